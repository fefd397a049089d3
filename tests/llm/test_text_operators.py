"""Operators that look at each text alone, against brute force."""

import hashlib
import re
from collections import Counter

import pytest

from tessera.llm import license_scan, quality_rules, queries, secret_scan
from tessera.llm import sentencepiece_codec as codec
from tessera.llm.common import Roller, table

HEX = "04dbebab91ab85687d33eeaaf9ac699e1188f962"
ODD = [
    None, "", " ", "a", "  two  spaces ", "\n", "\n\nx", "a \n b", "日本語 🙂 text", "▁", "a▁b", "<s> </s>", "\x00a", "a" * 700, "x\ny\nx\nx", "É é", "the the the the the the",
    f'token = "{HEX}"', f"api_key: {HEX} AKIA{'Q7' * 10} end", "password=short", "pwd is hunter2!Zq8 and x", "pwd: hunter2!Zq8 and x", "x" * 300 + " y " * 3000,
    "Released under the MIT License.", "apache license, version 2.0 and cc-by-nc cc by nc", "this work is licensed under the very gnu general public license version 3", "KEYK ſecret=abcdefgh",
]


@pytest.fixture(scope="module")
def docs(spark):
    """The odd texts, a null id, repeated rows and extra columns with clashing names."""
    rows = [(i, t, "s", i, -1.0) for i, t in enumerate(ODD)] + [(None, "a b c", None, None, None), (3, "a", "s", 3, -1.0)]
    return spark.createDataFrame(rows, "doc_id long, text string, kept string, n_words long, score double")


@pytest.fixture(scope="module")
def corpus(spark, sf_dir):
    return {r.doc_id: r.text for r in table(spark, sf_dir, "documents").collect()}


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def test_sentencepiece(spark, docs, sf_dir, corpus):
    library = codec.Codec(queries.piece_model()).library

    def expected(t):
        ids = library.encode(t or "")
        return len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids))

    got = codec.encode_documents(docs, queries.piece_model()).collect()
    assert len(got) == len(ODD) + 2 and all(r.agrees for r in got)
    for r in got:
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == expected("a b c" if r.doc_id is None else ODD[r.doc_id])
    for r in queries.op1_sentencepiece(spark, sf_dir).collect():
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == expected(corpus[r.doc_id]) and r.agrees


def test_codec_memory_is_bounded():
    small = codec.Codec(queries.piece_model(), remembered=50)
    texts = [f"word{i} and {i * 7} more" for i in range(300)]
    for t in texts:
        assert small.encode(t) == small.library.encode(t)
        assert small.decode(small.encode(t)) == t
        small.check()
    assert len(small.known) <= 60 and len(small.older) <= 60


def test_codec_memory_is_bounded_in_bytes():
    small = codec.Codec(queries.piece_model(), remembered_bytes=100_000)
    for i in range(40):
        t = chr(97 + i % 26) * 5_000 + str(i)  # one part
        assert small.encode(t) == small.library.encode(t)
        small.check()
        assert small.held < 200_000
    assert len(small.known) + len(small.older) < 40


def test_sentencepiece_long_text_without_spaces(spark):
    library = codec.Codec(queries.piece_model()).library
    text = "".join(chr(97 + (i * i * 7 + i // 11) % 26) for i in range(300_000))
    (row,) = codec.encode_documents(spark.createDataFrame([(1, text)], "doc_id long, text string"), queries.piece_model()).collect()
    ids = library.encode(text)
    assert (row.n_tokens, row.ids_sha256, row.decoded_sha256) == (len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids))) and row.agrees


def test_numbers():
    assert codec.numbers(["1,2,31999", "", "4"]) == [[1, 2, 31999], [], [4]] and codec.numbers([]) == []


def test_codec_takes_the_library_where_it_differs():
    c = codec.Codec(queries.piece_model())
    c.score = {}  # no merges: the agenda gives single characters
    c.encode_text("hello")
    assert c.check() == {"hello"}
    assert c.encode("hello") == c.library.encode("hello")


def test_codec_without_word_boundaries():
    c = codec.Codec(queries.piece_model())
    c.by_word = False
    for t in ("hello world  again\n", "a▁b", "日本 x"):
        assert c.encode(t) == c.library.encode(t)
        assert c.decoded_text(t, c.encode(t)) == c.library.decode(c.library.encode(t))
    c.score = {}
    texts = ["hello world", "", "a"]
    found = list(map(c.encode_text, texts))
    assert c.check_texts(texts, found) == {"hello world", "a"}  # without merges, no word mark joins its word
    assert codec.numbers(found) == c.library.encode(texts)


def brute_quality(s):
    w = re.findall(r"[^\x20\x09-\x0D]+", s)
    grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    marked = {j for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    seen, lines = set(), 0
    for line in s.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            lines += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for x in w for c in x), lines, len(marked)


def test_quality(spark, docs, sf_dir, corpus):
    for rows, texts in ((quality_rules.judge(docs), dict(enumerate(ODD)) | {None: "a b c"}), (queries.op8_quality(spark, sf_dir), corpus)):
        for r in rows.collect():
            n, chars, symbols, lines, repeats = brute_quality(texts[r.doc_id] or "")
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, lines, repeats)
            assert r.base_failed == (n < 50 or 100 * repeats > 50 * n) and not (r.base_failed and r.kept)


def test_quality_coverage():
    words = [f"w{i}" for i in range(60)]
    clean, copied = " ".join(words), " ".join(words + words)
    (a, b) = quality_rules.measure([clean.encode(), copied.encode()], Roller())
    assert a[6] and a[7:] == (0.0, 0.0, 0.0, 0.0)
    assert not b[6] and b[7] == 1.0 and b[9] == 1.0


def brute_secrets(s):
    found = [(m.start(), 0, m.end()) for m in re.finditer(r"""(?a:(?i:(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)))""", s) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", s) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", s) if len(m[0]) >= 24]
    return sorted(found)


def test_secrets(spark, docs, sf_dir, corpus):
    for rows, texts in ((secret_scan.scan(docs), dict(enumerate(ODD)) | {None: "a b c"}), (queries.op9_secrets(spark, sf_dir), corpus)):
        for r in rows.collect():
            base = brute_secrets(texts[r.doc_id] or "")
            said = ",".join(f"{secret_scan.KINDS[k]}:{a}:{b}" for a, k, b in base)
            assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == n for _, k, _ in base) for n in range(3))
            assert r.base_sha256 == sha(said) and set(said.split(",")) - {""} <= set(r.spans.split(","))


def test_secret_guesses_and_redaction(spark, docs):
    cost = {v: secret_scan.Guesser()(v) for v in ("password123", "qwertyuiop", "aaaaaaaaaaaa", "letmein2012", "12/31/1999", "abcabcabcabc", HEX, "xK9#mQ2$vL", "")}
    assert all(cost[v] < secret_scan.SECRET_FROM for v in ("password123", "qwertyuiop", "aaaaaaaaaaaa", "letmein2012", "12/31/1999", "abcabcabcabc", ""))
    assert all(cost[v] > secret_scan.SECRET_FROM for v in (HEX, "xK9#mQ2$vL"))
    out = {r.doc_id: r for r in secret_scan.redact(docs).collect()}
    assert out[ODD.index("pwd: hunter2!Zq8 and x")].text == "pwd: [secret] and x"
    prose = ODD.index("pwd is hunter2!Zq8 and x")
    assert out[prose].text == ODD[prose]  # a sentence is no context
    assert out[0].text is None and out[3].text == "a" and out[3].kept == "s"
    assert HEX not in out[ODD.index(f'token = "{HEX}"')].text
    assert secret_scan.redact(docs).columns == docs.columns


PROSE = [
    "The secret is simplicity and hard work.", "His password is required before noon.", "The secret: consistency, understanding and patience.", "Authorization: required for all visitors.",
    "Bearer bonds were sold.", "password: incorrect", "Token: nonrefundable after purchase.", "Access key: available downstairs.", "Their credentials: impressive and international.", "passphrase = correct",
]


def test_secrets_in_prose_and_planted():
    import random
    import string

    guesses = secret_scan.Guesser(queries.guess_words())
    for s in PROSE:
        assert secret_scan.find(s.encode(), guesses)[1] == [], s
    rng, chars, caught = random.Random(3), string.ascii_letters + string.digits + "!#$%&*+-/?@^_~", 0
    for i in range(400):
        value = "".join(rng.choice(chars) for _ in range(rng.randrange(9, 17)))
        text = f"some words {rng.choice(['pwd: ', 'passphrase = ', 'auth => ', 'private key: ', 'client_secret := '])}{value}\nmore"
        base, more, _ = secret_scan.find(text.encode(), guesses)
        caught += any(a <= text.index(value) and text.index(value) + len(value.rstrip(".!?:")) <= b for a, _, b in base + more)
    assert caught >= 0.9 * 400


def brute_guesses(value, words, each):
    """The cheapest cut by trying all of them, with words and brute force only."""
    best = [0.0]
    for j in range(1, len(value) + 1):
        best.append(min([best[j - 1] + each, *(best[i] + words[value[i:j]] + 0.3 for i in range(j) if value[i:j] in words)]))
    return best[-1]


def test_guess_costs():
    import random
    import time

    rng, words = random.Random(4), {"gra": 1.0, "grape": 3.5, "ape": 2.0, "pear": 1.5, "earl": 2.5}
    guesses = secret_scan.Guesser(words)
    for _ in range(200):
        value = "".join(rng.choice(["gra", "grape", "pear", "l", "x", "p"]) for _ in range(rng.randrange(1, 5)))
        if not any(len(set(value[i : i + 3])) == 1 for i in range(len(value))):
            assert guesses(value) <= brute_guesses(value, words, secret_scan._alphabet(value)) + 1e-9
    assert guesses("xgrapeq") == pytest.approx(brute_guesses("xgrapeq", words, secret_scan._alphabet("xgrapeq")))
    block = "".join(rng.choice("abcdefghijkmnopqrstuvwxyz0123456789") for _ in range(133))
    assert guesses(block * 3) < guesses(block) + 3  # whatever the length of the block
    for value in ("a" * 10**6, "abc" * 333_333, block * 7500):
        began = time.perf_counter()
        guesses(value)
        assert time.perf_counter() - began < 60


def brute_licenses(s):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", s.translate({c: c + 32 for c in range(65, 91)}))
    places = [(p, label) for phrase, label in license_scan.BASE for k in [phrase.split()] for p in range(len(w) - len(k) + 1) if w[p : p + len(k)] == k]
    starts = [p for p, _ in places]
    return len(w), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places}))


def test_licenses(spark, docs, sf_dir, corpus):
    for rows, texts in ((license_scan.scan(docs), dict(enumerate(ODD)) | {None: "a b c"}), (queries.op6_license_scan(spark, sf_dir), corpus)):
        out = rows.collect()
        assert len(out) == (len(ODD) + 2 if texts is not corpus else len(corpus))
        for r in out:
            assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute_licenses(texts[r.doc_id] or "")
            assert set(r.base_labels.split(",")) - {""} <= set(r.labels.split(",")) and 0 <= r.score <= 1
    out = {r.doc_id: r for r in license_scan.scan(docs).collect()}
    changed = out[ODD.index("this work is licensed under the very gnu general public license version 3")]
    assert "gpl-3" in changed.labels and changed.score < 1  # a word was put in


def test_licenses_told_apart(spark):
    said = [(phrase, label) for phrase, label in license_scan.MORE] + [
        ("Licensed under the GNU General Public License version 3", "gpl-3"), ("GNU General Public License, version 2", "gpl-2"), ("the GNU General Public License, as it is", "gpl"),
        ("under the MIT license, or the GNU Lesser General Public License, version 2.1", "lgpl-2.1,mit"), ("Apache Software License, Version 1.1", "apache-1.1"), ("Apache License, Version 2.0", "apache-2"),
    ]
    rows = [(i, f"some words before. {text} and words after it") for i, (text, _) in enumerate(said)]
    for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        assert r.labels == said[r.doc_id][1], said[r.doc_id]


def test_empty_tables(spark, docs):
    none = docs.where("false")
    for f in (lambda d: codec.encode_documents(d, queries.piece_model()), quality_rules.judge, secret_scan.scan, secret_scan.redact, license_scan.scan):
        assert f(none).count() == 0
