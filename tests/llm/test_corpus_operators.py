"""Operators that look at the corpus as a whole, against brute force."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tessera.llm import decontaminate, graph, lm_score, near_dup, ngram_trie, queries, toxicity, url_filter
from tessera.llm.common import table

DOCS = "doc_id long, text string, n_shingles long, key string, band int, component_id string"


def frame(spark, pairs):
    """Documents with extra columns whose names clash with those the operators make."""
    return spark.createDataFrame([(i, t, 5, "k", 1, "c") for i, t in pairs], DOCS)


# near copies


def shingle_sets(rows):
    for i, t in rows:
        w = (t or "").encode().lower().split()
        yield i, {tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute_components(rows):
    sets = list(shingle_sets(rows))
    parent = {i: i for i, _ in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    where = defaultdict(list)
    for k, (_, s) in enumerate(sets):
        for g in s:
            where[g].append(k)
    for k, (i, s) in enumerate(sets):
        common = Counter(j for g in s for j in where[g] if j < k)
        for j, n in common.items():
            if 100 * n >= 85 * (len(s) + len(sets[j][1]) - n):
                a, b = find(i), find(sets[j][0])
                parent[max(a, b)] = min(a, b)
    return {i: (len(s), find(i)) for i, s in sets}


def family(seed, n, words, edits):
    """A text and n copies of it with some words changed."""
    rng = random.Random(seed)
    base = [f"w{rng.randrange(5000)}" for _ in range(words)]
    for _ in range(n):
        copy = list(base)
        for _ in range(rng.randrange(edits + 1)):
            copy[rng.randrange(words)] = f"x{rng.randrange(10**6)}"
        yield " ".join(copy)


def check_near(spark, rows):
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dup.resolve(frame(spark, rows)).collect()}
    for i, (n, c) in brute_components(rows).items():
        assert got[i] == (n, c, c == i), i


def test_near_copies(spark, sf_dir):
    rows = list(enumerate([None, "", "  ", "one two", "One  TWO\n", "a b c d e", "A b c d e", "a b c d e f"]))
    rows += [(100 + i, t) for i, t in enumerate(family(1, 60, 150, 6))] + [(300 + i, t) for i, t in enumerate(family(2, 40, 80, 3))] + [(500, "x " * 20000)]
    check_near(spark, rows)
    check_near(spark, [(r.doc_id, r.text) for r in table(spark, sf_dir, "documents").collect()])


def test_near_copies_in_chunks(spark, monkeypatch):
    """Buckets and families that are dealt out in pairs of small chunks."""
    monkeypatch.setattr(near_dup, "CHUNK", 8)
    check_near(spark, [(i, t) for i, t in enumerate(family(3, 70, 150, 8))])


def test_near_copies_by_shuffle(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "BROADCAST_IDS", 0)
    rows = [(i, t) for i, t in enumerate(family(4, 20, 100, 2))]
    check_near(spark, rows)
    kept = near_dup.keep_one(frame(spark, rows))
    assert kept.columns == frame(spark, rows).columns
    assert {r.doc_id for r in kept.collect()} == {c for _, c in brute_components(rows).values()}


def test_near_copies_null_and_repeated_ids(spark):
    rows = [(None, "a b c d e f"), (1, "a b c d e f"), (2, "p q r s t u"), (2, "a b c d e f"), (3, "p q r s t u")]
    got = sorted(((r.doc_id, r.component_id, r.kept) for r in near_dup.resolve(frame(spark, rows)).collect()), key=repr)
    by_id = {(i, c) for i, c, _ in got}
    assert (None, None) in by_id and (1, 1) in by_id and len(got) == 5
    assert near_dup.resolve(frame(spark, rows).where("false")).count() == 0
    assert near_dup.keep_one(frame(spark, rows)).where("doc_id is null").count() == 1


def test_near_copies_linked_by_a_repeated_id(spark):
    first, second = "a b c d e f", "p q r s t u"
    rows = [(1, first), (2, second), (5, first), (5, second), (7, "other words stand in this one")]
    got = {(r.doc_id, r.component_id, r.kept) for r in near_dup.resolve(frame(spark, rows)).collect()}
    assert got == {(1, 1, True), (2, 1, False), (5, 1, False), (7, 7, True)}
    rng = random.Random(11)
    texts = [f"text {i} of a small set stands here" for i in range(40)]
    rows = [(rng.randrange(60), rng.randrange(40)) for _ in range(90)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for i, t in rows:
        a, b = sorted((find(i), find(("text", t))), key=lambda x: (isinstance(x, tuple), x))
        root[b] = a
    least = {}
    for i, _ in rows:
        least[find(i)] = min(least.get(find(i), i), i)
    for r in near_dup.resolve(frame(spark, [(i, texts[t]) for i, t in rows])).collect():
        assert r.component_id == least[find(r.doc_id)], r


def test_sketches():
    rng = np.random.default_rng(5)
    h = rng.integers(0, 2**63, 3000, dtype=np.uint64)
    sets = [np.sort(h[:2000]), np.sort(h[300:2300]), np.sort(h[:10]), np.sort(h[:1])]
    r = near_dup.registers(near_dup.minima(sets))
    again = near_dup.registers(near_dup.minima(sets[::-1]))[::-1]
    assert (r == again).all()  # whatever else is in the batch
    union = near_dup.registers(near_dup.minima([np.unique(np.concatenate(sets[:2]))]))[0]
    assert (union == np.maximum(r[0], r[1])).all()  # mergeable
    up, down = (r[0] > r[1]).sum(), (r[0] < r[1]).sum()
    est = near_dup.estimate(np.array([up]), np.array([down]), np.array([2000.0]), np.array([2000.0]))[0]
    assert abs(est - 1700 / 2300) < 0.15


def test_components(spark):
    rng = random.Random(6)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(60)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got.get(x, x) == find(x) for x in parent)
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


# decontamination


def test_decontamination(spark):
    rng = random.Random(7)
    word = lambda: f"v{rng.randrange(3000)}"
    items = [(i, " ".join(word() for _ in range(rng.randrange(15, 60)))) for i in range(30)] + [(90, None), (91, ""), (92, "tiny item"), (None, "no id here at all")]
    docs, truth = [], set()
    for d in range(200):
        w = [word() for _ in range(rng.randrange(30, 300))]
        if d % 5 == 0:  # a copy, every other one edited
            item = d // 5 % 30
            copy = items[item][1].split(" ")
            if d % 10:
                copy = [x if rng.random() > 0.12 else word() for x in copy]
                del copy[len(copy) // 2]
            at = rng.randrange(len(w))
            w[at:at] = copy
            truth.add((d, item))
        docs.append((d, " ".join(w)))
    docs += [(i, "all alike " + items[3][1].upper() + " end") for i in range(300, 500)] + [(600, None), (601, ""), (None, items[4][1])]
    truth |= {(i, 3) for i in range(300, 500)}
    frame_items = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.hits(frame(spark, docs), frame_items).collect()
    assert {(r.doc_id, r.item_id) for r in found} == truth
    exact = [r for r in found if r.doc_id >= 300]
    assert all(r.score == 1.0 and r.first_word == 2 and r.last_word == 1 + r.n_item for r in exact)
    kept = {r.doc_id for r in decontaminate.clean(frame(spark, docs), frame_items).collect()}
    assert kept == {d for d, _ in docs} - {d for d, _ in truth}
    assert decontaminate.hits(frame(spark, docs).where("false"), frame_items).count() == 0
    assert decontaminate.hits(frame(spark, docs), frame_items.where("false")).count() == 0


def edited_copies(n_docs):
    """Two test items of 38 words, and for each n_docs documents of random words around one copy: four words changed, or cut short."""
    rng = random.Random(n_docs)
    words = lambda n: [f"v{rng.randrange(3000)}" for _ in range(n)]
    whole, changed = words(38), words(38)
    items = [(1, " ".join(whole)), (2, " ".join(changed))]
    for i in (4, 13, 22, 31):
        changed[i] = "other"
    copies = [whole[:25], changed]
    return items, [(i, " ".join(words(40) + copies[i % 2] + words(40))) for i in range(2 * n_docs)]


@pytest.mark.parametrize("n_docs", [5, 50, 500])
def test_decontamination_of_one_edited_copy_in_many_documents(spark, n_docs):
    items, docs = edited_copies(n_docs)
    plain = [(10**6 + i, t) for i, t in enumerate(family(12, 20, 100, 5))]
    found = decontaminate.hits(frame(spark, docs + plain), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in found} == {(i, 1 + i % 2) for i, _ in docs}


def test_decontamination_of_a_long_item_whose_seeds_stand_together(spark):
    """Every third word is changed but in the middle, so only the middle has seeds."""
    item = [f"v{i}" for i in range(3000)]
    copy = [w if i % 3 or 1480 <= i < 1520 else "other" for i, w in enumerate(item)]
    found = decontaminate.hits(frame(spark, [(1, " ".join(copy))]), spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")).collect()
    assert [(r.doc_id, r.item_id, r.n_matched) for r in found] == [(1, 1, sum(a == b for a, b in zip(item, copy)))]


def test_decontamination_of_a_very_long_item(spark):
    rng = random.Random(3)
    item = [f"v{rng.randrange(4000)}" for _ in range(20_000)]
    edited = list(item)
    for i in range(0, len(edited), 9):
        edited[i] = "changed"
    docs = [(1, "before " * 50 + " ".join(item) + " after" * 50), (2, " ".join(edited)), (3, " ".join(item[:3000])), (4, "nothing of it")]
    got = {r.doc_id: r.score for r in decontaminate.hits(frame(spark, docs), spark.createDataFrame([(9, " ".join(item))], "item_id long, text string")).collect()}
    assert set(got) == {1, 2} and got[1] == 1 and got[2] > 0.8


def test_decontamination_of_two_texts_of_one_item(spark):
    one, two = " ".join(f"one{i}" for i in range(20)), " ".join(f"two{i}" for i in range(30))
    items = spark.createDataFrame([(1, one), (1, two), (1, two)], "item_id long, text string")
    docs = [(1, f"x {one} y"), (2, f"x {two} y"), (3, "x y z")]
    got = sorted((r.doc_id, r.score, r.n_item) for r in decontaminate.hits(frame(spark, docs), items).collect())
    assert got == [(1, 1.0, 20), (2, 1.0, 30)]


def test_alignment():
    rng = random.Random(8)
    for _ in range(60):
        a, b = ([rng.choice("abcde") for _ in range(rng.randrange(1, 12))] for _ in range(2))
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a, 1):
            for j, y in enumerate(b, 1):
                best[i][j] = max(0, best[i - 1][j - 1] + (2 if x == y else -1), best[i - 1][j] - 1, best[i][j - 1] - 1)
        same, other, i, j = decontaminate.align(a, b)
        assert 2 * same - other == max(map(max, best)) and 0 <= i <= j <= len(b)


# url filters


def brute_verdict(url, rules):
    at = (url or "").find("://")
    host = path = ""
    if at >= 0:
        rest = url[at + 3 :]
        end = min([k for c in "/?#" if (k := rest.find(c)) >= 0], default=len(rest))
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:end])
        path = rest[end:]
        path = path[: min([k for c in "?#" if (k := path.find(c)) >= 0], default=len(path))]
    fits = [(len(h) + len(p), len(h), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[2], best[3] if best else "allow" if host else "block"


@pytest.mark.parametrize("range_rows", [7, 20_000])
def test_url_filter(spark, monkeypatch, range_rows):
    monkeypatch.setattr(url_filter, "RANGE_ROWS", range_rows)
    rng = random.Random(9)
    hosts = ["a.org", "b.a.org", "x-a.org", "org", "c.b.a.org", "Example.COM", "com", "a.org.", ".org", "exa mple", "ü.org"]
    paths = ["", "/", "/es/", "/es/x", "/en/12", "/en/1", "/fr/?q=/de/", "/de/#x", "?a", "#b"]
    urls = [f"http://{rng.choice(hosts)}{rng.choice(paths)}" for _ in range(300)] + [None, "", "nothing", "://", "x://y://z/", "http:///p"] + ["http://b.a.org/es/hot"] * 300
    rules = [("org", "/", "allow"), ("a.org", "/es/", "block"), ("a.org", "/en/1", "block"), ("b.a.org", "/", "allow"), ("com", "/fr/", "allow"), ("a.org", "/e", "allow"), ("example.com", "", "block")]
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)] + [(None, "http://a.org/es/", "h")], "page_id long, url string, host string")
    got = url_filter.judge(pages, url_filter.rule_table(spark, rules)).collect()
    assert len(got) == len(urls) + 1
    for r in got:
        u = "http://a.org/es/" if r.page_id is None else urls[r.page_id]
        assert (r.host, r.path, r.rule, r.verdict) == brute_verdict(u, rules), u
    assert url_filter.judge(pages.where("false"), url_filter.rule_table(spark)).count() == 0
    nothing = url_filter.judge(pages, url_filter.rule_table(spark).where("false")).collect()
    assert {r.rule for r in nothing} == {None}


def test_url_filter_sql(spark, sf_dir):
    from oracle import connect, rows

    mine = queries.op3_url_filter(spark, sf_dir).toPandas()
    assert rows(mine) == rows(connect(sf_dir).execute(queries.ORACLES["op3_url_filter"]).df())


# toxicity


def brute_segments(scores):
    """All maximal segments: the best one, then the same left and right of it."""
    out = []

    def split(a, b):
        best = max(((sum(scores[i:j]), -(j - i), i, j) for i in range(a, b) for j in range(i + 1, b + 1)), default=(0,))
        if best[0] > 0:
            s, _, i, j = best
            out.append((round(s, 6), i, j))
            split(a, i)
            split(j, b)

    split(0, len(scores))
    return sorted(out)


def test_segments():
    rng = random.Random(10)
    for _ in range(80):
        scores = [rng.choice([-3.1, -1.03, -0.51, 0.77, 2.13, 4.07]) + rng.random() / 100 for _ in range(rng.randrange(0, 14))]
        assert sorted((round(s, 6), i, j) for s, i, j in toxicity.segments(scores)) == brute_segments(scores)


def test_features_of_long_words():
    assert [len(toxicity.features(b"x" * n)) for n in (2, 12, 64, 65, 5000)] == [1, 11, 11, 11, 11]


def test_toxicity(spark):
    sf_dir = "/root/testdata/sf0.01"
    out = queries.op4_toxicity(spark, sf_dir).join(table(spark, sf_dir, "labels").select("doc_id", "toxic"), "doc_id", "left").collect()
    assert len(out) == 1000
    for r in out:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
    held = [r for r in out if r.held_out and r.toxic is not None]
    toxic, clean = [r for r in held if r.toxic], [r for r in held if not r.toxic]
    assert sum(r.predicted for r in toxic) >= 0.7 * len(toxic) and sum(r.predicted for r in clean) <= 0.02 * len(clean)


def test_toxicity_cases(spark):
    docs = frame(spark, [(i, t) for i, t in enumerate([None, "", "plain words", "x " * 50_000])] + [(None, "text"), (2, "plain words")])
    none = spark.createDataFrame([], "doc_id long, toxic int")
    out = toxicity.score(docs, toxicity.learn(docs, none)).collect()
    assert len(out) == 6 and {round(r.score, 6) for r in out} == {0.5}
    one = spark.createDataFrame([(2, 1), (2, 0), (None, 1), (0, None)], "doc_id long, toxic int")
    assert toxicity.keep_clean(docs, toxicity.learn(docs, one)).columns == docs.columns
    model = toxicity.learn(docs, none)
    assert toxicity.score(docs.where("false"), model).count() == 0 and toxicity.keep_clean(docs, model).count() == 6


# language model


def test_lm(spark, sf_dir):
    rows = {r.doc_id: (r.text or "").encode().lower().split() for r in table(spark, sf_dir, "documents").collect()}
    counts = Counter()
    for i, w in rows.items():
        if zlib.crc32(str(i).encode()) % 10:
            counts.update([*w, None])
    total, kinds = sum(counts.values()), len(counts)
    for r in lm_score.score(table(spark, sf_dir, "documents"), block_bytes=60_000).collect():
        w = [*rows[r.doc_id], None]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(w), sum(counts[x] > 0 for x in w), total)
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 10 == 0)
        assert r.base_score == pytest.approx(sum(math.log10((counts[x] + 0.1) / (total + 0.1 * (kinds + 1))) for x in w))
        assert r.score < 0


def test_lm_is_a_distribution(spark):
    """All texts of up to three words over a small vocabulary with one unknown word: their chances and those of longer ones sum to one."""
    import itertools

    train = [(i, " ".join(random.Random(i).choices(["a", "b", "c"], [5, 2, 1], k=random.Random(i).randrange(3)))) for i in range(1, 400)]
    ids = [i for i in range(10**6, 10**6 + 5000) if zlib.crc32(str(i).encode()) % 10 == 0]
    texts = [" ".join(t) for n in range(4) for t in itertools.product(["a", "b", "c", "unknown"], repeat=n)]
    out = lm_score.score(spark.createDataFrame(train + list(zip(ids, texts)), "doc_id long, text string"))
    mass = sum(10**r.score for r in out.where("doc_id >= 1000000").collect())
    assert 0.95 < mass <= 1.01


def test_lm_cases(spark):
    docs = frame(spark, [(1, None), (2, ""), (3, "a b"), (3, "a b"), (None, "a z"), (4, "y " * 30_000)])
    out = lm_score.score(docs).collect()
    assert len(out) == 6 and {r.n_tokens for r in out} == {1, 3, 30_001}
    assert lm_score.score(docs.where("doc_id is null")).first().train_tokens == 0
    assert lm_score.score(docs.where("false")).count() == 0


def test_lm_knows_all_word_trigrams(spark):
    """Scores against counts of all trigrams of words that are each rare."""
    rng = random.Random(13)
    docs = [(i, " ".join(f"r{rng.randrange(400)}" for _ in range(rng.randrange(30)))) for i in range(300)]
    docs += [(1000 + i, " ".join(docs[i][1].split()[::-1]) + " never seen") for i in range(20)]
    seqs = {i: ["<", "<", *t.split(), ">"] for i, t in docs}
    train = [s for i, s in seqs.items() if zlib.crc32(str(i).encode()) % 10]
    one, two, three, behind = Counter(), Counter(), Counter(), defaultdict(set)
    for s in train:
        one.update(s[2:])
        two.update(zip(s[1:], s[2:]))
        for a, b, c in zip(s, s[1:], s[2:]):
            three[a, b, c] += 1
            behind[a, b].add(c)
    seen = Counter(n for w, n in one.items() if w != ">")
    d = lm_score.discounts([seen[k] for k in (1, 2, 3, 4)])
    whole = sum(one.values())
    unseen = sum(d[min(k, 3) - 1] * n for k, n in seen.items()) / whole

    def chance(a, b, c):
        p = one[c] / whole if c == ">" else (one[c] - d[min(one[c], 3) - 1]) / whole if one[c] else unseen
        used = len(train) if b == "<" else one[b]
        if used:
            p = (two[b, c] + used**lm_score.HEAPS * p) / (used + used**lm_score.HEAPS)
        used, kinds = sum(three[a, b, x] for x in behind[a, b]), len(behind[a, b])
        return (three[a, b, c] + kinds * p) / (used + kinds) if used else p

    for r in lm_score.score(frame(spark, docs), block_bytes=9_000).collect():
        s = seqs[r.doc_id]
        # each of the trie's codes is off by half a step at most
        assert r.score == pytest.approx(sum(math.log10(chance(*x)) for x in zip(s, s[1:], s[2:])), abs=ngram_trie.STEP * len(s))


def test_lm_shuffles_little(spark, sf_dir):
    """Words are not counted in a shuffle of their own, and texts are shuffled once and compressed."""
    docs = table(spark, sf_dir, "documents")
    sc = spark.sparkContext
    sc.setJobGroup("lm", "lm")
    lm_score.score(docs, block_bytes=200_000).collect()
    sc.setLocalProperty("spark.jobGroup.id", None)
    stages = {i for job in sc.statusTracker().getJobIdsForGroup("lm") for i in sc.statusTracker().getJobInfo(job).stageIds}
    written = sum(sc._jsc.sc().statusStore().lastStageAttempt(i).shuffleWriteBytes() for i in stages)
    size = sum(len((r.text or "").encode()) for r in docs.collect())
    assert written < 2.6 * size


def test_lm_blocks_ask_all_parts(spark):
    """Blocks with fewer words than there are parts know the sums of all words; texts on both sides of the compressed length."""
    rng = random.Random(17)
    docs = [(i, "".join(rng.choice("ab\u00e9\u4e2d \n") for _ in range(n))) for i, n in enumerate([0, 1, 3, 100, 127, 128, 129, 255, 256, 257, 3000])]
    docs += [(50, "a " * 128), (51, rng.randbytes(400).decode("latin-1")), (None, "a b")]
    whole, blocks = (sorted(map(tuple, lm_score.score(frame(spark, docs), block_bytes=n).collect()), key=str) for n in (1 << 20, 200))
    for a, b in zip(whole, blocks, strict=True):
        assert a[:5] == b[:5] and a[5:] == pytest.approx(b[5:])


def test_trie():
    rng = np.random.default_rng(11)
    v = np.sort(rng.integers(0, 10**6, 3000))
    assert (ngram_trie.Monotone(**ngram_trie.Monotone.pack(v)).at(np.arange(3000)) == v).all()
    n_contexts, kinds = 300, Counter()
    entries = Counter((int(rng.integers(0, n_contexts)) * 7919, int(rng.integers(0, 40)) << 20) for _ in range(3000))
    uses = Counter()
    for (c, _), n in entries.items():
        uses[c] += n
        kinds[c] += 1
    context, word, n = (np.array(x) for x in zip(*((c, w, n) for (c, w), n in entries.items())))
    twice = [np.concatenate((x, x)) for x in (context.astype(np.uint64), word.astype(np.uint32), n)]  # equal entries are added
    trie = ngram_trie.WordTrie(ngram_trie.WordTrie.build(*twice))
    asked = [7919 * int(c) for c in np.sort(rng.integers(0, n_contexts + 50, 500))]
    words = [int(w) << 20 for w in rng.integers(0, 45, 1000)]
    found = trie.find(np.array(asked, np.uint64), np.full(500, 2), np.array(words, np.uint32))
    near = lambda a, b: a == pytest.approx(b, rel=ngram_trie.STEP * math.log(10) / 2 + 1e-9)
    for i, c in enumerate(asked):
        u, k = 2 * uses[c], kinds[c]
        assert near(ngram_trie.whole_numbers(found[0][i : i + 1])[0], u)
        assert near(ngram_trie.shares(found[1][i : i + 1])[0], k / (u + k) if u else 0)
        for j in (2 * i, 2 * i + 1):
            assert near(ngram_trie.shares(found[2][j : j + 1])[0], 2 * entries[c, words[j]] / (u + k) if u else 0)
    nothing = ngram_trie.WordTrie(ngram_trie.WordTrie.build(*(x[:0] for x in twice)))
    assert not any(x.any() for x in nothing.find(np.array([1], np.uint64), np.array([1]), np.array([1], np.uint32)))


def test_query_names():
    assert [n.split("_")[0] for n in sorted(queries.QUERIES, key=lambda n: int(n[2:].split("_")[0]))] == [f"op{i}" for i in range(1, 11)]
