"""Secret scans: fixed patterns, and the cost of guessing values that stand in a credential context.

A value behind a credential word and a sign (":", "=", "=>") is cut into words, dates, repeats, character sequences,
keyboard walks and characters left to brute force; dynamic programming finds the cut that takes the fewest guesses. A
value that takes many guesses was not chosen by a person to be remembered: it is a secret (kind guess), unless a fixed
pattern has it already. Words cost by their rank in a dictionary: COMMON passwords, and the lists given as `words`,
which dictionary() reads from vocabularies whose entries are ordered by how common they are. One automaton finds all
words in a value, and every other part is found by sums along it, so that the time grows with its length (times its
logarithm for repeated blocks).

Repeated blocks: where the nearest earlier place of each window of 1, 2, 4, 8, ... characters lies at one distance for a
stretch that is at least as long as that distance, the stretch repeats the block before it. No length is too long.

Defined cases: a null or empty text has no spans; a null doc_id is kept; repeated rows are scanned each; other columns
are not read by scan() and pass through redact() unchanged. Offsets are code points, the end is exclusive.
"""

from __future__ import annotations

import base64
import hashlib
import json
import math
import re
from collections.abc import Iterator
from itertools import accumulate

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, slices, small_batches

# The kinds in order and what they match.
KINDS = ("assign", "access", "hex", "guess")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
CONTEXT = re.compile(
    r"""(?<![A-Za-z])(?:pwd|pass(?:code|phrase|word|wd)?|cred(?:ential)?s?|bearer|auth(?:orization)?|secret|token|(?:api|access|private|client|signing|encryption)[_\x20-]?(?:key|secret|token))(?:["']?\x20*(?::=|=>|[:=])\x20*|(?<=bearer)\x20+)["']?([^\s"'`,;<>(){}\[\]]+)""",
    re.I | re.A,
)
# Words that people choose, the commonest first.
COMMON = (
    "password love secret admin dragon monkey master shadow sunshine princess football baseball letmein welcome login hello "
    "freedom whatever trustno flower summer winter spring autumn test user guest root pass token change default example demo "
    "sample dummy changeme placeholder none null true false your here value string insert enter the and for key my new old"
).split()
LEET = str.maketrans("4310$57@", "aeiossta")
ROWS = ("`1234567890-=", " qwertyuiop[]", " asdfghjkl;'", " zxcvbnm,./")
SECRET_FROM = 10.0  # log10 of the guesses
SHORTEST = 6
HINTS = (b"pass", b"pwd", b"secret", b"token", b"api", b"cred", b"bearer", b"auth", b"key")
_HEX_BYTES = bytes(120 if chr(i) in "0123456789abcdef" else 32 for i in range(256))
SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_guess long, most_guesses double"


def _neighbours() -> dict[str, set[str]]:
    place = {c: (r, k) for r, row in enumerate(ROWS) for k, c in enumerate(row) if c != " "}
    return {a: {b for b, (s, j) in place.items() if b != a and abs(r - s) <= 1 and abs(k - j) <= 1} for a, (r, k) in place.items()}


NEXT_TO = _neighbours()
_DAY, _MONTH, _YEAR = r"(?:0[1-9]|[12]\d|3[01])", r"(?:0[1-9]|1[0-2])", r"(?:19|20)\d\d"
_DATE = re.compile(rf"{_YEAR}([-/._]?){_MONTH}\1{_DAY}|{_DAY}([-/._]?){_MONTH}\2{_YEAR}|{_MONTH}([-/._]?){_DAY}\3{_YEAR}|{_YEAR}")


def _alphabet(value: str) -> float:
    """log10 of the number of characters to try at each place."""
    n = sum(k for k, p in ((26, "[a-z]"), (26, "[A-Z]"), (10, "[0-9]"), (33, "[^A-Za-z0-9]")) if re.search(p, value))
    if re.fullmatch("[0-9a-f]+|[0-9A-F]+", value):
        n = min(n, 16)
    return math.log10(max(n, 2))


def dictionary(*vocabularies: str) -> dict[str, float]:
    """Words with log10 of their rank, from tokenizer files whose entries stand in the order of how common they are.

    A .json file lists words that end in "</w>", a .tiktoken file words behind a space.
    """
    words: dict[str, float] = {}
    for path in vocabularies:
        with open(path, "rb") as f:
            if path.endswith(".json"):
                ranked = sorted(json.load(f)["model"]["vocab"].items(), key=lambda x: x[1])
                found = [k[:-4] for k, _ in ranked if k.endswith("</w>")]
            else:
                ranked = sorted((int(b), base64.b64decode(a)) for a, b in map(bytes.split, f))
                found = [w[1:].decode(errors="replace").lower() for _, w in ranked if w.startswith(b" ")]
        for rank, word in enumerate(dict.fromkeys(w for w in found if len(w) >= 3 and w.isalpha())):
            words[word] = min(words.get(word, math.inf), math.log10(2 + rank))
    return words


class Guesser:
    """log10 of the fewest guesses for a value, with the words of COMMON and of a dictionary (word -> log10 of its rank)."""

    def __init__(self, words: dict[str, float] | None = None) -> None:
        ranked = dict(words or {})
        for i, w in enumerate(COMMON):
            ranked[w] = min(ranked.get(w, math.inf), math.log10(2 + i))
        self.words = ahocorasick.Automaton()
        for w, cost in ranked.items():
            if len(w) >= 3:
                self.words.add_word(w, (len(w), cost))
        self.words.make_automaton()

    def _found(self, low: str, extra: float, upper: list[int]) -> Iterator[tuple[int, int, float]]:
        """(start, end, cost) of the words in low, by end."""
        for last, (size, cost) in self.words.iter(low):
            end = last + 1
            yield end - size, end, cost + extra + (0.3 if upper[end] > upper[end - size] else 0.0)

    def __call__(self, value: str) -> float:
        n = len(value)
        if not n:
            return 0.0
        low = value.lower()
        if len(low) != n:
            low = "".join(x if len(x := c.lower()) == 1 else c for c in value)
        each = _alphabet(value)
        upper = [0, *accumulate(a != b for a, b in zip(value, low))]
        words: list[list[tuple[int, float]] | None] = [None] * (n + 1)
        plain = low.translate(LEET)
        for form, extra in ((low, 0.0), (plain, 0.5)) if plain != low else ((low, 0.0),):
            for start, end, cost in self._found(form, extra, upper):
                if words[end] is None:
                    words[end] = []
                words[end].append((start, cost))
        best, ahead = [0.0] * (n + 1), [math.inf] * (n + 1)
        runs, blocks = _runs(low, each), _blocks(low)
        for j in range(n + 1):
            if j:
                least = min(best[j - 1] + each, ahead[j])
                for i, cost in words[j] or ():
                    least = min(least, best[i] + cost + 0.3)
                best[j] = least
            if j < n:
                if value[j].isdigit() and (m := _DATE.match(value, j)) is not None:
                    ahead[m.end()] = min(ahead[m.end()], best[j] + (2.1 if m.end() - j == 4 else 4.7) + 0.3)
                for end, cost in (*runs(j), *blocks.get(j, ())):
                    ahead[end] = min(ahead[end], best[j] + cost + 0.3)
        return best[n]


def _runs(low: str, each: float):
    """A function of a place that gives (end, cost) of the runs from there: of one character, of steps by one, of neighbouring keys."""
    n = len(low)
    code = [ord(c) for c in low]
    same, step, walk = ([*range(1, n + 1)] for _ in range(3))
    turns = [0] * (n + 1)  # before a place
    for i in range(n - 2, -1, -1):
        if code[i] == code[i + 1]:
            same[i] = same[i + 1]
        if abs(code[i + 1] - code[i]) == 1:
            step[i] = step[i + 1] if i + 2 < n and code[i + 2] - code[i + 1] == code[i + 1] - code[i] else i + 2
        if low[i + 1] in NEXT_TO.get(low[i], ()):
            walk[i] = walk[i + 1]
    for i in range(1, n):
        turns[i + 1] = turns[i] + (i + 1 < n and walk[i - 1] > i + 1 and _turn(low, i))

    def at(i: int) -> Iterator[tuple[int, float]]:
        for ends, cost in ((same, each), (step, 1.7), (walk, 1.7)):
            if (j := ends[i]) - i >= 3:
                yield j, cost + (0.8 * (turns[j - 1] - turns[i + 1]) if ends is walk else 0.0) + math.log10(j - i)

    return at


def _blocks(low: str) -> dict[int, list[tuple[int, float]]]:
    """Place behind the first of equal blocks in a row -> (end of the row, cost of the other ones)."""
    found: dict[int, list[tuple[int, float]]] = {}
    n, k = len(low), 1
    rank = np.unique(np.frombuffer(low.encode("utf-32-le", "surrogatepass"), np.uint32), return_inverse=True)[1].astype(np.int64)
    while 2 * k <= n:
        order = np.argsort(rank, kind="stable")
        back = np.zeros(len(rank), np.int64)  # distance of the nearest earlier place of the same window
        again = rank[order[1:]] == rank[order[:-1]]
        back[order[1:][again]] = (order[1:] - order[:-1])[again]
        if not back.any():
            break  # longer windows are no more equal than these
        starts = np.flatnonzero(np.diff(back, prepend=-1))
        ends = np.append(starts[1:], len(back)) + k - 1
        size = back[starts]
        for a, b, d in zip(*(x[(size > 1) & (ends - starts >= size)].tolist() for x in (starts, ends, size))):
            found.setdefault(a, []).append((b, math.log10((b - a) // d + 1)))
        if len(rank) <= k:
            break
        rank = np.unique(rank[:-k] * (len(rank) + 1) + rank[k:], return_inverse=True)[1].astype(np.int64)
        k *= 2
    return found


def _turn(low: str, k: int) -> bool:
    a, b, c = (next((r, row.index(x)) for r, row in enumerate(ROWS) if x in row) for x in low[k - 1 : k + 2])
    return (b[0] - a[0], b[1] - a[1]) != (c[0] - b[0], c[1] - b[1])


def find(raw: bytes, guesses) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]], float]:
    """(spans of the fixed kinds, spans of kind guess, the dearest value's log10 guesses); a span is (start, kind, end). guesses: a Guesser."""
    low = raw.lower()
    hinted, keyed, hexed = any(h in low for h in HINTS), b"AKIA" in raw, b"x" * 24 in raw.translate(_HEX_BYTES)
    if not (hinted or keyed or hexed):
        return [], [], 0.0
    text, base, more, most = raw.decode(), [], [], 0.0
    if hinted:
        base += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if keyed:
        base += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    if hexed:
        base += [(m.start(), 2, m.end()) for m in HEX.finditer(text) if m.end() - m.start() >= 24]
    base.sort()
    if hinted:
        taken = sorted((s, e) for s, _, e in base)
        reach, at, k = 0, -1, 0
        for m in CONTEXT.finditer(text):
            a, b = m.span(1)
            b -= len(m[1]) - len(m[1].rstrip(".!?:"))
            if b - a < SHORTEST:
                continue
            cost = guesses(text[a:b])
            most = max(most, cost)
            while k < len(taken) and taken[k][0] < b:
                reach, k = max(reach, taken[k][1]), k + 1
            if cost >= SECRET_FROM and reach <= a and a >= at:
                more.append((a, 3, b))
                at = b
    return base, more, most


def _said(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))


def scan(docs: DataFrame, words: dict[str, float] | None = None) -> DataFrame:
    """One row for each row of docs(doc_id, text): SCHEMA. words: a dictionary(), sent to all workers."""
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(words or {})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        guesses = Guesser(sent.value)
        for batch in slices(batches, 1024):
            rows = []
            for raw in as_bytes(batch.column(1)):
                base, more, most = find(raw or b"", guesses)
                n = [sum(k == kind for _, k, _ in base) for kind in range(3)]
                rows.append((*n, hashlib.sha256(_said(base).encode()).hexdigest(), _said(base + more), len(more), most))
            columns = list(zip(*rows)) or [[]] * 7
            kinds = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, kinds))], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_guess", "most_guesses"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA)


def redact(docs: DataFrame, words: dict[str, float] | None = None, text: str = "text", mark: str = "[secret]") -> DataFrame:
    """docs with each secret in column text replaced by mark; all other columns as they were. Overlapping spans become one mark."""
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(words or {})

    def clean(raw: bytes | None, guesses: Guesser) -> str | None:
        if raw is None:
            return None
        base, more, _ = find(raw, guesses)
        if not base and not more:
            return raw.decode()
        s, out, at = raw.decode(), [], 0
        for a, _, b in sorted(base + more):
            if a >= at:
                out += [s[at:a], mark]
            at = max(at, b)
        return "".join(out) + s[at:]

    at = docs.columns.index(text)
    kind = pa.string()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        guesses = Guesser(sent.value)
        for batch in slices(batches, 1024):
            yield batch.set_column(at, batch.schema.field(at).with_type(kind), pa.array([clean(raw, guesses) for raw in as_bytes(batch.column(at))], kind))

    return docs.mapInArrow(run, docs.schema)
