"""Toxicity: maximum-scoring segments over token log-odds, aggregated by extreme-value calibration.

Learning: in a bounded sample of labelled texts, count each feature (a word, or the beginning of a word) in the toxic
and in the other texts, once behind each word that it follows. The share of toxic ones among a feature's uses has a Dirichlet prior whose mean is the share
among the other uses of its parent (the feature shorter by one character), and so on down to the share of all. The
log-odds of that share against the share of all is the feature's weight. A word scores the weight of the longest
feature of it that is known, if that is significant, or a small loss.

Scoring: a linear scan (Ruzzo and Tompa) finds all maximal segments of a text's word scores. Scores of background text
have an extreme-value tail with parameter lambda, the root of sum p(s) exp(lambda s) = 1 over the clean texts of the
sample, so that a segment of score S has E = n exp(-lambda S) of its kind by chance among n words. The smallest joint E
of the best r segments is the evidence; a logistic curve, fitted on the sample, makes it a probability. The work on a
text grows with its length only.

Bound: the sample holds at most SAMPLE labelled rows, by the hash of doc_id; the model sent to the executors has those
of its features that are significant, or lie under one that is. Everything else runs over every text.

Defined cases: a null or empty text has no words and no evidence; rows with a null doc_id are scored and never learned
from, held_out is false there; without labels, or with one class only, every score is the share of toxic ones (a half
without labels); repeated rows are scored each; labels with several rows for one doc_id count by their largest toxic;
other columns are not read by score() and pass through keep_clean() unchanged.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, crc_mod, cut, slices, small_batches

SAMPLE = 12_000
LONGEST_PREFIX = 12
SHORTEST_PREFIX = 3
LEAST_Z = 3.0
LEAST_WEIGHT = 2.0
MOST_WEIGHT = 8.0
LEAST_USES = 3
LEAST_TOXIC = 4
LOSS = -0.25
PRIOR_WEIGHT = 1.0  # Dirichlet mass of the parent's share
THRESHOLD = 0.7
SCHEMA = "doc_id long, held_out boolean, score double, predicted int, n_words long, n_passages long, passages string"
CEILING = 12.0  # evidence beyond this counts as this
#: ASCII characters that are no letters or digits are made spaces.
_FOLD = bytes(i if i >= 128 or chr(i).isalnum() else 32 for i in range(256))


def words(raw: bytes | None) -> list[bytes]:
    """The words of a text in lower case."""
    if not raw:
        return []
    return (raw.lower() if raw.isascii() else raw.decode().lower().encode()).translate(_FOLD).split()


def features(word: bytes) -> list[bytes]:
    """The word (marked by a final space) and its beginnings, cut between code points."""
    return [word + b" ", *(word[:k] for k in range(SHORTEST_PREFIX, min(LONGEST_PREFIX, len(word)) + 1) if k == len(word) or word[k] & 0xC0 != 0x80)]


class Model:
    """Word scores, the tail parameter and the logistic curve."""

    def __init__(self, scores: dict[bytes, float], tail: float = 1.0, slope: float = 1.0, level: float = 0.0) -> None:
        self.scores, self.tail, self.slope, self.level = scores, tail, slope, level
        self.memory: dict[bytes, float] = {}

    def parts(self) -> tuple:
        return self.scores, self.tail, self.slope, self.level

    def of_word(self, word: bytes) -> float:
        score = next((s for f in reversed(features(word)) if (s := self.scores.get(f)) is not None), LOSS)
        if len(self.memory) >= 150_000:
            self.memory.clear()
        self.memory[word] = score
        return score

    def of_words(self, tokens: list[bytes]) -> list[float]:
        known = self.memory.get
        return [s if (s := known(w)) is not None else self.of_word(w) for w in tokens]

    def passages(self, tokens: list[bytes]) -> list[tuple[float, int, int]]:
        """(log E, first word, end) of each maximal segment, the most significant first."""
        scores = self.of_words(tokens)
        n = math.log(max(len(scores), 1))
        return sorted((n - self.tail * s, a, b) for s, a, b in segments(scores))

    def evidence(self, found: list[tuple[float, int, int]]) -> float:
        """Minus the log of the smallest joint E of the r best segments, up to CEILING."""
        best = joint = 0.0
        for r, (log_e, _, _) in enumerate(found, 1):
            joint += log_e + (math.log(2) if r > 1 else 0)  # each further segment is paid for
            best = min(best, joint - math.lgamma(r + 1))
        return min(-best, CEILING)

    def score(self, found: list[tuple[float, int, int]]) -> float:
        x = self.slope * self.evidence(found) + self.level
        return 1 / (1 + math.exp(-x)) if x > -700 else 0.0


def segments(scores: list[float]) -> list[tuple[float, int, int]]:
    """All maximal scoring segments (score, start, end) in linear time."""
    held: list[list] = []  # [sum before it, sum after it, start, end]
    back: list[int] = []  # the nearest earlier segment with a smaller sum before it
    total = 0.0
    for i, s in enumerate(scores):
        if s <= 0:
            total += s
            continue
        new = [total, total + s, i, i + 1]
        total += s
        while True:
            j = len(held) - 1
            while j >= 0 and held[j][0] >= new[0]:
                j = back[j]
            if j < 0 or held[j][1] >= new[1]:
                held.append(new)
                back.append(j)
                break
            new[0], new[2] = held[j][0], held[j][2]
            del held[j:], back[j:]
    return [(b - a, i, j) for a, b, i, j in held]


def tail_parameter(clean: Counter) -> float:
    """The positive root of the moment equation over the scores of clean words (score -> how many)."""
    total = sum(clean.values())
    gains = [(s, n / total) for s, n in clean.items()] if total else []
    if not any(s > 0 for s, _ in gains):
        gains.append((3 * LEAST_WEIGHT, 0.5 / (total + 1)))
    moment = lambda x: sum(p * math.exp(min(x * s, 500)) for s, p in gains)
    low, high = 0.0, 20.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (low, mid) if moment(mid) > 1 else (mid, high)
    return max(low, 0.05)


def logistic(points: list[tuple[float, int]]) -> tuple[float, float]:
    """(slope, level) of the chance of y = 1 by x; a weak pull towards a slope of 1 keeps it finite."""
    x, y = np.array([p[0] for p in points]), np.array([p[1] for p in points], float)
    scale = max(float(np.std(x)), 1e-6)
    design, beta = np.stack([x / scale, np.ones(len(x))], 1), np.array([0.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        gradient = design.T @ (y - p) - np.array([0.1, 0.01]) * beta
        curve = (design * (p * (1 - p))[:, None]).T @ design + np.diag([0.1, 0.01])
        step = np.linalg.solve(curve, gradient)
        beta = beta + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return max(float(beta[0]) / scale, 1e-9), float(beta[1])


def weigh(uses: dict[bytes, tuple[int, int]], toxic: int, clean: int) -> dict[bytes, tuple[float, float]]:
    """(weight, z) of each feature in uses (feature -> uses in toxic and in clean texts), parents before children."""
    share = toxic / (toxic + clean)
    logit = lambda q: math.log(q / (1 - q))
    mean: dict[bytes, float] = {}
    out = {}
    for f in sorted(uses, key=len):
        t, c = uses[f]
        parent = next((p for p in reversed(features(f.rstrip(b" "))[1:]) if p != f and f.startswith(p) and p in mean), None)
        if parent is None:
            m = share
        else:
            pt, pc = uses[parent]
            m = (pt - t + PRIOR_WEIGHT * mean[parent]) / (pt + pc - t - c + PRIOR_WEIGHT)
        m = mean[f] = min(max(m, 1e-4), 1 - 1e-4)
        a, b = t + PRIOR_WEIGHT * m, c + PRIOR_WEIGHT * (1 - m)
        w = min(logit(a / (a + b)) - logit(share), MOST_WEIGHT)
        # how certain the counts make it, whatever share the parent hands down
        out[f] = (w, w / math.sqrt(1 / a + 1 / (c + PRIOR_WEIGHT * (1 - share))))
    return out


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """A model from at most `sample` labelled rows of docs(doc_id, text) whose crc32 remainder by 3 is not 1."""
    small_batches(docs.sparkSession)
    chosen = (
        labels.select(F.col("doc_id").alias("id"), F.col("toxic").cast("int").alias("y"))
        .where(F.col("id").isNotNull() & F.col("y").isNotNull() & (crc_mod(F.col("id"), 3) != 1))
        .groupBy("id").agg(F.max("y").alias("y"))
        .orderBy(F.xxhash64("id"), "id").limit(sample)
    )
    texts = cut(docs.select(F.col("doc_id").alias("id"), "text").join(F.broadcast(chosen), "id").select("text", F.least("y", F.lit(1)).alias("y")).distinct())
    numbers = dict(texts.groupBy("y").count().collect())
    toxic, clean = numbers.get(1, 0), numbers.get(0, 0)
    if not toxic or not clean:
        return Model({}, level=math.log((toxic + 0.5) / (clean + 0.5)))

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 64):
            word, before, toxic_ = [], [], []
            for raw, y in zip(as_bytes(batch.column(0)), batch.column(1).to_pylist()):
                said = words(raw)
                for a, w in set(zip([b"", *said], said)):
                    word.append(w)
                    before.append(a)
                toxic_ += [y] * (len(word) - len(toxic_))
            yield pa.RecordBatch.from_arrays([pa.array(word, pa.binary()), pa.array(before, pa.binary()), pa.array(toxic_, pa.int32())], names=["word", "before", "y"])

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, c = Counter(), Counter()

        def held() -> pa.RecordBatch:
            f = list(t)
            return pa.RecordBatch.from_arrays([pa.array(f, pa.binary()), pa.array([t[x] for x in f], pa.int64()), pa.array([c[x] for x in f], pa.int64())], names=["feature", "t", "c"])

        for batch in slices(batches, 1024):
            for w, n, m in zip(*(batch.column(i).to_pylist() for i in range(3))):
                for f in features(w):
                    t[f] += n
                    c[f] += m
            if len(t) > 50_000:  # parts of a sum are added behind the shuffle
                yield held()
                t.clear()
                c.clear()
        yield held()

    # a use behind the same word counts once in toxic and once in other texts, so that near copies of one text weigh little
    seen = texts.mapInArrow(pairs, "word binary, before binary, y int").groupBy("word", F.xxhash64("before").alias("b")).agg(F.max("y").alias("t"), F.max(1 - F.col("y")).alias("c"))
    uses = seen.groupBy("word").agg(F.sum("t").alias("t"), F.sum("c").alias("c"))
    sums = cut(uses.mapInArrow(spread, "feature binary, t long, c long").groupBy("feature").agg(F.sum("t").alias("t"), F.sum("c").alias("c")))
    read = lambda rows: {f: (t, c) for f, t, c in zip(*(rows.column(i).to_pylist() for i in range(3)))}
    uses = read(sums.where(F.col("t") >= LEAST_TOXIC).toArrow())
    certain = lambda w: w[0] >= LEAST_WEIGHT and w[1] >= LEAST_Z
    roots = {f for f, w in weigh(uses, toxic, clean).items() if certain(w)}

    def below(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([not roots.isdisjoint(features(f.rstrip(b" "))[1:]) for f in batch.column(0).to_pylist()], pa.bool_()))

    if roots:
        uses |= read(sums.where((F.col("t") < LEAST_TOXIC) & (F.col("t") + F.col("c") >= LEAST_USES)).mapInArrow(below, sums.schema).toArrow())
    weights = weigh(uses, toxic, clean)
    under = lambda f: f in roots or not roots.isdisjoint(features(f.rstrip(b" "))[1:])
    # of beginnings with the same uses, the longest stands for all
    covered = {p for f in weights if not f.endswith(b" ") for p in features(f)[1:-1][-1:] if uses.get(p) == uses[f]}
    ranked = sorted((f for f in weights if under(f) and f not in covered), key=lambda f: (-sum(uses[f]), f))
    model = Model({f: round(weights[f][0], 2) if certain(weights[f]) else LOSS for f in ranked})

    def background(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: Counter = Counter()
        for batch in batches:
            for raw in as_bytes(batch.column(0)):
                sums.update(model.of_words(words(raw)))
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.float64()), pa.array(list(sums.values()), pa.int64())], names=["s", "n"])

    rows = texts.where("y = 0").select("text").mapInArrow(background, "s double, n long").groupBy("s").agg(F.sum("n").alias("n")).toArrow()
    model.tail = tail_parameter(Counter(dict(zip(rows.column(0).to_pylist(), rows.column(1).to_pylist()))))

    def points(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [model.evidence(model.passages(words(raw))) for raw in as_bytes(batch.column(0))]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.float64()), batch.column(1)], names=["x", "y"])

    rows = texts.mapInArrow(points, "x double, y int").toArrow()
    model.slope, model.level = logistic(list(zip(rows.column(0).to_pylist(), rows.column(1).to_pylist())))
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """One row for each row of docs(doc_id, text): SCHEMA; passages: first:end of each significant passage, in words."""
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model.parts())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*sent.value)
        for batch in slices(batches, 1024):
            rows = []
            for raw in as_bytes(batch.column(1)):
                tokens = words(raw)
                found = own.passages(tokens)
                s = own.score(found)
                kept = sorted((a, b) for e, a, b in found if e < math.log(0.05))
                rows.append((s, int(s >= THRESHOLD), len(tokens), len(kept), ",".join(f"{a}:{b}" for a, b in kept)))
            columns = list(zip(*rows)) or [[]] * 5
            kinds = [pa.float64(), pa.int32(), pa.int64(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *(pa.array(c, t) for c, t in zip(columns, kinds))], names=["doc_id", "held_out", "score", "predicted", "n_words", "n_passages", "passages"])

    held = F.coalesce(crc_mod(F.col("doc_id"), 3) == 1, F.lit(False))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", held.alias("held_out")).mapInArrow(run, SCHEMA)


def keep_clean(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The rows of docs whose text the model does not call toxic, with all their columns."""
    small_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model.parts())
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*sent.value)
        for batch in slices(batches, 1024):
            yield batch.filter(pa.array([own.score(own.passages(words(raw))) < THRESHOLD for raw in as_bytes(batch.column(at))], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
