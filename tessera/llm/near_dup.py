"""Near-duplicate detection with SetSketch registers.

Each document's set of word shingles becomes M registers. A shingle's hash drives a Poisson process of rate M whose
points fall on random registers; a register's value is the place of its least point, on an exponential scale. Points are
made up to a bound at which all registers are likely covered (truncated minima), and further out where one is not, so
the values are exact, depend on the set only, and those of a union are the elementwise maxima.

Documents with equal sets form a class with one representative. Bands of ROWS registers give bucket keys. In a first
round each member of a bucket is held against the bucket's least member only: the likelihood of the Jaccard similarity
given which of two documents' registers are greater, smaller or equal (and both sizes) sorts out far pairs, and the full
sets confirm the rest. Most of a group of copies is then one component. In a second round only buckets that still hold
several components are looked at: registers tell which components have members that may be linked, and a bucket hands
on a forest of these, not the pairs. Components so joined form families; in a family, full sets are compared where
registers allow a link between different components. A bucket or family of any size is dealt out in pairs of chunks, so
that a task holds at most 2 * CHUNK members, and the members of a family's largest component are compared with the
others only. So a group of copies costs rows in proportion to its size, and no link between components is left out.

A pair at the threshold shares no band with a chance of (1 - 0.85 ** ROWS) ** BANDS, 3e-7.

Defined cases: a null or empty text has an empty set and is linked with nothing; a document with fewer than K words has
its whole word sequence as its one shingle; rows with a null doc_id take no part (component_id null, kept true); rows
that share a doc_id count as one document with the links of all of them; an empty table gives an empty one; other
columns are not read by resolve() and pass through keep_one() unchanged.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Roller, as_bytes, cut, mix, packs, slices, small_batches
from .graph import components

K = 5
BANDS, ROWS = 32, 6
M = BANDS * ROWS
BASE = 1.02
LEAST_PERCENT = 85
MARGIN = 4.0  # standard errors of the estimate
CHUNK = 2048
SPREAD, SPREAD_ROWS = 8, 128
BROADCAST_IDS = 1 << 20
_STEP = np.uint64(0x9E3779B97F4A7C15)


def shingles(pack, i: int, k: int = K) -> np.ndarray:
    """The sorted distinct shingle hashes of text i."""
    n = pack.counts[i]
    return np.zeros(0, np.uint64) if n == 0 else np.unique(pack.grams(i, k)) if n >= k else pack.whole(i)


def _point(h: np.ndarray, j) -> tuple[np.ndarray, np.ndarray]:
    """(gap to the next point, its register) of the j-th point of each hash."""
    z = mix(h + np.asarray(j, np.uint64) * _STEP)
    gap = -np.log(((z >> np.uint64(12)).astype(np.float64) + 0.5) * 2.0**-52) / M
    return gap, ((z & np.uint64(0xFFF)) * np.uint64(M) >> np.uint64(12)).astype(np.int64)


def minima(sets: list[np.ndarray]) -> np.ndarray:
    """The least point on each register (row: set)."""
    out = np.full((len(sets), M), np.inf)
    far = math.log(M) + 1.5
    big = [i for i, s in enumerate(sets) if len(s) >= 32]
    if big:
        h = np.concatenate([sets[i] for i in big])
        row = np.repeat(np.array(big), [len(sets[i]) for i in big])
        end = np.repeat(np.array([far / len(sets[i]) for i in big]), [len(sets[i]) for i in big])
        x, j, flat = np.zeros(len(h)), 0, out.reshape(-1)
        while len(h):
            j += 1
            gap, register = _point(h, j)
            x = x + gap
            go = x < end
            h, row, end, x = h[go], row[go], end[go], x[go]
            np.minimum.at(flat, row * M + register[go], x)
    for i, s in enumerate(sets):
        end = far
        while len(s) and not np.isfinite(out[i]).all():
            if len(s) >= 32 or end > far:
                end *= 2
            mean = M * end / len(s)
            n = int(mean + 8 * math.sqrt(mean) + 16)
            gap, register = _point(s[:, None], np.arange(1, n + 1)[None, :])
            x = np.cumsum(gap, 1)
            go = x < end / len(s)
            if go[:, -1].any():
                continue
            out[i] = np.inf
            np.minimum.at(out[i], register[go], x[go])
            end = max(end, far + 1e-9)
    return out


def registers(points: np.ndarray) -> np.ndarray:
    """Values on the exponential scale."""
    return np.floor(1 - np.log(points) / math.log(BASE)).astype(np.int16)


def estimate(greater: np.ndarray, less: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """The likeliest Jaccard similarity of sets of n and m shingles, by how many registers are greater and less."""
    if len(n) > 512:  # little memory: the grid is 201 wide
        return np.concatenate([estimate(greater[i : i + 512], less[i : i + 512], n[i : i + 512], m[i : i + 512]) for i in range(0, len(n), 512)])
    u = n / (n + m)
    v = 1 - u
    grid = np.linspace(0, 1, 201)[None, :] * np.minimum(u / v, v / u)[:, None]
    share = lambda x: -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / math.log(BASE)
    up, down = share(u[:, None] - v[:, None] * grid), share(v[:, None] - u[:, None] * grid)
    tiny = 1e-12
    chance = greater[:, None] * np.log(np.maximum(up, tiny)) + less[:, None] * np.log(np.maximum(down, tiny)) + (M - greater - less)[:, None] * np.log(np.maximum(1 - up - down, tiny))
    return grid[np.arange(len(u)), chance.argmax(1)]


def least_estimate(percent: int) -> float:
    j = percent / 100
    return j - MARGIN * math.sqrt(j * (1 - j) / M)


def sketch(docs: DataFrame, k: int = K) -> DataFrame:
    """(doc_id, n_shingles, digest, registers) for each row of docs(doc_id, text); digest and registers null for an empty set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roller = Roller()
        for batch in slices(batches, 512):
            sizes, digests, kept = [], [], []
            for _, pack in packs(as_bytes(batch.column(1)), roller):
                sets = [shingles(pack, i, k) for i in range(len(pack.counts))]
                for s, r in zip(sets, registers(minima(sets)) if sets else ()):
                    sizes.append(len(s))
                    full = len(s) > 0
                    digests.append(np.array([s.sum(), mix(s ^ _STEP).sum()], np.uint64).tobytes() if full else None)
                    kept.append(r.tobytes() if full else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(kept, pa.binary())], names=["doc_id", "n_shingles", "digest", "registers"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_shingles long, digest binary, registers binary")


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.int16).reshape(-1, M)


def likely(pairs: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """The pairs(a, b) whose estimate is not clearly below the threshold."""
    side = lambda x: reps.select(F.col("rep").alias(x), F.col("n").alias(f"n_{x}"), F.col("registers").alias(f"r_{x}"))
    low = least_estimate(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1024):
            n, m = (batch.column(i).to_numpy().astype(float) for i in (2, 3))
            r, s = _matrix(batch.column(4)), _matrix(batch.column(5))
            good = estimate((r > s).sum(1), (r < s).sum(1), n, m) >= low
            yield batch.select([0, 1]).filter(pa.array(good, pa.bool_()))

    near = pairs.join(side("a"), "a").join(side("b"), "b").where(100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))
    return near.select("a", "b", "n_a", "n_b", "r_a", "r_b").mapInArrow(run, "a long, b long").distinct()


def confirm(pairs: DataFrame, docs: DataFrame, percent: int, k: int = K) -> DataFrame:
    """The pairs(a, b) of doc_ids whose full shingle sets are similar enough."""
    pairs = cut(pairs)
    sets = cut(shingle_sets(docs, cut(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()), k))

    def hold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 128):
            good = [similar(np.frombuffer(s, np.uint64), np.frombuffer(t, np.uint64), percent) for s, t in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            yield batch.select([0, 1]).filter(pa.array(good, pa.bool_()))

    both = pairs.join(sets.select(F.col("id").alias("a"), F.col("set").alias("s")), "a").join(sets.select(F.col("id").alias("b"), F.col("set").alias("t")), "b")
    return both.select("a", "b", "s", "t").mapInArrow(hold, "a long, b long").distinct()


def forest(members: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """Pairs(a, b) of components that connect all components with likely links, for members(key, n, rep, component) of buckets."""
    low = least_estimate(percent)
    dealt = (
        members.withColumn("parts", F.ceil(F.col("n") / CHUNK).cast("int")).withColumn("own", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .select("key", "rep", "component", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
        .join(reps.select("rep", F.col("n").alias("size"), "registers"), "rep")
    )

    def run(key: tuple, group: pa.Table) -> pa.Table:
        part, size = group.column("component").to_numpy(), group.column("size").to_numpy()
        r = _matrix(group.column("registers").combine_chunks())
        root = part.copy()
        found = []
        names, counts = np.unique(part, return_counts=True)
        for x in np.flatnonzero(part != names[counts.argmax()]):  # each pair has an end outside the largest component
            y = np.flatnonzero(root != root[x])
            y = y[100 * np.minimum(size[y], size[x]) >= percent * np.maximum(size[y], size[x])]
            y = y[likely_rows(r, size, x, y, low)] if len(y) else y
            for other in np.unique(root[y]):
                found.append((part[x], part[y[np.flatnonzero(root[y] == other)[0]]]))
                root[root == other] = root[x]
        a, b = zip(*found) if found else ((), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return dealt.groupBy("key", "i", "j").applyInArrow(run, "a long, b long").distinct()


def likely_rows(r: np.ndarray, size: np.ndarray, x: int, y: np.ndarray, low: float) -> np.ndarray:
    """Which of the rows y of registers r may be similar enough to row x."""
    up, down = (r[x] > r[y]).sum(1), (r[x] < r[y]).sum(1)
    good = M - up - down >= (low - 0.05) * M
    if good.any():
        good[good] = estimate(up[good], down[good], np.full(good.sum(), float(size[x])), size[y[good]].astype(float)) >= low
    return good


def shingle_sets(docs: DataFrame, ids: DataFrame, k: int) -> DataFrame:
    """(id, set) of the rows of docs whose doc_id is in ids(id)."""
    wanted = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roller = Roller()
        for batch in slices(batches, 256):
            sets = [shingles(pack, i, k).tobytes() for _, pack in packs(as_bytes(batch.column(1)), roller) for i in range(len(pack.counts))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], names=["id", "set"])

    texts = docs.select(F.col("doc_id").alias("id"), "text").join(wanted, "id", "left_semi")
    return texts.mapInArrow(run, "id long, set binary")


def similar(s: np.ndarray, t: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets are similar enough."""
    both = np.concatenate((s, t))
    both.sort(kind="stable")
    common = int((both[1:] == both[:-1]).sum())
    return 100 * common >= percent * (len(s) + len(t) - common)


def inside(families: DataFrame, reps: DataFrame, docs: DataFrame, percent: int, k: int = K) -> DataFrame:
    """Links(a, b) that join the components of each family, for families(rep, component, family)."""
    low = least_estimate(percent)
    sizes = families.groupBy("family", "component").agg(F.count("*").alias("n"))
    mains = sizes.groupBy("family").agg(F.max(F.struct("n", "component")).alias("main"), F.sum("n").alias("all"))
    # even a family that one task could hold is spread over some
    parts = lambda n: F.greatest(F.lit(1), F.ceil(n / CHUNK), F.least(F.lit(SPREAD), F.ceil(n / SPREAD_ROWS))).cast("int")
    placed = (
        families.join(mains, "family").select("family", "rep", "component", (F.col("component") == F.col("main.component")).alias("is_main"), parts(F.col("all") - F.col("main.n")).alias("rest_parts"), parts(F.col("main.n")).alias("main_parts"))
        .withColumn("own", F.pmod(F.xxhash64("rep"), F.when(F.col("is_main"), F.col("main_parts")).otherwise(F.col("rest_parts"))).cast("int"))
    )
    # tasks (i, j, with_main): chunk i of the rest with chunk j of the rest, or of the main component
    all_of = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    with_rest = F.transform(all_of("rest_parts"), lambda o: F.struct(F.least("own", o).alias("i"), F.greatest("own", o).alias("j"), F.lit(False).alias("with_main")))
    with_main = F.transform(all_of("main_parts"), lambda o: F.struct(F.col("own").alias("i"), o.alias("j"), F.lit(True).alias("with_main")))
    from_main = F.transform(all_of("rest_parts"), lambda o: F.struct(o.alias("i"), F.col("own").alias("j"), F.lit(True).alias("with_main")))
    dealt = placed.select("family", "rep", "component", "is_main", "own", F.explode(F.when(F.col("is_main"), from_main).otherwise(F.concat(with_rest, with_main))).alias("t"))
    sets = cut(shingle_sets(docs, cut(families.select(F.col("rep").alias("id")).distinct()), k))
    full = dealt.join(reps.select("rep", F.col("n").alias("size"), "registers"), "rep").join(sets.withColumnRenamed("id", "rep"), "rep").select("family", "t.*", "rep", "component", "is_main", "own", "size", "registers", "set")

    def run(key: tuple, group: pa.Table) -> pa.Table:
        rep, part, main, own, size = (group.column(c).to_numpy() for c in ("rep", "component", "is_main", "own", "size"))
        r = _matrix(group.column("registers").combine_chunks())
        raw = group.column("set").to_pylist()
        whole = lambda i: np.frombuffer(raw[i], np.uint64)
        i, j, with_main = (k.as_py() for k in key[1:])
        root = part.copy()
        found = []
        for x in np.flatnonzero(~main):
            y = np.flatnonzero((root != root[x]) & (main if with_main else (np.arange(len(rep)) > x) & ((i == j) | (own != own[x]))))
            y = y[100 * np.minimum(size[y], size[x]) >= percent * np.maximum(size[y], size[x])]
            y = y[likely_rows(r, size, x, y, low)] if len(y) else y
            for z in y[np.argsort(-(r[y] == r[x]).sum(1), kind="stable")]:
                if root[z] != root[x] and similar(whole(x), whole(z), percent):
                    found.append((min(rep[x], rep[z]), max(rep[x], rep[z])))
                    root[root == root[z]] = root[x]
        a, b = zip(*found) if found else ((), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return full.groupBy("family", "i", "j", "with_main").applyInArrow(run, "a long, b long").distinct()


def resolve(docs: DataFrame, percent: int = LEAST_PERCENT, k: int = K) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of docs(doc_id, text)."""
    small_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sketches = cut(sketch(docs, k))
    full = sketches.where("doc_id is not null and digest is not null")
    reps = cut(full.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.min("n_shingles").alias("n"), F.min_by("registers", "doc_id").alias("registers")))
    bands = reps.select("rep", F.explode(F.array(*(F.xxhash64(F.lit(i), F.substring("registers", 2 * ROWS * i + 1, 2 * ROWS)) for i in range(BANDS)))).alias("key"))
    buckets = bands.groupBy("key").agg(F.min("rep").alias("pivot"), F.count("*").alias("n")).where("n > 1")
    members = cut(bands.join(buckets, "key"))
    first = cut(likely(members.where("rep <> pivot").select(F.col("pivot").alias("a"), F.col("rep").alias("b")).distinct(), reps, percent))
    # the classes of a doc_id with several texts are linked by it
    several = cut(full.groupBy("doc_id").agg(F.min("digest").alias("lo"), F.max("digest").alias("hi")).where("lo <> hi").select("doc_id"))
    shared = full.join(several, "doc_id", "left_semi").select("doc_id", "digest").join(reps.select("digest", "rep"), "digest").select(F.col("rep").alias("a"), F.col("doc_id").alias("b")).where("a <> b").distinct()
    links = cut(confirm(first, docs, percent, k).union(shared))
    parts = cut(components(links))
    placed = members.join(parts.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    mixed = placed.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("key")
    joins = cut(forest(placed.join(mixed, "key", "left_semi"), reps, percent))
    if not joins.isEmpty():
        family = components(joins).select(F.col("node").alias("component"), F.col("component").alias("family"))
        owned = reps.select("rep").distinct().join(parts.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
        more = inside(cut(owned.join(family, "component")), reps, docs, percent, k)
        parts = cut(components(links.union(more)))
    of_class = reps.select("digest", "rep").join(parts.withColumnRenamed("node", "rep"), "rep", "left").select("digest", F.coalesce("component", "rep").alias("of_set"))
    # a doc_id with several rows belongs to the least component of its rows, which the links have joined already
    joined = sketches.select("doc_id", "n_shingles", "digest").join(of_class, "digest", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("of_set", "doc_id"))
    return joined.select("doc_id", "n_shingles", component.alias("component_id"), (F.col("doc_id").isNull() | (component == F.col("doc_id"))).alias("kept"))


def keep_one(docs: DataFrame, percent: int = LEAST_PERCENT, k: int = K) -> DataFrame:
    """The rows of docs that stand for their component, with all their columns."""
    gone = cut(resolve(docs, percent, k).where("not kept").select("doc_id").distinct())
    return docs.join(F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone, "doc_id", "left_anti").select(docs.columns)
