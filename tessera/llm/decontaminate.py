"""Benchmark decontamination: n-gram seeds join passages to test items, Smith-Waterman alignment scores them.

Every n-gram of K words of a test item is a seed, however many documents hold it: a copy that thousands of documents
share, whole, edited or cut short, keeps all the seeds that its edits left. Each document gives the places of seeds,
grouped to passages with a margin, and a Spark join by seed hash pairs passages with items. Rows of that join are the
uses of seeds in documents, once for each item that has the seed; a phrase alone goes no further, two seeds must agree.
A pair whose seeds lie near one diagonal is aligned word by word (a match scores 2, a mismatch or gap -1); its score is
the share of the item's words that the best local alignment matches, less its mismatches and gaps at half weight. At
least LEAST_MATCHED words must match, or all of a shorter item.

A fixed-size bitmap of hashes keeps other n-grams from leaving the scan; the exact join follows, so a collision costs
time only. Test items are joined by Spark, never held on the driver; the bitmap has BITS bits whatever their number.

Defined cases: null or empty texts, and items or documents without words, match nothing; an item with fewer than K
words is sought as one n-gram of all its words; null doc_ids and item_ids take no part in hits(), a row with a null
doc_id passes clean(); rows that share a doc_id are one document; repeated items each report; empty tables give no
hits; other columns are not read by hits() and pass through clean() unchanged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Pack, Roller, as_bytes, cut, packs, slices, small_batches

K = 3
LEAST_SEEDS = 2  # on nearly one diagonal; one is enough if the item has only a few n-grams
DRIFT = 12
LEAST_SCORE = 0.5
LEAST_MATCHED = 8  # words, or all of a shorter item: a few words that many texts share are no copy
BITS = 1 << 24
MATCH, MISS = 2, -1
_SCORE, _SAME = 40, 20  # bits below a score and below the matches: up to a million words each
BROADCAST_IDS = 1 << 20


def _grams(pack: Pack, i: int, k: int) -> np.ndarray:
    """n-gram hashes of an item, in order; of all its words if it is shorter."""
    return pack.grams(i, k) if pack.counts[i] >= k else pack.whole(i) if pack.counts[i] else np.zeros(0, np.uint64)


def item_grams(items: DataFrame, k: int = K) -> DataFrame:
    """(item_id, version, n_item, size, gram, place) for each n-gram of items(item_id, text); version tells texts of one item_id apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roller = Roller()
        for batch in slices(batches, 256):
            rows = []
            for first, pack in packs(as_bytes(batch.column(2)), roller):
                for i in range(len(pack.counts)):
                    n = int(pack.counts[i])
                    at, version = (batch.column(c)[first + i].as_py() for c in (0, 1))
                    rows += [(at, version, n, min(n, k), g, p) for p, g in enumerate(_grams(pack, i, k).view(np.int64).tolist())]
            columns = list(zip(*rows)) or [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["item_id", "version", "n_item", "size", "gram", "place"])

    return item_texts(items).mapInArrow(run, "item_id long, version long, n_item long, size long, gram long, place long")


def item_texts(items: DataFrame) -> DataFrame:
    """(item_id, version, text): each text of items(item_id, text) once for each of its ids; rows with a null are left out."""
    whole = items.select(F.col("item_id").cast("long").alias("item_id"), F.xxhash64("text").alias("version"), "text")
    return whole.where("item_id is not null and text is not null").distinct()


def bitmap(grams: DataFrame) -> bytes:
    """BITS bits, those of the column gram set; made in parts on the executors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(_bit(batch.column(0).to_numpy().view(np.uint64))).astype(np.int32))], names=["bit"])

    bits = np.zeros(BITS, bool)
    found = grams.select("gram").mapInArrow(run, "bit int").distinct().toArrow()  # at most BITS rows
    bits[found.column(0).to_numpy()] = True
    return np.packbits(bits).tobytes()


def _bit(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - (BITS.bit_length() - 1))).astype(np.int64)


def _all_grams(pack: Pack, sizes: list[int]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(hash, first word, text) of the windows of each size that lie in one text."""
    text = np.repeat(np.arange(len(pack.counts)), pack.counts)
    n = len(text)
    for k in sizes:
        if n >= k:
            at = np.flatnonzero(text[: n - k + 1] == text[k - 1 :])
            yield pack.roller.spans(pack.sums, pack.starts[at], pack.ends[at + k - 1]), at, text[at]


def passages(docs: DataFrame, bits: bytes, sizes: list[int], margin: int) -> DataFrame:
    """(doc_id, first, words, grams, places) for each run of hits of docs(doc_id, text) that are at most margin words apart."""
    sent = docs.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roller, mask = Roller(), np.unpackbits(np.frombuffer(sent.value, np.uint8)).view(bool)
        for batch in slices(batches, 512):
            ids, rows = batch.column(0).to_pylist(), []
            for first, pack in packs(as_bytes(batch.column(1)), roller):
                found = [(text[go], at[go], h[go].view(np.int64)) for h, at, text in _all_grams(pack, sizes) for go in [mask[_bit(h)]]]
                if not found:
                    continue
                text, at, h = (np.concatenate(x) for x in zip(*found))
                order = np.lexsort((at, text))
                text, at, h = text[order], at[order], h[order]
                ends = np.flatnonzero((np.diff(text) != 0) | (np.diff(at) > margin)) + 1
                for a, b in zip(np.concatenate(([0], ends)).tolist(), np.concatenate((ends, [len(at)])).tolist()):
                    if a == b:
                        continue
                    t = int(text[a])
                    head = int(pack.first[t])
                    lo, hi = max(int(at[a]) - margin - head, 0), min(int(at[b - 1]) + margin - head, int(pack.counts[t]))
                    rows.append((ids[first + t], lo, b" ".join(pack.words[t][lo:hi]).decode(), h[a:b].tolist(), (at[a:b] - head).tolist()))
            columns = list(zip(*rows)) or [[]] * 5
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["doc_id", "first", "words", "grams", "places"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null").mapInArrow(run, "doc_id long, first long, words string, grams array<long>, places array<long>")


def align(item: list[str], passage: list[str]) -> tuple[int, int, int, int]:
    """Best local alignment: (matches, mismatches and gaps, first word in the passage, end).

    One row of cells is held: a cell is one number, its score before its matches before the start of its alignment, so
    that the greatest number is the best alignment and carries what is known of it.
    """
    code = {w: i for i, w in enumerate(dict.fromkeys(item))}
    p = np.array([code.get(w, -1) for w in passage], np.int64)
    m = len(passage)
    one = np.int64(1 << _SCORE)
    here = np.arange(m + 1, dtype=np.int64)  # an alignment that starts at this word
    hit, row = MATCH * one + (1 << _SAME), here.copy()
    top, end = np.int64(0), 0
    for w in item:
        down = row + MISS * one
        down[1:] = np.maximum(down[1:], row[:-1] + np.where(p == code[w], hit, MISS * one))
        down = np.where(down < one, here, down)
        row = np.maximum.accumulate(down - MISS * one * here) + MISS * one * here  # gaps along the passage
        row = np.where(row < one, here, row)
        j = int((row >> _SCORE).argmax())
        if row[j] >> _SCORE > top >> _SCORE:
            top, end = row[j], j
    score, same = int(top >> _SCORE), int(top >> _SAME) & ((1 << (_SCORE - _SAME)) - 1)
    return same, MATCH * same - score, int(top) & ((1 << _SAME) - 1) if score else end, end


def hits(docs: DataFrame, items: DataFrame, k: int = K, least: float = LEAST_SCORE) -> DataFrame:
    """(doc_id, item_id, score, n_matched, n_item, first_word, last_word) for each document and test item that it holds a copy of."""
    small_batches(docs.sparkSession)
    seeds = cut(item_grams(items, k))
    sizes = sorted(r[0] for r in seeds.select("size").distinct().collect())  # 1 to k
    longest = seeds.agg(F.max("n_item")).first()[0] or 0
    found = cut(passages(docs, bitmap(seeds), sizes, longest + longest // 2 + DRIFT))
    pairs = (
        found.withColumn("hit", F.explode(F.arrays_zip("grams", "places"))).select("doc_id", "first", F.col("hit.grams").alias("gram"), F.col("hit.places").alias("at"))
        .join(seeds, "gram")
        .groupBy("doc_id", "first", "item_id", "version", F.floor((F.col("at") - F.col("place")) / DRIFT).alias("d"), "n_item", "size").agg(F.countDistinct("place").alias("n"), F.min("at").alias("a"), F.max("at").alias("b"))
    )
    # a diagonal may straddle two neighbouring stripes
    near = Window.partitionBy("doc_id", "first", "item_id", "version").orderBy("d").rangeBetween(-1, 0)
    pairs = pairs.withColumn("votes", F.sum("n").over(near)).withColumn("lo", F.min("a").over(near)).withColumn("hi", F.max("b").over(near))
    need = F.least(F.lit(LEAST_SEEDS), F.greatest(F.lit(1), (F.col("n_item") - F.col("size") + 1) / 4))
    pairs = pairs.where(F.col("votes") >= need).select("doc_id", "first", "item_id", "version", "n_item", "lo", "hi")
    texts = item_texts(items).withColumnRenamed("text", "item")
    cases = pairs.join(found.select("doc_id", "first", "words"), ["doc_id", "first"]).join(texts, ["item_id", "version"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 256):
            rows = []
            for doc, first, item, n, lo, hi, words, raw in zip(*(batch.column(i).to_pylist() for i in range(8))):
                target = [w.decode() for w in raw.encode().lower().split()]
                a = max(lo - first - n - n // 2 - DRIFT, 0)
                same, other, i, j = align(target, words.split(" ")[a : hi - first + n + n // 2 + DRIFT])
                score = max(0.0, (same - other / 2) / n)
                if score >= least and same >= min(n, LEAST_MATCHED):
                    rows.append((doc, item, score, same, n, first + a + i, first + a + j - 1))
            columns = list(zip(*rows)) or [[]] * 7
            kinds = [pa.int64(), pa.int64(), pa.float64()] + [pa.int64()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["doc_id", "item_id", "score", "n_matched", "n_item", "first_word", "last_word"])

    scored = cases.select("doc_id", "first", "item_id", "n_item", "lo", "hi", "words", "item").mapInArrow(run, "doc_id long, item_id long, score double, n_matched long, n_item long, first_word long, last_word long")
    top = F.max(F.struct("score", "n_matched", -F.col("first_word"), -F.col("last_word"), "n_item")).alias("t")
    best = scored.groupBy("doc_id", "item_id").agg(top)
    return best.select("doc_id", "item_id", "t.score", "t.n_matched", "t.n_item", (-F.col("t.col3")).alias("first_word"), (-F.col("t.col4")).alias("last_word"))


def clean(docs: DataFrame, items: DataFrame, k: int = K, least: float = LEAST_SCORE) -> DataFrame:
    """The rows of docs that hold no copy of a test item, with all their columns."""
    gone = cut(hits(docs, items, k, least).select("doc_id").distinct())
    return docs.join(F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone, "doc_id", "left_anti").select(docs.columns)
