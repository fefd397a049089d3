"""Language-model scoring with an Elias-Fano trie of all word trigrams.

A word that was seen c times among N training tokens (an end closes each text) has P(w) = (c - D(c)) / N, with one
discount each for words seen once, twice and more often (from the counts of counts); what the discounts free is the
chance of a word that was never seen, one event as in base_score. P(w | b) and P(w | a, b) interpolate all word pairs
and triples of the training texts with the next shorter context; none is dropped. A context (a, b) gives it the weight
of the kinds of words seen behind it (Witten-Bell); a word b, of its uses to the power HEAPS, about the kinds of words
behind it. So the chances of all sequences of known words and unknown ones sum to one, but for quantising.

Neither word counts nor n-grams are held in one place. Texts are dealt into blocks of about `block_bytes` bytes by the
one shuffle of texts, each text compressed. A block sends its distinct words and trigrams, with their training uses, to
as many parts as there are blocks, by the hash of the word or of the context. A part builds its own mapped Elias-Fano
trie (ngram_trie.WordTrie) and answers each block in the order that it asked in: the counts of words, and quantised
logarithms of the smoothed shares of n-grams and of the weights of their contexts. Each answer also has the sums of the
part's word counts; a block asks every part, if only for these, so it has the sums of all words without a pass of their
own. So a block's texts and answers, or one part of all n-grams, are what a task holds, about 20
bytes of memory for each byte of a block; there are blocks * parts messages, so block_bytes should grow with the memory
of executors (256 MB at 100 TB: 400,000 blocks).

Words are known by 64 bits of xxh3. N-grams are known by CONTEXT_BITS of the context within its part and WORD_BITS of the
word within its context, so that a part of any table meets a false context about once in 300,000 questions.

Defined cases: a null or empty text is one end token; a row with a null doc_id is scored and never learned from, its
held_out is false; without training texts every count is 0 (base_score then adds log10(0.1 / 0.1) = 0 for each token),
and an end and an unknown word have a chance of 1/2; repeated rows each count and are each scored; other columns are not
read.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, crc_mod, mix, slices, small_batches
from .ngram_trie import WordTrie, fresh, shares, whole_numbers

BLOCK = 24 << 20
LEAST_BLOCK = 1 << 20
PACKED = 256  # bytes from which a text is compressed by itself; Spark compresses shorter ones together
HEAPS = 0.8
CONTEXT_BITS, WORD_BITS = 40, 32
EDGES = np.array([0x9E6C63D0876A9A47, 0xD1B54A32D192ED03, 0x8CB92BA72F3D8DD7], np.uint64)  # in place of words: start, end, behind the end
SCHEMA = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
ASKED = "block int, part int, keys binary, uses binary, contexts binary, sizes binary, words binary, n binary"
TOLD = "block int, part int, counts binary, pairs binary, weights binary, shares binary, uses long, kinds long, n1 long, n2 long, n3 long, n4 long"
BLOCKS = "block int, doc_id long, held_out boolean, train boolean, size int, text binary"  # size: of a compressed text, else 0


def _words(raw: bytes | None) -> list[bytes]:
    return raw.lower().split() if raw else []


def discounts(seen: list[int]) -> tuple[float, float, float]:
    """Discounts for words seen once, twice and three times or more, from how many words were seen 1, 2, 3 and 4 times."""
    n1, n2, n3, n4 = seen
    y = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
    raw = [k - (k + 1) * y * b / a if a and b else 0.5 * k for k, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]
    return tuple(min(max(d, 0.1), k - 0.1) for k, d in zip((1, 2, 3), raw))


class Block:
    """Some texts as numbers of their words, and what is to be asked about them.

    keys: hashes of the distinct words in order. at: place of each token's word there. sizes: words of each text.
    """

    def __init__(self) -> None:
        self.seen: defaultdict[bytes, int] = defaultdict()
        self.seen.default_factory = self.seen.__len__
        self.lengths: list[int] = []
        self.runs: list[np.ndarray] = []

    def add(self, raws: Iterable[bytes]) -> None:
        for raw in raws:
            words = _words(raw)
            self.lengths.append(len(words))
            self.runs.append(np.fromiter(map(self.seen.__getitem__, words), np.int32, len(words)))

    def close(self) -> None:
        """To be called once, behind the last add()."""
        hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, self.seen), np.uint64, len(self.seen))
        self.keys, back = np.unique(hashes, return_inverse=True)
        self.at = back.astype(np.int32)[np.concatenate(self.runs)] if self.runs else np.zeros(0, np.int32)
        self.sizes = np.array(self.lengths, np.int64)
        del self.seen, self.runs, self.lengths

    def ngrams(self, n_parts: int) -> tuple[np.ndarray, np.ndarray]:
        """(context, word) at the words of each text, at its end, and at what stands behind it; a context starts with its part."""
        n = self.sizes + 2
        first = np.concatenate(([0], np.cumsum(n)))[:-1]
        c = np.empty(int(n.sum()), np.uint64)
        inner = np.ones(len(c), bool)
        c[first + self.sizes], c[first + self.sizes + 1] = EDGES[1], EDGES[2]
        inner[first + self.sizes] = inner[first + self.sizes + 1] = False
        c[inner] = self.keys[self.at]
        del inner
        b = np.concatenate((EDGES[:1], c[:-1]))
        b[first] = EDGES[0]
        a = np.concatenate((EDGES[:1], b[:-1]))
        a[first] = EDGES[0]
        a = mix(mix(a) * np.uint64(0x9E3779B97F4A7C15) + b)
        del b
        context = (_part(a, n_parts) << np.uint64(CONTEXT_BITS)) | (a & np.uint64((1 << CONTEXT_BITS) - 1))
        return context, (c >> np.uint64(64 - WORD_BITS)).astype(np.uint32)


def _part(h: np.ndarray, n_parts: int) -> np.ndarray:
    """Parts are ranges of hashes."""
    return (h >> np.uint64(32)) * np.uint64(n_parts) >> np.uint64(32)


def _squeeze(x: np.ndarray, width: int) -> bytes:
    """Whole numbers of width bytes, least byte of all first, compressed."""
    planes = np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T)
    return len(x).to_bytes(4, "little") + pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def _expand(raw: bytes, width: int) -> np.ndarray:
    n = int.from_bytes(raw[:4], "little")
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = np.frombuffer(pa.decompress(raw[4:], n * width, codec="zstd", asbytes=True), np.uint8).reshape(width, n).T
    return out.reshape(-1).view("<u8")


def _rising(x: np.ndarray, width: int) -> bytes:
    """Numbers in rising order, as their differences."""
    return _squeeze(np.diff(x, prepend=np.uint64(0)), width)


def _risen(raw: bytes, width: int) -> np.ndarray:
    return np.cumsum(_expand(raw, width), dtype=np.uint64)


def _blobs(rows: list[tuple], schema: str) -> pa.RecordBatch:
    names, kinds = zip(*(x.split() for x in schema.split(", ")))
    columns = list(zip(*rows)) or [[]] * len(names)
    of = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array(c, of[k]) for c, k in zip(columns, kinds)], names=list(names))


def _bounds(parts: np.ndarray, n_parts: int) -> list[int]:
    return np.searchsorted(parts, np.arange(n_parts + 1)).tolist()


def _added(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the sums of their n."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(fresh(keys))
    return keys[first], np.add.reduceat(n[order], first) if len(first) else n


def packed(texts: DataFrame) -> DataFrame:
    """BLOCKS of texts(block, doc_id, held_out, train, text): long texts are compressed, so that their shuffle writes less."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 512):
            sizes, held = [], []
            for raw in as_bytes(batch.column(4)):
                less = pa.compress(raw, codec="zstd", asbytes=True) if len(raw) >= PACKED else raw
                sizes.append(len(raw) if len(less) < len(raw) else 0)
                held.append(less if sizes[-1] else raw)
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(sizes, pa.int32()), pa.array(held, pa.binary())], names=[x.split()[0] for x in BLOCKS.split(", ")])

    return texts.mapInArrow(run, BLOCKS)


def _unpacked(batch: pa.RecordBatch) -> Iterator[bytes]:
    """The texts one by one, as a small batch may hold much more text."""
    for n, raw in zip(batch.column("size").to_pylist(), as_bytes(batch.column("text"))):
        yield pa.decompress(raw, n, codec="zstd", asbytes=True) if n else raw


def questions(blocks: DataFrame, n_parts: int) -> DataFrame:
    """ASKED: each block's distinct words and trigrams, with their uses in the block's training texts, for each part.

    There is a row for every part, if an empty one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[Block, list[np.ndarray]]] = {}
        for batch in slices(batches, 512):
            owner, train = batch.column(0).to_numpy(), batch.column(3).to_numpy(zero_copy_only=False)
            for i in np.unique(owner).tolist():
                rows = np.flatnonzero(owner == i)
                block, used = held.setdefault(i, (Block(), []))
                block.add(_unpacked(batch.take(pa.array(rows))))
                used.append(train[rows])
        for i in list(held):
            block, used = held.pop(i)
            block.close()
            used = np.concatenate(used)
            uses = np.bincount(block.at, np.repeat(used, block.sizes), len(block.keys)).astype(np.int64)
            context, word = block.ngrams(n_parts)
            order = np.lexsort((word, context))
            context, word = context[order], word[order]
            first = np.flatnonzero(fresh(context, word))
            n = np.add.reduceat(np.repeat(used, block.sizes + 2)[order].astype(np.int64), first)
            del order
            context, word = context[first], word[first]
            of_words, of_ngrams = _bounds(_part(block.keys, n_parts), n_parts), _bounds(context >> np.uint64(CONTEXT_BITS), n_parts)
            for part in range(n_parts):
                a, b, c, d = *of_words[part : part + 2], *of_ngrams[part : part + 2]
                start = np.flatnonzero(fresh(context[c:d]))
                inner = context[c:d][start] & np.uint64((1 << CONTEXT_BITS) - 1)
                row = (i, part, _rising(block.keys[a:b], 8), _squeeze(uses[a:b], 5), _rising(inner, 5), _squeeze(np.diff(np.append(start, d - c)), 4), _squeeze(word[c:d], 4), _squeeze(n[c:d], 4))
                yield _blobs([row], ASKED)

    return blocks.mapInArrow(run, ASKED)  # with all columns, so that one shuffle of texts serves both uses


def answers(asked: DataFrame) -> DataFrame:
    """TOLD for each row of questions(), by the trie of its part; a part's rows lie in one partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[int, list[tuple]] = {}
        for batch in slices(batches, 512):
            for row in zip(*(batch.column(i).to_pylist() for i in range(8))):
                parts.setdefault(row[1], []).append(row)
        for part in list(parts):
            rows = parts.pop(part)
            known, total = _added(*(np.concatenate(x) for x in zip(*((_risen(r[2], 8), _expand(r[3], 5).astype(np.int64)) for r in rows))))
            sums = int(total.sum()), int((total > 0).sum()), *(int((total == k).sum()) for k in (1, 2, 3, 4))
            entries = []
            for *_, contexts, sizes, words, n in rows:
                n = _expand(n, 4).astype(np.int64)
                go = n > 0
                entries.append((np.repeat(_risen(contexts, 5), _expand(sizes, 4).astype(np.int64))[go], _expand(words, 4).astype(np.uint32)[go], n[go]))
            raw = WordTrie.build(*(np.concatenate(x) for x in zip(*entries)))
            del entries
            trie = WordTrie(raw)
            del raw
            for block, _, keys, _, contexts, sizes, words, _ in rows:
                counts = total[np.searchsorted(known, _risen(keys, 8))] if len(known) else np.zeros(0, np.int64)
                found = trie.find(_risen(contexts, 5), _expand(sizes, 4).astype(np.int64), _expand(words, 4).astype(np.uint32))
                yield _blobs([(block, part, _squeeze(counts, 5), *(_squeeze(x, 2) for x in found), *sums)], TOLD)

    return asked.mapInArrow(run, TOLD)


def score(docs: DataFrame, block_bytes: int = BLOCK) -> DataFrame:
    """One row for each row of docs(doc_id, text): SCHEMA; score is the model's log10 probability of the text."""
    spark = docs.sparkSession
    small_batches(spark)
    remainder = crc_mod(F.col("doc_id"), 10)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce(remainder == 0, F.lit(False)).alias("held_out"), F.coalesce(remainder != 0, F.lit(False)).alias("train"))
    size, ends = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count_if("train")).first()
    # as many blocks as there are shuffle partitions if these are smaller then, each in a task of its own
    n_blocks = max(1, -(-size // block_bytes), min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // LEAST_BLOCK)))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        names, kinds = zip(*(x.split() for x in SCHEMA.split(", ")))
        kinds = [{"long": pa.int64(), "boolean": pa.bool_(), "double": pa.float64()}[k] for k in kinds]
        block = Block()
        for batch in left.to_batches(max_chunksize=512):
            block.add(_unpacked(batch))
        block.close()
        words, types, *seen = (sum(right.column(x.split()[0]).to_pylist()) for x in TOLD.split(", ")[-6:])
        tokens = words + ends
        vocabulary = types + (ends > 0)
        discount = discounts(seen)
        freed = sum(d * n for d, n in zip(discount, (*seen[:2], types - sum(seen[:2]))))
        whole = words + (ends or 1) + (0 if freed else 1)
        unseen, end = (freed or 1) / whole, (ends or 1) / whole
        base_of = lambda c: np.log10((c + 0.1) / (tokens + 0.1 * (vocabulary + 1)))
        right = right.sort_by("part")
        told = lambda name, width: np.concatenate([_expand(raw, width) for raw in right.column(name).to_pylist()] or [np.zeros(0, np.uint64)])
        c = told("counts", 5).astype(float)
        pairs, weights, share = whole_numbers(told("pairs", 2)), shares(told("weights", 2)), shares(told("shares", 2))
        alone = np.where(c > 0, (c - np.choose(np.clip(c, 1, 3).astype(int) - 1, discount)) / whole, unseen)
        base, base_end = base_of(c), float(base_of(ends))
        # the block's trigrams in the order in which they were asked for
        context, word = block.ngrams(n_blocks)
        order = np.lexsort((word, context))
        context, word = context[order], word[order]
        of = np.empty(len(order), np.int32)
        of[order] = np.cumsum(fresh(context)) - 1
        to = np.empty(len(order), np.int32)
        to[order] = np.cumsum(fresh(context, word)) - 1
        del context, word, order
        sizes = block.sizes
        first = np.concatenate(([0], np.cumsum(sizes)))
        outs: list[list[np.ndarray]] = [[] for _ in range(4)]
        for a in range(0, len(sizes), 512):
            b = min(a + 512, len(sizes))
            m, here = sizes[a:b], block.at[first[a] : first[b]]
            g = slice(int(first[a] + 2 * a), int(first[b] + 2 * b))
            bounds = np.concatenate(([0], np.cumsum(m + 2)))
            inner = np.ones(int(bounds[-1]), bool)
            inner[bounds[1:] - 1] = inner[bounds[1:] - 2] = False
            p, before = np.full(len(inner), end), np.zeros(len(inner))
            p[inner] = alone[here]
            before[np.flatnonzero(inner) + 1] = c[here]
            before[bounds[:-1]] = ends
            two = np.append(pairs[of[g]][1:], 0.0)  # of a word and the one before it: the uses of the next context
            weight = before**HEAPS
            p = np.where(before > 0, (two + weight * p) / np.maximum(before + weight, 1e-300), p)
            w = weights[of[g]]
            said = np.log10(np.where(w > 0, share[to[g]] + w * p, p))
            said[bounds[1:] - 1] = 0.0  # what stands behind the end
            ends_at = np.concatenate(([0], np.cumsum(m))).tolist()
            sums = lambda x: np.array([x[i:j].sum() for i, j in zip(ends_at[:-1], ends_at[1:])])  # noqa: E731, B023
            for held, x in zip(outs, (m + 1, sums((c[here] > 0).astype(np.int64)) + (ends > 0), sums(base[here]) + base_end, np.add.reduceat(said, bounds[:-1]))):
                held.append(x)
        n_tokens, n_known, based, scored = (np.concatenate(x) if x else np.zeros(0) for x in outs)
        columns = [left.column("doc_id"), left.column("held_out"), n_tokens, n_known, np.full(len(sizes), tokens), based, scored]
        return pa.table([x.cast(k) if isinstance(x, pa.ChunkedArray) else pa.array(x.astype(k.to_pandas_dtype()), k) for x, k in zip(columns, kinds)], names=list(names))

    block = F.pmod(F.xxhash64("doc_id", "text"), F.lit(n_blocks)).cast("int").alias("block")
    blocks = packed(docs.select(block, "doc_id", "held_out", "train", "text")).repartitionById(n_blocks, F.col("block"))
    told = answers(questions(blocks, n_blocks).repartitionById(n_blocks, F.col("part"))).repartitionById(n_blocks, F.col("block"))
    return blocks.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(run, SCHEMA)
