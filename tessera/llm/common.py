"""Pieces that several training-data operators share: reading, cutting lineage, fast byte tokens and rolling hashes."""

from __future__ import annotations

import contextlib
import ctypes
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ARROW_ROWS = 1000
ARROW_BYTES = 8 << 20
_MULT = 0x9E3779B97F4A7C15
_MULT_INV = pow(_MULT, -1, 1 << 64)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own where that is unset and Spark is local (tests)."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = tempfile.mkdtemp(prefix="tessera-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where


def cut(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read back, so that a lost executor never reruns what made it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tessera-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def crc_mod(doc_id, n: int):
    """crc32 of the id's decimal text, modulo n; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % n


def as_bytes(column: pa.Array) -> list[bytes | None]:
    """The UTF-8 bytes of a string column."""
    if pa.types.is_large_string(column.type):
        return column.cast(pa.large_binary()).to_pylist()
    return column.cast(pa.binary()).to_pylist()


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of at most ARROW_ROWS rows and ARROW_BYTES bytes from now on, so that long texts need little memory.

    A smaller setting of the session's own stays.
    """
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)):
        now = re.fullmatch(r"(\d+)b?", spark.conf.get(key, None) or "")
        if not now or not 0 < int(now[1]) <= most:
            spark.conf.set(key, str(most))


def give_back() -> None:
    """Return freed memory to the system: a worker process outlives its tasks, and caches of allocators would add up."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def slices(batches, rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Smaller record batches, so that work on one needs little memory."""
    give_back()
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
        del batch
    give_back()


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Roller:
    """Polynomial hashes modulo 2**64 of any byte span of a buffer, from one prefix sum."""

    def __init__(self) -> None:
        self.power = self.inverse = np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.power) < n:
            n = max(n, 2 * len(self.power))
            for name, m in (("power", _MULT), ("inverse", _MULT_INV)):
                steps = np.full(n, m, np.uint64)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps, dtype=np.uint64))

    def prefix(self, buffer: np.ndarray) -> np.ndarray:
        self._grow(len(buffer) + 1)
        sums = np.zeros(len(buffer) + 1, np.uint64)
        np.cumsum((buffer.astype(np.uint64) + np.uint64(1)) * self.power[: len(buffer)], out=sums[1:])
        return sums

    def spans(self, sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((sums[ends] - sums[starts]) * self.inverse[starts])


class Pack:
    """Some texts as one buffer of words joined by single spaces, with the place of each word.

    lower: fold A-Z. counts: words of each text; first: index of each text's first word.
    """

    def __init__(self, texts: list[bytes | None], roller: Roller, lower: bool = True) -> None:
        words = [((t.lower() if lower else t).split() if t else []) for t in texts]
        self.words = words
        self.counts = np.fromiter(map(len, words), np.int64, len(words))
        self.first = np.concatenate(([0], np.cumsum(self.counts)))
        raw = b" ".join([b" ".join(w) for w in words if w])
        self.buffer = np.frombuffer(raw, np.uint8)
        gaps = np.flatnonzero(self.buffer == 32)
        if len(raw):
            self.starts, self.ends = np.concatenate(([0], gaps + 1)), np.concatenate((gaps, [len(raw)]))
        else:
            self.starts = self.ends = np.zeros(0, np.int64)
        self.roller, self.sums = roller, roller.prefix(self.buffer)

    def grams(self, i: int, k: int) -> np.ndarray:
        """Hashes of the k-word windows of text i, in order; none if it is shorter."""
        a, n = self.first[i], self.counts[i] - k + 1
        return self.roller.spans(self.sums, self.starts[a : a + n], self.ends[a + k - 1 : a + k - 1 + n]) if n > 0 else np.zeros(0, np.uint64)

    def whole(self, i: int) -> np.ndarray:
        """The hash of all words of text i, which must have one."""
        a, b = self.first[i], self.first[i + 1]
        return self.roller.spans(self.sums, self.starts[a : a + 1], self.ends[b - 1 : b])


def packs(texts: list[bytes | None], roller: Roller, lower: bool = True, size: int = 1 << 19) -> Iterator[tuple[int, Pack]]:
    """(index of the first text, Pack) for runs of texts of about size bytes; a longer text makes a run of its own."""
    at, held = 0, 0
    for i, t in enumerate(texts):
        n = len(t or b"")
        if held and held + n > size:
            yield at, Pack(texts[at:i], roller, lower)
            at, held = i, 0
        held += n
    if at < len(texts):
        yield at, Pack(texts[at:], roller, lower)
