"""Quality rules on repetition: how many characters stand inside n-grams and lines that a text has twice or more.

The n-grams of several lengths are rolling hashes over one buffer of words; one sort for each length finds those that
a text repeats, and a running sum marks the words they cover. The same windows of three words give n_repeat_words.

Defined cases: a null or empty text has no words and fails the base rule; a null doc_id is kept; repeated rows are
judged each, alone (no row depends on another); other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Pack, Roller, as_bytes, mix, packs, slices, small_batches

LENGTHS = (5, 7, 10)
#: A text is dropped if more than this share of its word characters is covered.
MOST_COVERED = {5: 0.45, 7: 0.40, 10: 0.35}
MOST_IN_LINES = 0.40
MOST_SYMBOLS = 0.10  # symbols for each word
SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, covered_5 double, covered_7 double, covered_10 double, covered_lines double"
_SYMBOL = np.zeros(256, np.int64)
_SYMBOL[list(b"#*$%&|<>")] = 1
_LETTER = np.ones(256, np.int64)  # bytes that start a code point, spaces aside
_LETTER[0x80:0xC0] = 0
_LETTER[32] = 0


def repeated(pack: Pack, k: int) -> np.ndarray:
    """For each word of the pack: whether it stands in a k-word window that its own text has twice or more."""
    n = len(pack.starts)
    marks = np.zeros(n + 1, np.int64)
    if n >= k:
        text = np.repeat(np.arange(len(pack.counts)), pack.counts)
        at = np.flatnonzero(text[: n - k + 1] == text[k - 1 :])
        grams = pack.roller.spans(pack.sums, pack.starts[at], pack.ends[at + k - 1]) ^ mix(text[at].astype(np.uint64))
        order = np.argsort(grams)
        same = grams[order[1:]] == grams[order[:-1]]
        twice = np.zeros(len(at), bool)
        twice[order[1:]] = same
        twice[order[:-1]] |= same
        np.add.at(marks, at[twice], 1)
        np.add.at(marks, at[twice] + k, -1)
    return np.cumsum(marks[:-1]) > 0


def duplicate_lines(raw: bytes) -> tuple[int, int]:
    """(lines with a word that equal an earlier line, their bytes without white space at the ends)."""
    if b"\n" not in raw:
        return 0, 0
    seen: set[bytes] = set()
    n = size = 0
    for line in raw.split(b"\n"):
        if not (bare := line.strip()):
            continue
        if line in seen:
            n, size = n + 1, size + len(bare)
        seen.add(line)
    return n, size


def measure(texts: list[bytes | None], roller: Roller) -> Iterator[tuple]:
    """The columns of SCHEMA behind doc_id for each text."""
    for first, pack in packs(texts, roller, lower=False):
        counts = pack.counts
        sums = lambda values: np.diff(np.concatenate(([0], np.cumsum(values)))[pack.first])
        heads = np.concatenate(([0], np.cumsum(_LETTER[pack.buffer])))
        chars = heads[pack.ends] - heads[pack.starts] if len(pack.starts) else np.zeros(0, np.int64)
        marks = np.concatenate(([0], np.cumsum(_SYMBOL[pack.buffer])))
        symbols = sums(marks[pack.ends] - marks[pack.starts]) if len(pack.starts) else np.zeros(len(counts), np.int64)
        total, repeats = sums(chars), sums(repeated(pack, 3))
        cover = {k: sums(chars * repeated(pack, k)) / np.maximum(total, 1) for k in LENGTHS}
        for i in range(len(counts)):
            raw = texts[first + i] or b""
            lines, size = duplicate_lines(raw)
            n, in_lines = int(counts[i]), size / max(len(raw), 1)
            failed = n < 50 or 100 * int(repeats[i]) > 50 * n
            kept = not failed and in_lines <= MOST_IN_LINES and int(symbols[i]) <= MOST_SYMBOLS * n and all(cover[k][i] <= MOST_COVERED[k] for k in LENGTHS)
            yield n, int(total[i]), int(symbols[i]), lines, int(repeats[i]), failed, kept, *(float(cover[k][i]) for k in LENGTHS), in_lines


def judge(docs: DataFrame) -> DataFrame:
    """One row for each row of docs(doc_id, text): SCHEMA."""
    small_batches(docs.sparkSession)
    names = [x.split()[0] for x in SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roller = Roller()
        kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.float64()] * 4
        for batch in slices(batches, 1024):
            columns = list(zip(*measure(as_bytes(batch.column(1)), roller))) or [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, kinds))], names=names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA)
