"""URL filters as a sort-merge range join.

A host's labels, reversed and each closed by a dot, make a key under which a rule's host and all its subdomains are one
interval. Urls are cut into ranges of that key (then path, then a hash of the row, so that a host or one url with a
third of all rows falls into many ranges), each rule goes to the ranges that its interval meets, and each range is
sorted and swept once: a stack holds the rules whose intervals are open. They nest, so an url's rules are all on the
stack, and the longest one whose path fits decides. The bounds of the ranges come from a sample of at most
SAMPLE_PER_RANGE keys for each range; the ranges hold every row.

Defined cases: a null url, or one without "://", has an empty host and path and no rule; it gets the verdict for an
empty host. A null page_id is kept. Repeated rows are judged each. Rules of one host and path: block wins over allow.
Of rules that fit, the longest (host and path together) wins, then the one with the longer host. Other columns are not
read.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, small_batches

# The production rules (host, path, verdict).
RULES = (
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
)
OTHERWISE = "allow"
NO_HOST = "block"
SAMPLE_PER_RANGE = 40
RANGE_ROWS = 20_000
SCHEMA = "page_id long, host string, path string, rule string, verdict string"
_LOWER = {c: c + 32 for c in range(65, 91)}


def split_url(url: str | None) -> tuple[str, str]:
    """(host, path) of an url."""
    if url is None or (at := url.find("://")) < 0:
        return "", ""
    rest = url[at + 3 :]
    end = min((k for c in "/?#" if (k := rest.find(c)) >= 0), default=len(rest))
    tail = rest[end:]
    stop = min((k for c in "?#" if (k := tail.find(c)) >= 0), default=len(tail))
    return rest[:end].translate(_LOWER), tail[:stop]


def host_key(host: str) -> str:
    """Labels in reverse, each closed by a dot: a prefix of this key is a domain above the host."""
    return "".join(label + "." for label in reversed(host.split("."))) if host else ""


def rule_table(spark: SparkSession, rules=RULES) -> DataFrame:
    return spark.createDataFrame(list(rules), "host string, path string, verdict string")


class _Node:
    """The rules of one host: their paths in order, each with the nearest path above it."""

    def __init__(self, host: str, rules: dict[str, str]) -> None:
        self.host, self.rules, self.paths, self.above = host, rules, sorted(rules), []
        open_: list[int] = []
        for i, p in enumerate(self.paths):
            while open_ and not p.startswith(self.paths[open_[-1]]):
                open_.pop()
            self.above.append(open_[-1] if open_ else -1)
            open_.append(i)

    def longest(self, path: str) -> str | None:
        i = bisect.bisect_right(self.paths, path) - 1
        while i >= 0 and not path.startswith(self.paths[i]):
            i = self.above[i]
        return self.paths[i] if i >= 0 else None


def judge(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """One row for each row of pages(page_id, url): SCHEMA."""
    small_batches(pages.sparkSession)
    parsed_schema = "key string, path string, host string, page_id long, verdict string, mark long"

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 8192):
            both = [split_url(u) for u in batch.column(1).to_pylist()]
            hosts, paths = [h for h, _ in both], [p for _, p in both]
            yield pa.RecordBatch.from_arrays(
                [pa.array([host_key(h) for h in hosts], pa.string()), pa.array(paths, pa.string()), pa.array(hosts, pa.string()), batch.column(0), pa.nulls(len(hosts), pa.string()), batch.column(2)],
                names=["key", "path", "host", "page_id", "verdict", "mark"],
            )

    urls = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.xxhash64("page_id", "url").alias("mark")).mapInArrow(parse, parsed_schema)
    n = pages.count()
    ranges = max(1, -(-n // RANGE_ROWS), int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    # a sample bounded by the number of ranges fixes where they begin
    share = min(1.0, 2 * SAMPLE_PER_RANGE * ranges / max(n, 1))
    place = F.struct("key", "path", "mark")
    taken = [tuple(r[0]) for r in urls.where(F.col("key") != "").sample(share, 1).select(place.alias("p")).limit(4 * SAMPLE_PER_RANGE * ranges).collect()]
    taken.sort()
    bounds = sorted({taken[len(taken) * k // ranges] for k in range(1, ranges)}) if taken else []

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, paths, marks, verdicts = (batch.column(i).to_pylist() for i in (0, 1, 5, 4))
            part, row = [], []
            for i, (k, p, m, v) in enumerate(zip(keys, paths, marks, verdicts)):
                if v is None:
                    at = bisect.bisect_right(bounds, (k, p, m)) if k else m % (len(bounds) + 1)
                    part.append(at)
                    row.append(i)
                else:  # every range between the first and the last key under the rule's host
                    for at in range(bisect.bisect_left(bounds, (k,)), bisect.bisect_left(bounds, (k[:-1] + "/",)) + 1):
                        part.append(at)
                        row.append(i)
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), *batch.take(pa.array(row, pa.int64())).columns], names=["part", *batch.schema.names])

    def prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(host_key(h), p, h, v) for h, p, v in zip(*(batch.column(i).to_pylist() for i in range(3))) if h and p is not None and v]
            k, p, h, v = (pa.array([r[i] for r in rows], pa.string()) for i in range(4))
            yield pa.RecordBatch.from_arrays([k, p, h, pa.nulls(len(rows), pa.int64()), v, pa.array(np.full(len(rows), -1))], names=["key", "path", "host", "page_id", "verdict", "mark"])

    lower = F.translate("host", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    both = urls.union(rules.select(lower.alias("host"), "path", "verdict").mapInArrow(prepare, parsed_schema))
    dealt = both.mapInArrow(deal, "part int, " + parsed_schema).repartitionById(len(bounds) + 1, F.col("part"))

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stack: list[tuple[str, str, dict[str, str]]] = []  # key, host, rules of the hosts above, the deepest last
        nodes: dict[str, _Node] = {}
        for batch in batches:
            out = []
            for key, path, host, page, verdict in zip(*(batch.column(i).to_pylist() for i in range(1, 6))):
                while stack and not key.startswith(stack[-1][0]):
                    nodes.pop(stack.pop()[0], None)
                if verdict is not None:
                    if not stack or stack[-1][0] != key:
                        stack.append((key, host, {}))
                    own = stack[-1][2]
                    own[path] = "block" if "block" in (own.get(path), verdict) else verdict
                    continue
                best = None
                for k, h, own in stack:
                    if (node := nodes.get(k)) is None:
                        node = nodes[k] = _Node(h, own)
                    if (p := node.longest(path)) is not None:
                        best = max(best or (-1, -1), (len(h) + len(p), len(h), h, p, own[p]))
                out.append((page, host, path, best[2] + best[3] if best else None, best[4] if best else OTHERWISE if host else NO_HOST))
            columns = list(zip(*out)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.int64()] + [pa.string()] * 4)], names=["page_id", "host", "path", "rule", "verdict"])

    # rules come before the urls of their own key
    ordered = dealt.sortWithinPartitions("key", F.col("verdict").isNull(), "path")
    return ordered.mapInArrow(sweep, SCHEMA)
