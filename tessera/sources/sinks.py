"""Sinks: step logs, reference caches, samples, metrics and generation tables."""

from __future__ import annotations

import json
import os

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..operators import metrics

# Bytes of JSON samples that one step log document holds.
DOCUMENT_BYTES = 32_000_000


def step_documents(scored: DataFrame, most: int = DOCUMENT_BYTES) -> DataFrame:
    """(name, document): one JSON document for each step, its samples in order, internal rewards left out.

    A step whose samples take more than most bytes of JSON is cut into runs of its samples, each a document of its own
    (step_000001.{part}.json; at most one sample longer than most), so no task holds a whole step. Their names
    and their field part increase with the samples, though not one by one. scored is read several times.
    """
    sample = F.struct("index", "question", "ground_truth", "response", "group", "original_idx", "datasource", metrics.drop_internal(F.col("rewards")).alias("rewards"))
    now = F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss")
    sizes = scored.groupBy("step").agg(F.sum(F.octet_length(F.to_json(sample)).cast("long") + 1).alias("size"))
    large = {r.step: r["size"] for r in sizes.where(F.col("size") > most).collect() if r.step is not None}  # one row for most bytes
    cut = F.coalesce(F.col("step").isin(*large), F.lit(False)) if large else F.lit(False)
    steps = scored.where(~cut).groupBy("step").agg(F.transform(F.array_sort(F.collect_list(F.struct("index", sample.alias("s"))), lambda a, b: F.signum(a["index"] - b["index"]).cast("int")), lambda x: x["s"]).alias("samples"))
    body = F.struct("step", now.alias("timestamp"), F.size("samples").cast("long").alias("num_samples"), "samples")
    whole = steps.select(text.step_name(F.col("step")).alias("name"), F.to_json(body).alias("document"))
    if not large:
        return whole
    dealt = ("step", "index", F.xxhash64("question", "response", "original_idx"))  # an index that comes often is dealt too
    rows = scored.where(cut).repartitionByRange(-(-2 * sum(large.values()) // most), *dealt).sortWithinPartitions("step", "index")
    runs = _runs(rows.select(F.col("step").cast("long").alias("step"), F.to_json(sample).alias("sample")), most)
    runs = runs.withColumn("part", F.monotonically_increasing_id())  # by range and place in it
    parts = (F.lit('{"step":'), F.col("step"), F.lit(',"timestamp":"'), now, F.lit('","num_samples":'), F.col("n"), F.lit(',"part":'), F.col("part"), F.lit(',"samples":['), F.col("samples"), F.lit("]}"))
    return whole.unionByName(runs.select(F.format_string("step_%06d.%018d.json", "step", "part").alias("name"), F.concat(*(p.cast("string") for p in parts)).alias("document")))


def _runs(rows: DataFrame, most: int) -> DataFrame:
    """Sorted (step, sample) as (step, n, samples): runs of one step, joined by commas, of at most a sample more than most bytes."""
    def run(batches):
        step, held, size = None, [], 0
        joined = lambda: pa.RecordBatch.from_arrays([pa.array([step], pa.int64()), pa.array([len(held)], pa.int64()), pa.array([b",".join(held)], pa.binary()).cast(pa.string())], ["step", "n", "samples"])
        for batch in batches:
            for s, sample in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
                if held and (s != step or size >= most):
                    yield joined()
                    held, size = [], 0
                step, size = s, size + len(sample) + 1
                held.append(sample)
        if held:
            yield joined()

    return rows.mapInArrow(run, "step long, n long, samples string")


def write_step_logs(scored: DataFrame, folder: str, most: int = DOCUMENT_BYTES) -> None:
    """The documents of all steps below folder, by Spark's own writer (any store): name=step_000001.json/part-..."""
    step_documents(scored, most).write.partitionBy("name").text(folder)  # a name is one row, so one file


def write_documents(documents: DataFrame, folder: str) -> None:
    """Each (name, document) to a file of its own in a folder that all tasks can reach by its path."""
    def put(rows) -> None:
        for row in rows:
            spare = os.path.join(folder, f".{row.name}.{os.getpid()}")
            with open(spare, "w", encoding="utf-8") as f:
                f.write(row.document)
            os.replace(spare, os.path.join(folder, row.name))  # a task that runs twice leaves one whole file

    os.makedirs(folder, exist_ok=True)
    documents.select("name", "document").foreachPartition(put)


def write_cache(best: DataFrame, path: str, global_step: int, documents: int = 1) -> None:
    """References best(original_idx, accuracy, value, think, step) as cache documents below path, which files.reference_cache reads.

    A document is one JSON object; where one would not fit into a task, more documents share the keys by hash.
    """
    entry = F.struct(F.col("think").alias("think_content"), "accuracy", F.col("value").alias("box_reward"), "step")
    dealt = best.groupBy(F.pmod(F.xxhash64("original_idx"), F.lit(documents)).alias("document"))
    cache = dealt.agg(F.map_from_entries(F.collect_list(F.struct(F.col("original_idx").cast("string"), entry))).alias("cache"))
    body = F.to_json(F.struct(F.lit(global_step).cast("long").alias("global_step"), "cache"))
    cache.select("document", body.alias("value")).write.mode("overwrite").partitionBy("document").text(path)


def write_samples(samples: DataFrame, path: str, by: str | None = None) -> None:
    """Samples as JSON lines, in a folder for each key if by is given."""
    writer = samples.write.mode("overwrite")
    (writer.partitionBy(by) if by else writer).json(path)


def metric_rows(df: DataFrame, step: int) -> DataFrame:
    """A one-row frame of metrics as (step, metric, value)."""
    return df.select(F.lit(step).alias("step"), F.explode(F.create_map(*(x for c in df.columns for x in (F.lit(c), F.col(f"`{c}`").cast("double"))))).alias("metric", "value"))


def console(df: DataFrame, step: int) -> None:
    for row in metric_rows(df, step).collect():  # a handful of metrics
        print(f"step {row.step}: {row.metric} = {row.value}")


def generation_rows(df: DataFrame, step: int) -> DataFrame:
    """(step, i, input, output, label, score) of validation samples(pos, ...)."""
    return df.select(F.lit(step).alias("step"), F.col("pos").alias("i"), "input", "output", "label", "score")


def generation_wide(df: DataFrame, n: int) -> DataFrame:
    """One row for each step: columns input_1, output_1, label_1, score_1, ... of the first n samples."""
    pick = lambda c, i: F.max(F.when(F.col("i") == i, F.col(c))).alias(f"{c}_{i + 1}")
    return df.groupBy("step").agg(*(pick(c, i) for i in range(n) for c in ("input", "output", "label", "score")))


def write_tracker(path: str, best_step: int, best_score: float, last_step: int, place: str) -> None:
    with open(path, "w", encoding="utf-8") as f:
        json.dump({"best_global_step": best_step, "best_val_reward_score": round(best_score, 4), "last_global_step": last_step, "last_actor_path": place}, f)
