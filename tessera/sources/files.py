"""Scans of data sets, step logs, offline samples, reference caches and images."""

from __future__ import annotations

import json
import os
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LOG_SCHEMA = (
    "step long, timestamp string, num_samples long, part long, samples array<struct<index:long,question:string,ground_truth:string,response:string,"
    "`group`:string,original_idx:long,datasource:string,rewards:map<string,double>>>, _corrupt_record string"
)
IMAGE_TYPES = ("jpg", "jpeg", "png", "bmp", "gif", "webp", "tiff")


def dataset(spark: SparkSession, path: str, kind: str | None = None) -> DataFrame:
    """'path@split': a file or folder; the split is a sub-folder, or train; jsonl is json."""
    path, _, split = path.partition("@")
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    fs = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.isDirectory(place):
        inner = jvm.org.apache.hadoop.fs.Path(place, split or "train")
        place = inner if fs.exists(inner) else place
        names = sorted(s.getPath().getName() for s in fs.listStatus(place) if s.getPath().getName()[0] not in "._")
        kind = kind or (names[0].rpartition(".")[2] if names else "parquet")
    kind = kind or path.rpartition(".")[2]
    return spark.read.format({"jsonl": "json"}.get(kind, kind)).load(place.toString())


def step_logs(spark: SparkSession, folder: str, options: dict | None = None) -> DataFrame:
    """The samples of all step logs of a folder, by step, part (0 where a step has one document) and place in it; unreadable files are left out."""
    logs = spark.read.schema(LOG_SCHEMA).options(**{"multiLine": True, "mode": "PERMISSIVE"} | (options or {})).json(f"{folder}/*step_*.json")
    good = logs.where(F.col("_corrupt_record").isNull() & F.col("samples").isNotNull())
    return _samples(good)


def step_log_stream(spark: SparkSession, folder: str) -> DataFrame:
    """The same as a stream: logs as they come."""
    logs = spark.readStream.schema(LOG_SCHEMA).option("multiLine", True).json(f"{folder}/*step_*.json")
    return _samples(logs.where(F.col("samples").isNotNull()))


def _samples(logs: DataFrame) -> DataFrame:
    return logs.select("step", "timestamp", F.coalesce("part", F.lit(0)).alias("part"), F.posexplode("samples").alias("place", "s")).select("step", "timestamp", "part", "place", "s.*")


def original_dataset(df: DataFrame, order: str, allowed: tuple[str, ...] = ()) -> DataFrame:
    """(original_idx, question, answer, images, datasource), numbered behind the filter by data source."""
    from ..operators import batch

    rows = df.where(F.col("datasource").isin(*allowed)) if allowed else df
    asked = [F.col(c) for c in ("query", "problem", "question") if c in df.columns]
    out = rows.select(order, F.coalesce(*asked).alias("question"), *(c for c in ("answer", "images", "datasource") if c in df.columns))
    return batch.with_pos(out, order, name="original_idx")


def offline_samples(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """(original_idx, samples) of the files {number}.json of a folder; other names, broken and empty ones are left out."""
    rows = spark.read.schema(f"{schema}, _corrupt_record string").options(multiLine=True, mode="PERMISSIVE").json(f"{folder}/*.json")
    rows = rows.withColumn("_name", F.regexp_extract(F.input_file_name(), r"/(\d+)\.json$", 1)).where((F.col("_name") != "") & F.col("_corrupt_record").isNull())
    kept = [c for c in rows.columns if c not in ("_name", "_corrupt_record")]
    return rows.groupBy(F.col("_name").cast("long").alias("original_idx")).agg(F.collect_list(F.struct(*kept)).alias("samples"))


def reference_cache(spark: SparkSession, path: str) -> DataFrame:
    """(original_idx, think_content, accuracy, box_reward, step) of a cache document; keys are whole numbers again."""
    schema = "global_step long, cache map<string,struct<think_content:string,accuracy:double,box_reward:double,step:long>>"
    return spark.read.schema(schema).option("multiLine", True).json(path).select(F.explode("cache").alias("k", "v")).select(F.col("k").cast("long").alias("original_idx"), "v.*")


def reference_state(spark: SparkSession, path: str) -> DataFrame:
    """The same as (original_idx, accuracy, value, think, step), the state that rewards.score takes."""
    return reference_cache(spark, path).select("original_idx", "accuracy", F.col("box_reward").alias("value"), F.col("think_content").alias("think"), "step")


def images(spark: SparkSession, folder: str) -> DataFrame:
    """(path, length, content) of all images below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    return files.where(F.lower(F.regexp_extract("path", r"\.([A-Za-z]+)$", 1)).isin(*IMAGE_TYPES)).select("path", "length", "content")


def image_size(content) -> tuple:
    """(width, height) columns from the header of PNG, GIF or BMP bytes; null for other kinds."""
    code = F.hex(F.substring(content, 1, 32))
    at = lambda i, n: F.substring(code, 2 * i + 1, 2 * n)
    flip = lambda i, n: F.concat(*(at(i + k, 1) for k in reversed(range(n))))
    number = lambda h: F.conv(h, 16, 10).cast("long")
    png, gif, bmp = code.startswith("89504E47"), code.startswith("47494638"), code.startswith("424D")
    pick = lambda p, g, b: F.when(png, number(at(p, 4))).when(gif, number(flip(g, 2))).when(bmp, number(flip(b, 4)))
    return pick(16, 6, 18), pick(20, 8, 22)


def prompt_templates(folder: str) -> dict[str, str]:
    """Template files by name without ending; they are short and become literals."""
    found = {}
    for name in sorted(os.listdir(folder)):
        if m := re.fullmatch(r"(.+)\.(?:jinja|txt)", name):
            with open(os.path.join(folder, name), encoding="utf-8") as f:
                found[m[1]] = f.read()
    return found


def latest_checkpoint(folder: str, tracker: str = "checkpoint_tracker.json", key: str = "last_global_step") -> str | None:
    """The folder of the last checkpoint that the tracker names, if both are there."""
    try:
        with open(os.path.join(folder, tracker), encoding="utf-8") as f:
            step = json.load(f)[key]
    except (OSError, KeyError, ValueError):
        return None
    place = os.path.join(folder, f"global_step_{step}")
    return place if os.path.isdir(place) else None


def merged_config(defaults: dict, *layers: dict) -> dict:
    """Defaults with the layers laid over them, nested keys one by one; unknown keys are an error."""
    out = {k: dict(v) if isinstance(v, dict) else v for k, v in defaults.items()}
    for layer in layers:
        for k, v in layer.items():
            if k not in out:
                raise KeyError(k)
            out[k] = merged_config(out[k], v) if isinstance(out[k], dict) and isinstance(v, dict) else v
    return out


def dotted(args: list[str]) -> dict:
    """a.b=1 arguments as nested dictionaries."""
    out: dict = {}
    for arg in args:
        path, _, raw = arg.partition("=")
        *heads, last = path.split(".")
        here = out
        for h in heads:
            here = here.setdefault(h, {})
        try:
            here[last] = json.loads(raw)
        except ValueError:
            here[last] = raw
    return out
