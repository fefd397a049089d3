"""Prompts, tokens and providers."""

from pyspark.sql import functions as F

from tessera.functions import prompts, tokens
from tessera.operators import providers


def test_grid_positions():
    ids = [7, 7, 99, 99, 99, 99, 8, 9]
    out = tokens.grid_positions(ids, [(1, 4, 4)], 99)
    assert out.tolist() == [[0, 1, 2, 2, 2, 2, 4, 5], [0, 1, 2, 2, 3, 3, 4, 5], [0, 1, 2, 3, 2, 3, 4, 5]]
    assert tokens.grid_positions([1, 2, 3], (), 99).tolist() == [[0, 1, 2]] * 3


def test_retry_and_answers(spark):
    calls = []

    def flaky(prompt):
        calls.append(prompt)
        if len(calls) < 3:
            raise RuntimeError("busy")
        return prompt.upper()

    assert providers.with_retry(flaky, 5)("a") == "A" and len(calls) == 3
    assert providers.with_retry(lambda p: None, 2)("a") is None
    df = spark.createDataFrame([("a",), ("b",), (None,), ("a",)], "p string")
    out = [r.x for r in df.select(providers.answers(F.col("p"), lambda p: p * 2).alias("x")).collect()]
    assert sorted(map(str, out)) == ["None", "aa", "aa", "bb"]


def test_generate(spark):
    df = spark.createDataFrame([(1, "p"), (2, "q")], "id long, prompt string")
    out = providers.generate(df, "prompt", 2, lambda p, k: f"{p}{k}" if k % 2 else None, r"[a-z]\d").collect()
    assert sorted((r.id, r.number, r.generated) for r in out) == [(1, 0, "p1"), (1, 1, "p3"), (2, 0, "q1"), (2, 1, "q3")]


def test_messages(spark):
    df = spark.createDataFrame([("system", "a <image>\nb")], "k string, q string")
    out = df.select(prompts.system_prompt(F.col("q"), "be kind").alias("m")).first().m
    assert [m.role for m in out] == ["system", "user"]
    assert [(c.type, c.text) for c in out[1].content] == [("text", "a "), ("image", None), ("text", "b")]
    shown = df.select(prompts.vision_content(F.array(F.lit("u")), F.col("q")).alias("c")).first().c
    assert [c.type for c in shown] == ["image_url", "text"]
