"""Column functions against plain Python."""

import re

import pytest
from pyspark.sql import functions as F

from tessera.functions import arrays, geometry, text


def one(spark, column, **values):
    kinds = {k: v[1] for k, v in values.items()}
    df = spark.createDataFrame([tuple(v[0] for v in values.values())], ", ".join(f"{k} {t}" for k, t in kinds.items()))
    return df.select(column.alias("x")).first().x


@pytest.mark.parametrize("said", [" a ", " x\t\n", "", "no", "  \n"])
def test_strip(spark, said):
    assert one(spark, text.strip(F.col("s")), s=(said, "string")) == said.strip()


@pytest.mark.parametrize("said,expected", [("<think> a\nb </think>", "a\nb"), ("none", None), ("<think></think>", ""), (None, None), ("<think>x</think><think>y</think>", "x")])
def test_tag(spark, said, expected):
    assert one(spark, text.tag(F.col("s"), "think"), s=(said, "string")) == expected


@pytest.mark.parametrize("said", ["<think>a</think>\n<answer>b</answer>", "x<think>a</think><answer>b</answer>", "<think>a<answer>b</answer>", "<think>a</think><answer>b</answer>\n"])
def test_well_formed(spark, said):
    assert one(spark, text.well_formed(F.col("s")), s=(said, "string")) == int(bool(re.fullmatch(r"<think>.*</think>.*<answer>.*</answer>", said, re.S)))


@pytest.mark.parametrize("said,expected", [("Score: 0.5", 0.0), ("10", 1.0), ("0.7 then 0.3", 0.7), ("none", None), (" 7 ", 1.0), ("-3", 0.0)])
def test_consistency(spark, said, expected):
    assert one(spark, text.consistency(F.col("s")), s=(said, "string")) == expected


@pytest.mark.parametrize("said,expected", [("x ## Equivalence Judgement TRUE", True), ("true ## Equivalence Judgement false", False), ("## Equivalence Judgement true and false", False)])
def test_verdict(spark, said, expected):
    assert one(spark, text.verdict(F.col("s")), s=(said, "string")) is expected


def test_message_parts(spark):
    out = one(spark, text.message_parts(F.col("s")), s=("<image>\nwhat <image>\nnow", "string"))
    assert [(r.type, r.text) for r in out] == [("image", None), ("text", "what "), ("image", None), ("text", "now")]


def test_render_and_names(spark):
    assert one(spark, text.render(F.col("s"), "Q: {{ content | trim }}!"), s=(" hi ", "string")) == "Q: hi!"
    assert one(spark, text.step_name(F.col("s")), s=(42, "long")) == "step_000042.json"
    assert one(spark, text.join_path(F.lit("/d/"), F.col("s")), s=("a/b", "string")) == "/d/a/b"
    assert one(spark, text.join_path(F.lit("/d"), F.col("s")), s=("/a", "string")) == "/a"
    assert one(spark, text.box_list(F.col("b")), b=([[1, 2, 3, 4], [5, 6, 7, 8]], "array<array<long>>")) == "<box1> 1 2 3 4\n<box2> 5 6 7 8"


def test_token_position(spark):
    for at, expected in ((1, 1), (3, 1), (4, 2), (6, 3), (99, 3)):
        assert one(spark, text.token_position(F.col("l"), F.lit(at)), l=([3, 2, 1], "array<long>")) == expected


@pytest.mark.parametrize("a,b,expected", [([100, 100, 200, 200], [95, 105, 195, 195], 8550 / 10450), ([0, 0, 1, 1], [2, 2, 3, 3], 0.0), ([0, 0, 0, 0], [0, 0, 0, 0], 0.0), ([0, 0, 2, 2], [0, 0, 2, 2], 1.0)])
def test_iou(spark, a, b, expected):
    assert one(spark, geometry.iou(F.col("a"), F.col("b")), a=(a, "array<long>"), b=(b, "array<long>")) == pytest.approx(expected)


def test_boxes_of_a_response(spark):
    said = "<box>[1,1,5,5]</box> <box>[1, 1,5,5]</box> <box>[9,9,2,2]</box>"
    share, n = geometry.box_validity(F.col("s"))
    assert one(spark, share, s=(said, "string")) == pytest.approx(1 / 3)
    assert one(spark, n, s=(said, "string")) == 3
    twice = "<box>[1,1,5,5]</box><box>[1,1,5,5]</box>"
    assert (one(spark, share, s=(twice, "string")), one(spark, n, s=(twice, "string"))) == (0.0, 0)
    targets = F.array(F.array(*(F.lit(v) for v in (1, 1, 5, 5)))).cast("array<array<bigint>>")
    assert one(spark, geometry.box_reward(F.col("s"), targets), s=("<box>[1,1,5,5]</box>", "string")) == 1.0
    assert one(spark, geometry.box_reward(F.col("s"), targets), s=("nothing", "string")) == 0.0
    none = F.array().cast("array<array<bigint>>")
    assert one(spark, geometry.box_reward(F.col("s"), none), s=("<box>x</box>", "string")) == 1.0


def test_rescale_rounds_half_even(spark):
    assert one(spark, geometry.rescale(F.col("b"), F.lit(0.5), F.lit(0.5)), b=([1, 3, 5, 7], "array<long>")) == [0, 2, 2, 4]


def test_response_mask_golden(spark):
    ids = [0, 0, 2, 4, 3, 5, 1, 0, 0]
    assert one(spark, arrays.response_mask(F.col("a"), [1]), a=(ids, "array<long>")) == [1, 1, 1, 1, 1, 1, 1, 0, 0]
    assert one(spark, arrays.response_mask(F.col("a"), [9]), a=(ids, "array<long>")) == [1] * 9
    assert one(spark, arrays.response_mask(F.col("a"), [3, 4]), a=(ids, "array<long>")) == [1, 1, 1, 1, 0, 0, 0, 0, 0]


def test_arrays(spark):
    assert one(spark, arrays.position_ids(F.col("a")), a=([0, 0, 1, 1, 0, 1], "array<long>")) == [0, 0, 0, 1, 1, 2]
    assert one(spark, arrays.fit(F.col("a"), 5, 0), a=([1, 2, 3], "array<long>")) == [0, 0, 1, 2, 3]
    assert one(spark, arrays.fit(F.col("a"), 2, 0, cut="left"), a=([1, 2, 3], "array<long>")) == [2, 3]
    assert one(spark, arrays.fit(F.col("a"), 2, 0, cut="right"), a=([1, 2, 3], "array<long>")) == [1, 2]
    with pytest.raises(Exception):
        one(spark, arrays.fit(F.col("a"), 2, 0, cut="error"), a=([1, 2, 3], "array<long>"))
    assert one(spark, arrays.roll_left(F.col("a")), a=([1, 2, 3], "array<long>")) == [2, 3, 1]
    assert one(spark, arrays.place_score(F.lit(4), F.col("n"), F.lit(2.5)), n=(0, "long")) == [0, 0, 0, 2.5]
    assert one(spark, arrays.place_score(F.lit(4), F.col("n"), F.lit(2.5)), n=(2, "long")) == [0, 2.5, 0, 0]
