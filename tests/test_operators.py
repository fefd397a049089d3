"""Grouped, sequential, sampling and scoring operators against plain Python."""

import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import balance, curation, groups, losses, metrics, rewards, sampling, scans
from tessera.sources import files, sinks


def test_grpo_and_rloo(spark):
    random.seed(1)
    data = [(i, i % 4, random.randint(-50, 50)) for i in range(40)]
    df = spark.createDataFrame(data, "id long, uid long, score long")
    got = {r.id: r.advantage for r in groups.grpo(df, "uid", "score").collect()}
    loo = {r.id: r.advantage for r in groups.rloo(df, "uid", "score").collect()}
    floats = {r.id: r.advantage for r in groups.grpo(df.withColumn("score", F.col("score").cast("double")), "uid", "score").collect()}
    for i, u, s in data:
        own = [x for _, v, x in data if v == u]
        assert got[i] == pytest.approx((s - statistics.mean(own)) / (statistics.stdev(own) + 1e-6))
        assert floats[i] == pytest.approx(got[i])
        assert loo[i] == pytest.approx(s - (sum(own) - s) / (len(own) - 1))
    with pytest.raises(Exception):
        groups.grpo(df.limit(1), "uid", "score").collect()


def test_segment_grpo_singleton(spark):
    df = spark.createDataFrame([("a", 3.0, 1.0, 9, [1, 1, 1, 1])], "uid string, s1 double, s2 double, cut long, mask array<long>")
    assert groups.segment_grpo(df, "uid", "s1", "s2", "cut", "mask").first().advantages == [0, 0, 0, 0]
    two = df.union(df.withColumn("s1", F.lit(1.0)).withColumn("cut", F.lit(-1)))
    out = sorted(r.advantages for r in groups.segment_grpo(two, "uid", "s1", "s2", "cut", "mask").collect())
    assert out[0][0] == pytest.approx(-0.7071, abs=1e-3) and out[0][2] == 0
    assert set(groups.ESTIMATORS) == {"grpo", "rloo", "remax", "segment_grpo"}


def test_reverse_scans(spark):
    rng = np.random.default_rng(2)
    data = [(i, rng.normal(size=n).tolist(), rng.normal(size=n).tolist(), rng.integers(0, 2, n).astype(float).tolist()) for i, n in enumerate((1, 5, 0, 9))]
    df = spark.createDataFrame(data, "id long, r array<double>, v array<double>, m array<double>")
    out = {x.id: x for x in df.select("id", scans.gae(F.col("r"), F.col("v"), 0.9, 0.8).alias("g"), scans.discounted(F.col("r"), F.col("m"), 0.9).alias("d")).collect()}
    for i, r, v, m in data:
        adv, last, run, back = [0.0] * len(r), 0.0, 0.0, [0.0] * len(r)
        for t in reversed(range(len(r))):
            after = v[t + 1] if t + 1 < len(r) else 0.0
            last = r[t] + 0.9 * after - v[t] + 0.72 * last
            adv[t] = last
            run = r[t] + 0.9 * run
            back[t] = run
            run *= m[t]
        assert out[i].g.advantages == pytest.approx(adv)
        assert out[i].g.returns == pytest.approx([a + b for a, b in zip(adv, v)])
        assert out[i].d == pytest.approx(back)


def test_whiten(spark):
    rng = np.random.default_rng(3)
    v, m = rng.normal(size=(6, 8)), rng.integers(0, 2, (6, 8))
    df = spark.createDataFrame([(i, v[i].tolist(), m[i].tolist()) for i in range(6)], "id long, v array<double>, m array<long>")
    out = np.array([r.whitened for r in scans.whiten(df, "v", "m").orderBy("id").collect()])
    picked = v[m == 1]
    assert out == pytest.approx((v - picked.mean()) / np.sqrt(picked.var(ddof=1) + 1e-8), rel=1e-6)


def test_running_best_first_wins(spark):
    df = spark.createDataFrame([("k", 1.0, 0.5, 1), ("k", 1.0, 0.5, 2), ("k", 0.0, 9.0, 3), ("k", 1.0, 0.7, 4)], "key string, acc double, value double, step long")
    out = [(-r.best.negative_step) for r in groups.running_best(df, "key", "acc", "value", "step").orderBy("step").collect()]
    assert out == [1, 1, 1, 4]


def test_four_rollouts(spark):
    """The hand-made fixture: two A and two B rollouts of one key."""
    said = lambda box, answer: f"<think>t{box}</think><answer>{answer}</answer>"
    data = [
        (0, "A", said("<box>[100,100,200,200]</box>", "red")), (1, "A", said("<box>[95,105,195,195]</box>", "red")),
        (2, "B", said("", "red")), (3, "B", said("", "blue")),
    ]
    df = spark.createDataFrame([(p, 0, g, r, "red", [[100, 100, 200, 200]], 1) for p, g, r in data], "pos long, original_idx long, `group` string, response string, ground_truth string, target_boxes array<array<long>>, step long")
    out = rewards.score(df).orderBy("pos").collect()
    assert [r.overall for r in out] == pytest.approx([4.0, 3.818182, 2.0, 1.0], abs=1e-6)
    assert [r.reference is not None for r in out] == [True] * 4
    best = rewards.references(rewards.score(df)).collect()
    assert len(best) == 1 and best[0].value == 1.0


def test_stored_references(spark):
    """A stored reference stays unless a row of this run is better."""
    said = lambda t, box, answer: f"<think>{t}{box}</think><answer>{answer}</answer>"
    data = [(0, 0, "A", said("new", "<box>[95,105,195,195]</box>", "red")), (1, 0, "B", said("b", "", "red")), (2, 1, "A", said("new", "<box>[100,100,200,200]</box>", "red")), (3, 2, "B", said("b", "", "red"))]
    df = spark.createDataFrame([(p, i, g, r, "red", [[100, 100, 200, 200]], 1) for p, i, g, r in data], "pos long, original_idx long, `group` string, response string, ground_truth string, target_boxes array<array<long>>, step long")
    state = spark.createDataFrame([(0, 1.0, 0.99, "stored"), (1, 1.0, 0.4, "stored"), (2, 1.0, 0.9, "stored")], "original_idx long, accuracy double, value double, think string")
    got = {r.pos: r.reference for r in rewards.score(df, state=state).collect()}
    assert got[0] == got[1] == got[3] == "stored" and got[2].startswith("new")


def test_losses(spark):
    df = spark.createDataFrame([(0.1, -0.2, 0.5), (0.4, 0.1, -0.7), (30.0, 0.0, 1.0), (30.0, 0.0, -1.0)], "p double, q double, a double")
    out = losses.policy_loss(F.col("q"), F.col("p"), F.col("a"), 0.2, 0.3, 3.0)
    for r in df.select("*", *(c.alias(k) for k, c in out.items())).collect():
        d = min(20, max(-20, r.p - r.q))
        plain, clipped, bound = -r.a * np.exp(d), -r.a * np.exp(min(np.log(1.3), max(np.log(0.8), d))), -r.a * 3
        higher = max(plain, clipped)
        assert r.loss == pytest.approx(min(higher, bound) if r.a < 0 else higher)
        assert r.clipped_lower == float(higher > bound and r.a < 0)
    control = losses.kl_controller("adaptive", 0.1, 1.0, 100)
    assert control.update(5.0, 10) == pytest.approx(0.1 * 1.02)
    assert losses.kl_controller("fixed", 0.3).update(9, 9) == 0.3
    arrays = spark.createDataFrame([([0.0, -1.0], [-1.0, 0.0])], "a array<double>, b array<double>")
    assert arrays.select(losses.full_kl(F.col("a"), F.col("b")).alias("x")).first().x == pytest.approx(1 - np.exp(-1))


def test_means_skip_what_does_not_apply(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", float("nan")), ("a", None), ("b", float("nan"))], "m string, v double")
    out = {r.m: r["mean"] for r in metrics.reduce_means(df, "m", "v").collect()}
    assert out["a"] == 1.0 and out["b"] != out["b"]
    m = spark.range(1).select(metrics.drop_internal(F.create_map(F.lit("_x"), F.lit(1.0), F.lit("y"), F.lit(2.0))).alias("m")).first().m
    assert m == {"y": 2.0}


def test_online_filter_is_strict(spark):
    df = spark.createDataFrame([(1, 0), (1, 1), (2, 1), (2, 1), (3, 0)], "uid long, s long")
    assert {r.uid for r in groups.online_filter(df, "uid", "s", 0.0, 1.0).collect()} == {1}
    assert groups.online_filter(df, "uid", "s", 0.5, 1.0).count() == 0


def test_differencing():
    random.seed(4)
    for equal in (False, True):
        sizes = [random.randint(1, 1000) for _ in range(64)]
        parts = balance.balanced(sizes, 8, equal)
        loads = [sum(sizes[i] for i in p) for p in parts]
        assert sorted(i for p in parts for i in p) == list(range(64))
        assert max(loads) - min(loads) <= (200 if equal else 50)
        if equal:
            assert {len(p) for p in parts} == {8}
    with pytest.raises(ValueError):
        balance.differencing([1, 2, 3], 2, True)
    greedy = balance.greedy([5, 4, 3, 2], 2, True)
    assert {len(p) for p in greedy} == {2}


def test_micro_batches_restore(spark):
    random.seed(5)
    sizes = [random.randint(50, 90) for _ in range(20)]
    df = spark.createDataFrame([(0, i, s) for i, s in enumerate(sizes)], "batch long, pos long, n long")
    out = balance.dynamic(df, "batch", "n", 300).collect()
    assert sorted((r.pos, r.n) for r in out) == list(enumerate(sizes))
    assert len({r.part for r in out}) == -(-sum(sizes) // 300)
    work = {}
    for r in out:
        work[r.part] = work.get(r.part, 0) + r.n * r.n
    assert [work[k] for k in sorted(work)] == sorted(work.values(), reverse=True)


def test_samplers(spark):
    pairs = spark.range(50).select(F.col("id").alias("k"), F.explode(F.array(F.lit("A"), F.lit("B"))).alias("g"))
    a, b = (sampling.paired(pairs.repartition(n), "k", "g", 42).orderBy("pos").collect() for n in (1, 7))
    assert a == b and all(a[i].k == a[i + 1].k for i in range(0, 100, 2)) and [r.pos for r in a] == list(range(100))
    mixed = sampling.mixed(spark.range(20).select(F.col("id").alias("k")), spark.range(100, 105).select(F.col("id").alias("k")), "k", 1, 8, 0.5)
    rows = mixed.collect()
    assert len(rows) == 10 * 8 and len({(r.batch_id, r.slot) for r in rows}) == 80
    assert sum(r.kind == "pair" for r in rows) == 40
    empty = sampling.mixed(spark.range(20).select(F.col("id").alias("k")), spark.range(0).select(F.col("id").alias("k")), "k", 1, 8, 0.5)
    assert empty.count() == 40
    assert sampling.sample_all(pairs, "k", 0, 1).count() == 0


def test_ranks_in_buckets(spark, monkeypatch):
    df = spark.range(500).select(F.col("id").alias("k"), (F.col("id") % 2).alias("g"))
    whole = [sampling.shuffled(df, "k", 9).orderBy("k").collect(), sampling.epochs(df, 50, 2, 3, "k", 500).orderBy("epoch", "k").collect()]
    monkeypatch.setattr(sampling, "BUCKET_ROWS", 10)
    assert whole[0] == sampling.shuffled(df, "k", 9).orderBy("k").collect()
    cut = sampling.epochs(df, 50, 2, 3, "k", 500).orderBy("epoch", "k")
    assert [(r.epoch, r.k, r.pos) for r in whole[1]] == [(r.epoch, r.k, r.pos) for r in cut.collect()]


def test_retention(spark):
    steps = spark.createDataFrame([(s,) for s in (5, 10, 15, 20, 25)], "step long")
    assert sorted(r.step for r in curation.retained(steps, 30, 10, 3).collect()) == [10, 25]


def test_files_and_sinks(spark, tmp_path):
    rows = spark.createDataFrame([(1, 1, "q", "g", "r", "A", 7, "d", {"x": 1.0, "_y": 2.0}), (1, 0, "p", "g", "r", "B", 8, "d", {"x": 3.0}), (2, 0, "p", "g", "r", "B", 8, "d", {})], "step long, index long, question string, ground_truth string, response string, `group` string, original_idx long, datasource string, rewards map<string,double>")
    sinks.write_documents(sinks.step_documents(rows), str(tmp_path / "logs"))
    (tmp_path / "logs" / "step_000003.json").write_text("{broken")
    assert sorted(p.name for p in (tmp_path / "logs").glob("step_*.json")) == ["step_000001.json", "step_000002.json", "step_000003.json"]
    back = files.step_logs(spark, str(tmp_path / "logs")).orderBy("step", "place").collect()
    assert [(r.step, r["index"], r.question) for r in back] == [(1, 0, "p"), (1, 1, "q"), (2, 0, "p")]
    assert back[1].rewards == {"x": 1.0}
    (tmp_path / "pool").mkdir()
    for name, body in (("3.json", '[{"a": "x"}, {"a": "y"}]'), ("nope.json", '[{"a": "z"}]'), ("4.json", "[]")):
        (tmp_path / "pool" / name).write_text(body)
    pool = files.offline_samples(spark, str(tmp_path / "pool"), "a string").collect()
    assert [(r.original_idx, sorted(s.a for s in r.samples)) for r in pool] == [(3, ["x", "y"])]
    (tmp_path / "cache.json").write_text('{"global_step": 4, "cache": {"12": {"think_content": "t", "accuracy": 1.0, "box_reward": 0.5, "step": 3}}}')
    assert files.reference_cache(spark, str(tmp_path / "cache.json")).first().original_idx == 12
    rows.select("step", "question").write.parquet(str(tmp_path / "data" / "train"))
    assert files.dataset(spark, f"{tmp_path / 'data'}@train").count() == 3
    assert files.latest_checkpoint(str(tmp_path)) is None
    (tmp_path / "global_step_5").mkdir()
    sinks.write_tracker(str(tmp_path / "checkpoint_tracker.json"), 5, 0.123456, 5, "x")
    assert files.latest_checkpoint(str(tmp_path)).endswith("global_step_5")


def test_image_headers(spark):
    png = b"\x89PNG\r\n\x1a\n" + b"\0\0\0\rIHDR" + (640).to_bytes(4, "big") + (480).to_bytes(4, "big") + b"\0" * 8
    gif = b"GIF89a" + (12).to_bytes(2, "little") + (34).to_bytes(2, "little") + b"\0" * 30
    df = spark.createDataFrame([(bytearray(png),), (bytearray(gif),), (bytearray(b"?"),)], "content binary")
    w, h = files.image_size(F.col("content"))
    assert [tuple(r) for r in df.select(w, h).collect()] == [(640, 480), (12, 34), (None, None)]


def test_config():
    assert files.merged_config({"a": {"b": 1, "c": 2}, "d": 3}, {"a": {"b": 5}}, files.dotted(["a.c=7", "d=x"])) == {"a": {"b": 5, "c": 7}, "d": "x"}
    with pytest.raises(KeyError):
        files.merged_config({"a": 1}, {"z": 2})


def test_curation(spark):
    df = spark.createDataFrame([(1, "ask", "one <box>[1,2,3,4]</box>  two")], "id long, problem string, body string")
    out = curation.rewrites(df, F.col("body"), 2, lambda b, i: F.lit("same")).first().variants
    assert out == ["same", "one two"]
    row = curation.defaults(df).first()
    assert (row.question, row.datasource, row.question_type, row.target_instances) == ("ask", "unknown", "validation", [])
    record = df.select(curation.sample_record(F.lit("q"), F.lit(" t "), F.lit("a"), F.array(F.lit("i")), F.lit("s"), " ").alias("r")).first().r
    assert record.conversations[1].value == "<think>t</think> <answer>a</answer>"
