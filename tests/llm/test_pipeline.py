"""The pipeline against a plain version of its stages, and its behaviour on odd rows."""

import hashlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import decontaminate, queries, secret_scan, sentencepiece_codec, toxicity
from tessera.llm.common import table

from .test_corpus_operators import brute_components, edited_copies


def plain_mask(s, guesses):
    if not s:
        return s
    spans = [(a, b) for kind in secret_scan.find(s.encode(), guesses)[:2] for a, _, b in kind]
    hidden = [any(a <= i < b for a, b in spans) for i in range(len(s))]
    starts = {a for a, _ in spans if a == 0 or not hidden[a - 1] or not any(x < a < y for x, y in spans)}
    return "".join(("[secret]" if i in starts and not any(x < i < y for x, y in spans) else "") if hidden[i] else c for i, c in enumerate(s))


def test_pipeline_equals_plain_stages(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = toxicity.learn(docs, table(spark, sf_dir, "labels"))
    rows = {r.doc_id: r.text for r in docs.collect() if model.score(model.passages(toxicity.words((r.text or "").encode()))) < 0.7}
    assert len(rows) < docs.count()
    rows = {i: rows[i] for i, (_, c) in brute_components(list(rows.items())).items() if i == c}
    items = [r.text.lower().split() for r in table(spark, sf_dir, "benchmark").collect()]

    def copied(text):
        w = (text or "").lower().split()
        aligned = ((len(item), *decontaminate.align(item, w)[:2]) for item in items)
        return any((same - other / 2) / n >= decontaminate.LEAST_SCORE and same >= min(n, decontaminate.LEAST_MATCHED) for n, same, other in aligned)

    rows = {i: t for i, t in rows.items() if not copied(t)}
    library = sentencepiece_codec.Codec(queries.piece_model()).library
    expected, guesses = {}, secret_scan.Guesser(queries.guess_words())
    for i, t in rows.items():
        ids = library.encode(plain_mask(t, guesses) or "")
        expected[i] = (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
    got = {r.doc_id: (r.n_tokens, r.ids_sha256) for r in corpus_pipeline.run(spark, sf_dir).collect()}
    assert got == expected


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES[:-1])
def test_stages_keep_columns_and_clean_rows(spark, sf_dir, name, stage):
    rows = [(1, "some plain words that stand here alone", "en", "s", 38), (2, None, None, None, None), (3, "", "en", "s", 0), (None, "no id", "en", "s", 5), (4, 'key = "x" token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" end', "en", "s", 65)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("before", F.lit(1))
    out = stage(spark, docs, sf_dir)
    assert out.columns == docs.columns and out.count() == 5
    if name == "secrets":
        kept = {r.doc_id: r for r in out.collect()}
        assert "04db" not in kept[4].text and kept[4].n_chars == len(kept[4].text) and kept[1].n_chars == 38 and kept[2].text is None
    assert stage(spark, docs.where("false"), sf_dir).count() == 0


def test_stage_drops_one_edited_copy_in_many_documents(spark, tmp_path):
    items, docs = edited_copies(50)
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = corpus_pipeline.drop_benchmark_copies(spark, spark.createDataFrame([*docs, (1000, "clean text")], "doc_id long, text string"), str(tmp_path))
    assert [r.doc_id for r in out.collect()] == [1000]
