"""The pipeline against brute-force views of each stage."""

from __future__ import annotations

import pytest

WHERE = "/root/testdata/sf0.001"


def test_every_query_runs_on_the_small_tables(spark):
    from tillsight.llm.queries import QUERIES

    assert len(QUERIES) == 13
    docs = spark.read.parquet(f"{WHERE}/documents.parquet").count()
    for name in ("op4_kd_shards", "op6_sentencepiece", "op7_near_duplicates", "op8_quality_rules", "op9_quality_net", "op10_pii",
                 "op13_token_alignment"):
        assert QUERIES[name](spark, WHERE).count() == docs, name
    pages = spark.read.parquet(f"{WHERE}/pages.parquet").count()
    for name in ("op3_main_text", "op11_url_templates"):
        assert QUERIES[name](spark, WHERE).count() == pages, name


def test_stages(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    from tests.llm.test_copies_leaks import brute_components
    from tests.llm.test_quality_pii_text import brute_spans

    docs = spark.read.parquet(f"{WHERE}/documents.parquet")
    columns = docs.columns
    marks = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{WHERE}/labels.parquet").collect()}
    items = [r["text"] for r in spark.read.parquet(f"{WHERE}/benchmark.parquet").collect()]
    for k, (name, stage) in enumerate(pipeline.STAGES):
        before = {r["doc_id"]: r["text"] for r in docs.collect()}
        stage(spark, docs, WHERE).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        after = {r["doc_id"]: r["text"] for r in docs.collect()}
        assert set(after) <= set(before)
        if name != "sentencepiece":
            assert docs.columns == columns
        if name == "quality classifier":
            good = [i for i in before if marks.get(i) == 1]
            bad = [i for i in before if marks.get(i) == 0]
            assert sum(i in after for i in good) >= 0.97 * len(good)
            assert sum(i in after for i in bad) <= 0.3 * len(bad)
        if name == "near-duplicates":
            roots, _ = brute_components(before)
            assert set(after) == set(roots.values())
        if name == "decontamination":
            assert not any(item in text for text in after.values() for item in items)
            gone = set(before) - set(after)
            assert all(any(set(item.lower().split()) & set(before[i].lower().split()) for item in items) for i in gone)
        if name == "personal data":
            assert not any(brute_spans(t) for t in after.values())
            assert all(after[i] == before[i] for i in after if not brute_spans(before[i]) and "[" not in after[i])
    assert all(r["decoded"] == r["text"] and r["n_tokens"] == len(r["ids"]) for r in docs.collect())


def test_rows_without_an_id_and_two_texts_under_one_id(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    item = spark.read.parquet(f"{WHERE}/benchmark.parquet").first()["text"]
    prose = [" ".join(f"word{k}of{n}" for k in range(60)) for n in range(4)]
    rows = [(None, prose[0]), (None, prose[1] + " " + item), (1, prose[1]), (1, prose[2] + " " + item), (2, prose[3]), (None, prose[3]),
            (3, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", None) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    clean = pipeline.decontaminate(spark, docs, WHERE)
    assert clean.columns == docs.columns
    key = lambda r: (str(r[0]), str(r[1]))
    assert sorted(((r["doc_id"], r["text"]) for r in clean.collect()), key=key) == sorted(
        [(None, prose[0]), (1, prose[1]), (2, prose[3]), (None, prose[3]), (3, None)], key=key)
    once = pipeline.near_duplicates(spark, clean, WHERE)
    assert sorted(((r["doc_id"], r["text"]) for r in once.collect()), key=key) == sorted(
        [(None, prose[0]), (1, prose[1]), (2, prose[3]), (3, None)], key=key)
    assert pipeline.quality(spark, docs, WHERE).columns == docs.columns


def test_texts_that_stay_are_not_moved(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    from tillsight.llm._tables import without

    rows = [(i, f"text {i}", "en", "s", 1) for i in range(300)] + [(7, "text 7", "en", "s", 1), (None, "none", "en", "s", 1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    gone = spark.createDataFrame([(i,) for i in (7, 8, 7, 5000)], "_key bigint")
    left = pipeline._without(pipeline._keyed(docs), gone)
    assert left.columns == docs.columns
    shown = left._jdf.queryExecution().optimizedPlan().toString()
    # one branch of the rows that the bitmap rules out, one with the exact join
    assert shown.count("LeftAnti") == 1 and "Union" in shown
    want = sorted(str(tuple(r)) for r in rows if r[0] not in (7, 8))
    assert sorted(str(tuple(r)) for r in left.collect()) == want
    # a bitmap that rules out next to nothing changes nothing
    crowded = without(pipeline._keyed(docs), gone.union(spark.range(1000, 1400).toDF("_key")), "_key", 6)
    assert sorted(str(tuple(r)) for r in crowded.select(*docs.columns).collect()) == want
    assert without(pipeline._keyed(docs), gone.limit(0), "_key").count() == len(rows)


def test_tokens_are_handed_on_slice_by_slice():
    import pyarrow as pa
    from pyspark.sql.types import LongType, StringType, StructField, StructType

    from tillsight.llm import sp_bpe
    from tillsight.llm.queries import tokenizer_path

    class Docs:
        columns = ["doc_id", "text"]
        schema = StructType([StructField("doc_id", LongType()), StructField("text", StringType())])

        def select(self, *_):
            return self

        def mapInArrow(self, run, _):
            return run

    texts = ["one two " * 150_000, None, "three", "four " * 250_000, ""]
    batch = pa.RecordBatch.from_arrays([pa.array(range(5), pa.int64()), pa.array(texts)], names=["doc_id", "text"])
    got = list(sp_bpe.encode(Docs(), tokenizer_path())(iter([batch])))
    assert len(got) == 2
    rows = [r for b in got for r in b.to_pylist()]
    assert [r["doc_id"] for r in rows] == list(range(5)) and [r["decoded"] for r in rows] == [t or "" for t in texts]
