"""The pipeline's stages, one after the other, on the smallest tables."""

import random

import corpus_pipeline
from tracewell.llm import queries

DATA = "/root/testdata/sf0.001"


def test_stages_and_run(spark):
    assert [k for k, _ in corpus_pipeline.STAGES] == ["toxicity", "quality_rules", "ngram_join", "source_mixing", "packing"]
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    ids = {r.doc_id for r in docs.select("doc_id").collect()}
    columns, kept = docs.columns, []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, DATA).cache()
        assert docs.columns == columns
        kept.append({r.doc_id for r in docs.select("doc_id").collect()})
        assert kept[-1] <= ids
        ids = kept[-1]
    packed = corpus_pipeline.run(spark, DATA).toPandas()
    assert set(packed.doc_id) == kept[-1] and packed.groupby("sequence_id").length.sum().max() <= 1024


def test_settings_of_the_session_stay(spark):
    """No operator changes how the session's later queries run."""
    keys = [k for k in ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")]
    before = [spark.conf.get(k) for k in keys]
    assert before[0] == "10000"
    for name in ("op1_toxicity", "op3_token_files", "op5_token_counts", "op12_decontamination"):
        queries.QUERIES[name](spark, DATA).count()
    assert [spark.conf.get(k) for k in keys] == before


def _tables(spark, folder, rows):
    schema = "doc_id long, text string, lang string, source string, n_chars long, score double, _doc string, label string, `a.b` map<string,int>"
    spark.createDataFrame(rows, schema).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(r[0], 1, 0) for r in rows if r[0] is not None], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")


def test_run_on_odd_tables(spark, tmp_path):
    """Nulls in every column, empty and very long texts, repeated rows, copies, and columns whose names clash."""
    rng = random.Random(3)
    vocabulary = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 7))) for _ in range(300)]
    body = lambda n: " ".join(rng.choices(vocabulary, k=n))
    texts = [None, "", "one", *[body(120) for _ in range(12)], body(20_000)]
    rows = [(k, t, "en", f"s{k % 3}", len(t or ""), 0.5, "d", "x", {"k": k}) for k, t in enumerate(texts)]
    rows += [rows[5], rows[5], (90, rows[6][1], None, None, None, None, None, None, None), (None, body(100), None, None, None, None, None, None, None), (None,) * 9]
    _tables(spark, str(tmp_path), rows)
    got = corpus_pipeline.run(spark, str(tmp_path)).toPandas()
    assert len(got) and not set(got.doc_id.dropna()) & {0, 1, 2} and got.groupby("sequence_id").length.sum().max() <= 1024
    assert not {6, 90} <= set(got.doc_id.dropna()) and (got.groupby("sequence_id").offset.min() == 0).all()
    for _, one in got.sort_values("offset").groupby("sequence_id"):
        assert one.offset.tolist() == [0, *one.length.cumsum().tolist()[:-1]]


def test_run_on_an_empty_table(spark, tmp_path):
    _tables(spark, str(tmp_path), [])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
