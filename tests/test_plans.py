import pytest
from pyspark.sql import functions as F

from tokenloom.operators import packing, scoring, stream
from tokenloom.operators.encode import encode, encoder
from tokenloom.plans.prepare import prepare_all, train_vocab
from tokenloom.session import work_path
from tokenloom.streaming.files import stream_prepare


@pytest.fixture
def raw(tmp_path):
    folder = tmp_path / "raw"
    folder.mkdir()
    for n in range(3):
        text = "\n\n".join(f"Story {n} {i}.\nIt was a day like day {i % 7}." for i in range(40))
        (folder / f"{n}.txt").write_text(text + "\n")
    return str(folder)


@pytest.mark.parametrize("mode, eos, ratio, header", [("documents", 120, 0.05, 16), ("chunks", 0, 0.01, 0)])
@pytest.mark.parametrize("model", ["bpe", "word"])
def test_prepare_all(spark, raw, mode, eos, ratio, header, model):
    made = prepare_all(spark, raw, 340, mode=mode, model=model, context_length=16, chunk_size=50)
    rows = made.stream.collect()
    assert sum(i == 3 for r in rows for i in r.ids) == eos
    total = sum(len(r.ids) for r in rows)
    stats = {r.split: r for r in made.stats.collect()}
    assert stats["val"].total_tokens == int(total * ratio)
    assert stats["train"].total_tokens == total - int(total * ratio)
    assert stats["train"].file_size_mb == (header + 2 * stats["train"].total_tokens) / 2**20
    order = sorted(rows, key=lambda r: r.start_pos)
    assert [r.doc_id for r in order] == list(range(len(order)))
    assert stream.check_ids(made.stream, 340).count() == 0


def test_streamed_documents_equal_batch(spark, raw):
    docs = spark.read.text(raw)
    ids_of = encoder(train_vocab(docs, 320, "char", text="value"), "char")
    target, state = work_path(spark, "streamed"), work_path(spark, "state")
    query = stream_prepare(spark, raw, target, state, ids_of, max_files_per_trigger=2)
    query.awaitTermination()
    assert query.exception() is None
    got = {(r.file.rsplit("/", 1)[-1], r.doc_no): r.ids for r in spark.read.parquet(target).collect()}
    from tokenloom.operators.documents import documents
    from tokenloom.sources.corpus import scan_corpus

    batch = encode(documents(scan_corpus(spark, raw)), ids_of, add_eos=True).collect()
    assert got == {(r.file.rsplit("/", 1)[-1], r.doc_no): r.ids for r in batch}


def plan_of(df):
    return df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


def test_plans_stay_distributed(spark):
    """No single-partition exchange and no product join over data that grows."""
    rows = spark.range(100).select(
        F.col("id").alias("doc_id"), F.array(F.lit(1), F.lit(2)).alias("ids"), F.lit(2).cast("long").alias("n_tokens"),
        (F.col("id") * 2).alias("start_pos"),
    )
    for df in (
        packing.pack_disjoint(rows, 3, 200),
        packing.pack_overlap(rows, 3, 200),
        stream.split(rows, 0.1, 200),
        scoring.top_p(scoring.candidates(rows.select(F.col("doc_id").alias("row_id"), F.col("ids").alias("logits"))), 0.9),
    ):
        text = plan_of(df)
        assert "SinglePartition" not in text and "CartesianProduct" not in text and "NestedLoop" not in text
    chain = scoring.candidates(rows.select(F.col("doc_id").alias("row_id"), F.col("ids").alias("logits")))
    text = plan_of(scoring.top_p(scoring.top_k(scoring.temperature(chain, 0.8), 5), 0.9))
    assert text.count("hashpartitioning(") == 1


def test_range_read_filters_files(spark):
    docs = spark.range(500).select(F.col("id").alias("doc_id"), F.col("id").cast("string").alias("text"))
    path = work_path(spark, "stream")
    stream.write_stream(docs, lambda t: F.array(t.cast("int")), path, rows_per_block=20)
    text = plan_of(stream.read_stream(spark, path, 100, 110))
    assert "GreaterThanOrEqual(block" in text and "LessThanOrEqual(block" in text
    assert sorted(r.doc_id for r in stream.read_stream(spark, path, 100, 110).collect()) == list(range(50, 55))
