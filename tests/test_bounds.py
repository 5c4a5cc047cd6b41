"""Bounds that raise, reads that prune, and plans that do not move exploded rows."""

from pathlib import Path

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tokenloom import session
from tokenloom.functions import positions
from tokenloom.functions.positions import first_rows, range_block
from tokenloom.functions.tables import SPECIAL_IDS
from tokenloom.operators import chat, scoring, stream
from tokenloom.operators.encode import decode, encoder
from tokenloom.operators.vocab import assemble_vocab, lookup_id, lookup_piece
from tokenloom.plans.prepare import prepare_all
from tokenloom.session import scratch, work_path
from tokenloom.sources.corpus import export_corpus, scan_corpus
from tokenloom.sources.vocab_files import read_vocab, write_vocab


def plan_of(df):
    return df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")


def test_large_vocabularies_raise_everywhere(spark, tmp_path):
    vocab = spark.range(70_000).select(
        F.col("id").cast("int").alias("id"), F.concat(F.lit("p"), "id").alias("piece"), F.lit(0.0).alias("score"), F.lit("piece").alias("kind")
    )
    ids = spark.createDataFrame([([69_999],)], "ids array<int>")
    (tmp_path / "v.vocab").write_text("\n".join(f"p{i}\t0" for i in range(70_000)))
    for use in (
        lambda: lookup_id(spark.createDataFrame([("p69999",)], "piece string"), vocab).collect(),
        lambda: lookup_piece(spark.createDataFrame([(5,)], "id int"), vocab).collect(),
        lambda: decode(ids, vocab).collect(),
        lambda: encoder(vocab, "word"),
        lambda: write_vocab(vocab, work_path(spark, "vocab")),
        lambda: read_vocab(spark, str(tmp_path / "v.vocab")).collect(),
    ):
        with pytest.raises(Exception, match="at most 65536"):
            use()


def test_too_many_blocks_raise(spark, monkeypatch):
    monkeypatch.setattr(positions, "MAX_BLOCKS", 3)
    with pytest.raises(ValueError, match="make them larger"):
        range_block(spark.range(100).withColumnRenamed("id", "doc_id"), "doc_id", rows_per_block=10)


def test_blocks_are_bounded_in_bytes(spark):
    sizes = [10] * 400 + [100_000] * 20 + [10] * 400
    docs = spark.createDataFrame([(i, "x" * n) for i, n in enumerate(sizes)], "doc_id long, text string")
    path = work_path(spark, "stream")
    stream.write_stream(docs, lambda t: F.array(F.length(t)), path, bytes_per_block=300_000)
    held = spark.read.parquet(f"{path}/rows").groupBy("block").agg(F.sum(F.get("ids", F.lit(0))).alias("n")).collect()
    assert max(r.n for r in held) <= 2 * 300_000
    got = stream.read_stream(spark, path).orderBy("start_pos").collect()
    assert [r.doc_id for r in got] == list(range(820))


def test_long_texts_and_their_ids_are_read_few_at_a_time(spark, monkeypatch, tmp_path):
    """A reader unpacks a row group at once, up to 4,096 rows: groups are bounded by what rows hold, copies too."""
    monkeypatch.setattr(session, "ROW_GROUP_BYTES", 1 << 16, raising=False)
    lines = ["one two three four"] * 20_000 + [f"{i} w{i % 90} {i % 90}x{i}" for i in range(20_000)]
    (tmp_path / "0.txt").write_text("\n".join(lines) + "\n")
    shared = Path(spark.conf.get("spark.checkpoint.dir")) / "tokenloom"
    before = set(shared.iterdir()) if shared.exists() else set()
    made = prepare_all(spark, str(tmp_path), 340, mode="chunks", model="word", chunk_size=50, coverage=1.0)
    tables = {p.name.split("-")[0]: p for p in set(shared.iterdir()) - before}
    for name, column, folder in (("chunks", "text", "."), ("texts", "text", "."), ("stream", "ids", "rows")):
        held = []
        for file in (tables[name] / folder).glob("part-*.parquet"):
            groups = pq.ParquetFile(file)
            for g in range(groups.num_row_groups):
                values = groups.read_row_group(g, columns=[column]).column(column).to_pylist()
                held.append(sum(len(v) * (4 if column == "ids" else 1) for v in values))
        assert sum(held) > 4 * (1 << 16), name
        assert max(held) < 3 * (1 << 16), name
    rows = made.stream.orderBy("start_pos").collect()
    assert [r.doc_id for r in rows] == list(range(800))
    text = spark.createDataFrame([(" ".join(lines),)], "text string")
    whole = text.select(encoder(made.vocab, "word", "nfkc")(F.col("text")).alias("ids")).first().ids
    assert [i for r in rows for i in r.ids] == whole


@pytest.fixture
def written(spark):
    docs = spark.range(600).select(F.col("id").alias("doc_id"), F.col("id").cast("string").alias("text"))
    path = work_path(spark, "stream")
    stream.write_stream(docs, lambda t: F.array(t.cast("int"), t.cast("int") + 1000, F.lit(7)), path, add_eos=False, rows_per_block=20)
    flat = [x for i in range(600) for x in (i, i + 1000, 7)]
    return path, flat


def test_point_and_slice_reads_prune_blocks(spark, written):
    path, flat = written
    asked = spark.createDataFrame([(1, 5), (2, -1), (3, 700), (4, 5000), (5, -5000)], "request_id long, pos long")
    got = {r.request_id: (r.token_id, r.error) for r in stream.read_token_at(spark, path, asked).collect()}
    assert got == {1: (flat[5], None), 2: (flat[-1], None), 3: (flat[700], None), 4: (None, "out of range"), 5: (None, "out of range")}
    slices = [(1, 5, 12, 1), (2, -10, None, 1), (3, 900, 800, -3), (4, None, None, 7), (5, 50, 40, 1), (6, None, None, -1), (7, 3, 1700, 11)]
    asked = spark.createDataFrame(slices, "request_id long, start long, stop long, step long")
    got = {r.request_id: r.ids for r in stream.read_slices(spark, path, asked).collect()}
    assert got == {i: flat[a:b:s] for i, a, b, s in slices}
    chunk = spark.createDataFrame([(1, 100, 9), (2, 1790, 20)], "request_id long, start long, length long")
    got = {r.request_id: (r.ids, r.error) for r in stream.read_chunks(spark, path, chunk).collect()}
    assert got == {1: (flat[100:109], None), 2: (None, "out of range")}
    text = plan_of(stream.read_spans(spark, path, spark.createDataFrame([(100, 110)], "lo long, hi long")))
    assert "GreaterThanOrEqual(block" in text and "LessThanOrEqual(block" in text


def test_long_slices_come_in_parts(spark, written, monkeypatch):
    path, flat = written
    monkeypatch.setattr(stream, "SPAN", 256)
    asked = spark.createDataFrame([(1, None, None, 1), (2, None, None, -5), (3, 10, 1500, 7)], "request_id long, start long, stop long, step long")
    rows = stream.read_slices(spark, path, asked, parts=True).collect()
    assert max(len(r.ids) for r in rows) <= 256 and sum(r.request_id == 1 for r in rows) > 5
    for i, want in ((1, flat), (2, flat[::-5]), (3, flat[10:1500:7])):
        parts = sorted((r.part_no, r.ids) for r in rows if r.request_id == i)
        assert [x for _, ids in parts for x in ids] == want


def test_parts_of_the_split_read_their_blocks(spark, written):
    path, flat = written
    val = stream.read_part(spark, path, 0.05, "val")
    rows = sorted((r.start_pos, r.ids) for r in val.collect())
    cut = len(flat) - int(len(flat) * 0.05)
    assert [x for _, ids in rows for x in ids] == flat[cut:]
    rows = sorted((r.start_pos, r.ids) for r in stream.read_part(spark, path, 0.05, "train").collect())
    assert [x for _, ids in rows for x in ids] == flat[:cut]
    assert "GreaterThanOrEqual(block" in plan_of(val)


def test_penalty_moves_no_candidates(spark):
    scores = spark.createDataFrame([(0, [1.0, -2.0, 3.0, 0.0]), (1, [5.0, 4.0]), (2, [1.0])], "row_id long, logits array<double>")
    seen = spark.createDataFrame([(0, 1), (0, 2), (0, 2), (1, 0), (1, 9), (5, 0)], "row_id long, token_id int")
    fast = scoring.candidates(scores, history=seen, penalty=2.0)
    slow = scoring.repetition_penalty(scoring.candidates(scores), seen, 2.0)
    assert sorted(map(tuple, fast.collect())) == sorted(map(tuple, slow.select(*fast.columns).collect()))
    drawn = scoring.next_token(scores, seen, 2.0, 0.8, 2, 0.9, seed=3)
    assert sorted(map(tuple, drawn.collect())) == sorted(
        map(tuple, scoring.next_token(scoring.candidates(scores), seen, 2.0, 0.8, 2, 0.9, seed=3).collect())
    )
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan_of(scoring.next_token(scores, seen, 2.0, 0.8, 2, 0.9, seed=3))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert text.count("hashpartitioning(") == 2  # logits and history by row, both ahead of the explode


def test_first_rows_are_exact(spark, monkeypatch):
    monkeypatch.setattr(positions, "_SAMPLED_KEYS", 50)
    rng = np.random.default_rng(1)
    rows = [(int(k), f"w{i:04d}") for i, k in enumerate(rng.integers(0, 5, 3000))]
    df = spark.createDataFrame(rows, "k long, w string").repartition(7)
    for n in (0, 1, 10, 700, 2999, 3000, 5000):
        assert sorted(map(tuple, first_rows(df, ["k", "w"], n).collect())) == sorted(rows)[:n]


def test_limited_export_keeps_the_first_documents(spark):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(500, 0, -1)], "doc_id long, text string").repartition(5)
    for n in (0, 7, 500, 600):
        path = work_path(spark, "export")
        export_corpus(docs, path, limit=n)
        texts = [r.value for r in spark.read.option("lineSep", "\n\n").schema("value string").text(path).collect()]
        assert sorted(texts) == sorted(f"text {i}" for i in range(1, min(n, 500) + 1))


def test_broken_bytes_go_and_real_replacements_stay(spark, tmp_path):
    real = "a�b ﷐﷒﷐﷑ ﷐"
    (tmp_path / "x.txt").write_bytes(real.encode() + b"\n\x66\xff\xfe\x67 \xc3\n")
    lines = [r.line for r in scan_corpus(spark, str(tmp_path), drop_bad_bytes=True).orderBy("row_key").collect()]
    assert lines == [real, "fg "]


def test_scratch_tables_go(spark, tmp_path):
    import os

    from tokenloom.session import materialize

    with scratch(spark):
        path = materialize(spark.range(3), "gone").inputFiles()[0]
        place = path.removeprefix("file://")
        assert os.path.exists(place)
    assert not os.path.exists(place)


def test_export_limit_keeps_rows_without_a_key(spark, tmp_path):
    docs = spark.createDataFrame([(2, "b"), (None, "n"), (1, "a")], "doc_id long, text string")
    for limit, want in ((5, ["a", "b", "n"]), (2, ["a", "n"]), (1, ["n"])):
        path = str(tmp_path / f"out{limit}")
        export_corpus(docs, path, limit=limit)
        assert sorted(r.value for r in spark.read.option("lineSep", "\n\n").text(path).collect()) == want


def test_null_and_empty_messages_lose_nothing(spark):
    pieces = spark.createDataFrame([("▁a", 0), ("▁b", 1)], "piece string, rank long")
    ids_of = encoder(assemble_vocab(pieces, None, 300), "word")
    rows = [(1, 0, "user", "a"), (1, 1, "assistant", None), (1, 2, "user", ""), (1, 3, None, "b"), (2, 0, "user", None)]
    got = {r.conv_id: r.ids for r in chat.encode_chat(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), ids_of).collect()}
    bos, user, assistant = (SPECIAL_IDS[n] for n in ("bos", "user", "assistant"))
    assert got == {1: [bos, user, 263, assistant, user, 264, assistant], 2: [bos, user, assistant]}
