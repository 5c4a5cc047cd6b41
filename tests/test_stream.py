import os
import struct

import numpy as np
import pytest
from pyspark.sql import DataFrameWriter
from pyspark.sql import functions as F

from tokenloom.functions.positions import range_block, running_before, running_min_before
from tokenloom.operators import packing, stream
from tokenloom.plans.steps import step_plan, training_totals
from tokenloom.session import work_path
from tokenloom.sources import token_bin

SCHEMA = "doc_id long, ids array<int>, n_tokens long, start_pos long"


def make(spark, sizes):
    rows, pos = [], 0
    for i, n in enumerate(sizes):
        rows.append((i, list(range(pos, pos + n)), n, pos))
        pos += n
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture
def twenty(spark):
    return make(spark, [7, 1, 12])


def number_ids(text):
    """A stand-in encoder: texts of numbers."""
    return F.transform(F.split(text, " "), lambda x: x.cast("int"))


@pytest.mark.parametrize("per_block, n", [(3, 8), (50, 1), (50, 31), (100_000, 8)])
def test_positions_do_not_depend_on_partitions(spark, partitions, n, per_block):
    partitions(n)
    rng = np.random.default_rng(1)
    keys = sorted(set(rng.integers(0, 10**12, 150).tolist()) | set(range(150)))  # half of the keys sit together
    texts = [(k, " ".join(str(x) for x in rng.integers(0, 60000, rng.integers(1, 30)))) for k in keys]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(7)
    path = work_path(spark, "stream")
    stream.write_stream(docs, number_ids, path, add_eos=True, rows_per_block=per_block)
    pos = 0
    for row, (key, text) in zip(stream.read_stream(spark, path).orderBy("start_pos").collect(), texts):
        ids = [int(x) for x in text.split()] + [3]
        assert (row.doc_id, row.start_pos, row.ids, row.n_tokens) == (key, pos, ids, len(ids))
        pos += len(ids)
    assert stream.stream_total(spark, path) == pos
    some = stream.read_stream(spark, path, pos // 3, pos // 3 + 5).collect()
    whole = stream.read_stream(spark, path).collect()
    assert sorted(some) == sorted(r for r in whole if r.start_pos < pos // 3 + 5 and r.start_pos + r.n_tokens > pos // 3)
    assert stream.read_stream(spark, path, pos + 1, pos + 2).count() == 0


def test_blocks_grow_with_the_key(spark):
    df = spark.range(1000).select((F.col("id") * F.col("id")).alias("k"))
    block, n = range_block(df, "k", rows_per_block=10)
    got = [r.b for r in df.select("k", block.alias("b")).orderBy("k").collect()]
    assert got == sorted(got) and got[0] == 0 and got[-1] == n - 1 and n > 50


def test_running_values_with_a_hot_group(spark):
    rows = [("hot" if i % 3 else f"g{i % 5}", i // 7, i, (i * 37) % 101) for i in range(300)]
    df = spark.createDataFrame(rows, "g string, b long, o long, v long")
    sums = running_before(df, "s", F.col("v"), "b", ["o"], within=["g"])
    lows = running_min_before(df, "m", F.col("v"), "b", ["o"], within=["g"])
    want_s, want_m, s, m = {}, {}, {}, {}
    for g, _, o, v in rows:
        want_s[o], want_m[o] = s.get(g, 0), m.get(g)
        s[g], m[g] = s.get(g, 0) + v, min(v, m.get(g, v))
    assert {r.o: r.s for r in sums.collect()} == want_s
    assert {r.o: r.m for r in lows.collect()} == want_m


def test_pack(spark, twenty):
    got = {r.seq_idx: r.tokens for r in packing.pack_disjoint(twenty, 4).collect()}
    assert got == {i: list(range(5 * i, 5 * i + 5)) for i in range(4)}
    got = {r.seq_idx: r.tokens for r in packing.pack_overlap(twenty, 4).collect()}
    assert got == {i: list(range(4 * i, 4 * i + 5)) for i in range(4)}


@pytest.mark.parametrize("sizes", [[1] * 40, [40], [5, 0, 0, 5, 13, 2], [3], [0], [100, 1, 1, 250]])
@pytest.mark.parametrize("context", [1, 4])
def test_pack_any_documents(spark, sizes, context):
    n, width = sum(sizes), context + 1
    rows = make(spark, sizes)
    got = {r.seq_idx: r.tokens for r in packing.pack_disjoint(rows, context).collect()}
    assert got == {i: list(range(i * width, i * width + width)) for i in range(n // width)}
    got = {r.seq_idx: r.tokens for r in packing.pack_overlap(rows, context, n).collect()}
    assert got == {i: list(range(i * context, i * context + width)) for i in range(max((n - 1) // context, 0))}


def test_shift(spark, twenty):
    row = packing.shift_targets(packing.pack_disjoint(twenty, 4)).orderBy("seq_idx").first()
    assert (row.input_ids, row.target_ids) == ([0, 1, 2, 3], [1, 2, 3, 4])


@pytest.mark.parametrize("ratio", [0.0, 0.3, 1.0])
def test_split(spark, twenty, ratio):
    val = int(20 * ratio)
    parts = stream.split(twenty, ratio)
    for name, want in (("train", list(range(20 - val))), ("val", list(range(20 - val, 20)))):
        both = parts.where(F.col("split") == name).drop("split"), stream.split_part(twenty, ratio, name, 20)
        for part in both:
            rows = part.orderBy("start_pos").collect()
            assert [i for r in rows for i in r.ids] == want
            assert [r.start_pos for r in rows] == [sum(x.n_tokens for x in rows[:k]) for k in range(len(rows))]
            assert all(len(r.ids) == r.n_tokens for r in rows)


def test_slices_match_python(spark, monkeypatch):
    monkeypatch.setattr(stream, "SPAN", 8)
    n = 60
    rows = make(spark, [7, 1, 12, 40])
    asked = [
        (start, stop, step)
        for start in (None, -70, -60, -5, 0, 3, 59, 60, 90)
        for stop in (None, -61, -1, 0, 13, 60, 99)
        for step in (None, 1, 2, 7, -1, -3)
    ]
    requests = spark.createDataFrame(
        [(i, *a) for i, a in enumerate(asked)], "request_id long, start long, stop long, step long"
    )
    got = {r.request_id: r.ids for r in stream.token_slices(rows, requests).collect()}
    assert got == {i: list(range(n))[a[0] : a[1] : a[2]] for i, a in enumerate(asked)}


def test_token_at_and_chunks(spark, monkeypatch):
    monkeypatch.setattr(stream, "SPAN", 8)
    rows = make(spark, [7, 1, 12, 40])
    where = [0, 59, 60, -1, -60, -61, 8]
    requests = spark.createDataFrame(list(enumerate(where)), "request_id long, pos long")
    got = {r.pos: (r.token_id, r.error) for r in stream.token_at(rows, requests).collect()}
    bad = (None, "out of range")
    assert got == {0: (0, None), 59: (59, None), 60: bad, -1: (59, None), -60: (0, None), -61: bad, 8: (8, None)}
    asked = [(0, 0, 60), (1, 5, 20), (2, 50, 11), (3, -1, 3), (4, 60, 0), (5, 10, 0)]
    requests = spark.createDataFrame(asked, "request_id long, start long, length long")
    got = {r.request_id: (r.ids, r.error) for r in stream.get_chunk(rows, requests).collect()}
    assert got == {
        0: (list(range(60)), None), 1: (list(range(5, 25)), None), 2: bad, 3: bad, 4: ([], None), 5: ([], None)
    }


def test_shuffle_is_a_seeded_permutation(spark):
    seqs = packing.pack_disjoint(make(spark, [300]), 2)
    orders = {
        (epoch, each): [r.seq_idx for r in packing.shuffle(seqs, 42, epoch, each).orderBy("rank").collect()]
        for epoch in (0, 1) for each in (False, True)
    }
    assert all(sorted(o) == list(range(100)) for o in orders.values())
    assert orders[0, False] == orders[1, False] == orders[0, True] != orders[1, True]


def test_permutation_over_many_blocks(spark, monkeypatch):
    numbers = spark.range(2000).withColumnRenamed("id", "seq_idx")
    one = packing.permutation(numbers, 7).collect()
    monkeypatch.setattr(packing, "_ROWS_PER_BLOCK", 3)
    assert sorted(packing.permutation(numbers, 7).collect()) == sorted(one)
    assert sorted(r.rank for r in one) == list(range(2000))


@pytest.mark.parametrize("drop_last", [True, False])
def test_batches(spark, drop_last):
    seqs = packing.in_order(packing.pack_disjoint(make(spark, [22]), 1))
    rows = packing.batches(seqs, 4, 11, drop_last).orderBy("batch_no", "slot").collect()
    assert [(r.batch_no, r.slot, r.seq_idx) for r in rows] == [(i // 4, i % 4, i) for i in range(8 if drop_last else 11)]


def test_get_batch_and_loaders(spark):
    rows = make(spark, [13, 30, 57])
    batch = packing.get_batch(packing.pack_disjoint(rows, 4), 2, 3).orderBy("slot").collect()
    assert [(r.slot, r.input_ids[0], r.target_ids[-1]) for r in batch] == [(i, 5 * (6 + i), 5 * (6 + i) + 4) for i in range(3)]
    parts = [stream.split_part(rows, 0.25, n) for n in ("train", "val")]
    out = packing.loaders(*parts, context_length=4, batch_size=2).collect()
    train = {r.seq_idx for r in out if r.split == "train"}
    val = sorted((r.batch_no, r.slot, r.seq_idx) for r in out if r.split == "val")
    assert len(train) == 14 and val == [(i // 2, i % 2, i) for i in range(4)]


def test_stats_and_check(spark, twenty):
    row = stream.dataset_stats(twenty, 4).first()
    assert (row.total_tokens, row.num_sequences, row.epochs_per_step_4) == (20, 4, 1.0)
    assert row.file_size_mb == 56 / 2**20
    assert stream.dataset_stats(twenty, 50).first().epochs_per_step_1 == 0.0
    bad = spark.createDataFrame([(0, [1, 70000, -1]), (1, [5])], "doc_id long, ids array<int>")
    assert [tuple(r) for r in stream.check_ids(bad, 6).collect()] == [(0, 2, 1)]


def test_step_plan(spark):
    rows = step_plan(spark, 3, 2, 8, 6, accumulation_steps=2, peak=1.0, warmup_steps=2).orderBy("step", "micro_step").collect()
    assert [(r.epoch, r.batch_no) for r in rows] == [(i // 3, i % 3) for i in range(12)]
    assert [r.learning_rate for r in rows[::2]][:3] == [0.0, 0.5, 1.0]
    assert rows[-1].tokens_seen == 12 * 16
    resumed = step_plan(spark, 3, 2, 8, 6, accumulation_steps=2, start_step=4).orderBy("step", "micro_step").collect()
    assert [(r.step, r.batch_no) for r in resumed] == [(4, 0), (4, 1), (5, 2), (5, 0)]
    assert training_totals(4, 8, 2048, 100_000)["total_tokens"] == 6_553_600_000


@pytest.mark.parametrize("header", [True, False])
def test_token_store_round_trip(spark, header):
    rows = make(spark, [7, 0, 1, 12, 40])
    path = work_path(spark, "bin")
    token_bin.write_tokens(rows, path, header=header, tokens_per_shard=25)
    blocks = token_bin.read_tokens(spark, path, header=header)
    got = sorted((r.start_pos, r.ids) for r in blocks.collect())
    assert [i for _, ids in got for i in ids] == list(range(60))
    packed = packing.pack_disjoint(token_bin.as_stream(blocks), 9)
    assert sorted(r.tokens[0] for r in packed.collect()) == [0, 10, 20, 30, 40, 50]
    with pytest.raises(Exception):
        token_bin.write_tokens(rows, path, header=header)
    single = work_path(spark, "bin")
    token_bin.write_tokens(rows, single, header=header, tokens_per_shard=None)
    files = [f for f in os.listdir(single.removeprefix("file://")) if f.endswith(".bin")]
    assert len(files) == 1
    whole = open(os.path.join(single.removeprefix("file://"), files[0]), "rb").read()
    head = struct.pack("<QQ", 0x544F4B454E53, 60) if header else b""
    assert whole == head + np.arange(60, dtype="<u2").tobytes()


def test_token_store_refuses_gaps_and_damage(spark):
    rows = make(spark, [7, 0, 1, 12, 40])
    for broken in (rows.where("doc_id <> 2"), rows.unionByName(rows.where("doc_id = 3"))):
        with pytest.raises(Exception, match="gap|cover"):
            token_bin.write_tokens(broken, work_path(spark, "bin"), tokens_per_shard=25)
    path = work_path(spark, "bin")
    token_bin.write_tokens(rows, path, tokens_per_shard=25)
    folder = path.removeprefix("file://")
    shard = next(f for f in os.listdir(folder) if f.startswith("part-000001"))
    with open(os.path.join(folder, shard), "r+b") as file:
        file.truncate(30)
    with pytest.raises(Exception, match="size"):
        token_bin.read_tokens(spark, path).count()


def test_single_token_files(spark, tmp_path):
    ids = np.array([1, 65535, 0, 40000], "<u2").tobytes()
    (tmp_path / "h.bin").write_bytes(struct.pack("<QQ", 0x544F4B454E53, 4) + ids)
    (tmp_path / "n.bin").write_bytes(ids)
    (tmp_path / "bad.bin").write_bytes(struct.pack("<QQ", 1, 4) + ids)
    (tmp_path / "zero.bin").write_bytes(struct.pack("<QQ", 0x544F4B454E53, 0))
    for name, header in (("h.bin", True), ("n.bin", False)):
        assert token_bin.read_tokens(spark, str(tmp_path / name), header).first().ids == [1, 65535, 0, 40000]
    assert token_bin.read_tokens(spark, str(tmp_path / "zero.bin")).count() == 0
    with pytest.raises(Exception, match="not a token file"):
        token_bin.read_tokens(spark, str(tmp_path / "bad.bin")).collect()
    (tmp_path / "short.bin").write_bytes(struct.pack("<QQ", 0x544F4B454E53, 100) + ids)
    (tmp_path / "odd.bin").write_bytes(ids + b"x")
    with pytest.raises(Exception, match="says it holds"):
        token_bin.read_tokens(spark, str(tmp_path / "short.bin")).collect()
    with pytest.raises(Exception, match="whole ids"):
        token_bin.read_tokens(spark, str(tmp_path / "odd.bin"), False).collect()


def test_token_store_refuses_wide_ids(spark):
    rows = spark.createDataFrame([(0, [70000], 1, 0)], SCHEMA)
    with pytest.raises(Exception, match="16 bits"):
        token_bin.write_tokens(rows, work_path(spark, "bin"))


def test_stream_shuffles_texts_alone(spark, monkeypatch):
    import pyarrow as pa

    from tokenloom.session import work_path

    seen = []
    writer = DataFrameWriter.parquet
    monkeypatch.setattr(DataFrameWriter, "parquet", lambda self, *a, **k: (seen.append(self._df), writer(self, *a, **k))[1])
    texts = [None if i % 9 == 0 else "x" * (i % 5) for i in range(300)]
    docs = spark.createDataFrame([(i // 2, t) for i, t in enumerate(texts)], "doc_id long, text string")
    path = work_path(spark, "stream")
    stream.write_stream(docs, lambda t: F.array_repeat(F.lit(5), F.length(t)), path, rows_per_block=40)
    monkeypatch.undo()
    plan = seen[0]._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Window" not in plan
    rows = spark.read.parquet(f"{path}/rows").collect()
    assert sum(r.n_tokens or 0 for r in rows) == sum(len(t) + 1 for t in texts if t is not None)
    for block in {r.block for r in rows}:
        held = sorted((r.local_start, r.doc_id, r.n_tokens or 0) for r in rows if r.block == block)
        assert [d for _, d, _ in held] == sorted(d for _, d, _ in held)
        assert [s for s, _, _ in held] == [sum(n for _, _, n in held[:i]) for i in range(len(held))]
    batch = lambda b, n: pa.record_batch([pa.array(b, pa.int32()), pa.array(n, pa.int64())], ["block", "n_tokens"])
    given = [batch([1, 1], [3, None]), batch([1, 2, 2], [4, 5, 6]), batch([], []), batch([2, 7], [1, 2])]
    got = [x for b in stream._with_starts(iter(given)) for x in b.column("local_start").to_pylist()]
    assert got == [0, 3, 3, 0, 5, 11, 0]
