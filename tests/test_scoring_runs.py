import json
import math

import pytest
from pyspark.sql import functions as F

from tokenloom.operators import chat, runs, scoring
from tokenloom.sources import run_logs


def cands(spark, *rows):
    data = [(r, t, float(x)) for r, row in enumerate(rows) for t, x in enumerate(row)]
    return spark.createDataFrame(data, "row_id long, token_id int, logit double")


def kept(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.row_id, set()).add(r.token_id)
    return out


def test_top_k_keeps_ties(spark):
    c = cands(spark, [1, 3, 2, 2], [5, 4, 3, 2])
    assert kept(scoring.top_k(c, 2)) == {0: {1, 2, 3}, 1: {0, 1}}
    assert kept(scoring.top_k(c, 99)) == kept(scoring.top_k(c, 0)) == kept(c)


def test_top_p_keeps_the_first_and_drops_after_the_mass(spark):
    probs = [0.7, 0.2, 0.06, 0.04]
    c = cands(spark, [math.log(p) for p in probs])
    assert kept(scoring.top_p(c, 0.5)) == {0: {0}}
    assert kept(scoring.top_p(c, 0.75)) == {0: {0, 1}}
    assert kept(scoring.top_p(c, 0.95)) == {0: {0, 1, 2}}
    assert kept(scoring.top_p(c, 1.0)) == kept(c)


def test_penalty_and_temperature(spark):
    c = cands(spark, [2, -2, 1])
    seen = spark.createDataFrame([(0, 0), (0, 0), (0, 1), (7, 2)], "row_id long, token_id int")
    got = {r.token_id: r.logit for r in scoring.repetition_penalty(c, seen, 2.0).collect()}
    assert got == {0: 1.0, 1: -4.0, 2: 1.0}
    assert kept(scoring.temperature(cands(spark, [1, 5, 5]), 0)) == {0: {1}}
    assert {r.logit for r in scoring.temperature(c, 0.5).collect()} == {4.0, -4.0, 2.0}


def test_sample_follows_the_distribution(spark):
    rows = spark.range(20_000).select(F.col("id").alias("row_id"), F.array(F.lit(math.log(0.7)), F.lit(math.log(0.3))).alias("logits"))
    drawn = scoring.sample(scoring.candidates(rows), 1)
    share = drawn.where("token_id = 0").count() / 20_000
    assert abs(share - 0.7) < 0.02
    assert sorted(drawn.collect()) == sorted(scoring.sample(scoring.candidates(rows), 1).collect())


def test_loss_and_evaluate(spark):
    rows = spark.createDataFrame([([1000.0, 1000.0], 0), ([0.0, math.log(3)], 1)], "logits array<double>, target int")
    row = scoring.cross_entropy(rows).first()
    assert row.loss == pytest.approx((math.log(2) + math.log(4 / 3)) / 2)
    scored = spark.createDataFrame([(0, 1.0), (0, 3.0), (1, 4.0), (2, 99.0)], "batch_no long, loss double")
    assert scoring.evaluate(scored, 2).first().val_loss == 3.0
    assert scoring.evaluate(scored.where("false")).first().val_loss == 0.0


def test_prompts_stops_and_responses(spark):
    df = spark.createDataFrame([([1, 2, 3, 4],), ([1, 2],), ([],)], "ids array<int>")
    got = [(r.ids, r.truncated) for r in scoring.truncate_prompts(df, 4).collect()]
    assert got == [([2, 3, 4], True), ([1, 2], False), ([], False)]
    df = spark.createDataFrame([([9, 8, 3, 7],), ([5, 4, 9],), ([9],), ([3],)], "ids array<int>")
    assert [r.ids for r in scoring.cut_at_stop(df, [4]).collect()] == [[9, 8], [5], [9], []]
    df = spark.createDataFrame([("abcdef", "abc"), ("é😀x", "é😀"), ("same", "same")], "full string, prompt string")
    assert [r.response for r in scoring.extract_response(df).collect()] == ["def", "x", ""]


def test_chat(spark):
    rows = [(1, 1, "user", "7"), (1, 0, "system", "5 6"), (1, 2, "tool", "9"), (2, 0, None, None)]
    messages = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    ids = lambda text: F.transform(F.split(F.coalesce(text, F.lit("0")), " "), lambda x: x.cast("int"))
    got = {r.conv_id: r.ids for r in chat.encode_chat(messages, ids).collect()}
    assert got == {1: [2, 6, 5, 6, 4, 7, 9, 5], 2: [2, 0, 5]}
    assert {r.conv_id: r.ids[-1] for r in chat.encode_chat(messages, ids, False).collect()} == {1: 9, 2: 0}
    got = {r.conv_id: r.prompt for r in chat.render_chat(messages).collect()}
    assert got == {
        1: "<|system|>\n5 6\n<|user|>\n7\n<|tool|>\n9\n<|assistant|>\n",
        2: "<|user|>\n\n<|assistant|>\n",
    }


def judge(values, patience, delta):
    best, counter, out = math.inf, 0, {"n": 0, "stop": None, "step": None}
    for step, v in enumerate(values):
        if v < best - delta:
            best, counter = v, 0
            out.update(n=out["n"] + 1, step=step, loss=v)
        else:
            counter += 1
        if counter >= patience:
            out["stop"] = step
            break
    return out["step"], out.get("loss"), out["n"], out["stop"]


def test_early_stopping(spark, monkeypatch):
    monkeypatch.setattr(runs, "STEPS_PER_BLOCK", 7)
    import random

    rng = random.Random(3)
    series = {
        0: [1.0, 0.9995, 0.9987, 0.9984],
        1: [5 - 0.0004 * i for i in range(200)],  # every value is a new low; one run holds most rows
        2: [rng.random() for _ in range(60)],
        3: [float("nan"), float("nan"), 3.0, 2.0],
        4: [math.inf] * 4,
        5: [rng.random() - 0.01 * i for i in range(60)],
    }
    rows = [(r, s, v) for r, values in series.items() for s, v in enumerate(values)]
    df = spark.createDataFrame(rows, "run long, step long, val_loss double").repartition(5)
    for patience in (1, 3, 10):
        got = {
            r.run: (r.best_step, r.best_loss, r.n_accepted, r.stop_step)
            for r in runs.early_stopping(df, patience, 0.001).collect()
        }
        assert got == {r: judge(v, patience, 0.001) for r, v in series.items()}


def test_streaming_early_stopping_equals_batch(spark, tmp_path):
    from tokenloom.streaming.early_stop import stream_early_stopping

    values = [3.0, 2.0, 2.5, 1.0, 1.5, 1.2, 1.1, 0.2]
    source, target, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    evals = spark.createDataFrame([(0, i, v) for i, v in enumerate(values)], "run long, step long, val_loss double")
    for lo in (0, 3, 6):  # three micro-batches, each started on its own
        evals.where(f"step >= {lo} and step < {lo + 3}").coalesce(1).write.mode("append").parquet(source)
        query = (
            stream_early_stopping(spark.readStream.schema(evals.schema).parquet(source), 3, 0.001)
            .writeStream.option("checkpointLocation", state).trigger(availableNow=True).format("parquet").start(target)
        )
        query.awaitTermination()
        assert query.exception() is None
    last = spark.read.parquet(target).orderBy(F.desc("step")).first()
    assert (last.best_step, last.best_loss, last.stopped, last.step) == (3, 1.0, True, 6)
    batch = runs.early_stopping(evals, 3, 0.001).first()
    assert (batch.best_step, batch.best_loss, batch.stop_step) == (3, 1.0, 6)


def test_best_and_retention(spark):
    saves = [(0, 500, 3.0), (0, 1000, 2.0), (0, 10000, 2.5), (0, 2000, 2.0), (0, 3000, 2.4), (1, 5, 1.0)]
    df = spark.createDataFrame(saves, "run long, step long, val_loss double")
    got = {(r.run, r.step): (r.is_best, r.kept) for r in runs.retention(df, 3).collect()}
    assert got == {
        (0, 500): (True, False), (0, 1000): (True, True), (0, 2000): (False, True),
        (0, 3000): (False, True), (0, 10000): (False, True), (1, 5): (True, True),
    }


def test_reports(spark):
    rows = [(0, s, 100, 100.0 if s < 3 else 2.0 + s % 2) for s in range(13)]
    df = spark.createDataFrame(rows, "run long, step long, tokens long, seconds double")
    log = runs.throughput(df, 5).orderBy("step").collect()
    assert [(r.step, r.tokens) for r in log] == [(5, 500), (10, 500)]
    assert log[0].tokens_per_sec == 500 / (300 + 3 + 2)
    report = runs.step_time_report(df, 1000, 800)
    row = report.first()
    assert (row.avg_step_time, row.min_step_time, row.max_step_time) == (2.5, 2.0, 3.0)
    assert (row.avg_tokens_per_sec, row.est_seconds, row.total_tokens) == (320.0, 2500.0, 800_000)
    cost = {r.offer: r.cloud_cost for r in runs.cloud_cost(report).collect()}
    assert len(cost) == 4 and cost["H100 (GCP)"] == pytest.approx(2500 / 3600 / 50 * 3.5)


def test_metrics_log(spark, tmp_path):
    from datetime import datetime

    at = datetime(2024, 1, 2, 3, 4, 5, 678)
    rows = [("r1", 10, at, 1.23456789, None, 3e-4, 12345.25, 0.5), ("r1", 20, at, None, 0.1, None, None, None)]
    df = spark.createDataFrame(
        rows, "run string, step long, timestamp timestamp, train_loss double, val_loss double, learning_rate double, tokens_per_sec double, grad_norm double"
    )
    text = [tuple(r) for r in run_logs.format_metrics(df).orderBy("step").collect()]
    assert text[0] == ("r1", "10", "2024-01-02T03:04:05.000678", "1.234568", "", "3.00e-04", "12345.2", "0.5000")
    run_logs.append_metrics(df.where("step = 10"), str(tmp_path / "log"))
    run_logs.append_metrics(df.where("step = 20"), str(tmp_path / "log"))
    back = run_logs.read_metrics(spark, str(tmp_path / "log")).orderBy("step").collect()
    assert [(r.run, r.step, r.timestamp, r.train_loss, r.val_loss) for r in back] == [
        ("r1", 10, at, 1.234568, None), ("r1", 20, at, None, 0.1)
    ]
    (tmp_path / "flat").mkdir()
    (tmp_path / "flat" / "20240101_000000.csv").write_text(
        "step,timestamp,train_loss,val_loss,learning_rate,tokens_per_sec,grad_norm\n5,2024-01-01T00:00:00.5,2.5,,1.00e-05,,\n"
    )
    row = run_logs.read_metrics(spark, str(tmp_path / "flat")).first()
    assert (row.run, row.step, row.train_loss, row.val_loss, row.learning_rate) == ("20240101_000000", 5, 2.5, None, 1e-5)


def test_manifests(spark, tmp_path):
    model = dict(vocab_size=32000, embedding_dim=768, num_layers=12, num_heads=12, ff_dim=2048, context_length=1024, dropout=0.0, rope_theta=1e4, extra=1)
    for step in (500, 10000):
        folder = tmp_path / "ck" / f"step_{step}"
        folder.mkdir(parents=True)
        text = json.dumps({"model": model, "training": {"batch_size": 2}, "step": step, "val_loss": 1.5}, indent=2)
        (folder / "config.json").write_text(text)
    rows = run_logs.read_checkpoints(spark, str(tmp_path)).orderBy("step").collect()
    assert [(r.run, r.step, r.estimated_params) for r in rows] == [("ck", 500, 109_529_856), ("ck", 10000, 109_529_856)]
    assert rows[0].estimated_params_no_norms == 109_529_856 - 12 * 2 * 768 - 768


def test_many_runs_share_few_logs(spark, tmp_path):
    from tokenloom.streaming.files import stream_metrics_sink

    names = ["a b", "x/y=1,2", 'q"\n%41', "é"]
    columns = "run string, step long, timestamp timestamp, train_loss double, val_loss double, learning_rate double, tokens_per_sec double, grad_norm double"
    data = [(f"r{i}" if i >= len(names) else names[i], i, None, i / 4, None, None, None, None) for i in range(300)]
    df = spark.createDataFrame([*data, (None, 300, None, 75.0, None, None, None, None)], columns)
    run_logs.append_metrics(df.where("step < 150"), str(tmp_path / "log"))
    run_logs.append_metrics(df.where("step >= 150"), str(tmp_path / "log"))
    df.write.parquet(str(tmp_path / "in"))
    rows = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    query = stream_metrics_sink(rows, str(tmp_path / "sink"), str(tmp_path / "state"))
    query.awaitTermination()
    assert query.exception() is None
    want = {r[1]: (r[0], r[3]) for r in data} | {300: ("__HIVE_DEFAULT_PARTITION__", 75.0)}
    for place in ("log", "sink"):
        assert len(list((tmp_path / place).rglob("*.csv"))) <= 2 * 8
        back = run_logs.read_metrics(spark, str(tmp_path / place))
        assert back.columns == ["run", *[c.split()[0] for c in run_logs.METRICS_SCHEMA.split(", ")]]
        got = back.collect()
        assert len(got) == 301 and {r.step: (r.run, r.train_loss) for r in got} == want


def test_manifests_are_packed(spark, tmp_path):
    rows = spark.range(200).selectExpr(
        "case when id = 7 then 'x/y=1' when id = 8 then null else cast(id as string) end as run", "concat('step_', id) as ckpt",
        "named_struct('vocab_size', 1000, 'embedding_dim', 64, 'num_layers', id, 'ff_dim', 256, 'unknown', 1) as model", "id as step", "id / 2 as val_loss",
    )
    run_logs.write_checkpoints(rows.coalesce(2), str(tmp_path / "ck"))
    (tmp_path / "ck" / "alone" / "step_500").mkdir(parents=True)
    (tmp_path / "ck" / "alone" / "step_500" / "config.json").write_text('{\n"step": 500, "val_loss": 1.5}')
    assert len([f for f in (tmp_path / "ck").rglob("*.json*") if not f.name.startswith(".")]) == 3
    got = {r.step: (r.run, r.val_loss) for r in run_logs.read_checkpoints(spark, str(tmp_path / "ck")).collect()}
    assert len(got) == 201 and got[500] == ("alone", 1.5)
    assert got[7] == ("x/y=1", 3.5) and got[8] == ("__HIVE_DEFAULT_PARTITION__", 4.0) and got[199] == ("199", 99.5)
