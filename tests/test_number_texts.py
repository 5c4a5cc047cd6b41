"""Numbers as texts, against Python's own exact rounding."""

import math
import random

import pytest

from tokenloom.functions.numbers import with_fixed, with_scientific
from tokenloom.sources.run_logs import METRICS_FORMATS, format_metrics

SPECIAL = [None, 0.0, -0.0, float("nan"), float("inf"), -float("inf")]


def _values():
    rng = random.Random(3)
    made = [0.125, 0.375, 2.5, 0.145, 1.005, 0.5, 0.05, 0.25, 0.0000005, 0.0000015, 0.9999995, 0.99999949, 9.99999999, 1e-300, -1e-9]
    made += [float(2**k) + d for k in (20, 45, 51, 52, 53, 61, 62, 63, 64, 70, 90, 111) for d in (0.0, 0.25)]
    made += [(2 * rng.randrange(1 << 20) + 1) / 2**k for k in range(1, 21) for _ in range(10)]  # ties of all kinds
    made += [rng.randrange(10**7) / 10 ** rng.randrange(9) for _ in range(500)]
    made += [(rng.randrange(10**6) + 0.5) / 10 ** rng.randrange(8) for _ in range(500)]
    made += [math.nextafter(v, rng.choice([0, 1e9])) for v in made[-500:]]
    made += [rng.uniform(-1, 1) * 10 ** rng.randrange(-12, 16) for _ in range(1000)]
    return made + [-v for v in made[:60]]


@pytest.mark.parametrize("digits", [1, 4, 6])
def test_fixed(spark, digits):
    values = _values() + SPECIAL
    rows = spark.createDataFrame(list(enumerate(values)), "i long, x double")
    found = {r.i: r.t for r in with_fixed(rows, {"x": digits}).withColumnRenamed("x", "t").collect()}
    for i, v in enumerate(values):
        assert found[i] == (None if v is None else format(v, f".{digits}f")), v


@pytest.mark.parametrize("digits", [2, 3])
def test_scientific(spark, digits):
    rng = random.Random(4)
    values = [v for v in _values() if abs(v) < 1e18 and abs(v) > 1e-18] + SPECIAL + [1e-5, 9.995e-5, 9.9949e-5, 1e-4, 9.995, 99.95, 999.5, 1e17]
    values += [rng.randrange(10**5) / 10 ** rng.randrange(15) for _ in range(1000)]
    values += [(rng.randrange(100, 1000) + 0.5) * 10.0**p for p in range(-14, 15) for _ in range(20)]
    values += [float(2**k) for k in range(-55, 58)] + [5e-300, 3e200]
    rows = spark.createDataFrame(list(enumerate(values)), "i long, x double")
    found = {r.i: r.t for r in with_scientific(rows, "x", digits, "t").select("i", "t").collect()}
    for i, v in enumerate(values):
        assert found[i] == (None if v is None else format(v, f".{digits}e")), v


def test_log_rows_need_no_python_worker(spark):
    values = [None, 1.5e-4, 0.0, 3.14159265]
    columns = ", ".join(f"x as {name}" for name in METRICS_FORMATS)
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "step long, x double")
    shown = format_metrics(rows.selectExpr("'r' as run", "step", "cast(0 as timestamp) as timestamp", *columns.split(", ")))
    plan = shown._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    for r in shown.collect():
        v = values[int(r.step)]
        for name, spec in METRICS_FORMATS.items():
            assert r[name] == ("" if v is None else format(v, spec))
