"""Vector searches against brute force."""

import numpy as np
from pyspark.sql import functions as F

from tokenloom.llm import exact_topk, onebit_ann

SCHEMA = "vec_id long, embedding array<float>, vector string, g int, score string"


def _table(spark, rows):
    return spark.createDataFrame([(i, v, "x", 1, "s") for i, v in rows], SCHEMA)


def _clustered(n, dims, seed):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(20, dims))
    vectors = (centres[rng.integers(0, 20, n)] + 0.4 * rng.normal(size=(n, dims))).astype(np.float32)
    return [(i, [float(x) for x in v]) for i, v in enumerate(vectors)]


BAD = [
    (10000, None), (10050, [1.0, None, 2.0]), (10100, [float("nan")] * 8), (10150, [float("inf"), 1.0]), (10200, []), (None, [1.0] * 8),
]


def _exact(rows, chosen, k, scale=256):
    good = [(i, v) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    whole = [(i, [int(np.floor(scale * float(np.float32(x)))) for x in v]) for i, v in good]
    queries = {}
    for i, v in good:
        if chosen(i):
            queries[i] = max(queries.get(i, v), v)
    out = []
    for q, v in queries.items():
        v = [int(np.floor(scale * float(np.float32(x)))) for x in v]
        scored = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in whole if i != q)[:k]
        out += [(q, r + 1, i, max(-(1 << 63), min((1 << 63) - 1, -s))) for r, (s, i) in enumerate(scored)]
    return sorted(out)


def _got(df):
    return sorted((r.query_id, r.rank, r.vec_id, r.score) for r in df.collect())


def test_exact_top_k_matches_brute_force(spark):
    for dims in (8, 64, 70):
        rows = _clustered(700, dims, dims) + BAD
        found = exact_topk.top_k(_table(spark, rows), F.col("vec_id") % 50 == 0, 5)
        assert _got(found) == _exact(rows, lambda i: i % 50 == 0, 5)


def test_exact_ties_repeats_lengths_and_few_rows(spark):
    rows = [(0, [1.0, 2.0]), (0, [1.0, 2.0]), (1, [3.0]), (2, [3.0, 0.0]), (3, [3.0, 0.0, 9.0]), (3, [3.0, 0.0, 9.0]), (50, [0.0])]
    found = exact_topk.top_k(_table(spark, rows), F.col("vec_id") % 50 == 0, 5)
    assert _got(found) == _exact(rows, lambda i: i % 50 == 0, 5)
    empty = [(0, []), (7, []), (3, [])]
    assert _got(exact_topk.top_k(_table(spark, empty), F.col("vec_id") == 0, 5)) == [(0, 1, 3, 0), (0, 2, 7, 0)]
    assert exact_topk.top_k(_table(spark, []), F.lit(True), 5).collect() == []
    assert exact_topk.top_k(_table(spark, rows), F.lit(False), 5).collect() == []
    assert exact_topk.top_k(_table(spark, rows[:1]), F.lit(True), 5).collect() == []


def test_exact_large_components(spark):
    rows = [(0, [3e38, -3e38]), (1, [3e38, 1.0]), (2, [-3e38, 3e38]), (3, [5.0, 5.0])]
    found = exact_topk.top_k(_table(spark, rows), F.col("vec_id") == 0, 5)
    assert _got(found) == _exact(rows, lambda i: i == 0, 5)


def test_pruning_keeps_the_best_and_drops_rows():
    rng = np.random.default_rng(0)
    vectors = np.floor(256 * rng.normal(size=(3000, 48)) * (np.arange(48, 0, -1) / 8))
    held = exact_topk.Vertical(vectors, np.arange(3000), block=8)
    for q in range(0, 3000, 300):
        ids, scores = held.top(vectors[q], q, 5)
        want = vectors @ vectors[q]
        want[q] = -np.inf
        order = np.lexsort((np.arange(3000), -want))[:5]
        assert ids.tolist() == order.tolist() and scores.tolist() == want[order].tolist()


def _recall(rows, found, chosen, k):
    usable = [(i, v) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    ids, vectors = np.array([i for i, _ in usable]), np.array([v for _, v in usable], np.float64)
    got = {}
    for r in found:
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    hits = total = 0
    for q in ids[[chosen(i) for i in ids]]:
        scores = vectors @ vectors[ids == q][0]
        others = np.flatnonzero(ids != q)
        want = others[np.lexsort((ids[others], -scores[others]))][:k]
        mine = sorted(got[q])
        assert [r for r, _, _ in mine] == list(range(1, len(want) + 1))
        for _, i, s in mine:
            assert abs(s - scores[ids == i][0]) < 1e-9
        assert all((-a[2], a[1]) < (-b[2], b[1]) for a, b in zip(mine, mine[1:]))
        hits += len({int(ids[w]) for w in want} & {i for _, i, _ in mine})
        total += len(want)
    return hits / total


def test_nearest_recall_on_random_and_clustered_vectors(spark):
    rng = np.random.default_rng(4)
    spread = rng.normal(size=(4000, 64)).astype(np.float32)
    spread /= np.linalg.norm(spread, axis=1, keepdims=True)
    for rows in ([(i, [float(x) for x in v]) for i, v in enumerate(spread)], _clustered(2000, 96, 6)):
        rows = rows + BAD + [(10250, [0.0] * len(rows[0][1]))]
        found = onebit_ann.nearest(_table(spark, rows), F.col("vec_id") % 50 == 0, 20).collect()
        assert {r.query_id for r in found} == {i for i in range(len(rows) - len(BAD) - 1) if i % 50 == 0}
        assert _recall(rows, found, lambda i: i % 50 == 0, 20) >= 0.95


def test_nearest_ties_repeats_and_few_rows(spark):
    one = [1.0] * 8
    rows = [(0, one), (0, one), (7, one), (5, one), (5, one), (9, [-1.0] * 8), (20, [1.0, 0.0]), (3, [0.0] * 8)]
    got = _got(onebit_ann.nearest(_table(spark, rows), F.col("vec_id") == 0, 20))
    assert got == [(0, 1, 5, 8.0), (0, 2, 5, 8.0), (0, 3, 7, 8.0), (0, 4, 20, 1.0), (0, 5, 9, -8.0)]
    assert onebit_ann.nearest(_table(spark, []), F.lit(True), 20).collect() == []
    assert onebit_ann.nearest(_table(spark, [(3, [0.0])]), F.lit(True), 20).collect() == []
    assert onebit_ann.nearest(_table(spark, rows[:1]), F.lit(True), 20).collect() == []


def test_estimates_stay_within_their_bounds():
    rng = np.random.default_rng(8)
    vectors = rng.normal(size=(3000, 64))
    rotation = onebit_ann.Rotation(vectors.mean(axis=0))
    import pyarrow as pa

    codes, length, fit, to_centre = rotation.encode(vectors)
    table = pa.table({
        "vec_id": range(3000), "code": pa.array([c.tobytes() for c in codes], pa.binary()), "length": length, "fit": fit,
        "to_centre": to_centre, "vector": pa.array(list(vectors), pa.list_(pa.float64())),
    })
    held = onebit_ann.Codes(rotation, table)
    assert codes.shape == (3000, 1) and codes.dtype == np.dtype("<u8")
    inside = []
    for q in vectors[:50]:
        estimate, error = held.estimate(q)
        inside.append((np.abs(estimate - vectors @ q) <= error).mean())
    assert np.mean(inside) > 0.95
