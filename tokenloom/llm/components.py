"""Connected components of an edge table by alternating large-star and small-star rounds.

Every round is two aggregations and two joins on the node, so a node with very many edges is summed
on the map side and its edges may be split by the adaptive join. No component is ever gathered in a
task or on the driver; the driver reads one checksum row per round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tokenloom.session import materialize, remove, work_path


ROWS_PER_FILE = 1 << 19


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node``, ``component`` for every node that has an edge; ``component`` is a node, the same for
    all that reach each other. Of whole-number nodes it is the smallest.

    Nodes may be of any type. Edges with a null end and self loops are left out, repeated edges
    count once, and an empty table gives an empty result.
    """
    pairs = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a is not null and b is not null and a <> b")
    if pairs.schema["a"].dataType.typeName() in ("long", "integer"):
        return _components(pairs.select(F.col("a").cast("long"), F.col("b").cast("long")))
    # other nodes are numbered, as numbers are summed in place; the numbers are written with them
    pairs = materialize(pairs.distinct(), "edges")
    nodes = pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct()
    nodes = materialize(nodes.withColumn("no", F.monotonically_increasing_id()), "nodes")
    left = pairs.join(nodes.select(F.col("node").alias("a"), F.col("no").alias("x")), "a")
    both = left.join(nodes.select(F.col("node").alias("b"), F.col("no").alias("y")), "b")
    found = _components(both.select(F.col("x").alias("a"), F.col("y").alias("b")))
    named = found.join(nodes.select(F.col("no").alias("node"), F.col("node").alias("name")), "node")
    roots = nodes.select(F.col("no").alias("component"), F.col("node").alias("root"))
    return named.join(roots, "component").select(F.col("name").alias("node"), F.col("root").alias("component"))


def _components(pairs: DataFrame) -> DataFrame:
    spark, seen, path = pairs.sparkSession, None, work_path(pairs.sparkSession, "edges")
    pairs.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct().write.parquet(path)
    while True:
        stars = spark.read.schema("u long, v long").parquet(path)
        now = stars.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now[0] == 0 or now == seen:
            break
        seen = now
        files = max(1, -(-now[0] // ROWS_PER_FILE))
        last, path = path, work_path(spark, "edges")
        _small_star(_large_star(stars)).coalesce(files).write.parquet(path)
        remove(spark, last)
    roots = stars.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return stars.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def _large_star(stars: DataFrame) -> DataFrame:
    # every neighbour above a node is tied to the least node around it
    both = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(stars: DataFrame) -> DataFrame:
    # a node and its lower neighbours are tied to the least of them
    least = stars.groupBy("u").agg(F.min("v").alias("m"))
    lower = stars.join(least, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return lower.unionByName(least.select("u", F.col("m").alias("v"))).distinct()
