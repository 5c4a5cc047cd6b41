"""Prefix trie of conversations by a recursion that halves depths, as a van Emde Boas layout does.

Sequences are cut at half depth. What stands before a cut is named: two sequences share a prefix when they
share the prefix up to the block and the block's content, and the name of a shared prefix is the smallest
conversation that has it. The upper trie and the forests below the cuts are cut in the same way, all at
once, so depth ``d`` takes ``log2(d)`` rounds of one grouping and one join, over rows that are prefixes.
Contents of blocks are named from below, two halves at a time.

Totals are grafted upward: at every cut a prefix gets the sum of what lies in the forest below it, and
hands it to its ancestors in the upper trie. Every node and each node under it are parted by one cut, so
all cuts are summed together, and a node's total is its own value and what it is handed.

A conversation of any length is rows, never one row, and a prefix that many share is summed before the
shuffle.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokenloom.functions.positions import running_before
from tokenloom.llm.common import drop_tables, materialize, ship_package

WORD = r"[^\x20\x09-\x0D]+"
BRANCH = 20  # every conversation starts as that whose id is the multiple below it
ENDS = 1 << 12  # ids joined to one text before they are hashed


def numbered(turns: DataFrame) -> DataFrame:
    """``conv``, ``t``, ``role``, ``text`` of all turns, numbered from 1 by turn, nulls first; ties by role and
    text. Null roles and texts are empty; rows without a conversation are left out."""
    rows = turns.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv"),
        F.coalesce(F.col("turn").cast("long"), F.lit(-(1 << 63))).alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    rows = rows.withColumn("block", F.shiftright("turn", 16))  # a long conversation is several blocks
    ahead = running_before(rows, "ahead", F.lit(1), "block", ["turn", "role", "text"], within=["conv"])
    return ahead.select("conv", (F.col("ahead") + 1).alias("t"), "role", "text")


def shared_turns(conv: Column) -> Column:
    """How many turns a conversation takes from the one it branches from."""
    return F.pmod(F.crc32(conv.cast("string").cast("binary")), F.lit(4))


def symbols(turns: DataFrame) -> DataFrame:
    """``conv``, ``t``, ``name`` (of role and text, 128 bits), ``words`` of the text."""
    whole = F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text")
    name = F.unhex(F.substring(F.sha2(whole.cast("binary"), 256), 1, 32))
    return turns.select("conv", "t", name.alias("name"), F.regexp_count("text", F.lit(WORD)).cast("long").alias("words"))


def branched(turns: DataFrame, base: int = BRANCH) -> DataFrame:
    """``turns`` of ``symbols`` with every conversation rebuilt: the first turns of the one at the multiple of
    ``base`` below its id, as many as ``shared_turns`` says, then its own after as many."""
    lengths = turns.groupBy("conv").agg(F.count("*").alias("length"))
    root = (F.col("conv") - F.col("conv") % base).alias("root")
    plans = lengths.select("conv", root, shared_turns(F.col("conv")).alias("h"))
    taken = F.least("h", F.coalesce("root_length", F.lit(0))).alias("taken")
    plans = plans.join(lengths.select(F.col("conv").alias("root"), F.col("length").alias("root_length")), "root", "left")
    plans = plans.select("conv", "root", "h", taken)
    own = turns.join(plans, "conv").where("t > h").select("conv", (F.col("t") - F.col("h") + F.col("taken")).alias("t"), "name", "words")
    firsts = turns.where("t <= 3").withColumnRenamed("conv", "root")
    return own.unionByName(plans.join(firsts, "root").where("t <= taken").select("conv", "t", "name", "words"))


def prefixes(convs: DataFrame, turns: DataFrame, depth: int) -> DataFrame:
    """``conv``, ``p``, ``rep``: for every prefix of length ``p`` of every conversation, the smallest that has it."""
    least = convs.agg(F.min("conv").alias("rep"))
    blocks = [turns.select("conv", (F.col("t") - 1).alias("at"), "name")]
    while 1 << (len(blocks) - 1) < depth:  # contents of full blocks of 1, 2, 4, ... turns
        half, later = F.col("at") / 2, F.col("at") % 2 == 1
        pairs = blocks[-1].groupBy("conv", F.floor(half).alias("at")).agg(
            F.max(F.when(~later, F.col("name"))).alias("a"), F.max(F.when(later, F.col("name"))).alias("b")
        )
        both = pairs.where("a is not null and b is not null")
        name = F.unhex(F.substring(F.sha2(F.concat("a", "b"), 256), 1, 32))
        blocks.append(materialize(both.select("conv", "at", name.alias("name")), "trie-blocks"))
    known = materialize(convs.crossJoin(F.broadcast(least)).select("conv", F.lit(0).cast("long").alias("p"), "rep"), "trie-prefixes")
    levels = [known]
    for k in reversed(range(len(blocks))):  # cuts at odd multiples of 2^k
        before = levels[0]
        for level in levels[1:]:
            before = before.unionByName(level)
        upper = before.join(blocks[k].select("conv", F.shiftleft("at", k).alias("p"), "name"), ["conv", "p"])
        firsts = upper.groupBy("p", "rep", "name").agg(F.min("conv").alias("least"))
        cut = upper.join(firsts, ["p", "rep", "name"]).select("conv", (F.col("p") + (1 << k)).alias("p"), F.col("least").alias("rep"))
        levels.append(materialize(cut, "trie-prefixes"))
    drop_tables(*blocks[1:])
    return _union(levels)


def _union(tables: list[DataFrame]) -> DataFrame:
    made = tables[0]
    for table in tables[1:]:
        made = made.unionByName(table)
    return made


def grafted(nodes: DataFrame, known: DataFrame) -> DataFrame:
    """``rep``, ``p``, ``saved``, ``leaves``: the sums of ``own_saved`` and ``own_leaves`` over each node's subtree."""
    q = F.col("p") - 1
    # a node lies in the lower half of one block for each bit of the turns before its last
    bits = F.filter(F.sequence(F.lit(0), F.lit(62)), lambda b: F.call_function("getbit", q, b) == 1)
    own = nodes.where("p > 0").select("rep", "p", "own_saved", "own_leaves")
    cut = F.expr("shiftleft(shiftright(p - 1, bit), bit)")
    below = own.withColumn("bit", F.explode(bits)).select(F.col("rep").alias("conv"), cut.alias("p"), "own_saved", "own_leaves")
    forests = below.join(known, ["conv", "p"]).groupBy("rep", "p").agg(F.sum("own_saved").alias("own_saved"), F.sum("own_leaves").alias("own_leaves"))
    forests = materialize(forests, "trie-forests")
    lowest = F.expr("p & -p")
    handed = forests.select(F.col("rep").alias("conv"), F.explode(F.sequence(F.col("p") - lowest + 1, "p")).alias("p"), "own_saved", "own_leaves")
    handed = handed.join(known, ["conv", "p"]).select("rep", "p", "own_saved", "own_leaves")
    whole = nodes.agg(F.sum("own_saved").alias("own_saved"), F.sum("own_leaves").alias("own_leaves"))
    root = nodes.where("p = 0").select("rep", "p").crossJoin(F.broadcast(whole))  # one row each
    summed = own.unionByName(handed).groupBy("rep", "p").agg(F.sum("own_saved").alias("saved"), F.sum("own_leaves").alias("leaves"))
    return summed.unionByName(root.select("rep", "p", F.col("own_saved").alias("saved"), F.col("own_leaves").alias("leaves")))


def end_digests(ends: DataFrame) -> DataFrame:
    """``rep``, ``p``, ``sha256`` of the ids ``conv``, ascending and joined by commas. Ids are joined in spans of
    ``ENDS``; the digest of a node reads its texts in order, a text at a time."""
    ship_package(ends.sparkSession)
    span = F.floor(F.col("conv") / ENDS).alias("span")
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("conv")), lambda c: c.cast("string")), ",")
    texts = ends.groupBy("rep", "p", span).agg(ids.alias("ids"))
    dealt = texts.repartition("rep", "p").sortWithinPartitions("rep", "p", "span").select("rep", "p", "ids")
    return dealt.mapInArrow(_digests, "rep long, p long, sha256 string")


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    node, digest, made = None, None, []

    def out() -> pa.RecordBatch:
        rep, p, sha = zip(*made)
        return pa.RecordBatch.from_arrays([pa.array(rep, pa.int64()), pa.array(p, pa.int64()), pa.array(sha)], names=["rep", "p", "sha256"])

    for batch in batches:
        for rep, p, ids in zip(*(c.to_pylist() for c in batch.columns)):
            if (rep, p) == node:
                digest.update(b"," + ids.encode())
                continue
            if node:
                made.append((*node, digest.hexdigest()))
            node, digest = (rep, p), hashlib.sha256(ids.encode())
        if len(made) >= 10_000:
            yield out()
            made = []
    if node:
        made.append((*node, digest.hexdigest()))
        yield out()


def prefix_trie(conversations: DataFrame, base: int | None = BRANCH) -> DataFrame:
    """One row for each distinct prefix of the conversations: ``conv_id`` (the smallest that starts with it),
    ``depth``, ``parent_conv_id`` (null for the root), ``n_convs``, ``n_children``, ``n_leaves``, ``saved_tokens``,
    ``ends_sha256``.

    ``conversations`` has ``conv_id``, ``turn``, ``role``, ``text``; other columns are not read. Turns are ordered by
    ``turn``, null first, then role and text; null roles and texts are empty. Rows with a null ``conv_id`` are
    left out; repeated rows are turns as often as they stand there. With ``base``, conversations are rebuilt
    as ``branched`` says, and one left without turns ends at the root. An empty table gives no row.
    """
    turns = materialize(symbols(numbered(conversations)), "trie-turns")
    convs = materialize(turns.select("conv").distinct(), "trie-convs")
    if base is not None:
        given, turns = turns, materialize(branched(turns, base), "trie-turns")
        drop_tables(given)
    depth = turns.agg(F.max("t")).first()[0] or 0
    known = materialize(prefixes(convs, turns, depth), "trie-known")
    counts = known.groupBy("rep", "p").agg(F.count("*").alias("n_convs"))
    words = turns.select(F.col("conv").alias("rep"), F.col("t").alias("p"), "words")
    parents = known.select(F.col("conv").alias("rep"), (F.col("p") + 1).alias("p"), F.col("rep").alias("parent"))
    nodes = counts.join(words, ["rep", "p"], "left").join(parents, ["rep", "p"], "left")
    nodes = materialize(nodes.withColumn("own_saved", (F.col("n_convs") - 1) * F.coalesce("words", F.lit(0))), "trie-nodes")
    children = nodes.where("p > 0").groupBy(F.col("parent").alias("rep"), (F.col("p") - 1).alias("p")).agg(F.count("*").alias("n_children"))
    own_leaves = F.when(F.col("n_children").isNull(), 1).otherwise(0).cast("long")
    nodes = materialize(nodes.join(children, ["rep", "p"], "left").withColumn("own_leaves", own_leaves), "trie-nodes")
    totals = grafted(nodes, known)
    lengths = known.groupBy("conv").agg(F.max("p").alias("p"))
    digests = end_digests(known.join(lengths, ["conv", "p"]))
    found = nodes.join(totals, ["rep", "p"]).join(digests, ["rep", "p"], "left")
    return found.select(
        F.col("rep").alias("conv_id"), F.col("p").alias("depth"), F.col("parent").alias("parent_conv_id"), "n_convs",
        F.coalesce("n_children", F.lit(0).cast("long")).alias("n_children"), F.col("leaves").alias("n_leaves"),
        F.col("saved").alias("saved_tokens"), F.coalesce("sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("ends_sha256"),
    )
