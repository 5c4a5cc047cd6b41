"""SimHash near-duplicates: fingerprints linked through vantage-point trees.

Distinct fingerprints are dealt to shards by the top of a vantage-point tree, which is fitted on a
bounded sample: every inner node has a vantage fingerprint and a radius, and a fingerprint lives on
the side its distance says. One that is within the link distance of a boundary is also sent, as a
query, to the shard across it, so by the triangle inequality every linked pair meets in the home
shard of either end. In a shard, another vantage-point tree over the fingerprints at home is walked
with all queries at once, pruned by the same bounds, and only its leaves are compared. A shard
gives the spanning links of what it found, never the pairs; components then join the shards.

Any choice of vantage points gives the same result, since the bounds are exact; the sample only
decides how even the shards are. Half of the space is within three bits of the median distance from
any point, so a level prunes about a fifth of the comparisons: the work grows as about the 1.7th
power of the distinct fingerprints.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tokenloom.llm.common import bound_batches, bounded_sample, local_roots, materialize, ship_package, word_windows
from tokenloom.llm.components import components

SEED = 42
SHINGLE = 3
MAX_BITS = 3
SAMPLE_ROWS = 8192  # fingerprints the top of the tree is fitted on
HOME_ROWS = 1 << 15  # fingerprints at home in a shard, about
QUERY_ROWS = 1 << 20  # queries of one shard in one task, about
MIN_LEVELS = 4
LEAF = 64
PRUNED = 0.81  # share of comparisons a level leaves

_WINDOW = 1 << 18  # shingles that are counted at a time


# Fingerprints


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id`` and ``bits``, the 64-bit fingerprint as a signed long, of every row's whole text.

    A-Z is lower-cased; words are runs without ASCII white space; shingles of three words are counted
    as often as they occur; a shorter text is one shingle, and one without words, or null, is zero.
    Rows stand for themselves; other columns are not read.
    """
    ship_package(docs.sparkSession)
    bound_batches(docs.sparkSession)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("binary").alias("text"))
    return rows.mapInArrow(_fingerprints, T.StructType([rows.schema["doc_id"], T.StructField("bits", T.LongType())]))


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        bits = fingerprint_all(batch.column(1).to_pylist())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bits.view(np.int64))], names=["doc_id", "bits"])


def fingerprint_all(texts: list[bytes | None]) -> np.ndarray:
    """The fingerprints of texts, as unsigned numbers."""
    totals = np.zeros((len(texts), 64), np.int64)
    counts = np.zeros(len(texts), np.int64)
    held: list[np.ndarray] = []
    owners: list[int] = []
    waiting = 0
    for i, text in enumerate(texts):
        for part in _hashes(text):
            held.append(part)
            owners.append(i)
            waiting += len(part)
            if waiting >= _WINDOW:
                _count(held, owners, totals, counts)
                held, owners, waiting = [], [], 0
    _count(held, owners, totals, counts)
    return np.packbits(2 * totals > counts[:, None], axis=1, bitorder="little").view("<u8").ravel()


def _hashes(text: bytes | None) -> Iterator[np.ndarray]:
    import itertools

    import xxhash

    digest = xxhash.xxh64_intdigest
    words, whole = [], False
    for more in word_windows((text or b"").lower()):
        words += more
        if len(words) >= SHINGLE:
            whole = True
            joined = b" ".join(words)
            starts = list(itertools.accumulate(map(len, words), lambda at, n: at + n + 1, initial=0))
            yield np.array([digest(joined[a : b - 1], SEED) for a, b in zip(starts, starts[SHINGLE:])], np.uint64)
            words = words[1 - SHINGLE :]  # the next shingle starts with these
    if words and not whole:
        yield np.array([digest(b" ".join(words), SEED)], np.uint64)


#: The eight bits of a byte as the eight bytes of a number, so that one addition counts eight bits.
_SPREAD = np.array([sum(((v >> k) & 1) << (8 * k) for k in range(8)) for v in range(256)], np.uint64)


def _count(held: list[np.ndarray], owners: list[int], totals: np.ndarray, counts: np.ndarray) -> None:
    if not held:
        return
    sizes = np.array([len(h) for h in held])
    spread = _SPREAD[np.concatenate(held).astype("<u8", copy=False).view(np.uint8).reshape(-1, 8)]
    starts = np.cumsum(sizes) - sizes
    runs = -(-sizes // 255)  # a byte counts to 255
    owner = np.repeat(np.arange(len(held)), runs)
    cuts = np.repeat(starts - 255 * (np.cumsum(runs) - runs), runs) + 255 * np.arange(runs.sum())
    part = np.add.reduceat(spread, cuts, axis=0)
    lanes = part.astype("<u8", copy=False).view(np.uint8).reshape(len(part), 64)
    np.add.at(totals, np.array(owners)[owner], lanes)
    np.add.at(counts, np.array(owners), sizes)


def hex_of(bits: Column) -> Column:
    """A fingerprint as 16 lower-case hex digits."""
    return F.lower(F.lpad(F.hex(bits), 16, "0"))


# Links


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", max_bits: int = MAX_BITS) -> DataFrame:
    """``doc_id``, ``bits``, ``component_id`` of every row.

    Ids may be of any type that has an order. Fingerprints that differ in at most ``max_bits`` bits are linked; ``component_id`` is the smallest
    ``doc_id`` reachable, the row's own included. A row with a null id has a fingerprint but takes no
    part in links, and its component is null. Repeated rows come back as often as they came. An
    empty table gives an empty result.
    """
    marked = materialize(fingerprints(docs, doc_id, text), "fingerprints")
    found = marked.where("doc_id is not null").groupBy("bits").agg(F.min("doc_id").alias("first"))
    # numbered, as ids may be of any type; the numbers are written with them
    reps = materialize(found.withColumn("rep", F.monotonically_increasing_id()), "distinct-fingerprints")
    roots = components(links(reps, max_bits)).withColumnsRenamed({"node": "rep"})
    named = reps.join(roots, "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    least = named.groupBy("component").agg(F.min("first").alias("component_id"))
    classes = named.join(least, "component").select("bits", "component_id")
    joined = marked.join(classes, "bits", "left")
    return joined.select("doc_id", "bits", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def links(reps: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """Edges ``a``, ``b`` between the ``rep`` of distinct ``bits`` that span all links between them."""
    total = reps.count()
    levels = max(MIN_LEVELS, math.ceil(math.log2(max(total, 1) / HOME_ROWS))) if total else MIN_LEVELS
    salts = max(1, math.ceil(total * PRUNED**levels / QUERY_ROWS))
    sample = bounded_sample(reps.select("bits"), [F.col("bits")], SAMPLE_ROWS).toArrow()
    tree = build_tree(np.sort(sample.column(0).to_numpy().view(np.uint64)), levels)
    sent = reps.select("bits", F.col("rep").cast("long")).mapInArrow(
        functools.partial(_route, tree, levels, salts, max_bits),
        "shard long, salt int, home boolean, bits binary, reps binary",
    )
    return sent.groupBy("shard", "salt").applyInArrow(_searching(max_bits), "a long, b long")


def build_tree(points: np.ndarray, levels: int) -> tuple[np.ndarray, np.ndarray]:
    """Vantage fingerprints and radii of a complete tree, in heap order; node ``i`` has the children
    ``2i + 1`` (inside) and ``2i + 2``. Few points give nodes of which one side stays empty."""
    vantage = np.zeros((1 << levels) - 1, np.uint64)
    radius = np.full((1 << levels) - 1, 32, np.int64)
    held = {0: points}
    for node in range(len(vantage)):
        own = held.pop(node, points[:0])
        if len(own):
            vantage[node] = _vantage(own)
            distance = np.bitwise_count(own ^ vantage[node])
            radius[node] = int(np.median(distance))
            inside = distance <= radius[node]
            held[2 * node + 1], held[2 * node + 2] = own[inside], own[~inside]
    return vantage, radius


def _vantage(points: np.ndarray) -> np.uint64:
    # of eight candidates, the one whose distances spread most
    tries = points[np.linspace(0, len(points) - 1, 8).astype(int)]
    probe = points[:: max(1, len(points) // 512)]
    return tries[np.argmax(np.bitwise_count(tries[:, None] ^ probe[None]).astype(float).var(axis=1))]


def _route(tree, levels: int, salts: int, max_bits: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    vantage, radius = tree
    first_leaf = (1 << levels) - 1
    for batch in batches:
        bits, reps = batch.column(0).to_numpy().view(np.uint64), batch.column(1).to_numpy()
        at = [(0, np.arange(len(bits)), np.ones(len(bits), bool))]
        out: list[tuple] = []
        while at:
            node, rows, home = at.pop()
            if not len(rows):
                continue
            if node >= first_leaf:
                salt = (bits[rows] * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)) % np.uint64(salts)
                for k in range(salts):  # the points at home go to every task of the shard
                    for kind, own in ((True, home), (False, ~home)):
                        mine = own if kind else own & (salt == k)
                        if mine.any():
                            out.append((node, k, kind, bits[rows[mine]].tobytes(), reps[rows[mine]].tobytes()))
                continue
            distance = np.bitwise_count(bits[rows] ^ vantage[node]).astype(np.int64)
            inside = distance <= radius[node]
            left, right = distance - max_bits <= radius[node], distance + max_bits > radius[node]
            at.append((2 * node + 1, rows[left], home[left] & inside[left]))
            at.append((2 * node + 2, rows[right], home[right] & ~inside[right]))
        for lo in range(0, len(out), 1024):
            part = list(zip(*out[lo : lo + 1024]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(part, (pa.int64(), pa.int32(), pa.bool_(), pa.binary(), pa.binary()))],
                names=["shard", "salt", "home", "bits", "reps"],
            )


def _searching(max_bits: int):
    def search(cell: pa.Table) -> pa.Table:
        bits = [np.frombuffer(b, np.uint64) for b in cell.column("bits").to_pylist()]
        reps = np.concatenate([np.frombuffer(b, np.int64) for b in cell.column("reps").to_pylist()])
        home = np.repeat(cell.column("home").to_numpy(), [len(b) for b in bits])
        a, b = spanning_links(np.concatenate(bits), home, max_bits)
        return pa.table({"a": reps[a], "b": reps[b]})

    return search


def spanning_links(points: np.ndarray, home: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs that connect what links between all points and those at home connect.

    A vantage-point tree over the points at home is cut down to leaves of ``LEAF`` points; all queries
    go down together, each to the sides its triangle bound leaves.
    """
    n = len(points)
    found_a, found_b, held = [], [], 0
    root = np.arange(n)
    stack = [(np.flatnonzero(home), np.arange(n))]
    while stack:
        own, queries = stack.pop()
        if not len(own) or not len(queries):
            continue
        if len(own) > LEAF:
            vantage = _vantage(points[own])
            d_own = np.bitwise_count(points[own] ^ vantage)
            mu = int(np.median(d_own))
            inside = d_own <= mu
            if inside.all():
                inside = d_own < mu
                mu -= 1
            if inside.any():
                d = np.bitwise_count(points[queries] ^ vantage).astype(np.int16)
                stack.append((own[inside], queries[d - max_bits <= mu]))
                stack.append((own[~inside], queries[d + max_bits > mu]))
                continue
        for lo in range(0, len(own), LEAF):
            leaf = own[lo : lo + LEAF]
            near = np.bitwise_count(points[queries][:, None] ^ points[leaf][None]) <= max_bits
            rows = np.flatnonzero(near.sum(axis=1, dtype=np.int32) > 0)
            if not len(rows):
                continue
            first = leaf[near[rows].argmax(axis=1)]
            found_a.append(queries[rows])
            found_b.append(first)
            # leaf points that one query reaches belong together
            masks = np.unique(near[rows], axis=0)
            which, col = np.nonzero(masks)
            found_a.append(leaf[masks.argmax(axis=1)][which])
            found_b.append(leaf[col])
            held += len(rows) + len(col)
            if held > 1 << 21:
                root = _merged(n, root, found_a, found_b)
                found_a, found_b, held = [], [], 0
    root = _merged(n, root, found_a, found_b)
    tied = np.flatnonzero(root != np.arange(n))
    return tied, root[tied]


def _merged(n: int, root: np.ndarray, a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    if not a:
        return root
    return local_roots(n, np.concatenate([np.arange(n), *a]), np.concatenate([root, *b]))
