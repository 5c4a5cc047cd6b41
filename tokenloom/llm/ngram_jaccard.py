"""Jaccard join of shingle sets: a size-aware join of small (light) and large (heavy) sets.

A light set, of at most ``boundary`` shingles, enumerates its subsets of fixed sizes: two sets whose
similarity reaches the threshold and of which the larger has ``m`` shingles share at least
``c = ceil(m * t)`` of them, so both enumerate the same subset of ``c``. Heavy sets scan inverted lists:
with shingles ordered from rare to common, such a pair shares one of the first ``n - ceil(n * t) + 1`` of
each, so only these enter the lists. Light sets that may meet a heavy one enter the lists as well. The
boundary is the size at which enumeration and scanning together cost the least, from the sizes of all
sets and the second moment of the shingle counts.

The order comes from a table of counts by hash, of fixed size, over all sets; any order gives the same
result. Lists are packed: a task sends its entries in a few blocks for each part of the hash space. Equal
sets are one set. In a list a set is compared with a leader of about its size and with its neighbour, and
with all others that places and sizes leave possible where these are few. Other lists, if this leaves
their members in several components, are compared in full, by cells of chunk pairs. Cells give spanning
links, so rows never grow with the pairs of a group.

Before sets are fetched, their signatures are compared: two to four bits a shingle, each the parity of the
shingles it stands for. Signatures differ in at most as many bits as sets do in members, so this only drops
pairs, and members of cells, that cannot be similar. What is left is compared by the exact sets.

Shingles and sets are known by 64-bit hashes.
"""

from __future__ import annotations

import functools
import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tokenloom.llm.common import drop_tables, filter_bits, materialize, may_hold, ship_package, word_windows
from tokenloom.llm.components import components

SHINGLE = 5
NUMERATOR, DENOMINATOR = 4, 5  # the threshold, 0.8
COUNTERS = 1 << 18  # counts by hash; a task's share is a megabyte
LONGEST_LIGHT = 24  # no boundary above: subsets grow exponentially
PART_ENTRIES = 1 << 20  # list entries a task holds, about
LIST_ENTRIES = 1 << 18  # a longer list is dealt over several tasks
PRUNED_MEMBERS = 1024  # of a list whose possible pairs are looked at before sets are fetched
FEW_PAIRS = 4  # possible pairs for each member of a list that are compared as pairs, not in cells
CHUNK_MEMBERS = 1024
GROUP_MEMBERS = 1 << 14  # members of lists that are compared together
CELL_BYTES = 1 << 24  # shingle sets compared in a group, about
FLUSH_ENTRIES = 1 << 21

_BASE = 0x9E3779B97F4A7C15
_MIX = 0xBF58476D1CE4E5B9
_SALTED = 1 << 31


# Shingles


class Hasher:
    """Hashes of the shingles of texts: a polynomial over the bytes from the first to the last word, all
    shingles of a batch at once."""

    def __init__(self, size: int = SHINGLE):
        self.size = size
        self.powers = np.ones(1, np.uint64)
        self.inverses = np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        if n >= len(self.powers):
            n = max(n + 1, 2 * len(self.powers))
            for name, base in (("powers", _BASE), ("inverses", pow(_BASE, -1, 1 << 64))):
                steps = np.full(n, base, np.uint64)
                steps[0] = 1
                setattr(self, name, np.multiply.accumulate(steps))

    def sets(self, text: bytes | None) -> np.ndarray:
        """The distinct shingles of a text, ascending. A-Z count as a-z; words are runs without ASCII
        white space; fewer words than a shingle are one; no words are none."""
        made: list[np.ndarray] = []
        words: list[bytes] = []
        for more in word_windows((text or b"").lower()):  # one window, if the text is not very long
            words += more
            if len(words) >= self.size:
                made.append(self._hashes(words))
                words = words[1 - self.size :]  # the next shingle starts with these
        if words and not made:
            made.append(self._hashes(words))
        return np.unique(np.concatenate(made)) if made else np.zeros(0, np.uint64)

    def _hashes(self, words: list[bytes]) -> np.ndarray:
        joined = np.frombuffer(b" ".join(words), np.uint8)
        self._grow(len(joined) + 1)
        total = np.zeros(len(joined) + 1, np.uint64)
        np.cumsum((joined.astype(np.uint64) + np.uint64(1)) * self.powers[: len(joined)], out=total[1:])
        gaps = np.flatnonzero(joined == 32)
        starts = np.concatenate([[0], gaps + 1])
        ends = np.concatenate([gaps, [len(joined)]])
        k = min(self.size, len(starts))
        starts, ends = starts[: len(starts) - k + 1], ends[k - 1 :]
        mixed = (total[ends] - total[starts]) * self.inverses[starts]
        mixed ^= mixed >> np.uint64(31)
        mixed *= np.uint64(_MIX)
        mixed ^= mixed >> np.uint64(29)
        return mixed


def _key(shingles: np.ndarray) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(shingles.tobytes(), seed=len(shingles))


def _counter(shingles: np.ndarray) -> np.ndarray:
    return (shingles >> np.uint64(20)).astype(np.int64) & (COUNTERS - 1)


def common_needed(sizes: np.ndarray | int) -> np.ndarray | int:
    """The least number of shingles that a set shares with a similar one of at most its size."""
    return -(-sizes * NUMERATOR // DENOMINATOR)


# Signatures


def signature(shingles: np.ndarray) -> bytes:
    """The parity of the shingles by their low bits: 64 bits, or the next power of two from ``2 * n``."""
    width = max(64, 1 << (2 * len(shingles) - 1).bit_length())
    odd = np.bincount((shingles & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def possible(a: np.ndarray, n: np.ndarray, b: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Whether sets of ``n`` and ``m`` shingles may be similar, by the rows of 64-bit words ``a``, ``b``."""
    differ = np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int64)
    near = (NUMERATOR * n <= DENOMINATOR * m) & (NUMERATOR * m <= DENOMINATOR * n)
    # n + m - 2 * common is what differs, see ``similar``
    return near & ((NUMERATOR + DENOMINATOR) * differ <= (DENOMINATOR - NUMERATOR) * (n + m))


def fold(words: np.ndarray) -> np.ndarray:
    """Signatures of half the width: a bit is taken with the one half the width away."""
    half = words.shape[-1] // 2
    return words[..., :half] ^ words[..., half:]


def _possible_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b, n, m = (batch.column(c).to_numpy() for c in ("a", "b", "n", "m"))
        left, right = (batch.column(c).to_pylist() for c in ("left", "right"))
        widths = np.stack([np.array([len(x) for x in side], np.int64).reshape(-1) for side in (left, right)])
        keep = np.zeros(len(a), bool)
        for width in np.unique(widths.min(axis=0)):
            fit = np.flatnonzero((widths.min(axis=0) == width) & (widths.max(axis=0) <= 2 * width))
            for at in np.array_split(fit, -(-len(fit) * int(width) // (1 << 24)) or 1):
                ends = [_words([side[i] for i in at.tolist()], int(width)) for side in (left, right)]
                keep[at] = possible(ends[0], n[at], ends[1], m[at])
        yield pa.RecordBatch.from_arrays([pa.array(a[keep]), pa.array(b[keep])], names=["a", "b"])


def _words(signatures: list[bytes], width: int) -> np.ndarray:
    """Signatures of ``width`` or twice as many bytes as rows of words of this width."""
    out = np.zeros((len(signatures), width // 8), np.uint64)
    for i, one in enumerate(signatures):
        words = np.frombuffer(one, np.uint64)
        out[i] = words if len(one) == width else fold(words)
    return out


def possible_members(sizes: np.ndarray, signatures: list[bytes], root: np.ndarray) -> np.ndarray:
    """Which sets may be similar to one of another group ``root``."""
    keep = np.zeros(len(sizes), bool)
    widths = np.array([len(s) for s in signatures])
    for width in np.unique(widths):
        at = np.flatnonzero((widths == width) | (widths == 2 * width))
        at = at[np.argsort(sizes[at], kind="stable")]  # those of this width come first, as the width follows the size
        words, n, r = _words([signatures[i] for i in at.tolist()], int(width)), sizes[at], root[at]
        own, step = int((widths == width).sum()), max(1, (1 << 21) // (len(at) * words.shape[1]))
        found = np.zeros(len(at), bool)
        for lo in range(0, own, step):
            hi = min(own, lo + step)
            end = int(np.searchsorted(n, n[hi - 1] * DENOMINATOR // NUMERATOR, "right"))  # pairs are met from the smaller
            rows, columns = slice(lo, hi), slice(lo, end)
            ok = possible(words[rows, None], n[rows, None], words[None, columns], n[None, columns])
            ok &= r[rows, None] != r[None, columns]
            found[rows] |= ok.any(axis=1)
            found[columns] |= ok.any(axis=0)
        keep[at[found]] = True
    return keep


def _possible_cell(cell: pa.Table) -> pa.Table:
    root = np.unique(cell.column("root").to_numpy(), return_inverse=True)[1]
    keep = np.zeros(len(root), bool)
    if root.any():
        keep = possible_members(cell.column("n").to_numpy(), cell.column("signature").to_pylist(), root)
    return cell.select(["first", "share", "i", "j", "key", "root"]).filter(pa.array(keep))


# Classes of equal sets, and counts


def _rows(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("binary").alias("text"))
    return rows.withColumn("row_hash", F.xxhash64("doc_id", "text"))


def shingle_sets(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, ``row_hash``, ``n`` (shingles), ``key`` and ``signature`` (of the set) of every row, and rows of ``block``
    and ``counts``: how many sets of a task hold a shingle with a hash of that block."""
    ship_package(docs.sparkSession)
    rows = _rows(docs, doc_id, text)
    kinds = (T.LongType(), T.LongType(), T.LongType(), T.BinaryType(), T.IntegerType(), T.BinaryType())
    names = ("row_hash", "n", "key", "signature", "block", "counts")
    schema = T.StructType([rows.schema["doc_id"], *map(T.StructField, names, kinds)])
    return rows.select("doc_id", "row_hash", "text").mapInArrow(_describe, schema)


_BLOCK = 1 << 14


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hasher, seen, counts = Hasher(), set(), np.zeros(COUNTERS, np.uint32)
    id_type = None
    names = ["doc_id", "row_hash", "n", "key", "signature", "block", "counts"]
    for batch in batches:
        id_type = batch.schema.field(0).type
        sizes, keys, signatures, held = [], [], [], []
        for text in batch.column(2).to_pylist():
            found = hasher.sets(text)
            key = _key(found)
            sizes.append(len(found))
            keys.append(key)
            signatures.append(signature(found))
            if key not in seen:
                if len(seen) >= 1 << 20:
                    seen.clear()
                seen.add(key)
                held.append(found)
        if held:
            counts += np.bincount(_counter(np.concatenate(held)), minlength=COUNTERS).astype(np.uint32)
        keys = np.array(keys, np.uint64).view(np.int64)
        n = len(sizes)
        columns = [batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(keys), pa.array(signatures, pa.binary())]
        columns += [pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, names=names)
    if id_type is not None:
        parts = [counts[at : at + _BLOCK] for at in range(0, COUNTERS, _BLOCK)]
        n = len(parts)
        columns = [pa.nulls(n, id_type), *(pa.nulls(n, pa.int64()) for _ in range(3)), pa.nulls(n, pa.binary()), pa.array(range(n), pa.int32())]
        yield pa.RecordBatch.from_arrays([*columns, pa.array([p.tobytes() for p in parts], pa.binary())], names=names)


def counter_table(described: DataFrame) -> np.ndarray:
    """The counts over all tasks: ``COUNTERS`` numbers, whatever the size of the input."""

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                sums.setdefault(block, np.zeros(_BLOCK, np.int64))
                sums[block] += np.frombuffer(counts, np.uint32)
        columns = [pa.array(list(sums), pa.int32()), pa.array([s.tobytes() for s in sums.values()], pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, names=["block", "counts"])

    dealt = described.where("block is not null").select("block", "counts").repartition(COUNTERS // _BLOCK, "block")
    table = np.zeros(COUNTERS, np.int64)
    for row in dealt.mapInArrow(total, "block int, counts binary").collect():  # one row a block
        table[row.block * _BLOCK : (row.block + 1) * _BLOCK] = np.frombuffer(row.counts, np.int64)
    return table


def choose_boundary(sizes: dict[int, int], table: np.ndarray) -> int:
    """The largest size of a light set, at which entries to enumerate and to scan cost the least.

    ``sizes`` gives the number of sets of each size up to ``LONGEST_LIGHT * 5 / 4``. A scanned entry meets
    as many others as the second moment of the counts says, freed from what unrelated shingles add.
    """
    total = float(table.sum())
    moment = (float((table.astype(float) ** 2).sum()) - total**2 / COUNTERS) / (1 - 1 / COUNTERS)
    met = max(1.0, moment / total) if total else 1.0

    def scanned(n: int) -> float:
        return (n - int(common_needed(n)) + 1) * met

    def enumerated(n: int) -> int:
        return sum(math.comb(n, c) for c in subset_sizes(n))

    def cost(boundary: int) -> float:
        light = sum(k * enumerated(n) for n, k in sizes.items() if n <= boundary)
        heavy = sum(k * scanned(n) for n, k in sizes.items() if n >= common_needed(boundary + 1))
        return light + heavy

    return min(range(LONGEST_LIGHT + 1), key=lambda b: (cost(b), b))


def subset_sizes(n: int) -> range:
    """The sizes of the subsets a set of ``n`` shares with a similar one: of every larger set's needs."""
    return range(int(common_needed(n)), n + 1) if n else range(0)


# Lists


@functools.lru_cache(maxsize=256)
def _subsets(n: int, c: int) -> np.ndarray:
    return np.array(list(itertools.combinations(range(n), c)), np.int64)


def entries_of(shingles: np.ndarray, boundary: int, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The list entries of one set: hash of the list, place of the shingle in the set's order, and how
    many sets the list may hold."""
    n = len(shingles)
    made = []
    counts = table[_counter(shingles)]
    if n * DENOMINATOR // NUMERATOR == n:  # a smaller set is only similar to its equals
        n = 0
    if 0 < n <= boundary:
        for c in subset_sizes(n):
            picks = _subsets(n, c)
            mixed = np.full(len(picks), c * 0x632BE5AB, np.uint64)
            for column in range(c):
                mixed = (mixed ^ shingles[picks[:, column]]) * np.uint64(_MIX)
                mixed ^= mixed >> np.uint64(32)
            made.append((mixed, np.zeros(len(picks), np.int64), counts[picks].min(axis=1)))
    if n and n >= common_needed(boundary + 1):
        first = n - int(common_needed(n)) + 1
        order = np.lexsort((shingles, counts))[:first]
        made.append((shingles[order], np.arange(first), counts[order]))
    if not made:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(c) for c in zip(*made))


def _entries(boundary: int, table: np.ndarray, parts: int, long_list: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hasher, seen, held, waiting = Hasher(), set(), [], 0

    def flush() -> pa.RecordBatch:
        lists, keys, places, salts = (np.concatenate(c) for c in zip(*held))
        part = (lists % np.uint64(parts)).astype(np.int64) + parts * salts
        order = np.argsort(part, kind="stable")
        cuts = np.flatnonzero(np.diff(part[order], prepend=-1))
        bounds = [*cuts.tolist(), len(order)]
        rows = [np.stack([c[order[lo:hi]] for c in (lists, keys, places)]).tobytes() for lo, hi in zip(bounds, bounds[1:])]
        return pa.RecordBatch.from_arrays([pa.array(part[order[cuts]]), pa.array(rows, pa.binary())], names=["part", "packed"])

    for batch in batches:
        for text in batch.column(0).to_pylist():
            found = hasher.sets(text)
            key = _key(found)
            if key in seen:
                continue
            if len(seen) >= 1 << 20:
                seen.clear()
            seen.add(key)
            lists, places, size = entries_of(found, boundary, table)
            salts = np.maximum(1, -(-size // long_list))  # the same for all entries of a list
            flags = np.where(salts > 1, _SALTED, 0)
            own = np.where(salts > 1, np.uint64(key) % salts.astype(np.uint64), 0).astype(np.int64)
            packed = (np.uint64(len(found)) << np.uint64(32)) | (places | flags).astype(np.uint64)
            held.append((lists, np.full(len(lists), key, np.uint64), packed, own))
            waiting += len(lists)
            if waiting >= FLUSH_ENTRIES:
                yield flush()
                held, waiting = [], 0
    if waiting:
        yield flush()


def _meet(part: pa.Table) -> pa.Table:
    # pairs to compare (list null), and members of lists to compare in full
    blocks = [np.frombuffer(b, np.uint64).reshape(3, -1) for b in part.column("packed").to_pylist()]
    lists, keys, packed = (np.concatenate(c) for c in zip(*blocks))
    n, place = (packed >> np.uint64(32)).astype(np.int64), (packed & np.uint64(_SALTED - 1)).astype(np.int64)
    salted = (packed & np.uint64(_SALTED)) != 0
    order = np.lexsort((keys, n, lists))
    lists, keys, n, place, salted = (c[order] for c in (lists, keys, n, place, salted))
    fresh = np.concatenate([[True], (lists[1:] != lists[:-1]) | (keys[1:] != keys[:-1])])
    lists, keys, n, place, salted = (c[fresh] for c in (lists, keys, n, place, salted))
    opens = np.concatenate([[True], lists[1:] != lists[:-1]])
    number = np.cumsum(opens) - 1
    sizes = np.bincount(number)
    shared = (sizes[number] > 1) | salted
    at = np.flatnonzero(shared)
    if not len(at):
        return pa.table({c: pa.array([], pa.int64()) for c in ("list", "a", "b")})
    lead = np.flatnonzero(opens)[number]
    while True:  # who is too large for the leader leads those after it
        late = at[NUMERATOR * n[at] > DENOMINATOR * n[lead[at]]]
        if not len(late):
            break
        heads = np.flatnonzero(np.diff(number[late], prepend=-1))
        lead[late] = np.repeat(late[heads], np.diff([*heads, len(late)]))
    # the largest partner that a first shared shingle at this place leaves possible
    reach = ((NUMERATOR + DENOMINATOR) * (n - place) - NUMERATOR * n) // NUMERATOR
    follow = at[1:][(number[at[1:]] == number[at[:-1]])]
    left, right = [lead[at], follow - 1], [at, follow]
    starts = np.flatnonzero(opens)
    full = np.flatnonzero((sizes > 2) & ~salted[starts])
    whole = np.zeros(len(sizes), bool)
    whole[full] = True
    for k, lo, hi in zip(full.tolist(), starts[full].tolist(), (starts + sizes)[full].tolist()):
        if hi - lo <= PRUNED_MEMBERS:
            possible = (n[lo:hi, None] <= reach[None, lo:hi]) & (n[None, lo:hi] <= reach[lo:hi, None])
            i, j = np.nonzero(np.triu(possible, 1))
            whole[k] = len(i) > FEW_PAIRS * (hi - lo)
            if not whole[k]:
                left.append(lo + i)
                right.append(lo + j)
    # of lists with the same members one is compared in full
    mixed = (keys ^ (keys >> np.uint64(33))) * np.uint64(_MIX)
    mixed ^= mixed >> np.uint64(29)
    sums = np.stack([sizes.astype(np.uint64), np.add.reduceat(mixed, starts), np.bitwise_xor.reduceat(keys, starts)])
    full = np.flatnonzero(whole)
    whole[:] = salted[starts]
    whole[full[np.unique(sums[:, full], axis=1, return_index=True)[1]]] = True
    left, right = np.concatenate(left), np.concatenate(right)
    fit = (left != right) & (n[left] <= reach[right]) & (n[right] <= reach[left])
    ends = keys[left[fit]], keys[right[fit]]
    pairs = np.unique(np.stack([np.minimum(*ends), np.maximum(*ends)]), axis=1)
    members = np.flatnonzero(whole[number])
    over = np.where(salted[members], keys[lead[members]].view(np.int64), 0)  # the leader, where a list is dealt over tasks
    tables = [
        pa.table({"list": pa.nulls(pairs.shape[1], pa.int64()), "a": pairs[0].view(np.int64), "b": pairs[1].view(np.int64)}),
        pa.table({"list": lists[members].view(np.int64), "a": keys[members].view(np.int64), "b": pa.array(over, mask=~salted[members])}),
    ]
    return pa.concat_tables(tables)


# Comparing


def fetch_sets(docs: DataFrame, classes: DataFrame, keys: DataFrame, doc_id: str, text: str) -> DataFrame:
    """``key``, ``n``, ``shingles`` of the sets named by ``keys``, read again from one row of each."""
    wanted = materialize(classes.join(keys, "key").select("key", "row_hash"), "jaccard-wanted")
    spark = docs.sparkSession
    bits = spark.sparkContext.broadcast(filter_bits(wanted, "row_hash"))

    def passing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, table, given = Hasher(), bits.value, set()
        for batch in batches:
            rows = np.flatnonzero(may_hold(table, batch.column(0).to_numpy()))
            taken, keys, sizes, blobs = [], [], [], []
            for i, row_hash in zip(rows.tolist(), batch.column(0).to_numpy()[rows].tolist()):
                if row_hash in given:
                    continue
                given.add(row_hash)
                found = hasher.sets(batch.column(1)[i].as_py())
                taken.append(row_hash)
                keys.append(_key(found))
                sizes.append(len(found))
                blobs.append(found.tobytes())
            columns = [pa.array(taken, pa.int64()), pa.array(np.array(keys, np.uint64).view(np.int64)), pa.array(sizes, pa.int64())]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(blobs, pa.binary())], names=["row_hash", "key", "n", "shingles"])

    rows = _rows(docs, doc_id, text).where("doc_id is not null").select("row_hash", "text")
    found = rows.mapInArrow(passing, "row_hash long, key long, n long, shingles binary")
    once = found.join(wanted, ["key", "row_hash"], "left_semi").select("key", "n", "shingles")
    return once.dropDuplicates(["key"])


def compare_pairs(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those pairs ``a``, ``b`` of set keys that are similar. A leader with many partners is dealt over
    several cells; cells are dealt to groups of about equal size."""
    sizes = pairs.join(sets.select(F.col("key").alias("b"), "n"), "b").groupBy("a").agg(F.sum("n").alias("total"))
    salts = sizes.select("a", "total", F.ceil(F.col("total") * 8 / CELL_BYTES).cast("int").alias("salts"))
    salts = materialize(salts, "jaccard-leaders")
    groups = _groups(salts, F.sum("total"))
    dealt = pairs.join(salts, "a").select("a", F.pmod(F.xxhash64("b"), "salts").cast("int").alias("salt"), F.col("b").alias("key"), F.lit(False).alias("leads"))
    leaders = salts.select("a", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.col("a").alias("key"), F.lit(True).alias("leads"))
    cells = dealt.unionByName(leaders).withColumn("group", F.pmod(F.xxhash64("a", "salt"), F.lit(groups)))
    return cells.join(sets, "key").groupBy("group").applyInArrow(_compare_leaders, "a long, b long")


def _groups(rows: DataFrame, shingles) -> int:
    total = rows.agg(shingles).first()[0] or 0
    return max(4 * rows.sparkSession.sparkContext.defaultParallelism, math.ceil(total * 8 / CELL_BYTES))


def similar(common: np.ndarray, n: np.ndarray | int, m: np.ndarray | int) -> np.ndarray:
    return (NUMERATOR + DENOMINATOR) * common >= NUMERATOR * (n + m)


def _compare_leaders(group: pa.Table) -> pa.Table:
    group = group.sort_by([("a", "ascending"), ("salt", "ascending"), ("leads", "descending")])
    leader, salt, keys = (group.column(c).to_numpy() for c in ("a", "salt", "key"))
    leads = group.column("leads").to_numpy()
    sets, found, own = group.column("shingles"), [], None
    for i in range(len(keys)):
        here = np.frombuffer(sets[i].as_py(), np.uint64)
        if leads[i]:
            own, cell = here, (leader[i], salt[i])
        elif own is not None and cell == (leader[i], salt[i]):
            at = np.minimum(np.searchsorted(own, here), len(own) - 1)
            if similar(np.count_nonzero(own[at] == here), len(here), len(own)):
                found.append(i)
    return pa.table({"a": leader[found], "b": keys[found]})


def compare_lists(members: DataFrame, roots: DataFrame, classes: DataFrame, docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Links that connect the similar sets of lists whose members are in several components."""
    rooted = members.join(roots, "key", "left").select("list", "key", F.coalesce("component", "key").alias("root"))
    rooted = materialize(rooted, "jaccard-rooted")
    lists = rooted.groupBy("list").agg(
        F.count("*").alias("n"), F.min("root").alias("least"), F.max("root").alias("most"), F.min("key").alias("first"),
        *[F.sum(F.xxhash64(F.lit(s), "key").cast("decimal(38,0)")).alias(f"s{s}") for s in (1, 2)],
    )
    mixed = lists.where("least <> most").groupBy("n", "first", "s1", "s2").agg(F.min("list").alias("list"))
    # lists with the same least member are compared together: they share most others, and each is sent once
    load = mixed.groupBy("first").agg(F.ceil(F.sum("n") / GROUP_MEMBERS).cast("int").alias("spread"))
    mixed = mixed.join(load, "first").select(
        "list", "first", F.pmod(F.xxhash64("list"), "spread").cast("int").alias("share"), F.ceil(F.col("n") / CHUNK_MEMBERS).cast("int").alias("chunks")
    )
    held = materialize(rooted.join(mixed, "list"), "jaccard-mixed")
    dealt = held.withColumn("c", F.pmod(F.xxhash64("key"), "chunks").cast("int"))
    met = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    cells = met.select("first", "share", F.least("c", "other").alias("i"), F.greatest("c", "other").alias("j"), "key", "root").distinct()
    signed = cells.join(classes.select("key", "n", "signature"), "key")
    kept = signed.groupBy("first", "share", "i", "j").applyInArrow(_possible_cell, cells.schema)
    kept = materialize(kept, "jaccard-cells")
    sets = materialize(fetch_sets(docs, classes, kept.select("key").distinct(), doc_id, text), "jaccard-sets")
    found = kept.join(sets, "key").groupBy("first", "share", "i", "j").applyInArrow(_compare_cell, "a long, b long")
    found = materialize(found.distinct(), "jaccard-links")
    drop_tables(rooted, held, kept, sets)
    return found


def _compare_cell(cell: pa.Table) -> pa.Table:
    cell = cell.sort_by("key")
    keys = cell.column("key").to_numpy()
    root = np.unique(cell.column("root").to_numpy(), return_inverse=True)[1]
    if not root.any():
        return pa.table({"a": keys[:0], "b": keys[:0]})
    a, b = spanning_links([np.frombuffer(s, np.uint64) for s in cell.column("shingles").to_pylist()], root)
    return pa.table({"a": keys[a], "b": keys[b]})


def spanning_links(sets: list[np.ndarray], root: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs that connect the groups ``root`` as all similar pairs of sets do, through an index from
    shingle to sets. A set is only compared with those it is not connected to yet."""
    n, root, found = len(sets), root.copy(), []
    sizes = np.array([len(s) for s in sets])
    flat, owner = np.concatenate(sets), np.repeat(np.arange(n), sizes)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    largest = np.bincount(root).argmax()  # its sets are met from the others
    for i in np.flatnonzero(root != largest):
        apart = root != root[i]
        lo, hi = np.searchsorted(flat, sets[i], "left"), np.searchsorted(flat, sets[i], "right")
        spans = hi - lo
        at = np.repeat(lo - (np.cumsum(spans) - spans), spans) + np.arange(spans.sum())
        near = np.flatnonzero(apart & similar(np.bincount(owner[at], minlength=n), sizes[i], sizes))
        for group in np.unique(root[near]):
            found.append((i, near[root[near] == group][0]))
        root[np.isin(root, root[near])] = root[i]
    a, b = zip(*found) if found else ((), ())
    return np.array(a, np.int64), np.array(b, np.int64)


# The join


def join_classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", boundary: int | None = None, long_list: int = LIST_ENTRIES) -> DataFrame:
    """``doc_id``, ``n_shingles``, ``component_id`` of every row.

    Rows whose sets of five-word shingles have a Jaccard similarity of at least 0.8 are linked;
    ``component_id`` is the smallest ``doc_id`` reachable, the row's own included. A text without words, or
    null, has an empty set and links with nothing. A row with a null id takes no part in links and its
    component is null. Repeated rows come back as often as they came, other columns are not read, and an
    empty table gives an empty result. ``boundary`` overrides the chosen one.
    """
    spark = docs.sparkSession
    described = materialize(shingle_sets(docs, doc_id, text), "jaccard-rows")
    rows = described.where("block is null")
    classes = rows.where("doc_id is not null and n > 0").groupBy("key").agg(
        F.min("n").alias("n"), F.min("doc_id").alias("first"), F.min("row_hash").alias("row_hash"), F.first("signature").alias("signature")
    )
    classes = materialize(classes, "jaccard-classes")
    links = _links(spark, docs, described, classes, doc_id, text, boundary, long_list)
    roots = components(links).withColumnsRenamed({"node": "key"})
    named = classes.join(roots, "key", "left").select("key", "first", F.coalesce("component", "key").alias("component"))
    least = named.groupBy("component").agg(F.min("first").alias("least"))
    known = named.join(least, "component").select("key", "least")
    found = rows.join(known, "key", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("doc_id")))
    return found.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))


def _links(spark: SparkSession, docs, described, classes, doc_id, text, boundary, long_list) -> DataFrame:
    table = counter_table(described)
    if boundary is None:
        light = classes.where(F.col("n") <= LONGEST_LIGHT * DENOMINATOR // NUMERATOR).groupBy("n").count()
        boundary = choose_boundary({r.n: r["count"] for r in light.collect()}, table)
    scanned = classes.agg(F.sum(F.col("n") / DENOMINATOR + 1)).first()[0] or 0
    parts = max(4 * spark.sparkContext.defaultParallelism, math.ceil(scanned / PART_ENTRIES))
    above = np.maximum(table - int(np.median(table)), 0)  # less what unrelated shingles add
    rows = _rows(docs, doc_id, text).where("doc_id is not null").select("text")
    sent = rows.mapInArrow(functools.partial(_entries, boundary, above, parts, long_list), "part long, packed binary")
    met = materialize(sent.groupBy("part").applyInArrow(_meet, "list long, a long, b long"), "jaccard-met")
    members = met.where("list is not null").select("list", F.col("a").alias("key"))
    # lists that are dealt over several tasks: their leaders meet the least one
    leaders = met.where("list is not null and b is not null").select("list", F.col("b").alias("leader")).distinct()
    firsts = leaders.groupBy("list").agg(F.min("leader").alias("a"))
    dealt = leaders.join(firsts, "list").where("leader <> a").select("a", F.col("leader").alias("b"))
    pairs = met.where("list is null").select("a", "b").unionByName(dealt).distinct()
    signed = classes.select("key", "n", "signature")
    signed = pairs.join(signed.toDF("a", "n", "left"), "a").join(signed.toDF("b", "m", "right"), "b")
    pairs = materialize(signed.mapInArrow(_possible_pairs, "a long, b long"), "jaccard-pairs")
    ends = pairs.select(F.col("a").alias("key")).unionByName(pairs.select(F.col("b").alias("key"))).distinct()
    sets = materialize(fetch_sets(docs, classes, ends, doc_id, text), "jaccard-sets")
    first = materialize(compare_pairs(pairs, sets), "jaccard-links")
    drop_tables(pairs, sets)
    roots = materialize(components(first).withColumnsRenamed({"node": "key"}), "jaccard-roots")
    second = compare_lists(members, roots, classes, docs, doc_id, text)
    drop_tables(met)
    return first.unionByName(second)
