"""Repeated passages across documents: paragraph MinHash with banding.

A paragraph is a line of at least ``MIN_WORDS`` words, or a run of shorter lines, up to a blank or a long
one, that has as many together. Exact copies are one paragraph, known by a hash
of its words. The distinct ones get a MinHash signature of their five-word shingles, cut to bands
that are tuned for high recall at the threshold; paragraphs that share a band are joined and their
exact Jaccard similarity is checked. Components of what is similar are one passage: its first place
stays and the others are removed.

What is left is searched for passages that lie inside longer paragraphs or run over their ends: every
run of ``PASSAGE_WORDS`` words that stands word for word in another document is found. Each such run
has a least shingle, its anchor, that all its copies share; only runs whose anchor stands in several
documents are hashed whole and counted. All of this is sums by hash, never pairs of places.

Bands and anchors are packed: a task sends those of its texts in a few blocks for each part of the hash
space, and only what several share becomes rows.

Members of a band that many share are cut to chunks, and every pair of chunks is a task's work, so a
band of any size is checked in full by tasks of bounded size. A task checks a pair only while the two
are not connected yet and gives spanning links, so neither work nor rows grow with all pairs of
copies. Bands with the same members are checked once.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tokenloom.llm.common import among, bound_batches, drop_tables, materialize, ship_package
from tokenloom.llm.components import components

SHINGLE = 5
THRESHOLD = 0.8
MIN_WORDS = 20  # shorter paragraphs are no passages: headings, licence lines, boilerplate
PASSAGE_WORDS = 50  # a run of so many words that other documents hold is a passage wherever it lies
HASHES = 64
RECALL = 0.999
CHUNK_MEMBERS = 2048
PART_BYTES = 1 << 24  # text whose bands and anchors one task compares, about
SEED = 11

_WINDOW = 1 << 16  # shingles hashed at a time
_KEYS_HELD = 1 << 17
_ROWS_HELD = 512
_CHARS_AT_ONCE = 1 << 19
_WORD = re.compile(r"\S+")
_MIX = 0x9E3779B97F4A7C15


def tune(threshold: float = THRESHOLD, hashes: int = HASHES, recall: float = RECALL) -> tuple[int, int]:
    """Bands and rows per band: the longest bands, then the fewest, with which ``hashes`` find a pair
    at the threshold with probability ``recall``."""
    for rows in range(hashes, 0, -1):
        for bands in range(1, hashes // rows + 1):
            if 1 - (1 - threshold**rows) ** bands >= recall:
                return bands, rows
    raise ValueError("too few hashes for this recall")


def word_hashes(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """A hash of every word of a text, cut at ASCII white space, and where the words start. Eight bytes of
    all words are mixed at a time."""
    flat = np.frombuffer(text, np.uint8)
    inside = np.concatenate([[False], ~_IS_WHITE[flat], [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, sizes = edges[::2], edges[1::2] - edges[::2]
    eights = np.ndarray(len(text) + 1, "<u8", text + bytes(8), strides=(1,))
    made = sizes.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)
    left, at = np.flatnonzero(sizes <= _LONG_WORD), 0
    while len(left):
        rest = sizes[left] - at
        mixed = (made[left] ^ (eights[starts[left] + at] & _MASKS[np.minimum(rest, 8)])) * np.uint64(_MIX)
        made[left] = mixed ^ (mixed >> np.uint64(32))
        left, at = left[rest > 8], at + 8
    for i in np.flatnonzero(sizes > _LONG_WORD):
        made[i] = _xxh64(text[starts[i] : starts[i] + sizes[i]])
    return made, starts


def _xxh64(data: bytes) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(data)


_LONG_WORD = 256
_IS_WHITE = np.zeros(256, bool)
_IS_WHITE[[*range(9, 14), *range(28, 33)]] = True
_WHITE = re.compile(rb"[\t-\r\x1c- ]")
_WIDE_WHITE = re.compile("[\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")  # with these, what str.split cuts at
_MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)

Block = tuple[int, int, int, int, int]


class Paragraphs:
    """Paragraphs of texts as runs of word hashes."""

    def __init__(self, min_words: int):
        self.min_words = min_words

    def cut(self, texts: Iterable[str | None]) -> Iterator[tuple[list[Block], np.ndarray]]:
        """The blocks of each text and the hashes of its words, in lower case. A block is ``(number of the
        first line, start, end, first word, word after the last)`` of a long line or of a run of short
        lines, short ones among them; places count characters of the text. Words are hashed over about
        ``_CHARS_AT_ONCE`` together."""
        some, size = [], 0
        for text in texts:
            some.append(text or "")
            size += len(some[-1])
            if size >= _CHARS_AT_ONCE:
                yield from self._cut(some)
                some, size = [], 0
        yield from self._cut(some)

    def _cut(self, texts: list[str]) -> Iterator[tuple[list[Block], np.ndarray]]:
        lower = "\n".join(texts).lower()
        if not lower.isascii():
            lower = _WIDE_WHITE.sub(" ", lower)
        data = lower.encode("utf-8", "surrogatepass")
        hashes, ends, lo, n = [np.zeros(0, np.uint64)], [], 0, 0
        while lo < len(data):
            space = _WHITE.search(data, lo + _CHARS_AT_ONCE)
            window = data[lo : space.end() if space else len(data)]
            made, starts = word_hashes(window)
            ends += (n + np.searchsorted(starts, np.flatnonzero(np.frombuffer(window, np.uint8) == 10))).tolist()
            hashes.append(made)
            n += len(made)
            lo += len(window)
        words = np.concatenate(hashes)
        ends, lo = iter([*ends, n]), 0
        for text in texts:
            lines = text.split("\n")
            blocks, first, hi = self._blocks(lines, ends, lo)
            yield blocks, words[first:hi]
            lo = hi

    def _blocks(self, lines: list[str], ends: Iterator[int], first: int) -> tuple[list[Block], int, int]:
        blocks, held, at, lo = [], None, 0, first
        for number, line in enumerate(lines):
            hi, end = next(ends), at + len(line)
            if held and not 0 < hi - lo < self.min_words:
                blocks.append(held)
                held = None
            if hi - lo >= self.min_words:
                blocks.append((number, at, end, lo - first, hi - first))
            elif hi > lo and held:
                held = (*held[:2], end, held[3], hi - first)
            elif hi > lo:
                held = (number, at, end, lo - first, hi - first)
            at, lo = end + 1, hi
        return ([*blocks, held] if held else blocks), first, lo

    def of(self, blocks: list[Block], words: np.ndarray) -> Iterator[tuple[int, int, int, np.ndarray, bytes]]:
        """``(number, start, end, word hashes, key)`` of each block that is long enough."""
        import xxhash

        for number, start, end, lo, hi in blocks:
            if hi - lo >= self.min_words:
                yield number, start, end, words[lo:hi], xxhash.xxh3_128_digest(words[lo:hi].tobytes())


def _mixed(words: np.ndarray) -> np.ndarray:
    """Hashes of the five-word shingles of one run of words."""
    mixed = np.zeros(max(0, len(words) - SHINGLE + 1), np.uint64)
    for k in range(SHINGLE):
        mixed = mixed * np.uint64(0x100000001B3) + words[k : k + len(mixed)]
    mixed ^= mixed >> np.uint64(31)
    mixed *= np.uint64(_MIX)
    mixed ^= mixed >> np.uint64(29)
    return mixed


def shingles(words: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the five-word shingles of runs of words, and how many each run has; a run shorter
    than a shingle has none."""
    mixed = _mixed(words)
    counts = np.maximum(sizes - SHINGLE + 1, 0)
    starts = np.cumsum(sizes) - sizes
    own = np.repeat(starts - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
    return mixed[own], counts


def least_of(values: np.ndarray, size: int) -> np.ndarray:
    """The least of every ``size`` neighbours."""
    if len(values) < size:
        return values[:0]
    made, held = values, 1
    while 2 * held <= size:
        made, held = np.minimum(made[:-held], made[held:]), 2 * held
    return made if held == size else np.minimum(made[: len(values) - size + 1], made[size - held :])


def run_hashes(words: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of every run of ``size`` words."""
    made = []
    for base in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F):
        count = max(0, len(words) - size + 1)
        total, done, block, held = np.zeros(count, np.uint64), 0, words, 1
        while done < size and count:  # blocks of doubling size
            power = np.uint64(pow(base, held, 1 << 64))
            if size & held:
                total, done = total * power + block[done : done + count], done + held
            block, held = block[:-held] * power + block[held:], 2 * held
        made.append(total)
    return made[0], made[1]


def anchors(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The shingles that are the least of a run of ``PASSAGE_WORDS`` words, and where they start."""
    hashed = _mixed(words)
    size = PASSAGE_WORDS - SHINGLE + 1
    least = least_of(hashed, size)
    if not len(least):
        return hashed[:0], np.zeros(0, np.int64)
    around = np.concatenate([np.zeros(size - 1, np.uint64), least, np.zeros(size - 1, np.uint64)])
    at = np.flatnonzero(~least_of(~around, size) == hashed)
    return hashed[at], at


def signatures(words: np.ndarray, sizes: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One hash for each band of each run; every run has a shingle."""
    rng = np.random.default_rng(SEED)
    factors = rng.integers(1, 1 << 63, bands * rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    shifts = rng.integers(0, 1 << 63, bands * rows, dtype=np.uint64)
    hashed, counts = shingles(words, sizes)
    made = np.full((len(sizes), bands), 0, np.uint64)
    ends = np.cumsum(counts)
    lo = 0
    while lo < len(sizes):
        hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] + _WINDOW)))
        part = hashed[ends[lo] - counts[lo] : ends[hi - 1]]
        starts = ends[lo:hi] - counts[lo:hi] - (ends[lo] - counts[lo])
        for band in range(bands):
            mixed = np.full(hi - lo, band + 1, np.uint64)
            for r in range(band * rows, (band + 1) * rows):
                mixed = (mixed ^ np.minimum.reduceat(part * factors[r] + shifts[r], starts)) * np.uint64(_MIX)
                mixed ^= mixed >> np.uint64(32)
            made[lo:hi, band] = mixed
        lo = hi
    return made


def _rows(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("text_hash"), F.col(text).alias("text"))
    return rows.where("doc_id is not null")


def paragraphs(docs: DataFrame, parts: int, min_words: int = MIN_WORDS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, ``text_hash``, ``para_no``, ``start``, ``stop``, ``n_words``, ``key`` of every paragraph, and rows
    without a key that hold a task's ``bands`` (band and key) or ``anchors`` (shingle, document and first
    line) of one ``part`` of the hash space, packed."""
    ship_package(docs.sparkSession)
    bound_batches(docs.sparkSession)
    rows = _rows(docs, doc_id, text).withColumn("row_hash", F.xxhash64("doc_id", "text_hash"))
    kinds = (T.LongType(), T.IntegerType(), T.LongType(), T.LongType(), T.IntegerType(), T.BinaryType(), T.IntegerType(), T.BinaryType(), T.BinaryType())
    schema = T.StructType([rows.schema["doc_id"], *map(T.StructField, _PLACE[1:], kinds)])
    return rows.mapInArrow(functools.partial(_paragraphs, max(min_words, SHINGLE), tune(), parts), schema)


_PLACE = ("doc_id", "text_hash", "para_no", "start", "stop", "n_words", "key", "part", "bands", "anchors")


def _paragraphs(min_words: int, shape: tuple[int, int], parts: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    cut = Paragraphs(min_words)
    bands, rows = shape
    packed: dict[str, list[np.ndarray]] = {"bands": [], "anchors": []}
    id_type, seen, waiting = None, set(), 0
    held, words = [], []

    def places() -> pa.RecordBatch:
        types = (id_type, pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
        arrays = [pa.array(c, t) for c, t in zip(zip(*held), types)]
        nulls = [pa.nulls(len(held), t) for t in (pa.int32(), pa.binary(), pa.binary())]
        return pa.RecordBatch.from_arrays([*arrays, *nulls], names=_PLACE)

    def sign() -> None:
        # bands of the paragraphs that are new to this task, with the first half of the key
        keys = np.frombuffer(b"".join(key[:8] for key, _ in words), ">u8").astype(np.uint64)
        flat = np.concatenate([hashes for _, hashes in words])
        found = signatures(flat, np.array([len(hashes) for _, hashes in words]), bands, rows)
        packed["bands"].append(np.stack([found.ravel(), np.repeat(keys, bands)]))

    def blocks() -> Iterator[pa.RecordBatch]:
        for at, kind in enumerate(("bands", "anchors")):
            if not packed[kind]:
                continue
            entries = np.concatenate(packed[kind], axis=1)
            packed[kind].clear()
            part = (entries[0] % np.uint64(parts)).astype(np.int32)
            order = np.argsort(part, kind="stable")
            cuts = np.flatnonzero(np.diff(part[order], prepend=-1))
            found = [entries[:, order[lo:hi]].tobytes() for lo, hi in zip(cuts, [*cuts[1:], len(order)])]
            n = len(cuts)
            types = (id_type, pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
            two = [pa.array(found, pa.binary()), pa.nulls(n, pa.binary())]
            yield pa.RecordBatch.from_arrays([*(pa.nulls(n, t) for t in types), pa.array(part[order[cuts]]), *(two if at == 0 else two[::-1])], names=_PLACE)

    for batch in (b.slice(at, _ROWS_HELD) for b in batches for at in range(0, b.num_rows, _ROWS_HELD)):
        id_type = batch.schema.field(0).type
        ids, versions, texts, row_hashes = (c.to_pylist() for c in batch.columns)
        for doc, version, row_hash, (of_text, all_words) in zip(ids, versions, row_hashes, cut.cut(texts)):
            for number, start, end, hashes, key in cut.of(of_text, all_words):
                held.append((doc, version, number, start, end, len(hashes), key))
                if key in seen:
                    continue
                if len(seen) >= _KEYS_HELD:
                    seen.clear()
                seen.add(key)
                words.append((key, hashes.copy()))
                waiting += len(hashes)
                if waiting >= 8 * _WINDOW:
                    sign()
                    words, waiting = [], 0
            if len(all_words) >= PASSAGE_WORDS:
                hashed, at = anchors(all_words)
                numbers, lengths = zip(*((b[0], b[4] - b[3]) for b in of_text))
                line_of = np.repeat(np.array(numbers, np.uint64), lengths)[at]
                found = np.stack([hashed, np.full(len(at), row_hash, np.int64).view(np.uint64), line_of])
                once = np.unique(hashed, return_index=True)[1]
                packed["anchors"].append(found if len(once) == len(hashed) else np.unique(found, axis=1))
        if held:
            yield places()
            held = []
        if sum(x.shape[1] for kind in packed.values() for x in kind) >= _FLUSH:
            yield from blocks()
    if words:
        sign()
    if id_type is not None:
        yield from blocks()


_FLUSH = 1 << 18


def _shared_bands(part: pa.Table) -> pa.Table:
    """The members of bands that several paragraphs have; of bands with the same members, one."""
    blocks = [np.frombuffer(b, np.uint64).reshape(2, -1) for b in part.column("bands").to_pylist()]
    band, key = np.concatenate(blocks, axis=1)
    order = np.lexsort((key, band))
    band, key = band[order], key[order]
    fresh = np.concatenate([[True], (band[1:] != band[:-1]) | (key[1:] != key[:-1])])
    band, key = band[fresh], key[fresh]
    opens = np.concatenate([[True], band[1:] != band[:-1]])
    number, starts = np.cumsum(opens) - 1, np.flatnonzero(opens)
    sizes = np.bincount(number)
    mixed = (key ^ (key >> np.uint64(33))) * np.uint64(_MIX)
    sums = np.stack([sizes.astype(np.uint64), np.add.reduceat(mixed, starts), np.bitwise_xor.reduceat(key, starts)])
    shared = np.flatnonzero(sizes > 1)
    kept = np.zeros(len(sizes), bool)
    kept[shared[np.unique(sums[:, shared], axis=1, return_index=True)[1]]] = True
    at = np.flatnonzero(kept[number])
    return pa.table({"band": band[at].view(np.int64), "half": key[at].view(np.int64)})


def _shared_anchors(part: pa.Table) -> pa.Table:
    """The places of shingles that are anchors in several documents."""
    blocks = [np.frombuffer(b, np.uint64).reshape(3, -1) for b in part.column("anchors").to_pylist()]
    anchor, row, line = np.concatenate(blocks, axis=1)
    order = np.lexsort((row, anchor))
    anchor, row, line = anchor[order], row[order], line[order]
    opens = np.concatenate([[True], anchor[1:] != anchor[:-1]])
    number, starts = np.cumsum(opens) - 1, np.flatnonzero(opens)
    several = np.minimum.reduceat(row, starts) != np.maximum.reduceat(row, starts)
    at = np.flatnonzero(several[number])
    return pa.table({"anchor": anchor[at].view(np.int64), "row_hash": row[at].view(np.int64), "line": line[at].astype(np.int32)})


def passages(docs: DataFrame, min_words: int = MIN_WORDS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Every place of every passage that occurs more than once: ``doc_id``, ``para_no``, ``start``,
    ``stop`` (characters), ``n_words``, ``kept_doc_id``, ``kept_para_no``, ``removed``, ``text_hash``.

    Passages are the components of paragraphs whose five-word shingle sets have a Jaccard similarity
    of at least ``THRESHOLD``, words compared in lower case. The first place by ``doc_id`` and number is
    kept; ``para_no`` is the number of a place's first line. In what these leave, passages are also the
    longest runs of words, over ends of lines too, each ``PASSAGE_WORDS`` words of which stand word for
    word in another document; the document with the smallest id keeps them, and places may overlap.
    Copies inside a paragraph that are changed more often than that are not found. Rows with a null id,
    null or empty texts and shorter paragraphs take no part; of rows that repeat an id, equal places are
    told apart by their text and otherwise count as one place each. Other columns are not read; an empty
    table gives an empty result.
    """
    total = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    parts = max(4 * docs.sparkSession.sparkContext.defaultParallelism, -(-total // PART_BYTES))
    scanned = materialize(paragraphs(docs, parts, min_words, doc_id, text), "paragraphs")
    members = scanned.where("bands is not null").groupBy("part").applyInArrow(_shared_bands, "band long, half long")
    members = materialize(members, "band-members")
    spots = scanned.where("anchors is not null").groupBy("part").applyInArrow(_shared_anchors, "anchor long, row_hash long, line int")
    spots = materialize(spots, "anchors")
    places = materialize(scanned.where("key is not null").select(*_PLACE[:7]), "places")
    drop_tables(scanned)
    whole = materialize(similar_paragraphs(docs, places, members, min_words, doc_id, text), "passages")
    drop_tables(places, members)
    return whole.unionByName(inner_passages(docs, spots, whole, min_words, doc_id, text))


def similar_paragraphs(docs: DataFrame, places: DataFrame, members: DataFrame, min_words: int, doc_id: str, text: str) -> DataFrame:
    """The places of paragraphs that are like another one."""
    roots = components(similar(docs, places, members, min_words, doc_id, text)).withColumnsRenamed({"node": "key"})
    where = F.struct("doc_id", "para_no")
    keys = places.groupBy("key").agg(F.min(where).alias("first"), F.count("*").alias("n"))
    known = keys.join(roots, "key", "left").withColumn("component", F.coalesce("component", "key"))
    groups = known.groupBy("component").agg(F.min("first").alias("kept"), F.sum("n").alias("n")).where("n > 1")
    repeated = known.select("key", "component").join(groups.select("component", "kept"), "component").select("key", "kept")
    found = places.join(repeated, "key")
    return found.select(
        "doc_id", "para_no", "start", "stop", "n_words",
        F.col("kept.doc_id").alias("kept_doc_id"), F.col("kept.para_no").alias("kept_para_no"),
        (where != F.col("kept")).alias("removed"), "text_hash",
    )


def inner_passages(docs: DataFrame, spots: DataFrame, whole: DataFrame, min_words: int, doc_id: str, text: str) -> DataFrame:
    """The places of runs of ``PASSAGE_WORDS`` words and more that other documents hold as well, in
    what is left without the removed places of ``whole``."""
    row = ["doc_id", "text_hash"]
    gone = whole.where("removed").select(F.xxhash64(*row).alias("row_hash"), F.col("para_no").alias("line")).distinct()
    left = materialize(spots.join(gone, ["row_hash", "line"], "left_anti").select("anchor", "row_hash"), "anchors-left")
    drop_tables(spots)
    shared = left.groupBy("anchor").agg(F.min("row_hash").alias("a"), F.max("row_hash").alias("b")).where("a <> b").select("anchor")
    sought = left.join(shared, "anchor").groupBy("row_hash").agg(F.collect_set("anchor").alias("sought"))
    gone = gone.groupBy("row_hash").agg(F.collect_set("line").alias("gone"))
    sought = materialize(sought.join(gone, "row_hash", "left"), "anchors-sought")
    rows = _rows(docs, doc_id, text).withColumn("row_hash", F.xxhash64(*row))
    rows = among(rows, "row_hash", sought.select("row_hash")).join(sought, "row_hash")  # texts move once
    near = materialize(rows.select(*row, "text", "sought", "gone"), "passages-near")
    drop_tables(left, sought)
    id_type = near.schema["doc_id"]
    kinds = (T.LongType(), T.IntegerType(), T.LongType(), T.LongType())
    runs = T.StructType([id_type, *map(T.StructField, ("text_hash", "para_no", "h", "g"), kinds)])
    size = max(min_words, SHINGLE)
    held = materialize(near.mapInArrow(functools.partial(_runs, size), runs), "passages-runs")
    firsts = held.groupBy("h", "g").agg(F.min(F.struct("doc_id", "para_no")).alias("first"), F.max("doc_id").alias("last"))
    firsts = firsts.where("first.doc_id <> last").select("h", "g", "first")
    marked = held.join(firsts, ["h", "g"]).groupBy(*row).agg(
        F.collect_set(F.struct("h", "g", F.col("first.doc_id").alias("doc_id"), F.col("first.para_no").alias("para_no"))).alias("marks")
    )
    kinds = (T.IntegerType(), T.LongType(), T.LongType(), T.IntegerType(), id_type.dataType, T.IntegerType(), T.BooleanType(), T.LongType())
    names = ("para_no", "start", "stop", "n_words", "kept_doc_id", "kept_para_no", "removed", "text_hash")
    schema = T.StructType([id_type, *map(T.StructField, names, kinds)])
    marked = materialize(marked, "passages-marked")
    drop_tables(held)
    found = near.drop("sought").join(marked, row).select(*row, "text", "gone", "marks")
    return found.mapInArrow(functools.partial(_spans, size), schema).distinct()


def _left(blocks: list[Block], gone: list[int] | None) -> Iterator[list[Block]]:
    """The blocks of a text in stretches without a removed one."""
    held, away = [], set(gone or ())
    for block in blocks:
        if block[0] not in away:
            held.append(block)
        elif held:
            yield held
            held = []
    if held:
        yield held


def _stretch(blocks: list[Block], words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of a stretch and the block of each word."""
    return words[blocks[0][3] : blocks[-1][4]], np.repeat(np.arange(len(blocks)), [b[4] - b[3] for b in blocks])


def _spread(lists: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The values of an Arrow column of lists and where those of each row start; the last number is their end."""
    return lists.flatten(), np.concatenate([[0], np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))])


def _runs(min_words: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    cut = Paragraphs(min_words)
    for batch in batches:
        ids, versions = batch.column(0), batch.column(1)
        sought, bounds = _spread(batch.column(3))
        sought = np.asarray(sought, np.int64).view(np.uint64)
        rows = zip(cut.cut(batch.column(2).to_pylist()), batch.column(4).to_pylist())
        made, waiting = [], 0

        def out():
            here, *columns = (pa.array(np.concatenate(c)) for c in zip(*made))
            return pa.RecordBatch.from_arrays([ids.take(here), versions.take(here), *columns], names=["doc_id", "text_hash", "para_no", "h", "g"])

        for i, ((all_blocks, all_words), gone) in enumerate(rows):
            anchored = sought[bounds[i] : bounds[i + 1]]
            of_text = []
            for blocks in _left(all_blocks, gone):
                words, block = _stretch(blocks, all_words)
                least = least_of(_mixed(words), PASSAGE_WORDS - SHINGLE + 1)
                at = np.flatnonzero(np.isin(least, anchored))
                if len(at):
                    h, g = (x[at].view(np.int64) for x in run_hashes(words, PASSAGE_WORDS))
                    of_text.append((np.array([b[0] for b in blocks], np.int32)[block[at]], h, g))
            if not of_text:
                continue
            numbers, h, g = (np.concatenate(c) for c in zip(*of_text))
            order = np.lexsort((g, h))  # the first of equal runs stands for them
            again = (h[order[1:]] == h[order[:-1]]) & (g[order[1:]] == g[order[:-1]])
            once = order[np.concatenate([[True], ~again])]
            made.append((np.full(len(once), i), numbers[once], h[once], g[once]))
            waiting += len(once)
            if waiting >= _WINDOW:
                yield out()
                made, waiting = [], 0
        if made:
            yield out()


def _spans(min_words: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    cut = Paragraphs(min_words)
    for batch in batches:
        made = []
        ids, versions, texts, gone = (batch.column(c).to_pylist() for c in range(4))
        marks, bounds = _spread(batch.column(4))
        marked = [np.asarray(marks.field(c), np.int64) for c in ("h", "g")]
        kept_places = [marks.field(c) for c in ("doc_id", "para_no")]
        for i, (all_blocks, all_words) in enumerate(cut.cut(texts)):
            lo, hi = bounds[i], bounds[i + 1]
            of_row = marked[0][lo:hi]
            runs = zip(of_row.tolist(), marked[1][lo:hi].tolist())
            known = dict(zip(runs, zip(*(c.slice(lo, hi - lo).to_pylist() for c in kept_places))))
            for blocks in _left(all_blocks, gone[i]):
                words, block = _stretch(blocks, all_words)
                h, g = (x.view(np.int64) for x in run_hashes(words, PASSAGE_WORDS))
                among_marks = np.flatnonzero(np.isin(h, of_row))
                spans: list[list] = []  # first word, last word, kept place
                for at, pair in zip(among_marks.tolist(), zip(h[among_marks].tolist(), g[among_marks].tolist())):
                    kept = known.get(pair)
                    if kept is None:
                        continue
                    if spans and spans[-1][1] == at + PASSAGE_WORDS - 2 and spans[-1][2][0] == kept[0]:
                        spans[-1][1] += 1
                    else:
                        spans.append([at, at + PASSAGE_WORDS - 1, kept])
                starts = blocks[0][3]
                found: dict[int, list[tuple[int, int]]] = {}

                def place(word: int) -> tuple[int, int]:
                    number = block[word]
                    _, start, end, first, _ = blocks[number]
                    if number not in found:
                        found[number] = [(start + m.start(), start + m.end()) for m in _WORD.finditer(texts[i][start:end])]
                    return found[number][starts + word - first]

                for first, last, kept in spans:
                    number, size = blocks[block[first]][0], last - first + 1
                    made.append((ids[i], number, place(first)[0], place(last)[1], size, *kept, kept[0] != ids[i], versions[i]))
        kind = batch.schema.field(0).type
        kinds = (kind, pa.int32(), pa.int64(), pa.int64(), pa.int32(), kind, pa.int32(), pa.bool_(), pa.int64())
        names = ["doc_id", "para_no", "start", "stop", "n_words", "kept_doc_id", "kept_para_no", "removed", "text_hash"]
        columns = list(zip(*made)) if made else [()] * len(kinds)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)


def similar(docs: DataFrame, places: DataFrame, members: DataFrame, min_words: int, doc_id: str, text: str) -> DataFrame:
    """Edges ``a``, ``b`` between paragraph keys that span all similar pairs the bands bring together."""
    # bands of different parts that hold the same members are one
    sets = members.groupBy("band").agg(
        F.count("*").alias("n"), F.min("half").alias("least"),
        *[F.sum(F.xxhash64(F.lit(s), "half").cast("decimal(38,0)")).alias(f"s{s}") for s in (1, 2)],
    )
    once = sets.groupBy("n", "least", "s1", "s2").agg(F.min("band").alias("band")).select("band", F.ceil(F.col("n") / CHUNK_MEMBERS).cast("int").alias("chunks"))
    dealt = members.join(once, "band").withColumn("c", F.pmod(F.xxhash64("half"), "chunks").cast("int"))
    met = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    cells = met.select("band", F.least("c", "other").alias("i"), F.greatest("c", "other").alias("j"), "half")
    # one place of every paragraph that is compared
    halves = members.select("half").distinct()
    first = F.min(F.struct("doc_id", "text_hash")).alias("first")
    known = places.withColumn("half", F.conv(F.hex(F.substring("key", 1, 8)), 16, -10).cast("long")).join(halves, "half").groupBy("key").agg(first)
    sought = known.groupBy("first.doc_id", "first.text_hash").agg(F.collect_set("key").alias("keys"))
    sought = materialize(sought.withColumn("row_hash", F.xxhash64("doc_id", "text_hash")).drop("doc_id", "text_hash"), "paragraphs-sought")
    rows = _rows(docs, doc_id, text).select(F.xxhash64("doc_id", "text_hash").alias("row_hash"), "text")
    rows = among(rows, "row_hash", sought.select("row_hash")).join(sought, "row_hash")
    sets_of = rows.select("text", "keys").mapInArrow(functools.partial(_sets, max(min_words, SHINGLE)), "key binary, half long, shingles binary")
    sets_of = sets_of.groupBy("key").agg(F.first("half").alias("half"), F.first("shingles").alias("shingles"))
    return cells.join(sets_of, "half").groupBy("band", "i", "j").applyInArrow(_verify, "a binary, b binary")


def _sets(min_words: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    cut = Paragraphs(min_words)
    for batch in batches:
        keys, blobs = [], []
        for (blocks, words), sought in zip(cut.cut(batch.column(0).to_pylist()), batch.column(1).to_pylist()):
            wanted = set(sought)
            for _, _, _, hashes, key in cut.of(blocks, words):
                if key in wanted:
                    wanted.discard(key)
                    keys.append(key)
                    blobs.append(np.unique(_mixed(hashes)).tobytes())
        halves = pa.array(np.frombuffer(b"".join(k[:8] for k in keys), ">i8").astype(np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), halves, pa.array(blobs, pa.binary())], names=["key", "half", "shingles"])


def _verify(cell: pa.Table) -> pa.Table:
    cell = cell.sort_by("key")
    keys = cell.column("key").to_pylist()
    tied, root = spanning_links([np.frombuffer(b, np.uint64) for b in cell.column("shingles").to_pylist()])
    return pa.table({"a": pa.array([keys[i] for i in tied], pa.binary()), "b": pa.array([keys[i] for i in root], pa.binary())})


def spanning_links(sets: list[np.ndarray], threshold: float = THRESHOLD) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs that connect what pairs of sets with at least the threshold's similarity connect.

    A set is compared with those that are not connected to it yet, through an index from shingle to
    sets.
    """
    n = len(sets)
    sizes = np.array([len(s) for s in sets])
    flat, owner = np.concatenate(sets), np.repeat(np.arange(n), sizes)
    order = np.argsort(flat, kind="stable")
    opens = np.flatnonzero(np.concatenate([[True], flat[order[1:]] != flat[order[:-1]]]))
    own, ends = np.empty((2, len(flat)), np.int64)  # for every shingle of a set, where its owners are
    shared = np.diff(opens, append=len(flat))
    own[order], ends[order] = np.repeat(opens, shared), np.repeat(opens + shared, shared)
    owner, places = owner[order], np.cumsum(sizes) - sizes
    root = np.arange(n)
    for i in range(n):
        apart = root != root[i]
        if not apart.any():
            break
        lo = own[places[i] : places[i] + sizes[i]]
        spans = ends[places[i] : places[i] + sizes[i]] - lo
        at = np.repeat(lo - (np.cumsum(spans) - spans), spans) + np.arange(spans.sum())
        common = np.bincount(owner[at], minlength=n)
        near = np.flatnonzero(apart & (common * (1 + threshold) >= threshold * (sizes[i] + sizes) - 1e-9))
        if len(near):
            joined = np.unique(root[near])
            root[np.isin(root, joined)] = root[i]
            root[root == root[i]] = min(int(joined[0]), int(root[i]))
    tied = np.flatnonzero(root != np.arange(n))
    return tied, root[tied]


def remove(docs: DataFrame, found: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with the removed places cut out of ``text``, whole lines with their ends; a text that is
    emptied by it goes. Rows without a removed place, null ids among them, are unchanged, and columns stay."""
    ship_package(docs.sparkSession)
    bound_batches(docs.sparkSession)
    cuts = found.where("removed").groupBy(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).agg(
        F.array_sort(F.collect_set(F.struct("start", "stop"))).alias("_cuts")
    )
    joined = docs.join(cuts, (F.col(doc_id) == F.col("_id")) & (F.xxhash64(text) == F.col("_hash")), "left")
    cut = F.arrow_udf(_without, "string")
    left = cut(F.when(F.col("_cuts").isNotNull(), F.col(text)), F.col("_cuts.start"), F.col("_cuts.stop"))
    after = F.when(F.col("_cuts").isNull(), F.col(text)).otherwise(left)
    kept = joined.withColumn(text, after).where(F.col("_cuts").isNull() | (F.trim(F.col(text)) != ""))
    return kept.select(*docs.columns)


def _without(texts: pa.Array, starts: pa.Array, stops: pa.Array) -> pa.Array:
    rows = zip(texts.to_pylist(), starts.to_pylist(), stops.to_pylist())
    return pa.array([None if text is None else without(text, list(zip(lo, hi))) for text, lo, hi in rows], pa.string())


def without(text: str, spans: list[tuple[int, int]]) -> str:
    """``text`` without the spans, which are sorted and may overlap. A span of whole lines goes with a
    line end, one inside a line with a space beside it; one over a line end leaves a line end."""
    merged: list[list[int]] = []
    for start, stop in spans:
        if merged and start <= merged[-1][1]:
            merged[-1][1] = max(stop, merged[-1][1])
        else:
            merged.append([start, stop])
    left, at = "", 0
    for start, stop in merged:
        left += text[at:start]
        at = stop
        opens, closes = start == 0 or text[start - 1] == "\n", stop == len(text) or text[stop] == "\n"
        if opens and closes:
            at = min(stop + 1, len(text))
            left = left.removesuffix("\n") if stop == len(text) else left
        elif closes:
            left = left.removesuffix(" ")
        elif "\n" in text[start:stop] and not opens:
            left = left.removesuffix(" ") + "\n"
            at += text[stop] == " "
        else:
            at += text[stop] == " "
    return left + text[at:]
