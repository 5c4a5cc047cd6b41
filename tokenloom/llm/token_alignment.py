"""Alignment of two tokenizers over the same bytes, by pointer jumping.

No token of either tokenizer crosses a single space between two printed characters other than to start
with it, so texts are cut there, and every distinct unit of a block of texts is encoded and aligned once.
Both tokenizers cut a unit's bytes into tokens. Every token points to the farthest-right token that it
overlaps, one of the other tokenizer; a token that ends where its partner ends points to itself. Doubling
the pointers of all tokens of a block together, in vectors, brings each to the terminal token of its
component, in as many steps as the logarithm of the longest chain; the terminal token labels the
group. Links are the pairs of tokens that overlap, one for each stretch between neighbouring cuts.

The count of a pair of ids, the documents that hold it linked, is summed in blocks of texts first. A block
sends its distinct pairs, not its links; the counts come back to the block by pair, to its units, and to
the documents, which hold numbers of units.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import json
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tokenloom.llm.common import materialize, ship_package

BLOCK_BYTES = 3 << 20  # text that is aligned at a time; one text is never cut
_PRINTED = "[!-~\u00c0-\u024f\u0386-\u0481\u048a-\u0556]"
_CUT = re.compile(f"(?<={_PRINTED}) (?={_PRINTED})")


# Fixed value: the pattern by which a byte-level merge file cuts texts before merging.
_BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


# Tokenizers


def _byte_values() -> dict[str, int]:
    # the byte-level alphabet: printable bytes stand for themselves, the others follow from 256
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Pair:
    """The two tokenizers, loaded once in a worker: ``a`` is a byte-level merge file, ``b`` a piece model that
    marks spaces and falls back to bytes."""

    def __init__(self, a: str, b: bytes):
        import sentencepiece
        import tiktoken

        spec = json.loads(a)
        vocab, model, cut = spec["model"]["vocab"], spec["model"], spec["pre_tokenizer"] or {}
        plain = cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space")
        merged = ["".join(m) if isinstance(m, list) else m.replace(" ", "") for m in model["merges"]]
        if spec.get("normalizer") or not plain or [vocab[m] for m in merged] != list(range(256, 256 + len(merged))):
            raise ValueError("the first file must be a byte-level merge vocabulary whose ids follow the merges")
        values = _byte_values()
        self.bytes_a = [b""] * (max(vocab.values()) + 1)
        for piece, i in vocab.items():
            self.bytes_a[i] = bytes(values[c] for c in piece) if i < 256 + len(merged) else b""
        ranks = {piece: i for i, piece in enumerate(self.bytes_a) if piece}
        self.a = tiktoken.Encoding("aligned", pat_str=_BYTE_LEVEL, mergeable_ranks=ranks, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b)
        model = self.b
        self.bytes_b = [
            bytes([int(model.id_to_piece(i)[3:5], 16)]) if model.is_byte(i) else model.id_to_piece(i).replace("▁", " ").encode()
            for i in range(model.vocab_size())
        ]
        self.sizes_a, self.sizes_b = (np.array([len(x) for x in c]) for c in (self.bytes_a, self.bytes_b))
        crossing = [i for i in range(model.vocab_size()) if "▁" in model.id_to_piece(i).lstrip("▁")]
        if crossing:
            raise ValueError(f"{len(crossing)} pieces cross a space, so texts cannot be cut at spaces")
        self.digits = _digits(max(len(self.bytes_a), len(self.bytes_b)))

    def encode(self, units: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of space and unit in ``a``, of the unit in ``b``, which adds the space."""
        encode = self.a.encode_ordinary
        return [encode(" " + u) for u in units], self.b.encode(units, num_threads=1)


def _digits(n: int) -> np.ndarray:
    """The decimal digits of 0 to ``n - 1`` as bytes, zero bytes after them."""
    return np.array([str(i).encode() for i in range(n)], "S6").view(np.uint8).reshape(n, 6)


@dataclass
class Files:
    """The two files as they are sent to the executors."""

    a: str
    b: bytes

    @classmethod
    def read(cls, a: str, b: str) -> Files:
        with open(a, encoding="utf-8") as x, open(b, "rb") as y:
            return cls(x.read(), y.read())


_LOADED: dict[int, Pair] = {}


def _pair(files: Files) -> Pair:
    key = hash((files.a, files.b))
    if key not in _LOADED:
        _LOADED[key] = Pair(files.a, files.b)
    return _LOADED[key]


# Alignment


def jump(ends_a: np.ndarray, ends_b: np.ndarray) -> np.ndarray:
    """The terminal token of every token, numbered ``a`` first. ``ends`` are the byte offsets after the tokens
    of two cuts of the same bytes, ascending."""
    n = len(ends_a)
    last_b = np.searchsorted(ends_b, ends_a, "left")  # the token that holds the last byte
    last_a = np.searchsorted(ends_a, ends_b, "left")
    farther_a, farther_b = ends_b[last_b] > ends_a, ends_a[last_a] > ends_b
    # tokens that end together: that of b is terminal
    meets = ends_b[last_b] == ends_a
    successor = np.concatenate([
        np.where(farther_a | meets, n + last_b, np.arange(n)),
        np.where(farther_b, last_a, n + np.arange(len(ends_b))),
    ])
    while True:
        doubled = successor[successor]
        if np.array_equal(doubled, successor):
            return successor
        successor = doubled


def links(ids_a: np.ndarray, ids_b: np.ndarray, ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of every pair of tokens that overlap, and where the overlap ends."""
    cuts = _runs(np.concatenate([ends_a, ends_b]))[0]
    pairs = ids_a[np.searchsorted(ends_a, cuts, "left")] << 32 | ids_b[np.searchsorted(ends_b, cuts, "left")]
    return pairs, cuts


def group_texts(ids_a, ids_b, groups_a, groups_b, digits: np.ndarray, docs_a, docs_b, n: int) -> list[bytes]:
    """``a1,a2|b1;a3|b2`` for each of ``n`` documents, from ids with their ascending group and document."""
    ids = np.concatenate([ids_a, ids_b])
    group, doc = np.concatenate([groups_a, groups_b]), np.concatenate([docs_a, docs_b])
    side = np.repeat([0, 1], [len(ids_a), len(ids_b)])
    order = np.lexsort((side, group))  # stable: tokens stay in order
    side, group, doc = side[order], group[order], doc[order]
    rows = np.zeros((len(ids), 7), np.uint8)
    rows[:, :6] = digits[ids[order]]
    turns, closes = np.ones(len(ids), bool), np.ones(len(ids), bool)
    turns[:-1], closes[:-1] = side[1:] != side[:-1], group[1:] != group[:-1]
    rows[:, 6] = np.where(closes, ord(";"), np.where(turns, ord("|"), ord(",")))
    used = rows != 0
    flat = rows[used].tobytes()
    bounds = np.concatenate([[0], np.cumsum(used.sum(axis=1))])[np.searchsorted(doc, np.arange(n + 1))]
    return [flat[lo : max(lo, hi - 1)] for lo, hi in zip(bounds.tolist(), bounds[1:].tolist())]


_DOCUMENT = ("n_a", "n_b", "n_groups", "n_links")


def align(docs: DataFrame, files: Files, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Blocks of aligned documents. A row with ``number`` null is a document: ``block``, ``doc_id``, its sizes,
    ``groups_sha256``, and ``held``: its distinct units as numbers of the block with how often they occur. A row
    with ``number`` -1 holds the links of the block's units. The other rows are the distinct links of a block:
    ``number``, ``pair``, ``documents`` that hold it."""
    ship_package(docs.sparkSession)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    longs = [T.StructField(c, T.LongType()) for c in _DOCUMENT]
    schema = T.StructType([
        T.StructField("block", T.StringType()), rows.schema["doc_id"], *longs, T.StructField("groups_sha256", T.StringType()),
        T.StructField("held", T.BinaryType()), T.StructField("number", T.IntegerType()), T.StructField("pair", T.LongType()),
        T.StructField("documents", T.LongType()),
    ])
    sent = docs.sparkSession.sparkContext.broadcast(files)
    return rows.mapInArrow(functools.partial(_align, sent), schema)


def _align(sent, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import uuid

    from pyspark import TaskContext

    pair, run, number = _pair(sent.value), uuid.uuid4().hex, 0
    part = TaskContext.get().partitionId()
    ids, texts, waiting = [], [], 0
    id_type = None
    for batch in batches:
        id_type = batch.schema.field(0).type
        for doc, text in zip(*(c.to_pylist() for c in batch.columns)):
            ids.append(doc)
            texts.append(text or "")
            waiting += len(text or "") + 64
            if waiting >= BLOCK_BYTES:
                yield from _block(pair, f"{part}-{number}-{run}", ids, texts, id_type)
                ids, texts, waiting, number = [], [], 0, number + 1
    if texts:
        yield from _block(pair, f"{part}-{number}-{run}", ids, texts, id_type)


_NAMES = ["block", "doc_id", *_DOCUMENT, "groups_sha256", "held", "number", "pair", "documents"]
_ROWS = 1 << 14


def _block(pair: Pair, block: str, ids: list, texts: list[str], id_type: pa.DataType) -> Iterator[pa.RecordBatch]:
    columns, held, links_of_units, pairs, documents = aligned(pair, texts)
    n = len(ids)
    for lo in range(0, n, _ROWS):
        hi = min(n, lo + _ROWS)
        arrays = [pa.array([block] * (hi - lo)), pa.array(ids[lo:hi], id_type), *(pa.array(columns[c][lo:hi], pa.int64()) for c in _DOCUMENT)]
        arrays += [pa.array(columns["groups_sha256"][lo:hi], pa.string()), pa.array(held[lo:hi], pa.binary())]
        yield pa.RecordBatch.from_arrays([*arrays, pa.nulls(hi - lo, pa.int32()), pa.nulls(hi - lo, pa.int64()), pa.nulls(hi - lo, pa.int64())], names=_NAMES)
    numbers = np.arange(-1, len(pairs), dtype=np.int32)
    for lo in range(0, len(numbers), _ROWS):
        part = numbers[lo : lo + _ROWS]
        size, none = len(part), part < 0
        arrays = [pa.array([block] * size), pa.nulls(size, id_type), *(pa.nulls(size, pa.int64()) for _ in _DOCUMENT), pa.nulls(size, pa.string())]
        arrays += [pa.array([links_of_units if x else None for x in none.tolist()], pa.binary()), pa.array(part)]
        of_pairs = (pa.array(np.where(none, 0, c[part] if len(c) else 0), pa.int64(), mask=none) for c in (pairs, documents))
        yield pa.RecordBatch.from_arrays([*arrays, *of_pairs], names=_NAMES)


def _runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values, ascending, and how often each occurs."""
    values = np.sort(values)
    starts = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.zeros(0, np.int64)
    return values[starts], np.diff(np.append(starts, len(values)))


def _flat(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    counts = np.fromiter(map(len, lists), np.int64, len(lists))
    return np.fromiter(itertools.chain.from_iterable(lists), np.int64, int(counts.sum())), counts


def aligned_units(pair: Pair, units: list[str]) -> tuple[dict[str, np.ndarray], list[bytes], np.ndarray, np.ndarray, np.ndarray]:
    """Sizes and group texts of units, and the distinct pairs and the unit and pair of every link. A unit whose
    tokens do not give its bytes back has none and is not ``whole``."""
    n = len(units)
    a, b = pair.encode(units)
    whole = np.ones(n, bool)
    wanted = [(" " + u).encode("utf-8", "surrogatepass") for u in units]
    sizes = np.fromiter(map(len, wanted), np.int64, n)
    for table, ids, lengths in ((pair.bytes_a, a, pair.sizes_a), (pair.bytes_b, b, pair.sizes_b)):
        flat, counts = _flat(ids)
        joined = b"".join(map(table.__getitem__, flat.tolist()))
        if joined == b"".join(wanted) and np.array_equal(np.bincount(np.repeat(np.arange(n), counts), lengths[flat], n), sizes):
            continue
        whole &= [b"".join(map(table.__getitem__, x)) == w for x, w in zip(ids, wanted)]
    if not whole.all():
        a, b = ([x if w else [] for x, w in zip(c, whole.tolist())] for c in (a, b))
    (ids_a, n_a), (ids_b, n_b) = _flat(a), _flat(b)
    ends_a, ends_b = np.cumsum(pair.sizes_a[ids_a]), np.cumsum(pair.sizes_b[ids_b])
    units_a, units_b = np.repeat(np.arange(n), n_a), np.repeat(np.arange(n), n_b)
    terminal = jump(ends_a, ends_b)
    label = _runs(terminal)[0]  # terminal tokens are of b and ascend with the bytes
    group = np.searchsorted(label, terminal)
    n_groups = np.bincount(units_b[label - len(ids_a)], minlength=n) if len(label) else np.zeros(n, np.int64)
    shown = group_texts(ids_a, ids_b, group[: len(ids_a)], group[len(ids_a) :], pair.digits, units_a, units_b, n)
    linked, cuts = links(ids_a, ids_b, ends_a, ends_b)
    unit = units_a[np.searchsorted(ends_a, cuts, "left")]
    pairs = _runs(linked)[0]
    which = np.searchsorted(pairs, linked)
    sizes = {"n_a": n_a, "n_b": n_b, "n_groups": n_groups, "n_links": np.bincount(unit, minlength=n), "whole": whole}
    return sizes, shown, pairs, unit, which


def _pack(press: Callable[[bytes], bytes], ascending: np.ndarray, *others: np.ndarray) -> bytes:
    """Columns of numbers, the first as steps, byte by byte of equal weight, compressed."""
    flat = np.concatenate([np.diff(ascending, prepend=0), *others]).astype("<u4")
    return press(flat.view(np.uint8).reshape(-1, 4).T.tobytes())


def _unpack(unpress: Callable[[bytes], bytes], blob: bytes, columns: int) -> np.ndarray:
    weights = np.frombuffer(unpress(blob), np.uint8).reshape(4, -1)
    numbers = np.ascontiguousarray(weights.T).view("<u4").reshape(columns, -1).astype(np.int64)
    numbers[0] = np.cumsum(numbers[0])
    return numbers


def aligned(pair: Pair, texts: list[str]) -> tuple[dict[str, list], list[bytes], bytes, np.ndarray, np.ndarray]:
    """The columns of the documents, their units as numbers, the links of the units, the distinct pairs and how
    many documents hold each."""
    n, known, held = len(texts), {}, []
    press = zstandard.ZstdCompressor(level=1).compress
    for text in texts:
        units = _CUT.split(text) if text else []
        for unit in dict.fromkeys(units):
            known.setdefault(unit, len(known))
        held.append(np.fromiter(map(known.__getitem__, units), np.int64, len(units)))
    sizes, shown, pairs, unit, which = aligned_units(pair, list(known))
    held = [h if sizes["whole"][h].all() else h[:0] for h in held]
    columns = {c: [int(sizes[c][h].sum()) for h in held] for c in _DOCUMENT}
    columns["groups_sha256"] = [hashlib.sha256(b";".join(map(shown.__getitem__, h.tolist()))).hexdigest() if len(h) else "" for h in held]
    # distinct units of the documents, with how often they occur
    doc = np.repeat(np.arange(n), [len(h) for h in held])
    own, often = _runs(doc * max(1, len(known)) + np.concatenate([*held, np.zeros(0, np.int64)]))
    owner, numbers = np.divmod(own, max(1, len(known)))
    bounds = np.searchsorted(owner, np.arange(n + 1)).tolist()
    packed = [_pack(press, numbers[lo:hi], often[lo:hi]) for lo, hi in zip(bounds, bounds[1:])]
    # distinct pairs of the units, and through them of the documents
    of_unit, times = _runs(unit * max(1, len(pairs)) + which)
    unit, which = np.divmod(of_unit, max(1, len(pairs)))
    first = np.searchsorted(unit, np.arange(len(known) + 1))
    spans = (first[1:] - first[:-1])[numbers]
    at = np.repeat(first[numbers] - (np.cumsum(spans) - spans), spans) + np.arange(spans.sum())
    in_docs = _runs(np.repeat(owner, spans) * max(1, len(pairs)) + which[at])[0]
    documents = np.bincount(in_docs % max(1, len(pairs)), minlength=len(pairs))
    links_of_units = _pack(press, unit, which, times)
    present = documents > 0  # units that only stand in documents without tokens bring pairs that none holds
    if not present.all():
        place = np.cumsum(present) - 1
        kept = present[which]
        links_of_units = _pack(press, unit[kept], place[which[kept]], times[kept])
        pairs, documents = pairs[present], documents[present]
    return columns, packed, links_of_units, pairs, documents.astype(np.int64)


def aligned_documents(docs: DataFrame, files: Files, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, ``n_a``, ``n_b``, ``n_groups``, ``n_links``, ``n_best``, ``count_sum``, ``groups_sha256`` of every row.

    The text is aligned over the bytes of a space and the text. A text that is null or empty, or whose tokens
    of either file do not give these bytes back, has no tokens: its numbers are zero and its digest is ''. Two
    rows of one id are two documents; null ids stay; other columns are not read; an empty table gives an
    empty result. ``n_best`` counts links whose pair is the most frequent of its ``a`` id, ties included.
    """
    blocks = materialize(align(docs, files, doc_id, text), "aligned")
    pairs = blocks.where("number >= 0").select("block", "number", "pair", "documents")
    counts = materialize(pairs.groupBy("pair").agg(F.sum("documents").alias("count")), "aligned-pairs")
    a = F.shiftright("pair", 32).alias("a")
    best = counts.groupBy(a).agg(F.max("count").alias("best"))
    marked = counts.select("pair", "count", a).join(best, "a").select("pair", "count", (F.col("count") == F.col("best")).alias("best"))
    known = pairs.join(marked, "pair").select(F.col("block").alias("of"), F.col("number").alias("at"), "count", "best")
    held = blocks.where("number is null or number = -1").select("block", "doc_id", *_DOCUMENT, "groups_sha256", "held", "number")
    longs = [T.StructField(c, T.LongType()) for c in (*_DOCUMENT, "n_best", "count_sum")]
    schema = T.StructType([held.schema["doc_id"], *longs, T.StructField("groups_sha256", T.StringType())])
    return held.groupBy("block").cogroup(known.groupBy("of")).applyInArrow(_count, schema)


def _count(held: pa.Table, known: pa.Table) -> pa.Table:
    unpress = zstandard.ZstdDecompressor().decompress
    order = np.argsort(known.column("at").to_numpy())
    counts = known.column("count").to_numpy()[order]
    best = known.column("best").to_numpy()[order]
    inner = held.column("number").is_valid().to_numpy()
    blob = held.filter(pa.array(inner)).column("held")[0].as_py()
    held = held.filter(pa.array(~inner))
    unit, which, times = _unpack(unpress, blob, 3)
    size = int(unit.max()) + 1 if len(unit) else 1
    sum_of, best_of = np.zeros(size, np.int64), np.zeros(size, np.int64)
    np.add.at(sum_of, unit, counts[which] * times)
    np.add.at(best_of, unit, best[which] * times)
    sums, bests = [], []
    for packed in held.column("held").to_pylist():
        numbers, often = _unpack(unpress, packed, 2)
        sums.append(int((sum_of[numbers] * often).sum()))
        bests.append(int((best_of[numbers] * often).sum()))
    made = {c: held.column(c) for c in ("doc_id", *_DOCUMENT)} | {"n_best": pa.array(bests, pa.int64()), "count_sum": pa.array(sums, pa.int64())}
    return pa.table(made | {"groups_sha256": held.column("groups_sha256")})
