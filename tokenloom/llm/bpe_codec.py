"""BPE encoding and decoding through a table of distinct words.

Texts are cut at ASCII white space, which no token of the vocabulary crosses. A scan turns runs of
documents into blocks: a block has its own list of distinct words, and its documents become
positions in that list. The words of all blocks are dealt by a hash, so that the copies of a word
meet in one task, which encodes it once. Its ids go back to the blocks that listed it, and there to
the documents by their positions. What is shuffled is packed: the distinct words of blocks, their
ids, and compressed positions; never a row for each word of the corpus.

Decoding looks the ids up in the id-to-piece table, which has one row for each vocabulary entry.
"""

from __future__ import annotations

import functools
import itertools
import json
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tokenloom.llm.common import materialize, ship_package, word_windows

BLOCK_WORDS = 1 << 20  # distinct words after which a block ends
BLOCK_BYTES = 12 << 20  # text after which a block ends
CHUNK_WORDS = 1 << 18  # words of a block whose positions are one row
WORDS_HELD = 1 << 19  # encoded words a task remembers
MAX_PIECES = 1 << 20  # a vocabulary larger than this is refused
ENCODE_BATCH = 4096


def read_tokenizer(path: str) -> str:
    """The vocabulary file as text; small enough to go along with the tasks, which is checked."""
    with open(path, encoding="utf-8") as file:
        spec = file.read()
    if len(json.loads(spec)["model"]["vocab"]) > MAX_PIECES:
        raise ValueError(f"a vocabulary holds at most {MAX_PIECES} pieces")
    return spec


@functools.lru_cache(maxsize=2)
def _tokenizer(spec: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark already runs a task on each core
    from tokenizers import Tokenizer

    made = Tokenizer.from_str(spec)
    made.no_truncation()
    made.no_padding()
    return made


def encode(docs: DataFrame, spec: str, doc_id: str = "doc_id", text: str = "text", stored: bool = False) -> DataFrame:
    """``doc_id``, ``ids`` of every row's whole text, as the library encodes it without added specials.

    A null or empty text gives an empty list. Rows stand for themselves: repeated rows and null ids
    come back as often as they came. Other columns of ``docs`` are not read. An empty table gives an
    empty table.

    The blocks are cut twice, once for their words and once for their positions. ``stored`` says that
    ``docs`` is read from files with no shuffle between, so that both cuts are the same; other frames
    are written first. A block whose two cuts differ raises an error.
    """
    spark = docs.sparkSession
    ship_package(spark)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("binary").alias("text"))
    rows = rows if stored else materialize(rows, "bpe-texts")
    key, parts = rows.schema["doc_id"], int(spark.conf.get("spark.sql.shuffle.partitions"))
    listed = rows.mapInArrow(functools.partial(_words, parts), "part int, block long, mark long, at binary, words binary")
    dictionary = listed.repartition(parts, "part").mapInArrow(
        functools.partial(_encode_words, spec), "of_block long, mark long, at binary, sizes binary, ids binary"
    )
    held = T.StructField("doc_ids", T.ArrayType(key.dataType))
    kinds = {"block": T.LongType(), "mark": T.LongType(), "sizes": T.BinaryType(), "codes": T.BinaryType()}
    coded = rows.mapInArrow(_positions, T.StructType([*(T.StructField(n, t) for n, t in kinds.items()), held]))
    out = T.StructType([key, T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return coded.groupBy("block").cogroup(dictionary.groupBy("of_block")).applyInArrow(_put_back, out)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[bytes], list, list[np.ndarray]]]:
    """``(number, distinct words, document ids, positions per document)`` of each block of a partition."""
    base = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 32
    ids, codes, size, number = [], [], 0, 0
    words = defaultdict(itertools.count().__next__)
    parts = (batch.slice(lo, 512) for batch in batches for lo in range(0, batch.num_rows, 512))
    for part in parts:
        for row, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
            lists = [np.fromiter(map(words.__getitem__, w), np.uint32, len(w)) for w in word_windows(text or b"")]
            ids.append(row)
            codes.append(lists[0] if len(lists) == 1 else np.concatenate([np.zeros(0, np.uint32), *lists]))
            size += len(text or b"")
            if size > BLOCK_BYTES or len(words) > BLOCK_WORDS:
                yield base + number, list(words), ids, codes
                ids, codes, size, number = [], [], 0, number + 1
                words = defaultdict(itertools.count().__next__)
    if ids:
        yield base + number, list(words), ids, codes


@functools.cache
def _zstd():
    import zstandard

    return zstandard.ZstdCompressor(level=1)


@functools.cache
def _unzstd():
    import zstandard

    return zstandard.ZstdDecompressor()


def _packed(numbers: np.ndarray) -> bytes:
    """Whole numbers below 2^32, byte by byte of equal weight, compressed."""
    return _zstd().compress(np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes())


def _unpacked(blob: bytes) -> np.ndarray:
    planes = np.frombuffer(_unzstd().decompress(blob), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel()


def _words(parts: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for block, words, _, _ in _blocks(batches):
        mark = zlib.crc32(b" ".join(words))
        dealt = np.fromiter(map(zlib.crc32, words), np.uint32, len(words)) % parts
        order = np.argsort(dealt, kind="stable")
        cuts = np.searchsorted(dealt[order], np.arange(parts + 1))
        for lo in range(0, parts, 256):
            used = [p for p in range(lo, min(parts, lo + 256)) if cuts[p] < cuts[p + 1]]
            own = [order[cuts[p] : cuts[p + 1]] for p in used]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(used, pa.int32()), pa.array([block] * len(used), pa.int64()), pa.array([mark] * len(used), pa.int64()),
                    pa.array([_packed(np.diff(o, prepend=0)) for o in own], pa.binary()),
                    pa.array([_zstd().compress(b" ".join([words[i] for i in o.tolist()])) for o in own], pa.binary()),
                ],
                names=["part", "block", "mark", "at", "words"],
            )


def _encode_words(spec: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    library = _tokenizer(spec)
    known: dict[bytes, list[int]] = {}
    for batch in batches:
        columns = [batch.column(i).to_pylist() for i in range(1, 5)]
        for block, mark, at, joined in zip(*columns):
            words = _unzstd().decompress(joined).split(b" ")
            fresh = [w for w in words if w not in known]
            for lo in range(0, len(fresh), ENCODE_BATCH):
                part = fresh[lo : lo + ENCODE_BATCH]
                texts = [w.decode("utf-8", "replace") for w in part]
                known.update(zip(part, (e.ids for e in library.encode_batch(texts, add_special_tokens=False))))
            found = [known[w] for w in words]
            sizes = np.fromiter(map(len, found), "<u4", len(found))
            ids = np.fromiter(itertools.chain.from_iterable(found), "<u4", int(sizes.sum()))
            if len(known) > WORDS_HELD:
                known.clear()  # a word may be encoded again then
            yield pa.RecordBatch.from_arrays(
                [pa.array([x], t) for x, t in ((block, pa.int64()), (mark, pa.int64()), (at, pa.binary()), (_packed(sizes), pa.binary()), (_packed(ids), pa.binary()))],
                names=["of_block", "mark", "at", "sizes", "ids"],
            )


def _positions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = None

    def watched():
        nonlocal kind
        for batch in batches:
            kind = batch.schema.field(0).type
            yield batch

    for block, words, ids, codes in _blocks(watched()):
        mark = zlib.crc32(b" ".join(words))
        sizes = np.fromiter(map(len, codes), np.int64, len(codes))
        lo = 0
        while lo < len(ids):
            hi = max(lo + 1, lo + int(np.searchsorted(np.cumsum(sizes[lo:]), CHUNK_WORDS, "right")))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([block], pa.int64()), pa.array([mark], pa.int64()), pa.array([_packed(sizes[lo:hi])], pa.binary()),
                    pa.array([_packed(np.concatenate(codes[lo:hi]))], pa.binary()), pa.array([ids[lo:hi]], pa.list_(kind)),
                ],
                names=["block", "mark", "sizes", "codes", "doc_ids"],
            )
            lo = hi


def _put_back(rows: pa.Table, dictionary: pa.Table) -> pa.Table:
    """The ids of a block's documents from the positions of their words in the block's list."""
    if len({*rows.column("mark").to_pylist(), *dictionary.column("mark").to_pylist()}) > 1:
        raise ValueError("the documents changed between two readings; pass stored=False")

    def joined(name, unpack=_unpacked):
        return np.concatenate([np.zeros(0, np.int64), *map(unpack, dictionary.column(name).to_pylist())]).astype(np.int64)

    at, length = joined("at", lambda blob: np.cumsum(_unpacked(blob), dtype=np.int64)), joined("sizes")
    flat = joined("ids").astype(np.int32)
    first, count = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
    first[at], count[at] = np.cumsum(length) - length, length
    kind = rows.schema.field("doc_ids").type.value_type
    schema = pa.schema([("doc_id", kind), ("ids", pa.list_(pa.int32()))])
    made = []
    for sizes, blob, held in zip(*(rows.column(c) for c in ("sizes", "codes", "doc_ids"))):
        codes = _unpacked(blob.as_py())
        spans = count[codes]
        ends = np.cumsum(spans)
        total = int(ends[-1]) if len(ends) else 0
        ids = flat[np.repeat(first[codes] - ends + spans, spans) + np.arange(total)]
        bounds = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(_unpacked(sizes.as_py()), dtype=np.int64)])]
        lists = pa.LargeListArray.from_arrays(pa.array(bounds), pa.array(ids)).cast(pa.list_(pa.int32()))
        made.append(pa.RecordBatch.from_arrays([held.values, lists], schema=schema))
    return pa.Table.from_batches(made, schema)


def pieces(spark: SparkSession, spec: str) -> DataFrame:
    """The id-to-piece table: ``id``, ``piece`` of every vocabulary entry and added token."""
    library = _tokenizer(spec)
    rows = [(i, library.id_to_token(i)) for i in range(library.get_vocab_size(with_added_tokens=True))]
    return spark.createDataFrame(rows, "id int, piece string")


def decode(df: DataFrame, table: DataFrame, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """Add ``text``: the pieces of an id column joined by spaces, special tokens included.

    That is the library's decoding for a vocabulary without a decoder of its own. Ids without a
    piece are left out, as there; null ids give a null text. The table is gathered into one array of
    at most ``MAX_PIECES`` entries, which is what a row's ids are joined to.
    """
    listed = table.groupBy().agg(F.array_sort(F.collect_list(F.struct("id", "piece"))).alias("t"))
    whole = (F.size("t") <= MAX_PIECES) & (F.coalesce(F.get("t", F.size("t") - 1)["id"], F.lit(-1)) + 1 == F.size("t"))
    by_id = F.when(whole, F.transform("t", lambda r: r["piece"])).otherwise(F.raise_error(F.lit("pieces need ids from 0, each once")))
    joined = F.array_join(F.transform(F.col(ids), lambda i: F.get(F.col("_pieces"), i)), " ")
    return df.withColumn("_pieces", listed.select(by_id.alias("t")).scalar()).withColumn(text, joined).drop("_pieces")


def ids_digest(df: DataFrame, pieces: int, ids: str = "ids", name: str = "ids_sha256") -> DataFrame:
    """Add ``name``: SHA-256, in lower-case hex, of ids as little-endian unsigned 32-bit integers; null
    for null. ``pieces`` is the size of the vocabulary; an id outside it raises an error."""
    if pieces > MAX_PIECES:
        raise ValueError(f"a vocabulary holds at most {MAX_PIECES} pieces")
    i = F.col(ids)

    def in_hex(number: Column) -> Column:
        return F.concat(*[F.lpad(F.hex(F.shiftright(number, 8 * k).bitwiseAND(F.lit(255))), 2, "0") for k in range(4)])

    table = df.sparkSession.range(1).select(F.transform(F.sequence(F.lit(0), F.lit(pieces - 1)), in_hex).alias("t"))
    joined = F.array_join(F.transform(i, lambda x: F.get(F.col("_hex"), x)), "")
    outside = (F.array_max(i) >= pieces) | (F.array_min(i) < 0)
    known = F.when(outside, F.raise_error(F.lit("an id that is not in the vocabulary")).cast("string")).otherwise(joined)
    return df.withColumn("_hex", table.scalar()).withColumn(name, F.sha2(F.unhex(known), 256)).drop("_hex")
