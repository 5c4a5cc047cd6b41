"""Language identification by compression with per-language Zstandard dictionaries.

A language is known by a raw-content dictionary: text of that language, which the compressor may
refer back to. A text is encoded with each of them, and the language of the smallest result is the
answer. Texts are compared by their letters alone, in lower case, so that markup, digits and capitals
do not weigh. Where the sizes differ by too little, the answer is rejected.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tokenloom.llm.common import bound_batches, ship_package

DICT_BYTES = 256 << 10  # text a language is learned from, at most
PIECE_CHARS = 1500  # a labelled text is cut to pieces of about so many, so that a dictionary holds many texts
SAMPLE_BYTES = 1 << 20  # distinct pieces chosen per language, about
MAX_LANGS = 256  # more than these are refused: the dictionaries travel with the tasks
LEVEL = 6
CHUNK_BYTES = 4 << 10  # a longer text is encoded in pieces, so that it cannot learn from itself instead
MIN_MARGIN = 0.01
UNKNOWN = "und"

_BUCKETS = 1 << 30


def letters(text: str) -> str:
    """The words of letters of a text and their marks, in lower case, with single spaces; nothing, if it has
    marks but no letter."""
    words = _not_letters().sub(" ", text.lower()).strip()
    return words if words and _letter().search(words) else ""


@functools.cache
def _letter():
    import regex

    return regex.compile(r"\p{L}")


@functools.cache
def _not_letters():
    import regex

    return regex.compile(r"[^\p{L}\p{M}]+")


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether a document is left out of learning; false for a null id, which is not learned from either."""
    return F.coalesce(_fold(doc_id) == 2, F.lit(False))


def _fold(doc_id: str) -> Column:
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4


def learnable(docs: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """The rows that may be learned from when some are held out."""
    return docs.where(_fold(doc_id) != 2)


def learn(labelled: DataFrame, text: str = "text", lang: str = "lang") -> list[tuple[str, int, bytes]]:
    """``(language, documents, dictionary)`` of every language of the labelled rows, sorted by language.

    The counts run over all rows, and the choice over the pieces of whole texts; the dictionaries hold
    ``DICT_BYTES`` each of distinct pieces with a letter, chosen by a hash of their content. Rows with a
    null text or language are passed over, and so is a language none of whose texts has a letter.
    """
    ship_package(labelled.sparkSession)
    bound_batches(labelled.sparkSession)
    rows = labelled.select(F.col(lang).alias("lang"), F.col(text).alias("text")).where("lang is not null and text is not null")
    counts = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).limit(MAX_LANGS + 1).collect()}
    if len(counts) > MAX_LANGS:
        raise ValueError(f"at most {MAX_LANGS} languages can be learned")
    if not counts:
        return []
    known = rows.mapInArrow(functools.partial(_pieces, None), "lang string, at long, size long")
    distinct = known.groupBy("lang", "at").agg(F.max("size").alias("size"))
    sizes = distinct.groupBy("lang").agg(F.sum("size").alias("b")).collect()
    shares = {r.lang: int(_BUCKETS * min(1.0, SAMPLE_BYTES / r.b)) for r in sizes}
    chosen = rows.mapInArrow(functools.partial(_pieces, shares), "lang string, at long, text string")
    chosen = chosen.groupBy("lang", "at").agg(F.min("text").alias("text"))
    made = chosen.select("lang", "text", "at").groupBy("lang").applyInArrow(_dictionary, "lang string, content binary").collect()
    return sorted((r.lang, counts[r.lang], bytes(r.content)) for r in made if len(r.content))


def pieces(text: str) -> Iterator[str]:
    """A whole text in pieces of about ``PIECE_CHARS``, cut at white space where there is some, without
    those that have no letter."""
    at = 0
    while at < len(text):
        space = _WHITE.search(text, at + PIECE_CHARS, at + 2 * PIECE_CHARS)
        end = space.end() if space else at + PIECE_CHARS
        piece = text[at:end]
        if _LETTER.search(piece):
            yield piece
        at = end


_WHITE, _LETTER = re.compile(r"\s"), re.compile(r"[^\W\d_]")


def _pieces(shares: dict[str, int] | None, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hash and size of every piece, or hash and text of those within the share of their language."""
    import xxhash

    for batch in batches:
        made = []
        for lang, text in zip(*(c.to_pylist() for c in batch.columns)):
            for piece in pieces(text):
                data = piece.encode("utf-8", "surrogatepass")
                at = xxhash.xxh3_64_intdigest(data)
                if shares is None:
                    made.append((lang, at - (1 << 63), len(data)))
                elif at % _BUCKETS <= shares[lang]:
                    made.append((lang, at - (1 << 63), piece))
        third = ("size", pa.int64()) if shares is None else ("text", pa.string())
        columns = list(zip(*made)) if made else [()] * 3
        arrays = [pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), third[1]))]
        yield pa.RecordBatch.from_arrays(arrays, names=["lang", "at", third[0]])


def _dictionary(rows: pa.Table) -> pa.Table:
    kept, size, seen = [], 0, set()
    for text in rows.sort_by([("at", "ascending"), ("text", "ascending")]).column("text").to_pylist():
        words = letters(text).encode()
        if words and words not in seen and size < DICT_BYTES:
            seen.add(words)
            kept.append(words)
            size += len(words) + 1
    return pa.table({"lang": rows.column("lang")[:1], "content": pa.array([b" ".join(kept)[:DICT_BYTES]], pa.binary())})


def classify(docs: DataFrame, model: list[tuple[str, int, bytes]], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, ``lang_pred``, ``score``, ``rejected`` of every row's whole text.

    ``score`` is the share by which the smallest encoding is smaller than the next language's (than
    the encoding without a dictionary, if only one language is known), from 0 to 1. Equal sizes go
    to the language with more learned documents, then the first by name, with score 0. A text that
    is null or has no letter is ``und`` with score 0, as is any text where nothing was learned.
    ``rejected`` is true for these and below ``MIN_MARGIN``. Rows stand for themselves; only the two
    columns are read.
    """
    ship_package(docs.sparkSession)
    bound_batches(docs.sparkSession)
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kinds = (T.StringType(), T.DoubleType(), T.BooleanType())
    fields = [rows.schema["doc_id"], *map(T.StructField, ("lang_pred", "score", "rejected"), kinds)]
    return rows.mapInArrow(functools.partial(_classify, model), T.StructType(fields))


def _classify(model, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    size_of = _encoders(model)
    for batch in batches:
        found = [_decide(text, model, size_of) for text in batch.column(1).to_pylist()]
        langs, scores = [f[0] for f in found], [f[1] for f in found]
        rejected = [lang == UNKNOWN or score < MIN_MARGIN for lang, score in found]
        columns = [batch.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(rejected, pa.bool_())]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "lang_pred", "score", "rejected"])


def _encoders(model):
    import zstandard

    def encoder(content: bytes):
        held = {"dict_data": zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)} if content else {}
        set_up = zstandard.ZstdCompressionParameters.from_level(
            LEVEL, source_size=2000, dict_size=len(content), write_content_size=0, write_checksum=0
        )
        compress = zstandard.ZstdCompressor(compression_params=set_up, **held).compress
        return lambda data: sum(len(compress(data[at : at + CHUNK_BYTES])) for at in range(0, len(data), CHUNK_BYTES))

    made = [encoder(content) for _, _, content in model]
    return made if len(made) != 1 else [*made, encoder(b"")]


def _decide(text: str | None, model, size_of) -> tuple[str, float]:
    data = letters(text or "").encode()
    if not data or not model:
        return UNKNOWN, 0.0
    sizes = [encoded(data) for encoded in size_of]
    ranked = sorted((size, -n, lang) for size, (lang, n, _) in zip(sizes, model))
    runner_up = ranked[1][0] if len(ranked) > 1 else sizes[1]
    return ranked[0][2], max(0.0, (runner_up - ranked[0][0]) / runner_up)
