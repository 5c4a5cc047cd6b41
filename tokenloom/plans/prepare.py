"""From raw text files to train and validation streams."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenloom.operators.bpe import known_letters, segments, train_bpe
from tokenloom.operators.documents import documents, line_chunks, training_lines, with_doc_ids
from tokenloom.operators.encode import encoder
from tokenloom.operators.stream import dataset_stats, read_part, read_stream, split, stream_total, write_stream
from tokenloom.operators.unigram import train_unigram
from tokenloom.operators.vocab import assemble_vocab
from tokenloom.operators.words import alphabet, train_char, train_word, word_counts
from tokenloom.session import materialize, work_path
from tokenloom.sources.corpus import scan_corpus
from tokenloom.sources.token_bin import TOKENS_PER_SHARD, write_tokens


@dataclass
class Prepared:
    vocab: DataFrame
    stream: DataFrame
    parts: DataFrame
    stats: DataFrame


def train_vocab(
    texts: DataFrame,
    vocab_size: int = 32000,
    model: str = "bpe",
    text: str = "text",
    coverage: float = 0.9995,
    max_sentence_length: int = 16384,
    form: str = "identity",
) -> DataFrame:
    """A vocabulary table from texts; ``model`` is ``bpe``, ``unigram``, ``word`` or ``char``."""
    words = materialize(word_counts(texts, text, max_sentence_length, form), "words")
    letters = materialize(alphabet(words, coverage), "alphabet")
    if model == "bpe":
        vocab = assemble_vocab(train_bpe(words, vocab_size, letters), letters, vocab_size)
    elif model in _TRAINERS:
        vocab = assemble_vocab(_TRAINERS[model](covered(words, letters, model), vocab_size), None, vocab_size)
    else:
        raise ValueError(f"unknown model {model}")
    return materialize(vocab, "vocab")


_TRAINERS = {"unigram": train_unigram, "word": train_word, "char": train_char}


def covered(words: DataFrame, letters: DataFrame, model: str) -> DataFrame:
    """Word counts as far as the alphabet covers them: words with another character are left out of a
    word vocabulary, and cut at such characters for the other models."""
    if model != "word":
        return segments(words, letters, 1).withColumnRenamed("s", "word")
    return words.where(F.translate("word", known_letters(letters), "") == "")


def train_from_text(spark: SparkSession, text: str, vocab_size: int = 32000, **options) -> DataFrame:
    """A vocabulary table from one text in hand."""
    return train_vocab(spark.createDataFrame([(text,)], "text string"), vocab_size, **options)


def prepare_all(
    spark: SparkSession,
    raw_path: str,
    vocab_size: int = 32000,
    val_ratio: float | None = None,
    mode: str = "documents",
    model: str = "bpe",
    context_length: int = 2048,
    chunk_size: int = 10_000,
    max_files: int | None = None,
    coverage: float = 0.9995,
    out: str | None = None,
    tokens_per_shard: int | None = TOKENS_PER_SHARD,
) -> Prepared:
    """Train a vocabulary on a text folder, encode it, split it and report on both parts.

    ``documents`` cuts files at blank lines, ends each document with the end id and counts a file
    header; ``chunks`` takes ``chunk_size`` raw lines of a flat folder at a time, without end ids or
    header, trains on stripped lines, and folds compatibility forms and line ends, as a trained
    model without a normalisation rule does. The validation share is 5% or 1% unless given.
    ``max_files`` takes the first files of the folder; broken bytes of the files are left out. With
    ``out`` both parts are written as token files below it, ``train`` and ``val``.
    """
    if mode not in ("documents", "chunks"):
        raise ValueError("mode must be 'documents' or 'chunks'")
    by_document = mode == "documents"
    form = "identity" if by_document else "nfkc"
    lines = scan_corpus(spark, raw_path, recursive=by_document, max_files=max_files, drop_bad_bytes=True)
    if by_document:
        texts = with_doc_ids(documents(lines))
        training = lines
    else:
        chunks = line_chunks(lines, chunk_size)
        texts = with_doc_ids(chunks.withColumnRenamed("chunk_no", "doc_no"))
        training = training_lines(lines)
    vocab = train_vocab(training, vocab_size, model, text="line", coverage=coverage, form=form)
    written = materialize(texts.select("doc_id", "text"), "texts", wide=True)
    path = work_path(spark, "stream")
    write_stream(written, encoder(vocab, model, form), path, add_eos=by_document)
    stream, total = read_stream(spark, path), stream_total(spark, path)
    ratio = (0.05 if by_document else 0.01) if val_ratio is None else val_ratio
    parts = {name: read_part(spark, path, ratio, name) for name in ("train", "val")}
    stats = [
        dataset_stats(part, context_length, header=by_document).withColumn("split", F.lit(name)) for name, part in parts.items()
    ]
    if out is not None:
        for name, part in parts.items():
            write_tokens(part, f"{out.rstrip('/')}/{name}", by_document, tokens_per_shard)
    return Prepared(vocab, stream, split(stream, ratio, total), stats[0].unionByName(stats[1]))
