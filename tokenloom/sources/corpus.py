"""Text corpora: reading line tables and prompts, writing document exports and results."""

from __future__ import annotations

from urllib.parse import unquote, urlparse

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenloom.functions.positions import first_rows
from tokenloom.functions.text import strip


def _is_file(spark: SparkSession, path: str) -> bool:
    found = [r.path for r in spark.read.format("binaryFile").load(path).select("path").head(2)]
    return len(found) == 1 and unquote(urlparse(found[0]).path) == urlparse(path).path.rstrip("/")


def scan_corpus(
    spark: SparkSession,
    path: str | list[str],
    recursive: bool = True,
    max_files: int | None = None,
    drop_bad_bytes: bool = False,
) -> DataFrame:
    """The lines of text files: ``file``, ``block_start``, ``row_key``, ``line``.

    ``path`` is a file, a list of files, or a folder whose ``*.txt`` files are read, those of its
    subfolders too if ``recursive``. ``max_files`` takes the first files in path order. Large files
    are read in splits; ``(block_start, row_key)`` is the line order within a file. Broken UTF-8
    shows as replacement characters; ``drop_bad_bytes`` leaves it out, and keeps replacement
    characters that are in the text.
    """
    if isinstance(path, list) or _is_file(spark, path):
        source = spark.read.text(path)
    else:
        options = {"pathGlobFilter": "*.txt", "recursiveFileLookup": str(recursive).lower()}
        files = spark.read.format("binaryFile").options(**options).load(path).select("path")
        if max_files:
            chosen = [r.path for r in files.orderBy("path").limit(max_files).collect()]
            if not chosen:
                raise ValueError(f"no .txt files found in {path}")
            source = spark.read.text(chosen)
        else:
            if files.isEmpty():
                raise ValueError(f"no .txt files found in {path}")
            source = spark.read.options(**options).text(path)
    line = F.col("value")
    if drop_bad_bytes:
        line = _valid_only(line)
    return source.select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block_start"),
        F.monotonically_increasing_id().alias("row_key"),
        line.alias("line"),
    )


def _valid_only(text: Column) -> Column:
    """A text without its broken bytes. Real replacement characters are written with two characters
    that stand for nothing in Unicode while the broken bytes are replaced and taken out."""
    mark, own, real, shown = "\ufdd0", "\ufdd0\ufdd1", "\ufdd0\ufdd2", "\ufffd"
    steps = ((mark, own), (shown, real))
    for old, new in steps:
        text = F.replace(text, F.lit(old), F.lit(new))
    text = F.replace(F.make_valid_utf8(text), F.lit(shown), F.lit(""))
    for old, new in reversed(steps):
        text = F.replace(text, F.lit(new), F.lit(old))
    return text


def scan_prompts(spark: SparkSession, path: str) -> DataFrame:
    """One stripped, non-empty prompt per row with its line order: ``prompt_no``, ``prompt``."""
    lines = spark.read.text(path).select(strip(F.col("value")).alias("prompt"))
    return lines.where("prompt != ''").select(F.monotonically_increasing_id().alias("prompt_no"), "prompt")


def export_corpus(
    docs: DataFrame,
    path: str,
    text: str = "text",
    order_by: str = "doc_id",
    limit: int | None = None,
    partition_by: str | None = None,
) -> None:
    """Write each text followed by a blank line, in document order over the part files. ``limit``
    keeps the first documents, found on their keys, those with a null key ahead; ``partition_by`` makes one folder per value, of
    as many files as its share of the rows asks for."""
    folder = [] if partition_by is None else [partition_by]
    chosen = docs
    if limit is not None:
        unkeyed, keyed = docs.where(F.col(order_by).isNull()).limit(limit), docs.where(F.col(order_by).isNotNull())
        room = limit - unkeyed.count()
        last = first_rows(keyed.select(order_by), [order_by], room).agg(F.max(order_by).alias("m")).first().m if room else None
        chosen = unkeyed
        if last is not None:
            below = keyed.where(F.col(order_by) < F.lit(last))
            ties = keyed.where(F.col(order_by) == F.lit(last)).limit(room - below.count())
            chosen = unkeyed.unionByName(below).unionByName(ties)
    writer = chosen.orderBy(*folder, order_by).select(text, *folder).write.option("lineSep", "\n\n")
    if partition_by is not None:
        writer = writer.partitionBy(partition_by)
    writer.text(path)


RESULT_SEPARATOR = "\n\n---\n\n"


def write_results(results: DataFrame, path: str, result: str = "result", order_by: str | None = None) -> None:
    """Write each result followed by a separator line."""
    ordered = results if order_by is None else results.orderBy(order_by)
    ordered.select(result).write.option("lineSep", RESULT_SEPARATOR).text(path)


def read_results(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("lineSep", RESULT_SEPARATOR).text(path).withColumnRenamed("value", "result")
