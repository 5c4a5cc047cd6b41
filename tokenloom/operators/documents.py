"""Lines of text files into documents, training lines and encoder chunks.

A line table has the columns ``file``, ``block_start``, ``row_key`` and ``line``; lines are ordered
by ``block_start`` and then ``row_key`` within a file. A block is a bounded piece of one file (a
read split, or a span of table rows), so a file of any size is worked on in parallel. Line groups
that lie inside one block are complete after the one shuffle that brings a block together; only
the fragments at block edges are shuffled again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tokenloom.functions.numbers import div
from tokenloom.functions.positions import running_before
from tokenloom.functions.text import is_blank, strip
from tokenloom.session import materialize

_BLOCK = ["file", "block_start"]


def table_lines(
    docs: DataFrame, text: str = "text", key: str = "doc_id", file: str = "source", docs_per_block: int = 4096
) -> DataFrame:
    """The line table a text export of ``docs`` would give: each text, then a blank line."""
    return docs.select(
        F.col(file).alias("file"),
        (F.col(key) - F.pmod(F.col(key), F.lit(docs_per_block))).alias("block_start"),
        F.col(key),
        F.posexplode(F.concat(F.split(text, "\n"), F.array(F.lit("")))).alias("line_no", "line"),
    ).select("file", "block_start", F.struct(key, "line_no").alias("row_key"), "line")


def documents(lines: DataFrame, keep_newline: bool = True) -> DataFrame:
    """Runs of non-blank lines within a file: ``file``, ``doc_no`` (from 0), ``text``.

    ``keep_newline`` ends the text with a newline, as every line of the run has one. The runs of
    each block are written once; the block edges come from their narrow columns.
    """
    runs = materialize(_block_runs(lines), "runs")
    edges = materialize(_block_edges(runs), "edges")
    pieces = (
        runs.where("run > 0")
        .join(edges, _BLOCK)
        .select(
            "file",
            (F.col("doc_base") + F.col("run") - 1 - F.col("continues").cast("long")).alias("doc_no"),
            "block_start",
            "text",
            ((F.col("opens") & F.col("continues")) | (F.col("closes") & F.col("continued"))).alias("cut"),
        )
    )
    closed = pieces.where("not cut").select("file", "doc_no", "text")
    joined = (
        pieces.where("cut")
        .groupBy("file", "doc_no")
        .agg(F.array_sort(F.collect_list(F.struct("block_start", "text"))).alias("parts"))
        .select("file", "doc_no", F.array_join(F.transform("parts", lambda p: p["text"]), "\n").alias("text"))
    )
    result = closed.unionByName(joined)
    return result.withColumn("text", F.concat("text", F.lit("\n"))) if keep_newline else result


def _block_runs(lines: DataFrame) -> DataFrame:
    """The runs of non-blank lines inside each block, numbered from 1, and whether a run opens or
    closes its block. Run 0 stands for blank lines that open one."""
    in_order = Window.partitionBy(*_BLOCK).orderBy("row_key")
    blank, before = F.col("blank"), F.col("before")
    return (
        lines.withColumn("blank", is_blank(F.col("line")))
        .withColumn("before", F.lag("blank").over(in_order))
        .withColumn("is_last", F.lead("blank").over(in_order).isNull())
        .withColumn("run", F.sum((~blank & F.coalesce(before, F.lit(True))).cast("long")).over(in_order))
        .withColumn("kept", F.when(~blank, F.struct("row_key", "line")))
        .groupBy(*_BLOCK, "run")
        .agg(
            F.array_sort(F.collect_list("kept")).alias("rows"),
            F.bool_or(before.isNull() & ~blank).alias("opens"),
            F.bool_or(F.col("is_last") & ~blank).alias("closes"),
        )
        .select(*_BLOCK, "run", F.array_join(F.transform("rows", lambda r: r["line"]), "\n").alias("text"), "opens", "closes")
    )


def _block_edges(runs: DataFrame) -> DataFrame:
    """Per block: whether its first document began in the block before, whether its last goes on in
    the next one, and how many documents of the file begin ahead of it."""
    by_file = Window.partitionBy("file").orderBy("block_start")
    blocks = runs.groupBy(*_BLOCK).agg(
        F.max("run").alias("starts"), F.bool_or("opens").alias("opens"), F.bool_or("closes").alias("closes")
    )
    return (
        blocks.withColumn("continues", F.col("opens") & F.coalesce(F.lag("closes").over(by_file), F.lit(False)))
        .withColumn("continued", F.coalesce(F.lead("continues").over(by_file), F.lit(False)))
        .withColumn("new", F.col("starts") - F.col("continues").cast("long"))
        .withColumn("doc_base", F.sum("new").over(by_file) - F.col("new"))
        .select(*_BLOCK, "continues", "continued", "doc_base")
    )


def training_lines(lines: DataFrame, line: str = "line") -> DataFrame:
    """Stripped lines, empty ones dropped."""
    return lines.withColumn(line, strip(F.col(line))).where(F.col(line) != "")


def line_chunks(lines: DataFrame, chunk_size: int = 10_000) -> DataFrame:
    """``chunk_size`` consecutive lines of a file per row, newlines kept: ``file``, ``chunk_no``,
    ``text``, ``n_lines``. The last chunk of a file holds what is left. The chunks and parts of chunks
    of each block are written once."""
    numbered = running_before(lines, "line_no", F.lit(1), "block_start", ["row_key"], within=["file"])
    fragments = (
        numbered.withColumn("chunk_no", div(F.col("line_no"), chunk_size))
        .groupBy(*_BLOCK, "chunk_no")
        .agg(
            F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("rows"),
            F.min("line_no").alias("first_line"),
            F.count("*").alias("n_lines"),
        )
        .select(
            "file",
            "chunk_no",
            "first_line",
            "n_lines",
            F.concat(F.array_join(F.transform("rows", lambda r: r["line"]), "\n"), F.lit("\n")).alias("text"),
        )
    )
    parts = materialize(fragments, "chunks", wide=True)
    whole = parts.where(F.col("n_lines") == chunk_size).select("file", "chunk_no", "text", "n_lines")
    rest = (
        parts.where(F.col("n_lines") < chunk_size)
        .groupBy("file", "chunk_no")
        .agg(
            F.array_sort(F.collect_list(F.struct("first_line", "text"))).alias("pieces"),
            F.sum("n_lines").alias("n_lines"),
        )
        .select("file", "chunk_no", F.array_join(F.transform("pieces", lambda p: p["text"]), "").alias("text"), "n_lines")
    )
    return whole.unionByName(rest)


def with_doc_ids(docs: DataFrame) -> DataFrame:
    """Number documents over all files in (file, doc_no) order: adds ``doc_id``.

    The number of documents ahead of a file comes from one row per file.
    """
    ahead = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    files = (
        docs.groupBy("file")
        .agg(F.count("*").alias("n"))
        .select("file", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("base"))
    )
    return docs.join(files, "file").withColumn("doc_id", F.col("base") + F.col("doc_no")).drop("base")
