"""Training of a merge vocabulary over the distinct units of a corpus.

Pairs are ranked by count, then by length and text of the merged piece. A pair that a merge creates
ranks below both the merged pair and the one it replaces: it occurs no more often and is longer. So
the merges made one at a time come in rank order, and a merge depends only on pairs that rank above
it. A round makes every merge that nothing above it can touch, wherever it stands in the ranking:

* no pair above overlaps with it, that is, ends where it starts or starts where it ends. A later
  pair that does would replace one that overlaps with it now and ranks higher still.
* no pair above leads to the same text, now or later. A later one would need a pair above whose
  text starts that text, and one whose text ends it.

A pair whose text is already a piece is never merged, but others may replace it; it counts where a
pair above can do that. Sorted by rank, the merges are those made one at a time.

The driver keeps the counts of the best pairs only (``_WATCHED``), each round adds what its merges
changed: units without one of its pairs give nothing. A pair that is not kept can only lose
occurrences, so it matters when the kept ones fall behind the last one kept; then the pairs are
counted again. Units travel in packed blocks and are rewritten every few rounds; those that are one
symbol then go.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokenloom.functions.pairs import BLOCKS, MERGED, Batch, change_counter, counter, packer, rewriter, symbols_of
from tokenloom.functions.tables import MAX_PIECE_CHARS, PIECE_BASE
from tokenloom.functions.text import characters
from tokenloom.operators.words import alphabet as corpus_alphabet
from tokenloom.session import bound_batches, materialize, remove, ship_package, work_path

# Characters of the supplementary private-use planes are left out of training and encoded as bytes;
# the first of them marks cuts.
_FIRST_CODE = 0xF0000
_PRIVATE = f"[{chr(0xF0000)}-{chr(0x10FFFF)}]"
_WATCHED = 16_384
_UNITS_PER_TASK = 500_000
_PENDING_LIMIT = 12
_NONE: frozenset[int] = frozenset()


def known_letters(letters: DataFrame) -> str:
    """The alphabet as one string; Unicode bounds it."""
    return "".join(r.char for r in letters.where(~F.col("char").rlike(_PRIVATE)).select("char").collect())


def segments(words: DataFrame, letters: DataFrame, least: int = 2) -> DataFrame:
    """Units cut at characters outside the alphabet: ``s``, ``n``; those of ``least`` characters and more.

    The alphabet is a constant string (Unicode bounds it), which makes the check one hash lookup per
    character; few units hold a character outside it.
    """
    known = known_letters(letters)
    gap = F.lit(chr(_FIRST_CODE))
    foreign = F.translate("word", known, "")
    parted = F.call_function("translate", F.col("word"), F.col("foreign"), F.repeat(gap, F.length("foreign")))
    parts = F.when(F.col("foreign") == "", F.array("word")).otherwise(F.split(parted, gap))
    return (
        words.withColumn("foreign", foreign)
        .select(F.explode(parts).alias("s"), "n")
        .where(F.length("s") >= least)
        .groupBy("s")
        .agg(F.sum("n").alias("n"))
    )


def pair_counts(state: DataFrame) -> DataFrame:
    """Occurrences of each pair of neighbours: ``pair``, ``c``. In ``aaa`` the pair counts twice."""
    pairs = F.regexp_extract_all("s", F.lit("(?s)(?=(..))."), F.lit(1))
    return state.select(F.explode(pairs).alias("pair"), "n").groupBy("pair").agg(F.sum("n").alias("c"))


def _top_pairs(counts: DataFrame, texts: Sequence[str], limit: int) -> list[tuple[int, int]]:
    """The best ``limit`` pairs and their counts, in rank order."""
    table = F.from_json(F.lit(json.dumps(list(texts))), "array<string>")

    def text(symbol: Column) -> Column:
        return F.when(symbol >= MERGED, F.get(table, (symbol - MERGED).cast("int"))).otherwise(
            F.decode(F.unhex(F.lpad(F.hex(symbol), 8, "0")), "UTF-32")
        )

    both = F.concat("left", "right")
    top = (
        counts.select("pair", "c", text(F.shiftright("pair", 21)).alias("left"), text(F.col("pair") % (1 << 21)).alias("right"))
        .where(F.length(both) <= MAX_PIECE_CHARS)
        .orderBy(F.desc("c"), F.length(both), both, "left")
        .limit(limit)
        .select("pair", "c")
    )
    return [(r.pair, r.c) for r in top.collect()]


class _Ranking:
    """The best pairs, with nothing missing down to ``last``, and the merges made so far."""

    def __init__(self) -> None:
        self.texts: list[str] = []
        self.made: dict[str, tuple] = {}  # text of a merge: its rank
        self.merges: list[tuple[tuple, tuple[str, str]]] = []
        self.counts: dict[int, int] = {}
        self.ties: dict[int, tuple] = {}  # what ranks pairs of one count
        self.last: tuple | None = None

    def text(self, symbol: int) -> str:
        return self.texts[symbol - MERGED] if symbol >= MERGED else chr(symbol)

    def rank(self, pair: int) -> tuple:
        if pair not in self.ties:
            left, right = map(self.text, symbols_of(pair))
            self.ties[pair] = (len(left + right), (left + right).encode(), left.encode())
        return (-self.counts[pair], *self.ties[pair])

    def fill(self, rows: list[tuple[int, int]], whole: bool) -> None:
        self.counts, self.ties = dict(rows), {}
        self.last = None if whole or not rows else self.rank(rows[-1][0])

    def add(self, changes: list[tuple[int, int]]) -> None:
        for pair, d in changes:
            left, right = map(self.text, symbols_of(pair))
            if len(left + right) <= MAX_PIECE_CHARS:
                self.counts[pair] = self.counts.get(pair, 0) + d
        for pair in [p for p, c in self.counts.items() if c <= 0 or (self.last and self.rank(p) > self.last)]:
            del self.counts[pair]
            self.ties.pop(pair, None)
        if len(self.counts) > 2 * _WATCHED:
            order = sorted(self.counts, key=self.rank)
            self.last = self.rank(order[_WATCHED - 1])
            for pair in order[_WATCHED:]:
                del self.counts[pair]
                self.ties.pop(pair, None)

    def ready(self, beyond: tuple | None) -> list[int]:
        """Pairs that can be merged now; those ranked after ``beyond`` are not needed."""
        chosen: list[int] = []
        texts: set[str] = set()  # of all pairs above
        open_texts: set[str] = set()  # of those that will be merged
        lefts: set[int] = set()
        rights: set[int] = set()
        all_lefts: set[int] = set()
        all_rights: set[int] = set()
        before: dict[int, set[int]] = {}  # what precedes a symbol in pairs that are left alone
        after: dict[int, set[int]] = {}

        def waits(left: int, right: int, text: str) -> bool:
            if left in rights or right in lefts or text in open_texts:
                return True
            if not before.get(left, _NONE).isdisjoint(all_rights) or not after.get(right, _NONE).isdisjoint(all_lefts):
                return True
            inner = range(2, len(text))
            return any(text[:i] in texts for i in inner) and any(text[-i:] in texts for i in inner)

        for rank, pair in sorted((self.rank(p), p) for p in self.counts):
            if beyond and rank > beyond:
                break
            left, right = symbols_of(pair)
            text = self.text(left) + self.text(right)
            if text in self.made:
                before.setdefault(right, set()).add(left)
                after.setdefault(left, set()).add(right)
            else:
                if not open_texts or not waits(left, right, text):
                    chosen.append(pair)
                open_texts.add(text)
                lefts.add(left)
                rights.add(right)
            texts.add(text)
            all_lefts.add(left)
            all_rights.add(right)
        return chosen

    def merge(self, pairs: list[int]) -> Batch:
        symbols = {}
        for pair in pairs:
            left, right = map(self.text, symbols_of(pair))
            rank = self.rank(pair)
            symbols[pair] = MERGED + len(self.texts)
            self.texts.append(left + right)
            self.made[left + right] = rank
            self.merges.append((rank, (left, right)))
        self.merges.sort()
        return tuple(np.array(x, np.int64) for x in zip(*sorted(symbols.items())))


def train_merges(words: DataFrame, letters: DataFrame, n_pieces: int) -> list[tuple[str, str]]:
    """The merges that give ``n_pieces`` new pieces, in order. A pair whose text is already a piece
    is left alone."""
    spark = words.sparkSession
    ship_package(spark)
    bound_batches(spark)
    units = segments(words, letters).select(F.transform(characters(F.col("s")), F.ascii).alias("symbols"), "n")
    path = work_path(spark, "bpe")
    units.write.parquet(path)
    state = spark.read.parquet(path)
    tasks = max(spark.sparkContext.defaultParallelism, state.count() // _UNITS_PER_TASK)
    state = state.repartition(tasks).mapInArrow(packer, BLOCKS)
    ranking = _Ranking()
    pending: list[Batch] = []

    def rewrite() -> None:
        nonlocal state, path
        old, path = path, work_path(spark, "bpe")
        state.mapInArrow(rewriter(pending), BLOCKS).write.parquet(path)
        state = spark.read.schema(BLOCKS).parquet(path)
        pending.clear()
        remove(spark, old)

    rewrite()
    while n_pieces > 0:
        beyond = ranking.merges[n_pieces - 1][0] if len(ranking.merges) >= n_pieces else None
        chosen = ranking.ready(beyond)
        if not chosen and (ranking.last or not ranking.merges):
            if beyond and ranking.last and ranking.last > beyond:
                break
            found = state.mapInArrow(counter(pending), "pair long, d long").groupBy("pair").agg(F.sum("d").alias("c"))
            rows = _top_pairs(found, ranking.texts, _WATCHED)
            ranking.fill(rows, len(rows) < _WATCHED)
            chosen = ranking.ready(beyond)
            if not chosen and ranking.last and not beyond:
                raise RuntimeError("more pairs lead to pieces that are there than are watched")
        if not chosen:
            break
        pending.append(ranking.merge(chosen))
        watched = np.array(sorted(ranking.counts), np.int64)
        newest = int(pending[-1][1].min())
        least = -ranking.last[0] if ranking.last else 1
        fresh = (F.shiftright("pair", 21) >= newest) | (F.col("pair") % (1 << 21) >= newest)
        changes = (
            state.mapInArrow(change_counter(pending, watched), "pair long, d long")
            .groupBy("pair")
            .agg(F.sum("d").alias("d"))
            .where((F.col("d") != 0) & (~fresh | (F.col("d") >= least)))
            .orderBy(fresh, F.desc("d"))
            .limit(len(watched) + _WATCHED)
            .toArrow()
        )
        rows = list(zip(changes["pair"].to_pylist(), changes["d"].to_pylist()))
        if len(rows) == len(watched) + _WATCHED:  # the least of the new pairs may be missing
            ranking.last = min(ranking.last or (0,), (-rows[-1][1],))
        ranking.add(rows)
        if len(pending) >= _PENDING_LIMIT:
            rewrite()
    remove(spark, path)
    return [merge for _, merge in ranking.merges[:n_pieces]]


def train_bpe(
    words: DataFrame, vocab_size: int = 32000, letters: DataFrame | None = None, coverage: float = 0.9995
) -> DataFrame:
    """Trained pieces with the pair each came from: ``rank``, ``left``, ``right``, ``piece``.

    ``words`` is read several times; hand in a written table.
    """
    spark = words.sparkSession
    if letters is None:
        letters = materialize(corpus_alphabet(words, coverage), "alphabet")
    merges = train_merges(words, letters, vocab_size - PIECE_BASE - letters.count())
    rows = [(rank, left, right, left + right) for rank, (left, right) in enumerate(merges)]
    return spark.createDataFrame(rows, "rank long, left string, right string, piece string")
