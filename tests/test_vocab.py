import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tokenloom.functions import lattice, pairs
from tokenloom.functions.pieces import UnitEncoder, best_path, expected_pieces, merge_pieces, unknown_score
from tokenloom.functions.text import units
from tokenloom.operators import bpe, encode, unigram, vocab, words
from tokenloom.plans.prepare import train_vocab
from tokenloom.session import materialize
from tokenloom.sources import vocab_files

TEXTS = [
    "The cat  sat on the mat. The cat sat!!",
    "123 cats, 45 mats\nÜber naïve café — 日本語 テスト",
    "  leading and trailing  ",
    "",
    "line one\n\nline three\ttabbed <|user|> hi !<|user|><x <y>> ",
    "aaa aaaa aa bbbbbb !!!!!! " + "z" * 500 + " " + "<" * 5000 + "?" * 5000,
    "emoji 😀😀 and \x00 control ﷐",
]


def table(spark, texts=TEXTS):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_units_join_back(spark):
    for row in table(spark).select("text", units(F.col("text")).alias("u")).collect():
        body = " ".join(p for p in row.text.strip(" ").split(" ") if p)
        want = "" if not row.text.strip(" ") else "▁" + body.replace(" ", "▁")
        assert "".join(row.u) == want


def sequential_merges(counts, n):
    """One merge at a time: best count, then shorter, then smaller text."""
    state, made, out = {tuple(w): c for w, c in counts.items()}, set(), []
    while len(out) < n:
        pairs = Counter()
        for word, c in state.items():
            for a, b in zip(word, word[1:]):
                if len(a + b) <= 16 and a + b not in made:
                    pairs[a, b] += c
        if not pairs:
            break
        best = min(pairs, key=lambda p: (-pairs[p], len(p[0] + p[1]), (p[0] + p[1]).encode(), p[0].encode()))
        out.append(best)
        made.add(best[0] + best[1])
        new = Counter()
        for word, c in state.items():
            merged, i = [], 0
            while i < len(word):
                if word[i : i + 2] == best:
                    merged.append(best[0] + best[1])
                    i += 2
                else:
                    merged.append(word[i])
                    i += 1
            new[tuple(merged)] += c
        state = new
    return out


@pytest.mark.parametrize("seed", range(4))
def test_merges_equal_one_at_a_time(spark, seed):
    """Small alphabets give many ties, runs and pairs that lead to one text."""
    rng = random.Random(seed)
    counts = {}
    for _ in range(40):
        word = "".join(rng.choice("abc" if seed % 2 else "ab") for _ in range(rng.randint(1, 9)))
        counts[word] = rng.randint(1, 4)
    df = materialize(spark.createDataFrame(list(counts.items()), "word string, n long"), "w")
    letters = spark.createDataFrame([("a", 0), ("b", 1), ("c", 2)], "char string, rank long")
    assert bpe.train_merges(df, letters, 25) == sequential_merges(counts, 25)


def test_merges_beyond_the_watched_pairs(spark, monkeypatch):
    """Few watched pairs, so they run out, overflow and are counted again; more rounds than one rewrite."""
    monkeypatch.setattr(bpe, "_WATCHED", 6)
    monkeypatch.setattr(bpe, "_PENDING_LIMIT", 2)
    rng = random.Random(9)
    counts = {}
    for _ in range(30):
        word = "".join(rng.choice("abc😀") for _ in range(rng.randint(1, 8)))
        counts[word * rng.randint(1, 2)] = rng.randint(1, 5)
    df = materialize(spark.createDataFrame(list(counts.items()), "word string, n long"), "w")
    letters = spark.createDataFrame([(c, i) for i, c in enumerate("abc😀")], "char string, rank long")
    assert bpe.train_merges(df, letters, 30) == sequential_merges(counts, 30)


def test_merges_until_pairs_run_out(spark):
    counts = {"abab": 3, "ba": 1, "aaaa": 2, "c": 9}
    df = materialize(spark.createDataFrame(list(counts.items()), "word string, n long"), "w")
    letters = spark.createDataFrame([("a", 0), ("b", 1), ("c", 2)], "char string, rank long")
    assert bpe.train_merges(df, letters, 1000) == sequential_merges(counts, 1000)
    assert bpe.train_merges(df, letters, 0) == []
    assert bpe.train_merges(df.limit(0), letters, 5) == []


def test_characters_outside_the_alphabet_part_units(spark):
    df = materialize(spark.createDataFrame([("abXab", 5), ("ba", 1)], "word string, n long"), "w")
    letters = spark.createDataFrame([("a", 0), ("b", 1)], "char string, rank long")
    assert bpe.train_merges(df, letters, 5) == [("a", "b"), ("b", "a")]


@pytest.mark.parametrize("size", [450, 8000])
def test_library_gives_the_same_vocabulary_ids_and_text(spark, tmp_path, size):
    spm = pytest.importorskip("sentencepiece")
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    texts = [r.text for r in docs.orderBy("doc_id").collect()]
    (tmp_path / "t.txt").write_text("\n".join(texts) + "\n")
    spm.SentencePieceTrainer.Train(
        input=str(tmp_path / "t.txt"), model_prefix=str(tmp_path / "m"), vocab_size=size, model_type="bpe",
        character_coverage=0.9995, max_sentence_length=16384, pad_id=0, unk_id=1, bos_id=2, eos_id=3,
        pad_piece="<|pad|>", unk_piece="<|unk|>", bos_piece="<|startoftext|>", eos_piece="<|endoftext|>",
        user_defined_symbols="<|user|>,<|assistant|>,<|system|>", byte_fallback=True, split_by_whitespace=True,
        split_digits=True, normalization_rule_name="identity", minloglevel=2,
    )
    lib = spm.SentencePieceProcessor(model_file=str(tmp_path / "m.model"))
    ours = train_vocab(docs, size, "bpe")
    rows = vocab.collect_vocab(ours)
    assert [r.piece for r in rows] == [lib.id_to_piece(i) for i in range(lib.get_piece_size())]
    assert [r.score for r in rows[7 + 256 :]] == [lib.get_score(i) for i in range(7 + 256, size)]
    many = docs.union(table(spark).select(F.col("doc_id") + 100_000, "text"))
    encoded = materialize(encode.encode(many, encode.encoder(ours)), "e")
    for row in encode.decode(encoded, ours, text="back", skip_special_tokens=False).collect():
        if "\x00" not in row.text:
            assert row.ids == lib.encode(row.text), row.doc_id
            assert row.back == lib.decode(row.ids)


@pytest.mark.parametrize("model", encode.MODELS)
def test_decode_gives_the_text_back(spark, model):
    made = train_vocab(table(spark), 420, model)
    encoded = encode.encode(table(spark), encode.encoder(made, model), add_bos=True, add_eos=True)
    for row in encode.decode(encoded, made, text="back").collect():
        assert row.back.replace("<|user|>", "") == " ".join(
            p for p in row.text.strip(" ").split(" ") if p
        ).replace("<|user|>", "")
        assert row.ids[0] == 2 and row.ids[-1] == 3 and max(row.ids) < 420


def test_broken_bytes_decode_to_replacement(spark):
    made = train_vocab(table(spark), 420, "char")
    ids = spark.createDataFrame([([7 + 0xFF, 7 + 0x41],), ([1, 7 + 0x41],)], "ids array<int>")
    assert [r.text for r in encode.decode(ids, made).collect()] == ["�A", " ⁇ A"]


def test_merge_order_is_by_score_then_left():
    score = {"ab": -1.0, "bc": -2.0, "abc": -3.0, "aa": -4.0}
    assert merge_pieces("abcab", score) == ["abc", "ab"]
    assert merge_pieces("aaa", score) == ["aa", "a"]
    assert merge_pieces("x", score) == ["x"]


def all_cuts(word):
    if not word:
        yield []
    for i in range(1, len(word) + 1):
        for rest in all_cuts(word[i:]):
            yield [word[:i], *rest]


def test_expected_pieces_over_all_cuts():
    import math

    score = {"a": -2.0, "b": -2.5, "ab": -3.0, "ba": -2.2, "aba": -5.0}
    weights = [(c, math.exp(sum(score[p] for p in c))) for c in all_cuts("abab") if all(p in score for p in c)]
    total, want = sum(w for _, w in weights), Counter()
    for cut, w in weights:
        for p in cut:
            want[p] += w / total
    got = expected_pieces("abab", score, 3)
    assert got.keys() == want.keys() and all(abs(got[p] - want[p]) < 1e-9 for p in want)
    best = max(weights, key=lambda x: x[1])[0]
    assert sum(score[p] for p in best_path("abab", score, 3)[0]) == pytest.approx(sum(score[p] for p in best))


def test_unigram_keeps_characters_and_frequent_pieces(spark):
    text = " ".join(["hello"] * 50 + ["help"] * 30 + ["yellow"] * 20)
    counts = materialize(words.word_counts(table(spark, [text])), "w")
    rows = unigram.train_unigram(counts, 263 + 14, 200).collect()
    pieces = {r.piece for r in rows}
    assert set("helopyw▁") <= pieces and len(rows) <= 14
    assert any(len(p) > 3 for p in pieces)


def test_word_counts(spark):
    long = "x" * 20_000
    got = {r.word: r.n for r in words.word_counts(table(spark, ["a  b1\n\na !?\n" + long + "\n<|user|> a"])).collect()}
    assert got == {"▁a": 2, "▁b": 1, "1": 1, "▁!?": 1, "▁": 1} or got == {"▁a": 3, "▁b": 1, "1": 1, "▁!?": 1, "▁": 1}


def test_alphabet_covers(spark):
    df = spark.createDataFrame([("aaaa", 10), ("b", 8), ("c", 1), ("▁", 1)], "word string, n long")
    assert [r.char for r in words.alphabet(df, 0.9).orderBy("rank").collect()] == ["▁", "a", "b"]
    assert [r.char for r in words.alphabet(df, 1.0).orderBy("rank").collect()] == ["▁", "a", "b", "c"]


def test_vocab_file_round_trip(spark, tmp_path):
    pieces = spark.createDataFrame([('▁"', 0), ('"', 1), ("▁the", 2), ("\\", 3), ("#", 4)], "piece string, rank long")
    made = vocab.assemble_vocab(pieces, None, 268)
    vocab_files.write_vocab(made, str(tmp_path / "v"))
    back = vocab_files.read_vocab(spark, str(tmp_path / "v"))
    assert vocab.collect_vocab(back) == vocab.collect_vocab(made)
    rows = vocab.collect_vocab(back)
    written = "".join(f.read_text() for f in (tmp_path / "v").glob("part*"))
    assert '\n▁"\t-0\n"\t-1\n' in written
    assert [r.piece for r in rows[263:]] == ['▁"', '"', "▁the", "\\", "#"]
    assert (rows[7].piece, rows[262].piece, rows[1].kind) == ("<0x00>", "<0xFF>", "unknown")


def test_one_text_from_two_merges_is_one_row(spark):
    pieces = spark.createDataFrame([("abc", 0), ("ab", 1), ("abc", 2)], "piece string, rank long")
    rows = vocab.collect_vocab(vocab.assemble_vocab(pieces, None, 300))[263:]
    assert [(r.piece, r.score) for r in rows] == [("abc", 0.0), ("ab", -1.0)]


def test_lookups_and_info(spark):
    pieces = spark.createDataFrame([("▁the", 0)], "piece string, rank long")
    made = vocab.assemble_vocab(pieces, None, 264)
    asked = spark.createDataFrame([("▁the",), ("zzz",), ("<|user|>",)], "piece string")
    assert {r.piece: r.id for r in vocab.lookup_id(asked, made).collect()} == {"▁the": 263, "zzz": 1, "<|user|>": 4}
    ids = spark.createDataFrame([(263,), (9999,)], "id int")
    assert {r.id: r.piece for r in vocab.lookup_piece(ids, made).collect()} == {263: "▁the", 9999: None}
    assert vocab.ids_of_pieces(made, ["<|user|>", "<|end|>", "▁the"]) == [4, 1, 263]
    info = vocab.vocab_info(made.where("piece <> '<|system|>'")).first()
    assert (info.vocab_size, info.user_id, info.system_id) == (263, 4, 1)


def test_too_large_a_vocabulary_is_refused(spark):
    big = spark.range(70_000).selectExpr("cast(id as int) id", "cast(id as string) piece", "0D score", "'piece' kind")
    with pytest.raises(ValueError):
        vocab.collect_vocab(big)


def test_token_stats_total_and_empty(spark):
    df = spark.createDataFrame([("f", "abcd", [1, 2]), ("g", "", [])], "file string, text string, ids array<int>")
    got = {r.file: (r.n_tokens, r.n_chars, r.chars_per_token) for r in encode.token_stats(df).collect()}
    assert got == {"f": (2, 4, 2.0), "g": (0, 0, None), None: (2, 4, 2.0)}


def test_compatibility_form(spark):
    df = spark.createDataFrame([("ﬁne\tＡＢ\n x",)], "text string")
    assert "".join(df.select(units(F.col("text"), "nfkc").alias("u")).first().u) == "▁fine▁AB▁x"


def test_long_batches_are_encoded_in_runs(spark, monkeypatch):
    import tracemalloc

    import pyarrow as pa

    from tokenloom.functions import pieces

    known = {f"w{i}": (300 + i, 0.0) for i in range(50)}
    rng = random.Random(1)
    rows = [None if rng.random() < 0.1 else [f"w{rng.randrange(60)}" for _ in range(rng.randrange(9))] for _ in range(400)]
    rows += [[], ["w1"] * 100, None, []]
    flat = lambda row: row and [i for u in row for i in ([known[u][0]] if u in known else [7 + b for b in u.encode()])]
    for at_once in (1, 7, 1000):
        monkeypatch.setattr(pieces, "_UNITS_AT_ONCE", at_once)
        monkeypatch.setattr(pieces, "_MEMO_LIMIT", 5)
        coder = pieces.UnitEncoder(known, "word", frozenset())
        assert coder.batch(pa.array(rows, pa.list_(pa.string()))).to_pylist() == [flat(r) for r in rows]
        assert coder.batch(pa.array(rows, pa.list_(pa.string())).slice(3, 90)).to_pylist() == [flat(r) for r in rows[3:93]]
        assert coder.batch(pa.array([], pa.list_(pa.string()))).to_pylist() == []
        assert len(coder.memo) <= 5 and len(coder.older) <= 5
    monkeypatch.undo()
    long = pa.array([["w1", "w2", "w3", "w4"] * 50] * 40_000, pa.list_(pa.string()))
    coder = pieces.UnitEncoder(known, "word", frozenset())
    tracemalloc.start()
    coder.batch(long)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 16 * 8_000_000  # ids and their copy; before, numbers of eight bytes several times over


def test_encoders_bound_the_bytes_of_a_batch(spark):
    from tokenloom.session import BATCH_BYTES

    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    try:
        spark.conf.set(key, "64m")
        made = vocab.assemble_vocab(spark.createDataFrame([("▁a", 0)], "piece string, rank long"), None, 300)
        encode.encoder(made, "word")
        assert spark.conf.get(key) == str(BATCH_BYTES)
        spark.conf.set(key, "1m")
        encode.encoder(made, "word")
        assert spark.conf.get(key) == "1m"
    finally:
        spark.conf.set(key, before)


def test_packed_units_merge_as_lists_do(monkeypatch):
    """Units cross no block and no neighbour; those left with one symbol are not carried on."""
    monkeypatch.setattr(pairs, "_BLOCK_SYMBOLS", 5)
    words_of = {"abab": 3, "a": 7, "aaaaa": 2, "ab": 5, "": 4, "ba\x00b": 1}
    rows = [pa.array([[ord(c) for c in w] for w in words_of], pa.list_(pa.int32())), pa.array(words_of.values(), pa.int64())]
    blocks = list(pairs.packer([pa.record_batch(rows, ["symbols", "n"])] * 2))
    assert len(blocks) > 2
    ab, aa = pairs.pair_of(97, 98), pairs.pair_of(97, 97)
    batch = (np.array([aa, ab]), np.array([pairs.MERGED, pairs.MERGED + 1]))
    found = Counter()
    for made in pairs.change_counter([batch], np.array([aa, ab]))(blocks):
        found.update(dict(zip(*(c.to_pylist() for c in made.columns))))
    fused = pairs.MERGED
    want = {ab: -22, aa: -16, pairs.pair_of(fused + 1, fused + 1): 6, pairs.pair_of(fused, fused): 4, pairs.pair_of(fused, 97): 4}
    assert found == want
    left = Counter()
    for made in pairs.rewriter([batch])(blocks):
        for symbols, n in zip(*(c.to_pylist() for c in made.columns)):
            units_of = np.split(np.frombuffer(symbols, np.int32), np.flatnonzero(np.frombuffer(symbols, np.int32) == pairs._END) + 1)
            for unit, count in zip(units_of, np.frombuffer(n, np.int64)):
                left[tuple(unit[:-1].tolist())] += int(count)
    assert left == {(fused + 1, fused + 1): 6, (fused, fused, 97): 4, (98, 97, 0, 98): 2}


@pytest.mark.parametrize("at_once", [7, 1 << 17])
def test_units_are_cut_together_as_alone(monkeypatch, at_once):
    """Ties, characters without a piece, empty units and runs of few units give what one unit at a time gives."""
    monkeypatch.setattr(lattice, "_AT_ONCE", at_once)
    rng = random.Random(1)
    for _ in range(10):
        score = {"".join(rng.choice("abc😀") for _ in range(rng.randint(1, 4))): -float(rng.randint(1, 6)) for _ in range(12)}
        some = ["".join(rng.choice("abc😀x") for _ in range(rng.randint(0, 9))) for _ in range(40)]
        n = np.array([rng.randint(1, 9) for _ in some])
        found, values = lattice.Lattice(list(score)), np.array(list(score.values()))
        counts, met = found.expected(some, n, values)
        want = Counter()
        for unit, times in zip(some, n.tolist()):
            for piece, weight in expected_pieces(unit, score, 4).items():
                want[piece] += weight * times
        assert {p for p, held in zip(score, met) if held} == want.keys()
        assert all(abs(c - want[p]) < 1e-9 for p, c in zip(score, counts))
        cuts = [[u[a:b] for _, a, b in cut] for u, cut in zip(some, found.best(some, values, unknown_score(score)))]
        assert cuts == [best_path(u, score, 4)[0] for u in some]


def test_unigram_ids_are_those_of_each_unit_alone():
    pieces = {"ab": (500, -1.0), "a": (501, -2.0), "b": (502, -2.0), "<x>": (503, 0.0), "abb": (504, -3.0)}
    encoder = UnitEncoder(pieces, "unigram", frozenset(["<x>"]))
    some = ["abb", "<x>", "", "aéb", "abab", "b😀", "abb"]
    want = []
    for unit in some:
        cut = [unit] if unit == "<x>" else best_path(unit, encoder.score, 3)[0]
        want.append([i for text in cut for i in encoder.text_ids(text)])
    for _ in range(2):  # the second time from the memo
        assert encoder.all_ids(some) == want
    assert encoder.batch(pa.array([some, []])).to_pylist() == [[i for ids in want for i in ids], []]


def test_whole_words_leave_nothing_behind():
    """What a worker holds between batches of a word model does not grow with the words it has met."""
    known = {"▁a": (300, 0.0), "é": (301, 0.0), "▁": (302, 0.0), "<x>": (303, 0.0)}
    encoder = UnitEncoder(known, "word", frozenset(["<x>"]))
    rows = [["▁a", "é", "▁b", "<x>", "", "😀"], None, [f"w{i}" for i in range(3000)], ["▁", "▁a", "▁a"], []]
    flat = lambda row: row and [i for u in row for i in ([known[u][0]] if u in known else [7 + b for b in u.encode()])]
    assert encoder.batch(pa.array(rows, pa.list_(pa.string()))).to_pylist() == [flat(r) for r in rows]
    assert not encoder.memo and not encoder.older
