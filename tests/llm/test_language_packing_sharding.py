"""Language identification, packing, sharding and the pipeline."""

import collections
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tokenloom.llm import bestfit_packing as bp
from tokenloom.llm import compression_langid as cl
from tokenloom.llm import queries, sharding, simhash_vptree
from tokenloom.llm.common import bounded_sample

SMALL = "/root/testdata/sf0.001"
SOUNDS = {"aa": "ba do ki lu mera sento", "bb": "xyl qor zhen wuft grosk trim", "cc": "ééa ñoñ üöl ças èmi ôru"}


def _prose(lang, n, rng):
    parts = SOUNDS[lang].split()
    return " ".join("".join(rng.choices(parts, k=rng.randrange(1, 4))) for _ in range(n))


def _labelled(seed=1, n=120):
    rng = random.Random(seed)
    langs = sorted(SOUNDS)
    return [(i, _prose(langs[i % 3], rng.randrange(30, 80), rng), langs[i % 3]) for i in range(n)]


def _docs(spark, rows):
    schema = "doc_id long, text string, lang string, score string, lang_pred int, at int"
    return spark.createDataFrame([(*r, "s", 1, 2) for r in rows], schema)


def test_language_is_told_on_held_out_text(spark):
    rows = _labelled()
    docs = _docs(spark, rows)
    model = cl.learn(cl.learnable(docs))
    assert [m[0] for m in model] == sorted(SOUNDS)
    held = {r.doc_id for r in docs.where(cl.held_out()).collect()}
    assert held == {i for i, *_ in rows if zlib.crc32(str(i).encode()) % 4 == 2}
    found = {r.doc_id: r for r in cl.classify(docs, model).collect()}
    assert len(found) == len(rows) and all(0 < r.score <= 1 and not r.rejected for r in found.values())
    assert all(found[i].lang_pred == lang for i, _, lang in rows if i in held)


def test_only_text_and_labels_of_the_other_rows_are_learned(spark):
    rows = _labelled()
    changed = [(i, "zz zz", "dd") if zlib.crc32(str(i).encode()) % 4 == 2 else (i, t, lang) for i, t, lang in rows]
    assert cl.learn(cl.learnable(_docs(spark, rows))) == cl.learn(cl.learnable(_docs(spark, changed)))


def test_language_of_hard_rows(spark):
    rng = random.Random(5)
    rows = _labelled() + [(900, "text without label", None), (901, None, "aa"), (902, "123 ...", "only-digits")]
    docs = _docs(spark, rows)
    model = cl.learn(docs)
    assert [m[0] for m in model] == sorted(SOUNDS)
    long = _prose("bb", 60000, rng)
    hard = [(1, None, "x"), (2, "", "x"), (3, "12 34 !?\n", "x"), (4, "q", "x"), (5, long, "x"), (5, long, "x"), (None, long, "x")]
    found = cl.classify(_docs(spark, hard), model).collect()
    got = collections.Counter((r.doc_id, r.lang_pred, r.rejected) for r in found)
    assert got[(1, "und", True)] == got[(2, "und", True)] == got[(3, "und", True)] == 1
    assert got[(5, "bb", False)] == 2 and got[(None, "bb", False)] == 1
    assert [r.rejected for r in found if r.doc_id == 4] == [True]  # too little to tell
    assert cl.learn(docs.limit(0)) == [] and cl.classify(docs.limit(0), model).collect() == []
    assert {r.lang_pred for r in cl.classify(docs, []).collect()} == {"und"}
    single = cl.learn(docs.where("lang = 'aa'"))
    told = {r.doc_id: r for r in cl.classify(docs.where("lang = 'aa' and text is not null"), single).collect()}
    assert {r.lang_pred for r in told.values()} == {"aa"} and all(r.score > 0 for r in told.values())


def test_language_accuracy_on_documents(spark):
    found = queries.op3_compression_langid(spark, SMALL).alias("f").join(spark.read.parquet(f"{SMALL}/documents.parquet"), "doc_id")
    right = found.where("held_out").agg(F.avg((F.col("lang_pred") == F.col("lang")).cast("int"))).first()[0]
    assert right > 0.95


# Packing


def _plain_best_fit(sizes, lengths, overhead):
    """Best fit by looking at every bin."""
    bins, placed = [], []
    for i, size in enumerate(sizes):
        fits = [(b["room"], -b["at"], n) for n, b in enumerate(bins) if b["room"] >= size]
        if fits:
            n = min(fits)[2]
        else:
            rest = sizes[i + 1 :]
            best = None
            for capacity in lengths:
                if capacity >= size:
                    coming = sum(s for s in rest if s <= capacity - size)
                    cost = (capacity + overhead) / min(capacity, size + coming)
                    if best is None or cost < best[0]:
                        best = (cost, capacity)
            bins.append({"room": best[1], "used": 0, "at": 0})
            n = len(bins) - 1
        placed.append((n, bins[n]["used"]))
        bins[n]["used"] += size
        bins[n]["room"] -= size
        bins[n]["at"] = i  # bins with the same room: the one filled last
    return placed, [b["used"] for b in bins]


def test_best_fit_matches_a_plain_one():
    rng = random.Random(3)
    for lengths in ((10,), (8, 16, 40), (16, 64)):
        for n in (1, 5, 60, 200):
            sizes = sorted((rng.randrange(1, lengths[-1] + 1) for _ in range(n)), reverse=True)
            at, starts, used = bp.best_fit(np.array(sizes), lengths, 3)
            placed, full = _plain_best_fit(sizes, lengths, 3)
            assert list(zip(at.tolist(), starts.tolist())) == placed and used.tolist() == full


def test_every_token_is_packed_once(spark):
    rng = random.Random(7)
    rows = [(i, "w " * rng.choice([0, 1, 5, 17, 40, 41, 200])) for i in range(400)] + [(7, "a b"), (7, "a b"), (None, "a b c"), (8, None)]
    docs = spark.createDataFrame([(*r, 1, "p") for r in rows], "doc_id long, text string, bin_id int, piece string")
    packed = bp.pack(docs, bp.word_count(), lengths=(40, 10, 20, 10)).collect()
    cover = collections.Counter()
    for r in packed:
        cover[r.doc_id] += r.n_tokens
        assert (r.bin_id is None) == (r.n_tokens == 0) and r.start == 40 * r.piece
    want = collections.Counter()
    for i, text in rows:
        want[i] += len((text or "").split())
    assert +cover == +want
    assert sum(r.n_tokens == 0 for r in packed) == sum(not (t or "").split() for _, t in rows)
    bins = collections.defaultdict(list)
    for r in packed:
        if r.bin_id is not None:
            bins[r.bin_id].append(r)
    for held in bins.values():
        held.sort(key=lambda r: r.bin_start)
        assert [r.bin_start for r in held] == np.cumsum([0, *[r.n_tokens for r in held]])[:-1].tolist()
        used = sum(r.n_tokens for r in held)
        assert {(r.bin_used, r.bin_capacity) for r in held} == {(used, min(c for c in (10, 20, 40) if c >= used))}
    total = sum(want.values())
    assert total / sum(held[0].bin_capacity for held in bins.values()) > 0.95
    assert bp.pack(docs.limit(0), bp.word_count()).collect() == []
    with pytest.raises(ValueError):
        bp.pack(docs, bp.word_count(), lengths=())


def test_groups_are_packed_apart(spark, monkeypatch):
    monkeypatch.setattr(bp, "GROUP_PIECES", 50)
    docs = spark.range(400).select(F.col("id").alias("doc_id"), (F.col("id") % 90 + 1).alias("n"))
    packed = bp.pack(docs, F.col("n"), lengths=(100,)).collect()
    assert sum(r.n_tokens for r in packed) == sum(i % 90 + 1 for i in range(400))
    assert len({r.bin_id >> 32 for r in packed}) == 8


# Sharding


def test_slots_are_claimed_in_turn():
    names, slots = [f"s{i}" for i in range(7)], 101
    owner = sharding.fill_table(names, slots)
    orders = []
    for name in names:
        mark = int(__import__("hashlib").md5(name.encode()).hexdigest(), 16)
        start, step = mark % slots, 1 + (mark >> 64) % (slots - 1)
        orders.append([(start + j * step) % slots for j in range(slots)])
    table = {}
    while len(table) < slots:
        for shard, order in enumerate(orders):
            if len(table) < slots:
                table[next(s for s in order if s not in table)] = shard
    assert owner.tolist() == [table[s] for s in range(slots)]


def test_table_is_even_and_moves_little():
    names = [f"s{i}" for i in range(20)]
    owner = sharding.fill_table(names)
    counts = np.bincount(owner)
    assert counts.max() - counts.min() <= 1
    fewer = sharding.fill_table(names[:-1])
    moved = (owner != fewer) & (owner != 19)
    assert moved.mean() < 0.1
    for bad in (([], 101), (["a", "a"], 101), (["a"], 100), ([str(i) for i in range(8)], 7)):
        with pytest.raises(ValueError):
            sharding.fill_table(*bad)


def test_rows_are_placed_by_their_key(spark, tmp_path):
    import hashlib

    names = [f"s{i}" for i in range(5)]
    rows = [(i % 60, f"t{i}") for i in range(200)] + [(None, f"n{i}") for i in range(100)] + [(None, None)]
    docs = spark.createDataFrame([(*r, 5, "x") for r in rows], "doc_id long, text string, slot int, shard string")
    owner = sharding.fill_table(names)
    placed = sharding.place(docs, names)
    got = placed.collect()
    assert placed.columns == docs.columns and len(got) == len(rows)
    for r in got:
        key = f"k{r.doc_id}" if r.doc_id is not None else f"n{r.text or ''}"
        slot = int(hashlib.md5(key.encode()).hexdigest()[:15], 16) % sharding.SLOTS
        assert (r.slot, r.shard) == (slot, names[owner[slot]])
    assert len({r.shard for r in got if r.doc_id is None}) == 5
    assert sharding.place(docs.limit(0), names).collect() == []
    sharding.write_shards(placed, str(tmp_path / "shards"), files_per_shard=3)
    back = spark.read.parquet(str(tmp_path / "shards"))
    assert sorted(map(tuple, back.select("doc_id", "text", "shard").collect()), key=repr) == sorted(
        ((r.doc_id, r.text, r.shard) for r in got), key=repr
    )


def test_sample_is_bounded_and_repeats(spark):
    rows = spark.range(5000)
    first = bounded_sample(rows, [F.col("id")], 100)
    assert 40 < first.count() <= 200
    assert first.sort("id").collect() == bounded_sample(rows.repartition(3), [F.col("id")], 100).sort("id").collect()
    assert bounded_sample(rows.limit(0), [F.col("id")], 100).collect() == []


def test_marks_without_letters_have_no_language(spark):
    train = [(i, f"the house and the river number {i} of many words", "en") for i in range(40)]
    train += [(100 + i, f"das Haus und der Fluss sind Nummer {i} von vielen", "de") for i in range(40)]
    model = cl.learn(_docs(spark, train))
    rows = [(1, "\u0301\u0302 \u0303", None), (2, "12 \u0301 !", None), (3, None, None), (4, "das Haus und der Fluss", None)]
    found = {r.doc_id: r.lang_pred for r in cl.classify(_docs(spark, rows), model).collect()}
    assert found == {1: "und", 2: "und", 3: "und", 4: "de"}


def test_near_copies_go_by_row(spark):
    rng = random.Random(3)
    w, v = (" ".join(rng.choice("abcdefgh") + str(rng.randrange(99)) for _ in range(60)) for _ in range(2))
    rows = [(1, w), (2, w), (2, v), (3, v), (3, v), (None, w), (None, w), (5, w)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    kept = sorted(((r.doc_id, r.text) for r in corpus_pipeline.drop_near_copies(spark, docs, SMALL).collect()), key=repr)
    assert kept == sorted([(1, w), (2, v), (None, w), (None, w)], key=repr)
    assert corpus_pipeline.drop_near_copies(spark, docs.limit(0), SMALL).collect() == []


def test_simhash_takes_ids_of_any_type(spark):
    rows = [("b", "one two three four"), ("a", "one two three four"), ("c", "quite another text of words"), (None, "one two three four")]
    found = simhash_vptree.near_duplicates(spark.createDataFrame(rows, "doc_id string, text string"))
    assert sorted(((r.doc_id, r.component_id) for r in found.collect()), key=repr) == sorted([("a", "a"), ("b", "a"), ("c", "c"), (None, None)], key=repr)


# Pipeline


def test_stages_keep_their_contract(spark):
    rng = random.Random(11)
    passage, twin = _prose("aa", 70, rng), _prose("bb", 200, rng)
    rows = [(i, t, lang, "s", len(t)) for i, t, lang in _labelled(seed=2)]
    rows += [(500, twin, "bb", "s", 0), (501, twin, "bb", "s", 0), (502, "123 456", "aa", "s", 7), (503, None, "aa", "s", 0), (504, "", "cc", "s", 0)]
    rows += [(600, _prose("aa", 40, rng) + "\n" + passage, "aa", "s", 0), (601, passage + "\n" + _prose("aa", 45, rng), None, "s", 0)]
    rows += [(None, _prose("cc", 50, rng), "cc", "s", 0), (602, passage, "aa", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    texts = {r[0]: r[1] for r in rows}
    told = corpus_pipeline.identify_language(spark, docs, SMALL)
    assert told.columns == docs.columns
    kept = {r.doc_id: r for r in told.collect()}
    assert set(texts) - set(kept) == {502, 503, 504} and kept[601].lang == "aa"
    single = corpus_pipeline.drop_near_copies(spark, told, SMALL)
    assert single.columns == docs.columns
    ids = {r.doc_id for r in single.collect()}
    assert 500 in ids and 501 not in ids and None in ids
    left = corpus_pipeline.remove_passages(spark, single, SMALL)
    after = {r.doc_id: r for r in left.collect()}
    assert left.columns == docs.columns and after[600].text == texts[600] and 602 not in after
    assert after[601].text == texts[601].split("\n")[1] and after[601].n_chars == len(after[601].text)
    packed = corpus_pipeline.pack_sequences(spark, left, SMALL).collect()
    assert sum(r.n_tokens for r in packed) == sum(len((r.text or "").split()) for r in after.values())
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), SMALL).collect() == []


def test_pipeline_runs_all_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SMALL)
    want = sorted((r.doc_id, r.piece, r.n_tokens) for r in docs.collect())
    got = corpus_pipeline.run(spark, SMALL)
    assert sorted((r.doc_id, r.piece, r.n_tokens) for r in got.collect()) == want


def test_oracles_agree(spark):
    duckdb = pytest.importorskip("duckdb")
    connection = duckdb.connect()
    for name in ("conversations", "pages", "embeddings"):
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SMALL}/{name}.parquet'")
    for key, sql in queries.ORACLES.items():
        found = queries.QUERIES[key](spark, SMALL)
        columns = sorted(found.columns)
        result = connection.execute(sql)
        names = [c[0] for c in result.description]
        theirs = sorted((tuple(r[names.index(c)] for c in columns) for r in result.fetchall()), key=repr)
        assert sorted((tuple(r[c] for c in columns) for r in found.collect()), key=repr) == theirs, key


def test_language_is_learned_from_whole_texts(spark):
    notice = "this notice opens every text " * 80
    rows = [(i, notice + f"zebra{chr(97 + i)} " * 30, "aa") for i in range(20)] + [(50, "12 " * 900 + "kilo lima", "bb")]
    model = {lang: (n, content) for lang, n, content in cl.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))}
    assert model["aa"][0] == 20 and model["bb"] == (1, b"kilo lima")
    assert all(f"zebra{chr(97 + i)}".encode() in model["aa"][1] for i in range(20)) and b"this notice" in model["aa"][1]
