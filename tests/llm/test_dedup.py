"""SimHash groups, paragraph passages and components against brute force."""

import collections
import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tokenloom.llm import paragraph_minhash as pm
from tokenloom.llm import simhash_vptree as sh
from tokenloom.llm.common import local_roots, word_windows
from tokenloom.llm.components import components


def _fingerprint(text):
    words = [w for w in (text or "").encode().lower().split()]
    if not words:
        return 0
    grams = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def _groups(n, linked):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in linked:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return [find(i) for i in range(n)]


def test_components_match_union_find(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(300)] + [(i, i + 1) for i in range(500, 700)]
    edges += [(1000, i) for i in range(1001, 1400)] + [(5, 5), (7, 8), (7, 8), (8, 7)]
    table = spark.createDataFrame([*edges, (None, 3), (3, None)], "a long, b long")
    got = {r.node: r.component for r in components(table).collect()}
    roots = _groups(1400, edges)
    assert got == {i: roots[i] for a, b in edges if a != b for i in (a, b)}
    assert components(table.limit(0)).collect() == []
    texts = table.where("a < 50 and b < 50").select(F.format_string("%03d", "a").alias("a"), F.format_string("%03d", "b").alias("b"))
    named = {int(r.node): int(r.component) for r in components(texts).collect()}
    small = {r.node: r.component for r in components(table.where("a < 50 and b < 50")).collect()}
    assert {n: {m for m in named if named[m] == named[n]} for n in named} == {n: {m for m in small if small[m] == small[n]} for n in small}


def test_local_roots_and_tree_search_match_brute_force():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    near = base[rng.integers(0, 300, 900)].copy()
    for _ in range(4):
        near ^= np.uint64(1) << rng.integers(0, 64, 900).astype(np.uint64)
    points = np.unique(np.concatenate([base, near, np.zeros(1, np.uint64)]))
    home = rng.random(len(points)) < 0.7
    a, b = sh.spanning_links(points, home, 3)
    distance = np.bitwise_count(points[:, None] ^ points[None])
    x, y = np.nonzero((distance <= 3) & home[None])
    assert np.array_equal(local_roots(len(points), a, b), local_roots(len(points), x, y))
    same = np.full(200, 5, np.uint64) ^ (np.arange(200, dtype=np.uint64) % np.uint64(2))
    a, b = sh.spanning_links(same, np.ones(200, bool), 3)
    assert len(set(local_roots(200, a, b))) == 1


def test_shards_meet_every_pair(spark):
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 63, 400, dtype=np.uint64)
    moved = base.copy()
    for _ in range(3):
        moved ^= np.uint64(1) << rng.integers(0, 64, 400).astype(np.uint64)
    bits = np.unique(np.concatenate([base, moved]))
    rows = [(int(v), i) for i, v in enumerate(bits.view(np.int64))]
    reps = spark.createDataFrame(rows, "bits long, rep long")
    found = sh.links(reps).toPandas()
    distance = np.bitwise_count(bits[:, None] ^ bits[None])
    want = local_roots(len(bits), *np.nonzero(distance <= 3))
    assert np.array_equal(local_roots(len(bits), found["a"].to_numpy(int), found["b"].to_numpy(int)), want)


HARD = [None, "", " \t\n", "One", "one two", "A b C", "a b c", "a b c", "é É", "x " * 60000, "x " * 60001, "x\x0bx\x0cx"]


def test_near_duplicates_match_brute_force(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(50)]
    long = [" ".join(rng.choices(words, k=300)) for _ in range(20)]
    texts = HARD + long + [t.replace("w1 ", "w2 ", 1) for t in long] + long[:5] * 3
    rows = [(100 - i, t, "zz", 3) for i, t in enumerate(texts)] + [(100, HARD[0], "zz", 3), (None, long[0], "zz", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, bits string, rep int")
    got = sorted((r.doc_id or -1, r.bits % (1 << 64), r.component_id or -1) for r in sh.near_duplicates(docs).collect())
    known = [(i, _fingerprint(t)) for i, t, *_ in rows if i is not None]
    linked = [
        (a, b) for a in range(len(known)) for b in range(a) if (known[a][1] ^ known[b][1]).bit_count() <= 3 or known[a][0] == known[b][0]
    ]
    roots = _groups(len(known), linked)
    least = collections.defaultdict(lambda: 1 << 60)
    for (i, _), r in zip(known, roots):
        least[r] = min(least[r], i)
    want = [(i, f, least[r]) for (i, f), r in zip(known, roots)] + [(-1, _fingerprint(long[0]), -1)]
    assert got == sorted(want)
    assert sh.near_duplicates(docs.limit(0)).collect() == []
    assert [r.h for r in spark.createDataFrame([(0,), (-1,), (255,)], "b long").select(sh.hex_of(F.col("b")).alias("h")).collect()] == [
        "0" * 16, "f" * 16, "0" * 14 + "ff",
    ]


def test_windows_of_long_texts_give_the_same_words_and_shingles(monkeypatch):
    rng = random.Random(8)
    for _ in range(50):
        text = "".join(rng.choice("ab  \n\t\x0b") for _ in range(rng.randrange(80))).encode()
        for size in (1, 3, 10, 1000):
            windows = list(word_windows(text, size))
            assert [w for window in windows for w in window] == text.split()
    texts = ["a", "a b", "a b c d e f g", "  x  y z ", " ".join(map(str, range(99)))]
    monkeypatch.setattr(sh, "word_windows", lambda text: word_windows(text, 2))
    assert sh.fingerprint_all([t.encode() for t in texts]).tolist() == [_fingerprint(t) for t in texts]


# Paragraphs


def _passages(rows, min_words):
    """Places of repeated passages by comparing all pairs of paragraphs."""
    places = []
    for doc, text in rows:
        for number, line in enumerate((text or "").split("\n")):
            words = tuple(line.lower().split())
            if doc is not None and len(words) >= min_words:
                places.append(((doc, number), words))
    sets = [{w[i : i + 5] for i in range(len(w) - 4)} for _, w in places]
    linked = [(a, b) for a in range(len(places)) for b in range(a) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9]
    roots = _groups(len(places), linked)
    groups = collections.defaultdict(list)
    for (place, _), r in zip(places, roots):
        groups[r].append(place)
    return {p: min(g) for g in groups.values() if len(g) > 1 for p in g}


def _corpus(seed=9):
    rng = random.Random(seed)
    words = [f"v{i}" for i in range(2000)]
    line = lambda n: " ".join(rng.choices(words, k=n))
    passage, other = line(60), line(55)
    nearly = passage.split()
    nearly[30] = "changed"
    rows = [(i, "\n".join([line(30), line(40)])) for i in range(30)]
    rows += [(100 + i, "\n".join([line(25), passage.upper() if i % 2 else passage, line(33)])) for i in range(8)]
    rows += [(200, " ".join(nearly)), (201, line(9) + "\n" + other + "\n\n" + line(9)), (202, other), (203, other), (203, other)]
    return [*rows, (300, None), (301, ""), (302, "\n\n"), (None, passage), (303, line(20000)), (304, "Short line of words")]


def test_passages_match_brute_force(spark):
    rows = _corpus()
    docs = spark.createDataFrame([(*r, "k", 1) for r in rows], "doc_id long, text string, key string, n int")
    found = pm.passages(docs).collect()
    got = {(r.doc_id, r.para_no): (r.kept_doc_id, r.kept_para_no) for r in found}
    assert got == _passages(rows, pm.MIN_WORDS)
    assert all(r.removed == ((r.doc_id, r.para_no) != (r.kept_doc_id, r.kept_para_no)) for r in found)
    texts = dict(r for r in rows if r[0] is not None)
    for r in found:
        assert texts[r.doc_id][r.start : r.stop] == texts[r.doc_id].split("\n")[r.para_no]
    left = {r.doc_id: r for r in pm.remove(docs, pm.passages(docs)).collect()}
    assert left[0].text == texts[0] and left[303].text == texts[303] and left[300].text is None and left[302].text == "\n\n"
    assert left[101].text == "\n".join([texts[101].split("\n")[0], texts[101].split("\n")[2]]) and left[100].text == texts[100]
    assert 200 not in left and 202 not in left and left[None].text == rows[-3][1]
    assert pm.passages(docs.limit(0)).collect() == [] and pm.remove(docs.limit(0), pm.passages(docs)).collect() == []


def test_hot_bands_are_checked_in_chunks(spark, monkeypatch):
    rng = random.Random(2)
    words = [f"u{i}" for i in range(500)]
    base = rng.choices(words, k=80)
    rows = []
    for i in range(120):
        own = list(base)
        own[rng.randrange(80)] = f"edit{i}"
        rows.append((i, " ".join(own)))
    monkeypatch.setattr(pm, "CHUNK_MEMBERS", 16)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.para_no): (r.kept_doc_id, r.kept_para_no) for r in pm.passages(docs).collect()}
    assert got == _passages(rows, pm.MIN_WORDS)


def test_links_inside_a_cell_are_complete():
    rng = random.Random(4)
    sets = []
    for c in range(12):
        core = rng.sample(range(c * 1000, c * 1000 + 900), 50)
        for _ in range(8):
            sets.append(np.array(sorted({*core[: rng.randrange(38, 51)], *rng.sample(range(50000, 60000), rng.randrange(3))}), np.uint64))
    a, b = pm.spanning_links(sets)
    linked = [
        (i, j) for i in range(len(sets)) for j in range(i)
        if len(np.intersect1d(sets[i], sets[j])) >= 0.8 * len(np.union1d(sets[i], sets[j])) - 1e-9
    ]
    assert local_roots(len(sets), a, b).tolist() == _groups(len(sets), linked)


def test_bands_are_tuned_for_recall():
    bands, rows = pm.tune()
    assert bands * rows <= pm.HASHES and 1 - (1 - pm.THRESHOLD**rows) ** bands >= pm.RECALL
    with pytest.raises(ValueError):
        pm.tune(0.1, 4, 0.999)


def test_passages_over_short_lines_are_found(spark):
    rng = random.Random(12)
    words = [f"s{i}" for i in range(2000)]
    line = lambda n: " ".join(rng.choices(words, k=n))
    wrapped = [line(9) for _ in range(7)]
    long, head = line(30), "A heading"
    rows = [
        (1, "\n".join([head, "", *wrapped, "", long])),
        (2, "\n".join([line(40), *wrapped, line(25)])),
        (3, "\n".join([line(12), "", " ".join(wrapped)])),
        (4, "\n".join([head, "", line(8), line(7)])),
    ]
    texts = dict(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = pm.passages(docs)
    got = {(r.doc_id, r.para_no): (r.kept_doc_id, r.kept_para_no, r.removed, texts[r.doc_id][r.start : r.stop].split()) for r in found.collect()}
    own = " ".join(wrapped).split()
    assert got == {(1, 2): (1, 2, False, own), (2, 1): (1, 2, True, own), (3, 2): (1, 2, True, own)}
    left = {r.doc_id: r.text for r in pm.remove(docs, found).collect()}
    two, three = texts[2].split("\n"), texts[3].split("\n")
    assert left == {1: texts[1], 2: "\n".join([two[0], two[-1]]), 3: "\n".join(three[:2]), 4: texts[4]}


def test_passages_inside_longer_lines_are_found(spark):
    rng = random.Random(14)
    words = [f"m{i}" for i in range(3000)]
    line = lambda n: " ".join(rng.choices(words, k=n))
    passage, exact, short = line(81), line(50), line(49)
    split = passage.split()
    rows = [
        (1, f"{line(30)} {passage} {line(47)}\n{line(22)}"),
        (2, f"{line(40)}\n{line(28)} {passage.upper()} {line(50)}"),
        (3, f"{line(70)} {' '.join(split[:40])}\n{' '.join(split[40:])} {line(60)}"),
        (4, f"{line(60)} {exact} {line(60)}"),
        (5, f"{line(60)} {exact}\n{line(60)}"),
        (6, f"{line(60)} {short} {line(60)}"),
        (7, f"{line(60)} {short} {line(60)} {passage}"),
        (8, passage),
        (9, "y " * 3000),
    ]
    texts = dict(rows)
    docs = spark.createDataFrame([*rows, (None, texts[1]), (10, None), (2, texts[2])], "doc_id long, text string")
    found = pm.passages(docs)
    got = {(r.doc_id, r.removed): (r.para_no, r.kept_doc_id, r.n_words, texts[r.doc_id][r.start : r.stop].lower().split()) for r in found.collect()}
    del got[2, False]  # the lines of the repeated row, which stand for one place each
    fifty = exact.split()
    assert got == {
        (1, False): (0, 1, 81, split), (2, True): (1, 1, 81, split), (3, True): (0, 1, 81, split), (7, True): (0, 1, 81, split),
        (8, True): (0, 1, 81, split), (4, False): (0, 4, 50, fifty), (5, True): (0, 4, 50, fifty),
    }
    left = collections.defaultdict(list)
    for r in pm.remove(docs, found).collect():
        left[r.doc_id].append(r.text)
    assert left[1] == [texts[1]] and left[6] == [texts[6]] and left[9] == [texts[9]] and left[None] == [texts[1]] and 8 not in left
    assert left[2] == [texts[2].replace(passage.upper() + " ", "")] * 2 and left[10] == [None]
    assert left[5] == [texts[5].replace(" " + exact, "")] and left[7] == [texts[7].replace(" " + passage, "")]
    three = texts[3].split()
    assert left[3] == [" ".join(three[:70]) + "\n" + " ".join(three[151:])]


def test_written_tables_leave_no_shuffle_files(spark):
    from tokenloom.llm.common import materialize

    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files, setting = disk.getAllFiles().size(), spark.conf.get(key)
    made = materialize(spark.range(1000).selectExpr("id % 7 as k").groupBy("k").count(), "counted")
    assert disk.getAllFiles().size() <= files
    assert made.count() == 7
    assert spark.conf.get(key) == setting


def test_paragraph_words_are_hashed_in_arrays(monkeypatch):
    """Words are what ``str.split`` gives in lower case, of any length and white space, alone or with other
    texts, whole or in windows; equal words and no others have equal hashes."""
    rng = random.Random(4)
    words = ["a", "ab", "ABCDEFGH", "abcdefgh", "abcdefghi", "İx", "ΟΔΟΣ", "x" * 300, "x" * 301, "y" * 256, "😀", "ab\x00", "\x00", "é"]
    gaps = [" ", "  ", "\t", "\x1c", "\x85", "\xa0", " ", "　", "\r", "\n", "\n\n", "\n \n"]
    texts = [None, "", "\n", " "] + ["".join(rng.choice(words) + rng.choice(gaps) for _ in range(rng.randrange(60))) for _ in range(40)]

    def blocks(text):
        at, held, n = 0, None, 0
        for number, line in enumerate((text or "").split("\n")):
            size = len(line.lower().split())
            if held and not 0 < size < 5:
                yield tuple(held)
                held = None
            if size and held:
                held[2], held[4] = at + len(line), n + size
            elif size:
                held = [number, at, at + len(line), n, n + size]
            if size >= 5:
                yield tuple(held)
                held = None
            at, n = at + len(line) + 1, n + size
        if held:
            yield tuple(held)

    found = {}
    for at_once in (1, 40, 1 << 19):
        monkeypatch.setattr(pm, "_CHARS_AT_ONCE", at_once)
        for text, (got, hashes) in zip(texts, pm.Paragraphs(5).cut(texts), strict=True):
            assert got == list(blocks(text))
            of_text = [w for line in (text or "").split("\n") for w in line.lower().split()]
            for word, h in zip(of_text, hashes.tolist(), strict=True):
                assert found.setdefault(word, h) == h
    assert len(set(found.values())) == len(found) > 10


def test_pipeline_operators_bound_the_bytes_of_a_batch(spark):
    """Rows are whole texts, and a batch of 10,000 of them has no bound by their number."""
    from tokenloom.llm import compression_langid as cl
    from tokenloom.session import BATCH_BYTES

    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    docs = spark.createDataFrame([(1, "some words")], "doc_id long, text string")
    try:
        for made in (lambda: cl.classify(docs, []), lambda: sh.fingerprints(docs), lambda: pm.paragraphs(docs, 4)):
            spark.conf.set(key, "64m")
            made()
            assert spark.conf.get(key) == str(BATCH_BYTES)
            assert BATCH_BYTES <= 4 << 20
    finally:
        spark.conf.set(key, before)
