"""Alignment, Jaccard join and prefix trie against brute force."""

import collections
import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tokenloom.llm import ngram_jaccard as nj
from tokenloom.llm import prefix_trie as pt
from tokenloom.llm import token_alignment as ta
from tokenloom.llm.common import word_windows

tokenizers = pytest.importorskip("public_tokenizers")


# Alignment


@pytest.fixture(scope="module")
def files():
    return ta.Files.read(tokenizers.path("byte_bpe_50k.json"), tokenizers.path("piece_bpe_32k.model"))


def _aligned(texts):
    """Groups and links of each text, token by token, with both libraries."""
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=tokenizers.path("piece_bpe_32k.model"))
    values = ta._byte_values()
    pieces = {i: p for p, i in a.get_vocab().items()}

    def of_a(i):
        return bytes(values[c] for c in pieces[i])

    def of_b(i):
        piece = b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if b.is_byte(i) else piece.replace("▁", " ").encode()

    for text in texts:
        x, y = a.encode(" " + (text or ""), add_special_tokens=False).ids, b.encode(text or "")
        whole = (" " + (text or "")).encode()
        if not text or b"".join(map(of_a, x)) != whole or b"".join(map(of_b, y)) != whole:
            yield 0, 0, [], []
            continue
        ends_a = np.cumsum([len(of_a(i)) for i in x]).tolist()
        ends_b = np.cumsum([len(of_b(i)) for i in y]).tolist()
        links, groups, i, j, own_a, own_b = [], [], 0, 0, [x[0]], [y[0]]
        while True:
            links.append((x[i], y[j]))
            near, far = ends_a[i], ends_b[j]
            if near == far:
                groups.append(",".join(map(str, own_a)) + "|" + ",".join(map(str, own_b)))
                own_a, own_b = [], []
                if i + 1 == len(x):
                    break
            if near <= far:
                i += 1
                own_a.append(x[i])
            if far <= near:
                j += 1
                own_b.append(y[j])
        yield len(x), len(y), groups, links


def _want_alignment(rows):
    made = list(_aligned([text for _, text in rows]))
    counts = collections.Counter(pair for *_, links in made for pair in set(links))
    best = collections.defaultdict(int)
    for (a, _), n in counts.items():
        best[a] = max(best[a], n)
    want = []
    for (doc, _), (n_a, n_b, groups, links) in zip(rows, made):
        sha = hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""
        n_best = sum(counts[p] == best[p[0]] for p in links)
        want.append((doc, n_a, n_b, len(groups), len(links), n_best, sum(counts[p] for p in links), sha))
    return sorted(want, key=repr)


TEXTS = [
    None, "", " ", "a", "  two  spaces ", "tab\tand\nlines\r\n", "Ünïcödé ç ß 漢字 かな 😀 é", "<|endoftext|> <s> </s> <0x41>", "it's we'll  I'd",
    "▁ mark", " nbsp em", "1234567 89,000.5", "ﬁ ligature ①", "x" * 5000, "word " * 3000, "\x00\x01 control", "don 't ' s", "a ́b", "А б В",
]


def test_alignment_matches_token_by_token(spark, files, monkeypatch):
    rng = random.Random(2)
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(3, "a"), (None, "null id")]
    rows += [(100 + i, " ".join(rng.choice(["the", "Haus", "niño,", "x.\ny", "l'été", "(a)", "50%"]) for _ in range(rng.randrange(1, 60)))) for i in range(60)]
    docs = spark.createDataFrame([(d, t, "p", 1) for d, t in rows], "doc_id long, text string, pair string, n_a int").repartition(3)
    monkeypatch.setattr(ta, "BLOCK_BYTES", 1 << 12)
    got = sorted((tuple(r) for r in ta.aligned_documents(docs, files).collect()), key=repr)
    assert got == _want_alignment(rows)
    assert ta.aligned_documents(docs.limit(0), files).collect() == []


def test_pointers_reach_the_last_token_of_each_component():
    rng = np.random.default_rng(5)
    for _ in range(200):
        size = int(rng.integers(1, 60))
        cuts = [np.append(np.flatnonzero(rng.random(size - 1) < rng.random()) + 1, size) for _ in range(2)]
        terminal = ta.jump(*cuts)
        shared = np.intersect1d(*cuts)
        ends = np.concatenate(cuts)
        want = shared[np.searchsorted(shared, ends)]
        assert np.array_equal(ends[terminal], want)
        assert (terminal >= len(cuts[0])).all()


def test_other_first_files_are_refused(files):
    with pytest.raises(ValueError, match="byte-level"):
        ta.Pair(files.a.replace('"ByteLevel"', '"Whitespace"', 1), files.b)


# Jaccard join


def _shingles(text):
    words = (text or "").encode().lower().split()
    return {b" ".join(words[i : i + 5]) for i in range(len(words) - 4)} or ({b" ".join(words)} if words else set())


def _want_classes(rows):
    sets = [_shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and rows[i][0] is not None and rows[j][0] is not None and 100 * len(a & b) >= 80 * len(a | b):
                root[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(i)] = min(least.get(find(i), doc), doc)
    return sorted(((d, len(s), None if d is None else (least[find(i)] if s else d)) for i, ((d, _), s) in enumerate(zip(rows, sets))), key=repr)


def _similar_texts(seed, n):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    common = [rng.choice(vocab) for _ in range(40)]
    texts = []
    while len(texts) < n:
        words = [rng.choice(vocab) for _ in range(rng.choice([3, 5, 6, 8, 9, 10, 12, 14, 18, 24, 40, 90, 200]))]
        if rng.random() < 0.3:
            at = rng.randrange(len(words))
            words[at:at] = common
        texts.append(" ".join(words))
        for _ in range(rng.choice([0, 0, 1, 2, 6])):
            near = list(words)
            for _ in range(rng.randrange(3)):
                near[rng.randrange(len(near))] = rng.choice(vocab)
            if rng.random() < 0.4:
                near = near[rng.randrange(2) : len(near) - rng.randrange(3)]
            texts.append(" ".join(near).upper() if rng.random() < 0.2 else " ".join(near))
    return texts[:n]


@pytest.mark.parametrize(("boundary", "long_list"), [(None, nj.LIST_ENTRIES), (0, nj.LIST_ENTRIES), (16, 3), (0, 1)])
def test_classes_match_all_pairs(spark, boundary, long_list):
    texts = [None, "", "  \t", "one", "ONE", "one two three four", "one two three four five six seven eight"]
    texts += ["one two three four five six seven eight nine"] + _similar_texts(boundary or 7, 420)
    rows = [(i * 3 % 1009, t) for i, t in enumerate(texts)] + [(None, texts[20]), (6, texts[2]), (3, texts[1]), (12, texts[30]), (12, texts[40])]
    docs = spark.createDataFrame([(d, t, 7, "x") for d, t in rows], "doc_id long, text string, n int, key string").repartition(5)
    got = sorted((tuple(r) for r in nj.join_classes(docs, boundary=boundary, long_list=long_list).collect()), key=repr)
    assert got == _want_classes(rows)
    assert nj.join_classes(docs.limit(0)).collect() == []


def test_large_groups_are_compared_in_cells(spark, monkeypatch):
    # variants of one text that are similar to some others only, in lists of all of them
    rng = random.Random(4)
    base = [f"b{i}" for i in range(60)]
    rows = []
    for i in range(150):
        words = list(base)
        for _ in range(rng.randrange(1, 4)):
            words[rng.randrange(60)] = f"x{rng.randrange(30)}"
        rows.append((i, " ".join(words)))
    monkeypatch.setattr(nj, "CHUNK_MEMBERS", 16)
    monkeypatch.setattr(nj, "FEW_PAIRS", 0)
    monkeypatch.setattr(nj, "CELL_BYTES", 1 << 10)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = sorted((tuple(r) for r in nj.join_classes(docs, boundary=0).collect()), key=repr)
    assert got == _want_classes(rows)


def test_windows_of_long_texts_give_the_same_shingles(monkeypatch):
    text = " ".join(f"w{i % 97}" for i in range(5000)).encode()
    whole = nj.Hasher().sets(text)
    monkeypatch.setattr(nj, "word_windows", lambda t: word_windows(t, 700))
    assert np.array_equal(nj.Hasher().sets(text), whole)
    assert len(whole) == len(_shingles(text.decode()))


def test_the_boundary_follows_cost():
    table = np.zeros(nj.COUNTERS, np.int64)
    table[:1000] = 1
    assert nj.choose_boundary({100: 10}, table) == 0  # nothing light to gain from
    table[:1000] = 100_000  # long lists: small sets are enumerated
    assert nj.choose_boundary({6: 1000, 30: 0}, table) >= 6


# Prefix trie


def _want_trie(turns, base):
    own = collections.defaultdict(list)
    for conv, turn, role, text in turns:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [t[2:] for t in sorted(v)] for c, v in own.items()}
    made = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        root = c - (abs(c) % base) * (1 if c >= 0 else -1) if base else c
        made[c] = own.get(root, [])[:h] + v[h:] if base else v
    nodes = collections.defaultdict(list)
    for c, v in made.items():
        for d in range(len(v) + 1):
            nodes[tuple(v[:d])].append(c)
    under = collections.defaultdict(lambda: [0, 0])
    children = collections.Counter(k[:-1] for k in nodes if k)
    for key, members in nodes.items():
        saved = (len(members) - 1) * (len(key[-1][1].encode().split()) if key else 0)
        for d in range(len(key) + 1):
            under[key[:d]][0] += saved
            under[key[:d]][1] += key not in children
    rows = []
    for key, members in nodes.items():
        ends = ",".join(str(c) for c in sorted(m for m in members if len(made[m]) == len(key)))
        parent = min(nodes[key[:-1]]) if key else None
        saved, leaves = under[key]
        rows.append((min(members), len(key), parent, len(members), children[key], leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(rows, key=repr)


@pytest.mark.parametrize("base", [20, None])
def test_trie_matches_direct_build(spark, monkeypatch, base):
    rng = random.Random(8)
    turns = []
    for conv in [*range(0, 130), *range(200, 260, 3), 10_000, 4095, 4096, 8192, -7, -40]:
        for turn in range(rng.choice([1, 1, 2, 3, 4, 5, 9, 17])):
            turns.append((conv, turn, rng.choice(["user", "assistant"]), rng.choice(["hello there", "a b  c", "x", "  y", ""])))
    turns += [(300, t, "user", f"turn {t % 7} of many") for t in range(200)] + [(301, t, "user", f"turn {t % 7} of many") for t in range(150)]
    turns += [(5, None, "user", None), (5, None, None, "z"), (5, 0, "user", "same"), (5, 0, "user", "same"), (None, 0, "user", "lost"), (7, 70_000, "user", "late")]
    monkeypatch.setattr(pt, "ENDS", 16)
    table = spark.createDataFrame([(*t, 1, "n") for t in turns], "conv_id long, turn long, role string, text string, p int, name string")
    got = sorted((tuple(r) for r in pt.prefix_trie(table, base).collect()), key=repr)
    assert got == _want_trie(turns, base)
    assert pt.prefix_trie(table.limit(0), base).collect() == []


def test_branched_conversation_may_have_no_turn(spark):
    # the base has no turn and the own ones are all among the first
    conv = next(c for c in range(1, 100) if c % 20 and zlib.crc32(str(c).encode()) % 4 == 3)
    turns = [(conv, 0, "user", "a"), (conv, 1, "user", "b")]
    table = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    assert [tuple(r) for r in pt.prefix_trie(table).collect()] == _want_trie(turns, 20)
    assert table.where(F.col("conv_id") == -1).count() == 0


def test_signatures_drop_no_similar_pair():
    rng = np.random.default_rng(5)
    sets, root = [], []
    for n in (1, 4, 31, 32, 33, 60, 64, 65, 300, 513, 2000):
        base = rng.integers(0, 1 << 63, n, dtype=np.uint64)
        for changed in (0, n // 20, n // 9, n // 4, n // 2):
            more = rng.integers(0, 1 << 63, changed, dtype=np.uint64)
            sets += [np.unique(np.concatenate([base[changed:], more])), np.unique(np.concatenate([base, more]))]
            root += [len(root), len(root) + 1]
    sizes = np.array([len(s) for s in sets])
    signatures = [nj.signature(s) for s in sets]
    kept = nj.possible_members(sizes, signatures, np.array(root))
    near, far = np.zeros(len(sets), bool), 0
    for i in range(len(sets)):
        for j in range(len(sets)):
            common = len(np.intersect1d(sets[i], sets[j]))
            link = i != j and nj.similar(common, sizes[i], sizes[j])
            near[i] |= link
            a, b = sorted((signatures[i], signatures[j]), key=len)
            if len(b) <= 2 * len(a):
                words = nj._words([a, b], len(a))
                may = nj.possible(words[0], sizes[i], words[1], sizes[j])
                assert may or not nj.similar(common, sizes[i], sizes[j])
                far += bool(may) and i != j and not link
            else:
                assert not link
    assert near.any() and (kept | ~near).all() and far < near.sum()
    assert not nj.possible_members(sizes, signatures, np.zeros(len(sets), np.int64)).any()
