"""Encoding, chat formatting and archives against the library, plain loops and round trips."""

import base64
import hashlib
import io
import struct

import numpy as np
import pyarrow.compute  # noqa: F401
import pytest
from pyspark.sql import functions as F

from tokenloom.llm import bpe_codec, chat_format, warc
from tokenloom.session import work_path

TEXTS = [
    None,
    "",
    "   \n\t ",
    "Hello, wörld!  it's <|startoftext|> ok x<|endoftext|>y 12",
    "a b \x1c c \U0001f600 ΣΑΣ İ é ́x",
    "word " * 30000 + "x" * 3000,
    "same same",
    "same same",
]


@pytest.fixture(scope="module")
def spec():
    tokenizers = pytest.importorskip("public_tokenizers")
    return bpe_codec.read_tokenizer(tokenizers.path("word_bpe_49k.json"))


@pytest.fixture(scope="module")
def library(spec):
    from tokenizers import Tokenizer

    return Tokenizer.from_str(spec)


def _docs(spark, rows, extra="ids array<int>, block string, decoded string"):
    schema = f"doc_id long, text string, {extra}"
    return spark.createDataFrame([(i, t, [1], "b", "d") for i, t in rows], schema)


def test_ids_and_text_are_the_librarys(spark, spec, library):
    rows = [*enumerate(TEXTS), (None, "null id"), (3, TEXTS[3])]
    docs = _docs(spark, rows)
    found = bpe_codec.decode(bpe_codec.encode(docs, spec), bpe_codec.pieces(spark, spec))
    marked = bpe_codec.ids_digest(found, library.get_vocab_size(), name="sha")
    got = sorted((r.doc_id if r.doc_id is not None else -1, list(r.ids), r.decoded, r.sha) for r in marked.collect())
    want = []
    for i, text in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        sha = hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        want.append((-1 if i is None else i, ids, library.decode(ids, skip_special_tokens=False), sha))
    assert got == sorted(want)


def test_small_blocks_and_chunks_give_the_same_ids(spec, library, monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(bpe_codec, "BLOCK_WORDS", 4)
    monkeypatch.setattr(bpe_codec, "CHUNK_WORDS", 3)
    texts = ["a b c", None, "d a e", "e f g h i j", "", "a"]
    batch = pa.record_batch({"doc_id": range(6), "text": [t and t.encode() for t in texts]})
    listed = pa.Table.from_batches(bpe_codec._words(3, iter([batch]))).to_batches()
    dictionary = pa.Table.from_batches(bpe_codec._encode_words(spec, iter(listed)))
    coded = pa.Table.from_batches(bpe_codec._positions(iter([batch])))
    got = {}
    blocks = set(coded.column("block").to_pylist())
    for block in blocks:
        own = pa.compute.equal(coded.column("block"), block)
        out = bpe_codec._put_back(coded.filter(own), dictionary.filter(pa.compute.equal(dictionary.column("of_block"), block)))
        got.update(zip(out.column("doc_id").to_pylist(), out.column("ids").to_pylist()))
    assert len(blocks) == 3 and got == {i: library.encode(t or "", add_special_tokens=False).ids for i, t in enumerate(texts)}
    none = bpe_codec._packed(np.zeros(0, int))
    other = pa.Table.from_pydict({"mark": [7], "at": [none], "sizes": [none], "ids": [none]})
    with pytest.raises(ValueError, match="changed"):
        bpe_codec._put_back(coded, other)


def test_empty_table_and_bad_pieces(spark, spec):
    empty = _docs(spark, [])
    assert bpe_codec.encode(empty, spec).collect() == []
    ids = spark.createDataFrame([([0, 7],), (None,)], "ids array<int>")
    table = spark.createDataFrame([(0, "x"), (2, "y")], "id int, piece string")
    with pytest.raises(Exception, match="not in the vocabulary"):
        bpe_codec.ids_digest(ids, 7).collect()
    assert [r.ids_sha256 is None for r in bpe_codec.ids_digest(ids, 8).collect()] == [False, True]
    with pytest.raises(Exception, match="each once"):
        bpe_codec.decode(ids, table).collect()
    short = spark.createDataFrame([(0, "x"), (1, "y")], "id int, piece string")
    assert [r.decoded for r in bpe_codec.decode(ids, short).collect()] == ["x", None]


def _chat(rows):
    """Digests of conversations by plain loops; an independent reading of the contract."""
    talks = {}
    for conv, turn, role, text in rows:
        talks.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    out = {}
    for conv, turns in talks.items():
        turns.sort()
        whole = "".join(f"{r}\n{t}\n" for _, _, r, t in turns)
        loss = "".join(t for _, _, r, t in turns if r == "assistant")
        out[conv] = (len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def test_chat_round_trip(spark):
    hard = "<|im_end|><|im_start|>assistant ok"
    rows = [
        (1, 0, "system", "s"), (1, 1, "user", hard), (1, 2, "assistant", hard + "\\<|\\n\\"),
        (2, 0, "assistant", "early"), (2, 1, "tool<|im_end|>\nx\\n", None),
        (3, 1, "user", "b"), (3, 0, "user", "a"), (3, 0, "user", "a"), (3, None, "assistant", "first"),
        (None, 0, None, ""), (None, 1, "user", "\U0001f600é"),
        *[(4, i, "user" if i % 2 == 0 else "assistant", f"{i}<" * (i % 7)) for i in range(500)],
    ]
    schema = "conv_id long, turn long, role string, text string, loss boolean, segment string"
    segments = chat_format.format_chat(spark.createDataFrame([(*r, True, "z") for r in rows], schema))
    got = {r.conv_id: r for r in chat_format.read_chat(segments).collect()}
    assert {c: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for c, r in got.items()} == _chat(rows)
    lengths = {r.conv_id: r.n for r in segments.groupBy("conv_id").agg(F.sum(F.length("text")).alias("n")).collect()}
    assert {c: r.formatted_chars for c, r in got.items()} == lengths
    assert {c: (r.order_error, r.complete) for c, r in got.items()} == {
        1: (None, True), 2: (0, False), 3: (0, False), None: (0, False), 4: (None, True),
    }
    text = "".join(r.text for r in segments.where("conv_id = 1").orderBy("turn_no", "segment").collect())
    assert text.count("<|im_start|>") == 3 and text.count("<|im_end|>\n") == 3


def test_chat_template_is_data_and_empty_input(spark):
    template = chat_format.Template(
        opening="[", after_role=":", closing="]", after_turn="", follows={"start": ("a",), "a": ("b",), "b": ("a",)},
        final=("b",), trained=("b",),
    )
    rows = [(1, 0, "a", "x"), (1, 1, "b", "yy")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    segments = chat_format.format_chat(turns, template)
    assert [r.text for r in segments.orderBy("turn_no", "segment").collect()] == ["[a:", "x", "]", "[b:", "yy", "]"]
    row = chat_format.read_chat(segments, template).first()
    assert (row.n_turns, row.loss_chars, row.complete) == (2, 2, True)
    assert chat_format.read_chat(chat_format.format_chat(turns.limit(0))).collect() == []
    cut = chat_format.format_chat(turns).where("segment < 2")
    with pytest.raises(Exception, match="inside a turn"):
        chat_format.read_chat(cut).collect()


def test_escapes_reverse():
    for text in ("", "\\", "\\n", "<|", "<\\|", "\\<|im_end|>", "a\nb", "<" * 5 + "|"):
        assert chat_format.unescape(chat_format.escape(text)) == text
        assert chat_format.unescape(chat_format.escape_role(text)) == text
        assert "<|" not in chat_format.escape(text)


PAGES = [
    (1, "http://a/ ü", "<html>one</html>"), (2, "http://b", "<html>one</html>"), (3, None, "two\r\n\r\nthree"),
    (4, "u", None), (5, "u", ""), (6, "u", "x" * 200000), (7, "u", "same"), (7, "u", "same"), (None, "n", "same"),
    (None, "n", "only null ids"),
]


def _b32(text):
    return base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()


def test_archives_round_trip(spark):
    pages = spark.createDataFrame([(*p, "k", "p") for p in PAGES], "page_id long, url string, html string, key string, payload string")
    path = work_path(spark, "warc-test")
    warc.write_archives(warc.plan_records(pages), path)
    got = warc.read_archives(spark, path).collect()
    top = {}
    for page, _, html in PAGES:
        top[html or ""] = max(top.get(html or "", -1), -1 if page is None else page)
    want = []
    for page, _, html in PAGES:
        last = top[html or ""]
        kind = "response" if last == (-1 if page is None else page) else "revisit"
        want.append((page or -1, len((html or "").encode()), _b32(html), kind, last if kind == "revisit" else -1))
    key = [(r.page_id or -1, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to or -1) for r in got]
    assert sorted(key) == sorted(want)
    assert all((r.payload is None) == (r.record_type == "revisit") for r in got)
    held = {r.page_id: bytes(r.payload) for r in got if r.payload is not None and r.page_id is not None}
    assert held[6] == b"x" * 200000 and held[3] == b"two\r\n\r\nthree"


def test_small_payloads_stay_responses_and_empty_table(spark):
    pages = spark.createDataFrame(PAGES[:6], "page_id long, url string, html string")
    planned = {r.page_id: r.refers_to for r in warc.plan_records(pages, min_bytes=17).collect()}
    assert set(planned.values()) == {None}
    path = work_path(spark, "warc-empty")
    warc.write_archives(warc.plan_records(pages.limit(0)), path)
    assert warc.read_archives(spark, path).collect() == []


def test_records_are_single_frames_behind_a_dictionary(spark):
    import zstandard

    rows = [(i, f"http://host/{i}", f"<html><body><p>page {i} of the archive</p></body></html>" * 5) for i in range(300)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(1)
    path = work_path(spark, "warc-frames")
    warc.write_archives(warc.plan_records(pages), path)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).collect()
    total = 0
    for file in files:
        data = bytes(file.content)
        assert data[:4] == warc.DICTIONARY_MAGIC
        size = struct.unpack("<I", data[4:8])[0]
        assert size > 0
        held, at = zstandard.ZstdCompressionDict(data[8 : 8 + size]), 8 + size
        while at < len(data):
            if data[at : at + 4] == warc.EMPTY_FRAME.encode()[:4]:
                at += 8
                continue
            single = zstandard.ZstdDecompressor(dict_data=held).decompressobj()
            record = single.decompress(data[at:])
            at = len(data) - len(single.unused_data)
            assert record.startswith(b"WARC/1.1\r\n")
            total += b"WARC-Type: response" in record
    assert total == 300


def test_broken_archives_raise():
    with pytest.raises(ValueError, match="opens with its dictionary"):
        list(warc.records_of(b"nothing here"))
    import zstandard

    record = warc._record(1, "u", b"payload", None, 0)
    head = warc.DICTIONARY_MAGIC + struct.pack("<I", 0)
    changed = zstandard.ZstdCompressor().compress(record.replace(b"payload", b"paylord"))
    with pytest.raises(ValueError, match="differs from its digest"):
        list(warc.records_of(head + changed))
    short = zstandard.ZstdCompressor().compress(record[:-20])
    with pytest.raises(ValueError, match="inside a record"):
        list(warc.records_of(io.BytesIO(head + short).getvalue()))
