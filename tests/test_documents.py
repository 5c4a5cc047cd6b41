import random

import pytest
from pyspark.sql import functions as F

from tokenloom.operators import documents as D
from tokenloom.sources import corpus


def split_documents(text):
    docs, run = [], []
    for line in text.splitlines():
        if line.strip():
            run.append(line)
        elif run:
            docs.append("\n".join(run) + "\n")
            run = []
    return docs + (["\n".join(run) + "\n"] if run else [])


def read_back(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.file.rsplit("/", 1)[-1], {})[r.doc_no] = r.text
    return {f: [d[i] for i in range(len(d))] for f, d in out.items()}


def write(folder, name, data):
    folder.mkdir(exist_ok=True)
    (folder / name).write_bytes(data.encode() if isinstance(data, str) else data)


def test_blank_lines_and_edges(spark, tmp_path):
    files = {
        "blank.txt": "a1\na2\n\n\nb1\n \t\nc1\nc2\n\n",
        "edges.txt": "\n\n\nx1\nx2\n\ny1",
        "crlf.txt": "p1\r\np2\r\n\r\nq1\r\n",
        "all_blank.txt": "\n \n\t\n",
    }
    for name, text in files.items():
        write(tmp_path / "in", name, text)
    got = read_back(D.documents(corpus.scan_corpus(spark, str(tmp_path / "in"))))
    assert got == {n: split_documents(t) for n, t in files.items() if split_documents(t)}


def test_broken_bytes(spark, tmp_path):
    write(tmp_path / "in", "a.txt", b"f\xff\xfeg\n")
    kept = corpus.scan_corpus(spark, str(tmp_path / "in"), drop_bad_bytes=True).first().line
    assert kept == "fg"


@pytest.mark.parametrize("split_bytes", ["2048", "16384"])
def test_files_of_many_splits(spark, tmp_path, split_bytes):
    """One file holds most of the lines, and its documents cross read splits."""
    rng = random.Random(5)
    files = {}
    for name, size in (("hot.txt", 4000), ("b.txt", 300), ("c.txt", 200)):
        rows = ["" if rng.random() < 0.3 else "w" * rng.randint(1, 40) for _ in range(size)]
        rows[size // 3 : size // 3 + 200] = [f"long{i}" * 10 for i in range(200)]
        files[name] = "\n".join(rows) + "\n"
        write(tmp_path / "in", name, files[name])
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split_bytes)
    try:
        lines = corpus.scan_corpus(spark, str(tmp_path / "in"))
        assert lines.select("file", "block_start").distinct().count() >= 7
        assert read_back(D.documents(lines)) == {n: split_documents(t) for n, t in files.items()}
        chunks = D.line_chunks(lines, 150)
        for name, text in files.items():
            rows = chunks.where(F.col("file").endswith(name)).orderBy("chunk_no").collect()
            assert "".join(r.text for r in rows) == text
            sizes = [r.n_lines for r in rows]
            assert sizes[:-1] == [150] * (len(sizes) - 1) and sum(sizes) == len(text.splitlines())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_chunks_keep_the_rest(spark, tmp_path):
    write(tmp_path / "in", "a.txt", "".join(f"l{i}\n" for i in range(7)))
    rows = D.line_chunks(corpus.scan_corpus(spark, str(tmp_path / "in")), 3).orderBy("chunk_no").collect()
    assert [(r.chunk_no, r.n_lines, r.text) for r in rows] == [
        (0, 3, "l0\nl1\nl2\n"), (1, 3, "l3\nl4\nl5\n"), (2, 1, "l6\n")
    ]


@pytest.mark.parametrize("per_block", [1, 16, 4096])
def test_table_documents_with_a_hot_source(spark, per_block):
    rows = [(i, "hot" if i % 3 else f"s{i % 7}", f"t{i}\nsecond line {i}") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = D.documents(D.table_lines(docs, docs_per_block=per_block))
    texts = {}
    for i, source, text in rows:
        texts.setdefault(source, []).append(text + "\n")
    assert read_back(got) == texts


def test_doc_ids_count_over_files(spark, tmp_path):
    for name in "abc":
        write(tmp_path / "in", f"{name}.txt", f"{name}1\n\n{name}2\n")
    out = D.with_doc_ids(D.documents(corpus.scan_corpus(spark, str(tmp_path / "in")))).orderBy("doc_id").collect()
    assert [(r.doc_id, r.text) for r in out] == list(enumerate(f"{n}{i}\n" for n in "abc" for i in (1, 2)))


def test_scan_options(spark, tmp_path):
    write(tmp_path / "in", "b.txt", "b\n")
    write(tmp_path / "in", "a.txt", "a\n")
    write(tmp_path / "in", "note.md", "no\n")
    write(tmp_path / "in" / "sub", "c.txt", "c\n")
    path = str(tmp_path / "in")

    def lines(**options):
        return sorted(r.line for r in corpus.scan_corpus(spark, path, **options).collect())

    assert lines() == ["a", "b", "c"]
    assert lines(recursive=False) == ["a", "b"]
    assert lines(max_files=2) == ["a", "b"]
    assert [r.line for r in corpus.scan_corpus(spark, path + "/note.md").collect()] == ["no"]
    with pytest.raises(ValueError):
        (tmp_path / "empty").mkdir()
        corpus.scan_corpus(spark, str(tmp_path / "empty"))


def test_training_lines_prompts_and_results(spark, tmp_path):
    write(tmp_path / "in", "p.txt", "  one \n\n \ttwo　\n   \n")
    lines = corpus.scan_corpus(spark, str(tmp_path / "in"))
    assert [r.line for r in D.training_lines(lines).orderBy("row_key").collect()] == ["one", "two"]
    prompts = corpus.scan_prompts(spark, str(tmp_path / "in" / "p.txt")).orderBy("prompt_no").collect()
    assert [r.prompt for r in prompts] == ["one", "two"]
    df = spark.createDataFrame([(2, "second"), (1, "first\nline")], "id long, result string").coalesce(1)
    corpus.write_results(df, str(tmp_path / "out"), order_by="id")
    text = "".join(p.read_text() for p in sorted((tmp_path / "out").glob("part*")))
    assert text == "first\nline\n\n---\n\nsecond\n\n---\n\n"


def test_export_order_and_limit(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"text {i}", "hot" if i % 3 else "x") for i in range(50)], "doc_id long, text string, source string")
    corpus.export_corpus(docs.repartition(5), str(tmp_path / "o"), limit=20)
    text = "".join(p.read_text() for p in sorted((tmp_path / "o").glob("part*")))
    assert text == "".join(f"text {i}\n\n" for i in range(20))
    corpus.export_corpus(docs.repartition(5), str(tmp_path / "s"), partition_by="source")
    hot = "".join(p.read_text() for p in sorted((tmp_path / "s" / "source=hot").glob("part*")))
    assert hot == "".join(f"text {i}\n\n" for i in range(50) if i % 3)
