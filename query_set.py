"""The queries behind ``__spark_entry__``: one per operator, over the whole tables.

Inputs that several operators share (the word counts, the vocabulary, the written token stream) are
made from the tables once per session and folder, as a user would make them once.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tokenloom.functions.positions import running_before
from tokenloom.operators import chat, documents, encode, packing, runs, scoring, stream, vocab, words
from tokenloom.operators.bpe import pair_counts, segments, train_bpe
from tokenloom.operators.unigram import seed_pieces, train_unigram
from tokenloom.plans import prepare, steps
from tokenloom.session import materialize, work_path
from tokenloom.sources import corpus, run_logs, token_bin, vocab_files
from tokenloom.streaming import early_stop, files

# Parameters the oracle SQL uses as well.
WORD_VOCAB = 32000
CONTEXT = 128
BATCH = 8
CHUNK = 100
BPE_VOCAB = 1000  # where SQL repeats the training one merge at a time
FULL_BPE_VOCAB = 32000
UNIGRAM_VOCAB = 1000
UNIGRAM_SEEDS = 4000
NEWLINE_ID = 7 + 10
EXPORT_LIMIT = 300

Query = Callable[[SparkSession, str], DataFrame]


def _shared(make: Query) -> Query:
    made: dict = {}

    @functools.wraps(make)
    def get(spark: SparkSession, sf: str) -> DataFrame:
        key = (spark.sparkContext.applicationId, sf)
        if key not in made:
            made[key] = make(spark, sf)
        return made[key]

    return get


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def docs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents")


def lines(spark: SparkSession, sf: str) -> DataFrame:
    return documents.table_lines(docs(spark, sf))


def csv(ids: str | Column) -> Column:
    return F.array_join(F.col(ids) if isinstance(ids, str) else ids, ",")


@_shared
def counted(spark: SparkSession, sf: str) -> DataFrame:
    return materialize(words.word_counts(docs(spark, sf).select("text")), "words")


@_shared
def letters(spark: SparkSession, sf: str) -> DataFrame:
    return materialize(words.alphabet(counted(spark, sf)), "alphabet")


@_shared
def word_vocab(spark: SparkSession, sf: str) -> DataFrame:
    pieces = words.train_word(counted(spark, sf), WORD_VOCAB)
    return materialize(vocab.assemble_vocab(pieces, None, WORD_VOCAB), "vocab")


@_shared
def word_encoder(spark: SparkSession, sf: str):
    return encode.encoder(word_vocab(spark, sf), "word")


@_shared
def merges(spark: SparkSession, sf: str) -> DataFrame:
    return materialize(train_bpe(counted(spark, sf), BPE_VOCAB, letters(spark, sf)), "merges")


@_shared
def unigram_pieces(spark: SparkSession, sf: str) -> DataFrame:
    return materialize(train_unigram(counted(spark, sf), UNIGRAM_VOCAB, UNIGRAM_SEEDS), "pieces")


@_shared
def unigram_vocab(spark: SparkSession, sf: str) -> DataFrame:
    return materialize(vocab.assemble_vocab(unigram_pieces(spark, sf), None, UNIGRAM_VOCAB), "vocab")


@_shared
def bpe_vocab(spark: SparkSession, sf: str) -> DataFrame:
    return materialize(vocab.assemble_vocab(merges(spark, sf), letters(spark, sf), BPE_VOCAB), "vocab")


@_shared
def full_merges(spark: SparkSession, sf: str) -> DataFrame:
    return materialize(train_bpe(counted(spark, sf), FULL_BPE_VOCAB, letters(spark, sf)), "merges")


@_shared
def full_bpe_vocab(spark: SparkSession, sf: str) -> DataFrame:
    made = vocab.assemble_vocab(full_merges(spark, sf), letters(spark, sf), FULL_BPE_VOCAB)
    return materialize(made, "vocab")


@_shared
def stream_path(spark: SparkSession, sf: str) -> str:
    path = work_path(spark, "stream")
    stream.write_stream(docs(spark, sf).select("doc_id", "text"), word_encoder(spark, sf), path)
    return path


def token_rows(spark: SparkSession, sf: str) -> DataFrame:
    return stream.read_stream(spark, stream_path(spark, sf))


def token_count(spark: SparkSession, sf: str) -> int:
    return stream.stream_total(spark, stream_path(spark, sf))


def sequences(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pack_disjoint(token_rows(spark, sf), CONTEXT, token_count(spark, sf))


def sequence_total(spark: SparkSession, sf: str) -> int:
    return token_count(spark, sf) // (CONTEXT + 1)


# --- sources and sinks


@_shared
def exported(spark: SparkSession, sf: str) -> str:
    path = work_path(spark, "corpus")
    corpus.export_corpus(docs(spark, sf), path, partition_by="source")
    return path


def a1_scan_corpus(spark, sf):
    scanned = corpus.scan_corpus(spark, exported(spark, sf))
    source = F.regexp_extract("file", "source=([^/]+)/", 1)
    blank = documents.is_blank(F.col("line")).cast("long")
    return scanned.groupBy(source.alias("source")).agg(
        F.count("*").alias("n_lines"), F.sum(blank).alias("n_blank"), F.sum(F.length("line")).alias("n_chars")
    )


def a2_documents(spark, sf):
    return documents.documents(lines(spark, sf))


def a3_training_lines(spark, sf):
    return documents.training_lines(lines(spark, sf)).select("file", "line")


def a4_line_chunks(spark, sf):
    return documents.line_chunks(lines(spark, sf), CHUNK)


def a5_export_corpus(spark, sf):
    path = work_path(spark, "export")
    corpus.export_corpus(docs(spark, sf), path)
    return spark.read.option("lineSep", "\n\n").text(path).withColumnRenamed("value", "text")


def a5_export_limit(spark, sf):
    path = work_path(spark, "export")
    corpus.export_corpus(docs(spark, sf), path, limit=EXPORT_LIMIT)
    return spark.read.option("lineSep", "\n\n").text(path).withColumnRenamed("value", "text")


def a6_scan_prompts(spark, sf):
    path = work_path(spark, "prompts")
    table(spark, sf, "benchmark").select("text").write.text(path)
    return corpus.scan_prompts(spark, path).select("prompt")


def a7_write_results(spark, sf):
    path = work_path(spark, "results")
    corpus.write_results(table(spark, sf, "benchmark"), path, "text", order_by="item_id")
    return corpus.read_results(spark, path)


def a8_read_tokens(spark, sf):
    path = work_path(spark, "tokens")
    token_bin.write_tokens(token_rows(spark, sf), path, header=False)
    blocks = token_bin.read_tokens(spark, path, header=False)
    one = blocks.select("start_pos", F.posexplode("ids").alias("at", "id"))
    place = F.pmod(F.col("start_pos") + F.col("at"), F.lit(10007))
    return one.agg(F.count("*").alias("n_tokens"), F.sum(place * F.col("id")).alias("checksum"))


def a9_write_tokens(spark, sf):
    path = work_path(spark, "tokens")
    token_bin.write_tokens(token_rows(spark, sf), path)
    back = token_bin.as_stream(token_bin.read_tokens(spark, path))
    return packing.pack_disjoint(back, 1023).select("seq_idx", csv("tokens").alias("tokens"))


def a10_read_vocab(spark, sf):
    path = work_path(spark, "vocab")
    vocab_files.write_vocab(word_vocab(spark, sf), path)
    return vocab_files.read_vocab(spark, path)


def a11_write_vocab(spark, sf):
    path = work_path(spark, "vocab")
    vocab_files.write_vocab(word_vocab(spark, sf), path)
    return spark.read.text(path).withColumnRenamed("value", "row")


def metrics(events: DataFrame) -> DataFrame:
    """The events as log rows: a run per user; an error event is an evaluation."""
    value, is_eval = F.col("value"), F.col("event_type") == "error"
    return events.select(
        F.col("user_id").cast("string").alias("run"),
        F.col("event_id").alias("step"),
        F.col("ts").alias("timestamp"),
        F.when(~is_eval, value / 7).alias("train_loss"),
        F.when(is_eval, value / 3).alias("val_loss"),
        F.when(~is_eval, value * 1e-6).alias("learning_rate"),
        F.when(~is_eval, value * 11.3).alias("tokens_per_sec"),
        F.when(F.col("event_type") == "click", value / 13).alias("grad_norm"),
    )


def a12_read_metrics(spark, sf):
    path = work_path(spark, "metrics")
    run_logs.append_metrics(metrics(table(spark, sf, "events")), path)
    return run_logs.read_metrics(spark, path)


def a13_append_metrics(spark, sf):
    return run_logs.format_metrics(metrics(table(spark, sf, "events")))


def a14_read_checkpoints(spark, sf):
    path = work_path(spark, "checkpoints")
    saves = table(spark, sf, "events").groupBy("user_id").agg(
        F.count("*").alias("step"), F.round(F.avg("value"), 6).alias("val_loss")
    )
    width = (F.col("user_id") % 8 + 1) * 64
    manifest = saves.select(
        F.col("user_id").cast("string").alias("run"),
        F.concat(F.lit("step_"), "step").alias("ckpt"),
        F.struct(
            (F.col("user_id") * 100 + 1000).alias("vocab_size"),
            width.alias("embedding_dim"),
            (F.col("user_id") % 12 + 1).alias("num_layers"),
            F.lit(8).alias("num_heads"),
            (width * 4).alias("ff_dim"),
            F.lit(1024).alias("context_length"),
            F.lit(0.0).alias("dropout"),
            F.lit(10000.0).alias("rope_theta"),
            F.lit("dropped").alias("unknown_key"),
        ).alias("model"),
        F.struct(F.lit(3e-4).alias("learning_rate"), F.lit(100000).alias("max_steps")).alias("training"),
        "step",
        "val_loss",
    )
    run_logs.write_checkpoints(manifest, path)
    return run_logs.read_checkpoints(spark, path).select(
        "run", "step", "val_loss", F.col("model.embedding_dim").alias("embedding_dim"), "estimated_params",
        "estimated_params_no_norms",
    )


# --- vocabulary and encoding


def b1_word_counts(spark, sf):
    return words.word_counts(docs(spark, sf).select("text"))


def b2_alphabet(spark, sf):
    return words.alphabet(counted(spark, sf))


def b3_train_bpe(spark, sf):
    return merges(spark, sf)


def b3_train_bpe_full(spark, sf):
    return full_merges(spark, sf)


def b3_pair_counts(spark, sf):
    return pair_counts(segments(counted(spark, sf), letters(spark, sf)))


def b4_seed_pieces(spark, sf):
    return seed_pieces(counted(spark, sf), None)


def b4_train_unigram(spark, sf):
    return unigram_pieces(spark, sf)


def b5_train_word(spark, sf):
    return words.train_word(counted(spark, sf), WORD_VOCAB)


def b5_train_char(spark, sf):
    return words.train_char(counted(spark, sf), WORD_VOCAB)


def b6_assemble_vocab(spark, sf):
    pieces = words.train_word(counted(spark, sf), WORD_VOCAB)
    return vocab.assemble_vocab(pieces, letters(spark, sf), WORD_VOCAB)


def b7_encode(spark, sf):
    out = encode.encode(docs(spark, sf), word_encoder(spark, sf), add_bos=True, add_eos=True)
    return out.select("doc_id", csv("ids").alias("ids"))


def b7_encode_bpe(spark, sf):
    out = encode.encode(docs(spark, sf), encode.encoder(bpe_vocab(spark, sf), "bpe"), add_eos=True)
    return out.select("doc_id", csv("ids").alias("ids"))


def b7_encode_bpe_full(spark, sf):
    out = encode.encode(docs(spark, sf), encode.encoder(full_bpe_vocab(spark, sf), "bpe"), add_eos=True)
    return out.select("doc_id", csv("ids").alias("ids"))


def b8_decode(spark, sf):
    ids = token_rows(spark, sf).select("doc_id", "ids")
    return encode.decode(ids, word_vocab(spark, sf)).select("doc_id", "text")


def round_trip(spark, sf, vocabulary: DataFrame, model: str) -> DataFrame:
    encoded = encode.encode(docs(spark, sf), encode.encoder(vocabulary, model), add_bos=True, add_eos=True)
    return encode.decode(encoded.select("doc_id", "ids"), vocabulary).select("doc_id", "text")


def b8_decode_bpe(spark, sf):
    return round_trip(spark, sf, bpe_vocab(spark, sf), "bpe")


def b8_decode_bpe_full(spark, sf):
    return round_trip(spark, sf, full_bpe_vocab(spark, sf), "bpe")


def b8_decode_unigram(spark, sf):
    return round_trip(spark, sf, unigram_vocab(spark, sf), "unigram")


def b9_encode_chat(spark, sf):
    out = chat.encode_chat(table(spark, sf, "conversations"), word_encoder(spark, sf))
    return out.select("conv_id", csv("ids").alias("ids"))


def b10_render_chat(spark, sf):
    return chat.render_chat(table(spark, sf, "conversations"))


def b11_lookup(spark, sf):
    found = vocab.lookup_id(counted(spark, sf), word_vocab(spark, sf), "word")
    return vocab.lookup_piece(found, word_vocab(spark, sf)).select("word", "id", "piece")


def b12_vocab_info(spark, sf):
    return vocab.vocab_info(word_vocab(spark, sf))


def b13_token_stats(spark, sf):
    out = encode.encode(docs(spark, sf), word_encoder(spark, sf))
    stats = encode.token_stats(out, file="source")
    return stats.withColumn("chars_per_token", F.round("chars_per_token", 6))


# --- the token stream


def c1_token_stream(spark, sf):
    out = stream.token_stream(docs(spark, sf).select("doc_id", "text"), word_encoder(spark, sf))
    return out.select("doc_id", "start_pos", "n_tokens", csv("ids").alias("ids"))


def c2_check_ids(spark, sf):
    return stream.check_ids(token_rows(spark, sf), 5000)


def c3_token_at(spark, sf):
    pos = F.pmod(F.col("doc_id") * 7919 * F.col("n_chars"), F.lit(3_000_000)) - 1_000_000
    requests = docs(spark, sf).select(F.col("doc_id").alias("request_id"), pos.alias("pos"))
    return stream.read_token_at(spark, stream_path(spark, sf), requests)


def slice_requests(documents_table: DataFrame) -> DataFrame:
    start = F.pmod(F.col("doc_id") * 7919 * F.col("n_chars"), F.lit(2_000_000)) - 500_000
    kind = F.col("doc_id") % 5
    length = 50 + F.col("n_chars") % 300
    rows = documents_table.select(F.col("doc_id").alias("request_id"), start.alias("s"), kind.alias("k"), length.alias("l"))
    first = F.when(F.col("k") == 3, F.col("s") + F.col("l")).when(F.col("k") == 4, None).otherwise(F.col("s"))
    stop = F.when(F.col("k") == 3, F.col("s")).when(F.col("k") == 4, F.col("l")).otherwise(F.col("s") + F.col("l"))
    step = F.when(F.col("k") == 2, 3).when(F.col("k") == 3, -2).otherwise(1)
    return rows.select("request_id", first.alias("start"), stop.alias("stop"), step.cast("long").alias("step"))


def c4_token_slices(spark, sf):
    out = stream.read_slices(spark, stream_path(spark, sf), slice_requests(docs(spark, sf)))
    return out.select("request_id", csv("ids").alias("ids"))


def c4_get_chunk(spark, sf):
    start = F.pmod(F.col("doc_id") * 7919 * F.col("n_chars"), F.lit(2_000_000)) - 500_000
    requests = docs(spark, sf).select(
        F.col("doc_id").alias("request_id"), start.alias("start"), (50 + F.col("n_chars") % 300).alias("length")
    )
    out = stream.read_chunks(spark, stream_path(spark, sf), requests)
    return out.select("request_id", csv("ids").alias("ids"), "error")


def c5_split(spark, sf):
    out = stream.split(token_rows(spark, sf), 0.05, token_count(spark, sf))
    return out.select("split", "doc_id", "start_pos", "n_tokens", csv("ids").alias("ids"))


def c6_pack_disjoint(spark, sf):
    return sequences(spark, sf).select("seq_idx", csv("tokens").alias("tokens"))


def c7_pack_overlap(spark, sf):
    out = packing.pack_overlap(token_rows(spark, sf), CONTEXT, token_count(spark, sf))
    return out.select("seq_idx", csv("tokens").alias("tokens"))


def c8_shift_targets(spark, sf):
    out = packing.shift_targets(sequences(spark, sf))
    return out.select("seq_idx", csv("input_ids").alias("input_ids"), csv("target_ids").alias("target_ids"))


def c9_shuffle(spark, sf):
    out = packing.shuffle(
        sequences(spark, sf), seed=42, epoch=1, reshuffle_each_epoch=True, num_sequences=sequence_total(spark, sf)
    )
    return out.select("rank", "seq_idx", csv("tokens").alias("tokens"))


def c10_batches(spark, sf):
    count = sequence_total(spark, sf)
    ranked = packing.shuffle(sequences(spark, sf), num_sequences=count)
    out = packing.batches(ranked, BATCH, count)
    return out.select("batch_no", "slot", "seq_idx", csv("tokens").alias("tokens"))


def c11_get_batch(spark, sf):
    lo, hi = packing.batch_positions(3, BATCH, CONTEXT)
    rows = stream.read_stream(spark, stream_path(spark, sf), lo, hi)
    out = packing.get_batch(packing.pack_disjoint(rows, CONTEXT, token_count(spark, sf)), 3, BATCH)
    return out.select("slot", "seq_idx", csv("input_ids").alias("input_ids"), csv("target_ids").alias("target_ids"))


def c12_loaders(spark, sf):
    total = token_count(spark, sf)
    train, val = (stream.read_part(spark, stream_path(spark, sf), 0.05, name) for name in ("train", "val"))
    held_out = int(total * 0.05)
    out = packing.loaders(train, val, CONTEXT, BATCH, totals=(total - held_out, held_out))
    return out.select(
        "split", "batch_no", "slot", "seq_idx", csv("input_ids").alias("input_ids"), csv("target_ids").alias("target_ids")
    )


def c13_dataset_stats(spark, sf):
    out = stream.dataset_stats(token_rows(spark, sf), CONTEXT)
    return out.select("total_tokens", "num_sequences", *[F.round(c, 9).alias(c) for c in out.columns[2:]])


@_shared
def prepared(spark: SparkSession, sf: str) -> tuple[prepare.Prepared, str]:
    out = work_path(spark, "prepared")
    made = prepare.prepare_all(
        spark, exported(spark, sf), WORD_VOCAB, model="word", context_length=CONTEXT, coverage=1.0, out=out
    )
    return made, out


def c14_prepare_parts(spark, sf):
    parts = prepared(spark, sf)[0].parts
    return parts.select("split", "doc_id", "start_pos", "n_tokens", csv("ids").alias("ids"))


def c14_prepare_files(spark, sf):
    return file_tokens(spark, prepared(spark, sf)[1], True)


def c14_prepare_chunks(spark, sf):
    raw, out = work_path(spark, "flat"), work_path(spark, "prepared")
    corpus.export_corpus(docs(spark, sf), raw)
    prepare.prepare_all(
        spark, raw, WORD_VOCAB, mode="chunks", model="word", context_length=CONTEXT, chunk_size=CHUNK, coverage=1.0, out=out
    )
    return file_tokens(spark, out, False)


def file_tokens(spark: SparkSession, out: str, header: bool) -> DataFrame:
    files_of = {name: token_bin.read_tokens(spark, f"{out}/{name}", header) for name in ("train", "val")}
    tokens = [
        df.select(F.lit(name).alias("split"), "start_pos", F.posexplode("ids").alias("i", "token_id"))
        for name, df in files_of.items()
    ]
    return tokens[0].unionByName(tokens[1]).select("split", (F.col("start_pos") + F.col("i")).alias("pos"), "token_id")


def c14_prepare_all(spark, sf):
    made = prepared(spark, sf)[0]
    return made.stats.select("split", "total_tokens", "num_sequences", F.round("file_size_mb", 9).alias("file_size_mb"))


def c15_step_plan(spark, sf):
    count = sequence_total(spark, sf) // BATCH
    plan = steps.step_plan(spark, count, BATCH, CONTEXT, count, accumulation_steps=2, warmup_steps=20)
    order = packing.permutation(spark.range(sequence_total(spark, sf)).withColumnRenamed("id", "seq_idx"))
    firsts = packing.batches(order, BATCH, sequence_total(spark, sf)).where("slot = 0")
    return plan.join(firsts.select("batch_no", F.col("seq_idx").alias("first_seq")), "batch_no").select(
        "step", "micro_step", "epoch", "batch_no", F.round("learning_rate", 12).alias("learning_rate"), "tokens_seen", "first_seq"
    )


# --- scores


def logits(spark, sf):
    return table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("row_id"), F.col("embedding").alias("logits"), F.col("label").alias("target")
    )


def cands(spark, sf):
    return scoring.candidates(logits(spark, sf))


def history(spark, sf):
    rows = logits(spark, sf)
    seen = F.array(F.col("target"), (F.col("row_id") % 64).cast("int"), F.col("target"))
    return rows.select("row_id", F.explode(seen).alias("token_id"))


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


def d1_cross_entropy(spark, sf):
    return rounded(scoring.cross_entropy(logits(spark, sf)), "loss")


def d2_evaluate(spark, sf):
    scored = logits(spark, sf).select(
        F.floor(F.col("row_id") / BATCH).alias("batch_no"),
        scoring.row_loss(F.col("logits"), F.col("target")).alias("loss"),
    )
    return rounded(scoring.evaluate(scored, 25), "val_loss")


def d3_repetition_penalty(spark, sf):
    return rounded(scoring.candidates(logits(spark, sf), history=history(spark, sf), penalty=1.3), "logit")


def d4_temperature(spark, sf):
    warm = scoring.temperature(cands(spark, sf), 0.8).withColumn("mode", F.lit("warm"))
    greedy = scoring.temperature(cands(spark, sf), 0.0).withColumn("mode", F.lit("greedy"))
    return rounded(warm.unionByName(greedy), "logit")


def d5_top_k(spark, sf):
    return rounded(scoring.top_k(cands(spark, sf), 10), "logit")


def d6_top_p(spark, sf):
    return rounded(scoring.top_p(cands(spark, sf), 0.6), "logit")


def d7_sample(spark, sf):
    return scoring.next_token(logits(spark, sf), history(spark, sf), 1.3, 0.8, 20, 0.9, seed=7)


def d8_truncate_prompts(spark, sf):
    out = scoring.truncate_prompts(token_rows(spark, sf).select("doc_id", "ids"), 257)
    return out.select("doc_id", csv("ids").alias("ids"), "truncated")


def d9_cut_at_stop(spark, sf):
    out = scoring.cut_at_stop(token_rows(spark, sf).select("doc_id", "ids"), [NEWLINE_ID])
    return out.select("doc_id", csv("ids").alias("ids"))


def d10_extract_response(spark, sf):
    rows = table(spark, sf, "conversations").select(
        "conv_id", "turn", F.concat("role", F.lit(":\n")).alias("prompt"), F.concat("role", F.lit(":\n"), "text").alias("full")
    )
    return scoring.extract_response(rows).select("conv_id", "turn", "response")


# --- runs


@_shared
def steps_of(spark, sf):
    """The events as training steps: a run per user, numbered by time. Whole seconds keep sums exact,
    so results that follow from them compare without rounding."""
    events = table(spark, sf, "events").withColumn("hour", F.date_trunc("hour", "ts"))
    numbered = running_before(events, "step", F.lit(1), "hour", ["ts", "event_id"], within=["user_id"])
    steps_table = numbered.select(
        F.col("user_id").alias("run"),
        "step",
        (100 + F.col("event_id") % 50).alias("tokens"),
        F.round(F.col("value") * 100).alias("seconds"),
        F.col("value").alias("val_loss"),
    )
    return materialize(steps_table, "steps")


def e1_throughput(spark, sf):
    return runs.throughput(steps_of(spark, sf), 10)


def e2_early_stopping(spark, sf):
    return runs.early_stopping(steps_of(spark, sf), patience=20, min_delta=0.5)


def e3_best_checkpoints(spark, sf):
    return runs.best_checkpoints(steps_of(spark, sf).select("run", "step", "val_loss"))


def e4_retention(spark, sf):
    return runs.retention(steps_of(spark, sf).select("run", "step", "val_loss"), 3)


def e5_step_time_report(spark, sf):
    return runs.step_time_report(steps_of(spark, sf), total_steps=100_000, tokens_per_step=8192)


def e6_cloud_cost(spark, sf):
    return runs.cloud_cost(e5_step_time_report(spark, sf))


# --- streaming


def f1_stream_prepare(spark, sf):
    return streamed(spark, sf).groupBy("source").agg(
        F.count("*").alias("n_docs"),
        F.sum(F.size("ids")).alias("n_tokens"),
        F.sum(F.aggregate("ids", F.lit(0).cast("long"), lambda a, i: a + i)).alias("id_sum"),
    )


def f1_stream_prepare_ids(spark, sf):
    return streamed(spark, sf).select("source", csv("ids").alias("ids"))


@_shared
def streamed(spark: SparkSession, sf: str) -> DataFrame:
    target, state = work_path(spark, "streamed"), work_path(spark, "streamed-state")
    query = files.stream_prepare(
        spark, exported(spark, sf), target, state, word_encoder(spark, sf), max_files_per_trigger=100
    )
    query.awaitTermination()
    if query.exception():
        raise query.exception()
    source = F.regexp_extract("file", "source=([^/]+)/", 1)
    return spark.read.parquet(target).withColumn("source", source)


def f2_stream_early_stopping(spark, sf):
    source, target, state = (work_path(spark, n) for n in ("evals", "judged", "judged-state"))
    steps_of(spark, sf).select("run", "step", "val_loss").write.parquet(source)
    evals = spark.readStream.schema("run long, step long, val_loss double").parquet(source)
    query = (
        early_stop.stream_early_stopping(evals, patience=20, min_delta=0.5)
        .writeStream.option("checkpointLocation", state)
        .trigger(availableNow=True)
        .format("parquet")
        .start(target)
    )
    query.awaitTermination()
    if query.exception():
        raise query.exception()
    judged = spark.read.parquet(target)
    return judged.groupBy("run").agg(
        F.max_by("best_step", "step").alias("best_step"),
        F.max_by("best_loss", "step").alias("best_loss"),
        F.sum(F.col("accepted").cast("long")).alias("n_accepted"),
        F.max(F.when(F.col("stopped"), F.col("step"))).alias("stop_step"),
    )


def f3_stream_metrics_sink(spark, sf):
    target, state = work_path(spark, "logged"), work_path(spark, "logged-state")
    source = work_path(spark, "events")
    table(spark, sf, "events").write.parquet(source)
    events = spark.readStream.schema(spark.read.parquet(source).schema).parquet(source)
    query = files.stream_metrics_sink(metrics(events), target, state)
    query.awaitTermination()
    if query.exception():
        raise query.exception()
    return run_logs.read_metrics(spark, target)


QUERIES: dict[str, Query] = {
    "A1_scan_corpus": a1_scan_corpus,
    "A2_documents": a2_documents,
    "A3_training_lines": a3_training_lines,
    "A4_line_chunks": a4_line_chunks,
    "A5_export_corpus": a5_export_corpus,
    "A5_export_limit": a5_export_limit,
    "A6_scan_prompts": a6_scan_prompts,
    "A7_write_results": a7_write_results,
    "A8_read_tokens": a8_read_tokens,
    "A9_write_tokens": a9_write_tokens,
    "A10_read_vocab": a10_read_vocab,
    "A11_write_vocab": a11_write_vocab,
    "A12_read_metrics": a12_read_metrics,
    "A13_append_metrics": a13_append_metrics,
    "A14_read_checkpoints": a14_read_checkpoints,
    "B1_word_counts": b1_word_counts,
    "B2_alphabet": b2_alphabet,
    "B3_train_bpe": b3_train_bpe,
    "B3_train_bpe_full": b3_train_bpe_full,
    "B3_pair_counts": b3_pair_counts,
    "B4_seed_pieces": b4_seed_pieces,
    "B4_train_unigram": b4_train_unigram,
    "B5_train_word": b5_train_word,
    "B5_train_char": b5_train_char,
    "B6_assemble_vocab": b6_assemble_vocab,
    "B7_encode": b7_encode,
    "B7_encode_bpe": b7_encode_bpe,
    "B7_encode_bpe_full": b7_encode_bpe_full,
    "B8_decode": b8_decode,
    "B8_decode_bpe": b8_decode_bpe,
    "B8_decode_bpe_full": b8_decode_bpe_full,
    "B8_decode_unigram": b8_decode_unigram,
    "B9_encode_chat": b9_encode_chat,
    "B10_render_chat": b10_render_chat,
    "B11_lookup": b11_lookup,
    "B12_vocab_info": b12_vocab_info,
    "B13_token_stats": b13_token_stats,
    "C1_token_stream": c1_token_stream,
    "C2_check_ids": c2_check_ids,
    "C3_token_at": c3_token_at,
    "C4_token_slices": c4_token_slices,
    "C4_get_chunk": c4_get_chunk,
    "C5_split": c5_split,
    "C6_pack_disjoint": c6_pack_disjoint,
    "C7_pack_overlap": c7_pack_overlap,
    "C8_shift_targets": c8_shift_targets,
    "C9_shuffle": c9_shuffle,
    "C10_batches": c10_batches,
    "C11_get_batch": c11_get_batch,
    "C12_loaders": c12_loaders,
    "C13_dataset_stats": c13_dataset_stats,
    "C14_prepare_all": c14_prepare_all,
    "C14_prepare_parts": c14_prepare_parts,
    "C14_prepare_files": c14_prepare_files,
    "C14_prepare_chunks": c14_prepare_chunks,
    "C15_step_plan": c15_step_plan,
    "D1_cross_entropy": d1_cross_entropy,
    "D2_evaluate": d2_evaluate,
    "D3_repetition_penalty": d3_repetition_penalty,
    "D4_temperature": d4_temperature,
    "D5_top_k": d5_top_k,
    "D6_top_p": d6_top_p,
    "D7_sample": d7_sample,
    "D8_truncate_prompts": d8_truncate_prompts,
    "D9_cut_at_stop": d9_cut_at_stop,
    "D10_extract_response": d10_extract_response,
    "E1_throughput": e1_throughput,
    "E2_early_stopping": e2_early_stopping,
    "E3_best_checkpoints": e3_best_checkpoints,
    "E4_retention": e4_retention,
    "E5_step_time_report": e5_step_time_report,
    "E6_cloud_cost": e6_cloud_cost,
    "F1_stream_prepare": f1_stream_prepare,
    "F1_stream_prepare_ids": f1_stream_prepare_ids,
    "F2_stream_early_stopping": f2_stream_early_stopping,
    "F3_stream_metrics_sink": f3_stream_metrics_sink,
}
