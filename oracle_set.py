"""Oracle SQL for DuckDB: the same results from the tables alone."""

from __future__ import annotations

from query_set import BATCH, BPE_VOCAB, CHUNK, CONTEXT, EXPORT_LIMIT, NEWLINE_ID, WORD_VOCAB

WIDTH = CONTEXT + 1

# The characters that str.strip() removes.
_SPACES = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())
_UNIT = (
    r"▁?[\p{L}\p{M}]+|[0-9０-９]|▁?[^\p{L}\p{M}0-9０-９▁\n]+|▁|\n"
)


def _norm(x: str) -> str:
    return f"CASE WHEN trim({x}, ' ') = '' THEN '' ELSE '▁' || regexp_replace(trim({x}, ' '), ' +', '▁', 'g') END"


def _units(x: str) -> str:
    return f"regexp_extract_all({_norm(x)}, '{_UNIT}')"


def _byte_ids(x: str) -> str:
    return (
        f"list_transform(range(strlen({x})), "
        f"lambda i: 7 + ('0x' || substr(hex(encode({x})), 2 * i::INT + 1, 2))::INT)"
    )


_WORDS = f"""
WITH lines AS (SELECT unnest(string_split(text, chr(10))) AS line FROM documents),
kept AS (SELECT line FROM lines WHERE strlen(line) <= 16384 AND trim(line, '{_SPACES}') <> ''),
counts AS (
  SELECT word, count(*)::BIGINT AS n
  FROM (SELECT unnest({_units('line')}) AS word FROM kept) GROUP BY word
),
words AS (
  SELECT word AS piece, n, rank FROM (
    SELECT word, n, row_number() OVER (ORDER BY n DESC, word) - 1 AS rank FROM counts)
  WHERE rank < {WORD_VOCAB} - 263
),
chars AS (
  SELECT ch AS char, sum(n)::BIGINT AS n FROM (
    SELECT unnest(regexp_extract_all(word, '(?s).')) AS ch, n FROM counts) GROUP BY ch
),
alphabet AS (
  SELECT char, n, rank FROM (
    SELECT char, n,
      row_number() OVER (ORDER BY char = '▁' DESC, n DESC, char) - 1 AS rank,
      sum(n) OVER (ORDER BY char = '▁' DESC, n DESC, char ROWS UNBOUNDED PRECEDING) - n AS before,
      sum(n) OVER () AS total
    FROM chars)
  WHERE char = '▁' OR before::DOUBLE < total::DOUBLE * 0.9995::DOUBLE
),
reserved AS (
  SELECT i::INT AS id,
    CASE WHEN i < 7 THEN ['<|pad|>', '<|unk|>', '<|startoftext|>', '<|endoftext|>', '<|user|>', '<|assistant|>', '<|system|>'][i + 1]
      ELSE printf('<0x%02X>', i - 7) END AS piece,
    0.0::DOUBLE AS score,
    CASE WHEN i = 1 THEN 'unknown' WHEN i IN (0, 2, 3) THEN 'control' WHEN i < 7 THEN 'user' ELSE 'byte' END AS kind
  FROM range(263) t(i)
),
vocab AS (
  SELECT id, piece, score, kind FROM reserved
  UNION ALL SELECT (rank + 263)::INT, piece, (0 - rank)::DOUBLE, 'piece' FROM words
)"""


def _encoded(name: str, source: str, key: str, text: str, tail: str = "") -> str:
    """CTEs that encode ``text`` of ``source`` with the word vocabulary into ``name(key, ids)``."""
    return f""",
{name}_u AS (SELECT {key}, u, generate_subscripts(u, 1) AS ord, unnest(u) AS unit
  FROM (SELECT {key}, {_units(text)} AS u FROM {source})),
{name}_b AS (SELECT DISTINCT unit FROM {name}_u),
{name}_v AS (SELECT b.unit, CASE WHEN w.rank IS NULL THEN {_byte_ids('b.unit')} ELSE [(w.rank + 263)::INT] END AS piece_ids
  FROM {name}_b b LEFT JOIN words w ON w.piece = b.unit),
{name} AS (SELECT {key}, flatten(list(piece_ids ORDER BY ord)){tail} AS ids
  FROM {name}_u JOIN {name}_v USING (unit) GROUP BY {key})"""


_STREAM = (
    _WORDS
    + _encoded("enc", "documents", "doc_id", "text", " || [3]")
    + """,
stream AS (
  SELECT doc_id, ids, len(ids)::BIGINT AS n_tokens,
    (coalesce(sum(len(ids)) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS start_pos
  FROM enc
),
total AS (SELECT sum(n_tokens)::BIGINT AS n FROM stream),
toks AS (SELECT start_pos + generate_subscripts(ids, 1) - 1 AS pos, unnest(ids) AS id FROM stream)"""
)


def _packed(width: int) -> str:
    return f""",
packed AS (
  SELECT pos // {width} AS seq_idx, list(id ORDER BY pos) AS tokens
  FROM toks WHERE pos // {width} < (SELECT n // {width} FROM total) GROUP BY 1
)"""


def _csv(x: str) -> str:
    return f"array_to_string({x}, ',')"


# One merge a step: units as strings with one character per symbol, and one row with the merges so far.
_MERGES = (
    _WORDS.replace("WITH lines", "WITH RECURSIVE lines", 1)
    + f""",
known AS (SELECT string_agg(char, '') AS cs FROM alphabet WHERE unicode(char) < 983040),
cut AS (
  SELECT n, unnest(string_split(array_to_string(list_transform(regexp_extract_all(word, '(?s).'),
    lambda c: CASE WHEN contains(cs, c) THEN c ELSE chr(983040) END), ''), chr(983040))) AS s
  FROM counts, known
),
units AS (SELECT s, sum(n)::BIGINT AS n FROM cut WHERE length(s) > 1 GROUP BY s),
size AS (SELECT {BPE_VOCAB} - 263 - count(*) AS wanted FROM alphabet),
steps AS (
  SELECT 0 AS k, s, n, NULL::STRUCT(l VARCHAR, r VARCHAR)[] AS merges FROM units
  UNION ALL SELECT 0, NULL, NULL, []
  UNION ALL
  SELECT k + 1, replace(s, pair, chr((983040 + k)::INT)), n, CASE WHEN s IS NULL THEN list_append(merges, {{'l': l, 'r': r}}) END
  FROM steps, size, (
    SELECT pair, l, r FROM (
      SELECT pair, c, made, CASE WHEN x > 0 THEN made[x].l || made[x].r ELSE pair[1] END AS l,
        CASE WHEN y > 0 THEN made[y].l || made[y].r ELSE pair[2] END AS r
      FROM (
        SELECT pair, sum(n) AS c, unicode(pair[1]) - 983039 AS x, unicode(pair[2]) - 983039 AS y
        FROM (SELECT substr(s, i::INT, 2) AS pair, n
          FROM (SELECT s, n, unnest(range(1, length(s))) AS i FROM steps WHERE s IS NOT NULL))
        GROUP BY pair), (SELECT merges AS made FROM steps WHERE s IS NULL))
    WHERE length(l) + length(r) <= 16 AND NOT list_contains(list_transform(made, lambda m: m.l || m.r), l || r)
    ORDER BY c DESC, length(l || r), l || r, l LIMIT 1)
  WHERE k < wanted
),
merged AS (
  SELECT (i - 1)::BIGINT AS rank, merges[i].l AS "left", merges[i].r AS "right", merges[i].l || merges[i].r AS piece
  FROM (SELECT merges, unnest(range(1, len(merges) + 1)) AS i
    FROM (SELECT merges FROM steps WHERE s IS NULL ORDER BY k DESC LIMIT 1))
)"""
)

# Units of documents cut by joining the best neighbouring pair, the first of equals, until none is a piece.
_BPE_DOCS = (
    _MERGES
    + f""",
pieces AS (
  SELECT piece, rank, (263 + rank)::INT AS id FROM merged
  UNION ALL SELECT char, NULL, (263 + rank + (SELECT count(*) FROM merged))::INT FROM alphabet
),
placed AS (SELECT doc_id, generate_subscripts(u, 1) AS ord, unnest(u) AS unit
  FROM (SELECT doc_id, {_units('text')} AS u FROM documents)),
parted AS (
  SELECT 0 AS k, unit, regexp_extract_all(unit, '(?s).') AS syms FROM (SELECT DISTINCT unit FROM placed)
  UNION ALL
  SELECT k + 1, unit, list_slice(syms, 1, spot - 1) || [syms[spot] || syms[spot + 1]] || list_slice(syms, spot + 2, len(syms))
  FROM (
    SELECT k, unit, any_value(syms) AS syms, arg_min(i, rank * 1000000 + i) AS spot
    FROM (SELECT k, unit, syms, unnest(range(1, len(syms))) AS i FROM parted) p
      JOIN merged m ON m.piece = p.syms[p.i] || p.syms[p.i + 1]
    GROUP BY k, unit)
),
final AS (SELECT unit, arg_max(syms, k) AS syms FROM parted GROUP BY unit),
coded AS (
  SELECT unit, flatten(list(CASE WHEN id IS NULL THEN {_byte_ids('sym')} ELSE [id] END ORDER BY i)) AS ids
  FROM (SELECT unit, generate_subscripts(syms, 1) AS i, unnest(syms) AS sym FROM final) LEFT JOIN pieces ON piece = sym
  GROUP BY unit
),
enc AS (SELECT doc_id, flatten(list(ids ORDER BY ord)) || [3] AS ids FROM placed JOIN coded USING (unit) GROUP BY doc_id)"""
)

_SEQS = _STREAM + _packed(WIDTH)
_RANKED = """,
ranked AS (
  SELECT seq_idx, tokens, row_number() OVER (ORDER BY md5('{seed}:{epoch}:' || seq_idx), seq_idx) - 1 AS rank
  FROM packed
)"""

_LINES = """
WITH lines AS (
  SELECT source AS file, doc_id, generate_subscripts(ls, 1) AS line_no, unnest(ls) AS line
  FROM (SELECT source, doc_id, string_split(text, chr(10)) || [''] AS ls FROM documents)
)"""

_START = "((doc_id * 7919 * n_chars) % 2000000) - 500000"

_CAND = """
WITH cand AS (
  SELECT vec_id AS row_id, generate_subscripts(embedding, 1)::INT - 1 AS token_id, unnest(embedding)::DOUBLE AS logit
  FROM embeddings
)"""
_HISTORY = """,
seen AS (SELECT vec_id AS row_id, label AS token_id FROM embeddings UNION SELECT vec_id, (vec_id % 64)::INT FROM embeddings),
penal AS (
  SELECT c.row_id, c.token_id,
    CASE WHEN s.row_id IS NULL THEN logit WHEN logit > 0 THEN logit / 1.3::DOUBLE ELSE logit * 1.3::DOUBLE END AS logit
  FROM cand c LEFT JOIN seen s USING (row_id, token_id)
)"""


def _top_p(source: str, p: str) -> str:
    return f"""
  SELECT row_id, token_id, logit FROM (
    SELECT *, coalesce(sum(prob) OVER (PARTITION BY row_id ORDER BY logit DESC, token_id
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS mass
    FROM (SELECT *, w / sum(w) OVER (PARTITION BY row_id) AS prob
      FROM (SELECT *, exp(logit - max(logit) OVER (PARTITION BY row_id)) AS w FROM {source})))
  WHERE mass <= {p}::DOUBLE"""


_LOSS = """
WITH losses AS (
  SELECT vec_id, top + ln(total) - embedding[label + 1]::DOUBLE AS loss FROM (
    SELECT *, list_sum(list_transform(embedding, lambda x: exp(x::DOUBLE - top))) AS total
    FROM (SELECT *, list_max(embedding)::DOUBLE AS top FROM embeddings))
)"""

_STEPS = """
WITH RECURSIVE steps AS (
  SELECT user_id AS run, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS step,
    100 + event_id % 50 AS tokens, round(value * 100) AS seconds, value AS val_loss
  FROM events
)"""

_STOPPING = (
    _STEPS
    + """,
walk AS (
  SELECT run, step, val_loss AS best, step AS best_step, 1 AS n_accepted, 0 AS counter, false AS stopped
  FROM steps WHERE step = 0
  UNION ALL
  SELECT s.run, s.step,
    CASE WHEN s.val_loss < w.best - 0.5::DOUBLE THEN s.val_loss ELSE w.best END,
    CASE WHEN s.val_loss < w.best - 0.5::DOUBLE THEN s.step ELSE w.best_step END,
    CASE WHEN s.val_loss < w.best - 0.5::DOUBLE THEN w.n_accepted + 1 ELSE w.n_accepted END,
    CASE WHEN s.val_loss < w.best - 0.5::DOUBLE THEN 0 ELSE w.counter + 1 END,
    NOT (s.val_loss < w.best - 0.5::DOUBLE) AND w.counter + 1 >= 20
  FROM walk w JOIN steps s ON s.run = w.run AND s.step = w.step + 1
  WHERE NOT w.stopped
)
SELECT run, max_by(best_step, step)::BIGINT AS best_step, max_by(best, step) AS best_loss,
  max(n_accepted)::BIGINT AS n_accepted, max(CASE WHEN stopped THEN step END)::BIGINT AS stop_step
FROM walk GROUP BY run"""
)

_BEST = (
    _STEPS
    + """,
flagged AS (
  SELECT run, step, val_loss, coalesce(val_loss < min(val_loss) OVER (PARTITION BY run ORDER BY step
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS is_best FROM steps
)"""
)

_REPORT = (
    _STEPS
    + """,
report AS (
  SELECT run, avg(seconds) AS avg_step_time, min(seconds) AS min_step_time, max(seconds) AS max_step_time,
    8192 / avg(seconds) AS avg_tokens_per_sec, (100000 * 8192)::BIGINT AS total_tokens,
    avg(seconds) * 100000 AS est_seconds, avg(seconds) * 100000 / 3600 AS est_hours,
    avg(seconds) * 100000 / 3600 / 24 AS est_days
  FROM steps WHERE step >= 3 GROUP BY run
)"""
)

_LOGGED = """
WITH logged AS (
  SELECT user_id::VARCHAR AS run, event_id AS step, ts AS timestamp,
    CASE WHEN event_type <> 'error' THEN value / 7 END AS train_loss,
    CASE WHEN event_type = 'error' THEN value / 3 END AS val_loss,
    CASE WHEN event_type <> 'error' THEN value * 1e-6 END AS learning_rate,
    CASE WHEN event_type <> 'error' THEN value * 11.3::DOUBLE END AS tokens_per_sec,
    CASE WHEN event_type = 'click' THEN value / 13 END AS grad_norm
  FROM events
),
written AS (
  SELECT run, step::VARCHAR AS step, strftime(timestamp, '%Y-%m-%dT%H:%M:%S.%f') AS timestamp,
    coalesce(format('{:.6f}', train_loss), '') AS train_loss, coalesce(format('{:.6f}', val_loss), '') AS val_loss,
    coalesce(format('{:.2e}', learning_rate), '') AS learning_rate,
    coalesce(format('{:.1f}', tokens_per_sec), '') AS tokens_per_sec, coalesce(format('{:.4f}', grad_norm), '') AS grad_norm
  FROM logged
)"""
_READ_LOG = (
    _LOGGED
    + """
SELECT w.run, w.step::BIGINT AS step, l.timestamp, nullif(w.train_loss, '')::DOUBLE AS train_loss,
  nullif(w.val_loss, '')::DOUBLE AS val_loss, nullif(w.learning_rate, '')::DOUBLE AS learning_rate,
  nullif(w.tokens_per_sec, '')::DOUBLE AS tokens_per_sec, nullif(w.grad_norm, '')::DOUBLE AS grad_norm
FROM written w JOIN logged l ON l.step = w.step::BIGINT"""
)

# A document read back from a text file ends with a newline, which encodes as one more byte.
_FILE_DOCS = _WORDS + _encoded("enc", "(SELECT *, text || chr(10) AS body FROM documents)", "doc_id", "body", " || [3]")



def _cut_stream(order: str, ratio: str) -> str:
    """CTEs that place the documents of ``enc`` one behind the other and cut the validation part off."""
    return f""",
placed AS (SELECT row_number() OVER (ORDER BY {order}) - 1 AS doc_id, ids FROM documents JOIN enc USING (doc_id)),
stream AS (
  SELECT doc_id, ids, len(ids)::BIGINT AS n_tokens,
    (coalesce(sum(len(ids)) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS start_pos
  FROM placed
),
total AS (SELECT sum(n_tokens)::BIGINT AS n FROM stream),
cut AS (SELECT n - trunc(n * {ratio}::DOUBLE)::BIGINT AS train FROM total),
parts AS (
  SELECT 'train' AS split, doc_id, start_pos, ids[1:greatest(least(train - start_pos, n_tokens), 0)] AS ids FROM stream, cut
  UNION ALL
  SELECT 'val', doc_id, greatest(start_pos - train, 0), ids[greatest(train - start_pos, 0) + 1:] FROM stream, cut
)"""


_FILE_STREAM = _FILE_DOCS + _cut_stream("source || '/', doc_id", "0.05")
_FLAT_STREAM = (
    _WORDS
    + _encoded("enc", "(SELECT *, replace(text, chr(10), ' ') AS body FROM documents)", "doc_id", "body")
    + _cut_stream("doc_id", "0.01")
)
_FILE_TOKENS = "\nSELECT split, start_pos + generate_subscripts(ids, 1) - 1 AS pos, unnest(ids) AS token_id FROM parts WHERE len(ids) > 0"

# Encoding drops spaces at the ends and counts a run of them as one; decoding gives that text back.
_DECODED = "SELECT doc_id, regexp_replace(trim(text, ' '), ' +', ' ', 'g') AS text FROM documents"


def _batch_rows(source: str, count: str) -> str:
    return f"""SELECT rank // {BATCH} AS batch_no, (rank % {BATCH})::INT AS slot, seq_idx, tokens
  FROM {source} WHERE rank // {BATCH} < ({count}) // {BATCH}"""


def _shifted(x: str = "tokens") -> str:
    return f"{_csv(f'{x}[1:{CONTEXT}]')} AS input_ids, {_csv(f'{x}[2:{WIDTH}]')} AS target_ids"


ORACLES: dict[str, str] = {
    "A1_scan_corpus": _LINES
    + f"""
SELECT file AS source, count(*)::BIGINT AS n_lines,
  count(*) FILTER (trim(line, '{_SPACES}') = '')::BIGINT AS n_blank, sum(length(line))::BIGINT AS n_chars
FROM lines GROUP BY file""",
    "A2_documents": _LINES
    + f""",
marked AS (
  SELECT *, trim(line, '{_SPACES}') = '' AS blank,
    sum((trim(line, '{_SPACES}') = '')::INT) OVER (PARTITION BY file ORDER BY doc_id, line_no ROWS UNBOUNDED PRECEDING) AS island
  FROM lines
),
runs AS (
  SELECT file, island, string_agg(line, chr(10) ORDER BY doc_id, line_no) || chr(10) AS text
  FROM marked WHERE NOT blank GROUP BY file, island
)
SELECT file, row_number() OVER (PARTITION BY file ORDER BY island) - 1 AS doc_no, text FROM runs""",
    "A3_training_lines": _LINES
    + f"""
SELECT file, trim(line, '{_SPACES}') AS line FROM lines WHERE trim(line, '{_SPACES}') <> ''""",
    "A4_line_chunks": _LINES
    + f""",
numbered AS (SELECT *, row_number() OVER (PARTITION BY file ORDER BY doc_id, line_no) - 1 AS ord FROM lines)
SELECT file, ord // {CHUNK} AS chunk_no, string_agg(line, chr(10) ORDER BY ord) || chr(10) AS text, count(*)::BIGINT AS n_lines
FROM numbered GROUP BY 1, 2""",
    "A5_export_corpus": "SELECT text FROM documents",
    "A5_export_limit": f"SELECT text FROM documents ORDER BY doc_id LIMIT {EXPORT_LIMIT}",
    "A6_scan_prompts": f"""
SELECT prompt FROM (SELECT trim(unnest(string_split(text, chr(10))), '{_SPACES}') AS prompt FROM benchmark) WHERE prompt <> ''""",
    "A7_write_results": "SELECT text AS result FROM benchmark",
    "A8_read_tokens": _STREAM
    + "\nSELECT count(*)::BIGINT AS n_tokens, sum((pos % 10007) * id)::BIGINT AS checksum FROM toks",
    "A9_write_tokens": _STREAM + _packed(1024) + f"\nSELECT seq_idx, {_csv('tokens')} AS tokens FROM packed",
    "A10_read_vocab": _WORDS + "\nSELECT id, piece, score, kind FROM vocab",
    "A11_write_vocab": _WORDS + """
SELECT piece || chr(9) || CASE WHEN kind = 'piece' AND score = 0 THEN '-0' ELSE score::BIGINT::VARCHAR END AS row FROM vocab""",
    "A12_read_metrics": _READ_LOG,
    "A13_append_metrics": _LOGGED + "\nSELECT * FROM written",
    "A14_read_checkpoints": """
WITH saves AS (
  SELECT user_id, count(*) AS step, round(avg(value), 6) AS val_loss, (user_id % 8 + 1) * 64 AS w,
    user_id * 100 + 1000 AS v, user_id % 12 + 1 AS l FROM events GROUP BY user_id)
SELECT user_id::VARCHAR AS run, step::BIGINT AS step, val_loss, w AS embedding_dim,
  v * w + l * (4 * w * w + 3 * w * 4 * w + 2 * w) + w AS estimated_params,
  v * w + l * (4 * w * w + 3 * w * 4 * w) AS estimated_params_no_norms
FROM saves""",
    "B1_word_counts": _WORDS + "\nSELECT word, n FROM counts",
    "B2_alphabet": _WORDS + "\nSELECT char, n, rank FROM alphabet",
    "B3_pair_counts": _WORDS
    + """,
spread AS (SELECT n, cs, unnest(range(1, len(cs))) AS i FROM (SELECT n, regexp_extract_all(word, '(?s).') AS cs FROM counts)),
pairs AS (SELECT cs[i] AS l, cs[i + 1] AS r, n FROM spread)
SELECT l || r AS pair, sum(n)::BIGINT AS c FROM pairs
WHERE l IN (SELECT char FROM alphabet) AND r IN (SELECT char FROM alphabet) GROUP BY 1""",
    "B3_train_bpe": _MERGES + '\nSELECT rank, "left", "right", piece FROM merged',
    "B7_encode_bpe": _BPE_DOCS + f"\nSELECT doc_id, {_csv('ids')} AS ids FROM enc",
    "B4_seed_pieces": _WORDS
    + """,
starts AS (SELECT word, n, unnest(range(1, length(word))) AS i FROM counts WHERE length(word) > 1),
spans AS (SELECT word, n, i, unnest(range(2, least(16, length(word) - i + 1) + 1)) AS size FROM starts)
SELECT substr(word, i::INT, size::INT) AS piece, sum(n)::BIGINT AS n FROM spans GROUP BY 1 HAVING sum(n) >= 2""",
    "B5_train_word": _WORDS + "\nSELECT piece, n, rank FROM words",
    "B5_train_char": _WORDS
    + f"""
SELECT char AS piece, n, rank FROM (SELECT char, n, row_number() OVER (ORDER BY n DESC, char) - 1 AS rank FROM chars)
WHERE rank < {WORD_VOCAB} - 263""",
    "B6_assemble_vocab": _WORDS
    + f""",
laid AS (
  SELECT piece, row_number() OVER (ORDER BY part, rank) - 1 AS ord FROM (
    SELECT piece, 0 AS part, rank FROM (
      SELECT piece, row_number() OVER (ORDER BY rank) - 1 AS rank FROM words
      WHERE piece NOT IN (SELECT char FROM alphabet))
    WHERE rank < {WORD_VOCAB} - 263 - (SELECT count(*) FROM alphabet)
    UNION ALL SELECT char, 1, rank FROM alphabet)
)
SELECT id, piece, score, kind FROM reserved
UNION ALL SELECT (ord + 263)::INT, piece, (0 - ord)::DOUBLE, 'piece' FROM laid WHERE ord < {WORD_VOCAB} - 263""",
    "B7_encode": _WORDS
    + _encoded("enc", "documents", "doc_id", "text", " || [3]")
    + f"\nSELECT doc_id, {_csv('[2] || ids')} AS ids FROM enc",
    "B8_decode": _DECODED,
    "B8_decode_bpe": _DECODED,
    "B8_decode_bpe_full": _DECODED,
    "B8_decode_unigram": _DECODED,
    "B9_encode_chat": _WORDS
    + _encoded("enc", "(SELECT *, conv_id * 100000 + turn AS k FROM conversations)", "k", "text")
    + f"""
SELECT conv_id, {_csv("[2] || flatten(list(CASE role WHEN 'user' THEN [4] WHEN 'assistant' THEN [5] WHEN 'system' THEN [6] ELSE [] END || coalesce(ids, []) ORDER BY turn)) || [5]")} AS ids
FROM conversations LEFT JOIN enc ON k = conv_id * 100000 + turn GROUP BY conv_id""",
    "B10_render_chat": """
SELECT conv_id, string_agg('<|' || coalesce(role, 'user') || '|>' || chr(10) || coalesce(text, '') || chr(10), '' ORDER BY turn)
  || '<|assistant|>' || chr(10) AS prompt
FROM conversations GROUP BY conv_id""",
    "B11_lookup": _WORDS
    + """
SELECT c.word, coalesce(v.id, 1) AS id, coalesce(v.piece, '<|unk|>') AS piece
FROM counts c LEFT JOIN vocab v ON v.piece = c.word""",
    "B12_vocab_info": _WORDS
    + """
SELECT count(*)::BIGINT AS vocab_size, 0 AS pad_id, 1 AS unk_id, 2 AS bos_id, 3 AS eos_id, 4 AS user_id,
  5 AS assistant_id, 6 AS system_id FROM vocab""",
    "B13_token_stats": _WORDS
    + _encoded("enc", "documents", "doc_id", "text")
    + """
SELECT d.source AS file, sum(len(ids))::BIGINT AS n_tokens, sum(length(d.text))::BIGINT AS n_chars,
  round(sum(length(d.text)) / sum(len(ids)), 6) AS chars_per_token
FROM documents d JOIN enc USING (doc_id) GROUP BY ROLLUP (d.source)""",
    "C1_token_stream": _STREAM + f"\nSELECT doc_id, start_pos, n_tokens, {_csv('ids')} AS ids FROM stream",
    "C2_check_ids": _STREAM
    + """
SELECT doc_id, len(list_filter(ids, lambda i: i < 0 OR i > 65535))::BIGINT AS not_uint16,
  len(list_filter(ids, lambda i: i >= 5000))::BIGINT AS not_in_vocab
FROM stream WHERE len(list_filter(ids, lambda i: i >= 5000)) > 0""",
    "C3_token_at": _STREAM
    + """,
asked AS (
  SELECT doc_id AS request_id, ((doc_id * 7919 * n_chars) % 3000000) - 1000000 AS pos FROM documents
),
placed AS (SELECT *, CASE WHEN pos < 0 THEN pos + (SELECT n FROM total) ELSE pos END AS lo FROM asked)
SELECT request_id, p.pos, CASE WHEN t.id IS NULL THEN 'out of range' END AS error, t.id AS token_id
FROM placed p LEFT JOIN toks t ON t.pos = p.lo""",
    "C4_token_slices": _STREAM
    + f""",
raw AS (SELECT doc_id AS request_id, {_START} AS s, doc_id % 5 AS k, 50 + n_chars % 300 AS l, (SELECT n FROM total) AS n FROM documents),
asked AS (
  SELECT request_id, n,
    CASE k WHEN 3 THEN s + l WHEN 4 THEN NULL ELSE s END AS b,
    CASE k WHEN 3 THEN s WHEN 4 THEN l ELSE s + l END AS e,
    CASE k WHEN 2 THEN 3 WHEN 3 THEN -2 ELSE 1 END AS st FROM raw
),
placed AS (
  SELECT request_id, st,
    CASE WHEN st > 0 THEN least(greatest(CASE WHEN coalesce(b, 0) < 0 THEN b + n ELSE coalesce(b, 0) END, 0), n)
      ELSE least(greatest(CASE WHEN b < 0 THEN b + n ELSE b END, -1), n - 1) END AS b,
    CASE WHEN st > 0 THEN least(greatest(CASE WHEN e < 0 THEN e + n ELSE e END, 0), n)
      ELSE least(greatest(CASE WHEN e < 0 THEN e + n ELSE e END, -1), n - 1) END AS e
  FROM asked
),
places AS (SELECT request_id, st, unnest(range(b, e, st)) AS pos FROM placed),
hits AS (SELECT request_id, list(id ORDER BY pos * sign(st)) AS ids FROM places JOIN toks USING (pos) GROUP BY request_id)
SELECT request_id, coalesce({_csv('ids')}, '') AS ids FROM placed LEFT JOIN hits USING (request_id)""",
    "C4_get_chunk": _STREAM
    + f""",
asked AS (SELECT doc_id AS request_id, {_START} AS s, 50 + n_chars % 300 AS l FROM documents),
checked AS (SELECT *, s >= 0 AND s + l <= (SELECT n FROM total) AS ok FROM asked),
places AS (SELECT request_id, unnest(range(s, s + l)) AS pos FROM checked WHERE ok),
hits AS (SELECT request_id, list(id ORDER BY pos) AS ids FROM places JOIN toks USING (pos) GROUP BY 1)
SELECT request_id, {_csv('ids')} AS ids, CASE WHEN NOT ok THEN 'out of range' END AS error FROM checked LEFT JOIN hits USING (request_id)""",
    "C5_split": _STREAM
    + f""",
cut AS (SELECT n - trunc(n * 0.05::DOUBLE)::BIGINT AS train FROM total),
parts AS (
  SELECT 'train' AS split, doc_id, start_pos, ids[1:greatest(least(train - start_pos, n_tokens), 0)] AS ids FROM stream, cut
  UNION ALL
  SELECT 'val', doc_id, greatest(start_pos - train, 0), ids[greatest(train - start_pos, 0) + 1:] FROM stream, cut
)
SELECT split, doc_id, start_pos, len(ids)::BIGINT AS n_tokens, {_csv('ids')} AS ids FROM parts WHERE len(ids) > 0""",
    "C6_pack_disjoint": _SEQS + f"\nSELECT seq_idx, {_csv('tokens')} AS tokens FROM packed",
    "C7_pack_overlap": _STREAM
    + f""",
twice AS (
  SELECT pos // {CONTEXT} AS seq_idx, pos, id FROM toks
  UNION ALL SELECT pos // {CONTEXT} - 1, pos, id FROM toks WHERE pos % {CONTEXT} = 0 AND pos > 0
)
SELECT seq_idx, {_csv('list(id ORDER BY pos)')} AS tokens FROM twice
WHERE seq_idx < (SELECT (n - 1) // {CONTEXT} FROM total) GROUP BY seq_idx""",
    "C8_shift_targets": _SEQS + f"\nSELECT seq_idx, {_shifted()} FROM packed",
    "C9_shuffle": _SEQS
    + _RANKED.format(seed=42, epoch=1)
    + f"\nSELECT rank, seq_idx, {_csv('tokens')} AS tokens FROM ranked",
    "C10_batches": _SEQS
    + _RANKED.format(seed=42, epoch=0)
    + f"""
SELECT batch_no, slot, seq_idx, {_csv('tokens')} AS tokens FROM ({_batch_rows('ranked', 'SELECT count(*) FROM packed')})""",
    "C11_get_batch": _SEQS
    + f"""
SELECT (seq_idx - {3 * BATCH})::INT AS slot, seq_idx, {_shifted()} FROM packed
WHERE seq_idx >= {3 * BATCH} AND seq_idx < {4 * BATCH}""",
    "C12_loaders": _STREAM
    + f""",
cut AS (SELECT n - trunc(n * 0.05::DOUBLE)::BIGINT AS train, trunc(n * 0.05::DOUBLE)::BIGINT AS val FROM total),
train AS (SELECT pos // {WIDTH} AS seq_idx, list(id ORDER BY pos) AS tokens FROM toks, cut
  WHERE pos < train AND pos // {WIDTH} < train // {WIDTH} GROUP BY 1),
val AS (SELECT (pos - train) // {WIDTH} AS seq_idx, list(id ORDER BY pos) AS tokens FROM toks, cut
  WHERE pos >= train AND (pos - train) // {WIDTH} < val // {WIDTH} GROUP BY 1),
ranked AS (SELECT *, row_number() OVER (ORDER BY md5('42:0:' || seq_idx), seq_idx) - 1 AS rank FROM train),
ordered AS (SELECT *, seq_idx AS rank FROM val)
SELECT 'train' AS split, batch_no, slot, seq_idx, {_shifted()} FROM ({_batch_rows('ranked', 'SELECT count(*) FROM train')})
UNION ALL
SELECT 'val', batch_no, slot, seq_idx, {_shifted()} FROM ({_batch_rows('ordered', 'SELECT count(*) FROM val')})""",
    "C13_dataset_stats": _STREAM
    + f""",
s AS (SELECT n, n // {WIDTH} AS q FROM total)
SELECT n AS total_tokens, q AS num_sequences, round((16 + 2 * n) / 1048576, 9) AS file_size_mb,
  round(1 / q, 9) AS epochs_per_step_1, round(4 / q, 9) AS epochs_per_step_4, round(8 / q, 9) AS epochs_per_step_8 FROM s""",
    "C14_prepare_all": _FILE_DOCS
    + f""",
total AS (SELECT sum(len(ids))::BIGINT AS n FROM enc),
cut AS (SELECT 'val' AS split, trunc(n * 0.05::DOUBLE)::BIGINT AS t FROM total
  UNION ALL SELECT 'train', n - trunc(n * 0.05::DOUBLE)::BIGINT FROM total)
SELECT split, t AS total_tokens, t // {WIDTH} AS num_sequences, round((16 + 2 * t) / 1048576, 9) AS file_size_mb FROM cut""",
    "C14_prepare_parts": _FILE_STREAM
    + f"""
SELECT split, doc_id, start_pos, len(ids)::BIGINT AS n_tokens, {_csv('ids')} AS ids FROM parts WHERE len(ids) > 0""",
    "C14_prepare_files": _FILE_STREAM + _FILE_TOKENS,
    "C14_prepare_chunks": _FLAT_STREAM + _FILE_TOKENS,
    "C15_step_plan": _STREAM
    + f""",
size AS (SELECT n // {WIDTH} AS seqs, n // {WIDTH} // {BATCH} AS nb FROM total),
draws AS (SELECT i AS draw, i // 2 AS step, (i % 2)::INT AS micro_step, i // nb AS epoch, i % nb AS batch_no, nb
  FROM size, range((SELECT 2 * nb FROM size)) t(i)),
firsts AS (SELECT rank // {BATCH} AS batch_no, s AS first_seq
  FROM (SELECT s, row_number() OVER (ORDER BY md5('42:0:' || s), s) - 1 AS rank FROM range((SELECT seqs FROM size)) t(s))
  WHERE rank % {BATCH} = 0)
SELECT step, micro_step, epoch, d.batch_no,
  round(CASE WHEN step < 20 THEN 3e-4 * step / 20 WHEN step >= nb THEN 3e-5
    ELSE 3e-5 + 0.5 * (3e-4 - 3e-5) * (1 + cos(pi() * (step - 20) / greatest(nb - 20, 1))) END, 12) AS learning_rate,
  (draw + 1) * {BATCH * CONTEXT} AS tokens_seen, first_seq
FROM draws d JOIN firsts f ON f.batch_no = d.batch_no""",
    "D1_cross_entropy": _LOSS + "\nSELECT round(avg(loss), 6) AS loss, count(*)::BIGINT AS n FROM losses",
    "D2_evaluate": _LOSS
    + f"""
SELECT round(avg(loss), 6) AS val_loss, count(*)::BIGINT AS n_batches FROM (
  SELECT vec_id // {BATCH} AS b, avg(loss) AS loss FROM losses GROUP BY 1 ORDER BY 1 LIMIT 25)""",
    "D3_repetition_penalty": _CAND + _HISTORY + "\nSELECT row_id, token_id, round(logit, 6) AS logit FROM penal",
    "D4_temperature": _CAND
    + """
SELECT row_id, token_id, round(logit / 0.8::DOUBLE, 6) AS logit, 'warm' AS mode FROM cand
UNION ALL
SELECT row_id, token_id, round(logit, 6), 'greedy' FROM (
  SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY logit DESC, token_id) AS r FROM cand) WHERE r = 1""",
    "D5_top_k": _CAND
    + """
SELECT row_id, token_id, round(logit, 6) AS logit FROM (
  SELECT *, rank() OVER (PARTITION BY row_id ORDER BY logit DESC) AS r FROM cand) WHERE r <= 10""",
    "D6_top_p": _CAND + f"\nSELECT row_id, token_id, round(logit, 6) AS logit FROM ({_top_p('cand', '0.6')})",
    "D7_sample": _CAND
    + _HISTORY
    + f""",
warm AS (SELECT row_id, token_id, logit / 0.8::DOUBLE AS logit FROM penal),
topk AS (SELECT row_id, token_id, logit FROM (
  SELECT *, rank() OVER (PARTITION BY row_id ORDER BY logit DESC) AS r FROM warm) WHERE r <= 20),
topp AS ({_top_p('topk', '0.9')}),
noisy AS (SELECT row_id, token_id,
  logit - ln(-ln((('0x' || substr(md5('7:' || row_id || ':' || token_id), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496::DOUBLE)) AS g FROM topp)
SELECT row_id, token_id FROM (
  SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY g DESC, token_id DESC) AS r FROM noisy) WHERE r = 1""",
    "D8_truncate_prompts": _STREAM
    + f"""
SELECT doc_id, {_csv('CASE WHEN n_tokens > 256 THEN ids[n_tokens - 255:] ELSE ids END')} AS ids, n_tokens > 256 AS truncated FROM stream""",
    "D9_cut_at_stop": _STREAM
    + f"""
SELECT doc_id, {_csv(f"ids[1:coalesce(least(nullif(list_position(ids, 3), 0), nullif(list_position(ids, {NEWLINE_ID}), 0)), n_tokens + 1) - 1]")} AS ids FROM stream""",
    "D10_extract_response": "SELECT conv_id, turn, text AS response FROM conversations",
    "E1_throughput": _STEPS
    + """
SELECT run, (step // 10 + 1) * 10 AS step, sum(tokens)::BIGINT AS tokens, sum(seconds) AS seconds,
  sum(tokens)::DOUBLE / greatest(sum(seconds), 1e-6::DOUBLE) AS tokens_per_sec
FROM steps GROUP BY run, step // 10 HAVING count(*) = 10""",
    "E2_early_stopping": _STOPPING,
    "E3_best_checkpoints": _BEST + "\nSELECT run, step, val_loss, is_best FROM flagged",
    "E4_retention": _BEST
    + """,
aged AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY step DESC) AS age,
  max(CASE WHEN is_best THEN step END) OVER (PARTITION BY run) AS best FROM flagged)
SELECT run, step, val_loss, is_best, age <= 3 OR step = best AS kept, NOT (age <= 3 OR step = best) AS removed FROM aged""",
    "E5_step_time_report": _REPORT + "\nSELECT * FROM report",
    "E6_cloud_cost": _REPORT
    + """,
offers(offer, speedup, price) AS (VALUES ('RTX 4090 (Vast.ai)', 15::DOUBLE, 0.40::DOUBLE),
  ('A100 40GB (Lambda)', 25::DOUBLE, 1.10::DOUBLE), ('A100 80GB (RunPod)', 35::DOUBLE, 1.60::DOUBLE), ('H100 (GCP)', 50::DOUBLE, 3.50::DOUBLE))
SELECT run, est_hours, offer, speedup, price, est_hours / speedup AS cloud_hours,
  est_hours / speedup * price AS cloud_cost FROM report CROSS JOIN offers""",
    "F1_stream_prepare": _FILE_DOCS
    + """
SELECT source, count(*)::BIGINT AS n_docs, sum(len(ids))::BIGINT AS n_tokens, sum(list_sum(ids))::BIGINT AS id_sum
FROM documents JOIN enc USING (doc_id) GROUP BY source""",
    "F1_stream_prepare_ids": _FILE_DOCS + f"\nSELECT source, {_csv('ids')} AS ids FROM documents JOIN enc USING (doc_id)",
    "F2_stream_early_stopping": _STOPPING,
    "F3_stream_metrics_sink": _READ_LOG,
}
