"""One query per operator over its whole table, and DuckDB SQL where SQL can express the result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from maskloom.llm import quality

    return quality.digest(_docs(spark, sf_dir), _labels(spark, sf_dir))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from maskloom.llm import decontamination

    return decontamination.digest(_docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from maskloom.llm import language

    return language.digest(_docs(spark, sf_dir))


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from maskloom.llm import near_dedup

    return near_dedup.digest(_docs(spark, sf_dir))


def op5_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    from maskloom.llm import language_model

    return language_model.digest(_docs(spark, sf_dir))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from maskloom.llm import toxicity

    return toxicity.digest(_docs(spark, sf_dir), _labels(spark, sf_dir))


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from maskloom.llm import secrets

    return secrets.digest(_docs(spark, sf_dir))


def op8_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from maskloom.llm import neighbours

    return neighbours.digest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from maskloom.llm import packing
    from maskloom.llm.token_ids import tokenizer_path

    return packing.digest(packing.pack(_docs(spark, sf_dir), tokenizer_path("byte_bpe_50k.json"), keep_ids=False))


def op10_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    from maskloom.llm import token_store
    from maskloom.llm.shared import new_path
    from maskloom.llm.token_ids import tokenizer_path

    docs = _docs(spark, sf_dir)
    path = token_store.write_store(docs, new_path(spark, "token-store"), tokenizer_path("word_bpe_49k.json"))
    return token_store.checksums(spark, path, token_store.stored_keys(docs)).select("doc_id", "start", "n_tokens", "ids_crc32")


def op11_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from maskloom.llm import chat

    return chat.digest(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from maskloom.llm import hard_negatives

    return hard_negatives.digest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    from maskloom.llm import spelling

    return spelling.digest(_docs(spark, sf_dir))


QUERIES = {
    f.__name__: f
    for f in (
        op1_quality, op2_decontamination, op3_language, op4_near_dedup, op5_language_model, op6_toxicity, op7_secrets, op8_neighbours, op9_packing, op10_token_store,
        op11_chat_format, op12_hard_negatives, op13_spelling_variants,
    )
}


def _secrets_sql() -> str:
    """DuckDB SQL of the secret scan: matches and their places from the texts between them; entropy of each window on its own."""
    from maskloom.llm import secrets as s

    quoted = lambda p: "'" + p.replace("'", "''") + "'"

    def spans(name: str, kind: str, pattern: str, more: str = "") -> str:
        p = quoted(pattern.replace(r"\x20", " "))
        return f"""{name} AS (
  SELECT doc_id, i, f[i] AS s, list_sum(list_transform(g[1:i], lambda x: length(x)))::BIGINT + coalesce(list_sum(list_transform(f[1:i-1], lambda x: length(x))), 0)::BIGINT AS a, '{kind}' AS kind{more}
  FROM (SELECT doc_id, f, g, unnest(range(1, len(f) + 1)) AS i FROM (SELECT doc_id, regexp_extract_all(t, {p}) AS f, string_split_regex(t, {p}) AS g FROM d)))"""

    allowed = " OR ".join(f"regexp_matches(s, {quoted(p)})" for p in s.ALLOWED)
    rank = "CASE kind " + " ".join(f"WHEN '{k}' THEN {i}" for i, k in enumerate(s.KINDS)) + " END"
    bound = "CASE kind " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in s.BOUNDS.items()) + " END"
    w = s.WINDOW
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
{spans("assigned", "assign", s.ASSIGN)},
{spans("access", "access", s.ACCESS)},
{spans("hexed", "hex", s.HEX)},
base AS (
  SELECT doc_id, a, a + length(s) AS b, kind FROM assigned WHERE length(regexp_extract(s, {quoted(s.ASSIGN.replace(chr(92) + "x20", " "))}, 2)) >= 8
  UNION ALL SELECT doc_id, a, a + length(s), kind FROM access UNION ALL SELECT doc_id, a, a + length(s), kind FROM hexed),
{spans("raw", "candidate", s.CANDIDATE)},
candidates AS (
  SELECT doc_id, i, s, a, CASE WHEN regexp_matches(s, '^([0-9a-f]+|[0-9A-F]+)$') THEN 'entropy_hex' WHEN regexp_matches(s, '^([0-9a-z]+|[0-9A-Z]+)$') THEN 'entropy_alnum' ELSE 'entropy_mixed' END AS kind
  FROM raw WHERE regexp_matches(s, '[0-9]') AND regexp_matches(s, '[A-Za-z]') AND NOT ({allowed})),
windows AS (
  SELECT doc_id, i, a, kind, k, list_aggregate(string_split(s[k + 1 : k + {w}], ''), 'entropy') AS h
  FROM (SELECT *, unnest(range(0, length(s) - {w} + 1)) AS k FROM candidates)),
hot AS (SELECT doc_id, i, a + min(k) AS a, a + max(k) + {w} AS b, kind FROM windows WHERE round({w} * h - {w} * {bound}, 6) >= 0 GROUP BY doc_id, i, a, kind),
added AS (SELECT * FROM hot h WHERE NOT EXISTS (SELECT 1 FROM base x WHERE x.doc_id = h.doc_id AND x.a < h.b AND h.a < x.b)),
told AS (
  SELECT doc_id, a, {rank} AS r, kind || ':' || a || ':' || b AS said, true AS own FROM base
  UNION ALL SELECT doc_id, a, {rank}, kind || ':' || a || ':' || b, false FROM added),
per AS (
  SELECT doc_id, count(*) FILTER (own AND r = 0) AS n_assign, count(*) FILTER (own AND r = 1) AS n_access, count(*) FILTER (own AND r = 2) AS n_hex,
    coalesce(string_agg(said, ',' ORDER BY a, r) FILTER (own), '') AS base, string_agg(said, ',' ORDER BY a, r) AS spans FROM told GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN per USING (doc_id)"""


def _chat_sql() -> str:
    """Turns in order, digests of whole and of learnt texts, and the formatted length: marks, and one escape for each control string."""
    from maskloom.llm import chat

    t = chat.Template()
    pattern = t.patterns()[0].replace("'", "''")
    longer = lambda x: f"length(regexp_replace({x}, '{pattern}', '\\1\\2x\\3', 'g'))"
    order = "ORDER BY turn NULLS FIRST, r, x"
    return f"""WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS x FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '{chat.HOSTILE}'), (-7, 1, 'assistant', '{chat.HOSTILE}'))
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(r || chr(10) || x || chr(10), '' {order})) AS turns_sha256,
  coalesce(sum(length(x)) FILTER (r = 'assistant'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(x, '' {order}) FILTER (r = 'assistant'), '')) AS loss_sha256,
  sum({len(t.start) + len(t.middle) + len(t.end)} + {longer("r")} + {longer("x")})::BIGINT AS formatted_chars
FROM c GROUP BY conv_id"""


def _hard_negatives_sql() -> str:
    """All anchors against all rows, with positives and windows by rank."""
    return """WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS c
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, n.vec_id AS other, a.label = n.label AS same, list_inner_product(a.c, n.c)::BIGINT AS score
  FROM v AS a JOIN v AS n ON n.vec_id <> a.vec_id AND len(a.c) = len(n.c) WHERE a.vec_id % 50 = 0),
p AS (
  SELECT anchor_id, other AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5)
SELECT p.anchor_id, p.positive_id, row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.other)::INTEGER AS rank,
  s.other AS negative_id, p.positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 100 * s.score BETWEEN 50 * p.positive_score AND 95 * p.positive_score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.other) <= 3"""


def _spelling_sql() -> str:
    """The hash by its definition, bit by bit over the bytes; near words by the places where a code point is left out; roots step by step."""
    from maskloom.llm import spelling as s

    return f"""WITH RECURSIVE runs AS (
  SELECT id, r, count(*) AS k FROM (SELECT coalesce(doc_id::VARCHAR, '') AS id, translate(unnest(regexp_extract_all(text, '[{s.LETTERS}]{{6,}}')), '{s._UPPER}', '{s._LOWER}') AS r FROM documents) GROUP BY 1, 2),
points AS (SELECT r, k, list_transform(string_split(id || ':' || r, ''), lambda ch: unicode(ch)::BIGINT) AS p FROM runs),
bytes AS (SELECT r, k, flatten(list_transform(p, lambda c: CASE WHEN c < 128 THEN [c] ELSE [192 | (c >> 6), 128 | (c & 63)] END)) AS b FROM points),
steps AS (SELECT r, k, [4294967295::BIGINT] || flatten(list_transform(b, lambda x: [x, -1, -1, -1, -1, -1, -1, -1, -1])) AS t FROM bytes),
hashed AS (SELECT r, k, xor(list_reduce(t, lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, 3988292384 * (c & 1)) END), 4294967295) AS h FROM steps),
words AS (
  SELECT word, sum(k)::BIGINT AS n FROM (SELECT CASE WHEN h % 199 = 0 THEN substr(r, 1, h % length(r)) || substr(r, h % length(r) + 2) ELSE r END AS word, k FROM hashed)
  WHERE length(word) >= 6 GROUP BY 1 HAVING sum(k) >= 5),
places AS MATERIALIZED (SELECT word, n, i, substr(word, 1, i - 1) AS head, substr(word, i + 1) AS tail FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
shorter AS (SELECT DISTINCT p.word, p.n, w.word AS near, w.n AS near_n FROM places p JOIN words w ON w.word = p.head || p.tail),
pairs AS (
  SELECT a.word, b.word AS near, b.n AS near_n FROM places a JOIN places b ON a.head = b.head AND a.tail = b.tail AND a.i = b.i AND a.word <> b.word
  UNION ALL SELECT word, near, near_n FROM shorter UNION ALL SELECT near, word, n FROM shorter),
best AS (SELECT word, near, near_n, count(*) OVER (PARTITION BY word) AS n_near, row_number() OVER (PARTITION BY word ORDER BY near_n DESC, near) AS r FROM pairs),
told AS (SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN b.near_n >= 5 * w.n THEN b.near END AS form, CASE WHEN b.near_n >= 5 * w.n THEN b.near_n END AS form_n FROM words w LEFT JOIN best b ON b.word = w.word AND b.r = 1),
way AS (SELECT word, form AS at FROM told WHERE form IS NOT NULL UNION ALL SELECT way.word, t.form FROM way JOIN told t ON t.word = way.at WHERE t.form IS NOT NULL),
ends AS (SELECT way.word, way.at AS root FROM way JOIN told t ON t.word = way.at WHERE t.form IS NULL)
SELECT t.word, t.form, coalesce(e.root, t.word) AS root, t.n, t.n_near, t.form_n FROM told t LEFT JOIN ends e ON e.word = t.word"""


ORACLE_SQL: dict[str, str] = {"op13_spelling_variants": _spelling_sql(), "op7_secrets": _secrets_sql(), "op11_chat_format": _chat_sql(), "op12_hard_negatives": _hard_negatives_sql()}
