"""The queries of the training-data operators, with production parameters over whole tables, and their SQL."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontaminate, exact_dedup, language_id, lm_score, ngram_join, packing, pii, toxicity, url_filter


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary() -> str:
    """The byte-level vocabulary file; RIBOLENS_VOCABULARY names another place."""
    import public_tokenizers

    return os.environ.get("RIBOLENS_VOCABULARY") or public_tokenizers.path("byte_bpe_50k.json")


def op2_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), vocabulary()).drop("ids")


def op3_tree_merge_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"), keep="max")


OP3_SQL = """
WITH d AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS s FROM documents
)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, s AS text_sha256
FROM d WINDOW w AS (PARTITION BY s)
"""


def op5_wu_manber(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digest(decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


OP5_SQL = r"""
WITH pattern AS (SELECT '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+' AS p),
d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), p) AS w FROM documents, pattern
),
b AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), p) AS w FROM benchmark, pattern
),
bw AS (
  SELECT DISTINCT item, least(len(w), 10) AS m, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS s
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)
),
lengths AS (SELECT DISTINCT m FROM bw),
dw AS (
  SELECT doc_id, m, i, array_to_string(w[i : i + m - 1], ' ') AS s
  FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d, lengths WHERE len(w) >= m)
),
found AS (SELECT doc_id, dw.m, i, item FROM dw JOIN bw ON dw.s = bw.s AND dw.m = bw.m),
hit AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS k FROM found) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, item FROM found) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
"""

def op1_information_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find(table(spark, sf_dir, "documents")))


def op4_nb_char_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_stupid_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lm_score.score(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", F.round("score", 6).alias("score"))


OP6_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
),
g AS (
  SELECT doc_id, i, w[i] AS c, CASE WHEN i > 1 THEN w[i - 1] END AS b, CASE WHEN i > 2 THEN w[i - 2] END AS a
  FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d)
),
one AS (SELECT c, count(*) AS n FROM g GROUP BY c),
two AS (SELECT b, c, count(*) AS n FROM g WHERE b IS NOT NULL GROUP BY b, c),
three AS (SELECT a, b, c, count(*) AS n FROM g WHERE a IS NOT NULL GROUP BY a, b, c),
total AS (SELECT count(*) AS n FROM g),
s AS (
  SELECT doc_id, CASE
    WHEN three.n >= 2 THEN ln(three.n / ab.n)
    WHEN bc.n >= 2 THEN ln(bc.n / y.n) + CASE WHEN g.a IS NULL THEN 0 ELSE ln(0.4) END
    ELSE ln(x.n / total.n) + CASE WHEN g.b IS NULL THEN 0 WHEN g.a IS NULL THEN ln(0.4) ELSE 2 * ln(0.4) END
  END AS v
  FROM g JOIN one x ON x.c = g.c CROSS JOIN total LEFT JOIN one y ON y.c = g.b
    LEFT JOIN two bc ON bc.b = g.b AND bc.c = g.c LEFT JOIN two ab ON ab.b = g.a AND ab.c = g.b
    LEFT JOIN three ON three.a = g.a AND three.b = g.b AND three.c = g.c
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, round(avg(v), 6) AS score FROM d LEFT JOIN s USING (doc_id) GROUP BY d.doc_id, len(w)
"""


def op7_budgeted_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    probe = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    return chat.digest(chat.format_chat(rows.unionByName(probe)))


def _sql_escape(c: str) -> str:
    c = f"replace({c}, '\\', '\\\\')"
    for s in chat.CONTROL:
        c = f"replace({c}, '{s}', '{s[0]}\\{s[1:]}')"
    return c


OP7_SQL = f"""
WITH r AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
),
p AS (SELECT *, length({_sql_escape('role')}) + length({_sql_escape('text')}) + {len("<||>") + 1 + len(chat.END)} AS size FROM r),
t AS (
  SELECT *, CAST(ceil(size / {chat.TOKEN}) AS BIGINT) AS tokens, row_number() OVER o - 1 AS idx,
    sum(CAST(ceil(size / {chat.TOKEN}) AS BIGINT)) OVER o - CAST(ceil(size / {chat.TOKEN}) AS BIGINT) AS pos
  FROM p WINDOW o AS (PARTITION BY conv_id ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING)
),
w AS (SELECT *, 2 * (pos // {chat.BUDGET // 2}) + CAST(pos // {chat.BUDGET // 2} <> (pos + tokens - 1) // {chat.BUDGET // 2} AS BIGINT) AS win FROM t),
f AS (SELECT conv_id, win, min(idx) AS first, min(pos) AS pos FROM w GROUP BY conv_id, win),
again AS (
  SELECT f.conv_id, f.win, w.idx, w.size FROM f JOIN w ON w.conv_id = f.conv_id AND w.idx >= f.first - {chat.HISTORY_TURNS} AND w.idx < f.first AND f.pos - w.pos <= {chat.BUDGET // 4}
  UNION
  SELECT f.conv_id, f.win, s.idx, s.size FROM f JOIN (SELECT conv_id, min(idx) AS idx, arg_min(size, idx) AS size FROM w WHERE role = 'system' GROUP BY conv_id) s ON s.conv_id = f.conv_id AND s.idx < f.first
),
chars AS (SELECT conv_id, sum(size) AS n FROM (SELECT conv_id, size FROM w UNION ALL SELECT conv_id, size FROM again) GROUP BY conv_id),
own AS (
  SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY idx) AS whole,
    coalesce(string_agg(text, '' ORDER BY idx) FILTER (role = 'assistant'), '') AS loss
  FROM w GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(whole) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, CAST(n AS BIGINT) AS formatted_chars
FROM own JOIN chars USING (conv_id)
"""


def op8_url_lm_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"))


def op9_adaptive_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar_groups(table(spark, sf_dir, "documents"))


def op10_crf_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_information_pii,
        op2_harmonic_packing,
        op3_tree_merge_dedup,
        op4_nb_char_toxicity,
        op5_wu_manber,
        op6_stupid_backoff,
        op7_budgeted_chat,
        op8_url_lm_ratio,
        op9_adaptive_jaccard,
        op10_crf_language_id,
    )
}
ORACLE_SQL = {
    "op3_tree_merge_dedup": OP3_SQL,
    "op5_wu_manber": OP5_SQL,
    "op6_stupid_backoff": OP6_SQL,
    "op7_budgeted_chat": OP7_SQL,
}
