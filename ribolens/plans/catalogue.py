"""The catalogue of queries over the test tables, and their SQL.

Documents stand for sequences, line items for homology hits, labels for predictions. Every query reads its whole tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import kmers, sequence
from ..operators import evaluate, extract, hits, homology, joins, model, orf
from ..schemas import HIT_FEATURES, NO_HITS, TRIMERS
from ..sources import fasta, tables

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
DIGITS = 6


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Deal a table that was read as few tasks over the cores, ahead of costly projections."""
    spark = df.sparkSession
    n = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return df.repartition(n) if df.rdd.getNumPartitions() < n // 2 else df


def seqs(spark: SparkSession, sf_dir: str) -> DataFrame:
    letters = F.lower(F.regexp_replace("text", "[^A-Za-z]", ""))
    seq = F.translate(letters, "abcdefghijklmnopqrstuvwxyz", "ACGTACGTACGTACGTACGTACGTAC")
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select("doc_id", seq.alias("seq")).withColumn("seq_len", F.length("seq"))


SEQS = """seqs AS (
  SELECT doc_id, seq, length(seq) AS seq_len FROM (
    SELECT doc_id, translate(lower(regexp_replace(text, '[^A-Za-z]', '', 'g')), 'abcdefghijklmnopqrstuvwxyz', 'ACGTACGTACGTACGTACGTACGTAC') AS seq FROM documents
  )
)"""


def hit_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    sign = F.when(F.col("l_linestatus") == "O", 1).otherwise(-1)
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("qseqid"),
        F.col("l_partkey").alias("sseqid"),
        F.col("l_discount").alias("evalue"),
        F.col("l_extendedprice").alias("bitscore"),
        F.col("l_quantity").alias("qcovhsp"),
        F.col("l_linenumber").alias("l_linenumber"),
        ((((F.col("l_linenumber") - 1) % 3) + 1) * sign).alias("qframe"),
    )


HITS = """hits AS (
  SELECT l_orderkey AS qseqid, l_partkey AS sseqid, l_discount AS evalue, l_extendedprice AS bitscore, l_quantity AS qcovhsp, l_linenumber,
    (((l_linenumber - 1) % 3) + 1) * (CASE l_linestatus WHEN 'O' THEN 1 ELSE -1 END) AS qframe
  FROM lineitem
)"""


def preds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, label, prediction, score: labels as predictions, the documents' lengths as scores."""
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"), F.col("toxic").alias("prediction"))
    return labels.join(table(spark, sf_dir, "documents").select("doc_id", F.col("n_chars").alias("score")), "doc_id")


PREDS = """preds AS (
  SELECT doc_id, quality AS label, toxic AS prediction, n_chars AS score FROM labels JOIN documents USING (doc_id)
)"""


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c), DIGITS) + 0.0 for c in columns})


# Sequences


@query(f"WITH {SEQS} SELECT doc_id, CAST(seq_len AS BIGINT) AS seq_len FROM seqs")
def seq_length(spark, sf_dir):
    return seqs(spark, sf_dir).select("doc_id", F.col("seq_len").cast("long").alias("seq_len"))


@query(f"WITH {SEQS} SELECT doc_id, CAST(seq_len AS BIGINT) AS seq_len FROM seqs WHERE seq_len >= 1000")
def min_len_filter(spark, sf_dir):
    return extract.min_length(seqs(spark, sf_dir), 1000).select("doc_id", F.col("seq_len").cast("long").alias("seq_len"))


@query(f"WITH {SEQS} SELECT count(*) FILTER (seq_len < 1000) AS removed, count(*) FILTER (seq_len >= 1000) AS retained FROM seqs")
def min_len_counts(spark, sf_dir):
    return extract.min_length_counts(seqs(spark, sf_dir), 1000)


@query(f"WITH {SEQS} SELECT doc_id, CAST(seq_len AS BIGINT) AS seq_len FROM seqs WHERE seq_len BETWEEN 500 AND 2000")
def length_range_filter(spark, sf_dir):
    return extract.length_range(seqs(spark, sf_dir), 500, 2000).select("doc_id", F.col("seq_len").cast("long").alias("seq_len"))


def _sql_count(base: str, seq: str = "seq") -> str:
    return f"(length({seq}) - length(replace({seq}, '{base}', '')))"


@query(
    f"""WITH {SEQS}, n AS (SELECT doc_id, seq_len, {', '.join(f'{_sql_count(b)} AS n_{b.lower()}' for b in 'ACGT')} FROM seqs)
SELECT doc_id, {', '.join(f'CAST(n_{b} AS BIGINT) AS n_{b}' for b in 'acgt')}, {', '.join(f'round(n_{b} * 100.0::DOUBLE / nullif(seq_len, 0), 6) AS pct_{b}' for b in 'acgt')},
  round((n_g + n_c) * 100.0::DOUBLE / nullif(seq_len, 0), 6) AS gc_pct, round((n_a + n_t) * 100.0::DOUBLE / nullif(seq_len, 0), 6) AS at_pct FROM n"""
)
def base_composition(spark, sf_dir):
    out = seqs(spark, sf_dir).select(
        "doc_id",
        *(sequence.base_count("seq", b).cast("long").alias(f"n_{b.lower()}") for b in "ACGT"),
        *(sequence.base_percent("seq", b).alias(f"pct_{b.lower()}") for b in "ACGT"),
        sequence.base_percent("seq", "GC").alias("gc_pct"),
        sequence.base_percent("seq", "AT").alias("at_pct"),
    )
    return rounded(out, "pct_a", "pct_c", "pct_g", "pct_t", "gc_pct", "at_pct")


def _sql_entropy(counts: list[str], empty: str) -> str:
    total = f"({' + '.join(counts)})"
    terms = " + ".join(f"CASE WHEN {c} > 0 THEN -({c}::DOUBLE / {total}) * log2({c}::DOUBLE / {total}) ELSE 0 END" for c in counts)
    return f"CASE WHEN {total} > 0 THEN round({terms}, 6) + 0.0 ELSE {empty} END"


@query(f"WITH {SEQS}, n AS (SELECT doc_id, {', '.join(f'{_sql_count(b)} AS {b.lower()}' for b in 'ACGT')} FROM seqs) SELECT doc_id, CAST({_sql_entropy(list('acgt'), '0.0')} AS DOUBLE) AS entropy FROM n")
def sequence_entropy(spark, sf_dir):
    return rounded(seqs(spark, sf_dir).select("doc_id", sequence.sequence_entropy("seq").alias("entropy")), "entropy")


LONG = """long AS (
  SELECT doc_id, trimer, count(*) AS n FROM (SELECT doc_id, substr(seq, i, 3) AS trimer FROM (SELECT doc_id, seq, unnest(range(1, seq_len - 1)) AS i FROM seqs))
  GROUP BY doc_id, trimer
)"""


@query(f"WITH {SEQS}, {LONG} SELECT doc_id, trimer, n FROM long")
def trimer_counts(spark, sf_dir):
    counted = seqs(spark, sf_dir).select("doc_id", F.posexplode(kmers.trimer_counts(F.col("seq"))).alias("i", "n"))
    names = F.array(*map(F.lit, TRIMERS))
    return counted.filter("n > 0").select("doc_id", names[F.col("i")].alias("trimer"), F.col("n").cast("long").alias("n"))


@query(
    f"""WITH {SEQS}, {LONG}
SELECT s.doc_id, {', '.join(f'''round(CASE WHEN s.seq_len > 2 THEN coalesce(max(n) FILTER (trimer = '{t}'), 0) * 100.0::DOUBLE / (s.seq_len - 2) END, 6) AS "{t}"''' for t in TRIMERS)},
  CAST(s.seq_len AS BIGINT) AS length
FROM seqs s LEFT JOIN long l ON l.doc_id = s.doc_id GROUP BY s.doc_id, s.seq_len"""
)
def trimer_features(spark, sf_dir):
    out = kmers.with_trimers(seqs(spark, sf_dir).select("doc_id", "seq")).drop("seq")
    return rounded(out, *TRIMERS).withColumn("length", F.col("length").cast("long"))


@query(
    f"""WITH {SEQS} SELECT doc_id, {', '.join(f"round(CASE WHEN seq_len > 5 THEN {_sql_count(b, f'substr(seq, {j}, seq_len - 5)')}::DOUBLE / (seq_len - 5) END, 6) AS {b.lower()}{j}" for b in 'AGCT' for j in range(1, 7))} FROM seqs"""
)
def hexmer_matrix(spark, sf_dir):
    columns = sequence.hexamer_matrix("seq")
    return rounded(seqs(spark, sf_dir).select("doc_id", *(c.alias(n) for n, c in columns.items())), *columns)


@query(
    f"""WITH {SEQS}, p AS (SELECT doc_id, {', '.join(f"list_transform(range({k}, seq_len + 1, 3), lambda i: substr(seq, i, 1)) AS p{k}" for k in (1, 2, 3))} FROM seqs)
SELECT doc_id, {', '.join(f"round(len(list_filter(p{k}, lambda x: x = 'G' OR x = 'C')) * 100.0::DOUBLE / nullif(len(p{k}), 0), 6) AS gc{k}" for k in (1, 2, 3))} FROM p"""
)
def gc_by_codon_pos(spark, sf_dir):
    out = seqs(spark, sf_dir).select("doc_id", *(sequence.codon_position_gc("seq", k).alias(f"gc{k}") for k in (1, 2, 3)))
    return rounded(out, "gc1", "gc2", "gc3")


WEIGHT = "CASE WHEN c IN ('TAA', 'TAG', 'TGA') THEN -5.0 ELSE 0.25 * (length(c) - length(replace(replace(c, 'G', ''), 'C', '')) - 1) END"


@query(
    f"""WITH {SEQS},
step AS (SELECT doc_id, (i - 1) % 3 AS f, i, substr(seq, i, 3) AS c FROM (SELECT doc_id, seq, unnest(range(1, seq_len - 4)) AS i FROM seqs)),
run AS (SELECT doc_id, f, i, sum(CAST({WEIGHT} AS DOUBLE)) OVER (PARTITION BY doc_id, f ORDER BY i) AS r FROM step),
low AS (SELECT doc_id, f, r, coalesce(min(r) OVER (PARTITION BY doc_id, f ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS m FROM run),
best AS (SELECT doc_id, f, max(r - least(m, 0)) AS s FROM low GROUP BY doc_id, f)
SELECT s.doc_id, {', '.join(f'coalesce(max(b.s) FILTER (b.f = {f}), 0.0) AS score_f{f}' for f in range(3))}, greatest({', '.join(f'coalesce(max(b.s) FILTER (b.f = {f}), 0.0)' for f in range(3))}) AS orf_score_approx
FROM seqs s LEFT JOIN best b ON b.doc_id = s.doc_id GROUP BY s.doc_id"""
)
def orf_frame_score(spark, sf_dir):
    out = orf.score_orfs(seqs(spark, sf_dir), orf.rule_weights(), keep=("doc_id",))
    return out.select("doc_id", "score_f0", "score_f1", "score_f2", "orf_score_approx")


# Homology hits


@query(f"WITH {HITS} SELECT qseqid, count(*) AS n FROM hits GROUP BY qseqid")
def hit_count(spark, sf_dir):
    return hit_rows(spark, sf_dir).groupBy("qseqid").agg(F.count(F.lit(1)).alias("n"))


SQL_SCORE = "round(sum(CASE WHEN evalue = 0 THEN 250.0::DOUBLE ELSE -ln(evalue) END), 6)"


@query(f"WITH {HITS} SELECT qseqid, {SQL_SCORE} AS hit_score FROM hits GROUP BY qseqid")
def hit_score(spark, sf_dir):
    return rounded(hit_rows(spark, sf_dir).groupBy("qseqid").agg(hits.hit_score(F.col("evalue")).alias("hit_score")), "hit_score")


@query(f"WITH {HITS} SELECT qseqid, round(sum(bitscore), 4) AS bitscore FROM hits GROUP BY qseqid")
def hit_bitscore(spark, sf_dir):
    return hit_rows(spark, sf_dir).groupBy("qseqid").agg(F.round(F.sum("bitscore"), 4).alias("bitscore"))


SQL_FRAMES = ", ".join(f"count(*) FILTER (qframe = {k}) AS f{k}" for k in (1, 2, 3))


@query(f"WITH {HITS} SELECT qseqid, {SQL_FRAMES} FROM hits GROUP BY qseqid")
def frame_counts(spark, sf_dir):
    return hit_rows(spark, sf_dir).groupBy("qseqid").agg(*(hits.frame_count(k).alias(f"f{k}") for k in (1, 2, 3)))


SQL_FRAME_ENTROPY = f"CAST({_sql_entropy(['f1', 'f2', 'f3'], '1.0')} AS DOUBLE)"


@query(f"WITH {HITS}, f AS (SELECT qseqid, {SQL_FRAMES} FROM hits GROUP BY qseqid) SELECT qseqid, {SQL_FRAME_ENTROPY} AS frame_entropy FROM f")
def frame_entropy(spark, sf_dir):
    counts = frame_counts(spark, sf_dir)
    return rounded(counts.select("qseqid", hits.frame_entropy([F.col(f"f{k}") for k in (1, 2, 3)]).alias("frame_entropy")), "frame_entropy")


HIT_SQL = f"""f AS (SELECT qseqid, {SQL_FRAMES}, count(*) AS n, {SQL_SCORE} AS s, round(sum(bitscore), 4) AS b FROM hits GROUP BY qseqid),
hf AS (SELECT qseqid AS seq_id, n AS "all_numhits", s AS "all_HitScore", {SQL_FRAME_ENTROPY} AS "all_Frame_Entropy", b AS "all_Bitscore" FROM f)"""


def _hit_features(spark, sf_dir):
    out = rounded(hits.hit_features(hit_rows(spark, sf_dir)), "all_HitScore", "all_Frame_Entropy")
    return out.withColumn("all_Bitscore", F.round("all_Bitscore", 4))


@query(f"WITH {HITS}, {HIT_SQL} SELECT * FROM hf")
def hit_features(spark, sf_dir):
    return _hit_features(spark, sf_dir)


@query(f"WITH {HITS} SELECT qseqid, CAST(min(l_linenumber) AS BIGINT) AS first_seen FROM hits GROUP BY qseqid")
def distinct_query_ids(spark, sf_dir):
    return hits.distinct_queries(hit_rows(spark, sf_dir), "l_linenumber").withColumn("first_seen", F.col("first_seen").cast("long"))


@query(f"WITH {HITS} SELECT qseqid, sseqid, qcovhsp, CAST(l_linenumber AS BIGINT) AS l_linenumber FROM hits WHERE qcovhsp >= 30")
def qcov_filter(spark, sf_dir):
    return hits.coverage_filter(hit_rows(spark, sf_dir), 30).select("qseqid", "sseqid", "qcovhsp", F.col("l_linenumber").cast("long").alias("l_linenumber"))


@query(
    f"""WITH {HITS}, {HIT_SQL} SELECT o_orderkey AS seq_id, {', '.join(f'coalesce(CAST("{c}" AS DOUBLE), {d}::DOUBLE) AS "{c}"' for c, d in zip(HIT_FEATURES, NO_HITS))}
FROM orders LEFT JOIN hf ON seq_id = o_orderkey"""
)
def features_left_join_default(spark, sf_dir):
    transcripts = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("seq_id"))
    return joins.join_hits(transcripts, _hit_features(spark, sf_dir))


@query(
    """SELECT n_nationkey, n_name, line AS matched, CAST(line_key AS BIGINT) AS matched_key FROM (
  SELECT a.n_nationkey, a.n_name, b.n_name AS line, b.n_nationkey AS line_key, row_number() OVER (PARTITION BY a.n_nationkey ORDER BY b.n_nationkey DESC) AS k
  FROM nation a JOIN nation b ON contains(b.n_name, a.n_name)) WHERE k = 1"""
)
def substring_first_match(spark, sf_dir):
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    lines = nation.select(F.col("n_name").alias("line"), (-F.col("n_nationkey")).alias("place"))
    found = joins.first_substring_match(nation, lines, "n_name", "line", "place")
    return found.select("n_nationkey", "n_name", "matched", (-F.col("matched_order")).cast("long").alias("matched_key"))


@query(
    """SELECT a.ordinal, c_custkey, o_orderkey FROM (SELECT row_number() OVER (ORDER BY c_custkey) AS ordinal, c_custkey FROM customer) a
JOIN (SELECT row_number() OVER (ORDER BY o_orderkey) AS ordinal, o_orderkey FROM orders WHERE o_orderkey <= (SELECT max(c_custkey) FROM customer)) b ON a.ordinal = b.ordinal"""
)
def positional_zip(spark, sf_dir):
    customers = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_custkey").alias("ord"))
    last = customers.agg(F.max("c_custkey").alias("last"))
    orders = table(spark, sf_dir, "orders").join(F.broadcast(last), F.col("o_orderkey") <= F.col("last")).select("o_orderkey", F.col("o_orderkey").alias("ord"))
    left = joins.with_ordinal(customers, "ord").drop("ord")
    return left.join(joins.with_ordinal(orders, "ord").drop("ord"), "ordinal")


@query(
    """SELECT 'D' || doc_id AS seq_id, CAST(CASE WHEN doc_id % 3 = 0 THEN -1 ELSE 1 END * n_chars / 100.0::DOUBLE AS DOUBLE) AS score,
  CAST(n_chars % 100 AS DOUBLE) + 0.5 AS orf_coverage FROM documents WHERE doc_id % 7 <> 0"""
)
def orf_report_parse(spark, sf_dir):
    sign = F.when(F.col("doc_id") % 3 == 0, "-").otherwise("")
    number = lambda c: F.format_string("%d.%02d", F.floor(c / 100).cast("long"), c % 100)
    head = F.concat(F.lit(">D"), F.col("doc_id"), F.lit(" [framefinder (0,9) score="), sign, number(F.col("n_chars")), F.lit(" used="), F.col("n_chars") % 100, F.lit(".50% "))
    tail = F.when(F.col("doc_id") % 7 != 0, "{forward,strict} ]\r").otherwise("]")  # lines without a brace are no headers
    return tables.parse_orf(table(spark, sf_dir, "documents").select(F.concat(head, tail).alias("value")))


# Classes, predictions, evaluation


@query(f"WITH {SEQS} SELECT doc_id, CAST(seq_len AS BIGINT) AS seq_len, quality AS label FROM seqs JOIN labels USING (doc_id)")
def class_union(spark, sf_dir):
    rows = seqs(spark, sf_dir).select("doc_id", F.col("seq_len").cast("long").alias("seq_len")).join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id")
    return joins.union_classes(rows.filter("quality = 0").drop("quality"), rows.filter("quality = 1").drop("quality"))


@query("SELECT range AS ord, CASE WHEN range < 130 THEN 1 ELSE 0 END AS label FROM range(260)")
def label_generator(spark, sf_dir):
    return tables.label_generator(spark, 130, 130)


@query(f"WITH {PREDS} SELECT prediction, count(*) AS n, round(count(*)::DOUBLE / (SELECT count(*) FROM preds), 6) AS fraction FROM preds GROUP BY prediction")
def predicted_class_summary(spark, sf_dir):
    return rounded(evaluate.class_summary(preds(spark, sf_dir)), "fraction")


@query(
    """WITH l AS (SELECT row_number() OVER (ORDER BY doc_id) AS k, quality FROM labels), p AS (SELECT row_number() OVER (ORDER BY doc_id) AS k, doc_id, toxic FROM labels)
SELECT doc_id, toxic AS prediction, quality AS label FROM p JOIN l USING (k)"""
)
def label_join(spark, sf_dir):
    labels = table(spark, sf_dir, "labels")
    return evaluate.join_labels(labels.select("doc_id", F.col("toxic").alias("prediction")), labels.select(F.col("doc_id"), F.col("quality").alias("label")), "doc_id")


SQL_CELLS = ", ".join(f"count(*) FILTER (label = {y} AND prediction = {p}) AS {n}" for n, y, p in (("tp", 1, 1), ("fn", 1, 0), ("tn", 0, 0), ("fp", 0, 1)))
SQL_MATRIX = f"m AS (SELECT {SQL_CELLS}, count(*) FILTER (NOT coalesce(label IN (0, 1) AND prediction IN (0, 1), false)) AS other FROM preds)"


@query(f"WITH {PREDS}, {SQL_MATRIX} SELECT * FROM m")
def confusion_matrix(spark, sf_dir):
    return evaluate.confusion(preds(spark, sf_dir))


@query(
    f"""WITH {PREDS}, {SQL_MATRIX} SELECT *, round(tp::DOUBLE / nullif(tp + fn, 0), 6) AS sensitivity, round(tn::DOUBLE / nullif(tn + fp, 0), 6) AS specificity,
  round(100.0::DOUBLE * (tp + tn) / nullif(tp + tn + fp + fn, 0), 6) AS accuracy,
  round((tp::DOUBLE * tn - fp::DOUBLE * fn) / nullif(sqrt((tp + fp)::DOUBLE * (tp + fn) * (tn + fp) * (tn + fn)), 0), 6) AS mcc FROM m"""
)
def classifier_metrics(spark, sf_dir):
    return rounded(evaluate.metrics(evaluate.confusion(preds(spark, sf_dir))), "sensitivity", "specificity", "accuracy", "mcc")


SQL_BY_SCORE = """g AS (SELECT score AS threshold, count(*) FILTER (label = 1) AS pos, count(*) FILTER (label = 0) AS neg FROM preds GROUP BY score),
r AS (SELECT threshold, pos, neg, sum(pos) OVER (ORDER BY threshold DESC) AS tp, sum(neg) OVER (ORDER BY threshold DESC) AS fp, sum(neg) OVER (ORDER BY threshold) AS below FROM g),
t AS (SELECT sum(pos)::DOUBLE AS p, sum(neg)::DOUBLE AS n FROM g)"""


@query(f"WITH {PREDS}, {SQL_BY_SCORE} SELECT threshold, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, round(tp / nullif(p, 0), 6) AS tpr, round(fp / nullif(n, 0), 6) AS fpr FROM r, t")
def roc_points(spark, sf_dir):
    return rounded(evaluate.roc_points(preds(spark, sf_dir), "score", "label", width=1024), "tpr", "fpr")


@query(f"WITH {PREDS}, {SQL_BY_SCORE} SELECT round(sum(pos * (below - neg + neg / 2.0::DOUBLE)) / nullif(max(p * n), 0), 6) AS auc FROM r, t")
def roc_auc(spark, sf_dir):
    return rounded(evaluate.roc_auc(preds(spark, sf_dir), "score", "label", width=1024), "auc")


def _extraction(spark, sf_dir):
    sequences = seqs(spark, sf_dir).select(F.col("doc_id").alias("seq_id"), "seq", "seq_len")
    p = F.col("score") / (F.col("score") + 1000.0)
    rows = preds(spark, sf_dir).select(F.col("doc_id").alias("seq_id"), "prediction", p.alias("p_noncoding"), (1.0 - p).alias("p_coding"))
    lost = table(spark, sf_dir, "labels").agg((F.max("doc_id") + 1000000).alias("seq_id"), F.lit(0).alias("prediction"), F.lit(1.0).alias("p_noncoding"), F.lit(0.0).alias("p_coding"))
    return sequences, rows.unionByName(lost)


SQL_CHOSEN = f"""{SEQS}, {PREDS}, chosen AS (
  SELECT doc_id FROM preds WHERE prediction = 0 AND score / (score + 1000.0::DOUBLE) >= 0.4 UNION SELECT max(doc_id) + 1000000 FROM labels
)"""


@query(f"WITH {SQL_CHOSEN} SELECT doc_id AS seq_id, CAST(seq_len AS BIGINT) AS seq_len FROM seqs WHERE doc_id IN (SELECT doc_id FROM chosen) AND seq_len BETWEEN 800 AND 5000")
def predtoseq_extract(spark, sf_dir):
    out = extract.extract(*_extraction(spark, sf_dir), 0, 0.4, 800, 5000)
    return out.select("seq_id", F.col("seq_len").cast("long").alias("seq_len"))


@query(
    f"""WITH {SQL_CHOSEN} SELECT count(*) AS matched, count(*) FILTER (seq_len > 5000) AS too_long, count(*) FILTER (seq_len < 800) AS too_short,
  count(*) FILTER (seq_len BETWEEN 800 AND 5000) AS written, count(*) FILTER (seq_len IS NULL) AS not_found FROM chosen LEFT JOIN seqs USING (doc_id)"""
)
def predtoseq_report(spark, sf_dir):
    return extract.report(*_extraction(spark, sf_dir), 0, 0.4, 800, 5000)


@query("SELECT arg_max(o_orderkey, (o_totalprice, -o_orderkey)) AS best FROM orders")
def best_model_select(spark, sf_dir):
    return table(spark, sf_dir, "orders").agg(F.max_by("o_orderkey", F.struct(F.col("o_totalprice"), -F.col("o_orderkey"))).alias("best"))


@query("SELECT s_name AS feature, round(s_acctbal / 10000, 4) AS importance FROM supplier ORDER BY importance DESC, feature DESC")
def importance_sort(spark, sf_dir):
    return model.sort_importances(table(spark, sf_dir, "supplier").select(F.col("s_name").alias("feature"), (F.col("s_acctbal") / 10000).alias("importance")))


# Files and models


@query(f"WITH {SEQS} SELECT 'D' || doc_id AS seq_id, seq, CAST(seq_len AS BIGINT) AS seq_len FROM seqs WHERE seq_len > 0")
def fasta_roundtrip(spark, sf_dir):
    """Written as FASTA, read back."""
    path = scratch(spark, "fasta")
    rows = seqs(spark, sf_dir).filter("seq_len > 0").select(F.col("doc_id").alias("ord"), F.concat(F.lit("D"), "doc_id").alias("seq_id"), F.lit("").alias("description"), "seq")
    fasta.write_fasta(rows, path)
    return fasta.read_fasta(spark, path).select("seq_id", "seq", F.col("seq_len").cast("long").alias("seq_len"))


@query("SELECT 'D' || doc_id AS seq_id, toxic AS prediction, round((toxic * 2 + 1) / 4.0::DOUBLE, 6) AS p_coding, round(1 - (toxic * 2 + 1) / 4.0::DOUBLE, 6) AS p_noncoding FROM labels")
def prediction_roundtrip(spark, sf_dir):
    """Written as a prediction table, read back."""
    path = scratch(spark, "predictions")
    p = (F.col("toxic") * 2 + 1) / 4.0
    rows = table(spark, sf_dir, "labels").select(F.concat(F.lit("D"), "doc_id").alias("seq_id"), F.col("toxic").alias("prediction"), p.alias("p_coding"), (1 - p).alias("p_noncoding"))
    tables.write_predictions(rows, path)
    return rounded(tables.read_predictions(spark, path), "p_coding", "p_noncoding")


@query(f"WITH {HITS}, {HIT_SQL} SELECT CAST(seq_id AS VARCHAR) AS seq_id, * EXCLUDE (seq_id) FROM hf")
def hit_table_scan(spark, sf_dir):
    """Hits written as a table of ten columns, with one malformed line, read back and summed up."""
    path = scratch(spark, "hits")
    columns = ["qseqid", "sseqid", F.lit(90.0), "evalue", F.lit(50.0), "qcovhsp", F.lit(1.0), "bitscore", "qframe", F.lit(1)]
    lines = hit_rows(spark, sf_dir).select(F.concat_ws("\t", *columns).alias("value")).unionByName(spark.range(1).select(F.lit("malformed line").alias("value")))
    lines.write.text(path)
    out = rounded(hits.hit_features(tables.good_hits(tables.read_hits(spark, path))), "all_HitScore", "all_Frame_Entropy")
    return out.withColumn("all_Bitscore", F.round("all_Bitscore", 4))


@query(
    f"""WITH {SEQS}, b AS (SELECT doc_id, seq AS s, 1 AS way FROM seqs UNION ALL SELECT doc_id, reverse(translate(seq, 'ACGT', 'TGCA')), -1 FROM seqs),
c AS (SELECT doc_id, way * (1 + (i - 1) % 3) AS qframe, i, substr(s, i, 3) AS t FROM (SELECT doc_id, s, way, unnest(range(1, length(s) - 1)) AS i FROM b)),
r AS (SELECT doc_id, qframe, string_agg(substr('{homology.RESIDUES}', CAST((strpos('TCAG', t[1]) - 1) * 16 + (strpos('TCAG', t[2]) - 1) * 4 + strpos('TCAG', t[3]) AS BIGINT), 1), '' ORDER BY i) AS p FROM c GROUP BY doc_id, qframe)
SELECT x.doc_id, f AS qframe, length(coalesce(p, '')) AS n_residues, md5(coalesce(p, '')) AS protein_md5
FROM (SELECT doc_id, unnest([1, 2, 3, -1, -2, -3]) AS f FROM seqs) x LEFT JOIN r ON r.doc_id = x.doc_id AND r.qframe = f"""
)
def six_frame_translation(spark, sf_dir):
    out = homology.six_frames(seqs(spark, sf_dir).select(F.col("doc_id").cast("string").alias("seq_id"), "seq"))
    return out.select(F.col("seq_id").cast("long").alias("doc_id"), "qframe", F.length("protein").cast("long").alias("n_residues"), F.md5("protein").alias("protein_md5"))


@query()
def rf_predict(spark, sf_dir):
    """A small forest on the trimers of labelled documents, scored on all documents."""
    rows = kmers.with_trimers(seqs(spark, sf_dir).filter("seq_len > 2").withColumnRenamed("doc_id", "seq_id"))
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("seq_id"), F.col("quality").alias("label"))
    forest = model.train_best(rows.join(labels, "seq_id"), [*TRIMERS, "length"], forests=2, trees=8, groups=2, depth=6)
    return model.predict(rows, forest)


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder that the driver and the executors share: under spark.checkpoint.dir, else a local one."""
    import tempfile
    import uuid

    top = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or "file://" + tempfile.gettempdir()
    return f"{top.rstrip('/')}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
