"""Queries of the training-data problems."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.cutoff import CountTree, keep_above
from tidemark.llm.mixing import Mix, mix
from tidemark.llm.packing import fill, packed
from tidemark.llm.tokens import token_count
from tidemark.llm.topn import top_n
from tidemark.llm.truncation import endings, measured_lengths, normal_source, significant_lengths, truncated
from tidemark.operators.inforce import in_force
from tidemark.session import new_path, written


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _eligible(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = in_force(_read(spark, sf_dir, "universe_month"), ["sid", "month_id"], "recv_at", ["avg_amount", "days_since_ipo"])
    return written(rows.where("days_since_ipo >= 120").select("month_id", "sid", "avg_amount"), "eligible")


def _cutoffs(tree: CountTree, eligible: DataFrame) -> DataFrame:
    return tree.cutoffs(eligible.groupBy("month_id").agg(F.count(F.lit(1)).alias("records")), 0.8, "average")


def _universe(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    eligible = _eligible(spark, sf_dir)
    tree = CountTree(spark, new_path(spark, "amounts"), ["month_id"])
    tree.add(eligible, "avg_amount", 0)
    return eligible, _cutoffs(tree, eligible)


def p3_cutoffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cutoff and kept size of each month."""
    return _universe(spark, sf_dir)[1]


def p3_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from a tree that got its records in three batches, one of them again, and was compacted in between."""
    eligible = _eligible(spark, sf_dir)
    tree = CountTree(spark, new_path(spark, "batched-amounts"), ["month_id"])
    batch = F.pmod(F.xxhash64("sid"), F.lit(3))
    for i in (0, 1, 1):
        tree.add(eligible.where(batch == i), "avg_amount", i)
    tree.compact()
    for i in (0, 2):
        tree.add(eligible.where(batch == i), "avg_amount", i)
    return _cutoffs(tree, eligible)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    eligible, cutoffs = _universe(spark, sf_dir)
    return keep_above(eligible, "avg_amount", cutoffs, ["month_id"]).select("month_id", "sid")


def p4_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best rows of each sid with their place."""
    scores = _read(spark, sf_dir, "scores").select("sid", "score_id", "fsm_score", "day")
    return top_n(scores, ["sid"], "fsm_score", ["day", "score_id"], ["score_id"], 5)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p4_top(spark, sf_dir).select("sid", "score_id")


def _sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return written(_read(spark, sf_dir, "documents").select("doc_id", normal_source(F.col("source")).alias("source"), token_count(F.col("text")).alias("tokens")), "tokens")


def _packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    capacities = [(r["pack_id"], r["capacity_tokens"]) for r in _read(spark, sf_dir, "pack_sizes").distinct().orderBy("pack_id").collect()]
    return packed(_sizes(spark, sf_dir), capacities)


def p6_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Container and place of every document, for each container capacity."""
    return _packed(spark, sf_dir)


def p6_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers and share of space used, for each capacity."""
    return fill(_packed(spark, sf_dir))


def _mixed(spark: SparkSession, sf_dir: str) -> Mix:
    plan = _read(spark, sf_dir, "source_mix").withColumn("source", normal_source(F.col("source")))
    return mix(_sizes(spark, sf_dir), plan)


def p7_uses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Uses of each document in each plan."""
    return _mixed(spark, sf_dir).uses


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and actual share of each source in each plan."""
    return _mixed(spark, sf_dir).shares


def p7_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each slot of each shard holds: its source, block, and the parts of documents in it."""
    return _mixed(spark, sf_dir).slots


def p8_judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with how it ends, whether its length is a limit of its source, and whether it was cut."""
    return truncated(_read(spark, sf_dir, "documents"))[0]


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p8_judged(spark, sf_dir).where("cut").select("doc_id")


def p8_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lengths at which a source cuts, with their hazard and its error."""
    limits = significant_lengths(measured_lengths(endings(_read(spark, sf_dir, "documents"))))
    return limits.select("source", "measure", F.col("length").cast("bigint").alias("length"), "n", "at_risk", F.round("hazard", 6).alias("hazard"), F.round("expected", 6).alias("expected"), F.round(F.log10(F.greatest("p", F.lit(1e-300))), 3).alias("log10_p"))


def p8_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each source cuts: all texts, those cut, and of these by a significant length, a mark or the kind of ending."""
    return p8_judged(spark, sf_dir).groupBy("source").agg(
        F.count(F.lit(1)).alias("documents"), F.count_if("cut").alias("cut"), *[F.count_if(F.coalesce(F.col("reason") == r, F.lit(False))).alias(f"cut_by_{r}") for r in ("length", "omission", "ending")], F.avg(F.col("cut").cast("double")).alias("share_cut")
    )


QUERIES = {f.__name__: f for f in (p3_cutoffs, p3_batches, p3_found, p4_top, p4_found, p6_packed, p6_fill, p7_uses, p7_shares, p7_slots, p8_judged, p8_found, p8_limits, p8_sources)}

_MONTHS = """WITH f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY sid, month_id ORDER BY recv_at DESC) AS rn FROM universe_month WHERE sid IS NOT NULL AND month_id IS NOT NULL) WHERE rn = 1 AND days_since_ipo >= 120),
    n AS (SELECT month_id, count(*) AS n FROM f GROUP BY month_id),
    r AS (SELECT month_id, sid, avg_amount, rank() OVER (PARTITION BY month_id ORDER BY avg_amount DESC) + (count(*) OVER (PARTITION BY month_id, avg_amount) - 1) / 2.0 AS rank FROM f WHERE avg_amount IS NOT NULL AND NOT isnan(avg_amount)),
    kept AS (SELECT r.*, n.n FROM r JOIN n USING (month_id) WHERE rank <= 0.8 * n)
    """
_CUTOFFS = _MONTHS + """, b AS (
        SELECT month_id, avg_amount AS cutoff, any_value(above) AS above, count(*) AS ties FROM (SELECT month_id, avg_amount, rank() OVER (PARTITION BY month_id ORDER BY avg_amount DESC) - 1 AS above FROM r) GROUP BY month_id, avg_amount),
    s AS (SELECT month_id, count(*) AS scored FROM r GROUP BY month_id),
    hit AS (SELECT b.* FROM b JOIN s USING (month_id) JOIN n USING (month_id) WHERE above < least(floor(0.8 * n.n), scored) AND least(floor(0.8 * n.n), scored) <= above + ties)
    SELECT n.month_id, n.n AS records, cutoff, coalesce(above + (ties + 1) / 2.0 <= 0.8 * n.n, false) AS inclusive, coalesce(above + CASE WHEN above + (ties + 1) / 2.0 <= 0.8 * n.n THEN ties ELSE 0 END, 0) AS kept FROM n LEFT JOIN hit USING (month_id)"""
_TOP = """SELECT sid, score_id, fsm_score, day, CAST(place AS INT) AS place FROM (
    SELECT *, row_number() OVER (PARTITION BY sid ORDER BY fsm_score DESC, day, score_id) AS place
    FROM (SELECT DISTINCT sid, score_id, day, fsm_score FROM scores WHERE sid IS NOT NULL AND day IS NOT NULL AND fsm_score IS NOT NULL AND NOT isnan(fsm_score))) WHERE place <= 5"""
# Texts differ by body; what is left over from whole packets counts once per length. The Poisson tail is summed term by term.
_LIMITS = """WITH b AS (SELECT DISTINCT coalesce(lower(trim(source)), '') AS source, regexp_replace(text, '\\n{1,2}$', '') AS body FROM documents WHERE regexp_matches(text, '[^ \\t\\r\\n\\f\\v\u00a0\u3000]')),
    s AS (SELECT source, len(body) AS chars, strlen(body) AS bytes FROM b),
    l AS (SELECT source, 'chars' AS measure, chars AS length FROM s UNION ALL SELECT source, 'bytes', bytes FROM s
        UNION ALL SELECT source, 'bytes%' || g, bytes % g FROM (SELECT DISTINCT source, bytes FROM s) d, (SELECT unnest([512, 1024, 1460]) AS g) g WHERE bytes >= g),
    c AS (SELECT source, measure, length, count(*) AS n FROM l GROUP BY ALL),
    h AS (SELECT *, CAST(sum(n) OVER (PARTITION BY source, measure ORDER BY length ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS at_risk, CAST(floor(ln(length + 500) / 0.1) AS BIGINT) AS bin, length - coalesce(lag(length) OVER (PARTITION BY source, measure ORDER BY length), length - 1) AS gap FROM c),
    hd AS (SELECT *, floor(log2(at_risk)) AS depth FROM h), d AS (SELECT source, measure, depth, sum(n) AS ends2, sum(gap * at_risk) AS exposure2 FROM hd GROUP BY ALL),
    e AS (SELECT source, measure, bin, sum(n) AS ends, sum(gap * at_risk) AS exposure FROM h GROUP BY ALL),
    o AS (SELECT source, measure, bin, sum(ends) AS ends, sum(exposure) AS exposure FROM (SELECT source, measure, ends, exposure, bin + unnest([-1, 0, 1]) AS bin FROM e) GROUP BY ALL),
    x AS (SELECT hd.*, n / at_risk AS hazard, greatest((ends - n + 0.5) / exposure, (ends2 - n + 0.5) / exposure2) * at_risk AS expected FROM hd JOIN o USING (source, measure, bin) JOIN d USING (source, measure, depth) WHERE n > 1 AND (measure IN ('chars', 'bytes') OR length = 0)),
    t AS (SELECT *, CASE WHEN n <= expected THEN 1.0 ELSE least(1.0, list_sum(list_transform(range(400), lambda i: exp((n + i) * ln(greatest(expected, 1e-12)) - greatest(expected, 1e-12) - lgamma(n + i + 1))))) END AS p FROM x),
    k AS (SELECT *, least(floor(-log2(greatest(p, 1e-300)) * 4), 4000) AS k FROM t),
    f AS (SELECT k, sum(count(*)) OVER (ORDER BY k DESC) AS passed, (SELECT count(*) FROM h) AS tests FROM k GROUP BY k)
    SELECT source, measure, CAST(length AS BIGINT) AS length, n, at_risk, round(hazard, 6) AS hazard, round(expected, 6) AS expected, round(log10(greatest(p, 1e-300)), 3) AS log10_p FROM k
    WHERE p <= (SELECT max(2.0 ** (-k / 4)) FROM f WHERE 2.0 ** (-k / 4) * tests <= 0.001 * passed)"""
SQL: dict[str, str] = {
    "p3_cutoffs": _CUTOFFS,
    "p3_batches": _CUTOFFS,
    "p3_found": _MONTHS + "SELECT month_id, sid FROM kept",
    "p4_top": _TOP,
    "p4_found": f"SELECT sid, score_id FROM ({_TOP})",
    "p8_limits": _LIMITS,
}
