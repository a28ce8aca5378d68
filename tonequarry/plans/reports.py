"""Queries on predicates, look-ups and report text, bound to the tables at hand, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tonequarry.functions.stats import joined, median_mad, medians_by
from tonequarry.operators import predicates as P
from tonequarry.operators import spectral
from tonequarry.plans import media
from tonequarry.plans.media import table
from tonequarry.sources import reports as W

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


@query("SELECT p_partkey FROM part WHERE NOT regexp_full_match(p_name, '(?i)[a-z]+[ _#-].*[02468]')")
def p04_off_convention(spark, sf_dir):
    return P.off_convention(table(spark, sf_dir, "part"), F.col("p_name"), r"[a-z]+[ _#-].*[02468]").select("p_partkey")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority WHEN o_orderkey % 3 = 1 THEN 'C' || o_custkey ELSE o_orderstatus END AS case_id FROM orders")
def p05_case_ids(spark, sf_dir):
    key = F.col("o_orderkey") % 3
    name = F.when(key == 1, F.concat(F.lit("take_C"), F.col("o_custkey").cast("string"), F.lit("_r01"))).otherwise("take")
    return table(spark, sf_dir, "orders").select("o_orderkey", P.case_id(F.when(key == 0, F.col("o_orderpriority")).when(key == 1, ""), name, r"_(C\d+)_", F.col("o_orderstatus")).alias("case_id"))


@query("SELECT event_id FROM events WHERE value >= 0.8 AND value <= 12")
def p10_voice_candidates(spark, sf_dir):
    return P.voice_candidates(table(spark, sf_dir, "events"), "value").select("event_id")


@query("SELECT event_id FROM events WHERE event_type NOT IN ('click', 'view')")
def p13_steps(spark, sf_dir):
    return P.select_steps(table(spark, sf_dir, "events"), ["click", "view"], "event_type").select("event_id")


@query("SELECT p_partkey, contains(lower(p_type), 'brass') OR contains(lower(p_type), 'steel') AS marked FROM part")
def p18_markers(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", P.has_marker(F.col("p_type"), ["BRASS", "steel"]).alias("marked"))


@query("SELECT user_id, arg_min(event_id, event_id) AS event_id FROM events WHERE value > 10 GROUP BY 1")
def p19_first_items(spark, sf_dir):
    return P.first_item(table(spark, sf_dir, "events").select("user_id", "event_id", "value"), ["user_id"], F.col("value") > 10, "event_id").select("user_id", "event_id")


@query("""SELECT o_orderkey, CASE WHEN starts_with(o_orderpriority, '1-') THEN 'first' WHEN starts_with(o_orderpriority, '5') THEN 'last' ELSE 'other' END || '/raw_' || o_orderpriority || '_' || o_orderstatus || '_r' || CASE WHEN o_custkey < 10 THEN '0' ELSE '' END || o_custkey || '.wav' AS path FROM orders""")
def p21_archive_paths(spark, sf_dir):
    case = F.col("o_orderpriority")
    name = P.clip_name(case, F.col("o_orderstatus"), F.col("o_custkey"), F.lit(".wav"))
    return table(spark, sf_dir, "orders").select("o_orderkey", P.archive_path(case, {"1-": "first", "5": "last"}, "other", name).alias("path"))


@query("SELECT user_id, CASE WHEN count(*) > 20 THEN 'listed 20 of ' || count(*) END AS note FROM events GROUP BY 1")
def p22_truncation(spark, sf_dir):
    n = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("n"))
    return n.select("user_id", P.truncation_note(F.least("n", F.lit(20)), F.col("n")).alias("note"))


@query("SELECT p_partkey, abs(p_size - 25) <= 2 AS covers FROM part")
def p23_covers_screen(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", P.covers_screen(F.col("p_size"), F.lit(10), F.lit(25), F.lit(11)).alias("covers"))


@query("""WITH b AS (SELECT user_id, count(*) AS n, list_sort(list(value))[count(*) // 2 + 1] AS med, max(value) AS amp FROM events GROUP BY 1) SELECT user_id, CASE WHEN n BETWEEN 3 AND 60 AND med BETWEEN 0.4 AND 20.0 THEN amp ELSE 0.0 END AS score FROM b""")
def p24_band_score(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    b = joined(e.groupBy("user_id").agg(F.count("*").alias("n"), F.max("value").alias("amp")), medians_by(e, ["user_id"], "value", "med", upper=True), ["user_id"], "left")
    return b.select("user_id", spectral.band_score(F.col("n"), F.col("med"), F.col("amp")).alias("score"))


@query("""WITH m AS (SELECT user_id, count(value) AS n, median(value) AS med FROM events GROUP BY 1) SELECT user_id, any_value(n) AS n, CAST(round(any_value(med) * 10000) AS BIGINT) AS median, CAST(round(median(abs(value - med)) * 10000) AS BIGINT) AS mad FROM events JOIN m USING (user_id) GROUP BY 1""")
def g08_median_mad(spark, sf_dir):
    s = median_mad(table(spark, sf_dir, "events"), ["user_id"], "value")
    whole = lambda c: F.round(F.col(c) * 10000).cast("long").alias(c)
    return s.select("user_id", "n", whole("median"), whole("mad"))


_FOUND = "SELECT '| ' || path || ' | ' || \"check\" || ' | ' || severity || ' |' AS line"


@query(f"{_FOUND} FROM ({media.SQL['p14_defects']}) UNION ALL SELECT unnest(['## Findings', '', '| path | check | severity |', '|---|---|---|'])")
def k02_findings_markdown(spark, sf_dir):
    return W.markdown_table(media.p14_defects(spark, sf_dir), "Findings", ["path", "check", "severity"], ["path", "check"])


@query(f"SELECT '| ' || added || ' | ' || removed || ' | ' || changed || ' | ' || regressions || ' |' AS line FROM ({media.SQL['j01_compare_summary']}) UNION ALL SELECT unnest(['## Comparison', '', '| added | removed | changed | regressions |', '|---|---|---|---|'])")
def k03_compare_markdown(spark, sf_dir):
    return W.markdown_table(media.j01_compare_summary(spark, sf_dir), "Comparison", ["added", "removed", "changed", "regressions"], ["added"])


@query("""WITH s AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k, event_id FROM events) SELECT user_id, 'D-' || CASE WHEN k < 10 THEN '0' ELSE '' END || k AS idx, '' AS speech_start, '' AS speech_end, event_id || '.000' AS subtitle_start, event_id || '.500' AS subtitle_end FROM s""")
def k04_ground_truth(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", F.col("event_id").cast("double").alias("start"), (F.col("event_id") + 0.5).alias("end"))
    return W.ground_truth(e, ["user_id"])


@query("""SELECT event_id, greatest(0.0, value - 0.5) AS clip_start, value + 2.0 + 0.5 - greatest(0.0, value - 0.5) AS clip_length FROM events""")
def k05_evidence_plan(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", F.col("value").alias("start"), (F.col("value") + 2.0).alias("end"))
    return W.evidence_plan(e).select("event_id", "clip_start", "clip_length")
