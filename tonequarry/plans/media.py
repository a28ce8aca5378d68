"""Queries on signals and libraries, bound to the tables at hand, each with its SQL.

Embeddings serve as signals of 64 whole-numbered samples, documents as files, parts as a library with
formats and loudness, line items as two scans to compare.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tonequarry.functions import stats
from tonequarry.functions import text as X
from tonequarry.operators import chunks as K
from tonequarry.operators import intervals as I
from tonequarry.operators import library as L
from tonequarry.operators import rules as R
from tonequarry.operators import sequences as Q
from tonequarry.operators import signals as S
from tonequarry.operators import spectral
from tonequarry.operators import takes as T
from tonequarry.sources.shared import stored

QUERIES: dict = {}
SQL: dict[str, str] = {}

FULL_SCALE, LSB, FLOOR, WINDOW, RATE = 20, 1, 2, 4, 400
CFG = R.Thresholds(clip_min_run=2, dc_offset_max=0.02, silence_floor_dbfs=-20.0, head_silence_max_ms=5.0, tail_silence_max_ms=5.0, loop_step_ratio_max=0.5, silence_window_ms=10.0, dropout_min_ms=10.0)


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """path, sample_rate, full_scale, lsb, chans: samples are hundredths, held at the rails."""
    e = table(spark, sf_dir, "embeddings")
    chan = F.transform("embedding", lambda v: F.greatest(F.lit(-FULL_SCALE), F.least(F.lit(FULL_SCALE - LSB), F.floor(v.cast("double") * 100))).cast("long"))
    name = F.concat(F.when(F.col("vec_id") % 3 == 0, "amb_loop_").otherwise("sfx_hit_"), F.col("vec_id").cast("string"), F.lit(".wav"))
    return e.select("vec_id", name.alias("path"), F.lit(RATE).alias("sample_rate"), F.lit(FULL_SCALE).alias("full_scale"), F.lit(LSB).alias("lsb"), F.array(chan).alias("chans"))


def _one(spark, sf_dir):
    return signals(spark, sf_dir).withColumn("c", F.get("chans", F.lit(0)))


_SIG = f"""sig AS (SELECT vec_id, CASE WHEN vec_id % 3 = 0 THEN 'amb_loop_' ELSE 'sfx_hit_' END || vec_id || '.wav' AS path,
  list_transform(embedding, lambda v: CAST(greatest(-{FULL_SCALE}, least({FULL_SCALE - LSB}, floor(CAST(v AS DOUBLE) * 100))) AS BIGINT)) AS c FROM embeddings),
smp AS (SELECT vec_id, path, i - 1 AS p, c[i] AS v, len(c) AS n FROM sig, unnest(generate_series(1, len(c))) AS t(i))"""


@query(f"WITH {_SIG} SELECT vec_id, max(abs(v)) AS peak FROM smp GROUP BY vec_id")
def a01_channel_peak(spark, sf_dir):
    return _one(spark, sf_dir).select("vec_id", S.channel_peak(F.col("c")).alias("peak"))


@query(f"WITH {_SIG} SELECT vec_id, CASE WHEN max(abs(v)) > 0 THEN CAST(round(20 * log10(max(abs(v)) / {FULL_SCALE}.0) * 1000000) AS BIGINT) END AS micro_dbfs FROM smp GROUP BY vec_id")
def a02_peak_dbfs(spark, sf_dir):
    db = S.to_dbfs(S.channel_peak(F.col("c")), F.col("full_scale"))
    return _one(spark, sf_dir).select("vec_id", F.round(db * 1000000).cast("long").alias("micro_dbfs"))


@query(f"WITH {_SIG} SELECT vec_id, CAST(round(sum(v)::DOUBLE / count(*) / {FULL_SCALE} * 1000000) AS BIGINT) AS micro_dc FROM smp GROUP BY vec_id")
def a03_dc_offset(spark, sf_dir):
    return _one(spark, sf_dir).select("vec_id", F.round(S.dc_offset(F.col("c"), F.col("full_scale")) * 1000000).cast("long").alias("micro_dc"))


_RAIL = f"(v IN ({FULL_SCALE - LSB}, {LSB - FULL_SCALE}, {-FULL_SCALE}))"
_CLIP = f"""rail AS (SELECT vec_id, p, p - row_number() OVER (PARTITION BY vec_id ORDER BY p) AS g FROM smp WHERE {_RAIL}),
runs AS (SELECT vec_id, min(p) AS start, count(*) AS length FROM rail GROUP BY vec_id, g)"""


@query(f"WITH {_SIG}, {_CLIP} SELECT vec_id, start, length FROM runs WHERE length >= 2")
def a04_clip_runs(spark, sf_dir):
    runs = S.full_scale_runs(F.col("c"), F.col("full_scale"), F.col("lsb"), 2)["runs"]
    return _one(spark, sf_dir).select("vec_id", F.inline(runs)).select("vec_id", F.col("start").cast("long"), F.col("length").cast("long"))


_EDGE = f"""pk AS (SELECT vec_id, n, p // {WINDOW} AS w, max(abs(v)) AS m FROM smp GROUP BY ALL),
tk AS (SELECT vec_id, n, (n - 1 - p) // {WINDOW} AS w, max(abs(v)) AS m FROM smp GROUP BY ALL),
hd AS (SELECT vec_id, least(coalesce(min(w) FILTER (m > {FLOOR}) * {WINDOW}, any_value(n)), any_value(n)) AS head FROM pk GROUP BY vec_id),
tl AS (SELECT vec_id, coalesce(least(min(w) FILTER (m > {FLOOR}) * {WINDOW}, any_value(n)), 0) AS tail FROM tk GROUP BY vec_id)"""


@query(f"WITH {_SIG}, {_EDGE} SELECT vec_id, CAST(head AS BIGINT) AS head, CAST(tail AS BIGINT) AS tail FROM hd JOIN tl USING (vec_id)")
def a05_edge_silence(spark, sf_dir):
    head, tail = (f(F.col("c"), F.lit(FLOOR), F.lit(WINDOW)).cast("long") for f in (S.head_silence, S.tail_silence))
    return _one(spark, sf_dir).select("vec_id", head.alias("head"), tail.alias("tail"))


_GAPS = f"""pw AS (SELECT vec_id, p // 2 AS w, max(abs(v)) AS m FROM smp GROUP BY ALL),
gq AS (SELECT vec_id, w, w - row_number() OVER (PARTITION BY vec_id ORDER BY w) AS g FROM pw WHERE m <= 8),
gi AS (SELECT vec_id, min(w) AS w0, count(*) AS k FROM gq GROUP BY vec_id, g),
gaps AS (SELECT gi.vec_id, w0 * 2 AS start, k * 2 AS length FROM gi WHERE k * 2 >= 4 AND w0 > 0 AND w0 + k < 32)"""


@query(f"WITH {_SIG}, {_GAPS} SELECT vec_id, CAST(start AS BIGINT) AS start, CAST(length AS BIGINT) AS length FROM gaps")
def a06_silence_gaps(spark, sf_dir):
    gaps = S.silence_gaps(F.col("chans"), F.lit(8), F.lit(2), F.lit(4))
    return _one(spark, sf_dir).select("vec_id", F.inline(gaps)).select("vec_id", F.col("start").cast("long"), F.col("length").cast("long"))


@query(f"WITH {_SIG} SELECT vec_id, CAST(any_value(n) - 1 - coalesce(max(p) FILTER (abs(v) > 3), -1) AS BIGINT) AS n_zeros FROM smp GROUP BY vec_id")
def a07_trailing_zeros(spark, sf_dir):
    quiet = F.transform("chans", lambda c: F.transform(c, lambda v: F.when(F.abs(v) > 3, v).otherwise(F.lit(0))))
    return signals(spark, sf_dir).select("vec_id", S.trailing_zeros(quiet).cast("long").alias("n_zeros"))


@query(f"""WITH {_SIG}, d AS (SELECT vec_id, abs(v - lag(v) OVER (PARTITION BY vec_id ORDER BY p)) AS d FROM smp),
s AS (SELECT vec_id, list_sort(list(d) FILTER (d IS NOT NULL)) AS ds FROM d GROUP BY vec_id)
SELECT vec_id, abs(c[1] - c[len(c)]) AS step, ds[CAST(round_even(0.99 * (len(ds) - 1), 0) AS INT) + 1] AS slope FROM sig JOIN s USING (vec_id)""")
def a08_loop_seam(spark, sf_dir):
    one = F.lit(1)
    return _one(spark, sf_dir).select("vec_id", S.loop_step(F.col("c"), one).cast("long").alias("step"), S.slope_p99(F.col("c"), one).cast("long").alias("slope"))


@query("""WITH l AS (SELECT user_id, list_sort(list(value)) AS v FROM events GROUP BY user_id)
SELECT user_id, v[CAST(round_even(0.9 * (len(v) - 1), 0) AS INT) + 1] AS p90, v[least(CAST(floor(0.95 * len(v)) AS INT), len(v) - 1) + 1] AS p95_floor,
v[len(v) // 2 + 1] AS upper_median FROM l""")
def a09_percentiles(spark, sf_dir):
    n = F.col("n")
    ranks = {"p90": (0.9, F.bround(0.9 * (n - 1), 0)), "p95_floor": (0.95, F.least(F.floor(0.95 * n), n - 1)), "upper_median": (0.5, F.floor(n / 2))}
    return stats.ranks_by(table(spark, sf_dir, "events"), ["user_id"], "value", ranks).drop("n")


@query(f"WITH {_SIG} SELECT vec_id, (vec_id % 2 = 0 OR c = list_reverse(c)) AS same FROM sig")
def a10_equal_channels(spark, sf_dir):
    second = F.when(F.col("vec_id") % 2 == 0, F.col("c")).otherwise(F.reverse("c"))
    return _one(spark, sf_dir).select("vec_id", S.equal_channels(F.array("c", second)).alias("same"))


@query(f"WITH {_SIG} SELECT vec_id, abs(c[1]) AS onset FROM sig")
def a11_loop_onset(spark, sf_dir):
    return signals(spark, sf_dir).select("vec_id", S.loop_onset(F.col("chans"), F.lit(1)).cast("long").alias("onset"))


@query(f"WITH {_SIG} SELECT vec_id, CAST(k AS BIGINT) AS frame, list_sum(c[k * 8 + 1 : k * 8 + 16]) AS total FROM sig, unnest(generate_series(0, (len(c) - 16) // 8)) AS t(k)")
def a12_framing(spark, sf_dir):
    f = S.frames_of(F.col("c"), 16, 8)
    return _one(spark, sf_dir).select("vec_id", F.posexplode(f).alias("frame", "s")).select("vec_id", F.col("frame").cast("long"), F.aggregate("s", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))


@query("SELECT doc_id, sha256(text) AS hash, count(*) OVER (PARTITION BY text) AS n_same FROM documents")
def a18_content_hash(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("hash"))
    return d.join(d.groupBy("hash").agg(F.count("*").alias("n_same")), "hash").select("doc_id", "hash", "n_same")


def _judged(spark, sf_dir):
    return R.judge(R.measure(signals(spark, sf_dir), CFG), CFG)


_GAP4 = f"""pq AS (SELECT vec_id, p // {WINDOW} AS w, max(abs(v)) AS m FROM smp GROUP BY ALL),
hq AS (SELECT vec_id, w, w - row_number() OVER (PARTITION BY vec_id ORDER BY w) AS g FROM pq WHERE m <= {FLOOR}),
hi AS (SELECT vec_id, min(w) AS w0, count(*) AS k FROM hq GROUP BY vec_id, g),
gp AS (SELECT vec_id, count(*) AS n_gaps FROM hi WHERE w0 > 0 AND w0 + k < 16 GROUP BY vec_id)"""
_RULES = f"""WITH {_SIG}, {_CLIP}, {_EDGE}, {_GAP4}, d AS (SELECT vec_id, abs(v - lag(v) OVER (PARTITION BY vec_id ORDER BY p)) AS d FROM smp),
s AS (SELECT vec_id, list_sort(list(d) FILTER (d IS NOT NULL)) AS ds FROM d GROUP BY vec_id),
b AS (SELECT vec_id, any_value(path) AS path, max(abs(v)) AS peak, abs(sum(v)::DOUBLE / count(*) / {FULL_SCALE}) AS dc, count(*) FILTER {_RAIL.join(["(WHERE ", ")"])} AS n_rail,
  any_value(n) - 1 - coalesce(max(p) FILTER (WHERE v <> 0), -1) AS zeros FROM smp GROUP BY vec_id),
r AS (SELECT vec_id, count(*) AS n_runs FROM runs WHERE length >= 2 GROUP BY vec_id),
m AS (SELECT b.*, coalesce(n_runs, 0) AS n_runs, head * 1000.0 / {RATE} AS head_ms, tail * 1000.0 / {RATE} AS tail_ms, zeros * 1000.0 / {RATE} AS zero_ms, coalesce(n_gaps, 0) AS n_gaps,
  abs(c[1] - c[len(c)]) / {FULL_SCALE}.0 AS step, ds[CAST(round_even(0.99 * (len(ds) - 1), 0) AS INT) + 1] / {FULL_SCALE}.0 AS slope, abs(c[1]) / {FULL_SCALE}.0 AS onset, b.vec_id % 3 = 0 AS is_loop
  FROM b JOIN sig USING (vec_id) JOIN s USING (vec_id) JOIN hd USING (vec_id) JOIN tl USING (vec_id) LEFT JOIN r USING (vec_id) LEFT JOIN gp USING (vec_id)),
q AS (SELECT *, CASE WHEN slope > 1e-9 THEN step / slope ELSE 0 END AS ratio FROM m),
z AS (SELECT *, step > 0.01 AND ratio > 0.5 AS seam FROM q),
f AS (SELECT path, 'silent_file' AS "check", 'FAIL' AS severity FROM z WHERE peak <= {FLOOR}
 UNION ALL SELECT path, 'clipping', 'FAIL' FROM z WHERE peak > {FLOOR} AND n_runs > 0
 UNION ALL SELECT path, 'clipping', 'WARN' FROM z WHERE peak > {FLOOR} AND n_runs = 0 AND n_rail > 0
 UNION ALL SELECT path, 'dc_offset', 'FAIL' FROM z WHERE peak > {FLOOR} AND dc > 0.02
 UNION ALL SELECT path, 'head_silence', 'FAIL' FROM z WHERE peak > {FLOOR} AND head_ms > 5
 UNION ALL SELECT path, 'tail_silence', 'WARN' FROM z WHERE peak > {FLOOR} AND zero_ms > 5
 UNION ALL SELECT path, 'tail_decay', 'INFO' FROM z WHERE peak > {FLOOR} AND NOT zero_ms > 5 AND tail_ms > 5
 UNION ALL SELECT path, 'silence_gap', 'WARN' FROM z WHERE peak > {FLOOR} AND n_gaps > 0
 UNION ALL SELECT path, 'loop_discontinuity', CASE WHEN is_loop THEN 'FAIL' ELSE 'INFO' END FROM z WHERE peak > {FLOOR} AND seam
 UNION ALL SELECT path, 'loop_onset', 'WARN' FROM z WHERE peak > {FLOOR} AND NOT seam AND is_loop AND onset > 0.05)"""
_STATUS = """, st AS (SELECT z.path, coalesce(max(CASE severity WHEN 'INFO' THEN 1 WHEN 'WARN' THEN 2 WHEN 'FAIL' THEN 3 END), 0) AS k FROM z LEFT JOIN f ON z.path = f.path GROUP BY z.path)"""


# --- the same in chunks of seven frames ---------------------------------------------


def _chunks(spark, sf_dir):
    return K.split(signals(spark, sf_dir).drop("path"), 7, "vec_id")


def _summaries(chunks, floor=FLOOR, window=WINDOW, gap=1, **more):
    return K.summarize(chunks, F.lit(floor), F.lit(window), F.lit(gap), 2, **more)


@query(SQL["a04_clip_runs"])
def s02_chunked_clip_runs(spark, sf_dir):
    return K.clip_runs(_summaries(_chunks(spark, sf_dir)), 2, "vec_id").drop("channel")


@query(SQL["a05_edge_silence"])
def s02_chunked_edges(spark, sf_dir):
    return K.edge_silence(_summaries(_chunks(spark, sf_dir)), "vec_id").drop("channel")


@query(SQL["a06_silence_gaps"])
def s02_chunked_gaps(spark, sf_dir):
    return K.silence_gaps(_summaries(_chunks(spark, sf_dir), 8, 2, 4), "vec_id")


@query(SQL["a07_trailing_zeros"])
def s02_chunked_zeros(spark, sf_dir):
    return K.trailing_zeros(_summaries(_chunks(spark, sf_dir), sound=3), "vec_id")


@query(SQL["a08_loop_seam"])
def s02_chunked_seams(spark, sf_dir):
    chunks = _chunks(spark, sf_dir)
    return K.loop_seams(chunks, _summaries(chunks), "vec_id").select("vec_id", "step", F.col("slope").cast("long").alias("slope"))


@query(f'{_RULES} SELECT path, "check", severity FROM f')
def s02_chunked_findings(spark, sf_dir):
    return R.findings_of(R.judge(K.measure(K.split(signals(spark, sf_dir), 7), CFG), CFG)).select("path", "check", "severity")


@query(f'{_RULES} SELECT path, "check", severity FROM f')
def r01_findings(spark, sf_dir):
    return R.findings_of(_judged(spark, sf_dir)).select("path", "check", "severity")


@query(f"{_RULES}{_STATUS} SELECT path, ['PASS', 'INFO', 'WARN', 'FAIL'][k + 1] AS status FROM st")
def g01_file_status(spark, sf_dir):
    return _judged(spark, sf_dir).select("path", "status")


@query(f'{_RULES}{_STATUS} SELECT count(*) AS total, count(*) FILTER (k = 0) AS "pass", count(*) FILTER (k = 1) AS info, count(*) FILTER (k = 2) AS warn, count(*) FILTER (k = 3) AS fail FROM st')
def g02_summary(spark, sf_dir):
    return R.summarize(_judged(spark, sf_dir))


@query(f"""{_RULES}{_STATUS} SELECT f.path, "check", severity FROM f JOIN st ON f.path = st.path WHERE k >= 2 AND severity IN ('WARN', 'FAIL')""")
def p14_defects(spark, sf_dir):
    return R.findings_of(R.defects(_judged(spark, sf_dir))).select("path", "check", "severity")


@query(f"""{_RULES}{_STATUS} SELECT f.path, severity AS status, "check" FROM f JOIN st ON f.path = st.path WHERE severity = ['PASS', 'INFO', 'WARN', 'FAIL'][k + 1]""")
def p15_same_severity(spark, sf_dir):
    return R.same_severity(_judged(spark, sf_dir)).select("path", "status", "check")


@query("""SELECT p_partkey, CASE WHEN p_retailprice / 500 - 3 > 0 THEN 'true_peak_overshoot' WHEN p_retailprice / 500 - 3 > -1 THEN 'true_peak_headroom' END AS finding, p_retailprice / 500 - 3 > -0.5 AS over_limit FROM part""")
def r17_true_peak(spark, sf_dir):
    """Both modes of the true-peak rules on the same peaks."""
    p = table(spark, sf_dir, "part").withColumn("tp", F.col("p_retailprice") / 500 - 3)
    sig = p.select("p_partkey", F.col("p_name").alias("path"), F.lit(8).alias("sample_rate"), F.lit(FULL_SCALE).alias("full_scale"), F.lit(1).alias("lsb"), F.array(F.array(*[F.lit(x).cast("long") for x in (5, -5) * 4])).alias("chans"), F.col("tp").alias("true_peak_dbtp"))
    own = lambda f: F.startswith(f["check"], F.lit("true_peak"))
    m = R.judge(R.measure(sig), R.Thresholds()).withColumn("finding", F.get(F.filter("findings", own), F.lit(0))["check"]).drop("findings", "status")
    m = R.judge(m, R.Thresholds(true_peak_max_dbtp=-0.5))
    return m.select("p_partkey", "finding", (F.size(F.filter("findings", own)) > 0).alias("over_limit"))


# --- libraries ---------------------------------------------------------------


def _part_files(spark, sf_dir):
    """Parts as files: the size is the sample rate, the brand's digit the channels, the price the loudness."""
    p = table(spark, sf_dir, "part")
    return p.select(
        F.format_string("%s/%08d.wav", F.col("p_type"), F.col("p_partkey")).alias("path"), F.col("p_size").alias("sample_rate"), F.lit(16).alias("bit_depth"), (F.col("p_partkey") % 2 + 1).cast("int").alias("channels"),
        (180 - F.col("p_retailprice") / 4).alias("lufs"), F.lit(None).cast("string").alias("error"), (F.col("p_partkey") % 10).alias("frames"), "p_type", "p_brand", "p_partkey",
    )


_PART = """pf AS (SELECT p_type || '/' || lpad(CAST(p_partkey AS VARCHAR), 8, '0') || '.wav' AS path, p_size AS sample_rate, 16 AS bit_depth, CAST(p_partkey % 2 + 1 AS INT) AS channels, 180 - p_retailprice / 4 AS lufs, p_partkey % 10 AS frames, p_type, p_brand, p_partkey FROM part)"""


@query(f"WITH {_PART} SELECT path FROM pf WHERE frames > 0")
def p03_usable(spark, sf_dir):
    return L.usable(_part_files(spark, sf_dir)).select("path")


@query(f"WITH {_PART} SELECT sample_rate, bit_depth, channels, count(*) AS n_files, min(path) AS first_path FROM pf GROUP BY ALL")
def g03_formats(spark, sf_dir):
    return L.formats(_part_files(spark, sf_dir))


@query(f"WITH {_PART}, c AS (SELECT p_brand, sample_rate, count(*) AS n, min(path) AS f FROM pf GROUP BY ALL) SELECT p_brand, sample_rate AS dominant_sample_rate FROM c QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY n DESC, f) = 1")
def g04_dominant_rate(spark, sf_dir):
    return L.dominant(_part_files(spark, sf_dir), "sample_rate", "path", ["p_brand"])


@query(f"WITH {_PART}, d AS (SELECT sample_rate AS dom FROM pf GROUP BY 1 ORDER BY count(*) DESC, min(path) LIMIT 1) SELECT path, sample_rate, dom AS dominant_sample_rate, CASE WHEN sample_rate > dom THEN 'WARN' ELSE 'INFO' END AS severity FROM pf, d WHERE sample_rate <> dom")
def r20_format_outliers(spark, sf_dir):
    return L.format_outliers(_part_files(spark, sf_dir))


def _doc_files(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    name = F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit("Loop_A#3_"), F.col("lang"))).when(F.col("doc_id") % 4 == 1, F.concat(F.lit("Loop_Bb3_"), F.col("lang"))).otherwise(F.concat(F.lit("take_"), F.col("doc_id").cast("string")))
    return d.select(F.concat_ws("/", "source", F.format_string("%07d", "doc_id"), F.concat(name, F.lit(".wav"))).alias("path"), F.col("n_chars").alias("size_bytes"), F.sha2("text", 256).alias("file_sha256"), F.sha2(F.lower("text"), 256).alias("content_sha256"), "doc_id", "lang")


_DOCS = """df AS (SELECT source || '/' || lpad(CAST(doc_id AS VARCHAR), 7, '0') || '/' || CASE doc_id % 4 WHEN 0 THEN 'Loop_A#3_' || lang WHEN 1 THEN 'Loop_Bb3_' || lang ELSE 'take_' || doc_id END || '.wav' AS path,
  CASE doc_id % 4 WHEN 0 THEN 'loop_note46_' || lang WHEN 1 THEN 'loop_note46_' || lang ELSE 'take_' || doc_id END AS canon,
  CASE doc_id % 4 WHEN 0 THEN 'Loop_A#3_' || lang WHEN 1 THEN 'Loop_Bb3_' || lang ELSE 'take_' || doc_id END AS nm, source || '/' || doc_id AS dir,
  n_chars AS size_bytes, sha256(text) AS file_sha256, sha256(lower(text)) AS content_sha256 FROM documents),
g0 AS (SELECT 'file' AS "by", file_sha256 AS hash, * FROM df UNION ALL SELECT 'content', content_sha256, * FROM df),
g1 AS (SELECT "by", hash, count(*) AS n_files, min(path) AS keeper, count(DISTINCT nm) = 1 AS one_name, count(DISTINCT dir) = 1 AS one_dir, count(DISTINCT canon) = 1 AS one_canonical, sum(size_bytes) - arg_min(size_bytes, path) AS rest, list_sort(list(path)) AS ps FROM g0 GROUP BY ALL HAVING count(*) > 1),
g2 AS (SELECT *, CASE WHEN one_name AND NOT one_dir THEN 'redundant_copy' WHEN one_canonical THEN 'equivalent_naming' ELSE 'duplicate_asset' END AS kind FROM g1 WHERE "by" = 'file' OR ps NOT IN (SELECT ps FROM g1 WHERE "by" = 'file')),
dg AS (SELECT "by", hash, n_files, keeper, one_name, one_dir, one_canonical, kind, CASE kind WHEN 'equivalent_naming' THEN 'INFO' ELSE 'WARN' END AS severity, CAST(CASE kind WHEN 'redundant_copy' THEN rest ELSE 0 END AS BIGINT) AS recoverable_bytes FROM g2)"""


@query(f"WITH {_DOCS} SELECT * FROM dg")
def g05_duplicate_groups(spark, sf_dir):
    return L.duplicate_groups(_doc_files(spark, sf_dir))


@query(f"""WITH {_DOCS} SELECT path, kind AS "check", severity, keeper AS duplicate_of, "by" = 'file' AS identical_bytes FROM df JOIN dg ON ("by" = 'file' AND dg.hash = df.file_sha256 OR "by" = 'content' AND dg.hash = df.content_sha256) WHERE path <> keeper""")
def r21_duplicates(spark, sf_dir):
    f = _doc_files(spark, sf_dir)
    return L.duplicate_findings(f, L.duplicate_groups(f))


@query(f"WITH {_DOCS} SELECT kind, count(*) AS n_groups, CAST(sum(recoverable_bytes) AS BIGINT) AS recoverable FROM dg GROUP BY kind")
def g07_recoverable(spark, sf_dir):
    return L.duplicate_groups(_doc_files(spark, sf_dir)).groupBy("kind").agg(F.count("*").alias("n_groups"), F.sum("recoverable_bytes").cast("long").alias("recoverable"))


_LOUD = f"""{_PART}, lo AS (SELECT * FROM pf WHERE lufs > -69), gm AS (SELECT p_type AS category, count(*) AS n_files, median(lufs) AS basis, mad(lufs) AS mad FROM lo GROUP BY 1),
lg AS (SELECT category, n_files, n_files >= 5 AS evaluated, CASE WHEN n_files >= 5 THEN basis END AS basis, CASE WHEN n_files >= 5 THEN mad END AS mad, CASE WHEN n_files >= 5 THEN greatest(2.0, 0.5 * mad) END AS tolerance FROM gm)"""
_LOUD_CFG = R.Thresholds(lufs_spread_k=0.5)


@query(f"WITH {_LOUD} SELECT category, n_files, evaluated, CAST(round(basis * 1000000) AS BIGINT) AS basis, CAST(round(mad * 1000000) AS BIGINT) AS mad, CAST(round(tolerance * 1000000) AS BIGINT) AS tolerance FROM lg")
def g10_loudness_groups(spark, sf_dir):
    g = L.loudness_groups(_part_files(spark, sf_dir), _LOUD_CFG, F.col("p_type"))
    return g.select("category", "n_files", "evaluated", *[F.round(F.col(c) * 1000000).cast("long").alias(c) for c in ("basis", "mad", "tolerance")])


@query(f"WITH {_LOUD} SELECT path, p_type AS category, lufs FROM lo JOIN lg ON p_type = category WHERE evaluated AND abs(lufs - basis) > tolerance")
def r22_loudness_outliers(spark, sf_dir):
    f, by = _part_files(spark, sf_dir), F.col("p_type")
    return L.loudness_outliers(f, L.loudness_groups(f, _LOUD_CFG, by), _LOUD_CFG, by).select("path", "category", "lufs")


@query(f"WITH {_PART} SELECT path, lufs FROM pf WHERE lufs > -69 AND abs(lufs - -55.0) > 2.0")
def g10_explicit_target(spark, sf_dir):
    cfg, f = R.Thresholds(lufs_target=-55.0), _part_files(spark, sf_dir)
    return L.loudness_outliers(f, L.loudness_groups(f, cfg), cfg).select("path", "lufs")


@query(f"WITH {_PART} SELECT path, lufs <= -56 AS below FROM pf")
def p09_gate(spark, sf_dir):
    f, cfg = _part_files(spark, sf_dir), R.Thresholds(lufs_gate_floor=-56.0)
    low = L.below_gate(f, cfg).select("path", F.lit(True).alias("below"))
    return low.union(f.filter(F.col("lufs") > cfg.lufs_gate_floor).select("path", F.lit(False)))


def _scan(spark, sf_dir, flag):
    """A scan of the parts shipped with one return flag."""
    g = table(spark, sf_dir, "lineitem").filter(F.col("l_returnflag") == flag).groupBy("l_partkey").agg(F.count("*").alias("n"), F.max("l_quantity").alias("q"), F.min("l_discount").alias("d"), F.max("l_linenumber").alias("ln"))
    none = F.lit(None).cast("double")
    return g.select(F.format_string("p%d", "l_partkey").alias("path"), F.when(F.col("n") % 3 > 0, F.concat_ws("-", "n", "q")).otherwise("").alias("content_sha256"), (F.col("n") % 2).alias("sample_rate"), F.when(F.col("n") % 5 > 0, F.lit(16)).alias("bit_depth"), F.lit(2).alias("channels"), F.col("q").alias("duration_s"), F.when(F.col("n") > 2, F.col("q") / 10).alias("peak_dbfs"), (F.col("d") * 10).alias("lufs"), none.alias("true_peak_dbtp"), F.array_compact(F.array(F.when(F.col("ln") > 5, "clipping"), F.when(F.col("d") > 0.02, "dc_offset"))).alias("fails"))


def _scan_sql(flag: str) -> str:
    return f"""(SELECT 'p' || l_partkey AS path, CASE WHEN n % 3 > 0 THEN n || '-' || q ELSE '' END AS ch, n % 2 AS sr, CASE WHEN n % 5 > 0 THEN 16 END AS bd, q AS dur, CASE WHEN n > 2 THEN q / 10 END AS pk, d * 10 AS lufs, ln > 5 AS f1, d > 0.02 AS f2
 FROM (SELECT l_partkey, count(*) AS n, max(l_quantity) AS q, min(l_discount) AS d, max(l_linenumber) AS ln FROM lineitem WHERE l_returnflag = '{flag}' GROUP BY 1))"""


_CMP = f"""WITH b AS {_scan_sql("A")}, a AS {_scan_sql("R")}, j AS (SELECT coalesce(a.path, b.path) AS path, a.path IS NULL AS gone, b.path IS NULL AS new,
 b.ch <> '' AND b.ch = a.ch AS same,
 CAST(a.sr IS DISTINCT FROM b.sr AS INT) + CAST(a.bd IS DISTINCT FROM b.bd AS INT) AS n_notes,
 CAST(coalesce(abs(a.dur - b.dur) > 0.01, false) AS INT) + CAST(coalesce(abs(a.pk - b.pk) > 0.5, false) AS INT) + CAST(coalesce(abs(a.lufs - b.lufs) > 0.5, false) AS INT) AS n_deltas,
 CAST(a.f1 AND NOT b.f1 AS INT) + CAST(a.f2 AND NOT b.f2 AS INT) AS n_new
 FROM a FULL JOIN b ON a.path = b.path),
k AS (SELECT path, CASE WHEN new THEN 'added' WHEN gone THEN 'removed' ELSE 'changed' END AS change, CASE WHEN NOT new AND NOT gone THEN CASE WHEN n_notes + n_deltas + n_new > 0 THEN 'FAIL' ELSE 'INFO' END END AS severity,
 CASE WHEN new OR gone THEN 0 ELSE n_deltas END AS n_deltas, CASE WHEN new OR gone THEN 0 ELSE n_notes END AS n_notes, CASE WHEN new OR gone THEN 0 ELSE n_new END AS n_new FROM j WHERE new OR gone OR NOT same)"""


@query(f"{_CMP} SELECT * FROM k")
def j01_compare(spark, sf_dir):
    d = L.compare(_scan(spark, sf_dir, "A"), _scan(spark, sf_dir, "R"))
    return d.select("path", "change", "severity", F.size("deltas").alias("n_deltas"), F.size("notes").alias("n_notes"), F.size("new_fails").alias("n_new"))


@query(f"{_CMP} SELECT count(*) FILTER (change = 'added') AS added, count(*) FILTER (change = 'removed') AS removed, count(*) FILTER (change = 'changed') AS changed, count(*) FILTER (severity = 'FAIL') AS regressions FROM k")
def j01_compare_summary(spark, sf_dir):
    return L.compare_summary(L.compare(_scan(spark, sf_dir, "A"), _scan(spark, sf_dir, "R")))


@query("""WITH b AS (SELECT l_suppkey AS id, CAST(sum(CAST(round(l_quantity * 100) AS BIGINT)) AS VARCHAR) AS before FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1), a AS (SELECT l_suppkey AS id, CASE WHEN l_suppkey % 7 = 0 THEN 'n/a' ELSE CAST(sum(CAST(round(l_quantity * 100) AS BIGINT)) AS VARCHAR) END AS after FROM lineitem WHERE l_returnflag = 'R' AND l_suppkey % 5 > 0 GROUP BY 1)
SELECT coalesce(a.id, b.id) AS id, before, after, try_cast(after AS DOUBLE) - try_cast(before AS DOUBLE) AS delta FROM a FULL JOIN b ON a.id = b.id""")
def j10_counter_diff(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    q = F.sum(F.round(F.col("l_quantity") * 100).cast("long")).cast("string")
    b = li.filter("l_returnflag = 'A'").groupBy(F.col("l_suppkey").alias("id")).agg(q.alias("v"))
    a = li.filter("l_returnflag = 'R' and l_suppkey % 5 > 0").groupBy(F.col("l_suppkey").alias("id")).agg(F.when(F.first("l_suppkey") % 7 == 0, F.lit("n/a")).otherwise(q).alias("v"))
    return L.counter_diff(b, a, "id", "v")


@query("""SELECT count(*) AS n_differing, count(*) = 0 AS identical FROM (SELECT p_partkey, p_size AS x FROM part) b FULL JOIN (SELECT p_partkey, CASE WHEN p_partkey % 50 = 0 THEN p_size + 1 ELSE p_size END AS y FROM part WHERE p_partkey % 31 > 0) a ON a.p_partkey = b.p_partkey WHERE x IS DISTINCT FROM y OR a.p_partkey IS NULL OR b.p_partkey IS NULL""")
def j14_same_rows(spark, sf_dir):
    b = table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").alias("v"))
    a = b.filter("p_partkey % 31 > 0").withColumn("v", F.when(F.col("p_partkey") % 50 == 0, F.col("v") + 1).otherwise(F.col("v")))
    return L.same_rows(b, a, "p_partkey", "v")


@query("""SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN CASE WHEN c_custkey % 2 = 0 THEN 'edited ' || c_custkey ELSE '' END ELSE c_mktsegment END AS c_mktsegment FROM customer""")
def j11_merge_edits(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    fresh = c.select("c_custkey", F.when(F.col("c_custkey") % 3 == 0, "").otherwise(F.col("c_mktsegment")).alias("c_mktsegment"))
    edited = c.filter("c_custkey % 2 = 0").select("c_custkey", F.concat(F.lit("edited "), F.col("c_custkey").cast("string")).alias("c_mktsegment"))
    return L.merge_edits(fresh, edited, ["c_custkey"], ["c_mktsegment"])


@query("""WITH t AS (SELECT 's' || (doc_id // 3) AS stem, source || '/s' || (doc_id // 3) || CASE doc_id % 3 WHEN 0 THEN '.wav' WHEN 1 THEN '.mkv' ELSE '.mp4' END AS path, doc_id % 3 = 0 AS is_audio FROM documents)
SELECT stem, path, is_audio FROM t QUALIFY row_number() OVER (PARTITION BY stem ORDER BY is_audio, path) = 1""")
def j13_one_per_stem(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    ext = F.element_at(F.array(F.lit(".wav"), F.lit(".mkv"), F.lit(".mp4")), (F.col("doc_id") % 3 + 1).cast("int"))
    f = d.select(F.concat(F.col("source"), F.lit("/s"), F.floor(F.col("doc_id") / 3).cast("string"), ext).alias("path"))
    return L.one_per_stem(f, X.stem(F.col("path")), X.suffix(F.col("path")).isin(".wav", ".flac", ".mp3", ".ogg"))


@query("""WITH s AS (SELECT o_custkey, list_sort(list(DISTINCT o_orderpriority) FILTER (o_orderstatus = 'F')) AS b, list_sort(list(DISTINCT o_orderpriority) FILTER (o_orderstatus = 'O')) AS a FROM orders GROUP BY 1)
SELECT o_custkey, len(list_filter(coalesce(b, []), lambda x: NOT list_contains(coalesce(a, []), x))) AS n_gone, len(list_filter(coalesce(a, []), lambda x: NOT list_contains(coalesce(b, []), x))) AS n_back FROM s""")
def j12_endpoint_changes(spark, sf_dir):
    s = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(*[F.array_sort(F.collect_set(F.when(F.col("o_orderstatus") == v, F.col("o_orderpriority")))).alias(c) for v, c in (("F", "b"), ("O", "a"))])
    return L.endpoint_changes(s, "b", "a").select("o_custkey", F.size("gone").cast("long").alias("n_gone"), F.size("back").cast("long").alias("n_back"))


# --- names and paths ---------------------------------------------------------


@query("""SELECT page_id, regexp_extract(url, '[^/]*$') AS name, lower(regexp_extract(regexp_extract(url, '[^/]*$'), '.(\\.[^.]*)$', 1)) AS suffix, regexp_replace(url, '/?[^/]*$', '') AS parent FROM pages""")
def p05_paths(spark, sf_dir):
    u = F.col("url")
    return table(spark, sf_dir, "pages").select("page_id", X.base_name(u).alias("name"), X.suffix(u).alias("suffix"), X.parent(u).alias("parent"))


@query("""SELECT p_partkey, regexp_matches('amb_' || CASE WHEN p_partkey % 2 = 0 THEN 'loop' ELSE 'loopy' END || CASE WHEN p_partkey % 3 = 0 THEN '_' || p_size ELSE '' END, '(?i)(^|[_\\-. ])loop([_\\-. 0-9]|$)') AS is_loop FROM part""")
def p06_loop_names(spark, sf_dir):
    name = F.concat(F.lit("amb_"), F.when(F.col("p_partkey") % 2 == 0, "loop").otherwise("loopy"), F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("_"), F.col("p_size").cast("string"))).otherwise(""))
    return table(spark, sf_dir, "part").select("p_partkey", X.is_loop_name(name).alias("is_loop"))


def _marks(rules) -> list[str]:
    return [m for _, marks in rules for m in marks]


def _chain(text: str, rules) -> str:
    return " ".join(f"WHEN {' OR '.join(f"contains({text}, '{m}')" for m in marks)} THEN '{label}'" for label, marks in rules)


#: Every mark of a directory meets every mark of a name, and both meet none; letters in upper and lower case, both slashes.
_DIRS, _NAMES = ["/plain/", *_marks(X.DIRECTORY_RULES)], ["x", *_marks(X.NAME_RULES)]
_sql_list = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"


@query(rf"""WITH p AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN upper(d) WHEN doc_id % 3 = 1 THEN replace(d, '/', '\') ELSE d END || 'a' || n || doc_id || '.wav' AS path
 FROM (SELECT doc_id, 'Audio/' || {_sql_list(_DIRS)}[doc_id % {len(_DIRS)} + 1] || '/b/' AS d, {_sql_list(_NAMES)}[doc_id // {len(_DIRS)} % {len(_NAMES)} + 1] AS n FROM documents)),
w AS (SELECT doc_id, '/' || lower(replace(path, '\', '/')) AS whole FROM p), q AS (SELECT *, regexp_replace(whole, '[^/]*$', '') AS dir FROM w)
SELECT doc_id, CASE {_chain('dir', X.DIRECTORY_RULES)} {_chain('whole', X.NAME_RULES)} ELSE 'uncategorized' END AS category FROM q""")
def p07_categories(spark, sf_dir):
    of = lambda words, k: F.element_at(F.array(*map(F.lit, words)), (k + 1).cast("int"))
    k = F.col("doc_id")
    folder = F.concat(F.lit("Audio/"), of(_DIRS, k % len(_DIRS)), F.lit("/b/"))
    folder = F.when(k % 3 == 0, F.upper(folder)).when(k % 3 == 1, F.replace(folder, F.lit("/"), F.lit("\\"))).otherwise(folder)
    path = F.concat(folder, F.lit("a"), of(_NAMES, F.floor(k / len(_DIRS)) % len(_NAMES)), k.cast("string"), F.lit(".wav"))
    return table(spark, sf_dir, "documents").select("doc_id", X.category(path).alias("category"))


@query("""SELECT doc_id, 'suling_note' || (12 * (doc_id // 28 % 11 - 1) + [0, 2, 4, 5, 7, 9, 11][doc_id % 7 + 1] + [0, 1, -1, 2][doc_id // 7 % 4 + 1]) || '_x' || doc_id AS canonical FROM documents""")
def p08_canonical_names(spark, sf_dir):
    k = F.col("doc_id")
    of = lambda words, at: F.element_at(F.array(*map(F.lit, words)), (at + 1).cast("int"))
    note = F.concat(of("CdEfGaB", k % 7), of(["", "#", "b", "##"], F.floor(k / 7) % 4), (F.floor(k / 28) % 11 - 1).cast("string"))
    path = F.concat(F.lit("a/Suling_"), note, F.lit("_138bpm4-4_L17M-P1B_X"), k.cast("string"), F.lit(".wav"))
    return table(spark, sf_dir, "documents").select("doc_id", X.canonical_name(path).alias("canonical"))


@query("""SELECT user_id, CAST(sum(CASE WHEN value > 1e308 OR isnan(value) THEN 0 ELSE 1 END) AS BIGINT) AS n_finite FROM events GROUP BY user_id""")
def p16_finite(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.count(stats.finite_round(F.col("value"), 2)).alias("n_finite"))


# --- spectra, frames, orders ------------------------------------------------------------


def _clips(spark, sf_dir):
    """Embeddings as clips of 64 samples, a thousand a second."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("clip"), F.lit(1000).alias("sample_rate"), F.transform("embedding", lambda v: v.cast("double")).alias("samples"))


@query()
def a13_onset_envelopes(spark, sf_dir):
    return spectral.envelopes(_clips(spark, sf_dir))


@query()
def a14_onset_features(spark, sf_dir):
    return spectral.onset_features(_clips(spark, sf_dir))


@query("""WITH e AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events),
v AS (SELECT user_id, k, event_id, log10(greatest(value, 1.0)) AS a, 4.0::DOUBLE * (event_id % 10 / 10.0::DOUBLE) AS b, log10(greatest(event_id % 7 / 10.0::DOUBLE, 0.001::DOUBLE)) AS c FROM e)
SELECT event_id, CAST(round(sqrt((a - lag(a) OVER w) ^ 2 + (b - lag(b) OVER w) ^ 2 + (c - lag(c) OVER w) ^ 2) * 1000000) AS BIGINT) AS micro_distance FROM v WINDOW w AS (PARTITION BY user_id ORDER BY k)""")
def a15_step_distances(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    v = e.withColumn("v", Q.step_vector(F.col("value"), F.col("event_id") % 10 / 10.0, F.col("event_id") % 7 / 10.0))
    before = F.lag("v").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return v.withColumn("d", Q.feature_distance(before, F.col("v"))).select("event_id", F.round(F.col("d") * 1000000).cast("long").alias("micro_distance"))


@query("""WITH f AS (SELECT label, vec_id, list_transform(embedding, lambda v: CAST(v > 0 AS INT)) AS m FROM embeddings),
g AS (SELECT *, lag(m) OVER (PARTITION BY label ORDER BY vec_id) AS p FROM f)
SELECT label, vec_id AS idx, list_sum(m)::DOUBLE / len(m) * 100 AS bright, CASE WHEN p IS NULL OR len(p) <> len(m) THEN 0.0 ELSE list_sum(list_transform(list_zip(m, p), lambda x: CAST(x[1] <> x[2] AS INT)))::DOUBLE / len(m) * 100 END AS change FROM g""")
def a16_frame_signals(spark, sf_dir):
    pixels = F.unhex(F.array_join(F.transform("embedding", lambda v: F.when(v > 0, "c8").otherwise("b4")), ""))
    frames = table(spark, sf_dir, "embeddings").select("label", F.col("vec_id").alias("idx"), pixels.alias("pixels"))
    return spectral.frame_signals(frames, ["label"])


@query("""SELECT vec_id, greatest(0.0, s[least(CAST(floor(0.95 * len(s)) AS INT), len(s) - 1) + 1] - s[least(CAST(floor(0.05 * len(s)) AS INT), len(s) - 1) + 1]) AS amplitude FROM (SELECT vec_id, list_sort(CAST(embedding AS DOUBLE[])) AS s FROM embeddings)""")
def a17_band_amplitudes(spark, sf_dir):
    values = F.array_sort(F.transform("embedding", lambda v: v.cast("double")))
    return table(spark, sf_dir, "embeddings").select("vec_id", spectral.band_amplitude(values).alias("amplitude"))


@query("""WITH b AS (SELECT user_id, event_id AS start, CASE WHEN user_id % 3 = 0 THEN 0.0 ELSE greatest(0.0, round_even(value / 10, 0) - 8) END AS score, value AS amplitude FROM events)
SELECT user_id, start, score, amplitude, score <= 0 AS fallback FROM b QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY score DESC, CASE WHEN score > 0 THEN 0.0 ELSE amplitude END DESC, start) = 1""")
def j17_best_bands(spark, sf_dir):
    score = F.when(F.col("user_id") % 3 == 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.bround(F.col("value") / 10, 0) - 8))
    bands = table(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("start"), score.alias("score"), F.col("value").alias("amplitude"))
    return spectral.best_band(bands, ["user_id"])


def _placed(df: DataFrame, key: str) -> DataFrame:
    """``key`` and place (from 0) of each row of a sorted table: places within parts, and what the parts before hold.

    The sorted rows are stored first: a sort that runs twice cuts its ranges anew, so places and counts would be of different parts.
    """
    parts = stored(df.select(key, F.monotonically_increasing_id().alias("_row")), "placed").withColumn("_part", F.shiftright("_row", 33))
    n = parts.groupBy("_part").agg(F.count("*").alias("_n"))
    before = n.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))  # a row for each part
    place = F.col("_before") + F.col("_row").bitwiseAND((1 << 33) - 1)
    return parts.join(F.broadcast(before), "_part").select(key, place.cast("long").alias("place"))


@query("SELECT p_partkey, row_number() OVER (ORDER BY p_name || p_partkey) - 1 AS place FROM part")
def t01_results_in_order(spark, sf_dir):
    files = table(spark, sf_dir, "part").select("p_partkey", F.concat("p_name", F.col("p_partkey").cast("string")).alias("path"))
    return _placed(L.results_in_order(files), "p_partkey")


@query("SELECT p_partkey, row_number() OVER (ORDER BY p_size % 4 DESC, p_name || p_partkey) - 1 AS place FROM part")
def t02_duplicates_in_order(spark, sf_dir):
    severity = F.get(F.array(*map(F.lit, R.SEVERITIES)), (F.col("p_size") % 4).cast("int"))  # element_at of a null index gives the last
    groups = table(spark, sf_dir, "part").select("p_partkey", severity.alias("severity"), F.concat("p_name", F.col("p_partkey").cast("string")).alias("keeper"))
    return _placed(L.duplicates_in_order(groups), "p_partkey")


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey % 4, CAST(o_orderkey AS VARCHAR)) - 1 AS place FROM orders")
def t03_differences_in_order(spark, sf_dir):
    category = F.get(F.array(*map(F.lit, I.CATEGORIES)), (F.col("o_orderkey") % 4).cast("int"))
    found = table(spark, sf_dir, "orders").select("o_orderkey", category.alias("category"), F.col("o_orderkey").cast("string").alias("idx"))
    return _placed(I.in_report_order(found), "o_orderkey")


@query("SELECT event_id, row_number() OVER (ORDER BY user_id, event_id / 4.0) - 1 AS place FROM events")
def t04_gaps_in_order(spark, sf_dir):
    gaps = table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("path"), (F.col("event_id") / 4.0).alias("time_s"))
    return _placed(T.gaps_in_order(gaps), "event_id")
