"""Manifest, job-health and bookkeeping queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from updraft import fixtures as fx
from updraft.catalog.registry import query, rnd, rounded
from updraft.operators import activity, health, terrain
from updraft.sources import tables

NOW = "2024-01-31 08:00:00"


def now():
    return F.to_timestamp(F.lit(NOW))


# -- manifest ----------------------------------------------------------------


def nested_manifest(spark, d):
    """The flat manifest in the stored, nested form."""
    flat = fx.manifest(spark, d)
    share = lambda m: (F.col("seq") % m) / float(m)
    metrics = F.struct(
        share(97).alias("cape_cover_frac"), share(89).alias("rad_cover_frac"), share(83).alias("htop_dc_cover_frac"),
        share(79).alias("wet_frac"), (F.col("seq") % 2000).cast("double").alias("cape_max_jkg"),
    )
    reason = F.when(F.col("fire"), "cape_cover").otherwise("no_threshold_met")
    trigger = F.when(F.col("tier") != "tier1", F.struct("fire", reason.alias("reason"), metrics.alias("metrics")))
    init = F.concat(F.col("init_date").cast("string"), F.lit("T"), F.lpad(F.col("init_h").cast("string"), 2, "0"), F.lit(":00:00Z"))
    return flat.select(
        "seq", init.alias("init_utc"), "tier", "files_attempted", "files_ok", "bytes_on_disk",
        F.array(F.lit("cape_ml"), F.lit("asob_s")).alias("variables"), trigger.alias("trigger"),
        F.when((F.col("tier") != "tier1") & (F.col("seq") % 5 != 0), init).alias("decision_init_utc"),
    )


KEYS = "(SELECT DISTINCT CAST(o_orderdate AS DATE) AS init_date, CAST(h AS INT) AS init_h FROM orders, (VALUES (0), (3), (6), (9), (12)) v(h)) k"


def keys(spark, d):
    hours = F.explode(F.array(*[F.lit(h) for h in (0, 3, 6, 9, 12)])).alias("init_h")
    return fx.table(spark, d, "orders").select(F.to_date("o_orderdate").alias("init_date")).distinct().select("init_date", hours)


@query("m1_has_record", fx.with_sql("manifest", body=f"SELECT k.* FROM {KEYS} WHERE EXISTS (SELECT 1 FROM manifest m WHERE m.init_date = k.init_date AND m.init_h = k.init_h)"))
def _m1(spark, d):
    return health.has_record(keys(spark, d), fx.manifest(spark, d), health.RUN)


@query("m2_has_successful_record", fx.with_sql("manifest", body=f"SELECT k.* FROM {KEYS} WHERE EXISTS (SELECT 1 FROM manifest m WHERE m.init_date = k.init_date AND m.init_h = k.init_h AND files_ok > 0)"))
def _m2(spark, d):
    return health.has_successful_record(keys(spark, d), fx.manifest(spark, d), health.RUN)


SUMMARY = """
, per AS (SELECT init_date, init_h, SUM(CASE WHEN tier = 'tier2_decision' AND fire THEN 1 ELSE 0 END) AS f, SUM(CASE WHEN tier = 'tier2' THEN 1 ELSE 0 END) AS t2 FROM manifest GROUP BY 1, 2)
, summary AS (SELECT COUNT(*) AS records, CAST(SUM(CASE WHEN tier = 'tier1' THEN 1 ELSE 0 END) AS BIGINT) AS tier1, CAST(SUM(CASE WHEN tier = 'tier2_decision' THEN 1 ELSE 0 END) AS BIGINT) AS tier2_decision,
    CAST(SUM(CASE WHEN tier = 'tier2' THEN 1 ELSE 0 END) AS BIGINT) AS tier2, CAST(SUM(CASE WHEN tier = 'tier2_decision' AND fire THEN 1 ELSE 0 END) AS BIGINT) AS fired_decisions,
    (SELECT COUNT(*) FROM per WHERE f > 0 AND t2 = 0) AS pending_downloads, CAST(SUM(bytes_on_disk) AS BIGINT) AS total_bytes FROM manifest)"""


@query("a5_manifest_summary", fx.with_sql("manifest", body=SUMMARY + "SELECT * FROM summary"))
def _a5(spark, d):
    return health.manifest_summary(fx.manifest(spark, d))


@query("m3_status_report", fx.with_sql("manifest", body=SUMMARY + "SELECT seq, tier, files_ok, bytes_on_disk, (SELECT records FROM summary) AS records FROM manifest ORDER BY seq DESC LIMIT 10"))
def _m3(spark, d):
    rows, summary = health.status_report(fx.manifest(spark, d))
    return rows.select("seq", "tier", "files_ok", "bytes_on_disk", summary.select("records").scalar().alias("records"))


@query("l2_last_records", fx.with_sql("manifest", body="SELECT seq, tier FROM manifest ORDER BY seq DESC LIMIT 10"))
def _l2(spark, d):
    return health.last_records(fx.manifest(spark, d)).select("seq", "tier")


PENDING = """
, fired AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY init_date, init_h ORDER BY seq DESC) AS rn FROM manifest WHERE tier = 'tier2_decision' AND fire)
SELECT init_date, init_h, seq, files_ok FROM fired f WHERE rn = 1 AND NOT EXISTS (SELECT 1 FROM manifest t WHERE t.tier = 'tier2' AND t.init_date = f.init_date AND t.init_h = f.init_h)"""


@query("j10_pending_targets", fx.with_sql("manifest", body=PENDING))
def _j10(spark, d):
    return health.pending_targets(fx.manifest(spark, d)).select("init_date", "init_h", "seq", "files_ok")


@query(
    "l1_sorted_targets",
    fx.with_sql("manifest", body=PENDING.replace("SELECT init_date, init_h, seq, files_ok FROM fired f", ", open AS (SELECT init_date, init_h FROM fired f") + ") SELECT *, CAST(ROW_NUMBER() OVER (ORDER BY init_date, init_h) AS INT) AS place FROM open"),
)
def _l1(spark, d):
    from pyspark.sql import Window as W

    ordered = health.pending_targets(fx.manifest(spark, d)).select("init_date", "init_h")
    # Places within each year plus the years before: no single-task numbering.
    year = F.year("init_date")
    counts = ordered.groupBy(year.alias("_y")).agg(F.count("*").alias("_n"))
    shift = counts.select("_y", F.coalesce(F.sum("_n").over(W.orderBy("_y").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_s"))
    placed = ordered.withColumn("_y", year).withColumn("_i", F.row_number().over(W.partitionBy("_y").orderBy("init_date", "init_h")))
    return placed.join(shift, "_y").select("init_date", "init_h", (F.col("_i") + F.col("_s")).cast("int").alias("place"))


@query(
    "a7_calendar",
    fx.with_sql("manifest", body="""SELECT init_date, """ + ", ".join(
        f"ROUND(CASE WHEN COUNT(CASE WHEN init_h = {h} THEN 1 END) > 0 THEN SUM(CASE WHEN init_h = {h} THEN files_ok END) / CAST(SUM(CASE WHEN init_h = {h} THEN files_attempted END) AS DOUBLE) END, 4) AS h{h:02d}" for h in (0, 3, 6, 9)
    ) + " FROM manifest WHERE tier = 'tier1' GROUP BY 1"),
)
def _a7(spark, d):
    wide = health.calendar(fx.manifest(spark, d), (0, 3, 6, 9))
    return wide.select("init_date", *[rnd(str(h), 4).alias(f"h{h:02d}") for h in (0, 3, 6, 9)])


INIT_UTC = "CAST(init_date AS VARCHAR) || 'T' || LPAD(CAST(init_h AS VARCHAR), 2, '0') || ':00:00Z'"


@query(
    "a8_trigger_history",
    fx.with_sql("manifest", body=f"""SELECT {INIT_UTC} AS target_init, CASE WHEN seq % 5 <> 0 THEN {INIT_UTC} ELSE '—' END AS decision_init, fire,
    CASE WHEN fire THEN 'cape_cover' ELSE 'no_threshold_met' END AS reason, ROUND((seq % 97) / 97.0e0, 4) AS cape_cover_frac, ROUND((seq % 79) / 79.0e0, 4) AS wet_frac FROM manifest WHERE tier = 'tier2_decision'"""),
)
def _a8(spark, d):
    history = health.trigger_history(nested_manifest(spark, d))
    return rounded(history.select("target_init", "decision_init", "fire", "reason", "cape_cover_frac", "wet_frac"), cape_cover_frac=4, wet_frac=4)


@query(
    "a8_fired_metrics",
    fx.with_sql("manifest", body=f""", f AS (SELECT {INIT_UTC} AS target_init, seq FROM manifest WHERE tier = 'tier2_decision' AND fire)
    SELECT target_init, 'cape_cover_frac' AS metric, ROUND((seq % 97) / 97.0e0, 4) AS value FROM f UNION ALL SELECT target_init, 'rad_cover_frac', ROUND((seq % 89) / 89.0e0, 4) FROM f
    UNION ALL SELECT target_init, 'htop_dc_cover_frac', ROUND((seq % 83) / 83.0e0, 4) FROM f"""),
)
def _a8_long(spark, d):
    return rounded(health.fired_metrics(health.trigger_history(nested_manifest(spark, d))), value=4)


# -- job state ---------------------------------------------------------------

STATE = """
, ranked AS (SELECT *, LAG(status) OVER w AS before FROM job_attempt WINDOW w AS (PARTITION BY job ORDER BY ts, seq))
, runs AS (SELECT *, SUM(CASE WHEN before IS NULL OR before <> status THEN 1 ELSE 0 END) OVER (PARTITION BY job ORDER BY ts, seq) AS run FROM ranked)
, last_run AS (SELECT job, MAX(run) AS run FROM runs GROUP BY 1)
, state AS (SELECT r.job, MAX(ts) AS last_attempt, MAX(CASE WHEN r.run = l.run THEN status END) AS last_status, MIN(CASE WHEN r.run = l.run THEN ts END) AS since, MAX(CASE WHEN status = 'ok' THEN ts END) AS last_success
    FROM runs r JOIN last_run l ON l.job = r.job GROUP BY 1)"""
THRESHOLDS = """
, thresholds AS (SELECT DISTINCT event_type AS job, CAST(LENGTH(event_type) * 7200 AS INT) AS threshold_s FROM events WHERE event_type <> 'view' UNION ALL SELECT r_name, 3600 FROM region)"""
AGE = "CAST(EPOCH(TIMESTAMP '2024-01-31 08:00:00') - FLOOR(EPOCH({c})) AS BIGINT)"
ALERTS = f"""
, aged AS (SELECT t.job, threshold_s, last_status, last_attempt, last_success, since, {AGE.format(c='last_attempt')} AS age, {AGE.format(c='since')} AS streak FROM thresholds t LEFT JOIN state s ON s.job = t.job)
, alert AS (SELECT *, CASE WHEN last_attempt IS NULL THEN 'missing' WHEN age > threshold_s THEN 'stale' WHEN last_status = 'fail' AND streak > 21600 THEN 'stuck-fail' END AS kind FROM aged)"""


def attempts(spark, d):
    return fx.job_attempt(spark, d)


def thresholds(spark, d):
    jobs = fx.table(spark, d, "events").where("event_type <> 'view'").select(F.col("event_type").alias("job")).distinct()
    known = jobs.select("job", (F.length("job") * 7200).alias("threshold_s"))
    return known.unionByName(fx.table(spark, d, "region").select(F.col("r_name").alias("job"), F.lit(3600).alias("threshold_s")))


def found_alerts(spark, d):
    return health.alerts(health.job_state(attempts(spark, d)), thresholds(spark, d), now())


@query("b1_job_state", fx.with_sql("job_attempt", body=STATE + "SELECT * FROM state"))
def _b1(spark, d):
    return health.job_state(attempts(spark, d))


@query("b1_last_extra", fx.with_sql("job_attempt", body="SELECT job, CAST(ARG_MAX(seq, (ts, seq)) AS VARCHAR) AS files FROM job_attempt GROUP BY 1"))
def _b1_extra(spark, d):
    noted = attempts(spark, d).withColumn("extra", F.create_map(F.lit("files"), F.col("seq").cast("string")))
    return health.job_state(noted).select("job", F.col("last_extra")["files"].alias("files"))


@query("b1_merge_job_state", fx.with_sql("job_attempt", body=STATE + "SELECT * FROM state"))
def _b1_merge(spark, d):
    middle = F.to_timestamp(F.lit("2024-01-15 00:00:00"))
    old = health.job_state(attempts(spark, d).where(F.col("ts") < middle))
    return health.merge_job_state(old, attempts(spark, d).where(F.col("ts") >= middle))


@query("b2_alerts", fx.with_sql("job_attempt", body=STATE + THRESHOLDS + ALERTS + "SELECT job, kind, CASE kind WHEN 'stale' THEN age WHEN 'stuck-fail' THEN streak END AS age_s, last_success FROM alert WHERE kind IS NOT NULL"))
def _b2(spark, d):
    return found_alerts(spark, d).select("job", "kind", "age_s", "last_success")


@query(
    "b3_alert_text",
    fx.with_sql("job_attempt", body=STATE + THRESHOLDS + ALERTS + """SELECT job, CONCAT_WS(' — ', '[' || UPPER(kind) || '] ' || job,
    CASE kind WHEN 'missing' THEN 'no heartbeat recorded (job never ran?)' WHEN 'stale' THEN 'last attempt ' || PRINTF('%.1f', FLOOR(age / 3600.0e0 * 10 + 0.5e0) / 10) || ' h ago, threshold ' || PRINTF('%.1f', FLOOR(threshold_s / 3600.0e0 * 10 + 0.5e0) / 10) || ' h'
      ELSE 'status=fail for ' || PRINTF('%.1f', FLOOR(streak / 3600.0e0 * 10 + 0.5e0) / 10) || ' h (streak start ' || STRFTIME(since, '%Y-%m-%dT%H:%M:%SZ') || ')' END,
    CASE kind WHEN 'stale' THEN 'age=' || PRINTF('%.1f', FLOOR(age / 60.0e0 * 10 + 0.5e0) / 10) || ' min' WHEN 'stuck-fail' THEN 'age=' || PRINTF('%.1f', FLOOR(streak / 60.0e0 * 10 + 0.5e0) / 10) || ' min' END,
    'last_ok=' || STRFTIME(last_success, '%Y-%m-%dT%H:%M:%SZ')) AS text FROM alert WHERE kind IS NOT NULL"""),
)
def _b3(spark, d):
    return health.alert_text(found_alerts(spark, d))


@query("a6_alerts_by_kind", fx.with_sql("job_attempt", body=STATE + THRESHOLDS + ALERTS + "SELECT kind, COUNT(*) AS n FROM alert WHERE kind IS NOT NULL GROUP BY 1"))
def _a6(spark, d):
    return health.alerts_by_kind(found_alerts(spark, d))


@query("a9_last_success", fx.with_sql("job_attempt", body=STATE + "SELECT MAX(last_success) AS last_success FROM state WHERE job LIKE 'c%'"))
def _a9(spark, d):
    return health.last_success(health.job_state(attempts(spark, d)), "c")


@query("j15_unexpected_jobs", fx.with_sql("job_attempt", body=STATE + THRESHOLDS + "SELECT job, last_status FROM state WHERE job NOT IN (SELECT job FROM thresholds)"))
def _j15(spark, d):
    return health.unexpected_jobs(health.job_state(attempts(spark, d)), thresholds(spark, d)).select("job", "last_status")


@query("s8_read_heartbeats", fx.with_sql("job_attempt", body=STATE + "SELECT job, last_status, STRFTIME(last_attempt, '%Y-%m-%dT%H:%M:%SZ') AS last_attempt_utc FROM state"))
def _s8(spark, d):
    from updraft.session import scratch_path

    path = scratch_path(spark, "status")
    iso = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias(f"{c}_utc")
    state = health.job_state(attempts(spark, d))
    state.select("job", "last_status", iso("last_attempt"), iso("since"), iso("last_success")).write.json(path)
    return tables.read_heartbeats(spark, path, multi_line=False).select("job", "last_status", "last_attempt_utc")


# -- files and days ----------------------------------------------------------


@query(
    "j9_pending_days",
    "SELECT DISTINCT CAST(ts AS DATE) AS day FROM events WHERE CAST(ts AS DATE) NOT IN (SELECT CAST(ts AS DATE) FROM events GROUP BY 1 HAVING COUNT(*) % 2 = 0) ORDER BY day DESC LIMIT 7",
)
def _j9(spark, d):
    logs = fx.table(spark, d, "events").select(F.to_date("ts").alias("day"))
    outputs = logs.groupBy("day").agg(F.count("*").alias("n")).where("n % 2 = 0")
    return activity.pending_days(logs, outputs, 7)


LOCAL_KEY = "CASE WHEN o_orderkey % 50 = 0 THEN 'misc/' || CAST(o_orderkey AS VARCHAR) ELSE STRFTIME(o_orderdate, '%Y/%m/%d') || '/06/' || CAST(o_orderkey AS VARCHAR) END"


def files(spark, d):
    key = F.col("o_orderkey").cast("string")
    dated = F.concat(F.date_format("o_orderdate", "yyyy/MM/dd"), F.lit("/06/"), key)
    path = F.when(F.col("o_orderkey") % 50 == 0, F.concat(F.lit("misc/"), key)).otherwise(dated)
    return fx.table(spark, d, "orders").select(path.alias("key"), F.floor("o_totalprice").alias("bytes"), "o_orderstatus")


@query(
    "j11_prune_candidates",
    f"""WITH f AS (SELECT {LOCAL_KEY} AS key, o_orderkey, CAST(o_orderdate AS DATE) AS day, CAST(FLOOR(o_totalprice) AS BIGINT) AS bytes, o_orderstatus FROM orders)
    SELECT CASE WHEN key LIKE 'misc/%' THEN 'undatable' WHEN day >= DATE '1998-06-15' - 30 THEN 'recent' WHEN o_orderstatus = 'P' THEN 'unconfirmed' ELSE 'deletable' END AS class,
    COUNT(*) AS n_files, CAST(SUM(bytes) AS BIGINT) AS bytes FROM f GROUP BY 1""",
)
def _j11(spark, d):
    local = files(spark, d)
    remote = local.where("o_orderstatus <> 'P'").select("key")
    return activity.prune_candidates(local.select("key", "bytes"), remote, 30, F.lit("1998-06-15").cast("date"))


@query(
    "j12_inventory_diff",
    f"""WITH f AS (SELECT {LOCAL_KEY} AS key, o_orderstatus AS s FROM orders)
    SELECT key, CASE s WHEN 'F' THEN 'missing' ELSE 'orphan' END AS side FROM f WHERE s IN ('F', 'P')""",
)
def _j12(spark, d):
    every = files(spark, d)
    return activity.inventory_diff(every.where("o_orderstatus <> 'P'"), every.where("o_orderstatus <> 'F'"))


@query("u2_set_difference", "SELECT DISTINCT o_custkey FROM orders WHERE o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def _u2(spark, d):
    orders = fx.table(spark, d, "orders")
    return orders.select("o_custkey").subtract(orders.where("o_orderstatus = 'P'").select("o_custkey"))


@query("u3_first_wins", "SELECT o_custkey, MIN(o_orderkey) AS o_orderkey, ARG_MIN(o_orderpriority, o_orderkey) AS o_orderpriority FROM orders GROUP BY 1")
def _u3(spark, d):
    first = F.min_by(F.struct("o_orderkey", "o_orderpriority"), "o_orderkey").alias("r")
    return fx.table(spark, d, "orders").groupBy("o_custkey").agg(first).select("o_custkey", "r.*")


@query("l4_argmax_per_group", "SELECT o_custkey, ARG_MAX(o_orderkey, (o_totalprice, -o_orderkey)) AS o_orderkey FROM orders GROUP BY 1")
def _l4(spark, d):
    rank = F.struct("o_totalprice", -F.col("o_orderkey"))
    return fx.table(spark, d, "orders").groupBy("o_custkey").agg(F.max_by("o_orderkey", rank).alias("o_orderkey"))


SIZES = ("small", "small_alpine", "liechti", "large", "huge", "unmeasured")


@query(
    "a10_class_counts",
    """WITH c AS (SELECT CASE WHEN a < 100 THEN 'small' WHEN a < 500 THEN 'small_alpine' WHEN a < 1500 THEN 'liechti' WHEN a < 3000 THEN 'large' ELSE 'huge' END AS size_class FROM (SELECT ABS(c_acctbal) AS a FROM customer))
    SELECT v.size_class, COUNT(c.size_class) AS n FROM (VALUES ('small'), ('small_alpine'), ('liechti'), ('large'), ('huge'), ('unmeasured')) v(size_class) LEFT JOIN c ON c.size_class = v.size_class GROUP BY 1""",
)
def _a10(spark, d):
    classed = fx.table(spark, d, "customer").select(terrain.size_class(F.abs("c_acctbal")).alias("size_class"))
    return activity.class_counts(classed, "size_class", SIZES)


@query(
    "a10_layer_summary",
    fx.with_sql("region_box", body="SELECT COUNT(*) AS n, ROUND(SUM(100.0e0 * region_id), 2) AS total_area_km2, MIN(x0) AS min_lon, MIN(y0) AS min_lat, MAX(x1) AS max_lon, MAX(y1) AS max_lat, COUNT(DISTINCT region_id % 5) AS n_parents FROM region_box"),
)
def _a10_layer(spark, d):
    layer = fx.region_box(spark, d).withColumn("area_km2", 100.0 * F.col("region_id")).withColumn("parent", F.col("region_id") % 5)
    return rounded(activity.layer_summary(layer, "parent"), total_area_km2=2)


@query("a11_storage_totals", "SELECT o_orderstatus AS layer, COUNT(*) AS n_files, CAST(SUM(CAST(FLOOR(o_totalprice) AS BIGINT)) AS BIGINT) AS bytes FROM orders GROUP BY ROLLUP (o_orderstatus)")
def _a11(spark, d):
    return activity.storage_totals(files(spark, d).withColumnRenamed("o_orderstatus", "layer"))
