"""Registered queries: file formats written from the tables by Spark and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tidefold.checks import sql
from tidefold.checks.models import rounded
from tidefold.functions.clock import slot_start, text
from tidefold.functions.text import flatten_schema, origin_of, override_origin, sorted_json
from tidefold.operators import impute, resample
from tidefold.plans import prepare
from tidefold.session import shared_folder
from tidefold.sources import files, panels, tsf


def _place(spark) -> str:
    return f"{shared_folder(spark)}/files-{uuid.uuid4().hex}"


def _user_panel(spark, folder):
    path = _place(spark)
    raw = panels.user_day(spark, folder).withColumns(
        {"value": F.round("value", 2), "user_class": F.when(F.length(F.col("series_id").cast("string")) == 2, "Bank user").otherwise("generated")}
    )
    names = {"series_id": "string", "user_class": "string"}
    tsf.write_panel(raw, path, names, {"relation": "users", "frequency": "daily", "horizon": "7", "missing": "true", "equallength": "true"})
    return path


def panel_file(spark, folder):
    """A panel file written from the events and read back as long rows."""
    got = tsf.read_panel(spark, _user_panel(spark, folder))
    return got.select(
        "series_id", "horizon", "pos", "value", sorted_json(F.col("attributes")).alias("attributes_json"),
        origin_of(F.col("attributes")).alias("origin"),
    )


def panel_file_prepared(spark, folder):
    """Panel file to metadata: trim, fill, horizon split and scale for all series in one plan."""
    raw = tsf.read_panel(spark, _user_panel(spark, folder)).select("series_id", "pos", "value")
    got = prepare.by_horizon_panel(raw, 7, F.lit(7), on_short="drop", max_len=panels.EVENT_DAYS.slots)
    out = prepare.metadata(got).select(
        "series_id", "original_length", "processed_length", "prior_n", "bound_n", "validation_n", "test_n", "seasonal_fills",
        "last_observation_fills", "leading_values_dropped", "scaler_mean", "scaler_scale", "scaler_fallback",
    )
    return rounded(out, scaler_mean=6, scaler_scale=6)


def zone_file(spark, folder):
    """A wide CSV with one column for each flag of the table, read back as long rows; cells that break the contract are marked."""
    path = _place(spark)
    p = panels.SHIP_WEEKS
    raw = panels.ship_week(spark, folder).filter(F.col("value").isNotNull())
    timed = raw.withColumn("DateTime", F.date_format(slot_start(F.col("pos"), p.start, p.step), "M/d/yyyy H:mm"))
    zones = resample.names_of(raw)
    names = {z: f"Zone {z}  Load" for z in zones}
    wide = timed.groupBy("DateTime").pivot("series_id", zones).agg(F.first("value"))
    wide.select("DateTime", *[F.col(c).alias(n) for c, n in names.items()]).write.option("header", "true").csv(path)
    got = files.zones_csv(spark, path, {n: c for c, n in names.items()}, on_bad="mark")
    return got.select("series_id", text(F.col("ts")).alias("week"), F.round("value", 4).alias("value"), "problem")


def region_files(spark, folder):
    """One CSV for each event type with repeated timestamps, read back under the contract and collapsed by hour."""
    root = _place(spark)
    events = panels.events(spark, folder)
    # Every event type of the table is a region; one value in 97 is negative, which the contract has to find.
    kinds = resample.names_of(events)
    value = F.when(F.col("event_id") % 97 == 0, -F.col("value")).otherwise(F.col("value"))
    for kind in kinds:
        part = events.filter(F.col("series_id") == kind)
        part.select(F.date_format(F.col("ts"), "yyyy-MM-dd HH:00:00").alias("Datetime"), value.alias("LOAD")).write.option(
            "header", "true"
        ).csv(f"{root}/{kind}")
    rows = files.regions_csv(spark, {k: (f"{root}/{k}", "LOAD") for k in kinds}, on_bad="mark")
    good = F.col("problem").isNull()
    collapsed = rows.groupBy("series_id", "ts").agg(F.avg(F.when(good, F.col("value"))).alias("value"), F.count_if(good).alias("copies"), F.count_if(~good).alias("bad"))
    return collapsed.groupBy("series_id").agg(
        F.sum("copies").alias("raw_rows"), F.sum("bad").alias("bad_rows"), F.count("*").alias("hours"), F.round(F.avg("value"), 6).alias("mean_value")
    )


def panel_file_typed(spark, folder):
    """Numeric and date attributes of a panel file: plain numbers in the JSON, typed columns."""
    path = _place(spark)
    user = F.col("series_id")
    raw = panels.user_day(spark, folder).withColumns(
        {"value": F.round("value", 2), "user_no": F.lpad(user.cast("string"), 6, "0"), "share": (user / 4).cast("string"),
         "opened": F.format_string("2023-%02d-01 06-30-00", F.pmod(user, F.lit(12)) + 1)}
    )
    kinds = {"series_id": "string", "user_no": "numeric", "share": "numeric", "opened": "date"}
    tsf.write_panel(raw, path, kinds, {"relation": "users", "frequency": "daily", "horizon": "7", "missing": "true", "equallength": "true"})
    got = tsf.read_panel(spark, path)
    number = [F.try_variant_get(F.col("typed")[c], "$", t).alias(c) for c, t in (("user_no", "bigint"), ("share", "double"))]
    return got.groupBy("series_id").agg(F.first(sorted_json(F.col("typed"))).alias("attributes_json"), F.first("typed").alias("typed"), F.count("value").alias("days")).select(
        "series_id", "attributes_json", *number, F.try_variant_get(F.col("typed")["opened"], "$", "string").cast("timestamp_ntz").cast("date").cast("string").alias("opened"), "days",
    )


def id_file(spark, folder):
    """Ids written as text with comments and blank lines, read back and used to override origins."""
    path = _place(spark)
    users = panels.table(spark, folder, "customer").select(F.col("c_custkey").cast("string").alias("value"), "c_acctbal", "c_mktsegment")
    lines = users.select(
        F.when(F.col("c_acctbal") < 0, F.concat(F.lit("# "), "value"))
        .when(F.col("c_mktsegment") == "MACHINERY", F.lit("  "))
        .otherwise(F.concat(F.lit(" "), "value", F.lit(" "))).alias("value")
    )
    lines.write.text(path)
    ids = files.id_list(spark, path)
    known = users.select(F.col("value").alias("series_id"), F.lit("unverified").alias("origin"))
    return override_origin(known, ids).groupBy("origin").agg(F.count("*").alias("series"))


def file_manifest(spark, folder):
    """State of every table of the folder against a manifest that has one table more and one changed.

    A table is one file or a folder of part files; either is one row.
    """
    found = files.file_hashes(spark, folder, "*.parquet")
    table = F.element_at(F.split("name", "/"), 1)
    base = found.select("name", F.when(table == "nation.parquet", "0" * 64).otherwise(F.col("sha256")).alias("sha256"))
    extra = base.filter(table == "region.parquet").select(F.regexp_replace("name", "^region", "absent").alias("name"), "sha256")
    return files.entry_states(files.verify_hashes(found, base.unionByName(extra)))


def model_store(spark, folder):
    """Panel and lag tables written by role, read back with only the test role listed."""
    path = _place(spark)
    prepared = prepare.by_ratio_panel(panels.evt_hour(spark, folder), 24, max_len=panels.EVENT_HOURS.slots)
    files.write_panel_table(prepared, f"{path}/panel", f"{path}/audit")
    back = spark.read.parquet(f"{path}/panel").filter(F.col("role") == "test")
    audit = spark.read.schema("series_id string, rows long, imputed_rows long").json(f"{path}/audit")
    return back.groupBy("series_id").agg(F.count("*").alias("test_rows"), F.round(F.avg("value_imputed"), 6).alias("test_mean")).join(audit, "series_id")


def resumed_tasks(spark, folder):
    """Series without a stored result, and the union of two result tables with different columns."""
    filled = impute.imputation_report(impute.seasonal_fill(panels.user_day(spark, folder), 7, max_len=30))
    done = filled.filter(F.col("seasonal_fills") >= 9).withColumn("note", F.lit("first run"))
    left = files.unfinished(filled, done, ["series_id"])
    return files.union_results([done, left]).select("series_id", "seasonal_fills", F.coalesce("note", F.lit("resumed")).alias("note"))


def flat_settings(spark, folder):
    """Nested rows as dotted columns, arrays as JSON text."""
    part = panels.table(spark, folder, "part").select(
        "p_partkey", F.struct(F.col("p_brand").alias("brand"), F.struct(F.col("p_size").alias("size")).alias("box")).alias("kind"),
        F.array("p_size", F.col("p_size") + 1).alias("sizes"),
    )
    flat = flatten_schema(part)
    return flat.select(*[F.col(f"`{c}`").alias(c.replace(".", "_")) for c in flat.columns])


_USERS = "WITH " + sql.USER_DAY + """,
uf AS (SELECT CAST(series_id AS VARCHAR) AS sid, CASE WHEN length(CAST(series_id AS VARCHAR)) = 2 THEN 'Bank user' ELSE 'generated' END AS cls, pos, round(value, 2) AS value FROM user_day)"""

CHECKS = {
    "panel_file": (panel_file, _USERS + """
SELECT sid AS series_id, 7 AS horizon, pos, value, '{"series_id":"' || sid || '","user_class":"' || cls || '"}' AS attributes_json,
 CASE cls WHEN 'generated' THEN 'artificial' ELSE 'real' END AS origin FROM uf"""),
    "panel_file_prepared": (panel_file_prepared, _USERS + ", uu AS (SELECT sid AS series_id, pos, value, 0 AS readings FROM uf)," + sql.imputed("uu", 7) + """,
n AS (SELECT *, count(*) OVER (PARTITION BY series_id) AS n FROM uu_i),
z AS (SELECT *, least(greatest(4, CAST(floor((n - 14) * 0.30::DOUBLE) AS BIGINT)), n - 14 - 4) AS pr FROM n),
s AS (SELECT series_id, min(n) + min(dropped) AS original_length, min(n) AS processed_length, min(pr) AS prior_n, min(n) - 14 - min(pr) AS bound_n, 7::BIGINT AS validation_n, 7::BIGINT AS test_n,
 count(*) FILTER (imputation_source = 'seasonal_past') AS seasonal_fills, count(*) FILTER (imputation_source = 'last_observation') AS last_observation_fills, min(dropped) AS leading_values_dropped,
 avg(value_imputed) FILTER (step < pr) AS m, stddev_pop(value_imputed) FILTER (step < pr) AS sd FROM z GROUP BY 1)
SELECT * EXCLUDE (m, sd), round(m, 6) AS scaler_mean, round(CASE WHEN sd > 1e-12 THEN sd ELSE 1 END, 6) AS scaler_scale, NOT coalesce(sd > 1e-12, false) AS scaler_fallback
FROM s WHERE prior_n >= 4 AND bound_n >= 4"""),
    "zone_file": (zone_file, "WITH " + sql.SHIP_WEEK + """,
ok AS (SELECT pos FROM ship_week GROUP BY 1 HAVING count(value) > 0)
SELECT series_id, strftime(TIMESTAMP '1995-01-02' + to_days(CAST(s.pos * 7 AS INT)), '%Y-%m-%d %H:%M:%S') AS week, round(value, 4) AS value, CASE WHEN value IS NULL THEN 'missing' WHEN value <= 0 THEN 'not positive' END AS problem
FROM ship_week s JOIN ok ON ok.pos = s.pos"""),
    "region_files": (region_files, """
WITH e AS (SELECT event_type, date_trunc('hour', ts) AS ts, CASE WHEN event_id % 97 = 0 THEN -value ELSE value END AS value FROM events),
h AS (SELECT event_type AS series_id, ts, avg(value) FILTER (value > 0) AS v, count(*) FILTER (value > 0) AS c, count(*) FILTER (value IS NULL OR value <= 0) AS b FROM e GROUP BY 1, 2)
SELECT series_id, CAST(sum(c) AS BIGINT) AS raw_rows, CAST(sum(b) AS BIGINT) AS bad_rows, count(*) AS hours, round(avg(v), 6) AS mean_value FROM h GROUP BY 1"""),
    "panel_file_typed": (panel_file_typed, "WITH " + sql.USER_DAY + """,
u AS (SELECT series_id AS s, series_id / 4 AS share, '2023-' || lpad(CAST(series_id % 12 + 1 AS VARCHAR), 2, '0') || '-01' AS opened, count(value) AS days FROM user_day GROUP BY 1)
SELECT CAST(s AS VARCHAR) AS series_id, '{"opened":"' || opened || 'T06:30:00","series_id":"' || s || '","share":' || CASE WHEN share = floor(share) THEN CAST(CAST(share AS BIGINT) AS VARCHAR) ELSE CAST(share AS VARCHAR) END
 || ',"user_no":' || s || '}' AS attributes_json, CAST(s AS BIGINT) AS user_no, CAST(share AS DOUBLE) AS share, opened, days FROM u"""),
    "id_file": (id_file, """
SELECT CASE WHEN c_acctbal >= 0 AND c_mktsegment <> 'MACHINERY' THEN 'real' ELSE 'artificial' END AS origin, count(*) AS series FROM customer GROUP BY 1"""),
    # The tables of the database, one of them changed in the manifest; one that is not there stands in for region.
    "file_manifest": (file_manifest, """
WITH t AS (SELECT DISTINCT table_name AS name FROM information_schema.tables WHERE table_name IN ('region', 'nation', 'customer', 'supplier', 'part',
 'orders', 'lineitem', 'events', 'documents', 'embeddings', 'pages', 'benchmark', 'labels', 'conversations'))
SELECT name || '.parquet' AS name, CASE name WHEN 'nation' THEN 'changed' ELSE 'same' END AS state FROM t UNION ALL SELECT 'absent.parquet', 'missing' FROM t WHERE name = 'region'"""),
    "model_store": (model_store, "WITH " + sql.prepared(sql.EVT_HOUR, "evt_hour", 24) + """
SELECT series_id, count(*) FILTER (role = 'test') AS test_rows, round(avg(value_imputed) FILTER (role = 'test'), 6) AS test_mean, count(*) AS rows, count(*) FILTER (was_imputed) AS imputed_rows FROM p GROUP BY 1"""),
    "resumed_tasks": (resumed_tasks, "WITH " + sql.USER_DAY + "," + sql.imputed("user_day", 7) + """,
r AS (SELECT series_id, count(*) FILTER (imputation_source = 'seasonal_past') AS seasonal_fills FROM user_day_i GROUP BY 1)
SELECT series_id, seasonal_fills, CASE WHEN seasonal_fills >= 9 THEN 'first run' ELSE 'resumed' END AS note FROM r"""),
    "flat_settings": (flat_settings, """
SELECT p_partkey, p_brand AS kind_brand, p_size AS kind_box_size, '[' || p_size || ',' || (p_size + 1) || ']' AS sizes FROM part"""),
}
