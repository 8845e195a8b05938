"""CSV series, id lists, file hashes, and result tables."""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Sequence

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidefold.functions.arrays import finite
from tidefold.functions.clock import epoch_seconds
from tidefold.operators.compare import require_rows
from tidefold.operators.quality import exact_columns, lagged_contract
from tidefold.operators.resample import long
from tidefold.session import spread_keys


def positive(df: DataFrame, value: str = "value", on_bad: str = "fail") -> DataFrame:
    """Rows under the contract of finite, positive values.

    A bad value fails the job; with ``on_bad='mark'`` all rows stay and
    ``problem`` says what is wrong with a row (NULL for a good one).
    """
    good = F.coalesce(finite(F.col(value)) & (F.col(value) > 0), F.lit(False))
    if on_bad == "mark":
        reason = F.when(F.col(value).isNull(), "missing").when(finite(F.col(value)), "not positive").otherwise("not finite")
        return df.withColumn("problem", F.when(~good, reason))
    if on_bad != "fail":
        raise ValueError(f"Unknown rule for bad values {on_bad}.")
    return df.filter(
        F.when(good, F.lit(True)).otherwise(F.raise_error(F.lit(f"{value} must be finite and positive")).cast("boolean"))
    )


def region_csv(spark: SparkSession, path: str, region: str, value_column: str, on_bad: str = "fail") -> DataFrame:
    """``Datetime, <value>`` file of one region; other columns fail the job, bad cells fail it or are marked."""
    rows = (
        spark.read.schema(f"Datetime timestamp_ntz, `{value_column}` double")
        .option("header", "true").option("enforceSchema", "false").option("mode", "FAILFAST")
        .csv(path)
    )
    named = rows.select(F.lit(region).alias("series_id"), F.col("Datetime").alias("ts"), F.col(value_column).alias("value"))
    return positive(named, on_bad=on_bad)


def regions_csv(spark: SparkSession, files: dict[str, tuple[str, str]], on_bad: str = "fail") -> DataFrame:
    """Union of several region files given as ``region -> (path, value column)``."""
    out = None
    for region, (path, column) in files.items():
        part = region_csv(spark, path, region, column, on_bad)
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("At least one region file is needed.")
    return out


def zones_csv(
    spark: SparkSession, path: str, columns: dict[str, str], time: str = "DateTime", pattern: str = "M/d/yyyy H:mm", on_bad: str = "fail"
) -> DataFrame:
    """Wide file with one column per zone, as long rows. ``columns`` maps file names to zone names."""
    fields = ", ".join([f"`{time}` string", *[f"`{c}` double" for c in columns]])
    rows = (
        spark.read.schema(fields).option("header", "true").option("enforceSchema", "false").option("mode", "FAILFAST").csv(path)
    )
    named = rows.select(
        F.to_timestamp_ntz(F.col(time), F.lit(pattern)).alias("ts"), *[F.col(f"`{c}`").alias(z) for c, z in columns.items()]
    )
    return positive(long(named, "ts", list(columns.values())), on_bad=on_bad)


def read_wide_panel(
    spark: SparkSession, path: str, names: Sequence[str], rows: int, step_seconds: int, form: str = "parquet"
) -> DataFrame:
    """Prepared wide panel as long rows under its contract.

    Exact columns are checked before anything is read; the row count, one fixed
    time step without a gap, and finite positive values fail the job.
    """
    wide = exact_columns(spark.read.format(form).load(path), ["timestamp", *names], "panel")
    at = epoch_seconds(F.col("timestamp"))
    counted = require_rows(wide, rows, "panel")
    # With the right row count, distinct times on one grid from first to last have no gap.
    shape = wide.agg(
        F.min(at).alias("first"), F.max(at).alias("last"), F.countDistinct("timestamp").alias("times"),
    )
    even = (F.col("last") - F.col("first") == (rows - 1) * step_seconds) & (F.col("times") == rows)
    phase = wide.agg(F.countDistinct(at % step_seconds).alias("phases"))
    guard = shape.withColumn("_one", F.lit(1)).join(phase.withColumn("_one", F.lit(1)), "_one").filter(
        F.when(even & (F.col("phases") == 1), F.lit(True)).otherwise(
            F.raise_error(F.lit("the panel has no uniform time step")).cast("boolean")
        )
    ).select("_one")
    checked = counted.withColumn("_one", F.lit(1)).join(F.broadcast(guard), "_one").drop("_one")
    return positive(long(checked, "timestamp", list(names)))


def id_list(spark: SparkSession, path: str) -> DataFrame:
    """Ids of a text file; blank lines and lines starting with '#' are ignored."""
    line = F.trim("value")
    return spark.read.text(path).filter((line != "") & ~line.startswith("#")).select(line.alias("id")).distinct()


PART = 8 << 20


def _hashed(batches):
    """SHA-256 of each path, read in parts of ``PART`` bytes."""
    for batch in batches:
        found = []
        for path in batch.column("path").to_pylist():
            system, place = fs.FileSystem.from_uri(path)
            digest = hashlib.sha256()
            with system.open_input_stream(place) as stream:
                while part := stream.read(PART):
                    digest.update(part)
            found.append(digest.hexdigest())
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.string())], [*batch.schema.names, "sha256"])


def file_hashes(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """SHA-256 of every file under a folder, of any size: only names are rows, a file's bytes pass through its task.

    A name is the path below the folder, so files of one name in two of its
    folders stay apart. Spark's listing leaves empty files out, and so does this one.
    """
    listed = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    scheme = r"^[A-Za-z][A-Za-z0-9+.\-]*:(//[^/]*)?"
    root = [p for p in re.sub(scheme, "", path if re.match(scheme, path) else os.path.abspath(path)).split("/") if p]
    # The parts of "/a/b/name" begin with an empty one.
    below = F.slice(F.split(F.regexp_replace("path", scheme, ""), "/"), len(root) + 2, 1 << 20)
    names = listed.select(F.array_join(below, "/").alias("name"), "path", F.col("length").alias("bytes"))
    return spread_keys(names, "path").mapInArrow(_hashed, "name string, path string, bytes long, sha256 string")


def verify_hashes(found: DataFrame, manifest: DataFrame) -> DataFrame:
    """Files that are missing, unexpected or changed against a manifest ``name, sha256``."""
    both = found.select("name", F.col("sha256").alias("actual")).join(
        manifest.select("name", F.col("sha256").alias("expected")), "name", "full"
    )
    state = (
        F.when(F.col("actual").isNull(), "missing").when(F.col("expected").isNull(), "unexpected")
        .when(F.col("actual") != F.col("expected"), "changed").otherwise("same")
    )
    return both.withColumn("state", state)


def entry_states(verified: DataFrame) -> DataFrame:
    """States of :func:`verify_hashes` for whole entries of the folder: a table may be one file or a folder of part files.

    An entry all of whose files have one state has that state; any other is changed.
    """
    entry = F.element_at(F.split("name", "/"), 1)
    return verified.groupBy(entry.alias("name")).agg(F.when(F.min("state") == F.max("state"), F.min("state")).otherwise("changed").alias("state"))


def write_new(df: DataFrame, path: str, partition_by: Sequence[str] = (), form: str = "parquet") -> None:
    """Write a result; an existing output is an error, so a finished run is never repeated over."""
    writer = df.write.mode("errorifexists").format(form)
    (writer.partitionBy(*partition_by) if partition_by else writer).save(path)


def write_panel_table(prepared: DataFrame, path: str, audit_path: str | None = None) -> None:
    """Prepared panel by role (and dataset), with an optional audit as JSON."""
    keys = [c for c in ("dataset", "role") if c in prepared.columns]
    write_new(prepared, path, keys)
    if audit_path is not None:
        audit = prepared.groupBy(*[k for k in keys if k != "role"], "series_id").agg(
            F.count("*").alias("rows"), F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"),
            F.count_if("was_imputed").alias("imputed_rows"),
        )
        write_new(audit, audit_path, form="json")


def write_lagged(lagged: DataFrame, path: str, order: int) -> None:
    """Lag rows by lag order and role, so a role is read without listing the others."""
    write_new(lagged.withColumn("lag", F.lit(order)), path, ("lag", "role"))


def read_lagged(spark: SparkSession, path: str, order: int, *roles: str) -> DataFrame:
    """Lag rows of one order (and some roles); rows that break the contract of lag rows fail the job."""
    rows = spark.read.parquet(path).filter(F.col("lag") == order).drop("lag")
    if roles:
        rows = rows.filter(F.col("role").isin(*roles))
    status = lagged_contract(rows, order).select("series_id", "status")
    fine = F.when(F.col("status") == "PASS", F.lit(True)).otherwise(
        F.raise_error(F.concat(F.lit("lag rows break their contract: "), F.col("series_id").cast("string"))).cast("boolean")
    )
    return rows.join(status, "series_id").filter(fine).drop("status")


def write_models(models: DataFrame, covers: DataFrame | None, path: str) -> None:
    """Fitted coefficients and rule geometry as two tables; loading them is a key join."""
    write_new(models, f"{path}/models")
    if covers is not None:
        write_new(covers, f"{path}/rules")


def read_models(spark: SparkSession, path: str, with_rules: bool = True) -> DataFrame:
    models = spark.read.parquet(f"{path}/models")
    if not with_rules:
        return models
    rules = spark.read.parquet(f"{path}/rules").drop("rule_count")
    return models.join(rules, ["series_id", "lag", "k"], "left")


def unfinished(tasks: DataFrame, done: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Tasks without a stored result: what a resumed run still has to do."""
    return tasks.join(done.select(*keys).distinct(), list(keys), "left_anti")


def union_results(parts: Sequence[DataFrame]) -> DataFrame:
    """Result tables of several runs; columns one of them lacks become NULL."""
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out
