"""Panel files with ``@`` header lines and one series per data line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidefold.functions.text import parse_boolean
from tidefold.operators.ordered import number_rows

# Attribute names that may hold the series id or its horizon.
ID_NAMES = ("series_name", "series_id", "item_id", "id", "name")
HORIZON_NAMES = ("horizon", "forecast_horizon", "prediction_length")
KINDS = ("string", "numeric", "date")
DATE_FORMAT = "yyyy-MM-dd HH-mm-ss"


def _fail(message: Column | str) -> Column:
    return F.raise_error(F.lit(message) if isinstance(message, str) else message)


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Trimmed, non-empty, non-comment lines with their place in their file.

    Read as ISO-8859-1, which maps every byte; the block start and the row
    number inside a block give the order without reading a file in one task.
    """
    raw = (
        spark.read.schema("line string")
        .option("sep", "\x01").option("quote", "").option("escape", "").option("encoding", "iso-8859-1")
        .option("header", "false").option("mode", "PERMISSIVE").option("recursiveFileLookup", "true").option("maxCharsPerColumn", "-1")
        .csv(path)
        .select(
            F.trim("line").alias("line"), F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("seq"),
        )
    )
    return raw.filter((F.col("line") != "") & ~F.col("line").startswith("#"))


def _headers(lines: DataFrame) -> DataFrame:
    """One row per file: attribute names and types in order, metadata, place of the data tag."""
    words = F.split("line", r"\s+")
    tag = F.lower(words[0])
    head = lines.filter(F.col("line").startswith("@")).withColumns({"words": words, "tag": tag, "place": F.struct("block", "seq")})
    attribute = F.col("tag") == "@attribute"
    data = F.lower("line") == "@data"
    known = F.when(attribute, F.size("words") == 3).when(data, F.lit(True)).otherwise(F.size("words") == 2)
    checked = head.filter(
        F.when(known, F.lit(True)).otherwise(_fail(F.concat(F.lit("invalid declaration: "), F.col("line"))).cast("boolean"))
    )

    def value(name: str) -> Column:
        return F.max_by(F.when(F.col("tag") == name, F.col("words")[1]), F.when(F.col("tag") == name, F.col("place")))

    # Header lines are few by the format.
    declared = F.array_sort(F.collect_list(F.when(attribute, F.struct("place", F.col("words")[1].alias("name"), F.lower(F.col("words")[2]).alias("kind")))))
    out = checked.groupBy("file").agg(
        declared.alias("declared"), value("@frequency").alias("frequency"), value("@horizon").cast("int").alias("dataset_horizon"),
        value("@missing").alias("_missing"), value("@equallength").alias("_equal"),
        F.min(F.when(data, F.col("place"))).alias("data_place"),
    )
    return out.select(
        "file", F.col("declared.name").alias("names"), F.col("declared.kind").alias("kinds"), "frequency", "dataset_horizon",
        F.when(F.col("_missing").isNotNull(), parse_boolean(F.col("_missing"))).alias("contains_missing"),
        F.when(F.col("_equal").isNotNull(), parse_boolean(F.col("_equal"))).alias("equal_length"), "data_place",
    )


def metadata(spark: SparkSession, path: str) -> DataFrame:
    return _headers(_lines(spark, path)).drop("data_place")


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """One row per data line: ``file, index, attributes, values`` and the file's metadata.

    ``?`` is NULL. Attributes are checked against their declared types. No data
    line, no attributes, an unknown type, no data tag, a wrong field count, a line
    before the tag or a line without any value fails the job.
    """
    lines = _lines(spark, path)
    rows = number_rows(
        lines.filter(~F.col("line").startswith("@")), ["file"], [F.col("block"), F.col("seq")], F.col("block"), "index"
    )
    # A file with a header and no data line comes out of the full join with no index.
    joined = rows.join(_headers(lines), "file", "full")
    count = F.size("names")
    fields = F.split("line", ":", count + 1)
    problem = (
        F.when(F.col("index").isNull(), "no data line")
        .when(F.col("names").isNull() | (count == 0), "no attributes declared")
        .when(F.exists("kinds", lambda k: ~k.isin(*KINDS)), "unknown attribute type")
        .when(F.col("data_place").isNull(), "no data tag")
        .when(F.struct("block", "seq") < F.col("data_place"), "data before the data tag")
        .when(F.size(fields) != count + 1, "wrong number of fields")
    )
    good = joined.filter(
        F.when(problem.isNull(), F.lit(True)).otherwise(_fail(F.concat(F.lit("bad panel file: "), problem)).cast("boolean"))
    )
    numbers = F.transform(
        F.split(F.get(fields, count), ","), lambda t: F.when(F.trim(t) != "?", F.trim(t).cast("double"))
    )
    texts = F.zip_with("kinds", F.slice(fields, F.lit(1), count), lambda kind, text: as_declared(text, kind))
    parsed = good.select(
        "file", "index", F.map_from_arrays("names", texts).alias("attributes"),
        F.map_from_arrays("names", "kinds").alias("kinds"), numbers.alias("values"), "frequency", "dataset_horizon",
        "contains_missing", "equal_length",
    )
    return parsed.filter(
        F.when(F.exists("values", lambda v: v.isNotNull()), F.lit(True)).otherwise(_fail("a series has no value").cast("boolean"))
    )


def as_declared(text: Column, kind: Column) -> Column:
    """Attribute text checked against its declared type; a number is written plainly (``007`` and ``7.0`` are ``7``)."""
    number = text.try_cast("double")
    plain = F.when(number == F.floor(number), F.floor(number).cast("long").cast("string")).otherwise(number.cast("string"))
    bad = _fail(F.concat(F.lit("attribute is not "), kind, F.lit(": "), text)).cast("string")
    numeric = F.when(number.isNull() | F.isnan(number), bad).otherwise(plain)
    date = F.when(F.try_to_timestamp(text, F.lit(DATE_FORMAT)).isNull(), bad).otherwise(text)
    return F.when(F.trim(text).isin("", "?"), text).when(kind == "numeric", numeric).when(kind == "date", date).otherwise(text)


def typed(text: Column, kind: Column) -> Column:
    """Attribute text that was checked against its type, as a VARIANT: whole and other numbers, moments in ISO form, text."""
    number = text.try_cast("double")
    whole = F.when(number == F.floor(number), F.floor(number).cast("long"))
    moment = F.date_format(F.try_to_timestamp(text, F.lit(DATE_FORMAT)), "yyyy-MM-dd'T'HH:mm:ss")
    numeric = F.when(whole.isNotNull(), whole.cast("variant")).otherwise(number.cast("variant"))
    return (
        F.when((kind == "numeric") & number.isNotNull(), numeric)
        .when((kind == "date") & moment.isNotNull(), moment.cast("variant"))
        .otherwise(text.cast("variant"))
    )


def typed_attributes(attributes: Column, kinds: Column) -> Column:
    """Map of attribute names to VARIANT values in their declared types."""
    return F.map_from_arrays(F.map_keys(attributes), F.transform(F.map_keys(attributes), lambda k: typed(attributes[k], kinds[k])))


def _lowered(attributes: Column) -> Column:
    return F.transform_keys(attributes, lambda k, v: F.lower(k))


def series_id(attributes: Column, index: Column) -> Column:
    """The first non-blank known id attribute, else ``series_%04d``."""
    low = _lowered(attributes)
    options = [F.nullif(F.trim(F.try_element_at(low, F.lit(n))), F.lit("")) for n in ID_NAMES]
    return F.coalesce(*options, F.format_string("series_%04d", index))


def horizon(attributes: Column, dataset: Column, fallback: int | None = None) -> Column:
    """The record's horizon, else the file's, else the fallback; none or a non-positive one fails."""
    low = _lowered(attributes)
    own = [F.try_element_at(low, F.lit(n)).cast("double").cast("int") for n in HORIZON_NAMES]
    last = [F.lit(fallback)] if fallback is not None and fallback > 0 else []
    found = F.coalesce(*own, dataset, *last)
    return F.when(found > 0, found).otherwise(_fail("no valid forecast horizon").cast("int"))


def read_panel(spark: SparkSession, path: str, fallback_horizon: int | None = None) -> DataFrame:
    """Long table ``file, series_id, horizon, attributes, typed, pos, value`` ready for the preparation plan.

    ``attributes`` holds the texts, ``typed`` the same values in their declared types.
    """
    records = read_records(spark, path)
    return records.select(
        "file", series_id(F.col("attributes"), F.col("index")).alias("series_id"),
        horizon(F.col("attributes"), F.col("dataset_horizon"), fallback_horizon).alias("horizon"), "attributes",
        typed_attributes(F.col("attributes"), F.col("kinds")).alias("typed"), F.posexplode("values").alias("pos", "value"),
    ).withColumn("pos", F.col("pos").cast("long"))


def write_panel(df: DataFrame, path: str, names: dict[str, str], header: dict[str, str], files: int = 8) -> None:
    """Write ``series_id, <names>, pos, value`` as ``files`` files, each with the full header.

    A line holds one whole series, so a series must be short enough for a line.
    """
    head = [f"@{k} {v}" for k, v in header.items()] + [f"@attribute {k} {v}" for k, v in names.items()] + ["@data"]
    bucket = F.pmod(F.xxhash64("series_id"), F.lit(files)).cast("int")
    values = F.array_join(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "value"))), lambda t: F.coalesce(t["value"].cast("string"), F.lit("?"))), ","
    )
    lines = df.groupBy("series_id", *[n for n in names if n != "series_id"]).agg(values.alias("_v")).select(
        bucket.alias("bucket"), F.lit(len(head)).alias("place"), F.concat_ws(":", *[F.col(n).cast("string") for n in names], "_v").alias("line")
    )
    # Header lines go to the buckets that hold series.
    tops = lines.select("bucket").distinct().select(
        "bucket", F.posexplode(F.array(*[F.lit(t) for t in head])).alias("place", "line")
    )
    (
        lines.unionByName(tops).repartition(files, "bucket").sortWithinPartitions("bucket", "place")
        .select("bucket", "line").write.mode("errorifexists").partitionBy("bucket").text(path)
    )


