"""Parsing, identifiers and hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Accepted spellings of a boolean.
TRUE_WORDS = ("true", "1", "yes")
FALSE_WORDS = ("false", "0", "no")

# Metadata words that tell where a series comes from.
ARTIFICIAL_WORDS = ("artificial", "synthetic", "generated", "simulated")
REAL_WORDS = ("real", "bank", "banking")


def parse_boolean(value: Column) -> Column:
    word = F.lower(F.trim(value.cast("string")))
    return (
        F.when(word.isin(*TRUE_WORDS), F.lit(True))
        .when(word.isin(*FALSE_WORDS), F.lit(False))
        .otherwise(
            F.raise_error(F.concat(F.lit("not a boolean: "), F.coalesce(word, F.lit("NULL")))).cast(
                "boolean"
            )
        )
    )


def parse_lags(value: Column) -> Column:
    """'3|5;10, 5' -> [3, 5, 10]; a value below one is an error."""
    parts = F.filter(
        F.transform(F.split(F.coalesce(value, F.lit("")), "[,;|]"), lambda t: F.trim(t)),
        lambda t: t != "",
    )
    lags = F.array_sort(F.array_distinct(F.transform(parts, lambda t: t.cast("int"))))
    return F.when(F.exists(lags, lambda v: v.isNull() | (v <= 0)), F.raise_error(F.lit("lags must be positive integers")).cast("array<int>")).otherwise(lags)


def safe_name(value: Column) -> Column:
    cleaned = F.regexp_replace(value, r"[^\p{L}\p{N}\-_.]", "_")
    cleaned = F.regexp_replace(cleaned, r"^[._]+|[._]+$", "")
    return F.when(cleaned == "", F.lit("series")).otherwise(cleaned)


def origin_of(attributes: Column) -> Column:
    """Origin named by the metadata text; artificial words win over real ones."""
    pairs = F.transform(
        F.map_entries(attributes), lambda e: F.concat(e["key"], F.lit("="), F.coalesce(e["value"], F.lit("")))
    )
    words = F.lower(F.array_join(pairs, " "))
    return (
        F.when(words.rlike("|".join(ARTIFICIAL_WORDS)), "artificial")
        .when(words.rlike("|".join(REAL_WORDS)), "real")
        .otherwise("unverified")
    )


def override_origin(df: DataFrame, verified: DataFrame, id_column: str = "series_id") -> DataFrame:
    """Listed ids are real and all others artificial; an empty list changes nothing."""
    listed = verified.select(F.col("id").alias(id_column)).distinct().withColumn("_listed", F.lit(True))
    # One row that says whether the list holds anything.
    some = verified.agg((F.count("*") > 0).alias("_some")).withColumn("_one", F.lit(1))
    named = F.when(F.col("_listed"), "real").otherwise("artificial")
    return (
        df.join(listed, id_column, "left").withColumn("_one", F.lit(1)).join(F.broadcast(some), "_one")
        .withColumn("origin", F.when(F.col("_some"), named).otherwise(F.col("origin")))
        .drop("_listed", "_some", "_one")
    )


def sorted_json(attributes: Column) -> Column:
    """Attributes (a map) as JSON by name; a VARIANT value keeps its type, so numbers are not quoted."""
    names = F.array_sort(F.map_keys(attributes))
    return F.to_json(F.map_from_arrays(names, F.transform(names, lambda k: attributes[k])))


def flatten_schema(df: DataFrame) -> DataFrame:
    """Nested structs become dotted columns and arrays become JSON text."""

    def leaves(schema: T.StructType, path: tuple[str, ...]):
        for field in schema.fields:
            here = (*path, field.name)
            if isinstance(field.dataType, T.StructType):
                yield from leaves(field.dataType, here)
                continue
            column = F.col(".".join(f"`{p}`" for p in here))
            if isinstance(field.dataType, T.ArrayType):
                column = F.to_json(column)
            yield column.alias(".".join(here))

    return df.select(*leaves(df.schema, ()))


def plain_number(value: Column, digits: int = 8) -> Column:
    """``%.{digits}g`` with trailing zeros removed."""
    v = value.cast("double")
    power = F.floor(F.log10(F.abs(v)))
    scale = F.pow(F.lit(10.0), digits - 1 - power)
    rounded = F.round(v * scale) / scale
    plain = F.regexp_replace(rounded.cast("decimal(38,18)").cast("string"), r"\.?0+$", "")
    text = F.format_string(f"%.{digits - 1}e", v)
    scientific = F.concat(
        F.regexp_replace(F.substring_index(text, "e", 1), r"\.?0+$", ""), F.lit("e"), F.substring_index(text, "e", -1)
    )
    small = F.abs(v) < F.lit(9.99999995e-5)
    large = F.abs(v) >= F.lit(10.0**digits - 0.5)
    return F.when(v == 0, F.lit("0")).when(small | large, scientific).otherwise(plain)


def candidate_id(family: Column, lag: Column, radius: Column, alpha: Column, rules: Column) -> Column:
    return F.concat(
        family,
        F.lit("|p="), lag.cast("string"),
        F.lit("|r="), F.coalesce(plain_number(radius), F.lit("none")),
        F.lit("|a="), plain_number(alpha),
        F.lit("|k="), rules.cast("string"),
    )


def digest(*parts: Column) -> Column:
    """SHA-256 of the parts joined by '|'."""
    return F.sha2(F.concat_ws("|", *[p.cast("string") for p in parts]), 256)


def digest_head(*parts: Column) -> Column:
    """The first 32 bits of the MD5 of the parts joined by '|'."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *[p.cast("string") for p in parts])), 1, 8), 16, 10).cast("long")
