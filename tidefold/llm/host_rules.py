"""Quality rules judged by host: failures counted by source, rates shrunk, verdicts joined back.

A document fails a rule by its own text. For every host and rule the failure
rate is shrunk to a beta prior fitted to all hosts by its first two moments, so
a host of few documents is judged mostly by what hosts are like; a host whose
shrunk rate is above ``MOST`` for a rule is rejected with all its documents.
Documents that fail one of the hard rules (too short, too repetitive) go anyway.

All expressions are Spark's own. Windows of eight words are compared by 64-bit
hashes inside the row: ``array_distinct`` tells whether any occurs twice, and only
then are the places sorted, so no window ever leaves its document.

NULL and empty texts have no words and fail as short. NULL is a host like any
other. Repeated rows count one by one. Without rows there are no hosts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidefold.functions.arrays import let
from tidefold.llm.common import table
from tidefold.session import store

WINDOW = 8
FEWEST_WORDS, REPEATED, SYMBOLS, DUPLICATES = 20, 30, 10, 30
MOST = 0.5
RULES = ("short", "repetitive", "symbols", "duplicate_lines")
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def repeated_words(windows: Column) -> Column:
    """Number of words inside windows that occur twice or more; ``windows`` are hashes by place."""

    def covered(ordered: Column) -> Column:
        again = F.transform(
            ordered,
            lambda x, i: F.when((F.get(ordered, i - 1)["h"] == x["h"]) | (F.get(ordered, i + 1)["h"] == x["h"]), x["p"]),
        )
        places = F.sort_array(F.filter(again, lambda p: p.isNotNull()))
        step = lambda r: F.transform(r, lambda p, j: F.least(F.lit(WINDOW), F.coalesce(F.get(r, j + 1) - p, F.lit(WINDOW))))
        return let(places, lambda r: F.aggregate(step(r), F.lit(0).cast("long"), lambda a, b: a + b))

    ordered = F.sort_array(F.transform(windows, lambda h, p: F.struct(h.alias("h"), p.alias("p"))))
    return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0).cast("long")).otherwise(let(ordered, covered))


def measured(docs: DataFrame) -> DataFrame:
    """(doc_id, source, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines) of each row."""
    own = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    )
    hashed = own.select(
        "doc_id",
        "source",
        F.transform(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)), lambda w: F.xxhash64(w)).alias("words"),
        (F.char_length("text") - F.regexp_count("text", F.lit(SPACE))).cast("long").alias("word_chars"),
        F.regexp_count("text", F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.transform(F.filter(F.split("text", "\n", -1), lambda x: x.rlike(WORD)), lambda x: F.xxhash64(x)).alias("lines"),
    )
    windows = F.when(
        F.size("words") >= WINDOW,
        F.transform(F.sequence(F.lit(1), F.size("words") - WINDOW + 1), lambda i: F.xxhash64(F.slice("words", i, WINDOW))),
    ).otherwise(F.array().cast("array<bigint>"))
    return hashed.select("*", windows.alias("windows")).select(
        "doc_id",
        "source",
        F.size("words").cast("long").alias("n_words"),
        "word_chars",
        "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        repeated_words(F.col("windows")).alias("n_repeat_words"),
        F.size("lines").cast("long").alias("n_lines"),
    )


def failures() -> dict[str, Column]:
    c = F.col
    return {
        "short": c("n_words") < FEWEST_WORDS,
        "repetitive": 100 * c("n_repeat_words") > REPEATED * c("n_words"),
        "symbols": 100 * c("n_symbols") > SYMBOLS * c("word_chars"),
        "duplicate_lines": 100 * c("n_dup_lines") > DUPLICATES * c("n_lines"),
    }


def host_verdicts(flagged: DataFrame, most: float = MOST) -> DataFrame:
    """(source, docs, rate_<rule> for each rule, host_failed) from rows with a boolean column for each rule."""
    hosts = flagged.groupBy("source").agg(F.count("*").alias("docs"), *[F.count_if(r).alias(f"f_{r}") for r in RULES])
    share = lambda r: F.col(f"f_{r}") / F.col("docs")
    prior = hosts.agg(*[F.avg(share(r)).alias(f"m_{r}") for r in RULES], *[F.var_pop(share(r)).alias(f"v_{r}") for r in RULES])

    def rate(r: str) -> Column:
        mean, spread = F.col(f"m_{r}"), F.col(f"v_{r}")
        # Prior weight in documents; hosts that do not differ leave a firm prior.
        weight = F.when(spread > 0, F.least(F.greatest(mean * (1 - mean) / spread - 1, F.lit(1.0)), F.lit(1e6))).otherwise(F.lit(1e6))
        return (F.col(f"f_{r}") + mean * weight) / (F.col("docs") + weight)

    rates = hosts.crossJoin(F.broadcast(prior)).select("source", "docs", *[rate(r).alias(f"rate_{r}") for r in RULES])  # the prior is one row
    return rates.withColumn("host_failed", F.greatest(*[F.col(f"rate_{r}") for r in RULES]) > most)


def judged(docs: DataFrame, most: float = MOST) -> DataFrame:
    """Measures, rules, ``base_failed``, the host's verdict and ``kept`` for each row of ``docs(doc_id, source, text)``."""
    flagged = store(measured(docs).withColumns(failures()))
    verdicts = host_verdicts(flagged, most).select(F.col("source").alias("_host"), "host_failed")
    return (
        flagged.join(verdicts, F.col("source").eqNullSafe(F.col("_host")), "left")
        .withColumn("base_failed", F.col("short") | F.col("repetitive"))
        .withColumn("kept", ~F.col("base_failed") & ~F.col("host_failed"))
        .drop("_host")
    )


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (
    SELECT doc_id, source, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
           list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
    FROM d
), windows AS (
    SELECT doc_id, k, array_to_string(words[k : k + 7], ' ') AS run FROM w, LATERAL unnest(range(1, len(words) - 6)) AS t(k)
), twice AS (
    SELECT doc_id, k FROM (SELECT doc_id, k, count(*) OVER (PARTITION BY doc_id, run) AS n FROM windows) WHERE n > 1
), repeats AS (
    SELECT doc_id, count(DISTINCT p) AS n FROM twice, LATERAL unnest(range(k, k + 8)) AS t(p) GROUP BY doc_id
), m AS (
    SELECT w.doc_id, source, CAST(len(words) AS BIGINT) AS n_words,
           CAST(length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
           CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
           CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, coalesce(repeats.n, 0) AS n_repeat_words, len(lines) AS n_lines
    FROM w LEFT JOIN repeats USING (doc_id)
), f AS (
    SELECT *, n_words < 20 AS a, 100 * n_repeat_words > 30 * n_words AS b, 100 * n_symbols > 10 * word_chars AS c, 100 * n_dup_lines > 30 * n_lines AS e FROM m
), tall AS (
    SELECT source, rule, count(*) AS docs, count(*) FILTER (failed) AS failures
    FROM (SELECT source, unnest(['a', 'b', 'c', 'e']) AS rule, unnest([a, b, c, e]) AS failed FROM f) GROUP BY source, rule
), prior AS (SELECT rule, avg(failures / docs) AS mean, var_pop(failures / docs) AS spread FROM tall GROUP BY rule),
weighed AS (
    SELECT rule, mean, CASE WHEN spread > 0 THEN least(greatest(mean * (1 - mean) / spread - 1, 1.0), 1e6) ELSE 1e6 END AS weight FROM prior
), hosts AS (
    SELECT source, max((failures + mean * weight) / (docs + weight)) > 0.5 AS host_failed FROM tall JOIN weighed USING (rule) GROUP BY source
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, a OR b AS base_failed, NOT (a OR b) AND NOT host_failed AS kept
FROM f JOIN hosts ON f.source IS NOT DISTINCT FROM hosts.source
"""

CHECKS = {"op9_host_rules": (op9, SQL)}
