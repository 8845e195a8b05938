"""Mixing sources to target weights by pivotal dependent rounding.

A source's target divided by its size is the number of copies each of its
documents is due, at most ``most``. The whole part is given to all; the
fraction is rounded so that the words taken add up to the target but for at
most one document:

Two documents with fractions ``p, q`` and sizes ``a, b`` meet. Either mass moves
from the second to the first until one fraction is 0 or 1, or the other way,
always keeping ``p*a + q*b``. The direction is drawn so that each fraction's
expectation stays. One of the two is then whole, the other meets the next.
Each bucket of a source leaves at most one document with a fraction; these meet
in a tree of ``FAN``-way merges, whose levels are ordinary grouped jobs.

A source is cut into buckets by a hash of its rows, so a hot source is many
groups; the draws are hashes of the ids, so reruns agree. Repeated rows, and rows
of a NULL id, are numbered and rounded one by one.

NULL texts have size 0 and are taken zero times; NULL is a source of its own,
the last one.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidefold.llm.common import table
from tidefold.operators.ordered import number_rows
from tidefold.session import store

WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
MOST = 2.0
BUCKET_ROWS = 50_000
FAN = 64
WORDS = r"[^\x20\x09-\x0D]+"


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """Add ``target`` to one row a source (source, source_size).

    With the excess over the cap dealt again by weight, targets end as
    ``min(cap, level * weight)``; sources reach their caps in the order of cap by
    weight, so running sums in that order give the level. Both windows run over
    one row a source.
    """
    ordered = Window.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(ordered) - 1) % len(weights)
    weighed = sizes.withColumn("_w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn + 1).cast("int"))).withColumn(
        "_cap", F.col("source_size") * F.lit(float(most))
    )
    everything = Window.partitionBy()
    filling = Window.orderBy(F.col("_cap") / F.col("_w"), "_w", F.col("source").asc_nulls_last())
    earlier = filling.rowsBetween(Window.unboundedPreceding, -1)
    # The level if this source and all later ones are below their caps.
    level = (F.sum("source_size").over(everything) * F.lit(float(share)) - F.coalesce(F.sum("_cap").over(earlier), F.lit(0.0))) / F.sum("_w").over(
        filling.rowsBetween(0, Window.unboundedFollowing)
    )
    stepped = weighed.withColumn("_level", level).withColumn("_open", F.col("_cap") > F.col("_level") * F.col("_w"))
    reached = F.max(F.when(F.col("_open"), F.col("_level"))).over(everything)
    return stepped.withColumn("target", F.least("_cap", F.coalesce(reached * F.col("_w"), F.col("_cap")))).select("source", "source_size", "target")


def pivot(key: np.ndarray, size: np.ndarray, part: np.ndarray) -> tuple[np.ndarray, int]:
    """Round ``part`` one pair after another; returns it and the row that keeps a fraction (-1: none)."""
    out = part.copy()
    draw = (key.astype(np.uint64) >> np.uint64(11)).astype(float) / float(1 << 53)
    held = -1
    for i in np.flatnonzero((part > 0) & (part < 1) & (size > 0)).tolist():
        if held < 0:
            held = i
            continue
        p, q, a, b = out[held], out[i], size[held], size[i]
        up = min((1 - p) * a, q * b)  # moved to the held one
        down = min(p * a, (1 - q) * b)
        if draw[i] * (up + down) < down:
            p, q = (1.0, q - up / b) if up == (1 - p) * a else (p + up / a, 0.0)
        else:
            p, q = (0.0, q + down / b) if down == p * a else (p - down / a, 1.0)
        p, q = min(max(p, 0.0), 1.0), min(max(q, 0.0), 1.0)
        out[held], out[i] = p, q
        held = held if 0 < p < 1 else i if 0 < q < 1 else -1
    return out, held


def _round_group(columns: list[str]):
    def rounded(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["_key", *columns], kind="stable")
        part, held = pivot(group["_key"].to_numpy(), group["size"].to_numpy(float), group["_part"].to_numpy(float))
        group["_part"] = part
        group["_open"] = np.arange(len(group)) == held
        return group

    return rounded


def copies(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST, bucket_rows: int = BUCKET_ROWS, seed: int = 0) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies) for each row of ``docs(doc_id, source, text)``."""
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), size_of(F.col("text").cast("string")).alias("size"))
    # Rows of one id, source and size are alike here: counted with partial sums, then told apart by a number, so they fall in many buckets.
    alike = store(base.groupBy("doc_id", "source", "size").agg(F.count("*").alias("_times")))
    by_source = alike.groupBy("source").agg(F.sum(F.col("size") * F.col("_times")).alias("source_size"), F.sum("_times").alias("_rows"))
    sized = alike.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_times")))).drop("_times")
    goal = targets(by_source.select("source", "source_size"), weights, share, most)
    # Below the bound every broadcast is Spark's own decision by size.
    goal = by_source.withColumnRenamed("source", "_s").join(goal.drop("source_size").withColumnRenamed("source", "_t"), F.col("_s").eqNullSafe(F.col("_t"))).select(
        "_s", "source_size", "target", F.ceil(F.col("_rows") / bucket_rows).alias("_buckets")
    )
    due = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    key = F.xxhash64(F.lit(seed), "doc_id", "size", "source", "_copy")
    rows = (
        sized.join(goal, F.col("source").eqNullSafe(F.col("_s")))
        .drop("_s")
        .withColumn("_whole", F.floor(due))
        .withColumn("_part", due - F.col("_whole"))
        .withColumn("_key", key)
        .withColumn("_bucket", F.pmod(F.xxhash64(F.lit(seed + 1), "_key"), F.col("_buckets")))
        .drop("_buckets", "_copy")
    )
    schema = rows.withColumn("_open", F.lit(False)).schema
    by_turn = _round_group(["doc_id", "size"])
    rounded = store(rows.groupBy("source", "_bucket").applyInPandas(by_turn, schema))
    done, open_rows = [rounded.filter(~F.col("_open"))], rounded.filter("_open").drop("_open")
    while True:
        # At most one row a bucket is left; a level of the tree divides them by FAN.
        left = store(open_rows.withColumn("_bucket", F.floor(F.col("_bucket") / FAN)).groupBy("source", "_bucket").applyInPandas(by_turn, schema))
        done.append(left.filter(~F.col("_open")))
        open_rows = left.filter("_open").drop("_open")
        if open_rows.filter("_bucket > 0").isEmpty():
            break
    # One row a source keeps a fraction: it is rounded by its own draw.
    drawn = F.shiftrightunsigned(F.xxhash64(F.lit(seed + 2), "_key"), 11) / F.lit(float(1 << 53))
    done.append(open_rows.withColumn("_part", F.when(drawn < F.col("_part"), 1.0).otherwise(0.0)).withColumn("_open", F.lit(False)))
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.select("doc_id", "source", "size", "source_size", "target", (F.col("_whole") + F.round("_part")).cast("int").alias("copies"))


def mixed(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with each row as often as the mix takes it; columns unchanged.

    Rows that share id, source and size get their copies in the order of their
    texts' hashes. They are only put in order where they are not all taken equally
    often, and then in 256 parts by that hash.
    """
    same = ["id", "source", "size"]
    # The given row is packed, so that no helper column can clash with its columns.
    own = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("id"), F.col("source").cast("string").alias("source"),
        size_of(F.col("text").cast("string")).alias("size"), F.xxhash64(F.col("text").cast("string")).alias("hash"),
    ).withColumn("key", F.to_json(F.struct(*same), {"ignoreNullFields": "false"}))
    taken = (
        copies(docs, **options).withColumnRenamed("doc_id", "id").withColumn("key", F.to_json(F.struct(*same), {"ignoreNullFields": "false"}))
        .groupBy("key", "copies").agg(F.count("*").alias("n"))
    )
    # At most three numbers of copies a key.
    each = taken.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("copies", "n"))).alias("each"))
    one, several = each.filter(F.size("each") == 1), each.filter(F.size("each") > 1)
    alike = own.join(one, "key").select("row", F.col("each")[0]["copies"].alias("times"))
    placed = number_rows(own.join(several, "key"), ["key"], [F.col("hash")], F.shiftright("hash", 56), "place").withColumn(
        "before", F.transform("each", lambda e, i: F.aggregate(F.slice("each", 1, i), F.lit(0).cast("long"), lambda t, x: t + x["n"]))
    )
    turn = F.size(F.filter("before", lambda v: v <= F.col("place"))) - 1
    unlike = placed.select("row", F.get("each", turn)["copies"].alias("times"))
    repeated = alike.unionByName(unlike).select("row", F.explode(F.array_repeat(F.lit(1), F.col("times"))).alias("one"))
    return repeated.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = copies(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).cast("long").alias("taken"))


CHECKS = {"op3_mixing": (op3, None)}
