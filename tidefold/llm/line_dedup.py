"""Near-equal lines over the whole corpus: one line of each component stays.

Lines are cut at ``\\n``, lower-cased for comparing, and count if they hold a
character that is no ASCII white space. A line's shingles are all runs of
``SHINGLE`` characters of it with a space put in front; a shorter line is one
shingle. Two lines are near-equal from a Jaccard similarity of ``SIMILAR`` on.

**Signatures.** All shingles of a line are hashed and sorted, as the line passes: the
lines are read again where their text is wanted and never stored as a whole. ``BANDS`` rotations of
the hash space are as many orders of them; the smallest ``ROWS`` of each order, read
off the one sorted array, are one band. Lines at the threshold share a band with a
chance of about 1 - (1 - 0.8**3)**10, which is 0.999, whatever their words and spaces.

**Candidates.** Lines that are equal have one key, so copies cost nothing. Below a
shared band each key is compared with one center, and keys that are not near it
with a second center. The components that these links give over all buckets say
which pairs need no comparison: a bucket of near-equal lines is one component by
its first center, so no pairs of a large group are made. In a bucket of several
components every pair of keys of different components is compared, in pairs of
blocks of about ``BLOCK_KEYS`` keys. So each pair of a bucket is compared or already
connected.

**Sketches.** A line that shares a bucket has its number of shingles and a bitmap of
their hashes. They bound the similarity from above, so a pair that they rule out
is below the threshold for certain and its text is not fetched.

**Verification** is on whole shingle sets, and near-equal pairs are joined by
distributed union-find. The line that stays is the one of the smallest
(doc_id, line number). All expressions are Spark's own.

NULL and empty texts have no lines. Rows that repeat a doc_id have the same
places and stay alike. A NULL doc_id is the smallest.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidefold.functions.arrays import let
from tidefold.llm.common import table
from tidefold.llm.components import components
from tidefold.llm.jaccard_join import in_blocks
from tidefold.session import store

SHINGLE = 9
SIMILAR = 0.8
BANDS, ROWS = 10, 3
BLOCK_KEYS = 1_024
# Words of 64 bits in the bitmap of a line's shingles, and in that of all wanted keys.
WORDS, KEY_WORDS = 16, 1 << 18


def lines_of(docs: DataFrame) -> DataFrame:
    """(doc_id, line_no, line) of every line with a word, lower-cased."""
    return (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.posexplode_outer(F.split(F.lower(F.col("text").cast("string")), "\n", -1)).alias("line_no", "line"))
        .filter(F.col("line").rlike(r"[^\x20\x09-\x0D]"))
    )


def key_of(line: Column) -> Column:
    return F.xxhash64(line)


def hashes(line: Column) -> Column:
    """Hash of every shingle of a line, repeats included; a line shorter than one is hashed whole.

    Each character takes four bytes in UTF-32, so a shingle is a cut of fixed place and length.
    """
    wide = 4 * SHINGLE

    def each(code: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.length(code) - (wide - 1), F.lit(4)), lambda at: F.xxhash64(F.substring(code, at, F.lit(wide))))

    cut = let(F.encode(F.concat(F.lit(" "), line), "UTF-32"), each)
    return F.when(F.length(line) >= SHINGLE - 1, cut).otherwise(F.array(F.xxhash64(F.encode(line, "UTF-32"))))


def shingles(line: Column) -> Column:
    """Distinct hashes of a line's shingles."""
    return F.array_distinct(hashes(line))


def signature(line: Column) -> Column:
    """Number of shingles and the BANDS band keys of a line.

    There are no lambdas and no branches around the arrays, so the expressions are compiled and those that repeat are worked out once.
    """
    starts = [-(1 << 63) + k * ((1 << 64) // BANDS) for k in range(BANDS)]
    ordered = F.sort_array(shingles(line))
    # Places of the starting points: sorted in among the hashes, less the points before them.
    merged = F.sort_array(F.concat(ordered, F.array(*[F.lit(x) for x in starts])))
    around = F.concat(ordered, F.slice(ordered, 1, ROWS), F.slice(ordered, 1, ROWS), F.slice(ordered, 1, ROWS))
    bands = [F.xxhash64(F.lit(k), F.slice(around, F.array_position(merged, starts[k]).cast("int") - k, ROWS)) for k in range(BANDS)]
    return F.struct(F.size(ordered).alias("size"), F.array(*bands).alias("bands"))


def near(left: Column, right: Column, n: Column, m: Column) -> Column:
    """Whether the shingle sets of two lines, of ``n`` and ``m`` shingles, reach the threshold."""
    return let(F.size(F.array_intersect(hashes(left), hashes(right))), lambda both: both >= F.lit(SIMILAR) * (n + m - both))


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """``pairs(a, b)`` that are near-equal by ``texts(key, line, size)``; lines travel, their sets are made where they meet."""
    left = texts.select(F.col("key").alias("a"), F.col("line").alias("_left"), F.col("size").alias("_n"))
    right = texts.select(F.col("key").alias("b"), F.col("line").alias("_right"), F.col("size").alias("_m"))
    met = pairs.select("a", "b").distinct().join(left, "a").join(right, "b")
    return met.filter(near(F.col("_left"), F.col("_right"), F.col("_n"), F.col("_m"))).select("a", "b")


def _bit(place: Column) -> Column:
    """The bit of a place in its word of 64."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), place.bitwiseAND(F.lit(63)).cast("int"))


def among(lines: DataFrame, keys: DataFrame) -> DataFrame:
    """``lines(key, ..)`` without most of those whose key is not in ``keys(key)``, by a bitmap of bounded size; none of ``keys`` is lost."""
    place = F.pmod(F.col("key"), F.lit(KEY_WORDS * 64))
    word = F.shiftright(place, 6).alias("_word")
    seen = keys.groupBy(word).agg(F.bit_or(_bit(place)).alias("_seen"))
    met = lines.withColumn("_word", word).join(F.broadcast(seen), "_word")
    return met.filter(F.col("_seen").bitwiseAND(_bit(place)) != 0).drop("_word", "_seen")


def _word(cells: Column) -> Column:
    """The bits of one word, set one after another."""
    return F.aggregate(cells, F.lit(0).cast("long"), lambda word, cell: word.bitwiseOR(_bit(F.shiftright(cell, 1))))


def sketches(texts: DataFrame) -> DataFrame:
    """(key, line, size, ones, w0, w1, ..): number of distinct shingles of each line, and a bitmap of WORDS words of their hashes with its number of ones."""
    found = texts.select("key", "line", shingles(F.col("line")).alias("found"))
    cells = found.select("key", "line", F.size("found").alias("size"), F.array_distinct(F.transform("found", lambda h: h.bitwiseAND(F.lit(WORDS * 64 - 1)).cast("int"))).alias("cells"))
    # Cell c is 2 c + 1, between the even bounds of its word; steps of their own, as what is used often is worked out once.
    bounds = [F.array_position("ordered", 128 * k).cast("int") for k in range(WORDS + 1)]
    ordered = F.sort_array(F.concat(F.transform("cells", lambda c: c * 2 + 1), F.array(*[F.lit(128 * k) for k in range(WORDS + 1)])))
    dealt = cells.select("key", "line", "size", F.size("cells").alias("ones"), ordered.alias("ordered")).select(
        "key", "line", "size", "ones", F.array(*[F.slice("ordered", a + 1, b - a - 1) for a, b in zip(bounds[:-1], bounds[1:])]).alias("dealt")
    )
    return dealt.select("key", "line", "size", "ones", *[_word(F.get("dealt", F.lit(k))).alias(f"w{k}") for k in range(WORDS)])


def sized(left: Column, right: Column) -> Column:
    """Whether sets of these sizes can reach the threshold."""
    return F.least(left, right) >= F.lit(SIMILAR) * F.greatest(left, right)


def possible(left: str, right: str) -> Column:
    """Whether the sets of two sketches can reach the threshold: a bit that only one of them has is a shingle that the other lacks."""
    n, m, n_ones, m_ones = (F.col(f"{side}.{c}") for c in ("size", "ones") for side in (left, right))
    shared = reduce(lambda x, y: x + y, [F.bit_count(F.col(f"{left}.w{k}").bitwiseAND(F.col(f"{right}.w{k}"))) for k in range(WORDS)])
    most = F.least(n - n_ones, m - m_ones) + shared
    # most / (n + m - most) against the threshold; the small number keeps rounding from ruling a pair out.
    return sized(n, m) & (most * (1 + SIMILAR) + 1e-6 >= F.lit(SIMILAR) * (n + m))


def _hopeful(pairs: DataFrame, known: DataFrame) -> DataFrame:
    """Distinct ``pairs(a, b)`` whose sketches allow the threshold."""
    once = pairs.select("a", "b").distinct().alias("p")
    met = once.join(known.alias("l"), F.col("p.a") == F.col("l.key")).join(known.alias("r"), F.col("p.b") == F.col("r.key"))
    return met.filter(possible("l", "r")).select("p.a", "p.b")


def _center(members: DataFrame, turn: int) -> DataFrame:
    """``members(bucket, key)`` with the bucket's center for this turn, for buckets of two keys or more."""
    order = F.xxhash64(F.lit(turn), "key")
    centers = members.groupBy("bucket").agg(F.min_by("key", order).alias("center"), F.count("*").alias("n"))
    return members.join(centers.filter("n > 1").select("bucket", "center"), "bucket")


def _unconnected(members: DataFrame, roots: DataFrame, known: DataFrame) -> DataFrame:
    """Pairs (a, b) of ``members(bucket, key)`` that share a bucket, are not connected by ``roots`` and can reach the threshold by their sketches."""
    placed = members.join(roots.withColumnRenamed("node", "key"), "key", "left").withColumn("part", F.coalesce("root", "key")).drop("root")
    mixed = (
        placed.groupBy("bucket").agg(F.min("part").alias("low"), F.max("part").alias("high"), F.count("*").alias("n")).filter("low != high")
        .select("bucket", F.ceil(F.col("n") / BLOCK_KEYS).alias("blocks"))
    )
    rows = in_blocks(placed.join(mixed, "bucket"), "bucket", "blocks", "key").select("group", "pair", "own", "key", "part")
    rows = store(rows.join(known, "key"))
    left, right = rows.alias("l"), rows.alias("r")
    once = F.when(F.col("l.pair"), F.col("l.own") < F.col("r.own")).otherwise(F.col("l.key") < F.col("r.key"))
    met = left.join(right, (F.col("l.group") == F.col("r.group")) & (F.col("l.part") != F.col("r.part")) & once & possible("l", "r"))
    return met.select(F.least("l.key", "r.key").alias("a"), F.greatest("l.key", "r.key").alias("b"))


def signed_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, line_no, key, bands) of every line with a word, stored; the lines themselves are not."""
    lines = lines_of(docs).select("doc_id", "line_no", key_of(F.col("line")).alias("key"), signature(F.col("line")).alias("s"))
    return store(lines.select("doc_id", "line_no", "key", "s.bands"))


def near_lines(docs: DataFrame, signed: DataFrame | None = None) -> DataFrame:
    """(a, b): verified near-equal keys, enough of them to connect every component that the bands show."""
    signed = signed_lines(docs) if signed is None else signed
    bands = [F.min(F.get("bands", F.lit(k))).alias(f"b{k}") for k in range(BANDS)]
    rows = signed.groupBy("key").agg(*bands).select("key", F.explode(F.array(*[f"b{k}" for k in range(BANDS)])).alias("bucket"))
    bucket = Window.partitionBy("bucket")
    shared = rows.filter("bucket is not null").withColumn("low", F.min("key").over(bucket)).withColumn("high", F.max("key").over(bucket))
    members = store(shared.filter("low != high").select("bucket", "key"))
    wanted = store(members.select("key").distinct())
    lines = lines_of(docs).select(key_of(F.col("line")).alias("key"), "line")
    texts = store(sketches(among(lines, wanted).join(wanted, "key").dropDuplicates(["key"])))
    known = texts.drop("line")
    found, left = [], members
    for turn in range(2):
        placed = _center(left, turn).filter("key != center")
        found.append(store(verified(_hopeful(placed.select(F.col("center").alias("a"), F.col("key").alias("b")), known), texts)))
        settled = found[-1].select(F.col("a").alias("center"), F.col("b").alias("key"))
        left = store(placed.join(settled, ["center", "key"], "left_anti").select("bucket", "key"))
    roots = store(components(reduce(DataFrame.unionByName, found)))
    # A key near a center may be near to others that the center is not near to.
    found.append(verified(_unconnected(members, roots, known), texts))
    return reduce(DataFrame.unionByName, found)


def line_classes(docs: DataFrame) -> DataFrame:
    """Every line with a word: (doc_id, line_no, class_id, class_lines, kept)."""
    signed = signed_lines(docs)
    roots = store(components(near_lines(docs, signed)))
    placed = signed.select("doc_id", "line_no", "key")
    classes = placed.groupBy("key").agg(F.min(F.struct("doc_id", "line_no")).alias("first"), F.count("*").alias("n"))
    rooted = classes.join(roots.withColumnRenamed("node", "key"), "key", "left").withColumn("class_id", F.coalesce("root", "key"))
    whole = rooted.filter("root is not null").groupBy("class_id").agg(F.min("first").alias("_first"), F.sum("n").alias("_n"))
    known = rooted.join(whole, "class_id", "left").select(
        "key", "class_id", F.coalesce("_first", "first").alias("first"), F.coalesce("_n", "n").alias("class_lines")
    )
    return placed.join(known, "key").select(
        "doc_id", F.col("line_no").cast("long").alias("line_no"), "class_id", "class_lines", (F.struct("doc_id", "line_no").eqNullSafe(F.col("first"))).alias("kept")
    )


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_classes(table(spark, sf_dir, "documents"))


CHECKS = {"op7_line_dedup": (op7, None)}
