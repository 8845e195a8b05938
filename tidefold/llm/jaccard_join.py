"""Near copies of texts: MinHash LSH forest over word shingles, then exact Jaccard.

Words are as in ``decontaminate``; a shingle is ``SHINGLE`` consecutive words, a
text of fewer words is one shingle. Texts with the same set of shingles are one
class (their similarity is 1), so exact copies are counted and not compared.

**Forest.** Every class has ``TREES`` labels of ``DEPTH`` MinHash values. A tree is
the trie of its labels in sorted order; classes below one trie node share a
prefix. Prefixes start at full depth and are shortened by one until the
expected recall is reached: each found link of similarity ``J`` had the chance
``1 - (1 - J**k)**TREES`` of being found at prefix length ``k``, which gives the
share that is still missing. The descent ends where that share is small enough and
this chance is at least ``RECALL`` for a link right at the threshold too, so the
result does not hang on how similar most of the found links are. At 0.8 that takes
the prefixes down to length 3, which a link misses in all trees once in 23,000 times.

Below a node, classes are gathered around pivots: one at an estimated similarity
of ``NEAR`` or more needs no pivot of its own, one at ``FAR`` or more is tied to the
pivot. Jaccard distance is a metric, so two classes at 0.8 of which one is within
0.2 of the pivot are both within 0.4 of it; the bounds leave room for the error
of the estimate. What leaves the task is one tie for each class, to the smallest
class it is tied to directly or through others; no pairs do.

**Verification.** Tied classes form families. In a family all pairs are compared by
their whole shingle sets, in blocks of bounded size, and each class gets the
number of its links. A family of ``m`` classes costs ``m**2`` comparisons, which a
count of all its links asks for, but never ``m**2`` rows.

Texts without a word are linked to nothing and are a class of their own.
Repeated rows are copies of each other. A class is known by a 64-bit hash of its
shingle set.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tidefold.llm import bytewords as bw
from tidefold.llm.common import free_prefix, lean, table
from tidefold.llm.components import components
from tidefold.llm.grouped import groups
from tidefold.session import spread_keys, store

SHINGLE = 5
SIMILAR = 0.8
TREES, DEPTH = 14, 6
RECALL = 0.9999
NEAR, FAR = 0.87, 0.45
NODE_ROWS = 2_048
BLOCK_SHINGLES = 1 << 20
SLICE = 2 << 20
# A character of a word: ``bytewords.ALNUM``.
WORDED = r"[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]"

_draws = np.random.default_rng(20_240_229)
_FACTOR = _draws.integers(1, 1 << 63, TREES * DEPTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFT = _draws.integers(0, 1 << 63, TREES * DEPTH, dtype=np.uint64)


def chance(similarity, prefix: int):
    """That two classes of this similarity share a prefix of this length in some tree."""
    return 1 - (1 - similarity**prefix) ** TREES


def shortest_prefix(threshold: float, recall: float) -> int:
    return next((k for k in range(DEPTH, 0, -1) if chance(threshold, k) >= recall), 1)


def shingle_sets(texts: pa.Array):
    """The sorted distinct shingle hashes of each text."""
    for a, b in bw.slices(texts, SLICE):
        w = bw.split(texts.slice(a, b - a), bw.ALNUM)
        whole = bw.runs(w.key, SHINGLE)
        for lo, hi in zip(w.first[:-1].tolist(), w.first[1:].tolist()):
            if hi - lo >= SHINGLE:
                yield np.unique(whole[lo : hi - SHINGLE + 1])
            else:
                yield bw.runs(w.key[lo:hi], hi - lo) if hi > lo else whole[:0]


def class_key(shingles: np.ndarray) -> int:
    """Signed 64-bit hash of a sorted set."""
    turned = bw.mix(shingles + bw.STEP)
    h = np.add.reduce(turned, keepdims=True) * bw.STEP + np.bitwise_xor.reduce(turned, keepdims=True)
    return int(bw.mix(h + np.uint64(len(shingles)))[0].astype(np.int64))


def labels(shingles: np.ndarray) -> np.ndarray:
    """TREES * DEPTH MinHash values of 32 bits."""
    low = np.full(TREES * DEPTH, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 1024):
        np.minimum(low, (shingles[at : at + 1024, None] * _FACTOR + _SHIFT).min(axis=0), out=low)
    return (low >> np.uint64(32)).astype("<u4")


def _signatures(batches):
    for batch in batches:
        node, size, sig = [], [], []
        for shingles in shingle_sets(batch.column("text")):
            node.append(class_key(shingles) if len(shingles) else None)
            size.append(len(shingles))
            sig.append(labels(shingles).tobytes() if len(shingles) else None)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("text_hash"), pa.array(node, pa.int64()), pa.array(size, pa.int64()), pa.array(sig, pa.binary())],
            ["doc_id", "text_hash", "node", "shingles", "sig"],
        )


def signatures(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    return own.mapInArrow(lean(_signatures), "doc_id long, text_hash long, node long, shingles long, sig binary")


def _ties(prefix: int):
    def tie(batches):
        for part in groups(batches, "group"):
            sig = np.frombuffer(b"".join(part.column("sig").to_pylist()), "<u4").reshape(part.num_rows, -1)
            nodes = part.column("node").to_numpy()
            order = np.lexsort([nodes, *sig.T[::-1]])
            sig, nodes = sig[order], nodes[order]
            free, home = np.ones(len(nodes), bool), np.arange(len(nodes))
            found = expected = 0.0
            for p in range(len(nodes)):
                if not free[p]:
                    continue
                same = sig == sig[p]
                alike = same.mean(axis=1)
                alike[p] = 0.0
                free[p] = False
                free &= alike < NEAR
                tied = np.flatnonzero(alike >= FAR)
                if len(tied):
                    # Links of this pivot, each counted once over the trees that show it.
                    linked = tied[alike[tied] >= SIMILAR]
                    shared = same[linked].reshape(len(linked), TREES, DEPTH)[:, :, :prefix].all(axis=2).sum(axis=1)
                    found += (1.0 / np.maximum(shared, 1)).sum()
                    expected += (1.0 / np.maximum(shared, 1) / chance(alike[linked], prefix)).sum()
                    met = np.unique(home[np.append(tied, p)])
                    home[np.isin(home, met)] = met[0]
                    if (home == home[0]).all():
                        break  # all are tied to each other through what was seen
            lowest = np.full(len(nodes), np.iinfo(np.int64).max)
            np.minimum.at(lowest, home, nodes)
            member = np.flatnonzero(nodes != lowest[home])
            if len(member):
                first = np.arange(len(member)) == 0
                yield pa.RecordBatch.from_arrays(
                    [pa.array(lowest[home][member]), pa.array(nodes[member]), pa.array(np.where(first, found, 0.0)), pa.array(np.where(first, expected, 0.0))],
                    ["a", "b", "found", "expected"],
                )

    return tie


def in_blocks(rows: DataFrame, key: str, blocks, member: str) -> DataFrame:
    """Repeat each row for every pair of blocks of its key; ``group`` is one such pair, ``own`` its block.

    ``blocks`` is the number of blocks of the row's key, one for all but large keys.
    """
    own = F.pmod(F.xxhash64(F.lit(11), member), F.col(blocks)).cast("int")
    low, high = F.least("own", "other"), F.greatest("own", "other")
    return (
        rows.withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), (F.col(blocks) - 1).cast("int"))))
        .withColumn("group", F.xxhash64(key, low, high))
        .withColumn("pair", low != high)
        .drop("other")
    )


def forest_ties(classes: DataFrame, prefix: int) -> DataFrame:
    """Ties (a, b, found, expected) below the trie nodes at one prefix length."""
    label = F.expr(f"substring(sig, tree * {DEPTH * 4} + 1, {prefix * 4})")
    leaves = classes.select("node", "sig", F.explode(F.sequence(F.lit(0), F.lit(TREES - 1))).alias("tree"))
    keyed = leaves.select("node", F.xxhash64("tree", label).alias("trie"), "sig")
    counted = (
        keyed.groupBy("trie").agg(F.count("*").alias("n")).filter("n > 1")
        .select("trie", F.ceil(F.col("n") / NODE_ROWS).alias("blocks"))
    )
    shared = in_blocks(keyed.select("node", "trie").join(counted, "trie"), "trie", "blocks", "node")
    # Signatures join only the rows that share a trie node with another.
    rows = shared.select("node", "group").join(classes.select("node", "sig"), "node")
    return spread_keys(rows, "group").sortWithinPartitions("group").mapInArrow(lean(_ties(prefix)), "a long, b long, found double, expected double")


def families(classes: DataFrame, threshold: float = SIMILAR, recall: float = RECALL) -> DataFrame:
    """(node, root): classes tied directly or through others."""
    ties = []
    for prefix in range(DEPTH, shortest_prefix(threshold, recall) - 1, -1):
        seen = Observation()
        ties.append(store(forest_ties(classes, prefix).observe(seen, F.sum("found").alias("found"), F.sum("expected").alias("expected"))))
        found, expected = seen.get["found"], seen.get["expected"]
        if expected and found / expected >= recall and chance(threshold, prefix) >= recall:
            break
    out = ties[0]
    for more in ties[1:]:
        out = out.unionByName(more)
    return components(out.select("a", "b"))


def common(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the left with the right sets."""
    if len(left) * len(right) <= 64:
        return np.asarray([[len(np.intersect1d(sets[i], sets[j], True)) for j in right] for i in left], np.int64).reshape(len(left), len(right))
    member = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    keep = times[column] > 1
    member, column = member[keep], column[keep]
    order = np.argsort(column, kind="stable")
    member, column = member[order], column[order]
    _, column = np.unique(column, return_inverse=True)
    out = np.zeros((len(left), len(right)), np.float64)
    wide = 2048
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, wide):
        a, b = np.searchsorted(column, [at, at + wide])
        tile = np.zeros((len(sets), wide), np.float32)
        tile[member[a:b], column[a:b] - at] = 1.0
        out += tile[left] @ tile[right].T
    return out.astype(np.int64)


def least_common(total: np.ndarray, threshold: float) -> np.ndarray:
    """The smallest intersection of two sets of ``total`` members together whose Jaccard similarity is at least ``threshold``.

    The threshold is the decimal as written (0.9 is nine tenths), and the bound is worked out
    in whole numbers of any size, once for each total.
    """
    share = Fraction(repr(float(threshold)))
    sums, at = np.unique(total, return_inverse=True)
    # both / (total - both) >= share
    least = [-(-share.numerator * int(s) // (share.numerator + share.denominator)) for s in sums]
    return np.asarray(least, np.int64)[at].reshape(np.shape(total))


def _links(threshold: float):

    def count(batches):
        for part in groups(batches, "group"):
            nodes, first = np.unique(part.column("node").to_numpy(), return_index=True)
            if len(nodes) < 2:
                continue
            copies, own = (part.column(c).to_numpy()[first] for c in ("copies", "own"))
            held = part.column("set").combine_chunks()
            sets = [np.frombuffer(held[int(i)].as_py(), np.uint64) for i in first]
            crossing = part.column("pair")[0].as_py()
            left = np.flatnonzero(own == own.min()) if crossing else np.arange(len(nodes))
            right = np.flatnonzero(own != own.min()) if crossing else left
            if not len(left) or not len(right):
                continue
            size = np.asarray([len(s) for s in sets])
            both = common(sets, left, right)
            (one, row), (two, column) = (np.unique(size[side], return_inverse=True) for side in (left, right))
            linked = both >= least_common(one[:, None] + two[None], threshold)[row][:, column]
            if not crossing:
                np.fill_diagonal(linked, False)
            for side, other, met in ((left, right, linked), (right, left, linked.T))[: 1 + crossing]:
                some = np.flatnonzero(met.any(axis=1))
                lowest = np.where(met[some], nodes[other][None], np.iinfo(np.int64).max).min(axis=1)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(nodes[side][some]), pa.array(lowest), pa.array(met[some].sum(axis=1)), pa.array(met[some] @ copies[other])],
                    ["node", "other", "text_links", "row_links"],
                )

    return count


def _sets(batches):
    for batch in batches:
        sets = list(shingle_sets(batch.column("text")))
        keep = [k for k, (s, node) in enumerate(zip(sets, batch.column("node").to_pylist())) if len(s) and class_key(s) == node]
        yield pa.RecordBatch.from_arrays(
            [batch.column("node").take(pa.array(keep, pa.int64())), pa.array([sets[k].tobytes() for k in keep], pa.binary())], ["node", "set"]
        )


def links(docs: DataFrame, classes: DataFrame, tied: DataFrame, threshold: float = SIMILAR) -> DataFrame:
    """(node, other, text_links, row_links) of verified links; ``other`` is a linked node of the same component."""
    sized = classes.join(tied, "node").select("node", "root", "copies", "first", "shingles")
    blocks = sized.groupBy("root").agg(F.ceil(F.sum("shingles") / BLOCK_SHINGLES).alias("blocks"))
    text = F.col("text").cast("string")
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_hash"))
    # One text for each class, by id and text, so that many rows of one id (NULL, say) meet only their own class.
    met = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("text_hash") == F.col("first.text_hash"))
    wanted = own.join(sized.select("node", "first"), met).groupBy("node").agg(F.first("text").alias("text"))
    sets = wanted.mapInArrow(lean(_sets), "node long, set binary")
    rows = in_blocks(sized.join(blocks, "root").join(sets, "node"), "root", "blocks", "node").select("group", "pair", "own", "node", "copies", "set")
    return spread_keys(rows, "group").sortWithinPartitions("group").mapInArrow(lean(_links(threshold)), "node long, other long, text_links long, row_links long")


def _compared(docs: DataFrame, threshold: float, recall: float) -> tuple[DataFrame, DataFrame]:
    """(signed rows, one row for each class: node, component, class_id, n_links, n_text_links)."""
    signed = store(signatures(docs))
    classes = store(
        signed.filter("node is not null").groupBy("node")
        .agg(
            F.count("*").alias("copies"), F.min("doc_id").alias("first_id"), F.min(F.struct("doc_id", "text_hash")).alias("first"),
            F.first("shingles").alias("shingles"), F.first("sig").alias("sig"),
        )
    )
    found = store(links(docs, classes, families(classes, threshold, recall), threshold))
    counts = found.groupBy("node").agg(F.sum("text_links").alias("text_links"), F.sum("row_links").alias("row_links"))
    roots = components(found.select(F.col("node").alias("a"), F.col("other").alias("b")))
    light = classes.select("node", "copies", "first_id")
    linked = light.join(roots, "node").join(counts, "node")
    class_id = linked.groupBy("root").agg(F.min("first_id").alias("class_id"))
    linked = linked.join(class_id, "root").select("node", "root", "class_id", "text_links", "row_links")
    each = light.join(linked, "node", "left").select(
        "node",
        F.coalesce("root", "node").alias("component"),
        F.when(F.col("root").isNull(), F.col("first_id")).otherwise(F.col("class_id")).alias("class_id"),
        (F.coalesce("row_links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        F.coalesce("text_links", F.lit(0)).alias("n_text_links"),
    )
    return signed, each


def near_copies(docs: DataFrame, threshold: float = SIMILAR, recall: float = RECALL) -> DataFrame:
    """For each row of ``docs(doc_id, text)``: class_id (smallest doc_id of its component of near copies), n_links
    (other rows at the threshold or above, copies included) and n_text_links (other texts)."""
    signed, each = _compared(docs, threshold, recall)
    return signed.select("doc_id", "node").join(each, "node", "left").select(
        "doc_id",
        F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("n_text_links", F.lit(0)).cast("long").alias("n_text_links"),
    )


def one_of_each(docs: DataFrame, threshold: float = SIMILAR, recall: float = RECALL) -> DataFrame:
    """One row of ``docs`` for each component of near copies: that of the smallest doc_id; columns unchanged.

    Rows are told apart by id and text, so unlinked texts of equal or NULL ids all stay. In a component a NULL id
    comes after the others, and among rows of one id the smallest text hash stays. Texts without a word are
    linked to nothing, so all of their rows stay.
    """
    signed, each = _compared(docs, threshold, recall)
    versions = signed.filter("node is not null").groupBy("node", "doc_id", "text_hash").agg(F.count("*").alias("rows"))
    order = F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "text_hash", "rows")
    nodes = versions.groupBy("node").agg(F.min(order).alias("first"))
    staying = nodes.join(each.select("node", "component"), "node").groupBy("component").agg(F.min("first").alias("first"))
    p = free_prefix(docs)
    staying = store(staying.select(F.col("first.doc_id").alias(f"{p}id"), F.col("first.text_hash").alias(f"{p}text"), F.col("first.rows").alias(f"{p}rows")))
    text = F.col("text").cast("string")
    worded = F.coalesce(text, F.lit("")).rlike(WORDED)
    met = docs.filter(worded).join(staying, F.col("doc_id").cast("long").eqNullSafe(F.col(f"{p}id")) & (F.xxhash64(text) == F.col(f"{p}text")))
    once = met.filter(F.col(f"{p}rows") == 1).select(*docs.columns)
    # Rows of one id and one text: the first of them.
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    first = met.filter(F.col(f"{p}rows") > 1).groupBy(f"{p}id", f"{p}text").agg(F.first(row).alias(f"{p}row"))
    again = first.select(*[F.col(f"{p}row").getField(c).alias(c) for c in docs.columns])
    return docs.filter(~worded).unionByName(once).unionByName(again)


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_copies(table(spark, sf_dir, "documents"))


CHECKS = {"op1_jaccard_join": (op1, None)}
