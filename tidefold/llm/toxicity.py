"""Toxicity of texts: logistic regression on hashed word n-grams, trained by FTRL-proximal.

Features of a text are the distinct hashes of its words, pairs of neighbours and
skip-grams over one word, ``2**BITS`` slots in all; words are as in
``decontaminate``. Each slot has its own learning rate, and the L1 term leaves
most weights at zero, so the trained model is one array of at most ``2**BITS``
floats: that size, and not the corpus, bounds what is broadcast.

Training uses at most ``MOST_ROWS`` labelled texts, those with the smallest hash
of id and text (a documented bound on the sample of labelled rows; scoring
covers every row). The sample is chosen from ids and hashes alone, by counts of hash
prefixes, and only the chosen texts are fetched. Rows that repeat an id and a text are
one example. FTRL takes one example after another, so the sample, as
integer slots, is learnt from in one task; its size is fixed by that bound.

The threshold on the score is ``CUT``. An empty, NULL or word-free text has the
score of the intercept alone. Labels that repeat an id count as toxic if one of
them does; ids without a document or with a NULL label are not learnt from.
Without any label the score is 0.5 everywhere (an untrained intercept).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidefold.llm import bytewords as bw
from tidefold.llm.common import free_prefix, give_back, in_fold, lean, table
from tidefold.operators.select import lowest_hashes
from tidefold.session import spread_keys, store

BITS = 20
MOST_ROWS = 12_288
ROUNDS = 3
ALPHA, BETA, L1, L2 = 1.0, 1.0, 6.0, 1.0
CUT = 0.3
SLICE = 1 << 20  # three features of some bytes a word: smaller slices than elsewhere


def features(w: bw.Words) -> tuple[np.ndarray, np.ndarray]:
    """(row, slot) of every word, neighbour pair and skip-gram; slot 0 is left to the intercept."""
    row, last, n = w.row_of(), w.last_of(), len(w.key)
    at = np.arange(n)
    rows, slots = [row], [w.key]
    for gap, salt in ((1, 1), (2, 2)):
        ok = np.flatnonzero(at + gap < last)
        rows.append(row[ok])
        slots.append(bw.mix(w.key[ok] * bw.STEP + w.key[ok + gap] + np.uint64(salt)))
    slot = (np.concatenate(slots) >> np.uint64(64 - BITS)).astype(np.int64)
    return np.concatenate(rows), np.maximum(slot, 1)


def weights_of(z: np.ndarray, n: np.ndarray) -> np.ndarray:
    """FTRL's closed form: zero inside the L1 ball; slot 0, the intercept, is not shrunk."""
    l1 = np.full(len(z), L1)
    l1[0] = 0.0
    return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((BETA + np.sqrt(n)) / ALPHA + L2))


def ftrl_pass(examples: list[tuple[np.ndarray, float]], z: np.ndarray, n: np.ndarray) -> None:
    """One pass over (slots, label); ``z`` and ``n`` are updated in place."""
    for slots, label in examples:
        zs, ns = z[slots], n[slots]
        root = np.sqrt(ns)
        l1 = np.where(slots == 0, 0.0, L1)
        w = np.where(np.abs(zs) <= l1, 0.0, -(zs - np.sign(zs) * l1) / ((BETA + root) / ALPHA + L2))
        g = 1.0 / (1.0 + np.exp(-np.clip(w.sum(), -35, 35))) - label
        n[slots] = ns + g * g
        z[slots] = zs + g - (np.sqrt(ns + g * g) - root) / ALPHA * w


def _examples(batches):
    """Rows (key, toxic, slots): the distinct slots of each text, and the intercept's."""
    for batch in batches:
        texts = batch.column("text")
        for a, b in bw.slices(texts, SLICE):
            row, slot = features(bw.split(texts.slice(a, b - a), bw.ALNUM))
            pair = np.unique(np.concatenate([(row << BITS) | slot, np.arange(b - a) << BITS]))
            cuts = np.searchsorted(pair, np.arange(b - a + 1) << BITS).astype(np.int32)
            slots = pa.ListArray.from_arrays(pa.array(cuts), pa.array((pair & ((1 << BITS) - 1)).astype(np.int32)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("key").slice(a, b - a), batch.column("toxic").slice(a, b - a), slots], ["key", "toxic", "slots"]
            )


def _learn(rounds: int):
    def learn(batches):
        examples = []
        for batch in batches:
            flat, cuts = batch.column("slots").values.to_numpy(), batch.column("slots").offsets.to_numpy()
            labels = batch.column("toxic").to_numpy()
            examples += [(flat[p:q].copy(), y) for p, q, y in zip(cuts[:-1], cuts[1:], labels)]
        z, n = np.zeros(1 << BITS), np.zeros(1 << BITS)
        for _ in range(rounds):
            ftrl_pass(examples, z, n)
        w = weights_of(z, n)
        yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(w)), pa.array(w[w != 0])], ["slot", "weight"])

    return learn


def sample_of(docs: DataFrame, labels: DataFrame, most_rows: int = MOST_ROWS) -> DataFrame:
    """(key, toxic, text) of at most ``most_rows`` labelled texts outside the held-out fold."""
    text = F.col("text").cast("string")
    own = docs.select(F.col("doc_id").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_hash"))
    known = own.select("doc_id", "text_hash").join(toxic_labels(labels), F.col("doc_id") == F.col("__label_id"))
    learnable = known.filter(~in_fold(F.col("doc_id"), 4, 2) & F.col("toxic").isNotNull())
    hashed = learnable.groupBy("doc_id", "text_hash").agg(F.max("toxic").cast("double").alias("toxic")).withColumn(
        "key", F.lpad(F.hex(F.xxhash64(F.lit(7), "doc_id", "text_hash")), 16, "0")
    )
    chosen = store(lowest_hashes(hashed, [], F.lit(most_rows), "key", tie="doc_id").select("doc_id", "text_hash", "toxic", "key"))
    # Bounded: at most ``most_rows`` small rows meet the texts.
    return own.join(F.broadcast(chosen), ["doc_id", "text_hash"]).groupBy("key").agg(F.first("toxic").alias("toxic"), F.first("text").alias("text"))


def train(sample: DataFrame, rounds: int = ROUNDS) -> np.ndarray:
    """Weights from a bounded ``sample(key, toxic, text)``; features are made in parallel and learnt from in one order."""
    rows = store(spread_keys(sample, "key").mapInArrow(lean(_examples), "key string, toxic double, slots array<int>"))
    learnt = rows.repartition(1).sortWithinPartitions("key", "toxic").mapInArrow(lean(_learn(rounds)), "slot long, weight double").toArrow()
    weights = np.zeros(1 << BITS, np.float32)
    weights[learnt.column("slot").to_numpy()] = learnt.column("weight").to_numpy()
    return weights


def scored(docs: DataFrame, weights: np.ndarray, text: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with the score of each whole text (a map over the scan)."""
    nonzero = np.flatnonzero(weights)
    shared = docs.sparkSession.sparkContext.broadcast((nonzero, weights[nonzero]))

    @F.pandas_udf("double")
    def score(batches: pd.Series) -> pd.Series:
        dense = np.zeros(1 << BITS, np.float32)
        dense[shared.value[0]] = shared.value[1]
        texts = pa.array(batches, pa.large_string(), from_pandas=True)
        out = []
        for a, b in bw.slices(texts, SLICE):
            row, slot = features(bw.split(texts.slice(a, b - a), bw.ALNUM))
            live = dense[slot] != 0
            pair = np.unique((row[live] << BITS) | slot[live])
            total = np.bincount(pair >> BITS, dense[pair & ((1 << BITS) - 1)].astype(float), b - a) + float(dense[0])
            out.append(1.0 / (1.0 + np.exp(-total)))
        give_back()
        return pd.Series(np.concatenate(out) if out else np.zeros(0))

    return docs.withColumn(name, score(F.col(text).cast("string")))


def toxic_labels(labels: DataFrame) -> DataFrame:
    return labels.filter(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("__label_id")).agg(F.max("toxic").alias("toxic"))


def learnt(docs: DataFrame, labels: DataFrame) -> np.ndarray:
    """Weights from the labelled rows outside the held-out fold."""
    return train(sample_of(docs, labels))


def without_toxic(docs: DataFrame, labels: DataFrame, cut: float = CUT) -> DataFrame:
    """Rows of ``docs`` that score below ``cut``; columns unchanged."""
    name = f"{free_prefix(docs)}score"
    return scored(docs, learnt(docs, labels), name=name).filter(F.col(name) < cut).select(*docs.columns)


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = scored(docs, learnt(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", in_fold(F.col("doc_id"), 4, 2).alias("held_out"), "score", F.when(F.col("score") >= CUT, 1).otherwise(0).alias("predicted"))


CHECKS = {"op8_toxicity": (op8, None)}
