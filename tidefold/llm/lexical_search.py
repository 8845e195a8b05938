"""Ranked lexical search by one Aho-Corasick scan of the texts, without a document index.

Terms are runs of ASCII letters and digits and characters beyond ASCII, lower-cased
in A-Z. All terms of the items become one automaton whose patterns are guarded by
a blank on both sides; in the texts every byte that belongs to no term is a blank,
so a match is a whole term and never a part of one. The scan counts each term's
occurrences straight from the text. What it finds is kept as (document, terms,
counts); document frequencies and lengths come from that table in plain
aggregations, and in a second pass over it the automaton's outputs are mapped to
items through postings, scored in 64-bit integers, and cut to the best of each
item inside every task.

Items are dealt to blocks of about ``BLOCK`` (item, term) pairs, so that automaton,
postings and weights have a fixed bound: more items take more scans, never a larger
broadcast. Texts are not shuffled. Only each task's best rows of an item meet, in
two steps, so that no group holds more than a share of the tasks' rows.

NULL texts and texts without a term are no documents of the ranking. A NULL
document id ranks behind other ids of the same score. Rows that repeat an id are
ranked one by one, and so is every row of the items; an item without a term has no
result. Extra columns are ignored. A text of any length is scanned in windows of
some megabytes that end at blanks.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidefold.llm import bytewords as bw
from tidefold.llm.common import table
from tidefold.session import store

BEST = 10
BLOCK = 1 << 18
WINDOW = 8 << 20
CELLS = 1 << 22
TURNS = 256
BLANK = 0x20

_GUARDED = np.where(bw.ALNUM, bw.FOLD, BLANK).astype(np.uint8)


class Terms:
    """Terms of a block of items, their postings and, once known, their weights; the automaton is built where it is used."""

    def __init__(self, rows: list[tuple[int, bytes, int]]):
        self.terms = sorted({term for _, term, _ in rows})
        self.items = sorted({item for item, _, _ in rows})
        place, item_place = ({x: k for k, x in enumerate(xs)} for xs in (self.terms, self.items))
        entries = np.asarray(sorted((place[term], item_place[item], n) for item, term, n in rows), np.int64).reshape(-1, 3)
        self.item, self.times = entries[:, 1], entries[:, 2]
        self.first = np.searchsorted(entries[:, 0], np.arange(len(self.terms) + 1))
        self.weight = np.zeros(len(self.terms), np.int64)

    def automaton(self):
        if getattr(self, "_automaton", None) is None:
            import ahocorasick

            # Bytes stand as characters of the same number: UTF-8 keeps whole characters apart.
            built = ahocorasick.Automaton(ahocorasick.STORE_INTS)
            for k, term in enumerate(self.terms):
                built.add_word(f" {term.decode('latin-1')} ", k)
            built.make_automaton()
            self._automaton = built
        return self._automaton

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_automaton"}


def guarded(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes with blanks for whatever is in no term and around every row, places of the rows' leading blanks)."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(texts.buffers()[2], np.uint8)[bounds[0] : bounds[-1]] if bounds[-1] > bounds[0] else np.zeros(0, np.uint8)
    bounds = bounds - bounds[0]
    return np.insert(_GUARDED[raw], bounds, BLANK), bounds + np.arange(len(bounds))


def windows(data: np.ndarray, size: int = WINDOW) -> Iterator[tuple[int, int]]:
    """Ranges of about ``size`` bytes that begin and end at a blank; neighbours share it."""
    at = 0
    while at < len(data) - 1:
        to = min(at + size, len(data) - 1)
        if data[to] != BLANK:
            near = np.flatnonzero(data[at + 1 : to] == BLANK)
            while not len(near):
                to, begin = min(to + size, len(data) - 1), to
                near = begin - at - 1 + np.flatnonzero(data[begin : to + 1] == BLANK)
            to = at + 1 + int(near[-1])
        yield at, to
        at = to


def occurrences(terms: Terms, texts: pa.Array, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(terms in all of each row, row, term, count) of the terms found."""
    data, guards = guarded(texts)
    inside = data != BLANK
    begins = np.flatnonzero(inside[1:] & ~inside[:-1])
    size = len(terms.terms)
    keys, counts = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for a, b in windows(data, window) if size else ():  # a block may be without terms
        found = np.fromiter(chain.from_iterable(terms.automaton().iter(data[a : b + 1].tobytes().decode("latin-1"))), np.int64)
        end, term = a + found[::2], found[1::2]
        key, count = np.unique((np.searchsorted(guards, end) - 1) * size + term, return_counts=True)
        keys.append(key)
        counts.append(count)
    key, which = np.unique(np.concatenate(keys), return_inverse=True)
    count = np.zeros(len(key), np.int64)
    np.add.at(count, which, np.concatenate(counts))
    return np.diff(np.searchsorted(begins, guards)), key // max(size, 1), key % max(size, 1), count


def item_terms(items: DataFrame) -> DataFrame:
    """(item, item_id, term, times): how often each row of ``items`` holds each of its terms; ``item`` numbers the rows."""

    def count(batches):
        for batch in batches:
            for a, b in bw.slices(batch.column("text")):
                w = bw.split(batch.column("text").slice(a, b - a), bw.ALNUM)
                data, found = w.data.tobytes(), {}
                for row, s, e in zip(w.row_of().tolist(), w.start.tolist(), w.end.tolist()):
                    found[row, data[s:e]] = found.get((row, data[s:e]), 0) + 1
                rows = pa.array([a + row for row, _ in found], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("item").take(rows), batch.column("item_id").take(rows), pa.array([t for _, t in found], pa.binary()), pa.array(found.values(), pa.int64())],
                    ["item", "item_id", "term", "times"],
                )

    kind = items.schema["item_id"].dataType.simpleString()
    rows = store(items.select("item_id", F.col("text").cast("string").alias("text"))).withColumn("item", F.monotonically_increasing_id())
    return store(rows.mapInArrow(count, f"item long, item_id {kind}, term binary, times long"))


def _scan(shared, window: int):
    def scan(batches):
        for batch in batches:
            for a, b in bw.slices(batch.column("text")):
                n, row, term, count = occurrences(shared.value, batch.column("text").slice(a, b - a), window)
                stops = pa.array(np.searchsorted(row, np.arange(b - a + 1)), pa.int32())
                lists = [pa.ListArray.from_arrays(stops, pa.array(x, kind)) for x, kind in ((term, pa.int32()), (count, pa.int64()))]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), pa.array(n, pa.int64()), *lists], ["doc_id", "n", "terms", "counts"])

    return scan


def _scored(shared, documents: int, all_terms: int, best: int, cells: int):
    """Each task's best rows of every item, kept over its batches."""

    def score(batches):
        block = shared.value
        width = len(block.items)
        kept = [np.zeros(0, kind) for kind in (np.int64, np.int64, bool, np.int64)]  # item, score, id is NULL, id
        floor = np.ones(width, np.int64)
        for batch in batches:
            n, missing = batch.column("n").to_numpy(), batch.column("doc_id").is_null().to_numpy(zero_copy_only=False)
            doc = batch.column("doc_id").fill_null(0).to_numpy()
            m = 25 + (75 * n * documents) // max(all_terms, 1)
            stops = batch.column("terms").offsets.to_numpy()
            term, count = (batch.column(c).values.to_numpy() for c in ("terms", "counts"))
            spread = np.concatenate([[0], np.cumsum(block.first[term + 1] - block.first[term])])
            work = spread[stops] + np.arange(len(stops)) * width
            a = 0
            while a < len(n):
                b = max(a + 1, int(np.searchsorted(work, work[a] + cells, "right")) - 1)
                t, f = term[stops[a] : stops[b]], count[stops[a] : stops[b]]
                row = np.repeat(np.arange(b - a), np.diff(stops[a : b + 1]))
                value = block.weight[t] * ((1_000_000_000 * f) // (1000 * f + 8 * m[a + row]))
                each = block.first[t + 1] - block.first[t]
                entry = np.repeat(block.first[t] - np.cumsum(each) + each, each) + np.arange(each.sum())
                scores = np.zeros((b - a) * width, np.int64)
                np.add.at(scores, np.repeat(row, each) * width + block.item[entry], np.repeat(value, each) * block.times[entry])
                scores = scores.reshape(b - a, width)
                if b - a > best:
                    floor = np.maximum(floor, np.partition(scores, b - a - best, axis=0)[b - a - best])
                row, item = np.nonzero(scores >= floor)
                new = (item, scores[row, item], missing[a + row], doc[a + row])
                kept = [np.concatenate(x) for x in zip(kept, new)]
                order = np.lexsort((kept[3], kept[2], -kept[1], kept[0]))
                kept = [x[order] for x in kept]
                place = np.arange(len(order)) - np.searchsorted(kept[0], kept[0])
                full = kept[0][place == best - 1]
                floor[full] = np.maximum(floor[full], kept[1][place == best - 1])
                kept = [x[place < best] for x in kept]
                a = b
        if len(kept[0]):
            part = TaskContext.get().partitionId() % TURNS
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.asarray(block.items)[kept[0]]), pa.array(np.full(len(kept[0]), part, np.int32)), pa.array(kept[3], mask=kept[2]), pa.array(kept[1])],
                ["item", "part", "doc_id", "score"],
            )

    return score


def ranked(docs: DataFrame, items: DataFrame, best: int = BEST, block: int = BLOCK, window: int = WINDOW, cells: int = CELLS) -> DataFrame:
    """(item_id, rank, doc_id, score): the best documents of each item."""
    spark = docs.sparkSession
    entries = item_terms(items)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    blocks = max(1, -(-entries.count() // block))
    tops = []
    for k in range(blocks):
        mine = entries.filter(F.pmod(F.xxhash64("item"), F.lit(blocks)) == k).select("item", "term", "times")
        # Bounded: a block holds about ``block`` entries whatever the number of items.
        terms = Terms([(r[0], bytes(r[1]), r[2]) for r in mine.toLocalIterator()])
        shared = spark.sparkContext.broadcast(terms)
        found = store(texts.mapInArrow(_scan(shared, window), "doc_id long, n long, terms array<int>, counts array<long>").filter("n > 0"))
        documents, all_terms = found.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        holding = found.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
        weights = holding.select("term", F.floor(1000 * F.log((2 * F.lit(documents) + 2) / (2 * F.col("df") + 1))).alias("w"))
        for row in weights.toLocalIterator():
            terms.weight[row["term"]] = row["w"]
        weighted = spark.sparkContext.broadcast(terms)
        tops.append(store(found.mapInArrow(_scored(weighted, documents, all_terms, best, cells), "item long, part int, doc_id long, score long")))
        shared.destroy()
        weighted.destroy()
    rows = tops[0]
    for more in tops[1:]:
        rows = rows.unionByName(more)
    order = (F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    for keys in (("item", "part"), ("item",)):
        rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("rank") <= best)
    return rows.join(entries.select("item", "item_id").distinct(), "item").select("item_id", "rank", "doc_id", "score")


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_CUT = r"""regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x{00}-\x{2F}\x{3A}-\x{40}\x{5B}-\x{60}\x{7B}-\x{7F}]+')"""

SQL = f"""
WITH items AS (SELECT row_number() OVER () AS item, item_id, {_CUT} AS t FROM benchmark),
wanted AS (SELECT item, any_value(item_id) AS item_id, term, count(*) AS times FROM (SELECT item, item_id, unnest(t) AS term FROM items) GROUP BY item, term),
docs AS (SELECT k, doc_id, t, len(t) AS n FROM (SELECT row_number() OVER () AS k, doc_id, {_CUT} AS t FROM documents) WHERE len(t) > 0),
size AS (SELECT count(*)::BIGINT AS n_docs, sum(n)::BIGINT AS n_terms FROM docs),
tf AS (SELECT k, term, count(*)::BIGINT AS tf FROM (SELECT k, unnest(t) AS term FROM docs) WHERE term IN (SELECT term FROM wanted) GROUP BY k, term),
weight AS (SELECT term, floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM tf, size GROUP BY term, n_docs),
scored AS (
  SELECT item, any_value(item_id) AS item_id, k, any_value(doc_id) AS doc_id,
    sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * n_docs) // n_terms))))::BIGINT AS score
  FROM wanted JOIN weight USING (term) JOIN tf USING (term) JOIN docs USING (k), size GROUP BY item, k
)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM scored WHERE score > 0
) WHERE rank <= {BEST}
"""

CHECKS = {"op11_lexical_search": (op11, SQL)}
