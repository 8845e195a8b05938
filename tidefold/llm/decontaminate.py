"""Training texts against benchmark items: shared word n-grams are found, verified and removed.

Words are runs of ASCII letters and digits and characters beyond ASCII,
lower-cased in A-Z. A window is ``length`` consecutive words of an item; an
item with fewer words, but at least one, is one shorter window. The windows'
hashes go to every task as a sorted array, in blocks of at most ``BLOCK``
windows, so what is broadcast has a fixed bound: a larger benchmark takes more
passes over the texts, never a larger broadcast. A hash that is found is
verified against the window's words before it counts.

NULL, empty and word-free texts have no hit. Items without a word are no items.
The windows of an item with a NULL id count as hits, but it is in no list of
items. Items that repeat an id count once for it. Extra columns are
ignored by ``contamination`` and kept by ``without_spans``.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidefold.llm import bytewords as bw
from tidefold.llm.common import free_prefix, give_back, lean, table
from tidefold.session import store

LENGTH = 10
BLOCK = 1 << 20
SLICE = 2 << 20
FOUND = "n_words long, n_hit long, items array<string>, spans array<struct<start:int,stop:int>>, hits binary"
NOTHING = "struct<hits:binary,items:array<string>>"


def item_windows(items: DataFrame, length: int = LENGTH) -> DataFrame:
    """Distinct (window, n, item): the window's words joined by spaces, their number, and the item's id as text."""

    def cut(batches):
        for batch in batches:
            for at, to in bw.slices(batch.column("text")):
                w = bw.split(batch.column("text").slice(at, to - at), bw.ALNUM)
                data = w.data.tobytes()
                rows = set()
                for row, item in enumerate(batch.column("item").slice(at, to - at).to_pylist()):
                    words = [data[a:b] for a, b in zip(w.start[w.first[row] : w.first[row + 1]], w.end[w.first[row] : w.first[row + 1]])]
                    size = min(length, len(words))
                    if size:
                        rows |= {(b" ".join(words[k : k + size]), size, item) for k in range(len(words) - size + 1)}
                window, n, item = zip(*rows) if rows else ((), (), ())
                yield pa.RecordBatch.from_arrays([pa.array(window, pa.binary()), pa.array(n, pa.int32()), pa.array(item, pa.string())], ["window", "n", "item"])

    known = items.select(F.col("item_id").cast("string").alias("item"), F.col("text").cast("string").alias("text"))
    return known.mapInArrow(lean(cut), "window binary, n int, item string").distinct()


def _block_of(rows) -> tuple[dict, dict]:
    """(items of each window, sorted hashes and a bitmap in front of them for each window size)."""
    items: dict[bytes, list[str]] = {}
    sizes: dict[bytes, int] = {}
    for window, n, item in rows:
        named = items.setdefault(bytes(window), [])
        if item is not None:
            named.append(item)
        sizes[bytes(window)] = n
    by_size = {}
    for n in sorted(set(sizes.values())):
        w = bw.split(pa.array([w.decode() for w, size in sizes.items() if size == n], pa.string()), bw.ALNUM)
        keys = np.sort(bw.runs(w.key, n)[w.first[:-1]])
        bits = np.zeros(1 << 22, bool)
        bits[keys >> np.uint64(42)] = True
        by_size[n] = (keys, bits)
    return items, by_size


def _scan(block: tuple[dict, dict], w: bw.Words):
    """(word hit flags, items per row) of the rows of ``w``."""
    known, by_size = block
    step = np.zeros(len(w.start) + 1, np.int64)
    items: dict[int, set] = {}
    data = memoryview(w.data)
    last = w.last_of()
    for n, (keys, bits) in by_size.items():
        got = bw.runs(w.key, n)
        at = np.flatnonzero(bits[got >> np.uint64(42)])
        at = at[(at + n <= last[at])]
        near = np.searchsorted(keys, got[at])
        at = at[keys[np.minimum(near, len(keys) - 1)] == got[at]]
        rows = np.searchsorted(w.first, at, "right") - 1
        for k, row in zip(at.tolist(), rows.tolist()):
            window = b" ".join(data[a:b] for a, b in zip(w.start[k : k + n], w.end[k : k + n]))
            if window in known:
                step[k] += 1
                step[k + n] -= 1
                items.setdefault(row, set()).update(known[window])
    return np.cumsum(step[:-1]) > 0, items


def _scanner(shared):
    @F.pandas_udf(FOUND)
    def scan(text: pd.Series, earlier: pd.DataFrame) -> pd.DataFrame:
        """Findings with this block's windows added to those of earlier blocks."""
        column = pa.array(text, pa.large_string(), from_pandas=True)
        out = []
        for a, b in bw.slices(column, SLICE):
            w = bw.split(column.slice(a, b - a), bw.ALNUM)
            hit, items = _scan(shared.value, w)
            before = zip(earlier["hits"].iloc[a:b], earlier["items"].iloc[a:b])
            for row, (lo, hi, (bits, known)) in enumerate(zip(w.first[:-1].tolist(), w.first[1:].tolist(), before)):
                found, own, spans = items.get(row, set()).union(known if known is not None else ()), hit[lo:hi], []
                if bits is not None:
                    own = own | np.unpackbits(np.frombuffer(bits, np.uint8), count=hi - lo).astype(bool)
                bits = None
                if own.any():
                    edges = lo + np.flatnonzero(np.diff(np.concatenate([[0], own.astype(np.int8), [0]])))
                    begin, stop = w.start[edges[::2]] - w.row_start[row], w.end[edges[1::2] - 1] - w.row_start[row]
                    spans = [{"start": x, "stop": y} for x, y in zip(begin.tolist(), stop.tolist())]
                    bits = np.packbits(own).tobytes()
                out.append((hi - lo, int(own.sum()), sorted(found), spans, bits))
        give_back()
        return pd.DataFrame(out, columns=["n_words", "n_hit", "items", "spans", "hits"])

    return scan


def _blocks(items: DataFrame, length: int, block: int):
    """Broadcast blocks of about ``block`` windows, one after another."""
    spark = items.sparkSession
    windows = store(item_windows(items, length))
    blocks = max(1, -(-windows.select("window").distinct().count() // block))
    for k in range(blocks):
        part = windows.filter(F.pmod(F.xxhash64("window"), F.lit(blocks)) == k)
        # Bounded: a block holds about ``block`` windows whatever the benchmark's size.
        yield k == blocks - 1, spark.sparkContext.broadcast(_block_of([tuple(r) for r in part.toLocalIterator()]))


def contamination(
    docs: DataFrame, items: DataFrame, length: int = LENGTH, keep: tuple[str, ...] = ("doc_id",), block: int = BLOCK, name: str = "__found"
) -> DataFrame:
    """``keep`` columns of each row and, in ``name``: n_words, n_hit, the items (sorted as text), byte spans of hit words.

    With one block this is a map over the scan. More blocks are passed through
    one after another over a written table, so a task holds one block at a time.
    """
    columns = list(dict.fromkeys([*keep, "text"]))
    out = docs.select(*columns, F.lit(None).cast(NOTHING).alias(name))
    for last, shared in _blocks(items, length, block):
        earlier = F.struct(F.col(f"{name}.hits").alias("hits"), F.col(f"{name}.items").alias("items"))
        out = out.select(*columns, _scanner(shared)(F.col("text").cast("string"), earlier).alias(name))
        if not last:
            out = store(out)
    return out.select(*keep, name)


def without_spans(docs: DataFrame, items: DataFrame, length: int = LENGTH) -> DataFrame:
    """``docs`` with the spans of hit words cut out of ``text``; other columns stay."""

    @F.pandas_udf("string")
    def cut(text: pd.Series, found: pd.DataFrame) -> pd.Series:
        out = []
        for body, spans in zip(text, found["spans"]):
            if spans is not None and len(spans):
                raw, at, parts = body.encode(), 0, []
                for span in spans:
                    parts.append(raw[at : span["start"]])
                    at = span["stop"]
                body = b"".join([*parts, raw[at:]]).decode()
            out.append(body)
        return pd.Series(out, dtype=object)

    name = f"{free_prefix(docs)}found"
    found = contamination(docs, items, length, tuple(docs.columns), name=name)
    return found.withColumn("text", cut(F.col("text").cast("string"), F.col(name))).select(*docs.columns)


def without_documents(docs: DataFrame, items: DataFrame, length: int = LENGTH) -> DataFrame:
    """Rows of ``docs`` in which no window of an item occurs."""
    name = f"{free_prefix(docs)}found"
    return contamination(docs, items, length, tuple(docs.columns), name=name).filter(F.col(f"{name}.n_hit") == 0).select(*docs.columns)


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        F.col("__found.n_words").alias("n_words"),
        F.col("__found.n_hit").alias("n_hit"),
        F.size("__found.items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "__found.items"), 256).alias("items_sha256"),
        (F.col("__found.n_hit") > 0).alias("contaminated"),
    )


SQL = r"""
WITH item_words AS (
    SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
    FROM benchmark
), windows AS (
    SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[k : k + least(10, len(w)) - 1], ' ') AS window
    FROM item_words, LATERAL unnest(range(1, len(w) - least(10, len(w)) + 2)) AS t(k)
    WHERE len(w) > 0
), doc_words AS (
    SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w
    FROM documents
), sizes AS (SELECT DISTINCT n FROM windows),
grams AS (
    SELECT doc_id, k, n, array_to_string(w[k : k + n - 1], ' ') AS window
    FROM doc_words, sizes, LATERAL unnest(range(1, len(w) - n + 2)) AS t(k)
), hits AS (SELECT doc_id, k, grams.n, item_id FROM grams JOIN windows ON windows.window = grams.window AND windows.n = grams.n),
hit_words AS (
    SELECT doc_id, count(DISTINCT p) AS n_hit FROM hits, LATERAL unnest(range(k, k + n)) AS t(p) GROUP BY doc_id
), found AS (
    SELECT doc_id, count(DISTINCT item_id) AS n_items, sha256(string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR))) AS items_sha256
    FROM hits GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc_words d LEFT JOIN hit_words USING (doc_id) LEFT JOIN found USING (doc_id)
"""

CHECKS = {"op2_decontaminate": (op2, SQL)}
