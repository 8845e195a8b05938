"""Token counts of whole texts; huge texts are cut into overlapping chunks and spliced.

Texts up to ``limit`` characters are encoded where they are. A longer text
becomes chunk rows that are dealt to many tasks: chunk ``i`` covers characters
``[i*stride, (i+1)*stride + overlap)``. Both neighbours see the overlap at
``(i+1)*stride``, and both look in it for the first place where a character that
is no white space is followed by a space or a line end. The tokenizer's rules
always begin a piece there, whatever stands before or after, so it is a proven
boundary; both encodings, with offsets, must also have a token begin there and
must agree on the id of that token. A chunk counts its tokens from its left to
its right splice. Where an overlap has no such place, or the encodings differ,
the text is cut again with overlaps and strides twice (four times, ...) as
long, at the end as one chunk.

A text that is one run without white space longer than memory cannot be cut:
there every boundary depends on its whole left context.

NULL and empty texts have no bytes and no tokens; rows with equal ids are
counted one by one.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidefold.llm import pieces
from tidefold.llm.common import table
from tidefold.session import spread_keys, store

LIMIT = 65_536
STRIDE = 32_768
OVERLAP = 256
OVER = 512

_boundary = re.compile(r"(?<=\S)[ \n]")


def _counted(tokenizer: str):
    def count(batches):
        coder = pieces.encoder(tokenizer)
        for batch in batches:
            n = [np.diff(stops) for _, _, stops in coder.rows(batch.column("text"))]
            column = pa.array(np.concatenate(n) if n else [], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), column], ["doc_id", "n_bytes", "n_tokens"])

    return count


def chunk_rows(texts: DataFrame, stride: int, overlap: int) -> DataFrame:
    """Rows (doc_key, doc_id, n_bytes, chunk, chunks, text, stride, overlap) of overlapping chunks."""

    def chop(batches):
        for batch in batches:
            for row in batch.to_pylist():
                text = row["text"]
                n = max(1, -(-(len(text) - overlap) // stride))
                for i in range(n):
                    part = text[i * stride : len(text) if i == n - 1 else (i + 1) * stride + overlap]
                    yield pa.RecordBatch.from_pylist([{"doc_key": row["doc_key"], "doc_id": row["doc_id"], "n_bytes": row["n_bytes"], "chunk": i, "chunks": n, "part": part}])

    return texts.select("doc_key", "doc_id", "n_bytes", "text").mapInArrow(
        chop, "doc_key string, doc_id long, n_bytes long, chunk long, chunks long, part string"
    )


def splice(part: str, low: int, high: int) -> int | None:
    """First proven boundary in ``part[low:high]``; the character before it is inside too, so both sides see the same."""
    found = _boundary.search(part, low + 1, high)
    return found.start() if found else None


def _chunk_counts(tokenizer: str, stride: int, overlap: int):
    def count(batches):
        coder = pieces.load(tokenizer)
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                part, first, last = row.pop("part"), row["chunk"] == 0, row["chunk"] == row["chunks"] - 1
                encoding = coder.encode(part, add_special_tokens=False)
                begins = np.asarray([a for a, _ in encoding.offsets], np.int64)
                left = 0 if first else splice(part, 0, overlap)
                right = len(part) if last else splice(part, stride, stride + overlap)
                # None where an overlap has no proven boundary; begins never decreases.
                cuts = [None if p is None else int(np.searchsorted(begins, p)) for p in (left, right)]

                def token(cut, place, edge):
                    if edge or cut is None:
                        return None
                    return encoding.ids[cut] if cut < len(begins) and begins[cut] == place else -1

                out.append(
                    row
                    | {"n": None if None in cuts else cuts[1] - cuts[0], "left_id": token(cuts[0], left, first), "right_id": token(cuts[1], right, last)}
                )
            yield pa.RecordBatch.from_pylist(out, pa.schema([
                ("doc_key", pa.string()), ("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("chunk", pa.int64()), ("chunks", pa.int64()),
                ("n", pa.int64()), ("left_id", pa.int64()), ("right_id", pa.int64()),
            ]))

    return count


def count_long(texts: DataFrame, tokenizer: str, stride: int, overlap: int) -> DataFrame:
    """Counts of ``texts(doc_key, doc_id, n_bytes, text)`` with ``n_tokens`` NULL where a splice failed."""
    parts = spread_keys(chunk_rows(texts, stride, overlap), "doc_key", "chunk")
    counts = parts.mapInArrow(
        _chunk_counts(tokenizer, stride, overlap),
        "doc_key string, doc_id long, n_bytes long, chunk long, chunks long, n long, left_id long, right_id long",
    )
    # The small count rows of one text meet: a few bytes for each chunk of it.
    following = F.lead("left_id").over(Window.partitionBy("doc_key").orderBy("chunk"))
    agrees = (F.col("chunk") == F.col("chunks") - 1) | ((F.col("right_id") >= 0) & (F.col("right_id") == F.col("_next")))
    good = F.col("n").isNotNull() & F.coalesce(agrees, F.lit(False))
    return (
        counts.withColumn("_next", following)
        .groupBy("doc_key")
        .agg(F.first("doc_id").alias("doc_id"), F.first("n_bytes").alias("n_bytes"), F.when(F.bool_and(good), F.sum("n")).alias("n_tokens"))
    )


def token_counts(
    docs: DataFrame, tokenizer: str, limit: int = LIMIT, stride: int = STRIDE, overlap: int = OVERLAP
) -> DataFrame:
    """(doc_id, n_bytes, n_tokens) for each row of ``docs(doc_id, text)``."""
    if overlap > stride:
        raise ValueError("An overlap is at most as long as a stride.")
    base = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes")
    )
    is_long = F.coalesce(F.char_length("text") > limit, F.lit(False))
    done = [base.filter(~is_long).mapInArrow(_counted(tokenizer), "doc_id long, n_bytes long, n_tokens long")]
    # Equal texts of equal ids share a key; each of them is counted once and repeated below.
    waiting = base.filter(is_long).withColumn("doc_key", F.sha2(F.concat_ws("\n", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "text"), 256))
    repeats = waiting.groupBy("doc_key").agg(F.count("*").cast("int").alias("_times"))
    once = waiting.dropDuplicates(["doc_key"])
    while True:
        counted = store(count_long(once, tokenizer, stride, overlap))
        done.append(
            counted.filter(F.col("n_tokens").isNotNull()).join(repeats, "doc_key")
            .select("doc_id", "n_bytes", "n_tokens", F.explode(F.array_repeat(F.lit(1), F.col("_times"))).alias("_one")).drop("_one")
        )
        failed = counted.filter(F.col("n_tokens").isNull()).select("doc_key")
        if failed.isEmpty():
            break
        stride, overlap = stride * 2, overlap * 4 if overlap * 4 <= stride * 2 else stride * 2
        once = once.join(failed, "doc_key", "left_semi")
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    counts = token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return counts.withColumn("over_limit", F.col("n_tokens") > OVER)


CHECKS = {"op5_token_counts": (op5, None)}
