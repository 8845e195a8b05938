"""Packing documents into sequences: shortest pack first over the length histogram.

A document's ids, with the end id behind them, are cut where a full sequence ends;
what remains is one piece below ``SEQUENCE`` ids. All full pieces are sequences of
their own. The rest is packed by lengths alone: from the histogram (one count for each length,
whatever the number of documents) lengths are placed longest first, each into the
pack with the fewest ids so far, a pattern of equal packs being kept once with its
count and split where only some of them take a piece.

Packs that stay open would be padding. As many packs are kept as all ids need, the
fullest ones; the pieces of the others are placed again in the same order, and where
not even the emptiest pack has room a piece is cut at the room there is. So fewer
than ``SEQUENCE`` ids of padding are left in all, and only the few pieces of
the given-up packs are cut.

Patterns go back to documents by rank. A piece's rank among those of its length is
its place within the task that wrote it plus the pieces of that length in
earlier tasks (a prefix sum of small counts); slots of the patterns own ranges of
ranks, and a binary search in the broadcast slots gives sequence and offset. The
slots' number is bounded by the square of the sequence length, not by the data. Pieces stay where they were written.

NULL and empty texts are the end id alone. Repeated rows are packed one by one.
Extra columns are ignored. An empty table gives no piece.
"""

from __future__ import annotations

import heapq
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidefold.llm import pieces
from tidefold.llm.common import table
from tidefold.session import store

SEQUENCE = 1024
END_ID = 0
RANKS = 1 << 50
CUT = "shard int, doc_id long, doc_tokens long, start long, length int, rank long, width int, ids binary"
PLACED = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, width int, ids binary"


@dataclass
class Slots:
    """Ranges of ranks of a length, by length and first rank; ``take`` ids go to the sequence, the rest has a rank of its own length."""

    key: np.ndarray
    sequence: np.ndarray
    offset: np.ndarray
    take: np.ndarray
    rest: np.ndarray
    sequences: int


@dataclass
class Pack:
    """Equal packs: their number, the first one's sequence, and their (length, offset) slots."""

    fill: int
    count: int
    slots: list[tuple[int, int]]
    first: int = 0


def shortest_first(counts: np.ndarray) -> list[Pack]:
    """Packs for ``counts[length]`` pieces, longest lengths first, each into the shortest pack."""
    size, packs, heap, turn = len(counts) - 1, [], [], 0
    for length in range(size, 0, -1):
        left = int(counts[length])
        while left:
            if heap and heap[0][0] + length <= size:
                pack = heapq.heappop(heap)[2]
                taken = min(left, pack.count)
                if taken < pack.count:
                    turn += 1
                    heapq.heappush(heap, (pack.fill, turn, Pack(pack.fill, pack.count - taken, pack.slots)))
                pack = Pack(pack.fill + length, taken, [*pack.slots, (length, pack.fill)])
            else:
                taken = left
                pack = Pack(length, taken, [(length, 0)])
            left -= taken
            if pack.fill < size:
                turn += 1
                heapq.heappush(heap, (pack.fill, turn, pack))
            else:
                packs.append(pack)
    return packs + [x[2] for x in heap]


def plan(counts: np.ndarray) -> Slots:
    """Slots for ``counts[length]`` pieces of 1 to ``len(counts) - 1`` ids."""
    size = len(counts) - 1
    full, counts = int(counts[size]), np.append(counts[:size], 0).astype(object)
    ids = sum(int(n) * length for length, n in enumerate(counts))
    needed = -(-ids // size)
    kept, again, room = [], [0] * (size + 1), needed
    for pack in sorted(shortest_first(counts), key=lambda p: -p.fill):
        taken = min(pack.count, room)
        if taken:
            kept.append(Pack(pack.fill, taken, pack.slots, needed - room))
            room -= taken
        for length, _ in pack.slots if taken < pack.count else ():
            again[length] += pack.count - taken
    rows: list[tuple[int, int, int, int, int, int]] = [(size, 0, needed, 0, size, 0)] if full else []
    begin = [0] * (size + 1)
    for pack in kept:
        for length, offset in pack.slots:
            rows.append((length, begin[length], pack.first, offset, length, 0))
            begin[length] += pack.count
    stop = [int(n) for n in counts]
    heap = [(p.fill, p.first, p) for p in kept if p.fill < size]
    heapq.heapify(heap)
    for length in range(size - 1, 0, -1):
        while begin[length] < stop[length]:
            pack = heapq.heappop(heap)[2]
            taken, take = min(stop[length] - begin[length], pack.count), min(length, size - pack.fill)
            rest = length - take
            rows.append((length, begin[length], pack.first, pack.fill, take, stop[rest] if rest else 0))
            begin[length] += taken
            if rest:
                stop[rest] += taken
            if taken < pack.count:
                heapq.heappush(heap, (pack.fill, pack.first + taken, Pack(pack.fill, pack.count - taken, [], pack.first + taken)))
            if pack.fill + take < size:
                heapq.heappush(heap, (pack.fill + take, pack.first, Pack(pack.fill + take, taken, [], pack.first)))
    table_ = np.asarray(sorted(rows), np.int64).reshape(-1, 6)
    return Slots(table_[:, 0] * RANKS + table_[:, 1], table_[:, 2], table_[:, 3], table_[:, 4], table_[:, 5], needed + full)


def _binary(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """``values[bounds[k]:bounds[k + 1]]`` as bytes for each ``k``."""
    offsets = pa.py_buffer((bounds * values.itemsize).astype(np.int32).tobytes())
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, offsets, pa.py_buffer(values.tobytes())])


def _cutter(tokenizer: str, end_id: int, size: int):
    def cut(batches):
        coder = pieces.encoder(tokenizer)
        kind = np.dtype("<u4") if end_id >= 1 << 16 else coder.kind
        shard, seen = TaskContext.get().partitionId(), np.zeros(size + 1, np.int64)
        for batch in batches:
            doc_id = batch.column("doc_id")
            for row, ids, stops in coder.rows(batch.column("text")):
                whole = np.insert(ids.astype(kind, copy=False), stops[1:], end_id)
                begins = stops + np.arange(len(stops))
                total = np.diff(begins)
                parts = -(-total // size)
                doc = np.repeat(np.arange(len(total)), parts)
                start = (np.arange(len(doc)) - np.repeat(np.cumsum(parts) - parts, parts)) * size
                length = np.minimum(size, total[doc] - start)
                order = np.argsort(length, kind="stable")
                rank = np.empty(len(doc), np.int64)
                rank[order] = np.arange(len(doc)) - np.searchsorted(length[order], length[order])
                rank += seen[length]
                seen += np.bincount(length, minlength=size + 1)
                bounds = np.append(begins[doc] + start, begins[-1])
                # Some megabytes of ids a batch, also where one document has very many.
                for a in range(0, len(doc), 4096):
                    b = min(a + 4096, len(doc))
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.full(b - a, shard, np.int32)), doc_id.take(pa.array(row + doc[a:b])), pa.array(total[doc[a:b]]), pa.array(start[a:b]),
                            pa.array(length[a:b].astype(np.int32)), pa.array(rank[a:b]), pa.array(np.full(b - a, kind.itemsize, np.int32)),
                            _binary(whole[bounds[a] : bounds[b]], bounds[a : b + 1] - bounds[a]),
                        ],
                        ["shard", "doc_id", "doc_tokens", "start", "length", "rank", "width", "ids"],
                    )

    return cut


def _placer(shared):
    def place(batches):
        slots = shared.value
        for batch in batches:
            doc, total, start, width, ids = (batch.column(c) for c in ("doc_id", "doc_tokens", "start", "width", "ids"))
            row, at = np.arange(batch.num_rows), np.zeros(batch.num_rows, np.int64)
            length, rank = batch.column("length").to_numpy().astype(np.int64), batch.column("rank").to_numpy()
            start, width_of = start.to_numpy(), width.to_numpy()
            while len(row):
                slot = np.searchsorted(slots.key, length * RANKS + rank, "right") - 1
                behind, take = rank - slots.key[slot] % RANKS, slots.take[slot]
                mine = pa.array(row)
                part = ids.take(mine)
                cut = np.flatnonzero((at > 0) | (take < length))
                if len(cut):
                    values = part.to_pylist()
                    for k in cut.tolist():
                        w = int(width_of[row[k]])
                        values[k] = values[k][at[k] * w : (at[k] + take[k]) * w]
                    part = pa.array(values, pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [doc.take(mine), pa.array(start[row] + at), pa.array(take), total.take(mine), pa.array(slots.sequence[slot] + behind), pa.array(slots.offset[slot]), width.take(mine), part],
                    ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "width", "ids"],
                )
                more = take < length
                row, at, length, rank = row[more], (at + take)[more], (length - take)[more], (slots.rest[slot] + behind)[more]

    return place


def packed(docs: DataFrame, tokenizer: str, end_id: int = END_ID, size: int = SEQUENCE) -> DataFrame:
    """(doc_id, start, length, doc_tokens, sequence_id, offset, width, ids) of every piece; ``ids`` are little-endian, ``width`` bytes each."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    cut = store(texts.mapInArrow(_cutter(tokenizer, end_id, size), CUT))
    by_shard = store(cut.groupBy("shard", "length").agg(F.count("*").alias("n")))
    counts = np.zeros(size + 1, np.int64)
    for row in by_shard.groupBy("length").agg(F.sum("n").alias("n")).collect():  # one row for each length
        counts[row["length"]] = row["n"]
    shared = docs.sparkSession.sparkContext.broadcast(plan(counts))
    before = Window.partitionBy("length").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    bases = store(by_shard.select("shard", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")))
    ranked = cut.join(bases, ["shard", "length"]).withColumn("rank", F.col("rank") + F.col("base"))
    return ranked.select("doc_id", "doc_tokens", "start", "length", "rank", "width", "ids").mapInArrow(_placer(shared), PLACED)


def with_checksum(rows: DataFrame) -> DataFrame:
    """``rows`` with ``ids_crc32``, of the ids as little-endian unsigned 32-bit integers, for ``ids`` and ``width``."""

    def add(batches):
        for batch in batches:
            out = []
            for width, ids in zip(batch.column("width").to_pylist(), batch.column("ids")):
                buffer = ids.as_buffer()
                out.append(zlib.crc32(buffer if width == 4 else np.frombuffer(buffer, "<u2").astype("<u4")))
            kept = [c for c in batch.schema.names if c not in ("ids", "width")]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(out, pa.int64())], [*kept, "ids_crc32"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema if f.name not in ("ids", "width"))
    return rows.mapInArrow(add, f"{fields}, ids_crc32 long")


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    rows = packed(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return with_checksum(rows).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


CHECKS = {"op12_packing": (op12, None)}
