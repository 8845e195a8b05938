"""Token ids as flat binary files with 64-bit offsets.

A dataset is a folder of shards. Shard ``k`` holds

* ``tokens-k.bin``: ids one after another, little-endian unsigned integers of
  16 bits (32 where the vocabulary needs them),
* ``offsets-k.bin``: ``n + 1`` little-endian unsigned 64-bit token offsets in
  the shard,
* ``docs-k.bin``: ``n`` little-endian signed 64-bit document ids; the first
  ``n_null`` of them stand for NULL.

Documents are in ascending id order within and across shards. The manifest (one
row a shard) carries each shard's base, the prefix sum of earlier shards'
token counts, so a document's place in the whole is base plus offset.

Files are written under another name and renamed, so a repeated task leaves the
same files. The folder has to be one that all executors reach: the one in
``spark.checkpoint.dir`` by default, through a mounted path (memory-mapped) or
any file system that Arrow opens by URI (then read as a stream).

NULL and empty texts are documents of the end id alone. Repeated ids are kept,
ordered by a hash of their text. An empty table gives no shard and no row.
"""

from __future__ import annotations

import uuid
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidefold.llm import pieces
from tidefold.llm.common import lean, table
from tidefold.session import shared_folder, spread_keys, store

END_ID = 1
MANIFEST = "shard int, n_docs long, n_null long, n_tokens long, width int"
FACTS = "doc_id long, start long, n_tokens long, ids_crc32 long"


def _opened(folder: str):
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(folder if "://" in folder else "file://" + folder.removeprefix("file:"))
    return system, path


def _write_shard(folder: str, tokenizer: str, end_id: int):
    def write(batches):
        system, path = _opened(folder)
        system.create_dir(path, recursive=True)
        shard = TaskContext.get().partitionId()
        coder = pieces.encoder(tokenizer)
        kind = np.dtype("<u4") if end_id >= 1 << 16 else coder.kind
        width = kind.itemsize
        mark = f"{path}/.{uuid.uuid4().hex}"
        offsets, docs, nulls, out = array("Q", [0]), array("q"), 0, None
        for batch in batches:
            ids = batch.column("doc_id")
            nulls += ids.null_count
            docs.frombytes(np.ascontiguousarray(ids.fill_null(0).to_numpy(zero_copy_only=False), "<i8").tobytes())
            out = out or system.open_output_stream(f"{mark}-tokens")
            for _, ids, stops in coder.rows(batch.column("text")):
                # The end id goes behind every row's ids.
                whole = np.insert(ids.astype(kind, copy=False), stops[1:], end_id)
                offsets.frombytes((offsets[-1] + stops[1:] + np.arange(1, len(stops))).astype("<u8").tobytes())
                out.write(whole.tobytes())
        if out is None:
            return
        out.close()
        for name, values in (("offsets", offsets), ("docs", docs)):
            with system.open_output_stream(f"{mark}-{name}") as f:
                f.write(values.tobytes())
        for name in ("tokens", "offsets", "docs"):
            system.move(f"{mark}-{name}", f"{path}/{name}-{shard}.bin")
        yield pa.RecordBatch.from_pylist(
            [{"shard": shard, "n_docs": len(docs), "n_null": nulls, "n_tokens": offsets[-1], "width": width}],
            pa.schema([("shard", pa.int32()), ("n_docs", pa.int64()), ("n_null", pa.int64()), ("n_tokens", pa.int64()), ("width", pa.int32())]),
        )

    return write


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, end_id: int = END_ID) -> DataFrame:
    """Encode ``docs(doc_id, text)`` into ``folder``; returns the manifest with bases (stored).

    One range shuffle of the texts by id.
    """
    ordered = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        .withColumn("tie", F.xxhash64("text"))
        .repartitionByRange("doc_id", "tie")
        .sortWithinPartitions("doc_id", "tie")
        .drop("tie")
    )
    shards = store(ordered.mapInArrow(lean(_write_shard(folder, tokenizer, end_id)), MANIFEST))
    # One row a shard: the only order over all of them is on this small table.
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return shards.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).cast("long"))


def _mapped(system, path: str, kind: str) -> np.ndarray:
    if system.type_name == "local":
        return np.memmap(path, kind, "r") if system.get_file_info(path).size else np.zeros(0, kind)
    with system.open_input_stream(path) as f:
        return np.frombuffer(f.read(), kind)


def read_shard(folder: str, shard: int, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, offsets, document ids) of one shard, mapped and not copied where the file system is local."""
    system, path = _opened(folder)
    return (
        _mapped(system, f"{path}/tokens-{shard}.bin", f"<u{width}"),
        _mapped(system, f"{path}/offsets-{shard}.bin", "<u8"),
        _mapped(system, f"{path}/docs-{shard}.bin", "<i8"),
    )


def read_token_files(manifest: DataFrame, folder: str) -> DataFrame:
    """One row a document, read from the files: its place, token count and the crc32 of its ids as 32-bit integers."""

    def facts(batches):
        for batch in batches:
            for row in batch.to_pylist():
                ids, offsets, docs = read_shard(folder, row["shard"], row["width"])
                for at in range(0, row["n_docs"], 4096):
                    to = min(at + 4096, row["n_docs"])
                    bounds = offsets[at : to + 1].astype(np.int64)
                    block = np.ascontiguousarray(ids[bounds[0] : bounds[-1]], "<u4")
                    local = bounds - bounds[0]
                    crc = [zlib.crc32(block[a:b]) for a, b in zip(local[:-1], local[1:])]
                    missing = np.arange(at, to) < row["n_null"]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.asarray(docs[at:to]), mask=missing), pa.array(row["base"] + bounds[:-1]),
                            pa.array(np.diff(bounds)), pa.array(crc, pa.int64()),
                        ],
                        ["doc_id", "start", "n_tokens", "ids_crc32"],
                    )

    return spread_keys(manifest, "shard").mapInArrow(lean(facts), FACTS)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def token_files(docs: DataFrame, tokenizer: str | None = None, end_id: int = END_ID, folder: str | None = None) -> DataFrame:
    """Write the files and read every document back from them."""
    folder = folder or f"{shared_folder(docs.sparkSession)}/tokens-{uuid.uuid4().hex}"
    return read_token_files(write_token_files(docs, folder, tokenizer or default_tokenizer(), end_id), folder)


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files(table(spark, sf_dir, "documents"))


CHECKS = {"op10_token_files": (op10, None)}
