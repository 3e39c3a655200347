"""Token ids in ORC: run-length encoded integers, row indexes and Bloom filters on document ids.

Documents are dealt to files by ranges of ``doc_id`` and lie in ascending order within
and across files, so stripe and row-group statistics prune by id, and a Bloom filter
settles point look-ups. Every stripe can be read by its own task.

Defined results: null and empty texts hold the end id alone; rows with one id keep all
their copies, next to each other, in the order of a hash of the text, and may lie in several
files; a null id sorts first; very long texts are encoded whole; an empty table gives an empty file
set and no rows; other columns of the input are ignored.
"""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from textguard.llm import bpe, memory
from textguard.llm.common import partitions, scratch_path, small_batches

#: Rows between entries of the row index, bytes of a stripe, share of false Bloom hits.
INDEX_STRIDE, STRIPE_BYTES, BLOOM_FPP = 1000, 16 << 20, 0.01
ORC_SCHEMA = "doc_id long, part int, row long, n_tokens long, ids array<int>"


def _encode(path: str, end_id: int):
    def run(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        memory.claim("bpe")
        enc, part, row, end = bpe.encoder(path), TaskContext.get().partitionId(), 0, end_id.to_bytes(4, "little")
        for batch in batches:
            texts = batch.column(1).to_pylist()
            ids = [enc.encode(t) + end for t in texts]
            n = np.fromiter((len(x) // 4 for x in ids), np.int64, len(ids))
            flat = pa.Array.from_buffers(pa.int32(), int(n.sum()), [None, pa.py_buffer(b"".join(ids))])
            offsets = pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32))
            rows = np.arange(row, row + len(ids))
            row += len(ids)
            columns = [batch.column(0), pa.array(np.full(len(ids), part, np.int32)), pa.array(rows), pa.array(n), pa.ListArray.from_arrays(offsets, flat)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "part", "row", "n_tokens", "ids"])

    return run


def write_tokens(docs: DataFrame, out: str, tokenizer: str | None = None, end_id: int = 2) -> None:
    """Encode whole texts, append ``end_id``, write ORC files in ascending ``doc_id`` order."""
    spark = docs.sparkSession
    small_batches(spark)
    # ties are dealt on by the text's hash and then by the row's place, so that no id holds a file to itself
    ties = docs.select("doc_id", "text", F.xxhash64("text").alias("tie"), F.monotonically_increasing_id().alias("place"))
    order = (F.col("doc_id").asc_nulls_first(), "tie", "place")
    dealt = ties.repartitionByRange(partitions(docs), *order).sortWithinPartitions(*order).select("doc_id", "text")
    encoded = dealt.mapInArrow(_encode(tokenizer or bpe.default_path(), end_id), ORC_SCHEMA)
    (
        encoded.write.option("compression", "lz4")
        .option("orc.bloom.filter.columns", "doc_id")
        .option("orc.bloom.filter.fpp", str(BLOOM_FPP))
        .option("orc.row.index.stride", str(INDEX_STRIDE))
        .option("orc.stripe.size", str(STRIPE_BYTES))
        .option("orc.create.index", "true")
        .orc(out)
    )


def read_tokens(spark: SparkSession, path: str, doc_ids: list[int] | None = None) -> DataFrame:
    """The documents of a token store; with ids, only stripes and row groups that may hold them are read."""
    found = spark.read.schema(ORC_SCHEMA).orc(path)
    return found if doc_ids is None else found.where(F.col("doc_id").isin([int(x) for x in doc_ids]))


def _digest(batches):
    import pyarrow as pa

    memory.claim("orc")
    for batch in batches:
        ids = batch.column(3)
        raw, ends = memoryview(ids.values.cast(pa.int32()).buffers()[1]).cast("B"), ids.offsets.to_pylist()
        at = 4 * ids.values.offset
        crc = [zlib.crc32(raw[at + 4 * a : at + 4 * b]) for a, b in zip(ends, ends[1:], strict=False)]
        n = [b - a for a, b in zip(ends, ends[1:], strict=False)]
        columns = [*(batch.column(k) for k in range(3)), pa.array(n, pa.int64()), pa.array(crc, pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "part", "row", "n_tokens", "ids_crc32"])


def document_index(spark: SparkSession, path: str) -> DataFrame:
    """Per document of a store: place in the whole run of ids, count and checksum of its ids.

    Starts are sums over the files before (one short row for each file) plus a running
    sum within the file, so no task sees more than one file's rows.
    """
    small_batches(spark)
    stored = read_tokens(spark, path)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    files = stored.groupBy("part").agg(F.sum("n_tokens").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    rows = stored.select("doc_id", "part", "row", "ids").mapInArrow(_digest, "doc_id long, part int, row long, n_tokens long, ids_crc32 long")
    within = Window.partitionBy("part").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("inside", F.coalesce(F.sum("n_tokens").over(within), F.lit(0)))
    return placed.join(files, "part").select("doc_id", (F.col("base") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")


def token_store_index(docs: DataFrame, tokenizer: str | None = None, end_id: int = 2) -> DataFrame:
    """Write a store of all documents to shared scratch and index it from its files."""
    path = scratch_path(docs.sparkSession, "orc")
    write_tokens(docs, path, tokenizer, end_id)
    return document_index(docs.sparkSession, path)
