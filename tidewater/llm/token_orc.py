"""Token ids in ORC files.

Documents are encoded and written in ascending id order, one row each, as ORC: the ids as an integer list (ORC's
run-length encoding of integers), with row indexes and a Bloom filter on the document id, so that readers can take
stripes in parallel and skip stripes and row groups by id. Files are ranges of the id; their order by least id is the
corpus order.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import checkpoint, estimated_bytes, partitions
from .textkernel import slices
from .tokens import encoder


def write_tokens(docs: DataFrame, path: str, vocabulary: str, end_id: int, lower: bool = True, id_col: str = "doc_id", text_col: str = "text", files: int | None = None, stripe_mb: int = 64) -> str:
    """Encodes every whole text, appends ``end_id``, and writes (doc_id, row_tag, ids) to ``path``; returns the path.

    Null and empty texts have the end id alone. Null ids come first; rows with one id are ordered by a hash of the text.
    Texts are shuffled once, by ranges of the id, and encoded after it, since ids are larger than compressed text.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    end = int(end_id).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = encoder(vocabulary, lower)
        for b in slices(batches, "text"):
            ids = [x + end for x in code.encode([t or "" for t in b.column(2).to_pylist()])]
            at = np.zeros(len(ids) + 1, dtype=np.int64)
            np.cumsum([len(x) // 4 for x in ids], out=at[1:])
            flat = pa.Array.from_buffers(pa.int32(), int(at[-1]), [None, pa.py_buffer(b"".join(ids))])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), flat)], names=["doc_id", "row_tag", "ids"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("row_tag"), F.col(text_col).alias("text"))
    rows = rows.repartitionByRange(files or partitions(docs.sparkSession, estimated_bytes(docs)), F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "row_tag")
    coded = rows.mapInArrow(run, f"doc_id {kind}, row_tag long, ids array<int>")
    options = {"orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01", "orc.create.index": "true", "orc.row.index.stride": "10000", "orc.stripe.size": str(stripe_mb << 20), "compression": "lz4"}
    coded.write.options(**options).orc(path)
    return path


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """The rows of the files, ids of documents in their own type; filters on doc_id prune files, stripes and row groups by
    statistics and Bloom filters."""
    return spark.read.orc(path)


def token_index(spark: SparkSession, path: str) -> DataFrame:
    """From the files: doc_id, start (ids of all documents before), n_tokens, ids_crc32.

    Starts are a prefix sum in two levels, over files and within each file, so no task sees all documents. The files are
    read once; what is left of each row, some integers, goes through the shared folder.
    """

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(3)
            at = lists.offsets.to_numpy()
            data = np.ascontiguousarray(lists.values.to_numpy(zero_copy_only=False), dtype="<u4").view(np.uint8)
            sums = [zlib.crc32(data[4 * i : 4 * j]) for i, j in zip(at[:-1], at[1:])]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(np.diff(at).astype(np.int64)), pa.array(sums, pa.int64())], names=["file", "doc_id", "row_tag", "n_tokens", "ids_crc32"])

    rows = read_tokens(spark, path).select(F.input_file_name().alias("file"), "doc_id", "row_tag", "ids")
    kind = rows.schema["doc_id"].dataType.simpleString()
    rows = checkpoint(rows.mapInArrow(digest, f"file string, doc_id {kind}, row_tag long, n_tokens long, ids_crc32 long"))
    order = [F.col("doc_id").asc_nulls_first(), "row_tag"]
    files = rows.groupBy("file").agg(F.min(F.struct(F.col("doc_id").isNotNull(), "doc_id", "row_tag")).alias("least"), F.sum("n_tokens").alias("n"))
    files = files.select("file", F.coalesce(F.sum("n").over(Window.orderBy("least").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    within = Window.partitionBy("file").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("prior", F.coalesce(F.sum("n_tokens").over(within), F.lit(0)))
    return rows.join(files, "file").select("doc_id", (F.col("before") + F.col("prior")).alias("start"), "n_tokens", "ids_crc32")
