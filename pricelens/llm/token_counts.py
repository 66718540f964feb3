"""Tokens per document of flat token files, by a scan for separators.

A flat file is a run of unsigned little-endian numbers without index or header; the end-of-document number closes each
document. Blocks of a file are searched for it with one vectorised comparison each. Where documents begin that were opened in an
earlier block is found by a prefix scan over the blocks' summaries.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pricelens.llm.tokens import encoded, tokenizer_path

#: Numbers are token ids plus one, so that zero is free to end a document. Tokens of a block.
END_OF_DOCUMENT, BLOCK = 0, 1 << 19
WIDTH = 2


def write_tokens(listings: DataFrame, folder: str, text: str = "description", path: str | None = None) -> None:
    """Flat files of the listings' tokens, one for each partition, its listings in their order. A null text is a document of none.

    The text writer puts the bytes down as they are, and its line separator is the end-of-document number."""
    path = path or tokenizer_path()

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, ids in (x for batch in batches for x in encoded(batch, 0, path, ordinary_specials=True)):
            yield pa.RecordBatch.from_arrays([pa.array([(i + 1).astype(f"<u{WIDTH}").tobytes() for i in ids], pa.binary())], names=["value"])

    (listings.select(F.col(text).alias("text")).mapInArrow(each, "value binary").select(F.col("value").cast("string"))
     .write.option("lineSep", "\0" * WIDTH).text(folder))


def token_counts(spark: SparkSession, folder: str, width: int = WIDTH, end: int = END_OF_DOCUMENT, block: int = BLOCK) -> DataFrame:
    """(file, document, n_tokens, closed): one row per document of the flat files in ``folder``, numbered from 0 in each file.

    The end number is not counted. Tokens after a file's last end number are a document that is not closed. Empty documents count
    zero; an empty file has none; bytes beyond the last whole number are left out. Spark reads a file as one value, so files of
    2 GB and more have to be split by whoever writes them. Blocks may be of any size: the result is the same.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(batch.column(0), batch.column(1)):
                data = np.frombuffer(content.as_buffer(), dtype=f"<u{width}", count=len(content.as_buffer()) // width)
                rows = [(n, len(part), np.flatnonzero(part == end)) for n, part in
                        ((at // block, data[at:at + block]) for at in range(0, len(data), block))]
                last = len(rows) - 1
                yield pa.RecordBatch.from_arrays([
                    pa.array([file.as_py()] * len(rows), pa.string()), pa.array([n for n, _, _ in rows], pa.int64()),
                    pa.array([s for _, s, _ in rows], pa.int64()), pa.array([e for _, _, e in rows], pa.list_(pa.int64())),
                    pa.array([n == last for n, _, _ in rows], pa.bool_())], names=["file", "block", "size", "ends", "last"])

    blocks = (spark.read.format("binaryFile").load(folder).select("path", "content")
              .mapInArrow(each, "file string, block long, size long, ends array<long>, last boolean"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    scanned = blocks.withColumn("base", F.coalesce(F.sum("size").over(before), F.lit(0))).withColumn(
        "latest", F.col("base") + F.get("ends", F.size("ends") - 1) + 1)
    scanned = scanned.select("file", "base", "ends", "last", "size",
                             F.coalesce(F.sum(F.size("ends")).over(before), F.lit(0)).alias("number"),
                             F.coalesce(F.max("latest").over(before), F.lit(0)).alias("opened"))
    ends = F.transform("ends", lambda e: F.col("base") + e)
    tail = F.col("base") + F.col("size")
    stops = F.concat(F.transform(ends, lambda e: F.struct(e.alias("at"), F.lit(True).alias("closed"))),
                     F.when(F.col("last") & (tail > F.coalesce(F.get(ends, F.size(ends) - 1) + 1, F.col("opened"))), F.array(F.struct(tail.alias("at"), F.lit(False).alias("closed"))))
                     .otherwise(F.array().cast("array<struct<at:bigint,closed:boolean>>")))
    starts = F.concat(F.array("opened"), F.transform(ends, lambda e: e + 1))
    counted = F.transform(stops, lambda s, i: F.struct((F.col("number") + i).alias("document"), (s["at"] - F.get(starts, i)).alias("n_tokens"), s["closed"].alias("closed")))
    return scanned.select("file", F.explode_outer(counted).alias("d")).where("d IS NOT NULL").select("file", "d.*")
