"""Helpers shared by the text operators: cutting lineage, splits by key, words, components of a graph of links."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pricelens.session import checkpoint_folder

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def cut(df: DataFrame) -> DataFrame:
    """The same rows from files in the shared checkpoint folder, so that a lost executor costs no earlier stage."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint()


def planned(df: DataFrame) -> DataFrame:
    """The same rows with the partitions that a scan gets now: whatever is made of them later, whichever executors there are then,
    sees the same rows in the same partitions and places. Nothing is stored."""
    spark = df.sparkSession
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(df._jdf.queryExecution().toRdd(), df._jdf.schema(), False), spark)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def remainder(key: Column) -> Column:
    """crc32 of the key's text modulo 5: the split into training and held-out rows."""
    return F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(5))


def ascii_lower(text: Column) -> Column:
    """Lower case for A-Z alone."""
    return F.translate(text, UPPER, LOWER)


def version(text: Column) -> Column:
    """Tells rows apart that share a key but not a text."""
    return F.hash(text)


def text_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 of each text; null counts as empty."""
    return [b or b"" for b in column.cast(pa.binary()).to_pylist()]


def runs(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Regroup the batches of a partition that is sorted by ``key``, so that no value of it spans two tables."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        values = batch.column(key).to_numpy(zero_copy_only=False)
        start = int(values.searchsorted(values[-1]))  # of the run that may go on in the next batch
        if start:
            yield pa.Table.from_batches([*held, batch.slice(0, start)])
            held = []
        elif held and held[-1].column(key)[-1].as_py() != values[0]:
            yield pa.Table.from_batches(held)
            held = []
        held.append(batch.slice(start))
    if held:
        yield pa.Table.from_batches(held)


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every node with a link: root is the same for all nodes that links connect.

    ``links`` has long columns a and b. Each round merges every node into the first of its neighbourhood in the order of a
    hash and keeps the links between what remains, so that chains, too, shrink by a constant factor a round. Nothing is
    gathered in one place.
    """
    order = lambda c: F.struct(F.xxhash64(c).alias("hash"), F.col(c).alias("root"))
    links = links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    spark, roots = links.sparkSession, None
    links = cut(links)
    while not links.isEmpty():
        both = links.unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        step = cut(both.groupBy(F.col("a").alias("node")).agg(F.min(F.least(order("a"), order("b"))).alias("first")).select("node", "first.root"))
        to = lambda side: step.select(F.col("node").alias(side), F.col("root").alias(f"{side}_root"))
        links = cut(links.join(to("a"), "a").join(to("b"), "b").where("a_root <> b_root")
                    .select(F.least("a_root", "b_root").alias("a"), F.greatest("a_root", "b_root").alias("b")).distinct())
        if roots is None:
            roots = step
        else:
            nxt = step.select(F.col("node").alias("root"), F.col("root").alias("next"))
            roots = cut(roots.join(nxt, "root", "left").select("node", F.coalesce("next", "root").alias("root")))
    return spark.createDataFrame([], "node long, root long") if roots is None else roots
