"""Near-duplicate listings: 64-bit SimHash fingerprints joined through a table of pivot distances.

Hamming distance is a metric, so two fingerprints within r bits have distances to any reference fingerprint (pivot) that
differ by at most r. The table holds the distances to sixteen pivots; a pair is dropped as soon as its largest coordinate
difference exceeds r, and only what survives is verified bit by bit.

Pairs meet through keys: the 64 bits are cut into r + 3 blocks, and two fingerprints within r bits agree on at least three
of them, so one of the keys made of three blocks (35 for r = 4) is common to both. A key is about 27 bits wide, hence the
expected number of chance meetings stays far below the number of fingerprints up to some billions of them.

Only different fingerprints are joined. A key that very many of them share is cut into chunks, and pairs of chunks become
groups of their own, so that no task gets more than ``2 * CHUNK`` of its rows. Within a large group links are found by a
search that leaves out whatever is linked already: the result is a spanning forest, not all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricelens.llm.common import components, cut, runs, text_bytes, version

SEED = 42
#: Keys with more fingerprints than this are cut into chunks.
CHUNK = 4096
#: Groups up to this size are compared pair by pair.
SMALL = 16
#: Reference fingerprints: hashes of their numbers, so that about half of the bits differ between any two.
PIVOTS = np.array([xxhash.xxh64_intdigest(f"pivot {i}".encode(), SEED) for i in range(16)], dtype=np.uint64)


def simhash(text: bytes, words_per_shingle: int = 4) -> int:
    """Fingerprint of a text: a bit is set if more than half of the shingle hashes have it. No words: zero."""
    words = text.lower().split()  # bytes: A-Z alone are lowered, white space is \x20 and \x09-\x0D
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1)
    if len(words) <= words_per_shingle:
        spans = [(0, len(joined))]
    else:
        starts = np.concatenate(([0], ends[:-words_per_shingle]))
        spans = list(zip(starts.tolist(), (ends[words_per_shingle - 1:] - 1).tolist()))
    digest = xxhash.xxh64_intdigest
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, len(spans), 1 << 16):
        hashes = np.array([digest(joined[a:b], SEED) for a, b in spans[at:at + (1 << 16)]], dtype="<u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(spans), bitorder="little").view("<u8")[0])


def fingerprints(listings: DataFrame, key: str = "obs_id", text: str = "description") -> DataFrame:
    """(key, v, bits): one row per input row, v telling texts of one key apart. A null text counts as empty; whole texts are read. Words are lowered in A-Z,
    four of them make a shingle; a shorter text is one shingle."""
    kind = listings.schema[key].dataType.simpleString()

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = np.array([simhash(b) for b in text_bytes(batch.column(2))], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(bits)], names=["key", "v", "bits"])

    return listings.select(F.col(key).alias("key"), version(F.col(text)).alias("v"), F.col(text).alias("text")).mapInArrow(
        each, f"key {kind}, v int, bits long")


def _masks(radius: int) -> list[int]:
    """Signed masks of all keys: three blocks out of radius + 3."""
    blocks = np.array_split(np.arange(64), radius + 3)
    masks = [sum(1 << int(i) for b in chosen for i in b) for chosen in combinations(blocks, 3)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def _pivot_table(bits: np.ndarray) -> np.ndarray:
    return np.bitwise_count(bits[:, None] ^ PIVOTS[None, :]).astype(np.int8)


def _small_links(key: np.ndarray, bits: np.ndarray, radius: int) -> Iterator[np.ndarray]:
    """Links of all groups of up to SMALL rows at once: row i against row i + k of the same group."""
    table = _pivot_table(bits)
    for k in range(1, SMALL):
        i = np.flatnonzero(key[:-k] == key[k:])
        if not len(i):
            return
        i = i[np.abs(table[i] - table[i + k]).max(axis=1) <= radius]
        i = i[np.bitwise_count(bits[i] ^ bits[i + k]) <= radius]
        yield np.stack([bits[i], bits[i + k]])


def _forest(bits: np.ndarray, radius: int) -> np.ndarray:
    """Links that span the components of one group: breadth first, each row leaves the search when it is first linked."""
    table = _pivot_table(bits)
    left = np.arange(len(bits))
    found: list[np.ndarray] = []
    while len(left):
        frontier, left = [int(left[0])], left[1:]
        while frontier and len(left):
            at = frontier.pop()
            near = np.abs(table[left, 0] - table[at, 0]) <= radius  # most rows go by the first coordinates
            near &= np.abs(table[left, 1] - table[at, 1]) <= radius
            rest = np.flatnonzero(near)
            rest = rest[np.abs(table[left[rest]] - table[at]).max(axis=1, initial=0) <= radius]
            rest = rest[np.bitwise_count(bits[left[rest]] ^ bits[at]) <= radius]
            if len(rest):
                new = left[rest]
                found.append(np.stack([np.full(len(new), bits[at]), bits[new]]))
                frontier.extend(new.tolist())
                left = np.delete(left, rest)
    return np.concatenate(found, axis=1) if found else np.empty((2, 0), dtype=np.uint64)


def links(distinct: DataFrame, radius: int = 4) -> DataFrame:
    """(a, b): enough pairs of different fingerprints within ``radius`` bits to connect all that are linked.

    ``distinct`` holds each fingerprint once, in a long column bits."""
    masks = F.array(*[F.struct(F.lit(t).alias("t"), F.lit(m).alias("m")) for t, m in enumerate(_masks(radius))])
    keys = distinct.select("bits", F.explode(masks).alias("k")).select(
        "bits", F.xxhash64("k.t", F.col("bits").bitwiseAND(F.col("k.m"))).alias("key"))
    large = keys.groupBy("key").count().where(F.col("count") > CHUNK).select(
        F.col("key").alias("large_key"), F.ceil(F.col("count") / (CHUNK // 2)).cast("long").alias("chunks"))
    own = F.pmod(F.xxhash64("bits"), F.col("chunks"))
    groups = (keys.join(large, F.col("key") == F.col("large_key"), "left")
              .select("bits", "key", "chunks", own.alias("own"))
              .select("bits", "key", "own", F.explode(F.when(F.col("chunks").isNull(), F.array(F.lit(0).cast("long")))
                                                      .otherwise(F.expr("sequence(0L, chunks - 1)"))).alias("other"), "chunks")
              .select("bits", F.when(F.col("chunks").isNull(), F.col("key"))
                      .otherwise(F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other"))).alias("group")))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in runs(batches, "group"):
            key = part.column("group").to_numpy()
            bits = part.column("bits").to_numpy().view(np.uint64)
            starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            sizes = np.diff(np.r_[starts, len(key)])
            few = np.repeat((sizes > 1) & (sizes <= SMALL), sizes)
            found = list(_small_links(key[few], bits[few], radius)) if few.any() else []
            found += [_forest(bits[s:s + n], radius) for s, n in zip(starts, sizes) if n > SMALL]
            if found:
                a, b = np.concatenate(found, axis=1).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return groups.repartition("group").sortWithinPartitions("group").mapInArrow(each, "a long, b long")


def _groups(marked: DataFrame, radius: int) -> DataFrame:
    """(bits, root): every fingerprint of ``marked`` with that of its component."""
    distinct = marked.select("bits").distinct()
    roots = components(links(distinct, radius))
    return distinct.join(roots, F.col("bits") == F.col("node"), "left").select("bits", F.coalesce("root", "bits").alias("root"))


def near_duplicates(listings: DataFrame, key: str = "obs_id", text: str = "description", radius: int = 4) -> DataFrame:
    """(key, fingerprint, component_id): one row per listing, with the smallest key that links lead to.

    Fingerprints link at ``radius`` or fewer differing bits; links chain. The fingerprint is 16 lowercase hex digits.
    Null and empty texts have fingerprint zero and are linked like others. Rows that repeat a key stay rows of their own;
    a null key never is a component_id unless its component has no other. Ties cannot occur: the smallest key is unique.
    An empty table gives an empty result. Other columns are ignored.
    """
    marked = cut(fingerprints(listings, key, text))
    groups = _groups(marked, radius)
    smallest = (marked.groupBy("bits").agg(F.min("key").alias("first")).join(groups, "bits").select("bits", "first", "root"))
    smallest = cut(smallest.groupBy("root").agg(F.min("first").alias("component_id"))
                   .join(smallest.select("bits", "root"), "root").select("bits", "component_id"))
    return marked.join(smallest, "bits").select(
        F.col("key").alias(key), F.lower(F.lpad(F.hex("bits"), 16, "0")).alias("fingerprint"), "component_id")


def first_of_groups(listings: DataFrame, key: str = "obs_id", text: str = "description", radius: int = 4) -> DataFrame:
    """``listings`` with one row of each near-duplicate group: that of the smallest key, of several with one key any text's.

    Rows and columns are as they were. A row with a null key stays only if its group has no other key.
    """
    marked = cut(fingerprints(listings, key, text))
    first = (marked.join(_groups(marked, radius), "bits").groupBy("root")
             .agg(F.min(F.struct(F.col("key").isNull().alias("nameless"), "key", "v")).alias("first")).select("first.key", "first.v"))
    rows = listings.select(F.struct("*").alias("row"), F.col(key).alias("k"), version(F.col(text)).alias("w"))
    kept = rows.join(first, F.col("k").eqNullSafe(F.col("key")) & (F.col("w") == F.col("v")), "left_semi").dropDuplicates(["k", "w"])
    return kept.select(*[F.col(f"row.`{c}`").alias(c) for c in listings.columns])
