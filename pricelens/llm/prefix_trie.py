"""The trie of the beginnings that threads share: which lines they have in common, and what storing each beginning once saves.

A thread (a forum topic) is the sequence of its lines; equal threads are one path of 16-byte digests of lines. Paths are cut into
ranges by splitters from a sample. A range is sorted and finishes all nodes that only its own paths pass. A node whose paths lie
in several ranges is the beginning of a splitter that parts them: these, the skeleton, are told from the splitters alone, which
every task knows. Of a skeleton node each range makes a partial aggregate, and the partial aggregates are reduced by node.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricelens.llm.common import cut, partitions, runs

#: Bytes of a line's digest; lines of a splitter; paths drawn for each splitter; lines of a range.
DIGEST, SPLITTER_LINES, DRAWN, RANGE_LINES = 16, 64, 16, 500_000
NO_ENDS = hashlib.sha256(b"").hexdigest()
#: Lines that a thread may take from the first of its hundred.
BORROWED, HUNDRED = 6, 100


def line_digest(author: str | Column, text: str | Column) -> Column:
    """Tells lines apart by author and text; null counts as empty."""
    author, text = F.coalesce(author, F.lit("")), F.coalesce(text, F.lit(""))
    return F.substring(F.unhex(F.sha2(F.concat(F.length(author).cast("string"), F.lit(":"), author, text).cast("binary"), 256)), 1, DIGEST)


def threads(lines: DataFrame, key: str = "topic_id", order: str = "line_no", author: str = "author", text: str = "text") -> DataFrame:
    """(topic, lines): one row per key, its lines in order as array<struct<at, digest, size>>; size is the text's code points.

    Null orders come first; lines of equal order are taken by digest, then by size, so repeated rows are lines one after
    another. Rows whose key is null or no whole number belong to no thread and are left out. Texts are digested before they are shuffled. A thread is
    one row: some forty bytes for each of its lines, however long these are.
    """
    topic = F.col(key).try_cast("long")
    rows = lines.where(topic.isNotNull()).select(
        topic.alias("topic"), F.struct(F.col(order).alias("at"), line_digest(F.col(author), F.col(text)).alias("digest"),
                                            F.length(F.coalesce(F.col(text), F.lit(""))).alias("size")).alias("line"))
    return rows.groupBy("topic").agg(F.sort_array(F.collect_list("line")).alias("lines"))


def borrowed_beginnings(found: DataFrame) -> DataFrame:
    """``threads`` of whole-number keys, each with its first h lines replaced by those of the thread its hundred begins with.

    h is the key's crc32 (of its decimal form) modulo six. The other thread gives the first h lines it has, none if it does not
    exist; the thread keeps its own lines after its first h.
    """
    h = F.pmod(F.crc32(F.col("topic").cast("string").cast("binary")), F.lit(BORROWED)).cast("int")
    first = found.where(F.col("topic") % HUNDRED == 0).select(F.col("topic").alias("base"), F.slice("lines", 1, BORROWED - 1).alias("given"))
    none = F.array().cast(found.schema["lines"].dataType)
    rows = found.select("topic", "lines", (F.col("topic") - F.col("topic") % HUNDRED).alias("base"), h.alias("h")).join(first, "base", "left")
    return rows.select("topic", F.concat(F.slice(F.coalesce("given", none), F.lit(1), F.col("h")), F.slice("lines", F.col("h") + 1, F.size("lines"))).alias("lines"))


def end_digests(topics: DataFrame) -> DataFrame:
    """(path_id, ends_sha256) of (path_id, topic): SHA-256 of the topics' decimal keys in ascending order, comma-joined.

    A hash is taken in one sequence, so each path is hashed in one task, from a sorted stream that is never held."""
    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, state = None, None
        for batch in batches:
            done = []
            for p, topic in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.string()).to_pylist()):
                if p != path:
                    if path is not None:
                        done.append((path, state.hexdigest()))
                    path, state = p, hashlib.sha256(topic.encode())
                else:
                    state.update(b"," + topic.encode())
            if done:
                yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.binary()), pa.array([d[1] for d in done])], names=["path_id", "ends_sha256"])
        if path is not None:
            yield pa.RecordBatch.from_arrays([pa.array([path], pa.binary()), pa.array([state.hexdigest()])], names=["path_id", "ends_sha256"])

    return topics.repartition("path_id").sortWithinPartitions("path_id", "topic").mapInArrow(hashed, "path_id binary, ends_sha256 string")


def splitters(paths: DataFrame, ranges: int) -> list[bytes]:
    """At most ``ranges`` - 1 beginnings that cut the paths into ranges of about equal numbers of lines, from a sample of them.

    The sample is a share of the paths by hash, of some DRAWN paths a range, and of each its first SPLITTER_LINES lines: so much comes
    to the driver, whatever the input."""
    n = paths.count()
    if ranges < 2 or n < 2:
        return []
    share = int(min(1.0, 2 * DRAWN * ranges / n) * (1 << 20)) + 1
    drawn = paths.where(F.pmod(F.xxhash64("path_id"), F.lit(1 << 20)) < share).select(
        F.substring("path", 1, SPLITTER_LINES * DIGEST).alias("begin"), (F.size("sizes") + 1).alias("weight"))
    found = sorted((bytes(r.begin), r.weight) for r in drawn.limit(8 * DRAWN * ranges).collect())  # four times what is awaited
    if not found:
        return []
    ends = np.cumsum([w for _, w in found])
    at = np.searchsorted(ends, ends[-1] * np.arange(1, ranges) / ranges)
    return sorted({found[i][0] for i in at.tolist()} - {b""})


@dataclass
class Node:
    """A node of a range's trie while the range's paths pass."""

    depth: int
    size: int = 0
    topic: int | None = None
    n: int = 0
    children: int = 0
    leaves: int = 0
    saved: int = 0
    end: bytes | None = None
    below: list = field(default_factory=list)


def skeleton_depth(path: bytes, low: bytes | None, high: bytes | None) -> int:
    """Up to which depth the nodes of a path are beginnings of one of its range's two splitters."""
    return max(_shared(path, low or b""), _shared(path, high or b""))


def _shared(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b)) // DIGEST
    if a[:n * DIGEST] == b[:n * DIGEST]:
        return n
    low, high = 0, n  # equal up to low, not up to high
    while high - low > 1:
        mid = (low + high) // 2
        low, high = (mid, high) if a[:mid * DIGEST] == b[:mid * DIGEST] else (low, mid)
    return low


def range_nodes(rows: list[tuple], low: bytes | None, high: bytes | None) -> Iterator[tuple]:
    """Nodes of a range's trie from its sorted (path, sizes, path_id, n, topic), as NODE tuples.

    Finished nodes come with the parent's topic, or with the parent's place in the skeleton. Skeleton nodes are partial: their
    children and leaves leave out those that are in the skeleton themselves, and their savings, too."""
    stack = [Node(0)]
    before = b""

    def place(path: bytes, depth: int) -> bytes:
        return hashlib.blake2b(path[:depth * DIGEST], digest_size=DIGEST).digest() if depth else b""

    def close(depth: int, path: bytes) -> Iterator[tuple]:
        """Nodes of ``path`` below ``depth`` are complete."""
        bones = skeleton_depth(path, low, high) if len(stack) - 1 > depth else 0
        while len(stack) - 1 > depth:
            node = stack.pop()
            up = stack[-1]
            up.n += node.n
            up.topic = node.topic if up.topic is None else min(up.topic, node.topic)
            up.leaves += node.leaves
            up.saved += node.saved
            if node.depth > bones:
                own = (node.n - 1) * node.size
                alone = not node.children
                up.leaves += alone
                up.saved += own
                up.children += 1
                row = (node.topic, node.depth, node.n, node.children, node.leaves + alone, node.saved + own, node.end)
                up.below.append(row)
                for child in node.below:
                    yield (*child, node.topic, None, None, None)
                if up.depth <= bones:  # the parent is of the skeleton, and it is not known here which topic names it
                    up.below.pop()
                    yield (*row, None, place(path, up.depth), None, None)
            else:
                yield (node.topic, node.depth, node.n, node.children, node.leaves, node.saved, node.end, None, place(path, node.depth),
                       [place(path, d) for d in range(node.depth)], node.size)

    for path, sizes, path_id, n, topic in rows:
        same = _shared(before, path)
        yield from close(same, before)
        for depth in range(same + 1, len(path) // DIGEST + 1):
            stack.append(Node(depth, sizes[depth - 1]))
        last = stack[-1]
        last.n, last.end = last.n + n, path_id
        last.topic = topic if last.topic is None else min(last.topic, topic)
        before = path
    yield from close(0, before)
    root = stack[0]
    yield (root.topic, 0, root.n, root.children, root.leaves, root.saved, root.end, None, b"", [], 0)


NODE = ("topic long, depth long, n_topics long, n_children long, n_leaves long, saved_chars long, path_id binary, "
        "parent_topic long, place binary, above array<binary>, size long")


def prefix_trie(found: DataFrame, ranges: int | None = None) -> DataFrame:
    """(topic, depth, parent_topic, n_topics, n_children, n_leaves, saved_chars, ends_sha256): the trie's nodes, from ``threads``.

    The project's threads are forum topics (``topic_id``) and the lines of their posts; any other sequences of authored texts with
    whole-number keys will do. A node is a sequence of first lines, author and text, that a thread begins with; the root
    is the empty one. ``topic`` is the smallest key among the n_topics threads that begin so, ``parent_topic`` the parent's (null for
    the root); n_leaves counts nodes without children in the subtree, its top included; saved_chars sums, over the subtree, each
    node's (n_topics - 1) times the code points of its last text; ends_sha256 is the SHA-256 of the keys of threads that end here
    (see ``end_digests``). Threads without lines end at the root. An empty frame gives an empty result. Texts are told apart by 128 bits of
    their SHA-256.

    ``ranges`` is the number of ranges, by default enough for RANGE_LINES lines each. A range is held by one task; equal threads are one path,
    however many they are. Paths and skeleton are stored when the frame is made.
    """
    spark = found.sparkSession
    path = F.unhex(F.array_join(F.transform("lines", lambda x: F.hex(x["digest"])), ""))
    keyed = cut(found.select("topic", path.alias("path"), F.transform("lines", lambda x: x["size"]).alias("sizes")).withColumn("path_id", F.unhex(F.sha2("path", 256))))
    paths = cut(keyed.groupBy("path_id").agg(F.any_value("path").alias("path"), F.any_value("sizes").alias("sizes"), F.count("*").alias("n"), F.min("topic").alias("topic")))
    if ranges is None:
        ranges = max(partitions(spark), -(-(paths.agg(F.sum(F.size("sizes"))).first()[0] or 0) // RANGE_LINES))
    cuts = spark.sparkContext.broadcast(splitters(paths, ranges))  # at most ranges * SPLITTER_LINES * DIGEST bytes

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = [bisect_right(cuts.value, p) for p in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), *batch.columns], names=["range", *batch.schema.names])

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64()] * 6 + [pa.binary(), pa.int64(), pa.binary(), pa.list_(pa.binary()), pa.int64()]
        for table in runs(batches, "range"):
            for at in sorted(set(table["range"].to_pylist())):
                part = table.filter(pa.compute.equal(table["range"], at))
                rows = sorted(zip(*(part[c].to_pylist() for c in ("path", "sizes", "path_id", "n", "topic"))), key=lambda r: r[0])
                some: list[tuple] = []
                for node in range_nodes(rows, cuts.value[at - 1] if at else None, cuts.value[at] if at < len(cuts.value) else None):
                    some.append(node)
                    if len(some) == 10_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*some), types)], names=NODES)
                        some = []
                if some:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*some), types)], names=NODES)

    dealt = paths.select("path", "sizes", "path_id", "n", "topic").mapInArrow(deal, "range int, path binary, sizes array<int>, path_id binary, n long, topic long")
    nodes = cut(dealt.repartition(ranges, "range").sortWithinPartitions("range").mapInArrow(finish, NODE))
    bones = nodes.where("above IS NOT NULL").groupBy("place").agg(
        F.min("topic").alias("topic"), F.first("depth").alias("depth"), F.sum("n_topics").alias("n_topics"), F.sum("n_children").alias("n_children"),
        F.sum("n_leaves").alias("n_leaves"), F.sum("saved_chars").alias("saved_chars"), F.max("path_id").alias("path_id"),
        F.first("above").alias("above"), F.first("size").alias("size"))
    up = F.element_at("above", -1)
    bones = cut(bones.withColumn("up", F.when(F.size("above") > 0, up)))
    # what skeleton nodes add to those above them: themselves as children, as leaves, and their own savings
    within = bones.groupBy(F.col("up").alias("place")).agg(F.count("*").alias("more_children")).where("place IS NOT NULL")
    counted = bones.join(within, "place", "left").withColumn("n_children", F.col("n_children") + F.coalesce("more_children", F.lit(0)))
    counted = counted.withColumn("own", (F.col("n_topics") - 1) * F.col("size")).withColumn("leaf", (F.col("n_children") == 0).cast("long"))
    sums = counted.select(F.explode(F.concat("above", F.array("place"))).alias("place"), "own", "leaf").groupBy("place").agg(
        F.sum("own").alias("more_saved"), F.sum("leaf").alias("more_leaves"))
    skeleton = counted.join(sums, "place").select("topic", "depth", "n_topics", "n_children", (F.col("n_leaves") + F.col("more_leaves")).alias("n_leaves"),
                                                  (F.col("saved_chars") + F.col("more_saved")).alias("saved_chars"), "path_id", F.col("up").alias("parent"))
    names = F.broadcast(bones.select(F.col("place").alias("parent"), F.col("topic").alias("named")))  # as many as splitters have lines, at most
    whole = ["topic", "depth", "n_topics", "n_children", "n_leaves", "saved_chars", "path_id"]
    local = nodes.where("above IS NULL").select(*whole, "parent_topic", F.col("place").alias("parent"))
    every = local.unionByName(skeleton.withColumn("parent_topic", F.lit(None).cast("long"))).join(names, "parent", "left")
    # nodes where nothing ends have a key of their own, or all of them would be of one partition
    end = F.coalesce("path_id", F.concat_ws(":", "topic", "depth").cast("binary"))
    ends = end_digests(keyed.select("path_id", "topic"))
    return every.withColumn("path_id", end).join(ends, "path_id", "left").select(
        "topic", "depth", F.coalesce("parent_topic", "named").alias("parent_topic"), "n_topics", "n_children", "n_leaves", "saved_chars",
        F.coalesce("ends_sha256", F.lit(NO_ENDS)).alias("ends_sha256"))


NODES = [c.split()[0] for c in NODE.split(", ")]
