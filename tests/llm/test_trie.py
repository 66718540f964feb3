"""The trie of threads' beginnings against brute force."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from pricelens.llm import prefix_trie as trie
from pricelens.llm import queries
from pricelens.llm.prefix_trie import borrowed_beginnings, prefix_trie, threads

LINE = "topic_id long, line_no long, author string, text string"


def plain_threads(lines):
    topics = {}
    for topic, no, author, text in lines:
        if topic is not None:
            topics.setdefault(topic, []).append((no is not None, no or 0, author or "", text or ""))
    return {t: [x[2:] for x in sorted(rows)] for t, rows in topics.items()}


def plain_borrowed(topics):
    out = {}
    for t, lines in topics.items():
        h = zlib.crc32(str(t).encode()) % 6
        out[t] = topics.get(t - t % 100, [])[:h] + lines[h:]
    return out


def plain_trie(topics):
    members = {}
    for t, lines in topics.items():
        for d in range(len(lines) + 1):
            members.setdefault(tuple(lines[:d]), []).append(t)
    children = {}
    for node in members:
        if node:
            children.setdefault(node[:-1], []).append(node)
    out = {}

    def visit(node):
        below = [visit(c) for c in children.get(node, [])]
        leaves = sum(b[0] for b in below) if below else 1
        saved = sum(b[1] for b in below) + (len(members[node]) - 1) * (len(node[-1][1]) if node else 0)
        ends = ",".join(map(str, sorted(t for t in members[node] if len(topics[t]) == len(node))))
        up = min(members[node[:-1]]) if node else None
        out[min(members[node]), len(node)] = (up, len(members[node]), len(below), leaves, saved, hashlib.sha256(ends.encode()).hexdigest())
        return leaves, saved

    if members:
        visit(())
    return out


def found(df):
    rows = df.collect()
    out = {(r.topic, r.depth): (r.parent_topic, r.n_topics, r.n_children, r.n_leaves, r.saved_chars, r.ends_sha256) for r in rows}
    assert len(out) == len(rows)
    return out


def drawn(seed, topics, spread):
    draw = random.Random(seed)
    lines = []
    for t in range(topics):
        t = t * 7 % 1000 + 1000 * (t % 2)
        for i in range(draw.choice([0, 1, 2, 3, 5, 12])):
            lines.append((t, i, draw.choice(["a", "b"]), f"é{draw.randrange(spread)}" * (1 + i % 3)))
    return lines


@pytest.mark.parametrize(("spread", "ranges"), [(1, 1), (2, 2), (2, 7), (3, 40), (40, 200), (1, 25)])
def test_nodes_equal_brute_force_however_many_ranges_there_are(spark, spread, ranges):
    lines = drawn(spread, 400, spread)
    rows = spark.createDataFrame(lines, LINE).repartition(3)
    topics = plain_threads(lines)
    assert found(prefix_trie(threads(rows), ranges)) == plain_trie(topics)
    assert found(prefix_trie(borrowed_beginnings(threads(rows)), ranges)) == plain_trie(plain_borrowed(topics))


def test_splitters_part_paths_that_share_beginnings():
    lines = drawn(9, 300, 2)
    paths = sorted({b"".join(hashlib.md5(f"{a}:{b}".encode()).digest() for a, b in rows) for rows in plain_threads(lines).values()})
    rows = [(p, [1] * (len(p) // 16), bytes([i % 250]), 1, i) for i, p in enumerate(paths)]
    cuts = paths[10::10]
    whole = [n for n in trie.range_nodes(rows, None, None) if n[7] is not None or n[8] is not None]
    every = {}
    for at in range(len(cuts) + 1):
        low, high = cuts[at - 1] if at else None, cuts[at] if at < len(cuts) else None
        some = [r for r in rows if (low is None or r[0] >= low) and (high is None or r[0] < high)]
        for n in trie.range_nodes(some, low, high):
            every.setdefault(n[8] if n[9] is not None else (n[0], n[1]), []).append(n)
    alone = [k for k, v in every.items() if isinstance(k, tuple)]
    assert all(len(every[k]) == 1 for k in alone) and max(len(v) for v in every.values()) > 10  # only skeleton nodes are of several ranges
    assert len(every) == len(whole) + (b"" not in {n[8] for n in whole if n[9] is not None})


def test_odd_threads(spark):
    lines = [(None, 1, "a", "x"), (5, None, "a", "first"), (5, 0, None, None), (5, 0, None, None), (5, 2, "", ""), (6, None, "a", "first"), (6, 1, "", ""),
             (7, 0, "a:", "b"), (8, 0, "a", ":b"), (9, 0, "a", "x" * 300_000), (10, 0, "a", "x" * 300_000), (100, 3, "u", "😀")]
    lines += [(11, i, "a", "again") for i in range(400)] + [(12, i, "a", "again") for i in range(300)] + [(t, 0, "a", "copy") for t in range(20, 60)]
    rows = spark.createDataFrame([(*x, 1) for x in lines], LINE + ", size int")
    for ranges in (1, 30):
        assert found(prefix_trie(threads(rows), ranges)) == plain_trie(plain_threads(lines))
        assert found(prefix_trie(borrowed_beginnings(threads(rows)), ranges)) == plain_trie(plain_borrowed(plain_threads(lines)))
    assert prefix_trie(threads(rows.limit(0))).count() == 0
    named = rows.withColumn("topic_id", F.concat(F.when(F.col("topic_id") == 9, "t").otherwise(""), F.col("topic_id").cast("string")))
    assert found(prefix_trie(threads(named), 2)) == plain_trie(plain_threads([x for x in lines if x[0] != 9]))


def test_topic_posts_share_lines(spark):
    posts = spark.createDataFrame([(3, ["Vends disque", "4 To"]), (4, ["Vends disque", "8 To"]), (9, ["Vends disque", "8 To"])], "topic_id long, lines array<string>")
    lines = posts.select("topic_id", F.posexplode("lines").alias("line_no", "text"), F.lit("seller").alias("author"))
    nodes = found(prefix_trie(threads(lines)))
    assert nodes[3, 1][:5] == (3, 3, 2, 2, 2 * len("Vends disque") + len("8 To")) and nodes[4, 2][:3] == (3, 2, 0)


def test_query_names_conversations(spark):
    sf = "/root/testdata/sf0.001"
    rows = queries.op12_prefix_trie(spark, sf)
    lines = [tuple(r) for r in queries.table(spark, sf, "conversations").select("conv_id", "turn", "role", "text").collect()]
    wanted = plain_trie(plain_borrowed(plain_threads(lines)))
    assert {(r.conv_id, r.depth): (r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in rows.collect()} == wanted
    assert all(t == "bigint" for c, t in rows.dtypes if c != "ends_sha256")
