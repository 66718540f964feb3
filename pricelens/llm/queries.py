"""The operators over the tables of a data folder: documents are read as listings, results are named as the tables are."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricelens.llm.common import cut, planned, remainder
from pricelens.llm.decontamination import contamination
from pricelens.llm.language import identify
from pricelens.llm.language_model import score
from pricelens.llm.lexical_search import ranked_search
from pricelens.llm.nearest import nearest
from pricelens.llm.packing import pack
from pricelens.llm.personal_data import KINDS as PERSONAL
from pricelens.llm.personal_data import find_personal_data
from pricelens.llm.personal_data import written as personal_spans
from pricelens.llm.prefix_trie import borrowed_beginnings, prefix_trie, threads
from pricelens.llm.quality import quality
from pricelens.llm.repeats import remove_repeats
from pricelens.llm.secrets import BASE, find_secrets, scan, written
from pricelens.llm.simhash import near_duplicates
from pricelens.llm.token_counts import token_counts, write_tokens
from pricelens.session import shared_folder
from pricelens.sources.observations import table

Query = Callable[[SparkSession, str], DataFrame]


def listings(documents: DataFrame) -> DataFrame:
    """Documents under the names of listing columns."""
    return documents.select(F.col("doc_id").alias("obs_id"), F.col("text").alias("description"), F.col("lang").alias("language"))


def read_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listings(table(spark, sf_dir, "documents"))


def op1_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_listings(spark, sf_dir)).withColumnRenamed("obs_id", "doc_id")


def op2_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = remainder(F.col("obs_id")) == 1
    return score(read_listings(spark, sf_dir), ~held_out).withColumn("held_out", held_out).withColumnRenamed("obs_id", "doc_id")


def op3_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("obs_id"), "embedding")
    return nearest(vectors, vectors.where("obs_id % 50 = 0")).withColumnRenamed("obs_id", "vec_id")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of each document, counted in flat files of all documents; a file's number and place give the doc_id back."""
    documents = read_listings(spark, sf_dir)
    rows = planned(documents)
    folder = shared_folder(spark, "tokens")
    write_tokens(rows, folder)
    place = F.monotonically_increasing_id()  # partition and place in it, as the files were written from the same partitions
    keys = rows.select("obs_id", F.shiftright(place, 33).alias("number"), place.bitwiseAND((1 << 33) - 1).alias("document"))
    counts = token_counts(spark, folder).withColumn("number", F.regexp_extract("file", r"part-(\d+)-[^/]*$", 1).cast("long"))
    found = cut(keys.join(counts, ["number", "document"]).select(F.col("obs_id").alias("doc_id"), "n_tokens"))
    files = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files.getFileSystem(spark._jsc.hadoopConfiguration()).delete(files, True)
    if (n := found.count()) != (wanted := documents.count()):
        raise RuntimeError(f"{n} token counts for {wanted} documents")
    return found


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = remainder(F.col("obs_id")) == 0
    reviews = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("obs_id"), F.col("quality").alias("keep"))
    return quality(read_listings(spark, sf_dir), reviews, ~held_out).select(
        F.col("obs_id").alias("doc_id"), held_out.alias("held_out"), "score", "predicted")


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read_listings(spark, sf_dir)).drop("ids").withColumnRenamed("obs_id", "doc_id")


def op7_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(read_listings(spark, sf_dir)).select(
        F.col("obs_id").alias("doc_id"), "n_words", "n_removed", F.sha2("description", 256).alias("kept_sha256"))


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_listings(spark, sf_dir)
    scanned = cut(scan(rows.select("obs_id", F.coalesce("description", F.lit("")).alias("description")), "description"))
    return find_secrets(rows, scanned).select(
        F.col("obs_id").alias("doc_id"), *[F.size(k).cast("long").alias(f"n_{k}") for k in BASE],
        F.sha2(written(F.col("spans"), len(BASE)), 256).alias("base_sha256"), written(F.col("spans")).alias("spans"))


def op9_contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "benchmark").select("item_id", "text")
    return contamination(read_listings(spark, sf_dir), items).select(
        F.col("obs_id").alias("doc_id"), "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), "contaminated")


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = remainder(F.col("obs_id")) == 0
    return identify(read_listings(spark, sf_dir), ~held_out).select(
        F.col("obs_id").alias("doc_id"), held_out.alias("held_out"), F.col("language").alias("lang_pred"), "score", "accepted")


def op11_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_personal_data(read_listings(spark, sf_dir)).select(
        F.col("obs_id").alias("doc_id"), *[F.size(k).cast("long").alias(f"n_{k}") for k in PERSONAL],
        F.sha2(personal_spans(F.concat(*PERSONAL)), 256).alias("base_sha256"), personal_spans(F.concat(*PERSONAL, "added")).alias("spans"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("topic_id"), F.col("turn").alias("line_no"), F.col("role").alias("author"), "text")
    return prefix_trie(borrowed_beginnings(threads(lines))).withColumnsRenamed(
        {"topic": "conv_id", "parent_topic": "parent_conv_id", "n_topics": "n_convs", "saved_chars": "saved_tokens"})


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    searches = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("search_key"), F.col("text").alias("query"))
    return ranked_search(read_listings(spark, sf_dir), searches).withColumnsRenamed({"search_key": "item_id", "obs_id": "doc_id"})


QUERIES: dict[str, Query] = {f.__name__: f for f in (
    op1_near_duplicates, op2_language_model, op3_nearest_vectors, op4_token_counts, op5_quality, op6_packing, op7_repeats, op8_secrets, op9_contamination,
    op10_language, op11_personal_data, op12_prefix_trie, op13_lexical_search)}
ORACLE: dict[str, str] = {
    "op3_nearest_vectors": """
WITH v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS n
  FROM embeddings WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e) / (q.n * c.n) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e)
  WHERE q.vec_id % 50 = 0 AND q.n > 0 AND c.n > 0 AND isfinite(q.n) AND isfinite(c.n)
)
SELECT query_id, rank, vec_id, score
FROM (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank FROM s)
WHERE rank <= 5
""",
    "op7_repeats": r"""
WITH w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents
), s AS (
  SELECT doc_id, i, array_to_string(ws[i:i + 34], ' ') AS win FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 33)) AS i FROM w)
), r AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS p
  FROM s JOIN (SELECT win FROM s GROUP BY win HAVING count(*) > 1) USING (win)
), k AS (
  SELECT a.doc_id, string_agg(a.word, ' ' ORDER BY a.p) FILTER (WHERE r.p IS NULL) AS kept, count(r.p) AS gone
  FROM (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p FROM w) a LEFT JOIN r ON r.doc_id = a.doc_id AND r.p = a.p GROUP BY a.doc_id
)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN k ON k.doc_id = w.doc_id
""",
    "op9_contamination": r"""
WITH low AS (
  SELECT 0 AS side, doc_id AS id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
  UNION ALL
  SELECT 1, item_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') FROM benchmark
), w AS (
  SELECT side, id, list_filter(regexp_split_to_array(t, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws FROM low
), g AS (
  SELECT DISTINCT id AS item, size, array_to_string(ws[i:i + size - 1], ' ') AS win
  FROM (SELECT id, ws, least(13, len(ws)) AS size, unnest(range(1, len(ws) - least(13, len(ws)) + 2)) AS i FROM w WHERE side = 1 AND len(ws) > 0)
), s AS (
  SELECT id, size, i, array_to_string(ws[i:i + size - 1], ' ') AS win
  FROM (SELECT id, ws, size, unnest(range(1, len(ws) - size + 2)) AS i FROM w CROSS JOIN (SELECT DISTINCT size FROM g) WHERE side = 0)
), h AS (
  SELECT id, item, s.size, i FROM s JOIN g ON g.win = s.win AND g.size = s.size
), n AS (
  SELECT id, count(DISTINCT p) AS n_hit FROM (SELECT id, unnest(range(i, i + size)) AS p FROM h) GROUP BY id
), m AS (
  SELECT id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT id, CAST(item AS VARCHAR) AS item FROM h WHERE item IS NOT NULL) GROUP BY id
)
SELECT w.id AS doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM w LEFT JOIN n ON n.id = w.id LEFT JOIN m ON m.id = w.id WHERE side = 0
""",
    "op12_prefix_trie": r"""
WITH t AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS i, coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL
), b AS (  -- crc32 of the decimal id, bit by bit
  SELECT DISTINCT conv_id, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT)) AS bytes FROM t
), c AS (
  SELECT conv_id, xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), bytes), lambda x, y:
    list_reduce(list_prepend(xor(x, y), [CAST(0 AS BIGINT), 0, 0, 0, 0, 0, 0, 0]), lambda u, v: xor(u >> 1, (u & 1) * 3988292384)))) % 6 AS h FROM b
), u AS (
  SELECT c.conv_id, t.i, t.role, t.text FROM c JOIN t ON t.conv_id = c.conv_id - c.conv_id % 100 AND t.i <= h
  UNION ALL
  SELECT c.conv_id, t.i, t.role, t.text FROM c JOIN t ON t.conv_id = c.conv_id AND t.i > h
), r AS (
  SELECT conv_id, row_number() OVER w AS d, length(text) AS size, md5(role) || md5(text) AS line FROM u WINDOW w AS (PARTITION BY conv_id ORDER BY i)
), p AS (  -- the node of each first d turns
  SELECT conv_id, 0 AS d, 0 AS size, '' AS node FROM c
  UNION ALL
  SELECT conv_id, d, size, string_agg(line, '') OVER (PARTITION BY conv_id ORDER BY d ROWS UNBOUNDED PRECEDING) FROM r
), n AS (
  SELECT node, any_value(d) AS d, any_value(size) AS size, min(conv_id) AS conv_id, count(*) AS n_convs FROM p GROUP BY node
), e AS (
  SELECT node, string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) AS ends FROM p
  WHERE (conv_id, d) IN (SELECT conv_id, max(d) FROM p GROUP BY conv_id) GROUP BY node
), k AS (
  SELECT n.node, n.conv_id, n.d, n.n_convs, n.size, a.node AS parent FROM n LEFT JOIN p a ON a.conv_id = n.conv_id AND a.d = n.d - 1
), m AS (
  SELECT parent AS node, count(*) AS n_children FROM k WHERE parent IS NOT NULL GROUP BY parent
), s AS (
  SELECT a.node, sum((k.n_convs - 1) * k.size) AS saved, count(*) FILTER (m.node IS NULL) AS leaves
  FROM k JOIN p a ON a.conv_id = k.conv_id AND a.d <= k.d LEFT JOIN m ON m.node = k.node GROUP BY a.node
)
SELECT k.conv_id, CAST(k.d AS BIGINT) AS depth, up.conv_id AS parent_conv_id, k.n_convs, coalesce(m.n_children, 0) AS n_children, s.leaves AS n_leaves,
  CAST(s.saved AS BIGINT) AS saved_tokens, sha256(coalesce(e.ends, '')) AS ends_sha256
FROM k JOIN s ON s.node = k.node LEFT JOIN m ON m.node = k.node LEFT JOIN e ON e.node = k.node LEFT JOIN n up ON up.node = k.parent
""",
    "op13_lexical_search": r"""
WITH low AS (
  SELECT 0 AS side, doc_id AS id, text FROM documents UNION ALL SELECT 1, item_id, text FROM benchmark
), t AS (
  SELECT side, id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM low
), s AS (
  SELECT count(*) AS docs, CAST(sum(len(ts)) AS BIGINT) AS total FROM t WHERE side = 0 AND len(ts) > 0
), i AS (
  SELECT id AS item_id, unnest(list_distinct(ts)) AS term FROM t WHERE side = 1
), p AS (
  SELECT id AS doc_id, n, term, count(*) AS tf FROM (SELECT id, len(ts) AS n, unnest(ts) AS term FROM t WHERE side = 0) GROUP BY ALL
), f AS (
  SELECT term, CAST(floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS w
  FROM p CROSS JOIN s WHERE term IN (SELECT term FROM i) GROUP BY term, docs
), r AS (
  SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + ((90 * n * docs) // total))))) AS BIGINT) AS score
  FROM i JOIN f USING (term) JOIN p USING (term) CROSS JOIN s GROUP BY item_id, doc_id
)
SELECT item_id, rank, doc_id, score
FROM (SELECT *, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INTEGER AS rank FROM r WHERE score > 0)
WHERE rank <= 10
""",
}
