"""Language of listing texts: nearest centroid of TF-IDF vectors of letter trigrams, several centroids per language.

Trigrams are taken over the letters of the lowered text, words apart by one blank, as UTF-8 bytes, and hashed to a fixed number
of dimensions. Document frequencies cover every training row. The centroids of a language come from spherical k-means over a
bounded sample of its rows. A text takes the language of the centroid with the largest cosine; the distance to it also tells
texts that are in none of the languages.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pricelens.llm.common import text_bytes

#: Dimensions of the hashed trigrams, sampled rows and centroids per language, rows of a matrix product.
DIMENSIONS, SAMPLE, CLUSTERS, ROWS = 1 << 14, 1000, 4, 128
#: Texts further from every centroid than this cosine are rejected: another script or no prose at all.
LEAST_SCORE = 0.05
LETTER = regex.compile(r"\p{L}")
_KEEP = bytes(c if c >= 128 or 97 <= c <= 122 else 32 for c in range(256))


def trigrams(text: str) -> np.ndarray:
    """Counts of the hashed trigrams of a whole text."""
    plain = b" ".join(text.lower().encode().translate(_KEEP).split())
    if not plain:
        return np.zeros(DIMENSIONS, dtype=np.float32)
    c = np.frombuffer(b" " + plain + b" ", dtype=np.uint8).astype(np.uint32)
    codes = (c[:-2] << np.uint32(16)) | (c[1:-1] << np.uint32(8)) | c[2:]
    return np.bincount((codes * np.uint32(2654435761)) >> np.uint32(18), minlength=DIMENSIONS).astype(np.float32)


def _vectors(texts: list[str], idf: np.ndarray) -> np.ndarray:
    m = np.stack([trigrams(t) for t in texts])
    np.log1p(m, out=m)
    m *= idf
    size = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(size > 0, size, 1)


def document_frequencies(training: DataFrame) -> tuple[np.ndarray, int]:
    """In how many texts each dimension occurs, and the number of texts; over all rows of ``training`` (text)."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(DIMENSIONS, dtype=np.int64), 0
        for batch in batches:
            for text in text_bytes(batch.column(0)):
                total += trigrams(text.decode()) > 0
                n += 1
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.r_[some, -1]), pa.array(np.r_[total[some], n])], names=["dim", "n"])

    rows = training.mapInArrow(each, "dim long, n long").groupBy("dim").agg(F.sum("n").alias("n")).collect()  # DIMENSIONS + 1 at most
    found = {r["dim"]: r["n"] for r in rows}
    n = found.pop(-1, 0)
    df = np.zeros(DIMENSIONS)
    df[list(found)] = list(found.values())
    return df, n


def _cluster(x: np.ndarray, k: int) -> np.ndarray:
    """Spherical k-means from rows picked far apart; unit centroids."""
    chosen = [0]
    far = x @ x[0]
    while len(chosen) < min(k, len(x)):
        chosen.append(int(far.argmin()))
        far = np.maximum(far, x @ x[chosen[-1]])
    centroids = x[chosen]
    for _ in range(10):
        own = (x @ centroids.T).argmax(axis=1)
        sums = np.stack([x[own == c].sum(axis=0) if (own == c).any() else centroids[c] for c in range(len(centroids))])
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        centroids = sums / np.where(size > 0, size, 1)
    return centroids


def train(training: DataFrame) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """idf, centroids and their languages from ``training`` (id, text, language), rows without a null in language.

    At most SAMPLE rows of a language are clustered, those with the smallest hash of key and text; the model is bounded by
    the number of languages.
    """
    df, n = document_frequencies(training.select("text"))
    idf = (np.log((1 + n) / (1 + df)) + 1).astype(np.float32)
    rank = F.xxhash64("id", "text")
    sizes = {r["language"]: r["n"] for r in training.groupBy("language").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return idf, np.zeros((0, DIMENSIONS), dtype=np.float32), []
    share = F.lit(0.0)
    for language, rows in sizes.items():  # languages, not rows
        share = F.when(F.col("language") == language, min(1.0, 4 * SAMPLE / rows)).otherwise(share)
    sample = (training.withColumn("order", rank)
              .where(F.col("order") <= (share * 2 - 1) * float(1 << 63))
              .withColumn("nth", F.row_number().over(Window.partitionBy("language").orderBy("order")))
              .where(F.col("nth") <= SAMPLE))

    def fit(group: pd.DataFrame) -> pd.DataFrame:
        x = _vectors(["" if t is None else t for t in group.sort_values("order")["text"]], idf)
        x = x[np.linalg.norm(x, axis=1) > 0]
        centroids = _cluster(x, CLUSTERS) if len(x) else x
        return pd.DataFrame({"language": group["language"].iloc[0], "centroid": [c.tolist() for c in centroids]})

    rows = sample.groupBy("language").applyInPandas(fit, "language string, centroid array<float>").collect()
    rows.sort(key=lambda r: (r["language"], r["centroid"]))
    return idf, np.array([r["centroid"] for r in rows], dtype=np.float32).reshape(-1, DIMENSIONS), [r["language"] for r in rows]


def _judge(spark: SparkSession, idf: np.ndarray, centroids: np.ndarray, names: list[str]) -> Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]:
    """Language and score of a column of texts."""
    model = spark.sparkContext.broadcast((idf, centroids))

    def judge(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        weights, nearest = model.value
        texts = [b.decode() for b in text_bytes(column)]
        found = np.full(len(texts), "und", dtype=object)
        score = np.zeros(len(texts))
        some = np.array([i for i, t in enumerate(texts) if len(nearest) and LETTER.search(t)], dtype=np.int64)
        for at in range(0, len(some), ROWS):
            rows = some[at:at + ROWS]
            close = _vectors([texts[i] for i in rows], weights) @ nearest.T
            found[rows] = [names[c] for c in close.argmax(axis=1)]
            score[rows] = close.max(axis=1).clip(0, 1)
        return found, score

    return judge


def _learned(listings: DataFrame, learn: Column, key: str, text: str, language: str) -> tuple[np.ndarray, np.ndarray, list[str]]:
    rows = listings.select(F.col(key).alias("id"), F.col(text).alias("text"), F.col(language).alias("language"), learn.alias("learn"))
    return train(rows.where(F.col("learn") & F.col("language").isNotNull()).select("id", "text", "language"))


def identify(listings: DataFrame, learn: Column, key: str = "obs_id", text: str = "description", language: str = "language",
             least_score: float = LEAST_SCORE) -> DataFrame:
    """(key, language, score, accepted): one row per listing; the model is learned from rows where ``learn`` holds and
    ``language`` is not null.

    The language is that of the nearest centroid, ties to the smaller name; it is ``und`` with score 0 for a text that is null or
    empty or has no letter, and for every text when no row could be learned from. The score is the cosine. ``accepted`` is false
    for ``und`` and for texts whose score is below ``least_score``. Key and language are never inputs of a prediction.
    Repeated rows give repeated results. Other columns are ignored.
    """
    kind = listings.schema[key].dataType.simpleString()
    judge = _judge(listings.sparkSession, *_learned(listings, learn, key, text, language))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, score = judge(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.tolist(), pa.string()), pa.array(score)], names=["id", "language", "score"])

    return listings.select(F.col(key).alias("id"), F.col(text).alias("text")).mapInArrow(each, f"id {kind}, language string, score double").select(
        F.col("id").alias(key), F.col("language").alias(language), "score",
        ((F.col("language") != "und") & (F.col("score") >= least_score)).alias("accepted"))


def in_known_language(listings: DataFrame, learn: Column, key: str = "obs_id", text: str = "description", language: str = "language",
                      least_score: float = LEAST_SCORE) -> DataFrame:
    """``listings`` without those that ``identify`` does not accept; rows and columns are as they were."""
    judge = _judge(listings.sparkSession, *_learned(listings, learn, key, text, language))
    place = listings.columns.index(text)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, score = judge(batch.column(place))
            yield batch.filter(pa.array((found != "und") & (score >= least_score)))

    return listings.mapInArrow(each, listings.schema)
