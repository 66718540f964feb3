"""Quality of listing texts by Bradley-Terry ranking.

Every pair of a kept and a rejected listing is a preference. The chance that i is preferred to j is modelled as
sigmoid(w . (x_i - x_j)) on features of the whole text, and w minimises the logistic loss over such pairs. The raw score w . x
is then placed so that the quantile that leaves the share of kept listings above it becomes the score THRESHOLD. Share and quantile are those
of all labelled listings; only the fit takes a bounded sample of them.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricelens.llm.common import cut, text_bytes

#: Labelled rows that the fit takes at most unless told otherwise (those with the smallest hash of their key), and preference pairs drawn from them.
LABELLED, PAIRS = 20_000, 200_000
#: The quantile is found among counts of raw scores in steps of 1/STEPS, those beyond REACH together.
STEPS, REACH = 1024, 64
THRESHOLD = 0.3
_KINDS = {"lower": range(97, 123), "upper": range(65, 91), "digit": range(48, 58), "blank": (9, 10, 11, 12, 13, 32), "stop": b".,;:'\"!?()-",
          "symbol": b"#$%&*+/<=>@[\\]^_`{|}~", "other": range(128, 256)}
_TABLE = np.zeros((256, len(_KINDS)))
for _n, _codes in enumerate(_KINDS.values()):
    _TABLE[list(_codes), _n] = 1


def features(text: bytes) -> list[float]:
    """Shape of a whole text: shares of character kinds, word lengths, repetition of words and lines."""
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * 21
    histogram = np.bincount(np.frombuffer(text, dtype=np.uint8), minlength=256)
    shares = histogram @ _TABLE / len(text)
    counts = Counter(words)
    most = counts.most_common(1)[0][1]
    lengths = np.fromiter(map(len, words), dtype=np.float64, count=n)
    ends = sum(1 for w in words if w[-1] in b"!#$%&*|@~^=+") / n
    alone = sum(c for w, c in counts.items() if not w.isalnum() and len(w) == 1 and w[0] < 128) / n
    twice = sum(a == b for a, b in zip(words, words[1:])) / n
    lines = text.split(b"\n")
    spread = np.array(list(counts.values())) / n
    peak = np.max(histogram[33:127], initial=0, where=~_ALNUM[33:127]) / len(text)
    return [1.0, *shares.tolist(), np.log1p(n), lengths.mean(), lengths.std(), len(counts) / n, most / n, ends, alone, twice,
            1 - len(set(lines)) / len(lines), float(-(spread * np.log(spread)).sum()) / np.log(n + 1), peak,
            float(shares[1] > shares[0]), float(twice > 0.1)]


_ALNUM = np.array([chr(c).isalnum() for c in range(256)])


def fit(x: np.ndarray, kept: np.ndarray, seed: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean, deviation and weights by Newton steps on the logistic loss of feature differences of preference pairs."""
    mean, deviation = x.mean(axis=0), x.std(axis=0)
    deviation[deviation < 1e-9] = 1
    z = (x - mean) / deviation
    draw = np.random.default_rng(seed)
    better, worse = np.flatnonzero(kept), np.flatnonzero(~kept)
    d = z[draw.choice(better, PAIRS)] - z[draw.choice(worse, PAIRS)]
    w, ridge = np.zeros(z.shape[1]), 1e-3 * PAIRS
    for _ in range(15):
        p = 1 / (1 + np.exp(-np.clip(d @ w, -30, 30)))
        hessian = (d * (p * (1 - p))[:, None]).T @ d + ridge * np.eye(len(w))
        w = w + np.linalg.solve(hessian, d.T @ (1 - p) - ridge * w)
    return mean, deviation, w


def _cutoff(rows: DataFrame) -> float:
    """Raw score that as many of ``rows`` (raw, kept) reach as are kept, to a step; what is collected is as many rows as there are steps at most."""
    step = F.floor(F.greatest(F.lit(-REACH), F.least(F.lit(REACH), F.col("raw"))) * STEPS)
    found = rows.groupBy(step.alias("step")).agg(F.count("*").alias("n"), F.sum("kept").alias("kept")).orderBy(F.desc("step")).toPandas()
    reached = int(np.searchsorted(found["n"].cumsum().to_numpy(), found["kept"].sum()))
    return float(found["step"].iloc[reached]) / STEPS


def quality(listings: DataFrame, reviews: DataFrame, learn: Column, key: str = "obs_id", text: str = "description",
            label: str = "keep", labelled: int = LABELLED) -> DataFrame:
    """(key, score, predicted): one row per listing, score 0 to 1, predicted 1 where score >= THRESHOLD.

    ``reviews`` holds key and ``label`` (1 kept, 0 rejected; others and nulls are no label). The fit sees labels of rows for
    which ``learn``, a condition on the key, holds: at most ``labelled`` of them, which is what reaches the driver; the cutoff sees all. Scores come from the text alone. Null and empty
    texts are scored as such. Without labels of both kinds in the sample every text gets the share of kept ones among the labels, 0.5 where
    there are none. Repeated rows give repeated results; of several labels of a key the more frequent counts, 1 on a tie. Other columns are ignored.
    """
    kind = listings.schema[key].dataType.simpleString()

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [features(b) for b in text_bytes(batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x, pa.list_(pa.float64()))], names=["id", "x"])

    described = cut(listings.select(F.col(key).alias("id"), F.col(text).alias("text")).mapInArrow(each, f"id {kind}, x array<double>"))
    labels = (reviews.select(F.col(key).alias(key), F.col(label).cast("int").alias("kept"))
              .where(learn & F.col("kept").isin(0, 1)).groupBy(F.col(key).alias("id")).agg((F.avg("kept") >= 0.5).cast("int").alias("kept")))
    drawn = min(1.0, 2 * labelled / max(1, labels.count()))  # twice what is wanted, so that few rows reach the driver
    some = labels.where(F.xxhash64("id") <= F.lit((2 * drawn - 1) * float(1 << 63)))
    sample = described.join(some, "id").orderBy(F.xxhash64("id"), "kept").limit(labelled).select("x", "kept").toPandas()
    kept = sample["kept"].to_numpy(dtype=bool)
    if kept.all() or not kept.any():
        share = described.select("id").join(labels, "id").agg(F.avg("kept")).first()[0]
        score = F.lit(0.5 if share is None else float(share))
    else:
        x = np.array(sample["x"].tolist())
        mean, deviation, w = fit(x, kept)
        line = w / deviation
        product = F.aggregate(F.zip_with("x", F.array(*map(F.lit, line.tolist())), lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
        raw = product - F.lit(float(mean @ line))
        cutoff = _cutoff(described.select("id", raw.alias("raw")).join(labels, "id"))
        score = 1 / (1 + F.exp(-(raw + F.lit(float(np.log(THRESHOLD / (1 - THRESHOLD))) - cutoff))))
    return described.select(F.col("id").alias(key), score.alias("score")).withColumn(
        "predicted", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).cast("int"))
