"""Log-probabilities of listing texts under a log-bilinear model trained by noise-contrastive estimation.

Counts of all training tokens are a table that is never gathered in one place; only its most frequent words go to every task.
The network predicts word classes: a frequent word is a class of its own, other words share a class by their ending. The
prediction vector of a context is the sum of one vector for each of its two classes; its products with the class vectors, plus
biases, are the scores, and a softmax over all classes makes them probabilities. Within a class a word has its smoothed share
of the class's tokens, so that text probabilities are normalised over all words.

Training sees every training text once, in ROUNDS parts. In a part each task takes steps of its own from the common weights, with
noise from the class frequencies, and the tasks' weights are averaged by tokens in a shuffle.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricelens.llm.common import cut, text_bytes

#: Most frequent words known to every task; classes of one word, class 0 being the end; classes by ending; vector length.
KNOWN, WORDS, ENDINGS, SIZE = 1 << 17, 384, 128, 16
CLASSES = WORDS + ENDINGS
ROUNDS, STEP, NOISE, RATE, FIRST = 2, 1024, 64, 0.1, 1e-6
#: The end of a text, as a word; no word is empty.
END = ""


def _ending(word: bytes) -> int:
    return WORDS + zlib.crc32(word[-2:]) % ENDINGS


def count_tokens(training: DataFrame) -> DataFrame:
    """(word, n) over all rows of ``training`` (text), the end included."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[bytes] = Counter()

        def rows() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()).cast(pa.string()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])

        for batch in batches:
            for text in text_bytes(batch.column(0)):
                counts.update(text.lower().split())
                counts[b""] += 1
                if len(counts) > 200_000:
                    yield rows()
                    counts.clear()
        yield rows()

    return training.mapInArrow(each, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


class Vocabulary:
    """What every task knows of the counts: KNOWN words at most, and sums for each class."""

    def __init__(self, counts: DataFrame):
        total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
        size = F.floor(F.log2("n") * 16)  # words of about one frequency are taken together or not at all
        rows, least = 0, None
        for r in sorted(counts.where(F.col("word") != END).groupBy(size.alias("size")).count().collect(), reverse=True):  # some hundred
            rows += r["count"]
            if rows > KNOWN:
                break
            least = r["size"]
        top = counts.where((F.col("word") != END) & (size >= least if least is not None else F.lit(False))).toPandas()
        top = top.sort_values(["n", "word"], ascending=[False, True], ignore_index=True)
        end = counts.where(F.col("word") == END).collect()
        words = [w.encode() for w in top["word"]]
        self.total, self.distinct = int(total), int(distinct)
        self.index = {w: i + 1 for i, w in enumerate(words)}
        self.counts = np.r_[end[0]["n"] if end else 0, top["n"].to_numpy(dtype=np.float64)].astype(np.float64)
        self.classes = np.array([0, *[i + 1 if i + 1 < WORDS else _ending(w) for i, w in enumerate(words)]], dtype=np.int64)
        # sums of the classes by ending over all words, as many rows as classes
        alone = top["word"].head(WORDS - 1).tolist()
        ending = F.pmod(F.crc32(F.substring(F.col("word").cast("binary"), -2, 2)), F.lit(ENDINGS)).cast("int")
        sums = counts.where((F.col("word") != END) & ~F.col("word").isin(alone)).groupBy(ending.alias("c")).agg(F.sum("n").alias("n"), F.count("*").alias("v"))
        self.tokens, self.kinds = np.zeros(CLASSES), np.zeros(CLASSES)
        self.tokens[:min(WORDS, len(self.counts))] = self.counts[:WORDS]
        for r in sums.collect():
            self.tokens[WORDS + r["c"]], self.kinds[WORDS + r["c"]] = r["n"], r["v"]
        self.base_denominator = math.log10(self.total + 0.5 * (self.distinct + 1))
        self.class_denominator = np.log10(self.tokens + 0.5 * (self.kinds + 1))
        self.class_denominator[:WORDS] = 0
        self.base = np.log10(self.counts + 0.5) - self.base_denominator
        self.within = np.where(self.classes >= WORDS, np.log10(self.counts + 0.5) - self.class_denominator[self.classes], 0.0)

    def read(self, text: bytes) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
        """Indices of a text's tokens (-1: not among the known words), their classes, and the words not known."""
        words = text.lower().split()
        get = self.index.get
        index = np.fromiter((get(w, -1) for w in words), dtype=np.int64, count=len(words))
        unknown = np.flatnonzero(index < 0)
        classes = np.append(self.classes[index], 0)
        rare = [words[i] for i in unknown]
        if rare:
            classes[unknown] = [_ending(w) for w in rare]
        return np.append(index, 0), classes, rare


def contexts(classes: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All tokens of some texts with the classes of the token before and the one before that; the end stands before a text."""
    flat = np.concatenate(classes)
    one, two = np.r_[0, flat[:-1]], np.r_[0, 0, flat[:-2]][:len(flat)]  # every text closes with the end
    two[np.r_[0, np.cumsum([len(c) for c in classes])[:-1]]] = 0
    return flat, one, two


class Model:
    """Context vectors for either place, class vectors and biases."""

    SHAPES = [(CLASSES, SIZE)] * 3 + [(CLASSES,)]

    def __init__(self, weights: np.ndarray):
        at = np.cumsum([0, *[math.prod(s) for s in self.SHAPES]])
        self.one, self.two, self.out, self.bias = (weights[a:b].reshape(s).astype(np.float32) for a, b, s in zip(at, at[1:], self.SHAPES))

    def weights(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in (self.one, self.two, self.out, self.bias)]).astype(np.float64)

    @classmethod
    def start(cls, share: np.ndarray) -> Model:
        draw = np.random.default_rng(7)
        return cls(np.concatenate([draw.normal(0, 0.1, 3 * CLASSES * SIZE), np.log(share)]))

    def steps(self, flat: np.ndarray, one: np.ndarray, two: np.ndarray, share: np.ndarray, squares: list[np.ndarray], draw: np.random.Generator) -> None:
        """Steps of noise-contrastive estimation over all tokens given, in random order; noise is common to a step."""
        log_noise = (np.log(share) + math.log(NOISE)).astype(np.float32)
        bounds = np.cumsum(share)
        order = draw.permutation(len(flat))
        for at in range(0, len(flat), STEP):
            rows = order[at:at + STEP]
            w, a, b = flat[rows], one[rows], two[rows]
            noise = np.searchsorted(bounds, draw.random(NOISE) * bounds[-1]).clip(0, CLASSES - 1)
            context = self.one[a] + self.two[b]
            true = np.einsum("ij,ij->i", context, self.out[w]) + self.bias[w] - log_noise[w]
            false = context @ self.out[noise].T + self.bias[noise] - log_noise[noise]
            up = 1 / (1 + np.exp(np.clip(true, -30, 30)))  # 1 - P(data)
            down = 1 / (1 + np.exp(-np.clip(false, -30, 30)))
            toward = up[:, None] * self.out[w] - down @ self.out[noise]
            out, bias = _added(w, up[:, None] * context), np.bincount(w, weights=up, minlength=CLASSES).astype(np.float32)
            np.subtract.at(out, noise, down.T @ context)
            np.subtract.at(bias, noise, down.sum(axis=0))
            for x, gradient, square in zip((self.one, self.two, self.out, self.bias), (_added(a, toward), _added(b, toward), out, bias), squares):
                gradient /= len(rows)  # steps are scaled by the root of the squares so far, one number for each class
                square += (gradient * gradient).mean(axis=1) if gradient.ndim > 1 else gradient * gradient
                rate = (RATE / np.sqrt(square)).astype(np.float32)
                x += gradient * (rate[:, None] if gradient.ndim > 1 else rate)

    def log_sums(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """Logarithm of the softmax's denominator for each context, by one matrix product for some thousands."""
        found = np.empty(len(one))
        columns = np.ascontiguousarray(self.out.T)
        for at in range(0, len(one), 4096):
            rows = slice(at, at + 4096)
            scores = (self.one[one[rows]] + self.two[two[rows]]) @ columns + self.bias
            most = scores.max(axis=1)
            scores -= most[:, None]
            found[rows] = most + np.log(np.exp(scores, out=scores).sum(axis=1, dtype=np.float64))
        return found


def _added(rows: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Sums of the values by row, for all classes."""
    columns = np.ascontiguousarray(values.T)
    return np.stack([np.bincount(rows, weights=c, minlength=CLASSES) for c in columns], axis=1).astype(np.float32)


def train(training: DataFrame, vocabulary, share: np.ndarray) -> np.ndarray:
    """Weights from all rows of ``training`` (part, text); part is the round that sees a row."""
    spark = training.sparkSession
    weights = Model.start(share).weights()
    for part in range(ROUNDS):
        start = spark.sparkContext.broadcast(weights)

        def each(batches: Iterator[pa.RecordBatch], start=start, part=part) -> Iterator[pa.RecordBatch]:
            model, n, squares, draw = Model(start.value), 0, [np.full(CLASSES, FIRST) for _ in Model.SHAPES], np.random.default_rng(part)
            for batch in batches:
                texts = text_bytes(batch.column(0))
                for at in range(0, len(texts), 256):
                    flat, one, two = contexts([vocabulary.value.read(t)[1] for t in texts[at:at + 256]])
                    model.steps(flat, one, two, share, squares, draw)
                    n += len(flat)
            if n:
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(start.value))), pa.array(model.weights() * n), pa.array(np.full(len(start.value), n))],
                                                 names=["i", "w", "n"])

        rows = (training.where(F.col("part") == part).select("text").mapInArrow(each, "i long, w double, n long")
                .groupBy("i").agg((F.sum("w") / F.sum("n")).alias("w")).toPandas())  # as many rows as weights
        weights = weights.copy()
        weights[rows["i"].to_numpy()] = rows["w"].to_numpy()
    return weights


def score(listings: DataFrame, learn: Column, key: str = "obs_id", text: str = "description") -> DataFrame:
    """(key, n_tokens, n_known, train_tokens, base_score, score): one row per listing.

    Tokens are the words of the text, lowered in A-Z, and one end. The counts and the model are learned from all rows where
    ``learn``, a condition on the key, holds. ``base_score`` is the sum of log10((c + 0.5) / (N + 0.5 (V + 1))), ``score`` the log10
    probability of the text under the model. ``n_known`` counts tokens that occur in training. A null or empty text is the end alone.
    With nothing to learn from, N and V are zero and the model is its start. Repeated rows count as often in training and give
    repeated results; a null ``learn`` is false. Other columns are ignored.
    """
    kind = listings.schema[key].dataType.simpleString()
    spark = listings.sparkSession
    rows = listings.select(F.col(key).alias("id"), F.col(text).alias("text"), F.coalesce(learn, F.lit(False)).alias("learn"))
    training = rows.where("learn").select("text", F.pmod(F.xxhash64("id", "text"), F.lit(ROUNDS)).alias("part"))
    counts = cut(count_tokens(training.select("text")))
    vocabulary = Vocabulary(counts)
    share = (vocabulary.tokens + 1) / (vocabulary.tokens + 1).sum()
    known = spark.sparkContext.broadcast(vocabulary)
    weights = spark.sparkContext.broadcast(train(training, known, share))
    total = vocabulary.total

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, v = Model(weights.value), known.value
        sums = np.full(CLASSES * CLASSES, np.nan)  # of the contexts met so far
        for batch in batches:
            texts = text_bytes(batch.column(1))
            for at in range(0, len(texts), 256):
                read = [v.read(t) for t in texts[at:at + 256]]
                flat, one, two = contexts([c for _, c, _ in read])
                index = np.concatenate([i for i, _, _ in read])
                code = one * CLASSES + two
                new = np.unique(code[np.isnan(sums[code])])
                sums[new] = model.log_sums(new // CLASSES, new % CLASSES)
                scores = np.einsum("ij,ij->i", model.one[one] + model.two[two], model.out[flat]) + model.bias[flat] - sums[code]
                seen = index >= 0
                logs = scores / math.log(10) + np.where(seen, v.within[index], -v.class_denominator[flat])
                base = np.where(seen, v.base[index], -v.base_denominator)
                first = np.r_[0, np.cumsum([len(i) for i, _, _ in read])[:-1]]
                rare = [Counter(w) for _, _, w in read]
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(at, 256), pa.array(np.diff(np.r_[first, len(flat)])), pa.array(np.add.reduceat(seen & (v.counts[index] > 0), first, dtype=np.int64)),
                    pa.array(np.add.reduceat(base, first)), pa.array(np.add.reduceat(logs, first)),
                    pa.array([list(c) for c in rare], pa.list_(pa.binary())).cast(pa.list_(pa.string())),
                    pa.array([list(c.values()) for c in rare], pa.list_(pa.int64()))], names=NAMES)

    scored = cut(rows.select("id", "text").mapInArrow(
        each, f"id {kind}, n_tokens long, n_known long, base double, model double, words array<string>, times array<long>")
        .withColumn("row", F.monotonically_increasing_id()))
    c = F.coalesce("n", F.lit(0))
    rest = (scored.select("row", F.explode(F.arrays_zip("words", "times")).alias("r")).select("row", F.col("r.words").alias("word"), "r.times")
            .join(counts, "word", "left").groupBy("row").agg(
                F.sum(F.col("times") * F.log10(c + 0.5)).alias("logs"), F.sum(F.when(c > 0, F.col("times")).otherwise(0)).alias("rare_known")))
    return scored.join(rest, "row", "left").select(
        F.col("id").alias(key), "n_tokens", (F.col("n_known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("logs", F.lit(0.0))).alias("base_score"), (F.col("model") + F.coalesce("logs", F.lit(0.0))).alias("score"))


NAMES = ["id", "n_tokens", "n_known", "base", "model", "words", "times"]
