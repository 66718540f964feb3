"""Listings ranked by the words they share with search texts, by K2-treaps over term-document grids.

Tasks cut their listings into shards. A shard is a grid of terms (rows, the heaviest first) and listings (columns), an entry the
impact of the term on the listing's score. The grid is a compressed quadtree: a level holds its non-empty cells alone, each with
its greatest impact, a mask of its quarters and the place of the first of them. A search is one path for each of its terms from
the root to the term's row; all its paths descend together. A range of listings is as good as the sum of the cells that the paths
have reached above it: the best ranges are halved first, and what stays below the tenth score found is never looked at.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from pricelens.llm.common import cut, text_bytes

TOP = 10
#: A shard ends at so many listings or entries; searches of one block have so many bytes; ranges are halved so many at a time.
SHARD, ENTRIES, BLOCK_BYTES, TOGETHER = 16384, 2_000_000, 4 << 20, 256
#: Texts that a task splits at a time; parts of the last ranking before it is made whole.
SLICE, PARTS = 512, 64
SPLIT = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms(text: bytes) -> list[bytes]:
    """Runs of digits, letters and everything beyond ASCII, A-Z lowered."""
    return text.translate(SPLIT).split()


@dataclass
class Searches:
    """A block of searches: their keys, the places of their terms, and all terms by place."""

    keys: list
    rows: list[np.ndarray]
    vocabulary: dict[bytes, int]

    @classmethod
    def of(cls, texts: list[tuple]) -> Searches:
        vocabulary: dict[bytes, int] = {}
        rows = [np.array(sorted({vocabulary.setdefault(t, len(vocabulary)) for t in terms((text or "").encode())}), dtype=np.int64) for _, text in texts]
        return cls([key for key, _ in texts], rows, vocabulary)


@dataclass
class Corpus:
    """Of all listings: how many have terms, how many terms they have, and how many listings have each term."""

    n: int
    total: int
    df: np.ndarray

    def weights(self) -> np.ndarray:
        return np.array([math.floor(1000 * math.log((2 * self.n + 2) / (2 * d + 1))) for d in self.df.tolist()], dtype=np.int64)

    def impacts(self, weight: np.ndarray, tf: np.ndarray, size: np.ndarray) -> np.ndarray:
        m = 100 - 90 + (90 * size * self.n) // self.total
        return weight * ((1_000_000_000 * tf) // (1000 * tf + 8 * m))


def _spread(x: np.ndarray) -> np.ndarray:
    """The lower 32 bits of x, a zero before each."""
    x = x.astype(np.uint64)
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        x = (x | (x << np.uint64(shift))) & np.uint64(mask)
    return x


#: Bits set in a mask of four quarters.
BITS = np.array([bin(i).count("1") for i in range(16)], dtype=np.int64)


class Treap:
    """Compressed quadtree of greatest values over a grid of rows and columns. Cell 0 stands for all empty ones, cell 1 is the root."""

    def __init__(self, rows: np.ndarray, columns: np.ndarray, values: np.ndarray):
        size = [int(x.max()).bit_length() for x in (rows, columns)]
        self.height = max(1, *size)
        self.shift = self.height - max(1, size[0])  # few rows lie far apart: paths reach them while ranges of columns are still wide
        code = (_spread(rows << self.shift) << np.uint64(1)) | _spread(columns)
        order = np.argsort(code, kind="stable")
        code, best = code[order], values[order]
        levels = [(best, np.zeros(len(best), dtype=np.int64), np.zeros(len(best), dtype=np.int64))]
        for _ in range(self.height):
            first = np.flatnonzero(np.r_[True, (code[1:] >> np.uint64(2)) != (code[:-1] >> np.uint64(2))])
            mask = np.bitwise_or.reduceat(1 << (code & np.uint64(3)).astype(np.int64), first)
            code, best = code[first] >> np.uint64(2), np.maximum.reduceat(best, first)
            levels.append((best, mask, first))
        levels.reverse()
        starts = np.cumsum([1, *[len(best) for best, _, _ in levels]])  # of the levels among all cells
        self.best = np.concatenate([[0], *[best for best, _, _ in levels]])
        self.mask = np.concatenate([[0], *[mask for _, mask, _ in levels]])
        self.first = np.concatenate([[0], *[first + start for (_, _, first), start in zip(levels, starts[1:])]])

    def quarter(self, cells: np.ndarray, which: np.ndarray) -> np.ndarray:
        mask = self.mask[cells]
        return np.where((mask >> which) & 1, self.first[cells] + BITS[mask & ((1 << which) - 1)], 0)

    def best_columns(self, rows: np.ndarray, least: int, top: int, offer) -> None:
        """Calls offer(columns, scores), which returns the least score that still counts, for the columns of the best ranges first."""
        cells, bound = np.ones((1, len(rows)), dtype=np.int64), self.best[1:2] * len(rows)
        level, column = np.zeros(1, dtype=np.int64), np.zeros(1, dtype=np.int64)
        rows = rows << self.shift
        while len(bound):
            some = np.argpartition(-bound, TOGETHER)[:TOGETHER] if len(bound) > TOGETHER else np.arange(len(bound))
            bit = self.height - 1 - level[some]
            low = ((rows[None, :] >> bit[:, None]) & 1) << 1
            halves = np.concatenate([self.quarter(cells[some], low | side) for side in (0, 1)])
            reached = self.best[halves].sum(axis=1)
            into, last = np.concatenate([2 * column[some], 2 * column[some] + 1]), np.r_[bit, bit] == 0
            if (found := np.flatnonzero(last & (reached >= least) & (reached > 0))).size:
                least = offer(into[found], reached[found])
            new = ~last & (reached >= least) & (reached > 0)
            old = bound >= least
            old[some] = False
            cells = np.concatenate([cells[old], halves[new]])
            bound, column = np.r_[bound[old], reached[new]], np.r_[column[old], into[new]]
            level = np.r_[level[old], np.r_[level[some], level[some]][new] + 1]


def _by_key(key) -> tuple:
    return (key is not None, key if key is not None else 0)


class Best:
    """The best listings of each search that a task has seen, by score, then by key (null first)."""

    def __init__(self, searches: Searches, top: int):
        self.top, self.found = top, [[] for _ in searches.keys]

    def least(self, search: int) -> int:
        found = self.found[search]
        return found[-1][0] if len(found) == self.top else 1

    def offer(self, search: int, keys: list, scores: np.ndarray) -> int:
        every = self.found[search] + list(zip(scores.tolist(), keys))
        self.found[search] = sorted(every, key=lambda x: (-x[0], _by_key(x[1])))[:self.top]
        return self.least(search)


def _unlike(shard: list[tuple], top: int) -> list[tuple]:
    """Of listings with equal terms and lengths, which all have equal scores, the first ``top`` by key: no others can be among the best."""
    groups: dict[tuple, list] = {}
    for row in shard:
        groups.setdefault(row[1:], []).append(row)
    return [row for rows in groups.values() for row in (rows if len(rows) <= top else heapq.nsmallest(top, rows, key=lambda r: _by_key(r[0])))]


def search_shard(shard: list[tuple[object, int, bytes, bytes]], searches: Searches, corpus: Corpus, best: Best) -> None:
    """Adds to ``best`` what the searches find in a shard: (key, length, places of terms, their numbers)."""
    shard = _unlike(shard, best.top)
    term = np.frombuffer(b"".join(r[2] for r in shard), dtype="<u4").astype(np.int64)
    tf = np.frombuffer(b"".join(r[3] for r in shard), dtype="<u4").astype(np.int64)
    sizes = np.array([len(r[2]) // 4 for r in shard])
    weight = corpus.weights()
    place = np.empty(len(weight), dtype=np.int64)
    place[np.argsort(-weight, kind="stable")] = np.arange(len(weight))
    row = place[term]
    heaviest = np.minimum.reduceat(row, np.cumsum(sizes) - sizes)
    order = np.argsort(heaviest, kind="stable")  # listings with the same rare terms are neighbours, so cells are few and their bounds tight
    column = np.empty(len(shard), dtype=np.int64)
    column[order] = np.arange(len(shard))
    length = np.repeat(np.array([r[1] for r in shard], dtype=np.int64), sizes)
    treap = Treap(row, np.repeat(column, sizes), corpus.impacts(weight[term], tf, length))
    keys = [shard[i][0] for i in order.tolist()]
    for i, rows in enumerate(searches.rows):
        if len(rows):
            treap.best_columns(place[rows], best.least(i), best.top, lambda columns, scores, i=i: best.offer(i, [keys[c] for c in columns.tolist()], scores))


def ranked_search(listings: DataFrame, searches: DataFrame, key: str = "obs_id", text: str = "description", search_key: str = "search_key",
                  search_text: str = "query", top: int = TOP, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(search_key, rank, key, score): the ``top`` listings of each search with the highest scores above 0, highest first.

    A listing's score is the sum of the impacts of the search's terms, each once: weight by the listings that hold the term, times a
    share of its occurrences by the listing's length, in whole numbers. Equal scores rank by key, null first. Null and empty
    listings have no terms and are not counted; null and empty searches find nothing; fewer listings than ``top`` are returned
    if no more have a score. Rows of one key are listings of their own, so repeated rows are found several times; equal rows of
    ``searches`` are one search, and its key may be null or repeated with another text. Very long texts are read whole. Empty tables
    give an empty result. Other columns are ignored.

    Searches go in blocks of ``block_bytes``, one pass over the listings each; listings never meet in one place, only the best of
    each task do. The terms are counted and stored when the frame is made.
    """
    spark = listings.sparkSession
    asked = searches.select(F.col(search_key).alias("search"), F.col(search_text).alias("text")).distinct()
    size = asked.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    out = None
    for block in range(blocks):
        some = asked.where(F.pmod(F.xxhash64("search", "text"), F.lit(blocks)) == block)
        found = _block(listings, some, key, text, top)
        out = found if out is None else out.unionAll(found)
    return out.withColumnsRenamed({"search": search_key, "id": key})


def _block(listings: DataFrame, asked: DataFrame, key: str, text: str, top: int) -> DataFrame:
    spark = listings.sparkSession
    held = spark.sparkContext.broadcast(Searches.of([tuple(r) for r in asked.collect()]))  # of block_bytes, by a sum taken before
    kind, searched = listings.schema[key].dataType, asked.schema["search"].dataType
    held_type, searched_type = to_arrow_type(kind), to_arrow_type(searched)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Listings with terms of the searches; at the end one row of length 0 with the task's listings, terms and listings by term."""
        vocabulary = held.value.vocabulary
        df, n, total = np.zeros(len(vocabulary), dtype=np.int64), 0, 0
        names = ["id", "length", "terms", "numbers"]
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                rows, places, lengths, found = [], [], [], []
                for i, raw in enumerate(text_bytes(part.column(1))):
                    words = terms(raw)
                    n, total = n + bool(words), total + len(words)
                    if known := Counter(filter(vocabulary.__contains__, words)):
                        place = np.fromiter(map(vocabulary.get, known), dtype="<u4", count=len(known))
                        order = np.argsort(place)
                        df[place] += 1
                        rows.append(i)
                        lengths.append(len(words))
                        places.append(place[order].tobytes())
                        found.append(np.fromiter(known.values(), dtype="<u4", count=len(known))[order].tobytes())
                if rows:
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(rows)), pa.array(lengths, pa.int64()), pa.array(places, pa.binary()),
                                                      pa.array(found, pa.binary())], names=names)
        if n:
            own = np.flatnonzero(df)
            counts = np.concatenate(([[-2, n], [-1, total]], np.c_[own, df[own]])).astype("<i8")
            yield pa.RecordBatch.from_arrays([pa.array([None], held_type), pa.array([0], pa.int64()), pa.array([counts.tobytes()], pa.binary()),
                                              pa.array([b""], pa.binary())], names=names)

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for packed in batch.column(0).to_pylist():
                counts = np.frombuffer(packed, dtype="<i8").reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([pa.array(counts[:, 0]), pa.array(counts[:, 1])], names=["term", "n"])

    rows = listings.select(F.col(key).alias("id"), F.col(text).alias("text"))
    counted = cut(rows.mapInArrow(count, f"id {kind.simpleString()}, length long, terms binary, numbers binary"))
    df = dict(counted.where("length = 0").select("terms").mapInArrow(unpack, "term long, n long").groupBy("term").agg(F.sum("n")).collect())  # as the block's terms at most
    n, total = df.pop(-2, 0), df.pop(-1, 0)
    corpus = Corpus(n, total, np.array([df.get(i, 0) for i in range(len(held.value.vocabulary))], dtype=np.int64))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searches = held.value
        best, shard, entries = Best(searches, top), [], 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                shard.append(row)
                entries += len(row[2]) // 4
                if len(shard) >= SHARD or entries >= ENTRIES:
                    search_shard(shard, searches, corpus, best)
                    shard, entries = [], 0
        if shard:
            search_shard(shard, searches, corpus, best)
        found = [(i, searches.keys[i], k, score) for i, rows in enumerate(best.found) for score, k in rows]
        if found:
            place, name, k, score = zip(*found)
            yield pa.RecordBatch.from_arrays([pa.array(place, pa.int64()), pa.array(name, searched_type), pa.array(k, held_type), pa.array(score, pa.int64())],
                                             names=["place", "search", "id", "score"])

    best = counted.where("length > 0").mapInArrow(search, f"place long, search {searched.simpleString()}, id {kind.simpleString()}, score long")
    order = [F.desc("score"), F.asc_nulls_first("id")]
    part = Window.partitionBy("place", "part").orderBy(*order)
    best = best.withColumn("part", F.spark_partition_id() % PARTS).withColumn("rank", F.row_number().over(part)).where(F.col("rank") <= top)
    return best.withColumn("rank", F.row_number().over(Window.partitionBy("place").orderBy(*order))).where(F.col("rank") <= top).select("search", "rank", "id", "score")
