"""Training sequences of related listings: lexical retrieval packing.

Listings are sorted by their rarest terms that others have, too, and cut into shards of about SHARD rows; token ids are the terms.
So copies and listings that share rare terms are of one shard. A shard holds a BM25 inverted index of its listings, weighted by
document frequencies and lengths of all listings. A seed opens a window; the index returns its unused neighbours, best first, and
they fill the window. What does not fit of the last one opens the next window and is its seed. So windows are full but for a
shard's last, whose tokens are laid into sequences of power-of-two lengths, which need no padding.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import batched

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from pricelens.llm.common import cut
from pricelens.llm.tokens import END, encoded, tokenizer_path

SHARD = 4096
#: BM25's constants; neighbours asked for at a time. Terms of more than one in DENSE of a shard's listings have full rows of weights.
K1, B, NEIGHBOURS, DENSE = 1.2, 0.75, 16, 16
SHARD_BITS = 32


@dataclass
class Corpus:
    """What BM25 has to know of all listings: their number, mean length, and number of listings by term."""

    n: int
    mean: float
    df: np.ndarray

    def ranks(self) -> np.ndarray:
        """Place of each term from the most frequent to the rarest; -1 for terms of a single listing, which relate it to none."""
        ranks = np.empty(len(self.df), dtype=np.int32)
        ranks[np.argsort(-self.df, kind="stable")] = np.arange(len(self.df), dtype=np.int32)
        ranks[self.df < 2] = -1
        return ranks


def distinct(sizes: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, term, count) of each document's different terms, by row and term; ``ids`` are all documents' in turn, ``sizes`` their lengths."""
    found = np.repeat(np.arange(len(sizes), dtype="<u8") << 32, sizes) | ids.astype("<u8")
    found.sort()
    first = np.flatnonzero(np.r_[found[:1] >= 0, found[1:] != found[:-1]])
    return (found[first] >> 32).astype(np.int64), (found[first] & 0xFFFFFFFF).astype(np.int64), np.diff(np.r_[first, len(found)])


def rarest(documents: list[np.ndarray], ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Highest and second highest rank of each document's terms; documents are not empty."""
    sizes = np.array([len(d) for d in documents])
    starts = np.cumsum(sizes) - sizes
    rank = ranks[np.concatenate(documents)]
    first = np.maximum.reduceat(rank, starts)
    rank[rank == np.repeat(first, sizes)] = -1
    return first, np.maximum.reduceat(rank, starts)


class Index:
    """BM25 inverted index of the listings of a shard, which are all listings where nothing is known of a corpus."""

    def __init__(self, documents: list[np.ndarray], corpus: Corpus | None = None):
        row, term, counts = distinct(np.array([len(d) for d in documents]), np.concatenate(documents))
        tf = counts.astype(np.float32)
        self.start = np.r_[0, np.cumsum(np.bincount(row, minlength=len(documents)))]
        here = np.bincount(term)
        length = np.array([len(d) for d in documents], dtype=np.float32)
        corpus = corpus or Corpus(len(documents), float(length.mean()), here)
        norm = (K1 * (1 - B + B * length / max(1.0, corpus.mean))).astype(np.float32)
        idf = np.log1p((corpus.n - corpus.df + 0.5) / (corpus.df + 0.5)).astype(np.float32)
        weight = idf[term] * tf * np.float32(K1 + 1) / (tf + norm[row])
        self.term = term  # by listing
        order = np.argsort(term, kind="stable")
        self.rows, self.weights = row[order], weight[order]  # by term
        self.postings = np.r_[0, np.cumsum(here)]
        often = np.flatnonzero(here > len(documents) / DENSE)
        self.dense = np.zeros((len(often), len(documents)), dtype=np.float32)
        self.place = np.full(len(here), -1)
        self.place[often] = np.arange(len(often))
        at = self.place[term]
        self.dense[at[at >= 0], row[at >= 0]] = weight[at >= 0]
        self.unused = np.ones(len(documents), dtype=bool)

    def scores(self, seed: int) -> np.ndarray:
        """Of all listings, by all terms of the seed."""
        terms = self.term[self.start[seed]:self.start[seed + 1]]
        at = self.place[terms]
        score = self.dense[at[at >= 0]].sum(axis=0)
        starts = self.postings[terms[at < 0]]
        sizes = self.postings[terms[at < 0] + 1] - starts
        starts, sizes = starts[sizes > 1], sizes[sizes > 1]  # others have it, too
        every = np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
        np.add.at(score, self.rows[every], self.weights[every])  # term by term, in their order
        return score

    def neighbours(self, score: np.ndarray) -> list[int]:
        """Unused listings by score, then by place; those that share nothing with the seed are none."""
        some = np.flatnonzero((score > 0) & self.unused)
        if len(some) > NEIGHBOURS:
            least = np.partition(score[some], -NEIGHBOURS)[-NEIGHBOURS]
            some = some[score[some] >= least]
        return some[np.argsort(-score[some], kind="stable")][:NEIGHBOURS].tolist()


def order(documents: list[np.ndarray], window: int, corpus: Corpus | None = None) -> Iterator[int]:
    """Rows of a shard in the order in which they are laid down."""
    index = Index(documents, corpus)
    room, first, queue, score = window, 0, [], None
    for _ in documents:
        queue = queue or ([] if score is None else index.neighbours(score))  # the seed is asked again while it has neighbours
        if queue:
            row = queue.pop(0)
        else:  # nothing related is left: the first unused listing is the next seed
            first += int(index.unused[first:].argmax())
            row, score = first, index.scores(first)
        index.unused[row] = False
        yield row
        room -= len(documents[row])
        if room <= 0:  # what is left of this one opens the next window
            room, queue, score = window - (-room) % window, [], index.scores(row)


def pieces(sizes: list[int], window: int) -> Iterator[tuple[int, int, int, int, int]]:
    """(row, start, length, sequence, offset) of rows laid one after another into windows, the rest into powers of two."""
    total = sum(sizes)
    bounds = list(range(0, total - total % window + 1, window))
    rest = total % window
    while rest:
        size = 1 << (rest.bit_length() - 1)
        bounds.append(bounds[-1] + size)
        rest -= size
    sequence, at = 0, 0
    for row, size in enumerate(sizes):
        start = 0
        while start < size:
            while at >= bounds[sequence + 1]:
                sequence += 1
            length = min(size - start, bounds[sequence + 1] - at)
            yield row, start, length, sequence, at - bounds[sequence]
            start += length
            at += length


def pack(listings: DataFrame, key: str = "obs_id", text: str = "description", window: int = 4096, path: str | None = None,
         shard_rows: int = SHARD) -> DataFrame:
    """(key, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids): one row per piece of a listing.

    A listing is its text's ids and END; a null or empty text is END alone. Every id is in exactly one piece; a sequence is
    laid out gapless from offset 0 and is ``window`` ids long or, at the end of a shard, a smaller power of two. ``ids`` holds the
    piece as little-endian unsigned 32-bit numbers. Repeated rows, rows with a null key and very long texts are listings like
    others; rows of one key may go to different shards. An empty table gives an empty result. Other columns are ignored.
    """
    path = path or tokenizer_path()
    kind = listings.schema[key].dataType.simpleString()

    def tokenize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Ids of the listings; at the end one row of width 0 with the task's listings, tokens and listings by term."""
        df, n, total = np.zeros(0, dtype=np.int64), 0, 0
        for part, ids in (x for batch in batches for x in encoded(batch, 1, path)):
            end = np.array([END], dtype="<u4")
            every, sizes = np.concatenate([x for i in ids for x in (i, end)]), np.array([len(i) + 1 for i in ids])
            small = "<u2" if every.max() < 1 << 16 else "<u4"
            found = np.bincount(distinct(sizes, every)[1], minlength=len(df))
            found[:len(df)] += df
            df, n, total = found, n + len(ids), total + len(every)
            data, ends = every.astype(small).tobytes(), (int(small[-1]) * np.cumsum(sizes)).tolist()
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([data[a:b] for a, b in zip([0, *ends], ends)], pa.binary()),
                                              pa.array([int(small[-1])] * len(ids), pa.int8())], names=["id", "ids", "width"])
        if n:
            terms = np.flatnonzero(df)
            counts = np.concatenate(([[-2, n], [-1, total]], np.c_[terms, df[terms]])).astype("<i8")
            yield pa.RecordBatch.from_arrays([pa.array([None], held_type), pa.array([counts.tobytes()], pa.binary()), pa.array([0], pa.int8())],
                                             names=["id", "ids", "width"])

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for packed in batch.column(0).to_pylist():
                counts = np.frombuffer(packed, dtype="<i8").reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([pa.array(counts[:, 0]), pa.array(counts[:, 1])], names=["term", "n"])

    held_type = to_arrow_type(listings.schema[key].dataType)
    tokens = cut(listings.select(F.col(key).alias("id"), F.col(text).alias("text")).mapInArrow(tokenize, f"id {kind}, ids binary, width tinyint"))
    counted = dict(tokens.where("width = 0").select("ids").mapInArrow(unpack, "term long, n long").groupBy("term").agg(F.sum("n")).collect())  # as the vocabulary at most
    n, total = counted.pop(-2, 0), counted.pop(-1, 0)
    df = np.zeros(max(counted, default=0) + 1, dtype=np.int64)
    df[list(counted)] = list(counted.values())
    corpus = Corpus(n, total / max(1, n), df)
    ranks, shards = corpus.ranks(), max(1, -(-n // shard_rows))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                documents = [np.frombuffer(b, dtype=f"<u{w}") for b, w in zip(batch.column("ids").to_pylist(), batch.column("width").to_pylist())]
                yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, rarest(documents, ranks))], names=[*batch.schema.names, "first", "second"])

    def lay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]  # a shard's listings, bounded by its size
        if not held:
            return
        table = pa.Table.from_batches(held)
        for shard in sorted(set(table["shard"].to_pylist())):
            part = table.filter(pa.compute.equal(table["shard"], shard))
            rows = sorted(zip(part["id"].to_pylist(), part["ids"].to_pylist(), part["width"].to_pylist()), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
            documents = [np.frombuffer(b, dtype=f"<u{w}") for _, b, w in rows]
            laid = list(order(documents, window, corpus))
            types = [part.schema.field("id").type, *[pa.int64()] * 6, pa.binary()]

            def cut(found: Iterator[tuple], documents=documents, laid=laid, rows=rows, shard=shard) -> Iterator[tuple]:
                for r, start, length, sequence, offset in found:
                    ids = documents[laid[r]]
                    piece = ids[start:start + length].astype("<u4").tobytes()
                    yield rows[laid[r]][0], start, length, zlib.crc32(piece), len(ids), (shard << SHARD_BITS) + sequence, offset, piece

            for some in batched(cut(pieces([len(documents[i]) for i in laid], window)), 500):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*some), types)], names=NAMES)

    placed = tokens.where("width > 0").mapInArrow(place, f"id {kind}, ids binary, width tinyint, first int, second int")
    # copies stand side by side, and however many there are, a shard's bounds may part them
    dealt = placed.repartitionByRange(shards, "first", "second", F.xxhash64("ids"), F.xxhash64("id", F.monotonically_increasing_id()))
    return dealt.select("id", F.spark_partition_id().alias("shard"), "ids", "width").mapInArrow(
        lay, f"id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary").withColumnRenamed("id", key)


NAMES = ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"]
