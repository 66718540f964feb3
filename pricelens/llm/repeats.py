"""Removal of passages that repeat, in one listing or across listings, found through difference-cover anchors.

COVER is a difference set modulo PERIOD: for any two places there is a shift below PERIOD that moves both onto the cover. So two
equal windows hold an anchor, a run of ``window - PERIOD + 1`` words that starts on the cover in both. Only anchors are hashed and
shuffled, a quarter of all places. Windows around anchors that occur twice are hashed whole and shuffled in turn; those
that occur twice are repeats. Their words are removed.

A run that occurs several times in one batch of a task is known to repeat there and then: the batch keeps its places, and
sends one row that tells others. So a passage that a third of the listings share is one row per batch, not one per listing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pricelens.llm.common import runs, text_bytes

PERIOD, COVER = 21, (3, 6, 7, 12, 14)
#: Listings of a batch.
BATCH = 1024
ODD = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
#: In the shuffles a text is the hash of its key and itself; a run is its hash (80 bits: below one chance meeting among a trillion
#: windows; 48 bits for anchors, which only propose windows) and, in the lowest half of tail, its place.
SENT, PLACES = "key long, tail long, text long, marks binary", "text long, at int, marks binary"
NOWHERE = 0xFFFFFFFF


def _word_hashes(words: list[bytes]) -> np.ndarray:
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(w) for w in words), dtype=np.uint64, count=len(words))


def run_hashes(h: np.ndarray, length: int, odd: int) -> np.ndarray:
    """Hash of each run of ``length`` words, put together from runs of powers of two. As long as ``h``; the last are of no use."""
    power = lambda n: np.uint64(pow(odd, n, 1 << 64))
    ahead = lambda x, n: np.concatenate((x[n:], np.zeros(min(n, len(x)), dtype=np.uint64)))
    total, done, g, size = None, 0, h, 1
    while True:
        if length & size:
            total, done = (g, size) if total is None else (total * power(size) + ahead(g, done), done + size)
        if done == length:
            break
        g, size = g * power(size) + ahead(g, size), size * 2
    total = (total ^ (total >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return total ^ (total >> np.uint64(29))


def _flat(words: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes of several texts in a row, the text and the place of each word, and the number of words of its text."""
    sizes = np.array([len(w) for w in words], dtype=np.int64)
    text = np.repeat(np.arange(len(words)), sizes)
    place = np.arange(len(text)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    return np.concatenate([_word_hashes(w) for w in words]) if words else np.zeros(0, np.uint64), text, place, sizes[text]


def _sent(names: np.ndarray, key: np.ndarray, more: np.ndarray, text: np.ndarray, place: np.ndarray, first: int) -> pa.RecordBatch:
    """Rows for the shuffle: places of runs met once; one row without a place for a run met several times; and, under a key that
    spreads them, one row of places per text for those."""
    more = more & np.uint64(0xFFFF)
    order = np.lexsort((more, key))
    k, m = key[order], more[order]
    same, again = np.zeros(len(k), dtype=bool), np.zeros(len(k), dtype=bool)
    same[1:] = (k[1:] == k[:-1]) & (m[1:] == m[:-1])
    again[:-1] = same[1:]
    again |= same
    once, heads, known = np.sort(order[~again]), order[again & ~same], np.sort(order[again])  # in order of the text, which packs well
    starts = np.flatnonzero(np.diff(text[known], prepend=-1))
    marks = [p.astype("<i4").tobytes() for p in np.split(place[known], starts[1:])] if len(known) else []
    spread = (np.arange(first, first + len(starts), dtype=np.uint64) * np.uint64(ODD[0])) ^ names[text[known[starts]]].view(np.uint64)
    tail = (more << np.uint64(32)) | place.astype(np.uint64)
    return pa.RecordBatch.from_arrays([
        pa.array(np.concatenate((key[once], spread, key[heads])).view(np.int64)),
        pa.array(np.concatenate((tail[once], np.zeros(len(starts), np.uint64), tail[heads] | np.uint64(NOWHERE))).view(np.int64)),
        pa.array(np.concatenate((names[text[once]], names[text[known[starts]]], np.zeros(len(heads), np.int64)))),
        pa.array([None] * len(once) + marks + [None] * len(heads), pa.binary())], names=["key", "tail", "text", "marks"])


def _met_again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Places of runs that occur more than once; rows of places known to be such pass."""
    for part in runs(batches, "key"):
        key, tail = part.column("key").to_numpy(), part.column("tail").to_numpy().view(np.uint64)
        more, at = tail >> np.uint64(32), tail & np.uint64(NOWHERE)
        known = part["marks"].is_valid().to_numpy()
        order = np.flatnonzero(~known)
        order = order[np.lexsort((more[order], key[order]))]
        k, m, placed = key[order], more[order], at[order] != NOWHERE
        start = np.ones(len(k), dtype=bool)
        start[1:] = (k[1:] != k[:-1]) | (m[1:] != m[:-1])
        group = np.cumsum(start) - 1
        twice = (np.bincount(group) > 1) | (np.bincount(group, weights=~placed) > 0)
        rows = np.concatenate((order[twice[group] & placed], np.flatnonzero(known)))
        found = part.take(rows)
        yield from pa.table({"text": found["text"], "at": pa.array(at[rows].astype(np.int32)), "marks": found["marks"]}).combine_chunks().to_batches()


def _places(at: list[int], marks: list[bytes]) -> np.ndarray:
    return np.concatenate([np.array(at or [], dtype=np.int64), *[np.frombuffer(b, dtype="<i4") for b in marks or []]]).astype(np.int64)


def _covered(places: np.ndarray, before: int, after: int, n: int) -> np.ndarray:
    """For each of n words whether a place lies in reach: from ``before`` words ahead of a place to ``after`` behind it."""
    delta = np.zeros(n + 1, dtype=np.int64)
    np.add.at(delta, np.clip(places - before, 0, n), 1)
    np.add.at(delta, np.clip(places + after, 0, n), -1)
    return np.cumsum(delta[:n]) > 0


def remove_repeats(listings: DataFrame, key: str = "obs_id", text: str = "description", window: int = 35) -> DataFrame:
    """(key, n_words, n_removed, text): one row per listing, its words kept, joined by one blank.

    A word is removed if a window of ``window`` words that covers it also starts anywhere else, in the same listing or another;
    all windows are judged on the input. Words are runs of other characters than \\x20 and \\x09-\\x0D, unchanged. Null and empty texts
    have no words and stay empty; texts of fewer words than a window stay whole. Rows that repeat a key and a text are texts of
    their own, each a repeat of the other; a null key is a key like others. An empty table gives an empty result. Other columns
    are ignored. ``window`` must be larger than PERIOD.
    """
    if window <= PERIOD:
        raise ValueError(f"window must be larger than {PERIOD}")
    kind = listings.schema[key].dataType.simpleString()
    anchor = window - PERIOD + 1
    cover = np.isin(np.arange(PERIOD), COVER)
    rows = listings.select(F.col(key).alias("id"), F.col(text).alias("body"), F.xxhash64(key, text).alias("text"))

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
        first = 0
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH):
                yield first, batch.slice(at, BATCH)
                first += BATCH

    def split(part: pa.RecordBatch) -> list[list[bytes]]:
        return [b.split() for b in text_bytes(part.column("body"))]

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for first, part in parts(batches):
            h, of, place, size = _flat([w if len(w) >= window else [] for w in split(part)])
            some = np.flatnonzero(cover[place % PERIOD] & (place + anchor <= size))
            hashes = run_hashes(h, anchor, ODD[0])[some] >> np.uint64(16)
            yield _sent(part.column("text").to_numpy(), hashes, np.zeros_like(hashes), of[some], place[some], first)

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for first, part in parts(batches):
            words = split(part)
            h, of, place, size = _flat(words)
            near = np.concatenate([_covered(_places(at, marks), window - anchor, 1, len(w)) for w, at, marks in
                                   zip(words, part.column("at").to_pylist(), part.column("marks").to_pylist())])
            some = np.flatnonzero(near & (place + window <= size))
            yield _sent(part.column("text").to_numpy(), *[run_hashes(h, window, odd)[some] for odd in ODD], of[some], place[some], first)

    def removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, part in parts(batches):
            found = []
            for words, at, marks in zip(split(part), part.column("at").to_pylist(), part.column("marks").to_pylist()):
                n, gone = len(words), 0
                if at or marks:
                    repeat = _covered(_places(at, marks), 0, window, n)
                    gone = int(repeat.sum())
                    words = [words[i] for i in np.flatnonzero(~repeat)]
                found.append((n, gone, b" ".join(words)))
            n, gone, kept = zip(*found)
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())],
                                             names=["id", "n_words", "n_removed", "body"])

    def again(sent: DataFrame) -> DataFrame:
        """Per text: places of runs that occur more than once, each place once, however many rows repeat the text under its key."""
        met = sent.repartition("key").sortWithinPartitions("key").mapInArrow(_met_again, PLACES)
        return met.groupBy("text").agg(F.collect_set(F.when(F.col("marks").isNull(), F.col("at"))).alias("at"), F.collect_set("marks").alias("marks"))

    near = rows.join(again(rows.mapInArrow(anchors, SENT)), "text")
    repeats = again(near.mapInArrow(windows, SENT))
    return rows.join(repeats, "text", "left").mapInArrow(removed, f"id {kind}, n_words long, n_removed long, body string").withColumnsRenamed(
        {"id": key, "body": text})
