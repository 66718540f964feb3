"""Benchmark items inside listing texts, by winnowing; DataFrame functions only.

Of every nine consecutive 5-grams of words the one with the least hash is kept, the first of equals. Two texts that share
thirteen consecutive words share such a window and so keep the same 5-gram of it: kept 5-grams of listings are joined with
the different ones of the items by hash. Each place that met is extended to the windows around it that hold its 5-gram, and these are
joined with the different windows of the items, word by word. Places are never paired with places: a text that repeats a word or a
line costs its length, however often an item repeats it. Items of fewer than thirteen words, below that guarantee, are met by the
hash of all their words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricelens.functions.literals import let
from pricelens.llm.common import ascii_lower

WINDOW, GRAM = 13, 5
#: A kept 5-gram is one long: the upper bits of its hash, then its position.
POSITION_BITS = 30
#: A window of a listing is one long: its first position, then its number of words.
SIZE_BITS = 4
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Lowered words: runs of digits, letters and everything beyond ASCII. Null has none."""
    return F.coalesce(F.array_remove(F.split(ascii_lower(text), SEPARATORS), ""), F.array().cast("array<string>"))


def _pairs(a: str | Column, b: str | Column, offset: int, length: Column, combine) -> Column:
    """Element i of a with element i + offset of b, for the first ``length`` of them; linear in the arrays."""
    return F.zip_with(F.slice(a, F.lit(1), length), F.slice(b, F.lit(offset + 1), length), combine)


def _mix(x: Column, y: Column) -> Column:
    return F.xxhash64(x, y)


def _least(x: Column, y: Column) -> Column:
    return F.least(x, y)


def version(text: Column) -> Column:
    """Tells texts of one key apart."""
    return F.xxhash64(text)


def _steps(df: DataFrame, rest: list[str], steps: list[tuple[str, Column, list[str]]]) -> DataFrame:
    """One column after another; each step names what later ones still need."""
    for name, value, keep in steps:
        df = df.select(*rest, *keep, value.alias(name))
    return df


def winnow(df: DataFrame) -> DataFrame:
    """``df`` with column words replaced by kept: the kept 5-grams of each row, none below thirteen words."""
    n = F.col("n")
    rest = [c for c in df.columns if c != "words"]
    return _steps(df.where(F.size("words") >= WINDOW).withColumn("n", F.size("words")), rest, [
        ("h", F.transform("words", lambda w: F.xxhash64(w)), ["n"]),
        ("g2", _pairs("h", "h", 1, n - 1, _mix), ["n", "h"]),
        ("g4", _pairs("g2", "g2", 2, n - 3, _mix), ["n", "h"]),
        ("g5", _pairs("g4", "h", 4, n - 4, _mix), ["n"]),
        ("m1", F.transform("g5", lambda x, i: F.shiftleft(F.shiftright(x, POSITION_BITS), POSITION_BITS).bitwiseOR(i.cast("long"))), ["n"]),
        ("m2", _pairs("m1", "m1", 1, n - 5, _least), ["n", "m1"]),
        ("m4", _pairs("m2", "m2", 2, n - 7, _least), ["n", "m1"]),
        ("m8", _pairs("m4", "m4", 4, n - 11, _least), ["n", "m1"]),
        ("kept", F.array_distinct(_pairs("m8", "m1", 8, n - 12, _least)), [])])


def _grams(df: DataFrame, length: int) -> DataFrame:
    """(..., hash, at): every run of ``length`` words (below thirteen), its hash put together from runs of 8, 4, 2 and 1."""
    rest = [c for c in df.columns if c != "words"]
    n = F.col("n")
    steps = [("g1", F.transform("words", lambda w: F.xxhash64(w)), ["n"])]
    have = ["g1"]
    for size in (2, 4, 8):
        if size <= length:
            steps.append((f"g{size}", _pairs(f"g{size // 2}", f"g{size // 2}", size // 2, n - (size - 1), _mix), ["n", *have]))
            have.append(f"g{size}")
    parts = [size for size in (8, 4, 2, 1) if length & size]
    whole, done = F.col(f"g{parts[0]}"), parts[0]
    for size in parts[1:]:
        done += size
        whole = _pairs(whole, f"g{size}", done - size, n - (done - 1), _mix)
    steps.append(("hashes", whole, []))
    return _steps(df.where(F.size("words") >= length).withColumn("n", F.size("words")), rest, steps).select(
        *rest, F.posexplode_outer("hashes").alias("at", "hash")).where("hash IS NOT NULL")


def _place(at: Column, size: Column | int) -> Column:
    return F.shiftleft(at.cast("long"), SIZE_BITS).bitwiseOR(F.lit(size).cast("long"))


def _at(place: Column) -> Column:
    return F.shiftright(place, SIZE_BITS).cast("int")


def _size(place: Column) -> Column:
    return place.bitwiseAND((1 << SIZE_BITS) - 1).cast("int")


def _window(of: Column, at: Column, size: Column) -> Column:
    """``size`` words from a position; words hold no spaces, so equal texts are equal words."""
    return F.array_join(F.slice(of, at + 1, size), " ")


def _met(texts: DataFrame, known: DataFrame) -> DataFrame:
    """(id, v, place): kept 5-grams of the listings that an item keeps too, with size thirteen, and runs of words that may be a short item."""
    kept = F.explode_outer("kept").alias("k")  # a plain explode would have its array tested, hence computed, once more below
    hashed = F.shiftright("k", POSITION_BITS).alias("hash")
    at = F.col("k").bitwiseAND((1 << POSITION_BITS) - 1)
    theirs = winnow(known.select(F.col("item_words").alias("words"))).select(kept).where("k IS NOT NULL").select(hashed).distinct()
    ours = winnow(texts).select("id", "v", kept).where("k IS NOT NULL").select("id", "v", hashed, _place(at, WINDOW).alias("place"))
    met = ours.join(theirs, "hash", "left_semi").select("id", "v", "place")
    short = known.where(F.size("item_words") < WINDOW)
    for (length,) in short.select(F.size("item_words")).distinct().collect():  # twelve values at most
        same = _grams(short.where(F.size("item_words") == length).select(F.col("item_words").alias("words")), length).select("hash").distinct()
        met = met.unionAll(_grams(texts, length).join(same, "hash", "left_semi").select("id", "v", _place(F.col("at"), length).alias("place")))
    return met


def occurrences(listings: DataFrame, items: DataFrame, key: str, text: str, item_key: str, item_text: str) -> DataFrame:
    """(id, v, item, place): every occurrence of a window of an item, by the places that met."""
    texts = listings.select(F.col(key).alias("id"), version(F.col(text)).alias("v"), words(F.col(text)).alias("words"))
    known = (items.select(F.col(item_key).alias("item"), words(F.col(item_text)).alias("item_words"))
             .where(F.size("item_words") > 0).distinct())
    met = _met(texts, known).groupBy("id", "v").agg(F.collect_set("place").alias("met"))
    whole = listings.select(F.col(key).alias("own"), version(F.col(text)).alias("own_v"), F.col(text).alias("text"))  # words would double the shuffle
    joined = met.join(whole, F.col("id").eqNullSafe(F.col("own")) & (F.col("v") == F.col("own_v"))).select("id", "v", "met", "text")

    def around(place: Column) -> Column:
        """Places of the windows that hold the 5-gram kept at ``place``; a short item's run is its own window."""
        at = _at(place)
        starts = F.sequence(F.greatest(F.lit(0), at - (WINDOW - GRAM)), at)
        return F.when(_size(place) == WINDOW, F.transform(starts, lambda i: _place(i, WINDOW))).otherwise(F.array(place))

    places = F.array_distinct(F.flatten(F.transform("met", around)))
    windows = let(words(F.col("text")), lambda of: F.transform(
        F.filter(F.col("places"), lambda p: _at(p) + _size(p) <= F.size(of)), lambda p: F.struct(p.alias("place"), _window(of, _at(p), _size(p)).alias("window"))))
    mine = _steps(joined, ["id", "v"], [("places", places, ["text"]), ("windows", windows, [])]).select("id", "v", F.explode_outer("windows").alias("w"))
    size = F.least(F.size("item_words"), F.lit(WINDOW))
    every = F.array_distinct(F.transform(F.sequence(F.lit(0), F.size("item_words") - size), lambda i: _window(F.col("item_words"), i, size)))
    theirs = known.select("item", F.explode_outer(every).alias("window"))
    return mine.where("w IS NOT NULL").select("id", "v", "w.place", "w.window").join(theirs, "window").select("id", "v", "item", "place")


def covered(places: Column) -> Column:
    """Number of word positions that the windows at these places cover together."""
    def add(done: Column, place: Column) -> Column:
        end = _at(place) + _size(place)
        return F.struct(F.greatest(done["upto"], end).alias("upto"),
                        (done["n"] + F.greatest(F.lit(0), end - F.greatest(_at(place), done["upto"]))).alias("n"))

    return F.aggregate(F.array_sort(places), F.struct(F.lit(0).alias("upto"), F.lit(0).cast("long").alias("n")), add, lambda done: done["n"])


def contamination(listings: DataFrame, items: DataFrame, key: str = "obs_id", text: str = "description", item_key: str = "item_id",
                  item_text: str = "text") -> DataFrame:
    """(key, v, n_words, n_hit, item_ids, contaminated): one row per listing; v tells texts of one key apart.

    A window is thirteen consecutive words of an item, or the whole item if it is shorter; a word of a listing inside any
    occurrence of a window is hit. ``item_ids`` are the items with an occurring window, sorted as strings. A listing is
    contaminated if a twentieth of its words or more is hit. Null and empty texts have no words and are never hit; empty items
    never occur; an item without a key hits but is not named. Repeated rows give repeated results. Other columns are ignored.
    """
    found = (occurrences(listings, items, key, text, item_key, item_text)
             .groupBy("id", "v").agg(F.collect_set("place").alias("places"), F.collect_set(F.col("item").cast("string")).alias("items"))
             .select(F.col("id").alias("hit_id"), F.col("v").alias("hit_v"), covered(F.col("places")).alias("n_hit"), "items"))
    mine = listings.select(F.col(key).alias("id"), version(F.col(text)).alias("v"), F.size(words(F.col(text))).cast("long").alias("n_words"))
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return mine.join(found, F.col("id").eqNullSafe(F.col("hit_id")) & (F.col("v") == F.col("hit_v")), "left").select(
        F.col("id").alias(key), "v", "n_words", n_hit.alias("n_hit"),
        F.array_sort(F.coalesce("items", F.array().cast("array<string>"))).alias("item_ids"),
        ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"))


def clean(listings: DataFrame, items: DataFrame, key: str = "obs_id", text: str = "description", item_key: str = "item_id",
          item_text: str = "text") -> DataFrame:
    """``listings`` without the contaminated ones; rows and columns are as they were."""
    found = contamination(listings, items, key, text, item_key, item_text).where("contaminated").select(F.col(key).alias("hit_id"), F.col("v").alias("hit_v")).distinct()
    rows = listings.select(F.struct("*").alias("row"), F.col(key).alias("id"), version(F.col(text)).alias("w"))
    return rows.join(found, F.col("id").eqNullSafe(F.col("hit_id")) & (F.col("w") == F.col("hit_v")), "left_anti").select(
        *[F.col(f"row.`{c}`").alias(c) for c in listings.columns])
