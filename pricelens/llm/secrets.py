"""Secrets in listing texts: three patterns, and character Markov models for what they miss; DataFrame functions only.

Two first-order models over printable ASCII, one of random strings and one of ordinary identifiers, are trained from
labelled samples. A run of token characters is a secret if the log-likelihood ratio of the two over its transitions reaches a
threshold. Each text is one row throughout; nothing is exploded but the samples' transitions, which are counted.
"""

from __future__ import annotations

import math
from collections import Counter
from itertools import pairwise

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: kind -> pattern, least length, group that the length is asked of. Matches are leftmost and do not overlap within a kind.
BASE = {
    "assign": (r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 2),
    "access": (r"AKIA[A-Z0-9]+", 20, 0),
    # of all runs of hex digits only those of full length are ever needed: runs are maximal
    "hex": (r"[0-9a-f]{24,}", 24, 0),
}
KINDS = [*BASE, "markov"]
TOKEN = r"[A-Za-z0-9+/_=-]{16,}"
FIRST, SYMBOLS, TOKEN_SYMBOLS = 33, 94, 67  # printable ASCII; those of TOKEN
#: Least log-likelihood ratio (natural logarithm) of a secret.
LEAST_RATIO = 12.0
MASK = "[secret]"
#: Ordinary identifiers by their form: parts of letters in one or in mixed case, up to four digits behind each or as a later part,
#: one separator between two; or separators alone. Possessive throughout, so that long tokens take no stack.
PART = r"(?:(?:[A-Z]{0,5}+[a-z]{2,}+)++|[A-Z]{2,}+)[0-9]{0,4}+"
ORDINARY = rf"^(?:{PART}(?:[-_/=+](?:{PART}|[0-9]{{1,4}}+))*+|[-_/=+]++)$"
#: Ordinary identifiers that every model knows, for a corpus may hold none of their forms.
KNOWN = ("home/user/documents/report", "usr/local/share/fonts", "www/images/2023/photo", "easy-to-read-manual", "made-in-germany", "Nord-Sud-Verbindung",
         "new_item_count", "first_name_last_name", "order_id_2019", "MIN_PAGE_WIDTH", "ERROR_NOT_FOUND", "DEFAULT_TIMEOUT_MS", "parseRequestHeader",
         "HttpClientFactory", "windowSizeLimit", "2021-11-08", "1999-12-31_10-45-00", "version-3-2-17", "IMG_20180604_153012", "name=value",
         "left+right", "----------------", "================", "________________")
#: Shares of the identifiers' model: pairs of the samples, their single characters, pairs of KNOWN; the rest is uniform. The random
#: strings' pairs and single characters have the first two. They weigh shares of counts, so the number of samples changes no verdict.
PAIRS, SINGLES, KNOWN_PAIRS = 0.75, 0.13, 0.05


def _spans(text: Column, matches: Column, pattern: str, kept: Column) -> Column:
    """array<struct<start, kind, end>>, kind left out: code point offsets of the matches for which ``kept`` is true."""
    gaps = F.transform(F.split(text, pattern, -1), lambda p: F.length(p))
    steps = F.arrays_zip(F.slice(gaps, F.lit(1), F.size(matches)).alias("gap"), F.transform(matches, lambda m: F.length(m)).alias("size"), kept.alias("kept"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + x["gap"]
        span = F.struct(begin.alias("start"), (begin + x["size"]).alias("end"))
        return F.struct((begin + x["size"]).alias("at"), F.when(x["kept"], F.array_append(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    return F.when(F.size(matches) > 0, F.aggregate(steps, start, step, lambda acc: acc["spans"])).otherwise(
        F.array().cast("array<struct<start:int,end:int>>"))


def _long(matches: Column, least: int) -> Column:
    return F.transform(matches, lambda m: F.length(m) >= least)


def scan(listings: DataFrame, text: str) -> DataFrame:
    """``listings`` with assign, access, hex (spans of the base patterns) and tokens (runs of token characters that no base
    span touches: start, end, token). Null texts count as empty."""
    keep = listings.columns
    body = F.coalesce(F.col(text), F.lit(""))
    all_of = lambda pattern, group=0: F.regexp_extract_all(body, F.lit(pattern), F.lit(group))
    df = listings.select("*", *[all_of(p, 0).alias(f"_{k}") for k, (p, _, _) in BASE.items()], all_of(BASE["assign"][0], 2).alias("_values"),
                         all_of(TOKEN).alias("_tokens"))
    spans = {}
    for kind, (pattern, least, group) in BASE.items():
        measured = F.col("_values" if group else f"_{kind}")
        spans[kind] = _spans(body, F.col(f"_{kind}"), pattern, _long(measured, least))
    every = _spans(body, F.col("_tokens"), TOKEN, F.transform("_tokens", lambda m: F.lit(True)))
    df = df.select(*keep, "_tokens", *[s.alias(k) for k, s in spans.items()], every.alias("_at"))
    touched = lambda s: F.exists(F.concat(*map(F.col, BASE)), lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
    pairs = F.zip_with("_at", "_tokens", lambda s, t: F.struct(s["start"].alias("start"), s["end"].alias("end"), t.alias("token")))
    return df.select(*keep, *BASE, F.filter(pairs, lambda s: ~touched(s)).alias("tokens"))


def samples(scanned: DataFrame, text: str) -> DataFrame:
    """(sample, secret): labelled strings of a scanned frame. Base spans are secrets, tokens of the form ORDINARY are not."""
    found = F.transform(F.concat("access", "hex"), lambda s: F.struct(F.substring(F.col(text), s["start"] + 1, s["end"] - s["start"]).alias("sample"), F.lit(True).alias("secret")))
    plain = F.transform(F.filter("tokens", lambda t: t["token"].rlike(ORDINARY)), lambda t: F.struct(t["token"].alias("sample"), F.lit(False).alias("secret")))
    return scanned.select(F.explode(F.concat(found, plain)).alias("s")).select("s.*")


def _shares(table: dict[int, int]) -> tuple[list[float | None], list[float]]:
    """Shares of pairs among those of the same first character (None where there are none), of second characters among all."""
    first, second = [0] * SYMBOLS, [0] * SYMBOLS
    for pair, n in table.items():
        first[pair // SYMBOLS] += n
        second[pair % SYMBOLS] += n
    every = sum(second)
    pairs = [table.get(p, 0) / first[p // SYMBOLS] if first[p // SYMBOLS] else None for p in range(SYMBOLS * SYMBOLS)]
    return pairs, [n / every if every else 1 / TOKEN_SYMBOLS for n in second]


def train(labelled: DataFrame) -> list[float]:
    """Log-likelihood ratio of every transition, random string against ordinary identifier, from (sample, secret).

    Transitions are counted over all samples. A model is a mix of fixed shares: of the transitions, of the frequency of the second
    character and of a uniform model, for identifiers also of KNOWN; so the ratios depend on the samples' proportions, not on their
    number. A first character without transitions counts as any; no samples of a kind leave it uniform. The random strings' model is
    mixed half and half with a uniform one, for their alphabets differ from kind to kind."""
    code = lambda i: F.ascii(F.substring(F.col("sample"), i, F.lit(1))) - FIRST
    steps = F.transform(F.sequence(F.lit(1), F.length("sample") - 1), lambda i: code(i) * SYMBOLS + code(i + 1))
    counts = (labelled.where(F.length("sample") > 1).select("secret", F.explode(steps).alias("step"))
              .groupBy("secret", "step").count().collect())  # two rows for each pair of symbols at most
    known = Counter((ord(a) - FIRST) * SYMBOLS + ord(b) - FIRST for k in KNOWN for a, b in pairwise(k))
    (random, random_single), (plain, plain_single), (given, given_single) = map(
        _shares, ({r["step"]: r["count"] for r in counts if r["secret"]}, {r["step"]: r["count"] for r in counts if not r["secret"]}, known))
    uniform, ratios = 1 / TOKEN_SYMBOLS, []
    for pair in range(SYMBOLS * SYMBOLS):
        b = pair % SYMBOLS
        of = lambda pairs, single: single[b] if pairs[pair] is None else pairs[pair]  # noqa: B023, E731
        secret = PAIRS * of(random, random_single) + SINGLES * random_single[b] + (1 - PAIRS - SINGLES) * uniform
        ordinary = (PAIRS * of(plain, plain_single) + SINGLES * plain_single[b] + KNOWN_PAIRS * of(given, given_single)
                    + (1 - PAIRS - SINGLES - KNOWN_PAIRS) * uniform)
        ratios.append(math.log((secret + uniform) / 2) - math.log(ordinary))
    return ratios


def judged(scanned: DataFrame, ratios: list[float], least_ratio: float = LEAST_RATIO) -> DataFrame:
    """A scanned frame with spans: array<struct<start, kind, end>> of all secrets, by start, then kind in the order of KINDS."""
    model = F.split(F.lit(",".join(f"{r:.6f}" for r in ratios)), ",").cast("array<double>")
    code = lambda t, i: F.ascii(F.substring(t, i, F.lit(1))) - FIRST
    ratio = lambda t: F.aggregate(F.sequence(F.lit(1), F.length(t) - 1), F.lit(0.0),
                                  lambda acc, i: acc + F.get(model, code(t, i) * SYMBOLS + code(t, i + 1)))
    added = F.filter("tokens", lambda s: ratio(s["token"]) >= least_ratio)
    named = lambda spans, n: F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(n).alias("kind"), s["end"].alias("end")))
    return scanned.select("*", F.array_sort(F.concat(*[named(F.col(k), n) for n, k in enumerate(BASE)], named(added, len(BASE)))).alias("spans"))


def written(spans: Column, kinds: int = len(KINDS)) -> Column:
    """kind:start:end of spans, comma-joined; only of the first ``kinds`` kinds."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(F.filter(spans, lambda s: s["kind"] < kinds), lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def find_secrets(listings: DataFrame, scanned: DataFrame, key: str = "obs_id", text: str = "description") -> DataFrame:
    """(key, assign, access, hex, spans): one row per listing, spans as code point offsets with exclusive end.

    ``scanned`` is ``scan(listings.select(key, text), text)``, stored or not, for the samples are drawn from it too. Base spans are
    always kept; the models add spans of kind markov. Null and empty texts have none; without samples only texts of
    base patterns have spans. Repeated rows give repeated results. Other columns are ignored.
    """
    return judged(scanned, train(samples(scanned, text))).select(key, *BASE, "spans")


def mask_secrets(listings: DataFrame, text: str = "description") -> DataFrame:
    """``listings`` with every secret in ``text`` replaced by MASK; overlapping spans become one. Rows and columns stay.

    Columns named like those of ``scan`` may occur in ``listings``: only the text is looked at, and null texts stay null."""
    body = listings.select(F.struct("*").alias("row"), F.col(text).alias("body"))
    ratios = train(samples(scan(body.select("body"), "body"), "body"))
    marked = judged(scan(body, "body"), ratios)
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        gap = F.substring(F.col("body"), acc["at"] + 1, s["start"] - acc["at"])
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"),
                        F.when(s["start"] >= acc["at"], F.concat(acc["out"], gap, F.lit(MASK))).otherwise(acc["out"]).alias("out"))

    clean = F.aggregate("spans", start, step, lambda acc: F.concat(acc["out"], F.substring(F.col("body"), acc["at"] + 1, F.length("body"))))
    return marked.select("row", F.when(F.size("spans") > 0, clean).otherwise(F.col("body")).alias("clean")).select(
        *[F.col("clean").alias(c) if c == text else F.col(f"row.`{c}`") for c in listings.columns])
