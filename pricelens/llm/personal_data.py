"""Personal data in listing texts by weak supervision; DataFrame functions only.

Four exact patterns and four wider ones propose spans. Labelers vote on each proposal: by its form, by gazetteers (call prefixes, top
domains, card issuers, words that announce a kind), by the words before it and by what touches it. Expectation-maximisation over the
counts of vote patterns estimates how reliable each labeler is for each kind; its posteriors are the targets of a logistic span
classifier over the span's shape and surroundings. The classifier decides on proposals of the wider patterns; what the exact
patterns match always stays. Each text is one row throughout and is read once; votes and shapes are a few codes for each proposal.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pricelens.functions.literals import let
from pricelens.llm.common import cut

KINDS = ("email", "ip", "card", "phone")
#: Exact patterns. Quantifiers are possessive and starts are anchored where that changes no match, so that long runs take linear time and no stack.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Wider patterns: addresses that are spelled out, long addresses of the second kind, groups with other separators, national numbers.
WIDE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+\x20?(?i:[\[({]\x20?at\x20?[\])}]|\x20at\x20(?=[A-Za-z0-9-]{1,63}+\x20?[\[({\x20]\x20?dot)|\x20@\x20)\x20?"
             r"[A-Za-z0-9-]{1,63}+(?:\x20?(?i:[\[({]\x20?dot\x20?[\])}]|\x20dot\x20|\.)\x20?[A-Za-z0-9-]{1,63}+){1,4}+",
    "ip": r"(?<![0-9A-Za-z:.])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:.])",
    "card": r"(?<![0-9A-Za-z./_-])[0-9]{4}(?:[./_\u00A0\u2009]|\x20{2}|\x20-\x20)[0-9]{4}(?:[./_\u00A0\u2009]|\x20{2}|\x20-\x20)[0-9]{4}(?:[./_\u00A0\u2009]|\x20{2}|\x20-\x20)[0-9]{1,7}(?![0-9A-Za-z])",
    "phone": r"(?<![0-9A-Za-z+./_=-])(?:\([0-9]{2,4}\)\x20?[0-9]{3,4}[\x20.-][0-9]{3,4}|00[1-9][0-9]{0,2}(?:[\x20.-][0-9]{1,4}){3,6}|0[1-9](?:[\x20.-][0-9]{2}){4}"
             r"|[2-9][0-9]{2}[.-][0-9]{3}[.-][0-9]{4}|0[0-9]{2,4}[\x20/-][0-9]{3,4}(?:[\x20-][0-9]{2,4}){1,2})(?![0-9A-Za-z._=/-]?[0-9A-Za-z])",
}
#: What a text must hold for a pattern to be tried at all.
HINT = {"email": r"@|(?i:[\[({ ]at[\])} ])", "ip": r"[0-9A-Fa-f][.:][0-9A-Fa-f]{1,4}[.:]", "card": r"[0-9]", "phone": r"[0-9]{2}"}
#: Gazetteers (fixed values): words that announce a kind, words that speak against it, known top domains, card issuers' first digits.
ANNOUNCED = {
    "email": r"(?i:e-?mail|courriel|correo|contact|kontakt|mail|adresse|write|écri(?:re|vez)|schreib)",
    "ip": r"(?i:\bip\b|ipv[46]|host|server|serveur|servidor|addr|login|client)",
    "card": r"(?i:card|carte|karte|tarjeta|visa|master|credit|crédit|kredit|cb\b|paiement|payment)",
    "phone": r"(?i:tel|tél|phone|fon\b|mobil|móvil|portable|handy|call|appel|anruf|llama|sms|whatsapp|fax|joindre)",
}
AGAINST = {
    "email": r"(?i:git|ssh|scp)",
    "ip": r"(?i:version|v\.?$|ver\.|release|section|§|chapter|chapitre|kapitel|capítulo|firmware)",
    "card": r"(?i:isbn|issn|ean|imei|serial|série|order|commande|bestell|pedido|ref|réf|tracking|suivi|barcode|id)",
    "phone": r"(?i:isbn|ean|ref|réf|order|commande|bestell|pedido|version|siret|page|prix|price|preis|precio|€|\$|n°|art\.?)",
}
TOP_DOMAINS = r"(?i:com|org|net|edu|gov|io|eu|fr|de|es|uk|it|nl|be|ch|at|pt|us|ca|info|biz|me)$"
ISSUERS = r"^(?:4|5[1-5]|2[2-7]|3[47]|6(?:011|5|4))"
#: Votes of a labeler, codes of an outcome: abstains, against, for. Labelers in the order of their votes.
LABELERS = ("form", "gazetteer", "announced", "against", "touched", "grouping")
ABSTAINS, NO, YES = 0, 1, 2
#: Characters of a text that are looked at before and behind a proposal; most digits and separators that shapes tell apart.
BEFORE, BEHIND = 32, 2
#: Rounds of expectation-maximisation; share of the prior in every estimated reliability; what is thought of a labeler that votes before it is seen.
ROUNDS, PRIOR, ACCURACY = 60, 0.1, 0.85
#: Least probability of a span that the classifier adds; strength of its ridge, as a share of the proposals.
LEAST, RIDGE, STEPS = 0.6, 0.002, 30
#: Levels of each feature of a shape: digits, separators, before, behind, announced, spoken against, exact.
SHAPE = (6, 6, 4, 4, 2, 2, 2)

_DIGITS = lambda m: F.regexp_replace(m, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the checksum of card numbers."""
    doubled = F.transform(F.split(F.reverse(digits), ""), lambda x, i: F.when(i % 2 == 0, x.try_cast("int")).otherwise(
        F.pmod(2 * x.try_cast("int"), F.lit(10)) + F.floor(2 * x.try_cast("int") / 10).cast("int")))
    return F.aggregate(doubled, F.lit(0), lambda acc, x: acc + F.coalesce(x, F.lit(0))) % 10 == 0


def exact(kind: str, match: Column) -> Column:
    """Whether a match of the exact pattern is what it looks like."""
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return F.forall(F.split(match, r"\."), lambda p: F.regexp_replace(p, "^0+", "").rlike("^(?:[0-9]{0,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    digits = _DIGITS(match)
    if kind == "card":
        return F.length(digits).between(13, 19) & F.when(F.length(digits).between(13, 19), luhn(digits)).otherwise(False)
    return F.length(digits).between(9, 15)


#: Type of spans with what surrounds them; matches of a part.
PART = 128
SPAN = "array<struct<start:int,end:int,match:string,before:string,behind:string>>"


def _spans(body: Column, matches: Column, pattern: str, keep) -> Column:
    """Of all matches of the pattern in order those that ``keep`` is true for, as SPAN; offsets in code points."""
    gaps = F.split(body, pattern, -1)
    rows = F.arrays_zip(F.slice(gaps, F.lit(1), F.size(matches)).alias("gap"), matches.alias("match"), F.slice(gaps, F.lit(2), F.size(matches)).alias("next"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("spans"))

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + F.length(x["gap"])
        end = begin + F.length(x["match"])
        span = F.struct(begin.alias("start"), end.alias("end"), x["match"].alias("match"), F.substring(x["gap"], -BEFORE, BEFORE).alias("before"),
                        F.substring(x["next"], 1, BEHIND).alias("behind"))
        return F.struct(end.alias("at"), F.when(keep(x["match"]), F.array_append(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    def shifted(acc: Column, x: Column) -> Column:
        moved = F.transform(x["spans"], lambda s: F.struct((s["start"] + acc["at"]).alias("start"), (s["end"] + acc["at"]).alias("end"), s["match"], s["before"], s["behind"]))
        return F.struct((acc["at"] + x["at"]).alias("at"), F.array_append(acc["parts"], moved).alias("parts"))

    # an array that grows is copied at each step: short parts first, then their offsets, so that a text's matches cost no square of their number
    parts = let(rows, lambda r: F.transform(F.sequence(F.lit(1), F.size(r), F.lit(PART)), lambda i: F.aggregate(F.slice(r, i, F.lit(PART)), start, step)))
    whole = F.aggregate(parts, F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{SPAN}>").alias("parts")), shifted, lambda acc: F.flatten(acc["parts"]))
    return F.when(F.size(matches) > 0, whole).otherwise(F.array().cast(SPAN))


def _vote(yes: Column | None = None, no: Column | None = None) -> Column:
    out = F.lit(ABSTAINS)
    if no is not None:
        out = F.when(no, F.lit(NO)).otherwise(out)
    if yes is not None:
        out = F.when(yes, F.lit(YES)).otherwise(out)
    return out


def votes(kind: str, x: Column, is_exact: bool) -> list[Column]:
    """One vote of each of LABELERS on a proposal."""
    match, before, behind = x["match"], x["before"], x["behind"]
    digits = _DIGITS(match)
    n = F.length(digits)
    if kind == "email":
        gazetteer = _vote(match.rlike(TOP_DOMAINS), ~match.rlike(TOP_DOMAINS))
        form, grouping = _vote(F.lit(is_exact)), _vote(no=match.rlike(r"^[._%+-]|\.\.|[.-]@|@-"), yes=match.rlike(r"^[A-Za-z]"))
    elif kind == "ip":
        gazetteer = _vote(no=match.rlike(r"^(?:0|1\.0\.0|255)\b"))
        form, grouping = _vote(exact(kind, match) if is_exact else F.lit(False)), _vote(yes=match.rlike(r"[0-9]{2,3}\.[0-9]{2,3}|:"), no=match.rlike(r"^[0-9]\.[0-9]\.[0-9]\.[0-9]$"))
    elif kind == "card":
        gazetteer = _vote(digits.rlike(ISSUERS), ~digits.rlike(ISSUERS))
        sound = n.between(13, 19) & luhn(digits)
        form, grouping = _vote(sound, ~sound), _vote(yes=match.rlike(r"^[0-9]{13,19}$|^[0-9]{4}(?:\D{1,3}[0-9]{4}){3}$"), no=match.rlike(r"^(?:[0-9]{1,3}\D)+"))
    else:
        gazetteer = _vote(match.rlike(r"^(?:\+|00|0[1-9]|\()|555"), ~match.rlike(r"^(?:\+|00|0|\()"))
        form, grouping = _vote(n.between(9, 15), ~n.between(7, 15)), _vote(yes=match.rlike(r"[0-9]{3}[\x20.-][0-9]{4}$|(?:[\x20.-][0-9]{2}){3}$"), no=match.rlike(r"^[0-9]{4}-[0-9]{2}-"))
    announced, against = before.rlike(ANNOUNCED[kind]), before.rlike(AGAINST[kind])
    touched = before.rlike(r"[\p{L}0-9_=/#\\-]$") | behind.rlike(r"^(?:[\p{L}0-9_=/\\]|[.-][0-9])")
    return [form, gazetteer, _vote(announced), _vote(no=against), _vote(~touched, touched), grouping]


def shape(kind: str, x: Column, is_exact: bool) -> list[Column]:
    """Features of a proposal, in the levels of SHAPE."""
    match, before, behind = x["match"], x["before"], x["behind"]
    digits = F.length(_DIGITS(match))
    separators = F.length(F.regexp_replace(match, "[A-Za-z0-9]", ""))
    side = lambda s: F.when(s == "", 0).when(s.rlike(r"[\p{L}0-9_]"), 1).when(s.rlike(r"\s"), 2).otherwise(3)
    return [F.when(digits == 0, 0).when(digits < 9, 1).when(digits < 11, 2).when(digits < 13, 3).when(digits < 16, 4).otherwise(5),
            F.least(separators, F.lit(5)), side(F.substring(before, -1, 1)), side(F.substring(behind, 1, 1)),
            before.rlike(ANNOUNCED[kind]).cast("int"), before.rlike(AGAINST[kind]).cast("int"), F.lit(int(is_exact))]


def propose(listings: DataFrame, key: str, text: str) -> DataFrame:
    """(key, email, ip, card, phone, wide): exact spans and further proposals of each text, and their votes and shapes.

    Elements are structs of start, end, kind, votes and shape, the latter two as one number each. Proposals that touch an exact span, or
    an earlier proposal of the kinds in their order, are left out."""
    body = F.coalesce(F.col(text), F.lit(""))

    def coded(values: list[Column], levels: list[int]) -> Column:
        out = F.lit(0)
        for v, n in zip(values, levels, strict=True):
            out = out * n + v
        return out.cast("int")

    def described(spans: str, kind: str, is_exact: bool) -> Column:
        return F.transform(spans, lambda x: F.struct(x["start"], x["end"], F.lit(KINDS.index(kind)).alias("kind"), coded(votes(kind, x, is_exact), [3] * len(LABELERS)).alias("votes"),
                                                    coded(shape(kind, x, is_exact), list(SHAPE)).alias("shape")))

    every = {k: (p, k, True) for k, p in BASE.items()} | {f"w_{k}": (p, k, False) for k, p in WIDE.items()}
    rows = listings.select(F.col(key).alias("id"), body.alias("body"))
    found = rows.select("id", "body", *[F.when(F.col("body").rlike(HINT[k]), F.regexp_extract_all("body", F.lit(p), F.lit(0))).otherwise(
        F.array().cast("array<string>")).alias(c) for c, (p, k, _) in every.items()])
    found = found.select("id", *[_spans(F.col("body"), F.col(c), p, lambda m, k=k, is_exact=is_exact: exact(k, m) if is_exact else F.lit(True)).alias(c)
                                 for c, (p, k, is_exact) in every.items()])
    found = found.select("id", *[described(c, k, is_exact).alias(c) for c, (_, k, is_exact) in every.items()])
    apart = lambda spans: lambda s: ~F.exists(spans, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
    found = found.withColumn("wide", F.col("w_email")).withColumn("exact", F.concat(*KINDS))
    for k in KINDS[1:]:
        found = found.withColumn("wide", F.when(F.size(f"w_{k}") > 0, F.concat("wide", F.filter(f"w_{k}", apart(F.col("wide"))))).otherwise(F.col("wide")))
    return found.select("id", *KINDS, F.filter("wide", apart(F.col("exact"))).alias("wide"))


def _digits_of(code: int, levels: tuple[int, ...]) -> list[int]:
    out = []
    for n in reversed(levels):
        code, v = divmod(code, n)
        out.append(v)
    return out[::-1]


def reliabilities(counts: list[tuple[int, int, int]]) -> dict[tuple[int, int], float]:
    """Probability that a proposal is personal data, by (kind, votes), from (kind, votes, number): expectation-maximisation.

    A labeler votes with unknown frequencies on true and on false proposals of a kind, independently of the others. PRIOR of each
    frequency is held by the prior, the rest by the shares of the counts, so the number of proposals changes no verdict. A kind
    without proposals has no entries."""
    out: dict[tuple[int, int], float] = {}
    prior = np.array([[ACCURACY / 2, ACCURACY / 2, 1 - ACCURACY], [ACCURACY / 2, 1 - ACCURACY, ACCURACY / 2]])  # class x vote
    for kind in sorted({k for k, _, _ in counts}):
        codes, number = zip(*[(v, n) for k, v, n in sorted(counts) if k == kind])
        cast = np.array([_digits_of(c, (3,) * len(LABELERS)) for c in codes])
        share = np.array(number, dtype=float) / sum(number)
        seen = np.eye(3)[cast]  # pattern x labeler x vote
        rate, true = np.repeat(prior[:, None, :], len(LABELERS), axis=1), 0.5
        for _ in range(ROUNDS):
            log = np.einsum("plv,clv->pc", seen, np.log(rate)) + np.log([1 - true, true])
            posterior = 1 / (1 + np.exp(np.clip(log[:, 0] - log[:, 1], -500, 500)))
            weight = np.stack([share * (1 - posterior), share * posterior])
            true = float(np.clip((1 - PRIOR) * weight[1].sum() + PRIOR * 0.5, 1e-6, 1 - 1e-6))
            totals = weight.sum(axis=1)[:, None, None]
            counted = np.einsum("cp,plv->clv", weight, seen) / np.maximum(totals, 1e-12)
            rate = np.where(totals > 1e-9, (1 - PRIOR) * counted + PRIOR * prior[:, None, :], prior[:, None, :])
        out.update({(kind, c): float(p) for c, p in zip(codes, posterior)})
    return out


@dataclass
class Classifier:
    """Logistic weights of a span's kind and of every level of its shape, one set a kind."""

    weights: dict[int, np.ndarray]

    @staticmethod
    def features(code: int) -> np.ndarray:
        return np.concatenate([[1.0], *[np.eye(n)[v] for v, n in zip(_digits_of(code, SHAPE), SHAPE)]])

    @classmethod
    def fit(cls, rows: list[tuple[int, int, int, float]]) -> Classifier:
        """From (kind, shape, number, expected true ones): Newton's method on shares, with a ridge."""
        weights = {}
        for kind in sorted({r[0] for r in rows}):
            own = sorted(r for r in rows if r[0] == kind)
            x = np.array([cls.features(r[1]) for r in own])
            n = np.array([r[2] for r in own], dtype=float) / sum(r[2] for r in own)
            y = np.array([r[3] / r[2] for r in own])
            w = np.zeros(x.shape[1])
            for _ in range(STEPS):
                p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
                gradient = x.T @ (n * (p - y)) + RIDGE * w
                curve = (x * (n * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + RIDGE * np.eye(len(w))
                w = w - np.linalg.solve(curve, gradient)
            weights[kind] = w
        return cls(weights)

    def probability(self, kind: int, code: int) -> float:
        if kind not in self.weights:
            return 0.0
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, float(self.features(code) @ self.weights[kind])))))

    def accepts(self, least: float) -> Callable[[Column], Column]:
        """Function of a proposal: whether its weights' sum reaches the probability."""
        def accepted(x: Column) -> Column:
            out = F.lit(False)
            for kind, w in self.weights.items():
                score, at, rest = F.lit(float(w[0])), len(w), x["shape"]
                for n in reversed(SHAPE):
                    at -= n
                    level = rest % n
                    rest = F.floor(rest / n).cast("int")
                    score = score + F.get(F.array(*[F.lit(round(float(v), 9)) for v in w[at:at + n]]), level)
                out = out | ((x["kind"] == kind) & (score >= math.log(least / (1 - least))))
            return out

        return accepted


def train(proposed: DataFrame) -> Classifier:
    """The span classifier, from the counts of vote patterns and shapes of all proposals.

    Two small tables come to the driver: 4 x 3^6 vote patterns, and as many shapes as SHAPE has combinations, at most."""
    every = proposed.select(F.explode(F.concat(*KINDS, "wide")).alias("s")).select("s.kind", "s.votes", "s.shape")
    counts = [tuple(r) for r in every.groupBy("kind", "votes").count().collect()]
    true = reliabilities(counts)
    if not true:
        return Classifier({})
    patterns = 3 ** len(LABELERS)
    table = F.split(F.lit(",".join(f"{true.get((k, c), 0):.9f}" for k in range(len(KINDS)) for c in range(patterns))), ",").cast("array<double>")
    expected = F.get(table, F.col("kind") * patterns + F.col("votes"))
    shapes = every.groupBy("kind", "shape").agg(F.count("*").alias("n"), F.sum(expected).alias("true")).collect()
    return Classifier.fit([tuple(r) for r in shapes])


def written(spans: Column) -> Column:
    """kind:start:end of spans by kind, then start, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    rows = F.array_sort(F.transform(spans, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))))
    return F.array_join(F.transform(rows, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def find_personal_data(listings: DataFrame, key: str = "obs_id", text: str = "description", least: float = LEAST) -> DataFrame:
    """(key, email, ip, card, phone, added): one row per listing, spans (start, end, kind) as code point offsets with exclusive end.

    The first four hold what the exact patterns match; ``added`` what the classifier takes from the wider ones, which touches none of them.
    Null and empty texts have none. Repeated rows give repeated results, rows with a null key are rows like others; other columns are
    ignored, and an empty table gives an empty result. What is decided about a text depends on the shares of vote patterns in the whole
    table, not on its size. Texts are read once; the proposals, a few numbers each, are stored when the frame is made.
    """
    proposed = cut(propose(listings, key, text))
    model = train(proposed)
    plain = lambda spans: F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))
    added = F.filter("wide", model.accepts(least)) if model.weights else F.filter("wide", lambda s: F.lit(False))
    return proposed.select(F.col("id").alias(key), *[plain(k).alias(k) for k in KINDS], plain(added).alias("added"))
