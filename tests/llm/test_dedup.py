"""Near-duplicate groups, repeated passages and nearest vectors against brute force."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from pricelens.llm import common, nearest as nearest_module, repeats, simhash
from pricelens.sources.observations import observation_log

SF = "/root/testdata/sf0.001"
LISTING = "obs_id long, source string, listing_id string, title string, description string"
WORDS = "disque dur serveur neuf garantie facture livraison paris lyon vélo cadre carbone selle roue pédale état moteur".split()


def listings(spark, texts, first=0):
    rows = [(i + first, "lbc", str(i), "annonce", t) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, LISTING)


def sentence(draw, n):
    return " ".join(draw.choice(WORDS) + str(draw.randrange(50)) for _ in range(n))


def plain_fingerprint(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\r\x0b\x0c":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    shingles = [" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    h = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(marks, radius=4):
    """(key, bits) rows -> smallest key of each one's component, in the same order."""
    parent = list(range(len(marks)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (_, a) in enumerate(marks):
        for j in range(i):
            if (a ^ marks[j][1]).bit_count() <= radius:
                parent[root(i)] = root(j)
    least = {}
    for i, (k, _) in enumerate(marks):
        if k is not None:
            least[root(i)] = min(k, least.get(root(i), k))
    return [least.get(root(i)) for i in range(len(marks))]


def test_near_duplicates_match_brute_force(spark):
    draw = random.Random(3)
    texts = [sentence(draw, 60) for _ in range(40)]
    texts += [t.replace(" ", "\n", 3) for t in texts[:5]] + [t + " fin" for t in texts[:10]] + [texts[0].upper(), "", None, "a b", "A  B", "é " * 50_000]
    rows = listings(spark, texts).union(listings(spark, texts[:3]))  # repeated keys
    rows = rows.union(spark.createDataFrame([(None, "lbc", "x", "t", texts[1])], LISTING)).withColumn("bits", F.lit("taken"))
    found = sorted(((r.obs_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(rows).collect()), key=str)
    data = [(r.obs_id, plain_fingerprint(r.description)) for r in rows.collect()]
    expected = [(k, f"{b:016x}", c) for (k, b), c in zip(data, plain_components(data))]
    assert found == sorted(expected, key=str)
    kept = simhash.first_of_groups(rows)
    assert kept.columns == rows.columns
    assert sorted(r.obs_id for r in kept.collect()) == sorted({c for _, _, c in expected})


def test_links_of_crowded_keys_keep_components(spark, monkeypatch):
    monkeypatch.setattr(simhash, "CHUNK", 20)
    draw = random.Random(5)
    bits = {draw.getrandbits(64) for _ in range(50)}
    centre = draw.getrandbits(64)
    bits |= {centre ^ (1 << a) ^ (1 << b) ^ (1 << c) for a, b, c in (draw.sample(range(64), 3) for _ in range(120))}
    bits = sorted(bits)
    signed = [b - (1 << 64) if b >> 63 else b for b in bits]
    df = spark.createDataFrame([(b,) for b in signed], "bits long")
    roots = {r.node: r.root for r in common.components(simhash.links(df)).collect()}
    groups = lambda labels: sorted(Counter(labels).values())
    assert groups(roots.get(s, s) for s in signed) == groups(plain_components(list(zip(signed, bits))))


def test_components_of_a_long_chain(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(30)] + [(100, 101), (101, 102), (7, 7)], "a long, b long")
    roots = {r.node: r.root for r in common.components(chain).collect()}
    assert len({roots[i] for i in range(31)}) == 1 and len({roots[i] for i in (100, 101, 102)}) == 1 and roots[0] != roots[100]


def test_near_duplicates_of_the_observation_log(spark):
    log = observation_log(spark, SF).limit(50)
    assert simhash.near_duplicates(log).count() == 50
    assert simhash.near_duplicates(log.limit(0)).count() == 0


def test_the_cover_meets_every_difference():
    assert {(a - b) % repeats.PERIOD for a in repeats.COVER for b in repeats.COVER} == set(range(repeats.PERIOD))


def test_repeats_match_brute_force(spark):
    draw = random.Random(9)
    passages = [sentence(draw, n) for n in (35, 36, 50, 34, 80)]
    texts = [" ".join([sentence(draw, draw.randrange(30)), draw.choice(passages), sentence(draw, draw.randrange(30))]) for _ in range(60)]
    texts += ["encore " * 200, " ".join([passages[2]] * 3), "", None, sentence(draw, 30_000), "  a\x0bb\x1cc "]
    rows = listings(spark, texts).union(listings(spark, texts[-1:], 99)).withColumn("marks", F.lit(1)).repartition(4)
    words = [(r.obs_id, (r.description or "").encode().split()) for r in rows.collect()]
    seen = Counter(tuple(w[i:i + 35]) for _, w in words for i in range(len(w) - 34))
    expected = []
    for i, w in words:
        gone = {p for s in range(len(w) - 34) if seen[tuple(w[s:s + 35])] > 1 for p in range(s, s + 35)}
        expected.append((i, len(w), len(gone), b" ".join(x for p, x in enumerate(w) if p not in gone).decode()))
    assert sorted(map(tuple, repeats.remove_repeats(rows).collect()), key=str) == sorted(expected, key=str)
    assert repeats.remove_repeats(rows.limit(0)).count() == 0


def test_repeats_with_null_and_repeated_keys(spark):
    text = sentence(random.Random(1), 40)
    rows = spark.createDataFrame([(None, text), (None, "seul"), (3, text), (3, text), (3, "autre")], "obs_id long, description string")
    assert sorted((str(r.obs_id), r.n_removed) for r in repeats.remove_repeats(rows).collect()) == [
        ("3", 0), ("3", 40), ("3", 40), ("None", 0), ("None", 40)]


def test_many_rows_of_one_key_and_text(spark):
    draw = random.Random(3)
    text, other = sentence(draw, 400), sentence(draw, 60)
    rows = spark.createDataFrame([(5, text)] * 1500 + [(6, other), (7, f"{other} {text[:3]} fin")], "obs_id long, description string").repartition(6)
    found = repeats.remove_repeats(rows).groupBy("obs_id", "n_removed").count().collect()
    assert {(r.obs_id, r.n_removed): r["count"] for r in found} == {(5, 400): 1500, (6, 60): 1, (7, 60): 1}


def plain_nearest(rows, queries, k):
    ok = [(i, np.array(v, dtype=float)) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    out = []
    for q, a in ok:
        if q in queries:
            scores = sorted((-sum(a * b) / np.sqrt(sum(a * a)) / np.sqrt(sum(b * b)), i) for i, b in ok if i != q and len(b) == len(a))[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scores)]
    return out


@pytest.mark.parametrize("block", [8192, 64])
def test_nearest_matches_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(nearest_module, "CANDIDATES", block)
    monkeypatch.setattr(nearest_module, "QUERIES", 3)
    x = np.random.default_rng(0).normal(size=(300, 7)).astype(np.float32)
    x[10] = x[11] = x[12]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(1000, None), (1001, [0.0] * 7), (1002, [float("nan")] * 7), (1003, [None] * 7), (1004, []), (1005, [1.0, 2.0]), (None, [1.0] * 7), (1006, [1e38] * 7)]
    df = spark.createDataFrame(rows, "obs_id long, embedding array<float>").withColumn("score", F.lit("taken"))
    found = sorted(map(tuple, nearest_module.nearest(df, df.where("obs_id % 50 = 0 or obs_id = 11")).collect()))
    expected = sorted(plain_nearest(rows, {i for i in range(2000) if i % 50 == 0 or i == 11}, 5))
    assert [f[:3] for f in found] == [e[:3] for e in expected]
    assert np.allclose([f[3] for f in found], [e[3] for e in expected], atol=1e-12)
    assert nearest_module.nearest(df.limit(0), df).count() == 0
    few = df.where("obs_id < 3")
    assert nearest_module.nearest(few, few.where("obs_id = 0")).count() == 2


def test_nearest_of_text_keys(spark):
    x = np.random.default_rng(2).normal(size=(120, 5))
    x[30] = x[31] = x[32]
    rows = [(f"é{i % 7}-{i}", v.tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "listing_id string, embedding array<double>").repartition(3)
    asked = df.where("listing_id like 'é3%'")
    found = sorted(map(tuple, nearest_module.nearest(df, asked, "listing_id").collect()))
    expected = sorted(plain_nearest(rows, {r.listing_id for r in asked.collect()}, 5))
    assert [f[:3] for f in found] == [e[:3] for e in expected]
    assert np.allclose([f[3] for f in found], [e[3] for e in expected], atol=1e-12)


def test_digest_of_kept_words_is_that_of_the_query(spark):
    from pricelens.llm.queries import op7_repeats

    row = op7_repeats(spark, SF).where("n_removed = n_words").first()
    assert row.kept_sha256 == hashlib.sha256(b"").hexdigest()
