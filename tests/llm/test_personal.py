"""Personal data: exact spans against the plain patterns, estimated reliabilities, what the classifier adds and leaves alone."""

import hashlib
import random
import re

from pyspark.sql import functions as F

from pricelens.llm import personal_data as personal
from pricelens.llm import queries
from pricelens.llm.personal_data import KINDS, NO, YES, Classifier, find_personal_data, reliabilities

LISTING = "obs_id long, description string"
PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+",
         "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain_luhn(digits):
    return sum(int(d) if i % 2 == 0 else sum(divmod(2 * int(d), 10)) for i, d in enumerate(reversed(digits))) % 10 == 0


def plain_spans(text):
    out = []
    for k, kind in enumerate(KINDS):
        for m in re.finditer(PLAIN[kind], text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")) or kind == "card" and not (13 <= len(digits) <= 19 and plain_luhn(digits)) or (
                    kind == "phone" and not 9 <= len(digits) <= 15):
                continue
            out.append((k, m.start(), m.end()))
    return out


def spans(row, *columns):
    return sorted((s.kind, s.start, s.end) for c in columns for s in row[c])


def odd_texts():
    draw = random.Random(5)
    out = ["".join(draw.choices("a.-_@b1+ ", k=60)) for _ in range(400)]
    out += ["".join(draw.choices("0125.. -+()", k=60)) for _ in range(400)]
    out += ["".join(draw.choices(["a@b.c", "_", "é", "😀", " ", ".", "@", "4111 1111 1111 1111", "-", "1.2.3.4", "256", "+1 (415) 555-0100", "0", "x"], k=12)) for _ in range(400)]
    return out + [None, "", "a" * 2000, "1" * 2000, "1." * 4000, "a@b" + ".c" * 2000, "+" * 5000, "+1" + " " * 2000, "1 " * 2000 + "a", "a@" * 2000,
                  "0000000255.1.1.0001", "é 😀 a@b.c"]


def test_exact_spans_equal_the_plain_patterns(spark):
    texts = odd_texts()
    rows = spark.createDataFrame([(i if i % 7 else None, t, "x") for i, t in enumerate(texts)], LISTING + ", email string").withColumn("n", F.monotonically_increasing_id())
    rows = rows.unionAll(rows.where("obs_id = 3"))
    found = find_personal_data(rows.withColumn("obs_id", F.coalesce("obs_id", F.lit(-1)))).collect()
    assert len(found) == len(texts) + 1
    by_text = sorted(spans(r, *KINDS) for r in found)
    assert by_text == sorted(plain_spans(t) for t in [*texts, texts[3]])
    keyed = {r.obs_id: spans(r, *KINDS) for r in found if r.obs_id != -1}
    assert all(keyed[i] == plain_spans(t) for i, t in enumerate(texts) if i % 7)
    assert find_personal_data(rows.limit(0)).count() == 0


def test_long_runs_take_linear_time(spark):
    texts = ["a" * 500_000, "1" * 500_000, "1." * 50_000, "a@b" + ".c" * 100_000, "+" * 100_000, "+1" + " " * 200_000, "1 " * 200_000 + "a", "a@" * 100_000]
    found = {r.obs_id: [len(r[k]) for k in KINDS] for r in find_personal_data(spark.createDataFrame(list(enumerate(texts)), LISTING)).collect()}
    assert found == {i: [0, 12_500, 0, 0] if i == 2 else [1, 0, 0, 0] if i == 3 else [0] * 4 for i in range(len(texts))}


SPELLED = ["jean.dupont [at] exemple [dot] fr", "anna(at)beispiel(dot)de", "bob at example dot com", "carla @ ejemplo.es"]
NUMBERS = ["(415) 555-0134", "415-555-0134", "06 12 34 56 78", "0033 6 12 34 56 78", "030 1234 5678"]
OTHERS = ["2001:0db8:85a3:0000:0000:8a2e:0370:7334", "4111.1111.1111.1111", "4111  1111  1111  1111"]
CLEAN = ["version 10.2.3 du 2019-11-08", "prix 1 250,00 € et 12 34", "lot de 4 disques 4000 Go 7200 tr/min", "ISBN 978-2-07-036822-8", "ref 06-12-34-56-78-90-12", "at home dot the i",
         "we met at noon", "12.50 - 13.75 - 14.00", "ST4000VN008-2DR166", "2021 2022 2023 2024", "le 06/12/2024 a 10:45:00", "0123456789abcdef"]


def corpus():
    draw = random.Random(8)
    out = []
    for i in range(600):
        words = " ".join(draw.choices(["vends", "disque", "neuf", "the", "mit", "und", "para"], k=8))
        made = draw.choice([f"contact u{i}@mail{i % 7}.example.com ici", f"tel +1 ({200 + i}) 555-{i:04d} merci", f"host {i % 255}.{i % 99}.7.{i % 31} ok", "rien", "version 1.2.3.4"])
        out.append(f"{words} {made} {words}")
    return out + [f"mail: {x} merci" for x in SPELLED] + [f"appelez au tel {x} le soir" for x in NUMBERS] + [f"client {x} carte" for x in OTHERS] + [f"neuf {x} bien" for x in CLEAN]


def test_classifier_adds_what_patterns_miss_and_leaves_clean_texts_alone(spark):
    texts = corpus()
    rows = spark.createDataFrame(list(enumerate(texts)), LISTING)
    found = {r.obs_id: r for r in find_personal_data(rows).collect()}
    planted = texts[600:600 + len(SPELLED) + len(NUMBERS) + len(OTHERS)]
    missed = [t for i, t in enumerate(planted, 600) if not found[i].added]
    assert not missed
    for i, x in enumerate(SPELLED + NUMBERS + OTHERS, 600):
        start = texts[i].index(x)
        assert spans(found[i], "added") == [(found[i].added[0].kind, start, start + len(x))]
    assert not [texts[i] for i in range(600) if found[i].added]
    assert not [texts[i] for i in range(600 + len(planted), len(texts)) if found[i].added]


def test_verdicts_do_not_depend_on_the_size_of_the_table(spark):
    texts = corpus()
    once = spark.createDataFrame(list(enumerate(texts)), LISTING)
    many = spark.createDataFrame([(i + 10_000 * k, t) for k in range(6) for i, t in enumerate(texts)], LISTING)
    key = lambda df: {r.obs_id % 10_000: spans(r, "added") for r in df.collect()}
    assert key(find_personal_data(once)) == key(find_personal_data(many))


def test_reliabilities_are_those_that_made_the_votes():
    draw = random.Random(1)
    right = [0.95, 0.9, 0.8, 0.75, 0.7, 0.55]
    counts, truth = {}, {}
    for _ in range(40_000):
        true = draw.random() < 0.4
        code = 0
        for r in right:
            vote = (YES if true else NO) if draw.random() < r else (NO if true else YES)
            code = code * 3 + (vote if draw.random() < 0.8 else 0)
        counts[code] = counts.get(code, 0) + 1
        truth[code] = truth.get(code, 0) + true
    found = reliabilities([(2, c, n) for c, n in counts.items()])
    error = sum(n * abs(found[2, c] - truth[c] / n) for c, n in counts.items()) / 40_000
    hits = sum(max(truth[c], n - truth[c]) if (found[2, c] > 0.5) == (truth[c] * 2 > n) else min(truth[c], n - truth[c]) for c, n in counts.items()) / 40_000
    assert error < 0.05 and hits > 0.95
    assert found == reliabilities([(2, c, 1000 * n) for c, n in counts.items()])


def test_classifier_learns_shares():
    code = lambda values: sum(v * w for v, w in zip(values, [6 * 4 * 4 * 8, 4 * 4 * 8, 4 * 8, 8, 4, 2, 1]))
    good, bad = code([3, 2, 2, 2, 1, 0, 0]), code([3, 2, 1, 2, 0, 1, 0])
    model = Classifier.fit([(3, good, 50, 48.0), (3, bad, 50, 1.0)])
    assert model.probability(3, good) > 0.85 and model.probability(3, bad) < 0.15 and model.probability(0, good) == 0


def test_query_counts_and_digests(spark):
    sf = "/root/testdata/sf0.001"
    rows = queries.op11_personal_data(spark, sf).collect()
    texts = {r.doc_id: r.text for r in queries.table(spark, sf, "documents").collect()}
    assert {r.doc_id for r in rows} == set(texts)
    for r in rows:
        plain = plain_spans(texts[r.doc_id])
        names = [f"{KINDS[k]}:{a}:{b}" for k, a, b in plain]
        assert r.base_sha256 == hashlib.sha256(",".join(names).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == i for k, _, _ in plain) for i in range(4)]
        assert set(names) <= set(r.spans.split(",")) if names else True
    assert personal.LEAST > 0.5
