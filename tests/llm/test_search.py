"""Ranked lexical search against brute force."""

import math
import random
import re
from collections import Counter

import numpy as np

from pricelens.llm import lexical_search, queries
from pricelens.llm.lexical_search import Treap, ranked_search

SF = "/root/testdata/sf0.001"
LISTING = "obs_id long, description string"
SEARCH = "search_key long, query string"


def plain_terms(text):
    lowered = "".join(c.lower() if c.isascii() else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lowered)


def plain_search(listings, searches, top=10):
    docs = [(k, Counter(t)) for k, t in ((k, plain_terms(t)) for k, t in listings) if t]
    n, total = len(docs), sum(sum(c.values()) for _, c in docs)
    df = Counter(t for _, c in docs for t in c)
    out = []
    for name, text in set(searches):
        found = []
        for k, c in docs:
            m = 10 + 90 * sum(c.values()) * n // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in set(plain_terms(text)) if t in c)
            if score:
                found.append((k, score))
        found.sort(key=lambda x: (-x[1], x[0] is not None, x[0]))
        out += [(name, r, k, score) for r, (k, score) in enumerate(found[:top], 1)]
    return sorted(out, key=repr)


def drawn(seed, rows, words=200):
    draw = random.Random(seed)
    names = [f"w{i}" for i in range(words)]
    weights = [1 / (i + 1) for i in range(words)]
    texts = [" ".join(draw.choices(names, weights, k=draw.choice([1, 3, 20, 60]))) for _ in range(rows)]
    return texts + [texts[0].upper()] * 30 + ["Disque dur 4 To, neuf; état: très bon"] * 15, draw


def found(df):
    return sorted((tuple(r) for r in df.select("search_key", "rank", "obs_id", "score").collect()), key=repr)


def test_search_equals_brute_force_over_several_shards_and_blocks(spark, monkeypatch):
    texts, draw = drawn(3, 900)
    listings = list(enumerate(texts))
    draw.shuffle(listings)
    searches = [(i, " ".join(draw.choices(texts).pop().split()[:12]) + " w0 disque") for i in range(25)] + [(90, texts[0]), (91, texts[0])]
    monkeypatch.setattr(lexical_search, "SHARD", 64)
    rows = spark.createDataFrame(listings, LISTING).repartition(3)
    asked = spark.createDataFrame(searches, SEARCH)
    wanted = plain_search(listings, searches)
    assert found(ranked_search(rows, asked)) == wanted
    assert found(ranked_search(rows, asked, block_bytes=700)) == wanted
    assert found(ranked_search(rows, asked, top=3)) == [w for w in wanted if w[1] <= 3]


def test_search_of_odd_rows(spark):
    listings = [(1, None), (2, ""), (3, "?!"), (None, "rare mot"), (5, "rare mot"), (5, "rare mot"), (6, "mot " * 60_000), (7, "Été rare"), (8, "a" * 200_000), (None, None)]
    searches = [(1, "RARE mot mot"), (1, "été"), (None, "rare"), (4, None), (5, " .. "), (6, "absent"), (1, "RARE mot mot")]
    rows = spark.createDataFrame([(*r, 1, "x") for r in listings], LISTING + ", score int, term string")
    asked = spark.createDataFrame([(*s, 2) for s in searches], SEARCH + ", rank int")
    assert found(ranked_search(rows, asked)) == plain_search(listings, searches)
    assert ranked_search(rows.limit(0), asked).count() == 0 and ranked_search(rows, asked.limit(0)).count() == 0
    names = spark.createDataFrame([(f"id{k}", t) for k, t in listings if k], "obs_id string, description string")
    assert {r.obs_id for r in ranked_search(names, asked).where("search_key IS NULL").collect()} == {"id5", "id7"}


def test_cells_hold_the_greatest_values_below_them():
    draw = np.random.default_rng(2)
    at = draw.choice(40 * 50, 300, replace=False)
    rows, columns, values = at // 50, at % 50, draw.integers(1, 1000, 300)
    treap = Treap(rows, columns, values)
    assert treap.height == 6 and treap.best[1] == values.max()
    every = np.arange(50)
    for row in range(40):
        cells = np.ones(50, dtype=np.int64)
        for level in range(treap.height):
            bit = treap.height - 1 - level
            cells = treap.quarter(cells, np.full(50, (row >> bit & 1) << 1) | (every >> bit & 1))
            for c in every[::7]:
                inside = (rows >> bit == row >> bit) & (columns >> bit == c >> bit)
                assert treap.best[cells[c]] == (values[inside].max() if inside.any() else 0)


def test_best_ranges_alone_are_halved(monkeypatch):
    monkeypatch.setattr(lexical_search, "TOGETHER", 8)
    n = 4096
    rows, columns = np.repeat([0, 1, 2], n), np.tile(np.arange(n), 3)
    values = np.where(columns % 512 == 5, 1000, 1)
    treap = Treap(rows, columns, values)
    asked, seen = 0, []
    quarter = Treap.quarter

    def counted(self, cells, which):
        nonlocal asked
        asked += len(cells)
        return quarter(self, cells, which)

    def offer(columns, scores):
        seen.extend(zip(scores.tolist(), columns.tolist()))
        best = sorted(seen, reverse=True)[:8]
        return best[-1][0] if len(best) == 8 else 1

    monkeypatch.setattr(Treap, "quarter", counted)
    treap.best_columns(np.array([0, 1, 2]), 1, 8, offer)
    assert sorted(c for s, c in seen if s == 3000) == list(range(5, n, 512)) and asked < 1000


def test_query_ranks_documents(spark):
    rows = queries.op13_lexical_search(spark, SF)
    assert dict(rows.dtypes) == {"item_id": "bigint", "rank": "int", "doc_id": "bigint", "score": "bigint"}
    docs = [tuple(r) for r in queries.table(spark, SF, "documents").select("doc_id", "text").collect()]
    items = [tuple(r) for r in queries.table(spark, SF, "benchmark").select("item_id", "text").collect()]
    assert sorted((tuple(r) for r in rows.collect()), key=repr) == plain_search(docs, items)
