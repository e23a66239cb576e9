"""Ranked lexical search against scores that are worked out one by one."""

import random
import re
from collections import Counter
from math import floor, log

import numpy as np
import pytest

from tensorloom.llm import lexical
from tensorloom.llm.lexical import Best, build, rank_documents, search

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
DOCS, ITEMS = "doc_id long, text string", "item_id long, text string"


def terms_of(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, k=10):
    counts = [(d, Counter(terms_of(t))) for d, t in docs]
    counts = [(d, c, c.total()) for d, c in counts if c]
    big_n, length = len(counts), sum(n for _, _, n in counts)
    df = Counter(w for _, c, _ in counts for w in c)
    out = []
    for item, text in {*items}:
        scores = []
        for d, c, n in counts:
            m = 10 + 90 * n * big_n // length
            score = sum(floor(1000 * log((2 * big_n + 2) / (2 * df[w] + 1))) * (10**9 * c[w] // (1000 * c[w] + 8 * m)) for w in {*terms_of(text)} if w in c)
            if score > 0:
                scores.append((-score, d is not None, d or 0))
        out += [(item, r, d if known else None, -s) for r, (s, known, d) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=repr)


def got(df):
    return sorted(map(tuple, df.select("item_id", "rank", "doc_id", "score").collect()), key=repr)


def corpus(seed, n, words=60):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(words)] + ["Ünï", "日本", "x-y"]
    weights = [1 / (k + 1) for k in range(len(vocabulary))]
    return [(k, " ".join(rng.choices(vocabulary, weights, k=rng.randrange(1, 40)))) for k in range(n)], [(k, " ".join(rng.choices(vocabulary, k=rng.randrange(1, 12)))) for k in range(12)]


@pytest.mark.parametrize("block, chunk", [(1 << 20, 2048), (50, 3)])
def test_against_brute_force(spark, monkeypatch, block, chunk):
    monkeypatch.setattr(lexical, "BLOCK_POSTINGS", block)
    monkeypatch.setattr(lexical, "CHUNK", chunk)
    docs, items = corpus(1, 400)
    df = spark.createDataFrame(docs, DOCS).repartition(5)
    assert got(rank_documents(df, spark.createDataFrame(items, ITEMS))) == brute(docs, items)


def test_ties_repeats_nulls_and_long_texts(spark):
    docs = [(d, "alpha beta") for d in (9, 4, 4, None, 7, -3)] + [(None, None), (1, None), (2, ""), (3, "?!"), (5, "ALPHA"), (6, "gamma " * 300_000 + "alpha"), (8, "ÄLPHA älpha alpha\x00beta")]
    items = [(1, "Alpha beta alpha"), (1, "Alpha beta alpha"), (1, "gamma"), (2, None), (3, "none of these"), (4, ""), (None, "alpha"), (5, "äLPHA")]
    df, queries = spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)
    want = brute(docs, [x for x in items if x[1] is not None])
    assert got(rank_documents(df, queries)) == want and len(want) == 20
    assert got(rank_documents(df, queries, k=2)) == brute(docs, [x for x in items if x[1] is not None], 2)


def test_empty_tables_and_other_columns(spark):
    docs, items = spark.createDataFrame([(1, "a", 5, "q")], "doc_id long, text string, score int, item_id string"), spark.createDataFrame([(1, "a", 2)], "item_id long, text string, rank int")
    for d, q in ((docs.where("false"), items), (docs, items.where("false")), (docs.withColumn("text", docs.text.substr(9, 1)), items)):
        out = rank_documents(d, q)
        assert out.count() == 0 and dict(out.dtypes) == {"item_id": "bigint", "rank": "int", "doc_id": "bigint", "score": "bigint"}
    assert got(rank_documents(docs, items)) == brute([(1, "a")], [(1, "a")])


def test_lots_of_queries(spark, monkeypatch):
    docs, items = corpus(2, 60)
    monkeypatch.setattr(lexical, "LOT_ROWS", 5)
    assert got(rank_documents(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS))) == brute(docs, items)


def test_treaps_and_pruning():
    rng = np.random.default_rng(3)
    n_terms, n_docs = 6, 4000
    pairs = np.unique(rng.integers(0, n_terms * n_docs, 9000))
    term, doc = np.divmod(pairs, n_docs)
    impact = np.where(rng.random(len(pairs)) < 0.5, 7, rng.integers(1, 10**9, len(pairs)))  # many ties
    mixed = rng.permutation(len(pairs))
    t = build(term[mixed], doc[mixed], impact[mixed], n_terms, n_docs)

    def walk(node, low, high, above):
        if node < 0:
            return 0, 0
        assert low <= t.doc[node] < high and t.impact[node] <= above
        (a, h), (b, g) = walk(t.left[node], low, t.doc[node], t.impact[node]), walk(t.right[node], t.doc[node] + 1, high, t.impact[node])
        return a + b + 1, max(h, g) + 1

    for k in range(n_terms):
        size, height = walk(t.root[k], 0, n_docs, 1 << 62)
        assert size == (term == k).sum() and height < 60, "equal impacts do not make a list of a tree"
    best, queries = Best(3, 10), [np.array([0, 1]), np.array([5]), np.array([0, 2, 3, 4])]
    scored = search(t, np.ones(n_docs, bool), np.arange(n_docs), queries, best)
    for q, terms in enumerate(queries):
        total = np.zeros(n_docs, np.int64)
        for k in terms:
            np.add.at(total, doc[term == k], impact[term == k])
        want = sorted(range(n_docs), key=lambda d: (-total[d], d))[:10]
        assert best.id[q].tolist() == want and best.score[q].tolist() == total[want].tolist()
    assert scored < n_docs, "intervals that cannot enter are left out"


def test_impacts_do_not_overflow():
    tf, n, w = np.array([3, 1]), np.array([10**9, 5]), np.array([2000, 10])
    documents, length = 10**10, 10**12
    want = [w_ * (10**9 * t // (1000 * t + 8 * (10 + 90 * n_ * documents // length))) for t, n_, w_ in zip(tf.tolist(), n.tolist(), w.tolist())]
    assert lexical.impacts(tf, n, w, documents, length).tolist() == want
