import math
import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from pairscape.llm import lexical

TERM = re.compile("[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
KIND = "doc_id long, text string, score string, item int, n int"


def terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, k):
    split = [(i, Counter(terms(t))) for i, t in docs]
    held = [t for _, t in split if t]
    n_docs, total = len(held), sum(t.total() for t in held)
    df = {}
    for t in held:
        for w in set(t):
            df[w] = df.get(w, 0) + 1
    out = []
    for item, text in items:
        scores, asked = [], Counter(terms(text))
        for i, t in split:
            if i is None or not t:
                continue
            m = 25 + 75 * t.total() * n_docs // total
            score = sum(
                times * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * (1_000_000_000 * t[w] // (1000 * t[w] + 8 * m))
                for w, times in asked.items() if w in t
            )
            if score > 0:
                scores.append((-score, i))
        out += [(item, r, i, -s) for r, (s, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out)


def made(seed, n, words):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(words)] + ["Ärger", "ÉTÉ", "don't", "x_y", "A1"]
    weights = [1 / (i + 1) for i in range(len(vocabulary))]
    return [" ".join(r.choices(vocabulary, weights, k=r.choice([0, 1, 3, 20, 60, 300]))) + r.choice(["", ".", "\n-- "]) for _ in range(n)]


def frame(spark, docs):
    return spark.createDataFrame([(i, t, "s", 1, 2) for i, t in docs], KIND)


def items_of(spark, items):
    return spark.createDataFrame([(i, t, "z") for i, t in items], "item_id long, text string, doc_id string")


def found(spark, docs, items, k):
    got = lexical.lexical_search(frame(spark, docs), items_of(spark, items), k).collect()
    return sorted((r.item_id, r["rank"], r.doc_id, r.score) for r in got)


def test_against_brute_force_with_ties_and_repeats(spark):
    texts = made(1, 260, 80)
    docs = [*enumerate(texts), *[(1000 + i, texts[7]) for i in range(30)], (7, texts[7]), (7, texts[7]), (None, texts[3]), (2000, None), (2001, "")]
    items = [(i, t) for i, t in enumerate(made(2, 25, 80))] + [(100, texts[7]), (101, texts[7] + " " + texts[7]), (102, "unknown words only"), (103, None), (104, "")]
    assert found(spark, docs, items, 10) == brute(docs, items, 10)
    assert found(spark, docs, items, 1) == brute(docs, items, 1)
    assert found(spark, docs, items, 1000) == brute(docs, items, 1000)


def test_items_without_id_and_repeated_items(spark):
    docs = list(enumerate(["alpha beta", "beta gamma", "gamma", "delta"]))
    items = [(None, "alpha"), (1, "beta"), (1, "alpha"), (1, "alpha"), (2, "gamma")]
    assert found(spark, docs, items, 5) == brute(docs, [(1, "alpha"), (2, "gamma")], 5)


def test_empty_tables(spark):
    docs, items = [(1, "a b"), (2, "a")], [(1, "a b")]
    assert found(spark, docs, [], 3) == [] == found(spark, [], items, 3)
    assert found(spark, [(1, None), (2, "--")], items, 3) == []
    assert found(spark, docs, [(1, "?!")], 3) == []


def test_very_long_text_and_many_copies(spark):
    long = " ".join(f"w{i % 500}" for i in range(200_000))
    docs = [(0, long), *[(i, "w1 w2 rare") for i in range(1, 900)], (5000, "rare rare")]
    items = [(1, "rare w1 w2"), (2, "w499 w1"), (3, long)]
    assert found(spark, docs, items, 10) == brute(docs, items, 10)


def test_chunks_and_small_blocks_change_nothing(spark, monkeypatch):
    texts = made(5, 120, 40)
    docs, items = list(enumerate(texts)), list(enumerate(made(6, 12, 40)))
    want = brute(docs, items, 4)
    monkeypatch.setattr(lexical, "CHUNK_TERMS", 100)
    assert found(spark, docs, items, 4) == want


def test_accumulators_stop_and_survivors_stay_exact():
    """A block of documents of which most hold only the frequent term: no accumulator is made for them once rare terms set the bar."""
    n = 500
    tf = np.ones(n + 4, np.int64)
    row = np.concatenate([np.arange(n), [0, 1, 2, 3]])
    term = np.concatenate([np.zeros(n, np.int64), [1, 1, 1, 1]])
    lengths = np.full(n, 10)
    df = np.array([n, 4])
    best = lexical.impacts(np.ones(2, np.int64), np.array([10, 10]), n, 10 * n)
    walk = lexical.walk_of([(9, [0, 1])], df, best, n, 10 * n)
    assert walk.term.tolist() == [1, 0] and walk.rest[0] > walk.rest[1]
    block = lexical.BlockIndex((np.arange(n), np.ones(n, bool), row, term, tf, lengths), walk)
    rows, score = block.walk(walk, 0, 3)
    assert rows.tolist() == [0, 1, 2, 3]
    w = [lexical.term_weight(int(d), n) for d in df]
    assert set(score.tolist()) == {(w[0] + w[1]) * int(best[0])}
    everything, _ = block.walk(walk, 0, 5)  # four documents do not fill five places: all get accumulators
    assert len(everything) == (n if w[0] else 4)


def test_any_partitioning_gives_the_same(spark):
    docs, items = frame(spark, list(enumerate(made(8, 150, 60)))), items_of(spark, list(enumerate(made(9, 10, 60))))
    one = lexical.lexical_search(docs.coalesce(1), items, 5).collect()
    many = lexical.lexical_search(docs.repartition(9, F.rand(3)), items, 5).collect()
    assert sorted(map(tuple, one)) == sorted(map(tuple, many))
