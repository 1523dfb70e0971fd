"""Contexts across words in the scores of context mixing."""

import collections
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairscape.llm import mixing

KIND = "doc_id long, text string, train boolean"


def prose(rng, n):
    """Words that each have two words they like to be followed by."""
    words = [f"w{i}" for i in range(60)]
    out = [rng.choice(words)]
    for _ in range(n):
        i = int(out[-1][1:])
        out.append(words[(7 * i + rng.choice((1, 2))) % 60] if rng.random() < 0.8 else rng.choice(words))
    return out


def test_order_of_words_and_documents_that_come_twice_are_told(spark):
    rng = random.Random(1)
    train = [prose(rng, 120) for _ in range(120)]
    held = [prose(rng, 120) for _ in range(20)]
    shuffled = [rng.sample(d, len(d)) for d in held]
    odd = [[f"x{rng.randrange(30)}" for _ in range(90)] for _ in range(8)]  # no order to learn, the last four come twice
    docs = [*train, *odd, *odd[4:]]
    rows = [(i, " ".join(d), True) for i, d in enumerate(docs)]
    rows += [(1000 + i, " ".join(d), False) for i, d in enumerate(held)] + [(2000 + i, " ".join(d), False) for i, d in enumerate(shuffled)]
    got = {r.doc_id: r for r in mixing.score_documents(spark.createDataFrame(rows, KIND).repartition(3)).collect()}
    assert len(got) == len(rows)
    for i in range(len(held)):
        assert got[1000 + i].base_score == pytest.approx(got[2000 + i].base_score)
        assert got[1000 + i].score > got[2000 + i].score + 20 and got[1000 + i].score > got[1000 + i].base_score
    once, twice = ([got[120 + k].bits_per_byte for k in some] for some in (range(4), (*range(4, 8), *range(8, 12))))
    assert max(twice) < 0.7 * min(once)


def test_counts_of_pairs_are_those_of_the_corpus(spark, monkeypatch):
    """Exact over blocks; the shares of all that follows a context are 1; a training token's own occurrence is left out."""
    monkeypatch.setattr(mixing, "BLOCK_CHARS", 200)
    rng = random.Random(2)
    docs = [(i, rng.choice(["", " ".join(rng.choice("abc") for _ in range(rng.randrange(40)))]), i % 4 > 0) for i in range(60)]
    blocks = mixing.blocks_of(spark.createDataFrame(docs, KIND).repartition(2))
    assert blocks.count() > 3
    columns = ("words", "counts", "lengths", "tokens", "train")
    found = mixing.corpus_counts(blocks, mixing.pair_keys, columns, mixing.PAIR_BITS, 1000)
    answers = found.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("bucket", "counts"))).alias("a"))
    want = collections.Counter()
    for _, text, train in docs:
        words = ["<", *text.split(), "END"]
        want.update({} if not train else collections.Counter(zip(words, words[1:])))
    texts = {i: (t, train) for i, t, train in docs}
    ends = sum(train for *_, train in docs)
    totals = collections.defaultdict(dict)
    for r in blocks.join(answers, "block").collect():
        words = mixing.unpacked(r.words, r.counts)[0]
        some = mixing.stream_of(len(words), r.lengths, r.tokens, r.train)
        _, at = np.unique(mixing.pairs_of(some, words), return_inverse=True)
        pairs = mixing._counts_of(r.a)[at]
        names = [*[w.decode() for w in words], "END"]
        whole = np.array([sum(t.split().count(w) for t, train in texts.values() if train) for w in names[:-1]] + [ends])
        gate, shares = mixing.context_shares(some, whole, pairs, ends)
        spot = 0
        for doc in r.doc_ids:
            text, train = texts[doc]
            doc_words = ["<", *text.split(), "END"]
            for i in range(1, len(doc_words)):
                pair = tuple(doc_words[i - 1 : i + 1])
                assert names[some.tokens[spot]] == doc_words[i] and some.train[spot] == train
                assert pairs[spot] == want[pair]
                seen = sum(n for k, n in want.items() if k[0] == pair[0])
                assert shares[spot] == pytest.approx(max(want[pair] - train, 0) / max(seen - train, 1))
                if not train:
                    totals[pair[0]][pair[1]] = shares[spot]
                spot += 1
        assert spot == len(some.tokens) and gate.max() < mixing.SEEN
    full = {c for c in totals if len(totals[c]) == len({k[1] for k, n in want.items() if k[0] == c and n})}
    assert full and all(sum(totals[c].values()) == pytest.approx(1) for c in full)


def test_weights_of_contexts_follow_the_document():
    """Probabilities of a token's alternatives stay a distribution at any state of the weights."""
    n = 320
    trust, told = np.full(n, 0.4), np.full(n, 0.9)
    share, spelled = np.full(n, 0.1), np.full(n, 0.001)
    lengths = np.array([n])
    good = mixing.adaptive_scores(share, spelled, np.log(spelled), lengths, 0.9, trust, told)
    start = mixing.adaptive_scores(share[:32], spelled[:32], np.log(spelled[:32]), np.array([32]), 0.9, trust[:32], told[:32])
    assert good[0] > 10 * start[0]  # later tokens trust the contexts more
    # two words, one of which the context expects: both probabilities add up to one after the same past
    last = []
    for hint in (0.9, 0.1):
        more = mixing.adaptive_scores(np.append(share, 0.5), np.append(spelled, 0.5), np.log(np.append(spelled, 0.5)), np.array([n + 1]), 0.9, np.append(trust, 0.4), np.append(told, hint))
        last.append(10 ** (more[0] - good[0]))
    assert sum(last) == pytest.approx(1)
