"""Top-k against brute force where the refinement needs several rounds."""

import numpy as np
import pytest

from pairscape.llm import topk


def _near_copies(rng):
    groups = rng.normal(size=(4, 16))
    v = np.repeat(groups, 500, axis=0) + rng.normal(scale=0.01, size=(2000, 16))
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def _one_long(rng):
    v = rng.normal(size=(2000, 16))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    v[7] *= 30
    return v


@pytest.mark.parametrize("made", [_near_copies, _one_long])
def test_top_k_matches_brute_force_over_several_rounds(spark, made):
    v = made(np.random.default_rng(5))
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<double>").repartition(4)
    asked = list(range(0, 2000, 20))
    got = {}
    for r in topk.top_k(rows, rows.where("vec_id % 20 = 0")).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    whole = np.floor(256 * v).astype(np.int64)
    for q in asked:
        scores = whole @ whole[q]
        best = sorted((i for i in range(len(v)) if i != q), key=lambda i: (-scores[i], i))[:5]
        assert sorted(got[q]) == [(n + 1, i, scores[i]) for n, i in enumerate(best)]
