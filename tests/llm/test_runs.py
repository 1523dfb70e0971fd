import hashlib
import random
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pairscape.llm import queries, runs


def brute(words, least, periods):
    """Runs from all periods by comparing words; the smallest period of a stretch counts."""
    n, found = len(words), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j + q - i >= 2 * q:
                found.setdefault((i, j + q), q)
            i = j + 1
    return sorted((s, e - s, q) for (s, e), q in found.items() if e - s >= max(least, periods * q))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=40), min_size=1, max_size=4), st.sampled_from([(24, 3), (2, 2), (6, 2), (9, 3)]))
def test_small_alphabets_against_brute_force(documents, limits):
    words = [[b"w%d" % x for x in d] for d in documents]
    assert runs.document_runs(words, *limits) == [brute(w, *limits) for w in words]


def test_periodic_documents_against_brute_force():
    r, documents = random.Random(4), []
    for _ in range(150):
        words = [b"w%d" % r.randrange(r.choice([2, 4, 50])) for _ in range(r.randint(0, 160))]
        for _ in range(r.randint(0, 3)):
            if len(words) > 30:
                a, p = r.randrange(len(words) - 20), r.randint(1, 12)
                b = r.randint(a, len(words))
                words[a:b] = [words[a + (i - a) % p] for i in range(a, b)]
        documents.append(words)
    for limits in ((24, 3), (4, 2)):
        assert runs.document_runs(documents, *limits) == [brute(w, *limits) for w in documents]


def test_fibonacci_words_hold_many_overlapping_runs():
    a, b = [b"a"], [b"a", b"b"]
    while len(b) < 400:
        a, b = b, b + a
    assert runs.document_runs([b, a], 2, 2) == [brute(b, 2, 2), brute(a, 2, 2)]
    assert runs.document_runs([b], 24, 3)[0] == brute(b, 24, 3)


def test_suffix_array_and_lcp():
    r = random.Random(2)
    for _ in range(60):
        codes = [r.randrange(3) for _ in range(r.randint(1, 40))]
        sa, isa, lcp = runs.suffix_array(runs.np.array(codes))
        assert sa.tolist() == sorted(range(len(codes)), key=lambda i: codes[i:])
        assert isa[sa].tolist() == list(range(len(codes)))
        for k in range(1, len(codes)):
            x, y = codes[sa[k - 1]:], codes[sa[k]:]
            same = next((i for i, (p, q) in enumerate(zip(x, y)) if p != q), min(len(x), len(y)))
            assert lcp[k] == same


def test_best_run_and_collapsed_text():
    assert runs.best_run([]) is None
    assert runs.best_run([(0, 24, 8), (30, 48, 16), (90, 25, 8)]) == (90, 25, 8)
    assert runs.best_run([(0, 30, 10), (5, 24, 8)]) == (0, 30, 10)
    words = [b"%d" % i for i in range(10)]
    assert runs.collapsed(words, [(2, 6, 2), (5, 4, 1)]) == [b"0", b"1", b"2", b"3", b"9"]


KIND = "doc_id long, text string, runs string, best int, start long, collapsed string"


def test_edge_cases(spark):
    line = "one two three four five six "
    rows = [(1, None), (2, ""), (3, " \t\n"), (None, line * 5), (4, line * 5), (4, line * 5), (5, "word"), (6, "x " * 30_000 + "y " * 3), (7, line * 4), (8, line * 3)]
    docs = spark.createDataFrame([(i, t, "r", 1, 2, "c") for i, t in rows], KIND)
    got = sorted(runs.periodic_runs(docs).collect(), key=lambda r: (r.doc_id or 0, r.n_words))
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
    assert len(got) == len(rows) and len(by[4]) == 2 and by[4][0] == by[4][1]
    for i in (1, 2, 3):
        assert (by[i][0].n_words, by[i][0].runs, by[i][0].best, by[i][0].collapsed) == (0, [], None, "")
    assert tuple(by[None][0].best) == tuple(by[4][0].best) == (0, 30, 6) and by[4][0].collapsed == line.strip()
    assert by[5][0].runs == [] and by[5][0].collapsed == "word"
    assert tuple(by[6][0].best) == (0, 30_000, 1) and by[6][0].collapsed == "x y y y"
    assert tuple(by[7][0].best) == (0, 24, 6) and by[8][0].runs == []
    assert runs.periodic_runs(docs.limit(0)).count() == 0


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_query_against_its_definition(spark, tmp_path):
    r, rows = random.Random(9), []
    for i in range(260):
        n = r.choice([0, 1, 40, 90, 200, 300])
        rows.append((i * 7 + 1, "".join(f"w{r.randrange(30)}" + r.choice([" ", "\n", "\t "]) for _ in range(n))))
    rows += [(900, None), (901, "a b " * 20)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {x.doc_id: x for x in queries.op12_periodic_runs(spark, str(tmp_path)).collect()}
    some = 0
    for i, text in rows:
        words = (text or "").split()
        h = zlib.crc32(str(i).encode())
        g, n = h // 10, len(words)
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[k] if k < a else words[a + (k - a) % p] for k in range(n)]
        want = brute(words, 24, 3)
        some += bool(want)
        gone = {k for s, m, q in want for k in range(s + q, s + m)}
        best = min(want, key=lambda x: (-x[1] / x[2], x[0], x[2])) if want else (None, None, None)
        x = got[i]
        assert (x.n_runs, x.start, x.length, x.period) == (len(want), *best)
        assert x.exponent_milli == (1000 * best[1] // best[2] if want else None)
        assert x.runs_sha256 == digest("".join(f"{s},{m},{q}\n" for s, m, q in want))
        assert x.collapsed_sha256 == digest(" ".join(w for k, w in enumerate(words) if k not in gone))
    assert some >= 5


@pytest.mark.parametrize("doc_id", [None, 3])
def test_planting_needs_an_id_and_words(doc_id):
    assert runs.planted(doc_id, []) == [] and runs.planted(None, [b"a"]) == [b"a"]
