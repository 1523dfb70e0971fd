"""Repeated spans against the sequences of words that were seen before."""

import re

import numpy as np

from pairscape.llm import substrings


def test_spans_hold_only_sequences_seen_before(spark):
    rng = np.random.default_rng(3)
    short = [" ".join(f"w{x}" for x in rng.integers(0, 400, int(rng.integers(1, 4)))) + "." for _ in range(60)]
    passage = " ".join(f"p{x}" for x in rng.integers(0, 400, 40)) + "."
    docs = []
    for i in range(80):
        parts = [short[x] for x in rng.integers(0, 60, 30)]
        docs.append((i, " ".join(parts[:15] + ([passage] if i % 8 == 0 else []) + parts[15:])))
    n, seen, may = substrings.MIN_WORDS, set(), {}
    for i, text in docs:
        w = [x.strip(".") for x in text.split()]
        rows = [tuple(w[a : a + n]) for a in range(len(w) - n + 1)]
        old, first = np.zeros(len(w), bool), {}
        for a, x in enumerate(rows):
            if x in seen or first.setdefault(x, a) < a:
                old[a : a + n] = True
        seen.update(rows)
        may[i] = old
    removed = 0
    for r in substrings.repeated_spans(spark.createDataFrame(docs, "doc_id long, text string")).collect():
        text = docs[r.doc_id][1]
        a, b = len(text[: r.start].split()), len(text[: r.stop].split())
        assert may[r.doc_id][a:b].all() and b - a == r.n_words >= n
        removed += sum(x.startswith("p") for x in text[r.start : r.stop].split())
    assert removed == 9 * 40


def test_run_of_one_word_keeps_its_first_words(spark):
    cut = next(w for w in map("v{}".format, range(100)) if substrings.Marks()[w] & 1)
    text = " ".join([cut] * 50)
    (r,) = substrings.repeated_spans(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert (len(text[: r.start].split()), r.n_words, r.first_doc_id) == (8, 42, 1)


def test_words_of_several_texts_are_found_and_marked_once():
    """Words, their places and the units of each text as a plain split gives them; a word that texts share is looked up once."""
    asked = []

    class Counted(substrings.Marks):
        def __getitem__(self, word):
            asked.append(word)
            return super().__getitem__(word)

    texts = ["a  bb. c\n\n d\x1ce", None, "", " \n", "é　a 𝒳 \x85bb.\n"]
    u = substrings.units(texts, Counted())
    plain = [[(w, m.start(), m.end()) for m in re.finditer(r"\S+", t or "") for w in [m.group()]] for t in texts]
    flat = [x for p in plain for x in p]
    assert sorted(asked) == sorted({w for w, _, _ in flat})
    assert list(zip(*(s.tolist() for s in u.spans), strict=True)) == [(a, b) for _, a, b in flat]
    assert u.bounds.tolist() == np.cumsum([0, *map(len, plain)]).tolist()
    for i, t in enumerate(texts):
        alone = substrings.units([t], substrings.Marks())
        mine = slice(u.bounds[i], u.bounds[i + 1])
        assert u.hashes[mine].tolist() == alone.hashes.tolist()
        assert (u.starts[:-1][u.text == i] - u.bounds[i]).tolist() == alone.starts[:-1].tolist()


def test_only_a_piece_of_a_batch_is_python_text_at_a_time():
    import tracemalloc

    import pyarrow as pa

    from pairscape.llm.common import runs, text_batches

    texts = [None, "", "é" * 70_000, *[f"{i} " + "word " * 2000 for i in range(3000)], "x" * 300_000, "end"]
    batch = pa.RecordBatch.from_pydict({"n": pa.array(range(len(texts))), "text": pa.array(texts)})
    want = [(a, b) for a, b in runs(texts, 100_000)]
    tracemalloc.start()
    try:
        got, held = [], 0
        for piece, some in text_batches([batch], 100_000):
            first = piece.column("n")[0].as_py()
            assert some == texts[first : first + piece.num_rows]
            got.append((first, first + piece.num_rows))
            held = max(held, tracemalloc.get_traced_memory()[0])
    finally:
        tracemalloc.stop()
    assert got == want and held < 2_000_000


def test_a_worker_drops_the_encoder_when_it_goes_to_another_operator():
    import pyarrow as pa

    from pairscape.llm import bpe, common

    batch = pa.RecordBatch.from_pydict({"text": ["a word", None]})
    held = bpe._loaded(bpe.WORD_BPE)
    assert [t for _, t in common.text_batches([batch], keeping=True)] == [["a word", None]]
    assert bpe._loaded(bpe.WORD_BPE) is held
    assert len([*common.text_batches([batch])]) == 1
    assert bpe._loaded(bpe.WORD_BPE) is not held
    common.kept_dropped()


def test_logits_of_slots_follow_the_plain_formula():
    import numpy as np

    from pairscape.llm import mixing

    rng = np.random.default_rng(3)
    counts = (rng.poisson(0.8, (mixing.OFFSETS[-1], 2)) * rng.integers(1, 90, (mixing.OFFSETS[-1], 1))).astype(np.float32)
    slots = [rng.integers(mixing.OFFSETS[k], mixing.OFFSETS[k + 1], 5000) for k in range(mixing.PREDICTORS)]
    bit, own = rng.integers(0, 2, 5000).astype(np.int8), rng.integers(0, 5, 5000).astype(np.float32)
    added = np.float32(mixing.ADDED)
    for mine, (x, gate) in ((np.zeros(5000, np.float32), mixing.looked_up(slots, *mixing.slot_values(counts))), (own, mixing.inputs(slots, counts, own, bit))):
        left = [[np.maximum(counts[s, v] - np.where(bit == v, mine, 0), 0) for v in (0, 1)] for s in slots]
        assert all(np.array_equal(x[:, k], np.clip(np.log((one + added) / (zero + added)), -12, 12)) for k, (zero, one) in enumerate(left))
        level = [(z + o > 0) * 1 + (z + o > 7) + (z + o > 127) for z, o in left]
        assert np.array_equal(gate, 4 * level[-2] + level[-1]) and (x[:, -1] == 1).all()
