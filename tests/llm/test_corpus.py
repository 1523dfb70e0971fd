"""The corpus operators against brute force, exact round trips, held-out accuracy and odd rows."""

import collections
import hashlib
import itertools
import math
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from pairscape.llm import bpe, decontaminate, jaccard, language, mixing, quality, sitetree, substrings, tokenfiles, topk

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
SMALL = "/root/testdata/sf0.001"
TOKENIZER = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def words(n, seed):
    rng = np.random.default_rng(seed)
    return [f"w{int(x)}" for x in rng.integers(0, 5000, n)]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty, white, one-word and long texts, repeated rows and ids; with columns whose names operators use themselves."""
    base = " ".join(words(60, 1))
    rows = [
        (1, base), (2, base), (3, base + " x"), (3, base + " x"), (4, None), (5, ""), (6, " \n\t "), (7, "one"), (8, "One"), (None, "orphan text of five words here"),
        (9, " ".join(words(60, 2))), (10, " ".join(words(20_000, 3))), (11, "á é ñ <|endoftext|> 日本 ΣΊΣΥΦΟΣ\x1cx"),
    ]
    df = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], DOCS)
    return df.withColumns({"score": F.lit(1), "root": F.lit("r"), "text_hash": F.lit(0), "row": F.lit(7)})


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def shingles(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute_components(rows):
    sets, up = {i: shingles(t) for i, t in rows}, {i: i for i, _ in rows}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in itertools.combinations(sorted(up), 2):
        if sets[a] and sets[b] and 100 * (k := len(sets[a] & sets[b])) >= 75 * (len(sets[a]) + len(sets[b]) - k):
            x, y = top(a), top(b)
            up[max(x, y)] = min(x, y)
    return {(i, len(sets[i]), top(i)) for i in up}


def test_jaccard_brute_force(spark):
    rows, rng = [], np.random.default_rng(5)
    for g in range(12):
        text = words(int(rng.integers(4, 90)), g)
        for _ in range(int(rng.integers(1, 8))):
            other = list(text)
            for p in rng.integers(0, len(other), int(rng.integers(0, 4))):
                other[p] = f"z{int(rng.integers(1000))}"
            rows.append((len(rows), " ".join(other)))
    got = jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {tuple(r) for r in got.select("doc_id", "n_shingles", "component_id").collect()} == brute_components(rows)


def test_jaccard_odd_rows(odd, empty):
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in jaccard.jaccard_components(odd).collect()}
    assert {(1, 56, 1), (2, 56, 1), (3, 57, 1), (4, 0, 4), (5, 0, 5), (6, 0, 6), (7, 1, 7), (8, 1, 7), (None, 2, None)} <= got
    assert jaccard.jaccard_components(empty).count() == 0


def test_prefix_matches():
    classes = np.zeros(jaccard.SKETCH, np.uint8)
    for n in (1, 2, 5, 19, 20, 400):
        m, p = jaccard.prefix(np.arange(n, dtype=np.uint64), classes)
        assert m >= jaccard.least_matches(n) or n < 4
        assert len(p) == n - math.ceil(0.75 * n) + m <= n


def test_spans_offsets(spark, odd, empty):
    passage = " ".join(words(40, 8)) + ". " + " ".join(words(20, 9)) + "."
    rows = [(1, "Start here. " + passage), (2, "Other start, no stop " + passage + " And an end."), (3, "Nothing in common with the rest of them."), (4, "LINE of eight words stands here two times.\nLine of eight words  stands here two times!")]
    found = substrings.repeated_spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    spans = {r.doc_id: (r.start, r.stop, r.first_doc_id) for r in found}
    assert set(spans) == {2, 4} and spans[2][2] == 1
    cut = rows[1][1][spans[2][0] : spans[2][1]]
    assert cut in passage and len(cut.split()) >= 45
    assert rows[3][1][spans[4][0] : spans[4][1]] == "Line of eight words  stands here two times!"
    kept = {r.doc_id: r.text for r in substrings.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert kept[1] == rows[0][1] and kept[3] == rows[2][1] and cut not in kept[2]
    out = substrings.remove_repeats(odd)
    assert out.columns == odd.columns and out.count() == odd.count()
    assert substrings.repeated_spans(empty).count() == 0


def distance(item, text):
    row = [0] * (len(text) + 1)
    for i, w in enumerate(item, 1):
        new = [i]
        for j, t in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (w != t)))
        row = new
    return min(row)


def test_decontamination_brute_force(spark, odd, empty):
    rng = np.random.default_rng(2)
    items = [(i, " ".join(words(int(rng.integers(10, 60)), 100 + i))) for i in range(20)] + [(50, None), (51, ""), (52, "too short")]
    docs = []
    for i in range(120):
        item = items[int(rng.integers(20))][1].split()
        for _ in range(int(rng.integers(0, 1 + int(0.3 * len(item))))):
            p, kind = int(rng.integers(len(item))), int(rng.integers(3))
            item[p : p + (kind != 1)] = [] if kind == 0 else ["new"]
        docs.append((i, " ".join([*words(int(rng.integers(30)), 500 + i), *item, *words(int(rng.integers(30)), 900 + i)])))
    want = {(d, i, k) for d, t in docs for i, x in items if x and len(x.split()) >= 8 for k in [distance(x.split(), t.split())] if k <= int(0.2 * len(x.split()))}
    schema = "item_id long, text string"
    got = decontaminate.contaminations(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, schema))
    got = {(r.doc_id, r.item_id, r.distance) for r in got.collect()}
    assert got <= want and len(got) >= 0.97 * len(want) and len(want) > 60
    assert decontaminate.contaminations(odd, spark.createDataFrame([], schema)).count() == 0
    assert decontaminate.contaminations(empty, spark.createDataFrame(items, schema)).count() == 0


def test_bpe_equals_library(odd, empty):
    texts = {r.doc_id: r.text or "" for r in odd.collect() if r.doc_id is not None}
    for r in bpe.bpe_roundtrip(odd).collect():
        if r.doc_id is not None:
            ids = TOKENIZER.encode(texts[r.doc_id], add_special_tokens=False).ids
            assert r.ids == ids and r.decoded == TOKENIZER.decode(ids, skip_special_tokens=False)
    assert bpe.bpe_roundtrip(empty).count() == 0


def test_forced_boundaries_cut_no_token():
    coder = bpe.ForcedBoundaryBPE(public_tokenizers.path("word_bpe_49k.json"))
    assert " " in coder.cut(["qjxzvkqqzj"])[0]
    for word in ("hello", "ththisting", "qjxzvkqqzj", "a"):
        assert coder.cut([word])[0].replace(" ", "") == word
        assert np.frombuffer(coder.encode_words([word])[0], np.int32).tolist() == TOKENIZER.encode(word, add_special_tokens=False).ids


def test_rank_coding():
    rng = np.random.default_rng(0)
    for n in (0, 1, 3, 4, 1001):
        ranks = rng.integers(0, [1, 300, 70_000, 1 << 31][n % 4], n).astype(np.uint32)
        control, data = tokenfiles.pack_ranks(ranks)
        assert (tokenfiles.unpack_ranks(np.frombuffer(control, np.uint8), np.frombuffer(data, np.uint8), n) == ranks).all()


def test_token_files(odd, empty, tmp_path):
    tokenfiles.write_token_files(odd, f"file://{tmp_path}/t", shard_tokens=3000)
    got = {(r.doc_id, r.n_tokens, r.ids_crc32) for r in tokenfiles.read_token_files(odd.sparkSession, f"file://{tmp_path}/t").collect()}
    want = set()
    for r in odd.collect():
        ids = [*TOKENIZER.encode(r.text or "", add_special_tokens=False).ids, 2]
        want.add((r.doc_id, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    assert got == want
    assert tokenfiles.token_file_index(empty).count() == 0


def test_topk_ties_and_odd_vectors(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.normal(size=6)]) for i in range(0, 120)] + [(i, [0.5] * 6) for i in range(200, 300)]
    odd_rows = [(301, None), (302, [1.0, None, 0, 0, 0, 0]), (303, [float("nan")] * 6), (304, [float("inf")] * 6), (None, [1.0] * 6), (250, [0.5] * 6)]
    df = spark.createDataFrame(rows + [(i, None if v is None else [None if x is None else float(x) for x in v]) for i, v in odd_rows], "vec_id long, embedding array<double>")
    good = [(i, np.floor(256 * np.array(v)).astype(int)) for i, v in rows] + [(250, np.full(6, 128))]
    got = collections.defaultdict(list)
    for r in topk.top_k(df, df.where("vec_id % 50 = 0")).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    vectors = dict(good)
    assert set(got) == {0, 50, 100, 200, 250}
    for q, found in got.items():
        want = sorted(((int(vectors[q] @ v), -i) for i, v in good if i != q), reverse=True)[:5]
        assert found == [(-i, s) for s, i in want]
    assert topk.top_k(df.limit(0), df).count() == 0


def test_quality_and_language(spark, odd, empty):
    docs, labels = spark.read.parquet(f"{SMALL}/documents.parquet"), spark.read.parquet(f"{SMALL}/labels.parquet")
    model = quality.fit_from_labels(docs, labels)
    scored = {r.doc_id: r.score for r in quality.score_quality(docs, model).collect()}
    good = [r for r in labels.collect() if r.quality == 1]
    assert np.mean([scored[r.doc_id] >= quality.THRESHOLD for r in good]) > 0.95
    assert all(0 <= r.score <= 1 for r in quality.score_quality(odd.drop("score"), model).collect())
    assert quality.fit_from_labels(empty, labels).constant is not None
    lang = language.fit_language(language.training_rows(docs))
    got = language.predict_language(docs, lang).collect()
    assert np.mean([r.lang == r.lang_pred for r in got if zlib.crc32(str(r.doc_id).encode()) % 3 == 1]) > 0.9
    strange = {r.doc_id: r.lang_pred for r in language.predict_language(odd.drop("score"), lang).collect()}
    assert strange[4] == strange[5] == strange[6] == "und" != strange[7]
    assert language.fit_language(language.training_rows(empty)) is None


PAGE = """<html><head><title>T</title><script>var a = "<p>no</p>";</script></head><body><nav><ul><li><a>Menu</a></ul></nav>
<div class="x">Join us today</div><div class=body><p>First {n} &amp; more<br>lines<p>Second {n}</div><form>f<input></form>
<div class="ad-box">Buy</div><section id="comments"><p>c</section><footer>F</footer></body></html>"""


def test_site_tree(spark):
    pages = [(i, f"http://a.example/{i}", PAGE.format(n=i)) for i in range(12)] + [(20, "http://b.example/", PAGE.format(n=20)), (21, None, None), (22, "x", "")]
    got = {r.page_id: r.text for r in sitetree.main_text(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got[3] == "First 3 & more lines\n\nSecond 3"
    assert got[20] == "Join us today\n\nFirst 20 & more lines\n\nSecond 20"  # one page says nothing about its site
    assert got[21] == got[22] == ""


def test_mixing_base_and_codes(odd, empty):
    got = mixing.score_documents(odd.withColumn("train", F.col("doc_id") != 9)).collect()
    counts = collections.Counter()
    for r in odd.collect():
        if r.doc_id is not None and r.doc_id != 9:
            counts.update([*(r.text or "").encode().lower().split(), b"\n"])
    total, distinct = sum(counts.values()), len(counts)
    texts = {r.doc_id: r.text for r in odd.collect()}
    for r in got:
        tokens = [*(texts[r.doc_id] or "").encode().lower().split(), b"\n"]
        base = sum(math.log10((counts[t] + 0.1) / (total + 0.1 * (distinct + 1))) for t in tokens)
        assert r.train_tokens == total and r.n_tokens == len(tokens) and r.n_known == sum(counts[t] > 0 for t in tokens)
        assert r.base_score == pytest.approx(base) and r.score < 0
    assert mixing.score_documents(empty.withColumn("train", F.lit(True))).count() == 0
    codes = mixing.code_trees(np.zeros(65536, np.uint64))
    assert sum(2.0 ** -int(codes.length[65 * 256 + s]) for s in range(256)) == 1.0


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    model = quality.fit_from_labels(docs, spark.read.parquet(f"{SMALL}/labels.parquet"))
    kept = {r.doc_id for r in quality.score_quality(docs, model).where(F.col("score") >= quality.THRESHOLD).collect()}
    stage = docs
    for name, f in corpus_pipeline.STAGES[:4]:
        out = f(spark, stage, SMALL).cache()
        assert out.columns == docs.columns, name
        ids = {r.doc_id for r in out.collect()}
        if name == "quality":
            assert ids == kept
        if name == "near_duplicates":
            rows = [(r.doc_id, r.text) for r in stage.collect()]
            assert ids == {i for i, _, c in brute_components(rows) if i == c}
        if name == "substrings":
            assert all(r.n_chars == len(r.text) for r in out.collect())
        stage = out
    tokens = {r.doc_id: r for r in corpus_pipeline.token_stage(spark, stage, SMALL).collect()}
    for r in stage.limit(20).collect():
        ids = TOKENIZER.encode(r.text, add_special_tokens=False).ids
        assert tokens[r.doc_id].ids == ids
        assert tokens[r.doc_id].decoded_sha256 == hashlib.sha256(TOKENIZER.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_words_by_kinds_are_those_of_the_pattern():
    """Words, ids and the number of look-ups for texts with endings, signs, numbers and odd white space."""
    coder = bpe.ForcedBoundaryBPE(bpe.public_tokenizers.path(bpe.WORD_BPE))
    every = [chr(i) for i in range(0x250) if not 0x1C <= i <= 0x1F]
    texts = ["", "don't  it's'll x--'s 's we'score", "l'été, l'été.\xa0l'été!", "".join(every), "".join(f"a{c}b1{c}'{c}" for c in every), "\x85 ", "İx ȺⱥȾ"]
    low = [t.lower() for t in texts]
    words, ends = coder.split(low)
    assert words.to_pylist() == [w for t in low for w in coder.pattern.findall(t)]
    assert ends.tolist() == np.cumsum([len(coder.pattern.findall(t)) for t in low]).tolist()
    for t, ids in zip(texts, coder.encode_all(texts), strict=True):
        assert ids.tolist() == coder.library.encode(t, add_special_tokens=False).ids
    asked = []
    fresh = bpe.ForcedBoundaryBPE(bpe.public_tokenizers.path(bpe.WORD_BPE))
    plain, fresh.last.function = fresh.last.function, lambda parts: plain(asked.extend(parts) or parts)
    fresh.encode_all(["word, word.", "word!", "(word)"])
    assert len(asked) == len(set(asked)) and asked.count("word") == 1


def test_blocks_hold_their_words_split_and_counted(spark):
    rows = [(1, "B a\tb  c", True), (2, None, True), (3, "c d", False), (4, " ", False)]
    (r,) = mixing.blocks_of(spark.createDataFrame(rows, "doc_id long, text string, train boolean").coalesce(1)).collect()
    words, counts = mixing.unpacked(r.words, r.counts)
    assert dict(zip(words, counts.tolist(), strict=True)) == {b"a": 1, b"b": 2, b"c": 1, b"d": 0} and r.train_docs == 2
    assert (np.diff(mixing.word_hashes(words).astype(object)) > 0).all()
    unpack = mixing.zstandard.ZstdDecompressor().decompress
    tokens, ends = np.frombuffer(unpack(r.tokens), np.int32), np.cumsum(np.frombuffer(unpack(r.lengths), np.int64))
    texts = {d: b" ".join(words[w] for w in p) for d, p in zip(r.doc_ids, np.split(tokens, ends[:-1]), strict=True)}
    assert texts == {1: b"b a b c", 2: b"", 3: b"c d", 4: b""}
