import random
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from pairscape.llm import queries, ring

KIND = "doc_id long, text string, shard string, row string, arc int"


def rows_of(n, seed=0):
    r = random.Random(seed)
    return [(i, " ".join(r.choice("abcdefgh") * r.randint(1, 9) for _ in range(r.randint(0, 30))), "x", "y", 7) for i in range(n)]


def test_balance_slots_and_sizes(spark):
    rows = rows_of(1003) + [(None, None, "x", "y", 1), (5, "", None, None, None), (5, "", None, None, None), (6, "é\n", None, None, 0)]
    got = ring.ring_shards(spark.createDataFrame(rows, KIND), 8).collect()
    assert Counter(r.doc_id for r in got) == Counter(r[0] for r in rows)
    counts = Counter(r.shard for r in got)
    assert set(counts) == set(range(8)) and max(counts.values()) - min(counts.values()) <= 1
    for s in counts:
        assert sorted(r.slot for r in got if r.shard == s) == list(range(counts[s]))
    texts = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, *_ in rows)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == texts


def test_a_third_of_equal_texts_overflows_clockwise(spark):
    rows = rows_of(600) + [(10_000 + i, "the same text", "", "", 0) for i in range(300)]
    docs = spark.createDataFrame(rows, KIND)
    got = ring.ring_shards(docs, 8).collect()
    counts = Counter(r.shard for r in got)
    assert max(counts.values()) - min(counts.values()) <= 1
    copies = Counter(r.shard for r in got if r.doc_id >= 10_000)
    arcs = ring.ring(8)
    cell = zlib.crc32(b"the same text") >> 20
    home = next((s for last, s in arcs if last >= cell), arcs[0][1])
    # the home shard takes what its bound allows, the rest what room the shards on the way have
    assert copies[home] and sum(copies.values()) == 300
    assert ring.fill([s for _, s in arcs], [0] * len(arcs), [3] * 8) == []


def test_equals_one_by_one_placing(spark):
    rows = rows_of(700, 3) + [(20_000 + i, "again", "", "", 0) for i in range(90)]
    got = {r.doc_id: (r.shard, r.slot) for r in ring.ring_shards(spark.createDataFrame(rows, KIND), 5, nodes=16).collect()}
    arcs = ring.ring(5, 16)
    of_arc = {}
    for i, text, *_ in rows:
        cell = zlib.crc32(text.encode()) >> 20
        arc = next((k for k, (last, _) in enumerate(arcs) if last >= cell), 0)
        of_arc.setdefault(arc, []).append((zlib.crc32(str(i).encode()), i))
    bound, inside, waiting = ring.bounds(len(rows), 5), {s: [] for s in range(5)}, []
    late = {}
    for arc, (_, shard) in enumerate(arcs):
        for rank, (_, i) in enumerate(sorted(of_arc.get(arc, []))):
            if len(inside[shard]) < bound[shard]:
                inside[shard].append((arc, rank, i))
            else:
                late.setdefault(arc, []).append((arc, rank, i))
    for turn in range(2):
        for arc, (_, shard) in enumerate(arcs):
            waiting += late.get(arc, []) if turn == 0 else []
            while waiting and len(inside[shard]) < bound[shard]:
                inside[shard].append(waiting.pop(0))
    assert not waiting
    want = {i: (s, slot) for s, held in inside.items() for slot, (_, _, i) in enumerate(sorted(held))}
    assert got == want


def test_bounded_loads_limit_movement(spark):
    docs = spark.createDataFrame(rows_of(3000, 5), KIND)

    def moved(slack):
        before = {r.doc_id: r.shard for r in ring.ring_shards(docs, 8, slack=slack).collect()}
        after = {r.doc_id: r.shard for r in ring.ring_shards(docs, 9, slack=slack).collect()}
        assert max(Counter(after.values()).values()) <= -(-3000 * (1 + slack) // 9)
        return sum(before[i] != after[i] for i in before) / len(before)

    # a ninth has to move; a modulus would move eight ninths
    assert moved(0.25) < 0.3 and moved(0.0) < 0.45


def test_any_order_and_partitioning_give_the_same(spark):
    docs = spark.createDataFrame(rows_of(400, 8), KIND)
    one = ring.ring_shards(docs.coalesce(1)).collect()
    many = ring.ring_shards(docs.repartition(7, F.rand(1))).collect()
    assert sorted(map(tuple, one)) == sorted(map(tuple, many))


def test_empty_and_fewer_rows_than_shards(spark):
    assert ring.ring_shards(spark.createDataFrame([], KIND)).count() == 0
    few = ring.ring_shards(spark.createDataFrame(rows_of(3), KIND)).collect()
    assert len({r.shard for r in few}) == 3 and {r.slot for r in few} == {0}


def test_written_folders_hold_all_columns(spark, tmp_path):
    ring.write_shards(spark.createDataFrame(rows_of(100), KIND), str(tmp_path / "out"), 4)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(tuple(r) for r in back.select("row.*").collect()) == sorted(rows_of(100))
    assert {p.name for p in (tmp_path / "out").iterdir() if p.is_dir()} == {f"shard={i}" for i in range(4)}


@pytest.mark.parametrize("name", ["op11_ring_sharding"])
def test_main_path_has_no_python(spark, tmp_path, name):
    spark.createDataFrame(rows_of(20), KIND).write.parquet(str(tmp_path / "documents.parquet"))
    df = queries.QUERIES[name](spark, str(tmp_path))
    plan = df._jdf.queryExecution().executedPlan().toString()
    for word in ("Python", "Pandas", "Arrow", "ExistingRDD", "CartesianProduct", "BroadcastNestedLoop"):
        assert word not in plan
    assert {r.law for r in df.collect()} == {"rows"} and {r.grown_shard for r in df.collect()} == {None}
