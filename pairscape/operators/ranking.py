"""Ordering inside groups that stays spread out when one group is huge.

A plain ``row_number() over (partition by group)`` puts a whole group into one
task. ``positions`` ranks inside order-preserving sub-buckets of a group and
adds the size of the earlier sub-buckets, so the work of a hot group is shared
while the result is the same exact number.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.numbers import hash_key, not_nan
from ..functions.text import as_col
from ..session import cut_lineage, stored

HASH_PREFIX = 2  # hex digits: 256 sub-buckets per group for hash orders


def positions(
    df: DataFrame,
    group: list[str],
    order: list,
    prefix: list,
    position: str = "position",
    total: str | None = None,
) -> DataFrame:
    """Zero-based position of each row in its group, and the group size if asked.

    ``prefix`` must be order-preserving: sorting by (prefix, order) equals
    sorting by order. Good choices are the leading order columns or the first
    hex digits of a hash. Group and prefix values must not be null. The bucket
    sizes are one partial aggregation; the rows are shuffled once, by
    (group, prefix).
    """
    names = [f"__p{i}" for i in range(len(prefix))]
    keyed = df.withColumns({n: as_col(c) for n, c in zip(names, prefix)})
    bucket = group + names
    counts = keyed.groupBy(*bucket).agg(F.count(F.lit(1)).alias("__n"))
    whole = Window.partitionBy(*group)
    earlier = whole.orderBy(*names).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        *bucket,
        F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__before"),
        F.sum("__n").over(whole).alias("__total"),
    )
    ranked = keyed.withColumn(
        "__rn", F.row_number().over(Window.partitionBy(*bucket).orderBy(*order))
    )
    out = ranked.join(offsets, bucket).withColumn(position, F.col("__before") + F.col("__rn") - 1)
    if total:
        out = out.withColumn(total, F.col("__total"))
    return out.drop(*names, "__rn", "__before", "__total")


def hash_positions(
    df: DataFrame, group: list[str], seed: int, key: str, position: str = "position",
    total: str | None = None,
) -> DataFrame:
    """``positions`` in seeded hash order of ``key``."""
    hashed = df.withColumn("__hash", hash_key(seed, key))
    out = positions(
        hashed, group, ["__hash", key], [F.left("__hash", F.lit(HASH_PREFIX))], position, total
    )
    return out.drop("__hash")


def top_k(df: DataFrame, group: list[str], order: list, k: int, rank: str | None = None) -> DataFrame:
    """First ``k`` rows per group. ``row_number() <= k`` is pushed below the
    shuffle by Spark, so each task sends at most ``k`` rows of a group."""
    name = rank or "__rank"
    out = df.withColumn(name, F.row_number().over(Window.partitionBy(*group).orderBy(*order)))
    out = out.filter(F.col(name) <= k)
    return out if rank else out.drop(name)


def first_by_key(df: DataFrame, key: list[str], order: list) -> DataFrame:
    """One row per non-null key: the first in the stated order."""
    return top_k(df.dropna(subset=key), key, order, 1)


def last_by_key(df: DataFrame, key: list[str], order: list) -> DataFrame:
    """One row per non-null key: the last in the stated order."""
    return first_by_key(df, key, [as_col(c).desc_nulls_last() for c in order])


def unique_ids(df: DataFrame, col: str, order: list) -> DataFrame:
    """Append ``_2``, ``_3``, … to the second, third, … occurrence of an id.

    Ids are meant to be nearly unique: the copies of one id meet in one task.
    """
    rn = F.row_number().over(Window.partitionBy(col).orderBy(*order))
    numbered = df.withColumn("__n", rn)
    renamed = F.when(F.col("__n") > 1, F.concat_ws("_", col, F.col("__n").cast("string")))
    return numbered.withColumn(col, F.coalesce(renamed, F.col(col))).drop("__n")


def even_pick(position: Column, total: Column, keep: Column) -> Column:
    """Is this position one of ``keep`` evenly spread positions out of ``total``?

    The picks are round-half-even(i·(total−1)/(keep−1)). Instead of joining to
    the list of picks, the nearest candidates i of a position are tested.
    """
    p, n, m = position.cast("double"), total.cast("double"), keep.cast("double")
    guess = F.floor(F.try_divide(p * (m - 1), n - 1))

    def hit(i: Column) -> Column:
        target = F.bround(F.try_divide(i * (n - 1), m - 1))
        return (i >= 0) & (i < m) & (target == p)

    picked = hit(guess) | hit(guess + 1) | hit(guess - 1)
    return (
        F.when(total <= keep, F.lit(True))
        .when(keep <= 1, position < keep)
        .otherwise(F.coalesce(picked, F.lit(False)))
    )


def even_sample(
    df: DataFrame, group: list[str], keep, seed: int = 42, key: str = "patch_id",
    crowded: bool = False,
) -> DataFrame:
    """At most ``keep`` rows per group, evenly spread over the (y, x) order.

    Without coordinates the sample is the first ``keep`` in hash order. Rows at
    the same place follow hash order. ``crowded`` says that many rows of a
    group may share a place (groups wider than one pair), which refines the
    sub-buckets of ``positions`` to places and hash digits.
    """
    limit = keep if isinstance(keep, Column) else F.lit(int(keep))
    if not {"x", "y"} <= set(df.columns):
        placed = hash_positions(df, group, seed, key, "__pos", "__size")
        return placed.filter(F.col("__pos") < limit).drop("__pos", "__size")
    hashed = df.withColumn("__h", hash_key(seed, key))
    prefix = ["y", "x", F.left("__h", F.lit(1))] if crowded else ["y"]
    placed = positions(hashed, group, ["y", "x", "__h", key], prefix, "__pos", "__size")
    picked = placed.filter(even_pick(F.col("__pos"), F.col("__size"), limit))
    return picked.drop("__h", "__pos", "__size")


#: Rows of a part of the order in ``slice_rows``, about.
PART_ROWS = 1 << 20


def slice_rows(
    df: DataFrame, order: str, start: int = 0, end: int | None = None, limit: int | None = None
) -> DataFrame:
    """Rows ``start`` … ``end`` − 1 of the order by one unique column of any type, at most ``limit``.

    The rows are divided into ranges of the column, by its own type, so text,
    times and numbers work alike; nulls come first. The sizes of the ranges say
    where each begins, and only ranges that the slice touches are numbered, each
    by its own task.
    """
    stop = min([x for x in (end, None if limit is None else start + limit) if x is not None], default=None)
    if start == 0 and stop is not None:
        return df.orderBy(order).limit(stop)
    if start == 0:
        return df
    parts = max(1, -(-df.count() // PART_ROWS))
    ranged = stored(df.repartitionByRange(max(parts, 2), order).withColumn("__part", F.spark_partition_id()))
    sizes = {r["__part"]: r["count"] for r in ranged.groupBy("__part").count().collect()}
    begins, at = {}, 0
    for part in sorted(sizes):
        if at + sizes[part] > start and (stop is None or at < stop):
            begins[part] = at
        at += sizes[part]
    if not begins:
        return df.limit(0)
    touched = ranged.filter(F.col("__part").isin(*begins))
    place = F.row_number().over(Window.partitionBy("__part").orderBy(order)) - 1 + fn_map(begins, "__part")
    kept = touched.withColumn("__pos", place).filter(F.col("__pos") >= start)
    if stop is not None:
        kept = kept.filter(F.col("__pos") < stop)
    return kept.drop("__part", "__pos")


def fn_map(values: dict[int, int], column: str) -> Column:
    """The entry of a small map for the value of ``column``."""
    pairs = [F.lit(x) for k, v in values.items() for x in (k, v)]
    return F.element_at(F.create_map(*pairs), F.col(column))


#: Parts of a doubling in the first pass of a quantile, and parts of an interval in the later ones.
OCTAVE, STEPS = 64, 4096
#: Intervals of at most so many values are counted value by value; intervals of so many groups are a broadcast.
LISTED, BROADCAST_GROUPS = 8192, 10_000


def exact_quantiles(df: DataFrame, group: list[str], value: str, probs: dict[str, float]) -> DataFrame:
    """Exact, linearly interpolated quantiles per group, one column per entry of ``probs``.

    ``percentile`` and ``median`` gather all distinct values of a group in one
    task. Here each pass only counts: first the values of each 64th part of a
    doubling, then the parts of those intervals that hold a wanted rank, until
    an interval is one value. Intervals of few values are counted value by value.
    Counts, the least and the greatest value are plain aggregates, so memory does
    not grow with a group, and a double is reached in five passes, mostly in three.

    Rows meet their group's intervals in a broadcast if at most
    ``BROADCAST_GROUPS`` groups were counted, else in a join. ``df`` is read
    once a pass. Null and NaN values do not count; a group without values gives
    no row (null quantiles without ``group``).
    """
    v = df.select(*(group or [F.lit(1).alias("__all")]), not_nan(value).cast("double").alias("__v")).filter(F.col("__v").isNotNull())
    keys = group or ["__all"]
    numbered = {g: f"__g{i}" for i, g in enumerate(keys)}
    names = list(numbered.values())
    ranks = {n: F.lit(float(p)) * (F.col("__size") - 1) for n, p in probs.items()}

    def holds(rank: Column) -> Column:
        return (F.col("__before") <= rank) & (rank < F.col("__before") + F.col("__n"))

    wanted = reduce(Column.__or__, [holds(f(r)) for r in ranks.values() for f in (F.floor, F.ceil)])
    counts = [F.count(F.lit(1)).alias("__n"), F.min("__v").alias("__lo"), F.max("__v").alias("__hi")]
    columns = [*names, "__size", "__before", "__n", "__lo", "__hi"]
    first = v.withColumnsRenamed(numbered).groupBy(*names, _octave_part(F.col("__v")).alias("__part")).agg(*counts)
    whole = Window.partitionBy(*names)
    placed = first.withColumns({"__size": F.sum("__n").over(whole), "__before": _sum_before(whole)})
    state = cut_lineage(placed.filter(wanted).select(*columns))
    while True:
        facts = state.agg(F.count_if(F.col("__lo") < F.col("__hi")).alias("open"), F.count_distinct(F.struct(*names)).alias("groups")).first()
        if not facts["open"]:
            break
        part = state.filter(F.col("__lo") < F.col("__hi")).withColumnsRenamed({c: f"__of{c}" for c in columns})
        side = F.broadcast(part) if facts["groups"] <= BROADCAST_GROUPS else part
        inside = (F.col("__v") >= F.col("__of__lo")) & (F.col("__v") <= F.col("__of__hi"))
        met = v.join(side, reduce(Column.__and__, [v[g].eqNullSafe(side[f"__of{n}"]) for g, n in numbered.items()]) & inside)
        share = (F.col("__v") - F.col("__of__lo")) / (F.col("__of__hi") - F.col("__of__lo"))
        step = F.when(F.col("__of__n") <= LISTED, F.col("__v")).otherwise(F.floor(share * STEPS).cast("double"))
        interval = [f"__of{c}" for c in (*names, "__size", "__before", "__lo")]
        parts = met.groupBy(*interval, step.alias("__part")).agg(*counts)
        earlier = F.col("__of__before") + _sum_before(Window.partitionBy(*interval))
        closer = parts.withColumn("__before", earlier).withColumnsRenamed({f"__of{c}": c for c in (*names, "__size")})
        state = cut_lineage(state.filter(F.col("__lo") == F.col("__hi")).unionByName(closer.filter(wanted).select(*columns)))
    ends = {f"__{side}{i}": F.max(F.when(holds(f(r)), F.col("__lo"))) for i, r in enumerate(ranks.values()) for side, f in (("x", F.floor), ("y", F.ceil))}
    values = state.groupBy(*names, "__size").agg(*[c.alias(n) for n, c in ends.items()])
    share = {n: r - F.floor(r) for n, r in ranks.items()}
    found = values.select(
        *[F.col(n).alias(g) for g, n in numbered.items()],
        *[(F.col(f"__x{i}") + F.when(share[n] > 0, (F.col(f"__y{i}") - F.col(f"__x{i}")) * share[n]).otherwise(0.0)).alias(n) for i, n in enumerate(probs)],
    )
    if group:
        return found
    one = df.sparkSession.range(1).select(F.lit(1).alias("__all"))
    return one.join(F.broadcast(found), "__all", "left").drop("__all")


def _octave_part(v: Column) -> Column:
    """A whole number that never falls as ``v`` grows: ``OCTAVE`` numbers for each doubling of its size."""
    size = F.abs(v)
    place = F.when(size == float("inf"), 1100 * 2 * OCTAVE).otherwise(F.floor(F.log2(size) * OCTAVE).cast("int") + 1100 * OCTAVE)
    return F.when(v > 0, place).when(v < 0, -place).otherwise(0)


def _sum_before(group) -> Column:
    """Values in the earlier parts of the group."""
    return F.coalesce(F.sum("__n").over(group.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def beside(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """A left join of two tables with one row a key each, as one grouping: equal keys, nulls too, are laid together."""
    rest = {side: [c for c in df.columns if c not in keys] for side, df in (("__l", left), ("__r", right))}
    parts = [df.select(*keys, F.struct(*rest[side]).alias(side)) for side, df in (("__l", left), ("__r", right))]
    both = parts[0].unionByName(parts[1], allowMissingColumns=True).groupBy(*keys).agg(
        *[F.any_value(side, True).alias(side) for side in rest]
    )
    return both.filter(F.col("__l").isNotNull()).select(*keys, "__l.*", "__r.*")
