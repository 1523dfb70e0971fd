"""Monthly district table to seasonal features, and pair features from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from .. import functions as fn
from ..functions.text import as_col
from ..session import cut_lineage
from .columns import medians_and_moments

# Pair columns that are not model features.
PAIR_METADATA = (
    "pair_id", "split", "district", "year_t1", "season_t1", "year_t2", "season_t2",
    "pair_type", "time_gap_group",
)
MISSING_FLAGS = (
    "tabular_t1_missing", "tabular_t2_missing", "tabular_any_missing", "tabular_district_missing",
)
TABULAR_KEYS = (
    "district", "district_original", "district_join_key", "year", "season", "season_order", "time_index",
)


def clean_table(df: DataFrame) -> DataFrame:
    """Snake-case names, no all-null rows, no exact duplicates."""
    return fn.standardize_columns(df).dropna("all").distinct()


def reject_rows(df: DataFrame, parsed: Column, raw: str, strict: bool = False) -> DataFrame:
    """Rows whose ``raw`` value is present but could not be parsed.

    ``strict`` raises with up to ten of the values instead.
    """
    bad = df.filter(F.col(raw).isNotNull() & parsed.isNull())
    if strict:
        examples = [r[0] for r in bad.select(raw).distinct().limit(10).collect()]
        if examples:
            raise ValueError(f"{raw} has values that cannot be parsed: {examples}")
    return bad


def monthly_to_seasonal(df: DataFrame, keys: dict[str, str] | None = None) -> DataFrame:
    """Mean (count-like features: sum) of every numeric feature per district and season.

    Null keys form groups of their own. A count feature without any value sums
    to 0. Mean columns come first, then count columns.
    """
    keys = keys or fn.detect_keys(df)
    features = fn.numeric_features(df, {*keys.values(), "district", "year", "month", "season"})
    counts = fn.count_features(features)
    means = [f for f in features if f not in counts]
    year = F.col(keys["year"]).cast("int")
    season = fn.season_of(year, fn.normalize_month(keys["month"]))
    working = df.select(
        fn.normalize_district(keys["district"], tabular=True).alias("district"),
        season.alias("__s"), *features,
    )
    grouped = working.groupBy("district", F.col("__s.season_year").alias("year"), F.col("__s.season").alias("season"))
    return grouped.agg(
        *[F.avg(fn.not_nan(c)).alias(c) for c in means],
        *[F.coalesce(F.sum(fn.not_nan(c) if isinstance(df.schema[c].dataType, T.FractionalType) else F.col(c)), F.lit(0)).alias(c) for c in counts],
    )


def prepare_tabular(tab: DataFrame) -> DataFrame:
    """Join key, canonical season and time index; the last row per key wins."""
    season = fn.normalize_season("season")
    prepared = tab.withColumns({
        "district_join_key": fn.district_join_key("district"),
        "year": F.col("year").cast("int"),
        "season": season,
        "time_index": fn.time_index(F.col("year").cast("int"), season),
    })
    return prepared


def base_features(tab: DataFrame) -> list[str]:
    return fn.numeric_features(tab, TABULAR_KEYS)


def _pair_keys(pairs: DataFrame) -> DataFrame:
    """Canonical seasons, the district's join key and both time indexes."""
    canonical = pairs.withColumns({f"season_{t}": fn.normalize_season(f"season_{t}") for t in ("t1", "t2")})
    return canonical.withColumns({
        "district_join_key": fn.district_join_key("district"),
        "__t1": fn.time_index("year_t1", "season_t1"),
        "__t2": fn.time_index("year_t2", "season_t2"),
    })


def _points(keyed: DataFrame, tab: DataFrame, features: list[str], order: list) -> DataFrame:
    """One row for each (district, time) that a record or a pair's end has.

    ``__e``: the features of the time's last record in ``order``; ``__n``: its
    records; ``__at`` and ``__before``: for each feature the running sums over the
    district's records up to this time, with and without it; ``__known``: whether
    the district has any record. Records are grouped before the running sums, so
    a district has as many rows as its calendar.
    """
    key = "district_join_key"
    records = prepare_tabular(tab).select(
        key, F.col("time_index").alias("__t"), F.lit(True).alias("__rec"), F.struct(*[as_col(c) for c in order]).alias("__o"), *features
    ).filter(F.col(key).isNotNull())
    ends = keyed.select(key, F.explode(F.array("__t1", "__t2")).alias("__t")).distinct().withColumn("__rec", F.lit(False))
    rows = records.unionByName(ends, allowMissingColumns=True)
    counted = F.col("__t").isNotNull()  # a record without time is in no span

    def total(c: Column) -> Column:
        return F.coalesce(F.sum(F.when(counted, c)), F.lit(0))

    parts = {}
    for i, f in enumerate(features):
        v = fn.not_nan(f)
        parts |= {
            f"s{i}": F.coalesce(F.sum(F.when(counted, fn.finite(f))), F.lit(0.0)), f"c{i}": total(v.isNotNull().cast("long")),
            # infinite values are counted, because a difference of sums would lose them
            f"p{i}": total((v == float("inf")).cast("long")), f"m{i}": total((v == float("-inf")).cast("long")),
        }
    times = rows.groupBy(key, "__t").agg(
        F.count_if("__rec").alias("__n"), F.max_by(F.struct(*features), F.struct("__rec", "__o")).alias("__e"),
        total(F.col("__rec").cast("long")).alias("r"), *[c.alias(n) for n, c in parts.items()],
    )
    whole = Window.partitionBy(key)
    upto = whole.orderBy("__t").rowsBetween(Window.unboundedPreceding, 0)
    sums = ["r", *parts]
    running = times.withColumns({f"__{c}": F.sum(c).over(upto) for c in sums} | {"__known": F.max(F.col("__n") > 0).over(whole)})

    def moments(value) -> Column:
        """``r`` and, for each feature, its sum, its known values and its infinite ones of either sign."""
        parts = [F.struct(*[value(f"{c}{i}").alias(c) for c in "scpm"]) for i in range(len(features))]
        return F.struct(value("r").alias("r"), F.array(*parts).alias("f"))

    return running.filter(counted).select(
        key, "__t", "__n", "__e", "__known", moments(lambda c: F.col(f"__{c}")).alias("__at"),
        moments(lambda c: F.col(f"__{c}") - F.col(c)).alias("__before"),
    )


def _at_both_ends(keyed: DataFrame, points: DataFrame, parts: dict[str, list[str]]) -> DataFrame:
    """The points of both ends beside each pair: ``__p_t1`` and ``__p_t2``, null where an end has no time.

    A district's points are one array, as long as its calendar, so the pairs are
    shuffled once, by district, before they are widened. ``parts`` are the
    columns that are looked up.
    """
    key = "district_join_key"
    used = sorted({c for names in parts.values() for c in names})
    calendar = points.groupBy(key).agg(F.collect_list(F.struct("__t", *used)).alias("__points"))
    met = keyed.join(calendar.withColumn("__times", F.col("__points.__t")), key, "left")

    def at(t: str) -> Column:
        return F.get("__points", (F.array_position("__times", F.col(f"__{t}")) - 1).cast("int"))

    return met.withColumns({f"__p_{t}": at(t) for t in ("t1", "t2")}).drop("__points", "__times")


def _endpoint_columns(features: list[str]) -> dict[str, Column]:
    t1, t2 = (F.coalesce(F.col(f"__p_{t}.__n") == 0, F.lit(True)) for t in ("t1", "t2"))
    out = {"tabular_t1_missing": t1, "tabular_t2_missing": t2, "tabular_any_missing": t1 | t2}
    for f in features:
        a, b = F.col(f"__p_t1.__e.{f}"), F.col(f"__p_t2.__e.{f}")
        out |= {f"{f}_t1": a, f"{f}_t2": b, f"{f}_diff": fn.not_nan(b) - fn.not_nan(a), f"{f}_ratio": fn.safe_ratio(fn.not_nan(b), fn.not_nan(a))}
    return out


def _within(wide: DataFrame) -> DataFrame:
    """``__some``: has the span records; ``__within``: for each feature their known values, sum and mean.

    Every record between both ends counts, also a second one for the same
    season, by the difference of two running sums. The features are one array, so
    that a wide table does not become one huge generated method.
    """
    def of(b: Column, a: Column) -> Column:
        high, low = b["p"] > a["p"], b["m"] > a["m"]
        total = F.when(high & low, float("nan")).when(high, float("inf")).when(low, float("-inf")).otherwise(b["s"] - a["s"])
        return F.struct((b["c"] - a["c"]).alias("n"), total.alias("total"), F.try_divide(total, b["c"] - a["c"]).alias("mean"))

    return wide.withColumns({
        "__some": F.col("__p_t2.__at.r") > F.col("__p_t1.__before.r"),
        "__within": F.zip_with("__p_t2.__at.f", "__p_t1.__before.f", of),
    })


def _between_columns(features: list[str]) -> dict[str, Column]:
    """Mean of every feature and sum of count features over each span; a span without records has nulls."""
    counts = fn.count_features(features)
    means, sums = {}, {}
    for i, f in enumerate(features):
        one = F.get("__within", F.lit(i))
        means[f"{f}_mean_between"] = F.when(F.col("__some") & (one["n"] > 0), one["mean"])
        if f in counts:
            sums[f"{f}_sum_between"] = F.when(F.col("__some"), F.when(one["n"] > 0, one["total"]).otherwise(0.0))
    return means | sums


ENDS, BETWEEN = {"t1": ["__n", "__e"], "t2": ["__n", "__e"]}, {"t1": ["__before"], "t2": ["__at"]}
LOOKED_UP = ["district_join_key", "__t1", "__t2", "__p_t1", "__p_t2", "__some", "__within"]


def _widened(pairs: DataFrame, tab: DataFrame, features: list[str], order: list, parts: dict[str, list[str]]) -> DataFrame:
    """Pairs with canonical seasons and the points of both ends."""
    keyed = _pair_keys(pairs)
    return _at_both_ends(keyed, _points(keyed, tab, features, order), parts)


def endpoint_features(pairs: DataFrame, tab: DataFrame, order=("year",)) -> DataFrame:
    """``_t1``, ``_t2``, ``_diff``, ``_ratio`` per feature and the missing flags."""
    features = base_features(tab)
    wide = _widened(pairs, tab, features, list(order), ENDS)
    return wide.withColumns(_endpoint_columns(features)).drop(*LOOKED_UP)


def between_features(pairs: DataFrame, tab: DataFrame) -> DataFrame:
    """Mean of every feature and sum of count features over the pair's time span."""
    features = base_features(tab)
    wide = _within(_widened(pairs, tab, features, ["year"], BETWEEN))
    return wide.withColumns(_between_columns(features)).drop(*LOOKED_UP)


def district_presence(pairs: DataFrame, tab: DataFrame) -> DataFrame:
    """Flag pairs whose district has no tabular record at all."""
    keys = tab.select(fn.district_join_key("district").alias("__k")).dropna().distinct().withColumn("__in", F.lit(True))
    keyed = pairs.withColumn("__k", fn.district_join_key("district"))
    return keyed.join(keys, "__k", "left").withColumn(
        "tabular_district_missing", F.col("__in").isNull()
    ).drop("__k", "__in")


def pair_features(pairs: DataFrame, tab: DataFrame, order=("year",)) -> DataFrame:
    """The full feature table of a pair: endpoints, differences, windows, one-hot columns."""
    features = base_features(tab)
    counts = fn.count_features(features)
    extra = [c for c in ("time_gap_years",) if c in pairs.columns]
    parts = {"t1": [*ENDS["t1"], *BETWEEN["t1"], "__known"], "t2": [*ENDS["t2"], *BETWEEN["t2"]]}
    joined = _within(_widened(pairs.select(*PAIR_METADATA, *extra), tab, features, list(order), parts))
    columns = _endpoint_columns(features) | _between_columns(features)
    columns["tabular_district_missing"] = ~F.coalesce("__p_t1.__known", F.lit(False))
    s1, s2 = F.col("season_t1"), F.col("season_t2")
    gap = F.col("time_gap_years") if extra else F.col("year_t2") - F.col("year_t1")
    return joined.select(
        *PAIR_METADATA, gap.cast("int").alias("time_gap_years"),
        (s1 == s2).alias("same_season"), (s1 != s2).alias("cross_season"), *[columns[c].alias(c) for c in MISSING_FLAGS],
        *[columns[f"{f}_{part}"].alias(f"{f}_{part}") for f in features for part in ("t1", "t2", "diff", "ratio")],
        *[columns[c].alias(c) for c in [*[f"{f}_mean_between" for f in features], *[f"{f}_sum_between" for f in counts]]],
        *fn.one_hot(s1, "season_t1", fn.SEASONS), *fn.one_hot(s2, "season_t2", fn.SEASONS),
        *fn.one_hot("pair_type", "pair_type", fn.PAIR_TYPES),
        *fn.one_hot("time_gap_group", "time_gap_group", fn.GAP_GROUPS),
    )


def model_features(df: DataFrame) -> list[str]:
    """Numeric columns that are scaled: everything but metadata and flags."""
    return fn.numeric_features(df, {*PAIR_METADATA, *MISSING_FLAGS, "district_join_key"})


def long_values(df: DataFrame, cols: list[str], keep=()) -> DataFrame:
    """(feature, value) rows of the named columns; NaN becomes null."""
    entries = [F.struct(F.lit(c).alias("feature"), fn.not_nan(c).alias("value")) for c in cols]
    return df.select(*keep, F.inline(F.array(*entries)))


def train_stats(df: DataFrame, cols: list[str] | None = None, split: str = "split") -> DataFrame:
    """(feature, median, mean, scale) fitted on train rows only.

    Mean and population deviation are those of the imputed values: the moments
    of the known values are merged with the nulls' share at the median, so the
    wide table is read a few times by column for both. A zero deviation becomes
    1; a feature without values has median 0.
    """
    cols = cols or model_features(df)
    kind = "feature string, n long, k long, m double, v double, median double"
    facts = medians_and_moments(df.filter(F.col(split) == "train"), cols)
    both = df.sparkSession.createDataFrame(facts, kind).withColumn("median", F.coalesce("median", F.lit(0.0)))
    share = F.col("k") / F.col("n")
    known_mean, known_var = F.coalesce("m", F.lit(0.0)), F.coalesce("v", F.lit(0.0))
    mean = known_mean * share + F.col("median") * (1 - share)
    gap = F.col("median") - known_mean
    variance = known_var * share + share * (1 - share) * gap * gap
    return both.select(
        "feature", "median", mean.alias("mean"),
        F.when(variance > 0, F.sqrt(variance)).otherwise(1.0).alias("scale"),
    )


def impute_scale(df: DataFrame, stats: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Fill nulls with the train median and standardize, on every split.

    The statistics reach the rows as one small array (a scalar subquery bounded
    by the number of columns), so the wide table is not shuffled. Without train
    rows there are no statistics and the job stops with an error.
    """
    cols = cols or model_features(df)
    number = F.array_position(F.array(*[F.lit(c) for c in cols]), F.col("feature"))
    known = stats.select(F.struct(number.alias("i"), "median", "mean", "scale").alias("e")).filter(F.col("e.i") > 0)
    table = known.agg(F.array_sort(F.collect_list("e")).alias("a")).scalar()
    fault = F.raise_error(F.lit("no statistics for every feature; has the train split rows?")).cast(
        "array<struct<i:bigint,median:double,mean:double,scale:double>>"
    )
    checked = df.withColumn("__a", table).withColumn(
        "__stats", F.when(F.size("__a") == len(cols), F.col("__a")).otherwise(fault)
    )

    def scaled(i: int, c: str) -> Column:
        s = F.get("__stats", F.lit(i))
        return ((F.coalesce(fn.not_nan(c), s["median"]) - s["mean"]) / s["scale"]).alias(c)

    place = {c: i for i, c in enumerate(cols)}
    return checked.select(*[scaled(place[c], c) if c in place else F.col(c) for c in df.columns])


def complete_pairs(pairs: DataFrame, feats: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(kept pairs, removed pairs, kept features) by the any-missing flag; the ids are written once for the three."""
    ids = cut_lineage(feats.filter(~F.col("tabular_any_missing")).select("pair_id").distinct())
    return (
        pairs.join(ids, "pair_id", "left_semi"),
        pairs.join(ids, "pair_id", "left_anti"),
        feats.join(ids, "pair_id", "left_semi"),
    )


def missing_report(df: DataFrame) -> DataFrame:
    """Missing count and percent, and type per column, in one aggregation."""
    n = F.count(F.lit(1))
    entries = []
    for f in df.schema.fields:
        col = fn.not_nan(f.name) if isinstance(f.dataType, T.FractionalType) else F.col(f.name)
        missing = n - F.count(col)
        entries.append(F.struct(
            F.lit(f.name).alias("column"), missing.alias("missing_count"),
            F.coalesce(F.try_divide(missing * 100.0, n), F.lit(0.0)).alias("missing_percent"),
            F.lit(f.dataType.simpleString()).alias("dtype"),
        ))
    return df.agg(F.array(*entries).alias("e")).select(F.inline("e"))


def feature_schema(df: DataFrame, keys=("district", "year", "season")) -> DataFrame:
    """Role (key, numeric feature, other) and aggregation of each column, with its missing share."""
    features = fn.numeric_features(df, keys)
    counts = set(fn.count_features(features))
    column = F.col("column")
    role = (
        F.when(column.isin(*keys), "key")
        .when(column.isin(*features), "numeric_feature").otherwise("non_numeric")
    )
    aggregation = F.when(column.isin(*counts), "sum").when(column.isin(*features), "mean")
    return missing_report(df).select("column", role.alias("role"), aggregation.alias("aggregation"), "dtype", "missing_percent")
