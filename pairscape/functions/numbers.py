"""Numeric helpers, classes, losses and prediction fields as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from .text import as_col, strip

# Class names in id order, class thresholds, column aliases.
CLASS_NAMES = ("low", "medium", "high")
LOW_BELOW, MEDIUM_BELOW = 0.05, 0.20
PREDICTION_ALIASES = ("y_pred_change_ratio", "predicted_change_ratio", "prediction", "y_pred", "pred")
TRUTH_ALIASES = ("y_true_change_ratio", "true_change_ratio", "change_ratio", "target")
ERROR_ALIASES = ("abs_error", "absolute_error")


def hash_key(seed: int, *cols) -> Column:
    """Seeded order that depends on the row's key only, never on input order."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[as_col(c).cast("string") for c in cols]))


def not_nan(col) -> Column:
    """NaN becomes null, so that aggregates skip it."""
    return F.nanvl(as_col(col).cast("double"), F.lit(None).cast("double"))


def is_finite(col) -> Column:
    c = as_col(col).cast("double")
    return F.coalesce(~F.isnan(c) & (F.abs(c) != float("inf")), F.lit(False))


def finite(col) -> Column:
    """The value if finite, otherwise null."""
    return F.when(is_finite(col), as_col(col).cast("double"))


def change_class(ratio, low_below: float = LOW_BELOW, medium_below: float = MEDIUM_BELOW) -> Column:
    r = not_nan(ratio)
    return (
        F.when((r >= 0) & (r < low_below), "low")
        .when((r >= low_below) & (r < medium_below), "medium")
        .when((r >= medium_below) & (r <= 1), "high")
        .otherwise("invalid")
    )


def safe_ratio(numerator, denominator) -> Column:
    return F.try_divide(not_nan(numerator), not_nan(denominator))


def safe_float(col, default=None, finite_only: bool = False) -> Column:
    """Text to double; empty or invalid text gives ``default``."""
    value = strip(as_col(col).cast("string")).try_cast("double")
    if finite_only:
        value = finite(value)
    return value if default is None else F.coalesce(value, F.lit(float(default)))


def one_hot(col, prefix: str, categories) -> list[Column]:
    """One 0/1 column per category, 0 everywhere for a null value."""
    return [
        F.coalesce((as_col(col) == c).cast("int"), F.lit(0)).alias(f"{prefix}_{c}")
        for c in categories
    ]


def softmax(logits) -> Column:
    z = as_col(logits)
    exps = F.transform(z, lambda v: F.exp(v - F.array_max(z)))
    total = F.aggregate(exps, F.lit(0.0), lambda a, v: a + v)
    return F.transform(exps, lambda e: e / total)


def argmax(values) -> Column:
    """Zero-based position of the first largest element."""
    v = as_col(values)
    return (F.array_position(v, F.array_max(v)) - 1).cast("int")


def class_name(class_id) -> Column:
    cid = as_col(class_id)
    return F.coalesce(
        F.get(F.array(*[F.lit(c) for c in CLASS_NAMES]), cid.cast("int")), cid.cast("string")
    )


def first_number(available, aliases, finite_only: bool = True) -> Column:
    """First usable number among the alias columns that exist."""
    found = [safe_float(F.col(a), finite_only=finite_only) for a in aliases if a in available]
    return F.coalesce(*found) if found else F.lit(None).cast("double")


def prediction_error(columns) -> Column:
    """|abs_error|, else |truth − prediction| from the first complete pair of columns."""
    available = set(columns)
    options = []
    if "abs_error" in available:
        options.append(F.abs(safe_float("abs_error")))
    for truth, pred in (("y_true_change_ratio", "y_pred_change_ratio"), ("change_ratio", "prediction")):
        if {truth, pred} <= available:
            options.append(F.abs(safe_float(truth) - safe_float(pred)))
    return F.coalesce(*options) if options else F.lit(None).cast("double")


def aliased_values(columns) -> dict[str, Column]:
    """Prediction, truth and absolute error under any of their known names."""
    available = set(columns)
    pred = first_number(available, PREDICTION_ALIASES)
    true = first_number(available, TRUTH_ALIASES)
    error = F.coalesce(first_number(available, ERROR_ALIASES), F.abs(pred - true))
    return {
        "predicted_change_ratio": pred,
        "true_change_ratio": true,
        "absolute_error": error,
    }


def regression_loss(pred, true, kind: str = "mse", delta: float = 0.1) -> Column:
    """Per-row loss; average it for the batch value."""
    err = as_col(pred) - as_col(true)
    size = F.abs(err)
    if kind == "mse":
        return err * err
    if kind == "mae":
        return size
    if kind == "huber":
        return F.when(size <= delta, 0.5 * err * err).otherwise(delta * (size - 0.5 * delta))
    if kind == "smooth_l1":
        return F.when(size < delta, 0.5 * err * err / delta).otherwise(size - 0.5 * delta)
    raise ValueError("kind must be one of: mse, mae, huber, smooth_l1")


def cross_entropy_parts(logits, class_id, weights=None, smoothing: float = 0.0) -> tuple[Column, Column]:
    """(numerator, weight) per row: the loss is sum(numerator) / sum(weight)."""
    z = as_col(logits)
    cid = as_col(class_id).cast("int")
    peak = F.array_max(z)
    log_norm = peak + F.ln(
        F.aggregate(F.transform(z, lambda v: F.exp(v - peak)), F.lit(0.0), lambda a, v: a + v)
    )
    w = F.array(*[F.lit(float(x)) for x in weights]) if weights else F.transform(z, lambda _: F.lit(1.0))
    row_weight = F.get(w, cid)
    numerator = (1.0 - smoothing) * row_weight * (log_norm - F.get(z, cid))
    if smoothing:
        spread = F.aggregate(
            F.zip_with(z, w, lambda v, u: u * (log_norm - v)), F.lit(0.0), lambda a, v: a + v
        )
        numerator = numerator + F.lit(smoothing) * spread / F.size(z)
    return numerator, row_weight


def any_true(*conditions: Column) -> Column:
    return reduce(lambda a, b: a | b, conditions)
