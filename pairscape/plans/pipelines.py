"""The three workflows as compositions of operators.

Tables that several later stages read are written once (``cut_lineage``);
everything else stays one lazy plan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators import evaluation, explain, pairs as pair_ops, patches as patch_ops, selection, splits, tabular
from ..session import cut_lineage


def feature_tables(
    images: DataFrame, monthly: DataFrame, targets: dict[str, int], seed: int = 42
) -> dict[str, DataFrame]:
    """Monthly table and images to split, constrained pairs and scaled features of complete pairs.

    Imputation and scaling are fitted before incomplete pairs are removed.
    """
    seasonal = cut_lineage(tabular.monthly_to_seasonal(tabular.clean_table(monthly)))
    assigned, unassigned = splits.assign_split(images, splits.split_districts(images, seed=seed))
    candidates = pair_ops.forward_pairs(assigned)
    chosen = pair_ops.constrained_pairs(candidates, targets, seed=seed)
    feats = cut_lineage(tabular.pair_features(chosen, seasonal))
    stats = cut_lineage(tabular.train_stats(feats))
    scaled = tabular.impute_scale(feats, stats)
    kept, removed, complete = tabular.complete_pairs(chosen, scaled)
    return {
        "seasonal": seasonal, "unassigned_images": unassigned, "pairs": chosen, "features": feats, "stats": stats,
        "scaled": scaled, "complete_pairs": kept, "removed_pairs": removed, "complete_features": complete,
    }


def labeled_selection(
    pairs: DataFrame, sizes: DataFrame, pixels: DataFrame, targets: dict[str, int], max_per_pair: int = 50,
    patch: int = patch_ops.PATCH, stride: int = patch_ops.STRIDE, seed: int = 42,
) -> dict[str, DataFrame]:
    """Pairs and raster tables to sampled, labeled and finally selected patches."""
    index, errors = patch_ops.patch_index(pairs, sizes, patch, stride)
    sampled = cut_lineage(patch_ops.spatial_sample(index, max_per_pair, seed))
    labels = patch_ops.label_pixels(sampled, pixels, patch, stride)
    labeled = cut_lineage(patch_ops.attach_labels(sampled, labels))
    return {
        "index_errors": errors, "sampled": sampled, "labeled": labeled,
        "final": selection.final_selection(labeled, targets, seed),
    }


def evaluate_and_explain(
    samples: DataFrame, index: DataFrame, model, channels: int, features: list[str], n: int = 100, seed: int = 42
) -> dict[str, DataFrame]:
    """Score samples, summarize errors, choose representatives and explain them."""
    meta = ["patch_id", "pair_id", "district", "split", "change_class", "pair_type", "time_gap_group"]
    scored = explain.score(samples, model, meta)
    pred = cut_lineage(evaluation.regression_fields(scored, "prediction", "change_ratio"))
    chosen = cut_lineage(explain.representative_samples(explain.merge_predictions(pred, index), n, seed))
    picked = samples.join(chosen.select("patch_id"), "patch_id", "left_semi")
    bands = explain.ablate_bands(picked, model, channels, ["patch_id"])
    feats = explain.ablate_features(picked, model, features, ["patch_id"])
    return {
        "predictions": pred, "metrics": evaluation.regression_metrics(pred), "groups": evaluation.group_summary(pred),
        "selected": chosen, "bands": bands, "band_summary": explain.importance_summary(bands, ["band_index", "band_name"]),
        "features": feats, "feature_summary": explain.importance_summary(feats, ["feature_index", "feature_name", "feature_group"]),
        "modalities": explain.ablate_modalities(picked, model, meta),
    }
