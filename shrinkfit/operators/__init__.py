from .correlate import correlated_pairs, correlation_matrix
from .effects import (DEFAULT_CHAIN, BiasModel, EffectSpec, FittedEffect, fit_effect, fit_effects,
                      global_mean, load_model, predict, residuals, save_model)
from .evaluate import (MODEL_LABELS, ablation, best_lambda, lambda_grid, model_sequence, rmse,
                       rmse_expr, with_drop_pct)
from .features import (add_features, explode_genres, genre_indicators, genre_vocabulary,
                       genre_vocabulary_df, head, regroup_first_sum, select_prefix)
from .joins import lookup_join, natural_anti_join
from .split import (guarded_split, quantile_breaks, seen_key_guard, split_share, stratified_split,
                    stratum_expr, train_test)

__all__ = [
    "DEFAULT_CHAIN", "MODEL_LABELS", "BiasModel", "EffectSpec", "FittedEffect", "ablation",
    "add_features", "best_lambda", "correlated_pairs", "correlation_matrix", "explode_genres",
    "fit_effect", "fit_effects", "genre_indicators", "genre_vocabulary", "genre_vocabulary_df",
    "global_mean", "guarded_split", "load_model", "save_model", "head", "lambda_grid", "lookup_join", "model_sequence",
    "natural_anti_join", "predict", "quantile_breaks", "regroup_first_sum", "residuals", "rmse",
    "rmse_expr", "seen_key_guard", "select_prefix", "split_share", "stratified_split",
    "stratum_expr", "train_test", "with_drop_pct",
]
