"""RMSE, leaderboards, feature ablation and the λ search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .copartition import Layout
from .effects import DEFAULT_CHAIN, BiasModel, EffectSpec, GridStatistics, fit_effects, grid_statistics, later_keys, predict, residuals
from .joins import lookup_join


def rmse_expr(pred: Column | str, obs: Column | str) -> Column:
    """Strict RMSE (T2): NULL when any prediction is missing."""
    pred = F.col(pred) if isinstance(pred, str) else pred
    obs = F.col(obs) if isinstance(obs, str) else obs
    return F.when(F.count(pred) == F.count(F.lit(1)), F.sqrt(F.avg(F.pow(pred - obs, 2))))


def rmse(df: DataFrame, pred: str = "pred", obs: str = "rating") -> DataFrame:
    """One row: strict ``rmse``, lenient ``rmse_scored`` (NULLs skipped), counts."""
    return df.agg(rmse_expr(pred, obs).alias("rmse"),
                  F.sqrt(F.avg(F.pow(F.col(pred) - F.col(obs), 2))).alias("rmse_scored"),
                  F.count(F.lit(1)).alias("n"),
                  (F.count(F.lit(1)) - F.count(pred)).alias("n_unscored"))


MODEL_LABELS = (
    "Model 1: mean",
    "Model 2: + movie",
    "Model 3: + user",
    "Model 4: + release year",
    "Model 5: + rating year + rating week",
    "Model 6: + genres",
)


def model_sequence(model: BiasModel, test: DataFrame, labels: tuple[str, ...] = MODEL_LABELS,
                   steps: tuple[int, ...] | None = None, layout: Layout | None = None) -> DataFrame:
    """RMSE of the nested models (M3-M9) from ONE pass over ``test`` (or its ``layout``).

    ``steps`` lists how many chain effects each model uses (default: the
    reference's 0, 1, 2, 3, 5, then 5 + genres).
    """
    steps = steps or (0, 1, 2, 3, 5)
    scored = predict(model, test, cumulative=True, layout=layout)
    aggs = []
    for i, k in enumerate(steps):
        aggs.append(F.struct(F.lit(i + 1).alias("seq"), F.lit(labels[i]).alias("method"),
                             rmse_expr(f"pred_m{k + 1}", model.rating_col).alias("rmse")))
    if model.genres is not None:
        i = len(steps)
        aggs.append(F.struct(F.lit(i + 1).alias("seq"), F.lit(labels[i]).alias("method"),
                             rmse_expr("pred_g", model.rating_col).alias("rmse")))
    return scored.agg(F.array(*aggs).alias("rows")).select(F.inline("rows"))


def with_drop_pct(board: DataFrame) -> DataFrame:
    """Relative RMSE drop vs the previous model, in %.

    The window has no partition key on purpose: a leaderboard has one row
    per model (bounded), not per rating.
    """
    prev = F.lag("rmse").over(Window.orderBy("seq"))
    return board.withColumn("drop_pct", (prev - F.col("rmse")) / prev * 100)


def fit_candidates(model: BiasModel, train: DataFrame, candidates: list[EffectSpec],
                   base_steps: int = 3, name: str = "ablation") -> list:
    """Each candidate's effect table (key, n, b0) on the residual of the first ``base_steps``.

    All come from ONE pass over the residual: a ``GROUPING SETS ((key1), (key2), …)``
    aggregate (partial aggregation, tiny output), written once.
    """
    from ..session import materialize
    from .effects import FittedEffect, _shrink

    resid = residuals(model.prefix(base_steps), train)
    keys = [c.key for c in candidates]
    if len(set(keys)) != len(keys):
        raise ValueError("candidate keys must be distinct")
    sets = materialize(resid.groupingSets([[k] for k in keys], *keys).agg(
        F.sum("_n").alias("n"), F.sum("_s0").alias("s"), *[F.grouping(k).alias(f"_g_{k}") for k in keys]), name)
    sizes = {tuple(r[f"_g_{k}"] for k in keys): r["count"]
             for r in sets.groupBy(*[f"_g_{k}" for k in keys]).count().collect()}
    fitted = []
    for c in candidates:
        mask = tuple(0 if k == c.key else 1 for k in keys)
        sel = F.lit(True)
        for k, m in zip(keys, mask):
            sel = sel & (F.col(f"_g_{k}") == m)
        table = sets.where(sel).select(c.key, "n", _shrink("s", "n", 0.0).alias("b0"))
        fitted.append(FittedEffect(c, table, sizes.get(mask, 0)))
    return fitted


def ablation(model: BiasModel, train: DataFrame, test: DataFrame, candidates: list[EffectSpec],
             base_steps: int = 3, name: str = "ablation") -> DataFrame:
    """Add each candidate effect *alone* on top of the first ``base_steps`` (M7).

    The test side is scored for the base and every candidate in a single pass.
    """
    base = model.prefix(base_steps)
    fitted = fit_candidates(model, train, candidates, base_steps, name)
    scored = predict(base, test)
    for f in fitted:
        side = f.table.select(f.spec.key, F.col("n").alias("_lk_n"), F.col("b0").alias(f"_c_{f.spec.name}"))
        scored = lookup_join(scored, side, [f.spec.key], "left", small_rows=f.rows, weight_col="_lk_n").drop("_lk_n")
    obs = model.rating_col
    base_rmse = rmse_expr("pred", obs)
    rows = [F.struct(F.lit(f.spec.key).alias("candidate"),
                     rmse_expr(F.col("pred") + F.col(f"_c_{f.spec.name}"), obs).alias("rmse"),
                     base_rmse.alias("base_rmse")) for f in fitted]
    out = scored.agg(F.array(*rows).alias("rows")).select(F.inline("rows"))
    delta = F.col("rmse") - F.col("base_rmse")
    return out.withColumns({"delta_vs_base": delta, "improves": delta < 0})


def lambda_grid(train: DataFrame, test: DataFrame, lambdas: list[float], chunk: int = 41,
                name: str = "grid", parallel: int = 1, statistics: GridStatistics | None = None, **fit_kw) -> DataFrame:
    """(lambda, rmse, n_unscored) for every λ.

    λ values are wide columns of the same fit, ``chunk`` of them per pass
    (bounded row width); the reference refits 41 times. What the first two effects need is
    read from the rows once, for all passes (``grid_statistics``, or ``statistics`` of these rows if given). With ``parallel`` > 1
    the chunks are fitted from that many driver threads at once: Spark runs
    their jobs concurrently, so the small dependent jobs of one chain overlap
    with another's instead of leaving task slots idle.
    """
    from concurrent.futures import ThreadPoolExecutor

    from pyspark import inheritable_thread_target

    chain = fit_kw.get("chain", DEFAULT_CHAIN)
    later = later_keys(chain, fit_kw.get("genres", True), genres_col=fit_kw.get("genres_col", "genres"))
    stats = statistics
    if stats is None and len(lambdas) > 1 and len(chain) >= 2 and later and fit_kw.get("row_steps", 2) == 2:
        stats = grid_statistics(train, chain, fit_kw.get("rating_col", "rating"), name, later)

    def one(start: int) -> DataFrame:
        lams = lambdas[start:start + chunk]
        model = fit_effects(train, lams, name=f"{name}{start}", statistics=stats, **fit_kw)
        scored = predict(model, test)
        obs = model.rating_col
        cols = ["pred"] if len(lams) == 1 else [f"pred{j}" for j in range(len(lams))]
        rows = [F.struct(F.lit(float(lam)).alias("lambda"), rmse_expr(c, obs).alias("rmse"),
                         (F.count(F.lit(1)) - F.count(c)).alias("n_unscored"))
                for lam, c in zip(lams, cols)]
        return scored.agg(F.array(*rows).alias("rows")).select(F.inline("rows"))

    starts = list(range(0, len(lambdas), chunk))
    if parallel > 1 and len(starts) > 1:
        with ThreadPoolExecutor(min(parallel, len(starts))) as pool:
            # Job groups and local properties of this thread hold in the pool's threads too.
            parts = list(pool.map(inheritable_thread_target(train.sparkSession)(one), starts))
    else:
        parts = [one(s) for s in starts]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def best_lambda(grid: DataFrame) -> DataFrame:
    """First λ with the smallest non-NULL RMSE.

    RMSE is rounded to 12 decimals for the comparison so summation-order
    noise cannot flip a tie; ties go to the smaller λ.
    """
    key = F.struct(F.round("rmse", 12), F.col("lambda"))
    valid = grid.where(F.col("rmse").isNotNull())
    return valid.agg(F.min_by("lambda", key).alias("lambda"), F.min_by("rmse", key).alias("rmse"))
