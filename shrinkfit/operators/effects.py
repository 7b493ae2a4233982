"""Sequential (optionally regularised) bias effects: fit, predict, residualise.

Model (one value per λ in ``lambdas``)::

    pred = mu + b_1[k_1] + … + b_m[k_m] + Σ_g u_g · count_g(genres)
    b_k  = Σ resid_{k-1} / (n + λ)      (grouped by k's key)
    u_g  = Σ resid_m / (n_g + λ)        (rows where genre g occurs exactly once)

Execution plan per effect: one ``groupBy(key)`` with partial aggregation
(a hot key is pre-combined map-side), the effect table written as Parquet
under the checkpoint folder (lineage cut, exact size), and one null-safe
lookup join that carries the residual forward. The join is a broadcast only
when the counted table is under the byte bound; user/item tables beyond it
go through AQE's shuffle join with skew splitting. After every such shuffle
join the carried table is persisted so later effects do not replay it.

Margins: after the first ``row_steps`` effects (the high-cardinality user and
item keys) one pass sums the residual per value of each remaining key, and one
counts the rows of each pair of values of two of them. The rest of the chain
and the genre effects follow from these small tables exactly (``Margins``):
no combination of all keys is grouped, so nothing as long as the rows is shuffled.
Rows and margins share one layout, weight ``_n`` and residual sums ``_s{j}``.

Several λ are fitted in the same pass as *wide* columns ``b0 … b{L-1}``:
no row multiplication, one aggregate per effect, codegen-friendly
arithmetic. What they need of the rows is made once for all passes (``grid_statistics``): a first-effect
value is Σ/(n+λ) of its key's two numbers, so each row takes those two along and is written into buckets of
the second key, hot keys apart. A pass then sums and joins the second effect bucket by bucket without a
shuffle of rows, and a value per λ is on a row only on its way into the margins.
The genre effects are aggregated per distinct genre *string*
(tiny), exploded there, and never per rating.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import genre_tokens
from ..session import materialize
from ..sources.tables import NO_GENRE
from .copartition import AlignedTable, Layout, align, group_parts, join_parts, lay_out
from .joins import can_broadcast, lookup_join


@dataclass(frozen=True)
class EffectSpec:
    name: str
    key: str


# The reference's final chain, in order.
DEFAULT_CHAIN: tuple[EffectSpec, ...] = (
    EffectSpec("b_i", "movieId"),
    EffectSpec("b_u", "userId"),
    EffectSpec("b_ry", "release_year"),
    EffectSpec("b_rat_y", "rating_year"),
    EffectSpec("b_rat_wy", "rating_week_of_year"),
)


@dataclass
class FittedEffect:
    spec: EffectSpec
    table: DataFrame   # key, n, b0..b{L-1}
    rows: int
    sums: DataFrame | None = None   # key, n, s: the values follow from these two numbers for every λ
    aligned: AlignedTable | None = None   # the table bucketed by its key, once a layout needs it

    def aligned_to(self, layout: Layout) -> AlignedTable:
        if self.aligned is None or self.aligned.buckets != layout.buckets:
            self.aligned = align(self.table, self.spec.key, layout.buckets, f"aligned-{self.spec.name}")
        return self.aligned


@dataclass
class BiasModel:
    mu: float
    lambdas: list[float]
    effects: list[FittedEffect] = field(default_factory=list)
    genres: DataFrame | None = None   # genre, n, g0..g{L-1}
    genre_rows: int = 0
    genres_col: str = "genres"
    rating_col: str = "rating"

    @property
    def width(self) -> int:
        return len(self.lambdas)

    def effect(self, name: str, j: int = 0) -> DataFrame:
        """Effect table ``(key, <name>, n)`` for λ number ``j``."""
        for e in self.effects:
            if e.spec.name == name:
                return e.table.select(e.spec.key, F.col(f"b{j}").alias(name), "n")
        raise KeyError(name)

    def genre_effects(self, j: int = 0) -> DataFrame:
        if self.genres is None:
            raise KeyError("model has no genre effects")
        return self.genres.select("genre", F.col(f"g{j}").alias("b_g"), "n")

    def prefix(self, k: int, with_genres: bool = False) -> "BiasModel":
        return BiasModel(self.mu, self.lambdas, self.effects[:k],
                         self.genres if with_genres else None,
                         self.genre_rows if with_genres else 0, self.genres_col, self.rating_col)


def _shrink(s: str, n: str, lam: float):
    """Σ/(n+λ); an empty group (n+λ = 0) gives 0 instead of NaN."""
    denom = F.col(n) + F.lit(float(lam))
    return F.when(denom > 0, F.coalesce(F.col(s), F.lit(0.0)) / denom).otherwise(F.lit(0.0))


def global_mean(df: DataFrame, col: str = "rating") -> float:
    """A1 with the reference's NA rule (T3): any NULL rating is an error."""
    row = df.agg(F.count(F.lit(1)).alias("n"), F.count(col).alias("nn"), F.avg(col).alias("mu")).first()
    if row["n"] == 0:
        raise ValueError("cannot fit on an empty table")
    if row["nn"] < row["n"]:
        raise ValueError(f"{row['n'] - row['nn']} NULL values in {col!r}")
    return float(row["mu"])


def _keep(df: DataFrame, name: str, durable: bool) -> tuple[DataFrame, int]:
    """Written under the checkpoint folder (long lineage) or persisted (short lineage)."""
    if durable:
        df = materialize(df, name)
    else:
        df = df.persist(StorageLevel.MEMORY_AND_DISK)
    return df, df.count()


def fit_effect(cur: DataFrame, spec: EffectSpec, lambdas: list[float], shared: bool,
               name: str = "effect", durable: bool = True) -> FittedEffect:
    """One grouped shrunk mean of the carried residual (A2/A3).

    ``durable=False`` is for effects fitted on already written margins:
    their lineage is a few small aggregates, so a persisted copy suffices.
    """
    L = len(lambdas)
    if shared:   # residual is still λ-independent: one sum serves every λ
        aggs = [F.sum("_s0").alias("s")]
        vals = [_shrink("s", "n", lam).alias(f"b{j}") for j, lam in enumerate(lambdas)]
    else:
        aggs = [F.sum(f"_s{j}").alias(f"s{j}") for j in range(L)]
        vals = [_shrink(f"s{j}", "n", lam).alias(f"b{j}") for j, lam in enumerate(lambdas)]
    grouped = cur.groupBy(spec.key).agg(F.sum("_n").alias("n"), *aggs)
    table, rows = _keep(grouped.select(spec.key, "n", *vals), f"{name}-{spec.name}", durable)
    return FittedEffect(spec, table, rows)


@dataclass
class GridStatistics:
    """What the fits of a chain need, whatever the λ."""

    mu: float
    first: DataFrame    # first key, n, s: rows and Σ (rating − mu)
    first_rows: int
    layout: Layout      # the rows by second key: later keys, _s0 = rating − mu, _m and _s1 = n and s of the first key
    counts: DataFrame   # rows of each pair of later keys' values
    codes: dict[str, DataFrame] = field(default_factory=dict)   # later keys of text that the rows hold as numbers: the number, the text


def grid_statistics(train: DataFrame, chain: tuple[EffectSpec, ...] = DEFAULT_CHAIN, rating_col: str = "rating", name: str = "grid",
                    keys: list[str] | None = None) -> GridStatistics:
    """The mean, the first key's sums, the rows laid out by the second key and the counts of the later ``keys``; all but the mean are written."""
    mu = global_mean(train, rating_col)
    one, two = chain[0].key, chain[1].key
    keys = [s.key for s in chain[2:]] if keys is None else keys
    plain, codes = train, {}
    for k in keys:
        if isinstance(train.schema[k].dataType, T.StringType) and k not in (one, two):
            train, numbered = _numbered(train, k, name)
            codes |= numbered
    rows = train.select(*dict.fromkeys([one, two, *keys]), (F.col(rating_col) - F.lit(mu)).alias("_s0"))
    first = materialize(rows.groupBy(one).agg(F.count(F.lit(1)).alias("n"), F.sum("_s0").alias("s")), f"{name}-{chain[0].name}-sums")
    n = first.count()
    side = first.select(one, F.col("n").alias("_m"), F.col("s").alias("_s1"))
    joined = lookup_join(rows, side, [one], "left", small_rows=n, weight_col="_m")
    laid = lay_out(joined.select(*dict.fromkeys([two, *keys]), "_s0", "_m", "_s1"), two, name=f"{name}-rows", sizes_of=plain)
    return GridStatistics(mu, first, n, laid, pair_counts(plain, keys, name), codes)


def _numbered(df: DataFrame, key: str, name: str) -> tuple[DataFrame, dict[str, DataFrame]]:
    """``df`` with a number for each text of ``key`` (NULL is one) and the table of both, if that may be broadcast: rows shuffle in fewer bytes."""
    table = materialize(df.groupBy(key).agg(F.count(F.lit(1)).alias("_w")).select(key, F.monotonically_increasing_id().alias("_code")), f"{name}-{key}-codes")
    n = table.count()
    if not can_broadcast(table, n):
        return df, {}
    return lookup_join(df, table, [key], "left", small_rows=n).drop(key).withColumnRenamed("_code", key), {key: table}


def effects_of(stats: GridStatistics, chain: tuple[EffectSpec, ...], lams: list[float], keys: list[str], name: str) -> tuple[list[FittedEffect], DataFrame]:
    """The first two effects at every λ, and the rows past both. The second key's sums and join read bucket by bucket."""
    values = [_shrink("s", "n", lam).alias(f"b{j}") for j, lam in enumerate(lams)]
    one = FittedEffect(chain[0], stats.first.select(chain[0].key, "n", *values), stats.first_rows, stats.first)
    two, layout = chain[1], stats.layout
    left = [F.col("_s0") - F.col("_s1") / (F.col("_m") + F.lit(lam)) for lam in lams]
    sums = group_parts(layout.parts, two.key, F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(f"s{j}") for j, c in enumerate(left)])
    table = align(sums.select(two.key, "n", *[_shrink(f"s{j}", "n", lam).alias(f"b{j}") for j, lam in enumerate(lams)]),
                  two.key, layout.buckets, f"{name}-{two.name}")
    past = join_parts(layout.parts, layout, table, {f"b{j}": f"_b{j}" for j in range(len(lams))})
    past = [p.select(*keys, F.lit(1).cast("long").alias("_n"), *[(c - F.col(f"_b{j}")).alias(f"_s{j}") for j, c in enumerate(left)]) for p in past]
    return [one, FittedEffect(two, table.bucketed.df, table.rows, aligned=table)], past[0].unionByName(past[1])


def _flagged(df: DataFrame, sets: list[tuple[str, ...]], keys: list[str], aggs: list) -> DataFrame:
    """One aggregate over the grouping ``sets`` of ``keys``; ``_g_<key>`` is 0 where the key belongs to the row's set."""
    return df.groupingSets([list(s) for s in sets], *keys).agg(*aggs, *[F.grouping(k).alias(f"_g_{k}") for k in keys])


def _set_of(df: DataFrame, chosen: tuple[str, ...], keys: list[str], values: list[str]) -> DataFrame:
    """The rows of one grouping set."""
    sel = F.lit(True)
    for k in keys:
        sel = sel & (F.col(f"_g_{k}") == F.lit(0 if k in chosen else 1))
    return df.where(sel).select(*chosen, *values)


def pair_counts(df: DataFrame, keys: list[str], name: str = "effect") -> DataFrame | None:
    """Rows of each pair of values of two of the ``keys``, from one pass; None for fewer than two keys."""
    pairs = [(a, b) for i, a in enumerate(keys) for b in keys[i + 1:]]
    if not pairs:
        return None
    return materialize(_flagged(df.select(*keys), pairs, keys, [F.count(F.lit(1)).alias("_n")]), f"{name}-pair-counts")


@dataclass
class Margins:
    """A residual's sums per value of each key, and how many rows each pair of values of two keys has.

    An effect of one key takes from another key's sums its values times those counts, so neither rows nor
    the keys' combinations are needed to go on: Σ (r − b[e]) over k = Σ r − Σ_e n(k, e) · b[e], exactly.
    """

    keys: list[str]
    sums: DataFrame                # keys, _n, _s0 …, one grouping set per key
    counts: DataFrame | None       # keys, _n, one grouping set per pair of keys
    width: int

    def past(self, key: str, effects: list[FittedEffect]) -> DataFrame:
        """``key``'s sums once these effects are taken: key, _n, _s0 …"""
        cols = [f"_s{j}" for j in range(self.width)]
        own = _set_of(self.sums, (key,), self.keys, ["_n", *cols])
        if not effects:
            return own
        out = own
        for e in effects:
            other = e.spec.key
            if other == key:
                met = own.select(key, "_n")
            else:
                met = _set_of(self.counts, tuple(k for k in self.keys if k in (key, other)), self.keys, ["_n"])
            side = e.table.select(other, *[F.col(f"b{j}").alias(f"_b{j}") for j in range(self.width)])
            taken = lookup_join(met, side, [other], "left", small_rows=e.rows)
            out = out.unionByName(taken.select(key, F.lit(0).cast("long").alias("_n"),
                                               *[(-F.col("_n") * F.col(f"_b{j}")).alias(f"_s{j}") for j in range(self.width)]))
        return out.groupBy(key).agg(F.sum("_n").alias("_n"), *[F.sum(c).alias(c) for c in cols])


def margins(cur: DataFrame, keys: list[str], width: int, counts: DataFrame | None, name: str = "effect",
            codes: dict[str, DataFrame] | None = None) -> Margins:
    """One pass over the residual, partial sums of one row per key value in each task. Keys that ``cur`` holds as numbers (``codes``) become texts again."""
    sums = _flagged(cur.select(*keys, "_n", *[f"_s{j}" for j in range(width)]), [(k,) for k in keys], keys,
                    [F.sum("_n").alias("_n"), *[F.sum(f"_s{j}").alias(f"_s{j}") for j in range(width)]])
    for k, table in (codes or {}).items():
        # A row of another key's set has no number, so no text either.
        sums = lookup_join(sums.withColumnRenamed(k, "_code"), table, ["_code"], "left", null_safe=False).drop("_code")
    return Margins(keys, materialize(sums, f"{name}-margins"), counts, width)


def effects_by_layout(layout: Layout, chain: tuple[EffectSpec, ...], lam: float, keys: list[str],
                      rating_col: str, name: str) -> tuple[float, list[FittedEffect], DataFrame]:
    """``mu``, the first two effects and the rows past both, from rows laid out by the second effect's key.

    The second key's sums and the join past them read bucket by bucket; the first key's join is ``lookup_join``'s.
    """
    one, two = chain[:2]
    mu = global_mean(layout.df, rating_col)
    needed = list(dict.fromkeys([one.key, two.key, *keys]))
    parts = [p.select(*needed, F.lit(1).cast("long").alias("_n"), (F.col(rating_col) - F.lit(mu)).alias("_s0")) for p in layout.parts]
    first = fit_effect(parts[0].unionByName(parts[1]), one, [lam], True, name)
    past = [_subtract(p, first, [lam], True) for p in parts]
    sums = group_parts(past, two.key, F.sum("_n").alias("n"), F.sum("_s0").alias("s"))
    table = align(sums.select(two.key, "n", _shrink("s", "n", lam).alias("b0")), two.key, layout.buckets, f"{name}-{two.name}")
    second = FittedEffect(two, table.bucketed.df, table.rows, aligned=table)
    past = [p.withColumn("_s0", F.col("_s0") - F.col("_n") * F.col("_b0")).drop("_b0")
            for p in join_parts(past, layout, table, {"b0": "_b0"})]
    return mu, [first, second], past[0].unionByName(past[1])


def fit_genres(cur: DataFrame, vocabulary: list[str], lambdas: list[float], genres_col: str,
               name: str = "effect", durable: bool = True) -> tuple[DataFrame, int]:
    """All genre effects on one common residual in one aggregate."""
    L = len(lambdas)
    spark = cur.sparkSession
    combos = cur.groupBy(genres_col).agg(F.sum("_n").alias("n"),
                                         *[F.sum(f"_s{j}").alias(f"s{j}") for j in range(L)])
    tokens = genre_tokens(genres_col)
    members = (combos.select("*", F.explode(F.array_distinct(tokens)).alias("genre"))
               .where(F.size(F.filter(tokens, lambda t: t == F.col("genre"))) == 1))
    per_genre = members.groupBy("genre").agg(F.sum("n").alias("n"),
                                              *[F.sum(f"s{j}").alias(f"s{j}") for j in range(L)])
    vocab = spark.createDataFrame([(g,) for g in vocabulary], "genre string")
    joined = vocab.join(per_genre, "genre", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    table = joined.select("genre", F.col("n").cast("long").alias("n"),
                          *[_shrink(f"s{j}", "n", lam).alias(f"g{j}") for j, lam in enumerate(lambdas)])
    return _keep(table, f"{name}-genres", durable)


def fit_effects(train: DataFrame, lambdas: list[float] | float = 0.0,
                chain: tuple[EffectSpec, ...] = DEFAULT_CHAIN, genres: bool = True,
                vocabulary: list[str] | None = None, exclude_genres: tuple[str, ...] = (),
                genres_col: str = "genres", rating_col: str = "rating",
                name: str = "model", row_steps: int = 2, statistics: GridStatistics | None = None, layout: Layout | None = None) -> BiasModel:
    """Fit ``mu``, the effect chain and the genre effects for every λ.

    The first ``row_steps`` effects run over rows; the rest over margins (``Margins``). Several λ take the first two
    from ``statistics`` (made here if they aren't given), if margins follow; one λ does so if they are given. One λ with a ``layout`` of the training
    rows by the second effect's key takes those two from it, without a shuffle on that key (``effects_by_layout``).
    """
    from .features import genre_vocabulary

    lams = [float(lambdas)] if isinstance(lambdas, (int, float)) else [float(x) for x in lambdas]
    L = len(lams)
    later = later_keys(chain, genres, row_steps, genres_col)
    if statistics is None and L > 1 and row_steps == 2 and len(chain) >= 2 and later:
        statistics = grid_statistics(train, chain, rating_col, name, later)
    by_layout = layout is not None and L == 1 and row_steps == 2 and len(chain) >= 2 and bool(later) and chain[1].key == layout.key
    if by_layout:
        mu, effects, past = effects_by_layout(layout, chain, lams[0], later, rating_col, name)
    else:
        mu = statistics.mu if statistics else global_mean(train, rating_col)
    model = BiasModel(mu, lams, genres_col=genres_col, rating_col=rating_col)
    needed = [rating_col] + [s.key for s in chain] + ([genres_col] if genres else [])
    cur = train.select(*dict.fromkeys(needed)).withColumns(
        {"_n": F.lit(1).cast("long"), "_s0": F.col(rating_col) - F.lit(mu)})
    shared = True
    held: list[DataFrame] = []
    if by_layout:
        model.effects, cur, shared = effects, past, False
    elif statistics:
        model.effects, cur = effects_of(statistics, chain, lams, later, name)
        shared = False
    for i, spec in enumerate(chain[:row_steps]):
        if i < len(model.effects):
            continue
        eff = fit_effect(cur, spec, lams, shared, name)
        # ``cur`` is now cached (the aggregate filled it): its parents can go.
        for df in held[:-1]:
            df.unpersist()
        held = held[-1:]
        model.effects.append(eff)
        cur = _subtract(cur, eff, lams, shared)
        shared = False
        # Persist only what the next effect reads twice (its sums and the
        # join past it), and only after a shuffle join or for a λ grid. What the
        # margins alone read is not held.
        if i + 1 < min(row_steps, len(chain)) and (L > 1 or not can_broadcast(eff.table, eff.rows)):
            cur = cur.persist(StorageLevel.MEMORY_AND_DISK)
            held.append(cur)
    if shared:  # no effect over rows: widen the single residual to every λ
        cur = cur.withColumns({f"_s{j}": F.col("_s0") for j in range(1, L)})
    summed = None
    if later and (len(chain) > row_steps or statistics or by_layout):
        summed = margins(cur, later, L, statistics.counts if statistics else pair_counts(train, later, name), name,
                         statistics.codes if statistics else None)
        for spec in chain[row_steps:]:
            model.effects.append(fit_effect(summed.past(spec.key, model.effects[row_steps:]), spec, lams, False, name, durable=False))
    if genres:
        vocab = vocabulary if vocabulary is not None else genre_vocabulary(train, genres_col)
        vocab = [g for g in vocab if g not in set(exclude_genres) and g not in (NO_GENRE, "")]
        cur = summed.past(genres_col, model.effects[row_steps:]) if summed else cur
        model.genres, model.genre_rows = fit_genres(cur, vocab, lams, genres_col, name, durable=summed is None)
    for df in held:
        df.unpersist()
    return model


def later_keys(chain: tuple[EffectSpec, ...], genres: bool, row_steps: int = 2, genres_col: str = "genres") -> list[str]:
    """The keys of what is fitted past the first ``row_steps`` effects."""
    return list(dict.fromkeys([s.key for s in chain[row_steps:]] + ([genres_col] if genres else [])))


def _subtract(cur: DataFrame, eff: FittedEffect, lambdas: list[float], shared: bool) -> DataFrame:
    """Carry the residual past one effect: ``_s{j} -= _n · b{j}[key]``."""
    L = len(lambdas)
    key = eff.spec.key
    side = eff.table.select(key, "n", *[F.col(f"b{j}").alias(f"_b{j}") for j in range(L)])
    out = lookup_join(cur, side, [key], "left", small_rows=eff.rows, weight_col="n").drop("n")
    src = (lambda j: "_s0") if shared else (lambda j: f"_s{j}")
    out = out.withColumns({f"_s{j}": F.col(src(j)) - F.col("_n") * F.col(f"_b{j}") for j in range(L)})
    return out.drop(*[f"_b{j}" for j in range(L)])


def _genre_terms(model: BiasModel, df: DataFrame) -> DataFrame:
    """Σ_g u_g·count_g and the rows (``_w``) of each distinct genre string of ``df``; written, since it is counted and joined."""
    L = model.width
    gc = model.genres_col
    combos = df.groupBy(gc).agg(F.count(F.lit(1)).alias("_w"))
    exploded = combos.select(gc, "_w", F.explode(genre_tokens(gc)).alias("genre"))
    eff = F.broadcast(model.genres) if can_broadcast(model.genres, model.genre_rows) else model.genres
    terms = (exploded.join(eff, "genre", "inner").groupBy(gc)
             .agg(F.max("_w").alias("_w"), *[F.sum(f"g{j}").alias(f"_G{j}") for j in range(L)]))
    return materialize(terms, "genre-terms")


def _genre_map_terms(model: BiasModel) -> list:
    """Per-row Σ_g u_g·count_g by folding the row's tokens over a literal map.

    Needs no pass over the input, so that a stream can be scored; the map is the
    genre effect table, held to the same byte bound as a broadcast.
    """
    if not can_broadcast(model.genres, model.genre_rows):
        raise ValueError("genre effects past the broadcast bound: score the stream in foreachBatch with genre_terms='join'")
    rows = model.genres.collect()
    out = []
    for j in range(model.width):
        m = F.create_map(*[x for r in rows for x in (F.lit(r["genre"]), F.lit(float(r[f"g{j}"])))]) \
            if rows else F.create_map().cast("map<string,double>")
        out.append(F.aggregate(genre_tokens(model.genres_col), F.lit(0.0), _adder(m)))
    return out


def _adder(m):
    return lambda acc, t: acc + F.coalesce(F.element_at(m, t), F.lit(0.0))


def predict(model: BiasModel, df: DataFrame, intercept: float | None = None,
            cumulative: bool = False, genre_terms: str = "join", layout: Layout | None = None) -> DataFrame:
    """Add ``pred`` (one λ) or ``pred0…`` (several) to ``df``.

    A row whose key has no fitted effect gets a NULL prediction (strict,
    like the reference). ``intercept`` replaces ``mu`` (T12). With
    ``cumulative`` the columns ``pred_m1 … pred_m{k}`` hold the prediction
    of every prefix of the chain (``pred_g`` adds genres), all from one pass.
    ``genre_terms="join"`` joins a per-genre-string table built from the
    input's distinct lists; ``"map"``, for streams alone, looks tokens up per
    row in the genre-effect map. A ``layout`` of the same rows by an effect's key takes that
    effect by a bucketed join (``df`` may then be ``layout.df``); the sum doesn't depend on the joins' order.
    """
    L = model.width
    mu = model.mu if intercept is None else float(intercept)
    out = df
    laid = next((e for e in model.effects if layout is not None and e.spec.key == layout.key), None)
    if laid is not None:
        parts = join_parts(layout.parts, layout, laid.aligned_to(layout), {f"b{j}": f"_{laid.spec.name}{j}" for j in range(L)})
        out = parts[0].unionByName(parts[1])
    late, spare = {}, []
    for e in model.effects:
        if e is laid:
            continue
        if e.sums is not None:   # two numbers travel through the later joins, not one for each λ
            names = {"n": f"_{e.spec.name}_n", "s": f"_{e.spec.name}_s"}
            side = e.sums.select(e.spec.key, *[F.col(c).alias(to) for c, to in names.items()])
            out = lookup_join(out, side, [e.spec.key], "left", small_rows=e.rows, weight_col=names["n"])
            late |= {f"_{e.spec.name}{j}": F.when(F.col(names["n"]).isNotNull(), _shrink(names["s"], names["n"], lam))
                     for j, lam in enumerate(model.lambdas)}
            spare += names.values()
            continue
        side = e.table.select(e.spec.key, F.col("n").alias("_lk_n"),
                              *[F.col(f"b{j}").alias(f"_{e.spec.name}{j}") for j in range(L)])
        out = lookup_join(out, side, [e.spec.key], "left", small_rows=e.rows, weight_col="_lk_n").drop("_lk_n")
    if model.genres is not None and genre_terms == "map":
        out = out.withColumns({f"_G{j}": t for j, t in enumerate(_genre_map_terms(model))})
    elif model.genres is not None:
        terms = _genre_terms(model, df)
        out = lookup_join(out, terms, [model.genres_col], "left", weight_col="_w").drop("_w")
        out = out.withColumns({f"_G{j}": F.coalesce(F.col(f"_G{j}"), F.lit(0.0)) for j in range(L)})
    out = out.withColumns(late) if late else out
    tmp = spare + [f"_{e.spec.name}{j}" for e in model.effects for j in range(L)]
    tmp += [f"_G{j}" for j in range(L)] if model.genres is not None else []
    cols = {}
    if cumulative:
        if L != 1:
            raise ValueError("cumulative predictions are for a single λ")
        acc = F.lit(mu)
        cols["pred_m1"] = acc
        for i, e in enumerate(model.effects, start=2):
            acc = acc + F.col(f"_{e.spec.name}0")
            cols[f"pred_m{i}"] = acc
        if model.genres is not None:
            cols["pred_g"] = acc + F.col("_G0")
    for j in range(L):
        p = F.lit(mu)
        for e in model.effects:
            p = p + F.col(f"_{e.spec.name}{j}")
        if model.genres is not None:
            p = p + F.col(f"_G{j}")
        cols["pred" if L == 1 else f"pred{j}"] = p
    return out.withColumns(cols).drop(*tmp)


def residuals(model: BiasModel, df: DataFrame, intercept: float | None = None) -> DataFrame:
    """``df`` with ``_s0`` = rating − model prediction and weight ``_n`` = 1 (single λ)."""
    if model.width != 1:
        raise ValueError("residuals are for a single λ")
    return predict(model, df, intercept).withColumns(
        {"_n": F.lit(1).cast("long"), "_s0": F.col(model.rating_col) - F.col("pred")}).drop("pred")


def save_model(model: BiasModel, path: str) -> None:
    """Persist a model as a directory of Parquet tables plus one JSON metadata row."""
    import json

    spark = (model.effects[0].table if model.effects else model.genres).sparkSession
    meta = {"mu": model.mu, "lambdas": model.lambdas, "genres_col": model.genres_col,
            "rating_col": model.rating_col, "chain": [[e.spec.name, e.spec.key] for e in model.effects],
            "has_genres": model.genres is not None}
    spark.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1) \
        .write.mode("overwrite").text(f"{path}/meta")
    for i, e in enumerate(model.effects):
        e.table.write.mode("overwrite").parquet(f"{path}/effect-{i}-{e.spec.name}")
    if model.genres is not None:
        model.genres.write.mode("overwrite").parquet(f"{path}/genres")


def load_model(spark, path: str) -> BiasModel:
    """Inverse of ``save_model``; table sizes are re-counted for the broadcast checks."""
    import json

    meta = json.loads(spark.read.text(f"{path}/meta").first()["value"])
    model = BiasModel(meta["mu"], meta["lambdas"], genres_col=meta["genres_col"], rating_col=meta["rating_col"])
    for i, (name, key) in enumerate(meta["chain"]):
        t = spark.read.parquet(f"{path}/effect-{i}-{name}")
        model.effects.append(FittedEffect(EffectSpec(name, key), t, t.count()))
    if meta["has_genres"]:
        model.genres = spark.read.parquet(f"{path}/genres")
        model.genre_rows = model.genres.count()
    return model
