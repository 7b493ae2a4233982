"""DuckDB SQL for every registered query (the correctness oracle).

Written independently of the Spark code path: plain CTE chains with window
``row_number`` for the split, λ as a joined column (long form) for the grid,
per-row token unnesting for genres. Shared prefixes are generated by the
helpers below; every double is rounded like ``queries.rounded``.
"""

from __future__ import annotations

import re

from ..functions.columns import lambda_values
from .queries import (DATE_COLS, EXCLUDED, FIXED_LAMBDA, GUARD_P, HEAD_ROWS, ID_COLS, MALFORMED_ABOVE, PAIR_THRESHOLD, PRICE_PROBS)

NO_GENRE = "(no genres listed)"
CHAIN = (("b_i", "movieId"), ("b_u", "userId"), ("b_ry", "release_year"),
         ("b_rat_y", "rating_year"), ("b_rat_wy", "rating_week_of_year"))
LAM_OUT = '"lambda"'  # reserved word in DuckDB lambda syntax: quoted
TOKENS = "string_split(coalesce({g}, ''), '|')"


def r6(expr: str) -> str:
    return f"round({expr}, 6) + 0.0"


def _last_paren(col: str) -> str:
    return f"regexp_extract_all({col}, '\\((.*?)\\)', 1)[-1]"


RATINGS = """ratings AS (
  SELECT concat_ws('-', CAST(l_orderkey AS VARCHAR), CAST(l_linenumber AS VARCHAR),
                   CAST(l_partkey AS VARCHAR), CAST(l_suppkey AS VARCHAR)) AS rk,
         o_custkey AS userId, l_partkey AS movieId, ceil(l_quantity / 5) / 2 AS rating,
         CAST(epoch(l_shipdate) AS BIGINT) AS ts
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""

MOVIES = f"""movies AS (
  SELECT p_partkey AS movieId,
         concat(p_name, ' (', p_brand, ') (', CAST(1950 + p_size AS VARCHAR), ')') AS title,
         CASE WHEN p_size = 50 THEN '{NO_GENRE}'
              ELSE concat_ws('|', concat('T-', p_type), split_part(p_name, ' ', 1), split_part(p_name, ' ', 2))
         END AS genres
  FROM part)"""

RELEASE_YEAR = (f"CASE WHEN regexp_matches({_last_paren('title')}, '^\\s*\\d+\\s*$') "
                f"THEN TRY_CAST(trim({_last_paren('title')}) AS INTEGER) END")

ML = """ml AS (
  SELECT r.rk, r.userId, r.movieId, r.rating, r.ts, m.title, m.genres
  FROM ratings r LEFT JOIN movies m ON r.movieId = m.movieId)"""

TS = "make_timestamp(ts * 1000000)"
DATE_PARTS = (f"CAST(year({TS}) AS INTEGER) AS rating_year, CAST(month({TS}) AS INTEGER) AS rating_month, "
              f"CAST(strftime({TS}, '%w') AS INTEGER) AS rating_day_of_week, "
              f"CAST(strftime({TS}, '%W') AS INTEGER) AS rating_week_of_year")

FEAT = f"""feat AS (
  SELECT rk, userId, movieId, rating, ts, title, genres, {RELEASE_YEAR} AS release_year, {DATE_PARTS}
  FROM ml)"""


def split_ctes(p: str, src: str, frac: float, seed: int = 1) -> list[str]:
    """``{p}_g``: ``src`` + is_test (exact per-stratum share, guarded) + moved_to_train."""
    q = "q"
    stratum = (f"1 + (CASE WHEN {q}[2] > {q}[1] AND {q}[2] < {q}[5] AND rating > {q}[2] THEN 1 ELSE 0 END)"
               f" + (CASE WHEN {q}[3] > {q}[1] AND {q}[3] < {q}[5] AND {q}[3] <> {q}[2] AND rating > {q}[3] THEN 1 ELSE 0 END)"
               f" + (CASE WHEN {q}[4] > {q}[1] AND {q}[4] < {q}[5] AND {q}[4] <> {q}[3] AND rating > {q}[4] THEN 1 ELSE 0 END)")
    return [
        f"{p}_q AS (SELECT quantile_cont(rating, [0.0, 0.25, 0.5, 0.75, 1.0]) AS q FROM {src})",
        f"{p}_s AS (SELECT s.*, CAST({stratum} AS INTEGER) AS stratum, md5(concat('{seed}:', rk)) AS h "
        f"FROM {src} s CROSS JOIN {p}_q)",
        f"{p}_r AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY h, rk) AS rn, "
        f"count(*) OVER (PARTITION BY stratum) AS ns FROM {p}_s)",
        f"{p}_f AS (SELECT * EXCLUDE (h, rn, ns), rn <= ceil(ns * {frac}) AS is_test0 FROM {p}_r)",
        f"{p}_m AS (SELECT movieId, bool_or(NOT is_test0) AS seen_m FROM {p}_f GROUP BY movieId)",
        f"{p}_u AS (SELECT userId, bool_or(NOT is_test0) AS seen_u FROM {p}_f GROUP BY userId)",
        f"{p}_g AS (SELECT f.* EXCLUDE (is_test0), "
        f"f.is_test0 AND coalesce(m.seen_m, false) AND coalesce(u.seen_u, false) AS is_test, "
        f"f.is_test0 AND NOT (coalesce(m.seen_m, false) AND coalesce(u.seen_u, false)) AS moved_to_train "
        f"FROM {p}_f f LEFT JOIN {p}_m m ON f.movieId IS NOT DISTINCT FROM m.movieId "
        f"LEFT JOIN {p}_u u ON f.userId IS NOT DISTINCT FROM u.userId)",
    ]


FEATURE_COLS = ("rk, userId, movieId, rating, ts, title, genres, release_year, rating_year, "
                "rating_month, rating_day_of_week, rating_week_of_year")


def prefix_ctes() -> list[str]:
    """ratings → features → holdout split → edx → edx split → edx_train / edx_test."""
    ctes = [RATINGS, MOVIES, ML, FEAT]
    ctes += split_ctes("s1", "feat", 0.1)
    ctes.append(f"edx AS (SELECT {FEATURE_COLS} FROM s1_g WHERE NOT is_test)")
    ctes.append(f"holdout AS (SELECT {FEATURE_COLS} FROM s1_g WHERE is_test)")
    ctes += split_ctes("s2", "edx", 0.2)
    ctes.append(f"edx_train AS (SELECT {FEATURE_COLS} FROM s2_g WHERE NOT is_test)")
    ctes.append(f"edx_test AS (SELECT {FEATURE_COLS} FROM s2_g WHERE is_test)")
    return ctes


def lam_cte(m: str, values: list[float] | None = None, from_sql: str | None = None) -> str:
    if from_sql:
        return f"{m}_lam AS ({from_sql})"
    lits = ", ".join(repr(float(v)) for v in values)
    return f"{m}_lam AS (SELECT unnest([{lits}]::DOUBLE[]) AS lam)"


def model_ctes(m: str, train: str, vocab_src: str = "edx", exclude: tuple[str, ...] | str = ()) -> list[str]:
    """Sequential shrunk means for each λ in ``{m}_lam``, then genre effects."""
    cols = "t.rk, t.movieId, t.userId, t.release_year, t.rating_year, t.rating_week_of_year, t.genres, t.rating"
    ctes = [
        f"{m}_mu AS (SELECT avg(rating) AS mu FROM {train})",
        f"{m}_n0 AS (SELECT *, row_number() OVER () AS rid FROM {train})",
        f"{m}_t0 AS (SELECT t.rid, {cols}, l.lam, t.rating - u.mu AS r "
        f"FROM {m}_n0 t CROSS JOIN {m}_mu u CROSS JOIN {m}_lam l)",
    ]
    for k, (_, key) in enumerate(CHAIN, start=1):
        ctes.append(f"{m}_e{k} AS (SELECT lam, {key}, count(*) AS n, sum(r) / (count(*) + lam) AS b "
                    f"FROM {m}_t{k - 1} GROUP BY lam, {key})")
        ctes.append(f"{m}_t{k} AS (SELECT t.* REPLACE (t.r - e.b AS r) FROM {m}_t{k - 1} t JOIN {m}_e{k} e "
                    f"ON t.lam = e.lam AND t.{key} IS NOT DISTINCT FROM e.{key})")
    last = len(CHAIN)
    ctes += [
        f"{m}_vocab AS (SELECT DISTINCT tok AS genre FROM (SELECT unnest({TOKENS.format(g='genres')}) AS tok "
        f"FROM {vocab_src}) WHERE tok <> '' AND tok <> '{NO_GENRE}'"
        + (f" AND tok NOT IN ({exclude if isinstance(exclude, str) else ', '.join(repr(g) for g in exclude)})" if exclude else "") + ")",
        f"{m}_tok AS (SELECT lam, rid, r, unnest({TOKENS.format(g='genres')}) AS genre FROM {m}_t{last})",
        f"{m}_mem AS (SELECT lam, rid, genre, any_value(r) AS r, count(*) AS c FROM {m}_tok "
        f"GROUP BY lam, rid, genre)",
        f"{m}_gs AS (SELECT lam, genre, count(*) AS n, sum(r) AS s FROM {m}_mem WHERE c = 1 "
        f"GROUP BY lam, genre)",
        f"{m}_ge AS (SELECT l.lam, v.genre, coalesce(g.n, 0) AS n, "
        f"CASE WHEN coalesce(g.n, 0) + l.lam > 0 THEN coalesce(g.s, 0) / (coalesce(g.n, 0) + l.lam) "
        f"ELSE 0.0 END AS b FROM {m}_vocab v CROSS JOIN {m}_lam l "
        f"LEFT JOIN {m}_gs g ON g.genre = v.genre AND g.lam = l.lam)",
    ]
    return ctes


def predict_ctes(m: str, test: str, out: str, intercept: str | None = None,
                 cumulative: bool = False) -> list[str]:
    """``out``: rk, userId, movieId, rating, lam, pred (+ pred_m1… if cumulative)."""
    mu = intercept or "u.mu"
    joins = " ".join(
        f"LEFT JOIN {m}_e{k} e{k} ON e{k}.lam = l.lam AND s.{key} IS NOT DISTINCT FROM e{k}.{key}"
        for k, (_, key) in enumerate(CHAIN, start=1))
    full = mu + "".join(f" + e{k}.b" for k in range(1, len(CHAIN) + 1)) + " + coalesce(G.G, 0)"
    extra = ""
    if cumulative:
        acc = mu
        parts = [f"{acc} AS pred_m1"]
        for k in range(1, len(CHAIN) + 1):
            acc = f"{acc} + e{k}.b"
            parts.append(f"{acc} AS pred_m{k + 1}")
        extra = ", " + ", ".join(parts)
    return [
        f"{out}_n AS (SELECT *, row_number() OVER () AS rid FROM {test})",
        f"{out}_G AS (SELECT x.rid, ge.lam, sum(ge.b) AS G FROM "
        f"(SELECT rid, unnest({TOKENS.format(g='genres')}) AS genre FROM {out}_n) x "
        f"JOIN {m}_ge ge ON ge.genre = x.genre GROUP BY x.rid, ge.lam)",
        f"{out} AS (SELECT s.rk, s.userId, s.movieId, s.rating, l.lam, {full} AS pred{extra} "
        f"FROM {out}_n s CROSS JOIN {m}_lam l CROSS JOIN {m}_mu u {joins} "
        f"LEFT JOIN {out}_G G ON G.rid = s.rid AND G.lam = l.lam)",
    ]


def strict_rmse(pred: str, obs: str = "rating") -> str:
    return f"CASE WHEN count({pred}) = count(*) THEN sqrt(avg(power({pred} - {obs}, 2))) END"


def rmse_cte(name: str, pred_table: str) -> str:
    return (f"{name} AS (SELECT lam, {strict_rmse('pred')} AS rmse, count(*) AS n, "
            f"count(*) - count(pred) AS n_unscored FROM {pred_table} GROUP BY lam)")


GRID = lambda_values()


def grid_ctes() -> list[str]:
    ctes = [lam_cte("gr", GRID)] + model_ctes("gr", "edx_train") + predict_ctes("gr", "edx_test", "gr_p")
    ctes.append(rmse_cte("gr_rmse", "gr_p"))
    ctes.append("best AS (SELECT lam, rmse FROM gr_rmse WHERE rmse IS NOT NULL "
                "ORDER BY round(rmse, 12), lam LIMIT 1)")
    return ctes


def with_(ctes: list[str], select: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n" + select


# ---- the queries -----------------------------------------------------------------------

def _genre_cells(src: str, keep: str) -> str:
    """One row per (row, vocabulary genre) with its token count; pivoted by the final SELECT.

    ``rid`` numbers the input rows so equal keys on two rows stay two rows.
    """
    return (f"numbered AS (SELECT *, row_number() OVER () AS rid FROM {src}), "
            f"cells AS (SELECT s.rid, {keep}, 'genres_' || regexp_replace(v.genre, '[^A-Za-z0-9]', '_', 'g') AS col, "
            f"CAST(len(list_filter({TOKENS.format(g='s.genres')}, lambda x: x = v.genre)) AS INTEGER) AS cnt "
            f"FROM numbered s CROSS JOIN vocab v)")


#: The fixture's genre tokens (part types, first and second word of part names).
FIXTURE_GENRES = ("T-ECONOMY", "T-LARGE", "T-MEDIUM", "T-PROMO", "T-SMALL", "T-STANDARD", "anvil", "blue", "bolt", "cold", "gear",
                  "gizmo", "hot", "large", "new", "old", "plate", "red", "ring", "rod", "small", "widget")


def _pivot(group_by: str) -> str:
    """A column for each fixture genre; a list of values, so that the statement can be a view."""
    names = ", ".join("'genres_" + re.sub("[^A-Za-z0-9]", "_", g) + "'" for g in FIXTURE_GENRES)
    return f"SELECT * EXCLUDE (rid) FROM (PIVOT cells ON col IN ({names}) USING first(cnt) GROUP BY rid, {group_by})"


def _vocab(src: str) -> str:
    return (f"vocab AS (SELECT DISTINCT tok AS genre FROM (SELECT unnest({TOKENS.format(g='genres')}) AS tok "
            f"FROM {src}) WHERE tok <> '' AND tok <> '{NO_GENRE}')")


def _corr_long(src: str, cols: list[str]) -> str:
    """Long correlation matrix from one aggregate, with R's NA rules."""
    aggs, rows = [], []
    for i, a in enumerate(cols):
        aggs.append(f"CASE WHEN count({a}) = count(*) AND stddev_pop(CAST({a} AS DOUBLE)) > 0 THEN 1.0 END AS r_{i}_{i}")
        for j in range(i + 1, len(cols)):
            b = cols[j]
            expr = (f"CASE WHEN stddev_pop(CAST({a} AS DOUBLE)) * stddev_pop(CAST({b} AS DOUBLE)) = 0 THEN NULL "
                    f"ELSE covar_pop(CAST({a} AS DOUBLE), CAST({b} AS DOUBLE)) / "
                    f"(stddev_pop(CAST({a} AS DOUBLE)) * stddev_pop(CAST({b} AS DOUBLE))) END")
            aggs.append(f"CASE WHEN count({a}) = count(*) AND count({b}) = count(*) THEN {expr} END AS r_{i}_{j}")
    for i, a in enumerate(cols):
        for j, b in enumerate(cols):
            rows.append(f"SELECT '{a}' AS col_a, '{b}' AS col_b, r_{min(i, j)}_{max(i, j)} AS r, "
                        f"{i} AS ia, {j} AS ib FROM w")
    return f"w AS (SELECT {', '.join(aggs)} FROM {src}), cm AS ({' UNION ALL '.join(rows)})"


# rating + one indicator per edx vocabulary genre, unpivoted, paired on the row key.
GENRE_CORR = (
    "gpos AS (SELECT genre, CAST(row_number() OVER (ORDER BY genre) AS INTEGER) AS pos FROM vocab), "
    "gtr AS (SELECT *, row_number() OVER () AS rid FROM edx_train), "
    "gv AS (SELECT rid, 'rating' AS col, 0 AS pos, CAST(rating AS DOUBLE) AS x FROM gtr UNION ALL "
    "SELECT t.rid, 'genres_' || regexp_replace(v.genre, '[^A-Za-z0-9]', '_', 'g') AS col, v.pos, "
    f"CAST(len(list_filter({TOKENS.format(g='t.genres')}, lambda x: x = v.genre)) AS DOUBLE) AS x "
    "FROM gtr t CROSS JOIN gpos v), "
    "gsd AS (SELECT col, stddev_pop(x) AS sd FROM gv GROUP BY col), "
    "gpair AS (SELECT a.col AS col_a, b.col AS col_b, a.pos AS ia, b.pos AS ib, covar_pop(a.x, b.x) AS cv "
    "FROM gv a JOIN gv b ON a.rid = b.rid GROUP BY a.col, b.col, a.pos, b.pos), "
    "gcm AS (SELECT p.col_a, p.col_b, p.ia, p.ib, CASE WHEN p.col_a = p.col_b THEN "
    "(CASE WHEN sa.sd > 0 THEN 1.0 END) WHEN sa.sd * sb.sd = 0 THEN NULL ELSE p.cv / (sa.sd * sb.sd) END AS r "
    "FROM gpair p JOIN gsd sa ON sa.col = p.col_a JOIN gsd sb ON sb.col = p.col_b)"
)


# One round: each end's rank (mean, pairs, name); the lower end of a pair is beaten and stays for now.
def _exclusion_round(edges: str, step: str) -> str:
    ranked = (f"SELECT label, CAST(sum(m) // count(*) AS BIGINT) AS mean, count(*) AS k FROM "
              f"(SELECT a AS label, m FROM ({edges}) UNION ALL SELECT b, m FROM ({edges})) GROUP BY label")
    pairs = (f"SELECT e.a, e.b, e.m, (x.mean < y.mean OR (x.mean = y.mean AND (x.k < y.k OR (x.k = y.k AND e.a < e.b)))) AS a_lower "
             f"FROM ({edges}) e JOIN ({ranked}) x ON x.label = e.a JOIN ({ranked}) y ON y.label = e.b")
    beaten = f"SELECT CASE WHEN a_lower THEN a ELSE b END AS label FROM ({pairs})"
    return (f"SELECT {step} AS step, p.a, p.b, p.m, p.a NOT IN ({beaten}) AS la, p.b NOT IN ({beaten}) AS lb, "
            f"x.mean AS ma, y.mean AS mb FROM ({pairs}) p JOIN ({ranked}) x ON x.label = p.a JOIN ({ranked}) y ON y.label = p.b")


def exclusion_ctes() -> list[str]:
    """``xl``: label, round, mean (millionths) of the genres that leave."""
    later = "SELECT a, b, m FROM xr WHERE NOT la AND NOT lb"
    return [
        "xp AS (SELECT ga.genre AS a, gb.genre AS b, CAST(round(abs(c.r) * 1000000) AS BIGINT) AS m FROM gcm c "
        f"JOIN gpos ga ON ga.pos = c.ia JOIN gpos gb ON gb.pos = c.ib WHERE c.ia < c.ib AND abs(c.r) > {PAIR_THRESHOLD})",
        f"xr(step, a, b, m, la, lb, ma, mb) AS ({_exclusion_round('SELECT a, b, m FROM xp', '1')} UNION ALL "
        f"{_exclusion_round(later, '(SELECT max(step) FROM xr) + 1')})",
        "xl AS (SELECT DISTINCT a AS label, step, ma AS mean FROM xr WHERE la UNION SELECT DISTINCT b, step, mb FROM xr WHERE lb)",
    ]


def oracle_queries() -> dict[str, str]:
    base = [RATINGS, MOVIES, ML]
    pre = prefix_ctes()
    q: dict[str, str] = {}

    q["ratings_enriched"] = with_(base, f"SELECT rk, userId, movieId, {r6('rating')} AS rating, ts, title, genres FROM ml")
    q["release_year"] = with_([MOVIES], f"SELECT movieId, title, {RELEASE_YEAR} AS release_year FROM movies")
    q["rating_date_parts"] = with_([RATINGS], f"SELECT rk, ts, {DATE_PARTS} FROM ratings")
    q["feature_table"] = with_(base + [FEAT], f"SELECT rk, userId, movieId, {r6('rating')} AS rating, ts, title, genres, "
                               "release_year, rating_year, rating_month, rating_day_of_week, rating_week_of_year FROM feat")
    q["genre_explode"] = with_(base, "SELECT rk, movieId, unnest(string_split(coalesce(genres, ''), '|')) AS genre FROM ml")
    q["genre_vocabulary"] = with_(base + [_vocab("ml")],
                                  "SELECT genre, 'genres_' || regexp_replace(genre, '[^A-Za-z0-9]', '_', 'g') AS column_name FROM vocab")
    q["genre_indicators"] = with_(base + [_vocab("ml"), _genre_cells("ml", "s.rk")], _pivot("rk"))
    q["regroup_first_sum"] = with_(
        base + [_vocab("ml"), _genre_cells("ml", f"s.rk, s.userId, s.movieId, {r6('s.rating')} AS rating")],
        _pivot("rk, userId, movieId, rating"))
    q["delimited_roundtrip"] = with_([RATINGS], f"SELECT userId, movieId, {r6('rating')} AS rating, ts AS timestamp FROM ratings")
    q["movies_roundtrip"] = with_([MOVIES], "SELECT movieId, title, genres FROM movies")
    q["quarantined_lines"] = with_([RATINGS], "SELECT 'ratings' AS source, concat_ws('::', '?', CAST(movieId AS VARCHAR), CAST(rating AS VARCHAR), "
                                   f"CAST(ts AS VARCHAR)) AS line, 'userId' AS reason FROM ratings WHERE rating > {MALFORMED_ABOVE}")
    q["sql_features"] = with_(base + [FEAT], "SELECT rk, release_year, rating_year, rating_month, rating_day_of_week, rating_week_of_year, CAST(len("
                              f"list_filter({TOKENS.format(g='genres')}, lambda x: x <> '' AND x <> '{NO_GENRE}')) AS INTEGER) AS n_labels FROM feat")
    q["malformed_lines"] = with_([RATINGS], f"SELECT count(*) AS n_rows, count_if(rating > {MALFORMED_ABOVE}) AS n_malformed FROM ratings")
    q["csv_roundtrip"] = with_(base + [_vocab("ml"), _genre_cells("ml", f"s.rk, s.movieId, {r6('s.rating')} AS rating")],
                               _pivot("rk, movieId, rating"))
    q["head_sample"] = with_(pre, f"SELECT rk, userId, movieId, {r6('rating')} AS rating, title, genres FROM edx "
                                  f"ORDER BY rk LIMIT {HEAD_ROWS}")

    q["stratified_split"] = with_(base + [FEAT] + split_ctes("sp", "feat", 0.1),
                                  f"SELECT rk, {r6('rating')} AS rating, stratum, is_test0 AS is_test FROM sp_f")
    guard = base + [FEAT] + split_ctes("sg", "feat", GUARD_P)
    q["guarded_train_test"] = with_(guard, "SELECT rk, is_test, moved_to_train FROM sg_g")
    q["seen_key_semi"] = with_(guard, f"SELECT rk, userId, movieId, {r6('rating')} AS rating FROM sg_g WHERE is_test")
    q["seen_key_removed"] = with_(guard, f"SELECT rk, userId, movieId, {r6('rating')} AS rating FROM sg_g WHERE moved_to_train")
    q["reloaded_split"] = with_(pre, "SELECT rk, is_test, moved_to_train FROM s1_g")
    share = ("SELECT count(*) AS n_total, count_if(is_test) AS n_test, count(*) - count_if(is_test) AS n_train, "
             "{t} AS test_pct, {r} AS train_pct, '{name}' AS split FROM {src}")
    pct_t = r6("count_if(is_test) / count(*) * 100")
    pct_r = r6("(count(*) - count_if(is_test)) / count(*) * 100")
    q["split_share"] = with_(pre, share.format(t=pct_t, r=pct_r, name="holdout", src="s1_g") + " UNION ALL "
                             + share.format(t=pct_t, r=pct_r, name="edx_test", src="s2_g"))
    q["price_quantiles"] = " UNION ALL ".join(
        f"SELECT {x}::DOUBLE AS prob, {r6(f'quantile_cont(l_extendedprice::DOUBLE, {x})')} AS price FROM lineitem" for x in PRICE_PROBS)
    breaks = ", ".join(f"quantile_cont(l_extendedprice::DOUBLE, {x}) AS b{i}" for i, x in enumerate((0.25, 0.5, 0.75)))
    q["price_strata"] = f"""WITH b AS (SELECT {breaks} FROM lineitem),
s AS (SELECT l_extendedprice::DOUBLE AS p, (1 + (p > b0)::INTEGER + (p > b1)::INTEGER + (p > b2)::INTEGER)::INTEGER AS stratum FROM lineitem, b)
SELECT stratum, count(*) AS n, {r6('min(p)')} AS low, {r6('max(p)')} AS high FROM s GROUP BY stratum"""
    q["edx_train_test"] = with_(pre, "SELECT rk, 'edx_train' AS part FROM edx_train UNION ALL "
                                     "SELECT rk, 'edx_test' AS part FROM edx_test UNION ALL "
                                     "SELECT rk, 'holdout' AS part FROM holdout")

    m0 = pre + [lam_cte("m0", [0.0])] + model_ctes("m0", "edx_train")
    for k, (name, key) in enumerate(CHAIN, start=1):
        qname = {"b_i": "movie_effect", "b_u": "user_effect", "b_ry": "release_year_effect",
                 "b_rat_y": "rating_year_effect", "b_rat_wy": "rating_week_effect"}[name]
        q[qname] = with_(m0, f"SELECT {key}, {r6('b')} AS {name}, n FROM m0_e{k}")
    q["genre_effects"] = with_(m0, f"SELECT genre, {r6('b')} AS b_g, CAST(n AS BIGINT) AS n FROM m0_ge")

    seq = m0 + predict_ctes("m0", "edx_test", "m0_p", cumulative=True)
    labels = ["Model 1: mean", "Model 2: + movie", "Model 3: + user", "Model 4: + release year",
              "Model 5: + rating year + rating week", "Model 6: + genres"]
    preds = ["pred_m1", "pred_m2", "pred_m3", "pred_m4", "pred_m6", "pred"]
    seq_sel = " UNION ALL ".join(
        f"SELECT {i + 1} AS seq, '{labels[i]}' AS method, {strict_rmse(preds[i])} AS rmse FROM m0_p"
        for i in range(6))
    q["model_sequence"] = with_(seq + [f"ms AS ({seq_sel})"], f"SELECT seq, method, {r6('rmse')} AS rmse FROM ms")

    # The same without some genres, and at a fixed lambda; the splits don't change.
    mx = pre + [lam_cte("mx", [0.0])] + model_ctes("mx", "edx_train", exclude=EXCLUDED)
    q["genre_effects_excluded"] = with_(mx, f"SELECT genre, {r6('b')} AS b_g, CAST(n AS BIGINT) AS n FROM mx_ge")
    mx_sel = " UNION ALL ".join(
        f"SELECT {i + 1} AS seq, '{labels[i]}' AS method, {strict_rmse(preds[i])} AS rmse FROM mx_p"
        for i in range(6))
    q["model_sequence_excluded"] = with_(mx + predict_ctes("mx", "edx_test", "mx_p", cumulative=True) + [f"ms AS ({mx_sel})"],
                                         f"SELECT seq, method, {r6('rmse')} AS rmse FROM ms")
    fe = pre + [lam_cte("fe", [FIXED_LAMBDA])] + model_ctes("fe", "edx_train", exclude=EXCLUDED) \
        + predict_ctes("fe", "edx_test", "fe_p") + [rmse_cte("fe_rmse", "fe_p")]
    q["model7_excluded"] = with_(fe, f"SELECT {r6('lam')} AS {LAM_OUT}, {r6('rmse')} AS rmse, n, n_unscored FROM fe_rmse")
    q["dense_row_id"] = with_(base, "SELECT rk, row_number() OVER (ORDER BY rk) AS row_id FROM ml")
    q["prefix_columns"] = with_(base + [FEAT], "SELECT rk, rating_year, rating_month, rating_day_of_week, rating_week_of_year FROM feat")

    # Ablation: each candidate alone on top of the Model 4 residual.
    abl = list(m0)
    cands = ["rating_year", "rating_month", "rating_week_of_year", "rating_day_of_week"]
    abl.append("ab_r AS (SELECT t.*, t.rating - u.mu - e1.b - e2.b - e3.b AS r FROM edx_train t CROSS JOIN m0_mu u "
               "LEFT JOIN m0_e1 e1 ON t.movieId IS NOT DISTINCT FROM e1.movieId "
               "LEFT JOIN m0_e2 e2 ON t.userId IS NOT DISTINCT FROM e2.userId "
               "LEFT JOIN m0_e3 e3 ON t.release_year IS NOT DISTINCT FROM e3.release_year)")
    for c in cands:
        abl.append(f"ab_{c} AS (SELECT {c}, sum(r) / count(*) AS b FROM ab_r GROUP BY {c})")
    abl.append("ab_p AS (SELECT t.*, u.mu + e1.b + e2.b + e3.b AS pred FROM edx_test t CROSS JOIN m0_mu u "
               "LEFT JOIN m0_e1 e1 ON t.movieId IS NOT DISTINCT FROM e1.movieId "
               "LEFT JOIN m0_e2 e2 ON t.userId IS NOT DISTINCT FROM e2.userId "
               "LEFT JOIN m0_e3 e3 ON t.release_year IS NOT DISTINCT FROM e3.release_year)")
    sel = []
    for c in cands:
        abl.append(f"ab_s_{c} AS (SELECT p.rating, p.pred, p.pred + a.b AS pc FROM ab_p p "
                   f"LEFT JOIN ab_{c} a ON p.{c} IS NOT DISTINCT FROM a.{c})")
        sel.append(f"SELECT '{c}' AS candidate, {strict_rmse('pc')} AS rmse, {strict_rmse('pred')} AS base_rmse "
                   f"FROM ab_s_{c}")
    abl.append(f"ab AS ({' UNION ALL '.join(sel)})")
    names = {"rating_year": "b_rat_y", "rating_month": "b_rat_m", "rating_week_of_year": "b_rat_wy", "rating_day_of_week": "b_rat_dw"}
    q["candidate_effects"] = with_(m0 + [c for c in abl if c.startswith("ab_r AS")], " UNION ALL ".join(
        f"SELECT '{names[c]}' AS effect, CAST({c} AS VARCHAR) AS key, {r6('sum(r) / count(*)')} AS b, count(*) AS n "
        f"FROM ab_r GROUP BY {c}" for c in cands))
    q["ablation_rating_date"] = with_(abl, f"SELECT candidate, {r6('rmse')} AS rmse, {r6('base_rmse')} AS base_rmse, "
                                           f"{r6('rmse - base_rmse')} AS delta_vs_base, rmse - base_rmse < 0 AS improves FROM ab")

    fx = pre + [lam_cte("fx", [FIXED_LAMBDA])] + model_ctes("fx", "edx_train") + predict_ctes("fx", "edx_test", "fx_p")
    fx.append(rmse_cte("fx_rmse", "fx_p"))
    q["model7_fixed_lambda"] = with_(fx, f"SELECT {r6('lam')} AS {LAM_OUT}, {r6('rmse')} AS rmse, n, n_unscored FROM fx_rmse")

    q["sql_predictions"] = with_(fx, f"SELECT rk, userId, movieId, {r6('rating')} AS rating, {r6('pred')} AS pred FROM fx_p")
    q["copartitioned_predictions"] = with_(fx, f"SELECT rk, userId, movieId, {r6('rating')} AS rating, {r6('pred')} AS pred FROM fx_p")

    parts = [f"SELECT '{name}' AS effect, CAST({key} AS VARCHAR) AS key, {r6('b')} AS b, n FROM fx_e{k}"
             for k, (name, key) in enumerate(CHAIN, start=1)]
    parts.append(f"SELECT 'b_g' AS effect, genre AS key, {r6('b')} AS b, CAST(n AS BIGINT) AS n FROM fx_ge")
    q["regularised_effects"] = with_(pre + [lam_cte("fx", [FIXED_LAMBDA])] + model_ctes("fx", "edx_train"), " UNION ALL ".join(parts))

    grid = pre + grid_ctes()
    q["lambda_grid"] = with_(grid, f"SELECT {r6('lam')} AS {LAM_OUT}, {r6('rmse')} AS rmse, n_unscored FROM gr_rmse")
    q["best_lambda"] = with_(grid, f"SELECT {r6('lam')} AS {LAM_OUT}, {r6('rmse')} AS rmse FROM best")

    m7 = grid + [lam_cte("m7", from_sql="SELECT lam FROM best")] + model_ctes("m7", "edx_train") \
        + predict_ctes("m7", "edx_test", "m7_p")
    q["model7_predictions"] = with_(m7, f"SELECT rk, userId, movieId, {r6('rating')} AS rating, {r6('pred')} AS pred FROM m7_p")
    lb = seq + [c for c in m7 if c not in seq] + [rmse_cte("m7_rmse", "m7_p"), f"ms AS ({seq_sel})"]
    lb.append("lb AS (SELECT seq, method, rmse FROM ms UNION ALL "
              "SELECT 7 AS seq, 'Model 7: regularised Model 6' AS method, rmse FROM m7_rmse)")
    q["leaderboard"] = with_(lb, f"SELECT seq, method, {r6('rmse')} AS rmse, "
                                 f"{r6('(lag(rmse) OVER (ORDER BY seq) - rmse) / lag(rmse) OVER (ORDER BY seq) * 100')} "
                                 f"AS drop_pct FROM lb")

    fin = grid + [lam_cte("fm", from_sql="SELECT lam FROM best")] + model_ctes("fm", "edx")
    fin_a = fin + predict_ctes("fm", "holdout", "fm_p") + [rmse_cte("fm_rmse", "fm_p")]
    q["final_holdout_rmse"] = with_(fin_a, f"SELECT {r6('lam')} AS {LAM_OUT}, {r6('rmse')} AS rmse, n, n_unscored FROM fm_rmse")
    fin_b = fin + ["m0_mu AS (SELECT avg(rating) AS mu FROM edx_train)"] \
        + predict_ctes("fm", "holdout", "fr_p", intercept="(SELECT mu FROM m0_mu)") + [rmse_cte("fr_rmse", "fr_p")]
    q["final_holdout_rmse_ref_intercept"] = with_(
        fin_b, f"SELECT {r6('lam')} AS {LAM_OUT}, {r6('rmse')} AS rmse, n, n_unscored FROM fr_rmse")

    q["corr_ids"] = with_(pre + [_corr_long("edx", ID_COLS)], f"SELECT col_a, col_b, {r6('r')} AS r FROM cm")
    q["corr_date_parts"] = with_(pre + [_corr_long("edx_train", DATE_COLS)], f"SELECT col_a, col_b, {r6('r')} AS r FROM cm")
    gc = pre + [_vocab("edx"), GENRE_CORR]
    q["corr_genres"] = with_(gc, f"SELECT col_a, col_b, {r6('r')} AS r FROM gcm")
    q["correlated_pairs"] = with_(gc, f"SELECT col_a, col_b, {r6('r')} AS r FROM gcm "
                                      f"WHERE ia < ib AND abs(r) > {PAIR_THRESHOLD}")
    xc = gc + exclusion_ctes()
    q["excluded_genres"] = with_(xc, f"SELECT label AS genre, CAST(step AS INTEGER) AS round, {r6('mean / 1000000')} AS mean_r FROM xl") \
        .replace("WITH ", "WITH RECURSIVE ", 1)
    ax = xc + [lam_cte("ax", [FIXED_LAMBDA])] + model_ctes("ax", "edx_train", exclude="SELECT label FROM xl") \
        + predict_ctes("ax", "edx_test", "ax_p") + [rmse_cte("ax_rmse", "ax_p")]
    q["model7_auto_excluded"] = with_(ax, f"SELECT {r6('lam')} AS {LAM_OUT}, {r6('rmse')} AS rmse, n, n_unscored FROM ax_rmse") \
        .replace("WITH ", "WITH RECURSIVE ", 1)
    return q
