"""Correlation matrix (A9, M15, T4): narrow and wide paths, NA rules."""

import numpy as np
import pytest

from shrinkfit.operators import correlated_pairs, correlation_matrix


def _frame(spark, n=400):
    rows = [(float(i % 7), float((i * 3) % 11), float(i % 7) * 2 + (i % 3), 5.0, 1700000000.0 + i)
            for i in range(n)]
    return spark.createDataFrame(rows, "a double, b double, c double, k double, t double")


def _numpy_corr(rows, i, j):
    import numpy as np
    x = np.array([r[i] for r in rows])
    y = np.array([r[j] for r in rows])
    return float(np.corrcoef(x, y)[0, 1])


def test_narrow_matches_numpy_and_constant_is_null(spark):
    df = _frame(spark)
    rows = df.collect()
    m = {(r["col_a"], r["col_b"]): r["r"] for r in correlation_matrix(df, ["a", "b", "c", "k", "t"]).collect()}
    assert m[("a", "c")] == pytest.approx(_numpy_corr(rows, 0, 2), abs=1e-12)
    assert m[("c", "a")] == m[("a", "c")]
    assert m[("a", "t")] == pytest.approx(_numpy_corr(rows, 0, 4), abs=1e-9)   # large magnitudes, centred
    assert m[("a", "a")] == 1.0
    assert m[("k", "a")] is None and m[("k", "k")] is None                      # constant column (T4)


def test_wide_path_equals_narrow(spark):
    df = _frame(spark)
    cols = ["a", "b", "c", "k", "t"]
    narrow = {(r["col_a"], r["col_b"]): r["r"] for r in correlation_matrix(df, cols).collect()}
    wide_cols = cols + [f"x{i}" for i in range(6)]
    from pyspark.sql import functions as F
    wdf = df.select("*", *[(F.col("a") * i + F.col("b")).alias(f"x{i}") for i in range(6)])
    wide = {(r["col_a"], r["col_b"]): r["r"] for r in correlation_matrix(wdf, wide_cols).collect()}
    for k, v in narrow.items():
        assert (wide[k] is None and v is None) or wide[k] == pytest.approx(v, abs=1e-12)
    assert len(wide) == len(wide_cols) ** 2


def test_null_column_gives_null(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, None), (3.0, 1.0)], "a double, b double")
    m = {(r["col_a"], r["col_b"]): r["r"] for r in correlation_matrix(df, ["a", "b"]).collect()}
    assert m[("a", "b")] is None and m[("a", "a")] == 1.0


def test_pairs_threshold(spark):
    df = _frame(spark)
    pairs = {(r["col_a"], r["col_b"]) for r in correlated_pairs(df, ["a", "b", "c"], 0.3).collect()}
    assert pairs == {("a", "c")}


@pytest.mark.parametrize("extra", [2, 8])
def test_one_rule_for_any_number_of_columns(spark, extra):
    cols = ["a", "tiny", "nan"] + [f"x{i}" for i in range(extra)]
    rows = [(float(i), 1e-7 * ((i * 7) % 11), float("nan") if i == 3 else float(i), *[float((i * (k + 3)) % 13) for k in range(extra)]) for i in range(40)]
    got = {(r.col_a, r.col_b): r.r for r in correlation_matrix(spark.createDataFrame(rows, cols), cols).collect()}
    want = np.corrcoef(np.array(rows, dtype=float).T)
    for i, a in enumerate(cols):
        for j, b in enumerate(cols):
            if "nan" in (a, b):
                assert got[a, b] is None
            else:
                assert got[a, b] == pytest.approx(want[i, j], abs=1e-9)


def test_weighted_rows_equal_repeated_rows(spark):
    cells = spark.createDataFrame([(1.0, 2.0, 3), (2.0, 1.0, 1), (4.0, 5.0, 2)], "a double, b double, n int")
    rows = spark.createDataFrame([(1.0, 2.0)] * 3 + [(2.0, 1.0)] + [(4.0, 5.0)] * 2, "a double, b double")
    r = lambda df, **k: {(x.col_a, x.col_b): x.r for x in correlation_matrix(df, ["a", "b"], **k).collect()}
    assert r(cells, weight="n") == pytest.approx(r(rows))
