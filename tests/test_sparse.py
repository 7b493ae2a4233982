"""Correlated pairs from sparse counts, and the labels to leave out."""

import random

import pytest

from shrinkfit.operators import correlated_pairs, genre_indicators
from shrinkfit.operators.sparse import exclude_correlated, sparse_correlated_pairs


def _dense(df, vocabulary, threshold):
    ind = genre_indicators(df, vocabulary)
    cols = ["rating"] + [f"genres_{g}" for g in vocabulary]
    return {(r.col_a.removeprefix("genres_"), r.col_b.removeprefix("genres_")): r.r for r in correlated_pairs(ind, cols, threshold).collect()}


@pytest.mark.parametrize("threshold", [0.02, 0.08, 0.6])
def test_equals_the_dense_form(spark, threshold):
    rng = random.Random(5)
    vocabulary = [f"g{i:02d}" for i in range(12)]
    weights = [30, 20, 9, 5, 5, 3, 2, 1, 1, 1, 1, 1]
    rows = [(rng.randrange(10) / 2, rng.choice([None, "", "(no genres listed)"]) if i % 17 == 0
             else "|".join(rng.choices(vocabulary, weights, k=rng.randrange(1, 5)))) for i in range(500)]
    df = spark.createDataFrame(rows, "rating double, genres string")
    got = {(r.a, r.b): r.r for r in sparse_correlated_pairs(df, threshold).collect()}
    assert got == pytest.approx(_dense(df, vocabulary, threshold)) and (got or threshold > 0.05)


def test_pairs_that_never_meet(spark):
    df = spark.createDataFrame([(1.0, "x")] * 5 + [(2.0, "y")] * 4 + [(1.5, "z")], "rating double, genres string")
    got = {(r.a, r.b): r.r for r in sparse_correlated_pairs(df, 0.25).collect()}
    assert got == pytest.approx(_dense(df, ["x", "y", "z"], 0.25)) and got["x", "y"] < -0.8 and ("x", "z") in got


def test_constant_null_and_empty(spark):
    schema = "rating double, genres string"
    df = spark.createDataFrame([(1.0, "all|x"), (None, "all"), (2.0, "all|x")], schema)
    assert sparse_correlated_pairs(df, 0.1).collect() == []       # "all" is constant, the rating has a NULL
    assert sparse_correlated_pairs(df.where("rating > 9"), 0.1).collect() == []
    with pytest.raises(ValueError):
        sparse_correlated_pairs(df, 0.0)


def test_many_labels_and_no_table_of_all_pairs(spark):
    df = spark.range(20000).selectExpr("CAST(id % 7 AS DOUBLE) AS rating", "concat_ws('|', 'a' || id % 5000, 'b' || id % 2500) AS genres")
    got = sparse_correlated_pairs(df, 0.5)
    assert got.count() == 5000 and got.where("r < 0.7").isEmpty()


def _plain(edges):
    """The rounds in plain Python."""
    edges, gone, step = {frozenset((a, b)): round(abs(r) * 1e6) for a, b, r in edges}, {}, 0
    while edges:
        step += 1
        of = {}
        for pair, m in edges.items():
            for v in pair:
                of.setdefault(v, []).append(m)
        rank = {v: (sum(ms) // len(ms), len(ms), v) for v, ms in of.items()}
        leaves = {v for v in rank if all(rank[v] > rank[u] for pair in edges if v in pair for u in pair - {v})}
        gone.update({v: step for v in leaves})
        edges = {p: m for p, m in edges.items() if not p & leaves}
    return gone


def test_exclusion_equals_the_plain_rounds(spark):
    rng = random.Random(2)
    names = [f"n{i}" for i in range(14)]
    edges = [(a, b, rng.choice([-1, 1]) * rng.choice([0.3, 0.5, 0.5, 0.7, 0.9])) for i, a in enumerate(names) for b in names[i + 1:] if rng.random() < 0.25]
    got = {r.label: r.round for r in exclude_correlated(spark.createDataFrame(edges, "a string, b string, r double")).collect()}
    assert got == _plain(edges) and all(a in got or b in got for a, b, _ in edges)


def test_exclusion_of_nothing(spark):
    got = exclude_correlated(spark.createDataFrame([], "a string, b string, r double"))
    assert got.columns == ["label", "round", "mean_r"] and got.collect() == []
