"""Property tests (Hypothesis): release-year rule and exact split shares on random inputs."""

import math
import re

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from shrinkfit.functions import release_year
from shrinkfit.operators import stratified_split

PIECES = st.sampled_from(["(", ")", " ", "1977", "19", "a", "x (y)", "(2001)", "( 1980 )", "(12.5)", "-", "()"])


def _rule(title: str):
    """The documented rule: the last non-greedy ( … ) group, digits (and spaces) only."""
    groups = re.findall(r"\((.*?)\)", title)
    if not groups or not re.fullmatch(r"\s*\d+\s*", groups[-1]):
        return None
    v = int(groups[-1].strip(" "))
    return v if v < 2 ** 31 else None


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(PIECES, min_size=0, max_size=8).map("".join), min_size=1, max_size=30))
def test_release_year_rule(spark, titles):
    df = spark.createDataFrame([(t,) for t in titles], "title string")
    got = [r["y"] for r in df.select(release_year("title").alias("y")).collect()]
    assert got == [_rule(t) for t in titles]


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.sampled_from([0.5 * k for k in range(1, 11)]), min_size=1, max_size=300),
       st.sampled_from([0.1, 0.2, 0.5, 0.9]), st.integers(min_value=1, max_value=99))
def test_split_share_exact(spark, ratings, p, seed):
    df = spark.createDataFrame([(f"r{i}", v) for i, v in enumerate(ratings)], "rk string, rating double")
    out = stratified_split(df, p, seed=seed, keep_stratum=True, bucket_rows=16)
    rows = out.groupBy("stratum").agg(F.count("*").alias("n"), F.count_if("is_test").alias("t")).collect()
    assert sum(r["n"] for r in rows) == len(ratings)
    for r in rows:
        assert r["t"] == math.ceil(r["n"] * p)
