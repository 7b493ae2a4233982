"""Pearson correlation matrix in long form and threshold pairs.

Two passes, no sort and no shuffle of rows: (1) count, mean, min, max per
column; (2) MLlib's Gramian of the *centred* columns, one packed k×k array per
partition added up by ``treeAggregate``, so the plan doesn't grow with k².
Centring on the exact means keeps the products small (no catastrophic
cancellation for ids or epoch seconds). There is one path for any number of
columns; the k×k result is what reaches the driver.

Equal rows may come once with a ``weight`` (their number): columns that
follow from a few keys are aggregated to those keys first, and the k² sums
run over the small table of cells.

R semantics: a constant column (min = max), any NULL or any NaN gives NA
(T4) — here NULL, on the diagonal too; nothing divides by zero under ANSI mode.
"""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def correlation_matrix(df: DataFrame, cols: list[str], weight: str | None = None) -> DataFrame:
    """(col_a, col_b, r) for every ordered pair, diagonal included."""
    x = {c: F.col(c).cast("double") for c in cols}
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    first = df.agg(F.sum(w).alias("n"),
                   *[F.count_if(x[c].isNull() | F.isnan(x[c])).alias(f"u_{i}") for i, c in enumerate(cols)],
                   *[F.sum(x[c] * w).alias(f"m_{i}") for i, c in enumerate(cols)],
                   *[(F.min(x[c]) == F.max(x[c])).alias(f"k_{i}") for i, c in enumerate(cols)]).first()
    n = first["n"] or 0
    usable = [n > 0 and not first[f"u_{i}"] and not first[f"k_{i}"] for i in range(len(cols))]
    keep = [i for i in range(len(cols)) if usable[i]]
    r: dict[tuple[int, int], float] = {}
    if len(keep) > 1:
        share = F.sqrt(w)
        centred = df.select(*[((x[cols[i]] - F.lit(first[f"m_{i}"] / n)) * share).alias(f"c{i}") for i in keep])
        vectors = VectorAssembler(inputCols=centred.columns, outputCol="v").transform(centred).select("v")
        gram = RowMatrix(MLUtils.convertVectorColumnsFromML(vectors, "v")).computeGramianMatrix().toArray()
        for p, i in enumerate(keep):
            for q, j in enumerate(keep):
                # Two roots: the product of two tiny sums would underflow.
                r[i, j] = 1.0 if i == j else float(gram[p, q] / (gram[p, p] ** 0.5 * gram[q, q] ** 0.5))
    elif keep:
        r[keep[0], keep[0]] = 1.0
    rows = [(a, b, r.get((i, j))) for i, a in enumerate(cols) for j, b in enumerate(cols)]
    return df.sparkSession.createDataFrame(rows, "col_a string, col_b string, r double")


def correlated_pairs(df: DataFrame, cols: list[str], threshold: float = 0.3, weight: str | None = None) -> DataFrame:
    """Unordered pairs (in ``cols`` order) with ``|r| > threshold``."""
    order = {c: i for i, c in enumerate(cols)}
    pos = F.create_map(*[x for c in cols for x in (F.lit(c), F.lit(order[c]))])
    m = correlation_matrix(df, cols, weight)
    return m.where((pos[F.col("col_a")] < pos[F.col("col_b")]) & (F.abs("r") > threshold))
