"""Standard scores and variance inflation factors: one distributed pass, then algebra of features x features."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def scaler(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row: mean and population deviation of each column; a constant column's deviation is 1."""
    aggs = []
    for c in columns:
        aggs += [F.avg(c).alias(f"{c}__mean"), F.coalesce(F.nullif(F.stddev_pop(c), F.lit(0.0)), F.lit(1.0)).alias(f"{c}__std")]
    return df.agg(*aggs)


def zscores(df: DataFrame, columns: Sequence[str], fit_on: DataFrame | None = None) -> DataFrame:
    out = df.crossJoin(F.broadcast(scaler(fit_on or df, columns)))  # one row
    out = out.withColumns({c: (F.col(c) - F.col(f"{c}__mean")) / F.col(f"{c}__std") for c in columns})
    return out.drop(*(f"{c}__{s}" for c in columns for s in ("mean", "std")))


def correlations(df: DataFrame, columns: Sequence[str]) -> np.ndarray:
    """The correlation matrix from centred sums of products: one row of features x features numbers."""
    z = zscores(df.select(*(F.col(c).cast("double").alias(c) for c in columns)), columns)
    pairs = [(i, j) for i in range(len(columns)) for j in range(i + 1)]
    row = z.agg(*(F.avg(F.col(columns[i]) * F.col(columns[j])).alias(f"c{i}_{j}") for i, j in pairs)).first()
    out = np.zeros((len(columns), len(columns)))
    for i, j in pairs:
        out[i, j] = out[j, i] = row[f"c{i}_{j}"] or 0.0
    return out


def factors(r: np.ndarray) -> np.ndarray:
    """1 / (1 - R2) of each column on the others; infinite for a combination of others."""
    k = len(r)
    out = np.ones(k)
    for i in range(k):
        if r[i, i] == 0:
            continue
        rest = [j for j in range(k) if j != i]
        r2 = float(r[i, rest] @ np.linalg.pinv(r[np.ix_(rest, rest)], hermitian=True) @ r[rest, i]) if rest else 0.0
        out[i] = np.inf if 1 - r2 < 1e-10 else 1 / (1 - r2)
    return out


def select(df: DataFrame, columns: Sequence[str], threshold: float = 10.0) -> tuple[list[str], list[tuple[str, float]]]:
    """Drops the column of the greatest factor, of ties the first, until none is above the threshold: what is
    kept, and what went with its factor.  The data are read once."""
    r, kept, gone = correlations(df, columns), list(range(len(columns))), []
    while len(kept) > 1:
        v = factors(r[np.ix_(kept, kept)])
        worst = int(np.argmax(v))
        if v[worst] <= threshold:
            break
        gone.append((columns[kept.pop(worst)], float(v[worst])))
    return [columns[i] for i in kept], gone
