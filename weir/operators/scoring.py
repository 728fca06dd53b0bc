"""Linear scoring on embeddings: normalisation, closed-form ridge from distributed sums, prediction."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def unit(vector: Column | str) -> Column:
    """The vector over its length (the zero vector stays)."""
    v = F.col(vector) if isinstance(vector, str) else vector
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return F.transform(v, lambda x: F.when(norm > 0, x.cast("double") / norm).otherwise(0.0))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def ridge(df: DataFrame, vector: str, target: str, penalty: float = 1.0) -> np.ndarray:
    """Weights and, last, the bias (not penalised). Sums of products are added up on the executors; d * d numbers come back."""
    import pyarrow as pa

    def sums(batches):
        total = None
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.array(batch.column(0).to_pylist(), float)
            x = np.concatenate([x, np.ones((len(x), 1))], axis=1)
            y = batch.column(1).to_numpy(zero_copy_only=False).astype(float)
            own = np.concatenate([x.T @ x, (x.T @ y)[:, None]], axis=1)
            total = own if total is None else total + own
        if total is not None:
            i, j = np.indices(total.shape)
            yield pa.RecordBatch.from_arrays([pa.array(i.ravel()), pa.array(j.ravel()), pa.array(total.ravel())], names=["i", "j", "v"])

    rows = df.select(vector, F.col(target).cast("double")).dropna().mapInArrow(sums, "i long, j long, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).toPandas()
    d = int(rows["i"].max()) + 1
    full = np.zeros((d, d + 1))
    full[rows["i"], rows["j"]] = rows["v"]
    keep = np.eye(d) * penalty
    keep[-1, -1] = 0
    return np.linalg.solve(full[:, :d] + keep, full[:, d])


def predicted(vector: Column, weights: np.ndarray, lo: float = 0.0, hi: float = 5.0) -> Column:
    w = F.array(*(F.lit(float(x)) for x in weights[:-1]))
    return F.least(F.lit(hi), F.greatest(F.lit(lo), dot(vector, w) + float(weights[-1])))
