"""Principal axes of many vectors: sums of their products by task, axes of the small matrix, projections by batch."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Components a vector may have: the matrix of their products is held by each task and the driver.
WIDEST = 2000


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)


def project(df: DataFrame, item: str, vector: str, axes: int = 2) -> DataFrame:
    """(item, pc1, pc2, ...): the vectors, all of one length and without nulls, on their axes of greatest variance.

    An axis points to where its largest component is positive. Products are summed about the first vector
    seen by the driver, so that far-off data lose no digits. Null vectors are left out; no vectors, no rows.
    """
    rows = df.where(F.col(vector).isNotNull()).select(item, F.col(vector).cast("array<double>").alias("v"))
    first = rows.select("v").first()
    kind = rows.select(item).schema[0].dataType.simpleString()
    schema = f"`{item}` {kind}, " + ", ".join(f"pc{i + 1} double" for i in range(axes))
    if first is None:
        return df.sparkSession.createDataFrame([], schema)
    base = np.array(first["v"])
    width = len(base)
    if width > WIDEST:
        raise ValueError(f"vectors of {width} components; at most {WIDEST} are projected")

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # The last row and column hold sums and the count.
        total = np.zeros((width + 1, width + 1))
        for batch in batches:
            x = np.hstack([_matrix(batch.column(0)) - base, np.ones((batch.num_rows, 1))])
            total += x.T @ x
        i, j = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(total[i, j])], ["i", "j", "s"])

    sums = rows.select("v").mapInArrow(products, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).toArrow()
    total = np.zeros((width + 1, width + 1))
    total[sums["i"].to_numpy(), sums["j"].to_numpy()] = sums["s"].to_numpy()
    n, mean = total[-1, -1], total[-1, :-1] / total[-1, -1]
    _, found = np.linalg.eigh(total[:-1, :-1] / n - np.outer(mean, mean))
    chosen = found[:, ::-1][:, :axes]
    chosen = chosen * np.sign(chosen[np.abs(chosen).argmax(axis=0), np.arange(chosen.shape[1])])

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = (_matrix(batch.column(1)) - base - mean) @ chosen
            at = np.hstack([at, np.zeros((len(at), axes - at.shape[1]))])
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c) for c in at.T]], [item, *[f"pc{i + 1}" for i in range(axes)]])

    return rows.mapInArrow(placed, schema)
