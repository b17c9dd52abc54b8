"""The default-risk classifier: preprocessing and a balanced, penalised logistic regression.

* Numeric columns: exact median for missing values, then mean 0 and
  population deviation 1 (a constant column keeps its scale). Text columns:
  most frequent value for missing ones (of equal counts the smallest), then
  one column a level seen in training; a level not seen has none.
* The coefficients minimise sum(s * log-loss) + |w|^2 / 2, with class weights
  s = n / (2 * n_class) and a free intercept. The minimum is unique, so
  Newton's method finds the same coefficients whatever the partitions: each step is one pass in
  which every task adds up its rows' gradient and curvature (k x k numbers,
  k features); a few tasks add up the tasks' sums. The fit ends
  when the gradient is nothing but rounding, and one more step is taken.
* Scoring is a column expression over a few dozen constants: no join, no shuffle, no Python.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.exprs import round_half_even
from ..session import cut_lineage
from .ordering import exact_medians

#: Levels of one text column: beyond, it is no category.
MAX_LEVELS = 1000
#: Probabilities are given to so many decimals; later ones depend on the order of summation.
DECIMALS = 6
#: Tasks that add up the sums of all tasks.
SUMMERS = 16
MAX_STEPS = 50


@dataclass
class Preprocessor:
    numeric: list[str]
    medians: list[float]
    means: list[float]
    scales: list[float]
    categorical: list[str]
    modes: list[str | None]
    levels: list[list[str]]

    @classmethod
    def fit(cls, df: DataFrame, numeric: list[str], categorical: list[str]) -> Preprocessor:
        """Statistics of ``df``, which is read several times (pass a stored table)."""
        found = exact_medians(df, numeric).first()
        medians = [float(found[c]) if found is not None and found[c] is not None else 0.0 for c in numeric]
        filled = [F.coalesce(F.col(c).cast("double"), F.lit(m)) for c, m in zip(numeric, medians)]
        row = df.agg(*[F.avg(x).alias(f"m{i}") for i, x in enumerate(filled)]).first()
        means = [float(row[f"m{i}"] or 0.0) for i in range(len(numeric))]
        row = df.agg(*[F.sqrt(F.avg((x - F.lit(m)) * (x - F.lit(m)))).alias(f"s{i}") for i, (x, m) in enumerate(zip(filled, means))]).first()
        scales = [float(row[f"s{i}"]) if row[f"s{i}"] else 1.0 for i in range(len(numeric))]
        modes, levels = [], []
        for c in categorical:
            counts = df.where(F.col(c).isNotNull()).groupBy(F.col(c).cast("string").alias("v")).count()
            rows = counts.orderBy(F.desc("count"), "v").limit(MAX_LEVELS + 1).collect()
            if len(rows) > MAX_LEVELS:
                raise ValueError(f"{c} has more than {MAX_LEVELS} values; it is no category")
            modes.append(rows[0]["v"] if rows else None)
            levels.append(sorted(r["v"] for r in rows))
        return cls(numeric, medians, means, scales, categorical, modes, levels)

    def columns(self) -> list[Column]:
        """The features, in order."""
        out = [(F.coalesce(F.col(c).cast("double"), F.lit(med)) - F.lit(mean)) / F.lit(scale)
               for c, med, mean, scale in zip(self.numeric, self.medians, self.means, self.scales)]
        for c, mode, levels in zip(self.categorical, self.modes, self.levels):
            value = F.coalesce(F.col(c).cast("string"), F.lit(mode))
            out += [F.when(value == F.lit(level), 1.0).otherwise(0.0) for level in levels]
        return out


@dataclass
class LogitModel:
    pre: Preprocessor
    coefficients: list[float]
    intercept: float
    steps: int
    gradient: float

    def logit(self) -> Column:
        z = F.lit(self.intercept)
        for x, b in zip(self.pre.columns(), self.coefficients):
            z = z + x * F.lit(b)
        return z

    def transform(self, df: DataFrame, out: str = "PredDefaultProbability") -> DataFrame:
        p = F.lit(1.0) / (F.lit(1.0) + F.exp(-self.logit()))
        return df.withColumn(out, round_half_even(p, DECIMALS))

    def save(self, spark: SparkSession, path: str) -> None:
        spark.createDataFrame([(json.dumps(asdict(self)),)], "value string").coalesce(1).write.mode("overwrite").text(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> LogitModel:
        held = json.loads(spark.read.text(path, wholetext=True).first()[0])
        return cls(**(held | {"pre": Preprocessor(**held["pre"])}))


def _sums(rows: DataFrame, beta: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Gradient, curvature and loss at ``beta`` over rows (x array<double>, y, s)."""
    k = len(beta)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(k + k * k + 1)
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.asarray(batch.column("x").flatten()).reshape(-1, k)
            y, s = np.asarray(batch.column("y")), np.asarray(batch.column("s"))
            z = x @ beta
            p = 1 / (1 + np.exp(-z))
            total[:k] += x.T @ (s * (p - y))
            total[k:-1] += ((x * (s * p * (1 - p))[:, None]).T @ x).ravel()
            total[-1] += float((s * (np.logaddexp(0, z) - y * z)).sum())
        yield pa.RecordBatch.from_pydict({"part": pa.array([TaskContext.get().partitionId() % SUMMERS], pa.int32()), "total": pa.array([total.tobytes()], pa.binary())})

    def add(table: pa.Table) -> pa.Table:
        held = sorted(table.column("total").to_pylist())
        return pa.table({"total": pa.array([np.sum([np.frombuffer(b) for b in held], axis=0).tobytes()], pa.binary())})

    parts = rows.mapInArrow(run, "part int, total binary").groupBy("part").applyInArrow(add, "total binary").collect()
    total = np.sum([np.frombuffer(b) for b in sorted(bytes(p["total"]) for p in parts)], axis=0)
    return total[:k], total[k:-1].reshape(k, k), float(total[-1])


def fit(df: DataFrame, label: str, numeric: list[str], categorical: list[str], penalty: float = 1.0) -> LogitModel:
    """Fit on rows with a 0/1 ``label``; both classes must occur."""
    counts = {int(r[label]): int(r["count"]) for r in df.groupBy(label).count().collect()}
    if set(counts) != {0, 1}:
        raise ValueError("Target needs at least two classes to train a classifier.")
    n = sum(counts.values())
    pre = Preprocessor.fit(df, numeric, categorical)
    weight = F.when(F.col(label) == 1, n / (2.0 * counts[1])).otherwise(n / (2.0 * counts[0]))
    rows = cut_lineage(df.select(F.array(*pre.columns(), F.lit(1.0)).alias("x"), F.col(label).cast("double").alias("y"), weight.alias("s")))
    k = len(pre.columns()) + 1
    ridge = np.full(k, penalty)
    ridge[-1] = 0.0

    def at(beta: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        g, h, loss = _sums(rows, beta)
        return g + ridge * beta, h + np.diag(ridge), loss + 0.5 * float(ridge @ (beta * beta))

    beta = np.zeros(k)
    g, h, loss = at(beta)
    for step in range(1, MAX_STEPS + 1):
        move, rate = np.linalg.solve(h, g), 1.0
        new = at(beta - move)
        while new[2] > loss + 1e-12 * abs(loss) and rate > 1e-6:
            rate /= 2
            new = at(beta - rate * move)
        done = np.abs(g).max() <= 1e-9 * n
        beta, (g, h, loss) = beta - rate * move, new
        if done:
            return LogitModel(pre, beta[:-1].tolist(), float(beta[-1]), step, float(np.abs(g).max()))
    raise RuntimeError(f"no minimum after {MAX_STEPS} steps; largest gradient {np.abs(g).max()}")
