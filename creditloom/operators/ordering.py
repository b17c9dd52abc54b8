"""Order statistics that stay distributed when one group is huge.

A plain ``row_number().over(Window.partitionBy(g).orderBy(...))`` sends a
whole group to one task; with a handful of officers (or a global order)
that is a third of the table in one sort. Here the rows are instead range
partitioned on ``(group, order)`` into a fixed number of partitions, so a
hot group spans many tasks. Each partition is a contiguous slice of the
global order; a tiny per-(partition, group) block table (at most
partitions + groups rows) gives every block the number of rows before it,
and a row's rank is its position inside its block plus that offset.

The slice tags (partition id, position) are read twice - once for the
block table, once for the rows. Range boundaries come from sampling the
input, whose row order after a shuffle is not fixed, so two evaluations
could disagree. The tagged slices are therefore checkpointed once into the
cluster's reliable checkpoint folder: both reads see the same tags, and a
lost executor re-reads the checkpoint instead of re-sampling. Because the
tags are materialised, AQE is free to merge adjacent ranges (they stay
contiguous), so the slice count adapts to the data size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import BROADCAST_MAX_ROWS, literal_map
from ..session import cut_lineage

_PID, _POS = "_cl_pid", "_cl_pos"


def _ranged(df: DataFrame, keys: list, n: int | None) -> DataFrame:
    """Range partitioning on ``keys``; without an explicit ``n`` AQE may merge
    adjacent (hence still contiguous) ranges to its advisory size."""
    return df.repartitionByRange(int(n), *keys) if n else df.repartitionByRange(*keys)


def _sorted_slices(df: DataFrame, keys: list[Column], n: int | None) -> DataFrame:
    ranged = _ranged(df, keys, n).sortWithinPartitions(*keys)
    pid = F.spark_partition_id()
    # monotonically_increasing_id = (partition << 33) + position in partition
    tagged = ranged.withColumn(_PID, pid).withColumn(
        _POS, F.monotonically_increasing_id() - F.shiftleft(pid.cast("bigint"), 33)
    )
    return cut_lineage(tagged)


def rank_within_groups(
    df: DataFrame,
    group_cols: list[str],
    order_cols: list[Column],
    rank_col: str,
    partitions: int | None = None,
    few_groups: bool = True,
) -> DataFrame:
    """``row_number`` of each row within ``group_cols`` by ``order_cols``.

    ``order_cols`` must make the order total (end with a unique key), so the
    result is deterministic across retries. ``few_groups`` asks for the
    block table (<= slices + groups rows) to be broadcast once its row count
    is checked; otherwise AQE decides from its measured size.
    """
    keys = [F.col(g) for g in group_cols] + list(order_cols)
    tagged = _sorted_slices(df, keys, partitions)
    blocks = tagged.groupBy(_PID, *group_cols).agg(
        F.min(_POS).alias("_cl_first"), F.count(F.lit(1)).alias("_cl_n")
    )
    before = Window.partitionBy(*group_cols).orderBy(_PID).rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("_cl_before", F.coalesce(F.sum("_cl_n").over(before), F.lit(0)))
    blocks = blocks.drop("_cl_n")
    out = _join_blocks(tagged, blocks, group_cols, few_groups)
    rank = (F.col(_POS) - F.col("_cl_first") + F.lit(1) + F.col("_cl_before")).cast("bigint")
    return out.withColumn(rank_col, rank).drop(_PID, _POS, "_cl_first", "_cl_before")


def _join_blocks(tagged: DataFrame, blocks: DataFrame, group_cols: list[str], few_groups: bool) -> DataFrame:
    """Rows joined to their block on (slice, group); a null group is a group too."""
    renamed = blocks.select(*[F.col(c).alias(f"_cl_b_{c}") for c in [_PID, *group_cols]],
                            *[c for c in blocks.columns if c not in (_PID, *group_cols)])
    # the block table has at most slices + groups rows; broadcast it only
    # after checking that count (it is an aggregate of a materialised table)
    if few_groups and renamed.count() <= BROADCAST_MAX_ROWS:
        renamed = F.broadcast(renamed)
    cond = F.col(_PID) == F.col(f"_cl_b_{_PID}")
    for g in group_cols:
        cond = cond & F.col(g).eqNullSafe(F.col(f"_cl_b_{g}"))
    out = tagged.join(renamed, cond, "inner")
    return out.drop(*[f"_cl_b_{c}" for c in [_PID, *group_cols]])


def global_row_index(df: DataFrame, order_cols: list[Column], index_col: str, partitions: int | None = None) -> DataFrame:
    """0-based position of every row in a total order, without a 1-task window."""
    out = rank_within_groups(df, [], order_cols, "_cl_rank", partitions, few_groups=True)
    return out.withColumn(index_col, F.col("_cl_rank") - F.lit(1)).drop("_cl_rank")


# Rows of a bracket that are few enough to be put in order value by value.
BRACKET_ROWS = 1_000_000
# Accuracy of the sketch that proposes a bracket: ranks within 1/10,000 of its rows.
SKETCH_ACCURACY = 10_000


class _Target:
    """One wanted rank of one column: the open interval that holds it, or its value."""

    def __init__(self, col: str, rank: int, rows: int):
        self.col, self.rank, self.rows = col, rank, rows
        self.low = self.high = self.value = None

    def inside(self, v: Column) -> Column:
        """``v`` lies in the interval (nulls and NaN lie in none)."""
        ok = v.isNotNull() & ~F.isnan(v)
        if self.low is not None:
            ok = ok & (v > F.lit(self.low))
        return ok & (v < F.lit(self.high)) if self.high is not None else ok

    def interval(self) -> tuple:
        return self.col, self.low, self.high

    def shares(self) -> list[float]:
        """Where the pivots lie among the rows of the interval."""
        at, off = (self.rank - 0.5) / self.rows, 2.0 / SKETCH_ACCURACY
        return [max(at - off, 0.0), min(at + off, 1.0)]

    def counts(self, a: float, b: float) -> list[Column]:
        """Rows of the interval below, at and between the pivots and at the upper one."""
        v = F.col(self.col).cast("double")
        ok = self.inside(v)
        parts = [v < F.lit(a), v == F.lit(a), (v > F.lit(a)) & (v < F.lit(b)), (v == F.lit(b)) & F.lit(b != a)]
        return [F.count(F.when(ok & part, 1)) for part in parts]

    def narrow(self, a: float, b: float, below: int, at_a: int, between: int, at_b: int) -> None:
        """Exact counts decide where the rank lies, whatever the sketch had promised."""
        if self.rank <= below:
            self.high, self.rows = a, below
        elif self.rank <= below + at_a:
            self.value = a
        elif self.rank <= below + at_a + between:
            self.low, self.high, self.rank, self.rows = a, b, self.rank - below - at_a, between
        elif self.rank <= below + at_a + between + at_b:
            self.value = b
        else:
            done = below + at_a + between + at_b
            self.low, self.rank, self.rows = b, self.rank - done, self.rows - done


def _pivots(df: DataFrame, targets: list[_Target]) -> list[list[float]]:
    """Two pivots for each target; those of one interval share its sketch."""
    same: dict[tuple, list[_Target]] = {}
    for t in targets:
        same.setdefault(t.interval(), []).append(t)
    sketches = []
    for i, ts in enumerate(same.values()):
        v = F.col(ts[0].col).cast("double")
        sketches.append(F.percentile_approx(F.when(ts[0].inside(v), v), [x for t in ts for x in t.shares()], SKETCH_ACCURACY).alias(f"p{i}"))
    found = df.agg(*sketches).first()
    # + 0.0: of literals 0.0 and -0.0 in one aggregate Spark evaluates only one
    of = {t: [found[f"p{i}"][2 * j] + 0.0, found[f"p{i}"][2 * j + 1] + 0.0] for i, ts in enumerate(same.values()) for j, t in enumerate(ts)}
    return [of[t] for t in targets]


def exact_medians(df: DataFrame, cols: list[str], bracket_rows: int = BRACKET_ROWS) -> DataFrame:
    """One row holding the exact median (two-middle mean) of each column.

    Nulls are skipped, NaN counts as the largest value, a column without
    values has a null median. Nothing is shuffled but sketches, counts and the
    rows of small brackets: a quantile sketch proposes two pivots around each
    middle rank, one count of the rows below, at and between them tells exactly
    where the rank lies, and so on inside that interval (a round leaves about a
    2,500th of its rows, apart from repeats of the pivots, which are decided
    by their count) until it holds at most ``bracket_rows`` rows. Those are
    reduced to (value, count) and put in order. A round is two map-side
    combined passes for all columns together; the driver sees four numbers per
    column and round. A table of at most ``bracket_rows`` rows takes no round.
    """
    spark = df.sparkSession
    if not cols:
        return spark.range(1).select()
    def census(i: int, c: str) -> list[Column]:
        v = F.col(c).cast("double")
        return [F.count(F.when(v.isNotNull() & ~F.isnan(v), 1)).alias(f"n{i}"), F.count(F.when(F.isnan(v), 1)).alias(f"x{i}")]

    sizes = df.agg(*[n for i, c in enumerate(cols) for n in census(i, c)]).first()
    targets: dict[str, list[_Target]] = {}
    for i, c in enumerate(cols):
        real, total = sizes[f"n{i}"], sizes[f"n{i}"] + sizes[f"x{i}"]
        targets[c] = [_Target(c, r, real) for r in sorted({(total + 1) // 2, total // 2 + 1})] if total else []
        for t in targets[c]:
            if t.rank > real:
                t.value = float("nan")
    every = [t for ts in targets.values() for t in ts]
    while wide := [t for t in every if t.value is None and t.rows > bracket_rows]:
        pivots = _pivots(df, wide)
        # the two middle ranks of a column mostly have the same pivots: these are counted once
        asked = {(*t.interval(), *ab): t for t, ab in zip(wide, pivots)}
        number = {key: i for i, key in enumerate(asked)}
        counted = df.agg(*[n.alias(f"c{number[key]}_{j}") for key, t in asked.items() for j, n in enumerate(t.counts(*key[3:]))]).first()
        of = [number[(*t.interval(), *ab)] for t, ab in zip(wide, pivots)]
        for t, ab, i in zip(wide, pivots, of):
            t.narrow(*ab, *[counted[f"c{i}_{j}"] for j in range(4)])
    _finish(df, [t for t in every if t.value is None])
    means = {c: sum(t.value for t in ts) / len(ts) if ts else None for c, ts in targets.items()}
    return spark.range(1).select(*[F.lit(means[c]).cast("double").alias(c) for c in cols])


def _finish(df: DataFrame, small: list[_Target]) -> None:
    """The values at the ranks of ``small``, whose intervals hold few rows each."""
    if not small:
        return
    items = F.array(*[F.struct(F.lit(i).alias("k"), F.when(t.inside(F.col(t.col).cast("double")), F.col(t.col).cast("double")).alias("v"))
                      for i, t in enumerate(small)])
    values = df.select(F.explode(items).alias("x")).select("x.k", "x.v").where("v IS NOT NULL")
    counts = values.groupBy("k", "v").agg(F.count(F.lit(1)).alias("n"))
    upto = F.sum("n").over(Window.partitionBy("k").orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    wanted = literal_map({i: t.rank for i, t in enumerate(small)})[F.col("k")]
    found = counts.withColumn("upto", upto).where(F.col("upto") >= wanted).groupBy("k").agg(F.min("v").alias("v"))
    for r in found.collect():  # a row a target
        small[r["k"]].value = r["v"]


def approx_medians(df: DataFrame, cols: list[str], accuracy: int = 100000) -> DataFrame:
    return df.agg(*[F.percentile_approx(F.col(c).cast("double"), 0.5, accuracy).alias(c) for c in cols])


def running_count_within_groups(
    df: DataFrame,
    group_cols: list[str],
    order_cols: list[Column],
    flag_col: str,
    out_col: str,
    partitions: int | None = None,
) -> DataFrame:
    """Running count of ``flag_col`` (0/1) within ``group_cols`` in a total order.

    Same range-slice scheme as ``rank_within_groups``: a hot group spans many
    slices; each (slice, group) block sums locally and adds the flags of the
    group's earlier blocks from the block table.
    """
    keys = [F.col(g) for g in group_cols] + list(order_cols)
    tagged = _sorted_slices(df, keys, partitions)
    local_w = Window.partitionBy(_PID, *group_cols).orderBy(_POS).rowsBetween(Window.unboundedPreceding, 0)
    local = tagged.withColumn("_cl_loc", F.sum(F.col(flag_col).cast("bigint")).over(local_w))
    blocks = tagged.groupBy(_PID, *group_cols).agg(F.sum(F.col(flag_col).cast("bigint")).alias("_cl_bs"))
    before = Window.partitionBy(*group_cols).orderBy(_PID).rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("_cl_before", F.coalesce(F.sum("_cl_bs").over(before), F.lit(0))).drop("_cl_bs")
    out = _join_blocks(local, blocks, group_cols, few_groups=False)
    return out.withColumn(out_col, F.col("_cl_loc") + F.col("_cl_before")).drop(_PID, _POS, "_cl_loc", "_cl_before")
