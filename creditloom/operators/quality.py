"""Validation and cleaning of a loan-account table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.exprs import BROADCAST_MAX_ROWS, strip
from ..schema import ID_CANDIDATES, REQUIRED_COLUMNS
from ..session import cut_lineage
from ..sources.files import required_status, validate_columns
from .ordering import approx_medians, exact_medians

__all__ = ["validate_columns", "required_status", "clean", "dedupe_and_census", "drop_duplicate_rows", "numeric_columns",
           "REQUIRED_COLUMNS"]


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


_DIGEST = "_cl_digest"


def _null_census(cols: list[str]) -> list:
    return [F.count(F.when(F.col(c).isNull(), 1)).alias(f"_null_{c}") for c in cols]


def row_digest(df: DataFrame) -> Column:
    """Equal for equal rows (nulls, NaN and zeros of either sign as in DISTINCT); different rows rarely share one."""
    gaps = F.concat(*[F.when(F.col(c).isNull(), "1").otherwise("0") for c in df.columns])
    return F.xxhash64(gaps, *df.columns)


def distinct_rows(df: DataFrame, max_digests: int = BROADCAST_MAX_ROWS) -> DataFrame:
    """Whole-row distinct of a stored table that moves only rows which may be copies.

    Digests (8 bytes a row, counted before they are shuffled) tell which rows
    can have an equal one; only rows of these digests are compared and
    shuffled whole, so rows of equal digest that differ all stay. The repeated
    digests are broadcast while there are at most ``max_digests`` (8 MB);
    beyond, the table is de-duplicated whole.
    """
    tagged = df.withColumn(_DIGEST, row_digest(df))
    counts = tagged.groupBy(_DIGEST).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(_DIGEST)
    repeated = cut_lineage(counts)
    found = repeated.count()
    if found == 0:
        return df
    if found > max_digests:
        return df.dropDuplicates()
    repeated = F.broadcast(repeated)
    copies = tagged.join(repeated, _DIGEST, "left_semi").drop(_DIGEST).dropDuplicates()
    return tagged.join(repeated, _DIGEST, "left_anti").drop(_DIGEST).unionByName(copies)


def dedupe_and_census(df: DataFrame, num: list[str], materialize: bool = True, unique_key: str | None = None):
    """(whole-row distinct table, null count per numeric column).

    Columns that the schema says are never null are not counted; where all are
    such, nothing is read here.

    With ``materialize``, the rows are written once to the checkpoint folder,
    and ``distinct_rows`` reads them there. Rows of a declared ``unique_key``
    cannot be equal: nothing is dropped, so nothing is shuffled, and with
    ``materialize`` off nothing is written either.
    """
    rows = cut_lineage(df) if materialize else df
    if unique_key is None:
        rows = distinct_rows(rows) if materialize else rows.dropDuplicates()
    gaps = [c for c in num if df.schema[c].nullable]
    census = rows.agg(*_null_census(gaps)).first() if gaps else {}
    return rows, {c: census[f"_null_{c}"] if c in gaps else 0 for c in num}


def drop_duplicate_rows(df: DataFrame, materialize: bool = True) -> DataFrame:
    """Whole-row distinct, nulls equal (see ``dedupe_and_census``)."""
    return dedupe_and_census(df, [], materialize)[0]


def clean(df: DataFrame, approx: bool = False, medians: DataFrame | None = None, materialize: bool = True,
          unique_key: str | None = None) -> DataFrame:
    """Whole-row dedupe, median fill of numeric and 'Unknown' fill of text.

    * Duplicate rows (nulls equal) are dropped.
    * Every numeric column gets its null cells filled with the exact
      median of the de-duplicated column (``approx=True`` uses a sketch).
      Numeric columns come out as double so a fractional median is kept;
      id candidate columns keep their type.
    * Text columns: null becomes ``Unknown``; all values are stripped.

    ``materialize`` writes the de-duplicated table once to the reliable
    checkpoint folder (see ``dedupe_and_census``): the null census, the medians and every later branch
    (sector shares, score maxima, plans) read it instead of recomputing the
    source joins, and lost executors re-read it. The census is a one-row
    aggregate over the columns that may be null by schema; medians are computed
    only for columns that have nulls (for the others the fill is a no-op) and
    reach the rows as one scalar subquery (no join).

    ``unique_key`` declares a column that no two rows share. Together with
    ``materialize=False`` the result is lazy: filters and column pruning of
    a later query reach the scan.
    """
    num = [c for c in numeric_columns(df) if c not in ID_CANDIDATES]
    dedup, nulls = dedupe_and_census(df, num if medians is None else [], materialize, unique_key)
    fill = num if medians is not None else [c for c in num if nulls.get(c, 1) > 0]
    med_of = {}
    if fill:
        med = medians if medians is not None else (approx_medians(dedup, fill) if approx else exact_medians(dedup, fill))
        # one scalar subquery holding every median, evaluated once
        packed = med.select(F.struct(*[F.col(c).cast("double").alias(c) for c in fill])).scalar()
        med_of = {c: packed[c] for c in fill}
    out = []
    for f in dedup.schema.fields:
        c = F.col(f.name)
        if f.name in num:
            c = F.coalesce(c.cast("double"), med_of[f.name]) if f.name in fill else c.cast("double")
        elif isinstance(f.dataType, T.StringType):
            c = strip(F.coalesce(c, F.lit("Unknown")))
        elif not isinstance(f.dataType, T.NumericType):
            c = strip(F.coalesce(c.cast("string"), F.lit("Unknown")))
        out.append(c.alias(f.name))
    return dedup.select(*out)


