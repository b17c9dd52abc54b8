"""Column-expression helpers: all built-in Catalyst expressions, no UDFs."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

EPS = 1e-9
# ASCII whitespace removed by a text "strip".
WHITESPACE = " \t\n\r\f\x0b"


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: str | Column) -> Column:
    """Remove leading/trailing ASCII whitespace (not only spaces)."""
    return F.btrim(col(c), F.lit(WHITESPACE))


def norm_code(c: str | Column) -> Column:
    """Upper-case and strip a code column."""
    return strip(F.upper(col(c)))


def blank_to_null(c: str | Column) -> Column:
    s = strip(col(c))
    return F.when(s == "", F.lit(None)).otherwise(s)


def blank_default(c: str | Column, default: str) -> Column:
    """Trimmed text; null or blank becomes ``default``."""
    return F.coalesce(blank_to_null(c), F.lit(default))


_STAMP = r"^(\d{4}-\d{2}-\d{2})(?:[T ](\d{2}:\d{2}(?::\d{2}(?:\.\d{1,9})?)?))?(Z|[+-]\d{2}:?\d{2})?$"


def parse_stamp(c: str | Column) -> Column:
    """ISO-8601 text (date, minutes, seconds or fractions; Z or an offset) as
    the TIMESTAMP_NTZ of its UTC time; without an offset it is read as UTC.
    Other text becomes null."""
    s = strip(col(c).cast("string"))
    time, zone = F.regexp_extract(s, _STAMP, 2), F.regexp_extract(s, _STAMP, 3)
    full = F.when(time == "", "00:00:00").when(F.length(time) == 5, F.concat(time, F.lit(":00"))).otherwise(time)
    local = F.concat(F.regexp_extract(s, _STAMP, 1), F.lit(" "), full).try_cast("timestamp_ntz")
    minutes = F.substring(zone, 2, 2).cast("int") * 60 + F.right(zone, F.lit(2)).cast("int")
    ahead = F.when(zone.isin("", "Z"), 0).when(zone.startswith("-"), -minutes).otherwise(minutes)
    return local - F.make_dt_interval(mins=ahead)


def safe_divide(num: str | Column, den: str | Column) -> Column:
    """``num / den`` where a zero or missing denominator becomes 1e-9."""
    d = col(den).cast("double")
    return col(num).cast("double") / F.coalesce(F.when(d != 0, d), F.lit(EPS))


def nan_to_null(c: str | Column) -> Column:
    x = col(c)
    return F.when(F.isnan(x), F.lit(None).cast("double")).otherwise(x)


def clip(c: Column, lo: float, hi: float) -> Column:
    return F.least(F.greatest(c, F.lit(lo)), F.lit(hi))


def round_half_even(c: Column, digits: int) -> Column:
    """Round the scaled double to the nearest even integer (numpy rounding).

    ``rint(x * 10^k) / 10^k``; ``bround`` rounds the decimal value instead
    and differs for values such as 1.015.
    """
    scale = float(10**digits)
    return F.rint(c * F.lit(scale)) / F.lit(scale)


def literal_map(mapping: dict) -> Column:
    return F.create_map(*[F.lit(x) for x in chain.from_iterable(mapping.items())])


def count_if(cond: Column) -> Column:
    return F.sum(F.when(cond, 1).otherwise(0)).cast("bigint")


def first_existing(columns, candidates):
    """First candidate present in ``columns`` (decided at plan time)."""
    present = set(columns)
    return next((c for c in candidates if c in present), None)


# Largest side (rows, bytes) broadcast after an explicit size check.
BROADCAST_MAX_ROWS = 1_000_000
BROADCAST_MAX_BYTES = 64 << 20


def row_bytes(df) -> Column:
    """Bytes of a row's values: texts by their length, nested values by that of their JSON, others 8 each."""
    fields = df.schema.fields
    texts = [f.name for f in fields if isinstance(f.dataType, (T.StringType, T.BinaryType))]
    nested = [f.name for f in fields if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType))]
    total = F.lit(8 * (len(fields) - len(texts) - len(nested))).cast("bigint")
    for c in texts:
        total = total + F.coalesce(F.octet_length(F.col(c)), F.lit(0))
    return total + F.octet_length(F.to_json(F.struct(*nested))) if nested else total


def join_small(big, small, on, how: str = "inner", max_rows: int = BROADCAST_MAX_ROWS, max_bytes: int = BROADCAST_MAX_BYTES):
    """Join ``big`` with a data-derived ``small`` side, broadcasting it only
    after checking its rows and bytes; beyond either limit it is a shuffle join.

    The check is one aggregate over ``small`` (typically an aggregate over a
    materialised base), so the big side is never shuffled on a skewed
    low-cardinality key when the small side really is small.
    """
    size = small.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(row_bytes(small)), F.lit(0)).alias("b")).first()
    if size["n"] <= max_rows and size["b"] <= max_bytes:
        return big.join(F.broadcast(small), on, how)
    return big.join(small, on, how)


# Wall-clock (TIMESTAMP_NTZ) <-> instant (TIMESTAMP) conversions that read the
# wall clock as UTC whatever the session time zone is.
EPOCH_NTZ = "1970-01-01 00:00:00"


def ntz_micros(c: Column) -> Column:
    """Microseconds since the epoch of a TIMESTAMP_NTZ value, zone-free.

    From its date and clock parts: ``timestamp_diff`` would read the value in the
    session's zone first, where an hour may be missing or come twice.
    """
    clock = F.hour(c).cast("bigint") * 3_600_000_000 + F.minute(c).cast("bigint") * 60_000_000
    return F.unix_date(c.cast("date")).cast("bigint") * 86_400_000_000 + clock + (F.extract(F.lit("SECOND"), c) * 1_000_000).cast("bigint")


def wall_to_instant(c: Column) -> Column:
    return F.timestamp_micros(ntz_micros(c))


def instant_to_wall(c: Column) -> Column:
    return F.timestamp_add("MICROSECOND", F.unix_micros(c), F.lit(EPOCH_NTZ).cast("timestamp_ntz"))
