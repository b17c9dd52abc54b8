"""File and table sources/sinks for loan, feedback and output tables."""

from __future__ import annotations

import os
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.exprs import blank_default, nan_to_null, parse_stamp, strip
from ..schema import FEEDBACK_COLUMNS, FEEDBACK_DEFAULTS, FEEDBACK_SCHEMA, JOB_SCHEMA, NA_TOKENS

# Declared types of the known loan-account columns; anything else stays text.
LOAN_TYPES = {
    "CLStatusCode": T.StringType(),
    "AgeDays": T.IntegerType(),
    "DefaultedInst": T.IntegerType(),
    "PrincipalOS": T.DoubleType(),
    "PrincipalArrear": T.DoubleType(),
    "InterestArrear": T.DoubleType(),
    "TotalAccruedInt": T.DoubleType(),
    "SecurityValue": T.DoubleType(),
    "Sector": T.StringType(),
    "RepaymentFrequency": T.StringType(),
    "TotalInstallments": T.IntegerType(),
    "FutureStatusCode": T.StringType(),
    "Branch": T.StringType(),
    "SanctionedAmount": T.DoubleType(),
    "IntRate": T.DoubleType(),
    "DisbAmount": T.DoubleType(),
}

FORMATS = {".csv": "csv", ".parquet": "parquet", ".json": "json", ".orc": "orc"}


def path_exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    fs = hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return bool(fs.exists(hpath))


def resolve_source(spark: SparkSession, candidates: list[str]) -> str:
    """First path that exists (e.g. an 'active' file, then the default)."""
    for p in candidates:
        if path_exists(spark, p):
            return p
    raise FileNotFoundError(f"Input file not found: {candidates[-1]}")


def _format_of(path: str) -> str:
    suffix = os.path.splitext(path.rstrip("/"))[1].lower()
    if suffix not in FORMATS:
        raise ValueError("Unsupported file format. Use .csv, .parquet, .json or .orc")
    return FORMATS[suffix]


def null_na_tokens(df: DataFrame) -> DataFrame:
    """Turn CSV missing-value tokens into nulls in every text column."""
    tokens = F.array(*[F.lit(t) for t in NA_TOKENS])
    return df.select(
        *[
            F.when(F.array_contains(tokens, strip(F.col(f.name))), F.lit(None)).otherwise(F.col(f.name)).alias(f.name)
            if isinstance(f.dataType, T.StringType)
            else F.col(f.name)
            for f in df.schema.fields
        ]
    )


def apply_types(df: DataFrame, types: dict) -> DataFrame:
    """Cast known columns to their declared type; bad values become null."""
    out = []
    for f in df.schema.fields:
        target = types.get(f.name)
        c = F.col(f.name)
        if target is not None and f.dataType != target:
            c = c.try_cast(target)
        if isinstance(target or f.dataType, (T.DoubleType, T.FloatType)):
            c = nan_to_null(c)
        out.append(c.alias(f.name))
    return df.select(*out)


def load_table(spark: SparkSession, path: str, types: dict | None = None) -> DataFrame:
    """Scan a loan-account table; header names trimmed, NA tokens nulled."""
    fmt = _format_of(path)
    if not path_exists(spark, path):
        raise FileNotFoundError(f"Input file not found: {path}")
    reader = spark.read.format(fmt)
    if fmt == "csv":
        reader = reader.option("header", True).option("multiLine", False)
    df = reader.load(path)
    df = df.toDF(*[c.strip() for c in df.columns])
    if fmt == "csv":
        df = null_na_tokens(df)
    return apply_types(df, LOAN_TYPES if types is None else types)


def validate_columns(df: DataFrame, required: list[str]) -> None:
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"Missing required columns: {missing}")


def required_status(df: DataFrame, required: list[str]) -> tuple[list[str], list[str]]:
    present = [c for c in required if c in df.columns]
    missing = [c for c in required if c not in df.columns]
    return present, missing


# ---------------------------------------------------------------------------
# Feedback log
# ---------------------------------------------------------------------------

def empty_feedback(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], FEEDBACK_SCHEMA)


def align_feedback(df: DataFrame) -> DataFrame:
    """Fixed 15-column order; absent columns back-filled with ''."""
    cols = []
    for c in FEEDBACK_COLUMNS:
        if c in df.columns:
            x = F.col(c)
            if c == "PromisedAmount":
                x = nan_to_null(strip(x.cast("string")).try_cast("double"))
            else:
                x = x.cast("string")
        else:
            x = F.lit(None).cast("double") if c == "PromisedAmount" else F.lit("")
        cols.append(x.alias(c))
    return df.select(*cols)


def load_feedback(spark: SparkSession, path: str) -> DataFrame:
    """The feedback log (csv/parquet/json/orc by suffix); an empty 15-column
    table when the log does not exist yet."""
    if not path_exists(spark, path):
        return empty_feedback(spark)
    fmt = _format_of(path)
    reader = spark.read.format(fmt)
    if fmt == "csv":
        reader = reader.option("header", True)
    df = reader.load(path)
    df = df.toDF(*[c.strip() for c in df.columns])
    return align_feedback(null_na_tokens(df) if fmt == "csv" else df)


def canonicalize_feedback(df: DataFrame, now_ts: str, today: str) -> tuple[DataFrame, DataFrame]:
    """Canonical feedback rows and the rejected ones (blank AccountId).

    Text is trimmed, blanks take the documented defaults, ``PromisedAmount``
    is coerced to a number (else 0) and missing stamps default to ``now``.
    """
    def text(c):
        return strip(F.coalesce(F.col(c).cast("string"), F.lit(""))) if c in df.columns else F.lit("")

    cols = []
    for c in FEEDBACK_COLUMNS:
        if c == "PromisedAmount":
            x = nan_to_null(strip(F.col(c).cast("string")).try_cast("double")) if c in df.columns else F.lit(None)
            x = F.coalesce(x, F.lit(0.0)).cast("double")
        elif c in FEEDBACK_DEFAULTS:
            x = blank_default(F.col(c), FEEDBACK_DEFAULTS[c]) if c in df.columns else F.lit(FEEDBACK_DEFAULTS[c])
        elif c == "AsOfDate":
            x = F.coalesce(F.col(c).cast("string"), F.lit(today)) if c in df.columns else F.lit(today)
        elif c == "RecordedAt":
            x = blank_default(F.col(c), now_ts) if c in df.columns else F.lit(now_ts)
        else:
            x = text(c)
        cols.append(x.alias(c))
    canon = df.select(*cols)
    ok = F.col("AccountId") != ""
    return canon.filter(ok), canon.filter(~ok)


def append_feedback(log: DataFrame, new_rows: DataFrame) -> DataFrame:
    """Union of the log and new canonical rows, aligned by column name."""
    return align_feedback(log).unionByName(align_feedback(new_rows))


# ---------------------------------------------------------------------------
# Sinks and record pages
# ---------------------------------------------------------------------------

def write_table(df: DataFrame, path: str, mode: str = "overwrite", partition_by: list[str] | None = None,
                fmt: str = "parquet") -> int:
    """Write ``df``; the number of rows written, observed by the write itself (no second pass)."""
    seen = Observation()
    w = df.observe(seen, F.count(F.lit(1)).alias("rows")).write.mode(mode).format(fmt)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.save(path)
    return int(seen.get["rows"])


def save_table(df: DataFrame, name: str, mode: str = "overwrite", url: str | None = None, properties: dict | None = None,
               connections: int = 8) -> None:
    """Replace ('overwrite') or extend ('append') a catalog table, or a JDBC table when ``url`` is given."""
    if mode not in ("overwrite", "append"):
        raise ValueError("mode must be one of: overwrite, append")
    if url:
        df.write.mode(mode).format("jdbc").options(**jdbc_write_options(url, name, properties, connections)).save()
    else:
        df.write.mode(mode).saveAsTable(name)


def seed_table_if_empty(spark: SparkSession, name: str, seed: DataFrame) -> DataFrame:
    """Create/fill a catalog table from ``seed`` only when it has no rows."""
    if not spark.catalog.tableExists(name) or spark.table(name).isEmpty():
        seed.write.mode("overwrite").saveAsTable(name)
    return spark.table(name)


def at_least_one(n: int) -> int:
    """The caller's limit, unbounded above."""
    return max(1, int(n))


def record_page(df: DataFrame, limit: int, order_by: list | None = None) -> DataFrame:
    """First ``limit`` rows (text nulls as '') plus the table's total rows.

    The total is a scalar subquery attached to the (bounded) page.
    """
    page = df.orderBy(*order_by) if order_by else df
    page = page.limit(limit)
    text_cols = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    page = page.fillna("", subset=text_cols) if text_cols else page
    return page.withColumn("total", df.agg(F.count(F.lit(1))).scalar())


# ---------------------------------------------------------------------------
# SQL / catalog tables, job log, account ids
# ---------------------------------------------------------------------------

@dataclass(frozen=True)
class Slices:
    """How a JDBC table is read in parallel: ``count`` ranges of equal width of a numeric,
    date or timestamp column. Rows beyond the bounds belong to the outer ranges."""

    column: str
    lower: int | str
    upper: int | str
    count: int


def jdbc_options(url: str, name: str, properties: dict | None = None, slices: Slices | None = None, fetch: int = 10_000) -> dict[str, str]:
    """Options of a JDBC read; without ``slices`` the table is one task."""
    options = {"fetchsize": str(fetch), **{k: str(v) for k, v in (properties or {}).items()}, "url": url, "dbtable": name}
    if slices is not None:
        if slices.count < 1:
            raise ValueError("a table is read in one slice or more")
        options |= {"partitionColumn": slices.column, "lowerBound": str(slices.lower), "upperBound": str(slices.upper),
                    "numPartitions": str(slices.count)}
    return options


def jdbc_write_options(url: str, name: str, properties: dict | None = None, connections: int = 8, batch: int = 10_000) -> dict[str, str]:
    """Options of a JDBC write: at most ``connections`` at once (Spark merges partitions for
    it), rows in batches; a replaced table is emptied, so its definition and grants stay."""
    if connections < 1:
        raise ValueError("a write needs one connection or more")
    return {"batchsize": str(batch), "truncate": "true", **{k: str(v) for k, v in (properties or {}).items()},
            "url": url, "dbtable": name, "numPartitions": str(connections)}


def read_sql_table(spark: SparkSession, name: str, url: str | None = None, properties: dict | None = None,
                   slices: Slices | None = None) -> DataFrame:
    """A catalog table, or a JDBC table when ``url`` is given (``SELECT *``), read in ``slices``."""
    if url:
        return spark.read.format("jdbc").options(**jdbc_options(url, name, properties, slices)).load()
    return spark.table(name)


def _is_table(spark: SparkSession, name: str) -> bool:
    if "/" in name:
        return False
    try:
        return bool(spark.catalog.tableExists(name))
    except Exception:
        return False


def output_exists(spark: SparkSession, name_or_path: str) -> bool:
    """True when the table/path exists and holds at least one row."""
    if _is_table(spark, name_or_path):
        return not spark.table(name_or_path).isEmpty()
    if path_exists(spark, name_or_path):
        return not _read_path(spark, name_or_path).isEmpty()
    return False


def _read_path(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """A csv, parquet, json or orc path by suffix; without a suffix (an output folder) parquet."""
    fmt = _format_of(path) if os.path.splitext(path.rstrip("/"))[1] else "parquet"
    reader = spark.read.format(fmt)
    if schema is not None and fmt == "json":
        reader = reader.schema(schema)
    return (reader.option("header", True) if fmt == "csv" else reader).load(path)


JOB_TIME_COLUMNS = ["next_attempt_at", "created_at", "updated_at"]


def load_job_log(spark: SparkSession, path_or_table: str) -> DataFrame:
    """Job log (table, or csv/parquet/json/orc path) with ISO-8601 UTC text stamps
    ('...Z') converted to timestamps and its counters to their types."""
    text_stamps = T.StructType([T.StructField(f.name, T.StringType() if f.name in JOB_TIME_COLUMNS else f.dataType)
                                for f in JOB_SCHEMA.fields])
    df = spark.table(path_or_table) if _is_table(spark, path_or_table) else _read_path(spark, path_or_table, text_stamps)
    df = apply_types(df, {f.name: f.dataType for f in JOB_SCHEMA.fields if f.name not in JOB_TIME_COLUMNS})
    for c in JOB_TIME_COLUMNS:
        if c in df.columns and isinstance(df.schema[c].dataType, T.StringType):
            df = df.withColumn(c, parse_stamp(F.col(c)))
    return df


def assign_account_ids(df: DataFrame, order_cols: list | None = None, id_col: str = "AccountNo") -> DataFrame:
    """Store an account id once at ingest: the first id candidate as text, or
    ``ACC_<position>`` in the given source order (distributed row index)."""
    from ..functions.exprs import first_existing
    from ..operators.ordering import global_row_index
    from ..schema import ID_CANDIDATES

    existing = first_existing(df.columns, ID_CANDIDATES)
    if existing is not None:
        return df.withColumn(id_col, F.col(existing).cast("string"))
    order = order_cols or [F.col(c) for c in df.columns]
    idx = global_row_index(df, order, "_row")
    return idx.withColumn(id_col, F.concat(F.lit("ACC_"), F.col("_row").cast("string"))).drop("_row")


def decode_json(df: DataFrame, col_name: str, schema: str) -> DataFrame:
    """Parse a JSON text column (payload, details) into a struct column."""
    return df.withColumn(col_name.replace("_json", ""), F.from_json(F.col(col_name), schema))


def decode_fields(df: DataFrame, col_name: str, fields: dict[str, tuple[str, str]]) -> DataFrame:
    """Fields of a JSON text column whose shape differs from row to row.

    ``fields`` maps a new column to (path, type), such as ``("$.steps[0].id", "bigint")``.
    The text is parsed once a row into a VARIANT. Bad JSON, a missing path and
    a value that is not of the type give null; ``<col>_valid`` tells whether
    the text was JSON (null for null text).
    """
    value = F.try_parse_json(F.col(col_name))
    parsed = df.withColumn("_cl_v", value)
    valid = F.when(F.col(col_name).isNotNull(), F.col("_cl_v").isNotNull())
    out = parsed.withColumn(f"{col_name}_valid", valid)
    for name, (path, kind) in fields.items():
        out = out.withColumn(name, F.try_variant_get(F.col("_cl_v"), path, kind))
    return out.drop("_cl_v")
