"""Scans and writes (S1, S2, S5-S10) plus the row identity column.

Between stages tables are parquet with a fixed schema; CSV exists only for
raw input and for users who ask for it.  Nothing infers a schema.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from blotter.functions import fixed

# Raw incident columns and their Spark types (text is cast with try_cast).
RAW_TYPES = {
    "ID": "bigint",
    "Date": "string",
    "Primary Type": "string",
    "Description": "string",
    "Location Description": "string",
    "Arrest": "boolean",
    "Domestic": "boolean",
    "Beat": "int",
    "District": "double",
    "Ward": "double",
    "Community Area": "double",
    "Year": "int",
    "Latitude": "double",
    "Longitude": "double",
}

ROW_KEY = "row_key"
_NULL_SENTINEL = "\u0000<null>"


#: The dialect that pandas and most tools write: quotes within a quoted field are doubled, no escape character.
CSV_DIALECT = {"quote": '"', "escape": '"'}


def cast_text(text: Column, kind: str) -> Column:
    """Text to a type, NULL if malformed.

    A column of integers with gaps is written as ``111.0`` by pandas, so whole decimal numbers are integers too.
    """
    if kind not in ("int", "bigint"):
        return text.try_cast(kind)
    number = text.try_cast("decimal(38,6)")
    return F.coalesce(text.try_cast(kind), F.when(number == F.floor(number), F.floor(number).try_cast(kind)))


def read_raw_csv(spark: SparkSession, path: str, types: dict[str, str] | None = None,
                 drop_index: bool = True, missing_tokens: list[str] | None = None, multi_line: bool = False) -> DataFrame:
    """Scan raw CSV text.

    Every field is read as text, the pandas-style missing tokens become NULL,
    and known columns are cast so that malformed values give NULL.
    The unnamed leading index column (``_c0``) is dropped.  Quoted fields may
    hold commas and doubled quotes.  Line breaks within fields need
    ``multi_line``; such a file is read by one task, so it is off by default.
    """
    types = RAW_TYPES if types is None else types
    tokens = fixed.MISSING_TOKENS if missing_tokens is None else missing_tokens
    reader = (spark.read.options(**CSV_DIALECT).option("mode", "PERMISSIVE").option("inferSchema", False)
              .option("nullValue", None).option("emptyValue", ""))
    raw = reader.option("header", True).csv(path)
    cols = raw.columns
    if multi_line:  # Spark's header check fails on an unnamed column here, so header rows are left out by their content
        named = [None if c == f"_c{i}" else c for i, c in enumerate(cols)]
        schema = T.StructType([T.StructField(c, T.StringType()) for c in cols])
        raw = reader.schema(schema).option("header", False).option("multiLine", True).csv(path)
        header = F.lit(True)
        for c, name in zip(cols, named, strict=True):
            header = header & F.col(f"`{c}`").eqNullSafe(F.lit(name))
        raw = raw.filter(~header)
    if drop_index and cols and (cols[0] == "_c0" or cols[0] == ""):
        cols = cols[1:]
    out = []
    for c in cols:
        text = F.col(f"`{c}`")
        cleaned = F.when(text.isin(*tokens), F.lit(None)).otherwise(text)
        t = types.get(c, "string")
        out.append((cleaned if t == "string" else cast_text(cleaned, t)).alias(c))
    return raw.select(*out)


def scan_with_rejects(spark: SparkSession, path: str, types: dict[str, str] | None = None, drop_index: bool = True,
                      missing_tokens: list[str] | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, rejects, report) of raw CSV text (S1): what :func:`read_raw_csv` would pad or blank in silence is told.

    A line with too few or too many fields is rejected: ``rejects`` holds it as text.  ``rows`` are the others, cast
    as usual, with ``_failed``, the names of the columns whose text did not fit their type (NULL there).  ``report``
    has (kind, column, count): lines ``accepted`` and ``rejected``, which add up to the input, and per typed column
    the values that ``failed`` or were ``missing``, over accepted lines.
    """
    types = RAW_TYPES if types is None else types
    tokens = fixed.MISSING_TOKENS if missing_tokens is None else missing_tokens
    reader = spark.read.options(**CSV_DIALECT).option("inferSchema", False).option("nullValue", None).option("emptyValue", "")
    cols = reader.option("header", True).csv(path).columns
    schema = T.StructType([T.StructField(c, T.StringType()) for c in [*cols, "_line"]])
    # no pruning: a pruned parse fills up short lines; header rows go by content: Spark's check fails on an unnamed column
    raw = (reader.schema(schema).option("header", False).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_line")
           .option("columnPruning", False).csv(path))
    header = F.lit(True)
    for i, c in enumerate(cols):
        header = header & F.col(f"`{c}`").eqNullSafe(F.lit(None if c == f"_c{i}" else c))
    raw = raw.filter(~header)
    wanted = cols[1:] if drop_index and cols and cols[0] in ("_c0", "") else cols
    out, failed = [], []
    for c in wanted:
        text = F.col(f"`{c}`")
        clean = F.when(text.isin(*tokens), F.lit(None)).otherwise(text)
        kind = types.get(c, "string")
        value = clean if kind == "string" else cast_text(clean, kind)
        out.append(value.alias(c))
        if kind != "string":
            failed.append(F.when(clean.isNotNull() & value.isNull(), F.lit(c)))
    bad = F.array_compact(F.array(*failed)) if failed else F.array().cast("array<string>")
    both = raw.select(*out, bad.alias("_failed"), "_line")
    rows = both.filter(F.col("_line").isNull()).drop("_line")
    rejects = both.filter(F.col("_line").isNotNull()).select(F.col("_line").alias("line"))
    typed = [c for c in wanted if types.get(c, "string") != "string"]
    taken = F.col("_line").isNull()
    counts = [F.count_if(taken).alias("n0"), F.count_if(~taken).alias("n1")]
    parts = ["'accepted', cast(null as string), n0", "'rejected', cast(null as string), n1"]
    for i, c in enumerate(typed):
        broken = F.array_contains("_failed", c)
        counts += [F.count_if(taken & broken).alias(f"f{i}"), F.count_if(taken & ~broken & F.col(f"`{c}`").isNull()).alias(f"m{i}")]
        name = "'" + c.replace("\\", "\\\\").replace("'", "\\'") + "'"
        parts += [f"'failed', {name}, f{i}", f"'missing', {name}, m{i}"]
    report = both.agg(*counts).selectExpr(f"stack({len(parts)}, {', '.join(parts)}) as (kind, column, count)")
    return rows, rejects, report


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Write a table as CSV with a header and no index column."""
    (df.write.mode(mode).options(**CSV_DIALECT).option("header", True).option("nullValue", "")
     .option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss.SSSSSS")
     .option("timestampFormat", "yyyy-MM-dd HH:mm:ss.SSSSSS").csv(path))


def read_csv_typed(spark: SparkSession, path: str, schema: T.StructType, multi_line: bool = False) -> DataFrame:
    """Read a CSV written by :func:`write_csv` back with a fixed schema."""
    return (spark.read.schema(schema).options(**CSV_DIALECT).option("multiLine", multi_line).option("header", True).option("mode", "PERMISSIVE")
            .option("nullValue", "")
            .option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss.SSSSSS")
            .option("timestampFormat", "yyyy-MM-dd HH:mm:ss.SSSSSS").csv(path))


def read_table(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame:
    """Typed parquet scan (S2); a column list prunes the read schema."""
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def load_optional(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Scan a table that may be absent (S5): absent -> empty table of ``schema``."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def write_table(df: DataFrame, path: str, mode: str = "overwrite",
                partition_by: list[str] | None = None) -> None:
    """Parquet write of a stage output."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def _as_text(c: str) -> Column:
    return F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(_NULL_SENTINEL))


def row_key_expr(columns: list[str]) -> Column:
    """md5 over every listed column; NULL is replaced by a sentinel first.

    ``concat_ws`` alone would skip NULLs and let different rows collide.
    """
    return F.md5(F.concat_ws("\u0001", *[_as_text(c) for c in columns]))


def with_row_key(df: DataFrame, id_col: str | None = None, name: str = ROW_KEY) -> DataFrame:
    """Attach a plan-independent identity column.

    With a unique ``id_col`` that column (as text) is the key; otherwise rows
    must already be distinct and the key is a hash of all their values.
    """
    if id_col is not None:
        return df.withColumn(name, F.col(f"`{id_col}`").cast("string"))
    return df.withColumn(name, row_key_expr(df.columns))


def save_model(model, path: str) -> None:
    """Persist a fitted Spark ML model or pipeline."""
    model.write().overwrite().save(path)

