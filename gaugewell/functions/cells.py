"""Cell-level expressions: missing values, infinities, text keys, percentages.

Everything here is a built-in Spark expression, so it stays inside whole-stage
code generation and reaches the scan as a pruned projection.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F, types as T

INF = float("inf")


def qcol(name: str) -> Column:
    """Reference a column whose name may hold dots, spaces or backticks."""
    return F.col("`" + name.replace("`", "``") + "`")


def is_float(dtype: T.DataType) -> bool:
    return isinstance(dtype, (T.FloatType, T.DoubleType))


def type_group(dtype: T.DataType) -> str:
    """Map a Spark type to numeric / categorical / boolean / datetime / unsupported."""
    if isinstance(dtype, T.NumericType):
        return "numeric"
    if isinstance(dtype, (T.StringType, T.CharType, T.VarcharType)):
        return "categorical"
    if isinstance(dtype, T.BooleanType):
        return "boolean"
    if isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "datetime"
    return "unsupported"


def present(name: str, dtype: T.DataType) -> Column:
    """The cell with NaN turned into null and -0.0 into 0.0; infinities are kept."""
    c = qcol(name)
    if is_float(dtype):
        return F.when(~F.isnan(c), c + F.lit(0.0).cast(dtype))
    return c


def finite(name: str, dtype: T.DataType) -> Column:
    """A numeric cell as double with NaN and both infinities turned into null."""
    c = qcol(name).cast("double")
    if is_float(dtype):
        return F.when(F.abs(c) < F.lit(INF), c + F.lit(0.0))
    return c


def is_infinite(name: str, dtype: T.DataType, sign: int) -> Column:
    if not is_float(dtype):
        return F.lit(False)
    return F.coalesce(qcol(name).cast("double") == F.lit(sign * INF), F.lit(False))


def text(name: str, dtype: T.DataType) -> Column:
    """The cell as a string that is equal exactly when the cells are equal."""
    c = present(name, dtype)
    if isinstance(dtype, (T.ArrayType, T.MapType, T.StructType)):
        return F.to_json(c)
    if isinstance(dtype, T.BinaryType):
        return F.hex(c)
    return c.cast("string")


def text_key(name: str, dtype: T.DataType) -> Column:
    """Grouping key of a cell: its whole text, so that shown values and ties are those of the cells."""
    return text(name, dtype)


HEAD = 32  # characters of a text that are compared and shuffled as they are


def text_digest(x: Column) -> list[Column]:
    """(head, h1, h2): a text of up to HEAD characters is its head; a longer one has 128 bits of hashes besides. Null is all null."""
    longer = F.char_length(x) > HEAD
    return [
        F.substring(x, 1, HEAD).alias("head"), F.when(longer, F.xxhash64(F.lit(17), x)).alias("h1"),
        F.when(longer, F.xxhash64(F.lit(8191), x)).alias("h2"),
    ]


def percent(part: Column, whole: Column) -> Column:
    """100 * part / whole rounded to two places; 0 when the whole is 0."""
    share = part.cast("double") * 100.0 / F.when(whole != 0, whole.cast("double"))
    return F.coalesce(F.round(share, 2), F.lit(0.0))


def row_digest(names_types: list[tuple[str, T.DataType]]) -> list[Column]:
    """Two independent 64-bit hashes of a whole row, with the null pattern mixed in.

    xxhash64 skips nulls, so each cell is hashed next to its null flag.
    """
    cells: list[Column] = []
    for name, dtype in names_types:
        c = text(name, dtype) if type_group(dtype) == "unsupported" else present(name, dtype)
        cells += [c, c.isNull()]
    return [F.xxhash64(F.lit(17), *cells), F.xxhash64(F.lit(8191), *reversed(cells))]


def json_safe(name: str, dtype: T.DataType) -> Column:
    """NaN and infinities become null; other cells are unchanged."""
    c = qcol(name)
    if is_float(dtype):
        return F.when(F.abs(c) < F.lit(INF), c).alias(name)
    return c.alias(name)


def csv_safe(name: str, dtype: T.DataType) -> Column:
    """Prefix a quote to strings a spreadsheet would run as a formula."""
    c = qcol(name)
    if type_group(dtype) != "categorical":
        return c.alias(name)
    return F.when(c.rlike("^[=+@-]"), F.concat(F.lit("'"), c)).otherwise(c).alias(name)
