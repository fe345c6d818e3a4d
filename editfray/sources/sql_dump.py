"""SQL dumps: rows of multi-row INSERT statements, by expressions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# A quoted string with its escapes, unrolled so that a long one needs no deep stack.
_QUOTED = r"'[^'\\]*+(?:(?:\\.|'')[^'\\]*+)*+'"
_TUPLE = rf"(?s)\(((?:{_QUOTED}|[^'()])*+)\)"
_FIELD = rf"(?s)\s*({_QUOTED}|[^,']*+)\s*(?:,|$)"


def _value(raw: Column) -> Column:
    """A field without quotes and escapes; NULL is null, in quotes as well; blanks around it go."""
    text = F.btrim(raw)
    quoted = text.startswith("'")
    inner = F.substring(text, F.lit(2), F.char_length(text) - 2)
    for a, b in ((r"\\n", "\n"), (r"\\r", "\r"), (r"\\t", "\t"), (r"\\0", "\0"), ("''", "'"), (r"\\(.)", "$1")):
        inner = F.regexp_replace(inner, a, b)
    out = F.when(quoted, F.btrim(inner)).otherwise(text)
    return F.when(F.upper(out) == "NULL", None).otherwise(out)


def rows(lines: DataFrame, table: str, columns: list[str]) -> DataFrame:
    """lines (value) of a dump: the named columns of the table's rows, as strings. Rows of fewer fields are left out."""
    start = f"INSERT INTO `{table}` VALUES "
    tuples = lines.where(F.col("value").startswith(start)).select(F.explode(F.regexp_extract_all(F.substring(F.col("value"), F.lit(len(start) + 1), F.char_length("value")), F.lit(_TUPLE), F.lit(1))).alias("t"))
    fields = tuples.select(F.transform(F.regexp_extract_all(F.concat("t", F.lit(",")), F.lit(_FIELD), F.lit(1)), _value).alias("f")).where(F.size("f") >= len(columns))
    return fields.select(*[F.get("f", F.lit(i)).alias(c) for i, c in enumerate(columns)])


def restrictions(spark: SparkSession, path: str) -> DataFrame:
    """page_id, type, level, cascade, expiry of a restrictions dump, for operators.governance.restrictions()."""
    return restrictions_of(spark.read.text(path))


def restrictions_of(lines: DataFrame) -> DataFrame:
    found = rows(lines, "page_restrictions", ["page_id", "type", "level", "cascade", "expiry"])
    return found.withColumns({"page_id": F.col("page_id").try_cast("bigint"), "cascade": F.coalesce(F.col("cascade").try_cast("int"), F.lit(0))}).where("page_id > 0")
