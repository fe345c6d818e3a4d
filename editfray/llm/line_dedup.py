"""Line dedup (native): drop lines that many documents hold, but in one of them.

DataFrame functions alone. Lines are exploded as hashes, never as text, and
counted by distinct document after a partial count by (hash, document); the
positions to drop are joined back to the whole texts once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, ascii_lower, cut, free, quoted


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(BLANKS)))


def _hashes(key: Column) -> tuple[Column, Column]:
    return F.xxhash64(key), F.xxhash64(F.lit(7), key)


def _code(pos: Column, h1: Column, h2: Column) -> Column:
    """The position above 32 bits of the key's hash: rows that share an id don't mix."""
    return F.shiftleft(pos.cast("long"), 32).bitwiseOR(h1.bitwiseXOR(h2).bitwiseAND(0xFFFFFFFF))


def line_dedup(docs: DataFrame, min_docs: int = 3, min_chars: int = 20, id_col: str = "doc_id", text_col: str = "text", counts: tuple[str, str] = ("n_lines", "n_dropped")) -> DataFrame:
    """All columns of docs with `text_col` rewritten, plus the `counts`: n_lines (before) and n_dropped.

    A key (line stripped of blanks, A-Z lower-cased) of at least min_chars code
    points that min_docs distinct ids hold loses its lines in all documents but
    the one with the largest id; there every repeat stays. Other lines keep
    their bytes and order. Null text counts as one empty line and becomes the
    empty text. Rows that repeat an id are one document for the count, and each
    is rewritten; rows with a null id add nothing to a count and lose such lines.
    An empty table gives an empty one. Other columns pass through as they are,
    but for those of the names in `counts`, which are replaced.
    """
    text = F.coalesce(quoted(text_col), F.lit(""))
    # A line of n code points has n bytes at least: most short lines go before their key is made.
    keys = F.filter(
        F.transform(F.split(text, "\n", -1), lambda line, i: F.struct(i.alias("pos"), F.when(F.octet_length(line) >= min_chars, line_key(line)).alias("key"))),
        lambda k: F.char_length(k["key"]) >= min_chars,
    )
    h1, h2 = _hashes(F.col("k.key"))
    held = docs.select(quoted(id_col).alias("id"), F.explode(keys).alias("k")).select("id", F.col("k.pos").alias("pos"), h1.alias("h1"), h2.alias("h2"))
    # One row for a document and key goes to the count, however hot the key is.
    common = (
        held.groupBy("h1", "h2", "id").agg(F.lit(1).alias("one"))
        .groupBy("h1", "h2").agg(F.count("id").alias("n"), F.max("id").alias("keeper"))
        .where(F.col("n") >= min_docs)
        .select("h1", "h2", "keeper")
    )
    # Written, it is a plain side of the join: where a hot key skews the other, Spark splits that.
    common = cut(common, "common-lines")
    own_id, gone, lines, kept = free(docs, "own_id", "gone", "lines", "kept")
    dropped = (
        held.join(common, ["h1", "h2"])
        .where(~F.col("id").eqNullSafe(F.col("keeper")))
        .groupBy(F.col("id").alias(own_id)).agg(F.collect_set(_code(F.col("pos"), F.col("h1"), F.col("h2"))).alias(gone))
    )
    others = [c for c in docs.columns if c.lower() not in map(str.lower, counts)]
    joined = docs.select(*map(quoted, others)).join(dropped, quoted(id_col).eqNullSafe(F.col(own_id)), "left")
    codes = F.transform(F.col(lines), lambda line, i: _code(i, *_hashes(line_key(line))))
    # array_except() hashes longs, and codes of one text differ: it keeps repeats and order.
    left = F.transform(F.array_except(codes, F.col(gone)), lambda c: F.get(F.col(lines), F.shiftright(c, 32).cast("int")))
    split = joined.withColumn(lines, F.split(text, "\n", -1)).withColumn(kept, F.when(F.col(gone).isNull(), F.col(lines)).otherwise(left))
    return split.select(
        *[F.when(F.col(gone).isNull(), text).otherwise(F.array_join(kept, "\n")).alias(c) if c == text_col else quoted(c) for c in others],
        F.size(lines).cast("long").alias(counts[0]),
        (F.size(lines) - F.size(kept)).cast("long").alias(counts[1]),
    )


def query(spark, sf_dir: str) -> DataFrame:
    from .common import table

    out = line_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


ORACLE = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents
), keyed AS (
  SELECT doc_id, pos, line,
         translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines
), common AS (
  SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 20
  GROUP BY key HAVING count(DISTINCT doc_id) >= 3
), marked AS (
  SELECT k.doc_id, k.pos, k.line, c.key IS NOT NULL AND k.doc_id <> c.keeper AS gone
  FROM keyed k LEFT JOIN common c ON k.key = c.key
)
SELECT doc_id, count(*) AS n_lines, sum(CASE WHEN gone THEN 1 ELSE 0 END)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
