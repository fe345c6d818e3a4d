"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Whole epochs of a source come first; the rest of its target is filled by
documents in the order of their exponential keys, -ln(u) / quality, up to a token
budget. The order of one source is never put in one task: keys fall into cells,
whole cells are taken by their sums, and only the cell that the budget ends in
is ordered row by row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, free, named, numbered, numbered_nulls, quoted, table

WEIGHTS = (3.0, 1.0, 2.0)
CELLS = 4096


def word_count(text: Column) -> Column:
    """Runs of [^\\x20\\x09-\\x0D]; null has none."""
    blank = r"[\x20\x09-\x0D]+"
    parts = F.size(F.split(text, blank, -1))
    ends = F.regexp_like(text, F.lit(r"^[\x20\x09-\x0D]")).cast("int") + F.regexp_like(text, F.lit(r"[\x20\x09-\x0D]\z")).cast("int")
    return F.when(text.isNull(), 0).when(F.btrim(text, F.lit(" \t\n\x0b\f\r")) == "", 0).otherwise(parts - ends).cast("long")


def quality(size: Column, n_chars: Column) -> Column:
    """0.5 to 1: highest where a word and its blank take six characters on average, as in running text."""
    return F.lit(0.5) + F.lit(0.5) / (F.lit(1.0) + F.abs(n_chars / F.greatest(size, F.lit(1)) - F.lit(6.0)))


def uniform(id_col: Column, seed: int) -> Column:
    """In (0, 1), from md5 of the seed and the id: the same in every run and engine."""
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit("")))), 1, 12)
    return (F.conv(digits, 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(1 << 48))


def source_targets(sized: DataFrame, share: float = 1.5, most: float = 2.0, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """source, source_size, target: one row a source. Weights go round the sources by code point, null last.

    Water-filling: the level at which all sources share, by weight, rises as those stopped at most * source_size hand on
    their excess; each round is two sums over the sources, until none more is stopped. Sources are sorted and numbered in parts, never in one task.
    """
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size")).orderBy(F.col("source").asc_nulls_last())
    sums = numbered(cut(sums.withColumn("at", F.monotonically_increasing_id()), "sources"), "at", "place")
    w = F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int"))
    sums = sums.withColumn("w", w).withColumn("stop", F.lit(most) * F.col("source_size"))
    all_ = sums.agg(F.sum("source_size").alias("size"), F.sum("w").alias("w")).first()
    level = share * all_["size"] / all_["w"] if all_["w"] else 0.0
    while all_["w"]:
        full = sums.where(F.lit(level) * F.col("w") > F.col("stop")).agg(F.coalesce(F.sum("stop"), F.lit(0.0)).alias("stop"), F.coalesce(F.sum("w"), F.lit(0.0)).alias("w")).first()
        new = (share * all_["size"] - full["stop"]) / (all_["w"] - full["w"]) if full["w"] < all_["w"] else level
        if new <= level:
            break
        level = new
    return sums.select("source", "source_size", F.least(F.col("stop"), F.lit(level) * F.col("w")).alias("target"))


def mix(
    docs: DataFrame, share: float = 1.5, most: int = 2, weights: tuple[float, ...] = WEIGHTS, seed: int = 17,
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", also: tuple[Column, ...] = (),
) -> DataFrame:
    """id, size, source_size, target and taken (words, repeats counted) for each row of docs.

    Each source's target is reached to within half of the document at its end.
    Null and blank texts have size 0 and nothing taken; null is a source of its
    own. Keys hang on the id, so rows that repeat an id with one size follow each
    other, and every run agrees. Ties in the key fall to the id, then to the
    size. An empty table gives an empty one. Only the named columns are read,
    whatever the others are called; those of `also` pass through.
    """
    text = quoted(text_col)
    sized = docs.select(quoted(id_col).alias("doc_id"), quoted(source_col).alias("source"), word_count(text).alias("size"), F.char_length(text).alias("n"), *also)
    # Four numbers a row from here on: the texts are read once.
    sized = cut(sized, "sizes")
    return mix_sized(sized, share, most, weights, seed, tuple(sized.columns[4:]))


def mix_sized(sized: DataFrame, share: float, most: int, weights: tuple[float, ...], seed: int, also: tuple[str, ...] = ()) -> DataFrame:
    targets = source_targets(sized, share, float(most), weights).select(
        F.col("source").alias("s"), "source_size", "target",
        F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long").alias("epochs"),
    ).withColumn("budget", F.col("target") - F.col("epochs") * F.col("source_size"))
    key = -F.log(uniform(F.col("doc_id"), seed)) / quality(F.col("size"), F.coalesce("n", F.lit(0)))
    # Any rising function of the key makes cells; this one makes them about even.
    keyed = sized.withColumn("key", key).withColumn("cell", F.floor(F.lit(CELLS) * (F.lit(1.0) - F.exp(-F.col("key") * F.lit(0.8)))))
    cells = keyed.groupBy("source", "cell").agg(F.sum("size").alias("cell_size"))
    before = Window.partitionBy("source").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    # Of each source: where each cell begins. Up to CELLS + 1 rows a source, whatever its size.
    starts = cells.select(F.col("source").alias("c_s"), F.col("cell").alias("c_cell"), "cell_size", F.coalesce(F.sum("cell_size").over(before), F.lit(0)).alias("start"))
    placed = keyed.join(
        starts.join(targets, F.col("c_s").eqNullSafe(F.col("s"))).drop("s"),
        F.col("source").eqNullSafe(F.col("c_s")) & (F.col("cell") == F.col("c_cell")),
    )
    ends_here = (F.col("start") < F.col("budget")) & (F.col("start") + F.col("cell_size") > F.col("budget"))
    out = [*also, "doc_id", "size", "source_size", "target"]
    taken = lambda more: (F.col("size") * (F.col("epochs") + more.cast("long"))).alias("taken")
    whole = placed.where(~ends_here).select(*out, taken(F.col("start") + F.col("cell_size") <= F.col("budget")))
    order = Window.partitionBy("source").orderBy("key", "doc_id", "size", *also).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # The one cell of each source in which the budget ends.
    edge = placed.where(ends_here).withColumn("upto", F.col("start") + F.sum("size").over(order))
    edge = edge.select(*out, taken(F.col("upto") - F.col("size") / 2 <= F.col("budget")))
    return whole.unionByName(edge)


def mixed_rows(docs: DataFrame, id_col: str = "doc_id", **how) -> DataFrame:
    """The rows of docs, with their columns, as often as the mix takes them; rows that share an id as often as the most of them,
    those with a null id each on its own."""
    row, own_id, at, often, i = free(docs, "row", "own_id", "at", "often", "i")
    nulls = numbered_nulls(docs, id_col, row)
    rows, also = docs, ()
    if nulls is not None:
        rows, also = docs.where(quoted(id_col).isNotNull()).withColumn(row, F.lit(None).cast("long")).unionByName(nulls), (F.col(row).alias("row"),)
    times = F.max(F.col("taken") / F.col("size")).cast("int").alias(often)
    taken = mix(rows, id_col=id_col, also=also, **how).where("taken > 0")
    same = quoted(id_col) == F.col(own_id)
    if nulls is not None:
        taken = taken.groupBy(F.col("doc_id").alias(own_id), F.col("row").alias(at)).agg(times)
        same = quoted(id_col).eqNullSafe(F.col(own_id)) & F.col(row).eqNullSafe(F.col(at))
    else:
        taken = taken.groupBy(F.col("doc_id").alias(own_id)).agg(times)
    return rows.join(taken, same).withColumn(i, F.explode(F.sequence(F.lit(1), F.col(often)))).select(*named(docs))


def query(spark, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH sized AS (
  SELECT doc_id, source, length(text) AS n,
         CASE WHEN text IS NULL THEN 0
              ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END::BIGINT AS size
  FROM documents
), sums AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         row_number() OVER (ORDER BY source NULLS LAST) AS place FROM sized GROUP BY source
), weighed AS (
  SELECT *, CASE (place - 1) % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS w,
         2.0::DOUBLE * source_size AS stop FROM sums
), levels AS (
  SELECT *,
    (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(stop) OVER (ORDER BY stop / w, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
    / (sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY stop / w, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0)) AS level
  FROM weighed
), free AS (
  SELECT level AS free FROM levels WHERE level * w <= stop ORDER BY stop / w, place LIMIT 1
), targets AS (
  SELECT source, source_size, least(stop, coalesce((SELECT free FROM free), 0.0) * w) AS target FROM levels
), budgets AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS epochs,
         target - CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT * source_size AS budget
  FROM targets
), keyed AS (
  SELECT *, -ln((('0x' || substr(md5('17:' || coalesce(doc_id::VARCHAR, '')), 1, 12))::BIGINT::DOUBLE + 0.5) / 281474976710656.0)
    / (0.5 + 0.5 / (1.0 + abs(coalesce(n, 0)::DOUBLE / greatest(size, 1) - 6.0))) AS key
  FROM sized
), summed AS (
  SELECT k.doc_id, k.size, b.source_size, b.target, b.epochs, b.budget,
    sum(k.size) OVER (PARTITION BY k.source ORDER BY k.key, k.doc_id, k.size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto
  FROM keyed k JOIN budgets b ON k.source IS NOT DISTINCT FROM b.source
)
SELECT doc_id, size, source_size, target,
       (size * (epochs + CASE WHEN upto - size / 2.0 <= budget THEN 1 ELSE 0 END))::BIGINT AS taken
FROM summed
"""
