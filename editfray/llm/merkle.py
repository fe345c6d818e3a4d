"""Merkle dataset manifest: a digest a row, trees over the rows of each group, a proof a row.

Leaves are sorted and numbered by ranges, and go by their numbers to aligned blocks
of a bounded number of leaves. In a block every level is two windows over the same order:
the node of a level stands in the row of its first leaf, so its siblings are lag and lead
columns at fixed offsets, masked by the node's slot and the length of its run; the
first child's row hashes the parent, and a fill hands what it saw to the other rows below it. A block's root is
a leaf of the next pass, with a thousandth of the rows. No window holds more than a block, however many
rows a group has, and all levels of a block share one shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, free, named, numbered, quoted, table

#: Leaves of a block, at most.
BLOCK = 1024


def sha(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def field(c: Column) -> Column:
    """What a value adds to its row's digest: `-` for null, else its bytes in UTF-8, `:`, the value."""
    text = c.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(*columns: Column) -> Column:
    """The digest of a row."""
    return sha(*map(field, columns))


def _levels(runs: int, most: int) -> int:
    """Levels of a block: as many as BLOCK leaves allow and a group of `most` nodes has, one at least."""
    n = 1
    while runs ** (n + 1) <= BLOCK and runs**n < most:
        n += 1
    return n


def _climb(nodes: DataFrame, runs: int, levels: int) -> DataFrame:
    """nodes (g, pos from 0, n: nodes of the group, node) with block, root (of the block), and path: for each level the siblings left and right.

    A level is climbed where a group still has several nodes."""
    block = Window.partitionBy("g", "block").orderBy("pos")
    seen = block.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    all_ = block.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = nodes.withColumn("block", F.floor(F.col("pos") / F.lit(runs**levels)).cast("long")).withColumn("at", F.col("node"))
    for level in range(levels):
        step = runs**level
        place = F.floor(F.col("pos") / F.lit(step))
        slot, held = place % runs, F.ceil(F.col("n") / F.lit(step))
        run = F.least(F.lit(runs), held - (place - slot))
        first, several = F.col("pos") % step == 0, F.col("n") > step
        left = [F.when(slot >= j, F.lag("at", j * step).over(block)).otherwise("") for j in range(runs - 1, 0, -1)]
        right = [F.when(slot + j < run, F.lead("at", j * step).over(block)).otherwise("") for j in range(1, runs)]
        # Only the row of a node's first leaf sees its siblings, and only a run's first child hashes the parent.
        saw = F.when(first, F.struct(F.concat(*left).alias("left"), F.concat(*right).alias("right")))
        rows = rows.withColumn("saw", saw)
        parent = F.when(several, F.when(first & (slot == 0), sha(F.col("at"), F.col("saw.right")))).otherwise(F.col("at"))
        rows = rows.withColumn("at", parent).withColumn(f"saw{level}", F.when(several, F.last("saw", ignorenulls=True).over(seen))).drop("saw")
    path = F.filter(F.array(*[f"saw{level}" for level in range(levels)]), lambda s: s.isNotNull())
    rows = rows.withColumn("root", F.first("at").over(all_)).withColumn("path", path)
    return rows.drop("at", *[f"saw{level}" for level in range(levels)])


def _trees(leaves: DataFrame, runs: int, name: str) -> DataFrame:
    """leaves (g, pos, n, node, others) with root, of the group's tree, and path: siblings left and right for each level, from the leaf up."""
    most = leaves.agg(F.max("n").alias("n")).first()["n"] or 0
    levels = _levels(runs, most)
    low, step = cut(_climb(leaves, runs, levels), name), runs**levels
    if most <= step:
        return low.drop("block")
    tops = low.where(F.col("pos") % step == 0).select("g", F.col("block").alias("pos"), F.ceil(F.col("n") / F.lit(step)).cast("long").alias("n"), F.col("root").alias("node"))
    tops = _trees(tops, runs, f"{name}-up").select(F.col("g").alias("u_g"), F.col("pos").alias("u_pos"), F.col("root").alias("u_root"), F.col("path").alias("u_path"))
    joined = low.join(tops, F.col("g").eqNullSafe(F.col("u_g")) & (F.col("block") == F.col("u_pos")))
    return joined.withColumn("root", F.col("u_root")).withColumn("path", F.concat("path", "u_path")).drop("block", "u_g", "u_pos", "u_root", "u_path")


def _placed(rows: DataFrame, by: str, *order: Column) -> DataFrame:
    """rows with g (of `by`), pos (from 0, in its group) and n (rows of the group): sorted by ranges, never in one task."""
    ordered = cut(rows.orderBy(F.col(by), *order).withColumn("at", F.monotonically_increasing_id()), "sorted-leaves")
    ordered = numbered(ordered, "at", "pos")
    spans = ordered.groupBy(F.col(by).alias("g")).agg(F.min("pos").alias("begin"), F.count("*").alias("n"))
    return ordered.join(spans, F.col(by).eqNullSafe(F.col("g"))).withColumn("pos", F.col("pos") - F.col("begin")).drop("begin", by)


def proof(path: Column) -> Column:
    """The digest of all siblings of a path, level by level, left to right."""
    return F.sha2(F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), ""), 256)


def folded(start: Column, path: Column) -> Column:
    """The root that a leaf's digest leads to along a path."""
    return F.aggregate(path, start, lambda at, s: sha(s["left"], at, s["right"]))


def manifest(docs: DataFrame, columns: Sequence[str] = ("doc_id", "source", "lang", "n_chars", "text"), group_col: str = "lang", id_col: str = "doc_id", runs: int = 2, also: tuple[Column, ...] = ()) -> DataFrame:
    """id, leaf, subroot, root and path for each row of docs; columns of `also` pass through.

    leaf is the digest of the row's `columns`. The leaves of a group ascend by id (null first; rows that repeat an id by leaf, so that order and
    root hang on no run); while several nodes remain, every `runs` consecutive ones become the digest of
    their digests, written one behind the other; the last run may be shorter, down to one. What remains is the subroot: a lone leaf is its own.
    Subroots, in the order of their group's bytes, null first, lead to root alike. path holds, level by level from
    the leaf to root, the siblings to the left and to the right: see folded() and proof(). Null and empty texts differ. An empty table
    gives an empty one. Only the named columns are read, whatever the others are called."""
    own = [quoted(c) for c in columns]
    # From here on rows have digests in place of texts, which are read once.
    leaves = cut(docs.select(quoted(group_col).cast("string").alias("group"), quoted(id_col).alias("id"), leaf(*own).alias("node"), *also), "leaves")
    low = _trees(_placed(leaves, "group", F.col("id"), F.col("node")), runs, "trees")
    groups = low.groupBy("g").agg(F.first("root").alias("node"))
    top = _placed(groups.withColumn("one", F.lit(0)).withColumnRenamed("g", "part"), "one", F.col("part").asc_nulls_first())
    top = _trees(top, runs, "groups").select(F.col("part").alias("t_g"), F.col("root").alias("t_root"), F.col("path").alias("t_path"))
    out = low.join(top, F.col("g").eqNullSafe(F.col("t_g")))
    return out.select(F.col("id").alias("doc_id"), F.col("node").alias("leaf"), F.col("root").alias("subroot"), F.col("t_root").alias("root"), F.concat("path", "t_path").alias("path"), *leaves.columns[3:])


def verified(made: DataFrame, docs: DataFrame, columns: Sequence[str] = ("doc_id", "source", "lang", "n_chars", "text"), id_col: str = "doc_id") -> DataFrame:
    """Rows of docs as they are now, held against a manifest made before: its columns without path, and claimed (the leaf now), folded_root, verified.

    Rows of the two meet by id: one that the manifest doesn't know, and one that is gone, has verified = false; an id that it holds several times
    is verified where one of its leaves and paths leads to root, so each row of docs stays one row."""
    now, row, own = docs.select(quoted(id_col).alias("now_id"), leaf(*[quoted(c) for c in columns]).alias("claimed")), "now_id", F.col("doc_id")
    both = now.join(made, own.eqNullSafe(F.col(row)), "full_outer")
    return both.select(
        F.coalesce(own, F.col(row)).alias("doc_id"), "leaf", "claimed", "subroot", "root",
        folded(F.col("claimed"), F.col("path")).alias("folded_root"),
    ).withColumn("verified", F.coalesce(F.col("folded_root") == F.col("root"), F.lit(False)))


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    tampered = F.crc32(F.col("doc_id").cast("string")) % 7 == 0
    # The rows as they come back: some with another n_chars.
    claimed = leaf(F.col("doc_id"), F.col("source"), F.col("lang"), F.when(tampered, F.col("n_chars") + 1).otherwise(F.col("n_chars")), F.col("text"))
    made = manifest(docs, also=(claimed.alias("claimed"),))
    out = made.select("doc_id", "leaf", "subroot", "root", proof(F.col("path")).alias("proof_sha256"), folded(F.col("claimed"), F.col("path")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


ORACLE = r"""
WITH RECURSIVE marked AS (
  SELECT *, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda ch: ascii(ch)::BIGINT)),
    lambda c, b: list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))) AS inverse
  FROM documents
), leaves AS (
  SELECT doc_id, lang, sha256(head || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') || tail) AS leaf,
    sha256(head || coalesce(strlen(new_chars::VARCHAR) || ':' || new_chars, '-') || tail) AS claimed,
    row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS pos
  FROM (
    SELECT doc_id, lang, n_chars, CASE WHEN xor(inverse, 4294967295) % 7 = 0 THEN n_chars + 1 ELSE n_chars END AS new_chars,
      coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') AS head,
      coalesce(strlen(text) || ':' || text, '-') AS tail
    FROM marked
  )
), levels AS (
  SELECT lang, 0 AS level, list(leaf ORDER BY pos) AS nodes FROM leaves GROUP BY lang
  UNION ALL
  SELECT lang, level + 1, list_transform(range(1, len(nodes) + 1, 2), lambda i: sha256(nodes[i] || coalesce(nodes[i + 1], ''))) FROM levels WHERE len(nodes) > 1
), subroots AS (
  SELECT lang, nodes[1] AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS place FROM levels WHERE len(nodes) = 1
), tops AS (
  SELECT 0 AS level, list(subroot ORDER BY place) AS nodes FROM subroots
  UNION ALL
  SELECT level + 1, list_transform(range(1, len(nodes) + 1, 2), lambda i: sha256(nodes[i] || coalesce(nodes[i + 1], ''))) FROM tops WHERE len(nodes) > 1
), steps AS (
  SELECT l.doc_id, v.level, (l.pos >> v.level) AS spot, v.nodes FROM leaves l JOIN levels v ON l.lang IS NOT DISTINCT FROM v.lang WHERE len(v.nodes) > 1
  UNION ALL
  SELECT l.doc_id, 100 + t.level, (s.place >> t.level), t.nodes FROM leaves l JOIN subroots s ON l.lang IS NOT DISTINCT FROM s.lang CROSS JOIN tops t WHERE len(t.nodes) > 1
), siblings AS (
  SELECT doc_id, level, CASE WHEN spot % 2 = 1 THEN nodes[spot] ELSE '' END AS l, CASE WHEN spot % 2 = 0 THEN coalesce(nodes[spot + 2], '') ELSE '' END AS r FROM steps
), paths AS (
  SELECT doc_id, string_agg(l || r, '' ORDER BY level) AS proof, list([l, r] ORDER BY level) AS path FROM siblings GROUP BY doc_id
), folds AS (
  SELECT l.doc_id, 0 AS done, l.claimed AS digest, coalesce(p.path, []) AS path FROM leaves l LEFT JOIN paths p USING (doc_id)
  UNION ALL
  SELECT doc_id, done + 1, sha256(path[done + 1][1] || digest || path[done + 1][2]), path FROM folds WHERE done < len(path)
)
SELECT l.doc_id, l.leaf, s.subroot, t.nodes[1] AS root, sha256(coalesce(p.proof, '')) AS proof_sha256, f.digest AS folded_root, f.digest = t.nodes[1] AS verified
FROM leaves l JOIN subroots s ON l.lang IS NOT DISTINCT FROM s.lang JOIN tops t ON len(t.nodes) = 1
LEFT JOIN paths p USING (doc_id) JOIN folds f ON f.doc_id = l.doc_id AND f.done = len(f.path)
"""
