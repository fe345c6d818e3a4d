"""Edit-aware token counts: a tree of pre-token runs for each document.

Leaves are runs of whole pre-tokens, cut where no edit elsewhere can undo the cut
(see bpe.CUT); inner nodes hold the characters and tokens below. An edit re-encodes
the leaves it touches, with a neighbour where it touches the cut itself, and
corrects the sums on the way up; nothing else is encoded again. Trees are kept as
two lists beside each text, the characters and tokens of its leaves, with a digest of the text they are of: count_trees() makes them, later
runs of edited_counts() take them up and return the new ones.
"""

from __future__ import annotations

import hashlib
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from .bpe import CUT, Codec, codec, default_vocabulary
from .common import arrow_map, free, named, quoted, table

RUN = 512


def digest(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def _fits(kept: tuple | None, text: str) -> bool:
    """Whether leaves are those of this very text: lists of one length, without holes, and the text's digest."""
    if kept is None or len(kept) != 3 or any(x is None for x in kept):
        return False
    chars, tokens, of = kept
    return of == digest(text) and len(chars) == len(tokens) and None not in chars and None not in tokens and sum(chars) == len(text)


class CountTree:
    """Token counts of one document under edits."""

    def __init__(self, text: str, bpe: Codec, run: int = RUN, kept: tuple | None = None):
        """kept: what leaves() gave for this text; then nothing is encoded. Of another text, or damaged, it is left aside."""
        self._bpe, self._run = bpe, run
        self.encoded = 0  # characters encoded so far
        if not _fits(kept, text):
            self._build(self._cut(text))
        else:
            ends = list(accumulate(kept[0]))
            self._build([text[b - n : b] for b, n in zip(ends, kept[0], strict=True)], list(kept[1]))

    def leaves(self) -> tuple[list[int], list[int], int]:
        """Characters and tokens of the leaves that hold text, and the text's digest."""
        held = [i for i in range(self._n, 2 * self._n) if self._chars[i]]
        return [self._chars[i] for i in held], [self._tokens[i] for i in held], digest(self.text)

    def _cut(self, text: str) -> list[str]:
        parts, start = [], 0
        while start < len(text):
            cut = CUT.search(text, start + self._run - 1)
            end = cut.end() if cut else len(text)
            parts.append(text[start:end])
            start = end
        return parts

    def _count(self, text: str) -> int:
        self.encoded += len(text)
        return len(self._bpe.plain(text)) if text else 0

    def _build(self, leaves: list[str], counts: list[int] | None = None) -> None:
        counts = [self._count(x) for x in leaves] if counts is None else counts
        self._n = n = 1 << max(0, (len(leaves) - 1).bit_length())
        self._leaves = leaves + [""] * (n - len(leaves))
        self._chars, self._tokens = [0] * (2 * n), [0] * (2 * n)
        for i, (x, k) in enumerate(zip(leaves, counts, strict=True), n):
            self._chars[i], self._tokens[i] = len(x), k
        for i in range(n - 1, 0, -1):
            self._sum(i)

    def _sum(self, i: int) -> None:
        self._chars[i] = self._chars[2 * i] + self._chars[2 * i + 1]
        self._tokens[i] = self._tokens[2 * i] + self._tokens[2 * i + 1]

    def _set(self, leaf: int, text: str, count: int) -> None:
        self._leaves[leaf] = text
        i = leaf + self._n
        self._chars[i], self._tokens[i] = len(text), count
        while i > 1:
            i //= 2
            self._sum(i)

    def _find(self, pos: int) -> tuple[int, int]:
        """The leaf that holds character pos, and the place in it; the last one with text for the end."""
        i = 1
        while i < self._n:
            i *= 2
            if pos >= self._chars[i] and (self._chars[i + 1] or pos > self._chars[i]):
                pos -= self._chars[i]
                i += 1
        return i - self._n, pos

    def _near(self, leaf: int, step: int) -> int | None:
        leaf += step
        while 0 <= leaf < self._n:
            if self._leaves[leaf]:
                return leaf
            leaf += step
        return None

    def edit(self, pos: int, drop: int, insert: str) -> None:
        """Replace `drop` characters from pos by `insert`; both are held within the text."""
        size = self._chars[1]
        pos = min(max(pos, 0), size)
        drop = min(max(drop, 0), size - pos)
        if not drop and not insert:
            return
        first, at = self._find(pos)
        last, to = self._find(pos + drop)
        # A cut stands or falls with the characters beside it.
        if at <= 1 and (before := self._near(first, -1)) is not None:
            at += len(self._leaves[before])
            first = before
        if to >= len(self._leaves[last]) - 1 and (after := self._near(last, 1)) is not None:
            last = after
        text = "".join(self._leaves[first : last + 1])
        text = text[:at] + insert + text[at + drop :]
        if len(text) > 16 * self._run + (last - first) * self._run:
            leaves, counts = self._leaves[:first], self._tokens[self._n : self._n + first]
            new = self._cut(text)
            leaves += new + self._leaves[last + 1 :]
            counts += [self._count(x) for x in new] + self._tokens[self._n + last + 1 : 2 * self._n]
            kept = [(x, k) for x, k in zip(leaves, counts, strict=True) if x]
            self._build([x for x, _ in kept], [k for _, k in kept])
            return
        for leaf in range(first + 1, last + 1):
            if self._leaves[leaf]:
                self._set(leaf, "", 0)
        self._set(first, text, self._count(text))

    @property
    def tokens(self) -> int:
        return self._tokens[1]

    @property
    def text(self) -> str:
        return "".join(self._leaves)


def with_edits(docs: DataFrame, edits: DataFrame, id_col: str = "doc_id", to: str = "edits") -> DataFrame:
    """docs and their edits (id, seq, pos, drop, ins) in one column `to`, in the order of seq; a column of that name is an error."""
    if to.lower() in map(str.lower, docs.columns):
        raise ValueError(f"docs have a column {to} of their own: choose another name for the edits")
    (own_id,) = free(docs, "own_id")
    lists = edits.groupBy(quoted(id_col).alias(own_id)).agg(F.sort_array(F.collect_list(F.struct("seq", "pos", "drop", "ins"))).alias(to))
    rows = docs.join(lists, quoted(id_col) == F.col(own_id), "left").drop(own_id)
    return rows.withColumn(to, F.transform(quoted(to), lambda e: F.struct(e["pos"].alias("pos"), e["drop"].alias("drop"), e["ins"].alias("ins"))))


_LEAVES = ("leaf_chars", "leaf_tokens", "leaf_digest")
_TYPES = (ArrayType(IntegerType()), ArrayType(IntegerType()), LongType())


def _leaf_columns(trees: list) -> list[pa.Array]:
    return [pa.array(x, t) for x, t in zip(zip(*(t.leaves() for t in trees), strict=True), (pa.list_(pa.int32()), pa.list_(pa.int32()), pa.int64()), strict=True)]


def count_trees(docs: DataFrame, vocabulary: str | None = None, text_col: str = "text") -> DataFrame:
    """docs with the trees of their texts: leaf_chars and leaf_tokens, arrays of int, and leaf_digest, a long; columns of these names are replaced. Null text has no leaf. An empty table gives an empty one."""
    vocabulary = vocabulary or default_vocabulary()
    kept = docs.select(*named(docs, *_LEAVES))

    def make():
        bpe = codec(vocabulary)

        def f(batch):
            trees = [CountTree(x or "", bpe) for x in batch.column(text_col).to_pylist()]
            return pa.RecordBatch.from_arrays([*batch.columns, *_leaf_columns(trees)], [*batch.schema.names, *_LEAVES])

        return f

    schema = StructType([*kept.schema, *(StructField(c, t) for c, t in zip(_LEAVES, _TYPES, strict=True))])
    return arrow_map(kept, make, schema, text_col)


def edited_counts(trees: DataFrame, vocabulary: str | None = None, id_col: str = "doc_id", text_col: str = "text", edits_col: str = "edits", with_text: bool = False) -> DataFrame:
    """Token counts before and after the edits of each row's column `edits_col` (array of pos, drop, ins).

    Returns id, n_edits, n_tokens, n_tokens_after, n_chars_after, n_encoded (characters
    encoded for the edits) and, if asked for, text and leaves as they are after the edits: trees for the next ones. Rows whose leaves aren't those of their text get
    a new tree first: where there are none, where the text has changed since (to one of the same length, too), and where they are damaged. Edits apply in
    order, each to the text as it then is; positions and lengths in code points are
    held within it, null ones count as 0 and null insertions as empty. Null text is
    empty; null edits are none. Rows that repeat stay. An empty table gives an empty one. Only
    the named columns and leaves are read."""
    vocabulary = vocabulary or default_vocabulary()
    leaves = [quoted(c) if c in trees.columns else F.lit(None).cast(t).alias(c) for c, t in zip(_LEAVES, _TYPES, strict=True)]
    kept = trees.select(quoted(id_col).alias("doc_id"), quoted(text_col).alias("text"), quoted(edits_col).alias("edits"), *leaves)
    names = ["n_edits", "n_tokens", "n_tokens_after", "n_chars_after", "n_encoded"]

    def make():
        bpe = codec(vocabulary)

        def f(batch):
            rows, after = [], []
            for text, edits, *leaves in zip(*(batch.column(c).to_pylist() for c in ("text", "edits", *_LEAVES)), strict=True):
                tree = CountTree(text or "", bpe, kept=tuple(leaves))
                before, done = tree.tokens, tree.encoded
                for e in edits or ():
                    if e:
                        tree.edit(e["pos"] or 0, e["drop"] or 0, e["ins"] or "")
                rows.append((len(edits or ()), before, tree.tokens, tree._chars[1], tree.encoded - done))
                after.append(tree)
            columns = [pa.array(x, pa.int64()) for x in zip(*rows, strict=True)]
            if with_text:
                columns += [pa.array([t.text for t in after], pa.string()), *_leaf_columns(after)]
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], ["doc_id", *names, *("text", *_LEAVES) * with_text])

        return f

    schema = f"doc_id {kept.schema['doc_id'].dataType.simpleString()}, " + ", ".join(f"{x} long" for x in names) + ", text string, leaf_chars array<int>, leaf_tokens array<int>, leaf_digest long" * with_text
    return arrow_map(kept, make, schema, "text")


def sample_edits(docs: DataFrame, every: int = 2000) -> DataFrame:
    """docs with an edit for each begun `every` characters: the passage there gives way to words from the text's other end."""
    n = F.char_length(F.coalesce(F.col("text"), F.lit("")))
    edit = lambda i: F.struct(
        (i * every + (F.crc32(F.col("doc_id").cast("string")) + i * 131) % every).cast("long").alias("pos"),
        ((i * 7 + 3) % 23).cast("long").alias("drop"),
        F.substring("text", (n - i * F.lit(every // 2) - F.lit(40)).cast("int"), ((i + 5) % 29).cast("int")).alias("ins"),
    )
    return docs.withColumn("edits", F.transform(F.sequence(F.lit(0), F.floor(n / every).cast("int")), edit))


def query(spark, sf_dir: str) -> DataFrame:
    return edited_counts(count_trees(sample_edits(table(spark, sf_dir, "documents").select("doc_id", "text"))))
