"""Language ID: interpolated Kneser-Ney character models, one a language, in sorted arrays.

A gram is up to four code points packed into 64 bits (16 each), so that suffixes and
histories are shifts and masks. Tasks count the highest grams of all training texts; Spark sums
them; lower orders are counts of distinct left neighbours, as Kneser-Ney has it. The
model is a set of Spark tables that grow with the texts, without a bound. Tasks hold the
losses of the most frequent grams, a row of all languages a gram; the grams of a text
that aren't among them are joined to the tables.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import ship_package
from .common import arrow_map, cut, drop_cut, fold_column, quoted, slices, table

ORDER = 4
SPACE = 32
#: Losses (grams times languages) that each task holds; a matter of speed, results don't depend on it.
CELLS = 4_000_000


def _letters() -> np.ndarray:
    """For each code point below 2^16: its lower case if it is a letter, else a blank."""
    out = np.full(1 << 16, SPACE, dtype=np.uint64)
    for i in range(1 << 16):
        c = chr(i)
        if c.isalpha():
            low = c.lower()
            out[i] = ord(low) if len(low) == 1 else i
    return out


_table: np.ndarray | None = None


def letter_codes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, lower-cased, every run of non-letters one blank, a blank around each text; and where each begins.

    Letters beyond 2^16 count as one unknown letter."""
    global _table
    if _table is None:
        _table = _letters()
    raw = [np.frombuffer(("\n" + (x or "") + "\n").encode("utf-32-le", "surrogatepass"), dtype=np.uint32) for x in texts]
    starts = np.concatenate(([0], np.cumsum([len(x) for x in raw])))
    points = np.concatenate(raw) if raw else np.zeros(0, dtype=np.uint32)
    codes = _table[np.minimum(points, 0xFFFF)]
    high = points > 0xFFFF
    if high.any():
        at = np.flatnonzero(high)
        codes[at] = [0xFFFD if chr(int(x)).isalpha() else SPACE for x in points[at]]
    blank = codes == SPACE
    keep = ~blank
    keep[1:] |= ~blank[:-1]
    keep[starts[:-1]] = True
    # A text's first blank stays, and so does one after each word; further blanks go.
    return codes[keep], np.concatenate(([0], np.cumsum(keep)))[starts]


def grams(codes: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The packed gram that ends at each code but each text's first, padded with blanks on the left; and where each text's begin."""
    n = len(codes)
    out = codes.copy()
    sizes = np.diff(starts)
    first = np.arange(n) - np.repeat(starts[:-1], sizes)
    for k in range(1, ORDER):
        back = np.full(n, SPACE, dtype=np.uint64)
        back[k:] = codes[:-k] if n > k else back[k:]
        back[first < k] = SPACE
        out |= back << np.uint64(16 * k)
    inside = first > 0
    return out[inside], starts - np.arange(len(starts))


def count_grams(docs: DataFrame) -> DataFrame:
    """lang, gram, n over the rows of docs (lang, text); each task sums what it has read, in bounded memory."""
    ship_package(docs.sparkSession)

    def run(batches):
        held: dict[str, list] = {}
        size = 0

        def merged(parts):
            keys, counts = (np.concatenate(x) for x in zip(*parts, strict=True))
            unique, at = np.unique(keys, return_inverse=True)
            return unique, np.bincount(at, weights=counts).astype(np.int64)

        def flush():
            for lang, parts in held.items():
                keys, counts = merged(parts)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(keys.view(np.int64)), pa.array(counts)], ["lang", "gram", "n"])
            held.clear()

        for b in batches:
            for s in slices(b, "text"):
                langs = np.array(s.column("lang").to_pylist(), dtype=object)
                texts = s.column("text").to_pylist()
                for lang in sorted(set(langs)):
                    own = [t for t, x in zip(texts, langs, strict=True) if x == lang]
                    keys, _ = grams(*letter_codes(own))
                    part = np.unique(keys, return_counts=True)
                    held.setdefault(lang, []).append(part)
                    size += len(part[0])
            if size > 4_000_000:
                for lang in held:
                    held[lang] = [merged(held[lang])]
                size = sum(len(x[0][0]) for x in held.values())
                if size > 2_000_000:
                    yield from flush()
                    size = 0
        yield from flush()

    counted = docs.where("lang IS NOT NULL AND text IS NOT NULL").select("lang", "text").mapInArrow(run, "lang string, gram long, n long")
    return counted.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


@dataclass
class Hot:
    """What each task holds of a model: the grams met most often, sorted, and a column a language, minus log2 of their probabilities."""

    grams: np.ndarray
    losses: np.ndarray

    def sums(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Of each text: the bits of its held grams by each language, how many grams it has, and whether it has a letter; and the
        grams that aren't held: text, gram and times."""
        codes, starts = letter_codes(texts)
        keys, begin = grams(codes, starts)
        letters = np.add.reduceat(np.concatenate((codes != SPACE, [False])), starts[:-1]) if len(texts) else np.zeros(0)
        sizes = np.diff(begin)
        sums = np.zeros((len(texts), self.losses.shape[1]))
        lost = (np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64))
        if len(keys):
            unique, at = np.unique(keys, return_inverse=True)
            place, hit = _places(self.grams, unique)
            some = sizes > 0
            for k in range(sums.shape[1]):  # one language at a time, so that memory doesn't grow with their number
                own = self.losses[place, k] if len(self.grams) else np.zeros(len(unique), dtype=np.float32)
                sums[some, k] = np.add.reduceat(np.where(hit, own, 0)[at], begin[:-1][some], dtype=np.float64)
            missed = np.flatnonzero(~hit[at])
            if len(missed):
                text = np.searchsorted(begin, missed, side="right") - 1
                pairs, times = np.unique(text * len(unique) + at[missed], return_counts=True)
                lost = (pairs // len(unique), unique[pairs % len(unique)], times)
        return sums, sizes, letters > 0, lost


def _places(known: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each key is in a sorted array, and whether it is."""
    if not len(known):
        return np.zeros(len(keys), dtype=np.int64), np.zeros(len(keys), dtype=bool)
    at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
    return at, known[at] == keys


def _packed(rows: np.ndarray) -> pa.Array:
    """Each row of numbers as bytes."""
    return pa.array([x.tobytes() for x in rows], pa.binary())


def _unpacked(column, kind, n: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=kind).reshape(len(column), n)


def _listed(column) -> tuple[np.ndarray, pa.Array]:
    """The row of each entry of a column of lists, and the entries."""
    sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    return np.repeat(np.arange(len(column)), sizes), column.flatten()


@dataclass
class Model:
    """langs; for each order from 1 two tables in Spark, without a bound on their rows: gram with its counts by language, and history
    with totals and kinds by language. hot: what tasks hold of them, for speed alone.

    floor: the probability of a letter never seen; level: bits a letter above which a text is held to be in none of the
    languages, a number a language."""

    langs: list[str]
    counts: list[DataFrame]
    histories: list[DataFrame]
    discount: float
    floor: float
    level: np.ndarray
    hot: Hot | None = None

    def probabilities(self, keys: DataFrame, order: int = ORDER) -> DataFrame:
        """gram and p, its probabilities by each language as packed doubles, for keys (distinct gram): a language that lacks a gram
        goes by its suffix, and by what its history leaves to it."""
        n, discount = len(self.langs), self.discount
        if not order:
            return keys.withColumn("p", F.lit(np.full(n, self.floor).tobytes()))
        rows = keys.withColumn("history", F.shiftrightunsigned("gram", 16)).withColumn("suffix", F.col("gram").bitwiseAND((1 << (16 * (order - 1))) - 1))
        rows = rows.join(self.counts[order - 1], "gram", "left").join(self.histories[order - 1], "history", "left")
        if order > 1:
            lower = self.probabilities(rows.select(F.col("suffix").alias("gram")).distinct(), order - 1)
            rows = rows.join(lower.withColumnRenamed("gram", "suffix"), "suffix")
        else:
            rows = rows.withColumn("p", F.lit(np.full(n, self.floor).tobytes()))

        def run(batches):
            step = max(1, 1_000_000 // n)
            for whole in batches:
                for i in range(0, whole.num_rows, step):
                    b = whole.slice(i, step)
                    lower = _unpacked(b.column("p"), np.float64, n)
                    weights, totals = np.ones(lower.shape), np.ones(lower.shape)
                    at, of = _listed(b.column("given"))
                    k, total, kinds = (of.field(x).to_numpy() for x in range(3))
                    weights[at, k], totals[at, k] = discount * kinds / total, total
                    p = weights * lower
                    at, of = _listed(b.column("own"))
                    k, c = (of.field(x).to_numpy() for x in range(2))
                    p[at, k] += np.maximum(c - discount, 0) / totals[at, k]
                    yield pa.RecordBatch.from_arrays([b.column("gram"), _packed(p)], ["gram", "p"])

        ship_package(keys.sparkSession)
        return rows.select("gram", "own", "given", "p").mapInArrow(run, "gram long, p binary")

    def look_up(self, keys: np.ndarray) -> np.ndarray:
        """Minus log2 of each key's probability by each language."""
        spark = self.counts[0].sparkSession
        unique, at = np.unique(keys, return_inverse=True)
        asked = spark.createDataFrame([(x,) for x in unique.view(np.int64).tolist()], "gram long")
        known, losses = _gathered(self.probabilities(asked), len(self.langs))
        return losses[_places(known, unique)[0]][at]


def _gathered(found: DataFrame, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted grams, and their losses, of a few rows of probabilities."""
    rows = found.toArrow().combine_chunks()
    keys = rows.column("gram").to_numpy().view(np.uint64)
    losses = np.concatenate([-np.log2(_unpacked(c, np.float64, n)).astype(np.float32) for c in rows.column("p").chunks] or [np.zeros((0, n), dtype=np.float32)])
    order = np.argsort(keys)
    return keys[order], losses[order]


def train(docs: DataFrame, discount: float = 0.75) -> Model | None:
    """Fit on all rows of docs (lang, text); None without any.

    Counts and sums are of all texts and all grams, and stay in Spark, as written tables."""
    counted = cut(count_grams(docs), "grams")
    langs = [r["lang"] for r in counted.select("lang").distinct().orderBy("lang").collect()]
    if not langs:
        return None
    places = docs.sparkSession.createDataFrame(list(enumerate(langs)), "k int, lang string")
    level = cut(counted.join(places, "lang").select("k", "gram", "n"), "grams")
    drop_cut(counted)
    counts, histories, top = [], [], level
    for order in range(ORDER, 0, -1):
        history = F.shiftrightunsigned("gram", 16).alias("history")
        sums = level.groupBy("k", history).agg(F.sum("n").alias("total"), F.count("*").alias("kinds"))
        counts.append(cut(level.groupBy("gram").agg(F.collect_list(F.struct("k", "n")).alias("own")), "counts"))
        histories.append(cut(sums.groupBy("history").agg(F.collect_list(F.struct("k", "total", "kinds")).alias("given")), "histories"))
        if order > 1:
            level = cut(level.groupBy("k", F.col("gram").bitwiseAND((1 << (16 * (order - 1))) - 1).alias("gram")).agg(F.count("*").alias("n")), "grams")
    counts, histories = counts[::-1], histories[::-1]
    model = Model(langs, counts, histories, discount, 1 / max(2, counts[0].count() + 1), np.full(len(langs), np.inf))
    # The most frequent grams that fit, by steps of their counts: held by tasks, so that few grams of a text must be joined.
    sums = top.groupBy("gram").agg(F.sum("n").alias("n")).withColumn("step", F.floor(F.log2("n") * 8))
    steps = sums.groupBy("step").agg(F.count("*").alias("grams")).toPandas().sort_values("step", ascending=False)
    fits = steps[steps["grams"].cumsum() <= max(1, CELLS // len(langs))]
    chosen = sums.where(F.col("step") >= int(fits["step"].min())) if len(fits) else sums.where("false")
    model.hot = Hot(*_gathered(model.probabilities(chosen.select("gram")), len(langs)))
    return model


def entropies(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang, size (grams), some (letters at all) and sums, bits by each language as packed doubles, for each row of docs (doc_id, lang, text).

    Grams that tasks don't hold are looked up in the model's tables by a join, each once, and added to their rows."""
    n = len(model.langs)
    shared = docs.sparkSession.sparkContext.broadcast(model.hot)

    def make():
        hot = shared.value

        def f(batch):
            sums, sizes, some, (text, gram, times) = hot.sums(batch.column("text").to_pylist())
            begin = np.searchsorted(text, np.arange(batch.num_rows + 1)).astype(np.int32)
            entries = pa.StructArray.from_arrays([pa.array(gram.view(np.int64)), pa.array(times.astype(np.int64))], ["gram", "n"])
            lost = pa.ListArray.from_arrays(pa.array(begin), entries)
            return pa.RecordBatch.from_arrays([batch.column("row"), batch.column("doc_id"), batch.column("lang"), pa.array(sizes.astype(np.int64)), pa.array(some), _packed(sums), lost], ["row", "doc_id", "lang", "size", "some", "sums", "lost"])

        return f

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "lang", "text")
    out = f"doc_id {kind}, lang string, size long, some boolean, sums binary"
    first = cut(arrow_map(rows, make, f"row long, {out}, lost array<struct<gram: long, n: long>>", "text"), "sums")
    lost = first.select("row", F.explode("lost").alias("x")).select("row", "x.gram", "x.n")
    if not lost.limit(1).count():
        return first.drop("row", "lost")
    known = cut(model.probabilities(cut(lost.select("gram").distinct(), "asked")), "found")

    def add(batches):
        held = None
        for b in batches:
            if not b.num_rows:
                continue
            row = b.column("row").to_numpy()
            bits = b.column("n").to_numpy()[:, None] * -np.log2(_unpacked(b.column("p"), np.float64, n))
            begin = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1])))
            keys, sums = row[begin], np.add.reduceat(bits, begin, axis=0)
            if held is not None:
                if held[0] == keys[0]:
                    sums[0] += held[1]
                else:
                    keys, sums = np.concatenate(([held[0]], keys)), np.concatenate((held[1][None], sums))
            held = (keys[-1], sums[-1])
            if len(keys) > 1:
                yield pa.RecordBatch.from_arrays([pa.array(keys[:-1]), _packed(sums[:-1])], ["row", "more"])
        if held is not None:
            yield pa.RecordBatch.from_arrays([pa.array([int(held[0])], pa.int64()), _packed(held[1][None])], ["row", "more"])

    more = lost.join(known, "gram").repartition("row").sortWithinPartitions("row").mapInArrow(add, "row long, more binary")

    def both():
        def f(b):
            sums = _unpacked(b.column("sums"), np.float64, n).copy()
            at = np.flatnonzero(b.column("more").is_valid().to_numpy(zero_copy_only=False))
            if len(at):
                sums[at] += _unpacked(b.column("more").drop_null(), np.float64, n)
            return pa.RecordBatch.from_arrays([*(b.column(x) for x in ("doc_id", "lang", "size", "some")), _packed(sums)], ["doc_id", "lang", "size", "some", "sums"])

        return f

    return cut(arrow_map(first.drop("lost").join(more, "row", "left").drop("row"), both, out), "sums")


def calibrate(model: Model, summed: DataFrame, spread: float = 4.0) -> None:
    """Set the model's levels: mean and `spread` deviations of the bits a letter of all rows of summed, by their own lang."""
    bits = decide(summed, model).where("lang IS NOT NULL").groupBy("lang").agg(F.avg("bits_own").alias("mean"), F.stddev_pop("bits_own").alias("deviation")).collect()
    for row in bits:
        if row["lang"] in model.langs and row["mean"] is not None:
            model.level[model.langs.index(row["lang"])] = row["mean"] + spread * (row["deviation"] or 0) + 0.25


def identify(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang (as given), lang_pred, score, bits, bits_own and rejected for each row of docs.

    lang_pred is the language of the lowest bits a letter (ties: the first by code point), `und` for a null
    text, one without a letter, and without a model. score, 0 to 1, is the share of the best language's likelihood over eight letters
    of average cost. bits_own are those of the row's own lang, null if unknown, for calibration alone. rejected: bits are over the language's level, as
    of text in none of the languages; und is rejected, too. Repeated rows stay; an empty table gives an empty one. lang may be missing."""
    given = F.col("lang") if "lang" in docs.columns else F.lit(None).cast("string")
    kept = docs.select(quoted(id_col).alias("doc_id"), quoted(text_col).alias("text"), given.alias("lang"))
    if model is None:
        none = F.lit(None).cast("double")
        return kept.select("doc_id", "lang", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"), none.alias("bits"), none.alias("bits_own"), F.lit(True).alias("rejected"))
    return decide(entropies(kept, model), model)


def decide(summed: DataFrame, model: Model) -> DataFrame:
    """The columns of identify() for each row of entropies()."""
    langs, level = model.langs, model.level.copy()

    def make():
        place = {x: i for i, x in enumerate(langs)}

        def f(batch):
            rows = batch.num_rows
            bits = _unpacked(batch.column("sums"), np.float64, len(langs)) / np.maximum(batch.column("size").to_numpy(), 1)[:, None]
            some = batch.column("some").to_numpy(zero_copy_only=False) & (batch.column("size").to_numpy() > 0)
            k = bits.argmin(axis=1)
            best = bits[np.arange(rows), k]
            share = np.exp2(-8 * (bits - best[:, None]))
            score = np.where(some, 1 / share.sum(axis=1), 0.0)
            out = ~some | (best > level[k])
            pred = [langs[i] if s else "und" for i, s in zip(k, some, strict=True)]
            own = [float(bits[i, place[x]]) if x in place and some[i] else None for i, x in enumerate(batch.column("lang").to_pylist())]
            columns = [batch.column("doc_id"), batch.column("lang"), pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(best, pa.float64()), pa.array(own, pa.float64()), pa.array(out, pa.bool_())]
            return pa.RecordBatch.from_arrays(columns, ["doc_id", "lang", "lang_pred", "score", "bits", "bits_own", "rejected"])

        return f

    kind = summed.schema["doc_id"].dataType.simpleString()
    return arrow_map(summed, make, f"doc_id {kind}, lang string, lang_pred string, score double, bits double, bits_own double, rejected boolean")


def language_id(docs: DataFrame) -> DataFrame:
    """Train on the rows outside fold 0 of crc32 of the id, and predict every row: see identify()."""
    held = fold_column(F.col("doc_id")) == 0
    model = train(docs.where(~held).select("lang", "text"))
    rows = docs.select("doc_id", "lang", "text")
    if model:
        summed = entropies(rows, model)
        calibrate(model, summed.where(~held))
        out = decide(summed, model)
    else:
        out = identify(rows, None)
    return out.select("doc_id", held.alias("held_out"), "lang_pred", "score", "rejected")


def query(spark, sf_dir: str) -> DataFrame:
    return language_id(table(spark, sf_dir, "documents"))
