"""Toxicity: Levenshtein automata over a lexicon trie, and windows of context.

The lexicon is learned: words that labelled toxic documents hold far more often than
others. Its trie and the Levenshtein automata of its words are intersected into one
deterministic automaton, which runs over all words of an Arrow batch at once, letter by
letter. Matches count by whether they are exact and whether their window reads like a
quotation; a logistic curve over their logarithms gives the score.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import ship_package
from .common import arrow_map, ascii_lower, cut, fold_column, quoted, slices, table

#: Digits and signs often written for letters, and the letters.
DISGUISES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"}
#: Marks that open or close a quotation, and words that report speech.
QUOTES = "\"“”„«»‹›‘`"
REPORTS = ("quote", "quoted", "quotes", "said", "says", "wrote", "writes", "called", "term", "word", "zitat", "sagte", "dit", "citation", "dijo", "cita")
WINDOW = 4


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """For each code point below 2^16: the letter it stands for inside a word (0: none), and whether it begins or ends words."""
    out = np.zeros(1 << 16, dtype=np.uint16)
    for i in range(1 << 16):
        c = chr(i)
        if c.isalpha():
            low = c.lower()
            out[i] = ord(low) if len(low) == 1 else i
    plain = out != 0
    for sign, letter in DISGUISES.items():
        out[ord(sign)] = ord(letter)
    return out, plain


_both: tuple | None = None


@dataclass
class Words:
    """All words of some texts: letters in one array, and for each word where it starts, its length, its text, and whether quotes stand around it."""

    letters: np.ndarray
    start: np.ndarray
    size: np.ndarray
    text: np.ndarray
    quoted: np.ndarray


def words_of(texts: list[str | None]) -> Words:
    """Words are runs of letters and of the signs that stand for letters, with one letter as such at least; exclamation
    marks at a word's end are none of it."""
    global _both
    if _both is None:
        _both = _tables()
    to, plain = _both
    raw = [np.frombuffer(("\n" + (x or "") + "\n").encode("utf-32-le", "surrogatepass"), dtype=np.uint32) for x in texts]
    ends = np.cumsum([len(x) for x in raw])
    points = np.minimum(np.concatenate(raw), 0xFFFF) if raw else np.zeros(0, dtype=np.uint32)
    letters = to[points]
    edge = np.diff((letters != 0).astype(np.int8), prepend=np.int8(0), append=np.int8(0))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    n_plain = np.concatenate(([0], np.cumsum(plain[points])))
    some = n_plain[end] > n_plain[start]
    start, end = start[some], end[some]
    while True:
        marks = (end > start) & (points[end - 1] == 0x21)
        if not marks.any():
            break
        end[marks] -= 1
    text = np.searchsorted(ends, start, "right")
    quote = np.isin(points, [ord(x) for x in QUOTES])
    line = points == 10
    # A quotation mark before, on the same line, that none has closed: an odd number since the line began.
    upto = np.cumsum(quote)
    began = np.maximum.accumulate(np.where(line, np.arange(len(points)), 0)) if len(points) else points
    open_ = (upto[start] - upto[began[start]]) % 2 == 1 if len(start) else np.zeros(0, dtype=bool)
    return Words(letters, start, end - start, text, open_)


class Automaton:
    """All strings within one edit of a word of the lexicon, as one table: state x letter -> state. Words in `exact`, and those
    shorter than `short`, match as they are alone."""

    def __init__(self, lexicon: list[str], exact: frozenset[str] = frozenset(), short: int = 5):
        self.lexicon = lexicon
        letters = sorted({c for w in lexicon for c in w})
        self.letters = np.zeros(1 << 16, dtype=np.int32)  # 0: any other letter
        for i, c in enumerate(letters, 1):
            self.letters[ord(c)] = i
        # Trie of the lexicon, node 0 its root.
        child: list[dict[str, int]] = [{}]
        final: dict[int, int] = {}
        for k, w in enumerate(lexicon):
            node = 0
            for c in w:
                if c not in child[node]:
                    child[node][c] = len(child)
                    child.append({})
                node = child[node][c]
            final[node] = k
        allowed = [int(len(w) >= short and w not in exact) for w in lexicon]
        reach = [0] * len(child)  # most edits that a word below a node allows
        for node in range(len(child) - 1, -1, -1):
            reach[node] = max([reach[x] for x in child[node].values()] + ([allowed[final[node]]] if node in final else [0]))

        def close(states):
            """Add skipped letters of the lexicon: (node, edits) with the fewest edits for each node."""
            best: dict[int, int] = {}
            todo = list(states)
            while todo:
                node, e = todo.pop()
                if e > reach[node] or best.get(node, 9) <= e:
                    continue
                best[node] = e
                todo += [(x, e + 1) for x in child[node].values()]
            return frozenset(best.items())

        start = close([(0, 0)])
        index, order, rows = {start: 1}, [start], []
        for state in order:
            row = []
            for c in ["", *letters]:
                new = []
                for node, e in state:
                    new.append((node, e + 1))  # one letter too many
                    for x, to in child[node].items():
                        new.append((to, e + (x != c)))
                new = close(new)
                if new and new not in index:
                    index[new] = len(index) + 1
                    order.append(new)
                row.append(index[new] if new else 0)
            rows.append(row)
        self.table = np.array([[0] * (len(letters) + 1), *rows], dtype=np.int32)
        self.word = np.full(len(order) + 1, -1, dtype=np.int32)
        self.edits = np.zeros(len(order) + 1, dtype=np.int32)
        for i, state in enumerate(order, 1):
            ok = sorted((e, final[n]) for n, e in state if n in final and e <= allowed[final[n]])
            if ok:
                self.edits[i], self.word[i] = ok[0]
        self.longest = max(map(len, lexicon), default=0) + 1

    def run(self, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Which words match: their places, the lexicon's words, and the edits."""
        at = np.flatnonzero(words.size <= self.longest)
        state = np.ones(len(at), dtype=np.int32)
        for k in range(self.longest):
            live = words.size[at] > k
            live &= state > 0
            spots = np.flatnonzero(live)
            if not len(spots):
                break
            letter = self.letters[words.letters[words.start[at[spots]] + k]]
            state[spots] = self.table[state[spots], letter]
            # A dead state stays dead; a word that has ended keeps its state.
            gone = state == 0
            if gone.any():
                at, state = at[~gone], state[~gone]
        hit = self.word[state] >= 0
        return at[hit], self.word[state[hit]], self.edits[state[hit]]


@dataclass
class Model:
    automaton: Automaton | None
    weights: np.ndarray  # of exact and misspelled terms outside and inside quotations, and a constant
    prior: float


def _features(model_automaton: Automaton | None, texts: list[str | None]) -> np.ndarray:
    """Of each text: exact and misspelled terms in plain speech, and in quotations."""
    out = np.zeros((len(texts), 4), dtype=np.int64)
    if model_automaton is None or not texts:
        return out
    words = words_of(texts)
    at, _, edits = model_automaton.run(words)
    for i, e in zip(at.tolist(), edits.tolist(), strict=True):
        t = words.text[i]
        low = i
        quoted = bool(words.quoted[i])
        if not quoted:
            while low > 0 and i - low < WINDOW and words.text[low - 1] == t:
                low -= 1
            near = (words.letters[words.start[j] : words.start[j] + words.size[j]] for j in range(low, i))
            quoted = any("".join(map(chr, x)) in REPORTS for x in near if len(x) <= 9)
        out[t, (2 if quoted else 0) + (1 if e else 0)] += 1
    return out


def _evidence(counts) -> np.ndarray:
    """What so many terms weigh: the second says less than the first, and none says nothing."""
    return np.log2(1.0 + np.asarray(counts, dtype=np.float64))


def learn_lexicon(labelled: DataFrame, least_docs: int = 5, times: float = 20.0) -> list[str]:
    """The words that toxic texts hold `times` as often as others, and at least least_docs of them, of any length and
    number; the highest log-odds come first.

    labelled: text, toxic. Each distinct word of each text counts once. Of texts that are the same but for A-Z and white
    space one counts: else the words of one text copied often would look like a habit."""
    ship_package(labelled.sparkSession)

    def run(batches):
        for b in batches:
            for s in slices(b, "text"):
                texts = s.column("text").to_pylist()
                toxic = s.column("toxic").to_pylist()
                words = words_of(texts)
                held: list[set] = [set() for _ in texts]
                for i in range(len(words.size)):
                    a = words.start[i]
                    held[words.text[i]].add(words.letters[a : a + words.size[i]].tobytes())
                counts: dict[bytes, list[int]] = {}
                for own, y in zip(held, toxic, strict=True):
                    for w in own:
                        counts.setdefault(w, [0, 0])[int(bool(y))] += 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array([w.decode("utf-16-le", "replace") for w in counts]), pa.array([x[1] for x in counts.values()], pa.int64()), pa.array([x[0] for x in counts.values()], pa.int64())], ["word", "toxic", "other"]
                )

    plain = ascii_lower(F.btrim(F.regexp_replace("text", r"[\x20\x09-\x0D]+", " ")))
    once = labelled.where("text IS NOT NULL AND toxic IS NOT NULL").groupBy(F.sha2(plain, 256).alias("copies"), "toxic").agg(F.min("text").alias("text"))
    counted = once.select("text", "toxic").mapInArrow(run, "word string, toxic long, other long").groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))
    sums = once.agg(F.count_if(F.col("toxic") > 0).alias("t"), F.count_if(F.col("toxic") == 0).alias("o")).first()
    t, o = sums["t"], sums["o"]
    if not t or not o:
        return []
    odds = F.log((F.col("toxic") + 0.5) / (t + 1.0)) - F.log((F.col("other") + 1.0) / (o + 1.0))
    found = counted.where((F.col("toxic") >= least_docs) & (odds >= float(np.log(times)))).orderBy(odds.desc(), "word").collect()
    return [r["word"] for r in found]


def _fit(rows: list, rounds: int = 50, ridge: float = 1.0) -> np.ndarray:
    """Logistic weights of counted feature rows (x..., toxic, n), by Newton's method, pulled to a prior.

    Exact terms are fitted first; where little was seen of the other ways, they stay near them: misspelled at
    four fifths, quoted at two fifths."""
    x = np.concatenate((_evidence([r[:4] for r in rows]), np.ones((len(rows), 1))), axis=1)
    y, n = (np.array([r[k] for r in rows], dtype=np.float64) for k in (4, 5))
    w = prior = np.array([2.0, 1.6, 0.8, 0.6, 0.0])
    for pull in (np.array([ridge, 1e6, 1e6, 1e6, 1e-3]), np.array([ridge] * 4 + [1e-3])):
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            g = x.T @ (n * (y - p)) - pull * (w - prior)
            h = (x * (n * p * (1 - p))[:, None]).T @ x + np.diag(pull)
            move = np.clip(np.linalg.solve(h, g), -2, 2)
            w = w + move
            if np.abs(move).max() < 1e-9:
                break
        prior = np.array([w[0], 0.8 * w[0], 0.4 * w[0], 0.3 * w[0], w[4]])
    return np.concatenate((np.maximum(w[:4], 0), w[4:]))


def _too_common(automaton: Automaton, labelled: DataFrame, share: float = 0.001) -> frozenset[str]:
    """Words of the lexicon whose neighbours by one edit stand in more than `share` of the texts that aren't toxic: they aren't misspelled there."""
    shared = labelled.sparkSession.sparkContext.broadcast(automaton)

    def make():
        def f(batch):
            words = words_of(batch.column("text").to_pylist())
            at, word, edits = shared.value.run(words)
            found = np.unique(np.stack([word[edits > 0], words.text[at[edits > 0]]]), axis=1)[0] if (edits > 0).any() else np.zeros(0, dtype=np.int64)
            return pa.RecordBatch.from_arrays([pa.array(found.astype(np.int64))], ["word"])

        return f

    clean = labelled.where("toxic = 0").select("text")
    n = clean.count()
    rows = arrow_map(clean, make, "word long", "text").groupBy("word").agg(F.count("*").alias("n")).collect()
    shared.destroy()
    return frozenset(automaton.lexicon[r["word"]] for r in rows if r["n"] > max(1, share * n))


def train(labelled: DataFrame) -> Model:
    """Fit on labelled rows (text, toxic): the lexicon, which of its words may be misspelled, then the weights over counted features
    (a few thousand combinations at most reach the driver)."""
    labelled = labelled.where("toxic IS NOT NULL").select(F.coalesce("text", F.lit("")).alias("text"), (F.col("toxic") > 0).cast("int").alias("toxic"))
    lexicon = learn_lexicon(labelled)
    automaton = Automaton(lexicon) if lexicon else None
    if automaton:
        automaton = Automaton(lexicon, _too_common(automaton, labelled))
    shared = labelled.sparkSession.sparkContext.broadcast(automaton)

    def make():
        def f(batch):
            x = _features(shared.value, batch.column("text").to_pylist())
            return pa.RecordBatch.from_arrays([*(pa.array(x[:, k]) for k in range(4)), batch.column("toxic")], ["a", "b", "c", "d", "toxic"])

        return f

    rows = arrow_map(labelled, make, "a long, b long, c long, d long, toxic int", "text").groupBy("a", "b", "c", "d", "toxic").agg(F.count("*").alias("n")).collect()
    shared.destroy()
    n = sum(r["n"] for r in rows)
    prior = sum(r["n"] for r in rows if r["toxic"]) / n if n else 0.0
    weights = _fit([tuple(r) for r in rows]) if automaton and n else np.array([0, 0, 0, 0, np.log((prior + 1e-4) / (1 - prior + 1e-4))])
    return Model(automaton, weights, prior)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score and predicted (score >= 0.5), and the counts behind them, for each row of docs.

    Null and empty texts have no terms, and the score of that. Repeated rows stay; an empty table gives an
    empty one. Only the named columns are read."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = docs.select(quoted(id_col).alias("doc_id"), quoted(text_col).alias("text"))
    names = ["exact", "misspelled", "exact_quoted", "misspelled_quoted"]

    def make():
        m = shared.value

        def f(batch):
            x = _features(m.automaton, batch.column("text").to_pylist())
            p = 1 / (1 + np.exp(-np.clip(_evidence(x) @ m.weights[:4] + m.weights[4], -30, 30)))
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(p), pa.array((p >= 0.5).astype(np.int32)), *(pa.array(x[:, k]) for k in range(4))], ["doc_id", "score", "predicted", *names])

        return f

    kind = kept.schema["doc_id"].dataType.simpleString()
    return arrow_map(kept, make, f"doc_id {kind}, score double, predicted int, " + ", ".join(f"{x} long" for x in names), "text")


def clean_rows(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, that the model doesn't hold toxic. Null texts stay."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        m = shared.value

        def f(batch):
            x = _features(m.automaton, batch.column(text_col).to_pylist())
            return batch.filter(pa.array(_evidence(x) @ m.weights[:4] + m.weights[4] < 0))

        return f

    return arrow_map(docs, make, docs.schema, text_col)


def labelled_rows(docs: DataFrame, labels: DataFrame, sample: int = 40_000) -> DataFrame:
    """text and toxic of labelled rows of docs that may be learned from: those outside fold 0 of crc32 of the id.

    `sample` bounds what the classifier is fitted on: of more labels, those whose hash falls into one
    class of as many as are needed. So the ids can be broadcast, and no text is shuffled."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (fold_column(F.col("doc_id")) != 0))
    step = max(1, -(-known.count() // sample))
    known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(step)) == 0).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    return cut(docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").select("text", "toxic"), "labelled")


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    model = train(labelled_rows(docs, labels))
    return score(docs, model).withColumn("held_out", fold_column(F.col("doc_id")) == 0)


def query(spark, sf_dir: str) -> DataFrame:
    out = toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "held_out", "score", "predicted", "exact", "misspelled", "exact_quoted", "misspelled_quoted")
