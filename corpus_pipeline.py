"""A training corpus from documents, in five stages of the training-data operators.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last keep the
columns of documents. Stages read what the one before has written. Null and empty
texts pass the first stages as they are, and leave at the mix, which takes
no words of them; repeated rows stay together; other columns pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from editfray.llm import bpe, line_dedup, mixing, ngram_join, toxicity
from editfray.llm.common import cut, free, named, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that operator 9, trained on those with labels, holds toxic go."""
    model = toxicity.train(toxicity.labelled_rows(docs, table(spark, sf_dir, "labels")))
    return toxicity.clean_rows(docs, model)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that three documents hold stay in one of them; n_chars follows the text."""
    out = line_dedup.line_dedup(docs, counts=tuple(free(docs, "n_lines", "n_dropped")))
    length = {"n_chars": F.char_length("text").cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {}
    return out.withColumns(length).select(*named(docs))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by five-word shingles, the document of the smallest id stays."""
    return ngram_join.one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: a row for each time."""
    return mixing.mixed_rows(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokens of each row: their number, and digests of the ids and of what they decode to."""
    return bpe.digests(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_lines),
    ("n-gram join", drop_copies),
    ("mixing", mix_sources),
    ("byte-level BPE", tokenize),
]

#: SQL has neither the learned automata nor the merges: the tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
