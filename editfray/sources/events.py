"""The live feed: JSON events to edits, and edits to revert signals. The same projections serve batch and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import revert_detector, reverted_revision, reverted_user
from ..schema import EVENT_SCHEMA


def edits_of(raw: DataFrame, server: str, wiki: str, namespace: int = 0, payload: str = "payload") -> DataFrame:
    """Edits of raw (payload JSON, perhaps stream_id): those of the server, wiki and namespace, by people, of type edit or new, with page and title.

    Payloads that don't parse, and those without a revision, go. Times are epoch seconds or ISO text."""
    rows = raw.withColumn("e", F.from_json(payload, EVENT_SCHEMA)).select("e.*", *(["stream_id"] if "stream_id" in raw.columns else [F.col("e.meta.id").alias("stream_id")]))
    rows = rows.where(
        (F.col("server_name") == server) & (F.col("wiki") == wiki) & (F.col("namespace") == namespace) & ~F.coalesce("bot", F.lit(False)) & F.col("type").isin("edit", "new")
        & (F.coalesce("page_id", F.lit(0)) != 0) & (F.coalesce("title", F.lit("")) != "")
    )
    ts = F.coalesce(F.timestamp_seconds(F.col("timestamp").try_cast("double")), F.try_to_timestamp(F.col("timestamp")))
    rev = F.coalesce(F.when(F.col("revision.new") != 0, F.col("revision.new")), F.col("rev_id"))
    return rows.withColumn("new_rev", rev).where("new_rev IS NOT NULL AND new_rev <> 0").select(
        "wiki", "page_id", F.col("title").alias("page_title"), "namespace", F.col("new_rev").alias("rev_id"), F.coalesce(F.when(F.col("revision.old") != 0, F.col("revision.old")), F.col("old_revid")).alias("parent_rev_id"),
        ts.alias("ts"), "user_id", F.coalesce("user", F.lit("")).alias("user_text"), F.coalesce("bot", F.lit(False)).alias("user_is_bot"), F.col("user_id").isNull().alias("user_is_anonymous"),
        F.coalesce("comment", F.lit("")).alias("comment"), F.coalesce("tags", F.array().cast("array<string>")).alias("tags"), F.coalesce("minor", F.lit(False)).alias("minor"),
        F.col("length.old").alias("old_len"), F.col("length.new").alias("new_len"), "stream_id",
    )


def with_reverts(edits: DataFrame) -> DataFrame:
    """Edits with `reverts` (whether they do), the detector and its confidence, and whom and what they revert: row by row, so that streams need no join. Nobody reverts himself."""
    who = reverted_user(F.col("comment"))
    rows = edits.withColumn("d", revert_detector(F.col("tags"), F.col("comment"))).withColumns({
        "reverts": F.col("d").isNotNull(), "detector": F.col("d.detector"), "confidence": F.col("d.confidence"),
        "reverted_user": F.when(F.col("d").isNotNull() & (who != F.col("user_text")), who), "reverted_rev_id": F.when(F.col("d").isNotNull(), reverted_revision(F.col("comment"))),
    })
    return rows.drop("d")


def revert_signals(edits: DataFrame) -> DataFrame:
    """Edits that revert, with detector, confidence, whom and what they revert."""
    return with_reverts(edits).where("reverts").select("wiki", "page_id", "rev_id", "ts", F.col("user_text").alias("reverter_user"), "reverted_user", "reverted_rev_id", "detector", "confidence")
