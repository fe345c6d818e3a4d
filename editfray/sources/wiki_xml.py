"""XML dumps: pages with their revisions, and log items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import wiki_dump

_TEXT = "struct<_VALUE:string,`_xml:space`:string>"
PAGE_SCHEMA = (
    "title string, ns int, id long, revision array<struct<id:long,timestamp:string,contributor:struct<username:string,ip:string,id:long>,comment:string,"
    f"text:{_TEXT}>>"
)
LOG_SCHEMA = "id long, timestamp string, type string, action string, logtitle string, params string"


def pages(spark: SparkSession, path: str) -> DataFrame:
    """One row a page. gz and bz2 are read by their extension; the schema is given, so files aren't read twice."""
    return spark.read.format("xml").option("rowTag", "page").schema(PAGE_SCHEMA).load(path)


def pages_of(texts: DataFrame, column: str = "value") -> DataFrame:
    """One row a page of texts that hold the XML of a page each, as files that are cut by pages have them."""
    return texts.select(F.from_xml(column, PAGE_SCHEMA, {"rowTag": "page"}).alias("p")).select("p.*")


def revisions(pages_: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """A row a revision, with the columns of its page that `keep` names; without a contributor the user is empty, without text so is the content."""
    rows = pages_.select(F.col("id").alias("page_id"), F.coalesce("title", F.lit("")).alias("page_title"), F.coalesce("ns", F.lit(0)).alias("namespace"), *keep, F.explode("revision").alias("r"))
    return rows.select(
        *keep, "page_id", "page_title", "namespace", F.coalesce("r.id", F.lit(0)).alias("rev_id"), F.try_to_timestamp("r.timestamp").alias("ts"), F.coalesce("r.contributor.username", "r.contributor.ip", F.lit("")).alias("user_text"),
        F.coalesce("r.comment", F.lit("")).alias("comment"), F.array().cast("array<string>").alias("tags"), F.coalesce("r.text._VALUE", F.lit("")).alias("content"),
    )


def candidate_pages(headers: DataFrame, candidates: DataFrame) -> DataFrame:
    """Rows of headers (page_id, page_title, namespace and others) of candidates' articles and talk pages, with the candidate.

    candidates: candidate, page_id, page_title, talk_page_id. An article goes by title, else by id; a talk page by its title without "Talk:", else by id."""
    from ..functions.text import lookup_title

    title = lookup_title(F.when(F.col("namespace") == 1, F.regexp_replace("page_title", "^Talk:", "")).otherwise(F.col("page_title")))
    rows = headers.where(F.col("namespace").isin(0, 1)).withColumn("__title", title).withColumn("__talk", F.col("namespace") == 1)
    titles = candidates.select(lookup_title(F.col("page_title")).alias("__title"), F.col("candidate").alias("__c1")).dropDuplicates(["__title"])
    ids = candidates.select(F.lit(False).alias("__talk"), "page_id", "candidate").unionByName(candidates.where("talk_page_id > 0").select(F.lit(True).alias("__talk"), F.col("talk_page_id").alias("page_id"), "candidate"))
    ids = ids.select("__talk", "page_id", F.col("candidate").alias("__c2")).dropDuplicates(["__talk", "page_id"])
    met = rows.join(titles, "__title", "left").join(ids, ["__talk", "page_id"], "left").withColumn("candidate", F.coalesce("__c1", "__c2")).where("candidate IS NOT NULL")
    return met.select("candidate", *headers.columns)


def read_revisions(chosen: DataFrame, since: str = "", until: str = "") -> DataFrame:
    """Revisions of chosen pieces of dumps (wiki_dump.pieces()), with the columns of revisions() behind those of the pieces."""
    rows = wiki_dump.revisions(chosen, since, until).drop("file", "start", "end").withColumn("ts", F.try_to_timestamp("timestamp")).withColumn("tags", F.array().cast("array<string>"))
    return rows.drop("timestamp")


def candidate_revisions(pieces: DataFrame, candidates: DataFrame, since: str = "", until: str = "") -> DataFrame:
    """Revisions of the candidates' pages: only the bytes of these are read, and no other revision is taken apart."""
    return read_revisions(candidate_pages(pieces, candidates), since, until)


def in_period(revisions_: DataFrame, start, end) -> DataFrame:
    return revisions_.where((F.col("ts") >= start) & (F.col("ts") < end) & (F.col("content") != ""))


def protection_events(spark: SparkSession, path: str) -> DataFrame:
    """protection_of() the log items of files."""
    return protection_of(spark.read.format("xml").option("rowTag", "logitem").schema(LOG_SCHEMA).load(path))


def log_items_of(texts: DataFrame, column: str = "value") -> DataFrame:
    """Log items of texts that hold the XML of one each."""
    return texts.select(F.from_xml(column, LOG_SCHEMA, {"rowTag": "logitem"}).alias("i")).select("i.*")


def protection_of(items: DataFrame) -> DataFrame:
    """Log items on protection that have a time, title and action; titles are normalised, those with a colon left out."""
    from ..functions.text import history_title

    rows = items.where("type = 'protect'")
    rows = rows.select(history_title(F.col("logtitle")).alias("page_title"), F.try_to_timestamp("timestamp", F.lit("yyyy-MM-dd'T'HH:mm:ss'Z'")).alias("ts"), "action", "id")
    return rows.where("page_title <> '' AND NOT contains(page_title, ':') AND ts IS NOT NULL AND action <> ''")
