"""Text rules as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import patterns as P
from .entities import bound, unescape


def _or_empty(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def _found(c: Column, pattern: str) -> Column:
    return _or_empty(c).rlike(pattern)


def revert_detector(tags: Column, comment: Column) -> Column:
    """struct(detector, confidence), null where an edit is no revert: the surest tag, else the comment."""
    out = F.when(_found(comment, P.REVERT_LIVE), F.struct(F.lit("comment").alias("detector"), F.lit(0.65).alias("confidence")))
    for tag, confidence in reversed(P.REVERT_TAGS):
        out = F.when(F.array_contains(F.coalesce(tags, F.array().cast("array<string>")), tag), F.struct(F.lit(tag).alias("detector"), F.lit(confidence).alias("confidence"))).otherwise(out)
    return out


def reverted_revision(comment: Column) -> Column:
    return F.regexp_extract(_or_empty(comment), P.REVISION_NUMBER, 1).try_cast("bigint")


def reverted_user(comment: Column) -> Column:
    """The first pattern that matches tells; brackets and blanks around the name go."""
    return F.coalesce(*[F.when(_found(comment, p), F.btrim(F.btrim(F.regexp_extract(_or_empty(comment), p, 1)), F.lit("[] "))) for p in P.BY_USER])


def is_revert_like(tags: Column, comment: Column) -> Column:
    some = F.exists(F.coalesce(tags, F.array().cast("array<string>")), lambda t: F.lower(t).rlike("revert|rollback|undo"))
    return _found(comment, P.REVERT_SEGMENT) | F.coalesce(some, F.lit(False))


def talk_flags(comment: Column) -> dict[str, Column]:
    return {name: _found(comment, p).cast("int") for name, p in (("rfc", P.TALK_RFC), ("arb", P.TALK_ARBITRATION), ("restriction", P.TALK_RESTRICTION))}


def substantive_talk(comment: Column) -> Column:
    """A comment of three characters at least that doesn't open like a routine action."""
    said = F.lower(F.trim(_or_empty(comment)))
    return (F.char_length(said) >= 3) & ~said.rlike(P.ROUTINE_TALK)


def talk_sentences(text: Column) -> Column:
    """The sentences of a text that may be part of a debate: of 20 to 280 characters, and no list of archives."""
    split = F.split(_or_empty(text), r"(?<=[.!?])(?U)\s+")
    archives = lambda s: F.size(F.split(normal(s), "archive")) - 1
    return F.transform(F.filter(split, lambda s: F.char_length(s).between(20, 280) & ~F.startswith(normal(s), F.lit("archives talk")) & (archives(s) < 3)), F.btrim)


def history_title(title: Column) -> Column:
    return F.regexp_replace(F.replace(_or_empty(title), F.lit(" "), F.lit("_")), "^Talk:", "")


def lookup_title(title: Column) -> Column:
    return F.replace(F.btrim(_or_empty(title)), F.lit(" "), F.lit("_"))


def normal(c: Column) -> Column:
    return F.btrim(F.regexp_replace(F.lower(_or_empty(c)), r"(?U)\s+", " "))


def clean_comment(comment: Column) -> Column:
    """Decoded, without tags, section marks and links."""
    out = F.regexp_replace(unescape(_or_empty(comment)), P.TAG, " ")
    out = F.regexp_replace(out, r"/\*.*?\*/", " ")
    out = F.regexp_replace(out, r"\[\[[^\]]+\]\]", " ")
    return F.btrim(F.regexp_replace(out, r"(?U)\s+", " "), F.lit(" -:"))


def first_sentence(comment: Column) -> Column:
    def cut(cleaned: Column) -> Column:
        found = F.regexp_extract(cleaned, r"(.{12,240}?[.!?])(?:\s|$)", 1)
        return F.when(found != "", F.btrim(found)).otherwise(F.btrim(F.substring(cleaned, 1, 240)))

    return bound(clean_comment(comment), cut)


def is_cleanup(comment: Column) -> Column:
    return _found(comment, P.CLEANUP)


def is_generated(comment: Column) -> Column:
    return _found(F.regexp_replace(unescape(_or_empty(comment)), P.TAG, " "), P.GENERATED) | _found(clean_comment(comment), P.GENERATED)


def has_substance(comment: Column) -> Column:
    """Three words at least that are no numbers, stop words or the name of a routine action."""
    rest = F.btrim(F.regexp_replace(_or_empty(comment), P.GENERIC_ACTION, ""))
    words = F.transform(F.regexp_extract_all(rest, F.lit(f"({P.WORD})"), 1), F.lower)
    return F.size(F.filter(words, lambda w: ~w.rlike("^[0-9]+$") & ~w.isin(*P.STOPWORDS))) >= 3


def first_shot(comment: Column) -> Column:
    """The first sentence of a comment that says something; else empty."""
    generated = is_generated(comment)

    def said(cleaned: Column) -> Column:
        good = (cleaned != "") & ~is_cleanup(cleaned) & ~is_generated(cleaned) & has_substance(cleaned)
        return F.when(good, cleaned).otherwise(F.lit(""))

    return F.when(generated, F.lit("")).otherwise(bound(first_sentence(comment), said))


def clean_wikitext(text: Column) -> Column:
    """Plain text of wikitext, its entities decoded."""
    out = F.regexp_replace(unescape(_or_empty(text)), P.REF, " ")
    out = F.regexp_replace(out, P.TEMPLATE, " ")
    out = F.regexp_replace(out, P.WIKILINK, "$1")
    out = F.regexp_replace(out, P.SECTION, " $1. ")
    out = F.regexp_replace(out, P.TAG, " ")
    out = F.replace(F.replace(out, F.lit("'''"), F.lit("")), F.lit("''"), F.lit(""))
    out = F.regexp_replace(out, r"(?U)https?://\S+", " ")
    out = F.regexp_replace(out, r"[\[\]{}|=*#_:;]", " ")
    return F.btrim(F.regexp_replace(out, r"(?U)\s+", " "))


def period_year(period: Column) -> Column:
    """history:S:YYYY-MM as history-year:S:YYYY; null for any other."""
    p = r"^history:([^:]+):(\d{4})-\d{2}$"
    return F.when(period.rlike(p), F.concat(F.lit("history-year:"), F.regexp_extract(period, p, 1), F.lit(":"), F.regexp_extract(period, p, 2)))


def period_bounds(period: Column) -> Column:
    """struct(start, end), half open, in UTC: of a year period, else of the last YYYY-MM in it."""
    year = F.regexp_extract(period, r"^history-year:[^:]+:(\d{4})$", 1)
    months = F.regexp_extract_all(period, F.lit(r"(\d{4}-\d{2})"), 1)
    month = F.when(F.size(months) > 0, F.element_at(months, -1))
    start = F.when(year != "", F.make_date(year.try_cast("int"), F.lit(1), F.lit(1))).otherwise(F.expr("null").cast("date"))
    start = F.coalesce(start, F.try_to_timestamp(month, F.lit("yyyy-MM")).cast("date"))
    end = F.when(year != "", F.add_months(start, 12)).otherwise(F.add_months(start, 1))
    return F.when(start.isNotNull(), F.struct(start.cast("timestamp").alias("start"), end.cast("timestamp").alias("end")))


def snapshot_id(period: Column) -> Column:
    """The snapshot of a period as YYYYMM01."""
    return F.concat(F.replace(F.regexp_extract(period, r"^history(?:-year)?:(\d{4}-\d{2}):", 1), F.lit("-"), F.lit("")), F.lit("01"))


def repeats(text: Column) -> Column:
    """Whether 82 of 100 characters and more repeat a unit of up to 24 from the text's start."""

    def most(signs):
        n = F.size(signs)
        units = F.sequence(F.lit(1), F.least(F.lit(24), F.greatest(F.lit(1), F.floor(n / 2).cast("int"))))
        return F.array_max(F.transform(units, lambda u: F.size(F.filter(signs, lambda c, i: c == F.get(signs, (i % u).cast("int")))))) / n

    # The characters are taken apart once: as an element of an array they are a variable of the lambda.
    return (F.char_length(text) > 0) & (F.element_at(F.transform(F.array(F.split(text, "")), most), 1) >= 0.82)


def is_graffiti(text: Column) -> Column:
    """Forty letters and more that repeat one unit, as a whole or as a word, or eight words and more of which seven tenths are one."""
    letters = F.lower(F.regexp_replace(_or_empty(text), "[^A-Za-z0-9]+", ""))
    words = F.transform(F.regexp_extract_all(_or_empty(text), F.lit(f"({P.WORD})"), 1), F.lower)
    # Words in order: the most frequent is the longest run.
    start = F.struct(F.lit("").alias("w"), F.lit(0).alias("n"), F.lit(0).alias("most"))

    def step(a, w):
        n = F.when(a["w"] == w, a["n"] + 1).otherwise(F.lit(1))
        return F.struct(w.alias("w"), n.alias("n"), F.greatest(a["most"], n).alias("most"))

    most = F.aggregate(F.sort_array(words), start, step)["most"]
    whole = (F.char_length(letters) >= 40) & ~letters.rlike("[0-9]") & repeats(letters)
    return whole | ((F.size(words) >= 8) & (most >= 0.7 * F.size(words))) | F.exists(words, lambda w: (F.char_length(w) >= 40) & repeats(w))
