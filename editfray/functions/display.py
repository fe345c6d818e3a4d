"""What a dashboard shows of numbers, periods, protection and segments, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names of protection levels.
LEVELS = {"sysop": "full protection", "autoconfirmed": "semi-protection", "extendedconfirmed": "extended confirmed protection", "templateeditor": "template protection"}
# Phases of a run.
PHASES = {
    "starting": "Starting", "resolving_candidates": "Resolving candidates", "resolving_talk_pages": "Resolving talk pages", "downloading_shards": "Downloading XML shards",
    "parsing_shards": "Parsing XML shards", "writing_cache": "Writing evidence cache", "period_done": "Period complete", "complete": "Complete", "stopped": "Stopped",
}


def number(x: Column) -> Column:
    """Groups of three digits, and one digit after the point where it isn't zero."""
    return F.regexp_replace(F.format_number(x.cast("double"), 1), r"\.0$", "")


def size(b: Column) -> Column:
    b = F.coalesce(b.cast("double"), F.lit(0.0))
    return F.when(b >= 1e6, F.concat(number(b / 1e6), F.lit(" MB"))).when(b >= 1e3, F.concat(number(b / 1e3), F.lit(" KB"))).otherwise(F.concat(number(b), F.lit(" B")))


def minutes(m: Column) -> Column:
    return F.concat(number(F.coalesce(m, F.lit(0))), F.lit(" min"))


def days(d: Column) -> Column:
    return F.when(d >= 365, F.concat(number(d / 365), F.lit(" years"))).when(d >= 1, F.concat(number(d), F.lit(" days"))).otherwise(F.concat(number(d * 24), F.lit(" hours")))


def expiry(value: Column) -> Column:
    v = F.btrim(F.coalesce(value, F.lit("")))
    day = F.concat_ws("-", F.substring(v, 1, 4), F.substring(v, 5, 2), F.substring(v, 7, 2))
    return F.when(v == "", "--").when(F.lower(v) == "infinity", "indefinite").when(v.rlike(r"^\d{14}$"), day).otherwise(v)


def parts(value: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(value, F.lit("")), ","), F.btrim), lambda x: x != "")


def level(value: Column) -> Column:
    key = F.regexp_replace(F.lower(F.coalesce(value, F.lit(""))), r"[-_\s]", "")
    out = value
    for name, text in LEVELS.items():
        out = F.when(key == name, text).otherwise(out)
    return out


def protection(levels: Column, cascade: Column, now: Column) -> Column:
    names = F.concat(F.transform(parts(levels), level), F.when(cascade, F.array(F.lit("cascading protection"))).otherwise(F.array().cast("array<string>")))
    return F.when(~now, "not currently protected").when(F.size(names) == 0, "currently protected").otherwise(F.array_join(names, ", "))


def period(p: Column, months: Column) -> Column:
    year, month = r"^history-year:(\d{4}-\d{2}):(\d{4})$", r"^history:(\d{4}-\d{2}):(\d{4}-\d{2})$"
    count = F.when(months > 0, F.concat(F.lit(", "), months.cast("string"), F.lit("/12 months"))).otherwise("")
    of = lambda q: F.concat(F.regexp_extract(p, q, 2), F.lit(" ("), F.regexp_extract(p, q, 1), F.lit(" snapshot"))
    return F.when(p.rlike(year), F.concat(of(year), count, F.lit(")"))).when(p.rlike(month), F.concat(of(month), F.lit(")"))).otherwise(F.coalesce(p, F.lit("")))


def label(key: Column) -> Column:
    """Words of a key, each with its first letter in upper case."""
    return F.array_join(F.transform(F.split(F.replace(key, F.lit("_"), F.lit(" ")), " "), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1 << 30))), " ")


def escaped(text: Column) -> Column:
    out = text
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#039;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def phase(p: Column) -> Column:
    out = F.when(F.coalesce(p, F.lit("")) == "", "Running").otherwise(p)
    for name, text in PHASES.items():
        out = F.when(p == name, text).otherwise(out)
    return out


def segment_hash(segment: Column, before: Column, after: Column) -> Column:
    """31-fold rolling hash in 32 bits of the segment and its context, without its sign. Code points beyond 2^16 count as one."""
    raw = F.concat_ws("-", *[F.coalesce(x, F.lit("")) for x in (segment, before, after)])
    codes = F.transform(F.filter(F.split(raw, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long"))
    rolled = F.aggregate(codes, F.lit(0).cast("long"), lambda h, c: (h * 31 + c).bitwiseAND(0xFFFFFFFF))
    return F.abs(F.when(rolled >= 1 << 31, rolled - (1 << 32)).otherwise(rolled))


def segment_id(segment: Column, before: Column, after: Column) -> Column:
    return F.lower(F.conv(segment_hash(segment, before, after).cast("string"), 10, 36))


def display_score(method: str, columns) -> Column:
    names = [c for c in (["controversy_score"] if method == "edit-war" else []) + ["candidate_score", "peak_score"] if c in columns]
    return F.coalesce(*names)
