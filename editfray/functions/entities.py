"""Character references of HTML as a column expression: names from the standard's table, numbers, and both without their semicolon."""

from __future__ import annotations

import json
from collections.abc import Callable
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Names by which a reference begins that may lack its semicolon, the longest first.
_BARE = sorted((n for n in html5 if not n.endswith(";")), key=lambda n: (-len(n), n))
_NAMES = json.dumps(html5)
_PREFIX = f"^({'|'.join(_BARE)})"
# Fixed values of the standard: numbers that stand for others, as the code page 1252 has them, and those that stand for nothing.
_ELSE = {0: "�", 13: "\r"} | {c: bytes([c]).decode("cp1252", "replace").replace("�", chr(c)) for c in range(0x80, 0xA0)}
_NOTHING = ((0x1, 0x8), (0xB, 0xB), (0xE, 0x1F), (0x7F, 0x9F), (0xFDD0, 0xFDEF))
#: What may be a reference, after its sign: a number, or a name of up to 32 signs.
DECIMAL, HEX, NAME = r"^#([0-9]+);?", r"^#[xX]([0-9a-fA-F]+);?", r"^([^\t\n\f <&#;]{1,32};?)"


def _sign(code: Column) -> Column:
    """The sign of a number (null: beyond all)."""
    plain = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
    none = (code % 0x10000).isin(0xFFFE, 0xFFFF)
    for low, high in _NOTHING:
        none = none | code.between(low, high)
    other = F.from_json(F.lit(json.dumps({str(k): v for k, v in _ELSE.items()})), "map<string,string>")
    found = F.element_at(other, code.cast("string"))
    return F.when(code.isNull() | code.between(0xD800, 0xDFFF) | (code > 0x10FFFF), F.lit("�")).when(found.isNotNull(), found).when(none, F.lit("")).otherwise(plain)


def _begun(piece: Column) -> Column:
    """What follows a sign "&", with it, decoded."""
    digits, hexed, name = (F.regexp_extract(piece, p, 1) for p in (DECIMAL, HEX, NAME))
    # Numbers of over nine signs are beyond all, once zeros at their front are gone.
    short = lambda c, most: F.when(F.length(F.ltrim(c, F.lit("0"))) <= most, c)
    number = F.when(digits != "", short(digits, 9).cast("bigint")).otherwise(F.conv(short(hexed, 8), 16, 10).cast("bigint"))
    rest = F.regexp_replace(piece, r"^#([0-9]+|[xX][0-9a-fA-F]+);?", "")
    exact = F.element_at(F.from_json(F.lit(_NAMES), "map<string,string>"), name)
    bare = F.regexp_extract(name, _PREFIX, 1)
    by_prefix = F.element_at(F.from_json(F.lit(json.dumps({n: html5[n] for n in _BARE})), "map<string,string>"), bare)
    after = lambda c: F.substr(piece, F.length(c) + 1)
    return (
        F.when((digits != "") | (hexed != ""), F.concat(_sign(number), rest))
        .when((name != "") & exact.isNotNull(), F.concat(exact, after(name)))
        .when(bare != "", F.concat(by_prefix, after(bare)))
        .otherwise(F.concat(F.lit("&"), piece))
    )


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value's expression in the plan once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def unescape(text: Column) -> Column:
    """text with its character references decoded, each once; null stays null."""
    return bound(text, _unescaped)


def _unescaped(text: Column) -> Column:
    pieces = F.split(text, "&", -1)
    decoded = F.concat(F.get(pieces, F.lit(0)), F.array_join(F.transform(F.slice(pieces, F.lit(2), F.size(pieces)), _begun), ""))
    return F.when(F.contains(text, F.lit("&")), decoded).otherwise(text)


def unescape_sql(text: str) -> str:
    """The same for the SQL that queries are held against."""
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    table = lambda names: "MAP {" + ", ".join(f"{quoted(k)}: " + " || ".join(f"chr({ord(c)})" for c in v) for k, v in names) + "}"
    names, bare = table(html5.items()), table((n, html5[n]) for n in _BARE)
    other = "MAP {" + ", ".join(f"{k}: chr({ord(v)})" for k, v in _ELSE.items()) + "}"
    none = " OR ".join(f"n BETWEEN {a} AND {b}" for a, b in _NOTHING)
    number = f"(CASE WHEN n IS NULL OR n BETWEEN 55296 AND 57343 OR n > 1114111 THEN chr(65533) WHEN {other}[n] IS NOT NULL THEN {other}[n] WHEN n % 65536 >= 65534 OR {none} THEN '' ELSE chr(n::INT) END)"
    value = "(CASE WHEN regexp_matches(p, '^#[0-9]') THEN TRY_CAST(regexp_extract(p, '^#([0-9]+)', 1) AS BIGINT) ELSE TRY_CAST('0x' || regexp_extract(p, '^#[xX]0*([0-9a-fA-F]+)', 1) AS BIGINT) END)"
    name, first = f"regexp_extract(p, {quoted(NAME)}, 1)", f"regexp_extract(p, {quoted(_PREFIX)}, 1)"
    begun = (
        f"CASE WHEN regexp_matches(p, '^#([0-9]|[xX][0-9a-fA-F])') THEN list_transform([{value}], lambda n: {number})[1] || regexp_replace(p, '^#([0-9]+|[xX][0-9a-fA-F]+);?', '') "
        f"WHEN {names}[{name}] IS NOT NULL THEN {names}[{name}] || substr(p, length({name}) + 1) WHEN {first} <> '' THEN {bare}[{first}] || substr(p, length({first}) + 1) ELSE '&' || p END"
    )
    return f"(CASE WHEN contains({text}, '&') THEN string_split({text}, '&')[1] || array_to_string(list_transform(string_split({text}, '&')[2:], lambda p: {begun}), '') ELSE {text} END)"
