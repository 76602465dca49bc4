"""Character references of HTML as expressions: named ones from the standard's list, decimal and hexadecimal numbers.

A text is cut at its ampersands; each piece begins with what may be a reference. Names are looked up in one constant map,
built from the list that Python's standard library carries; a name without its semicolon counts where the standard
allows that, by its longest prefix that is one. Everything stays in the JVM.
"""

from __future__ import annotations

import json
import zlib
from functools import cache
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from citewell.functions.overlap import bound

_NAME = r"^[^\t\n\f <&#;]{1,32};?"
_DECIMAL, _HEXADECIMAL = r"^#(\d+);?", r"^#[xX]([0-9a-fA-F]+);?"
#: The longest name that may go without a semicolon.
_BARE = max(len(n) for n in html5 if not n.endswith(";"))
_LAST = 0x10FFFF
_MAPS = 1024


@cache
def _names() -> str:
    """The names dealt over small maps by their checksum: a map is searched from end to end."""
    dealt: list[dict[str, str]] = [{} for _ in range(_MAPS)]
    for name, text in html5.items():
        dealt[zlib.crc32(name.encode()) % _MAPS][name] = text
    return json.dumps(dealt, ensure_ascii=False)


def _named(name: Column) -> Column:
    """The text of a name, or null."""
    maps = F.from_json(F.lit(_names()), "array<map<string,string>>")
    return F.try_element_at(F.get(maps, (F.crc32(name.cast("binary")) % _MAPS).cast("int")), name)


def _windows() -> dict[int, str]:
    """Numbers 128 to 159 mean what they are in Windows-1252, where it has them."""
    out = {}
    for n in range(128, 160):
        try:
            out[n] = bytes([n]).decode("cp1252")
        except UnicodeDecodeError:
            out[n] = chr(n)
    return out


def character(number: Column) -> Column:
    """The text of a code point as a reference means it; empty for those that the standard ignores."""
    own = F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32")
    windows = F.from_json(F.lit(json.dumps({str(k): v for k, v in _windows().items()})), "map<string,string>")
    ignored = number.between(1, 8) | (number == 11) | number.between(14, 31) | (number == 127) | number.between(0xFDD0, 0xFDEF) | (number.bitwiseAND(F.lit(0xFFFE)) == 0xFFFE)
    return (
        F.when((number == 0) | (number > _LAST) | number.between(0xD800, 0xDFFF), "�").when(number.between(128, 159), F.try_element_at(windows, number.cast("string")))
        .when(ignored, "").otherwise(own)
    )


def _number(digits: Column, base: int) -> Column:
    """The number, or one beyond all characters where there are more digits than any has."""
    short = F.regexp_replace(digits, "^0+(?=.)", "")
    return F.when(F.length(short) > 8, F.lit(_LAST + 1)).otherwise(F.conv(short, base, 10)).cast("long")


def _piece(p: Column) -> Column:
    """What follows an ampersand, with its reference resolved."""
    rest = lambda n: F.substring(p, n + 1, F.length(p))

    def numeric(pattern: str, base: int) -> Column:
        return F.concat(character(_number(F.regexp_extract(p, pattern, 1), base)), rest(F.length(F.regexp_extract(p, pattern, 0))))

    def named(name: Column) -> Column:
        prefix = [F.when(F.length(name) > k, F.concat(_named(F.left(name, F.lit(k))), rest(F.lit(k)))) for k in range(_BARE, 1, -1)]
        return F.coalesce(F.concat(_named(name), rest(F.length(name))), *prefix, F.concat(F.lit("&"), p))

    return (
        F.when(p.rlike(_HEXADECIMAL), numeric(_HEXADECIMAL, 16)).when(p.rlike(_DECIMAL), numeric(_DECIMAL, 10))
        .when(p.rlike(_NAME), bound(F.regexp_extract(p, _NAME, 0), named)).otherwise(F.concat(F.lit("&"), p))
    )


def unescape_html(text: Column) -> Column:
    """The text with its character references resolved, once; null stays null."""

    def whole(t: Column) -> Column:
        return bound(F.split(t, "&"), lambda parts: F.concat(parts[0], F.array_join(F.transform(F.slice(parts, 2, F.size(parts)), _piece), "")))

    return F.when(F.contains(text, F.lit("&")), bound(text, whole)).otherwise(text)
