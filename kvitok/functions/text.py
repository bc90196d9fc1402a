"""Text functions built from native columns."""

from __future__ import annotations

import json
from collections.abc import Callable
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from kvitok.functions.markup import MARKUP, SHOWN

# Fixed value: whitespace as Unicode defines it, plus the four separator controls.
_SPACE = r"[\s\x1c-\x1f]"

# Message limit and the marker added when a message is cut.
MESSAGE_LIMIT = 4000
CUT_MARKER = "... (обрезано)"

# Longest name that counts without a semicolon, and so also as the beginning of a longer word.
_OPEN_NAME = max(len(name) for name in html5 if not name.endswith(";"))


def _reference_table() -> str:
    """Character references as a JSON object: all names the standard library knows,
    and the numbers 128 to 159, which stand for their windows-1252 characters."""
    table = dict(html5)
    for code in range(128, 160):
        try:
            table[f"#{code}"] = bytes([code]).decode("cp1252")
        except UnicodeDecodeError:
            table[f"#{code}"] = chr(code)
    return json.dumps(table)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def collapse_whitespace(text: Column) -> Column:
    """Runs of any Unicode whitespace become one space; the ends are trimmed."""
    # A single space is one already, so it is no match and most texts are not built anew.
    return F.trim(F.regexp_replace(text, f"(?U) {_SPACE}++|[{_SPACE}&&[^ ]]{_SPACE}*+", " "))


def strip(text: Column) -> Column:
    """Remove Unicode whitespace at both ends."""
    return F.regexp_replace(text, f"(?U)^{_SPACE}+|{_SPACE}+$", "")


def lstrip(text: Column) -> Column:
    return F.regexp_replace(text, f"(?U)^{_SPACE}+", "")


def blank_to_null(text: Column) -> Column:
    return F.nullif(text, F.lit(""))


def html_escape(text: Column) -> Column:
    # The characters that markup must not hold, the ampersand first.
    for raw, escaped in (
        ("&", "&amp;"),
        ("<", "&lt;"),
        (">", "&gt;"),
        ('"', "&quot;"),
        ("'", "&#x27;"),
    ):
        text = F.replace(text, F.lit(raw), F.lit(escaped))
    return text


def _code_point(digits: Column, base: int, table: Column) -> Column:
    """Character of a number; controls and code points that are no characters vanish."""

    def char(code: Column) -> Column:
        known = code.between(1, 0xD7FF) | code.between(0xE000, 0x10FFFF)
        unseen = (
            code.between(1, 8) | (code == 0xB) | code.between(0xE, 0x1F) | (code == 0x7F)
            | code.between(0xFDD0, 0xFDEF) | (F.pmod(code, F.lit(0x10000)) >= 0xFFFE)
        )
        # Anything else is no character and becomes the replacement character.
        kept = F.lpad(F.hex(F.when(known, code).otherwise(F.lit(0xFFFD))), 8, "0")
        special = F.try_element_at(table, F.concat(F.lit("#"), code.cast("string")))
        return F.coalesce(special, F.when(known & unseen, F.lit("")), F.decode(F.unhex(kept), "UTF-32"))

    # More digits than a code point has only say that it is none.
    return let(F.conv(F.substring(F.regexp_replace(digits, "^0+", ""), 1, 9), base, 10).cast("long"), char)


def decode_references(text: Column) -> Column:
    """Decode named and numeric character references; unknown ones stay as they are.

    The text is cut at each ``&``, so nothing is decoded twice. Texts without one skip the work.
    """
    table = F.from_json(F.lit(_reference_table()), "map<string,string>")

    def piece(p: Column, i: Column) -> Column:
        token = F.regexp_extract(p, r"^([a-zA-Z][a-zA-Z0-9]*+;?|#[0-9]++;?|#[xX][0-9a-fA-F]++;?)", 1)
        return let(token, lambda t: F.when(i == 0, p).when(t == "", F.concat(F.lit("&"), p)).otherwise(decoded(p, t)))

    def decoded(p: Column, token: Column) -> Column:
        dec = F.regexp_extract(token, r"^#([0-9]+)", 1)
        hexa = F.regexp_extract(token, r"^#[xX]([0-9a-fA-F]+)", 1)
        char = (
            F.when(dec != "", _code_point(dec, 10, table))
            .when(hexa != "", _code_point(hexa, 16, table))
            .otherwise(F.try_element_at(table, token))
        )
        # Else the longest beginning that is a name by itself.
        opened = [
            F.concat(F.try_element_at(table, F.substring(token, 1, n)), F.substr(p, F.lit(n + 1)))
            for n in range(_OPEN_NAME, 1, -1)
        ]
        opened = [F.when(F.length(token) > n, x) for n, x in zip(range(_OPEN_NAME, 1, -1), opened)]
        rest = F.substr(p, F.length(token) + 1)
        return F.coalesce(F.concat(char, rest), *opened, F.concat(F.lit("&"), p))

    pieces = F.transform(F.split(text, "&", -1), piece)
    return F.when(F.contains(text, F.lit("&")), F.array_join(pieces, "")).otherwise(text)


def visible_text(html: Column) -> Column:
    """Text a reader sees: no scripts, styles, comments or tags; references decoded.

    One pattern covers all markup, so whichever item opens first wins, and each
    becomes one space. It reads a text in linear time. Only native expressions are used.
    """
    bare = F.regexp_replace(html, MARKUP, SHOWN)
    return collapse_whitespace(let(bare, decode_references))


def truncate_message(text: Column, limit: int = MESSAGE_LIMIT) -> Column:
    cut = F.concat(F.substring(text, 1, limit), F.lit(CUT_MARKER))
    return F.when(F.length(text) > limit, cut).otherwise(text)


def _bullet(line: Column) -> Column:
    def bulleted(body: Column) -> Column:
        indent = F.repeat(F.lit(" "), F.length(line) - F.length(body))
        marked = body.startswith("* ") | body.startswith("- ")
        return F.when(marked, F.concat(indent, F.lit("• "), F.substr(body, F.lit(3)))).otherwise(line)

    return let(lstrip(line), bulleted)


def markdown_to_html(text: Column) -> Column:
    """Headings of level three, bold, italics and bullets as chat HTML; the rest is escaped."""
    out = html_escape(text)
    # Headings, bold and italics as the messages write them.
    for pattern, tag in (
        (r"(?md)^### (.*?)$", "b"),
        (r"(?d)\*\*(.*?)\*\*", "b"),
        (r"(?d)(?<!\*)\*(?!\*)(.*?)(?<!\*)\*(?!\*)", "i"),
    ):
        out = F.regexp_replace(out, pattern, f"<{tag}>$1</{tag}>")
    return F.array_join(F.transform(F.split(out, "\n", -1), _bullet), "\n")


def month_label(year: Column, month: Column) -> Column:
    """``YYYY-MM``."""
    return F.concat(year.cast("string"), F.lit("-"), F.lpad(month.cast("string"), 2, "0"))


def fixed(number: Column, digits: int) -> Column:
    """Fixed decimals without thousands separators."""
    return F.replace(F.format_number(number, digits), F.lit(","), F.lit(""))
