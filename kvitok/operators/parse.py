"""Bills out of message parts, as native columns.

All steps work on one message row: candidates are array elements, so no part
of a message is ever shuffled and no window over message ids is needed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kvitok.functions.names import has_service_keyword, text_line_service
from kvitok.functions.numbers import (
    MONEY,
    QUANTITY,
    first_token,
    to_decimal,
    to_double,
    valid_tokens,
)
from kvitok.functions.text import blank_to_null, collapse_whitespace, let
from kvitok.schemas import BILL, SERVICE_LINE

# Patterns of the bill fields, applied to whitespace-collapsed text. Those that ignore case look first
# for all forms of their first letter, which is much faster than folding each letter of a text.
ACCOUNT = (
    r"Ф(?:ЛС|АС)\s*№?\s*(\d+)",
    r"[Кк](?iu)од\s+плательщика\s*[:\s]*(\d+)",
    r"[Пп](?iu)лательщик\s+№\s*(\d+)",
)
ADDRESS = r"[Аа](?iu)ДРЕС\s*[:\s]*([^\n\r]+?)(?=\s+(?:ПЕРИОД|код|на\s+\d{4}|$))"
PERIOD = r"[Пп](?iu)ЕРИОД\s*[:\s]*(\d{1,2})\s+месяц\s+(\d{4})\s+год"
AS_OF = r"на\s+(\d{4})-(\d{2})-(\d{2})"
TOTAL = r"[Ии](?iu)того к оплате\s*[:\s]*([\d\.,]+)"
APARTMENT = (
    r"[Тт\u1C84\u1C85](?iu)ип кв\.:\s*(.+?)[,.]?\s+К-во комнат:\s*(\d+)\s+"
    r"Площадь общая:\s*([\d\.]+),?\s+жилая:\s*([\d\.]+)"
)
RESIDENTS = r"[Пп](?iu)роживающих:\s*(\d+)"
PAID_ON = r"[Дд\u1C81](?iu)ата последней оплаты:\s*([\d\.-]+)"

# Fixed value: bills name no unit.
UNKNOWN_UNIT = "?"

VALID = "valid"
INVALID = "invalid"
BAD_AMOUNT = "bad_amount"


def bill_matches(text: Column) -> Column:
    """Struct of what the patterns find once whitespace is collapsed, ``''`` if nothing.

    Every pattern reads the text once, and those that stand in for others only where these find
    nothing. Those with several groups keep the whole match, whose groups are taken later from that
    short piece.
    """
    found = {
        "address": (ADDRESS, 1),
        "total": (TOTAL, 1),
        "apartment": (APARTMENT, 0),
        "residents": (RESIDENTS, 1),
        "paid_on": (PAID_ON, 1),
    }

    def first_of(t: Column, *patterns: str, group: int = 1) -> Column:
        # Nested, as a function that nulls empty texts would search twice.
        found = F.regexp_extract(t, patterns[-1], group)
        for pattern in reversed(patterns[:-1]):
            found = F.when(F.rlike(t, F.lit(pattern)), F.regexp_extract(t, pattern, group)).otherwise(found)
        return found

    def matches(t: Column) -> Column:
        return F.struct(
            first_of(t, *ACCOUNT).alias("account"),
            first_of(t, PERIOD, AS_OF, group=0).alias("dated"),
            *[F.regexp_extract(t, p, g).alias(name) for name, (p, g) in found.items()],
        )

    return let(collapse_whitespace(text), matches)


def _pieces(found: Column) -> Column:
    """What ``bill_matches`` found, its matches of several groups cut into these."""

    def group(name: str, pattern: str, number: int) -> Column:
        # No group of a match is empty, and what is searched for twice costs twice.
        return F.when(found[name] != "", F.regexp_extract(found[name], pattern, number))

    # A match of one of these patterns is none of the other, and gives an empty text, which is no number.
    return F.struct(
        *[found[name].alias(name) for name in ("account", "address", "total", "residents", "paid_on")],
        F.coalesce(group("dated", PERIOD, 2).try_cast("int"), group("dated", AS_OF, 1).try_cast("int")).alias("year"),
        F.coalesce(group("dated", PERIOD, 1).try_cast("int"), group("dated", AS_OF, 2).try_cast("int")).alias("month"),
        *[group("apartment", APARTMENT, n).alias(name) for n, name in enumerate(("type", "rooms", "area", "living"), 1)],
    )


def _values(piece: Column) -> Column:
    """The pieces of a bill with the numbers that several fields need."""
    return F.struct(
        *[piece[name].alias(name) for name in ("account", "address", "total", "residents", "paid_on", "year", "month", "type", "rooms")],
        to_double(piece["total"]).alias("total_value"),
        to_decimal(piece["total"], MONEY).alias("total_due"),
        to_double(piece["area"]).alias("area"),
        to_double(piece["living"]).alias("living"),
    )


def _fields(value: Column) -> Column:
    """Scalar fields of a bill. Its text holds single spaces only, so these are all that is to be trimmed."""
    bad_total = (value["total"] != "") & value["total_value"].isNull()
    too_large = value["total_value"].isNotNull() & value["total_due"].isNull()
    bad_area = value["type"].isNotNull() & (value["area"].isNull() | value["living"].isNull())
    return F.struct(
        blank_to_null(value["account"]).alias("account_number"),
        F.trim(blank_to_null(value["address"])).alias("address"),
        value["year"].alias("year"),
        value["month"].alias("month"),
        value["total_due"].alias("total_due"),
        F.trim(value["type"]).alias("apartment_type"),
        value["rooms"].try_cast("int").alias("rooms"),
        value["area"].alias("total_area"),
        value["living"].alias("living_area"),
        value["residents"].try_cast("int").alias("residents"),
        blank_to_null(value["paid_on"]).alias("last_payment_date"),
        F.when(bad_total, F.lit("bad_total")).when(bad_area, F.lit("bad_area")).when(too_large, F.lit(BAD_AMOUNT)).alias("defect"),
    )


# Steps from matches to fields; what one step gives, the next one may use often, so it is to be computed once.
FIELD_STEPS = (_pieces, _values, _fields)
FIELD_NAMES = (
    "account_number", "address", "year", "month", "total_due", "apartment_type", "rooms", "total_area", "living_area", "residents",
    "last_payment_date",
)


def _service_line(name: Column, quantity: Column, amount: Column) -> Column:
    zero = F.lit(0).cast(MONEY)
    return F.struct(
        name.alias("name"),
        F.lit(UNKNOWN_UNIT).alias("unit"),
        to_decimal(quantity, QUANTITY).alias("quantity"),
        zero.alias("tariff"),
        to_decimal(amount, MONEY).alias("amount_due"),
        zero.alias("benefit"),
        zero.alias("recalculation"),
    )


def text_services(body: Column) -> Column:
    """Service lines of a plain-text body: keyword plus at least two numbers; the last two count."""
    named = F.transform(
        F.split(body, "\n", -1), lambda line: F.struct(text_line_service(line).alias("name"), line.alias("line"))
    )
    lines = F.transform(
        F.filter(named, lambda x: x["name"].isNotNull()),
        lambda x: F.struct(x["name"].alias("name"), valid_tokens(x["line"]).alias("numbers")),
    )
    kept = F.filter(lines, lambda x: F.size(x["numbers"]) >= 2)
    return F.transform(
        kept,
        lambda x: _service_line(
            x["name"], F.try_element_at(x["numbers"], F.lit(-2)), F.try_element_at(x["numbers"], F.lit(-1))
        ),
    )


def _is_service_row(cells: Column) -> Column:
    return (
        (F.size(cells) >= 3)
        & has_service_keyword(F.get(cells, 0))
        & (first_token(F.get(cells, 1)) != "")
        & (first_token(F.get(cells, 2)) != "")
    )


def html_services(rows: Column) -> Column:
    """Service rows of the first table that has the most of them. A row names all tables that hold it."""

    def best_of(found: Column) -> Column:
        def size(table: Column) -> Column:
            held = F.filter(found, lambda row: F.array_contains(row["tables"], table))
            return F.struct(F.size(held).alias("n"), (-table).alias("order"))

        tables = F.array_distinct(F.flatten(F.transform(found, lambda row: row["tables"])))
        return let(
            F.array_max(F.transform(tables, size)),
            lambda most: F.filter(found, lambda row: F.array_contains(row["tables"], -most["order"])),
        )

    best = F.transform(
        F.coalesce(
            let(F.filter(rows, lambda row: _is_service_row(row["cells"])), best_of),
            F.array().cast("array<struct<cells:array<string>,tables:array<int>>>"),
        ),
        lambda row: row["cells"],
    )
    lines = F.transform(
        best,
        lambda cells: F.struct(
            F.get(cells, 0).alias("name"),
            first_token(F.get(cells, 1)).alias("quantity"),
            first_token(F.get(cells, 2)).alias("amount"),
        ),
    )
    kept = F.filter(
        lines, lambda x: to_double(x["quantity"]).isNotNull() & to_double(x["amount"]).isNotNull()
    )
    return F.transform(kept, lambda x: _service_line(x["name"], x["quantity"], x["amount"]))


def _candidate(part: Column) -> Column:
    is_html = part["content_type"] == "text/html"
    source = F.when(is_html, part["visible"]).otherwise(part["body"])
    return F.struct(
        part["part_idx"].alias("part_idx"),
        F.when(is_html, F.lit("html")).otherwise(F.lit("text")).alias("kind"),
        bill_matches(source).alias("found"),
        F.when(is_html, html_services(part["rows"]))
        .otherwise(text_services(part["body"]))
        .cast(f"array<{SERVICE_LINE}>")
        .alias("services"),
    )


def _judged(candidate: Column) -> Column:
    """Candidate with its fields and a status: valid, invalid or the defect that stops the message."""
    # Tokens of service lines are numbers, so a NULL is one beyond the digits that are stored.
    too_large = F.exists(candidate["services"], lambda s: s["quantity"].isNull() | s["amount_due"].isNull())

    def with_status(bill: Column) -> Column:
        complete = (
            bill["account_number"].isNotNull()
            & (F.coalesce(bill["year"], F.lit(0)) != 0)
            & (F.coalesce(bill["month"], F.lit(0)) != 0)
            & ((candidate["kind"] == "text") | (F.size(candidate["services"]) > 0))
        )
        return F.struct(
            candidate["part_idx"].alias("part_idx"),
            candidate["kind"].alias("kind"),
            *[bill[name].alias(name) for name in FIELD_NAMES],
            candidate["services"].alias("services"),
            F.coalesce(
                bill["defect"],
                F.when(complete & too_large, F.lit(BAD_AMOUNT))
                .when(complete, F.lit(VALID))
                .otherwise(F.lit(INVALID)),
            ).alias("status"),
        )

    pieces, values, fields = FIELD_STEPS
    return let(pieces(candidate["found"]), lambda p: let(values(p), lambda v: let(fields(v), with_status)))


def _first_deciding() -> Column:
    filled = F.filter("parts", lambda p: p["body"] != "")
    ordered = F.concat(
        F.filter(filled, lambda p: p["content_type"] == "text/html"),
        F.filter(filled, lambda p: p["content_type"] != "text/html"),
    )
    # Candidates behind the one that decides are not read.
    return F.aggregate(
        ordered,
        F.lit(None).cast(BILL),
        lambda deciding, part: F.when(deciding.isNotNull(), deciding).otherwise(
            let(let(_candidate(part), _judged), lambda c: F.when(c["status"] != INVALID, c))
        ),
    )


def parse_messages(messages: DataFrame) -> DataFrame:
    """Adds ``bill`` (NULL if none) and ``reason`` (NULL if the bill can be stored).

    HTML parts come before text parts, each in message order. The first candidate
    that is valid, or whose total or area is no number, decides. Where the reader of mail
    found it already (``deciding``), no part is read again.
    """
    if "deciding" in messages.columns:
        parsed = messages
    else:
        # Generated columns are computed once; a plain column would be repeated in every filter on it.
        parsed = messages.select(
            *[c for c in messages.columns if c != "parts"], F.explode(F.array(_first_deciding())).alias("deciding")
        )
    status = F.col("deciding.status")
    reason = (
        F.when(F.col("problem").isNotNull(), F.lit("unreadable"))
        .when(status.isNull(), F.lit("no_bill"))
        .when(status != VALID, status)
        .when(~F.col("deciding.month").between(1, 12), F.lit("bad_month"))
    )
    return parsed.select(
        *[c for c in messages.columns if c not in ("parts", "deciding")],
        F.when(status == VALID, F.col("deciding")).alias("bill"),
        reason.alias("reason"),
    )


def parse_texts(texts: DataFrame, body: str = "body") -> DataFrame:
    """Adds the bill fields of a plain-text column, computed once per row."""
    rows = texts.select("*", F.explode(F.array(bill_matches(F.col(body)))).alias("found"))
    for step in FIELD_STEPS[:-1]:
        rows = rows.select(*texts.columns, F.explode(F.array(step(F.col("found")))).alias("found"))
    return rows.select(*texts.columns, F.inline(F.array(FIELD_STEPS[-1](F.col("found")))))


def stored_bills(parsed: DataFrame) -> DataFrame:
    """Bills that pass all checks, one row each, fields as columns."""
    stored = [c for c in ("created_at",) if c in parsed.columns]
    return parsed.where("reason IS NULL").select("msg_id", "received_at", *stored, "bill.*")


def quarantine(parsed: DataFrame) -> DataFrame:
    """Messages that gave no storable bill, with the reason."""
    return parsed.where("reason IS NOT NULL").select("msg_id", "received_at", "reason", "content")
