"""Upserts as pure DataFrame steps: which row of a key survives.

``row_number() = 1`` is planned with a group limit on both sides of the shuffle,
so a key that holds a large share of the log is cut to one row per map task first.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kvitok.functions.names import normalize_service
from kvitok.functions.numbers import MONEY, QUANTITY
from kvitok.operators.parse import UNKNOWN_UNIT


def _one_per_key(df: DataFrame, keys: Sequence[str], order: list[Column]) -> DataFrame:
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(window)).where("_rank = 1").drop("_rank")


def latest_wins(df: DataFrame, keys: Sequence[str], arrival: Sequence[str]) -> DataFrame:
    """The whole last-arrived row of each key, NULLs included."""
    return _one_per_key(df, keys, [F.col(c).desc() for c in arrival])


def first_wins(df: DataFrame, keys: Sequence[str], arrival: Sequence[str]) -> DataFrame:
    """The whole first-arrived row of each key."""
    return _one_per_key(df, keys, [F.col(c).asc() for c in arrival])


def replace_rows(
    existing: DataFrame, new: DataFrame, keys: Sequence[str], arrival: Sequence[str]
) -> DataFrame:
    """Existing rows with new rows put over them; both carry the arrival columns."""
    return latest_wins(existing.unionByName(new, allowMissingColumns=True), keys, arrival)


def missing_rows(candidates: DataFrame, existing: DataFrame, keys: list[str]) -> DataFrame:
    """Candidates whose key is not stored yet.

    The stored keys among the candidates are found first: that semi join can ship the
    few candidates to a large table, which an anti join against the table cannot.
    """
    known = existing.select(*keys).join(candidates.select(*keys), keys, "left_semi")
    return candidates.join(known, keys, "left_anti")


def surrogate_id(*natural_key: str) -> Column:
    """Deterministic label of a natural key. Joins use the natural key itself."""
    return F.xxhash64(*natural_key)


def charge_rows(lines: DataFrame) -> DataFrame:
    """Bill lines with the columns a charge row has; ``service`` is the canonical name."""
    zero = F.lit(0).cast(MONEY)
    return lines.select(
        "account_number",
        "year",
        "month",
        normalize_service(F.col("raw_service")).alias("service"),
        F.col("quantity").cast(QUANTITY).alias("quantity"),
        zero.alias("tariff"),
        (F.col("quantity") * zero).cast(MONEY).alias("accrued_by_tariff"),
        zero.alias("benefit"),
        zero.alias("recalculation"),
        F.col("amount_due").cast(MONEY).alias("amount_due"),
        *[c for c in lines.columns if c not in _LINE_COLUMNS],
    )


_LINE_COLUMNS = ("account_number", "year", "month", "raw_service", "quantity", "amount_due")
CHARGE_KEY = ("account_number", "year", "month", "service")


def upsert_charges(lines: DataFrame, arrival: Sequence[str]) -> DataFrame:
    """Charges: per account, month and service the last line, never a sum."""
    rows = latest_wins(charge_rows(lines), CHARGE_KEY, arrival)
    return rows.drop(*[c for c in arrival if c not in ("quantity", "amount_due")])


def upsert_period_info(bills: DataFrame, arrival: Sequence[str]) -> DataFrame:
    """Apartment facts: the last bill with any fact replaces the whole row."""
    facts = ("total_area", "living_area", "rooms", "residents", "last_payment_date")
    any_fact = F.coalesce(*[F.col(c).cast("string") for c in facts]).isNotNull()
    rows = bills.where(any_fact).select(
        "account_number", "year", "month", *facts, F.lit(None).cast("string").alias("meter_readings"),
        *[c for c in ("created_at",) if c in bills.columns],
        *arrival,
    )
    return latest_wins(rows, ("account_number", "year", "month"), arrival).drop(*arrival)


def account_rows(bills: DataFrame, arrival: Sequence[str]) -> DataFrame:
    """Accounts as the first bill names them; a missing address is stored empty."""
    rows = bills.select(
        "account_number", F.coalesce("address", F.lit("")).alias("address"), *arrival
    )
    first = first_wins(rows, ("account_number",), arrival)
    return first.select(surrogate_id("account_number").alias("account_id"), "account_number", "address", *arrival)


def merged_accounts(rows: DataFrame) -> DataFrame:
    """One row per account of rows that several batches wrote: named as its first bill of all names it."""
    first = F.min(F.struct("received_at", "msg_id", "address")).alias("first")
    merged = rows.groupBy("account_number").agg(
        first, F.min("created_at").alias("created_at"), F.max("updated_at").alias("updated_at"), F.max("batch_id").alias("batch_id")
    )
    return merged.select(
        surrogate_id("account_number").alias("account_id"),
        "account_number",
        "first.address",
        "first.received_at",
        "first.msg_id",
        "created_at",
        "updated_at",
        F.lit(None).cast("string").alias("prior_address"),
        "batch_id",
    )


def corrected_accounts(candidates: DataFrame, stored: DataFrame, now: Column) -> DataFrame:
    """Accounts that are new, or whose first bill turns out to be earlier than the stored one.

    ``prior_address`` is the address that a correction takes away. Only stored accounts among the
    candidates are read on.
    """
    known = stored.join(candidates.select("account_number"), "account_number", "left_semi").select(
        "account_number",
        F.struct("received_at", "msg_id").alias("_arrival"),
        F.col("address").alias("_address"),
        F.col("created_at").alias("_created_at"),
    )
    both = candidates.join(known, "account_number", "left")
    earlier = both.where(F.col("_arrival").isNull() | (F.struct("received_at", "msg_id") < F.col("_arrival")))
    prior = F.when(F.col("_address") != F.col("address"), F.col("_address"))
    return earlier.select(
        *candidates.columns, F.coalesce("_created_at", now).alias("created_at"), now.alias("updated_at"), prior.alias("prior_address")
    )


def period_rows(bills: DataFrame) -> DataFrame:
    return (
        bills.select("year", "month")
        .distinct()
        .select(
            surrogate_id("year", "month").alias("period_id"),
            "year",
            "month",
            F.make_date("year", "month", F.lit(1)).alias("start_date"),
        )
    )


def service_rows(lines: DataFrame, arrival: Sequence[str] = ()) -> DataFrame:
    """Services by canonical name, with the unit of the line that named each first.

    Lines without a unit have the one that all bills print, and need no order. Raw names and units are
    reduced to their first line each before names are normalised.
    """
    unit = F.col("unit") if "unit" in lines.columns else F.lit(UNKNOWN_UNIT)
    first = F.min(F.struct(*arrival, unit.alias("unit"))).alias("first")
    named = lines.groupBy("raw_service").agg(first)
    by_name = named.groupBy(normalize_service(F.col("raw_service")).alias("name")).agg(F.min("first").alias("first"))
    return by_name.select(
        surrogate_id("name").alias("service_id"),
        "name",
        F.col("first.unit").alias("unit"),
        F.lit(None).cast("string").alias("code"),
        *[F.col(f"first.{c}").alias(c) for c in arrival],
    )


def merged_services(rows: DataFrame) -> DataFrame:
    """One row per service of rows that several batches wrote; the first unit stays."""
    arrival = ("received_at", "msg_id", "line_idx")
    merged = rows.groupBy("name").agg(F.min(F.struct(*arrival, "unit", "code")).alias("first"), F.max("batch_id").alias("batch_id"))
    return merged.select(
        surrogate_id("name").alias("service_id"), "name", "first.unit", "first.code", *[F.col(f"first.{c}").alias(c) for c in arrival], "batch_id"
    )


def bill_lines(bills: DataFrame, *keep: str) -> DataFrame:
    """One row per service line of stored bills, with its position in the bill."""
    return bills.select(
        "account_number", "year", "month", *keep, F.posexplode("services").alias("line_idx", "s")
    ).select(
        "account_number",
        "year",
        "month",
        F.col("s.name").alias("raw_service"),
        "s.unit",
        "s.quantity",
        "s.amount_due",
        *keep,
        "line_idx",
    )


def import_rows(bills: DataFrame, imported_at: Column) -> DataFrame:
    """Audit rows, one per stored bill; importing the same file again adds another."""
    return bills.select(
        F.lit("email").alias("source_type"),
        F.col("msg_id").alias("source_identifier"),
        F.col("msg_id").alias("raw_content"),
        imported_at.alias("processed_at"),
        "account_number",
    )
