"""Sums per address, month and service."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kvitok.functions.tariff import analysis_tariff

# Fixed value: unit shown when a service has none.
DEFAULT_UNIT = "ед."


def at_addresses(charges: DataFrame, accounts: DataFrame) -> DataFrame:
    """Charges with the address of their account."""
    return charges.join(accounts.select("account_number", "address"), "account_number")


def listed_addresses(accounts: DataFrame) -> DataFrame:
    """Distinct trimmed addresses that are not blank, in order."""
    trimmed = F.trim("address")
    return accounts.where(trimmed != "").select(trimmed.alias("address")).distinct().orderBy("address")


def accounts_by_address(accounts: DataFrame, address: str | None = None) -> DataFrame:
    """Accounts per address, the stored address untrimmed; one address if given."""
    if address is not None:
        accounts = accounts.where(F.col("address") == address)
    return accounts.select("address", "account_number").orderBy("address", "account_number")


def charged_periods(charges: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Distinct months that have charges, per ``by`` key."""
    return charges.select(*by, "year", "month").distinct()


def newest_first(periods: DataFrame) -> DataFrame:
    return periods.orderBy(F.desc("year"), F.desc("month"))


def month_services(charges: DataFrame, by: Sequence[str] = ("address",)) -> DataFrame:
    """Quantity and amount per key, month and service over all accounts of the key."""
    return charges.groupBy(*by, "year", "month", "service").agg(
        F.coalesce(F.sum("quantity"), F.lit(0)).alias("quantity"),
        F.sum("amount_due").alias("amount_due"),
    )


def with_analysis_tariff(months: DataFrame) -> DataFrame:
    return months.withColumn("tariff", analysis_tariff(F.col("amount_due"), F.col("quantity")))


def month_breakdown(months: DataFrame, services: DataFrame) -> DataFrame:
    """The same sums by service name and unit, with the defaults of a report."""
    # Null-safe equality keeps Spark from testing the computed name for NULL once more at the scan.
    named = months.join(
        services.select("name", "unit"), F.col("service").eqNullSafe(F.col("name"))
    ).drop("name")
    return named.select(
        *[c for c in months.columns if c not in ("service", "quantity", "amount_due")],
        F.col("service").alias("name"),
        F.coalesce(F.nullif("unit", F.lit("")), F.lit(DEFAULT_UNIT)).alias("unit"),
        F.coalesce("quantity", F.lit(0)).alias("quantity"),
        F.coalesce("amount_due", F.lit(0)).alias("amount_due"),
    )


def in_range(start: tuple[int, int], end: tuple[int, int]) -> Column:
    """Inclusive month range, written so that year and month reach the file scan."""
    year, month = F.col("year"), F.col("month")
    return ((year > start[0]) | ((year == start[0]) & (month >= start[1]))) & (
        (year < end[0]) | ((year == end[0]) & (month <= end[1]))
    )


def before(period: tuple[int, int], inclusive: bool = False) -> Column:
    year, month = F.col("year"), F.col("month")
    last = (month <= period[1]) if inclusive else (month < period[1])
    return (year < period[0]) | ((year == period[0]) & last)


def of_accounts(charges: DataFrame, accounts: list[str] | DataFrame) -> DataFrame:
    """Charges of the listed accounts; a DataFrame of accounts becomes a semi join."""
    if isinstance(accounts, DataFrame):
        return charges.join(accounts.select("account_number"), "account_number", "left_semi")
    if not accounts:
        raise ValueError("no accounts given")
    return charges.where(F.col("account_number").isin(list(accounts)))
