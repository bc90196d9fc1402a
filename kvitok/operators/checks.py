"""Table constraints as counts of violations.

A table is first counted per key (``key_counts``); all its checks read those counts,
so they share one shuffle and a key that holds much of the table is one row by then.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kvitok.session import shared_dir


def key_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Distinct values of the checked columns with their number of rows ``n``."""
    return df.groupBy(*columns).agg(F.count(F.lit(1)).alias("n"))


def row_checks(counts: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Rows that break each rule."""
    broken = [
        F.coalesce(F.sum(F.when(~F.coalesce(ok, F.lit(False)), F.col("n"))), F.lit(0)).alias(name)
        for name, ok in rules.items()
    ]
    result = F.array(
        *[F.struct(F.lit(name).alias("rule"), F.col(f"`{name}`").alias("violations")) for name in rules]
    )
    return counts.agg(*broken).select(F.inline(result))


def unique_check(counts: DataFrame, rule: str) -> DataFrame:
    """Keys that occur more than once."""
    return counts.agg(F.count_if(F.col("n") > 1).alias("violations")).select(
        F.lit(rule).alias("rule"), "violations"
    )


def reference_check(counts: DataFrame, parent: DataFrame, rule: str, key: list[str]) -> DataFrame:
    """Child rows without a parent row. NULL keys are left to the row checks."""
    present = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in key])
    children = counts.where(present).groupBy(*key).agg(F.sum("n").alias("n"))
    orphans = children.join(parent.select(*key), key, "left_anti")
    return orphans.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("violations")).select(
        F.lit(rule).alias("rule"), "violations"
    )


def all_checks(checks: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, checks)


# The constraints of the tables: columns that hold no NULL, keys that occur once, and keys that must
# exist in another table unless they are NULL.
NOT_NULL = {
    "accounts": ("account_number", "address"),
    "periods": ("year", "month", "start_date"),
    "services": ("name",),
    "charges": ("account_number", "year", "month", "service"),
    "account_period_info": ("account_number", "year", "month"),
    "raw_imports": ("source_type",),
    "address_analysis": ("address", "year", "month", "prompt", "response", "model"),
}
UNIQUE = {
    "accounts": ("account_number",),
    "periods": ("year", "month"),
    "services": ("name",),
    "charges": ("account_number", "year", "month", "service"),
    "account_period_info": ("account_number", "year", "month"),
    "address_analysis": ("address", "year", "month"),
}
REFERENCES = (
    ("charges", ("account_number",), "accounts", ("account_number",)),
    ("charges", ("year", "month"), "periods", ("year", "month")),
    ("charges", ("service",), "services", ("name",)),
    ("account_period_info", ("account_number",), "accounts", ("account_number",)),
    ("account_period_info", ("year", "month"), "periods", ("year", "month")),
    ("raw_imports", ("account_number",), "accounts", ("account_number",)),
    ("address_analysis", ("year", "month"), "periods", ("year", "month")),
)
MONTHS = ("periods",)


def _no_null(columns: Sequence[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in columns])


def _keys(table: str) -> list[str]:
    """Columns of a table whose values the checks must tell apart; of others only whether they are NULL counts."""
    own = [c for child, key, _, _ in REFERENCES if child == table for c in key]
    return list(dict.fromkeys([*UNIQUE.get(table, ()), *own, *(("month",) if table in MONTHS else ())]))


def table_counts(table: str, rows: DataFrame) -> DataFrame:
    """What all checks of a table need, as counts per key. Counts of several batches add up (``merged_counts``)."""
    keys = _keys(table)
    flags = [F.col(c).isNull().alias(f"no_{c}") for c in NOT_NULL[table] if c not in keys]
    return key_counts(rows.select(*keys, *flags), [*keys, *[f"no_{c}" for c in NOT_NULL[table] if c not in keys]])


def merged_counts(counts: Sequence[DataFrame]) -> DataFrame:
    """Counts of a table from those of its batches, so that its rows need not be read again."""
    together = reduce(DataFrame.unionByName, counts)
    return together.groupBy(*[c for c in together.columns if c != "n"]).agg(F.sum("n").alias("n"))


def table_checks(counts: dict[str, DataFrame]) -> DataFrame:
    """Violations of every constraint whose tables are given, from their ``table_counts``.

    Counts are stored once: the checks of a table filter and group them in different ways, so without
    that each of them would count the table again.
    """
    stored = {}
    for table, rows in counts.items():
        path = shared_dir(rows.sparkSession, f"counts-{table}")
        rows.write.parquet(path)
        stored[table] = rows.sparkSession.read.schema(rows.schema).parquet(path)
    counts = stored
    found = []
    for table, rows in counts.items():
        keys = _keys(table)
        rules = {f"{table}.{c} not null": F.col(c).isNotNull() if c in keys else ~F.col(f"no_{c}") for c in NOT_NULL[table]}
        if table in MONTHS:
            rules[f"{table}.month range"] = F.col("month").isNull() | F.col("month").between(1, 12)
        found.append(row_checks(rows, rules))
        if table in UNIQUE:
            key = UNIQUE[table]
            per_key = rows.where(_no_null(key)).groupBy(*key).agg(F.sum("n").alias("n"))
            found.append(unique_check(per_key, f"{table} unique"))
    for child, key, parent, parent_key in REFERENCES:
        if child in counts and parent in counts:
            known = counts[parent].where(_no_null(parent_key)).select(*[F.col(p).alias(c) for p, c in zip(parent_key, key)])
            found.append(reference_check(counts[child], known, f"{child}.{'+'.join(key)} exists", list(key)))
    return all_checks(found)
