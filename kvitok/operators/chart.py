"""Month by service matrices with zeros where nothing was charged."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kvitok.functions.tariff import chart_tariff
from kvitok.functions.text import month_label
from kvitok.operators.aggregates import in_range, month_services


def _labels(periods: DataFrame) -> Column:
    """All month labels as one sorted array: a scalar subquery as long as the periods table."""
    label = month_label(F.col("year"), F.col("month"))
    return periods.agg(F.array_sort(F.collect_set(label))).scalar()


def chart_long(
    charges: DataFrame,
    periods: DataFrame,
    start: tuple[int, int],
    end: tuple[int, int],
    services: list[str] | None = None,
    key: str = "address",
) -> DataFrame:
    """One row per key, service and month in range; months come from the periods table.

    A key's services are folded to a map by month, then read out along the month
    labels. This fills the gaps without joining months, services and keys.
    """
    if not start or not end:
        raise ValueError("a chart needs a first and a last month")
    kept = charges.where(in_range(start, end))
    if services:
        kept = kept.where(F.col("service").isin(list(services)))
    sums = month_services(kept, (key,)).withColumn("label", month_label(F.col("year"), F.col("month")))
    cell = F.struct(F.col("amount_due").alias("amount"), F.col("quantity").alias("quantity"))
    folded = sums.groupBy(key, "service").agg(
        F.map_from_entries(F.collect_list(F.struct(F.col("label"), cell.alias("cell")))).alias("cells")
    )
    found = folded.withColumn("label", F.explode(_labels(periods.where(in_range(start, end)))))
    value = found.withColumn("cell", F.try_element_at("cells", F.col("label")))
    amount = F.coalesce("cell.amount", F.lit(0))
    quantity = F.coalesce("cell.quantity", F.lit(0))
    return value.select(
        key,
        "label",
        "service",
        amount.alias("amount"),
        quantity.alias("quantity"),
        chart_tariff(amount, quantity).alias("tariff"),
    )


def chart_totals(long: DataFrame, key: str = "address") -> DataFrame:
    return long.groupBy(key, "label").agg(F.sum("amount").alias("total"))


def chart_series(long: DataFrame, key: str = "address") -> DataFrame:
    """Parallel arrays per service, in month order. A group is as long as the periods table."""
    point = F.struct("label", "amount", "quantity", "tariff")
    series = long.groupBy(key, "service").agg(F.array_sort(F.collect_list(point)).alias("points"))
    return series.select(
        key,
        "service",
        F.col("points.label").alias("months"),
        F.col("points.amount").cast("array<double>").alias("amounts"),
        F.col("points.quantity").cast("array<double>").alias("quantities"),
        F.col("points.tariff").alias("tariffs"),
    )


def chart_payload(long: DataFrame, keys: DataFrame, periods: DataFrame, key: str = "address") -> DataFrame:
    """The whole chart of a key as one JSON text; keys without charges get zero totals."""
    series = chart_series(long, key)
    by_service = series.groupBy(key).agg(
        F.array_sort(
            F.collect_list(
                F.struct("service", F.struct("amounts", "quantities", "tariffs").alias("values"))
            )
        ).alias("s")
    )
    totals = chart_totals(long, key).groupBy(key).agg(
        F.array_sort(F.collect_list(F.struct("label", "total"))).alias("t")
    )
    months = _labels(periods)
    empty = F.array_repeat(F.lit(0.0), F.size(months))
    names = F.coalesce(F.col("s.service"), F.array().cast("array<string>"))
    values = F.map_from_entries(F.col("s"))
    payload = F.struct(
        months.alias("months"),
        F.coalesce(F.col("t.total").cast("array<double>"), empty).alias("totals"),
        F.coalesce(
            values,
            F.create_map().cast(
                "map<string,struct<amounts:array<double>,quantities:array<double>,tariffs:array<double>>>"
            ),
        ).alias("services"),
        names.alias("service_names"),
    )
    joined = keys.select(key).distinct().join(by_service, key, "left").join(totals, key, "left")
    return joined.select(key, F.to_json(payload).alias("payload"))


_PAYLOAD = (
    "struct<months:array<string>,totals:array<double>,"
    "services:map<string,struct<amounts:array<double>,quantities:array<double>,tariffs:array<double>>>,service_names:array<string>>"
)


def payload_rows(payloads: DataFrame, key: str = "address") -> DataFrame:
    """What a consumer reads from payloads: a row per service and month, services numbered in their order."""
    read = payloads.select(key, F.from_json("payload", _PAYLOAD).alias("p"))
    named = read.select(key, "p", F.posexplode("p.service_names").alias("service_no", "service"))
    values = named.withColumn("s", F.try_element_at("p.services", F.col("service")))
    points = F.arrays_zip(
        F.col("p.months").alias("label"),
        F.col("p.totals").alias("total"),
        F.col("s.amounts").alias("amount"),
        F.col("s.quantities").alias("quantity"),
        F.col("s.tariffs").alias("tariff"),
    )
    return values.select(key, "service_no", "service", F.inline(points))
