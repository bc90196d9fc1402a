"""Checks of constraints count a table once."""

from pyspark.sql import functions as F

from kvitok.operators import checks


def test_checks_count_each_table_once(spark):
    """The checks of a table read stored counts, so rows are counted once, however many checks there are."""
    counted = spark.sparkContext.accumulator(0)

    def passed(batches):
        for batch in batches:
            counted.add(batch.num_rows)
            yield batch

    rows = spark.range(10).select(
        F.lit("a").alias("account_number"), F.lit(2024).alias("year"), F.col("id").cast("int").alias("month"), F.lit("ТКО").alias("service")
    )
    charges = checks.table_counts("charges", rows.mapInArrow(passed, rows.schema))
    parents = {
        "accounts": rows.select("account_number", F.lit("x").alias("address")).distinct(),
        "periods": rows.select("year", "month", F.lit(None).cast("date").alias("start_date")).where("month > 2"),
    }
    found = checks.table_checks({"charges": charges, **{n: checks.table_counts(n, r) for n, r in parents.items()}})
    got = {r.rule: r.violations for r in found.collect()}
    assert got["charges.year+month exists"] == 3 and got["charges.account_number exists"] == 0
    assert got["periods.start_date not null"] == 7
    assert counted.value == 10
