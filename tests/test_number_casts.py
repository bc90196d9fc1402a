"""Tokens that are no numbers are known by their form and not cast."""

from pyspark.sql import functions as F

from kvitok.functions.numbers import to_double

TOKENS = ["", ".", ",", "..", "1", "1.", ".5", ",5", "1,5", "1.2.3", "1,2,3", ".1.", "..1", "007", "1" * 400, " 2 ", " . ", "\n", ".\n", "1e3", "-4", "x", "1f", "NaN", "Infinity", None]


def test_casts_are_those_of_all_tokens(spark):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(TOKENS)], "i int, t string").repartition(2)
    plain = F.replace("t", F.lit(","), F.lit(".")).try_cast("double")
    got = rows.select(to_double(F.col("t")).alias("a"), plain.alias("b"))
    assert got.where("NOT (a <=> b)").isEmpty() and got.where("a IS NOT NULL").count() > 8
    assert "RLIKE" in got._jdf.queryExecution().analyzed().toString().upper()
