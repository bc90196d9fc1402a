"""Patterns that stand in for others are tried only where these find nothing."""

from pyspark.sql import functions as F

from kvitok.operators.parse import bill_matches, parse_texts

TEXTS = [
    "ФЛС № 1 код плательщика: 2 Плательщик № 3 ПЕРИОД: 3 месяц 2024 год на 2020-11-05 К-во проживающих: 4 проживающих: 5",
    "код плательщика: 2 Плательщик № 3 на 2020-11-05 ПРОЖИВАЮЩИХ: 5 К-во проживающих: 4",
    "Плательщик № 3 К-во проживающих: x",
    "ничего",
    None,
]


def test_first_pattern_found_decides(spark):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i int, body string")
    got = parse_texts(rows).orderBy("i").select("account_number", "year", "month", "residents").collect()
    assert [tuple(r) for r in got] == [("1", 2024, 3, 4), ("2", 2020, 11, 5), ("3", None, None, None), (None,) * 4, (None,) * 4]


def test_one_match_for_each_question(spark):
    names = spark.range(1).select(bill_matches(F.lit("x")).alias("f")).schema["f"].dataType.names
    assert names == ["account", "dated", "address", "total", "apartment", "residents", "paid_on"]
