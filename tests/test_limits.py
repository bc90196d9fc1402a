"""Values beyond the usual widths: nothing is cut or lost without a reason."""

import pytest
from pyspark.sql import functions as F

from kvitok.operators.parse import parse_messages
from kvitok.schemas import MESSAGE
from kvitok.sources.sample import padded

HEAD = "ФЛС № 0000000001 АДРЕС: ул. Мира, д. 1 ПЕРИОД: 3 месяц 2024 год\n"
LARGE = "9" * 20


def test_long_keys_stay_whole(spark):
    rows = spark.createDataFrame([("7",), ("12345678901",), ("12345678902",)], "x string")
    assert [r[0] for r in rows.select(padded(F.col("x"), 10)).collect()] == ["0000000007", "12345678901", "12345678902"]


@pytest.mark.parametrize(
    "body, reason",
    [
        (HEAD + "ХВС КПУ 2,5 100,00\nИтого к оплате: 100,00", None),
        (HEAD + f"ХВС КПУ 2,5 {LARGE}\nИтого к оплате: 100,00", "bad_amount"),
        (HEAD + f"ХВС КПУ 2,5 100,00\nИтого к оплате: {LARGE}", "bad_amount"),
    ],
)
def test_amounts_beyond_the_stored_digits_go_to_quarantine(spark, body, reason):
    part = (0, "text/plain", body, None, None)
    names = {"msg_id": "m", "parts": [part]}
    schema = spark.createDataFrame([], MESSAGE).schema
    row = tuple(names.get(f.name) for f in schema.fields)
    got = parse_messages(spark.createDataFrame([row], schema)).select("reason").collect()
    assert [r.reason for r in got] == [reason]
