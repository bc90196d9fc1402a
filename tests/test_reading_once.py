"""Steps of a message that are done once, and patterns that look for the first letter before they fold case."""

import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kvitok.operators import parse
from kvitok.sources import mime

FOLDED = [*parse.ACCOUNT[1:], parse.ADDRESS, parse.PERIOD, parse.TOTAL, parse.APARTMENT, parse.RESIDENTS, parse.PAID_ON]


def test_first_letters_are_all_that_folding_would_find(spark):
    heads = [re.match(r"\[(.)([^\]]+)\]\(\?iu\)", pattern) for pattern in FOLDED]
    letters = spark.range(0x110000).where("id NOT BETWEEN 55296 AND 57343").select(
        F.decode(F.unhex(F.lpad(F.hex("id"), 8, "0")), "UTF-32").alias("c")
    )
    for head in {h[0]: h for h in heads}.values():
        folded = F.rlike(F.concat("c", F.lit("1")), F.lit(f"(?iu)^{head[1]}1$"))
        listed = F.rlike("c", F.lit(f"^{head[0].removesuffix('(?iu)')}$"))
        assert letters.where(folded).count() >= 2 and letters.where(folded != listed).isEmpty()


def test_candidates_behind_the_one_that_decides_are_not_read(spark):
    bill = "ФЛС № 1 АДРЕС: Дом ПЕРИОД: 3 месяц 2024 год"
    part = "struct<part_idx:int,content_type:string,body:string,visible:string,rows:array<struct<cells:array<string>,tables:array<int>>>>"
    rows = spark.createDataFrame(
        [("a", None, [(0, "text/plain", "нет", None, None), (1, "text/plain", bill, None, None), (2, "text/plain", bill + " Итого к оплате: 1.2.3", None, None)]),
         ("b", None, [(0, "text/plain", bill + " Итого к оплате: 1.2.3", None, None), (1, "text/plain", bill, None, None)]), ("c", None, []), ("d", "x", None)],
        f"msg_id string, problem string, parts array<{part}>",
    )
    parsed = parse.parse_messages(rows)
    assert [tuple(r) for r in parsed.orderBy("msg_id").select("msg_id", "bill.part_idx", "reason").collect()] == [
        ("a", 1, None), ("b", None, "bad_total"), ("c", None, "no_bill"), ("d", None, "unreadable"),
    ]
    # Parts are folded one after the other, so a decided message reads no further one.
    assert "aggregate(" in parsed._jdf.queryExecution().analyzed().toString()


@pytest.mark.parametrize("read", [[], [[]], [[], [{"part_idx": 0, "content_type": "text/plain", "body": "x", "visible": None, "rows": None}], [
    {"part_idx": 0, "content_type": "text/html", "body": "y", "visible": "y", "rows": [{"cells": [], "tables": []}, {"cells": ["1", ""], "tables": [0, 2]}]},
    {"part_idx": 3, "content_type": "text/html", "body": "", "visible": "", "rows": []},
], []]])
def test_parts_by_column_are_the_nested_ones(read):
    kind = mime._arrow_schema().field("parts").type
    assert mime._part_column(read).to_pylist() == pa.array(read, kind).to_pylist()
    assert mime._part_column(read).type == kind
