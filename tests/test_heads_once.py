"""Heads that repeat are read once, and pieces and numbers of a bill are computed once."""

import pyarrow as pa
from pyspark.sql import functions as F

from kvitok.operators import parse
from kvitok.sources import mime
from tests.mails import bill, message, page


def _batch(contents):
    rows = {"msg_id": [str(k) for k in range(len(contents))], "received_at": pa.array([0] * len(contents), pa.timestamp("us", tz="UTC"))}
    return pa.RecordBatch.from_pydict({**rows, "content": contents})


def test_heads_that_repeat_are_read_once(monkeypatch):
    read, plain = [], mime._fields
    monkeypatch.setattr(mime, "_fields", lambda head: read.append(head) or plain(head))
    long = b"X-Way: " + b"x" * mime.SHORT_HEAD + b"\r\n"
    mails = [message(("plain", bill()), ("html", page([])))] * 600 + [long + b"Subject: z\r\n\r\nbody"] * 2
    batches = list(mime._read_batches(iter([_batch(mails)]), False, ("", "", ""), True))
    short = [head for head in read if len(head) <= mime.SHORT_HEAD]
    assert len(short) == len(set(short)) == 3 and len(read) == len(short) + 2
    found = [row for batch in batches for row in batch.to_pylist()]
    monkeypatch.undo()
    for row, content in zip(found, mails, strict=True):
        alone = mime.read_message(content)
        assert [row[k] for k in ("h_from", "h_to", "h_subject")] == [alone[k] for k in ("h_from", "h_to", "h_subject")]
        assert [p["body"] for p in row["parts"]] == [p["body"] for p in alone["parts"]]


def test_lone_surrogates_are_replaced_and_other_text_is_kept():
    assert mime._storable("ё\ud800x") == "ё?x"
    assert mime._storable("ёx") == "ёx"


def test_pieces_and_numbers_of_a_bill_are_computed_once(spark):
    text = (
        "ФЛС № 1 АДРЕС:  Дом, кв. 1  ПЕРИОД: 3 месяц 2024 год Итого к оплате: 1,5 Тип кв.: отдельная, К-во комнат: 2 "
        "Площадь общая: 40.5, жилая: 20.1 К-во проживающих: 3 Дата последней оплаты: 01.02.2024"
    )
    parsed = parse.parse_texts(spark.range(1).select(F.lit(text).alias("body")))
    plan = parsed._jdf.queryExecution().analyzed().toString()
    # One search of the text and one for each group.
    assert plan.count("К-во комнат:") - plan.count("кв. 1  ПЕРИОД") <= 5
    row = parsed.drop("body").first().asDict()
    assert (row["address"], row["apartment_type"], row["rooms"]) == ("Дом, кв. 1", "отдельная", 2)
    assert (row["total_area"], row["living_area"], row["residents"], row["defect"]) == (40.5, 20.1, 3, None)
