"""The mail stream: files in, tables out, in one or many micro-batches."""

import datetime as dt
import os
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from kvitok.api import Billing
from kvitok.operators.parse import parse_messages, stored_bills
from kvitok.operators.upsert import bill_lines, upsert_charges
from kvitok.sources import mail as sources
from kvitok.sources.mime import read_messages
from kvitok.streaming.ingest import ingest_batch, start_ingest
from kvitok.streaming.store import LINE_ARRIVAL, Store
from tests.mails import HEAD, MAIL_SCHEMA, bill, html_mail, mail_rows, message, page, text_mail

D = Decimal


def golden():
    april = HEAD.replace("3 месяц", "4 месяц")
    moved = HEAD.replace("д. 1", "д. 2")
    other = HEAD.replace("ФЛС № 123", "ФЛС № 456")
    return [
        text_mail(bill()),
        text_mail(bill("ХВС 10 300,00\nТКО 1 50\n")),
        html_mail(page([("ХВС КПУ", "1", "10.00"), ("ХВС пр.д.", "2", "5.00")], head=april)),
        text_mail(bill("ТКО 2 77\n", head=moved)),
        text_mail(bill("ТКО 3 30,10\n", head=other)),
        text_mail(bill(head=HEAD.replace("3 месяц", "13 месяц").replace("123", "999"))),
        text_mail("реклама"),
        message(("plain", bill("ТКО 9 999\n")), sender="spam@c.example"),
    ]


RULE = ("a@b.example", "", "")


def ingest(spark, root, contents, files_per_batch=100):
    os.makedirs(f"{root}/mail")
    for i, content in enumerate(contents):
        path = f"{root}/mail/m{i:03d}.eml"
        with open(path, "wb") as file:
            file.write(content)
        moment = dt.datetime(2024, 5, 1, tzinfo=dt.timezone.utc).timestamp() + 60 * i
        os.utime(path, (moment, moment))
    store = Store(spark, f"{root}/store")
    stream = sources.stream_mail_files(spark, f"{root}/mail", files_per_batch)
    start_ingest(store, stream, f"{root}/progress", RULE).awaitTermination()
    return store


def charge_set(frame):
    return {(r.account_number, r.year, r.month, r.service, r.quantity, r.amount_due) for r in frame.collect()}


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    return ingest(spark, str(tmp_path_factory.mktemp("one")), golden())


def test_charges_and_dimensions(store):
    assert charge_set(store.charges()) == {
        ("123", 2024, 3, "ХВС", D(10), D(300)),
        ("123", 2024, 3, "ТКО", D(2), D(77)),
        ("123", 2024, 4, "ХВС", D(2), D(5)),
        ("456", 2024, 3, "ТКО", D(3), D("30.10")),
    }
    accounts = {r.account_number: r.address for r in store.read("accounts").collect()}
    assert accounts == {"123": "ул. Мира, д. 1", "456": "ул. Мира, д. 1", "999": "ул. Мира, д. 1"}
    assert {(r.year, r.month) for r in store.read("periods").collect()} == {(2024, 3), (2024, 4)}
    assert {r.name for r in store.read("services").collect()} == {"ХВС", "ТКО"}


def test_audit_archive_and_quarantine(store):
    audit = store.read("raw_imports").collect()
    assert sorted(r.source_identifier for r in audit) == [f"m{i:03d}.eml" for i in range(5)]
    assert all(r.raw_content == r.source_identifier for r in audit)
    assert {r.msg_id: r.reason for r in store.quarantine().collect()} == {
        "m005.eml": "bad_month",
        "m006.eml": "no_bill",
    }
    raw = {r.msg_id: bytes(r.content) for r in store.archive().collect()}
    assert raw == {f"m{i:03d}.eml": content for i, content in enumerate(golden()[:5])}


def test_reports(store):
    reports = {(r.address, r.account_number, r.month): r.message for r in store.read("reports").collect()}
    assert set(reports) == {
        ("ул. Мира, д. 1", "123", 3),
        ("ул. Мира, д. 1", "123", 4),
        ("ул. Мира, д. 2", "123", 3),
        ("ул. Мира, д. 1", "456", 3),
    }
    # Sums cover both accounts of the address; the moved address has no account.
    assert "Итого: 407.10 руб." in reports["ул. Мира, д. 1", "456", 3]
    assert "данные не найдены" in reports["ул. Мира, д. 2", "123", 3]


def test_many_batches_give_the_same_tables(spark, store, tmp_path):
    other = ingest(spark, str(tmp_path), golden(), files_per_batch=2)
    assert other.read("parsed").select("batch_id").distinct().count() > 2
    assert charge_set(other.charges()) == charge_set(store.charges())
    for table, columns in (
        ("accounts", ("account_id", "account_number", "address")),
        ("periods", ("period_id", "year", "month", "start_date")),
        ("services", ("service_id", "name", "unit")),
        ("raw_imports", ("source_identifier", "account_number")),
    ):
        assert sorted(other.read(table).select(*columns).collect()) == sorted(
            store.read(table).select(*columns).collect()
        )


def test_stream_equals_batch(spark, store):
    mail = spark.createDataFrame(mail_rows(golden()), MAIL_SCHEMA)
    messages = sources.accept(read_messages(mail, rule=RULE), RULE)
    lines = bill_lines(stored_bills(parse_messages(messages)), "received_at", "msg_id")
    assert charge_set(upsert_charges(lines, LINE_ARRIVAL)) == charge_set(store.charges())


def test_a_repeated_batch_changes_nothing_but_a_repeated_mail_is_audited(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    rows = mail_rows(golden())
    mail = spark.createDataFrame(rows, MAIL_SCHEMA)
    ingest_batch(store, mail, 0, RULE)
    before = charge_set(store.charges())
    counts = {t: store.read(t).count() for t in ("raw_imports", "accounts", "periods", "services", "reports")}
    ingest_batch(store, mail, 0, RULE)
    assert charge_set(store.charges()) == before
    assert counts == {t: store.read(t).count() for t in counts}
    again = [(f"again-{name}", when + dt.timedelta(days=1), content) for name, when, content in rows]
    ingest_batch(store, spark.createDataFrame(again, MAIL_SCHEMA), 1, RULE)
    assert charge_set(store.charges()) == before
    assert store.read("raw_imports").count() == 2 * counts["raw_imports"]
    assert store.read("accounts").count() == counts["accounts"]


def test_compaction_keeps_charges(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    rows = mail_rows(golden())
    for batch_id in range(3):
        ingest_batch(store, spark.createDataFrame(rows[batch_id::3], MAIL_SCHEMA), batch_id, RULE)
    before = charge_set(store.charges())
    store.compact(1)
    assert charge_set(store.charges()) == before
    store.compact(2)
    assert charge_set(store.charges()) == before
    assert store.lines().count() == len(before)


def test_late_bill_reports_only_its_month(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    rows = mail_rows(golden())
    ingest_batch(store, spark.createDataFrame(rows[2:3], MAIL_SCHEMA), 0, RULE)
    ingest_batch(store, spark.createDataFrame(rows[:1], MAIL_SCHEMA), 1, RULE)
    reports = store.read("reports").where("batch_id = 1").collect()
    assert [(r.year, r.month) for r in reports] == [(2024, 3)]


def test_landed_mail(spark, tmp_path):
    path = str(tmp_path / "landed")
    mail = spark.createDataFrame(mail_rows(golden()), MAIL_SCHEMA)
    sources.land_mail(mail, path)
    sources.land_mail(mail, path)
    assert sources.read_landed(spark, path).count() == 2 * len(golden())
    name = mail.select(sources.landed_name(F.col("received_at"), F.col("content"))).head()[0]
    assert name.startswith("email_1714521600_") and name.endswith(".eml") and len(name) == 29


def test_questions(spark, store):
    billing = Billing(store)
    home = "ул. Мира, д. 1"
    assert [r.address for r in billing.addresses().collect()] == [home]
    assert [r.account_number for r in billing.accounts(home).collect()] == ["123", "456", "999"]
    assert billing.accounts("").count() == 0 and billing.periods([]).count() == 0
    assert [r.name for r in billing.services().collect()] == ["ТКО", "ХВС"]
    assert [tuple(r) for r in billing.periods(["123"]).collect()] == [(2024, 4), (2024, 3)]
    month = billing.month(home, 2024, 3).collect()
    assert [(r.service, r.amount_due) for r in month] == [("ТКО", D("107.10")), ("ХВС", D(300))]
    assert [r.service for r in billing.previous_month(home, 2024, 4).collect()] == ["ТКО", "ХВС"]
    assert billing.previous_month(home, 2024, 3).count() == 0
    assert [(r.month, r.service) for r in billing.last_12_months(home, 2024, 4).collect()] == [
        (4, "ХВС"),
        (3, "ТКО"),
        (3, "ХВС"),
    ]
    payload = billing.chart_payload(["123"], (2024, 1), (2024, 12)).head()["payload"]
    assert '"months":["2024-03","2024-04"],"totals":[377.0,5.0]' in payload
    assert [(r.year, r.month) for r in billing.queue().collect()] == [(2024, 4), (2024, 3)]
    assert len(billing.prompts(1).collect()) == 1
    with pytest.raises(ValueError):
        billing.analysis("", 2024, 3)
    answer = [(home, 2024, 4, "p", "r", "m", 5, dt.datetime(2024, 6, 1))]
    columns = (
        "address string, year int, month int, prompt string, response string, model string, "
        "tokens_used int, created_at timestamp"
    )
    store.save_analyses(100, spark.createDataFrame(answer, columns))
    assert [(r.year, r.month) for r in billing.queue().collect()] == [(2024, 3)]
    assert billing.analysis(home, 2024, 4).head()["response"] == "r"
