"""Messages with the bill or the reason each must give."""

from decimal import Decimal

import pytest

from kvitok.operators.parse import parse_messages
from kvitok.sources.mail import accept
from kvitok.sources.mime import read_messages
from tests.mails import HEAD, MAIL_SCHEMA, bill, html_mail, mail_rows, message, page, text_mail

D = Decimal


def parse(spark, *contents):
    mail = spark.createDataFrame(mail_rows(list(contents)), MAIL_SCHEMA)
    rows = parse_messages(read_messages(mail)).orderBy("msg_id").collect()
    return rows[0] if len(rows) == 1 else rows


def services(row):
    return [(s.name, s.quantity, s.amount_due) for s in row.bill.services]


def test_text_bill(spark):
    row = parse(
        spark,
        text_mail(
            bill(
                "ХВС 5 м3 45,00 225,00\nОтопление 0,5 1000\nнет чисел ТКО\nТКО 1\n"
                "Запирающее устр. 1,5 2.50\n",
                tail="Итого к оплате: 1227,50\nТип кв.: отдельная, К-во комнат: 2 Площадь общая: 54.3, "
                "жилая: 32.1 м\nК-во проживающих: 3\nДата последней оплаты: 10.02.2024",
            )
        ),
    )
    b = row.bill
    assert row.reason is None and b.kind == "text"
    assert (b.account_number, b.address, b.year, b.month) == ("123", "ул. Мира, д. 1", 2024, 3)
    assert (b.total_due, b.apartment_type, b.rooms) == (D("1227.50"), "отдельная", 2)
    assert (b.total_area, b.living_area, b.residents) == (54.3, 32.1, 3)
    assert b.last_payment_date == "10.02.2024"
    assert services(row) == [
        ("ХВС КПУ", D("45.000"), D("225.00")),
        ("Отопление", D("0.500"), D("1000.00")),
        ("Запирающее устройство", D("1.500"), D("2.50")),
    ]


def test_html_rows(spark):
    row = parse(
        spark,
        html_mail(
            page(
                [
                    ("Услуга", "Объем", "Сумма"),
                    ("ХВС КПУ", "3,5 м3", "-100,00"),
                    ("Кап. ремонт", "1", "2"),
                    ("кап. ремонт", "44", "1 234,56"),
                    ("ТКО", "нет", "5"),
                    ("ТКО", "1.2.3", "5"),
                ]
            )
        ),
    )
    assert row.bill.kind == "html"
    assert services(row) == [("ХВС КПУ", D("3.500"), D("100.00")), ("кап. ремонт", D("44.000"), D("1.00"))]


def test_html_before_text_and_fallback(spark):
    good, bad = page([("ХВС КПУ", "1", "10")]), page([("нет", "1", "10")])
    rows = parse(
        spark,
        message(("plain", bill()), ("html", good)),
        message(("html", bad), ("plain", bill())),
        message(("html", bad), ("html", good), ("plain", bill())),
    )
    assert [(r.bill.kind, r.bill.part_idx) for r in rows] == [("html", 2), ("text", 2), ("html", 2)]


def test_text_bill_needs_no_services(spark):
    row = parse(spark, text_mail(HEAD + "всё оплачено"))
    assert row.reason is None and row.bill.services == []


@pytest.mark.parametrize(
    "content, reason",
    [
        (text_mail(bill(tail="Итого к оплате: 1,234.56")), "bad_total"),
        (
            text_mail(
                bill(tail="Тип кв.: отд., К-во комнат: 1 Площадь общая: 40.1, жилая: 32.1. Конец")
            ),
            "bad_area",
        ),
        (text_mail(bill(head=HEAD.replace("3 месяц", "13 месяц"))), "bad_month"),
        (text_mail(bill(head=HEAD.replace("3 месяц", "0 месяц"))), "no_bill"),
        (text_mail(bill(head=HEAD.replace("2024 год", "0000 год"))), "no_bill"),
        (text_mail("привет"), "no_bill"),
        (html_mail(page([("нет", "1", "2")])), "no_bill"),
        # A broken total stops the message even if a later part is a good bill.
        (message(("html", page([], tail="Итого к оплате: 1.2.3")), ("plain", bill())), "bad_total"),
    ],
)
def test_quarantine(spark, content, reason):
    row = parse(spark, content)
    assert row.reason == reason
    assert (row.bill is not None) == (reason == "bad_month")


def test_area_with_comma_gives_no_apartment(spark):
    row = parse(spark, text_mail(bill(tail="Тип кв.: отд., К-во комнат: 1 Площадь общая: 54,3, жилая: 32,1")))
    assert row.reason is None
    assert (row.bill.apartment_type, row.bill.rooms, row.bill.total_area) == (None, None, None)


def test_address_at_end_is_not_found(spark):
    row = parse(spark, text_mail("ПЕРИОД 3 месяц 2024 год код плательщика 77 АДРЕС: ул. Мира, д. 1"))
    assert (row.bill.account_number, row.bill.address) == ("77", None)


def test_account_and_period_forms(spark):
    rows = parse(
        spark,
        text_mail("ФАС 9 КОД ПЛАТЕЛЬЩИКА: 8 на 2023-11-30"),
        text_mail("КОД ПЛАТЕЛЬЩИКА: 8 плательщик № 7 период 4 МЕСЯЦ 2022 ГОД"),
        text_mail("плательщик № 7 На 2023-11-30 на 2021-02-01"),
    )
    assert [(r.bill.account_number, r.bill.year, r.bill.month) for r in rows] == [
        ("9", 2023, 11),
        ("8", 2022, 4),
        ("7", 2021, 2),
    ]


def test_first_of_equal_tables_and_largest_table(spark):
    def table(*rows):
        return "<table>" + "".join(f"<tr><td>{n}</td><td>1</td><td>{a}</td></tr>" for n, a in rows) + "</table>"

    equal = f"<p>{HEAD}</p>" + table(("ХВС", 1)) + table(("ГВС", 2))
    larger = f"<p>{HEAD}</p>" + table(("ХВС", 1)) + table(("ГВС", 2), ("ТКО", 3))
    rows = parse(spark, html_mail(equal), html_mail(larger))
    assert [[s.name for s in r.bill.services] for r in rows] == [["ХВС"], ["ГВС", "ТКО"]]


def test_nested_table_rows_count_for_the_outer_table(spark):
    inner = "<table><tr><td>ХВС&nbsp;КПУ</td><td>1</td><td>10</td></tr></table>"
    outer = f"<p>{HEAD}</p><table><tr><td>{inner}</td></tr><tr><td>ТКО</td><td>2</td><td>20</td></tr></table>"
    row = parse(spark, html_mail(outer))
    assert services(row) == [("ХВС КПУ", D("1.000"), D("10.00")), ("ТКО", D("2.000"), D("20.00"))]


def test_charsets(spark):
    body = bill()
    head = b"From: a\r\nTo: b\r\nSubject: c\r\nContent-Type: text/plain; charset=%s\r\n"
    head += b"Content-Transfer-Encoding: 8bit\r\n\r\n"
    rows = parse(
        spark,
        head % b"windows-1251" + body.encode("cp1251"),
        head % b"nobody-knows" + body.encode(),
        head % b"utf-8" + body.encode() + b" \xff",
        text_mail(body.replace(" ", " ")),
    )
    assert [r.bill.address for r in rows] == ["ул. Мира, д. 1"] * 4
    assert all(len(r.bill.services) == 1 for r in rows)


def test_triage_is_case_sensitive_and_decodes_headers(spark):
    contents = [
        message(("plain", "x"), subject="Единый платежный документ за март"),
        message(("plain", "x"), subject="единый платежный документ"),
        message(("plain", "x"), subject="Единый платежный документ", sender="other@c.example"),
        b"Content-Type: text/plain\r\n\r\nno headers",
        b"",
    ]
    mail = spark.createDataFrame(mail_rows(contents), MAIL_SCHEMA)
    messages = read_messages(mail)
    assert messages.count() == 4
    kept = accept(messages, ("a@b.example", "me@", "Единый платежный документ"))
    assert [r.msg_id for r in kept.collect()] == ["m000.eml"]


@pytest.mark.parametrize("end", ["\n", "\r\n", "\r"])
def test_headers_end_at_the_first_empty_line(end):
    from kvitok.sources.mime import read_message

    content = end.join(["From: a@b", "To: c@d", "Subject: x", "", "Subject: y", "", "body"]).encode()
    read = read_message(content)
    assert (read["h_from"], read["h_to"], read["h_subject"], read["problem"]) == ("a@b", "c@d", "x", None)
    assert [p["body"].split() for p in read["parts"]] == [["Subject:", "y", "body"]]
    assert read_message(content, ("z", "", ""))["parts"] == []
