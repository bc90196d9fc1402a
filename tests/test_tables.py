"""Upserts, sums, history, charts and checks against small tables and plain Python."""

import itertools
import json
import random
from collections import defaultdict
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from kvitok import schemas
from kvitok.operators import aggregates, analysis, chart, checks, history, messages, upsert

D = Decimal
LINE = (
    "account_number string, year int, month int, raw_service string, "
    "quantity decimal(18,3), amount_due decimal(18,2), seq long"
)


def lines(spark, rows):
    return spark.createDataFrame(
        [(a, y, m, s, D(str(q)), D(str(v)), i) for i, (a, y, m, s, q, v) in enumerate(rows)], LINE
    )


def random_rows(seed=7, n=3000):
    """Accounts with gaps between their months; the first one has a third of all rows."""
    r = random.Random(seed)
    names = ["ХВС КПУ", "ХВС пр.д.", "ГВС", "ТКО", "Домофон"]
    rows = []
    for _ in range(n):
        account = "a0" if r.random() < 0.34 else f"a{r.randrange(1, 12)}"
        month = r.choice([1, 2, 3, 5, 8, 9, 12])
        rows.append(
            (account, r.randrange(2018, 2024), month, r.choice(names), r.randrange(0, 9), r.randrange(100))
        )
    return rows


ADDRESS = {f"a{i}": ("big" if i < 3 else f"home {i % 4}") for i in range(12)}


def accounts(spark):
    return spark.createDataFrame(list(ADDRESS.items()), "account_number string, address string")


CANONICAL = {"ХВС КПУ": "ХВС", "ХВС пр.д.": "ХВС"}


def expected_charges(rows):
    found = {}
    for a, y, m, s, q, v in rows:
        found[a, y, m, CANONICAL.get(s, s)] = (D(q), D(v))
    return found


def expected_months(rows):
    sums = defaultdict(lambda: [D(0), D(0)])
    for (a, y, m, s), (q, v) in expected_charges(rows).items():
        cell = sums[ADDRESS[a], y, m, s]
        cell[0] += q
        cell[1] += v
    return {k: tuple(v) for k, v in sums.items()}


@pytest.fixture(scope="module")
def rows():
    return random_rows()


@pytest.fixture(scope="module")
def months(spark, rows):
    charges = upsert.upsert_charges(lines(spark, rows), ("seq",))
    frame = aggregates.month_services(aggregates.at_addresses(charges, accounts(spark)))
    return frame.cache()


def test_last_line_wins_in_any_partitioning(spark, rows):
    expected = expected_charges(rows)
    for shuffled in (lines(spark, rows), lines(spark, rows).orderBy(F.rand(3)).repartition(7)):
        got = upsert.upsert_charges(shuffled, ("seq",)).collect()
        assert {(r.account_number, r.year, r.month, r.service): (r.quantity, r.amount_due) for r in got} == expected
        assert len(got) == len(expected)
        assert all(r.tariff == 0 and r.accrued_by_tariff == 0 for r in got)


def test_period_info_replaces_the_whole_row(spark):
    schema = (
        "account_number string, year int, month int, total_area double, living_area double, rooms int, "
        "residents int, last_payment_date string, seq int"
    )
    bills = spark.createDataFrame(
        [
            ("a", 2024, 1, 50.0, 30.0, 2, 3, None, 1),
            ("a", 2024, 1, None, None, None, None, "01.02.2024", 2),
            ("a", 2024, 1, None, None, None, None, None, 3),
            ("b", 2024, 1, None, None, None, None, None, 1),
        ],
        schema,
    )
    (row,) = upsert.upsert_period_info(bills, ("seq",)).collect()
    assert (row.account_number, row.total_area, row.residents, row.last_payment_date) == ("a", None, None, "01.02.2024")


def test_first_address_of_an_account_stays(spark):
    bills = spark.createDataFrame(
        [("a", None, 1), ("a", "x", 2), ("b", "y", 1), ("b", "z", 2)],
        "account_number string, address string, seq int",
    )
    got = {r.account_number: r.address for r in upsert.account_rows(bills, ("seq",)).collect()}
    assert got == {"a": "", "b": "y"}


def test_replace_and_missing_rows(spark):
    old = spark.createDataFrame([("a", 1, 1), ("b", 2, 1)], "k string, v int, seq int")
    new = spark.createDataFrame([("b", 9, 2), ("c", 3, 2)], "k string, v int, seq int")
    got = upsert.replace_rows(old, new, ["k"], ["seq"])
    assert {(r.k, r.v) for r in got.collect()} == {("a", 1), ("b", 9), ("c", 3)}
    assert [r.k for r in upsert.missing_rows(new, old, ["k"]).collect()] == ["c"]


def test_sums_over_accounts(months, rows):
    got = {(r.address, r.year, r.month, r.service): (r.quantity, r.amount_due) for r in months.collect()}
    assert got == expected_months(rows)


def periods_by_address(rows):
    found = defaultdict(set)
    for address, y, m, _ in expected_months(rows):
        found[address].add((y, m))
    return {a: sorted(p) for a, p in found.items()}


def test_previous_period_skips_gaps(months, rows):
    got = {
        (r.address, r.year, r.month): (r.prev_year, r.prev_month)
        for r in history.previous_periods(aggregates.charged_periods(months, ("address",))).collect()
    }
    expected = {}
    for address, periods in periods_by_address(rows).items():
        for before, now in zip([(None, None), *periods], periods):
            expected[(address, *now)] = before
    assert got == expected


def test_month_over_month(months, rows):
    sums, expected = expected_months(rows), {}
    for address, periods in periods_by_address(rows).items():
        for before, now in zip([None, *periods], periods):
            for service in {s for a, y, m, s in sums if a == address and (y, m) in (before, now)}:
                amount = sums.get((address, *now, service), (None, None))[1]
                previous = sums.get((address, *before, service), (None, None))[1] if before else None
                expected[(address, *now, service)] = (before or (None, None), amount, previous)
    got = {
        (r.address, r.year, r.month, r.service): ((r.prev_year, r.prev_month), r.amount, r.prev_amount)
        for r in history.month_over_month(months).collect()
    }
    assert got == expected


def test_trailing_months(months, rows):
    sums, expected = expected_months(rows), set()
    for address, periods in periods_by_address(rows).items():
        for i, now in enumerate(periods):
            for past in periods[max(0, i - 11) : i + 1]:
                for (a, y, m, s), (_, amount) in sums.items():
                    if a == address and (y, m) == past:
                        expected.add((address, *now, *past, s, amount))
    got = [tuple(r) for r in history.trailing_months(months).collect()]
    assert set(got) == expected and len(got) == len(expected)


def test_chart_keeps_empty_months_of_the_periods_table(spark, rows):
    charges = aggregates.at_addresses(
        upsert.upsert_charges(lines(spark, rows), ("seq",)), accounts(spark)
    )
    periods = spark.createDataFrame(
        [(2020, 4), (2020, 5), (2019, 12), (2022, 1)], "year int, month int"
    )
    long = chart.chart_long(charges, periods, (2020, 1), (2021, 12))
    got = long.collect()
    assert {r.label for r in got} == {"2020-04", "2020-05"}
    assert all(r.amount == 0 and r.tariff == 0 for r in got if r.label == "2020-04")
    only = chart.chart_long(charges, periods, (2020, 1), (2021, 12), ["ТКО"])
    assert {r.service for r in only.collect()} == {"ТКО"}
    with pytest.raises(ValueError):
        chart.chart_long(charges, periods, None, (2021, 12))


def test_chart_payload(spark):
    charges = lines(
        spark, [("a", 2024, 1, "ТКО", 2, 10), ("a", 2024, 3, "ТКО", 0, 5), ("a", 2024, 3, "ХВС", -2, 4)]
    )
    charges = upsert.upsert_charges(charges, ("seq",)).withColumn("address", F.lit("x"))
    periods = spark.createDataFrame([(2024, 1), (2024, 2), (2024, 3)], "year int, month int")
    keys = spark.createDataFrame([("x",), ("empty",)], "address string")
    long = chart.chart_long(charges, periods, (2024, 1), (2024, 12))
    got = {r.address: json.loads(r.payload) for r in chart.chart_payload(long, keys, periods).collect()}
    labels = ["2024-01", "2024-02", "2024-03"]
    assert got["x"] == {
        "months": labels,
        "totals": [10.0, 0.0, 9.0],
        "services": {
            "ТКО": {"amounts": [10.0, 0.0, 5.0], "quantities": [2.0, 0.0, 0.0], "tariffs": [5.0, 0.0, 0.0]},
            "ХВС": {"amounts": [0.0, 0.0, 4.0], "quantities": [0.0, 0.0, -2.0], "tariffs": [0.0, 0.0, -2.0]},
        },
        "service_names": ["ТКО", "ХВС"],
    }
    assert got["empty"] == {"months": labels, "totals": [0.0] * 3, "services": {}, "service_names": []}


def test_queue_equals_the_pairing_of_accounts_and_periods(spark, months, rows):
    analyses = spark.createDataFrame(
        [("big", 2018, 1), ("home 1", 2020, 5), ("nowhere", 2020, 5)], "address string, year int, month int"
    )
    charged = aggregates.charged_periods(months, ("address",))
    queue = [tuple(r) for r in analysis.queue_order(analysis.missing_analysis(charged, analyses)).collect()]
    done = {tuple(r) for r in analyses.collect()}
    have = {(a, y, m) for a, y, m, _ in expected_months(rows)}
    every = {(y, m) for _, y, m in have}
    paired = {
        (a, y, m) for a, (y, m) in itertools.product(set(ADDRESS.values()), every)
        if (a, y, m) in have and (a, y, m) not in done
    }
    assert queue == sorted(paired, key=lambda x: (-x[1], -x[2], x[0]))
    top = analysis.queue_order(analysis.missing_analysis(charged, analyses), 5).collect()
    assert [tuple(r) for r in top] == queue[:5]


def test_listing_trims_but_lookup_does_not(spark):
    table = spark.createDataFrame([("1", " x "), ("2", "x"), ("3", " ")], "account_number string, address string")
    assert [r.address for r in aggregates.listed_addresses(table).collect()] == ["x"]
    assert [r.account_number for r in aggregates.accounts_by_address(table, "x").collect()] == ["2"]


def test_account_lists(spark, rows):
    charges = upsert.upsert_charges(lines(spark, rows), ("seq",))
    listed = aggregates.of_accounts(charges, ["a1", "a2"])
    joined = aggregates.of_accounts(charges, accounts(spark).where("account_number IN ('a1', 'a2')"))
    assert sorted(map(str, listed.collect())) == sorted(map(str, joined.select(listed.columns).collect()))
    with pytest.raises(ValueError):
        aggregates.of_accounts(charges, [])


def test_checks(spark):
    parent = spark.createDataFrame([(1,), (2,)], "k int")
    child = spark.createDataFrame([(1, 1), (1, 1), (3, 13), (None, 2)], "k int, month int")
    counts = checks.key_counts(child, ["k", "month"])
    found = checks.all_checks(
        [
            checks.row_checks(
                counts, {"k": F.col("k").isNotNull(), "month": F.col("month").between(1, 12)}
            ),
            checks.unique_check(counts, "unique"),
            checks.reference_check(counts, parent, "parent", ["k"]),
        ]
    )
    assert {r.rule: r.violations for r in found.collect()} == {"k": 1, "month": 1, "unique": 1, "parent": 1}


def test_prompt_and_report(spark):
    schema = "address string, year int, month int, service string, quantity decimal(28,3), amount_due decimal(28,2)"
    rows = [("x", 2024, 1, "ТКО", D(2), D(10)), ("x", 2024, 3, "ХВС", D(0), D("1234.5")), ("x", 2024, 3, "ТКО", D(3), D(9))]
    months = spark.createDataFrame(rows, schema)
    texts = {r.month: r.prompt for r in messages.prompts(months).collect()}
    assert "Данные за предыдущий месяц отсутствуют.\n\nДинамика" in texts[1]
    march = texts[3]
    assert march.startswith("Ты аналитик ЖКХ. Проведи анализ ЕПД для адреса: x за период 2024-03.\n\n")
    assert (
        "- Итого к оплате: 1243.50 руб.\n- Структура услуг:\n"
        "  * ТКО: количество 3.000, средний тариф 3.00 руб., сумма 9.00 руб.\n"
        "  * ХВС: количество 0.000, средний тариф 0.00 руб., сумма 1234.50 руб.\n\n"
        "Данные за предыдущий месяц 2024-01:\n- Итого к оплате: 10.00 руб.\n"
    ) in march
    assert (
        "(доступно 2 месяцев):\n  2024-01:\n    ТКО: 10.00 руб.\n  2024-03:\n    ТКО: 9.00 руб.\n"
        "    ХВС: 1234.50 руб.\n\nТребуется:"
    ) in march
    done = spark.createDataFrame([("x", 2024, 1), ("y", 2024, 1)], "address string, year int, month int")
    assert [r.month for r in messages.prompts(months, done).collect()] == [3]

    services = spark.createDataFrame([("ТКО", "ед."), ("ХВС", None)], "name string, unit string")
    bills = spark.createDataFrame(
        [("x", "1", 2024, 3), ("y<", "2", 2024, 3), (None, "3", 2024, 3)],
        "address string, account_number string, year int, month int",
    )
    answers = spark.createDataFrame(
        [("x", 2024, 3, "**да** & нет")], "address string, year int, month int, response string"
    )
    got = {
        r.account_number: r.message
        for r in messages.reports(bills, aggregates.month_breakdown(months, services), answers).collect()
    }
    assert set(got) == {"1", "2"}
    assert got["1"] == (
        "<b>Анализ ЕПД</b>\n🏠 <b>Адрес:</b> x\n🆔 <b>Лицевой счет:</b> 1\n📅 <b>Период:</b> 2024-03\n\n"
        "💰 <b>Итого: 1,243.50 руб.</b>, в т.ч.:\n🔹 <b>ХВС:</b> 1,234.50 руб. <i>0,000 ед,</i>\n"
        "🔹 <b>ТКО:</b> 9.00 руб. <i>3,000 ед,</i>\n\n<b>Анализ:</b>\n<b>да</b> &amp; нет"
    )
    assert "Адрес:</b> y&lt;\n" in got["2"] and "данные не найдены" in got["2"]
    assert got["2"].endswith("<i>Анализ не проведен (ошибка сервиса ИИ)</i>")


def test_create_tables(spark):
    spark.sql("DROP DATABASE IF EXISTS kvitok_test CASCADE")
    schemas.create_tables(spark, "kvitok_test")
    schemas.create_tables(spark, "kvitok_test")
    assert schemas.tables_exist(spark, "kvitok_test")
    assert not schemas.tables_exist(spark, "default")
    spark.sql("DROP DATABASE kvitok_test CASCADE")
