import html
import random
import time

import pytest
from pyspark.sql import functions as F

from kvitok.functions import names, numbers, tariff, text
from kvitok.sources.mime import TableReader


def run(spark, function, values):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r[0] for r in rows.orderBy("i").select(function(F.col("v"))).collect()]


def test_whitespace(spark):
    values = ["a  b\n\tc ", "\x1c a b", "", "　x"]
    assert run(spark, text.collapse_whitespace, values) == [" ".join(v.split()) for v in values]
    assert run(spark, text.strip, values) == [v.strip() for v in values]


def test_html_escape(spark):
    values = ["<a href=\"x\">'&amp;</a>", "без разметки"]
    assert run(spark, text.html_escape, values) == [html.escape(v) for v in values]


def test_truncate(spark):
    values = ["я" * 4000, "я" * 4001, "x"]
    assert run(spark, text.truncate_message, values) == [values[0], "я" * 4000 + "... (обрезано)", "x"]


MARKDOWN = {
    "### Итог\n**важно** и *курсив*\n* пункт\n\t- вложенный\n": (
        "<b>Итог</b>\n<b>важно</b> и <i>курсив</i>\n• пункт\n • вложенный\n"
    ),
    "a * b * c\n** x **\n***": "a <i> b </i> c\n<b> x </b>\n***",
    "### \n- < & >\n\xa0* неразрывный": "<b></b>\n• &lt; &amp; &gt;\n • неразрывный",
    "текст\r\n### не в начале\rстроки": "текст\r\n<b>не в начале\rстроки</b>",
    "*один\nдва*": "*один\nдва*",
}


def test_markdown(spark):
    assert run(spark, text.markdown_to_html, list(MARKDOWN)) == list(MARKDOWN.values())


REFERENCES = {
    "&copy2024 &copy; &notit; &notin;": "©2024 © ¬it; ∉",
    "&#169 y &#00000169; &#xA9z &#x000000A9;": "© y © ©z ©",
    "&#150; &#x96 &#0; &#99999999999999999999; &#xD800;": "– – \ufffd \ufffd \ufffd",
    "a&#1;b &unknown; & &; &#; &#x;": "ab &unknown; & &; &#; &#x;",
    "<ruby>漢<rp>(</rp><rt>kan</rt><rp>)</rp></ruby>": "漢",
}


def test_references_by_hand_and_by_the_markup_reader(spark):
    got = run(spark, text.visible_text, list(REFERENCES))
    assert got == list(REFERENCES.values())
    assert [" ".join(TableReader().read(page)[0].split()) for page in REFERENCES] == got


def test_long_tags(spark):
    long = "x" * 1_000_000
    pages = [f"a <b {long}> c", f"a <b {long}", "a <b " + "k='v' " * 20_000 + "> c", f"a <b c=\"{long}\"> d"]
    assert run(spark, text.visible_text, pages) == ["a c", f"a <b {long}", "a c", "a d"]


def test_visible_text(spark):
    page = (
        "<!DOCTYPE html><style>p{}</style><p>a&nbsp;&lt;b&gt; &#1078;&#x416;;</p><!-- <p>x</p> -->"
        "<script>var t='</p>';</script><a title='1>2'>c</a> 1 < 2 &amp;lt;"
    )
    reader = TableReader()
    expected = " ".join(reader.read(page)[0].split())
    assert run(spark, text.visible_text, [page]) == [expected] == ["a <b> жЖ; c 1 < 2 &lt;"]


# Pages and what a reader sees of them.
PAGES = {
    "<p title=it's>don't lose me</p> end": "don't lose me end",
    "a <p title=it's> b": "a b",
    "a <p x = \"1>2\" y='>'> b": "a b",
    "a<p x=a\"b>c\">d": 'a c">d',
    "a <p \"x>y\"> b": 'a y"> b',
    "a <!-- b > c": "a",
    "a<!-->b<!--->c<!-- d --!>e": "a b c e",
    "a <!doctype x> b <?pi y> c </3> d </> e <3> f": "a b c d e <3> f",
    "a<script>b</scripts>c</script x>d<STYLE>e</Style >f": "a d f",
    "a<script>b": "a",
    "a<template>x<b>y</template>z<template>w": "a z",
    "<ruby>k<rt>kan<rp>)</ruby> text<p>b<rt>c</p>d": "k text b d",
    "a<rt>b": "a",
    "a<![CDATA[x>y]]>b<![CDATA[c": "a x>y b",
    "a <b x": "a <b x",
    "a <!doctype": "a <!doctype",
    "a < b <": "a < b <",
    "a <b x='1": "a <b x='1",
    "": "",
}


def test_visible_text_of_odd_pages(spark):
    assert run(spark, text.visible_text, list(PAGES)) == list(PAGES.values())
    assert [" ".join(TableReader().read(page)[0].split()) for page in PAGES] == list(PAGES.values())


def test_both_readers_agree_on_any_pieces(spark):
    pieces = "<p> </p> <b x= = \" ' > < </ <!-- --> - <! <? <script> </script> <rt> </rt> <td> <template> </template> <![CDATA[ ]]> a b &amp; &lt; / \n".split(" ")
    rng = random.Random(7)
    pages = ["".join(rng.choices(pieces, k=rng.randint(1, 25))) for _ in range(4000)]
    want = [" ".join(TableReader().read(page)[0].split()) for page in pages]
    assert run(spark, text.visible_text, pages) == want


HOSTILE = ("<!--", "<rt>", "<script>", "<a ", "<a x=\"", "<a x='", "<a =", "</", "<!", "<![CDATA[", "<template>", "&", "<p>", "</p>", "<a x=\">\"", "<table><tr><td>")


def test_hostile_pages_take_linear_time(spark):
    pages = [(one * (1_000_000 // len(one)))[:1_000_000] for one in HOSTILE]
    run(spark, text.visible_text, ["warm <b>up</b>"])
    for one, page in zip(HOSTILE, pages):
        start = time.perf_counter()
        spark.createDataFrame([(page,)], "v string").select(F.length(text.visible_text(F.col("v")))).collect()
        assert time.perf_counter() - start < 5, one
        if one != "<table><tr><td>":  # a cell belongs to every open row
            start = time.perf_counter()
            TableReader().read(page)
            assert time.perf_counter() - start < 5, one


def test_nested_tables_send_each_row_once():
    page = "<table><tr><td>" * 10 + "x" + "</td></tr><tr><td>y</td></tr></table>" * 10
    rows = TableReader().read(page)[1]
    assert len(rows) == 20 and [len(r["tables"]) for r in rows[:10]] == list(range(1, 11))
    assert sorted(r["tables"][-1] for r in rows) == sorted([*range(10)] * 2)


def test_visible_text_agrees_with_markup_reader(spark, small):
    pages = spark.read.parquet(f"{small}/pages.parquet")
    for row in pages.select("html", text.visible_text(F.col("html")).alias("t")).collect():
        assert row.t == " ".join(TableReader().read(row.html)[0].split())


@pytest.mark.parametrize(
    "raw, name",
    [
        ("ХВС КПУ", "ХВС"),
        ("гвс пр.д.", "ГВС"),
        ("Водоотв. пр. д.", "Водоотведение"),
        ("Сод жил", "Содержание жилья"),
        ("Кап. ремонт", "Капитальный ремонт"),
        ("Капремонт", "Капремонт"),
        (" Домофон пр.д. ", "Домофон пр.д."),
        ("Отопление ТКО", "Отопление"),
        ("", ""),
        (None, None),
    ],
)
def test_normalize_service(spark, raw, name):
    assert run(spark, names.normalize_service, [raw]) == [name]


def test_canonical_names_are_stable(spark):
    canonical = [name for _, name in names.CANONICAL_NAMES]
    assert run(spark, names.normalize_service, canonical) == canonical


def test_line_keywords_are_case_sensitive(spark):
    assert run(spark, names.text_line_service, ["кап. ремонт 1", "Кап. ремонт 1", "хвс", "ГВС и ХВС"]) == [
        "Капремонт",
        None,
        None,
        "ХВС КПУ",
    ]


def test_number_tokens(spark):
    values = ["-100,00 и 1 234,56", "1,234.56", "5. .5 . ,", "м3 45,00"]
    assert run(spark, numbers.valid_tokens, values) == [
        ["100,00", "1", "234,56"],
        [],
        ["5.", ".5"],
        ["3", "45,00"],
    ]
    assert run(spark, numbers.first_token, values) == ["100,00", "1,234.56", "5.", "3"]


def test_tariffs_differ_for_negative_quantity(spark):
    row = spark.createDataFrame([(10.0, -2.0), (10.0, 0.0), (10.0, 4.0)], "a double, q double").select(
        tariff.analysis_tariff(F.col("a"), F.col("q")), tariff.chart_tariff(F.col("a"), F.col("q"))
    )
    assert [tuple(r) for r in row.collect()] == [(0.0, -5.0), (0.0, 0.0), (2.5, 2.5)]


def test_fixed_rounds_half_even_on_the_exact_double(spark):
    row = spark.createDataFrame([(0.125,), (1234.5,), (2.675,)], "x double")
    assert [r[0] for r in row.select(text.fixed(F.col("x"), 2)).collect()] == [
        f"{x:.2f}" for x in (0.125, 1234.5, 2.675)
    ]
