"""Service names."""

from __future__ import annotations

import operator
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from kvitok.functions.text import strip

# The first rule with a fragment found in the lower-cased name decides.
CANONICAL_NAMES = (
    (("хвс",), "ХВС"),
    (("гвс",), "ГВС"),
    (("водоотв",), "Водоотведение"),
    (("отоп",), "Отопление"),
    (("сод.жил", "сод жил", "содержание жилья"), "Содержание жилья"),
    (("кап. ремонт", "кап ремонт", "капитальный ремонт"), "Капитальный ремонт"),
    (("тко",), "ТКО"),
    (("запирающее",), "Запирающее устройство"),
    (("шлагбаум",), "Шлагбаум"),
)

# Case-sensitive keyword of a bill line and the name a text line gets.
LINE_KEYWORDS = (
    ("ХВС", "ХВС КПУ"),
    ("ГВС", "ГВС КПУ"),
    ("Водоотв", "Водоотведение"),
    ("Отоп", "Отопление"),
    ("Сод.жил", "Содержание жилья"),
    ("кап. ремонт", "Капремонт"),
    ("ТКО", "ТКО"),
    ("Запирающее", "Запирающее устройство"),
    ("шлагбаумов", "Шлагбаум"),
)


def normalize_service(raw: Column) -> Column:
    """Canonical service name; a name no rule knows is kept, stripped.

    A ``пр.д.`` suffix needs no removal here: it shares no letters with the
    fragments, so it can neither make nor break a match.
    """
    lowered = F.lower(raw)
    rules = [
        (reduce(operator.or_, [F.contains(lowered, F.lit(f)) for f in fragments]), canonical)
        for fragments, canonical in CANONICAL_NAMES
    ]
    return _first_match(rules).otherwise(strip(raw))


def _first_match(rules: list[tuple[Column, str]]) -> Column:
    """One flat CASE, so that what its conditions share is computed once per row."""
    return reduce(lambda case, rule: case.when(rule[0], F.lit(rule[1])), rules, F)


def text_line_service(line: Column) -> Column:
    """Name of the first keyword found in a text line, else NULL."""
    return _first_match([(F.contains(line, F.lit(keyword)), name) for keyword, name in LINE_KEYWORDS])


def has_service_keyword(text: Column) -> Column:
    return text_line_service(text).isNotNull()
