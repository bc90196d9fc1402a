"""Number tokens as bills print them: digits with points or commas."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: a number token has neither a sign nor inner spaces.
TOKEN = r"([\d\.,]+)"

QUANTITY = "decimal(18,3)"
MONEY = "decimal(18,2)"


# Digits and points that no cast takes for a number. A failing cast costs an exception, which a pattern does not.
_NO_NUMBER = r"^(?:\.?|[0-9]*+\.[0-9]*+\.[0-9.]*+)$"


def to_double(token: Column) -> Column:
    """NULL when the token, with commas as points, is no number."""
    pointed = F.replace(token, F.lit(","), F.lit("."))
    return F.when(~F.rlike(pointed, F.lit(_NO_NUMBER)), pointed.try_cast("double"))


def to_decimal(token: Column, type_name: str) -> Column:
    return F.replace(token, F.lit(","), F.lit(".")).try_cast(type_name)


def first_token(text: Column) -> Column:
    """First token or the empty string."""
    return F.regexp_extract(text, TOKEN, 1)


def valid_tokens(text: Column) -> Column:
    """All tokens that are numbers, in order, as printed."""
    tokens = F.regexp_extract_all(text, F.lit(TOKEN), F.lit(1))
    return F.filter(tokens, lambda t: to_double(t).isNotNull())
