"""Functions of recording names and three-digit event codes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..params import CodeScheme

NO_ROLE = "NA"


def recording_number(name: Column) -> Column:
    """All digits of a recording's name, joined; fails where there is none."""
    digits = F.regexp_replace(F.trim(name), "[^0-9]", "")
    return F.when(digits == "", F.raise_error(F.concat(F.lit("no digits in recording name "), name))).otherwise(digits)


def digits(code: Column) -> tuple[Column, Column, Column]:
    """A, B and C of code = 100 A + 10 B + C."""
    tens = F.floor(code / 10)
    return F.floor(code / 100).cast("int"), F.pmod(tens, F.lit(10)).cast("int"), F.pmod(code, F.lit(10)).cast("int")


def flags(code: Column, scheme: CodeScheme = CodeScheme()) -> dict[str, Column]:
    a, b, c = digits(code)
    practice = a.isin(*scheme.practice)
    return {
        "is_true": b == scheme.true_digit,
        "is_buffer": b == scheme.buffer_digit,
        "is_standard": c == scheme.standard_digit,
        "is_deviant": c == scheme.deviant_digit,
        "is_practice": practice,
        "is_main": ~practice,
    }


def variant(code: Column, scheme: CodeScheme = CodeScheme()) -> Column:
    a = digits(code)[0]
    return F.when(a.isin(*scheme.reduced), "reduced").when(a.isin(*scheme.full), "full").otherwise("other")


def roles(code: Column, scheme: CodeScheme = CodeScheme()) -> dict[str, Column]:
    """Which token is the standard of the block, which the deviant, and which this trial plays."""
    a, _, c = digits(code)
    standard = F.when(a.isin(*scheme.first_is_standard), "token1").when(a.isin(*scheme.second_is_standard), "token2").otherwise(NO_ROLE)
    deviant = F.when(a.isin(*scheme.first_is_standard), "token2").when(a.isin(*scheme.second_is_standard), "token1").otherwise(NO_ROLE)
    return {"standard_role": standard, "deviant_role": deviant, "trial_role": F.when(c == scheme.standard_digit, standard).otherwise(deviant)}


def label(role: Column, tokens: dict[str, str]) -> Column:
    """A role's label; roles without one keep their name."""
    if not tokens:
        return role
    table = F.create_map(*[F.lit(x) for pair in tokens.items() for x in pair])
    return F.coalesce(F.try_element_at(table, role), role)
