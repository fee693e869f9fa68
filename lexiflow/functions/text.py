"""Column functions on tokens."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def shape(token: Column) -> Column:
    """Runs of capitals as X, of other letters as x, of digits as 9, of anything else as a full stop."""
    out = F.regexp_replace(token, r"[^\p{Lu}\p{L}\p{N}]+", ".")
    out = F.regexp_replace(out, r"\p{N}+", "9")
    out = F.regexp_replace(out, r"[\p{Ll}\p{Lt}\p{Lm}\p{Lo}]+", "x")
    return F.regexp_replace(out, r"\p{Lu}+", "X")


def shapes(lines: Column) -> Column:
    """The shape of each line."""
    out = F.regexp_replace(lines, r"[^\p{Lu}\p{L}\p{N}\n]+", ".")
    out = F.regexp_replace(out, r"\p{N}+", "9")
    out = F.regexp_replace(out, r"[\p{Ll}\p{Lt}\p{Lm}\p{Lo}]+", "x")
    return F.regexp_replace(out, r"\p{Lu}+", "X")


def first_capital(token: Column) -> Column:
    """A capital first and at least one letter after it, none of them a capital."""
    return token.rlike(r"^\p{Lu}[^\p{Lu}]*\p{Ll}[^\p{Lu}]*$")


def case_style(token: Column) -> Column:
    has = token.rlike(r"[\p{Lu}\p{Ll}]")
    return F.when(has & (F.upper(token) == token), "upper").when(first_capital(token), "first").otherwise("other")


def like_case(token: Column, form: Column) -> Column:
    """The form with a first capital where the token has one."""
    return F.when(first_capital(token), F.concat(F.upper(F.substring(form, 1, 1)), F.substring(form, F.lit(2), F.length(form)))).otherwise(form)


def syllables(word: Column) -> Column:
    return F.size(F.regexp_extract_all(F.lower(word), F.lit("[aāeēiīouū]+"), F.lit(0)))


def punctuation(token: Column) -> Column:
    return token.rlike(r"^[^\p{L}\p{N}]+$")


def fallback_class(token: Column) -> Column:
    """What a token without readings looks like: ordinal, number, abbreviation or nothing known."""
    return (
        F.when(token.rlike(r"^\d+[.]$"), "ordinal")
        .when(token.rlike(r"^[-−]?\d+([ ]\d\d\d)*([.,]\d+)?$") | token.rlike(r"^\d+(/\d+)$"), "number")
        .when(token.rlike(r"^\p{L}{1,3}[.]$"), "short abbreviation")
        .when(token.rlike(r"^(\p{L}+[.])+$"), "abbreviation")
        .otherwise("none")
    )


def glue(tokens: Column) -> Column:
    """Tokens joined by spaces, but for punctuation, which follows its token."""
    return F.aggregate(tokens, F.lit(""), lambda acc, t: F.when((acc == "") | punctuation(t), F.concat(acc, t)).otherwise(F.concat(acc, F.lit(" "), t)))
