"""Parsing and validating columns of loosely typed sources."""

from __future__ import annotations

import ast
import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

NUMBER = r"^\s*[+-]?(\d+\.?\d*([eE][+-]?\d+)?|\.\d+([eE][+-]?\d+)?|inf|infinity|nan)\s*$"
MEMBER = "array<struct<name:string,order:int,job:string,department:string>>"


def number(text: Column) -> Column:
    """A number, or null for junk and for what isn't one."""
    value = F.when(F.lower(text).rlike(NUMBER), text.try_cast("double"))
    return F.when(~F.isnan(value), value)


def valid_number(value: Column) -> Column:
    return F.coalesce((value >= 0) & (value < float("inf")) & ~F.isnan(value), F.lit(False))


def valid_id(value: Column) -> Column:
    return F.coalesce(value > 0, F.lit(False))


def valid_rating(value: Column) -> Column:
    """Half stars from 0.5 to 5."""
    return F.coalesce(value.isin(*[k / 2 for k in range(1, 11)]), F.lit(False))


def date_parts(text: Column, current_year: int | None = None) -> dict[str, Column]:
    """The day of a text yyyy-MM-dd, null for anything else, with its parts; valid: not later than the current year."""
    day = F.to_date(F.try_to_timestamp(text, F.lit("yyyy-MM-dd")))
    year = F.year(day)
    return {
        "release_date": day, "release_year": year, "release_month": F.month(day), "release_decade": (F.floor(year / 10) * 10).cast("int"),
        "release_date_valid": F.coalesce(year <= (F.year(F.current_date()) if current_year is None else F.lit(current_year)), F.lit(False)),
    }


def time_parts(seconds: Column, current_year: int | None = None) -> dict[str, Column]:
    """The moment of a number of seconds since 1970, its year, and whether that is not later than the current year. The session's time zone should be UTC."""
    moment = F.timestamp_seconds(seconds)
    year = F.year(moment)
    return {"rating_datetime": moment, "rating_year": year, "valid_timestamp": F.coalesce(year <= (F.year(F.current_date()) if current_year is None else F.lit(current_year)), F.lit(False))}


def flag(text: Column) -> Column:
    return F.coalesce(text == "True", F.lit(False))


def language(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), r"^\s+|\s+$", "")


def is_english(text: Column) -> Column:
    return F.coalesce(language(text) == "en", F.lit(False))


def valid_json(text: Column) -> Column:
    """Whether a text is JSON; missing ones are not."""
    return F.coalesce(F.try_parse_json(text).isNotNull(), F.lit(False))


@F.pandas_udf(StringType())
def _literal(texts: pd.Series) -> pd.Series:
    """Python literals as JSON; null for anything else."""

    def one(text):
        if text is None:
            return None
        try:
            return json.dumps(ast.literal_eval(text))
        except (ValueError, SyntaxError, TypeError, RecursionError, MemoryError):
            return None

    return texts.map(one)


def parsed(text: Column) -> Column:
    """The JSON of a text that is JSON or, failing that, a Python literal; null for missing, empty and malformed ones. Only texts that aren't JSON reach Python."""
    said = F.when(text != "", text)
    json_ = F.try_parse_json(said).isNotNull()
    return F.when(json_, said).otherwise(_literal(F.when(~json_, said)))


def _listed(json_text: Column, kind: str) -> Column:
    """A JSON list; anything else, a single object too, is empty."""
    listed = F.trim(json_text).startswith("[")
    return F.coalesce(F.when(listed, F.from_json(json_text, kind)), F.array().cast(kind))


def members(text: Column) -> Column:
    """The objects of a list, JSON or Python; anything else is empty."""
    return F.filter(_listed(parsed(text), MEMBER), lambda x: x.isNotNull())


def listed_names(text: Column, most: int | None = None) -> Column:
    """The texts of a list, JSON or Python, at most the first of them; missing and malformed ones are empty."""
    found = _listed(parsed(text), "array<string>")
    return found if most is None else F.slice(found, 1, most)


def all_names(found: Column) -> Column:
    """Names, empty ones kept."""
    return F.transform(found, lambda x: F.coalesce(x["name"], F.lit("")))


def object_name(text: Column) -> Column:
    """The name of a single object; empty for anything else."""
    json_text = parsed(text)
    return F.coalesce(F.when(F.trim(json_text).startswith("{"), F.from_json(json_text, "struct<name:string>")["name"]), F.lit(""))


def first(names_: Column) -> Column:
    return F.get(names_, 0)


def known_words(words: Column, vocabulary: Column) -> Column:
    """The members that are in a vocabulary, in their order."""
    return F.filter(words, lambda x: F.array_contains(vocabulary, x))


def names(found: Column) -> Column:
    return F.filter(F.transform(found, lambda x: x["name"]), lambda n: n != "")


def lead_names(found: Column, most: int = 5) -> Column:
    """The names of the first by order (without one: 999), equal orders as listed; empty names go after the cut."""
    placed = F.transform(found, lambda x, i: F.struct(F.coalesce(x["order"], F.lit(999)).alias("o"), i.alias("i"), x["name"].alias("name")))
    return F.filter(F.transform(F.slice(F.array_sort(placed), 1, most), lambda x: x["name"]), lambda n: n != "")


def names_where(found: Column, test) -> Column:
    """Names, empty ones kept, of the members that pass."""
    return F.transform(F.filter(found, lambda x: F.coalesce(test(x), F.lit(False))), lambda x: F.coalesce(x["name"], F.lit("")))


DIRECTOR = lambda x: x["job"] == "Director"
PRODUCER = lambda x: x["job"].contains("Producer")
WRITER = lambda x: x["department"] == "Writing"
COMPOSER = lambda x: x["job"].contains("Music") & x["job"].contains("Composer")
