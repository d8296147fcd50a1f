"""Checks of request bodies, and canonical and templated text, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Limits of request bodies, and the template of a topic's hypothesis.
KEY_CHARS, REASON_CHARS, NAME_CHARS, MOST_VALUES = 120, 1000, 200, 30
HYPOTHESIS = "This text is about {}."
DIMENSIONS = ("countries", "themes", "query_terms")


def told(*checks: tuple[Column, str]) -> Column:
    """Names of the conditions that hold; a condition that cannot be told holds."""
    return F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(True)), F.lit(name)) for c, name in checks]))


def outside(text: Column, most: int) -> Column:
    """Whether a text is empty or has more bytes than `most`."""
    return ~F.octet_length(text).between(1, most)


def repeated(values: Column) -> Column:
    return F.size(F.array_distinct(values)) != F.size(values)


def exposure_problems(exposures: Column) -> Column:
    """What is wrong with a list of exposures (instrument_key, reason, display_order)."""
    return told(
        (F.exists(exposures, lambda x: F.coalesce(outside(x["instrument_key"], KEY_CHARS), F.lit(True))), "instrument_key"),
        (F.exists(exposures, lambda x: F.coalesce(outside(x["reason"], REASON_CHARS), F.lit(True))), "reason"),
        (F.exists(exposures, lambda x: F.coalesce(x["display_order"] < 0, F.lit(True))), "display_order"),
        (repeated(F.transform(exposures, lambda x: x["instrument_key"])), "instrument_key repeated"),
    )


def rule_problems(rules: Column) -> Column:
    """What is wrong with a list of event rules (name and DIMENSIONS, arrays of strings)."""
    any_list = lambda test: F.exists(rules, lambda r: test(r["countries"]) | test(r["themes"]) | test(r["query_terms"]))
    return told(
        (F.exists(rules, lambda r: F.coalesce(outside(r["name"], NAME_CHARS), F.lit(True))), "name"),
        (repeated(F.transform(rules, lambda r: r["name"])), "name repeated"),
        (F.exists(rules, lambda r: F.size(r["countries"]) + F.size(r["themes"]) + F.size(r["query_terms"]) == 0), "no dimension"),
        (any_list(lambda v: F.size(v) > MOST_VALUES), "too many values"),
        (any_list(lambda v: F.exists(v, lambda x: F.trim(x) == "")), "blank value"),
        (any_list(repeated), "value repeated"),
    )


def canonical_json(*columns: Column) -> Column:
    """One JSON object of named columns with its keys in order and no spaces. Structs inside keep the order of their type."""
    ordered = sorted(columns, key=lambda c: c._jc.toString().rsplit(" AS ", 1)[-1])
    return F.to_json(F.struct(*ordered))


def filled(template: str, value: Column) -> Column:
    """The template with {} replaced."""
    before, after = template.split("{}")
    return F.concat(F.lit(before), value, F.lit(after))
