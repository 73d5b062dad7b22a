"""Filters over chunk and document columns, compiled from plain specifications to Columns."""

from __future__ import annotations

from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Public filter names and the columns that hold them.
COLUMNS = {"justice": "majority_author", "impacted_agencies": "agencies", "policy_topics": "topics"}
# Public names of opinion types.
OPINION_TYPES = {"concurring": "concurrence", "dissenting": "dissent"}


def _all(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def equals(fields: dict[str, Any]) -> Column:
    """Every field has its value; null never matches."""
    return _all([F.coalesce(F.col(k) == F.lit(v), F.lit(False)) for k, v in fields.items()])


def any_of(column: str, values: list[Any], array: bool = True) -> Column:
    """An array column shares a value, or a scalar column has one of them."""
    if not array:
        return F.coalesce(F.col(column).isin(values), F.lit(False))
    return F.coalesce(F.arrays_overlap(F.col(column), F.array(*map(F.lit, values))), F.lit(False))


def between(column: str, low: Any = None, high: Any = None) -> Column:
    """Both ends included, either may be open."""
    bounds = [F.col(column) >= F.lit(low)] * (low is not None) + [F.col(column) <= F.lit(high)] * (high is not None)
    return F.coalesce(_all(bounds), F.lit(False))


def compile_filter(spec: dict[str, list[dict]], arrays: tuple[str, ...] = ("agencies", "topics")) -> Column:
    """must: all; should: at least one; must_not: none. A condition has a key and match {value | any} or range."""

    def one(condition: dict) -> Column:
        key = COLUMNS.get(condition["key"], condition["key"])
        if "match" in condition:
            match = condition["match"]
            return any_of(key, match["any"], key in arrays) if "any" in match else equals({key: match["value"]})
        compare = {"gt": Column.__gt__, "gte": Column.__ge__, "lt": Column.__lt__, "lte": Column.__le__}
        return _all([compare[op](F.col(key), F.lit(v)) for op, v in condition["range"].items() if v is not None])

    held = _all([one(c) for c in spec.get("must", [])])
    if spec.get("should"):
        held = held & reduce(lambda a, b: a | b, [F.coalesce(one(c), F.lit(False)) for c in spec["should"]])
    for c in spec.get("must_not", []):
        held = held & ~F.coalesce(one(c), F.lit(False))
    return F.coalesce(held, F.lit(False))


def opinion_filter(opinion_type: str | None = None, justice: str | None = None, start: int | None = None, end: int | None = None) -> Column:
    """Court search: type (public or stored name, or syllabus), justice, publication date."""
    conditions = []
    if opinion_type == "syllabus":
        conditions.append(equals({"section_type": "syllabus"}))
    elif opinion_type:
        conditions.append(equals({"opinion_type": OPINION_TYPES.get(opinion_type, opinion_type)}))
    if justice:
        conditions.append(equals({"majority_author": justice}))
    if start is not None or end is not None:
        conditions.append(between("publication_date", start, end))
    return _all(conditions)


def order_filter(president: str | None = None, agencies: list[str] | None = None, topics: list[str] | None = None, start: int | None = None, end: int | None = None) -> Column:
    """Order search: president by full or last name, any agency, any topic, signing date."""
    conditions = []
    if president:
        conditions.append(F.coalesce((F.col("president") == president) | (F.element_at(F.split("president", " "), -1) == president), F.lit(False)))
    if agencies:
        conditions.append(any_of("agencies", agencies))
    if topics:
        conditions.append(any_of("topics", topics))
    if start is not None or end is not None:
        conditions.append(between("signing_date", start, end))
    return _all(conditions)


def keyword_search(docs: DataFrame, query: str, columns: tuple[str, ...], limit: int | None = None, order: tuple[str, ...] = ()) -> DataFrame:
    """Rows that hold every term; quoted words are one term; an empty query takes all."""
    import re

    terms = [(a or b).lower() for a, b in re.findall(r'"([^"]+)"|(\S+)', query)]
    text = F.lower(F.concat_ws(" ", *columns))
    found = docs.where(_all([text.contains(t) for t in terms]))
    found = found.orderBy(*order) if order else found
    return found.limit(limit) if limit is not None else found
