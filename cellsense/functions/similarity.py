"""Similarity scores over columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .celltypes import is_person  # noqa: F401 - the test that ``person`` goes with
from .text import initial_name


def edit_distance(a: Column, b: Column) -> Column:
    """Levenshtein distance over the longer length (0 for two empty texts)."""
    return F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b), F.lit(1))


def jaccard(a: Column, b: Column) -> Column:
    """Of two token arrays as sets; 0 where both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(F.lit(0.0))


def row_context(abstract: Column, header: Column, row: Column, forms) -> Column:
    """Abstract words of which a form (``forms``: singular, plural) stands in the header's bag, plus those in the row's bag."""
    one, many = forms
    in_header = F.filter(abstract, lambda w: F.array_contains(header, one(w))), F.filter(abstract, lambda w: F.array_contains(header, many(w)))
    return F.size(in_header[0]) + F.size(in_header[1]) + F.size(F.array_intersect(abstract, row))


def cell_context(cell: Column, entity: Column, abstract: Column) -> Column:
    """Words that the cell's bag shares with the entity's and with the abstract's."""
    return F.size(F.array_intersect(cell, entity)) + F.size(F.array_intersect(cell, abstract))


def numeric(a: Column, b: Column) -> Column:
    return F.lit(1.0) - F.abs(a - b) / F.greatest(F.abs(a), F.abs(b), F.lit(1.0))


def day_number(d: Column) -> Column:
    """Days with 0001-01-01 as day 1."""
    return F.datediff(d, F.to_date(F.lit("0001-01-01"))) + 1


def date(a: Column, b: Column) -> Column:
    x, y = day_number(a), day_number(b)
    return F.lit(1.0) - F.abs(x - y) / F.greatest(x, y, F.lit(1))


def containment(a: Column, b: Column) -> Column:
    """Shorter over longer length where one contains the other, else 0."""
    short, long = F.least(F.length(a), F.length(b)), F.greatest(F.length(a), F.length(b))
    return F.when((F.contains(a, b) | F.contains(b, a)) & (long > 0), short / long).otherwise(F.lit(0.0))


def person(cell: Column, value: Column) -> Column:
    """Edit distance to the value with its first name cut to the initial."""
    return edit_distance(cell, initial_name(value))


def candidate_score(entity_edit: Column, alias_edit: Column) -> Column:
    """The smaller of the distances to the entity's name and to its alias."""
    return F.least(entity_edit, F.coalesce(alias_edit, entity_edit))
