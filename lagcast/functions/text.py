"""Identity, key and name expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def station_id(eva: Column) -> Column:
    """Station number without leading zeros."""
    return F.regexp_replace(eva, "^0+", "")


def train_identity(train_type: Column, number: Column) -> Column:
    """``ICE 512``; null if either part is null."""
    return F.concat(train_type, F.lit(" "), number)


def train_key(identity: Column) -> Column:
    """File-safe upper-case key of a train identity."""
    return F.upper(F.btrim(F.regexp_replace(identity, "[^A-Za-z0-9]+", "_"), F.lit("_")))


def _filled(text: Column) -> Column:
    return F.when(F.trim(text) != "", text)


def label(category: Column, number: Column, line: Column) -> Column:
    """Line, prefixed by its category unless it already is, else category and number."""
    by_line = F.when(F.startswith(line, category), line).otherwise(train_identity(category, line))
    return F.coalesce(by_line, train_identity(category, number))


def lookup_keys(category: Column, number: Column, line: Column) -> Column:
    """History keys to try for a train: by number first, by line second."""
    line = _filled(line)
    by_line = F.when(F.startswith(line, category), line).otherwise(train_identity(category, line))
    keys = F.array(train_key(train_identity(category, _filled(number))), train_key(by_line))
    return F.array_distinct(F.array_compact(keys))


def normal_name(name: Column) -> Column:
    """Station name folded for search: lower case, no umlauts, no ``-()``."""
    folded = F.replace(F.translate(F.lower(name), "äöü-()", "aou   "), F.lit("ß"), F.lit("ss"))
    return F.trim(F.regexp_replace(folded, r"\s+", " "))


def split_route(route: Column) -> Column:
    """Bar-separated route to an array without blank stops."""
    return F.coalesce(
        F.filter(F.split(route, r"\|"), lambda stop: F.trim(stop) != ""),
        F.array().cast("array<string>"),
    )


def name_reaches(stop: Column, target: Column, both_ways: bool) -> Column:
    """Loose stop-name match, ignoring case: equal or containing, optionally contained."""
    stop, target = F.lower(stop), F.lower(target)
    hit = F.contains(stop, target)
    return hit | F.contains(target, stop) if both_ways else hit


def route_reaches(route: Column, target: Column, both_ways: bool) -> Column:
    return F.exists(route, lambda stop: name_reaches(stop, target, both_ways))
