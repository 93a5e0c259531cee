"""Column names as words, and the rules that read a meaning from them."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import fixed


def readable(name: Column) -> Column:
    """Header as separate words: a one-letter table prefix is dropped, snake_case and camelCase are split."""
    bare = F.regexp_replace(name, "^[A-Za-z]_", "")
    split = F.regexp_replace(bare, "([a-z0-9])([A-Z])", "$1 $2")
    return F.regexp_replace(split, r"[_\-]+", " ")


def is_revenue(name: Column) -> Column:
    n = readable(name)
    return n.rlike(fixed.REVENUE_NAME) & ~n.rlike(fixed.ATTRIBUTE_NAME) & ~n.rlike(fixed.QUANTITY_NAME)


def is_quantity(name: Column) -> Column:
    n = readable(name)
    return n.rlike(fixed.QUANTITY_NAME) & ~n.rlike(fixed.ATTRIBUTE_NAME)


def is_price_like(name: Column, semantic_type: Column) -> Column:
    n = readable(name)
    return ((semantic_type == "currency") | n.rlike(fixed.UNIT_PRICE_NAME)) & ~n.rlike(fixed.ATTRIBUTE_NAME)


def is_cost(name: Column) -> Column:
    return readable(name).rlike(fixed.COST_NAME)


def is_rate_like(name: Column) -> Column:
    return readable(name).rlike(fixed.RATE_NAME)


def metric_kind(name: Column, revenue: Column) -> Column:
    """value, quantity or attribute: the first two may be summed, the last only averaged."""
    n = readable(name)
    value = n.rlike(fixed.VALUE_NAME) & ~n.rlike(fixed.ATTRIBUTE_NAME) & ~n.rlike(fixed.UNIT_PRICE_NAME)
    return (F.when(F.coalesce(name == revenue, F.lit(False)), "value").when(is_quantity(name), "quantity")
            .when(value, "value").otherwise("attribute"))
