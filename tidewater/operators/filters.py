"""Filter expressions of nested comparators and operators, as retrieval clients send them."""

from __future__ import annotations

import operator
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

COMPARATORS = {"lt": operator.lt, "le": operator.le, "lte": operator.le, "eq": operator.eq, "gt": operator.gt, "ge": operator.ge, "gte": operator.ge, "ne": operator.ne}
#: Value types of the expressions by Spark's.
KINDS = {"STRING": "string", "INT": "int", "INTEGER": "int", "LONG": "bigint", "DOUBLE": "double", "FLOAT": "float", "BOOL": "boolean", "BOOLEAN": "boolean"}


def filter_column(tree: dict) -> Column:
    """A tree of ``{"comparator", "attribute", "value", "value_type"}`` leaves under ``{"operator": and|or|not, "arguments"}``."""
    if "comparator" in tree:
        if tree.get("attribute") is None:
            raise ValueError("a comparator needs an attribute")
        value = F.lit(tree["value"])
        if kind := tree.get("value_type"):
            value = value.cast(KINDS[kind.upper()])
        compare = COMPARATORS.get(str(tree["comparator"]).lower())
        if compare is None:
            raise ValueError(f"no such comparator: {tree['comparator']}")
        return compare(F.col(tree["attribute"]), value)
    parts, name = [filter_column(x) for x in tree["arguments"]], str(tree["operator"]).lower()
    if name == "not" and len(parts) == 1:
        return ~parts[0]
    if name in ("and", "or") and parts:
        return reduce(operator.and_ if name == "and" else operator.or_, parts)
    raise ValueError(f"no such operator: {name} of {len(parts)}")
