"""Predicates on event fields as column expressions."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

ATTRIBUTE_BAGS = ("attributes", "payload")

# The operators' names.
ALIASES = {"present": "exists", "absent": "not_exists", "==": "eq", "!=": "ne", ">": "gt", ">=": "gte", "<": "lt", "<=": "lte"}
OPERATORS = ("exists", "not_exists", "eq", "ne", "in", "not_in", "contains", "regex", "gt", "gte", "lt", "lte")


def field(df: DataFrame, name: str) -> Column:
    """A field of an event: a column, else a dotted path in an attribute bag (map, struct or JSON text).

    Null where it is missing.
    """
    if name in df.columns:
        return F.col(f"`{name}`")
    for bag in ATTRIBUTE_BAGS:
        if bag not in df.columns:
            continue
        kind = df.schema[bag].dataType
        if isinstance(kind, T.MapType):
            return F.try_element_at(F.col(bag), F.lit(name))
        if isinstance(kind, T.StringType):
            return F.get_json_object(F.col(bag), "$." + name)
        if isinstance(kind, T.StructType):
            at, parts = F.col(bag), name.split(".")
            for part in parts:
                if not isinstance(kind, T.StructType) or part not in kind.names:
                    return F.lit(None).cast("string")
                at, kind = at.getField(part), kind[part].dataType
            return at
    return F.lit(None).cast("string")


@dataclass(frozen=True)
class Predicate:
    """A condition on a field; with `event_type` it binds events of that type only."""

    field: str
    op: str
    value: Any = None
    event_type: str | None = None

    def __post_init__(self) -> None:
        object.__setattr__(self, "op", ALIASES.get(self.op, self.op))
        if self.op not in OPERATORS:
            raise ValueError(f"unknown operator {self.op!r}")

    @classmethod
    def of(cls, d: dict[str, Any]) -> Predicate:
        return cls(str(d["field"]), str(d.get("op", "eq")).lower(), d.get("value"), d.get("event_type"))

    def column(self, df: DataFrame, type_column: str = "event_type") -> Column:
        """True or false, never null: a missing field equals only null, differs from all else,
        and fails contains, regex and the numeric comparisons."""
        x = field(df, self.field)
        test = self._test(x)
        return test if self.event_type is None else (~F.col(type_column).eqNullSafe(self.event_type)) | test

    def _test(self, x: Column) -> Column:
        no = F.lit(False)
        if self.op in ("exists", "not_exists"):
            return x.isNotNull() if self.op == "exists" else x.isNull()
        if self.op in ("eq", "ne"):
            same = x.eqNullSafe(F.lit(self.value))
            return same if self.op == "eq" else ~same
        if self.op in ("in", "not_in"):
            listed = list(self.value or [])
            known = [v for v in listed if v is not None]
            within = F.coalesce(x.isin(known), no) if known else no
            if None in listed:
                within = within | x.isNull()
            return within if self.op == "in" else ~within
        if self.op == "contains":
            return F.coalesce(x.cast("string").contains(str(self.value)), no)
        if self.op == "regex":
            return F.coalesce(x.cast("string").rlike(str(self.value)), no)
        number = x.cast("string").try_cast("double") if hasattr(x, "try_cast") else x.cast("double")
        try:
            bound = F.lit(float(self.value))
        except (TypeError, ValueError):
            return no
        compared = {"gt": number > bound, "gte": number >= bound, "lt": number < bound, "lte": number <= bound}[self.op]
        return F.coalesce(compared, no)
