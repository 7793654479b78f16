"""JSON columns. Typed paths are three-valued; untyped predicates are never unknown.

An untyped predicate on a missing path or on another JSON type is false; a JSON null is a value of
its own, unlike a missing path. Columns are texts or variants.
"""

from __future__ import annotations

import json as _json

from pyspark.sql import Column
from pyspark.sql import functions as F

_SQL = {"int": "bigint", "long": "bigint", "double": "double", "decimal": "decimal(38,18)", "string": "string", "boolean": "boolean", "timestamp": "timestamp", "date": "date"}


def _path(parts) -> str:
    return "$" + "".join(f"[{p}]" if isinstance(p, int) else "['" + str(p).replace("'", "\\'") + "']" for p in parts)


def typed(c: Column, *parts, kind: str = "string") -> Column:
    """The value at a path in a text column, cast; JSON null and missing are null."""
    return F.get_json_object(c, _path(parts)).cast(_SQL[kind])


class Path:
    """Untyped predicates on the value at a path."""

    def __init__(self, c: Column, *parts, variant: bool = False):
        v = c if variant else F.try_parse_json(c)
        self.v = F.try_variant_get(v, _path(parts), "variant") if parts else v
        self.kind = F.schema_of_variant(self.v)

    def _is(self, condition: Column) -> Column:
        return F.coalesce(condition, F.lit(False))

    def exists(self) -> Column:
        return self.v.isNotNull()

    def missing(self) -> Column:
        return self.v.isNull()

    def is_json_null(self) -> Column:
        return self._is(F.is_variant_null(self.v))

    def is_not_json_null(self) -> Column:
        return self._is(self.v.isNotNull() & ~F.is_variant_null(self.v))

    def is_number(self) -> Column:
        return self._is(self.kind.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)"))

    def is_string(self) -> Column:
        return self._is(self.kind == "STRING")

    def is_bool(self) -> Column:
        return self._is(self.kind == "BOOLEAN")

    def is_array(self) -> Column:
        return self._is(self.kind.startswith("ARRAY<"))

    def is_object(self) -> Column:
        return self._is(self.kind.startswith("OBJECT<"))

    def is_type(self, name: str) -> Column:
        return {"number": self.is_number, "string": self.is_string, "boolean": self.is_bool, "array": self.is_array, "object": self.is_object, "null": self.is_json_null}[name]()

    def _keys(self) -> Column:
        return F.when(self.is_object(), F.json_object_keys(F.to_json(self.v)))

    def has_key(self, key: str) -> Column:
        return self._is(F.array_contains(self._keys(), key))

    def has_any_key(self, *keys: str) -> Column:
        return self._is(F.arrays_overlap(self._keys(), F.array(*map(F.lit, keys)))) if keys else F.lit(False)

    def has_all_keys(self, *keys: str) -> Column:
        found = F.size(F.array_except(F.array(*map(F.lit, keys)), self._keys())) == 0 if keys else F.lit(True)
        return self.is_object() & self._is(found)

    def eq_json(self, value) -> Column:
        """Structural equality; the order of an object's keys does not matter (variants keep them sorted)."""
        return self._is(F.to_json(self.v) == F.to_json(F.parse_json(F.lit(_json.dumps(value)))))

    def neq_json(self, value) -> Column:
        return self._is(self.v.isNotNull() & (F.to_json(self.v) != F.to_json(F.parse_json(F.lit(_json.dumps(value))))))

    def _items(self) -> Column:
        return F.when(self.is_array(), F.try_variant_get(self.v, "$", "array<variant>"))

    def array_contains(self, value) -> Column:
        want = F.to_json(F.parse_json(F.lit(_json.dumps(value))))
        return self._is(F.exists(self._items(), lambda x: F.to_json(x) == want))

    def _length(self) -> Column:
        return F.size(self._items())

    def array_len_eq(self, n: int) -> Column:
        return self.is_array() & self._is(self._length() == n)

    def array_len_gt(self, n: int) -> Column:
        return self.is_array() & self._is(self._length() > n)

    def array_len_gte(self, n: int) -> Column:
        return self.is_array() & self._is(self._length() >= n)

    def array_len_lt(self, n: int) -> Column:
        return self.is_array() & self._is(self._length() < n)

    def array_len_lte(self, n: int) -> Column:
        return self.is_array() & self._is(self._length() <= n)

    def _as(self, value) -> tuple[Column, Column]:
        """(guard, value) for comparing with a Python scalar: numbers as decimals, others by their own type."""
        if isinstance(value, bool):
            return self.is_bool(), F.try_variant_get(self.v, "$", "boolean")
        if isinstance(value, str):
            return self.is_string(), F.try_variant_get(self.v, "$", "string")
        return self.is_number(), F.try_variant_get(self.v, "$", "decimal(38,12)")

    def _compare(self, value, test) -> Column:
        guard, v = self._as(value)
        return guard & self._is(test(v, F.lit(value) if isinstance(value, bool | str) else F.lit(str(value)).cast("decimal(38,12)")))

    def eq(self, value) -> Column:
        return self._compare(value, lambda a, b: a == b)

    def neq(self, value) -> Column:
        return self._compare(value, lambda a, b: a != b)

    def _number_only(self, value) -> None:
        if isinstance(value, bool | str):
            raise TypeError("strings and booleans are compared for equality only")

    def gt(self, value) -> Column:
        self._number_only(value)
        return self._compare(value, lambda a, b: a > b)

    def gte(self, value) -> Column:
        self._number_only(value)
        return self._compare(value, lambda a, b: a >= b)

    def lt(self, value) -> Column:
        self._number_only(value)
        return self._compare(value, lambda a, b: a < b)

    def lte(self, value) -> Column:
        self._number_only(value)
        return self._compare(value, lambda a, b: a <= b)

    def between(self, low, high) -> Column:
        return self.gte(low) & self.lte(high)

    def in_(self, values: list, kind: str = "number") -> Column:
        """In a list; an empty one is false, and its negation true, on values of ``kind`` only."""
        out = F.lit(False)
        for x in values:
            out = out | self.eq(x)
        return self.is_type(kind if not values else self._kind(values[0])) & out

    def not_in(self, values: list, kind: str = "number") -> Column:
        return self.is_type(kind if not values else self._kind(values[0])) & ~self.in_(values, kind)

    @staticmethod
    def _kind(value) -> str:
        return "boolean" if isinstance(value, bool) else "string" if isinstance(value, str) else "number"
