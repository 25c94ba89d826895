"""JSON Schema checks for the keywords that page schemas use; other keywords raise."""

from __future__ import annotations

import re
from typing import Any

_IGNORED = {"definitions", "$schema", "$id", "id", "title", "description", "default", "examples", "additionalProperties"}
_DATE_TIME = re.compile(r"(\d{4})-(\d\d)-(\d\d)[Tt](\d\d):(\d\d):(\d\d)(?:\.\d+)?(?:[Zz]|[+-](\d\d):(\d\d))\Z")
_CHAR = r"(?:[A-Za-z0-9\-._~!$&'()*+,;=:@/?]|%[0-9A-Fa-f]{2})"
_URI = re.compile(rf"(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://(?:{_CHAR}|\[[0-9A-Fa-f:.]+\])*)?{_CHAR}*(?:#{_CHAR}*)?\Z")


class UnsupportedKeyword(ValueError):
    """A registered schema uses a keyword that this validator doesn't implement."""


def is_uri(value: str) -> bool:
    """Parses as an RFC 3986 reference (ASCII only)."""
    return _URI.match(value) is not None


def is_date_time(value: str) -> bool:
    """RFC 3339 date and time with an offset; a bare date is none."""
    m = _DATE_TIME.match(value)
    if not m:
        return False
    year, month, day, hour, minute, second = (int(x) for x in m.groups()[:6])
    leap = year % 4 == 0 and (year % 100 != 0 or year % 400 == 0)
    days = (31, 29 if leap else 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31)
    if not (1 <= month <= 12 and 1 <= day <= days[month - 1] and hour <= 23 and minute <= 59 and second <= 60):
        return False
    return m[7] is None or (int(m[7]) <= 23 and int(m[8]) <= 59)


_FORMATS = {"uri": is_uri, "date-time": is_date_time}


def _is(value: Any, kind: str) -> bool:
    if kind == "integer":
        return isinstance(value, int) and not isinstance(value, bool)
    if kind == "number":
        return isinstance(value, int | float) and not isinstance(value, bool)
    expected = {"object": dict, "array": list, "string": str, "boolean": bool, "null": type(None), "any": object}.get(kind)
    if expected is None:
        raise UnsupportedKeyword(f"unknown type {kind!r}")
    return isinstance(value, expected)


def _kind(value: Any) -> str:
    return next(k for k in ("boolean", "integer", "number", "string", "array", "object", "null") if _is(value, k))


class Validator:
    """errors(value): [(fragment, message)] of one schema. Constants are checked only on request."""

    def __init__(self, schema: dict, enforce_const: bool = False):
        self.root, self.enforce_const = schema, enforce_const
        self._checks = {
            "type": self._type, "required": self._required, "properties": self._properties, "items": self._items,
            "minItems": self._min_items, "enum": self._enum, "const": self._const, "maxLength": self._max_length,
            "minLength": self._min_length, "minimum": self._minimum, "format": self._format, "anyOf": self._any_of,
        }

    def errors(self, value: Any) -> list[tuple[str, str]]:
        return list(self._walk(self.root, value, "#/"))

    def _walk(self, schema: dict, value: Any, at: str):
        if "$ref" in schema:
            schema = self._target(schema["$ref"])
        for keyword, rule in schema.items():
            if keyword in self._checks:
                yield from self._checks[keyword](rule, value, at)
            elif keyword not in _IGNORED:
                raise UnsupportedKeyword(f"unsupported schema keyword {keyword!r}")

    def _target(self, ref: str) -> dict:
        if not ref.startswith("#/"):
            raise UnsupportedKeyword(f"only local references are supported, not {ref!r}")
        found: Any = self.root
        for part in ref[2:].split("/"):
            found = found[part]
        return found

    @staticmethod
    def _below(at: str, key: object) -> str:
        return f"{at}{key}" if at.endswith("/") else f"{at}/{key}"

    def _type(self, rule, value, at):
        kinds = rule if isinstance(rule, list) else [rule]
        if not any(_is(value, k) for k in kinds):
            wanted = f"one or more of the following types: {', '.join(kinds)}" if isinstance(rule, list) else f"the following type: {rule}"
            yield at, f"The property '{at}' of type {_kind(value)} did not match {wanted}"

    def _required(self, rule, value, at):
        if isinstance(value, dict):
            for name in rule:
                if name not in value:
                    yield at, f"The property '{at}' did not contain a required property of '{name}'"

    def _properties(self, rule, value, at):
        if isinstance(value, dict):
            for name, sub in rule.items():
                if name in value:
                    yield from self._walk(sub, value[name], self._below(at, name))

    def _items(self, rule, value, at):
        if isinstance(rule, list):
            raise UnsupportedKeyword("tuple items are not supported")
        if isinstance(value, list):
            for i, one in enumerate(value):
                yield from self._walk(rule, one, self._below(at, i))

    def _min_items(self, rule, value, at):
        if isinstance(value, list) and len(value) < rule:
            yield at, f"The property '{at}' did not contain a minimum number of items {rule}"

    def _enum(self, rule, value, at):
        if not any(value == v and type(value) is type(v) for v in rule):
            yield at, f"The property '{at}' value {value!r} did not match one of the following values: {', '.join(map(str, rule))}"

    def _const(self, rule, value, at):
        if self.enforce_const and value != rule:
            yield at, f"The property '{at}' value {value!r} did not match constant '{rule}'"

    def _max_length(self, rule, value, at):
        if isinstance(value, str) and len(value) > rule:
            yield at, f"The property '{at}' was not of a maximum string length of {rule}"

    def _min_length(self, rule, value, at):
        if isinstance(value, str) and len(value) < rule:
            yield at, f"The property '{at}' was not of a minimum string length of {rule}"

    def _minimum(self, rule, value, at):
        if _is(value, "number") and value < rule:
            yield at, f"The property '{at}' did not have a minimum value of {rule}, inclusively"

    def _format(self, rule, value, at):
        if rule not in _FORMATS:
            raise UnsupportedKeyword(f"unsupported format {rule!r}")
        if isinstance(value, str) and not _FORMATS[rule](value):
            yield at, f"The property '{at}' must be a valid {'URI' if rule == 'uri' else 'RFC3339 date/time string'}"

    def _any_of(self, rule, value, at):
        if not any(next(self._walk(one, value, at), None) is None for one in rule):
            yield at, f"The property '{at}' of type {_kind(value)} did not match one or more of the required schemas"
