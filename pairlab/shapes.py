"""Shapes of nested options as tables, and the one function that compares values
with them.

A shape maps the keys a mapping may have to what their values must be; rules say
what must hold between keys. All problems are found, not only the first.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Mapping
from dataclasses import dataclass
from string import Formatter
from typing import Any


@dataclass(frozen=True)
class Value:
    """``fits`` tells good values and ``says`` what is wrong with others; ``shape``
    and ``each`` describe what is inside a mapping, or inside its values or a
    list's items."""

    fits: Callable[[Any], bool] = lambda value: True
    says: str = ""
    needed: bool = False
    shape: Shape | None = None
    each: Value | None = None


@dataclass(frozen=True)
class Shape:
    values: Mapping[str, Value]
    rules: tuple[tuple[Callable[[Mapping], bool], str], ...] = ()


def problems(value: Any, expected: Value, place: str) -> Iterator[str]:
    """What is wrong with ``value``, each with its place."""
    if not expected.fits(value):
        yield f"`{place}`: {expected.says.format(value=value)}"
        return
    if expected.each is not None:
        named = value.items() if isinstance(value, Mapping) else enumerate(value)
        for key, item in named:
            inner = f"{place}.{key}" if isinstance(value, Mapping) else f"{place}[{key}]"
            yield from problems(item, expected.each, inner)
    if expected.shape is None:
        return
    if not isinstance(value, Mapping):
        yield f"`{place}`: expected a mapping"
        return
    unknown = sorted(set(value) - set(expected.shape.values))
    if unknown:
        yield f"`{place}` does not know {unknown}"
    for key, inner in expected.shape.values.items():
        if value.get(key) is not None:
            yield from problems(value[key], inner, f"{place}.{key}")
        elif inner.needed:
            yield f"`{place}.{key}` is missing"
    for holds, says in expected.shape.rules:
        if not unknown and not holds(value):
            yield f"`{place}` {says}"


def _reads_as(kind: type) -> Callable[[Any], bool]:
    def fits(value: Any) -> bool:
        try:
            kind(value)
        except (TypeError, ValueError):
            return False
        return True

    return fits


def _is_template(value: Any) -> bool:
    try:
        return isinstance(value, str) and list(Formatter().parse(value)) is not None
    except ValueError:
        return False


def texts(value: Any) -> bool:
    return isinstance(value, list) and bool(value) and all(map(_is_text, value))


def _is_text(value: Any) -> bool:
    return isinstance(value, str)


def one_of(names: Any) -> Value:
    names = tuple(names)
    return Value(lambda value: value in names, f"{{value}} is none of {names}")


def items(each: Value, says: str) -> Value:
    """A list of at least one item."""
    return Value(lambda x: isinstance(x, list) and bool(x), says, each=each)


def mapping(each: Value | None = None) -> Value:
    return Value(lambda x: isinstance(x, Mapping), "expected a mapping", each=each)


ANY = Value()
TEXT = Value(_is_text, "expected a text")
WHOLE = Value(_reads_as(int), "{value!r} is no number")
REAL = Value(_reads_as(float), "{value!r} is no number")
TEMPLATE = Value(_is_template, "{value!r} is no valid template")


def refused(says: str) -> Value:
    """An option that can only be left out or switched off."""
    return Value(lambda value: not value, says)


def needed(value: Value) -> Value:
    return Value(value.fits, value.says, True, value.shape, value.each)


def option_name(name: Any) -> str:
    """A name as options may spell it: any case, with hyphens or underscores."""
    return "_".join(str(name).strip().casefold().split("-"))


def option_names(given: Iterable[Any] | str | None) -> tuple[str, ...]:
    """The names in a comma list, a list, or a list of comma lists."""
    lists = [given] if isinstance(given, str) else list(given or ())
    spelt = [name for some in lists for name in str(some).split(",")]
    return tuple(option_name(name) for name in spelt if not name.isspace() and name)
