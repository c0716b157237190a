"""The mapping language: raw rows to prompt and completion columns.

A mapping is compiled once on the driver into plain column expressions; the
executors run generated code. Unknown template fields fail while the plan is
built, before any data is read.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from string import Formatter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.paths import quoted, resolve
from ..functions.text import as_text, strip

LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
DEFAULT_ITEM_FORMAT = "{label}. {text}"


def template_fields(template: str) -> list[tuple[str, str | None]]:
    """Literal text and the field after it, in order."""
    pieces = []
    for literal, field, spec, conversion in Formatter().parse(template):
        if spec or conversion:
            raise ValueError(
                f"Format specs and conversions are not supported: {template!r}"
            )
        pieces.append((literal, field))
    return pieces


def render(template: str, fields: Mapping[str, Column], name: str) -> Column:
    """``{field}`` template as one ``concat``; ``{{`` and ``}}`` are braces."""
    parts: list[Column] = []
    for literal, field in template_fields(template):
        if literal:
            parts.append(F.lit(literal))
        if field is None:
            continue
        if field not in fields:
            raise ValueError(f"`{name}` uses `{field}`, which no column or path provides")
        parts.append(fields[field])
    return F.concat(*parts) if parts else F.lit("")


class _Fields(dict):
    """Normalised source columns overlaid with computed ones; a dotted name that
    is no column is a path into the raw row."""

    def __init__(self, df: DataFrame, computed: Mapping[str, Column]):
        super().__init__()
        self._df = df
        for field in df.schema.fields:
            self[field.name] = as_text(quoted(field.name), field.dataType)
        self.update(computed)

    def __contains__(self, name: object) -> bool:
        return super().__contains__(name) or self._nested(name) is not None

    def __missing__(self, name: str) -> Column:
        found = self._nested(name)
        if found is None:
            raise KeyError(name)
        return found

    def _nested(self, name: object) -> Column | None:
        if not isinstance(name, str) or "." not in name:
            return None
        col, dtype = resolve(self._df, name)
        return None if dtype is None else as_text(col, dtype)


def _has_text(fields: Mapping[str, Column], name: str) -> Column:
    if name not in fields:
        return F.lit(False)
    return fields[name] != ""


def part_condition(part: Mapping, fields: Mapping[str, Column]) -> Column:
    """Whether a prompt part is rendered: ``when_field``, ``when_any`` and
    ``when_all`` all have to hold."""
    condition = F.lit(True)
    if part.get("when_field") is not None:
        condition = condition & _has_text(fields, str(part["when_field"]))
    if part.get("when_any") is not None:
        anything = F.lit(False)
        for name in part["when_any"]:
            anything = anything | _has_text(fields, str(name))
        condition = condition & anything
    for name in part.get("when_all") or []:
        condition = condition & _has_text(fields, str(name))
    return condition


def join_parts(parts: Sequence[Column], joiner: str) -> Column:
    """Join the non-empty parts; nulls and empty strings leave no joiner."""
    return F.concat_ws(joiner, *[F.nullif(part, F.lit("")) for part in parts])


def _filled(col: Column, dtype: T.DataType) -> Column:
    """Neither null, blank nor an empty collection; 0 and False count as filled."""
    if isinstance(dtype, T.StringType):
        return strip(col) != ""
    if isinstance(dtype, (T.ArrayType, T.MapType)):
        return F.size(col) > 0
    if isinstance(dtype, T.VariantType):
        text = F.try_variant_get(col, "$", "string")
        return ~F.coalesce(F.is_variant_null(col), F.lit(True)) & (
            ~strip(text).isin("", "[]", "{}")
        )
    return col.isNotNull()


def first_non_empty(df: DataFrame, paths: Sequence[str]) -> Column:
    found = []
    for path in paths:
        col, dtype = resolve(df, path)
        if dtype is not None:
            found.append(F.when(_filled(col, dtype), as_text(col, dtype)))
    return F.coalesce(*found, F.lit(""))


def _cycled_letter(index: Column) -> Column:
    return F.substring(F.lit(LETTERS), index % len(LETTERS) + 1, F.lit(1))


def format_choices(
    df: DataFrame,
    text_field: str | Sequence[str],
    label_field: str | None = None,
    item_format: str = DEFAULT_ITEM_FORMAT,
    joiner: str = "\n",
) -> Column:
    """Labelled lines from one list column or from several scalar paths.

    Labels come from ``label_field`` where it is a list of the same length,
    otherwise letters A to Z, starting over after Z.
    """
    if isinstance(text_field, str):
        texts, dtype = resolve(df, text_field)
        if isinstance(dtype, T.VariantType):
            texts = texts.try_cast("array<variant>")
            dtype = T.ArrayType(T.VariantType())
        if not isinstance(dtype, T.ArrayType):
            return F.lit("")
        element = dtype.elementType
        texts = F.transform(texts, lambda item: as_text(item, element))
    else:
        resolved = [resolve(df, path) for path in text_field]
        texts = F.array(*[as_text(col, dtype) for col, dtype in resolved])
    letters = F.transform(texts, lambda _, at: _cycled_letter(at))
    labels = letters
    if label_field:
        given, dtype = resolve(df, label_field)
        if isinstance(dtype, T.VariantType):
            given = given.try_cast("array<variant>")
            dtype = T.ArrayType(T.VariantType())
        if isinstance(dtype, T.ArrayType):
            element = dtype.elementType
            given = F.transform(given, lambda item: _label_text(item, element))
            labels = F.when(F.size(given) == F.size(texts), given).otherwise(letters)

    def line(label: Column, text: Column) -> Column:
        return render(item_format, {"label": label, "text": text}, "item_format")

    return F.coalesce(F.array_join(F.zip_with(labels, texts, line), joiner), F.lit(""))


def _label_text(item: Column, dtype: T.DataType) -> Column:
    """Labels keep their blanks; a null label reads ``None``."""
    if isinstance(dtype, T.StringType):
        return F.coalesce(item, F.lit("None"))
    return F.when(item.isNull(), F.lit("None")).otherwise(as_text(item, dtype))


def whole_number(col: Column, dtype: T.DataType) -> Column:
    """Integer behind a value the way ``int()`` reads it: numbers are cut towards
    zero, strings must be digits; null otherwise."""
    if isinstance(dtype, T.VariantType):
        col, dtype = F.try_variant_get(col, "$", "string"), T.StringType()
    if isinstance(dtype, T.StringType):
        text = strip(col)
        digits = F.regexp_replace(text, r"(?<=\d)_(?=\d)", "")
        return F.when(digits.rlike(r"^[+-]?\d+$"), digits.try_cast("bigint"))
    if isinstance(dtype, T.BooleanType):
        return col.cast("bigint")
    if isinstance(dtype, (T.DoubleType, T.FloatType)):
        return F.when(~F.isnan(col), col.try_cast("bigint"))
    if isinstance(dtype, T.NumericType):
        return col.try_cast("bigint")
    return F.lit(None).cast("bigint")


def index_value(col: Column, dtype: T.DataType | None) -> Column:
    """Zero-based position named by an integer or by one ASCII letter."""
    if dtype is None:
        return F.lit(None).cast("bigint")
    number = whole_number(col, dtype)
    if isinstance(dtype, T.VariantType):
        col, dtype = F.try_variant_get(col, "$", "string"), T.StringType()
    if not isinstance(dtype, T.StringType):
        return number
    letter = F.when(
        col.rlike("^[A-Za-z]$") & (F.length(col) == 1),
        (F.ascii(F.upper(col)) - 65).cast("bigint"),
    )
    return F.coalesce(number, letter)


def lookup_index(
    df: DataFrame,
    index: str,
    list: str | None = None,  # noqa: A002 - the recipe's key
    labels: Sequence | None = None,
    as_letter: bool = False,
) -> Column:
    """Item at a position: a letter, one of ``labels``, or an element of the list
    behind the ``list`` path. Out of range or unreadable gives ``""``."""
    at = index_value(*resolve(df, index))
    if as_letter:
        inside = (at >= 0) & (at < len(LETTERS))
        start = F.when(inside, at.cast("int") + 1)
        return F.coalesce(
            F.substring(F.lit(LETTERS), start, F.lit(1)), F.lit("")
        )
    if labels is not None:
        texts = ["" if v is None else str(v).strip() for v in labels]
        items, element = F.array(*[F.lit(v) for v in texts]), T.StringType()
    else:
        items, dtype = resolve(df, list) if list else (F.lit(None), None)
        if isinstance(dtype, T.VariantType):
            items = items.try_cast("array<variant>")
            dtype = T.ArrayType(T.VariantType())
        if not isinstance(dtype, T.ArrayType):
            return F.lit("")
        element = dtype.elementType
    inside = (at >= 0) & (at < F.size(items))
    picked = F.try_element_at(items, F.when(inside, at.cast("int") + 1))
    return as_text(picked, element)


COMPUTED = {
    "first_non_empty": lambda df, spec: first_non_empty(df, spec),
    "format_choices": lambda df, spec: format_choices(df, **spec),
    "lookup_index": lambda df, spec: lookup_index(df, **spec),
}


def computed_fields(df: DataFrame, specs: Mapping[str, Mapping]) -> dict[str, Column]:
    """All computed fields, each read from the raw row: they cannot see one
    another, and they hide source columns of the same name."""
    fields = {}
    for name, spec in specs.items():
        ((kind, options),) = spec.items()
        fields[str(name)] = strip(COMPUTED[kind](df, options))
    return fields


def format_records(
    df: DataFrame, mapping: Mapping, keep: Sequence[str] = ()
) -> DataFrame:
    """``prompt`` and ``completion`` of every row, plus the ``keep`` columns."""
    fields = _Fields(df, computed_fields(df, mapping.get("computed_fields") or {}))
    template = mapping.get("prompt_template")
    if isinstance(template, str):
        prompt = render(template, fields, "prompt_template")
    else:
        parts = []
        for at, part in enumerate(mapping.get("prompt_parts") or []):
            label = f"prompt_parts[{at}]"
            if isinstance(part, str):
                parts.append(render(part, fields, label))
            else:
                text = render(part["template"], fields, label)
                parts.append(F.when(part_condition(part, fields), text))
        joiner = str(mapping.get("prompt_joiner", "\n\n"))
        prompt = join_parts(parts, joiner)
    completion = render(
        mapping["completion_template"], fields, "completion_template"
    )
    return df.select(
        *[quoted(c) for c in keep],
        prompt.alias("prompt"),
        completion.alias("completion"),
    )
