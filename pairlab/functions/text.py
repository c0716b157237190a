"""Text expressions: normalisation, stringification, word and number extraction.

Everything here is a ``Column -> Column`` built from JVM-side functions, so it
stays inside whole-stage code generation and can be used in any ``select``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The characters Python's ``str.strip`` removes.
BLANKS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
# The same set as a regex class that both Java and RE2 read alike.
BLANK_CLASS = (
    r"[\t\n\x0B\f\r\x1C-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
    r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
)
# A word is a run of letters, numbers and underscores; a number
# may carry thousands separators and a fraction.
WORD = r"[\p{L}\p{N}_]+"
NUMBER = r"-?\p{Nd}+(?:,\p{Nd}{3})*(?:\.\p{Nd}+)?"


def strip(col: Column) -> Column:
    """Trim the blanks Python trims. One linear pass, no regex backtracking."""
    return F.btrim(col, F.lit(BLANKS))


def float_text(col: Column) -> Column:
    """A double written the way Python writes it.

    Java switches to exponents below 1e-3 and from 1e7, Python below 1e-4 and
    from 1e16, and Python pads the exponent to two digits.
    """
    value = col.cast("double")
    raw = value.cast("string")
    size = F.abs(value)
    plain = value.try_cast("decimal(38,21)").cast("string")
    plain = F.regexp_replace(plain, r"(\.\d+?)0+$", "$1")
    mantissa = F.regexp_replace(F.substring_index(raw, "E", 1), r"\.0$", "")
    power = F.substring_index(raw, "E", -1).try_cast("int")
    exponent = F.concat(
        F.when(power < 0, "e-").otherwise("e+"),
        F.lpad(F.abs(power).cast("string"), 2, "0"),
    )
    exponent = F.when(
        F.abs(power) > 99,
        F.concat(
            F.when(power < 0, "e-").otherwise("e+"), F.abs(power).cast("string")
        ),
    ).otherwise(exponent)
    return (
        F.when(F.isnan(value), "nan")
        .when(value == float("inf"), "inf")
        .when(value == float("-inf"), "-inf")
        .when(~F.contains(raw, F.lit("E")), raw)
        .when((size >= 1e-4) & (size < 1e16), plain)
        .otherwise(F.concat(mantissa, exponent))
    )


def as_text(col: Column, dtype: T.DataType | None) -> Column:
    """Value to stripped string, null to the empty string."""
    if dtype is None or isinstance(dtype, T.NullType):
        return F.lit("")
    if isinstance(dtype, T.StringType):
        text = col
    elif isinstance(dtype, T.BooleanType):
        text = F.initcap(col.cast("string"))
    elif isinstance(dtype, (T.DoubleType, T.FloatType)):
        text = float_text(col)
    elif isinstance(dtype, (T.ArrayType, T.MapType, T.StructType)):
        text = F.to_json(col)
    elif isinstance(dtype, T.VariantType):
        text = F.try_variant_get(col, "$", "string")
    else:
        text = col.cast("string")
    return F.coalesce(strip(text), F.lit(""))


def prompt_hash(col: Column) -> Column:
    """SHA-256 of the UTF-8 bytes, lower-case hex."""
    return F.sha2(col, 256)


def dataset_key(col: Column) -> Column:
    return F.translate(F.lower(strip(col)), "-_ ", "")


def slug(col: Column) -> Column:
    dashed = F.regexp_replace(F.lower(strip(col)), "[^a-z0-9]+", "-")
    return F.btrim(dashed, F.lit("-"))


def short_model_name(col: Column) -> Column:
    """Last path segment, ``-`` where there is no name."""
    name = F.coalesce(col, F.lit(""))
    return F.when(name == "", "-").otherwise(F.substring_index(name, "/", -1))


def coerce_int(col: Column) -> Column:
    return strip(col.cast("string")).try_cast("bigint")


def coerce_float(col: Column) -> Column:
    value = strip(col.cast("string")).try_cast("double")
    return F.when(~F.isnan(value), value)


def finite(col: Column) -> Column:
    """Finite double or null."""
    value = col.try_cast("double")
    return F.when(~F.isnan(value) & (F.abs(value) != float("inf")), value)


def normalize(col: Column) -> Column:
    """Lower case, stripped, runs of blanks as one space."""
    return F.regexp_replace(strip(F.lower(col)), BLANK_CLASS + "+", " ")


def normalize_sql(col: Column) -> Column:
    return F.rtrim(normalize(col), F.lit(";"))


def words(col: Column) -> Column:
    """Lower-case words. Blanks never belong to a word, so they need no
    collapsing first."""
    return F.regexp_extract_all(F.lower(col), F.lit(WORD), 0)


def last_number(col: Column) -> Column:
    """Last number in the text without its commas, null where there is none."""
    found = F.regexp_extract_all(col, F.lit(NUMBER), 0)
    return F.replace(F.try_element_at(found, F.lit(-1)), F.lit(","), F.lit(""))
