"""Dotted paths into VARIANT documents, and the number and text forms of what they find.

A path is keys and list positions joined by dots, e.g. ``by_host.buckets.0.doc_count``.
A missing path (SQL NULL) is kept apart from an explicit JSON null (variant null).
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# characters that mean something other than a key or a position in a search path
PATH_SPECIALS = r"[\\*?|#@!{}\[\]()'\"=<>%~:]"
_KIND = {"ARRAY": "array", "OBJECT": "object", "STRING": "string", "BOOLEAN": "boolean", "VOID": "null", "": "number"}
_NUMBER_TEXT = r"^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$"
_SPECIAL_TEXT = r"(?i)^[+-]?(inf|infinity|nan)$"


def path_is_plain(path: Column) -> Column:
    return (path != "") & ~path.rlike(PATH_SPECIALS) & ~path.rlike(r"(^\.)|(\.$)|(\.\.)")


def variant_path(path: Column) -> Column:
    """``a.b.0.c`` to ``$['a']['b'][0]['c']``; NULL when the path is not plain."""
    steps = F.transform(
        F.split(path, r"\."),
        lambda s: F.when(s.rlike(r"^\d+$"), F.concat(F.lit("["), s, F.lit("]"))).otherwise(
            F.concat(F.lit("['"), s, F.lit("']"))
        ),
    )
    return F.when(path_is_plain(path), F.concat(F.lit("$"), F.array_join(steps, "")))


def path_text(path: str) -> str:
    """:func:`variant_path` for one path at plan time."""
    steps = path.split(".")
    if not all(steps) or re.search(PATH_SPECIALS, path):
        raise ValueError(f"path {path!r} is not made of plain keys and positions")
    return "$" + "".join(f"[{s}]" if s.isdigit() else f"['{s}']" for s in steps)


def key_path(path: Column) -> Column:
    """:func:`variant_path` with numbers as object keys; NULL when the path has none."""
    quoted = F.transform(F.split(path, r"\."), lambda s: F.concat(F.lit("['"), s, F.lit("']")))
    return F.when(path_is_plain(path) & path.rlike(r"(^|\.)\d+(\.|$)"), F.concat(F.lit("$"), F.array_join(quoted, "")))


def lookup(v: Column, path: Column, keys: Column) -> Column:
    """The value at a translated path: numbers are positions, or else keys."""
    return F.coalesce(F.try_variant_get(v, path, "variant"), F.try_variant_get(v, keys, "variant"))


def extract(doc: Column, path: str) -> Column:
    """The value at a dotted path, as VARIANT; SQL NULL when there is nothing at the path.

    A number is a position in an array, or else a key of an object.
    """
    path_text(path)
    out, plain = doc, "$"
    for step in path.split("."):
        if step.isdigit():
            at = out if plain == "$" else F.try_variant_get(out, plain, "variant")
            out, plain = F.coalesce(F.try_variant_get(at, f"$[{step}]", "variant"), F.try_variant_get(at, f"$['{step}']", "variant")), "$"
        else:
            plain += f"['{step}']"
    return out if plain == "$" else F.try_variant_get(out, plain, "variant")


def variant_kind(v: Column) -> Column:
    """``number``, ``string``, ``boolean``, ``null``, ``array`` or ``object``; NULL when missing."""
    # the leading word of the schema text; every other type a variant holds is a number
    word = F.regexp_extract(F.schema_of_variant(v), r"^(ARRAY|OBJECT|STRING|BOOLEAN|VOID)?", 1)
    return F.element_at(F.create_map(*[F.lit(x) for kv in _KIND.items() for x in kv]), word)


def text_to_double(text: Column) -> Column:
    """Strict number text to DOUBLE; NULL for anything else, including padded text."""
    # a number too large for a DOUBLE is refused, infinity by name is not
    number = F.nullif(F.abs(F.when(text.rlike(_NUMBER_TEXT), text.try_cast("double"))), F.lit(float("inf")))
    sign = F.when(text.startswith("-"), -1.0).otherwise(1.0)
    special = F.when(text.rlike(_SPECIAL_TEXT), F.when(F.lower(text).contains("nan"), float("nan")).otherwise(float("inf")))
    return sign * F.coalesce(number, special)


def as_double(v: Column) -> Column:
    """Number as is, numeric text parsed, true 1, everything else 0; NULL only when missing."""
    text = F.try_variant_get(v, "$", "string")
    return F.when(
        v.isNotNull(),
        F.coalesce(
            F.when(variant_kind(v) == "string", F.coalesce(text_to_double(text), F.lit(0.0))),
            F.try_variant_get(v, "$", "double"),
            F.lit(0.0),
        ),
    )


def was_coerced(v: Column) -> Column:
    """True where :func:`as_double` had to replace a value that is not a number."""
    kind = variant_kind(v)
    text_ok = text_to_double(F.try_variant_get(v, "$", "string")).isNotNull()
    return F.when(kind == "string", ~text_ok).otherwise(kind != "number")


def plain_number(text: Column) -> Column:
    """Number text without exponent and without trailing zeros."""
    exact = text.try_cast("decimal(38,18)").cast("string")
    fixed = F.when(text.rlike(r"[eE]") & exact.isNotNull(), exact).otherwise(text)
    return F.when(
        fixed.contains("."), F.regexp_replace(F.regexp_replace(fixed, r"0+$", ""), r"\.$", "")
    ).otherwise(fixed)


def as_label(v: Column) -> Column:
    """Label text of a value; NULL only when missing."""
    kind = variant_kind(v)
    text = F.try_variant_get(v, "$", "string")
    return (
        F.when(kind == "string", text)
        .when(kind == "number", plain_number(text))
        .when(kind == "boolean", text)
        .when(kind == "null", "")
        .when(kind.isNotNull(), F.to_json(v))
    )
