"""Typed access to JSON text through VARIANT: pointers, types, canonical text."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from claimlake.functions.scalars import js_number_text

_INDEX = re.compile(r"^(0|[1-9]\d*)$")


def _key_step(segment: str) -> str:
    return f"['{segment}']" if '"' in segment else f'["{segment}"]'


def pointer_paths(pointer: str) -> tuple[str, str]:
    """JSON Pointer -> variant paths. A digit segment may be an index or a key, so two paths come back."""
    if pointer in ("", "/"):
        return "$", "$"
    segments = [s.replace("~1", "/").replace("~0", "~") for s in pointer.lstrip("/").split("/")]
    indexed = "".join(f"[{s}]" if _INDEX.match(s) else _key_step(s) for s in segments)
    keyed = "".join(_key_step(s) for s in segments)
    return "$" + indexed, "$" + keyed


def parse(text: Column) -> Column:
    return F.try_parse_json(text)


def variant_at(variant: Column, path: Column, alt: Column) -> Column:
    """The value at a path that may differ per row; null when nothing is there."""
    def at(p: Column) -> Column:
        return F.call_function("variant_get", variant, p, F.lit("variant"))

    return F.coalesce(at(path), F.when(alt.isNotNull(), at(alt)))


#: Paths that are written out; any others are parsed again for every value.
KNOWN_PATHS = 32


def known_at(variant: Column, path: Column, known: list[str]) -> Column:
    """The value at a path that may differ per row. Paths among the known ones are compiled once."""
    at = lambda p: F.call_function("variant_get", variant, p, F.lit("variant"))
    out = None
    for p in known[:KNOWN_PATHS]:
        out = (F if out is None else out).when(path == p, at(F.lit(p)))
    return at(path) if out is None else out.otherwise(at(path))


def json_at(variant: Column, path: Column, alt: Column) -> Column:
    """JSON text at a path; 'null' for JSON null."""
    return F.to_json(variant_at(variant, path, alt))


def variant_kind(schema: Column) -> Column:
    """missing / null / boolean / number / string / object / array from schema_of_variant text."""
    return (
        F.when(schema.isNull(), "missing")
        .when(schema == "STRING", "string")
        .when(schema == "VOID", "null")
        .when(schema == "BOOLEAN", "boolean")
        .when(schema.startswith("OBJECT"), "object")
        .when(schema.startswith("ARRAY"), "array")
        .otherwise("number")
    )


def json_type(text: Column) -> Column:
    """missing / null / boolean / number / string / object / array, read off the JSON text."""
    head = F.substring(text, 1, 1)
    return (
        F.when(text.isNull(), "missing")
        .when(head == '"', "string")
        .when(head == "{", "object")
        .when(head == "[", "array")
        .when(head.isin("t", "f"), "boolean")
        .when(head == "n", "null")
        .otherwise("number")
    )


def json_unquote(text: Column) -> Column:
    """The characters of a JSON string literal."""
    return F.when(
        text.contains("\\"), F.call_function("variant_get", F.try_parse_json(text), F.lit("$"), F.lit("string"))
    ).otherwise(text.substr(F.lit(2), F.length(text) - 2))


def scalar_text(text: Column) -> Column:
    """What String(x) gives for a JSON scalar."""
    kind = json_type(text)
    return F.when(kind == "string", json_unquote(text)).when(kind == "number", js_number_text(text)).otherwise(text)


def canonical(text: Column) -> Column:
    """Canonical JSON: keys sorted, no spaces, one text per value."""
    return F.to_json(F.try_parse_json(text))


def pointer_value(doc: Column, pointer: str) -> Column:
    """JSON text at a fixed pointer of a JSON text column."""
    path, alt = pointer_paths(pointer)
    variant = parse(doc)
    return json_at(variant, F.lit(path), F.lit(alt))
