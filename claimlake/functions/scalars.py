"""Scalar text rules as Column expressions: number text, display text, messages, scalar matching.

Everything stays on the JVM. Number text follows the ECMAScript rules the logs were written
with (10 rather than 10.0, 1e+21 rather than 1.0E21).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Longest operational message in a display, and the characters a trimmed text loses.
MESSAGE_MAX_CHARS = 2048
_BLANKS = "[\\s\\u00A0\\uFEFF\\u2028\\u2029]"
JSON_NUMBER = r"^-?(0|[1-9]\d*)(\.\d+)?([eE][+-]?\d+)?$"


def _strip_zeros(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"(\.\d*?)0+$", "$1"), r"\.$", "")


def js_number(d: Column) -> Column:
    """Text of a double. Plain digits between 1e-6 and 1e21, exponent form outside."""
    size = F.abs(d)
    raw = d.cast("string")
    sci = F.regexp_replace(
        F.regexp_replace(F.regexp_replace(raw, r"\.0E", "E"), "E-", "e-"), r"E(\d)", "e+$1"
    )
    return (
        F.when(d.isNull(), F.lit(None).cast("string"))
        .when(F.isnan(d), "NaN")
        .when(raw.contains("Infinity"), raw)
        .when(size == 0, "0")
        .when((size >= 1e-3) & (size < 1e7), _strip_zeros(raw))
        .when((size >= 1e7) & (size < 1e21), _strip_zeros(raw.cast("decimal(38,10)").cast("string")))
        .when((size >= 1e-6) & (size < 1e-3), _strip_zeros(F.format_string("%s", raw.cast("decimal(38,28)")).cast("string")))
        .otherwise(sci)
    )


def js_number_text(json_number: Column) -> Column:
    """Number text of a JSON number literal."""
    plain = json_number.rlike(r"^-?\d{1,15}$") | json_number.rlike(r"^-?\d{1,9}\.\d{0,5}[1-9]$")
    return F.when(plain & (json_number != "-0"), json_number).otherwise(js_number(json_number.try_cast("double")))


def js_trim(s: Column) -> Column:
    return F.regexp_replace(s, f"^{_BLANKS}+|{_BLANKS}+$", "")


def json_quote(s: Column) -> Column:
    """The JSON text of a string."""
    wrapped = F.to_json(F.array(s))
    return F.when(s.isNull(), F.lit(None).cast("string")).otherwise(
        wrapped.substr(F.lit(2), F.length(wrapped) - 2)
    )


def operational_message(raw: Column) -> Column:
    """One line: tabs and line ends become spaces, runs squeezed, trimmed. The whole text stays."""
    return F.trim(F.regexp_replace(F.regexp_replace(raw, "[\\t\\r\\n]", " "), " +", " "))


def display_message(raw: Column) -> Column:
    """The operational message as a display shows it: cut with an ellipsis at the longest length."""
    flat = operational_message(raw)
    return F.when(
        F.length(flat) > MESSAGE_MAX_CHARS,
        F.concat(F.substring(flat, 1, MESSAGE_MAX_CHARS - 3), F.lit("...")),
    ).otherwise(flat)


def iso_millis(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


# --- stored values -----------------------------------------------------------------------
# A stored value travels as text; its kind follows from the column type, known when planning.

def stored_kind(dtype: T.DataType) -> str:
    if isinstance(dtype, T.BooleanType):
        return "bool"
    if isinstance(dtype, (T.StringType, T.VarcharType, T.CharType)):
        return "str"
    if isinstance(dtype, T.NumericType):
        return "num"
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return "time"
    return "object"


def stored_text(col: Column, dtype: T.DataType) -> Column:
    kind = stored_kind(dtype)
    if kind == "num":
        if isinstance(dtype, T.IntegralType):
            return col.cast("string")
        return js_number(col.cast("double"))
    if kind == "time":
        return iso_millis(col.cast("timestamp"))
    if kind == "object":
        return F.when(col.isNotNull(), F.lit("[object]"))
    return col.cast("string")


def scalar_match(exp_type: Column, exp_text: Column, kind: Column, actual: Column) -> Column:
    """Does a stored value satisfy an expected scalar?

    exp_type is null/boolean/number/string, exp_text its text (strings unquoted); kind and
    actual describe the stored value. Rules are tried by expected type.
    """
    as_number = actual.try_cast("double")
    wanted = exp_text.try_cast("double")
    text = js_trim(exp_text)
    boolean = ((kind == "bool") & (actual == exp_text)) | (
        (kind == "num") & (as_number == F.when(exp_text == "true", F.lit(1.0)).otherwise(F.lit(0.0)))
    )
    number = ((kind == "num") & (as_number == wanted)) | (
        (kind == "str") & js_trim(actual).rlike(JSON_NUMBER) & (js_trim(actual).try_cast("double") == wanted)
    )
    string = (
        F.when(kind == "str", js_trim(actual) == text).otherwise(actual == text)
    )
    verdict = (
        F.when(exp_type == "null", actual.isNull())
        .when(actual.isNull(), F.lit(False))
        .when(exp_type == "boolean", boolean)
        .when(exp_type == "number", number)
        .otherwise(string)
    )
    return F.coalesce(verdict, F.lit(False))


def display_expected(exp_type: Column, exp_text: Column) -> Column:
    return F.when(exp_type == "null", F.lit("null")).when(exp_type == "string", json_quote(exp_text)).otherwise(exp_text)


def display_actual(kind: Column, actual: Column) -> Column:
    return (
        F.when(actual.isNull(), F.lit("null"))
        .when(kind.isin("num", "bool"), actual)
        .otherwise(json_quote(actual))
    )
