"""Tool registry: what rows each tool's claims imply.

The registry file is a JSON array of entries (toolId, effectDescriptionTemplate, verification).
It is loaded once, its pointers compiled to variant paths, and it becomes a table with one row
per (tool, check) that claims join to. Adding tools adds rows, not plan nodes.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimlake.functions.jsonval import pointer_paths
from claimlake.session import stored

_STR = T.StringType()


def _struct(**fields) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields.items()])


# One name or value a check needs: a constant or a pointer. Pairs also carry the compared value (v_*).
SPEC = _struct(
    role=_STR, ord=T.IntegerType(), side=_STR, label=_STR, const=_STR, path=_STR, alt=_STR, pointer=_STR,
    v_const=_STR, v_path=_STR, v_alt=_STR, v_pointer=_STR,
)
PART = _struct(const=_STR, path=_STR, alt=_STR)
CHECK_SCHEMA = _struct(
    tool_id=_STR, tool_kind=_STR, check_ord=T.IntegerType(), check_id=_STR, check_kind=_STR, n_checks=T.IntegerType(), prefix=_STR,
    static_code=_STR, static_message=_STR, specs=T.ArrayType(SPEC), fields_path=_STR, fields_alt=_STR,
    fn=_STR, expect_op=_STR, template=T.ArrayType(PART),
)
# A check whose table and column names are all constants: only compared values depend on the claim.
VALUE = _struct(role=_STR, ord=T.IntegerType(), column=_STR, label=_STR, const=_STR, path=_STR, alt=_STR, pointer=_STR)
FIXED_SCHEMA = _struct(
    tool_id=_STR, tool_kind=_STR, check_ord=T.IntegerType(), check_id=_STR, check_kind=_STR, n_checks=T.IntegerType(), prefix=_STR,
    static_ord=T.IntegerType(), static_code=_STR, static_message=_STR, table_name=_STR, lookup_table=_STR, name_list=T.ArrayType(_STR),
    fixed_values=T.ArrayType(VALUE), binding=_STR, fields_path=_STR, fields_pointer=_STR, fn=_STR, expect_op=_STR,
    expect_const=T.DoubleType(), expect_path=_STR, expect_pointer=_STR, template=T.ArrayType(PART),
)
IDENTIFIER = re.compile(r"^[a-zA-Z_][a-zA-Z0-9_]*$")
# Order in which problems of a check are reported, by role.
ROLE_ORDER = {"table": 0, "name": 100, "identity": 200, "filter": 300, "filter2": 400, "fields": 600, "expect": 800}


def _scalar_text(value) -> str:
    if value is None:
        return "null"
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, float) and value.is_integer() and abs(value) < 1e21:
        return str(int(value))
    return str(value)


def _source(raw: dict, label: str, head: str = "") -> dict:
    """const, or the compiled pointer; `head` names the columns of a pair's value."""
    if "pointer" in raw:
        path, alt = pointer_paths(raw["pointer"])
        found = {"const": None, "path": path, "alt": alt if alt != path else None, "pointer": raw["pointer"]}
    else:
        found = {"const": _scalar_text(raw["const"]), "path": None, "alt": None, "pointer": None}
    return {head + k: v for k, v in found.items()} | ({} if head else {"label": label})


def _spec(role: str, i: int, raw: dict, label: str, value: dict | None = None, side: str | None = None) -> dict:
    blank = {n: None for n in SPEC.names}
    spec = blank | {"role": role, "ord": ROLE_ORDER[role] + i, "side": side} | _source(raw, label)
    return spec | (_source(value, "", "v_") if value is not None else {})


def _pairs(role: str, raw: list | None, label: str) -> list[dict]:
    return [_spec(role, i, p["column"], f"{label}[{i}]", p["value"], p.get("tableSide")) for i, p in enumerate(raw or [])]


def _template(text: str) -> list[dict]:
    """Split an effect description into literal parts and {/pointer} parts."""
    parts = []
    for piece in re.split(r"(\{/[^{}]+\})", text):
        if re.fullmatch(r"\{/[^{}]+\}", piece):
            path, alt = pointer_paths(piece[1:-1])
            parts.append({"const": None, "path": path, "alt": alt})
        elif piece:
            parts.append({"const": piece, "path": None, "alt": None})
    return parts


def _check(item: dict, kind: str) -> dict:
    named = lambda role, *keys: [_spec(role, i, item[k], k) for i, k in enumerate(keys)]
    out: dict = {"fn": item.get("fn")}
    if kind in ("sql_row", "sql_row_absent"):
        specs = named("table", "table") + _pairs("identity", item["identityEq"], "identityEq") + _pairs("filter", item.get("filterEq"), "filterEq")
        if kind == "sql_row":
            fields = _spec("fields", 0, item["requiredFields"], "requiredFields")
            specs.append(fields)
            out |= {"fields_path": fields["path"], "fields_alt": fields["alt"]}
    elif kind == "related_exists":
        specs = named("table", "childTable") + _pairs("identity", item["matchEq"], "identityEq")
    elif kind == "aggregate":
        specs = named("table", "table") + _pairs("filter", item.get("whereEq"), "whereEq")
        if item["fn"] == "SUM" and item.get("sumColumn"):
            specs += named("name", "sumColumn")
    elif kind == "join_count":
        specs = named("table", "leftTable", "rightTable") + _pairs("filter", item.get("whereEq"), "whereEq")
        specs += [_spec("name", i, item["join"][k], f"join.{k}") for i, k in enumerate(("leftColumn", "rightColumn"))]
    else:
        specs = named("table", "anchorTable", "lookupTable") + named("name", "anchorColumn", "lookupColumn", "lookupPresenceColumn")
        specs += _pairs("filter", item.get("filterEqAnchor"), "filterEqAnchor") + _pairs("filter2", item.get("filterEqLookup"), "filterEqLookup")
    if "expect" in item:
        specs.append(_spec("expect", 0, item["expect"]["value"], "expect.value"))
        out["expect_op"] = item["expect"]["op"]
    return out | {"specs": specs}


@dataclass(frozen=True)
class Registry:
    entries: list[dict]

    @staticmethod
    def from_json(text: str) -> "Registry":
        return Registry(json.loads(text))

    @staticmethod
    def load(spark: SparkSession, path: str) -> "Registry":
        """Read a registry file: a configuration document, not data."""
        return Registry.from_json(spark.read.text(path, wholetext=True).first()[0])

    def duplicate_tools(self) -> list[str]:
        seen, twice = set(), []
        for e in self.entries:
            if e["toolId"] in seen and e["toolId"] not in twice:
                twice.append(e["toolId"])
            seen.add(e["toolId"])
        return twice

    def check_rows(self) -> list[dict]:
        if self.duplicate_tools():
            raise ValueError(f"REGISTRY_DUPLICATE_TOOL_ID: {self.duplicate_tools()[0]}")
        rows = []
        blank = {n: None for n in CHECK_SCHEMA.names} | {"specs": []}
        for e in self.entries:
            v = e["verification"]
            kind = v["kind"]
            if kind == "sql_effects":
                items = [(i["id"], "sql_row", i, f"effects[{i['id']}].") for i in v["effects"]]
            elif kind == "sql_relational":
                items = [(c["id"], c["checkKind"], c, f"checks[{c['id']}].") for c in v["checks"]]
            else:
                items = [("", kind, v, "")]
            seen = set()
            for ord_, (check_id, check_kind, item, prefix) in enumerate(items):
                row = blank | _common(e, kind, items, ord_, check_id, check_kind, prefix)
                if check_id in seen:
                    row |= {"static_code": "DUPLICATE_EFFECT_ID", "static_message": f"Duplicate effect id in registry: {check_id}"}
                elif check_kind not in ("sql_row", "sql_row_absent", "related_exists", "aggregate", "join_count", "anti_join"):
                    row |= {"static_code": "UNSUPPORTED_VERIFICATION_KIND", "static_message": "unsupported verification kind"}
                else:
                    row |= _check(item, check_kind)
                seen.add(check_id)
                rows.append(row)
        return rows

    def checks(self, spark: SparkSession) -> DataFrame:
        """One row per (tool, check). It is a small file, so the optimizer knows its size and picks the join."""
        return stored(spark.createDataFrame(self.check_rows(), CHECK_SCHEMA).coalesce(1))

    def fixed_checks(self, spark: SparkSession) -> DataFrame:
        """The checks of a registry without pointer-driven names, with everything fixed worked out once."""
        return stored(spark.createDataFrame([_fixed(r) for r in self.check_rows()], FIXED_SCHEMA).coalesce(1))

    def value_paths(self) -> list[str]:
        """Variant paths that claims are read at, those of most checks first."""
        found = Counter(p for r in self.check_rows() for s in [*r["specs"], *r["template"]] for p in (s.get("path"), s.get("v_path")) if p is not None)
        return [p for p, _ in sorted(found.items(), key=lambda x: (-x[1], x[0]))]

    def needs_discovery(self) -> bool:
        """True when a table or column name comes from the claims themselves."""
        named = ("table", "name", "identity", "filter", "filter2")
        return any(s["path"] is not None for r in self.check_rows() for s in r["specs"] if s["role"] in named)


def _common(entry, kind, items, ord_, check_id, check_kind, prefix) -> dict:
    return {
        "tool_id": entry["toolId"],
        "tool_kind": kind,
        "check_ord": ord_,
        "check_id": check_id,
        "check_kind": check_kind,
        "n_checks": len(items),
        "prefix": prefix,
        "template": _template(entry.get("effectDescriptionTemplate", "")),
    }


def _column(spec: dict, kind: str) -> str:
    return f"{spec['side']}.{spec['const']}" if kind == "join_count" and spec["side"] else spec["const"]


def _of(row: dict, role: str) -> list[dict]:
    return [s for s in row["specs"] if s["role"] == role]


def check_binding(row: dict) -> str | None:
    """Name of the keyed fact a check with constant names reads."""
    if row["static_code"]:
        return None
    kind = row["check_kind"]
    const = lambda role: [s["const"] for s in _of(row, role)]
    filters = sorted(_column(s, kind) for s in _of(row, "filter"))
    if kind == "join_count":
        parts = ["join", *const("table"), *const("name"), ",".join(filters)]
    elif kind == "anti_join":
        parts = ["orphan", *const("table"), *const("name"), ",".join(filters), ",".join(sorted(const("filter2")))]
    else:
        head = "row" if kind == "sql_row" else f"sum:{const('name')[0]}" if row["fn"] == "SUM" and const("name") else "count"
        parts = [head, *const("table"), ",".join(sorted(const("identity") + filters))]
    return "|".join(parts)


def _fixed_problem(row: dict) -> tuple[int, str, str] | None:
    """First problem that holds for every claim, with its place in emit order."""
    kind, prefix, found = row["check_kind"], row["prefix"], []
    taken = [s["const"] for s in _of(row, "identity")] if kind == "sql_row_absent" else []
    for s in row["specs"]:
        if s["const"] is None or s["role"] in ("fields", "expect"):
            continue
        pair = s["role"] in ("identity", "filter", "filter2")
        label = prefix + s["label"] + (".column" if pair else "")
        if s["const"] == "" and s["role"] != "table":
            found.append((s["ord"], "CONST_STRING_EMPTY", f"{label}: const must be non-empty string"))
        elif not IDENTIFIER.match(s["const"]):
            found.append((s["ord"], "INVALID_IDENTIFIER", f"{label}: {s['const']}"))
        elif s["role"] == "filter" and s["const"] in taken:
            found.append((s["ord"], "FILTER_EQ_OVERLAPS_IDENTITY", f"{prefix}filterEq column {s['const']} duplicates identityEq"))
    repeats = {"sql_row": [("identity", 299, "")], "related_exists": [("identity", 299, "")],
               "sql_row_absent": [("identity", 299, ""), ("filter", 500, "filterEq: ")],
               "anti_join": [("filter", 500, "filterEqAnchor: "), ("filter2", 501, "filterEqLookup: ")]}
    for role, place, label in repeats.get(kind, []):
        names = sorted(s["const"] for s in _of(row, role))
        twice = next((a for a, b in zip(names, names[1:]) if a == b), None)
        if twice:
            found.append((place, "EQUALITY_DUPLICATE_COLUMN", f"{prefix}{label}duplicate equality column: {twice}"))
    if kind == "aggregate" and row["fn"] == "SUM" and not _of(row, "name"):
        found.append((99, "RELATIONAL_SUM_COLUMN_REQUIRED", f"{prefix}sumColumn required when fn is SUM"))
    if row["static_code"]:
        found.append((-1, row["static_code"], row["static_message"]))
    return min(found) if found else None


def _fixed(row: dict) -> dict:
    kind = row["check_kind"]
    problem = _fixed_problem(row) or (None, None, None)
    tables, names = [s["const"] for s in _of(row, "table")], [s["const"] for s in _of(row, "name")]
    if kind == "anti_join":
        pairs = sorted(_of(row, "filter"), key=lambda s: s["const"]) + sorted(_of(row, "filter2"), key=lambda s: s["const"])
    else:
        pairs = sorted([*_of(row, "identity"), *_of(row, "filter")], key=lambda s: _column(s, kind))
    values = [
        {"role": s["role"], "ord": s["ord"], "column": _column(s, kind), "label": row["prefix"] + s["label"], "const": s["v_const"],
         "path": s["v_path"], "alt": s["v_alt"], "pointer": s["v_pointer"]}
        for s in pairs
    ]
    fields, expect = (_of(row, "fields") or [{}])[0], (_of(row, "expect") or [{}])[0]
    return {
        **{n: row[n] for n in ("tool_id", "tool_kind", "check_ord", "check_id", "check_kind", "n_checks", "prefix", "fn", "expect_op", "template")},
        "static_ord": problem[0], "static_code": problem[1], "static_message": problem[2],
        "table_name": tables[0] if tables else None, "lookup_table": tables[1] if len(tables) > 1 else None, "name_list": names,
        "fixed_values": values, "binding": check_binding(row), "fields_path": fields.get("path"), "fields_pointer": fields.get("pointer"),
        "expect_const": float(expect["const"]) if expect.get("const") is not None else None,
        "expect_path": expect.get("path"), "expect_pointer": expect.get("pointer"),
    }
