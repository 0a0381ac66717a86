"""State tables and the keyed facts that checks look up.

A binding names one pre-aggregation of state: its kind, tables and key columns. Every check kind
becomes a lookup of (binding, key): a row count, a sum, and for row checks the stored values.
State is first cut to the claimed keys, on the stored columns and their own types, and then aggregated
once for each table and set of key columns, whatever the number of claims and of bindings that share it.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from claimlake.functions.scalars import js_number, stored_kind, stored_text
from claimlake.operators.exact import exact_double_sum

FACT_SCHEMA = "binding string, key array<string>, n bigint, total double, payload map<string,string>"


def key_kind(dtype: T.DataType) -> str:
    if isinstance(dtype, T.IntegralType):
        return "int"
    if isinstance(dtype, T.DecimalType):
        return "dec"
    return stored_kind(dtype)


def key_text_stored(col: Column, dtype: T.DataType) -> Column:
    """Key text of a stored value, comparable with key_text_claimed."""
    kind = key_kind(dtype)
    if kind == "num":
        return js_number(col.cast("double"))
    if kind == "dec":
        return col.cast("decimal(38,10)").cast("string")
    if kind == "time":
        return F.unix_micros(col.cast("timestamp")).cast("string")
    return col.cast("string")


def key_native(text: Column, dtype: T.DataType) -> Column:
    """A claimed key's text as a value of the stored type; null, or a neighbour, where the type cannot hold it."""
    kind = key_kind(dtype)
    if kind == "time":
        return F.timestamp_micros(text.try_cast("bigint")).cast(dtype)
    return text if kind == "string" else text.try_cast(dtype)


def key_text_claimed(value: Column, kind: Column) -> Column:
    """Claimed key values are text; a text that does not fit the column type matches nothing."""
    exact = value.try_cast("decimal(38,10)")
    return (
        F.when(kind == "int", F.when(exact == F.floor(exact), F.floor(exact).cast("string")))
        .when(kind == "num", js_number(value.try_cast("double")))
        .when(kind == "dec", exact.cast("string"))
        .when(kind == "bool", value.try_cast("boolean").cast("string"))
        .when(kind == "time", F.unix_micros(value.try_cast("timestamp")).cast("string"))
        .otherwise(value)
    )


@dataclass
class State:
    """Declared state tables, by lower-cased name."""

    tables: dict[str, DataFrame]
    #: (table, column) -> whether its doubles are summed in bins, as far as asked.
    inexact: dict[tuple[str, str], bool] = field(default_factory=dict, repr=False, compare=False)

    @staticmethod
    def parquet(spark: SparkSession, base: str, names: list[str]) -> "State":
        return State({n: spark.read.parquet(f"{base}/{n}.parquet") for n in names})

    @staticmethod
    def jdbc(spark: SparkSession, url: str, names: list[str], **options: str) -> "State":
        """Read-only tables of a database the caller can reach."""
        return State({n: spark.read.format("jdbc").options(url=url, dbtable=n, **options).load() for n in names})

    def catalog(self, spark: SparkSession, keys: dict[str, dict] | None = None) -> DataFrame:
        """Table, column, type and declared key role. Parquet holds no keys, so they are declared."""
        rows = []
        for t, df in self.tables.items():
            declared = (keys or {}).get(t, {})
            for i, f in enumerate(df.schema.fields):
                fk = declared.get("foreign", {}).get(f.name)
                rows.append((t, f.name, i, f.dataType.simpleString(), f.name in declared.get("primary", []),
                             [f.name] in declared.get("unique", []), fk[0] if fk else None, fk[1] if fk else None))
        return spark.createDataFrame(
            rows, "table_name string, column_name string, position int, type string, is_primary boolean, is_unique boolean, ref_table string, ref_column string"
        )

    def dtype(self, table: str, column: str) -> T.DataType | None:
        df = self.tables.get(table)
        if df is None:
            return None
        found = {f.name.lower(): f.dataType for f in df.schema.fields}
        return found.get(column.lower())


def _list(text: str) -> list[str]:
    return [c for c in text.split(",") if c]


@dataclass(frozen=True)
class Binding:
    """One parsed binding name."""

    name: str
    kind: str
    tables: tuple[str, ...]
    names: tuple[str, ...]
    keys: tuple[tuple[str, str], ...]  # (table, column) per key position
    n_anchor_keys: int = 0

    @staticmethod
    def parse(name: str) -> "Binding":
        kind, *rest = name.split("|")
        if kind in ("row", "count") or kind.startswith("sum:"):
            table, cols = rest
            return Binding(name, kind, (table,), (), tuple((table, c) for c in _list(cols)))
        if kind == "join":
            left, right, lc, rc, cols = rest
            sides = {"left": left, "right": right}
            keys = tuple((sides[c.split(".")[0]], c) for c in _list(cols))
            return Binding(name, kind, (left, right), (lc, rc), keys)
        anchor, lookup, ac, lc, pc, fa, fl = rest
        keys = tuple((anchor, c) for c in _list(fa)) + tuple((lookup, c) for c in _list(fl))
        return Binding(name, kind, (anchor, lookup), (ac, lc, pc), keys, len(_list(fa)))

    def needed(self) -> list[tuple[str, str]]:
        out = [(t, c.split(".")[-1]) for t, c in self.keys]
        if self.kind.startswith("sum:"):
            out.append((self.tables[0], self.kind[4:]))
        if self.kind == "join":
            out += [(self.tables[0], self.names[0]), (self.tables[1], self.names[1])]
        if self.kind == "orphan":
            out += [(self.tables[0], self.names[0]), (self.tables[1], self.names[1]), (self.tables[1], self.names[2])]
        return out

    def readable(self, state: State) -> bool:
        return all(state.dtype(t, c) is not None for t, c in self.needed()) and all(t in state.tables for t in self.tables)

    def key_kinds(self, state: State) -> list[str]:
        return [key_kind(state.dtype(t, c.split(".")[-1])) for t, c in self.keys]


def _key(state: State, table: str, columns: list[str], prefix: str = "") -> Column:
    cols = [key_text_stored(F.col(prefix + c), state.dtype(table, c)) for c in columns]
    return F.array(*cols) if cols else F.array().cast("array<string>")


def _present(columns: list[str], prefix: str = "") -> Column:
    return reduce(lambda a, b: a & b, [F.col(prefix + c).isNotNull() for c in columns], F.lit(True))


def claimed_only(df: DataFrame, columns: list[str], wanted: DataFrame | None, texts: list[Column]) -> DataFrame:
    """Rows of df whose columns are among the claimed keys; `texts` give the key texts in wanted."""
    if wanted is None or not columns:
        return df
    kinds = {f.name.lower(): f.dataType for f in df.schema.fields}
    names = [f"claimed_{i}" for i in range(len(columns))]
    keys = wanted.select(*[key_native(t, kinds[c.lower()]).alias(n) for t, c, n in zip(texts, columns, names, strict=True)]).distinct()
    same = reduce(lambda a, b: a & b, [F.col(c) == F.col(n) for c, n in zip(columns, names, strict=True)])
    return df.join(keys, same, "left_semi")


def exact_sum(column: str, dtype: T.DataType) -> Column:
    """A sum that does not depend on the order of rows: whole numbers, decimals, and doubles that a decimal holds exactly."""
    if isinstance(dtype, T.IntegralType):
        return F.sum(F.col(column).cast("decimal(20,0)")).cast("double")
    if isinstance(dtype, T.DecimalType):
        return F.sum(column).cast("double")
    return F.sum(_as_decimal(column)).cast("double")


def _as_decimal(column: str) -> Column:
    return F.col(column).cast("double").try_cast("decimal(28,10)")


def _in_bins(state: State, table: str, column: str) -> bool:
    """Whether a column holds doubles that no decimal holds exactly, so that it is summed in bins. Looked up once for each column."""
    if not isinstance(state.dtype(table, column), T.DoubleType | T.FloatType):
        return False
    if (table, column) not in state.inexact:
        held = F.col(column).cast("double")
        inexact = held.isNotNull() & ~F.coalesce(_as_decimal(column).cast("double") == held, F.lit(False))
        state.inexact[table, column] = not state.tables[table].filter(inexact).isEmpty()
    return state.inexact[table, column]


def _table_facts(state: State, table: str, cols: list[str], bindings: list[Binding], wanted: DataFrame | None) -> DataFrame:
    """Facts of all bindings that look up `table` by `cols`: one scan, one aggregate over the typed key columns."""
    df = claimed_only(state.tables[table].filter(_present(cols)), cols, wanted, [F.col("key")[i] for i in range(len(cols))])
    sums = sorted({b.kind[4:] for b in bindings if b.kind.startswith("sum:")})
    fields = state.tables[table].schema.fields if any(b.kind == "row" for b in bindings) else []
    wanted_aggs = [F.count(F.lit(1)).alias("fact_n"), *[exact_sum(c, state.dtype(table, c)).alias(f"fact_sum_{i}") for i, c in enumerate(sums) if not _in_bins(state, table, c)]]
    if fields:
        wanted_aggs.append(F.any_value(F.struct(*[F.col(f"`{f.name}`") for f in fields])).alias("fact_v"))
    grouped = df.groupBy(*[F.col(c) for c in cols]).agg(*wanted_aggs)
    for i, c in enumerate(sums):
        if _in_bins(state, table, c):
            keyed, kept = (df, cols) if cols else (df.withColumn("fact_all", F.lit(1)), ["fact_all"])
            grouped = (grouped if cols else grouped.withColumn("fact_all", F.lit(1))).join(exact_double_sum(keyed, kept, F.col(c), f"fact_sum_{i}"), kept, "left")
    none, empty = F.lit(None).cast("double"), F.lit(None).cast("map<string,string>")
    entries = [x for f in fields for x in (F.lit(f.name.lower()), stored_text(F.col(f"fact_v.`{f.name}`"), f.dataType))]
    payload = F.when(F.col("fact_n") == 1, F.create_map(*entries)) if fields else empty
    rows = []
    for b in bindings:
        total = F.coalesce(f"fact_sum_{sums.index(b.kind[4:])}", F.lit(0.0)) if b.kind.startswith("sum:") else none
        rows.append(F.struct(F.lit(b.name).alias("binding"), F.col("fact_n").alias("n"), total.alias("total"), (payload if b.kind == "row" else empty).alias("payload")))
    key = _key(state, table, cols).alias("key")
    if len(rows) == 1:
        return grouped.select(*[rows[0][c].alias(c) for c in ("binding",)], key, *[rows[0][c].alias(c) for c in ("n", "total", "payload")])
    return grouped.select(key, F.inline(F.array(*rows))).select("binding", "key", "n", "total", "payload")


def _join_facts(state: State, b: Binding, wanted: DataFrame | None) -> DataFrame:
    """Joined row counts per filter key, without making the joined rows.

    Each side is counted per (join key, its own filter values) first, so a hot join key meets as
    one row per side and filter value, and the counts multiply.
    """
    lt, rt = b.tables
    lcols = [c.split(".")[1] for _, c in b.keys if c.startswith("left.")]
    rcols = [c.split(".")[1] for _, c in b.keys if c.startswith("right.")]

    def side(table: str, join_col: str, cols: list[str], first: int, tag: str) -> DataFrame:
        df = state.tables[table].filter(F.col(join_col).isNotNull() & _present(cols))
        df = claimed_only(df, cols, wanted, [F.col("key")[first + i] for i in range(len(cols))])
        grouped = df.groupBy(*[F.col(c) for c in dict.fromkeys([join_col, *cols])]).agg(F.count(F.lit(1)).alias(f"n_{tag}"))
        return grouped.select(key_text_stored(F.col(join_col), state.dtype(table, join_col)).alias("j"), _key(state, table, cols).alias(tag), f"n_{tag}")

    pairs = side(lt, b.names[0], lcols, 0, "l").join(side(rt, b.names[1], rcols, len(lcols), "r"), "j")
    return pairs.groupBy(F.concat("l", "r").alias("key")).agg(F.sum(F.col("n_l") * F.col("n_r")).alias("n")).select(
        "key", "n", F.lit(None).cast("double").alias("total"), F.lit(None).cast("map<string,string>").alias("payload")
    )


def orphan_parts(state: State, b: Binding, wanted: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """Anchor rows per anchor filter, and the correction per (anchor filter, lookup filter).

    Rows of `anchor LEFT JOIN lookup ON key AND lookup filter WHERE presence IS NULL` equal all anchor
    rows, less anchors that find a lookup row, plus found rows whose presence column is null.
    """
    at, lt = b.tables
    ac, lc, pc = b.names
    fa = [c for _, c in b.keys[: b.n_anchor_keys]]
    fl = [c for _, c in b.keys[b.n_anchor_keys:]]
    anchor_rows = claimed_only(state.tables[at].filter(_present(fa)), fa, wanted, [F.col("key")[i] for i in range(len(fa))])
    anchors = anchor_rows.groupBy(*[F.col(c) for c in dict.fromkeys([ac, *fa])]).agg(F.count(F.lit(1)).alias("n_a")).select(
        key_text_stored(F.col(ac), state.dtype(at, ac)).alias("j"), _key(state, at, fa).alias("a"), "n_a")
    lookup_rows = claimed_only(state.tables[lt].filter(F.col(lc).isNotNull() & _present(fl)), fl, wanted, [F.col("key")[len(fa) + i] for i in range(len(fl))])
    lookups = lookup_rows.groupBy(*[F.col(c) for c in dict.fromkeys([lc, *fl])]).agg(F.count_if(F.col(pc).isNull()).alias("absent")).select(
        key_text_stored(F.col(lc), state.dtype(lt, lc)).alias("j"), _key(state, lt, fl).alias("l"), "absent")
    everything = anchors.groupBy("a").agg(F.sum("n_a").alias("anchors"))
    found = anchors.join(lookups, "j").groupBy("a", "l").agg(
        F.sum("n_a").alias("found"), F.sum(F.col("n_a") * F.col("absent")).alias("absent")
    )
    return everything, found


def _orphan_facts(state: State, b: Binding, wanted: DataFrame | None) -> list[DataFrame]:
    everything, found = orphan_parts(state, b, wanted)
    none, empty = F.lit(None).cast("double").alias("total"), F.lit(None).cast("map<string,string>").alias("payload")
    named = F.lit(b.name).alias("binding")
    if b.n_anchor_keys == len(b.keys):
        merged = everything.join(found.select("a", "found", "absent"), "a", "left")
        left = F.col("anchors") - F.coalesce("found", F.lit(0)) + F.coalesce("absent", F.lit(0))
        return [merged.select(named, F.col("a").alias("key"), left.alias("n"), none, empty)]
    # With lookup filters the claim brings the lookup value: totals and corrections stay separate facts.
    corrections = found.select(named, F.concat("a", "l").alias("key"), (F.col("absent") - F.col("found")).alias("n"), none, empty)
    totals = everything.select(F.lit(f"{b.name}#anchors").alias("binding"), F.col("a").alias("key"), F.col("anchors").alias("n"), none, empty)
    return [corrections, totals]


def state_facts(spark: SparkSession, state: State, names: list[str], claimed: DataFrame | None = None) -> DataFrame:
    """Keyed facts of the given bindings: (binding, key) is unique.

    claimed: the (binding, key) that are asked for; without it, every key of state has its facts.
    """
    readable = [b for b in map(Binding.parse, names) if b.readable(state)]
    asked = lambda *bs: None if claimed is None else claimed.filter(F.col("binding").isin([b.name for b in bs])).select("key")
    shared: dict[tuple, list[Binding]] = defaultdict(list)
    parts = []
    for b in readable:
        if b.kind == "join":
            parts.append(_join_facts(state, b, asked(b)).select(F.lit(b.name).alias("binding"), "key", "n", "total", "payload"))
        elif b.kind == "orphan":
            parts += _orphan_facts(state, b, asked(b))
        else:
            shared[b.tables[0], tuple(c for _, c in b.keys)].append(b)
    for (table, cols), bs in shared.items():
        parts.append(_table_facts(state, table, list(cols), bs, asked(*bs)))
    if not parts:
        return spark.createDataFrame([], FACT_SCHEMA)
    return reduce(DataFrame.unionByName, parts)


def binding_types(spark: SparkSession, state: State, names: list[str]) -> DataFrame:
    """Plan-time types per binding: key kinds, and kinds of the columns a row check may read."""
    rows = []
    for name in names:
        b = Binding.parse(name)
        if not b.readable(state):
            continue
        kinds = {f.name.lower(): stored_kind(f.dataType) for f in state.tables[b.tables[0]].schema.fields} if b.kind == "row" else {}
        rows.append((name, b.key_kinds(state), kinds, b.n_anchor_keys if b.kind == "orphan" else len(b.keys)))
    return spark.createDataFrame(rows, "binding string, key_kinds array<string>, field_kinds map<string,string>, n_anchor_keys int")
