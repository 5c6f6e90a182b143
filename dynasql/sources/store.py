"""Tables that can be changed: each is a Parquet snapshot, replaced as a whole.

A change writes a new snapshot and then moves the table's pointer, so readers
see the old rows or the new ones, a failed change leaves nothing behind, and a
transaction is a saved copy of the pointers.
"""

from __future__ import annotations

import copy
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import values as V
from ..functions.values import Value
from ..sql.parser import SqlError
from .shared import shared_folder

SPARK_TYPE = {"int": "long", "real": "double", "numeric": "double", "text": "string", "blob": "string"}


@dataclass
class ColumnDef:
    name: str
    declared: str = ""
    not_null: bool = False
    default: object = None
    key: int = 0  # place in the primary key, from 1

    @property
    def kind(self) -> str:
        return V.affinity(self.declared)


@dataclass
class TableDef:
    name: str
    columns: list[ColumnDef]
    uniques: list[list[str]] = field(default_factory=list)
    checks: list[tuple] = field(default_factory=list)
    indexes: dict[str, tuple[list[str], bool]] = field(default_factory=dict)
    path: str | None = None
    text: str = ""

    def rowid_alias(self) -> str | None:
        keys = [c for c in self.columns if c.key]
        return keys[0].name if len(keys) == 1 and keys[0].declared.upper() == "INTEGER" else None

    def unique_sets(self) -> list[list[str]]:
        return self.uniques + [c for c, unique in self.indexes.values() if unique]


class Store:
    """Table definitions and snapshots of one database."""

    def __init__(self, spark: SparkSession, warehouse: str | None = None):
        self.spark = spark
        self.warehouse = warehouse or shared_folder(spark)
        self.tables: dict[str, TableDef] = {}
        self.saved: dict[str, TableDef] | None = None
        self.last_rowid, self.version = 0, 0

    # definitions and transactions
    def define(self, table: TableDef, if_not_exists: bool = False) -> None:
        if table.name.lower() in self.tables:
            if if_not_exists:
                return
            raise SqlError(f"table {table.name} already exists")
        self.tables[table.name.lower()] = table
        self.version += 1

    def get(self, name: str) -> TableDef:
        if name.lower() not in self.tables:
            raise SqlError(f"no such table: {name}")
        return self.tables[name.lower()]

    def begin(self) -> None:
        if self.saved is not None:
            raise SqlError("cannot start a transaction within a transaction")
        self.saved = copy.deepcopy(self.tables)

    def commit(self) -> None:
        if self.saved is None:
            raise SqlError("cannot commit - no transaction is active")
        self.saved = None

    def rollback(self) -> None:
        if self.saved is None:
            raise SqlError("cannot rollback - no transaction is active")
        self.tables, self.saved = self.saved, None

    # rows
    def schema(self, t: TableDef) -> str:
        return ", ".join(["_rowid long", *(f"`{c.name}` {SPARK_TYPE[c.kind]}" for c in t.columns)])

    def rows(self, name: str) -> DataFrame:
        t = self.get(name)
        if t.path is None:
            return self.spark.createDataFrame([], self.schema(t))
        df = self.spark.read.parquet(t.path)
        for c in t.columns:  # columns added later read as their default
            if c.name not in df.columns:
                df = df.withColumn(c.name, V.lit(c.default).c.cast(SPARK_TYPE[c.kind]))
        return df.select("_rowid", *(f"`{c.name}`" for c in t.columns))

    def put(self, t: TableDef, df: DataFrame) -> None:
        path = f"{self.warehouse}/{t.name.lower()}/{uuid.uuid4().hex}"
        df.write.parquet(path)
        t.path = path

    def stage(self, df: DataFrame) -> DataFrame:
        path = f"{self.warehouse}/staged/{uuid.uuid4().hex}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def numbered(self, df: DataFrame, first: int) -> DataFrame:
        """Rows with _rowid from `first` on, without gaps and without sorting them in one task."""
        parts = self.stage(df.withColumns({"__p": F.spark_partition_id(), "__m": F.monotonically_increasing_id()}))
        counts = sorted((r["__p"], r["n"]) for r in parts.groupBy("__p").agg(F.count("*").alias("n")).collect())
        starts, at = [], first
        for p, n in counts:
            starts.append((p, at))
            at += n
        if not starts:
            return df.withColumn("_rowid", F.lit(0).cast("long"))
        table = F.broadcast(self.spark.createDataFrame(starts, "__p int, __s long"))
        n = F.row_number().over(Window.partitionBy("__p").orderBy("__m"))
        return parts.join(table, "__p").withColumn("_rowid", (F.col("__s") + n - 1).cast("long")).drop("__p", "__m", "__s")

    def insert(self, name: str, names: list[str] | None, source: DataFrame, policy: str = "abort") -> int:
        """Append source's columns, in order, as columns `names`; returns the rows stored."""
        t = self.get(name)
        names = names or [c.name for c in t.columns]
        if len(names) != len(source.columns):
            raise SqlError(f"table {t.name} has {len(names)} columns but {len(source.columns)} values were supplied")
        known = {c.name.lower() for c in t.columns} | {"rowid", "_rowid_", "oid"}
        for n in names:
            if n.lower() not in known:
                raise SqlError(f"table {t.name} has no column named {n}")
        source = source.toDF(*(f"__v{i}" for i in range(len(names))))
        at = {n.lower(): i for i, n in enumerate(names)}
        columns = []
        for c in t.columns:
            i = at.get(c.name.lower())
            v = Value(F.col(f"__v{i}"), V.kind_of(source.schema[i].dataType)) if i is not None else V.lit(c.default)
            columns.append(stored(v, c.kind).alias(c.name))
        alias = t.rowid_alias()
        given = next((at[n] for n in ("rowid", "_rowid_", "oid") if n in at), None)
        rowid = F.col(f"__v{given}").cast("long") if given is not None else None
        staged = source.select(*columns, *([rowid.alias("_given")] if rowid is not None else []))
        old = self.rows(name)
        top = old.agg(F.max("_rowid")).first()[0] or 0
        new = self.numbered(staged, top + 1)
        own = F.col("_given") if rowid is not None else F.col(f"`{alias}`") if alias else F.lit(None).cast("long")
        new = new.withColumn("_rowid", F.coalesce(own, F.col("_rowid"))).drop("_given")
        if alias:
            new = new.withColumn(alias, F.col("_rowid"))
        new = self.stage(new.select("_rowid", *(f"`{c.name}`" for c in t.columns)))
        new = self.checked(t, new, policy)
        old, new = self.distinct(t, old, new, policy)
        new = self.stage(new)
        n, last = new.agg(F.count("*"), F.max("_rowid")).first()
        self.put(t, old.unionByName(new))
        self.last_rowid = last or self.last_rowid
        return n

    def checked(self, t: TableDef, new: DataFrame, policy: str) -> DataFrame:
        """NOT NULL and CHECK; rows that fail are left out under ignore, else an error."""
        from ..sql.engine import Compiler, Engine, Field

        engine = Engine(self.spark, self.rows)
        fields = [Field(t.name.lower(), c.name, Value(F.col(f"`{c.name}`"), {"numeric": "real"}.get(c.kind, "text" if c.kind == "blob" else c.kind), True)) for c in t.columns]
        tests = [(F.col(f"`{c.name}`").isNotNull(), f"NOT NULL constraint failed: {t.name}.{c.name}") for c in t.columns if c.not_null]
        comp = Compiler(engine, fields, {})
        tests += [(F.coalesce(V.truth(comp.value(x)), F.lit(True)), f"CHECK constraint failed: {t.name}") for x in t.checks]
        for good, message in tests:
            if policy == "ignore":
                new = new.filter(good)
            elif not new.filter(~good).isEmpty():
                raise SqlError(message)
        return new

    def distinct(self, t: TableDef, old: DataFrame, new: DataFrame, policy: str) -> tuple[DataFrame, DataFrame]:
        """UNIQUE and rowid conflicts by policy; null never equals null."""
        for keys in [["_rowid"], *t.unique_sets()]:
            quoted = [f"`{k}`" for k in keys]
            order = F.col("_rowid").desc() if policy == "replace" else F.col("_rowid").asc()
            some = F.lit(False)
            for k in quoted:
                some = some | F.col(k).isNull()
            ranked = new.withColumn("__n", F.when(some, F.lit(1)).otherwise(F.row_number().over(Window.partitionBy(*quoted).orderBy(order))))
            if policy == "ignore":
                new = ranked.filter("__n = 1").drop("__n").join(old.select(*quoted), keys, "left_anti").select(old.columns)
            elif policy == "replace":
                new = ranked.filter("__n = 1").drop("__n")
                old = old.join(new.select(*quoted), keys, "left_anti").select(new.columns)
            elif not ranked.filter("__n > 1").isEmpty() or not new.join(old.select(*quoted), keys, "left_semi").isEmpty():
                shown = [t.rowid_alias() or "rowid"] if keys == ["_rowid"] else keys
                raise SqlError("UNIQUE constraint failed: " + ", ".join(f"{t.name}.{k}" for k in shown))
        return old, new

    def update(self, name: str, changes: dict[str, tuple], where: tuple | None) -> int:
        """SET columns from expressions over the old row, where the condition holds."""
        from ..sql.engine import Engine, Field, Compiler

        t = self.get(name)
        old = self.rows(name)
        fields = [Field(t.name.lower(), f.name, Value(F.col(f"`{f.name}`"), V.kind_of(f.dataType), True), f.name != "_rowid") for f in old.schema]
        comp = Compiler(Engine(self.spark, self.rows), fields, {})
        hit = F.coalesce(V.truth(comp.value(where)), F.lit(False)) if where is not None else F.lit(True)
        by = {k.lower(): x for k, x in changes.items()}
        for k in by:
            if k not in {c.name.lower() for c in t.columns}:
                raise SqlError(f"no such column: {k}")
        alias = t.rowid_alias()
        columns = [stored(comp.value(by[c.name.lower()]), c.kind).alias(c.name) if c.name.lower() in by else F.col(f"`{c.name}`") for c in t.columns]
        rowid = columns[[c.name for c in t.columns].index(alias)].alias("_rowid") if alias and alias.lower() in by else F.col("_rowid")
        new = self.stage(old.filter(hit).select(rowid, *columns))
        rest = old.filter(~hit)
        self.checked(t, new, "abort")
        self.distinct(t, rest, new, "abort")
        n = new.count()
        if n:
            self.put(t, rest.unionByName(new))
        return n

    def delete(self, name: str, where: tuple | None) -> int:
        from ..sql.engine import Engine, Field, Compiler

        t = self.get(name)
        old = self.rows(name)
        fields = [Field(t.name.lower(), f.name, Value(F.col(f"`{f.name}`"), V.kind_of(f.dataType), True), f.name != "_rowid") for f in old.schema]
        hit = F.coalesce(V.truth(Compiler(Engine(self.spark, self.rows), fields, {}).value(where)), F.lit(False)) if where is not None else F.lit(True)
        n = old.filter(hit).count()
        if n:
            self.put(t, old.filter(~hit))
        return n


def stored(v: Value, kind: str):
    """A value as a column of an affinity keeps it; text that is no number is refused by a number column."""
    if v.kind == "null":
        return F.lit(None).cast(SPARK_TYPE[kind])
    if kind in ("text", "blob"):
        return V.text(v)
    if v.kind in ("text", "time"):
        t = V.text(v)
        n = F.when(t.rlike(V.NUMERIC), F.trim(t).try_cast("double"))
        bad = F.raise_error(F.concat(F.lit("datatype mismatch: "), t)).cast("double")
        out = F.when(t.isNull() | n.isNotNull(), n).otherwise(bad)
        return out.cast("long") if kind == "int" else out
    return v.c.cast("double") if kind != "int" else V.integer(v)
