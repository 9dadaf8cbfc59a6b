"""Quads as DataFrames: what patterns scan."""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import terms as t
from ..plans.algebra import RDF, RDFS, STRING, XSD


class Size(NamedTuple):
    """Estimates for join ordering: rows, distinct subjects, distinct objects."""

    rows: int
    subjects: int
    objects: int


class Dataset:
    """Quads in one DataFrame (g, s, p, o); graphs: registered names, which may be empty; most: no more quads than this, if known."""

    def __init__(self, quads: DataFrame, graphs: frozenset[str] = frozenset(), most: int | None = None):
        self.quads, self.graphs, self.most = quads, graphs, most
        self.spark = quads.sparkSession

    def scan(self, predicate: str | None = None, subject: str | None = None, like: str | None = None) -> DataFrame:
        """Quads of a predicate, or all; subject: an IRI outside of which rows may be left out; like: a predicate, and rows
        whose subjects can't be subjects of it may be left out."""
        return self.quads if predicate is None else self.quads.where(F.col("p") == predicate)

    def star(self, predicates: list[str]) -> DataFrame | None:
        """(g, s, o0, o1, ...): the objects of these predicates side by side, where one scan gives them without a join."""
        return None

    def size(self, predicate: str | None) -> Size:
        """Estimated rows of a predicate, or of all quads; one aggregate over the quads, made when first asked for."""
        if self._sizes is None:
            found = self.quads.groupBy("p").agg(F.count("*"), F.approx_count_distinct("s"), F.approx_count_distinct("o")).collect()
            self._sizes = {r[0]: Size(*r[1:]) for r in found}
            self._sizes[None] = Size(*(sum(r[i] for r in found) for i in (1, 2, 3)))
        return self._sizes.get(predicate, Size(0, 0, 0))

    _sizes: dict[str | None, Size] | None = None

    def graph_names(self) -> DataFrame:
        seen = self.scan().where("g IS NOT NULL").select("g").distinct()
        if not self.graphs:
            return seen
        return seen.union(self.spark.createDataFrame([(g,) for g in sorted(self.graphs)], "g string")).distinct()


#: Rows that one task makes distinct; a few hundred bytes each.
DISTINCT_ROWS = 200_000


def distinct(df: DataFrame, most: int | None) -> DataFrame:
    """Distinct rows. Where there may be many, they are dealt out before any task holds them, over tasks in proportion to their
    number: a split of a table makes many times its size in quads, and a shuffle's size tells little of what it holds."""
    if most is not None and most > DISTINCT_ROWS:
        df = df.repartition(-(-most // DISTINCT_ROWS), *df.columns)
    return df.dropDuplicates()


def empty_quads(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], t.QUAD)


BASE = "urn:t/"
#: table -> key columns; lineitem has no key, so its subject is a hash of the row.
KEYS = {"region": ["r_regionkey"], "nation": ["n_nationkey"], "supplier": ["s_suppkey"], "customer": ["c_custkey"], "part": ["p_partkey"], "orders": ["o_orderkey"], "lineitem": [], "events": ["event_id"], "documents": ["doc_id"], "labels": ["doc_id"], "conversations": ["conv_id", "turn"], "pages": ["page_id"], "benchmark": ["item_id"]}
#: column -> table it refers to.
REFERENCES = {"n_regionkey": "region", "s_nationkey": "nation", "c_nationkey": "nation", "o_custkey": "customer", "l_orderkey": "orders", "l_partkey": "part", "l_suppkey": "supplier", "user_id": "user"}
SUBJECTS = {"documents": "doc", "labels": "doc", "conversations": "turn", "pages": "page", "benchmark": "item", "events": "event"}


def _object(df: DataFrame, name: str, lang: str | None = None) -> Column:
    kind, c = df.schema[name].dataType.simpleString(), F.col(name)
    if name in REFERENCES:
        return t.iri(F.concat(F.lit(f"{BASE}{REFERENCES[name]}/"), c.cast("string")))
    if lang:
        return t.literal(c, RDF + "langString", F.col(lang))
    if kind in ("int", "bigint", "smallint", "tinyint"):
        return t.literal(c.cast("string"), XSD + "integer")
    if kind in ("double", "float"):
        return t.literal(t.double_text(c.cast("double")), XSD + kind)
    if kind == "boolean":
        return t.literal(c.cast("string"), XSD + "boolean")
    if kind.startswith("decimal"):
        return t.literal(t.decimal_text(c), XSD + "decimal")
    if kind.startswith("timestamp"):
        return t.literal(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss"), XSD + "dateTime")
    if kind == "date":
        return t.literal(c.cast("string"), XSD + "date")
    return t.literal(c.cast("string"), STRING)


class Table:
    """One table's quads; every column expression is made when a predicate first asks for it."""

    def __init__(self, spark: SparkSession, name: str, path: str):
        self.name, self.df = name, spark.read.parquet(path)
        self.columns = self.df.columns
        self.key, self.noun = KEYS[name], SUBJECTS.get(name, name)
        self._rows: int | None = None

    @property
    def rows(self) -> int:
        """From the footers of the files."""
        if self._rows is None:
            self._rows = self.df.count()
        return self._rows

    def subject(self) -> Column:
        parts = [F.col(c).cast("string") for c in self.key or self.columns]
        return t.iri(F.concat(F.lit(f"{BASE}{self.noun}/"), F.concat_ws("/", *parts) if self.key else F.sha2(F.concat_ws("|", *parts), 256)))

    def graph(self) -> Column:
        return F.concat(F.lit("urn:g/"), F.col("event_type")) if self.name == "events" else F.lit(None).cast("string")

    def predicates(self) -> list[str]:
        extra = {"nation": [RDFS + "subClassOf"], "conversations": [f"{BASE}next"]}.get(self.name, [])
        return [*([RDF + "type"] if self.name != "labels" else []), *(f"{BASE}{c}" for c in self.columns), *extra]

    def object(self, predicate: str) -> Column:
        """The object that a row has for a predicate, or null; not for urn:t/next, which needs the row after."""
        if predicate == RDF + "type":
            return t.iri(f"{BASE}{self.noun.capitalize()}")
        if predicate == RDFS + "subClassOf":
            return t.iri(F.concat(F.lit(f"{BASE}region/"), F.col("n_regionkey").cast("string")))
        c = predicate[len(BASE) :]
        return F.when(F.col(c).isNotNull(), _object(self.df, c, "lang" if (self.name, c) == ("documents", "text") else None))

    def only(self, subject: str | None) -> DataFrame | None:
        """The rows that may have this subject, by comparing key columns; None where there are none."""
        if subject is None:
            return self.df
        if not subject.startswith(f"{BASE}{self.noun}/"):
            return None
        parts = subject[len(f"{BASE}{self.noun}/") :].split("/")
        if not self.key:
            return self.df
        if len(parts) != len(self.key) or not all(p.lstrip("-").isdigit() and str(int(p)) == p for p in parts):
            return None
        df = self.df
        for k, p in zip(self.key, parts, strict=True):
            df = df.where(F.col(k) == F.lit(int(p)))
        return df

    def _rows_of(self, df: DataFrame, columns: list[Column]) -> DataFrame:
        return df.select(self.graph().alias("g"), self.subject().alias("s"), *columns)

    def quads(self, predicate: str, subject: str | None = None) -> DataFrame | None:
        df = self.only(subject)
        if df is None:
            return None
        if predicate == f"{BASE}next":
            follow = F.lead("turn").over(Window.partitionBy("conv_id").orderBy("turn"))
            # The turn after is looked for in all rows, so a bound subject is compared later.
            rows = self.df.select("conv_id", "turn", follow.alias("after")).where("after IS NOT NULL")
            node = lambda c: t.iri(F.concat(F.lit(f"{BASE}turn/"), F.col("conv_id").cast("string"), F.lit("/"), F.col(c).cast("string")))
            return rows.select(F.lit(None).cast("string").alias("g"), node("turn").alias("s"), F.lit(predicate).alias("p"), node("after").alias("o"))
        if predicate.startswith(BASE):
            df = df.where(F.col(predicate[len(BASE) :]).isNotNull())
        return self._rows_of(df, [F.lit(predicate).alias("p"), self.object(predicate).alias("o")])

    def all(self, subject: str | None = None) -> list[DataFrame]:
        """All quads of the table in one pass over its rows; urn:t/next apart."""
        df = self.only(subject)
        if df is None:
            return []
        pairs = [(p, self.object(p)) for p in self.predicates() if p != f"{BASE}next"]
        each = F.array(*(F.struct(F.lit(p).alias("p"), o.alias("o")) for p, o in pairs))
        rows = self._rows_of(df, [F.explode(each).alias("x")]).select("g", "s", "x.p", "x.o").where("o IS NOT NULL")
        return [rows, self.quads(f"{BASE}next", subject)] if self.name == "conversations" else [rows]

    def star(self, predicates: list[str]) -> DataFrame:
        df = self.df
        for p in predicates:
            if p.startswith(BASE):
                df = df.where(F.col(p[len(BASE) :]).isNotNull())
        return self._rows_of(df, [self.object(p).alias(f"o{i}") for i, p in enumerate(predicates)])


class TableDataset(Dataset):
    """Quads computed from tables; a constant predicate reads only the columns it is made of, a constant subject only the
    rows of its key."""

    def __init__(self, spark: SparkSession, tables: dict[str, Table]):
        self.spark, self.tables, self.graphs = spark, tables, frozenset()
        self.by_predicate: dict[str, list[Table]] = {}
        for table in tables.values():
            for p in table.predicates():
                self.by_predicate.setdefault(p, []).append(table)

    @property
    def most(self) -> int:
        return sum(x.rows * len(x.predicates()) for x in self.tables.values())

    def scan(self, predicate: str | None = None, subject: str | None = None, like: str | None = None) -> DataFrame:
        tables = list(self.tables.values()) if predicate is None else self.by_predicate.get(predicate, [])
        if like is not None:
            # A noun names the subjects of its tables only.
            nouns = {x.noun for x in self.by_predicate.get(like, [])}
            tables = [x for x in tables if x.noun in nouns]
        if predicate is None:
            frames = [df for table in tables for df in table.all(subject)]
        else:
            frames = [df for table in tables if (df := table.quads(predicate, subject)) is not None]
        return reduce(DataFrame.union, frames) if frames else empty_quads(self.spark)

    @property
    def quads(self) -> DataFrame:
        return self.scan()

    def star(self, predicates: list[str]) -> DataFrame | None:
        """Predicates that only one table has, each a column of its rows: a subject is one row there."""
        owners = {id(x): x for p in predicates for x in self.by_predicate.get(p, [])}
        if len(owners) != 1 or any(len(self.by_predicate.get(p, [])) != 1 for p in predicates) or f"{BASE}next" in predicates or len(set(predicates)) < len(predicates):
            return None
        return next(iter(owners.values())).star(predicates)

    def size(self, predicate: str | None) -> Size:
        """Rows of the tables; a reference has as many objects as the table it points to, other columns are taken to have few."""
        tables = self.by_predicate.get(predicate, []) if predicate is not None else list(self.tables.values())
        rows = sum(x.rows for x in tables)
        if predicate is None:
            return Size(rows * 5, rows, rows)
        c = predicate[len(BASE) :] if predicate.startswith(BASE) else ""
        if c in REFERENCES:
            other = self.tables.get(REFERENCES[c])
            return Size(rows, rows, min(rows, other.rows) if other else rows)
        keyed = any(c in x.key for x in tables) or c == "next"
        return Size(rows, rows, rows if keyed else min(rows, 1 if not c else 100))


_opened: dict[tuple, TableDataset] = {}


def table_dataset(spark: SparkSession, sf_dir: str, tables: list[str] | None = None) -> TableDataset:
    """The tables of a directory as quads: one subject per row, foreign keys as IRIs, other columns as typed literals.

    Nulls make no quad. Events stand in graphs named by their type, all else in the default graph. Nations point to
    their region by rdfs:subClassOf, and turns of a conversation to the next turn by urn:t/next. A directory is opened once
    a session: its files are taken to stay as they are.
    """
    names = tuple(tables or KEYS)
    slot = (spark.sparkContext.applicationId, id(spark), sf_dir, names)
    if slot not in _opened:
        _opened[slot] = TableDataset(spark, {n: Table(spark, n, f"{sf_dir}/{n}.parquet") for n in names})
    return _opened[slot]
