"""Graphs as DataFrames: stored triples, relational tables seen as triples, and datasets of named graphs."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field, replace
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .terms import PARTS, RDF, RDFS, TERM, XSD, Term, iri_column, literal_column, make

TYPE, SUBCLASS, SUBPROPERTY = RDF + "type", RDFS + "subClassOf", RDFS + "subPropertyOf"
SHAPES_GRAPH = "urn:plumbline:shapes-graph"
TRIPLE_SCHEMA = f"s {TERM}, p string, o {TERM}"

Triple = tuple[Term, str, Term]

_TERM = pa.struct([*((k, pa.string()) for k in PARTS), ("num", pa.float64())])
_KINDS = {"term": _TERM, "string": pa.string()}


def local_frame(spark: SparkSession, rows: Iterable[tuple], **columns: str) -> DataFrame:
    """A small DataFrame of ``term`` and ``string`` columns as a local relation, whose size the optimizer knows."""
    part = lambda t: None if t is None else {"kind": t.kind, "lex": t.lex, "dt": t.dt, "lang": t.lang, "num": t.num}
    rows = list(rows)
    arrays = [
        pa.array([part(r[i]) if kind == "term" else r[i] for r in rows], _KINDS[kind]) for i, kind in enumerate(columns.values())
    ]
    return spark.createDataFrame(pa.table(dict(zip(columns, arrays, strict=True))))


class Graph:
    """What shapes need of a graph: the pairs of a predicate, and all triples."""

    spark: SparkSession

    def pred(self, p: str) -> DataFrame:
        """(s, o) of the triples with predicate ``p``, each once."""
        raise NotImplementedError

    def triples(self) -> DataFrame:
        """(s, p, o), each triple once."""
        raise NotImplementedError

    def preds(self, some: Iterable[str]) -> DataFrame:
        """(s, o) of the triples with any of the predicates, each pair once."""
        frames = [self.pred(p) for p in some]
        return frames[0] if len(frames) == 1 else reduce(DataFrame.unionByName, frames).distinct()

    def instances(self, classes: Iterable[str]) -> DataFrame:
        """(s): the distinct nodes with one of the classes as a direct type."""
        types = self.pred(TYPE)
        return types.where((F.col("o.kind") == "iri") & F.col("o.lex").isin(list(classes))).select("s").distinct()

    def below(self, start: str, p: str) -> list[str]:
        """``start`` and the IRIs under it by ``p`` (subclasses, subproperties), found one level at a time.

        A class or property hierarchy is a schema, whose size doesn't follow the data; each level is one scan.
        """
        found, level = [start], [start]
        edges = self.pred(p).where("s.kind = 'iri'")
        while level:
            rows = edges.where((F.col("o.kind") == "iri") & F.col("o.lex").isin(level)).select("s.lex").distinct().collect()
            level = sorted({r[0] for r in rows} - set(found))
            found += level
        return found

    def home(self, classes: Iterable[str]) -> Mapping | None:
        """The table whose rows are just the instances of the classes, if the graph has tables and one is."""
        return None

    def column_of(self, home: Mapping, p: str) -> Column | None:
        """The term column of the table ``home`` that holds all values of ``p`` of its rows, if one does."""
        return None

    def across(self, p: str, q: str) -> DataFrame | None:
        """(s, o) of the path ``^p/q`` without a join, if both are columns of one table that alone has them."""
        return None

    def pointed(self, home: Mapping, p: str) -> Mapping | None:
        """The table whose rows are the nodes that ``p`` of the rows of ``home`` leads to, if columns of the two equal."""
        return None

    def pointing(self, home: Mapping, p: str) -> Mapping | None:
        """The table whose rows alone lead to the rows of ``home`` by ``p``, if columns of the two equal."""
        return None

    def triples_of(self, home: Mapping) -> DataFrame | None:
        """(s, p, o) of the rows of ``home`` as read from them, if no other table has their subjects; extra triples with them."""
        return None

    def star(self, preds: list[str | None]) -> DataFrame | None:
        """(s, p0, o0, p1, o1, ...): the nodes that have all the predicates, as read from a table's rows without a join; None
        stands for any predicate. None if no table alone has such nodes."""
        return None

    def cache(self) -> Graph:
        return self


class TripleGraph(Graph):
    """A DataFrame of (s, p, o). With ``distinct`` the rows are known to be distinct already."""

    def __init__(self, frame: DataFrame, distinct: bool = False) -> None:
        self.spark = frame.sparkSession
        self._frame = frame.select("s", "p", "o")
        if not distinct:
            self._frame = self._frame.dropDuplicates()

    @classmethod
    def of(cls, spark: SparkSession, triples: Iterable[Triple]) -> TripleGraph:
        """A graph of Python triples, such as a parsed shapes graph or a test's data."""
        return cls(local_frame(spark, dict.fromkeys(triples), s="term", p="string", o="term"), distinct=True)

    def pred(self, p: str) -> DataFrame:
        return self._frame.where(F.col("p") == p).select("s", "o")

    def triples(self) -> DataFrame:
        return self._frame

    def cache(self) -> TripleGraph:
        self._frame = self._frame.cache()
        return self


@dataclass(frozen=True)
class Iri:
    """An IRI made of a base and a column."""

    base: str
    column: str

    def term(self) -> Column:
        return iri_column(F.concat(F.lit(self.base), F.col(self.column).cast("string")))


@dataclass(frozen=True)
class Literal:
    """A literal of a column; ``lang`` names a column of language tags."""

    column: str
    dt: str = XSD + "string"
    lang: str = ""

    def term(self) -> Column:
        c = F.col(self.column)
        number = c.cast("double") if self.dt in NUMERIC else None
        if self.dt == XSD + "dateTime":
            return literal_column(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss"), self.dt, None, F.lit(None).cast("double"))
        return literal_column(c.cast("string"), self.dt, F.col(self.lang) if self.lang else None, number)


#: Datatypes of numeric columns, whose numbers needn't be read back from text.
NUMERIC = tuple(XSD + x for x in ("integer", "decimal", "double", "float", "int", "long"))


@dataclass(frozen=True)
class Mapping:
    """A table as triples: subject, class, and a predicate for each mapped column; ``unique``: subjects repeat nowhere.

    ``whole`` is the graph's own table, where this one has some of its rows only.
    """

    frame: DataFrame
    subject: Iri
    cls: str
    predicates: dict[str, Iri | Literal] = field(default_factory=dict)
    unique: bool = True
    whole: Mapping | None = None


def renamed(m: Mapping, prefix: str) -> Mapping:
    """The same table with ``prefix`` before the names of its columns, to be joined to others."""
    made = {
        p: replace(o, column=prefix + o.column) if isinstance(o, Iri) or not o.lang else replace(o, column=prefix + o.column, lang=prefix + o.lang)
        for p, o in m.predicates.items()
    }
    frame = m.frame.select(*(F.col(f"`{c}`").alias(prefix + c) for c in m.frame.columns))
    return replace(m, frame=frame, subject=replace(m.subject, column=prefix + m.subject.column), predicates=made)


class MappedGraph(Graph):
    """Relational tables seen as a graph, without triples being made: a predicate is two columns of a table.

    Parquet reads only these columns, and kinds and datatypes are constants that the optimizer folds away.
    """

    def __init__(self, mappings: list[Mapping], extra: Iterable[Triple] = ()) -> None:
        self.mappings = mappings
        self.spark = mappings[0].frame.sparkSession
        self.extra = list(extra)

    def _extra(self, p: str) -> list[DataFrame]:
        some = [x for x in self.extra if x[1] == p]
        return [TripleGraph.of(self.spark, some).pred(p)] if some else []

    def pred(self, p: str) -> DataFrame:
        found = self._extra(p)
        for m in self.mappings:
            if p == TYPE:
                rows = m.frame.select(m.subject.term().alias("s"), iri_column(F.lit(m.cls)).alias("o"))
            elif p in m.predicates:
                o = m.predicates[p]
                rows = m.frame.where(F.col(o.column).isNotNull()).select(m.subject.term().alias("s"), o.term().alias("o"))
            else:
                continue
            found.append(rows if m.unique else rows.distinct())
        if not found:
            return local_frame(self.spark, [], s="term", o="term")
        return reduce(DataFrame.unionByName, found)

    def instances(self, classes: Iterable[str]) -> DataFrame:
        """The subjects of the tables of these classes, with no scan of types."""
        classes = list(classes)
        hit = [m for m in self.mappings if m.cls in classes]
        found = [
            m.frame.select(m.subject.term().alias("s")) if m.unique else m.frame.select(m.subject.term().alias("s")).distinct()
            for m in hit
        ]
        extra = [x for x in self.extra if x[1] == TYPE and x[2].lex in classes]
        if extra:
            found.append(TripleGraph.of(self.spark, extra).pred(TYPE).select("s"))
        if not found:
            return local_frame(self.spark, [], s="term")
        out = reduce(DataFrame.unionByName, found)
        return out if len(found) == 1 else out.distinct()

    def home(self, classes: Iterable[str]) -> Mapping | None:
        classes = set(classes)
        hit = [m for m in self.mappings if m.cls in classes]
        typed = any(p == TYPE and o.lex in classes for _, p, o in self.extra)
        return hit[0] if len(hit) == 1 and hit[0].unique and not typed else None

    def column_of(self, home: Mapping, p: str) -> Column | None:
        others = any(m is not (home.whole or home) and m.subject.base == home.subject.base and p in m.predicates for m in self.mappings)
        if others or p not in home.predicates or any(q == p for _, q, _ in self.extra):
            return None
        return home.predicates[p].term()

    def across(self, p: str, q: str) -> DataFrame | None:
        owners = [m for m in self.mappings if p in m.predicates]
        if len(owners) != 1 or not owners[0].unique or self.column_of(owners[0], p) is None:
            return None
        (m,) = owners
        a, b = self.column_of(m, p), self.column_of(m, q)
        if b is None:
            return None
        return m.frame.select(a.alias("s"), b.alias("o")).where("s.lex is not null and o.lex is not null")

    def _keyed(self, m: Mapping, p: str, other: Mapping) -> bool:
        """Whether ``p`` of ``m`` names rows of ``other`` by a column that equals theirs just if the IRIs are equal."""
        o = m.predicates.get(p)
        if not isinstance(o, Iri) or o.base != other.subject.base or self.column_of(m, p) is None:
            return False
        kinds = [x.frame.schema[c].dataType.typeName() for x, c in ((m, o.column), (other, other.subject.column))]
        return set(kinds) <= {"byte", "short", "integer", "long"} or kinds == ["string", "string"]

    def pointed(self, home: Mapping, p: str) -> Mapping | None:
        o = home.predicates.get(p)
        hit = [m for m in self.mappings if isinstance(o, Iri) and m.subject.base == o.base]
        plain = len(hit) == 1 and hit[0].unique and not any(s.lex.startswith(o.base) for s, _, _ in self.extra)
        return hit[0] if plain and self._keyed(home, p, hit[0]) else None

    def pointing(self, home: Mapping, p: str) -> Mapping | None:
        owners = [m for m in self.mappings if p in m.predicates]
        plain = len(owners) == 1 and owners[0].unique and not any(q == p for _, q, _ in self.extra)
        return owners[0] if plain and self._keyed(owners[0], p, home) else None

    def triples_of(self, home: Mapping) -> DataFrame | None:
        if sum(m.subject.base == home.subject.base for m in self.mappings) > 1:
            return None
        alone = MappedGraph([home], [x for x in self.extra if x[0].lex.startswith(home.subject.base)])
        return alone.triples()

    def star(self, preds: list[str | None]) -> DataFrame | None:
        named = [p for p in preds if p is not None and p != TYPE]
        owners = [m for m in self.mappings if named and named[0] in m.predicates]
        if len(owners) != 1 or not owners[0].unique or any(self.column_of(owners[0], p) is None for p in named):
            return None
        (m,) = owners
        base, others = m.subject.base, [x.subject.base for x in self.mappings if x is not m]
        if any(x.startswith(base) or base.startswith(x) for x in others) or any(s.lex.startswith(base) for s, _, _ in self.extra):
            return None
        own = {**m.predicates, TYPE: None}
        value = lambda p: iri_column(F.lit(m.cls)) if p == TYPE else own[p].term()
        rows = m.frame.where(F.col(m.subject.column).isNotNull())
        for p in named:
            rows = rows.where(F.col(own[p].column).isNotNull())
        rows = rows.select(
            m.subject.term().alias("s"),
            *(x for i, p in enumerate(preds) if p is not None for x in (F.lit(p).alias(f"p{i}"), value(p).alias(f"o{i}"))),
            *(value(p).alias(f"_{k}") for k, p in enumerate(own) if None in preds),
        )
        for i in (i for i, p in enumerate(preds) if p is None):
            pairs = [F.struct(F.lit(p).alias("p"), F.col(f"_{k}").alias("o")) for k, p in enumerate(own)]
            rows = rows.withColumn("_t", F.explode(F.array(*pairs))).withColumns({f"p{i}": F.col("_t.p"), f"o{i}": F.col("_t.o")}).where(F.col(f"o{i}.lex").isNotNull())
        return rows.select("s", *(f"{x}{i}" for i in range(len(preds)) for x in "po"))

    def below(self, start: str, p: str) -> list[str]:
        """Tables hold no hierarchy unless a column is mapped to it; without one the extra triples tell."""
        if any(p in m.predicates for m in self.mappings):
            return super().below(start, p)
        found, level = [start], [start]
        while level:
            level = sorted({s.lex for s, q, o in self.extra if q == p and s.kind == "iri" and o.lex in level} - set(found))
            found += level
        return found

    def triples(self) -> DataFrame:
        """Every table read once: its mapped columns, exploded to triples."""
        found = []
        for m in self.mappings:
            pairs = [F.struct(F.lit(TYPE).alias("p"), iri_column(F.lit(m.cls)).alias("o"))]
            pairs += [F.struct(F.lit(p).alias("p"), o.term().alias("o")) for p, o in m.predicates.items()]
            rows = m.frame.select(m.subject.term().alias("s"), F.explode(F.array(*pairs)).alias("t"))
            rows = rows.select("s", "t.p", "t.o").where("o.lex is not null")
            found.append(rows if m.unique else rows.distinct())
        if self.extra:
            found.append(TripleGraph.of(self.spark, self.extra).triples())
        return reduce(DataFrame.unionByName, found)


@dataclass
class Dataset:
    """A data graph and the shapes graph, which SPARQL constraints can name."""

    data: Graph
    shapes: list[Triple] = field(default_factory=list)

    def named(self, name: str) -> Graph | None:
        return TripleGraph.of(self.data.spark, self.shapes) if name == SHAPES_GRAPH else None

    def quads(self) -> DataFrame:
        """(g, s, p, o): the data with a null graph name, and the shapes with theirs."""
        data = self.data.triples().withColumn("g", F.lit(None).cast("string"))
        shapes = TripleGraph.of(self.data.spark, self.shapes).triples().withColumn("g", F.lit(SHAPES_GRAPH))
        return data.unionByName(shapes)


def with_blank_scope(frame: DataFrame, scope: Column) -> DataFrame:
    """Blank node labels prefixed by ``scope``, so that those of different files differ."""
    fix = lambda t: F.when(t["kind"] == "bnode", make("bnode", F.concat(scope, t["lex"]))).otherwise(t)
    return frame.select(fix(F.col("s")).alias("s"), "p", fix(F.col("o")).alias("o"))
