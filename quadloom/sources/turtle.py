"""Turtle, TriG and RDF/JSON documents, each file read as a whole, one task per file or more files."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import terms as T
from ..functions.texts import print_value
from ..plans.algebra import Term, Triple, Var
from ..plans.parser import Parser, SparqlError

Row = tuple[str, str, str, str | None]


class _Document(Parser):
    """Turtle shares its triples with the query language; directives and graph blocks come on top."""

    def rows(self) -> list[Row]:
        out: list[Row] = []
        while self.kind() != "end":
            if self.directive():
                continue
            graph = None
            if self.take("GRAPH") or self.block_ahead():
                graph = self.code(self.node([]))
            if self.take("{"):
                while not self.take("}"):
                    out += self.flat(self.triples(), graph)
            else:
                before = self.at
                out += self.flat(self.triples(), None)
                if self.at == before:
                    raise SparqlError(f"unexpected {self.tokens[self.at][1]!r}")
        return out

    def directive(self) -> bool:
        kind, text = self.tokens[self.at]
        word = text.lower().lstrip("@")
        if word not in ("prefix", "base") or kind not in ("lang", "word"):
            return False
        self.at += 1
        if word == "prefix":
            name = self.next()[:-1]
            self.names[name] = self.iri()
        else:
            self.base = self.iri()
        if kind == "lang":
            self.need(".")
        return True

    def block_ahead(self) -> bool:
        return self.kind() in ("iri", "pname", "bnode") and self.tokens[self.at + 1] == ("op", "{")

    def triples(self) -> list[Triple]:
        """Up to the end of a statement, so that directives may follow."""
        out: list[Triple] = []
        if self.peek("."):
            self.need(".")
            return out
        s = self.node(out)
        if not (self.peek(".", "}") and out):
            self.properties(s, out)
        if not self.peek("}"):
            self.need(".")
        return out

    def code(self, node) -> str:
        return node.code if isinstance(node, Term) else "B" + node.name.lstrip("._:")

    def flat(self, triples: list[Triple], graph: str | None) -> list[Row]:
        for t in triples:
            if not isinstance(t.p, Term) or isinstance(t.s, Var) and not t.s.name.startswith(".") or isinstance(t.o, Var) and not t.o.name.startswith("."):
                raise SparqlError("variables and paths are not allowed here")
        return [(self.code(t.s), t.p.code, self.code(t.o), graph) for t in triples]


def parse_turtle(text: str) -> list[Row]:
    """Quads of a Turtle or TriG document; ValueError where it is none."""
    return _Document(text).rows()


def parse_rdf_json(text: str) -> list[Row]:
    """Quads of an RDF/JSON document: subject, predicate, list of value objects."""

    def node(text: str) -> str:
        return "B" + text[2:] if text.startswith("_:") else "U" + text

    out: list[Row] = []
    for s, props in json.loads(text).items():
        for p, values in props.items():
            for v in values:
                o = node(v["value"]) if v["type"] != "literal" else T.literal_code(v["value"], v.get("datatype", ""), v.get("lang", ""))
                out.append((node(s), "U" + p, o, None))
    return out


_READERS = {"ttl": parse_turtle, "trig": parse_turtle, "n3": parse_turtle, "rj": parse_rdf_json}


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(s, p, o, g, file) of ttl, trig, n3 and rj files below ``path``; blank nodes are set apart by file.

    Files that can't be read as their ending says give no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column("name").to_pylist(), batch.column("content").to_pylist()):
                try:
                    rows = _READERS[name.rsplit(".", 1)[-1]](data.decode("utf-8"))
                except (ValueError, KeyError, TypeError, AttributeError, IndexError, RecursionError):
                    continue
                mark = "".join(c if c.isalnum() else "_" for c in name)
                apart = [[f"B{mark}_{v[1:]}" if v is not None and v[0] == "B" else v for v in r] for r in rows]
                cols = list(zip(*apart)) or [[], [], [], []]
                yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.string()) for c in cols), pa.array([name] * len(rows), pa.string())], names=["s", "p", "o", "g", "file"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    named = files.select(F.element_at(F.split("path", "/"), -1).alias("name"), "content").where(F.substring_index("name", ".", -1).isin(*_READERS))
    return named.mapInArrow(run, "s string, p string, o string, g string, file string")


def to_turtle(quads: DataFrame, prefixes: dict[str, str]) -> DataFrame:
    """One ``value`` line per subject: its predicates and objects, with qualified names. Graphs are left aside."""
    show = lambda c: print_value(F.col(c), prefixes)
    objects = quads.select("s", "p", "o").distinct().groupBy("s", "p").agg(F.concat_ws(", ", F.sort_array(F.collect_list(show("o")))).alias("os"))
    pairs = objects.groupBy("s").agg(F.concat_ws(" ; ", F.sort_array(F.collect_list(F.concat(show("p"), F.lit(" "), F.col("os"))))).alias("ps"))
    return pairs.select(F.concat(show("s"), F.lit(" "), F.col("ps"), F.lit(" .")).alias("value"))


def write_turtle(quads: DataFrame, prefixes: dict[str, str], path: str) -> None:
    """Files that each begin with the prefixes."""
    head = "".join(f"@prefix {p}: <{n}> . " for p, n in sorted(prefixes.items()))
    to_turtle(quads, prefixes).select(F.concat(F.lit(head), "value").alias("value")).write.mode("overwrite").text(path)
