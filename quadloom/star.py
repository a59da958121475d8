"""Quads and records made from the star-schema tables, for queries over the graph and the records."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import terms as T
from .runtime import table
from .sources.quads import triplify

NS = {"d": "http://example.org/", "v": "http://example.org/vocab#", "xsd": T.XSD, "rdf": "http://www.w3.org/1999/02/22-rdf-syntax-ns#"}
V = NS["v"]


def node(kind: str, column: str):
    return F.concat(F.lit(f"U{NS['d']}{kind}/"), F.col(column).cast("string"))


def quads(spark: SparkSession, d: str, *names: str) -> DataFrame:
    """Quads of the named tables: ids become IRIs, keys of other tables links, the order status the graph of orders."""
    made = {
        "region": lambda t: triplify(t, node("region", "r_regionkey"), {V + "name": "r_name"}, rdf_type=V + "Region"),
        "nation": lambda t: triplify(t, node("nation", "n_nationkey"), {V + "name": "n_name", V + "inRegion": node("region", "n_regionkey")}, rdf_type=V + "Nation"),
        "customer": lambda t: triplify(
            t, node("customer", "c_custkey"),
            {V + "name": "c_name", V + "inNation": node("nation", "c_nationkey"), V + "balance": "c_acctbal", V + "segment": "c_mktsegment"}, rdf_type=V + "Customer",
        ),
        "supplier": lambda t: triplify(
            t, node("supplier", "s_suppkey"), {V + "name": "s_name", V + "inNation": node("nation", "s_nationkey"), V + "balance": "s_acctbal"}, rdf_type=V + "Supplier"
        ),
        "part": lambda t: triplify(
            t, node("part", "p_partkey"), {V + "name": "p_name", V + "brand": "p_brand", V + "kind": "p_type", V + "size": "p_size", V + "price": "p_retailprice"}, rdf_type=V + "Part"
        ),
        "orders": lambda t: triplify(
            t, node("order", "o_orderkey"),
            {V + "by": node("customer", "o_custkey"), V + "status": "o_orderstatus", V + "total": "o_totalprice", V + "date": "o_orderdate", V + "priority": "o_orderpriority"},
            graph=node("status", "o_orderstatus"), rdf_type=V + "Order",
        ),
        "lineitem": lambda t: triplify(
            t.withColumn("k_", F.concat_ws("-", "l_orderkey", "l_linenumber")), node("line", "k_"),
            {V + "of": node("order", "l_orderkey"), V + "part": node("part", "l_partkey"), V + "supplier": node("supplier", "l_suppkey"), V + "quantity": "l_quantity", V + "flag": "l_returnflag"},
        ),
    }
    out = None
    for n in names:
        part = made[n](table(spark, d, n))
        out = part if out is None else out.unionByName(part)
    return out


def decode(df: DataFrame, **kinds: str) -> DataFrame:
    """Solutions as plain columns: ``key`` is the number at the end of an IRI, other kinds are types to cast to.

    What doesn't fit is null: Catalyst may try a cast on constants of branches that yield no row.
    """
    return df.select(*[form(kinds.get(name, "string"))(F.col(f"`{name}`")).alias(name) for name in df.columns])


def form(kind: str) -> Callable[[Column], Column]:
    """What ``decode`` makes of the terms of a column."""
    if kind == "key":
        return lambda term: F.substring_index(T.lexical_form(term), "/", -1).try_cast("bigint")
    return T.lexical_form if kind == "string" else lambda term: T.lexical_form(term).try_cast(kind)
