"""Tools for benchmarks: joined samples of parameters, query templates, mixes of queries, and their figures."""

from __future__ import annotations

import random
import re
import threading
import time
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def sample_joined(tables: list[DataFrame], n: int, seed: int = 1) -> DataFrame:
    """``n`` different rows of the natural join of parameter tables, chosen by a seeded hash of the rows."""
    out = tables[0]
    for t in tables[1:]:
        shared = [c for c in out.columns if c in t.columns]
        out = out.join(t, shared) if shared else out.crossJoin(t)
    out = out.distinct()
    return out.orderBy(F.xxhash64(F.lit(seed), *[F.col(c) for c in out.columns]), *out.columns).limit(n)


def fill(template: str, values: dict[str, str]) -> str:
    """``${name}`` places of a template; a name without a value is an error."""

    def value(m: re.Match) -> str:
        if m[1] not in values:
            raise KeyError(m[1])
        return str(values[m[1]])

    return re.sub(r"\$\{([^}]+)\}", value, template)


def requests(engine) -> dict[str, Callable[[dict], DataFrame]]:  # noqa: ANN001
    """The kinds of requests to a session (``engine.Engine``), each a function of its parameters."""
    return {
        "download": lambda p: engine.download(p["id"], p.get("accept")),
        "retrieve": lambda p: engine.retrieve(p["kind"], p.get("condition"), props=p.get("props"), offset=p.get("offset", 0), limit=p.get("limit")),
        "lookup": lambda p: engine.retrieve(p["kind"], ids=[p["id"]], props=p.get("props")),
        "lookupall": lambda p: engine.retrieve(p["kind"], ids=list(p["ids"]), props=p.get("props")),
        "count": lambda p: engine.retrieve(p["kind"], p.get("condition")).agg(F.count(F.lit(1)).alias("n")),
        "sparql": lambda p: engine.sparql(fill(p["query"], p)),
    }


def run_mixes(
    spark: SparkSession, queries: dict[str, Callable[[dict], DataFrame]], parameters: list[dict], mixes: int, warmup: int = 0, seconds: float | None = None, seed: int = 1, clients: int = 1
) -> DataFrame:
    """Run mixes, all queries of one in a seeded order each; (mix, client, query, start, ms, rows, error) of those after the warmup.

    ``clients`` work at the same time, each on one mix after the other; no mix begins after ``seconds``.
    """
    rng, plans = random.Random(seed), []
    for mix in range(-warmup, mixes):
        names = sorted(queries)
        rng.shuffle(names)
        plans.append((mix, names, parameters[rng.randrange(len(parameters))] if parameters else {}))
    began, rows, left, lock = time.time(), [], iter(plans), threading.Lock()

    def work(client: int) -> None:
        while seconds is None or time.time() - began <= seconds:
            with lock:
                plan = next(left, None)
            if plan is None:
                return
            mix, names, given = plan
            for name in names:
                start, n, error = time.time(), 0, None
                try:
                    n = queries[name](given).count()
                except Exception as e:  # a failed request is a figure too
                    error = type(e).__name__
                if mix >= 0:
                    rows.append((mix, client, name, start, (time.time() - start) * 1000, n, error))

    with ThreadPoolExecutor(clients) as pool:
        list(pool.map(work, range(clients)))
    return spark.createDataFrame(rows, "mix int, client int, query string, start double, ms double, rows long, error string")


def rates(trace: DataFrame, clock_seconds: float) -> DataFrame:
    """(query, n, mean, median, high, rate): a query's clock is its share of all time, its rate n by that."""
    total = trace.agg(F.sum("ms").alias("total"))
    by = trace.groupBy("query").agg(F.count(F.lit(1)).alias("n"), F.avg("ms").alias("mean"), F.median("ms").alias("median"), F.max("ms").alias("high"), F.sum("ms").alias("sum"))
    clock = F.lit(clock_seconds) * F.col("sum") / F.nullif("total", F.lit(0.0))
    return by.crossJoin(F.broadcast(total)).select("query", "n", "mean", "median", "high", (F.col("n") / F.nullif(clock, F.lit(0.0))).alias("rate"))
