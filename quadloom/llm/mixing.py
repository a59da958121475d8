"""Mixing sources to target shares of tokens, by balanced sampling with the cube method.

A source that holds more than its target gives each document the same expected number of copies: a whole part that all get
and a fraction, drawn so that the tokens and the documents drawn equal their expectation. The flight phase moves the
fractions of a block through the null space of both constraints until at most two stay fractional; what blocks leave goes
into blocks of the next level, and the last few land one by one.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import materialize

TOKENIZER = os.environ.get("QUADLOOM_TOKENIZER", "/opt/tokenizers/byte_bpe_50k.tiktoken")
#: Fixed value: the published splitting pattern of the byte-level vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Documents of a flight, and the fraction below which a unit counts as settled.
FLIGHT, SETTLED = 4096, 1e-9

_loaded: dict[str, object] = {}


def _encoder(path: str):
    if path not in _loaded:
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        _loaded[path] = tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _loaded[path]


def with_tokens(documents: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, source, tokens) of every row; a null or empty text has no tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(tokenizer).encode_ordinary
        for batch in batches:
            sizes = [len(encode(t)) if t else 0 for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("source"), pa.array(sizes, pa.int64())], names=["doc_id", "source", "tokens"])

    return documents.select(F.col("doc_id").cast("bigint"), F.col("source").cast("string"), F.col("text").cast("string")).mapInArrow(
        run, "doc_id bigint, source string, tokens bigint"
    )


def flight(p: np.ndarray, tokens: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Inclusion probabilities after the flight phase: at most two are left between 0 and 1.

    Keeps the sum of ``p`` and of ``p * tokens`` and, for each unit, the expectation. In each turn all open units fly in
    threes, along the one direction that leaves both sums of the three as they are, until one of them settles.
    """
    p, tokens = p.astype(float).copy(), tokens.astype(float)
    active = np.flatnonzero((p > SETTLED) & (p < 1 - SETTLED))
    while len(active) >= 3:
        flying, rest = active[: len(active) // 3 * 3].reshape(-1, 3), active[len(active) // 3 * 3 :]
        t, q = tokens[flying], p[flying]
        u = np.roll(t, -2, axis=1) - np.roll(t, -1, axis=1)  # c - b, a - c, b - a
        u[~u.any(1)] = (1.0, -1.0, 0.0)
        with np.errstate(divide="ignore", invalid="ignore"):
            up = np.where(u > 0, (1 - q) / u, np.where(u < 0, -q / u, np.inf)).min(1)
            down = np.where(u > 0, q / u, np.where(u < 0, (q - 1) / u, np.inf)).min(1)
        step = np.where(rng.random(len(flying)) * (up + down) < down, up, -down)
        p[flying] = np.clip(q + step[:, None] * u, 0, 1)
        active = np.concatenate([flying.ravel(), rest])
        active = active[(p[active] > SETTLED) & (p[active] < 1 - SETTLED)]
    return p


def landing(p: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """0 or 1 for each unit: pairs give to each other with the expectation kept, the last one is drawn."""
    p = np.where(p < SETTLED, 0.0, np.where(p > 1 - SETTLED, 1.0, p.astype(float)))
    left = [i for i in range(len(p)) if 0 < p[i] < 1]
    while len(left) > 1:
        i, j = left[:2]
        up, down = min(1 - p[i], p[j]), min(p[i], 1 - p[j])
        step = up if rng.random() * (up + down) < down else -down
        p[i], p[j] = p[i] + step, p[j] - step
        p[[i, j]] = np.where(p[[i, j]] < SETTLED, 0, np.where(p[[i, j]] > 1 - SETTLED, 1, p[[i, j]]))
        left = [k for k in left if 0 < p[k] < 1]
    for i in left:
        p[i] = float(rng.random() < p[i])
    return p


def _level(units: DataFrame, blocks: int, level: int, seed: int, land: bool) -> DataFrame:
    """One flight per source and block; ``units`` has (doc_id, label, tokens, whole, p)."""
    cut = units.withColumn("block", F.pmod(F.xxhash64("doc_id", F.lit(level)), F.lit(blocks)).cast("int"))

    def fly(table: pa.Table) -> pa.Table:
        table = table.sort_by([("doc_id", "ascending"), ("tokens", "ascending")])
        p, tokens = table.column("p").to_numpy(), table.column("tokens").to_numpy()
        label = table.column("label")[0].as_py()
        rng = np.random.default_rng([seed, level, int(table.column("block")[0].as_py()), *label.encode()])
        p = flight(p, tokens, rng)
        if land:
            p = landing(p, rng)
        return table.set_column(table.column_names.index("p"), "p", pa.array(p))

    return cut.groupBy("label", "block").applyInArrow(fly, cut.schema).drop("block")


def mix(documents: DataFrame, targets: DataFrame, tokenizer: str = TOKENIZER, seed: int = 20, size: int | None = None) -> tuple[DataFrame, DataFrame]:
    """The drawn mix (doc_id, source, tokens, copies) and its report, one row per row of ``targets``.

    Report: source, target_share, max_repeats, documents, source_tokens, target_tokens, reachable, drawn_tokens,
    actual_share. A source's target is ``target_share`` of ``size`` tokens, which by default are the tokens of all rows of
    ``documents``; shares reached are of the tokens drawn. A source that cannot reach its target gives every document
    ``max_repeats`` times; ``reachable`` is false where the draw took all of a source and yet falls short. Labels are compared without letter case and white space around; of targets with the same label
    the smallest spelling counts. A null share counts as 0, null repeats as 1. Documents without id, or of a source without
    a target, are not drawn but count in the total. Empty texts have no tokens and may be drawn. Repeated rows are rows.
    """
    spark = documents.sparkSession
    key = lambda c: F.lower(F.regexp_replace(c, r"(?U)^\s+|\s+\z", ""))
    sized = materialize(with_tokens(documents, tokenizer).withColumn("label", key(F.col("source"))), "tokens")
    total = size if size is not None else (sized.agg(F.sum("tokens")).first()[0] or 0)
    wanted = (
        targets.where(F.col("source").isNotNull())
        .groupBy(key(F.col("source")).alias("label"))
        .agg(F.min(F.struct("source", "target_share", "max_repeats")).alias("t"))
        .select("label", F.col("t.source").alias("source"), F.coalesce("t.target_share", F.lit(0.0)).alias("share"), F.coalesce("t.max_repeats", F.lit(1)).cast("int").alias("repeats"))
    )
    have = sized.where("doc_id is not null").groupBy("label").agg(F.count(F.lit(1)).alias("documents"), F.sum("tokens").alias("source_tokens"))
    plan = materialize(
        wanted.join(have, "label", "left")
        .withColumn("documents", F.coalesce("documents", F.lit(0)))
        .withColumn("source_tokens", F.coalesce("source_tokens", F.lit(0)))
        .withColumn("target_tokens", F.col("share") * F.lit(total))
        .withColumn(
            "rate",
            F.when(F.col("source_tokens") > 0, F.least(F.col("repeats").cast("double"), F.col("target_tokens") / F.nullif("source_tokens", F.lit(0))))
            .when(F.col("target_tokens") > 0, F.col("repeats").cast("double"))
            .otherwise(0.0),
        )
        .coalesce(1),
        "plan",
    )
    units = sized.where("doc_id is not null").join(F.broadcast(plan.select("label", "rate")), "label").select(
        "doc_id", "label", "tokens", F.floor("rate").cast("int").alias("whole"), (F.col("rate") - F.floor("rate")).alias("p")
    )  # plan: a row per target
    count, level = max([r[0] for r in plan.select("documents").collect()] or [0]), 0
    open_ = F.col("p").between(SETTLED, 1 - SETTLED)
    drawn = None
    while True:
        land = count <= FLIGHT
        flown = materialize(_level(units.where(open_) if level else units, max(1, -(-count // FLIGHT)), level, seed, land), f"flight{level}")
        settled = flown if land else flown.where(~open_)
        drawn = settled if drawn is None else drawn.unionByName(settled)
        if land:
            break
        units, level = flown, level + 1
        count = max([r[0] for r in flown.where(open_).groupBy("label").count().select("count").collect()] or [0])
    copies = (F.col("whole") + F.round("p").cast("int")).alias("copies")
    names = F.broadcast(plan.select("label", "source", "repeats"))
    every = drawn.join(names, "label").select("doc_id", "source", "tokens", copies, (F.col("repeats") == copies).cast("int").alias("full"))
    draw = every.where("copies > 0").drop("full")
    sums = every.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("drawn_tokens"), F.sum("full").alias("full"))
    whole = F.sum("drawn_tokens").over(_all())
    report = (
        plan.join(sums, "source", "left")
        .withColumn("drawn_tokens", F.coalesce("drawn_tokens", F.lit(0)))
        .withColumn("reachable", (F.coalesce("full", F.lit(0)) < F.col("documents")) | (F.col("drawn_tokens") >= F.col("target_tokens")))
        .withColumn("actual_share", F.when(whole > 0, F.col("drawn_tokens") / whole))
        .select(
            "source", F.col("share").alias("target_share"), F.col("repeats").alias("max_repeats"), "documents", "source_tokens",
            "target_tokens", "reachable", "drawn_tokens", "actual_share",
        )
    )
    return draw, report


def _all():
    from pyspark.sql import Window

    return Window.partitionBy(F.lit(0))  # over the rows of the report, one per target
