"""Items of varying length put whole into containers of fixed capacity.

Method: the histogram of lengths is all that the driver sees (at most one row per length up to
the capacity). Shallow combinations of lengths that fill a container up to a small window are
enumerated, non-negative least squares finds how often to repeat each against the histogram,
the counts are rounded within what there is, and the rest is packed greedily, pattern by
pattern. The plan is a list of patterns with repeat counts; each item finds its container from
its rank among the items of its length.
"""

from __future__ import annotations

import heapq
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkwell.llm.sizes import TOKENIZERS, with_tokens
from inkwell.session import bounded, spread, written

#: The unused share of a container that a combination may have, and the combinations that are weighed.
WINDOW, MOST_COMBINATIONS = 0.01, 30_000
#: The solver ends when a round lowers the squared residual by less than this share, or after so many rounds.
CONVERGED, ROUNDS = 1e-4, 5000
#: Items of one length that are ranked in one task.
RANKED = 500_000
PARTNERS = 6  # the random second lengths that each length is tried with


@dataclass
class Pattern:
    """A way to fill a container: items by length, and how many containers are filled so."""

    items: dict[int, int]
    repeats: int


def combinations(sizes: np.ndarray, capacity: int, window: int, most: int = MOST_COMBINATIONS, counts: np.ndarray | None = None) -> list[dict[int, int]]:
    """Sets of up to four items, of at most three lengths, that fill the capacity to within the window.

    Where there are more than ``most``, each length leads one before any leads more; the others
    go to the lengths by their ``counts``, so that no part of the histogram is passed over.
    """
    have = np.zeros(capacity + 1, bool)
    have[sizes] = True
    under = np.maximum.accumulate(np.where(have, np.arange(capacity + 1), -1))  # the largest length not above
    out: dict[tuple, dict[int, int]] = {}
    r = np.random.default_rng(5)

    def led_by(a: int):
        if capacity - a <= window:
            yield (a,)
        for times in (1, 2, 3):
            left = capacity - times * a
            if left <= 0:
                break
            b = int(under[left])
            for _ in range(4):
                if b <= 0 or left - b > window:
                    break
                yield (*[a] * times, b)
                b = int(under[b - 1])
        for b in r.choice(sizes, min(PARTNERS, len(sizes)), replace=False):
            left = capacity - a - int(b)
            if left > 0 and (c := int(under[left])) > 0 and left - c <= window:
                yield (a, int(b), c)

    weights = np.ones(len(sizes)) if counts is None else counts
    turns = [(0.0, -float(n), -int(a), 0, led_by(int(a))) for a, n in zip(sizes, weights)]
    heapq.heapify(turns)
    while turns and len(out) < most:
        _, n, a, taken, more = heapq.heappop(turns)
        for parts in more:
            c = dict(Counter(parts))
            if (key := tuple(sorted(c.items()))) not in out:
                out[key] = c
                heapq.heappush(turns, ((taken + 1) / -n, n, a, taken + 1, more))
                break
    return list(out.values())


def solve(combos: list[dict[int, int]], histogram: np.ndarray, rounds: int = ROUNDS, converged: float = CONVERGED) -> np.ndarray:
    """Repeat counts x >= 0 that bring the lengths used nearest to the histogram, in least squares.

    Multiplicative updates keep x non-negative and never raise the residual; each round costs as
    much as there are parts, and the rounds end when they no longer gain.
    """
    rows = np.array([s for c in combos for s in c])
    cols = np.array([j for j, c in enumerate(combos) for _ in c])
    vals = np.array([m for c in combos for m in c.values()], dtype=float)
    h = histogram.astype(float)
    n = len(combos)
    x = np.full(n, h.sum() / max(1, 3 * n))
    goal = np.bincount(cols, vals * h[rows], n)
    before = np.inf
    for i in range(rounds):
        used = np.bincount(rows, vals * x[cols], len(h))
        if i % 10 == 0:
            left = float(((used - h) ** 2).sum())
            if left == 0 or i and before - left <= converged * before:
                break
            before = left
        x *= goal / np.maximum(np.bincount(cols, vals * used[rows], n), 1e-12)
    return x


def plan(histogram: dict[int, int], capacity: int) -> list[Pattern]:
    """Patterns that use up the histogram ``{length: count}`` of lengths from 1 to the capacity."""
    left = np.zeros(capacity + 1, np.int64)
    for s, n in histogram.items():
        left[s] = n
    sizes = np.flatnonzero(left)
    out: list[Pattern] = []
    if len(sizes) and (combos := combinations(sizes, capacity, max(1, int(capacity * WINDOW)), counts=left[sizes])):
        x = solve(combos, left)
        for j in np.argsort(-x, kind="stable"):
            times = min([int(round(x[j])), *(int(left[s]) // m for s, m in combos[j].items())])
            if times > 0:
                out.append(Pattern(combos[j], times))
                for s, m in combos[j].items():
                    left[s] -= times * m
    # the rest: the largest length first, then the largest that still fits; each pattern uses up a length
    while (sizes := np.flatnonzero(left)).size:
        items: dict[int, int] = {}
        room = capacity
        while room > 0 and (i := int(np.searchsorted(sizes, room, side="right"))) > 0:
            s = int(sizes[i - 1])
            take = min(int(left[s]) - items.get(s, 0), room // s)
            if take > 0:
                items[s] = items.get(s, 0) + take
                room -= take * s
            sizes = sizes[: i - 1]
        times = min(int(left[s]) // m for s, m in items.items())
        out.append(Pattern(items, times))
        for s, m in items.items():
            left[s] -= times * m
    return out


def slots(patterns: list[Pattern]) -> dict[int, np.ndarray]:
    """By length, rows ``(first rank, items a container, first container)`` in order of rank."""
    at: dict[int, int] = {}
    rows: dict[int, list[tuple[int, int, int]]] = {}
    base = 0
    for p in patterns:
        for s, m in p.items.items():
            rows.setdefault(s, []).append((at.get(s, 0), m, base))
            at[s] = at.get(s, 0) + m * p.repeats
        base += p.repeats
    return {s: np.array(r, dtype=np.int64) for s, r in rows.items()}


def pack(items: DataFrame, packs: DataFrame, ranked: int = RANKED, most_packs: int = 10_000) -> DataFrame:
    """``pack_name, container_id, item_id, piece_no, first_token, n_tokens``: every item in a container of every pack.

    ``items(item_id, size, lang)``; ``packs(pack_name, lang, capacity_tokens, gap_tokens)`` with
    ``lang`` null for all languages (else compared in lower case). An item larger than the
    capacity is split into full pieces and a rest; no other is split. Two items in a container
    have ``gap_tokens`` between them. An item without tokens, or of null size, needs no room: it
    comes out with a null container. Each row of ``items`` is an item of its own, so repeated
    rows are packed twice. A length that a third of all items have is ranked in parts of about
    ``ranked`` items, by hash; the driver sees counts by length alone.
    """
    ps = {r["pack_name"]: r for r in bounded(packs, most_packs, "the packs")}
    for r in ps.values():
        if r["capacity_tokens"] is None or r["capacity_tokens"] < 1:
            raise ValueError(f"pack {r['pack_name']} needs a capacity of one token at least")
    # the packs are a handful of literals, so items meet them without a join
    kinds = [F.struct(F.lit(r["pack_name"]).alias("name"), F.lit(r["lang"].lower() if r["lang"] else None).cast("string").alias("lang"), F.lit(int(r["capacity_tokens"])).cast("long").alias("cap"), F.lit(int(r["gap_tokens"] or 0)).cast("long").alias("gap")) for r in ps.values()]
    kinds = F.array(*kinds) if kinds else F.array().cast("array<struct<name:string,lang:string,cap:bigint,gap:bigint>>")
    fits = F.filter(kinds, lambda p: p["lang"].isNull() | (p["lang"] == F.lower("lang")))
    each = items.select("item_id", F.coalesce("size", F.lit(0)).cast("long").alias("size"), F.explode(fits).alias("p"))
    each = each.select("item_id", "size", F.col("p.name").alias("pack_name"), F.col("p.cap").alias("cap"), F.col("p.gap").alias("gap"))
    n = F.greatest(F.lit(1), F.ceil(F.col("size") / F.col("cap"))).cast("int")
    each = each.select("pack_name", "item_id", "size", "cap", "gap", F.posexplode(F.array_repeat(F.lit(0), n)).alias("piece_no", "zero"))
    first = F.col("piece_no") * F.col("cap")
    each = each.select("pack_name", "item_id", "piece_no", "gap", first.alias("first_token"), F.least(F.col("size") - first, F.col("cap")).alias("n_tokens"))
    each = written(each.withColumn("room", F.col("n_tokens") + F.col("gap")))
    most = sum(r["capacity_tokens"] + (r["gap_tokens"] or 0) for r in ps.values())
    hist: dict[str, dict[int, int]] = {}
    for r in bounded(each.where("n_tokens > 0").groupBy("pack_name", "room").agg(F.count(F.lit(1)).alias("n")), most + 1, "the histograms of lengths"):
        hist.setdefault(r["pack_name"], {})[r["room"]] = r["n"]
    table: dict[str, dict[int, np.ndarray]] = {}
    for name, h in hist.items():
        table[name] = slots(plan(h, ps[name]["capacity_tokens"] + (ps[name]["gap_tokens"] or 0)))
    # lengths that many items have are ranked in parts; few have so many that the parts are literals
    hot = [(name, room, -(-n // ranked)) for name, h in hist.items() for room, n in h.items() if n > ranked]
    part = F.lit(0)
    if hot:
        parts = each.sparkSession.createDataFrame(hot, "pack_name string, room long, parts int")  # no more rows than there are lengths
        each = each.join(F.broadcast(parts), ["pack_name", "room"], "left")
        part = F.pmod(F.xxhash64("item_id", "piece_no"), F.coalesce("parts", F.lit(1))).cast("int")
    full = each.where("n_tokens > 0").withColumn("part", part)
    rank = F.row_number().over(Window.partitionBy("pack_name", "room", "part").orderBy("item_id", "piece_no")) - 1
    full = full.withColumn("rank", rank)
    if hot:
        counts = each.where("parts > 1").groupBy("pack_name", "room", part.alias("part")).agg(F.count(F.lit(1)).alias("n"))
        offset = F.sum("n").over(Window.partitionBy("pack_name", "room").orderBy("part")) - F.col("n")
        most_parts = sum(p for *_, p in hot)
        offsets = each.sparkSession.createDataFrame(bounded(counts.select("pack_name", "room", "part", offset.alias("offset")), most_parts, "the parts of frequent lengths"), "pack_name string, room long, part int, offset long")
        full = full.join(F.broadcast(offsets), ["pack_name", "room", "part"], "left").withColumn("rank", F.col("rank") + F.coalesce("offset", F.lit(0)))

    def place(batches):
        for pdf in batches:
            box = np.empty(len(pdf), np.int64)
            for (name, room), rows in pdf.groupby(["pack_name", "room"], sort=False).indices.items():
                t = table[name][room]
                rank = pdf["rank"].to_numpy()[rows]
                i = np.searchsorted(t[:, 0], rank, side="right") - 1
                box[rows] = t[i, 2] + (rank - t[i, 0]) // t[i, 1]
            yield pd.DataFrame({"pack_name": pdf["pack_name"], "container_id": box, "item_id": pdf["item_id"], "piece_no": pdf["piece_no"], "first_token": pdf["first_token"], "n_tokens": pdf["n_tokens"]})

    schema = "pack_name string, container_id long, item_id long, piece_no int, first_token long, n_tokens long"
    cols = ["pack_name", "room", "rank", "item_id", "piece_no", "first_token", "n_tokens"]
    placed = full.select(*cols).mapInPandas(place, schema)
    none = each.where("n_tokens <= 0").select("pack_name", F.lit(None).cast("long").alias("container_id"), "item_id", "piece_no", "first_token", "n_tokens")
    return placed.unionByName(none)


def _items(spark, sf_dir: str, folder: str = TOKENIZERS) -> tuple[DataFrame, DataFrame]:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    items = with_tokens(spread(docs, "doc_id"), "text", "size", folder=folder).select(F.col("doc_id").alias("item_id"), "size", "lang")
    return items, spark.read.parquet(f"{sf_dir}/pack_sizes.parquet")


def packed(spark, sf_dir: str) -> DataFrame:
    return pack(*_items(spark, sf_dir)).withColumnRenamed("item_id", "doc_id")


def fill(spark, sf_dir: str) -> DataFrame:
    """Per pack: its containers, the fewest that the tokens could need, and the share of room in use."""
    items, packs = _items(spark, sf_dir)
    rows = pack(items, packs).where("container_id IS NOT NULL")
    boxes = rows.groupBy("pack_name", "container_id").agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("n_items"))
    sums = boxes.groupBy("pack_name").agg(F.count(F.lit(1)).alias("containers"), F.sum("tokens").alias("tokens"), F.sum("n_items").alias("items"))
    cap = F.col("capacity_tokens")
    return sums.join(packs.select("pack_name", "capacity_tokens"), "pack_name").select(
        "pack_name", "containers", "items", "tokens", F.ceil(F.col("tokens") / cap).alias("fewest"), (F.col("tokens") / (F.col("containers") * cap)).alias("filled")
    )


QUERIES = {"p6_packed": packed, "p6_fill": fill}
SQL: dict[str, str] = {}
