"""Sources mixed to target weights.

Method: every record has a hash. Tokens are summed by source and leading bits of the hash; the
cumulated sums show in which bucket each source's budget ends; only that bucket is summed
again by its next bits, until the record is found at which it ends. A record is taken if its hash
lies below its source's threshold, so nothing is sorted, and the threshold of a smaller budget is
no higher than that of a larger one.

The record at the threshold may be too long for what is left of a budget. Then the longest record
behind it that fits is taken too; where even that is less than half of the rest, the search goes on
with the same histograms among the records that fit. So what is open at least halves each time,
until it is no more than a share ``NEAR`` of the budget or no record fits. With records much
smaller than budgets there is nothing to mend.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwell.llm.sizes import TOKENIZERS, with_tokens
from inkwell.session import bounded, release, spread, written

BITS, TOP = 10, 60  # bits of the hash that a level reads, and those that are used in all
NEAR = 1e-4  # the share of a budget that may stay open


def _budgets(targets: list, sizes: dict[str, int], total: int | None) -> list[dict]:
    """How many tokens each mix takes of each source.

    Without a stated total a mix is as large as its scarcest source allows at the target
    shares. The shares of sources without tokens are spread over the others.
    """
    out = []
    for mix in sorted({t["mix_name"] for t in targets}):
        rows = [t for t in targets if t["mix_name"] == mix]
        live = [t for t in rows if sizes.get(t["source"], 0) > 0 and (t["target_share"] or 0) > 0 and (t["max_repeats"] or 0) > 0]
        whole = sum(t["target_share"] for t in live)
        room = [t["max_repeats"] * sizes[t["source"]] * whole / t["target_share"] for t in live]
        size = min(room, default=0) if total is None else total
        for t in rows:
            have = sizes.get(t["source"], 0)
            want = min(size * t["target_share"] / whole, t["max_repeats"] * have) if t in live else 0.0
            copies = min(int(want // have), t["max_repeats"]) if have else 0
            out.append({"mix_name": mix, "source": t["source"], "target_share": t["target_share"], "max_repeats": t["max_repeats"], "have": have, "copies": copies, "rest": want - copies * have})
    return out


def thresholds(records: DataFrame, budgets: list[dict], near: float = NEAR) -> None:
    """Sets ``stretches`` in every budget: a record is taken once more if it lies in one of them.

    ``records(source, h, n_tokens)`` with ``h`` from 0 to 2^60 - 1. A stretch is ``(lo, hi, most)``:
    hashes from ``lo`` to below ``hi``, records of at most ``most`` tokens.
    """
    for b in budgets:
        b |= {"stretches": [], "open": b["rest"], "lo": 0, "most": (1 << 62), "known": []}
    stretch = [b for b in budgets if b["rest"] > 0 and b["have"] > 0]
    while stretch:
        _stretch(records, stretch, near)
        stretch = []
        short = _short(budgets, near)
        while short:
            single = _longest(records, short)
            stretch += [b for b in short if b["i"] in single and single[b["i"]][0] * 2 < b["open"]]
            short = _short([b for b in short if b["i"] in single and b not in stretch], near)


def _short(budgets: list[dict], near: float) -> list[dict]:
    out = [b for b in budgets if b["lo"] < 1 << TOP and b["have"] > 0 and b["open"] >= 1 and b["open"] > near * b["rest"]]
    for i, b in enumerate(out):
        b["i"], b["most"] = i, int(b["open"])
    return out


def _wants(spark, wants: list[dict]) -> DataFrame:
    """A row for each budget; the hashes already looked at are few, see ``thresholds``."""
    schema = "i int, source string, up long, lo long, most long, known array<long>"
    return F.broadcast(spark.createDataFrame([(b["i"], b["source"], b.get("at"), b["lo"], b["most"], b["known"]) for b in wants], schema))


def _longest(records: DataFrame, short: list[dict]) -> dict[int, tuple[int, int]]:
    """The longest record behind each budget's threshold that fits; it is taken if it fills half of what is open."""
    spark = records.sparkSession
    hit = records.join(_wants(spark, short), "source").where("h >= lo AND n_tokens <= most AND n_tokens > 0 AND NOT array_contains(known, h)")
    best = hit.groupBy("i").agg(F.max(F.struct("n_tokens", F.negative("h").alias("h"))).alias("x"))
    got = {r["i"]: (r["x"]["n_tokens"], -r["x"]["h"]) for r in bounded(best, len(short), "the longest records")}
    taken = [b for b in short if b["i"] in got and got[b["i"]][0] * 2 >= b["open"]]
    if taken:
        # repeated records have one hash: they are taken all or not at all
        at = spark.createDataFrame([(b["i"], b["source"], got[b["i"]][1]) for b in taken], "i int, source string, h long")
        sums = records.join(F.broadcast(at), ["source", "h"]).groupBy("i").agg(F.sum("n_tokens").alias("n"))
        n = {r["i"]: r["n"] for r in bounded(sums, len(taken), "the longest records")}
        for b in taken:
            h = got[b["i"]][1]
            b["known"].append(h)
            if n[b["i"]] <= b["open"]:
                b["open"] -= n[b["i"]]
                b["stretches"].append((h, h + 1, 1 << 62))
    return got


def _stretch(records: DataFrame, wants: list[dict], near: float) -> None:
    """The next stretch of each budget: as far from ``lo`` as its records up to ``most`` tokens stay within ``open``.

    One pass over the records finds the buckets in which the budgets end; the records of these
    are written, some thousandth of all, and the further levels read only them.
    """
    spark = records.sparkSession
    for i, b in enumerate(wants):
        b |= {"i": i, "at": 0, "end": None}
    rows, shift = records, TOP
    while shift > 0 and (live := [b for b in wants if b["end"] is None]):
        first, shift = shift == TOP, shift - BITS
        hit = rows.withColumn("up", F.shiftright("h", shift + BITS)).join(_wants(spark, live), ["source", "up"]).where("h >= lo AND n_tokens <= most AND NOT array_contains(known, h)")
        sums = hit.groupBy("i", F.shiftright("h", shift).alias("k")).agg(F.sum("n_tokens").alias("n"))
        got: dict[int, list[tuple[int, int]]] = {}
        for r in bounded(sums, len(live) << BITS, "the sums by bucket"):
            got.setdefault(r["i"], []).append((r["k"], r["n"]))
        for b in live:
            b["at"] = None
            for k, n in sorted(got.get(b["i"], [])):
                if n > b["open"]:
                    b["at"] = k
                    if n <= near * b["rest"]:
                        b["end"] = k << shift  # what this bucket could add is less than may stay open
                    break
                b["open"] -= n
            if b["at"] is None:
                # all of it fits: to the end, or to the end of the bucket that was read
                b["end"] = 1 << TOP if first else (b["bucket"] + 1) << (shift + BITS)
            b["bucket"] = b["at"]
        if first and (live := [b for b in live if b["end"] is None]):
            last = spark.createDataFrame(sorted({(b["source"], b["at"]) for b in live}), "source string, up long")
            rows = written(rows.join(F.broadcast(last), (F.shiftright("h", shift) == F.col("up")) & (rows["source"] == last["source"])).select(rows["source"], "h", "n_tokens"))
    for b in wants:
        end = b["end"] if b["end"] is not None else b["at"] << shift  # at the last level a bucket is one hash
        if end > b["lo"]:
            b["stretches"].append((b["lo"], end, b["most"]))
        b["lo"] = end if b["end"] is not None else end + 1
    if rows is not records:
        release(rows)


def mix(records: DataFrame, targets: DataFrame, total: int | None = None, seed: int = 0, most_targets: int = 2_000) -> tuple[DataFrame, DataFrame]:
    """``(taken, shares)`` for every mix of ``targets(mix_name, source, target_share, max_repeats)``.

    ``records(record_id, source, n_tokens)``. ``taken(mix_name, source, record_id, copies)`` has one
    row per mix and record that is taken at least once; no record is taken more than its source's
    ``max_repeats`` times, and copies of a source's records differ by one at most. ``shares`` has,
    for every target, the tokens there are and taken, the repeats, and the share reached (null in
    a mix without tokens). Records with a null source or id belong to no mix; records without
    tokens go with their hash; a repeated row is a record of its own. A source without records
    takes nothing and its share goes to the others. A hot source is only ever summed by bucket.
    """
    spark = records.sparkSession
    h = F.shiftrightunsigned(F.xxhash64(F.lit(seed), "record_id"), 64 - TOP)
    rows = written(records.where("record_id IS NOT NULL AND source IS NOT NULL").select("record_id", "source", F.coalesce("n_tokens", F.lit(0)).cast("long").alias("n_tokens"), h.alias("h")))
    wanted = bounded(targets, most_targets, "the targets")
    names = spark.createDataFrame([(x,) for x in sorted({t["source"] for t in wanted if t["source"] is not None})], "source string")
    sums = rows.join(F.broadcast(names), "source", "left_semi").groupBy("source").agg(F.sum("n_tokens").alias("n"))
    budgets = _budgets(wanted, {r["source"]: r["n"] for r in bounded(sums, most_targets, "the sources of the mixes")}, total)
    thresholds(rows, budgets)
    schema = "mix_name string, source string, target_share double, max_repeats int, have long, copies int, stretches array<struct<lo:long,hi:long,most:long>>"
    b = spark.createDataFrame([(x["mix_name"], x["source"], x["target_share"], x["max_repeats"], x["have"], x["copies"], x["stretches"]) for x in budgets], schema)
    inside = F.exists("stretches", lambda s: (F.col("h") >= s["lo"]) & (F.col("h") < s["hi"]) & (F.col("n_tokens") <= s["most"]))
    n = F.col("copies") + F.when(inside, 1).otherwise(0)
    hit = rows.join(F.broadcast(b.select("mix_name", "source", "copies", "stretches")), "source").withColumn("copies", n).where("copies > 0")
    taken = hit.select("mix_name", "source", "record_id", "copies")
    sums = hit.groupBy("mix_name", "source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("taken_tokens"), F.max("copies").alias("repeats"), F.count(F.lit(1)).alias("n_records"))
    whole = sums.groupBy("mix_name").agg(F.sum("taken_tokens").alias("mix_tokens"))
    shares = b.join(sums, ["mix_name", "source"], "left").join(whole, "mix_name", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    shares = shares.select("mix_name", "source", "target_share", "max_repeats", F.col("have").alias("source_tokens"), zero("taken_tokens"), zero("n_records"), zero("repeats"), F.try_divide(F.coalesce("taken_tokens", F.lit(0)), F.col("mix_tokens")).alias("actual_share"))
    return taken, shares


def _mix(spark, sf_dir: str, folder: str = TOKENIZERS) -> tuple[DataFrame, DataFrame]:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    records = with_tokens(spread(docs, "doc_id"), "text", "n_tokens", folder=folder).select(F.col("doc_id").alias("record_id"), "source", "n_tokens")
    return mix(records, spark.read.parquet(f"{sf_dir}/mix_targets.parquet"))


def mixed(spark, sf_dir: str) -> DataFrame:
    return _mix(spark, sf_dir)[0].withColumnRenamed("record_id", "doc_id")


def shares(spark, sf_dir: str) -> DataFrame:
    return _mix(spark, sf_dir)[1]


QUERIES = {"p7_mixed": mixed, "p7_shares": shares}
SQL: dict[str, str] = {}
