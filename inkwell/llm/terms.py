"""Frequency of every distinct value: how often, in how many records, and which are too rare or too common.

Method: a global integer dictionary over all values, blockwise count arrays for occurrences
and record presence, and a sum of those arrays by identifier range.

* Values travel as 64-bit codes; the strings are shuffled once a distinct value, in the dictionary.
  Codes that collide are told apart before they are used, so the counts are exact.
* A *block* is a bucket of records (hash of the record id), so that a record lies in one
  block and presence can be added up over blocks. Rows move to their block once; repeats are
  taken out and values are counted there. Rows of records that many rows have are spread by their
  own id instead, and counted by record and value before they meet.
* An *identifier* is a range number (hash of the value) and a dense position in that range.
  It needs no pass over one machine, and each range's array has a known length.
* A hot value is at most one row per block once the blocks are counted, so neither the
  encoding join nor the sum sees its skew.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkwell.session import bounded, written

#: Identifiers in one range; an array of 64k longs is half a megabyte.
RANGE_WIDTH = 65536


def _code(field: str, term: Column, clashes: list[int]) -> Column:
    """The 64-bit code of a field's value; codes that two values share are replaced by others."""
    code = F.xxhash64(F.lit(field), term)
    if clashes:
        code = F.when(code.isin(clashes), F.xxhash64(F.lit(1), F.lit(field), term)).otherwise(code)
    return F.when(term.isNotNull(), code)


def distinct_values(rows: DataFrame, fields: list[str]) -> tuple[DataFrame, list[int]]:
    """``(field, term, code)`` of every distinct value, written, and the codes that more than one value had."""
    one = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("term")) for f in fields]))
    values = rows.select(one.alias("x")).select("x.field", "x.term").where("term IS NOT NULL").groupBy("field", "term").agg(F.lit(1).alias("one"))
    values = written(values.select("field", "term", F.xxhash64("field", "term").alias("code")))
    twice = values.groupBy("code").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("code")
    clashes = [r["code"] for r in bounded(twice, 100_000, "the codes that collide")]
    if clashes:
        values = values.withColumn("code", F.when(F.col("code").isin(clashes), F.xxhash64(F.lit(1), "field", "term")).otherwise(F.col("code")))
    return values, clashes


def block_counts(rows: DataFrame, record: str, fields: list[str], row_id: str | None, n_blocks: int, clashes: list[int]) -> DataFrame:
    """``block, code, occ, pres``: one row per value and block.

    A row repeated whole counts once: rows are told apart by ``row_id`` (null is a value
    of its own). Records with more rows than a block should have are counted apart.
    """
    codes = [_code(f, F.col(f).cast("string"), clashes) for f in fields]
    names = [f"_c{i}" for i in range(len(fields))]
    flat = rows.select(F.col(record).alias("_rec"), *([F.col(row_id).alias("_rid")] if row_id else []), *[c.alias(n) for c, n in zip(codes, names)])
    sizes = rows.groupBy(F.col(record).alias("_rec")).agg(F.count(F.lit(1)).alias("n"))
    total = sizes.agg(F.sum("n")).first()[0] or 0
    most = max(1000, total // (4 * n_blocks))  # so there are no more than four hot records a block
    hot = [r["_rec"] for r in bounded(sizes.where(F.col("n") > most).select("_rec"), 4 * n_blocks + 1, "the records of very many rows")]
    is_hot = reduce(lambda a, b: a | b, [F.col("_rec").eqNullSafe(F.lit(x)) for x in hot]) if hot else F.lit(False)
    known = ["_rec", "_rid", *names] if row_id else None

    def counted(x: DataFrame) -> DataFrame:
        each = x.select("_rec", F.explode(F.array(*names)).alias("code")).where("code IS NOT NULL")
        return each.groupBy("_rec", "code").agg(F.count(F.lit(1)).alias("n"))

    # a block's rows meet once: the repartitioning serves the repeats and the counts alike
    cold = flat.where(~is_hot).repartition(n_blocks, "_rec")
    parts = counted(cold.dropDuplicates(known) if row_id else cold)
    if hot:
        warm = flat.where(is_hot)
        parts = parts.unionByName(counted(warm.dropDuplicates(known) if row_id else warm))
    block = F.pmod(F.xxhash64("_rec"), F.lit(n_blocks)).cast("int")
    pres = F.sum(F.when(F.col("_rec").isNotNull(), 1).otherwise(0)).cast("long")
    return parts.groupBy(block.alias("block"), "code").agg(F.sum("n").alias("occ"), pres.alias("pres"))


def dictionary(values: DataFrame, n_ranges: int) -> DataFrame:
    """``values`` with the global identifiers: ``rng`` is a hash, ``pos`` dense in its range."""
    rng = F.pmod(F.xxhash64("code"), F.lit(n_ranges)).cast("int")
    return values.withColumn("rng", rng).withColumn("pos", F.row_number().over(Window.partitionBy("rng").orderBy("code")) - 1)


def _sum_ranges(batches):
    """Adds the block arrays of one range after another; the rows come clustered by range."""
    at, occ, pres = None, None, None

    def out():
        keep = np.flatnonzero(occ)
        return pd.DataFrame({"rng": np.full(len(keep), at, "int32"), "pos": keep.astype("int32"), "occ": occ[keep], "pres": pres[keep]})

    for pdf in batches:
        for rng, pos, o, p in zip(pdf["rng"], pdf["pos"], pdf["occ"], pdf["pres"]):
            if rng != at:
                if at is not None:
                    yield out()
                at, occ, pres = rng, np.zeros(1024, "int64"), np.zeros(1024, "int64")
            pos = np.asarray(pos)
            if (need := int(pos.max()) + 1) > len(occ):
                size = 1 << (need - 1).bit_length()
                occ, pres = np.pad(occ, (0, size - len(occ))), np.pad(pres, (0, size - len(pres)))
            occ[pos] += np.asarray(o)  # a position occurs once in a block's array
            pres[pos] += np.asarray(p)
    if at is not None:
        yield out()


def term_frequencies(
    rows: DataFrame, record: str, fields: list[str], row_id: str | None = None, n_blocks: int | None = None, n_ranges: int | None = None
) -> DataFrame:
    """``field_name, term, n_rows, n_records`` for every distinct value of every field.

    Null is no value, the empty string is one. A row with a null record id counts as an
    occurrence but in no record. Rows repeated whole count once where ``row_id`` names their
    identifier. Other columns of ``rows`` play no part, whatever their names. An empty table
    gives an empty result. ``n_blocks`` and ``n_ranges`` only place the work: ranges are sized
    from the number of distinct values, so that an array stays near ``RANGE_WIDTH``.
    """
    spark = rows.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    values, clashes = distinct_values(rows, fields)
    if n_ranges is None:
        n_ranges = max(parts, math.ceil(values.count() / RANGE_WIDTH))
    ids = written(dictionary(values, n_ranges))
    counts = block_counts(rows, record, fields, row_id, n_blocks or parts, clashes)
    arrays = (
        counts.join(ids.select("code", "rng", "pos"), "code")
        .groupBy("block", "rng")
        .agg(F.collect_list(F.struct("pos", "occ", "pres")).alias("x"))  # one block's array of one range: bounded by the range's width
        .select("rng", F.col("x.pos").alias("pos"), F.col("x.occ").alias("occ"), F.col("x.pres").alias("pres"))
    )
    clustered = arrays.repartition(min(n_ranges, parts), "rng").sortWithinPartitions("rng")
    sums = clustered.mapInPandas(_sum_ranges, "rng int, pos int, occ long, pres long")
    return ids.join(sums, ["rng", "pos"]).select(F.col("field").alias("field_name"), "term", F.col("occ").alias("n_rows"), F.col("pres").alias("n_records"))


def marked_terms(freq: DataFrame, limits: DataFrame, rows: DataFrame, record: str) -> DataFrame:
    """``freq`` with ``mark`` (``rare``, ``common`` or null) under ``limits(field_name, min_files, max_permille)``.

    A field without limits gets no mark. ``limits`` has one row per field.
    """
    total = rows.agg(F.countDistinct(record).alias("total"))
    bounds = limits.select("field_name", "min_files", "max_permille", total.scalar().alias("total"))
    mark = F.when(F.col("n_records") < F.col("min_files"), "rare").when(F.col("n_records") * 1000 > F.col("max_permille") * F.col("total"), "common")
    return freq.join(bounds, "field_name", "left").withColumn("mark", mark).drop("min_files", "max_permille", "total")


def found(spark, sf_dir: str) -> DataFrame:
    alerts = spark.read.parquet(f"{sf_dir}/alerts.parquet")
    limits = spark.read.parquet(f"{sf_dir}/term_limits.parquet")
    freq = term_frequencies(alerts, "file_id", ["check_name", "match_text"], "alert_id")
    return marked_terms(freq, limits, alerts, "file_id").where("mark IS NOT NULL").select("field_name", "term", "mark")


def all_frequencies(spark, sf_dir: str) -> DataFrame:
    alerts = spark.read.parquet(f"{sf_dir}/alerts.parquet")
    limits = spark.read.parquet(f"{sf_dir}/term_limits.parquet")
    freq = term_frequencies(alerts, "file_id", ["check_name", "match_text"], "alert_id")
    return marked_terms(freq, limits, alerts, "file_id")


_FREQ_SQL = """
WITH x AS (SELECT DISTINCT alert_id, file_id, check_name, match_text FROM alerts),
v AS (SELECT 'check_name' AS field_name, check_name AS term, file_id FROM x UNION ALL SELECT 'match_text', match_text, file_id FROM x),
g AS (SELECT field_name, term, count(*) AS n_rows, count(DISTINCT file_id) AS n_records FROM v WHERE term IS NOT NULL GROUP BY 1, 2),
m AS (SELECT g.field_name, g.term, g.n_rows, g.n_records,
  CASE WHEN n_records < min_files THEN 'rare' WHEN n_records * 1000 > max_permille * (SELECT count(DISTINCT file_id) FROM alerts) THEN 'common' END AS mark
  FROM g LEFT JOIN term_limits l ON l.field_name = g.field_name)
"""
QUERIES = {"p1_found": found, "p1_term_frequencies": all_frequencies}
SQL = {
    "p1_found": _FREQ_SQL + "SELECT field_name, term, mark FROM m WHERE mark IS NOT NULL",
    "p1_term_frequencies": _FREQ_SQL + "SELECT field_name, term, n_rows, n_records, mark FROM m",
}
