"""Files as documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkwell.plans.config import glob_regex


def read_folder(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    """``doc_id, path, ext, text`` of every file below a folder that fits the glob; ``.git`` and ``node_modules`` are left out.

    The glob is applied to paths before contents are decoded. ``doc_id`` is a hash of the path, so
    it is the same in every run and needs no pass over all files.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    path = F.regexp_replace("path", "^file:/*", "/")
    keep = ~path.rlike(r"/(\.git|node_modules)/")
    negate, pattern = glob.startswith("!"), glob.lstrip("!")
    fits = path.rlike("^" + glob_regex("*" + pattern if not pattern.startswith(("*", "/")) else pattern).pattern + "$")
    text = F.decode("content", "UTF-8")
    return raw.where(keep & (~fits if negate else fits)).select(F.xxhash64(path).alias("doc_id"), path.alias("path"), F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1)).alias("ext"), text.alias("text"))


def from_text(spark: SparkSession, text: str, ext: str = ".txt", path: str = "stdin") -> DataFrame:
    return spark.createDataFrame([(0, path, ext, text)], "doc_id long, path string, ext string, text string")


def json_values(rows: DataFrame, key: str, column: str, paths: dict[str, str]) -> DataFrame:
    """``key, name, value``: named values of a JSON column by path; a path that isn't there gives no row."""
    each = F.array(*[F.struct(F.lit(n).alias("name"), F.get_json_object(column, p).alias("value")) for n, p in paths.items()])
    return rows.select(key, F.explode(each).alias("x")).select(key, "x.name", "x.value").where("value IS NOT NULL")
