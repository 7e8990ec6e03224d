"""Helpers of the training-data operators: text columns, shared folders, connected components."""

from __future__ import annotations

import gc
import json
import re
import uuid
from functools import reduce
from string import ascii_lowercase, ascii_uppercase

from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.session import cut_lineage, ensure_checkpoint_dir


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z only. ``lower`` has a fast path when every character is one byte."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, ascii_uppercase, ascii_lowercase))


def text_or_empty(column: str) -> Column:
    return F.coalesce(F.col(column), F.lit(""))


#: bytes of rows that reach a Python worker at once
BATCH_BYTES = 8 << 20
_BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def _in_bytes(size: str) -> int:
    """A size setting in bytes: digits and an optional unit, such as ``64m``; negative is unbounded."""
    digits, unit = re.fullmatch(r"\s*(-?\d+)\s*([kmgtp]?)b?\s*", size.lower()).groups()
    return int(digits) << 10 * " kmgtp".index(unit or " ")


def map_batches(df: DataFrame, function, schema: str) -> DataFrame:
    """``mapInPandas`` with batches bounded in bytes, so long texts do not pile up in a worker. Spark reads the bound from the session when the result is
    computed, so it is set there and stays; one that the session's owner has made smaller is kept."""
    conf = df.sparkSession.conf
    if not 0 < _in_bytes(conf.get(_BATCH_SETTING)) <= BATCH_BYTES:
        conf.set(_BATCH_SETTING, str(BATCH_BYTES))
    return df.mapInPandas(function, schema)


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A new folder below the shared checkpoint folder; every executor and the driver see it."""
    return f"{ensure_checkpoint_dir(spark)}/{purpose}-{uuid.uuid4().hex}"


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """``df`` written as a table in the shared folder and read back: lineage is cut, and columns are compressed, which a checkpoint's rows are not."""
    folder = shared_folder(df.sparkSession, purpose)
    df.write.parquet(folder)
    return df.sparkSession.read.parquet(folder)


def release_shuffles(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of results that are stored by now. It does so once the driver's collector finds their plans unreachable, which a driver with a
    roomy heap puts off for up to half an hour (``spark.cleaner.periodicGC.interval``) while the files of all steps pile up."""
    gc.collect()
    spark._jvm.System.gc()


def discard(held: DataFrame) -> None:
    """Delete the files of a table made by ``stored``, once nothing that is still to be computed reads it."""
    files, session = held.inputFiles(), held.sparkSession
    if files:
        folder = session._jvm.org.apache.hadoop.fs.Path(files[0].rsplit("/", 1)[0])
        folder.getFileSystem(session._jsc.hadoopConfiguration()).delete(folder, True)


def filesystem(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder and the path inside it; ``file:/x`` is what Hadoop prints for ``file:///x``."""
    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[len("file:"):]
    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)


def commit_files(manifest: DataFrame, folder: str) -> None:
    """Rename every temporary file of a materialised manifest (columns ``temp``, ``name``) to its final name,
    as a Spark job. Doing it twice is harmless: a name already in place stays."""

    def rename(batches):
        store, root = filesystem(folder)
        for pdf in batches:
            for temp, name in zip(pdf["temp"], pdf["name"]):
                if store.get_file_info(f"{root}/{name}").type == fs.FileType.NotFound:
                    store.move(f"{root}/{temp}", f"{root}/{name}")
            yield pdf[["name"]]

    manifest.select("temp", "name").mapInPandas(rename, "name string").write.format("noop").mode("overwrite").save()


def write_manifest(manifest: DataFrame, folder: str) -> DataFrame:
    """Commit the files, then the manifest itself, under a temporary name first. A folder without ``manifest``
    is an unfinished write. Returns the manifest as read back."""
    commit_files(manifest, folder)
    manifest.drop("temp").write.parquet(f"{folder}/_manifest")
    store, root = filesystem(folder)
    store.move(f"{root}/_manifest", f"{root}/manifest")
    return manifest.sparkSession.read.parquet(f"{folder}/manifest")


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of a link list: (node, component) with the smallest node of each component.

    Alternating large-star and small-star steps until the links stay the same, about the logarithm of the longest path in number; each is a group-by that is
    combined with a minimum before its shuffle, so a hub costs no more than its rows. Every round is cut with a reliable checkpoint. Nodes
    without links are not returned; null ends and self links are ignored."""
    edges = cut_lineage(links.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u is not null and v is not null and u <> v").distinct())
    if edges.isEmpty():
        return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    before, state = None, ()
    while state != before:
        before = state
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("x"), "u", "m")
        edges = small.select(F.col("x").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        edges = cut_lineage(edges)
        state = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("v", "u") % 1000003)).first()
    return edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def dumps(value) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"))
