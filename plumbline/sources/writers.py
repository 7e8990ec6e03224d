"""Writers: parquet with provenance, the spatially ordered release, file manifests."""

from __future__ import annotations

import hashlib

from pyarrow import fs
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: larger files are not read as one value; a value ends at 2 GB
WHOLE_BYTES, PIECE_BYTES = 128 << 20, 8 << 20


def write_with_provenance(df: DataFrame, path: str, sources: list[str], partition_by: list[str] | None = None) -> DataFrame:
    """Zstd parquet plus a one-row provenance record; the row count is observed while writing."""
    obs = Observation("written")
    w = df.observe(obs, F.count(F.lit(1)).alias("n_rows")).write.mode("overwrite").option("compression", "zstd")
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)
    row = [(path, obs.get["n_rows"], df.columns, sources)]
    prov = df.sparkSession.createDataFrame(row, "path string, n_rows long, columns array<string>, sources array<string>").coalesce(1)
    prov.write.mode("overwrite").json(path.rstrip("/") + "_provenance")
    return prov


def _spread(x: Column) -> Column:
    """Sixteen bits moved to the even places of thirty-two."""
    for shift, mask in ((8, 0x00FF00FF), (4, 0x0F0F0F0F), (2, 0x33333333), (1, 0x55555555)):
        x = x.bitwiseOR(F.shiftleft(x, shift)).bitwiseAND(F.lit(mask).cast("long"))
    return x


def morton(df: DataFrame, x: str, y: str, out: str = "morton") -> DataFrame:
    """Z-order code of a position over the table's own extent."""
    e = df.agg(F.struct(F.min(x).alias("x0"), F.max(x).alias("x1"), F.min(y).alias("y0"), F.max(y).alias("y1"))).scalar()
    d = df.withColumn("_e", e)
    cell = lambda c, a, b: F.floor((F.col(c) - F.col(f"_e.{a}")) / F.greatest(F.col(f"_e.{b}") - F.col(f"_e.{a}"), F.lit(1e-10)) * 65535.0).cast("long")
    return d.withColumn(out, _spread(cell(x, "x0", "x1")).bitwiseOR(F.shiftleft(_spread(cell(y, "y0", "y1")), 1))).drop("_e")


def write_release(units: DataFrame, boundaries: DataFrame, path: str, files: int, key: str = "zcta_id", lon: str = "lon", lat: str = "lat") -> None:
    """Units with boundaries in Z-order, so neighbouring units share row groups."""
    d = morton(units.join(boundaries, key), lon, lat)
    d.repartitionByRange(files, "morton").sortWithinPartitions("morton", key).drop("morton").write.mode("overwrite").option("compression", "zstd").parquet(path)


def _opened(path: str):
    """A stream of a file from wherever a worker can open it."""
    if path.startswith("file:"):
        return fs.LocalFileSystem().open_input_stream("/" + path[len("file:") :].lstrip("/"), compression=None)
    store, inner = fs.FileSystem.from_uri(path)
    return store.open_input_stream(inner, compression=None)


def _opens(path: str) -> bool:
    try:
        _opened(path).close()
        return True
    except (OSError, ValueError, NotImplementedError):
        return False


def _streamed(batches):
    for pdf in batches:
        sums = []
        for path in pdf["path"]:
            h = hashlib.sha256()
            with _opened(path) as f:
                while chunk := f.read(PIECE_BYTES):
                    h.update(chunk)
            sums.append(h.hexdigest())
        yield pdf.assign(sha256=sums)


def manifest(spark: SparkSession, glob: str, whole_bytes: int = WHOLE_BYTES) -> DataFrame:
    """Name, size and SHA-256 of every file; a file is hashed where it is read.

    Files up to ``whole_bytes`` are values of one row; larger ones, which may exceed what a row holds, are hashed piece by piece, one file a task. A hash takes its
    file from the first byte to the last, so no file is split over tasks."""
    f = spark.read.format("binaryFile").load(glob)
    small = f.filter(F.col("length") <= whole_bytes).select("path", "length", F.sha2("content", 256).alias("sha256"))
    sizes = f.filter(F.col("length") > whole_bytes).select("path", "length")  # contents are not read here
    n = sizes.count()
    if n and not _opens(sizes.first()["path"]):  # only Spark's readers reach these files
        small, n = f.select("path", "length", F.sha2("content", 256).alias("sha256")), 0
    if n:
        small = small.unionByName(sizes.repartition(n, "path").mapInPandas(_streamed, "path string, length long, sha256 string"))
    return small.select(F.element_at(F.split("path", "/"), -1).alias("file"), F.col("length").alias("size_bytes"), "sha256")
