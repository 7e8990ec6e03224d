"""File manifests: small files as rows, large ones piece by piece."""

import hashlib

from plumbline.sources import writers as X


def test_manifest_streams_files_that_no_row_holds(spark, tmp_path):
    for k, size in enumerate((10, 900, 5_000, 70_000)):
        (tmp_path / f"part {k}.parquet").write_bytes(bytes(range(256)) * (size // 256 + 1))
    want = {(p.name, p.stat().st_size, hashlib.sha256(p.read_bytes()).hexdigest()) for p in tmp_path.iterdir()}
    for limit in (1_000, X.WHOLE_BYTES):
        assert {tuple(r) for r in X.manifest(spark, f"{tmp_path}/*.parquet", limit).collect()} == want


def test_manifest_of_a_file_beyond_a_row(spark, tmp_path):
    with open(tmp_path / "large.parquet", "wb") as f:
        f.truncate((1 << 31) + 5)  # sparse
    row = X.manifest(spark, f"{tmp_path}/*.parquet").first()
    assert row["size_bytes"] == (1 << 31) + 5 and len(row["sha256"]) == 64


def test_manifest_of_paths_only_spark_opens(spark, tmp_path, monkeypatch):
    (tmp_path / "a.parquet").write_bytes(b"x" * 5_000)
    assert X._opens(f"file:{tmp_path}/a.parquet") and not X._opens("nowhere://host/a.parquet")
    monkeypatch.setattr(X, "_opens", lambda path: False)
    assert X.manifest(spark, f"{tmp_path}/*.parquet", 1_000).first()["sha256"] == hashlib.sha256(b"x" * 5_000).hexdigest()
