"""File digests in ranges: small files, empty ones, odd names, a file above 2 GiB in bounded memory."""

import hashlib

from gradeline.operators import audit
from gradeline.sources import files, ranges


def test_same_as_the_binary_source(spark, tmp_path):
    for name, data in {"ship/a b+c.png": b"x" * 1000, "ship/é.PNG": b"e", "airplane/deep/z.png": bytes(range(256)) * 40, "ship/skip.txt": b"t", "top.png": b"q"}.items():
        path = tmp_path / "tree" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(data)
    root = str(tmp_path / "tree")
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    got = ranges.digest_files(spark, root, ["png"], task_bytes=2000, range_bytes=7)
    assert rows(got) == rows(files.scan_labeled_tree(spark, root)) and got.columns == files.scan_labeled_tree(spark, root).columns
    assert got.rdd.getNumPartitions() > 1
    assert ranges.digest_files(spark, root, ["jpeg"]).count() == 0
    (tmp_path / "tree" / "ship" / "empty.png").write_bytes(b"")  # Spark's file scan plans no read of an empty file
    assert {r["name"]: r["sha256"] for r in ranges.digest_files(spark, root, ["png"]).collect()}["empty.png"] == hashlib.sha256().hexdigest()


def test_sums_of_a_folder(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"one")
    (tmp_path / "b.txt").write_bytes(b"two")
    lines = [(f"{hashlib.sha256(d).hexdigest()}  {n}",) for n, d in (("a.txt", b"one"), ("b.txt", b"changed"), ("c.txt", b""))]
    manifest = audit.parse_sha256sums(spark.createDataFrame(lines, "value string"))
    found = audit.verify_sha256sums(manifest, ranges.directory_digests_of_any_size(spark, str(tmp_path), exclude=["SHA256SUMS"]))
    assert {(r["path"], r["rule"]) for r in found.collect()} == {("b.txt", "digest_mismatch"), ("c.txt", "missing_file")}


def test_a_file_above_two_gib(spark, tmp_path):
    size = (2 << 30) + 12345
    with open(tmp_path / "checkpoint.pt", "wb") as f:  # sparse: it takes no disk
        f.truncate(size - 4)
        f.seek(size - 4)
        f.write(b"tail")
    want = hashlib.sha256()
    with open(tmp_path / "checkpoint.pt", "rb") as f:
        while data := f.read(1 << 24):
            want.update(data)
    row = ranges.digest_files(spark, str(tmp_path)).first()
    assert (row["name"], row["length"], row["sha256"], row["label"]) == ("checkpoint.pt", size, want.hexdigest(), tmp_path.name)
