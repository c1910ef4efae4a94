"""File sources, record contracts, sinks, label gate, digests."""

import hashlib
import struct
import tempfile
import zlib
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from gradeline.functions import digests
from gradeline.operators import audit, bank, grid, metrics, raster, splits
from gradeline.sources import files, records, writers


@pytest.fixture()
def folder():
    return Path(tempfile.mkdtemp(prefix="gradeline-test-"))


def png(width, height, value=100):
    def chunk(kind, data):
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    rows = b"".join(b"\0" + bytes((value + x + y) % 256 for x in range(width)) for y in range(height))
    head = struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


@pytest.fixture()
def tree(folder):
    for cls, name, body in [("airplane", "b.png", png(5, 4)), ("airplane", "a.png", png(3, 2)), ("ship", "c d.png", png(7, 7)), ("ship", "labels.csv", b"x"), ("ship", "broken.png", b"no image")]:
        (folder / cls).mkdir(exist_ok=True)
        (folder / cls / name).write_bytes(body)
    return folder


def test_scan_labeled_tree(spark, tree):
    rows = files.scan_labeled_tree(spark, str(tree)).collect()
    assert [r["filepath"] for r in rows] == ["airplane/a.png", "airplane/b.png", "ship/broken.png", "ship/c d.png"]
    assert [r["label"] for r in rows] == ["airplane", "airplane", "ship", "ship"]
    assert rows[0]["sha256"] == hashlib.sha256((tree / "airplane" / "a.png").read_bytes()).hexdigest()


def test_image_area_keeps_unreadable_files(spark, tree):
    got = {Path(r["origin"].replace("%20", " ")).name: (r["area"], r["error"]) for r in files.image_area(files.read_images(spark, str(tree))).collect()}
    assert got["a.png"] == (6.0, None) and got["c d.png"] == (49.0, None) and got["broken.png"] == (None, "unreadable")


def test_explode_images(spark, tree):
    grid_rows = raster.explode_images(files.read_images(spark, str(tree / "airplane")))
    per = {Path(r["origin"]).name: (r["n"], r["m"]) for r in grid_rows.groupBy("origin").agg(F.count("v").alias("n"), F.max("v").alias("m")).collect()}
    assert per == {"a.png": (6, 100 + 2 + 1), "b.png": (20, 100 + 4 + 3)}


def test_manifest_anchor(spark, folder):
    path = folder / "m.txt"
    path.write_bytes("b/2.png\na/1.png".encode())
    good = hashlib.sha256(path.read_bytes()).hexdigest()
    assert files.read_manifest(spark, str(path), good, 2).count() == 2
    with pytest.raises(ValueError, match="digest"):
        files.read_manifest(spark, str(path), "0" * 64)
    with pytest.raises(ValueError, match="2 lines"):
        files.read_manifest(spark, str(path), None, 3)


def test_sha256sums_roundtrip(spark, tree):
    lines = [f"{hashlib.sha256(p.read_bytes()).hexdigest()}  {p.relative_to(tree)}" for p in sorted(tree.rglob("*")) if p.is_file()]
    sums = tree.parent / (tree.name + "-SUMS.txt")
    sums.write_text("\n".join(lines) + "\n")
    actual = files.directory_digests(spark, str(tree))
    assert audit.verify_sha256sums(files.read_sha256sums(spark, str(sums)), actual).count() == 0
    (tree / "ship" / "labels.csv").write_bytes(b"changed")
    (tree / "ship" / "new.txt").write_bytes(b"new")
    bad = {r["path"]: r["rule"] for r in audit.verify_sha256sums(files.read_sha256sums(spark, str(sums)), files.directory_digests(spark, str(tree))).collect()}
    assert bad == {"ship/labels.csv": "digest_mismatch", "ship/new.txt": "unlisted_file"}
    broken = spark.createDataFrame([("zz  a.txt",)], "value string")
    with pytest.raises(Exception, match="invalid line"):
        audit.parse_sha256sums(broken).collect()
    escape = spark.createDataFrame([("../a", "0" * 64), ("x", "0" * 64), ("x", "0" * 64)], "path string, digest string")
    rules = {r["path"]: r["rule"] for r in audit.verify_sha256sums(escape, spark.createDataFrame([("x", "0" * 64)], "path string, digest string")).collect()}
    assert rules == {"../a": "escapes_root", "x": "duplicate_path"}


def test_name_set_signature_bytes(spark):
    names = ["b.png", "a.png", "ä.png"]
    h = hashlib.sha256()
    for n in sorted(names):
        h.update(len(n.encode()).to_bytes(4, "big") + n.encode())
    df = spark.createDataFrame([("g", n) for n in names], "g string, name string")
    assert digests.name_set_signature(df, ["g"], "name").first()["signature"] == h.hexdigest()


def test_manifest_fingerprint_bytes(spark):
    entries = [("ship", "b.png", "1" * 32), ("airplane", "z.png", "2" * 32), ("ship", "a.png", "3" * 32)]
    want = hashlib.md5("|".join(f"{c}/{n}:{d}" for c, n, d in sorted(entries)).encode()).hexdigest()
    df = spark.createDataFrame([("k", *e) for e in entries], "k string, c string, n string, d string")
    assert digests.manifest_fingerprint(df, ["k"], "c", "n", "d").first()["fingerprint"] == want


def test_tree_signature_sees_every_change(spark):
    rows = [("k", "ship", f"f{i}", str(i)) for i in range(50)]
    root = lambda r: digests.tree_signature(spark.createDataFrame(r, "k string, c string, n string, d string").repartition(3), ["k"], "c", "n", "d").first()["root"]
    base = root(rows)
    assert root(rows[::-1]) == base
    assert len({base, root(rows[1:]), root([("k", "ship", "f0", "x"), *rows[1:]]), root([("k", "ship", "g0", "0"), *rows[1:]])}) == 4


def test_strict_json_refuses_nan(spark, folder):
    with pytest.raises(Exception, match="refusing to write NaN"):
        writers.write_strict_json(spark.createDataFrame([(float("nan"),)], "v double"), str(folder / "x"))


def test_new_only(spark, folder):
    df = spark.range(3)
    writers.write_new_only(df, str(folder / "out"))
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        writers.write_new_only(df, str(folder / "out"))


def test_run_records_by_file_name(spark, folder):
    for arm in (0, 1):
        for seed in (0, 1):
            (folder / f"{arm}_seed{seed}.json").write_text('{\n "value": %d\n}\n' % (10 * arm + seed))
    read = lambda **k: records.read_run_records(spark, str(folder), "value int", multiline=True, **k)
    got = {(r["arm"], r["seed"]): r["value"] for r in read(strict={"arm": [0, 1], "seed": [0, 1]}).collect()}
    assert got == {(0, 0): 0, (0, 1): 1, (1, 0): 10, (1, 1): 11}
    with pytest.raises(ValueError, match="missing"):
        read(strict={"arm": [0, 1], "seed": [0, 1, 2]})
    (folder / "notes.json").write_text('{"value": 5}')
    assert read().count() == 4


def test_envelope_shapes(spark):
    docs = spark.createDataFrame([('[{"a": 1}, {"a": 2}]',), ('{"records": [{"a": 3}]}',)], "d string")
    assert sorted(r["a"] for r in records.read_records_envelope(docs, "d", "struct<a: int>").collect()) == [1, 2, 3]
    with pytest.raises(Exception, match="non-empty array"):
        records.read_records_envelope(spark.createDataFrame([('{"records": []}',)], "d string"), "d", "struct<a: int>").collect()


def test_label_gate(spark, folder):
    df = spark.createDataFrame([(1, 0), (2, 1)], "id int, y int")
    for reason, caller in [("", "me"), ("why", " ")]:
        with pytest.raises(PermissionError):
            audit.authorized_labels(df, "y", reason, caller, str(folder / "log"))
    rows, access = audit.authorized_labels(df, "y", "why", "me", str(folder / "log"))
    rows.collect()
    access.record()
    assert spark.read.json(str(folder / "log")).first()["n_labels_read"] == 2


def test_align_labels_is_strict(spark):
    a = spark.createDataFrame([(1, 0.5), (2, 0.25)], "id int, p double")
    b = spark.createDataFrame([(1, 0), (2, 1)], "id int, y int")
    assert audit.align_labels(a, b, "id").count() == 2
    for bad in (b.where("id = 1"), b.unionByName(b.where("id = 1")), b.unionByName(spark.createDataFrame([(3, 0)], "id int, y int"))):
        with pytest.raises(Exception, match="duplicated or unmatched"):
            audit.align_labels(a, bad, "id").collect()


def test_content_diff_refuses_other_roster(spark):
    a = spark.createDataFrame([("x", "1"), ("y", "2")], "n string, d string")
    assert {r["n"]: r["state"] for r in audit.content_diff(a, a.withColumn("d", F.lit("1")), ["n"], "d").collect()} == {"x": "unchanged", "y": "changed"}
    with pytest.raises(Exception, match="one roster only"):
        audit.content_diff(a, a.where("n = 'x'"), ["n"], "d").collect()


def test_cache_lookup_refuses_infinite(spark):
    ids = spark.createDataFrame([("a",), ("b",)], "k string")
    with pytest.raises(Exception, match="non-finite"):
        audit.cache_lookup(ids, spark.createDataFrame([("a", float("inf"))], "k string, s double"), "k", "s").collect()


def test_merge_verified_refuses_changed_copy(spark):
    a = spark.createDataFrame([(1, "x")], "id int, digest string")
    with pytest.raises(Exception, match="copy differs"):
        splits.merge_verified(a, a, "id", "digest", [a.withColumn("digest", F.lit("y"))]).collect()


def test_kfold_counts_match_the_usual_sizes(spark):
    df = spark.range(553).select(F.col("id"), F.when(F.col("id") < 66, "airplane").otherwise("ship").alias("label"))
    out = splits.stratified_kfold(df, [], "label", "id", 5, 42).groupBy("fold").agg(
        F.count_if(F.col("label") == "airplane").alias("a"), F.count_if(F.col("label") == "ship").alias("s")
    )
    assert sorted((r["a"], r["s"]) for r in out.collect()) == sorted([(14, 97), (13, 98), (13, 98), (13, 97), (13, 97)])
    table = splits.expand_folds(splits.stratified_kfold(df, [], "label", "id", 5, 42))
    assert splits.leak_check(table, ["fold"], "id").count() == 0
    assert splits.fold_coverage_check(table, [], "id", 5).count() == 0


def test_metrics_from_stored_matrix_and_contract(spark):
    cells = spark.createDataFrame([(3, 1, 2, 2)], "c00 bigint, c01 bigint, c10 bigint, c11 bigint")
    r = metrics.metrics_from_confusion(cells).first()
    assert r["macro_f1"] == pytest.approx(0.6190476190476191) and r["accuracy"] == 0.625 and r["aircraft_recall"] == 0.75


def test_grid_complete_lists_every_problem(spark):
    cells = spark.createDataFrame([(0, 0), (0, 0), (1, 1), (2, 0)], "a int, b int")
    got = {(r["a"], r["b"]): r["problem"] for r in grid.grid_complete(cells, {"a": [0, 1], "b": [0, 1]}).collect()}
    assert got == {(0, 0): "duplicate", (0, 1): "missing", (1, 0): "missing", (2, 0): "extra"}


def test_filter_bank_reports_all_reasons(spark):
    row = (1, 11.0, 600.0, 1.0, None, 0.0, 1.0, 0, 16)
    df = spark.createDataFrame([row], "entry_id int, hl_c double, hl_loc double, hl_scale double, sh_c double, sh_loc double, sh_scale double, hl_psd_size int, sh_psd_size int")
    assert bank.filter_bank(df).first()["reasons"] == ["hl_shape", "hl_location", "hl_psd_failed", "sh_fit_failed"]


def test_weibull_fit_solves_the_likelihood_equations(spark):
    np = pytest.importorskip("numpy")
    rng = np.random.default_rng(0)
    px = np.clip(np.round(60 * rng.weibull(2.2, 4000)), 1, 255)
    df = spark.createDataFrame([("a", float(v)) for v in px] + [("few", 3.0)] * 10 + [("zero", float(v)) for v in [0] * 60], "g string, v double")
    out = {r["g"]: r for r in raster.weibull_fit_by_group(df, ["g"], "v").collect()}
    c, s = out["a"]["c"], out["a"]["scale"]
    assert s == pytest.approx(np.mean(px**c) ** (1 / c), rel=1e-9)
    assert (px**c * np.log(px)).sum() / (px**c).sum() - 1 / c == pytest.approx(np.log(px).mean(), abs=1e-9)
    assert out["few"]["c"] is None and out["zero"]["c"] is None and out["a"]["n_px"] == 4000


def test_gmm_labels_follow_the_means(spark):
    rows = [(i, float(m + i % 5)) for m in (20, 120, 220) for i in range(100)]
    out = raster.gmm_segment(spark.createDataFrame(rows, "i int, v double"), "v")
    means = {r["label"]: r["m"] for r in out.groupBy("label").agg(F.avg("v").alias("m")).collect()}
    assert [means[k] for k in sorted(means)] == sorted(means.values()) and out.count() == 300


def test_pick_clean_candidate_falls_back_to_cleanest(spark):
    rows = [("a", 0, 0.5), ("a", 1, 0.05), ("a", 2, 0.0), ("b", 0, 0.4), ("b", 1, 0.2), ("b", 2, 0.3)]
    got = {r["k"]: (r["draw"], r["clean"], r["redraws"]) for r in splits.pick_clean_candidate(spark.createDataFrame(rows, "k string, d int, f double"), ["k"], "d", "f").collect()}
    assert got == {"a": (1, True, 1), "b": (1, False, 2)}


def test_soft_knees_are_continuous(spark):
    from gradeline.functions.scalars import soft_ceil, soft_floor

    df = spark.createDataFrame([(10.0,), (9.999999,), (-50.0,), (245.0,), (245.000001,), (400.0,)], "x double")
    lo = [r[0] for r in df.select(soft_floor("x", 10.0)).collect()]
    hi = [r[0] for r in df.select(soft_ceil("x", 10.0)).collect()]
    assert lo[0] == 10.0 and lo[1] == pytest.approx(10.0, abs=1e-5) and 0 < lo[2] < 0.1
    assert hi[3] == 245.0 and hi[4] == pytest.approx(245.0, abs=1e-5) and 254 < hi[5] < 255
