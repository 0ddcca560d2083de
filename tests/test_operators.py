import hashlib
import os

import pytest
from pyspark.sql import functions as F

from siltstone.functions import exprs
from siltstone.operators import cleanup, duplicates, pathaudit, reuse, scope
from siltstone.plans import store
from siltstone.sources import hashing, inventory

BIG = bytes(i % 251 for i in range(200000))


@pytest.mark.parametrize(
    ("content", "blake", "sample"),
    [
        (b"", "0e5751c026e543b2e8ab2eb06099daa1d1e5df47778f7787faab45cdf12fe3a8", "c804ce198ec337e3dc762bdd1a09aece"),
        (b"hello", "324dcf027dd4a30a932c441f365a25e86b173defa4b8e58948253471b81b72cf", "1da02013dd1b331b1424b4f6c2ea8bd7"),
        (BIG, "04bb8ecaae05b9024a76314d4e774b4bda8ad4c662e5dc008764fc6c37284653", "14750975f570a88f169b955b83525289"),
    ],
)
def test_hashes(tmp_path, content, blake, sample):
    path = tmp_path / "f"
    path.write_bytes(content)
    found = hashing.hash_file(os.fsencode(path), "blake2b", empty_policy="report")
    assert (found["digest"], found["sample_digest"]) == (blake, sample)
    assert found["status"] == ("ok" if content else "empty_reported")


def test_hash_refuses_links(tmp_path):
    (tmp_path / "a").write_text("x")
    (tmp_path / "l").symlink_to(tmp_path / "a")
    assert hashing.hash_file(os.fsencode(tmp_path / "l"))["status"] == "error"
    with pytest.raises(ValueError):
        hashing.hasher("md5")


def values(spark, rows, column):
    return [r[0] for r in spark.createDataFrame([(i, x) for i, x in enumerate(rows)], "i int, x string").orderBy("i").select(column).collect()]


def test_copy_names(spark):
    names = ["a.txt", "a (1).txt", "a(1).txt", "a copy.txt", "a COPY 3.txt", "copy.txt", "a copy", "a (٣).txt", "a (2).tar.gz", ".bashrc"]
    assert values(spark, ["/d/" + n for n in names], exprs.copy_score(F.col("x"))) == [0, 1, 1, 1, 1, 0, 0, 1, 0, 0]
    assert values(spark, names, exprs.extension_of(F.col("x"))) == [".txt"] * 6 + ["", ".txt", ".gz", ""]
    assert values(spark, ["/d/A (1).txt", "/d/a copy 2.TXT"], exprs.plain_name(F.col("x"))) == ["a.txt", "a.txt"]


def test_globs(spark):
    for glob, expected in [("b/*.txt", 1), ("/a/*", 0), ("/a/b/*", 1), ("**/c.txt", 1), ("/**/c.txt", 0), ("*/b", 0), ("[bc].txt", 1)]:
        assert values(spark, ["/a/b/c.txt"], exprs.glob_match(F.col("x"), glob)) == [bool(expected)], glob


def test_scalars(spark):
    sizes = [1152, 1408, 2176, 512]
    assert values(spark, [str(x) for x in sizes], exprs.human_bytes(F.col("x").cast("long"))) == ["1.12 KiB", "1.38 KiB", "2.12 KiB", "512.00 B"]
    assert values(spark, ["abc", "a😀b", "é", ""], exprs.utf16_length(F.col("x"))) == [3, 4, 1, 0]
    assert values(spark, ["1700000000123456000", "0", None], exprs.iso_time(F.col("x").cast("long"))) == ["2023-11-14T22:13:20.123456+00:00", "1970-01-01T00:00:00+00:00", ""]
    assert values(spark, ["a\nb", "\x01", "\x7f"], exprs.display(F.col("x"))) == ["a\\nb", "\\x01", "\\x7f"]


FILES = "id long, path string, digest string, size_bytes long, device long, inode long, allocated_bytes long, cleanup_risk string, status string"


def test_duplicates(spark):
    rows = [
        (1, "/a", "x", 5, 1, 1, 4, "low", "ok"), (2, "/b", "x", 5, 1, 1, 4, "critical", "reused"), (3, "/c", "x", 5, 1, 2, None, "low", "ok"), (4, "/d", "y", 5, 1, 3, 8, "low", "ok"),
        (5, "/e", "y", 5, 1, 3, 8, "low", "ok"), (6, "/f", "x", 6, 1, 4, 8, "low", "ok"), (7, "/g", "", 5, 1, 5, 8, "low", "ok"), (8, "/h", "x", 5, 1, 6, 8, "low", "error"),
    ]
    found = {r["digest"]: r for r in duplicates.groups(duplicates.eligible(spark.createDataFrame(rows, FILES))).collect()}
    assert (found["x"]["path_count"], found["x"]["physical_copy_count"], found["x"]["group_risk"], found["x"]["reclaimable_max_bytes"]) == (3, 2, "critical", 4)
    assert (found["y"]["path_count"], found["y"]["physical_copy_count"]) == (2, 1)


def test_keeper_and_protection(spark):
    rows = [(i, p, "x", 5, 1, i, 5, "low", "ok") for i, p in enumerate(["/k/a.txt", "/k/a (1).txt", "/k/a copy.txt", "/digital/a.txt", "/digital/a (1).txt"], 1)]
    files = spark.createDataFrame(rows, FILES)
    clusters = cleanup.clusters(files, "low")
    assert [r["parent"] for r in clusters.collect()] == ["/k"]  # a folder's name with "git" in it is blocked
    found = cleanup.proposals(cleanup.keepers(files, clusters, protect=["/k/a copy.txt"]))
    assert {(r["keeper_path"], r["candidate_path"]) for r in found.collect()} == {("/k/a copy.txt", "/k/a.txt"), ("/k/a copy.txt", "/k/a (1).txt")}


def test_upsert_and_strict(spark):
    old = spark.createDataFrame([("a", 1, 1), ("b", 1, 1)], "path string, size_bytes long, seen_generation int")
    new = spark.createDataFrame([("a", 2, 1), ("c", 3, 2)], "path string, size_bytes long, seen_generation int")
    merged = reuse.upserted(old, new, ["path"])
    assert {(r[0], r[1]) for r in merged.collect()} == {("a", 2), ("b", 1), ("c", 3)}
    assert reuse.swept(merged, 2).count() == 1


def test_real_tree(spark, tmp_path):
    (tmp_path / "a.txt").write_text("hello")
    (tmp_path / "sub" / "deep").mkdir(parents=True)
    os.link(tmp_path / "a.txt", tmp_path / "sub" / "hard.txt")
    (tmp_path / "link.txt").symlink_to(tmp_path / "a.txt")
    (tmp_path / "sub" / "sp ace#1\n.txt").write_text("w")
    (tmp_path / "sub" / "deep" / "n").write_text("n")
    with open(os.fsencode(tmp_path) + b"/\xff", "w") as f:
        f.write("")
    spark.dataSource.register(inventory.InventorySource)
    read = spark.read.format("inventory").option("roots", f"{tmp_path}:{tmp_path}/sub/deep").load()
    rows = {bytes(r["path_raw"]): r for r in read.filter("item_type = 'file'").collect()}
    assert {os.path.basename(p) for p in rows} == {b"a.txt", b"hard.txt", b"sp ace#1\n.txt", b"n", b"\xff"}
    assert rows[os.fsencode(tmp_path / "sub/deep/n")]["root_id"] == 2
    found = hashing.hashed_files(read.filter("item_type = 'file'")).filter("status = 'ok'")
    assert found.groupBy("digest").count().filter("count = 2").count() == 1


def test_store(spark, tmp_path):
    assert store.fingerprint({"b": 1, "a": [1]}) == store.fingerprint({"a": [1], "b": 1})
    rows = spark.createDataFrame([("a,b", 'q"x', None), ("l ", "=1", "")], "x string, y string, z string")
    store.write_report(rows, f"{tmp_path}/r", ["x"])
    part = next(p for p in (tmp_path / "r").iterdir() if p.suffix == ".csv")
    assert part.read_bytes() == b'x,y,z\r\n"a,b","q""x",\r\nl ,=1,\r\n'
    store.write_snapshot(rows, f"{tmp_path}/s", "one")
    assert store.read_snapshot(spark, f"{tmp_path}/s", "one").filter("scan_id = 'one'").count() == 2
    assert inventory.mounts("36 35 98:0 / /mnt\\040x rw shared:1 - ext3 /dev/root rw\nshort") == [("98:0", "/mnt x", "ext3", "/dev/root")]


def test_stream(spark, tmp_path):
    from siltstone.streaming.incremental import upsert_stream

    schema = "path string, size_bytes long, seen_generation int"
    for g in (1, 2):
        spark.createDataFrame([("a", g, g), (f"p{g}", g, g)], schema).write.mode("append").parquet(f"{tmp_path}/in")
        upsert_stream(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/check", ["path"]).awaitTermination()
    assert {(r[0], r[1]) for r in spark.read.parquet(f"{tmp_path}/out/version=1").collect()} == {("a", 2), ("p1", 1), ("p2", 2)}


def test_cleanup_runs(spark, tmp_path):
    from siltstone.plans import actions

    tree = tmp_path / "tree"
    (tree / "k").mkdir(parents=True)
    for name in ("a.txt", "a (1).txt", "a copy.txt", "b.txt", "b (1).txt"):
        (tree / "k" / name).write_text(name[0] * 9)
    spark.dataSource.register(inventory.InventorySource)
    walked = spark.read.format("inventory").option("roots", str(tree)).load().filter("item_type = 'file'")
    hashed = hashing.hashed_files(walked).withColumn("path", F.col("path_raw").cast("string")).withColumn("cleanup_risk", F.lit("low"))
    files = spark.createDataFrame(hashed.withColumn("id", F.xxhash64("path_raw")).collect())  # as they were, whatever happens then

    def names():
        return sorted(p.name for p in (tree / "k").iterdir())

    for wrong in ({"action": "delete"}, {"action": "delete", "token": actions.TOKEN, "full_verify": False}, {"action": "delete", "token": actions.TOKEN, "eligibility": "all"}, {"action": "quarantine"}, {"action": "quarantine", "quarantine": "/q", "risk": "critical"}):
        with pytest.raises(ValueError):
            actions.run_cleanup(spark, files, actions.CleanupPolicy(**wrong), f"{tmp_path}/store")
    actions.run_cleanup(spark, files, actions.CleanupPolicy(), f"{tmp_path}/store")
    assert len(names()) == 5

    # a candidate that has changed since the scan stays; the keepers do too
    (tree / "k" / "b (1).txt").write_text("other")
    moved = actions.run_cleanup(spark, files, actions.CleanupPolicy(action="quarantine", quarantine=f"{tmp_path}/q", protect=[f"{tree}/k/a copy.txt"]), f"{tmp_path}/store")
    assert names() == ["a copy.txt", "b (1).txt", "b.txt"]
    assert sorted(p.name for p in (tmp_path / "q" / moved).rglob("*.txt")) == ["a (1).txt", "a.txt"]
    run = spark.read.parquet(f"{tmp_path}/store/cleanup_runs").collect()[0]
    assert (run["proposed_files"], run["quarantined_files"], run["skipped_files"], run["failed_files"], run["reclaimed_bytes"], run["state"]) == (3, 2, 1, 0, 18, "completed")

    # the rest of a scan that no longer holds: keepers are gone, so nothing is deleted
    actions.run_cleanup(spark, files, actions.CleanupPolicy(action="delete", token=actions.TOKEN), f"{tmp_path}/store")
    assert names() == ["a copy.txt", "b (1).txt", "b.txt"]


def test_deletion(spark, tmp_path):
    from siltstone.plans import actions

    for name in ("a.txt", "a (1).txt", "a copy.txt"):
        (tmp_path / name).write_text("same")
    paths = spark.createDataFrame([(os.fsencode(tmp_path / n),) for n in ("a.txt", "a (1).txt", "a copy.txt")], "path_raw binary")
    files = hashing.hashed_files(paths).select("*", F.xxhash64("path_raw").alias("id"), F.col("path_raw").cast("string").alias("path"), F.lit("low").alias("cleanup_risk")).collect()
    run_id = actions.run_cleanup(spark, spark.createDataFrame(files), actions.CleanupPolicy(action="delete", token=actions.TOKEN), f"{tmp_path}/store")
    assert [p.name for p in tmp_path.glob("*.txt")] == ["a.txt"]
    rows = spark.read.parquet(f"{tmp_path}/store/cleanup_actions/cleanup_run_id={run_id}").collect()
    assert {r["action_result"] for r in rows} == {"deleted"} and len(rows) == 2


def test_inventory_keeps_nulls(spark, tmp_path):
    import duckdb

    from siltstone.plans import adapters

    rows = [(1, "a", "en", "src1"), (2, None, "en", "src1"), (3, None, "de", "src1"), (4, "a", "en", None), (5, "a", "en", None), (6, None, "en", None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r["id"], r["inode"], r["digest"]) for r in adapters.inventory(spark, str(tmp_path)).collect()}
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert got == set(con.sql(f"{adapters.PLAIN} SELECT id, inode, digest FROM inv").fetchall()) and len(got) == 6


def test_keep_is_a_folder(spark):
    """A folder to keep is taken by components, not as a glob; the order of folders counts."""
    rows = [(i, p, "x", 5, 1, i, 5, "low", "ok") for i, p in enumerate(["/m/a.txt", "/m/keep/a.txt", "/m/keeper/a.txt", "/m/last/a.txt"], 1)]
    files = spark.createDataFrame(rows, FILES)
    ranked = cleanup.keepers(files, cleanup.whole_groups(files), keep=["/m/keep", "/m/last"], whole=True)
    assert [r["path"] for r in ranked.orderBy("place").collect()] == ["/m/keep/a.txt", "/m/last/a.txt", "/m/a.txt", "/m/keeper/a.txt"]
    assert {r["candidate_path"] for r in cleanup.proposals(ranked).collect()} == {"/m/a.txt", "/m/keeper/a.txt", "/m/last/a.txt"}


def test_folding(spark):
    texts = [f"A{c}b" for c in map(chr, range(0x110000)) if not 0xD800 <= ord(c) < 0xE000 and (c.lower() != c or c.casefold() != c)] + ["ΑΣ", "Σ", "İI", "ﬃ ß ẞ"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", exprs.folded(F.col("t")).alias("f")).collect()
    assert [(r["t"], r["f"]) for r in got if r["f"] != r["t"].casefold()] == []


@pytest.mark.parametrize("inline", [1000, 0])
def test_longest_prefix(spark, monkeypatch, inline):
    """Repeated rows, nulls and paths that nothing covers stay, whichever way the prefixes are met."""
    monkeypatch.setattr(scope, "INLINE", inline)
    rows = [(1, "/a/b/c", None), (1, "/a/b/c", None), (2, "/ab", 1), (None, "/x", None), (3, "/a", 2), (4, None, 2)]
    paths = spark.createDataFrame(rows, "id long, path string, device long")
    found = scope.owned_by_root(paths, spark.createDataFrame([("/a", 1), ("/a/b", 2)], "root string, root_id long"))
    assert sorted((r["path"] or "", r["id"] or 0, r["root_id"]) for r in found.collect()) == [("", 4, None), ("/a", 3, 1), ("/a/b/c", 1, 2), ("/a/b/c", 1, 2), ("/ab", 2, None), ("/x", 0, None)]
    mounts = spark.createDataFrame([(1, "/", "ext4", "/dev/a"), (2, "/a", "xfs", None)], "device long, mount_point string, filesystem_type string, mount_source string")
    got = sorted((r["path"] or "", r["mount_point"] or "", r["filesystem_type"], r["mount_source"]) for r in scope.mounted(paths, mounts).collect())
    assert got == [("", "", "unknown", "unknown"), ("/a", "/a", "xfs", "unknown"), *[("/a/b/c", "/a/b/c", "unknown", "unknown")] * 2, ("/ab", "/", "ext4", "/dev/a"), ("/x", "/x", "unknown", "unknown")]
    assert scope.owned_by_root(paths, spark.createDataFrame([], "root string, root_id long")).count() == 6


def test_scan_life_cycle(spark, tmp_path):
    from siltstone.plans import lifecycle

    catalog, root = f"{tmp_path}/catalog", tmp_path / "tree"
    root.mkdir()
    options = lifecycle.ScanOptions([str(root)], audit_paths=True)
    scan_id = lifecycle.begin_scan(spark, catalog, options)
    assert [(r["root"], r["root_id"]) for r in lifecycle.roots(spark, catalog, scan_id).collect()] == [(str(root), 1)]
    lifecycle.set_state(spark, catalog, scan_id, "interrupted", "signal\n2")
    row = lifecycle.scans(spark, catalog).collect()
    assert [(r["state"], r["reason"], r["generation"]) for r in row] == [("interrupted", "signal\\n2", 1)]
    with pytest.raises(ValueError):
        lifecycle.resume_scan(spark, catalog, lifecycle.ScanOptions([str(root)]))
    assert lifecycle.resume_scan(spark, catalog, options) == (scan_id, 2)
    lifecycle.set_state(spark, catalog, scan_id, "completed")
    done = scope.latest_scan(lifecycle.scans(spark, catalog), "completed", "sha256").collect()
    assert [(r["scan_id"], r["generation"]) for r in done] == [(scan_id, 2)]
    with pytest.raises(ValueError):
        lifecycle.resume_scan(spark, catalog, options)
    assert len(options.payload()) == 16 and len(options.payload(legacy=True)) == 8
    assert len(lifecycle.accepted_fingerprints(options, 2)) == 2 and len(lifecycle.accepted_fingerprints(options, 3)) == 1
    for wrong in ({"roots": []}, {"empty_files": "x"}, {"chunk_mib": 0}, {"audit_only": True, "audit_paths": False}, {"policy": pathaudit.PathPolicy(warning=300)}):
        with pytest.raises(ValueError):
            lifecycle.ScanOptions(**({"roots": ["/"]} | wrong)).checked()
    assert lifecycle.mount_of("/mnt/x", os.makedev(8, 1), [("8:1", "/", "ext4", "/dev/a"), ("8:1", "/mnt", "xfs", "/dev/b"), ("8:2", "/mnt/x", "xfs", "/dev/c")], {"/dev/b": "u-1"}) == ("/mnt", "xfs", "/dev/b", "u-1")
    files = spark.createDataFrame([("ok", 8, 2.0), ("error", 0, 0.0), ("reused", 0, 0.0)], "status string, bytes_read long, elapsed_seconds double")
    assert lifecycle.held_rows(files) == 2 and lifecycle.throughput(files).first()["bytes_per_second"] == 4.0
    uuids = spark.createDataFrame([("/dev/b", "u-1")], "mount_source string, filesystem_uuid string")
    held = scope.with_disk_uuid(spark.createDataFrame([("/a", "/dev/b"), ("/c", "unknown")], "path string, mount_source string"), uuids)
    assert {(r["path"], r["filesystem_uuid"]) for r in held.collect()} == {("/a", "u-1"), ("/c", "")}


def test_statuses_and_snapshot(spark):
    from siltstone.operators import duplicates as d

    kinds = ["ok", "ok", "reused", "empty", "empty_reported", "changed", "cancelled", "error", "error", "error"]
    row = d.status_counters(spark.createDataFrame([(k,) for k in kinds], "status string")).first()
    assert (row["examined"], row["hashed"], row["reused"], row["empty"], row["changed"], row["cancelled"], row["errors"]) == (10, 2, 1, 2, 1, 1, 3)
    kept = spark.createDataFrame([("/a", "x", "ok", 5)], "path string, digest string, status string, bytes_read long")
    new = spark.createDataFrame([("/b", "y", "ok", 7)], "path string, digest string, status string, bytes_read long")
    assert {tuple(r) for r in reuse.assembled(kept, new, 3).select("path", "status", "bytes_read", "seen_generation").collect()} == {("/a", "reused", 0, 3), ("/b", "ok", 7, 3)}


def _report(folder):
    import csv

    lines = [line for p in sorted(folder.glob("part-*")) for line in p.read_text().splitlines()]
    return list(csv.DictReader(lines))


def test_scan_from_end_to_end(spark, tmp_path):
    """First scan, a scan that reuses hashes, one after an interruption, and clean-up, by the command line."""
    from siltstone import __main__ as command
    from siltstone.plans import lifecycle, scan, store

    tree, out = tmp_path / "tree", tmp_path / "out"
    (tree / "sub" / ("d" * 120)).mkdir(parents=True)
    for name, text in {"a.txt": "one", "a (1).txt": "one", "sub/b.bin": "two" * 50_000, "empty": ""}.items():
        (tree / name).write_text(text)
    os.link(tree / "a.txt", tree / "sub" / "hard.txt")
    with open(os.fsencode(tree) + b"/\xff", "w") as f, open(tree / "\\udcff", "w") as g:  # shown alike
        f.write("x")
        g.write("y")
    base = ["--root", str(tree), "--output-dir", str(out)]
    assert command.main([*base, "--audit-paths"]) == 0
    rows = _report(out / scan.ALL_FILES)
    assert len(rows) == 7 and len(rows[0]) == 23
    by = {bytes.fromhex(r["path_bytes_hex"])[len(str(tree)) + 1 :]: r for r in rows}
    assert by[b"a.txt"]["hash"] == hashlib.sha256(b"one").hexdigest() and by[b"\xff"]["hash"] == hashlib.sha256(b"x").hexdigest() and by[b"\\udcff"]["hash"] == hashlib.sha256(b"y").hexdigest()
    assert {k: r["status"] for k, r in by.items()} == {b"a.txt": "ok", b"a (1).txt": "ok", b"sub/b.bin": "ok", b"empty": "empty", b"sub/hard.txt": "reused", b"\xff": "ok", b"\\udcff": "ok"}
    twice = _report(out / scan.DUPLICATES)
    assert len(twice) == 3 and len(twice[0]) == 27 and {r["physical_copy_count"] for r in twice} == {"2"}
    found = _report(out / scan.PATHS)
    assert len(found) == 1 and len(found[0]) == 22 and found[0]["item_type"] == "directory"

    # a file that was written again is hashed, what is unchanged is not
    (tree / "sub" / "b.bin").write_text("2wo" + "two" * 49_999)
    (tree / "new").write_text("new")
    assert command.main([*base, "--incremental"]) == 0
    by = {r["path"][len(str(tree)) + 1 :]: r for r in _report(out / scan.ALL_FILES) if "udcff" not in r["path"]}
    assert {k: r["status"] for k, r in by.items()} == {"a.txt": "reused", "a (1).txt": "reused", "sub/hard.txt": "reused", "empty": "reused", "sub/b.bin": "ok", "new": "ok"}
    assert not (out / scan.PATHS).exists() and not list((out / "catalog" / "parts").iterdir())

    # an interrupted scan goes on after its last whole batch
    options, catalog = command.options_of(command.parser().parse_args(base)), f"{out}/catalog"
    hashed, calls = scan._hashed, []
    try:
        scan._hashed = lambda *a: calls.append(1) or (_ for _ in ()).throw(KeyboardInterrupt()) if calls else calls.append(1) or hashed(*a)
        with pytest.raises(KeyboardInterrupt):
            scan.run_scan(spark, catalog, options)
    finally:
        scan._hashed = hashed
    (tree / "new").unlink()
    (tree / "late").write_text("late")
    assert command.main([*base, "--resume"]) == 0
    last = scope.latest_scan(lifecycle.scans(spark, catalog), "completed").first()
    rows = store.read_snapshot(spark, f"{catalog}/files", last["scan_id"]).collect()
    assert last["generation"] == 2 and len(rows) == 8 == len({r["id"] for r in rows}) and {r["seen_generation"] for r in rows} == {2}
    again = {r["path"].rsplit("/", 1)[1]: r["id"] >> 56 for r in rows}
    assert again["late"] == 2 and again["b.bin"] == 1 and "new" not in again

    # reports once more, of the scan as it was made, without a walk
    scan.removed(spark, f"{out}/{scan.ALL_FILES}")
    assert command.main([*base, "--report-only", "--algorithm", "blake2b"]) == 0
    assert {r["algorithm"] for r in _report(out / scan.ALL_FILES)} == {"sha256"}

    assert command.main(["--cleanup", "--output-dir", str(out)]) == 0 and (tree / "a (1).txt").exists()
    assert command.main(["--cleanup", "--output-dir", str(out), "--cleanup-action", "delete", "--confirmation-token", "x"]) == 2
    assert command.main(["--cleanup", "--output-dir", str(out), "--cleanup-action", "quarantine", "--quarantine-dir", str(tmp_path / "q"), "--yes-noninteractive"]) == 0
    assert not (tree / "a (1).txt").exists() and (tree / "a.txt").exists()


@pytest.mark.parametrize(
    "arguments",
    [
        "", "--cleanup --root /", "--cleanup --resume", "--root / --resume --incremental", "--root / --report-only --resume", "--root / --path-audit-only --incremental", "--root / --workers -1",
        "--root / --retry-changed -1", "--root / --office-path-limit 200", "--root / --hard-path-limit 239", "--root / --chunk-size-mib 0", "--cleanup --cleanup-action quarantine",
        "--cleanup --cleanup-action delete --no-full-verify", "--cleanup --cleanup-action delete --cleanup-risk critical", "--root / --progress-seconds 0", "--root / --filename-limit 0",
    ],
)
def test_arguments_that_are_refused(arguments):
    from siltstone import __main__ as command

    assert command.main(arguments.split()) == 2
