"""The folder tree as a source: pruned walks, manifests of cycles, changed and deleted files."""

import os

import pytest
from pyspark.sql import functions as F

from lumenspan.operators.catalogue import skipped_folder
from lumenspan.sources import scan, tree
from lumenspan.streaming import jobs


def make(root, files):
    for name, data in files.items():
        p = root / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(data)


FILES = {
    "a.txt": "top level file", "tiny.txt": "x", ".env": "a hidden file",
    "b/one.txt": "one " * 5, "b/c/d/e/deep.md": "deep " * 5, "b.x/two.txt": "two " * 5, "b/c.txt": "between",
    "node_modules/p/q.json": '{"name": "long enough"}', "Intel/x.txt": "skipped " * 3, ".git/config": "skipped " * 3, "b/My.app/x.txt": "skipped " * 3,
    "b/0123456789abcdef/x.txt": "skipped " * 3, "b/12345678-1234-1234-1234-123456789abc/x.txt": "skipped " * 3, "we(ird)+x/[y].txt": "odd names " * 2,
}
SEEN = {".env", "a.txt", "b/one.txt", "b/c/d/e/deep.md", "b.x/two.txt", "we(ird)+x/[y].txt"}


def test_skipped_folders_are_never_listed(tmp_path):
    make(tmp_path, FILES)
    os.symlink(tmp_path / "b", tmp_path / "link")
    os.symlink(tmp_path / "a.txt", tmp_path / "link.txt")
    listed = []

    def look(folder):
        listed.append(os.path.relpath(folder, tmp_path))
        return tree.children(folder)

    found = list(tree.walk(str(tmp_path), look=look))
    files = {os.path.relpath(p, tmp_path) for p, e in found if not e.is_folder}
    assert files == SEEN  # "between" is under ten bytes
    assert sorted(listed) == [".", "b", "b.x", "b/c", "b/c/d", "b/c/d/e", "we(ird)+x"]
    paths = [p for p, _ in found]
    assert paths == sorted(paths, key=tree.order)
    listed.clear()
    assert {b.folder for b in tree.branches([str(tmp_path)], 1, look)} == {str(tmp_path), *(str(tmp_path / n) for n in ("b", "b.x", "we(ird)+x"))}
    assert listed == ["."]  # the driver lists the top level only


@pytest.mark.parametrize("depth", [0, 1, 2, 7])
def test_every_depth_sees_the_same(spark, tmp_path, depth):
    make(tmp_path / "we(ird)+root", FILES)
    root = str(tmp_path / "we(ird)+root")
    rows = scan.tree(spark, [f"file://{root}"], depth=depth).collect()
    assert {os.path.relpath(r["path"], root) for r in rows if not r["is_folder"]} == SEEN
    assert {os.path.relpath(r["path"], root) for r in rows if r["is_folder"]} == {"b", "b.x", "b/c", "b/c/d", "b/c/d/e", "we(ird)+x"}
    assert len(rows) == len({r["path"] for r in rows}) and {r["change"] for r in rows} == {"present"}
    assert scan.scan(spark, root).where("filename = '[y].txt'").count() == 1


def test_gone_and_closed_folders(spark, tmp_path):
    assert scan.tree(spark, [str(tmp_path / "nowhere")]).collect() == []
    assert tree.contents(str(tmp_path / "nowhere")) is None


def test_names_are_judged_as_columns_judge_them(spark):
    names = ["Windows", "windows", ".x", "x", "a.app", "A.APP", "deadbeefdeadbeef", "deadbeef", "12345678-1234-1234-1234-123456789abc", "Temp", "Temporary", "3D Objects", "0123-4567-89ab-cdef", "zzzzzzzz-zzzz-zzzz-zzzz-zzzzzzzzzzzz"]
    rows = spark.createDataFrame([(n,) for n in names], "n string").select("n", skipped_folder(F.col("n")).alias("s")).collect()
    assert {r["n"]: r["s"] for r in rows} == {n: tree.skipped(n) for n in names}


def test_differences():
    before = [("/r/a", 1, 10), ("/r/a/x", 1, 10), ("/r/b", 1, 10), ("/r/d", 1, 10)]
    after = [("/r/a/x", 2, 10), ("/r/a.b", 1, 10), ("/r/b", 1, 11), ("/r/d", 1, 10), ("/r/e", 1, 10)]
    got = list(tree.differences(iter(sorted(before, key=lambda r: tree.order(r[0]))), iter(sorted(after, key=lambda r: tree.order(r[0])))))
    assert got == [("/r/a", 1, 10, "deleted"), ("/r/a/x", 2, 10, "changed"), ("/r/a.b", 1, 10, "added"), ("/r/b", 1, 11, "changed"), ("/r/e", 1, 10, "added")]


def test_a_cycle_read_again_is_the_same(tmp_path):
    """What a cycle returned doesn't change when the tree does, so a failed batch can be run again."""
    from pyspark.sql.types import _parse_datatype_string

    make(tmp_path / "root", FILES)
    stream = tree.TreeStream(_parse_datatype_string(tree.SCHEMA), [str(tmp_path / "root")], 1, False, str(tmp_path / "manifests"))

    def read(start, end):
        return sorted((r["path"], r["change"]) for p in stream.partitions(start, end) for b in stream.read(p) for r in b.to_pylist())

    zero, one = stream.initialOffset(), stream.latestOffset()
    first = read(zero, one)
    assert len(first) == len(SEEN) and {c for _, c in first} == {"added"}
    (tmp_path / "root/b/one.txt").write_text("other text " * 3)
    make(tmp_path / "root", {"fresh/new.txt": "a new folder"})
    for p in ("b.x/two.txt", "we(ird)+x/[y].txt"):
        (tmp_path / "root" / p).unlink()
    (tmp_path / "root/b.x").rmdir()
    assert read(zero, one) == first
    two = stream.latestOffset()
    assert two["cycle"] > one["cycle"]
    second = [(os.path.relpath(p, tmp_path / "root"), c) for p, c in read(one, two)]
    assert second == [("b.x/two.txt", "deleted"), ("b/one.txt", "changed"), ("fresh/new.txt", "added"), ("we(ird)+x/[y].txt", "deleted")]
    stream.commit(two)
    assert [n for n in os.listdir(tmp_path / "manifests")] == [f"cycle={two['cycle']}"]
    assert read(two, stream.latestOffset()) == []


def test_ingest_follows_the_tree(spark, tmp_path, monkeypatch):
    """Changed files are read again, deleted ones go where asked; snapshots change nothing."""
    monkeypatch.setattr(jobs, "COMPACT", 2)
    monkeypatch.setattr(jobs.upsert_sink, "__defaults__", (2,))
    make(tmp_path / "root", FILES)
    root, out, mark = str(tmp_path / "root"), str(tmp_path / "out"), str(tmp_path / "mark")

    def cycle(delete=False):
        jobs.ingest(spark, root, out, mark, delete=delete, depth=1).awaitTermination()
        files, chunks = jobs.tables(spark, out)
        assert files.select("file_id").distinct().count() == files.count()
        names = {os.path.relpath(r["path"], root) for r in files.collect()}
        return names, {r["filename"]: r["text"] for r in chunks.orderBy("chunk_index").collect()}

    names, texts = cycle()
    assert names == SEEN and texts["one.txt"] == "one " * 5 and ".env" not in texts  # no reader for it
    (tmp_path / "root/b/one.txt").write_text("rewritten text")
    os.utime(tmp_path / "root/b/one.txt", (2_000_000_000, 2_000_000_000))
    (tmp_path / "root/b.x/two.txt").unlink()
    names, texts = cycle()
    assert names == SEEN and texts["one.txt"] == "rewritten text" and "two.txt" in texts  # deletions weren't asked for
    (tmp_path / "root/a.txt").unlink()
    make(tmp_path / "root", {"late.txt": "x\n" * 3000})
    names, texts = cycle(delete=True)
    assert names == (SEEN - {"a.txt"}) | {"late.txt"} and "a.txt" not in texts and texts["one.txt"] == "rewritten text"
    assert cycle(delete=True) == (names, texts)
    assert any(n.startswith("snapshot=") for n in os.listdir(f"{out}/chunks"))
    assert len(os.listdir(f"{out}/files")) <= 3


def test_files_are_written_and_removed(spark, tmp_path):
    rows = [(str(tmp_path / "x/a.txt"), "one"), (str(tmp_path / "x/y/b.txt"), "two")]
    scan.write_files(spark.createDataFrame(rows, "path string, content string"))
    assert [open(p).read() for p, _ in rows] == ["one", "two"]
    scan.write_files(spark.createDataFrame([(rows[0][0], None), (str(tmp_path / "none"), None)], "path string, content string"))
    assert not os.path.exists(rows[0][0]) and os.path.exists(rows[1][0])


def test_files_of_one_folder_are_read_by_several_tasks(spark, tmp_path):
    make(tmp_path / "root", {f"one/f{i:03}.txt": f"text {i} of many" for i in range(80)})
    found = scan.scan(spark, str(tmp_path / "root"), content=True)
    got = found.select("filename", F.decode("content", "utf-8").alias("text"), F.spark_partition_id().alias("task")).collect()
    assert {r["filename"]: r["text"] for r in got} == {f"f{i:03}.txt": f"text {i} of many" for i in range(80)}
    tasks = [r["task"] for r in got]
    assert max(map(tasks.count, set(tasks))) < 50
