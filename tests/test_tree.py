import hashlib
import os

import pytest

from tarnfield.sources import artifacts, tree


@pytest.fixture
def root(tmp_path):
    folder = tmp_path / "tree"
    for name, text in (("b.json", "b"), ("runs/run-2.json", "two"), ("runs/run-10.json", "ten"), ("runs-old/x.md", "x"), ("a/b/c.md", ""), ("ﬀ.md", "bmp"), ("\U0001f600.md", "astral")):
        path = folder / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text)
    return folder


@pytest.fixture
def read(spark, root):
    tree.register(spark)
    return lambda **options: spark.read.format("artifact_tree").options(**options).load(str(root))


def test_listing_is_sorted_and_whole(read, root, spark):
    rows = read().collect()
    # Folder by folder in the order of UTF-16 units: a surrogate pair comes before U+FB00.
    assert [r.path for r in rows] == ["a/b/c.md", "b.json", "runs/run-10.json", "runs/run-2.json", "runs-old/x.md", "\U0001f600.md", "ﬀ.md"]
    ten = next(r for r in rows if r.path == "runs/run-10.json")
    assert (ten.length, bytes(ten.content), ten.revision) == (3, b"ten", "sha256:" + hashlib.sha256(b"ten").hexdigest())
    # The same as the source for stores, in which Spark leaves out empty files.
    plain = {(r.path, bytes(r.content), r.revision, r.length, r.modified.replace(microsecond=0)) for r in artifacts.artifact_files(spark, str(root)).collect() if r.path.isascii()}
    assert plain == {(r.path, bytes(r.content), r.revision, r.length, r.modified.replace(microsecond=0)) for r in rows if r.path.isascii() and r.length}
    assert [r.path for r in read(pattern="*.md").select("path").collect()] == ["a/b/c.md", "runs-old/x.md", "\U0001f600.md", "ﬀ.md"]


def test_filters_reach_the_walk(read, root):
    os.symlink("/etc/passwd", root / "a/b/link")
    # A folder that a filter leaves out isn't walked, so the link in it isn't met; without a filter it is.
    assert [r.path for r in read().where("path like 'runs/%'").collect()] == ["runs/run-10.json", "runs/run-2.json"]
    assert [r.path for r in read().where("path = 'runs-old/x.md'").collect()] == ["runs-old/x.md"]
    assert [r.path for r in read().where("path in ('b.json', 'runs/run-2.json', 'none') and path like 'runs%' and length > 1").collect()] == ["runs/run-2.json"]
    assert read().where("path = 'none'").count() == 0
    with pytest.raises(Exception, match="unsafe path: a/b/link"):
        read().count()


@pytest.mark.parametrize("kind", ["link", "folder-link", "pipe", "backslash", "root"])
def test_unsafe_trees_are_refused(read, root, spark, kind):
    if kind == "link":
        os.symlink(root / "b.json", root / "c.json")
    elif kind == "folder-link":
        os.symlink(root / "runs", root / "again")
    elif kind == "pipe":
        os.mkfifo(root / "pipe")
    elif kind == "backslash":
        (root / "a\\b").write_text("")
    frame = read()
    if kind == "root":
        os.symlink(root, root.parent / "alias")
        frame = spark.read.format("artifact_tree").load(str(root.parent / "alias"))
    with pytest.raises(Exception, match="unsafe"):
        frame.count()


def test_a_file_replaced_after_listing_is_refused(root):
    reader = tree.TreeReader({"path": str(root)})
    (files,) = reader.partitions()
    (root / "b.json").unlink()
    os.symlink(root / "runs/run-2.json", root / "b.json")
    with pytest.raises(OSError):
        list(reader.read(files))
    (root / "b.json").unlink()
    (root / "b.json").write_text("b")
    (root / "runs").rename(root.parent / "moved")
    os.symlink(root.parent / "moved", root / "runs")
    with pytest.raises(tree.UnsafeTree):
        list(reader.read(files))


def test_splits_follow_sizes():
    sizes = [("a", 10), ("b", 0), ("c", 5 << 20), ("d", 1), ("e", 1)]
    assert [s.paths for s in tree.splits(sizes, 1 << 20)] == [["a", "b"], ["c"], ["d", "e"]]
    assert [s.paths for s in tree.splits([], 1 << 20)] == [[]]
    assert [len(s.paths) for s in tree.splits(((str(i), 0) for i in range(100)), 16 * tree.OPEN_BYTES)] == [16] * 6 + [4]


def test_many_small_files(spark, tmp_path):
    tree.register(spark)
    for d in range(100):
        (tmp_path / f"d{d:02d}").mkdir()
        for i in range(100):
            (tmp_path / f"d{d:02d}/f{i:02d}.txt").write_bytes(b"%d" % i)
    rows = spark.read.format("artifact_tree").option("split", 1000 * tree.OPEN_BYTES + (1 << 16)).load(str(tmp_path))
    assert rows.rdd.getNumPartitions() == 10
    paths = [r.path for r in rows.select("path").collect()]
    assert len(paths) == 10_000 and paths == sorted(paths)
    assert rows.agg({"length": "sum"}).first()[0] == 19_000


def test_an_empty_tree(spark, tmp_path):
    tree.register(spark)
    assert spark.read.format("artifact_tree").load(str(tmp_path)).count() == 0
