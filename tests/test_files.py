"""Files as files: the sink's commit and abort, frames and reports as files, and the listing that reads them."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from pixsieve.operators import carving as cv
from pixsieve.sources import corpus, files, reports

JPEG = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xda\x00\x02xyz\xff\xd9"


def rows(spark, items):
    return spark.createDataFrame([(n, None if c is None else bytearray(c)) for n, c in items], "name STRING, content BINARY")


def there(target):
    return {str(p.relative_to(target)): p.read_bytes() for p in Path(target).rglob("*") if p.is_file() and not p.name.endswith(".crc")}


def test_files_are_written_once_and_replaced(spark, tmp_path):
    target = str(tmp_path / "out")
    items = [(f"d{i % 3}/f{i}.bin", bytes([i]) * i) for i in range(40)] + [("empty", b""), ("null", None)]
    want = {n: c or b"" for n, c in items}
    for _ in range(2):  # a second run leaves one file per name
        files.write_files(rows(spark, items).repartition(7), target)
        assert there(target) == want | {"_SUCCESS": b"42 files\n"}
    files.write_files(rows(spark, [("d0/f0.bin", b"new"), ("more", b"x")]), target)
    assert there(target) == want | {"d0/f0.bin": b"new", "more": b"x", "_SUCCESS": b"2 files\n"}
    files.write_files(rows(spark, [("only", b"1")]), target, overwrite=True)
    assert there(target) == {"only": b"1", "_SUCCESS": b"1 files\n"}


def test_rows_of_one_name_are_one_file(spark, tmp_path):
    files.write_files(rows(spark, [("a", b"1"), ("a", b"2"), ("b", b"3")]).coalesce(1), str(tmp_path))
    assert there(tmp_path) == {"a": b"12", "b": b"3", "_SUCCESS": b"2 files\n"}


@pytest.mark.parametrize("bad", ["../up", "/root", "a//b", "", None, ".hidden", "a/_x"])
def test_bad_names_end_the_write_and_change_nothing(spark, tmp_path, bad):
    files.write_files(rows(spark, [("old", b"o")]), str(tmp_path))
    before = there(tmp_path)
    with pytest.raises(Exception, match="not a file name"):
        files.write_files(rows(spark, [("good", b"g"), (bad, b"b")]), str(tmp_path), overwrite=True)
    assert there(tmp_path) == before
    assert not (tmp_path.parent / "up").exists()


def test_a_name_of_two_tasks_ends_the_write(spark, tmp_path):
    two = rows(spark, [("same", b"1")]).unionByName(rows(spark, [("same", b"2")]))
    with pytest.raises(Exception, match="two tasks wrote"):
        files.write_files(two, str(tmp_path))
    with pytest.raises(Exception, match="do not follow"):
        files.write_files(rows(spark, [("a", b"1"), ("b", b"2"), ("a", b"3")]).coalesce(1), str(tmp_path))
    assert there(tmp_path) == {}


def test_a_failed_task_leaves_the_target_as_it_was(spark, tmp_path):
    target = str(tmp_path / "out")
    files.write_files(rows(spark, [("old", b"o")]), target)

    def failing(batches):
        for k, batch in enumerate(batches):
            yield batch
            raise RuntimeError("lost")

    good = spark.range(50).select(F.concat(F.lit("f"), F.col("id")).alias("name"), F.lit(b"x").alias("content")).repartition(5)
    with pytest.raises(Exception, match="lost"):
        files.write_files(good.mapInArrow(failing, good.schema), target)
    assert there(target) == {"old": b"o", "_SUCCESS": b"1 files\n"}
    files.write_files(good, target)
    assert len(there(target)) == 52


def test_what_dead_attempts_left_is_never_moved(tmp_path):
    """Two attempts of a task stage the same file; only the one whose message arrives counts, and the other goes."""
    writer = files.FileWriter(tmp_path.as_uri(), False)
    staging = tmp_path / f"{files.STAGING}{writer.job}"
    for attempt in ("1-a", "2-b"):
        (staging / attempt).mkdir(parents=True)
        (staging / attempt / "f").write_text(attempt)
    writer.commit([files.Staged(str(staging / "2-b"), 1), None])
    assert there(tmp_path) == {"f": b"2-b", "_SUCCESS": b"1 files\n"}
    again = files.FileWriter(tmp_path.as_uri(), True)
    (tmp_path / f"{files.STAGING}{again.job}" / "1").mkdir(parents=True)
    again.abort([])
    assert there(tmp_path) == {"f": b"2-b", "_SUCCESS": b"1 files\n"}


def test_frames_and_reports_become_files(spark, files_of, tmp_path):
    blobs = {"/in/a.b.JPG": b"--" + JPEG + JPEG, "/in/sub/c": JPEG, "/in/none.jpg": b"nothing"}
    frames = cv.jpeg_frames(files_of(blobs))
    for _ in range(2):
        cv.write_frame_files(frames, str(tmp_path / "frames"))
    assert there(tmp_path / "frames") == {
        "in/a.b.000001.jpg": JPEG, "in/a.b.000002.jpg": JPEG, "in/sub/c.000001.jpg": JPEG, "_SUCCESS": b"3 files\n"}
    lines = spark.range(3000).selectExpr("concat('/in/', id % 2, '.jpg') AS path", "id AS seq", "concat('é ', id) AS text")
    report = reports.numbered(reports.lines(lines, "warn", F.col("text")), span=256)
    reports.write_report_files(report, str(tmp_path / "reports"))
    got = there(tmp_path / "reports")
    for p in range(2):
        assert got[f"in/{p}.jpg.txt"].decode().splitlines() == [f"é {i}" for i in range(p, 3000, 2)]


def test_listing_of_a_large_flat_directory(spark, tmp_path):
    for i in range(10_000):
        (tmp_path / f"f {i}+%20é.{'jpg' if i % 4 else 'png'}").write_bytes(b"" if i % 10 == 1 else b"abc")
    listed = corpus.read_files(spark, str(tmp_path))
    got = {r.path.rsplit("/", 1)[1]: r.length for r in listed.select("path", "length").collect()}
    assert got == {f"f {i}+%20é.jpg": 0 if i % 10 == 1 else 3 for i in range(10_000) if i % 4}
    assert listed.select("path").rdd.getNumPartitions() >= 4
    only = corpus.read_files(spark, str(tmp_path), with_empty=False)
    assert only.select("path").count() == sum(1 for i in range(10_000) if i % 4 and i % 10 != 1)


def test_a_root_without_scheme_follows_the_default_file_system(spark, tmp_path):
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    (tmp_path / "x.jpg").write_bytes(b"")
    before = conf.get("fs.defaultFS")
    conf.set("fs.viewfs.mounttable.test.link./in", tmp_path.as_uri())
    conf.set("fs.defaultFS", "viewfs://test/")
    try:
        assert files.qualified(spark, "/in") == "viewfs://test/in"
        assert [r.path for r in corpus.read_files(spark, "/in").select("path").collect()] == ["viewfs://test/in/x.jpg"]
    finally:
        conf.set("fs.defaultFS", before)
    assert files.qualified(spark, "/in") == "file:///in"


def test_a_tree_is_listed_and_read_by_tasks(spark, tmp_path, monkeypatch):
    """The driver holds no listing; hidden names, times and empty files are as with Spark's own source."""
    for i in range(60):
        at = tmp_path / f"d{i % 3}" / ("deep +%é" if i % 2 else "")
        at.mkdir(parents=True, exist_ok=True)
        (at / f"f {i}.{'JPG' if i % 4 else 'png'}").write_bytes(bytes([i]) * (i % 5))
    for name in ("_SUCCESS", ".x.jpg", "_part/y.jpg", "d0/z.jpg._COPYING_"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(b"hidden")
    monkeypatch.setattr(corpus, "TASK_FILES", 7)
    by_tasks = [corpus.read_files(spark, str(tmp_path), recursive=True, extract_all=a, with_empty=e) for a in (False, True) for e in (False, True)]
    monkeypatch.setattr(corpus, "OPENED", ())
    by_spark = [corpus.read_files(spark, str(tmp_path), recursive=True, extract_all=a, with_empty=e) for a in (False, True) for e in (False, True)]
    for one, other in zip(by_tasks, by_spark, strict=True):
        assert one.columns == other.columns
        shown = [sorted((r.path, r.modificationTime and int(r.modificationTime.timestamp()), r.length, bytes(r.content)) for r in df.collect()) for df in (one, other)]
        assert shown[0] == shown[1] and shown[0]
        assert not one._jdf.inputFiles()[0].endswith((".JPG", ".png"))
    assert by_tasks[3].rdd.getNumPartitions() == 9
    assert "ArrowEvalPython" not in by_tasks[3].select("path", "length")._jdf.queryExecution().executedPlan().toString()


def test_a_commit_keeps_few_moves_waiting(tmp_path, monkeypatch):
    monkeypatch.setattr(files, "MOVES", 3)
    writer = files.FileWriter(tmp_path.as_uri(), False)
    staging = tmp_path / f"{files.STAGING}{writer.job}"
    for task in range(4):
        (staging / str(task) / "sub").mkdir(parents=True)
        for k in range(10):
            (staging / str(task) / "sub" / f"{task}-{k}").write_bytes(bytes([k]))
    (staging / "3" / "sub" / "0-5").write_bytes(b"twice")
    messages = [files.Staged(str(staging / str(t)), 10) for t in range(4)]
    with pytest.raises(ValueError, match="two tasks wrote 'sub/0-5'"):
        writer.commit(messages)
    assert not (tmp_path / "sub").exists()
    (staging / "3" / "sub" / "0-5").unlink()
    writer.commit(messages)
    assert there(tmp_path) == {f"sub/{t}-{k}": bytes([k]) for t in range(4) for k in range(10)} | {"_SUCCESS": b"40 files\n"}
