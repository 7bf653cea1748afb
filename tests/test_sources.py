"""Directory listing, report and signature sinks, constant dimensions."""

import pytest
from pyspark.sql import functions as F

from pixsieve.operators import lookups as lk
from pixsieve.operators import signatures as sg
from pixsieve.sources import corpus, dims, reports, sigdb


@pytest.fixture()
def tree(tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "empty.jpg").write_bytes(b"")
    for n in ("a.JPG", "sub/b.jpeg", "c.png", "noext"):
        (tmp_path / n).write_bytes(b"0123456789abcdef")
    return tmp_path


def names(df):
    return sorted(r.path.rsplit("/", 1)[1] for r in df.select("path").collect())


def test_listing(spark, tree):
    root = str(tree)
    assert names(corpus.read_files(spark, root)) == ["a.JPG", "empty.jpg"]
    assert names(corpus.read_files(spark, root, recursive=True)) == ["a.JPG", "b.jpeg", "empty.jpg"]
    assert names(corpus.read_files(spark, root, recursive=True, extract_all=True)) == ["a.JPG", "b.jpeg", "c.png", "empty.jpg", "noext"]
    assert names(corpus.read_files(spark, root, exts=(".png",))) == ["c.png"]
    status = corpus.read_files(spark, root).select("path", corpus.size_status(F.col("length")).alias("s"))
    assert {r.path.rsplit("/", 1)[1]: r.s for r in status.collect()} == {"a.JPG": "ok", "empty.jpg": "empty"}


def test_listing_reads_no_content_when_only_sizes_are_asked(spark, tree):
    plan = corpus.read_files(spark, str(tree)).select("path", "length")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<path:string,length:bigint>" in plan


def test_batch_plan(spark):
    f = spark.createDataFrame([(p,) for p in ("/r/a.JPG", "/r/s/b.jpeg", "/r/c.png", "/r/x.jpg.bak", "/other/z.jpg")], "path STRING")
    rows = {r.path: (r.dst_path, r.log_path) for r in corpus.plan_batch(f, "/r", "/o").collect()}
    assert rows == {"/r/a.JPG": ("/o/a.JPG", "/o/a.JPG.txt"), "/r/s/b.jpeg": ("/o/s/b.jpeg", "/o/s/b.jpeg.txt")}
    assert corpus.plan_batch(f, "/r", "/o", recursive=False, extract_all=True).count() == 3


def test_progress_over_spans(spark):
    f = spark.range(50).select((F.col("id") * 7).alias("file_no"))
    rows = corpus.batch_progress(f, "file_no", span=20).orderBy("file_no").collect()
    assert [(r.i, r.n, r.percent) for r in rows] == [(i + 1, 50, (i + 1) * 2.0) for i in range(50)]


def test_reports_are_written_in_order(spark, tmp_path):
    rows = spark.range(500).select((F.col("id") % 3).cast("string").alias("path"), F.col("id").alias("seq"))
    rep = reports.lines(rows, "warn", F.concat(F.lit("line "), F.col("seq").cast("string")))
    assert reports.lines(rows, "warn", F.lit("x"), enabled=False).count() == 0
    with pytest.raises(ValueError):
        reports.lines(rows, "purple", F.lit("x"))
    target = str(tmp_path / "rep")
    reports.write_reports(reports.numbered(rep, span=64), target)
    for p in range(3):
        parts = list((tmp_path / "rep" / f"path={p}" / "part=0").glob("*.txt"))
        assert len(parts) == 1
        assert parts[0].read_text().splitlines() == [f"line {i}" for i in range(p, 500, 3)]


def test_signature_store_and_load(spark, tmp_path):
    cols = "sig_id INT, is_user BOOLEAN, valid BOOLEAN, editor_class STRING, make STRING, model STRING, quality STRING, csig STRING, csig_rot STRING"
    rows = [(1, True, True, "camera", "A", "m", "", "X", "Y"), (2, True, False, "camera", "A", "m", "", "X", "Y"), (3, False, True, "camera", "A", "m", "", "X", "Y")]
    s = spark.createDataFrame(rows, cols)
    target = str(tmp_path / "db")
    sigdb.store(s, target)
    stored = sigdb.load(spark, target)
    assert [r.sig_id for r in stored.collect()] == [1]
    loaded = sigdb.load_versions({"01": stored.drop("csig_rot", "is_user", "valid"), "00": stored, "03": stored.drop("is_user", "valid")})
    assert sorted((r.version, r.csig_rot, r.sw_disp) for r in loaded.collect()) == [("01", "", ""), ("03", "Y", "")]
    with pytest.raises(ValueError):
        sigdb.load_versions({"00": stored})


def test_exceptions_prefix_and_exact(spark):
    img = spark.createDataFrame([("A", "PROMO"), ("A", "PR"), ("B", "x"), ("C", "")], "make STRING, model STRING")
    pre = spark.createDataFrame([("A", "PRO"), ("B", ""), ("C", "Z*"), ("A", "PROM*")], "make STRING, model STRING")
    assert sorted(map(tuple, sg.no_makernote_expected(img, pre).collect())) == [("A", "PROMO"), ("B", "x")]
    exact = spark.createDataFrame([("A", "PRO"), ("A", "PR"), ("B", "")], "make STRING, model STRING")
    assert sorted(map(tuple, sg.always_edited(img, exact).collect())) == [("A", "PR"), ("B", "x")]


def test_trim_uses_the_plain_hash_only(spark):
    cols = "make STRING, model STRING, csig STRING, csig_rot STRING"
    built = spark.createDataFrame([("A", "m", "X", "Y")], cols)
    user = spark.createDataFrame([("A", "m", "Y", "q"), ("A", "m", "Q", "X"), ("B", "m", "X", "Y")], cols)
    assert sorted(r.csig for r in sg.trim_known(user, built).collect()) == ["Q", "X"]


def test_comment_markers(spark):
    c = spark.createDataFrame([("made with Photoshop",), ("PHOTOSHOP",), ("",), (None,)], "c STRING")
    got = [r[0] for r in c.select(sg.contains_any(F.col("c"), dims.COMMENT_SOFTWARE)).collect()]
    assert got == [True, False, False, False]


def test_dimension_sizes_and_keys(spark):
    assert (len(dims.IPTC_FIELDS), len(dims.RESOURCE_IDS), len(dims.PSD_ENUMS), len(dims.DICOM_TRANSFER_SYNTAXES)) == (77, 86, 47, 37)
    assert (len(dims.IJG_SOFTWARE), len(dims.COMMENT_SOFTWARE)) == (8, 6)
    assert len({(r, d) for r, d, *_ in dims.IPTC_FIELDS}) == 77 and len({(f, v) for f, v, _ in dims.PSD_ENUMS}) == 47
    assert len({(s, t) for s, t, _ in dims.EXIF_TAGS}) == len(dims.EXIF_TAGS)
    one = lk.single_codes(dims.dim_resource(spark))
    assert one.count() == 84 + (0x0BB6 - 0x07D0 + 1) + (0x1387 - 0x0FA0 + 1)


def test_registry_can_be_handed_in(spark, tmp_path):
    target = str(tmp_path / "registry")
    spark.createDataFrame([(9, 1, "Private")], "grp INT, elem INT, name STRING").write.parquet(target)
    rows = spark.createDataFrame([(9, 1), (9, 0), (9, 2)], "grp INT, elem INT")
    got = {r.elem: (r.name, r.known) for r in lk.name_dicom(rows, dims.dim_dicom(spark, target)).collect()}
    assert got == {1: ("Private", True), 0: ("Group Length (Group=0009)", True), 2: ("??? (0009,0002)", False)}


def test_marker_names():
    names = {c: dims.marker_name(c) for c in (0xC0, 0xC2, 0xC4, 0xCC, 0xD3, 0xD8, 0xDA, 0xE1, 0xFE, 0x01, 0x02)}
    assert names == {0xC0: "SOF0", 0xC2: "SOF2", 0xC4: "DHT", 0xCC: "DAC", 0xD3: "RST3", 0xD8: "SOI", 0xDA: "SOS", 0xE1: "APP1", 0xFE: "COM", 1: "TEM", 2: "RES"}


SIGS = "sig_id INT, is_user BOOLEAN, valid BOOLEAN, make STRING"


def test_a_table_can_be_stored_from_itself(spark, tmp_path):
    target = str(tmp_path / "db")
    with pytest.raises(ValueError, match="no signature table"):
        sigdb.load(spark, target)
    sigdb.store(spark.createDataFrame([(i, True, True, "A") for i in range(20)], SIGS), target)
    for step in range(5):
        loaded = sigdb.load(spark, target)
        sigdb.store(loaded.withColumns({"make": F.concat("make", F.lit("+")), "valid": F.col("sig_id") != step}), target)
    assert sorted((r.sig_id, r.make) for r in sigdb.load(spark, target).collect()) == [(i, "A+++++") for i in range(5, 20)]
    assert len([p for p in (tmp_path / "db").iterdir() if p.name.startswith(sigdb.SNAPSHOT)]) == 3
    assert not [p for p in (tmp_path / "db").iterdir() if p.name.startswith(sigdb.POINTER + "-")]


def test_a_store_that_dies_leaves_the_old_table(spark, tmp_path):
    target = str(tmp_path / "db")
    sigdb.store(spark.createDataFrame([(1, True, True, "A")], SIGS), target)
    before = sigdb.current(spark, target)
    dying = sigdb.load(spark, target).withColumn("make", F.raise_error(F.lit("killed")).cast("string"))
    with pytest.raises(Exception, match="killed"):
        sigdb.store(dying, target)
    assert sigdb.current(spark, target) == before and [r.make for r in sigdb.load(spark, target).collect()] == ["A"]
    # a whole snapshot whose pointer was never switched does not count either
    spark.createDataFrame([(2, True, True, "B")], SIGS).write.parquet(f"{target}/{sigdb.SNAPSHOT}0000000009-x")
    assert [r.make for r in sigdb.load(spark, target).collect()] == ["A"]


def binary_table(header, version, records, wide, end="*Z*", count=None):
    coding = "utf-16-le" if wide else "latin-1"
    text = lambda x: (x + "\0").encode(coding)
    body = b"".join(text(f) for r in records for f in r)
    n = len(records) if count is None else count
    return text(header) + text(version) + text("*DB*") + n.to_bytes(4, "little") + body + text(end)


def test_binary_tables_of_all_versions(spark, files_of):
    long = [("Make é", f"m{i}", str(i % 5), "q", "AA", "BB", "2x1", "t", "d") for i in range(300)]
    old = [r[:5] + r[6:] for r in long]
    blobs = {
        "v1": binary_table("Tool", "01", old, False), "v2": binary_table("Tool", "02", long, False), "v3": binary_table("Tool", "03", long, True),
        "v0": binary_table("Tool", "00", long, False), "v9": binary_table("Tool", "09", long, False), "other": binary_table("Toll", "03", long, True),
        "cut": binary_table("Tool", "03", long[:2], True)[:-40], "endless": binary_table("Tool", "02", long[:2], False, count=2**32 - 1),
        "letter": binary_table("Tool", "02", [("M", "m", "x", *long[0][3:])], False), "empty": b"", "head": b"Tool\0",
    }
    rows = sigdb.read_binary(files_of(blobs), "Tool").collect()
    by = {p: sorted((r for r in rows if r.path == p), key=lambda r: r.seq) for p in blobs}
    assert {p: len(r) for p, r in by.items()} == {"v1": 300, "v2": 300, "v3": 300, "v0": 0, "v9": 0, "other": 0, "cut": 2, "endless": 3, "letter": 1, "empty": 0, "head": 0}
    for p in ("v1", "v2", "v3"):
        got = [(r.make, r.model, r.editor_class, r.quality, r.csig, r.csig_rot, r.subsampling, r.sw_trim, r.sw_disp, r.valid) for r in by[p]]
        assert got == [(*r[:2], [*sigdb.EDITORS, "unset"][int(r[2])], *r[3:5], "" if p == "v1" else "BB", *r[6:], True) for r in long]
    assert [r.valid for r in by["cut"]] == [True, False] and [r.valid for r in by["endless"]] == [True, True, False]
    assert [r.valid for r in by["letter"]] == [False]
