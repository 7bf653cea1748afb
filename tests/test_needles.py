"""Many needles at once, against looking for each."""

import random

from pixsieve.operators import needles as nd
from pixsieve.plans import byte_plans


def brute(blobs, needles):
    return {(p, n, i) for p, c in blobs.items() for n in needles for i in range(len(c) - len(n) + 1) if c[i : i + len(n)] == n}


def table(spark, needles):
    return spark.createDataFrame([(bytearray(n) if n is not None else None,) for n in needles], "needle BINARY")


def found(spark, files, needles, *keep):
    return {(r.path, bytes(r.needle), r.pos) for r in nd.find_needles(files, table(spark, needles), *keep).collect()}


def test_nested_and_overlapping_needles_across_pieces(spark, files_of, monkeypatch):
    monkeypatch.setattr(nd, "PIECE", 7)
    rng = random.Random(3)
    blobs = {f"f{i}": bytes(rng.choices(b"ab\xff\x00", k=n)) for i, n in enumerate((0, 1, 6, 7, 8, 300))}
    needles = [b"a", b"ab", b"aba", b"bab", b"\xff\x00", b"aa", b"aaaa", bytes(rng.choices(b"ab", k=9)), b"zz"]
    got = nd.find_needles(files_of(blobs), table(spark, [*needles, b"ab", b"", None])).collect()
    assert len(got) == len({(r.path, bytes(r.needle), r.pos) for r in got})
    assert {(r.path, bytes(r.needle), r.pos) for r in got} == brute(blobs, needles)


def test_ten_thousand_needles_in_one_plan(spark, files_of, monkeypatch):
    rng = random.Random(4)
    needles = sorted({bytes(rng.choices(b"abcd", k=rng.randint(4, 9))) for _ in range(18_000)})
    assert len(needles) > 10_000
    blobs = {f"f{i}": bytes(rng.choices(b"abcd", k=400)) for i in range(20)}
    plan = lambda n: nd.find_needles(files_of(blobs), table(spark, n))._jdf.queryExecution().optimizedPlan().toString().count("\n")
    assert plan(needles) == plan(needles[:2])
    held = set(needles)
    want = {(p, c[i : i + k], i) for p, c in blobs.items() for k in range(4, 10) for i in range(len(c) - k + 1) if c[i : i + k] in held}
    assert found(spark, files_of(blobs), needles) == want
    monkeypatch.setattr(nd, "SLAB_BYTES", 20_000)  # four automata
    assert found(spark, files_of(blobs), needles) == want


def test_many_hits_null_contents_and_kept_columns(spark, monkeypatch):
    monkeypatch.setattr(nd, "HITS", 10)
    files = spark.createDataFrame([(1, bytearray(b"a" * 35), "x"), (2, None, None)], "path LONG, content BINARY, `odd name` STRING")
    rows = nd.find_needles(files, table(spark, [b"aa", b"a"]), "odd name").collect()
    assert len(rows) == 69 and {(r.path, r["odd name"]) for r in rows} == {(1, "x")}
    assert nd.find_needles(files, table(spark, [])).count() == 0


def test_first_listed_marker(spark):
    texts = spark.createDataFrame([(1, "made with Paint and GIMP"), (2, "none"), (3, None), (4, "gimp GIMP"), (5, "")], "path LONG, text STRING")
    markers = spark.createDataFrame([(2, "GIMP"), (1, "Paint"), (0, ""), (2, "gimp")], "rank INT, marker STRING")
    assert {(r.path, r.marker) for r in nd.first_listed(texts, markers).collect()} == {(1, "Paint"), (4, "GIMP")}


def test_search_hits_are_named_without_a_shuffle_by_needle(spark, tmp_path):
    """Four needles are four keys: shuffled by them, the hits of all documents would be four tasks."""
    spark.createDataFrame([(1, "the der the"), (2, None), (3, "zzzzz")], "doc_id LONG, text STRING").write.parquet(f"{tmp_path}/documents.parquet")
    hits = byte_plans.byte_search(spark, str(tmp_path))
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    assert sorted(map(tuple, hits.collect())) == [(1, 0, 0), (1, 0, 8), (1, 1, 4), (3, 3, 0), (3, 3, 1)]
