"""What a worker holds while a stage of the pipeline scans its texts, and after it."""

import tracemalloc

import numpy as np
import pyarrow as pa
from pyspark.sql.classic.dataframe import DataFrame

from pixsieve.llm import decontaminate
from pixsieve.llm.words import powers, shingles, word_hashes


def test_seed_bitmaps_stay_packed_and_go_at_the_end(spark, monkeypatch):
    text = "one two three four five six seven"
    words, counts, _, _ = word_hashes(pa.array([text], pa.string()), strip=True)
    maps = {}
    for k in range(1, decontaminate.TILE + 1):
        maps[k] = np.zeros(1 << decontaminate.BITS, bool)
        maps[k][decontaminate.bit_places(shingles(words[:k], np.array([k]), k)[0])] = True
    tasks, whole = [], DataFrame.mapInArrow
    monkeypatch.setattr(DataFrame, "mapInArrow", lambda self, f, *a: tasks.append(f) or whole(self, f, *a))
    decontaminate.stretches(spark.createDataFrame([(bytearray(b"t"), text)], "tag BINARY, text STRING"), maps)
    batch = pa.RecordBatch.from_arrays([pa.array([b"t", b"u"]), pa.array([text, "other words"])], names=["tag", "text"])
    list(tasks[0](iter([batch])))  # the broadcast is read
    tracemalloc.start()
    rows = [r for b in tasks[0](iter([batch])) for r in b.to_pylist()]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [r["tag"] for r in rows] == [b"t"] and sorted(s["k"] for s in rows[0]["seeds"]) == [1, 2, 3, 4, 5]
    assert np.frombuffer(rows[0]["words"], np.uint64).tolist() == words[:5].tolist()
    assert peak < 8 << 20 and powers.cache_info().currsize == 0
