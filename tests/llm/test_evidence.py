"""The classifier's log odds: worked out in tasks, four bytes an entry on the driver."""

import random

import numpy as np
import pyarrow as pa
from pyspark.sql.classic.dataframe import DataFrame

from pixsieve.llm import toxicity


def test_odds_equal_those_of_all_rows_at_once_and_few_bytes_are_sent(spark, monkeypatch):
    pick = random.Random(7)
    words = ["".join(pick.choices("abcdefgh", k=pick.randint(2, 6))) for _ in range(400)]
    rows = [(" ".join(pick.choices(words[: 200 + 200 * y], k=30)), y) for y in (pick.randint(0, 1) for _ in range(300))]
    docs = spark.createDataFrame([(None, 0), ("", 1), *rows], "text STRING, toxic INT").na.fill("", ["text"]).repartition(5)
    model = toxicity.char_model(toxicity.char_counts(docs, "text"))
    sizes, whole = [], DataFrame.toArrow
    monkeypatch.setattr(DataFrame, "toArrow", lambda self: sizes.append(whole(self)) or sizes[-1])
    got = toxicity.evidence(docs, model)
    assert sum(t.nbytes for t in sizes) <= 5 * toxicity.ENTRIES

    table = pa.Table.from_pylist([r.asDict() for r in docs.collect()]).combine_chunks()
    own, doc = toxicity.features(table["text"].chunk(0), toxicity.Reader(model))
    label, totals = table["toxic"].to_numpy(), np.zeros((4, toxicity.ENTRIES))
    toxicity.counted(own, doc, label, totals)
    want = toxicity.log_odds(np.concatenate([np.bincount(label[doc], minlength=2), np.bincount(label, minlength=2)]).astype(float), totals)
    assert np.count_nonzero(want) > 100 and np.allclose(got, want.astype(np.float32), rtol=1e-6, atol=0)
    assert not toxicity.evidence(docs.limit(0), model).any()
