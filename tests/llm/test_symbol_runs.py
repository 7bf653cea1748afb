"""Runs of symbols are told apart by tables, and texts that are asked about and scored are shuffled once."""

import random

import pyarrow as pa
import pytest

from pixsieve.llm import quality


@pytest.mark.parametrize("alphabet", ["ab", "abc é東🙂\x00", "".join(map(chr, range(0x4E00, 0x5E00)))])
def test_runs_of_symbols_equal_plain_cutting(alphabet):
    pick = random.Random(4)
    texts = ["", *("".join(pick.choices(alphabet, k=pick.choice([0, 1, 2, 3, 40, 3000]))) for _ in range(30)), ""]
    context, last, where, sizes = quality.symbol_runs(pa.array(texts, pa.string()))
    want = []
    for t in texts:
        symbols = [0, 0, 0, *(ord(c) + 1 for c in t), 0]
        want += [(symbols[i - 3] << 42 | symbols[i - 2] << 21 | symbols[i - 1], symbols[i]) for i in range(3, len(symbols))]
    assert list(zip(context[where].tolist(), last[where].tolist(), strict=True)) == want
    assert len(context) == len(set(want)) and sizes.tolist() == [len(t) + 1 for t in texts]


def test_texts_to_be_judged_are_shuffled_once(spark):
    docs = spark.createDataFrame([(k, "some text of its own", "en") for k in range(20)], "doc_id LONG, text STRING, lang STRING")
    orders = quality.kneser_ney(quality.run_counts(docs.select("text")))
    found = quality.perplexities(docs, orders, "doc_id", "text", "lang")
    assert len(found.collect()) == 20
    assert "ReusedExchange" in found._jdf.queryExecution().executedPlan().toString()
