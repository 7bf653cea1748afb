import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from pixsieve.llm import collocations
from pixsieve.llm.words import bytes_of

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(docs, least, kept=2000):
    counts = defaultdict(Counter)
    for d in docs:
        own = counts["und" if d.lang is None else d.lang]
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (d.text or "").translate(UPPER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            own[()] += len(words)
            for k in (1, 2, 3, 4):
                own.update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = Counter()
    for lang, f in counts.items():
        n = f.pop(())
        found = {p: a for p, a in f.items() if a >= least}
        rows = []
        for p, a in found.items():
            if len(p) < 2:
                continue
            score, c = min((2_000_000 * a // (f[p[:c]] + f[p[c:]]), c) for c in range(1, len(p)))
            around = [b for q, b in found.items() if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))]
            if not any(100 * b >= 80 * a for b in around):
                rows.append((-score, -a, " ".join(p).encode(), f[p[:c]], f[p[c:]]))
        for rank, (score, a, p, left, right) in enumerate(sorted(rows)[:kept], 1):
            out[lang, rank, p.decode(), -a, left, right, n, -score] += 1
    return out


def run(docs, least, **options):
    cols = ("lang", "rank", "phrase", "a", "l", "r", "n", "score")
    return Counter(tuple(r[c] for c in cols) for r in collocations.collocations(docs, min_count=least, **options).collect())


def made(spark, n=300):
    rng = random.Random(11)
    vocabulary = [*"abcdefghij", "New", "york", "città", "東京", "São", "x" * 40, "\xa0", "\x1c"]
    rows = []
    for i in range(n):
        words = [rng.choice(vocabulary) if rng.random() < 0.7 else "new  York\tcity" for _ in range(rng.randint(0, 60))]
        text = "".join(w + rng.choice([" ", " ", "  ", "\t", ", ", "\n", "."]) for w in words)
        rows.append((i, None if i % 50 == 9 else text, [None, "en", "de", "und", ""][i % 5], "s"))
    rows += [(5, "a hot line, in  every Copy of it", "en", "s")] * 200
    rows += [(6, " ".join(rng.choices(vocabulary, k=30_000)), "long", "s")]
    return spark.createDataFrame(rows, "doc_id LONG, text STRING, lang STRING, phrase STRING").repartition(4)


def test_equals_brute_force(spark):
    docs = made(spark)
    want = brute(docs.collect(), 5)
    assert len(want) > 100 and run(docs, 5) == want
    assert run(docs, 5, kept=3) == brute(docs.collect(), 5, 3)


def test_odd_rows(odd_docs, no_docs):
    assert run(odd_docs, 2) == brute(odd_docs.collect(), 2)
    assert run(no_docs, 1) == Counter()


@pytest.mark.parametrize("weak", ["fp", "bitmap", "slices"])
def test_collisions_full_bitmaps_and_short_slices(spark, monkeypatch, weak):
    """First fingerprints of 6 bits, a bitmap of 2^7 bits, slices of 100 bytes: the result stays."""
    docs = made(spark, 40)
    want = brute(docs.collect(), 3)
    if weak == "bitmap":
        monkeypatch.setattr(collocations, "BITMAP_BITS", (7, 7))
    if weak == "slices":
        monkeypatch.setattr(collocations, "SLICE_BYTES", 100)
        monkeypatch.setattr(collocations, "HELD_KEYS", 500)
    if weak == "fp":
        narrow_fp(monkeypatch)
    assert run(docs, 3) == want


def narrow_fp(monkeypatch):
    """Fingerprints keep 6 of their 62 bits; the workers get the changed method with the class, pickled by value."""
    import sys

    from pyspark import cloudpickle

    plain = collocations.Prefixes.fingerprints

    def narrow(self, first, last, lang):
        return plain(self, first, last, lang) & np.uint64(0xFC00000000000000)

    monkeypatch.setattr(collocations.Prefixes, "fingerprints", narrow)
    cloudpickle.register_pickle_by_value(sys.modules["pixsieve.llm.collocations"])


def test_cuts_keep_pieces_whole():
    texts = ["one two. three", "", "x" * 50, "a b c d e f g h, i j k", "."]
    body, offsets = bytes_of(pa.array(texts))
    for limit in (1, 5, 17, 1000):
        parts = list(collocations.cuts(body, offsets, limit))
        assert [a for a, _ in parts] == [0, *[b for _, b in parts[:-1]]] and parts[-1][1] == len(body)
        for _, to in parts[:-1]:
            assert to in offsets or collocations.BREAK[body[to - 1]]


def counts_of(keys):
    fp, n = np.unique(np.array(keys, np.uint64), return_counts=True)
    return [fp, n, fp + np.uint64(1), n * 0 + 8]


def test_keys_that_recur_stay_in_a_full_table():
    """30 frequent keys among ever new ones: each is sent once at the end, not with every full table."""
    parts = [counts_of([*range(30), *range(30), *range(1000 + 50 * i, 1050 + 50 * i)]) for i in range(40)]
    out = [[x.copy() for x in counts] for counts in collocations.summed(iter(parts), 200)]
    fp, n, guard, pointer = (np.concatenate(x) for x in zip(*out, strict=True))
    assert len(fp) == 30 + 40 * 50 and len(np.unique(fp)) == len(fp)
    assert (n[fp < 30] == 80).all() and (n[fp >= 1000] == 1).all()
    assert (guard == fp + 1).all() and (pointer == 8).all()


def test_counts_larger_than_the_table_go_through():
    parts = [counts_of(range(5)), counts_of(range(50)), counts_of(range(5))]
    total = Counter()
    for fp, n, *_ in collocations.summed(iter(parts), 10):
        total.update(dict(zip(fp.tolist(), n.tolist(), strict=True)))
    assert total == Counter({i: 3 if i < 5 else 1 for i in range(50)})
    assert list(collocations.summed(iter([]), 10)) == []


def test_small_tasks_add_up_together(spark):
    """64 tasks of one text each: a phrase is sent by a few units, not by each of them."""
    rows = spark.createDataFrame([(i, "en", "one two three four") for i in range(64)], "tag LONG, lang STRING, text STRING").repartition(64)
    units = collocations.in_units(rows)
    most = max(1, spark.sparkContext.defaultParallelism)
    assert units.rdd.getNumPartitions() <= most
    full = np.full(1 << 10, 255, np.uint8)
    sent = collocations.added_up(units, lambda batch: collocations.runs_of(batch, full), "fp long, n long, guard long, pointer long")
    assert sent.count() <= most * 11  # ten phrases and the empty one
    assert sent.agg({"n": "sum"}).first()[0] == 64 * (10 + 4)
