import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from pixsieve.llm import blocks, lmscore, suffixes
from pixsieve.llm.components import components


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1)), st.lists(st.integers(0, 200)))
def test_messages_round_trip(keys, small):
    a, b = np.array(sorted(keys), np.uint64), np.array(small, np.uint8)
    x, y = blocks.unpack_arrays(blocks.pack_arrays(a, b))
    assert (x == a).all() and (y == b).all() and len(x) == len(a) and len(y) == len(b)


def brute_scores(rows, cuts):
    def words(t):
        return [w.encode() for w in re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))] + [None]

    part = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 5
    c, p = Counter(), Counter()
    for i, t in rows:
        if part(i) != 1:
            w = words(t)
            c.update(w)
            p.update(zip(w, w[1:]))  # noqa: B905
    n, v, of = sum(c.values()), len(c), Counter(p.values())
    d2, d3 = cuts(of[1], of[2], of[3], of[4])
    held = defaultdict(float)
    for (a, _), k in p.items():
        if k >= 2:
            held[a] += k - (d2 if k == 2 else d3)
    uni = lambda w: (c[w] + 0.5) / (n + 0.5 * (v + 1))
    out = []
    for i, t in rows:
        w = words(t)
        s = math.log10(uni(w[0]))
        for h, z in zip(w, w[1:]):  # noqa: B905
            k = p[h, z]
            s += math.log10(((k - (d2 if k == 2 else d3)) / c[h] if k >= 2 else 0) + (1 - held[h] / c[h] if c[h] else 1) * uni(z))
        out.append((i, part(i) == 1, len(w), sum(c[z] > 0 for z in w), n, round(sum(math.log10(uni(z)) for z in w), 4), round(s, 4)))
    return Counter(out)


def test_scores_equal_brute_force(spark, odd_docs, no_docs):
    rows = [(d.doc_id, d.text) for d in odd_docs.collect()]
    got = Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4), round(r.score, 4)) for r in lmscore.scores(odd_docs, block_bytes=50_000).collect())
    assert got == brute_scores(rows, lmscore.discounts)
    assert lmscore.scores(no_docs).count() == 0


def test_the_query_keeps_pairs_seen_once(spark, tmp_path):
    texts = ["a b c", "a b d", "a c d a b", "b c a", "c d", "a d b c", "c a d", "b a", "d c b"]
    rows = [(i, t) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id LONG, text STRING").repartition(2).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.score for r in lmscore.op9_lm_score(spark, str(tmp_path)).collect()}
    end, c, p = "", Counter(), Counter()
    for i, t in rows:
        if zlib.crc32(str(i).encode()) % 5 != 1:
            w = [*t.split(), end]
            c.update(w)
            p.update(zip(w, w[1:]))  # noqa: B905
    of = Counter(p.values())
    assert of[1] and of[2]
    cut = (lmscore.once_discount(of[1], of[2]), *lmscore.discounts(of[1], of[2], of[3], of[4]))
    uni = lambda w: (c[w] + 0.5) / (sum(c.values()) + 0.5 * (len(c) + 1))
    for i, t in rows:
        w = [*t.split(), end]
        s = math.log10(uni(w[0]))
        for h, z in zip(w, w[1:]):  # noqa: B905
            kept = {x: p[h, x] - cut[min(p[h, x], 3) - 1] for x in c if p[h, x]}
            s += math.log10(kept.get(z, 0) / c[h] + (1 - sum(kept.values()) / c[h]) * uni(z))
        assert abs(got[i] - s) < 1e-9


def brute_cut(rows, length):
    seen, out = set(), []
    for i, t in sorted(enumerate(rows), key=lambda x: (x[1][0] is None, x[1][0] or 0, x[0])):
        body = (t[1] or "").encode()
        gone = np.zeros(len(body), bool)
        for s in range(len(body) - length + 1):
            w = body[s : s + length]
            if w in seen:
                gone[s : s + length] = True
            else:
                seen.add(w)
        kept = np.frombuffer(body, np.uint8)[~gone].tobytes()
        out.append((t[0], len(body), int(gone.sum()), int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum()), hashlib.sha256(kept).hexdigest()))
    return Counter(out)


def test_repeats_equal_brute_force(spark, odd_docs, no_docs):
    rng = np.random.default_rng(4)
    passages = ["".join(rng.choice(list("ab cé"), 140)) for _ in range(6)]
    texts = []
    for _ in range(80):
        parts = ["".join(rng.choice(list("abcd "), int(rng.integers(0, 60)))) for _ in range(4)]
        for k in range(3):
            p = passages[int(rng.integers(6))]
            a = int(rng.integers(0, 40))
            parts.insert(k * 2, p[a : a + int(rng.integers(80, 140))])
        texts.append("".join(parts))
    texts += ["ab" * 300, "ab" * 260, "a" * 99, "a" * 100, "a" * 101, texts[3], texts[3]]
    rows = [(i, t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id LONG, text STRING").repartition(3)
    got = Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixes.cut_repeats(docs, block_bytes=3000).collect())
    assert got == brute_cut(rows, 100)
    odd = [(d.doc_id, d.text) for d in odd_docs.collect()]
    out = suffixes.cut_repeats(odd_docs, block_bytes=200_000).collect()
    assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in out) == brute_cut(odd, 100)
    assert all(hashlib.sha256(bytes(r.kept_text)).hexdigest() == r.kept_sha256 for r in out)
    assert suffixes.cut_repeats(no_docs).count() == 0


def test_hot_runs_are_dealt_out_by_their_strings(spark):
    rng = np.random.default_rng(6)
    noise = lambda n: "".join(rng.choice(list("abcdefgh é"), int(n)))
    line, passage, tail = noise(70), noise(130), noise(40)
    texts = [noise(rng.integers(0, 200)) + (line, passage, line + tail)[k % 3] + noise(rng.integers(0, 200)) for k in range(300)]
    texts += [texts[4], texts[4], passage + passage, line, "z" * 300, "z" * 200]
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, "doc_id LONG, text STRING").repartition(3)
    want = brute_cut(rows, 100)
    for hot in (0, 8, None):
        out = suffixes.cut_repeats(docs, block_bytes=9000, hot=hot).collect()
        assert Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in out) == want

    # a shard of suffixes gets no more of a run, however many texts hold it
    sink = pa.BufferOutputStream()
    table = pa.table({"order": [0] * len(rows), "id": [i for i, _ in rows], "tag": [0] * len(rows), "text": pa.array([t.encode() for t in texts], pa.binary())})
    with pa.ipc.new_stream(sink, table.schema) as writer:
        writer.write_table(table)
    part = pa.table({"packed": pa.array([sink.getvalue().to_pybytes()], pa.binary())})
    asked = suffixes.ask_runs(0, 100)([pa.scalar(0)], part)["packed"]
    reply = suffixes.shared_runs(20)([blocks.unpack_arrays(asked[0].as_buffer())])[0]
    replies = pa.table({"shard": [0], "packed": pa.array([blocks.pack_arrays(*reply)], pa.binary())})
    block = suffixes.Block(part["packed"], 100)
    sent, _, _ = block.survivors(block.kinds(replies, 0), 0)
    assert max(Counter(bytes(r[1][:50]) for r in sent).values()) <= 20


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.binary(max_size=8), max_size=8), min_size=1, max_size=6))
def test_loser_tree_merge(runs):
    runs = [sorted(r) for r in runs]
    shared = [[0 if k == 0 else suffixes.common_prefix(r[k - 1], r[k]) for k in range(len(r))] for r in runs]
    order, place, prefix = suffixes.merged(runs, shared)
    out = [runs[r][p] for r, p in zip(order, place, strict=True)]
    assert out == sorted(x for r in runs for x in r)
    assert prefix.tolist()[1:] == [suffixes.common_prefix(a, b) for a, b in zip(out, out[1:])]  # noqa: B905


def test_components(spark):
    edges = [(k, k + 1) for k in range(10, 40)] + [(1, 5), (5, 3), (7, 7), (100, 90), (90, 95)]
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "a LONG, b LONG")).collect()}
    assert got == {**{k: 10 for k in range(10, 41)}, 1: 1, 5: 1, 3: 1, 100: 90, 90: 90, 95: 90}
    assert components(spark.createDataFrame([], "a LONG, b LONG")).count() == 0
