import hashlib
import math
import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa

import corpus_pipeline
from pixsieve.llm import decontaminate, mixing, nearcopies, tokens, toxicity
from pixsieve.llm.common import table
from pixsieve.llm.words import word_hashes

SF = "/root/testdata/sf0.001"


def words(text: str) -> np.ndarray:
    return word_hashes(pa.array([text]), strip=True)[0]


def alike(a: str, b: str) -> bool:
    x, y = nearcopies.numbers(pa.array([a, b]))
    m = nearcopies.aligned(x, y, None) if len(x) and len(y) and min(len(x), len(y)) >= 0.8 * max(len(x), len(y)) else 0
    return m > 0 and m / (len(x) + len(y) - m) >= 0.8 - 1e-12


def one_each(rows: dict[int, str]) -> dict[int, str]:
    first: dict[int, int] = {}
    for i in sorted(rows):
        same = {first[j] for j in first if rows[i] == rows[j] or alike(rows[i], rows[j])}
        first[i] = min(same | {i})
        for j in first:
            if first[j] in same:
                first[j] = first[i]
    return {i: t for i, t in rows.items() if first[i] == i}


def clean(rows: dict[int, str], items: list[str]) -> dict[int, str]:
    tests = [w for w in map(words, items) if len(w)]

    def covered(text: str) -> bool:
        own = words(text)
        found = set(own.tolist())
        likely = (t for t in tests if np.isin(t, list(found)).mean() >= decontaminate.COVERAGE)
        return any(sum(n for _, _, n in decontaminate.tiles(t, own, min(5, len(t)))) / len(t) >= decontaminate.COVERAGE for t in likely)

    return {i: t for i, t in rows.items() if not covered(t)}


def mixed(rows: dict[int, str], source: dict[int, str]) -> list[int]:
    """The ids of the mix in training order."""
    size = {i: len(re.findall(mixing.WORD, t)) for i, t in rows.items()}
    held = defaultdict(int)
    for i, n in size.items():
        held[source[i]] += n
    weight = {s: mixing.WEIGHTS[k % 3] for k, s in enumerate(sorted(held))}
    goal, left = {}, set(held)
    rest = sum(held.values())
    while left:
        level = rest / sum(weight[s] for s in left)
        over = {s for s in left if weight[s] * level >= 3 * held[s]}
        if not over:
            goal |= {s: weight[s] * level for s in left}
            break
        goal |= {s: 3 * held[s] for s in over}
        rest -= sum(3 * held[s] for s in over)
        left -= over
    out, done = [], defaultdict(int)
    for i in sorted(rows, key=lambda i: (hashlib.md5(str(i).encode()).hexdigest(), i)):
        s = source[i]
        whole = goal[s] // held[s]
        copies = int(whole) + (done[s] + size[i] / 2 < goal[s] - whole * held[s])
        begin = mixing.STARTS[sorted(held).index(s) % 3]
        slope = (1 - begin) * 2
        for copy in range(copies):
            u = min(1.0, (done[s] + copy * held[s]) / goal[s])
            out.append(((math.sqrt(begin * begin + slope * u * 2) - begin) / slope if slope else u, i, copy))
        done[s] += size[i]
    return [i for _, i, _ in sorted(out)]


def test_pipeline_equals_brute_force(spark):
    docs = table(spark, SF, "documents")
    rows = {r.doc_id: r.text or "" for r in docs.collect()}
    source = {r.doc_id: r.source for r in docs.collect()}
    toxic = {r.doc_id for r in toxicity.scored(docs, table(spark, SF, "labels")).collect() if r.score >= 0.5}
    rows = one_each({i: t for i, t in rows.items() if i not in toxic})
    rows = clean(rows, [r.text for r in table(spark, SF, "benchmark").collect()])
    tok, start, want = tokens.tokenizer(tokens.default_vocabulary())[0], 0, []
    for i in mixed(rows, source):
        ids = [*tok.encode(rows[i], add_special_tokens=False).ids, 2]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    got = sorted(tuple(r) for r in corpus_pipeline.run(spark, SF).select("doc_id", "start", "n_tokens", "ids_crc32").collect())
    assert got == sorted(want)


def test_stages_bear_odd_and_empty_tables(spark, odd_docs, no_docs):
    plain = odd_docs.select("doc_id", "text", "lang", "source", "n_chars")
    for docs in (plain, no_docs.select(plain.columns)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            assert stage(spark, docs, SF).columns == plain.columns
        assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == docs.count()
