import hashlib
import json
import subprocess
import sys
import tracemalloc
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pixsieve.llm import exact, mixing, tokens
from pixsieve.llm.radix import RadixTrie, common_prefix


def test_token_files_equal_plain_encoding(odd_docs, no_docs):
    tok = tokens.tokenizer(tokens.default_vocabulary())[0]
    got = tokens.tokenised(odd_docs).collect()
    plain = Counter()
    for d in odd_docs.collect():
        ids = [*tok.encode(d.text or "", add_special_tokens=False).ids, 2]
        plain[d.doc_id, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == plain
    ordered = sorted(got, key=lambda r: r.start)
    assert [r.start for r in ordered] == [0, *np.cumsum([r.n_tokens for r in ordered])[:-1].tolist()]
    assert [r.doc_id for r in ordered] == sorted((r.doc_id for r in got), key=lambda i: (i is not None, i or 0))
    assert tokens.tokenised(no_docs).count() == 0


def test_token_files_are_read_by_another_process(spark, tmp_path):
    texts = {1: "The quick brown fox.", 2: "", 3: "déjà vu 東京 \x1c 🙂", 7: "x" * 5000}
    docs = spark.createDataFrame(list(texts.items()), "doc_id LONG, text STRING")
    folder = str(tmp_path / "files")
    tokens.write_files(docs, folder)
    code = (
        "import sys, json; from pixsieve.session import local_session; from pixsieve.llm import tokens; import numpy as np;"
        "rows = tokens.decoded(local_session('other', 2), sys.argv[1], with_ids=True).collect();"
        "print('IDS' + json.dumps({r.doc_id: np.frombuffer(r.ids, '<u4').tolist() for r in rows}))"
    )
    out = subprocess.run([sys.executable, "-c", code, folder], capture_output=True, text=True, cwd=Path(__file__).parents[2], timeout=120, check=True).stdout
    got = json.loads(next(line for line in out.splitlines() if line.startswith("IDS"))[3:])
    tok = tokens.tokenizer(tokens.default_vocabulary())[0]
    assert got == {str(i): [*tok.encode(t, add_special_tokens=False).ids, 2] for i, t in texts.items()}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 300)), min_size=1))
def test_codes_round_trip(docs):
    counts = np.array([len(d) for d in docs])
    values = np.array([v for d in docs for v in d], np.uint32)
    control, data = tokens.pack(values, counts)
    assert (tokens.unpack(control, data, counts) == values).all()
    assert [len(c.as_py()) for c in control] == [-(-n // 4) for n in counts]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.binary(max_size=6)))
def test_trie_holds_every_string_once(keys):
    trie = RadixTrie(lambda a, b: a + b)
    for k in keys:
        trie.insert(k, 1)
    spilled = Counter()
    if trie.held:
        for k, n in trie.evict():
            spilled[k] += n
    assert dict(trie.items()) | spilled == Counter(keys)


def test_trie_size_is_what_it_holds():
    tracemalloc.start()
    trie = RadixTrie(lambda a, b: a + b)
    for k in range(20_000):
        trie.insert(hashlib.md5(str(k).encode()).digest()[:15], (True, k, 1))
    held, _ = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert 0.5 * held < trie.size < 2 * held
    while trie.held:
        list(trie.evict())
    assert trie.size == 0


@given(st.binary(), st.binary())
def test_common_prefix(a, b):
    n = common_prefix(a, b)
    assert a[:n] == b[:n] and (n == min(len(a), len(b)) or a[n] != b[n])


@pytest.mark.parametrize("trie_bytes", [64 << 20, 1000])
def test_exact_groups(odd_docs, no_docs, trie_bytes):
    rows = odd_docs.selectExpr("doc_id AS id", "coalesce(text, '') AS text", "monotonically_increasing_id() AS tag")
    assert exact.owners(rows, trie_bytes=trie_bytes).count() == len({(d.text or "") for d in odd_docs.collect()})
    groups = {}
    for d in odd_docs.collect():
        groups.setdefault(d.text or "", []).append(d.doc_id)
    got = exact.exact_groups(odd_docs).collect()
    assert len(got) == odd_docs.count() and sum(r.kept for r in got) == len(groups)
    want = Counter((i, max((x for x in g if x is not None), default=None), len(g)) for g in groups.values() for i in g)
    assert Counter((r.doc_id, r.keep_id, r.group_size) for r in got) == want
    smallest = {(r.doc_id, r.keep_id) for r in exact.exact_groups(odd_docs, keep="smallest").collect()}
    assert (8, 8) in smallest and (5, 4) in smallest and (None, 7) in smallest
    assert exact.exact_groups(no_docs).count() == 0


def test_mix_meets_targets(odd_docs, no_docs, spark):
    got = mixing.taken_copies(odd_docs).collect()
    assert len(got) == odd_docs.count()
    by_source = {}
    for r in got:
        by_source.setdefault(r.source, []).append(r)
    total = sum(r.size for r in got)
    assert abs(sum(rs[0].target for rs in by_source.values()) - total) < 1e-6 * total
    for rs in by_source.values():
        assert rs[0].source_size == sum(r.size for r in rs) and rs[0].target <= 3 * rs[0].source_size + 1e-9
        assert abs(sum(r.size * r.copies for r in rs) - rs[0].target) <= max(r.size for r in rs)
        assert all(r.copies <= 3 for r in rs)
    mixed = mixing.mix(odd_docs)
    assert mixed.columns == [*odd_docs.columns, "mix_copy", "mix_position"]
    at = [r.mix_position for r in mixed.collect()]
    assert at == sorted(at) and all(0 <= x <= 1 for x in at)
    assert mixing.mix(no_docs).count() == 0 and mixing.taken_copies(no_docs).count() == 0


def test_positions_follow_the_schedule(spark):
    rows = [(i, "w " * 10, "abc"[i % 3]) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id LONG, text STRING, source STRING")
    order = mixing.training_order(mixing.taken_copies(docs)).collect()
    early = Counter(r.source for r in order if r.position < 0.5)
    whole = Counter(r.source for r in order)
    # the first weight's density runs from 0.5 to 1.5, the last one's from 1.5 to 0.5: 3/8 and 5/8 of their words come early
    assert abs(early["a"] / whole["a"] - 0.375) < 0.02 and abs(early["c"] / whole["c"] - 0.625) < 0.03
