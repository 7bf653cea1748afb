"""The shards of repeated passages hold like shares of the anchors."""

import numpy as np
import pyarrow as pa

from pixsieve.llm import blocks, suffixes


def test_anchors_fall_into_all_shards_alike():
    rng = np.random.default_rng(3)
    body = rng.integers(97, 123, 300_000).astype(np.uint8)
    place, _, _, h, _ = suffixes.anchors(body, np.array([0, len(body)]), 100)
    held = np.bincount(suffixes.shards_of(h, 4), minlength=16)
    assert len(place) > 5000 and held.min() > 0.7 * held.mean() and held.max() < 1.3 * held.mean()
    # equal runs have equal hashes still
    again = suffixes.anchors(np.concatenate([body[:1000], body[:1000]]), np.array([0, 1000, 2000]), 100)
    assert (again[3][: len(again[3]) // 2] == again[3][len(again[3]) // 2 :]).all()


def test_anchors_are_worked_out_before_the_cut_only(monkeypatch):
    """The last phase reads a block's own note instead of choosing and sorting its anchors once more."""
    texts = [b"q" * 20 + bytes(range(60, 120)) * 3, b"other " * 5 + bytes(range(60, 120)) * 3, b""]
    sink = pa.BufferOutputStream()
    table = pa.table({"order": [0] * 3, "id": [0, 1, 2], "tag": [0] * 3, "text": pa.array(texts, pa.binary())})
    with pa.ipc.new_stream(sink, table.schema) as writer:
        writer.write_table(table)
    part, key = pa.table({"packed": pa.array([sink.getvalue().to_pybytes()], pa.binary())}), [pa.scalar(0)]
    arrays = lambda x: blocks.unpack_arrays(x.as_buffer())
    packed = lambda rows: pa.table({c: [r[k] for r in rows] for k, c in enumerate(("shard", "packed", "kind"))})
    runs = suffixes.shared_runs(10)([arrays(suffixes.ask_runs(0, 100)(key, part)["packed"][0])])[0]
    sent = suffixes.send_suffixes(0, 100)(key, part, packed([(0, blocks.pack_arrays(*runs), 1)]))
    by_shard = dict(zip(sent["shard"].to_pylist(), sent["packed"], strict=True))
    marks = suffixes.covers([arrays(by_shard[0])], 100)[0]
    monkeypatch.setattr(suffixes, "anchors", None)
    out = suffixes.cut_block(0, 100, True)(key, part, packed([(0, blocks.pack_arrays(*marks), 2), (-1, by_shard[-1].as_py(), 5)]))
    assert out["n_removed"].to_pylist() == [120, 180, 0] and out["n_spans"].to_pylist() == [1, 1, 0]
    assert out["kept_text"].to_pylist() == [texts[0][:80], texts[1][:30], b""]
