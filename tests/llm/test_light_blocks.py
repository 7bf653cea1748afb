"""What a worker holds while it handles a block, and after it."""

import random
import tracemalloc

import pyarrow as pa

from pixsieve.llm import lmscore
from pixsieve.llm.common import light, light_cogroup, light_group
from pixsieve.llm.words import powers


def packed(rows: pa.Table) -> pa.Table:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema) as writer:
        writer.write_table(rows)
    return pa.table({"packed": pa.array([sink.getvalue().to_pybytes()], pa.binary())})


def test_tasks_give_their_memory_back():
    def run(batches):
        for batch in batches:
            powers(3, 1 << 16)
            yield batch

    batch = pa.RecordBatch.from_arrays([pa.array([1])], names=["a"])
    assert list(light(run)(iter([batch]))) == [batch] and powers.cache_info().currsize == 0
    powers(3, 1 << 16)
    assert light_group(lambda key, part: (key, part))(1, 2) == (1, 2) and powers.cache_info().currsize == 0
    powers(3, 1 << 16)
    assert light_cogroup(lambda key, left, right: (key, left, right))(1, 2, 3) == (1, 2, 3) and powers.cache_info().currsize == 0


def test_a_block_of_the_language_model_is_bounded():
    pick = random.Random(2)
    words = ["".join(pick.choices("abcdefghij", k=pick.randint(2, 9))) for _ in range(20_000)]
    texts, size = [], 0
    while size < lmscore.BLOCK_BYTES:
        texts.append(" ".join(pick.choices(words, k=600)))
        size += len(texts[-1])
    n = len(texts)
    part = packed(pa.table({"id": pa.array(range(n)), "held_out": pa.array([k % 5 == 1 for k in range(n)]), "text": pa.array(texts, pa.string())}))
    del texts
    key, bits = (pa.scalar(0, pa.int32()),), 0
    tracemalloc.start()
    asked = lmscore.ask(bits)(key, part)
    counts = pa.concat_tables([lmscore.count_shard(bits, 1)((pa.scalar(s, pa.int32()),), asked.filter(pa.array([x == s for x in asked["shard"].to_pylist()]))) for s in (0, 1)])
    kind = counts["kind"].to_numpy()
    own = counts.filter(pa.array(kind == 4))
    told = lmscore.spell_block(bits)(key, counts.filter(pa.array(kind == 1)), pa.table({"of_shard": own["shard"], "keys": own["packed"]}))
    held = lmscore.weigh_shard((pa.scalar(0, pa.int32()),), own, told)
    replies = pa.concat_tables([counts.filter(pa.array(kind == 0)), held.append_column("kind", pa.array([3] * len(held), pa.int32()))])
    del asked, counts, own, told, held
    scored = lmscore.score_block(bits, 1000, 100, (0.5, 0.7, 0.9), 1)(key, part, replies)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(scored) == n and peak < 160 << 20
