"""Sharded count joins: blocks of documents ask, shards of keys answer.

Documents are packed and dealt to blocks by their id's hash; a block works out which 64-bit keys it needs and how often it
counts each, and writes one packed message per shard (a range of keys). A shard merges the messages of all blocks and
answers each block in the order it asked. Both sides are Spark groups of bounded size: blocks by the bytes of text, shards
by the number of keys, of which each block sends one entry however often it occurs.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pixsieve.llm.common import block_count, light

PACKED = "block int, packed binary"
MESSAGE = "shard int, block int, packed binary"


def blocks_for(docs: DataFrame, text: Column, block_bytes: int) -> int:
    """Blocks by the bytes of text, and enough for all shuffle partitions."""
    return max(block_count(docs, text, block_bytes), int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def packed_rows(rows: DataFrame, blocks: int, key: Column) -> DataFrame:
    """The rows dealt to blocks by the hash of key, many rows of a task in one compressed value: block, packed."""
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        options = pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=3))
        for batch in batches:
            if not batch.num_rows:
                continue
            order = pc.sort_indices(batch.column(0))
            own = batch.take(order)
            block = own.column(0).to_numpy()
            begins = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]]))
            out = []
            for a, b in zip(begins, [*begins[1:], len(block)], strict=True):
                part = pa.RecordBatch.from_arrays(own.columns[1:], names=names).slice(a, b - a)
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, part.schema, options=options) as writer:
                    writer.write_batch(part)
                out.append(sink.getvalue().to_pybytes())
            yield pa.RecordBatch.from_arrays([pa.array(block[begins], pa.int32()), pa.array(out, pa.binary())], names=["block", "packed"])

    dealt = rows.select(F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int").alias("block_of_row"), *names)
    return dealt.mapInArrow(light(run), PACKED)


def unpacked(packed: pa.ChunkedArray | pa.Array) -> pa.Table:
    """The rows of a block's packed values, in the order of their first column, then of the others' arrival."""
    return pa.concat_tables([pa.ipc.open_stream(x.as_buffer()).read_all() for x in packed]).combine_chunks()


def pack_arrays(*arrays: np.ndarray) -> bytes:
    """Arrays of one message, compressed, byte planes apart; sorted 64-bit keys travel as their differences."""
    parts, head = [], []
    for a in arrays:
        ascending = a.dtype == np.uint64 and len(a) > 1 and bool((a[1:] >= a[:-1]).all())
        body = np.ascontiguousarray(np.diff(a, prepend=np.uint64(0)) if ascending else a)
        parts.append(np.ascontiguousarray(body.view(np.uint8).reshape(-1, a.itemsize).T).tobytes())
        head.append((a.dtype.str, len(a), ascending))
    raw = json.dumps(head).encode().ljust(64) + b"\n" + b"".join(parts)
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def unpack_arrays(packed: bytes | pa.Buffer) -> list[np.ndarray]:
    packed = memoryview(packed)
    raw = pa.decompress(packed[8:], int.from_bytes(packed[:8], "little"), codec="zstd", asbytes=True)
    at = raw.index(b"\n") + 1
    out = []
    for kind, n, ascending in json.loads(raw[:at]):
        kind = np.dtype(kind)
        planes = np.frombuffer(raw, np.uint8, n * kind.itemsize, at).reshape(kind.itemsize, n)
        at += planes.nbytes
        a = np.ascontiguousarray(planes.T).view(kind).ravel()
        out.append(np.cumsum(a) if ascending else a)
    return out


def shard_bits(shards: int) -> int:
    return max(0, (shards - 1).bit_length())


def by_shard(keys: np.ndarray, bits: int) -> list[tuple[int, int, int]]:
    """(shard, from, to) of sorted 64-bit keys, by their leading bits."""
    if not len(keys):
        return []
    if not bits:
        return [(0, 0, len(keys))]
    shard = (keys >> np.uint64(64 - bits)).astype(np.int64)
    begins = np.flatnonzero(np.concatenate([[True], shard[1:] != shard[:-1]]))
    return list(zip(shard[begins].tolist(), begins.tolist(), [*begins[1:].tolist(), len(keys)], strict=True))


def messages(rows: list[tuple[int, int, bytes]], names: tuple[str, str, str] = ("shard", "block", "packed")) -> pa.Table:
    cols = list(zip(*rows, strict=True)) if rows else [[], [], []]
    return pa.table([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.binary())], names=list(names))


Answer = Callable[[list[list[np.ndarray]]], list[tuple[np.ndarray, ...]]]


def answered(requests: DataFrame, answer: Answer, odd: Answer | None = None) -> DataFrame:
    """Per shard the answers to all blocks: answer gets each block's arrays and gives each block's reply; odd, if given, does so in
    shards of odd number. What a block sends to a shard below 0 comes back as it is."""

    def run(key, asked):
        if key[0].as_py() < 0:
            return asked
        asked = asked.sort_by("block")
        blocks = asked["block"].to_pylist()
        own = odd if odd and key[0].as_py() % 2 else answer
        replies = own([unpack_arrays(x.as_buffer()) for x in asked["packed"]])
        return messages([(key[0].as_py(), b, pack_arrays(*r)) for b, r in zip(blocks, replies, strict=True)])

    return requests.groupBy("shard").applyInArrow(run, MESSAGE)
