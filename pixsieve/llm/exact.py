"""Exact dedup by Patricia-trie owners.

Each scanning task inserts its rows' full byte strings into a compressed radix trie whose terminals keep (owner, count),
so copies within a task cost nothing further. A trie above its byte budget spills its largest subtree: the terminals go
on as partial rows, to be merged by their owner. Partial rows are partitioned and sorted by (length, content hash); the
owner of such a key inserts the strings into a trie of its own, so equality is decided by bytes, and the terminal's
value is final. A key's rows arrive in a stream and at most one per task and eviction, so no hot text fills a task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pixsieve.llm.common import table, whole_text
from pixsieve.llm.radix import RadixTrie

PARTIAL = "length long, hash long, body binary, has_id boolean, owner long, n long"
OWNER = "digest binary, has_id boolean, owner long, n long"


def merge_largest(a: tuple, b: tuple) -> tuple:
    """(has_id, id, count): the largest id stays; a null id loses against any."""
    return (*max(a[:2], b[:2]), a[2] + b[2])


def merge_smallest(a: tuple, b: tuple) -> tuple:
    """As merge_largest with the smallest id; a null id loses here too."""
    return (*min(a[:2], b[:2], key=lambda x: (not x[0], x[1])), a[2] + b[2])


def owners(docs: DataFrame, keep: str = "largest", trie_bytes: int = 64 << 20) -> DataFrame:
    """One row per distinct text: digest (SHA-256), owner (the id that stays), n (rows). docs: (id, text)."""
    merge = {"largest": merge_largest, "smallest": merge_smallest}[keep]

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = RadixTrie(merge)
        for batch in batches:
            for i, body in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                trie.insert(body, (i is not None, i or 0, 1))
                if trie.size > trie_bytes:
                    yield from partial_rows(trie.evict())
        yield from partial_rows(trie.items())

    def final(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, trie, out = None, RadixTrie(merge), []
        for batch in batches:
            names = batch.schema.names
            cols = [batch.column(names.index(c)).to_pylist() for c in ("length", "hash", "body", "has_id", "owner", "n")]
            for length, code, body, *value in zip(*cols, strict=True):
                if (length, code) != key:
                    out.extend(trie.items())
                    key, trie = (length, code), RadixTrie(merge)
                    if len(out) >= 5000:
                        yield owner_rows(out)
                        out = []
                trie.insert(body, tuple(value))
        out.extend(trie.items())
        yield owner_rows(out)

    partial = docs.select("id", F.col("text").cast("binary").alias("body")).mapInArrow(local, PARTIAL)
    dealt = partial.repartition("length", "hash").sortWithinPartitions("length", "hash")
    return dealt.mapInArrow(final, OWNER)


def partial_rows(items) -> Iterator[pa.RecordBatch]:
    """Batches of bounded bytes from (string, value)."""
    rows, held = [], 0
    for body, (has_id, owner, n) in items:
        code = int.from_bytes(hashlib.blake2b(body, digest_size=8).digest(), "little", signed=True)
        rows.append((len(body), code, body, has_id, owner, n))
        held += len(body)
        if held > 8 << 20 or len(rows) >= 5000:
            yield partial_batch(rows)
            rows, held = [], 0
    if rows:
        yield partial_batch(rows)


def partial_batch(rows: list) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.binary(), pa.bool_(), pa.int64(), pa.int64())
    names = ("length", "hash", "body", "has_id", "owner", "n")
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def owner_rows(items: list) -> pa.RecordBatch:
    cols = [(hashlib.sha256(body).digest(), has_id, owner, n) for body, (has_id, owner, n) in items]
    kinds, names = (pa.binary(), pa.bool_(), pa.int64(), pa.int64()), ("digest", "has_id", "owner", "n")
    by_column = zip(*cols, strict=True) if cols else [[]] * 4
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(by_column, kinds, strict=True)], names=names)


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "largest") -> DataFrame:
    """One row per row of docs, dropped ones too: doc_id, keep_id, group_size, kept, text_sha256.

    A null text counts as empty; a null id never stays while a real one is there, and keep_id is null where a text has
    only null ids. Rows that repeat id and text are one group of which one row stays. Other columns are not read; an
    empty table gives no rows.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), whole_text(text_col).alias("text"))
    own = owners(rows, keep)
    # rows equal in id and text are numbered among themselves: one of them stays
    number = F.row_number().over(Window.partitionBy("digest", "id").orderBy(F.lit(0)))
    keyed = rows.select("id", F.unhex(F.sha2("text", 256)).alias("digest")).withColumn("number", number)
    keep_id = F.when(F.col("has_id"), F.col("owner"))
    return keyed.join(own, "digest").select(
        F.col("id").alias("doc_id"),
        keep_id.alias("keep_id"),
        F.col("n").alias("group_size"),
        (F.col("id").eqNullSafe(keep_id) & (F.col("number") == 1)).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the id that stays for its text."""
    return exact_groups(table(spark, sf_dir, "documents"))


SQL = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""
QUERIES = {"op4_exact_dedup": op4_exact_dedup}
ORACLES = {"op4_exact_dedup": SQL}
