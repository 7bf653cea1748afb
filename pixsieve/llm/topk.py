"""Exact top-k search by multi-resolution segment statistics.

Vectors are cut into segments of which each keeps its mean and its deviation (the length of what the mean leaves). Segment by
segment no inner product exceeds L * mean * mean + deviation * deviation, which is to say that no squared distance is below
L * (mean - mean)^2 + (deviation - deviation)^2. A few long segments rule most candidates out, more short ones most of
the rest, and only what survives is multiplied out, in whole numbers.

Equal vectors are one candidate with its smallest ids, so neither many copies of a vector nor many queries for it meet in a
task. Distinct vectors are range-sorted by the signs of their segment means and dealt into chunks of bounded bytes. The queries
of a chunk first search their own chunk: the score of their last hit there is a floor for all others. Then every chunk
meets the queries of all chunks, a bounded slab of them at a time, and sends on what reaches the floor.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pixsieve.llm.blocks import pack_arrays, unpack_arrays
from pixsieve.llm.common import stored, table
from pixsieve.llm.ranks import ranked

K = 20
EVERY = 20
SCALE = 64
#: Segments per level, coarse to fine.
LEVELS = (4, 16)
#: Bytes that a chunk's numbers take at most as 64-bit ones, and its vectors at most (a power of two).
CHUNK_BYTES = 8 << 20
CHUNK_ROWS = 4096
#: Queries that meet a chunk at once.
BLOCK = 512
#: Chunks whose queries meet another chunk in one call.
SLAB = 128
KINDS = (np.int8, np.int16, np.int32, np.int64)


def whole_numbers(rows: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec (the floors of scale times the components, in the narrowest width that holds them), places, code, vec_id.

    rows: (vec_id, x as array of doubles). Left out are null ids, null vectors, and those with a component that is null, not
    finite, or whose floor is no 64-bit number.
    """
    def run(batches):
        for batch in batches:
            there = batch.filter(pc.and_(batch.column(0).is_valid(), batch.column(1).is_valid()))
            ids, x = there.column(0).to_numpy(), there.column(1)
            places = pc.list_value_length(x).to_numpy()
            values, starts = x.flatten().to_numpy(zero_copy_only=False), np.cumsum(places) - places  # nulls are nan here
            out = []
            for n in np.unique(places).tolist():
                rows_of = np.flatnonzero(places == n)
                v = np.floor(scale * values[starts[rows_of][:, None] + np.arange(n)])
                fit = (np.abs(v) < 2.0**63).all(axis=1)  # false for what is not finite too
                v, rows_of = v[fit].astype(np.int64), rows_of[fit]
                means, _ = statistics(v.astype(np.float64), LEVELS[-1])
                codes = np.packbits(means > 0, axis=1).astype(np.int64) @ (1 << 8 * np.arange(-(-means.shape[1] // 8))[::-1])
                least, most = v.min(axis=1, initial=0), v.max(axis=1, initial=0)
                width = sum(((least < np.iinfo(k).min) | (most > np.iinfo(k).max)).astype(int) for k in KINDS)
                for row, w, code, i in zip(v, width, codes.tolist(), ids[rows_of].tolist(), strict=True):
                    out.append((bytes([1 << w]) + row.astype(KINDS[w]).tobytes(), n, code, i))
            cols = list(zip(*out, strict=True)) if out else [[]] * 4
            kinds = (pa.binary(), pa.int32(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["vec", "places", "code", "vec_id"])

    return rows.mapInArrow(run, "vec binary, places int, code long, vec_id long")


def matrix(vecs: list[bytes], places: int) -> np.ndarray:
    """Vectors as rows of 64-bit numbers, with zeros behind the shorter ones."""
    out = np.zeros((len(vecs), places), np.int64)
    for i, v in enumerate(vecs):
        own = np.frombuffer(v, f"<i{v[0]}", offset=1)
        out[i, : len(own)] = own
    return out


def widened(numbers: np.ndarray, size: np.ndarray, rows: int, places: int) -> np.ndarray:
    """Flat numbers of rows of this size as a matrix, with zeros behind up to so many places."""
    return np.pad(numbers.reshape(rows, int(size[0])), ((0, 0), (0, places - int(size[0]))))


def segments(places: int, n: int) -> np.ndarray:
    """Where each of n segments begins, with the end."""
    return np.unique(np.linspace(0, places, min(n, places) + 1).astype(np.int64))


def statistics(rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Means times the root of their segment's length, and deviations: each row by segment."""
    at = segments(rows.shape[1], n)
    if len(at) < 2:
        return np.zeros((len(rows), 0)), np.zeros((len(rows), 0))
    size = np.diff(at)
    sums = np.add.reduceat(rows, at[:-1], axis=1)
    rest = rows - np.repeat(sums / size, size, axis=1)
    return sums / np.sqrt(size), np.sqrt(np.add.reduceat(rest * rest, at[:-1], axis=1))


def outline(rows: np.ndarray, n: int) -> np.ndarray:
    """Per row the numbers whose inner product with another row's bounds the rows' own from above."""
    return np.concatenate(statistics(rows.astype(np.float64), n), axis=1)


def products(rows: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Exact inner products of all rows with all others, as 64-bit numbers.

    In floats where they hold every partial sum, else in Python's whole numbers, kept within 64 bits.
    """
    largest = [max(float(np.abs(x.astype(np.float64)).max(initial=0)), 1.0) for x in (rows, others)]
    bound = largest[0] * largest[1] * max(rows.shape[1], 1)
    if bound < 2.0**52:
        kind = np.float32 if bound < 2.0**23 else np.float64
        return (rows.astype(kind) @ others.astype(kind).T).astype(np.int64)
    exact = rows.astype(object) @ others.astype(object).T
    return np.clip(exact, -(2**63), 2**63 - 1).astype(np.int64)


def floors(queries: np.ndarray, rows: np.ndarray, copies: np.ndarray, k: int) -> np.ndarray:
    """Per query the score that k of these rows reach, each as often as it has copies; minus infinity if they are fewer."""
    if int(copies.sum()) < k or not len(queries):
        return np.full(len(queries), -np.inf)
    score = products(queries, rows)
    best = np.argpartition(score, max(0, len(rows) - k), axis=1)[:, -k:]  # k distinct vectors are k rows at least
    score = np.take_along_axis(score, best, axis=1)
    order = np.argsort(score, axis=1)[:, ::-1]
    enough = (np.cumsum(copies[np.take_along_axis(best, order, axis=1)], axis=1) < k).sum(axis=1)
    return np.take_along_axis(np.take_along_axis(score, order, axis=1), enough[:, None], axis=1)[:, 0].astype(np.float64)


class Chunk:
    """Candidates of one chunk: numbers, outlines by level, ids of their copies."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray, copies: np.ndarray, own: np.ndarray):
        self.rows, self.ids, self.copies, self.own = rows, ids, copies, own
        self.starts = np.cumsum(copies) - copies
        self.length = float(np.sqrt((rows.astype(np.float64) ** 2).sum(axis=1)).max(initial=0))
        self.outlines = [outline(rows, n) for n in LEVELS]

    def search(self, queries: np.ndarray, floor: np.ndarray, number: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
        """(number, score, id, own) of each query's first k hits that reach its floor, ties by id.

        Each level keeps the candidates that some query can still reach, so the next one has fewer columns.
        """
        slack = 1e-9 * np.sqrt((queries.astype(np.float64) ** 2).sum(axis=1)) * self.length + 1e-6
        least = (floor - slack)[:, None]
        columns = np.arange(len(self.rows))
        for n, every in zip(LEVELS, self.outlines, strict=True):
            columns = columns[(outline(queries, n) @ every[columns].T >= least).any(axis=0)]
        score = products(queries, self.rows[columns])
        query, column = np.nonzero(score >= least)
        score, at = score[query, column], columns[column]
        n = self.copies[at]
        ids = self.ids[np.repeat(self.starts[at] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
        query, score, own = np.repeat(query, n), np.repeat(score, n), np.repeat(self.own[at], n)
        order = np.lexsort((ids, ~score, query))  # the complement turns a 64-bit order round
        query = query[order]
        first = np.searchsorted(query, query)
        order = order[np.arange(len(order)) - first < k]
        query = np.repeat(np.arange(len(queries)), np.minimum(np.bincount(query, minlength=len(queries)), k))
        return number[query], score[order], ids[order], own[order] == number[query]


def chunk_bits(places: int) -> int:
    """Vectors of a chunk, as a power of two, so that its numbers stay within CHUNK_BYTES."""
    return max(0, min(CHUNK_ROWS, CHUNK_BYTES // (8 * max(places, 1))).bit_length() - 1)


def distinct_vectors(rows: DataFrame, every: int, k: int) -> DataFrame:
    """number (from 0, in the order of places, code and vec), vec, places, ids (the k smallest), asked (some row is a query)."""
    first = rows.withColumn("nth", F.row_number().over(Window.partitionBy("vec").orderBy("vec_id"))).where(F.col("nth") <= k)
    each = first.groupBy("vec", "places", "code").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    asked = rows.where(F.col("vec_id") % every == 0).select("vec").distinct().withColumn("asked", F.lit(True))
    flagged = each.join(asked, "vec", "left").withColumn("asked", F.coalesce("asked", F.lit(False)))
    placed = ranked(flagged.withColumn("all", F.lit(0)), "all", ("places", "code", "vec"))
    return placed.select(F.col("rank").alias("number"), "vec", "places", "ids", "asked")


def chunks(vectors: DataFrame, k: int) -> DataFrame:
    """c (0, 1, ...), packed (candidates), queries (packed with their floors, null without any): stored, one row a chunk."""
    places = vectors.agg(F.max("places")).first()[0] or 0
    chunked = vectors.withColumn("c", F.shiftright("number", chunk_bits(places)).cast("int"))

    def pack(key, rows):
        rows = rows.sort_by("number")
        width = max(rows["places"].to_pylist())
        numbers = matrix(rows["vec"].to_pylist(), width)
        number = rows["number"].to_numpy()
        ids = [np.array(x, np.int64) for x in rows["ids"].to_pylist()]
        copies = np.array([len(x) for x in ids], np.int64)
        size = np.array([width], np.int64)
        asked = np.flatnonzero(rows["asked"].to_numpy())
        queries = None
        if len(asked):
            queries = pack_arrays(numbers[asked].ravel(), size, floors(numbers[asked], numbers, copies, k), number[asked])
        packed = pack_arrays(numbers.ravel(), size, np.concatenate(ids), copies, number)
        return pa.table({"c": pa.array([key[0].as_py()], pa.int32()), "packed": pa.array([packed], pa.binary()), "queries": pa.array([queries], pa.binary())})

    return stored(chunked.groupBy("c").applyInArrow(pack, "c int, packed binary, queries binary"), "vector-chunks")


def hits(packed: DataFrame, k: int) -> DataFrame:
    """number (of a distinct query), score, vec_id, own (the hit's vector is the query's): the first k of each chunk that reach the floor."""
    n = packed.count()
    slabs = -(-n // SLAB)

    def search(_, candidates, asked):
        out = []
        parts = [unpack_arrays(x.as_buffer()) for x in asked["queries"]]
        for body in candidates["packed"] if parts else []:
            numbers, size, ids, copies, own = unpack_arrays(body.as_buffer())
            places = max(int(size[0]), *(int(width[0]) for _, width, _, _ in parts))
            chunk = Chunk(widened(numbers, size, len(copies), places), ids, copies, own)
            for values, width, floor, number in parts:
                queries = widened(values, width, len(number), places)
                for a in range(0, len(number), BLOCK):
                    out.append(chunk.search(queries[a : a + BLOCK], floor[a : a + BLOCK], number[a : a + BLOCK], k))
        cols = [np.concatenate(x) for x in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 3 + [np.zeros(0, bool)]
        return pa.table([pa.array(c) for c in cols], names=["number", "score", "vec_id", "own"])

    candidates = packed.select("c", F.explode(F.sequence(F.lit(0), F.lit(max(slabs - 1, 0)))).alias("slab"), "packed")
    asked = packed.where("queries IS NOT NULL").select(
        F.explode(F.sequence(F.lit(0), F.lit(max(n - 1, 0)))).alias("c"), F.floor(F.col("c") / SLAB).cast("int").alias("slab"), "queries"
    )
    return candidates.groupBy("c", "slab").cogroup(asked.groupBy("c", "slab")).applyInArrow(search, "number long, score long, vec_id long, own boolean")


def without_own(found: Column, query: Column) -> Column:
    """The hits without the query's own row: one hit with its vector and its id."""
    at = F.array_position(F.transform(found, lambda h: h["own"] & (h["vec_id"] == query)), True).cast("int")
    return F.when(at > 0, F.concat(F.slice(found, F.lit(1), at - 1), F.slice(found, at + 1, F.size(found)))).otherwise(found)


def nearest(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", every: int = EVERY, k: int = K, scale: int = SCALE) -> DataFrame:
    """query_id, rank, vec_id, score: the k highest inner products of each row whose id `every` divides with all other rows.

    Ties go to the smaller id. Rows that repeat an id or a vector are rows of their own: each is a query, and a candidate to
    the others. Of vectors of unequal length the missing places count as 0. Null ids, null vectors and those with a
    component that is null, not finite or beyond 64 bits take no part; scores beyond 64 bits stay at the limit; a query alone
    has no hits; an empty table gives no rows. Other columns are not read.
    """
    read = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("x"))
    rows = stored(whole_numbers(read, scale), "whole-numbers")
    each = distinct_vectors(rows, every, k + 1)
    found = hits(chunks(each, k + 1), k + 1)
    order = Window.partitionBy("number").orderBy(F.desc("score"), "vec_id")
    best = found.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= k + 1)
    lists = best.groupBy("number").agg(F.sort_array(F.collect_list(F.struct("nth", "vec_id", "score", "own"))).alias("found"))
    queries = rows.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), "vec")
    answers = lists.join(each.where("asked").select("number", "vec"), "number").join(queries, "vec")
    kept = answers.select("query_id", F.slice(without_own(F.col("found"), F.col("query_id")), 1, k).alias("found"))
    return kept.select("query_id", F.posexplode("found").alias("at", "hit")).select(
        "query_id", (F.col("at") + 1).alias("rank"), "hit.vec_id", "hit.score"
    )


def op13_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 highest inner products of every embedding whose id 20 divides."""
    return nearest(table(spark, sf_dir, "embeddings"))


SQL = """
WITH v AS (
  SELECT vec_id, row_number() OVER () AS line, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (
  SELECT q.line, q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON q.line <> c.line WHERE q.vec_id % 20 = 0),
ranked AS (SELECT *, row_number() OVER (PARTITION BY line ORDER BY score DESC, vec_id) AS rank FROM pairs)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 20
"""
QUERIES = {"op13_top_k": op13_top_k}
ORACLES = {"op13_top_k": SQL}
