"""Benchmark decontamination by greedy string tiling.

Seeds are runs of `tile` words of a test item. Documents are scanned once: a bitmap of fixed size over all seeds (2 MiB,
whatever the benchmark's size) keeps the stretches that may match, everything else is never moved. The stretches' seeds
join the seed table; an item is a candidate by its rarest seeds only, as many as any sufficient coverage must touch, so a
phrase that all items share makes no pairs. Each candidate pair is tiled: the longest common runs of unmarked words are
marked again and again, found by running Karp-Rabin, until no run of `tile` words is left. An item whose marked words make
up `coverage` of all its words contaminates the document, in whatever order its passages stand.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pixsieve.llm.common import free_name, light, row_key, stored, table, text_key, whole_text
from pixsieve.llm.words import BASE, INVERSE, powers, room, shingles, slices, word_hashes

TILE = 5
COVERAGE = 0.5
BITS = 24


def bit_places(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - BITS)).astype(np.int64)


def item_words(items: DataFrame, id_col: str, text_col: str, tile: int) -> DataFrame:
    """Per item with words: key (of its id and text), item (its id), n words, k (its seeds' length: tile, or all words of a
    shorter item), words, seeds (as longs)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for a, b in slices(batch.column(2)):
                words, counts, _, _ = word_hashes(batch.column(2).slice(a, b - a), strip=True)
                ids = (batch.column(c).slice(a, b - a).to_pylist() for c in (0, 1))
                for key, i, to, n in zip(*ids, np.cumsum(counts), counts, strict=True):
                    if n:
                        own, k = words[to - n : to], min(tile, int(n))
                        seeds, _ = shingles(own, np.array([n]), k)
                        rows.append((key, i, int(n), k, own.tobytes(), seeds.view(np.int64).tolist()))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 6
            kinds = (pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["key", "item", "n", "k", "words", "seeds"])

    rows = items.select(F.col(id_col).cast("long").alias("item"), whole_text(text_col).alias("text"))
    keyed = rows.select(row_key("item", F.col("text")).alias("key"), "item", "text").dropDuplicates(["key"])
    return keyed.mapInArrow(light(run), "key binary, item long, n long, k int, words binary, seeds array<long>")


def bitmaps(seeds: DataFrame) -> dict[int, np.ndarray]:
    """Per seed length a bitmap of 2^BITS bits over the seeds: 2^(BITS-6) numbers at most reach the driver for each of `tile` lengths."""
    place = F.shiftrightunsigned("seed", 64 - BITS)
    words = seeds.groupBy("k", F.shiftright(place, 6).alias("at")).agg(F.expr(f"bit_or(shiftleft(1L, cast(shiftrightunsigned(seed, {64 - BITS}) % 64 as int)))").alias("bits"))
    found: dict[int, np.ndarray] = {}
    for k, at, bits in words.collect():
        found.setdefault(k, np.zeros(1 << (BITS - 6), np.int64))[at] = bits
    return {k: np.unpackbits(v.view(np.uint8), bitorder="little").view(bool) for k, v in found.items()}


def stretches(rows: DataFrame, maps: dict[int, np.ndarray]) -> DataFrame:
    """Per document with possible seeds: tag, words (numbers of the touched words, a zero between stretches), seeds (k, seed)."""
    packed = {k: np.packbits(v).tobytes() for k, v in maps.items()}
    spark_map = rows.sparkSession.sparkContext.broadcast(packed)  # at most `tile` maps of 2 MiB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = {k: np.frombuffer(v, np.uint8) for k, v in spark_map.value.items()}  # a bit stays a bit: 2 MiB each, not 16
        for batch in batches:
            out = []
            for a, b in slices(batch.column(1)):
                words, counts, _, _ = word_hashes(batch.column(1).slice(a, b - a), strip=True)
                touched = np.zeros(len(words), bool)
                found: list[tuple[int, np.ndarray, np.ndarray]] = []
                starts = np.cumsum(counts) - counts
                for k, bits in own.items():
                    h, per = shingles(words, counts, k)
                    place = bit_places(h)
                    hit = np.flatnonzero(bits[place >> 3] >> (7 - (place & 7)).astype(np.uint8) & 1)
                    ends = np.cumsum(per)
                    doc = np.searchsorted(ends, hit, "right")
                    at = starts[doc] + hit - (ends[doc] - per[doc])
                    for j in range(k):
                        touched[at + j] = True
                    found.append((k, doc, h[hit].view(np.int64)))
                docs = np.unique(np.concatenate([d for _, d, _ in found])) if found else []
                tags = batch.column(0).slice(a, b - a).to_pylist()
                for d in docs:
                    at = np.flatnonzero(touched[starts[d] : starts[d] + counts[d]])
                    breaks = np.flatnonzero(np.diff(at) > 1) + 1
                    run_words = np.insert(words[starts[d] + at], breaks, 0)
                    seeds = [{"k": k, "seed": s} for k, doc, h in found for s in np.unique(h[np.searchsorted(doc, d) : np.searchsorted(doc, d, "right")]).tolist()]
                    out.append((tags[d], run_words.tobytes(), seeds))
            cols = list(zip(*out, strict=True)) if out else [[]] * 3
            kinds = (pa.binary(), pa.binary(), pa.list_(pa.struct([("k", pa.int32()), ("seed", pa.int64())])))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["tag", "words", "seeds"])

    return rows.mapInArrow(light(run), "tag binary, words binary, seeds array<struct<k: int, seed: long>>")


class Runs:
    """Karp-Rabin numbers of all runs of some words, of any length, rolled by running sums."""

    def __init__(self, words: np.ndarray):
        size = room(len(words))
        self.words = words
        self.sums = np.zeros(len(words) + 1, np.uint64)
        np.cumsum(words * powers(BASE, size)[: len(words)], out=self.sums[1:])
        self.back = powers(INVERSE, size)[: len(words) + 1]

    def free(self, marked: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        """(places, numbers) of the runs of this length without a marked word, by place."""
        blocked = np.zeros(len(marked) + 1, np.int64)
        np.cumsum(marked, out=blocked[1:])
        at = np.flatnonzero(blocked[length:] == blocked[: len(blocked) - length])
        return at, (self.sums[at + length] - self.sums[at]) * self.back[at]


def tiles(pattern: np.ndarray, text: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling: (place in pattern, place in text, length), longest first, none shorter than least.

    Again and again the longest common run of unmarked words is marked, of equal ones the first in the pattern, then in the
    text. Where a run is common its shorter parts are, so the greatest length is found by halving, each step linear in the
    words; all matches of that length are marked in one pass, since a run once marked stays so. Numbers 0 break the text.
    The lengths of the tiles add up to the pattern's at most, so there are no more different ones than about the square root of
    twice that.
    """
    if min(len(pattern), len(text)) < least:
        return []
    runs_p, runs_t = Runs(pattern), Runs(text)
    mark_p, mark_t = np.zeros(len(pattern), bool), text == 0
    out: list[tuple[int, int, int]] = []

    def common(length: int) -> bool:
        return bool(np.isin(runs_p.free(mark_p, length)[1], runs_t.free(mark_t, length)[1]).any())

    bound = min(len(pattern), len(text))
    while bound >= least and common(least):
        low, high, step = least, bound, least
        while low < high:  # doubling first: most matches are short beside the text
            at = min(high, low + step) if step else (low + high + 1) // 2
            if common(at):
                low, step = at, 2 * step
            else:
                high, step = at - 1, 0
        out += marked_matches(runs_p, mark_p, runs_t, mark_t, low)
        bound = low - 1
    return out


def marked_matches(runs_p: Runs, mark_p: np.ndarray, runs_t: Runs, mark_t: np.ndarray, length: int) -> list[tuple[int, int, int]]:
    """Marks the matches of this length one after the other, by place in the pattern, then in the text, until none is left."""
    at_t, numbers_t = runs_t.free(mark_t, length)
    at_p, numbers_p = runs_p.free(mark_p, length)
    order = np.argsort(numbers_t, kind="stable")
    numbers_t, at_t = numbers_t[order], at_t[order]
    first, last = np.searchsorted(numbers_t, numbers_p, "left"), np.searchsorted(numbers_t, numbers_p, "right")
    there = np.flatnonzero(first < last)
    out, next_of, free_from = [], {}, 0
    for p, a, b in zip(at_p[there].tolist(), first[there].tolist(), last[there].tolist(), strict=True):
        if p < free_from:
            continue
        own = next_of.get(a, a)  # places before it are marked for good
        while own < b and mark_t[at_t[own] : at_t[own] + length].any():
            own += 1
        next_of[a] = own
        for k in range(own, b):
            t = int(at_t[k])
            if not mark_t[t : t + length].any() and np.array_equal(runs_p.words[p : p + length], runs_t.words[t : t + length]):
                mark_p[p : p + length] = mark_t[t : t + length] = True
                out.append((p, t, length))
                free_from = p + length
                break
    return out


def matches(docs: DataFrame, items: DataFrame, text_col: str, item_id: str, item_text: str, tile: int, coverage: float) -> DataFrame:
    """Pairs of a text (tag: its key) and an item it covers: tag, item, coverage, n_tiles. Equal texts are one."""
    words = stored(item_words(items, item_id, item_text, tile), "item-words")
    seeds = words.select("key", "n", "k", F.explode("seeds").alias("seed")).distinct()
    maps = bitmaps(seeds)
    hits = stretches(docs.select(text_key(whole_text(text_col)).alias("tag"), whole_text(text_col).alias("text")), maps)
    hits = stored(hits.groupBy("tag").agg(F.first("words").alias("words"), F.first("seeds").alias("seeds")), "stretches")
    # an item's coverage needs n * coverage words in tiles, and a tile of any length has a seed for every k words at least:
    # so many of its distinct seeds must be met that all but the rarest may be left out as a start
    often = seeds.groupBy("k", "seed").agg(F.count("*").alias("often"))
    own = seeds.groupBy("key").agg(F.count("*").alias("own"))
    rank = F.row_number().over(Window.partitionBy("key").orderBy("often", "seed"))
    start = seeds.join(often, ["k", "seed"]).join(own, "key").withColumn("rank", rank)
    # repeated words make fewer distinct seeds: with repeats every seed may start
    repeats = F.col("own") < F.col("n") - F.col("k") + 1
    start = start.where(repeats | (F.col("rank") <= F.col("own") - F.greatest(F.lit(1), F.ceil(F.col("n") * coverage / F.col("k") - 1e-9)) + 1))
    pairs = hits.select("tag", F.explode("seeds").alias("s")).select("tag", "s.k", "s.seed").join(start.select("k", "seed", "key"), ["k", "seed"]).select("tag", "key").distinct()
    joined = pairs.join(hits.select("tag", F.col("words").alias("text")), "tag").join(words.select("key", "item", "n", "k", F.col("words").alias("pattern")), "key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names
            cols = [batch.column(names.index(c)).to_pylist() for c in ("tag", "item", "n", "k", "text", "pattern")]
            out = []
            for t, item, n, k, text, pattern in zip(*cols, strict=True):
                found = tiles(np.frombuffer(pattern, np.uint64), np.frombuffer(text, np.uint64), k)
                out.append((t, item, sum(x[2] for x in found) / n, len(found)))
            by_column = list(zip(*out, strict=True)) if out else [[]] * 4
            kinds = (pa.binary(), pa.int64(), pa.float64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(by_column, kinds, strict=True)], names=["tag", "item", "coverage", "n_tiles"])

    return joined.mapInArrow(light(run), "tag binary, item long, coverage double, n_tiles long").where(F.col("coverage") >= coverage - 1e-9)


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", tile: int = TILE, coverage: float = COVERAGE) -> DataFrame:
    """One row per document: doc_id, contaminated, coverage (of its best item, 0 without), n_items, items (ascending ids).

    Words are compared without case (A to Z) and ASCII punctuation. Null and empty texts are clean; items without words
    match nothing; those without an id count as one item, which the list does not name; items of fewer than `tile` words must stand as a whole; repeated rows each get their own; an empty
    table on either side gives clean rows or none. Other columns are not read.
    """
    found = matches(docs, items, text_col, item_id, item_text, tile, coverage)
    per = found.groupBy("tag").agg(F.max("coverage").alias("coverage"), F.countDistinct(F.coalesce(F.col("item").cast("string"), F.lit(""))).alias("n_items"), F.sort_array(F.collect_set("item")).alias("items"))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_key(whole_text(text_col)).alias("tag")).join(per, "tag", "left").select(
        "doc_id", F.col("n_items").isNotNull().alias("contaminated"), F.coalesce("coverage", F.lit(0.0)).alias("coverage"),
        F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"), F.coalesce("items", F.array().cast("array<long>")).alias("items"),
    )


def clean(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", tile: int = TILE, coverage: float = COVERAGE) -> DataFrame:
    """The documents that no item contaminates, with all their columns."""
    tag = free_name(docs, "text_key")
    found = matches(docs, items, text_col, item_id, item_text, tile, coverage).select(F.col("tag").alias(tag)).distinct()
    return docs.withColumn(tag, text_key(whole_text(text_col))).join(found, tag, "left_anti").drop(tag)


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document against every benchmark item."""
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {"op10_decontaminate": op10_decontaminate}
ORACLES: dict[str, str] = {}
