"""Quality by an interpolated modified Kneser-Ney model of trusted text.

Symbols are whole code points, whatever the script, and a break at the ends of a text. Runs of ORDER symbols are counted
over all trusted documents; every lower order has continuation counts. Counts, context totals and counts of counts are
grouped and joined as tables of the whole runs; only discounts reach the driver. To score, blocks of documents ask shards
for the runs they hold (see blocks), of 1 to ORDER symbols and by 64-bit numbers; a shard answers with a run's discounted
share and with its weight as a context, and the block puts them together. A document is kept between two quantiles of the
trusted documents of its language, a fifth of which the model does not see for that purpose: above lies junk, below lies
text that repeats itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixsieve.bitmaps import may_hold
from pixsieve.llm.blocks import MESSAGE, blocks_for, by_shard, messages, pack_arrays, packed_rows, shard_bits, unpack_arrays, unpacked
from pixsieve.llm.common import light, light_cogroup, light_group, remainder, stored, table, whole_text
from pixsieve.llm.words import BASE, bytes_of, mixed, slices

ORDER = 4
LOW, HIGH = 0.002, 0.995
BLOCK_BYTES = 6 << 20
#: A symbol is a code point and one, 0 is the break; ORDER - 1 symbols fit a 64-bit number.
BITS = 21
MASK = (1 << BITS) - 1
SYMBOLS = 0x110000 + 1


def code_points(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The symbols of all texts, and how many each has."""
    body, offsets = bytes_of(texts)
    if not (body & 0x80).any():
        return body.astype(np.int32) + 1, np.diff(offsets)
    lead = np.flatnonzero((body & 0xC0) != 0x80)
    code = body[lead].astype(np.int32)
    wide = np.flatnonzero(code >= 0x80)
    size = np.append(lead[1:], len(body))[wide] - lead[wide]
    code[wide] &= np.where(code[wide] < 0xE0, 0x1F, np.where(code[wide] < 0xF0, 0x0F, 0x07))
    for j in (1, 2, 3):
        more = wide[size > j]
        code[more] = code[more] << 6 | body[lead[more] + j] & 0x3F
    return np.minimum(code, 0x10FFFF) + 1, np.diff(np.searchsorted(lead, offsets))


def ranked(codes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct codes, which lie below size, ascending, and where each code is among them. They are marked in a table, unless
    that would be much longer than the codes; then they are sorted."""
    if size > max(1 << 16, 4 * len(codes)):
        return np.unique(codes, return_inverse=True)
    seen = np.zeros(size, bool)
    seen[codes] = True
    return np.flatnonzero(seen), (np.cumsum(seen, dtype=np.int32) - np.int32(1))[codes]


def symbol_runs(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The distinct runs of ORDER symbols, as a number of the first ones and the last; which of them ends at each symbol of each
    text (breaks stand before a text and once after it); and how many symbols each text has.

    Runs of k symbols are numbered, and such a number with the next symbol is the code of a run of k + 1."""
    symbols, n = code_points(texts)
    breaks = ORDER - 1
    begins = np.cumsum(n) - n + np.arange(len(n)) * ORDER
    ending = np.ones(len(symbols) + len(n) * ORDER, bool)  # ORDER - 1 breaks before each text, one behind it
    for j in range(breaks):
        ending[begins + j] = False
    inner = ending.copy()
    inner[begins + breaks + n] = False
    laid = np.zeros(len(inner), np.int32)
    laid[inner] = symbols
    known, symbol = ranked(laid, int(laid.max(initial=0)) + 1)
    known = known.astype(np.int64)
    context, last, number = np.zeros(len(known), np.int64), known, symbol
    for k in range(2, ORDER + 1):
        context = context << BITS | last
        size = len(context) * len(known)
        code = number[:-1].astype(np.int32 if size < 1 << 31 else np.int64) * len(known) + symbol[k - 1 :]
        found, number = ranked(code[ending[breaks:]] if k == ORDER else code, size)
        before, at = np.divmod(found, max(1, len(known)))
        context, last = context[before], known[at]
    return context, last, number.astype(np.int32), n + 1


def numbered(k: int, context: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The 64-bit number of a run of k symbols: k - 1 and the last."""
    return mixed(mixed(context.astype(np.uint64) + np.uint64(k * BASE % (1 << 64))) * np.uint64(BASE) + last.astype(np.uint64))


def run_counts(texts: DataFrame) -> DataFrame:
    """context, last, n over all texts of the one column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column(0), 4 << 20):
                context, last, where, _ = symbol_runs(batch.column(0).slice(a, b - a))
                yield pa.RecordBatch.from_arrays([pa.array(context), pa.array(last), pa.array(np.bincount(where))], names=["context", "last", "n"])

    return texts.mapInArrow(light(run), "context long, last long, n long").groupBy("context", "last").agg(F.sum("n").alias("n"))


def discounts(counts: DataFrame) -> tuple[float, float, float]:
    """D1, D2, D3+ of modified Kneser-Ney from the counts of counts."""
    row = counts.agg(*(F.sum(F.when(F.col("n") == k, 1).otherwise(0)).alias(f"n{k}") for k in (1, 2, 3, 4))).first()
    n1, n2, n3, n4 = (float(x or 0) for x in row)
    if not n1 or not n2:
        return 0.5, 0.75, 0.75  # too little text for an estimate
    y = n1 / (n1 + 2 * n2)
    d = 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 1.5
    return tuple(min(max(x, 0.05), k + 0.95) for k, x in enumerate(d))


def kneser_ney(counts: DataFrame) -> list[tuple[DataFrame, DataFrame]]:
    """Per order from 1 up: (context, last, part) with the discounted share, and (context, weight) of the lower order."""
    orders = []
    level = stored(counts, "runs-of-all")
    for order in range(ORDER, 0, -1):
        d1, d2, d3 = discounts(level)
        cut = F.when(F.col("n") == 1, d1).when(F.col("n") == 2, d2).otherwise(d3)
        totals = level.groupBy("context").agg(F.sum("n").alias("total"), F.sum(cut).alias("held"))
        parts = level.join(totals, "context").select("context", "last", ((F.col("n") - cut) / F.col("total")).alias("part"))
        orders.append((parts, totals.select("context", (F.col("held") / F.col("total")).alias("weight"))))
        if order > 1:
            lower = F.col("context").bitwiseAND(F.lit((1 << (BITS * (order - 2))) - 1))
            level = stored(level.groupBy(lower.alias("context"), "last").agg(F.count("*").alias("n")), f"runs-of-{order - 1}")
    return orders[::-1]


def log_table(orders: list[tuple[DataFrame, DataFrame]]) -> np.ndarray:
    """A small model whole, to look at: after each context met, ln P of up to 63 symbols and, as the 64th, of all others."""
    parts = [{(r.context, r.last): r.part for r in x.collect()} for x, _ in orders]
    weights = [{r.context: r.weight for r in x.collect()} for _, x in orders]
    known = sorted({last for _, last in parts[0]})
    if len(known) > 63:
        raise ValueError("more than 63 symbols")
    out = []
    for context in sorted(weights[-1]):
        p = np.zeros(64)
        p[: len(known)], p[63] = 1 / SYMBOLS, 1 - len(known) / SYMBOLS
        for k in range(ORDER):
            own = context & ((1 << (BITS * k)) - 1)
            p *= weights[k].get(own, 1.0)
            p[: len(known)] += [parts[k].get((own, s), 0.0) for s in known]
        out.append(p)
    return np.log(np.maximum(np.concatenate(out), 1e-12))


def model_rows(orders: list[tuple[DataFrame, DataFrame]], bits: int) -> DataFrame:
    """shard, h, context, value: the shares of all runs by their number, and the weights of those that are contexts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k, context, last = (batch.column(c).to_numpy() for c in range(3))
            h = np.zeros(len(k), np.uint64)
            for own in np.unique(k):
                h[k == own] = numbered(int(own), context[k == own], last[k == own])
            shard = (h >> np.uint64(64 - bits)).astype(np.int32) if bits else np.zeros(len(h), np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(shard), pa.array(h.view(np.int64)), batch.column(3), batch.column(4)], names=["shard", "h", "context", "value"])

    rows = None
    for k, (parts, weights) in enumerate(orders, 1):
        both = parts.select(F.lit(k).cast("long").alias("k"), "context", "last", F.lit(False).alias("as_context"), F.col("part").alias("value"))
        if k > 1:  # the one weight of order 1 is the driver's
            of = F.shiftright("context", BITS), F.col("context").bitwiseAND(F.lit(MASK))
            both = both.union(weights.select(F.lit(k - 1).cast("long"), *of, F.lit(True), "weight"))
        rows = both if rows is None else rows.union(both)
    return rows.mapInArrow(light(run), "shard int, h long, context boolean, value double")


class Runs:
    """The distinct runs of a block's texts, their numbers by length, and those of their contexts."""

    def __init__(self, rows: pa.Table):
        context, last, number, sizes = [], [], [], []
        for chunk in rows["text"].chunks:
            for a, b in slices(chunk):
                c, x, where, n = symbol_runs(chunk.slice(a, b - a))
                context.append(c)
                last.append(x)
                number.append((numbered(ORDER, c, x), where))
                sizes.append(n)
        h, at = np.unique(np.concatenate([x for x, _ in number]), return_index=True)
        context, last = np.concatenate(context)[at], np.concatenate(last)[at]
        self.where = np.concatenate([np.searchsorted(h, own).astype(np.int32)[where] for own, where in number])
        self.sizes = np.concatenate(sizes)
        low = lambda k: context & ((1 << (BITS * k)) - 1)
        self.runs = [numbered(k, low(k - 1), last) for k in range(1, ORDER + 1)]
        self.contexts = [numbered(k, low(k) >> BITS, context & MASK) for k in range(1, ORDER)]
        self.keys = np.unique(np.concatenate([*self.runs, *self.contexts]))


def ask(bits: int):
    """Blocks: the numbers of all runs and contexts that their texts hold."""

    def run(key, part):
        keys = Runs(unpacked(part["packed"])).keys
        return messages([(s, key[0].as_py(), pack_arrays(keys[a:b])) for s, a, b in by_shard(keys, bits)])

    return run


def answer(key, asked, model):
    """Shards: to each block its runs' shares (0 if the model has none) and their weights as contexts (1 if none)."""
    if not asked.num_rows:
        return messages([])
    h, kind, value = model["h"].to_numpy().view(np.uint64), model["context"].to_numpy().astype(bool), model["value"].to_numpy()
    order = np.argsort(h)
    sides = [(h[own], value[own], missing) for own, missing in ((order[~kind[order]], 0.0), (order[kind[order]], 1.0))]
    out = []
    for block, packed in zip(asked["block"].to_pylist(), asked["packed"], strict=True):
        keys, reply = unpack_arrays(packed.as_buffer())[0], []
        for known, values, missing in sides:
            if len(known):
                at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
                reply.append(np.where(known[at] == keys, values[at], missing).astype(np.float32))
            else:
                reply.append(np.full(len(keys), missing, np.float32))
        out.append((key[0].as_py(), block, pack_arrays(*reply)))
    return messages(out)


SCORED = "doc_id long, lang string, n_symbols long, perplexity double"


def score_block(bits: int, weight: float):
    """A block's rows; weight is what order 1 leaves to any symbol."""

    def run(key, part, replies):
        rows = unpacked(part["packed"])
        runs = Runs(rows)
        got = dict(zip(replies["shard"].to_pylist(), replies["packed"], strict=True))
        found = [unpack_arrays(got[s].as_buffer()) for s, _, _ in by_shard(runs.keys, bits)]
        share, left = (np.concatenate([x[k] for x in found]).astype(np.float64) for k in (0, 1))
        p = np.full(len(runs.runs[0]), 1 / SYMBOLS)
        for k, own in enumerate(runs.runs):
            p *= left[np.searchsorted(runs.keys, runs.contexts[k - 1])] if k else weight
            p += share[np.searchsorted(runs.keys, own)]
        n = runs.sizes
        sums = np.add.reduceat(np.log(p)[runs.where], np.cumsum(n) - n)
        return pa.table([rows["id"], rows["lang"], pa.array(n, pa.int64()), pa.array(np.exp(-sums / n))], names=[x.split()[0] for x in SCORED.split(", ")])

    return run


def perplexities(docs: DataFrame, orders: list[tuple[DataFrame, DataFrame]], id_col: str, text_col: str, lang_col: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, lang, n_symbols, perplexity."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(lang_col).cast("string").alias("lang"), whole_text(text_col).alias("text"))
    blocks = blocks_for(rows, F.col("text"), block_bytes)
    bits = shard_bits(blocks)
    packed = packed_rows(rows, blocks, F.struct("id", "text"))
    first = orders[0][1].first()
    # asked and scored in one job: both read the blocks from one exchange, so the texts stand on disk once
    asked = packed.groupBy("block").applyInArrow(light_group(ask(bits)), MESSAGE)
    model = model_rows(orders, bits)
    replies = asked.groupBy("shard").cogroup(model.groupBy("shard")).applyInArrow(light_cogroup(answer), MESSAGE)
    return packed.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(light_cogroup(score_block(bits, first.weight if first else 1.0)), SCORED)


def judged(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", label_col: str = "quality", low: float = LOW, high: float = HIGH) -> DataFrame:
    """One row per document: doc_id, lang, n_symbols, perplexity, lower, upper, keep. Trusted are the ids with label 1;
    those whose remainder is 0 set the quantiles, the others train the model.

    Null and empty texts have one symbol, the end; a language without trusted documents is judged by the quantiles of all
    trusted ones, a null language is a language of its own; without any trusted document all are kept. Labels that are
    null or of null ids are not used, several labels of an id must all be 1. Repeated rows stay; empty tables give no rows;
    other columns are not read.
    """
    marks = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("label_id")).agg(F.min(F.col(label_col).cast("int")).alias("label"))
    trusted = marks.where("label = 1").select("label_id")
    fifth = remainder("label_id") == 0  # kept out of the model, for the quantiles
    # a bitmap of fixed size over the ids leaves most other texts where they are; the join behind it, whose sides both grow
    # with the corpus, is a merge at every size
    texts = docs.select(F.col(id_col).cast("long").alias("label_id"), whole_text(text_col).alias("text")).where(~fifth)
    texts = may_hold(texts, F.xxhash64("label_id"), trusted.select(F.xxhash64("label_id").alias("h"))).where("__may").drop("__may")
    texts = texts.join(trusted.hint("merge"), "label_id", "left_semi").select("text")
    scored = stored(perplexities(docs, kneser_ney(run_counts(texts)), id_col, text_col, lang_col), "perplexities")
    known = scored.join(trusted, F.col("doc_id") == F.col("label_id"), "left_semi")
    fresh = F.when(remainder("doc_id") == 0, F.col("perplexity"))
    # text the model has seen lies lower than its like: the lower bound is set by all, the upper by the fifth not seen
    bounds = (F.percentile_approx("perplexity", low, 10_000).alias("low"), F.percentile_approx(fresh, high, 10_000).alias("high"))
    by_lang = known.groupBy("lang").agg(*bounds).select(F.col("lang").alias("of"), "low", "high")
    low_all, high_all = known.agg(*bounds).first()
    joined = scored.join(by_lang, F.col("lang").eqNullSafe(F.col("of")), "left")
    lower = F.coalesce("low", F.lit(0.0 if low_all is None else low_all))
    upper = F.coalesce("high", F.lit(float("inf") if high_all is None else high_all))
    return joined.select("doc_id", "lang", "n_symbols", "perplexity", lower.alias("lower"), upper.alias("upper"), F.col("perplexity").between(lower, upper).alias("keep"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's perplexity under the model of trusted text, and whether it is kept."""
    return judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {"op8_quality": op8_quality}
ORACLES: dict[str, str] = {}
