"""Near-duplicate documents by Order MinHash, verified by banded alignment.

Five-word shingles are labelled with their occurrence number. A sketch takes the `picked` smallest labelled shingles under
its own hash and keeps them in text order, so two texts share a sketch with a probability that falls with their edit
distance. Texts that share a sketch are compared with the one of them that shares most in all, never all with all; those that turn
out unlike it are compared with what exact bounds (lengths, shingles that no other text has, the triangle inequality of the indel
distance, shingle histograms) leave of the others, so that no link is lost. A comparison aligns the two shingle sequences in a band just wide enough for
the threshold: matched shingles over all distinct ones must reach it. Classes are the connected components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pixsieve.llm.common import free_name, light, one_row_each, row_key, stored, table, text_key, whole_text
from pixsieve.llm.components import components
from pixsieve.llm.words import mixed, shingles, slices, word_hashes

SHINGLE = 5
SIMILARITY = 0.8
SKETCHES, PICKED = 24, 5
#: Texts of few shingles also get sketches of two, which a missing shingle spoils less often.
SHORT, SHORT_SKETCHES, SHORT_PICKED = 16, 12, 2
#: Bins of the shingle histograms that bound a pair's matches.
COARSE, BINS = 32, 512
SKETCH_ROWS = "sketch int, key long, tag binary, n int"


def labelled(h: np.ndarray, per: np.ndarray) -> np.ndarray:
    """Shingle numbers told apart by their occurrence within the text."""
    doc = np.repeat(np.arange(len(per)), per)
    order = np.argsort(h ^ mixed(doc.astype(np.uint64)), kind="stable")
    same = np.concatenate([[False], (h[order][1:] == h[order][:-1]) & (doc[order][1:] == doc[order][:-1])]) if len(h) else np.zeros(0, bool)
    if not same.any():
        return h
    at = np.arange(len(h))
    begin = np.maximum.accumulate(np.where(same, 0, at))
    times = np.empty(len(h), np.uint64)
    times[order] = (at - begin).astype(np.uint64)
    return np.where(times > 0, mixed(h + times * np.uint64(0x9E3779B97F4A7C15)), h)


def sketch_keys(own: np.ndarray, salts: np.ndarray, picked: int) -> np.ndarray:
    """One number per salt: the picked smallest labelled shingles in text order."""
    n = len(own)
    if n <= picked:
        at = np.broadcast_to(np.arange(n), (len(salts), n))
    else:
        # multiplying by an odd salt and mixing once is a hash of its own for each sketch
        h = own[None, :] * salts[:, None]
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        at = np.sort(np.argpartition(h, picked - 1, axis=1)[:, :picked], axis=1)
    key = salts.copy()
    for j in range(at.shape[1]):
        key = mixed(key * np.uint64(31) + own[at[:, j]])
    return key


def salts_of(n: int, first: int) -> np.ndarray:
    return mixed(np.arange(first, first + n, dtype=np.uint64) + np.uint64(0x51ED)) | np.uint64(1)


def sketches(rows: DataFrame) -> DataFrame:
    """From (tag, text), tag naming the text: a row per sketch."""
    salts, short_salts = salts_of(SKETCHES, 1), salts_of(SHORT_SKETCHES, 1000)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column(1)):
                words, counts, _, _ = word_hashes(batch.column(1).slice(a, b - a))
                h, per = shingles(words, counts, SHINGLE, short=True)
                marked = labelled(h, per)
                ends = np.cumsum(per)
                tags = batch.column(0).slice(a, b - a)
                keys, numbers, at = [], [], []
                for d in np.flatnonzero(per):
                    own = marked[ends[d] - per[d] : ends[d]]
                    keys.append(sketch_keys(own, salts, PICKED))
                    numbers.append(np.arange(SKETCHES))
                    if per[d] < SHORT:
                        keys.append(sketch_keys(own, short_salts, SHORT_PICKED))
                        numbers.append(np.arange(SKETCHES, SKETCHES + SHORT_SKETCHES))
                    at.append(np.full(SKETCHES + (SHORT_SKETCHES if per[d] < SHORT else 0), d))
                key = np.concatenate(keys) if keys else np.zeros(0, np.uint64)
                number = np.concatenate(numbers) if keys else np.zeros(0, np.int64)
                doc = np.concatenate(at).astype(np.int64) if keys else np.zeros(0, np.int64)
                columns = [pa.array(number, pa.int32()), pa.array(key.view(np.int64)), tags.take(pa.array(doc)), pa.array(per[doc], pa.int32())]
                yield pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in SKETCH_ROWS.split(", ")])

    return rows.select("tag", "text").mapInArrow(light(run), SKETCH_ROWS)


def least_matches(n1: int, n2: int, similarity: float) -> int:
    """Matched shingles that a pair of n1 and n2 needs: m / (n1 + n2 - m) >= similarity."""
    return int(np.ceil(similarity * (n1 + n2) / (1 + similarity) - 1e-9))


def aligned(a: np.ndarray, b: np.ndarray, band: int | None) -> int:
    """Length of the longest common subsequence of two sequences, of matches at most `band` places apart if one is given.

    Common ends are stripped; in between one machine word holds 64 cells of a row (a column of b per bit), rows are added.
    """
    n = min(len(a), len(b))
    ahead = int(np.argmin(np.append(a[:n] == b[:n], False)))
    a, b, n = a[ahead:], b[ahead:], n - ahead
    behind = int(np.argmin(np.append(a[len(a) - n :][::-1] == b[len(b) - n :][::-1], False)))
    a, b = a[: len(a) - behind].tolist(), b[: len(b) - behind].tolist()
    if not a or not b:
        return ahead + behind
    masks: dict[int, int] = {}
    for j, x in enumerate(b):
        masks[x] = masks.get(x, 0) | 1 << j
    full = (1 << len(b)) - 1
    window = None if band is None or band >= max(len(a), len(b)) else (1 << (2 * band + 1)) - 1
    row = full
    for i, x in enumerate(a):
        m = masks.get(x, 0)
        if m and window is not None:
            m &= window << (i - band) if i >= band else window >> (band - i)
        if m:
            u = row & m
            row = ((row + u) | (row - u)) & full
    return ahead + behind + len(b) - row.bit_count()


def compared(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """From pairs (a, b) and texts (tag, text): a, b, distance (indel distance of the shingle sequences), alike."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names
            left, right = batch.column(names.index("text_a")), batch.column(names.index("text_b"))
            rows = []
            for x, y in zip(numbers(left), numbers(right), strict=True):
                need = least_matches(len(x), len(y), similarity)
                m = aligned(x, y, max(len(x), len(y)) - need)
                alike = m >= need
                if not alike:
                    m = aligned(x, y, None)  # the exact distance, for the triangle inequality
                rows.append((len(x) + len(y) - 2 * m, alike))
            distance, alike = zip(*rows, strict=True) if rows else ([], [])
            columns = [batch.column(names.index("a")), batch.column(names.index("b")), pa.array(distance, pa.int64()), pa.array(alike, pa.bool_())]
            yield pa.RecordBatch.from_arrays(columns, names=["a", "b", "distance", "alike"])

    left = texts.select(F.col("tag").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("tag").alias("b"), F.col("text").alias("text_b"))
    joined = pairs.select("a", "b").join(right, "b").join(left, "a")
    return joined.mapInArrow(light(run), "a binary, b binary, distance long, alike boolean")


def numbers(texts: pa.Array) -> list[np.ndarray]:
    """Shingle numbers of each text, in text order."""
    out = []
    for a, b in slices(texts):
        words, counts, _, _ = word_hashes(texts.slice(a, b - a))
        h, per = shingles(words, counts, SHINGLE, short=True)
        out.extend(np.split(h, np.cumsum(per)[:-1]))
    return out


def links(rows: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """Verified links (a, b) between different texts, from (tag, text), tag naming the text.

    Every pair of one sketch is linked directly, or through texts that it is linked with, or shown to be unlike.
    """
    member = stored(sketches(rows).groupBy("sketch", "key", "tag").agg(F.min("n").alias("n")), "members")
    bucket = member.groupBy("sketch", "key").agg(F.count("*").alias("held")).where("held > 1")
    shared = stored(member.join(bucket, ["sketch", "key"]), "shared-sketches")
    # the head of a sketch is the text that shares most over all its sketches: the original of edited copies, if it is there
    fame = shared.groupBy("tag").agg(F.sum("held").alias("fame"))
    heads = shared.join(fame, "tag").groupBy("sketch", "key").agg(F.max(F.struct("fame", "tag", "n")).alias("head"))
    starred = shared.join(heads, ["sketch", "key"]).where("tag <> head.tag")
    starred = stored(starred.select("sketch", "key", "tag", "n", F.col("head.tag").alias("head"), F.col("head.n").alias("head_n")), "starred")
    fits = F.least("n", "head_n") >= F.lit(similarity - 1e-9) * F.greatest("n", "head_n")
    first = starred.where(fits).select(F.col("head").alias("a"), F.col("tag").alias("b")).distinct()
    involved = starred.select("tag").union(starred.select("head")).distinct()
    # copies are merged where they are scanned, so that a text with very many meets the join once a task
    merged = rows.groupBy("tag").agg(F.first("text").alias("text"))
    texts = stored(merged.join(involved, "tag", "left_semi"), "near-texts")
    seen = stored(compared(first, texts, similarity), "compared")
    # what is unlike its head may be like another member of the sketch
    known = seen.select(F.col("a").alias("head"), F.col("b").alias("tag"), "distance", "alike")
    judged = starred.join(known, ["head", "tag"], "left").select(
        "sketch", "key", "tag", "n", F.coalesce("alike", F.lit(False)).alias("alike"),
        # without a comparison the difference in length is the least distance, the sum the largest
        F.coalesce("distance", F.abs(F.col("n") - F.col("head_n")).cast("long")).alias("nearest"),
        F.coalesce("distance", (F.col("n") + F.col("head_n")).cast("long")).alias("farthest"),
    )
    judged = stored(judged, "judged")
    astray = judged.groupBy("sketch", "key").agg(F.bool_or(~F.col("alike")).alias("some"), F.min("n").alias("least_n")).where("some").drop("some")
    open_sketches = judged.join(astray, ["sketch", "key"], "left_semi").select("tag").distinct()
    open_texts = texts.join(open_sketches, "tag", "left_semi")
    lone = stored(lone_shingles(open_texts), "lone-shingles")
    # a shingle that no other text of these sketches has matches nothing: what is left must do
    usable = judged.join(lone, "tag", "left").withColumn("usable", F.col("n") - F.coalesce("lone", F.lit(0)))
    share = F.lit(similarity / (1 + similarity))
    enough = lambda usable, n, other: F.col(usable) >= share * (F.col(n) + F.col(other)) - 1e-6
    members = usable.join(astray, ["sketch", "key"]).where(enough("usable", "n", "least_n") & (F.col("usable") >= F.lit(similarity - 1e-9) * F.col("n")))
    members = stored(members.drop("least_n", "lone").join(histograms(open_texts), "tag"), "open-members")
    stray = members.where("NOT alike").select("sketch", "key", *(F.col(c).alias(f"s_{c}") for c in ("tag", "n", "nearest", "farthest", "usable", "coarse", "bins")))
    at_most = lambda c: F.aggregate(F.zip_with(c, f"s_{c}", lambda x, y: F.least(x, y)), F.lit(0), lambda total, x: total + x)
    need = share * (F.col("n") + F.col("s_n")) - 1e-6
    gap = F.greatest(F.col("s_nearest") - F.col("farthest"), F.col("nearest") - F.col("s_farthest"))
    room = (F.col("n") + F.col("s_n")) * F.lit((1 - similarity) / (1 + similarity)) + 1e-6
    more = stray.join(members, ["sketch", "key"]).where(
        (F.col("tag") != F.col("s_tag")) & (F.col("alike") | (F.col("tag") > F.col("s_tag")))
        & (F.least("n", "s_n") >= F.lit(similarity - 1e-9) * F.greatest("n", "s_n")) & (gap <= room)
        & enough("usable", "n", "s_n") & enough("s_usable", "n", "s_n")
        # the dearer a bound, the later
        & F.when(enough("usable", "n", "s_n") & enough("s_usable", "n", "s_n") & (gap <= room), F.when(at_most("coarse") >= need, at_most("bins") >= need)).eqNullSafe(True)
    )
    more = more.select(F.least("tag", "s_tag").alias("a"), F.greatest("tag", "s_tag").alias("b")).distinct()
    linked = components(seen.where("alike"), "first-classes")
    of = lambda side: linked.select(F.col("node").alias(side), F.col("label").alias(f"{side}_label"))
    open_pairs = more.join(of("a"), "a", "left").join(of("b"), "b", "left").where(F.coalesce("a_label", "a") != F.coalesce("b_label", "b")).select("a", "b")
    late = compared(stored(open_pairs, "possible"), texts, similarity)
    return stored(seen.where("alike").select("a", "b").union(late.where("alike").select("a", "b")), "links")


def lone_shingles(texts: DataFrame) -> DataFrame:
    """From different texts (tag, text): tag, lone (how many of a text's shingles stand in no other of them)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, own in enumerate(numbers(batch.column(1))):
                h, n = np.unique(own, return_counts=True)
                tags = batch.column(0).take(pa.array(np.full(len(h), k)))
                yield pa.RecordBatch.from_arrays([tags, pa.array(h.view(np.int64)), pa.array(n, pa.int64())], names=["tag", "h", "n"])

    each = texts.select("tag", "text").mapInArrow(light(run), "tag binary, h long, n long")
    single = each.groupBy("h").agg(F.count("*").alias("held"), F.min("tag").alias("tag"), F.min("n").alias("n")).where("held = 1")
    return single.groupBy("tag").agg(F.sum("n").alias("lone"))


def histograms(texts: DataFrame) -> DataFrame:
    """From different texts (tag, text): tag, coarse and bins (shingles by the leading bits of their number)."""
    bits = np.uint64(64 - (BINS - 1).bit_length())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bins = [np.bincount((own >> bits).astype(np.int64), minlength=BINS) for own in numbers(batch.column(1))]
            coarse = [b.reshape(COARSE, -1).sum(axis=1) for b in bins]
            columns = [pa.array(x, pa.list_(pa.int32())) for x in (coarse, bins)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["tag", "coarse", "bins"])

    return texts.select("tag", "text").mapInArrow(light(run), "tag binary, coarse array<int>, bins array<int>")


def near_nodes(docs: DataFrame, id_col: str, text_col: str, similarity: float) -> DataFrame:
    """One row per different text: tag, held (rows), n_verified, class_size, has_id and first (the class's smallest id), best (the row key that stays)."""
    text = whole_text(text_col)
    rows = docs.select(text_key(text).alias("tag"), F.col(id_col).cast("long").alias("id"), row_key(id_col, text).alias("row"), text.alias("text"))
    found = links(rows.select("tag", "text"), similarity)
    labels = components(found, "classes")
    ends = found.select(F.col("a").alias("node"), F.col("b").alias("other")).union(found.select(F.col("b").alias("node"), F.col("a").alias("other"))).distinct()
    degree = ends.groupBy("node").agg(F.count("*").alias("n_verified"))
    best = F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", "row"))
    copies = rows.groupBy(F.col("tag").alias("node")).agg(best.alias("best"), F.count("*").alias("held"))
    nodes = copies.join(labels, "node", "left").join(degree, "node", "left").select("node", "best", "held", F.coalesce("n_verified", F.lit(0)).cast("long").alias("n_verified"), F.coalesce("label", "node").alias("label"))
    nodes = stored(nodes, "near-nodes")
    classes = nodes.groupBy("label").agg(F.min("best").alias("first"), F.sum("held").alias("class_size"))
    return nodes.join(classes, "label").select(F.col("node").alias("tag"), "n_verified", "first", "class_size")


def near_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """One row per document: doc_id, class_id (smallest id of its class), class_size (rows), n_verified, kept (one row a class).

    Words are compared without case (A to Z). A null text counts as empty. Equal texts are one class; texts without words
    are alike only if equal; a text of fewer than five words has one shingle of them all. n_verified counts the
    different texts that this one was compared with and found alike, not all that it is like; class ids are null where all
    ids of the class are. Of a class the row with the smallest id stays, null ids last, one of rows equal in id and text. An
    empty table gives no rows; other columns are not read.
    """
    text = whole_text(text_col)
    number = F.row_number().over(Window.partitionBy("row").orderBy(F.lit(0)))
    keyed = docs.select(F.col(id_col).cast("long").alias("id"), text_key(text).alias("tag"), row_key(id_col, text).alias("row")).withColumn("number", number)
    return keyed.join(near_nodes(docs, id_col, text_col, similarity), "tag").select(
        F.col("id").alias("doc_id"), F.col("first.id").alias("class_id"), "class_size", "n_verified",
        ((F.col("row") == F.col("first.row")) & (F.col("number") == 1)).alias("kept"),
    )


def one_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """One document of every class, with all its columns."""
    key = free_name(docs, "row_key")
    stay = near_nodes(docs, id_col, text_col, similarity).select(F.col("first.row").alias(key)).distinct()
    rows = docs.withColumn(key, row_key(id_col, whole_text(text_col))).join(stay, key, "left_semi")
    return one_row_each(rows, key).drop(key)


def op3_near_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its class of near copies."""
    return near_classes(table(spark, sf_dir, "documents"))


QUERIES = {"op3_near_copies": op3_near_copies}
ORACLES: dict[str, str] = {}
