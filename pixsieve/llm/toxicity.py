"""Toxicity of whole texts, read through leetspeak, spacing and repetition.

Noisy channel: a word that mixes letters with other signs or begins with one that may be a letter, repeats a letter three
times or every letter twice, or stands in a run of single letters becomes a lattice (a sign may be a letter, a separator or itself; a long run of a letter one or two letters; a gap
may be closed). Viterbi finds the reading that a character 4-gram model, counted over all documents, finds likeliest.
Words without such marks have one reading, themselves.

Score: words and word beginnings of the restored text are hashed into a table of fixed size whose entries hold the lower
confidence bound of their log odds between toxic and other labelled documents; a small logistic regression on a
document's strongest word, sum, density and length gives the probability. Labels are learned from at most LABELLED rows.
"""

from __future__ import annotations


from collections.abc import Iterator


import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pixsieve.llm.common import free_name, light, remainder, table, whole_text
from pixsieve.llm.words import BASE, INVERSE, LOWER, PUNCTUATION, SPACE, bytes_of, mixed, powers, room, slices

#: Labelled rows that the classifier is fitted on at most, and those of them that only the regression sees.
LABELLED = 200_000
#: Table entries: log odds by hashed feature, whatever the vocabulary.
ENTRIES = 1 << 20
PREFIXES = (3, 4, 5, 6, 7, 8)

# Fixed values of common leetspeak: the letters that a sign may stand for.
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "<": "c", "€": "e", "¡": "i", "*": "",
}
#: Channel costs, natural logarithms: a letter sign, a dropped sign, a sign kept, a shortened run by 1 or 2, a closed gap.
AS_LETTER, DROPPED, KEPT, RUN_ONE, RUN_TWO, CLOSED = -1.0, -3.0, -1.5, -1.0, -1.5, -0.5

#: Letters that a word has at least if it writes each of them twice. Signs that begin a word as a letter.
DOUBLED = 3
LEADING = np.zeros(256, bool)
LEADING[[ord(c) for c in "!(<"]] = True

#: Symbols of the character model: 0 for any break, 1-26 letters, 27-31 bytes of other scripts' letters.
SYMBOL = np.zeros(256, np.uint8)
SYMBOL[97:123] = np.arange(1, 27)
SYMBOL[128:] = 27 + np.arange(128) % 5


def char_counts(docs: DataFrame, text_col: str) -> np.ndarray:
    """Counts of the 32^4 symbol runs over all texts; that many numbers at most reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << 20, np.int64)
        for batch in batches:
            for a, b in slices(batch.column(0)):
                body, offsets = bytes_of(batch.column(0).slice(a, b - a))
                body = np.insert(SYMBOL[LOWER[body]], offsets, 0).astype(np.int32)
                body = body[np.concatenate([[True], (body[1:] > 0) | (body[:-1] > 0)])]  # one break between words
                body = np.concatenate([[0, 0], body])
                total += np.bincount(body[:-3] << 15 | body[1:-2] << 10 | body[2:-1] << 5 | body[3:], minlength=1 << 20)
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(total[found])], names=["code", "n"])

    rows = docs.select(whole_text(text_col)).mapInArrow(light(run), "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(1 << 20)
    out[rows["code"].to_numpy()] = rows["n"].to_numpy()
    return out


def char_model(counts: np.ndarray) -> np.ndarray:
    """ln P(symbol | three before), Witten-Bell interpolation down to uniform."""
    p = np.full(32, 1 / 32)
    full = counts.reshape(32, 32, 32, 32)
    for order in range(4):
        c = full.sum(axis=tuple(range(3 - order)))
        n, kinds = c.sum(axis=-1, keepdims=True), (c > 0).sum(axis=-1, keepdims=True)
        p = np.where(n > 0, (c + kinds * p) / np.maximum(n + kinds, 1), np.broadcast_to(p, c.shape))
    return np.log(p).astype(np.float32).ravel()


def lattice(token: str) -> list[list[tuple[str, float]]]:
    """Readings of each stretch of a lower-case token: (replacement, cost)."""
    out = []
    letters = [c.isalpha() for c in token]
    doubled = len(token) >= 2 * DOUBLED and token[::2] == token[1::2]
    at = 0
    while at < len(token):
        c, to = token[at], at + 1
        while to < len(token) and token[to] == c:
            to += 1
        n = to - at
        if letters[at]:
            out.append([(c * n, 0.0), *([(c * (n // 2), RUN_ONE)] if doubled else [])] if n < 3 or (doubled and n % 2 == 0) else [(c, RUN_ONE), (c * 2, RUN_TWO), (c * n, 4 * RUN_ONE)])
        else:
            single = at > 0 and letters[at - 1] and to < len(token) and letters[to] and (at < 2 or not letters[at - 2])
            gap = CLOSED if single or c.isspace() else DROPPED
            options = [("", gap), (c * n, KEPT)]
            options += [(x * k, AS_LETTER + (k > 1) * RUN_ONE) for x in LEET.get(c, "") for k in range(1, min(n, 2) + 1)]
            out.append(options)
        at = to
    return out


def decode(token: str, model: np.ndarray) -> str:
    """The likeliest reading of a token (its gaps included), by Viterbi over its lattice with the last three symbols as state."""
    states: dict[tuple[int, int, int], tuple[float, tuple]] = {(0, 0, 0): (0.0, ())}
    for options in [*lattice(token), [(" ", 0.0)]]:
        following: dict[tuple[int, int, int], tuple[float, tuple]] = {}
        coded = [(x, cost, SYMBOL[LOWER[np.frombuffer(x.encode(), np.uint8)]].tolist()) for x, cost in options]
        for state, (score, path) in states.items():
            for x, cost, symbols in coded:
                s, total = state, score + cost
                for y in symbols:
                    if y == 0 and s[2] == 0:
                        continue  # one break
                    total += float(model[s[0] << 15 | s[1] << 10 | s[2] << 5 | y])
                    s = (s[1], s[2], y)
                if s not in following or following[s][0] < total:
                    following[s] = (total, (path, x))
        states = following
    _, path = max(states.values(), key=lambda v: v[0])
    parts = []
    while path:
        path, x = path
        parts.append(x)
    return "".join(reversed(parts)).strip()


class Reader:
    """Restored readings of suspicious tokens, remembered up to a bound."""

    def __init__(self, model: np.ndarray):
        self.model, self.known = model, {}

    def read(self, token: str) -> str:
        found = self.known.get(token)
        if found is None:
            if len(self.known) > 200_000:
                self.known.clear()
            found = self.known[token] = decode(token, self.model)
        return found


def suspicious(body: np.ndarray, first: np.ndarray, last: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words to be read through the lattice, and the run (a number each) that they stand in: single letters in a row are one."""
    n = len(body)
    letter = (SYMBOL[body] > 0) | (body >= 128)
    letters = np.concatenate([[0], np.cumsum(letter)])
    others = np.concatenate([[0], np.cumsum(~letter & ~SPACE[body])])
    triple = np.zeros(n, bool)
    if n > 2:
        triple[2:] = letter[2:] & (body[2:] == body[1:-1]) & (body[1:-1] == body[:-2])
    triples = np.concatenate([[0], np.cumsum(triple)])
    # signs at the outer ends that never stand for letters there don't count
    lead, trail = first.copy(), last.copy()
    outer = PUNCTUATION.copy()
    outer[[ord(c) for c in "@$|+"]] = False
    for _ in range(3):
        lead = np.where((lead < last) & outer[body[np.minimum(lead, n - 1)]], lead + 1, lead)
        trail = np.where((trail > first) & outer[body[trail - 1]], trail - 1, trail)
    trail = np.maximum(trail, lead)
    inner = (letters[last] - letters[first] >= 1) & (others[trail] - others[lead] > 0)
    # one sign before letters that may be a letter itself
    begun = LEADING[body[np.minimum(first, n - 1)]] & (lead == first + 1) & (letters[trail] - letters[lead] >= DOUBLED)
    # every letter twice: at each second place from the word's first on
    twice = np.zeros(n + 2, np.int64)
    twice[2 : n + 1] = letter[: n - 1] & (body[: n - 1] == body[1:]) if n > 1 else 0
    by_two = twice.copy()  # sums over places of one parity
    by_two[::2], by_two[1::2] = np.cumsum(twice[::2]), np.cumsum(twice[1::2])
    size = last - first
    even = (size % 2 == 0) & (size >= 2 * DOUBLED)
    doubled = even & (by_two[np.where(even, last, 0)] - by_two[np.where(even, first, 0)] == size // 2)
    odd = inner | begun | doubled | (triples[last] - triples[first] > 0)
    chars = np.concatenate([[0], np.cumsum((body & 0xC0) != 0x80)])
    single = (chars[last] - chars[first] == 1) & ((letters[last] > letters[first]) | (others[last] > others[first]))
    same = np.concatenate([[False], (doc[1:] == doc[:-1]) & single[1:] & single[:-1]])
    run = np.cumsum(~same) - 1
    long_run = np.bincount(run, minlength=1)[run] >= 3 if len(run) else np.zeros(0, bool)
    return (odd & ~single) | (long_run & single), run


def features(texts: pa.Array, reader: Reader | None) -> tuple[np.ndarray, np.ndarray]:
    """Table entries of every word of the restored texts, one row of (word, prefixes) each (-1: none), and the word's text."""
    body, offsets = bytes_of(texts)
    body = LOWER[body]
    n = len(body)
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    inside = ~SPACE[body]
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= SPACE[body[:-1]] | edge[1:n]
    ends[:-1] &= SPACE[body[1:]] | edge[1:n]
    first, last = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    doc = np.searchsorted(offsets, first, "right") - 1
    extra: list[str] = []
    extra_doc: list[int] = []
    if reader is not None and len(first):
        odd, run = suspicious(body, first, last, doc)
        hit = np.flatnonzero(odd)
        if len(hit):
            raw = body.tobytes()
            groups = np.flatnonzero(np.concatenate([[True], run[hit][1:] != run[hit][:-1]]))
            for a, b in zip(groups, [*groups[1:], len(hit)], strict=True):
                token = raw[first[hit[a]] : last[hit[b - 1]]].decode("utf-8", "replace")
                extra.append(reader.read(token.lower()))
                extra_doc.append(int(doc[hit[a]]))
            first, last, doc = first[~odd], last[~odd], doc[~odd]
    stays = ~PUNCTUATION[body]
    kept = np.concatenate([[0], np.cumsum(stays)])
    own, where = entries(body[stays], kept[first], kept[last])
    doc = doc[where]
    if extra:
        more, at = features(pa.array(extra, pa.string()), None)
        own, doc = np.concatenate([own, more]), np.concatenate([doc, np.array(extra_doc)[at]])
    return own, doc


def entries(body: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Entries of the non-empty words, and which they are."""
    where = np.flatnonzero(last > first)
    first, last = first[where], last[where]
    n = len(body)
    size = room(n)
    running = np.zeros(n + 1, np.uint64)
    np.cumsum((body.astype(np.uint64) + np.uint64(1)) * powers(BASE, size)[:n], out=running[1:])
    inverse = powers(INVERSE, size)[first]
    out = np.full((len(first), 1 + len(PREFIXES)), -1, np.int32)
    for k, length in enumerate((None, *PREFIXES)):
        to = last if length is None else np.minimum(first + length, last)
        h = mixed((running[to] - running[first]) * inverse + np.uint64(length or 99))
        out[:, k] = (h >> np.uint64(44)).astype(np.int32)
        if length is not None:
            out[last - first <= length, k] = -1
    return out, where


def counted(own: np.ndarray, doc: np.ndarray, label: np.ndarray, totals: np.ndarray) -> None:
    """Adds words and documents by entry and label to totals[(words 0, words 1, documents 0, documents 1), entry]."""
    at = np.repeat(doc, own.shape[1])
    e = own.ravel()
    at, e = at[e >= 0].astype(np.int64), e[e >= 0].astype(np.int64)
    pairs, n = np.unique(at << 20 | e, return_counts=True)
    d, e = label[pairs >> 20], pairs & (ENTRIES - 1)
    for y in (0, 1):
        totals[y] += np.bincount(e[d == y], weights=n[d == y], minlength=ENTRIES)
        totals[2 + y] += np.bincount(e[d == y], minlength=ENTRIES)


CHUNK = 4096


def log_odds(words: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """Of some entries, from words 0 and 1, documents 0 and 1 in all and of each entry; less what is in doubt."""
    odds = np.log((totals[1] + 0.5) / (words[1] + 1) / ((totals[0] + 0.5) / (words[0] + 1)))
    doubt = np.sqrt(1 / (totals[3] + 0.5) + 1 / (totals[2] + 0.5))
    sure = np.maximum(0, np.abs(odds) - 1.5 * doubt)
    return np.where(totals[2] + totals[3] >= 3, np.sign(odds) * sure, 0.0)


def evidence(labelled: DataFrame, reader_model: np.ndarray) -> np.ndarray:
    """The table of log odds from (text, toxic). Sums travel as packed stretches of 4096 entries, one per task and stretch, each
    with the task's words and documents by label, so that the odds are worked out where a stretch is added up."""
    shared = labelled.sparkSession.sparkContext.broadcast(reader_model)  # 4 MiB

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, totals = Reader(shared.value), np.zeros((4, ENTRIES))
        words = np.zeros(4)
        for batch in batches:
            label = batch.column(1).to_numpy(zero_copy_only=False)
            for a, b in slices(batch.column(0)):
                own, doc = features(batch.column(0).slice(a, b - a), reader)
                counted(own, doc, label[a:b], totals)
                words[:2] += np.bincount(label[a:b][doc], minlength=2)[:2]
                words[2:] += np.bincount(label[a:b], minlength=2)[:2]
        if not words.any():
            return
        parts = totals.reshape(4, -1, CHUNK).transpose(1, 0, 2)
        rows = [words.astype(np.int64).tobytes() + (part.astype(np.uint32).tobytes() if part.any() else b"") for part in parts]
        yield pa.RecordBatch.from_arrays([pa.array(range(len(rows)), pa.int32()), pa.array(rows, pa.binary())], names=["chunk", "packed"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, packed in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                own = sums.setdefault(k, np.zeros(4 + 4 * CHUNK, np.int64))
                own[:4] += np.frombuffer(packed.as_buffer(), np.int64, 4)
                values = np.frombuffer(packed.as_buffer(), np.uint32, offset=32)
                own[4 : 4 + len(values)] += values
        odds = [(k, log_odds(v[:4].astype(float), v[4:].reshape(4, CHUNK))) for k, v in sums.items()]
        odds = [(k, v.astype(np.float32).tobytes()) for k, v in odds if v.any()]
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in odds], pa.int32()), pa.array([v for _, v in odds], pa.binary())], names=["chunk", "packed"])

    # four bytes an entry reach the driver
    rows = labelled.select("text", "toxic").mapInArrow(light(count), "chunk int, packed binary").repartition("chunk").mapInArrow(light(add), "chunk int, packed binary").toArrow()
    out = np.zeros(ENTRIES, np.float32)
    for k, packed in zip(rows["chunk"].to_pylist(), rows["packed"], strict=True):
        out[k * CHUNK : (k + 1) * CHUNK] = np.frombuffer(packed.as_buffer(), np.float32)
    return out


def signals(texts: pa.Array, reader: Reader, odds: np.ndarray) -> np.ndarray:
    """Per text what the regression sees."""
    own, doc = features(texts, reader)
    w = odds[own]
    w[own < 0] = 0
    best, worst = w.max(axis=1, initial=-99), w.min(axis=1, initial=99)
    value = np.where(best > 0.3, best, np.minimum(worst, 0) * 0.1)
    docs = len(texts)
    n = np.bincount(doc, minlength=docs).astype(float)
    up = np.bincount(doc, weights=np.where(value > 0.3, value, 0), minlength=docs)
    net = np.bincount(doc, weights=value, minlength=docs)
    strong = np.bincount(doc, weights=value > 2.5, minlength=docs)
    top = np.zeros(docs)
    np.maximum.at(top, doc, np.maximum(value, 0))
    some = np.maximum(n, 1)
    return np.column_stack([
        top, np.log1p(up), up / some, up / np.sqrt(some), np.sign(net) * np.log1p(np.abs(net)), net / some,
        np.log1p(strong), strong / some, np.log1p(n), np.minimum(top, 3) * np.log1p(strong), np.minimum(strong, 3.0), top * (strong > 0),
    ])


def regression(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Logistic regression by Newton steps: means, scales and weights, packed in rows."""
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    z = np.column_stack([np.ones(len(x)), (x - mean) / scale])
    w = np.zeros(z.shape[1])
    keep = np.eye(len(w)) * ridge
    keep[0, 0] = 1e-6
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + keep, z.T @ (y - p) - keep @ w)
        w += np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-6:
            break
    return np.vstack([np.append(0, mean), np.append(1, scale), w])


def probability(x: np.ndarray, fitted: np.ndarray) -> np.ndarray:
    mean, scale, w = fitted
    return 1 / (1 + np.exp(-np.clip(w[0] + ((x - mean[1:]) / scale[1:]) @ w[1:], -30, 30)))


def fit(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, labelled_rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Character model, log odds, regression. Only labels of ids whose remainder is not 0 are used; remainder 4 for the regression."""
    chars = char_model(char_counts(docs, text_col))
    ids = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & (remainder(id_col) != 0)).groupBy(F.col(id_col).cast("long").alias("label_id")).agg(F.max(F.col(label_col).cast("int")).alias("toxic"))
    some = ids.orderBy(F.xxhash64("label_id"), "label_id").limit(labelled_rows)  # 12 bytes a row: the broadcast is bounded
    known = docs.select(F.col(id_col).cast("long").alias("id"), whole_text(text_col).alias("text")).join(F.broadcast(some), F.col("id") == F.col("label_id"))
    odds = evidence(known.where(remainder("id") != 4), chars)
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((chars, odds))  # 4 MiB each

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(shared.value[0])
        for batch in batches:
            for a, b in slices(batch.column(0)):
                x = signals(batch.column(0).slice(a, b - a), reader, shared.value[1])
                yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in x], pa.binary()), batch.column(1).slice(a, b - a)], names=["x", "toxic"])

    rows = known.where(remainder("id") == 4).select("text", "toxic").mapInArrow(light(seen), "x binary, toxic int").toArrow()  # a quarter of `labelled_rows` short rows
    y = rows["toxic"].to_numpy().astype(float)
    width = signals(pa.array([""], pa.string()), Reader(chars), odds).shape[1]
    x = np.frombuffer(b"".join(rows["x"].to_pylist()), float).reshape(-1, width)
    if len(y) == 0 or y.min() == y.max():  # nothing to tell apart
        share = (y.sum() + 0.5) / (len(y) + 1) if len(y) else 0.5
        fitted = np.zeros((3, width + 1))
        fitted[1] = 1
        fitted[2, 0] = np.log(share / (1 - share))
    else:
        order = np.lexsort((*x.T, y))  # rows arrive in no set order
        fitted = regression(x[order], y[order])
    return chars, odds, fitted


def scored(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", labelled_rows: int = LABELLED) -> DataFrame:
    """One row per document: doc_id, held_out (its label was not used), score, predicted.

    Null and empty texts score as texts without words; a null id is held out where the remainder of the empty text says
    so; labels that are null or neither 0 nor 1 are left out, of several labels of an id the largest counts; without any
    label the score is 0.5. Repeated rows each get their score; an empty table gives no rows; other columns are not read.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), (remainder(id_col) == 0).alias("held_out"), whole_text(text_col).alias("text"))
    model = fit(docs, labels, id_col, text_col, label_col, labelled_rows)
    scored_rows = with_score(rows, model, "text", "score", drop="text")
    return scored_rows.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def with_score(rows: DataFrame, model: tuple[np.ndarray, np.ndarray, np.ndarray], text: str, score: str, drop: str | None = None) -> DataFrame:
    """The rows with the score of the text column (a string, null as empty) behind them; the column `drop` is left out."""
    shared = rows.sparkSession.sparkContext.broadcast(model)  # 8 MiB
    names = [c for c in rows.columns if c != drop]
    at = rows.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chars, odds, fitted = shared.value
        reader = Reader(chars)
        for batch in batches:
            for a, b in slices(batch.column(at)):  # a slice goes on at once: no second copy of a batch is held
                part = batch.slice(a, b - a)
                values = probability(signals(pc.fill_null(part.column(at), ""), reader, odds), fitted)
                kept = [c for k, c in enumerate(part.columns) if rows_names[k] != drop]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(values)], names=[*names, score])

    rows_names = rows.columns
    schema = T.StructType([*(f for f in rows.schema if f.name != drop), T.StructField(score, T.DoubleType())])
    return rows.mapInArrow(light(run), schema)


def without_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", threshold: float = 0.5, labelled_rows: int = LABELLED) -> DataFrame:
    """The documents that score below the threshold, with all their columns."""
    score = free_name(docs, "toxicity_score")
    model = fit(docs, labels, id_col, text_col, label_col, labelled_rows)
    scored_rows = with_score(docs, model, text_col, score)
    return scored_rows.where(F.col(score) < threshold).drop(score)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's toxicity, learned from the labels."""
    return scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {"op2_toxicity": op2_toxicity}
ORACLES: dict[str, str] = {}
