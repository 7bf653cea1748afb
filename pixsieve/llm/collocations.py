"""Phrase collocations by Rabin-Karp fingerprints of every run of one to four words.

A slice of texts is lower-cased and laid out with one space behind each word, so a phrase is a stretch of bytes and its
fingerprint a difference of prefix polynomials: one modulo two primes (62 bits), and another modulo 2^64 that tells phrases
apart whose first ones collide. Both together are the key. Tasks add up equal keys before they send them on, with a pointer
to one occurrence: 29 bits of its text's hash, the byte where it begins, its number of words.

A first scan counts words and pairs by 40 bits of the first fingerprint, in narrow rows; what is frequent there goes into a
bitmap sized by their number. A second one does the same with runs of three words whose pairs the bitmap holds. The third
counts by the whole key, and only runs whose shorter runs may all be frequent; a full bitmap costs time, never a phrase.
Only frequent keys get their words: the pointers join the texts they point to, the words at that place are fingerprinted
again, and a text that merely shares the 29 bits is known by its other fingerprint. All that follows are joins of phrases.

A language's number of words travels the same way, as the count of its empty phrase.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pixsieve.bitmaps import may_hold
from pixsieve.llm.common import block_count, light, stored, table, whole_text
from pixsieve.llm.words import LOWER, bytes_of, mixed, powers, room

LONGEST = 4
MIN_COUNT = 30
SCALE = 2_000_000
#: A candidate goes if a longer phrase around it has this share of its occurrences, in hundredths.
COVERED = 80
KEPT = 2000

BREAK = np.zeros(256, bool)
BREAK[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
GAP = np.zeros(256, bool)
GAP[[0x20, 0x09]] = True
WORD = rb"[^\x20\x09.,;:!?\x0A-\x0D]+"
RUN = {k: re.compile(WORD + (rb"(?:[\x20\x09]+" + WORD + rb"){%d}" % (k - 1))) for k in range(1, LONGEST + 1)}

PRIMES = ((1 << 31) - 1, (1 << 31) - 19)
BASES = (911_382_323, 972_663_749)
WIDE_BASE = 0xD6E8FEB86659FD93
TAG_BITS, PLACE_BITS, LENGTH_BITS = 29, 31, 3
#: Bits of a fingerprint by which the first scan counts.
HASH_BITS = 40
#: Bytes of text whose fingerprints are worked out at once (tables of powers are kept in powers of two), and keys that a
#: task has room for to add up before it sends some on.
SLICE_BYTES = (1 << 19) - (1 << 12)
HELD_KEYS = 1 << 20
#: Text that a task of the scans behind a bitmap adds up: it sends a row for each frequent phrase it meets, so small tasks send
#: them all again and again.
UNIT_BYTES = 128 << 20
#: The bitmap of frequent runs: so many bits each, so that few others pass, within these bounds (2^28 bits are 32 MiB).
BITS_EACH = 64
BITMAP_BITS = (20, 28)


@lru_cache(maxsize=16)
def prime_powers(base: int, prime: int, size: int) -> np.ndarray:
    """1, base, base^2 ... modulo prime, by doubling; size is a power of two."""
    out = np.ones(1, np.uint64)
    while len(out) < size:
        out = np.concatenate([out, out * np.uint64(pow(base, len(out), prime)) % np.uint64(prime)])
    return out


class Prefixes:
    """Prefix polynomials of some bytes; fingerprints of stretches of them."""

    def __init__(self, body: np.ndarray):
        n = len(body)
        self.size = room(n)
        value = body.astype(np.uint64) + np.uint64(1)
        self.sums = []
        for base, prime in zip(BASES, PRIMES, strict=True):
            term = value * prime_powers(base, prime, self.size)[:n]
            sums = np.zeros(n + 1, np.uint64)
            if n >= 1 << 24:  # terms are below 2^39: so many of them would pass 64 bits
                term %= np.uint64(prime)
            np.cumsum(term, out=sums[1:])
            self.sums.append(sums % np.uint64(prime))
        self.wide = np.zeros(n + 1, np.uint64)
        np.cumsum(value * powers(WIDE_BASE, self.size)[:n], out=self.wide[1:])

    def fingerprints(self, first: np.ndarray, last: np.ndarray, lang: np.ndarray) -> np.ndarray:
        """Of the stretches, with their languages' numbers mixed in."""
        halves = []
        for base, prime, sums in zip(BASES, PRIMES, self.sums, strict=True):
            p = np.uint64(prime)
            part = sums[last] + p - sums[first]
            halves.append(part % p * prime_powers(pow(base, -1, prime), prime, self.size)[first] % p)
        return mixed((halves[0] << np.uint64(31) | halves[1]) ^ lang)

    def guards(self, first: np.ndarray, last: np.ndarray, lang: np.ndarray) -> np.ndarray:
        """Their second fingerprints."""
        wide = (self.wide[last] - self.wide[first]) * powers(pow(WIDE_BASE, -1, 1 << 64), self.size)[first]
        return mixed(wide + (last - first).astype(np.uint64)) ^ lang


def lang_number(lang: str) -> np.uint64:
    return np.uint64(int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "little"))


def empty_phrase(lang: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return mixed(~lang), mixed(lang + np.uint64(1))


def cuts(body: np.ndarray, offsets: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Stretches of about limit bytes that end where a text or a piece of one ends; a longer piece stays whole."""
    at, n = 0, len(body)
    while at < n:
        to = min(n, at + limit)
        if to < n:
            edge = int(offsets[np.searchsorted(offsets, to, "right") - 1])
            breaks = np.flatnonzero(BREAK[body[at:to]])
            inner = max(edge, at + int(breaks[-1]) + 1 if len(breaks) else 0)
            if inner <= at:
                after = int(offsets[np.searchsorted(offsets, at, "right")])
                breaks = np.flatnonzero(BREAK[body[to:after]])
                inner = to + int(breaks[0]) + 1 if len(breaks) else after
            to = inner
        yield at, to
        at = to


class Words:
    """The words of a stretch of a batch: where they begin in it and in the laid-out bytes, their texts, which follow each other."""

    def __init__(self, body: np.ndarray, offsets: np.ndarray, at: int, to: int):
        part = LOWER[body[at:to]]
        stop, n = BREAK[part], to - at
        inside = ~(stop | GAP[part])
        edge = np.zeros(n + 1, bool)
        edge[offsets[np.searchsorted(offsets, at) : np.searchsorted(offsets, to, "right")] - at] = True
        begins, ends = inside.copy(), inside.copy()
        begins[1:] &= ~inside[:-1] | edge[1:n]
        ends[:-1] &= ~inside[1:] | edge[1:n]
        first, last = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        size = last - first
        self.text = np.searchsorted(offsets, first + at, "right") - 1
        self.place = first + at - offsets[self.text]
        self.first = np.cumsum(size + 1) - (size + 1)
        self.last = self.first + size
        self.laid = np.full(int((size + 1).sum()), 0x20, np.uint8)
        self.laid[np.arange(int(size.sum())) + np.repeat(np.arange(len(first)), size)] = part[inside]
        stops = np.cumsum(stop)
        self.joined = (stops[first[1:]] == stops[first[:-1]]) & (self.text[1:] == self.text[:-1])

    def __len__(self) -> int:
        return len(self.first)


Counts = list[np.ndarray]


def added_down(columns: Counts, used: int) -> int:
    """Equal keys among the first `used` ones added up in their place, in order; returns how many are left. One column after the
    other, so that little is held beside them."""
    if not used:
        return 0
    order = np.argsort(columns[0][:used], kind="stable")
    for x in columns:
        x[:used] = x[:used][order]
    del order
    fp, n, *more = (x[:used] for x in columns)
    new = np.ones(used, bool)
    new[1:] = fp[1:] != fp[:-1]
    if more:
        new[1:] |= more[0][1:] != more[0][:-1]
    begins = np.flatnonzero(new)
    left = len(begins)
    n[:left] = np.add.reduceat(n, begins)
    for x in (fp, *more[:1]):
        x[:left] = x[begins]
    if more:
        more[1][:left] = np.minimum.reduceat(more[1], begins)
    return left


def added(parts: list[Counts]) -> Counts:
    """Equal keys added up; parts: fp, n, and in the last scan guard and pointer, of which the smallest stays. Keys that share
    fp alone stay apart, in more rows than one perhaps."""
    columns = [np.concatenate(x) for x in zip(*parts, strict=True)]
    left = added_down(columns, len(columns[0]))
    return [x[:left] for x in columns]


class Batch:
    """Slices of a batch of (tag, lang, text), and the numbers of their languages."""

    def __init__(self, batch: pa.RecordBatch):
        langs = batch.column(1).dictionary_encode()
        numbers = np.array([lang_number(x) for x in langs.dictionary.to_pylist()], np.uint64)
        self.lang = numbers[langs.indices.to_numpy()] if len(langs) else np.zeros(0, np.uint64)
        self.tag = batch.column(0).to_numpy().astype(np.int64) << (PLACE_BITS + LENGTH_BITS)
        self.body, self.offsets = bytes_of(batch.column(2))

    def slices(self) -> Iterator[tuple[Words, Prefixes, np.ndarray]]:
        """Words, their prefixes, and the number of each word's language."""
        for at, to in cuts(self.body, self.offsets, SLICE_BYTES):
            words = Words(self.body, self.offsets, at, to)
            if len(words):
                yield words, Prefixes(words.laid), self.lang[words.text]


def runs_held(words: Words, prefixes: Prefixes, lang: np.ndarray, bits: np.ndarray | None, lengths: range) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each length the runs whose shorter ones of these lengths the bitmap holds: length, first words, fingerprints.

    Of a length that is not the last only those that the bitmap holds themselves.
    """
    ok = np.ones(len(words), bool)
    for k in lengths:
        if k > 1:
            both = ok[:-1] & ok[1:]
            i = np.flatnonzero(both & words.joined if k == 2 else both)
        else:
            i = np.arange(len(words))
        fp = prefixes.fingerprints(words.first[i], words.last[i + k - 1], lang[i])
        if bits is not None and k < lengths[-1]:
            here = held(bits, fp)
            i, fp = i[here], fp[here]
        yield k, i, fp
        ok[:] = False
        ok[i] = True


def hashes_of(batch: Batch, bits: np.ndarray | None, lengths: range, counted_from: int) -> Iterator[Counts]:
    """The leading bits of the fingerprints of runs_held, of those of counted_from words or more."""
    for words, prefixes, lang in batch.slices():
        fp = np.concatenate([fp for k, _, fp in runs_held(words, prefixes, lang, bits, lengths) if k >= counted_from])
        yield added([[fp >> np.uint64(64 - HASH_BITS), np.ones(len(fp), np.int64)]])


def runs_of(batch: Batch, bits: np.ndarray) -> Iterator[Counts]:
    """The runs of one to four words whose shorter runs the bitmap holds, and empty phrases, which count all words."""
    for words, prefixes, lang in batch.slices():
        text, n = np.unique(words.text, return_counts=True)
        empty = empty_phrase(batch.lang[text])
        parts = [[empty[0], n.astype(np.int64), empty[1], batch.tag[text]]]
        for k, i, fp in runs_held(words, prefixes, lang, bits, range(1, LONGEST + 1)):
            pointer = batch.tag[words.text[i]] | words.place[i] << LENGTH_BITS | k
            parts.append([fp, np.ones(len(i), np.int64), prefixes.guards(words.first[i], words.last[i + k - 1], lang[i]), pointer])
        yield added(parts)


def summed(each: Iterator[Counts], limit: int) -> Iterator[Counts]:
    """What each gives, added up in room for so many keys. When it is full the rarest go; the others go on being added up."""
    columns, used = None, 0
    for counts in each:
        size = len(counts[0])
        if size > limit:
            yield counts
            continue
        if columns is None:
            columns = [np.empty(limit, x.dtype) for x in counts]
        if used + size > limit:
            used = added_down(columns, used)
            if used > (kept := min(limit * 3 // 4, limit - size)):
                n = columns[1][:used]
                stays = n > np.partition(n, used - kept - 1)[used - kept - 1]
                yield [x[:used][~stays] for x in columns]
                for x in columns:
                    x[: int(stays.sum())] = x[:used][stays]
                used = int(stays.sum())
        for x, own in zip(columns, counts, strict=True):
            x[used : used + size] = own
        used += size
    if used:
        used = added_down(columns, used)
        yield [x[:used] for x in columns]


def in_units(rows: DataFrame) -> DataFrame:
    """The rows in tasks of about UNIT_BYTES of text where theirs are smaller, but no fewer than can run at once."""
    return rows.coalesce(max(block_count(rows, F.col("text"), UNIT_BYTES), rows.sparkSession.sparkContext.defaultParallelism))


def added_up(rows: DataFrame, counts_of, schema: str) -> DataFrame:
    """What counts_of gives of the batches of rows, added up as far as a task holds it, and dealt by its first column.

    It is dealt before it is grouped, since adding up again in the same task would cost memory and find little.
    """
    names = [x.split()[0] for x in schema.split(", ")]

    def sent(counts: Counts, size: int = 1 << 17) -> Iterator[pa.RecordBatch]:
        for a in range(0, len(counts[0]), size):
            yield pa.RecordBatch.from_arrays([pa.array(x[a : a + size].view(np.int64)) for x in counts], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = (counts for batch in batches for counts in counts_of(Batch(batch)))
        for counts in summed(each, HELD_KEYS):
            yield from sent(counts)

    return rows.select("tag", "lang", "text").mapInArrow(light(run), schema).repartition(names[0])


def frequent_hashes(rows: DataFrame, min_count: int, bitmap_bytes: bytes | None = None) -> DataFrame:
    """h: the leading HASH_BITS of the fingerprints of runs that may occur min_count times or more: of words and pairs, with
    their bitmap of runs of three words. Stored."""
    bits = lambda: None if bitmap_bytes is None else np.frombuffer(bitmap_bytes, np.uint8)
    lengths, counted_from = (range(1, 3), 1) if bitmap_bytes is None else (range(2, 4), 3)
    each = added_up(rows, lambda batch: hashes_of(batch, bits(), lengths, counted_from), "h long, n long")
    return stored(each.groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count).select("h"), "phrase-hashes")


def counted(rows: DataFrame, bitmap_bytes: bytes, min_count: int) -> DataFrame:
    """fp, guard, n, pointer of all runs that occur min_count times or more, and of empty phrases. rows: (tag, lang, text) without nulls."""
    each = added_up(rows, lambda batch: runs_of(batch, np.frombuffer(bitmap_bytes, np.uint8)), "fp long, n long, guard long, pointer long")
    whole = each.groupBy("fp", "guard").agg(F.sum("n").alias("n"), F.min("pointer").alias("pointer"))
    return whole.where((F.col("n") >= min_count) | (words_in(F.col("pointer")) == 0))


def words_in(pointer: Column) -> Column:
    return pointer.bitwiseAND((1 << LENGTH_BITS) - 1)


def held(bits: np.ndarray, fp: np.ndarray) -> np.ndarray:
    place = fp >> np.uint64(64 - (len(bits) * 8).bit_length() + 1)
    return (bits[(place >> np.uint64(3)).astype(np.int64)] >> (place & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


def bitmap(hashes: DataFrame) -> bytes:
    """One bit for each hash's leading bits: 2^22 words of 64 bits at most reach the driver, whatever the number of hashes."""
    bits = min(max((hashes.count() * BITS_EACH).bit_length(), BITMAP_BITS[0]), BITMAP_BITS[1])
    words = hashes.select(F.shiftright("h", HASH_BITS - bits).alias("place")).groupBy(F.shiftright("place", 6).alias("at")).agg(
        F.expr("bit_or(shiftleft(1L, cast(place % 64 as int)))").alias("bits")
    ).toArrow()
    out = np.zeros(1 << (bits - 6), np.int64)
    out[words["at"].to_numpy()] = words["bits"].to_numpy()
    return out.tobytes()


def phrases(rows: DataFrame, heads: DataFrame) -> DataFrame:
    """lang, phrase, k, a: the words of frequent keys, read at their pointers and verified there. rows as in counted."""
    window = F.shiftright("pointer", LENGTH_BITS + 20).bitwiseAND((1 << (PLACE_BITS - 20)) - 1)  # a very long text in pieces of 1 MiB
    tagged = heads.withColumn("tag", F.shiftright("pointer", PLACE_BITS + LENGTH_BITS))
    asked = tagged.groupBy("tag", window.alias("window")).agg(F.collect_list(F.struct("fp", "guard", "n", "pointer")).alias("heads"))
    # rows that no pointer means stay in their scanning task; copies of one text come down to one
    hashes = tagged.select(F.shiftleft("tag", 64 - TAG_BITS).alias("h"))
    meant = may_hold(rows, F.shiftleft("tag", 64 - TAG_BITS), hashes).where("__may").select("tag", "lang", "text").distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lang, text, asked_here = (batch.column(i) for i in range(3))
            found, langs, keys = [], [], []
            for name, body, wanted in zip(lang.to_pylist(), text.cast(pa.binary()).to_pylist(), asked_here, strict=True):
                cols = [wanted.values.field(c).to_numpy() for c in ("fp", "guard", "n", "pointer")]
                lengths = cols[3] & ((1 << LENGTH_BITS) - 1)
                places = cols[3] >> LENGTH_BITS & ((1 << PLACE_BITS) - 1)
                for k, at in zip(lengths.tolist(), places.tolist(), strict=True):
                    run_of_words = RUN[k].match(body, at) if k else None
                    found.append(b" ".join(run_of_words[0].lower().split()) if run_of_words else b"")
                langs += [name] * len(lengths)
                keys.append(np.stack([*cols, lengths]))
            if not found:
                continue
            fp, guard, n, _, k = np.concatenate(keys, axis=1)
            stretch = pa.array(found, pa.binary())
            body, offsets = bytes_of(stretch)
            names = pa.array(langs).dictionary_encode()
            number = np.array([lang_number(x) for x in names.dictionary.to_pylist()], np.uint64)[names.indices.to_numpy()]
            prefixes = Prefixes(body)
            own = prefixes.fingerprints(offsets[:-1], offsets[1:], number), prefixes.guards(offsets[:-1], offsets[1:], number)
            none = empty_phrase(number)
            same = (np.where(k > 0, own[0], none[0]) == fp.view(np.uint64)) & (np.where(k > 0, own[1], none[1]) == guard.view(np.uint64))
            out = pa.RecordBatch.from_arrays(
                [pa.array(langs, pa.string()), stretch.cast(pa.string(), safe=False), pa.array(k.astype(np.int32)), pa.array(np.ascontiguousarray(n))],
                names=["lang", "phrase", "k", "a"],
            )
            yield out.filter(pa.array(same))

    read = meant.join(asked, "tag").select("lang", "text", "heads").mapInArrow(run, "lang string, phrase string, k int, a long")
    return read.groupBy("lang", "phrase").agg(F.max("k").alias("k"), F.max("a").alias("a"))  # two equal texts may share a tag


def frequent(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", min_count: int = MIN_COUNT) -> DataFrame:
    """lang, phrase, k (words, 0 to 4), a (occurrences): all phrases of min_count occurrences, and each language's empty phrase."""
    own = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), whole_text(text_col).alias("text"))
    rows = own.withColumn("tag", F.xxhash64("lang", "text").bitwiseAND((1 << TAG_BITS) - 1))
    short, units = frequent_hashes(rows, min_count), in_units(rows)
    every = short.unionByName(frequent_hashes(units, min_count, bitmap(short)))
    return stored(phrases(rows, stored(counted(units, bitmap(every), min_count), "phrase-keys")), "phrases")


def scored(found: DataFrame) -> DataFrame:
    """lang, phrase, a, l, r, score of every candidate: the cut of lowest score, the earliest of equal ones. found as frequent gives it."""
    words = F.split("phrase", " ")
    cut = found.where("k >= 2").select("lang", "phrase", "a", "k", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("cut"))
    parts = cut.select(
        "lang", "phrase", "a", "cut", F.array_join(F.slice(words, F.lit(1), F.col("cut")), " ").alias("first"),
        F.array_join(F.slice(words, F.col("cut") + 1, F.col("k") - F.col("cut")), " ").alias("rest"),
    )
    known = found.where("k >= 1")
    sides = parts.join(known.select("lang", F.col("phrase").alias("first"), F.col("a").alias("l")), ["lang", "first"]).join(
        known.select("lang", F.col("phrase").alias("rest"), F.col("a").alias("r")), ["lang", "rest"]
    )
    score = F.expr(f"(cast(a AS decimal(20, 0)) * {SCALE}) div (cast(l AS decimal(20, 0)) + r)")
    best = sides.withColumn("score", score).groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "cut", "l", "r")).alias("best"))
    return best.select("lang", "phrase", "a", "best.l", "best.r", "best.score")


def covered(found: DataFrame) -> DataFrame:
    """lang, phrase, most: the occurrences of the commonest longer phrase that holds a phrase's words."""
    inside = F.flatten(F.transform(F.sequence(F.lit(2), F.col("k") - 1), lambda m: F.transform(
        F.sequence(F.lit(1), F.col("k") - m + 1), lambda i: F.array_join(F.slice(F.split("phrase", " "), i, m), " "))))
    return found.where("k >= 3").select("lang", "a", F.explode(inside).alias("phrase")).groupBy("lang", "phrase").agg(F.max("a").alias("most"))


def collocations(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", min_count: int = MIN_COUNT, kept: int = KEPT) -> DataFrame:
    """Each language's first `kept` phrases of 2 to 4 words: lang, rank, phrase, a, l, r, n, score.

    A null text counts as empty, a null language as und; empty texts and an empty table give nothing. Equal rows count each;
    ties of score and a go by the phrase's bytes. A text may have 2 GiB, as in Spark. Other columns are not read.
    """
    found = frequent(docs, lang_col, text_col, min_count)
    whole = found.where("k = 0").select("lang", F.col("a").alias("n"))
    uncovered = scored(found).join(covered(found), ["lang", "phrase"], "left").where(
        f"most IS NULL OR cast(most AS decimal(20, 0)) * 100 < cast(a AS decimal(20, 0)) * {COVERED}"
    )
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    first = uncovered.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= kept)
    return first.join(whole, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each language's first 2000 collocations."""
    return collocations(table(spark, sf_dir, "documents"))


SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
worded AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS words FROM pieces),
totals AS (SELECT lang, CAST(sum(len(words)) AS BIGINT) AS n FROM worded GROUP BY lang),
runs AS (
  SELECT lang, k, array_to_string(words[i : i + k - 1], ' ') AS phrase
  FROM (SELECT lang, words, k, unnest(range(1, len(words) - k + 2)) AS i FROM worded, (SELECT unnest([1, 2, 3, 4]) AS k))),
found AS (SELECT lang, k, phrase, count(*) AS a FROM runs GROUP BY lang, k, phrase HAVING count(*) >= 30),
cut AS (
  SELECT lang, phrase, k, a, string_split(phrase, ' ') AS words, unnest(range(1, k)) AS c FROM found WHERE k >= 2),
sides AS (
  SELECT cut.*, x.a AS l, y.a AS r, CAST(2000000::HUGEINT * cut.a // (x.a::HUGEINT + y.a) AS BIGINT) AS score
  FROM cut JOIN found x ON x.lang = cut.lang AND x.phrase = array_to_string(words[1 : c], ' ')
           JOIN found y ON y.lang = cut.lang AND y.phrase = array_to_string(words[c + 1 :], ' ')),
best AS (SELECT * FROM sides QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) = 1),
longer AS (
  SELECT lang, a, array_to_string(words[i : i + m - 1], ' ') AS phrase
  FROM (SELECT lang, a, words, k, m, unnest(range(1, k - m + 2)) AS i
        FROM (SELECT lang, a, k, string_split(phrase, ' ') AS words, unnest(range(2, k)) AS m FROM found WHERE k >= 3))),
covers AS (SELECT lang, phrase, max(a) AS most FROM longer GROUP BY lang, phrase),
kept AS (
  SELECT best.* FROM best LEFT JOIN covers ON covers.lang = best.lang AND covers.phrase = best.phrase
  WHERE most IS NULL OR 100::HUGEINT * most < 80::HUGEINT * a),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""
QUERIES = {"op12_collocations": op12_collocations}
ORACLES = {"op12_collocations": SQL}
