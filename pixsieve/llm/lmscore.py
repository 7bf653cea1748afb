"""Log probability of whole texts under a weighted backoff automaton learned from the training documents.

Words and pairs are counted over all training documents by sharded count joins (see blocks), each block asking for its own.
The model interpolates a pair's discounted count with the smoothed unigram; the query keeps
every pair, however rare; the discounts come from the counts of counts. As an automaton: a state for every word that has kept successors and one root;
arcs from a state carry log10 P(word | state); the failure arc carries log10 of the state's backoff weight to the root,
which has an arc for every word and one for the unknown. A block's texts are read left to right side by side, every
text carrying its state and its sum.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixsieve.llm.blocks import MESSAGE, blocks_for, by_shard, messages, pack_arrays, packed_rows, shard_bits, unpack_arrays, unpacked
from pixsieve.llm.common import light_cogroup, light_group, remainder, stored, table, whole_text
from pixsieve.llm.words import BASE, mixed, slices, word_hashes

#: A block takes some twenty times its text while it is scored, and two of them meet on an executor of two cores.
BLOCK_BYTES = 7 << 20
#: Pairs that occur less often are left to the backoff, unless a caller keeps all (1, as the query does).
KEPT = 2
END = np.uint64(0xE17A1465E17A1465)


def block_words(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Word numbers of all texts, each with its end, and how many each has. A text column of many chunks is one run."""
    out, sizes = [], []
    for chunk in rows["text"].chunks:
        for a, b in slices(chunk):
            words, counts, _, _ = word_hashes(chunk.slice(a, b - a))
            out.append(np.insert(words, np.cumsum(counts), END))
            sizes.append(counts + 1)
    return (np.concatenate(out), np.concatenate(sizes)) if out else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


def pair_keys(words: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The number of (word before, word) for every word with one before it in its text, and where those words are."""
    first = np.zeros(len(words), bool)
    first[np.cumsum(counts) - counts] = True
    at = np.flatnonzero(~first)
    return pair_of(words[at - 1], words[at]), at


def pair_of(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mixed(a * np.uint64(BASE) + b)


def counted(keys: np.ndarray, train: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, and how often each occurs in training text."""
    found, at = np.unique(keys, return_inverse=True)
    return found, np.bincount(at[train], minlength=len(found)).astype(np.uint32)


def ask(bits: int):
    """A block's messages, with training counts: to even shards its words, to odd ones its pairs, those of training text
    with the place of their first word among the block's words."""

    def run(key, part):
        block = key[0].as_py()
        rows = unpacked(part["packed"])
        words, counts = block_words(rows)
        train = np.repeat(~rows["held_out"].to_numpy(), counts)
        vocabulary, n = counted(words, train)
        out = [(2 * s, block, pack_arrays(vocabulary[a:b], n[a:b])) for s, a, b in by_shard(vocabulary, bits)]
        pairs, at = pair_keys(words, counts)
        found, n = counted(pairs, train[at])
        before = np.zeros(len(found), np.uint32)
        before[np.searchsorted(found, pairs)] = np.searchsorted(vocabulary, words[at - 1])
        some = n > 0
        for s, a, b in by_shard(found, bits):
            out.append((2 * s + 1, block, pack_arrays(found[a:b], n[a:b], before[a:b][some[a:b]])))
        return messages(out)

    return run


def merge(asked: list[list[np.ndarray]]) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """All distinct keys of a shard, where each block's keys are among them, and the summed counts."""
    keys = np.unique(np.concatenate([m[0] for m in asked]))
    places = [np.searchsorted(keys, m[0]) for m in asked]
    total = np.zeros(len(keys), np.int64)
    for at, m in zip(places, asked, strict=True):
        total[at] += m[1]
    return keys, places, total


#: What is told of a first word's kept pairs: their count, and how many occur once, twice and more often.
HELD = 4
COUNTED = "shard int, block int, packed binary, kind int"


def count_shard(bits: int, kept: int):
    """Sums of a shard: replies to the blocks (kind 0: totals in asking order); of words, the blocks' questions again (kind
    4); of pairs, what the kept ones hold of their first words, each told to one block that counted it (kind 1); and sums
    over all keys (kind 2)."""

    def run(key, part):
        part = part.sort_by("block")
        shard, blocks = key[0].as_py(), part["block"].to_pylist()
        asked = [unpack_arrays(x.as_buffer()) for x in part["packed"]]
        keys, places, total = merge(asked)
        out = [(shard, b, pack_arrays(total[at].astype(np.uint32 if total.max(initial=0) < 1 << 32 else np.int64)), 0) for b, at in zip(blocks, places, strict=True)]
        if shard % 2:
            told = np.zeros(len(keys), bool)
            for b, at, m in zip(blocks, places, asked, strict=True):
                own = at[m[1] > 0]
                mine = np.flatnonzero(~told[own] & (total[own] >= kept))
                told[own] = True
                word, where = np.unique(m[2][mine], return_inverse=True)
                n = total[own[mine]]
                held = [np.bincount(where, weights=w, minlength=len(word)).astype(np.int64) for w in (n, n == 1, n == 2, n > 2)]
                out.append((shard, b, pack_arrays(word, *held), 1))
            sums = [int((total == k).sum()) for k in (1, 2, 3, 4)]
        else:
            out += [(shard, b, pack_arrays(m[0]), 4) for b, m in zip(blocks, asked, strict=True)]
            sums = [int(total.sum()), int((total > 0).sum())]
        out.append((shard, -1, pack_arrays(np.array(sums, np.int64)), 2))
        cols = list(zip(*out, strict=True))
        return pa.table([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.binary()), pa.array(cols[3], pa.int32())], names=["shard", "block", "packed", "kind"])

    return run


def spell_block(bits: int):
    """For a block: what it was told of its words' places (kind 1), by the words themselves, to the words' shards."""

    def run(key, told, words):
        if not told.num_rows or not words.num_rows:
            return messages([])
        # shards are ranges of keys: in their order the block's questions are its sorted words
        vocabulary = np.concatenate([unpack_arrays(x.as_buffer())[0] for x in words.sort_by("of_shard")["keys"]])
        sums = np.zeros((HELD, len(vocabulary)), np.int64)
        for x in told["packed"]:
            word, *parts = unpack_arrays(x.as_buffer())
            for k in range(HELD):
                sums[k][word] += parts[k]
        some = np.flatnonzero(sums[0])
        return messages([(2 * s, key[0].as_py(), pack_arrays(vocabulary[some[a:b]], *(x[some[a:b]] for x in sums))) for s, a, b in by_shard(vocabulary[some], bits)])

    return run


def weigh_shard(key, asked, held):
    """For a shard of words: to each block, what kept pairs hold of each of its words as first word (count, ones, twos, more)."""
    if not asked.num_rows:
        return messages([])
    asked = asked.sort_by("block")
    wanted = [unpack_arrays(x.as_buffer()) for x in asked["packed"]]
    keys = np.unique(np.concatenate([m[0] for m in wanted]))
    sums = np.zeros((HELD, len(keys)), np.int64)
    for x in held["packed"]:
        word, *parts = unpack_arrays(x.as_buffer())
        at = np.searchsorted(keys, word)
        for k in range(HELD):
            sums[k][at] += parts[k]
    out = []
    for block, m in zip(asked["block"].to_pylist(), wanted, strict=True):
        at = np.searchsorted(keys, m[0])
        some = np.flatnonzero(sums[0][at])
        out.append((key[0].as_py(), block, pack_arrays(some, *(sums[k][at][some] for k in range(HELD)))))
    return messages(out)


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float]:
    """What kept pairs of count 2 and of more give to the backoff."""
    if not (n1 and n2 and n3):
        return 0.75, 0.75
    y = n1 / (n1 + 2 * n2)
    return min(max(2 - 3 * y * n3 / n2, 0.1), 1.9), min(max(3 - 4 * y * n4 / n3, 0.1), 2.9)


def once_discount(n1: int, n2: int) -> float:
    """What kept pairs of count 1 give to the backoff."""
    return n1 / (n1 + 2 * n2) if n1 and n2 else 0.75


class Automaton:
    """States, arcs and failure arcs that one block can meet, as arrays.

    words: sorted numbers; state k > 0 is the word at places[k - 1]. arc_keys: sorted numbers of (state's word, word).
    """

    def __init__(self, words: np.ndarray, root: np.ndarray, fail: np.ndarray, arc_keys: np.ndarray, arcs: np.ndarray):
        self.words, self.root, self.fail, self.arc_keys, self.arcs = words, root, fail, arc_keys, arcs

    def read(self, words: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """log10 probability of each text, all read side by side from left to right."""
        total = np.zeros(len(counts))
        if not len(words):
            return total
        place = np.searchsorted(self.words, words)
        keyed, at = pair_keys(words, counts)
        arc = np.full(len(words), -1, np.int64)
        if len(self.arc_keys):
            found = np.minimum(np.searchsorted(self.arc_keys, keyed), len(self.arc_keys) - 1)
            arc[at] = np.where(self.arc_keys[found] == keyed, found, -1)
        order = np.argsort(-counts, kind="stable")
        begins, live = (np.cumsum(counts) - counts)[order], -np.sort(-counts)
        sums, state = np.zeros(len(counts)), np.full(len(counts), -1, np.int64)  # -1: the root
        for step in range(int(live[0])):
            n = int(np.searchsorted(-live, -step, "left"))  # texts that have a word here
            where = begins[:n] + step
            take, now = arc[where], place[where]
            own = state[:n]
            weight = self.root[now]  # the root's arc, after the failure arc of a state without this one
            weight = weight + np.where(own >= 0, self.fail[own], 0.0)
            by_arc = take >= 0
            weight[by_arc] = self.arcs[take[by_arc]]
            sums[:n] += weight
            state[:n] = now
        total[order] = sums
        return total


def score_block(bits: int, n_train: int, n_words: int, cuts: tuple[float, float, float], least: int):
    """A block's rows from its packed texts and the replies to its questions."""

    def run(key, part, replies):
        rows = unpacked(part["packed"])
        words, counts = block_words(rows)
        got = {(k, s): unpack_arrays(x.as_buffer()) for k, s, x in zip(replies["kind"].to_pylist(), replies["shard"].to_pylist(), replies["packed"], strict=True)}
        vocabulary, where = np.unique(words, return_inverse=True)
        c = np.zeros(len(vocabulary), np.int64)
        held = np.zeros((HELD, len(vocabulary)), np.int64)
        for s, a, b in by_shard(vocabulary, bits):
            c[a:b] = got[0, 2 * s][0]
            some, *parts = got[3, 2 * s]
            for k in range(HELD):
                held[k][a:b][some] = parts[k]
        pairs, at = pair_keys(words, counts)
        found, first = np.unique(pairs, return_index=True)
        n = np.zeros(len(found), np.int64)
        for s, a, b in by_shard(found, bits):
            n[a:b] = got[0, 2 * s + 1][0]
        del got, pairs  # what is not needed beside the automaton goes first
        before, after = where[at - 1][first], where[at][first]
        unigram = (c + 0.5) / (n_train + 0.5 * (n_words + 1))
        d1, d2, d3 = cuts
        # what kept pairs hold of a word, less their discounts; the rest goes on to the root
        backoff = np.where(c > 0, 1 - (held[0] - d1 * held[1] - d2 * held[2] - d3 * held[3]) / np.maximum(c, 1), 1.0)
        kept = np.flatnonzero(n >= least)
        share = (n[kept] - np.select([n[kept] == 1, n[kept] == 2], [d1, d2], d3)) / np.maximum(c[before[kept]], 1)
        arcs = np.log10(share + backoff[before[kept]] * unigram[after[kept]])
        machine = Automaton(vocabulary, np.log10(unigram), np.log10(backoff), found[kept], arcs)
        del found, first, n, before, after, kept, share, at
        docs = np.repeat(np.arange(len(counts)), counts)
        base = np.bincount(docs, weights=np.log10(unigram)[where], minlength=len(counts))
        known = np.bincount(docs, weights=(c > 0)[where], minlength=len(counts)).astype(np.int64)
        del docs, where
        return pa.table([
            rows["id"], rows["held_out"], pa.array(counts, pa.int64()), pa.array(known), pa.array(np.full(len(counts), n_train)),
            pa.array(base), pa.array(machine.read(words, counts)),
        ], names=[x.split()[0] for x in SCORED.split(", ")])

    return run


SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES, kept: int = KEPT) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Words are compared by 64-bit numbers. Null and empty texts are their end alone; a null id belongs to the part of the
    empty text's remainder; repeated rows each count and score; an empty table gives no rows; other columns are not read.
    """
    text = whole_text(text_col)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), (remainder(id_col) == 1).alias("held_out"), text.alias("text"))
    blocks = blocks_for(rows, F.col("text"), block_bytes)
    bits = shard_bits(blocks)
    packed = packed_rows(rows, blocks, F.struct("id", "text"))
    asked = packed.groupBy("block").applyInArrow(light_group(ask(bits)), MESSAGE)
    counts = stored(asked.groupBy("shard").applyInArrow(light_group(count_shard(bits, kept)), COUNTED), "lm-counts", "uncompressed")
    n_train = n_words = 0
    sums = np.zeros(4, np.int64)
    for shard, values in counts.where("kind = 2").select("shard", "packed").collect():  # a few numbers a shard
        found = unpack_arrays(bytes(values))[0]
        if shard % 2:
            sums += found
        else:
            n_train, n_words = n_train + int(found[0]), n_words + int(found[1])
    words = counts.where("kind = 4").drop("kind")
    # both sides come from one table: the second takes column names of its own
    asked_words = words.select(F.col("shard").alias("of_shard"), F.col("block").alias("at_block"), F.col("packed").alias("keys"))
    held = counts.where("kind = 1").drop("kind").groupBy("block").cogroup(asked_words.groupBy("at_block")).applyInArrow(light_cogroup(spell_block(bits)), MESSAGE)
    held = words.groupBy("shard").cogroup(held.groupBy("shard")).applyInArrow(light_cogroup(weigh_shard), MESSAGE)
    replies = counts.where("kind = 0").union(held.withColumn("kind", F.lit(3)))
    scored = packed.groupBy("block").cogroup(replies.groupBy("block"))
    ones = sums.tolist()
    cuts = once_discount(ones[0], ones[1]), *discounts(*ones)
    return scored.applyInArrow(light_cogroup(score_block(bits, n_train, n_words, cuts, kept)), SCORED)


def op9_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's log probability beside its unigram base."""
    return scores(table(spark, sf_dir, "documents"), kept=1)


QUERIES = {"op9_lm_score": op9_lm_score}
ORACLES: dict[str, str] = {}
