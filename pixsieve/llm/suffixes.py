"""Removal of repeated passages by a common-prefix-aware distributed merge sort of sampled suffixes.

Every string of `length` bytes has an anchor inside it, chosen by its content alone: the leftmost 50-byte run with the
smallest hash. So equal strings have their anchors at the same place, and it is enough to sort the suffixes that begin at
anchors (about one position in 26) together with the bytes that stand before them.

1. Blocks of documents send the hashes of their anchors' runs to shards (hash ranges), each with the number of different
   surroundings it has in the block. Shards answer where a run stands in another block too; an anchor whose run is unique
   belongs to no repeated string and is done with. A run of more surroundings than a few a block is hot.
2. Each block sorts what is left, drops suffixes equal in all their bytes to an earlier one of the block (they are
   repeats), and sends each shard a sorted, front-coded run: per suffix the length of the prefix shared with the one before
   and the bytes after it.
3. A shard merges the runs of all blocks with a loser tree that compares prefix lengths first and bytes only beyond them.
   The merge also yields the shared prefixes of neighbours, hence for every depth the groups of equal right parts; the left
   parts are ranked likewise. A string is a right group and a left group; all but its earliest place are repeats.
4. The anchors of hot runs take no part in 2 and 3, as all of a run's entries meet in one shard. Each of their strings goes
   its own way, by the hash of all its bytes: blocks ask which strings another block has too, send the bytes and earliest
   place of those, and shards answer which stand earlier. The edges of a hot line, different in every document, end with the
   question.
5. Blocks mark the bytes of repeated strings, count and hash what is left. Of their anchors they read what they noted in 2.

Strings are compared by their bytes; hashes only choose anchors and shards. Equal suffixes of a block travel once, and so do
equal strings of hot runs: a run costs a shard a few entries per block, however many documents hold it in whatever text.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixsieve.llm.blocks import MESSAGE, answered, blocks_for, by_shard, messages, pack_arrays, packed_rows, shard_bits, unpack_arrays, unpacked
from pixsieve.llm.common import stored, table, whole_text
from pixsieve.llm.radix import common_prefix
from pixsieve.llm.words import BASE, INVERSE, bytes_of, mixed, powers, room, slices

LENGTH = 100
BLOCK_BYTES = 6 << 20
#: Text whose anchors are worked out at once: the windows' minima take some 60 bytes for each of its bytes, and should stay in the cache.
ANCHOR_BYTES = (1 << 17) - (1 << 12)
#: The place of a run in such a stretch, as so many bits. The bits above them of a run's hash choose the anchors, everywhere.
PLACE_BITS = 17
#: A run is hot with more different surroundings than this in all, and than so many for each block.
HOT, HOT_PER_BLOCK = 256, 2
#: Strings whose bytes are gathered at once.
GATHERED = 1 << 14


def anchors(body: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Per anchor: its place, the first and last start of a string that it anchors, its run's hash, and that of all its
    strings' bytes and its place in them. Strings lie inside a text."""
    k = length // 2
    n = len(body)
    none = np.zeros(0, np.int64)
    if n < length:
        return none, none, none, np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    size = room(n)
    running = np.zeros(n + 1, np.uint64)
    np.cumsum((body.astype(np.uint64) + np.uint64(1)) * powers(BASE, size)[:n], out=running[1:])
    h = mixed((running[k:] - running[: n - k + 1]) * powers(INVERSE, size)[: n - k + 1])
    w = length - k + 1  # runs in a string
    where = smallest(h >> np.uint64(PLACE_BITS), w)
    starts = np.arange(len(where))
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[: len(where)]
    valid = starts + length <= offsets[1:][text]
    starts, where, text = starts[valid], where[valid], text[valid]
    if not len(starts):
        return none, none, none, np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    begins = np.flatnonzero(np.concatenate([[True], (where[1:] != where[:-1]) | (text[1:] != text[:-1])]))
    ends = np.append(begins[1:], len(starts)) - 1
    place, first, last = where[begins], starts[begins], starts[ends]
    around = mixed((running[last + length] - running[first]) * powers(INVERSE, size)[first] + (last - first).astype(np.uint64))
    # anchors' hashes are the smallest of many; mixed again they fall into all ranges alike
    return place, first, last, mixed(h[place] + np.uint64(1)), mixed(around + (place - first).astype(np.uint64))


def smallest(value: np.ndarray, w: int) -> np.ndarray:
    """The place of the smallest of w values from each place on, the leftmost if equal. Values leave PLACE_BITS bits free."""
    if len(value) <= 1 << PLACE_BITS:  # with its place below it, a value's minima are those of single numbers
        value = value << np.uint64(PLACE_BITS) | np.arange(len(value), dtype=np.uint64)
        span = 1
        while span < w:
            step = min(span, w - span)
            value = np.minimum(value[:-step], value[step:])
            span += step
        return (value & np.uint64((1 << PLACE_BITS) - 1)).astype(np.int64)
    where, span = np.arange(len(value), dtype=np.int32), 1
    while span < w:
        step = min(span, w - span)
        right = value[step:]
        keep = value[: len(right)] <= right
        where = np.where(keep, where[: len(right)], where[step:])
        value = np.where(keep, value[: len(right)], right)
        span += step
    return where.astype(np.int64)


class Rows:
    """A block's rows in (id, tag) order with their bytes, the same in every phase."""

    def __init__(self, packed, length: int):
        rows = unpacked(packed).sort_by([("order", "ascending"), ("id", "ascending"), ("tag", "ascending")])
        self.rows, self.length = rows, length
        self.order, self.tag = rows["order"].to_numpy(), rows["tag"].to_numpy()
        self.ids = rows["id"].fill_null(0).to_numpy()
        parts = [bytes_of(chunk) for chunk in rows["text"].chunks]
        self.body = np.concatenate([body for body, _ in parts]) if parts else np.zeros(0, np.uint8)
        self.sizes = np.concatenate([np.diff(offsets) for _, offsets in parts]) if parts else np.zeros(0, np.int64)
        self.begins = np.concatenate([[0], np.cumsum(self.sizes)])

    def strings(self, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The strings of hot runs, whose anchors have these first and last starts: where they start, in order, their hashes, and
        which of them is the first with the same bytes. One whose hash, but not bytes, an earlier one has counts as a first."""
        n = last - first + 1
        starts = np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())
        h = np.zeros(len(starts), np.uint64)
        for a in range(0, len(starts), GATHERED):
            at, own = starts[a : a + GATHERED], h[a : a + GATHERED]
            for j in range(self.length):
                own[:] = own * np.uint64(BASE) + (self.body[at + j].astype(np.uint64) + np.uint64(1))
        h = mixed(h)
        _, rep, inverse = np.unique(h, return_index=True, return_inverse=True)
        of = rep[inverse]
        again = np.flatnonzero(of != np.arange(len(of)))
        for a in range(0, len(again), GATHERED):
            own = again[a : a + GATHERED]
            other = own[(self.gathered(starts[own]) != self.gathered(starts[of[own]])).any(axis=1)]
            of[other] = other
        return starts, h, of

    def gathered(self, starts: np.ndarray) -> np.ndarray:
        """The bytes of strings, one a row."""
        return self.body[starts[:, None] + np.arange(self.length)]

class Block(Rows):
    """The same with their anchors."""

    def __init__(self, packed, length: int):
        super().__init__(packed, length)
        parts, base = [], 0
        for chunk in self.rows["text"].chunks:
            for a, b in slices(chunk, ANCHOR_BYTES):
                body, offsets = bytes_of(chunk.slice(a, b - a))
                place, first, last, h, around = anchors(body, offsets, length)
                parts.append((place + base, first + base, last + base, h, around))
                base += len(body)
        none = np.zeros(0, np.int64)
        empty = (none, none, none, none.astype(np.uint64), none.astype(np.uint64))
        self.place, self.first, self.last, self.hash, self.around = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else empty

    def kinds(self, replies, bits: int) -> np.ndarray:
        """Per anchor whether its run is unique (0), stands elsewhere too (1), or is hot (2)."""
        keys, at, n = np.unique(self.hash, return_inverse=True, return_counts=True)
        kind = (n > 1).astype(np.uint8)
        for (s, a, b), own in zip(by_shard(keys, bits), answers(replies, keys, bits), strict=True):
            kind[a:b] = np.maximum(kind[a:b], own)
        return kind[at]

    def survivors(self, kinds: np.ndarray, bits: int) -> tuple[list[tuple], list[int], np.ndarray]:
        """The anchors whose run is neither unique nor hot: (shard, suffix, bytes before reversed, least and most bytes before,
        row, place), sorted and without repeats of a suffix, what each stands for among the block's anchors, and the repeats."""
        kept = np.flatnonzero(kinds == 1)
        raw, shards = self.body.tobytes(), shards_of(self.hash[kept], bits).tolist()
        text = (np.searchsorted(self.begins, self.place[kept], "right") - 1).tolist()
        rows = []
        for i, s, t, x, lo, hi in zip(kept.tolist(), shards, text, self.place[kept].tolist(), self.first[kept].tolist(), self.last[kept].tolist(), strict=True):
            rows.append((s, raw[x : hi + self.length], raw[lo:x][::-1], x - hi, x - lo, t, x, i))
        rows.sort()
        single, repeats = [], []
        for r in rows:  # sorted: the first of equal ones is the earliest
            if single and single[-1][:5] == r[:5]:
                repeats.append(r[7])
            else:
                single.append(r)
        return single, [r[7] for r in single], np.array(repeats, np.int64)


def shards_of(h: np.ndarray, bits: int) -> np.ndarray:
    return (h >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(h), np.int64)


def answers(replies, keys: np.ndarray, bits: int) -> list[np.ndarray]:
    """The shards' replies about a block's sorted keys, in the order of by_shard."""
    got = dict(zip(replies["shard"].to_pylist(), replies["packed"], strict=True))
    return [unpack_arrays(got[s].as_buffer())[0] for s, _, _ in by_shard(keys, bits)]


def of_kind(replies, kind: int):
    return replies.filter(pa.array([k == kind for k in replies["kind"].to_pylist()], pa.bool_()))


def ask_runs(bits: int, length: int):
    """Phase 1, blocks: the distinct hashes of anchored runs, and how many surroundings each has."""

    def run(key, part):
        block = Block(part["packed"], length)
        order = np.lexsort((block.around, block.hash))
        h, around = block.hash[order], block.around[order]
        fresh = np.ones(len(h), bool)
        fresh[1:] = (h[1:] != h[:-1]) | (around[1:] != around[:-1])
        keys, n = np.unique(h[fresh], return_counts=True)
        n = n.astype(np.uint32)
        return messages([(s, key[0].as_py(), pack_arrays(keys[a:b], n[a:b])) for s, a, b in by_shard(keys, bits)])

    return run


def shared_runs(hot: int):
    """Phase 1, shards: which hashes another block sent too (1), and which have more than `hot` surroundings (2)."""

    def answer(asked: list[list[np.ndarray]]) -> list[tuple[np.ndarray]]:
        keys, at, n = np.unique(np.concatenate([m[0] for m in asked]), return_inverse=True, return_counts=True)
        around = np.bincount(at, weights=np.concatenate([m[1] for m in asked]), minlength=len(keys))
        kind = np.where(around > hot, 2, n > 1).astype(np.uint8)
        return [(kind[np.searchsorted(keys, m[0])],) for m in asked]

    return answer


def shared_strings(asked: list[list[np.ndarray]]) -> list[tuple[np.ndarray]]:
    """Hot runs, shards: which strings' hashes another block sent too."""
    keys, n = np.unique(np.concatenate([m[0] for m in asked]), return_counts=True)
    return [(n[np.searchsorted(keys, m[0])] > 1,) for m in asked]


def shared_firsts(h: np.ndarray, of: np.ndarray, replies, bits: int) -> np.ndarray:
    """Which strings of hot runs a block sends, sorted by hash: the first of each that another block may have too."""
    keys, rep, inverse = np.unique(h, return_index=True, return_inverse=True)
    shared = np.concatenate([np.zeros(0, bool), *answers(replies, keys, bits)])
    number = np.arange(len(h))
    own = np.flatnonzero((of == number) & (shared[inverse] | (rep[inverse] != number)))
    return own[np.argsort(h[own], kind="stable")]


def noted(replies) -> list[np.ndarray]:
    """What a block noted in phase 2: first and last starts of the anchors that are repeats in it, the others' places and shards as it
    sent them, first and last starts of hot runs' anchors."""
    return unpack_arrays(of_kind(replies, 5)["packed"][0].as_buffer())


def send_strings(bits: int, length: int):
    """Hot runs, blocks: bytes and earliest places of strings that another block may have too."""

    def run(key, part, replies):
        asked = of_kind(replies, 3)
        if not part.num_rows or not asked.num_rows:
            return messages([])
        block = Rows(part["packed"], length)
        starts, h, of = block.strings(*noted(replies)[4:])
        own = shared_firsts(h, of, asked, bits)
        out = []
        for s, a, b in by_shard(h[own], bits):
            at = starts[own[a:b]]
            text = np.searchsorted(block.begins, at, "right") - 1
            out.append((s, key[0].as_py(), pack_arrays(block.gathered(at).ravel(), block.order[text], block.ids[text], block.tag[text], at - block.begins[text])))
        return messages(out)

    return run


def later_strings(length: int):
    """Hot runs, shards: which strings stand in an earlier place too."""

    def answer(asked: list[list[np.ndarray]]) -> list[tuple[np.ndarray]]:
        body, *place = (np.concatenate([m[k] for m in asked]) for k in range(5))
        _, string = np.unique(body.view(f"V{length}"), return_inverse=True)
        order = np.lexsort((*place[::-1], string))
        later = np.zeros(len(order), bool)
        later[order[1:]] = string[order[1:]] == string[order[:-1]]
        ends = np.cumsum([len(m[1]) for m in asked])
        return [(later[b - len(m[1]) : b],) for m, b in zip(asked, ends.tolist(), strict=True)]

    return answer


def send_suffixes(bits: int, length: int):
    """Phase 2, blocks: to even shards a sorted, front-coded run of suffixes, to odd ones the hashes of hot runs' strings, and to
    itself, below 0, what it needs of its anchors later."""

    def run(key, part, replies):
        if not part.num_rows:
            return messages([])
        block = Block(part["packed"], length)
        kinds = block.kinds(replies, bits)
        rows, own, repeats = block.survivors(kinds, bits)
        hot = np.flatnonzero(kinds == 2)
        ends = block.first[hot], block.last[hot]
        number, shards = key[0].as_py(), np.array([r[0] for r in rows], np.int64)
        note = pack_arrays(block.first[repeats], block.last[repeats], block.place[np.array(own, np.int64)], shards, *ends)
        out, at = [(-1 - number, number, note)], 0
        while at < len(rows):
            to = at
            while to < len(rows) and rows[to][0] == rows[at][0]:
                to += 1
            out.append((2 * rows[at][0], number, front_coded(rows[at:to], block)))
            at = to
        keys = np.unique(block.strings(*ends)[1])
        return messages(out + [(2 * s + 1, number, pack_arrays(keys[a:b])) for s, a, b in by_shard(keys, bits)])

    return run


def front_coded(rows: list[tuple], block: Block) -> bytes:
    shared, tails, before = [], [], b""
    for r in rows:
        n = common_prefix(before, r[1])
        shared.append(n)
        tails.append(r[1][n:])
        before = r[1]
    text = np.array([r[5] for r in rows], np.int64)
    numbers = lambda x, kind: np.array(x, kind)
    width = np.uint8 if block.length <= 255 else np.int32
    return pack_arrays(
        numbers(shared, width), numbers([len(t) for t in tails], width), np.frombuffer(b"".join(tails), np.uint8),
        numbers([len(r[2]) for r in rows], width), np.frombuffer(b"".join(r[2] for r in rows), np.uint8),
        numbers([r[3] for r in rows], width), numbers([r[4] for r in rows], width),
        block.order[text], block.ids[text], block.tag[text], numbers([r[6] for r in rows], np.int64) - block.begins[text],
    )


def decoded(shared: np.ndarray, sizes: np.ndarray, tails: np.ndarray) -> list[bytes]:
    """The suffixes of a front-coded run."""
    raw, at, before, out = tails.tobytes(), 0, b"", []
    for n, size in zip(shared.tolist(), sizes.tolist(), strict=True):
        before = before[:n] + raw[at : at + size]
        at += size
        out.append(before)
    return out


def merged(runs: list[list[bytes]], shared: list[list[int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Loser-tree merge of sorted runs: for each output its run, its place in the run, and the prefix it shares with the output before.

    A player is the head of a run with the prefix length it shares with the last winner. The longer such prefix is the
    smaller string; bytes are compared only from equal lengths on, and the loser remembers how far. The next string of the
    winning run brings its length from the run's own front coding.
    """
    players = 1 << max(0, (len(runs) - 1).bit_length())
    head = [r[0] if r else None for r in runs] + [None] * (players - len(runs))
    known = [0] * players
    at = [0] * players
    losers = [-1] * players

    def play(a: int, b: int) -> tuple[int, int]:
        """Winner and loser; the loser's prefix length becomes that to the winner."""
        x, y = head[a], head[b]
        if x is None:
            return b, a
        if y is None:
            return a, b
        p, q = known[a], known[b]
        if p != q:
            return (a, b) if p > q else (b, a)
        if x == y:
            known[max(a, b)] = len(x)
            return (a, b) if a < b else (b, a)
        n = p + common_prefix(x[p:], y[p:])
        first, second = (a, b) if x[n:] < y[n:] else (b, a)
        known[second] = n
        return first, second

    def start(node: int) -> int:
        if node >= players:
            return node - players
        winner, losers[node] = play(start(2 * node), start(2 * node + 1))
        return winner

    winner = start(1) if players > 1 else 0
    order, place, prefix = [], [], []
    while head[winner] is not None:
        order.append(winner)
        place.append(at[winner])
        prefix.append(known[winner])
        at[winner] += 1
        if at[winner] < len(runs[winner]):
            head[winner], known[winner] = runs[winner][at[winner]], shared[winner][at[winner]]
        else:
            head[winner] = None
        node = (winner + players) >> 1
        while node:
            other = losers[node]
            x, p, q = head[winner], known[winner], known[other]
            if x is not None and head[other] is not None and p != q:  # decided by the prefixes alone
                if q > p:
                    losers[node], winner = winner, other
            else:
                winner, losers[node] = play(winner, other)
            node >>= 1
    return np.array(order, np.int64), np.array(place, np.int64), np.array(prefix, np.int64)


def covers(asked: list[list[np.ndarray]], length: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Phase 3, shards: per suffix of each block how many bytes before and from the anchor lie in repeated strings (0, 0: none)."""
    runs = [decoded(*m[:3]) for m in asked]
    order, place, prefix = merged(runs, [m[0].tolist() for m in asked])
    begins = np.concatenate([[0], np.cumsum([len(r) for r in runs])])
    entry = begins[order] + place  # in sorted order, numbers by block
    n = len(entry)
    column = lambda k: np.concatenate([m[k] for m in asked])[entry]
    least, most = column(5).astype(np.int64), column(6).astype(np.int64)
    rank = np.empty(n, np.int64)
    rank[np.lexsort((column(10), column(9), column(8), column(7)))] = np.arange(n)
    lengths, flat = np.concatenate([m[3] for m in asked]).astype(np.int64), np.concatenate([m[4] for m in asked])
    depth = int(lengths.max(initial=0))
    left = np.zeros((n, max(1, depth)), np.uint8)
    row = np.repeat(np.arange(n), lengths)
    left[row, np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    left = left[entry]
    by_left = np.argsort(np.ascontiguousarray(left).view(f"S{left.shape[1]}").ravel(), kind="stable")
    same = left[by_left[1:]] == left[by_left[:-1]]
    left_prefix = np.concatenate([[-1], np.where(same.all(axis=1), left.shape[1], np.argmin(same, axis=1))])
    before, after = np.zeros(n, np.int64), np.zeros(n, np.int64)
    prefix[:1] = -1
    group_left = np.empty(n, np.int64)
    for d in range(int(least.min(initial=0)), int(most.max(initial=-1)) + 1):
        valid = np.flatnonzero((least <= d) & (d <= most))
        if not len(valid):
            continue
        right = np.cumsum(prefix < length - d)
        group_left[by_left] = np.cumsum(left_prefix < d)
        key = right[valid] * (n + 1) + group_left[valid]
        first = np.lexsort((rank[valid], key))
        repeat = valid[first[1:][key[first[1:]] == key[first[:-1]]]]
        before[repeat] = np.maximum(before[repeat], d)
        after[repeat] = np.maximum(after[repeat], length - d)
    out_before, out_after = np.zeros(n, np.int64), np.zeros(n, np.int64)
    out_before[entry], out_after[entry] = before, after
    width = np.uint8 if length <= 255 else np.int32
    return [(out_before[a:b].astype(width), out_after[a:b].astype(width)) for a, b in zip(begins[:-1], begins[1:], strict=True)]


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept_text binary"


def cut_block(bits: int, length: int, with_text: bool):
    """Phase 5, blocks: marks, counts and hashes."""

    def run(key, part, replies):
        if not part.num_rows:
            return empty_result()
        block, second = Rows(part["packed"], length), of_kind(replies, 2)
        repeats_first, repeats_last, place, shards, *hot = noted(replies)
        got = dict(zip(second["shard"].to_pylist(), second["packed"], strict=True))
        step = np.zeros(len(block.body) + 1, np.int32)
        np.add.at(step, repeats_first, 1)
        np.add.at(step, repeats_last + length, -1)
        for s in np.unique(shards):
            mine = place[shards == s]
            before, after = (x.astype(np.int64) for x in unpack_arrays(got[int(s)].as_buffer()))
            hit = np.flatnonzero(after > 0)
            np.add.at(step, mine[hit] - before[hit], 1)
            np.add.at(step, mine[hit] + after[hit], -1)
        starts, h, of = block.strings(*hot)
        if len(starts):
            sent = shared_firsts(h, of, of_kind(replies, 3), bits)
            later = np.concatenate([np.zeros(0, bool), *answers(of_kind(replies, 4), h[sent], bits)])
            repeats = starts[np.concatenate([np.flatnonzero(of != np.arange(len(of))), sent[later]])]
            np.add.at(step, repeats, 1)
            np.add.at(step, repeats + length, -1)
        gone = np.cumsum(step[:-1]) > 0
        removed, spans, digest, texts = [], [], [], []
        for a, b in zip(block.begins[:-1], block.begins[1:], strict=True):
            g = gone[a:b]
            removed.append(int(g.sum()))
            spans.append(int(g[:1].sum() + (g[1:] & ~g[:-1]).sum()))
            kept = block.body[a:b][~g].tobytes()
            digest.append(hashlib.sha256(kept).hexdigest())
            texts.append(kept if with_text else None)
        return pa.table(
            [block.rows["id"], pa.array(block.sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(digest, pa.string()), pa.array(texts, pa.binary())],
            names=[x.split()[0] for x in RESULT.split(", ")],
        )

    return run


def empty_result() -> pa.Table:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
    return pa.table([pa.array([], k) for k in kinds], names=[x.split()[0] for x in RESULT.split(", ")])


def cut_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, block_bytes: int = BLOCK_BYTES, with_text: bool = True, hot: int | None = None) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept_text (the bytes that stay, if asked for).

    A byte goes where it lies in a string of `length` bytes that also starts earlier: in a document of smaller id, or
    earlier in the same. Null texts count as empty; texts shorter than `length` lose nothing; null ids come last, rows that
    repeat an id stand in an order set by their texts; an empty table gives no rows; other columns are not read. A run of
    more than `hot` surroundings is dealt out by its strings; the result does not depend on it.
    """
    text = whole_text(text_col).cast("binary")
    rows = docs.select(
        F.col(id_col).isNull().cast("int").alias("order"), F.col(id_col).cast("long").alias("id"),
        F.xxhash64(text).alias("tag"), text.alias("text"),
    )
    blocks = blocks_for(rows, F.col("text"), block_bytes)
    bits = shard_bits(blocks)
    packed = packed_rows(rows, blocks, F.struct("id", "tag"))
    asked = packed.groupBy("block").applyInArrow(ask_runs(bits, length), MESSAGE)
    hot = max(HOT, HOT_PER_BLOCK * blocks) if hot is None else hot
    common = stored(answered(asked, shared_runs(hot)), "common-runs", "uncompressed")
    sent = packed.groupBy("block").cogroup(common.groupBy("block")).applyInArrow(send_suffixes(bits, length), MESSAGE)
    marks = stored(answered(sent, lambda m: covers(m, length), shared_strings), "repeat-marks", "uncompressed")
    kind = F.when(F.col("shard") < 0, 5).when(F.col("shard") % 2 == 0, 2).otherwise(3)
    replies = marks.select(F.floor(F.col("shard") / 2).cast("int").alias("shard"), "block", "packed", kind.alias("kind"))
    if not marks.where("shard % 2 = 1").isEmpty():
        strings = packed.groupBy("block").cogroup(replies.where("kind <> 2").groupBy("block")).applyInArrow(send_strings(bits, length), MESSAGE)
        later = stored(answered(strings, later_strings(length)), "later-strings", "uncompressed")
        replies = replies.union(later.withColumn("kind", F.lit(4)))
    cut = packed.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(cut_block(bits, length, with_text), RESULT)
    return cut if with_text else cut.drop("kept_text")


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the passages that stand earlier."""
    return cut_repeats(table(spark, sf_dir, "documents"), with_text=False)


QUERIES = {"op7_suffix_dedup": op7_suffix_dedup}
ORACLES: dict[str, str] = {}
