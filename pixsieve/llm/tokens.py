"""Token ids as binary files: frequency-ranked ids in byte-aligned variable-length codes with separate control bytes.

1. Texts are cut at white space, the distinct chunks of a batch are encoded once by the tokenizer (its rules never join
   across white space) and every document's ids are gathered from them; the ids are stored in the shared folder.
2. Ids are counted over all documents and ranked, most frequent first; the ranking is bounded by the vocabulary.
3. Documents are range-partitioned and sorted by id. A file holds a stretch of ascending documents; a document is two byte
   strings: control bytes (two bits an id, its byte length less one, four ids a byte) and the ranks' low bytes.
4. Reading looks up four lengths a control byte in a table of 256 rows and gathers the ranks with numpy. The ranking is
   written beside the documents, so that any later session can read them.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pixsieve.llm.common import light, shared_folder, stored, table, whole_text

END_ID = 2
#: Byte lengths of the four ids of each control byte.
LENGTHS = ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3).astype(np.uint8) + 1
#: Text handled at once, and distinct chunks remembered by a worker.
SLICE_BYTES = 16 << 20
REMEMBERED = 800_000
#: A sign that stands alone between chunks encoded together.
MARK = "\x01"
#: What may stand behind a chunk's core: ASCII punctuation.
STOPS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
#: Rules that leave a run of lower-case letters as it is, whole, and the letters for which this is used.
RULES = (
    {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
)
LETTERS = "^[a-zß-öø-ÿ]+$"
FILE = "doc_id long, part int, at long, n_tokens long, control binary, data binary"


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@lru_cache(maxsize=2)
def tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path), {}


@lru_cache(maxsize=2)
def letter_tokenizer(path: str):
    """The same vocabulary for runs of LETTERS alone, without the rules that do nothing to them; none if the rules are others."""
    from tokenizers import Tokenizer, pre_tokenizers

    tok = tokenizer(path)[0]
    if tok.normalizer is None or tok.pre_tokenizer is None:
        return None
    normalizer, cut = (json.loads(x.__getstate__()) for x in (tok.normalizer, tok.pre_tokenizer))
    if (normalizer, cut) != (RULES[0], {"type": "Sequence", "pretokenizers": list(RULES[1:])}):
        return None
    plain = Tokenizer(tok.model)
    plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    return plain


def binary_column(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Binary values that lie one after the other in data; ends in bytes."""
    offsets = np.zeros(len(ends) + 1, np.int32)
    offsets[1:] = ends
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])


def spans(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indices of all spans, one span after the other."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)


def parted(chunks: pa.Array) -> tuple[pa.Array, pa.Array]:
    """What each chunk is encoded as: its core and the punctuation behind it, which the rules never join, the core in lower
    case where it is ASCII and the letters of Latin-1 (the tokenizer lower-cases itself). A chunk whose core ends otherwise than
    in a letter or digit, once normalised, or that may hold a special token, is whole."""
    trimmed = pc.ascii_rtrim(chunks, characters=STOPS)
    simple = pc.match_substring_regex(trimmed, "^[\\x00-\\x7fÀ-ÿ]*$")
    normal = pc.if_else(simple, trimmed, pc.utf8_normalize(pc.if_else(simple, "", trimmed), "NFC"))
    ends = pc.and_(pc.match_substring_regex(normal, r"[\p{L}\p{N}]$"), pc.invert(pc.ends_with(normal, "İ")))  # its lower case ends in a dot
    splits = pc.and_(ends, pc.invert(pc.match_substring(chunks, "<|")))
    tails = pc.extract_regex(chunks, r"(?P<tail>[!-/:-@\[-`{-~]*)$").field("tail")
    lower = pc.if_else(simple, pc.utf8_lower(trimmed), trimmed)
    return pc.if_else(splits, lower, chunks), pc.if_else(splits, tails, "")


def encode_new(tok, known: dict, words: list[str], width: np.dtype) -> None:
    """Encodes chunks a hundred at a time, a mark of one id between them; chunks that hold the mark's sign go alone."""
    mark = tok.encode(MARK, add_special_tokens=False).ids
    plain = [w for w in words if MARK not in w] if len(mark) == 1 else []
    for at in range(0, len(plain), 100_000):
        lots = [plain[a : a + 100] for a in range(at, min(at + 100_000, len(plain)), 100)]
        for lot, e in zip(lots, tok.encode_batch_fast([f" {MARK} ".join(x) for x in lots], add_special_tokens=False), strict=True):
            ids = np.array([*e.ids, mark[0]], np.int64)
            data, begin, step = ids.astype(width).tobytes(), 0, width.itemsize
            for w, end in zip(lot, np.flatnonzero(ids == mark[0]).tolist(), strict=True):
                known[w] = data[begin * step : end * step]
                begin = end + 1
    alone = [w for w in words if w not in known]
    for w, e in zip(alone, tok.encode_batch_fast(alone, add_special_tokens=False), strict=True):
        known[w] = np.array(e.ids, width).tobytes()


def ids_of(parts: pa.Array, tok, known: dict, width: np.dtype, plain=None) -> pa.Array:
    """The ids of each part as bytes; each different one is encoded once, runs of LETTERS by plain, if given."""
    coded = pc.dictionary_encode(parts)
    words = coded.dictionary.to_pylist()
    new = [w for w in words if w and w not in known]
    if plain is not None and new:
        letters = pc.match_substring_regex(pa.array(new, pa.string()), LETTERS).to_pylist()
        encode_new(plain, known, [w for w, x in zip(new, letters, strict=True) if x], width)
        new = [w for w, x in zip(new, letters, strict=True) if not x]
    encode_new(tok, known, new, width)
    return pa.array([known[w] if w else b"" for w in words], pa.binary()).take(coded.indices)


def encoded(texts: pa.Array, path: str, end_id: int, width: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    """All ids of the texts, each text with its end, and the number of ids up to each text's end."""
    tok, known = tokenizer(path)
    if len(known) > REMEMBERED:
        known.clear()
    words = pc.utf8_split_whitespace(texts)
    chunks = pc.dictionary_encode(words.flatten())
    own = pc.binary_join_element_wise(*(ids_of(x, tok, known, width, letter_tokenizer(path)) for x in parted(chunks.dictionary)), pa.scalar(b"", pa.binary()))
    pieces = pa.concat_arrays([own, pa.array([np.array([end_id], width).tobytes()], pa.binary())])
    word_ends = words.offsets.to_numpy().astype(np.int64) - words.offsets[0].as_py()
    taken = pieces.take(pa.array(np.insert(chunks.indices.to_numpy(), word_ends[1:], len(own))))
    ends = np.frombuffer(taken.buffers()[1], np.int32)[taken.offset : taken.offset + len(taken) + 1].astype(np.int64) // width.itemsize
    return np.frombuffer(taken.buffers()[2], width)[: ends[-1]], ends[word_ends[1:] + np.arange(1, len(texts) + 1)]


def token_ids(docs: DataFrame, id_col: str, text_col: str, path: str, end_id: int, order: tuple[str, ...] = ()) -> tuple[DataFrame, np.dtype]:
    """doc_id, ids (of the whole text, as little-endian integers, two bytes wide where the vocabulary allows), and the columns
    of order as order_0, order_1 ..."""
    vocabulary = tokenizer(path)[0].get_vocab_size(with_added_tokens=True)
    width = np.dtype("<u2" if max(vocabulary, end_id + 1) <= 1 << 16 else "<u4")
    places = [f"order_{k}" for k in range(len(order))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = tokenizer(path)[0]
        for batch in batches:
            sizes = np.cumsum(pc.binary_length(batch.column(1)).to_numpy(zero_copy_only=False).astype(np.int64))
            at = 0
            while at < batch.num_rows:  # slices of bounded text
                to = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + SLICE_BYTES, "right")))
                texts = batch.column(1).slice(at, to - at)
                # the control characters 1C to 1F are white space to the splitter only: such texts are encoded as they are
                odd = pc.match_substring_regex(texts, "[\x1c-\x1f]").to_numpy(zero_copy_only=False)
                plain = pc.if_else(pa.array(odd), "", texts) if odd.any() else texts
                ids, ends = encoded(plain, path, end_id, width)
                if odd.any():
                    parts = [ids[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]
                    for i in np.flatnonzero(odd):
                        own = tok.encode(texts[int(i)].as_py(), add_special_tokens=False).ids
                        parts[i] = np.array([*own, end_id], width)
                    ids, ends = np.concatenate(parts), np.cumsum([len(p) for p in parts])
                column = binary_column(ids, ends * width.itemsize)
                kept = [batch.column(k).slice(at, to - at) for k in (0, *range(2, batch.num_columns))]
                yield pa.RecordBatch.from_arrays([kept[0], column, *kept[1:]], names=["doc_id", "ids", *places])
                at = to

    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).alias("text"), *(F.col(f"`{c}`").cast("long").alias(p) for c, p in zip(order, places, strict=True))
    )
    return rows.mapInArrow(light(run), ", ".join(["doc_id long, ids binary", *(f"{p} long" for p in places)])), width


def ranking(ids: DataFrame, width: np.dtype, vocabulary: int) -> np.ndarray:
    """Ids by falling frequency over all documents, ties by id; ids that never occur come last. One number per id of the vocabulary."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(vocabulary, np.int64)
        for batch in batches:
            total += np.bincount(column_values(batch.column(0), width), minlength=vocabulary)
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(total[found])], names=["token", "n"])

    counts = np.zeros(vocabulary, np.int64)
    for token, n in ids.select("ids").mapInArrow(light(count), "token long, n long").groupBy("token").agg(F.sum("n")).collect():
        counts[token] = n
    return np.lexsort((np.arange(vocabulary), -counts)).astype(np.uint32)


def column_values(column: pa.Array, width: np.dtype) -> np.ndarray:
    """The bytes of a binary column without nulls as one run of numbers."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    if len(column) == 0 or offsets[0] == offsets[-1]:
        return np.zeros(0, width)
    return np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]].view(width)


def pack(values: np.ndarray, counts: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """Control and data bytes of each document; values of all documents one after the other, counts per document."""
    extra = (values > 0xFF).astype(np.uint8) + (values > 0xFFFF) + (values > 0xFFFFFF)
    size = extra.astype(np.int64) + 1
    at = np.cumsum(size) - size
    data = np.zeros(int(size.sum()), np.uint8)
    for k in range(4):
        m = extra >= k
        data[at[m] + k] = (values[m] >> np.uint32(8 * k)).astype(np.uint8)
    padded = -(-counts // 4) * 4
    slots = np.zeros(int(padded.sum()), np.uint8)
    slots[spans(np.cumsum(padded) - padded, counts)] = extra
    control = (slots.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(axis=1, dtype=np.uint8)
    total = np.concatenate([[0], np.cumsum(size)])
    return binary_column(control, np.cumsum(padded) // 4), binary_column(data, total[np.cumsum(counts)])


def unpack(control: pa.Array, data: pa.Array, counts: np.ndarray) -> np.ndarray:
    """The values of all documents, by table lookup."""
    lengths = LENGTHS[column_values(control, np.dtype(np.uint8))].ravel()
    padded = -(-counts // 4) * 4
    lengths = lengths[spans(np.cumsum(padded) - padded, counts)].astype(np.int64)
    body = column_values(data, np.dtype(np.uint8))
    at = np.cumsum(lengths) - lengths
    values = body[at].astype(np.uint32)
    for k in range(1, 4):
        m = np.flatnonzero(lengths > k)
        values[m] |= body[at[m] + k].astype(np.uint32) << np.uint32(8 * k)
    return values


def write_files(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, end_id: int = END_ID, order: tuple[str, ...] = ()) -> None:
    """Writes every document's ids below folder (documents), with the ranking they are coded by (dictionary).

    Documents stand in ascending id order, or by the whole numbers in the columns of order.
    """
    spark = docs.sparkSession
    path = path or default_vocabulary()
    ids, width = token_ids(docs, id_col, text_col, path, end_id, order)
    ids = stored(ids, "token-ids")
    ranks = ranking(ids, width, max(tokenizer(path)[0].get_vocab_size(with_added_tokens=True), end_id + 1))
    rank = np.empty(len(ranks), np.uint32)
    rank[ranks] = np.arange(len(ranks), dtype=np.uint32)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            if not batch.num_rows:
                continue
            counts = pc.binary_length(batch.column(1)).to_numpy(zero_copy_only=False).astype(np.int64) // width.itemsize
            control, data = pack(rank[column_values(batch.column(1), width)], counts)
            starts = at + np.cumsum(counts) - counts
            at = int(starts[-1] + counts[-1])
            parts = pa.array(np.full(batch.num_rows, part, np.int32))
            yield pa.RecordBatch.from_arrays([batch.column(0), parts, pa.array(starts), pa.array(counts), control, data], names=[x.split()[0] for x in FILE.split(", ")])

    ranked = pa.table({"rank": pa.array(range(len(ranks)), pa.int64()), "token": pa.array(ranks.astype(np.int64))})
    spark.createDataFrame(ranked).coalesce(1).write.parquet(f"{folder}/dictionary")
    keys = [f"order_{k}" for k in range(len(order))] or ["doc_id"]
    ordered = ids.repartitionByRange(*keys).sortWithinPartitions(*keys, "doc_id", "ids").select("doc_id", "ids")
    ordered.mapInArrow(light(code), FILE).write.option("compression", "uncompressed").parquet(f"{folder}/documents")


def decoded(spark: SparkSession, folder: str, with_ids: bool = False) -> DataFrame:
    """Per document from the files: doc_id, part, at (ids before it in its part), n_tokens, ids_crc32 and, if asked, ids (unsigned
    32-bit numbers, little-endian)."""
    ranks = spark.read.parquet(f"{folder}/dictionary").toArrow()  # one number per id of the vocabulary
    order = np.zeros(ranks.num_rows, np.uint32)
    order[ranks["rank"].to_numpy()] = ranks["token"].to_numpy()
    schema = "doc_id long, part int, at long, n_tokens long, ids_crc32 long" + (", ids binary" if with_ids else "")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            doc, part, at, n, control, data = batch.columns
            counts = n.to_numpy(zero_copy_only=False)
            ids = order[unpack(control, data, counts)].astype("<u4")
            ends = np.cumsum(counts)
            crc = [zlib.crc32(ids[b - c : b]) for b, c in zip(ends, counts, strict=True)]
            own = [binary_column(ids, ends * 4)] if with_ids else []
            yield pa.RecordBatch.from_arrays([doc, part, at, n, pa.array(crc, pa.int64()), *own], names=[x.split()[0] for x in schema.split(", ")])

    files = spark.read.parquet(f"{folder}/documents")
    return files.select("doc_id", "part", "at", "n_tokens", "control", "data").mapInArrow(light(read), schema)


def read_files(spark: SparkSession, folder: str) -> DataFrame:
    """Per document from the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""
    # one row per file part: all a single task holds
    parts = spark.read.parquet(f"{folder}/documents").groupBy("part").agg(F.sum("n_tokens").alias("held"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select("part", F.coalesce(F.sum("held").over(before), F.lit(0)).alias("base"))
    return decoded(spark, folder).join(offsets, "part").select("doc_id", (F.col("base") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def tokenised(docs: DataFrame, **options) -> DataFrame:
    """Writes the files to the shared folder and reads them back. A null or empty text is its end id alone; null ids come first;
    rows that repeat an id follow each other, by their ids' bytes; an empty table gives no rows; other columns are not read."""
    folder = f"{shared_folder(docs.sparkSession)}/token-files-{uuid.uuid4().hex}"
    write_files(docs, folder, **options)
    return read_files(docs.sparkSession, folder)


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place, length and checksum in the token files."""
    return tokenised(table(spark, sf_dir, "documents"))


QUERIES = {"op1_token_files": op1_token_files}
ORACLES: dict[str, str] = {}
