"""Token ids in files of word-aligned Simple-8b blocks."""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textwarden.llm.common import new_folder, read_file, write_file
from textwarden.sources.checkpoints import cut_lineage

#: By selector: how many ids a word holds and the bits of each; 4 bits of selector, 60 of ids.
LAYOUT = ((60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60))
#: Selector of an escape: the next word is one id as it is.
ESCAPE = 15
MAGIC = b"SIMPLE8B"
#: Ids in a block; each block starts at a word of its own, which the header names.
BLOCK = 1 << 16
#: Texts a file, by words of the encoded ids.
FILE_WORDS = 1 << 21
#: Distinct parts, and as many words, that a worker remembers, some 150 bytes each; beyond that a table starts anew.
TABLE_SIZE = 1_000_000
END_ID = 1


def pack(ids: np.ndarray) -> np.ndarray:
    """64-bit words of non-negative ids.

    For each selector, runs of ids that are narrow enough tell at which places it fits; a
    word takes the selector with the most ids. A last word may be filled up with zeros,
    which the block's count cuts off.
    """
    n = len(ids)
    ids = ids.astype(np.uint64)
    out: list[np.ndarray] = []
    if n == 0:
        return np.zeros(0, dtype=np.uint64)
    choice = np.full(n, ESCAPE, dtype=np.int64)
    widest = int(ids.max())
    for selector in range(len(LAYOUT) - 1, -1, -1):
        count, bits = LAYOUT[selector]
        if widest < 1 << bits:
            choice[:] = selector
            continue
        narrow = np.flatnonzero(ids < np.uint64(1 << bits))
        if len(narrow):
            # Where each run of neighbours ends; the last one may be filled up.
            breaks = np.flatnonzero(np.diff(narrow) != 1)
            ends = np.append(narrow[breaks] + 1, n + count if narrow[-1] == n - 1 else narrow[-1] + 1)
            lengths = np.diff(np.concatenate([[-1], breaks, [len(narrow) - 1]]))
            choice[narrow[np.repeat(ends, lengths) - narrow >= count]] = selector
    step = np.array([c for c, _ in LAYOUT] + [0, 1])
    after = (np.arange(n) + step[choice]).tolist()
    places: list[int] = []
    add, at = places.append, 0
    while at < n:
        add(at)
        at = after[at]
    starts = np.array(places)
    kinds = choice[starts]
    padded = np.concatenate([ids, np.zeros(60, dtype=np.uint64)])
    sizes = np.where(kinds == ESCAPE, 2, 1)
    ends = np.cumsum(sizes)
    words = np.zeros(int(ends[-1]), dtype=np.uint64)
    first = ends - sizes
    for selector, (count, bits) in enumerate(LAYOUT):
        here = np.flatnonzero(kinds == selector)
        if len(here):
            word = np.full(len(here), selector << 60, dtype=np.uint64)
            for k in range(count):
                word |= padded[starts[here] + k] << np.uint64(bits * k)
            words[first[here]] = word
    here = np.flatnonzero(kinds == ESCAPE)
    words[first[here]] = np.uint64(ESCAPE << 60)
    words[first[here] + 1] = padded[starts[here]]
    return words


def unpack(words: np.ndarray, n: int) -> np.ndarray:
    """The n ids that pack() has packed."""
    kinds = (words >> np.uint64(60)).astype(np.int64)
    # The word after an escape is raw and may look like anything.
    raw = np.zeros(len(words), dtype=bool)
    for i in np.flatnonzero(kinds == ESCAPE):
        if not raw[i]:
            raw[i + 1] = True
    count = np.array([c for c, _ in LAYOUT] + [0, 0])[kinds]
    count[raw] = 1
    first = np.cumsum(count) - count
    out = np.zeros(int(count.sum()), dtype=np.uint64)
    for selector, (size, bits) in enumerate(LAYOUT):
        here = np.flatnonzero((kinds == selector) & ~raw)
        mask = np.uint64((1 << bits) - 1)
        for k in range(size):
            out[first[here] + k] = (words[here] >> np.uint64(bits * k)) & mask
    out[first[raw]] = words[raw]
    return out[:n]


def file_parts(lengths: list[int], ids: np.ndarray, keys: list[int | None] = ()) -> Iterator[bytes]:
    """A file: magic, counts, ids of each document, first word of each block, blocks; then the documents' keys.

    Keys are 64-bit integers, after them a byte each that is 1 where there is none.
    """
    blocks = [pack(ids[at : at + BLOCK]) for at in range(0, len(ids), BLOCK)]
    offsets = np.cumsum([0, *map(len, blocks)], dtype="<u8")
    yield MAGIC + struct.pack("<QQQ", len(lengths), len(ids), len(blocks))
    yield np.array(lengths, dtype="<u8").tobytes()
    yield offsets.tobytes()
    for block in blocks:
        yield block.astype("<u8").tobytes()
    yield np.array([k or 0 for k in keys], dtype="<i8").tobytes()
    yield bytes(k is None for k in keys)


def read_keys(raw: bytes) -> list[int | None]:
    """The keys of a file's documents, in their order."""
    docs, _, blocks = struct.unpack_from("<QQQ", raw, 8)
    words = struct.unpack_from("<Q", raw, 32 + 8 * docs + 8 * blocks)[0]
    at = 32 + 8 * docs + 8 * (blocks + 1) + 8 * words
    keys = np.frombuffer(raw, "<i8", docs, at).tolist()
    return [None if missing else key for key, missing in zip(keys, raw[at + 8 * docs : at + 9 * docs])]


def read_documents(raw: bytes) -> Iterator[np.ndarray]:
    """The ids of each document of a file, as unsigned 32-bit integers; one block at a time."""
    if raw[:8] != MAGIC:
        raise ValueError("not a file of packed token ids")
    docs, total, blocks = struct.unpack_from("<QQQ", raw, 8)
    lengths = np.frombuffer(raw, "<u8", docs, 32).astype(np.int64)
    offsets = np.frombuffer(raw, "<u8", blocks + 1, 32 + 8 * docs).astype(np.int64)
    base = 32 + 8 * docs + 8 * (blocks + 1)
    held, ready, block = [], 0, 0
    for length in lengths.tolist():
        while ready < length:
            words = np.frombuffer(raw, "<u8", int(offsets[block + 1] - offsets[block]), base + 8 * int(offsets[block]))
            held.append(unpack(words, min(BLOCK, total - BLOCK * block)).astype("<u4"))
            ready, block = ready + len(held[-1]), block + 1
        joined = np.concatenate(held) if len(held) != 1 else held[0]
        yield joined[:length]
        held, ready = [joined[length:]], ready - length


#: Texts in these characters, in lower case and without "<|", split into endings, letters, digits and
#: other marks as the tokenizer's own pattern would.
_PLAIN = re.compile(r"[\t-\r -~À-ÖØ-öø-ÿ]*")
_PARTS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\t-\r a-zß-öø-ÿ0-9]+")


class WordCoder:
    """Encodes as the library does, but each distinct piece once.

    White space separates words for this tokenizer whatever stands around it, so a text's
    ids are those of its words in order. Texts of plain characters are split at once into the
    parts that the tokenizer would make of their words; distinct parts go to its model without the
    normaliser, which would leave them as they are. Other texts go to the whole tokenizer word by word.
    """

    def __init__(self, tokenizer_file: str, table_size: int = TABLE_SIZE):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.full = Tokenizer.from_file(tokenizer_file)
        self.parts_only = Tokenizer(self.full.model)
        self.parts_only.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.size, self.words, self.parts = table_size, {}, {}

    def _fill(self, table: dict, tokenizer, pieces: list[list[str]]) -> None:
        """Learn what a table lacks; it starts anew where it would grow too large."""
        need = set(chain.from_iterable(pieces))
        missing = list(need.difference(table))
        if len(table) + len(missing) > self.size:
            table.clear()
            missing = list(need)
        for at in range(0, len(missing), 10_000):
            keys = missing[at : at + 10_000]
            found = tokenizer.encode(keys, is_pretokenized=True, add_special_tokens=False)
            ids = np.array(found.ids, dtype="<u4").tobytes()
            owner = np.array(found.word_ids, dtype=np.int64)
            ends = (4 * np.searchsorted(owner, np.arange(len(keys) + 1))).tolist()
            table.update(zip(keys, map(ids.__getitem__, map(slice, ends, ends[1:]))))

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian 32-bit integers."""
        plain = [_PLAIN.fullmatch(t) is not None and "<|" not in t for t in texts]
        pieces = [_PARTS.findall(t.lower()) if p else [w for w in re.split("[\t-\r ]+", t) if w] for t, p in zip(texts, plain)]
        self._fill(self.parts, self.parts_only, [ps for ps, p in zip(pieces, plain) if p])
        self._fill(self.words, self.full, [ps for ps, p in zip(pieces, plain) if not p])
        parts, words = self.parts.__getitem__, self.words.__getitem__
        return [b"".join(map(parts if p else words, ps)) for ps, p in zip(pieces, plain)]


@lru_cache(maxsize=2)
def coder(tokenizer_file: str) -> WordCoder:
    """One for each worker and tokenizer; workers serve many tasks."""
    return WordCoder(tokenizer_file)


def write_token_files(
    docs: DataFrame, tokenizer_file: str, folder: str, *, doc_id: str = "doc_id", text: str = "text", end_id: int = END_ID
) -> DataFrame:
    """Write the ids of all documents in ascending doc_id order; return path, n_docs, n_ids, first of each file.

    Documents are dealt out by ranges of doc_id and sorted in each; a task writes files
    of bounded size, each under a name of its own, so that a task that runs twice leaves
    at worst a file that no list names. The list is a written table, and `first`, the
    number of ids before a file, is a running sum over its one row a file; it is then put
    beside each file, under the file's name with `.base`.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    dealt = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    # As text, ids keep all digits in pandas where some of them are null.
    dealt = dealt.select(F.col("doc_id").cast("string").alias("doc_id"), "text")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import uuid

        code = coder(tokenizer_file)
        end = np.array([end_id], dtype="<u4").tobytes()
        keys, lengths, held, size, order = [], [], [], 0, 0

        def flush() -> pd.DataFrame:
            path = f"{folder}/{uuid.uuid4()}.s8b"
            write_file(path, file_parts(lengths, np.frombuffer(b"".join(held), dtype="<u4"), keys))
            low = pd.array([keys[0]], dtype="Int64")
            return pd.DataFrame({"path": [path], "low": low, "part": [order], "n_docs": [len(keys)], "n_ids": [size]})

        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.iloc[at : at + 256]
                for key, raw in zip(part["doc_id"], code.encode(part["text"].tolist())):
                    raw += end
                    keys.append(None if key is None else int(key))
                    lengths.append(len(raw) // 4)
                    held.append(raw)
                    size += len(raw) // 4
                    if size >= 2 * FILE_WORDS:
                        yield flush()
                        keys, lengths, held, size, order = [], [], [], 0, order + 1
        if keys:
            yield flush()

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, first in zip(batch["path"], batch["first"]):
                write_file(f"{path}.base", [struct.pack("<Q", first)])
            yield batch

    files = cut_lineage(dealt.mapInPandas(run, "path string, low long, part int, n_docs long, n_ids long"))
    before = Window.orderBy(F.col("low").asc_nulls_first(), "part", "path").rowsBetween(Window.unboundedPreceding, -1)
    order = files.select("path", "n_docs", "n_ids", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("first"))
    return cut_lineage(order.mapInPandas(place, "path string, n_docs long, n_ids long, first long"))


def read_token_files(files: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in the listed files, all of it from the files; files: path."""
    spread = files.select("path").repartition(max(1, files.sparkSession.sparkContext.defaultParallelism * 4), "path")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path in batch["path"]:
                raw = read_file(path)
                keys, starts, lengths, sums = read_keys(raw), [], [], []
                (at,) = struct.unpack("<Q", read_file(f"{path}.base"))
                for ids in read_documents(raw):
                    starts.append(at)
                    lengths.append(len(ids))
                    sums.append(zlib.crc32(ids.tobytes()))
                    at += len(ids)
                yield pd.DataFrame(
                    {"doc_id": pd.array(keys, dtype="Int64"), "start": starts, "n_tokens": lengths, "ids_crc32": sums}
                )

    return spread.mapInPandas(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files(docs: DataFrame, tokenizer_file: str, **columns: str) -> DataFrame:
    """Write all documents as token files in the shared folder and read them back.

    Null texts count as empty ones and have the end id alone. Null ids come first; rows
    that repeat an id stay neighbours, in any order. Other columns do not come along.
    """
    folder = new_folder(docs.sparkSession, "tokens")
    return read_token_files(write_token_files(docs, tokenizer_file, folder, **columns))


def op8(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return token_files(docs, public_tokenizers.path("word_bpe_49k.json"))
