"""Byte-level BPE by dynamic programming over prefixes: encoding, decoding, appends and edits."""

from __future__ import annotations

import base64
import hashlib
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Distinct words that a worker remembers; beyond that its table starts anew.
TABLE_SIZE = 400_000
#: Answers remembered about pairs of neighbours.
PAIRS = 1 << 18
#: Documents encoded and handed on at once.
SLICE = 128
_END = 1 << 62


class BytePairCoder:
    """Encodes as merging by ranks does, without merging.

    The encoding of a byte string ends in one token, and without that token is the encoding
    of a shorter prefix. So each prefix has one last token, and it is the only token that is a
    suffix of the prefix and may follow the last token of what stands before it. Whether
    two tokens may stand side by side is told by their edges: a token's right edge is, in turn,
    its last byte and the larger and larger pieces that merging makes of it, each until the rank of
    the next; so is the left edge of the token after it. The border stays if no two pieces that
    exist at the same time have a joint rank that comes earlier than the end of either; of
    equal ranks the left one goes first.

    This needs ranks that exceed those of the two tokens that merging joins into theirs, which the
    constructor checks. A token that merging never makes of its own bytes is never a last token,
    though a whole word that equals it has its id.
    """

    def __init__(self, rank_file: str, pattern: str, table_size: int = TABLE_SIZE):
        import ahocorasick
        import regex

        with open(rank_file, "rb") as lines:
            rows = [line.split() for line in lines if line.strip()]
        self.ranks = {base64.b64decode(token): int(rank) for token, rank in rows}
        self.token = {rank: token for token, rank in self.ranks.items()}
        self.longest = max(map(len, self.ranks))
        self.pattern = regex.compile(pattern)
        self.pattern_text = pattern
        #: token: its (piece, rank at which the piece is merged into the next one), ending in the token itself.
        self.right: dict[bytes, tuple] = {}
        self.left: dict[bytes, tuple] = {}
        self._make_edges()
        self.odd = {token: rank for token, rank in self.ranks.items() if token not in self.right}
        for token in self.odd:
            if len(self._merged(token)) == 1:
                raise ValueError(f"rank {self.odd[token]} joins a token of a larger rank")
        self.follows = lru_cache(maxsize=PAIRS)(self._follows)
        self.automaton = ahocorasick.Automaton()
        for token, rank in self.ranks.items():
            if token in self.right:
                self.automaton.add_word(token.decode("latin-1"), (len(token), rank))
        self.automaton.make_automaton()
        self.size, self.words = table_size, {}
        self._probes: dict[str, tuple] | None = None
        self._class: dict[str, str] = {}

    # -------------------------------------------------------- which tokens may be neighbours

    def _make_edges(self) -> None:
        for token, rank in sorted(self.ranks.items(), key=lambda item: item[1]):
            if len(token) == 1:
                self.right[token] = self.left[token] = ((token, _END),)
                continue
            for at in range(1, len(token)):
                a, b = token[:at], token[at:]
                # Parts of larger ranks are not there yet: they have no edges.
                if a in self.right and b in self.right and self._apart(a, b):
                    self.right[token] = (*self.right[b][:-1], (b, rank), (token, _END))
                    self.left[token] = (*self.left[a][:-1], (a, rank), (token, _END))
                    break

    def _apart(self, a: bytes, b: bytes) -> bool:
        """Whether merging makes both tokens whole before anything crosses the border between them."""
        right, left, i, j = self.right[a], self.left[b], 0, 0
        while True:
            (x, x_until), (y, y_until) = right[i], left[j]
            if x_until == y_until == _END:
                return True
            rank = self.ranks.get(x + y)
            if rank is not None and rank < x_until and rank <= y_until:
                return False
            if x_until <= y_until:
                i += 1
            else:
                j += 1

    def _merged(self, data: bytes) -> list[bytes]:
        pieces = [data[i : i + 1] for i in range(len(data))]
        while True:
            joint = [self.ranks.get(a + b, _END) for a, b in zip(pieces, pieces[1:])]
            if not joint or min(joint) == _END:
                return pieces
            at = joint.index(min(joint))
            pieces[at : at + 2] = [pieces[at] + pieces[at + 1]]

    def _follows(self, first: int, second: int) -> bool:
        a, b = self.token[first], self.token[second]
        return a + b not in self.ranks and self._apart(a, b)

    # -------------------------------------------------------- prefixes

    def extend(self, data: bytes, last: list[int], old: tuple[bytes, list[int]] | None = None) -> list[int]:
        """Complete `last`, where last[i] is the last token of the encoding of data[:i], from the prefixes it has.

        With `old`, the bytes and table before an edit, the rest is taken from there once as many prefixes
        in a row as the longest token has bytes have the tokens they had, in bytes that did not change.
        """
        if not last:
            last.append(-1)
        have, same, run = len(last), 0, 0
        if old is not None:
            most = min(len(data), len(old[0]))
            while same < most and data[-1 - same] == old[0][-1 - same]:
                same += 1
        unchanged, shift = len(data) - same, (len(old[0]) - len(data)) if old is not None else 0
        start = max(0, have - self.longest)
        follows = self.follows
        for end, (length, token) in self.automaton.iter(data[start:].decode("latin-1")):
            end += start + 1
            if end < have:
                continue
            begin = end - length
            if begin < 0 or (begin and not follows(last[begin], token)):
                continue
            last.append(token)
            have += 1
            if old is not None and end >= unchanged and end + shift > 0:
                run = run + 1 if old[1][end + shift] == token else 0
                if run >= self.longest:
                    last.extend(old[1][end + shift + 1 :])
                    return last
        return last

    def tokens(self, data: bytes, last: list[int]) -> list[int]:
        """The encoding of a word, read backwards from its table."""
        if data in self.odd:
            return [self.odd[data]]
        ids, at = [], len(data)
        while at:
            ids.append(last[at])
            at -= len(self.token[last[at]])
        return ids[::-1]

    def encode_word(self, data: bytes) -> list[int]:
        return self.tokens(data, self.extend(data, []))

    # -------------------------------------------------------- texts

    def _as_split(self, text: str) -> str:
        """The text with characters that this Python does not know replaced by others of their class.

        Libraries know different versions of Unicode. The class of such a character is asked of
        the tokenizer library, by whether it stays in one match with a letter or a digit.
        """
        if text.isascii():
            return text
        for c in {c for c in set(text) if unicodedata.category(c) == "Cn"}:
            if c not in self._class:
                self._class[c] = self._ask(c)
            text = text.replace(c, self._class[c])
        return text

    def _ask(self, c: str) -> str:
        import tiktoken

        lead = c.encode()[:1]
        for partner in "a1":
            ranks = {bytes([i]): i for i in range(256)} | {partner.encode() + lead: 256}
            probe = tiktoken.Encoding("probe", pat_str=self.pattern_text, mergeable_ranks=ranks, special_tokens={})
            if probe.encode_ordinary(partner + c)[0] == 256:
                return partner
        return "!"

    def split(self, text: str, start: int = 0) -> Iterator[tuple[int, int]]:
        """Where the matches of the pattern begin and end."""
        for match in self.pattern.finditer(self._as_split(text), start):
            yield match.span()

    def _split_words(self, text: str) -> list[str]:
        plain = self._as_split(text)
        if plain is text or plain == text:
            return self.pattern.findall(text)
        return [text[a:b] for a, b in self.split(text)]

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        """The ids of each text as little-endian 32-bit integers; each distinct word is encoded once."""
        for text in texts:
            words = self._split_words(text)
            missing = set(words).difference(self.words)
            if missing:
                if len(self.words) + len(missing) > self.size:
                    self.words.clear()
                    missing = set(words)
                for word in missing:
                    self.words[word] = np.array(self.encode_word(word.encode()), dtype="<u4").tobytes()
            yield b"".join(map(self.words.__getitem__, words))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.token.__getitem__, ids))


class Prefixes:
    """A text with the last token of every byte prefix of each of its words.

    Appends and edits compute only what they change: the words next to them, and in those the
    prefixes from the change on, up to where the tokens are again what they were.
    """

    def __init__(self, coder: BytePairCoder, text: str = ""):
        self.coder, self.text = coder, ""
        self.words: list[str] = []
        self.tables: list[list[int]] = []
        self.append(text)

    def append(self, more: str) -> None:
        self.replace(len(self.text), len(self.text), more)

    def replace(self, start: int, stop: int, new: str) -> None:
        """Put `new` in place of the characters from start up to stop."""
        ends = [0, *accumulate(map(len, self.words))]
        # A match depends on its characters and at most on the two that follow.
        kept = max(0, int(np.searchsorted(ends, start - 2, side="right")) - 1)
        text = self.text[:start] + new + self.text[stop:]
        boundary = {end: k for k, end in enumerate(ends)}
        words, tables, rest, at = [], [], len(self.words), kept
        shift = len(text) - len(self.text)
        for a, b in self.coder.split(text, ends[kept]):
            if a >= start + len(new) and boundary.get(a - shift, -1) >= at:
                rest = boundary[a - shift]
                break
            word = text[a:b].encode()
            before = (self.words[at].encode(), self.tables[at]) if at < len(self.words) else (b"", [-1])
            common, most = 0, min(len(word), len(before[0]))
            while common < most and word[common] == before[0][common]:
                common += 1
            tables.append(self.coder.extend(word, before[1][: common + 1], before))
            words.append(text[a:b])
            at += 1
        self.text = text
        self.words[kept:rest] = words
        self.tables[kept:rest] = tables

    def ids(self) -> list[int]:
        return [i for word, table in zip(self.words, self.tables) for i in self.coder.tokens(word.encode(), table)]


@lru_cache(maxsize=2)
def coder(rank_file: str, pattern: str) -> BytePairCoder:
    """One for each worker and vocabulary; workers serve many tasks."""
    return BytePairCoder(rank_file, pattern)


def encode_and_decode(
    docs: DataFrame, rank_file: str, pattern: str, *, doc_id: str = "doc_id", text: str = "text", keep_ids: bool = False
) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each row, and with keep_ids also ids and decoded bytes.

    Ids are those of the matches of the pattern in order; there are no special tokens, whatever the text says.
    Null texts count as empty ones: no ids, decoded to nothing. Repeated rows give repeated rows; null doc_ids stay
    null; other columns of the input do not come along. Rows stay where they are: no shuffle. A worker holds one
    batch, the vocabulary, a bounded table of distinct words and, for the word at work, an id a byte. The rank
    file lies at the same path on every machine.
    """
    fields = "n_tokens long, ids_sha256 string, decoded_sha256 string"
    if keep_ids:
        fields += ", ids array<long>, decoded binary"
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = coder(rank_file, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                n, raws, decoded, lists = [], [], [], []
                for raw in code.encode(part.column("text").to_pylist()):
                    ids = np.frombuffer(raw, dtype="<u4").tolist()
                    back = code.decode(ids)
                    n.append(len(ids))
                    raws.append(hashlib.sha256(raw).hexdigest())
                    decoded.append(hashlib.sha256(back).hexdigest())
                    if keep_ids:
                        lists.append((ids, back))
                columns = [part.column("doc_id"), pa.array(n, pa.int64()), pa.array(raws, pa.string()), pa.array(decoded, pa.string())]
                if keep_ids:
                    columns += [pa.array([x[0] for x in lists], pa.list_(pa.int64())), pa.array([x[1] for x in lists], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", *[f.split()[0] for f in fields.split(", ")]])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, {fields}")


def op12(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return encode_and_decode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
