"""SentencePiece encoding and decoding over a table of distinct chunks."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textwarden.llm.common import forget_tables

MARK = "▁"
#: Distinct chunks that a worker remembers; beyond that its table starts anew.
TABLE_SIZE = 400_000
#: A run of markers, written as spaces, with what follows up to the next one; or a line feed with what follows.
_CHUNK = re.compile(" +[^ \n]*|\n[^ \n]*")


class ChunkCoder:
    """Encodes as the library does, but segments each distinct chunk once.

    Sound where no piece holds a marker after another character and none holds a line
    feed, and where the model neither changes nor trims text: then no merge crosses the
    start of a run of markers, or touches a line feed, and ids of a text are those of its
    chunks in order. The constructor checks all of this and, where it fails, segments
    whole texts.
    """

    def __init__(self, model_file: str, table_size: int = TABLE_SIZE):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=model_file)
        self.size, self.table = table_size, {}
        pieces = [self.library.id_to_piece(i) for i in range(self.library.get_piece_size())]
        crossing = any(re.search(f"[^{MARK}]{MARK}|\n", p) for p in pieces)
        self.mark = self.library.piece_to_id(MARK)
        probe = "  Ａ ⁵ ﬁ  a\tb  "
        unchanged = self.library.normalize(probe) == (MARK + probe).replace(" ", MARK)
        self.chunked = unchanged and not crossing and not self.library.is_unknown(self.mark)

    def _segment(self, chunks: list[str]) -> None:
        """Fill the table for chunks that it lacks."""
        if len(self.table) + len(chunks) > self.size:
            self.table.clear()
        # The library puts one marker before a text. A chunk brings its own, so that one
        # of them is left out; a line feed brings none, and the added one is taken off.
        for chunk, ids in zip(chunks, self.library.encode([c if c[0] == "\n" else c[1:] for c in chunks], num_threads=1)):
            if chunk[0] == "\n":
                ids = ids[1:]
            elif len(chunk) == 1:
                ids = [self.mark]
            self.table[chunk] = np.array(ids, dtype="<u4").tobytes()

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        """The ids of each text, without begin and end, as little-endian 32-bit integers."""
        for text in texts:
            if not self.chunked or not text:
                yield np.array(self.library.encode(text), dtype="<u4").tobytes()
                continue
            # The library takes both for the same; a marker would make Python hold every character of a key in two bytes.
            chunks = _CHUNK.findall(" " + text.replace(MARK, " "))
            missing = [c for c in dict.fromkeys(chunks) if c not in self.table]
            if missing:
                before = len(self.table)
                self._segment(missing)
                if len(self.table) < before:
                    self._segment([c for c in dict.fromkeys(chunks) if c not in self.table])
            yield b"".join([self.table[c] for c in chunks])


@lru_cache(maxsize=2)
def coder(model_file: str) -> ChunkCoder:
    """One for each worker and model, in place of the tables of other operators; workers serve many tasks."""
    forget_tables(keep=__name__)
    return ChunkCoder(model_file)


def encode_and_decode(
    docs: DataFrame, model_file: str, *, doc_id: str = "doc_id", text: str = "text", keep_ids: bool = False
) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each row, and with keep_ids also ids and decoded.

    Ids begin with the model's begin id and close with its end id. Null texts count as
    empty ones: two ids, decoded to the empty text. Repeated rows give repeated rows; other
    columns of the input do not come along. Rows stay where they are: no shuffle; memory
    is bounded by the chunk table and a hundred rows. The model file lies at the same path on
    every machine.
    """
    fields = "n_tokens long, ids_sha256 string, decoded_sha256 string"
    if keep_ids:
        fields += ", ids array<long>, decoded string"
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))

    # Spark pickles a hundred rows at a time; an Arrow batch would be 10,000 texts, held several times in the
    # executor and in each worker, whose memory is not the heap's.
    @F.udf(f"struct<{fields.replace(' ', ':').replace(',:', ',')}>", useArrow=False)
    def coded(value: str) -> tuple:
        code = coder(model_file)
        library = code.library
        (inner,) = code.encode([value])
        ids = [library.bos_id(), *np.frombuffer(inner, dtype="<u4").tolist(), library.eos_id()]
        raw, decoded = np.array(ids, dtype="<u4").tobytes(), library.decode(ids)
        row = (len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())
        return row + (ids, decoded) * keep_ids

    return rows.select("doc_id", coded("text").alias("coded")).select("doc_id", "coded.*")


def op7(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return encode_and_decode(docs, public_tokenizers.path("piece_bpe_32k.model"))
