"""SentencePiece encoding and decoding with a merge-type prefix table (see ``pieces``).

Texts are cut where no merge can cross, each distinct pre-token is encoded and decoded once
per worker as long as the bounded memory of pre-tokens holds it, and a text's ids are the
concatenation. One pass over the rows, no shuffle; a lost task is simply run again.

Defined cases: a null or empty text has no ids and decodes to the empty text; all rows are
kept, repeated ones too; other columns are not read unless named in ``carry``.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tivlens.llm.pieces import MARK, PieceEncoder, encoder, pretokens

MEMORY = 250_000  # pre-tokens in each half of a worker's memory
LONGEST = 64  # code points of a remembered pre-token
SLICE = 1 << 19  # ids in one output batch, about


def model_bytes(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


class Memory(dict):
    """Pre-token to its ids, four bytes each, and their text; unknown ones are encoded and decoded.

    What is kept is the ids, and the text only of the few that decode to something else than themselves. When
    it is full it becomes the older half and a new one begins; what is asked for again moves over, so frequent
    pre-tokens are never forgotten.
    """

    def __init__(self, enc: PieceEncoder) -> None:
        self.enc = enc
        self.kept = super().__getitem__
        self.older: dict[str, bytes | tuple[bytes, str]] = {}

    def __missing__(self, token: str) -> bytes | tuple[bytes, str]:
        if (known := self.older.get(token)) is None:
            ids = self.enc.encode(token)
            known, text = array("i", ids).tobytes(), self.enc.decode(ids)
            if text != token.replace(MARK, " "):
                known = known, text
        if len(token) <= LONGEST:
            if len(self) >= MEMORY:
                self.older = dict(self)
                self.clear()
            self[token] = known
        return known

    def __getitem__(self, token: str) -> tuple[bytes, str]:
        known = self.kept(token)
        return known if type(known) is tuple else (known, token.replace(MARK, " "))

    def text(self, text: str) -> tuple[bytes, str]:
        """Ids of a whole text, four bytes each, and the text they decode to."""
        tokens = pretokens(text)
        found = [*map(self.kept, tokens)]
        try:
            ids, decoded = b"".join(found), "".join(tokens).replace(MARK, " ")
        except TypeError:  # one of the few
            both = [(f, t.replace(MARK, " ")) if type(f) is bytes else f for f, t in zip(found, tokens, strict=True)]
            ids, decoded = b"".join([f[0] for f in both]), "".join([f[1] for f in both])
        return ids, decoded[1:]  # without the marker put in front


@lru_cache(maxsize=1)
def memory(model: bytes) -> Memory:
    """One memory per worker, kept from task to task."""
    return Memory(encoder(model))


def encode_decode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text",
                  carry: bool = False) -> DataFrame:
    """``doc_id, ids array<int>, decoded string`` for every row; with ``carry`` also struct ``row``."""
    model = model_bytes(model_path)
    others = [F.col(f"`{c}`") for c in docs.columns if c != text_col]
    rows = docs.select(F.struct(*others).alias("row") if carry else F.col(id_col).alias("doc_id"),
                       F.col(text_col).alias("text"))
    first = rows.columns[0]
    schema = T.StructType([rows.schema[first], T.StructField("ids", T.ArrayType(T.IntegerType(), False)),
                           T.StructField("decoded", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = memory(model).text
        for batch in batches:
            start, offsets, decoded = 0, [0], []
            parts: list[bytes] = []
            texts, total = batch.column(1), 0
            for k in range(batch.num_rows):
                text = texts[k].as_py()
                flat, plain = of(text) if text else (b"", "")
                parts.append(flat)
                total += len(flat) // 4
                offsets.append(total)
                decoded.append(plain)
                if total >= SLICE or k == batch.num_rows - 1:
                    values = pa.Array.from_buffers(pa.int32(), total, [None, pa.py_buffer(b"".join(parts))])
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).slice(start, k + 1 - start),
                         pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values),
                         pa.array(decoded, pa.string())], names=[first, "ids", "decoded"])
                    start, offsets, parts, decoded, total = k + 1, [0], [], [], 0
        pa.default_memory_pool().release_unused()  # the worker stays for later tasks, the batches' memory need not

    return rows.mapInArrow(run, schema)
