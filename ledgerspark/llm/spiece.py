"""SentencePiece encoding and decoding over a distinct-chunk table.

A text with its white-space markers written out falls into chunks: a run of markers and what follows up to
the next run. Where no piece of the model has a marker after another character, no merge crosses from one
chunk into the next, so a text's ids are its chunks' ids in order. Each task segments every distinct chunk
that it meets once, keeps the ids in a table, and joins them back by position. The table is emptied at
``TABLE`` entries and chunks over ``LONG`` characters are never kept, so memory does not grow with the input.
No shuffle: words by position would move several times the input, and a chunk costs microseconds to redo.

A model whose pieces cross markers, or that rewrites or squeezes its input, is used on whole texts instead.

Defined results: null is the empty text (begin and end ids only); repeated rows each get a row; no rows give
no rows; a text of any length is encoded whole; extra columns are ignored. A marker character (U+2581) in a
text is white space to the model, and decodes to a space.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import small_batches

MARK = "▁"
CHUNKS = re.compile(f"{MARK}+[^{MARK}]*")
TABLE, LONG = 200_000, 64


@cache
def processor(model: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=model)


@cache
def splits_at_markers(model: str) -> bool:
    sp = processor(model)
    pieces = [sp.id_to_piece(i) for i in range(sp.vocab_size())]
    probe = "  a\n\tB  ééﬁ "
    kept = MARK + probe.replace(" ", MARK)
    return not any(MARK in p.lstrip(MARK) for p in pieces) and "".join(sp.encode(probe, out_type=str)).replace("<0x0A>", "\n").replace("<0x09>", "\t") == kept


class Encoder:
    def __init__(self, model: str):
        self.sp, self.by_chunk = processor(model), splits_at_markers(model)
        self.table: dict[str, bytes] = {}
        self.lone = [self.sp.piece_to_id(MARK)]  # a marker alone, at the end of a text
        self.begin, self.end = (np.array([x], "<u4").tobytes() for x in (self.sp.bos_id(), self.sp.eos_id()))

    def ids(self, text: str) -> bytes:
        """All ids, begin and end included, as little-endian unsigned 32-bit integers."""
        if not text:
            return self.begin + self.end
        if not self.by_chunk:
            return self.begin + np.array(self.sp.encode(text), "<u4").tobytes() + self.end
        chunks = CHUNKS.findall(MARK + text.replace(" ", MARK))
        table = self.table
        new = [c for c in dict.fromkeys(chunks) if c not in table]
        if new:
            if len(table) + len(new) > TABLE:
                table.clear()
                new = list(dict.fromkeys(chunks))
            # the model puts one marker before each chunk itself
            for c, ids in zip(new, self.sp.encode([c[1:].replace(MARK, " ") for c in new], num_threads=1), strict=True):
                table[c] = np.array(ids or self.lone, "<u4").tobytes()
        out = b"".join([self.begin, *map(table.__getitem__, chunks), self.end])
        for c in new:
            if len(c) > LONG:
                del table[c]
        return out


def encode(docs: DataFrame, model: str, decoded: bool = False) -> DataFrame:
    """doc_id, ids (binary: little-endian unsigned 32-bit integers), n_tokens; with ``decoded`` also text, what the decoder makes of the ids.

    Decoding in the same pass saves a second set of Python workers and a second trip of all ids.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = Encoder(model)
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                ids = [enc.ids(t) for t in part.column(1).to_pylist()]
                out = [part.column(0), pa.array(ids, pa.binary()), pa.array([len(x) // 4 for x in ids], pa.int64())]
                if decoded:
                    out.append(pa.array([text_of(enc.sp, x) for x in ids], pa.string()))
                yield pa.RecordBatch.from_arrays(out, ["doc_id", "ids", "n_tokens", "text"][: len(out)])

    schema = "doc_id long, ids binary, n_tokens long" + ", text string" * decoded
    return small_batches(docs).select(F.col("doc_id").cast("long"), "text").mapInArrow(each, schema)


def text_of(sp, ids: bytes) -> str:
    return sp.decode(np.frombuffer(ids, "<u4").tolist())


def decode(encoded: DataFrame, model: str) -> DataFrame:
    """encoded (doc_id, ids, n_tokens) with ``text``: what the model's decoder makes of each row's ids; null ids give null."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sp = processor(model)
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                texts = [None if x is None else text_of(sp, x) for x in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], ["doc_id", "ids", "n_tokens", "text"])

    return small_batches(encoded).select("doc_id", "ids", "n_tokens").mapInArrow(each, "doc_id long, ids binary, n_tokens long, text string")


def digests(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256."""
    both = encode(docs, model, decoded=True)
    return both.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"))
