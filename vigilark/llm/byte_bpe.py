"""Byte-level BPE by the tiktoken library with a local rank file, and decoding to raw bytes.

Long texts are cut where no match of the split pattern can reach across: between a character that is
not white space and a space or line break after it. Very long runs of white space, which the library's
pattern cannot take, are merged as the pieces that the pattern would make of them.

Defined cases: a null text encodes to no ids; empty tables, repeated rows and null ids pass through;
other columns are kept, except those with the names of the results, which are replaced.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from vigilark.llm.common import Batches, sliced

#: Characters of a text that are encoded at once, if it has a safe place to cut.
CHUNK = 50_000
#: Bytes of text or ids that a task works on at once.
SLICE_BYTES = 2 << 20
#: White space as the library's pattern has it, in runs too long for it.
BLANK = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
SAFE = re.compile(r"(?<=\S)(?=[ \n])")


def encoding(path: str, pattern: str):
    """The library's encoding for a rank file."""
    import base64

    import tiktoken

    with open(path, "rb") as file:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
    return tiktoken.Encoding("local", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def chunks(text: str, most: int = CHUNK) -> list[str]:
    """``text`` in parts of about ``most`` characters, cut at safe places only."""
    out, start = [], 0
    while len(text) - start > most:
        cut = SAFE.search(text, start + most)
        if cut is None:
            break
        out.append(text[start:cut.start()])
        start = cut.start()
    out.append(text[start:])
    return out


class Encoder:
    """Ids of one text after another."""

    def __init__(self, path: str, pattern: str, run: int = 1000):
        self.library = encoding(path, pattern)
        self.run = re.compile(f"[{BLANK}]{{{run},}}")

    def _chunk(self, text: str) -> list[int]:
        ids, at = [], 0
        for found in self.run.finditer(text):
            # The run without its last character is one piece, unless the text ends with the run.
            end = found.end() - (found.end() < len(text))
            ids += self.library.encode_ordinary(text[at:found.start()])
            ids += self.library._encode_single_piece(text[found.start():end])
            at = end
        return ids + self.library.encode_ordinary(text[at:])

    def ids(self, text: str) -> list[int]:
        if len(text) <= CHUNK and not self.run.search(text):
            return self.library.encode_ordinary(text)
        return [x for part in chunks(text) for x in self._chunk(part)]


def _added(df: DataFrame, **more: T.DataType) -> T.StructType:
    return T.StructType([f for f in df.schema.fields if f.name not in more]
                        + [T.StructField(k, v) for k, v in more.items()])


def encode(docs: DataFrame, path: str, pattern: str, text_col: str = "text", decoded: bool = False,
           keep_text: bool = True) -> DataFrame:
    """``docs`` with n_tokens and ids (binary: little-endian unsigned 32-bit).

    ``decoded`` adds the bytes of the ids as ``decode`` does, in the same worker, so that a task has one
    and the ids travel once; without ``keep_text`` the text does not travel back.
    """
    new = {"n_tokens": T.LongType(), "ids": T.BinaryType()} | ({"bytes": T.BinaryType()} if decoded else {})
    kept = docs if keep_text else docs.drop(text_col)
    names = [n for n in kept.columns if n not in new]

    def run(batches: Batches) -> Batches:
        encoder = Encoder(path, pattern)
        for batch in batches:
            for part in sliced(batch, text_col, SLICE_BYTES):
                ids = [np.array(encoder.ids(x.as_py() or ""), "<u4") for x in part.column(text_col)]
                made = [pa.array(map(len, ids), pa.int64()), pa.array([x.tobytes() for x in ids], pa.binary())]
                if decoded:
                    made.append(pa.array([encoder.library.decode_bytes(x.tolist()) for x in ids], pa.binary()))
                yield pa.RecordBatch.from_arrays([*(part.column(n) for n in names), *made], names=[*names, *new])

    return docs.mapInArrow(run, _added(kept, **new))


def decode(docs: DataFrame, path: str, pattern: str, ids_col: str = "ids") -> DataFrame:
    """``docs`` with the bytes (binary) of its ids, which need not be valid text. Null ids: none."""
    names = [n for n in docs.columns if n != "bytes"]

    def run(batches: Batches) -> Batches:
        library = encoding(path, pattern)
        for batch in batches:
            for part in sliced(batch, ids_col, SLICE_BYTES):
                found = [library.decode_bytes(np.frombuffer(x.as_py() or b"", "<u4").tolist())
                         for x in part.column(ids_col)]
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(n) for n in names), pa.array(found, pa.binary())], names=[*names, "bytes"])

    return docs.mapInArrow(run, _added(docs, bytes=T.BinaryType()))
