"""Packing by power-of-two decomposition.

A document of L tokens (its ids and one end id) is cut into as many pieces of
``longest`` tokens as fit and, for the rest, one piece for each set bit of the
rest's length, longest first.  Every piece is a sequence of its own whose length
is a power of two: no sequence crosses documents and none is padded.  Sequences
of equal length form a bucket (column ``length``) from which batches are drawn.

The ids are those of the public 50k byte-level BPE; its rank file is read by
tiktoken, which gives the ids that the JSON form of the same vocabulary gives in
tokenizers (tested).  The JSON adds one token, "<|endoftext|>", which its library
finds in texts too; so does this operator, unless ``special`` is empty: then the
string is ordinary text.

Defined cases: a null or empty text has one token, the end id; a null doc_id
stays null; rows with equal doc_id are packed each.  Ill-formed UTF-8 is
replaced by U+FFFD.  ``sequence_id`` is the task's number and a running number,
so it is unique in one result.
"""

from __future__ import annotations

import base64
import functools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from . import textkernel as tk
from .common import table

LONGEST = 2048
END_ID = 1
#: The token that the JSON form adds to the ranks, and its id.
SPECIAL = {"<|endoftext|>": 50256}


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


@functools.cache
def encoding(path: str, special: tuple[tuple[str, int], ...] = ()):
    """The byte-level BPE of a rank file with its special tokens, loaded once in each worker."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=dict(special))


def pieces(n: int, longest: int = LONGEST) -> list[int]:
    """Lengths, longest first, of the pieces of ``n`` tokens."""
    out = [longest] * (n // longest)
    return out + [1 << b for b in range(longest.bit_length() - 2, -1, -1) if n % longest >> b & 1]


def _packer(path: str, longest: int, end_id: int, with_ids: bool, special: dict[str, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoding(path, tuple(special.items()))
        sequence = TaskContext.get().partitionId() << 40
        for batch in batches:
            data, offsets = tk.buffers(batch.column("text"))
            ids_of = batch.column("doc_id")
            for first, end, raw, offs in tk.chunks(data, offsets):
                rows: list[int] = []
                cols: list[list[int]] = [[], [], [], []]
                held: list[np.ndarray] = []
                for i in range(end - first):
                    text = raw[offs[i] : offs[i + 1]].tobytes().decode("utf-8", "replace")
                    plain = not any(token in text for token in special)
                    ids = np.array([*(bpe.encode_ordinary(text) if plain else bpe.encode(text, allowed_special="all")), end_id], "<u4")
                    at = 0
                    for n in pieces(len(ids), longest):
                        part = ids[at : at + n]
                        rows.append(first + i)
                        for col, v in zip(cols, (at, n, zlib.crc32(part.tobytes()), len(ids))):
                            col.append(v)
                        if with_ids:
                            held.append(part)
                        at += n
                start, length, crc, total = (pa.array(c, pa.int64()) for c in cols)
                numbers = np.arange(sequence, sequence + len(rows))
                sequence += len(rows)
                arrays = [ids_of.take(pa.array(rows, pa.int64())), start, length, crc, total, pa.array(numbers), pa.array(np.zeros(len(rows), np.int64))]
                if with_ids:
                    flat = np.concatenate(held).astype(np.int32)
                    cuts = np.concatenate(([0], np.cumsum([len(x) for x in held]))).astype(np.int32)
                    arrays.append(pa.ListArray.from_arrays(pa.array(cuts), pa.array(flat)))
                yield pa.RecordBatch.from_arrays(arrays, NAMES + ["ids"] * with_ids)

    return run


NAMES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def pack(docs: DataFrame, tokenizer_path: str | None = None, longest: int = LONGEST, end_id: int = END_ID, with_ids: bool = True, special: dict[str, int] | None = None) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset and, unless left out, its ids."""
    if longest < 1 or longest & (longest - 1):
        raise ValueError("longest must be a power of two")
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, " + ", ".join(f"{c} long" for c in NAMES[1:]) + ", ids array<int>" * with_ids
    return docs.select("doc_id", "text").mapInArrow(_packer(tokenizer_path or default_tokenizer(), longest, end_id, with_ids, SPECIAL if special is None else special), schema)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), with_ids=False)
