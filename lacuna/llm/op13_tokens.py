"""Token counts by byte-pair merging with a heap over a linked list.

A word's bytes are a linked list of symbols.  A heap holds its adjacent pairs by
merge rank, then by place; the lowest is popped, its two symbols become one, and
the pairs with the new neighbours are pushed.  A popped pair that no longer
stands there is passed over.  The count of tokens is the symbols at the start
less the merges; no identifiers come out.

Merges, pre-tokenisation and the added token are those of the JSON form of the
public 50k byte-level BPE.  A text is cut at the added token's string, which is
one token as in the library's default; between, into units: a run of other
than white space with the one space before it, or white space.  No merge
crosses units, so a unit's count is worked out once and kept while the task's
bounded memory of units has room.

Defined cases: a null or empty text has no bytes and no tokens; a null doc_id
stays null; rows with equal doc_id are counted each; other columns are ignored.
Ill-formed UTF-8 is replaced by U+FFFD for the tokens, not for ``n_bytes``.
"""

from __future__ import annotations

import functools
import json
import re
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from itertools import pairwise

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from . import textkernel as tk
from .common import table

#: A document with more tokens is over the limit.
LIMIT = 512
#: Units, and parts of units, whose counts a task remembers; longer ones than LONGEST characters it does not.
REMEMBERED, LONGEST = 1 << 20, 48

#: Unicode white space, as the pattern of the pre-tokeniser means it.
WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
UNIT = re.compile(rf" ?[^{WHITE}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Remembered(dict):
    """Counts by text, worked out when missing; when full, those not met since the last time it was full are forgotten."""

    def __init__(self, count):
        super().__init__()
        self.count, self.older = count, {}

    def __missing__(self, text: str) -> int:
        n = self.older.get(text)
        if n is None:
            n = self.count(text)
            if len(text) > LONGEST:
                return n
        if 2 * len(self) >= REMEMBERED:
            self.older = dict(self)
            self.clear()
        self[text] = n
        return n


class Merges:
    """Counts tokens by the merges of a byte-level BPE's JSON file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            parsed = json.load(f)
        self.ids = ids = parsed["model"]["vocab"]
        self.bits = max(ids.values()).bit_length()
        #: Rank by pair (two ids in one number), and the symbol that a rank's merge makes.
        self.ranks: dict[int, int] = {}
        self.made: list[int] = []
        for rank, (a, b) in enumerate(m if isinstance(m, list) else m.split(" ") for m in parsed["model"]["merges"]):
            self.ranks[ids[a] << self.bits | ids[b]] = rank
            self.made.append(ids[a + b])
        special = [t["content"] for t in parsed["added_tokens"]]
        self.at_special = re.compile("|".join(map(re.escape, special))) if special else None
        # Which characters are letters or digits is for the library to say: its Unicode tables may be older than ours.
        self.parts = Tokenizer.from_file(path).pre_tokenizer.pre_tokenize_str
        self.part_counts, self.unit_counts = Remembered(self.merge), Remembered(self.unit)

    def unit(self, unit: str) -> int:
        """Tokens of one unit; it may hold several pre-tokens, such as a word and its comma."""
        parts = self.parts(unit)
        return self.merge(parts[0][0]) if len(parts) == 1 else sum(self.part_counts[part] for part, _ in parts)

    def merge(self, part: str) -> int:
        """Tokens of one pre-token, given as the vocabulary writes its bytes: a printable character for each."""
        ids, rank_of, bits = self.ids, self.ranks.get, self.bits
        symbols = [ids[c] for c in part]
        n = count = len(symbols)
        # A heap entry is rank and place in one number, so that lower ranks, then earlier places come first.
        heap = [rank << 32 | i for i, (a, b) in enumerate(pairwise(symbols)) if (rank := rank_of(a << bits | b)) is not None]
        if not heap:
            return count
        heapify(heap)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        while heap:
            entry = heappop(heap)
            rank, i = entry >> 32, entry & 0xFFFFFFFF
            j = after[i]
            if j >= n or symbols[i] < 0 or rank_of(symbols[i] << bits | symbols[j]) != rank:
                continue  # one of the two has been merged since
            symbols[i], symbols[j] = new, _ = self.made[rank], -1
            count -= 1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (rank := rank_of(new << bits | symbols[k])) is not None:
                    heappush(heap, rank << 32 | i)
            h = before[i]
            if h >= 0 and (rank := rank_of(symbols[h] << bits | new)) is not None:
                heappush(heap, rank << 32 | h)
        return count

    def tokens(self, text: str) -> int:
        """Tokens of a text, added ones in it included."""
        spans = self.at_special.split(text) if self.at_special else [text]
        return len(spans) - 1 + sum(sum(map(self.unit_counts.__getitem__, UNIT.findall(span))) for span in spans)


@functools.cache
def merges_of(path: str) -> Merges:
    """The merges of a file, loaded once in each worker."""
    return Merges(path)


def _counter(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = merges_of(path)
        for batch in batches:
            data, offsets = tk.buffers(batch.column("text"))
            cuts = offsets.tolist()
            n = [bpe.tokens(data[a:b].tobytes().decode("utf-8", "replace")) for a, b in zip(cuts[:-1], cuts[1:])]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(offsets[1:] - offsets[:-1], pa.int64()), pa.array(n, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    return run


def count_tokens(docs: DataFrame, tokenizer_path: str | None = None, limit: int = LIMIT) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_tokens and over_limit (more tokens than ``limit``)."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    counted = docs.select("doc_id", "text").mapInArrow(_counter(tokenizer_path or default_tokenizer()), f"doc_id {kind}, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)


def op13_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"))
