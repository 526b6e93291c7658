"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics of every whole text are computed in numpy passes over Arrow buffers
and stored; labelled rows outside the held-out quarter are thinned by a hash to
about ``sample`` rows, which bounds what the driver fits on; the fitted trees, a
few flat arrays whose size depends on the parameters only, are broadcast and
score the stored statistics.

Defined cases: a null text counts as empty and, like an empty one, gets the
score of its (all zero) statistics; null labels teach nothing; with no label or
one class the score is the smoothed share of label 1.  Rows with equal doc_id are
scored each.  An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import gbdt, textkernel as tk
from .common import Scratch, held_out, table, thin

#: Labelled rows that the model is fitted on, about.
SAMPLE = 20_000
THRESHOLD = 0.7

_CLASSES = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "lower": b"abcdefghijklmnopqrstuvwxyz",
    "digit": b"0123456789",
    "blank": b" \t",
    "newline": b"\n\r",
    "stop": b".,;:'\"()-",
    "loud": b"!?",
    "sign": b"#$%&*+=@^_~`<>{}[]\\/",
    "bar": b"|",
}
FEATURES = [f"share_{c}" for c in _CLASSES] + [
    "share_high", "log_bytes", "log_words", "word_length", "word_length_sd", "distinct_words", "capital_words",
    "signed_words", "log_lines", "distinct_lines", "words_per_line", "distinct_shingles",
]


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of ``FEATURES`` for each text; zeros for an empty one."""
    n = np.diff(offsets).astype(float)
    some = np.maximum(n, 1)
    cols = []
    kinds = np.full(256, 255, np.uint8)
    for i, chars in enumerate(_CLASSES.values()):
        kinds[list(chars)] = i
    kinds[128:] = len(_CLASSES)
    kind = kinds[data]
    cols += [tk.counts_in(kind == i, offsets) / some for i in range(len(_CLASSES) + 1)]
    starts, ends, rows = tk.words(data, offsets)
    w = np.diff(rows).astype(float)
    many = np.maximum(w, 1)
    lens = (ends - starts).astype(float)

    def per_row(values: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate(([0.0], np.cumsum(values)))[rows])

    mean = per_row(lens) / many
    sd = np.sqrt(np.maximum(per_row(lens**2) / many - mean**2, 0))
    hashes = tk.spans_hash(tk.LOWER[data], starts, ends)
    last = kind[ends - 1]
    names = list(_CLASSES)
    signed = np.isin(last, [names.index("loud"), names.index("sign"), names.index("bar")])
    no_line = np.zeros(256, bool)
    no_line[[10, 13]] = True
    ls, le, lrows = tk.words(data, offsets, no_line)
    lines = np.diff(lrows).astype(float)
    k = 3
    grams = np.maximum(w - k + 1, 0)
    with np.errstate(over="ignore"):
        gram = hashes[: max(0, len(hashes) - k + 1)].copy()
        for j in range(1, k):
            gram = tk.mix(gram + hashes[j : j + len(gram)])
    owner = np.repeat(np.arange(len(w)), np.diff(rows))
    inside = owner[: len(gram)] == owner[len(owner) - len(gram) :] if len(gram) else np.zeros(0, bool)
    gram_rows = np.concatenate(([0], np.cumsum(grams))).astype(np.int64)
    cols += [
        np.log1p(n), np.log1p(w), mean, sd, tk.distinct_in(hashes, rows) / many, per_row(kind[starts] == names.index("upper")) / many,
        per_row(signed) / many, np.log1p(lines), tk.distinct_in(tk.spans_hash(data, ls, le), lrows) / np.maximum(lines, 1), w / np.maximum(lines, 1),
        tk.distinct_in(gram[inside], gram_rows) / np.maximum(grams, 1),
    ]
    return np.stack(cols, axis=1)


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = tk.buffers(batch.column("text"))
        for first, end, raw, offs in tk.chunks(data, offsets):
            x = statistics(raw, offs).astype(np.float32)
            values = pa.array(x.ravel())
            cuts = pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(first, end - first), pa.ListArray.from_arrays(cuts, values)], ["doc_id", "x"])


def described(docs: DataFrame) -> DataFrame:
    """(doc_id, x): the statistics of every text."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(_describe, f"doc_id {kind}, x array<float>")


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(np.float64)


def score_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE, threshold: float = THRESHOLD) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted, learned from ``labels`` (doc_id, ``label``)."""
    spark = docs.sparkSession
    stats = Scratch(spark).save(described(docs), "statistics")
    taught = labels.select("doc_id", F.col(label).cast("double").alias("y")).where(F.col("y").isNotNull() & ~held_out(F.col("doc_id")))
    rows = stats.join(thin(taught, sample), "doc_id").orderBy("doc_id").toArrow()
    x = _matrix(rows.column("x").combine_chunks()) if rows.num_rows else np.zeros((0, len(FEATURES)))
    model = spark.sparkContext.broadcast(gbdt.fit(x, rows.column("y").to_numpy()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = model.value.probability(_matrix(batch.column("x"))) if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(p)], ["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = stats.mapInArrow(run, f"doc_id {kind}, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
