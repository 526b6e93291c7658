"""Language identification by segmentation-marginalised unigrams.

The pieces are those of a public 32k vocabulary, which is fixed: only their
probabilities are learned here, one distribution for each language.  A text's
probability under a language is the product over its words of the sum over all
segmentations of the word into pieces of the product of piece probabilities.
That sum is the last value of a forward recursion over the word's bytes.

Words are runs of letters (A-Z lower-cased), which end at ASCII bytes that are no
letters and at the punctuation of other scripts; a word starts with the vocabulary's
space mark, which is dropped from pieces, so a piece means the same anywhere in a
word.  Single bytes back every piece up, so each word has a segmentation.

Learning takes labelled documents outside the held-out quarter, thinned by a hash
to about ``sample`` rows, and runs ``rounds`` of expectation-maximisation: the
forward and backward values of all distinct words give the expected number of
uses of each piece, for words of any length.  The fitted model is one array
(languages x pieces); every language that is taught has its column.

Both use whole texts.  Words are of any length, in scripts without blanks a clause.
Beyond ``WINDOW`` bytes the forward values are carried from window to window, so
time is in proportion to the length and memory bounded; learning cuts such words
into windows, all of which count.  In a batch each distinct word is scored once.

Defined cases: a null or empty text or one without a letter gives ``und`` with
score 0; with nothing to learn from, so does every text.  A null ``lang`` teaches
nothing.  Ties go to the language first in code-point order.  Rows with equal
doc_id are scored each.  An empty table gives no rows.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkernel as tk
from .common import held_out, table

#: Labelled documents that the probabilities are learned from, about.
SAMPLE = 6_000
ROUNDS = 3
#: Longest word in bytes that is scored with plain sums; longer ones are summed as logarithms.
LINEAR = 24
#: No piece of the vocabulary is longer, in bytes.
LONGEST = 256

#: Bytes of a word handled at once.
WINDOW = 4096

#: Bytes that end a word: everything but ASCII letters and bytes of other scripts.
NO_LETTER = np.ones(256, bool)
NO_LETTER[65:91] = NO_LETTER[97:123] = NO_LETTER[128:] = False


#: Blocks of punctuation outside ASCII as first bytes and the range of the last one, in UTF-8.
PUNCTUATION = [
    (b"\xc2", 0x80, 0xA9), (b"\xc2", 0xAB, 0xB4), (b"\xc2", 0xB6, 0xB9), (b"\xc2", 0xBB, 0xBF), (b"\xe2\x80", 0x80, 0x8B), (b"\xe2\x80", 0x8E, 0xBF), (b"\xe2\x81", 0x80, 0xAF),
    (b"\xe3\x80", 0x80, 0x84), (b"\xe3\x80", 0x88, 0xA0), (b"\xef\xbc", 0x81, 0x8F), (b"\xef\xbc", 0x9A, 0xA0), (b"\xef\xbc", 0xBB, 0xBF), (b"\xef\xbd", 0x9B, 0xA5),
]


def blanked(low: np.ndarray) -> np.ndarray:
    """The bytes with punctuation of other scripts turned into blanks, as many."""
    found = [(head, low_end, high_end, np.flatnonzero(low[: len(low) - len(head)] == head[0])) for head, low_end, high_end in PUNCTUATION]
    out = low
    for head, first, last, at in found:
        for k, byte in enumerate(head[1:], 1):
            at = at[low[at + k] == byte]
        end = low[at + len(head)]
        at = at[(end >= first) & (end <= last)]
        if len(at):
            out = low.copy() if out is low else out
            for k in range(len(head) + 1):
                out[at + k] = 32
    return out


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


@functools.cache
def pieces(path: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashes, sorted, of the vocabulary's letter pieces as bytes, and of all single bytes; the piece lengths that occur."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    texts = {bytes([b]) for b in range(256) if not NO_LETTER[b]}
    for i in range(model.get_piece_size()):
        if model.is_byte(i) or model.is_control(i) or model.is_unknown(i):
            continue
        raw = model.id_to_piece(i).replace("▁", "").lower().encode()
        if raw and not NO_LETTER[list(raw)].any():
            texts.add(raw)
    ordered = sorted(texts)
    data = np.frombuffer(b"".join(ordered), np.uint8)
    ends = np.cumsum([len(t) for t in ordered])
    hashes = tk.spans_hash(data, ends - [len(t) for t in ordered], ends)
    return np.sort(hashes), np.unique([len(t) for t in ordered])


def lattice(vocabulary: tuple[np.ndarray, np.ndarray], data: np.ndarray, starts: np.ndarray, ends: np.ndarray, langs: int) -> list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Words by length: (length, their indices, piece ids [word, end, size], -1 where no piece ends there with that size)."""
    keys, sizes = vocabulary
    out = []
    lens = ends - starts
    for n in np.unique(lens).tolist():
        which = np.flatnonzero(lens == n)
        for part in np.array_split(which, max(1, len(which) * n * (4 + langs) // 3_200_000)):
            use = sizes[sizes <= n]
            ids = np.full((len(part), n, len(use)), -1, np.int32)
            for j, size in enumerate(use.tolist()):
                at = (starts[part][:, None] + np.arange(n - size + 1)).ravel()
                step = max(1, len(at))
                # Overlapping spans are hashed as disjoint ones over a gathered copy.
                copy = data[(at[:, None] + np.arange(size)).ravel()]
                cut = np.arange(step + 1) * size
                h = tk.spans_hash(copy, cut[:-1], cut[1:])
                k = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
                ids[:, size - 1 :, j] = np.where(keys[k] == h, k, -1).reshape(len(part), -1)
            out.append((n, part, ids, use))
    return out


def forward(prob: np.ndarray, ids: np.ndarray, use: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Scaled forward values [word, position, language] and log of the scales; prob is [piece + 1, language], its last row 0."""
    m, n, _ = ids.shape
    alpha = np.zeros((m, n + 1, prob.shape[1]))
    alpha[:, 0] = 1
    log = np.zeros((m, prob.shape[1]))
    for i in range(1, n + 1):
        for j, size in enumerate(use.tolist()):
            if size <= i:
                alpha[:, i] += alpha[:, i - size] * prob[ids[:, i - 1, j]]
        if i % 16 == 0 or i == n:  # rescale everything that later positions read
            top = alpha[:, max(0, i - LONGEST + 1) : i + 1].max(axis=1)
            top[top == 0] = 1
            alpha[:, max(0, i - LONGEST + 1) : i + 1] /= top[:, None]
            log += np.log(top)
    return alpha, log


def log_sums(log_prob: np.ndarray, ids: np.ndarray, use: np.ndarray, back: bool = False) -> np.ndarray:
    """Logarithms of the forward values, or of the backward ones, [word, position, language]; nothing underflows at any length."""
    m, n, _ = ids.shape
    out = np.full((m, n + 1, log_prob.shape[1]), -np.inf)
    out[:, n if back else 0] = 0
    for i in range(n - 1, -1, -1) if back else range(1, n + 1):
        sizes = [(j, size) for j, size in enumerate(use.tolist()) if size <= (n - i if back else i)]
        ways = np.stack([out[:, i + size] + log_prob[ids[:, i + size - 1, j]] if back else out[:, i - size] + log_prob[ids[:, i - 1, j]] for j, size in sizes])
        top = ways.max(axis=0)
        out[:, i] = top + np.log(np.exp(ways - top).sum(axis=0))
    return out


def _blocks(columns: np.ndarray, cells: int) -> list[np.ndarray]:
    """``columns`` in blocks for which arrays of ``cells`` values a column stay small."""
    return np.array_split(columns, min(len(columns), 1 + len(columns) * cells // 3_200_000)) if len(columns) else []


def word_scores(model: np.ndarray, vocabulary: tuple[np.ndarray, np.ndarray], data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Log-probability of each word under each language, summed over all segmentations."""
    out = np.zeros((len(starts), model.shape[1]))
    log_model = None
    long = np.flatnonzero(ends - starts > WINDOW)
    if len(long):
        with np.errstate(divide="ignore"):
            log_model = np.log(model)
        for w in long.tolist():
            out[w] = long_word(log_model, vocabulary, data, int(starts[w]), int(ends[w]))
    short = np.flatnonzero(ends - starts <= WINDOW)
    for n, part, ids, use in lattice(vocabulary, data, starts[short], ends[short], model.shape[1]):
        part = short[part]
        for cols in _blocks(np.arange(model.shape[1]), len(part) * (n + 1)):
            if n <= LINEAR:
                alpha, log = forward(model[:, cols], ids, use)
                out[np.ix_(part, cols)] = log + np.log(np.maximum(alpha[:, n], 1e-300))
            else:
                if log_model is None:
                    with np.errstate(divide="ignore"):
                        log_model = np.log(model)
                out[np.ix_(part, cols)] = log_sums(log_model[:, cols], ids, use)[:, n]
    return out


def long_word(log_model: np.ndarray, vocabulary: tuple[np.ndarray, np.ndarray], data: np.ndarray, start: int, end: int) -> np.ndarray:
    """Log-probability of one word under each language, window by window; what is carried are the last forward values."""
    reach, langs = int(vocabulary[1][-1]), log_model.shape[1]
    tail = np.full((reach, langs), -np.inf)
    tail[-1] = 0
    for a in range(start, end, WINDOW):
        b, low = min(a + WINDOW, end), max(start, a - reach)
        _, _, ids, use = lattice(vocabulary, data, np.array([low]), np.array([b]), langs)[0]
        ids = ids[0, a - low :]
        alpha = np.concatenate([tail, np.empty((b - a, langs))])
        for i in range(b - a):
            ways = alpha[reach + i - use] + log_model[ids[i]]
            top = ways.max(axis=0)
            alpha[reach + i] = top + np.log(np.exp(ways - top).sum(axis=0))
        tail = alpha[-reach:]
    return tail[-1]


def expected(prob: np.ndarray, vocabulary: tuple[np.ndarray, np.ndarray], data: np.ndarray, starts: np.ndarray, ends: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Expected uses [piece, language] of each piece over all segmentations of the words, ``weight`` [word, language] being counts."""
    uses = np.zeros((len(prob), prob.shape[1]))
    with np.errstate(divide="ignore"):
        log_prob = np.log(prob)
    for n, part, ids, use in lattice(vocabulary, data, starts, ends, prob.shape[1]):
        for cols in _blocks(np.flatnonzero(weight[part].any(axis=0)), 2 * len(part) * (n + 1)):
            p, w = log_prob[:, cols], weight[np.ix_(part, cols)]
            alpha, beta = log_sums(p, ids, use), log_sums(p, ids, use, back=True)
            total = alpha[:, n]
            for i in range(1, n + 1):
                for j, size in enumerate(use.tolist()):
                    if size <= i:
                        k = ids[:, i - 1, j]
                        some = np.flatnonzero(k >= 0)
                        if len(some):
                            got = w[some] * np.exp(alpha[some, i - size] + p[k[some]] + beta[some, i] - total[some])
                            np.add.at(uses, (k[some][:, None], cols), got)
    return uses


def distinct_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes; starts and ends of distinct words; for each word its distinct one; first word of each row (n + 1)."""
    low = blanked(tk.LOWER[data])
    starts, ends, rows = tk.words(low, offsets, NO_LETTER)
    _, first, inverse = np.unique(tk.spans_hash(low, starts, ends), return_index=True, return_inverse=True)
    return low, starts[first], ends[first], inverse, rows


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, word, n) of the sample, summed in each chunk."""
    for batch in batches:
        data, offsets = tk.buffers(batch.column("text"))
        lang = batch.column("lang").dictionary_encode()
        names, code = lang.dictionary, lang.indices.to_numpy(zero_copy_only=False)
        for first, end, raw, offs in tk.chunks(data, offsets):
            low, starts, ends, inverse, rows = distinct_words(raw, offs)
            owner = np.repeat(code[first:end], np.diff(rows))
            key, n = np.unique(inverse.astype(np.int64) * len(names) + owner, return_counts=True)
            buf = low.tobytes()
            text = [buf[starts[k] : ends[k]] for k in (key // len(names)).tolist()]
            yield pa.RecordBatch.from_arrays([names.take(pa.array(key % len(names))), pa.array(text, pa.binary()), pa.array(n)], ["lang", "word", "n"])


def fit(counts: pa.Table, path: str, rounds: int = ROUNDS) -> tuple[list[str], np.ndarray]:
    """Languages in code-point order and probabilities [piece + 1, language] from rows (lang, word, n)."""
    vocabulary = pieces(path)
    langs = sorted(set(counts.column("lang").to_pylist()))
    where = {x: i for i, x in enumerate(langs)}
    code = np.array([where[x] for x in counts.column("lang").to_pylist()], np.int64)
    distinct = counts.column("word").combine_chunks().dictionary_encode()
    words, at = distinct.dictionary.to_pylist(), distinct.indices.to_numpy(zero_copy_only=False)
    weight = np.zeros((len(words), len(langs)))
    np.add.at(weight, (at, code), counts.column("n").to_numpy())
    owner = np.array([i for i, w in enumerate(words) for _ in range(0, len(w), WINDOW)], np.int64)
    parts = [w[a : a + WINDOW] for w in words for a in range(0, len(w), WINDOW)]
    weight = weight[owner]
    data = np.frombuffer(b"".join(parts), np.uint8)
    lens = np.array([len(w) for w in parts], np.int64)
    ends = np.cumsum(lens)
    size = len(vocabulary[0])
    prob = np.append(np.full((size, len(langs)), 1.0 / size), np.zeros((1, len(langs))), axis=0)
    for _ in range(rounds):
        uses = expected(prob, vocabulary, data, ends - lens, ends, weight)[:size]
        pooled = uses.sum(axis=1) + 1e-3
        uses += 20.0 * (pooled / pooled.sum())[:, None] * 1.0 + 1e-4  # a Dirichlet prior centred on all languages together
        prob[:size] = uses / uses.sum(axis=0)
    return langs, prob


def identify(docs: DataFrame, vocabulary_path: str | None = None, sample: int = SAMPLE, rounds: int = ROUNDS) -> DataFrame:
    """Per document: doc_id, held_out, lang_pred, score."""
    spark = docs.sparkSession
    path = vocabulary_path or default_vocabulary()
    taught = docs.where(F.col("lang").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", "lang", "text")
    by_lang = taught.groupBy("lang").count().collect()
    total, share = sum(r["count"] for r in by_lang), max(50, sample // max(1, len(by_lang)))
    # About sample / languages documents of each language, by a hash of the id.
    quota = spark.createDataFrame([(r["lang"], int(min(1.0, share / r["count"]) * (1 << 30))) for r in by_lang], "lang string, quota long")
    rows = taught.join(F.broadcast(quota), "lang").where(F.pmod(F.xxhash64(F.lit(7), "doc_id"), F.lit(1 << 30)) < F.col("quota")) if total else taught.limit(0)
    counts = rows.select("lang", "text").mapInArrow(_word_counts, "lang string, word binary, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    found = counts.orderBy("lang", "word").toArrow()
    model = fit(found, path, rounds) if found.num_rows else ([], np.zeros((0, 0)))
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, prob = shared.value
        vocabulary = pieces(path)
        for batch in batches:
            data, offsets = tk.buffers(batch.column("text"))
            letter = batch.column("letter").to_numpy(zero_copy_only=False)
            for first, end, raw, offs in tk.chunks(data, offsets, 4 * tk.CHUNK):
                n = end - first
                names, score = ["und"] * n, np.zeros(n)
                if langs:
                    low, starts, ends, inverse, rows = distinct_words(raw, offs)
                    each = word_scores(prob, vocabulary, low, starts, ends)
                    total = np.stack([np.diff(np.concatenate(([0.0], np.cumsum(each[inverse, c])))[rows]) for c in range(len(langs))], axis=1)
                    best = total.argmax(axis=1)
                    odds = np.exp(np.clip(total - total.max(axis=1, keepdims=True), -700, 0))
                    some = letter[first:end] & (np.diff(rows) > 0)
                    score = np.where(some, 1 / odds.sum(axis=1), 0.0)
                    names = [langs[b] if s else "und" for b, s in zip(best.tolist(), some.tolist())]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(first, n), pa.array(names, pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    letter = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letter")
    scored = docs.select("doc_id", "text", letter).mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))
