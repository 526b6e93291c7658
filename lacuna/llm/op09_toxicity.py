"""Toxicity by maximum-scoring segment search.

Learning.  From labelled rows outside the held-out quarter, thinned by a hash to
about ``sample`` of each class, the engine counts in how many toxic and clean
documents each token occurs.  A token's rate of toxic documents is smoothed by a
Dirichlet (for two classes, Beta) prior centred on the rate of its six-byte
prefix, that one on its four-byte prefix, that one on the base rate; the token's
log-odds is the logit of its rate less that of the base.  Tokens with log-odds
above 1 score these, every other token scores ``drift``.

Search.  In a text's token scores the linear-time all-maximal-subsequences scan
finds every maximal scoring passage.

Calibration.  Passages of clean documents have an exponential tail of scores, so
the best one of n tokens follows an extreme-value law with location
(ln K + ln n) / lambda.  Over the sample's clean documents, lambda is one over
the mean excess of passages above their median score, and K their number a
token, carried back to score 0.  A passage is significant when its E-value K n exp(-lambda S) is below ``e_value``.  A
document's evidence is the sum over its significant passages of -ln E; a
logistic curve fitted on the sample, each document scored by counts that leave
it out, turns it into the score.

Tokens are runs of letters, digits and non-ASCII bytes, A-Z lower-cased.

Defined cases: a null or empty text, or one without tokens, has no passage and
gets the score of no evidence, the same as any clean text; null labels teach
nothing; with one class only, every document gets the smoothed base rate.  Rows
with equal doc_id are scored each.  An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textkernel as tk
from .common import Scratch, held_out, table, thin

#: Labelled rows of each class that the lexicon and the calibration are learned from, about.
SAMPLE = 8_000
THRESHOLD = 0.3
#: Support of a token form: in fewer toxic documents of the sample than this, and in fewer than four times as many
#: clean ones, it has no rate of its own and takes its prefix's.  A rate from one document would say who wrote it.
LEAST = 2
PREFIXES = (4, 6)
#: Passages expected by chance in a clean document of the same length, below which one is significant.
E_VALUE = 0.5


@dataclass(frozen=True)
class Lexicon:
    """Document counts by token form: at each level sorted hashes, toxic and clean documents, and the rate of the form's prefix."""

    keys: list[np.ndarray]
    toxic: list[np.ndarray]
    clean: list[np.ndarray]
    parent: list[np.ndarray]
    prior: float
    alpha: float
    drift: float

    def score(self, levels: list[np.ndarray], own: np.ndarray | None = None) -> np.ndarray:
        """Log-odds of tokens given their hashes, longest form first: the first known form counts.

        ``own`` is the label of the token's document where that document is in
        the counts; it is then left out of them.
        """
        rate = np.full(len(levels[0]), np.nan)
        for keys, toxic, clean, parent, h in zip(self.keys, self.toxic, self.clean, self.parent, levels):
            if len(keys):
                at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
                t, c = toxic[at], clean[at]
                if own is not None:
                    t, c = np.maximum(t - own, 0), np.maximum(c - (1 - own), 0)
                mine = (t + self.alpha * parent[at]) / (t + c + self.alpha)
                rate = np.where(np.isnan(rate) & (keys[at] == h), mine, rate)
        odds = np.log(rate / (1 - rate)) - np.log(self.prior / (1 - self.prior))
        return np.where(odds > self.floor, odds, self.drift)

    @property
    def floor(self) -> float:
        """Log-odds that a token needs to count for toxicity."""
        return 1.0


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Hashes of all tokens, of their six-byte and of their four-byte prefixes; first token of each row (n + 1)."""
    low = tk.LOWER[data]
    starts, ends, rows = tk.words(low, offsets, tk.BREAK)
    forms = [tk.spans_hash(low, starts, ends)]
    for level, n in enumerate(reversed(PREFIXES)):
        forms.append(tk.mix(tk.spans_hash(low, starts, np.minimum(starts + n, ends)) + np.uint64(level + 1)))
    return forms, rows


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring subsequences (start, end, score), in one left-to-right scan of linear time.

    The candidates are disjoint and in order, each with the running totals before
    and after it, and a link to the nearest one before that starts lower.  A new
    positive score joins the nearest candidate that starts lower if that one does
    not reach as high.  What a search passes over lies behind the new candidate's
    link or inside it, so no later search visits it again.
    """
    total = np.concatenate(([0.0], np.cumsum(scores)))
    hits = np.flatnonzero(scores > 0)
    starts: list[int] = []
    ends: list[int] = []
    lows: list[float] = []
    highs: list[float] = []
    links: list[int] = []
    for i, low, high in zip(hits.tolist(), total[hits].tolist(), total[hits + 1].tolist()):
        start, j = i, len(lows) - 1
        while j >= 0 and lows[j] >= low:
            j = links[j]
        while j >= 0 and highs[j] < high:
            start, low, link = starts[j], lows[j], links[j]
            for column in (starts, ends, lows, highs, links):
                del column[j:]
            j = link
        starts.append(start)
        ends.append(i + 1)
        lows.append(low)
        highs.append(high)
        links.append(j)
    return [(a, b, high - low) for a, b, low, high in zip(starts, ends, lows, highs)]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(level, key, parent, toxic, clean): documents of a chunk that hold a token form, and its prefix's key."""
    for batch in batches:
        data, offsets = tk.buffers(batch.column("text"))
        toxic = batch.column("y").to_numpy(zero_copy_only=False) > 0
        for first, end, raw, offs in tk.chunks(data, offsets, 4 * tk.CHUNK):
            forms, rows = tokens(raw, offs)
            owner = np.repeat(np.arange(end - first), np.diff(rows))
            for level, h in enumerate(forms):
                up = forms[min(level + 1, len(forms) - 1)]
                order = np.lexsort((owner, h))
                k, o = h[order], owner[order]
                new = np.ones(len(k), bool)
                new[1:] = (k[1:] != k[:-1]) | (o[1:] != o[:-1])
                bad = toxic[first + o[new]]
                keys, at, inverse = np.unique(k[new], return_index=True, return_inverse=True)
                n = np.bincount(inverse, minlength=len(keys))
                t = np.bincount(inverse, bad, minlength=len(keys)).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(keys), level, np.int32)), pa.array(keys.view(np.int64)), pa.array(up[order][new][at].view(np.int64)), pa.array(t), pa.array(n - t)],
                    ["level", "key", "parent", "toxic", "clean"],
                )


def lexicon(counts: pa.Table, n_toxic: int, n_clean: int, alpha: float = 1.0, drift: float = -1.0) -> Lexicon:
    """Rates with nested Dirichlet priors: base rate, four-byte prefix, six-byte prefix, token."""
    prior = (n_toxic + 0.5) / (n_toxic + n_clean + 1)
    level, key, up = counts.column("level").to_numpy(), counts.column("key").to_numpy().view(np.uint64), counts.column("parent").to_numpy().view(np.uint64)
    t, c = counts.column("toxic").to_numpy().astype(float), counts.column("clean").to_numpy().astype(float)
    n = len(PREFIXES) + 1
    keys, toxic, clean, parent = ([None] * n for _ in range(4))
    above = (np.zeros(0, np.uint64), np.zeros(0))
    for i in reversed(range(n)):
        mine = np.flatnonzero(level == i)
        mine = mine[np.argsort(key[mine])]
        keys[i], toxic[i], clean[i] = key[mine], t[mine], c[mine]
        parent[i] = np.full(len(mine), prior)
        if len(above[0]):
            at = np.minimum(np.searchsorted(above[0], up[mine]), len(above[0]) - 1)
            parent[i] = np.where(above[0][at] == up[mine], above[1][at], prior)
        # Leaving half a document out of the prefix's rate keeps a form that is its prefix's only one from counting twice.
        above = (keys[i], (np.maximum(toxic[i] - 1, 0) + alpha * parent[i]) / (np.maximum(toxic[i] - 1, 0) + clean[i] + alpha))
    return Lexicon(keys, toxic, clean, parent, prior, alpha, drift)


@dataclass(frozen=True)
class Calibration:
    rate: float
    log_k: float
    e_value: float
    intercept: float
    slope: float

    def log_e(self, score: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Log of the number of passages scoring as much expected in a clean document of ``n`` tokens."""
        return self.log_k + np.log(np.maximum(n, 1)) - self.rate * score

    def probability(self, evidence: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.intercept + self.slope * evidence, -500, 500)))


def passages(lex: Lexicon, data: np.ndarray, offsets: np.ndarray, y: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All maximal passages of all rows: row, start and end token, score; and each row's number of tokens.

    ``y`` are the labels of rows that the lexicon was learned from; each is scored as if left out.
    """
    forms, rows = tokens(data, offsets)
    score = lex.score(forms, None if y is None else np.repeat(y, np.diff(rows)))
    hits = tk.counts_in(score > 0, rows)
    out = [(i, *s) for i in np.flatnonzero(hits).tolist() for s in segments(score[rows[i] : rows[i + 1]])]
    row, start, end, total = (np.array(c) for c in zip(*out)) if out else (np.zeros(0, np.int64),) * 3 + (np.zeros(0),)
    return row, start, end, total, np.diff(rows)


def _best(lex):
    """(y, n, tokens, scores of all passages) of the sample's documents, for the calibration."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = tk.buffers(batch.column("text"))
            for first, end, raw, offs in tk.chunks(data, offsets):
                y = batch.column("y").slice(first, end - first).to_numpy(zero_copy_only=False)
                row, _, _, total, n = passages(lex.value, raw, offs, y)
                cuts = np.searchsorted(row, np.arange(end - first + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([batch.column("y").slice(first, end - first), pa.array(n), pa.ListArray.from_arrays(pa.array(cuts), pa.array(total.astype(float)))], ["y", "n", "scores"])

    return run


def calibrate(y: np.ndarray, n: np.ndarray, scores: list[np.ndarray], weight: np.ndarray, e_value: float) -> Calibration:
    """Extreme-value law from clean documents, then the logistic curve over the evidence."""
    best = np.array([s.max() if len(s) else 0.0 for s in scores])
    clean = (y == 0) & (n > 0)
    # An exponential tail of single passages: mean excess over the median passage; K from their number a token.
    pool = np.concatenate([s for s, c in zip(scores, clean) if c] or [np.zeros(0)])
    if len(pool) >= 10:
        low = float(np.median(pool))
        rate = 1 / max(float((pool[pool >= low] - low).mean()), 0.2)
        log_k = float(np.log((pool >= low).sum() / n[clean].sum()) + rate * low)
    else:
        rate, log_k = 1.0, float(np.log(1 / max(n[clean].sum(), 1)))
    cal = Calibration(rate, log_k, e_value, 0.0, 0.0)
    evidence = np.array([evidence_of(cal, s, np.full(len(s), m)) for s, m in zip(scores, n)])
    top = np.log1p(evidence)
    b = np.zeros(2)
    x = np.stack([np.ones_like(top), top], axis=1)
    for _ in range(50):  # Newton steps with a light ridge
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        g = x.T @ (weight * (y - p)) - 1e-2 * b * [0, 1]
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + np.diag([1e-6, 1e-2])
        step = np.linalg.solve(h, g)
        b += np.clip(step, -3, 3)
        if np.abs(step).max() < 1e-8:
            break
    return Calibration(rate, log_k, e_value, float(b[0]), float(max(b[1], 0.0)))


def evidence_of(cal: Calibration, score: np.ndarray, n: np.ndarray) -> float:
    """Sum of -ln E over passages with E below the limit."""
    log_e = cal.log_e(score, n)
    return float(-log_e[log_e < np.log(cal.e_value)].sum()) if len(log_e) else 0.0


def train(docs: DataFrame, labels: DataFrame, label: str, sample: int, e_value: float) -> tuple[Lexicon, Calibration] | float:
    """The lexicon and the calibration; with one class or none, the smoothed base rate."""
    spark = docs.sparkSession
    taught = labels.select("doc_id", F.col(label).cast("int").alias("y")).where(F.col("y").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    share = {r["y"]: r["count"] for r in taught.where(F.col("y").isin(0, 1)).groupBy("y").count().collect()}
    n1, n0 = share.get(1, 0), share.get(0, 0)
    if not n1 or not n0:
        return (n1 + 0.5) / (n1 + n0 + 1)
    picked = thin(taught.where(F.col("y") == 1), sample).unionAll(thin(taught.where(F.col("y") == 0), sample))
    # At most about 2 * sample rows whatever the input, hence broadcast; one scan keeps the sample's texts.
    rows = Scratch(spark).save(docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").select("text", "y"), "sample")
    found = {r["y"]: r["count"] for r in rows.groupBy("y").count().collect()}
    if not found.get(1) or not found.get(0):
        return (n1 + 0.5) / (n1 + n0 + 1)
    counts = (
        rows.mapInArrow(_count, "level int, key long, parent long, toxic long, clean long").groupBy("level", "key")
        .agg(F.min("parent").alias("parent"), F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")).where((F.col("toxic") >= LEAST) | (F.col("clean") >= 4 * LEAST))
        .toArrow()
    )
    lex = lexicon(counts, found[1], found[0])
    shared = spark.sparkContext.broadcast(lex)
    seen = rows.mapInArrow(_best(shared), "y int, n long, scores array<double>").toArrow()
    y, n = seen.column("y").to_numpy().astype(float), seen.column("n").to_numpy()
    scores = [np.array(s, float) for s in seen.column("scores").to_pylist()]
    weight = np.where(y > 0, n1 / found[1], n0 / found[0])
    return lex, calibrate(y, n, scores, weight / weight.mean(), e_value)


def score_toxicity(
    docs: DataFrame, labels: DataFrame, label: str = "toxic", sample: int = SAMPLE, threshold: float = THRESHOLD, e_value: float = E_VALUE, keep: tuple[str, ...] = ("doc_id",)
) -> DataFrame:
    """The columns ``keep`` of each document, held_out, score, predicted, and its significant passages (start and end token, score)."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels, label, sample, e_value))
    kept = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))
    names = [f"_{i}" for i in range(len(keep))]
    added = ["_score", "_passages"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = tk.buffers(batch.column("_text"))
            for first, end, raw, offs in tk.chunks(data, offsets):
                n = end - first
                spans: list[list] = [[] for _ in range(n)]
                if isinstance(shared.value, float):
                    score = np.full(n, shared.value)
                else:
                    lex, cal = shared.value
                    row, a, b, total, size = passages(lex, raw, offs)
                    log_e = cal.log_e(total, size[row])
                    good = log_e < np.log(cal.e_value)
                    evidence = np.bincount(row[good], -log_e[good], minlength=n) if good.any() else np.zeros(n)
                    for i, s, e, t in zip(row[good].tolist(), a[good].tolist(), b[good].tolist(), total[good].tolist()):
                        spans[i].append({"start": s, "end": e, "score": t})
                    score = cal.probability(np.log1p(evidence))
                own = [batch.column(c).slice(first, n) for c in names]
                yield pa.RecordBatch.from_arrays([*own, pa.array(score), pa.array(spans, kept)], names + added)

    types = ", ".join(f"_{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(keep))
    columns = [docs[c].alias(n) for c, n in zip(keep, names)] + [docs["text"].alias("_text"), held_out(docs["doc_id"]).alias("_held")]
    schema = f"{types}, _held boolean, _score double, _passages array<struct<start:long,end:long,score:double>>"
    names = [*names, "_held"]
    scored = docs.select(*columns).mapInArrow(run, schema)
    return scored.select(
        *[F.col(f"_{i}").alias(c) for i, c in enumerate(keep)], F.col("_held").alias("held_out"), F.col("_score").alias("score"),
        (F.col("_score") >= threshold).cast("int").alias("predicted"), F.col("_passages").alias("passages"),
    )


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.withColumn("n_passages", F.size("passages").cast("long")).drop("passages")
