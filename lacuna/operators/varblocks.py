"""Smoothing of autoregressive series in blocks of rows, exactly.

A VAR(p) couples a row with the p rows before it only.  A series is cut into
blocks; the last p rows of a block are its border.  Given the borders, blocks do
not know of each other, so every block eliminates its inner unknown cells where
it is and sends a small quadratic form in its two borders.  Those forms are a
chain, solved forwards and backwards by group: means and covariances of borders,
or a draw from their law.  Then each block solves its inner cells given its borders.
The result is the Gaussian law of all unknown cells given all known ones; where
the cuts lie changes nothing.

The M-step takes the expected second moments of (1, x_t, ..., x_(t-p)), the
covariance of unknown cells within the window included, summed over all rows.
What meets by group is one form for each block, a few numbers for some hundred rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import rand
from ..storage import Scratch
from .rowwise import SMALL, Parameters

#: Cells of a block, at most about.
CELLS = 768
#: Precision, in units of the noise's, of a weak prior for unknown cells among the first p rows, which have no row before them.
WEAK = 1e-6


class Block:
    """One block's rows (those of the border before it first) and its quadratic form in its free cells.

    ``p`` are the parameters (B by rows, S): x_t = b_0 + sum of x_(t-k) B_k + noise of covariance S.
    """

    def __init__(self, x: np.ndarray, z: np.ndarray, first: int, start: int, halo: int, last: bool, b: np.ndarray, s: np.ndarray, lags: int):
        m, d = x.shape
        self.lags, self.halo, self.d, self.m = lags, halo, d, m
        free = np.isnan(x) & (np.arange(first, first + m) >= start)[:, None]
        self.value = np.where(np.isnan(x), z, x)
        at = np.arange(max(halo, lags if first == 0 else halo), m)
        self.at = at
        w = np.linalg.cholesky(np.linalg.inv(s)).T
        # What a row's noise takes of the row k before it.
        part = [w, *(-w @ b[1 + (k - 1) * d : 1 + k * d].T for k in range(1, lags + 1))]
        self.cells = np.flatnonzero(free.ravel())
        self.number = np.full((m, d), -1)  # of each free cell
        self.number.ravel()[self.cells] = np.arange(len(self.cells))
        fixed, g = np.where(free, 0.0, self.value), np.zeros((m, d))
        right = w @ b[0] - sum(fixed[at - k] @ c.T for k, c in enumerate(part))
        self.h = np.zeros((len(self.cells),) * 2)
        self.pairs = {(i, j): self._met(i, j) for i in range(lags + 1) for j in range(lags + 1)}
        for i, ci in enumerate(part):
            g[at - i] += right @ ci
            for j, cj in enumerate(part):
                one, other, which = self.pairs[i, j]
                self.h[one, other] += (ci.T @ cj).ravel()[which]  # no pair of cells comes twice
        self.g = g.ravel()[self.cells]
        rows = self.cells // d
        weak = np.where(first + rows < lags, WEAK / np.diag(s)[self.cells % d], 0.0) * (rows >= halo)
        self.h[np.diag_indices(len(self.cells))] += weak
        self.g += weak * z.ravel()[self.cells]
        edge = rows < halo
        if not last:
            edge |= rows >= m - lags
        self.edge, self.inner = np.flatnonzero(edge), np.flatnonzero(~edge)
        # Places in the pair of borders, each of lags x d cells.
        e = self.cells[self.edge]
        self.place = np.where(e // d < halo, e, lags * d + e - (m - lags) * d)
        hi = self.h[np.ix_(self.inner, self.inner)]
        self.inverse = np.linalg.inv(hi) if len(self.inner) else hi
        self.to_edge = self.inverse @ self.h[np.ix_(self.inner, self.edge)]

    def _met(self, i: int, j: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The pairs of free cells in the rows i and j before each row: their numbers, and which of the d x d pairs of columns."""
        one, other = (np.broadcast_to(x, (len(self.at), self.d, self.d)) for x in (self.number[self.at - i][:, :, None], self.number[self.at - j][:, None, :]))
        n, a, b = np.nonzero((one >= 0) & (other >= 0))
        return one[n, a, b], other[n, a, b], a * self.d + b

    def form(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The quadratic form in the two borders: matrix, right side, and which of their cells are free."""
        k = 2 * self.lags * self.d
        out, right, is_free = np.zeros((k, k)), np.zeros(k), np.zeros(k)
        hie = self.h[np.ix_(self.inner, self.edge)]
        out[np.ix_(self.place, self.place)] = self.h[np.ix_(self.edge, self.edge)] - hie.T @ self.to_edge
        right[self.place] = self.g[self.edge] - self.to_edge.T @ self.g[self.inner]
        is_free[self.place] = 1
        return out, right, is_free

    def given(self, edge: np.ndarray, rng: np.random.Generator | None = None) -> np.ndarray:
        """All rows, the free cells at their means given the borders' values, or drawn."""
        f = np.zeros(len(self.cells))
        f[self.edge] = edge[self.place]
        f[self.inner] = self.inverse @ self.g[self.inner] - self.to_edge @ f[self.edge]
        if rng is not None and len(self.inner):
            e, v = np.linalg.eigh(self.inverse)
            f[self.inner] += v @ (np.sqrt(np.maximum(e, 0)) * rng.standard_normal(len(e)))
        out = self.value.ravel().copy()
        out[self.cells] = f
        return out.reshape(self.m, self.d)

    def covariance(self, edge: np.ndarray) -> np.ndarray:
        """Of the free cells, from that of the borders."""
        n = len(self.cells)
        c = np.zeros((n, n))
        ce = edge[np.ix_(self.place, self.place)]
        c[np.ix_(self.edge, self.edge)] = ce
        c[np.ix_(self.inner, self.inner)] = self.inverse + self.to_edge @ ce @ self.to_edge.T
        c[np.ix_(self.inner, self.edge)] = -self.to_edge @ ce
        c[np.ix_(self.edge, self.inner)] = -(self.to_edge @ ce).T
        return c

    def moments(self, mean: np.ndarray, edge: np.ndarray | None) -> np.ndarray:
        """The sum over the block's rows of E[w w'], w = (1, x_t, x_(t-1), ..., x_(t-lags))."""
        w = np.concatenate([np.ones((len(self.at), 1)), *[mean[self.at - k] for k in range(self.lags + 1)]], axis=1)
        out = w.T @ w
        if edge is not None and len(self.cells):
            c, d = self.covariance(edge), self.d
            for i in range(self.lags + 1):
                for j in range(self.lags + 1):
                    one, other, which = self.pairs[i, j]
                    out[1 + i * d : 1 + (i + 1) * d, 1 + j * d : 1 + (j + 1) * d] += np.bincount(which, c[one, other], d * d).reshape(d, d)
        return out


def chain(forms: list[tuple[np.ndarray, np.ndarray, np.ndarray]], noise: list[np.ndarray] | None = None) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """For each block the values (means, or a draw where there is noise) and the covariance of its two borders."""
    n, k = len(forms), len(forms[0][1]) // 2
    diag = [np.zeros((k, k)) for _ in range(n - 1)]
    right = [np.zeros(k) for _ in range(n - 1)]
    across = [forms[s + 1][0][:k, k:] for s in range(n - 2)]
    for s in range(n - 1):
        diag[s] += forms[s][0][k:, k:] + forms[s + 1][0][:k, :k]
        right[s] += forms[s][1][k:] + forms[s + 1][1][:k]
        free = np.maximum(forms[s][2][k:], forms[s + 1][2][:k])
        diag[s] += np.diag(1 - free)
    inverse, gain = [], []
    for s in range(n - 1):
        if s:
            diag[s] = diag[s] - across[s - 1].T @ inverse[-1] @ across[s - 1]
            right[s] = right[s] - across[s - 1].T @ inverse[-1] @ right[s - 1]
        inverse.append(np.linalg.inv(diag[s]))
        gain.append(inverse[-1] @ across[s] if s < n - 2 else np.zeros((k, k)))
    value, cov = [np.zeros(k)] * (n - 1), [np.zeros((k, k))] * (n - 1)
    for s in range(n - 2, -1, -1):
        value[s] = inverse[s] @ right[s] - (gain[s] @ value[s + 1] if s < n - 2 else 0)
        if noise is not None:
            e, v = np.linalg.eigh(inverse[s])
            value[s] = value[s] + v @ (np.sqrt(np.maximum(e, 0)) * noise[s])
        cov[s] = inverse[s] + (gain[s] @ cov[s + 1] @ gain[s].T if s < n - 2 else 0)
    values, covs = [], []
    for b in range(n):
        v, c = np.zeros(2 * k), np.zeros((2 * k, 2 * k))
        if b:
            v[:k], c[:k, :k] = value[b - 1], cov[b - 1]
        if b < n - 1:
            v[k:], c[k:, k:] = value[b], cov[b]
        if 0 < b < n - 1:
            c[:k, k:] = -gain[b - 1] @ cov[b]
            c[k:, :k] = c[:k, k:].T
        values.append(v)
        covs.append(c)
    return values, covs


def solve_moments(m: np.ndarray, d: int, lags: int) -> tuple[np.ndarray, np.ndarray]:
    """B and S from the sum of E[w w']; its first cell is the number of rows."""
    past = [0, *range(1 + d, 1 + (lags + 1) * d)]
    zz, zy, yy = m[np.ix_(past, past)], m[np.ix_(past, range(1, 1 + d))], m[1 : 1 + d, 1 : 1 + d]
    b = np.linalg.pinv(zz, rcond=1e-10, hermitian=True) @ zy
    s = (yy - b.T @ zy - zy.T @ b + b.T @ zz @ b) / max(m[0, 0], 1)
    s = (s + s.T) / 2
    return b, s + (1e-9 * np.trace(s) / d + 1e-12) * np.eye(d)


def each(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """The rows of batches one by one, lists as numpy arrays, so that no batch becomes Python numbers as a whole."""
    for batch in batches:
        columns = {}
        for name, c in zip(batch.schema.names, batch.columns):
            if pa.types.is_list(c.type):
                at, flat = c.offsets.to_numpy(), c.values.to_numpy(zero_copy_only=False)
                columns[name] = lambda i, at=at, flat=flat: flat[at[i] : at[i + 1]]
            else:
                columns[name] = lambda i, c=c: c[i].as_py()
        for i in range(batch.num_rows):
            yield {name: f(i) for name, f in columns.items()}


def gathered(rows: Iterator[dict], schema: pa.Schema, most: int = 1 << 17) -> Iterator[pa.RecordBatch]:
    """Batches of about ``most`` numbers; a row is a dict of arrays of one length, for a list column a matrix."""

    def packed() -> pa.RecordBatch:
        out = []
        for f in schema:
            v = np.concatenate([r[f.name] for r in held])
            out.append(pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1, dtype=np.int32) * v.shape[1]), pa.array(v.ravel())) if pa.types.is_list(f.type) else pa.array(v, f.type))
        return pa.RecordBatch.from_arrays(out, schema.names)

    held, n = [], 0
    for r in rows:
        held.append(r)
        n += sum(v.size for v in r.values())
        if n >= most:
            yield packed()
            held, n = [], 0
    if held:
        yield packed()


class Series:
    """Rows (g, i, v, z) of all groups (values with NaN, values to start with), cut into stored blocks."""

    def __init__(self, rows: DataFrame, d: int, lags: int, scratch: Scratch, length: int | None = None):
        self.d, self.lags, self.scratch = d, lags, scratch
        self.length = length = max(length or CELLS // d, 2 * lags, 1)
        whole = ~F.exists("v", F.isnan)
        groups = rows.groupBy("g").agg(F.count("*").alias("n"), F.coalesce(F.min(F.when(whole, F.col("i"))), F.lit(0)).alias("start"))
        groups = groups.where(F.col("n") >= lags + 3).select("g", F.monotonically_increasing_id().alias("gid"), F.xxhash64("g").alias("hashed"), "n", "start")
        self.groups = scratch.save(groups, "groups", tidy=False)
        self.n_groups = self.groups.count()
        b = F.floor(F.col("i") / length)
        met = rows.join(self.groups, "g")
        ahead = (F.col("i") % length >= length - lags) & ((b + 1) * length < F.col("n"))
        dealt = met.select("gid", "hashed", "n", "start", "i", "v", "z", F.explode(F.when(ahead, F.array(b, b + 1)).otherwise(F.array(b))).alias("b"))
        cut = dealt.groupBy("gid", "b").agg(F.first("hashed").alias("hashed"), F.first("n").alias("n"), F.first("start").alias("start"), F.array_sort(F.collect_list(F.struct("i", "v", "z"))).alias("rows"))  # at most length + lags rows
        flat = lambda c: F.flatten(F.transform("rows", lambda r: r[c])).alias(c)
        self.blocks = scratch.save(cut.select("gid", "b", "hashed", "n", "start", F.col("rows")[0]["i"].alias("first"), flat("v"), flat("z")), "blocks")

    def of(self, row: dict, p: np.ndarray | None = None) -> Block:
        d, lags = self.d, self.lags
        x, z = (np.array(row[c], float).reshape(-1, d) for c in ("v", "z"))
        if p is None:
            b, s = np.zeros((1 + lags * d, d)), np.eye(d)
        else:
            b, s = p[1 : 1 + (1 + lags * d) * d].reshape(-1, d), p[-d * d :].reshape(d, d)
        return Block(x, z, int(row["first"]), int(row["start"]), lags if row["b"] else 0, (row["b"] + 1) * self.length >= row["n"], b, s, lags)

    def light(self) -> Series:
        """What tasks need of this: no table."""
        out = object.__new__(Series)
        out.d, out.lags, out.length = self.d, self.lags, self.length
        return out

    def borders(self, params: DataFrame, seed: int | None = None) -> DataFrame:
        """(gid, b, value, cov): each block's two borders."""
        me = self.light()
        k = 2 * self.lags * self.d

        def forms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            def one(row: dict) -> dict:
                m, r, free = me.of(row, row["p"]).form()
                return {**{c: np.array([row[c]]) for c in ("gid", "b", "hashed")}, "f": np.concatenate([m.ravel(), r, free])[None]}

            yield from gathered(map(one, each(batches)), FORM)

        def solve(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("b")
            parts = [(f[: k * k].reshape(k, k), f[k * k : k * k + k], f[k * k + k :]) for f in map(np.asarray, pdf["f"])]
            noise = None if seed is None else [rand.generator("border", seed, int(h), int(b)).standard_normal(k // 2) for h, b in zip(pdf["hashed"], pdf["b"])]
            values, covs = chain(parts, noise)
            return pd.DataFrame({"gid": pdf["gid"], "b": pdf["b"], "value": [v.tolist() for v in values], "cov": [c.ravel().tolist() for c in covs]})

        made = self.blocks.join(params, "gid").mapInArrow(forms, "gid long, b long, hashed long, f array<double>")
        return made.groupBy("gid").applyInPandas(solve, "gid long, b long, value array<double>, cov array<double>")

    def moments(self, params: DataFrame | None) -> DataFrame:
        """(gid, pos, v): the sums of E[w w'] by group, of the starting values without parameters."""
        me, k = self.light(), 2 * self.lags * self.d

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total: dict[int, np.ndarray] = {}
            for row in each(batches):
                block = me.of(row, row.get("p"))
                part = block.moments(block.value, None) if "p" not in row else block.moments(block.given(row["value"]), row["cov"].reshape(k, k))
                total[row["gid"]] = total.get(row["gid"], 0) + part.ravel()
                if len(total) > 1 and len(total) * (k + 1) ** 2 > SMALL:
                    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array([v.tolist() for v in total.values()], pa.list_(pa.float64()))], ["gid", "s"])
                    total = {}
            if total:
                yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array([v.tolist() for v in total.values()], pa.list_(pa.float64()))], ["gid", "s"])

        rows = self.blocks if params is None else self.blocks.join(params, "gid").join(self.borders(params), ["gid", "b"])
        return rows.mapInArrow(run, "gid long, s array<double>").select("gid", F.posexplode("s")).groupBy("gid", "pos").agg(F.sum("col").alias("v"))

    def fit(self, most: int, tol: float) -> DataFrame:
        """(gid, p): largest move, B and S of each group, by expectation-maximisation."""
        d, lags, size = self.d, self.lags, 1 + (self.lags + 1) * self.d
        params = Parameters(self.blocks.sparkSession, self.scratch, self.n_groups * size**2 <= SMALL)

        def step(s: np.ndarray, old: np.ndarray | None) -> np.ndarray:
            b, cov = solve_moments(s.reshape(size, size), d, lags)
            new = np.concatenate([b.ravel(), cov.ravel()])
            return np.concatenate([[np.inf if old is None else np.abs(new - old[1:]).max()], new])

        params.update(self.moments(None), step)
        for _ in range(most):
            params.update(self.moments(params.table), step)
            if params.most(0) < tol:
                break
        return params.table

    def filled(self, params: DataFrame, seed: int | None = None) -> DataFrame:
        """(gid, i, m): every row with its unknown cells at their means, or drawn from their law."""
        me = self.light()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            def one(row: dict) -> dict:
                block = me.of(row, row["p"])
                rng = None if seed is None else rand.generator("inner", seed, row["hashed"], row["b"])
                own = block.given(row["value"], rng)[block.halo :]
                return {"gid": np.full(len(own), row["gid"]), "i": np.arange(row["first"] + block.halo, row["first"] + block.m), "m": own}

            yield from gathered(map(one, each(batches)), FILLED)

        met = self.blocks.join(params, "gid").join(self.borders(params, seed), ["gid", "b"])
        return met.mapInArrow(run, "gid long, i long, m array<double>")


FILLED = pa.schema([("gid", pa.int64()), ("i", pa.int64()), ("m", pa.list_(pa.float64()))])
FORM = pa.schema([("gid", pa.int64()), ("b", pa.int64()), ("hashed", pa.int64()), ("f", pa.list_(pa.float64()))])
