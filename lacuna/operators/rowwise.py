"""Low-rank decompositions of matrices whose rows lie in many tasks.

A matrix has many rows and few columns (those of the table, times the period of a
folded series).  What couples its rows is small: Gram sums over all rows.  So each
iteration is one aggregate of sums, made by block in each task and added by group
and place, a small step on the sums, and a function of single rows that the next
pass applies:

* Noisy decomposition and soft-impute: for a basis Q of r rows, a row's factors and
  anomalies are a problem of that row alone, solved where the row is; Q then comes
  from the sums of L'L and L'X over the rows where a column is known.  The state is Q, which is also what the fitted model
  keeps: rows that come later are solved on it.
* Principal component pursuit: thresholding singular values of Z is Z W with
  W = V f(S) V' from the Gram matrix Z'Z, again a function of rows.  Rows replay
  the W of the last few iterations from their stored state.

Groups are matrices of their own and take part in the same passes.  Parameters of
all groups pass through the driver up to ``SMALL`` numbers; beyond, they are a
stored table that the planner joins.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.linalg import soft_threshold
from ..storage import Scratch

#: Parameters of all groups, at most, that pass through the driver: 8 MB.
SMALL = 1 << 20
#: Iterations of principal component pursuit that rows replay before their state is stored.
REPLAY = 8
#: Rows that numpy takes at once.
BLOCK = 4096


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """A column of equally long arrays as a matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width) if len(column) else np.zeros((0, width))


def by_group(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, pa.RecordBatch, np.ndarray]]:
    """(gid, rows x, parameters, the batch, the rows' places in it) for each group of each batch; columns are gid, x, p, more."""
    for batch in batches:
        gid = batch.column(0).to_numpy(zero_copy_only=False)
        x = matrix(batch.column(1), width)
        for g in np.unique(gid):
            at = np.flatnonzero(gid == g)
            p = np.array(batch.column(2)[int(at[0])].as_py(), float)
            for a in range(0, len(at), BLOCK):
                yield int(g), x[at[a : a + BLOCK]], p, batch, at[a : a + BLOCK]


def sums_by_group(rows: DataFrame, width: int, sums: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """(gid, pos, v): ``sums(x, p)`` of blocks of rows added up for each group and place; a task sends one array a group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for g, x, p, _, _ in by_group(batches, width):
            part = sums(x, p)
            total[g] = total[g] + part if g in total else part
            if len(total) > 1 and len(total) * len(part) > SMALL:
                yield packed(total)
                total = {}
        if total:
            yield packed(total)

    def packed(total: dict[int, np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array([v.tolist() for v in total.values()], pa.list_(pa.float64()))], ["gid", "s"])

    cells = rows.select("gid", "x", "p").mapInArrow(run, "gid long, s array<double>").select("gid", F.posexplode("s"))
    return cells.groupBy("gid", "pos").agg(F.sum("col").alias("v"))


class Parameters:
    """An array of numbers for each group: on the driver while ``few``, or a stored table."""

    def __init__(self, spark: SparkSession, scratch: Scratch, few: bool):
        self.spark, self.scratch, self.few = spark, scratch, few
        self.local: dict[int, np.ndarray] = {}
        self.table: DataFrame | None = None

    def update(self, sums: DataFrame, step: Callable[[np.ndarray, np.ndarray | None], np.ndarray]) -> None:
        """Each group's parameters from its sums (gid, pos, v) and the parameters as they were."""
        if self.few:
            got = sums.toArrow()
            gid, pos, v = (got.column(i).to_numpy() for i in range(3))
            order = np.lexsort((pos, gid))
            found, first = np.unique(gid[order], return_index=True)
            self.local = {int(g): step(s, self.local.get(int(g))) for g, s in zip(found, np.split(v[order], first[1:]))}
            self.hold()
            return

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                olds = batch.column(2).to_pylist() if batch.num_columns > 2 else [None] * batch.num_rows
                p = [step(np.array(s, float), None if o is None else np.array(o, float)).tolist() for s, o in zip(batch.column(1).to_pylist(), olds)]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p, pa.list_(pa.float64()))], ["gid", "p"])

        whole = sums.groupBy("gid").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "v"))), lambda c: c["v"]).alias("s"))
        met = whole if self.table is None else whole.join(self.table, "gid").select("gid", "s", "p")
        self.table = self.scratch.save(met.mapInArrow(run, "gid long, p array<double>"), "parameters", tidy=False)

    def change(self, arrays: Callable[[np.ndarray], np.ndarray], column: Column) -> None:
        """Parameters cut anew: ``arrays`` says how for those on the driver, ``column`` for those in a table."""
        if self.few:
            self.local = {g: arrays(p) for g, p in self.local.items()}
            self.hold()
        else:
            self.table = self.scratch.save(self.table.select("gid", column.alias("p")), "parameters", tidy=False)

    def hold(self) -> None:
        ids, ps = pa.array(list(self.local), pa.int64()), pa.array([p.tolist() for p in self.local.values()], pa.list_(pa.float64()))
        self.table = self.spark.createDataFrame(pa.table({"gid": ids, "p": ps}), "gid long, p array<double>")

    def most(self, place: int) -> float:
        """The largest number at a place over all groups."""
        if self.few:
            return max((p[place] for p in self.local.values()), default=0.0)
        return self.table.agg(F.max(F.col("p")[place])).first()[0] or 0.0


# -- noisy decomposition and soft-impute ------------------------------------------


def on_basis(x: np.ndarray, q: np.ndarray, tau: float, lam: float, most: int = 500, tol: float = 1e-10) -> tuple[np.ndarray, np.ndarray]:
    """Factors and anomalies of rows (NaN: unknown) on basis ``q``: the minimum of |known (x - l q - a)|^2 / 2 + tau |l|^2 / 2 + lam |a|_1."""
    known = ~np.isnan(x)
    seen = np.where(known, x, 0.0)
    gram = np.einsum("nd,rd,sd->nrs", known.astype(float), q, q) + tau * np.eye(len(q))
    inverse = np.linalg.pinv(gram, hermitian=True)
    a = np.zeros_like(seen)
    l = np.einsum("nrs,ns->nr", inverse, seen @ q.T)
    if not np.isfinite(lam):
        return l, a
    for _ in range(most):
        a = np.where(known, soft_threshold(seen - l @ q, lam), 0.0)
        new = np.einsum("nrs,ns->nr", inverse, (seen - a) @ q.T)
        moved, l = np.abs(new - l).max(initial=0), new
        if moved < tol:
            break
    return l, a


def basis_of(p: np.ndarray, width: int) -> tuple[np.ndarray, float, float]:
    """Q, tau and lam from a group's parameters (r, tau, lam, cost, moved, energy, Q...)."""
    return p[6 : 6 + int(p[0]) * width].reshape(int(p[0]), width), p[1], p[2]


def fit_basis(rows: DataFrame, width: int, n_groups: int, rank: int | None, tau: float | None, lam: float | None, most: int, tol: float, scratch: Scratch) -> DataFrame:
    """(gid, p): a basis for each group's rows (gid, x with NaN where unknown).

    ``tau`` and ``lam`` default to one over the root of the longer side; the rank to
    that of 95 % of the singular values of the rows with 0 where unknown.
    """
    params = Parameters(rows.sparkSession, scratch, n_groups * width * (rank or width) * ((rank or width) + 1) <= SMALL)
    nothing = rows.withColumn("p", F.array(F.lit(0.0)))

    def gram(x: np.ndarray, _: np.ndarray) -> np.ndarray:
        z = np.nan_to_num(x)
        return np.concatenate([[len(x)], (z.T @ z).ravel()])

    def start(s: np.ndarray, _: None) -> np.ndarray:
        w, v = np.linalg.eigh(s[1:].reshape(width, width))
        root = np.sqrt(np.maximum(w[::-1], 0))
        side = 1 / np.sqrt(max(s[0], width))
        share = np.cumsum(root) / root.sum() if root.sum() else np.ones(width)
        r = min(rank or int(np.argmax(share > 0.95 - 1e-12)) + 1, width, max(int(s[0]), 1))
        q = np.sqrt(root[:r])[:, None] * v[:, ::-1].T[:r]
        return np.concatenate([[r, side if tau is None else tau, side if lam is None else lam, np.inf, 1.0, np.trace(s[1:].reshape(width, width))], q.ravel()])

    def pass_sums(x: np.ndarray, p: np.ndarray) -> np.ndarray:
        q, t, m = basis_of(p, width)
        l, a = on_basis(x, q, t, m)
        known, left = (~np.isnan(x)).astype(float), np.nan_to_num(x - a)
        cost = 0.5 * np.nansum((x - a - l @ q) ** 2) + 0.5 * t * (l**2).sum() + (m * np.abs(a).sum() if np.isfinite(m) else 0)
        return np.concatenate([[cost], np.einsum("nd,nr,ns->drs", known, l, l).ravel(), (left.T @ l).ravel()])

    def step(s: np.ndarray, p: np.ndarray) -> np.ndarray:
        r, t = int(p[0]), p[1]
        grams, right = s[1 : 1 + width * r * r].reshape(width, r, r), s[1 + width * r * r :].reshape(width, r)
        q = np.einsum("drs,ds->rd", np.linalg.pinv(grams + t * np.eye(r), hermitian=True), right)
        cost = s[0] + 0.5 * t * (p[6:] ** 2).sum()
        moved = 1.0 if not np.isfinite(p[3]) else abs(p[3] - cost) / max(cost, 1e-6 * p[5], 1e-300)  # an exact fit costs next to nothing
        return np.concatenate([[r, t, p[2], cost, moved, p[5]], q.ravel()])

    params.update(sums_by_group(nothing, width, gram), start)
    for _ in range(most):
        params.update(sums_by_group(rows.join(params.table, "gid"), width, pass_sums), step)
        if params.most(4) < tol:
            break
    return params.table


def solved_on_basis(rows: DataFrame, params: DataFrame, width: int) -> DataFrame:
    """(gid, i, m): the low-rank part of each row (gid, x, i) on its group's basis."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, x, p, batch, at in by_group(batches, width):
            q, t, m = basis_of(p, width)
            fit = on_basis(x, q, t, m)[0] @ q
            places = pa.array(at)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(places), batch.column(3).take(places), pa.array(list(fit), pa.list_(pa.float64()))], ["gid", "i", "m"])

    return rows.join(params, "gid").select("gid", "x", "p", "i").mapInArrow(run, "gid long, i long, m array<double>")


# -- principal component pursuit --------------------------------------------------


def replay(x: np.ndarray, p: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, float, float]:
    """A block's d, m, a and y after the iterations in ``p``, and the squares of the last gap and of the last move of a.

    ``x`` holds d (NaN: unknown), a and y side by side; ``p``: mu, lam, whether it still moves, the squares of d, then (mu, W) for each iteration.
    """
    known = ~np.isnan(x[:, :width])
    d, a, y = np.where(known, x[:, :width], 0.0), x[:, width : 2 * width], x[:, 2 * width :]
    m, gap, moved = d - a, np.zeros_like(d), np.zeros_like(d)
    for part in p[4:].reshape(-1, 1 + width * width):
        mu, w = part[0], part[1:].reshape(width, width)
        m = (d - a + y / mu) @ w
        new = np.where(known, soft_threshold(d - m + y / mu, p[1] / mu), d - m + y / mu)
        gap, moved, a = d - m - new, mu * (new - a), new
        y = y + mu * gap
    return d, m, a, y, float((gap**2).sum()), float((moved**2).sum())


def pursue(rows: DataFrame, width: int, n_groups: int, mu: float | None, lam: float | None, most: int, tol: float, scratch: Scratch) -> DataFrame:
    """(gid, i, m): the low-rank part of each group's rows (gid, i, x with NaN where unknown): D = M + A, M of low nuclear norm, A sparse and free where D is unknown.

    Alternating directions; the weight ``mu`` is doubled or halved where one of the
    primal and dual residuals is ten times the other, so few passes are needed.
    """
    params = Parameters(rows.sparkSession, scratch, n_groups * width * (width + 1) * REPLAY <= SMALL)
    zeros = F.array_repeat(F.lit(0.0), 2 * width)
    state = scratch.save(rows.select("gid", "i", F.concat("x", zeros).alias("x")), "state", tidy=False)

    def size(x: np.ndarray, _: np.ndarray) -> np.ndarray:
        d = np.nan_to_num(x[:, :width])
        return np.concatenate([[len(x), np.abs(d).sum(), (d**2).sum()], (d.T @ d).ravel()])

    def pushed(p: np.ndarray, gram: np.ndarray) -> np.ndarray:
        """The parameters with one more iteration."""
        w, v = np.linalg.eigh(gram.reshape(width, width))
        s = np.sqrt(np.maximum(w, 0))
        shrink = np.where(s > 1 / p[0], 1 - 1 / (p[0] * np.maximum(s, 1e-300)), 0.0)
        return np.concatenate([p, [p[0]], ((v * shrink) @ v.T).ravel()])

    def start(s: np.ndarray, _: None) -> np.ndarray:
        n, total = s[0] * width, s[1]
        first = mu if mu is not None else (min(1e3, n / (4 * total)) if total else 1e3)
        return pushed(np.array([first, lam if lam is not None else 1 / np.sqrt(max(s[0], width)), 1.0, s[2]]), s[3:])

    def pass_sums(x: np.ndarray, p: np.ndarray) -> np.ndarray:
        d, _, a, y, gap, moved = replay(x, p, width)
        # Z for any weight: Z'Z from the products of d - a and y.
        e = d - a
        return np.concatenate([[gap, moved], (e.T @ e).ravel(), (e.T @ y).ravel(), (y.T @ y).ravel()])

    def step(s: np.ndarray, p: np.ndarray) -> np.ndarray:
        gap, moved = np.sqrt(s[0]), np.sqrt(s[1])
        norm = max(np.sqrt(p[3]), 1e-300)
        ee, ey, yy = s[2:].reshape(3, width, width)
        still = 0.0 if gap / norm < tol and moved / (p[0] * norm) < tol else 1.0
        weight = p[0] * (2.0 if gap * p[0] > 10 * moved else 0.5 if moved > 10 * gap * p[0] else 1.0)
        p = np.concatenate([[weight, p[1], still], p[3:]])
        return pushed(p, (ee + (ey + ey.T) / weight + yy / weight**2).ravel())

    def moved_on(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, x, p, batch, at in by_group(batches, 3 * width):
            d, _, a, y, _, _ = replay(x, p, width)
            out = np.concatenate([x[:, :width], a, y], axis=1)
            places = pa.array(at)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(places), batch.column(3).take(places), pa.array(list(out), pa.list_(pa.float64()))], ["gid", "i", "x"])

    params.update(sums_by_group(state.withColumn("p", F.array(F.lit(0.0))), 3 * width, size), start)
    for it in range(1, most):
        if it % REPLAY == 0:
            # All but the newest iteration are taken into the stored rows.
            last = 1 + width * width
            kept = 4 + (REPLAY - 1) * last
            old = params.table.select("gid", F.slice("p", 1, kept).alias("p"))
            further = scratch.save(state.join(old, "gid").select("gid", "x", "p", "i").mapInArrow(moved_on, "gid long, i long, x array<double>"), "state", tidy=False)
            scratch.drop(state)
            state = further
            params.change(lambda p: np.concatenate([p[:4], p[-last:]]), F.concat(F.slice("p", 1, 4), F.slice("p", -last, last)))
        params.update(sums_by_group(state.join(params.table, "gid"), 3 * width, pass_sums), step)
        if params.most(2) == 0.0:
            break

    def low_rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, x, p, batch, at in by_group(batches, 3 * width):
            m = replay(x, p, width)[1]
            places = pa.array(at)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(places), batch.column(3).take(places), pa.array(list(m), pa.list_(pa.float64()))], ["gid", "i", "m"])

    return state.join(params.table, "gid").select("gid", "x", "p", "i").mapInArrow(low_rank, "gid long, i long, m array<double>")
