"""Low-rank imputation: principal component pursuit, noisy robust PCA, and soft-thresholded ALS.

The imputers work on rows in many tasks (see ``rowwise``).  Only lag penalties
(``list_periods``) couple rows with each other: with them a group's matrix is held
in one task and must fit there.  The classes of one matrix in numpy are for such
groups, and for matrices of one's own.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import LacunaError
from ..frame import numeric_columns
from ..functions import linalg
from ..functions.linalg import soft_threshold, svd_threshold
from ..functions.ranks import ranked
from ..storage import Scratch
from . import rowwise
from .base import Imputer, Model
from .simple import per_group


class RpcaPcp:
    """D = M + A, M of low nuclear norm and A sparse, by alternating directions; A is free where D is unknown."""

    def __init__(self, mu: float | None = None, lam: float | None = None, max_iterations: int = 10_000, tolerance: float = 1e-6):
        self.mu, self.lam, self.max_iterations, self.tolerance = mu, lam, max_iterations, tolerance

    def scale(self, d: np.ndarray) -> tuple[float, float]:
        size = np.abs(d).sum()
        return (min(1e3, d.size / (4 * size)) if size else 1e3), 1 / np.sqrt(max(d.shape))

    def decompose(self, d: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        d = linalg.fill_linear(np.where(known, d, np.nan))
        mu0, lam0 = self.scale(d)
        mu, lam = self.mu if self.mu is not None else mu0, self.lam if self.lam is not None else lam0
        norm = np.linalg.norm(d)
        if norm == 0:
            return d.copy(), np.zeros_like(d)
        m, a, y = np.zeros_like(d), np.zeros_like(d), np.zeros_like(d)
        for _ in range(self.max_iterations):
            m = svd_threshold(d - a + y / mu, 1 / mu)
            a = np.where(known, soft_threshold(d - m + y / mu, lam / mu), d - m)
            gap = d - m - a
            y = y + mu * gap
            if np.linalg.norm(gap) / norm < self.tolerance:
                break
        return m, a

    @staticmethod
    def cost(m: np.ndarray, a: np.ndarray, known: np.ndarray, lam: float) -> float:
        return float(np.linalg.svd(m, compute_uv=False).sum() + lam * np.abs(a * known).sum())


class RpcaNoisy:
    """Minimises |D - LQ - A|^2 / 2 on known cells + tau (|L|^2 + |Q|^2) / 2 + lam |A|_1 + sum of eta |H LQ|^2 / 2.

    Block-coordinate descent: A by soft thresholding, the unknown cells by the
    current fit, L by a linear system in which each period's lag-difference
    operator H couples rows, and Q by ridge regression.
    """

    def __init__(self, rank: int | None = None, tau: float | None = None, lam: float | None = None, list_periods: tuple[int, ...] = (), list_etas: tuple[float, ...] = (), max_iterations: int = 500, tolerance: float = 1e-6, norm: str = "L2"):
        if norm not in ("L1", "L2"):
            raise LacunaError("norm is L1 or L2")
        self.rank, self.tau, self.lam, self.periods, self.etas = rank, tau, lam, tuple(list_periods), tuple(list_etas)
        self.max_iterations, self.tolerance, self.norm = max_iterations, tolerance, norm

    def scale(self, d: np.ndarray) -> tuple[int, float, float]:
        s = 1 / np.sqrt(max(d.shape))
        return linalg.approx_rank(d), s, s

    def resolved(self, d: np.ndarray) -> tuple[int, float, float]:
        r, t, l = self.scale(d)
        return self.rank or r, self.tau if self.tau is not None else t, self.lam if self.lam is not None else l

    def cost(self, d, known, m, a, tau, lam) -> float:
        out = 0.5 * (np.where(known, d - m - a, 0) ** 2).sum() + tau * np.linalg.svd(m, compute_uv=False).sum() + lam * np.abs(np.where(known, a, 0)).sum()
        for p, eta in zip(self.periods, self.etas):
            diff = linalg.lag_difference(p, len(m)) @ m
            out += eta * (np.abs(diff).sum() if self.norm == "L1" else 0.5 * (diff**2).sum())
        return float(out)

    def decompose(self, d: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """M, A and the basis Q."""
        for p in self.periods:
            if p >= len(d):
                raise LacunaError(f"period {p} is not shorter than the {len(d)} rows")
        d = linalg.fill_linear(np.where(known, d, np.nan))
        rank, tau, lam = self.resolved(d)
        u, s, v = np.linalg.svd(d, full_matrices=False)
        l, q = u[:, :rank] * np.sqrt(s[:rank]), np.sqrt(s[:rank])[:, None] * v[:rank]
        n, eye = len(d), np.eye(q.shape[0])
        weights = [np.ones(n)] * len(self.periods)
        ops = [linalg.lag_difference(p, n) for p in self.periods]
        m = l @ q
        for _ in range(self.max_iterations):
            a = np.where(known, soft_threshold(d - m, lam), 0)
            x = np.where(known, d - a, m)
            if not ops:
                l = np.linalg.solve(q @ q.T + tau * eye, q @ x.T).T
            else:
                if self.norm == "L1":  # reweighted squares
                    weights = [1 / np.sqrt(((h @ m) ** 2).mean(axis=1) + 1e-6) for h in ops]
                pen = sum(eta * h.T @ (w[:, None] * h) for eta, h, w in zip(self.etas, ops, weights))
                # (Q Q' + tau) acts on columns, pen (Q Q') on rows: diagonalise both.
                e1, v1 = np.linalg.eigh(pen)
                e2, v2 = np.linalg.eigh(q @ q.T)
                rhs = v1.T @ (x @ q.T) @ v2
                l = v1 @ (rhs / (e2 + tau + np.outer(e1, e2))) @ v2.T
            q = np.linalg.solve(l.T @ l + (sum(eta * (h @ l).T @ (w[:, None] * (h @ l)) for eta, h, w in zip(self.etas, ops, weights)) if ops else 0) + tau * eye, l.T @ x)
            new = l @ q
            moved = np.linalg.norm(new - m) / max(np.linalg.norm(m), 1e-12)
            m = new
            if moved < self.tolerance:
                break
        return m, np.where(known, soft_threshold(d - m, lam), d - m), q

    def decompose_on_basis(self, d: np.ndarray, known: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """M and A for rows of their own, given a basis."""
        _, tau, lam = self.resolved(linalg.fill_linear(np.where(known, d, np.nan)))
        a, l = np.zeros_like(d), np.zeros((len(d), len(q)))
        x = np.where(known, d, 0)
        for _ in range(self.max_iterations):
            new = np.linalg.solve(q @ q.T + 2 * tau * np.eye(len(q)), q @ (np.where(known, x - a, l @ q)).T).T
            a = np.where(known, soft_threshold(x - new @ q, lam), 0)
            if np.abs(new - l).max() < self.tolerance:
                l = new
                break
            l = new
        return l @ q, a


class SoftImpute:
    """Soft-thresholded SVD by alternating ridge regressions with at most ``rank`` factors."""

    def __init__(self, rank: int | None = None, tau: float | None = None, max_iterations: int = 100, tolerance: float = 1e-5):
        self.rank, self.tau, self.max_iterations, self.tolerance = rank, tau, max_iterations, tolerance

    def decompose(self, d: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        x = np.where(known, d, 0.0)
        tau = self.tau if self.tau is not None else 1 / np.sqrt(max(d.shape))
        rank = min(self.rank or linalg.approx_rank(linalg.fill_linear(np.where(known, d, np.nan))), min(d.shape))
        u, s, v = np.linalg.svd(x, full_matrices=False)
        a, b = u[:, :rank] * np.sqrt(s[:rank]), v[:rank].T * np.sqrt(s[:rank])
        m, eye = a @ b.T, np.eye(rank)
        for _ in range(self.max_iterations):
            b = np.linalg.solve(a.T @ a + tau * eye, a.T @ np.where(known, x, m)).T
            m = a @ b.T
            a = np.linalg.solve(b.T @ b + tau * eye, b.T @ np.where(known, x, m).T).T
            new = a @ b.T
            moved = np.linalg.norm(new - m) / max(np.linalg.norm(m), 1e-12)
            m = new
            if moved < self.tolerance:
                break
        m = svd_threshold(np.where(known, x, m), tau)
        return m, np.where(known, x - m, 0.0)

    @staticmethod
    def cost(d: np.ndarray, known: np.ndarray, m: np.ndarray, tau: float) -> float:
        return float(0.5 * (np.where(known, d - m, 0) ** 2).sum() + tau * np.linalg.svd(m, compute_uv=False).sum())


class _LowRank(Imputer):
    """Holes take the low-rank part of the standardised matrix; ``period`` folds a series into one, ``columnwise`` gives each column its own."""

    leaves_none = False

    def engine(self, column: str | None):
        """The decomposition of one matrix in numpy."""
        raise NotImplementedError

    def fitted(self, rows: DataFrame, width: int, n_groups: int, column: str | None, scratch: Scratch) -> DataFrame | None:
        """What a fit keeps for each group; None where a table is decomposed as a whole at each transform."""
        raise NotImplementedError

    def solved(self, rows: DataFrame, model: DataFrame | None, width: int, n_groups: int, column: str | None, scratch: Scratch) -> DataFrame:
        """(gid, i, m): the low-rank part of the rows."""
        return rowwise.solved_on_basis(rows, model, width)

    def coupled(self, column: str | None) -> bool:
        return False

    def fit(self, df: DataFrame) -> Model:
        if any(int(self.param("period", c, 1)) > 1 or self.coupled(c) for c in (None, *self.targets(df))):
            self.spec.ordered(type(self).__name__)
        return super().fit(df)

    def _fit(self, df: DataFrame, holes: list[str], targets: list[str]) -> Callable[[DataFrame], DataFrame]:
        cols = [c for c in numeric_columns(df) if c in targets]
        by_column, asked = self.param("columnwise", default=False), [c for c in holes if c in cols]
        parts = [([c], c) for c in asked] if by_column else [(cols, None)]
        if any(self.coupled(name) for _, name in parts):
            return per_group(self, asked, lambda pdf, _: self._one_matrix(pdf, parts))
        scratch = Scratch(df.sparkSession)
        models = [self._learn(df, part, name, scratch) for part, name in parts]

        def fill(d: DataFrame) -> DataFrame:
            out = d
            for (part, name), (groups, model, n_groups) in zip(parts, models):
                out = self._apply(out, part, [c for c in asked if c in part], name, groups, model, n_groups)
            return out

        return fill

    def _rows(self, d: DataFrame, part: list[str], name: str | None, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
        """The table's rows with their group, matrix row ``i`` and place ``k`` in it; and the matrix rows (g, i, x)."""
        period, by = int(self.param("period", name, 1)), self.spec.groups
        group = F.struct(*[F.col(c).alias(f"g{i}") for i, c in enumerate(by)]) if by else F.struct(F.lit(0).alias("g0"))
        rows = d.select(F.struct(*d.columns).alias("row"), group.alias("g"), F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))) for c in part]).alias("v"))
        if period == 1:
            kept = scratch.save(rows.select("row", "g", "v", F.monotonically_increasing_id().alias("i"), F.lit(0).alias("k")), "rows")
            return kept, kept.select("g", "i", F.col("v").alias("x"))
        order = F.struct(*[F.col("row")[c] for c in self.spec.order_by])
        placed = ranked(rows.withColumn("_order", order), "g", "_order", scratch).drop("_order")
        kept = scratch.save(placed.select("row", "g", "v", F.floor(F.col("i") / period).alias("i"), (F.col("i") % period).cast("int").alias("k")), "rows")
        cells = kept.groupBy("g", "i").agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("v"))  # at most a period each
        gap = F.array_repeat(F.lit(float("nan")), len(part))
        return kept, cells.select("g", "i", F.flatten(F.transform(F.sequence(F.lit(0), F.lit(period - 1)), lambda k: F.coalesce(F.element_at("v", k), gap))).alias("x"))

    def _scaled(self, matrix: DataFrame, groups: DataFrame, width: int) -> DataFrame:
        """(gid, i, x): matrix rows in units of their columns' deviation, about their means."""
        known = matrix.join(groups, "g")
        return known.select("gid", "i", F.array(*[(F.col("x")[j] - F.col("centre")[j]) / F.col("spread")[j] for j in range(width)]).alias("x"))

    def _learn(self, df: DataFrame, part: list[str], name: str | None, scratch: Scratch) -> tuple[DataFrame, DataFrame | None, int]:
        width = len(part) * int(self.param("period", name, 1))
        _, matrix = self._rows(df, part, name, scratch)
        cell = [F.when(~F.isnan(F.col("x")[j]), F.col("x")[j]) for j in range(width)]
        stats = matrix.groupBy("g").agg(F.array(*[F.avg(c) for c in cell]).alias("m"), F.array(*[F.stddev_pop(c) for c in cell]).alias("s"))
        # A column without values takes the mean of the others.
        seen = F.filter("m", lambda v: v.isNotNull())
        others = F.try_divide(F.aggregate(seen, F.lit(0.0), lambda t, v: t + v), F.size(seen))
        stats = stats.where(others.isNotNull()).select("g", F.monotonically_increasing_id().alias("gid"), F.transform("m", lambda v: F.coalesce(v, others)).alias("centre"), F.transform("s", lambda v: F.when(v > 0, v).otherwise(1.0)).alias("spread"))
        groups = scratch.save(stats, "groups", tidy=False)
        n_groups = groups.count()
        rows = scratch.save(self._scaled(matrix, groups, width), "scaled")
        return groups, self.fitted(rows, width, n_groups, name, scratch), n_groups

    def _apply(self, d: DataFrame, part: list[str], asked: list[str], name: str | None, groups: DataFrame, model: DataFrame | None, n_groups: int) -> DataFrame:
        scratch = Scratch(d.sparkSession)
        width = len(part) * int(self.param("period", name, 1))
        rows, matrix = self._rows(d, part, name, scratch)
        fit = self.solved(self._scaled(matrix, groups, width), model, width, n_groups, name, scratch)
        fit = fit.join(groups, "gid").select("g", "i", "m", "centre", "spread")
        met = rows.select("row", "k", F.col("g").alias("rg"), F.col("i").alias("ri")).join(fit, F.col("rg").eqNullSafe(F.col("g")) & (F.col("ri") == F.col("i")), "left")
        place = lambda c: F.col("k") * len(part) + part.index(c)
        value = lambda c: F.coalesce(F.col("row")[c].cast("double"), F.get("m", place(c)) * F.get("spread", place(c)) + F.get("centre", place(c)))
        return met.select(*[value(c).alias(c) if c in asked else F.col("row")[c].alias(c) for c in d.columns])

    def _one_matrix(self, pdf: pd.DataFrame, parts: list[tuple[list[str], str | None]]) -> pd.DataFrame:
        for part, name in parts:
            x = pdf[part].to_numpy(float)
            if np.isnan(x).all():
                continue
            m = linalg.fold(x, int(self.param("period", name, 1)))
            known = ~np.isnan(m)
            centre = np.nan_to_num([np.nanmean(c) if np.isfinite(c).any() else np.nanmean(m) for c in m.T])
            spread = np.array([np.nanstd(c) if np.isfinite(c).any() else 1.0 for c in m.T])
            spread[spread == 0] = 1
            fitted = self.engine(name).decompose((m - centre) / spread, known)[0]
            pdf[part] = linalg.unfold(fitted * spread + centre, x.shape)
        return pdf


class ImputerRpcaPcp(_LowRank):
    """Principal component pursuit, of each table that is transformed as a whole."""

    def engine(self, c):
        return RpcaPcp(self.param("mu", c), self.param("lam", c), int(self.param("max_iterations", c, 1000)), float(self.param("tolerance", c, 1e-6)))

    def fitted(self, rows, width, n_groups, c, scratch):
        return None

    def solved(self, rows, model, width, n_groups, c, scratch):
        return rowwise.pursue(rows, width, n_groups, self.param("mu", c), self.param("lam", c), int(self.param("max_iterations", c, 200)), float(self.param("tolerance", c, 1e-5)), scratch)


class ImputerRpcaNoisy(_LowRank):
    """A basis is learned by ``fit``; ``transform`` solves the rows of any table on it, anomalies set apart.

    ``rank``, ``tau``, ``lam`` as in ``RpcaNoisy``.  There is no weight ``mu`` between
    the low-rank part and its factors: the part is their product, exactly.
    """

    def engine(self, c):
        return RpcaNoisy(self.param("rank", c), self.param("tau", c), self.param("lam", c), self.param("list_periods", c, ()), self.param("list_etas", c, ()), int(self.param("max_iterations", c, 500)), float(self.param("tolerance", c, 1e-6)), self.param("norm", c, "L2"))

    def coupled(self, c):
        return bool(self.param("list_periods", c, ()))

    def fitted(self, rows, width, n_groups, c, scratch):
        return rowwise.fit_basis(rows, width, n_groups, self.param("rank", c), self.param("tau", c), self.param("lam", c), int(self.param("max_iterations", c, 50)), float(self.param("tolerance", c, 1e-5)), scratch)


class ImputerSoftImpute(_LowRank):
    """As the noisy decomposition, without anomalies."""

    def engine(self, c):
        return SoftImpute(self.param("rank", c), self.param("tau", c), int(self.param("max_iterations", c, 100)), float(self.param("tolerance", c, 1e-5)))

    def fitted(self, rows, width, n_groups, c, scratch):
        return rowwise.fit_basis(rows, width, n_groups, self.param("rank", c), self.param("tau", c), float("inf"), int(self.param("max_iterations", c, 50)), float(self.param("tolerance", c, 1e-5)), scratch)
