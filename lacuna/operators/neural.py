"""Small neural imputers in numpy: a regressor, an autoencoder, and denoising diffusion for rows and for windows of rows.

A group of up to ``block_rows`` rows is trained in one task.  A larger one is cut
into blocks of rows: whole-batch gradients are summed over blocks, which gives
the networks that one task would train; diffusion, which steps by small batches,
trains a copy in each block for an epoch and goes on with their mean.  Networks
are dense, trained by Adam; weights come from a generator keyed by seed and group.
"""

from __future__ import annotations

import json
import pickle
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import EstimatorNotDefined
from ..frame import numeric_columns
from ..functions import rand
from ..functions.ranks import ranked
from ..storage import Scratch
from .base import Imputer, join_groups
from .simple import per_group

#: Rows of a group that one task trains on, and of a block of a larger group.
BLOCK_ROWS = 50_000
#: Large groups whose networks each machine gets whole.
FEW_GROUPS = 100


class Dense:
    """A stack of linear layers with ReLU between them."""

    def __init__(self, sizes: Sequence[int], rng: np.random.Generator):
        self.w = [rng.normal(0, np.sqrt(2 / a), (a, b)) for a, b in zip(sizes[:-1], sizes[1:])]
        self.b = [np.zeros(b) for b in sizes[1:]]
        self.m = [np.zeros_like(p) for p in self.w + self.b]
        self.v = [np.zeros_like(p) for p in self.w + self.b]
        self.t = 0

    def forward(self, x: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        kept = [x]
        for i, (w, b) in enumerate(zip(self.w, self.b)):
            x = x @ w + b
            if i < len(self.w) - 1:
                x = np.maximum(x, 0)
            kept.append(x)
        return x, kept

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return self.forward(x)[0]

    def gradient(self, kept: list[np.ndarray], g: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """From the loss's gradient by the output: that by the input, and those by weights and biases."""
        gw, gb = [], []
        for i in reversed(range(len(self.w))):
            if i < len(self.w) - 1:
                g = g * (kept[i + 1] > 0)
            gw.append(kept[i].T @ g)
            gb.append(g.sum(axis=0))
            g = g @ self.w[i].T
        return g, gw[::-1] + gb[::-1]

    def move(self, gradient: list[np.ndarray], rate: float) -> None:
        """One Adam step."""
        self.t += 1
        for k, (p, d) in enumerate(zip(self.w + self.b, gradient)):
            self.m[k] = 0.9 * self.m[k] + 0.1 * d
            self.v[k] = 0.999 * self.v[k] + 0.001 * d * d
            p -= rate * (self.m[k] / (1 - 0.9**self.t)) / (np.sqrt(self.v[k] / (1 - 0.999**self.t)) + 1e-8)

    def step(self, kept: list[np.ndarray], g: np.ndarray, rate: float) -> np.ndarray:
        """One Adam step from the loss's gradient by the output; returns the gradient by the input."""
        back, gradient = self.gradient(kept, g)
        self.move(gradient, rate)
        return back

    def flat(self) -> np.ndarray:
        """Steps, parameters and moments as one vector."""
        return np.concatenate([[self.t], *[p.ravel() for p in [*self.w, *self.b, *self.m, *self.v]]])

    def set_flat(self, x: np.ndarray) -> None:
        self.t, at = float(x[0]), 1
        for p in [*self.w, *self.b, *self.m, *self.v]:
            p[...] = x[at : at + p.size].reshape(p.shape)
            at += p.size

    def split(self, x: np.ndarray) -> list[np.ndarray]:
        """A vector as parts with the shapes of the parameters."""
        shapes = [p.shape for p in self.w + self.b]
        ends = np.cumsum([int(np.prod(s)) for s in shapes])
        return [part.reshape(s) for part, s in zip(np.split(x[: ends[-1]], ends[:-1]), shapes)]

    @property
    def size(self) -> int:
        return sum(p.size for p in self.w + self.b)


def build_mlp(n_in: int, hidden: Sequence[int], n_out: int, rng: np.random.Generator) -> Dense:
    return Dense([n_in, *hidden, n_out], rng)


def build_autoencoder(n_in: int, latent: int, hidden: Sequence[int], rng: np.random.Generator) -> tuple[Dense, Dense]:
    """An encoder of descending and a decoder of ascending widths."""
    return Dense([n_in, *sorted(hidden, reverse=True), latent], rng), Dense([latent, *sorted(hidden), n_in], rng)


def _scaled(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    with np.errstate(all="ignore"):
        mean = np.nan_to_num(np.array([np.nanmean(c) if np.isfinite(c).any() else 0.0 for c in x.T]))
        sd = np.array([np.nanstd(c) if np.isfinite(c).any() else 1.0 for c in x.T])
    sd[sd == 0] = 1
    return (x - mean) / sd, mean, sd


class _Neural(Imputer):
    leaves_none = False

    def _fit(self, df: DataFrame, holes: list[str], targets: list[str]) -> Callable[[DataFrame], DataFrame]:
        cols = [c for c in numeric_columns(df) if c in targets]
        asked = [c for c in holes if c in cols]
        if self.param("model") == "TsDDPM":
            self.spec.ordered("TsDDPM")

        def run(pdf: pd.DataFrame, _: list[str]) -> pd.DataFrame:
            x = pdf[cols].to_numpy(float)
            z, mean, sd = _scaled(x)
            rng = rand.generator(type(self).__name__, self.seed, *[str(pdf[g].iloc[0]) for g in self.spec.groups])
            times = pdf[self.spec.order_by[0]] if self.spec.order_by else None
            pdf[cols] = self.impute(z, rng, times) * sd + mean
            return pdf

        alone = per_group(self, asked, run)

        def fill(d: DataFrame) -> DataFrame:
            most, groups = int(self.param("block_rows", default=BLOCK_ROWS)), self.spec.groups
            sizes = d.groupBy(*groups).count().where(F.col("count") > most).drop("count") if groups else d.limit(most + 1).groupBy().count().where(F.col("count") > most).drop("count")
            sizes = Scratch(d.sparkSession).save(sizes.withColumn("_large", F.lit(True)), "large", tidy=False)
            large = sizes.count()
            if not large:
                return alone(d)
            marked = join_groups(d, sizes, groups)
            filled = self._in_blocks(marked.where("_large").drop("_large"), cols, asked, most, large)
            return filled if not groups else filled.unionByName(alone(marked.where("_large IS NULL").drop("_large")))

        return fill

    def _in_blocks(self, d: DataFrame, cols: list[str], asked: list[str], most: int, large: int) -> DataFrame:
        """Large groups: rows stay in Spark; blocks of their numbers are trained on round by round."""
        scratch, spec, k, seed, name = Scratch(d.sparkSession), self.spec, len(cols), self.seed, type(self).__name__
        halo = self.halo()
        group = F.to_json(F.struct(*spec.groups), {"ignoreNullFields": "false"}) if spec.groups else F.lit("")
        order = F.struct(*dict.fromkeys([*spec.order_by, *spec.key])) if spec.order_by or spec.key else F.xxhash64(*cols)
        x = [F.col(c).cast("double").alias(f"x{j}") for j, c in enumerate(cols)]
        placed = scratch.save(ranked(d.select(F.struct(*[F.col(c) for c in d.columns]).alias("row"), *x, group.alias("g"), order.alias("o")), "g", "o", scratch).drop("o"), "placed")
        names = [f"x{j}" for j in range(k)]
        stats = placed.groupBy("g").agg(F.count("*").alias("n"), *[f(c).alias(f"{f.__name__}_{c}") for c in names for f in (F.count, F.avg, F.stddev_pop, F.min, F.max)])
        # The last rows of a block are also the first of the next, which looks back at them.
        at = F.array(F.struct(F.expr(f"i div {most}").alias("b"), F.expr(f"i % {most}").alias("at")), *([F.struct(F.expr(f"i div {most} + 1").alias("b"), F.expr(f"i % {most} - {most}").alias("at"))] if halo else []))
        rows = placed.select("g", *names, F.inline(F.filter(at, lambda p: p["at"] >= -halo)))

        def pack(key, pdf):
            pdf = pdf.sort_values("at")
            if pdf["at"].iloc[-1] < 0:  # nothing follows the group's last block
                return pd.DataFrame(columns=["g", "b", "before", "v"])
            return pd.DataFrame({"g": [key[0]], "b": int(key[1]), "before": int((pdf["at"] < 0).sum()), "v": [pdf[names].to_numpy(float).tobytes()]})

        parts = max(1, min(4 * d.sparkSession.sparkContext.defaultParallelism, 8 * large))
        packed = rows.groupBy("g", "b").applyInPandas(pack, "g string, b long, before int, v binary")
        blocks = scratch.save(packed.join(F.broadcast(stats) if large <= FEW_GROUPS else stats, "g").repartition(parts, "g", "b"), "blocks")

        def begin(key, pdf):
            r = pdf.iloc[0]
            nets = self.begin(k, int(r["n"]), [int(r[f"count_{c}"]) for c in names], rand.generator(name, seed, *[str(v) for v in json.loads(key[0] or "{}").values()]))
            return pd.DataFrame({"g": [key[0]], "s": [pickle.dumps(nets)]})

        state = scratch.save(stats.groupBy("g").applyInPandas(begin, "g string, s binary"), "state", tidy=False)

        def each(pdf):
            nets_of: dict[str, list[Dense]] = {}
            for _, r in pdf.iterrows():
                if r["g"] not in nets_of:
                    nets_of = {r["g"]: pickle.loads(r["s"])}
                seen = np.array([r[f"count_{c}"] for c in names])
                mean = np.nan_to_num(np.array([r[f"avg_{c}"] for c in names], float))
                sd = np.nan_to_num(np.array([r[f"stddev_pop_{c}"] for c in names], float))
                sd[sd == 0] = 1
                z = (np.frombuffer(r["v"], float).reshape(-1, k) - mean) / sd
                low, high = (np.nan_to_num((np.array([r[f"{f}_{c}"] for c in names], float) - mean) / sd) for f in ("min", "max"))
                yield r, nets_of[r["g"]], z, {"n": int(r["n"]), "seen": seen, "low": low, "high": high, "mean": mean, "sd": sd, "before": int(r["before"])}

        def met(state):
            return blocks.join(F.broadcast(state) if large <= FEW_GROUPS else state, "g")

        def learn(state: DataFrame, turn: int) -> DataFrame:
            def work(batches):
                sums: dict[str, np.ndarray] = {}
                for pdf in batches:
                    for r, nets, z, about in each(pdf):
                        got = self.work(nets, z, about, turn, lambda t: rand.generator(name, seed, t, r["g"], r["b"]))
                        sums[r["g"]] = sums[r["g"]] + got if r["g"] in sums else got
                yield pd.DataFrame({"g": np.array(list(sums), object), "t": [v.tobytes() for v in sums.values()]}, columns=["g", "t"])

            def merge(key, part, old):
                nets = pickle.loads(old["s"].iloc[0])
                self.merge(nets, np.sum([np.frombuffer(t, float) for t in part["t"]], axis=0), turn)
                return pd.DataFrame({"g": [key[0]], "s": [pickle.dumps(nets)]})

            summed = met(state).mapInPandas(work, "g string, t binary")
            return scratch.save(summed.groupBy("g").cogroup(state.groupBy("g")).applyInPandas(merge, "g string, s binary"), "state", tidy=False)

        for turn in range(self.turns()):
            state = learn(state, turn)

        def finish(batches):
            for pdf in batches:
                for r, nets, z, about in each(pdf):
                    made = self.finish(nets, z, about, lambda t: rand.generator(name, seed, t, r["g"], r["b"]))
                    hole = np.isnan(z)
                    out = np.where(hole, made, z) * about["sd"] + about["mean"]
                    at = np.flatnonzero(hole.any(axis=1) & (np.arange(len(z)) >= about["before"]))
                    yield pd.DataFrame({"fg": np.full(len(at), r["g"], object), "fi": r["b"] * most + at - about["before"], **{f"f{j}": out[at, j] for j in range(k)}})

        made = met(state).mapInPandas(finish, ", ".join(["fg string, fi long", *[f"f{j} double" for j in range(k)]]))
        both = placed.join(made, (F.col("g") == F.col("fg")) & (F.col("i") == F.col("fi")), "left")
        value = lambda c: F.coalesce(f"x{cols.index(c)}", f"f{cols.index(c)}")
        return both.select(*[(value(c) if c in asked else F.col("row")[c]).alias(c) for c in d.columns])

    def halo(self) -> int:
        """Rows before a block that it looks back at."""
        return 0

    def turns(self) -> int:
        """Rounds over all blocks."""
        return int(self.param("epochs", default=200))

    def impute(self, z: np.ndarray, rng: np.random.Generator, times: pd.Series | None) -> np.ndarray:
        raise NotImplementedError

    def begin(self, d: int, n: int, seen: Sequence[int], rng: np.random.Generator) -> list:
        """A group's networks before the first round."""
        raise NotImplementedError

    def work(self, nets: list, z: np.ndarray, about: dict, turn: int, rng_of: Callable[[int], np.random.Generator]) -> np.ndarray:
        """What a block gives to a round: vectors that are summed by group."""
        raise NotImplementedError

    def merge(self, nets: list, total: np.ndarray, turn: int) -> None:
        raise NotImplementedError

    def finish(self, nets: list, z: np.ndarray, about: dict, rng_of: Callable[[int], np.random.Generator]) -> np.ndarray:
        """A block's rows with their missing cells made."""
        raise NotImplementedError


class ImputerRegressorMLP(_Neural):
    """One network for each incomplete column on the others, absolute loss, whole-batch Adam."""

    def impute(self, z, rng, times):
        if self.param("hidden", default=(32, 16)) is None:
            raise EstimatorNotDefined("hidden layer sizes are needed")
        out = z.copy()
        for j in range(z.shape[1]):
            hole = np.isnan(z[:, j])
            x = np.nan_to_num(np.delete(z, j, axis=1))
            if not hole.any() or hole.all() or not x.shape[1]:
                continue
            net = build_mlp(x.shape[1], self.param("hidden", default=(32, 16)), 1, rng)
            for _ in range(int(self.param("epochs", default=200))):
                y, kept = net.forward(x[~hole])
                net.step(kept, np.sign(y - z[~hole, j : j + 1]) / max((~hole).sum(), 1), float(self.param("learning_rate", default=1e-2)))
            out[hole, j] = net(x[hole])[:, 0]
        return out

    def begin(self, d, n, seen, rng):
        hidden = self.param("hidden", default=(32, 16))
        if hidden is None:
            raise EstimatorNotDefined("hidden layer sizes are needed")
        return [build_mlp(d - 1, hidden, 1, rng) if 0 < seen[j] < n and d > 1 else None for j in range(d)]

    def work(self, nets, z, about, turn, rng_of):
        out = [np.zeros(0)]
        for j, net in enumerate(nets):
            if net is not None:
                hole = np.isnan(z[:, j])
                y, kept = net.forward(np.nan_to_num(np.delete(z, j, axis=1))[~hole])
                out += [g.ravel() for g in net.gradient(kept, np.sign(y - z[~hole, j : j + 1]) / about["seen"][j])[1]]
        return np.concatenate(out)

    def merge(self, nets, total, turn):
        for net in nets:
            if net is not None:
                net.move(net.split(total), float(self.param("learning_rate", default=1e-2)))
                total = total[net.size :]

    def finish(self, nets, z, about, rng_of):
        out = z.copy()
        for j, net in enumerate(nets):
            if net is not None:
                hole = np.isnan(z[:, j])
                out[hole, j] = net(np.nan_to_num(np.delete(z, j, axis=1))[hole])[:, 0]
        return out


class ImputerAutoencoder(_Neural):
    """An autoencoder fitted to the current fill, which its reconstruction with a noisy latent renews; repeated."""

    def impute(self, z, rng, times):
        hole, x = np.isnan(z), np.nan_to_num(z)
        d = z.shape[1]
        enc, dec = build_autoencoder(d, int(self.param("latent", default=max(1, d // 2))), self.param("hidden", default=(16,)), rng)
        rate, lamb = float(self.param("learning_rate", default=1e-2)), float(self.param("lamb", default=1e-2))
        for _ in range(int(self.param("max_iterations", default=10))):
            for _ in range(int(self.param("epochs", default=30))):
                h, k1 = enc.forward(x)
                y, k2 = dec.forward(h)
                enc.step(k1, dec.step(k2, 2 * (y - x) / x.size, rate), rate)
            h = enc(x)
            x = np.where(hole, dec(h + lamb * h.std(axis=0) * rng.normal(size=h.shape)), x)
        return np.where(hole, dec(enc(x)), z)

    # Over blocks, a block's fill is made again from the kept networks of the iterations before, with the same noise.

    def turns(self):
        return int(self.param("max_iterations", default=10)) * (int(self.param("epochs", default=30)) + 1)

    def begin(self, d, n, seen, rng):
        enc, dec = build_autoencoder(d, int(self.param("latent", default=max(1, d // 2))), self.param("hidden", default=(16,)), rng)
        return [enc, dec, []]

    def _fill(self, nets, z, rng_of):
        hole, x = np.isnan(z), np.nan_to_num(z)
        for turn, enc, dec, spread in nets[2]:
            h = enc(x)
            x = np.where(hole, dec(h + spread * rng_of(turn).normal(size=h.shape)), x)
        return x

    def work(self, nets, z, about, turn, rng_of):
        enc, dec, _ = nets
        x = self._fill(nets, z, rng_of)
        h, k1 = enc.forward(x)
        if turn % (int(self.param("epochs", default=30)) + 1) == int(self.param("epochs", default=30)):
            return np.concatenate([[len(h)], h.sum(axis=0), (h**2).sum(axis=0)])
        y, k2 = dec.forward(h)
        back, gd = dec.gradient(k2, 2 * (y - x) / (about["n"] * z.shape[1]))
        return np.concatenate([g.ravel() for g in [*gd, *enc.gradient(k1, back)[1]]])

    def merge(self, nets, total, turn):
        enc, dec, past = nets
        if turn % (int(self.param("epochs", default=30)) + 1) == int(self.param("epochs", default=30)):
            mean, square = total[1:].reshape(2, -1) / total[0]
            copies = [pickle.loads(pickle.dumps(net)) for net in (enc, dec)]
            past.append((turn, *copies, float(self.param("lamb", default=1e-2)) * np.sqrt(np.maximum(square - mean**2, 0))))
            return
        rate = float(self.param("learning_rate", default=1e-2))
        dec.move(dec.split(total), rate)
        enc.move(enc.split(total[dec.size :]), rate)

    def finish(self, nets, z, about, rng_of):
        return nets[1](nets[0](self._fill(nets, z, rng_of)))


class ImputerDiffusion(_Neural):
    """Denoising diffusion: ``model`` TabDDPM over rows, TsDDPM over windows of rows.

    A linear noise schedule; a network predicts the noise of cells from the noisy
    row and a sine embedding of the step; an epoch shuffles all rows and walks
    them in batches, the last one short.  The reverse process keeps observed
    cells at their noised values.  ``num_sampling`` draws are averaged and, with
    ``is_clip``, kept within the range seen.  Windows are the last ``freq_rows``
    rows; only a window's last row is written back.
    """

    def impute(self, z, rng, times):
        hole = np.isnan(z)
        if not hole.any():
            return z
        x, known = self._windows(z, 0)
        net = self.begin(z.shape[1], len(z), (), rng)[0]
        for _ in range(self.turns()):
            self._epoch(net, x, known, rng)
        seen = [z[~hole[:, j], j] for j in range(z.shape[1])]
        made = self._draw(net, x, known, rng, z.shape[1], [s.min() if len(s) else 0 for s in seen], [s.max() if len(s) else 0 for s in seen])
        return np.where(hole, made, z)

    def _width(self) -> int:
        return int(self.param("freq_rows", default=4)) if self.param("model", default="TabDDPM") == "TsDDPM" else 1

    def _windows(self, z: np.ndarray, before: int) -> tuple[np.ndarray, np.ndarray]:
        """The windows of rows from ``before`` on, and which of their cells are known."""
        width = self._width()
        take = np.maximum(np.arange(before, len(z))[:, None] - np.arange(width - 1, -1, -1), 0)
        return np.nan_to_num(z)[take].reshape(len(take), -1), ~np.isnan(z)[take].reshape(len(take), -1)

    def _noise(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        steps, size = int(self.param("num_noise_steps", default=30)), 8
        beta = np.linspace(float(self.param("beta_start", default=1e-3)), float(self.param("beta_end", default=0.3)), steps)
        freq = np.exp(-np.arange(size // 2))
        return beta, np.cumprod(1 - beta), np.concatenate([np.sin(np.arange(steps)[:, None] * freq), np.cos(np.arange(steps)[:, None] * freq)], axis=1)

    def _epoch(self, net: Dense, x: np.ndarray, known: np.ndarray, rng: np.random.Generator) -> None:
        beta, alpha, embed = self._noise()
        n = len(x)
        batch = min(n, int(self.param("batch_size", default=256)))
        order = rng.permutation(n)
        for at in range(0, n, batch):
            rows = order[at : at + batch]
            t = rng.integers(0, len(beta), len(rows))
            noise = rng.normal(size=(len(rows), x.shape[1]))
            noisy = np.sqrt(alpha[t])[:, None] * x[rows] + np.sqrt(1 - alpha[t])[:, None] * noise
            y, kept = net.forward(np.concatenate([noisy, known[rows], embed[t]], axis=1))
            net.step(kept, 2 * (y - noise) * known[rows] / max(known[rows].sum(), 1), float(self.param("learning_rate", default=1e-3)))

    def _draw(self, net: Dense, x: np.ndarray, known: np.ndarray, rng: np.random.Generator, d: int, low: Sequence[float], high: Sequence[float]) -> np.ndarray:
        beta, alpha, embed = self._noise()
        n, total, draws = len(x), np.zeros_like(x), int(self.param("num_sampling", default=5))
        for _ in range(draws):
            cur = rng.normal(size=x.shape)
            for t in range(len(beta) - 1, -1, -1):
                cur = np.where(known, np.sqrt(alpha[t]) * x + np.sqrt(1 - alpha[t]) * rng.normal(size=x.shape), cur)
                e = net(np.concatenate([cur, known, np.repeat(embed[t : t + 1], n, axis=0)], axis=1))
                pull = beta[t] / np.sqrt(1 - alpha[t]) if beta[t] > 0 else 0.0  # a step without noise moves nothing
                cur = (cur - pull * e) / np.sqrt(1 - beta[t])
                if t:
                    cur += np.sqrt(beta[t]) * rng.normal(size=x.shape)
            total += cur
        made = (total / draws).reshape(n, -1, d)[:, -1]
        return np.clip(made, low, high) if self.param("is_clip", default=True) else made

    def halo(self):
        return self._width() - 1

    def begin(self, d, n, seen, rng):
        cells = d * self._width()
        return [build_mlp(cells * 2 + 8, self.param("hidden", default=(64, 64)), cells, rng)]

    def work(self, nets, z, about, turn, rng_of):
        net = pickle.loads(pickle.dumps(nets[0]))
        x, known = self._windows(z, about["before"])
        self._epoch(net, x, known, rng_of(turn))
        return np.concatenate([[len(x)], len(x) * net.flat()])

    def merge(self, nets, total, turn):
        nets[0].set_flat(total[1:] / total[0])

    def finish(self, nets, z, about, rng_of):
        x, known = self._windows(z, about["before"])
        out = z.copy()
        out[about["before"] :] = self._draw(nets[0], x, known, rng_of(-1), z.shape[1], about["low"], about["high"])
        return out
