"""Distance correlation of two samples of rows, exact, without an n x n matrix in one place.

With a_i, b_i the row sums of the two distance matrices, the mean of the product of the
doubly centred matrices is sum(a_ij b_ij)/n^2 + sum(a) sum(b)/n^4 - 2 sum(a_i b_i)/n^3.
One column a side: row sums come from running sums in order, sum(a_ij b_ij) from sums
over dominated points, all in blocks of ranks (`_line`).  More columns: distances are
summed by tiles of two blocks (`_tiles`), which is quadratic work in many tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..frame import about_means
from ..functions.select import order_statistics
from ..storage import Scratch

#: Rows of a rank block, and of a tile's side; and the most rank blocks, whose cells in two dimensions come to the driver.
LINE_ROWS, TILE_ROWS, MOST_BLOCKS = 100_000, 2_000, 512
#: The most blocks of which each two make a tile, and the rows by rows whose distances a task holds at once.
MOST_TILES, HELD_ROWS = 64, 1_000


def dominated(u: np.ndarray, v: np.ndarray, x: np.ndarray, y: np.ndarray) -> float:
    """Sum of (x_i - x_j)(y_i - y_j) over pairs with u_j < u_i and v_j < v_i, by merging halves of the order by u.

    Equal v must mean equal y.
    """
    n = len(u)
    order = np.lexsort((-v, u))  # of equal u the larger v first: such pairs then never count
    rank = np.empty(n, np.int64)
    rank[np.lexsort((np.arange(n), v[order]))] = np.arange(n)
    x, y, place, total, width = x[order], y[order], np.arange(n), 0.0, 1
    while width < n:
        by = np.argsort(place // (2 * width) * n + rank)
        left, start = by // width % 2 == 0, by // (2 * width) * 2 * width
        px, py = x[by], y[by]

        def below(w: np.ndarray) -> np.ndarray:
            upto = np.r_[0.0, np.cumsum(np.where(left, w, 0.0))]
            return (upto[:-1] - upto[start])[~left]

        qx, qy = px[~left], py[~left]
        total += float((qx * qy * below(np.ones(n)) - qx * below(py) - qy * below(px) + below(px * py)).sum())
        width *= 2
    return total


def row_sums(v: np.ndarray, before: int, sum_before: float, n: int, total: float) -> np.ndarray:
    """Sums of |v_i - v_j| over all ``n`` values, of sorted ``v`` that follow ``before`` values of ``sum_before``."""
    r, p = before + np.arange(len(v)), sum_before + np.cumsum(v) - v
    return 2 * (v * r - p) + total - n * v


def _combine(n: int, s: dict[str, float]) -> float:
    """(1 - distance correlation) / 2 of the sums ab, aa, bb (of matrices) and a, b, ra, rb, rab (of row sums, squares and products)."""
    def centred(m: float, a: float, b: float, r: float) -> float:
        return m / n**2 + a * b / n**4 - 2 * r / n**3

    var = max(centred(s["aa"], s["a"], s["a"], s["ra"]), 0) * max(centred(s["bb"], s["b"], s["b"], s["rb"]), 0)
    return float((1 - np.sqrt(max(centred(s["ab"], s["a"], s["b"], s["rab"]), 0) / np.sqrt(var))) / 2) if var > 0 else 0.5


def _block(value: str, cuts: list[float], salt: Column) -> Column:
    """A rank block; a value that is several cuts falls in any of theirs, as equal values need no order."""
    low = F.size(F.filter(F.lit(cuts), lambda c: c < F.col(value))) if cuts else F.lit(0)
    same = F.size(F.filter(F.lit(cuts), lambda c: c == F.col(value))) if cuts else F.lit(0)
    return (low + F.pmod(salt, same + 1)).cast("int")


def _line(rows: DataFrame, scratch: Scratch, block_rows: int) -> float:
    """One column a side, O(n log n): pairs of two rank blocks both ways come from sums by cell, the others within a block."""
    rows = scratch.save(about_means(rows.toDF("x", "y"), ["x", "y"])[0], "line")
    n = rows.count()
    k = max(1, min(MOST_BLOCKS, -(-n // block_rows)))
    cuts = order_statistics(rows, {c: [n * i // k for i in range(1, k)] for c in "xy"})
    salt = F.xxhash64("x", "y", F.monotonically_increasing_id())
    dealt = scratch.save(rows.select("x", "y", _block("x", cuts["x"], salt).alias("bx"), _block("y", cuts["y"], F.shiftright(salt, 20)).alias("by")), "dealt")
    cells = dealt.groupBy("bx", "by").agg(F.count("*").alias("n"), F.sum("x").alias("x"), F.sum("y").alias("y"), F.sum(F.col("x") * F.col("y")).alias("xy")).toPandas()
    grid = {}
    for c in ("n", "x", "y", "xy"):
        g = np.zeros((k, k))
        g[cells["bx"], cells["by"]] = cells[c]
        grid[c] = g
    low = {c: np.pad(g, ((1, 0), (1, 0))).cumsum(0).cumsum(1)[:k, :k] for c, g in grid.items()}
    sx, sy, sxy = (float(grid[c].sum()) for c in ("x", "y", "xy"))
    pairs = float((grid["xy"] * low["n"] - grid["x"] * low["y"] - grid["y"] * low["x"] + grid["n"] * low["xy"]).sum())
    starts = {c: (np.r_[0, grid["n"].sum(axis)].cumsum(), np.r_[0, grid[c].sum(axis)].cumsum()) for c, axis in (("x", 1), ("y", 0))}

    def by_x(key, pdf):
        pdf, b = pdf.sort_values("x", kind="stable"), int(key[0])
        x, y = pdf["x"].to_numpy(), pdf["y"].to_numpy()
        d = np.zeros(len(pdf))
        d[:1] = dominated(np.arange(len(x)), y, x, y)
        return pd.DataFrame({"bx": b, "by": pdf["by"].to_numpy(), "x": x, "y": y, "a": row_sums(x, int(starts["x"][0][b]), starts["x"][1][b], n, sx), "d": d})

    def by_y(key, pdf):
        pdf, q = pdf.sort_values("y", kind="stable"), int(key[0])
        x, y, a = (pdf[c].to_numpy() for c in "xya")
        b = row_sums(y, int(starts["y"][0][q]), starts["y"][1][q], n, sy)
        d = pdf["d"].sum() + dominated(pdf["bx"].to_numpy(), np.arange(len(y)), x, y)
        return pd.DataFrame([[d, a.sum(), b.sum(), a @ a, b @ b, a @ b, x @ x, y @ y]], columns=names)

    names = ["d", "a", "b", "ra", "rb", "rab", "xx", "yy"]
    half = scratch.save(dealt.groupBy("bx").applyInPandas(by_x, "bx int, by int, x double, y double, a double, d double"), "by_x")
    s = half.groupBy("by").applyInPandas(by_y, ", ".join(f"{c} double" for c in names)).agg(*[F.sum(c).alias(c) for c in names]).first().asDict()
    # |dy| = 2 max(dy, 0) - dy, and the plain products of differences have a closed sum.
    s["ab"] = 2 * (2 * (pairs + s["d"]) - (n * sxy - sx * sy))
    return _combine(n, s | {"aa": 2 * n * s["xx"] - 2 * sx * sx, "bb": 2 * n * s["yy"] - 2 * sy * sy})


def _tiles(rows: DataFrame, d: int, scratch: Scratch, tile_rows: int) -> float:
    """Any number of columns a side: tiles of two blocks give their part of the row sums and of the sums of products.

    Blocks grow with the table beyond ``MOST_TILES``, so what tiles receive and send
    grows with the rows; a task walks through its tile in pieces.
    """
    names = [f"x{i}" for i in range(d)] + [f"y{i}" for i in range(d)]
    rows = scratch.save(about_means(rows.toDF(*names), names)[0].withColumn("h", F.xxhash64(*names, F.monotonically_increasing_id())), "tiles")
    n = rows.count()
    k = max(1, min(MOST_TILES, -(-n // tile_rows)))

    def pack(key, pdf):
        return pd.DataFrame({"block": [int(key[0])], "n": [len(pdf)], "v": [pdf[names].to_numpy(float).tobytes()]})

    blocks = scratch.save(rows.withColumn("block", F.pmod("h", F.lit(k)).cast("int")).groupBy("block").applyInPandas(pack, "block int, n int, v binary"), "blocks")

    def distances(v: np.ndarray, w: np.ndarray) -> np.ndarray:
        return np.sqrt(sum((v[:, None, j] - w[None, :, j]) ** 2 for j in range(d)))

    def run(batches):
        for pdf in batches:
            for p, v, q, w in zip(pdf["p"], pdf["v"], pdf["q"], pdf["w"]):
                v, w = (np.frombuffer(z, float).reshape(-1, 2 * d) for z in (v, w))
                rows, across, sums = np.zeros((2, len(v))), np.zeros((2, len(w))), np.zeros(3)
                for i in range(0, len(v), HELD_ROWS):
                    for j in range(0, len(w), HELD_ROWS):
                        vi, wj = v[i : i + HELD_ROWS], w[j : j + HELD_ROWS]
                        a, b = distances(vi[:, :d], wj[:, :d]), distances(vi[:, d:], wj[:, d:])
                        sums += [(a * b).sum(), (a * a).sum(), (b * b).sum()]
                        rows[:, i : i + HELD_ROWS] += a.sum(axis=1), b.sum(axis=1)
                        across[:, j : j + HELD_ROWS] += a.sum(axis=0), b.sum(axis=0)
                out = [(p, rows[0].tobytes(), rows[1].tobytes(), *(sums * (1 + (p != q))))]
                if p != q:
                    out.append((q, across[0].tobytes(), across[1].tobytes(), 0.0, 0.0, 0.0))
                yield pd.DataFrame(out, columns=["block", "a", "b", "ab", "aa", "bb"])

    def add(pdf):
        a, b = (np.sum([np.frombuffer(z, float) for z in pdf[c]], axis=0) for c in "ab")
        return pd.DataFrame([[*pdf[["ab", "aa", "bb"]].sum(), a.sum(), b.sum(), a @ a, b @ b, a @ b]], columns=sums)

    sums = ["ab", "aa", "bb", "a", "b", "ra", "rb", "rab"]
    left, right = blocks.select(F.col("block").alias("p"), "v"), blocks.select(F.col("block").alias("q"), F.col("v").alias("w"))
    # Each block is sent to the blocks from its own number on: all tiles of the upper triangle.
    tiles = left.withColumn("q", F.explode(F.sequence("p", F.lit(k - 1)))).join(right, "q").repartition(min(k * (k + 1) // 2, 10_000))
    parts = tiles.mapInPandas(run, "block int, a binary, b binary, ab double, aa double, bb double")
    got = parts.groupBy("block").applyInPandas(add, ", ".join(f"{c} double" for c in sums)).agg(*[F.sum(c).alias(c) for c in sums]).first()
    return _combine(n, got.asDict())


def distance_anticorrelation(df: DataFrame, left: Sequence[str], right: Sequence[str], block_rows: int | None = None) -> float:
    """(1 - distance correlation) / 2 of columns ``left`` against ``right``; rows with an unknown cell in either take no part.

    0.5 where a side does not vary; without rows, NaN.
    """
    if len(left) != len(right) or not left:
        raise ValueError("as many columns on the right as on the left, and one at least")
    known = df.select(*[F.col(f"`{c}`").cast("double").alias(f"v{i}") for i, c in enumerate([*left, *right])]).dropna()
    if known.isEmpty():
        return float("nan")
    scratch = Scratch(df.sparkSession)
    if len(left) == 1:
        return _line(known, scratch, block_rows or LINE_ROWS)
    return _tiles(known, len(left), scratch, block_rows or TILE_ROWS)
