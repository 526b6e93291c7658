"""The library's queries over the driver's tables, each with the DuckDB SQL that gives the same rows.

The tables have no NULL, so holes are injected by an integer predicate that both
engines evaluate alike.  Methods that SQL cannot express are registered as
invariants: counts that must be zero, or decisions that must hold.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..frame import Spec, pattern
from ..operators import distances, em, holes, knn, lowrank, mcar, metrics, neural, preprocessing, regress, simple
from ..functions import select, series
from ..sources import datasets, tsf
from ..storage import Scratch
from .comparator import Comparator
from .search import minimize, objective_of

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

HOLE = "((event_id * 7919 + 104729) % 1000) < 150"
HOLE2 = "((event_id * 6101 + 7717) % 1000) < 120"
EV = f"ev AS (SELECT event_id, event_type AS g, user_id, ts, value, CASE WHEN {HOLE} THEN NULL ELSE value END AS x, ({HOLE}) AS m_x FROM events)"
BY = {"groups": ["g"], "order_by": ["event_id"], "key": ["event_id"], "columns": ["x"]}


def query(name: str, sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return add


def read(s: SparkSession, d: str, t: str) -> DataFrame:
    return s.read.parquet(f"{d}/{t}.parquet")


def events(s: SparkSession, d: str) -> DataFrame:
    hole = F.expr(HOLE)
    return read(s, d, "events").select("event_id", F.col("event_type").alias("g"), "user_id", "ts", "value", F.when(~hole, F.col("value")).alias("x"), hole.alias("m_x"))


def median(df: DataFrame, c: str) -> float:
    """Of the known values, by counting: a window over the whole table would be one task."""
    known = df.select(c).dropna()
    n = known.count()
    return sum(select.order_statistics(known, {c: [(n - 1) // 2, n // 2] if n else []})[c]) / 2


def r6(c: Column | str) -> Column:
    return F.round(c, 6) + 0.0


def out(df: DataFrame, c: str = "x") -> DataFrame:
    return df.select("event_id", r6(c).alias("x"))


# -- imputers -----------------------------------------------------------------


@query("impute_linear", f"""WITH {EV}, n AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY event_id) AS rn FROM ev),
w AS (SELECT *, last_value(CASE WHEN x IS NOT NULL THEN rn END IGNORE NULLS) OVER a AS r0, last_value(x IGNORE NULLS) OVER a AS x0,
 first_value(CASE WHEN x IS NOT NULL THEN rn END IGNORE NULLS) OVER b AS r1, first_value(x IGNORE NULLS) OVER b AS x1 FROM n
 WINDOW a AS (PARTITION BY g ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), b AS (PARTITION BY g ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT g, count(*) AS n_holes, round(avg(abs(value - coalesce(x, CASE WHEN x0 IS NULL THEN x1 WHEN x1 IS NULL THEN x0 ELSE x0 + (x1 - x0) * (rn - r0) / (r1 - r0) END))), 6) AS mae FROM w WHERE m_x GROUP BY g""")
def impute_linear(s, d):
    """Flagship: linear interpolation in each group, scored on the holes."""
    filled = simple.ImputerInterpolation(**BY).fit_transform(events(s, d))
    return filled.where("m_x").groupBy("g").agg(F.count(F.lit(1)).alias("n_holes"), r6(F.avg(F.abs(F.col("value") - F.col("x")))).alias("mae"))


for _n, _f in (("mean", "avg"), ("median", "median")):
    query(f"impute_{_n}", f"WITH {EV} SELECT event_id, round(coalesce(x, {_f}(x) OVER (PARTITION BY g)), 6) AS x FROM ev")(
        lambda s, d, n=_n: out(simple.ImputerSimple(strategy=n, **BY).fit_transform(events(s, d)))
    )


@query("impute_mode", f"""WITH o AS (SELECT o_orderkey, o_orderstatus, CASE WHEN (o_orderkey * 7919 + 104729) % 1000 < 150 THEN NULL ELSE o_orderpriority END AS p FROM orders),
c AS (SELECT o_orderstatus, p, row_number() OVER (PARTITION BY o_orderstatus ORDER BY count(*) DESC, p) AS r FROM o WHERE p IS NOT NULL GROUP BY 1, 2)
SELECT o_orderkey, coalesce(o.p, c.p) AS p FROM o LEFT JOIN c ON o.o_orderstatus = c.o_orderstatus AND c.r = 1""")
def impute_mode(s, d):
    o = read(s, d, "orders").select("o_orderkey", "o_orderstatus", F.when(~F.expr("(o_orderkey * 7919 + 104729) % 1000 < 150"), F.col("o_orderpriority")).alias("p"))
    return simple.ImputerSimple(groups=["o_orderstatus"], columns=["p"]).fit_transform(o).select("o_orderkey", "p")


query("impute_constant", f"WITH {EV} SELECT event_id, round(coalesce(x, -1.5), 6) AS x FROM ev")(lambda s, d: out(simple.ImputerSimple(strategy="constant", fill_value=-1.5, **BY).fit_transform(events(s, d))))
query("impute_oracle", "SELECT event_id, round(value, 6) AS x FROM events")(
    lambda s, d: out(simple.ImputerOracle(read(s, d, "events").select("event_id", F.col("value").alias("x")), **BY).fit_transform(events(s, d)))
)
query("impute_locf", f"WITH {EV} SELECT event_id, round(coalesce(last_value(x IGNORE NULLS) OVER (PARTITION BY g ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), first_value(x IGNORE NULLS) OVER (PARTITION BY g ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 6) AS x FROM ev")(
    lambda s, d: out(simple.ImputerLOCF(**BY).fit_transform(events(s, d)))
)
query("impute_nocb", f"WITH {EV} SELECT event_id, round(coalesce(first_value(x IGNORE NULLS) OVER (PARTITION BY g ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), last_value(x IGNORE NULLS) OVER (PARTITION BY g ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)), 6) AS x FROM ev")(
    lambda s, d: out(simple.ImputerNOCB(**BY).fit_transform(events(s, d)))
)
query("impute_locf_global", f"WITH {EV} SELECT event_id, round(coalesce(last_value(x IGNORE NULLS) OVER (ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), first_value(x IGNORE NULLS) OVER (ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 6) AS x FROM ev")(
    lambda s, d: out(simple.ImputerLOCF(order_by=["event_id"], columns=["x"], n_blocks=16).fit_transform(events(s, d)))
)
_NEIGHBOURS = f"""WITH {EV}, n AS (SELECT *, epoch_us(ts)::DOUBLE AS t, row_number() OVER (PARTITION BY g ORDER BY ts, event_id)::DOUBLE AS rn FROM ev),
w AS (SELECT *, last_value(CASE WHEN x IS NOT NULL THEN {{p}} END IGNORE NULLS) OVER a AS r0, last_value(x IGNORE NULLS) OVER a AS x0,
 first_value(CASE WHEN x IS NOT NULL THEN {{p}} END IGNORE NULLS) OVER b AS r1, first_value(x IGNORE NULLS) OVER b AS x1 FROM n
 WINDOW a AS (PARTITION BY g ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), b AS (PARTITION BY g ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT event_id, round(coalesce(x, CASE WHEN x0 IS NULL THEN x1 WHEN x1 IS NULL THEN x0 ELSE {{e}} END), 6) AS x FROM w"""
_TIMED = BY | {"order_by": ["ts", "event_id"]}
query("impute_time_linear", _NEIGHBOURS.format(p="t", e="x0 + CASE WHEN r1 <> r0 THEN (x1 - x0) * (t - r0) / (r1 - r0) ELSE 0 END"))(
    lambda s, d: out(simple.ImputerInterpolation(method="time", col_time="ts", **_TIMED).fit_transform(events(s, d)))
)
query("impute_nearest", _NEIGHBOURS.format(p="rn", e="CASE WHEN rn - r0 <= r1 - rn THEN x0 ELSE x1 END"))(lambda s, d: out(simple.ImputerInterpolation(method="nearest", **_TIMED).fit_transform(events(s, d))))
query("impute_fallback", f"""WITH {EV}, h AS (SELECT event_id, g, CASE WHEN g = 'view' THEN NULL ELSE x END AS x FROM ev), f AS (SELECT event_id, coalesce(x, avg(x) OVER (PARTITION BY g)) AS x FROM h)
SELECT event_id, round(coalesce(x, (SELECT median(x) FROM f)), 6) AS x FROM f""")(
    lambda s, d: out(simple.ImputerSimple(strategy="mean", **BY).fit_transform(events(s, d).withColumn("x", F.when(F.col("g") != "view", F.col("x")))))
)


def _days(s: SparkSession, d: str) -> DataFrame:
    o = read(s, d, "orders").select(F.to_date("o_orderdate").alias("day"), "o_totalprice")
    t = o.groupBy("day").agg(F.avg("o_totalprice").alias("v"), F.count(F.lit(1)).alias("n"))
    n = F.datediff("day", F.lit("1990-01-01").cast("date")).cast("long")
    return t.select(n.alias("event_id"), F.col("v").alias("value"), F.when((n * 7919 + 104729) % 1000 >= 150, F.col("v")).alias("x"), F.col("n").cast("double").alias("n"))


DAYS = """days AS (SELECT datediff('day', DATE '1990-01-01', CAST(o_orderdate AS DATE)) AS event_id, avg(o_totalprice) AS value,
 CASE WHEN (datediff('day', DATE '1990-01-01', CAST(o_orderdate AS DATE)) * 7919 + 104729) % 1000 < 150 THEN NULL ELSE avg(o_totalprice) END AS x, count(*)::DOUBLE AS n FROM orders GROUP BY CAST(o_orderdate AS DATE))"""


@query("impute_residuals_interior", f"""WITH {DAYS}, n AS (SELECT *, row_number() OVER (ORDER BY event_id) AS rn, count(*) OVER () AS total FROM days),
w AS (SELECT *, last_value(CASE WHEN x IS NOT NULL THEN rn END IGNORE NULLS) OVER a AS r0, last_value(x IGNORE NULLS) OVER a AS x0, first_value(CASE WHEN x IS NOT NULL THEN rn END IGNORE NULLS) OVER b AS r1, first_value(x IGNORE NULLS) OVER b AS x1 FROM n
 WINDOW a AS (ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), b AS (ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
i AS (SELECT event_id, x, rn, total, coalesce(x, CASE WHEN x0 IS NULL THEN x1 WHEN x1 IS NULL THEN x0 ELSE x0 + (x1 - x0) * (rn - r0) / (r1 - r0) END) AS y FROM w),
t AS (SELECT *, CASE WHEN rn > 3 AND rn <= total - 3 THEN avg(y) OVER (ORDER BY rn ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) END AS t0 FROM i),
la AS (SELECT regr_slope(t0, rn) m, avg(t0) ya, avg(rn) ra FROM t WHERE rn > 3 AND rn <= 10), lb AS (SELECT regr_slope(t0, rn) m, avg(t0) ya, avg(rn) ra FROM t WHERE rn <= total - 3 AND rn > total - 10),
tr AS (SELECT t.*, coalesce(t0, CASE WHEN rn <= 3 THEN la.ya + la.m * (rn - la.ra) ELSE lb.ya + lb.m * (rn - lb.ra) END) AS tr FROM t, la, lb),
se AS (SELECT (rn - 1) % 7 AS k, avg(y - tr) AS s FROM tr GROUP BY 1), sc AS (SELECT k, s - (SELECT avg(s) FROM se) AS s FROM se),
e AS (SELECT tr.*, tr + s AS base, CASE WHEN x IS NOT NULL THEN y - tr - s END AS e FROM tr JOIN sc ON k = (rn - 1) % 7),
v AS (SELECT *, last_value(CASE WHEN e IS NOT NULL THEN rn END IGNORE NULLS) OVER a AS q0, last_value(e IGNORE NULLS) OVER a AS e0, first_value(CASE WHEN e IS NOT NULL THEN rn END IGNORE NULLS) OVER b AS q1, first_value(e IGNORE NULLS) OVER b AS e1 FROM e
 WINDOW a AS (ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), b AS (ORDER BY rn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT event_id, round(0.00000123 + coalesce(x, base + coalesce(e, CASE WHEN e0 IS NULL THEN e1 WHEN e1 IS NULL THEN e0 ELSE e0 + (e1 - e0) * (rn - q0) / (q1 - q0) END)), 5) AS x FROM v""")
def impute_residuals(s, d):
    filled = simple.ImputerResiduals(period=7, order_by=["event_id"], columns=["x"]).fit_transform(_days(s, d).select("event_id", "x"))
    # Daily means are often half-way between two decimals; the small shift keeps rounding away from such ties.
    return filled.select("event_id", (F.round(F.col("x") + 0.00000123, 5) + 0.0).alias("x"))


PARTS = "pt AS (SELECT p_partkey AS id, CASE WHEN (p_partkey * 7919 + 104729) % 1000 < 150 THEN NULL ELSE p_size::DOUBLE END AS a, CASE WHEN (p_partkey * 6101 + 7717) % 1000 < 120 THEN NULL ELSE p_retailprice / 100 END AS b, p_brand AS g FROM part)"


def _parts(s: SparkSession, d: str) -> DataFrame:
    size, price = F.expr("(p_partkey * 7919 + 104729) % 1000 < 150"), F.expr("(p_partkey * 6101 + 7717) % 1000 < 120")
    return read(s, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("g"), F.when(~size, F.col("p_size").cast("double")).alias("a"), F.when(~price, F.col("p_retailprice") / 100).alias("b"))


@query("em_conditional_mean_fixed", "SELECT p_partkey AS id, round(CASE WHEN (p_partkey * 7919 + 104729) % 1000 < 150 THEN 25 + 0.5 * (p_retailprice / 100 - 14) ELSE p_size END, 6) AS a FROM part")
def em_fixed(s, d):
    import numpy as np
    import pandas as pd

    mu, sigma = np.array([25.0, 14.0]), np.array([[200.0, 4.0], [4.0, 8.0]])
    p = read(s, d, "part").select(F.col("p_partkey").alias("id"), F.when(~F.expr("(p_partkey * 7919 + 104729) % 1000 < 150"), F.col("p_size").cast("double")).alias("a"), (F.col("p_retailprice") / 100).alias("b"))

    def run(batches):
        for x in batches:
            yield pd.DataFrame({"id": x["id"], "a": em.conditional(x[["a", "b"]].to_numpy(float), mu, sigma)[:, 0]})

    return p.mapInPandas(run, "id long, a double").select("id", r6("a").alias("a"))


query("impute_ols1", f"""WITH {EV}, c AS (SELECT g, regr_slope(x, user_id) AS m, regr_intercept(x, user_id) AS b FROM ev GROUP BY g)
SELECT event_id, round(coalesce(x, b + m * user_id), 6) AS x FROM ev JOIN c USING (g)""")(
    lambda s, d: out(regress.ImputerRegressor(groups=["g"], key=["event_id"], columns=["x", "user_id"]).fit_transform(events(s, d).drop("ts", "value")))
)


@query("impute_mice_one_sweep", f"""WITH p AS (SELECT p_partkey AS id, CASE WHEN (p_partkey * 7919 + 104729) % 1000 < 150 THEN NULL ELSE p_size::DOUBLE END AS a, CASE WHEN (p_partkey * 6101 + 7717) % 1000 < 120 THEN NULL ELSE p_retailprice / 100 END AS b FROM part),
f AS (SELECT id, a, b, coalesce(a, avg(a) OVER ()) AS a0, coalesce(b, avg(b) OVER ()) AS b0, count(*) FILTER (a IS NULL) OVER () AS na, count(*) FILTER (b IS NULL) OVER () AS nb FROM p),
s1 AS (SELECT *, CASE WHEN na <= nb THEN coalesce(a, (SELECT regr_intercept(a, b0) + regr_slope(a, b0) * f.b0 FROM f WHERE a IS NOT NULL)) ELSE a0 END AS a1, CASE WHEN na > nb THEN coalesce(b, (SELECT regr_intercept(b, a0) FROM f WHERE b IS NOT NULL) + (SELECT regr_slope(b, a0) FROM f WHERE b IS NOT NULL) * f.a0) ELSE b0 END AS b1 FROM f)
SELECT id, round(CASE WHEN na <= nb THEN a1 ELSE coalesce(a, (SELECT regr_intercept(a, b1) FROM s1 WHERE a IS NOT NULL) + (SELECT regr_slope(a, b1) FROM s1 WHERE a IS NOT NULL) * b1) END, 5) AS a,
 round(CASE WHEN na > nb THEN b1 ELSE coalesce(b, (SELECT regr_intercept(b, a1) FROM s1 WHERE b IS NOT NULL) + (SELECT regr_slope(b, a1) FROM s1 WHERE b IS NOT NULL) * a1) END, 5) AS b FROM s1""".replace("(SELECT regr_intercept(a, b0) + regr_slope(a, b0) * f.b0 FROM f WHERE a IS NOT NULL)", "(SELECT regr_intercept(a, b0) FROM f WHERE a IS NOT NULL) + (SELECT regr_slope(a, b0) FROM f WHERE a IS NOT NULL) * f.b0"))
def impute_mice(s, d):
    filled = regress.ImputerMICE(estimator="ols", max_iter=1, key=["id"]).fit_transform(_parts(s, d).drop("g"))
    return filled.select("id", (F.round("a", 5) + 0.0).alias("a"), (F.round("b", 5) + 0.0).alias("b"))


@query("impute_knn", f"""WITH {PARTS}, c AS (SELECT l.id, r.id AS donor, r.a, sqrt(CASE WHEN l.b IS NOT NULL AND r.b IS NOT NULL THEN 2 * (l.b - r.b) * (l.b - r.b) END) AS dist FROM pt l JOIN pt r ON l.g = r.g AND l.a IS NULL AND r.a IS NOT NULL),
k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY dist, donor) AS n FROM c WHERE dist IS NOT NULL),
v AS (SELECT id, coalesce(avg(a) FILTER (dist = 0), sum(a / nullif(dist, 0)) / sum(1 / nullif(dist, 0))) AS a FROM k WHERE n <= 5 GROUP BY id)
SELECT pt.id, round(coalesce(pt.a, v.a, avg(pt.a) OVER (PARTITION BY pt.g)), 6) AS a FROM pt LEFT JOIN v USING (id)""")
def impute_knn(s, d):
    return knn.ImputerKNN(n_neighbors=5, key=["id"], groups=["g"]).fit_transform(_parts(s, d)).select("id", r6("a").alias("a"))


@query("impute_knn_global", f"""WITH {PARTS}, c AS (SELECT l.id, r.id AS donor, r.a, sqrt(2 * (l.b - r.b) * (l.b - r.b)) AS dist FROM pt l JOIN pt r ON l.a IS NULL AND r.a IS NOT NULL AND l.b IS NOT NULL AND r.b IS NOT NULL),
k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY dist, donor) AS n FROM c),
v AS (SELECT id, coalesce(avg(a) FILTER (dist = 0), sum(a / nullif(dist, 0)) / sum(1 / nullif(dist, 0))) AS a FROM k WHERE n <= 7 GROUP BY id)
SELECT pt.id, round(coalesce(pt.a, v.a, avg(pt.a) OVER ()), 6) AS a FROM pt LEFT JOIN v USING (id)""")
def impute_knn_global(s, d):
    """Without groups and without the plain join: neighbours by the search through cells."""
    parts = _parts(s, d).drop("g")
    return knn.ImputerKNN(n_neighbors=7, key=["id"], most_pairs=0).fit_transform(parts).select("id", r6("a").alias("a"))


query("impute_shuffle_hash")(lambda s, d: _invariants(events(s, d), simple.ImputerShuffle(seed=3, **BY).fit_transform(events(s, d))))


def _invariants(before: DataFrame, after: DataFrame) -> DataFrame:
    """Holes left, observed cells changed, and values outside the group's observed range."""
    lo, hi = F.min("x0").over(Window.partitionBy("g")), F.max("x0").over(Window.partitionBy("g"))
    both = before.select("event_id", F.col("g"), F.col("x").alias("x0")).withColumns({"lo": lo, "hi": hi}).join(after.select("event_id", "x"), "event_id")
    return both.agg(
        F.count(F.lit(1)).alias("n_rows"), F.count(F.when(F.col("x").isNull(), 1)).alias("n_missing_after"), F.count(F.when(F.col("x0").isNotNull() & (F.col("x0") != F.col("x")), 1)).alias("n_observed_changed"),
        F.count(F.when(~F.col("x").between(F.col("lo"), F.col("hi")), 1)).alias("n_outside_range"),
    )


ORACLE_SQL["impute_shuffle_hash"] = "SELECT count(*) AS n_rows, 0::BIGINT AS n_missing_after, 0::BIGINT AS n_observed_changed, 0::BIGINT AS n_outside_range FROM events"


def _numeric(name: str, make: Callable[[], object]) -> None:
    """A method over two numeric columns by group, held to its contract: nothing missing after, nothing observed changed."""

    def f(s: SparkSession, d: str) -> DataFrame:
        e = events(s, d).select("event_id", "g", "x", F.col("user_id").cast("double").alias("u"))
        both = e.withColumnRenamed("x", "x0").join(make().fit_transform(e).select("event_id", F.col("x")), "event_id")
        return both.agg(F.count(F.lit(1)).alias("n_rows"), F.count(F.when(F.col("x").isNull() | F.isnan("x"), 1)).alias("n_missing_after"), F.count(F.when(F.col("x0").isNotNull() & (F.col("x0") != F.col("x")), 1)).alias("n_observed_changed"))

    query(name, "SELECT count(*) AS n_rows, 0::BIGINT AS n_missing_after, 0::BIGINT AS n_observed_changed FROM events")(f)


_XU = BY | {"columns": ["x", "u"]}
# With one column complete, the Gaussian's maximum likelihood and the chained equations' fixed point are the regression on it.
_REGRESSED = f"""WITH {EV}, c AS (SELECT g, regr_slope(x, user_id) AS m, regr_intercept(x, user_id) AS b FROM ev GROUP BY g)
SELECT event_id, round(coalesce(x, b + m * user_id), 4) AS x FROM ev JOIN c USING (g)"""


def _regressed(name: str, make: Callable[[], object]) -> None:
    def f(s: SparkSession, d: str) -> DataFrame:
        e = events(s, d).select("event_id", "g", "x", F.col("user_id").cast("double").alias("u"))
        return make().fit_transform(e).select("event_id", (F.round("x", 4) + 0.0).alias("x"))

    query(name, _REGRESSED)(f)


_regressed("impute_em_mle", lambda: em.ImputerEM(tolerance=1e-12, max_iter_em=500, **_XU))
_regressed("impute_mice_full", lambda: regress.ImputerMICE(estimator="ols", max_iter=10, **_XU))


@query("impute_mice_draws", f"""WITH {EV}, f AS (SELECT g, regr_slope(x, user_id) AS b, regr_intercept(x, user_id) AS a, count(x) AS n, count(*) - count(x) AS holes  FROM ev GROUP BY g)
SELECT g, holes AS n_holes, round(a + b * 100, 3) + 0.0 AS fit_at_100, true AS mean_holds, true AS spread_holds FROM f""")
def impute_mice_draws(s, d):
    """Four imputations drawn from the posterior of each group's regression on user_id, against its closed form.

    The fit is the library's own, at user_id = 100. Over the holes the draws' distance from
    their conditional means, in units of the residual deviation, must have mean 0 within five
    standard errors (of coefficients and cells) and mean square 1 within a tenth and five more.
    """
    e = events(s, d).select("event_id", "g", F.col("user_id").cast("double").alias("u"), "x")
    kw = {"estimator": "ols", "groups": ["g"], "key": ["event_id"], "columns": ["u", "x"]}
    probes = e.groupBy("g").agg(F.lit(-1).cast("long").alias("event_id")).select("event_id", "g", F.lit(100.0).alias("u"), F.lit(None).cast("double").alias("x"))
    mean = regress.ImputerMICE(max_iter=1, **kw).fit_transform(e.unionAll(probes))
    at = mean.where("event_id = -1").select("g", F.round("x", 3).alias("fit_at_100"))
    seen = e.where("x IS NOT NULL").groupBy("g").agg(F.regr_sxx("x", "u").alias("sxx"), F.regr_syy("x", "u").alias("syy"), F.regr_sxy("x", "u").alias("sxy"), F.count("*").alias("n"))
    scale = seen.select("g", "n", F.sqrt((F.col("syy") - F.col("sxy") ** 2 / F.col("sxx")) / (F.col("n") - 2)).alias("s"))
    runs, seeds = None, 4
    for seed in range(seeds):
        one = regress.ImputerMICE(sample_posterior=True, max_iter=1, seed=seed, **kw).fit_transform(e).select("event_id", F.col("x").alias("drawn"))
        runs = one if runs is None else runs.unionAll(one)
    holes_ = mean.where("event_id >= 0").join(e.where("x IS NULL").select("event_id"), "event_id").select("event_id", "g", F.col("x").alias("fit"))
    r = holes_.join(runs, "event_id").join(scale, "g").withColumn("r", (F.col("drawn") - F.col("fit")) / F.col("s"))
    r = r.groupBy("g").agg(F.count("*").alias("k"), F.max("n").alias("n"), F.avg("r").alias("m"), F.avg(F.col("r") ** 2).alias("v"))
    cells = F.col("k") / seeds
    good = r.select("g", cells.cast("long").alias("n_holes"), (F.abs("m") < 5 * F.sqrt(1 / F.col("k") + 1 / (seeds * F.col("n")))).alias("mean_holds"), (F.abs(F.col("v") - 1) < 0.1 + 5 * F.sqrt(2 / F.col("k") + 2 / (seeds * F.col("n")))).alias("spread_holds"))
    return good.join(at, "g").select("g", "n_holes", F.col("fit_at_100") + 0.0, "mean_holds", "spread_holds").toDF("g", "n_holes", "fit_at_100", "mean_holds", "spread_holds")


_numeric("impute_em_sample", lambda: em.ImputerEM(method="sample", seed=1, **_XU))
_numeric("impute_var", lambda: em.ImputerEM(model="VAR", p=1, max_iter_em=2, **_XU))


@query("impute_var_blocks", f"WITH {EV} SELECT count(*) AS n, count(*) FILTER (x IS NULL) AS n_holes, 0::BIGINT AS n_moved_by_cuts, 0::BIGINT AS n_seen_changed FROM ev")
def impute_var_blocks(s, d):
    """The smoother's fills do not depend on where series are cut: short blocks against long ones, after one round of EM."""
    e = events(s, d).select("event_id", "g", "x", F.col("user_id").cast("double").alias("u"))
    short, long = (em.ImputerEM(model="VAR", p=1, max_iter_em=1, block=n, **_XU).fit_transform(e).select("event_id", F.col("x").alias(f"x{n}")) for n in (37, 350))
    met = e.select("event_id", "x").join(short, "event_id").join(long, "event_id")
    count = lambda c, name: F.count(F.when(c, 1)).alias(name)
    far = F.coalesce(F.abs(F.col("x37") - F.col("x350")) > 1e-6 * (1 + F.abs("x37")), F.lit(True))
    return met.agg(F.count("*").alias("n"), count(F.col("x").isNull(), "n_holes"), count(far, "n_moved_by_cuts"), count(F.col("x") != F.col("x37"), "n_seen_changed"))


_CURVES = {"cubic": "(i - 30) * (i - 30) * (i - 30) / 1000.0 + i / 7.0", "quadratic": "(i - 20) * (i - 20) / 50.0 - i / 3.0"}


def _spline(method: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(s: SparkSession, d: str) -> DataFrame:
        n = F.row_number().over(Window.partitionBy("p_brand").orderBy("p_partkey")) - 1
        p = read(s, d, "part").select(F.col("p_partkey").alias("id"), "p_brand", n.alias("n"))
        p = p.select("id", "p_brand", F.floor(F.col("n") / 60).alias("k"), (F.col("n") % 60).alias("i"), F.max("n").over(Window.partitionBy("p_brand")).alias("last"), "n")
        hole = (F.col("i") % 7 == 3) & (F.col("n") < F.col("last")) & (F.col("i") < 59)
        e = p.select("id", "p_brand", "k", F.when(~hole, F.expr(_CURVES[method]).cast("double")).alias("x"))
        return simple.ImputerInterpolation(method=method, groups=["p_brand", "k"], order_by=["id"], key=["id"], columns=["x"]).fit_transform(e).select("id", (F.round("x", 4) + 0.0).alias("x"))

    run.__doc__ = f"""A {method} curve of the rank, in stretches of 60 rows by brand: the spline gives it back in the holes."""
    return run


for _name, _method in (("impute_spline", "cubic"), ("impute_quadratic", "quadratic")):
    query(_name, f"WITH p AS (SELECT p_partkey AS id, (row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1) % 60 AS i FROM part) SELECT id, round({_CURVES[_method]}, 4) + 0.0 AS x FROM p")(_spline(_method))


@query("tsf_source", "SELECT p_brand AS series_name, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS i, CASE WHEN p_partkey % 5 <> 2 THEN p_retailprice::DOUBLE END AS v FROM part")
def tsf_source(s, d):
    """Prices by brand written as .tsf files and read back by the data source, in byte ranges that cut the files."""
    value = F.struct("p_partkey", F.when(F.col("p_partkey") % 5 != 2, F.col("p_retailprice").cast("double")).alias("v"))
    series = read(s, d, "part").groupBy(F.col("p_brand").alias("series_name")).agg(F.transform(F.sort_array(F.collect_list(value)), lambda x: x["v"]).alias("series_value"))
    scratch = Scratch(s)
    tsf.write_tsf(series, f"{scratch.base}/series")
    tsf.register(s)
    got = s.read.format("tsf").option("split_bytes", 1_000).load(f"{scratch.base}/series")
    return got.select("series_name", F.posexplode("series_value").alias("i", "v")).withColumn("i", F.col("i").cast("long"))


def _planted(s: SparkSession, d: str) -> DataFrame:
    """A series that folds to a matrix of rank 1, with holes; every matrix row keeps a cell."""
    i = F.col("p_partkey")
    e = read(s, d, "part").select(F.col("p_partkey").alias("id"), ((1.0 + i % 5) * (10.0 + F.floor(i / 5) % 7)).alias("truth"), (i % 5).alias("at"), F.floor(i / 5).alias("line"))
    return e.select("id", "truth", F.when(((F.col("id") * 7919 + 104729) % 1000 >= 100) | (F.col("at") == F.col("line") % 5), F.col("truth")).alias("x"))


def _near(filled: DataFrame, truth: DataFrame) -> DataFrame:
    """Whether each cell is within a twentieth, and a half, of the planted value."""
    far = F.abs(F.col("x") - F.col("truth")) > 0.05 * F.col("truth") + 0.5
    return filled.join(truth.select("id", "truth"), "id").select("id", (~F.coalesce(far, F.lit(True))).alias("near"))


def _low_rank_values(name: str, make: Callable[[], object]) -> None:
    def f(s: SparkSession, d: str) -> DataFrame:
        e = _planted(s, d)
        return _near(make().fit_transform(e.select("id", "x")), e)

    query(name, "SELECT p_partkey AS id, true AS near FROM part")(f)


def _low_rank(name: str, make: Callable[[], object]) -> None:
    """Holes must come back far nearer than by the mean: the nuclear norm shrinks what it fits."""

    def f(s: SparkSession, d: str) -> DataFrame:
        e = _planted(s, d)
        both = make().fit_transform(e.select("id", "x")).select("id", F.col("x").alias("y")).join(e, "id").crossJoin(F.broadcast(e.agg(F.avg("x").alias("mean"))))
        return both.agg(
            F.count(F.when(F.col("y").isNull() | (F.col("x").isNotNull() & (F.col("x") != F.col("y"))), 1)).alias("n_wrong"),
            (F.avg(F.when(F.col("x").isNull(), F.abs(F.col("y") - F.col("truth")))) < 0.2 * F.avg(F.when(F.col("x").isNull(), F.abs(F.col("mean") - F.col("truth"))))).alias("recovers"),
        )

    query(name, "SELECT 0::BIGINT AS n_wrong, true AS recovers")(f)


_ROWS = {"order_by": ["id"], "key": ["id"], "columns": ["x"]}
_EXACT = _ROWS | {"rank": 1, "tau": 1e-3, "period": 5, "max_iterations": 12}
_low_rank("impute_rpca_pcp", lambda: lowrank.ImputerRpcaPcp(max_iterations=40, period=5, **_ROWS))
_low_rank_values("impute_rpca_noisy", lambda: lowrank.ImputerRpcaNoisy(lam=100.0, **_EXACT))
_low_rank_values("impute_softimpute", lambda: lowrank.ImputerSoftImpute(**_EXACT))


@query("rpca_noisy_other_rows", "SELECT p_partkey AS id, true AS near FROM part WHERE p_partkey // 5 % 3 = 1")
def rpca_noisy_other_rows(s, d):
    """A basis learned from two thirds of the matrix rows fills the others."""
    wide = {f"c{j}": F.sum(F.when(F.col("id") % 5 == j, F.col("x"))) for j in range(5)}
    lines = _planted(s, d).groupBy(F.floor(F.col("id") / 5).alias("line")).agg(*[v.alias(k) for k, v in wide.items()])
    model = lowrank.ImputerRpcaNoisy(lam=100.0, rank=1, tau=1e-3, columns=list(wide)).fit(lines.where("line % 3 <> 1"))
    cells = model.transform(lines.where("line % 3 = 1")).select("line", F.posexplode(F.array(*wide)).alias("j", "v"))
    ids = (F.col("line") * 5 + F.col("j")).alias("id")
    return _near(cells.select(ids, F.col("v").alias("x")), _planted(s, d))


_numeric("impute_mlp", lambda: neural.ImputerRegressorMLP(epochs=30, **_XU))
_numeric("impute_autoencoder", lambda: neural.ImputerAutoencoder(max_iterations=2, epochs=10, **_XU))
_numeric("impute_ddpm", lambda: neural.ImputerDiffusion(epochs=20, num_noise_steps=10, num_sampling=1, **_XU))
_numeric("impute_ts_ddpm", lambda: neural.ImputerDiffusion(model="TsDDPM", epochs=20, num_noise_steps=10, num_sampling=1, **_XU))

# -- holes --------------------------------------------------------------------

SPEC = Spec.of(["event_id"], ["event_id"], ["g"])
query("hole_run_lengths", f"""WITH {EV}, r AS (SELECT g, x IS NULL AS h, row_number() OVER (PARTITION BY g ORDER BY event_id) - row_number() OVER (PARTITION BY g, x IS NULL ORDER BY event_id) AS i FROM ev),
l AS (SELECT count(*) AS length FROM r WHERE h GROUP BY g, i) SELECT length, count(*) AS n FROM l GROUP BY length""")(lambda s, d: holes.run_lengths(events(s, d), "x", SPEC))
_STATE = f"WITH {EV}, st AS (SELECT g, event_id, (x IS NULL)::BIGINT {{more}} AS state FROM ev), tr AS (SELECT state, coalesce(lead(state) OVER (PARTITION BY g ORDER BY event_id), 0) AS next FROM st UNION ALL SELECT 0, arg_min(state, event_id) FROM st GROUP BY g)"
query("hole_transition_counts", _STATE.format(more="") + " SELECT state, next, count(*) AS n FROM tr GROUP BY 1, 2")(lambda s, d: holes.transition_counts(events(s, d), ["x"], SPEC))
query("hole_transition_probs", _STATE.format(more="") + " SELECT state, next, round(count(*) / sum(count(*)) OVER (PARTITION BY state), 6) AS p FROM tr GROUP BY 1, 2")(
    lambda s, d: holes.transition_matrix(events(s, d), ["x"], SPEC).withColumn("p", r6("p"))
)
query("hole_multi_transition_counts", _STATE.format(more=f"+ 2 * ({HOLE2})::BIGINT") + " SELECT state, next, count(*) AS n FROM tr GROUP BY 1, 2")(
    lambda s, d: holes.transition_counts(events(s, d).withColumn("y", F.when(~F.expr(HOLE2), F.col("value"))), ["x", "y"], SPEC)
)
query("hole_sizes_max", f"""WITH {EV}, r AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY event_id) - row_number() OVER (PARTITION BY g, x IS NULL ORDER BY event_id) AS i FROM ev),
p AS (SELECT *, CASE WHEN x IS NULL THEN 0 ELSE row_number() OVER (PARTITION BY g, x IS NULL, i ORDER BY event_id) - 1 END AS pos FROM r)
SELECT event_id, coalesce(lag(pos) OVER (PARTITION BY g ORDER BY event_id), 0) AS size_max FROM p""")(lambda s, d: holes.sizes_max(events(s, d), "x", SPEC).select("event_id", "size_max"))
query("mask_patterns", f"WITH {EV} SELECT (x IS NULL)::BIGINT + 2 * ({HOLE2})::BIGINT AS p, count(*) AS n FROM ev GROUP BY 1")(
    lambda s, d: events(s, d).withColumn("y", F.when(~F.expr(HOLE2), F.col("value"))).groupBy(pattern(["x", "y"]).alias("p")).agg(F.count(F.lit(1)).alias("n"))
)


def _masks(name: str, make: Callable[[], holes.HoleGenerator], slack: int) -> None:
    """A generator held to its contract: the share of cells, none of them missing, the same again, folds that differ."""

    def f(s: SparkSession, d: str) -> DataFrame:
        e = events(s, d).select("event_id", "g", "x")
        m = make().split(e)
        again = make().split(e).select("event_id", "fold", F.col("m_x").alias("m2"))
        n = F.sum(F.col("m_x").cast("long"))
        per = m.join(again, ["event_id", "fold"]).groupBy("fold").agg(n.alias("k"), F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("m_x") & F.col("x").isNull(), 1)).alias("bad"), F.count(F.when(F.col("m_x") != F.col("m2"), 1)).alias("other"))
        return per.agg(F.sum("n").alias("n_rows"), F.sum("bad").alias("n_on_missing"), F.sum("other").alias("n_not_reproduced"), F.count(F.when(F.abs(F.col("k") - F.ceil(F.col("n") * 0.1)) > F.col("n") * slack / 100, 1)).alias("n_off_ratio"))

    query(name, "SELECT (2 * count(*))::BIGINT AS n_rows, 0::BIGINT AS n_on_missing, 0::BIGINT AS n_not_reproduced, 0::BIGINT AS n_off_ratio FROM events")(f)


_GEN = {"n_splits": 2, "subset": ["x"], "ratio_masked": 0.1, "order_by": ["event_id"], "key": ["event_id"], "groups": ["g"]}
_masks("holes_uniform_hash", lambda: holes.UniformHoleGenerator(**_GEN), 0)
_masks("holes_geometric", lambda: holes.GeometricHoleGenerator(**_GEN), 2)
_masks("holes_empirical", lambda: holes.EmpiricalHoleGenerator(**_GEN), 2)
_masks("holes_multimarkov", lambda: holes.MultiMarkovHoleGenerator(**_GEN), 2)


@query("holes_grouped", "SELECT 2::BIGINT AS n_folds, 0::BIGINT AS n_partly, 0::BIGINT AS n_without, 0::BIGINT AS n_not_nearest")
def holes_grouped(s, d):
    """Groups are hidden whole or not at all, at least one a fold, and no other end of the fold's own order is nearer to the ratio."""
    e = events(s, d).select("event_id", "g", "x")
    by = holes.GroupedHoleGenerator(**_GEN).split(e).groupBy("fold", "g").agg(F.count(F.lit(1)).alias("n"), F.count("x").alias("seen"), F.sum(F.col("m_x").cast("long")).alias("hidden"))
    w = Window.partitionBy("fold")
    by = by.withColumns({"all": F.sum("n").over(w), "upto": F.sum(F.when(F.col("hidden") > 0, F.col("n")).otherwise(0)).over(w), "least": F.min(F.when(F.col("hidden") > 0, F.col("n"))).over(w)})
    far = lambda n: F.abs(n / F.col("all") - 0.1)
    per = by.groupBy("fold").agg(
        F.count(F.when((F.col("hidden") > 0) & (F.col("hidden") < F.col("seen")), 1)).alias("partly"), F.sum("hidden").alias("hidden"),
        F.max(((F.col("upto") > F.col("least")) & (far(F.col("upto")) > far(F.col("least")))).cast("int")).alias("off"),
    )
    return per.agg(F.count(F.lit(1)).alias("n_folds"), F.sum("partly").alias("n_partly"), F.count(F.when(F.col("hidden") == 0, 1)).alias("n_without"), F.sum("off").cast("long").alias("n_not_nearest"))


# -- metrics ------------------------------------------------------------------


def scored(s: SparkSession, d: str) -> DataFrame:
    """Truth x, imputed x by the group's mean of what is seen, mask."""
    e = events(s, d)
    return e.select("event_id", "g", F.col("value").alias("x"), F.coalesce("x", F.avg("x").over(Window.partitionBy("g")) + F.col("event_id") % 7).alias("x_imputed"), "m_x")


SC = f"{EV}, sc AS (SELECT event_id, g, value AS x, coalesce(x, avg(x) OVER (PARTITION BY g) + event_id % 7) AS y, m_x FROM ev), mk AS (SELECT * FROM sc WHERE m_x)"
for _n, _e in (("mse", "avg((x-y)*(x-y))"), ("rmse", "sqrt(avg((x-y)*(x-y)))"), ("mae", "avg(abs(x-y))"), ("mape", "avg(abs(x-y)/greatest(abs(x),2.220446049250313e-16))"), ("wmape", "sum(abs(x-y))/sum(abs(x))"), ("accuracy", "avg((x=y)::DOUBLE)")):
    query(f"metric_{_n}", f"WITH {SC} SELECT g, round({_e}, 6) AS v FROM mk GROUP BY g")(lambda s, d, n=_n: metrics.long_scores(scored(s, d), ["x"], [n], ["g"]).select("g", r6("value").alias("v")))
_by_g = lambda f: lambda s, d: f(scored(s, d), "x", ["g"]).select("g", r6("value").alias("v"))
query("metric_wasserstein", f"WITH {SC}, a AS (SELECT g, x, row_number() OVER (PARTITION BY g ORDER BY x) r FROM mk), b AS (SELECT g, y, row_number() OVER (PARTITION BY g ORDER BY y) r FROM mk) SELECT g, round(avg(abs(x - y)), 6) AS v FROM a JOIN b USING (g, r) GROUP BY g")(_by_g(metrics.wasserstein))
query("metric_ks", f"WITH {SC}, u AS (SELECT g, x AS v, 1 AS s FROM mk UNION ALL SELECT g, y, -1 FROM mk), c AS (SELECT g, v, sum(s) AS s FROM u GROUP BY 1, 2), r AS (SELECT g, abs(sum(s) OVER (PARTITION BY g ORDER BY v)) AS k FROM c) SELECT g, round(max(k) / (SELECT count(*) FROM mk WHERE mk.g = r.g), 6) AS v FROM r GROUP BY g")(_by_g(metrics.ks))
query("metric_kl_hist", f"""WITH {SC}, u AS (SELECT g, x AS v, 1 AS s FROM mk UNION ALL SELECT g, y, 0 FROM mk), r AS (SELECT g, min(v) lo, (max(v) - min(v)) / 19 w FROM u GROUP BY g),
b AS (SELECT g, least(floor((v - lo) / w), 18) AS k, sum(s)::DOUBLE AS a, sum(1 - s)::DOUBLE AS c, max(w) AS w FROM u JOIN r USING (g) GROUP BY 1, 2), p AS (SELECT g, a / sum(a) OVER (PARTITION BY g) + 2.220446049250313e-16 * w AS p, c / sum(c) OVER (PARTITION BY g) + 2.220446049250313e-16 * w AS q FROM b)
SELECT g, round(sum(p * ln(p / q)), 6) AS v FROM p GROUP BY g""")(_by_g(metrics.kl_histogram))
query("metric_energy", f"""WITH {SC}, u AS (SELECT g, x AS v, 1 AS s FROM mk UNION ALL SELECT g, y, 0 FROM mk), r AS (SELECT g, v, 2 * row_number() OVER (PARTITION BY g ORDER BY v) - count(*) OVER (PARTITION BY g) - 1 AS a, 2 * row_number() OVER (PARTITION BY g, s ORDER BY v) - count(*) OVER (PARTITION BY g, s) - 1 AS o FROM u)
SELECT g, round(2 * sum(a * v) - 4 * sum(o * v), 3) AS v FROM r GROUP BY g""")(lambda s, d: metrics.energy(scored(s, d), "x", ["g"]).select("g", (F.round("value", 3) + 0.0).alias("v")))
query("metric_pairwise_l1", f"WITH {SC}, m AS (SELECT * FROM mk) SELECT a.g, round(sum(abs(a.x - b.y)), 3) AS v FROM m a JOIN m b ON a.g = b.g GROUP BY a.g")(
    lambda s, d: metrics.pairwise_l1(scored(s, d), ["x"], ["g"]).select("g", (F.round("value", 3) + 0.0).alias("v"))
)


def _categories(s: SparkSession, d: str) -> DataFrame:
    e = events(s, d)
    return e.select("event_id", F.col("g").alias("x"), F.when((F.col("event_id") * 31) % 10 < 6, F.col("g")).otherwise("view").alias("x_imputed"), "m_x", F.col("value").alias("v"), F.col("value").alias("v_imputed"), F.col("m_x").alias("m_v"))


CAT = f"{EV}, ct AS (SELECT g AS x, CASE WHEN (event_id * 31) % 10 < 6 THEN g ELSE 'view' END AS y, value AS v FROM ev WHERE m_x)"
query("metric_tvd", f"WITH {CAT}, u AS (SELECT x AS k, 1 AS s FROM ct UNION ALL SELECT y, -1 FROM ct), c AS (SELECT k, abs(sum(s)) AS d FROM u GROUP BY k) SELECT round(sum(d) / (SELECT count(*) FROM ct), 6) AS v FROM c")(
    lambda s, d: metrics.total_variation(_categories(s, d), "x").select(r6("value").alias("v"))
)
_F = """(SELECT ((sum(s * s / n) - sum(s) * sum(s) / sum(n)) / (count(*) - 1)) / ((sum(q) - sum(s * s / n)) / (sum(n) - count(*)))
 FROM (SELECT count(*)::DOUBLE AS n, sum({v}) AS s, sum({v} * {v}) AS q FROM c2 GROUP BY {a}))"""
_CHI2 = """(SELECT any_value(t) * sum(n * n / (na * nb)) - any_value(t) FROM (SELECT n, sum(n) OVER (PARTITION BY a) AS na, sum(n) OVER (PARTITION BY b) AS nb, sum(n) OVER () AS t
 FROM (SELECT {a} AS a, {b} AS b, count(*)::DOUBLE AS n FROM c2 GROUP BY 1, 2)))"""
C2 = f"{EV}, c2 AS (SELECT g AS x, CASE WHEN (event_id * 31) % 10 < 6 THEN g ELSE 'view' END AS xi, user_id % 3 AS y, CASE WHEN (event_id * 17) % 10 < 7 THEN user_id % 3 ELSE 0 END AS yi, value AS v, value * 0.5 + event_id % 11 AS vi FROM ev WHERE m_x)"


def _mixed(s: SparkSession, d: str) -> DataFrame:
    i, y = F.col("event_id"), (F.col("user_id") % 3).cast("string")
    return events(s, d).select(
        F.col("g").alias("x"), F.when((i * 31) % 10 < 6, F.col("g")).otherwise("view").alias("x_imputed"), y.alias("y"), F.when((i * 17) % 10 < 7, y).otherwise("0").alias("y_imputed"),
        F.col("value").alias("v"), (F.col("value") * 0.5 + i % 11).alias("v_imputed"), "m_x", F.col("m_x").alias("m_y"), F.col("m_x").alias("m_v"),
    )


query("metric_anova_f", f"WITH {C2} SELECT round(abs({_F.format(a='x', v='v')} - {_F.format(a='xi', v='vi')}), 5) AS f")(
    lambda s, d: s.createDataFrame([(round(metrics.mixed_difference(_mixed(s, d), ["x"], ["v"], False)["x"], 5),)], "f double")
)
query("metric_chi2_stat", f"WITH {C2} SELECT round((abs({_CHI2.format(a='x', b='x')} - {_CHI2.format(a='xi', b='xi')}) + abs({_CHI2.format(a='x', b='y')} - {_CHI2.format(a='xi', b='yi')})) / 2, 5) AS chi2")(
    lambda s, d: s.createDataFrame([(round(metrics.categorical_difference(_mixed(s, d), ["x", "y"], False)["x"], 5),)], "chi2 double")
)


def _two(s: SparkSession, d: str) -> DataFrame:
    e = events(s, d)
    return e.select("event_id", F.col("value").alias("a"), (F.col("value") * 0.5 + F.col("event_id") % 11).alias("a_imputed"), F.col("user_id").cast("double").alias("b"), (F.col("user_id") + F.col("event_id") % 13).cast("double").alias("b_imputed"), F.col("m_x").alias("m_a"), F.col("m_x").alias("m_b"))


TWO = f"{EV}, tw AS (SELECT value AS a, value * 0.5 + event_id % 11 AS ai, user_id::DOUBLE AS b, (user_id + event_id % 13)::DOUBLE AS bi FROM ev WHERE m_x)"
query("metric_corr_diff_r", f"WITH {TWO} SELECT round(abs(corr(a, b) - corr(ai, bi)) / 2, 6) AS v FROM tw")(
    lambda s, d: s.createDataFrame([(round(metrics.correlation_difference(_two(s, d), ["a", "b"], False)["a"], 6),)], "v double")
)
query("metric_kl_gauss_1d", f"WITH {TWO} SELECT round(0.5 * (var_samp(a) / var_samp(ai) + (avg(ai) - avg(a)) * (avg(ai) - avg(a)) / var_samp(ai) - 1 + ln(var_samp(ai) / var_samp(a))), 6) AS v FROM tw")(
    lambda s, d: s.createDataFrame([(round(metrics.kl_gaussian(_two(s, d), ["a"]), 6),)], "v double")
)
query("metric_frechet_1d", f"WITH {TWO}, u AS (SELECT a AS v FROM tw UNION ALL SELECT ai FROM tw), sd AS (SELECT stddev_samp(v) AS s FROM u) SELECT round(((avg(a) - avg(ai)) * (avg(a) - avg(ai)) + (stddev_samp(a) - stddev_samp(ai)) * (stddev_samp(a) - stddev_samp(ai))) / any_value(s * s), 6) AS v FROM tw, sd")(
    lambda s, d: s.createDataFrame([(round(metrics.frechet(_two(s, d), ["a"]), 6),)], "v double")
)

# -- selection, tests, preprocessing, features ----------------------------------


@query("comparator_table", f"WITH {EV}, w AS (SELECT value, m_x, avg(x) OVER (PARTITION BY g) AS a, median(x) OVER (PARTITION BY g) AS b FROM ev) SELECT 'mae' AS metric, round(avg(abs(value - a)), 6) AS mean, round(avg(abs(value - b)), 6) AS median FROM w WHERE m_x")
def comparator_table(s, d):
    class Fixed(holes.HoleGenerator):
        def mask(self, df, columns, fold):
            return df.withColumn("m_x", F.expr(HOLE))

    e = read(s, d, "events").select("event_id", F.col("event_type").alias("g"), F.col("value").alias("x"))
    models = {k: simple.ImputerSimple(strategy=k, **BY) for k in ("mean", "median")}
    table = Comparator(models, Fixed(subset=["x"]), ["mae"]).compare(e)
    return table.select("metric", r6("mean").alias("mean"), r6("median").alias("median"))


@query("search_improves", "SELECT true AS near_best")
def search_improves(s, d):
    """The best constant fill by absolute error is the median: the search must come within a twentieth of its error."""
    e = read(s, d, "events").select("event_id", F.col("value").alias("x")).withColumns({"m_x": F.expr(HOLE), "fold": F.lit(0)})
    f = objective_of(simple.ImputerSimple(strategy="constant", key=["event_id"], columns=["x"]), e, ["x"], "mae")
    best = minimize(lambda p: f(p), {"fill_value": ("uniform", 0.0, 200.0)}, 25)[1]
    median = e.where("m_x").agg(F.median("x")).first()[0]
    return s.createDataFrame([(best <= 1.05 * f({"fill_value": median}),)], "near_best boolean")


@query("little_d2_monotone", """WITH p AS (SELECT p_size::DOUBLE AS a, CASE WHEN (p_partkey * 7919 + 104729) % 1000 < 150 THEN NULL ELSE p_retailprice / 100 END AS b FROM part),
o AS (SELECT regr_slope(b, a) AS m, regr_intercept(b, a) AS k, var_pop(b) AS vb, var_pop(a) AS va, covar_pop(a, b) AS cab FROM p WHERE b IS NOT NULL),
e AS (SELECT avg(a) AS ma, var_pop(a) AS va, count(*)::DOUBLE AS n FROM p), f AS (SELECT ma, k + m * ma AS mb, e.va * n / (n - 1) AS saa, m * e.va * n / (n - 1) AS sab, (vb - m * m * o.va + m * m * e.va) * n / (n - 1) AS sbb FROM o, e),
g AS (SELECT b IS NULL AS h, count(*)::DOUBLE AS n, avg(a) AS xa, avg(b) AS xb FROM p GROUP BY 1)
SELECT round(sum(CASE WHEN h THEN g.n * (xa - ma) * (xa - ma) / saa ELSE g.n * ((xa - ma) * (xa - ma) * sbb - 2 * (xa - ma) * (xb - mb) * sab + (xb - mb) * (xb - mb) * saa) / (saa * sbb - sab * sab) END), 4) AS d2 FROM g, f""")
def little(s, d):
    p = read(s, d, "part").select(F.col("p_size").cast("double").alias("a"), F.when(~F.expr("(p_partkey * 7919 + 104729) % 1000 < 150"), F.col("p_retailprice") / 100).alias("b"))
    return s.createDataFrame([(round(mcar.LittleTest(max_iter=2000, tolerance=1e-12).statistic(p)[0], 4),)], "d2 double")


@query("little_decision", "SELECT true AS accepts_mcar, true AS rejects_mar")
def little_decision(s, d):
    e = read(s, d, "events").select(F.col("value").alias("a"), (F.col("value") * 0.3 + F.col("user_id")).alias("b"), "event_id")
    free = e.select("a", F.when(~F.expr(HOLE), F.col("b")).alias("b"))
    tied = e.select("a", F.when(F.col("a") < median(e, "a"), F.col("b")).alias("b"))
    return s.createDataFrame([(mcar.LittleTest().test(free) > 0.01, mcar.LittleTest().test(tied) < 0.01)], "accepts_mcar boolean, rejects_mar boolean")


@query("pklm_decision", "SELECT true AS rejects_mar, true AS accepts_mcar")
def pklm_decision(s, d):
    """Default trees, projections and permutations: holes told by another column are rejected, holes by an integer hash are not."""
    e = read(s, d, "customer").select(F.col("c_acctbal").cast("double").alias("a"), F.col("c_nationkey").cast("double").alias("b"), "c_custkey")
    tied = e.select("a", F.when(F.col("a") < median(e, "a"), F.col("b")).alias("b"))
    free = e.select("a", F.when((F.col("c_custkey") * 7919 + 104729) % 1000 >= 300, F.col("b")).alias("b"))
    test = mcar.PKLMTest()
    return s.createDataFrame([(test.test(tied) < 0.05, test.test(free) > 0.05)], "rejects_mar boolean, accepts_mcar boolean")


@query("pklm_blocks", "SELECT 0.0::DOUBLE AS gap, 9::BIGINT AS n")
def pklm_blocks(s, d):
    """Forests grown over blocks of rows have the statistics of forests grown on the whole table: the largest gap, and how many."""
    c = read(s, d, "customer").select(F.col("c_acctbal").cast("double").alias("a"), F.col("c_nationkey").cast("double").alias("b"), F.col("c_custkey").cast("double").alias("c"))
    c = c.select(F.when(F.col("c") % 7 != 3, F.col("a")).alias("a"), F.when(F.col("a") < 5000, F.col("b")).alias("b"), F.when(F.col("c") % 5 != 2, F.col("c")).alias("c"))
    many = max(60, c.count() // 4)
    whole, blocks = (mcar.PKLMTest(nb_permutation=1, nb_trees_per_proj=20, block_rows=r).statistics(c)[:, 0] for r in (10**7, many))
    return s.createDataFrame([(round(float(abs(whole - blocks).max()), 6) + 0.0, len(whole))], "gap double, n long")


_DISTANCES = """SELECT '{kind}' AS kind, round((1 - sqrt(greatest(ab, 0) / sqrt(aa * bb))) / 2, 6) + 0.0 AS v FROM (
 SELECT any_value(mab) / any_value(n * n) + sum(a) * sum(b) / any_value(n * n * n * n) - 2 * sum(a * b) / any_value(n * n * n) AS ab, any_value(maa) / any_value(n * n) + sum(a) * sum(a) / any_value(n * n * n * n) - 2 * sum(a * a) / any_value(n * n * n) AS aa,
 any_value(mbb) / any_value(n * n) + sum(b) * sum(b) / any_value(n * n * n * n) - 2 * sum(b * b) / any_value(n * n * n) AS bb FROM (
 SELECT i, sum(dx) AS a, sum(dy) AS b, sum(sum(dx * dy)) OVER () AS mab, sum(sum(dx * dx)) OVER () AS maa, sum(sum(dy * dy)) OVER () AS mbb, (count(*) OVER ())::DOUBLE AS n FROM (
 SELECT p.i, {dx} AS dx, {dy} AS dy FROM t_{kind} p, t_{kind} q) GROUP BY i))"""


@query(
    "metric_distance_correlation",
    "WITH t_line AS (SELECT p_partkey AS i, p_size::DOUBLE AS x, p_retailprice::DOUBLE AS y FROM part), t_tiles AS (SELECT s_suppkey AS i, s_acctbal::DOUBLE AS x, s_nationkey::DOUBLE AS x2, (s_suppkey % 11)::DOUBLE AS y, s_acctbal::DOUBLE AS y2 FROM supplier) "
    + _DISTANCES.format(kind="line", dx="abs(p.x - q.x)", dy="abs(p.y - q.y)")
    + " UNION ALL "
    + _DISTANCES.format(kind="tiles", dx="sqrt((p.x - q.x) ** 2 + (p.x2 - q.x2) ** 2)", dy="sqrt((p.y - q.y) ** 2 + (p.y2 - q.y2) ** 2)"),
)
def metric_distance_correlation(s, d):
    """One column a side by rank blocks, two by tiles; blocks small enough that there are several."""
    line = distances.distance_anticorrelation(read(s, d, "part"), ["p_size"], ["p_retailprice"], 500)
    supplier = read(s, d, "supplier").select("s_acctbal", "s_nationkey", (F.col("s_suppkey") % 11).alias("r"), F.col("s_acctbal").alias("again"))
    tiles = distances.distance_anticorrelation(supplier, ["s_acctbal", "s_nationkey"], ["r", "again"], 40)
    return s.createDataFrame([("line", round(line, 6) + 0.0), ("tiles", round(tiles, 6) + 0.0)], "kind string, v double")


@query("bins_snap", "WITH k AS (SELECT DISTINCT (10 * p_size)::DOUBLE AS v FROM part), q AS (SELECT event_id, value AS x FROM events), n AS (SELECT event_id, x, v, row_number() OVER (PARTITION BY event_id ORDER BY abs(x - v), v DESC) AS r FROM q, k) SELECT event_id, v AS x FROM n WHERE r = 1")
def bins_snap(s, d):
    known = read(s, d, "part").select((F.col("p_size") * 10).cast("double").alias("x"))
    return preprocessing.BinTransformer(["x"]).fit(known).transform(read(s, d, "events").select("event_id", F.col("value").alias("x")))


@query("onehot", "SELECT event_id, event_type AS g, (event_type = 'view')::DOUBLE AS is_view FROM events")
def onehot(s, d):
    e = read(s, d, "events").select("event_id", F.col("event_type").alias("g"))
    o = preprocessing.OneHot(["g"]).fit(e)
    wide = o.transform(e)
    return o.reverse(wide.withColumn("is_view", F.col("`g=view`"))).select("event_id", "g", "is_view")


query("feature_station", "SELECT event_id, (event_type = 'click')::DOUBLE AS f FROM events")(lambda s, d: datasets.add_station_features(read(s, d, "events"), "event_type").select("event_id", F.col("`event_type=click`").alias("f")))
query("feature_datetime", """SELECT o_orderkey, round(cos(dayofyear(o_orderdate) * 2 * pi() / CASE WHEN (year(o_orderdate) % 4 = 0 AND year(o_orderdate) % 100 <> 0) OR year(o_orderdate) % 400 = 0 THEN 366 ELSE 365 END), 6) + 0.0 AS time_cos,
 round(sin(dayofyear(o_orderdate) * 2 * pi() / CASE WHEN (year(o_orderdate) % 4 = 0 AND year(o_orderdate) % 100 <> 0) OR year(o_orderdate) % 400 = 0 THEN 366 ELSE 365 END), 6) + 0.0 AS time_sin FROM orders""")(
    lambda s, d: datasets.add_datetime_features(read(s, d, "orders"), "o_orderdate").select("o_orderkey", r6("time_cos").alias("time_cos"), r6("time_sin").alias("time_sin"))
)
query("acf", f"WITH {DAYS}, l AS (SELECT value, " + ", ".join(f"lag(value, {k}) OVER (ORDER BY event_id) AS l{k}" for k in range(1, 5)) + " FROM days) " + " UNION ALL ".join(f"SELECT {k}::BIGINT AS lag, round(corr(value, l{k}), 6) AS r FROM l" for k in range(1, 5)))(
    lambda s, d: series.acf(_days(s, d), "value", Spec.of(["event_id"]), 5).where("lag > 0").select("lag", r6("r").alias("r"))
)


@query("lag_matrix_gram", f"WITH {DAYS}, l AS (SELECT value AS y, lag(value, 1) OVER w AS z1, lag(value, 2) OVER w AS z2 FROM days WINDOW w AS (ORDER BY event_id)) SELECT count(*) AS n, round(sum(z1 * z1) / 1e6, 3) AS z11, round(sum(z1 * z2) / 1e6, 3) AS z12, round(sum(z1 * y) / 1e6, 3) AS z1y FROM l WHERE z2 IS NOT NULL")
def lag_gram(s, d):
    z = series.lag_table(_days(s, d), "value", Spec.of(["event_id"]), 2)
    return z.agg(F.count(F.lit(1)).alias("n"), *[(F.round(F.sum(F.col(a) * F.col(b)) / 1e6, 3) + 0.0).alias(k) for k, a, b in (("z11", "z1", "z1"), ("z12", "z1", "z2"), ("z1y", "z1", "y"))])


@query("nan_mean_cov", f"WITH {EV}, m AS (SELECT avg(x) AS mx, avg(CASE WHEN NOT ({HOLE2}) THEN user_id END) AS my FROM ev) SELECT round(sum((x - mx) * (user_id - my)) / (count(*) - 1), 5) AS c FROM ev, m WHERE x IS NOT NULL AND NOT ({HOLE2})")
def nan_cov(s, d):
    e = events(s, d).select("x", F.when(~F.expr(HOLE2), F.col("user_id").cast("double")).alias("y"))
    return s.createDataFrame([(round(float(series.nan_mean_cov(e, ["x", "y"])[1][0, 1]), 5),)], "c double")


@query("fold_signal", f"WITH {DAYS}, r AS (SELECT value, row_number() OVER (ORDER BY event_id) - 1 AS i FROM days) SELECT i // 7 AS row, i % 7 AS col, round(value, 6) AS v FROM r")
def fold_signal(s, d):
    return series.folded(_days(s, d), "value", Spec.of(["event_id"]), 7).withColumn("v", r6("v"))


query("topk_groups", "WITH g AS (SELECT user_id FROM events GROUP BY user_id ORDER BY avg(value) DESC, user_id LIMIT 5) SELECT event_id, user_id FROM events WHERE user_id IN (FROM g)")(
    lambda s, d: datasets.top_groups(read(s, d, "events"), "user_id", "value", 5).select("event_id", "user_id")
)
query("daily_resample", "SELECT event_type, date_trunc('day', ts)::TIMESTAMP AS date, round(avg(value), 6) AS value FROM events GROUP BY 1, 2")(
    lambda s, d: datasets.daily(
        read(s, d, "events").select("event_type", "value", F.year("ts").alias("year"), F.month("ts").alias("month"), F.day("ts").alias("day"), F.hour("ts").alias("hour")), ["value"], ["event_type"]
    ).select("event_type", "date", r6("value").alias("value"))
)
