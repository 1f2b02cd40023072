"""Mixture proportions and training curves."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandwise.catalog import query, views as V
from strandwise.operators import mixture as X, runs
from strandwise.plans.reports import tumour_purity

N = 200
MARGINS = (0.6, 0.4)
PAIR_SQL = f"SELECT read_id, dmr_ctype, a / (a + b) / 0.6 AS x, b / (a + b) / 0.4 AS y FROM (SELECT read_id, dmr_ctype, probs[1] AS a, probs[2] AS b FROM ({V.PROBS_SQL}) p) q"


def _pair(spark, sf):
    """The first two classes as normal and type."""
    a, b = F.get("probs", F.lit(0)), F.get("probs", F.lit(1))
    return V.scored(spark, sf).select("read_id", "dmr_ctype", (a / (a + b)).alias("p_n"), (b / (a + b)).alias("p_t"))


def _curve_sql(by: str) -> str:
    keys = f"{by}, " if by else ""
    part = f"PARTITION BY {by}" if by else ""
    return f"""
c AS (SELECT {keys}g, sum(ln((1 - g / {N}) * x + g / {N} * y)) AS ll FROM ({PAIR_SQL}) p, (SELECT unnest(range(0, {N})) AS g) i GROUP BY {keys}g),
d AS (SELECT *, ll - lag(ll) OVER ({part} ORDER BY g) AS step FROM c)"""


@query("mixture_curve", f"WITH {_curve_sql('')} SELECT CAST(g AS INT) AS grid, round(ll, 6) AS loglik FROM c")
def mixture_curve(spark, sf):
    return X.mixture_curve(_pair(spark, sf), MARGINS, N).withColumn("loglik", F.round("loglik", 6))


@query("mixture_grid", f"WITH {_curve_sql('')} SELECT round(arg_min(g, [-ll, g]) / {N}, 6) AS purity, round(var_pop(step), 8) AS fi, round(max(ll), 6) AS loglik FROM d")
def mixture_grid(spark, sf):
    g = X.mixture_grid(_pair(spark, sf), MARGINS, N)
    return g.select(F.round("purity", 6).alias("purity"), F.round("fi", 8).alias("fi"), F.round("loglik", 6).alias("loglik"))


BY_REGION_SQL = f"WITH {_curve_sql('dmr_ctype')} SELECT dmr_ctype, arg_min(g, [-ll, g]) / {N} AS purity, var_pop(step) AS fi, max(ll) AS loglik FROM d GROUP BY dmr_ctype"


@query("mixture_grid_by_region", f"SELECT dmr_ctype, round(purity, 6) AS purity, round(fi, 8) AS fi, round(loglik, 6) AS loglik FROM ({BY_REGION_SQL}) b")
def mixture_grid_by_region(spark, sf):
    g = X.mixture_grid_by_region(_pair(spark, sf), MARGINS, N, region="dmr_ctype")
    return g.select("dmr_ctype", F.round("purity", 6).alias("purity"), F.round("fi", 8).alias("fi"), F.round("loglik", 6).alias("loglik"))


@query("mean_purity", f"SELECT count(*) AS n_regions, round(greatest(least(avg(purity), 1.0), 0.0), 6) AS purity FROM ({BY_REGION_SQL}) b")
def mean_purity(spark, sf):
    g = X.mean_purity(X.mixture_grid_by_region(_pair(spark, sf), MARGINS, N, region="dmr_ctype"))
    return g.withColumn("purity", F.round("purity", 6))


def _proportions_sql(reads: str) -> str:
    """Shares from ``reads(cell_type, m, p)``: a multiplier is halved in on until the shares whose slopes equal it add up to 1."""
    slope = "list_sum(list_transform(x.a, lambda r, i: x.d[i] / (r + (b.lo + b.hi) / 2 * x.d[i])))"
    share = lambda level: f"""list_reduce(list_transform(range(60), lambda i: {{'lo': 1e-10::DOUBLE, 'hi': (1 - 1e-10)::DOUBLE}}),
 lambda b, _: CASE WHEN {slope} > {level} THEN {{'lo': (b.lo + b.hi) / 2, 'hi': b.hi}} ELSE {{'lo': b.lo, 'hi': (b.lo + b.hi) / 2}} END).lo"""  # noqa: E731
    return f"""
reads AS ({reads}),
parts AS (SELECT cell_type, (1 - p) / (1 - m) AS a, p / m - (1 - p) / (1 - m) AS d FROM reads),
types AS (SELECT list({{'t': cell_type, 'a': a, 'd': d}} ORDER BY cell_type) AS ts FROM (SELECT cell_type, list(a) AS a, list(d) AS d FROM parts GROUP BY cell_type) g),
level AS (SELECT ts, list_reduce(list_transform(range(110), lambda i: {{'lo': -1e9::DOUBLE, 'hi': 1e9::DOUBLE}}),
 lambda s, _: CASE WHEN list_sum(list_transform(ts, lambda x: {share('(s.lo + s.hi) / 2')})) > 1 THEN {{'lo': (s.lo + s.hi) / 2, 'hi': s.hi}} ELSE {{'lo': s.lo, 'hi': (s.lo + s.hi) / 2}} END).lo AS multiplier FROM types),
shares AS (SELECT unnest(list_transform(ts, lambda x: {{'cell_type': x.t, 'share': {share('multiplier')}}})) AS r FROM level)"""


TYPES_SQL = "(SELECT unnest(['T0', 'T1', 'T2', 'T3']) AS cell_type, unnest([0.2, 0.3, 0.3, 0.2]) AS m)"


@query("mixture_proportions", f"""
WITH {_proportions_sql(f"SELECT cell_type, m, probs[2] AS p FROM ({V.PROBS_SQL}) p JOIN {TYPES_SQL} t ON t.cell_type = p.dmr_ctype")}
SELECT r.cell_type AS cell_type, round(r.share / sum(r.share) OVER (), 6) AS pred, true AS converged FROM shares""")
def mixture_proportions(spark, sf):
    rows = V.scored(spark, sf).select("dmr_ctype", F.get("probs", F.lit(1)).alias("p_ctype"))
    found = X.mixture_proportions(rows, {"T0": 0.2, "T1": 0.3, "T2": 0.3, "T3": 0.2})
    return found.withColumn("pred", F.round("pred", 6))


@query("tumour_purity_many", f"""
WITH margins AS (SELECT 'T' || CAST(label AS VARCHAR) AS cell_type, CAST(count(*) AS DOUBLE) / sum(count(*)) OVER () AS m FROM embeddings GROUP BY label),
named AS (SELECT *, row_number() OVER (ORDER BY cell_type) - 1 AS place FROM margins),
{_proportions_sql(f"SELECT cell_type, m, probs[true_label + 1] AS p FROM ({V.PROBS_SQL}) p JOIN named ON place = true_label WHERE read_id % 7 <> 0")}
SELECT r.cell_type AS cell_type, round(r.share / sum(r.share) OVER (), 6) AS pred, true AS converged FROM shares""")
def tumour_purity_many(spark, sf):
    """Shares of all classes; a read speaks for its own class, every seventh holds no call."""
    rows = V.scored(spark, sf).withColumn("methyl_seq", F.when(F.col("read_id") % 7 == 0, "222").otherwise("212"))
    train = V.table(spark, sf, "embeddings").select(F.concat(F.lit("T"), F.col("label").cast("string")).alias("ctype"))
    return tumour_purity(rows, train).withColumn("pred", F.round("pred", 6))


@query("skewness_purity")
def skewness_purity(spark, sf):
    """Region weights by descent: the tests compare it with a dense solver on small fixtures."""
    rows = _pair(spark, sf).withColumn("dmr_label", F.col("read_id") % 23)
    found = X.skewness_purity(X.mixture_grid_by_region(rows, MARGINS, N))
    return found.select("n_regions", F.round("purity", 6).alias("purity"), "converged")


@query("tumour_purity", f"""
WITH m AS (SELECT CAST(count(*) FILTER (label % 3 <> 0) AS DOUBLE) / count(*) AS mn, CAST(count(*) FILTER (label % 3 = 0) AS DOUBLE) / count(*) AS mt FROM embeddings),
p AS (SELECT a / (a + b) AS x, b / (a + b) AS y FROM (SELECT probs[1] AS a, probs[2] AS b FROM ({V.PROBS_SQL}) p WHERE read_id % 7 <> 0) q),
c AS (SELECT g, sum(ln((1 - g / {N}) * x / mn + g / {N} * y / mt)) AS ll FROM p, m, (SELECT unnest(range(0, {N})) AS g) i GROUP BY g),
b AS (SELECT arg_min(g, [-ll, g]) / {N} AS pred FROM c)
SELECT 'T' AS cell_type, round(pred, 6) AS pred FROM b UNION ALL SELECT 'N', round(1 - pred, 6) FROM b""")
def tumour_purity_query(spark, sf):
    """Every seventh read holds no call and is left out."""
    a, b = F.get("probs", F.lit(0)), F.get("probs", F.lit(1))
    rows = V.scored(spark, sf).select(
        "read_id", "true_label", F.array(a / (a + b), b / (a + b)).alias("probs"),
        F.when(F.col("read_id") % 7 == 0, "222").otherwise("212").alias("methyl_seq"),
    )
    train = V.table(spark, sf, "embeddings").select(F.when(F.col("label") % 3 == 0, "T").otherwise("N").alias("ctype"))
    return tumour_purity(rows, train, N).withColumn("pred", F.round("pred", 6))


@query("tumour_purity_by_region", f"""
WITH m AS (SELECT CAST(count(*) FILTER (label % 3 <> 0) AS DOUBLE) / count(*) AS mn, CAST(count(*) FILTER (label % 3 = 0) AS DOUBLE) / count(*) AS mt FROM embeddings),
p AS (SELECT read_id % 5 AS region, a / (a + b) AS x, b / (a + b) AS y FROM (SELECT read_id, probs[1] AS a, probs[2] AS b FROM ({V.PROBS_SQL}) p WHERE read_id % 7 <> 0) q),
c AS (SELECT region, g, sum(ln((1 - g / {N}) * x / mn + g / {N} * y / mt)) AS ll FROM p, m, (SELECT unnest(range(0, {N})) AS g) i GROUP BY region, g),
b AS (SELECT avg(pred) AS pred FROM (SELECT arg_min(g, [-ll, g]) / {N} AS pred FROM c GROUP BY region) r)
SELECT 'T' AS cell_type, round(pred, 6) AS pred FROM b UNION ALL SELECT 'N', round(1 - pred, 6) FROM b""")
def tumour_purity_by_region(spark, sf):
    """The mean of the shares found inside five regions."""
    a, b = F.get("probs", F.lit(0)), F.get("probs", F.lit(1))
    rows = V.scored(spark, sf).select(
        "read_id", "true_label", (F.col("read_id") % 5).alias("dmr_label"), F.array(a / (a + b), b / (a + b)).alias("probs"),
        F.when(F.col("read_id") % 7 == 0, "222").otherwise("212").alias("methyl_seq"),
    )
    train = V.table(spark, sf, "embeddings").select(F.when(F.col("label") % 3 == 0, "T").otherwise("N").alias("ctype"))
    return tumour_purity(rows, train, N, by_region=True).withColumn("pred", F.round("pred", 6))


@query("region_moments", """
SELECT o_orderpriority, count(*) AS n, round(avg((v - 0.5) ** 2), 6) AS m2, round(avg((v - 0.5) ** 3), 6) AS m3,
 round(avg((v - 0.5) ** 3) ** 2 / avg((v - 0.5) ** 2) ** 3, 6) AS skewness_sq FROM (SELECT o_orderpriority, o_totalprice / 600000 AS v FROM orders) t GROUP BY o_orderpriority""")
def region_moments(spark, sf):
    rows = V.table(spark, sf, "orders").select("o_orderpriority", (F.col("o_totalprice") / 600000).alias("purity"))
    m = X.region_moments(rows, 0.5, by=("o_orderpriority",))
    return m.select("o_orderpriority", "n", *[F.round(c, 6).alias(c) for c in ("m2", "m3", "skewness_sq")])


RUNS_SQL = V.RUN_EVAL_SQL


@query("run_summary", f"""
SELECT run, count(*) AS n_points, arg_min(step, [loss, step]) AS final_step, min(loss) AS final_loss, arg_min(acc, [loss, step]) AS final_acc,
 arg_min(step, [-acc, step]) AS best_step, max(acc) AS best_acc FROM ({RUNS_SQL}) e GROUP BY run""")
def run_summary(spark, sf):
    return runs.run_summary(V.run_eval(spark, sf))


@query("improvements", f"""
SELECT run, step, loss, acc FROM (SELECT *, min(loss) OVER (PARTITION BY run ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best
 FROM ({RUNS_SQL}) e) t WHERE best IS NULL OR loss < best""")
def improvements(spark, sf):
    return runs.improvements(V.run_eval(spark, sf))


THIN_SQL = f"""
WITH RECURSIVE e AS MATERIALIZED ({RUNS_SQL}),
k AS (SELECT run, min(step) AS step FROM e GROUP BY run
  UNION ALL SELECT k.run, (SELECT min(e.step) FROM e WHERE e.run = k.run AND e.step >= k.step + 1000) FROM k WHERE k.step IS NOT NULL)
SELECT e.run, e.step, e.loss, e.acc FROM e WHERE EXISTS (SELECT 1 FROM k WHERE k.run = e.run AND k.step = e.step)
 OR e.step = (SELECT max(x.step) FROM e x WHERE x.run = e.run)
"""


@query("thin_curve", THIN_SQL)
def thin_curve(spark, sf):
    return runs.thin_curve(V.run_eval(spark, sf), 1000)
