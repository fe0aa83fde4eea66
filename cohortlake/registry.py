"""Queries of the age-period-cohort engine and the SQL that gives the same rows.

Doubles are rounded to 6 digits on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import api
from .functions import expressions as e
from .operators import posterior, predict, relational, simulate
from .operators.sampler import sample
from .operators.select import rank, select_model
from .plans.spec import Mcmc, ModelSpec
from .sources import lexis
from .sources.lexis import AGES, COHORTS, PER_AGE, PERIODS, shipment_cells, table
from .streaming.ingest import streaming_cells

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def r6(*names: str):
    return {n: F.round(n, 6) for n in names}


# --------------------------------------------------------------------------- shared SQL
CELLS = """cells AS (
  SELECT CAST(floor((p_size - 1) / 5) AS INTEGER) + 1 AS age_idx,
    CAST((year(l_shipdate) - 1995) * 2 + CASE WHEN month(l_shipdate) > 6 THEN 2 ELSE 1 END AS INTEGER) AS period_idx,
    CAST(count(*) AS BIGINT) AS population, CAST(count(CASE WHEN l_returnflag = 'R' THEN 1 END) AS BIGINT) AS cases
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2),
c AS (SELECT *, CAST((10 - age_idx) * 2 + period_idx AS INTEGER) AS cohort_idx FROM cells)"""


def _starts(axis: str) -> str:
    return f"""(SELECT {axis}, ln(p / (1.0e0 - p)) - avg(ln(p / (1.0e0 - p))) OVER () AS effect
  FROM (SELECT {axis}, least(greatest((sum(cases) + 0.5e0) / (sum(population) + 1.0e0), 1e-8), 1.0e0 - 1e-8) AS p FROM c GROUP BY {axis}))"""


ETA = f"""{CELLS},
m AS (SELECT ln(p / (1.0e0 - p)) AS mu FROM (SELECT CAST(sum(cases) AS DOUBLE) / sum(population) AS p FROM c)),
a AS {_starts('age_idx')},
b AS {_starts('period_idx')},
eta AS (SELECT c.*, mu + a.effect + b.effect AS eta FROM c CROSS JOIN m JOIN a USING (age_idx) JOIN b USING (period_idx)),
r AS (SELECT *, 1.0e0 / (1.0e0 + exp(-eta)) AS rate, population / (1.0e0 + exp(-eta)) AS expected FROM eta),
w AS (SELECT *, population * rate * (1.0e0 - rate) AS weight, cases - expected AS residual FROM r)"""


def eta_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = shipment_cells(spark, sf_dir)
    mu, age, period = relational.start_values(cells)
    return relational.linear_predictor(cells, mu, age, period)


# --------------------------------------------------------------------------- cells
@query(f"WITH {CELLS} SELECT age_idx, period_idx, cohort_idx, population, cases FROM c")
def lexis_cells(spark, sf_dir):
    return shipment_cells(spark, sf_dir).select("age_idx", "period_idx", "cohort_idx", "population", "cases")


@query("""WITH x AS (SELECT p_brand AS series_id, CAST(floor((p_size - 1) / 5) AS INTEGER) + 1 AS age_idx,
  CAST((year(l_shipdate) - 1995) * 2 + CASE WHEN month(l_shipdate) > 6 THEN 2 ELSE 1 END AS INTEGER) AS period_idx, l_returnflag
  FROM lineitem JOIN part ON l_partkey = p_partkey)
SELECT series_id, age_idx, period_idx, CAST((10 - age_idx) * 2 + period_idx AS INTEGER) AS cohort_idx, CAST(count(*) AS BIGINT) AS population,
  CAST(count(CASE WHEN l_returnflag = 'R' THEN 1 END) AS BIGINT) AS cases FROM x GROUP BY 1, 2, 3""")
def lexis_cells_by_series(spark, sf_dir):
    return shipment_cells(spark, sf_dir, {"series_id": F.col("p_brand")}).select("series_id", "age_idx", "period_idx", "cohort_idx", "population", "cases")


@query("SELECT CAST(i AS INTEGER) AS age_idx, CAST(j AS INTEGER) AS period_idx, CAST((10 - i) * 2 + j AS INTEGER) AS cohort_idx FROM range(1, 11) x(i), range(1, 15) y(j)")
def cohort_index(spark, sf_dir):
    return lexis.grid(spark, AGES, PERIODS, PER_AGE)


@query(f"""WITH {CELLS}, few AS (SELECT * FROM c WHERE cases % 3 <> 0)
SELECT CAST(i AS INTEGER) AS age_idx, CAST(j AS INTEGER) AS period_idx, CAST((10 - i) * 2 + j AS INTEGER) AS cohort_idx, coalesce(population, 0) AS population, coalesce(cases, 0) AS cases
FROM range(1, 11) x(i) CROSS JOIN range(1, 15) y(j) LEFT JOIN few ON few.age_idx = i AND few.period_idx = j""")
def densified_grid(spark, sf_dir):
    return lexis.densify(shipment_cells(spark, sf_dir).where("cases % 3 <> 0"), AGES, PERIODS, PER_AGE)


@query(f"""WITH {CELLS}, o AS (SELECT *, age_idx BETWEEN 1 AND 8 AND period_idx BETWEEN 1 AND 14 AS inside FROM c)
SELECT CAST(0 AS BIGINT) AS n_null, CAST(count(CASE WHEN cases < 0 OR population < 0 THEN 1 END) AS BIGINT) AS n_negative, CAST(count(CASE WHEN cases > population THEN 1 END) AS BIGINT) AS n_more_cases,
  CAST(count(CASE WHEN NOT inside THEN 1 END) AS BIGINT) AS n_outside, CAST(112 - count(CASE WHEN inside THEN 1 END) AS BIGINT) AS n_missing, CAST(0 AS BIGINT) AS n_repeated FROM o""")
def validate_cells(spark, sf_dir):
    return lexis.validate(shipment_cells(spark, sf_dir), 8, PERIODS, PER_AGE)  # two age groups too many, to be reported


@query(f"""WITH {CELLS} SELECT age_idx, period_idx, cohort_idx, CAST(sum(population) AS BIGINT) AS population, CAST(sum(cases) AS BIGINT) AS cases, CAST(count(*) AS BIGINT) AS n_cells
FROM c GROUP BY GROUPING SETS ((age_idx), (period_idx), (cohort_idx), ())""")
def margins_grouping_sets(spark, sf_dir):
    return relational.margins(shipment_cells(spark, sf_dir))


@query(f"WITH {CELLS} SELECT cohort_idx, CAST(sum(population) AS BIGINT) AS population, CAST(sum(cases) AS BIGINT) AS cases, CAST(count(*) AS BIGINT) AS n_cells FROM c GROUP BY cohort_idx")
def cohort_totals(spark, sf_dir):
    return relational.axis_totals(shipment_cells(spark, sf_dir), "cohort_idx")


@query(f"""WITH {CELLS}, s AS (SELECT avg(CASE WHEN cases = 0 THEN 1.0e0 ELSE 0.0e0 END) AS zero_frac, avg(CASE WHEN cases <= 5 THEN 1.0e0 ELSE 0.0e0 END) AS few_frac FROM c)
SELECT round(zero_frac, 6) AS zero_frac, round(few_frac, 6) AS few_frac, CAST(round_even(40.0e0 * (1 + 2 * least(greatest(zero_frac, few_frac / 2), 1.0e0)), 0) * 1000 AS BIGINT) AS n_iter FROM s""")
def rarity_auto_mcmc(spark, sf_dir):
    return relational.auto_mcmc(shipment_cells(spark, sf_dir)).withColumns(r6("zero_frac", "few_frac"))


# --------------------------------------------------------------------------- starting values, predictor, deviance
@query(f"WITH {ETA} SELECT 'mu' AS param, 0 AS idx, round(mu, 6) AS value FROM m UNION ALL SELECT 'age', age_idx, round(effect, 6) FROM a UNION ALL SELECT 'period', period_idx, round(effect, 6) FROM b")
def start_values(spark, sf_dir):
    mu, age, period = relational.start_values(shipment_cells(spark, sf_dir))
    out = mu.select(F.lit("mu").alias("param"), F.lit(0).alias("idx"), F.col("mu").alias("value"))
    out = out.unionByName(age.select(F.lit("age").alias("param"), F.col("age_idx").alias("idx"), F.col("effect").alias("value")))
    return out.unionByName(period.select(F.lit("period").alias("param"), F.col("period_idx").alias("idx"), F.col("effect").alias("value"))).withColumns(r6("value"))


@query(f"WITH {ETA} SELECT age_idx, period_idx, round(eta, 6) AS eta FROM eta")
def eta_start(spark, sf_dir):
    return eta_cells(spark, sf_dir).select("age_idx", "period_idx", F.round("eta", 6).alias("eta"))


@query(f"WITH {ETA} SELECT age_idx, period_idx, round(rate, 6) AS rate, round(expected, 6) AS expected, round(ln(rate / (1.0e0 - rate)), 6) AS back FROM r")
def inv_logit_rates(spark, sf_dir):
    r = relational.rates(eta_cells(spark, sf_dir))
    return r.select("age_idx", "period_idx", "rate", "expected", e.logit("rate").alias("back")).withColumns(r6("rate", "expected", "back"))


_DEV = "2.0e0 * (CASE WHEN cases > 0 THEN cases * ln(cases / expected) ELSE 0.0e0 END + CASE WHEN population - cases > 0 THEN (population - cases) * ln((population - cases) / (population - expected)) ELSE 0.0e0 END)"


@query(f"WITH {ETA} SELECT round(sum({_DEV}), 6) AS deviance FROM r")
def deviance_start(spark, sf_dir):
    return relational.deviance(eta_cells(spark, sf_dir)).withColumns(r6("deviance"))


@query(f"WITH {ETA} SELECT period_idx, round(sum({_DEV}), 6) AS deviance FROM r GROUP BY period_idx")
def deviance_by_period(spark, sf_dir):
    return relational.deviance(eta_cells(spark, sf_dir), "period_idx").withColumns(r6("deviance"))


@query(f"WITH {ETA} SELECT age_idx, period_idx, round(weight, 6) AS weight, round(greatest(eta, 0.0e0) + ln(1.0e0 + exp(-abs(eta))), 6) AS softplus FROM w")
def fisher_weights(spark, sf_dir):
    return relational.rates(eta_cells(spark, sf_dir)).select("age_idx", "period_idx", "weight", e.softplus("eta").alias("softplus")).withColumns(r6("weight", "softplus"))


@query(f"""WITH {ETA} SELECT 'age' AS axis, age_idx AS idx, round(sum(residual), 6) AS score, round(sum(weight), 6) AS weight FROM w GROUP BY age_idx
UNION ALL SELECT 'period', period_idx, round(sum(residual), 6), round(sum(weight), 6) FROM w GROUP BY period_idx UNION ALL SELECT 'cohort', cohort_idx, round(sum(residual), 6), round(sum(weight), 6) FROM w GROUP BY cohort_idx""")
def score_margins(spark, sf_dir):
    r = relational.rates(eta_cells(spark, sf_dir))
    parts = [relational.score_margins(r, f"{a}_idx").select(F.lit(a).alias("axis"), F.col(f"{a}_idx").alias("idx"), "score", "weight") for a in ("age", "period", "cohort")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).withColumns(r6("score", "weight"))


@query(f"WITH {ETA} SELECT age_idx, cohort_idx, round(sum(weight), 6) AS weight FROM w GROUP BY 1, 2")
def age_cohort_coupling(spark, sf_dir):
    return relational.coupling(relational.rates(eta_cells(spark, sf_dir)), "age_idx", "cohort_idx").withColumns(r6("weight"))


@query(f"WITH {ETA} SELECT period_idx, cohort_idx, round(sum(weight), 6) AS weight FROM w GROUP BY 1, 2")
def period_cohort_coupling(spark, sf_dir):
    return relational.coupling(relational.rates(eta_cells(spark, sf_dir)), "period_idx", "cohort_idx").withColumns(r6("weight"))


@query(f"""WITH {ETA}, h AS (SELECT age_idx, period_idx, eta AS x, (exp(eta / 2) - exp(-eta / 2)) / (exp(eta / 2) + exp(-eta / 2)) AS t FROM eta)
SELECT age_idx, period_idx, round(CASE WHEN abs(x) < 1e-4 THEN 0.25e0 ELSE t / (2 * x) END, 6) AS mean, round(CASE WHEN abs(x) < 1e-4 THEN 1.0e0 / 24 ELSE ((2 / x) * t - (1 - t * t)) / (4 * x * x) END, 6) AS variance FROM h""")
def pg_moments(spark, sf_dir):
    return eta_cells(spark, sf_dir).select("age_idx", "period_idx", e.pg_mean("eta").alias("mean"), e.pg_variance("eta").alias("variance")).withColumns(r6("mean", "variance"))


def _rw(order: int) -> str:
    d = "effect - lag(effect, 1) OVER (ORDER BY period_idx)" if order == 1 else "effect - 2 * lag(effect, 1) OVER (ORDER BY period_idx) + lag(effect, 2) OVER (ORDER BY period_idx)"
    return f"WITH {ETA}, d AS (SELECT {d} AS d FROM b) SELECT round(sum(d * d), 6) AS penalty FROM d"


@query(_rw(1))
def rw1_penalty(spark, sf_dir):
    return relational.random_walk_penalty(relational.start_values(shipment_cells(spark, sf_dir))[2], "period_idx", 1).withColumns(r6("penalty"))


@query(_rw(2))
def rw2_penalty(spark, sf_dir):
    return relational.random_walk_penalty(relational.start_values(shipment_cells(spark, sf_dir))[2], "period_idx", 2).withColumns(r6("penalty"))


@query("SELECT CAST(i AS INTEGER) AS r, CAST(j AS INTEGER) AS c, CAST(CASE WHEN i = j THEN CASE WHEN i IN (1, 14) THEN 1 ELSE 2 END ELSE -1 END AS DOUBLE) AS v FROM range(1, 15) x(i), range(1, 15) y(j) WHERE abs(i - j) <= 1")
def structure_matrix_rw1(spark, sf_dir):
    return relational.structure_matrix(spark, PERIODS, 1)


@query("SELECT CAST(i AS INTEGER) AS r, CAST(j AS INTEGER) AS c, CAST(CASE abs(i - j) WHEN 2 THEN 1 WHEN 1 THEN CASE WHEN least(i, j) IN (1, 13) THEN -2 ELSE -4 END ELSE CASE WHEN i IN (1, 14) THEN 1 WHEN i IN (2, 13) THEN 5 ELSE 6 END END AS DOUBLE) AS v FROM range(1, 15) x(i), range(1, 15) y(j) WHERE abs(i - j) <= 2")
def structure_matrix_rw2(spark, sf_dir):
    return relational.structure_matrix(spark, PERIODS, 2)


# --------------------------------------------------------------------------- covariates
_COV = "cov AS (SELECT period_idx AS idx, CAST(sum(population) AS DOUBLE) / 1000.0e0 AS value FROM c GROUP BY period_idx), nc AS (SELECT idx, value / avg(value) OVER () AS value FROM cov WHERE idx <= 14)"


def _covariate(spark, sf_dir):
    per = relational.axis_totals(shipment_cells(spark, sf_dir), "period_idx").select(F.col("period_idx").alias("idx"), (F.col("population") / 1000.0).alias("value"))
    return relational.normalised_covariate(per, PERIODS)


@query(f"WITH {CELLS}, {_COV} SELECT idx, round(value, 6) AS value FROM nc")
def covariate_normalised(spark, sf_dir):
    return _covariate(spark, sf_dir).withColumns(r6("value"))


@query(f"WITH {ETA}, {_COV} SELECT period_idx, round(effect, 6) AS effect, round(value, 6) AS value, round(effect / value, 6) AS relative FROM b JOIN nc ON idx = period_idx")
def relative_effect(spark, sf_dir):
    period = relational.start_values(shipment_cells(spark, sf_dir))[2]
    return relational.relative_effect(period, _covariate(spark, sf_dir), "period_idx").select("period_idx", "effect", "value", "relative").withColumns(r6("effect", "value", "relative"))


# --------------------------------------------------------------------------- posterior layer on deterministic pseudo-draws
PSEUDO = """pseudo AS (SELECT CAST(l_linenumber % 4 AS INTEGER) AS chain, l_orderkey AS draw, CASE WHEN l_suppkey % 3 = 0 THEN 'age' WHEN l_suppkey % 3 = 1 THEN 'period' ELSE 'cohort' END AS param,
  CAST(l_partkey % 12 + 1 AS INTEGER) AS idx, l_quantity / 10.0e0 + l_tax AS value FROM lineitem)"""
EFFECTS = """eff AS (SELECT p_size % 5 AS draw, 'age' AS param, CAST((p_size - 1) % 10 + 1 AS INTEGER) AS idx, avg(p_retailprice) / 1000.0e0 AS value FROM part GROUP BY 1, 2, 3
  UNION ALL SELECT p_size % 5, 'period', CAST(p_partkey % 14 + 1 AS INTEGER), avg(p_retailprice) / 900.0e0 FROM part GROUP BY 1, 2, 3
  UNION ALL SELECT p_size % 5, 'cohort', CAST(p_partkey % 32 + 1 AS INTEGER), avg(p_retailprice) / 800.0e0 FROM part GROUP BY 1, 2, 3)"""


def _pseudo(spark, sf_dir):
    q = F.col("l_suppkey") % 3
    return table(spark, sf_dir, "lineitem").select(
        (F.col("l_linenumber") % 4).cast("int").alias("chain"), F.col("l_orderkey").alias("draw"), F.when(q == 0, "age").when(q == 1, "period").otherwise("cohort").alias("param"),
        (F.col("l_partkey") % 12 + 1).cast("int").alias("idx"), (F.col("l_quantity") / 10.0 + F.col("l_tax")).alias("value"))


def _effects(spark, sf_dir):
    part = table(spark, sf_dir, "part").select((F.col("p_size") % 5).alias("draw"), "p_size", "p_partkey", "p_retailprice")
    spread = F.array(*[F.struct(F.lit(p).alias("param"), i.cast("int").alias("idx"), F.lit(s).alias("scale")) for p, i, s in (("age", (F.col("p_size") - 1) % 10 + 1, 1000.0), ("period", F.col("p_partkey") % 14 + 1, 900.0), ("cohort", F.col("p_partkey") % 32 + 1, 800.0))])
    rows = part.select("draw", "p_retailprice", F.explode(spread).alias("x"))
    return rows.groupBy("draw", "x.param", "x.idx", "x.scale").agg(F.avg("p_retailprice").alias("v")).select("draw", "param", "idx", (F.col("v") / F.col("scale")).alias("value"))


@query(f"WITH {EFFECTS} SELECT draw, param, round(regr_slope(value, CAST(idx AS DOUBLE)), 6) AS slope FROM eff GROUP BY 1, 2")
def slope_per_effect(spark, sf_dir):
    return posterior.slopes(_effects(spark, sf_dir), "draw").withColumns(r6("slope"))


@query(f"WITH {EFFECTS} SELECT draw, param, idx, round(value - avg(value) OVER (PARTITION BY draw, param), 6) AS value FROM eff")
def centred_effects(spark, sf_dir):
    return posterior.centred(_effects(spark, sf_dir), "draw").withColumns(r6("value"))


def _gauge(convention: str, sign: str) -> str:
    return f"""WITH {EFFECTS}, s AS (SELECT draw, {sign} * regr_slope(value, CAST(idx AS DOUBLE)) AS f FROM eff WHERE param = '{convention}' GROUP BY draw),
g AS (SELECT eff.draw, param, idx, value + CASE param WHEN 'age' THEN f * 2 * idx WHEN 'period' THEN -f * idx ELSE f * idx END AS value FROM eff JOIN s ON eff.draw = s.draw)
SELECT draw, param, idx, round(value - avg(value) OVER (PARTITION BY draw, param), 6) AS value FROM g"""


@query(_gauge("age", "-0.5e0"))
def gauge_age(spark, sf_dir):
    return posterior.gauge(_effects(spark, sf_dir), PER_AGE, "age", "draw").select("draw", "param", "idx", F.round("value", 6).alias("value"))


@query(_gauge("period", "1.0e0"))
def gauge_period(spark, sf_dir):
    return posterior.gauge(_effects(spark, sf_dir), PER_AGE, "period", "draw").select("draw", "param", "idx", F.round("value", 6).alias("value"))


@query(_gauge("cohort", "-1.0e0"))
def gauge_cohort(spark, sf_dir):
    return posterior.gauge(_effects(spark, sf_dir), PER_AGE, "cohort", "draw").select("draw", "param", "idx", F.round("value", 6).alias("value"))


@query(f"WITH {PSEUDO} " + " UNION ALL ".join(f"SELECT param, idx, CAST({p} AS DOUBLE) AS probability, round(quantile_cont(value, {p}), 6) AS value FROM pseudo GROUP BY 1, 2" for p in (0.05, 0.5, 0.95)))
def quantiles_type7(spark, sf_dir):
    return posterior.quantiles(_pseudo(spark, sf_dir), [0.05, 0.5, 0.95], "param", "idx").withColumns(r6("value"))


@query(f"""WITH {PSEUDO}, one AS (SELECT param, idx, chain, avg(value) AS m, var_samp(value) AS s2, CAST(count(*) AS DOUBLE) AS n FROM pseudo GROUP BY 1, 2, 3),
two AS (SELECT param, idx, CAST(count(*) AS DOUBLE) AS k, avg(n) AS n, avg(s2) AS w, avg(n) * var_samp(m) AS b, var_samp(s2) AS vs, covar_samp(s2, m * m) AS c2, covar_samp(s2, m) AS c1, avg(m) AS mean FROM one GROUP BY 1, 2),
v AS (SELECT *, (n - 1) / n * w + (1 + 1 / k) * b / n AS v, vs / k AS vw, 2 * b * b / (k - 1) AS vb, n / k * (c2 - 2 * mean * c1) AS cwb FROM two),
d AS (SELECT *, 2 * v * v / ((((n - 1) * (n - 1)) * vw + ((1 + 1 / k) * (1 + 1 / k)) * vb + 2 * (n - 1) * (1 + 1 / k) * cwb) / (n * n)) AS df FROM v)
SELECT param, idx, round(sqrt((df + 3) / (df + 1) * ((n - 1) / n + (1 + 1 / k) * b / (n * w))), 6) AS psrf FROM d""")
def psrf_point(spark, sf_dir):
    return posterior.psrf_point(_pseudo(spark, sf_dir), "param", "idx").select("param", "idx", F.round("psrf", 6).alias("psrf"))


@query()
def psrf_upper(spark, sf_dir):
    return posterior.psrf(_pseudo(spark, sf_dir), "param", "idx").withColumns(r6("psrf", "upper"))


_SPECS = f"""{PSEUDO}, f AS (SELECT 'm' || lpad(CAST(idx AS VARCHAR), 2, '0') AS spec_id, CASE WHEN idx = 3 THEN NULL ELSE round(avg(value) * 100, 4) END AS dic, idx % 3 <> 0 AS converged FROM pseudo GROUP BY idx)"""


def _fits(spark, sf_dir):
    f = _pseudo(spark, sf_dir).groupBy("idx").agg(F.avg("value").alias("v"))
    return f.select(F.concat(F.lit("m"), F.lpad(F.col("idx").cast("string"), 2, "0")).alias("spec_id"), F.when(F.col("idx") == 3, None).otherwise(F.round(F.col("v") * 100, 4)).alias("dic"), (F.col("idx") % 3 != 0).alias("converged"))


@query(f"""WITH {_SPECS} SELECT spec_id, dic, converged, CAST(row_number() OVER (ORDER BY dic ASC NULLS LAST, spec_id) AS INTEGER) AS position,
  row_number() OVER (ORDER BY CASE WHEN converged AND dic IS NOT NULL THEN 0 ELSE 1 END, dic ASC NULLS LAST, spec_id) = 1 AS selected FROM f""")
def rank_specs_by_dic(spark, sf_dir):
    return rank(_fits(spark, sf_dir))


@query(f"""WITH {_SPECS}, b AS (SELECT min(dic) AS best FROM f WHERE converged) SELECT spec_id, dic, round(dic - best, 4) AS gap, dic - best < 4.0e0 AS within_margin FROM f CROSS JOIN b WHERE converged AND dic IS NOT NULL""")
def best_spec_margin(spark, sf_dir):
    f = _fits(spark, sf_dir).where("converged and dic is not null")
    b = f.agg(F.min("dic").alias("best"))
    return f.join(F.broadcast(b)).select("spec_id", "dic", F.round(F.col("dic") - F.col("best"), 4).alias("gap"), (F.col("dic") - F.col("best") < 4.0).alias("within_margin"))


# --------------------------------------------------------------------------- the functions of a fit on made-up draws of known values
_FULL = ModelSpec("rw1", "rw1+het", "rw1")
_VALUES = {  # of chain c, draw d and index i
    "age": "((c * 7 + d * 13 + i * 5) % 11) / 10.0e0 - 0.5e0", "period": "((c * 5 + d * 11 + i * 3) % 9) / 10.0e0 - 0.4e0", "cohort": "((c * 3 + d * 5 + i * 7) % 17) / 20.0e0 - 0.4e0",
    "period2": "((c + d * 3 + i * 2) % 7) / 50.0e0 - 0.06e0",
}
_NUMBERS = {"intercept": "((c * 3 + d * 7) % 13) / 50.0e0 - 0.5e0", "deviance": "100.0e0 + (c * 11 + d * 17) % 29", "age_parameter": "1.0e0 + (c + d * 5) % 6", "period_parameter": "2.0e0 + (c * 2 + d) % 9", "cohort_parameter": "3.0e0 + (c + d) % 4", "period2_parameter": "4.0e0 + (c * 3 + d) % 5"}
_LENGTHS = {"age": AGES, "period": PERIODS, "cohort": COHORTS, "period2": PERIODS}
_CHAINS, _DRAWS = 4, 25
_ROWS = " UNION ALL ".join(f"SELECT c, d, '{k}' AS param, i, {_VALUES[k]} AS value FROM cd, range(1, {n + 1}) z(i)" for k, n in _LENGTHS.items())
_PARAMETERS = " UNION ALL ".join(f"SELECT c, d, '{k}' AS param, {v} AS value FROM cd" for k, v in _NUMBERS.items())
_MADE = f"""cd AS (SELECT c, d FROM range(0, {_CHAINS}) x(c), range(0, {_DRAWS}) y(d)), made AS ({_ROWS}), numbers AS ({_PARAMETERS}),
made_eta AS (SELECT n.c, n.d, a.i AS age_idx, p.i AS period_idx, n.value + a.value + p.value + q.value + k.value AS eta
  FROM numbers n JOIN made a ON n.param = 'intercept' AND a.param = 'age' AND a.c = n.c AND a.d = n.d JOIN made p ON p.param = 'period' AND p.c = n.c AND p.d = n.d
  JOIN made q ON q.param = 'period2' AND q.c = n.c AND q.d = n.d AND q.i = p.i JOIN made k ON k.param = 'cohort' AND k.c = n.c AND k.d = n.d AND k.i = ({AGES} - a.i) * {PER_AGE} + p.i)"""
_MADE_GAUGE = f"""{_MADE}, s AS (SELECT c, d, -0.5e0 * regr_slope(value, CAST(i AS DOUBLE)) AS f FROM made WHERE param = 'age' GROUP BY c, d),
g AS (SELECT made.c, made.d, param, i, value + CASE param WHEN 'age' THEN f * {PER_AGE} * i WHEN 'period' THEN -f * i ELSE f * i END AS value FROM made JOIN s ON made.c = s.c AND made.d = s.d WHERE param <> 'period2'),
fixed AS (SELECT c, d, param, CAST(i AS INTEGER) AS idx, value - avg(value) OVER (PARTITION BY c, d, param) AS value FROM g)"""


def _quantile_sql(keys: str, source: str, probabilities: tuple[float, ...]) -> str:
    return " UNION ALL ".join(f"SELECT {keys}, CAST({p} AS DOUBLE) AS probability, round(quantile_cont(value, {p}), 9) AS value FROM {source} GROUP BY {keys}" for p in probabilities)


def _made_draws(spark):
    """A table like the sampler's, with the values above."""
    array = lambda k: F.expr(f"transform(sequence(1, {_LENGTHS[k]}), i -> CAST({_VALUES[k]} AS DOUBLE))")
    rows = spark.range(_CHAINS * _DRAWS).select(F.lit("all").alias("series_id"), F.lit(_FULL.key).alias("spec_id"), (F.col("id") % _CHAINS).cast("int").alias("c"), F.floor(F.col("id") / _CHAINS).cast("int").alias("d"))
    rows = rows.withColumns({k: array(k) for k in _VALUES} | {k: F.expr(v).cast("double") for k, v in _NUMBERS.items()})
    none = lambda kind: F.lit(None).cast(kind)
    rows = rows.withColumns({"age2": none("array<double>"), "cohort2": none("array<double>"), "age2_parameter": none("double"), "cohort2_parameter": none("double"), "overdispersion": none("double"), "accepted": F.lit(1.0), "seconds": F.lit(0.0), "error": none("string")})
    eta = F.expr(f"transform(sequence(0, {AGES * PERIODS - 1}), k -> intercept + age[int(k div {PERIODS})] + period[k % {PERIODS}] + period2[k % {PERIODS}] + cohort[int(({AGES - 1} - k div {PERIODS}) * {PER_AGE} + k % {PERIODS})])")
    return rows.withColumn("eta", eta).withColumnsRenamed({"c": "chain", "d": "draw"})


@query(f"WITH {_MADE_GAUGE} SELECT param, idx, round(avg(value), 9) AS value FROM fixed GROUP BY 1, 2")
def effects_mean(spark, sf_dir):
    return posterior.effects(_made_draws(spark), _FULL, PER_AGE, None).select("param", "idx", F.round("value", 9).alias("value"))


@query(f"WITH {_MADE_GAUGE} {_quantile_sql('param, idx', 'fixed', (0.1, 0.5, 0.9))}")
def effects_quantiles(spark, sf_dir):
    return posterior.effects(_made_draws(spark), _FULL, PER_AGE, [0.1, 0.5, 0.9]).select("param", "idx", "probability", F.round("value", 9).alias("value"))


@query(f"""WITH {_MADE}, h AS (SELECT p.c, p.d, CAST(p.i AS INTEGER) AS idx, p.value + q.value AS value FROM made p JOIN made q ON p.param = 'period' AND q.param = 'period2' AND p.c = q.c AND p.d = q.d AND p.i = q.i)
SELECT 'period' AS param, idx, round(avg(value), 9) AS value FROM h GROUP BY 2 UNION ALL SELECT param, CAST(i AS INTEGER), round(avg(value), 9) FROM made WHERE param IN ('age', 'cohort') GROUP BY 1, 2""")
def effects_with_heterogeneity(spark, sf_dir):
    return posterior.effects(_made_draws(spark), _FULL, PER_AGE, None, "none", combined=True).select("param", "idx", F.round("value", 9).alias("value"))


@query(f"WITH {_MADE} {_quantile_sql('param', 'numbers', (0.05, 0.5, 0.95))}")
def parameter_summary(spark, sf_dir):
    return posterior.summary(_made_draws(spark)).select("param", "probability", F.round("value", 9).alias("value"))


@query(f"WITH {_MADE} SELECT CAST(age_idx AS INTEGER) AS age_idx, CAST(period_idx AS INTEGER) AS period_idx, round(avg(eta), 9) AS eta FROM made_eta GROUP BY 1, 2")
def fitted_predictor(spark, sf_dir):
    return posterior.fitted(_made_draws(spark), PERIODS).select("age_idx", "period_idx", F.round("eta", 9).alias("eta"))


@query(f"""WITH {CELLS}, {_MADE}, f AS (SELECT age_idx, period_idx, avg(eta) AS eta FROM made_eta GROUP BY 1, 2),
x AS (SELECT c.*, population / (1.0e0 + exp(-eta)) AS expected FROM c JOIN f USING (age_idx, period_idx)), m AS (SELECT avg(value) AS dbar FROM numbers WHERE param = 'deviance'),
p AS (SELECT sum({_DEV}) AS plug FROM x) SELECT round(dbar, 5) AS mean_deviance, round(plug, 5) AS deviance_at_mean, round(dbar - plug, 5) AS pd, round(2 * dbar - plug, 5) AS dic FROM m CROSS JOIN p""")
def deviance_information(spark, sf_dir):
    out = posterior.information(_made_draws(spark), _one_series(spark, sf_dir), PERIODS)
    return out.select(*[F.round(c, 5).alias(c) for c in ("mean_deviance", "deviance_at_mean", "pd", "dic")])


@query(f"""WITH {_MADE}, x AS (SELECT c AS chain, 'eta' AS param, (age_idx - 1) * {PERIODS} + period_idx AS idx, eta AS value FROM made_eta UNION ALL SELECT c, param, 0, value FROM numbers WHERE param <> 'deviance'),
one AS (SELECT param, idx, chain, avg(value) AS m, var_samp(value) AS s2, CAST(count(*) AS DOUBLE) AS n FROM x GROUP BY 1, 2, 3),
two AS (SELECT param, idx, CAST(count(*) AS DOUBLE) AS k, avg(n) AS n, avg(s2) AS w, avg(n) * var_samp(m) AS b, var_samp(s2) AS vs, covar_samp(s2, m * m) AS c2, covar_samp(s2, m) AS c1, avg(m) AS mean FROM one GROUP BY 1, 2),
v AS (SELECT *, (n - 1) / n * w + (1 + 1 / k) * b / n AS v, vs / k AS vw, 2 * b * b / (k - 1) AS vb, n / k * (c2 - 2 * mean * c1) AS cwb FROM two),
d AS (SELECT *, 2 * v * v / ((((n - 1) * (n - 1)) * vw + ((1 + 1 / k) * (1 + 1 / k)) * vb + 2 * (n - 1) * (1 + 1 / k) * cwb) / (n * n)) AS df FROM v),
r AS (SELECT max(sqrt((df + 3) / (df + 1) * ((n - 1) / n + (1 + 1 / k) * b / (n * w)))) AS r FROM d) SELECT round(r, 9) AS max_psrf, r < 1.1e0 AS converged FROM r""")
def convergence_point(spark, sf_dir):
    return posterior.convergence(_made_draws(spark), 1.1, 1).select(F.round("max_psrf", 9).alias("max_psrf"), "converged")


@query(f"WITH {_MADE} SELECT CAST(c AS INTEGER) AS chain, CAST(count(*) AS BIGINT) AS n, round(avg(value), 9) AS mean_deviance FROM numbers WHERE param = 'deviance' AND (d + 1) % 3 = 0 GROUP BY 1")
def thinned_draws(spark, sf_dir):
    return posterior.thin(_made_draws(spark), 8).groupBy("chain").agg(F.count("*").alias("n"), F.round(F.avg("deviance"), 9).alias("mean_deviance"))


@query(f"WITH {_MADE}, r AS (SELECT CAST(age_idx AS INTEGER) AS age_idx, CAST(period_idx AS INTEGER) AS period_idx, 1.0e0 / (1.0e0 + exp(-eta)) AS value FROM made_eta) {_quantile_sql('age_idx, period_idx', 'r', (0.05, 0.5, 0.95))}")
def predicted_rates(spark, sf_dir):
    rates = predict.predict(_made_draws(spark), [_FULL], _one_series(spark, sf_dir), AGES, PERIODS, PER_AGE)["rates"]
    return rates.select("age_idx", "period_idx", "probability", F.round("value", 9).alias("value"))


_CURVE = [1.0 + 0.125 * j for j in range(PERIODS)]


@query(f"""WITH {_MADE}, v AS (SELECT i, 1.0e0 + 0.125e0 * (i - 1) AS v FROM range(1, {PERIODS + 1}) z(i)),
e AS (SELECT 'effect' AS panel, param, CAST(i AS INTEGER) AS idx, value FROM made WHERE param <> 'period2' UNION ALL SELECT 'relative', param, CAST(made.i AS INTEGER), value / v FROM made JOIN v ON made.i = v.i WHERE param = 'period'),
q AS ({_quantile_sql('panel, param, idx', 'e', (0.05, 0.5, 0.95))} UNION ALL SELECT 'covariate', 'period', CAST(i AS INTEGER), 0.5e0, v FROM v)
SELECT *, CASE WHEN probability = 0.5e0 THEN 'solid' ELSE 'dashed' END AS line FROM q""")
def plot_panels(spark, sf_dir):
    curves = posterior.plot_data(_made_draws(spark), _FULL, PER_AGE, covariates={"period": _CURVE})
    return curves.select("panel", "param", "idx", "probability", F.round("value", 9).alias("value"), "line")


# --------------------------------------------------------------------------- forecasts
def _path(order: int) -> str:
    step = "0.0e0" if order == 1 else "l.value - p.value"
    return f"""WITH {EFFECTS}, x AS (SELECT * FROM eff WHERE param = 'period'), n AS (SELECT draw, max(idx) AS n FROM x GROUP BY draw)
SELECT n.draw, CAST(n.n + h AS INTEGER) AS idx, round(l.value + h * ({step}), 6) AS value FROM n JOIN x l ON l.draw = n.draw AND l.idx = n.n JOIN x p ON p.draw = n.draw AND p.idx = n.n - 1 CROSS JOIN range(1, 6) t(h)"""


@query(_path(1))
def rw1_forecast_mean(spark, sf_dir):
    return predict.mean_path(_effects(spark, sf_dir).where("param = 'period'"), 1, 5, "draw").withColumns(r6("value"))


@query(_path(2))
def rw2_forecast_mean(spark, sf_dir):
    return predict.mean_path(_effects(spark, sf_dir).where("param = 'period'"), 2, 5, "draw").withColumns(r6("value"))


@query(f"WITH {ETA} SELECT period_idx, round(sum(expected), 6) AS expected, CAST(sum(cases) AS BIGINT) AS cases FROM r GROUP BY period_idx")
def predicted_cases_per_period(spark, sf_dir):
    r = relational.rates(eta_cells(spark, sf_dir))
    return r.groupBy("period_idx").agg(F.round(F.sum("expected"), 6).alias("expected"), F.sum("cases").alias("cases"))


_SIM = dict(intercept=-5.0, age=[-1.0 + 0.2 * i for i in range(10)], period=[0.1 * (j % 5) for j in range(14)], cohort=[0.02 * k - 0.3 for k in range(32)])


@query("""SELECT CAST(i AS INTEGER) AS age_idx, CAST(j AS INTEGER) AS period_idx, CAST((10 - i) * 2 + j AS INTEGER) AS cohort_idx, round(1000000 / (1.0e0 + exp(-(-5.0e0 + -1.0e0 + 0.2e0 * (i - 1) + 0.1e0 * ((j - 1) % 5) + 0.02e0 * ((10 - i) * 2 + j - 1) - 0.3e0))), 6) AS expected
FROM range(1, 11) x(i), range(1, 15) y(j)""")
def simulate_expected(spark, sf_dir):
    s = simulate.expected(spark, _SIM["intercept"], _SIM["age"], _SIM["period"], _SIM["cohort"], PER_AGE, 1_000_000)
    return s.select("age_idx", "period_idx", "cohort_idx", F.round(F.col("population") * F.col("rate"), 6).alias("expected"))


@query()
def simulate_apc(spark, sf_dir):
    s = simulate.expected(spark, _SIM["intercept"], _SIM["age"], _SIM["period"], _SIM["cohort"], PER_AGE, 1_000_000)
    return simulate.simulate(s.select("age_idx", "period_idx", "cohort_idx", "population", "rate"), seed=7)


# --------------------------------------------------------------------------- sampling
FAST = Mcmc(600, 300, 2, 4)


def _one_series(spark, sf_dir):
    return shipment_cells(spark, sf_dir).withColumn("series_id", F.lit("all"))


def _fit(spark, sf_dir, spec: ModelSpec, mcmc: Mcmc = FAST) -> api.ApcFit:
    return api.fit(_one_series(spark, sf_dir), spec, AGES, PERIODS, PER_AGE, mcmc)


@query()
def fit_apc(spark, sf_dir):
    draws = sample(_one_series(spark, sf_dir), [ModelSpec("rw1", "rw1", "rw1")], FAST, AGES, PERIODS, PER_AGE)
    return draws.groupBy("series_id", "spec_id", "chain").agg(F.count("*").alias("n_draws"), F.round(F.avg("deviance"), 2).alias("mean_deviance"), F.round(F.avg("accepted"), 3).alias("accepted"))


@query()
def fit_many_series(spark, sf_dir):
    cells = shipment_cells(spark, sf_dir, {"series_id": F.col("l_linestatus")})
    specs = [ModelSpec("rw1", "rw1", "rw1"), ModelSpec("rw2", "rw2", "rw2"), ModelSpec("rw1", "rw1", None, overdisp=True)]
    return sample(cells, specs, Mcmc(300, 150, 1, 2), AGES, PERIODS, PER_AGE).groupBy("series_id", "spec_id").agg(F.count("*").alias("n_draws"), F.round(F.avg("deviance"), 2).alias("mean_deviance"))


@query()
def check_convergence(spark, sf_dir):
    return _fit(spark, sf_dir, ModelSpec("rw1", "rw1", "rw1")).convergence().select("series_id", "spec_id", F.round("max_psrf", 3).alias("max_psrf"), "converged")


@query()
def information_criterion(spark, sf_dir):
    return _fit(spark, sf_dir, ModelSpec("rw1", "rw1", "rw1")).information().withColumns({c: F.round(c, 2) for c in ("mean_deviance", "deviance_at_mean", "pd", "dic")})


@query()
def effects_apc(spark, sf_dir):
    return _fit(spark, sf_dir, ModelSpec("rw1", "rw1", "rw1")).effects([0.05, 0.5, 0.95]).withColumns({"value": F.round("value", 4)})


@query()
def plot_data(spark, sf_dir):
    return _fit(spark, sf_dir, ModelSpec("rw2", "rw2", None)).plot_data().withColumns({"value": F.round("value", 4)})


@query()
def print_summary(spark, sf_dir):
    return posterior.summary(_fit(spark, sf_dir, ModelSpec("rw1+het", "rw1", None, overdisp=True)).draws).withColumns({"value": F.round("value", 4)})


@query()
def predict_apc(spark, sf_dir):
    return _fit(spark, sf_dir, ModelSpec("rw1", "rw2", "rw1"), Mcmc(400, 200, 1, 2)).predict(3)["rates"].withColumns({"value": F.round("value", 5)})


@query()
def select_apc_model(spark, sf_dir):
    found = select_model(_one_series(spark, sf_dir), AGES, PERIODS, PER_AGE, pinned={"cohort": None}, screen=Mcmc(400, 200, 1, 2), refit=False).table
    return found.drop("seconds").withColumns({c: F.round(c, 2) for c in ("dic", "pd", "mean_deviance", "max_psrf")})


# --------------------------------------------------------------------------- streaming ingest, run over the stored events
@query("""SELECT date_trunc('day', ts) AS period_start, CAST(user_id % 10 + 1 AS INTEGER) AS age_idx, CAST(count(*) AS BIGINT) AS population, CAST(count(CASE WHEN event_type = 'error' THEN 1 END) AS BIGINT) AS cases FROM events GROUP BY 1, 2""")
def event_cells(spark, sf_dir):
    return streaming_cells(table(spark, sf_dir, "events"), F.col("user_id") % 10 + 1, F.col("event_type") == "error")
