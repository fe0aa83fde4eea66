import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlake import api
from cohortlake.operators import posterior, relational
from cohortlake.operators.select import rank, select_model
from cohortlake.operators.simulate import expected, simulate
from cohortlake.plans.spec import Mcmc, ModelSpec
from cohortlake.sources import lexis
from cohortlake.streaming.ingest import refit_on_batch, streaming_cells

FAST = Mcmc(300, 150, 1, 2)


@pytest.fixture(scope="module")
def cells(spark):
    sim = expected(spark, -3.0, list(np.linspace(-0.5, 0.5, 5)), [0.1 * (j % 3) for j in range(8)], [0.0] * 16, 2, 20_000)
    return simulate(sim.select("age_idx", "period_idx", "cohort_idx", "population", "rate"), 5).withColumn("series_id", F.lit("s")).persist()


@pytest.fixture(scope="module")
def fit(cells):
    return api.fit(cells, ModelSpec("rw1", "rw1", "rw1"), 5, 8, 2, FAST)


def test_cohort_index(spark):
    from cohortlake.functions.expressions import cohort_index

    r = spark.range(1).select(cohort_index(F.lit(10), F.lit(1), 10, 5).alias("a"), cohort_index(F.lit(1), F.lit(8), 10, 5).alias("b")).first()
    assert (r.a, r.b) == (1, 53)


@pytest.mark.parametrize("y,want", [([9] * 4, 40000), ([0] * 4, 120000), ([0, 0, 3, 9], 80000), ([9, 9, 9, 5, 5], 56000), ([], 80000)])
def test_auto_mcmc(spark, y, want):
    df = spark.createDataFrame([(v,) for v in y], "cases bigint")
    assert relational.auto_mcmc(df).first().n_iter == want


def test_validation(spark):
    df = spark.createDataFrame([(1, 1, 5, 9), (1, 2, None, 1), (9, 1, 5, 1), (1, 1, -3, 0)], "age_idx int, period_idx int, population bigint, cases bigint")
    r = lexis.validate(df, 2, 2, 1).first()
    assert (r.n_null, r.n_negative, r.n_more_cases, r.n_outside, r.n_missing, r.n_repeated) == (1, 1, 2, 1, 2, 1)


def test_matrices(spark):
    c = lexis.cells_from_matrices(spark, [[1, 2], [3, 4], [5, 6]], [[9, 9]] * 3, 1)
    assert {(r.age_idx, r.period_idx): r.cases for r in c.collect()}[2, 3] == 6
    with pytest.raises(ValueError):
        lexis.cells_from_matrices(spark, [[1]], [[1, 2]], 1)


def test_convergence_and_information(fit):
    c = fit.convergence().first()
    assert c.max_psrf is not None and c.max_psrf < 1.5
    i = fit.information().first()
    assert abs(i.pd + i.mean_deviance - i.dic) < 1e-6 and 0 < i.pd < 30


def test_draws_do_not_depend_on_partitioning(fit, cells, spark):
    again = api.fit(cells.repartition(7), fit.spec, 5, 8, 2, FAST).draws
    a, b = (d.groupBy("chain").agg(F.sum("deviance").alias("s")).orderBy("chain").collect() for d in (fit.draws, again))
    assert a == b


def test_gauge(fit):
    rows = posterior.long_effects(fit.draws.where("draw < 3 and chain = 0"))
    for name in ("age", "period", "cohort"):
        g = posterior.gauge(rows, 2, name, "draw")
        assert abs(posterior.slopes(g.where(F.col("param") == name), "draw").agg(F.max(F.abs("slope"))).first()[0]) < 1e-9
        assert g.groupBy("draw", "param").agg(F.sum("value").alias("s")).agg(F.max(F.abs("s"))).first()[0] < 1e-9


@pytest.mark.parametrize("q", [[0.5], [0.1, 0.9], [0.05, 0.35, 0.5, 0.95]])
def test_effects_and_predictions(fit, q):
    assert fit.effects(q).count() == len(q) * (5 + 8 + 16)
    p = fit.predict(2, probabilities=q)
    assert p["rates"].count() == len(q) * 5 * 10 and p["cases_period"].count() == len(q) * 8


def test_effects_mean_and_plot(fit):
    assert fit.effects(None).count() == 29 and fit.plot_data().where("line = 'solid'").count() == 29
    assert "DIC" in fit.describe() and "Gamma" in fit.settings()
    ranges = {(r.param, r.panel): r for r in posterior.plot_ranges(fit.plot_data()).collect()}
    assert set(ranges) == {("age", "effect"), ("period", "effect"), ("cohort", "effect")} and ranges["cohort", "effect"].last == 16


def test_one_sampler_run_serves_all(fit):
    for out in (fit.convergence(), fit.information(), fit.effects(), fit.predict(1)["rates"]):
        assert "FlatMapGroupsInPandas" not in out._jdf.queryExecution().executedPlan().toString()


def test_one_chain(cells):
    f = api.fit(cells, ModelSpec("rw1", None, None), 5, 8, 2, Mcmc(20, 10, 1, 1))
    c = f.convergence().first()
    assert c.max_psrf is None and c.converged is False and "unknown" in f.describe()


def test_failed_chains_are_reported(cells):
    zeros = cells.withColumns({"cases": F.lit(0).cast("long"), "population": F.lit(0).cast("long")})
    wild = ModelSpec("rw1", None, None, hyper={"age": (1e300, 1e-300)})
    with pytest.warns(UserWarning, match="chains failed"):
        f = api.fit(zeros, wild, 5, 8, 2, Mcmc(20, 10, 1, 2))
    assert len(f.failed) == 2 and "failed" in f.describe() and f.convergence().first().converged is False


def test_cells_outside_the_diagram(cells):
    for column, value in (("age_idx", 0), ("age_idx", 6), ("period_idx", 9), ("period_idx", None)):
        wrong = cells.withColumn(column, F.when((F.col("age_idx") == 1) & (F.col("period_idx") == 1), F.lit(value)).otherwise(F.col(column)).cast("int"))
        with pytest.raises(ValueError, match="outside"):
            api.fit(wrong, ModelSpec(), 5, 8, 2, FAST)


def test_wide_matrices(spark):
    c = lexis.cells_from_matrices(spark, [[1, 2], [3, 4], [5, 6]], [[9, 9]] * 3, 1)
    assert [tuple(r) for r in lexis.matrix(c, "cases", 2).orderBy("period_idx").collect()] == [(1, 1, 2), (2, 3, 4), (3, 5, 6)]
    assert [tuple(r) for r in lexis.matrix(c, "cases", 2, by_period=False).orderBy("age_idx").collect()] == [(1, 1, 3, 5), (2, 2, 4, 6)]


def test_example_data(spark):
    from cohortlake.sources.example import example

    e = example()
    cells = e.cells(spark)
    assert (len(e.cases), len(e.cases[0]), len(e.period_covariate), len(e.cohort_covariate)) == (10, 8, 10, 45)
    assert cells.count() == 80 and cells.agg(F.max("cohort_idx")).first()[0] == 45 and lexis.validate(cells, 8, 10, 5).first().n_more_cases == 0
    f = api.fit(cells, ModelSpec("rw1", "rw1", None), 8, 10, 5, Mcmc(40, 20, 1, 2), period_covariate=e.period_covariate)
    assert f.effects(None).count() == 18


def test_work_tables_need_a_shared_folder():
    from types import SimpleNamespace

    from cohortlake import storage

    session = lambda folder: SimpleNamespace(conf=SimpleNamespace(get=lambda key, default: folder), sparkContext=SimpleNamespace(master="spark://far:7077"))
    assert storage.work_dir(session("hdfs://shared/")) == "hdfs://shared"
    with pytest.raises(RuntimeError):
        storage.work_dir(session(None))


def test_stream_refits_all_closed_cells(spark, tmp_path):
    seen = []
    run = refit_on_batch(lambda df: seen.append(df.count()), str(tmp_path / "closed"))
    a = spark.createDataFrame([(1, 2)], "age_idx int, cases bigint")
    for number, batch in ((0, a), (1, a.unionAll(a)), (1, a), (2, a.limit(0))):
        run(batch, number)
    assert seen == [1, 3, 2]


def test_heterogeneity_and_overdispersion(cells):
    f = api.fit(cells, ModelSpec("rw2+het", "rw1", None, overdisp=True), 5, 8, 2, Mcmc(60, 30, 1, 2))
    d = f.draws.first()
    assert len(d.age) == len(d.age2) == 5 and d.cohort is None and d.overdispersion > 0 and d.age2_parameter > 0
    assert f.predict(1)["rates"].count() == 3 * 5 * 9


def test_covariate(cells):
    f = api.fit(cells, ModelSpec("rw1", "rw1", None), 5, 8, 2, Mcmc(60, 30, 1, 2), period_covariate=[1.0, 2, 3, 4, 5, 6, 7, 8])
    assert f.effects(None).count() == 13
    curves = f.plot_data().collect()
    assert {(r.param, r.panel) for r in curves} == {("age", "effect"), ("period", "effect"), ("period", "relative"), ("period", "covariate")}
    value = {(r.panel, r.idx): r.value for r in curves if r.param == "period" and r.line == "solid"}
    assert all(abs(value["relative", i] * value["covariate", i] - value["effect", i]) < 1e-9 for i in range(1, 9))
    with pytest.raises(ValueError):
        f.predict(1)
    with pytest.raises(ValueError):
        api.fit(cells, ModelSpec("rw1", "rw1", None), 5, 8, 2, FAST, period_covariate=[1.0])


def test_rejected_input(cells):
    with pytest.raises(ValueError):
        api.fit(cells.withColumn("cases", F.col("population") + 1), ModelSpec(), 5, 8, 2, FAST)
    with pytest.raises(ValueError):
        api.fit(cells, ModelSpec(), 5, 8, 8, FAST)
    with pytest.raises(ValueError):
        api.fit(cells, ModelSpec(), 5, 8, 2, FAST, method="iwls")


def test_selection(cells, spark):
    s = select_model(cells, 5, 8, 2, pinned={"cohort": None}, overdispersion=False, screen=Mcmc(200, 100, 1, 2), final=Mcmc(60, 30, 1, 2), psrf_tol=2.0, hyper={"age": (1.0, 0.1)})
    assert s.path[0] == "rw1|rw1|-|plain" and s.table.where("selected").count() == 1 and "<--" in s.show()
    r = s.table.where("selected").first()
    assert abs(r.pd + r.mean_deviance - r.dic) < 1e-6 and r.max_psrf > 0.9 and r.seconds > 0 and s.draws.count() == 2 * 30
    with pytest.raises(ValueError, match="one series"):
        select_model(cells.unionByName(cells.withColumn("series_id", F.lit("t"))), 5, 8, 2)
    t = spark.createDataFrame([("a", 1.0, False), ("b", 2.0, True), ("c", None, True)], "spec_id string, dic double, converged boolean")
    assert [r.spec_id for r in rank(t).where("selected").collect()] == ["b"]


def test_selection_without_convergence(cells):
    with pytest.warns(UserWarning, match="converged"):
        s = select_model(cells, 5, 8, 2, pinned={"period": None, "cohort": None}, overdispersion=False, screen=Mcmc(12, 6, 1, 2), refit=False, psrf_tol=0.5)
    assert not s.converged and s.path == [s.best.key] and s.draws is None and "Warning" in s.show()


def test_simulation_length(spark):
    with pytest.raises(ValueError):
        expected(spark, 0.0, [0.0, 0.0], [0.0] * 3, [0.0] * 3, 2, 10)


def test_streaming_equals_batch(spark):
    path = "/root/testdata/sf0.001"
    schema = spark.read.parquet(f"{path}/events.parquet").schema
    stream = spark.readStream.schema(schema).parquet(f"{path}/events*.parquet")
    cells = streaming_cells(stream, F.col("user_id") % 10 + 1, F.col("event_type") == "error")
    q = cells.writeStream.outputMode("complete").format("memory").queryName("cells_now").trigger(availableNow=True).start()
    q.awaitTermination(120)
    batch = streaming_cells(spark.read.parquet(f"{path}/events.parquet"), F.col("user_id") % 10 + 1, F.col("event_type") == "error")
    assert sorted(spark.table("cells_now").collect()) == sorted(batch.collect())
    seen = []
    refit_on_batch(lambda df: seen.append(df.count()))(batch, 0)
    assert seen == [batch.count()]
