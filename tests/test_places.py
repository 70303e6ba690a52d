"""Points at one place share their work: copies of the places add rows to the result, and no geometry."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from orogen.operators import editing as E

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Two folders: 1,500 customers at a place each, and three customers at each of these places."""
    once, thrice = (str(tmp_path_factory.mktemp(n)) for n in ("once", "thrice"))
    customers = spark.read.parquet(f"{SF}/customer.parquet")
    for d, n in ((once, 1), (thrice, 3)):
        copies = spark.range(n).select((F.col("id") * 2700).alias("more"))
        customers.crossJoin(copies).withColumn("c_custkey", F.col("c_custkey") + F.col("more")).drop("more").write.parquet(f"{d}/customer.parquet")
        for t in ("supplier", "nation"):
            spark.read.parquet(f"{SF}/{t}.parquet").write.parquet(f"{d}/{t}.parquet")
    return once, thrice


def made(plan):
    """Rows that the plan's generators made, through which costly formulas go."""
    kind = plan.getClass().getSimpleName()
    if kind == "AdaptiveSparkPlanExec":
        return made(plan.executedPlan())
    if kind.endswith("QueryStageExec"):
        return made(plan.plan())
    own = plan.metrics().apply("numOutputRows").value() if kind == "GenerateExec" else 0
    below = plan.children()
    return own + sum(made(below.apply(i)) for i in range(below.size()))


@pytest.mark.parametrize("name", ["weights", "cycle_hits", "primitive_hits", "nearest_segment", "point_evaluate", "point_in_polygon"])
def test_points_at_one_place_share_their_work(spark, tables, monkeypatch, name):
    met, nearby = [], E.nearby
    monkeypatch.setattr(E, "nearby", lambda pointers, *rest: met.append(pointers.count()) or nearby(pointers, *rest))
    rows, work = [], []
    for d in tables:
        df = __spark_entry__.queries()[name](spark, d)
        rows.append(sorted(map(tuple, df.collect()), key=repr))
        work.append(made(df._jdf.queryExecution().executedPlan()))
    assert rows[0] and rows[1] == sorted(((r[0] + 2700 * k, *r[1:]) for r in rows[0] for k in range(3)), key=repr)
    assert work[0] == work[1] and set(met) <= {1500}


def test_weights_round_as_their_sql(spark, tmp_path):
    """The distance is the double next to 32.1515625, and a little less than it."""
    import duckdb

    for t, key, value in (("customer", "c_custkey", 174), ("supplier", "s_suppkey", 3482)):
        spark.read.parquet(f"{SF}/{t}.parquet").limit(1).withColumn(key, F.lit(value).cast("long")).write.parquet(f"{tmp_path}/{t}.parquet")
        duckdb.sql(f"CREATE OR REPLACE VIEW {t} AS FROM '{tmp_path}/{t}.parquet/*.parquet'")
    spark.read.parquet(f"{SF}/nation.parquet").where("false").write.parquet(f"{tmp_path}/nation.parquet")
    duckdb.sql(f"CREATE OR REPLACE VIEW nation AS FROM '{SF}/nation.parquet' WHERE false")
    want = duckdb.sql(__spark_entry__.oracle_sql()["weights"]).fetchall()
    assert [tuple(r) for r in __spark_entry__.queries()["weights"](spark, str(tmp_path)).collect()] == want == [(174, "area-3482", 1.0, 32.151562)]
