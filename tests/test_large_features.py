"""Tables that are exploded from few rows are many times what the planner takes them for."""

from paratope.operators import features
from paratope.plans import complexes
from tests.conftest import SF


def test_exploded_tables_are_not_broadcast(spark):
    def gathered(df):
        plan = df._jdf.queryExecution().executedPlan().toString()
        return plan.count("BroadcastExchange")

    t = complexes.complexes(spark, SF)
    assert gathered(features.helix_confidence(t["atom"], t["residue"], t["jobs"])) == 0
    assert gathered(t["pae"]) == 0
    assert gathered(features.loop_confidence(t["atom"], t["imgt"])) == 1  # the table of regions


def test_cells_of_pairs_stay_where_they_are(spark):
    """Joins whose other side is in more parts than four a core don't shuffle the contacts again."""
    from paratope.plans import complexes

    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "37")
    try:
        other = spark.range(10).selectExpr("cast(id AS string) AS job_name").groupBy("job_name").count()
        joined = complexes.complexes(spark, "/root/testdata/sf0.001")["contact"].join(other.hint("merge"), "job_name")
        plan = joined._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert "SortMergeJoin" in plan and plan.count("ENSURE_REQUIREMENTS") == 1
