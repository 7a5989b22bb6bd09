"""Physical-plan properties that matter at scale."""

import __spark_entry__ as entry
from retentio.sources.customers import customer_table


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_customer_table_pushes_the_cut_and_has_no_expand(spark, sf_small):
    df = customer_table(spark, sf_small)
    plan = df._jdf.queryExecution().explainString(
        spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "Expand" not in plan
    assert "LessThanOrEqual(o_orderdate" in plan and "GreaterThan(o_orderdate" in plan
    assert "ReadSchema: struct<l_orderkey:bigint,l_quantity:double,l_discount:double,l_returnflag:string>" in plan


def test_flagship_prunes_and_pushes_down(spark, sf_small):
    spark.catalog.clearCache()     # cached frames over the same table would replace the scan
    df = entry.entry(spark)
    plan = df._jdf.queryExecution().explainString(
        spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "PushedFilters: [IsNotNull(country)]" in plan
    assert "TakeOrderedAndProject" in plan
    assert "customer_id" not in plan.split("ReadSchema:")[1].split("\n")[0]


def test_no_nested_loop_or_cartesian_joins(spark, sf_small):
    for name in ["m6_rule_scoring", "a5_country_risk", "e1_e5_rule_evaluation", "e6_permutation_importance",
                 "w3_risk_signals", "w4_what_if", "l1_stratified_split", "a9_segment_profile"]:
        plan = _plan(entry.queries()[name](spark, sf_small))
        assert "BroadcastNestedLoopJoin" not in plan and "CartesianProduct" not in plan, name
