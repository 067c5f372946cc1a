"""The cascade's paths are worked out once, and embeddings in one row group are dealt to all tasks."""

from diegrid.plans import catalog
from diegrid.plans.policy_queries import judged
from diegrid.sources import views as V

SF = "/root/testdata/sf0.001"


def test_report_reads_stored_rows(spark):
    plan = catalog.QUERIES["cascade_report"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "embedding" not in plan and "features" not in plan


def test_one_row_group_is_many_tasks(spark):
    assert V.embeddings(spark, SF, dealt=True).rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_rules_at_hand_judge_alike(spark):
    from diegrid.plans.policy_queries import fold_rules
    rows = [sorted(map(str, judged(spark, SF, "fold", tempered=True, rules=rules).select("vec_id", "status", "second_status").collect()))
            for rules in (None, fold_rules(spark, SF).localCheckpoint())]
    assert rows[0] == rows[1]
