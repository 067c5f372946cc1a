"""What the audits join several times is worked out once."""

from diegrid.plans.duplicate_queries import duplicates


def test_images_and_members_are_only_read(spark):
    for df in duplicates(spark, "/root/testdata/sf0.001"):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "Join" not in plan and "Aggregate" not in plan and df.count() > 0
