"""Predictions are not shuffled by task."""

from plumbline.operators import certificates as C


def test_predictions_meet_group_statistics_without_a_shuffle(spark):
    preds = spark.createDataFrame([("t", f"m{i % 3}", float(i % 5), float(i % 7)) for i in range(60)], "task string, model_version string, y_true double, y_pred double")
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = C.ceiling_certificates(preds)._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)
    joins = [line for line in plan.splitlines() if "Join" in line and "task_residual_floor" not in line]
    assert sum("rightHint=(strategy=broadcast)" in line for line in joins) >= 2
