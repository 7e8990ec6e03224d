"""Leave-one-block-out ridge on odd tables."""

import math

from plumbline.operators import inference as I

FIELDS = "id long, b string, z array<double>, y array<double>"


def rows(n):
    return [(i, str(i % 3), [math.sin(i), math.cos(i * i), 1.0], [float(i % 7)]) for i in range(n)]


def predicted(spark, data, parts):
    found = I.ridge_out_of_block(spark.createDataFrame(data, FIELDS).repartition(parts), "b", "id", "z", "y").collect()
    return {r["id"]: None if r["predicted"] is None else round(r["predicted"][0], 9) for r in found}


def test_partitions_without_rows_change_nothing(spark):
    assert predicted(spark, rows(12), 60) == predicted(spark, rows(12), 1)


def test_unusable_rows_train_nothing(spark):
    odd = [(90, "0", None, [1.0]), (91, "0", [1.0], [1.0]), (92, "1", [1.0, None, 1.0], [1.0]), (93, "1", [1.0, 1.0, float("nan")], [1.0]), (94, "2", [1.0, 1.0, 1.0], None)]
    found = predicted(spark, rows(12) + odd + [(95, None, [1.0, 1.0, 1.0], [1.0])], 3)
    assert found == predicted(spark, rows(12), 3) | {i: None for i in range(90, 95)}


def test_empty_table(spark):
    assert predicted(spark, [], 2) == {}
