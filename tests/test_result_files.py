"""Rows of a result file take their own id along only."""

import json

from quillmark.session import fresh_path
from quillmark.sources import results as rs


def test_a_row_does_not_carry_all_ids(spark):
    path = fresh_path(spark, "ids")
    tree = {"m": {"f": {"d": {"logits": [[0.5], [1.5], [2.5]], "label_ids": [0, 0, 0], "row_ids": [7, None]},
                        "e": {"logits": [[0.5]], "label_ids": [0], "row_ids": [4, 5, 6]}}}}
    spark.createDataFrame([(json.dumps(json.dumps(tree)),)], "value string").coalesce(1).write.text(path)
    got = rs.read_json(spark, path)
    assert sorted((r.dataset, r.row_id) for r in got.collect()) == [("d", 1), ("d", 2), ("d", 7), ("e", 4)]
    assert "element_at" not in got._jdf.queryExecution().optimizedPlan().toString()  # ids are zipped, not looked up
