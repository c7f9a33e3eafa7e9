"""Results kept by the fingerprint of inputs and parameters."""

from quillmark.session import fresh_path
from quillmark.sources import ingest as ing


def test_built_once_until_something_changes(spark):
    path, built = fresh_path(spark, "input"), []

    def get(*parameters):
        def build():
            built.append(parameters)
            return spark.read.parquet(path).groupBy().count()
        return ing.kept(spark, "count", [path], parameters, build).first()[0]

    spark.range(5).write.parquet(path)
    assert (get(1), get(1), len(built)) == (5, 5, 1)
    assert (get(2), len(built)) == (5, 2)
    spark.range(3).write.mode("append").parquet(path)
    assert (get(1), get(1), len(built)) == (8, 8, 3)
