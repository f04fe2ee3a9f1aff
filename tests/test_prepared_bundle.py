import pytest

from chronolex.plans.base import Tables
from chronolex.plans.workflows import inc_prepare_bundle


class Changing(Tables):
    """Documents get another row after the body is read."""

    reads = 0

    @property
    def documents(self):
        self.reads += 1
        rows = self.spark.read.parquet(f"{self.sf_dir}/documents.parquet")
        return rows if self.reads < 3 else rows.limit(1).unionByName(rows)


def test_a_change_of_the_base_stops_the_run(spark, sf_dir):
    with pytest.raises(RuntimeError, match="changed"):
        inc_prepare_bundle(Changing(spark, sf_dir)).collect()
