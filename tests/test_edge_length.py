"""The edge length check looks at every pair of correspondences, whatever their ids."""

import pytest

from pointloom.operators import registration as R
from pointloom.plans.queries import QUERIES


@pytest.mark.parametrize("block", [2048, 5])
@pytest.mark.parametrize(("gap", "passed"), [(8.0, True), (0.1, False)])
def test_pairs_of_large_ids_count(spark, tmp_path, monkeypatch, gap, passed, block):
    """With a small gap, the last two points meet the same target; small blocks hold them apart."""
    monkeypatch.setattr(R, "EDGE_BLOCK", block)
    places = [4.0 * i for i in range(50)]
    rows = [(i, [x, 0.0, 0.0, 1.0, 0.0, 0.0]) for i, x in enumerate([*places, places[-1] + gap])]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    assert [r.passed for r in QUERIES["check_edge_length"](spark, str(tmp_path)).collect()] == [passed]
