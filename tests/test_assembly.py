import pytest

from kinetable.operators import quality as Q


def test_assembly_keeps_common_keys_and_rejects_repeats(spark):
    a = spark.createDataFrame([(1, "a"), (2, "b")], "key long, x string")
    b = spark.createDataFrame([(2, "c"), (3, "d")], "key long, y string")
    assert [tuple(r) for r in Q.assemble_samples({"a": a, "b": b}).collect()] == [(2, "b", "c")]
    assert {tuple(r) for r in Q.missing_parts({"a": a, "b": b}).collect()} == {(1, "b"), (3, "a")}
    with pytest.raises(Exception, match="occurs twice"):
        Q.assemble_samples({"a": a.union(a), "b": b}).collect()
