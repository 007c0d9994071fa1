import pytest

from kinetable.operators.mixture import dedup_keep_first, lookup_excludes
from kinetable.registry import Embodiment, Registry, specs_frame

TEXT = """[{"name": "two_arm", "stride": 3, "state_keys": ["state_pose"], "action_keys": ["action_pose", "action_grip"],
  "configs": [{"key": "action_pose", "rep": "rel_xyz_rot6d", "state_key": "state_pose"}, {"key": "action_grip"}]},
 {"name": "drone", "stride": 1}]"""


def test_registry_table(spark):
    reg = Registry.from_json(TEXT)
    rows = {r.embodiment: r for r in reg.frame(spark).collect()}
    assert rows["two_arm"].stride == 3 and rows["two_arm"].configs[0].rep == "rel_xyz_rot6d"
    assert rows["drone"].configs == [] and reg["two_arm"].deltas(4)["action"] == [0, 3, 6]
    assert reg["two_arm"].deltas(3, 2)["video"] == [0, 2, 4]
    with pytest.raises(ValueError, match="unknown embodiment"):
        reg["nope"]
    with pytest.raises(ValueError, match="stride"):
        Embodiment("x", 0)


def test_specs_keep_the_first_and_share_excludes(spark):
    specs = specs_frame(spark, [
        {"path": "a", "embodiment": "x", "mix_ratio": 1.0, "exclude_splits": ["fail"]},
        {"path": "a", "embodiment": "x", "mix_ratio": 9.0}, {"path": "b", "embodiment": "x", "mix_ratio": 2.0, "data_split_override": "full"},
    ])
    first = dedup_keep_first(specs, ["path", "embodiment"], "spec_order")
    assert {r.path: r.mix_ratio for r in first.collect()} == {"a": 1.0, "b": 2.0}
    got = {r.path: r.exclude_splits for r in lookup_excludes(spark.createDataFrame([("a",), ("c",)], "path string"), specs).collect()}
    assert got == {"a": ["fail"], "c": []}
