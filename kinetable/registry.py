"""Embodiment registry and mixture specs as configuration and as tables."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession

from kinetable.operators.actions import ActionKey
from kinetable.operators.windows import delta_grid
from kinetable.session import local_table

REGISTRY_SCHEMA = (
    "embodiment string, stride int, normalization string, state_keys array<string>, action_keys array<string>, "
    "passthrough_keys array<string>, configs array<struct<key:string,rep:string,state_key:string,in_fmt:string,"
    "ref_fmt:string,in_order:string,ref_order:string>>"
)
SPEC_SCHEMA = (
    "spec_order int, path string, embodiment string, mix_ratio double, exclude_splits array<string>, "
    "data_split_override string, test_split_ratio_override double"
)


@dataclass(frozen=True)
class Embodiment:
    """Stride, ordered keys and per-key action representation of one robot."""

    name: str
    stride: int
    state_keys: tuple[str, ...] = ()
    action_keys: tuple[str, ...] = ()
    configs: tuple[ActionKey, ...] = ()
    passthrough_keys: tuple[str, ...] = ()
    normalization: str = "mean_std"

    def __post_init__(self):
        if self.stride < 1:
            raise ValueError(f"stride of {self.name} must be at least 1")
        unknown = {c.key for c in self.configs} - set(self.action_keys)
        if unknown:
            raise ValueError(f"{self.name} configures keys that are not in its action order: {sorted(unknown)}")

    def deltas(self, num_frames: int, stride: int | None = None) -> dict[str, list[int]]:
        """Frame offsets per modality; ``stride`` overrides the registered one."""
        step = self.stride if stride is None else stride
        if step < 1:
            raise ValueError(f"stride must be at least 1, got {step}")
        return delta_grid(num_frames, step)


@dataclass
class Registry:
    """Named embodiments, loadable from a JSON list."""

    entries: dict[str, Embodiment] = field(default_factory=dict)

    @classmethod
    def from_json(cls, text: str) -> "Registry":
        made = {}
        for e in json.loads(text):
            configs = tuple(ActionKey(**c) for c in e.get("configs", ()))
            kw = {k: tuple(v) if isinstance(v, list) else v for k, v in e.items() if k != "configs"}
            made[e["name"]] = Embodiment(**kw, configs=configs)
        return cls(made)

    def __getitem__(self, name: str) -> Embodiment:
        if name not in self.entries:
            raise ValueError(f"unknown embodiment {name!r}; available: {sorted(self.entries)}")
        return self.entries[name]

    def frame(self, spark: SparkSession) -> DataFrame:
        """One row per embodiment; a configuration table, not data."""
        es = list(self.entries.values())
        return local_table(
            spark,
            {
                "embodiment": [e.name for e in es], "stride": [e.stride for e in es],
                "normalization": [e.normalization for e in es], "state_keys": [list(e.state_keys) for e in es],
                "action_keys": [list(e.action_keys) for e in es], "passthrough_keys": [list(e.passthrough_keys) for e in es],
                "configs": [[asdict(c) for c in e.configs] for e in es],
            },
            REGISTRY_SCHEMA,
        )


def specs_frame(spark: SparkSession, specs: Sequence[dict]) -> DataFrame:
    """Mixture specs in list order; absent overrides are null."""
    names = ("path", "embodiment", "mix_ratio", "exclude_splits", "data_split_override", "test_split_ratio_override")
    columns = {n: [s.get(n) for s in specs] for n in names}
    return local_table(spark, {"spec_order": list(range(len(specs))), **columns}, SPEC_SCHEMA)
