"""Settings of a build, read from YAML or JSON."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, fields, replace

from pyspark.sql import SparkSession


@dataclass(frozen=True)
class Settings:
    """Every field is optional in the file."""

    enricher_llm: str = "fake"
    labeler_llm: str = "fake"
    labeler_llm_per_level: dict[str, str] = field(default_factory=dict)
    embedding_model: str = "fake"
    # The defaults of a build.
    embedding_dim: int = 64
    enrich_batch_size: int = 20
    cache_dir: str = "data/cache"
    fanout: dict[str, tuple[int, int]] = field(default_factory=lambda: {"domain": (2, 20), "category": (2, 10), "group": (2, 10), "tool": (3, 8)})
    thresholds: dict[str, float] = field(default_factory=lambda: {"near_dup": 0.97, "group": 0.30, "category": 0.45, "domain": 0.70})

    def labeler(self, level: str | None) -> str:
        """The provider that labels nodes of a level."""
        return self.labeler_llm_per_level.get(level or "", self.labeler_llm)


def from_dict(given: dict) -> Settings:
    """Unknown keys are ignored, thresholds add to the defaults, a fanout takes their place."""
    base = Settings()
    known = {k: v for k, v in given.items() if k in {f.name for f in fields(Settings)}}
    for name in ("embedding_dim", "enrich_batch_size"):
        if name in known:
            known[name] = int(known[name])
    if "fanout" in known:
        known["fanout"] = {k: tuple(v) for k, v in known["fanout"].items()}
    if "thresholds" in known:
        known["thresholds"] = base.thresholds | {k: float(v) for k, v in known["thresholds"].items()}
    levels = known.pop("labeler_llm_per_level", None)
    if isinstance(levels, dict):
        known["labeler_llm_per_level"] = {str(k): str(v) for k, v in levels.items()}
    return replace(base, **known)


def load(spark: SparkSession, path: str) -> Settings:
    """Settings of a .json file, or of a YAML file where a YAML reader is installed; an empty file gives the defaults."""
    rows = spark.read.text(path, wholetext=True).collect()  # one small file
    text = rows[0]["value"] if rows else ""
    if path.endswith(".json"):
        return from_dict(json.loads(text or "{}"))
    import yaml

    return from_dict(yaml.safe_load(text) or {})
