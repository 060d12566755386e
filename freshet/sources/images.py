"""Stored images with provenance, and ensemble manifests."""

from __future__ import annotations

import dataclasses
import json
from collections.abc import Mapping, Sequence
from dataclasses import asdict, dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession

#: Names of the scoring rules.
DRY_RULE, WET_RULE, SUPPLEMENT_RULE = "gamma2-ssi+open-end-events+in-window-rates", "q95-pot+critical-pulse+one-day-rise", "truncation-flags+event-totals+flow-regime"
#: First days of the reference record and of a scenario, months before the scored window.
REFERENCE_START, SCENARIO_START, CUT_MONTHS = "1945-01-01", "1999-12-01", 6
#: What has to be equal, in the order in which it is looked at.
LEGS = ("scenario_start", "cut_months", "dry_rule", "wet_rule", "supplement_rule")


@dataclass(frozen=True)
class Provenance:
    """What an image was scored with; images with different values must not be mixed."""

    reference_start: str = REFERENCE_START
    cut_months: int = CUT_MONTHS
    dry_rule: str = DRY_RULE
    wet_rule: str = WET_RULE
    supplement_rule: str = SUPPLEMENT_RULE
    scenario_start: str = SCENARIO_START


def save_image(image: DataFrame, path: str, provenance: Provenance, axes: Sequence[str], chosen_axes: Sequence[str] | None = None, supplement: Sequence[str] = ()) -> str:
    """Writes the image's rows and a one-row sidecar; all axes are the chosen ones by default."""
    missing = {*axes, *supplement} - set(image.columns)
    if missing:
        raise ValueError(f"the image lacks the columns {sorted(missing)}")
    image.select("scenario_id", *axes, *supplement).write.mode("overwrite").parquet(f"{path}/rows")
    meta = asdict(provenance) | {"axes": list(axes), "chosen_axes": list(chosen_axes or axes), "supplement": list(supplement)}
    image.sparkSession.createDataFrame([(json.dumps(meta),)], "meta string").coalesce(1).write.mode("overwrite").parquet(f"{path}/meta")
    return path


def check_provenance(meta: Mapping[str, Any], expected: Provenance, path: str = "") -> None:
    """Raises, naming the first value that fails: the reference's start has to be there, those of ``LEGS`` have to be there and equal, with or without a supplement."""
    if meta.get("reference_start") is None:
        raise ValueError(f"{path}: the image does not name its reference_start")
    for leg in LEGS:
        if meta.get(leg) != getattr(expected, leg):
            raise ValueError(f"{path}: {leg} is {meta.get(leg)!r}, not {getattr(expected, leg)!r}")


def load_image(spark: SparkSession, path: str, expected: Provenance | None = None) -> tuple[DataFrame, dict[str, Any]]:
    """The rows and the sidecar, after its check."""
    meta = json.loads(spark.read.parquet(f"{path}/meta").first().meta)
    check_provenance(meta, expected or Provenance(), path)
    return spark.read.parquet(f"{path}/rows"), meta


@dataclass(frozen=True)
class Manifest:
    """Provenance of one staged ensemble."""

    design: str
    draw: int
    n_realizations: int
    realization_years: int
    master_seed: int
    realization_global_indices: Sequence[int]
    forcing_hash: str
    hazard_axes: Sequence[str]
    screen_result: Mapping[str, Any] = field(default_factory=dict)
    slug: str = ""
    created: str = ""
    source_kind: str = ""
    start_date: str = ""
    notes: str = ""

    def to_json(self) -> str:
        return json.dumps(asdict(self), indent=2, sort_keys=True)

    def write(self, spark: SparkSession, path: str) -> str:
        spark.createDataFrame([(self.to_json(),)], "value string").coalesce(1).write.mode("overwrite").text(path, lineSep="\0")
        return path

    @classmethod
    def read(cls, spark: SparkSession, path: str) -> Manifest:
        data = json.loads(spark.read.text(path, wholetext=True).first().value.rstrip("\0"))
        return cls(**{k: v for k, v in data.items() if k in {f.name for f in dataclasses.fields(cls)}})
