"""Settings of the light-curve operators. Values are checked when set, also after construction."""

from __future__ import annotations

from dataclasses import dataclass, field

from lyraflux.constants import DM_EDGES, DT_EDGES, FILTER_BANDS, KNOWN_ALGORITHMS, MATCH_RADIUS_ARCSEC


class _Checked:
    """Runs ``check`` after every assignment once all fields are there."""

    def __setattr__(self, name: str, value) -> None:
        before = getattr(self, name, None)
        object.__setattr__(self, name, value)
        if getattr(self, "_ready", False):
            try:
                self.check()
            except ValueError:
                object.__setattr__(self, name, before)
                raise

    def __post_init__(self) -> None:
        self.check()
        object.__setattr__(self, "_ready", True)

    def check(self) -> None: ...


@dataclass
class IngestConfig(_Checked):
    bands: tuple[str, ...] = ("g", "r", "i")
    program_ids: tuple[int, ...] = (1, 2, 3)
    max_time: float | None = None
    epoch_cutoff: bool = False  # drop single epochs beyond max_time too, not only documents without an earlier one
    min_cadence_days: float = 5.0 / 1440.0
    min_nobs: int = 50

    def check(self) -> None:
        if unknown := set(self.bands) - set(FILTER_BANDS.values()):
            raise ValueError(f"unknown bands {sorted(unknown)}")


@dataclass
class PeriodConfig(_Checked):
    algorithms: tuple[str, ...] = ("CE", "AOV", "LS", "MHF", "FPW")
    min_period: float = 0.003472
    max_period: float = 10.0
    samples_per_peak: int = 10
    top_n: int = 10
    chunks_per_peak: int = 3

    def check(self) -> None:
        # a leading E names the same method run on another device
        plain = tuple(a[1:] if a not in KNOWN_ALGORITHMS and a.startswith("E") else a for a in self.algorithms)
        if unknown := set(plain) - set(KNOWN_ALGORITHMS):
            raise ValueError(f"unknown algorithms {sorted(unknown)}")
        object.__setattr__(self, "algorithms", plain)
        if not 0 < self.min_period < self.max_period:
            raise ValueError("periods have to be positive, the least below the greatest")


@dataclass
class HistogramConfig(_Checked):
    dm_edges: tuple[float, ...] = DM_EDGES
    dt_edges: tuple[float, ...] = DT_EDGES

    def check(self) -> None:
        for edges in (self.dm_edges, self.dt_edges):
            if len(edges) < 2 or any(a >= b for a, b in zip(edges, edges[1:], strict=False)):
                raise ValueError("edges have to be two or more and to increase")
        if self.dt_edges[0] < 0:
            raise ValueError("the first time edge can't be negative")


@dataclass
class SplitConfig(_Checked):
    test: float = 0.1
    validation: float = 0.1
    seed: int = 42

    def check(self) -> None:
        if not (0 < self.test < 1 and 0 < self.validation < 1 and self.test + self.validation < 1):
            raise ValueError("fractions lie between 0 and 1, their sum below 1")


@dataclass
class TierConfig(_Checked):
    high: float = 0.9
    medium: float = 0.7

    def check(self) -> None:
        if not 0 <= self.medium < self.high <= 1:
            raise ValueError("thresholds lie between 0 and 1, high above medium")


@dataclass
class Config:
    ingest: IngestConfig = field(default_factory=IngestConfig)
    period: PeriodConfig = field(default_factory=PeriodConfig)
    histogram: HistogramConfig = field(default_factory=HistogramConfig)
    split: SplitConfig = field(default_factory=SplitConfig)
    tiers: TierConfig = field(default_factory=TierConfig)
    min_observations: int = 50
    match_radius_arcsec: float = MATCH_RADIUS_ARCSEC


def load_config(path: str) -> Config:
    """Settings from a YAML file with the sections above; what it leaves out keeps its default, unknown keys are ignored."""
    import yaml

    with open(path, encoding="utf-8") as f:
        given = yaml.safe_load(f) or {}
    out = Config()
    for name, value in given.items():
        if isinstance(value, dict) and hasattr(out, name):
            own = getattr(out, name)
            known = {k: tuple(v) if isinstance(v, list) else v for k, v in value.items() if k in type(own).__dataclass_fields__}
            setattr(out, name, type(own)(**{k: getattr(own, k) for k in type(own).__dataclass_fields__} | known))
        elif hasattr(out, name):
            setattr(out, name, value)
    return out
