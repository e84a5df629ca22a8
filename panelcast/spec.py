"""Settings of one panel: which columns play which role, and the constants of the pipeline."""

from __future__ import annotations

from dataclasses import dataclass, replace

# The simulation table's column names and the calendar constants.
STATIC_COVARIATES = (
    "eir", "dn0_use", "dn0_future", "Q0", "phi_bednets", "seasonal", "routine",
    "itn_use", "irs_use", "itn_future", "irs_future", "lsm",
)
GATED_COVARIATES = ("dn0_future", "itn_future", "irs_future", "lsm", "routine")
DAYS_PER_YEAR = 365
SPLITS = ("train", "validate", "test")
TRAIN_SHARE, VALIDATE_SHARE = 0.7, 0.15
METRIC_EPS = 1e-7
MODES = ("prevalence", "cases")


@dataclass(frozen=True)
class PanelSpec:
    """Column roles and constants; every operator takes one of these.

    ``mode`` picks the target: ``prevalence`` is a ratio of sums in [0, 1], ``cases`` a rate per
    1000 units of exposure that also carries its exposure along as the row weight.
    """

    mode: str = "prevalence"

    # roles
    param: str = "parameter_index"
    sim: str = "simulation_index"
    global_id: str = "global_index"
    day: str = "timesteps"
    prevalence_counts: tuple[str, str] = ("n_detect_lm_0_1825", "n_age_0_1825")
    cases_counts: tuple[str, str] = ("n_inc_clinical_0_36500", "n_age_0_36500")
    statics: tuple[str, ...] = STATIC_COVARIATES
    gated: tuple[str, ...] = GATED_COVARIATES

    # selection
    param_limit: int | None = None
    sims_per_param: int | None = None
    min_prevalence: float = 0.01
    min_cases: float = 0.0
    seed: int = 42

    # time
    burn_in: int = 6 * DAYS_PER_YEAR
    intervention: int = 9 * DAYS_PER_YEAR
    window: int = 7
    cyclic_time: bool = False

    # sequences and losses
    lookback: int = 30
    train_stride: int = 1
    batch_size: int = 4096
    eps: float = 1e-5
    loss_space: str = "natural"
    slope_weight: float = 0.05
    curvature_weight: float = 0.0
    patience: int = 16

    # how rows are spread: windows of one series per chunk
    chunk: int = 512

    def __post_init__(self) -> None:
        if self.mode not in MODES:
            raise ValueError(f"mode must be one of {MODES}, not {self.mode!r}")
        if self.loss_space not in ("natural", "transformed"):
            raise ValueError(f"unknown loss_space {self.loss_space!r}")
        for name in ("window", "lookback", "train_stride", "batch_size", "chunk"):
            if getattr(self, name) < 1:
                raise ValueError(f"{name} must be at least 1")

    def with_(self, **changes) -> "PanelSpec":
        return replace(self, **changes)

    @property
    def is_rate(self) -> bool:
        return self.mode == "cases"

    @property
    def target(self) -> str:
        return self.mode

    @property
    def num(self) -> str:
        return (self.cases_counts if self.is_rate else self.prevalence_counts)[0]

    @property
    def den(self) -> str:
        return (self.cases_counts if self.is_rate else self.prevalence_counts)[1]

    @property
    def threshold(self) -> float:
        return self.min_cases if self.is_rate else self.min_prevalence

    @property
    def pair(self) -> list[str]:
        """Key of one series."""
        return [self.param, self.sim]

    @property
    def unit(self) -> list[str]:
        return [self.param, self.sim, self.global_id]

    @property
    def measures(self) -> list[str]:
        """Target columns a window row carries."""
        return [self.target] + (["cases_count", "exposure_pd"] if self.is_rate else [])

    @property
    def time_features(self) -> list[str]:
        return ["sin_day", "cos_day"] if self.cyclic_time else ["time_norm"]

    @property
    def feature_columns(self) -> list[str]:
        """Model inputs in order: time, scaled covariates, event flag, years since the event."""
        scaled = [f"scaled_{c}" for c in self.statics]
        return [*self.time_features, *scaled, "post_intervention", "years_since"]

    @property
    def input_size(self) -> int:
        return len(self.feature_columns)
