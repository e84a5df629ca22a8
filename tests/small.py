"""A hand-sized fact table with the awkward cases."""

import numpy as np
import pandas as pd

from panelcast.spec import PanelSpec

SPEC = PanelSpec(
    prevalence_counts=("hits", "tests"),
    cases_counts=("events", "person_days"),
    statics=("a", "b", "c"),
    gated=("c",),
    min_prevalence=0.05,
    burn_in=10,
    intervention=60,
    window=5,
    lookback=4,
    batch_size=3,
    chunk=3,
    slope_weight=0.1,
    curvature_weight=0.05,
)


def facts() -> pd.DataFrame:
    """30 parameters with 1 to 4 simulations; constant covariate ``b``; days 0..200 with gaps."""
    rng = np.random.default_rng(7)
    rows = []
    for param in range(30):
        a, c = rng.normal(), float(rng.integers(0, 4))
        for sim in range(1 + param % 4):
            last = int(rng.integers(12, 200))
            for day in np.flatnonzero(rng.random(last) < 0.6):
                tests = float(rng.integers(0, 9))
                rows.append((param, sim, param * 10 + sim, int(day), float(rng.binomial(int(tests), 0.4)), tests,
                             float(rng.poisson(2)), float(rng.integers(1, 50)), a, 5.0, c))
    columns = ["parameter_index", "simulation_index", "global_index", "timesteps", "hits", "tests", "events",
               "person_days", "a", "b", "c"]
    df = pd.DataFrame(rows, columns=columns)
    extra = []

    def series(param, sim, days, hits, tests, global_index=None):
        extra.extend(
            (param, sim, global_index or param * 10 + sim, d, h, t, h, t, 1.0, 5.0, 2.0)
            for d, h, t in zip(days, hits, tests)
        )

    days = list(range(10, 60, 5))
    series(100, 0, days, [1] * 10, [2, 0, 2, 2, 2, 2, 2, 2, 2, 2])        # a window without tests
    series(100, 1, [10, 11], [0, 1], [0, 2])                              # zero tests on one day only
    series(101, 0, [9, 10], [1, 1], [1, 4])                               # first day after the burn-in
    series(101, 1, [58, 59, 60, 61, 64, 65], [1] * 6, [2] * 6)            # straddles the intervention
    series(102, 0, days[:3], [1] * 3, [2] * 3)                            # T = L - 1
    series(102, 1, days[:4], [1] * 4, [2] * 4)                            # T = L
    series(102, 2, list(range(10, 65, 5)), [1] * 11, [2] * 11)            # T = 2L + 3
    series(103, 0, [12], [1], [1])                                        # a single step, target 1
    series(103, 1, days, [0] * 10, [3] * 10)                              # under the threshold
    series(104, 0, days, [2, np.inf, 1, 1, np.nan, 1, 1, 0, 1, 4], [4] * 10)  # not finite
    series(105, 0, days, [1] * 10, [4] * 10, global_index=7001)           # two ids for one pair
    series(105, 0, days, [2] * 10, [4] * 10, global_index=7002)
    series(106, 0, list(range(10, 2000)), [1, 2, 3, 1, 0] * 398, [4] * 1990)  # one dominant series
    return pd.concat([df, pd.DataFrame(extra, columns=columns)], ignore_index=True)
