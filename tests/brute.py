"""What the pipeline should give, worked out step by step from the definitions, to compare with."""

import hashlib
import math

import numpy as np
import pandas as pd

PAIR = ["parameter_index", "simulation_index"]


def windows(facts: pd.DataFrame, spec) -> pd.DataFrame:
    f = facts[facts.timesteps >= spec.burn_in].copy()
    f["group_id"] = (f.timesteps - spec.burn_in) // spec.window
    rows = []
    for key, g in f.groupby([*PAIR, "global_index", "group_id"]):
        num, den = g[spec.num].sum(skipna=False), g[spec.den].sum()
        if den == 0:
            continue
        scale = 1000.0 if spec.is_rate else 1.0
        row = dict(zip([*PAIR, "global_index", "group_id"], key), abs_timesteps=g.timesteps.min(), target=scale * num / den)
        row |= {"cases_count": num, "exposure_pd": den}
        row |= {c: g[c].max() for c in spec.statics}
        rows.append(row)
    out = pd.DataFrame(rows).sort_values([*PAIR, "group_id", "global_index"], ignore_index=True)
    out["timesteps"] = out.groupby(PAIR).cumcount() + 1
    return out


def keep(rows: pd.DataFrame, spec) -> pd.DataFrame:
    means = rows.groupby(PAIR).target.mean()
    good = means[means >= spec.threshold].index
    return rows[rows.set_index(PAIR).index.isin(good)]


def labels(params, spec) -> dict:
    order = sorted(set(params), key=lambda p: (hashlib.md5(f"split:{spec.seed}:{p}".encode()).hexdigest(), p))
    n = len(order)
    a, b = int(0.7 * n), int(0.15 * n)
    return {p: "train" if i < a else "validate" if i < a + b else "test" for i, p in enumerate(order)}


def scaler(rows: pd.DataFrame, label: dict, spec):
    first = rows.groupby(PAIR).first().reset_index()
    x = first[first.parameter_index.map(label) == "train"][list(spec.statics)].to_numpy(float)
    std = x.std(axis=0)
    return x.mean(axis=0), np.where(std < 1e-12, 1.0, std)


def into_training_space(value: float, spec) -> float:
    """The log of one more than a rate, or the log odds of a share kept off 0 and 1."""
    if spec.is_rate:
        return math.log(1 + max(value, 0.0))
    share = min(max(value, spec.eps), 1 - spec.eps)
    return math.log(share) - math.log(1 - share)


def natural(y: float, spec) -> float:
    return math.exp(y) - 1 if spec.is_rate else 1 / (1 + math.exp(-y))


def phase(day: int) -> float:
    """Angle of the day in a year of 365."""
    return math.tau * (day % 365) / 365


def features(rows: pd.DataFrame, label: dict, spec) -> pd.DataFrame:
    """One record per step with a finite target, each input by its definition."""
    mean, std = scaler(rows, label, spec)
    centre, unit = dict(zip(spec.statics, mean)), dict(zip(spec.statics, std))
    out = []
    for (param, sim), g in rows.groupby(PAIR):
        steps = [r for r in g.sort_values("timesteps").to_dict("records") if math.isfinite(r["target"])]
        if not steps:
            continue
        first, last = steps[0]["timesteps"], steps[-1]["timesteps"]
        for place, r in enumerate(steps):
            day, step = r["abs_timesteps"], r["timesteps"]
            since = day - spec.intervention
            if spec.cyclic_time:
                time = {"sin_day": math.sin(phase(day)), "cos_day": math.cos(phase(day))}
            else:
                time = {"time_norm": float(step) if first == last else (step - first) / (last - first)}
            inputs = {}
            for c in spec.statics:
                hidden = c in spec.gated and since < 0
                inputs[f"scaled_{c}"] = ((0.0 if hidden else steps[0][c]) - centre[c]) / unit[c]
            out.append({
                "parameter_index": param, "simulation_index": sim, "split": label[param], "timesteps": step,
                "abs_timesteps": day, "position": place, "valid_length": len(steps), **time, **inputs,
                "post_intervention": int(since >= 0), "years_since": max(0, since) / 365,
                "y": into_training_space(r["target"], spec), "w": r["exposure_pd"] if spec.is_rate else 1.0,
            })
    return pd.DataFrame(out)


def starts(length: int, split: str, spec) -> list[int]:
    """Places from which a whole look-back window fits: all multiples of the stride for training, else of the length."""
    every = spec.train_stride if split == "train" else spec.lookback
    return [s for s in range(length) if s % every == 0 and s + spec.lookback <= length]


def mean_square(pairs) -> float:
    """Of (weight, error) pairs, over a total weight of at least 1."""
    pairs = list(pairs)
    return sum(w * e * e for w, e in pairs) / max(1.0, sum(w for w, _ in pairs))


def loss(p, t, w, spec) -> float:
    """Level, slope and curvature errors of all windows; those of slope and curvature are differences of level errors."""
    level, slope, curve = [], [], []
    for forecasts, truths, weight in zip(p, t, w):
        shown = (lambda v: natural(v, spec)) if spec.loss_space == "natural" else float
        error = [shown(a) - shown(b) for a, b in zip(forecasts, truths)]
        for k, e in enumerate(error):
            level.append((weight[k], e))
            if k >= 1:
                slope.append(((weight[k] + weight[k - 1]) / 2, e - error[k - 1]))
            if k >= 2:
                curve.append(((weight[k] + 2 * weight[k - 1] + weight[k - 2]) / 4, e - 2 * error[k - 1] + error[k - 2]))
    return mean_square(level) + spec.slope_weight * mean_square(slope) + spec.curvature_weight * mean_square(curve)
