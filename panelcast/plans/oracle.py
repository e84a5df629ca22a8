"""The registered queries in DuckDB SQL, built from one chain of common table expressions."""

from __future__ import annotations

from panelcast.operators.baselines import SEASON_DAYS
from panelcast.operators.shuffling import DIGITS, FEISTEL_ROUNDS
from panelcast.operators.tuning import LOOKBACKS
from panelcast.plans.queries import (
    CASES, DEFAULT_PARAMETERS, EPOCHS, HISTORY_START, ORDERED_RANGE, PARAM_LIMIT, PREVALENCE, RIDGE, SAMPLED_SPEC, SHAPE, STATE_DECAYS,
    STATEFUL, TUNED,
)
from panelcast.spec import DAYS_PER_YEAR, METRIC_EPS, PanelSpec

KEY = "parameter_index, simulation_index"
STATICS = "s_acctbal, s_nationkey, n_regionkey"


def r(expression: str, name: str | None = None) -> str:
    """Six digits, and zero never negative."""
    name = name or expression.split(".")[-1]
    return f"CASE WHEN abs({expression}) < 5e-7 THEN 0.0 ELSE round({expression}, 6) END AS {name}"


def natural(y: str, spec: PanelSpec) -> str:
    return f"(exp({y}) - 1)" if spec.is_rate else f"(1 / (1 + exp(-{y})))"


def chain(spec: PanelSpec) -> dict[str, str]:
    """All steps up to batched baseline predictions; a query uses the ones it needs."""
    if spec.is_rate:
        measures = (
            f"1000.0 * sum({spec.num}) / nullif(sum({spec.den}), 0) AS target, "
            f"sum({spec.num}) AS cases_count, sum({spec.den}) AS exposure_pd"
        )
        y, w = "ln(1 + greatest(target, 0.0))", "exposure_pd"
    else:
        measures = f"sum({spec.num}) / nullif(sum({spec.den}), 0) AS target"
        eps = spec.eps
        clipped = f"greatest({eps}::DOUBLE, least(target, 1 - {eps}::DOUBLE))"
        y, w = f"ln({clipped} / (1 - {clipped}))", "1.0::DOUBLE"
    gate = f"CASE WHEN abs_timesteps >= {spec.intervention} THEN f.n_regionkey ELSE 0 END"
    angle = f"2 * pi() * (abs_timesteps % {DAYS_PER_YEAR}) / {DAYS_PER_YEAR}.0::DOUBLE"
    length = spec.lookback
    return {
        "facts": f"""
            SELECT l_suppkey AS parameter_index, CAST(l_linenumber AS BIGINT) AS simulation_index,
                   l_suppkey * 10 + l_linenumber AS global_index,
                   CAST(datediff('day', DATE '1995-01-01', CAST(l_shipdate AS DATE)) AS BIGINT) AS timesteps,
                   CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0.0 END::DOUBLE AS returned_qty,
                   CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END::DOUBLE AS returned_lines,
                   l_quantity AS total_qty, s_acctbal, CAST(s_nationkey AS DOUBLE) AS s_nationkey,
                   CAST(n_regionkey AS DOUBLE) AS n_regionkey
            FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey""",
        "units": f"SELECT DISTINCT {KEY} FROM facts" if spec.sims_per_param is None else f"""
            SELECT {KEY} FROM (
                SELECT *, row_number() OVER (PARTITION BY parameter_index ORDER BY
                    md5('{spec.seed}:' || parameter_index || ':' || simulation_index), simulation_index) AS rn
                FROM (SELECT DISTINCT {KEY} FROM facts))
            WHERE rn <= {spec.sims_per_param}""",
        "win": f"""
            SELECT {KEY}, global_index,
                   CAST(floor((timesteps - {spec.burn_in}) / {spec.window}.0) AS BIGINT) AS group_id,
                   min(timesteps) AS abs_timesteps, {measures},
                   max(s_acctbal) AS s_acctbal, max(s_nationkey) AS s_nationkey, max(n_regionkey) AS n_regionkey
            FROM facts JOIN units USING ({KEY}) WHERE timesteps >= {spec.burn_in}
            GROUP BY ALL""",
        "panel": f"""
            SELECT *, row_number() OVER (PARTITION BY {KEY} ORDER BY group_id, global_index) AS timesteps
            FROM win WHERE target IS NOT NULL""",
        "kept": f"""
            SELECT {KEY}, avg(target) AS mean_target, count(*) AS n_steps, min(timesteps) AS min_step,
                   max(timesteps) AS max_step, arg_max(global_index, timesteps) AS global_index,
                   arg_min(s_acctbal, timesteps) AS s_acctbal, arg_min(s_nationkey, timesteps) AS s_nationkey,
                   arg_min(n_regionkey, timesteps) AS n_regionkey
            FROM panel GROUP BY {KEY} HAVING avg(target) >= {spec.threshold}""",
        "labels_": f"""
            SELECT parameter_index, CASE
                WHEN rk < floor(0.7::DOUBLE * n) THEN 'train'
                WHEN rk < floor(0.7::DOUBLE * n) + floor(0.15::DOUBLE * n) THEN 'validate'
                ELSE 'test' END AS split
            FROM (SELECT parameter_index, count(*) OVER () AS n,
                         row_number() OVER (ORDER BY md5('split:{spec.seed}:' || parameter_index), parameter_index) - 1 AS rk
                  FROM (SELECT DISTINCT parameter_index FROM kept))""",
        "series": "SELECT * FROM kept JOIN labels_ USING (parameter_index)",
        "scaler": """
            SELECT avg(s_acctbal) AS mean_s_acctbal, stddev_pop(s_acctbal) AS std_s_acctbal,
                   avg(s_nationkey) AS mean_s_nationkey, stddev_pop(s_nationkey) AS std_s_nationkey,
                   avg(n_regionkey) AS mean_n_regionkey, stddev_pop(n_regionkey) AS std_n_regionkey
            FROM series WHERE split = 'train'""",
        "feat": f"""
            SELECT p.parameter_index, p.simulation_index, f.global_index, split, p.timesteps, abs_timesteps, target, n_steps,
                   p.timesteps - 1 AS position, sin({angle}) AS sin_day, cos({angle}) AS cos_day,
                   CASE WHEN max_step > min_step THEN (p.timesteps - min_step) / (max_step - min_step)::DOUBLE
                        ELSE p.timesteps END AS time_norm,
                   (f.s_acctbal - mean_s_acctbal) / std_s_acctbal AS scaled_s_acctbal,
                   (f.s_nationkey - mean_s_nationkey) / std_s_nationkey AS scaled_s_nationkey,
                   ({gate} - mean_n_regionkey) / std_n_regionkey AS scaled_n_regionkey,
                   CAST(abs_timesteps >= {spec.intervention} AS INTEGER) AS post_intervention,
                   greatest(0, abs_timesteps - {spec.intervention}) / {DAYS_PER_YEAR}.0::DOUBLE AS years_since,
                   {y} AS y, {w} AS w
            FROM panel p JOIN series f ON p.parameter_index = f.parameter_index
                 AND p.simulation_index = f.simulation_index, scaler""",
        "seasoned": f"SELECT *, CAST(floor((abs_timesteps % {DAYS_PER_YEAR}) / {SEASON_DAYS}.0) AS BIGINT) AS season FROM feat",
        "means": "SELECT season, avg(y) AS m FROM seasoned WHERE split = 'train' GROUP BY season",
        "overall": "SELECT avg(y) AS o FROM seasoned WHERE split = 'train'",
        "forecasts": f"""
            SELECT s.*, coalesce(m, o) AS seasonal,
                   coalesce(lag(y) OVER (PARTITION BY {KEY} ORDER BY timesteps), m, o) AS persistence
            FROM seasoned s LEFT JOIN means USING (season), overall""",
        "predicted": """
            SELECT *, 'persistence' AS model, persistence AS yhat FROM forecasts
            UNION ALL SELECT *, 'seasonal' AS model, seasonal AS yhat FROM forecasts""",
        "bases": f"""
            SELECT {KEY}, coalesce(sum(n_steps // {length}) OVER (PARTITION BY split ORDER BY {KEY}
                       ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS windows_before
            FROM series""",
        "scored": f"""
            SELECT *, position - position % {length} AS start,
                   CAST(floor((windows_before + position // {length}) / {spec.batch_size}.0) AS BIGINT) AS batch_id,
                   {natural("y", spec)} AS t, {natural("yhat", spec)} AS p
            FROM predicted JOIN bases USING ({KEY})
            WHERE position < n_steps - n_steps % {length}""",
        "d1": f"""
            SELECT *, p - lag(p) OVER s AS p1, t - lag(t) OVER s AS t1, (w + lag(w) OVER s) * 0.5 AS w1
            FROM scored WINDOW s AS (PARTITION BY model, {KEY}, start ORDER BY position)""",
        "d2": f"""
            SELECT *, p1 - lag(p1) OVER s AS p2, t1 - lag(t1) OVER s AS t2, (w1 + lag(w1) OVER s) * 0.5 AS w2
            FROM d1 WINDOW s AS (PARTITION BY model, {KEY}, start ORDER BY position)""",
    }


def sql(body: str, spec: PanelSpec = PREVALENCE, upto: str = "d2", extra: dict[str, str] | None = None) -> str:
    steps, wanted = chain(spec), {}
    for name, text in steps.items():
        wanted[name] = text
        if name == upto:
            break
    wanted |= extra or {}
    return "WITH " + ",\n".join(f"{n} AS ({t})" for n, t in wanted.items()) + "\n" + body


def mse(error: str, weight: str) -> str:
    return f"sum({weight} * ({error}) * ({error})) / greatest(sum({weight}), 1.0)"


def losses(by: str, spec: PanelSpec) -> str:
    base, slope = mse("p - t", "w"), f"coalesce({mse('p1 - t1', 'w1')}, 0)"
    curve = f"coalesce({mse('p2 - t2', 'w2')}, 0)"
    return (
        f"SELECT {by}, {base} AS base_loss, {slope} AS slope_loss, {curve} AS curvature_loss, "
        f"{base} + {spec.slope_weight} * {slope} + {spec.curvature_weight} * {curve} AS total_loss "
        f"FROM d2 GROUP BY {by}"
    )


def metric_columns(spec: PanelSpec) -> dict[str, str]:
    e = METRIC_EPS
    pc, tc = (f"greatest({e}::DOUBLE, least({c}, 1 - {e}::DOUBLE))" for c in "pt")
    columns = {
        "n": "count(*)",
        "mse": "avg((p - t) * (p - t))",
        "rmse": "sqrt(avg((p - t) * (p - t)))",
        "mae": "avg(abs(p - t))",
        "r2": "1 - sum((p - t) * (p - t)) / (var_pop(t) * count(*))",
        "smape": f"100 * avg(2 * abs(p - t) / (abs(p) + abs(t) + {e}::DOUBLE))",
        "bias": "avg(p - t)",
    }
    if spec.is_rate:
        columns["mape"] = f"100 * avg(CASE WHEN abs(t) > {e}::DOUBLE THEN abs((t - p) / (t + {e}::DOUBLE)) END)"
    else:
        columns["log_likelihood"] = f"avg(ln({pc}) * {tc} + ln(1 - {pc}) * (1 - {tc}))"
    return columns


def metric_sql(spec: PanelSpec) -> str:
    columns = metric_columns(spec)
    listed = ", ".join(f"{c} AS {name}" for name, c in columns.items())
    shown = ", ".join(["m.model", "m.split", "n", *[r(n) for n in columns if n != "n"], r("avg_loss_transformed")])
    batches = f"SELECT model, split, batch_id, {mse('yhat - y', 'w')} AS b FROM scored GROUP BY model, split, batch_id"
    return sql(
        f"""SELECT {shown} FROM (SELECT model, split, {listed} FROM scored GROUP BY model, split) m
            JOIN (SELECT model, split, avg(b) AS avg_loss_transformed FROM ({batches}) GROUP BY model, split) a
              ON m.model = a.model AND m.split = a.split""",
        spec, "scored",
    )


def feature_sql(columns: list[str], spec: PanelSpec = PREVALENCE) -> str:
    whole = ("split", "abs_timesteps", "post_intervention")
    shown = ", ".join(c if c in whole else r(c) for c in columns)
    return sql(f"SELECT {KEY}, timesteps, {shown} FROM feat", spec, "feat")


def both_modes(column: str, name: str, upto: str) -> str:
    """One query over two independent chains, as nested statements."""
    parts = []
    for spec in (PREVALENCE, CASES):
        value = column(spec)
        inner = sql(f"SELECT '{spec.mode}' AS mode, {KEY}, timesteps, {value} FROM {upto}", spec, "feat")
        parts.append(f"SELECT * FROM ({inner})")
    return " UNION ALL ".join(parts)


SCALED = ["scaled_s_acctbal", "scaled_s_nationkey", "scaled_n_regionkey"]
STRIDE = f"CASE WHEN split = 'train' THEN {PREVALENCE.train_stride} ELSE {PREVALENCE.lookback} END"
LAST_START = f"n_steps - {PREVALENCE.lookback}"
STARTS = f"""
    SELECT {KEY}, split, n_steps, unnest(range(0, {LAST_START} + 1, {STRIDE})) AS start
    FROM series WHERE n_steps >= {PREVALENCE.lookback}"""
HISTORY = f"""
    SELECT user_id AS run, CAST(datediff('day', DATE '{HISTORY_START}', CAST(ts AS DATE)) AS BIGINT) AS epoch,
           round(avg(value), 9) AS val_loss
    FROM events GROUP BY ALL"""
TRIALS = """
    SELECT event_type AS model_type, user_id AS trial_number, round(avg(value), 9) AS best_val_loss, count(*) AS n_events
    FROM events GROUP BY ALL"""
RANKED = f"""
    SELECT *, row_number() OVER (PARTITION BY model_type ORDER BY best_val_loss, trial_number) AS rank
    FROM ({TRIALS})"""
AGAIN = f"""
    SELECT -1 - run AS run, epoch, CASE WHEN run % 3 = 0 THEN 'nan'::DOUBLE ELSE val_loss END AS val_loss FROM ({HISTORY})"""
AWKWARD = f"""
    SELECT * FROM ({HISTORY}) UNION ALL SELECT * FROM ({AGAIN})
    UNION ALL SELECT DISTINCT run, e, x::DOUBLE FROM ({AGAIN}), (VALUES (-2, 'inf'), (-1, 'nan')) v(e, x)"""
#: A gain is a loss below infinity that none of the earlier numbers reaches.
IMPROVED = f"""
    SELECT *, epoch_number = 1 + lower_count AND NOT isnan(val_loss) AND val_loss < 'inf'::DOUBLE AS improved FROM (
        SELECT *, row_number() OVER (PARTITION BY run ORDER BY epoch) AS epoch_number,
               (SELECT count(*) FROM ({AWKWARD}) e WHERE e.run = a.run AND e.epoch < a.epoch
                AND (isnan(e.val_loss) OR e.val_loss > a.val_loss)) AS lower_count
        FROM ({AWKWARD}) a)"""
COUNTED = f"""
    SELECT run, epoch, val_loss, improved, epoch_number,
           min(CASE WHEN improved THEN val_loss END) OVER so_far AS best_so_far,
           epoch_number - coalesce(max(CASE WHEN improved THEN epoch_number END) OVER so_far, 0) AS patience_counter
    FROM ({IMPROVED})
    WINDOW so_far AS (PARTITION BY run ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"""
SHOWN = f"""
    SELECT parameter_index FROM (SELECT DISTINCT parameter_index FROM series WHERE split = 'test')
    ORDER BY md5('report:{PREVALENCE.seed}:' || parameter_index), parameter_index LIMIT 9"""


CHOSEN = """
    SELECT parameter_index, simulation_index, is_test FROM (
        SELECT *, row_number() OVER (PARTITION BY parameter_index
               ORDER BY CASE WHEN is_test THEN 0 ELSE 1 END, simulation_index) AS rn
        FROM (SELECT DISTINCT p.parameter_index, p.simulation_index, s.split IS NOT NULL AS is_test
              FROM panel p JOIN shown h ON p.parameter_index = h.parameter_index
              LEFT JOIN (SELECT * FROM series WHERE split = 'test') s
                ON p.parameter_index = s.parameter_index AND p.simulation_index = s.simulation_index))
    WHERE rn = 1"""
PREDICTED = f"""
    {KEY}, global_index, split = 'test' AS is_test, timesteps AS timestep,
    {r(natural('y', PREVALENCE), 'true_prevalence')},
    {r(natural('persistence', PREVALENCE), 'persistence_prediction')},
    {r(natural('seasonal', PREVALENCE), 'seasonal_prediction')}"""


def precedence_sql() -> str:
    default = DEFAULT_PARAMETERS
    return f"""
        WITH best AS (SELECT model_type, round(best_val_loss / 1000.0, 9) AS learning_rate, n_events AS lookback
                      FROM ({RANKED}) WHERE rank = 1),
        loaded AS (SELECT model_type, learning_rate, lookback + 100 AS lookback FROM best
                   WHERE model_type IN ('click', 'signup', 'purchase')),
        tuned AS (SELECT * FROM best WHERE model_type IN ('purchase', 'view'))
        SELECT m.model_type,
               CASE WHEN t.model_type IS NOT NULL THEN 'tuned' WHEN l.model_type IS NOT NULL THEN 'loaded'
                    ELSE 'default' END AS source,
               coalesce(t.learning_rate, l.learning_rate, {default["learning_rate"]}::DOUBLE) AS learning_rate,
               CAST(coalesce(t.lookback, l.lookback, {default["lookback"]}) AS BIGINT) AS lookback
        FROM (SELECT DISTINCT event_type AS model_type FROM events) m
        LEFT JOIN loaded l ON m.model_type = l.model_type LEFT JOIN tuned t ON m.model_type = t.model_type"""


def compare_sql() -> str:
    columns = metric_columns(PREVALENCE)
    rows = " UNION ALL ".join(
        f"SELECT '{m}' AS metric, {r(f'max(CASE WHEN model = {chr(39)}persistence{chr(39)} THEN {m} END)', 'persistence')}, "
        f"{r(f'max(CASE WHEN model = {chr(39)}seasonal{chr(39)} THEN {m} END)', 'seasonal')} FROM rec"
        for m in ("mse", "rmse", "mae", "r2")
    )
    listed = ", ".join(f"{c} AS {name}" for name, c in columns.items())
    return sql(rows, PREVALENCE, "scored", {
        "rec": f"SELECT model, {listed} FROM scored WHERE split = 'test' GROUP BY model"
    })


def fit_steps(spec: PanelSpec, penalties: dict[str, float] = {"linear": 0.0}, rows: str = "feat",  # noqa: B006
              more: tuple[str, ...] = ()) -> dict[str, str]:
    """Weighted least squares on the training steps: normal equations, a model per penalty."""
    x = ["1.0::DOUBLE", *spec.feature_columns, *more]
    n, stride = len(x), spec.train_stride
    first, last = f"greatest(0, position - {spec.lookback} + 1)", f"least(position, n_steps - {spec.lookback})"
    held = f"CASE WHEN {last} < 0 THEN 0 ELSE greatest(0, floor({last} / {stride}.0) - ceil({first} / {stride}.0) + 1) END"
    cells = [(i, j) for i in range(n) for j in range(n + 1)]
    sums = ", ".join(f"sum(fw * {x[i]} * {(*x, 'y')[j]}) AS a_{i}_{j}" for i, j in cells)
    steps = {
        "fit_rows": f"SELECT *, w * ({held}) AS fw FROM {rows} WHERE split = 'train'",
        "sums": f"SELECT {sums}, sum(fw * y * y) AS yy FROM fit_rows",
    }
    # a penalty adds a share of a column's variation to its own square; the share is over the target's deviation
    share = f"penalty / sqrt(yy / a_0_0 - (a_0_{n} / a_0_0) ** 2)"
    diagonal = {i: f"a_{i}_{i} + {share} * (a_{i}_{i} - a_0_{i} * a_0_{i} / a_0_0)" for i in range(1, n)}
    first_step = ", ".join(f"{diagonal.get(i, f'a_{i}_{i}') if i == j else f'a_{i}_{j}'} AS a_{i}_{j}" for i, j in cells)
    listed = ", ".join(f"('{name}', {p!r}::DOUBLE)" for name, p in penalties.items())
    steps["step_0"] = f"SELECT model, {first_step} FROM sums, (VALUES {listed}) v(model, penalty)"
    return steps | solve_steps(x, rows)


def solve_steps(x: list[str], rows: str = "feat") -> dict[str, str]:
    """One elimination a step from ``step_0``, a row per model; its coefficients, and its forecast of every step."""
    n, steps = len(x), {}
    cells = [(i, j) for i in range(n) for j in range(n + 1)]
    for k in range(n):
        rest = (f"a_{i}_{j} - a_{i}_{k} / a_{k}_{k} * a_{k}_{j}" if i != k else f"a_{i}_{j}" for i, j in cells)
        named = ", ".join(f"{e} AS a_{i}_{j}" for e, (i, j) in zip(rest, cells))
        steps[f"step_{k + 1}"] = f"SELECT model, {named} FROM step_{k}"
    steps["beta"] = "SELECT model, " + ", ".join(f"a_{i}_{n} / a_{i}_{i} AS b_{i}" for i in range(n)) + f" FROM step_{n}"
    value = " + ".join(f"b_{i} * {x[i]}" for i in range(n))
    steps["predicted"] = f"SELECT {rows}.*, beta.model, {value} AS yhat FROM {rows}, beta"
    return steps


def shape_steps(spec: PanelSpec) -> dict[str, str]:
    """Least squares on levels and differences inside every training window, each made as rows of its own."""
    x = ["1.0::DOUBLE", *spec.feature_columns]
    n, columns = len(x), [*spec.feature_columns, "y"]
    inside = f"PARTITION BY {KEY}, start ORDER BY position"

    def lagging(order: int) -> str:
        last = "" if order == 1 else f"{order - 1}"
        parts = [f"{c}{last} - lag({c}{last}) OVER s AS {c}{order}" for c in columns]
        weight = f"(w{last} + lag(w{last}) OVER s) * 0.5 AS w{order}"
        return f"SELECT *, {', '.join(parts)}, {weight} FROM held{order - 1} WINDOW s AS ({inside})"

    def cell(i: int, j: int) -> str:
        own = [*x, "y"]
        terms = [f"sum(w * {own[i]} * {own[j]}) / greatest(sum(w), 1.0)"]
        if i and j:
            terms += [f"{share} * sum(w{o} * {own[i]}{o} * {own[j]}{o}) / greatest(sum(w{o}), 1.0)"
                      for o, share in ((1, spec.slope_weight), (2, spec.curvature_weight))]
        return " + ".join(terms)

    cells = [(i, j) for i in range(n) for j in range(n + 1)]
    return {
        "held0": f"""
            SELECT f.*, start FROM feat f JOIN ({STARTS}) s ON f.parameter_index = s.parameter_index
             AND f.simulation_index = s.simulation_index AND f.position >= start AND f.position < start + {spec.lookback}
            WHERE f.split = 'train'""",
        "held1": lagging(1),
        "held2": lagging(2),
        "step_0": "SELECT 'shape' AS model, " + ", ".join(f"{cell(i, j)} AS a_{i}_{j}" for i, j in cells) + " FROM held2",
    } | solve_steps(x)


def fitted_sql(body: str, spec: PanelSpec, after: tuple[str, ...] = (), fit: dict[str, str] | None = None) -> str:
    """The chain up to features, the fit in place of the baselines, and further steps of the chain."""
    steps = chain(spec)
    names = list(steps)
    wanted = {name: steps[name] for name in names[: names.index("feat") + 1]} | (fit or fit_steps(spec))
    wanted |= {name: steps[name] for name in after}
    return "WITH " + ",\n".join(f"{n} AS MATERIALIZED ({t})" for n, t in wanted.items()) + "\n" + body


def tune_sql() -> str:
    parts = []
    for number, lookback in enumerate(LOOKBACKS):
        spec = PREVALENCE.with_(lookback=lookback)
        loss = f"SELECT avg(total_loss) AS loss FROM ({losses('split, batch_id', spec)}) WHERE split = 'validate'"
        inner = fitted_sql(loss, spec, ("bases", "scored", "d1", "d2"))
        parts.append(f"SELECT {number} AS trial_number, {lookback} AS lookback, loss FROM ({inner})")
    return f"""
        SELECT trial_number::BIGINT AS trial_number, lookback::BIGINT AS lookback, round(coalesce(loss, 'inf'::DOUBLE), 6) AS best_val_loss,
               CASE WHEN loss IS NOT NULL THEN 1::BIGINT END AS best_epoch,
               CASE WHEN loss IS NOT NULL THEN 'COMPLETE' ELSE 'FAIL' END AS state,
               row_number() OVER (ORDER BY coalesce(loss, 'inf'::DOUBLE), trial_number) AS rank
        FROM ({" UNION ALL ".join(parts)})"""


def states(columns: dict[str, tuple[str, float]]) -> str:
    """Steps with decaying sums over all earlier ones, each weight worked out from the distance."""
    sums = ", ".join(f"sum({d}::DOUBLE ** (f.position - e.position) * e.{c}) AS {name}" for name, (c, d) in columns.items())
    return f"""
        SELECT f.*, {", ".join(f"q.{name}" for name in columns)} FROM feat f JOIN (
            SELECT f.parameter_index, f.simulation_index, f.position, {sums} FROM feat f JOIN feat e
              ON f.parameter_index = e.parameter_index AND f.simulation_index = e.simulation_index AND e.position <= f.position
            GROUP BY ALL) q
          ON f.parameter_index = q.parameter_index AND f.simulation_index = q.simulation_index AND f.position = q.position"""


STATES = {f"{c}_h{round(d * 1000)}": (c, d) for c in ("years_since", "cos_day") for d in STATE_DECAYS}


def stateful_sql() -> str:
    columns = {"s1": ("cos_day", STATE_DECAYS[0]), "s2": ("post_intervention", STATE_DECAYS[0])}
    fit = {"stated": states(columns)} | fit_steps(STATEFUL, rows="stated", more=tuple(columns))
    return scores_sql(STATEFUL, fit)


def shuffle_sql(spec: PanelSpec, turns: int = 4) -> str:
    """Ordinals as pairs over two radices, rounds of digests, and further turns for results of n or more."""
    steps = {
        "starts": STARTS,
        "placed": f"""
            SELECT {KEY}, CAST(start AS BIGINT) AS start, epoch::BIGINT AS epoch,
                   row_number() OVER (PARTITION BY epoch ORDER BY {KEY}, start) - 1 AS x
            FROM starts, range({EPOCHS}) e(epoch) WHERE split = 'train'""",
        "size_": "SELECT count(*)::BIGINT // 2 AS n, floor(sqrt(count(*) // 2))::BIGINT AS root FROM placed",
        "radix": """
            SELECT n, a, CAST(ceil(n / a::DOUBLE) AS BIGINT) AS b FROM (
                SELECT n, unnest(range(greatest(2, root // 4), root + 1))::BIGINT AS a FROM size_)
            ORDER BY (a - n % a) % a, a DESC LIMIT 1""",
        "t0": "SELECT p.*, n, a, b FROM placed p, radix",
    }
    last = "t0"
    for turn in range(turns):
        steps[f"h{turn}_0"] = f"SELECT *, x % a AS l, x // a AS h FROM {last}"
        for k in range(FEISTEL_ROUNDS):
            def number(half: str, k: int = k) -> str:
                return f"('0x' || substr(md5('{spec.seed}:' || epoch || ':{k}:' || {half}), 1, {DIGITS}))::BIGINT"

            moved = f"(l + {number('h')}) % a AS l, h" if k % 2 == 0 else f"l, (h + {number('l')}) % b AS h"
            steps[f"h{turn}_{k + 1}"] = f"SELECT * EXCLUDE (l, h), {moved} FROM h{turn}_{k}"
        kept = "l + h * a" if not turn else "CASE WHEN x >= n THEN l + h * a ELSE x END"
        steps[f"t{turn + 1}"] = f"SELECT * EXCLUDE (l, h) REPLACE ({kept} AS x) FROM h{turn}_{FEISTEL_ROUNDS}"
        last = f"t{turn + 1}"
    return sql(
        f"SELECT {KEY}, start, epoch, x // {spec.batch_size} AS batch_id, x % {spec.batch_size} AS slot "
        f"FROM {last} WHERE x // {spec.batch_size} < n // {spec.batch_size}", spec, "series", steps)


def ridge_sql() -> str:
    parts = []
    for number, lookback in enumerate(LOOKBACKS):
        spec = TUNED.with_(lookback=lookback)
        penalties = {str(number * len(RIDGE) + k): p for k, p in enumerate(RIDGE)}
        loss = f"SELECT model, avg(total_loss) AS loss FROM ({losses('model, split, batch_id', spec)}) WHERE split = 'validate' GROUP BY model"
        inner = fitted_sql(loss, spec, ("bases", "scored", "d1", "d2"), fit_steps(spec, penalties))
        parts.append(f"SELECT v.model, {lookback} AS lookback, loss FROM (VALUES {', '.join(f'({chr(39)}{m}{chr(39)})' for m in penalties)}) v(model) "
                     f"LEFT JOIN ({inner}) q ON v.model = q.model")
    return f"""
        SELECT model::BIGINT AS trial_number, lookback::BIGINT AS lookback, round(coalesce(loss, 'inf'::DOUBLE), 6) AS best_val_loss,
               CASE WHEN loss IS NOT NULL THEN 1::BIGINT END AS best_epoch,
               CASE WHEN loss IS NOT NULL THEN 'COMPLETE' ELSE 'FAIL' END AS state
        FROM ({" UNION ALL ".join(parts)})"""


def scores_sql(spec: PanelSpec, fit: dict[str, str] | None = None) -> str:
    return fitted_sql(
        f"SELECT {KEY}, split, timesteps, abs_timesteps, {r(natural('y', spec), 'truth')}, "
        f"{r(natural('yhat', spec), 'prediction')} FROM predicted",
        spec, fit=fit,
    )


def window_sql(spec: PanelSpec, shown: str) -> str:
    return sql(f"SELECT {KEY}, global_index, group_id, abs_timesteps, {shown}, {STATICS} "
               "FROM win WHERE target IS NOT NULL", spec, "win")


ORACLE: dict[str, str] = {
    "scan_panel": sql("SELECT * FROM facts", upto="facts"),
    "param_limit": sql(f"SELECT {KEY}, timesteps, total_qty FROM facts WHERE parameter_index < {PARAM_LIMIT}", upto="facts"),
    "distinct_units": sql(f"SELECT DISTINCT {KEY}, global_index FROM facts", upto="facts"),
    "sample_units": sql("SELECT * FROM units", SAMPLED_SPEC, "units"),
    "semi_join_sample": sql(
        f"SELECT {KEY}, global_index, timesteps, returned_qty, total_qty FROM facts SEMI JOIN units USING ({KEY})",
        SAMPLED_SPEC, "units",
    ),
    "row_rate": sql(f"SELECT {KEY}, timesteps, {r('1000.0 * returned_lines / nullif(total_qty, 0)', 'raw_cases')} FROM facts", upto="facts"),
    "window_prevalence": window_sql(PREVALENCE, "target AS prevalence"),
    "window_rate": window_sql(CASES, f"{r('target', 'cases')}, cases_count, exposure_pd"),
    "renumber": sql(f"SELECT {KEY}, global_index, group_id, timesteps, abs_timesteps FROM panel", upto="panel"),
    "renumber_by_series": sql(
        f"SELECT {KEY}, global_index, group_id, timesteps, abs_timesteps FROM panel", SAMPLED_SPEC, "panel"),
    "threshold_filter": sql(
        f"SELECT {KEY}, group_id, target AS prevalence, {r('mean_target')} FROM panel JOIN kept USING ({KEY})", upto="kept"
    ),
    "series_outline": sql(f"SELECT {KEY}, global_index, n_steps, min_step, max_step, {STATICS} FROM kept", upto="kept"),
    "split_params": sql("SELECT * FROM labels_", upto="labels_"),
    "split_series": sql(f"SELECT {KEY}, global_index, split FROM series", upto="series"),
    "split_sizes": sql(
        "SELECT split, count(*) AS n_series, count(DISTINCT parameter_index) AS n_params FROM series GROUP BY split",
        upto="series",
    ),
    "split_overlap": sql(
        f"""SELECT {KEY}, count(DISTINCT split) AS n_splits FROM (
                SELECT {KEY}, split FROM series UNION ALL SELECT {KEY}, 'train' FROM series WHERE split = 'test')
            GROUP BY {KEY} HAVING count(DISTINCT split) > 1""",
        upto="series",
    ),
    "split_restrict": sql(
        f"""SELECT u.parameter_index, u.simulation_index, CASE
                WHEN rk < floor(0.7::DOUBLE * n) THEN 'train'
                WHEN rk < floor(0.7::DOUBLE * n) + floor(0.15::DOUBLE * n) THEN 'validate' ELSE 'test' END AS split
            FROM kept u JOIN (
                SELECT parameter_index, count(*) OVER () AS n, row_number() OVER (
                    ORDER BY md5('split:{PREVALENCE.seed}:' || parameter_index), parameter_index) - 1 AS rk
                FROM (SELECT DISTINCT parameter_index FROM facts)) q ON u.parameter_index = q.parameter_index""",
        SAMPLED_SPEC, "kept",
    ),
    "scaler_stats": sql(
        "SELECT " + ", ".join(r(f"{s}_{c}") for c in PREVALENCE.statics for s in ("mean", "std")) + " FROM scaler",
        upto="scaler",
    ),
    "gate_scale": feature_sql(["abs_timesteps", *SCALED]),
    "event_features": feature_sql(["abs_timesteps", "post_intervention", "years_since"]),
    "cyclic_time": feature_sql(["abs_timesteps", "sin_day", "cos_day"]),
    "norm_time": feature_sql(["time_norm"]),
    "target_logit": sql(f"SELECT {KEY}, timesteps, {r('target', 'prevalence')}, {r('y')} FROM feat", upto="feat"),
    "target_log1p": sql(f"SELECT {KEY}, timesteps, {r('target', 'cases')}, {r('y')} FROM feat", CASES, "feat"),
    "target_roundtrip": both_modes(lambda s: r(natural("y", s), "back"), "back", "feat"),
    "row_weights": both_modes(lambda s: "w", "w", "feat"),
    "panel_features": feature_sql(["split", *PREVALENCE.feature_columns, "y", "w"]),
    "panel_features_rate": feature_sql(["split", *CASES.feature_columns, "y", "w"], CASES),
    "window_starts": sql(f"SELECT {KEY}, split, CAST(start AS BIGINT) AS start FROM starts", upto="series", extra={"starts": STARTS}),
    "window_rows": sql(
        f"""SELECT s.parameter_index, s.simulation_index, s.split, CAST(s.start AS BIGINT) AS start,
                   CAST(f.position - s.start AS BIGINT) AS k,
                   {r('sin_day')}, {r('years_since')}, {r('y')}, w
            FROM starts s JOIN feat f ON s.parameter_index = f.parameter_index
             AND s.simulation_index = f.simulation_index
             AND f.position >= s.start AND f.position < s.start + {PREVALENCE.lookback}""",
        upto="feat", extra={"starts": STARTS},
    ),
    "batch_ids": sql(
        f"""SELECT {KEY}, split, CAST(start AS BIGINT) AS start,
                   CAST(floor((row_number() OVER (PARTITION BY split ORDER BY {KEY}, start) - 1)
                              / {PREVALENCE.batch_size}.0) AS BIGINT) AS batch_id
            FROM starts""",
        upto="series", extra={"starts": STARTS},
    ),
    "coverage": sql(
        f"""SELECT f.parameter_index, f.simulation_index, f.timesteps, count(s.start) AS n_windows
            FROM feat f LEFT JOIN starts s ON s.parameter_index = f.parameter_index
             AND s.simulation_index = f.simulation_index
             AND f.position >= s.start AND f.position < s.start + {PREVALENCE.lookback}
            WHERE f.split = 'train' GROUP BY ALL""",
        upto="feat", extra={"starts": STARTS},
    ),
    "diffs": sql(
        f"SELECT model, {KEY}, start, position, " + ", ".join(r(f"{c}{i}") for i in (1, 2) for c in "ptw") + " FROM d2", CASES
    ),
    "weighted_loss": sql(
        f"""SELECT model, split, {r(mse('p - t', 'w'), 'base_loss')}, 'natural' AS loss_space FROM scored GROUP BY model, split
            UNION ALL
            SELECT model, split, {r(mse('yhat - y', 'w'), 'base_loss')}, 'transformed' FROM scored GROUP BY model, split""",
        CASES, "scored",
    ),
    "shape_loss": sql(
        "SELECT model, split, " + ", ".join(r(f"{c}_loss") for c in ("base", "slope", "curvature", "total"))
        + f" FROM ({losses('model, split', PREVALENCE.with_(curvature_weight=0.02))})"
    ),
    "batch_loss": sql(
        f"""SELECT a.model, a.split, n_batches, {r('mean_batch_loss')}, {r('avg_loss_transformed')} FROM (
                SELECT model, split, count(*) AS n_batches, avg(total_loss) AS mean_batch_loss
                FROM ({losses('model, split, batch_id', CASES)}) GROUP BY model, split) a
            JOIN (SELECT model, split, avg(b) AS avg_loss_transformed FROM (
                    SELECT model, split, batch_id, {mse('yhat - y', 'w')} AS b FROM scored
                    GROUP BY model, split, batch_id) GROUP BY model, split) c
              ON a.model = c.model AND a.split = c.split""",
        CASES,
    ),
    "metrics_prevalence": metric_sql(PREVALENCE),
    "metrics_rate": metric_sql(CASES),
    "compare_models": compare_sql(),
    "best_epoch": f"SELECT run, epoch AS best_epoch, val_loss AS best_val_loss FROM ("
                  f"SELECT *, row_number() OVER (PARTITION BY run ORDER BY val_loss, epoch) AS rn FROM ({HISTORY})) WHERE rn = 1",
    "patience": COUNTED,
    "run_report": f"""
        WITH counted AS ({COUNTED}),
        stops AS (SELECT run, min(CASE WHEN patience_counter >= {PREVALENCE.patience} THEN epoch END) AS stop
                  FROM counted GROUP BY run),
        seen AS (SELECT c.*, stop FROM counted c JOIN stops s ON c.run = s.run WHERE stop IS NULL OR epoch <= stop)
        SELECT run, max(epoch) AS stop_epoch, max(stop) IS NOT NULL AS stopped_early, min(best_so_far) AS best_val_loss,
               max(CASE WHEN improved THEN epoch END) AS best_epoch
        FROM seen GROUP BY run""",
    "leaderboard": f"SELECT model_type, trial_number, best_val_loss, rank FROM ({RANKED})",
    "best_trial": f"SELECT model_type, trial_number, best_val_loss FROM ({RANKED}) WHERE rank = 1",
    "param_precedence": precedence_sql(),
    "report_params": sql(SHOWN, upto="series"),
    "report_series": sql(CHOSEN, upto="series", extra={"shown": SHOWN}),
    "actual_vs_pred": sql(f"SELECT {PREDICTED} FROM forecasts", upto="forecasts"),
    "report_table": sql(
        f"SELECT {PREDICTED} FROM forecasts SEMI JOIN chosen USING ({KEY})",
        upto="forecasts", extra={"shown": SHOWN, "chosen": CHOSEN},
    ),
    "fit_score_linear": scores_sql(PREVALENCE),
    "fit_shape": scores_sql(SHAPE, shape_steps(SHAPE)),
    "tune_linear": tune_sql(),
    "tune_ridge": ridge_sql(),
    "series_states": sql(
        f"SELECT {KEY}, timesteps, " + ", ".join(r(n) for n in STATES) + " FROM stated", STATEFUL, "feat",
        {"stated": states(STATES)}),
    "fit_stateful": stateful_sql(),
    "train_batches": shuffle_sql(PREVALENCE),
    "saved_split": sql(f"SELECT {KEY}, global_index, split FROM series", upto="series"),
    "reused_split": sql(f"SELECT {KEY}, global_index, split FROM series WHERE split <> 'test'", upto="series"),
    "split_examples": sql(f"SELECT {KEY} FROM series WHERE split = 'test' ORDER BY {KEY} LIMIT 5", upto="series"),
    "saved_scaler": sql(
        "SELECT " + ", ".join(r(f"{s}_{c}") for c in PREVALENCE.statics for s in ("mean", "std")) + " FROM scaler",
        upto="scaler",
    ),
    "saved_metrics": " UNION ALL ".join(
        f"""SELECT '{spec.mode}' AS mode, model, n, mse, rmse, mae, r2, smape, bias, avg_loss_transformed,
                   {"mape, NULL::DOUBLE" if spec.is_rate else "NULL::DOUBLE AS mape, log_likelihood"} AS log_likelihood
            FROM ({metric_sql(spec)}) WHERE split = 'test'"""
        for spec in (PREVALENCE, CASES)
    ).replace("log_likelihood AS log_likelihood", "log_likelihood"),
    "saved_history": f"SELECT CASE WHEN run % 2 = 0 THEN 'even' ELSE 'odd' END AS model, run AS trial, epoch, val_loss * 2 AS train_loss, val_loss FROM ({HISTORY})",
    "saved_trials": f"""SELECT model_type, trial_number, best_val_loss, n_events AS best_epoch, 'COMPLETE' AS state,
                               n_events::DOUBLE AS lookback FROM ({TRIALS})""",
    "best_params": f"""
        SELECT m.model_type, CASE WHEN b.model_type IS NOT NULL THEN 'loaded' ELSE 'default' END AS source,
               coalesce(round(best_val_loss / 1000.0, 9), {DEFAULT_PARAMETERS["learning_rate"]}::DOUBLE) AS learning_rate,
               CAST(coalesce(n_events, {DEFAULT_PARAMETERS["lookback"]}) AS BIGINT) AS lookback
        FROM (SELECT DISTINCT event_type AS model_type FROM events) m
        LEFT JOIN (SELECT * FROM ({RANKED}) WHERE rank = 1 AND model_type IN ('click', 'view')) b
          ON m.model_type = b.model_type""",
    "ordered_panel": sql(
        f"SELECT {KEY}, timesteps, abs_timesteps, split, {r('y')} FROM feat "
        f"WHERE parameter_index BETWEEN {ORDERED_RANGE[0]} AND {ORDERED_RANGE[1]}", upto="feat"),
    "saved_report": sql(f"SELECT {PREDICTED} FROM forecasts", upto="forecasts"),
}
