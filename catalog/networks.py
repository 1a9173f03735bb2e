"""The two networks, their gradients and their training written out in SQL, for the checks.

Every row has its numbers as columns. Parameters are literals, or one row of lists that an update in the
same statement made, so a whole run can be followed.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from catalog.tables import metrics_sql
from ratewell.models.network import TASKS
from ratewell.models.scoring import MultiTaskModel
from ratewell.models.training import TrainConfig, deal_batches
from ratewell.schemas import METRIC_NAMES

Cell = Callable[..., str]


def _number(v: float) -> str:
    text = repr(float(v))
    return text if "e" in text else text + "e0"


def _sum(a: Sequence[str], b: Sequence[str]) -> str:
    return " + ".join(f"{x} * {y}" for x, y in zip(a, b))


def network_sql(model: MultiTaskModel, prefix: str = "n") -> str:
    """CTEs that run a network with literal parameters over ``vectors``; see :func:`forward_sql`."""
    p = model.params

    def wide(name: str, *at) -> str:
        values = p[name][at[0], :, at[1]] if len(at) == 2 else p[name][:, at[0]]
        return f"[{', '.join(map(_number, values))}]"

    source = f"""{prefix}_in AS (
      SELECT key, CAST(x AS DOUBLE[]) AS x, y_income AS y1, y_never_married AS y2 FROM vectors)"""
    return f"{source}, {forward_sql(model, prefix, lambda name, *at: _number(p[name][at]), wide)}"


def forward_sql(model: MultiTaskModel, prefix: str, cell: Cell, wide: Cell) -> str:
    """CTEs from ``{prefix}_in`` to ``{prefix}_out`` with every number named: ``h{level}_{expert}_{j}``,
    ``r``, ``mu``, ``sd``, ``o{level}_{expert}_{k}``, ``w{level}_{task}_{expert}``, ``mix{level}_{task}_{k}``,
    ``u{task}_{k}``, ``z1`` and ``z2``. ``cell`` spells a parameter, ``wide`` the list of those that meet
    the raw features."""
    c = model.config
    experts, hidden, width = range(c.experts), range(c.expert_hidden), range(c.d_model)
    ctes, last = [], f"{prefix}_in"

    def add(cells: list[str]) -> None:
        nonlocal last
        name = f"{prefix}_{len(ctes) + 1}"
        ctes.append(f"{name} AS (SELECT *, {', '.join(cells)} FROM {last})")
        last = name

    for level in range(1, c.num_levels + 1):
        add([
            f"greatest(0e0, list_dot_product(x, {wide(f'{level}.hidden.weight', e, j)})"
            f" + {cell(f'{level}.hidden.bias', e, 0, j)}) AS h{level}_{e}_{j}"
            for e in experts for j in hidden
        ])
        add([
            _sum([f"h{level}_{e}_{j}" for j in hidden], [cell(f"{level}.out.weight", e, j, k) for j in hidden])
            + f" + {cell(f'{level}.out.bias', e, 0, k)} AS r{level}_{e}_{k}"
            for e in experts for k in width
        ])
        add([
            f"({' + '.join(f'r{level}_{e}_{k}' for k in width)}) / {len(width)} AS mu{level}_{e}"
            for e in experts
        ])
        add([
            f"sqrt(({' + '.join(f'pow(r{level}_{e}_{k} - mu{level}_{e}, 2)' for k in width)}) / {len(width)}"
            f" + 1e-5) AS sd{level}_{e}"
            for e in experts
        ])
        add([
            f"(r{level}_{e}_{k} - mu{level}_{e}) / sd{level}_{e} * {cell(f'{level}.norm.weight', e, 0, k)}"
            f" + {cell(f'{level}.norm.bias', e, 0, k)} AS o{level}_{e}_{k}"
            for e in experts for k in width
        ])
        cells = []
        for i, t in enumerate(TASKS, 1):
            name = f"{level}.gate.{t}.weight"
            for e in experts:
                a = f"list_dot_product(x, {wide(name, e)})" if level == 1 else _sum(
                    [f"mix{level - 1}_{i}_{k}" for k in width], [cell(name, k, e) for k in width]
                )
                cells.append(f"exp({a} + {cell(f'{level}.gate.{t}.bias', e)}) AS a{level}_{i}_{e}")
        add(cells)
        add([
            f"a{level}_{i}_{e} / ({' + '.join(f'a{level}_{i}_{f}' for f in experts)}) AS w{level}_{i}_{e}"
            for i in (1, 2) for e in experts
        ])
        add([
            f"{_sum([f'w{level}_{i}_{e}' for e in experts], [f'o{level}_{e}_{k}' for e in experts])}"
            f" AS mix{level}_{i}_{k}"
            for i in (1, 2) for k in width
        ])
    units = range(max(1, c.d_model // 2))
    top = {i: [f"mix{c.num_levels}_{i}_{k}" for k in width] for i in (1, 2)}
    add([
        f"greatest(0e0, {_sum(top[i], [cell(f'tower.{t}.hidden.weight', k, j) for k in width])}"
        f" + {cell(f'tower.{t}.hidden.bias', j)}) AS u{i}_{j}"
        for i, t in enumerate(TASKS, 1) for j in units
    ])
    add([
        f"{_sum([f'u{i}_{j}' for j in units], [cell(f'tower.{t}.out.weight', j, 0) for j in units])}"
        f" + {cell(f'tower.{t}.out.bias', 0)} AS z{i}"
        for i, t in enumerate(TASKS, 1)
    ])
    ctes.append(f"{prefix}_out AS MATERIALIZED (SELECT * FROM {last})")
    return ", ".join(ctes)


# Parameters as rows (q, i, v, m, s): all narrow ones are list 0, every list of parameters that meets the
# raw features is one of its own; m and s are the moments.


def _wide(model: MultiTaskModel) -> list[tuple[str, tuple[int, ...]]]:
    """Parameter and place of each list that meets the raw features, in order of its number."""
    c, found = model.config, []
    for name in c.trained():
        if name.endswith("hidden.weight") and not name.startswith("tower"):
            found += [(name, (e, j)) for e in range(c.experts) for j in range(c.expert_hidden)]
        elif name.startswith("1.gate.") and name.endswith("weight"):
            found += [(name, (e,)) for e in range(c.experts)]
    return found


def _narrow(model: MultiTaskModel) -> list[tuple[str, int]]:
    """Parameter and place of each cell of list 0."""
    wide = {name for name, _ in _wide(model)}
    return [(n, i) for n in model.config.trained() if n not in wide for i in range(model.params[n].size)]


def start_sql(model: MultiTaskModel) -> str:
    """CTE ``start``: the parameters of a model, with moments of zero."""
    p = model.params
    lists = [[p[n].ravel()[i] for n, i in _narrow(model)]]
    lists += [p[n][at[0], :, at[1]] if len(at) == 2 else p[n][:, at[0]] for n, at in _wide(model)]
    rows = ", ".join(f"({q}, [{', '.join(map(_number, values))}])" for q, values in enumerate(lists))
    return f"""start AS MATERIALIZED (
      SELECT q, unnest(vs) AS v, generate_subscripts(vs, 1) AS i, 0e0 AS m, 0e0 AS s
      FROM (VALUES {rows}) AS lists(q, vs))"""


def weights_sql(income: object, never: object) -> str:
    """CTE ``positive``: what a positive label weighs, per task."""
    return f"positive AS MATERIALIZED (SELECT CAST({income} AS DOUBLE) AS p1, CAST({never} AS DOUBLE) AS p2)"


def scored_sql(model: MultiTaskModel, prefix: str, rows: str, theta: str) -> str:
    """CTEs that run the network with the parameters of ``theta`` over ``rows``, to ``{prefix}_out``."""
    place = {at: k for k, at in enumerate(_narrow(model), 1)}
    number = {at: q for q, at in enumerate(_wide(model), 1)}

    def cell(name: str, *at) -> str:
        i = 0
        for k, n in zip(at, model.params[name].shape):
            i = i * n + k
        return f"t[{place[name, i]}]"

    def wide(name: str, *at) -> str:
        return f"t{number[name, at]}"

    lists = [f"list(v ORDER BY i) FILTER (q = {q}) AS t{q or ''}" for q in range(len(number) + 1)]
    return f"""{prefix}_lists AS MATERIALIZED (SELECT {", ".join(lists)} FROM {theta}),
    {prefix}_in AS (
      SELECT key, CAST(x AS DOUBLE[]) AS x, y_income AS y1, y_never_married AS y2, positive.*, l.*
      FROM {rows} CROSS JOIN positive CROSS JOIN {prefix}_lists l),
    {forward_sql(model, prefix, cell, wide)}"""


def gradient_sql(model: MultiTaskModel, prefix: str) -> str:
    """CTEs from ``{prefix}_out`` to ``{prefix}_gradient`` (q, i, g): the mean over the rows, by the chain rule."""
    c = model.config
    experts, hidden, width = range(c.experts), range(c.expert_hidden), range(c.d_model)
    units = range(max(1, c.d_model // 2))
    place = {at: k for k, at in enumerate(_narrow(model), 1)}
    ctes, last = [], f"{prefix}_out"
    of: dict[tuple[str, tuple[int, ...]], str] = {}  # gradient of a cell in one row

    def cell(name: str, *at) -> str:
        i = 0
        for k, n in zip(at, model.params[name].shape):
            i = i * n + k
        return f"t[{place[name, i]}]"

    def add(cells: list[str]) -> None:
        nonlocal last
        name = f"{prefix}_b{len(ctes)}"
        ctes.append(f"{name} AS (SELECT *, {', '.join(cells)} FROM {last})")
        last = name

    add([f"(1 - y{i}) - (1 + (p{i} - 1) * y{i}) / (1 + exp(z{i})) AS d{i}" for i in (1, 2)])
    add([
        f"CASE WHEN u{i}_{j} > 0 THEN d{i} * {cell(f'tower.{t}.out.weight', j, 0)} ELSE 0 END AS du{i}_{j}"
        for i, t in enumerate(TASKS, 1) for j in units
    ])
    n = c.num_levels
    add([
        f"{_sum([f'du{i}_{j}' for j in units], [cell(f'tower.{t}.hidden.weight', k, j) for j in units])}"
        f" AS dmix{n}_{i}_{k}"
        for i, t in enumerate(TASKS, 1) for k in width
    ])
    for i, t in enumerate(TASKS, 1):
        of[f"tower.{t}.out.bias", (0,)] = f"d{i}"
        of |= {(f"tower.{t}.out.weight", (j, 0)): f"d{i} * u{i}_{j}" for j in units}
        of |= {(f"tower.{t}.hidden.bias", (j,)): f"du{i}_{j}" for j in units}
        of |= {
            (f"tower.{t}.hidden.weight", (k, j)): f"du{i}_{j} * mix{n}_{i}_{k}" for k in width for j in units
        }
    for level in range(n, 0, -1):
        a = str(level)
        add([
            f"{_sum([f'w{a}_{i}_{e}' for i in (1, 2)], [f'dmix{a}_{i}_{k}' for i in (1, 2)])} AS do{a}_{e}_{k}"
            for e in experts for k in width
        ] + [
            f"{_sum([f'dmix{a}_{i}_{k}' for k in width], [f'o{a}_{e}_{k}' for k in width])} AS dw{a}_{i}_{e}"
            for i in (1, 2) for e in experts
        ] + [
            f"(r{a}_{e}_{k} - mu{a}_{e}) / sd{a}_{e} AS unit{a}_{e}_{k}" for e in experts for k in width
        ])
        add([
            f"w{a}_{i}_{e} * (dw{a}_{i}_{e}"
            f" - ({_sum([f'dw{a}_{i}_{f}' for f in experts], [f'w{a}_{i}_{f}' for f in experts])})) AS da{a}_{i}_{e}"
            for i in (1, 2) for e in experts
        ] + [
            f"do{a}_{e}_{k} * {cell(f'{a}.norm.weight', e, 0, k)} AS dunit{a}_{e}_{k}"
            for e in experts for k in width
        ])
        add([
            f"(dunit{a}_{e}_{k} - ({' + '.join(f'dunit{a}_{e}_{f}' for f in width)}) / {len(width)}"
            f" - unit{a}_{e}_{k} * ({_sum([f'dunit{a}_{e}_{f}' for f in width], [f'unit{a}_{e}_{f}' for f in width])})"
            f" / {len(width)}) / sd{a}_{e} AS dr{a}_{e}_{k}"
            for e in experts for k in width
        ])
        cells = [
            f"CASE WHEN h{a}_{e}_{j} > 0 THEN"
            f" {_sum([f'dr{a}_{e}_{k}' for k in width], [cell(f'{a}.out.weight', e, j, k) for k in width])}"
            f" ELSE 0 END AS dh{a}_{e}_{j}"
            for e in experts for j in hidden
        ]
        if level > 1:
            cells += [
                f"{_sum([f'da{a}_{i}_{e}' for e in experts], [cell(f'{a}.gate.{t}.weight', k, e) for e in experts])}"
                f" AS dmix{level - 1}_{i}_{k}"
                for i, t in enumerate(TASKS, 1) for k in width
            ]
        add(cells)
        for e in experts:
            for k in width:
                of[f"{a}.norm.weight", (e, 0, k)] = f"do{a}_{e}_{k} * unit{a}_{e}_{k}"
                of[f"{a}.norm.bias", (e, 0, k)] = f"do{a}_{e}_{k}"
                of[f"{a}.out.bias", (e, 0, k)] = f"dr{a}_{e}_{k}"
                of |= {(f"{a}.out.weight", (e, j, k)): f"h{a}_{e}_{j} * dr{a}_{e}_{k}" for j in hidden}
            of |= {(f"{a}.hidden.bias", (e, 0, j)): f"dh{a}_{e}_{j}" for j in hidden}
            for i, t in enumerate(TASKS, 1):
                of[f"{a}.gate.{t}.bias", (e,)] = f"da{a}_{i}_{e}"
                if level > 1:
                    of |= {(f"{a}.gate.{t}.weight", (k, e)): f"da{a}_{i}_{e} * mix{level - 1}_{i}_{k}" for k in width}
    flat = {}
    for (name, at), slope in of.items():
        i = 0
        for k, size in zip(at, model.params[name].shape):
            i = i * size + k
        flat[name, i] = slope
    narrow = ", ".join(f"avg({flat[at]})" for at in _narrow(model))
    task = {t: i for i, t in enumerate(TASKS, 1)}
    slopes = [
        f"dh{name[0]}_{at[0]}_{at[1]}" if len(at) == 2 else f"da1_{task[name.split('.')[2]]}_{at[0]}"
        for name, at in _wide(model)
    ]
    ctes.append(f"{prefix}_back AS MATERIALIZED (SELECT * FROM {last})")
    ctes.append(f"""{prefix}_spread AS (
      SELECT generate_subscripts(x, 1) AS i, unnest(x) AS x_i, {", ".join(slopes)} FROM {prefix}_back)""")
    ctes.append(f"""{prefix}_by_cell AS (
      SELECT i, [{", ".join(f"avg(x_i * {slope})" for slope in slopes)}] AS gs FROM {prefix}_spread GROUP BY i)""")
    ctes.append(f"{prefix}_flat AS (SELECT [{narrow}] AS gs FROM {prefix}_back)")
    ctes.append(f"""{prefix}_gradient AS MATERIALIZED (
      SELECT 0 AS q, generate_subscripts(gs, 1) AS i, unnest(gs) AS g FROM {prefix}_flat
      UNION ALL SELECT generate_subscripts(gs, 1) AS q, i, unnest(gs) AS g FROM {prefix}_by_cell)""")
    return ", ".join(ctes)


def step_sql(
    model: MultiTaskModel, prefix: str, rows: str, theta: str, turn: int = 1, lr: str = "0.002",
    decay: float = 1e-4, clip: float = 1.0,
) -> str:
    """CTEs of the ``turn``-th update, by the rows of ``rows``: scores in ``{prefix}_out``, the gradient in
    ``{prefix}_gradient`` and the parameters after it in ``{prefix}_theta``."""
    return f"""{scored_sql(model, prefix, rows, theta)}, {gradient_sql(model, prefix)},
    {prefix}_norm AS (SELECT least(1, {clip} / (sqrt(sum(g * g)) + 1e-6)) AS share FROM {prefix}_gradient),
    {prefix}_moments AS (
      SELECT q, i, v, 0.9e0 * m + 0.1e0 * (g * share) AS m, 0.999e0 * s + 0.001e0 * pow(g * share, 2) AS s
      FROM {theta} JOIN {prefix}_gradient USING (q, i) CROSS JOIN {prefix}_norm),
    {prefix}_theta AS MATERIALIZED (
      SELECT q, i, m, s, v * (1 - ({lr}) * {decay!r}) - ({lr}) * (m / (1 - pow(0.9e0, {turn})))
        / (sqrt(s / (1 - pow(0.999e0, {turn}))) + 1e-8) AS v
      FROM {prefix}_moments)"""


def named_sql(model: MultiTaskModel, table: str, value: str) -> str:
    """The rows of a table by (q, i) as (param, place), the place in the parameter's own order."""
    narrow = ", ".join(f"(0, {k}, '{n}', {i})" for k, (n, i) in enumerate(_narrow(model), 1))
    wide = []
    for q, (name, at) in enumerate(_wide(model), 1):
        shape = model.params[name].shape
        first = at[0] * shape[1] * shape[2] + at[1] if len(at) == 2 else at[0]
        wide.append(f"({q}, '{name}', {first}, {shape[-1]})")
    return f"""
    SELECT param, CAST(place AS BIGINT) AS place, {value}
    FROM {table} JOIN (VALUES {narrow}) AS cells(q, i, param, place) USING (q, i)
    UNION ALL SELECT param, CAST(first + (i - 1) * step AS BIGINT) AS place, {value}
    FROM {table} JOIN (VALUES {", ".join(wide)}) AS lists(q, param, first, step) USING (q)"""


def fit_sql(model: MultiTaskModel, config: TrainConfig) -> str:
    """CTEs of a whole run over ``vectors``, ending in ``log``.

    A row's bucket is its key modulo the number of buckets, and every fifth row is for validation. Which
    buckets make a batch is drawn by the trainer and written as numbers.
    """
    rate = lambda done: f"{config.lr!r} * (1 + cos(pi() * {done} / {config.epochs})) / 2"
    positive = [f"(SELECT sum(1 - {y}) * 1e0 / greatest(1, sum({y})) FROM train)" for y in ("y_income", "y_never_married")]
    ctes = [
        "train AS (SELECT * FROM vectors WHERE key % 5 <> 4)", "val AS (SELECT * FROM vectors WHERE key % 5 = 4)",
        weights_sql(*positive), start_sql(model),
    ]
    theta, turn, logs = "start", 0, []
    for epoch in range(1, config.epochs + 1):
        scored = []
        for batch, buckets in enumerate(deal_batches(config.seed, epoch, range(config.buckets), config.batches_per_epoch)):
            turn += 1
            s = f"s{turn}"
            inside = ", ".join(str(b) for b in buckets)
            ctes.append(f"{s}_rows AS (SELECT * FROM train WHERE key % {config.buckets} IN ({inside}))")
            ctes.append(step_sql(
                model, s, f"{s}_rows", theta, turn, rate(epoch - 1), config.weight_decay, config.grad_clip
            ))
            theta = f"{s}_theta"
            scored.append(f"SELECT {batch} AS batch, z1, z2, y1, y2, p1, p2 FROM {s}_out")
        e, v = f"e{epoch}", f"v{epoch}"
        ctes.append(f"{e}_rows AS ({' UNION ALL '.join(scored)})")
        ctes.append(metrics_sql("batch", f"{e}_rows", e, ("p1", "p2")))
        ctes.append(scored_sql(model, v, "val", theta))
        ctes.append(metrics_sql("1", f"{v}_out", v, ("p1", "p2")))
        means = [f"avg({c}) AS {c}" for c in METRIC_NAMES[1:7]]
        logs.append(f"""SELECT {epoch} AS epoch, 'train' AS part, avg(inc_loss) + avg(nm_loss) AS loss,
          {", ".join(means)}, (avg(inc_auc) + avg(nm_auc)) / 2 AS combined_auc FROM {e}metrics
          UNION ALL SELECT {epoch}, 'val', {", ".join(METRIC_NAMES)} FROM {v}metrics""")
    ctes.append(f"logged AS ({' UNION ALL '.join(logs)})")
    ctes.append("top AS (SELECT epoch FROM logged WHERE part = 'val' ORDER BY combined_auc DESC, epoch LIMIT 1)")
    ctes.append(f"""log AS (
      SELECT epoch, part, round({rate("epoch")}, 9) AS lr, epoch = (SELECT epoch FROM top) AS best,
        {", ".join(f"round({c}, 6) AS {c}" for c in METRIC_NAMES)} FROM logged)""")
    return ", ".join(ctes)
