"""SQL that solves regression models, to check the estimators.

Each Newton step is one common table expression or a few.  The first functions solve
small systems by hand: one 0/1 exposure next to stratum intercepts, Cox models with one
or two 0/1 covariates.  ``logistic_fits`` and ``cox_fits`` take any columns and solve
by elimination.
"""

from __future__ import annotations

Z = "1.959963984540054::DOUBLE"


def effect_columns(beta: str, error: str, ratio: str, low: str, high: str) -> str:
    """Rounded ratio, standard error, statistic and Wald bounds."""
    return (
        f"round(exp({beta}), 6) AS {ratio}, round({error}, 6) AS std_error, "
        f"round({beta} / {error}, 6) AS statistic, "
        f"round(exp({beta} - {Z} * {error}), 6) AS {low}, "
        f"round(exp({beta} + {Z} * {error}), 6) AS {high}"
    )


def one_factor(long: str) -> str:
    """Closed form for one factor: rows (model, level, reference, y)."""
    return f"""
    WITH cells AS (SELECT model, level, reference,
        (count(*) FILTER (WHERE y = 1))::DOUBLE AS a,
        (count(*) FILTER (WHERE y = 0))::DOUBLE AS b
      FROM ({long}) WHERE level IS NOT NULL AND y IS NOT NULL GROUP BY ALL),
    base AS (SELECT model, a AS c, b AS d FROM cells WHERE level = reference),
    effects AS (
      SELECT model, '(Intercept)' AS term, ln(c / d) AS beta,
        sqrt(1 / c + 1 / d) AS se FROM base
      UNION ALL
      SELECT model, model || '=' || level, ln(a * d / (b * c)),
        sqrt(1 / a + 1 / b + 1 / c + 1 / d)
      FROM cells JOIN base USING (model) WHERE level <> reference)
    SELECT model, term,
      {effect_columns("beta", "se", "estimate", "conf_low", "conf_high")}
    FROM effects
    """


def exposure_with_strata(long: str, keys: str = "model", steps: int = 12) -> str:
    """Logistic fit of a 0/1 exposure with one intercept per group.

    Rows are (keys, grp, x, y).  The group block of the information matrix is
    diagonal and is eliminated before the exposure is solved.
    """
    parts = [f"""
    cells AS MATERIALIZED (SELECT {keys}, grp, x::DOUBLE AS x, count(*)::DOUBLE AS n,
        sum(y)::DOUBLE AS k FROM ({long})
      WHERE grp IS NOT NULL AND x IS NOT NULL AND y IS NOT NULL GROUP BY ALL),
    s0 AS MATERIALIZED (SELECT DISTINCT {keys}, grp, 0::DOUBLE AS a, 0::DOUBLE AS b
      FROM cells)
    """]
    for i in range(steps):
        parts.append(f"""
    m{i} AS (SELECT {keys}, grp, x, n, k, a, b, 1 / (1 + exp(-(a + b * x))) AS mu
      FROM cells JOIN s{i} USING ({keys}, grp)),
    h{i} AS MATERIALIZED (SELECT {keys}, grp, any_value(a) AS a, any_value(b) AS b,
        sum(n * mu * (1 - mu)) AS haa, sum(x * n * mu * (1 - mu)) AS hab,
        sum(k - n * mu) AS ga, sum(x * (k - n * mu)) AS gb
      FROM m{i} GROUP BY {keys}, grp),
    d{i} AS MATERIALIZED (SELECT {keys},
        sum(hab) - sum(hab * hab / haa) AS info,
        (sum(gb) - sum(hab * ga / haa)) / (sum(hab) - sum(hab * hab / haa)) AS db
      FROM h{i} GROUP BY {keys}),
    s{i + 1} AS MATERIALIZED (SELECT {keys}, grp, a + (ga - hab * db) / haa AS a,
        b + db AS b FROM h{i} JOIN d{i} USING ({keys}))
        """)
    effects = effect_columns(
        "any_value(b)", "any_value(1 / sqrt(info))", "estimate", "conf_low", "conf_high"
    )
    return (
        "WITH " + ",".join(parts)
        + f"SELECT {keys}, {effects} FROM s{steps} JOIN d{steps - 1} USING ({keys}) "
        f"GROUP BY {keys}"
    )


def profile_two_by_two(long: str, steps: int = 70) -> str:
    """Profile-likelihood bounds of a 0/1 exposure, rows (model, x, y).

    For a fixed odds ratio the best intercept is the root of a quadratic, so
    the bounds follow by bisection.
    """
    ln_lik = (
        "k * ln({u}) + k1 * {b} - n0 * ln(1 + {u}) - n1 * ln(1 + exp({b}) * {u})"
    )
    root = """(-(n0 + n1 * exp({b}) - k * (1 + exp({b})))
      + sqrt(power(n0 + n1 * exp({b}) - k * (1 + exp({b})), 2)
        + 4 * (n0 + n1 - k) * exp({b}) * k)) / (2 * (n0 + n1 - k) * exp({b}))"""
    at_best = ln_lik.format(u=f"({root.format(b='best')})", b="best")
    at_middle = ln_lik.format(u=f"({root.format(b='middle')})", b="middle")
    return f"""
    WITH RECURSIVE cells AS (SELECT model, count(*)::DOUBLE AS n, sum(y)::DOUBLE AS k,
        sum(x * y)::DOUBLE AS k1, sum(x)::DOUBLE AS n1, sum(1 - x)::DOUBLE AS n0
      FROM ({long}) WHERE x IS NOT NULL AND y IS NOT NULL GROUP BY model),
    fits AS (SELECT *, ln(k1 * (n0 - (k - k1)) / ((n1 - k1) * (k - k1))) AS best
      FROM cells),
    bounds AS (
      SELECT model, side, 0 AS i, best AS inside, best + side * 8 AS outside
      FROM fits, (VALUES (-1), (1)) AS s(side)
      UNION ALL
      SELECT model, side, i + 1,
        CASE WHEN near THEN middle ELSE inside END,
        CASE WHEN near THEN outside ELSE middle END
      FROM (SELECT model, side, i, inside, outside, middle,
          2 * (({at_best}) - ({at_middle})) < {Z} * {Z} AS near
        FROM (SELECT b.*, (inside + outside) / 2 AS middle FROM bounds b
          WHERE i < {steps}) JOIN fits USING (model)))
    SELECT model,
      round(exp(max(inside) FILTER (WHERE side = -1)), 6) AS conf_low,
      round(exp(max(inside) FILTER (WHERE side = 1)), 6) AS conf_high
    FROM bounds WHERE i = {steps} GROUP BY model
    """


def cox_one(rows: str, steps: int = 10) -> str:
    """Cox model with Efron ties and one 0/1 covariate, rows (t, x, event)."""
    parts = [f"""
    per AS (SELECT round(t, 9) AS t, (count(*) FILTER (WHERE x = 0))::DOUBLE AS n0,
        (count(*) FILTER (WHERE x = 1))::DOUBLE AS n1,
        coalesce(sum(event) FILTER (WHERE x = 0), 0)::DOUBLE AS d0,
        coalesce(sum(event) FILTER (WHERE x = 1), 0)::DOUBLE AS d1
      FROM ({rows}) WHERE x IS NOT NULL GROUP BY 1),
    risk AS (SELECT d0, d1, d0 + d1 AS d, sum(n0) OVER w AS r0, sum(n1) OVER w AS r1
      FROM per WINDOW w AS (ORDER BY t DESC)),
    ties AS MATERIALIZED (SELECT *, l / d AS f FROM (SELECT *,
      unnest(range(d::BIGINT)) AS l FROM risk WHERE d > 0)),
    b0 AS MATERIALIZED (SELECT 0::DOUBLE AS b, 1::DOUBLE AS info)
    """]
    for i in range(steps):
        parts.append(f"""
    b{i + 1} AS MATERIALIZED (SELECT any_value(b) + sum(d1 / d - p) / sum(p * (1 - p))
        AS b, sum(p * (1 - p)) AS info
      FROM (SELECT b, d, d1, (r1 - f * d1) * exp(b)
          / (r0 - f * d0 + (r1 - f * d1) * exp(b)) AS p FROM ties, b{i}))
        """)
    return "WITH " + ",".join(parts) + f"SELECT * FROM b{steps}"


def cox_two(long: str, steps: int = 10) -> str:
    """Cox models with two 0/1 covariates, rows (model, t, x1, x2, event).

    Returns the coefficients b1, b2 and the inverse information v1, v2.
    """
    cells = ["00", "10", "01", "11"]
    counts = ", ".join(
        f"(count(*) FILTER (WHERE x1 = {c[0]} AND x2 = {c[1]}))::DOUBLE AS n{c}, "
        f"coalesce(sum(event) FILTER (WHERE x1 = {c[0]} AND x2 = {c[1]}), 0)::DOUBLE "
        f"AS d{c}"
        for c in cells
    )
    running = ", ".join(f"sum(n{c}) OVER w AS r{c}, d{c}" for c in cells)
    parts = [f"""
    per AS (SELECT model, round(t, 9) AS t, {counts} FROM ({long})
      WHERE x1 IS NOT NULL AND x2 IS NOT NULL GROUP BY 1, 2),
    risk AS (SELECT model, {running}, d00 + d10 + d01 + d11 AS d FROM per
      WINDOW w AS (PARTITION BY model ORDER BY t DESC)),
    ties AS MATERIALIZED (SELECT model, d, (d10 + d11) / d AS e1, (d01 + d11) / d AS e2,
        {", ".join(f"r{c} - l / d * d{c} AS q{c}" for c in cells)}
      FROM (SELECT *, unnest(range(d::BIGINT)) AS l FROM risk WHERE d > 0)),
    b0 AS MATERIALIZED (SELECT DISTINCT model, 0::DOUBLE AS b1, 0::DOUBLE AS b2
      FROM ties)
    """]
    for i in range(steps):
        parts.append(f"""
    w{i} AS (SELECT model, b1, b2, e1, e2, q00 + q10 * exp(b1) + q01 * exp(b2)
        + q11 * exp(b1 + b2) AS s,
        q10 * exp(b1) + q11 * exp(b1 + b2) AS s1,
        q01 * exp(b2) + q11 * exp(b1 + b2) AS s2, q11 * exp(b1 + b2) AS s12
      FROM ties JOIN b{i} USING (model)),
    g{i} AS (SELECT model, any_value(b1) AS b1, any_value(b2) AS b2,
        sum(e1 - s1 / s) AS g1, sum(e2 - s2 / s) AS g2,
        sum(s1 / s * (1 - s1 / s)) AS h11, sum(s2 / s * (1 - s2 / s)) AS h22,
        sum(s12 / s - s1 / s * (s2 / s)) AS h12
      FROM w{i} GROUP BY model),
    b{i + 1} AS MATERIALIZED (SELECT model,
        b1 + (h22 * g1 - h12 * g2) / (h11 * h22 - h12 * h12) AS b1,
        b2 + (h11 * g2 - h12 * g1) / (h11 * h22 - h12 * h12) AS b2,
        h22 / (h11 * h22 - h12 * h12) AS v1, h11 / (h11 * h22 - h12 * h12) AS v2
      FROM g{i})
        """)
    return "WITH " + ",".join(parts) + f"SELECT * FROM b{steps}"


def indicators(name: str, levels: tuple[str, ...], label: str | None = None) -> dict[str, str]:
    """Design columns of a category, reference first; NULL for other values."""
    listed = ", ".join(f"'{v}'" for v in levels)
    return {
        f"{label or name}={v}": f"CASE WHEN {name} IN ({listed}) THEN ({name} = '{v}')::INT END"
        for v in levels[1:]
    }


def _cells(models: dict[str, tuple[str, dict[str, str]]], keep: str, sums: str) -> str:
    """Rows with equal design, counted per model, and the names of the columns.

    ``models``: a name to its rows and its design columns; rows with NULL in a column
    are left out.
    """
    cells = " UNION ALL ".join(
        f"SELECT '{name}' AS model, x, {keep} {sums} FROM (SELECT *, "
        f"[{', '.join(f'({e})::DOUBLE' for e in columns.values())}]::DOUBLE[] AS x "
        f"FROM ({rows})) WHERE len(list_filter(x, lambda v: v IS NULL)) = 0 GROUP BY ALL"
        for name, (rows, columns) in models.items()
    )
    names = ", ".join(
        f"('{name}', {j}, '{term}')"
        for name, (_, columns) in models.items() for j, term in enumerate(columns, 1)
    )
    return (
        f"cells AS MATERIALIZED ({cells}), "
        f"names AS (SELECT * FROM (VALUES {names}) AS v(model, j, term))"
    )


def _eliminated(source: str, name: str, keys: str, size: int) -> str:
    """Gauss-Jordan elimination of systems (keys, i, j, v); smaller systems end earlier."""
    parts, last = [], source
    for k in range(1, size + 1):
        own = name if k == size else f"{name}_{k}"
        parts.append(f"""
    {own} AS {"MATERIALIZED" if k == size else ""} (SELECT {keys}, i, j,
        CASE WHEN lead_v IS NULL THEN v WHEN i = {k} THEN v / lead_v
          ELSE v - of_row / lead_v * of_column END AS v
      FROM (SELECT *,
          max(v) FILTER (WHERE i = {k} AND j = {k}) OVER (PARTITION BY {keys}) AS lead_v,
          max(v) FILTER (WHERE j = {k}) OVER (PARTITION BY {keys}, i) AS of_row,
          max(v) FILTER (WHERE i = {k}) OVER (PARTITION BY {keys}, j) AS of_column
        FROM {last}))""")
        last = own
    return ",".join(parts)


def _moved(source: str, solved: str, keys: str, beta: str = "beta") -> str:
    """Vectors of ``source`` plus the solutions of their systems (column 0)."""
    return (
        f"SELECT s.* REPLACE ([{beta}[q] + step[q] for q in range(1, len({beta}) + 1)] "
        f"AS {beta}) FROM {source} s JOIN (SELECT {keys}, list(v ORDER BY i) AS step "
        f"FROM {solved} WHERE j = 0 GROUP BY {keys}) USING ({keys})"
    )


def _p_value(z: str) -> str:
    """Two-sided normal p-value by the power series of the error function."""
    series = "1"
    for k in range(90, 0, -1):
        series = f"1 + s / {2 * k + 1} * ({series})"
    return (
        f"(SELECT CASE WHEN s > 32 THEN 0 ELSE 1 - 2 / sqrt(pi()) * exp(-s / 2) "
        f"* sqrt(s / 2) * ({series}) END FROM (SELECT ({z}) * ({z}) AS s))"
    )


def _logistic_system(trials: str, keys: str, beta: str, size: int) -> str:
    """Information (i, j) and scores (i, 0) of every trial vector."""
    return f"""
      SELECT {keys}, i, j, sum(n * mu * (1 - mu) * x[i] * x[j]) AS v
      FROM (SELECT {trials}.*, x, n, k,
          1 / (1 + exp(-list_dot_product(x, {beta}))) AS mu
        FROM {trials} JOIN cells USING (model)),
        range(1, {size + 1}) AS r(i), range(1, {size + 1}) AS c(j)
      WHERE i <= len(x) AND j <= len(x) GROUP BY ALL
      UNION ALL
      SELECT {keys}, i, 0 AS j, sum((k - n * mu) * x[i]) AS v
      FROM (SELECT {trials}.*, x, n, k,
          1 / (1 + exp(-list_dot_product(x, {beta}))) AS mu
        FROM {trials} JOIN cells USING (model)), range(1, {size + 1}) AS r(i)
      WHERE i <= len(x) GROUP BY ALL"""


def _identity(size: int) -> str:
    return f"""
      UNION ALL SELECT model, i, {size} + j, (i = j)::INT::DOUBLE FROM
        (SELECT model, j AS i FROM names) JOIN (SELECT model, j FROM names) USING (model)"""


def _newton(size: int, steps: int, system) -> str:
    parts = ["""
    b0 AS MATERIALIZED (SELECT model, [0::DOUBLE for q in range(count(*))] AS beta
      FROM names GROUP BY model)"""]
    for t in range(steps):
        # The last step's system also gives the inverse information.
        more = _identity(size) if t == steps - 1 else ""
        parts.append(f"h{t} AS MATERIALIZED ({system(t)}{more})")
        parts.append(_eliminated(f"h{t}", f"a{t}", "model", size))
        parts.append(f"b{t + 1} AS MATERIALIZED ({_moved(f'b{t}', f'a{t}', 'model')})")
    parts.append(f"""
    fitted AS MATERIALIZED (SELECT model, j, term, beta[j] AS beta, sqrt(v) AS se
      FROM b{steps} JOIN names USING (model)
        JOIN (SELECT model, i AS j, v FROM a{steps - 1} WHERE j = {size} + i)
        USING (model, j))""")
    return ",".join(parts)


def logistic_fits(
    models: dict[str, tuple[str, dict[str, str]]], profile: bool = False,
    steps: int = 12, key: str = "model,",
) -> str:
    """Logistic models with any columns, every term; rows have the outcome ``y``.

    With ``profile`` the bounds solve for the drop of the likelihood and the other
    coefficients' scores together.  ``key``: the SQL of the columns that name a model.
    """
    models = {
        name: (f"SELECT * FROM ({rows}) WHERE y IS NOT NULL", {"(Intercept)": "1", **columns})
        for name, (rows, columns) in models.items()
    }
    size = max(len(columns) for _, columns in models.values())
    parts = [
        _cells(models, "", "count(*)::DOUBLE AS n, sum(y)::DOUBLE AS k"),
        _newton(size, steps, lambda t: _logistic_system(f"b{t}", "model", "beta", size)),
        "counted AS (SELECT model, sum(n)::BIGINT AS n_obs FROM cells GROUP BY model)",
    ]
    low, high = f"beta - {Z} * se", f"beta + {Z} * se"
    source = "fitted"
    if profile:
        value = """
      SELECT {t}.model, {keys} sum(k * eta - n * (greatest(eta, 0) + ln(1 + exp(-abs(eta)))))
        AS value FROM (SELECT {t}.*, n, k, list_dot_product(x, {beta}) AS eta
          FROM {t} JOIN cells USING (model)) {t} GROUP BY ALL"""
        parts.append(f"best AS MATERIALIZED ({value.format(t=f'b{steps}', keys='', beta='beta')})")
        parts.append(f"""
    p0 AS MATERIALIZED (SELECT model, term, side, m.j AS slot,
        [whole[q] + side * {Z} * line[q] / se for q in range(1, len(whole) + 1)] AS theta
      FROM fitted f JOIN (SELECT model, beta AS whole FROM b{steps}) USING (model)
        JOIN (SELECT model, j - {size} AS j, list(v ORDER BY i) AS line FROM a{steps - 1}
          WHERE j > {size} GROUP BY ALL) m USING (model, j),
        (VALUES (-1), (1)) AS s(side))""")
        keys = "model, term, side, slot"
        for t in range(9):
            trial_value = value.format(t=f"p{t}", keys="term, side, slot,", beta="theta")
            parts.append(f"""
    q{t} AS MATERIALIZED ({_logistic_system(f"p{t}", keys, "theta", size)}),
    v{t} AS MATERIALIZED ({trial_value}),
    w{t} AS MATERIALIZED (
      SELECT {keys}, i, j, v FROM q{t} WHERE i <> slot
      UNION ALL SELECT {keys}, slot AS i, i AS j, -v FROM q{t} WHERE j = 0
      UNION ALL SELECT {keys}, slot AS i, 0 AS j, v{t}.value - best.value + {Z} * {Z} / 2
        FROM v{t} JOIN best USING (model))""")
            parts.append(_eliminated(f"w{t}", f"e{t}", keys, size))
            parts.append(
                f"p{t + 1} AS MATERIALIZED ({_moved(f'p{t}', f'e{t}', keys, 'theta')})"
            )
        parts.append("""
    bounded AS (SELECT f.*, below.theta[f.j] AS low, above.theta[f.j] AS high
      FROM fitted f JOIN p9 below ON f.model = below.model AND f.j = below.slot
          AND below.side = -1
        JOIN p9 above ON f.model = above.model AND f.j = above.slot AND above.side = 1)""")
        low, high, source = "low", "high", "bounded"
    return (
        "WITH " + ",".join(parts) + f"""
    SELECT {key} term, round(exp(beta), 6) AS estimate, round(se, 6) AS std_error,
      round(beta / se, 6) AS statistic, round({_p_value("beta / se")}, 6) AS p_value,
      round(exp({low}), 6) AS conf_low, round(exp({high}), 6) AS conf_high,
      n_obs, TRUE AS converged
    FROM {source} JOIN counted USING (model)"""
    )


def cox_fits(
    models: dict[str, tuple[str, dict[str, str]]], steps: int = 9, key: str = "model,"
) -> str:
    """Cox models with Efron ties and any columns, every term; rows have ``t``, ``event``."""
    size = max(len(columns) for _, columns in models.values())
    parts = [
        _cells(
            models, "round(t, 9) AS t,",
            "count(*)::DOUBLE AS n, sum(event)::DOUBLE AS d",
        ),
        """
    ties AS MATERIALIZED (SELECT model, t, d, unnest(range(d::BIGINT)) / d AS f
      FROM (SELECT model, t, sum(d) AS d FROM cells GROUP BY ALL) WHERE d > 0),
    counted AS (SELECT model, sum(n)::BIGINT AS n_obs, sum(d)::BIGINT AS n_events
      FROM cells GROUP BY model)""",
        f"""
    totals AS (SELECT model, i, sum(d * x[i]) AS v FROM cells, range(1, {size + 1}) AS r(i)
      WHERE i <= len(x) GROUP BY ALL)""",
    ]

    def system(t: int) -> str:
        return f"SELECT model, i, j, v FROM s{t}"

    newton = _newton(size, steps, system)
    for t in range(steps):
        own = f"""
    r{t} AS MATERIALIZED (
      SELECT model, t, i, j, sum(sum(n * w * z[i] * z[j])) OVER
          (PARTITION BY model, i, j ORDER BY t DESC) AS risk, sum(d * w * z[i] * z[j]) AS dead
      FROM (SELECT model, t, n, d, list_prepend(1::DOUBLE, x) AS z,
          exp(list_dot_product(x, beta)) AS w FROM cells JOIN b{t} USING (model)),
        range(1, {size + 2}) AS r(i), range(1, {size + 2}) AS c(j)
      WHERE i <= j AND j <= len(z) GROUP BY model, t, i, j),
    o{t} AS MATERIALIZED (SELECT model, t, f, risk - f * dead AS q0
      FROM r{t} JOIN ties USING (model, t) WHERE i = 1 AND j = 1),
    u{t} AS MATERIALIZED (SELECT model, t, f, j - 1 AS i, (risk - f * dead) / q0 AS m
      FROM r{t} JOIN o{t} USING (model, t) WHERE i = 1 AND j > 1),
    k{t} AS MATERIALIZED (
      SELECT model, i, j, sum(v) AS v FROM (
        SELECT model, i - 1 AS i, j - 1 AS j, sum((risk - f * dead) / q0) AS v
        FROM r{t} JOIN o{t} USING (model, t) WHERE i > 1 GROUP BY ALL
        UNION ALL
        SELECT p.model, p.i, q.i AS j, -sum(p.m * q.m) FROM u{t} p JOIN u{t} q
          ON p.model = q.model AND p.t = q.t AND p.f = q.f AND p.i <= q.i GROUP BY ALL)
      GROUP BY ALL),
    s{t} AS MATERIALIZED (
      SELECT model, i, j, v FROM k{t}
      UNION ALL SELECT model, j, i, v FROM k{t} WHERE i <> j
      UNION ALL SELECT model, i, 0, totals.v - g FROM totals JOIN
        (SELECT model, i, sum(m) AS g FROM u{t} GROUP BY ALL) USING (model, i)),"""
        newton = newton.replace(f"h{t} AS MATERIALIZED", own + f"\n    h{t} AS MATERIALIZED", 1)
    parts.append(newton)
    return (
        "WITH " + ",".join(parts) + f"""
    SELECT {key} term, round(exp(beta), 6) AS hazard_ratio,
      round(exp(beta - {Z} * se), 6) AS ci_lower, round(exp(beta + {Z} * se), 6) AS ci_upper,
      round(beta, 6) AS coef, round(se, 6) AS std_error, round(beta / se, 6) AS statistic,
      round({_p_value("beta / se")}, 6) AS p_value, n_obs, n_events, TRUE AS converged
    FROM fitted JOIN counted USING (model)"""
    )
