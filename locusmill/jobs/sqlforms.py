"""SQL texts for the check of the iterative fits: linear systems, logistic steps and the normal tail."""

from __future__ import annotations


def solve(name: str, source: str, k: int, extra: int, keys: tuple[str, ...] = ()) -> str:
    """CTEs that reduce the columns m{i}_{j} of ``source`` (k rows, k + extra columns) to [I | solution].

    The last CTE is called ``name``; its columns m{i}_{k + e} hold the solution.
    """
    out, width = [], k + extra
    for c in range(k):
        cell = lambda i, j: f"m{c}_{j} / m{c}_{c}" if i == c else f"m{i}_{j} - m{i}_{c} * m{c}_{j} / m{c}_{c}"
        columns = [*keys, *[f"{cell(i, j)} AS m{i}_{j}" for i in range(k) for j in range(c + 1, width)]]
        to = name if c == k - 1 else f"{name}_{c}"
        out.append(f"{to} AS MATERIALIZED (SELECT {', '.join(columns)} FROM {source})")
        source = to
    return ",\n".join(out)


def logistic(data: str, k: int, steps: int = 9) -> str:
    """CTEs of Newton steps from zero for ``data`` (x0..x{k-1}, y).

    ``beta`` holds b0.. at the end and i{r}_{c}, the inverse information of the last step.
    """
    out = ["b0_ AS (SELECT " + ", ".join(f"0.0::DOUBLE AS b{i}" for i in range(k)) + ")"]
    eta = " + ".join(f"b{i} * x{i}" for i in range(k))
    for s in range(steps):
        sums = [f"sum(w * x{i} * x{j}) AS m{i}_{j}" for i in range(k) for j in range(k)]
        sums += [f"sum(w * x{i} * z) AS m{i}_{k}" for i in range(k)]
        sums += [f"{float(i == j)}::DOUBLE AS m{i}_{k + 1 + j}" for i in range(k) for j in range(k)]
        rows = f"(SELECT *, mu * (1 - mu) AS w, eta + (y - mu) / (mu * (1 - mu)) AS z FROM (SELECT *, 1 / (1 + exp(-eta)) AS mu FROM (SELECT d.*, {eta} AS eta FROM {data} d, b{s}_)))"
        out.append(f"g{s} AS MATERIALIZED (SELECT {', '.join(sums)} FROM {rows})")
        out.append(solve(f"h{s}", f"g{s}", k, 1 + k))
        last = s == steps - 1
        kept = [f"m{i}_{k} AS b{i}" for i in range(k)] + [f"m{i}_{k + 1 + j} AS i{i}_{j}" for i in range(k) for j in range(k) if last]
        out.append(f"{'beta' if last else f'b{s + 1}_'} AS MATERIALIZED (SELECT {', '.join(kept)} FROM h{s})")
    return ",\n".join(out)


def two_sided(t: str, points: int = 4000) -> str:
    """Two-sided normal tail of a column: the mean of exp(-t^2 / (2 sin^2 a)) over angles in (0, pi/2)."""
    return f"list_avg([exp(-{t} * {t} / (2 * sin((k + 0.5) * pi() / {2 * points}) ** 2)) for k in range({points})])"


def pql_families(rows: str, tau: float, steps: int) -> str:
    """CTEs of a binary mixed model over ``rows`` (sample_id, f, x, y) at kinship component tau, the kinship being 1/2 I + 1/2 J in a family f.

    The covariance of a family is diagonal plus rank one, so its inverse is a closed form. The
    last CTE is ``pql`` (sample_id, f, x, y, eta), after ``steps`` renewals of the working response.
    """
    h = tau / 2
    work = "SELECT *, 1 / (1 / w + {h}) AS d FROM (SELECT *, eta + (y - mu) / w AS v FROM (SELECT *, mu * (1 - mu) AS w FROM (SELECT *, 1 / (1 + exp(-eta)) AS mu FROM {t})))"
    out = [f"pql0 AS MATERIALIZED (SELECT *, 0.0::DOUBLE AS eta FROM {rows})"]
    for i in range(steps):
        out.append(f"w{i} AS MATERIALIZED ({work.format(h=h, t=f'pql{i}')})")
        out.append(f"f{i} AS MATERIALIZED (SELECT f, {h} / (1 + {h} * sum(d)) AS g, sum(d) AS sd, sum(d * x) AS sx, sum(d * v) AS sv, sum(d * x * x) AS sxx, sum(d * x * v) AS sxv FROM w{i} GROUP BY f)")
        out.append(f"s{i} AS MATERIALIZED (SELECT sum(sd - g * sd * sd) AS a11, sum(sx - g * sd * sx) AS a1x, sum(sxx - g * sx * sx) AS axx, sum(sv - g * sd * sv) AS b1, sum(sxv - g * sx * sv) AS bx FROM f{i})")
        out.append(f"c{i} AS MATERIALIZED (SELECT *, (b1 * axx - bx * a1x) / (a11 * axx - a1x * a1x) AS k0, (bx * a11 - b1 * a1x) / (a11 * axx - a1x * a1x) AS k1 FROM s{i})")
        out.append(f"pql{i + 1} AS MATERIALIZED (SELECT sample_id, w{i}.f AS f, x, y, v - d * ((v - k0 - k1 * x) - g * (sv - k0 * sd - k1 * sx)) / w AS eta FROM w{i} JOIN f{i} USING (f), c{i})")
    out.append(f"pql AS MATERIALIZED ({work.format(h=h, t=f'pql{steps}')})")
    out.append(f"pqlf AS MATERIALIZED (SELECT f, {h} / (1 + {h} * sum(d)) AS g, sum(d) AS sd, sum(d * x) AS sx, sum(d * x * x) AS sxx FROM pql GROUP BY f)")
    return ",\n".join(out)
