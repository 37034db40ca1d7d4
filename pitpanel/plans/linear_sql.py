"""Linear systems, ridge and logistic fits as SQL text, for the oracles of queries that solve them in Python."""

from __future__ import annotations

from .registry import cte


def solve_ctes(p: str, src: str, keys: str, n: int, carry: str = "") -> str:
    """Gauss-Jordan steps over `a`, the n x (n + 1) system as one list; the last column of the result is the solution."""
    for k in range(n):
        row, pivot = f"a[{k * (n + 1) + 1}+(i%{n + 1})]", f"a[{k * (n + 1) + k + 1}]"
        cte(f"{p}_{k}", f"SELECT {keys}{carry}, list_transform(range({n * (n + 1)}), lambda i: CASE WHEN i//{n + 1}={k} THEN a[i+1]/{pivot} ELSE a[i+1]-a[(i//{n + 1})*{n + 1}+{k + 1}]*{row}/{pivot} END) AS a FROM {src}", src)
        src = f"{p}_{k}"
    return src


def logit_ctes(p: str, src: str, keys: str, features, c: float = 0.3, min_rows: int = 36, steps: int = 12) -> str:
    """`<p>_fit`: n_train, base, means, deviations and the Newton solution w (null for one class) of the learn rows of each key."""
    k, n = len(features), len(features) + 1
    stats = ", ".join(f"avg({f}) AS m_{f}, CASE WHEN stddev_pop({f})<=1e-12 THEN 1e0 ELSE stddev_pop({f}) END AS s_{f}" for f in features)
    cte(f"{p}_ms", f"SELECT {keys}, count(*) AS n_train, avg(CASE WHEN y>0 THEN 1e0 ELSE 0e0 END) AS base, {stats} FROM {src} WHERE learn GROUP BY {keys} HAVING count(*)>={min_rows}", src, held=True)
    z = ", ".join(f"({f}-m_{f})/s_{f}" for f in features)
    cte(f"{p}_z", f"SELECT {keys}, [1e0, {z}] AS z, CASE WHEN y>0 THEN 1e0 ELSE 0e0 END AS l FROM {src} JOIN {p}_ms USING ({keys}) WHERE learn AND base>0 AND base<1", src, f"{p}_ms", held=True)
    cte(f"{p}_w0", f"SELECT DISTINCT {keys}, [{', '.join(['0e0'] * n)}] AS w FROM {p}_z", f"{p}_z", held=True)
    dot = "+".join(f"z[{i + 1}]*w[{i + 1}]" for i in range(n))
    pen = [0.0] + [1.0 / c] * k
    for it in range(steps):
        cells = []
        for r in range(n):
            for q in range(n):
                lo, hi = min(r, q) + 1, max(r, q) + 1
                cells.append(f"sum(pr*(1e0-pr)*z[{lo}]*z[{hi}])" + (f"+{pen[r]!r}e0" if r == q and r else ""))
            cells.append(f"sum((pr-l)*z[{r + 1}])" + (f"+{pen[r]!r}e0*any_value(w)[{r + 1}]" if r else ""))
        cte(f"{p}_h{it}", f"SELECT {keys}, any_value(w) AS w, [{', '.join(cells)}] AS a FROM (SELECT {keys}, w, z, l, 1e0/(1e0+exp(-({dot}))) AS pr FROM {p}_z JOIN {p}_w{it} USING ({keys})) GROUP BY {keys}", f"{p}_z", f"{p}_w{it}", held=True)
        last = solve_ctes(f"{p}_s{it}", f"{p}_h{it}", keys, n, ", w")
        cte(f"{p}_w{it + 1}", f"SELECT {keys}, [{', '.join(f'w[{i + 1}]-a[{i * (n + 1) + n + 1}]' for i in range(n))}] AS w FROM {last}", last, held=True)
    return cte(f"{p}_fit", f"SELECT * FROM {p}_ms LEFT JOIN {p}_w{steps} USING ({keys})", f"{p}_ms", f"{p}_w{steps}", held=True)


def logit_terms(features) -> list[str]:
    return [f"w[{i + 2}]*({f}-m_{f})/s_{f}" for i, f in enumerate(features)]


def logit_p(features) -> str:
    return f"CASE WHEN w IS NULL THEN base ELSE 1e0/(1e0+exp(-(w[1]+{'+'.join(logit_terms(features))}))) END"


def ridge_ctes(p: str, src: str, keys: str, features, y: str, alpha: float, min_rows: int) -> str:
    """`<p>_fit`: n_train, mean outcome, means, deviations and the standardised ridge solution w of the learn rows of each key."""
    n = len(features)
    stats = ", ".join(f"avg({f}) AS m_{f}, CASE WHEN stddev_pop({f})<=1e-12 THEN 1e0 ELSE stddev_pop({f}) END AS s_{f}" for f in features)
    cte(f"{p}_ms", f"SELECT {keys}, count(*) AS n_train, avg({y}) AS m_y, {stats} FROM {src} WHERE learn GROUP BY {keys} HAVING count(*)>={min_rows}", src, held=True)
    z = ", ".join(f"({f}-m_{f})/s_{f}" for f in features)
    cells = []
    for r in range(n):
        cells += [f"sum(z[{min(r, q) + 1}]*z[{max(r, q) + 1}])" + (f"+{alpha!r}e0" if r == q else "") for q in range(n)] + [f"sum(z[{r + 1}]*v)"]
    cte(f"{p}_h", f"SELECT {keys}, [{', '.join(cells)}] AS a FROM (SELECT {keys}, [{z}] AS z, {y}-m_y AS v FROM {src} JOIN {p}_ms USING ({keys}) WHERE learn) GROUP BY {keys}", src, f"{p}_ms", held=True)
    last = solve_ctes(f"{p}_s", f"{p}_h", keys, n)
    cte(f"{p}_w", f"SELECT {keys}, [{', '.join(f'a[{i * (n + 1) + n + 1}]' for i in range(n))}] AS w FROM {last}", last, held=True)
    return cte(f"{p}_fit", f"SELECT * FROM {p}_ms JOIN {p}_w USING ({keys})", f"{p}_ms", f"{p}_w", held=True)


def ridge_pred(features) -> str:
    return "m_y+" + "+".join(f"w[{i + 1}]*({f}-m_{f})/s_{f}" for i, f in enumerate(features))
