"""Small SQL text helpers for the oracle strings (DuckDB dialect)."""

from __future__ import annotations

from typing import Sequence


def long_sql(table: str, cols: Sequence[str], var: str = "variable", val: str = "value") -> str:
    """UNION ALL stack of numeric columns, nulls dropped."""
    parts = [f"SELECT '{c}' AS {var}, CAST({c} AS DOUBLE) AS {val} FROM {table} WHERE {c} IS NOT NULL"
             for c in cols]
    return "(" + " UNION ALL ".join(parts) + ")"


def moments_cte(long: str) -> str:
    """CTEs lg (long), mm (n, mean), cm (population g1, g2, sample sd) - DuckDB."""
    return f"""lg AS (SELECT * FROM {long}),
mm AS (SELECT variable, COUNT(*) AS n, AVG(value) AS mean, MIN(value) AS mn, MAX(value) AS mx FROM lg GROUP BY variable),
cm AS (SELECT lg.variable, mm.n, mm.mean, mm.mn, mm.mx,
         SUM((value - mean) * (value - mean)) AS m2s,
         SUM((value - mean) * (value - mean) * (value - mean)) AS m3s,
         SUM((value - mean) * (value - mean) * (value - mean) * (value - mean)) AS m4s
       FROM lg JOIN mm USING (variable) GROUP BY lg.variable, mm.n, mm.mean, mm.mn, mm.mx),
gg AS (SELECT variable, n, mean, mn, mx, sqrt(m2s / (n - 1.0)) AS sd, m2s / (n - 1.0) AS var_s,
         (m3s / n) / pow(m2s / n, 1.5) AS g1, (m4s / n) / ((m2s / n) * (m2s / n)) - 3.0 AS g2 FROM cm)"""


def dagostino_sql(n: str = "n", g1: str = "g1", g2: str = "g2") -> str:
    """D'Agostino-Pearson p-value expression in DuckDB SQL (same formula as the operator)."""
    return f"exp(-({dagostino_k2_sql(n, g1, g2)}) / 2.0)"


def dagostino_k2_sql(n: str = "n", g1: str = "g1", g2: str = "g2") -> str:
    """D'Agostino-Pearson K2 expression in DuckDB SQL."""
    N = f"CAST({n} AS DOUBLE)"
    y = f"({g1} * sqrt(({N} + 1.0) * ({N} + 3.0) / (6.0 * ({N} - 2.0))))"
    beta2 = (f"(3.0 * ({N} * {N} + 27.0 * {N} - 70.0) * ({N} + 1.0) * ({N} + 3.0) / "
             f"(({N} - 2.0) * ({N} + 5.0) * ({N} + 7.0) * ({N} + 9.0)))")
    w2 = f"(-1.0 + sqrt(2.0 * ({beta2} - 1.0)))"
    z1 = f"(asinh({y} / sqrt(2.0 / ({w2} - 1.0))) / sqrt(0.5 * ln({w2})))"
    e = f"(3.0 * ({N} - 1.0) / ({N} + 1.0))"
    varb2 = f"(24.0 * {N} * ({N} - 2.0) * ({N} - 3.0) / (({N} + 1.0) * ({N} + 1.0) * ({N} + 3.0) * ({N} + 5.0)))"
    x = f"((({g2}) + 3.0 - {e}) / sqrt({varb2}))"
    sb1 = (f"(6.0 * ({N} * {N} - 5.0 * {N} + 2.0) / (({N} + 7.0) * ({N} + 9.0)) * "
           f"sqrt(6.0 * ({N} + 3.0) * ({N} + 5.0) / ({N} * ({N} - 2.0) * ({N} - 3.0))))")
    a = f"(6.0 + 8.0 / {sb1} * (2.0 / {sb1} + sqrt(1.0 + 4.0 / ({sb1} * {sb1}))))"
    d = f"(1.0 + {x} * sqrt(2.0 / ({a} - 4.0)))"
    term2 = f"(sign({d}) * cbrt((1.0 - 2.0 / {a}) / abs({d})))"
    z2 = f"((1.0 - 2.0 / (9.0 * {a}) - {term2}) / sqrt(2.0 / (9.0 * {a})))"
    return f"(({z1}) * ({z1}) + ({z2}) * ({z2}))"


def bias_sql(n: str = "n", g1: str = "g1", g2: str = "g2"):
    N = f"CAST({n} AS DOUBLE)"
    G1 = f"({g1} * sqrt({N} * ({N} - 1.0)) / ({N} - 2.0))"
    G2 = f"((({N} + 1.0) * {g2} + 6.0) * ({N} - 1.0) / (({N} - 2.0) * ({N} - 3.0)))"
    return G1, G2


def values_sql(rows, names, alias: str = "t") -> str:
    def lit(v):
        if isinstance(v, str):
            return "'" + v.replace("'", "''") + "'"
        return repr(v)
    body = ", ".join("(" + ", ".join(lit(v) for v in r) + ")" for r in rows)
    return f"(VALUES {body}) AS {alias}({', '.join(names)})"
