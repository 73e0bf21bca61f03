"""SQL building blocks of the twins, in DuckDB's dialect."""

from __future__ import annotations

BARS = """
bars AS (
  SELECT event_type AS symbol, date_trunc('hour', ts) AS ts,
         arg_min(value, struct_pack(a := ts, b := event_id)) AS open, max(value) AS high, min(value) AS low,
         arg_max(value, struct_pack(a := ts, b := event_id)) AS close, sum(value) AS volume
  FROM events GROUP BY 1, 2)"""

RETS = """
rets AS (
  SELECT *, ln(close / lag(close) OVER w) AS ret, close - lag(close) OVER w AS step,
         row_number() OVER w - 1 AS pos
  FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY ts))"""


def with_(*parts: str, recursive: bool = False) -> str:
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",".join(parts) + "\n"


def full(expr: str, agg: str, n: int, by: str = "symbol") -> str:
    """Rolling aggregate over exactly n non-NULL rows."""
    over = f"OVER (PARTITION BY {by} ORDER BY ts ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({expr}) {over} = {n} THEN {agg}({expr}) {over} END"


def unpivot(view: str, keep: str, cols: dict[str, dict[int, str]]) -> str:
    """Stack wide columns: one SELECT per horizon."""
    hs = sorted(next(iter(cols.values())))
    return " UNION ALL ".join(
        f"SELECT {keep}, {h} AS horizon, " + ", ".join(f"{c[h]} AS {n}" for n, c in cols.items()) + f" FROM {view}"
        for h in hs
    )


def t_two_sided(t: str, nu: str) -> str:
    """P(|T| > |t|) of Student's t with a whole number of degrees of freedom, as a finite sum over the angle atan(t / sqrt(nu))."""
    a = f"atan(abs({t}) / sqrt({nu}))"
    even = f"sin({a}) * coalesce(list_sum(list_transform(range(0, ({nu}) // 2), lambda k: exp(lgamma(k + 0.5) - lgamma(0.5) - lgamma(k + 1.0)) * pow(cos({a}), 2 * k))), 0)"
    odd = f"2 / pi() * ({a} + sin({a}) * cos({a}) * coalesce(list_sum(list_transform(range(0, (({nu}) - 1) // 2), lambda k: exp(lgamma(k + 1.0) + lgamma(1.5) - lgamma(k + 1.5)) * pow(cos({a}), 2 * k))), 0))"
    return f"CASE WHEN {t} IS NOT NULL AND ({nu}) > 0 THEN 1 - CASE WHEN ({nu}) % 2 = 0 THEN {even} ELSE {odd} END END"


def t_quantile(p: str, nu: str) -> str:
    """The t with P(T <= t) = p for p above one half, by halving an interval of two-sided tails."""
    tail = t_two_sided("((b[1] + b[2]) / 2)", nu)
    step = f"lambda b, i: CASE WHEN ({tail}) > 2 * (1 - {p}) THEN [(b[1] + b[2]) / 2, b[2]] ELSE [b[1], (b[1] + b[2]) / 2] END"
    return f"CASE WHEN ({nu}) > 0 THEN list_reduce(range(90), {step}, [0.0::DOUBLE, 1000.0::DOUBLE])[1] END"


def chi2_upper(x: str, dof: str) -> str:
    """P(X > x) of chi-square: one minus the series of the lower incomplete gamma function."""
    a, h = f"(({dof}) / 2.0)", f"(({x}) / 2.0)"
    terms = f"list_sum(list_transform(range(0, 400), lambda k: exp(k * ln({h}) + lgamma({a} + 1) - lgamma({a} + k + 1.0))))"
    return f"1 - exp({a} * ln({h}) - {h} - lgamma({a} + 1)) * {terms}"
