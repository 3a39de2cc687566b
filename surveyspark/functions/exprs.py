"""Column-expression helpers (all JVM-side, inside whole-stage codegen)."""

from __future__ import annotations

from functools import reduce
from typing import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def clip(col, lo: float, hi: float) -> Column:
    """CLN-7: clip to [lo, hi]."""
    return F.greatest(F.least(c(col), F.lit(float(hi))), F.lit(float(lo)))


def logit(p, eps: float | None = None) -> Column:
    """DRV-11: ln(p / (1 - p)), optionally after clipping to [eps, 1 - eps]."""
    q = clip(p, eps, 1.0 - eps) if eps is not None else c(p)
    return F.ln(q / (F.lit(1.0) - q))


def safe_ratio(num, den, fill=None) -> Column:
    """DRV-8 / CLN-8: num / nullif(den, 0), null filled by ``fill`` (column or value)."""
    r = F.try_divide(c(num).cast("double"), F.nullif(c(den).cast("double"), F.lit(0.0)))
    if fill is None:
        return r
    return F.coalesce(r, fill if isinstance(fill, Column) else F.lit(float(fill)))


def flag_below(col, cutoff) -> Column:
    """DRV-1: (col < cutoff) as int."""
    return (c(col) < F.lit(cutoff)).cast("int")


def flag_in(col, codes: Iterable) -> Column:
    """DRV-5: membership indicator; null stays 0 like pandas ``isin``."""
    return F.coalesce(c(col).isin(list(codes)), F.lit(False)).cast("int")


def any_of(cols: Sequence) -> Column:
    """DRV-2: 1 if any indicator equals 1."""
    return reduce(lambda a, b: a | b, [F.coalesce(c(x) == 1, F.lit(False)) for x in cols]).cast("int")


def all_of(conds: Sequence[Column]) -> Column:
    """DRV-7: compound AND indicator."""
    return F.coalesce(reduce(lambda a, b: a & b, conds), F.lit(False)).cast("int")


def square(col) -> Column:
    """DRV-4."""
    return c(col) * c(col)


def classify(p, cutoff: float = 0.5) -> Column:
    """DRV-12: class at a probability cut-off (>=)."""
    return (c(p) >= F.lit(float(cutoff))).cast("int")


def band(col, cuts: Sequence[float], labels: Sequence[str], right_closed: bool = False) -> Column:
    """DRV-15: label by ascending cut points.

    ``labels`` has len(cuts) + 1 entries. With ``right_closed=False`` the band
    is ``cuts[i-1] <= x < cuts[i]``; with True it is ``cuts[i-1] < x <= cuts[i]``.
    """
    assert len(labels) == len(cuts) + 1
    x = c(col)
    expr = None
    for cut, lab in zip(cuts, labels[:-1]):
        cond = (x <= F.lit(cut)) if right_closed else (x < F.lit(cut))
        expr = F.when(cond, F.lit(lab)) if expr is None else expr.when(cond, F.lit(lab))
    return expr.otherwise(F.lit(labels[-1])) if expr is not None else F.lit(labels[-1])


def p_stars(p) -> Column:
    """DRV-15: significance stars of a p-value."""
    x = c(p)
    return (F.when(x < 0.001, "***").when(x < 0.01, "**").when(x < 0.05, "*").otherwise("ns"))


def age_text(months) -> Column:
    """DRV-16: months -> 'a an(s) r mois' text."""
    m = c(months).cast("int")
    a = F.floor(m / 12).cast("int")
    r = (m % 12).cast("int")
    ans = F.concat(a.cast("string"), F.lit(" an"), F.when(a > 1, F.lit("s")).otherwise(F.lit("")))
    return (F.when(a == 0, F.concat(r.cast("string"), F.lit(" mois")))
            .when(r == 0, ans)
            .otherwise(F.concat(ans, F.lit(" "), r.cast("string"), F.lit(" mois"))))


def prefix_code(col, sep: str = "=") -> Column:
    """PRJ-9: leading integer code of a '5=Name' label; null if not a number."""
    return F.expr(f"try_cast(trim(split_part({_sql_ref(col)}, '{sep}', 1)) as int)")


def format_percent(col, digits: int = 1) -> Column:
    """PRJ-12: fraction -> 'xx.x%' text."""
    return F.concat(F.format_number(F.round(c(col) * 100.0, digits), digits), F.lit("%"))


def status_label(col, mapping: dict) -> Column:
    """PRJ-13: code -> status text."""
    expr = None
    for k, v in mapping.items():
        expr = F.when(c(col) == F.lit(k), F.lit(v)) if expr is None else expr.when(c(col) == F.lit(k), F.lit(v))
    return expr


def weighted_sum(terms: dict) -> Column:
    """DRV-9: sum of weight * column."""
    return reduce(lambda a, b: a + b, [F.lit(float(w)) * c(k).cast("double") for k, w in terms.items()])


def _sql_ref(col) -> str:
    if isinstance(col, str):
        return "`" + col.replace("`", "``") + "`"
    raise TypeError("prefix_code needs a column name")


def bounded_broadcast(df: DataFrame, max_rows: int) -> DataFrame:
    """Broadcast ``df`` only after checking it holds at most ``max_rows`` rows.

    The check reads at most ``max_rows + 1`` rows. Beyond the bound the frame is
    returned unhinted and the planner (with AQE) picks a shuffle join.
    """
    n = df.limit(max_rows + 1).count()
    return F.broadcast(df) if n <= max_rows else df


def materialize_small(df: DataFrame, max_rows: int) -> DataFrame:
    """Checkpoint a derived key table (reliable, in the cluster's checkpoint folder) and
    broadcast it if its checked row count is within ``max_rows``; otherwise leave the
    join strategy to the planner and AQE. One computation serves the check and the join."""
    from surveyspark.session import ensure_checkpoint_dir
    ensure_checkpoint_dir(df.sparkSession)
    m = df.checkpoint(eager=True)
    return F.broadcast(m) if m.count() <= max_rows else m
