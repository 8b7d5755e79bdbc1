"""SQL texts shared by the stated results."""

from __future__ import annotations

from collections.abc import Sequence

ITEMS = "select *, case when l_returnflag = 'R' then 1 else 0 end as y from lineitem"
RETURNED = (
    "select l.*, o.*, case when l_returnflag = 'R' then 1 else 0 end as y "
    "from lineitem l join orders o on l_orderkey = o_orderkey"
)
PART_ITEMS = (
    "select l.*, p.*, case when l_returnflag = 'R' then 1 else 0 end as y "
    "from lineitem l join part p on l_partkey = p_partkey"
)


def chi2_tail(score: str, dof: str) -> str:
    """Upper tail of the chi-square distribution for two columns."""
    x, a = f"({score} / 2.0e0)", f"({dof} / 2.0e0)"
    n = f"cast(300 + 20 * sqrt({a}) as integer)"
    steps = f"list_reverse(range(1, {n} + 1))::double[]"
    pre = f"exp(-{x} + {a} * ln({x}) - lgamma({a}))"
    series = (
        f"list_reduce(list_prepend(0.0e0::double, {steps}),"
        f" lambda s, n: (1.0e0 + s) * {x} / ({a} + n))"
    )
    fraction = (
        f"list_reduce(list_prepend(({x} + 1.0e0 - {a} + 2.0e0 * {n})::double, {steps}),"
        f" lambda f, n: {x} + 2.0e0 * n - 1.0e0 - {a} - n * (n - {a}) / f)"
    )
    return (
        f"case when {score} is null then null when {dof} <= 0 or {score} <= 0 then 1.0e0"
        f" when {x} < {a} + 1.0e0 then 1.0e0 - {pre} * (1.0e0 + {series}) / {a}"
        f" else {pre} / {fraction} end"
    )


def sums(base: str, features: Sequence[str]) -> str:
    """CTEs ``base`` and ``sums (feature, class, o, n_class, total, n, expected)``."""
    lines = " union all ".join(
        f"select '{c}' as feature, y as class, coalesce(sum({c}::double), 0) as o, count(*) as n_class from base group by y"
        for c in features
    )
    return (
        f"base as ({base}), long as ({lines}), totals as (select *, sum(o) over (partition by feature) as total,"
        " sum(n_class) over (partition by feature) as n from long),"
        " sums as (select *, n_class::double / n * total as expected from totals)"
    )


def cells(base: str, features: Sequence[str], keep_missing: bool = False) -> str:
    """CTEs ``base`` and ``cells (feature, value, class, o)``."""
    lines = " union all ".join(
        f"select '{c}' as feature, cast({c} as varchar) as value, y as class, count(*) as o from base"
        + ("" if keep_missing else f" where {c} is not null") + " group by all"
        for c in features
    )
    return f"base as ({base}), cells as ({lines})"


def table(base: str, features: Sequence[str], keep_missing: bool = False) -> str:
    """CTEs up to ``tab``, the full contingency table with expected counts."""
    return cells(base, features, keep_missing) + """,
    r as (select feature, value, sum(o) as row_total from cells group by all),
    k as (select feature, class, sum(o) as col_total from cells group by all),
    s as (select feature, sum(col_total) as n, count(*) as n_classes from k group by all),
    tab as (
      select r.feature, r.value, k.class, coalesce(c.o, 0) as o, row_total, col_total, n, n_classes,
             row_total::double * col_total / n as expected
      from r join k on r.feature = k.feature join s on r.feature = s.feature
      left join cells c on c.feature = r.feature and c.value is not distinct from r.value and c.class = k.class
    )"""


TESTS = """,
    tested as (
      select feature, any_value(n) as n, any_value(n_classes) as n_cols,
             count(*) / any_value(n_classes) as n_rows,
             sum(power(o - expected, 2) / expected) as plain,
             sum(power(abs(o - expected) - least(0.5, abs(o - expected)), 2) / expected) as drawn
      from tab group by feature
    ),
    sized as (select *, (n_rows - 1) * (n_cols - 1) as dof from tested),
    tests as (
      select feature, n, n_rows, n_cols, dof,
             case when dof = 0 then 0 when dof = 1 then drawn else plain end as chi2,
             case when dof = 0 then 0 else plain end as chi2_plain
      from sized
    )"""


def corrected_v(chi2: str) -> str:
    """Bias-corrected V over the columns of ``tests``."""
    r = "(n_rows - power(n_rows - 1, 2) / (n - 1) - 1)"
    k = "(n_cols - power(n_cols - 1, 2) / (n - 1) - 1)"
    phi2 = f"greatest(0, {chi2} / n - (n_cols - 1) * (n_rows - 1) / (n - 1))"
    return f"case when least({r}, {k}) > 0 then sqrt({phi2} / least({r}, {k})) end"


RESIDUAL = "(o - expected) / nullif(sqrt(expected * (1 - row_total::double / n) * (1 - col_total::double / n)), 0)"

FULL_TERM = (
    "power(o - expected, 2) / (expected + 1e-12)"
    " + power((n_class - o) - (n_class - expected), 2) / (n_class - expected + 1e-12)"
)
