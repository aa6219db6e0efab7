"""DuckDB SQL fragments for the oracle side of the drift queries.

Each function returns CTE text that reads a long table and defines the named
result CTE; the Spark side computes the same quantities with DataFrame
operators. Kept here so the per-query SQL stays short.
"""

from __future__ import annotations


def num_counts(long_cte: str, out: str) -> str:
    """long_cte(side, feature, v) -> out(feature, v, n_ref, n_cur)."""
    return f"""{out} AS (
  SELECT feature, v, count(*) FILTER (WHERE side = 0) AS n_ref, count(*) FILTER (WHERE side = 1) AS n_cur
  FROM {long_cte} WHERE v IS NOT NULL AND NOT isnan(v) GROUP BY feature, v)"""


def ladder(counts: str, out: str) -> str:
    return f"""{out} AS (
  SELECT *, sum(n_ref) OVER w AS cum_ref, sum(n_cur) OVER w AS cum_cur,
         sum(n_ref) OVER (PARTITION BY feature) AS R, sum(n_cur) OVER (PARTITION BY feature) AS C
  FROM {counts} WINDOW w AS (PARTITION BY feature ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""


def ks_pvalue(d: str, r: str, c: str) -> str:
    en = f"(({r})::DOUBLE * ({c})::DOUBLE / (({r}) + ({c}))::DOUBLE)"
    series = (f"list_sum(list_transform(range(1, 101), lambda k: (CASE WHEN k % 2 = 1 THEN 1.0 ELSE -1.0 END)"
              f" * exp(-2.0 * k::DOUBLE * k::DOUBLE * ({en} * ({d}) * ({d})))))")
    return (f"(CASE WHEN ({d}) IS NULL THEN NULL WHEN sqrt({en}) * ({d}) < 0.1 THEN 1.0 "
            f"ELSE least(greatest(2.0 * {series}, 0.0), 1.0) END)")


def ks(ladder_cte: str, out: str) -> str:
    return f"""{out}_d AS (
  SELECT feature, max(abs(cum_ref / R - cum_cur / C)) AS statistic, any_value(R) AS R, any_value(C) AS C
  FROM {ladder_cte} GROUP BY feature),
{out} AS (SELECT feature, statistic, {ks_pvalue('statistic', 'R', 'C')} AS p_value FROM {out}_d)"""


def psi(long_cte: str, ladder_cte: str, out: str, num_bins: int = 10, min_current: int = 50) -> str:
    """PSI on reference quantile edges, numpy linear interpolation."""
    return f"""{out}_st AS (
  SELECT feature, any_value(R) AS R, any_value(C) AS C, min(v) AS vmin, max(v) AS vmax,
         least({num_bins}, greatest(4, any_value(C) // 5)) AS nb
  FROM {ladder_cte} GROUP BY feature),
{out}_rk AS (
  SELECT feature, v, row_number() OVER (PARTITION BY feature ORDER BY v) - 1 AS rnk
  FROM {long_cte} WHERE side = 0 AND v IS NOT NULL AND NOT isnan(v)),
{out}_pr AS (
  SELECT s.feature, s.R, i, (i::DOUBLE / s.nb::DOUBLE) * (s.R - 1)::DOUBLE AS h
  FROM {out}_st s, range(0, {num_bins} + 1) t(i)
  WHERE i <= s.nb AND s.R > 0 AND s.C >= {min_current} AND s.vmin < s.vmax),
{out}_q AS (
  SELECT p.feature, p.i, p.h, a.v AS va, b.v AS vb
  FROM {out}_pr p
  JOIN {out}_rk a ON a.feature = p.feature AND a.rnk = floor(p.h)
  JOIN {out}_rk b ON b.feature = p.feature AND b.rnk = least(floor(p.h) + 1, p.R - 1)),
{out}_e AS (
  SELECT feature, list_sort(list_distinct(list(
    CASE WHEN h - floor(h) >= 0.5 THEN vb - (vb - va) * (1.0 - (h - floor(h)))
         ELSE va + (vb - va) * (h - floor(h)) END))) AS es
  FROM {out}_q GROUP BY feature),
{out}_in AS (
  SELECT feature, len(es) AS n_edges,
         CASE WHEN len(es) > 2 THEN es[2:len(es) - 1] ELSE []::DOUBLE[] END AS interior
  FROM {out}_e),
{out}_b AS (
  SELECT l.feature, len(list_filter(i.interior, lambda e: e <= l.v)) AS bin,
         sum(l.n_ref) AS nr, sum(l.n_cur) AS nc, any_value(l.R) AS R, any_value(l.C) AS C
  FROM {ladder_cte} l JOIN {out}_in i ON i.feature = l.feature AND i.n_edges >= 2
  GROUP BY l.feature, bin),
{out}_v AS (
  SELECT feature, sum((greatest(nr / R, 1e-6) - greatest(nc / C, 1e-6))
                      * ln(greatest(nr / R, 1e-6) / greatest(nc / C, 1e-6))) AS psi
  FROM {out}_b GROUP BY feature),
{out} AS (
  SELECT s.feature,
         CASE WHEN s.R = 0 OR s.C = 0 THEN NULL WHEN s.vmin = s.vmax THEN 0.0
              WHEN s.C < {min_current} THEN NULL WHEN i.n_edges < 2 THEN 0.0 ELSE v.psi END AS statistic,
         CASE WHEN s.R > 0 AND s.C > 0 AND s.vmin < s.vmax AND s.C < {min_current}
              THEN 'window too small for PSI (n<{min_current})' END AS info
  FROM {out}_st s LEFT JOIN {out}_in i ON i.feature = s.feature LEFT JOIN {out}_v v ON v.feature = s.feature)"""


def chi_closed_form_p(x: str, dof: str) -> str:
    """Chi-square upper tail for even dof 2, 4, 6, 8 (closed form); NULL otherwise."""
    h = f"(({x}) / 2.0)"
    return (f"(CASE WHEN ({dof}) = 2 THEN exp(-{h}) "
            f"WHEN ({dof}) = 4 THEN exp(-{h}) * (1 + {h}) "
            f"WHEN ({dof}) = 6 THEN exp(-{h}) * (1 + {h} + {h} * {h} / 2.0) "
            f"WHEN ({dof}) = 8 THEN exp(-{h}) * (1 + {h} + {h} * {h} / 2.0 + {h} * {h} * {h} / 6.0) END)")


def categorical(cat_counts: str, out: str, min_current: int = 50) -> str:
    """cat_counts(feature, category, n_ref, n_cur) -> chi-square and categorical PSI."""
    return f"""{out}_t AS (
  SELECT feature, sum(n_ref) AS R, sum(n_cur) AS C, count(*) AS k FROM {cat_counts} GROUP BY feature),
{out}_j AS (
  SELECT c.*, t.R, t.C, t.k, (c.n_ref + c.n_cur)::DOUBLE AS s, (t.R + t.C)::DOUBLE AS tot
  FROM {cat_counts} c JOIN {out}_t t USING (feature)),
{out}_a AS (
  SELECT feature, any_value(R) AS R, any_value(C) AS C, any_value(k) AS k,
         sum(power(n_ref - R * s / tot, 2) / (R * s / tot) + power(n_cur - C * s / tot, 2) / (C * s / tot)) AS chi,
         min(least(R * s / tot, C * s / tot)) AS min_e,
         sum((greatest(n_ref / R, 1e-6) - greatest(n_cur / C, 1e-6)) * ln(greatest(n_ref / R, 1e-6) / greatest(n_cur / C, 1e-6))) AS psi
  FROM {out}_j GROUP BY feature),
{out} AS (
  SELECT feature,
         CASE WHEN R = 0 OR C = 0 OR min_e < 1 THEN NULL WHEN k < 2 THEN 0.0 ELSE chi END AS chi_stat,
         CASE WHEN R = 0 OR C = 0 OR min_e < 1 THEN NULL WHEN k < 2 THEN 1.0 ELSE {chi_closed_form_p('chi', 'k - 1')} END AS chi_p,
         CASE WHEN NOT (R = 0 OR C = 0) AND min_e < 1 THEN printf('min_expected=%.2f < 1 — sample too small for chi-square', min_e) END AS chi_info,
         CASE WHEN C < {min_current} THEN NULL ELSE psi END AS cpsi,
         CASE WHEN C < {min_current} THEN 'window too small for categorical_psi (n<{min_current})' END AS cpsi_info
  FROM {out}_a)"""
