"""Reference SQL of the registered queries, over whole tables, for an independent engine."""

from __future__ import annotations

import math

from liftgrid.catalog.queries import PLACEBO_DRAWS, REPLICATES
from liftgrid.functions.hashing import POISSON_ONE_CUTS
from liftgrid.functions.normal import detectable_shift
from liftgrid.operators.abtest import Z_95
from liftgrid.operators.quality import EXPECTED_RATES, RATE_TOLERANCE
from liftgrid.operators.tails import TAIL_PERCENTILES
from liftgrid.sources.testbed import EXPERIMENT_SQL, SPEC

E = f"e AS ({EXPERIMENT_SQL})"
SCORED = """scored AS (
  SELECT unit_id, treatment, visit, conversion, 'a' AS model, f0 AS tau FROM e
  UNION ALL SELECT unit_id, treatment, visit, conversion, 'b', f0 + f5 / 10 FROM e
  UNION ALL SELECT unit_id, treatment, visit, conversion, 'c', -f7 FROM e)"""


def with_(*ctes: str, select: str) -> str:
    return "WITH " + ",\n".join((E, *ctes)) + "\n" + select


def curve_ctes(source: str, groups: str = "model", outcome: str = "conversion") -> tuple[str, str]:
    """CTEs ``ranked`` and ``curve``: a plain global window over (groups)."""
    part = f"PARTITION BY {groups} " if groups else ""
    keys = f"{groups}, " if groups else ""
    over = f"OVER ({part}ORDER BY tau DESC, unit_id ROWS UNBOUNDED PRECEDING)"
    whole = f"OVER ({part.strip()})"
    ranked = f"""ranked AS (
      SELECT {keys}unit_id, tau, treatment AS t, {outcome} AS y,
        row_number() OVER ({part}ORDER BY tau DESC, unit_id) AS rank, count(*) {whole} AS n,
        sum(treatment) {over} AS ct, sum(1 - treatment) {over} AS cc,
        sum({outcome} * treatment) {over} AS cyt, sum({outcome} * (1 - treatment)) {over} AS cyc
      FROM {source})"""
    curve = """curve AS (
      SELECT *, CASE WHEN ct > 0 AND cc > 0
        THEN CAST(cyt AS DOUBLE) / CAST(ct AS DOUBLE) - CAST(cyc AS DOUBLE) / CAST(cc AS DOUBLE)
        ELSE 0 END AS u
      FROM ranked)"""
    return ranked, curve


def top_lift(k: float) -> str:
    """Lift among the first floor(n*k) ranks."""
    top = f"rank <= floor(n * CAST({k} AS DOUBLE))"
    return f"avg(CASE WHEN {top} AND t = 1 THEN y END) - avg(CASE WHEN {top} AND t = 0 THEN y END)"


ATE = "(avg(CASE WHEN t = 1 THEN y END) - avg(CASE WHEN t = 0 THEN y END))"
AUUC = "((sum(u) - (max(CASE WHEN rank = 1 THEN u END) + max(CASE WHEN rank = n THEN u END)) / 2) / max(n))"
QINI = f"({AUUC} - {ATE} * (max(n) - 1) / max(n))"


def erfc_sql(x: str) -> str:
    """Series below 2.5, continued fraction above, written out."""
    series = "1.0"
    for k in range(70, 0, -1):
        series = f"(1.0 + 2.0 * {x} * {x} / {2 * k + 1}.0 * {series})"
    fraction = x
    for k in range(70, 0, -1):
        fraction = f"({x} + {k / 2} / {fraction})"
    return (
        f"CASE WHEN {x} < 2.5 THEN 1.0 - {2 / math.sqrt(math.pi)!r} * exp(-{x} * {x}) * {x} * {series} "
        f"ELSE exp(-{x} * {x}) / ({math.sqrt(math.pi)!r} * {fraction}) END"
    )


COUNTS = """counts AS (
  SELECT 'visit' AS outcome, count(*) FILTER (treatment = 1) AS n1,
    CAST(coalesce(sum(visit) FILTER (treatment = 1), 0) AS BIGINT) AS x1, count(*) FILTER (treatment = 0) AS n0,
    CAST(coalesce(sum(visit) FILTER (treatment = 0), 0) AS BIGINT) AS x0 FROM e
  UNION ALL SELECT 'conversion', count(*) FILTER (treatment = 1),
    CAST(coalesce(sum(conversion) FILTER (treatment = 1), 0) AS BIGINT), count(*) FILTER (treatment = 0),
    CAST(coalesce(sum(conversion) FILTER (treatment = 0), 0) AS BIGINT) FROM e)"""
RATES = """rates AS (
  SELECT *, CAST(x1 AS DOUBLE) / n1 AS p1, CASE WHEN n0 > 0 THEN CAST(x0 AS DOUBLE) / n0 END AS p0,
    CAST(x1 + x0 AS DOUBLE) / (n1 + n0) AS pp FROM counts)"""
TEST = """test AS (
  SELECT *, p1 - p0 AS lift,
    CASE WHEN sqrt(pp * (1 - pp) * (1.0 / n1 + 1.0 / n0)) <> 0
      THEN (p1 - p0) / sqrt(pp * (1 - pp) * (CAST(1 AS DOUBLE) / n1 + CAST(1 AS DOUBLE) / n0)) END AS z,
    sqrt(p1 * (1 - p1) / n1 + p0 * (1 - p0) / n0) AS se FROM rates)"""
SHIFT = detectable_shift(0.05, 0.80)
MDE = f"""mde AS (
  SELECT *, {SHIFT!r} * sqrt(CAST(1 AS DOUBLE) / n0 + CAST(1 AS DOUBLE) / n1) AS h,
    pow(sin(asin(sqrt(p0)) + {SHIFT!r} * sqrt(CAST(1 AS DOUBLE) / n0 + CAST(1 AS DOUBLE) / n1) / 2), 2) AS p_mde
  FROM test)"""
MDE_COLUMNS = """round(p0, 6) AS baseline_control_rate, round(h, 6) AS cohens_h_detectable,
  round(p_mde - p0, 6) AS mde_absolute,
  CASE WHEN p0 > 0 THEN round((p_mde - p0) / p0 * 100, 3) END AS mde_relative_pct,
  CAST(0.05 AS DOUBLE) AS alpha, CAST(0.8 AS DOUBLE) AS power"""


def allocation(name: str, sizes: str, draws: str, strata: str = "treatment, conversion") -> str:
    """CTE dividing ``draws`` over strata by largest remainder."""
    return f"""{name} AS (
      SELECT {strata}, n, base + CASE WHEN row_number() OVER (
          ORDER BY rem DESC, {strata}) <= draws - sum(base) OVER () THEN 1 ELSE 0 END AS q
      FROM (SELECT *, draws * n // total AS base, draws * n % total AS rem FROM (
        SELECT {strata}, n, sum(n) OVER () AS total,
          CAST({draws} AS BIGINT) AS draws FROM {sizes})))"""


SIZES = "sizes AS (SELECT treatment, conversion, count(*) AS n FROM e GROUP BY ALL)"


def drawn(salt: str, strata: str = "treatment, conversion", source: str = "e") -> str:
    return f"""drawn AS (
      SELECT *, row_number() OVER (PARTITION BY {strata}
        ORDER BY md5(unit_id || ':{salt}:42'), unit_id) AS r FROM {source})"""


def split_ctes(strata: str = "treatment, conversion", source: str = "e") -> tuple[str, ...]:
    """CTE ``split``: the rows of ``source`` with their part, exact in each stratum."""
    return (
        f"sizes AS (SELECT {strata}, count(*) AS n FROM {source} GROUP BY ALL)",
        allocation("first", "sizes", "floor(CAST(0.7 AS DOUBLE) * sum(n) OVER ())", strata),
        f"rest AS (SELECT {strata}, n - q AS n FROM first)",
        allocation("second", "rest", f"floor(CAST({0.15 / 0.30!r} AS DOUBLE) * sum(n) OVER ())", strata),
        drawn("split", strata, source),
        f"""split AS (
          SELECT d.*, CASE WHEN r <= f.q THEN 'train' WHEN r <= f.q + s.q THEN 'val' ELSE 'test' END AS split
          FROM drawn d JOIN first f USING ({strata}) JOIN second s USING ({strata}))""",
    )


SPLIT = split_ctes()
SCALES = "stats AS (SELECT " + ", ".join(
    f"avg({c}) AS m_{c}, CASE WHEN stddev_pop({c}) = 0 THEN 1 ELSE stddev_pop({c}) END AS s_{c}"
    for c in SPEC.features) + " FROM split WHERE split = 'train')"

MASK = "CAST(4294967295 AS BIGINT)"


def mix_sql(x: str) -> str:
    """One statement per step, so the text stays short: returns nested subexpressions."""
    return f"(xor({x}, {x} >> 16) * 73244475) & {MASK}"


def weight_ctes(source: str, replicates: int = REPLICATES) -> tuple[str, ...]:
    """CTE ``weights(unit_id, replicate, w)``, one mixing step per CTE."""
    ctes = [
        f"""k0 AS (SELECT unit_id, replicate,
          CAST('0x' || substr(md5(unit_id), 1, 8) AS BIGINT) AS a, CAST('0x' || substr(md5(unit_id), 9, 8) AS BIGINT) AS b,
          (CAST(replicate AS BIGINT) * 2654435769 + 42) & {MASK} AS x
          FROM (SELECT DISTINCT unit_id FROM {source}), (SELECT unnest(range({replicates})) AS replicate))"""
    ]
    step = 0

    def mix() -> None:
        nonlocal step
        for _ in range(2):
            ctes.append(f"k{step + 1} AS (SELECT unit_id, replicate, a, b, {mix_sql('x')} AS x FROM k{step})")
            step += 1
        ctes.append(f"k{step + 1} AS (SELECT unit_id, replicate, a, b, xor(x, x >> 16) AS x FROM k{step})")
        step += 1

    mix()
    for other in ("a", "b"):
        ctes.append(f"k{step + 1} AS (SELECT unit_id, replicate, a, b, xor(x, {other}) AS x FROM k{step})")
        step += 1
        mix()
    count = " + ".join(f"CASE WHEN x >= {c} THEN 1 ELSE 0 END" for c in POISSON_ONE_CUTS)
    ctes.append(f"weights AS (SELECT unit_id, CAST(replicate AS INTEGER) AS replicate, {count} AS w FROM k{step})")
    return tuple(ctes)


def resample(source: str, groups: str = "") -> str:
    """CTE ``drawn_rows``: each unit as often as its weight says."""
    keys = f"s.{groups}, " if groups else ""
    return f"""drawn_rows AS (
      SELECT {keys}w.replicate, s.unit_id, s.tau, s.treatment, s.conversion
      FROM {source} s JOIN weights w USING (unit_id), unnest(range(w.w)) AS copies(i))"""


ONE_SCORE = "one AS (SELECT unit_id, treatment, visit, conversion, f0 + f5 / 10 AS tau FROM e)"
SHUFFLED = """shuffled AS (
  SELECT {keys}unit_id, treatment, conversion,
    CAST(CAST('0x' || substr(md5(unit_id || ':perm:42'), 1, 8) AS BIGINT) AS DOUBLE) AS tau FROM {source})"""

FEATURES = ", ".join(SPEC.features)


def profile_sql(column: str) -> str:
    return f"""SELECT '{column}' AS "column", count(*) FILTER ({column} IS NULL) AS null_count,
      round(avg({column}), 6) AS mean, CAST(min({column}) AS DOUBLE) AS min,
      CAST(max({column}) AS DOUBLE) AS max, count(*) AS row_count, avg({column}) AS raw FROM e"""


def balance_sql(column: str) -> str:
    m1, m0 = (f"avg({column}) FILTER (treatment = {a})" for a in (1, 0))
    v1, v0 = (f"var_samp({column}) FILTER (treatment = {a})" for a in (1, 0))
    return f"SELECT '{column}' AS feature, {m1} AS m1, {m0} AS m0, {v1} AS v1, {v0} AS v0 FROM e"


SMD = f"""smd AS (SELECT feature, m1, m0, v1, v0,
  CASE WHEN sqrt((v1 + v0) / 2) > 0 THEN (m1 - m0) / sqrt((v1 + v0) / 2) ELSE 0 END AS smd
  FROM ({' UNION ALL '.join(balance_sql(c) for c in SPEC.features)}))"""

PROFILE = " UNION ALL ".join(profile_sql(c) for c in SPEC.contract)
EXPECTED = " UNION ALL ".join(f"SELECT '{c}' AS \"column\", CAST({v} AS DOUBLE) AS expected" for c, v in EXPECTED_RATES.items())
CHECKS = f"""checks AS (
  SELECT x."column", x.expected, round(p.raw, 5) AS actual, abs(p.raw - x.expected) <= {RATE_TOLERANCE} AS within_tolerance
  FROM ({EXPECTED}) x JOIN ({PROFILE}) p USING ("column"))"""

DECILE = "CAST((10 * rank + n - 1) // n AS INTEGER)"
CELL_LIFT = "avg(CASE WHEN t = 1 THEN y END) - avg(CASE WHEN t = 0 THEN y END)"

WINSOR = """bounds AS (
  SELECT model, quantile_cont(tau, 0.01) AS low, quantile_cont(tau, 0.99) AS high FROM scored GROUP BY model),
both_scores AS (
  SELECT model || '|raw' AS model, unit_id, treatment, conversion, tau FROM scored
  UNION ALL SELECT s.model || '|win', unit_id, treatment, conversion, greatest(least(tau, high), low)
  FROM scored s JOIN bounds USING (model))"""

PAIRS = """ranks AS (
  SELECT model, unit_id, rank() OVER (PARTITION BY model ORDER BY tau DESC)
    + (count(*) OVER (PARTITION BY model, tau) - 1) / CAST(2 AS DOUBLE) AS r FROM scored),
rho AS (SELECT a.model AS model_a, b.model AS model_b, count(*) AS n, corr(a.r, b.r) AS rho
  FROM ranks a JOIN ranks b ON a.unit_id = b.unit_id AND a.model < b.model GROUP BY ALL),
tail AS (SELECT *, n - 2 AS df, abs(rho * sqrt((n - 2) / (1 - rho * rho))) AS t FROM rho),
steps AS (SELECT model_a, model_b, df, t, unnest(generate_series(0, df // 2 - 1)) AS j FROM tail),
logs AS (SELECT *, CASE WHEN j = 0 THEN 0 ELSE ln(df / (df + t * t)) + CASE WHEN df % 2 = 0
    THEN ln((2 * j - 1) / (2 * j)) ELSE ln(2 * j / (2 * j + 1)) END END AS step FROM steps),
terms AS (SELECT model_a, model_b, exp(sum(step) OVER (PARTITION BY model_a, model_b ORDER BY j)) AS term FROM logs),
series AS (SELECT model_a, model_b, sum(term) AS total FROM terms GROUP BY ALL),
student AS (SELECT tail.*, 1 - CASE WHEN df % 2 = 0 THEN t / sqrt(df + t * t) * total
    ELSE 2 / pi() * (atan(t / sqrt(df)) + t * sqrt(df) / (df + t * t) * coalesce(total, 0)) END AS p
  FROM tail LEFT JOIN series USING (model_a, model_b))"""


def _tail_points() -> str:
    names = ("tau_min", "tau_p5", "tau_p25", "tau_p50", "tau_p75", "tau_p95", "tau_max")
    return ", ".join(
        f"round(quantile_cont(tau, {p}), 6) AS {c}" for p, c in zip(TAIL_PERCENTILES, names)
    )


# Poisson counts at shares from digests: the last count whose smaller counts have less than the share.
RESAMPLED = """cells AS (SELECT model, decile, unnest([0, 1, 2, 3]) AS cell, unnest([x1, n1 - x1, x0, n0 - x0]) AS size FROM tail),
sizes AS (SELECT DISTINCT size FROM cells),
spread AS (SELECT size, unnest(generate_series(CAST(greatest(0, floor(size - 12 * sqrt(size) - 40)) AS BIGINT),
    CAST(ceil(size + 12 * sqrt(size) + 40) AS BIGINT))) AS k FROM sizes),
chance AS (SELECT size, k, CASE WHEN size > 0 THEN exp(k * ln(size) - size - lgamma(k + 1)) WHEN k = 0 THEN 1 ELSE 0 END AS p FROM spread),
below AS (SELECT size, k, coalesce(sum(p) OVER (PARTITION BY size ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS less FROM chance),
draws AS (SELECT *, (CAST(CAST('0x' || substr(md5(model || '|' || decile || ':' || draw || ':' || cell || ':42'), 1, 13) AS BIGINT) AS DOUBLE)
    + CAST(0.5 AS DOUBLE)) / 4503599627370496 AS share FROM cells, range(500) AS r(draw)),
counted AS (SELECT draws.*, below.k FROM draws ASOF JOIN below ON draws.size = below.size AND draws.share > below.less),
resampled AS (SELECT model, decile, draw, CAST(max(k) FILTER (cell = 0) AS DOUBLE) AS s1, max(k) FILTER (cell = 1) AS f1,
    CAST(max(k) FILTER (cell = 2) AS DOUBLE) AS s0, max(k) FILTER (cell = 3) AS f0 FROM counted GROUP BY ALL),
ends AS (SELECT model, decile, quantile_cont(s1 / (s1 + f1) - s0 / (s0 + f0), 0.025) AS low,
    quantile_cont(s1 / (s1 + f1) - s0 / (s0 + f0), 0.975) AS high FROM resampled WHERE s1 + f1 > 0 AND s0 + f0 > 0 GROUP BY ALL)"""
GROUP_MEANS = """means AS (SELECT f0 > 40 AS high, avg(visit) FILTER (treatment = 0) AS mu0, avg(visit) FILTER (treatment = 1) AS mu1
  FROM e GROUP BY 1)"""
REGIONS = """regions AS (SELECT unit_id, f1, f0 + f5 / 10 AS tau,
  CASE WHEN f5 > 10 THEN CAST(floor(f5 / 20) AS INTEGER) END AS region FROM e)"""


def hex_sql(salt: str, at: int) -> str:
    """Eight hex digits of a unit's draw as a number."""
    return f"CAST('0x' || substr(md5(unit_id || ':{salt}:42'), {at}, 8) AS BIGINT)"


def oracle() -> dict[str, str]:
    z_columns = f"""round(lift, 6) AS absolute_lift, round(z, 4) AS z_statistic,
      round(lift - {Z_95} * se, 6) AS ci_low, round(lift + {Z_95} * se, 6) AS ci_high"""
    metrics = f"""{ATE} AS ate, {AUUC} AS auuc, {QINI} AS qini, {AUUC} - {ATE} / 2 AS qini_triangle,
      {top_lift(0.1)} AS uplift_at_10pct, {top_lift(0.2)} AS uplift_at_20pct,
      avg(tau) AS tau_mean, stddev_pop(tau) AS tau_std"""
    names = ("ate", "auuc", "qini", "qini_triangle", "uplift_at_10pct", "uplift_at_20pct", "tau_mean", "tau_std")

    def rounded(columns: tuple[str, ...], places: int) -> str:
        return ", ".join(f"round({c}, {places}) AS {c}" for c in columns)

    boot_model = (*weight_ctes("e"), resample("scored", "model"))
    interval = f"""per AS (SELECT model, replicate, {AUUC} AS auuc, {QINI} AS qini FROM curve GROUP BY model, replicate),
      ci AS (SELECT model, quantile_cont(qini, 0.025) AS qini_low, quantile_cont(qini, 0.975) AS qini_high,
        quantile_cont(auuc, 0.025) AS auuc_low, quantile_cont(auuc, 0.975) AS auuc_high FROM per GROUP BY model)"""
    shuffled_curve = tuple(
        c.replace("ranked AS", "s_ranked AS").replace("curve AS", "s_curve AS").replace("FROM ranked", "FROM s_ranked")
        for c in curve_ctes("shuffled")
    )
    model_curve = tuple(
        c.replace("ranked AS", "m_ranked AS").replace("curve AS", "m_curve AS").replace("FROM ranked", "FROM m_ranked")
        for c in curve_ctes("scored")
    )
    x_learner = with_(
        GROUP_MEANS,
        """effects AS (SELECT high, avg(mu1 - visit) FILTER (treatment = 0) AS tau0, avg(visit - mu0) FILTER (treatment = 1) AS tau1
          FROM e JOIN means ON high = (f0 > 40) GROUP BY high)""",
        select="""SELECT unit_id, round(tau0, 9) AS tau0, round(tau1, 9) AS tau1, round(g * tau0 + (1 - g) * tau1, 9) AS tau
          FROM e JOIN effects ON high = (f0 > 40), (SELECT avg(treatment) AS g FROM e)""",
    )
    verdict = (
        "p AS (SELECT unit_id, (f5 - 25.5) / 1000 AS tau FROM e WHERE treatment = 0)", *weight_ctes("p", PLACEBO_DRAWS),
        "means AS (SELECT replicate, sum(w * tau) / sum(w) AS m FROM p JOIN weights USING (unit_id) GROUP BY replicate)",
        "ci AS (SELECT quantile_cont(m, 0.025) AS low, quantile_cont(m, 0.975) AS high FROM means)",
        "s AS (SELECT count(*) AS n, avg(tau) AS mean, stddev_pop(tau) AS std FROM p)",
        "r AS (SELECT abs(avg(conversion) FILTER (treatment = 1) - avg(conversion) FILTER (treatment = 0)) AS ate FROM e)",
    )
    verdict_columns = """n AS n_scored, round(mean, 6) AS tau_mean, round(std, 6) AS tau_std, round(low, 6) AS ci_low,
        round(high, 6) AS ci_high, low <= 0 AND high >= 0 AS statistical_check_pass, round(ate, 6) AS real_ate,
        round(abs(mean) / ate * 100, 3) AS practical_ratio_pct, CAST(10 AS DOUBLE) AS practical_threshold_pct,
        abs(mean) / ate < 0.1 AS practical_check_pass,
        CASE WHEN abs(mean) / ate < 0.1 THEN 'PASS' ELSE 'FAIL' END AS overall_verdict"""
    sql = {
        "ab_report": with_(
            COUNTS, RATES, TEST, MDE, "tail AS (SELECT *, abs(z) / sqrt(CAST(2 AS DOUBLE)) AS x FROM mde)",
            select=f"""SELECT outcome, n1, x1, n0, x0, round(p1, 6) AS p_treatment, round(p0, 6) AS p_control,
              CASE WHEN p0 > 0 THEN round(lift / p0 * 100, 3) END AS relative_lift_pct, {z_columns},
              round({erfc_sql('x')}, 12) AS p_value, {erfc_sql('x')} < 0.05 AS significant, {MDE_COLUMNS} FROM tail""",
        ),
        "arm_counts": with_(COUNTS, select="SELECT * FROM counts"),
        "arm_counts_by_size": with_(
            """counts AS (SELECT f5, outcome, count(*) FILTER (treatment = 1) AS n1,
              CAST(coalesce(sum(y) FILTER (treatment = 1), 0) AS BIGINT) AS x1, count(*) FILTER (treatment = 0) AS n0,
              CAST(coalesce(sum(y) FILTER (treatment = 0), 0) AS BIGINT) AS x0
              FROM (SELECT f5, treatment, 'visit' AS outcome, visit AS y FROM e
                UNION ALL SELECT f5, treatment, 'conversion', conversion FROM e) GROUP BY f5, outcome)""",
            RATES, TEST, select=f"SELECT f5, outcome, n1, x1, n0, x0, {z_columns} FROM test",
        ),
        "average_effect": with_(
            select="SELECT round(avg(conversion) FILTER (treatment = 1) - avg(conversion) FILTER (treatment = 0), 9) AS ate FROM e"
        ),
        "detectable_effect": with_(
            COUNTS, RATES, TEST, MDE, select=f"SELECT outcome, n1, x1, n0, x0, {MDE_COLUMNS} FROM mde"
        ),
        "balance_table": with_(
            SMD, select="""SELECT feature, round(round(m1, 6), 3) AS mean_treatment, round(round(m0, 6), 3) AS mean_control,
              round(round(v1, 6), 3) AS var_treatment, round(round(v0, 6), 3) AS var_control, round(smd, 6) AS smd,
              abs(smd) < 0.1 AS balanced, (v1 + v0 = 0 AND m1 <> m0) AS degenerate FROM smd""",
        ),
        "balance_summary": with_(
            SMD, select="""SELECT count(*) AS n_features, count(*) FILTER (abs(smd) >= 0.1) AS n_unbalanced,
              max(abs(round(smd, 6))) AS max_abs_smd FROM smd""",
        ),
        "contract_rows": with_(select=f"SELECT unit_id, {FEATURES}, treatment, visit, conversion FROM e"),
        "control_rows": with_(select="SELECT unit_id, visit, conversion, f0 FROM e WHERE treatment = 0"),
        "column_profile": with_(
            select=f'SELECT "column", null_count, mean, min, max, row_count FROM ({PROFILE})'
        ),
        "rate_checks": with_(CHECKS, select="SELECT * FROM checks"),
        "quality_verdict": with_(
            CHECKS, select=f"""SELECT row_count, true AS schema_matches, 0 AS n_missing, 0 AS n_unexpected, any_nulls,
              CAST((SELECT count(*) FILTER (NOT within_tolerance) FROM checks) AS INTEGER) AS n_rates_off,
              NOT any_nulls AND (SELECT bool_and(within_tolerance) FROM checks) AS all_passed
              FROM (SELECT max(row_count) AS row_count, max(null_count) > 0 AS any_nulls FROM ({PROFILE}))""",
        ),
        "sample_rows": with_(
            select="SELECT unit_id, treatment FROM e WHERE substr(md5(unit_id || ':sample:42'), 1, 8) < '19999999'"
        ),
        "sample_share": with_(
            """s AS (SELECT count(*) AS full_rows,
              count(*) FILTER (substr(md5(unit_id || ':sample:42'), 1, 8) < '19999999') AS sample_rows FROM e)""",
            select="SELECT full_rows, sample_rows, round(CAST(100 * sample_rows AS DOUBLE) / full_rows, 2) AS sample_pct FROM s",
        ),
        "split_rows": with_(*SPLIT, select="SELECT unit_id, split FROM split"),
        "split_rows_by_order_value": with_(
            "priced AS (SELECT unit_id, treatment, CAST(floor(f4) AS BIGINT) AS price FROM e)",
            *split_ctes("treatment, price", "priced"), select="SELECT unit_id, split FROM split",
        ),
        "split_round_trip": with_(
            *SPLIT, SCALES, select="SELECT unit_id, split, treatment, conversion, " + ", ".join(
                f"round(CAST(CAST(({c} - m_{c}) / s_{c} AS FLOAT) AS DOUBLE), 5) AS {c}" for c in SPEC.features)
            + " FROM split, stats WHERE split = 'test'"
        ),
        "split_summary": with_(
            *SPLIT, select="""SELECT split, count(*) AS n, round(avg(treatment), 6) AS treat_ratio,
              round(avg(visit), 6) AS visit_rate, round(avg(conversion), 6) AS conversion_rate,
              CAST(sum(conversion) AS BIGINT) AS conversion_count, sum(conversion) < 50 AS unstable
              FROM split GROUP BY split""",
        ),
        "scaled_features": with_(
            *SPLIT, SCALES, select="SELECT unit_id, split, " + ", ".join(
                f"round(({c} - m_{c}) / s_{c}, 6) AS {c}" for c in SPEC.features) + " FROM split, stats",
        ),
        "scaler_state": with_(
            *SPLIT, select=" UNION ALL ".join(
                f"""SELECT '{c}' AS feature, round(avg({c}), 6) AS mean,
                round(CASE WHEN stddev_pop({c}) = 0 THEN 1 ELSE stddev_pop({c}) END, 6) AS scale
                FROM split WHERE split = 'train'""" for c in SPEC.features),
        ),
        "subsample_rows": with_(
            SIZES, allocation("first", "sizes", "5001"), drawn("subsample"),
            select="""SELECT unit_id, treatment, conversion FROM drawn JOIN first USING (treatment, conversion)
              WHERE r <= q""",
        ),
        "holdout_rows": with_(
            SIZES,
            allocation("first", "sizes", "sum(n) OVER () - CAST(ceil(CAST(0.3 AS DOUBLE) * sum(n) OVER ()) AS BIGINT)"),
            drawn("holdout"),
            select="SELECT unit_id, r > q AS holdout FROM drawn JOIN first USING (treatment, conversion)",
        ),
        "pseudo_arms": with_(
            select="""SELECT unit_id, CASE WHEN substr(md5(unit_id || ':pseudo:42'), 1, 8) < '80000000'
              THEN 1 ELSE 0 END AS pseudo FROM e WHERE treatment = 0"""
        ),
        "fold_sizes": with_(
            select="""SELECT CAST(CAST('0x' || substr(md5(unit_id || ':fold:42'), 1, 8) AS BIGINT) % 3 AS INTEGER) AS fold,
              treatment, count(*) AS n FROM e GROUP BY ALL"""
        ),
        "uplift_curve": with_(
            ONE_SCORE, *curve_ctes("one", ""), select="SELECT unit_id, rank, n, round(u, 9) AS uplift FROM curve"
        ),
        "uplift_curve_tied": with_(
            "tied AS (SELECT unit_id, treatment, conversion, greatest(f0, 33.0) AS tau FROM e)",
            *curve_ctes("tied", ""), select="SELECT unit_id, rank, round(u, 9) AS uplift FROM curve",
        ),
        "ranking_metrics": with_(
            SCORED, *curve_ctes("scored"), f"m AS (SELECT model, count(*) AS n, {metrics} FROM curve GROUP BY model)",
            select=f"SELECT model, n, {rounded(names, 9)} FROM m",
        ),
        "ranking_metrics_visit": with_(
            SCORED, *curve_ctes("scored", outcome="visit"), f"m AS (SELECT model, {metrics} FROM curve GROUP BY model)",
            select=f"SELECT model, {rounded(('ate', 'auuc', 'qini', 'qini_triangle'), 9)} FROM m",
        ),
        "uplift_at_k": with_(
            SCORED, curve_ctes("scored")[0],
            select=" UNION ALL ".join(
                f"""SELECT model, CAST({k} AS DOUBLE) AS k, count(*) AS n_top, CAST(sum(t) AS BIGINT) AS n_treatment,
                CAST(sum(1 - t) AS BIGINT) AS n_control, round({CELL_LIFT}, 9) AS uplift
                FROM ranked WHERE rank <= floor(n * CAST({k} AS DOUBLE)) GROUP BY model""" for k in (0.05, 0.1, 0.2, 0.5)),
        ),
        "decile_table": with_(
            SCORED, curve_ctes("scored")[0],
            select=f"""SELECT model, {DECILE} AS decile, count(*) AS n, CAST(sum(t) AS BIGINT) AS n_treatment,
              CAST(sum(1 - t) AS BIGINT) AS n_control, round(avg(tau), 6) AS mean_predicted_tau,
              round({CELL_LIFT}, 6) AS observed_lift FROM ranked GROUP BY model, decile""",
        ),
        "score_summary": with_(
            SCORED, select="""SELECT model, count(*) AS n, round(avg(tau), 6) AS tau_mean,
              round(stddev_pop(tau), 6) AS tau_std FROM scored GROUP BY model""",
        ),
        "permutation_check": with_(
            SHUFFLED.format(keys="", source="e"), *curve_ctes("shuffled", ""),
            f"m AS (SELECT {QINI} AS q, {ATE} AS a FROM curve)",
            select="""SELECT round(q, 6) AS shuffled_tau_qini, round(a, 6) AS ate_for_reference,
              abs(q) < CASE WHEN a <> 0 THEN 0.1 * abs(a) ELSE 1e-4 END AS sanity_pass FROM m""",
        ),
        "bootstrap_weights": with_(
            *weight_ctes("e"), select="SELECT replicate, w, count(*) AS units FROM weights GROUP BY ALL"
        ),
        "bootstrap_metrics": with_(
            ONE_SCORE, *weight_ctes("e"), resample("one"), *curve_ctes("drawn_rows", "replicate"),
            f"m AS (SELECT replicate, count(*) AS n, {metrics} FROM curve GROUP BY replicate)",
            select=f"SELECT replicate, n, {rounded(names[:6], 9)} FROM m",
        ),
        "bootstrap_interval": with_(
            SCORED, *boot_model, *curve_ctes("drawn_rows", "model, replicate"), interval,
            select=f"SELECT model, {rounded(('qini_low', 'qini_high', 'auuc_low', 'auuc_high'), 8)} FROM ci",
        ),
        "bootstrap_interval_full": with_(
            ONE_SCORE, *weight_ctes("e"), resample("one"), *curve_ctes("drawn_rows", "replicate"),
            f"per AS (SELECT replicate, {AUUC} AS auuc, {QINI} AS qini FROM curve GROUP BY replicate)",
            select="""SELECT round(quantile_cont(qini, 0.025), 8) AS qini_low, round(quantile_cont(qini, 0.975), 8) AS qini_high,
              round(quantile_cont(auuc, 0.025), 8) AS auuc_low, round(quantile_cont(auuc, 0.975), 8) AS auuc_high FROM per""",
        ),
        "bootstrap_means": with_(
            SCORED, *weight_ctes("e"),
            select="""SELECT model, replicate, CAST(sum(w) AS BIGINT) AS n, round(sum(w * tau) / sum(w), 6) AS mean
              FROM scored JOIN weights USING (unit_id) GROUP BY ALL""",
        ),
        "evaluation_report": with_(
            SCORED, *model_curve, SHUFFLED.format(keys="model, ", source="scored"), *shuffled_curve, *boot_model,
            *curve_ctes("drawn_rows", "model, replicate"), interval,
            f"m AS (SELECT model, count(*) AS n_test, {metrics} FROM m_curve GROUP BY model)",
            f"s AS (SELECT model, {QINI} AS q, {ATE} AS a FROM s_curve GROUP BY model)",
            f"""d AS (SELECT model, round({CELL_LIFT}, 6) AS top_decile_lift FROM m_ranked
              WHERE {DECILE} = 1 GROUP BY model)""",
            select=f"""SELECT model, n_test, {rounded(('qini', 'auuc', 'uplift_at_10pct', 'uplift_at_20pct', 'tau_mean', 'tau_std'), 6)},
              {rounded(('qini_low', 'qini_high', 'auuc_low', 'auuc_high'), 6)}, round(q, 6) AS shuffled_tau_qini,
              abs(q) < 0.1 * abs(a) AS sanity_pass, top_decile_lift
              FROM m JOIN s USING (model) JOIN ci USING (model) JOIN d USING (model)""",
        ),
        "evaluation_deciles": with_(
            SCORED, curve_ctes("scored")[0],
            select=f"""SELECT model, {DECILE} AS decile, count(*) AS n, round(avg(tau), 6) AS mean_predicted_tau,
              round({CELL_LIFT}, 6) AS observed_lift FROM ranked GROUP BY model, decile""",
        ),
        "leaderboard": with_(
            SCORED, *curve_ctes("scored"), f"m AS (SELECT model, count(*) AS n, {metrics} FROM curve GROUP BY model)",
            select=f"""SELECT model, n, {rounded(('qini', 'auuc', 'uplift_at_10pct', 'uplift_at_20pct', 'ate'), 6)},
              round(uplift_at_10pct / ate, 3) AS lift_over_ate FROM m""",
        ),
        "split_metrics": with_(
            SCORED, *SPLIT,
            """held AS (SELECT scored.model, split.split, scored.unit_id, scored.tau, scored.treatment, scored.conversion
              FROM scored JOIN split ON scored.unit_id = split.unit_id WHERE split <> 'train')""",
            *curve_ctes("held", "model, split"),
            f"m AS (SELECT model, split, count(*) AS n, {metrics} FROM curve GROUP BY model, split)",
            select=f"SELECT model, split, n, {rounded(names[1:], 6)} FROM m",
        ),
        "rank_agreement": with_(
            SCORED, PAIRS, select="""SELECT model_a, model_b, n, round(rho, 4) AS spearman, abs(round(p, 6)) AS p_value,
              CASE WHEN rho > 0.6 THEN 'strong' WHEN rho > 0.3 THEN 'moderate' ELSE 'weak' END AS agreement FROM student""",
        ),
        "rank_agreement_of_many_models": with_(
            """scored AS (SELECT unit_id, 'm' || k AS model, f0 * (k % 5) + f1 / 1000 + f5 * (k % 7) AS tau
              FROM e, (SELECT unnest(range(10, 22)) AS k) WHERE substr(unit_id, 1, 1) <> CAST(k % 10 AS VARCHAR))""",
            PAIRS, select="SELECT model_a, model_b, n, round(rho, 4) AS spearman, abs(round(p, 6)) AS p_value FROM student",
        ),
        "average_ranks": with_(
            select="""SELECT 'a' AS model, unit_id, rank() OVER (ORDER BY f0 DESC)
              + (count(*) OVER (PARTITION BY f0) - 1) / CAST(2 AS DOUBLE) AS avg_rank FROM e"""
        ),
        "alignment_report": with_(
            SCORED, "p AS (SELECT * FROM scored WHERE model <> 'c' OR treatment = 1)",
            "c AS (SELECT model, count(DISTINCT unit_id) AS units, count(*) AS all_rows FROM p GROUP BY model)",
            select="""SELECT model, units, (SELECT count(DISTINCT unit_id) FROM p) - units AS missing,
              all_rows - units AS repeated,
              (SELECT count(DISTINCT unit_id) FROM p) = units AND all_rows = units AS aligned FROM c""",
        ),
        "percentiles": with_(
            SCORED, select=" UNION ALL ".join(
                f"""SELECT model, count(*) AS n, CAST({p} AS DOUBLE) AS prob, round(quantile_cont(tau, {p}), 6) AS value
                FROM scored GROUP BY model""" for p in (0.0, 0.01, 0.25, 0.5, 0.99, 1.0)),
        ),
        "winsorized_rows": with_(
            "b AS (SELECT quantile_cont(f1, 0.01) AS low, quantile_cont(f1, 0.99) AS high FROM e)",
            select="SELECT unit_id, round(greatest(least(f1, high), low), 6) AS winsorized FROM e, b",
        ),
        "winsorize_report": with_(
            SCORED, WINSOR, *curve_ctes("both_scores"),
            f"m AS (SELECT model, {metrics} FROM curve GROUP BY model)",
            "clipped AS (SELECT model, low, high, count(*) FILTER (tau < low) AS n_low, count(*) FILTER (tau > high) AS n_high FROM scored JOIN bounds USING (model) GROUP BY ALL)",
            "d AS (SELECT c.*, r.qini AS rq, r.auuc AS ra, w.qini AS wq, w.auuc AS wa, w.uplift_at_10pct AS wk, round(round(w.qini, 6) - round(r.qini, 6), 6) AS delta FROM clipped c JOIN m r ON r.model = c.model || '|raw' JOIN m w ON w.model = c.model || '|win')",
            select="""SELECT model, round(low, 6) AS clip_low, round(high, 6) AS clip_high, n_low AS n_clipped_low,
              n_high AS n_clipped_high, round(rq, 6) AS raw_qini, round(wq, 6) AS winsorized_qini, round(ra, 6) AS raw_auuc,
              round(wa, 6) AS winsorized_auuc, round(wk, 6) AS winsorized_at_10pct, delta AS qini_delta,
              CASE WHEN delta > 0 THEN 'helped' ELSE 'hurt or no change' END AS verdict FROM d""",
        ),
        "last_deciles": with_(
            SCORED, WINSOR, curve_ctes("both_scores")[0],
            f"""d AS (SELECT model, {DECILE} AS decile, round(avg(tau), 6) AS mean_tau, round({CELL_LIFT}, 6) AS lift
              FROM ranked GROUP BY model, decile)""",
            select="""SELECT b.model, r.decile, r.mean_tau AS raw_mean_tau, r.lift AS raw_lift,
              w.mean_tau AS winsorized_mean_tau, w.lift AS winsorized_lift
              FROM bounds b JOIN d r ON r.model = b.model || '|raw' JOIN d w ON w.model = b.model || '|win'
                AND w.decile = r.decile WHERE r.decile >= 9""",
        ),
        "tail_diagnosis": with_(
            SCORED, curve_ctes("scored")[0], f"d AS (SELECT *, {DECILE} AS decile FROM ranked)",
            select=f"""SELECT model, decile, count(*) AS n, CAST(sum(t) AS BIGINT) AS n_treatment,
              CAST(sum(1 - t) AS BIGINT) AS n_control, round(avg(tau), 6) AS mean_tau,
              CAST(sum(y * t) AS BIGINT) AS conversions_treatment, CAST(sum(y * (1 - t)) AS BIGINT) AS conversions_control,
              round(avg(CASE WHEN t = 1 THEN y END), 5) AS rate_treatment, round(avg(CASE WHEN t = 0 THEN y END), 5) AS rate_control,
              round({CELL_LIFT}, 6) AS observed_lift, {_tail_points()}
              FROM d WHERE decile IN (1, 9, 10) GROUP BY model, decile""",
        ),
        "tail_interval": with_(
            SCORED, curve_ctes("scored")[0], f"d AS (SELECT *, {DECILE} AS decile FROM ranked)",
            f"""tail AS (SELECT model, decile, count(*) FILTER (t = 1) AS n1, CAST(sum(y * t) AS BIGINT) AS x1,
              count(*) FILTER (t = 0) AS n0, CAST(sum(y * (1 - t)) AS BIGINT) AS x0, {CELL_LIFT} AS lift
              FROM d WHERE decile IN (1, 9, 10) GROUP BY model, decile)""",
            RESAMPLED,
            select="""SELECT model, decile, round(lift, 6) AS observed_lift, round(low, 6) AS lift_low, round(high, 6) AS lift_high,
              low <= 0 AND high >= 0 AS contains_zero FROM tail LEFT JOIN ends USING (model, decile)""",
        ),
        "imputed_effects": with_(
            select="""SELECT unit_id, round(CASE WHEN treatment = 1 THEN conversion - f2 / 4 ELSE f3 / 2 - conversion END, 9)
              AS effect FROM e"""
        ),
        "imputed_effect_summary": with_(
            "d AS (SELECT treatment, CASE WHEN treatment = 1 THEN conversion - f2 / 4 ELSE f3 / 2 - conversion END AS x FROM e)",
            select="""SELECT treatment AS arm, count(*) AS n, round(avg(x), 8) AS mean, round(stddev_pop(x), 8) AS std
              FROM d GROUP BY treatment""",
        ),
        "blended_effects": with_(
            "g AS (SELECT avg(treatment) AS g FROM e)",
            select="SELECT unit_id, round(g * f2 + (1 - g) * f3, 9) AS tau FROM e, g",
        ),
        "honest_leaf_moments": with_(
            """r AS (SELECT 0 AS tree, CAST(f5 AS INTEGER) AS leaf, conversion - 0.02::DOUBLE AS y, treatment - 0.85::DOUBLE AS t FROM e
              UNION ALL SELECT 1, CAST(floor(f0 / 5) AS INTEGER), conversion - 0.02::DOUBLE, treatment - 0.85::DOUBLE FROM e)""",
            select="""SELECT tree, leaf, count(*) AS n, round(avg(t), 8) AS t, round(avg(y), 8) AS y,
              round(avg(t * y), 8) AS ty, round(avg(t * t), 8) AS tt FROM r GROUP BY tree, leaf""",
        ),
        "t_learner_by_group": with_(
            GROUP_MEANS,
            select="SELECT unit_id, round(mu0, 9) AS mu0, round(mu1, 9) AS mu1, round(mu1 - mu0, 9) AS tau FROM e JOIN means ON high = (f0 > 40)",
        ),
        "x_learner_by_group": x_learner,
        "x_learner_reloaded": x_learner,
        "residuals_by_group": with_(
            f"folded AS (SELECT unit_id, f0 > 40 AS high, visit, treatment, {hex_sql('fold', 1)} % 3 AS fold FROM e)",
            "parts AS (SELECT high, fold, count(*) AS n, sum(visit) AS y, sum(treatment) AS t FROM folded GROUP BY ALL)",
            """others AS (SELECT high, fold, (sum(y) OVER w - y) / (sum(n) OVER w - n) AS ey, (sum(t) OVER w - t) / (sum(n) OVER w - n) AS et
              FROM parts WINDOW w AS (PARTITION BY high))""",
            select="SELECT unit_id, round(visit - ey, 9) AS ry, round(treatment - et, 9) AS rt FROM folded JOIN others USING (high, fold)",
        ),
        "honest_tree_effects": with_(
            f"""held AS (SELECT f0 > 40 AS high, treatment - 0.85 AS t, visit - 0.07 AS y FROM e
              WHERE ({hex_sql('honest', 9)} % 2147483647 * 1000003 + 42) % 2147483647 >= 1073741823)""",
            "leaves AS (SELECT high, (avg(t * y) - avg(t) * avg(y)) / (avg(t * t) - avg(t) * avg(t)) AS tau FROM held GROUP BY high)",
            select="SELECT unit_id, round(tau, 9) AS tau FROM e JOIN leaves ON high = (f0 > 40)",
        ),
        "placebo_scores_by_group": with_(
            """controls AS (SELECT unit_id, f0 > 40 AS high, visit, CASE WHEN substr(md5(unit_id || ':pseudo:42'), 1, 8) < '80000000'
              THEN 1 ELSE 0 END AS pseudo FROM e WHERE treatment = 0)""",
            "strata AS (SELECT pseudo AS treatment, visit AS conversion, count(*) AS n FROM controls GROUP BY ALL)",
            allocation("first", "strata", "sum(n) OVER () - CAST(ceil(CAST(0.3 AS DOUBLE) * sum(n) OVER ()) AS BIGINT)"),
            """ranked_controls AS (SELECT *, row_number() OVER (PARTITION BY pseudo, visit
              ORDER BY md5(unit_id || ':holdout:42'), unit_id) AS r FROM controls)""",
            """marked AS (SELECT c.*, r > q AS holdout FROM ranked_controls c
              JOIN first f ON f.treatment = c.pseudo AND f.conversion = c.visit)""",
            "fitted AS (SELECT high, avg(visit) FILTER (pseudo = 1) - avg(visit) FILTER (pseudo = 0) AS tau FROM marked WHERE NOT holdout GROUP BY high)",
            select="SELECT unit_id, round(tau, 9) AS tau FROM marked JOIN fitted USING (high) WHERE holdout",
        ),
        "feature_vectors": with_(select="SELECT unit_id, " + ", ".join(f"{c} AS v{i}" for i, c in enumerate(SPEC.features)) + " FROM e"),
        "winsorized_rows_by_null_group": with_(
            REGIONS,
            "b AS (SELECT region, quantile_cont(f1, 0.01) AS low, quantile_cont(f1, 0.99) AS high FROM regions GROUP BY region)",
            select="SELECT unit_id, r.region, round(greatest(least(f1, high), low), 6) AS winsorized FROM regions r JOIN b ON r.region IS NOT DISTINCT FROM b.region",
        ),
        "percentiles_by_null_group": with_(
            REGIONS,
            "placed AS (SELECT region, tau, row_number() OVER (PARTITION BY region ORDER BY tau DESC, unit_id) AS rank, count(*) OVER (PARTITION BY region) AS n FROM regions)",
            f"tenths AS (SELECT region, tau, {DECILE} AS decile FROM placed)",
            select="""SELECT region, decile, count(*) AS n, round(min(tau), 6) AS tau_min, round(quantile_cont(tau, 0.5), 6) AS tau_p50,
              round(max(tau), 6) AS tau_max FROM tenths WHERE decile IN (1, 9, 10) GROUP BY region, decile""",
        ),
        "placebo_verdict": with_(*verdict, select=f"SELECT {verdict_columns} FROM s, ci, r"),
        "placebo_report": with_(
            *verdict, "pool AS (SELECT count(*) AS n_control_pool, round(avg(conversion), 9) AS base_rate FROM e WHERE treatment = 0)",
            select=f"""SELECT n_control_pool, '50/50 symmetric' AS pseudo_assignment, base_rate, {verdict_columns}
              FROM s, ci, r, pool""",
        ),
        "control_pool": with_(
            select="""SELECT count(*) AS n_control_pool, round(avg(conversion), 9) AS base_rate FROM e WHERE treatment = 0"""
        ),
        "csv_round_trip": with_(select="SELECT f0, f1, f7, treatment, visit, conversion FROM e"),
        "arm_table_round_trip": with_(select="SELECT unit_id, treatment, visit, conversion, f4 FROM e"),
        "prediction_round_trip": with_(SCORED, select="SELECT unit_id, model, tau FROM scored WHERE model <> 'b'"),
        "counts_round_trip": with_(
            COUNTS, RATES, TEST, select=f"""SELECT outcome, n1, x1, n0, x0, round(z, 4) AS z_statistic,
              round(lift - {Z_95} * se, 6) AS ci_low, round(lift + {Z_95} * se, 6) AS ci_high FROM test""",
        ),
        "combined_report": with_(
            COUNTS, SMD, select="""SELECT outcome AS item, CAST(x1 + x0 AS DOUBLE) AS value FROM counts
              UNION ALL SELECT feature, round(smd, 6) FROM smd""",
        ),
    }
    return sql
