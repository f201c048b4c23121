"""DuckDB statements that the registered queries are checked against.

They are written independently of the library: exposures are joined with all
later events of the user, where the library takes windows and minima.
"""

from __future__ import annotations

# Chebyshev coefficients of erfc on [0, inf), c0 first.
_C = (
    -1.3026537197817094,
    0.6419697923564902,
    0.019476473204185836,
    -0.00956151478680863,
    -0.000946595344482036,
    0.000366839497852761,
    4.2523324806907e-05,
    -2.0278578112534e-05,
    -1.624290004647e-06,
    1.30365583558e-06,
    1.5626441722e-08,
    -8.5238095915e-08,
    6.529054439e-09,
    5.059343495e-09,
    -9.91364156e-10,
    -2.27365122e-10,
    9.6467911e-11,
    2.394038e-12,
    -6.886027e-12,
    8.94487e-13,
    3.13092e-13,
    -1.12708e-13,
    3.81e-16,
    7.106e-15,
    -1.523e-15,
    -9.4e-17,
    1.21e-16,
    -2.8e-17,
)


class L:
    """The texts of the reports."""

    SIGNIFICANT = "Significant (p < 0.05)"
    NOT_SIGNIFICANT = "Not Significant (p >= 0.05)"
    BAYES_STRONG_B = "Strong evidence for Variant B (P > 95%)"
    BAYES_MODERATE_B = "Moderate evidence for Variant B (P > 90%)"
    BAYES_STRONG_A = "Strong evidence for Control A (P(B) < 10%)"
    BAYES_INCONCLUSIVE = "Inconclusive (P ~ 50%)"
    BAYES_WEAK = "Weak evidence, continue test"
    EFFECT_NEGLIGIBLE = "Negligible (|h| < 0.2)"
    EFFECT_SMALL = "Small (0.2 <= |h| < 0.5)"
    EFFECT_MEDIUM = "Medium (0.5 <= |h| < 0.8)"
    EFFECT_LARGE = "Large (|h| >= 0.8)"
    SRM_NAME = "SRM Test Result"
    SRM_DETECTED = "❌ SRM DETECTED (p < 0.01) - DO NOT TRUST TEST RESULTS"
    SRM_POSSIBLE = "⚠️ Possible SRM (p < 0.05) - Investigate"
    SRM_NONE = "✅ No SRM detected (p >= 0.05)"
    SRM_NO_DATA = "Insufficient data"
    GUARDRAIL_PASS = "✅ PASS"
    BOUNCE_FAIL = "❌ FAIL: Bounce rate +5pp"
    DURATION_FAIL = "❌ FAIL: Duration -20%"
    CART_FAIL = "❌ FAIL: Abandonment +10pp"
    LOWER_IS_BETTER = "✅ Variant better (lower is better)"
    HIGHER_IS_BETTER = "✅ Variant better (higher is better)"
    VARIANT_WORSE = "❌ Variant worse"
    DECISION_LAUNCH = "Launch Variant B"
    DECISION_KEEP = "Keep Control A"
    DECISION_FOLLOW_UP = "Run Follow-up Test"
    DECISION_INVALID = "Invalid Test (SRM/Guardrail failure)"


SITE = "https://shop.example.com"


def rnd(x: str, digits: int) -> str:
    """Half away from zero, on the double."""
    q = f"(floor(abs(CAST({x} AS DOUBLE)) * 1e{digits} + 0.5e0) / 1e{digits})"
    return f"(CASE WHEN ({x}) < 0 AND {q} > 0 THEN -{q} ELSE {q} END)"


def erfc_nonnegative(x: str) -> str:
    """The Chebyshev series of erfc for x >= 0, summed by its cosine form."""
    t = f"(2e0 / (2e0 + ({x})))"
    terms = " + ".join(f"({c!r})::DOUBLE * cos({j} * acos(2e0 * {t} - 1e0))" for j, c in enumerate(_C) if j)
    return f"({t} * exp(-({x}) * ({x}) + ({_C[0]!r})::DOUBLE / 2e0 + {terms}))"


def phi(x: str) -> str:
    up = erfc_nonnegative(f"abs({x}) / sqrt(2e0)")
    return f"(CASE WHEN ({x}) < 0 THEN 0.5e0 * {up} ELSE 1e0 - 0.5e0 * {up} END)"


GA4 = f"""
raw AS (
  SELECT ts, user_id, event_type, strftime(ts, '%Y%m%d') AS event_date,
         CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS k
  FROM events
  WHERE ts >= TIMESTAMP '2024-01-01' AND ts < TIMESTAMP '2024-02-01'
),
ga4 AS (
  SELECT event_date, epoch_us(ts) AS event_timestamp,
    CASE event_type
      WHEN 'view' THEN 'page_view' WHEN 'purchase' THEN 'purchase' WHEN 'signup' THEN 'add_to_cart'
      WHEN 'click' THEN CASE k % 3 WHEN 0 THEN 'click' WHEN 1 THEN 'scroll' ELSE 'view_item' END
      WHEN 'error' THEN CASE k % 2 WHEN 0 THEN 'session_start' ELSE 'first_visit' END
    END AS event_name,
    user_id::VARCHAR || '.' || event_date AS user_pseudo_id,
    CASE WHEN k % 25 <> 13 THEN hour(ts) // 6 END::BIGINT AS session_id,
    CASE
      WHEN k < 80 THEN '{SITE}/landing-v' || (CASE WHEN user_id % 2 = 0 THEN '1' ELSE '2' END)
      WHEN k < 85 THEN '{SITE}/landing-v' || (CASE WHEN user_id % 2 = 0 THEN '2' ELSE '1' END)
      WHEN k < 90 THEN '{SITE}/home?variant=' || (CASE WHEN k % 2 = 0 THEN 'A' ELSE 'B' END)
      WHEN k < 95 THEN '{SITE}/product/' || k::VARCHAR
    END AS page_location,
    CASE WHEN k % 2 = 0 THEN CASE user_id % 5 WHEN 0 THEN 'google' WHEN 1 THEN 'bing'
      WHEN 2 THEN 'facebook' WHEN 3 THEN 'partner' END END AS source,
    CASE WHEN k % 2 = 0 THEN CASE user_id % 7 WHEN 0 THEN 'cpc' WHEN 1 THEN 'organic'
      WHEN 2 THEN 'paid_social' WHEN 3 THEN 'email' WHEN 4 THEN 'referral'
      WHEN 5 THEN 'affiliate' END END AS medium,
    k % 10 = 7 AS has_experiment_param
  FROM raw
)"""

# (experiment, variant, is the control, planned share, URL test on p)
LANDING = [
    ("landing_page", "Control_A", True, "0.5e0", "p LIKE '%/landing-v1%'"),
    ("landing_page", "Variant_B", False, "0.5e0", "p LIKE '%/landing-v2%'"),
]
REGISTRY = [
    *LANDING,
    ("home_param", "Home_A", True, "0.5e0", "p LIKE '%/home?variant=A%'"),
    ("home_param", "Home_B", False, "0.5e0", "p LIKE '%/home?variant=B%'"),
    ("three_way", "Control_A", True, "0.5e0", "p LIKE '%/landing-v1%'"),
    ("three_way", "Variant_B", False, "0.25e0", "p LIKE '%/landing-v2%'"),
    ("three_way", "Variant_C", False, "0.25e0", "p LIKE '%/home%'"),
]


def views(arms) -> str:
    """Every exposing page view; the arms' patterns do not overlap within an
    experiment, so each arm is one branch."""
    branches = [
        f"SELECT '{e}' AS experiment_id, '{v}' AS variant, {c} AS is_control, user_pseudo_id, "
        f"session_id, event_timestamp FROM (SELECT *, page_location AS p FROM ga4 "
        f"WHERE event_name = 'page_view') WHERE {test}"
        for e, v, c, _, test in arms
    ]
    return "arm_views AS (" + "\nUNION ALL ".join(branches) + ")"


def exposed(keys: str) -> str:
    return (
        f"ex AS (SELECT experiment_id, variant, is_control, {keys}, MIN(event_timestamp) AS session_start "
        f"FROM arm_views GROUP BY experiment_id, variant, is_control, {keys})"
    )


USER = "user_pseudo_id"
USER_SESSION = "user_pseudo_id, session_id"
FORWARD = "ev.user_pseudo_id = e.user_pseudo_id AND ev.event_timestamp >= e.session_start"
WITHIN = FORWARD + " AND ev.session_id IS NOT DISTINCT FROM e.session_id"


def units(on: str = FORWARD, keep: str = "TRUE") -> str:
    """0/1 conversions by the literal join with all later events."""
    return f"""
conv AS (
  SELECT e.experiment_id, e.variant, e.is_control, e.user_pseudo_id, MIN(e.session_start) AS session_start,
         MAX(CASE WHEN ev.event_name = 'purchase' THEN 1 ELSE 0 END) AS converted
  FROM ex e LEFT JOIN ga4 ev ON {on}
  GROUP BY 1, 2, 3, 4
),
marked AS (
  SELECT *, COUNT(*) OVER (PARTITION BY experiment_id, user_pseudo_id) AS arms_seen,
         ROW_NUMBER() OVER (PARTITION BY experiment_id, user_pseudo_id
                            ORDER BY session_start, is_control DESC, variant) AS arm_order
  FROM conv
),
u AS (SELECT * FROM marked WHERE {keep})"""


def stats(segment: str = "") -> str:
    seg = f", {segment}" if segment else ""
    return f"""
vs AS (
  SELECT experiment_id, variant, is_control{seg}, COUNT(*) AS visitors,
         CAST(SUM(converted) AS BIGINT) AS conversions, AVG(converted) AS cr,
         STDDEV_SAMP(converted) AS stddev,
         CAST(SUM(converted) + 1 AS BIGINT) AS alpha,
         CAST(COUNT(*) - SUM(converted) + 1 AS BIGINT) AS beta
  FROM u GROUP BY experiment_id, variant, is_control{seg}
)"""


def pairs(table: str, name: str = "ab", segment: str = "") -> str:
    seg = f" AND a.{segment} IS NOT DISTINCT FROM b.{segment}" if segment else ""
    return (
        f"{name} AS (SELECT a AS a, b AS b, a.experiment_id AS experiment_id"
        + (f", a.{segment} AS {segment}" if segment else "")
        + f" FROM {table} a CROSS JOIN {table} b WHERE a.is_control AND NOT b.is_control "
        f"AND a.experiment_id = b.experiment_id{seg})"
    )


Z = """
z0 AS (
  SELECT *, a.cr AS pa, b.cr AS pb, a.visitors::DOUBLE AS na, b.visitors::DOUBLE AS nb,
         (a.conversions + b.conversions) / (a.visitors + b.visitors)::DOUBLE AS pp
  FROM ab
),
z1 AS (
  SELECT *, sqrt(pa * (1 - pa) / na + pb * (1 - pb) / nb) AS se,
         (pb - pa) / NULLIF(sqrt(pp * (1 - pp) * (1e0 / na + 1e0 / nb)), 0) AS z
  FROM z0
)"""


def z_select(lead: str = "") -> str:
    return f"""
SELECT {lead} a.variant AS control_name, b.variant AS variant_name,
  a.visitors AS control_visitors, b.visitors AS variant_visitors,
  a.conversions AS control_conversions, b.conversions AS variant_conversions,
  {rnd('pa * 100', 2)} AS control_cr_pct, {rnd('pb * 100', 2)} AS variant_cr_pct,
  {rnd('(pb - pa) * 100', 2)} AS difference_pct_points,
  {rnd('(pb - pa) / NULLIF(pa, 0) * 100', 2)} AS relative_improvement_pct,
  {rnd('z', 2)} AS z_score,
  {rnd('2 * (1 - ' + phi('abs(z)') + ')', 4)} AS p_value_two_tailed,
  {rnd('(pb - pa) - 1.96e0 * se', 4)} AS ci_lower, {rnd('(pb - pa) + 1.96e0 * se', 4)} AS ci_upper,
  CASE WHEN abs(z) > 1.96e0 THEN '{L.SIGNIFICANT}' ELSE '{L.NOT_SIGNIFICANT}' END AS significance
FROM z1"""


BAYES = f"""
b0 AS (
  SELECT *,
    (b.alpha / (b.alpha + b.beta)::DOUBLE - a.alpha / (a.alpha + a.beta)::DOUBLE) / sqrt(
      (b.alpha * b.beta)::DOUBLE / pow(b.alpha + b.beta, 2) / (b.alpha + b.beta + 1)
      + (a.alpha * a.beta)::DOUBLE / pow(a.alpha + a.beta, 2) / (a.alpha + a.beta + 1)) AS x
  FROM ab
),
b1 AS (SELECT *, {phi('x')} AS raw_p FROM b0),
b2 AS (SELECT *, {rnd('raw_p', 4)} AS p FROM b1)"""


def bayes_select(lead: str = "") -> str:
    return f"""
SELECT {lead} a.variant AS control, b.variant AS variant,
  a.visitors AS control_visitors, b.visitors AS variant_visitors,
  a.conversions AS control_conversions, b.conversions AS variant_conversions,
  {rnd('a.cr * 100', 2)} AS control_cr_pct, {rnd('b.cr * 100', 2)} AS variant_cr_pct,
  {rnd('(b.cr - a.cr) * 100', 2)} AS difference_pct_points,
  p AS probability_b_better, {rnd('p * 100', 1)} AS probability_b_better_pct,
  CASE WHEN p > 0.95e0 THEN '{L.BAYES_STRONG_B}' WHEN p > 0.90e0 THEN '{L.BAYES_MODERATE_B}'
       WHEN p < 0.10e0 THEN '{L.BAYES_STRONG_A}'
       WHEN p BETWEEN 0.40e0 AND 0.60e0 THEN '{L.BAYES_INCONCLUSIVE}'
       ELSE '{L.BAYES_WEAK}' END AS bayesian_decision
FROM b2"""


EFFECT = "e0 AS (SELECT *, 2 * asin(sqrt(b.cr)) - 2 * asin(sqrt(a.cr)) AS h FROM ab)"


def effect_select(lead: str = "") -> str:
    return f"""
SELECT {lead} a.variant AS control, b.variant AS variant,
  a.visitors AS control_visitors, b.visitors AS variant_visitors,
  {rnd('a.cr * 100', 2)} AS control_cr_pct, {rnd('b.cr * 100', 2)} AS variant_cr_pct,
  {rnd('(b.cr - a.cr) * 100', 3)} AS risk_difference_pp,
  {rnd('(b.cr - a.cr) / NULLIF(a.cr, 0) * 100', 2)} AS relative_lift_pct,
  {rnd('h', 4)} AS cohens_h,
  CASE WHEN abs(h) < 0.2e0 THEN '{L.EFFECT_NEGLIGIBLE}' WHEN abs(h) < 0.5e0 THEN '{L.EFFECT_SMALL}'
       WHEN abs(h) < 0.8e0 THEN '{L.EFFECT_MEDIUM}' ELSE '{L.EFFECT_LARGE}' END AS effect_size_label
FROM e0"""


def srm(arms) -> str:
    planned = ", ".join(f"('{e}', '{v}', {share})" for e, v, _, share, _ in arms)
    return f"""
{views(arms)},
planned(experiment_id, variant, share) AS (VALUES {planned}),
counts AS (
  SELECT p.experiment_id, p.variant, p.share, COUNT(DISTINCT v.user_pseudo_id) AS users
  FROM planned p LEFT JOIN arm_views v ON v.experiment_id = p.experiment_id AND v.variant = p.variant
  GROUP BY 1, 2, 3
),
totals AS (SELECT experiment_id, CAST(SUM(users) AS DOUBLE) AS total FROM counts GROUP BY 1),
parts AS (
  SELECT c.*, t.total, t.total * c.share AS expected,
         pow(c.users - t.total * c.share, 2) / NULLIF(t.total * c.share, 0) AS part
  FROM counts c JOIN totals t ON t.experiment_id = c.experiment_id
)"""


def srm_test_select(lead: str = "") -> str:
    return f"""
, chi AS (
  SELECT experiment_id, SUM(part ORDER BY part) AS x, CAST(COUNT(*) - 1 AS INTEGER) AS df
  FROM parts GROUP BY 1
)
SELECT {lead} '{L.SRM_NAME}' AS test_name, x AS chi_square_statistic, df AS degrees_of_freedom,
  CASE df WHEN 1 THEN {rnd(erfc_nonnegative('sqrt(x / 2e0)'), 4)} WHEN 2 THEN {rnd('exp(-x / 2e0)', 4)} END AS p_value,
  CASE WHEN x IS NULL THEN '{L.SRM_NO_DATA}'
       WHEN x > CASE df WHEN 1 THEN 6.63e0 WHEN 2 THEN 9.210340371976184e0 END THEN '{L.SRM_DETECTED}'
       WHEN x > CASE df WHEN 1 THEN 3.84e0 WHEN 2 THEN 5.991464547107979e0 END THEN '{L.SRM_POSSIBLE}'
       ELSE '{L.SRM_NONE}' END AS srm_result
FROM chi"""


def metrics(on: str = FORWARD) -> str:
    """Session metrics by the literal join with all later events."""
    return f"""
sm AS (
  SELECT e.experiment_id, e.variant, e.is_control, e.session_id, e.user_pseudo_id,
    CASE WHEN COUNT(*) FILTER (ev.event_name = 'page_view') = 1 THEN 1 ELSE 0 END AS is_bounce,
    (MAX(ev.event_timestamp) - MIN(ev.event_timestamp))::DOUBLE / 6e7 AS minutes,
    COUNT(*) FILTER (ev.event_name = 'page_view') AS pages_per_session,
    MAX(CASE WHEN ev.event_name = 'add_to_cart' THEN 1 ELSE 0 END) AS added_to_cart,
    MAX(CASE WHEN ev.event_name = 'purchase' THEN 1 ELSE 0 END) AS purchased,
    COUNT(*) FILTER (ev.event_name IN ('scroll', 'click', 'view_item')) AS engagement_events,
    COUNT(*) FILTER (ev.event_name = 'scroll') AS scrolls,
    COUNT(*) FILTER (ev.event_name = 'click') AS clicks,
    COUNT(*) FILTER (ev.event_name = 'purchase') AS purchases
  FROM ex e LEFT JOIN ga4 ev ON {on}
  GROUP BY 1, 2, 3, 4, 5
),
sd AS (SELECT *, {rnd('minutes', 2)} AS session_duration_min FROM sm)"""


# Durations have two places, so their mean is taken over whole hundredths: a sum
# of doubles would depend on the order of the rows.
MEAN_DURATION = "(AVG(CAST(round(session_duration_min * 100) AS BIGINT)) / 1e2)"

METRICS_SELECT = """
SELECT variant, session_id, user_pseudo_id, is_bounce, session_duration_min, pages_per_session,
  added_to_cart, purchased, engagement_events, scrolls, clicks, purchases FROM sd"""

GUARD_STATS = f"""
gs AS (
  SELECT experiment_id, variant, is_control, COUNT(DISTINCT user_pseudo_id) AS sessions,
    {rnd('AVG(is_bounce) * 100', 2)} AS bounce_rate_pct,
    {rnd(MEAN_DURATION, 2)} AS avg_session_duration_min,
    {rnd('AVG(pages_per_session)', 2)} AS avg_pages_per_session,
    {rnd('SUM(CASE WHEN added_to_cart = 1 AND purchased = 0 THEN 1 ELSE 0 END) * 1e2 / NULLIF(SUM(added_to_cart), 0)', 2)}
      AS cart_abandonment_rate_pct,
    {rnd('AVG(engagement_events)', 2)} AS avg_engagement_events
  FROM sd GROUP BY 1, 2, 3
)"""


def guard_select(lead: str = "") -> str:
    return f"""
SELECT {lead} a.variant AS control, b.variant AS variant,
  a.sessions AS control_sessions, b.sessions AS variant_sessions,
  a.bounce_rate_pct AS control_bounce_pct, b.bounce_rate_pct AS variant_bounce_pct,
  {rnd('b.bounce_rate_pct - a.bounce_rate_pct', 2)} AS bounce_rate_diff_pct,
  CASE WHEN b.bounce_rate_pct > a.bounce_rate_pct + 5 THEN '{L.BOUNCE_FAIL}'
       ELSE '{L.GUARDRAIL_PASS}' END AS bounce_check,
  a.avg_session_duration_min AS control_duration_min,
  b.avg_session_duration_min AS variant_duration_min,
  {rnd('b.avg_session_duration_min - a.avg_session_duration_min', 2)} AS duration_diff_min,
  CASE WHEN b.avg_session_duration_min < a.avg_session_duration_min * 0.8e0 THEN '{L.DURATION_FAIL}'
       ELSE '{L.GUARDRAIL_PASS}' END AS duration_check,
  a.cart_abandonment_rate_pct AS control_cart_abandon_pct,
  b.cart_abandonment_rate_pct AS variant_cart_abandon_pct,
  {rnd('b.cart_abandonment_rate_pct - a.cart_abandonment_rate_pct', 2)} AS cart_diff_pct,
  CASE WHEN b.cart_abandonment_rate_pct > a.cart_abandonment_rate_pct + 10 THEN '{L.CART_FAIL}'
       ELSE '{L.GUARDRAIL_PASS}' END AS cart_check
FROM gab"""


ENGAGEMENT_SELECT = f"""
SELECT variant, COUNT(DISTINCT session_id) AS sessions,
  {rnd('AVG(is_bounce) * 100', 2)} AS bounce_rate_pct,
  {rnd('AVG(pages_per_session)', 2)} AS avg_pageviews,
  {rnd(MEAN_DURATION, 2)} AS avg_duration_min,
  {rnd('(1 - AVG(is_bounce)) * 100', 2)} AS engagement_rate_pct,
  {rnd('COUNT(*) FILTER (clicks > 0) * 1e2 / COUNT(*)', 2)} AS click_rate_pct,
  {rnd('COUNT(*) FILTER (purchases > 0) * 1e2 / COUNT(*)', 2)} AS conversion_rate_pct
FROM sd GROUP BY variant ORDER BY variant"""

BOUNCE_SELECT = f"""
, rates AS (
  SELECT experiment_id, variant, is_control, AVG(is_bounce) AS br, AVG(pages_per_session) AS pv
  FROM sd GROUP BY 1, 2, 3
),
{pairs('rates', 'rab')}
SELECT {rnd('a.br * 100', 2)} AS control_bounce_pct, {rnd('b.br * 100', 2)} AS variant_bounce_pct,
  {rnd('(b.br - a.br) * 100', 2)} AS bounce_diff_pct_points,
  CASE WHEN b.br < a.br THEN '{L.LOWER_IS_BETTER}' ELSE '{L.VARIANT_WORSE}' END AS bounce_verdict,
  {rnd('a.pv', 2)} AS control_pageviews, {rnd('b.pv', 2)} AS variant_pageviews,
  {rnd('b.pv - a.pv', 2)} AS pageviews_diff,
  CASE WHEN b.pv > a.pv THEN '{L.HIGHER_IS_BETTER}' ELSE '{L.VARIANT_WORSE}' END AS pageviews_verdict
FROM rab"""


def top_pages(name: str, where: str) -> str:
    return f"""
{name} AS (
  SELECT page_location, COUNT(DISTINCT user_pseudo_id) AS unique_users, COUNT(*) AS pageviews,
         COUNT(*) FILTER (event_name = 'purchase') AS conversions,
         {rnd("COUNT(*) FILTER (event_name = 'purchase') * 1e2 / NULLIF(COUNT(DISTINCT user_pseudo_id), 0)", 2)} AS cr_pct
  FROM ga4 WHERE {where}
  GROUP BY 1 ORDER BY unique_users DESC NULLS LAST, page_location ASC NULLS FIRST LIMIT 50
)"""


BY_URL = top_pages(
    "by_url",
    "event_name IN ('page_view', 'purchase') AND (page_location LIKE '%/landing%' "
    "OR page_location LIKE '%/v1%' OR page_location LIKE '%/v2%' OR page_location LIKE '%?variant=%' "
    "OR page_location LIKE '%?test=%' OR page_location LIKE '%?exp=%')",
)
BY_PARAM = top_pages("by_param", "event_name = 'page_view' AND has_experiment_param")
BY_PARAM_ALL = top_pages(
    "by_param", "event_name IN ('page_view', 'purchase') AND has_experiment_param"
)
BOTH_METHODS = """
SELECT 'url_pattern' AS method, * FROM by_url
UNION ALL SELECT 'event_param' AS method, * FROM by_param"""

SOURCE = """
ranked AS (
  SELECT *, source IS NOT NULL OR medium IS NOT NULL AS named,
         CASE WHEN named AND event_name NOT IN ('session_start', 'first_visit') THEN 0
              WHEN named AND event_name = 'session_start' THEN 1 ELSE 2 END AS place
  FROM ga4 WHERE session_id IS NOT NULL
),
resolved AS (
  SELECT user_pseudo_id, session_id, make_timestamp(event_timestamp) AS session_start,
         COALESCE(source, '(direct)') AS source, COALESCE(medium, '(none)') AS medium
  FROM ranked
  QUALIFY ROW_NUMBER() OVER (
    PARTITION BY user_pseudo_id, session_id
    ORDER BY place, event_timestamp, source NULLS FIRST, medium NULLS FIRST) = 1
)"""
# The exact media of each channel.
CHANNEL = """
media(exact, its_channel) AS (VALUES
  ('cpc', 'Paid Search'), ('ppc', 'Paid Search'), ('paidsearch', 'Paid Search'),
  ('organic', 'Organic Search'), ('email', 'Email'), ('display', 'Display'), ('banner', 'Display'),
  ('referral', 'Referral'), ('affiliate', 'Affiliate'), ('(none)', 'Direct'), ('', 'Direct')),
channels AS (
  SELECT r.*, COALESCE(its_channel, CASE WHEN contains(lower(medium), 'social') THEN 'Social' END,
                       source || ' / ' || medium) AS channel
  FROM resolved r LEFT JOIN media ON exact = medium
)"""
# The session of a unit's first exposure; the smaller id (NULL first) at a tie.
UNIT_CHANNEL = """
first_session AS (
  SELECT experiment_id, variant, user_pseudo_id, session_id FROM arm_views
  QUALIFY ROW_NUMBER() OVER (PARTITION BY experiment_id, variant, user_pseudo_id
                             ORDER BY event_timestamp, session_id NULLS FIRST) = 1
),
u2 AS (
  SELECT u.*, c.channel FROM u
  JOIN first_session f ON f.experiment_id = u.experiment_id AND f.variant = u.variant
                      AND f.user_pseudo_id IS NOT DISTINCT FROM u.user_pseudo_id
  LEFT JOIN channels c ON c.user_pseudo_id = f.user_pseudo_id AND c.session_id = f.session_id
)"""


def sample_size(table: str, segment: str = "") -> str:
    seg = f"{segment}, " if segment else ""
    on = f"c.{segment} IS NOT DISTINCT FROM d.{segment}" if segment else "TRUE"
    days = ", ".join(
        f"{rnd(f'n * 2 / {t}e3', 1)} AS days_at_{t}k_daily_traffic" for t in (1, 5, 10)
    )
    return f""",
per_day AS (
  SELECT {seg}CAST(make_timestamp(session_start) AS DATE) AS day,
         COUNT(DISTINCT user_pseudo_id) AS users
  FROM {table} GROUP BY ALL
),
traffic AS (SELECT {seg}AVG(users) AS daily_traffic FROM per_day GROUP BY ALL),
control AS (SELECT {seg}AVG(converted) AS p1 FROM {table} WHERE is_control GROUP BY ALL),
grid(name, mde) AS (VALUES ('Sample Size Calculation', 0.15e0),
  ('Scenario: 10% MDE (smaller effect)', 0.10e0), ('Scenario: 20% MDE (larger effect)', 0.20e0)),
plan AS (
  SELECT d.*, c.p1, g.name, g.mde, c.p1 * (1 + g.mde) AS p2
  FROM traffic d LEFT JOIN control c ON {on} CROSS JOIN grid g
),
sized AS (
  SELECT *, CASE WHEN p2 <= 1 THEN
    pow(1.96e0 * sqrt(2 * ((p1 + p2) / 2) * (1 - (p1 + p2) / 2))
        + 0.84e0 * sqrt(p1 * (1 - p1) + p2 * (1 - p2)), 2) / NULLIF(pow(p2 - p1, 2), 0) END AS n
  FROM plan
)
SELECT {seg}name AS calculation_type, {rnd('p1 * 100', 2)} AS baseline_cr_pct,
  {rnd('p2 * 100', 2)} AS target_cr_pct, {rnd('mde * 100', 1)} AS mde_relative_pct,
  {rnd('p1 * mde * 100', 3)} AS mde_absolute_pp, 0.05e0 AS alpha, 0.8e0 AS power,
  1.96e0 AS z_alpha, 0.84e0 AS z_beta,
  {rnd('n', 0)} AS sample_size_per_variant, {rnd('n * 2', 0)} AS total_sample_size,
  {rnd('n * 2 / 1e3', 1)} AS total_sample_size_k, {days},
  {rnd('daily_traffic', 2)} AS daily_traffic,
  {rnd('n * 2 / daily_traffic', 1)} AS days_at_measured_traffic
FROM sized"""


def decision(arms, min_days: int | None = None) -> str:
    timed = min_days is not None
    flag = ", d.long_enough" if timed else ""
    need = " AND d.long_enough" if timed else ""
    return f""",
{srm(arms)},
{exposed(USER)}, {units()}, {stats()}, {pairs('vs')}, {Z},
exs AS (SELECT experiment_id, variant, is_control, user_pseudo_id, session_id,
               MIN(event_timestamp) AS session_start FROM arm_views GROUP BY 1, 2, 3, 4, 5),
{metrics().replace('FROM ex e', 'FROM exs e')},
{GUARD_STATS},
{pairs('gs', 'gab')},
tests AS (
  SELECT experiment_id, a.variant AS control, b.variant AS variant, COALESCE(abs(z) > 1.96e0, FALSE) AS significant, z,
         COALESCE({rnd('(pb - pa) / NULLIF(pa, 0) * 100', 2)} >= 15, FALSE) AS effect_ok
  FROM z1
),
rails AS (
  SELECT experiment_id, b.variant AS variant,
    NOT (COALESCE(b.bounce_rate_pct > a.bounce_rate_pct + 5, FALSE)
      OR COALESCE(b.avg_session_duration_min < a.avg_session_duration_min * 0.8e0, FALSE)
      OR COALESCE(b.cart_abandonment_rate_pct > a.cart_abandonment_rate_pct + 10, FALSE)) AS guardrails_ok
  FROM gab
),
splits AS (SELECT experiment_id, COUNT(*) = 2 AS two, COALESCE(SUM(part) <= CASE COUNT(*) WHEN 2 THEN 6.63e0
             WHEN 3 THEN 9.210340371976184e0 END, FALSE) AS srm_ok FROM parts GROUP BY 1),
lengths AS (
  SELECT experiment_id, (MAX(session_start) - MIN(session_start)) / 864e8 >= {min_days or 0} AS long_enough
  FROM u GROUP BY 1
)
SELECT s.experiment_id, t.variant, t.significant, t.effect_ok, r.guardrails_ok, s.srm_ok{flag},
  CASE WHEN NOT (s.srm_ok AND r.guardrails_ok) THEN '{L.DECISION_INVALID}'
       WHEN t.significant AND t.effect_ok{need} THEN CASE WHEN two THEN '{L.DECISION_LAUNCH}' ELSE 'Launch ' || t.variant END
       WHEN t.significant AND z < 0 THEN CASE WHEN two THEN '{L.DECISION_KEEP}' ELSE 'Keep ' || control END
       ELSE '{L.DECISION_FOLLOW_UP}' END AS decision
FROM splits s JOIN tests t ON t.experiment_id = s.experiment_id
JOIN rails r ON r.experiment_id = t.experiment_id AND r.variant = t.variant
JOIN lengths d ON d.experiment_id = t.experiment_id"""


# Session metrics in the channel of their session.
SESSION_CHANNEL = """
sc AS (
  SELECT s.*, c.channel FROM sd s
  LEFT JOIN channels c ON c.user_pseudo_id = s.user_pseudo_id AND c.session_id = s.session_id
)"""


def in_channels(text: str) -> str:
    """A statement per variant of the session metrics, per channel as well."""
    text = text.replace("FROM sd GROUP BY 1, 2, 3", "FROM sc GROUP BY ALL")
    text = text.replace("FROM sd GROUP BY variant ORDER BY variant", "FROM sc GROUP BY channel, variant")
    return text.replace("SELECT experiment_id, variant,", "SELECT channel, experiment_id, variant,").replace("SELECT variant,", "SELECT channel, variant,")


def channel_split(arms) -> str:
    """The split by the channel of first exposure: every arm in each channel that its experiment was seen in."""
    planned = ", ".join(f"('{e}', '{v}', {share})" for e, v, _, share, _ in arms)
    return f"""
planned(experiment_id, variant, share) AS (VALUES {planned}),
seen_in AS (SELECT DISTINCT experiment_id, channel FROM u2),
counts AS (
  SELECT p.experiment_id, s.channel, p.variant, p.share, COUNT(u.user_pseudo_id) AS users
  FROM planned p JOIN seen_in s ON s.experiment_id = p.experiment_id
  LEFT JOIN u2 u ON u.experiment_id = p.experiment_id AND u.variant = p.variant AND u.channel IS NOT DISTINCT FROM s.channel
  GROUP BY ALL
),
totals AS (SELECT experiment_id, channel, CAST(SUM(users) AS DOUBLE) AS total FROM counts GROUP BY ALL),
parts AS (
  SELECT c.*, t.total, t.total * c.share AS expected,
         pow(c.users - t.total * c.share, 2) / NULLIF(t.total * c.share, 0) AS part
  FROM counts c JOIN totals t ON t.experiment_id = c.experiment_id AND t.channel IS NOT DISTINCT FROM c.channel
)"""


def decision_by_channel(arms) -> str:
    return f""",
{views(arms)}, {exposed(USER)}, {units()}, {SOURCE}, {CHANNEL}, {UNIT_CHANNEL}, {channel_split(arms)},
{stats('channel').replace('FROM u ', 'FROM u2 ')}, {pairs('vs', segment='channel')}, {Z},
exs AS (SELECT experiment_id, variant, is_control, user_pseudo_id, session_id,
               MIN(event_timestamp) AS session_start FROM arm_views GROUP BY 1, 2, 3, 4, 5),
{metrics().replace('FROM ex e', 'FROM exs e')}, {SESSION_CHANNEL}, {in_channels(GUARD_STATS)},
tests AS (
  SELECT experiment_id, channel, a.variant AS control, b.variant AS variant, COALESCE(abs(z) > 1.96e0, FALSE) AS significant, z,
         COALESCE({rnd('(pb - pa) / NULLIF(pa, 0) * 100', 2)} >= 15, FALSE) AS effect_ok
  FROM z1
),
rails AS (
  SELECT t.experiment_id, t.channel, t.variant,
    NOT (COALESCE(b.bounce_rate_pct > a.bounce_rate_pct + 5, FALSE)
      OR COALESCE(b.avg_session_duration_min < a.avg_session_duration_min * 0.8e0, FALSE)
      OR COALESCE(b.cart_abandonment_rate_pct > a.cart_abandonment_rate_pct + 10, FALSE)) AS guardrails_ok
  FROM tests t
  JOIN gs a ON a.experiment_id = t.experiment_id AND a.channel IS NOT DISTINCT FROM t.channel AND a.variant = t.control
  JOIN gs b ON b.experiment_id = t.experiment_id AND b.channel IS NOT DISTINCT FROM t.channel AND b.variant = t.variant
),
splits AS (SELECT experiment_id, channel, COUNT(*) = 2 AS two, COALESCE(SUM(part) <= CASE COUNT(*) WHEN 2 THEN 6.63e0
             WHEN 3 THEN 9.210340371976184e0 END, FALSE) AS srm_ok FROM parts GROUP BY ALL)
SELECT s.experiment_id, s.channel, t.variant, COALESCE(t.significant, FALSE) AS significant, COALESCE(t.effect_ok, FALSE) AS effect_ok,
  COALESCE(r.guardrails_ok, FALSE) AS guardrails_ok, s.srm_ok,
  CASE WHEN NOT (s.srm_ok AND COALESCE(r.guardrails_ok, FALSE)) THEN '{L.DECISION_INVALID}'
       WHEN t.significant AND t.effect_ok THEN CASE WHEN two THEN '{L.DECISION_LAUNCH}' ELSE 'Launch ' || t.variant END
       WHEN t.significant AND z < 0 THEN CASE WHEN two THEN '{L.DECISION_KEEP}' ELSE 'Keep ' || control END
       ELSE '{L.DECISION_FOLLOW_UP}' END AS decision
FROM splits s LEFT JOIN tests t ON t.experiment_id = s.experiment_id AND t.channel IS NOT DISTINCT FROM s.channel
LEFT JOIN rails r ON r.experiment_id = t.experiment_id AND r.variant = t.variant AND r.channel IS NOT DISTINCT FROM t.channel"""


def _with(*parts: str) -> str:
    """CTEs, then the statement as the last part, which may start with further
    CTEs of its own (led by a comma)."""
    *ctes, final = [GA4, *parts]
    joint = "" if final.lstrip().startswith(",") else "\n"
    return "WITH " + ",\n".join(c.strip() for c in ctes) + joint + final


def statements() -> dict[str, str]:
    landing = views(LANDING)
    by_user = (landing, exposed(USER), units())
    by_session = (landing, exposed(USER_SESSION))
    tested = (*by_user, stats(), pairs("vs"))
    sessions = (*by_session, metrics())
    guarded = (*sessions, GUARD_STATS)
    registry = (views(REGISTRY), exposed(USER), units(), stats(), pairs("vs"))
    registry_guarded = (
        views(REGISTRY), exposed(USER_SESSION), metrics(), GUARD_STATS, pairs("gs", "gab"),
    )
    in_session = (landing, exposed(USER_SESSION), units(WITHIN))
    channelled = (*by_user, SOURCE, CHANNEL, UNIT_CHANNEL)
    by_channel = (
        *channelled, stats("channel").replace("FROM u ", "FROM u2 "), pairs("vs", segment="channel"),
    )
    test_url = "(page_location LIKE '%/landing-v1%' OR page_location LIKE '%/landing-v2%')"
    lead = "experiment_id,"

    def crossover(keep: str):
        return (landing, exposed(USER), units(keep=keep), stats(), pairs("vs"), Z, z_select())

    registry_channelled = (views(REGISTRY), exposed(USER), units(), SOURCE, CHANNEL, UNIT_CHANNEL)
    session_channelled = (*sessions, SOURCE, CHANNEL, SESSION_CHANNEL)

    def two_weeks(text: str) -> str:
        return text.replace("TIMESTAMP '2024-01-01'", "TIMESTAMP '2024-01-08'").replace("TIMESTAMP '2024-02-01'", "TIMESTAMP '2024-01-22'")

    rolled_up = (
        "SELECT '{}' AS method, page_location, COUNT(DISTINCT user_pseudo_id) AS unique_users FROM ga4 WHERE {} "
        "AND user_pseudo_id IS NOT NULL GROUP BY ALL"
    )
    by_url, by_param = (t.split("WHERE ")[-1].split("GROUP BY 1")[0] for t in (BY_URL, BY_PARAM))

    return {
        "z_test_partitioned": two_weeks(_with(*tested, Z, z_select())),
        "z_test_daily": _with(*registry, Z, z_select(lead)),
        "srm_test_rolled_up": _with(srm(REGISTRY), srm_test_select(lead)),
        "srm_counts_by_day": _with(
            views(REGISTRY).replace("session_id, event_timestamp FROM", "session_id, event_timestamp, event_date FROM"),
            "SELECT experiment_id, event_date, variant, COUNT(DISTINCT user_pseudo_id) AS users FROM arm_views GROUP BY ALL",
        ),
        "test_pages_rolled_up": _with(
            rolled_up.format("url_pattern", by_url) + " UNION ALL " + rolled_up.format("event_param", by_param)
        ),
        "landing_page_view": _with(
            "SELECT event_name, COUNT(*) AS n, COUNT(DISTINCT user_pseudo_id) AS users FROM ga4 GROUP BY event_name"
        ),
        "classify_variants_limited": _with(
            "SELECT DISTINCT user_pseudo_id, session_id, page_location, CASE "
            "WHEN page_location LIKE '%/landing-v1%' THEN 'Control_A' "
            "WHEN page_location LIKE '%/landing-v2%' THEN 'Variant_B' ELSE 'Unknown' END AS experiment_variant "
            "FROM ga4 WHERE event_name = 'page_view' AND page_location LIKE '%/landing%' "
            "ORDER BY user_pseudo_id NULLS FIRST, session_id NULLS FIRST, page_location NULLS FIRST LIMIT 100"
        ),
        "experiment_page_views_limited": _with(
            "SELECT user_pseudo_id, session_id, page_location, MIN(event_timestamp) AS session_start "
            f"FROM ga4 WHERE event_name = 'page_view' AND {test_url} GROUP BY 1, 2, 3 "
            "ORDER BY user_pseudo_id NULLS FIRST, session_id NULLS FIRST, page_location NULLS FIRST LIMIT 100"
        ),
        "guardrails_by_channel": _with(
            *session_channelled, in_channels(GUARD_STATS), pairs("gs", "gab", "channel"), guard_select("channel,")
        ),
        "engagement_by_channel": _with(*session_channelled, in_channels(ENGAGEMENT_SELECT)),
        "bounce_comparison_by_channel": _with(
            *session_channelled,
            in_channels(BOUNCE_SELECT).replace(pairs("rates", "rab"), pairs("rates", "rab", "channel")).replace(
                ")\nSELECT", ")\nSELECT channel,"
            ),
        ),
        "srm_split_by_channel": _with(
            *channelled, channel_split(LANDING),
            f"SELECT channel, variant, users, {rnd('expected', 0)} AS expected_users, "
            f"{rnd('users / total * 100', 1)} AS actual_pct, {rnd('share * 100', 1)} AS expected_pct, "
            f"{rnd('part', 2)} AS chi_square_component FROM parts",
        ),
        "srm_test_by_channel": _with(
            *channelled, channel_split(LANDING),
            srm_test_select("channel,").replace("SELECT experiment_id, SUM", "SELECT experiment_id, channel, SUM").replace("GROUP BY 1", "GROUP BY ALL"),
        ),
        "z_test_registry_by_channel": _with(
            *registry_channelled,
            stats("channel").replace("FROM u ", "FROM u2 "),
            pairs("vs", segment="channel"),
            Z,
            z_select("experiment_id, channel,"),
        ),
        "launch_decision_by_channel": _with(decision_by_channel(REGISTRY)),
        "ga4_events": _with("SELECT * FROM ga4"),
        "landing_page_experiments": _with(
            "SELECT user_pseudo_id, session_id, page_location, event_timestamp, event_name FROM ga4"
        ),
        "experiment_page_views": _with(
            "SELECT user_pseudo_id, session_id, page_location, MIN(event_timestamp) AS session_start "
            f"FROM ga4 WHERE event_name = 'page_view' AND {test_url} GROUP BY 1, 2, 3"
        ),
        "classify_variants": _with(
            "SELECT DISTINCT user_pseudo_id, session_id, page_location, CASE "
            "WHEN page_location LIKE '%/landing-v1%' THEN 'Control_A' "
            "WHEN page_location LIKE '%/landing-v2%' THEN 'Variant_B' ELSE 'Unknown' END AS experiment_variant "
            "FROM ga4 WHERE event_name = 'page_view' AND page_location LIKE '%/landing%'"
        ),
        "experiment_page_views_registry": _with(
            " UNION ALL ".join(
                "SELECT '{}' AS experiment_id, user_pseudo_id, session_id, page_location, MIN(event_timestamp) AS "
                "session_start FROM (SELECT *, page_location AS p FROM ga4 WHERE event_name = 'page_view') "
                "WHERE {} GROUP BY ALL".format(e, " OR ".join(t for x, _, _, _, t in REGISTRY if x == e))
                for e in dict.fromkeys(x for x, *_ in REGISTRY)
            )
        ),
        "classify_variants_registry": _with(
            " UNION ALL ".join(
                "SELECT DISTINCT '{}' AS experiment_id, user_pseudo_id, session_id, page_location, CASE {} ELSE 'Unknown' END "
                "AS experiment_variant FROM (SELECT *, page_location AS p FROM ga4 WHERE event_name = 'page_view') "
                "WHERE p LIKE '%/landing%'".format(
                    e, " ".join(f"WHEN {t} THEN '{v}'" for x, v, _, _, t in REGISTRY if x == e)
                )
                for e in dict.fromkeys(x for x, *_ in REGISTRY)
            )
        ),
        "sample_size_registry": _with(views(REGISTRY), exposed(USER), units(), sample_size("u", "experiment_id")),
        "bayes_test_by_channel": _with(*by_channel, BAYES, bayes_select("channel,")),
        "effect_size_by_channel": _with(*by_channel, EFFECT, effect_select("channel,")),
        "test_pages_uncut": _with(
            BY_URL.replace("LIMIT 50", ""), BY_PARAM.replace("LIMIT 50", ""), BOTH_METHODS
        ),
        "exposures": _with(
            landing, exposed(USER), "SELECT user_pseudo_id, variant, session_start FROM ex"
        ),
        "exposures_by_session": _with(
            *by_session, "SELECT user_pseudo_id, session_id, variant, session_start FROM ex"
        ),
        "conversions": _with(*by_user, "SELECT user_pseudo_id, variant, converted FROM u"),
        "conversions_bucketed": _with(*by_user, "SELECT user_pseudo_id, variant, converted FROM u"),
        "conversions_in_session": _with(
            *in_session, "SELECT user_pseudo_id, variant, converted FROM u"
        ),
        "variant_stats": _with(
            *by_user,
            stats(),
            f"SELECT variant, visitors, conversions, cr, {rnd('stddev', 9)} AS stddev, alpha, beta FROM vs",
        ),
        "z_test": _with(*tested, Z, z_select()),
        "z_test_in_session": _with(*in_session, stats(), pairs("vs"), Z, z_select()),
        "z_test_without_crossovers": _with(*crossover("arms_seen = 1")),
        "z_test_first_arm": _with(*crossover("arm_order = 1")),
        "z_test_registry": _with(*registry, Z, z_select(lead)),
        "z_test_by_channel": _with(
            *channelled,
            stats("channel").replace("FROM u ", "FROM u2 "),
            pairs("vs", segment="channel"),
            Z,
            z_select("channel,"),
        ),
        "bayes_test": _with(*tested, BAYES, bayes_select()),
        "bayes_test_registry": _with(*registry, BAYES, bayes_select(lead)),
        "effect_size": _with(*tested, EFFECT, effect_select()),
        "effect_size_registry": _with(*registry, EFFECT, effect_select(lead)),
        "srm_split": _with(
            srm(LANDING),
            f"SELECT variant, users, {rnd('expected', 0)} AS expected_users, "
            f"{rnd('users / total * 100', 1)} AS actual_pct, {rnd('share * 100', 1)} AS expected_pct, "
            f"{rnd('part', 2)} AS chi_square_component FROM parts",
        ),
        "srm_test": _with(srm(LANDING), srm_test_select()),
        "srm_test_registry": _with(srm(REGISTRY), srm_test_select(lead)),
        "session_metrics": _with(*sessions, METRICS_SELECT),
        "session_metrics_in_session": _with(*by_session, metrics(WITHIN), METRICS_SELECT),
        "guardrail_stats": _with(
            *guarded,
            "SELECT variant, sessions, bounce_rate_pct, avg_session_duration_min, "
            "avg_pages_per_session, cart_abandonment_rate_pct, avg_engagement_events FROM gs",
        ),
        "guardrails": _with(*guarded, pairs("gs", "gab"), guard_select()),
        "guardrails_registry": _with(*registry_guarded, guard_select(lead)),
        "engagement_by_variant": _with(*sessions, ENGAGEMENT_SELECT),
        "bounce_comparison": _with(*sessions, BOUNCE_SELECT),
        "test_pages_by_url": _with(BY_URL, "SELECT * FROM by_url"),
        "test_pages_by_param": _with(BY_PARAM, "SELECT * FROM by_param"),
        "test_pages": _with(BY_URL, BY_PARAM, BOTH_METHODS),
        "test_pages_with_purchases": _with(BY_URL, BY_PARAM_ALL, BOTH_METHODS),
        "session_source": _with(SOURCE, "SELECT * FROM resolved"),
        "session_channel": _with(SOURCE, CHANNEL, "SELECT * FROM channels"),
        "sample_size": _with(*by_user, sample_size("u")),
        "sample_size_by_channel": _with(*channelled, sample_size("u2", "channel")),
        "launch_decision": _with(decision(REGISTRY)),
        "launch_decision_with_duration": _with(decision(REGISTRY, 14)),
    }
