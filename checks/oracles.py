"""The registered queries as plain SQL over the same tables, for comparison in DuckDB."""

from __future__ import annotations

from staylight.bindings import ACCOUNTS as SPEC
from staylight.bindings import DOCUMENTS
from staylight.functions.derived import PAY_RISES, RISK_BANDS
from staylight.scorecards import ACCOUNT_SCORECARD as CARD
from staylight.spec import RateClaim

THRESHOLD = 0.5
SEED = 42
FOLDS, FOLD_REPEATS = 5, 2
IMPORTANCE_REPEATS = 3
STAMP = "2024-05-01 12:30:45"

CATS, NUMS = list(SPEC.categoricals), list(SPEC.numerics)
MODEL_CATS, MODEL_NUMS = list(SPEC.model_categoricals), list(SPEC.model_numerics)


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def even(expr: str, digits: int) -> str:
    """Round halves to even; ``+ 0.0`` turns a negative zero into a plain one."""
    return f"(round_even(CAST({expr} AS DOUBLE), {digits}) + 0.0)"


def rate4(left: str, total: str) -> str:
    """``left / total`` to 4 decimals, halves to even, in whole numbers only."""
    num, den = f"(CAST({left} AS BIGINT) * 10000)", f"CAST({total} AS BIGINT)"
    up = f"(2 * ({num} % {den}) > {den} OR (2 * ({num} % {den}) = {den} AND ({num} // {den}) % 2 = 1))"
    return f"(CAST({num} // {den} + CASE WHEN {up} THEN 1 ELSE 0 END AS DOUBLE) / 10000.0::DOUBLE)"


def case_map(column: str, table: dict, default: str) -> str:
    whens = " ".join(f"WHEN {q(k)} THEN {v}" for k, v in table.items())
    return f"(CASE {column} {whens} ELSE {default} END)"


PANEL = """
bounds AS (SELECT max(CAST(o_orderdate AS DATE)) - 180 AS snapshot,
                  min(CAST(o_orderdate AS DATE)) AS start_day FROM orders),
dated AS (SELECT o.*, CAST(o.o_orderdate AS DATE) AS day, b.snapshot, b.start_day
          FROM orders o, bounds b),
order_figures AS (
  SELECT o_custkey, count(*) AS orders_n,
         count(*) FILTER (WHERE o_orderpriority = '1-URGENT') AS urgent_n,
         count(*) FILTER (WHERE o_orderstatus = 'F') AS filled_n,
         count(*) FILTER (WHERE day > snapshot - 365) AS orders_last_year,
         CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS cents,
         date_diff('day', min(day), any_value(snapshot)) AS tenure_days,
         date_diff('day', max(day), any_value(snapshot)) AS recency_days,
         date_diff('day', any_value(start_day), any_value(snapshot)) AS span_days
  FROM dated WHERE day <= snapshot GROUP BY o_custkey),
later AS (SELECT DISTINCT o_custkey FROM dated WHERE day > snapshot),
line_figures AS (
  SELECT o_custkey, count(*) AS lines_n, count(DISTINCT l_suppkey) AS suppliers_n,
         count(*) FILTER (WHERE l_returnflag = 'R') AS returned_n,
         CAST(sum(CAST(round(l_discount * 100) AS BIGINT)) AS BIGINT) AS points
  FROM lineitem JOIN dated ON l_orderkey = o_orderkey AND day <= snapshot GROUP BY o_custkey),
joined AS (
  SELECT c.*, n_name, r_name, f.*,
         coalesce(l.lines_n, 0) AS lines_n, coalesce(l.suppliers_n, 0) AS suppliers_n,
         coalesce(l.returned_n, 0) AS returned_n, coalesce(l.points, 0) AS points,
         greatest(f.tenure_days // 30, 1) AS months, t.o_custkey IS NULL AS gone
  FROM customer c JOIN order_figures f ON c_custkey = f.o_custkey
  LEFT JOIN line_figures l ON c_custkey = l.o_custkey
  LEFT JOIN later t ON c_custkey = t.o_custkey
  JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
panel AS (
  SELECT c_custkey AS account_id, r_name AS region, c_mktsegment AS segment, n_name AS nation,
    CASE WHEN c_acctbal < 1200 THEN 'Entry' WHEN c_acctbal < 3500 THEN 'Junior'
         WHEN c_acctbal < 5700 THEN 'Mid' WHEN c_acctbal < 8000 THEN 'Senior'
         ELSE 'Executive' END AS tier,
    CASE WHEN urgent_n * 5 >= orders_n THEN 'Yes' ELSE 'No' END AS urgent,
    CASE WHEN returned_n * 100 < lines_n * 30 THEN 'None'
         WHEN returned_n * 100 < lines_n * 37 THEN 'Rare' ELSE 'Frequent' END AS returns,
    CASE WHEN points * 10 < lines_n * 47 THEN 'None' WHEN points * 10 < lines_n * 50 THEN 'Basic'
         WHEN points * 10 < lines_n * 53 THEN 'Standard' ELSE 'Premium' END AS discount,
    CASE WHEN filled_n * 5 < orders_n THEN 'Low' WHEN filled_n * 3 < orders_n THEN 'Medium'
         WHEN filled_n * 2 < orders_n THEN 'High' ELSE 'Very High' END AS fulfilment,
    CAST((2 * cents + months) // (2 * months) AS DOUBLE) / 100.0::DOUBLE AS monthly_spend,
    CAST(tenure_days AS DOUBLE) / 365.25::DOUBLE AS tenure_years,
    CAST(recency_days AS DOUBLE) / 365.25::DOUBLE AS recency_years,
    CAST(span_days AS DOUBLE) / 365.25::DOUBLE AS span_years,
    orders_n, orders_last_year, suppliers_n,
    CASE WHEN gone THEN 'Yes' ELSE 'No' END AS churned
  FROM joined)"""

DOC_PANEL = """
docs AS (
  SELECT d.doc_id, CASE WHEN quality = 1 THEN 'Good' ELSE 'Poor' END AS quality, lang, source,
         n_chars, CASE WHEN toxic = 1 THEN 'Yes' ELSE 'No' END AS toxic
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"""


def features(source: str, name: str = "feat") -> str:
    """The derived columns on top of a CTE with the panel's columns."""
    level = case_map("tier", dict(SPEC.level_ranks), "1")
    share = "CASE WHEN span_years > 0 THEN tenure_years / span_years ELSE 1.0 END"
    gap = "CASE WHEN tenure_years > 0 THEN recency_years / tenure_years ELSE recency_years END"
    return f"""
{name} AS (
  SELECT *, {even(f'least(greatest({share}, 0), 1)', 3)} AS career_share,
    {even(f'least(greatest({gap}, 0), 5)', 3)} AS promotion_gap,
    {even(f'monthly_spend / CAST({level} AS DOUBLE)', 0)} AS pay_per_level,
    {level} AS level_rank,
    CASE WHEN tenure_years < 2 THEN 'Under 2 years' WHEN tenure_years < 5 THEN '2-5 years'
         WHEN tenure_years < 10 THEN '5-10 years' ELSE '10+ years' END AS tenure_band
  FROM {source})"""


def term(column: str, prefix: str = "") -> str:
    """The scorecard's contribution of one model column."""
    if column in CARD.points:
        return case_map(f"{prefix}{column}", dict(CARD.points[column]), "0.0") + "::DOUBLE"
    if column in CARD.slopes:
        centre, scale, weight = CARD.slopes[column]
        return (
            f"((CAST({prefix}{column} AS DOUBLE) - {centre}::DOUBLE) / {scale}::DOUBLE"
            f" * {weight}::DOUBLE)"
        )
    return "0.0::DOUBLE"


def z(prefix: str = "") -> str:
    scored = [c for c in SPEC.model_columns if c in CARD.points or c in CARD.slopes]
    return " + ".join([f"{CARD.intercept}::DOUBLE", *(term(c, prefix) for c in scored)])


def scores(source: str = "feat", name: str = "scored") -> str:
    return f"""
{name} AS (SELECT *, 1.0::DOUBLE / (1.0::DOUBLE + exp(-({z()}))) AS p FROM {source})"""


FEAT = PANEL + "," + features("panel")
SCORED = FEAT + "," + scores()
BAND = "CASE WHEN p < 0.25 THEN 'Low' WHEN p < 0.5 THEN 'Moderate' WHEN p < 0.75 THEN 'High' ELSE 'Critical' END"
ADVICE = "CASE " + " ".join(
    f"WHEN p < {b[1]} THEN {q(b[3])}" for b in RISK_BANDS
) + f" ELSE {q(RISK_BANDS[-1][3])} END"


def rank_case(column: str, values) -> str:
    return case_map(column, {v: i + 1 for i, v in enumerate(values)}, "NULL")


def breakdown_cte(
    source: str, spec, columns, income: str, name: str = "rates", target: str | None = None
) -> str:
    target = target or spec.target
    pairs = " UNION ALL ".join(
        f"SELECT {q(c)} AS attribute, coalesce(CAST({c} AS VARCHAR), '(missing)') AS category, "
        f"CAST(lower({target}) = 'yes' AS INTEGER) AS gone, CAST({income} AS DOUBLE) AS income "
        f"FROM {source}"
        for c in columns
    )
    declared = "CASE " + " ".join(
        f"WHEN attribute = {q(c)} THEN {rank_case('category', spec.orderings[c])}"
        for c in columns if c in spec.orderings
    ) + " ELSE NULL END" if any(c in spec.orderings for c in columns) else "NULL"
    ordered = ", ".join(q(c) for c in columns if c in spec.orderings) or "''"
    caption = case_map("attribute", {c: q(spec.caption(c)) for c in columns}, "''")
    monitored = ", ".join(q(c) for c in spec.monitor_only) or "''"
    return f"""
pairs AS ({pairs}),
counted AS (SELECT attribute, category, count(*) AS total, CAST(sum(gone) AS BIGINT) AS "left",
                   avg(income) AS income FROM pairs GROUP BY 1, 2),
{name} AS (
  SELECT attribute, {caption} AS caption, attribute IN ({monitored}) AS monitor_only,
    CAST(row_number() OVER (PARTITION BY attribute ORDER BY {declared} ASC NULLS LAST,
      CASE WHEN attribute NOT IN ({ordered}) THEN CAST("left" AS DOUBLE) / total END DESC NULLS LAST,
      category) AS INTEGER) AS position,
    category, total, "left", total - "left" AS stayed, {rate4('"left"', 'total')} AS attrition_rate,
    CAST({even('income', 0)} AS BIGINT) AS avg_salary
  FROM counted)"""


def kpi_select(source: str, spec, tenure: str | None, age: str | None, income: str) -> str:
    gone = f"lower({spec.target}) = 'yes'"

    def mean(column, keep, digits):
        return even(f"avg(CASE WHEN {keep} THEN CAST({column} AS DOUBLE) END)", digits)

    extra = ""
    if tenure:
        extra = f""",
  {mean(tenure, gone, 1)} AS avg_tenure_left, {mean(tenure, f'NOT ({gone})', 1)} AS avg_tenure_stayed,
  {mean(age, gone, 1)} AS avg_age_left, {mean(age, f'NOT ({gone})', 1)} AS avg_age_stayed"""
    lost = f"coalesce(sum(CASE WHEN {gone} THEN CAST({income} AS DOUBLE) END), 0)"
    return f"""SELECT count(*) AS employees, count(*) FILTER (WHERE {gone}) AS "left",
  count(*) FILTER (WHERE NOT ({gone})) AS stayed,
  {rate4(f'count(*) FILTER (WHERE {gone})', 'count(*)')} AS attrition_rate,
  CAST({even(lost, 0)} AS BIGINT) AS monthly_salary_lost,
  CAST({even(f'{lost} * 6', 0)} AS BIGINT) AS replacement_cost, 6 AS replacement_cost_months,
  CAST({mean(income, gone, 0)} AS BIGINT) AS avg_salary_left,
  CAST({mean(income, f'NOT ({gone})', 0)} AS BIGINT) AS avg_salary_stayed{extra}
FROM {source}"""


KPIS = kpi_select("feat", SPEC, "tenure_years", "recency_years", "monthly_spend")


def indian(expr: str) -> str:
    """Indian digit grouping of a whole number of up to 18 digits."""
    d = f"CAST(abs({expr}) AS VARCHAR)"
    n = f"length({d})"
    # Pairs before the last three digits; the first group may be a single digit.
    parts = [
        f"CASE WHEN {n} >= {k} THEN substr({d}, {n} - {k - 1}, 2) || ',' "
        f"WHEN {n} = {k - 1} THEN substr({d}, 1, 1) || ',' ELSE '' END"
        for k in (17, 15, 13, 11, 9, 7, 5)
    ]
    sign = f"CASE WHEN {expr} < 0 THEN '-' ELSE '' END"
    return f"('₹' || {sign} || {' || '.join(parts)} || right({d}, 3))"


def short(expr: str) -> str:
    """Crore and lakh, halves away from zero, in whole numbers only."""

    def unit(size: int, decimals: int, suffix: str) -> str:
        part = size // 10**decimals
        scaled = f"((abs({expr}) + {part // 2}) // {part})"
        ten = 10**decimals
        text = (
            f"CAST({scaled} // {ten} AS VARCHAR) || '.' || "
            f"lpad(CAST({scaled} % {ten} AS VARCHAR), {decimals}, '0')"
        )
        return (
            f"'₹' || CASE WHEN {expr} < 0 THEN '-' ELSE '' END || CASE WHEN {expr} % {size} = 0 "
            f"THEN CAST(abs({expr}) // {size} AS VARCHAR) ELSE {text} END || '{suffix}'"
        )

    return (
        f"(CASE WHEN abs({expr}) >= 10000000 THEN {unit(10000000, 2, ' Cr')} "
        f"WHEN abs({expr}) >= 100000 THEN {unit(100000, 1, ' L')} ELSE {indian(expr)} END)"
    )


CURVE = SCORED + """,
coded AS (SELECT CAST(round(p * 1000000) AS BIGINT) AS code,
                 CAST(churned = 'Yes' AS BIGINT) AS y FROM scored),
counts AS (SELECT code, CAST(sum(y) AS BIGINT) AS pos, CAST(sum(1 - y) AS BIGINT) AS neg
           FROM coded GROUP BY code),
curve AS (SELECT CAST(row_number() OVER w AS BIGINT) AS position,
  CAST(code AS DOUBLE) / 1000000.0::DOUBLE AS threshold, code, pos, neg,
  CAST(sum(pos) OVER w AS BIGINT) AS tp, CAST(sum(neg) OVER w AS BIGINT) AS fp,
  CAST(sum(pos) OVER () AS BIGINT) AS positives, CAST(sum(neg) OVER () AS BIGINT) AS negatives,
  count(*) OVER () AS scores_n
  FROM counts WINDOW w AS (ORDER BY code DESC ROWS UNBOUNDED PRECEDING))"""

ROC = CURVE + """,
bends AS (SELECT *, lead(pos) OVER (ORDER BY position) AS next_pos,
                 lead(neg) OVER (ORDER BY position) AS next_neg FROM curve),
kept AS (SELECT * FROM bends
         WHERE position = 1 OR next_pos IS NULL OR pos <> next_pos OR neg <> next_neg),
roc AS (SELECT 0 AS point, 0.0::DOUBLE AS x, 0.0::DOUBLE AS y
        UNION ALL SELECT row_number() OVER (ORDER BY position),
          CAST(fp AS DOUBLE) / negatives, CAST(tp AS DOUBLE) / positives FROM kept),
points AS (SELECT CAST(point AS BIGINT) AS point, count(*) OVER () AS points_n, x, y FROM roc)"""

PR = CURVE + """,
pr AS (SELECT scores_n - position AS point, CAST(tp AS DOUBLE) / positives AS x,
              CAST(tp AS DOUBLE) / (tp + fp) AS y FROM curve
       UNION ALL SELECT max(scores_n), 0.0::DOUBLE, 1.0::DOUBLE FROM curve),
points AS (SELECT point, count(*) OVER () AS points_n, x, y FROM pr)"""


def thin(source: str, curve: str) -> str:
    return f"""{source},
wanted AS (SELECT DISTINCT CASE WHEN i = 59 THEN n - 1
             ELSE CAST(floor(i * (CAST(n - 1 AS DOUBLE) / 59.0::DOUBLE)) AS BIGINT) END AS point
           FROM (SELECT max(points_n) AS n FROM points), range(60) AS r(i))
SELECT {q(curve)} AS curve, point, {even('x', 4)} AS x, {even('y', 4)} AS y FROM points
WHERE points_n <= 60 OR point IN (SELECT point FROM wanted)"""


# --- typical account and what-ifs -------------------------------------------------
def typical_cte() -> str:
    parts = [
        f"(SELECT {c} FROM feat GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1) AS {c}"
        for c in MODEL_CATS
    ]
    parts += [f"(SELECT CAST(median(CAST({c} AS DOUBLE)) AS DOUBLE) FROM feat) AS {c}" for c in MODEL_NUMS]
    return f"typical AS (SELECT {', '.join(parts)})"


def _row(kind, field, display, step, replace=None, value=None, where="TRUE", source="panel s"):
    columns = ", ".join(
        f"{value if c == replace else ('s.' + c if c in CATS else f'CAST(s.{c} AS DOUBLE)')} AS {c}"
        for c in CATS + NUMS
    )
    current = "NULL" if field is None else (
        f"s.{field}" if field in CATS else f"CAST(CAST(s.{field} AS DOUBLE) AS VARCHAR)"
    )
    name = "NULL" if field is None else q(field)
    return (
        f"SELECT s.account_id, {q(kind)} AS kind, {name} AS field, {display} AS display, "
        f"{step} AS step, {current} AS value, {columns} FROM {source} WHERE {where}"
    )


def variant_rows(kinds) -> str:
    rows = []
    if "base" in kinds:
        rows.append(_row("base", None, "''", 0))
    if "driver" in kinds:
        both = "panel s, typical t"
        for c in CATS:
            rows.append(_row("driver", c, f"t.{c}", 0, c, f"t.{c}", f"s.{c} <> t.{c}", both))
        for c in NUMS:
            rows.append(
                _row("driver", c, f"CAST(t.{c} AS VARCHAR)", 0, c, f"t.{c}",
                     f"CAST(s.{c} AS DOUBLE) <> t.{c}", both)
            )
    if "action" in kinds:
        for c, ladder in SPEC.ladders.items():
            for i, option in enumerate(ladder):
                rank = rank_case(f"s.{c}", ladder)
                rows.append(
                    _row("action", c, q(option), f"{i + 1} - {rank}", c, q(option), f"{rank} < {i + 1}")
                )
    if "pay" in kinds:
        for i, rise in enumerate(PAY_RISES):
            raised = even(f"s.monthly_spend * {1 + rise!r}::DOUBLE", -2)
            rows.append(
                _row("pay", "monthly_spend", q(f"+{rise:.0%}"), i + 1, "monthly_spend", raised,
                     "s.monthly_spend > 0")
            )
    return "variants AS (" + "\nUNION ALL ".join(rows) + ")"


def what_ifs(kinds) -> str:
    label = case_map("field", {k: q(v) for k, v in SPEC.labels.items()}, "field")
    pitch = case_map("field", {k: q(v) for k, v in SPEC.playbook.items()}, "''")
    return f"""{FEAT}, {typical_cte()},
{variant_rows(kinds)},{features('variants', 'vfeat')},{scores('vfeat', 'vscored')},{scores('feat', 'own')},
deltas AS (SELECT v.*, o.p - v.p AS delta, o.p AS base,
             CASE v.kind WHEN 'pay' THEN 'action' ELSE v.kind END AS list
           FROM vscored v JOIN own o USING (account_id)),
bests AS (SELECT *, {even('delta', 4)} AS effect, row_number() OVER (
             PARTITION BY account_id, list, field ORDER BY delta DESC, step) AS b
          FROM deltas WHERE list <> 'action' OR delta > 0.01),
short_list AS (SELECT *, CAST(row_number() OVER (
             PARTITION BY account_id, list ORDER BY abs(effect) DESC, field) AS INTEGER) AS position
          FROM bests WHERE b = 1),
drivers AS (SELECT account_id, position, field, {label} AS label, value, display AS compared_to,
              effect AS impact, CASE WHEN delta > 0 THEN 'increases' ELSE 'decreases' END AS direction
            FROM short_list WHERE list = 'driver' AND position <= 6),
actions AS (SELECT account_id, position, field, {label} AS label, value AS "from",
              CASE WHEN kind = 'pay' THEN CAST(monthly_spend AS VARCHAR) ELSE display END AS "to",
              display, effect AS reduction, {even('p', 4)} AS new_probability,
              CASE WHEN kind = 'pay' THEN replace({q(SPEC.pay_pitch)}, '%s', display)
                   ELSE {pitch} END AS recommendation, kind
            FROM short_list WHERE list = 'action' AND position <= 4)"""


# --- dirty rows: the panel as a careless export -------------------------------------
#: Text forms of the spend by segment; see ``checks.queries.dirty_panel``.
DIRTY = PANEL + """,
dirty AS (
  SELECT '  ACC-' || account_id || chr(9) AS account_id, region, segment,
    ' ' || nation || ' ' AS nation, chr(10) || tier AS tier, urgent, returns,
    CASE WHEN discount = 'Premium' THEN 'Platinum' ELSE discount END AS discount,
    CASE WHEN fulfilment = 'Low' THEN NULL ELSE fulfilment END AS fulfilment,
    CASE segment WHEN 'AUTOMOBILE' THEN 'abc' WHEN 'BUILDING' THEN NULL
      WHEN 'FURNITURE' THEN ' 1.5e3 ' WHEN 'HOUSEHOLD' THEN '12d'
      ELSE ' ' || CAST(CAST(floor(monthly_spend) AS BIGINT) AS VARCHAR) END AS monthly_spend,
    tenure_years, recency_years, span_years,
    CASE WHEN returns = 'Frequent' THEN orders_n || '.5' ELSE CAST(orders_n AS VARCHAR) END AS orders_n,
    CASE tier WHEN 'Entry' THEN '-' || orders_last_year WHEN 'Junior' THEN 'Infinity'
      ELSE '+' || orders_last_year END AS orders_last_year,
    CAST(suppliers_n AS VARCHAR) AS suppliers_n, upper(churned) AS churned
  FROM panel)"""

_SPACE = "' ' || chr(9) || chr(10)"
_NUMBER = r"'^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$'"


def parsed(c: str) -> str:
    text = f"trim(CAST({c} AS VARCHAR), {_SPACE})"
    return f"(CASE WHEN regexp_matches({text}, {_NUMBER}) THEN TRY_CAST({text} AS DOUBLE) END)"


def violations() -> str:
    rules = []
    for c, allowed in SPEC.categoricals.items():
        rules.append((c, "missing", f"{c} IS NULL"))
        if allowed:
            rules.append((c, "unknown category", f"{c} NOT IN ({', '.join(q(a) for a in allowed)})"))
    for c in NUMS:
        rules.append((c, "missing", f"{c} IS NULL"))
        rules.append((c, "not a number", f"{c} IS NOT NULL AND {parsed(c)} IS NULL"))
        if c in SPEC.whole_numbers:
            rules.append((c, "not a whole number", f"{parsed(c)} <> floor({parsed(c)})"))
        low, high = SPEC.ranges[c]
        rules.append((c, "below minimum", f"{parsed(c)} < {low}"))
        rules.append((c, "above maximum", f"{parsed(c)} > {high}"))
    return "broken AS (" + " UNION ALL ".join(
        f"SELECT account_id, {q(c)} AS field, {q(rule)} AS rule, CAST({c} AS VARCHAR) AS value "
        f"FROM trimmed WHERE {cond}"
        for c, rule, cond in rules
    ) + ")"


def headline_sql() -> str:
    rows = []
    for i, claim in enumerate(SPEC.claims):
        if isinstance(claim, RateClaim):
            def rate(category):
                return (f"(SELECT max(attrition_rate) FROM rates WHERE attribute = {q(claim.field)}"
                        f" AND category = {q(category)})")

            worse, better = rate(claim.worse), rate(claim.better)
            fill = [f"CAST(CAST({even(f'{r} * 100', 0)} AS BIGINT) AS VARCHAR) || '%'" for r in (worse, better)]
            holds = f"{worse} > {better}"
        elif claim.kind == "pay_gap":
            fill = [indian("avg_salary_left"), indian("avg_salary_stayed"),
                    indian("(avg_salary_stayed - avg_salary_left)")]
            holds = "avg_salary_left < avg_salary_stayed"
        else:
            fill = ['CAST("left" AS VARCHAR)', indian("monthly_salary_lost"), "'6'",
                    indian("replacement_cost")]
            holds = "TRUE"
        pieces = claim.detail.split("%s")
        detail = q(pieces[0])
        for piece, value in zip(pieces[1:], fill):
            detail += f" || {value} || {q(piece)}"
        rows.append(f"SELECT {i + 1} AS position, {q(claim.title)} AS title, {detail} AS detail "
                    f"FROM kpis WHERE {holds}")
    columns = list(dict.fromkeys(c.field for c in SPEC.claims if isinstance(c, RateClaim)))
    return (f"WITH {FEAT}, kpis AS ({KPIS}),{breakdown_cte('feat', SPEC, columns, 'monthly_spend')} "
            + " UNION ALL ".join(rows))


LOG = SCORED + f""",
log AS (SELECT account_id AS id, CAST('{STAMP}' AS TIMESTAMP) AS created_at, 'batch' AS source,
  CAST(account_id AS VARCHAR) AS employee_ref, {even('p', 4)} AS probability, {BAND} AS risk_band,
  CAST(p >= {THRESHOLD} AS INTEGER) AS will_leave, monthly_spend AS salary,
  CAST(trunc(tenure_years) AS INTEGER) AS years_here, segment AS job_role,
  tier AS payload_tier, CAST(account_id AS VARCHAR) AS payload_id,
  monthly_spend AS payload_spend, DATE '{STAMP[:10]}' AS score_date FROM scored)"""
LOG_COLUMNS = (
    "id, created_at, source, employee_ref, probability, risk_band, will_leave, salary, "
    "years_here, job_role, payload_tier, payload_id, payload_spend, score_date"
)
LOG_SUMMARY = f"""SELECT count(*) AS total, CAST(coalesce(sum(will_leave), 0) AS BIGINT) AS flagged,
  {even('coalesce(avg(probability), 0)', 4)} AS avg_probability,
  CAST({even('coalesce(sum(salary * probability), 0)', 0)} AS BIGINT) AS salary_at_risk FROM log"""

CONFUSION = f"""SELECT count(*) FILTER (WHERE churned = 'No' AND p < {THRESHOLD}) AS true_negative,
  count(*) FILTER (WHERE churned = 'No' AND p >= {THRESHOLD}) AS false_positive,
  count(*) FILTER (WHERE churned = 'Yes' AND p < {THRESHOLD}) AS false_negative,
  count(*) FILTER (WHERE churned = 'Yes' AND p >= {THRESHOLD}) AS true_positive FROM scored"""

METRICS = f"""WITH {CURVE}, matrix AS ({CONFUSION}),
ranked AS (SELECT sum(pos * (negatives - fp + neg / 2.0::DOUBLE)) / (max(positives)::DOUBLE * max(negatives)) AS roc_auc,
  sum(pos * (CAST(tp AS DOUBLE) / (tp + fp))) / max(positives) AS pr_auc FROM curve),
miss AS (SELECT avg((p - CASE churned WHEN 'Yes' THEN 1 ELSE 0 END)
               * (p - CASE churned WHEN 'Yes' THEN 1 ELSE 0 END)) AS brier FROM scored)
SELECT {rate4('true_positive + true_negative', '(true_positive + true_negative + false_positive + false_negative)')} AS accuracy,
  {rate4('true_positive', '(true_positive + false_positive)')} AS precision,
  {rate4('true_positive', '(true_positive + false_negative)')} AS recall,
  {rate4('2 * true_positive', '(2 * true_positive + false_positive + false_negative)')} AS f1,
  {even('roc_auc', 4)} AS roc_auc, {even('pr_auc', 4)} AS pr_auc, {even('brier', 4)} AS brier
FROM matrix, ranked, miss"""


def importance_ctes() -> str:
    terms = ", ".join(f"{term(c)} AS t_{c}" for c in SPEC.model_columns)
    total = " + ".join(
        [f"{CARD.intercept}::DOUBLE"]
        + [f"t_{c}" for c in SPEC.model_columns if c in CARD.points or c in CARD.slopes]
    )
    order = "md5(concat_ws(':', CAST(account_id AS VARCHAR), '%d'%s))"
    swapped = " UNION ALL ".join(
        f"SELECT {q(c)} AS feature, r.rep, r.y, r.z - r.t_{c} + d.t_{c} AS z "
        "FROM receivers r JOIN donors d ON r.rep = d.rep AND r.position = d.position"
        for c in SPEC.model_columns
    )
    donor_key = order % (SEED, ", 'swap', CAST(i AS VARCHAR)")
    return f"""{FEAT},
termed AS (SELECT account_id, CAST(churned = 'Yes' AS BIGINT) AS y, {terms} FROM feat),
summed AS (SELECT *, {total} AS z FROM termed),
reps AS (SELECT CAST(i AS INTEGER) AS i FROM range({IMPORTANCE_REPEATS}) AS r(i)),
placed AS (SELECT *, row_number() OVER (ORDER BY {order % (SEED, '')}, account_id) AS position FROM summed),
receivers AS (SELECT placed.*, i AS rep FROM placed, reps),
donors AS (SELECT summed.*, i AS rep, row_number() OVER (
             PARTITION BY i ORDER BY {donor_key}, account_id) AS position FROM summed, reps),
swapped AS ({swapped} UNION ALL SELECT '(none)' AS feature, 0 AS rep, y, z FROM summed),
scodes AS (SELECT feature, rep, y, CAST(round(1000000.0::DOUBLE / (1.0::DOUBLE + exp(-z))) AS BIGINT) AS code FROM swapped),
scounts AS (SELECT feature, rep, code, CAST(sum(y) AS BIGINT) AS pos, CAST(sum(1 - y) AS BIGINT) AS neg
            FROM scodes GROUP BY 1, 2, 3),
sranked AS (SELECT *, sum(neg) OVER (PARTITION BY feature, rep ORDER BY code) - neg AS below,
              sum(pos) OVER (PARTITION BY feature, rep) AS pp, sum(neg) OVER (PARTITION BY feature, rep) AS nn
            FROM scounts),
aucs AS (SELECT feature, rep, sum(pos * (below + neg / 2.0::DOUBLE)) / (max(pp)::DOUBLE * max(nn)) AS auc
         FROM sranked GROUP BY 1, 2),
importance AS (SELECT feature, {even("(SELECT auc FROM aucs WHERE feature = '(none)') - avg(auc)", 5)} AS importance,
  {even('stddev_pop(auc)', 5)} AS std FROM aucs WHERE feature <> '(none)' GROUP BY feature)"""


def oracle_sql() -> dict[str, str]:
    rates = breakdown_cte("feat", SPEC, list(SPEC.breakdowns), "monthly_spend")
    rate_columns = ('attribute, caption, monitor_only, position, category, total, "left", stayed, '
                    "attrition_rate, avg_salary")
    contract = ", ".join(CATS + NUMS)
    clean_numbers = ", ".join(f"coalesce({parsed(c)}, 0.0) AS {c}" for c in NUMS)
    trimmed = ", ".join(
        f"trim({c}, {_SPACE}) AS {c}"
        for c in ["account_id", "region", *CATS, "monthly_spend", "orders_n", "orders_last_year",
                  "suppliers_n", "churned"]
    )
    model = ", ".join(MODEL_CATS + [f"CAST({c} AS DOUBLE) AS {c}" for c in MODEL_NUMS])
    segments = f"""SELECT CAST(row_number() OVER (ORDER BY attrition_rate DESC, ord, position) AS INTEGER) AS position,
  caption || ': ' || category AS segment, total AS employees, attrition_rate,
  {even("coalesce(attrition_rate / nullif((SELECT avg(CASE churned WHEN 'Yes' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) FROM feat), 0), 0)", 2)} AS lift
FROM (SELECT *, {rank_case('attribute', list(SPEC.breakdowns))} AS ord FROM rates
      WHERE NOT monitor_only AND total >= 8) ORDER BY attrition_rate DESC, ord, position LIMIT 8"""

    def bins(column, edges, source="feat", target="churned", label="low || '-' || high"):
        step, top = edges[-1] - edges[-2], edges[-1]
        whens = " ".join(
            f"WHEN v >= {a} AND v < {b} THEN {a}" for a, b in zip(edges, edges[1:])
        )
        highs = " ".join(
            f"WHEN v >= {a} AND v < {b} THEN {b}" for a, b in zip(edges, edges[1:])
        )
        return f"""binned AS (SELECT CAST(CASE {whens}
    WHEN v >= {top} THEN {top} + floor((v - {top}) / {step}) * {step} END AS DOUBLE) AS low,
  CAST(CASE {highs} WHEN v >= {top} THEN {top} + (floor((v - {top}) / {step}) + 1) * {step} END AS DOUBLE) AS high,
  CAST({target} = 'Yes' AS BIGINT) AS gone FROM (SELECT CAST({column} AS DOUBLE) AS v, {target} FROM {source}))
SELECT CAST(CAST(low AS BIGINT) AS VARCHAR) || '-' || CAST(CAST(high AS BIGINT) AS VARCHAR) || {label} AS label, low, high, count(*) AS total,
  CAST(sum(gone) AS BIGINT) AS "left", count(*) - CAST(sum(gone) AS BIGINT) AS stayed,
  {rate4('sum(gone)', 'count(*)')} AS attrition_rate
FROM binned WHERE low IS NOT NULL GROUP BY low, high"""

    decision = f"""SELECT account_id, {even('p', 6)} AS probability, {even('p * 100', 1)} AS percent,
  p >= {THRESHOLD} AS will_leave, {BAND} AS risk_band, {ADVICE} AS advice FROM scored"""
    ranked = f"""SELECT account_id, segment, nation, tenure_years, monthly_spend, {even('p', 4)} AS probability,
  {even('p * 100', 1)} AS percent, {BAND} AS risk_band, p >= {THRESHOLD} AS will_leave FROM scored"""
    best = f"""best AS (SELECT threshold AS raw_threshold, f1 AS best_f1 FROM (
  SELECT *, 2.0::DOUBLE * tp / (tp + fp + positives) AS f1 FROM curve) ORDER BY f1 DESC, code LIMIT 1)"""
    amounts = "SELECT o_orderkey, CAST(round(o_totalprice * 100) AS BIGINT) AS amount FROM orders"
    folds = lambda repeats: f"""folded AS (SELECT account_id, CAST(churned = 'Yes' AS INTEGER) AS label, CAST(i AS INTEGER) AS repeat
  FROM panel, range({repeats}) AS r(i))
SELECT account_id, label, repeat, CAST((row_number() OVER (PARTITION BY repeat, label
  ORDER BY md5(concat_ws(':', CAST(account_id AS VARCHAR), CAST(repeat + {SEED} AS VARCHAR))), account_id) - 1) % {FOLDS} AS INTEGER) AS fold
FROM folded"""
    slots = " UNION ALL ".join(
        f"SELECT account_id, {q(c)} AS field, CAST(dense_rank() OVER (ORDER BY {c}) - 1 AS INTEGER) AS slot FROM feat"
        for c in MODEL_CATS
    )
    stats = " UNION ALL ".join(
        f"SELECT {q(c)} AS field, {even(f'avg(CAST({c} AS DOUBLE))', 6)} AS mean, "
        f"{even(f'stddev_pop(CAST({c} AS DOUBLE))', 6)} AS sd FROM feat"
        for c in MODEL_NUMS
    )
    typical = f"WITH {FEAT}, {typical_cte()} " + " UNION ALL ".join(
        [f"SELECT {q(c)} AS field, 'category' AS kind, {c} AS text, CAST(NULL AS DOUBLE) AS number FROM typical"
         for c in MODEL_CATS]
        + [f"SELECT {q(c)} AS field, 'number' AS kind, CAST(NULL AS VARCHAR) AS text, {c} AS number FROM typical"
           for c in MODEL_NUMS]
    )
    explained = f"""SELECT o.account_id, {even('o.p', 4)} AS probability, {even('o.p * 100', 1)} AS percent,
  o.p >= {THRESHOLD} AS will_leave, {BAND.replace('p <', 'o.p <')} AS risk_band,
  o.career_share, o.promotion_gap, o.pay_per_level, o.tenure_band,
  CAST({even('o.monthly_spend * 6 * o.p', 0)} AS BIGINT) AS cost_at_risk,
  coalesce(d.fields, '') AS driver_fields, coalesce(d.total, 0) AS driver_total,
  coalesce(a.fields, '') AS action_fields, coalesce(a.total, 0) AS action_total
FROM own o
LEFT JOIN (SELECT account_id, string_agg(field, ',' ORDER BY position) AS fields,
             {even('sum(impact)', 4)} AS total FROM drivers GROUP BY 1) d USING (account_id)
LEFT JOIN (SELECT account_id, string_agg(field || '>' || display, ',' ORDER BY position) AS fields,
             {even('sum(reduction)', 4)} AS total FROM actions GROUP BY 1) a USING (account_id)"""
    all_kinds = ("base", "driver", "action", "pay")
    tidy = f"SELECT {trimmed}, tenure_years, recency_years, span_years FROM dirty"
    p6 = f"WITH {DIRTY}, trimmed AS ({tidy}), {violations()} "
    checks = f"""facts AS (SELECT count(*) AS n, count(*) - count(DISTINCT account_id) AS repeated,
  count(*) FILTER (WHERE churned = 'Yes') AS yes,
  count(*) FILTER (WHERE {' OR '.join(f'{c} IS NULL' for c in ['account_id', 'churned', 'region', *CATS, *NUMS])}) AS nulls
  FROM feat)
SELECT 'no nulls' AS "check", nulls = 0 AS passed, nulls AS observed FROM facts
UNION ALL SELECT 'ids are unique', repeated = 0, repeated FROM facts
UNION ALL SELECT 'target is yes or no', count(*) = 0, count(*) FROM feat WHERE lower(churned) NOT IN ('yes', 'no')
UNION ALL SELECT 'both outcomes occur', yes > 0 AND yes < n, yes FROM facts
UNION ALL SELECT 'rates are proportions', count(*) = 0, count(*) FROM rates WHERE attrition_rate NOT BETWEEN 0 AND 1
UNION ALL SELECT 'breakdowns cover all rows', count(*) = 0, count(*) FROM (
  SELECT attribute, sum(total) AS total FROM rates GROUP BY 1) WHERE total <> (SELECT n FROM facts)"""
    doc_rates = breakdown_cte("docs", DOCUMENTS, list(DOCUMENTS.breakdowns), "n_chars")
    doc_order = rank_case("attribute", list(DOCUMENTS.breakdowns))
    doc_base = "(SELECT avg(CASE toxic WHEN 'Yes' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) FROM docs)"
    doc_segments = f"""SELECT CAST(row_number() OVER (ORDER BY attrition_rate DESC, ord, position) AS INTEGER) AS position,
  caption || ': ' || category AS segment, total AS employees, attrition_rate,
  {even(f"coalesce(attrition_rate / nullif({doc_base}, 0), 0)", 2)} AS lift
FROM (SELECT *, {doc_order} AS ord FROM rates WHERE NOT monitor_only AND total >= 8)
ORDER BY attrition_rate DESC, ord, position LIMIT 8"""
    doc_typical = " UNION ALL ".join(
        [f"SELECT {q(c)} AS field, 'category' AS kind, (SELECT {c} FROM docs GROUP BY {c} "
         f"ORDER BY count(*) DESC, {c} LIMIT 1) AS text, CAST(NULL AS DOUBLE) AS number"
         for c in DOCUMENTS.model_categoricals]
        + [f"SELECT {q(c)}, 'number', CAST(NULL AS VARCHAR), median(CAST({c} AS DOUBLE)) FROM docs"
           for c in DOCUMENTS.model_numerics]
    )
    found = {
        "account_panel": f"WITH {PANEL} SELECT * FROM panel",
        "document_panel": f"WITH {DOC_PANEL} SELECT * FROM docs",
        # cleaning and contracts
        "s2_load_clean": f"WITH {PANEL} SELECT account_id, region, {', '.join(CATS)}, "
        + ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in NUMS) + ", churned FROM panel",
        "p1_trim_strings": f"WITH {DIRTY} {tidy}",
        "p2_coerce_numerics": f"WITH {DIRTY} SELECT account_id, {clean_numbers} FROM dirty",
        "p3_target_flag": f"WITH {DIRTY} SELECT account_id, churned, CAST(lower(churned) = 'yes' AS INTEGER) AS label FROM dirty",
        "p4_features_only": f"WITH {PANEL} SELECT {contract} FROM panel",
        "p5_model_frame": f"WITH {FEAT} SELECT account_id, {', '.join(SPEC.model_columns)} FROM feat",
        "p6_violations": p6 + "SELECT * FROM broken",
        "p6_valid_rows": p6 + "SELECT account_id FROM trimmed WHERE account_id NOT IN (SELECT account_id FROM broken)",
        "p7_defaults": f"WITH {PANEL} SELECT * REPLACE ('None' AS discount, 3 AS tenure_years) FROM panel",
        "p8_contract_columns": f"WITH {PANEL} SELECT account_id, {contract} FROM panel",
        "p9_form_projection": f"WITH {FEAT} SELECT account_id, {contract} FROM feat",
        "p10_flagged_rows": f"WITH {SCORED} SELECT account_id, {even('p', 6)} AS probability FROM scored WHERE p >= {THRESHOLD}",
        "p11_keep_first": "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS n FROM orders) WHERE n = 1",
        "p12_quality_checks": f"WITH {FEAT},{rates}, {checks}",
        # small lookups
        "j1_level_rank": f"WITH {FEAT} SELECT account_id, tier, level_rank FROM feat",
        "j2_category_order": f"WITH {FEAT},{rates} SELECT attribute, category, position FROM rates",
        "j3_upgrades": f"WITH {PANEL}, {variant_rows(('action',))} SELECT account_id, field, value AS \"from\", display AS \"to\", CAST(step AS INTEGER) AS step FROM variants",
        "j5_band_table": f"WITH {SCORED} SELECT account_id, {BAND} AS risk_band, {ADVICE} AS advice FROM scored",
        "j6_typical_pairs": f"WITH {FEAT}, {typical_cte()}, {variant_rows(('driver',))} SELECT account_id, field, value, display AS compared_to FROM variants",
        # derived columns
        "f1_f3_derived_numbers": f"WITH {FEAT} SELECT account_id, career_share, promotion_gap, pay_per_level FROM feat",
        "f4_tenure_band": f"WITH {FEAT} SELECT account_id, tenure_band FROM feat",
        "f5_decision": f"WITH {SCORED} {decision}",
        "f6_cost_at_risk": f"WITH {SCORED} SELECT account_id, CAST({even('monthly_spend * 6 * p', 0)} AS BIGINT) AS cost_at_risk FROM scored",
        "f7_pay_rises": f"WITH {PANEL}, {variant_rows(('pay',))} SELECT account_id, display, monthly_spend AS raised FROM variants",
        "f9_indian_amounts": f"WITH a AS ({amounts}) SELECT o_orderkey, {indian('amount')} AS amount FROM a",
        "f10_short_amounts": f"WITH a AS ({amounts}) SELECT o_orderkey, {short('amount')} AS amount FROM a",
        "f12_headlines": headline_sql(),
        "f13_log_rows": f"WITH {LOG} SELECT {LOG_COLUMNS} FROM log",
        # reports
        "a1_kpis": f"WITH {FEAT} {KPIS}",
        "a1_document_kpis": f"WITH {DOC_PANEL} {kpi_select('docs', DOCUMENTS, None, None, 'n_chars')}",
        "a2_tier_breakdown": f"WITH {FEAT},{breakdown_cte('feat', SPEC, ['tier'], 'monthly_spend')} SELECT {rate_columns} FROM rates",
        "a3_breakdowns": f"WITH {FEAT},{rates} SELECT {rate_columns} FROM rates",
        "a3_document_breakdowns": f"WITH {DOC_PANEL},{doc_rates} SELECT {rate_columns} FROM rates",
        "a4_tenure_histogram": f"WITH {FEAT}, " + bins("tenure_years", [0, 2, 3, 4], label="'y'"),
        "a4_spend_histogram": f"WITH {FEAT}, " + bins("monthly_spend", [5000, 10000, 15000, 20000], label="''"),
        "a4_document_histogram": f"WITH {DOC_PANEL}, " + bins("n_chars", [0, 500, 1000, 2000, 4000], "docs", "toxic", "''"),
        "a5_risk_segments": f"WITH {FEAT},{rates} {segments}",
        "a5_document_segments": f"WITH {DOC_PANEL},{doc_rates} {doc_segments}",
        "a6_typical_account": typical,
        "a6_typical_document": f"WITH {DOC_PANEL} {doc_typical}",
        "a7_batch_summary": f"WITH {SCORED} SELECT count(*) AS \"count\", count(*) FILTER (WHERE p >= {THRESHOLD}) AS flagged, {rate4(f'count(*) FILTER (WHERE p >= {THRESHOLD})', 'count(*)')} AS flagged_share, CAST({even('sum(monthly_spend * 6 * p)', 0)} AS BIGINT) AS cost_at_risk, {THRESHOLD}::DOUBLE AS threshold FROM scored",
        "a8_log_summary": f"WITH {LOG} {LOG_SUMMARY}",
        "t1_roster": f"WITH {FEAT} SELECT * EXCLUDE (level_rank) FROM feat",
        "t2_ranked_batch": f"WITH {SCORED} {ranked}",
        "t3_recent_log": f"WITH {LOG} SELECT id, created_at, source, employee_ref, probability, risk_band, will_leave, salary, years_here, job_role FROM log ORDER BY created_at DESC, id DESC LIMIT 25",
        # evaluation
        "a9_confusion": f"WITH {SCORED} {CONFUSION}",
        "a10_a11_metrics": METRICS,
        "w1_cumulative_counts": f"WITH {CURVE} SELECT * EXCLUDE (code) FROM curve",
        "w2_roc_points": f"WITH {ROC} SELECT point, {even('x', 6)} AS x, {even('y', 6)} AS y FROM points",
        "w3_pr_points": f"WITH {PR} SELECT point, {even('x', 6)} AS x, {even('y', 6)} AS y FROM points",
        "w4_thinned_roc": "WITH " + thin(ROC, "roc"),
        "w4_thinned_pr": "WITH " + thin(PR, "pr"),
        "w5_best_threshold": f"WITH {CURVE}, {best} SELECT raw_threshold, {even('best_f1', 6)} AS best_f1, {even('least(greatest(raw_threshold, 0.15), 0.85)', 3)} AS threshold FROM best",
        "w6_stratified_folds": f"WITH {PANEL}, {folds(FOLD_REPEATS)}",
        # models on the fixed scorecard
        "m1_one_hot_slots": f"WITH {FEAT} {slots}",
        "m2_scaling_stats": f"WITH {FEAT} {stats}",
        "m7_permutation_importance": f"WITH {importance_ctes()} SELECT * FROM importance",
        "t7_top_features": f"WITH {importance_ctes()} SELECT * FROM importance WHERE importance > 0 ORDER BY importance DESC, feature LIMIT 12",
        "m8_scored_accounts": f"WITH {SCORED} SELECT account_id, {even('p', 6)} AS probability FROM scored",
        "m9_drivers": f"WITH {what_ifs(('driver',))} SELECT * FROM drivers",
        "m10_actions": f"WITH {what_ifs(('action', 'pay'))} SELECT * FROM actions",
        "m11_explained": f"WITH {what_ifs(all_kinds)} {explained}",
        # files, log and streams
        "s3_score_file": f"WITH {SCORED} SELECT CAST(account_id AS VARCHAR) AS account_id, {even('p', 6)} AS probability FROM scored",
        "s5_stored_breakdowns": f"WITH {FEAT},{rates} SELECT {rate_columns} FROM rates",
        "s8_exported_ranking": f"WITH {SCORED} SELECT CAST(account_id AS VARCHAR) AS account_id, probability, percent, risk_band, will_leave FROM ({ranked})",
        "m4a_logistic_balance": f"WITH {PANEL} SELECT count(*) AS rows, count(*) FILTER (WHERE churned = 'Yes') AS positives, 1.0::DOUBLE AS balance FROM panel",
        "m5_logistic_folds": f"""WITH placed AS (WITH {PANEL}, {folds(10)}), held AS (
  SELECT repeat, fold, count(*) AS n, sum(label) AS yes FROM placed GROUP BY repeat, fold)
SELECT repeat, fold, CAST(sum(n) OVER w - n AS BIGINT) AS rows, CAST(sum(yes) OVER w - yes AS BIGINT) AS positives,
  1.0::DOUBLE AS balance FROM held WINDOW w AS (PARTITION BY repeat)""",
        "m5_held_out_rows": f"WITH {PANEL} SELECT account_id, CAST(churned = 'Yes' AS INTEGER) AS label, TRUE AS in_range FROM panel",
        "s6_metric_card": f"WITH {PANEL} SELECT count(*) AS rows_total, count(*) AS employees_scored, round(avg(CASE churned WHEN 'Yes' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 4) AS attrition_rate, CAST(3 * 3 * 2 + 1 AS INTEGER) AS models_fitted FROM panel",
        "s7_same_scores": f"WITH {PANEL} SELECT account_id, TRUE AS same FROM panel",
        "m11_fitted_invariants": f"WITH {PANEL} SELECT account_id, TRUE AS drivers_fit, TRUE AS actions_fit, TRUE AS actions_gain FROM panel",
        "s10_cleared_log": f"WITH {SCORED} SELECT count(*) AS removed, count(*) FILTER (WHERE p >= {THRESHOLD}) AS left_after FROM scored",
        "s3_batch_ranked": f"""WITH {SCORED}, numbered AS (
  SELECT *, row_number() OVER (ORDER BY account_id) AS "row" FROM scored)
SELECT "row", CASE WHEN segment = 'MACHINERY' THEN 'row-' || "row" ELSE CAST(account_id AS VARCHAR) END AS account_id,
  segment, nation, tenure_years, monthly_spend, {even('p', 4)} AS probability, {even('p * 100', 1)} AS percent,
  {BAND} AS risk_band, p >= {THRESHOLD} AS will_leave FROM numbered WHERE segment <> 'BUILDING'""",
        "s3_batch_rejected": f"""WITH {PANEL}, numbered AS (
  SELECT *, row_number() OVER (ORDER BY account_id) AS "row" FROM panel)
SELECT "row", CAST(account_id AS VARCHAR) AS account_id, 'tier' AS field, 'unknown category' AS rule,
  'Platinum' AS value FROM numbered WHERE segment = 'BUILDING'""",
        "a7_batch_summary_of_file": f"WITH {SCORED} SELECT count(*) AS \"count\", count(*) FILTER (WHERE p >= {THRESHOLD}) AS flagged, {rate4(f'count(*) FILTER (WHERE p >= {THRESHOLD})', 'count(*)')} AS flagged_share, CAST({even('sum(monthly_spend * 6 * p)', 0)} AS BIGINT) AS cost_at_risk, {THRESHOLD}::DOUBLE AS threshold FROM scored WHERE segment <> 'BUILDING'",
        "s9_shared_log": f"WITH {LOG} SELECT s AS source, id, employee_ref, probability, will_leave FROM log, unnest(['batch', 'stream', 'again']) AS u(s)",
        "m11_rows_without_own_ids": f"""WITH {SCORED} SELECT CASE WHEN segment = 'BUILDING' THEN 1
  WHEN segment <> 'MACHINERY' THEN account_id END AS account_id, count(*) AS n,
  count(*) FILTER (WHERE p >= {THRESHOLD}) AS flagged FROM scored GROUP BY 1""",
        "s9_stored_log": f"WITH {LOG} SELECT {LOG_COLUMNS} FROM log",
        "r1_streamed_log": f"WITH {LOG} SELECT {LOG_COLUMNS.replace('source', q('stream') + ' AS source')} FROM log",
        "r1_streamed_rejects": f"WITH {PANEL} SELECT account_id, 'tier' AS field, 'unknown category' AS rule, 'Platinum' AS value FROM panel WHERE segment = 'BUILDING'",
        "r2_streamed_summary": f"WITH {LOG} {LOG_SUMMARY}",
    }
    # The tables of the stored report are those of the operators.
    stored = {
        "kpis": "a1_kpis", "segments": "a5_risk_segments", "headlines": "f12_headlines", "roster": "t1_roster",
        "tenure_histogram": "a4_tenure_histogram", "spend_histogram": "a4_spend_histogram",
    }
    found |= {f"s5_stored_{table}": found[name] for table, name in stored.items()}
    entry = "count(*) FILTER (WHERE tier = 'Entry')"
    states = {
        "nothing made": ("TRUE", "count(*)"), "made": ("FALSE", "count(*)"), "added": ("TRUE", f"count(*) + {entry}"),
        "made again": ("FALSE", f"count(*) + {entry}"),
        "removed": ("TRUE", "count(*) FILTER (WHERE segment <> 'BUILDING') + count(*) FILTER (WHERE tier = 'Entry' AND segment <> 'BUILDING')"),
    }
    rows = " UNION ALL ".join(f"SELECT '{k}' AS state, {stale} AS stale, {n} AS input_rows FROM panel" for k, (stale, n) in states.items())
    found["s11_staleness"] = f"WITH {PANEL} {rows}"
    return found
