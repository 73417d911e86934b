"""Usage queries and their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from pultwerk import fixed_values as fv
from pultwerk.operators import usage
from pultwerk.plans.registry import query, values
from pultwerk.sources import usage_files
from pultwerk.sources.tables import view, view_sql

_DIMS = ", ".join([
    values("price_list", "provider, model, input_price, output_price", [(p, m, float(a), float(b)) for p, m, a, b in fv.PRICES]),
    values("seqs", "provider, seq", [("anthropic", 0), ("openrouter", 1), ("openai", 2), ("google", 3)]),
    values("aliases", "asked, provider, model", fv.MODEL_ALIASES),
])


def r6(amount: str) -> str:
    """Half-up to six places, spelled out: rounding of wide decimals is not half-up everywhere."""
    return f"CAST(floor(CAST({amount} AS DECIMAL(30,8)) * CAST(1000000 AS DECIMAL(7,0)) + 0.5) AS DOUBLE) / 1000000"


def priced_sql(source: str) -> str:
    return f"""WITH {view_sql(source)}, {_DIMS}, resolved AS (
  SELECT u.*,
    COALESCE(pa.provider, ph.provider, pf.provider, 'anthropic') AS resolved_provider,
    COALESCE(pa.model, ph.model, pf.model, 'claude-3-5-sonnet-20241022') AS resolved_model,
    CAST(COALESCE(pa.input_price, ph.input_price, pf.input_price, 3.00) AS DECIMAL(10,2)) AS input_price,
    CAST(COALESCE(pa.output_price, ph.output_price, pf.output_price, 15.00) AS DECIMAL(10,2)) AS output_price,
    COALESCE(pa.model, ph.model, pf.model) IS NULL AS price_fallback
  FROM {source} u
  LEFT JOIN aliases a ON u.model = a.asked
  LEFT JOIN price_list pa ON pa.provider = a.provider AND pa.model = a.model
  LEFT JOIN price_list ph ON ph.provider = u.provider AND ph.model = u.model
  LEFT JOIN (SELECT p.* FROM price_list p JOIN seqs s USING (provider)
             QUALIFY row_number() OVER (PARTITION BY model ORDER BY seq) = 1) pf ON pf.model = u.model),
priced AS (SELECT *, input_tokens + output_tokens AS total_tokens,
    CAST(input_tokens AS DECIMAL(18,0)) * input_price * 0.000001::DECIMAL(7,6) AS input_cost,
    CAST(output_tokens AS DECIMAL(18,0)) * output_price * 0.000001::DECIMAL(7,6) AS output_cost,
    input_cost + output_cost AS cost,
    strftime(ts, '%Y-%m-%d') AS day, strftime(ts, '%Y-%m') AS month,
    regexp_replace(trim(lower(skill_name)), '[/\\\\]', '_', 'g') AS norm_skill,
    norm_skill || '_' || substring(md5(norm_skill), 1, 8) AS skill_id
  FROM resolved)
"""


_SUMS = f"""CAST(sum(total_tokens) AS BIGINT) AS total_tokens, CAST(sum(input_tokens) AS BIGINT) AS input_tokens,
 CAST(sum(output_tokens) AS BIGINT) AS output_tokens, {r6('sum(cost)')} AS cost_usd"""
_EV, _HI = priced_sql("usage_events"), priced_sql("usage_history")


def _priced(spark, sf, source="usage_events"):
    return usage.with_cost(view(spark, sf, source))


@query("src_01_usage_events", f"WITH {view_sql('usage_events')} SELECT CAST(request_id AS VARCHAR) AS request_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, user_id, model, provider, input_tokens, output_tokens, skill_name FROM usage_events")
def _(spark, sf):
    """Events written out as JSON lines text and read back through the event schema."""
    lines = view(spark, sf, "usage_events").select(F.to_json(F.struct(
        F.col("request_id").cast("string").alias("request_id"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("ts"),
        "user_id", "model", "provider", "input_tokens", "output_tokens", "skill_name")).alias("value"))
    raw = lines.select(F.from_json("value", usage_files.EVENT_SCHEMA, {"columnNameOfCorruptRecord": "_corrupt"}).alias("e")).select("e.*")
    return usage_files._typed(raw).withColumn("ts", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))


@query("prj_01_period_keys", _EV + "SELECT request_id, day, month FROM priced")
def _(spark, sf):
    return usage.period_keys(view(spark, sf, "usage_events")).select("request_id", "day", "month")


@query("prj_02_skill_id", _EV + "SELECT skill_name, skill_id, count(*) AS n FROM priced WHERE skill_name IS NOT NULL GROUP BY ALL")
def _(spark, sf):
    return (view(spark, sf, "usage_events").filter("skill_name is not null").groupBy("skill_name").agg(F.count("*").alias("n"))
            .select("skill_name", usage.skill_id(F.col("skill_name")).alias("skill_id"), "n"))


@query("prj_03_event_cost", _EV + f"SELECT request_id, {r6('input_cost')} AS input_cost_usd, {r6('output_cost')} AS output_cost_usd, {r6('cost')} AS total_cost_usd FROM priced")
def _(spark, sf):
    p = _priced(spark, sf)
    return p.select("request_id", usage.usd(F.col("input_cost")).alias("input_cost_usd"),
                    usage.usd(F.col("output_cost")).alias("output_cost_usd"), usage.usd(F.col("cost")).alias("total_cost_usd"))


@query("prj_04_cost_estimate", _HI + f"SELECT request_id, resolved_provider, resolved_model, model AS original_model, {r6('input_cost')} AS estimated_input_cost_usd, {r6('output_cost')} AS estimated_output_cost_usd, {r6('cost')} AS estimated_total_cost_usd, CAST(input_price AS DOUBLE) AS price_per_million_input, CAST(output_price AS DOUBLE) AS price_per_million_output FROM priced")
def _(spark, sf):
    return usage.cost_estimate(view(spark, sf, "usage_history")).select(
        "request_id", "resolved_provider", "resolved_model", F.col("model").alias("original_model"),
        "estimated_input_cost_usd", "estimated_output_cost_usd", "estimated_total_cost_usd",
        "price_per_million_input", "price_per_million_output")


@query("prj_05_messages_per_euro", _EV + "SELECT request_id, CAST(floor(1.08::DOUBLE / (CAST(input_price AS DOUBLE) * 0.0003::DOUBLE + CAST(output_price AS DOUBLE) * 0.0006::DOUBLE) / 100 + 0.5) * 100 AS BIGINT) AS messages_per_euro FROM priced")
def _(spark, sf):
    p = usage.resolve_prices(view(spark, sf, "usage_events"))
    return p.select("request_id", usage.messages_per_euro(F.col("input_price").cast("double"), F.col("output_price").cast("double")).alias("messages_per_euro"))


@query("jn_01_price_resolution", _EV + "SELECT request_id, model, provider, resolved_provider, resolved_model, CAST(input_price AS DOUBLE) AS input_price, CAST(output_price AS DOUBLE) AS output_price, price_fallback FROM priced")
def _(spark, sf):
    return usage.resolve_prices(view(spark, sf, "usage_events")).select(
        "request_id", "model", "provider", "resolved_provider", "resolved_model",
        F.col("input_price").cast("double").alias("input_price"), F.col("output_price").cast("double").alias("output_price"), "price_fallback")


@query("ag_01_usage_total", _HI + f"SELECT {_SUMS}, count(*) AS requests, count(skill_name) AS skill_executions FROM priced")
def _(spark, sf):
    return usage.usage_total(_priced(spark, sf, "usage_history"))


@query("ag_02_usage_by_day", _HI + f"SELECT day, {_SUMS}, count(*) AS requests, count(skill_name) AS skill_executions FROM priced GROUP BY day")
def _(spark, sf):
    return usage.usage_by_day(_priced(spark, sf, "usage_history"))


_MONTHLY = f"SELECT month, {_SUMS}, count(*) AS requests, array_to_string(list_sort(list(DISTINCT day)), ',') AS active_days FROM priced GROUP BY month"


@query("ag_03_usage_by_month", _HI + _MONTHLY)
def _(spark, sf):
    return usage.usage_by_month(_priced(spark, sf, "usage_history"))


_BY_SKILL = f"SELECT skill_id, arg_min(skill_name, (ts, request_id)) AS name, {_SUMS}, count(*) AS executions, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first_used, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_used FROM priced WHERE skill_name IS NOT NULL GROUP BY skill_id"


@query("ag_04_usage_by_skill", _EV + _BY_SKILL)
def _(spark, sf):
    out = usage.usage_by_skill(_priced(spark, sf))
    return out.withColumns({c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c in ("first_used", "last_used")})


@query("ag_05_usage_by_day_skill", _EV + f"SELECT day, skill_name, CAST(sum(total_tokens) AS BIGINT) AS total_tokens, {r6('sum(cost)')} AS cost_usd, count(*) AS executions FROM priced WHERE skill_name IS NOT NULL GROUP BY ALL")
def _(spark, sf):
    return usage.usage_by_day_skill(_priced(spark, sf))


@query("ag_06_usage_by_model", _EV + f"SELECT model, {_SUMS}, count(*) AS requests FROM priced GROUP BY model")
def _(spark, sf):
    return usage.usage_by_model(_priced(spark, sf))


_ALL = f""", all_rolls AS (
 SELECT 'total' AS period, 'total' AS key, NULL AS sub_key, {_SUMS}, count(*) AS requests, count(skill_name) AS skill_executions FROM priced
 UNION ALL SELECT 'day', day, NULL, {_SUMS}, count(*), count(skill_name) FROM priced GROUP BY day
 UNION ALL SELECT 'month', month, NULL, {_SUMS}, count(*), count(skill_name) FROM priced GROUP BY month
 UNION ALL SELECT 'skill', skill_id, NULL, {_SUMS}, count(*), count(skill_name) FROM priced WHERE skill_name IS NOT NULL GROUP BY skill_id
 UNION ALL SELECT 'day_skill', day, skill_name, {_SUMS}, count(*), count(skill_name) FROM priced WHERE skill_name IS NOT NULL GROUP BY day, skill_name
 UNION ALL SELECT 'model', model, NULL, {_SUMS}, count(*), count(skill_name) FROM priced GROUP BY model)
"""


@query("ag_01_06_usage_rollups", _EV + _ALL + "SELECT * FROM all_rolls")
def _(spark, sf):
    return usage.rollups(_priced(spark, sf))


@query("prj_16_usage_summary", _EV + _ALL + "SELECT * FROM all_rolls WHERE period = 'skill' AND key = (SELECT DISTINCT skill_id FROM priced WHERE skill_name = 'a/b test')")
def _(spark, sf):
    return usage.summary(usage.rollups(_priced(spark, sf)), "skill", "a/b test")


@query("ag_07_session_tokens", _EV + """, gaps AS (SELECT user_id, ts, total_tokens,
  CASE WHEN lag(ts) OVER w IS NULL OR ts >= lag(ts) OVER w + INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS is_new FROM priced WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
 numbered AS (SELECT *, sum(is_new) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS sid FROM gaps)
 SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS session_start, CAST(sum(total_tokens) AS BIGINT) AS session_tokens, count(*) AS requests FROM numbered GROUP BY user_id, sid""")
def _(spark, sf):
    return usage.session_tokens(_priced(spark, sf)).withColumn("session_start", F.date_format("session_start", "yyyy-MM-dd HH:mm:ss"))


def _alerts(cte: str) -> str:
    return cte + f""", run AS (SELECT month, request_id, cost, sum(cost) OVER (PARTITION BY month ORDER BY ts, request_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS mtd FROM priced)
 SELECT month, request_id, {r6('mtd')} AS month_to_date_usd,
  CASE WHEN mtd >= 90 THEN 'budget_90' WHEN mtd >= 75 THEN 'budget_75' END AS budget_alert, cost > 50 AS request_alert FROM run"""


@query("wn_01_budget_alerts", _alerts(_HI))
def _(spark, sf):
    return usage.budget_alerts(_priced(spark, sf, "usage_history"))


@query("wn_01_budget_alerts_one_month", _alerts(_EV))
def _(spark, sf):
    return usage.budget_alerts(_priced(spark, sf))


@query("tk_03_last_six_months", _HI + f"SELECT * FROM ({_MONTHLY}) ORDER BY month DESC LIMIT 6")
def _(spark, sf):
    return usage.last_months(usage.usage_by_month(_priced(spark, sf, "usage_history")))


@query("tk_04_top_skills", _EV + f"SELECT * FROM ({_BY_SKILL}) ORDER BY cost_usd DESC, skill_id LIMIT 5")
def _(spark, sf):
    out = usage.top_skills(usage.usage_by_skill(_priced(spark, sf)))
    return out.withColumns({c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c in ("first_used", "last_used")})


@query("src_12_report_monthly_csv", _HI + f"""SELECT month AS "Month", CAST(sum(total_tokens) AS BIGINT) AS "Total Tokens", CAST(sum(input_tokens) AS BIGINT) AS "Input Tokens",
 CAST(sum(output_tokens) AS BIGINT) AS "Output Tokens", printf('%.2f', {r6('sum(cost)')}) AS "Cost (USD)", count(*) AS "Requests" FROM priced GROUP BY month""")
def _(spark, sf):
    return usage_files.monthly_csv(usage.usage_by_month(_priced(spark, sf, "usage_history")))


@query("src_12_report_skill_csv", _EV + f"""SELECT name AS "Skill Name", executions AS "Executions", total_tokens AS "Total Tokens", input_tokens AS "Input Tokens", output_tokens AS "Output Tokens",
 printf('%.2f', cost_usd) AS "Cost (USD)", first_used AS "First Used", last_used AS "Last Used" FROM ({_BY_SKILL})""")
def _(spark, sf):
    by = usage.usage_by_skill(_priced(spark, sf)).withColumns({c: F.date_format(c, "yyyy-MM-dd HH:mm:ss") for c in ("first_used", "last_used")})
    return usage_files.skill_csv(by)


@query("src_12_report_text", _HI + f""", t AS (SELECT {_SUMS}, count(*) AS requests, count(skill_name) AS skills FROM priced),
 m AS (SELECT * FROM ({_MONTHLY}) ORDER BY month DESC LIMIT 6), s AS (SELECT * FROM ({_BY_SKILL}) ORDER BY cost_usd DESC, skill_id LIMIT 5)
 SELECT 1 AS section, '0' AS sort_key, 'Total Tokens: ' || format('{{:,}}', total_tokens) AS line FROM t
 UNION ALL SELECT 1, '1', 'Input Tokens: ' || format('{{:,}}', input_tokens) FROM t
 UNION ALL SELECT 1, '2', 'Output Tokens: ' || format('{{:,}}', output_tokens) FROM t
 UNION ALL SELECT 1, '3', 'Total Kosten: $' || printf('%.2f', cost_usd) FROM t
 UNION ALL SELECT 1, '4', 'Total Requests: ' || requests FROM t
 UNION ALL SELECT 1, '5', 'Skills ausgeführt: ' || skills FROM t
 UNION ALL SELECT 2, month, month || ': $' || printf('%.2f', cost_usd) || ' (' || format('{{:,}}', total_tokens) || ' Tokens)' FROM m
 UNION ALL SELECT 3, skill_id, name || ': $' || printf('%.2f', cost_usd) || ' (' || executions || 'x)' FROM s""")
def _(spark, sf):
    p = _priced(spark, sf, "usage_history")
    return usage.report_lines(usage.usage_total(p), usage.usage_by_month(p), usage.usage_by_skill(p))
