"""Token usage: price resolution, cost, rollups, budgets and reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pultwerk import fixed_values as fv
from pultwerk.functions.text import strip
from pultwerk.operators import ordered

# 20 digits before the point; sums of it are decimal(38,8), so nothing is rounded on the way
MONEY = "decimal(28,8)"
PERIODS = ("total", "day", "month", "skill", "day_skill", "model")


def price_dimensions(spark: SparkSession, prices=fv.PRICES, aliases=fv.MODEL_ALIASES) -> tuple[DataFrame, DataFrame]:
    """Price list and alias map → what a model costs with and without a provider hint.

    Both are configuration of a few dozen rows, so they become constant relations: the
    broadcast has a known size and no shuffle is spent on them.
    """
    listed = {(p, m): f"named_struct('provider', '{p}', 'model', '{m}', 'input_price', {a}BD, 'output_price', {b}BD)" for p, m, a, b in prices}
    first: dict[str, str] = {}
    for (_, model), row in listed.items():
        first.setdefault(model, row)
    aliased = {asked: listed[(p, m)] for asked, p, m in aliases if (p, m) in listed}
    null = "CAST(NULL AS struct<provider:string,model:string,input_price:decimal(10,2),output_price:decimal(10,2)>)"
    price = lambda row: f"CAST({row} AS struct<provider:string,model:string,input_price:decimal(10,2),output_price:decimal(10,2)>)" if row else null
    by_model = ", ".join(f"('{m}', {price(aliased.get(m))}, {price(first.get(m))})" for m in sorted({*first, *aliased}))
    by_hint = ", ".join(f"('{m}', '{p}', {price(row)})" for (p, m), row in listed.items())
    return (spark.sql(f"SELECT * FROM VALUES {by_model} AS t(model, _alias, _first)"),
            spark.sql(f"SELECT * FROM VALUES {by_hint} AS t(model, provider, _hinted)"))


def resolve_prices(events: DataFrame, prices=fv.PRICES, aliases=fv.MODEL_ALIASES) -> DataFrame:
    """Adds resolved_provider, resolved_model, both prices and price_fallback.

    Alias first (the hint is ignored then), then the hinted provider, then the first
    provider that lists the model, else the default model with the fallback flag set.
    """
    by_model, by_hint = price_dimensions(events.sparkSession, prices, aliases)
    default = next(r for r in prices if tuple(r[:2]) == (fv.DEFAULT_PROVIDER, fv.DEFAULT_MODEL))
    fallback = F.struct(F.lit(default[0]).alias("provider"), F.lit(default[1]).alias("model"),
                        F.lit(default[2]).cast("decimal(10,2)").alias("input_price"),
                        F.lit(default[3]).cast("decimal(10,2)").alias("output_price"))
    found = F.coalesce("_alias", "_hinted", "_first")
    return (events.join(F.broadcast(by_model), "model", "left").join(F.broadcast(by_hint), ["model", "provider"], "left")
            .withColumn("price_fallback", found.isNull())
            .withColumn("_p", F.coalesce(found, fallback))
            .withColumn("resolved_provider", F.col("_p.provider"))
            .withColumn("resolved_model", F.col("_p.model"))
            .withColumn("input_price", F.col("_p.input_price"))
            .withColumn("output_price", F.col("_p.output_price"))
            .drop("_alias", "_hinted", "_first", "_p"))


def _cost(tokens: str, price: str) -> Column:
    per_token = F.lit("0.000001").cast("decimal(6,6)")
    return (F.col(tokens).cast("decimal(18,0)") * F.col(price) * per_token).cast(MONEY)


def with_cost(events: DataFrame, prices=fv.PRICES) -> DataFrame:
    """Exact cost per event, so that sums do not depend on the order of rows.

    An empty skill name means that no skill ran; events need not name skills at all.
    """
    if "skill_name" in events.columns:
        events = events.withColumn("skill_name", F.nullif("skill_name", F.lit("")))
    return (resolve_prices(events, prices)
            .withColumn("input_cost", _cost("input_tokens", "input_price"))
            .withColumn("output_cost", _cost("output_tokens", "output_price"))
            .withColumn("cost", (F.col("input_cost") + F.col("output_cost")).cast(MONEY))
            .withColumn("total_tokens", F.col("input_tokens") + F.col("output_tokens")))


def period_keys(events: DataFrame) -> DataFrame:
    """Day and month key, as text, from the event's own local timestamp."""
    day = F.col("ts").cast("date").cast("string")
    return events.withColumn("day", day).withColumn("month", F.substring(day, 1, 7))


def skill_id(name: Column) -> Column:
    normal = F.regexp_replace(strip(F.lower(name)), r"[/\\]", "_")
    return F.concat(normal, F.lit("_"), F.substring(F.md5(normal), 1, 8))


def usd(amount: Column) -> Column:
    return F.round(amount, 6).cast("double")


def _sums() -> list[Column]:
    return [
        F.sum("total_tokens").alias("total_tokens"),
        F.sum("input_tokens").alias("input_tokens"),
        F.sum("output_tokens").alias("output_tokens"),
        usd(F.sum("cost")).alias("cost_usd"),
        F.count("*").alias("requests"),
        F.count("skill_name").alias("skill_executions"),
    ]


def rollups(priced: DataFrame) -> DataFrame:
    """Total, day, month, skill, day × skill and model rollups.

    ``period`` names the grouping and ``key``/``sub_key`` its value. Events are summed to
    (day, skill, model) first; the six groupings then multiply that small result instead
    of the events. Events without a skill take no part in the skill groupings.
    """
    sums = ["total_tokens", "input_tokens", "output_tokens", "cost"]
    fine = priced.groupBy(F.col("ts").cast("date").alias("_d"), "skill_name", "model").agg(
        *[F.sum(c).alias(c) for c in sums], F.count("*").alias("requests"), F.count("skill_name").alias("skill_executions"))
    keyed = period_keys(fine.withColumnRenamed("_d", "ts")).withColumn("sid", skill_id(F.col("skill_name")))
    names = ["day", "month", "sid", "skill_name", "model"]
    sets = keyed.groupingSets([[], ["day"], ["month"], ["sid"], ["day", "skill_name"], ["model"]], *names).agg(
        F.grouping_id(*names).alias("gid"), *[F.sum(c).alias(c) for c in (*sums, "requests", "skill_executions")])
    # bits of gid: 1 = column not part of the grouping, in the order of ``names``
    period = (F.when(F.col("gid") == 0b11111, "total").when(F.col("gid") == 0b01111, "day")
              .when(F.col("gid") == 0b10111, "month").when(F.col("gid") == 0b11011, "skill")
              .when(F.col("gid") == 0b01101, "day_skill").otherwise("model"))
    rows = sets.withColumns({"period": period, "key": F.coalesce("day", "month", "sid", "model", F.lit("total")), "sub_key": F.col("skill_name"),
                             "cost_usd": usd(F.col("cost"))})
    no_skill = (F.col("period") == "skill") & F.col("sid").isNull() | (F.col("period") == "day_skill") & F.col("sub_key").isNull()
    return rows.filter(~no_skill).drop("gid", *names, "cost")


def usage_total(priced: DataFrame) -> DataFrame:
    return priced.agg(*_sums())


def usage_by_day(priced: DataFrame) -> DataFrame:
    return period_keys(priced).groupBy("day").agg(*_sums())


def usage_by_month(priced: DataFrame) -> DataFrame:
    """Month sums with the sorted list of active days (at most 31 of them)."""
    per_day = period_keys(priced).groupBy("month", "day").agg(
        *[F.sum(c).alias(c) for c in ("total_tokens", "input_tokens", "output_tokens", "cost")],
        F.count("*").alias("requests"))
    return per_day.groupBy("month").agg(
        *[F.sum(c).alias(c) for c in ("total_tokens", "input_tokens", "output_tokens")],
        usd(F.sum("cost")).alias("cost_usd"), F.sum("requests").alias("requests"),
        F.array_join(F.array_sort(F.collect_list("day")), ",").alias("active_days"))


def usage_by_skill(priced: DataFrame) -> DataFrame:
    """First and last use by (ts, request_id), since a batch has no arrival order."""
    arrival = F.struct("ts", "request_id")
    return (priced.filter("skill_name is not null").withColumn("skill_id", skill_id(F.col("skill_name")))
            .groupBy("skill_id").agg(
                F.min_by("skill_name", arrival).alias("name"), *_sums()[:4],
                F.count("*").alias("executions"),
                F.min_by("ts", arrival).alias("first_used"), F.max_by("ts", arrival).alias("last_used")))


def usage_by_day_skill(priced: DataFrame) -> DataFrame:
    return period_keys(priced.filter("skill_name is not null")).groupBy("day", "skill_name").agg(
        F.sum("total_tokens").alias("total_tokens"), usd(F.sum("cost")).alias("cost_usd"),
        F.count("*").alias("executions"))


def usage_by_model(priced: DataFrame) -> DataFrame:
    """By the model as requested, not as resolved."""
    return priced.groupBy("model").agg(*_sums()[:5])


def session_tokens(priced: DataFrame, gap_minutes: int = 30) -> DataFrame:
    """Tokens per user session; a session is a chain of requests less than the gap apart.

    Requests are cut into ranges of (user, time), so a user with very many of them is spread
    over many tasks. Each range sums up its own partial sessions; a partial session that
    starts within the gap of the one before, in this range or an earlier one, goes on with it.
    """
    order = ["ts", "request_id"]
    stamped = priced.filter("ts is not null").withColumn("ts", F.col("ts").cast("timestamp")).select("user_id", *order, "total_tokens")
    split = ordered.range_split(stamped, ["user_id"], order)
    gap = F.expr(f"INTERVAL {int(gap_minutes)} MINUTES")
    rows = Window.partitionBy(ordered.PART, "user_id").orderBy(*order)
    marked = split.withColumn("_before", F.lag("ts").over(rows)).withColumn(
        "_n", F.sum(F.when(F.col("ts") >= F.col("_before") + gap, 1).otherwise(0)).over(rows))
    partial = marked.groupBy(ordered.PART, "user_id", "_n").agg(
        F.min("ts").alias("start"), F.max("ts").alias("end"), F.sum("total_tokens").alias("tokens"), F.count("*").alias("requests"))
    joined = ordered.previous(partial, ["user_id"], ["start"], "end", "_before")
    opened = F.when(F.col("_before").isNull() | (F.col("start") >= F.col("_before") + gap), 1).otherwise(0)
    numbered = ordered.running(joined, ["user_id"], ["start"], opened, "_session")
    return numbered.groupBy("user_id", "_session").agg(
        F.min("start").alias("session_start"), F.sum("tokens").alias("session_tokens"), F.sum("requests").alias("requests")).drop("_session")


def summary(rolled: DataFrame, period: str, key: str | None = None) -> DataFrame:
    """One slice of the rollups; an unknown period is an error."""
    if period not in PERIODS:
        raise ValueError(f"unknown period {period!r}")
    out = rolled.filter(F.col("period") == period)
    if key is None:
        return out
    wanted = skill_id(F.lit(key)) if period == "skill" else F.lit(key)
    return out.filter(F.col("key") == wanted)


def cost_estimate(plan: DataFrame, prices=fv.PRICES) -> DataFrame:
    priced = with_cost(plan, prices)
    return priced.withColumns({
        "estimated_input_cost_usd": usd(F.col("input_cost")),
        "estimated_output_cost_usd": usd(F.col("output_cost")),
        "estimated_total_cost_usd": usd(F.col("cost")),
        "price_per_million_input": F.col("input_price").cast("double"),
        "price_per_million_output": F.col("output_price").cast("double"),
    })


def messages_per_euro(input_price: Column, output_price: Column) -> Column:
    cost = (input_price * F.lit(fv.MESSAGE_INPUT_TOKENS / 1e6)) + (output_price * F.lit(fv.MESSAGE_OUTPUT_TOKENS / 1e6))
    return (F.floor(F.lit(fv.USD_PER_EURO) / cost / 100 + 0.5) * 100).cast("long")


def budget_alerts(priced: DataFrame, budget: float = fv.MONTHLY_BUDGET_USD,
                  request_limit: float = fv.REQUEST_WARNING_USD, spent: DataFrame | None = None) -> DataFrame:
    """Month-to-date cost at every event and the alerts it raises.

    ``spent`` (month, spent) holds what months cost before these events: a row per month.

    The running total spans partitions (see ``ordered``), so one month holding most of the
    rows is still worked on by many tasks.
    """
    keyed = period_keys(priced).select("month", "ts", "request_id", "cost")
    split = ordered.range_split(keyed, ["month"], ["ts", "request_id"])
    run = ordered.running(split, ["month"], ["ts", "request_id"], F.col("cost"), "month_to_date")
    if spent is not None:
        named = F.broadcast(spent.withColumnRenamed("month", "_month"))
        # 37 digits and 37 digits keep all eight places behind the point
        both = F.col("month_to_date").cast("decimal(37,8)") + F.coalesce(F.col("spent").cast("decimal(37,8)"), F.lit(0).cast("decimal(37,8)"))
        run = run.join(named, F.col("month").eqNullSafe(F.col("_month")), "left").withColumn("month_to_date", both)
    level = (F.when(F.col("month_to_date") >= budget * 0.9, "budget_90")
             .when(F.col("month_to_date") >= budget * 0.75, "budget_75"))
    return run.select(
        "month", "request_id", usd(F.col("month_to_date")).alias("month_to_date_usd"),
        (level if budget > 0 else F.lit(None).cast("string")).alias("budget_alert"),
        (F.col("cost") > request_limit).alias("request_alert"))


def last_months(monthly: DataFrame, n: int = 6) -> DataFrame:
    return monthly.orderBy(F.desc("month")).limit(n)


def top_skills(by_skill: DataFrame, n: int = 5) -> DataFrame:
    return by_skill.orderBy(F.desc("cost_usd"), "skill_id").limit(n)


def report_lines(total: DataFrame, monthly: DataFrame, by_skill: DataFrame) -> DataFrame:
    """Text report as ordered lines (section, pos, line)."""
    money = lambda c: F.format_string("$%.2f", F.col(c))
    count = lambda c: F.format_number(F.col(c), 0)
    labels = [("Total Tokens: ", count("total_tokens")), ("Input Tokens: ", count("input_tokens")),
              ("Output Tokens: ", count("output_tokens")), ("Total Kosten: ", money("cost_usd")),
              ("Total Requests: ", F.col("requests").cast("string")),
              ("Skills ausgeführt: ", F.col("skill_executions").cast("string"))]
    head = total.select(F.posexplode(F.array(*[F.concat(F.lit(t), v) for t, v in labels])).alias("pos", "line")) \
        .select(F.lit(1).alias("section"), F.col("pos").cast("string").alias("sort_key"), "line")
    months = last_months(monthly).select(
        F.lit(2).alias("section"), F.col("month").alias("sort_key"),
        F.concat("month", F.lit(": "), money("cost_usd"), F.lit(" ("), count("total_tokens"), F.lit(" Tokens)")).alias("line"))
    skills = top_skills(by_skill).select(
        F.lit(3).alias("section"), F.col("skill_id").alias("sort_key"),
        F.concat("name", F.lit(": "), money("cost_usd"), F.lit(" ("), F.col("executions").cast("string"), F.lit("x)")).alias("line"))
    return reduce(DataFrame.unionByName, [head, months, skills])
