"""Sensor-shaped views of the available tables.

Means are built from integer hundredths, so a daily value is the same double
however the rows were partitioned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

EVENT_METRICS = ["click", "error", "purchase", "signup", "view"]
LINE_METRICS = ["disc", "price", "qty", "tax"]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def hundredths(c: str) -> Column:
    return F.round(F.col(c) * 100).cast("bigint")


def samples(spark: SparkSession, folder: str) -> DataFrame:
    """Irregular samples: (entity_id, metric, ts, day, value, cents, event_id)."""
    return table(spark, folder, "events").select(
        "event_id", F.col("user_id").alias("entity_id"), F.col("event_type").alias("metric"), "ts",
        F.to_date("ts").alias("day"), "value", hundredths("value").alias("cents"),
    )


def exact_mean(cents: Column, n: Column) -> Column:
    return cents.cast("double") / n / 100


def event_daily(spark: SparkSession, folder: str) -> DataFrame:
    """One row per entity, metric and day."""
    return samples(spark, folder).groupBy("entity_id", "metric", "day").agg(
        F.count("*").alias("n"), exact_mean(F.sum("cents"), F.count("*")).alias("value")
    )


def event_wide(spark: SparkSession, folder: str) -> DataFrame:
    """One row per entity and day, a column per metric; one shuffle."""
    cols = []
    for m in EVENT_METRICS:
        hit = F.col("metric") == m
        cols.append(exact_mean(F.sum(F.when(hit, F.col("cents"))), F.count(F.when(hit, 1))).alias(m))
    return samples(spark, folder).groupBy("entity_id", "day").agg(*cols)


def line_daily(spark: SparkSession, folder: str) -> DataFrame:
    """Dense daily series for a few entities: mean quantity, price (thousands), discount and tax (percent)."""
    n = F.count("*")
    return (
        table(spark, folder, "lineitem")
        .select(
            F.col("l_returnflag").alias("entity_id"), F.to_date("l_shipdate").alias("day"),
            F.col("l_quantity").cast("bigint").alias("q"), hundredths("l_extendedprice").alias("p"),
            hundredths("l_discount").alias("d"), hundredths("l_tax").alias("t"),
        )
        .groupBy("entity_id", "day")
        .agg(
            n.alias("n"),
            (F.sum("d").cast("double") / n).alias("disc"),
            (F.sum("p").cast("double") / n / 100000).alias("price"),
            (F.sum("q").cast("double") / n).alias("qty"),
            (F.sum("t").cast("double") / n).alias("tax"),
        )
    )


def line_signals(spark: SparkSession, folder: str) -> DataFrame:
    pairs = [F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in LINE_METRICS]
    return line_daily(spark, folder).select("entity_id", "day", F.inline(F.array(*pairs)))


def order_daily(spark: SparkSession, folder: str) -> DataFrame:
    """Daily orders per priority: count and mean price in thousands."""
    n = F.count("*")
    return (
        table(spark, folder, "orders")
        .select(F.col("o_orderpriority").alias("entity_id"), F.to_date("o_orderdate").alias("day"), hundredths("o_totalprice").alias("p"))
        .groupBy("entity_id", "day")
        .agg(n.alias("n"), (F.sum("p").cast("double") / n / 100000).alias("value"))
    )


# SQL text of the same views.
SQL_VIEWS = {
    "ev": """SELECT event_id, user_id AS entity_id, event_type AS metric, ts, CAST(ts AS DATE) AS day, value,
        CAST(round(value*100) AS BIGINT) AS cents FROM events""",
    "ed": """SELECT entity_id, metric, day, count(*) AS n, CAST(sum(cents) AS DOUBLE)/count(*)/100 AS value
        FROM ev GROUP BY entity_id, metric, day""",
    "ew": "SELECT entity_id, day, " + ", ".join(
        f"CAST(sum(cents) FILTER (WHERE metric='{m}') AS DOUBLE)/count(*) FILTER (WHERE metric='{m}')/100 AS \"{m}\""
        for m in EVENT_METRICS
    ) + " FROM ev GROUP BY entity_id, day",
    "ld": """SELECT entity_id, day, count(*) AS n, CAST(sum(d) AS DOUBLE)/count(*) AS disc,
        CAST(sum(p) AS DOUBLE)/count(*)/100000 AS price, CAST(sum(q) AS DOUBLE)/count(*) AS qty,
        CAST(sum(t) AS DOUBLE)/count(*) AS tax
        FROM (SELECT l_returnflag AS entity_id, CAST(l_shipdate AS DATE) AS day, CAST(l_quantity AS BIGINT) AS q,
              CAST(round(l_extendedprice*100) AS BIGINT) AS p, CAST(round(l_discount*100) AS BIGINT) AS d,
              CAST(round(l_tax*100) AS BIGINT) AS t FROM lineitem) GROUP BY entity_id, day""",
    "ls": " UNION ALL ".join(f"SELECT entity_id, day, '{m}' AS metric, {m} AS value FROM ld" for m in LINE_METRICS),
    "od": """SELECT entity_id, day, count(*) AS n, CAST(sum(p) AS DOUBLE)/count(*)/100000 AS value
        FROM (SELECT o_orderpriority AS entity_id, CAST(o_orderdate AS DATE) AS day,
              CAST(round(o_totalprice*100) AS BIGINT) AS p FROM orders) GROUP BY entity_id, day""",
}
_NEEDS = {"ed": ["ev"], "ew": ["ev"], "ls": ["ld"]}


def sql(views: str, body: str, recursive: bool = False) -> str:
    """``WITH`` the named views, then extra CTEs and a select in ``body``.

    ``body`` is either a plain SELECT or ``name AS (...), ... SELECT ...``.
    """
    names: list[str] = []
    for v in views.split():
        for need in [*_NEEDS.get(v, []), v]:
            if need not in names:
                names.append(need)
    head = ", ".join(f"{v} AS ({SQL_VIEWS[v]})" for v in names)
    body = body.strip()
    join = " " if body[:6].upper() == "SELECT" else ", "
    return f"WITH {'RECURSIVE ' if recursive else ''}{head}{join}{body}"


# Fixed bindings: which sample kind stands for which epoch phase.
PHASE_OF_METRIC = {"click": 1, "view": 2, "purchase": 3, "error": 4, "signup": 4}


def epochs(spark: SparkSession, folder: str) -> DataFrame:
    """Categorical 5-minute epochs per entity and week."""
    from ..functions.scalar import code_label
    from ..operators.nights import slot_epochs

    ev = samples(spark, folder).withColumn("week_no", F.floor(F.unix_date("day") / 7))
    return slot_epochs(ev, ["entity_id", "week_no"], code_label("metric", PHASE_OF_METRIC).cast("int"), ["ts", "event_id"])


SQL_VIEWS["ep"] = """SELECT entity_id, week_no, phase, slot - min(slot) OVER (PARTITION BY entity_id, week_no) AS epoch_index FROM (
    SELECT entity_id, CAST(floor(date_diff('day', DATE '1970-01-01', day)/7.0) AS BIGINT) AS week_no,
        CAST(floor(epoch_us(ts)/300000000.0) AS BIGINT) AS slot,
        arg_max(CASE metric WHEN 'click' THEN 1 WHEN 'view' THEN 2 WHEN 'purchase' THEN 3 ELSE 4 END, (ts, event_id)) AS phase
    FROM ev GROUP BY ALL)"""
_NEEDS["ep"] = ["ev"]
SQL_VIEWS["se"] = """SELECT entity_id, session, min(us) AS start_us, max(us) AS end_us, count(*) AS n FROM (
    SELECT *, sum(fresh) OVER (PARTITION BY entity_id ORDER BY us, event_id) AS session FROM (
      SELECT *, CASE WHEN us - lag(us) OVER (PARTITION BY entity_id ORDER BY us, event_id) > 21600000000 THEN 1 ELSE 0 END AS fresh
      FROM (SELECT entity_id, event_id, epoch_us(ts) AS us FROM ev))) GROUP BY entity_id, session HAVING count(*) >= 2"""
_NEEDS["se"] = ["ev"]


#: Physiological stand-ins computed from the dense daily series.
BIO = {
    "rmssd": "qty", "sleep_hr": "40 + price*0.75e0", "efficiency": "80 + tax*2", "temp_deviation": "(disc - 5)/2",
    "spo2": "CASE WHEN n >= 6 THEN 94 + tax*0.75e0 END", "deep_pct": "qty/2", "rem_pct": "price/2", "awake_pct": "disc",
    "hr_dip_pct": "tax*3", "awake_hr": "60 + price/2", "cv_age_delta": "CASE WHEN n >= 4 THEN disc END", "dfa_alpha1": "tax/4",
    "strain_ratio": "disc/3", "total_hours": "4 + tax*0.75e0", "steps": "price*100",
}


def bio_daily(spark: SparkSession, folder: str) -> DataFrame:
    return line_daily(spark, folder).select("entity_id", "day", *[F.expr(e.replace("e0", "D")).cast("double").alias(c) for c, e in BIO.items()])


SQL_VIEWS["bd"] = "SELECT entity_id, day, " + ", ".join(f"CAST({e} AS DOUBLE) AS {c}" for c, e in BIO.items()) + " FROM ld"
_NEEDS["bd"] = ["ld"]
