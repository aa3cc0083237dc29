"""Landing objects, keyed writes, streams against batch, and the claim audit."""

import datetime as dt
import json
import math

import pytest
from pyspark.sql import functions as F

from nightloom.functions.text import strip_markup
from nightloom.operators import audit, quality, spc
from nightloom.plans.runner import run_plans
from nightloom.sources import landing, sinks, tables
from nightloom.streaming import charts, ingest

T0 = dt.datetime(2024, 1, 1)


def write_lines(path, rows, extra=()):
    with open(path, "w") as f:
        for r in rows:
            f.write(json.dumps(r) + "\n")
        for line in extra:
            f.write(line + "\n")


def test_landing_periods(spark, folder):
    write_lines(f"{folder}/p.json", [
        {"entity_id": "a", "id": "p1", "day": "2024-01-02", "type": "long_sleep", "imported_at": "1",
         "hrv": {"timestamp": "2024-01-01T23:00:00+01:00", "interval": None, "items": [40.0, None, 0.0, 42.5]},
         "heart_rate": {"timestamp": "not a time", "interval": 5, "items": [60.0]}, "sleep_phase_5_min": "42x1", "movement_30_sec": "12"},
        {"entity_id": "a", "id": "p2", "day": "bad day"},
    ], ["{broken"])
    t = landing.period_tables(landing.read_landing(spark, folder, "sleep_periods"))
    hrv = t["hrv"].orderBy("ts").collect()
    assert [(r.rmssd, r.source) for r in hrv] == [(40.0, "sleep_period:long_sleep"), (42.5, "sleep_period:long_sleep")]
    assert (hrv[1].ts - hrv[0].ts).total_seconds() == 900 and hrv[0].ts == dt.datetime(2024, 1, 1, 22)
    assert t["sleep_hr"].count() == 0
    assert [(r.epoch_index, r.phase) for r in t["sleep_epochs"].orderBy("epoch_index").collect()] == [(0, 4), (1, 2), (3, 1)]
    assert {r.period_id: r.day for r in t["sleep_periods"].collect()} == {"p1": dt.date(2024, 1, 2), "p2": None}


def test_landing_flat_tables(spark, folder):
    write_lines(f"{folder}/r.json", [{"entity_id": "a", "day": "2024-01-02", "score": 80, "contributors": {"hrv_balance": 70}}])
    r = landing.typed_table(landing.read_landing(spark, folder, "readiness"), "readiness").first()
    assert (r.day, r.score, r.hrv_balance, r.sleep_balance) == (dt.date(2024, 1, 2), 80, 70, None)
    person = spark.createDataFrame([("a", "x@y.z")], "entity_id STRING, email STRING")
    assert len(sinks.replace_person(person).first().email_key) == 16


def test_merge_touches_only_its_months(spark, folder):
    cols = "entity_id STRING, day DATE, month STRING, v INT, seq INT"
    row = lambda m, d, v, s: ("a", dt.date(2024, m, d), f"2024-{m:02d}", v, s)
    path = f"{folder}/t"
    sinks.merge_into(spark, path, spark.createDataFrame([row(1, 1, 1, 1), row(2, 1, 2, 1)], cols), ["entity_id", "day"], ["seq"])
    january = lambda: {f for f in spark.read.parquet(path).inputFiles() if "month=2024-01" in f}
    before = january()
    sinks.merge_into(spark, path, spark.createDataFrame([row(2, 1, 9, 2), row(2, 2, 3, 1)], cols), ["entity_id", "day"], ["seq"])
    out = spark.read.parquet(path)
    assert sorted((str(r.day), r.v) for r in out.collect()) == [("2024-01-01", 1), ("2024-02-01", 9), ("2024-02-02", 3)]
    assert january() == before


def test_manifest(spark):
    want = spark.createDataFrame([("a",), ("b",)], "artifact STRING")
    have = spark.createDataFrame([("a",), ("a",)], "artifact STRING")
    assert {r.artifact: r.n_rows for r in sinks.manifest(want, have).collect()} == {"a": 2, "b": 0}
    with pytest.raises(ValueError):
        sinks.assert_complete(want, have)


def test_precheck(spark, folder):
    spark.range(1).write.parquet(f"{folder}/ok")
    got = {r.table: (r.readable, r.has_rows) for r in tables.precheck(spark, {"ok": f"{folder}/ok", "gone": f"{folder}/gone"}).collect()}
    assert got == {"ok": (True, True), "gone": (False, False)}


def write_files(spark, folder, frames):
    for i, rows in enumerate(frames):
        df = spark.createDataFrame(rows, "event_id BIGINT, entity_id STRING, metric STRING, ts TIMESTAMP, value DOUBLE, cents BIGINT")
        df.coalesce(1).write.mode("append").parquet(folder)


def row(i, minutes, v, entity="a", metric="m"):
    return (i, entity, metric, T0 + dt.timedelta(minutes=minutes), float(v), int(v * 100))


def test_stream_dedup_over_batches(spark, folder):
    write_files(spark, folder, [[row(1, 0, 1), row(2, 5, 2)], [row(2, 5, 2), row(3, 3, 3)], [row(1, 0, 1), row(4, 9, 4)]])
    s = ingest.file_stream(spark, folder, files_per_trigger=1)
    got = ingest.run_available(ingest.dedup(s, ["event_id"]), "t-dedup")
    assert sorted(r.event_id for r in got.collect()) == [1, 2, 3, 4]


def test_stream_sessions_over_batches(spark, folder):
    write_files(spark, folder, [[row(1, 0, 1), row(2, 40, 1)], [row(3, 20, 1), row(4, 300, 1)], [row(5, 310, 1), row(6, 20000, 1)]])
    s = ingest.file_stream(spark, folder, files_per_trigger=1)
    got = ingest.run_available(ingest.sessions(s, ["entity_id"], delay="1 hour"), "t-sess")
    assert sorted(r.n for r in got.collect()) == [2, 3]


def test_chart_state_spans_batches(spark, folder):
    x = [10 + math.sin(i) for i in range(20)] + [14.0] * 10
    rows = [row(i, i * 60, v) for i, v in enumerate(x)]
    # the row of time 0 in the third file is behind the watermark; the last file moves the watermark past all rows
    write_files(spark, folder, [rows[:9], rows[9:17], rows[17:] + [row(99, 0, 500)], [row(100, 10_000, 10.0)]])
    s = ingest.file_stream(spark, folder, files_per_trigger=1)
    got = ingest.run_available(charts.control_chart(s, ["entity_id", "metric"], delay="1 hour"), "t-chart").orderBy("at_us").collect()
    mu = sum(x[:14]) / 14
    sd = (sum((v - mu) ** 2 for v in x[:14]) / 14) ** 0.5
    pos, want = 0.0, []
    for v in x[14:]:
        pos = max(0.0, pos + v - mu - 0.5 * sd)
        want.append(pos)
    assert [r.cusum_pos for r in got] == pytest.approx(want)
    assert got[-1].level == "RED"


def test_stream_quality_gate(spark, folder):
    write_files(spark, folder, [[row(1, 0, 5), row(2, 1, 500)], [row(3, 2, 7)]])
    good, bad = ingest.quality_stream(ingest.file_stream(spark, folder, files_per_trigger=1), "t-gate", {"value": (0, 100, False)})
    assert sorted(r.event_id for r in good.collect()) == [1, 3] and [r.event_id for r in bad.collect()] == [2]


def test_claims_and_verdicts(spark):
    html = ("<p>HRV p &lt; 0.001 and r = +0.79 over the whole of the observed nights.</p><style>p = 0.5; width: 3</style> <i>Cohen's d = -1.5</i> R&sup2; = 0.25 "
            + "x" * 70 + " deep = 0.4 p=1.7 " + "y" * 70 + " p = 0.031")
    docs = json.dumps({"label": "L", "a": {"p_value": 0.0312, "n": [{"correlation": 0.785}]}, "r_squared": 0.29, "cohens_d": -2.4})
    pages = spark.createDataFrame([(1, html, docs)], "page_id INT, html STRING, doc STRING")
    claims = audit.extract_claims(pages)
    got = {(r.stat_type, r.value) for r in claims.collect()}
    assert got == {("p_value", 0.001), ("correlation", 0.79), ("cohens_d", -1.5), ("r_squared", 0.25), ("p_value", 0.031)}
    v = {(r.stat_type, r.value): r.verdict for r in audit.cross_reference(claims, audit.extract_references(pages)).collect()}
    assert v[("p_value", 0.031)] == "matched" and v[("correlation", 0.79)] == "matched"
    assert v[("r_squared", 0.25)] == "warning" and v[("cohens_d", -1.5)] == "unmatched" and v[("p_value", 0.001)] == "warning"


def test_markup(spark):
    df = spark.createDataFrame([("<b>a &amp;lt; b</b>&#8364;&#x41;&nope;",)], "h STRING")
    assert df.select(strip_markup("h")).first()[0] == " a &lt; b €A&nope;"


def test_failing_plan_does_not_stop_the_others(spark, folder):
    def boom(s, d):
        raise RuntimeError("no")

    status = run_plans(spark, folder, {"good": lambda s, d: s.range(3), "bad": boom}, f"{folder}/out")
    assert {r.plan: (r.ok, r.n_rows) for r in status.collect()} == {"good": (True, 3), "bad": (False, None)}


def test_split_valid_covers_all_rows(spark):
    df = spark.createDataFrame([(1.0,), (None,), (float("nan"),), (400.0,)], "rmssd DOUBLE")
    good, bad = quality.split_valid(df, {"rmssd": (0, 300, True)})
    assert (good.count(), bad.count()) == (3, 1)


def test_reset_chart(spark):
    x = [0.0, 1.0] * 7 + [5.0] * 6
    df = spark.createDataFrame([("a", (T0 + dt.timedelta(days=i)).date(), v) for i, v in enumerate(x)], "entity_id STRING, day DATE, value DOUBLE")
    mu, sd, pos, want = 0.5, 0.5, 0.0, []
    for i, v in enumerate(x):
        if i:
            pos = max(0.0, pos + (v - mu) / sd - 0.5)
            if pos > 4:
                want.append((T0 + dt.timedelta(days=i)).date())
                pos = 0.0
    assert sorted(r.day for r in spc.cusum_reset(df, "value", ["entity_id"]).collect()) == want


def test_merge_keeps_rows_when_the_read_fails(spark, folder):
    path = f"{folder}/t"
    cols = "entity_id INT, day INT, value INT, seq INT, month STRING"
    put = lambda rows: sinks.merge_into(spark, path, spark.createDataFrame(rows, cols), ["entity_id", "day"], ["seq"])
    put([(1, 1, 1, 1, "2024-01"), (2, 1, 2, 1, "2024-01"), (1, 40, 5, 1, "2024-02")])
    spark.range(1).write.parquet(f"{path}/batch=1")  # a foreign folder: the table can't be read
    with pytest.raises(Exception):
        put([(3, 1, 3, 1, "2024-01")])
    assert spark.read.parquet(f"{path}/month=2024-01").count() == 2
    plain = spark.read.option("basePath", path).parquet(f"{path}/month=2024-01", f"{path}/month=2024-02")
    plan = plain.where(F.col("month").isin(["2024-01"]))._jdf.queryExecution().executedPlan().toString()
    assert "(month" in plan.split("PartitionFilters: [")[1].split("PushedFilters")[0]
