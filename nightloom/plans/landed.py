"""Landing text of every endpoint, written from the dense daily series, read back into typed tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from ..session import scratch_path
from ..sources import adapters as A
from ..sources import landing as L
from ..sources import schemas
from .registry import register

sql = A.sql
IMPORTED = "2024-01-01T00:00:00Z"
DAYS = {"day", "start_day", "end_day"}
STAMPS = {"timestamp", "start_datetime", "end_datetime", "start_time", "end_time", "bedtime_start", "bedtime_end", "set_up_at"}
#: Lines of these days (modulo 13) are cut off, or no object at all.
CUT, BROKEN, SHOWN = 0, 1, 40
SERIES = {"hrv": "array(n * 0.25D + 1, NULL, 0D, 2D)", "heart_rate": "array(60D, n * 1D)"}
DIGITS = {"sleep_phase_5_min": "42x1", "movement_30_sec": "12"}


def _fields(layout: str) -> list[tuple[str, str]]:
    """(name, type) of a declared layout; commas inside brackets belong to a field's type."""
    parts, depth = [""], 0
    for ch in layout:
        depth += (ch == "<") - (ch == ">")
        if ch == "," and depth == 0:
            parts.append("")
        else:
            parts[-1] += ch
    named = [p.strip().split(" ", 1) for p in parts]
    return [(name.rstrip(":"), kind.strip()) for name, kind in named]


def _inner(kind: str) -> str | None:
    return kind[len("STRUCT<"):-1] if kind.startswith("STRUCT<") else None


def _text(name: str) -> str:
    """SQL text, for both engines, of a text field."""
    if name in DAYS:
        return "CAST(day AS STRING)"
    if name in STAMPS:
        return "CAST(day AS STRING) || 'T08:00:00+00:00'"
    if name in DIGITS:
        return f"'{DIGITS[name]}'"
    return {"entity_id": "entity_id", "imported_at": f"'{IMPORTED}'", "id": "entity_id || CAST(day AS STRING)"}.get(name, f"'{name} ' || CAST(n AS STRING)")


def _numbers(stream: str) -> dict[str, int]:
    """The addend of every numeric field, by its path."""
    out: dict[str, int] = {}

    def walk(layout: str, prefix: str) -> None:
        for name, kind in _fields(layout):
            if _inner(kind) and name not in SERIES:
                walk(_inner(kind), f"{prefix}{name}.")
            elif kind in ("INT", "DOUBLE"):
                out[prefix + name] = len(out)

    walk(schemas.LANDING[stream], "")
    return out


def _object(stream: str):
    addend = _numbers(stream)

    def build(layout: str, prefix: str):
        cells = []
        for name, kind in _fields(layout):
            path = prefix + name
            if _inner(kind) and name in SERIES:
                start = F.expr(_text("timestamp")).alias("timestamp")
                cell = F.struct(start, F.lit(None).cast("int").alias("interval"), F.expr(SERIES[name]).alias("items"))
            elif _inner(kind):
                cell = build(_inner(kind), f"{path}.")
            elif kind == "INT":
                cell = F.col("n").cast("int") + addend[path]
            elif kind == "DOUBLE":
                cell = F.col("n") * 0.25 + addend[path]
            else:
                cell = F.expr(_text(name))
            cells.append(cell.alias(name))
        return F.struct(*cells)

    return F.to_json(build(schemas.LANDING[stream], ""))


def written(spark, d) -> str:
    """Folder with one line per entity-day and endpoint, in a folder of its own for each endpoint."""
    line = A.line_daily(spark, d)
    objects = F.array(*[F.struct(F.lit(s).alias("stream"), _object(s).alias("line")) for s in schemas.LANDING])
    rows = line.select("entity_id", "day", F.inline(objects))
    kind = F.unix_date("day") % 13
    text = F.when(kind == CUT, F.substring("line", 1, SHOWN)).when(kind == BROKEN, F.concat_ws(" ", F.lit("no object"), "entity_id", "day")).otherwise(F.col("line"))
    target = scratch_path(spark, "landing-text")
    rows.select("stream", text.alias("value")).write.partitionBy("stream").text(target)
    return target


def _split(spark, d):
    root = written(spark, d)
    return {s: L.split_lines(spark.read.text(f"{root}/stream={s}"), s) for s in schemas.LANDING}


GOOD = f"k AS (SELECT *, date_diff('day', DATE '1970-01-01', day) % 13 AS k FROM ld), g AS (SELECT * FROM k WHERE k NOT IN ({CUT}, {BROKEN}))"
STREAMS = "s(stream) AS (VALUES " + ", ".join(f"('{s}')" for s in schemas.LANDING) + ")"


@register("landing_counts", sql("ld", GOOD + ", " + STREAMS + f" SELECT stream, count(*) FILTER (k NOT IN ({CUT}, {BROKEN})) AS n_good, count(*) FILTER (k IN ({CUT}, {BROKEN})) AS n_bad FROM k, s GROUP BY stream"))
def _(spark, d):
    """Good and bad lines of every endpoint."""
    parts = [r.select(F.lit(s).alias("stream"), "ok") for s, r in _split(spark, d).items()]
    both = reduce(lambda a, b: a.unionByName(b), parts)
    return both.groupBy("stream").agg(F.count_if("ok").alias("n_good"), F.count_if(~F.col("ok")).alias("n_bad"))


@register("landing_quarantine", sql("ld", GOOD + ", " + STREAMS + f""" SELECT stream, CASE k WHEN {CUT} THEN '{{"entity_id":"' || entity_id || '","imported_at":"2024-01-' ELSE 'no object ' || entity_id || ' ' || CAST(day AS VARCHAR) END AS line,
    count(*) AS n FROM k, s WHERE k IN ({CUT}, {BROKEN}) GROUP BY ALL"""))
def _(spark, d):
    """The bad lines, listed."""
    parts = [r.where(~F.col("ok")).select(F.lit(s).alias("stream"), F.col("value").alias("line")) for s, r in _split(spark, d).items()]
    return reduce(lambda a, b: a.unionByName(b), parts).groupBy("stream", "line").agg(F.count("*").alias("n"))


def _typed(spark, d):
    out = {}
    for stream, rows in _split(spark, d).items():
        good = rows.where("ok").select("row.*")
        if stream == "sleep_periods":
            out |= L.period_tables(good)
        else:
            out[stream] = L.typed_table(good, stream)
    return out


def _facts(table: str, df):
    """(table, column, n_known, total) of a typed table; totals of numeric columns."""
    named = [c for c in df.dtypes if c[0] != "imported_at"]
    cells = [F.struct(F.lit(c).alias("column"), F.count(c).alias("n_known"), (F.sum(F.col(c).cast("double")) if t in ("int", "double") else F.lit(None).cast("double")).alias("total")) for c, t in named]
    return df.agg(F.array(*cells).alias("cells")).select(F.lit(table).alias("table"), F.inline("cells"))


def _expected() -> str:
    """The same facts from the daily series, column by column."""
    rows = []

    def add(table: str, column: str, total: str = "NULL", each: int = 1, known: bool = True) -> None:
        rows.append(f"SELECT '{table}' AS \"table\", '{column}' AS \"column\", count(*)*{each if known else 0} AS n_known, CAST({total} AS DOUBLE) AS total FROM g")

    value = lambda kind, k: f"sum(n + {k})" if kind == "INT" else f"sum(n*0.25 + {k})"
    for stream in schemas.LANDING:
        addend, names = _numbers(stream), {name for name, _ in _fields(schemas.LANDING[stream])}
        for name, kind in (f.strip().split(" ", 1) for f in schemas.TABLES[stream].split(",")):
            path = L._RENAMES.get(stream, {}).get(name, name)
            if path in addend:
                add(stream, name, value(kind, addend[path]))
            else:
                here = path.split(".")[0] in names or (stream, name) in {("heart_rate", "ts"), ("personal_info", "email_key"), ("sleep_periods", "period_id")}
                add(stream, name, known=here)
    hearts = "sum(CASE WHEN n > 0 THEN n ELSE 0 END)"
    for table, columns in {
        "hrv": {"entity_id": "NULL", "period_id": "NULL", "ts": "NULL", "rmssd": "sum(n*0.25 + 3)", "source": "NULL"},
        "sleep_hr": {"entity_id": "NULL", "period_id": "NULL", "ts": "NULL", "bpm": f"sum(60) + {hearts}"},
        "sleep_epochs": {"entity_id": "NULL", "period_id": "NULL", "epoch_index": "sum(0 + 1 + 3)", "phase": "sum(4 + 2 + 1)"},
        "sleep_movement": {"entity_id": "NULL", "period_id": "NULL", "movement_index": "sum(1)", "classification": "sum(3)"},
    }.items():
        for column, total in columns.items():
            add(table, column, total, each=3 if table == "sleep_epochs" else 2)
    return " UNION ALL ".join(rows)


@register("landing_tables", sql("ld", GOOD + ", x AS (" + _expected() + ') SELECT "table", "column", n_known, total FROM x'))
def _(spark, d):
    """Known cells and totals of every column of every typed table."""
    return reduce(lambda a, b: a.unionByName(b), [_facts(t, df) for t, df in _typed(spark, d).items()])
