"""Packing into optimal length buckets.

The histogram of all lengths goes to the driver: one number for each different length, of which there are no more than
the longest text has words, however many rows there are.  A dynamic programme over it picks the bucket boundaries with the
least padding; the cost of a last bucket is linear in its length, so a lower envelope of lines gives each step's optimum
in constant time.  Inside a bucket, rows are numbered and cut into batches of as many rows as
the token budget holds at the bucket's length.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import cut, gapless
from .registry import register, table

BUCKETS = 16
BUDGET = 65_536
WORD = r"[^\x20\x09-\x0D]+"


def boundaries(lengths: list[int], count: list[int], buckets: int) -> list[int]:
    """Bucket lengths with the least padding for ``count`` rows of each of the ascending ``lengths``; whole numbers throughout."""
    n, used = len(lengths), min(buckets, len(lengths))
    rows, tokens = [0], [0]
    for x, c in zip(lengths, count):
        rows.append(rows[-1] + c)
        tokens.append(tokens[-1] + c * x)
    best: list[int | None] = [0] + [None] * n
    choice = []
    for _ in range(used):
        now: list[int | None] = [None] * (n + 1)
        chosen = [0] * (n + 1)
        lines: list[tuple[int, int, int]] = []  # slope, offset, place: the envelope at ever larger lengths
        at = 0
        for j in range(1, n + 1):
            if best[j - 1] is not None:
                slope, offset = -rows[j - 1], best[j - 1] + tokens[j - 1]
                while len(lines) > at + 1 and (offset - lines[-2][1]) * (lines[-2][0] - lines[-1][0]) <= (lines[-1][1] - lines[-2][1]) * (lines[-2][0] - slope):
                    lines.pop()
                lines.append((slope, offset, j - 1))
            x = lengths[j - 1]
            if not lines:
                continue
            while at + 1 < len(lines) and lines[at + 1][0] * x + lines[at + 1][1] < lines[at][0] * x + lines[at][1]:
                at += 1
            now[j], chosen[j] = lines[at][0] * x + lines[at][1] + rows[j] * x - tokens[j], lines[at][2]
        best = now
        choice.append(chosen)
    out, j = [], n
    for chosen in reversed(choice):
        out.append(int(lengths[j - 1]))
        j = chosen[j]
    return out[::-1]


def pack(docs: DataFrame, buckets: int = BUCKETS, budget: int = BUDGET, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, length, bucket, bucket_length, batch, place, padding for each input row.

    A length is a row's number of words.  Null and empty texts have length 0 and, where the optimum says so, share the
    shortest bucket; a row longer than the budget is a batch of its own; rows of equal id are placed in any order, each
    once; other columns are ignored, whatever their names; an empty table gives no rows.
    """
    length = F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(WORD)).cast("long")
    rows = cut(docs.select(F.col(doc_id).cast("long").alias("doc_id"), length.alias("length")))
    cells = sorted((r.length, r.c) for r in rows.groupBy("length").agg(F.count(F.lit(1)).alias("c")).collect())  # different lengths only
    ends = boundaries([x for x, _ in cells], [c for _, c in cells], buckets) or [0]
    bucket, size = F.lit(len(ends) - 1), F.lit(ends[-1])
    for k in range(len(ends) - 2, -1, -1):
        bucket, size = F.when(F.col("length") <= ends[k], k).otherwise(bucket), F.when(F.col("length") <= ends[k], ends[k]).otherwise(size)
    placed = gapless(
        rows.select("doc_id", "length", bucket.cast("int").alias("bucket"), size.cast("long").alias("bucket_length")),
        "bucket", ["doc_id", "length"], ["doc_id", "length"], "number",
    )
    hold = F.greatest(F.floor(F.lit(budget) / F.greatest("bucket_length", F.lit(1))), F.lit(1)).cast("long")
    return placed.select(
        "doc_id", "length", "bucket", "bucket_length", F.floor(F.col("number") / hold).cast("long").alias("batch"),
        (F.col("number") % hold).alias("place"), (F.col("bucket_length") - F.col("length")).alias("padding"),
    )


@register("op5_packing")
def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
