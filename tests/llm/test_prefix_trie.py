"""The prefix trie against brute force."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import types as T

from nightloom.llm.prefix_trie import prefix_trie, ranked

FORM = T.StructType(
    [T.StructField("conv_id", T.LongType()), T.StructField("turn", T.LongType()), T.StructField("role", T.StringType()), T.StructField("text", T.StringType())]
)


def frame(spark, rows, clash=False):
    df = spark.createDataFrame(rows, FORM).repartition(4)
    return df.selectExpr("*", *(f"1 AS {c}" for c in ("idx", "gid", "pid", "key", "bytes", "a", "b", "depth", "arc", "place", "row"))) if clash else df


def brute(rows):
    own = {}
    for c, turn, role, text in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0)):
        if c is not None:
            own.setdefault(c, []).append((role or "", text or ""))
    made = {}
    for c in own:
        h, base = zlib.crc32(str(c).encode()) % 9, c - (abs(c) % 5 if c >= 0 else -(abs(c) % 5))
        made[c] = tuple(own.get(base, [])[:h] + own[c][h:])
    members = {}
    for c, seq in made.items():
        for d in range(len(seq) + 1):
            members.setdefault(seq[:d], []).append(c)
    children = {}
    for p in members:
        if p:
            children.setdefault(p[:-1], []).append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        mine = (len(members[p]) - 1) * (len(p[-1][1].encode()) if p else 0)
        leaves[p] = sum(leaves[x] for x in children[p]) if p in children else 1
        saved[p] = mine + sum(saved[x] for x in children.get(p, []))
    out = []
    for p, who in members.items():
        ends = ",".join(str(c) for c in sorted(who) if made[c] == p)
        out.append((min(who), len(p), min(members[p[:-1]]) if p else None, len(who), len(children.get(p, [])), leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def talks(seed, n, longest=14):
    r = random.Random(seed)
    rows = []
    for c in [*range(n), -7, -5, -3, 10**12, 10**12 + 3]:
        for t in range(r.randint(1, longest)):
            rows.append((c, t, r.choice(["user", "assistant"]) if t else "user", r.choice(["a", "b", "é", ""]) * (1 if t > 2 else 2)))
    rows += [(3, 40, None, None), (3, None, "system", "first"), (None, 1, "user", "no id"), (4, 99, "user", "x" * 200_000)]
    rows += [(50_000 + c, t, "user", "same") for c in range(60) for t in range(5)]
    rows += [(70_000, t, "user", f"t{t % 7}") for t in range(300)] + [(70_003, 2 * t, "user", f"t{t % 7}") for t in range(300)]
    return rows


@pytest.mark.parametrize("seed,walk,chunk", [(1, 400, 3), (2, 4096, 4096)])
def test_trie(spark, seed, walk, chunk):
    rows = talks(seed, 40)
    got = prefix_trie(frame(spark, rows, clash=True), walk=walk, chunk=chunk)
    assert sorted(map(tuple, got.collect()), key=repr) == brute(rows)


def test_small_tables(spark):
    assert prefix_trie(frame(spark, [])).collect() == []
    assert prefix_trie(frame(spark, [(None, 0, "user", "x")])).collect() == []
    for rows in ([(7, None, None, None)], [(1, 0, "u", "a"), (1, 1, "u", "b"), (2, 0, "u", "a")]):
        assert sorted(map(tuple, prefix_trie(frame(spark, rows)).collect()), key=repr) == brute(rows)


def test_repeated_rows_are_turns(spark):
    rows = [(0, 5, "user", "again")] * 12 + [(5, 5, "user", "again")] * 11
    assert sorted(map(tuple, prefix_trie(frame(spark, rows), walk=2).collect()), key=repr) == brute(rows)


def test_roles_and_texts_do_not_run_together(spark):
    rows = [(0, 0, "ab", "c"), (5, 0, "a", "bc"), (10, 0, "", "abc")]
    assert sorted(map(tuple, prefix_trie(frame(spark, rows)).collect()), key=repr) == brute(rows)


@pytest.mark.parametrize("walk", [1, 5, 1000])
def test_list_ranking(spark, walk):
    r = random.Random(walk)
    order = list(range(200))
    r.shuffle(order)
    weight = {a: r.randint(0, 9) for a in order}
    rows = [(a, order[i - 1] if i else None, order[i + 1] if i < 199 else None, weight[a], 1) for i, a in enumerate(order)]
    got = {x.arc: (x.leaves, x.saved) for x in ranked(spark.createDataFrame(rows, "arc long, before long, after long, leaves long, saved long"), walk).collect()}
    assert got == {a: (sum(weight[b] for b in order[i:]), 200 - i) for i, a in enumerate(order)}
