"""The other operators against brute force, with nulls, empties, ties, repeated rows, long texts and clashing names."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from nightloom.llm import decontaminate as D
from nightloom.llm import near_dedup as N
from nightloom.llm import packing as P
from nightloom.llm import quality as Q
from nightloom.llm import sharding as S
from nightloom.llm import token_counts as K
from nightloom.llm import url_filter as U
from nightloom.llm.exact_dedup import exact_dedup

ODD = [None, "", " ", "a", "a b", "a b", "A b c", "x " * 5000, "é è", "a\nb c"]


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def near_brute(rows, width, percent):
    sets = {}
    for i, t in rows:
        w = [bytes(c + 32 if 65 <= c <= 90 else c for c in x) for x in (t or "").encode().split()]
        sets[i] = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(sets, 2):
        n = len(sets[a] & sets[b])
        if sets[a] and sets[b] and 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return sorted(((i, len(s), find(i), find(i) == i) for i, s in sets.items()), key=repr)


def near_texts(seed, copies):
    r = random.Random(seed)
    out = list(ODD)
    for _ in range(6):
        base = [f"w{r.randrange(60)}" for _ in range(r.randint(5, 80))]
        for _ in range(copies):
            t = list(base)
            for _ in range(r.randint(0, max(1, len(t) // 8))):
                t[r.randrange(len(t))] = f"w{r.randrange(60)}"
            out.append(" ".join(t))
    return list(enumerate(out))


def test_near_dedup_equals_brute_force(docs, monkeypatch):
    rows = near_texts(1, 12)
    assert rows_of(N.near_dedup(docs(rows, clash=True))) == near_brute(rows, 2, 80)
    assert rows_of(N.near_dedup(docs(rows), width=5)) == near_brute(rows, 5, 80)
    monkeypatch.setattr(N, "SMALL", 4)
    monkeypatch.setattr(N, "BLOCK", 8)  # clusters of many blocks, with rows outside the commonest component
    rows = near_texts(2, 40)
    assert rows_of(N.near_dedup(docs(rows))) == near_brute(rows, 2, 80)


def test_pairs_of_large_nodes_meet(docs, monkeypatch):
    # one tree, which misses a pair of this similarity by its branching once in thousands; all documents share a passage
    monkeypatch.setattr(N, "SMALL", 4)
    monkeypatch.setattr(N, "trees_for", lambda share: 1)
    r = random.Random(6)
    passage = [f"p{i}" for i in range(75)]
    rows = []
    for i in range(150):
        own = [f"w{r.randrange(10**6)}" for _ in range(37)]
        rows += [(2 * i + j, " ".join([*passage, *own, f"last{j}"])) for j in range(2)]
    assert rows_of(N.near_dedup(docs(rows))) == near_brute(rows, 2, 80)


@pytest.mark.parametrize("walk", [0, 7, 10_000])
def test_components(spark, monkeypatch, walk):
    """Paths, stars, a ring and repeated links, contracted to nothing, to a few links, or joined at once."""
    monkeypatch.setattr(N, "WALK", walk)
    r = random.Random(3)
    name = list(range(1000, 1300))
    r.shuffle(name)
    links = [(name[i], name[i + 1]) for i in range(60)] + [(name[70], name[i]) for i in range(71, 120)] + [(name[200 + i], name[200 + (i + 1) % 40]) for i in range(40)]
    links += [(name[130], name[130]), (name[200], name[201])]
    want = {}
    for group in (range(61), range(70, 120), range(200, 240)):
        want |= {name[i]: min(name[k] for k in group) for i in group}
    got = N.components(spark.createDataFrame(links, "u long, v long")).collect()
    assert {x.rid: x.label for x in got} == want and len(got) == len(want)
    assert N.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_large_nodes_branch_on(docs, monkeypatch):
    """Many unlinked documents share a passage: nodes branch to the deepest level, and the few links are found."""
    monkeypatch.setattr(N, "SMALL", 8)
    monkeypatch.setattr(N, "FEW", 4)
    monkeypatch.setattr(N, "BLOCK", 16)
    r = random.Random(8)
    passage = [f"p{i}" for i in range(60)]
    rows = []
    for i in range(120):
        own = [f"w{r.randrange(10**6)}" for _ in range(40)]
        rows += [(2 * i + j, " ".join([*passage, *own[: 40 - 4 * j], *(f"x{j}{i}{k}" for k in range(4 * j))])) for j in range(1 + (i % 3 == 0))]
    assert rows_of(N.near_dedup(docs(rows))) == near_brute(rows, 2, 80)


def test_near_copies_are_looked_up_by_part(docs, monkeypatch):
    """Nodes of near-copies, up to 64 for each document, look up what their blocks connect and not each document."""
    monkeypatch.setattr(N, "SMALL", 16)
    r = random.Random(9)
    base = [f"b{i}" for i in range(120)]
    rows = []
    for i in range(300):
        text = list(base)
        text[r.randrange(120)] = f"x{i}"
        rows.append((i, " ".join(text)))
    table = docs(rows)
    looked_up = []
    joined = type(table).join

    def counted(self, other, on=None, how=None):
        out = joined(self, other, on, how)
        if how == "left":
            looked_up.append(out.count())
        return out

    monkeypatch.setattr(type(table), "join", counted)
    got = rows_of(N.near_dedup(table))
    monkeypatch.undo()
    assert got == near_brute(rows, 2, 80) and {x[2] for x in got} == {0}
    assert sum(looked_up) < 10 * len(rows)


@pytest.mark.parametrize("few", [4, 512])
def test_open_nodes_from_block_parts(spark, monkeypatch, few):
    """Nodes of several clusters are open, with the documents that the blocks counted; equal nodes are compared once."""
    monkeypatch.setattr(N, "SMALL", 4)
    monkeypatch.setattr(N, "FEW", few)
    sketch = spark.createDataFrame([(i, 100, bytes([i // 6]) * N.SKETCH) for i in range(30)], "rid long, n long, sketch binary")
    held = {7: range(30), 8: range(30), 9: range(6), 10: range(3), 11: range(4, 13)}
    rows = [(path, rid, len(rids), -(-len(rids) // 2) if len(rids) > 4 else 1) for path, rids in held.items() for rid in rids]
    nodes = spark.createDataFrame(rows, "path long, rid long, m long, blocks int").withColumn("block", N.block_of("rid", "blocks"))
    near, parts = N.in_blocks(nodes, sketch, 80)
    assert {(x.u // 6, x.u < x.v) for x in near.collect()} <= {(x.v // 6, True) for x in near.collect()}
    size = {x.path: x["sum(size)"] for x in parts.groupBy("path").sum("size").collect()}
    assert size == {path: len(rids) for path, rids in held.items() if len(rids) > 4}
    labels = spark.createDataFrame([(i, i - i % 6) for i in range(30)], "rid long, label long")
    got = {(x.path, x.m, x.strays) for x in N.open_nodes(N.clustered(parts, labels)).collect()}
    assert got == {(7, 30, 24), (11, 9, 3)} | ({(8, 30, 24)} if few == 4 else set())


def thue_morse(n, one, two):
    return [two if bin(i).count("1") % 2 else one for i in range(n)]


def test_only_what_a_join_needs_is_dealt(spark):
    """Texts outside clusters and tokens of other levels stay where they are."""
    rows = spark.range(5000).withColumnRenamed("id", "rid").withColumn("text", F.lit("x"))
    left = N.among(rows, rows.filter("rid % 50 = 0"))
    assert left.columns == ["rid", "text"] and left.filter("rid % 50 = 0").count() == 100 and left.count() < 110
    per = N.DEEPEST * N.BRANCHES
    groups = spark.createDataFrame([(1, list(range(N.SKETCH)))], "rid LONG, tokens ARRAY<INT>")
    got = groups.select(N.level_tokens(3, 2)).first()[0]
    assert got == [tree * per + 3 * N.BRANCHES + k for tree in range(N.SKETCH // per) for k in range(2 * N.BRANCHES)]


def test_names_of_periodic_words_differ(docs):
    """Thue-Morse strings and their complements share every polynomial name modulo 2**64."""
    for n in (1024, 4096):
        one, two = "".join(thue_morse(n, "a", "b")), "".join(thue_morse(n, "b", "a"))
        rows = [(0, one), (1, two), (2, "x " + one), (3, "x " + two), (4, "x " + one + " ")]
        assert rows_of(N.near_dedup(docs(rows))) == near_brute(rows, 2, 80)


def test_near_dedup_empty_and_repeated(docs, sample):
    assert N.near_dedup(sample.limit(0)).count() == 0
    got = N.near_dedup(docs([(3, "a b c"), (3, "a b c"), (5, "a b c"), (5, "q r s"), (7, None)]))
    assert rows_of(got) == [(3, 2, 3, True), (3, 2, 3, True), (5, 2, 3, False), (5, 2, 5, True), (7, 0, 7, True)]


def test_trees_reach_the_wanted_recall():
    assert N.trees_for(0.8) * N.DEEPEST * N.BRANCHES <= N.SKETCH and 0.0625 ** N.trees_for(0.8) < 1e-9


def test_exact_dedup(docs, sample):
    rows = [(i, t) for i, t in enumerate(ODD * 3)]
    for digest in (None, lambda t: F.lit(b"x"), lambda t: F.substring(t, 1, 1).cast("binary")):  # also where digests say nothing
        got = exact_dedup(docs(rows, clash=True), **({"digest": digest} if digest else {}))
        groups = defaultdict(list)
        for i, t in rows:
            groups[t or ""].append(i)
        want = [(i, max(groups[t or ""]), len(groups[t or ""]), i == max(groups[t or ""]), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows]
        assert rows_of(got) == sorted(want, key=repr)
    assert exact_dedup(sample.limit(0)).count() == 0
    assert rows_of(exact_dedup(docs([(1, "t"), (1, "t"), (0, "t")])).select("doc_id", "keep_id", "group_size", "kept")) == [(0, 1, 3, False), (1, 1, 3, True), (1, 1, 3, True)]


def test_long_lengths_have_boundaries_of_their_own(docs):
    assert P.boundaries([513, 514], [20, 1], 2) == [513, 514]
    got = P.pack(docs([" ".join(["w"] * 513)] * 20 + [" ".join(["w"] * 514)]), buckets=2).collect()
    assert sum(x.padding for x in got) == 0


def test_stored_map_is_edited(docs, folder):
    """A second call starts from the last version; one more shard takes slots, and nothing else moves."""
    df = docs([f"text {i} " * (i % 17) for i in range(300)])
    read = lambda v: {r.vslot: r.shard for r in df.sparkSession.read.parquet(f"{folder}/version={v}").collect()}
    S.shard_documents(df, 4, slots=64, map_folder=folder).count()
    first = read(1)
    S.shard_documents(df, 4, slots=64, map_folder=folder).count()
    assert read(1) == first and read(2) == first
    grown = S.shard_documents(df, 5, slots=64, map_folder=folder)
    moved = {s: h for s, h in read(3).items() if first[s] != h}
    assert moved and set(moved.values()) == {4} and {r.shard for r in grown.collect()} == set(range(5))
    with pytest.raises(ValueError):
        S.shard_documents(df, 3, slots=64, map_folder=folder)


def test_sharding(docs, sample, folder):
    got = S.shard_documents(sample, 24, map_folder=folder).collect()
    text = {r.doc_id: r.text for r in sample.collect()}
    assert sorted(r.doc_id for r in got) == sorted(text)
    load = Counter()
    for r in got:
        body = (text[r.doc_id] or "").encode()
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(body) + 8, zlib.crc32(body), "bytes", None)
        load[r.shard] += r["size"]
    largest = max(r["size"] for r in got)
    assert set(load) == set(range(24)) and max(load.values()) <= max(sum(load.values()) / 24 * 1.05, largest)
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert S.shard_documents(docs(ODD * 2, clash=True), 24).count() == 20 and S.shard_documents(sample.limit(0), 24).count() == 0
    assert len({r.shard for r in S.shard_documents(docs([(1, "a"), (1, "a"), (None, None)]), 2, slots=4).collect()}) <= 2


def test_shard_map_edits():
    r = random.Random(2)
    size = [r.randint(0, 1000) for _ in range(512)]
    first = S.even_map(512, 8)
    edited = S.rebalance(first, size, 8)
    load = [sum(s for s, h in zip(size, edited) if h == k) for k in range(8)]
    assert max(load) - min(load) <= 8 and sum(a != b for a, b in zip(first, edited)) < 256
    grown = S.grow(edited, size, 8)
    assert all(b == a or b == 8 for a, b in zip(edited, grown)) and sum(s for s, h in zip(size, grown) if h == 8) > 0.9 * sum(size) / 9


def test_url_rules_and_templates(spark):
    urls = ["http://A.Org/x", "https://b.example.org/es/1?q", "http://example.org/en/12", "http://example.org", "http://c.com/fr/#a", "http://c.com/de/1", "x", None, "a://", "http://h.net/en/1"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("host", F.lit(1)).withColumn("n", F.lit(2))
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in U.judge_urls(pages).collect()}
    assert got[0] == ("a.org", "/x", "org/", "allow") and got[1] == ("b.example.org", "/es/1", "example.org/es/", "block")
    assert got[2][2:] == ("example.org/en/1", "block") and got[3][:3] == ("example.org", "", None)
    assert got[4][1:] == ("/fr/", "com/fr/", "allow") and got[5][2:] == ("com/de/", "block")
    assert [got[k][:3] for k in (6, 7, 8)] == [("", "", None)] * 3 and len(got) == len(urls)
    many = [(i, f"http://s.com/{'de' if i % 2 else 'en'}/{i}/p") for i in range(60)] + [(100, "http://s.com/de9/1")]
    judged = U.judge_urls(spark.createDataFrame(many, "page_id long, url string")).collect()
    assert {r.template for r in judged if "/de/" in r.path} == {"s.com/de/*/~"} or len({r.template for r in judged}) < 10
    assert U.judge_urls(pages.limit(0)).count() == 0


def greedy(word, first, inner):
    """Longest match by trying every length."""
    at, n = 0, 0
    while at < len(word) or not n:
        known = first if not n else inner
        end = next((e for e in range(len(word), at - 1 if not n else at, -1) if word[at:e] in known), None)
        if end is None:
            return 0
        at, n = end, n + 1
    return n


def test_token_counts_equal_greedy_matching(docs, sample):
    r = random.Random(4)
    for _ in range(40):
        pieces = {("▁" if r.random() < 0.5 else "") + "".join(r.choice("abc") for _ in range(r.randint(1, 4))) for _ in range(r.randint(1, 25))} | ({"▁"} if r.random() < 0.5 else set())
        automaton = K.Automaton(sorted(pieces))
        first, inner = {p[1:] for p in pieces if p[0] == "▁"}, {p for p in pieces if p[0] != "▁"}
        for _ in range(60):
            word = "".join(r.choice("abc") for _ in range(r.randint(1, 9)))
            assert automaton.count(word) == greedy(word, first, inner), (pieces, word)
    pieces = K.read_pieces()
    first, inner = {p[1:] for p in pieces if p[0] == "▁"}, {p for p in pieces if p[0] != "▁"}
    for r in K.token_counts(sample.limit(20)).join(sample.select("doc_id", "text"), "doc_id").collect():
        assert r.n_tokens == sum(greedy(w, first, inner) or 1 for w in r.text.encode().decode().split(" ") for w in w.split())
    got = rows_of(K.token_counts(docs(ODD, clash=True)))
    assert [x[1] for x in got] == [len((t or "").split()) for t in ODD] and K.token_counts(sample.limit(0)).count() == 0


def test_packing(docs, sample):
    r = random.Random(5)
    for _ in range(30):
        length = sorted(r.randint(0, 30) + r.choice([0, 0, 500, 20_000]) for _ in range(r.randint(1, 9)))
        tops, count = np.unique(length, return_counts=True)
        ends = P.boundaries(tops.tolist(), count.tolist(), 3)
        cost = lambda ends: sum(min(e for e in ends if e >= x) - x for x in length)
        best = min(cost((*c, length[-1])) for k in range(3) for c in combinations(sorted(set(length)), k))
        assert cost(ends) == best
    got = P.pack(sample, buckets=4, budget=2000).collect()
    assert sorted(x.doc_id for x in got) == sorted(x.doc_id for x in sample.collect())
    batches = defaultdict(list)
    for x in got:
        assert x.padding == x.bucket_length - x.length >= 0
        batches[x.bucket, x.batch].append(x)
    for rows in batches.values():
        assert sorted(x.place for x in rows) == list(range(len(rows)))
        assert len(rows) * rows[0].bucket_length <= 2000 or len(rows) == 1
    assert P.pack(sample.limit(0)).count() == 0 and P.pack(docs(ODD * 2, clash=True)).count() == 20


def test_quality_on_held_out_rows(spark):
    folder = "/root/testdata/sf0.01"
    documents, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    rows = Q.classify(documents, labels).join(labels, "doc_id").filter("held_out").collect()
    assert all((zlib.crc32(str(r.doc_id).encode()) % 5 == 0) == r.held_out for r in rows)
    assert np.mean([r.predicted == r.quality for r in rows]) > 0.95
    kept = Q.keep_good(documents, labels)
    assert kept.columns == documents.columns and 0.7 < kept.count() / documents.count() < 1


def test_quality_odd_input(docs, spark, sample):
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, None), (99, 1)], "doc_id long, quality int")
    got = Q.classify(docs(ODD, clash=True), labels).collect()
    assert len(got) == len(ODD) and all(0 <= r.score <= 1 for r in got)
    assert Q.classify(sample.limit(0), labels).count() == 0 and Q.classify(docs(ODD), labels.limit(0)).count() == len(ODD)


def edits(pattern, text):
    """Least edits of the pattern against any stretch of the text."""
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        new = [i]
        for j, t in enumerate(text, 1):
            new.append(min(row[j - 1] + (p != t), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def test_leaks_equal_alignment_of_every_window(docs, spark, sample):
    r = random.Random(6)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(2, 7)))
    items = [" ".join(word() for _ in range(n)) for n in (8, 25, 40)] + ["tiny", "", None]
    texts = list(ODD)
    for t in items[:3]:
        for n in (0, 3, 8, 14, 30):
            copy = list(t[: r.choice([110, 400])])
            for _ in range(n):
                at = r.randrange(len(copy))
                copy[at : at + r.choice([0, 1])] = r.choice(["", "z", "y"])
            texts.append(" ".join(word() for _ in range(r.randint(0, 30))) + " " + "".join(copy).upper() + "\n" + " ".join(word() for _ in range(9)))
    texts.append("a Tiny thing")
    table = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(x.doc_id, x.item_id) for x in D.find_leaks(docs(texts, clash=True), table).collect()}
    assert got == {(x.doc_id, x.item_id) for x in D.find_leaks(docs(texts), table, block=60).collect()}  # many blocks
    want = set()
    for k, item in enumerate(items):
        code = D.normal(item)
        for i, text in enumerate(D.normal(t) for t in texts):
            if 0 < len(code) < D.Q and code in text:
                want.add((i, k))
            if len(code) >= D.Q and any(edits("".join(map(chr, w.code)), text) <= w.edits for w in D.cover(k, D.codes(code), D.Q, D.WINDOW, D.STRIDE, D.RATE)):
                want.add((i, k))
    assert got == want and len(want) >= 8
    kept = D.drop_leaks(docs(texts), table)
    assert {x.doc_id for x in kept.collect()} == set(range(len(texts))) - {i for i, _ in want}
    assert D.find_leaks(sample.limit(0), table).count() == 0 and D.find_leaks(sample, table.limit(0)).count() == 0


def test_leaks_of_windows_at_every_start(docs, spark):
    r = random.Random(11)
    text = lambda n: "".join(r.choice("abcdefghijklmnop ") for _ in range(n))
    items = [D.normal(text(r.randint(212, 394))) for _ in range(5)]
    texts, copied = [], set()
    for k, item in enumerate(items):
        for n, changes in ((100, 0), (110, 0), (149, 10), (130, 30)):
            at = r.randrange(len(item) - n + 1)
            copy = list(item[at : at + n])
            for c in r.sample(range(n), changes):
                copy[c] = r.choice(["", "z", copy[c] + "y"])
            if changes <= 10:
                copied.add((len(texts), k))
            texts.append("".join([text(60), *copy, text(60)]))
    table = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(x.doc_id, x.item_id) for x in D.find_leaks(docs(texts), table).collect()}
    want = {
        (i, k) for k, item in enumerate(items) for i, t in enumerate(map(D.normal, texts)) if i // 4 == k
        and any(edits(item[s : s + D.WINDOW], t) <= D.RATE * D.WINDOW for s in range(len(item) - D.WINDOW + 1))
    }
    # a copy that begins or ends with a blank may lose it to its surroundings, at the cost of an edit more
    assert got == want and len(copied - got) <= 2


def test_pipeline_stages_keep_their_contract(spark, sample, docs):
    pipeline = pytest.importorskip("corpus_pipeline")
    folder = "/root/testdata/sf0.001"
    have = sample
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, have, folder)
        assert out.columns == sample.columns, name
        before, after = {tuple(r) for r in have.collect()}, [tuple(r) for r in out.collect()]
        assert after and set(after) <= before and len(after) == len(set(after))
        have = spark.createDataFrame(after, sample.schema)
    assert pipeline.STAGES[-1][1](spark, have, folder).count() == have.count()
    twice = docs([(1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f"), (3, None)])
    assert sorted(r.doc_id for r in pipeline.exact_stage(spark, twice, folder).collect()) == [2, 3]


def test_pipeline_decides_rows_that_share_an_id(spark, docs, folder):
    """An id that occurs twice: each of its rows is judged by its own text; an empty table stays empty."""
    pipeline = pytest.importorskip("corpus_pipeline")
    shared = docs([(1, "a b c"), (2, "a b c"), (1, "x y z"), (None, "x y z"), (None, "only")], clash=True)
    got = pipeline.exact_stage(spark, shared, folder)
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=repr) == [(1, "x y z"), (2, "a b c"), (None, "only")]
    assert got.columns == shared.columns
    near = [(4, " ".join(f"w{i}" for i in range(40))), (4, " ".join(f"w{i}" for i in range(41))), (9, "else")]
    assert sorted(r.text for r in pipeline.near_stage(spark, docs(near), folder).collect()) == sorted(["else", near[0][1]])
    assert pipeline.exact_stage(spark, shared.limit(0), folder).count() == 0


def test_quality_scores_equal_dense_densities(spark, sample):
    """The scores against Gaussian log-densities of standardized features, by plain matrices."""
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    x = {r.doc_id: np.array(r.x) for r in Q.features(sample).collect()}
    y = {r.doc_id: r.quality for r in labels.collect() if r.quality in (0, 1) and r.doc_id in x and zlib.crc32(str(r.doc_id).encode()) % 5}
    ids = sorted(y)
    train, kind = np.array([x[i] for i in ids]), np.array([y[i] for i in ids])
    z = (train - train.mean(0)) / np.sqrt(np.maximum(train.var(0), 1e-9))
    p = z.shape[1]
    cov = [np.cov(z[kind == c].T, bias=True) for c in (0, 1)]
    both = sum((kind == c).mean() * cov[c] for c in (0, 1))

    def density(v, c):
        s = (1 - Q.POOLED) * cov[c] + Q.POOLED * both
        s = (1 - Q.SPHERE) * s + (Q.SPHERE * np.trace(s) / p + 1e-6) * np.eye(p)
        d = v - z[kind == c].mean(0)
        return np.log((kind == c).mean()) - 0.5 * np.linalg.slogdet(s)[1] - 0.5 * d @ np.linalg.solve(s, d)

    for r in Q.classify(sample, labels).collect():
        v = (x[r.doc_id] - train.mean(0)) / np.sqrt(np.maximum(train.var(0), 1e-9))
        assert r.score == pytest.approx(1 / (1 + np.exp(-np.clip(density(v, 1) - density(v, 0), -500, 500))), abs=1e-6)
