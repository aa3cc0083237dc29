"""Repeat removal against brute force over every window."""

import hashlib
import random
from collections import Counter

import numpy as np

from nightloom.llm import suffix_dedup as S
from nightloom.llm.substring_dedup import substring_dedup


def brute(units_of, rows, span):
    units = [(i, units_of(t)) for i, t in rows]
    seen = Counter(tuple(u[s : s + span]) for _, u in units for s in range(len(u) - span + 1))
    for i, u in units:
        gone = [False] * len(u)
        for s in range(len(u) - span + 1):
            if seen[tuple(u[s : s + span])] > 1:
                gone[s : s + span] = [True] * span
        yield i, u, gone


def brute_words(rows, span):
    for i, u, gone in brute(lambda t: (t or "").encode().split(), rows, span):
        kept = b" ".join(w for w, g in zip(u, gone) if not g)
        yield i, len(u), sum(gone), hashlib.sha256(kept).hexdigest()


def brute_bytes(rows, span):
    for i, u, gone in brute(lambda t: (t or "").encode(), rows, span):
        kept = bytes(b for b, g in zip(u, gone) if not g)
        runs = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        yield i, len(u), sum(gone), runs, hashlib.sha256(kept).hexdigest()


def got(df, *names):
    return sorted(tuple(r) for r in df.select(*names).collect())


def words(df, span):
    return got(substring_dedup(df, span=span), "doc_id", "n_words", "n_removed", "kept_sha256")


def bytes_(df, span, gram):
    return got(S.suffix_dedup(df, span=span, gram=gram), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def texts(seed):
    """Few words, copies, near copies, runs of one word, periods, nulls, empties and a long text."""
    r = random.Random(seed)
    vocab = [chr(97 + i) * (1 + i % 3) + ("é" if i % 5 == 0 else "") for i in range(25)]
    out = [None, "", " \t\n", "a", "a " * 60, "a " * 45 + "b", "ab cd " * 50, "b " + "a " * 20 + "cd ef gh ij kl mn op qr"]
    out += ["b " + "a " * 20 + "cd ef gh ij kl mn op qr st uv"]
    for _ in range(30):
        t = [r.choice(vocab) for _ in range(r.randint(1, 150))]
        out += [" ".join(t)] * r.choice([1, 1, 2])
        if r.random() < 0.5:
            t[r.randrange(len(t))] = "X"
            out.append("\n".join(t))
        if r.random() < 0.5:
            at = r.randrange(len(t))
            out.append(" ".join(r.choice(vocab) for _ in range(20)) + "  " + " ".join(t[at : at + 40]))
    out.append(" ".join(r.choice(vocab) for _ in range(3000)) + " " + out[20])
    return out


def test_words_equal_brute_force(docs, sample):
    for seed, span in ((1, 35), (2, 8), (3, 3), (4, 1)):
        rows = list(enumerate(texts(seed)))
        assert words(docs(rows, clash=seed % 2 == 0), span) == sorted(brute_words(rows, span)), span
    rows = [(r.doc_id, r.text) for r in sample.collect()]
    assert words(sample, 35) == sorted(brute_words(rows, 35))


def test_bytes_equal_brute_force(docs, sample):
    for seed, span, gram in ((5, 40, 20), (6, 12, 4), (7, 200, 100), (8, 30, 30)):
        rows = list(enumerate(texts(seed)))
        assert bytes_(docs(rows, clash=seed % 2 == 0), span, gram) == sorted(brute_bytes(rows, span)), span
    rows = [(r.doc_id, r.text) for r in sample.collect()]
    assert bytes_(sample, 200, 100) == sorted(brute_bytes(rows, 200))


def test_large_anchor_is_cut_into_shards(docs, monkeypatch):
    """One passage with another surrounding in each row: many different pieces under few anchors."""
    monkeypatch.setattr(S, "SHARD_PIECES", 8)
    r = random.Random(3)
    passage = "".join(r.choice("abcdef ") for _ in range(90))
    rows = [(i, "".join(r.choice("xyz") for _ in range(5)) + passage + "".join(r.choice("xyz") for _ in range(4))) for i in range(150)]
    assert bytes_(docs(rows), 60, 40) == sorted(brute_bytes(rows, 60))
    assert bytes_(docs(rows), 92, 40) == sorted(brute_bytes(rows, 92))


def test_repeated_rows_and_missing_ids(docs):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (1, "q r s t"), (None, "z y x w"), (None, "c d e f")]
    have = words(docs(rows).fillna(-1, ["doc_id"]), 3)
    assert have == sorted((i if i is not None else -1, *x) for (i, _), (_, *x) in zip(rows, brute_words(rows, 3)))


def test_periodic_texts_do_not_collide(docs):
    """Thue-Morse strings and their complements share every polynomial name modulo 2**64."""
    flip = [bin(i).count("1") % 2 for i in range(4096)]
    long = ["".join("ab"[f ^ c] for f in flip[:n]) for n in (1024, 4096) for c in (0, 1)]
    same = " ".join(f"w{i}" for i in range(34))
    rows = list(enumerate([f"{same} {x}" for x in long] + [" ".join(("p", "q")[f ^ c] for f in flip[:1024]) for c in (0, 1)]))
    assert words(docs(rows), 35) == sorted(brute_words(rows, 35))
    rows = list(enumerate(["".join("ab"[f ^ c] for f in flip[:n]) + tail for n, tail in ((1024, "x"), (4096, "y")) for c in (0, 1)]))
    assert bytes_(docs(rows), 1024, 100) == sorted(brute_bytes(rows, 1024))


def test_empty_table(docs, sample):
    assert words(sample.limit(0), 35) == [] and bytes_(sample.limit(0), 200, 100) == []


def test_suffix_array_and_permuted_prefixes():
    r = random.Random(1)
    for turn in range(200):
        x = [r.randint(1, r.choice([1, 2, 3, 8])) for _ in range(r.randint(0, 90))]
        if turn % 3 == 0:
            x = (x[:7] * 40)[: len(x)]
        t = np.array([*x, 0])
        sa = S.suffix_array(t)
        assert list(sa) == sorted(range(len(t)), key=lambda i: list(t[i:]))
        prefix = S.permuted_prefixes(t, sa)
        for a, b in zip(sa, sa[1:]):
            n = 0
            while t[a + n] == t[b + n]:
                n += 1
            assert prefix[b] == n
