"""Repeated strings against a plain search."""

import hashlib
import random

import numpy as np

from verishelf.llm.suffix_array import kept_digest, remove_repeats, repeated_windows, suffix_array


def test_suffix_array_order():
    rng = np.random.default_rng(2)
    for size, letters in ((1, 2), (50, 2), (400, 3), (3000, 200), (600, 1)):
        t = rng.integers(1, letters + 1, size).astype(np.uint8)
        t[rng.random(size) < 0.02] = 0
        t = np.append(t, 0).astype(np.uint8)
        sa = suffix_array(t, 40)
        assert sorted(sa.tolist()) == list(range(len(t)))
        head = [bytes(t[i:]).split(b"\0")[0][:40] for i in sa]
        assert all(a <= b for a, b in zip(head, head[1:]))


def test_windows():
    parts = [b"abcabcabcx", b"zabcabc\0", b"abcabcab"]
    got = repeated_windows(parts, np.array([1, 2, 0]), np.array([0, 5, 0]), np.array([6, 4, 4]), 5)
    seen, want = set(), {}
    order = sorted((d, s + i, k, i) for k, (d, s, n) in enumerate([(1, 0, 6), (2, 5, 4), (0, 0, 4)]) for i in range(n))
    for _, _, k, i in order:
        w = parts[k][i : i + 5]
        want[k, i] = w in seen
        seen.add(w)
    assert got.tolist() == [want[k, i] for k, n in enumerate([6, 4, 4]) for i in range(n)]


def _brute(rows, length):
    seen, out = set(), []
    for i, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        t = (text or "").encode()
        gone, own = np.zeros(len(t), dtype=bool), []
        for s in range(len(t) - length + 1):
            w = t[s : s + length]
            if w in seen:
                gone[s : s + length] = True
            seen.add(w)
            own.append(w)
        edge = np.diff(np.concatenate([[0], gone.astype(int), [0]]))
        out.append((i, len(t), int(gone.sum()), int((edge == 1).sum()), hashlib.sha256(bytes(np.frombuffer(t, dtype=np.uint8)[~gone])).hexdigest()))
    return out


def _texts(rng):
    make = lambda n: "".join(rng.choice("abcdé \n") for _ in range(n))
    shared = [make(n) for n in (60, 101, 150, 400)]
    texts = [None, "", "short", "a" * 700, "ab" * 300, make(99), make(100)]
    for _ in range(60):
        texts.append("".join(rng.choice([make(rng.randint(0, 150)), rng.choice(shared), rng.choice(shared)[: rng.randint(50, 140)]]) for _ in range(rng.randint(1, 6))))
    return texts + texts[6:14] + ["a" * 120, "x\0" * 90, "y" + "x\0" * 90]


def test_removal(spark):
    rng = random.Random(8)
    texts = _texts(rng)
    ids = rng.sample(range(-50, 1000), len(texts))
    rows = list(zip(ids, texts))
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, doc int").repartition(5)
    want = sorted(_brute(rows, 100))
    for extra in ({}, {"shard_bytes": 300, "hot_variants": 3}):
        got = kept_digest(remove_repeats(df, **extra))
        assert sorted(tuple(r) for r in got.collect()) == want
    assert remove_repeats(df.limit(0)).count() == 0


def test_repeated_rows_and_null_ids(spark):
    text = "".join(chr(97 + i * 7 % 26) + str(i) for i in range(80))
    df = spark.createDataFrame([(3, text), (3, text), (None, text), (1, text[:130])], "doc_id long, text string")
    got = sorted(((r["doc_id"] or 99, r["n_removed"]) for r in kept_digest(remove_repeats(df)).collect()))
    n = len(text)
    assert got == [(1, 0), (3, 130), (3, n), (99, n)]
