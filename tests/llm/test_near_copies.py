"""Near copies by exact Jaccard similarity against all pairs."""

import random

import numpy as np

from verishelf.llm.simhash import drop_near_copies, hub_pairs, prefix_of, shingle_set, near_copy_classes


def _shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def _roots(texts, linked):
    root = list(range(len(texts)))
    find = lambda x: x if root[x] == x else find(root[x])
    for a in range(len(texts)):
        for b in range(a):
            if linked(texts[a], texts[b]):
                root[max(find(a), find(b))] = min(find(a), find(b))
    return [find(x) for x in range(len(texts))]


def _similar(a, b):
    return a == b or (bool(a and b) and 5 * len(a & b) >= 4 * len(a | b))


def _corpus(rng):
    word = lambda: f"w{rng.randint(0, 5000)}"
    texts = [None, "", "One two", "one TWO", "one two three", "a b c d e", "a b c d e f", "a b c d e f g h i", "b c d e f g h i"]
    for _ in range(40):
        w = [word() for _ in range(rng.choice([12, 40, 150]))]
        texts.append(" ".join(w))
        for _ in range(4):  # similarities of about 0.6 to 0.95
            v = list(w)
            for _ in range(max(1, round(len(v) * rng.uniform(0.005, 0.06)))):
                v[rng.randrange(len(v))] = word()
            texts.append(" ".join(v))
    core = [word() for _ in range(20)]
    texts += [" ".join(core + [word() for _ in range(4)]) for _ in range(120)]  # 16 of 20 shared: 0.667
    dense = [word() for _ in range(60)]
    for _ in range(60):
        v = list(dense)
        for _ in range(rng.randint(0, 2)):
            v[rng.randrange(60)] = word()
        texts.append(" ".join(v))
    return texts


def test_links_are_those_of_all_pairs(spark):
    texts = _corpus(random.Random(8))
    sets = [_shingles(t) for t in texts]
    want = _roots(sets, _similar)
    pairs = [len(a & b) / len(a | b) for i, a in enumerate(sets) for b in sets[:i] if a & b]
    assert sum(0.6 <= p < 0.8 for p in pairs) > 100 and sum(0.8 <= p < 0.9 for p in pairs) > 100
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for sample in (20_000, 40, 1):
        got = {r["doc_id"]: r["component_id"] for r in near_copy_classes(df, sample=sample).collect()}
        assert [got[i] for i in range(len(texts))] == want
    assert sorted(r["doc_id"] for r in drop_near_copies(df).collect()) == sorted(set(want))


def test_a_template_costs_no_pairs():
    rng = random.Random(5)
    core = [f"c{i}" for i in range(20)]
    sets = [shingle_set(" ".join(core + [f"u{rng.randint(0, 10**9)}" for _ in range(4)]).encode()) for _ in range(300)]
    seen, count = np.unique(np.concatenate(sets), return_counts=True)
    rows = sorted((int(t), i, len(s), k, i) for i, s in enumerate(sets) for k, t in enumerate(prefix_of(s, (seen[count > 1], count[count > 1]), 4, 5).tolist()))
    columns = [np.array(c) for c in zip(*rows, strict=True)]
    assert not sum(len(a) for a, _ in hub_pairs(*columns, (0, 1 << 62), 4, 5))
