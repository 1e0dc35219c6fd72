import random

import numpy as np

from tivlens.llm import minhash
from tivlens.llm.components import components

SCHEMA = "doc_id long, text string, keys string, component string"


def brute(rows, size, percent):
    sets = {}
    for d, t in rows:
        w = (t or "").encode().lower().split()
        if w:
            k = min(size, len(w))
            sets.setdefault(d, set()).update(tuple(w[i:i + k]) for i in range(len(w) - k + 1))
    root = {d: d for d, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            common = len(sets[a] & sets[b])
            if 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d: (len(sets.get(d, ())), find(d), find(d) == d) for d, _ in rows}


def made(seed=3):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(4000)]
    rows = [(0, None), (1, ""), (2, " \n"), (3, "One two"), (4, "one TWO"), (5, "one two three"), (6, "a b c d"), (7, "A b c d")]
    for group in range(25):
        base = [rng.choice(words) for _ in range(rng.choice([8, 40, 150]))]
        for _ in range(12):
            copy = [rng.choice(words) if rng.random() < rng.choice([0, 0.01, 0.03, 0.06]) else w for w in base]
            rows.append((len(rows), " ".join(copy)))
    near = [rng.choice(words) for _ in range(60)]  # a chain: each step is near, its ends are not
    for _ in range(15):
        near = near[1:] + [rng.choice(words)]
        rows.append((len(rows), " ".join(near)))
    return rows


def test_matches_brute_force(spark):
    rows = made()
    df = spark.createDataFrame([(d, t, "x", "y") for d, t in rows], SCHEMA)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(df, size=4).collect()}
    assert got == brute(rows, 4, 80)


def test_pairs_left_for_the_last_step(spark, monkeypatch):
    monkeypatch.setattr(minhash, "ROUNDS", 0)
    rows = made(5)
    df = spark.createDataFrame([(d, t, "x", "y") for d, t in rows], SCHEMA)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(df, size=5).collect()}
    assert got == brute(rows, 5, 80)


def test_repeated_rows_null_ids_and_empty_table(spark):
    rows = [(None, "a b c d e f", "", ""), (9, "a b c d e f", "", ""), (9, "a b c d e f", "", ""), (8, "a b c d e f", "", "")]
    df = spark.createDataFrame(rows, SCHEMA)
    got = sorted((r.doc_id or 0, r.component_id or 0, r.kept) for r in minhash.near_duplicates(df).collect())
    assert got == [(0, 0, True), (8, 8, True), (9, 8, False), (9, 8, False)]
    assert minhash.near_duplicates(df.limit(0)).count() == 0


def test_values_agree_as_often_as_sets_overlap():
    rng = np.random.default_rng(1)
    shares = []
    for _ in range(60):
        x = rng.integers(0, 2**64, 400, dtype=np.uint64)
        a, b = minhash.signature(x[:360]), minhash.signature(x[40:])
        shares.append((a == b).mean())
    assert abs(np.mean(shares) - 0.8) < 0.01 and np.std(shares) < 0.04
    keys = minhash.bands(np.stack([a, a]))
    assert (keys[0] == keys[1]).all() and len(set(keys[0])) == minhash.BANDS


def test_components(spark):
    rng = random.Random(2)
    links = [(k, k + 1) for k in range(100, 140)] + [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(7, 7)]
    got = {r.vertex: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    root = {}
    for a, b in links:
        root.setdefault(a, a), root.setdefault(b, b)
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(root[a], root[b])
            changed |= root[a] != low or root[b] != low
            root[a] = root[b] = low
    assert got == {k: v for k, v in root.items() if k != v}
