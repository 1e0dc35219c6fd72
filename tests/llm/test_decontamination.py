import random

import numpy as np

from tivlens.llm.decontamination import align, contaminated

rng = random.Random(4)
COMMON = ["the", "of", "and", "to", "in"]
RARE = [f"term{k}" for k in range(3000)]
DOCS = "doc_id long, text string, score double, item_id string"


def prose(n):
    return [rng.choice(COMMON) if rng.random() < 0.4 else rng.choice(RARE) for _ in range(n)]


def edited(words, share):
    out = []
    for w in words:
        r = rng.random()
        if r < share:
            out.extend([] if r < share / 3 else [rng.choice(RARE)] if r < share * 2 / 3 else [w, rng.choice(RARE)])
        else:
            out.append(w)
    return out


def full(item, text):
    """Smith-Waterman by its definition."""
    rows = [[0] * (len(text) + 1) for _ in range(len(item) + 1)]
    for i, a in enumerate(item, 1):
        for j, b in enumerate(text, 1):
            rows[i][j] = max(0, rows[i - 1][j - 1] + (2 if a == b else -1), rows[i - 1][j] - 1, rows[i][j - 1] - 1)
    return max(map(max, rows))


def test_alignment_equals_its_definition():
    for _ in range(60):
        item = np.array([rng.randrange(5) for _ in range(rng.randrange(1, 12))])
        text = np.array([rng.randrange(-1, 5) for _ in range(rng.randrange(1, 25))])
        score, start, end = align(item, text)
        assert score == full(item, text)
        assert score == 0 or full(item, text[start:end]) == score


def test_finds_copies_and_leaves_others(spark):
    items = [prose(n) for n in (15, 30, 45, 60)] + [["the", "of", "and", "to"], ["term1"], []]
    docs, want = [], {}
    for k in range(160):
        text, item = prose(rng.choice([5, 80, 400])), k % 4
        if k % 2:
            at = rng.randrange(len(text))
            text[at:at] = edited(items[item], rng.choice([0, 0.1, 0.2]))
            want[k] = item
        docs.append((k, " ".join(text).upper() if k % 3 else "\n".join(text), 0.0, "x"))
    docs += [(900, None, 0.0, "x"), (901, "", 0.0, "x"), (None, " ".join(items[0]), 0.0, "x"), (902, "The OF and to", 0.0, "x")]
    bench = spark.createDataFrame([(k, " ".join(i)) for k, i in enumerate(items)] + [(77, None)], "item_id long, text string")
    rows = contaminated(spark.createDataFrame(docs, DOCS), bench).where("item_id <> 5").collect()
    found = {(r.doc_id, r.item_id) for r in rows}
    assert set(want.items()) <= found
    brute = {(d, k) for d, t, *_ in docs if t for k, i in enumerate(items) if len(i) > 10
             and full(i, [w.lower() for w in t.split()]) >= len(i)}
    # the item of frequent words has no rare n-gram: three of its words in a row are its seed
    assert {x for x in found if x[1] != 4} == brute and (902, 4) in found
    exact = [r for r in rows if r.doc_id is None]
    assert [(r.score, r.start_word, r.end_word) for r in exact] == [(1.0, 0, 15)]


def test_blocks_and_empty_tables(spark):
    bench = spark.createDataFrame([(k, " ".join(RARE[10 * k:10 * k + 10])) for k in range(6)], "item_id long, text string")
    docs = spark.createDataFrame([(k, " ".join(RARE[10 * k:10 * k + 10]), 0.0, "") for k in range(9)], DOCS)
    found = contaminated(docs, bench, block=2)
    assert sorted((r.doc_id, r.item_id) for r in found.collect()) == [(k, k) for k in range(6)]
    assert contaminated(docs.limit(0), bench).count() == 0
    assert contaminated(docs, bench.limit(0)).count() == 0


def test_equals_full_alignment_for_heavily_edited_copies(spark):
    items = [prose(n) for n in (3, 4, 6, 7, 8, 9, 10, 12, 20, 31)] + [[rng.choice(COMMON) for _ in range(n)] for n in (5, 9)]
    docs = []
    for item in items:
        docs.append(sum(([w] if k % 2 == 0 else [w, "inserted"] for k, w in enumerate(item)), []))
        docs.append([w if k % 3 < 2 else "replaced" for k, w in enumerate(item)])
        docs.append([w for k, w in enumerate(item) if k % 4 < 3])
        docs.append(sum(([w, "x"] for w in item), []))
        docs.extend(prose(rng.choice([0, 30])) + edited(item, rng.choice([0.3, 0.4])) + prose(30) for _ in range(12))
    bench = spark.createDataFrame([(k, " ".join(i)) for k, i in enumerate(items)], "item_id long, text string")
    rows = contaminated(spark.createDataFrame([(k, " ".join(d), 0.0, "x") for k, d in enumerate(docs)], DOCS), bench).collect()
    want = {(d, k): s / (2 * len(i)) for d, t in enumerate(docs) for k, i in enumerate(items) if (s := full(i, t)) >= len(i)}
    assert {(r.doc_id, r.item_id): r.score for r in rows} == want
