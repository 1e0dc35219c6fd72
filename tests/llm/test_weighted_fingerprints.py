import hashlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tivlens.llm import weighted_fingerprints as wf
from tivlens.llm.common import table

SCHEMA = "doc_id long, text string, fingerprint string, h long, uid int, own string"


def generalised_jaccard(a, b):
    x, y = (Counter(t.encode().lower().split()) for t in (a, b))
    most = sum((x | y).values())
    return sum((x & y).values()) / most if most else 1.0


def by_definition(rows):
    """(id, chars, hash, similarity to the edited text, to the next one) in descending order of distinct ids."""
    rows = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is None, -(r[0] or 0)))
    out = []
    for k, (i, t) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        cut = len(t) // 3
        edited = t[:len(t) - cut] + after[:cut]
        out.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), generalised_jaccard(t, edited),
                    generalised_jaccard(t, after)))
    return out


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "clash", 1, 2, "x") for i, t in rows], SCHEMA)


@pytest.mark.parametrize("ranges", [1, 2, 7, 40])
def test_next_document_in_any_number_of_ranges(spark, ranges):
    texts = [None, "", "a", " ", "é漢\U0001f600 x", "One two three. " * 40, "x" * 5000, "the end\nof it", "THE end of IT", "a b c d e f"]
    rows = [(3 * i - 7, texts[i % 10]) for i in range(60)] + [(None, "no id at all")]
    found = wf.edited_likeness(frame(spark, rows).repartition(5), ranges=ranges).collect()
    want = {r[0]: r[1:] for r in by_definition(rows)}
    assert len(found) == 61
    for r in found:
        n, sha, edited, after = want[r.doc_id]
        assert (r.n_chars, r.edited_sha256) == (n, sha)
        assert abs(r.near_edited - edited) < 0.25 and abs(r.near_next - after) < 0.25
        assert (r.near_next == 1.0) == (after == 1.0)


def test_one_row_and_no_row(spark):
    one = wf.edited_likeness(frame(spark, [(5, "some words here")])).collect()
    assert [(r.doc_id, r.near_next) for r in one] == [(5, 1.0)]
    assert one[0].edited_sha256 == by_definition([(5, "some words here")])[0][2]
    assert wf.edited_likeness(frame(spark, [(5, "x")]).limit(0)).count() == 0


def test_hot_id_and_copies_are_cut_between_ranges(spark):
    rows = [(7, "the very same text")] * 300 + [(7, f"text number {i}") for i in range(50)] + [(9, "first"), (1, "last")]
    rows += [(None, "missing")] * 200
    df = wf.edited_likeness(frame(spark, rows), ranges=16)
    found = df.collect()
    assert len(found) == len(rows)
    # 299 of 300 copies are followed by a copy; every row is followed by exactly one
    assert sum(r.near_next == 1.0 for r in found if r.doc_id == 7) == 299
    assert sum(r.near_next == 1.0 for r in found if r.doc_id is None) == 199
    assert len({r.fingerprint for r in found}) == 54
    dealt = df.select(F.spark_partition_id().alias("p")).groupBy("p").count().collect()
    assert max(r["count"] for r in dealt) < 5 * len(rows) / 16


def test_order_and_place_do_not_matter():
    a, b = wf.Sampler(), wf.Sampler()
    words = [f"w{i % 97}" for i in range(900)]
    b.codes(b"other words first")
    text, turned = " ".join(words), "\n".join(w.upper() for w in reversed(words))
    assert wf.as_text(a.codes(text.encode())) == wf.as_text(b.codes(turned.encode()))
    assert a.codes(b" \n ") is None and wf.alike(None, None) == 1.0 and wf.alike(None, a.codes(b"x")) == 0.0


def test_memory_is_bounded(monkeypatch):
    whole = wf.Sampler().codes(" ".join(f"v{i}" for i in range(700)).encode())
    monkeypatch.setattr(wf, "KNOWN", 60)
    monkeypatch.setattr(wf, "BLOCK", 50)
    small = wf.Sampler()
    assert (small.codes(" ".join(f"v{i}" for i in range(700)).encode()) == whole).all() and len(small.at) <= 60


def test_collisions_estimate_weighted_similarity():
    rng = np.random.default_rng(1)
    sampler, errors = wf.Sampler(), []
    for _ in range(150):
        pool = [f"w{i}" for i in rng.integers(0, 60, 300)]
        a, b = " ".join(pool[:200]), " ".join(pool[rng.integers(0, 150):])
        errors.append(wf.alike(sampler.codes(a.encode()), sampler.codes(b.encode())) - generalised_jaccard(a, b))
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 0.06  # 0.044 at most for 128 samples


def test_fingerprints_and_likeness(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    alone = wf.fingerprints(docs)
    whole = wf.edited_likeness(docs)
    both = whole.join(alone.withColumnRenamed("fingerprint", "again"), "doc_id")
    assert both.where("fingerprint = again").count() == docs.count()
    assert both.where(F.abs(wf.likeness(F.col("fingerprint"), F.col("edited_fingerprint")) - F.col("near_edited")) > 1e-12).count() == 0
    want = {r[0]: r for r in by_definition([(r.doc_id, r.text) for r in docs.collect()])}
    found = whole.collect()
    assert all(want[r.doc_id][1:3] == (r.n_chars, r.edited_sha256) for r in found)
    assert abs(np.mean([r.near_edited - want[r.doc_id][3] for r in found])) < 0.01
    assert abs(np.mean([r.near_next - want[r.doc_id][4] for r in found])) < 0.01
    assert max(abs(r.near_edited - want[r.doc_id][3]) for r in found) < 0.2
