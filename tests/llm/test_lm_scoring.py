import math
from collections import Counter
from itertools import combinations

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tivlens.llm import lm_scoring
from tivlens.llm.piece_codec import model_bytes
from tivlens.llm.queries import QUERIES

PATH = public_tokenizers.path("piece_bpe_32k.model")


def test_forward_sums_over_all_segmentations():
    net = lm_scoring.Lattice(model_bytes(PATH), None)
    log = {t: v for t, (_, _, v) in zip(net.automaton.keys(), net.automaton.values(), strict=True)}
    for word in ("cat", "thanat", "ééa", "abab"):
        whole, total = "▁" + word, 0.0
        for n in range(len(whole)):
            for cuts in combinations(range(1, len(whole)), n):
                ends = [0, *cuts, len(whole)]
                parts = [whole[a:b] for a, b in zip(ends, ends[1:], strict=False)]
                if all(p in log for p in parts):
                    total += math.exp(sum(log[p] for p in parts))
        assert abs(net.log_probability(word) - math.log(total) - net.stop) < 1e-9
    rare = next(ch for ch in map(chr, range(0x4E00, 0x9FFF)) if ch not in net.known)
    by_bytes = sum(net.log[net.bytes[b]] for b in rare.encode())
    assert abs(net.log_probability("a" + rare) - net.log_probability("a") - by_bytes) < 1e-9
    counts = np.zeros(len(net.log))
    net.expect("thanat", counts)
    length = {i: len(t) for t, (_, i, _) in zip(net.automaton.keys(), net.automaton.values(), strict=True)}
    assert abs(sum(counts[i] * n for i, n in length.items()) - len("▁thanat")) < 1e-9 and counts[-1] == 1
    assert math.isfinite(net.log_probability("x" * 5000 + "\U0001f600\x00"))


def brute(rows, train):
    def tokens(t):
        return (t or "").encode().lower().split() + [None]

    c = Counter(w for k, (_, t) in enumerate(rows) if train(k) for w in tokens(t))
    n, v = c.total(), len(c)
    return [(len(tokens(t)), sum(c[w] > 0 for w in tokens(t)), n, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in tokens(t)))
            for _, t in rows]


ROWS = [(1, None), (2, ""), (3, "The cat\tsat"), (4, "the CAT sat on the mat " * 50), (5, "é漢 \U0001f600 zzqq"), (6, "the " * 3000 + "zzqq zzqq"),
        (7, "the cat"), (7, "the cat"), (None, "a b")]


@pytest.mark.parametrize("frequent", [lm_scoring.FREQUENT, 20])
@pytest.mark.parametrize("labels", [None, "lang"])
def test_base_is_the_add_one_model(spark, monkeypatch, frequent, labels):
    monkeypatch.setattr(lm_scoring, "FREQUENT", frequent)
    df = spark.createDataFrame([(k, d, t, "ab"[k % 2] if k else None, "x", 0) for k, (d, t) in enumerate(ROWS)],
                               "k int, doc_id long, text string, lang string, word string, base int")
    got = lm_scoring.score_texts(df, F.col("k") != 4, PATH, labels, id_col="k").orderBy("doc_id").collect()
    want = brute(ROWS, lambda k: k != 4)
    for r, w in zip(got, want, strict=True):
        assert (r.n_tokens, r.n_known, r.train_tokens) == w[:3] and abs(r.base_score - w[3]) < 1e-6
        assert math.isfinite(r.score) and r.score < 0
    assert abs(got[6].score - got[7].score) < 1e-9


def test_nothing_to_learn_from_and_empty_table(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string")
    rows = lm_scoring.score_texts(df, F.lit(False), PATH).collect()
    assert all(r.train_tokens == 0 and r.n_known == 0 and r.score < 0 for r in rows) and len(rows) == len(ROWS)
    assert lm_scoring.score_texts(df.limit(0), F.lit(True), PATH).count() == 0


def test_probabilities_of_known_texts_beat_the_base(spark):
    rows = QUERIES["op8_lm_scoring"](spark, "/root/testdata/sf0.001").where("not held_out").collect()
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows)


@pytest.mark.parametrize("rest", ["many labels", "no label"])
def test_rare_and_missing_labels_have_a_class(spark, rest):
    def text(label, k):
        return " ".join(f"{label}{chr(97 + (k * 7 + j * 3) % 13)}" for j in range(20))

    known = [(k, label, text(label, k)) for label in "abcdefgh" for k in range(12)]
    rare = [(k, (label if rest == "many labels" else None), text(label, k)) for label in "xyz" for k in range(8)]
    asked = [(100, None, text("x", 3)), (100, None, text("a", 3))]
    df = spark.createDataFrame(known + rare + asked, "doc_id long, lang string, text string")
    learned = F.col("doc_id") < 100

    def scores(labels):
        rows = lm_scoring.score_texts(df, learned, PATH, labels).where(~learned).collect()
        return sorted(r.score for r in rows)

    assert all(a > b + 1 for a, b in zip(scores("lang"), scores(None), strict=True))


def test_draws_of_all_words_at_once():
    log_p = np.log(np.random.default_rng(1).random((300, 3)) ** 8)
    k = np.array([1, 2, 3, 40, 41, 42, 5000, 1, 7, 2] * 30)

    def one(p, n):
        return math.log(lm_scoring.URN) + p + (math.lgamma(lm_scoring.URN * math.exp(p) + n) - math.lgamma(lm_scoring.URN * math.exp(p) + 1))

    want = [[one(p, n) for p in row] for row, n in zip(log_p.tolist(), k.tolist(), strict=True)]
    assert np.allclose(lm_scoring.drawn(log_p, k), want, rtol=1e-12, atol=1e-9)
    for none in ([], [1], [50]):
        assert lm_scoring.drawn(np.full((len(none), 2), -1.0), np.array(none, np.int64)).shape == (len(none), 2)
