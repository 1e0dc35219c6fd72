import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tivlens.llm import token_alignment as ta
from tivlens.llm.common import table
from tivlens.llm.piece_codec import model_bytes
from tivlens.llm.pieces import processor

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
LIB_A, LIB_B = Tokenizer.from_file(A), processor(model_bytes(B))
LIB_A.encode_special_tokens = True
TEXTS = [None, "", " ", "  ", "a", "  two  spaces ", "end ", "tab\t here\n  and\n\nthere \r\n x", "don't you'll ",
         "<|endoftext|> <s></s><unk> <0x0A>", "é漢字 \U0001f600 ﬁ\x00 x", "marker ▁ inside", "a\u00a0 b\u2003 c\u180e d\u200b e \x1c f",
         "x" * 3000 + " y", "Words and words, again and again. " * 200, "12345 67,890.12 ;\r {\r\n}", "a b", "a b"]


def by_library(text):
    """Tokens, groups and links of one text, straight from the libraries and the definition."""
    none = [], [], [], []
    if not text:
        return none
    raw = (" " + text).encode()
    letters = ta._byte_alphabet()
    a = LIB_A.encode(" " + text, add_special_tokens=False)
    b = LIB_B.encode(text)
    a_bytes = [bytes(letters[ch] for ch in t) for t in a.tokens]
    b_bytes = [bytes([int(LIB_B.id_to_piece(i)[3:5], 16)]) if LIB_B.is_byte(i) else LIB_B.id_to_piece(i).replace("▁", " ").encode()
               for i in b]
    if b"".join(a_bytes) != raw or b"".join(b_bytes) != raw:
        return none
    a_end, b_end = np.cumsum(list(map(len, a_bytes))).tolist(), np.cumsum(list(map(len, b_bytes))).tolist()
    both = sorted(set(a_end) & set(b_end))
    groups = []
    for lo, hi in zip([0, *both[:-1]], both, strict=True):
        groups.append(",".join(str(i) for i, e in zip(a.ids, a_end, strict=True) if lo < e <= hi) + "|"
                      + ",".join(str(i) for i, e in zip(b, b_end, strict=True) if lo < e <= hi))
    links, first = [], 0
    for i, e, n in zip(a.ids, a_end, map(len, a_bytes), strict=True):
        while b_end[first] <= e - n:
            first += 1
        k = first
        while k < len(b) and b_end[k] - len(b_bytes[k]) < e:
            links.append((i, b[k]))
            k += 1
    return a.ids, b, groups, links


def by_definition(rows):
    found = [(i, *by_library(t)) for i, t in rows]
    counts = Counter(x for *_, links in found for x in links)
    best = {}
    for (_, b), n in counts.items():
        best[b] = max(best.get(b, 0), n)
    return sorted(((i, len(a), len(b), len(g), len(links), sum(counts[x] == best[x[1]] for x in links),
                    sum(counts[x] for x in links), hashlib.sha256(";".join(g).encode()).hexdigest() if g else "")
                   for i, a, b, g, links in found), key=str)


def result(df):
    return sorted((tuple(r[c] for c in ("doc_id", *ta.NUMBERS, "groups_sha256")) for r in df.collect()), key=str)


@settings(max_examples=500, deadline=None)
@given(st.one_of(st.text(max_size=60), st.text("ab'st .,\n\t\r▁\u00a0\u2028é9", max_size=60)))
def test_parts_join_to_the_whole(text):
    aligner = ALIGNER
    if aligner.full:
        aligner.clear()
    a, b, groups, links = by_library(text)
    if not text:
        return
    assert " " + " ".join(ta.parts(text)) == " " + text
    at, ends, fine = aligner.place([text])
    assert bool(fine[0]) == bool(groups)
    if groups:
        assert b";".join(aligner.groups[i] for i in at).decode() == ";".join(groups)
        assert links_of(aligner, at) == links
        assert aligner.facts[at, :4].sum(axis=0).tolist() == [len(a), len(b), len(groups), len(links)]


MODELS = ta._Models(A, B)
ALIGNER = ta.Aligner(MODELS, None)


def links_of(aligner, at):
    """The links of parts, by their place among all parts' links."""
    flat = np.concatenate(aligner.links)
    ends = np.cumsum(aligner.facts[:len(aligner.at), 3])
    return [(x >> ta.B_BITS, x & (1 << ta.B_BITS) - 1) for i in at for x in flat[ends[i] - aligner.facts[i, 3]:ends[i]].tolist()]


def test_settled_characters_split_alike():
    aligner = ta.Aligner(MODELS, None)
    assert aligner.quick is not None
    for c in map(chr, range(ord(ta.SETTLED))):
        for text in (f"a{c}b 1{c}{c} x", f"{c}", f"{c}{c}9{c} ,{c}'s{c}", f"a {c} {c}{c}\n{c}b"):
            assert aligner.quick(text) == LIB_A.encode(text, add_special_tokens=False).ids, (c, text)


def test_vocabularies_that_ranks_do_not_encode():
    import json

    spec = json.loads(model_bytes(A))
    assert ta.ranks(model_bytes(A)) is not None
    merges = spec["model"]["merges"]
    merges[5], merges[6] = merges[6], merges[5]
    assert ta.ranks(json.dumps(spec).encode()) is None
    slow = ta.Aligner(MODELS, None)
    slow.quick = None
    at, _, _ = slow.place(["the same groups, without ranks"])
    quick, _, _ = ALIGNER.place(["the same groups, without ranks"])
    assert [slow.groups[i] for i in at] == [ALIGNER.groups[i] for i in quick]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, t) for k, t in enumerate(TEXTS)] + [(3, "a"), (None, "no id")]
    return rows, spark.createDataFrame([(i, t, 1, "clash", []) for i, t in rows],
                                       "doc_id long, text string, n_a int, pair string, rare array<int>")


@pytest.mark.parametrize("frequent", [1_000_000, 40, 1])  # all counts sent, some joined, nearly all joined
def test_counts_sent_and_joined_give_the_same(docs, monkeypatch, frequent):
    rows, df = docs
    monkeypatch.setattr(ta, "FREQUENT", frequent)
    assert result(ta.align(df, A, B)) == by_definition(rows)


def test_real_documents_and_a_small_memory(spark, monkeypatch):
    docs = table(spark, "/root/testdata/sf0.001", "documents").limit(60)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert result(ta.align(df, A, B)) == by_definition(rows)
    groups = {r.doc_id: r.groups for r in ta.token_groups(df, A, B).collect()}
    assert all(groups[i] == ";".join(by_library(t)[2]) for i, t in rows)


def test_memory_is_forgotten_when_full(monkeypatch):
    monkeypatch.setattr(ta, "KNOWN", 5)
    small = ta.Aligner(MODELS, None)
    for text in ("one two three", "four five six seven", "one two", "x" * 9000):
        if small.full:
            small.clear()
        at, *_ = small.place([text])
        assert b";".join(small.groups[i] for i in at).decode() == ";".join(by_library(text)[2])
    assert len(small.at) < 12


def test_pair_counts_and_empty_table(docs):
    rows, df = docs
    counts = Counter(x for _, t in rows for x in by_library(t)[3])
    found = ta.pair_counts(df, A, B).collect()
    assert {(r.a, r.b): r.n for r in found} == counts
    most = {}
    for (_, b), n in counts.items():
        most[b] = max(most.get(b, 0), n)
    assert all(r.best == (r.n == most[r.b]) for r in found)
    assert ta.align(df.limit(0), A, B).count() == 0 and ta.align(df.where("doc_id < 2"), A, B).count() == 2
