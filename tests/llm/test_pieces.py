import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tivlens.llm import piece_codec
from tivlens.llm.piece_codec import encode_decode, model_bytes
from tivlens.llm.pieces import PieceEncoder, encoder, pretokens, processor
from tivlens.llm.token_counts import count_tokens

PATH = public_tokenizers.path("piece_bpe_32k.model")
MODEL = model_bytes(PATH)
TEXTS = [None, "", " ", "a", "  a  ", "the  the\n\n▁▁x", "<s></s><0x0A>", "é漢\U0001f600\x00", " " * 77, "x" * 3000,
         "Words and words, again and again. " * 3000, "Zürich 1234567 ﬁ"]


@settings(max_examples=400, deadline=None)
@given(st.one_of(st.text(max_size=60), st.text("abcdethrsin ▁.,\n", max_size=80)))
def test_equals_the_library(text):
    enc, lib = encoder(MODEL), processor(MODEL)
    ids = [i for t in pretokens(text) for i in enc.encode(t)]
    assert ids == lib.encode(text)
    assert "".join(enc.decode(enc.encode(t)) for t in pretokens(text))[1:] == lib.decode(ids)


def test_other_models_are_refused(monkeypatch):
    class Other:
        def __getattr__(self, name):
            return getattr(processor(MODEL), name)

        def get_score(self, i):
            return 0.0

    monkeypatch.setattr("tivlens.llm.pieces.processor", lambda model: Other())
    with pytest.raises(ValueError):
        PieceEncoder(MODEL)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(k, t, 1, "clash") for k, t in enumerate(TEXTS)] + [(3, "a", 1, None), (None, "b", 1, None)],
                                 "doc_id long, text string, ids int, n_tokens string")


def test_codec(docs):
    lib = processor(MODEL)
    rows = encode_decode(docs, PATH).collect()
    assert len(rows) == len(TEXTS) + 2
    for r in rows:
        text = "b" if r.doc_id is None else TEXTS[r.doc_id] or ""
        assert r.ids == lib.encode(text) and r.decoded == lib.decode(r.ids)
    carried = encode_decode(docs, PATH, carry=True)
    assert carried.where("row.ids = 1").count() == len(TEXTS) + 2
    assert encode_decode(docs.limit(0), PATH).count() == 0


def test_counts(docs):
    lib = processor(MODEL)
    rows = count_tokens(docs, PATH, limit=2999).collect()
    assert len(rows) == len(TEXTS) + 2
    for r in rows:
        text = "b" if r.doc_id is None else TEXTS[r.doc_id] or ""
        n = len(lib.encode(text))
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(text.encode()), n, n > 2999)
    assert count_tokens(docs.limit(0), PATH).count() == 0


def test_memory_outlives_a_task_and_keeps_frequent_pretokens(monkeypatch):
    """Each task used to start with an empty memory, and a full one forgot all at once."""
    from tivlens.llm import piece_codec

    monkeypatch.setattr(piece_codec, "MEMORY", 3)
    assert piece_codec.memory(MODEL) is piece_codec.memory(MODEL)
    known, lib, learned = piece_codec.Memory(encoder(MODEL)), processor(MODEL), []
    monkeypatch.setattr(known, "enc", type("Enc", (), {
        "encode": staticmethod(lambda t: learned.append(t) or encoder(MODEL).encode(t)), "decode": encoder(MODEL).decode}))
    words = ["the", "a", "\u6f22", "the", "zebra", "the", "qqq", "the", "Z\u00fcrich", "the", "x" * 100, "x" * 100]
    for w in words:
        (token,) = pretokens(w)
        packed, text = known[token]
        ids = memoryview(packed).cast("i").tolist()
        assert ids == lib.encode(w) and text == " " + w
    assert learned.count(pretokens("the")[0]) == 1 and len(known) <= 3 and len(known.older) <= 3
    assert learned.count(pretokens("x" * 100)[0]) == 2  # long ones aren't remembered


def test_memory_of_pretokens_is_compact():
    """Two workers keep theirs beside the heap of their executor."""
    import gc
    import tracemalloc

    memory = piece_codec.Memory(PieceEncoder(piece_codec.model_bytes(PATH)))
    words = [f"▁w{k * 7919 % 100_003}x" for k in range(20_000)]
    for w in words:
        memory.enc.encode(w)  # so that the encoder's own tables aren't counted
    gc.collect()
    tracemalloc.start()
    for w in words:
        memory[w]
    taken = tracemalloc.get_traced_memory()[0] / len(words)
    tracemalloc.stop()
    assert len(memory) == len(words) and taken < 130


def test_texts_that_decode_to_something_else_keep_it(monkeypatch):
    memory = piece_codec.Memory(PieceEncoder(piece_codec.model_bytes(PATH)))
    plain = memory.text("the cat sat  on▁the mat")
    assert plain[1] == "the cat sat  on the mat"
    decode = memory.enc.decode
    odd = memory.enc.encode("▁cat")
    monkeypatch.setattr(memory.enc, "decode", lambda ids: " dog" if ids == odd else decode(ids))
    memory.clear()
    assert memory.text("the cat sat  on▁the mat") == (plain[0], "the dog sat  on the mat")
    assert memory.text("cat" + "a" * 200) == memory.text("cat" + "a" * 200) and memory.text("cat")[1] == "dog"
