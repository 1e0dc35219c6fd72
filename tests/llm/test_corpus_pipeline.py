"""The pipeline against brute force on a small table made here, stage by stage."""

import random

import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tivlens.llm.common import SPACES
from tivlens.llm.piece_codec import model_bytes
from tivlens.llm.pieces import processor

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
WORDS = {"aa": ["kal", "tok", "mira", "ponta", "zek", "hola"], "bb": ["shri", "wyth", "gruff", "lynch", "dwyr", "ffest"]}


def made():
    rng = random.Random(8)

    def prose(lang, n):
        return " ".join(rng.choice(WORDS[lang]) + rng.choice(WORDS[lang]) + rng.choice(WORDS[lang]) for _ in range(n))

    bench = [(k, prose("aa", 20)) for k in range(3)]
    docs = []
    for k in range(60):
        lang = "ab"[k % 2] * 2
        docs.append([k, "\n".join(prose(lang, 12) for _ in range(3)), lang])
    docs[10][1] += "\n" + docs[3][1].split("\n")[0]  # shares a line
    docs[11][1] = docs[5][1]  # every line is document 5's
    docs[12][1] = docs[6][1].replace("\n", " ")
    docs[14][1] = docs[12][1] + " more"  # near copy of 12
    docs[20][1] += " " + bench[1][1] + " " + prose("aa", 5)
    docs[21][1], docs[22][1], docs[23][1] = None, "", "12 !\n34"
    docs[30][2] = None
    rows = [(d, t, lang, "s", len(t or "")) for d, t, lang in docs]
    return rows, bench


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    where = tmp_path_factory.mktemp("tables")
    rows, bench = made()
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{where}/documents.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{where}/benchmark.parquet")
    return str(where)


def brute(rows, bench):
    rows = [r for r in rows if r[1] and any(c.isalpha() for c in r[1])]

    def key(x):
        return x.strip(SPACES).lower()

    held = {}
    for d, t, *_ in rows:
        for x in t.split("\n"):
            held.setdefault(key(x), set()).add(d)
    lines = []
    for d, t, *_ in rows:
        kept = [x for x in t.split("\n") if len(key(x)) < 10 or min(held[key(x)]) == d]
        if kept:
            lines.append((d, "\n".join(kept)))
    sets = {}
    for d, t in lines:
        w = t.lower().split()
        sets[d] = {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))}
    gone = {b for b in sets for a in sets if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    found = {d for d, t in lines for _, i in bench if i in t.replace("\n", " ")}
    lib = processor(model_bytes(public_tokenizers.path(corpus_pipeline.PIECES)))
    return {d: lib.encode(t) for d, t in lines if d not in gone | found}


def test_run_equals_brute_force(spark, folder):
    rows = corpus_pipeline.run(spark, folder).collect()
    assert {r.doc_id: r.ids for r in rows} == brute(*made())
    assert all(r.decodes and r.n_tokens == len(r.ids) for r in rows)
    assert {r.lang for r in rows} == {"aa", "bb"} and all(r.lang == "ab"[r.doc_id % 2] * 2 for r in rows)


def test_stages_keep_the_columns_and_take_empty_tables(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
        assert docs.count() == 0
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == COLUMNS


def test_null_and_repeated_ids_are_judged_by_row(spark, folder):
    rng = random.Random(9)

    def prose():
        return " ".join("".join(rng.choice(WORDS["aa"]) for _ in range(3)) for _ in range(40))

    bench = made()[1]
    clean, other, copied = prose(), prose(), prose()
    bad = prose() + " " + bench[1][1]
    rows = [(None, bad), (None, clean), (1, bad), (1, other), (2, prose()), (None, copied), (None, copied), (7, copied), (5, copied),
            (5, copied + " more"), (None, bench[0][1])]
    docs = spark.createDataFrame([(d, t, "aa", "s", len(t)) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted(((r.doc_id, r.text) for r in corpus_pipeline.decontaminate(spark, docs, folder).collect()), key=str)
    assert got == sorted((x for x in rows if x[1] not in (bad, bench[0][1])), key=str)
    got = [(r.doc_id, r.text) for r in corpus_pipeline.drop_near_duplicates(spark, docs, folder).collect()]
    assert len(got) == len(set(rows)) - 4 and (1, bad) in got and (None, bad) not in got
    assert [d for d, t in got if t.startswith(copied)] == [5] and {(None, clean), (1, other), rows[4], rows[10]} <= set(got)


def test_batches_for_the_workers_are_bounded_by_bytes(spark):
    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes], pa.int64())], names=["n"])

    texts = spark.range(0, 9000, 1, 1).select(F.repeat(F.lit("x"), 3000).alias("text"))
    stage = corpus_pipeline.bounded(lambda session, docs, sf_dir: docs.mapInArrow(sizes, "n long"))
    try:
        spark.conf.unset(corpus_pipeline.BATCH)
        found = [r.n for r in stage(spark, texts, "").collect()]  # one batch of 27 MB without the bound
        assert sum(found) >= 27_000_000 and max(found) < 2 * corpus_pipeline.BATCH_BYTES
        spark.conf.set(corpus_pipeline.BATCH, 1 << 20)  # a session's own limit stands
        assert max(r.n for r in stage(spark, texts, "").collect()) < 2 << 20
    finally:
        spark.conf.unset(corpus_pipeline.BATCH)
    assert all(f.__qualname__.startswith("bounded") for _, f in corpus_pipeline.STAGES)
