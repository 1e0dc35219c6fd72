"""What the pipeline's last stage sends to the workers."""

from pyspark.sql import functions as F

import corpus_pipeline
from tivlens.llm import piece_codec


def test_encode_sends_each_text_once(spark, monkeypatch):
    sent, plain = [], piece_codec.encode_decode

    def watched(docs, *args, **more):
        rest = [F.length(F.col(c).cast("string")) for c in docs.columns if c != "text"]
        sent.append(docs.select(sum(rest, F.lit(0)).alias("n")).first()["n"])
        return plain(docs, *args, **more)

    monkeypatch.setattr(piece_codec, "encode_decode", watched)
    text = "kal tok mira " * 300
    docs = spark.createDataFrame([(1, text, "aa", "s", len(text))], "doc_id long, text string, lang string, source string, n_chars long")
    assert corpus_pipeline.encode(spark, docs, "").first()["decodes"]
    assert sent[0] < 200  # before, the text came along a second time
