"""A training corpus from ``documents`` in five stages.

1. language ID: documents without a recognisable language go, the predicted one is noted;
2. line dedup: lines that several documents share stay in one of them; documents that lose
   every line go, as all they say is said elsewhere;
3. near duplicates: one document of each group stays, that of the smallest id (five-word shingles, 80 %);
4. decontamination: documents that hold a benchmark item, edited copies included, go;
5. SentencePiece: the texts as ids, with a check that they decode to what was encoded.

Every stage decides row by row: rows that repeat an id or have none are documents of their own,
but in stage 2 rows of one id count as one document, and rows without an id neither share nor
lose lines.

Each stage takes ``(spark, docs, sf_dir)``; all but the last return the columns of
``documents``. ``run`` writes what a stage returns to the shared folder and reads it again.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tivlens.llm import decontamination, language_id, line_dedup, minhash, piece_codec
from tivlens.llm.common import SPACES, matching, stored, table

PIECES = "piece_bpe_32k.model"
BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = 4 << 20  # of texts on their way to a worker; they lie in both processes several times over
LEAST_SURE = 0.5  # language score; a document that is likelier another language than the best one goes


def _documents(df: DataFrame, row: str, columns: list[str], **changed) -> DataFrame:
    """The columns of ``documents``: those of struct ``row``, or the changed ones."""
    return df.select(*[(changed[c] if c in changed else F.col(row)[c]).alias(c) for c in columns])


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = language_id.fit(docs)
    found = language_id.predict(docs, model, carry=True)
    sure = found.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SURE))
    return _documents(sure, "row", docs.columns, lang=F.col("lang_pred"))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    done = line_dedup.dedup_lines(docs, carry=True)
    kept = done.where((F.col("n_dropped") == 0) | (F.trim("kept_text", F.lit(SPACES)) != ""))
    return _documents(kept, "row", docs.columns, text=F.col("kept_text"),
                      n_chars=F.length("kept_text").cast("long"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # rows are told apart by a number of their own: ids may be missing or repeat
    numbered = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.monotonically_increasing_id().alias("n"))
    rows = stored(numbered, "numbered")
    found = stored(minhash.near_duplicates(rows.select("n", "row.text"), size=5, id_col="n").select(
        F.col("doc_id").alias("n"), "component_id"), "groups")
    groups = found.join(found.groupBy("component_id").agg(F.count("*").alias("size")).where("size > 1"), "component_id")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "n")
    members = stored(groups.join(rows.select("n", "row.doc_id"), "n").select("n", "component_id", order.alias("o")), "members")
    first = members.groupBy("component_id").agg(F.min("o")["n"].alias("n")).select("n")
    # what goes are few rows: they are sent to the texts, which stay where they are
    gone = stored(members.select("n").join(first, "n", "left_anti"), "gone")
    return matching(rows, gone, "n", "left_anti").select("row.*").select(docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.uncontaminated(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # what a text should decode to goes to the workers and back as a digest, not as a second copy of the text
    with_text = docs.withColumn("plain", F.sha2(F.replace(F.coalesce("text", F.lit("")), F.lit("▁"), F.lit(" ")), 256))
    done = piece_codec.encode_decode(with_text, public_tokenizers.path(PIECES), carry=True)
    return done.select("row.doc_id", "row.lang", "row.source", F.size("ids").cast("long").alias("n_tokens"), "ids",
                       (F.sha2("decoded", 256) == F.col("row.plain")).alias("decodes"))


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def bounded(stage: Stage) -> Stage:
    """``stage`` in a session that sends rows to the Python workers in batches of ``BATCH_BYTES``, unless it has a limit of its own."""
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        if spark.conf.get(BATCH, None) is None:
            spark.conf.set(BATCH, BATCH_BYTES)
        return stage(spark, docs, sf_dir)

    return run


STAGES = [
    ("language_id", bounded(identify_language)),
    ("line_dedup", bounded(dedup_lines)),
    ("near_duplicates", bounded(drop_near_duplicates)),
    ("decontamination", bounded(decontaminate)),
    ("sentencepiece", bounded(encode)),
]

#: Three stages are no SQL: a learned classifier, an alignment and a tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
