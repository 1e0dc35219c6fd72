"""Document fingerprints by consistent weighted sampling.

A text's terms are its words (``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z), weighted by how often
they occur. For each of ``SAMPLES`` samples every word has two Gamma(2, 1) variables r, c and a
uniform b, all drawn from a hash of the word; with weight S

    t = floor(ln S / r + b),    ln a = ln c - r * (t - b + 1),

and the sample is the pair (word, t) with the smallest a. Two texts take the same pair with a
probability equal to the generalised Jaccard similarity of their weights, sum(min) / sum(max).
A fingerprint is the samples' 16-bit codes in hex; likeness is the share of equal codes.

A word's row of ``SAMPLES`` (ln a, code) values depends on the word and its weight alone, so a
worker keeps the rows of the words it meets in a bounded table, and a text is one gather and one
minimum. ``ln a`` is kept in steps of 1/1024 and ties go to the smaller code, so the order of words
doesn't matter and equal texts have equal fingerprints.

``edited_likeness`` needs each document beside the next one in descending order of ids. Rows are
cut into ranges of that order, of about equal bytes, by bounds from a sample of keys; texts are
shuffled once, each range is sorted, and the first row of each range is also sent to the range
before it. A key is id, hash of the text and row number, so that rows of one id, copies included,
may be cut anywhere.

Defined cases: a null text counts as empty; texts without words have the fingerprint '' and are
like each other (1.0) and unlike all others (0.0); null ids come last in the descending order,
rows that share an id are ordered by a hash of their texts; a single row is its own next one; an
empty table gives no rows. Ids are integral numbers. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SAMPLES = 128
KNOWN = 300_000  # rows of words that a worker keeps, 512 bytes each
BLOCK = 4096  # words of a text gathered at once
KEYS_PER_RANGE = 30  # sampled keys behind each bound
LOWEST, STEP = -48.0, 1 / 1024  # of ln a, which fills 16 bits
_U = np.uint32
#: Odd multipliers for five streams of random numbers, one for each sample.
_STREAMS = np.random.default_rng(20100718).integers(0, 2**32, (5, SAMPLES), dtype=np.uint32) | _U(1)
_LARGEST = _U(0xFFFFFFFF)


def _stream(low: np.ndarray, high: np.ndarray, k: int) -> np.ndarray:
    """32 random bits of each word and sample, from the halves of the words' hashes."""
    x = high * _STREAMS[k]
    x ^= low
    for shift, factor in ((16, 0x7FEB352D), (15, 0x846CA68B)):
        x ^= x >> _U(shift)
        x *= _U(factor)
    x ^= x >> _U(16)
    return x


def _log_product(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The negative logarithm of a product of two uniforms in (0, 1): a Gamma(2, 1) variable."""
    product = ((x >> _U(8)).astype(np.float32) + np.float32(0.5)) * ((y >> _U(8)).astype(np.float32) + np.float32(0.5))
    product *= np.float32(2.0**-48)
    return -np.log(product, out=product)


def samples(hashes: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Of each word: ``ln a`` in the upper and the code of (word, t) in the lower 16 bits, words x SAMPLES."""
    low, high = hashes.astype(np.uint32)[:, None], (hashes >> np.uint64(32)).astype(np.uint32)[:, None]
    r = _log_product(_stream(low, high, 0), _stream(low, high, 1))
    ln_c = np.log(_log_product(_stream(low, high, 2), _stream(low, high, 3)))
    rest = _stream(low, high, 4)
    b = (rest >> _U(16)).astype(np.float32) * np.float32(2.0**-16)
    t = np.floor(np.log(weights).astype(np.float32)[:, None] / r + b)
    ln_a = ln_c - r * (t - b + np.float32(1.0))
    place = np.clip((ln_a - np.float32(LOWEST)) / np.float32(STEP), 0, 0xFFFF).astype(np.uint32)
    code = rest + t.astype(np.int32).view(np.uint32) * _U(40503)
    return place << _U(16) | code & _U(0xFFFF)


class Sampler:
    """Fingerprints of texts as arrays of codes, with a bounded memory of words."""

    def __init__(self) -> None:
        self.at: dict = {}  # word (weight 1) or (word, weight) to its row
        self.rows = np.empty((KNOWN, SAMPLES), np.uint32)

    def _gathered(self, terms: list) -> np.ndarray:
        at = self.at
        new = [x for x in terms if x not in at]
        if new:
            if len(at) + len(new) > KNOWN:
                at.clear()
                new = terms
            first = len(at)
            pairs = [(x, 1) if type(x) is bytes else x for x in new]
            self.rows[first:first + len(new)] = samples(
                np.array([xxhash.xxh3_64_intdigest(w) for w, _ in pairs], np.uint64), np.array([n for _, n in pairs], float))
            at.update(zip(new, range(first, first + len(new)), strict=True))
        return self.rows[list(map(at.__getitem__, terms))]

    def codes(self, text: bytes) -> np.ndarray | None:
        """None for a text without words."""
        counts = Counter(text.lower().split())  # of bytes: ASCII letters and white space only
        if not counts:
            return None
        terms = [w if n == 1 else (w, n) for w, n in counts.items()]
        low = np.full(SAMPLES, _LARGEST)
        for at in range(0, len(terms), BLOCK):
            np.minimum(low, self._gathered(terms[at:at + BLOCK]).min(axis=0), out=low)
        return low.astype(np.uint16)


def as_text(codes: np.ndarray | None) -> str:
    return "" if codes is None else codes.astype(">u2").tobytes().hex()


def alike(a: np.ndarray | None, b: np.ndarray | None) -> float:
    if a is None or b is None:
        return float(a is None and b is None)
    return float(np.count_nonzero(a == b)) / SAMPLES


_WORKER: list[Sampler] = []


def _sampler() -> Sampler:
    """One per worker, kept from task to task."""
    if not _WORKER:
        _WORKER.append(Sampler())
    return _WORKER[0]


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fingerprint`` for every row, in one pass."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler = _sampler()
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([as_text(sampler.codes(x.as_py() or b"")) for x in batch.column(1)], pa.string())],
                names=["doc_id", "fingerprint"])

    return rows.mapInArrow(run, T.StructType([rows.schema["doc_id"], T.StructField("fingerprint", T.StringType())]))


def likeness(a: Column, b: Column) -> Column:
    """Share of equal codes of two fingerprints in hex."""
    starts = F.sequence(F.lit(1), F.lit(4 * SAMPLES), F.lit(4))
    equal = F.size(F.filter(starts, lambda i: F.substr(a, i, F.lit(4)) == F.substr(b, i, F.lit(4))))
    return F.when((a == "") | (b == ""), (a == b).cast("double")).otherwise(equal / F.lit(float(SAMPLES)))


# ------------------------------------------------------------- the next document

def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("h"),
                       F.monotonically_increasing_id().alias("uid"))


def _order(doc_id: int | None, h: int, uid: int) -> tuple:
    """Sorts like descending ids, nulls last, then hashes, then row numbers."""
    return (doc_id is None, 0 if doc_id is None else -doc_id, h, uid)


def _bounds(rows: DataFrame, ranges: int) -> list[tuple]:
    """First keys of the second and later ranges: of about equal bytes in a sample of bounded size."""
    n = rows.count()
    share = min(1.0, ranges * KEYS_PER_RANGE / max(n, 1))
    found = rows.select("doc_id", "h", "uid", F.length("text").alias("size"))
    found = (found if share == 1.0 else found.sample(share, seed=3)).collect()
    keys = sorted((_order(r.doc_id, r.h, r.uid), r["size"] + 200) for r in found)
    total, before, out = sum(size for _, size in keys), 0, []
    for key, size in keys:
        if before * ranges >= total * (len(out) + 1):
            out.append(key)
        before += size
    return out[:ranges - 1]


def _range_of(bounds: list[tuple]):
    """A function of key columns: the range that a key falls into."""
    heads = np.array([b[:2] for b in bounds], np.int64).reshape(-1, 2)
    nulls = int((heads[:, 0] == 0).sum())  # bounds that have an id
    ids = heads[:nulls, 1]

    def place(doc_id: pd.Series, h: pd.Series, uid: pd.Series) -> pd.Series:
        missing = doc_id.isna().to_numpy()
        key = -doc_id.fillna(0).astype("int64").to_numpy()
        low = np.where(missing, nulls, np.searchsorted(ids, key, "left"))
        high = np.where(missing, len(bounds), np.searchsorted(ids, key, "right"))
        for i in np.flatnonzero(low < high):  # the id of a bound
            low[i] = bisect_right(bounds, (bool(missing[i]), 0 if missing[i] else int(key[i]), int(h.iloc[i]), int(uid.iloc[i])))
        return pd.Series(low, dtype="int32")

    return F.pandas_udf(place, T.IntegerType())


def edited_likeness(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranges: int | None = None) -> DataFrame:
    """Every document against an edited text of itself and against the next document, in descending order of ids.

    The edited text is the document with its last third of code points, rounded down, replaced by the first as
    many of the next document (all, if it has fewer); the first document follows the last. Returns ``doc_id,
    n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next``. ``ranges`` is the number
    of tasks that compare, by default the session's number of shuffle partitions.
    """
    spark = docs.sparkSession
    ranges = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = _keyed(docs, id_col, text_col)
    bounds = _bounds(rows, ranges)
    n_ranges = len(bounds) + 1
    spot = _range_of(bounds)("doc_id", "h", "uid")
    order = [F.col("doc_id").isNull(), F.col("doc_id").desc(), F.col("h"), F.col("uid")]
    first_key = F.struct(F.col("doc_id").isNull(), (-F.col("doc_id").cast("decimal(20,0)")).alias("down"), "h", "uid")
    firsts = sorted((r.spot, r.uid) for r in (
        rows.select(spot.alias("spot"), "doc_id", "h", "uid")
        .groupBy("spot").agg(F.min_by("uid", first_key).alias("uid")).collect()))  # one row per range
    spots = [s for s, _ in firsts]
    also = {uid: spots[k - 1] for k, (_, uid) in enumerate(firsts)}  # the first range's first row follows the last range

    @F.pandas_udf(T.IntegerType())
    def before_it(uid: pd.Series) -> pd.Series:
        return uid.map(also).astype("Int32")

    placed = rows.withColumn("own", spot).withColumn("extra", before_it("uid"))
    whole = placed.select("doc_id", "text", "h", "uid", F.explode(F.filter(F.array(
        F.struct(F.col("own").alias("spot"), F.lit(False).alias("copied")),
        F.struct(F.col("extra").alias("spot"), F.lit(True).alias("copied"))),
        lambda x: x["spot"].isNotNull())).alias("to"))
    dealt = (whole.repartitionById(n_ranges, F.col("to.spot")).sortWithinPartitions("to.spot", "to.copied", *order)
             .select("doc_id", "text", "to.copied"))
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_chars", T.LongType()),
                           *[T.StructField(c, T.StringType()) for c in ("edited_sha256", "fingerprint", "edited_fingerprint")],
                           T.StructField("near_edited", T.DoubleType()), T.StructField("near_next", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler = _sampler()
        before: tuple | None = None
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                out = []
                for doc_id, text, copied in zip(*(c.slice(at, 500) for c in batch.columns), strict=True):
                    text = text.as_py()
                    codes = sampler.codes(text.encode())
                    if before is not None:
                        own_id, own, own_codes = before
                        cut = len(own) // 3
                        edited = (own[:len(own) - cut] + text[:cut]).encode()
                        edited_codes = sampler.codes(edited)
                        out.append((own_id, len(own), hashlib.sha256(edited).hexdigest(), as_text(own_codes),
                                    as_text(edited_codes), alike(own_codes, edited_codes), alike(own_codes, codes)))
                    # what follows a copy is the first row of another range
                    before = None if copied.as_py() else (doc_id.as_py(), text, codes)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x[k] for x in out], kind) for k, kind in enumerate(
                        [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()])],
                    names=schema.names)

    return dealt.mapInArrow(run, schema)
