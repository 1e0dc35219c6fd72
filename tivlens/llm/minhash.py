"""Near-duplicate groups with min-max hashing.

Each text becomes its set of distinct word shingles (64-bit hashes). Every permutation is
evaluated once and gives two signature values, the minimum and the maximum, so half the
evaluations fill the bands. Texts that agree in a band are candidates; links are
confirmed on the full sets, and the components of the confirmed links are the groups.

Groups of any size stay linear:

- texts with equal sets are one class, represented by its smallest id, before banding;
- in each round a text is compared with one centre of each of its buckets that is not in its
  component yet, at most 48 of them, so a bucket of n copies costs n comparisons, not n squared;
- what is left in buckets that still hold several components is compared across
  components within the join: rows with a partner carry their sets, and only links come out. One-bit
  signatures (288 bits) first rule out pairs far below the threshold (a pair at 0.8 agrees
  in 259 of them on average; below 233, five standard deviations less, it is ruled out),
  and a pair is compared in the first of its common buckets only.

With 48 bands of 6 values a pair at similarity 0.8 is missed with probability 5e-7. Signatures,
buckets and sets are written to the shared folder once.

Defined cases: words are ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z; fewer words than a
shingle make one shingle; texts without words have no shingles and no links; rows that share
an id are one vertex; a row without an id is never linked and keeps a null component, and is kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tivlens.llm.common import matching, stored
from tivlens.llm.components import components

BANDS, PERMS_PER_BAND = 48, 3
PERMS = BANDS * PERMS_PER_BAND
VALUES = 2 * PERMS
AGREEING = 233  # of VALUES one-bit values, at least, to be compared in full
BLOCK = 2048  # shingles permuted at once
KNOWN = 400_000  # word hashes a worker remembers
ROUNDS = 3
_U = np.uint64


def _constants(n: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 2**64, n, dtype=np.uint64) | _U(1)


MULTIPLIERS = _constants(PERMS, 20240229)
_FOLD = _constants(2 * PERMS_PER_BAND + 1, 7)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class Shingler:
    """Sets of shingle hashes, with a bounded memory of word hashes."""

    def __init__(self, size: int) -> None:
        self.size = size
        self.known: dict[bytes, int] = {}

    def shingles(self, text: bytes) -> np.ndarray:
        words = text.lower().split()  # of bytes: ASCII letters and white space only
        if not words:
            return np.empty(0, np.uint64)
        known = self.known
        new = [w for w in words if w not in known]
        if new:
            if len(known) > KNOWN:
                known.clear()
                new = words
            known.update((w, xxhash.xxh3_64_intdigest(w)) for w in new)
        hashes = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        k = min(self.size, len(words))
        n = len(words) - k + 1
        out = np.full(n, k, np.uint64)
        for j in range(k):
            out = out * _U(0x9E3779B97F4A7C15) + hashes[j:j + n]
        return np.unique(mixed(out))


def signature(shingles: np.ndarray) -> np.ndarray:
    """Minimum and maximum of every permutation, side by side."""
    low = np.full(PERMS, 2**64 - 1, np.uint64)
    high = np.zeros(PERMS, np.uint64)
    for at in range(0, len(shingles), BLOCK):
        values = np.multiply.outer(MULTIPLIERS, shingles[at:at + BLOCK])
        np.minimum(low, values.min(axis=1), out=low)
        np.maximum(high, values.max(axis=1), out=high)
    return np.stack([low, high], axis=1).reshape(-1)


def bands(signatures: np.ndarray) -> np.ndarray:
    """One 64-bit key per band for each row of signatures."""
    parts = signatures.reshape(len(signatures), BANDS, 2 * PERMS_PER_BAND)
    keys = np.broadcast_to(mixed(np.arange(BANDS, dtype=np.uint64) + _U(1)), parts.shape[:2]).copy()
    for j in range(2 * PERMS_PER_BAND):
        keys = mixed(keys * _FOLD[j] + parts[:, :, j])
    return keys


def one_bits(signatures: np.ndarray) -> np.ndarray:
    """One bit of each mixed value, packed into 64-bit words."""
    bits = np.zeros((len(signatures), -(-VALUES // 64) * 64), np.uint8)
    bits[:, :VALUES] = mixed(signatures) & _U(1)
    return np.packbits(bits, axis=1).view(np.int64)


def _lists(values: np.ndarray, sizes: list[int]) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *sizes]), pa.int32()), pa.array(values.reshape(-1).view(np.int64)))


def signed(docs: DataFrame, size: int, id_col: str, text_col: str) -> DataFrame:
    """``doc, n, s1, s2, keys, bits``: set size, identity of the set, band keys and one-bit signature."""
    rows = docs.select(F.col(id_col).alias("doc"), F.col(text_col).cast("binary").alias("text"))
    longs = T.ArrayType(T.LongType(), False)
    schema = T.StructType([rows.schema["doc"], T.StructField("n", T.LongType()), T.StructField("s1", T.LongType()),
                           T.StructField("s2", T.LongType()), T.StructField("keys", longs), T.StructField("bits", longs)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(size)
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                n, s1, s2, signatures = [], [], [], []
                for value in part.column(1):
                    found = shingler.shingles(value.as_py() or b"")
                    n.append(len(found))
                    s1.append(int(found.sum().view(np.int64)) if len(found) else 0)
                    s2.append(int(mixed(found * _FOLD[0]).sum().view(np.int64)) if len(found) else 0)
                    if len(found):
                        signatures.append(signature(found))
                matrix = np.array(signatures, np.uint64).reshape(len(signatures), VALUES)
                bits = one_bits(matrix)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(n, pa.int64()), pa.array(s1, pa.int64()), pa.array(s2, pa.int64()),
                     _lists(bands(matrix), [BANDS * (x > 0) for x in n]),
                     _lists(bits, [bits.shape[1] * (x > 0) for x in n])],
                    names=["doc", "n", "s1", "s2", "keys", "bits"])

    return rows.mapInArrow(run, schema)


def full_sets(docs: DataFrame, size: int) -> DataFrame:
    """``doc, set``: all shingle hashes of each row of ``doc, text``."""
    rows = docs.select("doc", F.col("text").cast("binary").alias("text"))
    schema = T.StructType([rows.schema["doc"], T.StructField("set", T.ArrayType(T.LongType(), False))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(size)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                sets = [shingler.shingles(v.as_py() or b"") for v in part.column(1)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), _lists(np.concatenate(sets), [len(s) for s in sets])], names=["doc", "set"])

    return rows.mapInArrow(run, schema)


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs ``a, b`` whose full sets have ``percent`` similarity at least."""
    a = sets.select(F.col("doc").alias("a"), F.col("set").alias("set_a"))
    b = sets.select(F.col("doc").alias("b"), F.col("set").alias("set_b"))
    both = pairs.join(a, "a").join(b, "b").select(
        "a", "b", F.size("set_a").alias("na"), F.size("set_b").alias("nb"),
        F.size(F.array_intersect("set_a", "set_b")).cast("long").alias("common"))
    return both.where(100 * F.col("common") >= percent * (F.col("na") + F.col("nb") - F.col("common"))).select("a", "b")


def _partners(members: DataFrame) -> tuple[DataFrame, Column]:
    """``members`` once more, and whether a row may be linked with one of another component of its bucket."""
    other = members.select(*[F.col(c).alias(f"{c}_b") for c in members.columns])
    differing = sum(F.bit_count(F.col("bits")[i].bitwiseXOR(F.col("bits_b")[i])) for i in range(-(-VALUES // 64)))
    first_common = F.get(F.array_intersect("keys", "keys_b"), F.lit(0)) == F.col("key")
    return other, ((F.col("key") == F.col("key_b")) & (F.col("component") != F.col("component_b"))
                   & (differing <= VALUES - AGREEING) & first_common)


def linked_within(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The links ``a, b`` between components within buckets: ``key, doc, component, bits, keys``.

    Only rows that have a partner by their bits are joined with their sets.
    """
    other, likely = _partners(members)
    members = stored(stored(members.join(other, likely, "left_semi"), "likely").join(sets, "doc"), "members")
    other, likely = _partners(members)
    common = F.size(F.array_intersect("set", "set_b")).cast("long")
    enough = (100 + percent) * common >= percent * (F.size("set") + F.size("set_b"))
    both = members.join(other, likely & (F.col("component") < F.col("component_b")) & enough)
    return both.select(F.col("doc").alias("a"), F.col("doc_b").alias("b"))


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row of ``docs``."""
    sigs = stored(signed(docs, size, id_col, text_col), "signatures")
    own = ["n", "s1", "s2"]
    some = sigs.where(F.col("doc").isNotNull() & (F.col("n") > 0))
    classes = stored(some.groupBy(*own).agg(F.min("doc").alias("rep"), F.max("doc").alias("last")), "classes")
    single = sigs.join(classes.select(F.col("rep").alias("doc"), *own), ["doc", *own], "left_semi")
    single = single.dropDuplicates(["doc", *own])
    keyed = single.select("doc", F.explode("keys").alias("key"))
    shared = stored(keyed.groupBy("key").agg(F.min("doc").alias("least"), F.max("doc").alias("most"))
                    .where("least < most").select("key"), "keys")
    buckets = stored(keyed.join(shared, "key").distinct(), "buckets")
    involved = stored(buckets.select("doc").distinct(), "involved")
    texts = matching(docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text")), involved, "doc")
    # rows that repeat an id pool their shingles
    sets = full_sets(texts, size)
    sets = stored(sets.groupBy("doc").agg(F.array_distinct(F.flatten(F.collect_list("set"))).alias("set")), "sets")

    links = None
    labels = components(buckets.select(F.col("doc").alias("a"), F.col("doc").alias("b")))
    for step in range(ROUNDS + 1):
        placed = buckets.join(labels.withColumnRenamed("vertex", "doc"), "doc", "left").withColumn(
            "component", F.coalesce("component", "doc"))
        placed = stored(placed, "placed")
        order = F.struct(F.lit(0) if step == 0 else F.xxhash64("doc", "key", F.lit(step)), F.col("doc"))
        open_keys = (placed.groupBy("key").agg(
            F.min("component").alias("lo"), F.max("component").alias("hi"),
            F.min_by(F.struct("doc", "component"), order).alias("centre"))
            .where("lo < hi").select("key", "centre"))
        open_keys = stored(open_keys, "open")
        if open_keys.isEmpty():
            break
        members = placed.join(open_keys, "key")
        if step < ROUNDS:
            apart = members.where(F.col("component") != F.col("centre.component"))
            centre = F.col("centre.doc").alias("b")
            # smallest ids first: most copies need one comparison
            pairs = (apart.groupBy("doc").agg(F.min("centre.doc").alias("b")) if step == 0 else
                     apart.select("doc", centre).distinct()).select(F.col("doc").alias("a"), "b")
            found = confirmed(stored(pairs, "pairs"), sets, percent)
        else:
            members = members.select("key", "doc", "component").join(single.select("doc", "bits", "keys"), "doc")
            found = linked_within(stored(members, "rest"), sets, percent)
        links = stored(found if links is None else links.unionByName(found), "links")
        labels = components(links)

    placed = labels.select(F.col("vertex").alias("rep"), "component")
    of_class = stored(classes.join(placed, "rep", "left").select(
        *own, F.coalesce("component", "rep").alias("component")), "classes")
    group = F.when(F.col("n") > 0, F.col("component"))
    out = sigs.select("doc", *own).join(of_class, own, "left").select(
        F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"),
        F.when(F.col("doc").isNotNull(), F.coalesce(group, F.col("doc"))).alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").isNull() | (F.col("doc_id") == F.col("component_id")))
