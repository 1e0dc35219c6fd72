"""Approximate nearest neighbours by largest inner product: a hash-prefix forest.

Each of ``TREES`` trees gives a vector a string of ``DEPTH`` bits: on which side of as many random
directions, orthogonal as far as possible, it lies. Inner products become angles by one more
coordinate that fills every row up to the longest row's length. A tree's strings are a sorted array,
dealt over tasks by range, in which the rows of a prefix are one run; the lengths of these runs are
the counts by which a query descends and ascends.

A query descends all trees to the longest prefix shared by so many rows that, with ``PROBES``
buckets per tree, ``wanted`` candidates may be in reach: its own bucket and those beyond the
directions that it lies nearest to (behind the bits that make a block, so one block a tree is enough). If its buckets hold fewer, it ascends in all trees at once to
the longest prefix, found by halving, at which they hold enough; at last to the root, which holds every row. ``wanted`` is fitted, not given: the
first ``SAMPLE`` queries (by digest) are compared with every row, and it is the fewest candidates
with which this rule finds their true neighbours with a recall of ``TARGET``. So it follows from
the data how it grows: slowly where neighbours are close, with a power near 0.8 of the rows
for vectors without any structure. There is one path for tables of every size.

Rows and queries meet by tree and leading bits of their strings, in blocks of about ``GROUP`` rows;
there the rows are sorted by string and a query's buckets are found by binary search. Prefixes with
more rows are cut into several blocks, and their queries too, so no candidate is dropped and no
task holds more than one block of each. Of rows with one vector only the ``k + 1`` smallest ids
are indexed, as no other can be among the ``k`` nearest of any query.

Defined cases: rows whose vector is null, zero, of another length than the most common one,
or holds null or non-finite components take no part, and neither do rows without an id; a
query is never its own neighbour; rows that repeat an id count once, with their best score;
ties go to the smaller id; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from tivlens.llm.common import stored

TREES, DEPTH, PROBES = 8, 40, 32
SAMPLE, TARGET = 64, 0.94  # queries that fit the number of candidates, and the recall they ask for
FLIPPED = 10  # the nearest directions among which probes choose
SPREAD = 6  # the last places of a prefix, in which probes may differ even if they are among the leading bits of a block
GROUP, BLOCK_QUERIES, BATCH = 16_384, 8192, 2048
NARROW = 1e-9  # rounding allowed for before scores are computed exactly


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> tuple[DataFrame, int]:
    """``id, vector array<double>`` of the rows that take part, and their length."""
    v = F.col("vector")
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("vector"))
    rows = rows.where(F.col("id").isNotNull() & v.isNotNull() & F.forall(
        v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
        & F.exists(v, lambda x: x != 0))
    common = rows.groupBy(F.size("vector").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
    d = common.d if common else 0
    return rows.where(F.size("vector") == d), d


class Forest:
    """The directions of all trees."""

    def __init__(self, d: int, longest: float, seed: int, head: int) -> None:
        rng = np.random.default_rng(seed)
        blocks = [np.linalg.qr(rng.standard_normal((d + 1, d + 1)))[0] for _ in range(-(-TREES * DEPTH // (d + 1)))]
        self.directions = np.concatenate(blocks, axis=1)[:, :TREES * DEPTH]
        self.longest, self.head = longest, head
        self.powers = 1 << np.arange(DEPTH - 1, -1, -1, dtype=np.int64)
        self.sets = (np.arange(1 << FLIPPED)[:, None] >> np.arange(FLIPPED) & 1).astype(float)

    def sides(self, x: np.ndarray, query: bool) -> np.ndarray:
        """How far rows lie beyond each direction: rows x trees x places."""
        if query:
            filled = np.c_[x / np.linalg.norm(x, axis=1, keepdims=True), np.zeros(len(x))]
        else:
            x = x / self.longest
            filled = np.c_[x, np.sqrt(np.maximum(0, 1 - np.einsum("ij,ij->i", x, x)))]
        return (filled @ self.directions).reshape(len(x), TREES, DEPTH)

    def strings(self, sides: np.ndarray) -> np.ndarray:
        return (sides > 0) @ self.powers

    def probes(self, sides: np.ndarray, level: int) -> np.ndarray:
        """Prefixes of ``level`` bits that one query visits: trees x probes, its own first, nearest first."""
        own = self.strings(sides) >> (DEPTH - level)
        fixed = max(0, min(self.head, level - SPREAD))
        usable = min(level - fixed, FLIPPED)
        far = sides[:, :level] ** 2
        places = fixed + np.argsort(far[:, fixed:], axis=1, kind="stable")[:, :usable]
        sets = self.sets[:1 << usable, :usable]
        cost = np.take_along_axis(far, places, axis=1) @ sets.T
        first = np.argsort(cost, axis=1, kind="stable")[:, :PROBES]
        flips = (sets.astype(np.int64) @ (1 << (level - 1 - places)).T).T
        return own[:, None] ^ np.take_along_axis(flips, first, axis=1)


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def _lists(values: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1) * values.shape[1], pa.int32()),
                                    pa.array(values.reshape(-1)))


def hashed(rows: DataFrame, d: int, longest: float, seed: int, head: int, query: bool, kind: type) -> DataFrame:
    """``id, bytes, strings``: the vector in binary, as numbers of ``kind``, and its string in each tree."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = Forest(d, longest, seed, head)
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH):
                part = batch.slice(at, BATCH)
                x = _matrix(part.column(1), d)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([v.tobytes() for v in x.astype(kind)], pa.binary()),
                     _lists(forest.strings(forest.sides(x, query)))], names=["id", "bytes", "strings"])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, bytes binary, strings array<bigint>")


def prefix_counts(strings: DataFrame) -> DataFrame:
    """``tree, level, prefix, rows`` of every prefix that two rows or more share, from sorted ``tree, string``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tree, string = (batch.column(k).to_numpy() for k in (0, 1))
            for level in range(1, DEPTH + 1):
                prefix = string >> (DEPTH - level)
                starts = np.flatnonzero(np.r_[True, (prefix[1:] != prefix[:-1]) | (tree[1:] != tree[:-1])])[:len(string)]
                rows = np.diff(np.r_[starts, len(string)])
                keep = rows > 1  # the ends of a batch may be parts of longer runs
                keep[:1] = keep[-1:] = True
                starts, rows = starts[keep], rows[keep]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(tree[starts]), pa.array(np.full(len(starts), level, np.int32)), pa.array(prefix[starts]),
                     pa.array(rows.astype(np.int64))], names=["tree", "level", "prefix", "rows"])

    runs = strings.repartitionByRange("tree", "string").sortWithinPartitions("tree", "string")
    counts = runs.mapInArrow(run, "tree int, level int, prefix long, rows long")
    return counts.groupBy("tree", "level", "prefix").agg(F.sum("rows").alias("rows")).where("rows > 1")


def compared(rows: DataFrame, asked: list, d: int, k: int) -> dict:
    """The true ``k`` nearest vectors of a few queries, from all rows: id of the query to vectors."""
    q = np.array([list(r.vector) for r in asked], float)
    own = [r.id for r in asked]
    batch_type = to_arrow_type(rows.schema["id"].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: list[list] = [[] for _ in own]
        for batch in batches:
            x, ids = _matrix(batch.column(1), d), batch.column(0).to_pylist()
            for j, scores in enumerate(q @ x.T):
                first = np.argsort(-scores, kind="stable")[:k + 1]
                best[j] = sorted([*best[j], *((-scores[i], ids[i], x[i].tolist()) for i in first if ids[i] != own[j])])[:k]
        found = [(j, -s, i, x) for j, b in enumerate(best) for s, i, x in b]
        columns = list(zip(*found, strict=True)) or [[], [], [], []]
        yield pa.RecordBatch.from_arrays(
            [pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.float64()), pa.array(columns[2], batch_type),
             pa.array(columns[3], pa.list_(pa.float64()))], names=["query", "score", "id", "vector"])

    found = rows.mapInArrow(run, f"query int, score double, id {rows.schema['id'].dataType.simpleString()}, vector array<double>")
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "id"))
    near: dict = {}
    for r in found.withColumn("rank", rank).where(F.col("rank") <= k).collect():  # SAMPLE * k rows
        near.setdefault(r.query, []).append(r.vector)
    return near


def _visited(d: int, longest: float, seed: int, head: int, kind: type):
    """Of queries with a level: the prefixes they visit."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = Forest(d, longest, seed, head)
        for batch in batches:
            out: list[list] = [[], [], [], []]
            levels = batch.column(2).to_numpy()
            for j, value in enumerate(batch.column(1)):
                level = int(levels[j])
                found = np.zeros((1, 1), np.int64)  # the root, which any tree holds whole
                if level:
                    found = forest.probes(forest.sides(np.frombuffer(value.as_py(), kind)[None].astype(float), True)[0], level)
                out[0].append(np.full(found.size, j))
                out[1].append(np.repeat(np.arange(len(found), dtype=np.int32), found.shape[1]))
                out[2].append(np.full(found.size, level, np.int32))
                out[3].append(found.reshape(-1))
            at, tree, level, prefix = (np.concatenate(c) if c else np.zeros(0, np.int64) for c in out)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(at)), pa.array(tree, pa.int32()), pa.array(level, pa.int32()), pa.array(prefix)],
                names=["id", "tree", "level", "prefix"])

    return run


def fitted_count(near: dict, asked: list, forest: Forest, reached: dict, whole: int) -> int:
    """The fewest candidates with which the sampled queries' true neighbours are found with the recall ``TARGET``.

    ``reached`` holds the rows that a sampled query meets at each level, ``whole`` those at the root.
    """
    sides = forest.sides(np.array([list(r.vector) for r in asked], float), True)
    levels = range(DEPTH + 1)
    met, rows = np.zeros((len(near), DEPTH + 1)), np.zeros((len(near), DEPTH + 1))
    for row, (j, vectors) in enumerate(sorted(near.items())):
        strings = forest.strings(forest.sides(np.array(vectors, float), False))
        met[row, 0], rows[row] = 1, [whole, *(reached.get((asked[j].id, level), 0) for level in levels[1:])]
        for level in levels[1:]:
            visited, prefixes = forest.probes(sides[j], level), strings >> (DEPTH - level)
            met[row, level] = reduce(np.logical_or, (np.isin(prefixes[:, t], visited[t]) for t in range(TREES))).mean()
    for wanted in np.unique(rows[rows > 0]).astype(int):
        level = DEPTH - np.argmax(rows[:, ::-1] >= wanted, axis=1)
        if met[np.arange(len(rows)), level].mean() >= TARGET:
            return int(wanted)
    return whole


def best_of_block(d: int, k: int, kind: type):
    """The ``k`` nearest of each query among the rows of its prefixes in one block."""
    def run(rows: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        if len(rows) and len(queries):
            rows = rows.sort_values("string", kind="stable")
            string, ids = rows["string"].to_numpy(), rows["id"].to_numpy()
            x = np.frombuffer(b"".join(rows["bytes"]), kind).reshape(-1, d).astype(float)
            single = len(np.unique(ids)) == len(ids)
            for own, level, bytes_, prefixes in zip(queries["id"], queries["level"], queries["bytes"], queries["prefixes"]):
                q, shift = np.frombuffer(bytes_, kind).astype(float), DEPTH - level
                prefixes = np.sort(np.asarray(prefixes, np.int64))
                low, high = np.searchsorted(string, prefixes << shift), np.searchsorted(string, (prefixes + 1) << shift)
                runs = [(a, b) for a, b in zip(low.tolist(), high.tolist()) if a < b]
                if not runs:
                    continue
                scores = np.concatenate([x[a:b] @ q for a, b in runs])
                at = np.concatenate([np.arange(a, b) for a, b in runs])
                if single and len(at) > k + 1:  # whatever may be among the nearest k + 1, in spite of rounding
                    edge = np.partition(scores, len(scores) - k - 1)[len(scores) - k - 1]
                    at = at[scores >= edge - NARROW * max(1.0, abs(edge))]
                at = at[ids[at] != own]
                exact = (x[at] * q).sum(axis=1)
                order = np.lexsort((ids[at], -exact))
                distinct = pd.Series(ids[at][order]).drop_duplicates().index[:k] if not single else range(min(k, len(at)))
                out.extend((own, ids[at][order[i]], exact[order[i]]) for i in distinct)
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"])

    return run


def _blocks(n: Column, size: int) -> Column:
    return F.ceil(n / size).cast("int")


def _merged(left: DataFrame, right: DataFrame, on: list[str] | str, how: str = "inner") -> DataFrame:
    """A join in which both sides are shuffled and neither is broadcast.

    Spark estimates sizes from those of files, in which a query's 320 prefixes or a run of equal
    values take next to nothing, and would collect tables in the driver that grow with the input.
    """
    return left.join(right.hint("merge"), on, how)


def visits_of(asked: DataFrame, runs: DataFrame, d: int, longest: float, seed: int, head: int, kind: type, wanted: int) -> DataFrame:
    """``id, tree, level, prefix``: the prefixes that each query visits."""
    reach = f"id {asked.schema['id'].dataType.simpleString()}, tree int, level int, prefix long"

    def visited(levels: DataFrame) -> DataFrame:
        return levels.select("id", "bytes", "level").mapInArrow(_visited(d, longest, seed, head, kind), reach).distinct()

    # down, by the rows that share the query's own prefixes: ``low`` reaches enough, below ``high`` may
    path = (asked.select("id", F.posexplode("strings").alias("tree", "string"))
            .withColumn("level", F.explode(F.sequence(F.lit(1), F.lit(DEPTH))))
            .select("id", "tree", "level", F.expr(f"shiftright(string, {DEPTH} - level)").alias("prefix")).distinct())
    shared = _merged(path, runs, ["tree", "level", "prefix"]).groupBy("id", "level").agg(F.sum("rows").alias("rows"))
    most = 1.5 * F.col("rows") * F.least(F.lit(PROBES), F.pow(F.lit(2), F.col("level")))  # own prefixes may be the smaller ones
    bounds = shared.groupBy("id").agg(F.max(F.when(F.col("rows") >= wanted, F.col("level"))).alias("low"),
                                      F.max(F.when(most >= wanted, F.col("level"))).alias("high"))
    zero = F.lit(0)
    waiting = stored(_merged(asked.select("id", "bytes"), bounds, "id", "left").select(
        "id", "bytes", F.coalesce("low", zero).alias("low"), (F.coalesce("high", zero) + 1).alias("high"),
        F.coalesce("high", zero).alias("level")), "waiting")
    settled = waiting.where("high - low <= 1").select("id", "bytes", F.col("low").alias("level"))
    waiting = waiting.where("high - low > 1")
    while not waiting.isEmpty():  # up: in all trees at once, halving the levels that are left, at most log2(DEPTH) times
        reached = _merged(visited(waiting), runs, ["tree", "level", "prefix"], "left").groupBy("id").agg(F.sum("rows").alias("rows"))
        enough = F.coalesce("rows", zero) >= wanted
        waiting = stored(_merged(waiting, reached, "id").select(
            "id", "bytes", F.when(enough, F.col("level")).otherwise(F.col("low")).alias("low"),
            F.when(enough, F.col("high")).otherwise(F.col("level")).alias("high")), "waiting")
        settled = settled.unionByName(waiting.where("high - low <= 1").select("id", "bytes", F.col("low").alias("level")))
        waiting = waiting.where("high - low > 1").withColumn("level", F.floor((F.col("low") + F.col("high")) / 2).cast("int"))
    return visited(settled)


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding",
            seed: int = 11) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest found of each row where ``is_query`` (of ``id_col``) holds."""
    rows, d = usable(vectors, id_col, vec_col)
    id_type = rows.schema["id"].dataType.simpleString()
    schema = f"query_id {id_type}, rank int, vec_id {id_type}, score double"
    asked = rows.withColumnRenamed("id", id_col).where(is_query).withColumnRenamed(id_col, "id")
    sample = (asked.withColumn("digest", F.md5(F.col("id").cast("string"))).dropDuplicates(["id"])
              .orderBy("digest", "id").limit(SAMPLE).collect())
    if not sample:
        return vectors.sparkSession.createDataFrame([], schema)
    place = F.row_number().over(Window.partitionBy("vector").orderBy("id"))
    kept = stored(rows.distinct().withColumn("place", place).where(F.col("place") <= k + 1).drop("place"), "kept")
    length = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x))
    facts = kept.agg(F.count("*").alias("n"), F.max(length).alias("longest")).first()
    n, longest = facts.n, facts.longest
    bits = max(0, math.ceil(math.log2(n / GROUP)))  # the leading bits of a block
    element = vectors.schema[vec_col].dataType.elementType
    kind = np.float32 if isinstance(element, T.FloatType) else np.float64
    index = stored(hashed(kept, d, longest, seed, bits, False, kind), "index")
    asked = stored(hashed(asked.distinct(), d, longest, seed, bits, True, kind), "asked")
    runs = stored(prefix_counts(index.select(F.posexplode("strings").alias("tree", "string"))), "runs")
    near = compared(kept, sample, d, k)
    if not near:
        return vectors.sparkSession.createDataFrame([], schema)
    levels = asked.join(F.broadcast(vectors.sparkSession.createDataFrame([(r.id,) for r in sample], f"id {id_type}")), "id").select(
        "id", "bytes", F.explode(F.sequence(F.lit(1), F.lit(DEPTH))).alias("level"))
    tried = levels.mapInArrow(_visited(d, longest, seed, bits, kind), f"id {id_type}, tree int, level int, prefix long").distinct()
    reached = _merged(tried, runs, ["tree", "level", "prefix"]).groupBy("id", "level").agg(F.sum("rows").alias("rows")).collect()
    fitted = fitted_count(near, sample, Forest(d, longest, seed, bits), {(r.id, r.level): r.rows for r in reached}, TREES * n)
    repeats = kept.groupBy("id").count().agg(F.max("count")).first()[0]  # vectors of one id
    wanted = max(TREES * (k + 1) * repeats, fitted)  # so many hold k other ids, even if all trees meet the same rows
    visits = stored(visits_of(asked, runs, d, longest, seed, bits, kind, wanted), "visits")

    # blocks of rows and of queries: tree and leading bits, cut further where they hold many rows
    head = F.expr(f"shiftright(string, {DEPTH - bits})")
    trees = index.select("id", "bytes", F.posexplode("strings").alias("tree", "string")).withColumn("head", head)
    short = F.greatest(F.lit(0), bits - F.col("level"))  # a visited prefix shorter than a head covers several
    own = ["tree", "head"]
    met = (visits.withColumn("first", F.expr(f"if(level >= {bits}, shiftright(prefix, level - {bits}), "
                                             f"shiftleft(prefix, {bits} - level))"))
           .withColumn("head", F.explode(F.sequence("first", F.col("first") + F.pow(F.lit(2), short).cast("long") - 1)))
           .groupBy("id", "level", *own).agg(F.collect_list("prefix").alias("prefixes")))  # at most PROBES
    met = stored(met, "met")
    cuts = (trees.groupBy(*own).agg(_blocks(F.count("*"), GROUP).alias("i_of"))
            .join(met.groupBy(*own).agg(_blocks(F.count("*"), BLOCK_QUERIES).alias("j_of")), own))
    cuts = stored(cuts, "cuts")
    left = (trees.join(cuts, own).withColumn("i", F.pmod(F.xxhash64("id"), F.col("i_of")))
            .withColumn("j", F.explode(F.sequence(F.lit(0), F.col("j_of") - 1)))
            .select(*own, F.col("i").cast("int"), "j", "id", "bytes", "string"))
    right = (_merged(met, asked.select("id", "bytes"), "id").join(cuts, own)
             .withColumn("j", F.pmod(F.xxhash64("id"), F.col("j_of")).cast("int"))
             .withColumn("i", F.explode(F.sequence(F.lit(0), F.col("i_of") - 1)))
             .select(*own, "i", "j", "id", "level", "bytes", "prefixes"))
    cell = [*own, "i", "j"]
    best = left.groupBy(*cell).cogroup(right.groupBy(*cell)).applyInPandas(
        best_of_block(d, k, kind), f"query_id {id_type}, vec_id {id_type}, score double")
    best = best.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
