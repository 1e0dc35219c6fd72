"""LM scoring with a subword lattice.

A text is its words (``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z) and one end. The pieces of an
existing vocabulary span a lattice over each word; a word's lattice probability sums over
all its segmentations by a forward recursion in log space. Piece weights start from the
vocabulary's scores (their ranks, read as Zipf's law) and are re-estimated once, by
forward-backward over every distinct training word. Words that the training texts hold also
have an edge of their own: with N training tokens, V distinct ones and the word's count c,

    P(word) = (c + V * lattice(word)) / (N + V + 1),    P(end) = (ends + 1) / (N + V + 1)

so the lattice carries what the counts don't know. Texts come from classes (labels of the
training texts, the most frequent ones, and one class of all other training texts, those
without a label included; never read from a text that is scored), whose word
weights back off in the same way, P(word | class) = (c' + V' * P(word)) / (N' + V' + 1), and
the words of one text are drawn from an urn that repeats itself (``URN`` draws' worth of prior).
A text's probability is the sum over classes; given the class it is a sum over segmentations
word by word, because no piece crosses a space.

Words are counted over all texts; each distinct word is weighted once. Frequent words (more
than one in ``FREQUENT`` tokens, so at most ``FREQUENT`` of them) are summed within the
tasks that read the texts, all others are joined by word, so no hot word is shuffled.

Defined cases: a null or empty text is just the end; rows that repeat are scored each; a null
id counts as empty text when rows are split; without training rows N and V are 0 and the
pieces keep their first weights. Other columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tivlens.llm.common import stored
from tivlens.llm.piece_codec import model_bytes
from tivlens.llm.pieces import MARK, processor

FREQUENT = 500_000
CLASSES = 8  # most frequent labels that get counts of their own; all others share one more class
URN = 4000.0
PRODUCT = 40  # draws up to which factors are multiplied: (URN + PRODUCT) ** PRODUCT is far below the largest double
PENDING = 200_000  # distinct words a task counts before it passes them on
INF = float("inf")


class Lattice:
    """All segmentations of words into pieces; characters without a piece are their bytes."""

    def __init__(self, model: bytes, weights: np.ndarray | None) -> None:
        import ahocorasick

        sp = processor(model)
        n = sp.get_piece_size()
        self.bytes = {int(sp.id_to_piece(i)[3:5], 16): i for i in range(n) if sp.is_byte(i)}
        texts = {i: sp.id_to_piece(i) for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))}
        texts = {i: t for i, t in texts.items() if not t.strip(MARK) == "" or t == MARK}
        if weights is None:  # by rank, bytes last
            rank = np.array([-sp.get_score(i) if i in texts else n for i in range(n)], float)
            weights = np.where([i in texts or sp.is_byte(i) for i in range(n)], 1 / (np.clip(rank, 0, n) + 2.7), 0)
            weights = np.append(weights, weights.sum() / 3)  # the last one ends a word: three pieces on average
        with np.errstate(divide="ignore"):
            self.log = np.log(weights / weights.sum())
        self.stop = float(self.log[-1])
        self.known = {t for t in texts.values() if len(t) == 1}
        self.automaton = ahocorasick.Automaton()
        for i, t in texts.items():
            self.automaton.add_word(t, (len(t), i, float(self.log[i])))
        self.automaton.make_automaton()

    def runs(self, word: str) -> Iterator[tuple[str, bool]]:
        """The word, marked, cut into runs of characters that have pieces and single ones that have none."""
        word = MARK + word
        if self.known.issuperset(word):
            yield word, True
            return
        at = 0
        for k, ch in enumerate(word):
            if ch not in self.known:
                if at < k:
                    yield word[at:k], True
                yield ch, False
                at = k + 1
        if at < len(word):
            yield word[at:], True

    def forward(self, run: str, edges: list | None = None) -> list[float]:
        """Log probability of every prefix, summed over its segmentations."""
        a = [-INF] * (len(run) + 1)
        a[0] = 0.0
        for end, (size, piece, log) in self.automaton.iter(run):
            end += 1
            x = a[end - size] + log
            m = a[end]
            if m == -INF:
                a[end] = x
            elif x > m:
                a[end] = x + math.log1p(math.exp(m - x))
            else:
                a[end] = m + math.log1p(math.exp(x - m))
            if edges is not None:
                edges.append((end - size, end, piece, log))
        return a

    def log_probability(self, word: str) -> float:
        """Natural log of the word's probability, its end included."""
        total = self.stop
        for run, pieces in self.runs(word):
            total += self.forward(run)[-1] if pieces else sum(float(self.log[self.bytes[b]]) for b in run.encode())
        return total

    def expect(self, word: str, counts: np.ndarray) -> None:
        """Add the expected number of times that each piece is used in the word."""
        counts[-1] += 1
        for run, pieces in self.runs(word):
            if not pieces:
                for b in run.encode():
                    counts[self.bytes[b]] += 1
                continue
            edges: list = []
            a = self.forward(run, edges)
            whole, b = a[-1], [-INF] * (len(run) + 1)
            b[-1] = 0.0
            for start, end, piece, log in reversed(edges):
                x = b[end] + log
                share = a[start] + x - whole
                if share > -40:
                    counts[piece] += math.exp(share)
                m = b[start]
                if m == -INF:
                    b[start] = x
                elif x > m:
                    b[start] = x + math.log1p(math.exp(m - x))
                else:
                    b[start] = m + math.log1p(math.exp(x - m))


@lru_cache(maxsize=2)
def lattice(model: bytes, weights: bytes | None) -> Lattice:
    """One lattice per worker and set of weights."""
    return Lattice(model, None if weights is None else np.frombuffer(weights))


def word_counts(docs: DataFrame, kind: Column, classes: int, text_col: str) -> DataFrame:
    """``word binary, n_all, c, c0, c1, ...``: how often all, training and each class's texts hold each word.

    ``kind`` is -1 for texts that aren't learned from, else the class or, without one, ``classes``. Tasks count first.
    """
    names = ["n_all", "c", *[f"c{k}" for k in range(classes)]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[int, Counter] = {k: Counter() for k in range(-1, classes + 1)}

        def flush() -> pa.RecordBatch:
            both = list(set().union(*counts.values()))
            by_kind = {k: np.fromiter(map(x.get, both, repeat(0)), np.int64, len(both)) for k, x in counts.items()}
            learned = sum(x for k, x in by_kind.items() if k >= 0)
            for x in counts.values():
                x.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array(both, pa.binary()), pa.array(learned + by_kind[-1]), pa.array(learned),
                 *[pa.array(by_kind[k]) for k in range(classes)]], names=["word", *names])

        for batch in batches:
            for value, k in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                counts[k].update((value.as_py() or b"").lower().split())
                if sum(map(len, counts.values())) > PENDING:
                    yield flush()
        yield flush()

    rows = docs.select(F.col(text_col).cast("binary").alias("text"), kind.cast("int").alias("kind"))
    counted = rows.mapInArrow(run, "word binary, " + ", ".join(f"{x} long" for x in names))
    return counted.groupBy("word").agg(*[F.sum(x).alias(x) for x in names])


def piece_weights(words: DataFrame, model: bytes) -> np.ndarray:
    """Expected uses of every piece over the distinct training words, each counted once; the last is the word end."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = lattice(model, None)
        counts = np.zeros(len(net.log))
        for batch in batches:
            for value in batch.column(0):
                net.expect(value.as_py().decode(), counts)
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(counts[at])], names=["piece", "uses"])

    found = (words.where("c > 0").select("word").mapInArrow(run, "piece int, uses double")
             .groupBy("piece").agg(F.sum("uses").alias("uses")).collect())  # one row per piece
    first = lattice(model, None).log
    weights = np.where(np.isfinite(first), np.exp(first), 0.0)  # counts as one word does, so that no piece is impossible
    for r in found:
        weights[r.piece] += r.uses
    return weights


def _log(x: float) -> float:
    return math.log(x) if x > 0 else -INF


def drawn(log_p: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Log weights of ``k`` draws each of some words from the urn, without the part that depends on the text's length alone.

    Rows of ``log_p`` are words, columns classes. Beyond the first draw the weight is the product of
    ``URN * p + j`` for j from 1 to k - 1, which is a quotient of gamma functions.
    """
    out = math.log(URN) + log_p
    again = np.flatnonzero(k > 1)
    again = again[np.argsort(-k[again], kind="stable")]
    urn, times = URN * np.exp(log_p[again]), k[again]
    many = int(np.count_nonzero(times > PRODUCT))
    product = np.ones_like(urn[many:])
    for j in range(1, int(times[many]) if many < len(times) else 1):
        n = np.count_nonzero(times[many:] > j)
        product[:n] *= urn[many:many + n] + j
    out[again[many:]] += np.log(product)
    for at, u, n in zip(again[:many].tolist(), urn[:many].tolist(), times[:many].tolist(), strict=True):
        out[at] += [math.lgamma(x + n) - math.lgamma(x + 1) for x in u]
    return out


def score_texts(docs: DataFrame, training: Column, model_path: str, label_col: str | None = None,
                id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, training, n_tokens, n_known, train_tokens, base_score, score`` for every row; logarithms to base 10.

    ``base_score`` is the add-one word model: the sum of log10((c + 1) / (N + V + 1)).
    """
    model = model_bytes(model_path)
    spark = docs.sparkSession
    label = F.col(label_col).cast("string") if label_col else F.lit(None).cast("string")
    sizes = docs.where(training).groupBy(label.alias("label")).agg(F.count("*").alias("n"))
    ends = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first().n
    largest = sizes.where("label is not null").orderBy(F.desc("n"), "label").limit(CLASSES).collect()
    kind = F.lit(len(largest))
    for k, r in enumerate(largest):
        kind = F.when(label == r.label, k).otherwise(kind)
    classes = len(largest)
    words = stored(word_counts(docs, F.when(training, kind).otherwise(-1), classes, text_col), "words")
    texts = [r.n for r in largest]
    if classes and (others := ends - sum(texts)):  # without any label all texts are of the one plain class
        words = words.withColumn(f"c{classes}", F.col("c") - sum(F.col(f"c{k}") for k in range(classes)))
        texts.append(others)
        classes += 1
    zero = F.lit(0)
    facts = words.agg(
        F.coalesce(F.sum("n_all"), zero).alias("all"), F.coalesce(F.sum("c"), zero).alias("n"),
        F.count(F.when(F.col("c") > 0, 1)).alias("v"),
        *[F.coalesce(F.sum(f"c{k}"), zero).alias(f"n{k}") for k in range(classes)],
        *[F.count(F.when(F.col(f"c{k}") > 0, 1)).alias(f"v{k}") for k in range(classes)]).first()
    n, v = facts.n + ends, facts.v + (ends > 0)
    of = [(facts[f"n{k}"] + e, facts[f"v{k}"] + 1, e) for k, e in enumerate(texts)]  # tokens, distinct ones, texts
    packed = piece_weights(words, model).tobytes()
    base_end, log_end = math.log10((ends + 1) / (n + v + 1)), math.log((ends + 1) / (n + v + 1))
    ended = [_log((e + vk * math.exp(log_end)) / (nk + vk + 1)) for nk, vk, e in of] or [log_end]
    share = [_log(e / sum(x[2] for x in of)) for *_, e in of] or [0.0]
    wide = range(len(ended))

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = lattice(model, packed)
        for batch in batches:
            c = batch.column(2).to_numpy()
            deep = np.array([net.log_probability(w.as_py().decode()) for w in batch.column(0)], float)
            with np.errstate(divide="ignore"):
                whole = np.logaddexp(np.log(c), np.log(v) + deep) - np.log(n + v + 1) if v else deep
                each = [np.logaddexp(np.log(batch.column(3 + k).to_numpy()), np.log(vk) + whole) - np.log(nk + vk + 1)
                        for k, (nk, vk, _) in enumerate(of)] or [whole]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(c > 0), pa.array(np.log10((c + 1) / (n + v + 1))),
                 *map(pa.array, each)], names=["word", "n_all", "known", "base", *[f"s{k}" for k in wide]])

    scores = ", ".join(f"s{k} double" for k in wide)
    weighed = stored(words.mapInArrow(weigh, f"word binary, n_all long, known boolean, base double, {scores}"), "weighed")
    frequent = F.col("n_all") * FREQUENT > facts["all"]
    table = weighed.where(frequent).toArrow()  # at most FREQUENT rows
    sent = spark.sparkContext.broadcast((
        {w: i for i, w in enumerate(table["word"].to_pylist())}, table["known"].to_numpy().astype(np.int64), table["base"].to_numpy(),
        np.stack([table[f"s{k}"].to_numpy() for k in wide], axis=1)))
    end_weights = drawn(np.array([ended]), np.array([1]))[0] + np.array(share)

    def sum_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, is_known, base, log_p = sent.value
        find = places.get
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                tokens, distinct, rare_words, offsets = [], [], [], [0]
                found, times, rare_times = [], [], []
                for value in part.column(3):
                    counts = Counter((value.as_py() or b"").lower().split())
                    where = np.fromiter(map(find, counts, repeat(-1)), np.int64, len(counts))
                    k = np.fromiter(counts.values(), np.int64, len(counts))
                    tokens.append(1 + int(k.sum()))
                    held = where >= 0
                    if not held.all():
                        ws = [*counts]
                        rare_words.extend([ws[j] for j in np.flatnonzero(~held).tolist()])
                        rare_times.append(k[~held])
                        where, k = where[held], k[held]
                    offsets.append(len(rare_words))
                    distinct.append(len(where))
                    found.append(where)
                    times.append(k)
                where, k = np.concatenate(found), np.concatenate(times)
                text, n = np.repeat(np.arange(part.num_rows), distinct), part.num_rows
                weights = drawn(log_p[where], k)
                length = np.array([math.lgamma(URN) - math.lgamma(URN + t) for t in tokens])
                rare = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(
                    [pa.array(rare_words, pa.binary()), pa.array(np.concatenate([*rare_times, np.empty(0, np.int64)]))], names=["word", "k"]))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), part.column(2), pa.array(tokens, pa.int64()),
                     pa.array(int(ends > 0) + np.bincount(text, is_known[where] * k, n).astype(np.int64)),
                     pa.array(base_end + np.bincount(text, base[where] * k, n)),
                     *[pa.array(end_weights[j] + length + np.bincount(text, weights[:, j], n)) for j in wide], rare],
                    names=["rid", "doc_id", "training", "n_tokens", "n_known", "base", *[f"s{k}" for k in wide], "rare"])

    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).alias("doc_id"),
                       training.alias("training"), F.col(text_col).cast("binary").alias("text"))
    parts = stored(rows.mapInArrow(sum_up, (
        f"rid long, doc_id {rows.schema['doc_id'].dataType.simpleString()}, training boolean, n_tokens long, "
        f"n_known long, base double, {scores}, rare array<struct<word: binary, k: bigint>>")), "parts")

    def rare_draws(log_p: Column) -> Column:
        again = F.aggregate(F.sequence(F.lit(1), F.col("k").cast("int") - 1), F.lit(0.0),
                            lambda total, j: total + F.log(URN * F.exp(log_p) + j))
        return F.log(F.lit(URN)) + log_p + F.when(F.col("k") > 1, again).otherwise(0.0)

    rare = (parts.select("rid", F.explode("rare").alias("r")).select("rid", "r.word", "r.k")
            .join(weighed.where(~frequent).drop("n_all"), "word").groupBy("rid")
            .agg(F.sum(F.col("k") * F.col("known").cast("long")).alias("more"), F.sum(F.col("k") * F.col("base")).alias("b"),
                 *[F.sum(rare_draws(F.col(f"s{k}"))).alias(f"m{k}") for k in wide]))
    none = F.lit(0.0)
    both = parts.drop("rare").join(rare, "rid", "left")
    sums = [F.col(f"s{k}") + F.coalesce(F.col(f"m{k}"), none) for k in wide]
    most = F.greatest(*sums) if len(sums) > 1 else sums[0]
    total = most + F.log(sum(F.exp(x - most) for x in sums))
    return both.select(
        "doc_id", "training", "n_tokens", (F.col("n_known") + F.coalesce("more", F.lit(0))).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"), (F.col("base") + F.coalesce("b", none)).alias("base_score"),
        (total / math.log(10)).alias("score"))
