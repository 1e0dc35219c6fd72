"""Benchmark decontamination: pairs of words as seeds, then Smith-Waterman alignment.

A seed is a pair of an item's words that are neighbours or have one word between them, and a
document holds it where the two are neighbours or have one word between them: so one edit
between them is allowed. An alignment of n words that scores ``least`` (L) or more has at least
Ln - 1 such pairs, with as many different left words: of m equal words, at most 2m - 2Ln edits
lie in the m - 1 places between them, so at most m - Ln places have two or more. Hence the pairs
of the n - (Ln - 1) least likely left words are enough to find every place. Likelihood is the
product of the words' relative frequencies over all documents; pairs up to ``chance`` are seeds
besides. Items of so few words that one equal word is enough (Ln <= 1) have single words as seeds.
Around seeds, places that hold at least Ln of the item's words are aligned with the item:
the result is that of comparing every document with every item in full.

The corpus is read twice and never shuffled: benchmark items, a stated set that doesn't
grow with the corpus, go to the tasks in blocks of about ``block`` items (one pass for each block).

Scores: 2 for an equal word, -1 for another word or a gap, divided by twice the item's length.

Defined cases: words are ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z; a null or empty text or
item matches nothing; rows that repeat a document or an item are compared each, and equal
result rows are not merged; a null id stays null.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

ROUND = 1e-9  # rounding allowed for in bounds
EQUAL, OTHER, GAP = 2, -1, -1


def words(text: bytes | None) -> list[bytes]:
    return text.lower().split() if text else []  # of bytes: ASCII only


def smith_waterman(item: np.ndarray, region: np.ndarray) -> tuple[int, int]:
    """Best local score and the place in ``region`` where it ends; negative codes equal nothing."""
    steps = np.arange(len(region) + 1)
    row, best, end = np.zeros(len(region) + 1, np.int64), 0, 0
    for code in item:
        fresh = np.zeros_like(row)
        fresh[1:] = np.maximum(row[:-1] + np.where(region == code, EQUAL, OTHER), row[1:] + GAP)
        np.maximum(fresh, 0, out=fresh)
        row = np.maximum.accumulate(fresh - GAP * steps) + GAP * steps
        at = int(row.argmax())
        if row[at] > best:
            best, end = int(row[at]), at
    return best, end


def align(item: np.ndarray, region: np.ndarray) -> tuple[int, int, int]:
    """Best local score with its start and end in ``region``."""
    best, end = smith_waterman(item, region)
    back = smith_waterman(item[::-1], region[:end][::-1])[1]
    return best, end - back, end


class Items:
    """The seeds of a block of items: coded words and pairs of words."""

    def __init__(self, items: list[tuple], frequency: dict[bytes, float], chance: float, least: float) -> None:
        texts = [(i, words(t)) for i, t in items]
        self.code = {w: k for k, w in enumerate(sorted({w for _, ws in texts for w in ws}))}
        self.ids = [i for i, _ in texts]
        self.words = [np.array([self.code[w] for w in ws], np.int64) for _, ws in texts]
        self.least = least
        self.seen = np.zeros(len(self.code), bool)
        rarity = np.array([frequency.get(w, 0.0) for w in self.code])
        single: list[tuple[int, int, int]] = []
        pairs: list[tuple[int, int, int]] = []
        for k, codes in enumerate(self.words):
            n = len(codes)
            p = rarity[codes]
            equal = max(1, math.ceil(least * n - ROUND))  # words at least
            if (close := math.ceil(least * n - 1 - ROUND)) < 1:
                order = np.argsort(p, kind="stable")
                single.extend((int(codes[j]), k, int(j)) for j in order[:max(0, n - equal + 1)])
                continue
            odds = p[:-1] * 2 * (p[1:] + np.append(p[2:], 0.0))
            order = np.argsort(odds, kind="stable")
            needed = max(0, n - close)
            for at, j in enumerate(order):
                if at < needed or odds[j] <= chance:
                    pairs.extend((int(codes[j]) * len(self.code) + int(b), k, int(j)) for b in set(codes[j + 1:j + 3].tolist()))
        self.single, self.pairs = self._index(single), self._index(pairs)

    @staticmethod
    def _index(seeds: list[tuple[int, int, int]]) -> tuple[np.ndarray, ...]:
        """Distinct keys, where the places of each start, and the items and places in them."""
        key, item, place = np.array(sorted(seeds), np.int64).reshape(-1, 3).T
        keys, starts = np.unique(key, return_index=True)
        return keys, np.append(starts, len(key)), item, place

    @staticmethod
    def _look_up(index: tuple[np.ndarray, ...], spots: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        """Rows (item, place in the document, place in the item)."""
        keys, starts, item, place = index
        if not len(keys) or not len(wanted):
            return np.empty((0, 3), np.int64)
        where = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        hit = np.flatnonzero(keys[where] == wanted)
        first, n = starts[where[hit]], starts[where[hit] + 1] - starts[where[hit]]
        at = np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())
        return np.stack([item[at], np.repeat(spots[hit], n), place[at]], axis=1)

    def places(self, doc: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """Each item with seeds in ``doc``, with rows (item, place in the document, place in the item)."""
        known = np.flatnonzero(doc >= 0)
        found = [self._look_up(self.single, known, doc[known])]
        for gap in (1, 2):
            spots = known[known < len(doc) - gap]
            spots = spots[doc[spots + gap] >= 0]
            found.append(self._look_up(self.pairs, spots, doc[spots] * len(self.code) + doc[spots + gap]))
        hits = np.concatenate(found)
        if not len(hits):
            return
        hits = np.unique(hits, axis=0)
        for part in np.split(hits, np.flatnonzero(np.diff(hits[:, 0])) + 1):
            yield int(part[0, 0]), part

    def may_hold(self, item: np.ndarray, region: np.ndarray) -> bool:
        """Whether enough of the item's words are in the region, and enough of the region's in the item."""
        enough, seen = self.least * len(item) - ROUND, self.seen
        region = region[region >= 0]
        seen[region] = True
        held = np.count_nonzero(seen[item])
        seen[region] = False
        if held < enough:
            return False
        seen[item] = True
        held = np.count_nonzero(seen[region])
        seen[item] = False
        return held >= enough

    def matches(self, doc: np.ndarray) -> Iterator[tuple[int, float, int, int, int]]:
        """(item, score, start, end, seeds) of each item's best place."""
        for k, hits in self.places(doc):
            item = self.words[k]
            pad = int(2 * len(item) * (1 - self.least) + ROUND)  # edits at most
            spans: list[list[int]] = []
            for start in np.unique(hits[:, 1] - hits[:, 2]).tolist():
                low, high = max(0, start - pad), min(len(doc), start + len(item) + pad)
                if spans and high <= spans[-1][1] or not self.may_hold(item, doc[low:high]):
                    continue
                if spans and low <= spans[-1][1]:
                    spans[-1][1] = high
                else:
                    spans.append([low, high])
            enough = self.least * EQUAL * len(item) - ROUND
            found = [(align(item, doc[a:b]), -a) for a, b in spans if smith_waterman(item, doc[a:b])[0] >= enough]
            if found:
                (score, start, end), shift = max(found)
                yield k, score / (EQUAL * len(item)), start - shift, end - shift, len(hits)


def word_frequencies(docs: DataFrame, vocabulary: set[bytes], text_col: str) -> dict[bytes, float]:
    """Relative frequency over all documents of the words given, by far fewer rows than documents."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for value in batch.column(0):
                ws = words(value.as_py())
                counts[None] += len(ws)
                counts.update(filter(vocabulary.__contains__, ws))
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())],
                                         names=["word", "n"])

    counted = (docs.select(F.col(text_col).cast("binary").alias("text")).mapInArrow(run, "word binary, n long")
               .groupBy("word").agg(F.sum("n").alias("n")))
    found = {None if r.word is None else bytes(r.word): r.n for r in counted.collect()}
    total = max(1, found.pop(None, 0) or 0)
    return {w: n / total for w, n in found.items()}


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 item_col: str = "item_id", item_text: str = "text", least: float = 0.5, chance: float = 1e-6,
                 block: int = 20_000) -> DataFrame:
    """``doc_id, item_id, score, start_word, end_word, n_seeds`` where an item's score is ``least`` or more."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    whole = None
    for items, id_type in _blocks(docs, benchmark, text_col, item_col, item_text, least, chance, block):
        schema = T.StructType([rows.schema["doc_id"], id_type, T.StructField("score", T.DoubleType()),
                               T.StructField("start_word", T.LongType()), T.StructField("end_word", T.LongType()),
                               T.StructField("n_seeds", T.LongType())])
        found = rows.mapInArrow(_matcher(items, to_arrow_type(id_type.dataType)), schema)
        whole = found if whole is None else whole.unionByName(found)
    return whole


def uncontaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id",
                   item_text: str = "text", least: float = 0.5, chance: float = 1e-6, block: int = 20_000) -> DataFrame:
    """The rows of ``docs`` in which no item has a score of ``least`` or more, each judged by its own text."""
    left = docs
    for items, _ in _blocks(docs, benchmark, text_col, item_col, item_text, least, chance, block):
        left = left.select("*", F.col(text_col).cast("binary").alias("__text")).mapInArrow(_filter(items), docs.schema)
    return left


def _blocks(docs: DataFrame, benchmark: DataFrame, text_col: str, item_col: str, item_text: str, least: float,
            chance: float, block: int) -> Iterator[tuple[Items, T.StructField]]:
    """The benchmark in blocks, with the field of its ids."""
    items = benchmark.select(F.col(item_col).alias("item_id"), F.col(item_text).cast("binary").alias("text"))
    blocks = max(1, -(-items.count() // block))
    for k in range(blocks):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k)
        pairs = [(r.item_id, None if r.text is None else bytes(r.text)) for r in part.collect()]
        frequency = word_frequencies(docs, {w for _, t in pairs for w in words(t)}, text_col)
        yield Items(pairs, frequency, chance, least), items.schema["item_id"]


def _coded(items: Items, text: bytes | None) -> np.ndarray:
    code, ws = items.code.get, words(text)
    return np.fromiter((code(w, -1) for w in ws), np.int64, len(ws))


def _filter(items: Items):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_columns - 1
            clean = [next(items.matches(_coded(items, value.as_py())), None) is None for value in batch.column(n)]
            yield batch.select(list(range(n))).filter(pa.array(clean, pa.bool_()))

    return run


def _matcher(items: Items, id_type: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, found = [], []
            for k, value in enumerate(batch.column(1)):
                for match in items.matches(_coded(items, value.as_py())):
                    at.append(k)
                    found.append(match)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(at, pa.int64())),
                 pa.array([items.ids[m[0]] for m in found], id_type),
                 *[pa.array([m[j] for m in found], pa.float64() if j == 1 else pa.int64()) for j in range(1, 5)]],
                names=["doc_id", "item_id", "score", "start_word", "end_word", "n_seeds"])

    return run
