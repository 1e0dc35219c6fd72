"""Alignment of two tokenizers over the same texts, and how often their tokens overlap.

``" " + text`` is encoded by a byte-level BPE (A) and the text by a SentencePiece BPE (B, which puts
that space in front itself). Both are tilings of the same bytes. Interval coalescing: the tokens
of both are sorted by start, ends are accumulated to a running maximum, and a group ends where the
next start reaches it. Tokens of A and B whose byte ranges overlap are links; a pair of ids
counts how many links of the corpus hold it.

Texts are cut before a space that follows a character that is no white space. No pre-token of A
and no merge of B crosses such a place (B's side is checked by ``pieces``), so groups never do
either, and a text's groups and links are those of its parts, one after the other. A worker
keeps the groups and links of the parts it meets in a bounded table; new parts of a batch of
texts are encoded and coalesced together. Where A's merge ranks alone are proven to encode as its
merges do, parts of settled characters are encoded by ranks, which is several times faster.

Two passes over the texts: the first counts pairs (tasks add up their own parts' links, Spark
sums by pair), the second looks counts up. Pairs that make up more than one link in ``FREQUENT``
are at most ``FREQUENT``; their counts are sent to the tasks. Links of all other pairs are joined
by pair, so no hot pair is shuffled. One way for every size of the corpus.

Defined cases: a null or empty text, and one whose tokens' joined bytes differ from space + text in A
or B (such as a text with the space marker U+2581), has no tokens: zeros, and '' for its groups; it
adds nothing to the counts. Special tokens' strings are plain text. Rows that repeat count each;
a null id is kept; very long texts and parts are whole; an empty table gives no rows. Other columns
are not read.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import uuid
from collections.abc import Iterator
from itertools import chain, compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tivlens.llm.common import stored
from tivlens.llm.piece_codec import model_bytes
from tivlens.llm.pieces import MARK, encoder, processor

FREQUENT = 1_000_000
KNOWN = 400_000  # parts that a worker keeps
KNOWN_LINKS = 4_000_000  # and their links
ROWS, CHARS = 500, 2_000_000  # texts handled at once
B_BITS = 20  # a pair of ids is a << B_BITS | b

# what may be white space to either tokenizer
_BLANK = "\\s\u180e\u200b-\u200d\u2060\ufeff"
_PART = re.compile(f" [{_BLANK}]*[^{_BLANK}]*(?:(?! )[{_BLANK}]+[^{_BLANK}]*)*").findall
_UNCUT = re.compile(f"(?:^|[{_BLANK}]) ").search
_ASCII_UNCUT = ["  ", *(c + " " for c in "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f")]


def parts(text: str) -> list[str]:
    """The parts of a text that isn't empty, each without the space it starts with."""
    if text.isascii():
        uncut = text[0] == " " or any(x in text for x in _ASCII_UNCUT)
    else:
        uncut = _UNCUT(text)
    return [p[1:] for p in _PART(" " + text)] if uncut else text.split(" ")


def _byte_alphabet() -> dict[str, int]:
    """The characters that byte-level vocabularies write bytes as: printable ones as they are, others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


def coalesce(a_end: np.ndarray, a_size: np.ndarray, b_end: np.ndarray, b_size: np.ndarray
             ) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Two tilings: group of each A token, of each B token, and the links as indexes into A and B."""
    start = np.r_[a_end - a_size, b_end - b_size]
    end = np.r_[a_end, b_end]
    order = np.lexsort((end, start))
    reached = np.maximum.accumulate(end[order])
    opens = np.r_[True, start[order][1:] >= reached[:-1]] if len(order) else np.zeros(0, bool)
    group = np.empty(len(order), np.int64)
    group[order] = np.cumsum(opens) - 1
    first = np.searchsorted(b_end, a_end - a_size, "right")
    n = np.searchsorted(b_end - b_size, a_end, "left") - first
    a_of = np.repeat(np.arange(len(a_end)), n)
    b_of = np.arange(len(a_of)) + np.repeat(first - (np.cumsum(n) - n), n)
    return group[:len(a_end)], group[len(a_end):], a_of, b_of


def _sums(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sums of consecutive stretches of rows that end before ``ends``."""
    whole = np.concatenate([np.zeros((1, *values.shape[1:]), np.int64), np.cumsum(values, axis=0, dtype=np.int64)])
    return whole[ends] - whole[np.r_[0, ends[:-1]]] if len(ends) else whole[:0]


_AFTER, _END = (b",", b"|", b";", b""), 3  # within a side, between sides, between groups, at the end of a part

#: Fixed value: how byte-level BPE vocabularies of this kind split a text.
PRETOKENS = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters below this one belong to the same classes in every version of Unicode (tested one by one).
SETTLED = "\u0250"


def ranks(a_json: bytes) -> dict[bytes, int] | None:
    """Merge ranks of vocabulary A by bytes if ranks alone encode as its merges do, else None.

    They do if ids count the merges in order and every token, cut into bytes, is merged into itself:
    then no two neighbours that make up a token can ever be others than those its merge names.
    """
    from tokenizers import Tokenizer

    spec = json.loads(a_json)
    model, split = spec["model"], spec["pre_tokenizer"] or {}
    alphabet, vocab = _byte_alphabet(), model["vocab"]
    merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    plain = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space") \
        and spec["normalizer"] is None and not model.get("ignore_merges")
    if not plain or sorted(vocab[c] for c in alphabet) != [*range(256)] \
            or any(vocab.get(x + y) != 256 + k for k, (x, y) in enumerate(merges)) or len(vocab) != 256 + len(merges):
        return None
    merged = Tokenizer.from_str(a_json.decode()).model
    if any(len(merged.tokenize(t)) != 1 for t in vocab):
        return None
    return {bytes(alphabet[ch] for ch in t): i for t, i in vocab.items()}


class _Models:
    def __init__(self, a_path: str, b_path: str) -> None:
        self.a, self.b = model_bytes(a_path), model_bytes(b_path)
        encoder(self.b)  # refuses models that the cuts don't hold for
        self.ranks = ranks(self.a)
        self.key = hashlib.sha256(self.a + self.b).hexdigest()


def _easy(part: str) -> bool:
    """Its characters' classes are settled, and what follows it may be encoded with it."""
    return bool(part) and ("!" <= part[-1] <= "~" or part[-1] >= "\u00a1") and (part.isascii() or max(part) < SETTLED)


class Aligner:
    """Groups and links of parts, with counts of pairs if there are any yet."""

    def __init__(self, models: _Models, counts: tuple[np.ndarray, np.ndarray, np.ndarray] | None, groups: bool = True) -> None:
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.a = Tokenizer.from_str(models.a.decode())
        self.a.encode_special_tokens = True
        self.b = processor(models.b)
        self.quick = None
        if models.ranks:
            import tiktoken

            self.quick = tiktoken.Encoding("a", pat_str=PRETOKENS, mergeable_ranks=models.ranks, special_tokens={}).encode_ordinary
        alphabet = _byte_alphabet()
        vocab = self.a.get_vocab(with_added_tokens=False)
        self.a_bytes = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            self.a_bytes[i] = bytes(alphabet[ch] for ch in token)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(MARK, " ").encode()
                        for i, p in enumerate(pieces)]
        self.a_size = np.array(list(map(len, self.a_bytes)))
        self.b_size = np.array(list(map(len, self.b_bytes)))
        self.mark = self.b.piece_to_id(MARK)
        self.counts = counts
        # the text of every id of A, then of B, with each separator that may follow it
        self.shown = [b"%d%b" % (i, after) for n in (len(self.a_bytes), len(pieces)) for i in range(n) for after in _AFTER] if groups else []
        self.shown_size = np.array(list(map(len, self.shown)))
        self.clear()

    def clear(self) -> None:
        self.at: dict[str, int] = {}
        self.groups: list[bytes] = []
        self.links: list[np.ndarray] = []  # of all parts, in order
        self.rare = np.zeros(0, np.int64)  # links whose counts aren't known here, in order
        self.rare_ends = np.zeros(0, np.int64)
        self.n_links = 0
        # tokens of A and of B, groups, links, links of the best count, sum of counts, rare links, whether bytes differ
        self.facts = np.zeros((1024, 8), np.int64)

    @property
    def full(self) -> bool:
        return len(self.at) > KNOWN or self.n_links > KNOWN_LINKS

    def _encode_a(self, new: list[str], raw: list[bytes], easy: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the parts, one after the other, and where those of each end; the first ``easy`` ones are easy."""
        ids, ends = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if easy:
            found = np.array(self.quick(" " + " ".join(new[:easy])), np.int64)
            reached, wanted = np.cumsum(self.a_size[found]), np.cumsum(list(map(len, raw[:easy])))
            last = np.searchsorted(reached, wanted)
            if len(found) == last[-1] + 1 and (reached[last] == wanted).all():
                ids, ends = found, last + 1
            else:
                easy = 0
        rest = [e.ids for e in self.a.encode_batch_fast([" " + x for x in new[easy:]], add_special_tokens=False)]
        more = np.fromiter(chain.from_iterable(rest), np.int64)
        return np.r_[ids, more], np.r_[ends, len(ids) + np.cumsum(np.fromiter(map(len, rest), np.int64, len(rest)))]

    def _differing(self, ids: np.ndarray, ends: np.ndarray, known: list[bytes], raw: list[bytes]) -> np.ndarray:
        """Of each part: whether its tokens' joined bytes are others than its own."""
        own = list(map(known.__getitem__, ids.tolist()))
        sizes = self.a_size if known is self.a_bytes else self.b_size
        if b"".join(own) == b"".join(raw) and (_sums(sizes[ids], ends) == list(map(len, raw))).all():
            return np.zeros(len(raw), bool)
        return np.array([b"".join(own[i:j]) != r for i, j, r in zip([0, *ends[:-1].tolist()], ends.tolist(), raw, strict=True)])

    def _learn(self, new: list[str]) -> None:
        sure = [self.quick is not None and _easy(x) for x in new]
        new = [*compress(new, sure), *(x for x, y in zip(new, sure, strict=True) if not y)]
        raw = [b" " + x.encode() for x in new]
        a_ids, a_ends = self._encode_a(new, raw, sum(sure))
        found = self.b.encode(new, num_threads=1)
        if "" in new:  # nothing but the space in front, which the library leaves out
            found[new.index("")] = [self.mark]
        b_ids = np.array(list(chain.from_iterable(found)), np.int64)
        b_ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)))
        differs = self._differing(a_ids, a_ends, self.a_bytes, raw) | self._differing(b_ids, b_ends, self.b_bytes, raw)
        if differs.any():
            a_n, b_n = np.diff(a_ends, prepend=0), np.diff(b_ends, prepend=0)
            a_ids, b_ids = a_ids[~np.repeat(differs, a_n)], b_ids[~np.repeat(differs, b_n)]
            a_ends, b_ends = np.cumsum(a_n * ~differs), np.cumsum(b_n * ~differs)
        a_size, b_size = self.a_size[a_ids], self.b_size[b_ids]
        a_group, b_group, a_of, b_of = coalesce(np.cumsum(a_size), a_size, np.cumsum(b_size), b_size)
        pairs = a_ids[a_of] << B_BITS | b_ids[b_of]
        link_ends = np.searchsorted(a_of, a_ends)
        # both tilings are sorted, so a part's groups are consecutive
        group_ends = np.where(a_ends > 0, a_group[np.maximum(a_ends - 1, 0)] + 1, 0) if len(a_ids) else np.zeros_like(a_ends)
        n = len(self.at)
        while len(self.facts) < n + len(new):
            self.facts = np.concatenate([self.facts, np.zeros_like(self.facts)])
        own = self.facts[n:n + len(new)]
        own[:, :4] = np.stack([np.diff(x, prepend=0) for x in (a_ends, b_ends, group_ends, link_ends)], axis=1)
        own[:, 7] = differs
        if self.counts is None:
            self.links.append(pairs)
        else:
            keys, totals, best = self.counts
            if len(keys):
                spot = np.minimum(np.searchsorted(keys, pairs), len(keys) - 1)
                sent = keys[spot] == pairs
                seen = np.stack([sent & best[spot], np.where(sent, totals[spot], 0), ~sent], axis=1)
            else:
                sent = np.zeros(len(pairs), bool)
                seen = np.stack([sent, sent, ~sent], axis=1)
            own[:, 4:7] = _sums(seen, link_ends)
            self.rare = np.r_[self.rare, pairs[~sent]]
            self.rare_ends = np.cumsum(self.facts[:n + len(new), 6])
        if self.shown:
            self._write_groups(a_ids, b_ids, a_group, b_group, a_ends, b_ends)
        self.n_links += len(pairs)
        self.at.update(zip(new, range(n, n + len(new)), strict=True))

    def _write_groups(self, a_ids, b_ids, a_group, b_group, a_ends, b_ends) -> None:
        group = np.r_[a_group, b_group]
        side = np.r_[np.zeros(len(a_ids), np.int64), np.ones(len(b_ids), np.int64)]
        part = np.r_[*(np.repeat(np.arange(len(e)), np.diff(e, prepend=0)) for e in (a_ends, b_ends))]
        order = np.lexsort((side, group))
        group, side, part = group[order], side[order], part[order]
        after = np.full(len(order), _END)
        if len(order):
            same = group[1:] == group[:-1]
            after[:-1] = np.where(same, np.where(side[1:] == side[:-1], 0, 1), np.where(part[1:] == part[:-1], 2, _END))
        code = (np.r_[a_ids, b_ids + len(self.a_bytes)][order]) * len(_AFTER) + after
        whole = b"".join(map(self.shown.__getitem__, code.tolist()))
        ends = np.r_[0, np.cumsum(self.shown_size[code])][a_ends + b_ends].tolist()
        self.groups.extend(whole[i:j] for i, j in zip([0, *ends[:-1]], ends, strict=True))

    def rare_links(self, parts_at: np.ndarray) -> np.ndarray:
        """The links of some parts whose counts aren't known here."""
        n = self.facts[parts_at, 6]
        first = self.rare_ends[parts_at] - n
        return self.rare[np.arange(n.sum()) + np.repeat(first - (np.cumsum(n) - n), n)]

    def place(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of texts that aren't empty: the numbers of their parts, where each text's parts end, which texts have tokens."""
        cut = list(map(parts, texts))
        flat = list(chain.from_iterable(cut))
        at = list(map(self.at.get, flat))
        missing = [k for k, i in enumerate(at) if i is None]
        if missing:
            self._learn(list(dict.fromkeys([flat[k] for k in missing])))
            for k in missing:
                at[k] = self.at[flat[k]]
        at = np.array(at, np.int64)
        ends = np.cumsum(np.fromiter(map(len, cut), np.int64, len(cut)))
        return at, ends, _sums(self.facts[at, 7], ends) == 0


_HELD: dict[str, Aligner] = {}


def _aligner(models: _Models, kind: str, counts=None) -> Aligner:
    """One per worker, kept from task to task; that of an earlier pass goes."""
    key = f"{models.key} {kind}"
    if key not in _HELD:
        _HELD.clear()
        _HELD[key] = Aligner(models, counts, kind != "links")
    return _HELD[key]


def _portions(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, list[str | None]]]:
    """Slices of batches with a bounded number of rows and characters (or one row)."""
    for batch in batches:
        at, size, held = 0, 0, []
        for k, value in enumerate(batch.column(column)):
            text = value.as_py()
            if held and (len(held) >= ROWS or size + len(text or "") > CHARS):
                yield batch.slice(at, k - at), held
                at, size, held = k, 0, []
            held.append(text)
            size += len(text or "")
        if held:
            yield batch.slice(at), held


def pair_counts(docs: DataFrame, a_path: str, b_path: str, text_col: str = "text") -> DataFrame:
    """``pair, a, b, n, best`` of every linked pair of ids: its links in the corpus, and whether no A id has more with this b."""
    models = _Models(a_path, b_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _aligner(models, "links")
        uses = np.zeros(0, np.int64)

        def flush() -> pa.RecordBatch:
            pairs = np.concatenate([np.zeros(0, np.int64), *aligner.links])
            n = np.zeros(len(aligner.at), np.int64)
            n[:len(uses)] = uses
            n = np.repeat(n, aligner.facts[:len(n), 3])
            pairs, n = pairs[n > 0], n[n > 0]
            order = np.argsort(pairs, kind="stable")
            pairs, n = pairs[order], n[order]
            first = np.flatnonzero(np.diff(pairs, prepend=-1))
            return pa.RecordBatch.from_arrays(
                [pa.array(pairs[first]), pa.array(np.add.reduceat(n, first) if len(first) else n)], names=["pair", "n"])

        for _, texts in _portions(batches, 0):
            if aligner.full:
                yield flush()
                aligner.clear()
                uses = np.zeros(0, np.int64)
            at, ends, fine = aligner.place([t for t in texts if t])
            n = np.bincount(at[np.repeat(fine, np.diff(ends, prepend=0))], minlength=len(aligner.at))
            n[:len(uses)] += uses
            uses = n
        yield flush()

    found = docs.select(F.col(text_col).alias("text")).mapInArrow(run, "pair bigint, n bigint")
    summed = found.groupBy("pair").agg(F.sum("n").alias("n")).select(
        "pair", F.shiftright("pair", B_BITS).cast("int").alias("a"),
        F.col("pair").bitwiseAND((1 << B_BITS) - 1).cast("int").alias("b"), "n")
    # an id of B has at most as many partners as A's vocabulary has ids
    return summed.withColumn("best", F.col("n") == F.max("n").over(Window.partitionBy("b")))


def token_groups(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, groups`` for every row: the groups themselves, as ``a1,a2|b1;a3|b2,b3``."""
    models = _Models(a_path, b_path)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _aligner(models, "groups")
        for part, texts in _portions(batches, 1):
            if aligner.full:
                aligner.clear()
            at, ends, fine = aligner.place([t for t in texts if t])
            groups = [aligner.groups[i] for i in at.tolist()]
            cuts = iter(zip([0, *ends[:-1].tolist()], ends.tolist(), fine.tolist(), strict=True) if len(ends) else ())
            out = []
            for t in texts:
                i, j, ok = next(cuts) if t else (0, 0, False)
                out.append(b";".join(groups[i:j]).decode() if ok else "")
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(out, pa.string())], names=["doc_id", "groups"])

    return rows.mapInArrow(run, T.StructType([rows.schema["doc_id"], T.StructField("groups", T.StringType())]))


NUMBERS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]


def align(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`` for every row.

    ``n_best`` counts links whose pair has the highest count of its B id, ties included; ``count_sum`` adds up
    the counts of all links' pairs.
    """
    models = _Models(a_path, b_path)
    spark = docs.sparkSession
    pairs = stored(pair_counts(docs, a_path, b_path, text_col), "pairs")
    total = pairs.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first().n
    frequent = F.col("n") * FREQUENT > total
    table = pairs.where(frequent).select("pair", "n", "best").toArrow().sort_by("pair")  # FREQUENT rows at most
    sent = spark.sparkContext.broadcast(tuple(
        table[c].to_numpy().astype(kind) for c, kind in (("pair", np.int64), ("n", np.int64), ("best", bool))))
    kind = uuid.uuid4().hex
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    schema = T.StructType([
        T.StructField("rid", T.LongType()), rows.schema["doc_id"], *[T.StructField(c, T.LongType()) for c in NUMBERS],
        T.StructField("groups_sha256", T.StringType()),
        T.StructField("rare", T.ArrayType(T.StructType([T.StructField("pair", T.LongType()), T.StructField("k", T.LongType())])))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = _aligner(models, kind, sent.value)
        rare_type = pa.list_(pa.struct([("pair", pa.int64()), ("k", pa.int64())]))
        for part, texts in _portions(batches, 2):
            if aligner.full:
                aligner.clear()
            at, ends, fine = aligner.place([t for t in texts if t])
            facts = aligner.facts[at, :7]
            sums = _sums(facts, ends) * fine[:, None]
            numbers = np.zeros((len(texts), 6), np.int64)
            some = np.array([bool(t) for t in texts])
            numbers[some] = sums[:, :6]
            whole, rare = [""] * len(texts), [[]] * len(texts)
            groups = [aligner.groups[i] for i in at.tolist()]
            start = 0
            for k, end, ok, n_rare in zip(np.flatnonzero(some).tolist(), ends.tolist(), fine.tolist(), sums[:, 6].tolist(), strict=True):
                if ok:
                    whole[k] = hashlib.sha256(b";".join(groups[start:end])).hexdigest()
                    if n_rare:
                        found, n = np.unique(aligner.rare_links(at[start:end]), return_counts=True)
                        rare[k] = [{"pair": p, "k": c} for p, c in zip(found.tolist(), n.tolist(), strict=True)]
                start = end
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), *[pa.array(numbers[:, j]) for j in range(6)],
                 pa.array(whole, pa.string()), pa.array(rare, rare_type)], names=schema.names)

    done = stored(rows.mapInArrow(run, schema), "aligned")
    more = (done.select("rid", F.explode("rare").alias("r")).select("rid", "r.pair", "r.k")
            .join(pairs.where(~frequent).select("pair", "n", "best"), "pair").groupBy("rid")
            .agg(F.sum(F.when(F.col("best"), F.col("k")).otherwise(0)).alias("more_best"),
                 F.sum(F.col("k") * F.col("n")).alias("more_sum")))
    zero = F.lit(0)
    return done.drop("rare").join(more, "rid", "left").select(
        "doc_id", *NUMBERS[:4], (F.col("n_best") + F.coalesce("more_best", zero)).alias("n_best"),
        (F.col("count_sum") + F.coalesce("more_sum", zero)).alias("count_sum"), "groups_sha256")
