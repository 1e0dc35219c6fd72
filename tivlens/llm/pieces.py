"""Piece vocabularies: where a text splits into independent pre-tokens, and exact BPE on one.

The merge-type prefix table follows the linear-time BPE encoders: every prefix of a
pre-token has exactly one last token, found among the vocabulary entries that end there
(Aho-Corasick matches) as the one compatible with the last token of the prefix before it.
Two tokens are compatible when merging their concatenation gives just these two. The ids
are then read backwards from the last prefix.

Vocabularies supported: BPE with distinct merge scores, no normalisation map, a space
marker in front of words only, and byte fallback. Others raise ``ValueError``.
"""

from __future__ import annotations

import heapq
import re
from functools import lru_cache

MARK = "▁"
_CHUNK = re.compile(f"{MARK}+[^{MARK}]*").findall


def pretokens(text: str) -> list[str]:
    """``text`` in the model's alphabet, cut before every run of space markers; no merge crosses a cut."""
    return _CHUNK(MARK + text.replace(" ", MARK)) if text else []


def as_text(pretoken: str) -> str:
    """The text that the library encodes to this pre-token: it puts one marker in front itself."""
    return pretoken[1:].replace(MARK, " ")


@lru_cache(maxsize=2)
def processor(model: bytes):
    """The library's processor, one per worker and model."""
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_proto=model)


class PieceEncoder:
    """Encodes pre-tokens with the vocabulary and merge scores of a piece model."""

    MAX_PAIRS = 500_000  # remembered compatibility tests, some 240 bytes each; forgotten all at once beyond

    def __init__(self, model: bytes) -> None:
        import ahocorasick

        sp = processor(model)
        self.texts: list[str] = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
        self.bytes = {int(self.texts[i][3:5], 16): i for i in range(len(self.texts)) if sp.is_byte(i)}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        normal = [i for i in range(len(self.texts))
                  if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        self.ids = {self.texts[i]: i for i in normal}
        self.score = {self.texts[i]: sp.get_score(i) for i in normal}
        self.skipped = {i for i in range(len(self.texts)) if sp.is_control(i)}
        words = [t for t in self.ids if t.strip(MARK)]
        if len(self.bytes) != 256 or any(MARK in t[1:] for t in words) or sp.encode("a  b") == sp.encode("a b") \
                or len({self.score[t] for t in words}) < len(words):
            raise ValueError("unsupported piece model: byte fallback, distinct scores and leading markers are needed")
        self.automaton = ahocorasick.Automaton()
        for t in (*words, MARK):
            self.automaton.add_word(t, (len(t), self.ids[t]))
        self.automaton.make_automaton()
        self.pairs: dict[int, bool] = {}
        self.alone: dict[int, bool] = {}

    def merged(self, symbols: str) -> list[str]:
        """BPE by definition, for short strings and for runs of markers: best score first, then leftmost."""
        part = list(symbols)
        after = [*range(1, len(part)), -1]
        before = [*range(-1, len(part) - 1)]
        heap: list[tuple[float, int, str]] = []

        def offer(i: int) -> None:
            if i >= 0 and after[i] >= 0 and (s := self.score.get(both := part[i] + part[after[i]])) is not None:
                heapq.heappush(heap, (-s, i, both))

        for i in range(len(part) - 1):
            offer(i)
        while heap:
            _, i, both = heapq.heappop(heap)
            j = after[i]
            if not part[i] or j < 0 or part[i] + part[j] != both:
                continue
            part[i], part[j], after[i] = both, "", after[j]
            if after[i] >= 0:
                before[after[i]] = i
            offer(before[i])
            offer(i)
        return [p for p in part if p]

    def _stands(self, token: int) -> bool:
        if (ok := self.alone.get(token)) is None:
            ok = self.alone[token] = len(self.merged(self.texts[token])) == 1
        return ok

    def _fits(self, left: int, right: int) -> bool:
        key = left << 32 | right
        if (ok := self.pairs.get(key)) is None:
            a, b = self.texts[left], self.texts[right]
            if len(self.pairs) >= self.MAX_PAIRS:
                self.pairs.clear()
            # two tokens that merge with each other are never left side by side
            ok = self.pairs[key] = a + b not in self.score and self.merged(a + b) == [a, b]
        return ok

    def _word(self, word: str) -> list[int]:
        """Ids of a pre-token with one marker at most."""
        n = len(word)
        last: list[int] = [0] * (n + 1)  # last token of each prefix
        width = [0] * (n + 1)  # its length; 0: none found, the character is unknown
        fits = self.pairs.get
        for end, (size, token) in self.automaton.iter(word):
            end += 1
            if width[end]:
                continue
            start = end - size
            if start == 0 or not width[start]:
                ok = self._stands(token)
            elif (ok := fits(last[start] << 32 | token)) is None:
                ok = self._fits(last[start], token)
            if ok:
                last[end], width[end] = token, size
        out: list[int] = []
        while n:
            if width[n]:
                out.append(last[n])
                n -= width[n]
            else:
                out.extend(self.bytes[b] for b in reversed(word[n - 1].encode()))
                n -= 1
        out.reverse()
        return out

    def encode(self, pretoken: str) -> list[int]:
        run = len(pretoken) - len(pretoken.lstrip(MARK))
        if run < 2:
            return self._word(pretoken)
        # runs of markers merge after everything else, from the left; the last one may belong to the word
        rest = self._word(pretoken[run - 1:])
        if rest[0] == self.ids[MARK]:
            rest = rest[1:]
        else:
            run -= 1
        return [self.ids[t] for t in self.merged(MARK * run)] + rest

    def decode(self, ids: list[int]) -> str:
        """Text of ids inside a longer sequence: markers become spaces, byte runs become characters."""
        out: list[str] = []
        run = bytearray()
        for i in ids:
            if (b := self.byte_of.get(i)) is not None:
                run.append(b)
                continue
            if run:
                out.append(run.decode("utf-8", "replace"))
                run = bytearray()
            if i not in self.skipped:
                out.append(self.texts[i])
        if run:
            out.append(run.decode("utf-8", "replace"))
        return "".join(out).replace(MARK, " ")


@lru_cache(maxsize=2)
def encoder(model: bytes) -> PieceEncoder:
    """One encoder per worker and model."""
    return PieceEncoder(model)
