"""Byte-pair encoding of whole corpora with a public vocabulary file, in linear time.

A text is cut by the vocabulary's pattern into pieces that merges never cross.
Each piece's bytes are mapped to Latin-1, one character per byte, so that an
Aho-Corasick automaton over the vocabulary finds longest tokens. The longest
match at every place is right most of the time; whether two tokens may stand side
by side is decided by undoing their merges across the border, and remembered per
pair. Where two may not, the encoder backtracks: it tries the next shorter token
that is a prefix, and leaves a place for good once no token fits behind it, so
that no place is visited twice with the same outcome. A sequence whose adjacent
pairs are all compatible is exactly what the merges produce. Time is linear in the
piece, also for pieces of megabytes without a border.

Defined cases: null and empty texts give an empty list; strings that look like
special tokens are ordinary text; lone surrogates cannot occur in Spark strings;
texts are encoded whole whatever their length; repeated rows are encoded each.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed value: the pattern that goes with the byte-level vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
VOCABULARY = os.environ.get("SEKVANT_TOKENIZERS", "/opt/tokenizers") + "/byte_bpe_50k.json"
#: Pieces and pairs remembered per worker before the memory is started anew.
MEMO_PIECES, MEMO_PAIRS = 200_000, 1_000_000


def _printable_bytes() -> dict[str, str]:
    """The vocabulary file's stand-in character of each byte -> its Latin-1 character."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): chr(b) for b in plain} | {chr(256 + i): chr(b) for i, b in enumerate(rest)}


class Encoder:
    """An encoder for one vocabulary file of the byte-level kind."""

    def __init__(self, path: str) -> None:
        import ahocorasick
        import regex

        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        to_latin = str.maketrans(_printable_bytes())
        self.ids = ids = {t.translate(to_latin): i for t, i in model["vocab"].items()}
        #: The two tokens a token was merged from; single bytes have none.
        self.halves: dict[int, tuple[int, int]] = {}
        #: The token that a pair merges into, and the merge's place in the order.
        self.merged: dict[tuple[int, int], int] = {}
        self.order: dict[int, int] = {}
        for place, m in enumerate(model["merges"]):
            a, b = (m.split(" ") if isinstance(m, str) else m)
            a, b = a.translate(to_latin), b.translate(to_latin)
            token = ids[a + b]
            if token not in self.halves:
                self.halves[token], self.order[token] = (ids[a], ids[b]), place
            self.merged[ids[a], ids[b]] = place
        reachable = {t: i for t, i in ids.items() if len(t) == 1 or i in self.halves}
        self.text = {i: t for t, i in reachable.items()}
        #: The longest shorter token that a token begins with.
        self.shorter: dict[int, int] = {}
        for t, i in reachable.items():
            for k in range(len(t) - 1, 0, -1):
                if (j := reachable.get(t[:k])) is not None:
                    self.shorter[i] = j
                    break
        self.widest = max(map(len, reachable))
        self.automaton = ahocorasick.Automaton()
        for t, i in reachable.items():
            self.automaton.add_word(t, i)
        self.automaton.make_automaton()
        self.pieces = regex.compile(PATTERN).findall
        self.pair_memo: dict[tuple[int, int], bool] = {}
        self.piece_memo: dict[str, list[int]] = {}

    def compatible(self, a: int, b: int) -> bool:
        """Whether the merges leave a border between tokens ``a`` and ``b`` that stand side by side."""
        key = (a, b)
        known = self.pair_memo.get(key)
        if known is None:
            if len(self.pair_memo) >= MEMO_PAIRS:
                self.pair_memo.clear()
            known = self.pair_memo[key] = self._border_holds(a, b)
        return known

    def _border_holds(self, a: int, b: int) -> bool:
        """Undo merges, latest first, and look for one across the border that would have come earlier.

        ``left`` and ``right`` are the tokens that touch the border before the merge of
        order ``limit`` took place. A merge of the two that precedes ``limit`` would have
        been applied instead. At equal order the left of two overlapping pairs goes first.
        """
        order, halves, merged = self.order, self.halves, self.merged
        left, right = a, b
        limit = len(merged) * 2 + 2
        while True:
            across = merged.get((left, right))
            # Doubled so that "just after an equal merge to the left" lies between two places.
            if across is not None and 2 * across < limit:
                return False
            at_left, at_right = order.get(left, -1), order.get(right, -1)
            if at_left < 0 and at_right < 0:
                return True
            if at_left > at_right:
                left, limit = halves[left][1], 2 * at_left
            else:
                right, limit = halves[right][0], 2 * at_right + 1

    def encode_piece(self, piece: str) -> list[int]:
        """Ids of one piece given in Latin-1."""
        whole = self.ids.get(piece)
        if whole is not None and whole in self.text:
            return [whole]
        compatible, text = self.compatible, self.text
        greedy = [i for _, i in self.automaton.iter_long(piece)]
        good = 1
        while good < len(greedy) and compatible(greedy[good - 1], greedy[good]):
            good += 1
        if good == len(greedy):
            return greedy
        return self._backtrack(piece, greedy[:good])

    def _backtrack(self, piece: str, out: list[int]) -> list[int]:
        """Go on from tokens that fit together, with the longest token that fits at each place."""
        compatible, text, shorter = self.compatible, self.text, self.shorter
        size = len(piece)
        at = sum(len(text[t]) for t in out)
        closed = bytearray(size + 1)  # places from which the rest was found impossible
        token = self._longest(piece, at)
        while True:
            last = out[-1] if out else None
            while token is not None:
                end = at + len(text[token])
                if not closed[end] and (last is None or compatible(last, token)):
                    break
                token = shorter.get(token)
            if token is None:
                closed[at] = 1
                token = out.pop()
                at -= len(text[token])
                token = shorter.get(token)
                continue
            out.append(token)
            at = end
            if at == size:
                return out
            token = self._longest(piece, at)

    def _longest(self, piece: str, at: int) -> int:
        return next(self.automaton.iter_long(piece[at : at + self.widest]))[1]

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        memo, out = self.piece_memo, []
        for piece in self.pieces(text):
            found = memo.get(piece)
            if found is None:
                found = self.encode_piece(piece.encode("utf-8").decode("latin-1"))
                if len(piece) <= 64:
                    if len(memo) >= MEMO_PIECES:
                        memo.clear()
                    memo[piece] = found
            out += found
        return out


@lru_cache(maxsize=2)
def encoder(path: str = VOCABULARY) -> Encoder:
    """The worker's encoder of a vocabulary file, built once."""
    return Encoder(path)


def token_ids(text: Column, vocabulary: str = VOCABULARY) -> Column:
    """``array<int>`` of the text's ids."""

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def ids(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = encoder(vocabulary).encode
        for texts in batches:
            yield pd.Series([encode(t) for t in texts], dtype=object)

    return ids(text)


def token_count(text: Column, vocabulary: str = VOCABULARY) -> Column:
    """Number of ids of the text; 0 for a null or empty text."""

    @F.pandas_udf(T.IntegerType())
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = encoder(vocabulary).encode
        for texts in batches:
            yield pd.Series([len(encode(t)) for t in texts], dtype="int32")

    return count(text)
