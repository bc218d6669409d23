"""Scoring documents for abusive, hateful or sexual content.

Factorization machine over hashed terms. A document is judged by its worst
sentence. A sentence becomes a set of hashed terms: its words, pairs of
neighbouring words, four-letter parts of words, and the word list's kinds it
meets. Every term has a weight and a short vector; the score adds the weights and
the products of the vectors of all pairs of terms, so an insult beside a mention of
a group or of a person counts in a way the two apart do not, and a coarse word
beside a thing does not.

Training: labels are of documents, so the likelihood of a labelled document is that
at least one of its sentences is a case (noisy or), with each labeller's error rate
taken into account. It runs on at most ``MAX_LABELLED`` labelled documents, chosen
by a hash of their text, and is the only sampled step: scoring covers every document and
the whole of every text. The model's size is fixed by ``HASH_BITS`` and ``RANK``.

All sentences of an Arrow batch that were not met before are turned into terms and
scored together, in arrays; a word's own hashes are worked out once. A sentence is
scored whole, so any two of its terms meet; one above ``RUN_WORDS`` words is scored
in half-overlapping runs as well, so that few words among many keep their weight.

Spelling is undone before hashing: case, accents, invisible characters, look-alike
letters, digits and signs for letters, letters set apart, drawn-out letters, markup
and doubly encoded characters.

Defined cases: null, empty and blank texts score 0; a text without letters scores
0; equal texts get equal scores; without labelled documents of both kinds only the
word list speaks (its insults, group and sexual words, by strength); null labels and
unknown documents are left out; an empty table gives an empty result.
"""

from __future__ import annotations

import html
import re
import sys
import unicodedata
import zlib
from array import array
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

HASH_BITS, RANK = 17, 8
MAX_LABELLED = 20_000
#: Passes over the labelled documents, and steps that few of them are gone over for at least.
EPOCHS, LEAST_STEPS, BATCH, RATE, DECAY = 6, 150, 128, 0.08, 2e-5
#: Words from which a sentence is also looked at in runs.
RUN_WORDS = 48
#: Sentences and words a worker remembers, and words worked on at a time; they bound its memory, not the result.
MEMO_SENTENCES, MEMO_WORDS, BLOCK_WORDS = 300_000, 500_000, 200_000
#: Gradients below this move nothing.
LEAST_GRADIENT = 3e-3
#: Score from which a document is taken for a case; chosen on held-out labels, where scores
#: between 0.3 and 0.5 belong to cases more often than not.
THRESHOLD = 0.4

#: Letters that look like Latin ones.
LOOK_ALIKES = str.maketrans("аеорсухіјѕԁһкмтвнгпαεορτυικνχβηωɡıł", "aeopcyxijsdhkmtbhrnaeoptuiknxbnwgil")
#: Digits and signs that stand for letters inside a word.
SIGN_LETTERS = str.maketrans("013457@$!|", "oieastasii")
_INVISIBLE = re.compile(r"[­᠎​-‏‪-‮⁠-⁤︀-️﻿]")
_TAG = re.compile(r"<[^<>]{1,80}>")
_TWICE = re.compile("[Â-ô][\u0080-¿ŒœŠšŸŽžƒˆ˜–-›€™]{1,3}")
_APART = re.compile(r"(?<!\w)\w(?:([ _.*\-])\w)(?:\1\w)+(?!\w)")
_SENTENCE = re.compile(r"(?<=[.!?…。！？])\s+|[\n\r]+|[。！？]")
_TOKEN = re.compile(r"[^\W_]+(?:[*%#@$!|'’0-9]+[^\W_]+)*|[@$][^\W_]+(?:[*@$!|0-9]+[^\W_]+)*|\*+")
_DRAWN = re.compile(r"(\w)\1{2,}")
_HIDDEN = re.compile(r"[*%#]")
_LETTER = re.compile(r"[^\W\d_]")
_MARKS = re.compile("[" + "".join(map(chr, filter(lambda c: unicodedata.combining(chr(c)), range(sys.maxunicode + 1)))) + "]+")
_MASK = (1 << HASH_BITS) - 1


def _once(m: re.Match) -> str:
    for charset in ("latin-1", "cp1252"):
        try:
            return m[0].encode(charset).decode("utf-8")
        except UnicodeError:
            continue
    return m[0]


def raw_sentences(text: str) -> list[str]:
    """Parts of a text as written, without markup."""
    if "&" in text:
        text = html.unescape(text)
    if "<" in text:
        text = _TAG.sub("\n", text)
    return _SENTENCE.split(text)


def plain_sentences(raw: str) -> Iterator[str]:
    """Sentences of a raw one: invisible characters and encodings undone, case kept away."""
    if not raw.isascii():
        raw = unicodedata.normalize("NFKC", _INVISIBLE.sub("", _TWICE.sub(_once, raw)))
    text = _APART.sub(lambda m: m[0].replace(m[1], ""), raw.lower())
    for s in _SENTENCE.split(text):
        if s and _LETTER.search(s):
            yield " ".join(s.split())


def sentences(text: str) -> Iterator[str]:
    """Plain sentences of a text."""
    for raw in raw_sentences(text):
        yield from plain_sentences(raw)


def tokens(sentence: str) -> list[str]:
    """Words of a plain sentence without accents and look-alikes."""
    if not sentence.isascii():
        sentence = _MARKS.sub("", unicodedata.normalize("NFD", sentence.translate(LOOK_ALIKES)))
    return _TOKEN.findall(sentence)


def spelt(token: str) -> str:
    """A token without signs for letters and drawn-out letters; numbers are ``0``."""
    if token.isdigit():
        return "0"
    if token.startswith("user") and token[4:].isdigit():
        return "user"
    return _DRAWN.sub(r"\1", token if token.isalpha() else token.translate(SIGN_LETTERS))


def words(sentence: str) -> list[str]:
    return [spelt(t) for t in tokens(sentence)]


def _crc(term: str) -> int:
    return zlib.crc32(term.encode())


def _pair(before: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Hashed terms of neighbouring words from the words' own hashes."""
    h = before * np.uint64(0x9E3779B97F4A7C15) + after * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(0x165667B19E3779F9)
    return ((h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(40)) & np.uint64(_MASK)


class Words:
    """Numbers of tokens, and by number the hashes of the word, of its parts and of its kind in the word list."""

    def __init__(self, listed: dict[str, str], strength: dict[str, float]) -> None:
        self.listed, self.strength = listed, strength
        self.by_length: dict[int, list[str]] = defaultdict(list)
        for x in listed:
            self.by_length[len(x)].append(x)
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = {}
        self.crc, self.kind, self.parts, self.begin, self.force = array("Q"), array("q"), array("q"), array("q", [0]), array("d")

    def _word(self, token: str) -> str:
        """The token's plain spelling; a listed word where its hidden letters leave just one."""
        w = spelt(token)
        if w not in self.listed and _HIDDEN.search(token) and len(token) - len(_HIDDEN.findall(token)) >= 2:
            shape = re.compile("".join("." if _HIDDEN.match(c) else re.escape(c) for c in token))
            fits = [x for x in self.by_length.get(len(token), ()) if shape.fullmatch(x)]
            return fits[0] if len(fits) == 1 else w
        return w

    def _add(self, token: str) -> int:
        w = self._word(token)
        n = self.number[token] = len(self.crc)
        self.crc.append(_crc(w))
        self.kind.append(_crc("list:" + self.listed[w]) & _MASK if w in self.listed else -1)
        self.force.append(self.strength.get(w, 0.0))
        edged = f"<{w}>"
        self.parts.extend([_crc("part:" + edged[i : i + 4]) & _MASK for i in range(len(edged) - 3)])
        self.begin.append(len(self.parts))
        return n

    def numbers(self, sentence: str) -> list[int]:
        known = self.number
        return [known[t] if t in known else self._add(t) for t in tokens(sentence)]

    def terms(self, bags: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
        """Sorted distinct terms of each non-empty bag of word numbers, one after another, and how many each has."""
        count = np.fromiter(map(len, bags), dtype=np.int64, count=len(bags))
        ids = np.fromiter((i for b in bags for i in b), dtype=np.int64, count=int(count.sum()))
        crc, kind, parts, begin = (np.array(a) for a in (self.crc, self.kind, self.parts, self.begin))
        each = np.arange(len(bags))
        owner, last = np.repeat(each, count), np.cumsum(count) - 1
        h = crc[ids]
        before = np.empty_like(h)
        before[1:] = h[:-1]
        before[last - count + 1] = 1  # the edge of a sentence
        n_parts = begin[ids + 1] - begin[ids]
        at = np.arange(int(n_parts.sum())) + np.repeat(begin[ids] - np.cumsum(n_parts) + n_parts, n_parts)
        on_list = kind[ids] >= 0
        term = [(h & np.uint64(_MASK)), _pair(before, h), _pair(h[last], np.full(len(bags), 2, dtype=np.uint64)), kind[ids][on_list], parts[at]]
        bag = [owner, owner, each, owner[on_list], np.repeat(owner, n_parts)]
        key = np.sort((np.concatenate(bag) << HASH_BITS) | np.concatenate([t.astype(np.int64) for t in term]))
        key = key[np.concatenate([[True], key[1:] != key[:-1]])]
        return key & _MASK, np.bincount(key >> HASH_BITS, minlength=len(bags))


def runs(bag: list[int]) -> Iterator[list[int]]:
    """The bag itself, and if it is long, runs of it that overlap by half."""
    yield bag
    if len(bag) > RUN_WORDS:
        half = RUN_WORDS // 2
        for i in range(0, len(bag) - half, half):
            yield bag[i : i + RUN_WORDS]


@dataclass
class Model:
    """Weights of the machine, and the word list in plain spelling."""

    bias: float
    weight: np.ndarray
    vector: np.ndarray
    listed: dict[str, str]
    strength: dict[str, float] = field(default_factory=dict)  # used instead where nothing was learnt
    memo: dict[str, float] = field(default_factory=dict, repr=False, compare=False)
    known: Words | None = field(default=None, repr=False, compare=False)

    def _bags(self, bags: list[list[int]]) -> np.ndarray:
        if self.strength:
            force = np.array(self.known.force)
            return np.array([force[b].max() for b in bags])
        z = _forward(self.bias, self.weight, self.vector, *self.known.terms(bags))[0]
        return 1 / (1 + np.exp(-z))

    def _learn(self, raw: Iterable[str]) -> None:
        """Score raw sentences that are not remembered yet, in blocks of bounded size."""
        waiting, bags, owner, size = [], [], [], 0

        def work() -> None:
            best = np.zeros(len(waiting))
            if bags:
                np.maximum.at(best, np.array(owner), self._bags(bags))
            self.memo.update(zip(waiting, best.tolist()))

        for r in raw:
            if size >= BLOCK_WORDS:
                work()
                waiting, bags, owner, size = [], [], [], 0
                if len(self.known.number) > MEMO_WORDS:
                    self.known.clear()
            for s in plain_sentences(r):
                if ids := self.known.numbers(s):
                    for bag in runs(ids):
                        bags.append(bag)
                        owner.append(len(waiting))
                        size += len(bag)
            waiting.append(r)
        work()

    def score_all(self, texts: Iterable[str | None]) -> list[float]:
        """Between 0 and 1 for every text: the worst sentence's probability to be a case."""
        if self.known is None:
            self.known = Words(self.listed, self.strength)
        if len(self.memo) > MEMO_SENTENCES:
            self.memo.clear()
        parts = [raw_sentences(t) if t else () for t in texts]
        self._learn(dict.fromkeys(s for p in parts for s in p if s not in self.memo))
        memo = self.memo
        return [max([memo[s] for s in p], default=0.0) for p in parts]

    def score(self, text: str | None) -> float:
        return self.score_all([text])[0]


def _forward(bias: float, weight: np.ndarray, vector: np.ndarray, flat: np.ndarray, size: np.ndarray):
    """Scores of bags of terms, one after another; each term's value is one over the root of the bag's size."""
    at = np.cumsum(size) - size
    x = np.repeat((1 / np.sqrt(size)).astype(np.float32), size)
    v = vector[flat] * x[:, None]
    total = np.add.reduceat(v, at, axis=0)
    pairs = 0.5 * (np.square(total).sum(axis=1) - np.add.reduceat(np.einsum("ij,ij->i", v, v), at))
    return bias + np.add.reduceat(weight[flat] * x, at) + pairs, x, total, v


@dataclass
class _Batch:
    """Documents learnt together: their sentences' terms, and which document has which sentence."""

    flat: np.ndarray
    size: np.ndarray
    used: np.ndarray
    place: np.ndarray  # of each term among the used ones
    doc: np.ndarray
    sentence: np.ndarray
    label_doc: np.ndarray
    positive: np.ndarray
    error: np.ndarray


def _batches(docs: list[list[int]], labels: list[tuple[int, bool, float]], flat: np.ndarray, size: np.ndarray, order: np.ndarray) -> list[_Batch]:
    """Documents, given by their sentences' numbers, in batches that stay the same in all epochs."""
    start = np.cumsum(size) - size
    of_doc = defaultdict(list)
    for d, case, e in labels:
        of_doc[d].append((case, e))
    out = []
    for k in range(0, len(order), BATCH):
        part = order[k : k + BATCH]
        doc = np.repeat(np.arange(len(part)), [len(docs[d]) for d in part])
        uniq, sentence = np.unique(np.concatenate([docs[d] for d in part]), return_inverse=True)
        n = size[uniq]
        terms = flat[np.repeat(start[uniq] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))]
        used, place = np.unique(terms, return_inverse=True)
        judged = [(i, case, e) for i, d in enumerate(part) for case, e in of_doc[d]]
        out.append(_Batch(terms, n, used, place, doc, sentence, *(np.array(c) for c in zip(*judged))))
    return out


def train(docs: list[list[int]], labels: list[tuple[int, bool, float]], flat: np.ndarray, size: np.ndarray, listed: dict[str, str], *, seed: int = 7, epochs: int = EPOCHS) -> Model:
    """Fit on documents given by their sentences' numbers and labels ``(document, case, error rate)``.

    ``flat`` and ``size`` are the sentences' terms. Sentences whose gradient is next to
    nothing are left out of a step.
    """
    rng = np.random.default_rng(seed)
    n = 1 << HASH_BITS
    weight, bias = np.zeros(n, dtype=np.float32), -3.0
    vector = rng.normal(0, 0.05, (n, RANK)).astype(np.float32)
    past_w, past_v, past_b = np.full(n, 1e-2, dtype=np.float32), np.full((n, RANK), 1e-2, dtype=np.float32), 1e-2
    batches = _batches(docs, labels, flat, size, rng.permutation(len(docs)))
    for _ in range(max(epochs, -(-LEAST_STEPS // len(batches)))):
        for k in rng.permutation(len(batches)):
            b = batches[k]
            z, x, total, v = _forward(bias, weight, vector, b.flat, b.size)
            p = np.clip(1 / (1 + np.exp(-z)), 1e-6, 1 - 1e-6)
            none = np.exp(np.bincount(b.doc, np.log1p(-p)[b.sentence]))
            e = b.error
            seen = np.clip(e + (1 - 2 * e) * (1 - none[b.label_doc]), 1e-4, 1 - 1e-4)
            outer = np.bincount(b.label_doc, np.where(b.positive, -1 / seen, 1 / (1 - seen)) * (1 - 2 * e))
            g = np.bincount(b.sentence, (outer * none)[b.doc], minlength=len(p)) * p
            moved = np.abs(g) > LEAST_GRADIENT
            if not moved.any():
                continue
            rows = np.repeat(moved, b.size)
            size_, place = b.size[moved], b.place[rows]
            gz = np.repeat(g[moved].astype(np.float32), size_) * x[rows]
            step = gz[:, None] * (np.repeat(total[moved], size_, axis=0) - v[rows])
            hit, place = np.unique(place, return_inverse=True) if len(place) * 2 < len(b.place) else (np.arange(len(b.used)), place)
            used = b.used[hit]
            gw = np.bincount(place, gz, len(used)).astype(np.float32) + DECAY * weight[used]
            past_w[used] += gw * gw
            weight[used] -= RATE * gw / np.sqrt(past_w[used])
            gv = np.bincount((place[:, None] * RANK + np.arange(RANK)).ravel(), step.ravel(), len(used) * RANK).reshape(-1, RANK).astype(np.float32) + DECAY * vector[used]
            past_v[used] += gv * gv
            vector[used] -= RATE * gv / np.sqrt(past_v[used])
            gb = float(g.sum())
            past_b += gb * gb
            bias -= RATE * gb / np.sqrt(past_b)
    return Model(bias, weight, vector, listed)


def error_rates(labels: Iterable[tuple[object, object, bool]]) -> dict[object, float]:
    """Each labeller's error rate from documents with several judgements ``(doc, labeller, case)``."""
    by_doc = defaultdict(list)
    for doc, who, case in labels:
        by_doc[doc].append((who, case))
    same, both = Counter(), Counter()
    for votes in by_doc.values():
        for i, (a, x) in enumerate(votes):
            for b, y in votes[:i]:
                for w in (a, b):
                    both[w] += 1
                    same[w] += x == y
    overall = (sum(both.values()) - sum(same.values()) + 5.0) / (sum(both.values()) + 50.0)
    people = {who for votes in by_doc.values() for who, _ in votes}
    # A disagreement is shared by two; half of the usual one is the other's.
    return {w: float(np.clip((both[w] - same[w] + 20 * overall) / (both[w] + 20) - overall / 2, 0.01, 0.3)) for w in people}


def fit(texts: dict[object, str], labels: list[tuple[object, object, bool]], word_list: list[tuple[str, str, int]]) -> Model:
    """The model of labelled texts ``(doc, labeller, case)`` and a word list ``(term, kind, strength)``."""
    listed = {" ".join(words(t.lower())): f"{kind}" for t, kind, _ in word_list if t}
    errors = error_rates(labels)
    known = Words(listed, {})
    number: dict[str, list[int]] = {}
    bags: list[list[int]] = []
    docs: list[list[int]] = []
    place: dict[object, int | None] = {}
    judged = []
    for doc, who, case in labels:
        if doc not in place:
            mine = []
            for raw in raw_sentences(texts.get(doc) or ""):
                if raw not in number:
                    found = [bag for s in plain_sentences(raw) if (ids := known.numbers(s)) for bag in runs(ids)]
                    number[raw] = [*range(len(bags), len(bags) + len(found))]
                    bags += found
                mine += number[raw]
            mine = [*dict.fromkeys(mine)]
            place[doc] = len(docs) if mine else None
            if mine:
                docs.append(mine)
        if place[doc] is not None:
            judged.append((place[doc], case, errors[who]))
    if len({case for _, case, _ in judged}) < 2:
        strength = {" ".join(words(t.lower())): min(0.3 * (s or 0), 0.9) for t, kind, s in word_list if t and kind != "coarse"}
        return Model(0.0, np.zeros(1, dtype=np.float32), np.zeros((1, 1), dtype=np.float32), listed, strength or {"": 0.0})
    return train(docs, judged, *known.terms(bags), listed)


def scores(text: Column, model: Model) -> Column:
    """Score of every text; the model goes to the workers once, inside the function."""
    shared = Model(model.bias, model.weight, model.vector, model.listed, model.strength)

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            yield pd.Series(shared.score_all(b), dtype="float64")

    return run(text)
