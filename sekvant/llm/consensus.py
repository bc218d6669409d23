"""One label per item from several annotators who disagree, and how far each can be trusted.

Triplet moment method. For two annotators the rate of agreement, corrected for the
agreement that chance gives, is the product of their chance-corrected accuracies;
so three annotators i, j, l give q_i**2 = r_ij * r_il / r_jl, and the median over
all pairs (j, l), weighted by how surely each can tell, is an estimate that a few
dependent annotators do not bend. Pairs
that agree more than the product of their accuracies allows are dependent: the
less accurate of the two is taken to copy the other at the rate that explains the
excess, triplets with such a pair are dropped, and the accuracies solved again.
With the accuracies known, the joint counts of every annotator with the others are
inverted in closed form, which gives how an annotator confuses particular labels.
Votes are added as log-odds with the labels' frequencies as prior; a copier's vote
counts only for what it adds to the copied one.

Labels have two levels, a group and a part of it that may be missing; the method
runs on groups, and on the parts among annotators that name the same group.

An item has one row with its votes as two short arrays, so pairs of votes are counted
from rows, never joined, with map-side combining, and only pairs of votes that were given
are listed. The joint counts that occur leave the executors as sparse triples; they and
the table of annotators by labels are vocabularies that do not grow with the rows. Both
are refused above ``DRIVER_BYTES``. Nothing else limits annotators or labels; triplets
take time by the cube of the annotators.

Defined cases: an item without a counted vote gives no row; a single vote is
followed; fewer than three annotators are taken as equally accurate; equal
scores give the label that sorts first; an empty table gives an empty result.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sekvant.staging import release, staged

#: Bytes the driver takes for labels, for the table of annotators by labels, and for joint counts.
DRIVER_BYTES = 512 << 20
_COUNT_BYTES = 32
#: Pairs of votes from which an agreement rate counts; weight of the one-accuracy model beside counts.
MIN_PAIRS, SHRINK = 20, 20.0
#: Copying below this rate, or an excess of agreement below this or within so many standard
#: errors, is taken as chance: annotators who are nearly always right agree a little more
#: than the product of their accuracies without copying.
#: On parts, which are compared on fewer votes of like groups, the excess must be larger.
MIN_COPY, MIN_EXCESS, MIN_PART_EXCESS, SIGMAS = 0.3, 0.06, 0.2, 4.0


def _look(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Values by sorted keys; 0 for a key that is not there."""
    if not len(keys):
        return np.zeros(wanted.shape)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, values[at], 0.0)


@dataclass
class Confusion:
    """P(vote | truth) of every annotator on one level: sparse counts over a one-accuracy model."""

    size: int
    block: np.ndarray  # by label: among how many labels the annotator chooses
    own: np.ndarray  # by annotator: accuracy
    keys: np.ndarray  # sorted (annotator * size + vote) * size + truth
    counted: np.ndarray
    truth_keys: np.ndarray  # sorted annotator * size + truth
    truth_total: np.ndarray

    def log(self, who: np.ndarray, vote: np.ndarray, truth: np.ndarray) -> np.ndarray:
        many = self.block[truth]
        plain = np.where(vote == truth, np.where(many > 1, self.own[who], 1.0), (1 - self.own[who]) / np.maximum(many - 1, 1))
        counted = _look(self.keys, self.counted, (who * self.size + vote) * self.size + truth)
        total = _look(self.truth_keys, self.truth_total, who * self.size + truth)
        return np.log(np.clip((counted + SHRINK * plain) / (total + SHRINK), 1e-4, None))


@dataclass
class Fit:
    """What was learnt: accuracies by level, copying, and how annotators confuse labels."""

    annotators: list[str]
    labels: list[tuple[str, str | None]]
    group: np.ndarray  # by label
    parted: np.ndarray  # by label: whether it has a part
    group_accuracy: np.ndarray
    part_accuracy: np.ndarray
    copies: list[tuple[int, int, float]]  # (copier, copied, rate)
    prior: np.ndarray  # log, by label
    groups: Confusion
    parts: Confusion
    usual: np.ndarray  # log, annotator x label: share of a part among the annotator's votes for its group

    def said(self, who: np.ndarray, vote: np.ndarray, truth: np.ndarray) -> np.ndarray:
        """log P(vote | truth), copied votes included."""
        # A truth of another group, or known by its group alone, meets no vote for one of its parts.
        same = (self.group[vote] == self.group[truth]) & self.parted[truth]
        part = np.where(same, self.parts.log(who, vote, np.where(same, truth, vote)), self.usual[who, vote])
        return self.groups.log(who, self.group[vote], self.group[truth]) + np.where(self.parted[vote], part, 0.0)

    def own(self, who: np.ndarray, copied: np.ndarray, rate: np.ndarray, vote: np.ndarray, truth: np.ndarray) -> np.ndarray:
        """P(vote | truth) of a copier's own votes."""
        both = np.exp(self.said(who, vote, truth)) - rate * np.exp(self.said(copied, vote, truth))
        return np.clip(both / (1 - rate), 1e-4, None)


def _moments(agree: np.ndarray, n: np.ndarray, chance: np.ndarray, least: float = MIN_EXCESS) -> tuple[np.ndarray, list[tuple[int, int, float]]]:
    """Chance-corrected accuracies, and which annotator copies which at what rate."""
    d = len(n)
    ok = n >= MIN_PAIRS
    with np.errstate(all="ignore"):
        r = np.where(ok, (agree / np.maximum(n, 1) - chance) / np.maximum(1 - chance, 1e-9), np.nan)
    typical = np.sqrt(np.clip(np.nanmedian(r[ok]) if ok.any() else 0.5, 0.05, 0.98))

    full = np.where(np.isnan(r), r.T, r)
    many = np.maximum(n, n.T)

    def solve(dependent: set[tuple[int, int]]) -> np.ndarray:
        q, free = np.full(d, typical), ~np.isnan(full)
        np.fill_diagonal(free, False)
        for i, j in dependent:
            free[i, j] = free[j, i] = False
        upper = np.triu(np.ones((d, d), dtype=bool), 1)
        for i in range(d):
            with np.errstate(all="ignore"):
                ok_ = upper & free & free[i][:, None] & free[i][None, :] & (full > 0.05)
                j, k = np.nonzero(ok_)
                if not len(j):
                    continue
                square = np.maximum(full[i, j], 0) * np.maximum(full[i, k], 0) / full[j, k]
                sure = np.minimum(np.minimum(many[i, j], many[i, k]), many[j, k]) * (full[i, j] * full[i, k] * full[j, k]) ** 2
            order = np.lexsort((sure, square))
            upto = np.cumsum(sure[order])
            q[i] = np.sqrt(square[order][int(np.searchsorted(upto, upto[-1] / 2))])
        return np.clip(q, 0.05, 0.995)

    q, copies = solve(set()), []
    for _ in range(3):
        copies = []
        for i, j in itertools.combinations(range(d), 2):
            excess = r[i, j] - q[i] * q[j]
            if np.isnan(excess) or excess < least:
                continue
            # The error of the rate that would be seen without copying.
            free = chance[i, j] + (1 - chance[i, j]) * q[i] * q[j]
            if excess * (1 - chance[i, j]) < SIGMAS * np.sqrt(free * (1 - free) / n[i, j]):
                continue
            copier, copied = (i, j) if q[i] <= q[j] else (j, i)
            rate = excess / max(1 - q[copied] ** 2, 1e-3)
            if rate >= MIN_COPY:
                copies.append((copier, copied, float(min(rate, 0.95))))
        again = solve({tuple(sorted(c[:2])) for c in copies})
        if np.allclose(again, q):
            break
        q = again
    # Each copies one other at most: the strongest link counts.
    best: dict[int, tuple[int, int, float]] = {}
    for c in copies:
        if c[0] not in best or c[2] > best[c[0]][2]:
            best[c[0]] = c
    return q, list(best.values())


def _confusion(size: int, block: np.ndarray, pool: np.ndarray, own: np.ndarray, right: np.ndarray, who: np.ndarray, other: np.ndarray, vote: np.ndarray, said: np.ndarray, n: np.ndarray) -> Confusion:
    """From joint counts of each annotator's votes with what independent others said, by the others' accuracies ``right``.

    ``pool`` numbers the blocks of labels among which votes are confused.
    """
    many = block[vote]
    slip = (1 - right[other]) / np.maximum(many - 1, 1)
    width = int(pool.max(initial=0)) + 1
    at = who * width + pool[vote]
    total, scale = np.bincount(at, n), np.bincount(at, n * (right[other] - slip))
    row_keys, row = np.unique(who * size + vote, return_inverse=True)
    expected = np.bincount(row, n * slip, len(row_keys))
    keys, cell = np.unique((who * size + vote) * size + said, return_inverse=True)
    counted = np.bincount(cell, n, len(keys)).astype(float)
    counted = np.clip(counted - expected[np.searchsorted(row_keys, keys // size)], 0, None)
    at = keys // size // size * width + pool[keys % size]
    counted *= np.where(scale[at] > 0, total[at] / np.where(scale[at] > 0, scale[at], 1), 0.0)
    truth_keys, place = np.unique(keys // size // size * size + keys % size, return_inverse=True)
    return Confusion(size, block, own, keys, counted, truth_keys, np.bincount(place, counted, len(truth_keys)))


def fit(annotators: list[str], labels: list[tuple[str, str | None]], single: np.ndarray, i: np.ndarray, j: np.ndarray, a: np.ndarray, b: np.ndarray, n: np.ndarray) -> Fit:
    """Solve the model from vote counts ``single[annotator, label]`` and joint counts ``n`` of annotators i < j giving labels a and b."""
    d, size = len(annotators), len(labels)
    names: dict[str, int] = {}
    group = np.array([names.setdefault(g, len(names)) for g, _ in labels], dtype=np.int64)
    parted = np.array([p is not None for _, p in labels], dtype=bool)
    n_groups = len(names)
    by_group = np.stack([np.bincount(group, single[x], n_groups) for x in range(d)]) if d else np.zeros((0, n_groups))
    in_parts = np.stack([np.bincount(group[parted], single[x][parted], n_groups) for x in range(d)]) if d else np.zeros((0, n_groups))
    members = np.bincount(group[parted], minlength=n_groups) if size else np.zeros(0, dtype=int)
    share0 = by_group / np.maximum(by_group.sum(axis=1, keepdims=True), 1)
    share1 = np.where(parted, single / np.maximum(in_parts[:, group], 1), 0.0)
    square = lambda keys, w: np.bincount(keys, w, d * d).reshape(d, d)

    same = group[a] == group[b]
    inner = same & parted[a] & parted[b]
    pair = i * d + j
    q0, copies = _moments(square(pair, n * same), square(pair, n), share0 @ share0.T)
    chance = np.zeros(d * d)
    keys, cell = np.unique(pair[inner] * max(n_groups, 1) + group[a[inner]], return_inverse=True)
    met = np.bincount(cell, n[inner], len(keys))
    for p in np.unique(keys // max(n_groups, 1)):
        mine = keys // max(n_groups, 1) == p
        alike = np.bincount(group, share1[p // d] * share1[p % d], n_groups)
        chance[p] = (met[mine] * alike[keys[mine] % n_groups]).sum() / max(met[mine].sum(), 1)
    q1, copies1 = _moments(square(pair, n * (inner & (a == b))), square(pair, n * inner), chance.reshape(d, d), MIN_PART_EXCESS)
    seen = {c[0] for c in copies}
    copies += [c for c in copies1 if c[0] not in seen]

    counts = single.sum(axis=0)
    weight = np.bincount(group, counts, n_groups) / max(counts.sum(), 1)
    p0 = q0 + (1 - q0) * float(weight @ weight)
    whole = np.bincount(group[parted], counts[parted], n_groups)
    within = np.where(members > 0, np.bincount(group[parted], counts[parted] ** 2, n_groups) / np.maximum(whole, 1) ** 2, 1.0)
    p1 = q1 + (1 - q1) * (float(np.average(within, weights=np.maximum(weight, 1e-9))) if n_groups else 0.0)

    linked = np.zeros((d, d), dtype=bool)
    for x, y, _ in copies:
        linked[x, y] = linked[y, x] = True
    use = ~linked[i, j]
    both = lambda x, y, m: np.concatenate([x[m], y[m]])
    who, other = both(i, j, use), both(j, i, use)
    groups = _confusion(max(n_groups, 1), np.full(max(n_groups, 1), n_groups), np.zeros(max(n_groups, 1), dtype=int), p0, p0, who, other, both(group[a], group[b], use), both(group[b], group[a], use), both(n, n, use))
    use &= inner
    parts = _confusion(max(size, 1), members[group], group, p1, p1, both(i, j, use), both(j, i, use), both(a, b, use), both(b, a, use), both(n, n, use))
    usual = np.log((single + 1) / np.maximum(in_parts[:, group] + members[group], 1)) if size else np.zeros((d, 0))

    trust = np.log(np.clip(p0, 0.2, 0.99) / (1 - np.clip(p0, 0.2, 0.99)))
    votes = (single * np.clip(trust, 0.1, None)[:, None]).sum(axis=0) + 1.0
    on_group = np.bincount(group, votes, n_groups) if size else np.zeros(0)
    on_parts = np.bincount(group[parted], votes[parted], n_groups) if size else np.zeros(0)
    prior = np.log(on_group / votes.sum())[group] + np.where(parted, np.log(votes / np.maximum(on_parts[group], 1e-300)), 0.0) if size else np.zeros(0)
    return Fit(annotators, labels, group, parted, p0, p1, copies, prior, groups, parts, usual)


def vote(model: Fit, who: np.ndarray, votes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Label and its posterior probability for every row of annotators and their votes, -1 behind the last."""
    n, d = votes.shape
    known = votes >= 0
    scores = np.full((n, d), -np.inf)
    copied, rate = np.full(len(model.annotators) or 1, -1), np.zeros(len(model.annotators) or 1)
    for x, y, r in model.copies:
        copied[x], rate[x] = y, r
    for k in range(d):
        rows = np.flatnonzero(known[:, k])
        truth = votes[rows, k]
        s = model.prior[truth].copy()
        for i in range(d):
            has = np.flatnonzero(known[rows, i])
            w, v, t = who[rows[has], i], votes[rows[has], i], truth[has]
            said = model.said(w, v, t)
            for j in range(d) if model.copies else ():
                meets = np.flatnonzero((copied[w] >= 0) & (who[rows[has], j] == copied[w]) & known[rows[has], j])
                if len(meets):
                    x, y, u = w[meets], v[meets], votes[rows[has[meets]], j]
                    said[meets] = np.log(rate[x] * (u == y) + (1 - rate[x]) * model.own(x, copied[x], rate[x], y, t[meets]))
            s[has] += said
        scores[rows, k] = s
    # A group alone is a label only where no vote names one of its parts.
    group, part = model.group, model.parted
    for k in range(d):
        for i in range(d):
            both = known[:, k] & known[:, i]
            beaten = both & ~part[votes[:, k]] & part[votes[:, i]] & (group[votes[:, k]] == group[votes[:, i]])
            scores[beaten, k] = -np.inf
    first = np.lexsort((votes, -scores), axis=1)[:, 0] if n else np.zeros(0, dtype=int)
    label = votes[np.arange(n), first]
    top = scores[np.arange(n), first]
    total = np.zeros(n)
    for k in range(d):
        fresh = known[:, k] & np.isfinite(scores[:, k])
        for i in range(k):
            fresh &= ~(known[:, i] & (votes[:, i] == votes[:, k]))
        total += np.where(fresh, np.exp(np.where(fresh, scores[:, k] - top, 0.0)), 0.0)
    return label, 1 / np.maximum(total, 1e-12)


@dataclass
class Annotations:
    """Votes as arrays ``who`` and ``label`` of annotator and label numbers, one row per item."""

    votes: DataFrame
    annotators: list[str]
    labels: list[tuple[str, str | None]]


def _refuse(size: int, what: str) -> None:
    if size > DRIVER_BYTES:
        raise ValueError(f"{what}: {size} bytes; the driver takes {DRIVER_BYTES}")


def annotations(votes: DataFrame) -> Annotations:
    """From rows ``(item, annotator, grp, part)``, at most one per item and annotator; part may be null."""
    votes = votes.select("item", "annotator", "grp", "part").where(F.col("item").isNotNull() & F.col("annotator").isNotNull() & F.col("grp").isNotNull())
    width = F.coalesce(F.octet_length("grp"), F.lit(0)) + F.coalesce(F.octet_length("part"), F.lit(0)) + F.octet_length("annotator") + 64
    kinds = votes.groupBy("annotator", "grp", "part").agg(F.count(F.lit(1)).alias("n"))
    _refuse(kinds.agg(F.sum(width)).first()[0] or 0, "names of labels")
    kinds = kinds.collect()
    who = sorted({x.annotator for x in kinds})
    labels = sorted({(x.grp, x.part) for x in kinds}, key=lambda x: (x[0], x[1] is None, x[1] or ""))
    _refuse(8 * len(who) * len(labels), "annotators by labels")
    spark = votes.sparkSession
    # Vocabularies of the size just checked.
    numbers = F.broadcast(spark.createDataFrame([(g, p, i) for i, (g, p) in enumerate(labels)], "grp string, part string, label int"))
    people = F.broadcast(spark.createDataFrame([(w, i) for i, w in enumerate(who)], "annotator string, who int"))
    coded = votes.join(numbers, votes["grp"].eqNullSafe(numbers["grp"]) & votes["part"].eqNullSafe(numbers["part"])).join(people, "annotator")
    rows = coded.groupBy("item").agg(F.sort_array(F.collect_list(F.struct("who", "label"))).alias("x"))
    return Annotations(rows.select("item", F.col("x.who").alias("who"), F.col("x.label").alias("label")), who, labels)


def learn(a: Annotations) -> Fit:
    """Count votes and joint votes on the executors and solve the model from the counts."""
    d, size = len(a.annotators), len(a.labels)
    first = a.votes.select("who", "label", F.posexplode("who").alias("p", "i"))
    pairs = first.select("i", F.get("label", F.col("p")).alias("a"), F.explode(F.slice(F.arrays_zip("who", "label"), F.col("p") + 1, F.size("who"))).alias("y"))
    counts = staged(pairs.groupBy("i", F.col("y.who").alias("j"), "a", F.col("y.label").alias("b")).agg(F.count(F.lit(1)).alias("n")), "joint-counts")
    _refuse(counts.count() * _COUNT_BYTES, "joint counts")
    c = counts.toPandas()
    release(counts)
    i, j, x, y = (c[k].to_numpy(dtype=np.int64) for k in ("i", "j", "a", "b"))
    n = c["n"].to_numpy(dtype=float)
    own = i == j
    single = np.zeros((d, size))
    single[i[own], x[own]] = n[own]
    return fit(a.annotators, a.labels, single, i[~own], j[~own], x[~own], y[~own], n[~own])


def consensus(a: Annotations, model: Fit) -> DataFrame:
    """``(item, grp, part, confidence, agreement, n_votes, contradicts)`` for every item.

    ``agreement`` is the share of pairs of votes that name the same group, null for one
    vote; ``contradicts`` says whether two votes differ in group, or in part where both have one.
    """
    kind = a.votes.schema["item"].dataType.simpleString()
    shared = a.votes.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = shared.value
        labels, group, parted = model.labels, model.group, model.parted
        for b in batches:
            count = b["who"].map(len).to_numpy(dtype=int)
            if not len(count):
                continue
            row, slot = np.repeat(np.arange(len(b)), count), np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
            who, votes = np.full((len(b), int(count.max())), -1), np.full((len(b), int(count.max())), -1)
            who[row, slot], votes[row, slot] = np.concatenate(b["who"].to_list()), np.concatenate(b["label"].to_list())
            label, sure = vote(model, who, votes)
            pairs, same = np.zeros(len(b)), np.zeros(len(b))
            against = np.zeros(len(b), dtype=bool)
            for i, j in itertools.combinations(range(votes.shape[1]), 2):
                both = (votes[:, i] >= 0) & (votes[:, j] >= 0)
                x, y = votes[:, i], votes[:, j]
                g = group[x] == group[y]
                pairs, same = pairs + both, same + (both & g)
                against |= both & (~g | (parted[x] & parted[y] & (x != y)))
            with np.errstate(all="ignore"):
                agreement = np.where(pairs > 0, same / pairs, np.nan)
            yield pd.DataFrame(
                {
                    "item": b["item"],
                    "grp": [labels[x][0] for x in label],
                    "part": [labels[x][1] for x in label],
                    "confidence": sure,
                    "agreement": pd.Series(agreement, index=b.index).astype(object).where(pairs > 0, None),
                    "n_votes": count,
                    "contradicts": against,
                }
            )

    return a.votes.mapInPandas(run, f"item {kind}, grp string, part string, confidence double, agreement double, n_votes int, contradicts boolean")
