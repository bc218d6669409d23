"""Splitting fields that hold several values, one row per value with its place.

Delimiter skeletons: a field is cut into units - a run of blanks, a run of
ordinary characters, or one sign - and every unit is masked to one character
(blank, ``a`` or the sign itself). The skeleton tells where values begin and end
without their letters, so splitting rules are resolved once per distinct
skeleton, in Python and in parallel, and then applied to all rows inside the JVM: a
rule marks by position the units that begin, continue or belong to no value. Time
is linear in the field's length.

Two grammars: ``plain`` fields hold names without blanks or signs unless quoted;
``typed`` fields hold ``type|name`` values whose name may hold blanks and signs,
so a value ends only where another ``type|`` or a quote begins; what stands before the
first of these is one value without a type.

The rule table is broadcast only while it has at most ``broadcast_bytes``;
beyond that it is joined by a salted shuffle, as one skeleton may be most rows'.

Defined cases: null, blank and placeholder fields hold no value; empty entries
are no values and take no place; brackets around the whole list and quotes
around a value belong to no value; a quote that is never closed is an ordinary
sign; repeated rows count each; an empty table gives an empty result; very long
fields are split whole; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sekvant.staging import measured, row_bytes

#: The words that stand for "nothing known", compared in lower case.
PLACEHOLDERS = ("unknown", "mixture", "none", "na", "?", ".")
BLANKS = " \\t\\n\\r\\f\\x0b\\x85\\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
SIGNS = "\"',;；，、/|+&\\[\\](){}"
PLAIN, TYPED = "plain", "typed"
BROADCAST_BYTES = 32 << 20
SALTS = 16

_SEPARATORS = set(",;；，、/|+&")
_CLOSING = {"[": "]", "(": ")", "{": "}"}
_RULES = "skeleton string, marks string, n_vals int"
#: Noncharacters, which no text may hold, between the values of a field.
_BREAK = "\ufdd0\ufdd1"


def units(field: Column) -> Column:
    """The field as an array of units; joined again they give the field."""
    return F.regexp_extract_all(field, F.lit(f"[{BLANKS}]+|[^{BLANKS}{SIGNS}]+|[{SIGNS}]"), 0)


def skeleton(field: Column) -> Column:
    """One character per unit of the field."""
    return F.regexp_replace(F.regexp_replace(field, f"[{BLANKS}]+", " "), f"[^ {SIGNS}]+", "a")


def _quoted(s: str, i: int, end: int) -> int:
    """Index of the quote that closes the one at ``i``, or -1."""
    q, j = s[i], i + 1
    while j < end:
        if s[j] == q:
            if q == '"' and j + 1 < end and s[j + 1] == q:
                j += 2
                continue
            if q == '"' or j + 1 == end or s[j + 1] == " " or s[j + 1] in _SEPARATORS:
                return j
        j += 1
    return -1


def _opens(s: str, j: int, begin: int, end: int) -> bool:
    """Whether a typed value begins at ``j``, bare or quoted."""
    if j > begin and s[j - 1] != " " and s[j - 1] not in _SEPARATORS:
        return False
    if s[j] in "\"'":
        j += 1
    return s.startswith("a|", j) and j + 1 < end


def _bare_end(s: str, begin: int, stop: int) -> int:
    """End of the bare value of ``s[begin:stop]``, without blanks and separators behind it."""
    while stop > begin and (s[stop - 1] == " " or s[stop - 1] in _SEPARATORS):
        stop -= 1
    return stop


def split_rule(s: str, grammar: str) -> list[tuple[int, int, bool]]:
    """Values of a skeleton as ``(first unit from 1, number of units, doubled quotes)``."""
    i, end = 0, len(s)

    def strip() -> None:
        nonlocal i, end
        while i < end and s[i] == " ":
            i += 1
        while i < end and s[end - 1] == " ":
            end -= 1

    strip()
    if end - i >= 2 and _CLOSING.get(s[i]) == s[end - 1] and s.find(s[end - 1], i) == end - 1:
        i, end = i + 1, end - 1
        strip()
    begin, out = i, []
    while i < end:
        c = s[i]
        if c == " " or c in _SEPARATORS:
            i += 1
            continue
        if c in "\"'" and (j := _quoted(s, i, end)) > 0:
            inner = s[i + 1 : j]
            if bare := inner.strip(" "):
                out.append((i + 2 + len(inner) - len(inner.lstrip(" ")), len(bare), c == '"' and '""' in bare))
            i = j + 1
            continue
        j = i + 1
        if grammar == PLAIN:
            while j < end and s[j] != " " and s[j] not in _SEPARATORS:
                j += 1
            out.append((i + 1, j - i, False))
        else:
            while j < end and not _opens(s, j, begin, end):
                j += 1
            out.append((i + 1, _bare_end(s, i, j) - i, False))
        i = j
    return out


def unit_marks(s: str, grammar: str) -> str:
    """The rule by unit: 1 begins a value, 2 goes on with it, 0 belongs to none."""
    marks = ["0"] * len(s)
    for at, n, twice in split_rule(s, grammar):
        marks[at - 1 : at - 1 + n] = ["1", *"2" * (n - 1)]
        i = at - 1
        while twice and i < at + n - 2:
            if s[i] == s[i + 1] == '"':
                marks[i + 1] = "0"  # of two quotes one is left
                i += 1
            i += 1
    return "".join(marks)


def _resolve(grammar: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            marks = [unit_marks(s, grammar) for s in b["skeleton"]]
            yield pd.DataFrame({"skeleton": b["skeleton"], "marks": marks, "n_vals": [m.count("1") for m in marks]})

    return run


def blank_or_placeholder(field: Column) -> Column:
    bare = F.lower(F.regexp_replace(field, f"^[{BLANKS}]+|[{BLANKS}]+$", ""))
    return field.isNull() | (bare == "") | bare.isin(*PLACEHOLDERS)


def split_packed(df: DataFrame, row_id: str, field: str, *, grammar: str = PLAIN, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``(row_id, pos, val, n_vals)``: every value, its place from 1 and its field's number of values."""
    rows = df.select(F.col(row_id).alias("row_id"), F.col(field).cast("string").alias("f")).where(~blank_or_placeholder(F.col("f"))).withColumn("skeleton", skeleton(F.col("f")))
    # Resolving takes far more time than rows of skeletons show by their bytes, so it is spread by number.
    spread = rows.select("skeleton").distinct().repartition(rows.sparkSession.sparkContext.defaultParallelism, "skeleton")
    rules, seen = measured(spread.mapInPandas(_resolve(grammar), _RULES).where("n_vals > 0"), "split-rules", size=row_bytes("skeleton", "marks"))
    if seen["size"] <= broadcast_bytes:
        ruled = rows.join(F.broadcast(rules), "skeleton")
    else:
        salted = rules.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        ruled = rows.withColumn("salt", F.pmod(F.xxhash64("row_id", "f"), F.lit(SALTS)).cast("int")).join(salted, ["skeleton", "salt"])
    marked = F.zip_with(units(F.col("f")), F.split("marks", ""), lambda u, m: F.when(m == "1", F.concat(F.lit(_BREAK), u)).when(m == "2", u).otherwise(""))
    vals = F.split(F.array_join(marked, ""), _BREAK)
    return ruled.select("row_id", "n_vals", F.posexplode(vals).alias("pos", "val")).where("pos > 0").select("row_id", "pos", "val", "n_vals")
