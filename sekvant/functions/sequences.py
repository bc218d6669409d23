"""Nucleotide strings: cleaning, reverse complement, translation, windows, slices."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The standard genetic code, codons in the order T, C, A, G.
STANDARD_CODE = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"
BASES, COMPLEMENTS = "ACGTacgt", "TGCAtgca"


def clean(seq: Column) -> Column:
    """Upper case; whatever is not A, C, G, T or N becomes N."""
    return F.regexp_replace(F.upper(seq), "[^ACGTN]", "N")


def reverse_complement(seq: Column) -> Column:
    """Other characters and the case are kept."""
    return F.reverse(F.translate(seq, BASES, COMPLEMENTS))


def amino_acids() -> list[str]:
    """Amino acid by codon, a codon read as a decimal number of the digits T0 C1 A2 G3 N4.

    A codon with N has an amino acid where every base in its place gives the same one, else X.
    """
    out = ["X"] * 445
    for codon in product(range(5), repeat=3):
        given = {STANDARD_CODE[a * 16 + b * 4 + c] for a, b, c in product(*(range(4) if x == 4 else [x] for x in codon))}
        out[int("".join(map(str, codon)))] = given.pop() if len(given) == 1 else "X"
    return out


def translate(seq: Column, frame: int) -> Column:
    """Amino acids of the whole codons from offset ``frame`` of a clean sequence, in linear time."""
    digits = F.translate(F.substring(seq, frame + 1, 2**31 - 1), "TCAGN", "01234")
    table = F.array(*map(F.lit, amino_acids()))
    return F.array_join(F.transform(F.regexp_extract_all(digits, F.lit("..."), 0), lambda c: F.get(table, c.cast("int"))), "")


def trimmed_length(length: Column, frame: int) -> Column:
    """End of the last whole codon of a frame."""
    return frame + (length - frame) - F.pmod(length - frame, F.lit(3))


def _frame_tables() -> tuple[np.ndarray, np.ndarray]:
    """Digit of every byte, and amino acid of every three digits to the base of five."""
    digit = np.full(256, 4, dtype=np.int64)
    for i, c in enumerate("TCAG"):
        digit[ord(c)] = i
    letters = amino_acids()
    table = np.array([ord(letters[a * 100 + b * 10 + c]) for a, b, c in product(range(5), repeat=3)], dtype=np.uint8)
    return digit, table


@F.pandas_udf(T.ArrayType(T.StringType()))
def _six(seqs: Iterator[pd.Series]) -> Iterator[pd.Series]:
    digit, table = _frame_tables()
    # T C A G pair with A G T C: the complement of a digit; N stays.
    pair = np.array([2, 3, 0, 1, 4])
    for batch in seqs:
        out = []
        for s in batch:
            if s is None:
                out.append(None)
                continue
            fwd = digit[np.frombuffer(s.encode("latin-1", "replace"), dtype=np.uint8)]
            both = []
            for d in (fwd, pair[fwd[::-1]]):
                for k in range(3):
                    n = max(len(d) - k, 0) // 3 * 3
                    c = d[k : k + n].reshape(-1, 3)
                    both.append(table[c[:, 0] * 25 + c[:, 1] * 5 + c[:, 2]].tobytes().decode("ascii"))
            out.append(both)
        yield pd.Series(out, dtype=object)


def six_frames(df: DataFrame, name: str = "name", seq: str = "seq") -> DataFrame:
    """``(target_name, base_seq, strand, frame, aa)`` of a clean sequence; frames without a codon are left out.

    A sequence is read as numbers once and all its frames are looked up in arrays; a
    letter that is no base counts as N.
    """
    each = df.select(F.col(name).alias("base_seq"), F.posexplode(_six(F.col(seq))).alias("i", "aa")).where("aa <> ''")
    way, k = F.when(F.col("i") < 3, "fwd").otherwise("rev"), F.pmod("i", F.lit(3)).cast("int")
    suffix = F.concat(F.lit("|"), way, (k + 1).cast("string"))
    return each.select(F.concat("base_seq", suffix).alias("target_name"), "base_seq", F.when(F.col("i") < 3, "+").otherwise("-").alias("strand"), k.alias("frame"), "aa")


def windows(df: DataFrame, size: int, overlap: int, name: str = "name", seq: str = "seq") -> DataFrame:
    """Windows of ``size + overlap`` bases every ``size``, ``(window_id, chrom, w_start, w_end, seq)``, 1-based.

    The last window ends with the sequence; no window begins after one that does.
    """
    length = F.length(seq)
    last = F.greatest(F.lit(0), F.ceil((length - size - overlap) / F.lit(size)))
    # The windows leave the row as an array of pieces, so the whole sequence does not travel with each of them.
    cut = F.when(length > 0, F.transform(F.sequence(F.lit(0), last.cast("int")), lambda i: F.struct((i * size + 1).alias("w_start"), F.substring(F.col(seq), i * size + 1, F.lit(size + overlap)).alias("piece"))))
    pieces = df.select(F.col(name).alias("chrom"), F.explode(cut).alias("x")).select("chrom", "x.w_start", (F.col("x.w_start") + F.length("x.piece") - 1).alias("w_end"), F.col("x.piece").alias("seq"))
    return pieces.select(F.concat("chrom", F.lit(":"), "w_start", F.lit("-"), "w_end").alias("window_id"), "chrom", "w_start", "w_end", "seq")


def slice_of(seq: Column, start: Column, end: Column, strand: Column | None = None) -> Column:
    """Bases ``start`` to ``end``, 1-based, ends included; reverse complement on the minus strand."""
    part = F.substring(seq, start, end - start + 1)
    return part if strand is None else F.when(strand == "-", reverse_complement(part)).otherwise(part)


def wrapped(seq: Column, width: int = 60) -> Column:
    """The sequence in lines of ``width``."""
    return F.regexp_replace(F.regexp_replace(seq, f"(.{{{width}}})", "$1\n"), "\n$", "")
