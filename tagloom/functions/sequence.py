"""Column functions over DNA strings (upper case, A C G T and IUPAC codes).

All are compositions of built-in functions, so they stay in generated code and
can be used in select, filter and join conditions alike.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: IUPAC codes and their complements, and the bases each code stands for.
IUPAC, COMPLEMENT = "ACGTRYSWKMBDHVN", "TGCAYRSWMKVHDBN"
IUPAC_BASES = {"A": "A", "C": "C", "G": "G", "T": "T", "R": "AG", "Y": "CT", "S": "CG", "W": "AT", "K": "GT", "M": "AC", "B": "CGT", "D": "AGT", "H": "ACT", "V": "ACG", "N": "ACGT"}
EVEN_BITS = 0x5555555555555555


def iupac_matches(base: Column, code: Column) -> Column:
    """Whether a base is one of those the code stands for."""
    table = F.create_map(*[F.lit(x) for kv in IUPAC_BASES.items() for x in kv])
    return F.coalesce(F.instr(F.element_at(table, F.upper(code)), F.upper(base)) > 0, F.lit(False))


def is_pure(seq: Column) -> Column:
    """Only A, C, G, T in either case; an empty string is not."""
    return seq.rlike("^[ACGTacgt]+$")


def revcomp(seq: Column) -> Column:
    """Reverse complement; what is no IUPAC code becomes N."""
    return F.reverse(F.translate(F.regexp_replace(F.upper(seq), f"[^{IUPAC}]", "N"), IUPAC, COMPLEMENT))


def gc_content(seq: Column) -> Column:
    """(G + C) / length, 0 for an empty string."""
    return gc_count(seq) / F.greatest(F.length(seq), F.lit(1))


def gc_count(seq: Column) -> Column:
    return F.length(F.regexp_replace(seq, "[^GCgc]", "")).cast("long")


def pack(seq: Column) -> Column:
    """Two bits a base, base i in bits 2i and 2i + 1 (A 0, C 1, G 2, T 3); up to 32 bases; other letters count as A."""
    digits = F.translate(F.regexp_replace(F.upper(seq), "[^ACGT]", "A"), "ACGT", "0123")
    half = lambda a: F.coalesce(F.conv(F.reverse(F.substring(digits, a, 16)), 4, 10).cast("long"), F.lit(0).cast("long"))
    return half(1).bitwiseOR(F.shiftleft(half(17), 32))


def unpack(packed: Column, length: int) -> Column:
    """The bases of a packed string of known length."""
    return F.array_join(F.transform(F.sequence(F.lit(0), F.lit(length - 1)), lambda i: F.element_at(F.array(*map(F.lit, "ACGT")), F.call_function("shiftrightunsigned", packed, 2 * i).bitwiseAND(F.lit(3)).cast("int") + 1)), "")


def canonical(seq: Column) -> Column:
    """The smaller of a string and its reverse complement: an equality key of both strands."""
    return F.least(seq, revcomp(seq))


def packed_mismatches(a: Column, b: Column, length: int = 32) -> Column:
    """Bases that differ among the first ``length`` of two packed strings: fold the bit pairs of the xor, count them."""
    mask = (1 << (2 * min(length, 32))) - 1
    mask = mask - (1 << 64) if mask >> 63 else mask
    x = a.bitwiseXOR(b).bitwiseAND(F.lit(mask).cast("long"))
    return F.bit_count(x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(F.lit(EVEN_BITS).cast("long")))


def bit_hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def screen_key(tag: Column, window: int = 18) -> Column:
    """The smaller strand of the centred window of a tag; the whole tag if it is no longer."""
    lo = F.greatest(F.floor((F.length(tag) - window) / 2), F.lit(0)).cast("int") + 1
    return F.least(F.substring(tag, lo, F.lit(window)), F.substring(revcomp(tag), lo, F.lit(window)))


def part_bounds(length: int, parts: int) -> list[tuple[int, int]]:
    """Split [0, length) into near-equal parts, the longer ones first."""
    base, extra = divmod(length, parts)
    out, at = [], 0
    for k in range(parts):
        to = at + base + (k < extra)
        out.append((at, to))
        at = to
    return out
