"""The enzyme registry: recognition patterns and geometry."""

from __future__ import annotations

import re
import warnings
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from tagloom.functions.sequence import COMPLEMENT, IUPAC

#: Fixed values. Enzyme: tag length, forward and reverse pattern (site@offset; [..] is a choice), left anchor, right anchor, spacer.
TABLE = {
    "BcgI": (32, "CGA@10 TGC@19", "GCA@10 TCG@19", "CGA", "TGC", 6),
    "AlfI": (32, "GCA@10 TGC@19", "", "GCA", "TGC", 6),
    "AloI": (27, "GAAC@7 TCC@17", "GGA@7 GTTC@16", "GAAC", "TCC", 6),
    "BaeI": (28, "AC@10 GTA@16 [CT]@19 C@20", "G@7 [AG]@8 TAC@9 GT@16", "AC", "GTAYC", 4),
    "BplI": (27, "GAG@8 CTC@16", "", "GAG", "CTC", 5),
    "BsaXI": (27, "AC@9 CTCC@16", "GGAG@7 GT@16", "AC", "CTCC", 5),
    "BslFI": (25, "GGGAC@6", "GTCCC@14", "GGGAC", "", 0),
    "Bsp24I": (27, "GAC@8 TGG@17", "CCA@7 GTC@16", "GAC", "TGG", 6),
    "CjeI": (28, "CCA@8 GT@17", "AC@9 TGG@17", "CCA", "GT", 6),
    "CjePI": (27, "CCA@7 TC@17", "GA@8 TGG@17", "CCA", "TC", 7),
    "CspCI": (33, "CAA@11 GTGG@19", "CCAC@10 TTG@19", "CAA", "GTGG", 5),
    "FalI": (27, "AAG@8 CTT@16", "", "AAG", "CTT", 5),
    "HaeIV": (27, "GA@7 [CT]@9 [AG]@15 TC@16", "GA@9 [CT]@11 [AG]@17 TC@18", "GAY", "RTC", 5),
    "Hin4I": (27, "GA@8 [CT]@10 [ACG]@16 TC@17", "GA@8 [CTG]@10 [AG]@16 TC@17", "GAY", "VTC", 5),
    "PpiI": (27, "GAAC@7 CTC@16", "GAG@8 GTTC@16", "GAAC", "CTC", 5),
    "PsrI": (27, "GAAC@7 TAC@17", "GTA@7 GTTC@16", "GAAC", "TAC", 6),
}
DEFAULT_PANEL = ("BcgI", "AlfI", "AloI", "FalI")
LONGEST_TAG = 32


@dataclass(frozen=True)
class Enzyme:
    name: str
    tag_len: int
    patterns: tuple[tuple[tuple[int, str], ...], ...]  # (offset, allowed bases) of each fixed place
    left: str
    right: str
    spacer: int
    exact_site: int
    d2: int
    d3: int

    @property
    def body_len(self) -> int:
        """Places free to vary: the tag without its site."""
        return min(self.tag_len, LONGEST_TAG) - self.exact_site - self.d2 - self.d3

    @property
    def recognition(self) -> str:
        return f"{self.left}-N{self.spacer}-{self.right}"


@dataclass(frozen=True)
class MarginEnzyme:
    """An enzyme of one's own: two anchors in IUPAC codes around a spacer, and margins on either side of the site."""

    name: str
    left: str
    right: str
    spacer: int
    tag_len: int
    left_margin: int
    right_margin: int

    @property
    def reverse_anchors(self) -> tuple[str, str]:
        turn = str.maketrans(IUPAC, COMPLEMENT)
        return self.right.upper().translate(turn)[::-1], self.left.upper().translate(turn)[::-1]

    @property
    def recognition(self) -> str:
        return f"{self.left}-N{self.spacer}-{self.right}" if self.right else self.left


def _places(pattern: str) -> tuple[tuple[int, str], ...]:
    out = []
    for part in pattern.split():
        site, _, at = part.partition("@")
        for k, m in enumerate(re.findall(r"\[[A-Z]+\]|[A-Z]", site)):
            out.append((int(at) + k, m.strip("[]")))
    return tuple(out)


def _enzyme(name: str) -> Enzyme:
    tag, forward, reverse, left, right, spacer = TABLE[name]
    first = _places(forward)
    sizes = [len(b) for _, b in first]
    return Enzyme(name, tag, tuple(_places(p) for p in (forward, reverse) if p), left, right, spacer, sizes.count(1), sizes.count(2), sizes.count(3))


REGISTRY = {name.lower(): _enzyme(name) for name in TABLE}


def get(name: str) -> Enzyme | None:
    """By name, in any case."""
    return REGISTRY.get(name.strip().lower())


def resolve(names: str | list[str] | tuple[str, ...] = DEFAULT_PANEL) -> list[Enzyme]:
    """A panel from names: an unknown one is an error, one whose tags are too long to pack is left out with a warning."""
    names = names.split(",") if isinstance(names, str) else names
    out = []
    for n in names:
        e = get(n)
        if e is None:
            raise ValueError(f"unknown enzyme: {n}")
        if e.tag_len > LONGEST_TAG:
            warnings.warn(f"{e.name} is left out: its tags have {e.tag_len} bases, more than {LONGEST_TAG}", stacklevel=2)
        elif e not in out:
            out.append(e)
    return out


def usable() -> list[Enzyme]:
    return [e for e in REGISTRY.values() if e.tag_len <= LONGEST_TAG]


def registry(spark: SparkSession) -> DataFrame:
    """The registry as a table (16 rows)."""
    rows = [(e.name, e.left, e.right, e.spacer, e.tag_len, e.recognition, len(e.patterns), e.exact_site, e.d2, e.d3, e.body_len) for e in REGISTRY.values()]
    return spark.createDataFrame(rows, "enzyme string, left_anchor string, right_anchor string, spacer int, tag_len int, recognition string, n_patterns int, exact_site int, d2 int, d3 int, body_len int")
