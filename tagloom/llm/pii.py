"""Personal data (op4): base patterns, and a semi-Markov conditional random field over whole spans.

The base patterns are found by linear scans. The field adds spans that they miss
(spelt-out addresses, national telephone numbers, split digits): a text is cut
into tokens; every run of at most ``LONGEST`` tokens and ``DIGITS`` digits (no kind
has more) that begins and ends with a bearing token, and not with a number that
stands before or after another one as in a column, is a candidate segment of each
type, features of the whole span score it, and a dynamic programme over segment
ends chooses boundaries and types jointly; tokens outside are single segments of no
type with score 0. The weights are trained by gradient ascent of the conditional
likelihood on sentences written here from fixed templates with a fixed seed. Added
spans never overlap base ones. Segments cannot reach over a stretch without bearing
tokens, so the programme runs on the stretches around them, which is exact. A
span's own features depend on its shape alone and are scored once a shape; the
programme goes over a stretch from left to right and holds one row of it. So the
work is linear in a text, whatever it is made of. No shuffle.
"""

from __future__ import annotations

import math
import random
import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, table

KINDS = ("email", "ip", "card", "phone")
#: Tokens and digits of a segment at most: a spelt-out address has 21 tokens or a few more, a card number 19 digits.
LONGEST, DIGITS = 32, 19

_domain = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+").match
_local = re.compile(r"[A-Za-z0-9._%+-]+\Z").search
_ip = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}").finditer
_card = re.compile(r"[0-9](?:[ -]?[0-9])+").finditer
_phone = re.compile(r"\+[0-9][ ().0-9-]+[0-9]").finditer
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        n = int(c) * (1 + k % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost, non-overlapping matches, by the at signs: what lies left of one is the longest run of local characters."""
    free, at = 0, text.find("@")
    while at >= 0:
        m = _domain(text, at + 1)
        if m:
            start = at
            while start > free and text[start - 1] in _LOCAL:
                start -= 1
            if start < at:
                yield start, m.end()
                free = m.end()
        at = text.find("@", at + 1)


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base patterns, by start and then kind."""
    out = [(a, b, "email") for a, b in emails(text)] if "@" in text else []
    if any_digit(text):
        for m in _ip(text):
            if all(len(p.lstrip("0")) < 4 and int(p[-4:]) < 256 for p in m.group().split(".")):
                out.append((m.start(), m.end(), "ip"))
        for m in _card(text):
            d = re.sub("[ -]", "", m.group())
            if 12 <= len(d) <= 19 and luhn(d):
                out.append((m.start(), m.end(), "card"))
        if "+" in text:
            for m in _phone(text):
                if 9 <= sum(c in "0123456789" for c in m.group()) <= 15:
                    out.append((m.start(), m.end(), "phone"))
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


any_digit = re.compile("[0-9]").search

# --- the field ------------------------------------------------------------------------------

_tokens = re.compile(r"[0-9]+|[A-Za-zÀ-￿]+|[^\s]| ").finditer
#: Words that may bear an address spelt out, or announce a span; fixed values.
_AT, _DOT = frozenset(["at"]), frozenset(["dot"])
_CUES = {
    "email": frozenset(["email", "mail", "e-mail", "contact", "write"]),
    "ip": frozenset(["ip", "host", "server", "address"]),
    "card": frozenset(["card", "visa", "mastercard", "credit"]),
    "phone": frozenset(["phone", "tel", "telephone", "call", "fax", "mobile", "telefon"]),
}
_at = re.compile(r"(?i) ?[\[({<]? ?(?:@|\bat\b) ?[\])}>]? ?").finditer
_run = re.compile(r"(?i)[a-z0-9-]++").match
_host = re.compile(r"(?i)[a-z0-9-]++(?: ?[\[({<]? ?(?:\.|\bdot\b) ?[\])}>]? ?[a-z0-9-]++)+").match
_bracketed = re.compile(r"[\[({<] ?at ?[\])}>]").search
_numeric = re.compile(r"[(+]?[0-9](?:[ ().\[\]-]{0,3}[0-9])+").finditer
_NAME = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._-")


def spelt(text: str) -> Iterator[tuple[int, int]]:
    """Addresses with signs or words for at and dot, leftmost first: from each sign the host to the right, then the name to the left."""
    free = dead = 0
    for m in _at(text):
        if m.start() <= free or m.end() < dead:
            continue
        host = _host(text, m.end())
        if host is None:
            # whatever begins in this run ends where it ends, and fails alike
            run = _run(text, m.end())
            dead = run.end() if run else m.end()
            continue
        start = m.start()
        while start > free and text[start - 1] in _NAME:
            start -= 1
        if start < m.start():
            yield start, host.end()
            free = host.end()


def bearing_ranges(text: str) -> list[tuple[int, int]]:
    """Stretches outside which no segment has a type: digits with what joins them (7 digits at least), and spelt-out addresses."""
    found = [(m.start(), m.end()) for m in _numeric(text) if sum(map(m.group().count, "0123456789")) >= 7 or m.group().count(".") >= 3] if any_digit(text) else []
    low = text.lower()
    if "@" in text or "dot" in low or _bracketed(low):
        found += [(a, b) for a, b in spelt(text) if "@" in text[a:b] or "dot" in text[a:b].lower() or _bracketed(text[a:b].lower())]
    found.sort()
    out: list[tuple[int, int]] = []
    for a, b in found:
        if out and a <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


#: A token of k digits is written as this letter plus k (of more than DIGITS digits: DIGITS + 1).
_DIGIT = 0xE000


def _digits(letter: str) -> int:
    """How many digits a token's letter stands for."""
    n = ord(letter) - _DIGIT
    return n if 0 < n <= DIGITS + 1 else 0


class Stretch:
    """Tokens of a stretch: where they start and end, and one letter each for their shape."""

    def __init__(self, text: str, lo: int, hi: int) -> None:
        self.text = text
        self.starts, self.ends, letters, self.digits = [], [], [], [0]
        for m in _tokens(text, lo, hi):
            g = m.group()
            n = 0
            if "0" <= g[0] <= "9":
                n = len(g)
                letters.append(chr(_DIGIT + min(n, DIGITS + 1)))
            elif g[0].isalpha():
                low = g.lower()
                letters.append("A" if low in _AT else "D" if low in _DOT else "a")
            else:
                letters.append("?" if _digits(g) else g)
            self.starts.append(m.start())
            self.ends.append(m.end())
            self.digits.append(self.digits[-1] + n)
        self.shape = "".join(letters)

    def bears(self, i: int) -> bool:
        return _ends(self.shape[i]) or self.shape[i] in "(+"

    def goes_on(self, j: int) -> bool:
        """Whether token j - 1 is a number that another one follows as in a column."""
        return _digits(self.shape[j - 1]) > 0 and _right(self.text, self.ends[j - 1])[2] > 0

    def reach(self) -> Iterator[tuple[int, int]]:
        """(i, j) for each bearing token i: segments from i end before token j."""
        j, n = 0, len(self.shape)
        for i in range(n):
            j = max(i, j)
            while j < n and j < i + LONGEST and self.digits[j + 1] - self.digits[i] <= DIGITS:
                j += 1
            # inside a column of numbers nothing begins
            if self.bears(i) and not (_digits(self.shape[i]) and _left(self.text, self.starts[i])[2]):
                yield i, j


def _ends(letter: str) -> bool:
    return letter.isalnum() or _digits(letter) > 0


def _segment_ends(shape: str) -> list[int]:
    """Lengths of the candidate segments at the beginning of a shape."""
    out, some = [], False
    for k, c in enumerate(shape):
        some = some or c in "A@" or _digits(c) > 0
        if some and _ends(c):
            out.append(k + 1)
    return out


def candidates(text: str, lo: int, hi: int) -> tuple[list[int], list[tuple[int, int]]]:
    """Token starts of a stretch (and its end), and candidate segments as pairs of token numbers."""
    s = Stretch(text, lo, hi)
    return s.starts + [s.ends[-1] if s.ends else lo], [(i, i + k) for i, j in s.reach() for k in _segment_ends(s.shape[i:j]) if not s.goes_on(i + k)]


def shape_features(kind: str, shape: str, lead: str) -> list[str]:
    """Features of a span's shape: one letter a token, and its first character."""
    digits = [n for c in shape if (n := _digits(c))]
    plain = "".join("9" if _digits(c) else c for c in shape)
    groups = ",".join(map(str, digits)) if len(digits) <= 5 else "many"
    lead = lead if lead in "0+(" else "9" if lead.isdigit() else "a"
    return [f"{kind}", f"{kind}|shape={plain if len(plain) <= 24 else 'long'}", f"{kind}|digits={sum(digits)}", f"{kind}|groups={groups}", f"{kind}|lead={lead}"]


def _left(text: str, start: int) -> tuple[bool, int, int]:
    """Whether no word goes on before a place, whether a sign joins it, and whether a number stands before it as in a column."""
    if not start:
        return True, 0, 0
    c = text[start - 1]
    return not c.isalnum(), int(c in ".-+@/("), int(c in " ,-" and text[max(0, start - 4) : start].rstrip(" ,-")[-1:].isdigit())


_follows = re.compile(r"[ ,-]{1,3}[0-9]++(?!\.[0-9])").match


def _right(text: str, end: int) -> tuple[bool, int, int]:
    if end == len(text):
        return True, 0, 0
    c = text[end]
    return not c.isalnum(), int(c in "-@/"), int(c in " ,-" and _follows(text, end) is not None)


def _cue(kind: str, text: str, start: int) -> bool:
    before = text[max(0, start - 16) : start].lower().replace(":", " ").split()
    return bool(before) and before[-1].strip(".,") in _CUES[kind]


def _valid(kind: str, span: str) -> bool:
    """Whether the digits pass Luhn (card) or are four parts of at most 255 (ip)."""
    if kind == "card":
        digits = re.sub("[^0-9]", "", span)
        return 12 <= len(digits) <= 19 and luhn(digits)
    parts = re.findall("[0-9]+", span) if kind == "ip" else ()
    return len(parts) == 4 and all(int(x) < 256 for x in parts)


def place_features(kind: str, text: str, start: int, end: int) -> list[str]:
    """Features of where a span stands and of its digits' values."""
    (a, b, c), (x, y, z) = _left(text, start), _right(text, end)
    return [f"{kind}|tight={int(a and x)}", f"{kind}|joined={b + y}", f"{kind}|column={c + z}", f"{kind}|cue={int(_cue(kind, text, start))}", f"{kind}|valid={int(_valid(kind, text[start:end]))}"]


def features(kind: str, text: str, start: int, end: int) -> list[str]:
    """Features of a whole span as a segment of ``kind``."""
    return shape_features(kind, Stretch(text, start, end).shape, text[start]) + place_features(kind, text, start, end)


def _score(weights: dict[str, float], names: list[str]) -> float:
    return sum(weights.get(n, 0.0) for n in names)


class Field:
    """Weights, the most that a span's place can add for each kind, and the scores of shapes met so far (at most ``SHAPES``, then forgotten)."""

    SHAPES = 200_000

    def __init__(self, weights: dict[str, float]) -> None:
        self.weights = weights
        value = lambda k, name, n: [weights.get(f"{k}|{name}={v}", 0.0) for v in range(n)]
        self.tight, self.joined, self.column, self.cue, self.valid = ({k: value(k, name, n) for k in KINDS} for name, n in (("tight", 2), ("joined", 3), ("column", 3), ("cue", 2), ("valid", 2)))
        self.late = {k: max(self.cue[k]) + max(self.valid[k]) for k in KINDS}
        #: the most that a place adds, by whether a number stands before it
        self.before = {k: [max(self.tight[k]) + max(self.joined[k]) + max(self.column[k][c : c + 2]) + self.late[k] for c in (0, 1)] for k in KINDS}
        self.place = {k: max(self.tight[k]) + max(self.joined[k]) + max(self.column[k]) + self.late[k] for k in KINDS}
        self.shapes: dict[tuple[str, str], list[tuple[str, float]]] = {}
        self.starts: dict[tuple[str, str], list[tuple[int, str, float]]] = {}

    def possible(self, shape: str, lead: str) -> list[tuple[int, str, float]]:
        """(tokens, kind, score of the shape) of the segments at the beginning of a shape that may score above 0."""
        key = (shape, lead)
        found = self.starts.get(key)
        if found is None:
            found = []
            for k in _segment_ends(shape):
                own = (shape[:k], lead)
                scored = self.shapes.get(own)
                if scored is None:
                    scored = [(kind, s) for kind in KINDS if (s := _score(self.weights, shape_features(kind, *own))) + self.place[kind] > 0]
                    if len(self.shapes) >= self.SHAPES:
                        self.shapes.clear()
                    self.shapes[own] = scored
                found += [(k, kind, s) for kind, s in scored]
            if len(self.starts) >= self.SHAPES:
                self.starts.clear()
            self.starts[key] = found
        return found

    def decode(self, text: str, lo: int, hi: int) -> list[tuple[int, int, str]]:
        """The best segmentation of a stretch: spans of a type."""
        s = Stretch(text, lo, hi)
        n = len(s.shape)
        best, back = [0.0] + [-math.inf] * n, [None] * (n + 1)
        at = 0
        for i, j in s.reach():
            for k in range(at, i):
                if best[k] >= best[k + 1]:
                    best[k + 1], back[k + 1] = best[k], None
            at = i
            here = best[i]
            if here >= best[i + 1]:
                best[i + 1], back[i + 1] = here, None
            left = None
            for size, kind, score in self.possible(s.shape[i:j], text[s.starts[i]]):
                least = max(0.0, best[i + size] - here)
                left = left or _left(text, s.starts[i])
                if score + self.before[kind][left[2]] <= least:
                    continue
                right = _right(text, s.ends[i + size - 1])
                if right[2] and _digits(s.shape[i + size - 1]):
                    continue
                score += self.tight[kind][left[0] and right[0]] + self.joined[kind][left[1] + right[1]] + self.column[kind][left[2] + right[2]]
                if score + self.late[kind] <= least:
                    continue
                score += self.cue[kind][_cue(kind, text, s.starts[i])] + self.valid[kind][_valid(kind, text[s.starts[i] : s.ends[i + size - 1]])]
                if score > least:
                    best[i + size], back[i + size] = here + score, (i, kind)
            at = i + 1
        for k in range(at, n):
            if best[k] >= best[k + 1]:
                best[k + 1], back[k + 1] = best[k], None
        out, j = [], n
        while j:
            if back[j] is None:
                j -= 1
                continue
            i, kind = back[j]
            out.append((s.starts[i], s.ends[j - 1], kind))
            j = i
        return out[::-1]


def decode(weights: dict[str, float], text: str, lo: int, hi: int) -> list[tuple[int, int, str]]:
    return Field(weights).decode(text, lo, hi)


def _sentences(n: int, seed: int) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """Training sentences with their spans, from templates."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice(("an", "er", "th", "on", "lo", "mi", "ta", "que", "sch", "re")) for _ in range(rng.randrange(1, 4)))
    num = lambda k: "".join(rng.choice("0123456789") for _ in range(k))

    def card(valid: bool) -> str:
        head = "4" + num(14)
        d = next(c for c in "0123456789" if luhn(head + c) == valid)
        d = head + d
        return rng.choice([d, " ".join(d[k : k + 4] for k in (0, 4, 8, 12)), ".".join(d[k : k + 4] for k in (0, 4, 8, 12))])

    def real() -> tuple[str, str]:
        kind = rng.choice(KINDS)
        if kind == "email":
            a, d = rng.choice([(" at ", " dot "), (" [at] ", " [dot] "), ("[at]", "[dot]"), ("(at)", "(dot)"), (" (at) ", " (dot) "), ("[at]", "."), (" @ ", "."), ("(at)", ".")])
            return kind, f"{word()}{rng.choice(['', '.' + word(), num(2)])}{a}{word()}{rng.choice(['', num(1)])}{d}{rng.choice(['com', 'org', 'net', 'de', 'example' + d + 'com'])}"
        if kind == "ip":
            return kind, rng.choice(["[.]", "(.)"]).join(str(rng.randrange(256)) for _ in range(4))
        if kind == "card":
            return kind, card(True).replace(" ", rng.choice([" ", "."]))
        return kind, rng.choice([f"({num(3)}) {num(3)}-{num(4)}", f"{num(3)}-{num(3)}-{num(4)}", f"({num(3)}) 555-{num(4)}", f"{num(3)}.{num(3)}.{num(4)}", f"0{num(2)} {num(3)} {num(4)}", f"0{num(3)}-{num(7)}", f"+1 ({num(3)}) {num(3)}-{num(4)}", f"+{num(2)} {num(3)} {num(7)}"])

    def other() -> str:
        if rng.random() < 0.3:  # columns of numbers
            digits = rng.randrange(1, 7)
            if rng.random() < 0.5:  # of one width, most of them like the groups of a card number
                width = rng.choice([2, 3, 4, 4, 4, 5])
                return rng.choice([" ", " ", " ", ", ", " - "]).join(str(rng.randrange(10 ** (width - 1), 10**width)) for _ in range(rng.randrange(5, 16)))
            return rng.choice([" ", " ", "  ", ", ", " - "]).join(str(rng.randrange(1, 10 ** rng.randrange(1, digits + 1))) for _ in range(rng.randrange(2, 12)))
        return rng.choice([num(rng.randrange(1, 12)), num(16), card(False), f"{num(1)}.{num(1)}", f"{num(4)}-{num(2)}-{num(2)}", f"{num(2)}:{num(2)}", f"{num(1)},{num(3)},{num(3)}", f"{num(4)}-{num(4)}", f"{num(1)}.{num(1)}.{num(1)}.{num(4)}", f"{word()} at {word()} {word()}", f"{word()} dot {word()}", f"{num(3)} {num(3)} {num(2)}", f"{num(4)} {num(4)}", f"{num(3)}-{num(4)}", f"{num(2)}.{num(2)}.{num(4)}", f"{word()} at {num(3)}", f"{num(2)}-{num(2)}-{num(2)}-{num(2)}", f"{num(3)}, {num(3)}, {num(4)}", f"{num(5)}-{num(4)}", f"{num(3)} - {num(3)}"])

    out = []
    for _ in range(n):
        text, spans = "", []
        for _ in range(rng.randrange(1, 4)):
            text += " ".join(word() for _ in range(rng.randrange(1, 4))) + " "
            if rng.random() < 0.45:
                kind, s = real()
                if rng.random() < 0.3:
                    text += rng.choice(sorted(_CUES[kind])) + rng.choice([" ", ": "])
                spans.append((len(text), len(text) + len(s), kind))
                text += s
                if rng.random() < 0.1:  # what follows a span need not be a word
                    s = ".".join(num(2) for _ in range(4))
                    spans.append((len(text) + 1, len(text) + 1 + len(s), "ip"))
                    text += " " + s
            else:
                text += other()
            text += rng.choice([" ", ", ", ". "])
        out.append((text + word() + ".", spans))
    return out


@lru_cache(2)
def train(sentences: int = 900, seed: int = 11, rounds: int = 12, rate: float = 0.3, decay: float = 1e-3) -> dict[str, float]:
    """Weights by stochastic gradient ascent of the conditional likelihood (forward-backward over segments)."""
    data = []
    for text, spans in _sentences(sentences, seed):
        gold = set(spans)
        for lo, hi in bearing_ranges(text):
            at, segments = candidates(text, lo, hi)
            items = []
            ends = Stretch(text, lo, hi).ends
            for i, j in segments:
                items += [(i, j, features(k, text, at[i], ends[j - 1]), (at[i], ends[j - 1], k) in gold) for k in KINDS]
            if items:
                data.append((len(at) - 1, items))
    weights: dict[str, float] = {}
    order = random.Random(seed + 1)
    for r in range(rounds):
        order.shuffle(data)
        step = rate / (1 + r / 4)
        for n, items in data:
            scores = [_score(weights, f) for _, _, f, _ in items]
            ends: dict[int, list[int]] = {}
            starts: dict[int, list[int]] = {}
            for k, (i, j, _, _) in enumerate(items):
                ends.setdefault(j, []).append(k)
                starts.setdefault(i, []).append(k)
            alpha, beta = [0.0] * (n + 1), [0.0] * (n + 1)
            for j in range(1, n + 1):
                alpha[j] = _lse([alpha[j - 1]] + [alpha[items[k][0]] + scores[k] for k in ends.get(j, ())])
            for i in range(n - 1, -1, -1):
                beta[i] = _lse([beta[i + 1]] + [beta[items[k][1]] + scores[k] for k in starts.get(i, ())])
            for k, (i, j, f, true) in enumerate(items):
                g = true - math.exp(min(0.0, alpha[i] + scores[k] + beta[j] - alpha[n]))
                if abs(g) > 1e-4:
                    for name in f:
                        weights[name] = weights.get(name, 0.0) * (1 - step * decay) + step * g
    return weights


def _lse(x: list[float]) -> float:
    m = max(x)
    return m + math.log(sum(math.exp(v - m) for v in x))


def added_spans(field: Field | dict[str, float], text: str, base: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Spans of the field that overlap no base span (given by start): the programme runs between them."""
    field = field if isinstance(field, Field) else Field(field)
    taken: list[list[int]] = []
    for a, b, _ in base:
        if taken and a <= taken[-1][1]:
            taken[-1][1] = max(b, taken[-1][1])
        else:
            taken.append([a, b])
    ends = [b for _, b in taken]
    out = []
    for lo, hi in bearing_ranges(text):
        k = bisect_right(ends, lo)
        while lo < hi:
            a, b = taken[k] if k < len(taken) else (hi, hi)
            if text[lo : min(a, hi)].strip():
                out += field.decode(text, lo, min(a, hi))
            lo, k = b, k + 1
    return out


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", weights: dict[str, float] | None = None) -> DataFrame:
    """One row a document: doc_id, base and spans (arrays of kind, start, end; code points, end exclusive; by start, then kind).

    spans has the base spans and the field's, which have at most ``LONGEST`` tokens
    and ``DIGITS`` digits. Null and empty texts have none; texts and words of any
    length are read whole in linear time; repeated rows are judged each on its own;
    an empty table gives no rows.
    """
    field = Field(weights if weights is not None else train())
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    rows = lambda spans: [{"kind": k, "start": a, "end": b} for a, b, k in spans]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            base, both = [], []
            for text in batch.column(1).to_pylist():
                own = base_spans(text or "")
                base.append(rows(own))
                more = added_spans(field, text or "", own)
                both.append(rows(sorted(own + more, key=lambda s: (s[0], KINDS.index(s[2])))) if more else base[-1])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(base, kind), pa.array(both, kind)], ["doc_id", "base", "spans"])

    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    s = "array<struct<kind:string,start:long,end:long>>"
    return d.mapInArrow(run, f"doc_id long, base {s}, spans {s}")


def op4_semicrf_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_personal_data(table(spark, sf_dir, "documents"))
    text = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    counts = [count(k) for k in KINDS]
    return found.select("doc_id", *counts, F.sha2(text("base"), 256).alias("base_sha256"), text("spans").alias("spans"))
