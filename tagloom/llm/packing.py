"""Packing (op7): sum-of-squares online packing of token ids into windows.

Each task packs the documents of its input partition in the order in which it
reads them, so no document is shuffled and a lost task repeats the same
choices. A document's full windows stand alone; its remainder goes to the fill
level h that makes the sum of squared counts of partially filled windows least,
among all levels that a level array counts and a new window. What is still open
at the end of a partition is closed by cutting: the emptiest windows fill the
gaps of the fullest, and the one window left is cut into powers of two. Nothing
is padded then. Open windows hold remainders only, two bytes an id, so memory is
bounded by the size of an input partition.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator
from itertools import chain, count, filterfalse

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from .common import id_text, slices, split_words, table, text_buffer

CAPACITY, END_ID = 4096, 2
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def tokenizer_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLANK = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_LETTER = np.isin(np.arange(256), np.arange(97, 123))
#: Words that are one run of lower-case letters, which normalising leaves as they are.
_SIMPLE = re.compile("[a-z\u00e0-\u00f6\u00f8-\u00ff]+").fullmatch


def _apart(texts: pa.Array) -> pa.Array:
    """Lower-case A-Z and set the last full stop or comma of a word apart: fewer distinct words, the same ids.

    Not where the mark of special tokens occurs, whose case counts.
    """
    offsets, raw = text_buffer(texts)
    if b"<|" not in raw.tobytes():
        raw = _LOWER[raw]
        first, blank = np.zeros(len(raw) + 1, bool), np.ones(len(raw) + 1, bool)
        first[offsets] = True
        blank[:-1] = _BLANK[raw] | first[:-1]
        at = np.flatnonzero((raw == 44) | (raw == 46))
        at = at[(at > 0) & ~first[at] & blank[at + 1]]
        at = at[_LETTER[raw[at - 1]]]
        raw = np.insert(raw, at, 32)
        offsets = offsets + np.searchsorted(at, offsets)  # none of these places starts a text
    return pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(np.ascontiguousarray(offsets)), pa.py_buffer(np.ascontiguousarray(raw)))


class WordTokenizer:
    """Ids of whole texts, by a table of the ids of each blank-separated word.

    The tokenizer drops white space and never joins characters across it, so a
    text's ids are those of its words in turn. The table is emptied when it has
    ``most`` words, which bounds memory and changes nothing else.
    """

    def __init__(self, path: str, end_id: int = END_ID, most: int = 1_000_000) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.end_id, self.most = Tokenizer.from_file(path), end_id, most
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)  # ids that end a word
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self._clear()

    def _clear(self) -> None:
        self.at: dict[str, int] = {}
        self.flat, self.lens = np.array([self.end_id], np.uint32), np.ones(1, np.int64)

    def _learn(self, words: list[str]) -> None:
        simple = list(filter(_SIMPLE, words))
        other = list(filterfalse(_SIMPLE, words))
        blocks = [simple[k : k + 500] for k in range(0, len(simple), 500)]
        flat, lens = [self.flat], [self.lens]
        for block, e in zip(blocks, self.tokenizer.encode_batch_fast([" ".join(b) for b in blocks], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, np.uint32)
            n = np.diff(np.flatnonzero(self.ends[ids]), prepend=-1)
            if len(n) != len(block) or n.sum() != len(ids):
                raise ValueError("a word of letters without one end")
            flat.append(ids)
            lens.append(n)
        rest = [e.ids for e in self.tokenizer.encode_batch_fast(other, add_special_tokens=False)]
        flat.append(np.fromiter(chain.from_iterable(rest), np.uint32))
        lens.append(np.fromiter(map(len, rest), np.int64, len(rest)))
        self.at.update(zip(chain(simple, other), count(len(self.lens))))
        self.flat, self.lens = np.concatenate(flat), np.concatenate(lens)

    def __call__(self, texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(first row, token offsets by text, ids) of blocks of rows, each text closed by the end id."""
        starts, ids, words = split_words(_apart(texts), None)
        if len(self.at) > self.most:
            self._clear()
        words = words.to_pylist()
        self._learn(list(filterfalse(self.at.__contains__, filter(None, words))))
        begins = np.cumsum(self.lens) - self.lens
        index = np.fromiter((self.at.get(w, 0) for w in words), np.int64, len(words))  # the empty word does not occur in ids
        a = 0
        while a < len(texts):
            b = max(a + 1, int(np.searchsorted(starts, starts[a] + 200_000, side="right")) - 1)
            word = np.insert(index[ids[starts[a] : starts[b]]] if len(index) else np.zeros(0, np.int64), starts[a + 1 : b + 1] - starts[a], 0)  # row 0: the end id
            n = self.lens[word]
            upto = np.concatenate(([0], np.cumsum(n)))
            yield a, upto[starts[a : b + 1] - starts[a] + np.arange(b - a + 1)], self.flat[np.repeat(begins[word] - upto[:-1], n) + np.arange(upto[-1])]
            a = b


class Packer:
    """Packs documents one after another; rows() gives the pieces of the windows closed so far."""

    def __init__(self, capacity: int, first_id: int, max_open: int | None = None) -> None:
        self.capacity, self.next_id, self.max_open = capacity, first_id, max_open
        self.count = np.zeros(capacity + 1, np.int64)  # windows at each fill level
        self.open: dict[int, list[list]] = {}  # level -> windows, each a list of pieces (doc, start, ids, doc_tokens)
        self.n_open = 0
        self.out: list[tuple] = []

    def add(self, doc, ids: np.ndarray) -> None:
        c, n = self.capacity, len(ids)
        full = n - n % c
        for s in range(0, full, c):
            self._close([(doc, s, ids[s : s + c], n)])
        if n > full:
            rest = ids[full:]
            self._place((doc, full, rest.astype(np.uint16) if rest.max() < 1 << 16 else rest.copy(), n))
        if self.max_open is not None and self.n_open > self.max_open:
            self.flush()

    def _place(self, piece: tuple) -> None:
        c, s, count = self.capacity, len(piece[2]), self.count
        best, level = 2 * int(count[s]) + 1, 0  # a new window
        if s < c - 1:
            gain = np.where(count[1 : c - s] > 0, 2 * (count[1 + s : c] - count[1 : c - s]) + 2, np.iinfo(np.int64).max)
            k = len(gain) - 1 - int(np.argmin(gain[::-1]))  # of equals, the fullest
            if gain[k] <= best:
                best, level = int(gain[k]), k + 1
        if count[c - s] and 1 - 2 * int(count[c - s]) <= best:
            level = c - s  # fills a window
        window = []
        if level:
            window = self.open[level].pop()
            self.count[level] -= 1
            self.n_open -= 1
        window.append(piece)
        if level + s == c:
            self._close(window)
        else:
            self.open.setdefault(level + s, []).append(window)
            self.count[level + s] += 1
            self.n_open += 1

    def _close(self, window: list[tuple]) -> None:
        offset = 0
        for doc, start, ids, n in window:
            self.out.append((doc, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), n, self.next_id, offset))
            offset += len(ids)
        self.next_id += 1

    def flush(self) -> None:
        """Close all open windows without padding, by cutting."""
        windows = [[level, w] for level in sorted(self.open, reverse=True) for w in self.open[level]]
        self.open, self.n_open = {}, 0
        self.count[:] = 0
        i, j = 0, len(windows) - 1
        while i < j:
            gap, (level, donor) = self.capacity - windows[i][0], windows[j]
            doc, start, ids, n = donor.pop()
            if len(ids) > gap:
                donor.append((doc, start, ids[: len(ids) - gap], n))
                start, ids = start + len(ids) - gap, ids[len(ids) - gap :]
            windows[i][1].append((doc, start, ids, n))
            windows[i][0] += len(ids)
            windows[j][0] = level - len(ids)
            if windows[i][0] == self.capacity:
                self._close(windows[i][1])
                i += 1
            if not windows[j][0]:
                j -= 1
        if i == j:
            left, pieces = windows[i]
            while left:
                size = 1 << (left.bit_length() - 1)
                window, room = [], size
                while room:
                    doc, start, ids, n = pieces.pop(0)
                    if len(ids) > room:
                        pieces.insert(0, (doc, start + room, ids[room:], n))
                        ids = ids[:room]
                    window.append((doc, start, ids, n))
                    room -= len(ids)
                self._close(window)
                left -= size

    def rows(self) -> pa.RecordBatch:
        out, self.out = self.out, []
        names = [x.split()[0] for x in SCHEMA.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], pa.int64()) for k in range(len(names))], names)


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, max_open: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Every id of every document lies in one piece; a null or empty text has the
    end id alone. Sequences hold ``capacity`` ids, but for a few of a power of
    two at the end of each partition. Repeated documents are packed each on its
    own. sequence_id is unique, not gapless: the partition's number and a count.
    With ``max_open`` a partition closes its windows whenever more are open. An
    empty table gives no rows; null ids keep theirs.
    """
    path = path or tokenizer_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = WordTokenizer(path)
        packer = Packer(capacity, TaskContext.get().partitionId() << 36, max_open)
        for batch in slices(batches, most=16 << 20):
            names = batch.column(0).to_pylist()
            for first, starts, ids in encode(batch.column(1)):
                for k in range(len(starts) - 1):
                    packer.add(names[first + k], ids[starts[k] : starts[k + 1]])
            yield packer.rows()
        packer.flush()
        yield packer.rows()

    return id_text(docs, id_col, text_col).mapInArrow(run, SCHEMA)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
