"""Encoding of texts with a public byte-level BPE vocabulary, as a reduction of a tree."""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trendloom.session import spread

#: Where the vocabulary files lie; a parameter, never part of this repository.
TOKENIZERS = "/opt/tokenizers"
# Fixed value: how the vocabulary's texts are cut before merging (the published pattern).
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Places where a piece of the pattern ends whatever stands around: before white space after another character (no piece
#: holds white space after one), between letters and digits, and between one of these and a sign (signs before letters are
#: no cut, as an apostrophe goes with some). Only characters that all versions of Unicode class alike are looked at.
_CUT = re.compile(r"(?<=\S)(?=[ \t\r\n])|(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])|(?<=[A-Za-z0-9])(?=[!-/:-@\[-`{-~])")
#: Runs inside a piece: letters (of blocks that hold nothing else), digits, signs but the apostrophe, white space.
_RUNS = [re.compile(f"[{x}]*") for x in ("A-Za-zÀ-ÖØ-öø-ɏЁА-яё\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fa5\uac00-\ud7a3", "0-9", r"!-&(-/:-@\[-`{-~", r" \t\r\n")]
#: Long runs of white space, which the pattern's library can't take at once.
_LONG_BLANKS = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{1000,}")
#: Bytes at the ends of a run that may belong to another piece: a contraction, the last blank before a word.
_MARGIN = 16


class BytePairs:
    """A vocabulary, and texts as values of a monoid: `node(a + b) == join(node(a), node(b))`.

    A node is a text with its ids. Two are joined by re-encoding a window around their
    boundary, until all ids outside it provably are those of the whole text:

    - The window ends at cuts, places where a piece of the pattern ends whatever stands around.
      While a side has none near, the window grows.
    - Inside a long piece (a run of letters, digits or signs) it ends at tokens and doubles until
      the pairs at both of its ends are stable: two neighbours are what their own bytes are encoded
      as. A sequence all of whose neighbours are stable is the encoding of its bytes, since merges
      go by rank: the first merge that differed would change some pair of neighbours by itself.
    """

    def __init__(self, ranks_file: str, leaf_chars: int = 256, window_chars: int = 16) -> None:
        import tiktoken

        with open(ranks_file, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding(os.path.basename(ranks_file), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.token_bytes = {i: t for t, i in ranks.items()}
        self.lengths = {i: len(t) for t, i in ranks.items()}
        self.leaf_chars, self.window_chars = leaf_chars, window_chars
        self.joins = self.widest = 0

    def leaf(self, text: str) -> list[int]:
        if len(text) < 1_000:
            return self.encoding.encode_ordinary(text)
        out, done = [], 0
        for m in _LONG_BLANKS.finditer(text):
            i, j = m.span()
            j -= j < len(text)  # the last blank belongs to what follows
            out += self.encoding.encode_ordinary(text[done:i]) + self._piece(text[i:j].encode())
            done = j
        return out + self.encoding.encode_ordinary(text[done:])

    def join(self, left: str, a: list[int], right: str, b: list[int]) -> list[int]:
        """Ids of left + right from those of both; the list `a` becomes the result."""
        if not left or not right:
            return b if not left else a
        self.joins += 1
        i, j = self._cut_back(left), self._cut_ahead(right)
        head, tail = left[i:], right[:j]
        if len(head) + len(tail) > 256:
            made = self._join_inside(head, a, tail, b)
            if made is not None:
                return made
        self.widest = max(self.widest, len(head) + len(tail))
        # tokens of a side before its cut, and after it, end at the cut: count them by their bytes
        kept, dropped, lengths = len(a), 0, self.lengths
        size = len(head.encode())
        while size > 0:
            kept -= 1
            size -= lengths[a[kept]]
        size = len(tail.encode())
        while size > 0:
            size -= lengths[b[dropped]]
            dropped += 1
        del a[kept:]
        a += self.leaf(head + tail)
        a += islice(b, dropped, None)
        return a

    def _cut_back(self, text: str) -> int:
        """The last cut, looked for in growing windows from the end, 0 if there is none."""
        size = self.window_chars
        while True:
            low = max(0, len(text) - size)
            last = 0
            for m in _CUT.finditer(text, low):
                last = m.start()
            if last or not low:
                return last
            size *= 2

    def _cut_ahead(self, text: str) -> int:
        m = _CUT.search(text)
        return m.start() if m else len(text)

    def _join_inside(self, head: str, a: list[int], tail: str, b: list[int]) -> list[int] | None:
        """The join inside a piece that reaches far into both sides; None where the window would leave the piece."""
        mirrored = head[::-1]
        for run in _RUNS:
            before, after = run.match(mirrored)[0], run.match(tail)[0]
            if before and after:
                break
        else:
            return None
        left_room, right_room = len(before.encode()) - _MARGIN, len(after.encode()) - _MARGIN
        size = 4
        while size < len(a) and size < len(b):
            # one more token on either side must lie in the run
            if sum(self.lengths[x] for x in a[-size - 1 :]) > left_room or sum(self.lengths[x] for x in b[: size + 1]) > right_room:
                return None
            window = b"".join(map(self.token_bytes.__getitem__, a[-size:] + b[:size]))
            made = self._piece(window)
            self.widest = max(self.widest, len(window))
            if self._stable(a[-size - 1], made[0]) and self._stable(made[-1], b[size]):
                del a[-size:]
                a += made
                a += islice(b, size, None)
                return a
            size *= 2
        return None

    def _piece(self, piece: bytes) -> list[int]:
        return self.encoding._encode_single_piece(piece)

    def _stable(self, x: int, y: int) -> bool:
        return self._piece(self.token_bytes[x] + self.token_bytes[y]) == [x, y]

    def encode(self, text: str) -> list[int]:
        """Ids of a text of any length: halves are encoded recursively and joined."""
        if len(text) <= self.leaf_chars:
            return self.leaf(text)
        half = len(text) // 2
        left, right = text[:half], text[half:]
        return self.join(left, self.encode(left), right, self.encode(right))

    def decode(self, ids: list[int]) -> str:
        """The text of ids: bytes of the halves, concatenated up the tree."""
        return self._bytes(list(ids)).decode("utf-8")

    def _bytes(self, ids: list[int]) -> bytes:
        if len(ids) <= self.leaf_chars:
            return self.encoding.decode_bytes(ids)
        half = len(ids) // 2
        return self._bytes(ids[:half]) + self._bytes(ids[half:])


_LOADED: dict[tuple, BytePairs] = {}


def _loaded(*key: object) -> BytePairs:
    """One vocabulary per Python worker."""
    if key not in _LOADED:
        _LOADED[key] = BytePairs(*key)
    return _LOADED[key]


def encode_texts(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", vocabulary: str = "byte_bpe_50k", folder: str = TOKENIZERS, leaf_chars: int = 256) -> DataFrame:
    """(doc_id, ids) of every row: the ids of its text, without special tokens.

    A null or empty text gives an empty list; blank text is encoded as it is; strings that
    spell special tokens are ordinary text. Method: monoid tree reduction (`BytePairs`); a
    text of up to `leaf_chars` characters is a leaf. Rows are independent: nothing is shuffled
    unless the scan has fewer partitions than there are cores.
    """
    path = f"{folder}/{vocabulary}.tiktoken"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = _loaded(path, leaf_chars)
        for b in batches:
            ids = [np.array(pairs.encode(t), np.int64) if t else _NONE for t in b["text"].to_pylist()]
            ends = np.cumsum([len(x) for x in ids])
            offsets = pa.array(np.concatenate([[0], ends]).astype(np.int32))
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(ids) if ids else _NONE))], ["doc_id", "ids"])

    return spread(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))).mapInArrow(run, "doc_id bigint, ids array<bigint>")


def decode_ids(encoded: DataFrame, *, doc_id: str = "doc_id", ids: str = "ids", vocabulary: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """(doc_id, text) of lists of ids; an empty or null list gives an empty text."""
    path = f"{folder}/{vocabulary}.tiktoken"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = _loaded(path)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array([pairs.decode(x or []) for x in b["ids"].to_pylist()], pa.string())], ["doc_id", "text"])

    return encoded.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(ids).alias("ids")).mapInArrow(run, "doc_id bigint, text string")


_NONE = np.empty(0, np.int64)
