"""Byte-level BPE ids of whole texts with a public vocabulary.

A text is cut into parts of `part_chars` characters wherever these end.  The
parts are encoded on their own, as texts, and then joined as a tree of halves:
around each cut a window is encoded anew, and it grows until both sides agree
with it exactly.  The parts of a text above `spread_chars` are encoded in
different tasks, those of a shorter one in the task that has it.

The result is exactly that of encoding the whole text:

* A window begins and ends at an anchor: a position between two ASCII characters
  where every run of the splitting pattern splits, whatever is around.  Up to the
  first anchor the left half's ids stand, from the second one those of the right.
* If one unsplit piece reaches across the cut, its halves' tokens are joined: a
  window of tokens grows until its encoding begins with a token of the left half
  and ends with one of the right half.  A BPE encoding is right if each pair of
  neighbours is.

Defined results.  Null and empty texts give an empty list.  Nothing is trimmed
or normalised, strings that look like special tokens are ordinary text.  Each
row of the input gives one row; repeated ids give repeated rows, those of long
texts too.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arbordelta.sources.spread import spread

#: Fixed value: the pattern that belongs to the vocabulary, with \s spelt as the property it stands for.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Letters, digits, marks and spaces of ASCII: no piece goes on from one kind to another, but from a space, or from an apostrophe to a letter.
ANCHOR = r"(?<=[A-Za-z])(?=[\t\n\r -@\[-`{-~])|(?<=[0-9])(?=[\t\n\r -/:-~])|(?<=[!-&(-/:-@\[-`{-~])(?=[\t\n\r 0-9A-Za-z])|(?<=')(?=[\t\n\r 0-9])"
BYTE_BPE_50K = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PART_CHARS = 1024
SPREAD_CHARS = 4096
PIECE_BYTES = 1 << 16


class Encoder:
    def __init__(self, path: str):
        import regex
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.bpe = tiktoken.Encoding("given", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
        self.unsplit = tiktoken.Encoding("unsplit", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})
        self.lengths = np.zeros(max(ranks.values()) + 1, np.int64)
        self.bytes_of: list[bytes] = [b""] * len(self.lengths)
        for token, i in ranks.items():
            self.lengths[i] = len(token)
            self.bytes_of[i] = token
        self.split = regex.compile(SPLIT.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))
        self.anchor, self.anchor_before = regex.compile(ANCHOR), regex.compile(f"(?r){ANCHOR}")

    def text(self, text: str) -> np.ndarray:
        return self.bpe.encode_to_numpy(text, disallowed_special=()).astype(np.int32, copy=False)

    def piece(self, piece: str, leaf: int = PIECE_BYTES) -> list[int]:
        """Ids of one unsplit piece."""
        if len(piece) <= max(leaf // 4, 1):
            return self.unsplit.encode(piece, disallowed_special=())
        cut = len(piece) // 2
        return self.join_tokens(self.piece(piece[:cut], leaf), self.piece(piece[cut:], leaf))

    def join_tokens(self, left: list[int], right: list[int], window: int = 4) -> list[int]:
        """Ids of the piece whose halves have these ids."""
        while True:
            a, b = left[-window:], right[:window]
            whole_left, whole_right = window >= len(left), window >= len(right)
            try:  # a window is whole characters
                text = b"".join(self.bytes_of[i] for i in [*a, *b]).decode()
            except UnicodeDecodeError:
                window *= 2
                continue
            new = self.unsplit.encode(text, disallowed_special=())
            if (whole_left or new[0] == a[0]) and (whole_right or new[-1] == b[-1]):
                return [*([] if whole_left else left[:-window]), *new, *right[window:]]
            window *= 2


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


class Part:
    """A text with its ids."""

    def __init__(self, text: str, ids: np.ndarray):
        self.text, self.ids = text, ids

    @classmethod
    def encoded(cls, enc: Encoder, text: str) -> Part:
        return cls(text, enc.text(text))


def _tokens(enc: Encoder, ids: np.ndarray, n_bytes: int, at_once: int = 64) -> int:
    """How many of the first ids cover n_bytes."""
    covered = 0
    for at in range(0, len(ids) + 1, at_once):
        sums = covered + np.cumsum(enc.lengths[ids[at:at + at_once]])
        if not n_bytes > (sums[-1] if len(sums) else covered):
            return at + (int(np.searchsorted(sums, n_bytes)) + 1 if n_bytes > covered else 0)
        covered = int(sums[-1])
    raise AssertionError("fewer bytes than asked for")


def _window(enc: Encoder, a: str, b: str, window: int) -> tuple[int, int]:
    """(begin in a, end in b): the anchors next to the cut, found in windows that grow; the ends of the texts if there are none."""
    w = window
    while (m := enc.anchor_before.search(a, max(1, len(a) - w))) is None and w < len(a):
        w *= 2
    begin, w = (m.start() if m else 0), window
    while (m := enc.anchor.search(b, 1, w)) is None and w < len(b):
        w *= 2
    return begin, m.start() if m else len(b)


def join_parts(enc: Encoder, a: Part, b: Part, window: int = 32) -> Part:
    """Part.encoded(a.text + b.text), from both parts' own encodings."""
    if not a.text or not b.text:
        return b if not a.text else a
    begin, end = _window(enc, a.text, b.text, window)
    left, right = a.text[begin:], b.text[:end]
    keep = len(a.ids) - _tokens(enc, a.ids[::-1], len(left.encode()))
    skip = _tokens(enc, b.ids, len(right.encode()))
    if len(left) + len(right) <= PIECE_BYTES // 4:
        middle = enc.text(left + right)
    else:  # long without an anchor: pieces of their own, the one across the cut joined from the halves
        middle = _long_middle(enc, left, right, a.ids[keep:], b.ids[:skip])
    return Part(a.text + b.text, np.concatenate([a.ids[:keep], np.asarray(middle, np.int32), b.ids[skip:]]))


def _long_middle(enc: Encoder, left: str, right: str, left_ids: np.ndarray, right_ids: np.ndarray) -> list[int]:
    last = max(m.start() for m in enc.split.finditer(left))
    first = enc.split.match(right).end()
    out: list[int] = []
    for m in enc.split.finditer(left + right):
        s, e = m.span()
        if s == last and e == len(left) + first:  # halves of one piece, which both sides have encoded as pieces
            tail = len(left_ids) - _tokens(enc, left_ids[::-1], len(left[last:].encode()))
            out += enc.join_tokens(left_ids[tail:].tolist(), right_ids[: _tokens(enc, right_ids, len(right[:first].encode()))].tolist())
        else:
            out += enc.piece(m.group())
    return out


def join_tree(enc: Encoder, parts: list[Part]) -> Part:
    while len(parts) > 1:
        parts = [join_parts(enc, *parts[i:i + 2]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
    return parts[0]


def cut_text(text: str, part_chars: int) -> list[str]:
    """Equal halves of halves, none above part_chars."""
    n = 1
    while -(-len(text) // n) > part_chars:
        n *= 2
    bounds = [len(text) * k // n for k in range(n + 1)]
    return [text[a:b] for a, b in zip(bounds, bounds[1:])]


def encode_tree(enc: Encoder, text: str, part_chars: int) -> np.ndarray:
    return join_tree(enc, [Part.encoded(enc, t) for t in cut_text(text, part_chars)]).ids


def _lists(arrays: list[np.ndarray], dtype) -> pa.ListArray:
    offsets = np.zeros(len(arrays) + 1, np.int32)
    np.cumsum([len(x) for x in arrays], out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.zeros(0, dtype), *arrays])))


#: Rows and bytes of text that one batch to the JVM holds at most (a single text may exceed them).
OUT_ROWS, OUT_CHARS = 1024, 4 << 20


def token_ids(documents: DataFrame, path: str = BYTE_BPE_50K, spread_chars: int = SPREAD_CHARS, part_chars: int = PART_CHARS) -> DataFrame:
    """(doc_id, ids) of each row."""
    docs = documents.select("doc_id", "text")
    kind = docs.schema["doc_id"].dataType.simpleString()

    def here(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            at, size, ids = 0, 0, []
            for text in batch.column(1):
                t = text.as_py()
                ids.append(encode_tree(enc, t, part_chars) if t else np.zeros(0, np.int32))
                size += len(t or "")
                if len(ids) >= OUT_ROWS or size >= OUT_CHARS:
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(ids)), _lists(ids, np.int32)], ["doc_id", "ids"])
                    at, size, ids = at + len(ids), 0, []
            if ids:
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(ids)), _lists(ids, np.int32)], ["doc_id", "ids"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, key, text in zip(batch.column(0), batch.column(2).to_pylist(), batch.column(1)):
                for seq, part in enumerate(cut_text(text.as_py(), spread_chars // 2)):
                    yield pa.RecordBatch.from_arrays([pa.array([doc.as_py()], doc.type), pa.array([key], pa.string()), pa.array([seq], pa.int64()), pa.array([part], pa.string())], ["doc_id", "key", "seq", "part"])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                yield pa.RecordBatch.from_arrays([*row.columns, _lists([encode_tree(enc, row.column(3)[0].as_py(), part_chars)], np.int32)], ["doc_id", "key", "seq", "part", "ids"])

    def join(group: pa.Table) -> pa.Table:
        enc = encoder(path)
        group = group.sort_by("seq")
        seq = np.asarray(group["seq"])
        times = int((seq == 0).sum())  # equal rows of the input have equal parts
        parts = [Part(group["part"][i].as_py(), np.asarray(group["ids"][i].values, np.int32)) for i in range(0, len(seq), times)]
        done = join_tree(enc, parts)
        return pa.Table.from_arrays([group["doc_id"].slice(0, times), _lists([done.ids] * times, np.int32)], ["doc_id", "ids"])

    is_long = F.coalesce(F.length("text") > spread_chars, F.lit(False))
    near = spread(docs.where(~is_long)).mapInArrow(here, f"doc_id {kind}, ids array<int>")
    # The key follows from the row alone, so a task that is run again gives the same one.
    keyed = docs.where(is_long).withColumn("key", F.concat_ws("-", F.sha2("text", 256), F.col("doc_id")))
    parts = keyed.mapInArrow(cut, f"doc_id {kind}, key string, seq long, part string").repartition("key", "seq")
    coded = parts.mapInArrow(encode, f"doc_id {kind}, key string, seq long, part string, ids array<int>")
    return near.unionByName(coded.groupBy("key").applyInArrow(join, f"doc_id {kind}, ids array<int>"))
