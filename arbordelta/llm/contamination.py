"""Test items that occur in documents, found in FM-indexes of the documents.

Both sides are reduced to ASCII letters and digits in lower case.  Each task
builds an FM-index of its documents, shard by shard, and searches it backwards
for the items' phrases: blocks of half the shortest match, side by side, one of
which lies in any match.  Occurrences are located by sampled suffix positions.
Each lies in a few stretches of the shortest match; those are looked up among
the items' own, by hash, and compared symbol by symbol.  As each position of a
shard begins one stretch, what is looked up never exceeds the shard, however
often a phrase occurs on either side.  Neighbouring stretches of one document
are merged into spans to remove.

The items are the query set.  They are cut into blocks of at most `block_bytes`,
in overlapping sections where an item is longer, and each block is a file that
executors fetch; a task builds a shard's index once and then reads one block
after the other, so what it holds doesn't grow with the items.  Documents aren't
shuffled, only cases are.

Defined results.  Null, empty and short texts, reduced to fewer characters than
the shortest match, have no cases.  Repeated items count each.  A long text is
cut into overlapping sections, which lose no match.  Repeated rows of a document
give its cases once.
"""

from __future__ import annotations

import pickle
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from arbordelta.llm.fm_index import MAX_SYMBOLS, FMIndex
from arbordelta.sources.scratch import put_file
from arbordelta.sources.spread import spread

MIN_CHARS = 60
BLOCK_BYTES = 1 << 20
SHARD_SYMBOLS = 1 << 20
#: Occurrences or cases, and stretches, worked on at once.
AT_ONCE = 1 << 16
STRETCHES = 1 << 14

_CODES = np.zeros(256, np.uint8)
for _k, _c in enumerate("abcdefghijklmnopqrstuvwxyz0123456789"):
    _CODES[ord(_c)] = _CODES[ord(_c.upper())] = _k + 1


def reduced(text: str | None) -> np.ndarray:
    codes = _CODES[np.frombuffer((text or "").encode(), np.uint8)]
    return codes[codes > 0]


@dataclass
class Phrases:
    """A block of items: their phrases, and their stretches of the shortest match, distinct, in order of hash."""

    ids: list[list]  # of the items with one text
    text: np.ndarray
    phrases: np.ndarray
    hashes: np.ndarray
    place: np.ndarray  # where in text each distinct stretch stands
    first_item: np.ndarray
    items: np.ndarray  # by stretch, the texts that have it
    base: int


def _hashes(rows: np.ndarray, base: int) -> np.ndarray:
    powers = np.cumprod(np.full(rows.shape[1], base, np.uint64), dtype=np.uint64)
    x = ((rows.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) ^ (rows.astype(np.uint64) << np.uint64(40))) @ powers
    return x ^ (x >> np.uint64(29))


def _stretches(text: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    return np.lib.stride_tricks.sliding_window_view(text, n)[starts]


def phrases_of(items: list[tuple], min_chars: int) -> Phrases | None:
    """items: (id, codes)."""
    block = (min_chars + 1) // 2
    by_text: dict[bytes, list] = {}
    for item, codes in items:
        if len(codes) >= min_chars:
            by_text.setdefault(codes.tobytes(), []).append(item)
    if not by_text:
        return None
    text = np.frombuffer(b"".join(by_text), np.uint8)
    n = np.array([len(t) for t in by_text])
    begin = np.cumsum(n) - n
    phrases = np.unique(_stretches(text, _runs_of(begin, (n - block) // block + 1, block), block), axis=0)
    starts = _runs_of(begin, n - min_chars + 1)
    owner = np.repeat(np.arange(len(n)), n - min_chars + 1)
    base = 0xD1342543DE82EF95
    while True:
        key = np.concatenate([_hashes(_stretches(text, starts[i:i + STRETCHES], min_chars), base) for i in range(0, len(starts), STRETCHES)])
        order = np.lexsort((owner, key))
        key, at, who = key[order], starts[order], owner[order]
        new = np.append(True, key[1:] != key[:-1])
        first = at[np.flatnonzero(new)[np.cumsum(new) - 1]]
        if all(_same(text, at[i:i + STRETCHES], text, first[i:i + STRETCHES], min_chars).all() for i in range(0, len(at), STRETCHES)):
            break
        base += 2  # two stretches had one hash
    place, group = at[new], np.cumsum(new) - 1
    once = new | np.append(True, who[1:] != who[:-1])
    return Phrases(list(by_text.values()), text, phrases, key[new], place, np.append(np.flatnonzero(new[once]), once.sum()), who[once].astype(np.int32), base)


def _runs_of(starts: np.ndarray, counts: np.ndarray, step: int = 1) -> np.ndarray:
    """starts[0], starts[0] + step, ... counts[0] of them, then the same for the next."""
    before = np.cumsum(counts) - counts
    return np.repeat(starts, counts) + step * (np.arange(int(counts.sum())) - np.repeat(before, counts))


def _same(a: np.ndarray, at: np.ndarray, b: np.ndarray, bt: np.ndarray, n: int) -> np.ndarray:
    return (_stretches(a, at, n) == _stretches(b, bt, n)).all(axis=1)


def search_shard(index: FMIndex, codes: np.ndarray, want: Phrases, min_chars: int) -> tuple[np.ndarray, np.ndarray]:
    """(start, stretch) of each position of the shard at which one of the items' stretches begins, ascending."""
    block = want.phrases.shape[1]
    _, low, high = index.search(want.phrases)
    n_rows = high - low
    ends = np.cumsum(n_rows)
    # Begins of stretches in which a phrase occurs: changes of how many occurrences reach there.
    near = np.zeros(len(codes) + 1, np.int32)
    for a in range(0, int(n_rows.sum()), AT_ONCE):
        b = min(a + AT_ONCE, int(ends[-1]))
        k = np.searchsorted(ends, np.arange(a, b), "right")
        at = index.locate(low[k] + np.arange(a, b) - (ends[k] - n_rows[k]))
        np.add.at(near, np.maximum(at + block - min_chars, 0), 1)
        np.add.at(near, at + 1, -1)
    starts = np.flatnonzero(np.cumsum(near)[: max(0, len(codes) - min_chars + 1)] > 0)
    found = [np.zeros((2, 0), np.int64)]
    for a in range(0, len(starts), STRETCHES):
        at = starts[a:a + STRETCHES]
        key = _hashes(_stretches(codes, at, min_chars), want.base)
        k = np.minimum(np.searchsorted(want.hashes, key), len(want.hashes) - 1)
        hit = want.hashes[k] == key
        at, k = at[hit], k[hit]
        same = _same(codes, at, want.text, want.place[k], min_chars)
        found.append(np.stack([at[same], k[same]]))
    return tuple(np.concatenate(found, axis=1))


def _shards(batches: Iterator[pa.RecordBatch], min_chars: int, limit: int) -> Iterator[tuple[np.ndarray, np.ndarray, list]]:
    """(codes, starts, texts): texts are (doc_id, text, symbols before this section)."""
    parts, texts, starts, size = [], [], [], 0
    for batch in batches:
        docs, col = batch.column(0), batch.column(1).cast(pa.large_string())
        offsets = np.frombuffer(col.buffers()[1], np.int64)[col.offset:col.offset + len(col) + 1]
        data = np.frombuffer(col.buffers()[2] or b"", np.uint8)
        valid = np.asarray(col.is_valid())
        for i in np.flatnonzero(valid & (np.diff(offsets) >= min_chars)).tolist():
            codes = _CODES[data[offsets[i]:offsets[i + 1]]]
            codes = codes[codes > 0]
            for at in range(0, max(1, len(codes) - min_chars + 1), limit - min_chars):
                section = codes[at:at + limit - 1]
                if len(section) < min_chars:
                    continue
                if size and size + len(section) + 1 > limit:
                    yield np.concatenate(parts), np.array(starts), texts
                    parts, texts, starts, size = [], [], [], 0
                parts += [section, np.zeros(1, np.uint8)]
                texts.append((docs[i].as_py(), col[i], at))
                starts.append(size)
                size += len(section) + 1
    if size:
        yield np.concatenate(parts), np.array(starts), texts


def _original(text: str, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Character positions of stretches of the reduced text."""
    data = np.frombuffer(text.encode(), np.uint8)
    char = np.cumsum((data & 0xC0) != 0x80) - 1
    kept = np.flatnonzero(_CODES[data])
    return char[kept[starts]], char[kept[ends - 1]] + 1


def _item_blocks(benchmark: DataFrame, min_chars: int, block_bytes: int) -> Iterator[Phrases]:
    """Blocks of sections of items; one is held at a time."""
    held, size = [], 0
    room = max(block_bytes, 2 * min_chars)
    for item, text in benchmark.where(F.col("text").isNotNull()).select("item_id", "text").toLocalIterator():
        codes = reduced(text)
        for at in range(0, max(1, len(codes) - min_chars + 1), room - min_chars + 1):
            section = codes[at:at + room]
            if held and size + len(section) > room:
                yield phrases_of(held, min_chars)
                held, size = [], 0
            held.append((item, section))
            size += len(section)
    yield phrases_of(held, min_chars)


@lru_cache(maxsize=1)
def _block(name: str) -> Phrases:
    with open(SparkFiles.get(name), "rb") as f:
        return pickle.load(f)


def _search(documents: DataFrame, benchmark: DataFrame, emit, schema: str, min_chars: int, block_bytes: int, shard_symbols: int) -> DataFrame:
    limit = min(shard_symbols, MAX_SYMBOLS)
    if limit <= 2 * min_chars:
        raise ValueError("a shard must hold more than two matches")
    spark = documents.sparkSession
    names = []
    for want in _item_blocks(benchmark, min_chars, block_bytes):
        if want is not None:
            names.append(f"items-{uuid.uuid4().hex}")
            spark.sparkContext.addFile(put_file(spark, names[-1], pickle.dumps(want)))
    if not names:
        return spark.createDataFrame([], schema)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for codes, starts, texts in _shards(batches, min_chars, limit):
            index = FMIndex(codes)
            for name in names:
                want = _block(name)
                at, stretch = search_shard(index, codes, want, min_chars)
                if len(at):
                    yield from emit(want, starts, texts, np.searchsorted(starts, at, "right") - 1, at, stretch)

    return spread(documents.select("doc_id", "text")).mapInArrow(task, schema)


def leaked_items(documents: DataFrame, benchmark: DataFrame, min_chars: int = MIN_CHARS, block_bytes: int = BLOCK_BYTES, shard_symbols: int = SHARD_SYMBOLS) -> DataFrame:
    """(doc_id, item_id), distinct."""
    fields = documents.select("doc_id").schema.fields + benchmark.select("item_id").schema.fields
    doc_type, item_type = (f.dataType.simpleString() for f in fields)

    def emit(want, starts, texts, section, at, stretch):
        pairs = np.unique(np.stack([section, stretch]), axis=1)
        n = want.first_item[pairs[1] + 1] - want.first_item[pairs[1]]
        seen = np.zeros(0, np.int64)
        bounds = np.searchsorted(np.cumsum(n), np.arange(AT_ONCE, int(n.sum()) + AT_ONCE, AT_ONCE))
        for a, b in zip([0, *(bounds + 1).tolist()], [*(bounds + 1).tolist(), len(n)]):
            who = want.items[_runs_of(want.first_item[pairs[1, a:b]], n[a:b])].astype(np.int64)
            new = np.setdiff1d(np.repeat(pairs[0, a:b], n[a:b]) * len(want.ids) + who, seen)
            seen = np.union1d(seen, new)
            rows = [(texts[d][0], i) for d, k in zip((new // len(want.ids)).tolist(), (new % len(want.ids)).tolist()) for i in want.ids[k]]
            for c in range(0, len(rows), AT_ONCE):
                docs, items = zip(*rows[c:c + AT_ONCE])
                yield pa.RecordBatch.from_pydict({"doc_id": docs, "item_id": items})

    return _search(documents, benchmark, emit, f"doc_id {doc_type}, item_id {item_type}", min_chars, block_bytes, shard_symbols).distinct()


def removal_spans(documents: DataFrame, benchmark: DataFrame, min_chars: int = MIN_CHARS, block_bytes: int = BLOCK_BYTES, shard_symbols: int = SHARD_SYMBOLS) -> DataFrame:
    """(doc_id, from_char, to_char): merged stretches of a document that items share, in its characters."""
    doc_type = documents.select("doc_id").schema["doc_id"].dataType.simpleString()

    def emit(want, starts, texts, section, at, stretch):
        for d, first, n in zip(*np.unique(section, return_index=True, return_counts=True)):
            doc, text, before = texts[d]
            mine = at[first:first + n]  # ascending, and so are the sections
            head = np.append(True, mine[1:] > mine[:-1] + min_chars)
            a, b = _original(text.as_py(), mine[head] - starts[d] + before, mine[np.append(head[1:], True)] + min_chars - starts[d] + before)
            yield pa.RecordBatch.from_arrays([pa.array([doc] * len(a)), pa.array(a.astype(np.int64)), pa.array(b.astype(np.int64))], ["doc_id", "from_char", "to_char"])

    spans = _search(documents, benchmark, emit, f"doc_id {doc_type}, from_char long, to_char long", min_chars, block_bytes, shard_symbols)
    # Spans of one document from two sections or item blocks may overlap still; there are few.
    order = Window.partitionBy("doc_id").orderBy("from_char", "to_char")
    reached = F.max("to_char").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = spans.distinct().withColumn("_new", F.when(reached.isNull() | (F.col("from_char") > reached), 1).otherwise(0))
    return marked.withColumn("_run", F.sum("_new").over(order)).groupBy("doc_id", "_run").agg(F.min("from_char").alias("from_char"), F.max("to_char").alias("to_char")).drop("_run")
