"""Long exact spans that several documents share.

The unit is the passage: any `span` consecutive characters of a text.  Its
MinHash is the least hash of its `gram`-character shingles.  Equal passages have
equal MinHashes, so one band of one row already has full recall, whatever the
offset; neighbouring passages mostly have the same one, and a maximal run of
such passages is a paragraph, cut by content and not by line ends.  Paragraphs
are what is shuffled, about 2 / (span - gram) of them per character.

1. Paragraphs collide if their MinHash is also found in another document.
2. Equal colliding paragraphs (a cryptographic hash of the whole text) are
   shared as they stand; their classes are folded by partial aggregation, so a
   licence in a third of all documents is one row per task.
3. One representative of each class of a MinHash with several classes is cut
   out of its text.  All passages of the representatives of one MinHash are
   put together by hash, and then compared character by character: the edit
   distance of what is linked is 0.  A MinHash with more classes than `block` is
   split over tasks, whose passages then meet by a cryptographic hash.
4. Shared stretches are merged per document; documents that share are
   clustered by components.  Of each passage the copy in the least document
   stays, the others are removals, reported with their document's cluster.

Banding: equal passages agree in every hash function, so any number of bands and
rows has recall 1 for what is asked for here; one band of one row is the least
that does.

Defined results.  Null, empty and short texts have no case.  A stretch repeated
only within one doc_id is none.  Characters are code points, unchanged.  Long
texts are worked on in sections, which lose no passage.  doc_id is integral.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from arbordelta.llm.components import components
from arbordelta.sources.scratch import written
from arbordelta.sources.spread import spread

SPAN = 300
GRAM = 150
#: Classes of one MinHash that one task compares.
BLOCK = 1 << 14
SECTION = 1 << 20
#: Paragraphs compared at once.
AT_ONCE = 1 << 14

_U = np.uint64
_BASE, _BASE2 = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(31))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(29))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(32))


@lru_cache(maxsize=4)
def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, _U)
    out[0] = 1
    return np.cumprod(out, dtype=_U)


class Rolling:
    """Hashes of substrings, equal wherever they begin."""

    def __init__(self, codes: np.ndarray, base: int = _BASE):
        size = 1 << max(12, int(len(codes)).bit_length())
        self.sums = np.zeros(len(codes) + 1, _U)
        np.cumsum(_mix(codes.astype(_U) + _U(base & 0xFFFF)) * _powers(base, size)[: len(codes)], dtype=_U, out=self.sums[1:])
        self.inverse = _powers(pow(base, -1, 1 << 64), size)

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return _mix((self.sums[ends] - self.sums[starts]) * self.inverse[starts] + (ends - starts).astype(_U))

    def grams(self, k: int) -> np.ndarray:
        n = len(self.sums) - k
        return _mix((self.sums[k:] - self.sums[:n]) * self.inverse[:n])


def _window_least(x: np.ndarray, w: int) -> np.ndarray:
    n = len(x)
    rows = np.full(-(-n // w) * w, np.iinfo(_U).max, _U)
    rows[:n] = x
    rows = rows.reshape(-1, w)
    up = np.minimum.accumulate(rows, axis=1).ravel()
    down = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(down[: n - w + 1], up[w - 1:n])


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def paragraphs_of(codes: np.ndarray, span: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(minhash, hash of the paragraph, first passage, passages) of a text of at least `span` characters.

    A run of passages with the same MinHash, as in a long run of one character, is cut
    after as many as can share one shingle; so no paragraph is longer than 2 * span - gram.
    """
    most = span - gram + 1
    least = _window_least(Rolling(codes).grams(gram), most)
    first = np.flatnonzero(np.append(True, least[1:] != least[:-1]))
    times = -(-np.diff(np.append(first, len(least))) // most)
    nth = np.arange(int(times.sum())) - np.repeat(np.cumsum(times) - times, times)
    first = np.repeat(first, times) + nth * most
    after = np.append(first[1:], len(least))
    return least[first].view(np.int64), _text_hashes(codes, first, after - 1 + span), first, after - first


def _text_hashes(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    data = memoryview(codes.tobytes())
    out = b"".join(blake2b(data[4 * a:4 * b], digest_size=8).digest() for a, b in zip(starts.tolist(), ends.tolist()))
    return np.frombuffer(out, np.int64)


def paragraphs(documents: DataFrame, span: int = SPAN, gram: int = GRAM, section: int = SECTION) -> DataFrame:
    """(doc_id, minhash, whole, first, passages)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = np.asarray(batch.column(0).cast(pa.int64()).fill_null(0))
            valid = np.asarray(batch.column(0).is_valid())
            out, rows = [], 0
            for doc, ok, text in zip(ids.tolist(), valid.tolist(), batch.column(1)):
                t = text.as_py()
                if not ok or not t or len(t) < span:
                    continue
                for at in range(0, len(t) - span + 1, section):
                    m, w, f, n = paragraphs_of(_codes(t[at:at + section + span - 1]), span, gram)
                    out.append((np.full(len(m), doc), m, w, f + at, n))
                    rows += len(m)
                if rows > 100_000:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out)], ["doc_id", "minhash", "whole", "first", "passages"])
                    out, rows = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out)], ["doc_id", "minhash", "whole", "first", "passages"])

    return spread(documents.select("doc_id", "text")).mapInArrow(cut, "doc_id long, minhash long, whole long, first long, passages long")


def _ranges(hit: np.ndarray, *keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index ranges [from, to) of runs of hits with the same keys."""
    padded = np.concatenate([[False], hit, [False]])
    turn = np.ones(len(hit) + 1, bool)
    turn[1:-1] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    begin = padded[1:-1] & (~padded[:-2] | turn[:-1])
    end = padded[1:-1] & (~padded[2:] | turn[1:])
    return np.flatnonzero(begin), np.flatnonzero(end) + 1


def _passages(batch: pa.RecordBatch | pa.Table, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(codes, row, offset, start) of all passages of representatives."""
    texts = [_codes(t) for t in batch["text"].to_pylist()]
    n = np.array([len(t) - span + 1 for t in texts], np.int64)
    base = np.concatenate([[0], np.cumsum(n + span - 1)[:-1]])
    row = np.repeat(np.arange(len(texts)), n)
    offset = np.arange(int(n.sum())) - np.repeat(np.concatenate([[0], np.cumsum(n)[:-1]]), n)
    return np.concatenate(texts), row, offset, base[row] + offset


def told_apart(codes: np.ndarray, start: np.ndarray, key: np.ndarray, span: int) -> np.ndarray:
    """key of ascending starts, changed where passages have one key and different texts.

    Each passage is compared with the first of its key; where both go on from
    passages that were compared, by the character that is new.
    """
    _, first, group = np.unique(key, return_index=True, return_inverse=True)
    ref = start[first[group]]
    goes_on = np.append(False, (start[1:] == start[:-1] + 1) & (ref[1:] == ref[:-1] + 1))
    equal = codes[start + span - 1] == codes[ref + span - 1]
    rows = np.lib.stride_tricks.sliding_window_view(codes, span)
    heads = np.flatnonzero(~goes_on)
    for a in range(0, len(heads), 1 << 12):
        h = heads[a:a + (1 << 12)]
        equal[h] = (rows[start[h]] == rows[ref[h]]).all(axis=1)
    if equal.all():
        return key
    key, names = key.copy(), {}
    taken = set(key.tolist())
    for i in np.flatnonzero(np.isin(group, group[~equal])).tolist():
        text = rows[start[i]].tobytes()
        if text not in names:
            names[text] = next(k for k in range(len(names), 1 << 62) if k not in taken)
            taken.add(names[text])
        key[i] = names[text]
    return key


def _compare(group: pa.Table, span: int) -> pa.RecordBatch:
    """Shared passages of representatives of whole MinHash groups: (minhash, whole, from_passage, to_passage, own_doc, with_doc)."""
    codes, row, offset, start = _passages(group, span)
    key = told_apart(codes, start, Rolling(codes, _BASE2).of(start, start + span), span)
    minhash, whole = np.asarray(group["minhash"])[row], np.asarray(group["whole"])[row]
    low, high = np.asarray(group["low_doc"])[row], np.asarray(group["high_doc"])[row]
    order = np.lexsort((key, minhash))
    head = np.concatenate([[True], (key[order][1:] != key[order][:-1]) | (minhash[order][1:] != minhash[order][:-1])])
    at = np.flatnonzero(head)
    times = np.diff(np.append(at, len(row)))
    least, most = np.empty(len(row), np.int64), np.empty(len(row), np.int64)
    least[order] = np.repeat(np.minimum.reduceat(low[order], at), times)
    most[order] = np.repeat(np.maximum.reduceat(high[order], at), times)
    other = np.where(low == least, most, least)
    a, b = _ranges(least < most, row, other)
    return pa.RecordBatch.from_arrays([pa.array(x) for x in (minhash[a], whole[a], offset[a], offset[b - 1] + 1, low[a], other[a])], _RESULT_NAMES)


_RESULT_NAMES = ["minhash", "whole", "from_passage", "to_passage", "own_doc", "with_doc"]


class Shared(NamedTuple):
    """stretches: (doc_id, from_char, to_char), not merged; links: (own_doc, with_doc) of documents that share a passage.

    Links connect all documents that share a passage, each to the least or greatest of them.
    removals: (doc_id, from_char, to_char), not merged, of what also stands in a lesser document.
    """

    stretches: DataFrame
    links: DataFrame
    removals: DataFrame


def find_shared(documents: DataFrame, span: int = SPAN, gram: int = GRAM, block: int = BLOCK, section: int = SECTION) -> Shared:
    every = written(paragraphs(documents, span, gram, section), "paragraphs")
    colliding = every.groupBy("minhash").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a < b").select("minhash")
    collisions = written(every.join(colliding, "minhash"), "collisions")
    classes = collisions.groupBy("minhash", "whole").agg(
        F.min("doc_id").alias("low_doc"), F.max("doc_id").alias("high_doc"), F.min(F.struct("doc_id", "first", "passages")).alias("rep"))
    several = classes.groupBy("minhash").agg(F.count(F.lit(1)).alias("classes")).where("classes > 1")
    named = classes.join(several, "minhash", "left")
    named = written(named.select("minhash", "whole", "low_doc", "high_doc", "rep.doc_id", "rep.first", "rep.passages", F.coalesce("classes", F.lit(1)).alias("classes")), "classes")

    wanted = named.where("classes > 1").groupBy("doc_id").agg(F.collect_list(F.struct("minhash", "whole", "low_doc", "high_doc", "first", "passages", "classes")).alias("want"))
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(F.length("text") >= span)
    fields = ["minhash", "whole", "low_doc", "high_doc", "classes"]

    def cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: dict[tuple, str] = {}
            for text, want in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for w in want:
                    part = text[w["first"]:w["first"] + w["passages"] - 1 + span]
                    codes = _codes(part)
                    # Rows that repeat a doc_id with another text don't have this paragraph there.
                    if len(part) == w["passages"] - 1 + span and int(_text_hashes(codes, np.array([0]), np.array([len(codes)]))[0]) == w["whole"]:
                        rows[tuple(w[f] for f in fields)] = part
            if rows:
                yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in zip(*rows)), pa.array(list(rows.values()), pa.string())], [*fields, "text"])

    reps = texts.join(wanted, "doc_id").select("text", "want").mapInArrow(cut_out, ", ".join(f"{f} long" for f in fields) + ", text string")
    reps = written(reps, "representatives")
    few = reps.where(F.col("classes") <= block).dropDuplicates(["minhash", "whole"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) < AT_ONCE:
                continue
            table = pa.Table.from_batches(held)
            last = table["minhash"][-1].as_py()
            whole = int(np.searchsorted(np.asarray(table["minhash"]), last))  # the last group may go on
            if whole:
                yield _compare(table.slice(0, whole), span)
            held = table.slice(whole).combine_chunks().to_batches()
        if held:
            yield _compare(pa.Table.from_batches(held), span)

    result = ", ".join(f"{n} long" for n in _RESULT_NAMES)
    in_task = few.repartition("minhash").sortWithinPartitions("minhash").mapInArrow(compare, result)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                codes, row, offset, start = _passages(part, span)
                key = _text_hashes(codes, start, start + span)
                names = ["minhash", "whole", "low_doc", "high_doc"]
                yield pa.RecordBatch.from_arrays([*(part[n].take(pa.array(row)) for n in names), pa.array(offset), pa.array(key)], [*names, "from_passage", "passage"])

    # The representatives of one of the many MinHashes with more classes than a task should hold.
    split = reps.where(F.col("classes") > block).mapInArrow(emit, "minhash long, whole long, low_doc long, high_doc long, from_passage long, passage long")
    met = split.groupBy("minhash", "passage").agg(F.min("low_doc").alias("a"), F.max("high_doc").alias("b")).where("a < b")
    other = F.when(F.col("low_doc") == F.col("a"), F.col("b")).otherwise(F.col("a"))
    across = split.join(met, ["minhash", "passage"]).select(
        "minhash", "whole", "from_passage", (F.col("from_passage") + 1).alias("to_passage"), F.col("low_doc").alias("own_doc"), other.alias("with_doc"))
    parts = written(in_task.unionByName(across), "parts")

    same_class = collisions.join(named.where("low_doc < high_doc").select("minhash", "whole", "low_doc"), ["minhash", "whole"])
    equal = same_class.select("doc_id", F.col("first").alias("from_char"), (F.col("first") + F.col("passages") - 1 + span).alias("to_char"))
    single = parts.join(named.where("low_doc = high_doc").select("minhash", "whole"), ["minhash", "whole"])
    alone = collisions.join(single, ["minhash", "whole"]).select(
        "doc_id", (F.col("first") + F.col("from_passage")).alias("from_char"), (F.col("first") + F.col("to_passage") - 1 + span).alias("to_char"))
    links = same_class.select(F.col("doc_id").alias("own_doc"), F.col("low_doc").alias("with_doc")).unionByName(parts.select("own_doc", "with_doc"))
    again = same_class.where(F.col("doc_id") > F.col("low_doc")).select("doc_id", F.col("first").alias("from_char"), (F.col("first") + F.col("passages") - 1 + span).alias("to_char"))
    lesser = parts.where(F.col("with_doc") < F.col("own_doc"))
    others = collisions.join(lesser, ["minhash", "whole"]).where(F.col("doc_id") == F.col("own_doc")).select(
        "doc_id", (F.col("first") + F.col("from_passage")).alias("from_char"), (F.col("first") + F.col("to_passage") - 1 + span).alias("to_char"))
    return Shared(equal.unionByName(alone), links, again.unionByName(others))


def shared_stretches(documents: DataFrame, *args, **settings) -> DataFrame:
    """(doc_id, from_char, to_char): stretches that occur in other documents, not merged."""
    return find_shared(documents, *args, **settings).stretches


def clusters(documents: DataFrame, *args, **settings) -> DataFrame:
    """(doc_id, cluster): documents that share a passage, directly or through others; cluster is the least doc_id."""
    return _clusters(find_shared(documents, *args, **settings).links)


def _clusters(links: DataFrame) -> DataFrame:
    return components(links, "own_doc", "with_doc").select(F.col("node").alias("doc_id"), F.col("component").alias("cluster"))


def cluster_removals(documents: DataFrame, *args, **settings) -> DataFrame:
    """(doc_id, cluster, from_char, to_char): merged stretches to remove, so that of each passage the copy in the least document of its cluster stays."""
    shared = find_shared(documents, *args, **settings)
    order = Window.partitionBy("doc_id").orderBy("from_char", "to_char")
    reached = F.max("to_char").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = shared.removals.distinct().withColumn("_new", F.when(F.col("from_char") <= reached, 0).otherwise(1))
    spans = marked.withColumn("_run", F.sum("_new").over(order)).groupBy("doc_id", "_run").agg(F.min("from_char").alias("from_char"), F.max("to_char").alias("to_char"))
    return spans.join(_clusters(shared.links), "doc_id").select("doc_id", "cluster", "from_char", "to_char")


def shared_characters(stretches: DataFrame) -> DataFrame:
    """(doc_id, shared_chars, spans): merged lengths per document."""
    order = Window.partitionBy("doc_id").orderBy("from_char", "to_char")
    reached = F.max("to_char").over(order.rowsBetween(Window.unboundedPreceding, -1))
    new = F.col("from_char") > F.coalesce(F.col("_reached"), F.lit(-1))
    fresh = F.greatest(F.lit(0), F.col("to_char") - F.greatest("from_char", F.coalesce("_reached", F.lit(0))))
    return (
        stretches.select("doc_id", "from_char", "to_char").distinct().withColumn("_reached", reached)
        .groupBy("doc_id").agg(F.sum(fresh).alias("shared_chars"), F.count(F.when(new, 1)).alias("spans"))
    )
