"""Removal of passages that repeat across documents, by level-wise doubling of repeated windows."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .kernels import U64, cover, mix, pieces, window_hashes, window_starts, word_hashes, word_spans
from .runtime import input_bytes, shuffle_partitions

#: The shortest window of the first level, in words.
BASE = 4

#: Bytes of the input's files that go into one block of documents.
BLOCK_BYTES = 4 << 20

#: Bytes of the input's files for each partition, of which there are the session's number at least.
PARTITION_BYTES = 64 << 20

_LAST = np.iinfo(np.int64).max

#: What a block sends at the last level: a window's hash, twice its tag, plus 1 if two documents of the block hold it, and the least id.
#: At the others: twice the block's number, plus 1 if two of its documents hold the anchor.
_FOUND = T.StructType([T.StructField("h", T.LongType()), T.StructField("mark", T.IntegerType()), T.StructField("lo", T.LongType())])
_SEEN = T.StructType([T.StructField("h", T.LongType()), T.StructField("code", T.LongType())])


def levels(window: int, base: int = BASE) -> list[int]:
    """Lengths from ``base`` on, each twice the one before, the last cut to ``window``."""
    out = [min(base, window)]
    while out[-1] < window:
        out.append(min(2 * out[-1], window))
    return out


def _running_min(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` consecutive values."""
    have = 1
    while have < width:
        step = min(have, width - have)
        values = np.minimum(values[: len(values) - step], values[step:])
        have += step
    return values


class _Block:
    """One block of documents: per piece its words and the windows that lie in one document."""

    def __init__(self, table: pa.Table, window: int):
        self.window = window
        self.ids = np.where(table.column("id").is_null().to_numpy(zero_copy_only=False), _LAST, table.column("id").fill_null(0).to_numpy())
        self.texts = table.column("text").combine_chunks() if table.num_rows else pa.array([], pa.string())

    def pieces(self):
        for first, end, data, offsets in pieces(self.texts):
            start, stop, bounds = word_spans(data, offsets)
            words = word_hashes(data, start, stop)
            at = window_starts(bounds, self.window)
            owner = self.ids[first:end][np.searchsorted(bounds, at, "right") - 1]
            yield first, end, data, start, stop, bounds, words, at, owner

    def anchors(self, words: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
        """For each window the least hash of the windows of ``length`` words in it."""
        if not len(at):
            return np.zeros(0, np.uint64)
        return _running_min(window_hashes(words, length), self.window - length + 1)[at]

    def tags(self, words: np.ndarray, at: np.ndarray) -> np.ndarray:
        """31 more bits of each window, from other values of its words than the hash's."""
        if not len(at):
            return np.zeros(0, np.int32)
        return (window_hashes(mix(words + U64(0x632BE59BD9B4E019)), self.window)[at] >> U64(33)).astype(np.int32)


def _among(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """The place of each value in the sorted ``known``, or -1."""
    if not len(known) or not len(values):
        return np.full(len(values), -1, np.int64)
    edge = np.flatnonzero(np.r_[True, values[1:] != values[:-1]])  # neighbouring windows mostly share their anchor
    place = np.searchsorted(known, values[edge])
    place[place == len(known)] = 0
    place = np.where(known[place] == values[edge], place, -1)
    return np.repeat(place, np.diff(np.r_[edge, len(values)]))


def _known(reply: pa.Table) -> np.ndarray:
    return np.sort(reply.column("h").to_numpy().view(np.uint64))


def _known_windows(reply: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    h = reply.column("h").to_numpy().view(np.uint64)
    order = np.argsort(h, kind="stable")
    return h[order], reply.column("tag").to_numpy()[order], reply.column("lo").to_numpy()[order]


def _places(values: np.ndarray, tags: np.ndarray, known: np.ndarray, known_tags: np.ndarray) -> np.ndarray:
    """The place of each value and tag in ``known`` (sorted by value alone), or -1."""
    place = _among(values, known)
    other = np.flatnonzero(place >= 0)
    other = other[known_tags[place[other]] != tags[other]]
    while len(other):  # windows that differ though their hashes agree
        place[other] += 1
        over = place[other] == len(known)
        over[~over] = known[place[other[~over]]] != values[other[~over]]
        place[other[over]] = -1
        other = other[~over]
        other = other[known_tags[place[other]] != tags[other]]
    return place


def _level(table: pa.Table, block: int, window: int, before: tuple[int, np.ndarray] | None, length: int) -> pa.Table:
    """The anchors of ``length`` words of the windows that are still candidates, each once (``_SEEN``, at the last level ``_FOUND``)."""
    docs = _Block(table, window)
    last = length == window
    hashes, owners, tags = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int32)]
    for _, _, _, _, _, _, words, at, owner in docs.pieces():
        if before is not None:
            alive = _among(docs.anchors(words, at, before[0]), before[1]) >= 0
            at, owner = at[alive], owner[alive]
        h = docs.anchors(words, at, length)
        if len(h):
            tag = docs.tags(words, at) if last else np.zeros(len(h), np.int32)
            edge = np.r_[True, (h[1:] != h[:-1]) | (owner[1:] != owner[:-1]) | (tag[1:] != tag[:-1])]
            hashes.append(h[edge])
            owners.append(owner[edge])
            tags.append(tag[edge])
    h, owner, tag = np.concatenate(hashes), np.concatenate(owners), np.concatenate(tags)
    order = np.argsort(h, kind="stable")
    h, owner, tag = h[order], owner[order], tag[order]
    first = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (tag[1:] != tag[:-1])]) if len(h) else np.zeros(0, np.int64)
    lo = np.minimum.reduceat(owner, first) if len(h) else owner
    hi = np.maximum.reduceat(owner, first) if len(h) else owner
    if last:
        order = np.argsort(lo, kind="stable")  # rows of one document side by side compress better
        mark = ((tag[first].view(np.uint32) << np.uint32(1)) | (lo < hi)).astype(np.uint32).view(np.int32)
        return pa.table({"h": h[first][order].view(np.int64), "mark": mark[order], "lo": lo[order]})
    return pa.table({"h": h[first].view(np.int64), "code": 2 * block + (lo < hi)})


def _cut(table: pa.Table, window: int, known: np.ndarray, known_tags: np.ndarray, least: np.ndarray) -> pa.Table:
    """Per document: id, number of words, spans removed, text kept."""
    docs = _Block(table, window)
    n_words, n_removed, spans, kept = [], [], [], []
    for first, end, data, start, stop, bounds, words, at, owner in docs.pieces():
        place = _places(docs.anchors(words, at, window), docs.tags(words, at), known, known_tags)
        gone = at[(place >= 0) & (least[place] < owner)] if len(known) else at[:0]
        removed = cover(len(start), gone, window)
        size = np.where(removed, 0, stop - start + 1)
        to = np.concatenate([[0], np.cumsum(size)])
        take = np.repeat(start - to[:-1], size) + np.arange(to[-1])
        out = data[np.minimum(take, len(data) - 1)] if len(data) else data
        out[to[1:][size > 0] - 1] = 32
        text = out.tobytes()
        total = np.concatenate([[0], np.cumsum(removed)])
        for k in range(end - first):
            a, b = bounds[k], bounds[k + 1]
            n_words.append(int(b - a))
            n_removed.append(int(total[b] - total[a]))
            kept.append(text[to[a] : max(to[a], to[b] - 1)].decode("utf-8", "replace"))
            if n_removed[-1]:
                edge = np.flatnonzero(np.diff(np.concatenate([[0], removed[a:b].view(np.int8), [0]])))
                spans.append(edge.tolist())
            else:
                spans.append([])
    return pa.table(
        {"id": table.column("id"), "n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()), "spans": pa.array(spans, pa.list_(pa.int64())), "kept_text": pa.array(kept, pa.string())}
    )


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = 13, base: int = BASE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Remove the words covered by a window that also starts in a document with a smaller id.

    A window is ``window`` consecutive words (runs of bytes other than ASCII
    white space, unchanged) of one document.  Windows are found level by
    level: at each length (``base``, then doubled, at last ``window``) every
    window that is still a candidate is represented by its anchor, the window
    of that length in it with the least hash; equal windows have equal anchors,
    and only windows whose anchor occurs in two documents are extended to the
    next length.  At the first level that is one anchor for about
    ``(window - base) / 2`` words instead of a row for each word, and texts
    that share nothing end there.  The last level compares the windows
    themselves by 95 bits, 64 of a hash and 31 of another.

    Documents are dealt once into blocks by a hash of their ids; all levels
    reuse that exchange.  Each block sends an anchor once, with its least and
    greatest id, so a passage that every document holds makes one row per
    block; the answer goes back to the blocks that asked.

    Returns one row per input row: ``id_col``, ``n_words``, ``n_removed``,
    ``spans`` (alternating first and end word of each removed run) and
    ``kept_text`` (kept words joined by one space).  Null text has no words.
    Rows that repeat an id are one document: they don't remove each other's
    words.  A null id is greater than all others.  Extra columns are ignored;
    an empty table gives an empty result.
    """
    spark = docs.sparkSession
    size = input_bytes(docs)
    parts = max(shuffle_partitions(spark), -(-size // PARTITION_BYTES))
    blocks = max(parts, -(-size // block_bytes))
    dealt = docs.select(
        F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"), F.pmod(F.xxhash64(F.col(id_col).cast("long")), F.lit(blocks)).alias("block")
    ).repartition(parts, "block")

    block_of = lambda c: F.pmod(F.xxhash64(c), F.lit(blocks))
    same = Window.partitionBy("h")

    def repeated(found: DataFrame) -> DataFrame:
        """Per block its anchors that two documents hold; a document is in one block only."""
        told = found.repartition(parts, "h").select("h", "code", F.count(F.lit(1)).over(same).alias("n"), F.max(F.col("code") % 2).over(same).alias("twice"))
        return told.filter("n > 1 OR twice = 1").select(F.shiftright("code", 1).alias("block"), "h")

    def removable(found: DataFrame) -> DataFrame:
        """Per block its windows that a smaller id than one of its own holds, with the least id."""
        told = found.repartition(parts, "h").select("h", F.shiftrightunsigned("mark", 1).alias("tag"), "lo", (F.col("mark") % 2 != 0).alias("several"))
        told = told.withColumn("least", F.min("lo").over(Window.partitionBy("h", "tag")))
        own = F.when(F.col("lo") == _LAST, F.lit(None)).otherwise(F.col("lo"))
        return told.filter("several OR least < lo").select(block_of(own).alias("block"), "h", "tag", F.col("least").alias("lo"))

    def first_level(length: int):
        return lambda key, t: _level(t, key[0].as_py(), window, None, length)

    def next_level(done: int, length: int):
        return lambda key, t, r: _level(t, key[0].as_py(), window, (done, _known(r)), length)

    reply = None
    done = 0
    for length in levels(window, base):
        kind = _FOUND if length == window else _SEEN
        if reply is None:
            found = dealt.groupBy("block").applyInArrow(first_level(length), kind)
        else:
            found = dealt.groupBy("block").cogroup(reply.groupBy("block")).applyInArrow(next_level(done, length), kind)
        reply = removable(found) if length == window else repeated(found)
        done = length
    out = T.StructType(
        [
            T.StructField("id", T.LongType()),
            T.StructField("n_words", T.LongType()),
            T.StructField("n_removed", T.LongType()),
            T.StructField("spans", T.ArrayType(T.LongType())),
            T.StructField("kept_text", T.StringType()),
        ]
    )
    cut = dealt.groupBy("block").cogroup(reply.groupBy("block")).applyInArrow(lambda t, r: _cut(t, window, *_known_windows(r)), out)
    return cut.withColumnRenamed("id", id_col)
