"""Benchmark decontamination with one Aho-Corasick automaton over the items' word windows."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .kernels import text_bytes
from .runtime import map_in_arrow

#: Bytes of benchmark text that one automaton holds; more text makes more automata.
AUTOMATON_BYTES = 8 << 20

#: A-Z lower-cased; ASCII that is neither letter nor digit becomes a space; bytes of other characters stay.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def _words(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split(b" ")


def item_windows(text: str | None, length: int) -> set[str]:
    """The item's windows as the automaton's patterns: words between single spaces, one character a byte."""
    words = [w for w in _words((text or "").encode()) if w]
    if not words:
        return set()
    if len(words) < length:
        return {f" {b' '.join(words).decode('latin-1')} "}
    return {f" {b' '.join(words[k : k + length]).decode('latin-1')} " for k in range(len(words) - length + 1)}


def _automaton(items: list[tuple[object, str | None]], length: int):
    patterns: dict[str, set] = {}
    for item, text in items:
        for w in item_windows(text, length):
            patterns.setdefault(w, set()).add(item)
    built = ahocorasick.Automaton()
    for w, owners in patterns.items():
        built.add_word(w, (len(w), tuple(owners)))
    if patterns:
        built.make_automaton()
    return built, bool(patterns)


_built: dict[str, tuple] = {}


def _cached(key: str, items: list, length: int):
    if key not in _built:
        if len(_built) >= 2:
            _built.clear()
        _built[key] = _automaton(items, length)
    return _built[key]


_SCANNED = T.StructType(
    [
        T.StructField("row_id", T.LongType()),
        T.StructField("n_words", T.LongType()),
        T.StructField("spans", T.ArrayType(T.LongType())),
        T.StructField("items", T.ArrayType(T.StringType())),
    ]
)


def _union(spans: list[tuple[int, int]]) -> list[int]:
    out: list[int] = []
    for a, b in sorted(spans):
        if out and a <= out[-1]:
            out[-1] = max(out[-1], b)
        else:
            out += [a, b]
    return out


def _scan_text(data: bytes, machines: list[tuple]) -> tuple[int, list[int], list[str]]:
    """Number of words, word spans that are hit, items."""
    parts = _words(data)
    words = [w for w in parts if w]
    if not words:
        return 0, [], []
    text = f" {b' '.join(words).decode('latin-1')} "
    spans, items = [], set()
    starts = None
    for machine, filled in machines:
        if not filled:
            continue
        for end, (size, owners) in machine.iter(text):
            if starts is None:
                starts = np.cumsum([0, *(len(w) + 1 for w in words)])
            # the pattern begins at the space before its first word and ends at the one after its last
            spans.append((int(np.searchsorted(starts, end - size + 1)), int(np.searchsorted(starts, end))))
            items.update(owners)
    return len(words), _union(spans), sorted(items)


def _blocks(benchmark: DataFrame, id_col: str, text_col: str, limit: int) -> list[list[tuple[str, str | None]]]:
    """The benchmark's items in blocks of at most ``limit`` bytes (an item is never split).

    The benchmark is a published test set; its size is measured first and
    decides the number of blocks.  Only one block at a time is put together.
    """
    rows = benchmark.select(F.col(id_col).cast("string"), F.col(text_col).alias("text"))
    blocks: list[list] = []
    room = 0
    for item, text in rows.toLocalIterator():
        size = len((text or "").encode())
        if not blocks or size > room:
            blocks.append([])
            room = limit
        blocks[-1].append((item, text))
        room -= size
    return blocks


def _scanner(spark: SparkSession, benchmark: DataFrame, item_col: str, text_col: str, window: int, block_bytes: int):
    """A function from a column of texts to their numbers of words, hit spans and items."""
    blocks = [[("null" if i is None else i, t) for i, t in b] for b in _blocks(benchmark, item_col, text_col, block_bytes)]
    shared = [(hashlib.md5(repr((window, b)).encode()).hexdigest(), spark.sparkContext.broadcast(b)) for b in blocks]

    def scanner(column: pa.Array) -> tuple[list, list, list]:
        data, offsets = text_bytes(column)
        raw = data.tobytes()
        bounds = list(zip(offsets[:-1].tolist(), offsets[1:].tolist()))
        n_words = [0] * len(bounds)
        spans: list[list[int]] = [[] for _ in bounds]
        items: list[list[str]] = [[] for _ in bounds]
        for key, block in shared or [("", None)]:
            machines = [_cached(key, block.value, window)] if block is not None else []
            for k, (a, b) in enumerate(bounds):
                n_words[k], s, i = _scan_text(raw[a:b], machines)
                if s:
                    spans[k] = _union([*zip(spans[k][::2], spans[k][1::2]), *zip(s[::2], s[1::2])])
                    items[k] = sorted({*items[k], *i})
        return n_words, spans, items

    return scanner


def hits(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 10, block_bytes: int = AUTOMATON_BYTES) -> DataFrame:
    """Where windows of benchmark items occur in the documents.

    Words are maximal runs of characters that are not ASCII punctuation, space
    or control characters, after lower-casing A-Z.  A window is ``window``
    consecutive words of an item; an item of fewer words (but not none) is one
    window.  The benchmark goes into one automaton if it has at most
    ``block_bytes`` of text (its size is measured), else into one for every
    ``block_bytes``; each text is normalised once and scanned by each of them.
    Automata are broadcast as the items' texts and built once per worker.

    Returns per row: ``id_col``, ``n_words``, ``spans`` (flat list of
    alternating begins and ends, in words of the original text, of the
    maximal runs of hit words) and ``items`` (ids as strings, sorted).  Null
    text has no words; null item ids are reported as the string ``null``;
    repeated rows are scanned one by one; empty tables give no rows or no hits.
    """
    scanner = _scanner(docs.sparkSession, benchmark, item_col, item_text_col, window, block_bytes)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, spans, items = scanner(batch.column(1))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n_words, pa.int64()), pa.array(spans, pa.list_(pa.int64())), pa.array(items, pa.list_(pa.string()))], names=["row_id", "n_words", "spans", "items"]
            )

    rows = docs.select(F.col(id_col).cast("long").alias("row_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(scan, _SCANNED).withColumnRenamed("row_id", id_col)


def contamination(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """Per document: id, n_words, n_hit, n_items, items_sha256, contaminated. See :func:`hits`."""
    id_col = options.get("id_col", "doc_id")
    found = hits(docs, benchmark, **options)
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: x - s)  # e2 - (b2 - (e1 - b1))
    return found.select(
        id_col,
        "n_words",
        F.when(F.size("spans") > 0, n_hit).otherwise(0).cast("long").alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        (F.size("spans") > 0).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 10, block_bytes: int = AUTOMATON_BYTES) -> DataFrame:
    """The rows of ``docs``, all columns, without a hit window; no row is moved."""
    scanner = _scanner(docs.sparkSession, benchmark, item_col, item_text_col, window, block_bytes)
    at = docs.columns.index(text_col)

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, spans, _ = scanner(batch.column(at))
            yield batch.filter(pa.array([not s for s in spans], pa.bool_()))

    return map_in_arrow(docs, clean, docs.schema)
