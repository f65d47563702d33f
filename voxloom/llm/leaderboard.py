"""A change feed of leaderboards: the ten best items of each nation after every arrival day.

Lines are cut into batches by arrival day and fed in order to one Structured
Streaming query, started anew for each batch on one checkpoint.  Its state is a
tree of boards: a leaf for each nation and part of the items keeps the running
revenues of its items and reports what changed on its own ten best; a merging
operator keeps a board of what at most ``FAN_IN`` children report, and the last
one is the nation's.  A nation's ten best are among the ten best of its parts,
so only those go on, and no task sees a nation's lines, however many they are.
The tree is as deep as the number of items asks for: where all fit one leaf,
that is the nation's board.
Spark's watermark drops late lines.
"""

from __future__ import annotations

import contextlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .runtime import collect_garbage, delete, make_folder, move, new_path

#: Places of a board.
PLACES = 10
#: First arrival day that the batches count from (2024-01-01), and the days that they divide.
FIRST_DAY, DAYS = 19723, 180
DAY_MS = 86_400_000
#: Items of a nation that one leaf keeps, on average, and children that one merging operator hears.
LEAF_ITEMS, FAN_IN = 65536, 64
#: Copies of the tables of vendors and items that lines are dealt to, so that a frequent vendor or item goes to as many tasks.
VENDOR_SALTS, ITEM_SALTS = 16, 8
#: Items that a leaf's ordered list holds after it was filled, and parcels of changes that it keeps before they are added up.
HEAD, PARCELS = 256, 8

_FEED = "batch int, nation_id int, item_id long, arrival_day int, shipped_day int, shipped timestamp, cents double"
_REPORT = "nation_id int, node int, item_id long, batch int, arrival_day int, at timestamp, cents double, listed boolean"
_CHANGES = "nation_id int, arrival_day long, item_id long, batch int, change string, old_rank int, new_rank int, revenue long"


def _cents(amount: Column) -> Column:
    return F.floor(F.lit(100.0) * amount + F.lit(0.5)).cast("double")


def _salted(table: DataFrame, n: int) -> DataFrame:
    return table.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))


def dated(lines: DataFrame, batches: int = 10) -> DataFrame:
    """``lines`` with the day ``shipped_day``, the ``arrival_day`` and the ``batch`` of each."""
    text = F.concat_ws(",", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("sale_id", "item_id", "vendor_id", "line_no")))
    h = F.crc32(text)
    shipped = F.coalesce(F.unix_date(F.col("shipped_at").cast("date")), (F.lit(FIRST_DAY) + h % 150).cast("int"))
    dealt = lines.select("item_id", "vendor_id", "quantity", "amount", "flag", h.alias("h"), shipped.alias("shipped_day"))
    dealt = dealt.withColumn("arrival_day", (F.col("shipped_day") + F.col("h") % 7 + F.when(F.col("h") % 5 == 0, 20).otherwise(0)).cast("int"))
    batch = F.lit(1) + F.floor((F.col("arrival_day") - FIRST_DAY) * batches / DAYS)
    return dealt.withColumn("batch", F.greatest(F.lit(1), F.least(F.lit(batches), batch)).cast("int")).drop("h")


def feed(lines: DataFrame, vendors: DataFrame, items: DataFrame, batches: int = 10) -> DataFrame:
    """What is fed: cents of lines by batch, nation, item, day of arrival and day of shipping.

    Lines of equal keys are added up.  Lines without a nation or without a row
    in ``items`` keep null there and count for the watermark only.  Amounts
    that are null, NaN or infinite are taken from the price; without a price or
    quantity they are 0.  Of repeated vendors the smallest nation holds, of
    repeated items the smallest price.
    """
    known = F.when(~(F.isnan("amount") | F.abs("amount").isin(float("inf"))), F.col("amount"))
    sign = F.when(F.col("flag") == "swapped", -1.0).otherwise(1.0)
    day = dated(lines, batches).select(
        "batch", "vendor_id", "item_id", "arrival_day", "shipped_day",
        (sign * _cents(known)).alias("cents"), F.when(known.isNull(), sign * F.col("quantity")).alias("pieces"),
    )
    nations = vendors.filter("vendor_id is not null").groupBy("vendor_id").agg(F.min("nation_id").alias("nation_id"))
    prices = items.filter("item_id is not null").groupBy("item_id").agg(_cents(F.min("price")).alias("price"), F.lit(True).alias("sold"))
    by_vendor = day.withColumn("salt", F.pmod(F.xxhash64("item_id", "arrival_day", "shipped_day"), F.lit(VENDOR_SALTS)).cast("int"))
    placed = by_vendor.join(_salted(nations, VENDOR_SALTS).hint("shuffle_hash"), ["vendor_id", "salt"], "left").drop("vendor_id")
    by_item = placed.withColumn("salt", F.pmod(F.xxhash64("nation_id", "arrival_day", "shipped_day"), F.lit(ITEM_SALTS)).cast("int"))
    priced = by_item.join(_salted(prices, ITEM_SALTS).hint("shuffle_hash"), ["item_id", "salt"], "left")
    # grouped as the join dealt them: no other shuffle
    keys = ["item_id", "salt", "nation_id", "arrival_day", "shipped_day", "batch", "sold"]
    summed = priced.groupBy(*keys).agg(F.sum(F.coalesce("cents", F.col("pieces") * F.col("price"), F.lit(0.0))).alias("cents"))
    counts = F.col("sold") & F.col("nation_id").isNotNull()
    return summed.select(
        "batch", F.when(counts, F.col("nation_id")).alias("nation_id"), F.when(counts, F.col("item_id")).alias("item_id"), "arrival_day", "shipped_day",
        F.timestamp_seconds(F.col("shipped_day").cast("long") * 86400).alias("shipped"), "cents",
    )


class Ranking:
    """The best of some items: a list of (-revenue, item), kept in order by bisection.

    It holds every item of at least ``floor`` and more than nothing; what lies
    below waits in the arrays, and the list is filled from them when fewer than
    ``PLACES`` are left.
    """

    def __init__(self, items: np.ndarray, totals: np.ndarray):
        self.items, self.totals = items, totals
        self.fill()

    def fill(self) -> None:
        places = np.flatnonzero(self.totals > 0)
        self.floor = 0.0
        if len(places) > HEAD:
            self.floor = float(np.partition(self.totals[places], len(places) - HEAD)[len(places) - HEAD])
            places = places[self.totals[places] >= self.floor]
        self.order = sorted(zip((-self.totals[places]).tolist(), self.items[places].tolist()))

    def add(self, places: np.ndarray, cents: np.ndarray) -> None:
        before = self.totals[places]
        after = before + cents
        self.totals[places] = after
        was, now = (before >= self.floor) & (before > 0), (after >= self.floor) & (after > 0)
        some = np.flatnonzero((was | now) & (before != after))
        for item, old, new, out, into in zip(self.items[places[some]].tolist(), before[some].tolist(), after[some].tolist(), was[some].tolist(), now[some].tolist()):
            if out:
                del self.order[bisect_left(self.order, (-old, item))]
            if into:
                insort(self.order, (-new, item))
        if self.floor > 0 and not PLACES <= len(self.order) <= 8 * HEAD:
            self.fill()

    def best(self) -> dict[int, float]:
        return {item: -less for less, item in self.order[:PLACES]}


def _arrays(rows: Iterator[pd.DataFrame], *columns: str) -> list[np.ndarray]:
    chunks = [tuple(r[c].to_numpy() for c in columns) for r in rows]
    return [np.concatenate(x) for x in zip(*chunks)]


def _days(days: np.ndarray) -> Iterator[tuple[int, slice]]:
    """Each day of a sorted array with its rows."""
    if not len(days):
        return
    cuts = [0, *(np.flatnonzero(np.diff(days)) + 1).tolist(), len(days)]
    for a, b in zip(cuts, cuts[1:]):
        yield int(days[a]), slice(a, b)


def _reports(rows: list[tuple]) -> pd.DataFrame:
    """Rows (nation, node, item, batch, day, cents, listed) as a table."""
    table = pd.DataFrame(rows, columns=["nation_id", "node", "item_id", "batch", "arrival_day", "cents", "listed"])
    table["at"] = pd.to_datetime(table["arrival_day"], unit="D", utc=True)
    return table[["nation_id", "node", "item_id", "batch", "arrival_day", "at", "cents", "listed"]]


def _differences(before: dict[int, float], now: dict[int, float], revenue) -> list[tuple[int, float, bool]]:
    """(item, revenue, listed) of the items whose place among the best or revenue changed; ``revenue`` tells that of items which left."""
    gone = [(i, revenue(i), False) for i in before if i not in now]
    return gone + [(i, c, True) for i, c in now.items() if before.get(i) != c]


class Leaf(StatefulProcessor):
    """The running revenues of one part of a nation's items.

    The map state holds parcels of changes (sorted items, cents); after
    ``PARCELS`` of them they are added up into one, so what a batch writes
    follows what it changed.  The only leaf of a nation (``last``) gives the
    changes of ranks, and saves its board.
    """

    def __init__(self, last: bool = False):
        self.last = last

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.parcels = handle.getMapState("revenues", "parcel int", "items binary, cents binary")
        self.board = handle.getValueState("board", "items binary") if self.last else None

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        item, day, shipped, batch, cents = _arrays(rows, "item_id", "arrival_day", "shipped_day", "batch", "cents")
        # Spark itself drops late rows by the watermark of one batch before, so that operators in a row agree on it
        timely = shipped.astype(np.int64) * DAY_MS > timerValues.getCurrentWatermarkInMs()
        item, day, batch, cents = item[timely], day[timely], batch[timely], cents[timely]
        kept = {k[0]: (np.frombuffer(v[0], np.int64), np.frombuffer(v[1], np.float64)) for k, v in self.parcels.iterator()} if self.parcels.exists() else {}
        old = np.concatenate([v[0] for v in kept.values()]) if kept else np.zeros(0, np.int64)
        items, where = np.unique(np.concatenate([old, item]), return_inverse=True)
        totals = np.zeros(len(items))
        if kept:
            np.add.at(totals, where[: len(old)], np.concatenate([v[1] for v in kept.values()]))
        start, place = totals.copy(), where[len(old) :]
        ranking = Ranking(items, totals)
        order = np.argsort(day, kind="stable")
        place, day, batch, cents = place[order], day[order], batch[order], cents[order]
        out, before = [], ranking.best()
        if self.last and self.board.exists():
            before = {i: before[i] for i in np.frombuffer(self.board.get()[0], np.int64).tolist()}
        revenue = lambda i: float(totals[np.searchsorted(items, i)])
        for d, rows_of in _days(day):
            at, back = np.unique(place[rows_of], return_inverse=True)
            ranking.add(at, np.bincount(back, cents[rows_of], len(at)))
            now = ranking.best()
            if self.last:
                out += [(key[0], d, int(batch[rows_of.start]), *c) for c in _moves(list(before), list(now), revenue)]
            else:
                out += [(key[0], key[1], i, int(batch[rows_of.start]), d, c, on) for i, c, on in _differences(before, now, revenue)]
            before = now
        if self.last:
            self.board.update((np.array(list(before), np.int64).tobytes(),))
        if len(kept) >= PARCELS:
            for k in kept:
                self.parcels.removeKey((k,))
            self.parcels.updateValue((0,), (items.tobytes(), totals.tobytes()))
        elif len(changed := np.flatnonzero(totals != start)):
            self.parcels.updateValue((max(kept, default=-1) + 1,), (items[changed].tobytes(), (totals - start)[changed].tobytes()))
        if out:
            yield _changes(out) if self.last else _reports(out)

    def close(self) -> None:
        pass


class Merge(StatefulProcessor):
    """A board over what the nodes below report; the last one of a nation gives the changes of ranks, the others report upwards."""

    def __init__(self, last: bool):
        self.last = last

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.revenues = handle.getMapState("revenues", "item long", "cents double")
        self.board = handle.getValueState("board", "items binary")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        item, day, batch, cents, listed = _arrays(rows, "item_id", "arrival_day", "batch", "cents", "listed")
        known = {k[0]: v[0] for k, v in self.revenues.iterator()} if self.revenues.exists() else {}
        order = sorted((-c, i) for i, c in known.items())
        board = np.frombuffer(self.board.get()[0], np.int64).tolist() if self.board.exists() else []
        before, touched = {i: known[i] for i in board}, set()
        by_day = np.argsort(day, kind="stable")
        item, day, batch, cents, listed = item[by_day], day[by_day], batch[by_day], cents[by_day], listed[by_day]
        out = []
        for d, rows_of in _days(day):
            left = {}
            for i, c, on in zip(item[rows_of].tolist(), cents[rows_of].tolist(), listed[rows_of].tolist()):
                touched.add(i)
                if i in known:
                    del order[bisect_left(order, (-known.pop(i), i))]
                if on:
                    known[i] = c
                    insort(order, (-c, i))
                else:
                    left[i] = c
            now = {i: -less for less, i in order[:PLACES]}
            revenue = lambda i: known.get(i, left.get(i))
            if self.last:
                out += [(key[0], d, int(batch[rows_of.start]), *c) for c in _moves(list(before), list(now), revenue)]
            else:
                out += [(key[0], key[1], i, int(batch[rows_of.start]), d, c, on) for i, c, on in _differences(before, now, revenue)]
            before = now
        for i in touched:
            if i in known:
                self.revenues.updateValue((i,), (known[i],))
            elif self.revenues.containsKey((i,)):
                self.revenues.removeKey((i,))
        self.board.update((np.array(list(before), np.int64).tobytes(),))
        if out:
            yield _changes(out) if self.last else _reports(out)

    def close(self) -> None:
        pass


def _moves(before: list[int], now: list[int], revenue) -> Iterator[tuple]:
    """(item, change, old rank, new rank, revenue) of the items whose rank differs."""
    old, new = {i: r for r, i in enumerate(before, 1)}, {i: r for r, i in enumerate(now, 1)}
    for i in sorted({*old, *new}):
        a, b = old.get(i), new.get(i)
        if a != b:
            yield i, "enter" if a is None else "exit" if b is None else "move", a, b, int(revenue(i))


def _changes(rows: list[tuple]) -> pd.DataFrame:
    table = pd.DataFrame(rows, columns=["nation_id", "arrival_day", "batch", "item_id", "change", "old_rank", "new_rank", "revenue"])
    table = table.astype({"old_rank": "Int32", "new_rank": "Int32"})
    return table[["nation_id", "arrival_day", "item_id", "batch", "change", "old_rank", "new_rank", "revenue"]]


@contextlib.contextmanager
def _streaming(spark: SparkSession):
    """Settings that the query takes when it starts; those of before come back after it."""
    wanted = {
        "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
        "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
        "spark.sql.streaming.noDataMicroBatches.enabled": "false",
    }
    before = {k: spark.conf.get(k, None) for k in wanted}
    try:
        for k, v in wanted.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def boards(stream: DataFrame, parts: int, fan_in: int = FAN_IN) -> DataFrame:
    """The change feed of a stream of :func:`feed`: leaves, then merging operators up to one a nation."""
    # a line waits three days: what was shipped more than that before the latest line of earlier batches is dropped
    # (the filter names the time as well, as the optimizer would move it below the watermark, which all lines must reach)
    timely = stream.withWatermark("shipped", "3 days 1 millisecond").filter("nation_id is not null or shipped is null")
    if parts == 1:
        return timely.groupBy("nation_id").transformWithStateInPandas(Leaf(last=True), _CHANGES, "append", "eventTime")
    leaves = timely.withColumn("node", F.pmod(F.xxhash64("item_id"), F.lit(parts)).cast("int")).groupBy("nation_id", "node")
    reports = leaves.transformWithStateInPandas(Leaf(), _REPORT, "append", "eventTime", eventTimeColumnName="at")
    while parts > fan_in:
        parts = -(-parts // fan_in)
        nodes = reports.withColumn("node", F.floor(F.col("node") / fan_in).cast("int")).groupBy("nation_id", "node")
        reports = nodes.transformWithStateInPandas(Merge(last=False), _REPORT, "append", "eventTime", eventTimeColumnName="at")
    return reports.groupBy("nation_id").transformWithStateInPandas(Merge(last=True), _CHANGES, "append", "eventTime")


def change_feed(lines: DataFrame, vendors: DataFrame, items: DataFrame, batches: int = 10, leaf_items: int = LEAF_ITEMS, fan_in: int = FAN_IN) -> DataFrame:
    """Changes of the nations' boards of ``lines``, fed in ``batches`` by arrival day.

    Returns nation_id, arrival_day, item_id, batch, change (enter, exit, move),
    old_rank, new_rank (null: not on the board) and revenue (cents after the
    day, also of items that left), for each item whose rank differs from the
    board before.  Days without lines that count leave a board as it is.

    Null ids take part in the hash as empty text; a line without vendor,
    nation or item is ignored but for the watermark.  Repeated lines count
    each time, equal revenues rank the smaller item first, lines that arrive
    before the first day belong to batch 1, empty tables give no rows, other
    columns are not read.
    """
    spark = lines.sparkSession
    root = new_path(spark, "leaderboard")
    parts = max(1, -(-items.count() // leaf_items))
    feed(lines, vendors, items, batches).write.partitionBy("batch").option("compression", "zstd").parquet(f"{root}/cut")
    collect_garbage(spark)
    make_folder(spark, f"{root}/feed")
    make_folder(spark, f"{root}/changes")
    with _streaming(spark):
        for k in range(1, batches + 1):
            move(spark, f"{root}/cut/batch={k}", f"{root}/feed/batch={k}")
            stream = spark.readStream.schema(_FEED).parquet(f"{root}/feed")
            sink = boards(stream, parts, fan_in).writeStream.format("parquet").outputMode("append").trigger(availableNow=True)
            query = sink.option("path", f"{root}/changes").option("checkpointLocation", f"{root}/checkpoint").start()
            query.awaitTermination()
            collect_garbage(spark)
    for done in ("cut", "feed", "checkpoint"):
        delete(spark, f"{root}/{done}")
    return spark.read.schema(_CHANGES).parquet(f"{root}/changes")
