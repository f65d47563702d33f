"""Near-duplicate detection on word shingles with bottom-k sketches of one hash function."""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .graph import components
from .kernels import U64, lower_ascii, mix, pieces, window_hashes, word_hashes, word_spans
from .runtime import discard, fresh, named, written

#: Values that a sketch retains.
SKETCH = 1024

#: -ln of the bound on the chance that a pair at the threshold is missed.
SURENESS = 20.0

#: Values of the shorter sketches that filter pairs before full sets are fetched.
ESTIMATE_SKETCH = 256

#: Sizes of unions up to which every value may begin a run, then those at which sparser beginnings are tried.
SIZES = (128, 192, 256, 384, 512, 768, 1024)

#: Rounds in which a list's members are compared with one of its members only.
STAR_ROUNDS = 3

#: Ids up to which (counted first) the documents of candidate pairs are picked by a broadcast, else by a shuffle.
BROADCAST_IDS = 200_000

#: Members up to which a list that is still open is compared member by member.
SHORT_LIST = 64

#: Members of a long list that one block of a comparison holds.
LIST_BLOCK = 512


def least_overlap(k: int, similarity: float, sureness: float = SURENESS) -> int:
    """The overlap that two bottom-``k`` sketches of sets of this similarity miss with a chance below ``exp(-sureness)``.

    By Chernoff's bound for drawing the union's ``k`` least values without
    replacement.
    """
    for m in range(math.ceil(k * similarity), 1, -1):
        q = m / k
        if q < similarity:
            far = q * math.log(q / similarity) + ((1 - q) * math.log((1 - q) / (1 - similarity)) if similarity < 1 else math.inf)
            if k * far >= sureness:
                return m
    return 1


# -- runs of retained values ------------------------------------------------------------------------------------


def certain_run(size: int, percent: int) -> int:
    """The values in a row, in order of hash, that two similar sets have in common for certain if their union has this size.

    At most ``(100 - percent) %`` of the union are in one set only; these part
    the common ones into one stretch more than they are.
    """
    odd = (100 - percent) * size // 100
    return -(-(size - odd) // (odd + 1))


@functools.lru_cache(maxsize=None)
def missed(values: int, density: float, run: int, similarity: float) -> float:
    """The chance that of ``values`` of a union no ``run`` common ones in a row start at one that may begin a run.

    A value is common with the chance ``similarity`` (drawing without
    replacement is only less likely to fail) and may begin a run with the
    chance ``density``; the state is how far the oldest run under way has come.
    """
    state = [1.0] + [0.0] * (run - 1)
    for _ in range(values):
        after = [(1 - similarity) * sum(state)] + [0.0] * (run - 1)
        after[0] += state[0] * similarity * (1 - density)
        for come, x in enumerate(state):
            if come + 1 < run:
                after[come + 1] += x * similarity * (density if come == 0 else 1.0)
        state = after
    return sum(state)


@functools.lru_cache(maxsize=None)
def beginnings(values: int, run: int, similarity: float, sureness: float = SURENESS) -> int | None:
    """How many of ``values`` of a union must be able to begin a run so that a pair is missed with a chance below ``exp(-sureness)``; None if all don't do."""
    if missed(values, 1.0, run, similarity) > math.exp(-sureness):
        return None
    low, high = 1, values
    while low < high:
        middle = (low + high) // 2
        if missed(values, middle / values, run, similarity) <= math.exp(-sureness):
            high = middle
        else:
            low = middle + 1
    return low


class Runs:
    """Which runs of retained values a set of a size puts into inverted lists.

    Similar sets have long runs of equal values in the order of hashes.  The
    length of a run depends on the union's size: up to ``SIZES[0]`` it is the
    one that is certain and every value begins a run, so no pair is missed;
    unions beyond ``longer_from`` have runs of one value more.  As a set
    doesn't know the union, it takes all lengths of the unions it can have
    with a similar set.  Values begin a run if another hash of theirs is below
    a bound that falls with the set's size; so what begins one in the larger
    of two sets does so in the smaller.
    """

    def __init__(self, percent: int, sketch: int):
        self.percent, self.sketch, s = percent, sketch, percent / 100
        self.short = certain_run(1 << 20, percent) if percent < 100 else 0
        fits = lambda run, part: next((n for n in SIZES if (c := beginnings(n, run, s)) is not None and c <= part * n), SIZES[-1])
        self.longer_from = max(SIZES[0], fits(self.short + 1, 0.3)) if self.short else 0
        self.dense_to = max(SIZES[0], fits(self.short, 0.6)) if self.short else 0
        self.many = {run: beginnings(n, run, s) or n for run, n in ((self.short, self.dense_to), (self.short + 1, self.longer_from))} if self.short else {}

    def lengths(self, size: int) -> list[int]:
        """The lengths of runs of a set of this size."""
        if not self.short:
            return []
        widest = size * 100 // self.percent
        if size > self.longer_from:
            return [self.short + 1]
        found = {min(self.short, certain_run(u, self.percent)) for u in range(size, min(widest, 16 * (self.short + 1), self.longer_from) + 1) if (100 - self.percent) * u >= 100}
        if widest >= 16 * (self.short + 1):
            found.add(self.short)
        if widest > self.longer_from:
            found.add(self.short + 1)
        return sorted(found)

    def density(self, size: int, run: int) -> float:
        """The share of values that begin a run."""
        return 1.0 if size <= self.dense_to and run <= self.short else min(1.0, self.many.get(run, self.many[self.short]) / min(size, self.sketch))

    def keys(self, values: np.ndarray) -> np.ndarray:
        """Of a set's sorted values the 63-bit hashes of the runs within its sketch."""
        low = values[: self.sketch]
        out = []
        for run in self.lengths(len(values)):
            if len(low) >= run:
                whole = mix(window_hashes(low, run) + U64(run)) >> U64(1)
                bound = self.density(len(values), run)
                out.append(whole if bound >= 1 else whole[mix(low[: len(whole)] ^ U64(0x5851F42D4C957F2D)) < U64(int(bound * 2.0**64))])
        return np.concatenate(out) if out else values[:0]


# -- sets -------------------------------------------------------------------------------------------------------


def _sets(column: pa.Array, words: int) -> Iterator[np.ndarray]:
    """The sorted 63-bit hashes of each text's distinct shingles."""
    for first, end, data, offsets in pieces(column):
        data = lower_ascii(data)
        start, stop, bounds = word_spans(data, offsets)
        hashes = word_hashes(data, start, stop)
        whole = window_hashes(hashes, words) >> U64(1)
        for k in range(end - first):
            a, b = int(bounds[k]), int(bounds[k + 1])
            if b - a >= words:
                yield np.unique(whole[a : b - words + 1])
            elif b > a:
                yield window_hashes(hashes[a:b], b - a) >> U64(1)
            else:
                yield hashes[:0]


def _lists(arrays: list[np.ndarray], kind=pa.int64()) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype(np.int32)
    values = np.concatenate(arrays) if arrays else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.astype(np.int64), kind))


_SKETCHED = "id long, n long, sa long, sb long, keys array<long>"


def _sketcher(words: int, percent: int, k: int):
    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = Runs(percent, k)
        for batch in batches:
            n, sa, sb, keys = [], [], [], []
            for s in _sets(batch.column(1), words):
                n.append(len(s))
                sa.append(int(mix(s).sum(dtype=np.uint64)))
                sb.append(int(np.bitwise_xor.reduce(mix(s * U64(3) + U64(1)))) if len(s) else 0)
                keys.append(runs.keys(s))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(np.array(sa, np.uint64).view(np.int64)), pa.array(np.array(sb, np.uint64).view(np.int64)), _lists(keys)], names=["id", "n", "sa", "sb", "keys"]
            )

    return sketch


def _full(words: int):
    def full(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), _lists(list(_sets(batch.column(1), words)))], names=["id", "shingles"])

    return full


# -- candidates -------------------------------------------------------------------------------------------------


def _flat(table: pa.Table, name: str) -> tuple[np.ndarray, np.ndarray]:
    """Values of a list column and the row of each."""
    column = table.column(name).combine_chunks() if table.num_rows else pa.array([], pa.list_(pa.int64()))
    return column.flatten().to_numpy(), np.repeat(np.arange(len(column)), column.value_lengths().to_numpy())


def _postings(first: DataFrame) -> DataFrame:
    """(v, id, n) of the inverted lists with two members or more, written.

    The lists' lengths are summed before they are shuffled, so the longest
    list is one row a task; the join that leaves out lists of one member lets
    adaptive execution split a long list.
    """
    every = first.select(F.explode("keys").alias("v"), "id", "n")
    lists = written(every.groupBy("v").agg(F.count(F.lit(1)).alias("members")).filter("members > 1").select("v"), "lists")
    found = written(every.join(lists, "v", "left_semi"), "postings")
    discard(lists)
    return found


def _estimate_passes(percent: int) -> Column:
    """Whether the union's sketch leaves a pair (na, ska, nb, skb) possible.

    The sketches hold the upper 31 bits of their values, in order.  Values of
    one set that agree in these count once in the intersection, so as many are
    added back: equal upper bits can only let a pair pass.
    """
    k, m = ESTIMATE_SKETCH, least_overlap(ESTIMATE_SKETCH, percent / 100)
    both = F.array_intersect("ska", "skb")
    least = F.slice(F.array_sort(F.array_union("ska", "skb")), 1, k)
    whole = (F.col("na") <= k) & (F.col("nb") <= k)
    merged = F.least(*(F.size(c) - F.size(F.array_distinct(c)) for c in ("ska", "skb")))
    most = F.size(both) + merged
    exact = most * 100 >= (F.col("na") + F.col("nb") - most) * percent
    return F.when(whole, exact).otherwise(F.size(F.array_intersect(least, both)) + merged >= m)


def _of_pairs(sets: DataFrame, pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The sets that occur in the pairs, so that others aren't moved; and the written table of their ids."""
    ids = written(pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).distinct(), "ids")
    return sets.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "id", "left_semi"), ids


def _verified(pairs: DataFrame, sets: DataFrame, percent: int, name: str, every: bool = False) -> DataFrame:
    """The pairs (a, b) whose sets are similar: the union's sketch filters, the full sets decide. every: about all sets occur in the pairs."""
    pairs = written(pairs, f"{name}-pairs")
    near, ids = (sets, None) if every else _of_pairs(sets, pairs)
    short = F.transform(F.slice("shingles", 1, ESTIMATE_SKETCH), lambda v: F.shiftright(v, 32).cast("int"))
    side = lambda x: near.select(F.col("id").alias(x), F.size("shingles").alias(f"n{x}"), short.alias(f"sk{x}"))
    likely = written(pairs.join(side("a"), "a").join(side("b"), "b").filter(_estimate_passes(percent)).select("a", "b"), f"{name}-likely")
    discard(pairs, *([] if every else [ids]))
    near, ids = _of_pairs(sets, likely)
    full = lambda x: near.select(F.col("id").alias(x), F.col("shingles").alias(f"full{x}"))
    both = F.size(F.array_intersect("fulla", "fullb"))
    exact = likely.join(full("a"), "a").join(full("b"), "b").filter(both * 100 >= (F.size("fulla") + F.size("fullb") - both) * percent)
    links = written(exact.select("a", "b").distinct(), name)
    discard(likely, ids)
    return links


def _all(links: list[DataFrame]) -> DataFrame:
    every = links[0]
    for more in links[1:]:
        every = every.union(more)
    return every


def _open_lists(postings: DataFrame, labels: DataFrame | None) -> DataFrame:
    """(v, id, n, label) of the lists that hold more than one component, one of those with the same members.

    Once there are labels, the two members of a list of two have been compared
    and so have nothing left to tell.
    """
    if labels is None:
        named = postings.select("v", "id", "n", F.col("id").alias("label"))
    else:
        named = postings.select("v", "id", "n").join(labels.withColumnRenamed("node", "id"), "id", "left").select("v", "id", "n", F.coalesce("label", "id").alias("label"))
    low = lambda *c: F.xxhash64(*c).bitwiseAND(0xFFFFFFFFFF)
    lists = named.groupBy("v").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count(F.lit(1)).alias("members"), F.sum(low("id")).alias("s1"), F.sum(low("id", F.lit(7))).alias("s2"))
    one = lists.filter("lo < hi").filter(F.col("members") > (1 if labels is None else 2)).groupBy("members", "s1", "s2").agg(F.min("v").alias("v")).select("v")
    return named.join(one, "v", "left_semi")


def _alike(percent: int) -> Column:
    return F.least("n", "m") * 100 >= F.greatest("n", "m") * percent


def _pairs(df: DataFrame) -> DataFrame:
    return df.select(F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b")).distinct()


def _stars(members: DataFrame, percent: int, turn: int) -> DataFrame:
    """Pairs of each member of a list with one hub of another component: the least id at first, then the member of least hash."""
    order = F.col("id") if turn == 0 else F.xxhash64("id", F.lit(turn))
    hubs = members.groupBy("v").agg(F.min(F.struct(order.alias("o"), "id", "n", "label")).alias("h"))
    hubs = hubs.select("v", F.col("h.id").alias("other"), F.col("h.n").alias("m"), F.col("h.label").alias("theirs"))
    return _pairs(members.join(hubs, "v").filter((F.col("label") != F.col("theirs")) & _alike(percent)))


def _block_links(percent: int):
    """Links between a block's outsiders and its members of other components, decided on the full sets.

    Of an outsider's links to one component one is returned: it joins them.
    """

    def links(table):
        ids, label = table.column("id").to_numpy(), table.column("label").to_numpy()
        out = table.column("outsider").to_numpy(zero_copy_only=False)
        left, right = np.flatnonzero(out), np.flatnonzero(~out)
        a = b = np.zeros(0, np.int64)
        if len(left) and len(right):
            values, row = _flat(table, "shingles")
            size = np.bincount(row, minlength=len(ids))
            _, code = np.unique(values, return_inverse=True)
            of_left = out[row]
            width = int(code.max()) + 1 if len(code) else 0
            both = (np.bincount(code[of_left], minlength=width) > 0) & (np.bincount(code[~of_left], minlength=width) > 0)
            keep = both[code]
            column = (np.cumsum(both) - 1)[code[keep]]
            row, of_left = row[keep], of_left[keep]
            place = np.empty(len(ids), np.int64)
            place[left], place[right] = np.arange(len(left)), np.arange(len(right))
            shared = np.zeros((len(left), len(right)), np.float32)
            order = np.argsort(column, kind="stable")
            column, row, of_left = column[order], row[order], of_left[order]
            for first in range(0, int(both.sum()), 4096):  # bounds the dense matrices
                part = slice(*np.searchsorted(column, [first, first + 4096]))
                c, r, o = column[part] - first, place[row[part]], of_left[part]
                x, y = np.zeros((len(left), 4096), np.float32), np.zeros((len(right), 4096), np.float32)
                x[r[o], c[o]] = 1
                y[r[~o], c[~o]] = 1
                shared += x @ y.T
            union = size[left][:, None] + size[right][None, :] - shared
            i, j = np.nonzero((100 * shared >= percent * union) & (label[left][:, None] != label[right][None, :]))
            _, one = np.unique(np.stack([i, label[right][j]]), axis=1, return_index=True)
            a, b = ids[left][i[one]], ids[right][j[one]]
        return pa.table({"a": pa.array(np.minimum(a, b), pa.int64()), "b": pa.array(np.maximum(a, b), pa.int64())})

    return links


def _last_links(members: DataFrame, sets: DataFrame, percent: int) -> list[DataFrame]:
    """What links components in the lists that still hold several.

    In a list all but the largest component are outsiders; each of them must
    still be compared with every member of another component.  In lists of at
    most ``SHORT_LIST`` members these pairs are made by a join and verified as
    before.  Components that meet in longer lists form clusters; a cluster's
    outsiders and members are dealt into blocks of about ``LIST_BLOCK`` with
    their full sets, and every pair of blocks is one bounded task.  So a pair
    is looked at once however many lists share it, and what leaves a task is
    at most one link for an outsider and a component.
    """
    sizes = members.groupBy("v", "label").agg(F.count(F.lit(1)).alias("c"))
    lists = sizes.groupBy("v").agg(F.max(F.struct("c", "label")).alias("main"), F.sum("c").alias("all")).select("v", F.col("main.label").alias("main"), "all")
    told = written(members.join(lists, "v"), "told")
    short = told.filter(F.col("all") <= SHORT_LIST)
    theirs = short.select("v", F.col("id").alias("other"), F.col("n").alias("m"), F.col("label").alias("theirs"))
    few = _pairs(short.filter("label <> main").join(theirs, "v").filter((F.col("label") != F.col("theirs")) & _alike(percent)))
    long = told.filter(F.col("all") > SHORT_LIST)
    links = [_verified(few, sets, percent, "links-short")]
    if not long.limit(1).count():
        discard(told)
        return links
    within = components(long.filter("label <> main").select(F.col("label").alias("a"), F.col("main").alias("b")))
    clusters = within.select(F.col("node").alias("label"), F.col("label").alias("cluster"))
    docs = long.select("id", "n", "label").distinct().join(clusters, "label")
    sides = docs.groupBy("cluster", "label").agg(F.count(F.lit(1)).alias("c")).groupBy("cluster").agg(F.max(F.struct("c", "label")).alias("main"), F.sum("c").alias("all"))
    sides = sides.select("cluster", F.col("main.label").alias("main"), F.ceil(F.col("all") / LIST_BLOCK).alias("cols"), F.ceil((F.col("all") - F.col("main.c")) / LIST_BLOCK).alias("rows"))
    placed = docs.join(sides, "cluster").withColumn("outside", F.col("label") != F.col("main"))
    h = F.xxhash64("id")
    upto = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    as_row = placed.filter("outside").select("cluster", "id", "label", F.lit(True).alias("outsider"), F.pmod(h, "rows").alias("i"), upto("cols").alias("j"))
    as_col = placed.select("cluster", "id", "label", F.lit(False).alias("outsider"), upto("rows").alias("i"), F.pmod(h, "cols").alias("j"))
    loaded = as_row.union(as_col).join(sets, "id").select("cluster", "i", "j", "id", "label", "outsider", "shingles")
    links.append(written(loaded.groupBy("cluster", "i", "j").applyInArrow(_block_links(percent), "a long, b long").distinct(), "links-long"))
    discard(told, within)
    return links


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", words: int = 5, percent: int = 80, sketch: int = SKETCH) -> DataFrame:
    """The component of near duplicates of every row.

    Texts are lower-cased (A-Z) and cut into words at ASCII white space; a
    row's set holds its distinct shingles of ``words`` words (the whole
    sequence if it has fewer, nothing if it has none).  Two rows are linked if
    their sets' Jaccard similarity is at least ``percent`` / 100.

    1. One hash function; a set's sketch is its ``sketch`` least values.  Rows
       of equal sets become one class at once.
    2. Inverted lists of retained values, a few in a row each (:class:`Runs`):
       single values that most texts of a language have would make lists that
       grow with the corpus, several in a row are shared by chance only by
       texts that overlap much.
    3. Members of a list are paired with one of its members, not with each
       other.  The sketch of the union filters the pairs, the full sets decide.
       A list whose members are now in one component is finished: no pair in it
       can change the result.  While one of the others has over ``SHORT_LIST``
       members, they go through more such rounds.
    4. In the lists that stay open every member outside the largest component
       is compared with all members of other components, long lists in blocks.

    Pairs whose union has up to ``SIZES[0]`` shingles are never missed, larger
    ones at the threshold with a chance below ``exp(-SURENESS)``, about 2e-9;
    no value, list or candidate is capped.

    Returns one row per input row: ``id_col``, ``n_shingles``,
    ``component_id`` (least id reachable, itself included), ``kept``.  Rows
    without words are linked with nothing.  Rows that repeat an id are one
    document: its links are those of any of them.  A null id is linked with
    nothing, has a null component and stays.  Other columns are ignored.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    sketched = written(rows.mapInArrow(_sketcher(words, percent, sketch), _SKETCHED), "sketched")
    made = written(sketched.select("id", "n", "sa", "sb"), "classes")
    classes = made.filter("n > 0 AND id IS NOT NULL").groupBy("n", "sa", "sb").agg(F.min("id").alias("rep"))
    named = classes.select(F.col("n").alias("cn"), F.col("sa").alias("ca"), F.col("sb").alias("cb"), "rep")
    same = (F.col("id") == F.col("rep")) & (F.col("n") == F.col("cn")) & (F.col("sa") == F.col("ca")) & (F.col("sb") == F.col("cb"))
    first = written(sketched.join(named, same, "left_semi").select("id", "n", "keys"), "first")
    discard(sketched)
    postings = _postings(first)
    discard(first)
    sets = written(rows.join(postings.select("id").distinct(), "id", "left_semi").mapInArrow(_full(words), "id long, shingles array<long>"), "sets")
    found: list[DataFrame] = []
    labels, members = None, postings
    for turn in range(STAR_ROUNDS + 1):
        still = written(_open_lists(members, labels), "open-lists")
        discard(members)
        members = still
        if not members.limit(1).count():
            break
        last = turn == STAR_ROUNDS or turn and not members.groupBy("v").count().filter(F.col("count") > SHORT_LIST).limit(1).count()
        links = _last_links(members, sets, percent) if last else [_verified(_stars(members, percent, turn), sets, percent, f"links{turn}", every=not turn)]
        if _all(links).limit(1).count():
            found += links
            if labels is not None:
                discard(labels)
            labels = components(_all(found))
        else:
            discard(*links)
        if last:
            break
    discard(sets, members, *found)
    if labels is None:
        labels = docs.sparkSession.createDataFrame([], "node long, label long")
    of_class = classes.join(labels.withColumnRenamed("node", "rep"), "rep", "left").select("n", "sa", "sb", F.coalesce("label", "rep").alias("component"))
    named = made.select("id", "n", "sa", "sb").join(of_class, ["n", "sa", "sb"], "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "id"))
    return named.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))


def drop_near_copies(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs``, all columns, that are the first of their component."""
    (gone_id,) = fresh(docs.columns, "gone_id")
    gone = near_duplicates(docs, id_col=id_col, text_col=text_col, **options).filter("NOT kept").select(F.col(id_col).alias(gone_id)).distinct()
    return docs.join(gone, named(id_col) == F.col(gone_id), "left_anti")
