"""Word n-gram Jaccard join by signature trees, and the components of its links.

Documents are sets of distinct shingles of five words (all words as one if fewer), as 64-bit
hashes. Equal sets are one class, which has a number of its own while links are found. In any fixed order of
shingles, two sets of similarity t share one of the first ``n - ceil(t n) + 1`` of each; the order
puts rare shingles first, by counts over the whole corpus in a sketch of fixed size. The first one
that they share also has enough places behind it in both; a set whose place of a shingle leaves too
few for any set it meets there is dropped, so texts that share most of a template, but aren't
similar, don't meet in it. Sets that
share such a shingle are joined in groups by signature trees: each node holds, for each slot of a
hashed bitmap, the largest number of tokens that a set below it has there (its OR, with counts),
and the range of set sizes. A dual traversal drops node pairs whose largest possible overlap is
under the least that their sizes ask for, and node pairs that lie in one component already; what
is left at the leaves is counted exactly.

The join runs twice. Sets that meet in a shared shingle, at sizes that allow it, first join on
signatures of 256 bytes or some more, where the largest possible overlap decides alone; shingles that the same
sets share are joined once. Only sets that this leaves fetch their texts and are counted, in groups
of what the first join connects.

Groups of up to ``GROUP`` sets and ``MOST_SHINGLES`` shingles are joined in one task. Larger ones are joined
in blocks of about as much: first each set with others that chose the same shared shingle, which connects copies,
then, for each shingle whose sets are still in several components, the sets outside its largest
component with all its sets. No link between different components is left out, so the components
are exact. Sets of one component need not be compared further, so a group of n copies costs about
n comparisons.

Null texts and texts without words have an empty set and are linked with nothing; their component
is their own id. Rows without doc_id take no part and have no component. Repeated rows are one
class. Rows of one id with different sets are classes as any others; components are named by their
least id at the end, so two that share it have one name in ``component_id`` and two in ``comp``. A
very long text is shingled in one task. An empty table gives an empty one. Only ``doc_id`` and
``text`` are read, whatever other columns are named.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from granary.llm.common import map_batches, texts
from granary.llm.components import components
from granary.session import stage

WORDS, PERCENT = 5, 80
#: Sets of one group or block at most; signatures of one; least and most slots of a
#: signature; children of a node.
GROUP, SIGNED_GROUP, SLOTS, MOST_SLOTS, FANOUT = 512, 4096, 256, 1 << 14, 8
#: Shingles of one group or block at most; a longer set is alone with others that count no more.
MOST_SHINGLES = 1 << 22
#: Bits of a frequency counter's number; counters in one row.
COUNTER_BITS, CHUNK = 19, 1 << 13
COUNTERS = 1 << COUNTER_BITS
#: Bits of a place in the filter of ids at least and at most, and places for each id that it holds.
FILTER_BITS, MOST_FILTER_BITS, PLACES = 21, 27, 16
_COUNTS = "part int, chunk int, counts binary"
_P = np.uint64(0x9E3779B97F4A7C15)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingles(text: str) -> np.ndarray:
    """Distinct shingle hashes in ascending order. ``bytes.lower`` and ``bytes.split`` know ASCII
    letters and ASCII white space only, which is what a word is here."""
    import xxhash

    words = text.encode().lower().split()
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, n)
    k = min(n, WORDS)
    out = np.full(n - k + 1, k, np.uint64)
    for i in range(k):
        out = out * _P + h[i : n - k + 1 + i]
    return np.unique(_mixed(out))


def prefix_length(n: int) -> int:
    return n - -(-PERCENT * n // 100) + 1


def sketch(docs: DataFrame) -> np.ndarray:
    """Frequency level of each counter's shingles (log scale), over all documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(COUNTERS, np.int64)
        for batch in batches:
            slots = [(shingles(t) >> np.uint64(64 - COUNTER_BITS)).astype(np.int64) for t in texts(batch)]
            total += np.bincount(np.concatenate(slots), minlength=COUNTERS) if slots else 0
        yield _own(total)

    total = _merged(docs.select("text").mapInArrow(count, _COUNTS), np.int64, np.add)
    if not len(total):
        return np.zeros(COUNTERS, np.uint8)
    usual = max(float(np.median(total)), 1.0)
    return np.clip(np.round(4 * np.log2(np.maximum(total / usual, 1))), 0, 255).astype(np.uint8)


def slot_counts(s: np.ndarray, slots: int = SLOTS) -> np.ndarray:
    """Tokens by slot; of twice as many slots, two that are neighbours fall into one."""
    return np.bincount((s >> np.uint64(65 - slots.bit_length())).astype(np.int64), minlength=slots)


def signature(s: np.ndarray) -> bytes:
    """Tokens by slot, a byte each; a long set has more slots, so that they are about as full."""
    slots = SLOTS
    while slots * 4 < len(s) and slots < MOST_SLOTS:
        slots *= 2
    return np.minimum(slot_counts(s, slots), 255).astype(np.uint8).tobytes()


def unfolded(signatures: list[bytes]) -> np.ndarray:
    """Signatures as rows of as many slots as the shortest has; 255 stands for any number."""
    slots = min(map(len, signatures))
    out = np.zeros((len(signatures), slots), np.uint16)
    for i, b in enumerate(signatures):
        row = np.frombuffer(b, np.uint8).astype(np.int64)
        row[row == 255] = 65535
        out[i] = np.minimum(row.reshape(slots, -1).sum(1), 65535)
    return out


def digest(s: np.ndarray) -> bytes:
    import hashlib

    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def signed(docs: DataFrame, levels: np.ndarray) -> DataFrame:
    """``(doc_id, text_hash, n_shingles, digest, prefix, signature)``: the set's size, its 128-bit digest, its
    rarest shingles, enough to meet each similar set in one, and its tokens by slot."""

    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            sizes, digests, prefixes, signatures = [], [], [], []
            for t in texts(batch):
                s = shingles(t)
                sizes.append(len(s))
                if not len(s):
                    digests.append(None), prefixes.append([]), signatures.append(None)
                    continue
                digests.append(digest(s))
                order = np.lexsort((s, levels[(s >> np.uint64(64 - COUNTER_BITS)).astype(np.int64)]))
                prefixes.append(s[order[: prefix_length(len(s))]].view(np.int64))
                signatures.append(signature(s))
            columns = [batch.column("doc_id"), batch.column("text_hash"), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(prefixes, pa.list_(pa.int64())), pa.array(signatures, pa.binary())]
            return pa.RecordBatch.from_arrays(columns, ["doc_id", "text_hash", "n_shingles", "digest", "prefix", "signature"])

        return work

    return map_batches(docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash")), make, "doc_id bigint, text_hash bigint, n_shingles bigint, digest binary, prefix array<bigint>, signature binary")


class _Union:
    def __init__(self, start: list[int]):
        self.up = start

    def find(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i


def tree_links(slots: np.ndarray, sizes: np.ndarray, sets: list[np.ndarray] | None = None, start: list[int] | None = None) -> list[tuple[int, int]]:
    """Links that join the sets' components, by dual traversal of a signature tree. ``slots`` has
    each set's tokens by slot. Without ``sets``, pairs whose bound suffices count as linked.
    ``start`` gives each set the place of another that it is connected with already."""
    n = len(sizes)
    if n == 2 and sets is None:
        bound = min(int(np.minimum(slots[0], slots[1]).sum(dtype=np.int64)), int(min(sizes)))
        return [(0, 1)] if (100 + PERCENT) * bound >= PERCENT * int(sizes[0] + sizes[1]) else []
    order = np.lexsort((*slots.T[:4], sizes))
    union = _Union(list(range(n)) if start is None else list(start))
    level = slots[order]
    most, low, high = [level], [sizes[order]], [sizes[order]]
    while len(most[-1]) > 1:
        at = np.arange(0, len(most[-1]), FANOUT)
        most.append(np.maximum.reduceat(most[-1], at))
        low.append(np.minimum.reduceat(low[-1], at))
        high.append(np.maximum.reduceat(high[-1], at))
    links: list[tuple[int, int]] = []

    def one_component(k: int, a: int, b: int) -> bool:
        span = FANOUT**k
        root = union.find(order[a * span])
        return all(union.find(order[i]) == root for x in (a, b) for i in range(x * span, min((x + 1) * span, n)))

    stack = [(len(most) - 1, 0, 0)]
    while stack:
        k, a, b = stack.pop()
        if k == 0:
            i, j = int(order[a]), int(order[b])
            ri, rj = union.find(i), union.find(j)
            if ri != rj:
                both = 0 if sets is None else len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                if sets is None or 100 * both >= PERCENT * (sizes[i] + sizes[j] - both):
                    union.up[max(ri, rj)] = min(ri, rj)
                    links.append((i, j))
            continue
        if one_component(k, a, b):
            continue
        k -= 1
        xs = np.arange(a * FANOUT, min((a + 1) * FANOUT, len(low[k])))
        ys = np.arange(b * FANOUT, min((b + 1) * FANOUT, len(low[k])))
        bound = np.minimum(most[k][xs][:, None], most[k][ys][None]).sum(2, dtype=np.int64)
        bound = np.minimum(bound, np.minimum(high[k][xs][:, None], high[k][ys][None]))
        asked = PERCENT * (low[k][xs][:, None] + low[k][ys][None])
        fits = (100 + PERCENT) * bound >= asked
        fits &= (100 * high[k][xs][:, None] >= PERCENT * low[k][ys][None]) & (100 * high[k][ys][None] >= PERCENT * low[k][xs][:, None])
        for p, q in np.argwhere(fits)[::-1]:
            x, y = int(xs[p]), int(ys[q])
            if x < y or x == y and k:
                stack.append((k, x, y))
    return links


def _linked(groups: DataFrame, keys: list[str]) -> DataFrame:
    """Links ``(a, b)`` within groups. ``groups`` has the keys, ``rep``, ``comp`` and ``shingles``;
    a group is bounded by its makers."""

    def link(rows: pa.Table) -> pa.Table:
        reps, first, sets_, start, roots = [], {}, [], [], {}
        for rep, comp, packed in zip(*(rows.column(c).to_pylist() for c in ("rep", "comp", "shingles")), strict=True):
            if rep not in first:
                first[rep] = len(reps)
                start.append(roots.setdefault(comp, len(reps)))
                reps.append(rep)
                sets_.append(np.frombuffer(packed, np.uint64))
        slots = np.array([np.minimum(slot_counts(x), 65535) for x in sets_], np.uint16)
        found = tree_links(slots, np.array([len(x) for x in sets_]), sets_, start)
        return pa.table({"a": pa.array([reps[i] for i, _ in found], pa.int64()), "b": pa.array([reps[j] for _, j in found], pa.int64())})

    return groups.select(*keys, "rep", "comp", "shingles").groupBy(*keys).applyInArrow(link, "a bigint, b bigint")


def _possible(lists: DataFrame, signatures: DataFrame) -> DataFrame:
    """Pairs ``(a, b)`` that connect what signatures can't tell apart in each of ``lists(list, rep)``;
    many lists are joined in one task's turn, so many that a turn has some thousand rows."""
    turns = max(1, lists.count() // 8192)

    def link(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("list")
        signatures_ = rows.column("signature").to_pylist()
        sizes, reps, ids = (rows.column(c).to_numpy() for c in ("n", "rep", "list"))
        ends = [*(np.flatnonzero(ids[1:] != ids[:-1]) + 1).tolist(), len(ids)]
        found, start = [], 0
        for end in ends:
            found += [(start + i, start + j) for i, j in tree_links(unfolded(signatures_[start:end]), sizes[start:end])]
            start = end
        at = np.array(found, np.int64).reshape(-1, 2)
        return pa.table({"a": pa.array(reps[at[:, 0]], pa.int64()), "b": pa.array(reps[at[:, 1]], pa.int64())})

    rows = lists.join(signatures, "rep").select(F.pmod("list", F.lit(turns)).alias("turn"), "list", "rep", "n", "signature")
    return rows.groupBy("turn").applyInArrow(link, "a bigint, b bigint")


def _merged(rows: DataFrame, dtype: type, merge: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """Arrays of fixed size, ``(part, chunk, counts)`` from each task, merged in two steps, so that
    no group grows with the tasks."""

    def add(rows: pa.Table) -> pa.Table:
        total = reduce(merge, (np.frombuffer(b, dtype) for b in rows.column("counts").to_pylist()))
        return pa.table({"part": pa.array([rows.column("part")[0].as_py()], pa.int32()), "chunk": pa.array([rows.column("chunk")[0].as_py()], pa.int32()), "counts": pa.array([total.tobytes()], pa.binary())})

    once = rows.groupBy("part", "chunk").applyInArrow(add, _COUNTS)
    chunks = once.groupBy("chunk").applyInArrow(add, _COUNTS).toArrow().sort_by("chunk")
    return np.frombuffer(b"".join(chunks.column("counts").to_pylist()), dtype)


def _own(total: np.ndarray) -> pa.RecordBatch:
    from pyspark import TaskContext

    rows = [total[i : i + CHUNK].tobytes() for i in range(0, len(total), CHUNK)]
    part = TaskContext.get().partitionId() % 1024
    return pa.RecordBatch.from_arrays([pa.array([part] * len(rows), pa.int32()), pa.array(range(len(rows)), pa.int32()), pa.array(rows, pa.binary())], ["part", "chunk", "counts"])


def _places(ids: np.ndarray, bits: int) -> np.ndarray:
    """Two places of an id in a filter."""
    h = _mixed(ids.astype(np.int64).view(np.uint64) * _P)
    return np.stack([h >> np.uint64(64 - bits), h & np.uint64((1 << bits) - 1)], 1).astype(np.int64)


def filter_bits(n: int) -> int:
    """Bits of a place in a filter of ``n`` ids."""
    return min(max((PLACES * n).bit_length(), FILTER_BITS), MOST_FILTER_BITS)


def _holding(ids: DataFrame, n: int) -> np.ndarray:
    """A filter of ``n`` ids, eight places a byte, made in the tasks."""
    bits = filter_bits(n)

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(1 << bits, bool)
        for batch in batches:
            seen[_places(batch.column(0).to_numpy(), bits).ravel()] = True
        yield _own(np.packbits(seen))

    merged = _merged(ids.mapInArrow(mark, _COUNTS), np.uint8, np.bitwise_or)
    return merged if len(merged) else np.zeros(1 << bits >> 3, np.uint8)


def _held(ids: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """False for ids that a filter doesn't hold; True for the others, and for a few it doesn't."""
    at = _places(ids, (len(seen) << 3).bit_length() - 1)
    return (seen[at >> 3] << (at & 7).astype(np.uint8) & 128 > 0).all(1)


def _sets(docs: DataFrame, reps: DataFrame) -> DataFrame:
    """Shingles of the classes, one row each, from the text of their least id, beside the other columns
    of ``reps``.

    A filter drops most other documents before anything moves; the join decides. The filter grows
    with the classes up to a bound (16 MiB, at which it drops nine in ten others of 25 million classes); beyond it
    more texts are moved. Texts rather than shingles are moved, as they are shorter; those that repeat
    go once.
    """
    filled = docs.sparkSession.sparkContext.broadcast(_holding(reps.select("least"), reps.count()))

    def pick():
        seen = filled.value
        return lambda batch: batch.filter(pa.array(_held(batch.column("doc_id").to_numpy(), seen)))

    def cut():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            sets = [shingles(t) for t in texts(batch)]
            same = [digest(s) == d for s, d in zip(sets, batch.column("digest").to_pylist(), strict=True)]
            columns = [*(batch.column(c) for c in ("rep", "component", "bulk")), pa.array([s.tobytes() for s in sets], pa.binary())]
            return pa.RecordBatch.from_arrays(columns, ["rep", "component", "bulk", "shingles"]).filter(pa.array(same, pa.bool_()))

        return work

    rows = docs.where("doc_id IS NOT NULL").select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    once = map_batches(rows, pick, "doc_id bigint, text string, text_hash bigint").groupBy("doc_id", "text_hash").agg(F.first("text").alias("text"))
    found = once.join(reps, (F.col("doc_id") == F.col("least")) & (F.col("text_hash") == F.col("least_hash")))
    return map_batches(found.select("text", "digest", "rep", "component", "bulk"), cut, "rep bigint, component bigint, bulk double, shingles binary")


def _share(group: int) -> Column:
    """What a set takes of a block."""
    return F.lit(1.0 / group) + F.col("n") / float(MOST_SHINGLES)


def _large_links(shared: DataFrame, sets: DataFrame, group: int) -> DataFrame:
    """Links among sets of groups that are too large for one task; ``shared(token, rep, n)``."""
    picks = [F.min(F.struct(F.xxhash64("token", F.lit(k)), "token"))["token"].alias(f"t{k}") for k in range(3)]
    chosen = shared.groupBy("rep", "n").agg(*picks).select("rep", "n", F.posexplode(F.array("t0", "t1", "t2")).alias("k", "token"))
    counted = chosen.join(chosen.groupBy("k", "token").agg(F.sum(_share(group)).alias("bulk")), ["k", "token"])
    blocks = counted.select("k", "token", F.pmod(F.xxhash64("rep", "k"), F.ceil("bulk")).alias("block"), "rep", F.col("rep").alias("comp"))
    first = stage(_linked(blocks.join(sets, "rep"), ["k", "token", "block"]), "links-a")

    known = shared.join(components(first).withColumnRenamed("id", "rep"), "rep", "left").select("token", "rep", "n", F.coalesce("component", "rep").alias("comp"))
    known = stage(known.distinct(), "links-known")
    by_comp = known.groupBy("token", "comp").agg(F.sum(_share(group)).alias("bulk"))
    mixed = by_comp.groupBy("token").agg(F.count(F.lit(1)).alias("comps"), F.sum("bulk").alias("bulk_all"), F.max(F.struct("bulk", "comp")).alias("main")).where("comps > 1")
    minors = F.greatest(F.ceil((F.col("bulk_all") - F.col("main.bulk")) * 2), F.lit(1))
    mixed = mixed.select("token", F.col("main.comp").alias("main"), minors.alias("minors"), F.ceil(F.col("bulk_all") * 2).alias("alls"))
    rows = known.join(mixed, "token")
    where = lambda parts: F.pmod(F.xxhash64("rep", "token"), parts)
    every = F.sequence(F.lit(0), F.col("minors") - 1)
    right = rows.select("token", F.explode(every).alias("i"), where(F.col("alls")).alias("j"), "rep", "comp")
    left = rows.where("comp <> main").select("token", where(F.col("minors")).alias("i"), F.explode(F.sequence(F.lit(0), F.col("alls") - 1)).alias("j"), "rep", "comp")
    return first.union(_linked(left.unionByName(right).join(sets, "rep"), ["token", "i", "j"]))


def _runs(tokens: DataFrame) -> DataFrame:
    """``(token, rep, n, head)`` of sets that meet in a token where similarity is possible. ``pos`` is a
    token's place in the set's order. If it's the first that two similar sets share, they share no
    more than the ``n - pos`` from there on, which bounds the size of the other set. In order of
    size, a token's sets are cut where no set before reaches the size. All windows use one shuffle
    by token."""
    reach = F.floor((100 + PERCENT) * (F.col("n") - F.col("pos")) / PERCENT + 1e-9) - F.col("n")
    order = Window.partitionBy("token").orderBy("n", "rep")
    reached = F.max("reach").over(order.rowsBetween(Window.unboundedPreceding, -1))
    far = tokens.select("token", "rep", "n", reach.alias("reach")).withColumn("far", F.coalesce(reached < F.col("n"), F.lit(True)))
    cut = far.withColumn("last", F.coalesce(F.lead("far").over(order), F.lit(True))).where("NOT (far AND last)").withColumn("run", F.sum(F.col("far").cast("int")).over(order))
    whole = Window.partitionBy("token", "run")
    runs = cut.withColumn("head", F.min("rep").over(whole)).withColumn("tail", F.max("rep").over(whole)).where("head <> tail")
    return runs.select(F.xxhash64("token", "run").alias("token"), "rep", "n", "head")


def join_similar(docs: DataFrame, group: int = GROUP, signed_group: int = SIGNED_GROUP) -> DataFrame:
    """``(doc_id, n_shingles, component_id)``, one row a row of ``docs``."""
    return linked(docs, group, signed_group).select("doc_id", "n_shingles", "component_id")


def linked(docs: DataFrame, group: int = GROUP, signed_group: int = SIGNED_GROUP) -> DataFrame:
    """What ``join_similar`` gives, with ``text_hash`` and ``comp``, which tells all components apart."""
    docs = docs.select("doc_id", "text")
    rows = stage(signed(docs, sketch(docs)), "similar-rows")
    # Rows of one digest have the same set, so any of them gives the class its prefix and signature.
    own = [F.first(c).alias(c) for c in ("prefix", "signature")]
    first = F.min(F.struct("doc_id", "text_hash")).alias("first")
    classes = rows.where("digest IS NOT NULL AND doc_id IS NOT NULL").groupBy("digest").agg(first, F.first("n_shingles").alias("n"), *own)
    classes = classes.select("digest", F.col("first.doc_id").alias("least"), F.col("first.text_hash").alias("least_hash"), "n", "prefix", "signature")
    classes = stage(classes.withColumn("rep", F.monotonically_increasing_id()), "similar-classes")
    reps = classes.drop("digest", "least", "least_hash")
    shared = stage(_runs(reps.select("rep", "n", F.posexplode("prefix").alias("pos", "token"))), "similar-shared")

    # By signatures.
    counted = shared.groupBy("token").agg(F.count(F.lit(1)).alias("size"))
    over = counted.where(F.col("size") > signed_group).select("token")
    members = shared.join(counted.where(F.col("size") <= signed_group), "token").groupBy("token").agg(F.sort_array(F.collect_set("rep")).alias("members"))
    lists = members.select("members").distinct().select(F.xxhash64("members").alias("list"), F.explode("members").alias("rep"))
    possible = _possible(stage(lists, "similar-lists"), reps.drop("prefix"))
    beyond = shared.join(over, "token", "left_semi").select(F.col("rep").alias("a"), F.col("head").alias("b"))

    # By shingles.
    near = components(possible.union(beyond)).withColumnRenamed("id", "rep")
    near = near.join(classes.select("rep", "n", "least", "least_hash", "digest"), "rep")
    bulks = near.groupBy("component").agg(F.sum(_share(group)).alias("bulk"))
    near = stage(near.drop("n").join(bulks, "component"), "similar-near")
    sets = stage(_sets(docs, near), "similar-sets")
    links = stage(_linked(sets.where("bulk <= 1.000001").withColumn("comp", F.col("rep")), ["component"]), "links")
    large = near.where("bulk > 1.000001").select("rep")
    if not large.isEmpty():
        links = links.union(_large_links(shared.join(large, "rep", "left_semi").select("token", "rep", "n"), sets.where("bulk > 1.000001").select("rep", "shingles"), group))
    found = components(links).withColumnRenamed("id", "rep")
    named = classes.select("digest", "rep", "least").join(found, "rep", "left").withColumn("comp", F.coalesce("component", "rep"))
    names = named.where("component IS NOT NULL").groupBy("comp").agg(F.min("least").alias("name"))
    named = named.join(names, "comp", "left").select("digest", "comp", F.coalesce("name", "least").alias("component_id"))
    joined = rows.select("doc_id", "text_hash", "n_shingles", "digest").join(named, "digest", "left")
    own = F.when(F.col("digest").isNull(), F.col("doc_id")).when(F.col("doc_id").isNotNull(), F.col("component_id"))
    return joined.select("doc_id", "n_shingles", own.alias("component_id"), "text_hash", "comp")
