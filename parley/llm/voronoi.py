"""Exact linking inside overlapping regions of a metric space, with pivots and triangle-inequality windows.

Input are regions (any two ids that may link share one) and a signature per id whose distance is a metric that never
exceeds the true one. In a region the first id is a pivot; ids within the radius form its Voronoi cell, ids in the window
between one and two radii are the boundary that may link across cells, ids beyond two radii cannot link into the cell.
The rest is divided again with the next pivot. Each id is first verified against its pivot only. Where a verification
fails, or a boundary id is near a cell's members, the region is visited again: an id of a smaller component is verified
with the nearest members of the larger ones, four at first and sixteen times as many in each further visit, until no pair
of different components is left that may link. So components are exact, yet a group of g mutual copies costs g
verifications, and what is emitted grows with the ids that are outside the largest component of their region.
Regions of more than BLOCK ids are dealt as blocks that share the region's pivot; then only the ids outside the region's
largest component go to every block.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.llm import textkit as T
from parley.llm.components import components
from parley.llm.scratch import Scratch, only

#: A region with more ids is dealt as blocks of about this many.
BLOCK = 20_000
#: Partners an id is verified with in the first visit of a region; each further visit takes sixteen times as many.
PARTNERS = 4
#: Pivots taken from each region before it is left to the visits.
ROUNDS = 64
#: Rows of regions that are sorted at once to find those with several ids.
PART = 1 << 18
#: Bytes of signatures of pairs that a task compares at once.
PAIR_BYTES = 4 << 20

Lower = Callable[[np.ndarray, np.ndarray], np.ndarray]


class Gate(NamedTuple):
    """What else tells, from further bytes of the signatures, that near rows cannot link, and a quicker search of near rows.

    width: bytes behind those of the distance; may(x, y): whether such bytes of rows may belong to a pair that links;
    place(sig): a number of which the rows of a near pair differ by the radius at most.
    """

    width: int
    may: Callable[[np.ndarray, np.ndarray], np.ndarray]
    place: Callable[[np.ndarray], np.ndarray]


def _near(sig: np.ndarray, more: np.ndarray | None, x: np.ndarray, y: np.ndarray, lower: Lower, radius: float, gate: Gate | None) -> tuple[np.ndarray, np.ndarray]:
    """(distances of rows x to y, which of them may link)."""
    d = lower(sig[x], sig[y])
    near = d <= radius
    if gate is not None:
        some = np.flatnonzero(near)
        near[some] = gate.may(more[x[some]], more[y[some]])
    return d, near


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Batches cut at region boundaries: (rows, first row of each region and the end)."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        region = batch.column(0).to_numpy()
        if held and region[-1] == held[0].column(0)[-1 if len(held) == 1 else 0].as_py() and region[0] == region[-1]:
            held.append(batch)
            continue
        cut = int(np.searchsorted(region != region[-1], False)) if region[0] == region[-1] else int(np.flatnonzero(region != region[-1])[-1]) + 1
        ready = [*held, batch.slice(0, cut)]
        yield from _whole(ready)
        held = [batch.slice(cut)]
    yield from _whole(held)


def _whole(parts: list[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    parts = [p for p in parts if p.num_rows]
    if not parts:
        return
    rows = parts[0] if len(parts) == 1 else pa.Table.from_batches(parts).combine_chunks().to_batches(max_chunksize=None)[0]
    region = rows.column(0).to_numpy()
    yield rows, np.concatenate([[0], np.flatnonzero(region[1:] != region[:-1]) + 1, [len(region)]])


def _crossing(near: np.ndarray, window: np.ndarray, d_near: np.ndarray, d_window: np.ndarray, group: np.ndarray, sig: np.ndarray, lower: Lower, radius: float, more: np.ndarray | None = None, gate: Gate | None = None) -> np.ndarray:
    """Boundary rows that are near a member of the cell; of a cell only members far enough out are compared."""
    shared = np.intersect1d(group[near], group[window])
    found = []
    if len(shared):
        closest = np.full(int(group.max()) + 1, np.inf)
        np.minimum.at(closest, group[window], d_window)
        inner = near[d_near >= closest[group[near]] - radius]
        starts, stops = np.searchsorted(group[inner], group[window]), np.searchsorted(group[inner], group[window], "right")
        counts = stops - starts
        lo, some = 0, max(1, PAIR_BYTES // (sig.shape[1] + (gate.width if gate else 0)))
        while lo < len(window):
            hi = max(lo + 1, lo + int(np.searchsorted(np.cumsum(counts[lo:]), some, "right")))
            n = counts[lo:hi]
            if n.sum():
                y = np.repeat(window[lo:hi], n)
                x = inner[np.repeat(starts[lo:hi], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
                found.append(y[_near(sig, more, x, y, lower, radius, gate)[1]])
            lo = hi
    return np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)


def _stars(at: np.ndarray, sig: np.ndarray, lower: Lower, radius: float, more: np.ndarray | None = None, gate: Gate | None = None):
    """(member, pivot) rows of the cells of all groups at once, and which groups have a boundary row near another cell.

    Such a boundary row is given as its own pivot too, as it may be in no cell.
    """
    group = np.repeat(np.arange(len(at) - 1), np.diff(at))
    crossing = np.zeros(len(at) - 1, dtype=bool)
    alive, members, pivots = np.flatnonzero(np.repeat(np.diff(at) > 1, np.diff(at))), [], []
    for _ in range(ROUNDS):
        if not len(alive):
            break
        g = group[alive]
        new = np.ones(len(alive), dtype=bool)
        new[1:] = g[1:] != g[:-1]
        pivot = alive[np.flatnonzero(new)[np.cumsum(new) - 1]]
        rest, pivot = alive[~new], pivot[~new]
        d, near = _near(sig, more, rest, pivot, lower, radius, gate)
        window = ~near & (d <= 2 * radius)
        members.append(rest[near])
        pivots.append(pivot[near])
        if window.any() and near.any():
            across = _crossing(rest[near], rest[window], d[near], d[window], group, sig, lower, radius, more, gate)
            crossing[group[across]] = True
            members.append(across)
            pivots.append(across)
        alive = rest[~near]
    if len(alive):  # regions of very many cells: what is left is searched in the visits
        crossing[group[alive]] = True
        members.append(alive)
        pivots.append(alive)
    return np.concatenate(members) if members else alive, np.concatenate(pivots) if pivots else alive, crossing, group


def _parted(column: pa.Array, width: int, gate: Gate | None) -> tuple[np.ndarray, np.ndarray | None]:
    """Signatures as bytes of the distance and bytes of the gate."""
    if gate is None:
        return T.matrix(column, width), None
    both = T.matrix(column, width + gate.width)
    return np.ascontiguousarray(both[:, :width]), np.ascontiguousarray(both[:, width:])


def _star_task(lower: Lower, width: int, radius: float, gate: Gate | None = None):
    def run(batches):
        for rows, at in _groups(batches):
            region, ids, (sig, further) = rows.column(0).to_numpy(), rows.column(1).to_numpy(), _parted(rows.column(2), width, gate)
            member, pivot, crossing, group = _stars(at, sig, lower, radius, further, gate)
            if len(member):
                yield pa.RecordBatch.from_arrays([pa.array(region[member]), pa.array(ids[member]), pa.array(ids[pivot]), pa.array(crossing[group[member]])], names=["region", "a", "b", "crossing"])

    return run


def _across(at: np.ndarray, sig: np.ndarray, label: np.ndarray, lower: Lower, radius: float, partners: int, further: np.ndarray | None = None, gate: Gate | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Near pairs of rows with different labels in each of many regions, as (rows, partners, whether some were left for later).

    Rows meet only inside the window of their distances to the first row of their region, or of the gate's places, in whose
    order they are looked up then. A row meets rows of labels that
    are more frequent than its own: the nearest row of each label first, `partners` rows at most.
    """
    region = np.repeat(np.arange(len(at) - 1), np.diff(at))
    order = np.lexsort((label, region))
    new = np.ones(len(order), dtype=bool)
    new[1:] = (label[order][1:] != label[order][:-1]) | (region[1:] != region[:-1])
    cut = np.flatnonzero(new)
    many = np.empty(len(order), np.int64)
    many[order] = np.repeat(np.diff(np.append(cut, len(order))), np.diff(np.append(cut, len(order))))
    order = np.lexsort((label, many, region))  # rare labels first: a row's partners are the rows behind its label's
    new[1:] = (label[order][1:] != label[order][:-1]) | (region[1:] != region[:-1])
    run = np.cumsum(new) - 1
    behind, end = np.append(np.flatnonzero(new)[1:], len(order))[run], at[1:][region]
    if gate is None:
        pivot = lower(sig[order], sig[at[:-1]][region]) if len(at) * 2 > len(order) else np.concatenate([lower(sig[order[lo:hi]], sig[lo : lo + 1]) for lo, hi in zip(at[:-1], at[1:])])
        start, n = behind, end - behind
    else:  # rows by region and place, so that a window is a stretch
        place = gate.place(sig[order]).astype(np.float64)
        place += region * (place.max(initial=0) - place.min(initial=0) + 2 * radius)
        by_place = np.argsort(place, kind="stable")
        start, stop = np.searchsorted(place[by_place], place - radius - 1e-3), np.searchsorted(place[by_place], place + radius + 1e-3)
        n = np.where(behind < end, stop - start, 0)
    sofar, lo, some = np.cumsum(n), 0, max(1, PAIR_BYTES // (sig.shape[1] + (gate.width if gate else 0)))
    while lo < len(order):
        hi = max(lo + 1, int(np.searchsorted(sofar, (sofar[lo - 1] if lo else 0) + some, "right")))
        x = np.repeat(np.arange(lo, hi), n[lo:hi])
        y = np.arange(len(x)) - np.repeat(np.cumsum(n[lo:hi]) - n[lo:hi], n[lo:hi]) + start[x]
        lo = hi
        if gate is None:
            inside = np.abs(pivot[x] - pivot[y]) <= radius + 1e-9
        else:
            y = by_place[y]
            inside = y >= behind[x]
        x, y = x[inside], y[inside]
        gap, near = _near(sig, further, order[x], order[y], lower, radius, gate)
        x, y, gap = x[near], y[near], gap[near]
        if not len(x):
            continue
        first = np.searchsorted(x, x)
        more = np.searchsorted(x, x, "right") - first > partners
        if more.any():
            by = np.lexsort((gap, run[y], x))
            other = np.ones(len(by), dtype=bool)
            other[1:] = (run[y[by]][1:] != run[y[by]][:-1]) | (x[1:] != x[:-1])
            place = np.flatnonzero(other)
            turn = np.arange(len(by)) - place[np.cumsum(other) - 1]  # place among the rows of one label
            by = by[np.lexsort((gap[by], turn, x))]
            kept = np.arange(len(by)) - first < partners
            x, y, more = x[kept], y[by[kept]], more[kept]
        yield order[x], order[y], more


def _across_task(lower: Lower, width: int, radius: float, partners: int, gate: Gate | None = None):
    def run(batches):
        for rows, at in _groups(batches):
            region, ids, label, (sig, further) = rows.column(0).to_numpy(), rows.column(1).to_numpy(), rows.column(3).to_numpy(), _parted(rows.column(2), width, gate)
            for x, y, more in _across(at, sig, label, lower, radius, partners, further, gate):
                a, b = np.maximum(ids[x], ids[y]), np.minimum(ids[x], ids[y])
                yield pa.RecordBatch.from_arrays([pa.array(region[x]), pa.array(a), pa.array(b), pa.array(more)], names=["region", "a", "b", "more"])

    return run


#: One id in so many tells which regions are larger than a block.
SAMPLE = 64


def _shared(members: DataFrame) -> DataFrame:
    """Regions of two or more ids; of regions with the same ids, as the sums of three 32-bit hashes tell, only one."""
    own = [F.sum(F.expr(f"xxhash64(id, {seed}) & 4294967295")).alias(f"h{seed}") for seed in (1, 2, 3)]
    sizes = members.groupBy("region").agg(F.count("*").alias("n"), *own).where("n > 1")
    return members.join(sizes.groupBy("n", "h1", "h2", "h3").agg(F.min("region").alias("region")).select("region"), "region")


def _repeated_task(batches):
    """Rows of sorted regions whose region has another row; only the last row is held from batch to batch."""
    names, held = ["region", "id"], None
    for batch in batches:
        if not batch.num_rows:
            continue
        region, ids = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        if held is not None:
            region, ids = np.concatenate([held[0], region]), np.concatenate([held[1], ids])
        same = region[1:] == region[:-1]
        again = np.zeros(len(region), dtype=bool)
        again[1:] = same
        again[:-1] |= same
        if held is not None:
            again[0] |= held[2]
        # the last row waits for the next batch, with whether it is known to be one of several
        yield pa.RecordBatch.from_arrays([pa.array(region[:-1][again[:-1]]), pa.array(ids[:-1][again[:-1]])], names=names)
        held = (region[-1:].copy(), ids[-1:].copy(), bool(again[-1]))
    if held is not None and held[2]:
        yield pa.RecordBatch.from_arrays([pa.array(held[0]), pa.array(held[1])], names=names)


def _pack_task(parts: int):
    """Rows (region, id) as one row for each part of the regions in a batch, its bytes the pairs of numbers."""

    def run(batches):
        for batch in batches:
            both = np.stack([batch.column("region").to_numpy(), batch.column("id").to_numpy()], axis=1)
            part = (T.mix(both[:, 0].view(np.uint64)) % T.U(parts)).astype(np.int32)
            order = np.argsort(part, kind="stable")
            some, first = np.unique(part[order], return_index=True)
            at = np.append(first, len(part)).astype(np.int32) * both.dtype.itemsize * 2
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.Array.from_buffers(pa.binary(), len(some), [None, pa.py_buffer(at), pa.py_buffer(both[order])])], names=["part", "rows"])

    return run


def _unpack_task(batches):
    """Rows of the parts whose region has another row, a part at a time."""
    for rows, at in _groups(batches):
        _, offsets, data = rows.column(1).buffers()
        place = np.frombuffer(offsets, np.int32)[rows.column(1).offset :]
        for lo, hi in zip(at[:-1], at[1:]):
            both = np.frombuffer(data, np.int64, (place[hi] - place[lo]) // 8, place[lo]).reshape(-1, 2)
            order = np.argsort(both[:, 0], kind="stable")
            region, again = both[order, 0], np.zeros(len(order), dtype=bool)
            again[1:] = region[1:] == region[:-1]
            again[:-1] |= again[1:].copy()
            yield pa.RecordBatch.from_arrays([pa.array(region[again]), pa.array(both[order[again], 1])], names=["region", "id"])


def repeated(members: DataFrame, scratch: Scratch, rows: int | None = None) -> DataFrame:
    """Rows of `members` (region, id; ids once per region) whose region has two or more ids, written.

    A sample tells regions of more than about BLOCK ids; their rows stay where they are, only the rest is dealt by region,
    packed, in parts of about PART rows that are sorted one by one. rows: how many there are about.
    """
    large = scratch.write(_sampled(members).select("region"), "large")
    split = not large.isEmpty()
    rest = members.join(F.broadcast(large), "region", "left_anti") if split else members  # a row for BLOCK ids at least
    parts = 1 + (members.count() if rows is None else rows) // PART
    packed = rest.select("region", "id").mapInArrow(_pack_task(parts), "part int, rows binary")
    several = packed.repartition("part").sortWithinPartitions("part").mapInArrow(_unpack_task, "region long, id long")
    out = scratch.write(several.union(members.join(F.broadcast(large), "region").select("region", "id")) if split else several, "several")
    scratch.drop(large)
    return out


def _sampled(seen: DataFrame) -> DataFrame:
    """(region, n): regions of more than about BLOCK ids, with their ids in the sample."""
    return seen.where(F.pmod(F.xxhash64("id", F.lit(7)), F.lit(SAMPLE)) == 0).groupBy("region").agg(F.count("*").alias("n")).where(F.col("n") * SAMPLE > BLOCK)


def _block(blocks):
    return F.xxhash64("region", F.pmod(F.xxhash64("id"), blocks))


def _dealt(seen: DataFrame, large: DataFrame) -> DataFrame:
    """Large regions as blocks that all hold the smallest id of the region, which so is their first pivot."""
    large = F.broadcast(large)  # a row for BLOCK ids at least
    own = seen.join(large, "region", "left")
    pivots = seen.join(large, "region").groupBy("region", "blocks").agg(F.min(F.struct("id", "sig")).alias("p"))
    lent = pivots.select("region", F.col("p.id").alias("id"), F.col("p.sig").alias("sig"), "blocks", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"))
    lent = lent.where(F.col("block") != F.pmod(F.xxhash64("id"), F.col("blocks"))).select(F.xxhash64("region", "block").alias("region"), "id", "sig")
    return own.select(F.when(F.col("blocks").isNull(), F.col("region")).otherwise(_block(F.col("blocks"))).alias("region"), "id", "sig").union(lent)


def _left_of_large(members: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows of large regions by block: an id of the region's largest component once, every other id in every block."""
    named = members.join(labels, "id", "left").withColumn("label", F.coalesce("label", "id"))
    counts = named.groupBy("region", "label").agg(F.count("*").alias("k"))
    largest = counts.groupBy("region").agg(F.max_by("label", F.struct("k", "label")).alias("most"), F.count("*").alias("labels")).where("labels > 1")
    every = F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda j: F.xxhash64("region", j))
    places = F.when(F.col("label") == F.col("most"), F.array(_block(F.col("blocks")))).otherwise(every)
    return named.join(F.broadcast(largest), "region").select(F.explode(places).alias("region"), "id", "sig", "label")  # a row for each large region


def link(members: DataFrame, signatures: DataFrame, verify: Callable[[DataFrame], DataFrame], lower: Lower, width: int, radius: float, scratch: Scratch, partners: int = PARTNERS, rows: int = 1000, gate: Gate | None = None) -> DataFrame:
    """(id, label) for all ids with a link; ids without one are absent.

    members: (region, id), ids once per region, or (region, id, sig) if signatures are short; signatures: (id, sig binary
    of `width` bytes); verify: from pairs (a, b) to those that link. lower(x, y) bounds the distances of rows of x to those
    of y (or to the only one) from below and is a metric itself. rows: pairs that a Python task of `verify` gets at once.
    gate: signatures are longer by its width, and near pairs that it rules out are not verified.
    """
    seen = members.select("region", "id", "sig") if "sig" in members.columns else _shared(members).join(signatures, "id").select("region", "id", "sig")
    large = scratch.write(_sampled(seen).select("region", F.ceil(F.col("n") * SAMPLE / BLOCK).alias("blocks")), "large")
    split = not large.isEmpty()
    dealt = _dealt(seen, large) if split else seen
    stars = scratch.write(dealt.repartition("region").sortWithinPartitions("region", "id").mapInArrow(_star_task(lower, width, radius, gate), "region long, a long, b long, crossing boolean"), "stars")
    tried = scratch.write(stars.where("a <> b").select("a", "b").distinct(), "tried")
    labels = components(links := scratch.write(verify(tried).select("a", "b"), "links", rows), scratch)
    failed = stars.join(labels.select(F.col("id").alias("a"), F.col("label").alias("la")), "a", "left").join(labels.select(F.col("id").alias("b"), F.col("label").alias("lb")), "b", "left")
    again = scratch.write(failed.where("crossing or coalesce(la, a) <> coalesce(lb, b)").select("region").distinct(), "revisited")
    # an id that is near none of its region is in no row of stars and need not come again
    near = stars.join(again, "region")
    near = near.select("region", F.col("a").alias("id")).union(near.select("region", F.col("b").alias("id"))).distinct()
    left = scratch.write(near.join(only(signatures, near.select("id"), "id"), "id").select("region", "id", "sig"), "again")
    of_large = scratch.write(seen.join(F.broadcast(large), "region"), "members") if split else None
    scratch.drop(stars, again, large)
    while True:
        named = left.join(labels, "id", "left").select("region", "id", "sig", F.coalesce("label", "id").alias("label"))
        named = named.union(_left_of_large(of_large, labels)) if split else named
        found = scratch.write(named.repartition("region").sortWithinPartitions("region", "id").mapInArrow(_across_task(lower, width, radius, partners, gate), "region long, a long, b long, more boolean"), "found")
        new = scratch.write(found.select("a", "b").distinct().join(tried, ["a", "b"], "left_anti"), "pairs")
        nothing, done = new.isEmpty(), found.where("more").isEmpty()
        if nothing and done:
            break
        if not nothing:
            more = scratch.write(verify(new).select("a", "b"), "links", rows)
            known = scratch.write(tried.union(new), "tried")
            scratch.drop(tried, new)
            tried = known
            if not more.isEmpty():
                # a link of components, so that each round works on labels and new links only
                merged = scratch.write(labels.select(F.col("id").alias("a"), F.col("label").alias("b")).where("a <> b").union(more), "links")
                scratch.drop(labels)
                labels = components(merged, scratch)
                scratch.drop(merged)
            scratch.drop(more)
        if done:  # every near pair of different labels is tried now
            break
        # of the other regions every near pair of different labels is tried now
        shrunk = scratch.write(left.join(found.where("more").select("region").distinct(), "region", "left_semi"), "again")
        scratch.drop(left, found)
        left, partners = shrunk, partners * 16
    scratch.drop(left, found, new, tried, links, *([of_large] if split else []))
    return labels
