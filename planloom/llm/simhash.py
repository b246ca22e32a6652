"""Near-duplicate groups by SimHash, found with a generalised pigeonhole index.

A fingerprint of 64 bits is the majority of the hashes of a text's word shingles. Two fingerprints link
when they differ in ``RADIUS`` bits or fewer. To find all links:

1. Correlated bits are grouped into the same part, from the bits' correlations over all fingerprints, so
   that the parts are as independent of each other as possible. There are about
   64 / log2(fingerprints) parts.
2. Each fingerprint gets a threshold per part. By the pigeonhole principle, if the thresholds plus one
   add up to ``RADIUS + 1``, any fingerprint within the radius is within the threshold in one part at
   least. A dynamic program over the parts picks the thresholds with the fewest expected candidates plus
   probes; the candidates of a value are counted from histograms of the parts over all fingerprints.
   Frequent values thus get a low threshold, or none.
3. Each fingerprint is indexed under its value in each part and probes all values within its
   thresholds. Index entries and probes meet by part and value and are verified by their distance.
   A value with more than ``BLOCK`` entries is split into blocks, which the probes visit all.
4. What a task has verified is reduced to the smallest fingerprint of each local group before it leaves,
   so a dense group of many near copies gives as many links as it has members, not their pairs.

Equal fingerprints are one node from the start, with map-side combined counts, and components of nodes
are found by :func:`planloom.llm.components.components`.

Defined results: null and empty texts have fingerprint zero and are linked like any others; rows of one
text share a group; a null doc_id is no component_id unless the whole group has none; an empty table
gives an empty result; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations
from math import log2

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planloom.llm.common import lowered, mix, stored
from planloom.llm.components import components

BITS = 64
SHINGLE = 4
RADIUS = 4
SEED = 42
BLOCK = 20_000
HISTOGRAM_BITS = 16
# A probe costs about as much as this many candidates.
PROBE_COST = 3.0
PAIRS_AT_ONCE = 1 << 20


def fingerprint(words: list[bytes], shingle: int) -> int:
    """Bits set in over half of the hashes of the words' shingles."""
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.r_[0, ends[:-1] + 1]
    size = min(shingle, len(words))
    digest = xxhash.xxh64_intdigest
    spans = zip(starts[: len(words) - size + 1].tolist(), ends[size - 1 :].tolist())
    hashes = np.array([digest(joined[a:b], SEED) for a, b in spans], np.uint64)
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 15):
        part = hashes[at : at + (1 << 15)].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def _fingerprints(shingle: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, data = lowered(batch.column("text"))
            prints = [fingerprint(data[a:b].split(), shingle) for a, b in zip(offsets[:-1], offsets[1:])]
            column = pa.array(np.array(prints, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), column], ["doc_id", "fingerprint"])

    return run


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """``doc_id, fingerprint`` of each row."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return texts.mapInArrow(_fingerprints(shingle), "doc_id long, fingerprint long")


# -- statistics of all fingerprints --------------------------------------------------


def _unpacked(prints: np.ndarray) -> np.ndarray:
    return np.unpackbits(prints.astype("<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def _together(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How often each pair of bits is set together, per task; the last entry counts fingerprints."""
    total = np.zeros(BITS * BITS + 1, np.int64)
    for batch in batches:
        bits = _unpacked(batch.column(0).to_numpy()).astype(np.float32)
        total[:-1] += (bits.T @ bits).astype(np.int64).ravel()
        total[-1] += len(bits)
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], ["i", "n"])


def bit_correlations(nodes: DataFrame) -> tuple[int, np.ndarray]:
    """Number of fingerprints and the absolute correlations of their bits (64 x 64 numbers)."""
    sums = nodes.select("fingerprint").mapInArrow(_together, "i long, n long").groupBy("i").agg(F.sum("n").alias("n"))
    flat = np.zeros(BITS * BITS + 1)
    for i, n in sums.collect():
        flat[i] = n
    rows = max(flat[-1], 1.0)
    joint = flat[:-1].reshape(BITS, BITS) / rows
    mean = np.diag(joint).copy()
    spread = np.sqrt(np.maximum(mean * (1 - mean), 1e-9))
    return int(flat[-1]), np.abs(joint - np.outer(mean, mean)) / np.outer(spread, spread)


def group_bits(correlations: np.ndarray, parts: int) -> list[list[int]]:
    """Bits of each part: strongly correlated bits share a part; sizes differ by one at most."""
    left, groups = set(range(BITS)), []
    links = correlations - np.diag(np.diag(correlations))
    for part in range(parts):
        width = BITS // parts + (part < BITS % parts)
        seed = max(sorted(left), key=lambda b: links[b, sorted(left)].sum())
        group = [seed]
        left.remove(seed)
        while len(group) < width:
            best = max(sorted(left), key=lambda b: links[b, group].sum())
            group.append(best)
            left.remove(best)
        groups.append(group)
    return groups


def blocks_of(groups: list[list[int]]) -> list[tuple[int, list[int]]]:
    """Pieces of the parts that are small enough for a histogram: part and bits."""
    out = []
    for part, bits in enumerate(groups):
        pieces = -(-len(bits) // HISTOGRAM_BITS)
        out += [(part, bits[k::pieces]) for k in range(pieces)]
    return out


def values(bits: np.ndarray, chosen: list[int]) -> np.ndarray:
    """The number formed by the chosen columns of unpacked fingerprints."""
    return bits[:, chosen].astype(np.int64) @ (1 << np.arange(len(chosen), dtype=np.int64))


def _histogram(pieces):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = _unpacked(batch.column(0).to_numpy())
            for k, (_, chosen) in enumerate(pieces):
                found, n = np.unique(values(bits, chosen), return_counts=True)
                columns = [pa.array(np.full(len(found), k, np.int64)), pa.array(found), pa.array(n.astype(np.int64))]
                yield pa.RecordBatch.from_arrays(columns, ["piece", "value", "n"])

    return run


def ball_counts(histogram: np.ndarray, width: int, radius: int) -> np.ndarray:
    """For each distance up to ``radius`` and value, how many entries are that far away."""
    counts = np.zeros((radius + 1, len(histogram)))
    counts[0] = histogram
    index = np.arange(len(histogram))
    for bit in range(width):
        flipped = counts[:, index ^ (1 << bit)]
        counts[1:] += flipped[:-1]
    return counts


class Plan:
    """Parts, the histograms' ball counts and the number of fingerprints; sent to all tasks."""

    def __init__(self, nodes: DataFrame, radius: int, parts: int | None = None):
        rows, correlations = bit_correlations(nodes)
        if parts is None:
            parts = min(max(round(BITS / log2(max(rows, 4))), 2), radius + 1)
        self.rows, self.radius = rows, radius
        self.groups = group_bits(correlations, parts)
        self.pieces = blocks_of(self.groups)
        counted = nodes.select("fingerprint").mapInArrow(_histogram(self.pieces), "piece long, value long, n long")
        counted = counted.groupBy("piece", "value").agg(F.sum("n").alias("n"))
        histograms = [np.zeros(1 << len(chosen)) for _, chosen in self.pieces]
        # At most 2 ** HISTOGRAM_BITS rows for each of at most eight pieces.
        for piece, value, n in counted.collect():
            histograms[piece][value] = n
        self.balls = [ball_counts(h, len(c), radius).astype(np.float32) for h, (_, c) in zip(histograms, self.pieces)]

    def tables(self) -> dict:
        return vars(self)


def expected(plan: dict, bits: np.ndarray, part: int) -> np.ndarray:
    """Expected entries within each distance of the values of a part; pieces count as independent."""
    total = None
    for (owner, chosen), ball in zip(plan["pieces"], plan["balls"]):
        if owner != part:
            continue
        own = ball[:, values(bits, chosen)] / max(plan["rows"], 1)
        if total is None:
            total = own
        else:
            total = np.array([sum(total[i] * own[d - i] for i in range(d + 1)) for d in range(len(own))])
    return np.cumsum(total, axis=0) * plan["rows"]


def masks(width: int, radius: int) -> np.ndarray:
    """All differences of at most ``radius`` bits."""
    flips = [sum(1 << b for b in c) for r in range(radius + 1) for c in combinations(range(width), r)]
    return np.array(flips, np.int64)


def thresholds(plan: dict, bits: np.ndarray) -> np.ndarray:
    """Threshold plus one of each part, per fingerprint; they add up to the radius plus one."""
    goal, parts, n = plan["radius"] + 1, len(plan["groups"]), len(bits)
    best = np.full((goal + 1, n), np.inf)
    best[0] = 0
    picks = np.zeros((parts, goal + 1, n), np.int64)
    for part, group in enumerate(plan["groups"]):
        found = expected(plan, bits, part)
        cost = np.zeros((goal + 1, n))
        for take in range(1, goal + 1):
            cost[take] = found[take - 1] + PROBE_COST * len(masks(len(group), take - 1))
        options = np.full((goal + 1, goal + 1, n), np.inf)
        for total in range(goal + 1):
            for take in range(total + 1):
                options[total, take] = best[total - take] + cost[take]
        picks[part] = options.argmin(axis=1)
        best = options.min(axis=1)
    out, total = np.zeros((parts, n), np.int64), np.full(n, goal)
    for part in reversed(range(parts)):
        out[part] = picks[part][total, np.arange(n)]
        total = total - out[part]
    return out


def _entries(held):
    """Index entries and probes of each fingerprint."""

    def rows(plan, part, found, prints, spread, probe):
        key = np.int64(part) << 48 | found
        share = np.ones(len(found), np.int64)
        group, pieces = plan["groups"][part], [(c, b) for (o, c), b in zip(plan["pieces"], plan["balls"]) if o == part]
        if len(pieces) == 1:
            share = np.maximum(-(-pieces[0][1][0][found].astype(np.int64) // BLOCK), 1)
        else:
            place = {b: k for k, b in enumerate(group)}
            estimate = np.full(len(found), float(plan["rows"]))
            for chosen, ball in pieces:
                own = sum(((found >> place[b]) & 1) << k for k, b in enumerate(chosen))
                estimate *= ball[0][own] / max(plan["rows"], 1)
            share = np.maximum(-(-estimate.astype(np.int64) // BLOCK), 1)
        if spread:
            times = np.repeat(np.arange(len(found)), share)
            block = np.arange(len(times)) - np.repeat(np.cumsum(share) - share, share)
            key, prints = key[times], prints[times]
        else:
            block = (mix(prints.view(np.uint64)) % share.astype(np.uint64)).astype(np.int64)
        columns = [pa.array(key), pa.array(block), pa.array(np.full(len(key), probe)), pa.array(prints)]
        return pa.RecordBatch.from_arrays(columns, ["key", "block", "probe", "fingerprint"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan = held.value
        for whole in batches:
            for at in range(0, whole.num_rows, 4096):
                prints = whole.column(0).slice(at, 4096).to_numpy()
                bits = _unpacked(prints)
                chosen = thresholds(plan, bits)
                for part, group in enumerate(plan["groups"]):
                    own = values(bits, group)
                    yield rows(plan, part, own, prints, False, False)
                    for take in np.unique(chosen[part]).tolist():
                        if not take:
                            continue
                        who = np.flatnonzero(chosen[part] == take)
                        flips = masks(len(group), take - 1)
                        for k in range(0, len(who), max(1, PAIRS_AT_ONCE // 4 // len(flips))):
                            some = who[k : k + max(1, PAIRS_AT_ONCE // 4 // len(flips))]
                            near = (own[some][:, None] ^ flips[None, :]).ravel()
                            yield rows(plan, part, near, np.repeat(prints[some], len(flips)), True, True)

    return run


def local_stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links of each value to the smallest of its component, for the components of links ``a, b``."""
    nodes, flat = np.unique(np.r_[a, b], return_inverse=True)
    left, right = flat[: len(a)], flat[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[left], label[right])
        new = label.copy()
        np.minimum.at(new, left, low)
        np.minimum.at(new, right, low)
        new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    moved = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[moved], nodes[label[moved]]


def _verify(radius: int):
    """Links from rows sorted by key, block and probe; entries come before their probes."""

    def near(owner, first, counts, entries, probes):
        """Verified pairs of some probes and the entries of their groups."""
        n = counts[owner]
        left = np.repeat(probes, n)
        step = np.arange(len(left)) - np.repeat(np.cumsum(n) - n, n)
        right = entries[np.repeat(first[owner], n) + step]
        hit = (np.bitwise_count((left ^ right).view(np.uint64)) <= radius) & (right < left)
        return left[hit], right[hit]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = None
        for batch in batches:
            key, block, probe, prints = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(4))
            if kept is not None:
                key, block, probe, prints = (np.r_[x, y] for x, y in zip(kept, (key, block, probe, prints)))
            if not len(key):
                continue
            new = np.r_[True, (key[1:] != key[:-1]) | (block[1:] != block[:-1])]
            group = np.cumsum(new) - 1
            is_entry = ~probe
            # Entries of the last group, as its probes may go on in the next batch.
            last = (group == group[-1]) & is_entry
            kept = tuple(x[last] for x in (key, block, probe, prints))
            counts = np.bincount(group[is_entry], minlength=group[-1] + 1)
            first = np.cumsum(counts) - counts
            entries, probes, owner = prints[is_entry], prints[probe], group[probe]
            cost = np.cumsum(counts[owner])
            at = 0
            while at < len(probes):
                done = cost[at - 1] if at else 0
                end = max(at + 1, int(np.searchsorted(cost, done + PAIRS_AT_ONCE, side="right")))
                a, b = near(owner[at:end], first, counts, entries, probes[at:end])
                at = end
                if len(a):
                    a, b = local_stars(a, b)
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return run


def hamming_links(nodes: DataFrame, radius: int = RADIUS, parts: int | None = None) -> DataFrame:
    """Links ``a, b`` that connect all distinct fingerprints within ``radius`` bits of each other."""
    plan = Plan(nodes, radius, parts)
    held = nodes.sparkSession.sparkContext.broadcast(plan.tables())
    entries = nodes.select("fingerprint").mapInArrow(_entries(held), "key long, block long, probe boolean, fingerprint long")
    grouped = entries.repartition("key", "block").sortWithinPartitions("key", "block", "probe")
    return grouped.mapInArrow(_verify(radius), "a long, b long")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """Per row of ``docs``: ``doc_id, fingerprint`` (hexadecimal) and ``component_id``."""
    rows = stored(fingerprints(docs, shingle))
    nodes = stored(rows.groupBy("fingerprint").agg(F.min("doc_id").alias("least")))
    labels = components(hamming_links(nodes, radius))
    rooted = nodes.join(labels, nodes["fingerprint"] == labels["node"], "left")
    rooted = rooted.select("fingerprint", "least", F.coalesce("root", "fingerprint").alias("root"))
    # Stored, so that both sides of the join have a shuffle of their own and a giant component can be split.
    least = stored(rooted.groupBy("root").agg(F.min("least").alias("component_id")))
    named = rooted.join(least, "root").select("fingerprint", "component_id")
    found = rows.join(named, "fingerprint")
    return found.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")
