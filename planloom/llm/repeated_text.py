"""Removal of repeated passages by a depth-limited radix sort of suffixes.

A byte goes if a string of ``DEPTH`` bytes covers it that also starts earlier: in a smaller doc_id, or
further to the front of the same text. The suffixes of all texts are grouped by their first ``DEPTH``
bytes in passes over ever longer digits; a suffix that is alone in its group is not looked at again.
Digits are compared by hashes, 128 bits in all for what counts as equal.

1. Digit one is a gram of ``GRAM`` bytes. For each suffix it is the gram with the least hash within the
   first ``DEPTH`` bytes, so that equal strings have the same gram at the same place and neighbouring
   suffixes share one. All suffixes that share a gram's place are one *run*, a single row.
2. Digit two is the run's whole string, from the start of its first suffix to the end of its last one.
   Runs are dealt and sorted by gram and string. All but the first of equal runs repeat it in full.
   Runs that are alone with their gram are not repeated anywhere.
3. For first runs whose gram also has other strings, the suffixes are taken by ``BLOCK`` that lie side by
   side, counted from the gram. Digit three is what all suffixes of a block have in common. A block whose
   digit no other one has is not repeated.
4. Digit four, for the suffixes of the blocks that are left, is all of the ``DEPTH`` bytes, in two halves.
   All but the first of equal suffixes are repeated.

Before each shuffle a task sorts what it has in hand: rows that are not the first of their group there
are decided at once and dealt out evenly, so that a passage that a third of all texts share sends one row
per batch to its group. Passes only stream sorted rows. Texts are shuffled once, by doc_id, to look
up the suffixes of passes three and four and to cut out what goes.

Texts go by a number of their own, ``doc``. Where every row has a doc_id of its own, that is it. Otherwise rows are
sorted by ranges of doc_id, SHA-256 of the text and place in the input, and numbered in that order; the numbers
are stored with the texts. So rows that share a doc_id, or have none, are dealt like all others.

Defined results: a null text is empty; texts shorter than ``DEPTH`` stay whole; a null doc_id ranks below
all others; texts that share a doc_id are taken in the order of their SHA-256, and of equal rows with
one doc_id the first stays; an empty table gives an empty result; further columns are not read. ``DEPTH`` less ``GRAM``
is less than 128, and a text has less than 2**33 bytes.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planloom.llm.common import SLICE_BYTES, mix, slices, span_hashes, stored, text_buffer, written

DEPTH = 100
GRAM = 24
BLOCK = 8

# A place is one number: start, whether it is decided, and suffixes after the first.
_SPAN, _LATER, _START, _PLACE_BITS = 7, 1 << 7, 8, 41

_SPAN_MASK = _LATER - 1

_ROWS = "gram long, digit long, doc long, place long"
_NAMES = ["gram", "digit", "doc", "place"]
_FOUND = "doc long, place long, check boolean"


def window_minima(values: np.ndarray, width: int) -> np.ndarray:
    """Least of each ``width`` consecutive values."""
    size, least = 1, values
    while 2 * size <= width:
        least = np.minimum(least[: len(least) - size], least[size:])
        size *= 2
    rest = width - size
    return np.minimum(least[: len(least) - rest], least[rest:]) if rest else least


def runs(data: np.ndarray, ends: np.ndarray, depth: int, gram: int):
    """Runs of suffixes in adjoining texts: first and last start, place and hash of the gram."""
    n = len(data) - depth + 1
    none = np.zeros(0, np.int64)
    if n <= 0:
        return none, none, none, none.astype(np.uint64)
    at = np.arange(len(data) - gram + 1)
    hashes = span_hashes(data, at, at + gram)
    low = np.uint64((1 << 24) - 1)
    least = window_minima((hashes & ~low) | at.astype(np.uint64), depth - gram + 1)[:n]
    anchor = (least & low).astype(np.int64)
    # Suffixes that reach into the next text are none.
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, np.clip(ends[:-1] - depth + 1, 0, n), 1)
    np.add.at(edge, np.clip(ends[:-1], 0, n), -1)
    whole = np.cumsum(edge[:n]) == 0
    change = np.r_[True, anchor[1:] != anchor[:-1]]
    first = np.flatnonzero(whole & (change | np.r_[True, ~whole[:-1]]))
    last = np.flatnonzero(whole & np.r_[change[1:] | ~whole[1:], True])
    return first, last, anchor[first], hashes[anchor[first]]


def _texts(offsets: np.ndarray, data: memoryview, wanted: list | None, depth: int) -> Iterator[tuple]:
    """Pieces of a batch: first row, starts and ends of the rows in the piece, bytes, offset in the row."""
    raw = np.frombuffer(data, np.uint8)
    for a, b in slices(offsets, SLICE_BYTES):
        if wanted is not None and not any(wanted[a:b]):
            continue
        if b - a == 1 and offsets[b] - offsets[a] > SLICE_BYTES:
            begin, end = int(offsets[a]), int(offsets[b])
            for at in range(begin, end - depth + 1, SLICE_BYTES):
                part = raw[at : min(at + SLICE_BYTES + depth - 1, end)]
                yield a, np.array([0, len(part)]), part, at - begin
        else:
            yield a, offsets[a : b + 1] - offsets[a], raw[offsets[a] : offsets[b]], 0


def _batch(gram, digit, doc, place, spare: int) -> pa.RecordBatch:
    """Rows of a batch, in order of their groups' rows; all but ``spare`` of each group are marked as decided."""
    order = np.lexsort((place, doc, digit, gram))
    new = np.ones(len(gram), bool)
    new[1:] = (gram[order][1:] != gram[order][:-1]) | (digit[order][1:] != digit[order][:-1])
    heads = np.flatnonzero(new)
    head = heads[np.cumsum(new) - 1]
    same = (doc[order] == doc[order][head]) & (place[order] == place[order][head])
    later = ~same if spare == 1 else np.arange(len(gram)) - head >= spare
    place = place.copy()
    place[order[later]] |= _LATER
    columns = [gram.view(np.int64), digit.view(np.int64), doc, place]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], _NAMES)


def _rows_out(parts: list[tuple], spare: int = 1) -> pa.RecordBatch:
    kinds = (np.uint64, np.uint64, np.int64, np.int64)
    columns = [np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, kind) for k, kind in enumerate(kinds)]
    return _batch(*columns, spare)


def _ids(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("doc").to_numpy(zero_copy_only=False).astype(np.int64)


def _runs_of(batch: pa.RecordBatch, wanted: list | None, depth: int, gram: int) -> Iterator[tuple]:
    """Per piece of a batch: rows and places of the runs, their first and last starts, grams and bytes."""
    offsets, data = text_buffer(batch.column("text"))
    for a, bounds, part, shift in _texts(offsets, data, wanted, depth):
        first, last, at, grams = runs(part, bounds[1:], depth, gram)
        # Empty texts share a bound with the next one.
        owner = np.searchsorted(bounds, first, side="right") - 1
        start = first - bounds[owner] + shift
        yield owner + a, start << _START, first, last, at, grams, part


def _each(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of some ranges, ends included, and the range of each."""
    length = last - first + 1
    which = np.repeat(np.arange(len(first)), length)
    return first[which] + np.arange(len(which)) - np.repeat(np.cumsum(length) - length, length), which


def _all_runs(depth: int, gram: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, parts = _ids(batch), []
            for owner, place, first, last, _, grams, part in _runs_of(batch, None, depth, gram):
                string = span_hashes(part, first, last + depth)
                # The number of suffixes is part of what has to be equal.
                string = mix(string + (last - first).astype(np.uint64))
                parts.append((grams, string, docs[owner], place | (last - first)))
            yield _rows_out(parts)

    return run


def _blocks(depth: int, gram: int):
    """Blocks of the suffixes of the runs asked for, by what a block's suffixes have in common."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, parts = _ids(batch), []
            wanted = batch.column("places").to_pylist()
            for owner, place, first, last, at, _, part in _runs_of(batch, wanted, depth, gram):
                # The places asked for, each with the row it belongs to.
                rows = np.unique(owner)
                asked = [np.array(wanted[n] or [], np.int64) + (n << _PLACE_BITS) for n in rows.tolist()]
                own = (owner << _PLACE_BITS) + (place | (last - first))
                keep = np.flatnonzero(np.isin(own, np.concatenate([place[:0], *asked])))
                first, last, at, owner, place = (x[keep] for x in (first, last, at, owner, place))
                block, which = _each((at - last) // BLOCK, (at - first) // BLOCK)
                near = at[which] - block * BLOCK
                low = np.maximum(near - BLOCK + 1, first[which])
                span = np.minimum(near, last[which]) - low
                common = span_hashes(part, near, near - BLOCK + 1 + depth)
                row = place[which] + ((low - first[which]) << _START) + span
                doc = docs[owner[which]]
                parts.append((common, np.zeros_like(common), doc, row))
            yield _rows_out(parts, spare=2)

    return run


def _suffixes(depth: int):
    """All suffixes of the blocks asked for, by their two halves."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        half = depth // 2
        for batch in batches:
            docs, parts = _ids(batch), []
            offsets, data = text_buffer(batch.column("text"))
            wanted = [np.array(w or [], np.int64) for w in batch.column("places").to_pylist()]
            for a, bounds, part, shift in _texts(offsets, data, [len(w) for w in wanted], depth):
                rows = np.repeat(np.arange(len(bounds) - 1), [len(wanted[a + n]) for n in range(len(bounds) - 1)])
                place = np.concatenate([wanted[a][:0], *wanted[a : a + len(bounds) - 1]])
                begin = (place >> _START) - shift
                span = place & _SPAN_MASK
                # Of a long text, this piece's only.
                inside = (begin >= 0) & (begin + span + depth <= np.diff(bounds)[rows])
                rows, place, begin, span = (x[inside] for x in (rows, place, begin, span))
                start, which = _each(bounds[rows] + begin, bounds[rows] + begin + span)
                step = start - (bounds[rows] + begin)[which]
                own = (place[which] >> _START << _START) + (step << _START)
                front = span_hashes(part, start, start + half)
                parts.append((front, span_hashes(part, start + half, start + depth), docs[a + rows[which]], own))
            yield _rows_out(parts)

    return run


def _later(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows that are not the first of their group; with ``check`` first ones whose gram has other groups."""
    kept = None  # gram, digit, doc, place of the last group's first row; groups of its gram so far
    for batch in batches:
        gram, digit, doc, place = (c.to_numpy() for c in batch.columns)
        decided = place & _LATER != 0
        doc_out, place_out = [doc[decided]], [place[decided] & ~_LATER]
        gram, digit, doc, place = (x[~decided] for x in (gram, digit, doc, place))
        checks = [np.zeros(decided.sum(), bool)]
        if len(gram):
            seen = 0
            if kept is not None:
                gram, digit, doc, place = (np.r_[np.int64(k), x] for k, x in zip(kept, (gram, digit, doc, place)))
                seen = kept[4]
            new_gram = np.r_[True, gram[1:] != gram[:-1]]
            new = new_gram | np.r_[True, digit[1:] != digit[:-1]]
            heads = np.flatnonzero(new)
            head = heads[np.cumsum(new) - 1]
            later = (doc != doc[head]) | (place != place[head])
            doc_out.append(doc[later])
            place_out.append(place[later])
            checks.append(np.zeros(later.sum(), bool))
            # Groups of each gram in this batch, and those of the first gram before it.
            number = np.cumsum(new_gram) - 1
            groups = np.bincount(number[heads])
            if kept is not None:
                groups[0] += seen - 1
            several = groups[number[heads]] > 1
            if kept is not None:
                # The row carried over was given out already if its gram had several groups.
                several[0] &= seen == 1
            doc_out.append(doc[heads][several])
            place_out.append(place[heads][several])
            checks.append(np.ones(several.sum(), bool))
            end = heads[-1]
            kept = (gram[end], digit[end], doc[end], place[end], int(groups[-1]))
        columns = [np.concatenate(x) for x in (doc_out, place_out, checks)]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["doc", "place", "check"])


def _repeated(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All rows whose first digit other rows have too."""
    kept = None  # gram, doc and place of the last row if it is not out yet; else its gram alone
    for batch in batches:
        gram, _, doc, place = (c.to_numpy() for c in batch.columns)
        decided = place & _LATER != 0
        doc_out, place_out = [doc[decided]], [place[decided] & ~_LATER]
        gram, doc, place = (x[~decided] for x in (gram, doc, place))
        if len(gram):
            same = gram[1:] == gram[:-1]
            goes_on = kept is not None and kept[0] == gram[0]
            if goes_on and len(kept) == 3:
                doc_out.append(np.array([kept[1]]))
                place_out.append(np.array([kept[2]]))
            out = np.r_[goes_on, same] | np.r_[same, False]
            doc_out.append(doc[out])
            place_out.append(place[out])
            kept = (gram[-1],) if out[-1] else (gram[-1], doc[-1], place[-1])
        columns = [np.concatenate(x) for x in (doc_out, place_out)]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["doc", "place"])


def _pass(rows: DataFrame, step, shape: str) -> DataFrame:
    """One pass: rows dealt by their first digit, decided ones evenly, sorted, and streamed through ``step``."""
    decided = F.col("place").bitwiseAND(F.lit(_LATER)) != 0
    dealt = rows.repartition(F.when(decided, F.hash("doc", "place")).otherwise(F.hash("gram")))
    return dealt.sortWithinPartitions(*_NAMES).mapInArrow(step, shape)


def _cut(depth: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, data = text_buffer(batch.column("text"))
            columns = [[], [], [], []]
            for n, places in enumerate(batch.column("places").to_pylist()):
                text = data[offsets[n] : offsets[n + 1]]
                place = np.unique(np.array(places or [], np.int64))
                first = place >> _START
                end = first + (place & _SPAN_MASK) + depth
                order = np.argsort(first, kind="stable")
                first, end = first[order], np.maximum.accumulate(end[order])
                head = np.flatnonzero(np.r_[True, first[1:] > end[:-1]]) if len(first) else np.zeros(0, np.int64)
                first, end = first[head], end[np.r_[head[1:] - 1, len(end) - 1]] if len(head) else end
                kept, at = [], 0
                for x, y in zip(first.tolist(), end.tolist()):
                    kept.append(text[at:x])
                    at = y
                kept.append(text[at:])
                out = (len(text), int((end - first).sum()), len(first), b"".join(kept))
                for column, value in zip(columns, out):
                    column.append(value)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(columns, kinds))],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"],
            )

    return run


def numbered(docs: DataFrame) -> DataFrame:
    """``doc_id, doc, text``: ``doc`` is different for each row and rises with doc_id, null ones first."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    shared = texts.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1 OR doc_id IS NULL")
    if shared.isEmpty():
        # Never null here; a column that says so gets no filter in some plans that keeps them from sharing a shuffle.
        return texts.withColumn("doc", F.coalesce("doc_id", F.lit(0).cast("long")))
    order = ["doc_id", "digest", "row"]
    digest = F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256))
    rows = texts.withColumns({"digest": digest, "row": F.monotonically_increasing_id()})
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    # Numbers of rows in their tasks rise with the ranges.
    return written(rows.select("doc_id", "text", F.monotonically_increasing_id().alias("doc")))


def remove_repeats(docs: DataFrame, depth: int = DEPTH, gram: int = GRAM) -> DataFrame:
    """Per row ``doc_id, n_bytes, n_removed, n_spans, kept``; ``kept`` are the bytes that stay."""
    if not 0 < gram <= depth or depth - gram >= 1 << _SPAN or depth > SLICE_BYTES:
        raise ValueError("a gram is at most as long as the depth, and at most 127 bytes shorter")
    texts = numbered(docs)
    found = stored(_pass(texts.select("doc", "text").mapInArrow(_all_runs(depth, gram), _ROWS), _later, _FOUND))

    def places(rows: DataFrame) -> DataFrame:
        return rows.groupBy("doc").agg(F.collect_list("place").alias("places"))

    # One shuffle of the texts, read three times: all three reads need the same columns.
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by_doc = texts.select("doc", "doc_id", "text").repartition(parts, "doc")
    blocks = by_doc.join(places(found.filter("check")), "doc").mapInArrow(_blocks(depth, gram), _ROWS)
    blocks = _pass(blocks, _repeated, "doc long, place long")
    suffixes = by_doc.join(places(blocks), "doc").mapInArrow(_suffixes(depth), _ROWS)
    suffixes = _pass(suffixes, _later, _FOUND)
    gone = places(found.unionByName(suffixes).filter("NOT check"))
    return by_doc.join(gone, "doc", "left").mapInArrow(_cut(depth), "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")
