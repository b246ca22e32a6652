"""Benchmark decontamination by a prefix-filtered join.

A window is ``WINDOW`` consecutive words of a benchmark item; an item of fewer words is one window. A
document is joined to a window only where it has the window's necessary prefix:

1. Shingles of up to three words are ordered by rarity, that is by their count over all documents.
   Since a window has to occur whole, a prefix of one shingle, its rarest, is necessary.
2. One pass counts the benchmark's shingles in the documents; a second emits the places of prefix
   shingles with the words around them. Both passes look shingles up in a Bloom filter of fixed size;
   what it lets through by mistake fails the join.
3. Places and windows are joined by shingle, salted by place, as one passage may be in a third of all
   documents. The place of the shingle in its window gives the window's start in the document;
   windows that would begin before the text or end after it are out (positional and length bounds).
4. The words at that place are compared with those of the window.

Verified windows of a document are merged from left to right for the number of words hit.

Defined results: a null text has no words; an item without words is no window; equal windows of many
items are one window with many items; a null item_id counts as an item named by the empty string; each
row of the documents is one of its own, also where rows repeat; empty tables give no hits.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from planloom.llm.common import ALNUM_WORDS, lowered, mix, slices, span_hashes, stored, word_spans

WINDOW = 13
SHINGLE = 3
FILTER_BITS = 1 << 23
SALTS = 32

_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_STEPS = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]

_WINDOWS = "item_id string, window array<binary>, shingles array<long>"
_PLACES = "doc_id long, n_words long, places array<struct<shingle: long, pos: long, first: long, words: array<binary>>>"


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of each ``size`` consecutive word hashes, as signed numbers."""
    n = max(len(words) - size + 1, 0)
    total = np.full(n, size, np.uint64)
    for k in range(size):
        total = total + words[k : k + n] * _STEPS[k]
    return mix(total).view(np.int64)


def item_windows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All windows of each item, with the hashes of their shingles."""
    for batch in batches:
        offsets, data = lowered(batch.column("text"))
        rows = []
        for n, item in enumerate(batch.column("item_id").to_pylist()):
            text = data[offsets[n] : offsets[n + 1]]
            words = _WORD.findall(text)
            raw = np.frombuffer(text, np.uint8)
            starts, ends, _ = word_spans(raw, np.array([0, len(raw)]), ALNUM_WORDS)
            size = min(WINDOW, len(words))
            if not size:
                continue
            hashes = shingle_hashes(span_hashes(raw, starts, ends), min(SHINGLE, size))
            per = size - min(SHINGLE, size) + 1
            for at in range(len(words) - size + 1):
                rows.append((item, words[at : at + size], hashes[at : at + per].tolist()))
        columns = list(zip(*rows)) if rows else [[], [], []]
        kinds = [pa.string(), pa.list_(pa.binary()), pa.list_(pa.int64())]
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, kinds)], ["item_id", "window", "shingles"]
        )


def shingle_filter(shingles: DataFrame) -> dict[int, np.ndarray]:
    """A Bloom filter per size with two bits a shingle, in ``FILTER_BITS`` bits whatever it holds."""
    bit = F.explode(F.array(F.col("shingle"), F.shiftright("shingle", 32)))
    bits = shingles.select("size", bit.alias("h")).select("size", F.col("h").bitwiseAND(FILTER_BITS - 1).alias("b"))
    flag = F.expr("shiftleft(1L, CAST(b & 63 AS INT))")
    words = bits.groupBy("size", F.shiftright("b", 6).alias("word")).agg(F.bit_or(flag).alias("flags"))
    held: dict[int, np.ndarray] = {}
    # At most SHINGLE * FILTER_BITS / 64 rows.
    for size, word, flags in words.collect():
        held.setdefault(size, np.zeros(FILTER_BITS // 64, np.int64))[word] = flags
    return held


def _may_hold(held: np.ndarray, shingles: np.ndarray) -> np.ndarray:
    found = np.ones(len(shingles), bool)
    for h in (shingles, shingles >> 32):
        b = h & (FILTER_BITS - 1)
        found &= (held[b >> 6] >> (b & 63)) & 1 == 1
    return found


def _shingles(batch: pa.RecordBatch, held) -> Iterator[tuple]:
    """Per slice of a batch: rows, text, word spans, and (size, places, hashes) of found shingles."""
    offsets, data = lowered(batch.column("text"))
    raw = np.frombuffer(data, np.uint8)
    for a, b in slices(offsets):
        part = raw[offsets[a] : offsets[b]]
        starts, ends, bounds = word_spans(part, offsets[a : b + 1] - offsets[a], ALNUM_WORDS)
        words = span_hashes(part, starts, ends)
        found = []
        for size, own in held.value.items():
            hashes = shingle_hashes(words, size)
            places = np.flatnonzero(_may_hold(own, hashes))
            # A shingle ends in the text it begins in.
            text = np.searchsorted(bounds, places, side="right") - 1
            places = places[places + size <= bounds[text + 1]]
            found.append((size, places, hashes[places]))
        yield a, b, part, starts, ends, bounds, found


def _count_shingles(held):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for *_, found in _shingles(batch, held):
                for size, _, hashes in found:
                    values, counts = np.unique(hashes, return_counts=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(values), size, np.int32)), pa.array(values), pa.array(counts.astype(np.int64))],
                        ["size", "shingle", "n"],
                    )

    return run


def _find_places(held):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            totals, rows = [], []
            for a, b, part, starts, ends, bounds, found in _shingles(batch, held):
                totals.extend(np.diff(bounds).tolist())
                rows.extend([] for _ in range(a, b))
                text = part.tobytes()
                for _, places, hashes in found:
                    owner = np.searchsorted(bounds, places, side="right") - 1
                    low, high = bounds[owner], bounds[owner + 1]
                    first = np.maximum(places - WINDOW + 1, low)
                    last = np.minimum(places + WINDOW, high)
                    for n, h, p, f, t in zip((owner + a).tolist(), hashes.tolist(), places.tolist(), first.tolist(), last.tolist()):
                        base = int(bounds[n - a])
                        words = [text[starts[i] : ends[i]] for i in range(f, t)]
                        rows[n].append({"shingle": h, "pos": p - base, "first": f - base, "words": words})
            place = pa.struct([("shingle", pa.int64()), ("pos", pa.int64()), ("first", pa.int64()), ("words", pa.list_(pa.binary()))])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(totals, pa.int64()), pa.array(rows, pa.list_(place))],
                ["doc_id", "n_words", "places"],
            )

    return run


def verified_windows(docs: DataFrame, benchmark: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents as ``row, doc_id, n_words``, hits as ``row, start, size, key``, items as ``key, item_id``."""
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text")
    windows = items.mapInArrow(item_windows, _WINDOWS)
    windows = stored(windows.withColumn("key", F.sha2(F.concat_ws(" ", F.transform("window", lambda w: w.cast("string"))), 256)))
    distinct = windows.groupBy("key").agg(F.first("window").alias("window"), F.first("shingles").alias("shingles"))
    # Fewer than SHINGLE words are a shingle of their own size.
    size = F.least(F.size("window"), F.lit(SHINGLE)).alias("size")
    shingles = distinct.select("key", size, F.posexplode("shingles").alias("offset", "shingle"))

    wanted = shingles.select("size", "shingle").distinct()
    held = spark.sparkContext.broadcast(shingle_filter(wanted))
    counts = texts.mapInArrow(_count_shingles(held), "size int, shingle long, n long")
    counts = counts.groupBy("size", "shingle").agg(F.sum("n").alias("n"))
    ranked = shingles.join(counts, ["size", "shingle"], "left")
    rarest = F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "shingle", "offset", "size"))
    prefixes = stored(ranked.groupBy("key").agg(rarest.alias("p")).select("key", "p.shingle", "p.offset", "p.size"))

    held = spark.sparkContext.broadcast(shingle_filter(prefixes.select("size", "shingle").distinct()))
    found = stored(texts.mapInArrow(_find_places(held), _PLACES).withColumn("row", F.monotonically_increasing_id()))
    places = found.filter(F.size("places") > 0).select("row", "n_words", F.inline("places"))
    places = places.withColumn("salt", F.pmod(F.xxhash64("row", "pos"), F.lit(SALTS)).cast("int"))
    probes = prefixes.drop("size").join(distinct.select("key", "window"), "key")
    probes = probes.select("*", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    start = F.col("pos") - F.col("offset")
    length = F.size("window")
    inside = (start >= 0) & (start + length <= F.col("n_words"))
    at = (start - F.col("first") + 1).cast("int")
    same = F.slice("words", F.when(inside, at).otherwise(F.lit(1)), length) == F.col("window")
    hits = places.join(probes, ["shingle", "salt"]).filter(inside & same)
    hits = hits.select("row", start.alias("start"), length.cast("long").alias("size"), "key").distinct()
    return found.select("row", "doc_id", "n_words"), hits, windows.select("key", F.coalesce("item_id", F.lit("")).alias("item_id")).distinct()


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Per document: ``doc_id, n_words, n_hit, n_items, items_sha256, contaminated``."""
    rows, hits, items = verified_windows(docs, benchmark)
    hits = stored(hits)
    earlier = Window.partitionBy("row").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    spans = hits.groupBy("row", "start").agg(F.max(F.col("start") + F.col("size")).alias("end"))
    new = F.col("end") - F.greatest(F.col("start"), F.coalesce(F.max("end").over(earlier), F.lit(0)))
    words = spans.select("row", F.greatest(new, F.lit(0)).alias("new")).groupBy("row").agg(F.sum("new").alias("n_hit"))
    named = hits.select("row", "key").distinct().join(items, "key").select("row", "item_id").distinct()
    named = named.groupBy("row").agg(F.array_sort(F.collect_set("item_id")).alias("items"))
    all_rows = rows.join(words, "row", "left").join(named, "row", "left")
    n_hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return all_rows.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.coalesce(F.array_join("items", ","), F.lit("")), 256).alias("items_sha256"),
        ((n_hit > 0) & (F.lit(20) * n_hit >= F.col("n_words"))).alias("contaminated"),
    )
