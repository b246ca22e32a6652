"""Exact deduplication with a cuckoo-filter index of live digests.

Texts are equal when they are identical after lower-casing A-Z. Every task keeps an index of the
digests that are live in it: a cuckoo filter of 16-bit fingerprints in buckets of four, with the
digest and its group beside each fingerprint. A fingerprint that is found is verified against the
content of its bucket. Where the filter is full it is rebuilt at twice the size from the stored
digests.

The work is done twice by the same index. On the map side it combines the copies within a task; it
holds at most ``LIVE_DIGESTS`` groups and deletes the oldest when there are more, so its memory does
not depend on the data. The partial groups, at most one per digest, task and eviction, are then dealt
by digest, and an index per shard merges them. A group of copies with a third of all rows thus
reaches its shard as a few rows. Rows and groups meet in a join by digest, where adaptive execution
splits the rows of a large group; the group's side has one row.

Defined results: a null text is empty; a null doc_id ranks below all others; of rows with one text and
one doc_id a single one stays; an empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

import hashlib
from array import array
from collections import deque
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planloom.llm.common import lowered, stored

SLOTS = 4
KICKS = 200
LIVE_DIGESTS = 100_000
SHARD_DIGESTS = 400_000
LOWEST = -(1 << 63)

Group = list  # digest, largest doc_id, its row, number of rows


class CuckooIndex:
    """Groups by digest; at most two buckets of four slots are looked at for a digest."""

    def __init__(self, buckets: int = 1 << 10):
        self._clear(buckets)

    def _clear(self, buckets: int) -> None:
        self.mask = buckets - 1
        self.prints = array("H", bytes(2 * SLOTS * buckets))
        self.content: list[Group | None] = [None] * (SLOTS * buckets)
        self.size = 0

    def __len__(self) -> int:
        return self.size

    def groups(self) -> Iterator[Group]:
        return (g for g in self.content if g is not None)

    def _places(self, digest: bytes) -> tuple[int, int, int]:
        mark = int.from_bytes(digest[:2], "little") or 1
        first = int.from_bytes(digest[2:10], "little") & self.mask
        return mark, first, self._other(first, mark)

    def _other(self, bucket: int, mark: int) -> int:
        return (bucket ^ (mark * 0x5BD1E995)) & self.mask

    def _slot(self, digest: bytes) -> int:
        mark, first, second = self._places(digest)
        for bucket in (first, second):
            for slot in range(SLOTS * bucket, SLOTS * bucket + SLOTS):
                if self.prints[slot] == mark and self.content[slot][0] == digest:
                    return slot
        return -1

    def find(self, digest: bytes) -> Group | None:
        slot = self._slot(digest)
        return None if slot < 0 else self.content[slot]

    def insert(self, group: Group) -> None:
        """Add a group whose digest is not in the index."""
        waiting = [group]
        while waiting:
            left = self._place(waiting.pop())
            if left is not None:
                waiting += [*self.groups(), left]
                self._clear(2 * (self.mask + 1))

    def _place(self, group: Group) -> Group | None:
        """Put a group into a slot; gives back the group that found none after many moves."""
        mark, bucket, second = self._places(group[0])
        for choice in (bucket, second):
            if self._put(choice, mark, group):
                return None
        for n in range(KICKS):
            slot = SLOTS * bucket + (mark + n) % SLOTS
            mark, self.prints[slot] = self.prints[slot], mark
            group, self.content[slot] = self.content[slot], group
            bucket = self._other(bucket, mark)
            if self._put(bucket, mark, group):
                return None
        return group

    def _put(self, bucket: int, mark: int, group: Group) -> bool:
        for slot in range(SLOTS * bucket, SLOTS * bucket + SLOTS):
            if not self.prints[slot]:
                self.prints[slot], self.content[slot] = mark, group
                self.size += 1
                return True
        return False

    def delete(self, digest: bytes) -> Group | None:
        slot = self._slot(digest)
        if slot < 0:
            return None
        group, self.content[slot] = self.content[slot], None
        self.prints[slot] = 0
        self.size -= 1
        return group

    def add(self, digest: bytes, doc_id: int, row: int, rows: int) -> bool:
        """Count rows to their group; the row with the largest doc_id is the live one."""
        group = self.find(digest)
        if group is None:
            self.insert([digest, doc_id, row, rows])
            return True
        group[3] += rows
        if (doc_id, row) > (group[1], group[2]):
            group[1], group[2] = doc_id, row
        return False


_GROUPS = pa.schema(
    [("digest", pa.binary()), ("keep_id", pa.int64()), ("keep_row", pa.int64()), ("group_size", pa.int64())]
)
_GROUPS_SQL = "digest binary, keep_id long, keep_row long, group_size long"


def _batch(groups: list[Group]) -> pa.RecordBatch:
    columns = list(zip(*groups)) if groups else [[], [], [], []]
    return pa.RecordBatch.from_arrays(
        [pa.array(c, f.type) for c, f in zip(columns, _GROUPS)], schema=_GROUPS
    )


def _combine(batches: Iterable[pa.RecordBatch], live: int | None) -> Iterator[pa.RecordBatch]:
    index, order = CuckooIndex(), deque()
    for batch in batches:
        out = []
        for digest, doc_id, row, rows in zip(*(c.to_pylist() for c in batch.columns)):
            if index.add(digest, doc_id, row, rows) and live is not None:
                order.append(digest)
                if len(index) > live:
                    out.append(index.delete(order.popleft()))
        if out:
            yield _batch(out)
    out = []
    for group in index.groups():
        out.append(group)
        if len(out) == 10_000:
            yield _batch(out)
            out = []
    yield _batch(out)


def _combine_task(batches):
    return _combine(batches, LIVE_DIGESTS)


def _merge_shard(batches):
    return _combine(batches, None)


def _digests(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        offsets, data = lowered(batch.column("text"))
        view = memoryview(data)
        digests = [hashlib.sha256(view[a:b]).digest() for a, b in zip(offsets[:-1], offsets[1:])]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(digests, pa.binary())], ["doc_id", "digest"]
        )


def live_groups(keys: DataFrame) -> DataFrame:
    """One row per digest of ``keys(digest, doc_id, row)``: the live row and the number of rows."""
    rows = keys.select("digest", F.coalesce("doc_id", F.lit(LOWEST)), "row", F.lit(1).cast("long"))
    partial = rows.mapInArrow(_combine_task, _GROUPS_SQL)
    least = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shards = max(least, -(-keys.count() // SHARD_DIGESTS))
    return partial.repartition(shards, "digest").mapInArrow(_merge_shard, _GROUPS_SQL)


def exact_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of ``docs``: ``doc_id, keep_id, group_size, kept, text_sha256``."""
    texts = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    keys = texts.mapInArrow(_digests, "doc_id long, digest binary")
    # Stored, so that the row numbers stay as they are whatever is computed again.
    keys = stored(keys.withColumn("row", F.monotonically_increasing_id()))
    found = keys.join(live_groups(keys), "digest")
    return found.select(
        "doc_id",
        F.nullif("keep_id", F.lit(LOWEST)).alias("keep_id"),
        "group_size",
        (F.col("row") == F.col("keep_row")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )
