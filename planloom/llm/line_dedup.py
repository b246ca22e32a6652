"""Line deduplication: lines that many documents share stay in one of them.

Every text is split at newlines. A line's key is the line without blanks at both ends and with A-Z in
lower case; only keys of ``min_chars`` code points or more count. Each document gives each of its keys
once, as an md5 digest; documents per digest are counted with map-side partial sums, so a line that
every document holds is shuffled as one row per task. Keys in at least ``min_docs`` documents lose
their lines but in the largest doc_id that has them. Which lines go depends on doc_id and digest
alone: the digests to drop are gathered per doc_id, joined to the texts, and the texts put together
again from the lines that stay, in order.

Defined results: a null or empty text is one empty line and comes back as an empty text; each row is a
document of its own, also where rows or doc_ids repeat; a null doc_id ranks below all others, and
lines found only in documents without doc_id stay; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planloom.llm.common import SPACES, TO_LOWER, fresh, stored, text_buffer

MIN_CHARS = 40
MIN_DOCS = 5


def line_key(line: bytes, min_chars: int) -> bytes | None:
    """The digest of a line's key; None for a short one."""
    line = line.strip(SPACES)
    if len(line) < min_chars or (not line.isascii() and len(line.decode()) < min_chars):
        return None
    return hashlib.md5(line.translate(TO_LOWER), usedforsecurity=False).digest()


def _keys(min_chars: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, data = text_buffer(batch.column("text"))
            ids, digests = [], []
            for n in range(batch.num_rows):
                lines = bytes(data[offsets[n] : offsets[n + 1]]).split(b"\n")
                found = {line_key(line, min_chars) for line in lines} - {None}
                ids.append(found)
                digests.extend(found)
            rows = pa.array([n for n, found in enumerate(ids) for _ in found], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(rows), pa.array(digests, pa.binary())], ["doc_id", "digest"]
            )

    return run


def _rebuild(min_chars: int, text: str, drops: str, schema: pa.Schema):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, data = text_buffer(batch.column(text))
            texts, totals, dropped = [], [], []
            for n, gone in enumerate(batch.column(drops).to_pylist()):
                lines = bytes(data[offsets[n] : offsets[n + 1]]).split(b"\n")
                gone = set(gone or ())
                kept = [x for x in lines if line_key(x, min_chars) not in gone] if gone else lines
                texts.append(b"\n".join(kept))
                totals.append(len(lines))
                dropped.append(len(lines) - len(kept))
            own = {text: pa.array(texts, pa.binary()).cast(schema.field(text).type)}
            own |= {schema.names[-2]: pa.array(totals, pa.int64()), schema.names[-1]: pa.array(dropped, pa.int64())}
            columns = [own[f.name] if f.name in own else batch.column(f.name) for f in schema]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return run


def shared_lines(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS
) -> DataFrame:
    """The digests each document loses: ``doc_id, digest``."""
    texts = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = texts.schema["doc_id"].dataType.simpleString()
    keys = stored(texts.mapInArrow(_keys(min_chars), f"doc_id {kind}, digest binary"))
    counts = keys.groupBy("digest").agg(F.count(F.lit(1)).alias("docs"), F.max("doc_id").alias("keep_id"))
    # Stored, so that the join below has plain shuffles on both sides, whose hot digests Spark splits.
    shared = stored(counts.filter(F.col("docs") >= min_docs).select("digest", "keep_id"))
    return keys.join(shared, "digest").filter(~F.col("doc_id").eqNullSafe(F.col("keep_id"))).select("doc_id", "digest")


def drop_shared_lines(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS
) -> DataFrame:
    """``docs`` with the texts that are left, and the numbers of lines and of dropped lines at the end.

    The two columns are called ``n_lines`` and ``n_dropped``, or the same with ``_`` behind where
    ``docs`` has such columns.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    shared = shared_lines(docs, doc_id, text, min_chars, min_docs)
    gone, key = fresh(docs, "digests"), fresh(docs, "line_doc_id")
    drops = shared.groupBy(F.col("doc_id").alias(key)).agg(F.collect_set("digest").alias(gone))
    joined = docs.join(drops, docs[doc_id].eqNullSafe(drops[key]), "left").drop(key)
    n_lines, n_dropped = fresh(docs, "n_lines"), fresh(docs, "n_dropped")
    shape = docs.select("*", F.lit(0).cast("long").alias(n_lines), F.lit(0).cast("long").alias(n_dropped)).schema
    return joined.mapInArrow(_rebuild(min_chars, text, gone, to_arrow_schema(shape)), shape)
