"""Alignment of two tokenizers over the bytes of each text, and how often their tokens end together.

Both tokenizers cut the same bytes, so a token is a range of bytes. Neither has tokens that go on from
another character into a blank, so texts are cut into words with a blank before each, and each
distinct word of a task is aligned once. The tokens of all words that are new to a batch, A's and B's, are
sorted by start (lexsort); the running maximum of their ends (maximum.accumulate) is where a group may
end: a new group begins at each token whose start reaches that maximum. Within groups of several
tokens the overlaps of A's and B's tokens are expanded from the places where their sorted ranges meet;
there are fewer overlaps than tokens of both sides. The overlaps whose ranges end together are the *links*.

Pairs of ids are counted over the whole corpus. The texts are encoded once; ids, digests and the links'
ids are written to a table in the shared folder, and the passes that follow read its link columns only:

1. Tasks count pairs in tables of bounded size and send partial counts; sums are combined on the map side.
2. Pairs that hold at least a ``HEAD``-th of all links, hence ``HEAD`` pairs at most, are sent to all
   tasks with their counts; tasks look their links up and add up per text.
3. All other links leave as (row, pair, times) and meet the counts in a join. None of its keys is frequent.

Defined results: null and empty texts, and texts whose joined token bytes differ from a blank and the
text on either side, have no tokens: numbers are zero and the digest is an empty string. Rows are kept
apart by stored row numbers, so repeated rows and doc_ids, and null ones, each have their own result.
An empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from planloom.llm.bpe import byte_names
from planloom.llm.common import slices, text_buffer, written

HEAD = 1 << 20
# Distinct pairs that a task keeps before it sends their counts.
KEPT_PAIRS = 1 << 21
LINKS_AT_ONCE = 1 << 19
# Links in a row of the stored table: a batch of rows is small, however long the texts are.
BLOCK = 256
# Words that a task keeps aligned, the bytes of these and their groups, and words that are encoded at once.
KEPT_WORDS, KEPT_BYTES, WORDS_AT_ONCE = 300_000, 1 << 25, 4096
BLANK = "▁"
# Fixed value: the words of byte-level vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_level_entries(spec: dict) -> list[bytes]:
    """The bytes of each id of a byte-level vocabulary; special tokens are their text."""
    values = {name: byte for byte, name in enumerate(byte_names())}
    entries = {i: bytes(values[c] for c in piece) for piece, i in spec["model"]["vocab"].items() if all(c in values for c in piece)}
    entries |= {t["id"]: t["content"].encode() for t in spec["added_tokens"]}
    return [entries.get(i, b"") for i in range(max(entries) + 1)]


def piece_entries(model) -> list[bytes]:
    """The bytes of each id of a SentencePiece model."""
    pieces = ((model.id_to_piece(i), model.is_byte(i)) for i in range(model.get_piece_size()))
    return [bytes([int(p[3:-1], 16)]) if is_byte else p.replace(BLANK, " ").encode() for p, is_byte in pieces]


class Encoders:
    """Both tokenizers with the bytes of their ids, made in a task from the vocabularies' files."""

    def __init__(self, byte_file: bytes, piece_file: bytes):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(byte_file.decode())
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        self.b = sentencepiece.SentencePieceProcessor(model_proto=piece_file)
        self.blank = self.b.piece_to_id(BLANK)
        spec = json.loads(byte_file)
        entries = byte_level_entries(spec)
        self.ranked = self._ranked(spec, entries)
        self.entries = [pa.array(e, pa.large_binary()) for e in (entries, piece_entries(self.b))]

    @staticmethod
    def _ranked(spec: dict, entries: list[bytes]):
        """A quicker encoder of ASCII words with the same results, for vocabularies whose ids rise with the merges."""
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        made = [spec["model"]["vocab"][a + b] for a, b in merges]
        if made != sorted(made) or spec["model"].get("ignore_merges"):
            return None
        import tiktoken

        special = {t["id"] for t in spec["added_tokens"]}
        ranks = {e: i for i, e in enumerate(entries) if i not in special}
        return tiktoken.Encoding("ascii", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, words: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Ids of all words and numbers of ids per word, for both with a blank before each word."""
        a: list = [None] * len(words)
        other = range(len(words))
        if self.ranked:
            quick = self.ranked.encode_ordinary
            a = [quick(" " + w) if w.isascii() else None for w in words]
            other = [n for n, ids in enumerate(a) if ids is None]
        for n, found in zip(other, self.a.encode_batch_fast([" " + words[n] for n in other], add_special_tokens=False)):
            a[n] = found.ids
        # The library adds no blank to an empty text.
        b = [ids or [self.blank] for ids in self.b.encode(words, num_threads=1)]
        return [(np.fromiter(chain.from_iterable(x), np.int32), np.fromiter(map(len, x), np.int64, len(x))) for x in (a, b)]

    def bytes_of(self, side: int, ids: np.ndarray) -> tuple[np.ndarray, memoryview]:
        """Offsets of the ids' bytes, and the bytes."""
        return text_buffer(self.entries[side].take(pa.array(ids)))


def groups_of(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The group of each token, for two sorted sequences of ranges that cover the same bytes."""
    starts = np.r_[0, ends_a[:-1], 0, ends_b[:-1]] if len(ends_a) and len(ends_b) else np.zeros(0, np.int64)
    ends = np.r_[ends_a, ends_b]
    order = np.lexsort((ends, starts))
    reached = np.maximum.accumulate(ends[order])
    new = np.ones(len(order), bool)
    new[1:] = starts[order][1:] >= reached[:-1]
    group = np.empty(len(order), np.int64)
    group[order] = np.cumsum(new) - 1
    return group[: len(ends_a)], group[len(ends_a) :]


def overlaps(ends_a: np.ndarray, ends_b: np.ndarray, group_a: np.ndarray, group_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of all pairs of an A token and a B token that share a byte."""
    groups = int(group_a[-1]) + 1 if len(group_a) else 0
    alone = (np.bincount(group_a, minlength=groups) == 1) & (np.bincount(group_b, minlength=groups) == 1)
    one_a, one_b = np.flatnonzero(alone[group_a]), np.flatnonzero(alone[group_b])
    many = np.flatnonzero(~alone[group_a])
    starts = np.r_[0, ends_a[:-1]][many] if len(ends_a) else many
    first = np.searchsorted(ends_b, starts, side="right")
    last = np.searchsorted(ends_b, ends_a[many], side="left")
    n = last - first + 1
    left = np.repeat(many, n)
    right = np.arange(len(left)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)
    return np.r_[one_a, left], np.r_[one_b, right]


def links_of(ends_a: np.ndarray, ends_b: np.ndarray, group_a: np.ndarray, group_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the overlapping tokens that end together, by place."""
    a, b = overlaps(ends_a, ends_b, group_a, group_b)
    together = ends_a[a] == ends_b[b]
    a, b = a[together], b[together]
    order = np.argsort(a, kind="stable")
    return a[order], b[order]


def _separated(entries: int) -> pa.Array:
    """Decimal numbers, each followed by nothing and by the three separators."""
    return pa.array([f"{i}{mark}".encode() for mark in ("", ",", "|", ";") for i in range(entries)], pa.large_binary())


def _sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of consecutive runs."""
    total = np.r_[0, np.cumsum(values)]
    ends = np.cumsum(counts)
    return total[ends] - total[ends - counts]


class _Index(dict):
    """Numbers of words; words that are met first get the next number and wait in ``new``."""

    def __init__(self):
        super().__init__()
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = number = len(self)
        self.new.append(word)
        return number


def split_words(text: str) -> list[str]:
    """Parts of a text between the blanks that follow something else than white space.

    In a blank and the text, each part comes with the blank before it. A's words and B's pieces never go on
    from other characters into a blank, so tokens of both sides begin where a part's blank is.
    """
    return _PARTS.split(text) if _WIDE.search(text) else text.split(" ")


_PARTS, _WIDE = re.compile(r"(?<=\S) "), re.compile(r"\s |^ ")


class Words:
    """Aligned words: the words new to a batch are aligned together, and kept in tables of bounded size."""

    def __init__(self, encoders: Encoders):
        self.encoders = encoders
        self.width = max(len(e) for e in encoders.entries)
        self.numbers = _separated(self.width)
        self.clear()

    def clear(self) -> None:
        self.index, self.group_texts, self.size = _Index(), [], 0
        # Per word: A tokens, B tokens, groups, links and whether the bytes are right.
        self.counts = np.zeros((5, 0), np.int64)
        self.links = [np.zeros(0, np.int32), np.zeros(0, np.int32)]

    def _group_text(self, ids, groups, ids_b, groups_b, ends_of_words) -> pa.Array:
        """All ids in the order of groups, A's before B's, each with the separator that follows it."""
        place_a = np.arange(len(ids)) + np.searchsorted(groups_b, groups, side="left")
        place_b = np.arange(len(ids_b)) + np.searchsorted(groups, groups_b, side="right")
        joined, group, side = (np.empty(len(ids) + len(ids_b), np.int64) for _ in range(3))
        for place, own, at, kind in ((place_a, ids, groups, 0), (place_b, ids_b, groups_b, 1)):
            joined[place], group[place], side[place] = own, at, kind
        mark = np.zeros(len(joined), np.int64)
        mark[:-1] = np.where(group[1:] != group[:-1], 3, np.where(side[1:] != side[:-1], 2, 1))
        mark[ends_of_words[ends_of_words > 0] - 1] = 0
        return self.numbers.take(pa.array(mark * self.width + joined))

    def fill(self) -> None:
        """Align the words that wait."""
        words, self.index.new = self.index.new, []
        for at in range(0, len(words), WORDS_AT_ONCE):
            self._align(words[at : at + WORDS_AT_ONCE])

    def _align(self, words: list[str]) -> None:
        sides = self.encoders.encode(words)
        spans, good = [], np.ones(len(words), bool)
        wanted = [b" " + w.encode() for w in words]
        for side, (ids, counts) in enumerate(sides):
            offsets, data = self.encoders.bytes_of(side, ids)
            edges = offsets[np.r_[0, np.cumsum(counts)]]
            good &= [bytes(data[x:y]) == w for x, y, w in zip(edges[:-1], edges[1:], wanted)]
            spans.append(np.diff(offsets))
        (ids_a, n_a), (ids_b, n_b) = sides
        keep_a, keep_b = np.repeat(good, n_a), np.repeat(good, n_b)
        ids_a, ids_b, n_a, n_b = ids_a[keep_a], ids_b[keep_b], n_a * good, n_b * good
        ends_a, ends_b = np.cumsum(spans[0][keep_a]), np.cumsum(spans[1][keep_b])
        group_a, group_b = groups_of(ends_a, ends_b)
        left, right = links_of(ends_a, ends_b, group_a, group_b)

        word = np.repeat(np.arange(len(words)), n_a)
        new = np.r_[True, group_a[1:] != group_a[:-1]] if len(group_a) else np.zeros(0, bool)
        counts = [n_a, n_b, _sums(new.astype(np.int64), n_a), np.bincount(word[left], minlength=len(words)), good]
        offsets, data = text_buffer(self._group_text(ids_a, group_a, ids_b, group_b, np.cumsum(n_a + n_b)))
        edges = offsets[np.r_[0, np.cumsum(n_a + n_b)]]
        self.group_texts += [bytes(data[x:y]) for x, y in zip(edges[:-1], edges[1:])]
        self.counts = np.concatenate([self.counts, np.array(counts, np.int64)], axis=1)
        self.links = [np.r_[kept, ids] for kept, ids in zip(self.links, (ids_a[left], ids_b[right]))]
        self.size += len(data) + sum(map(len, words))

    def align(self, texts: list[str]) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray]:
        """Counts of A tokens, B tokens, groups and links per text, digests, and ids of all links in order."""
        if len(self.index) > KEPT_WORDS or self.size > KEPT_BYTES:
            self.clear()
        number = self.index.__getitem__
        numbers = [list(map(number, split_words(t))) if t else [] for t in texts]
        self.fill()
        parts = np.fromiter(map(len, numbers), np.int64, len(numbers))
        flat = np.fromiter(chain.from_iterable(numbers), np.int64, parts.sum())
        counts = np.array([_sums(c[flat], parts) for c in self.counts])
        good = (counts[4] == parts) & (parts > 0)
        counts = counts[:4] * good
        digests = [
            hashlib.sha256(b";".join(map(self.group_texts.__getitem__, own))).hexdigest() if ok else ""
            for own, ok in zip(numbers, good.tolist())
        ]
        flat = flat[np.repeat(good, parts)]
        n, starts = self.counts[3][flat], (np.cumsum(self.counts[3]) - self.counts[3])[flat]
        places = np.arange(n.sum()) + np.repeat(starts - (np.cumsum(n) - n), n)
        return counts, digests, self.links[0][places], self.links[1][places]


_ALIGNED = pa.schema(
    [("row", pa.int64()), ("doc_id", pa.int64())]
    + [(c, pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links")]
    + [("groups_sha256", pa.string()), ("link_a", pa.list_(pa.int32())), ("link_b", pa.list_(pa.int32()))]
)
_ALIGNED_SQL = (
    "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
    "link_a array<int>, link_b array<int>"
)


def _align(files):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = None
        for batch in batches:
            words = words or Words(Encoders(*files.value))
            texts = batch.column("text")
            offsets, _ = text_buffer(texts)
            for start, end in slices(offsets):
                some = pc.fill_null(texts.slice(start, end - start), "").to_pylist()
                counts, digests, *links = words.align(some)
                # The first block of a text has its numbers, all have links.
                blocks = np.maximum(-(-counts[3] // BLOCK), 1)
                text = np.repeat(np.arange(len(some)), blocks)
                step = np.arange(len(text)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
                size = np.clip(counts[3][text] - step * BLOCK, 0, BLOCK)
                ends = pa.array(np.r_[0, np.cumsum(size)], pa.int32())
                lists = [pa.ListArray.from_arrays(ends, pa.array(x, pa.int32())) for x in links]
                ids = [batch.column(c).slice(start, end - start).take(pa.array(text)) for c in ("row", "doc_id")]
                first = pa.array(np.where(step == 0, text, 0), mask=step > 0)
                numbers = [pa.array(c, pa.int64()).take(first) for c in counts] + [pa.array(digests, pa.string()).take(first)]
                yield pa.RecordBatch.from_arrays([*ids, *numbers, *lists], schema=_ALIGNED)

    return run


def aligned(docs: DataFrame, byte_path: str, piece_path: str) -> DataFrame:
    """Numbers, digests and link ids, stored in blocks of at most ``BLOCK`` links.

    ``row`` numbers the rows of ``docs``; numbers and digest are in the first block of a row and null in the others.
    """
    files = []
    for path in (byte_path, piece_path):
        with open(path, "rb") as file:
            files.append(file.read())
    held = docs.sparkSession.sparkContext.broadcast(tuple(files))
    texts = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    return written(texts.mapInArrow(_align(held), _ALIGNED_SQL))


# -- counts of pairs -----------------------------------------------------------------


def _pairs(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Some rows, ids of A above ids of B in one number, and the row of each link; few links, or one row, at a time."""
    for start, end in slices(batch.column("link_a").offsets.to_numpy(), LINKS_AT_ONCE):
        some = batch.slice(start, end - start)
        a, b = (some.column(c) for c in ("link_a", "link_b"))
        n = pc.list_value_length(a).to_numpy(zero_copy_only=False)
        yield some, a.flatten().to_numpy().astype(np.int64) << 32 | b.flatten().to_numpy(), np.repeat(np.arange(len(n)), n)


def _merged(pairs: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    found, place = np.unique(np.concatenate(pairs), return_inverse=True)
    return found, np.bincount(place, np.concatenate(counts), len(found)).astype(np.int64)


def _count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial counts of pairs; sent whenever there are many, so that memory is bounded."""
    pairs, counts, held, least = [], [], 0, KEPT_PAIRS

    def sent(found, n):
        return pa.RecordBatch.from_arrays([pa.array(found), pa.array(n)], ["pair", "n"])

    for _, links, _ in chain.from_iterable(map(_pairs, batches)):
        found, n = np.unique(links, return_counts=True)
        pairs.append(found)
        counts.append(n)
        held += len(found)
        if held > least:
            found, n = _merged(pairs, counts)
            pairs, counts, held = [found], [n], len(found)
            if held > KEPT_PAIRS // 2:
                yield sent(found, n)
                pairs, counts, held = [], [], 0
    if pairs:
        yield sent(*_merged(pairs, counts))


def pair_counts(blocks: DataFrame) -> DataFrame:
    """``pair, n, best``: links of each pair of ids, and whether none of its B id's pairs has more; stored."""
    counts = blocks.select("link_a", "link_b").mapInArrow(_count, "pair long, n long")
    counts = written(counts.groupBy("pair").agg(F.sum("n").alias("n")))
    b = F.col("pair").bitwiseAND((1 << 32) - 1)
    # One row for each id of B's vocabulary at most.
    most = counts.groupBy(b.alias("b")).agg(F.max("n").alias("most"))
    return written(counts.join(F.broadcast(most), b == F.col("b")).select("pair", "n", (F.col("n") == F.col("most")).alias("best")))


def _look_up(head):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, best = head.value
        for batch, pairs, rows in chain.from_iterable(map(_pairs, batches)):
            at = np.minimum(np.searchsorted(keys, pairs), max(len(keys) - 1, 0))
            known = keys[at] == pairs if len(keys) else np.zeros(len(pairs), bool)
            own, number = rows[known], batch.num_rows
            n_best = np.bincount(own, best[at[known]], number).astype(np.int64)
            total = np.zeros(number, np.int64)
            np.add.at(total, own, counts[at[known]])
            # The other links, equal ones of a row together.
            order = np.lexsort((pairs[~known], rows[~known]))
            pair, row = pairs[~known][order], rows[~known][order]
            first = np.flatnonzero(np.r_[True, (pair[1:] != pair[:-1]) | (row[1:] != row[:-1])]) if len(pair) else np.zeros(0, np.int64)
            times = np.diff(np.r_[first, len(pair)])
            ends = np.searchsorted(row[first], np.arange(number + 1))
            rest = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x, pa.int64())) for x in (pair[first], times)]
            columns = [batch.column("row"), pa.array(n_best), pa.array(total), *rest]
            yield pa.RecordBatch.from_arrays(columns, ["row", "n_best", "count_sum", "pairs", "times"])

    return run


_LOOKED_UP = "row long, n_best long, count_sum long, pairs array<long>, times array<long>"


def link_totals(blocks: DataFrame, counts: DataFrame, head: int = HEAD) -> DataFrame:
    """``row, n_best, count_sum`` of each row."""
    total = counts.agg(F.sum("n")).first()[0] or 0
    frequent: Column = F.col("n") >= -(-total // head)
    chosen = counts.filter(frequent).toArrow()
    keys, n, best = (chosen.column(c).to_numpy() for c in ("pair", "n", "best"))
    order = np.argsort(keys)
    held = blocks.sparkSession.sparkContext.broadcast((keys[order], n[order], best[order].astype(np.int64)))
    looked_up = blocks.select("row", "link_a", "link_b").mapInArrow(_look_up(held), _LOOKED_UP)
    sums = looked_up.select("row", "n_best", "count_sum")
    if not counts.filter(~frequent).isEmpty():
        looked_up = written(looked_up)
        zipped = F.explode(F.arrays_zip("pairs", "times")).alias("link")
        rest = looked_up.select("row", zipped).select("row", "link.pairs", "link.times")
        met = rest.join(counts.filter(~frequent), rest["pairs"] == counts["pair"])
        n_best, count_sum = F.col("times") * F.col("best").cast("long"), F.col("times") * F.col("n")
        sums = looked_up.select("row", "n_best", "count_sum").unionByName(met.select("row", n_best.alias("n_best"), count_sum.alias("count_sum")))
    return sums.groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))


def align(docs: DataFrame, byte_path: str, piece_path: str, head: int = HEAD) -> DataFrame:
    """Per row of ``docs``: numbers of tokens, groups and links, ``n_best``, ``count_sum`` and the digest."""
    blocks = aligned(docs, byte_path, piece_path)
    totals = link_totals(blocks, pair_counts(blocks), head)
    rows = blocks.filter(F.col("n_a").isNotNull())
    return rows.join(totals, "row").select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
