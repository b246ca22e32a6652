"""Byte-pair encoding of whole texts by an index of pair occurrences, and decoding.

The words that are new to a task are laid out as one sequence of symbols. An index maps each mergeable
pair, by its rank, to all its positions in that sequence. The active ranks are taken in ascending order
from a heap: all positions of the pair are merged at once, and the pairs to their left and right enter
the index under their own ranks. A rank that has no positions is never looked at. The words' ids are
kept for the rest of the task, in a table of bounded size, and texts are put together from them.

Texts are split as the vocabulary's file says: special tokens first, in the raw text; then canonical
composition, lower case by character, and runs of letters, single digits and runs of other characters;
white space goes. Decoding names each id and joins the names with blanks, as the file has no decoder.

Defined results: a null or empty text has no ids and decodes to an empty text; rows are independent of
each other, so repeated rows and doc_ids give repeated results; further columns are not read.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planloom.llm.common import slices, text_buffer

# Words whose ids a task keeps; text handled between two rounds of merging; rows sent back at once.
KEPT_WORDS = 400_000
ROUND_BYTES = 1 << 24
ROWS_OUT = 256

NO_RANK = 1 << 30
_SHIFT = 1 << 20

# The encoder's classes are those of Unicode 16, its lower case that of Unicode 17.
# Letters and numbers of the pattern library that came later, and lower case that Python lacks.
LATER_LETTERS = (
    "0558 058B-058C 088F 0C5C 0CDC 208F 209D-209F A7CE-A7CF A7D2 A7D4 A7DD A7E2 A7F1 AB6C-AB6D 107BB-107BF "
    "10940-10959 10EC5-10EC7 10ED9-10EEE 11B0A 11DB0-11DDB 11DF1 16EA0-16EB8 16EBB-16ED3 16FF2-16FF3 "
    "187F8-187FF 18CD6-18CDA 18D09-18D20 18D80-18DF2 18E00-19191 191A0-191D2 1B123-1B128 1B168 1D6A6 "
    "1DF1F-1DF24 1DF2B-1DF81 1DF90-1DF96 1DFCD-1DFFF 1E6C0-1E6DE 1E6E0-1E6E2 1E6E4-1E6E5 1E6E7-1E6ED "
    "1E6F0-1E6F4 1E6FE-1E6FF 2B73A-2B73F 2B81E 2CEA2-2CEAD 323B0-33479 3D000-3FC3F"
)
LATER_NUMBERS = "11DE0-11DE9 1246F 12475-1247F 12550-12686 16FF4-16FF6"
LATER_LOWER = {0x1C89: 0x1C8A, 0xA7CB: 0x264, 0xA7CC: 0xA7CD, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5}
LATER_LOWER |= {0xA7DA: 0xA7DB, 0xA7DC: 0x19B}
LATER_LOWER |= {c: c + 0x20 for c in range(0x10D50, 0x10D66)} | {c: c + 0x1B for c in range(0x16EA0, 0x16EB9)}


def _without(kind: str, ranges: str) -> str:
    ends = [r.split("-") for r in ranges.split()]
    later = "".join(f"{chr(int(e[0], 16))}-{chr(int(e[-1], 16))}" for e in ends)
    return rf"[\p{{{kind}}}--[{later}]]"


_PARTS = r"'s|'t|'re|'ve|'m|'ll|'d|{L}+|{N}|[^\s{l}{n}]+"
_L, _N = _without("L", LATER_LETTERS), _without("N", LATER_NUMBERS)
_ANY = regex.compile(_PARTS.format(L=_L, N=_N, l=_L, n=_N).replace(r"\s", r"\p{White_Space}"), regex.V1)
# The same for characters below U+0250, where classes can be listed.
_LOW_END = 0x250


def _listed(kind: str) -> str:
    return "".join(re.escape(c) for c in map(chr, range(_LOW_END)) if unicodedata.category(c)[0] == kind)


_LOW = re.compile(
    _PARTS.format(L=f"[{_listed('L')}]", N=f"[{_listed('N')}]", l=_listed("L"), n=_listed("N")).replace(r"\s", "\t-\r \x85\xa0")
)
_HIGH = re.compile(f"[^\x00-{chr(_LOW_END - 1)}]")


def split_words(text: str) -> list[str]:
    """The words of a text without special tokens."""
    if not text.isascii() and _HIGH.search(text):
        text = unicodedata.normalize("NFC", text)
        # By character: a capital sigma is lowered alike wherever it stands.
        text = "".join(map(str.lower, text)) if "Σ" in text else text.lower()
        text = text.translate(LATER_LOWER)
        return _ANY.findall(text)
    text = text.lower()
    # One capital letter below U+0250 has a lower case with a combining mark.
    return (_ANY if not text.isascii() and _HIGH.search(text) else _LOW).findall(text)


def byte_names() -> list[str]:
    """The printable character that stands for each byte in vocabularies of byte-level pairs."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


def load_vocabulary(path: str) -> dict:
    """Plain tables of a vocabulary file of byte pairs with word ends."""
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    vocab, end = spec["model"]["vocab"], spec["model"]["end_of_word_suffix"]
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
    left = np.array([vocab[a] for a, _ in merges], np.int64)
    right = np.array([vocab[b] for _, b in merges], np.int64)
    keys = left * _SHIFT + right
    order = np.argsort(keys)
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    names = byte_names()
    return {
        "keys": keys[order],
        "ranks": order,
        "twins": left == right,
        "merged": np.array([vocab[a + b] for a, b in merges], np.int32),
        "inside": np.array([vocab[c] for c in names], np.int32),
        "last": np.array([vocab[c + end] for c in names], np.int32),
        "names": {i: t for t, i in (vocab | special).items()},
        "special": special,
    }


def _ranks(vocabulary: dict, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    wanted = left.astype(np.int64) * _SHIFT + right
    keys = vocabulary["keys"]
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, vocabulary["ranks"][at], NO_RANK)


class PairIndex:
    """Positions of each mergeable pair, by rank."""

    def __init__(self):
        self.places: dict[int, list[np.ndarray]] = {}
        self.active: list[int] = []

    def add(self, ranks: np.ndarray, positions: np.ndarray) -> None:
        keep = np.flatnonzero(ranks < NO_RANK)
        if not len(keep):
            return
        keep = keep[np.argsort(ranks[keep], kind="stable")]
        ranks, positions = ranks[keep], positions[keep]
        cuts = np.flatnonzero(np.diff(ranks)) + 1
        for rank, part in zip(ranks[np.r_[0, cuts]].tolist(), np.split(positions, cuts)):
            if rank in self.places:
                self.places[rank].append(part)
            else:
                self.places[rank] = [part]
                heapq.heappush(self.active, rank)

    def pop(self) -> tuple[int, np.ndarray]:
        rank = heapq.heappop(self.active)
        return rank, np.unique(np.concatenate(self.places.pop(rank)))


def _left_to_right(positions: np.ndarray, following: np.ndarray) -> np.ndarray:
    """Of positions of a pair of equal symbols, those that a scan from the left merges."""
    taken, chosen = set(), []
    for i, j in zip(positions.tolist(), following[positions].tolist()):
        if i not in taken:
            taken.add(j)
            chosen.append(i)
    return np.array(chosen, np.int64)


def merge_words(words: list[bytes], vocabulary: dict) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all words one after the other, and the number of ids of each word."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    data = np.frombuffer(b"".join(words), np.uint8)
    ends = np.cumsum(lengths) - 1
    symbols = vocabulary["inside"][data]
    symbols[ends] = vocabulary["last"][data[ends]]
    n = len(data)
    following = np.arange(1, n + 1)
    following[ends] = -1
    before = np.arange(-1, n - 1)
    before[np.r_[0, ends[:-1] + 1]] = -1
    alive = np.ones(n, bool)

    ranks = np.full(n, NO_RANK, np.int64)
    inner = np.flatnonzero(following >= 0)
    ranks[inner] = _ranks(vocabulary, symbols[inner], symbols[inner + 1])
    index = PairIndex()
    index.add(ranks, np.arange(n))
    while index.active:
        rank, at = index.pop()
        at = at[ranks[at] == rank]
        if vocabulary["twins"][rank]:
            at = _left_to_right(at, following)
        if not len(at):
            continue
        right = following[at]
        beyond = following[right]
        symbols[at] = vocabulary["merged"][rank]
        alive[right], ranks[right] = False, NO_RANK
        following[at] = beyond
        inside = beyond >= 0
        before[beyond[inside]] = at[inside]
        touched = before[at]
        touched = np.unique(np.r_[at, touched[touched >= 0]])
        after = following[touched]
        new = np.full(len(touched), NO_RANK, np.int64)
        paired = np.flatnonzero(after >= 0)
        new[paired] = _ranks(vocabulary, symbols[touched[paired]], symbols[after[paired]])
        ranks[touched] = new
        index.add(new, touched)
    counts = np.add.reduceat(alive, ends - lengths + 1, dtype=np.int64)
    return symbols[alive], counts


class WordTable:
    """Ids and names of the words a task has met."""

    def __init__(self, vocabulary: dict):
        self.vocabulary = vocabulary
        self.special = regex.compile("|".join(map(regex.escape, vocabulary["special"]))) if vocabulary["special"] else None
        self.clear()

    def clear(self) -> None:
        self.numbers: dict[str, int] = {}
        self.names: list[str] = []
        # Special tokens are words of their own, under keys that no word has.
        special = self.vocabulary["special"]
        for name, number in special.items():
            self.numbers[f" {name}"] = len(self.names)
            self.names.append(name)
        self.ids = np.array(list(special.values()), np.int32)
        self.counts = np.ones(len(special), np.int64)
        self.firsts = np.arange(len(special))

    def number(self, text: str) -> np.ndarray:
        """The words of a text as numbers of this table."""
        numbers = self.numbers
        if self.special is not None and "<" in text and (found := list(self.special.finditer(text))):
            words, at = [], 0
            for m in found:
                words += [*split_words(text[at : m.start()]), f" {m[0]}"]
                at = m.end()
            words += split_words(text[at:])
        else:
            words = split_words(text)
        add = numbers.setdefault
        return np.array([add(w, len(numbers)) for w in words], np.int32)

    def fill(self) -> None:
        """Merge the words that were numbered since the last time."""
        known = len(self.names)
        new = list(self.numbers)[known:]
        if not new:
            return
        ids, counts = merge_words([w.encode() for w in new], self.vocabulary)
        name = self.vocabulary["names"]
        named = [name[i] for i in ids.tolist()]
        at = 0
        for n in counts.tolist():
            self.names.append(" ".join(named[at : at + n]))
            at += n
        self.ids = np.r_[self.ids, ids]
        self.counts = np.r_[self.counts, counts]
        self.firsts = np.cumsum(self.counts) - self.counts

    def encode(self, words: np.ndarray) -> np.ndarray:
        counts, firsts = self.counts[words], self.firsts[words]
        steps = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        return self.ids[np.repeat(firsts, counts) + steps]


def _encode(vocabulary):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordTable(vocabulary.value)
        for batch in batches:
            offsets, data = text_buffer(batch.column("text"))
            for a, b in slices(offsets, ROUND_BYTES):
                if len(words.names) > KEPT_WORDS:
                    words.clear()
                texts = [words.number(str(data[offsets[n] : offsets[n + 1]], "utf-8")) for n in range(a, b)]
                words.fill()
                for c in range(a, b, ROWS_OUT):
                    rows = texts[c - a : min(c + ROWS_OUT, b) - a]
                    ids = [words.encode(t).astype("<u4").tobytes() for t in rows]
                    names = words.names
                    decoded = [" ".join([names[w] for w in t.tolist()]) for t in rows]
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("doc_id").slice(c, len(rows)), pa.array(ids, pa.binary()), pa.array(decoded, pa.string())],
                        ["doc_id", "ids", "decoded"],
                    )

    return run


def encode_decode(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row ``doc_id, n_tokens, ids, decoded``; ids are little-endian unsigned 32-bit numbers.

    ``path`` is read by the driver; its tables, as large as the vocabulary, are sent to the tasks.
    """
    texts = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = texts.schema["doc_id"].dataType.simpleString()
    vocabulary = docs.sparkSession.sparkContext.broadcast(load_vocabulary(path))
    encoded = texts.mapInArrow(_encode(vocabulary), f"doc_id {kind}, ids binary, decoded string")
    n_tokens = (F.length("ids") / 4).cast("long")
    return encoded.select("doc_id", n_tokens.alias("n_tokens"), "ids", "decoded")
