"""Token counts by greedy longest match, with an automaton that never goes back in the text.

The vocabulary's pieces form a trie over bytes. Each node has a failure link and the number of tokens
that are complete when the link is taken: for a piece, itself and then the root; for another node,
those of its parent and of the links followed until the node's byte fits. Every byte of a word is read
once, the counts on the links taken are added up, and the pieces themselves are never built.

A word is a run without blanks; its first piece may begin with the vocabulary's mark of word starts.
Bytes that no piece begins with are tokens of one byte, so each word has a count. The words that are
new to a task run through the automaton side by side, one byte each at a time; their counts are kept in a
table of bounded size, and a text's count is the sum over its words.

Defined results: a null or empty text has no words and no tokens; rows are independent of each other;
an empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planloom.llm.common import slices, text_buffer

KEPT_WORDS = 400_000
ROUND_BYTES = 1 << 24
MARK = "▁"


def load_pieces(path: str) -> list[bytes]:
    """The text pieces of a SentencePiece model, without control and byte pieces."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    plain = (n for n in range(model.get_piece_size()) if not (model.is_control(n) or model.is_unknown(n) or model.is_byte(n)))
    return [model.id_to_piece(n).encode() for n in plain]


def build_automaton(pieces: Iterable[bytes]) -> dict[str, np.ndarray]:
    """Trie edges sorted by (node, byte), and per node its link, popped tokens and tokens at a word's end."""
    children: list[dict[int, int]] = [{}]
    whole = [False]
    for piece in {*pieces, *(bytes([b]) for b in range(256))} - {b""}:
        node = 0
        for byte in piece:
            if byte not in children[node]:
                children[node][byte] = len(children)
                children.append({})
                whole.append(False)
            node = children[node][byte]
        whole[node] = True

    link, popped, rest = [0] * len(children), [0] * len(children), [0] * len(children)
    queue = deque([0])
    while queue:
        parent = queue.popleft()
        for byte, node in children[parent].items():
            queue.append(node)
            if whole[node]:
                link[node], popped[node] = 0, 1
            else:
                # The root has an edge for each byte, so this ends.
                popped[node], to = popped[parent], link[parent]
                while byte not in children[to]:
                    popped[node] += popped[to]
                    to = link[to]
                link[node] = children[to][byte]
            rest[node] = popped[node] + rest[link[node]]
    edges = sorted((node << 8 | byte, to) for node, own in enumerate(children) for byte, to in own.items())
    keys, to = (np.array(c, np.int64) for c in zip(*edges))
    return {"keys": keys, "to": to, **{k: np.array(v, np.int64) for k, v in (("link", link), ("popped", popped), ("rest", rest))}}


def count_words(words: list[bytes], automaton: dict[str, np.ndarray]) -> np.ndarray:
    """Tokens of each word."""
    keys, to, link, popped = (automaton[k] for k in ("keys", "to", "link", "popped"))
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    starts = np.cumsum(lengths) - lengths
    data = np.frombuffer(b"".join(words), np.uint8).astype(np.int64)
    order = np.argsort(-lengths, kind="stable")
    starts, left = starts[order], lengths[order]
    node, count = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
    # Words by falling length: those with a byte at a place come first.
    alive = np.searchsorted(-left, -np.arange(1, (left[0] if len(left) else 0) + 1), side="right")
    for at, n in enumerate(alive.tolist()):
        byte = data[starts[:n] + at]
        open_ = np.arange(n)
        while len(open_):
            wanted = node[open_] << 8 | byte[open_]
            found = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
            fits = keys[found] == wanted
            node[open_[fits]] = to[found[fits]]
            open_ = open_[~fits]
            count[open_] += popped[node[open_]]
            node[open_] = link[node[open_]]
    count += automaton["rest"][node]
    out = np.empty(len(words), np.int64)
    out[order] = count
    return out


def _count(automaton, mark: bytes):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, int] = {}
        counts = np.zeros(0, np.int64)
        for batch in batches:
            offsets, data = text_buffer(batch.column("text"))
            n_words, n_tokens = [], []
            for a, b in slices(offsets, ROUND_BYTES):
                if len(known) > KEPT_WORDS:
                    known, counts = {}, counts[:0]
                add = known.setdefault
                texts = []
                for n in range(a, b):
                    words = bytes(data[offsets[n] : offsets[n + 1]]).split()
                    texts.append(np.array([add(w, len(known)) for w in words], np.int64))
                new = [mark + w for w in list(known)[len(counts) :]]
                counts = np.r_[counts, count_words(new, automaton.value)]
                n_words += map(len, texts)
                n_tokens += [int(counts[t].sum()) for t in texts]
            columns = [batch.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_tokens, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "n_tokens"])

    return run


def token_counts(docs: DataFrame, pieces: Iterable[bytes], mark: str = MARK, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row ``doc_id, n_words, n_tokens``; the automaton is as large as the vocabulary."""
    texts = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = texts.schema["doc_id"].dataType.simpleString()
    automaton = docs.sparkSession.sparkContext.broadcast(build_automaton(pieces))
    return texts.mapInArrow(_count(automaton, mark.encode()), f"doc_id {kind}, n_words long, n_tokens long")
