"""Alignment of two tokenizers against brute force over byte ranges."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
import sentencepiece
from cases import documents, empty, rows
from hypothesis import given
from hypothesis import strategies as st
from tokenizers import Tokenizer

from planloom.llm import alignment
from planloom.llm.queries import vocabulary

BYTE, PIECE = vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model")


def spans(pieces):
    out, at = [], 0
    for token, data in pieces:
        out.append((token, at, at + len(data)))
        at += len(data)
    return out


def tokens(texts):
    """Per text A's and B's (id, start, end), or nothing where the bytes differ."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    names = {chr(b): b for b in printable} | {chr(256 + n): b for n, b in enumerate(b for b in range(256) if b not in printable)}
    a = Tokenizer.from_file(BYTE)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    out = []
    for text in texts:
        left = [(i, bytes(names[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids] if text else []
        right = []
        for i in b.encode(text) if text else []:
            piece = b.id_to_piece(i)
            right.append((i, bytes([int(piece[3:5], 16)]) if b.is_byte(i) else piece.replace("▁", " ").encode()))
        whole = (" " + text).encode() if text else b""
        same = all(b"".join(x for _, x in side) == whole for side in (left, right))
        out.append((spans(left), spans(right)) if same else ([], []))
    return out


def brute(texts):
    found = tokens([t or "" for t in texts])
    pairs = [[(x[0], y[0]) for x in a for y in b if x[2] == y[2] and x[1] < y[2] and y[1] < x[2]] for a, b in found]
    counts = Counter(p for some in pairs for p in some)
    most = defaultdict(int)
    for (_, b), n in counts.items():
        most[b] = max(most[b], n)
    out = []
    for (a, b), own in zip(found, pairs):
        cuts = sorted({x[2] for x in a} & {x[2] for x in b})
        groups, low = [], 0
        for cut in cuts:
            groups.append("|".join(",".join(str(t) for t, _, end in side if low < end <= cut) for side in (a, b)))
            low = cut
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""
        best = sum(counts[p] == most[p[1]] for p in own)
        out.append((len(a), len(b), len(groups), len(own), best, sum(counts[p] for p in own), digest))
    return out


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
ODD = ["<|endoftext|> <s></s> <0x41>", "low ▁ line", "naïve café 日本語 ①ﬁ", "\x00\x01 \t\r\n", "  two  blanks  ", "é́ 👩‍👩‍👧", "zz" * 400, "a▁b"]


@pytest.mark.parametrize("head", [alignment.HEAD, 40, 0.5])
def test_alignment(spark, head):
    short = [(r[0], r[1] if r[1] is None else r[1][:3000]) for r in rows(1, True)] + [(2000 + n, t) for n, t in enumerate(ODD)]
    docs = spark.createDataFrame(short, "doc_id long, text string").repartition(3)
    got = alignment.align(docs, BYTE, PIECE, head)
    assert got.columns == COLUMNS
    want = [(r[0], *x) for r, x in zip(short, brute([r[1] for r in short]))]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    assert sum(w[1] > 0 for w in want) > 60
    assert [w[1:] for w in want if w[0] == 2001] == [(0, 0, 0, 0, 0, 0, "")]


def test_words_give_what_whole_texts_give():
    rng = random.Random(3)
    pieces = [" ", "  ", "   ", "\n", "\t ", " \n", "\u3000", "\x1c ", "\xa0", "it's", "'s", "we'll", "12", "345 ", "a", "be", "class", "é", "日本", "👩‍👧", "...", "<s>", "_", "-"]
    texts = ["".join(rng.choices(pieces, k=rng.randint(1, 25))) for _ in range(600)]
    files = [open(path, "rb").read() for path in (BYTE, PIECE)]
    words = alignment.Words(alignment.Encoders(*files))
    counts, digests, _, _ = words.align(texts)
    assert [(*c, d) for c, d in zip(counts.T.tolist(), digests)] == [(*x[:4], x[6]) for x in brute(texts)]


def test_long_texts_clashing_columns_and_no_rows(spark):
    docs = documents(spark, 1)
    got = alignment.align(docs, BYTE, PIECE)
    assert got.count() == docs.count() and got.agg({"n_a": "max"}).first()[0] > 10_000
    assert alignment.align(empty(spark), BYTE, PIECE).count() == 0


def test_link_ids_are_those_that_end_together(spark, monkeypatch):
    monkeypatch.setattr(alignment, "BLOCK", 5)
    texts = [ODD[2], "", ODD[3], ODD[6], "a"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    blocks = alignment.aligned(docs, BYTE, PIECE).collect()
    for n, (a, b) in enumerate(tokens(texts)):
        own = [r for r in blocks if r.doc_id == n]
        links = [p for r in own for p in zip(r.link_a, r.link_b)]
        assert links == [(x[0], y[0]) for x in a for y in b if x[2] == y[2]]
        assert [r.n_links for r in own] == [len(links)] + [None] * (len(own) - 1) and len(own) == max(1, -(-len(links) // 5))


def test_hot_text(spark):
    texts = ["one text with many copies"] * 300 + [f"other text {n}" for n in range(50)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    got = {r.doc_id: tuple(r)[1:] for r in alignment.align(docs, BYTE, PIECE, 10).collect()}
    assert [got[n] for n in range(350)] == brute(texts)


def test_counts_do_not_depend_on_the_table_size(spark, monkeypatch):
    table = alignment.aligned(documents(spark, 2), BYTE, PIECE)
    want = sorted(map(tuple, alignment.pair_counts(table).collect()))
    monkeypatch.setattr(alignment, "KEPT_PAIRS", 5)
    assert sorted(map(tuple, alignment.pair_counts(table).collect())) == want


sizes = st.lists(st.integers(1, 6), min_size=1, max_size=12)


@given(sizes, sizes)
def test_overlaps_and_groups_of_ranges(one, two):
    one.append(max(0, sum(two) - sum(one)) or 1)
    two.append(sum(one) - sum(two)) if sum(one) > sum(two) else None
    ends_a, ends_b = np.cumsum(one), np.cumsum(two)
    group_a, group_b = alignment.groups_of(ends_a, ends_b)
    cuts = np.array(sorted(set(ends_a) & set(ends_b)))
    assert group_a.tolist() == np.searchsorted(cuts, ends_a).tolist()
    assert group_b.tolist() == np.searchsorted(cuts, ends_b).tolist()
    got = sorted(zip(*map(np.ndarray.tolist, alignment.overlaps(ends_a, ends_b, group_a, group_b))))
    start_a, start_b = ends_a - one, ends_b - two
    want = [(i, j) for i in range(len(one)) for j in range(len(two)) if start_a[i] < ends_b[j] and start_b[j] < ends_a[i]]
    assert got == want
