"""Alignment of two tokenizers against brute force, by hand-made ends, and on odd input."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
from tokenizers import Tokenizer

from barloom.llm import alignment as A
from barloom.llm.queries import queries

FILES = (P.path(A.BYTE_TOKENIZER), P.path(A.PIECE_TOKENIZER))


@pytest.fixture(scope="module")
def both():
    own = Tokenizer.from_file(FILES[0])
    own.encode_special_tokens = True
    return own, sentencepiece.SentencePieceProcessor(model_file=FILES[1])


def letter_bytes(token):
    spread, extra = {}, 0
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174:
            spread[chr(b)] = b
        else:
            spread[chr(256 + extra)] = b
            extra += 1
    return bytes(spread[c] for c in token)


def spans(tokens):
    at = 0
    for i, raw in tokens:
        yield i, at, at + len(raw)
        at += len(raw)


def brute(both, texts):
    own, pieces = both
    seen = []
    for t in texts:
        a = [(i, letter_bytes(own.id_to_token(i))) for i in own.encode(" " + t, add_special_tokens=False).ids] if t else []
        b = []
        for i in pieces.encode(t) if t else []:
            p = pieces.id_to_piece(i)
            b.append((i, bytes([int(p[3:5], 16)]) if pieces.is_byte(i) else p.replace("▁", " ").encode()))
        raw = (" " + (t or "")).encode()
        if b"".join(x for _, x in a) != raw or b"".join(x for _, x in b) != raw:
            a, b = [], []
        a, b = list(spans(a)), list(spans(b))
        links = [(x, y) for x, s, e in a for y, s2, e2 in b if s < e2 and s2 < e]
        ends = sorted({e for _, _, e in a} & {e for _, _, e in b})
        groups = [
            ",".join(str(i) for i, s, e in a if lo <= s and e <= hi) + "|" + ",".join(str(i) for i, s, e in b if lo <= s and e <= hi)
            for lo, hi in zip([0, *ends], ends, strict=False)
        ]
        seen.append((len(a), len(b), groups, links))
    counts = Counter(p for *_, links in seen for p in set(links))
    most = Counter()
    for (x, _), n in counts.items():
        most[x] = max(most[x], n)
    return [
        (na, nb, len(groups), len(links), sum(counts[p] == most[p[0]] for p in links), sum(counts[p] for p in links), ";".join(groups))
        for na, nb, groups, links in seen
    ]


TEXTS = [
    None, "", " ", "hello world", "hello world", "  two  spaces ", "tab\tand\nnew\r\nline", "Über straße naïve café", "漢字かな交じり文と数字12345",
    "👩‍👩‍👧 emoji 🏳️‍🌈", "<|endoftext|> is text, <s> too </s> <0x41> <unk>", "a▁b", "x" * 400, "ﬁ ligature", "é combining", "\u0000 nul \u0007", "\xa0nbsp　wide",
    "1234567890 3.14159 1e-10", "don't WON'T I'll they've", "camelCaseIdentifier_snake_case kebab-case", "﻿bom", "ABC" * 50,
]


@pytest.mark.parametrize("frequent, pattern", [(0, None), (7, P.PATTERN)])
def test_alignment_is_that_of_brute_force(spark, both, frequent, pattern):
    random.seed(4)
    words = " ".join(t for t in TEXTS if t).split()
    texts = TEXTS + [" ".join(random.choices(words, k=random.choice([3, 20, 200]))) for _ in range(30)]
    rows = [(i, t, "clash", "clash", 1) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_a string, _row string, _text int").repartition(3)
    got = A.score_links(A.align(df, *FILES, pattern, slice_bytes=500), frequent).collect()
    want = brute(both, texts)
    assert {r.doc_id: (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups) for r in got} == dict(enumerate(want))
    assert {(r._row, r._text) for r in got} == {("clash", 1)}
    assert sum(w[0] == 0 for w in want) < len(want) / 3 and any(w[2] < w[0] for w in want)


def test_cuts_of_random_ends():
    random.seed(5)
    for _ in range(200):
        ends_a, ends_b, docs_a, docs_b, want, at = [], [], [0], [0], [], 0
        for _ in range(random.randint(1, 4)):
            n = random.choice([0, 1, 2, 9, 60])
            a, b = (sorted({*random.sample(range(1, n), random.randint(0, (n - 1) // k)), n}) if n else [] for k in (1, 3))
            want += [(len(ends_a) + a.index(e) + 1, len(ends_b) + b.index(e) + 1) for e in a if e in b]
            ends_a, ends_b, at = ends_a + [at + e for e in a], ends_b + [at + e for e in b], at + n
            docs_a, docs_b = [*docs_a, len(ends_a)], [*docs_b, len(ends_b)]
        got = A.shared_cuts(*(np.array(x, dtype=np.int64) for x in (ends_a, ends_b, docs_a, docs_b)))
        assert list(zip(*(g.tolist() for g in got), strict=True)) == want


def test_a_long_interval_without_a_cut_and_one_with_cuts_at_its_end():
    n = 200_000
    a = np.append(np.arange(1, 2 * n, 2), 2 * n)  # odd ends
    for b in (np.append(np.arange(2, 2 * n - 1, 2), 2 * n), np.append(np.arange(2, 2 * n - 50, 2), np.arange(2 * n - 50, 2 * n + 1))):
        got_a, got_b = A.shared_cuts(a, b, np.array([0, len(a)]), np.array([0, len(b)]))
        assert np.array_equal(a[got_a - 1], np.intersect1d(a, b)) and np.array_equal(b[got_b - 1], np.intersect1d(a, b))


def test_odd_tables(spark):
    df = spark.createDataFrame([(None, None), (None, "one"), (1, "one"), (1, "one")], "doc_id long, text string")
    got = A.score_links(A.align(df, *FILES)).collect()
    assert sorted(r.count_sum for r in got) == [0, 3, 3, 3] and sum(r.n_groups for r in got) == 3
    assert A.score_links(A.align(df.filter("false"), *FILES)).collect() == []


def test_registered_query_on_the_given_table(spark, both):
    sf = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    want = brute_long(both, docs)
    got = {r.doc_id: r for r in queries()["op12_alignment"](spark, sf).collect()}
    assert set(got) == set(docs)
    for i, w in want.items():
        r = got[i]
        assert (r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) == w


def brute_long(both, docs):
    """As ``brute``, with two pointers instead of all pairs, for long texts."""
    own, pieces = both
    known = {}
    for i, t in docs.items():
        a = [(k, letter_bytes(own.id_to_token(k))) for k in own.encode(" " + t, add_special_tokens=False).ids] if t else []
        b = []
        for k in pieces.encode(t) if t else []:
            p = pieces.id_to_piece(k)
            b.append((k, bytes([int(p[3:5], 16)]) if pieces.is_byte(k) else p.replace("▁", " ").encode()))
        raw = (" " + (t or "")).encode()
        if b"".join(x for _, x in a) != raw or b"".join(x for _, x in b) != raw:
            a, b = [], []
        a, b, links, groups, x, y, last = list(spans(a)), list(spans(b)), [], [], 0, 0, (0, 0)
        while x < len(a):
            links.append((a[x][0], b[y][0]))
            end_a, end_b = a[x][2], b[y][2]
            x, y = x + (end_a <= end_b), y + (end_b <= end_a)
            if end_a == end_b:
                groups.append(",".join(str(k[0]) for k in a[last[0] : x]) + "|" + ",".join(str(k[0]) for k in b[last[1] : y]))
                last = (x, y)
        known[i] = (len(a), len(b), groups, links)
    counts, most = Counter(p for *_, links in known.values() for p in set(links)), Counter()
    for (k, _), n in counts.items():
        most[k] = max(most[k], n)
    return {
        i: (na, nb, len(g), len(li), sum(counts[p] == most[p[0]] for p in li), sum(counts[p] for p in li), hashlib.sha256(";".join(g).encode()).hexdigest() if na else "")
        for i, (na, nb, g, li) in known.items()
    }


def test_ids_are_those_of_the_libraries(both):
    """By ranks or by the tokenizer itself, over white space of all kinds, signs, and letters within and beyond the common ones."""
    own, pieces = both
    a, b = A.byte_side(open(FILES[0], "rb").read(), P.PATTERN), A.piece_side(open(FILES[1], "rb").read())
    rng = random.Random(9)
    signs = [" ", " ", "  ", "\n", "\t", "\r\n", "\x0b", "\x1c", "\x85", "\xa0", "'s", "'t", "'", "’", ".", ",", "1", "23", "a", "the", "Über", "ß", "ĳ", "ʰ", "\u02bc", "\u0300", "Ͱ", "漢", "\u2003", "\u200b", "▁", "_", "😀", "²", "½", "<s>"]
    for _ in range(3000):
        text = "".join(rng.choices(signs, k=rng.randint(1, 12)))
        x, y = a.ids([text])[0], b.ids([text])[0]
        assert x is None or x.tolist() == own.encode(" " + text, add_special_tokens=False).ids, repr(text)
        assert y is None or y.tolist() == pieces.encode(text), repr(text)
        joined = b"".join(b.tokens[i] for i in pieces.encode(text))
        assert (y is not None) == (joined == (" " + text).encode()), repr(text)


def test_every_token_alone_has_its_own_id_on_both_ways(both):
    own, _ = both
    a = A.byte_side(open(FILES[0], "rb").read(), P.PATTERN)
    texts = [t for t in (raw.decode("utf-8", "ignore") for raw in a.tokens) if t and max(t) < "\u0370"]
    assert len(texts) > 49_000
    whole = [e.ids for e in own.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)]
    assert [list(x) for x in a.encode(texts)] == whole
