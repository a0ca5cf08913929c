"""Long matches, and the kept words, against the public tokenizer."""

from __future__ import annotations

import base64
import random
import time

import numpy as np
import public_tokenizers as P
import tiktoken

from barloom.llm import bpe

RAW = open(P.path(bpe.VOCABULARY), "rb").read()
RANKS = {base64.b64decode(a): int(b) for a, b in map(bytes.split, RAW.splitlines())}
KNOWN = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})


def words():
    rng = random.Random(3)
    letters = "abcdefghijklmnopqrstuvwxyz"
    for n in (97, 150, 700, 5000):
        yield "".join(rng.choices(letters, k=n))
        yield "".join(rng.choices("etaoinshrdlu", k=n))
        yield "".join(rng.choices("ab", k=n))
        yield letters[n % 26] * n
        yield "-=" * n
        yield "".join(rng.choices("0123456789", k=n))
        yield "".join(chr(rng.randint(0x4E00, 0x4F00)) for _ in range(n))
        yield "".join(rng.choice(["the", "ing", "tion", "Anti", "dis", "establish", "ment", "arian", "ism"]) for _ in range(n))
        yield "ha" * n + "".join(rng.choices("ha", k=n))
        yield " " * n
        yield "!" * n + "?" * n


def test_long_words_are_those_of_the_public_tokenizer():
    coder = bpe.Coder(RAW)
    found = [w for text in words() for w in bpe.split_words(text, P.PATTERN)]
    ids, back = coder.learn(set(found))
    assert sum(len(w.encode()) > bpe.LONG_WORD for w in found) > 30
    for w in found:
        assert np.frombuffer(ids[w], "<u4").tolist() == KNOWN.encode_ordinary(w) and back[w] == w.encode()


def test_a_megabyte_without_a_break_ends():
    rng = random.Random(4)
    word = "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=1_000_000))
    begin = time.perf_counter()
    ids, _ = bpe.Coder(RAW).learn({word})
    assert time.perf_counter() - begin < 120
    parts = np.frombuffer(ids[word], "<u4").tolist()
    at = next(i for i in range(50, 5000) if KNOWN.encode_ordinary(word[: len(KNOWN.decode(parts[:i])) + 400])[:i] == parts[:i])
    assert b"".join(KNOWN.decode_single_token_bytes(t) for t in parts).decode() == word and at == 50


def test_words_are_forgotten_without_harm(monkeypatch):
    monkeypatch.setattr(bpe, "KEPT_BYTES", 5000)
    coder, rng = bpe.Coder(RAW), random.Random(5)
    vocabulary = ["".join(rng.choices("abcdefgh ", k=9)) for _ in range(200)]
    for _ in range(30):
        some = rng.sample(vocabulary, 20)
        ids, back = coder.learn(set(some))
        for w in some:
            one = coder.encode([w.encode()]).to_pylist()[0]
            assert np.frombuffer(ids[w], "<u4").tolist() == one or len(ids[w]) == 4
            assert back[w] == w.encode()
        assert len(coder.young[0]) + len(coder.old[0]) < 80
