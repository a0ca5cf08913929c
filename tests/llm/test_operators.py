"""The document operators against brute force, and on nulls, empty tables, repeated rows and clashing columns."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F

from barloom.llm import bpe, chat, language, mixing, quality, simhash, suffix, token_counts, toxicity
from barloom.llm.exact_dedup import exact_dedup

VOCABULARY = P.path(bpe.VOCABULARY)
SPACE = r"[^\x20\x09-\x0D]+"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, name string, _x int"


def table(spark, texts, start=0):
    rows = [(i + start, t, "en", f"src{i % 3}", 1, "clash", "clash", 0) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, empty and blank texts, a repeated row, one id with two texts, a long text."""
    rows = [
        (None, None, None, None, None, None, None, None), (None, "x y z", None, None, None, None, None, None),
        (1, "", "en", "a", 0, "k", "n", 1), (2, " \n\t ", "en", "a", 0, "k", "n", 1), (3, None, "en", "b", 0, "k", "n", 1),
        (4, "Some words here", "en", "b", 0, "k", "n", 1), (4, "Some words here", "en", "b", 0, "k", "n", 1),
        (5, "one text", "en", "b", 0, "k", "n", 1), (5, "another text", "en", "b", 0, "k", "n", 1),
        (6, "Über ÉTÉ 123 " * 3000, "de", "c", 0, "k", "n", 1), (7, "some WORDS here", "en", None, 0, "k", "n", 1), (8, "123 !!", "en", None, 0, "k", "n", 1),
    ]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def empty(odd):
    return odd.filter("false")


def lowered(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


@pytest.mark.parametrize("route", [F.xxhash64, lambda c: F.crc32(c) % 2])
def test_exact_dedup_names_equal_texts_only(spark, route):
    random.seed(1)
    texts = ["".join(random.choice("aAb") for _ in range(random.choice([0, 3, 16, 40]))) for _ in range(80)]
    groups = defaultdict(list)
    for i, t in enumerate(texts):
        groups[lowered(t)].append(i)
    want = {i: (max(v), len(v), i == max(v), hashlib.sha256(k.encode()).hexdigest()) for k, v in groups.items() for i in v}
    got = exact_dedup(table(spark, texts), block_bytes=8, route=route).collect()
    assert {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in got} == want


def test_exact_dedup_odd_rows(odd, empty):
    got = exact_dedup(odd).collect()
    assert len(got) == 11 and [r.copies for r in got if r.doc_id == 4] == [2]
    assert {r.doc_id for r in got if r.kept and r.text_sha256 == hashlib.sha256(b"").hexdigest()} == {3}
    assert {(r.doc_id, r.kept, r.group_size) for r in got if r.keep_id == 7} == {(4, False, 3), (7, True, 3)}
    assert exact_dedup(empty).count() == 0


def fingerprint(t):
    ws = re.findall(SPACE, lowered(t))
    h = [xxhash.xxh64_intdigest(" ".join(ws[i : i + 3]).encode(), 42) for i in range(max(1, len(ws) - 2))] if ws else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_of_texts(spark):
    texts = ["", "One", "a b", "Éa B c d", "x " * 50, " \x85 a"]
    got = simhash.simhash_groups(table(spark, texts)).collect()
    assert {r.doc_id: r.fingerprint for r in got} == {i: f"{fingerprint(t):016x}" for i, t in enumerate(texts)}


@pytest.mark.parametrize("group", [4, 1024])
def test_pigeonhole_links_connect_what_brute_force_connects(spark, group):
    random.seed(2)
    prints = {random.getrandbits(64) for _ in range(40)}
    for f in list(prints)[:8]:
        for _ in range(12):
            f ^= sum(1 << b for b in random.sample(range(64), random.randint(1, 4)))
            prints.add(f)
    signed = sorted(f - (1 << 64) if f >> 63 else f for f in prints)
    root = {f: f for f in signed}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    for i, a in enumerate(signed):
        for b in signed[:i]:
            if ((a ^ b) & (1 << 64) - 1).bit_count() <= 3 and find(a) != find(b):
                root[max(find(a), find(b))] = min(find(a), find(b))
    distinct = spark.createDataFrame([(f,) for f in signed], "fp long")
    got = {r.v: r.label for r in simhash.components(simhash.block_links(distinct, group)).collect()}
    assert {f: got.get(f, f) for f in signed} == {f: find(f) for f in signed}


def test_long_chain_is_one_component(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(300)], "a long, b long")
    assert {r.label for r in simhash.components(links).collect()} == {0}


def test_simhash_odd_rows(odd, empty):
    got = simhash.simhash_groups(odd).collect()
    assert len(got) == 12 and {r.component_id for r in got if r.fingerprint == "0" * 16} == {1}
    assert simhash.simhash_groups(empty).count() == 0


def measured(t):
    ws, lines = re.findall(SPACE, t or ""), [x for x in (t or "").split("\n") if re.search(SPACE, x)]
    seen = Counter(tuple(ws[i : i + 5]) for i in range(len(ws) - 4))
    covered = {k for i in range(len(ws) - 4) if seen[tuple(ws[i : i + 5])] > 1 for k in range(i, i + 5)}
    return len(ws), sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(covered)


def test_quality_measures(spark, odd, empty):
    random.seed(3)
    texts = [" ".join(random.choice(["a", "b", "$c", "d\n", "é"]) for _ in range(random.randint(0, 60))) for _ in range(60)]
    got = quality.quality_rules(table(spark, texts)).collect()
    assert {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got} == {i: measured(t) for i, t in enumerate(texts)}
    assert [r.kept for r in quality.quality_rules(odd).collect()].count(False) == 12
    assert quality.quality_rules(empty).count() == 0


def test_bad_host_loses_all_and_good_host_keeps_clean(spark):
    clean = [" ".join(f"w{i}x{k}" for k in range(30)) for i in range(200)]
    rows = [(i, t, "bad" if i % 4 == 0 else "good") for i, t in enumerate(clean)] + [(1000 + i, "$ " * 30, "bad") for i in range(400)]
    got = quality.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert {r.doc_id for r in got if r.kept} == {i for i in range(200) if i % 4}


def repeats(docs, n):
    raw = [(d, (t or "").encode()) for d, t in docs]
    seen, out = Counter(t[i : i + n] for _, t in raw for i in range(len(t) - n + 1)), []
    for d, t in raw:
        gone = np.zeros(len(t), dtype=bool)
        for i in range(len(t) - n + 1):
            gone[i : i + n] |= seen[t[i : i + n]] > 1
        kept = bytes(b for b, g in zip(t, gone, strict=True) if not g)
        spans = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        out.append((d, len(t), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("trial", range(60))
def test_repeated_windows(trial):
    random.seed(trial)
    n, letters = random.choice([2, 3, 5, 8]), random.choice(["ab\0", "abcdef"])
    texts = ["".join(random.choice(letters) for _ in range(random.randint(0, 40))).encode() for _ in range(random.randint(1, 6))]
    seen = Counter(t[i : i + n] for t in texts for i in range(len(t) - n + 1))
    for t, found in zip(texts, suffix.repeated_windows(texts, n), strict=True):
        assert found.tolist() == [i + n <= len(t) and seen[t[i : i + n]] > 1 for i in range(len(t))]


@pytest.mark.parametrize("group", [1, 3, 1000])
def test_remove_repeats(spark, group):
    random.seed(4)
    docs = [(i, random.choice(["xy", "abcabcabc", "hello é "]) * random.randint(0, 20) + "".join(random.choice("ab") for _ in range(random.randint(0, 60)))) for i in range(50)]
    docs += [(None, "q" * 50), (7, "q" * 50), (7, "q" * 50), (99, None), (98, "")]
    got = suffix.digests(suffix.remove_repeats(spark.createDataFrame(docs, "doc_id long, text string"), length=20, gram=6, group=group, batch_bytes=300))
    assert sorted(map(tuple, got.collect()), key=str) == repeats(docs, 20)


def test_remove_repeats_odd_rows(odd, empty):
    docs = [(r.doc_id, r.text) for r in odd.collect()]
    assert sorted(map(tuple, suffix.digests(suffix.remove_repeats(odd, length=10, gram=4)).collect()), key=str) == repeats(docs, 10)
    assert suffix.remove_repeats(empty).count() == 0


ENCODING = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(open(VOCABULARY, "rb").read()), special_tokens={})


def test_bpe_is_the_public_tokenizers(spark, odd, empty):
    texts = [
        "", " ", "a\x1cb \x85 　x y", "\U0001f600\U00020000a  b", "'S I'll we're can't  \n\n x", "Ⅷ²½ 一二三", "x" * 3000, "ab" * 800 + "q" * 900, "\x00​",
    ]
    for df, n in ((table(spark, texts), len(texts)), (odd, 12)):
        rows = bpe.encode_decode(df, VOCABULARY, P.PATTERN, slice_bytes=100).collect()
        assert len(rows) == n
        for r in rows:
            ids = ENCODING.encode_ordinary(r.text or "")
            assert np.frombuffer(r.ids, "<u4").tolist() == ids and r.n_tokens == len(ids) and bytes(r.decoded) == (r.text or "").encode()
    assert bpe.encode_decode(empty, VOCABULARY, P.PATTERN).count() == 0


def test_automaton_counts_greedy_pieces():
    pieces = {b"a", b"abcdx", b"b", b"c", b"cdy", b"dz"}

    def greedy(w):
        n = 0
        while w:
            k = next((k for k in range(len(w), 0, -1) if w[:k] in pieces), 0)
            if not k:
                return -1
            w, n = w[k:], n + 1
        return n

    automaton = token_counts.Automaton(pieces)
    random.seed(5)
    for _ in range(5000):
        w = bytes(random.choice(b"abcdxyz") for _ in range(random.randint(0, 9)))
        assert automaton.count(w) == greedy(w)


def test_token_counts(odd, empty):
    ranks = bpe.read_ranks(open(VOCABULARY, "rb").read())

    def greedy(w):
        n = 0
        while w:
            k = next(k for k in range(len(w), 0, -1) if w[:k] in ranks)
            w, n = w[k:], n + 1
        return n

    for r in token_counts.token_counts(odd, VOCABULARY, P.PATTERN).collect():
        ws = bpe.split_words(r.text or "", P.PATTERN)
        assert (r.n_words, r.n_tokens, r.n_unknown) == (len(ws), sum(greedy(w.encode()) for w in ws), 0)
    assert token_counts.token_counts(empty, VOCABULARY, P.PATTERN).count() == 0


def test_mixing_reaches_targets(spark, odd, empty):
    random.seed(6)
    rows = [(i, "w " * random.randint(1, 60), random.choice(["a", "b", "c", "d", None])) for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix_sources(df, range_docs=50).collect()
    assert len(got) == 3000 and max(r._copies for r in got) <= 3
    for s in ("a", "b", "c", "d", None):
        own = [r for r in got if r.source == s]
        assert abs(sum(r._copies * r._size for r in own) - own[0]._target) <= 0.002 * own[0]._target + 60
    assert {(r.doc_id, r._copies) for r in mixing.mix_sources(df, range_docs=50).collect()} == {(r.doc_id, r._copies) for r in got}
    assert mixing.mix_sources(odd).count() == 12 and mixing.mix_sources(empty).count() == 0


def test_targets_are_shared_again():
    sizes = {"a": 10, "b": 100, None: 890}
    got = mixing.targets(sizes, 1000)
    assert got["a"] == 30 and got["b"] == 300 and got[None] == 670


def test_route_prefers_fresh_words():
    patterns = [(("a",), 100), (("a", "b"), 100), (("b",), 100)]
    sent = mixing.route(patterns, {"a": 150, "b": 150})
    used = [sum(n for (p, _), n in sent.items() if p == i) for i in range(3)]
    assert used == [100, 100, 100] and sum(sent.values()) == 300
    assert sum(mixing.route([(("a",), 10)], {"a": 25}).values()) == 25


def test_language_held_out(spark, odd, empty):
    random.seed(7)
    stems = {"en": ["the", "thing", "when"], "de": ["schen", "ung", "keit"], "fr": ["eaux", "tion", "é"], "es": ["ción", "ll", "ñ"]}
    rows = [(i, " ".join("".join(random.choices(stems[x], k=3)) for _ in range(20)), x) for i in range(400) for x in [random.choice(list(stems))]]
    got = language.language_id(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    truth = {i: x for i, _, x in rows}
    assert all(r.lang_pred == truth[r.doc_id] and 0 <= r.score <= 1 for r in got if r.held_out)
    found = language.language_id(odd).collect()
    assert len(found) == 12 and {r.lang_pred for r in found if r.doc_id in (1, 2, 3, 8)} == {"und"}
    assert language.language_id(empty).count() == 0


def test_toxicity(spark, odd, empty):
    random.seed(8)
    words = ["alpha", "beta", "gamma", "delta", "omega", "sigma"]
    rows = [(i, " ".join(random.choices(words, k=30) + ["idiot", "moron"] * (i % 5 == 0))) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 0, int(i % 5 == 0)) for i in range(600)] + [(None, 0, 1), (3, 0, None)], "doc_id long, quality int, toxic int")
    got = toxicity.toxicity(docs, labels).collect()
    assert all(r.predicted == int(r.doc_id % 5 == 0) for r in got) and any(r.held_out for r in got)
    found = toxicity.toxicity(odd, labels).collect()
    assert len(found) == 12 and all(0 <= r.score <= 1 for r in found)
    assert toxicity.toxicity(empty, labels).count() == 0 and {r.score for r in toxicity.toxicity(odd, labels.filter("false")).collect()} == {0.0}


@pytest.mark.parametrize("frequent", [0, 6, 100])
def test_block_max_search_is_exact(frequent):
    rng = np.random.default_rng(9)
    rows = [(i, int(rng.integers(2)), sorted(rng.choice(20, rng.integers(1, 6), replace=False).tolist()), None) for i in range(200)]
    rows = [(i, y, t, rng.integers(1, 4, len(t)).tolist()) for i, y, t, _ in rows]
    index = toxicity.build_index(rows, 1 + rng.random(20), block=16, frequent=frequent)
    dense = np.zeros((len(index.ids), 20))
    for t, (places, values) in enumerate(index.postings):
        dense[places, t] = values
    term = np.concatenate([np.sort(rng.choice(20, 4, replace=False)) for _ in range(50)])
    row = np.repeat(np.arange(50), 4)
    w = index.weights(row, term, np.ones(200))
    for i, (near, cosines) in enumerate(index.nearest(51, row, term, w, 7)):
        best = np.sort(dense[:, term[row == i]] @ w[row == i])[::-1][:7] if i < 50 else np.zeros(7)
        assert np.allclose(cosines, best[: len(cosines)]) and (len(near) == 7 or best[len(near)] <= 1e-12)


def test_chat_layouts_and_round_trip(spark):
    records = [
        '{"prompt":"a","response":"</s>[INST] [\\\\INST] x"}', '{"instruction":"i","input":"q","output":"é"}', '{"instruction":"i","output":null}', '{"completion":"c","prompt":"p"}',
        '{"messages":[{"role":"system","content":"s"},{"role":null,"content":null}]}', '{"conversations":[{"from":"human","value":"h"},{"from":"gpt","value":"g"}]}', '{"other":1}', "broken", None,
    ]
    df = chat.format_chats(spark.createDataFrame(list(enumerate(records)), "id int, record string"))
    got = {r.id: r for r in df.withColumns({"t": chat.read_turns(F.col("formatted")), "loss": chat.read_loss(F.col("formatted"), F.col("loss_mask"))}).collect()}
    turns = {i: [tuple(t) for t in r.t] if r.t is not None else None for i, r in got.items()}
    assert turns[0] == [("user", "a"), ("assistant", "</s>[INST] [\\INST] x")] and got[0].loss == "</s>[INST] [\\INST] x"
    assert turns[1] == [("system", "i"), ("user", "q"), ("assistant", "é")]
    assert turns[2] == [("user", "i"), ("assistant", "")] and turns[3] == [("user", "p"), ("assistant", "c")]
    assert turns[4] == [("system", "s"), ("", "")] and turns[5] == [("user", "h"), ("assistant", "g")]
    assert turns[6] is turns[7] is turns[8] is None
