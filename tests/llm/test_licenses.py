"""Licence scans against a plain version of the rules, and on odd input."""

from __future__ import annotations

import random
import re

import pytest

from barloom.llm import licenses as L
from barloom.llm.license_rules import RULES

SCHEMA = "doc_id long, text string, labels int, _row string, _words string"


def plain(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    ws = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)
    places = sorted((i, label) for phrase, label in L.BASE for i in range(len(ws)) if ws[i : i + len(phrase.split())] == phrase.split())
    marked = "".join(f"<{w}>" for w in ws)
    starts = [0]
    for w in ws:
        starts.append(starts[-1] + len(w) + 2)
    word = {at: i for i, at in enumerate(starts)}
    hits = [(word[m.start()], word[m.end()], r) for r in RULES for m in re.finditer(r.pattern, marked)]
    left = []
    for s, e, r in hits:
        def beats(s2, e2, r2):
            if (s2, e2, r2) == (s, e, r) or not (s2 <= s and e <= e2) or r2.priority < r.priority:
                return False
            return (s2, e2, r2.priority) != (s, e, r.priority) or r2.number < r.number
        if not any(beats(*h) for h in hits):
            left.append((s, e, r.number, r.label))
    labels = sorted({label for _, label in places} | {x[3] for x in left})
    score = max([L.SURE[RULES[x[2]].priority] for x in left] + [0.5] * bool(places) + [0.0])
    ends = (places[0][0], places[-1][0]) if places else (None, None)
    return (len(ws), len(places), *ends, ",".join(sorted({label for _, label in places})), ",".join(labels), score, sorted(left))


def sample(pattern):
    """Some text that the pattern matches."""
    pattern = re.sub(r"\(\?:<\[\^>\]\*>\)\{0,(\d+)\}", lambda m: "<filler>" * random.randint(0, int(m[1])), pattern)
    pattern = re.sub(r"\(\?:(<(?:[^<>()]|\(\?:[^()]*\))*>)\)\?", lambda m: m[1] if random.random() < 0.5 else "", pattern)
    pattern = re.sub(r"\(\?:([^()]*)\)", lambda m: random.choice(m[1].split("|")), pattern).replace("[0-9]+", "2024")
    return " ".join(re.findall(r"<([^>]*)>", pattern))


TEXTS = [
    None, "", " \n\t", "no terms here", "Licensed under CC BY-NC 4.0", "CC-BY cc by CC BY", "commit license", "the MIT licenses", "mıt license",
    "GNU General Public License, version 3. All Rights Reserved. GENERAL PUBLIC LICENSE", "all rights reserved all rights reserved", "éall rights reserved",
    "MIT License MIT License mit license", "gnu lesser general public license version 2.1", "<all><rights> reserved < gpl >", "\x00cc\x00by\x00", "cc by " * 500,
    "Copyright (c) 2024 Some Person. All rights reserved.", "x" * 5000 + " public domain " + "y " * 5000,
]


def test_rules_are_well_formed():
    assert len(RULES) > 200 and len({r.pattern for r in RULES}) > 0.95 * len(RULES)
    random.seed(6)
    for r in RULES:
        assert set(L.SURE) >= {r.priority} and not re.fullmatch(r.pattern, "")
        text = sample(r.pattern)
        assert re.search(r.pattern, "".join(f"<{w}>" for w in text.split())) and r.keyword in text.split(), r


def test_scans_are_those_of_the_plain_version(spark):
    random.seed(7)
    filler = "some other words of a text with a license or gpl in it cc by mit version 2 0 only".split()
    texts = list(TEXTS) + [sample(r.pattern) for r in RULES]
    for _ in range(60):
        parts = [random.choice([sample(random.choice(RULES).pattern).upper(), " ".join(random.choices(filler, k=4))]) for _ in range(random.randint(1, 8))]
        texts.append(random.choice([" ", ". ", ", "]).join(parts))
    df = spark.createDataFrame([(i, t, 1, "clash", "clash") for i, t in enumerate(texts)], SCHEMA).repartition(4)
    got = L.scan_licenses(df).collect()
    assert {(r._row, r._words) for r in got} == {("clash", "clash")} and len(got) == len(texts)
    for r in got:
        found = [(d.start_word, d.end_word, d.rule, d.label) for d in r.detections]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, r.score, found) == plain(texts[r.doc_id]), texts[r.doc_id]


def test_priorities_decide():
    assert plain("licensed under the gnu general public license")[5] == "gpl"
    assert plain("gnu lesser general public license version 2 1")[5] == "gpl,lgpl-2.1"  # the base label stays


def test_odd_tables(spark):
    df = spark.createDataFrame([(None, None), (None, "mit license"), (1, "mit license"), (1, "mit license")], "doc_id long, text string")
    assert sorted((str(r.doc_id), r.labels) for r in L.scan_licenses(df).collect()) == [("1", "mit"), ("1", "mit"), ("None", ""), ("None", "mit")]
    assert L.scan_licenses(df.filter("false")).collect() == [] and L.scan_licenses(df.filter("text is null")).first().score == 0.0


@pytest.mark.parametrize("n", [3000])
def test_thousands_of_detections_in_a_text(spark, n):
    df = spark.createDataFrame([(1, "All rights reserved. MIT License. " * n)], "doc_id long, text string")
    r = L.scan_licenses(df).select("n_base", "labels", "last_word", "score").first()
    assert (r.n_base, r.labels, r.last_word) == (n, "mit,reserved", 5 * n - 5) and r.score == 0.8
