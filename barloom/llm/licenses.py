"""Licence scans by ordered signature rules.

A text becomes its lower-cased words, written as ``<word><word>...`` if one of the rules' keywords is among them; only the
rules whose keyword is there are then matched. Where they match is read off the pieces between the matches. Detections of a
document that overlap are resolved in one ordered pass: a detection that lies within one of the same or a higher priority
is suppressed; of equal intervals and priorities the first rule stays. No Python runs on the way.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barloom.llm.common import ascii_lower, fresh, stored, whole_text
from barloom.llm.license_rules import RULES, Rule

#: What separates words, after lower-casing: every ASCII character but digits and lower-case letters.
BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Phrases whose label a text has wherever their words stand one after the other.
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
#: How sure a detection of each priority is; a phrase of the base alone is as sure as the first.
SURE = {1: 0.5, 2: 0.8, 3: 0.95}


def _marked(words: str) -> str:
    return "".join(f"<{w}>" for w in words.split())


def _word_count(marked: Column) -> Column:
    return F.length(marked) - F.length(F.replace(marked, F.lit("<"), F.lit("")))


def _rule_table(rules: list[Rule]) -> Column:
    """The rules as a constant array, ordered by number."""
    rows = json.dumps([r._asdict() for r in rules])
    return F.from_json(F.lit(rows), "array<struct<number:int,label:string,priority:int,keyword:string,pattern:string>>")


def scan(df: DataFrame, text: str = "text", carry: list[str] | None = None, rules: list[Rule] = RULES) -> DataFrame:
    """The columns in ``carry``, n_words, n_base, first_word, last_word, base_labels, and in ``_hits`` for each rule that
    matches: its number, the words between its matches (``gaps``) and in them (``sizes``)."""
    carry = df.columns if carry is None else carry
    keywords = sorted({r.keyword for r in rules} | {p.split()[0] for p, _ in BASE})
    df = df.select(*carry, F.array_remove(F.split(ascii_lower(whole_text(text)), BREAK), "").alias("_words"))
    given = F.array(*[F.lit(k) for k in keywords])
    df = df.withColumn("_found", F.array_intersect("_words", given)).withColumn("n_words", F.size("_words").cast("long"))
    df = df.withColumn("_marked", F.when(F.size("_found") > 0, F.concat(F.lit("<"), F.array_join("_words", "><"), F.lit(">"))))
    df = df.drop("_words")
    pieces = {label: F.when(F.array_contains("_found", phrase.split()[0]), F.split("_marked", _marked(phrase))) for phrase, label in BASE}
    df = df.withColumns({f"_base_{label}": F.when(F.size(p) > 1, F.transform(p, _word_count)) for label, p in pieces.items()})
    counts = [F.coalesce(F.size(F.col(f"_base_{label}")) - 1, F.lit(0)) for _, label in BASE]
    firsts = [F.get(F.col(f"_base_{label}"), F.lit(0)) for _, label in BASE]
    lasts = [F.col("n_words") - F.element_at(F.col(f"_base_{label}"), -1) - len(phrase.split()) for phrase, label in BASE]
    labels = F.array_compact(F.array(*[F.when(F.col(f"_base_{label}").isNotNull(), label) for _, label in sorted(BASE, key=lambda b: b[1])]))

    def hit(r: Column) -> Column:
        between = F.split("_marked", r["pattern"])
        inside = F.regexp_extract_all("_marked", r["pattern"], F.lit(0))
        return F.when(
            F.size(between) > 1, F.struct(r["number"].alias("rule"), F.transform(between, _word_count).alias("gaps"), F.transform(inside, _word_count).alias("sizes"))
        )

    hits = F.array_compact(F.transform(F.filter(_rule_table(rules), lambda r: F.array_contains("_found", r["keyword"])), hit))
    return df.select(
        *carry, "n_words", sum(counts[1:], counts[0]).cast("long").alias("n_base"), F.least(*firsts).cast("long").alias("first_word"),
        F.greatest(*lasts).cast("long").alias("last_word"), labels.alias("base_labels"), F.when(F.col("_marked").isNotNull(), hits).alias("_hits"),
    )


def detections(scanned: DataFrame, row: str, rules: list[Rule] = RULES) -> DataFrame:
    """(row, rule, label, priority, start_word, end_word) of the detections that no other one suppresses."""
    one = scanned.select(row, F.explode("_hits").alias("_h")).select(
        row, "_h.rule", F.posexplode(F.arrays_zip(F.slice("_h.gaps", 1, F.size("_h.sizes")).alias("gap"), F.col("_h.sizes").alias("size"))).alias("_at", "_g")
    )
    so_far = Window.partitionBy(row, "rule").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    meta = F.get(_rule_table(rules), F.col("rule"))
    one = one.select(
        row, "rule", meta["label"].alias("label"), meta["priority"].alias("priority"), F.col("_g.size").alias("_size"),
        F.sum(F.col("_g.gap") + F.col("_g.size")).over(so_far).alias("end_word"),
    ).withColumn("start_word", F.col("end_word") - F.col("_size"))
    # what contains a detection with no less priority comes before it in this order
    before = Window.partitionBy(row).orderBy("start_word", F.desc("end_word"), F.desc("priority"), "rule").rowsBetween(Window.unboundedPreceding, -1)
    reach = {p: F.max(F.when(F.col("priority") >= p, F.col("end_word"))).over(before) for p in SURE}
    inside = F.lit(False)
    for p, end in reach.items():
        inside = inside | ((F.col("priority") == p) & (F.coalesce(end, F.lit(-1)) >= F.col("end_word")))
    return one.withColumn("_inside", inside).filter("NOT _inside").select(row, "rule", "label", "priority", "start_word", "end_word")


def scan_licenses(df: DataFrame, text: str = "text", carry: list[str] | None = None, rules: list[Rule] = RULES) -> DataFrame:
    """Add n_words, n_base, first_word, last_word, base_labels, labels, score and detections to the columns in ``carry``.

    Words are runs of digits, letters a-z (A-Z are lower-cased) and anything beyond ASCII. n_base counts the places of the base
    phrases, first_word and last_word are the least and greatest word at which one begins (null without any). detections lists
    rule, label, start_word and end_word of what is left after suppression, in order of the text; labels joins their labels and
    base_labels, distinct and sorted, by commas; score is that of the surest one, 0 without any. Null and empty texts have no
    words. Rows stay as they are, repeated ones too; columns of ``df`` with the new names are replaced.
    """
    added = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "detections"]
    carry = [c for c in (df.columns if carry is None else carry) if c not in added]
    names = {c: f"c{i}" for i, c in enumerate(carry)}  # free of clashes with the working columns
    row = fresh("_row", carry)
    source = df.select(*[F.col(c).alias(n) for c, n in names.items()], F.col(text).alias("_text"))
    scanned = scan(source, "_text", list(names.values()), rules).withColumn(row, F.monotonically_increasing_id())
    scanned = stored(scanned)  # written, so that row numbers stay
    found = detections(scanned.select(row, "_hits"), row, rules)
    sure = F.create_map(*[F.lit(x) for pair in SURE.items() for x in pair])
    listed = F.array_sort(F.collect_list(F.struct("start_word", "end_word", "rule", "label")))
    found = found.groupBy(row).agg(F.collect_set("label").alias("_labels"), F.max(F.element_at(sure, F.col("priority"))).alias("_sure"), listed.alias("detections"))
    joined = scanned.drop("_hits").join(stored(found), row, "left")
    every = F.array_sort(F.array_union("base_labels", F.coalesce("_labels", F.array().cast("array<string>"))))
    base_sure = F.when(F.size("base_labels") > 0, SURE[1]).otherwise(0.0)
    return joined.select(
        *[F.col(n).alias(c) for c, n in names.items()], "n_words", "n_base", "first_word", "last_word", F.array_join("base_labels", ",").alias("base_labels"),
        F.array_join(every, ",").alias("labels"), F.greatest(F.coalesce("_sure", F.lit(0.0)), base_sure).alias("score"),
        F.coalesce("detections", F.array().cast(dict(found.dtypes)["detections"])).alias("detections"),
    )
