"""Toxicity by nearest labelled examples.

A bounded sample of labelled documents is indexed: postings of exact TF-IDF weights by term, the examples in blocks, and
for each frequent term its largest weight in each block. A slice of documents is searched at once: the postings of the rarer
terms are added up; with the block maxima of the frequent terms they bound the cosine in every block; the blocks with the
highest bounds are scored first, as products of matrices, and then those whose bound is no less than the k-th cosine found.
So the k nearest examples are exact, up to single precision. They vote, weighted by distance; a logistic curve fitted to the examples' own
leave-one-out votes turns the vote into a score.

Terms are all words of the sample and their beginnings of four to six letters. None is dropped: a term's weight is its
TF-IDF times its association with the label in the sample, so words that go with neither label hardly turn a vector.
Document frequencies are counted over all documents.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructType

from barloom.llm.common import crc_mod, per_process, slices, stored, whole_text

FOLDS, HELD_OUT = 5, 0
#: Examples of each label, about; bytes of a text that can be one; neighbours; examples in a block; least association of a term.
PER_LABEL, EXAMPLE_BYTES, NEIGHBOURS, BLOCK, LEAST = 2000, 1 << 20, 15, 64, 1e-4
#: Terms with a row of block maxima and weights of all examples; documents searched at once, and blocks scored before the k-th cosine is known.
FREQUENT, TOGETHER, FIRST_BLOCKS = 2048, 64, 6
#: Weights of frequent terms are kept in single precision: how much less a bound may be for that.
SINGLE = 1e-5
_WORD, KEPT_WORDS = re.compile(r"[^\W\d_]+"), 300_000
_ASCII_WORD = re.compile("[a-z]+")


def words_of(text: str) -> list[str]:
    """The words of a text, lower-cased: runs of letters. ASCII texts go by a plain class."""
    low = text.lower()
    return (_ASCII_WORD if low.isascii() else _WORD).findall(low)


def chain(word: str) -> list[str]:
    """The terms of a word, each followed by the next one that every word with it has too."""
    return [word, *[word[:n] + "*" for n in (6, 5, 4) if len(word) >= n]]


def deepest(word: str, terms: dict[str, int]) -> int:
    """The first known term of the word's chain, which stands for all known ones; -1 if none is known."""
    return next((terms[t] for t in chain(word) if t in terms), -1)


def spread(row: np.ndarray, term: np.ndarray, count: np.ndarray, parent: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows with their terms, sorted, and counts, from the deepest terms: each counts for the rest of its chain (``parent``)."""
    keys, times = [], []
    while len(term):
        keys.append(row * len(parent) + term)
        times.append(count)
        up = parent[term]
        row, term, count = row[up >= 0], up[up >= 0], count[up >= 0]
    if not keys:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0)
    every, at = np.unique(np.concatenate(keys), return_inverse=True)
    return every // len(parent), every % len(parent), np.bincount(at, np.concatenate(times))


def _listed(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, term and count of all entries of the lists ``terms`` and ``counts``."""
    sizes = part.column("terms").value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    flat = [part.column(c).flatten().to_numpy(zero_copy_only=False).astype(np.int64) for c in ("terms", "counts")]
    return np.repeat(np.arange(part.num_rows), sizes), *flat


def term_counts(df: DataFrame, shared, carry: list[str], text: str = "text") -> DataFrame:
    """Add terms and counts (of the deepest known term of each word of the text) to the columns in ``carry``.

    ``shared`` broadcasts the terms, in order, as one Arrow array.
    """
    source = df.select(*carry, whole_text(text).alias("_text"))

    mark = uuid.uuid4().hex

    def run(batches):
        terms, known = per_process("terms", mark, lambda: ({t: i for i, t in enumerate(shared.value.to_pylist())}, {}))
        for part in slices(batches, "_text", 4 << 20):
            cuts, found, times = [0], [], []
            for text in part.column("_text").to_pylist():
                counts: dict[int, int] = {}
                for word, n in Counter(words_of(text)).items():
                    if (t := known.get(word)) is None:
                        if len(known) > KEPT_WORDS:
                            known.clear()
                        t = known[word] = deepest(word, terms)
                    if t >= 0:
                        counts[t] = counts.get(t, 0) + n
                found += counts
                times += counts.values()
                cuts.append(len(found))
            columns = [pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(np.array(x, dtype=np.int32))) for x in (found, times)]
            yield pa.RecordBatch.from_arrays([*[part.column(c) for c in carry], *columns], names=[*carry, "terms", "counts"])

    schema = StructType(source.schema.fields[:-1]).add("terms", ArrayType(IntegerType())).add("counts", ArrayType(IntegerType()))
    return source.mapInArrow(run, schema)


def document_frequencies(counted: DataFrame, shared) -> DataFrame:
    """(t, n): how many rows hold term t; each task sends one row per term. ``shared`` broadcasts the parents of the terms."""

    def run(batches):
        parent = shared.value
        n = np.zeros(len(parent), dtype=np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, TOGETHER):
                n += np.bincount(spread(*_listed(batch.slice(at, TOGETHER)), parent)[1], minlength=len(n))
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(n[at], pa.int64())], names=["t", "n"])

    return counted.select("terms", "counts").mapInArrow(run, "t int, n long").groupBy("t").agg(F.sum("n").alias("n"))


def labelled(docs: DataFrame, labels: DataFrame, per_label: int = PER_LABEL) -> DataFrame:
    """(doc_id, text, toxic) of about ``per_label`` documents of each label, chosen by a hash of doc_id.

    An id with several labels counts as toxic if one is; a null label is none. Of an id with several texts the least is
    taken; a text of more than EXAMPLE_BYTES is no example.
    """
    known = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    known = known.filter(crc_mod("doc_id", FOLDS) != HELD_OUT)
    totals = known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n"))
    share = (F.xxhash64(F.col("doc_id"), F.lit(9)) / 2.0**64 + 0.5) * F.col("n")
    chosen = known.join(F.broadcast(totals), "toxic").filter(share < per_label)
    fitting = docs.select("doc_id", "text").filter(F.octet_length("text") <= EXAMPLE_BYTES)
    return fitting.join(F.broadcast(chosen.select("doc_id", "toxic")), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))


def sample_terms(sample: DataFrame) -> tuple[list[str], np.ndarray, np.ndarray]:
    """All terms of the sample, for each the next one of its chain or -1, and its association with the label: its
    chi-square over the number of examples."""

    def run(batches):
        for part in slices(batches, "text", 4 << 20):
            rows = [(t, y) for text, y in zip(part.column("text").to_pylist(), part.column("toxic").to_pylist(), strict=True) for t in set().union(*map(chain, set(words_of(text or ""))))]
            yield pa.RecordBatch.from_arrays([pa.array([t for t, _ in rows], pa.string()), pa.array([y for _, y in rows], pa.int32())], names=["term", "toxic"])

    sides = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    pos, neg = sides.get(1, 0), sides.get(0, 0)
    counts = sample.select("text", "toxic").mapInArrow(run, "term string, toxic int").groupBy("term").agg(F.sum("toxic").alias("a"), F.count(F.lit(1)).alias("all"))
    found = counts.toArrow().sort_by("term")  # per_label bounds it
    names = found.column("term").to_pylist()
    terms = {t: i for i, t in enumerate(names)}
    ups = [(w[:-2] + "*" if len(w) > 5 else None) if w.endswith("*") else (w[: min(len(w), 6)] + "*" if len(w) >= 4 else None) for w in names]
    parent = np.array([terms[u] if u else -1 for u in ups], dtype=np.int64)
    a = found.column("a").to_numpy().astype(float)
    b = found.column("all").to_numpy() - a
    c, d = pos - a, neg - b
    return names, parent, (a * d - b * c) ** 2 / ((a + b) * (c + d + 1e-9) * max(pos, 1) * max(neg, 1))


def _ranges(start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The numbers of all half-open ranges, one range after the other."""
    n = end - start
    return np.repeat(start - np.cumsum(n) + n, n) + np.arange(n.sum())


@dataclass
class ExampleIndex:
    """Postings sorted by term and example. Plain arrays: tasks get its fields, not the object.

    A term that is in the same examples, as often, as the next one of its chain has the same postings but for a factor. Only
    the ``head`` of such terms has postings; ``share`` is the factor by which the weight of a term counts there.
    """

    ids: list
    labels: np.ndarray
    idf: np.ndarray
    places: np.ndarray
    values: np.ndarray
    starts: np.ndarray
    head: np.ndarray
    share: np.ndarray
    block: int
    curve: tuple[float, float] = (6.0, -3.0)
    prior: float = 0.0
    frequent: int = FREQUENT
    dense: np.ndarray = field(init=False, repr=False)

    def __post_init__(self) -> None:
        """The weights of the frequent terms as a matrix, its block maxima, and the column of each of these terms."""
        sizes = np.diff(self.starts)
        chosen = np.argsort(-sizes, kind="stable")[: self.frequent]
        chosen = np.sort(chosen[sizes[chosen] > 0])
        self.column = np.full(len(sizes), -1)
        self.column[chosen] = np.arange(len(chosen))
        self.blocks = -(-len(self.ids) // self.block)
        self.dense = np.zeros((self.blocks * self.block, len(chosen)), dtype=np.float32)
        rows = _ranges(self.starts[chosen], self.starts[chosen + 1])
        self.dense[self.places[rows], np.repeat(np.arange(len(chosen)), sizes[chosen])] = self.values[rows]
        self.most = self.dense.reshape(self.blocks, self.block, len(chosen)).max(axis=1) if self.blocks else np.zeros((0, len(chosen)), dtype=np.float32)

    def given(self) -> dict:
        """What makes the same index again."""
        names = ("ids", "labels", "idf", "places", "values", "starts", "head", "share", "block", "curve", "prior", "frequent")
        return {n: getattr(self, n) for n in names}

    @property
    def postings(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """Of each term: its examples and their weights."""
        return [(self.places[a:b], self.values[a:b] * x) for a, b, x in zip(self.starts[self.head], self.starts[self.head + 1], self.share, strict=True)]

    def weights(self, row: np.ndarray, term: np.ndarray, count: np.ndarray) -> np.ndarray:
        """Unit vectors of the rows."""
        w = (1.0 + np.log(count)) * self.idf[term]
        return w / np.sqrt(np.bincount(row, w * w))[row]

    def nearest(self, n: int, row: np.ndarray, term: np.ndarray, weight: np.ndarray, k: int, skip: np.ndarray | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each of ``n`` rows the k nearest examples with a positive cosine (ties: the first of the index) and their cosines."""
        width = self.blocks * self.block
        if not width or not len(row):
            return [(np.zeros(0, dtype=np.int64), np.zeros(0))] * n
        keys, at = np.unique(row * len(self.head) + self.head[term], return_inverse=True)
        row, term, weight = keys // len(self.head), keys % len(self.head), np.bincount(at, weight * self.share[term])
        rare = self.column[term] < 0
        start, sizes = self.starts[term[rare]], self.starts[term[rare] + 1] - self.starts[term[rare]]
        cuts, own = np.searchsorted(row[rare], np.arange(n + 1)), weight[rare]
        ends = np.cumsum(sizes)
        steps, known = np.arange(ends[-1] if len(ends) else 0), np.zeros((n, width))
        shift = start - (ends - sizes)
        for i in np.flatnonzero(np.diff(cuts)):  # a row's postings at a time stay in the cache
            x = slice(cuts[i], cuts[i + 1])
            at = np.repeat(shift[x], sizes[x])
            at += steps[ends[x.stop - 1] - len(at) : ends[x.stop - 1]]
            known[i] = np.bincount(self.places.take(at), np.repeat(own[x], sizes[x]) * self.values.take(at), minlength=width)
        often = np.zeros((n, self.dense.shape[1]), dtype=np.float32)
        often[row[~rare], self.column[term[~rare]]] = weight[~rare]
        bounds = often @ self.most.T + known.reshape(n, self.blocks, self.block).max(axis=2)
        cosines = np.zeros((n, width))

        def visit(wanted: np.ndarray) -> None:
            for b in np.flatnonzero(wanted.any(axis=0)):
                own, cut = np.flatnonzero(wanted[:, b]), slice(b * self.block, (b + 1) * self.block)
                cosines[own, cut] = known[own, cut] + often[own] @ self.dense[cut].T
                if skip is not None:
                    inside = own[(skip[own] >= cut.start) & (skip[own] < cut.stop)]
                    cosines[inside, skip[inside]] = 0.0

        wanted = np.zeros((n, self.blocks), dtype=bool)
        first = min(FIRST_BLOCKS, self.blocks)
        np.put_along_axis(wanted, np.argpartition(-bounds, first - 1, axis=1)[:, :first], True, axis=1)
        visit(wanted)
        kth = np.partition(cosines, width - min(k, width), axis=1)[:, width - min(k, width)]
        visit(~wanted & (bounds > 0) & (bounds >= kth[:, None] - SINGLE))
        kth = np.partition(cosines, width - min(k, width), axis=1)[:, width - min(k, width)]
        found = []
        for i in range(n):
            hit = np.flatnonzero((cosines[i] > 0) & (cosines[i] >= kth[i] - 1e-11))
            hit = hit[np.lexsort((hit, -np.round(cosines[i, hit], 12)))[:k]]
            found.append((hit, cosines[i, hit]))
        return found

    def vote(self, near: np.ndarray, cosines: np.ndarray) -> float:
        w = cosines * cosines
        return float((w * self.labels[near]).sum() / w.sum()) if len(near) else 0.0

    def score(self, vote: float, any_near: bool) -> float:
        return float(1.0 / (1.0 + np.exp(-(self.curve[0] * vote + self.curve[1])))) if any_near else self.prior


def build_index(
    rows: list[tuple], idf: np.ndarray, block: int = BLOCK, k: int = NEIGHBOURS, prior: float = 0.0, frequent: int = FREQUENT
) -> ExampleIndex:
    """rows: (doc_id, label, terms, counts)."""
    sizes = [len(r[2]) for r in rows]
    flat = [np.concatenate([np.zeros(0, dtype=np.int64), *[np.asarray(r[c], dtype=np.int64) for r in rows]]) for c in (2, 3)]
    alone = np.full(len(idf), -1)
    return index_of([r[0] for r in rows], np.array([r[1] for r in rows], dtype=float), np.repeat(np.arange(len(rows)), sizes), *flat, idf, alone, block, k, prior, frequent)


def index_of(
    ids: list, labels: np.ndarray, row: np.ndarray, term: np.ndarray, count: np.ndarray, idf: np.ndarray, parent: np.ndarray, block: int = BLOCK,
    k: int = NEIGHBOURS, prior: float = 0.0, frequent: int = FREQUENT,
) -> ExampleIndex:
    """The index of examples, given by their entries; ``parent`` is the next term of each one's chain, or -1. Examples with the same strongest term are put side by side, so blocks differ."""
    w = (1.0 + np.log(count)) * idf[term]
    w /= np.sqrt(np.bincount(row, w * w, minlength=len(ids)))[row]
    held, first = np.unique(row, return_index=True)  # rows are in order; examples without terms are left out
    at_most = np.zeros(len(ids))
    at_most[held] = np.maximum.reduceat(w, first) if len(first) else 0.0
    strong = np.flatnonzero(w == at_most[row])
    strongest = term[strong[np.unique(row[strong], return_index=True)[1]]]  # the first of equals
    order = sorted(range(len(held)), key=lambda i: (strongest[i], labels[held[i]], ids[held[i]]))
    place_of = np.full(len(ids), -1, dtype=np.int32)
    place_of[held[order]] = np.arange(len(held))
    places, values = place_of[row], w.astype(np.float32)
    del w, strong
    # a term is never in more examples nor more often than the next of its chain; where it is as often, both are always together
    examples, times = np.bincount(term, minlength=len(idf)), np.bincount(term, count, minlength=len(idf))
    alike = np.flatnonzero((parent >= 0) & (examples > 0))
    alike = alike[(examples[alike] == examples[parent[alike]]) & (times[alike] == times[parent[alike]])]
    head = np.arange(len(idf))
    head[parent[alike]] = alike
    while (head[head] != head).any():
        head = head[head]
    share = idf / idf[head]
    held_postings = head[term] == term
    by_term = np.flatnonzero(held_postings)
    by_term = by_term[np.argsort(term[by_term] * np.int64(len(ids) + 1) + places[by_term])]
    del held_postings
    starts = np.searchsorted(term[by_term], np.arange(len(idf) + 1))
    ids, labels = [ids[i] for i in held[order]], labels[held[order]]
    index = ExampleIndex(ids, labels, idf, places[by_term], values[by_term], starts, head, share, block, prior=prior, frequent=frequent)
    by_place = np.argsort(places, kind="stable")
    cuts, votes = np.searchsorted(places[by_place], np.arange(len(ids) + 1)), []
    for at in range(0, len(ids), TOGETHER):
        n = min(TOGETHER, len(ids) - at)
        own = by_place[cuts[at] : cuts[at + n]]
        votes += [index.vote(*x) for x in index.nearest(n, places[own] - at, term[own], values[own], k, skip=np.arange(at, at + n))]
    index.curve = fit_curve(np.array(votes), labels)
    return index


def fit_curve(votes: np.ndarray, labels: np.ndarray, rounds: int = 500) -> tuple[float, float]:
    """Slope and offset of a logistic curve from votes to labels, held near a default by a weak prior; both labels weigh alike."""
    a, b = 6.0, -3.0
    if not len(votes) or labels.min() == labels.max():
        return a, b
    weight = np.where(labels > 0, 0.5 / (labels > 0).mean(), 0.5 / (labels == 0).mean()) / len(votes)
    for _ in range(rounds):
        p = 1.0 / (1.0 + np.exp(-(a * votes + b)))
        error = weight * (p - labels)
        a -= 2.0 * (float((error * votes).sum()) + 0.002 * (a - 6.0))
        b -= 2.0 * (float(error.sum()) + 0.002 * (b + 3.0))
    return max(a, 0.1), b


def toxicity(
    docs: DataFrame, labels: DataFrame, per_label: int = PER_LABEL, k: int = NEIGHBOURS, block: int = BLOCK
) -> DataFrame:
    """doc_id, held_out, score, predicted and evidence (nearest examples: doc_id, cosine, label) of every row of ``docs``.

    Only labels of ids outside the held-out fold are read. A text near no example (null, empty, or without a term of the
    sample) has the share of toxic labels as its score, at most 0.49; without labels every score is 0. Repeated rows
    are scored alike; extra columns are left out.
    """
    docs = docs.select("doc_id", "text")
    sc, id_type = docs.sparkSession.sparkContext, docs.schema["doc_id"].dataType
    sample = stored(labelled(docs, labels, per_label))
    names, parent, association = sample_terms(sample)
    shared, parents = sc.broadcast(pa.array(names, pa.string())), sc.broadcast(parent)  # the sample bounds them
    all_counts = stored(term_counts(docs.withColumn("held_out", crc_mod("doc_id", FOLDS) == HELD_OUT), shared, ["doc_id", "held_out"]))
    n_docs = all_counts.count()
    df_rows = document_frequencies(all_counts, parents).toArrow()  # a row per term
    parent = parent if len(parent) else np.full(1, -1)
    idf = np.full(max(len(association), 1), np.log(1.0 + n_docs) + 1.0)
    idf[df_rows.column("t").to_numpy()] = np.log((1.0 + n_docs) / (1.0 + df_rows.column("n").to_numpy())) + 1.0
    idf[: len(association)] *= association + LEAST
    share = labels.filter(crc_mod("doc_id", FOLDS) != HELD_OUT).agg(F.avg((F.col("toxic") > 0).cast("double")).alias("p")).collect()[0]["p"] or 0.0
    examples = term_counts(sample, shared, ["doc_id", "toxic"]).toArrow().sort_by("doc_id").combine_chunks()
    parts = (spread(*_listed(part), parent) for part in examples.to_batches(max_chunksize=TOGETHER))
    entries = [(r.astype(np.int32), t.astype(np.int32), c.astype(np.float32)) for r, t, c in parts]
    row = np.concatenate([np.zeros(0, dtype=np.int32), *[e[0] + np.int32(i * TOGETHER) for i, e in enumerate(entries)]])
    term, times = (np.concatenate([np.zeros(0, dtype=t), *[e[j] for e in entries]]) for j, t in ((1, np.int32), (2, np.float32)))
    ids, toxic = examples.column("doc_id").to_pylist(), examples.column("toxic").to_numpy().astype(float)
    del examples, entries, parts
    mark, given = uuid.uuid4().hex, sc.broadcast(index_of(ids, toxic, row, term, times, idf, parent, block, k, min(share, 0.49)).given())  # the sample bounds it
    shown = pa.list_(pa.struct([("doc_id", to_arrow_type(id_type)), ("cosine", pa.float64()), ("label", pa.int32())]))

    def run(batches):
        index, parent = per_process("examples", mark, lambda: ExampleIndex(**given.value)), parents.value
        for batch in batches:
            for begin in range(0, batch.num_rows, TOGETHER):
                part = batch.slice(begin, TOGETHER)
                row, term, count = spread(*_listed(part), parent)
                near = index.nearest(part.num_rows, row, term, index.weights(row, term, count), k)
                scores = [index.score(index.vote(*x), True) if len(x[0]) else index.prior for x in near]
                evidence = [[{"doc_id": index.ids[i], "cosine": s, "label": int(index.labels[i])} for i, s in zip(at[:3].tolist(), c[:3].tolist(), strict=True)] for at, c in near]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("held_out"), pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32()), pa.array(evidence, shown)],
                    names=["doc_id", "held_out", "score", "predicted", "evidence"],
                )

    schema = StructType([all_counts.schema["doc_id"], all_counts.schema["held_out"]]).add("score", DoubleType()).add("predicted", IntegerType())
    shown_type = StructType().add("doc_id", id_type).add("cosine", DoubleType()).add("label", IntegerType())
    return all_counts.mapInArrow(run, schema.add("evidence", ArrayType(shown_type)))
