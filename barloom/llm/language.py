"""Language identification by family, then by one-versus-one linear support vector machines.

Texts become hashed counts of byte n-grams inside words. Languages whose mean profiles are alike form a family (they are
merged bottom-up); a linear machine per family says which family a text belongs to, and machines for each pair of the
family's languages then vote. All machines are fitted on the driver on a bounded sample of labelled rows and have a fixed
size, so they go to the tasks with the code.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import crc_mod, slices

FOLDS, HELD_OUT = 3, 1
#: Rows of each language that the machines are fitted on, about, and the size of a text's profile.
PER_LANGUAGE, BUCKETS = 400, 2048
#: Most languages: the driver holds per_language profiles of each.
MAX_LANGUAGES = 500
UNDETERMINED = "und"
#: ASCII that isn't a letter becomes a space.
_LETTERS = bytes(c if chr(c).isalpha() or c > 127 else 32 for c in range(256))
_ODD = (np.uint32(1), np.uint32(2654435761), np.uint32(2246822519))


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def profile(text: str, buckets: int = BUCKETS) -> np.ndarray:
    """Square roots of the shares of byte 1-, 2- and 3-grams, hashed to ``buckets`` and scaled to length one."""
    counts, stride = np.zeros(buckets), 1 << 20
    raw = np.frombuffer(b" " + text.lower().encode("utf-8", "surrogatepass").translate(_LETTERS) + b" ", dtype=np.uint8)
    for at in range(0, len(raw), stride):
        part = raw[at : at + stride + 2].astype(np.uint32)
        code = np.zeros(len(part), dtype=np.uint32)
        for n, odd in enumerate(_ODD):
            code = code[: len(part) - n] * np.uint32(257) + part[n:] + np.uint32(1)
            mixed = code * odd
            counts += np.bincount((mixed ^ (mixed >> np.uint32(15))) % np.uint32(buckets), minlength=buckets)
    root = np.sqrt(counts)
    return root / (np.sqrt((root * root).sum()) or 1.0)


def fit_machine(x: np.ndarray, side: np.ndarray, penalty: float = 1e-4, rounds: int = 150) -> np.ndarray:
    """Weights and offset of a linear machine with squared hinge loss, by accelerated gradient steps; ``side`` is 1 or -1."""
    x = np.hstack([x, np.ones((len(x), 1))])
    weight = np.where(side > 0, 0.5 / max(1, (side > 0).sum()), 0.5 / max(1, (side < 0).sum()))
    w = ahead = np.zeros(x.shape[1])
    step = 1.0 / (2.0 * (weight * (x * x).sum(axis=1)).sum() + penalty)
    for k in range(rounds):
        slack = np.maximum(0.0, 1.0 - side * (x @ ahead))
        new = ahead - step * (penalty * ahead - 2.0 * x.T @ (weight * side * slack))
        ahead, w = new + k / (k + 3.0) * (new - w), new
    return w


@dataclass
class LanguageModel:
    families: list[list[str]] = field(default_factory=list)
    family_machines: np.ndarray | None = None
    pairs: dict[int, list[tuple[int, int]]] = field(default_factory=dict)
    pair_machines: dict[int, np.ndarray] = field(default_factory=dict)
    buckets: int = BUCKETS

    def predict(self, profiles: np.ndarray) -> tuple[list[str], np.ndarray]:
        x = np.hstack([profiles, np.ones((len(profiles), 1))])
        margins = x @ self.family_machines.T
        family, sure = margins.argmax(axis=1), _softmax(margins).max(axis=1)
        names, scores = [""] * len(x), np.zeros(len(x))
        for f, members in enumerate(self.families):
            rows = np.flatnonzero(family == f)
            if not len(rows):
                continue
            votes = np.zeros((len(rows), len(members)))
            for (a, b), w in zip(self.pairs[f], self.pair_machines[f], strict=True):
                p = 1.0 / (1.0 + np.exp(-4.0 * (x[rows] @ w)))
                votes[:, a] += p
                votes[:, b] += 1.0 - p
            votes /= max(1, len(members) - 1)
            best = votes.argmax(axis=1)
            for r, k in zip(rows, best, strict=True):
                names[r] = members[k]
            scores[rows] = sure[rows] * (votes.max(axis=1) if len(members) > 1 else 1.0)
        return names, np.clip(scores, 0.0, 1.0)


def _softmax(margins: np.ndarray) -> np.ndarray:
    if margins.shape[1] == 1:
        return np.ones_like(margins)
    e = np.exp(4.0 * (margins - margins.max(axis=1, keepdims=True)))
    return e / e.sum(axis=1, keepdims=True)


def families_of(means: dict[str, np.ndarray]) -> list[list[str]]:
    """About sqrt(n) families of n languages: the two families with the most alike mean profiles merge, again and again."""
    families = [[name] for name in sorted(means)]
    while len(families) > int(np.ceil(np.sqrt(len(means)))):
        profiles = [np.mean([means[n] for n in f], axis=0) for f in families]
        a, b = max(combinations(range(len(families)), 2), key=lambda ab: float(profiles[ab[0]] @ profiles[ab[1]]))
        families[a] = sorted(families[a] + families.pop(b))
    return families


def fit(profiles: np.ndarray, languages: list[str], buckets: int = BUCKETS) -> LanguageModel:
    names = np.array(languages)
    families = families_of({n: profiles[names == n].mean(axis=0) for n in sorted(set(languages))})
    model = LanguageModel(families, buckets=buckets)
    inside = np.array([next(i for i, f in enumerate(families) if n in f) for n in languages])
    one = len(families) == 1
    model.family_machines = np.array(
        [np.zeros(profiles.shape[1] + 1) if one else fit_machine(profiles, np.where(inside == f, 1.0, -1.0)) for f in range(len(families))]
    )
    for f, members in enumerate(families):
        model.pairs[f] = list(combinations(range(len(members)), 2))
        model.pair_machines[f] = np.array(
            [
                fit_machine(profiles[(names == members[a]) | (names == members[b])], np.where(names[(names == members[a]) | (names == members[b])] == members[a], 1.0, -1.0))
                for a, b in model.pairs[f]
            ]
        )
    return model


def learn_languages(
    df: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", per_language: int = PER_LANGUAGE, buckets: int = BUCKETS
) -> LanguageModel:
    """Fit the machines on rows of ``df`` with a language and a letter.

    Of each language about ``per_language`` rows are taken, chosen by a hash of ``doc_id``; the driver holds their profiles.
    """
    rows = df.filter(F.col(lang).isNotNull()).select(F.col(lang).alias("lang"), F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    counts = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))
    share = (F.xxhash64(F.col("doc_id"), F.lit(5)) / 2.0**64 + 0.5) * F.col("n")
    if (found := counts.count()) > MAX_LANGUAGES:
        raise ValueError(f"{found} languages; the machines take {MAX_LANGUAGES}")
    sample = rows.join(F.broadcast(counts), "lang").filter(share < per_language).select("lang", "text")

    def run(batches):
        for part in slices(batches, "text", 4 << 20):
            got = [(n, profile(t, buckets)) for n, t in zip(part.column("lang").to_pylist(), part.column("text").to_pylist(), strict=True) if has_letter(t)]
            yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in got], pa.string()), pa.array([p.astype("<f4").tobytes() for _, p in got], pa.binary())], names=["lang", "profile"])

    got = sorted((r["lang"], bytes(r["profile"])) for r in sample.mapInArrow(run, "lang string, profile binary").collect())
    if not got:
        return LanguageModel(buckets=buckets)
    return fit(np.array([np.frombuffer(p, "<f4") for _, p in got], dtype=np.float64), [n for n, _ in got], buckets)


def predict_languages(df: DataFrame, model: LanguageModel, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """Add lang_pred and score to the columns in ``carry``; nothing but the text is looked at.

    A null text and one without a letter are ``und`` with score 0, and so is everything if nothing was learned. Rows stay
    as they are; columns of ``df`` with the new names are replaced.
    """
    carry = [c for c in (df.columns if carry is None else carry) if c not in ("lang_pred", "score")]
    source = df.select(*carry, F.col(text).alias("_text"))

    def run(batches):
        for batch in slices(batches, "_text", 4 << 20):
            for part in (batch.slice(i, 512) for i in range(0, batch.num_rows, 512)):
                texts = part.column("_text").to_pylist()
                known = [i for i, t in enumerate(texts) if model.families and has_letter(t)]
                names, scores = [UNDETERMINED] * len(texts), np.zeros(len(texts))
                if known:
                    found, sure = model.predict(np.array([profile(texts[i], model.buckets) for i in known]))
                    for i, n in zip(known, found, strict=True):
                        names[i] = n
                    scores[known] = sure
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in carry], pa.array(names, pa.string()), pa.array(scores)], names=[*carry, "lang_pred", "score"])

    from pyspark.sql.types import DoubleType, StringType, StructType

    schema = StructType(source.schema.fields[:-1]).add("lang_pred", StringType()).add("score", DoubleType())
    return source.mapInArrow(run, schema)


def held_out(doc_id: str = "doc_id"):
    return crc_mod(doc_id, FOLDS) == HELD_OUT


def language_id(df: DataFrame) -> DataFrame:
    """Learn from the rows that are not held out and predict all rows: doc_id, held_out, lang_pred, score."""
    model = learn_languages(df.filter(~held_out()))
    return predict_languages(df.withColumn("held_out", held_out()), model, carry=["doc_id", "held_out"])
