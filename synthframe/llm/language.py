"""Language identification: family first, then one-versus-one linear SVMs inside the family.

Features are hashed counts of letter pairs and triples over the whole text, divided
by their number.  One linear SVM per family (against the rest) picks the family; a
linear SVM for every pair of languages of that family then votes.
"""

from __future__ import annotations

import itertools
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from synthframe.llm.common import bounded_sample, held_out, texts, tidied

#: ISO 639-1 codes by family. A code that is not listed is a family of its own.
FAMILIES = {
    "germanic": ("af", "da", "de", "en", "fy", "is", "nb", "nl", "nn", "no", "sv", "yi"),
    "romance": ("ca", "es", "fr", "gl", "it", "oc", "pt", "ro"),
    "slavic": ("be", "bg", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"),
    "uralic": ("et", "fi", "hu"),
    "turkic": ("az", "kk", "ky", "tr", "uz"),
    "indic": ("bn", "gu", "hi", "mr", "ne", "pa", "ur"),
}
UNKNOWN = "und"
BUCKETS = 1 << 13
SLICE = 1 << 20
_LETTER = re.compile(r"[^\W\d_]")
_KEEP = np.array([c if c >= 128 or 97 <= c <= 122 else 0 for c in range(256)], dtype=np.uint32)


def family_of(lang: str) -> str:
    code = lang.split("-")[0].lower()
    return next((name for name, codes in FAMILIES.items() if code in codes), f"only {lang}")


def _grams(text: str):
    """Hash buckets of the pairs and triples of a text, slice by slice; runs of non-letters count as one space."""
    raw = np.frombuffer(text.lower().encode("utf-8", "surrogatepass"), dtype=np.uint8)
    for start in range(0, max(len(raw), 1), SLICE):
        codes = _KEEP[raw[max(0, start - 2):start + SLICE]]
        codes = codes[np.flatnonzero((codes != 0) | np.append(True, codes[:-1] != 0))]
        codes = np.concatenate(([0], codes, [0])).astype(np.uint32)
        pair = codes[:-1] * np.uint32(257) + codes[1:]
        triple = (pair[:-1] + np.uint32(1)) * np.uint32(263) + codes[2:]
        yield np.concatenate(((pair * np.uint32(2654435761)) >> np.uint32(19), (triple * np.uint32(2246822519)) >> np.uint32(19)))


def features(text: str) -> np.ndarray:
    """Square roots of the shares of the buckets, one vector of length 1 per text."""
    counts = np.zeros(BUCKETS)
    for buckets in _grams(text):
        counts += np.bincount(buckets, minlength=BUCKETS)
    return np.sqrt(counts / max(counts.sum(), 1.0)).astype(np.float32)


def _svm(x: np.ndarray, gram: np.ndarray, y: np.ndarray, rounds: int = 400, reg: float = 1e-4) -> tuple[np.ndarray, float]:
    """Linear SVM with squared hinge loss by accelerated gradient steps; classes weigh the same.

    Every gradient is a combination of the rows of x, so the steps move the rows'
    factors over their inner products and the weights are formed once at the end.
    """
    weight = np.where(y > 0, 0.5 / max((y > 0).sum(), 1), 0.5 / max((y < 0).sum(), 1))
    a, b = np.zeros(len(y)), 0.0
    past_a, past_b = a, b
    for i in range(rounds):
        ahead = i / (i + 3)
        at_a, at_b = a + ahead * (a - past_a), b + ahead * (b - past_b)
        slack = np.maximum(0.0, 1.0 - y * (gram @ at_a + at_b)) * weight * y
        past_a, past_b = a, b
        a = at_a - 0.25 * (reg * at_a - 2 * slack)
        b = at_b + 0.25 * 2 * slack.sum()
    return (x.T @ a.astype(np.float32)).astype(np.float64), float(b)


class LanguageModel:
    """The linear SVMs of the families and of the language pairs inside each."""

    def __init__(self, x: np.ndarray, langs: list[str]):
        self.langs = sorted(set(langs))
        self.families: dict[str, list[str]] = {}
        for lang in self.langs:
            self.families.setdefault(family_of(lang), []).append(lang)
        family = np.array([family_of(lang) for lang in langs])
        lang_of = np.array(langs)
        names = list(self.families)
        gram = (x @ x.T).astype(np.float64)
        self.family_svm = {n: _svm(x, gram, np.where(family == n, 1.0, -1.0)) for n in names} if len(names) > 1 else {}
        self.pair_svm = {}
        for members in self.families.values():
            for a, b in itertools.combinations(members, 2):
                rows = np.flatnonzero(np.isin(lang_of, (a, b)))
                self.pair_svm[a, b] = _svm(x[rows], gram[np.ix_(rows, rows)], np.where(lang_of[rows] == a, 1.0, -1.0))

    def predict(self, text: str) -> tuple[str, float]:
        """(language, confidence); `und` and 0 without letters or without a learned language."""
        if not self.langs or not _LETTER.search(text):
            return UNKNOWN, 0.0
        x = features(text)
        surest = 30.0
        name = next(iter(self.families))
        if self.family_svm:
            margins = sorted(((float(x @ w + b), n) for n, (w, b) in self.family_svm.items()), reverse=True)
            name, surest = margins[0][1], (margins[0][0] - margins[1][0]) / 2
        members = self.families[name]
        votes = {lang: [0, 0.0] for lang in members}
        for a, b in itertools.combinations(members, 2):
            w, c = self.pair_svm[a, b]
            margin = float(x @ w + c)
            won, lost = (a, b) if margin >= 0 else (b, a)
            votes[won][0] += 1
            votes[won][1] += abs(margin)
            votes[lost][1] -= abs(margin)
        best = max(members, key=lambda lang: (votes[lang][0], votes[lang][1], lang))
        if len(members) > 1:
            surest = min(surest, max(0.0, votes[best][1] / (len(members) - 1)))
        return best, float(1.0 / (1.0 + np.exp(-3.0 * min(surest, 10.0))))


def fit(docs: DataFrame, per_language: int = 300) -> LanguageModel:
    """Learn from about `per_language` documents of each language (the bound of the sample).

    Rows with a null id, a null language or held out by crc32(doc_id) mod 3 = 1 are
    not learned from.  At most twice the bound of feature vectors, 8,192 numbers
    each, reaches the driver.
    """
    labelled = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("lang").cast("string").alias("lang"))
    labelled = labelled.filter("doc_id IS NOT NULL AND text IS NOT NULL AND lang IS NOT NULL").filter(~held_out())
    chosen = bounded_sample(labelled, "lang", per_language)

    def vectors(batches):
        for batch in batches:
            kept = [(lang, features(text).tobytes()) for text, lang in zip(batch["text"].to_pylist(), batch["lang"].to_pylist(), strict=True)
                    if _LETTER.search(text)]
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in kept], pa.string()), pa.array([k[1] for k in kept], pa.binary())], ["lang", "x"])

    rows = sorted(chosen.select("text", "lang").mapInArrow(tidied(vectors), "lang string, x binary").collect())
    x = np.array([np.frombuffer(r["x"], dtype=np.float32) for r in rows], dtype=np.float32).reshape(len(rows), BUCKETS)
    return LanguageModel(x, [r["lang"] for r in rows])


def identify(docs: DataFrame, model: LanguageModel | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, held_out, lang_pred, score and the columns of `keep`, one row per input row.

    A null or letterless text gives `und` with score 0, as does a table without any
    learnable row.  Repeated rows and null ids are predicted like any other row;
    other columns are never read.
    """
    texts(docs)  # ships the package
    model = model or fit(docs)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # languages x 8,192 numbers
    fields = list(dict.fromkeys(["doc_id", "text", *keep]))
    kept = [f for f in docs.select(*fields).schema.fields if f.name in ("doc_id", *keep)]
    schema = ", ".join(f"`{f.name}` {'bigint' if f.name == 'doc_id' else f.dataType.simpleString()}" for f in kept)

    def predict(batches):
        known = shared.value
        for batch in batches:
            found = [known.predict(t or "") for t in batch["text"].to_pylist()]
            columns = [batch[f.name] for f in kept] + [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, [*(f.name for f in kept), "lang_pred", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *[f for f in fields if f != "doc_id"])
    out = rows.mapInArrow(tidied(predict), f"{schema}, lang_pred string, score double")
    return out.withColumn("held_out", held_out())


def drop_rejected(docs: DataFrame, model: LanguageModel | None = None) -> DataFrame:
    """The rows of `docs`, all columns, whose text has a language; null and letterless texts go."""
    texts(docs)
    shared = docs.sparkSession.sparkContext.broadcast(model or fit(docs))

    def clean(batches):
        known = shared.value
        for batch in batches:
            yield batch.filter(pa.array([known.predict(t or "")[0] != UNKNOWN for t in batch["text"].to_pylist()], pa.bool_()))

    return docs.mapInArrow(tidied(clean), docs.schema)
