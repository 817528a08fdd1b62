"""Subject areas of documents, by one-versus-rest linear classifiers on hashed word n-grams.

The classifiers are fitted on sentences.  Labels are weak: readers give subjects to whole
documents, some wrong or missing.  A first fit on whole documents says which sentences of
a labelled document speak of its subjects; the classifiers are then fitted on sentences with
these labels, twice.  A document has a subject if at least so many of its sentences pass that
subject's threshold; both numbers are calibrated for each subject on labelled documents
held out of the fit, and those common to all subjects stand in where a subject has few of
them.  The confidence is the share of held-out documents with as many such sentences to
which readers gave the subject.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Hashed features.
BITS = 17
#: Labelled documents for fit and calibration, at most, and the longest text among them.
TRAINING_DOCS, TRAINING_CHARS = 8_000, 20_000
#: Part of them held out for calibration, held-out documents that a subject needs for numbers of its own, and sentences that are told apart in the confidence.
HELD_OUT, OWN_NUMBERS, COUNTED = 0.25, 40, 8
#: Passes over the training rows, rows of a gradient step, step and shrinkage.
PASSES, STEP_ROWS, RATE, SHRINK = 10, 1_500, 0.3, 1e-4
#: Words and word pairs whose feature a task remembers, sentences that are scored at once; numbers that calibration chooses from: a single sentence is a mention in passing.
HELD_WORDS, SCORED = 400_000, 20_000
THRESHOLDS, LEAST = (-2.0, -1.5, -1.0, -0.5, 0.0, 0.5, 1.0, 1.5), (2, 3, 4)

_END = re.compile(r"(?<=[.!?…])[\"'»”)\]]*\s+|[\r\n]+")
_WORD = re.compile(r"[^\W\d_]{2,}")


def sentences(text: str) -> list[str]:
    return [s for s in _END.split(text.lower() if text else "") if s and _WORD.search(s)]


class Bags:
    """Distinct features of many texts as one array in order of the text, for sums over each."""

    def __init__(self, index: np.ndarray, row: np.ndarray, n: int) -> None:
        self.index, self.row, self.n = index, row, n

    def frequent(self, least: int = 2) -> Bags:
        """Without features of fewer than ``least`` texts."""
        kept = np.bincount(self.index, minlength=1 << BITS)[self.index] >= least
        return Bags(self.index[kept], self.row[kept], self.n)

    def grouped(self, of: np.ndarray, n: int) -> Bags:
        """Bags of the texts that have the same number in ``of``."""
        pairs = np.unique((of[self.row] << BITS) | self.index)
        return Bags(pairs & ((1 << BITS) - 1), pairs >> BITS, n)

    def part(self, rows: np.ndarray) -> Bags:
        """The bags of ``rows``, numbered anew."""
        place = np.full(self.n, -1)
        place[rows] = np.arange(len(rows))
        at = place[self.row]
        kept = at >= 0
        order = np.argsort(at[kept], kind="stable")
        return Bags(self.index[kept][order], at[kept][order], len(rows))

    def scores(self, weights: np.ndarray, bias: np.ndarray) -> np.ndarray:
        out = np.zeros((self.n, weights.shape[1]), np.float32)
        if len(self.row):
            rows, first = np.unique(self.row, return_index=True)
            out[rows] = np.add.reduceat(weights[self.index], first, axis=0)
        return out + bias


class Hasher:
    """Features of sentences: hashes of words and word pairs, those met before remembered."""

    def __init__(self) -> None:
        self.words: dict[str, int] = {}
        self.names: list[str] = []
        self.hashes: list[int] = []
        self.pairs: dict[int, int] = {}

    def __call__(self, lines: list[str]) -> Bags:
        if len(self.words) > HELD_WORDS or len(self.pairs) > HELD_WORDS:
            self.__init__()
        found = [_WORD.findall(x) for x in lines]
        flat = [w for f in found for w in f]
        for w in set(flat).difference(self.words):
            self.words[w] = len(self.names)
            self.names.append(w)
            self.hashes.append(zlib.crc32(w.encode()) >> (32 - BITS))
        ids = np.fromiter(map(self.words.__getitem__, flat), np.int64, len(flat))
        row = np.repeat(np.arange(len(lines)), np.fromiter(map(len, found), np.int64, len(found)))
        inside = row[:-1] == row[1:]
        codes, pairs = pd.factorize((ids[:-1] << 32 | ids[1:])[inside])
        known, of = self.pairs, []
        for k in pairs.tolist():
            i = known.get(k)
            if i is None:
                i = known[k] = zlib.crc32(f"{self.names[k >> 32]} {self.names[k & 0xFFFFFFFF]}".encode()) >> (32 - BITS)
            of.append(i)
        index = np.concatenate([np.array(self.hashes, np.int64)[ids] if len(ids) else ids, np.array(of, np.int64)[codes]])
        both = np.unique((np.concatenate([row, row[:-1][inside]]) << BITS) | index)
        return Bags(both & ((1 << BITS) - 1), both >> BITS, len(lines))


@dataclass
class Model:
    subjects: list[str]
    weights: np.ndarray  # features x subjects
    bias: np.ndarray
    threshold: np.ndarray  # of a sentence's score, by subject
    least: np.ndarray  # sentences that a subject needs
    confidence: np.ndarray  # by subject and number of its sentences, up to COUNTED


def fit(bags: Bags, target: np.ndarray, used: np.ndarray | None = None, passes: int = PASSES, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Logistic regression for each column of ``target`` by adaptive gradient steps on a part of the rows at a time; ``used`` weighs each cell of ``target``."""
    n, subjects = target.shape
    weights, bias = np.zeros((1 << BITS, subjects), np.float32), np.full(subjects, -2.0, np.float32)
    seen, seen_bias = np.full((1 << BITS, subjects), 1e-6, np.float32), np.full(subjects, 1e-6, np.float32)
    target = target.astype(np.float32)
    used = np.ones_like(target) if used is None else used.astype(np.float32)
    order = np.random.default_rng(seed).permutation(n)
    steps = []
    for lo in range(0, n, STEP_ROWS):
        rows = order[lo : lo + STEP_ROWS]
        part = bags.part(rows)
        by = np.argsort(part.index, kind="stable")
        features, first = np.unique(part.index[by], return_index=True)
        steps.append((rows, part, part.row[by], features, first))
    for _ in range(passes):
        for rows, part, row_by, features, first in steps:
            p = 1 / (1 + np.exp(-np.clip(part.scores(weights, bias), -30, 30)))
            err = ((p - target[rows]) * used[rows]).astype(np.float32)
            if len(features):
                g = np.add.reduceat(err[row_by], first, axis=0) + SHRINK * weights[features]
                seen[features] += g * g
                weights[features] -= RATE * g / np.sqrt(seen[features])
            g = err.sum(0)
            seen_bias += g * g
            bias -= RATE * g / np.sqrt(seen_bias)
    return weights, bias


def train(texts: list[str], labels: list[set[str]], subjects: list[str]) -> Model:
    """Fits and calibrates the classifiers on labelled documents."""
    cuts = [sentences(t) for t in texts]
    given = np.array([[s in x for s in subjects] for x in labels], bool).reshape(len(texts), len(subjects))
    at = round(len(texts) * (1 - HELD_OUT))
    fitted = [s for c in cuts[:at] for s in c]
    of = np.repeat(np.arange(at), [len(c) for c in cuts[:at]])
    bags = Hasher()(fitted)
    weights, bias = fit(bags.grouped(of, at).frequent(), given[:at].astype(float))
    parts = bags.frequent()
    for _ in range(2):
        score = parts.scores(weights, np.zeros(len(subjects), np.float32))
        best = score.argmax(1)
        rows = np.arange(len(best))
        # a sentence speaks of the subject that it scores best in, if readers gave it to the document; where they did not, little is learned of it
        top = score[rows, best]
        clear = top > np.maximum(0.5, np.quantile(top, 0.2)) if len(top) else top > 0
        target = np.zeros_like(score)
        hit = clear & given[of, best]
        target[rows[hit], best[hit]] = 1.0
        used = np.ones_like(score)
        doubt = clear & ~given[of, best]
        used[rows[doubt], best[doubt]] = 0.2
        weights, bias = fit(parts, target, used)
    k = len(subjects)
    model = Model(subjects, weights, bias, np.zeros(k), np.full(k, 3), np.tile(np.linspace(0.5, 0.95, COUNTED + 1), (k, 1)))
    if len(texts) - at >= 20:
        calibrate(model, cuts[at:], given[at:])
    return model


def calibrate(model: Model, docs: list[list[str]], given: np.ndarray) -> None:
    """Threshold of sentences and least number of them with the best F1 against the readers' subjects, for each subject; and how often readers gave a subject to documents of so many sentences."""
    of = np.repeat(np.arange(len(docs)), [len(d) for d in docs])
    score = Hasher()([s for d in docs for s in d]).scores(model.weights, model.bias)
    count = {t: np.stack([np.bincount(of, score[:, k] > t, len(docs)) for k in range(score.shape[1])], 1) for t in THRESHOLDS}
    pairs = [(t, n) for t in THRESHOLDS for n in LEAST]

    def f1(found: np.ndarray, true: np.ndarray) -> float:
        return 2 * (found & true).sum() / max(1, found.sum() + true.sum())

    common = max(pairs, key=lambda x: f1(count[x[0]] >= x[1], given))
    for k in range(given.shape[1]):
        own = lambda x: f1(count[x[0]][:, k] >= x[1], given[:, k])
        best = max(pairs, key=own) if given[:, k].sum() >= OWN_NUMBERS else common
        # of numbers as good as the common ones, those stay
        model.threshold[k], model.least[k] = best if own(best) > own(common) + 0.005 else common
    n = np.stack([np.minimum(count[t][:, k], COUNTED) for k, t in enumerate(model.threshold)], 1)
    for i in range(COUNTED + 1):
        there, right = (n == i).sum(0), ((n == i) & given).sum(0)
        all_ = right.sum() / max(1, there.sum())
        model.confidence[:, i] = (right + 10 * all_) / (there + 10)  # few documents lean on those of all subjects
    model.confidence = np.maximum.accumulate(model.confidence, axis=1)


def fit_subjects(docs: DataFrame, labels: DataFrame, areas: DataFrame, rows: int = TRAINING_DOCS) -> Model:
    """Classifiers for ``areas(subject)`` from ``labels(doc_id, subject)`` on ``docs(doc_id, text)``.

    At most ``rows`` labelled documents are used, those of smallest hash; subjects that are no area are ignored.
    """
    subjects = sorted({r[0] for r in areas.select("subject").where("subject is not null").collect()})  # a fixed table
    by_doc = labels.where(F.col("subject").isin(subjects)).groupBy("doc_id").agg(F.collect_set("subject").alias("subjects"))
    some = by_doc.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    got = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id").where(F.length("text").between(1, TRAINING_CHARS)).collect()  # bounded by rows
    got = sorted(got, key=lambda r: (zlib.crc32(str(r["doc_id"]).encode()), r["text"]))
    return train([r["text"] for r in got], [set(r["subjects"]) for r in got], subjects)


_FOUND = pa.struct([("subject", pa.string()), ("n_sentences", pa.int32()), ("confidence", pa.float64())])


def _judge(model: Model, keep_counts: bool):
    names = np.array(model.subjects, object)
    least = np.ones(len(names), int) if keep_counts else model.least

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for b in batches:
            cuts = [sentences(t) for t in b.column(b.num_columns - 1).to_pylist()]
            every = [s for c in cuts for s in c]
            of = np.repeat(np.arange(len(cuts)), [len(c) for c in cuts])
            count = np.zeros((len(cuts), len(names)), np.int64)
            for lo in range(0, len(every), SCORED):
                hit = hasher(every[lo : lo + SCORED]).scores(model.weights, model.bias) > model.threshold
                for k in range(len(names)):
                    count[:, k] += np.bincount(of[lo : lo + SCORED], hit[:, k], len(cuts)).astype(np.int64)
            doc, k = np.nonzero(count >= np.maximum(least, 1))
            n = count[doc, k]
            ends = np.searchsorted(doc, np.arange(len(cuts) + 1)).astype(np.int32)
            parts = [pa.array(names[k], pa.string()), pa.array(n, pa.int32()), pa.array(np.round(model.confidence[k, np.minimum(n, COUNTED)], 6), pa.float64())]
            got = pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays(parts, fields=list(_FOUND)))
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], got], [*b.schema.names[:-1], "found"])

    return run


def subjects_of(docs: DataFrame, columns: list[str], text: str, model: Model, mentions: bool = False) -> DataFrame:
    """``columns, subject, n_sentences, confidence``: one row per subject of each document.

    Null, empty and blank texts have no subject; neither have texts without a subject that
    enough sentences speak of.  ``mentions`` also gives subjects of fewer sentences.  Texts
    are read whole; rows with the same key are judged one by one.
    """
    narrow = docs.select(*columns, F.col(text).cast("string").alias("__text"))
    schema = ", ".join(f"`{c}` {t}" for c, t in narrow.dtypes[:-1])
    judged = narrow.mapInArrow(_judge(model, mentions), f"{schema}, found array<struct<subject: string, n_sentences: int, confidence: double>>")
    return judged.select(*columns, F.explode("found").alias("f")).select(*columns, "f.subject", "f.n_sentences", "f.confidence")
