"""Subject areas of documents (problem 10).

Each subject has an interpolated n-gram language model, trained on the sentences of labelled documents.
A sentence treats the subject whose model gives it the lowest cross-entropy per token, if that lies below
the background's, and below that of the model of no subject, by more than the subject's margin. The
margins, one a subject, are calibrated on held-out labelled documents. A document gets the subjects that
at least three of its sentences treat, and a subject that is the only one treated.

Labels belong to documents, not to sentences: training starts from sentences shared among the labels of
their document and then reassigns them by expectation-maximisation among these labels,
no subject and, at a low prior, other subjects. It uses a bounded sample of labelled documents; every
document is then classified whole, in Arrow batches, without a shuffle.
"""

from __future__ import annotations

import html
import random
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Most labelled documents used for training: those with the smallest hash of their id.
TRAINING_DOCUMENTS = 6_000
LEAST_SENTENCES = 3
#: Weights of the models of order 2, 1 and 0.
WEIGHTS = (0.35, 0.64, 0.01)
#: Share of the background in each subject's model, so that words it never saw cost little.
REST = 0.25
#: Prior weights of a sentence: one of the document's subjects, none, another subject.
PRIOR = {"label": 0.6, "none": 0.3, "other": 0.1}
#: Margins (nats a token below the background's cross-entropy) that calibration tries, and the one before it.
MARGINS = (0.0, 0.02, 0.04, 0.06, 0.08, 0.1, 0.12, 0.15, 0.18, 0.21, 0.25, 0.3, 0.35, 0.4, 0.5)
MARGIN = 0.15
#: By how many documents' subjects a margin of its own must better the agreement before a subject leaves the common one.
EVIDENCE = 0.5
_WORD = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")
_END = re.compile(r"(?<=[.!?…。])[\"'»”)]*\s+(?=[\"'«“(¿¡]*[^\W\d_])|(?<=[.!?。])\s*$|\n{2,}|[。！？]")
_CODE = re.compile(r"^\s*(?:[A-Z][A-Z0-9_-]{0,7}\s*=|(?:def|class|import|from|for|while|if|elif|else|return|let|var|func|print|select|SELECT|#include|//|#|\$|>>>)\b.*[=():{};]|[\w.\[\]]+\s*=\s*\S|[{}\[\]();]+\s*$|\S+\(.*\)\s*[;:{]?\s*$)")


def clean(text: str) -> str:
    text = html.unescape(text).replace("\r\n", "\n").replace("\r", "\n")
    return re.sub(r"[\u0000-\u0008\u000b-\u001f\u007f-\u009f­​-‏‪-‮⁠-⁤﻿]", "", text)


def sentences(text: str) -> list[list[str]]:
    """The sentences of a text as lower-case words. Lines of code and of headers give none."""
    lines = []
    for line in clean(text).split("\n"):
        line = re.sub(r"^\s*(?:COMMENT|HISTORY)\s+", "", line).rstrip()
        lines.append("" if _CODE.match(line) else line)
    out = []
    for part in _END.split("\n".join(lines)):
        words = [w.lower() for w in _WORD.findall(part or "")]
        if len(words) > 1:
            out.append(words)
    return out


START, OTHER, END = 0, 1, 2


@dataclass
class Corpus:
    """Sentences as flat arrays: words and bigrams of all sentences one after another."""

    words: np.ndarray
    bigrams: np.ndarray
    starts: np.ndarray  # of each sentence
    of: np.ndarray  # sentence of each word


def _flatten(sents: list[list[str]], ids: dict[str, int], pairs: dict[int, int], grow: bool = False) -> Corpus:
    words, bigrams, starts, of = [], [], [], []
    step = len(ids) + 3
    for k, sent in enumerate(sents):
        starts.append(len(words))
        before = START
        for w in (*(ids.get(x, OTHER) for x in sent), END):
            pair = before * step + w
            words.append(w)
            bigrams.append(pairs.setdefault(pair, len(pairs) + 1) if grow else pairs.get(pair, 0))
            of.append(k)
            before = w
    return Corpus(*(np.array(x, np.int64) for x in (words, bigrams, starts, of)))


@dataclass
class Classifier:
    """Interpolated models of all subjects side by side, then of sentences on no subject; the last column is the background."""

    subjects: list[str]
    ids: dict[str, int]
    pairs: dict[int, int]
    one: np.ndarray
    two: np.ndarray
    margins: np.ndarray | None = None

    def gains(self, corpus: Corpus) -> np.ndarray:
        """Cross-entropy of each sentence below the background's (nats), by subject and, last, for none."""
        if not len(corpus.words):
            return np.zeros((0, len(self.subjects) + 1))
        w2, w1, w0 = WEIGHTS
        p = w2 * self.two[corpus.bigrams] + w1 * self.one[corpus.words] + w0 / len(self.one)
        return np.add.reduceat(np.log(REST + (1 - REST) * p[:, :-1] / p[:, -1:]), corpus.starts)

    def choose(self, corpus: Corpus) -> tuple[np.ndarray, np.ndarray]:
        """Of each sentence the best subject, and its gain a token over the background and over the model of no subject."""
        gains = self.gains(corpus)
        own = gains[:, :-1]
        tokens = np.diff(np.r_[corpus.starts, len(corpus.words)])
        return own.argmax(1), (own.max(1) - np.maximum(gains[:, -1], 0.0)) / np.maximum(tokens, 1)

    def treated(self, sents: list[list[str]]) -> list[str | None]:
        who, gain = self.choose(_flatten(sents, self.ids, self.pairs))
        margins = self.margins if self.margins is not None else np.full(len(self.subjects), MARGIN)
        return [self.subjects[k] if g > m else None for k, g, m in zip(who, gain, margins[who])]

    def of_documents(self, texts: list[str | None]) -> list[list[str]]:
        split = [sentences(t) if t else [] for t in texts]
        who = iter(self.treated([s for sents in split for s in sents]))
        return [accept(Counter(x for x in (next(who) for _ in sents) if x)) for sents in split]


def accept(counts: Counter) -> list[str]:
    """Subjects with enough sentences, or the only one that is treated at all."""
    return sorted(s for s, n in counts.items() if n >= LEAST_SENTENCES or len(counts) == 1)


def _damped(items: np.ndarray, docs: np.ndarray, size: int, weights: np.ndarray) -> np.ndarray:
    """Weighted counts of items; repeats inside a document count with their square root."""
    _, first, cell = np.unique(docs * size + items, return_index=True, return_inverse=True)
    out = np.empty((size, weights.shape[1]))
    for k in range(weights.shape[1]):
        out[:, k] = np.bincount(items[first], np.sqrt(np.bincount(cell, weights[:, k])), size)
    return out


def _fit(split: list[tuple[list[list[str]], list[str]]], rounds: int) -> Classifier:
    subjects = sorted({s for _, labels in split for s in labels})
    spread = Counter(w for sents, _ in split for w in {w for s in sents for w in s})
    # a word of a single document says nothing about a subject (names, typing errors)
    ids = {w: k for k, w in enumerate(sorted(w for w, n in spread.items() if n > 1), 3)}
    pairs: dict[int, int] = {}
    corpus = _flatten([s for sents, _ in split for s in sents], ids, pairs, grow=True)
    doc = np.repeat(np.arange(len(split)), [len(sents) for sents, _ in split])
    none = len(subjects)
    prior = np.full((len(split), none + 1), PRIOR["other"] / len(subjects))
    prior[:, none] = PRIOR["none"]
    mine = np.zeros(prior.shape, bool)
    mine[:, none] = True
    for k, (_, labels) in enumerate(split):
        for s in labels:
            prior[k, subjects.index(s)] = PRIOR["label"] / len(labels)
            mine[k, subjects.index(s)] = True
    weights, prior = (prior * mine)[doc], prior[doc]
    words, grams = len(ids) + 3, len(pairs) + 1
    head = np.zeros(grams, np.int64)
    for pair, k in pairs.items():
        head[k] = pair // words
    model = None
    for _ in range(rounds):
        if model is not None:
            weights = prior * np.exp(np.minimum(50.0, model.gains(corpus)))
        weights = weights / weights.sum(1, keepdims=True)
        each = np.c_[weights, np.ones(len(weights))][corpus.of]
        at = doc[corpus.of]
        one = _damped(corpus.words, at, words, each)
        two = _damped(corpus.bigrams, at, grams, each)
        context = np.zeros_like(one)
        np.add.at(context, head, two)
        two = two / np.maximum(context[head], 1e-9)
        two[0] = 0.0
        model = Classifier(subjects, ids, pairs, (one / np.maximum(one.sum(0), 1e-9)).astype(np.float32), two.astype(np.float32))
    return model


def _calibrate(parts: list[tuple[Classifier, list]], subjects: list[str]) -> np.ndarray:
    """One margin a subject with the best agreement (F1 of the documents' subjects) over held-out parts.

    The best common margin first (ties to the larger), then each subject's in turn while the agreement rises by
    more than chance would: a few labelled documents leave the common margin in place.
    """
    who, gain, doc, truth, n = [], [], [], [], 0
    for model, split in parts:
        w, g = model.choose(_flatten([s for sents, _ in split for s in sents], model.ids, model.pairs))
        to = np.array([subjects.index(s) for s in model.subjects])
        who.append(to[w] if len(w) else w)
        gain.append(g)
        doc.append(np.repeat(np.arange(n, n + len(split)), [len(sents) for sents, _ in split]))
        for _, labels in split:
            truth.append([s in labels for s in subjects])
        n += len(split)
    who, gain, doc, truth = np.concatenate(who), np.concatenate(gain), np.concatenate(doc), np.array(truth, bool)
    cell = doc * len(subjects) + who

    def agreement(margins: np.ndarray) -> float:
        counts = np.bincount(cell[gain > margins[who]], minlength=truth.size).reshape(truth.shape)
        said = (counts >= LEAST_SENTENCES) | ((counts > 0) & ((counts > 0).sum(1, keepdims=True) == 1))
        return 2 * (said & truth).sum() / max(1, said.sum() + truth.sum())

    best, margins = max((agreement(np.full(len(subjects), m)), m) for m in MARGINS)
    margins = np.full(len(subjects), margins)
    for _ in range(2):
        for k in range(len(subjects)):
            for m in MARGINS:
                trial = margins.copy()
                trial[k] = m
                found = agreement(trial)
                if found > best + EVIDENCE / truth.sum():
                    best, margins = found, trial
    return margins


def train(documents: list[tuple[str, list[str]]], rounds: int = 4) -> Classifier | None:
    """documents: (text, subjects), in a fixed order. The margins are calibrated on held-out halves; None without labels."""
    split = [(sentences(text or ""), sorted(set(labels))) for text, labels in documents]
    split = [(sents, labels) for sents, labels in split if labels and sents]
    if not split:
        return None
    random.Random(0).shuffle(split)
    halves = split[::2], split[1::2]
    parts = [(_fit(a, rounds), b) for a, b in (halves, halves[::-1]) if a and b]
    model = _fit(split, rounds)
    if parts:
        model.margins = _calibrate(parts, model.subjects)
    return model


def _classify(model):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        classifier = Classifier(*model.value)
        for pdf in batches:
            found = [(d, s) for d, own in zip(pdf.doc, classifier.of_documents(pdf.text.tolist())) for s in own]
            yield pd.DataFrame(found, columns=["doc", "subject"])

    return run


def subjects_of(documents: DataFrame, key: str, text: str, labels: DataFrame, label_key: str, subject: str, *, most: int = TRAINING_DOCUMENTS) -> DataFrame:
    """(key, subject): one row for each subject of each document.

    Null, empty and blank texts, and texts that treat no subject, give no row. Repeated documents count
    once a key, repeated labels once; labels of unknown documents and nulls are ignored; without labels
    there is no result. At most ``most`` labelled documents (by hash of their key) train the models;
    texts are read whole, extra columns are ignored.
    """
    spark = documents.sparkSession
    texts = documents.select(F.col(key).alias("doc"), F.col(text).alias("text")).where(F.col("doc").isNotNull() & F.col("text").isNotNull())
    known = labels.where(F.col(subject).isNotNull() & F.col(label_key).isNotNull()).groupBy(F.col(label_key).alias("doc")).agg(F.array_sort(F.collect_set(subject)).alias("subjects"))
    sample = known.orderBy(F.xxhash64("doc"), "doc").limit(most)
    rows = texts.join(F.broadcast(sample), "doc").orderBy(F.xxhash64("doc"), "doc").dropDuplicates(["doc"]).collect()  # at most `most` documents
    rows.sort(key=lambda r: str(r.doc))
    model = train([(r.text, list(r.subjects)) for r in rows])
    schema = f"doc {dict(texts.dtypes)['doc']}, subject string"
    if model is None:
        return spark.createDataFrame([], schema).withColumnRenamed("doc", key)
    # plain values, as a broadcast object would need this package on every executor; bounded by the training sample
    shared = spark.sparkContext.broadcast((model.subjects, model.ids, model.pairs, model.one, model.two, model.margins))
    return texts.mapInPandas(_classify(shared), schema).distinct().withColumnRenamed("doc", key)
