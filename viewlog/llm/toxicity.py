"""Toxic documents by multiple-instance learning.

A document is a bag of sentences. Each sentence has a probability of being toxic from its words
and word beginnings (hashed); a document is toxic if any sentence is: the probabilities are
combined by noisy-or. Weights are learned from labels of documents alone, and then point to the
sentences.

Training reads at most ``ROWS_PER_CLASS`` labelled documents of either label. Features enter
only if they stand in far more toxic than clean documents of the sample, so a clean sentence has
the base probability however long it is. Scoring is one pass without a shuffle.

Defined results: a null or empty text has no sentence and score 0; without labels of both kinds
every score is 0; rows with equal or null ids are scored one by one (a null id counts as held
out); an empty table gives an empty result. Only doc_id and text are read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from viewlog.llm import text_arrays as ta
from viewlog.llm.labelled import fold, training_sample

FOLDS = 5
ROWS_PER_CLASS = 5_000
BUCKETS = 1 << 20
PREFIXES = (3, 4, 5, 6, 7)
MIN_DOCS, MIN_RATIO = 4, 4.0
ROUNDS, RATE, SHRINK = 300, 0.1, 2e-4
LIMIT = 0.5

_SENTENCE_END = ta.byte_class((0x0A, 0x0A), (0x21, 0x21), (0x2E, 0x2E), (0x3F, 0x3F))


def sentence_features(data: np.ndarray, offsets: np.ndarray):
    """Flat (bucket, word) pairs, and (sentence number, text, start, end) of each word.

    Sentence numbers rise over all texts in a row and never span two.
    """
    lower = ta.LOWER[data]
    starts, ends, first = ta.word_spans(lower, offsets, ta.ALNUM_WORD)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    stops = np.concatenate([[0], np.cumsum(_SENTENCE_END[data])])
    sentence = stops[starts] + text  # a text's end stops a sentence too
    buckets = [ta.span_hashes(lower, starts, ends) % np.uint64(BUCKETS)]
    words = [np.arange(len(starts))]
    for n in PREFIXES:
        long = np.flatnonzero(ends - starts > n)
        hashes = ta.span_hashes(lower, starts[long], starts[long] + n, seed=n)
        buckets.append(hashes % np.uint64(BUCKETS))
        words.append(long)
    return (
        np.concatenate(buckets).astype(np.int64),
        np.concatenate(words),
        sentence,
        text,
        starts,
        ends,
    )


def _bags(texts: pa.Array):
    data, offsets = ta.strings(texts)
    for low, high in ta.slices(offsets):
        found = sentence_features(data[offsets[low] : offsets[high]], offsets[low : high + 1] - offsets[low])
        yield low, high, found


class NoisyOr:
    """Weights of the chosen buckets and the base log-odds of a sentence."""

    def __init__(self):
        self.weights, self.base = np.zeros(BUCKETS, np.float32), -30.0

    def fit(self, texts: pa.Array, y: np.ndarray, totals: dict[int, int]) -> NoisyOr:
        counts = np.bincount(y, minlength=2)
        if not counts.all():
            return self
        seen = np.zeros((2, BUCKETS), np.int64)
        for low, _, (bucket, word, _, text, _, _) in _bags(texts):
            pairs = np.unique(bucket * (len(y) + 1) + text[word] + low)
            np.add.at(seen, (y[pairs % (len(y) + 1)], pairs // (len(y) + 1)), 1)
        ratio = ((seen[1] + 0.5) / counts[1]) / ((seen[0] + 0.5) / counts[0])
        chosen = np.flatnonzero((seen[1] >= MIN_DOCS) & (ratio >= MIN_RATIO))
        slot = np.full(BUCKETS, -1)
        slot[chosen] = np.arange(len(chosen))
        docs, sentences, slots, plain, shift = [], [], [], np.zeros(len(y)), 0
        for low, high, (bucket, word, sentence, text, _, _) in _bags(texts):
            bags = np.unique(np.stack([sentence, text]), axis=1)
            plain[low:high] += np.bincount(bags[1], minlength=high - low)
            use = slot[bucket] >= 0
            rows = np.unique(np.stack([sentence[word[use]] + shift, text[word[use]] + low, slot[bucket[use]]]), axis=1)
            sentences.append(rows[0])
            docs.append(rows[1])
            slots.append(rows[2])
            shift += int(sentence.max(initial=0)) + 1
        weight = np.array([1.0, totals[1] / totals[0] * counts[0] / counts[1]])[y]
        self._descend(np.concatenate(docs), np.concatenate(sentences), np.concatenate(slots), plain, y, weight, chosen, np.log(ratio[chosen]))
        return self

    def _descend(self, docs, sentences, slots, plain, y, weight, chosen, start):
        """Adam on the noisy-or likelihood; ``plain`` counts each text's sentences.

        Weights start at the log of how much more often toxic texts hold the feature.
        """
        _, at, number = np.unique(sentences, return_index=True, return_inverse=True)
        owner = docs[at]
        plain = plain - np.bincount(owner, minlength=len(y))
        theta = np.append(start, -7.0)
        mean, square = np.zeros(len(theta)), np.zeros(len(theta))
        for step in range(1, ROUNDS + 1):
            z = theta[-1] + np.bincount(number, theta[slots], len(owner))
            p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            p0 = 1 / (1 + np.exp(-theta[-1]))
            clean = np.bincount(owner, np.log1p(-np.minimum(p, 1 - 1e-9)), len(y)) + plain * np.log1p(-p0)
            clean = np.exp(clean)
            # d loss / d z of a sentence: p for clean texts, -p * clean / (1 - clean) for toxic.
            pull = weight * np.where(y == 1, -clean / np.maximum(1 - clean, 1e-9), 1.0) / weight.sum()
            dz = p * pull[owner]
            grad = np.append(np.bincount(slots, dz[number], len(chosen)), dz.sum() + (plain * pull).sum() * p0)
            grad[:-1] += SHRINK / max(1, len(chosen)) * np.sign(theta[:-1])
            mean, square = 0.9 * mean + 0.1 * grad, 0.999 * square + 0.001 * grad**2
            theta -= RATE * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-9)
        self.weights[chosen], self.base = theta[:-1], float(theta[-1])

    def score(self, found, rows: int):
        """Probability of each text, and (text, sentence start, end, p) of its likely sentences."""
        bucket, word, sentence, text, starts, ends = found
        if not len(sentence):
            return np.zeros(rows), []
        by_word = np.bincount(word, self.weights[bucket], len(sentence))
        # Words and beginnings count once a sentence in training; repeats add little here.
        new = np.append(True, sentence[1:] != sentence[:-1])
        begin = np.flatnonzero(new)
        z = self.base + np.add.reduceat(by_word, begin)
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        clean = np.bincount(text[begin], np.log1p(-np.minimum(p, 1 - 1e-9)), rows)
        last = np.append(begin[1:], len(sentence)) - 1
        bad = np.flatnonzero(p >= LIMIT)
        spans = list(
            zip(text[begin][bad].tolist(), starts[begin][bad].tolist(), ends[last][bad].tolist(), strict=True)
        )
        return 1 - np.exp(clean), spans


def fit(docs: DataFrame, labels: DataFrame) -> NoisyOr:
    sample, totals = training_sample(docs, labels, "toxic", lambda i: fold(i, FOLDS) != 0, ROWS_PER_CLASS)
    rows = sample.orderBy("doc_id").toArrow().combine_chunks()
    y = rows.column("y").to_numpy().astype(np.int64)
    texts = rows.column("text")
    texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
    return NoisyOr().fit(texts, y, totals)


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted, sentences): the likely toxic sentences as texts."""
    spark = docs.sparkSession
    ta.small_batches(spark)
    model = ta.send(spark, fit(docs, labels))

    def scored(batches):
        own = ta.received(model)
        for batch in batches:
            names, texts = batch.column("doc_id"), batch.column("text")
            data, offsets = ta.strings(texts)
            for low, high in ta.slices(offsets):
                part = data[offsets[low] : offsets[high]]
                found = sentence_features(part, offsets[low : high + 1] - offsets[low])
                scores, spans = own.score(found, high - low)
                sentences: list[list[str]] = [[] for _ in range(high - low)]
                for row, begin, end in spans:
                    sentences[row].append(part[begin:end].tobytes().decode("utf-8", "replace"))
                yield pa.RecordBatch.from_arrays(
                    [names.slice(low, high - low), pa.array(scores), pa.array(sentences, pa.list_(pa.string()))],
                    ["doc_id", "score", "sentences"],
                )

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    made = rows.mapInArrow(scored, "doc_id bigint, score double, sentences array<string>")
    return made.select(
        "doc_id",
        F.coalesce(fold(F.col("doc_id"), FOLDS) == 0, F.lit(True)).alias("held_out"),
        "score",
        (F.col("score") >= LIMIT).cast("int").alias("predicted"),
        "sentences",
    )
