"""Toxicity by multiple-instance learning: documents are bags of sentences, joined by noisy-or."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .langid import Words, held_out
from .textnp import column_bytes, mix, row_groups

BITS = 20
#: Lengths of the word prefixes that are features beside the whole word.
PREFIXES = (3, 4, 5, 6, 7)
#: Labelled documents that the model is fitted on: this many of either class, on average, at most.
TRAIN_TOXIC = 1000
TRAIN_CLEAN = 2500
#: A feature takes part if it is in so many toxic documents of the sample, and tells the classes apart with
#: a likelihood ratio statistic of so much.
MIN_TOXIC = 2
MIN_RATIO = 6.0
EPOCHS = 120
RATE = 0.5
L1 = 0.05
START = -3.0
#: The bias of the document scores is set by fits that leave out one of so many parts of the sample.
FOLDS = 3
#: Sentences that carry so much of a document's score are reported.
OFFENDING = 0.25
#: Of the sentence ends within so many words the first counts, so that runs of one-word sentences stay together.
SHORTEST = 8
#: Characters that end a sentence (fixed values).
STOPS = np.array([0x0A, 0x21, 0x2E, 0x3F, 0x3002, 0xFF01, 0xFF1F, 0x0964], dtype=np.uint32)

_PLACE = mix(np.arange(1, 65, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F)) | np.uint64(1)


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[Words, np.ndarray, np.ndarray]:
    """The words of a group of rows, a matrix of their feature buckets (-1: none), and the sentence of each word."""
    w = Words(data, offsets)
    n = len(w.starts)
    if not n:
        return w, np.zeros((0, 1 + len(PREFIXES)), np.int64), np.zeros(0, np.int64)
    place = np.arange(len(w.flat)) - np.repeat(w.gram_starts, w.letters + 1)
    terms = w.flat * _PLACE[place & 63]
    whole = np.add.reduceat(terms, w.gram_starts)
    out = np.full((n, 1 + len(PREFIXES)), -1, dtype=np.int64)
    shift = np.uint64(64 - BITS)
    out[:, 0] = (mix(whole) >> shift).astype(np.int64)
    run = np.zeros(n, dtype=np.uint64)
    for k in range(max(PREFIXES)):
        has = w.letters > k
        run[has] += terms[w.gram_starts[has] + k]
        if k + 1 in PREFIXES:
            out[has, 1 + PREFIXES.index(k + 1)] = (mix(run[has] + np.uint64(k + 1)) >> shift).astype(np.int64)
    stops = np.flatnonzero(np.isin(w.codes, STOPS))
    before = np.searchsorted(stops, w.starts)
    new_row = np.ones(n, dtype=bool)
    new_row[1:] = w.rows[1:] != w.rows[:-1]
    at = np.arange(n)
    cell = (at - np.maximum.accumulate(np.where(new_row, at, 0))) // SHORTEST
    ends = np.flatnonzero((before[1:] != before[:-1]) & ~new_row[1:]) + 1
    first = np.ones(len(ends), dtype=bool)
    first[1:] = (cell[ends[1:]] != cell[ends[:-1]]) | (w.rows[ends[1:]] != w.rows[ends[:-1]])
    fresh = new_row
    fresh[ends[first]] = True
    return w, out, np.cumsum(fresh) - 1


def _softplus(z: np.ndarray) -> np.ndarray:
    return np.maximum(z, 0) + np.log1p(np.exp(-np.abs(z)))


def sentence_logits(weights: np.ndarray, by_sentence: np.ndarray, bag: np.ndarray, n_docs: int) -> np.ndarray:
    """The logit of each sentence: its features' weights, the bias, and less the more sentences its document has, as long documents are no likelier to be toxic."""
    return weights[-2] + by_sentence - np.log(np.maximum(1, np.bincount(bag, minlength=n_docs)))[bag]


def noisy_or(z: np.ndarray, bag: np.ndarray, n_docs: int) -> np.ndarray:
    """-log(1 - P) of each document, where 1 - P is the product of its sentences' 1 - p."""
    return np.bincount(bag, _softplus(z), minlength=n_docs)


def slopes(z: np.ndarray, bag: np.ndarray, label: np.ndarray) -> np.ndarray:
    """The slope of the bags' negative log likelihood at each z: p in a clean document and -p (1 - P) / P in a toxic one."""
    p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    clean = np.exp(-noisy_or(z, bag, len(label)))
    return p * np.where(label[bag] > 0, -(clean / np.maximum(1 - clean, 1e-4))[bag], 1.0)


def common_features(buckets: np.ndarray, sentence: np.ndarray, bag: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, sentence) of the features that may take part: in ``MIN_TOXIC`` toxic documents or more, and telling the classes apart by a quarter of what is asked for at least.

    Most words of a sample are in one document only or equally common in both classes, so what is left is small.
    """
    has = buckets >= 0
    flat, of = buckets[has].astype(np.int32), np.repeat(sentence.astype(np.int32), has.sum(1))
    toxic = (label[bag] > 0)[of]
    pairs = np.unique(flat[toxic].astype(np.int64) * len(label) + bag[of[toxic]])
    keep = (np.bincount(pairs // len(label), minlength=1 << BITS) >= MIN_TOXIC)[flat]
    del toxic, pairs
    flat, of = flat[keep], of[keep]
    keep = telling_features(flat, bag[of], label, MIN_RATIO / 4)[flat]
    return flat[keep], of[keep]


def telling_features(flat: np.ndarray, doc: np.ndarray, label: np.ndarray, least: float = MIN_RATIO) -> np.ndarray:
    """Whether each bucket is commoner in toxic documents, by a likelihood ratio test over documents."""
    pairs = np.unique(flat.astype(np.int64) * len(label) + doc)
    feature, toxic = pairs // len(label), label[pairs % len(label)] > 0
    a = np.bincount(feature, toxic, minlength=1 << BITS)
    c = np.bincount(feature, ~toxic, minlength=1 << BITS)
    n_a, n_c = (label > 0).sum(), (label <= 0).sum()
    n = n_a + n_c

    def part(seen: np.ndarray, of: np.ndarray) -> np.ndarray:
        return np.where(seen > 0, seen * np.log(np.maximum(seen, 1) / np.maximum(of, 1e-9)), 0)

    both = a + c
    ratio = 2 * (part(a, both * n_a / n) + part(c, both * n_c / n) + part(n_a - a, (n - both) * n_a / n) + part(n_c - c, (n - both) * n_c / n))
    return (a >= MIN_TOXIC) & (a * n_c > c * n_a) & (ratio >= least)


def fit_noisy_or(flat: np.ndarray, of: np.ndarray, bag: np.ndarray, label: np.ndarray, epochs: int = EPOCHS) -> np.ndarray:
    """Weights (2 ** BITS, then the sentences' bias and 0) by AdaGrad with an L1 penalty on the bags' likelihood.

    ``flat`` and ``of`` are the bucket and the sentence of each feature, ``bag`` the document of each sentence, in order. Weights are 0 or more: only what marks toxic documents counts.
    """
    n_s = len(bag)
    good = telling_features(flat, bag[of], label)[flat]
    used, column = np.unique(flat[good], return_inverse=True)
    of = of[good]
    out = np.zeros((1 << BITS) + 2)
    w, out[-2] = np.zeros(len(used)), START
    seen_w, seen_b = np.ones(len(used)), 1.0
    for _ in range(epochs):
        slope = slopes(sentence_logits(out, np.bincount(of, w[column], minlength=n_s), bag, len(label)), bag, label)
        g, gb = np.bincount(column, slope[of], minlength=len(used)), slope.sum()
        seen_w += g * g
        seen_b += gb * gb
        w = np.maximum(w - RATE / np.sqrt(seen_w) * (g + L1), 0)
        out[-2] -= RATE * gb / np.sqrt(seen_b)
    out[used] = w
    return out


def _logits(weights: np.ndarray, flat: np.ndarray, of: np.ndarray, bag: np.ndarray, n_docs: int) -> np.ndarray:
    z = sentence_logits(weights, np.bincount(of, weights[flat], minlength=len(bag)), bag, n_docs)
    return np.log(np.expm1(np.clip(noisy_or(z, bag, n_docs), 1e-9, 50)))


def fit_calibrated(buckets: np.ndarray, sentence: np.ndarray, bag: np.ndarray, label: np.ndarray, folds: int = FOLDS) -> np.ndarray:
    """``fit_noisy_or``, with the last weight a shift of the documents' logits.

    Documents that a fit has learned from look surer than others, so the shift is the one that makes the documents left out
    of ``folds`` smaller fits as often toxic as they are scored.
    """
    flat, of = common_features(buckets, sentence, bag, label)
    out = fit_noisy_or(flat, of, bag, label)
    fold, x = np.arange(len(label)) % folds, np.zeros(len(label))
    for k in range(folds):
        parts = []
        for docs in (fold != k, fold == k):
            of_bag = docs[bag]
            mine = of_bag[of]
            parts.append((flat[mine], (np.cumsum(of_bag) - 1)[of[mine]], (np.cumsum(docs) - 1)[bag[of_bag]]))
        x[fold == k] = _logits(fit_noisy_or(*parts[0], label[fold != k]), *parts[1], int((fold == k).sum()))
    # targets just inside 0 and 1, so that separable classes give a bounded shift
    toxic, clean = (label > 0).sum(), (label <= 0).sum()
    target = np.where(label > 0, (toxic + 1) / (toxic + 2), 1 / (clean + 2))
    for _ in range(50):
        p = 1 / (1 + np.exp(-(x + out[-1])))
        out[-1] -= np.clip((p - target).sum() / max(1e-3, (p * (1 - p)).sum()), -1, 1)
    return out


def learn(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", toxic: int = TRAIN_TOXIC, clean: int = TRAIN_CLEAN, seed: int = 11) -> np.ndarray:
    """Weights from a bounded sample of labelled documents: by a hash of the id, ``toxic`` and ``clean`` of them on average at most.

    Of contradicting labels of a document the higher counts. The sample's whole texts meet in
    one task, which their stated number bounds. Without documents of both classes the weights are those of an untrained model.
    """
    marks = labels.select("doc_id", F.col(label_col).cast("int").alias("label")).where("doc_id is not null and label is not null").groupBy("doc_id").agg(F.max("label").alias("label"))
    sizes = {r.label: r["count"] for r in marks.withColumn("label", (F.col("label") > 0).cast("int")).groupBy("label").count().collect()}
    if len(sizes) < 2:
        return np.append(np.zeros(1 << BITS), (START, 0.0))
    share = {1: min(1.0, toxic / sizes[1]), 0: min(1.0, clean / sizes[0])}
    draw = F.pmod(F.xxhash64(F.lit(seed), F.col("doc_id")), F.lit(1 << 30)) / float(1 << 30)
    picked = marks.where(draw < F.when(F.col("label") > 0, share[1]).otherwise(share[0]))
    sample = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").select("label", "text", F.xxhash64("doc_id", "text").alias("order"))

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, n_s, n_d = [], 0, 0
        for batch in batches:
            data, offsets = column_bytes(batch, "text")
            marks = batch.column(batch.schema.get_field_index("label")).to_numpy(zero_copy_only=False)
            for i, j in row_groups(offsets):
                w, buckets, sentence = features(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                if len(sentence):
                    first = np.flatnonzero(np.diff(sentence, prepend=-1))
                    parts.append((buckets.astype(np.int32), sentence + n_s, w.rows[first] + n_d))
                    n_s += int(sentence[-1]) + 1
                n_d += j - i
                parts.append(marks[i:j])
        if not parts:
            return
        bags = [x for x in parts if isinstance(x, tuple)]
        label = np.concatenate([x for x in parts if not isinstance(x, tuple)])
        parts.clear()
        if bags:
            sample = [np.concatenate(x) for x in zip(*bags, strict=True)]
            bags.clear()
            weights = fit_calibrated(*sample, label)
            at = np.flatnonzero(weights)
            yield pa.RecordBatch.from_pydict({"slot": pa.array(at, pa.int64()), "w": pa.array(weights[at])})

    got = sample.repartition(1).sortWithinPartitions("order").mapInArrow(fit, "slot long, w double").toArrow()
    weights = np.append(np.zeros(1 << BITS), (START, 0.0))
    if got.num_rows:
        weights[:] = 0
        weights[got["slot"].to_numpy()] = got["w"].to_numpy()
    return weights


def score(docs: DataFrame, weights: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, score double, sentences array<struct<start, end, score>> of each row.

    ``score`` is the calibrated noisy-or of the sentence probabilities. The score of a sentence is its share: the probability that it
    offends if the document does, times ``score``; ``sentences`` are those of
    ``OFFENDING`` or more, from their first to their last word in code points. Null and empty texts and
    texts without a letter have no sentence and score 0. Whole texts are read;
    repeated rows score alike; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(weights.astype(np.float32))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.append(shared.value[:-2], np.float32(0))  # the last slot: no feature
        for batch in batches:
            data, offsets = column_bytes(batch, "text")
            for i, j in row_groups(offsets):
                w, buckets, sentence = features(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                n = j - i
                total, spans = np.zeros(n), [[] for _ in range(n)]
                if len(sentence):
                    by_word = table[buckets].sum(1)
                    first = np.flatnonzero(np.diff(sentence, prepend=-1))
                    row = w.rows[first]
                    z = sentence_logits(shared.value, np.add.reduceat(by_word, first), row, n).astype(np.float64)
                    every = np.maximum(noisy_or(z, row, n), 1e-12)
                    total = np.where(np.bincount(row, minlength=n) > 0, 1 / (1 + np.exp(-shared.value[-1]) / np.expm1(np.minimum(every, 50))), 0)
                    own = total[row] / (1 + np.exp(-z)) / -np.expm1(-every[row])
                    last = np.append(first[1:], len(sentence)) - 1
                    for k in np.flatnonzero(own >= OFFENDING).tolist():
                        r = int(row[k])
                        spans[r].append({"start": int(w.starts[first[k]] - w.row_starts[r]), "end": int(w.ends[last[k]] - w.row_starts[r]), "score": min(1.0, float(own[k]))})
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, n), pa.array(np.clip(total, 0, 1)), pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())])))],
                    names=["id", "score", "sentences"],
                )

    kind = dict(docs.dtypes)[id_col]
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, score double, sentences array<struct<start:int,end:int,score:double>>")


def op10_query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    weights = learn(docs, labels.where(F.crc32(F.col("doc_id").cast("string")) % 3 != 1))
    found = score(docs, weights)
    return found.select(F.col("id").alias("doc_id"), held_out(F.col("id"), 3, 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
