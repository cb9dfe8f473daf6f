"""Language identification: script ranges, n-gram word scores, Viterbi spans."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .textnp import column_bytes, mix, row_groups

BITS = 16
SMOOTHING = 0.5
SWITCH_PENALTY = 12.0
#: Whole texts that a language's model is learned from: this many, on average, at most.
TRAIN_DOCS = 3000
#: Learned labels at most; more is an error.
MAX_LABELS = 512
UNDETERMINED = "und"

#: Letter ranges of scripts (fixed values); anything else is script 0.
SCRIPTS = {
    "Latin": [(0x0041, 0x005A), (0x0061, 0x007A), (0x00AA, 0x00AA), (0x00BA, 0x00BA), (0x00C0, 0x02AF), (0x1E00, 0x1EFF), (0x2C60, 0x2C7F), (0xA720, 0xA7FF), (0xFF21, 0xFF5A)],
    "Greek": [(0x0370, 0x03FF), (0x1F00, 0x1FFF)],
    "Cyrillic": [(0x0400, 0x052F), (0x1C80, 0x1C8F), (0x2DE0, 0x2DFF), (0xA640, 0xA69F)],
    "Armenian": [(0x0530, 0x058F)],
    "Hebrew": [(0x0590, 0x05FF), (0xFB1D, 0xFB4F)],
    "Arabic": [(0x0600, 0x06FF), (0x0750, 0x077F), (0x08A0, 0x08FF), (0xFB50, 0xFDFF), (0xFE70, 0xFEFF)],
    "Devanagari": [(0x0900, 0x097F)],
    "Bengali": [(0x0980, 0x09FF)],
    "Gurmukhi": [(0x0A00, 0x0A7F)],
    "Gujarati": [(0x0A80, 0x0AFF)],
    "Tamil": [(0x0B80, 0x0BFF)],
    "Telugu": [(0x0C00, 0x0C7F)],
    "Kannada": [(0x0C80, 0x0CFF)],
    "Malayalam": [(0x0D00, 0x0D7F)],
    "Thai": [(0x0E00, 0x0E7F)],
    "Georgian": [(0x10A0, 0x10FF), (0x2D00, 0x2D2F)],
    "Ethiopic": [(0x1200, 0x139F)],
    "Khmer": [(0x1780, 0x17FF)],
    "Kana": [(0x3040, 0x30FF), (0x31F0, 0x31FF)],
    "Hangul": [(0x1100, 0x11FF), (0x3130, 0x318F), (0xAC00, 0xD7AF)],
    "Han": [(0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x3FFFF)],
}

_TABLES: list[np.ndarray] = []


def _tables() -> list[np.ndarray]:
    """is-letter, lower-case and script by code point, made once in a worker."""
    if not _TABLES:
        points = [chr(i) for i in range(0x110000)]
        letter = np.fromiter((c.isalpha() for c in points), dtype=bool, count=0x110000)
        lower = np.arange(0x110000, dtype=np.uint32)
        for i in np.flatnonzero(letter):
            low = points[i].lower()
            if len(low) == 1:
                lower[i] = ord(low)
        script = np.zeros(0x110000, dtype=np.uint8)
        for k, ranges in enumerate(SCRIPTS.values(), 1):
            for a, b in ranges:
                script[a : b + 1] = k
        _TABLES.extend((letter, lower, script))
    return _TABLES


class Words:
    """The letter runs of a group of rows, with the n-gram buckets of each."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        letter, lower, script = _tables()
        codes = np.frombuffer(data.tobytes().decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        heads = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
        self.row_starts = heads[offsets]
        self.codes = codes
        n = len(codes)
        inside = letter[codes]
        edge = np.zeros(n + 1, dtype=bool)
        edge[self.row_starts] = True
        begin = inside.copy()
        begin[1:] &= ~inside[:-1] | edge[1:n]
        last = inside.copy()
        last[:-1] &= ~inside[1:] | edge[1:n]
        self.starts, self.ends = np.flatnonzero(begin), np.flatnonzero(last) + 1
        self.rows = np.searchsorted(self.row_starts, self.starts, "right") - 1
        self.letters = self.ends - self.starts
        if not len(self.starts):
            self.scripts, self.buckets, self.gram_starts, self.flat = np.zeros(0, np.uint8), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
            return
        self.scripts = script[codes[self.starts]]
        # the letters of all words side by side, each word followed by one 0
        word_of = np.repeat(np.arange(len(self.starts)), self.letters)
        flat = np.zeros(int(self.letters.sum()) + len(self.starts), dtype=np.uint64)
        flat[np.arange(len(word_of)) + word_of] = lower[codes[inside]]
        one = np.concatenate((np.zeros(1, np.uint64), flat[:-1]))
        two = np.concatenate((np.zeros(2, np.uint64), flat[:-2]))
        two[one == 0] = 0
        self.buckets = (mix((two << np.uint64(42)) | (one << np.uint64(21)) | flat) >> np.uint64(64 - BITS)).astype(np.int64)
        self.gram_starts = np.concatenate(([0], np.cumsum(self.letters + 1)[:-1]))
        self.flat = flat


def learn(docs: DataFrame, per_label: int = TRAIN_DOCS) -> dict:
    """A model from rows of text and lang: hashed letter-trigram log probabilities, and the scripts of each language.

    Each language is learned from a sample of ``per_label`` whole texts on
    average, taken by a hash of the text; smaller languages from all their texts.
    Counting runs in Spark; what returns is one table of 2 ** BITS buckets a language.
    """
    docs = docs.where("lang is not null and text is not null")
    sizes = {r.lang: r["count"] for r in docs.groupBy("lang").count().limit(MAX_LABELS + 1).collect()}
    if len(sizes) > MAX_LABELS:
        raise ValueError(f"more than {MAX_LABELS} languages to learn")
    langs = sorted(sizes)
    if not langs:
        return {"langs": [], "logp": np.zeros((1 << BITS, 0), np.float32), "scripts": np.zeros((len(SCRIPTS) + 1, 0), bool)}
    keep = F.lit(False)
    for lang in langs:
        if sizes[lang] <= per_label:
            keep = keep | (F.col("lang") == lang)
        else:
            keep = keep | ((F.col("lang") == lang) & (F.pmod(F.xxhash64("text"), F.lit(1 << 20)) < int((1 << 20) * per_label / sizes[lang])))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            data, offsets = column_bytes(batch, "text")
            labels = batch.column(batch.schema.get_field_index("lang")).to_pylist()
            for i, j in row_groups(offsets):
                w = Words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                gram_rows = np.repeat(w.rows, w.letters + 1)
                names = np.array(labels[i:j], dtype=object)
                for lang in set(labels[i:j]):
                    mine = names == lang
                    total = sums.setdefault(lang, np.zeros((1 << BITS) + len(SCRIPTS) + 1))
                    if len(w.starts):
                        total[: 1 << BITS] += np.bincount(w.buckets[mine[gram_rows]], minlength=1 << BITS)
                        total[1 << BITS :] += np.bincount(w.scripts[mine[w.rows]], minlength=len(SCRIPTS) + 1)
        for lang, total in sums.items():
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(at), pa.string()), "slot": pa.array(at, pa.int64()), "n": pa.array(total[at].astype(np.int64))})

    counted = docs.where(keep).select("lang", "text").mapInArrow(count, "lang string, slot long, n long").groupBy("lang", "slot").agg(F.sum("n").alias("n")).toArrow()
    table = np.zeros(((1 << BITS) + len(SCRIPTS) + 1, len(langs)))
    place = {lang: k for k, lang in enumerate(langs)}
    table[counted["slot"].to_numpy(), [place[x] for x in counted["lang"].to_pylist()]] = counted["n"].to_numpy()
    grams, scripts = table[: 1 << BITS], table[1 << BITS :]
    seen = max(1, int((grams.sum(1) > 0).sum()))
    logp = np.log((grams + SMOOTHING) / (grams.sum(0) + SMOOTHING * seen))
    return {"langs": langs, "logp": logp.astype(np.float32), "scripts": scripts > 0.005 * np.maximum(1, scripts.sum(0))}


def viterbi(scores: np.ndarray, begins: np.ndarray, lengths: np.ndarray, penalty: float) -> np.ndarray:
    """The best label of each word of each sequence, where a change of label costs ``penalty``; all sequences step together."""
    n_labels = scores.shape[1]
    labels = np.zeros(len(scores), dtype=np.int64)
    order = np.argsort(-lengths, kind="stable")
    begins, lengths = begins[order], lengths[order]
    back = np.zeros((len(scores), n_labels), dtype=np.int16)
    value = np.zeros((len(begins), n_labels))
    own = np.arange(n_labels)
    active = np.searchsorted(-lengths, -np.arange(int(lengths[0]) if len(lengths) else 0), "left")
    for t, k in enumerate(active):
        v, at = value[:k], begins[:k] + t
        top = v.argmax(1)
        change = v[np.arange(k), top] - penalty
        stay = v >= change[:, None]
        back[at] = np.where(stay, own, top[:, None])
        value[:k] = np.where(stay, v, change[:, None]) + scores[at]
    now = value.argmax(1) if len(begins) else np.zeros(0, np.int64)
    for t in range(len(active) - 1, -1, -1):
        k = active[t]
        at = begins[:k] + t
        labels[at] = now[:k]
        now[:k] = back[at, now[:k]]
    return labels


def label_words(scores: np.ndarray, begins: np.ndarray, penalty: float) -> np.ndarray:
    """Viterbi labels of each row's words. Rows where no change can pay are labelled at once.

    With b the best single label of a row, a stretch of other labels gains at most
    the sum, over its words, of their best score less b's. If no stretch gains
    more than one penalty, the path that stays with b is the best one.
    """
    lengths = np.diff(begins)
    labels = np.zeros(len(scores), dtype=np.int64)
    filled = np.flatnonzero(lengths)
    if not len(filled) or scores.shape[1] < 2:
        return labels
    best = np.add.reduceat(scores, begins[:-1][filled], axis=0).argmax(1)
    labels = np.repeat(best, lengths[filled])
    rest = scores.copy()
    at = np.arange(len(scores))
    base = scores[at, labels]
    rest[at, labels] = -np.inf
    gain = rest.max(1) - base
    sums = np.concatenate(([0.0], np.cumsum(gain, dtype=np.float64)))
    hard = []
    for r in filled:
        s = sums[begins[r] : begins[r + 1] + 1]
        if (s[1:] - np.minimum.accumulate(s[:-1])).max() > penalty:
            hard.append(r)
    if hard:
        at = np.array(hard)
        found = viterbi(scores, begins[at], lengths[at], penalty)
        for r in hard:
            labels[begins[r] : begins[r + 1]] = found[begins[r] : begins[r + 1]]
    return labels


def identify(docs: DataFrame, model: dict, text_col: str = "text", penalty: float = SWITCH_PENALTY) -> DataFrame:
    """``docs`` with lid_lang string, lid_score double, lid_spans array<struct<start, end, lang>>.

    The script of a word's first letter leaves the languages that use that script
    (all, if none does); its score for each is the sum of its letter trigrams'
    log probabilities; Viterbi with a penalty for each change of language labels the
    words, and spans are the stretches of one label, in code points, end exclusive.
    lid_lang has the most letters (ties: the first by name); lid_score is its share
    of the letters times its softmax share of the score of the words so labelled. Null texts and texts
    without a letter are ``und`` with score 0 and no spans, as is every text if nothing was learned.
    Whole texts are read, of any length; repeated rows are labelled alike; other columns
    pass through, but those with the names of the three results are replaced.
    """
    sc = docs.sparkSession.sparkContext
    shared = sc.broadcast(model)
    docs = docs.drop("lid_lang", "lid_score", "lid_spans")
    n_plain, names = len(docs.columns), [*docs.columns, "lid_lang", "lid_score", "lid_spans"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        langs, logp, scripts = m["langs"], m["logp"], m["scripts"]
        for batch in batches:
            data, offsets = column_bytes(batch, text_col)
            for i, j in row_groups(offsets):
                w = Words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                n = j - i
                pred, score, spans = [UNDETERMINED] * n, [0.0] * n, [[] for _ in range(n)]
                if len(w.starts) and langs:
                    scores = np.add.reduceat(logp[w.buckets], w.gram_starts, axis=0)
                    allowed = scripts[w.scripts]
                    allowed[~allowed.any(1)] = True
                    scores = np.where(allowed, scores, scores.min(1, keepdims=True) - 20.0)
                    begins = np.searchsorted(w.rows, np.arange(n + 1))
                    labels = label_words(scores, begins, penalty)
                    weight = np.zeros((n, len(langs)))
                    np.add.at(weight, (w.rows, labels), w.letters)
                    filled = np.flatnonzero(np.diff(begins))
                    top = weight.argmax(1)
                    mine = labels == top[w.rows]
                    sums = np.stack([np.bincount(w.rows[mine], scores[mine, k], minlength=n) for k in range(len(langs))], 1)
                    means = (sums / np.sqrt(np.maximum(1, np.bincount(w.rows[mine], minlength=n)))[:, None])[filled]
                    odds = np.exp(means - means.max(1, keepdims=True))
                    odds /= odds.sum(1, keepdims=True)
                    share = weight[filled, top[filled]] / weight[filled].sum(1)
                    change = np.ones(len(labels), dtype=bool)
                    change[1:] = (labels[1:] != labels[:-1]) | (w.rows[1:] != w.rows[:-1])
                    first = np.flatnonzero(change)
                    final = np.append(first[1:], len(labels)) - 1
                    for a, b in zip(first.tolist(), final.tolist(), strict=True):
                        r = w.rows[a]
                        spans[r].append({"start": int(w.starts[a] - w.row_starts[r]), "end": int(w.ends[b] - w.row_starts[r]), "lang": langs[labels[a]]})
                    for r, s, o in zip(filled.tolist(), share.tolist(), odds, strict=True):
                        pred[r] = langs[top[r]]
                        score[r] = min(1.0, max(0.0, s * max(float(o[top[r]]), 1 / len(langs))))
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c).slice(i, n) for c in range(n_plain)), pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())])))],
                    names=names,
                )

    own = T._parse_datatype_string("lid_lang string, lid_score double, lid_spans array<struct<start:int,end:int,lang:string>>")
    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *own.fields]))


def held_out(doc_id: Column, modulus: int, remainder: int) -> Column:
    """Whether crc32 of the id as text leaves ``remainder``; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % modulus == remainder, F.lit(False))


def learnable(docs: DataFrame) -> DataFrame:
    return docs.where(F.crc32(F.col("doc_id").cast("string")) % 4 != 2)


def op4_query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    found = identify(docs.select("doc_id", "text"), learn(learnable(docs)))
    return found.select("doc_id", held_out(F.col("doc_id"), 4, 2).alias("held_out"), F.col("lid_lang").alias("lang_pred"), F.col("lid_score").alias("score"))


def keep_identified(docs: DataFrame, least: float = 0.1) -> DataFrame:
    """The rows of ``docs`` whose text has letters and whose language is told with a score of ``least`` or more.

    Where nothing can be learned (no row with a language outside the held-out ones), every row whose text has a letter stays.
    """
    model = learn(learnable(docs))
    if not model["langs"]:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    found = identify(docs, model)
    return found.where((F.col("lid_lang") != UNDETERMINED) & (F.col("lid_score") >= least)).select(*docs.columns)
