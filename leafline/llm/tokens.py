"""Token counts by byte-pair merging with a heap and a linked list; no token identifiers are made."""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator

import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

TOKENIZER = "byte_bpe_50k.json"
LIMIT = 512
#: Counts of pieces that a Python worker keeps; when it is full it starts anew.
KEPT_PIECES = 1 << 19
#: Longer pieces are counted each time, so that what is kept has a bound in bytes too.
KEPT_LENGTH = 64
#: Code points below this are letters, numbers or white space alike for the pattern and for the library's own (older) Unicode tables.
AGREED = 0x530

#: Fixed value: the split of byte-level tokenizers of this kind.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_PIECES = regex.compile(PIECES)
_OTHERS = regex.compile(rf"[^\x00-\u{AGREED - 1:04x}]")


def byte_symbols() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary: itself if it is printable, else the next one from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


class Merges:
    """The merges of a tokenizer file: (left, right) -> rank and the number of what they make."""

    def __init__(self, spec: str):
        spec_ = json.loads(spec)
        model, split = spec_["model"], spec_["pre_tokenizer"]
        plain = model["type"] == "BPE" and split["type"] == "ByteLevel" and split.get("use_regex", True) and not split["add_prefix_space"]
        if not plain or spec_["normalizer"] or spec_["post_processor"] or any(model[k] for k in ("dropout", "ignore_merges", "continuing_subword_prefix", "end_of_word_suffix")):
            raise ValueError("not a plain byte-level tokenizer")
        number: dict[str, int] = {}
        for symbol in [*byte_symbols(), *("".join(m) for m in model["merges"])]:
            number.setdefault(symbol, len(number))
        self.table = {(number[a], number[b]): (rank, number[a + b]) for rank, (a, b) in enumerate(model["merges"])}
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec_["added_tokens"]):
            raise ValueError("added tokens that take characters around them")
        self.added = sorted((t["content"] for t in spec_["added_tokens"]), key=len, reverse=True)

    def count(self, data: bytes) -> int:
        """Tokens of one piece: its bytes less the merges. The pair of lowest rank merges first, of equal ones the leftmost."""
        table, symbols, n = self.table, list(data), len(data)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(made[0], i) for i in range(n - 1) if (made := table.get((symbols[i], symbols[i + 1]))) is not None]
        heapq.heapify(heap)
        merges = 0
        while heap:
            rank, i = heapq.heappop(heap)
            j = after[i]
            if j >= n or symbols[i] < 0:
                continue
            made = table.get((symbols[i], symbols[j]))
            if made is None or made[0] != rank:  # the pair has changed since it was pushed
                continue
            merges += 1
            symbols[i], symbols[j] = made[1], -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (made := table.get((symbols[i], symbols[k]))) is not None:
                    heapq.heappush(heap, (made[0], i))
            if (h := before[i]) >= 0 and (made := table.get((symbols[h], symbols[i]))) is not None:
                heapq.heappush(heap, (made[0], h))
        return n - merges


class Counts(dict):
    """piece -> tokens, computed when first asked for; bounded in entries and in the length of each."""

    def __init__(self, merges: Merges):
        self.merges = merges

    def __missing__(self, piece: str) -> int:
        n = self.merges.count(piece.encode("utf-8", "replace"))
        if len(piece) <= KEPT_LENGTH:
            if len(self) >= KEPT_PIECES:
                self.clear()
            self[piece] = n
        return n


class Counter:
    """Counts the tokens of texts under one tokenizer file."""

    def __init__(self, spec: str):
        self.merges, self.pre = Merges(spec), Tokenizer.from_str(spec).pre_tokenizer
        self.counts = Counts(self.merges)
        self.added = regex.compile("|".join(map(regex.escape, self.merges.added))) if self.merges.added else None

    def pieces(self, text: str) -> Iterator[str]:
        if _OTHERS.search(text) is None:
            return (m.group() for m in _PIECES.finditer(text))
        return (text[a:b] for _, (a, b) in self.pre.pre_tokenize_str(text))

    def tokens(self, text: str) -> int:
        n = 0
        if self.added is not None and self.added.search(text):
            parts = self.added.split(text)
            return len(parts) - 1 + sum(self.tokens(p) for p in parts)
        if len(text) < 1 << 20 and _OTHERS.search(text) is None:
            return sum(map(self.counts.__getitem__, _PIECES.findall(text)))
        for piece in self.pieces(text):
            n += self.counts[piece]
        return n


_COUNTERS: dict[str, Counter] = {}


def _counter(spec: str) -> Counter:
    """The worker's counter; the next task of the worker finds what it keeps."""
    if spec not in _COUNTERS:
        _COUNTERS.clear()
        _COUNTERS[spec] = Counter(spec)
    return _COUNTERS[spec]


def count_tokens(docs: DataFrame, tokenizer: str | None = None, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_bytes, n_tokens, over_limit of every row of ``docs``, by the byte-level tokenizer file ``tokenizer`` (its path on the driver).

    A text is cut at the strings of added tokens, which count one each, and then into
    pieces; a piece's count is its bytes less the merges that a heap of adjacent pairs and a
    linked list of symbols allow. Whole texts are counted, without added tokens of the
    tokenizer's own, truncation or padding. The file is broadcast: a tokenizer's size doesn't
    grow with the data. Where a text holds characters that Unicode versions class
    differently, its pieces are cut by the library's own splitter.

    A null or empty text has 0 bytes and 0 tokens. Rows that repeat are counted each; a null
    id stays null. Bytes that are no UTF-8 count as U+FFFD in tokens. Other columns are
    ignored, an empty table gives an empty one, and nothing is shuffled.
    """
    spark = docs.sparkSession
    with open(tokenizer or public_tokenizers.path(TOKENIZER), encoding="utf-8") as f:
        spec = spark.sparkContext.broadcast(f.read())

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(spec.value)
        for batch in batches:
            n = [counter.tokens(text.as_py()) for text in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64())], ["id", "n_bytes", "n_tokens"])

    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.octet_length(text).cast("long").alias("n_bytes"), F.make_valid_utf8(text).alias("text"))
    out = rows.mapInArrow(counted, f"id {rows.schema['id'].dataType.simpleString()}, n_bytes long, n_tokens long")
    return out.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op12_query(spark, sf_dir: str) -> DataFrame:
    return count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"))
