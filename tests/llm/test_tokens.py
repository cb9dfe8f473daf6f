"""Token counts against the library itself."""

import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from leafline.llm import tokens

PARTS = ["a", "b", " ", "  ", "\n", "\t", "<|endoftext|>", "<|endof", "text|>", "'s", "'T", "é", "日本", "1", "½", "՘", "꟎", "😀", "́", "\x00", "\x85", "\x1c", " ", "the", "ing", "_", "-", " the", "!!", "ſ", "ß"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path(tokens.TOKENIZER))


def test_random_texts_count_as_the_library_counts_them(library):
    counter = tokens.Counter(open(public_tokenizers.path(tokens.TOKENIZER), encoding="utf-8").read())
    r = random.Random(5)
    rows = ["".join(r.choices(PARTS, k=r.randint(0, 40))) for _ in range(5000)]
    assert [counter.tokens(x) for x in rows] == [len(e.ids) for e in library.encode_batch(rows, add_special_tokens=False)]


def test_below_the_bound_pattern_and_library_cut_alike(library):
    counter = tokens.Counter(library.to_str())
    for cp in range(tokens.AGREED):
        text = f"a{chr(cp)} {chr(cp)}1{chr(cp)}a"
        assert list(counter.pieces(text)) == [text[a:b] for _, (a, b) in library.pre_tokenizer.pre_tokenize_str(text)], hex(cp)


def test_a_full_cache_and_long_pieces_change_nothing(library, monkeypatch):
    monkeypatch.setattr(tokens, "KEPT_PIECES", 3)
    monkeypatch.setattr(tokens, "KEPT_LENGTH", 4)
    counter = tokens.Counter(library.to_str())
    for text in ["internationalization of the merging words " * 3, "ab" * 20_000, "x" * 30_001, " " * 5000 + "end", "日" * 3000]:
        assert counter.tokens(text) == len(library.encode(text, add_special_tokens=False).ids)
        assert len(counter.counts) <= 3


def test_rows_of_any_kind(spark, library):
    long = "some long words again " * 60_000
    rows = [(1, "", 0), (2, None, 0), (3, "one <|endoftext|> two", 1), (3, "one <|endoftext|> two", 1), (None, "x", 2), (5, long, 3), (6, "ünï 日本", 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")  # the last name clashes
    got = sorted((str(x.doc_id), x.n_bytes, x.n_tokens, x.over_limit) for x in tokens.count_tokens(docs).collect())
    n = lambda t: len(library.encode(t or "", add_special_tokens=False).ids)
    assert got == sorted((str(i), len((t or "").encode()), n(t), n(t) > 512) for i, t, _ in rows)
    assert tokens.count_tokens(docs.limit(0)).count() == 0


def test_query(spark, library):
    sf = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = tokens.op12_query(spark, sf)
    assert got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"] and [t for _, t in got.dtypes] == ["bigint", "bigint", "bigint", "boolean"]
    for r in got.collect():
        n = len(library.encode(docs[r.doc_id], add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(docs[r.doc_id].encode()), n, n > 512)
