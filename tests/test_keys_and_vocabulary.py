import public_tokenizers
import pytest

from tessera.functions.chunking import chunk_text
from tessera.functions.token_costs import vocabulary_cost
from tessera.operators import indexing as D
from tessera.sources.sales import discover_keys


def test_keys_are_found_without_declarations(spark):
    n = 5000
    wide = spark.range(n).selectExpr("id", "id % 4999 AS nearly", "CASE WHEN id <> 7 THEN id END AS hole", "cast(id as string) AS text",
                                     "id % 10 AS few", "NULL AS nothing")
    small = spark.createDataFrame([("a", 1), ("a", 2)], "x string, y int")
    got = {(r.table_name, r.column_name): (r.is_key, r.nulls, r.row_count) for r in discover_keys(
        {"wide": wide, "small": small, "none": small.filter("false")}).collect()}
    assert got == {("wide", "id"): (True, 0, n), ("wide", "nearly"): (False, 0, n), ("wide", "hole"): (False, 1, n),
                   ("wide", "text"): (True, 0, n), ("wide", "few"): (False, 0, n), ("wide", "nothing"): (False, n, n),
                   ("small", "x"): (False, 0, 2), ("small", "y"): (True, 0, 2), ("none", "x"): (False, 0, 0), ("none", "y"): (False, 0, 0)}


@pytest.mark.parametrize("max_tokens", [3, 40])
def test_vocabulary_costs_equal_the_tokenizer(spark, max_tokens):
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tok.encode_special_tokens = True
    counter = vocabulary_cost(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    texts = ["antidisestablishmentarianism is one word", "naïve 日本語 <|endoftext|> 1234567", "  a\n b ", "", None] + ["to be or not " * 30]

    def brute(words):
        return [len(tok.encode(w + " ", add_special_tokens=False).ids) for w in words]
    docs = spark.createDataFrame([(f"k{i}", t) for i, t in enumerate(texts)], "key string, text string")
    got = sorted((r.key, r.chunk_no, r.chunk) for r in D.chunk_documents(docs, max_tokens, counter).collect())
    assert got == sorted((f"k{i}", n + 1, c) for i, t in enumerate(texts) for n, c in enumerate(chunk_text(t, max_tokens, brute) or []))
