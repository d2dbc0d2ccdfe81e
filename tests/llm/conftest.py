import pytest
from pyspark.sql import functions as F

#: Null, empty, short, repeated, tied and odd texts.
TEXTS = [
    None, "", " ", "\n\n", "a", "a b", "one two three", "one two three", "ONE  two\tthree", "x " * 50, "é漢字 ▁ <0x0A> 😀\r\n tail  ", "word\x1cother\x85more　end", "<|endoftext|> in <|im_end|> text",
    "the quick brown fox jumps over the lazy dog " * 9, "the quick brown fox jumps over the lazy dog " * 9,
]


@pytest.fixture(scope="session")
def odd(spark):
    """Odd texts with repeated and null ids, and columns whose names operators use too."""
    rows = [(None if i == 4 else 3 if i in (6, 7) else i, x) for i, x in enumerate(TEXTS)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    clashes = ("n_tokens", "score", "kept", "leaks", "ids", "fp", "component_id", "shard", "size", "root", "_0", "words", "row", "key")
    return df.select("doc_id", "text", F.lit("en").alias("lang"), F.lit(None).cast("string").alias("source"), F.length("text").cast("long").alias("n_chars"), *(F.lit("mine").alias(c) for c in clashes))


@pytest.fixture(scope="session")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")
