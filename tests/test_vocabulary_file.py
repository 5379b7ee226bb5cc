"""A published vocabulary replayed by this library against the library it was made for."""

import json

import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tokenloom.operators import measure
from tokenloom.sources.tokenizers import Merges


def test_tokens_of_whole_documents(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    with open(path, encoding="utf-8") as file:
        own = Merges.from_config("own", json.load(file), public_tokenizers.PATTERN)
    library = Tokenizer.from_file(path)
    rows = [(r["text"],) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").limit(60).collect()]
    rows += [("",), ("é ê\r\n  x  y\t\tz 12345 क्षत्रिय 😀😀",), (" " * 9,), (None,)]
    docs = spark.createDataFrame(rows, "text string")
    found = docs.select("text", own.cuts(F.col("text"))[1].alias("n")).collect()
    for r in found:
        if r["text"] is None:
            assert r["n"] is None
            continue
        alphabet = library.encode(r["text"], add_special_tokens=False).tokens  # one character for each byte
        assert r["n"] == [len(t) for t in alphabet], ascii(r["text"])[:80]
    counted = measure.text_counts(docs, own).where("text = ''").first()
    assert (counted["tokens"], counted["letters"], counted["exact"]) == (0, 0, 1)
