"""Odd rows through the stages of the pipeline, and texts of more than 100,000 characters through every operator over texts."""

import hashlib
import random

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tokenloom.llm import quality_rules, spot_signatures
from tokenloom.llm.bpe import encode_documents
from tokenloom.llm.jaccard_join import JaccardJoin
from tokenloom.llm.packing import token_lengths
from tokenloom.llm.quality_classifier import score_quality
from tokenloom.llm.token_store import token_store
from tokenloom.llm.toxicity import score_toxicity

SF = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("word_bpe_49k.json")
rng = random.Random(5)
LONG = " ".join(rng.choices("the old house by the river was sold when eleven people came to see it again in spring".split(), k=32_000)) + ".\n"


@pytest.fixture(scope="module")
def docs(spark):
    """Documents with null, empty, blank, very long and repeated rows, null ids, and columns that operators use names of."""
    rows = [(9001, None), (9002, ""), (9003, " \t\n"), (9004, LONG), (9005, LONG), (9006, "Twice."), (9006, "Twice."), (None, "No id here."), (None, "No id here."), (None, None), (9007, "é" * 120_000)]
    odd = spark.createDataFrame([(i, t, "en", "odd", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    usual = spark.read.parquet(f"{SF}/documents.parquet").select(odd.columns[0], "text", "lang", "source", F.col("n_chars").cast("long"))
    return usual.limit(120).unionByName(odd).selectExpr("*", "1 as x", "2 as m", "3 as place", "'a' as text_of", "4 as h", "5 as n", "6 as found")


def test_stages_on_odd_rows(spark, docs):
    n = docs.count()
    texts = {r["text"] for r in docs.select("text").collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, SF).collect()
        assert kept and len(kept) <= n and {*kept[0].asDict()} == {*docs.columns}, name
        assert {r["text"] for r in kept} <= texts and all(r["x"] == 1 and r["text_of"] == "a" for r in kept)
        if name != "near_copies":  # equal texts share their fate
            assert sum(r["text"] == LONG for r in kept) in (0, 2) and sum(r["text"] == "Twice." for r in kept) in (0, 2)
        else:
            assert sum(r["text"] == LONG for r in kept) == 1
    name, last = corpus_pipeline.STAGES[-1]
    packed = last(spark, docs, SF).collect()
    assert len(packed) == n and len({(r["bucket"], r["batch_id"], r["slot"]) for r in packed}) == n


def test_stages_on_no_rows(spark, docs):
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), SF).count() == 0, name


def test_equal_texts_score_alike(spark, docs):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    for score in (score_quality, score_toxicity):
        found = score(docs, labels).collect()
        assert len(found) == docs.count() and all(0 <= r["score"] <= 1 for r in found)
        by_id = {r["doc_id"]: r["score"] for r in found}
        assert by_id[9004] == by_id[9005] and by_id[9001] == by_id[9002]


def test_long_texts(spark):
    rows = [(1, LONG), (2, LONG), (3, "short text"), (4, LONG.upper()), (5, "é" * 120_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("lang", F.lit("en")).withColumn("source", F.lit("s"))
    words = len(LONG.split())
    judged = {r["doc_id"]: r for r in quality_rules.apply_rules(docs).collect()}
    assert judged[1]["n_words"] == words and judged[5]["word_chars"] == 120_000
    own = Tokenizer.from_file(PATH)
    n = {i: len(own.encode(t, add_special_tokens=False).ids) for i, t in rows}
    assert {r["doc_id"]: r["n_tokens"] for r in token_lengths(docs, PATH).collect()} == n
    assert {r["doc_id"]: r["n_tokens"] for r in token_store(docs, PATH, 2).collect()} == {i: k + 1 for i, k in n.items()}
    encoded = {r["doc_id"]: r for r in encode_documents(docs, PATH).collect()}
    for i, t in rows:
        ids = own.encode(t, add_special_tokens=False).ids
        assert encoded[i]["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert encoded[i]["decoded_sha256"] == hashlib.sha256(own.decode(ids, skip_special_tokens=False).encode()).hexdigest()
    classes = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in JaccardJoin(docs, width=4, percent=85).classes().collect()}
    low = LONG.lower().split()
    assert classes[1] == classes[2] == classes[4] == (len({tuple(low[i : i + 4]) for i in range(len(low) - 3)}), 1) and classes[3] == (1, 3) and classes[5] == (1, 5)
    spots = {r["doc_id"]: r for r in spot_signatures.compare_with_next(docs).collect()}
    assert spots[1]["fingerprint"] == spots[2]["fingerprint"] and spots[1]["n_chars"] == len(LONG) and spots[1]["near_next"] == 1
