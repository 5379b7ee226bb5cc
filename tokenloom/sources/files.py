"""Readers and writers of texts, results and tokenizer files."""

from __future__ import annotations

import html
import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tokenloom.functions import text as T
from tokenloom.operators.score import latest

QUESTION = "flores_passage string, question string, mc_answer1 string, mc_answer2 string, mc_answer3 string, mc_answer4 string, correct_answer_num string"


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, text) of text files: every line with its number in its file from 0; only \\n ends a line.

    Large files are read in splits by many tasks. The lines of each split are counted first, a few numbers for each;
    a line's number is then that of its split's first line plus its place in the split, which a task reads in order.
    """
    lines = spark.read.text(path, lineSep="\n").select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("begin"), F.monotonically_increasing_id().alias("at"))
    splits = lines.groupBy("path", "begin").agg(F.count("*").alias("n"), F.min("at").alias("least"))
    before = F.sum("n").over(Window.partitionBy("path").orderBy("begin")) - F.col("n") - F.col("least")
    placed = lines.join(splits.select("path", "begin", before.alias("offset")), ["path", "begin"])
    return placed.select("file", (F.col("at") + F.col("offset")).alias("line"), F.col("value").alias("text"))


def parallel_texts(spark: SparkSession, folder: str, split: str = "devtest") -> DataFrame:
    """(lang, sent_id, text) of files <lang>.<split>, one sentence a line; lines with one number are translations."""
    lines = numbered_lines(spark, f"{folder}/*.{split}")
    return lines.select(F.regexp_replace("file", rf"\.{split}$", "").alias("lang"), F.col("line").alias("sent_id"), "text")


def jsonl(spark: SparkSession, path: str, schema: str = "text string") -> DataFrame:
    return spark.read.schema(schema).json(path)


def questions(spark: SparkSession, path: str) -> DataFrame:
    """Multiple-choice questions: passage, question, answers (array) and the number of the right one."""
    rows = jsonl(spark, path, QUESTION)
    return rows.select(F.col("flores_passage").alias("passage"), "question", F.array(*(f"mc_answer{i}" for i in range(1, 5))).alias("answers"), F.col("correct_answer_num").cast("int").alias("answer"))


def results(spark: SparkSession, path: str, schema: str, key: list[str], order: str | None = None) -> DataFrame:
    """Result rows; of those with equal keys the last counts: by `order`, a column of the rows, else by file name and line."""
    rows = spark.read.schema(schema).json(path)
    if order is not None:
        return latest(rows, key, F.col(order))
    # a split is read in order by one task, so an ascending number tells the lines of a split apart
    place = F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id())
    return latest(rows.select("*", place.alias("__at")), key, F.col("__at")).drop("__at")


def write_jsonl(docs: DataFrame, path: str) -> DataFrame:
    """Writes documents' texts as JSON lines and their totals beside them, which it returns."""
    docs.select("text").write.json(f"{path}/documents")
    info = docs.agg(F.count("*").alias("documents"), F.sum(T.octets(F.col("text"))).alias("bytes"))
    info.write.json(f"{path}/info")
    return docs.sparkSession.read.schema(info.schema).json(f"{path}/info")


def write_results(rows: DataFrame, path: str, *others: DataFrame) -> None:
    """Writes result rows as JSON and as CSV with one header.

    Rows of other tables, with other columns, go to the same files: a column that a table lacks is null in its
    rows, and columns stand in the order in which they first appear.
    """
    for more in others:
        rows = rows.unionByName(more, allowMissingColumns=True)
    rows.write.json(f"{path}/json")
    rows.write.csv(f"{path}/csv", header=True)


def append_log(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def write_tokenizer(config: dict, path: str) -> None:
    """A tokenizer configuration as a file on the driver."""
    with open(path, "w", encoding="utf-8") as file:
        json.dump(config, file, ensure_ascii=False)


def segments_page(rows: list[tuple[str, int, list]]) -> str:
    """An HTML page of (caption, tokens, segments): a box for each segment, marked where it has more tokens than letters."""
    out = ["<!doctype html><meta charset=utf-8><style>p{display:flex;flex-wrap:wrap;gap:3px}span{padding:2px 5px;background:#e8f1fd}.x{background:#fde2dd;outline:1px solid #d4553f}</style>"]
    for caption, tokens, parts in rows:
        boxes = "".join(f'<span class="{"x" if s["tokens"] > max(s["letters"], 1) else "w"}">{html.escape(s["chunk"])}{f"<sup>{s["tokens"]}</sup>" if s["tokens"] > max(s["letters"], 1) else ""}</span>' for s in parts)
        out.append(f"<h2>{html.escape(caption)}: {tokens} tokens</h2><p>{boxes}</p>")
    return "\n".join(out)
