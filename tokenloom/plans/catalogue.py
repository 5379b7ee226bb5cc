"""The queries of the reference's operators over the driver's tables, each with DuckDB SQL where SQL expresses it.

`documents` is not parallel text, so ratios between its languages show the formulas and are no like-for-like
comparison of tokenizers.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from importlib.util import find_spec

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tokenloom.functions import graphemes
from tokenloom.functions import text as T
from tokenloom.functions.bytelevel import ALPHABET
from tokenloom.functions.letters import letters
from tokenloom.functions.rounding import rounded
from tokenloom.operators import corpus, measure, score, vocabulary
from tokenloom.operators.staged import staged
from tokenloom.session import ship
from tokenloom.sources import dims
from tokenloom.sources.tokenizers import Characters, FixedCut, Merges, PreTokens

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: Merges that the learner's queries make.
MERGES = 6
#: Bytes of a token of the fixed-cut tokenizer; 2 and 3 byte characters get cut.
CUT = 3
CONTEXT = 32_768
CAPS = {"fr": 200_000, "en": 800_000}
SEQ = 2_048
#: Weights of languages, as speakers in millions. Illustrative.
WEIGHTS = {"en": 0.0, "fr": 80.0, "de": 95.0, "es": 480.0}
GROUP = 50
#: Stands in the SQL for white space that another character follows; no text holds it.
_MARK = chr(0xE000)


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def _docs(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    return ship(spark).read.parquet(f"{d}/documents.parquet").select(*(columns or ("doc_id", "text", "lang", "source")))


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{d}/{name}.parquet")


# DuckDB has no look-ahead: a mark stands for a white-space character that is followed by another character
_SQL_PATTERN = rf"(?i:'s|'t|'re|'ve|'m|'ll|'d)|{_MARK}?[^\r\n\p{{L}}\p{{N}}{_MARK}]?\p{{L}}+|\p{{N}}|{_MARK}? ?[^\s\p{{L}}\p{{N}}{_MARK}]+[\r\n{_MARK}]*|[\s{_MARK}]*[\r\n]+|{_MARK}?\s+".replace("'", "''")
_SQL_PIECES = rf"list_transform(regexp_extract_all(regexp_replace(text, '(\s)([^\s])', '{_MARK}\1\2', 'g'), '{_SQL_PATTERN}'), lambda p: replace(p, '{_MARK}', ''))"
_SQL_FLOOR = rf"len(regexp_extract_all(regexp_replace(text, '(\s)([^\s])', '{_MARK}\1\2', 'g'), '{_SQL_PATTERN}'))"
_SQL_WORDS = r"len(list_filter(string_split_regex(text, '[\s\x1c-\x1f]+'), lambda w: w <> ''))"
_SQL_BYTES = "octet_length(encode(text))"


@query(f"""SELECT lang, count(*) AS docs, CAST(sum(length(text)) AS BIGINT) AS chars, CAST(sum({_SQL_BYTES}) AS BIGINT) AS bytes,
  CAST(sum({_SQL_WORDS}) AS BIGINT) AS words, CAST(sum({_SQL_FLOOR}) AS BIGINT) AS floor FROM documents GROUP BY lang""")
def text_counts_by_lang(spark, d):
    """Characters, bytes, words and pre-tokenizer pieces of each language: one scan, one aggregate."""
    text = F.col("text")
    counts = _docs(spark, d, "text", "lang").select("lang", T.chars(text).alias("chars"), T.octets(text).alias("bytes"), T.words(text).alias("words"), T.floor(text).alias("floor"))
    return counts.groupBy("lang").agg(F.count("*").alias("docs"), *(F.sum(c).alias(c) for c in ("chars", "bytes", "words", "floor")))


@query(f"""WITH s AS (SELECT lang, CAST(sum({_SQL_FLOOR}) AS BIGINT) AS floor, CAST(sum({_SQL_BYTES}) AS BIGINT) AS tokens FROM documents GROUP BY lang)
SELECT lang, floor, tokens, floor / (SELECT tokens FROM s WHERE lang = 'en') AS floor_tax, floor / (SELECT floor FROM s WHERE lang = 'en') AS floor_ratio FROM s""")
def floor_tax(spark, d):
    """The floor over the baseline's byte tokens, and over its floor."""
    text = F.col("text")
    sums = _docs(spark, d, "text", "lang").groupBy("lang").agg(F.sum(T.floor(text)).alias("floor"), F.sum(T.octets(text)).alias("tokens")).withColumn("tokenizer", F.lit("bytes"))
    return sums.select("lang", "floor", "tokens", (F.col("floor") / measure.of_base(F.col("tokens"), "en")).alias("floor_tax"), (F.col("floor") / measure.of_base(F.col("floor"), "en")).alias("floor_ratio"))


# the pattern with U+0B3F inside words, for texts in which that is the only mark
_SQL_MARKED = rf"(?i:'s|'t|'re|'ve|'m|'ll|'d)|{_MARK}?[^\r\n\p{{L}}\x{{0B3F}}\p{{N}}{_MARK}]?[\p{{L}}\x{{0B3F}}]+|\p{{N}}|{_MARK}? ?[^\s\p{{L}}\x{{0B3F}}\p{{N}}{_MARK}]+[\r\n{_MARK}]*|[\s{_MARK}]*[\r\n]+|{_MARK}?\s+".replace("'", "''")


@query(f"""WITH t AS (SELECT lang, regexp_replace(translate(text, 'ae', chr(2837) || chr(2879)), '(\\s)([^\\s])', '{_MARK}\\1\\2', 'g') AS text FROM documents)
SELECT lang, CAST(sum(len(regexp_extract_all(text, '{_SQL_PATTERN}'))) AS BIGINT) AS floor, CAST(sum(len(regexp_extract_all(text, '{_SQL_MARKED}'))) AS BIGINT) AS floor_with_marks FROM t GROUP BY lang""")
def marks_floor_delta(spark, d):
    """Pieces before and after marks are allowed in words, of texts in which an Odia letter and mark stand for a and e."""
    text = F.translate("text", "ae", "\u0b15\u0b3f")
    return _docs(spark, d, "text", "lang").groupBy("lang").agg(F.sum(T.floor(text)).alias("floor"), F.sum(T.floor(text, T.fix_marks(T.PATTERN, T.INDIC_MARKS))).alias("floor_with_marks"))


@query(f"""SELECT lang, CAST(sum(length_grapheme(text)) AS BIGINT) AS letters, CAST(sum({_SQL_FLOOR}) AS BIGINT) AS tokens,
  sum({_SQL_FLOOR}) / sum(length_grapheme(text)) AS tokens_per_letter FROM documents GROUP BY lang""")
def tokens_per_letter(spark, d):
    """Letters (grapheme clusters), and pre-tokenizer tokens for each."""
    text = F.col("text")
    sums = _docs(spark, d, "text", "lang").select("lang", letters(text).alias("letters"), T.floor(text).alias("tokens")).groupBy("lang").agg(F.sum("letters").alias("letters"), F.sum("tokens").alias("tokens"))
    return sums.withColumn("tokens_per_letter", F.try_divide("tokens", "letters"))


_TAX_SQL = "SELECT lang, CAST(sum({t}) AS BIGINT) AS tokens, sum({t}) / (SELECT sum({t}) FROM documents WHERE lang = 'en') AS tax, sum(length(text)) / sum({t}) AS chars_per_token FROM documents GROUP BY lang"


def _plain_tax(spark, d, tokenizer) -> DataFrame:
    text = F.col("text")
    sums = _docs(spark, d, "text", "lang").groupBy("lang").agg(F.sum(tokenizer.tokens(text)).alias("tokens"), F.sum(T.chars(text)).alias("chars")).withColumn("tokenizer", F.lit(tokenizer.key))
    return sums.select("lang", "tokens", (F.col("tokens") / measure.of_base(F.col("tokens"), "en")).alias("tax"), F.try_divide("chars", "tokens").alias("chars_per_token"))


@query(_TAX_SQL.format(t=_SQL_BYTES))
def byte_tokens_tax(spark, d):
    """The tax of a byte tokenizer."""
    return _plain_tax(spark, d, FixedCut(1))


@query(_TAX_SQL.format(t="length(text)"))
def char_tokens_tax(spark, d):
    """The tax of a character tokenizer."""
    return _plain_tax(spark, d, Characters())


@query(f"""WITH p AS (SELECT lang, doc_id, unnest(range(0, {_SQL_BYTES}, {CUT})) AS i, encode(text) AS b FROM documents),
c AS (SELECT lang, CAST(unhex(substr(hex(b), CAST(2 * i + 1 AS BIGINT), {2 * CUT})) AS BLOB) AS piece FROM p)
SELECT lang, count(*) AS tokens, count(*) FILTER (WHERE TRY(decode(piece)) IS NULL) AS fragments FROM c GROUP BY lang""")
def fixed_cut_fragments(spark, d):
    """Tokens of three bytes that are no whole characters."""
    pieces = _docs(spark, d, "text", "lang").select("lang", FixedCut(CUT).pieces(F.col("text")).alias("p"))
    return pieces.groupBy("lang").agg(F.sum(F.size("p")).cast("long").alias("tokens"), F.sum(F.size(F.filter("p", lambda x: ~F.is_valid_utf8(x)))).cast("long").alias("fragments"))


# letters are characters with their marks here, which is all that the rules ask of texts without conjuncts, flags and the like
_MEASURES_SQL = rf"""t AS (SELECT row_number() OVER () AS k, lang, text, {_SQL_BYTES} AS bytes, {_SQL_PIECES} AS pieces FROM documents),
l0 AS (SELECT k, unnest(ls) AS l, generate_subscripts(ls, 1) AS i FROM (SELECT k, regexp_extract_all(text, '\r\n|(?s:.)\p{{M}}*') AS ls FROM t)),
l AS (SELECT k, length(l) AS chars, octet_length(encode(l)) AS own, CAST(sum(octet_length(encode(l))) OVER (PARTITION BY k ORDER BY i) AS BIGINT) AS upto FROM l0),
h0 AS (SELECT k, unnest(cs) AS c, generate_subscripts(cs, 1) AS i FROM (SELECT k, string_split(text, '') AS cs FROM t)),
h AS (SELECT k, octet_length(encode(c)) AS own, CAST(sum(octet_length(encode(c))) OVER (PARTITION BY k ORDER BY i) AS BIGINT) AS upto FROM h0),
p0 AS (SELECT k, unnest(pieces) AS p, generate_subscripts(pieces, 1) AS i FROM t),
p AS (SELECT k, CAST(sum(octet_length(encode(p))) OVER (PARTITION BY k ORDER BY i) AS BIGINT) AS upto FROM p0),
z AS (SELECT unnest([1, {CUT}]) AS z),
cuts AS (SELECT k, z, unnest(range((upto - own) // z * z + z, upto, z)) AS x FROM h, z WHERE own > 1),
parts AS (SELECT k, 'bytes' || z AS tokenizer, count(DISTINCT x) AS fragments FROM (SELECT k, z, x FROM cuts UNION ALL SELECT k, z, x - z FROM cuts) GROUP BY ALL),
broken AS (SELECT k, 'bytes' || z AS tokenizer, count(*) AS broken FROM l, z WHERE (upto - 1) // z * z > upto - own GROUP BY ALL
  UNION ALL SELECT k, 'chars', count(*) FROM l WHERE chars > 1 GROUP BY ALL
  UNION ALL SELECT k, 'pretokens', count(*) FROM l WHERE chars > 1 AND EXISTS (SELECT 1 FROM p WHERE p.k = l.k AND p.upto > l.upto - l.own AND p.upto < l.upto) GROUP BY ALL),
each AS (SELECT k, lang, text, bytes, unnest([{{'tokenizer': 'bytes1', 'n': bytes}}, {{'tokenizer': 'bytes{CUT}', 'n': (bytes + {CUT - 1}) // {CUT}}}, {{'tokenizer': 'chars', 'n': length(text)}}, {{'tokenizer': 'pretokens', 'n': len(pieces)}}], recursive := true) FROM t),
s AS (SELECT tokenizer, lang, count(*) AS sentences, CAST(sum(n) AS BIGINT) AS tokens, CAST(sum(length_grapheme(text)) AS BIGINT) AS letters, CAST(sum(length(text)) AS BIGINT) AS chars, CAST(sum(bytes) AS BIGINT) AS bytes,
  CAST(sum({_SQL_WORDS}) AS BIGINT) AS words, CAST(0 AS BIGINT) AS unk, CAST(sum(CASE WHEN tokenizer = 'pretokens' THEN n END) AS BIGINT) AS floor, count(*) AS exact, CAST(sum(n) AS BIGINT) AS exact_tokens,
  CAST(sum(length_grapheme(text)) AS BIGINT) AS exact_letters, CAST(sum(coalesce(fragments, 0)) AS BIGINT) AS fragments, CAST(sum(coalesce(broken, 0)) AS BIGINT) AS broken
  FROM each LEFT JOIN parts USING (k, tokenizer) LEFT JOIN broken USING (k, tokenizer) GROUP BY tokenizer, lang)"""


@query(f"""WITH {_MEASURES_SQL}, e AS (SELECT *, max(CASE WHEN lang = 'en' THEN tokens END) OVER (PARTITION BY tokenizer) AS t, max(CASE WHEN lang = 'en' THEN floor END) OVER (PARTITION BY tokenizer) AS f FROM s)
SELECT * EXCLUDE (t, f), tokens / t AS tax, tokens / letters AS tokens_per_letter, chars / tokens AS chars_per_token, floor / t AS floor_tax, floor / f AS floor_ratio, broken / exact_letters AS broken_letters, fragments / exact_tokens AS byte_fragments FROM e""")
def fixed_cut_measures(spark, d):
    """Every measure of the three-byte, byte, character and pre-token tokenizers, with ratios to English."""
    counted = measure.text_counts(_docs(spark, d, "text", "lang"), FixedCut(CUT), FixedCut(1), Characters(), PreTokens())
    return measure.tax(measure.corpus_counts(counted), "en")


_TAXED = {"bytes1": _SQL_BYTES, f"bytes{CUT}": f"({_SQL_BYTES} + {CUT - 1}) // {CUT}", "chars": "length(text)"}


@query(f"""WITH c AS (SELECT lang, unnest([{', '.join(f"{{'tokenizer': '{k}', 'n': CAST({v} AS BIGINT)}}" for k, v in _TAXED.items())}]) AS x,
    length_grapheme(text) AS letters, length(text) AS chars, {_SQL_BYTES} AS bytes, {_SQL_WORDS} AS words, text FROM documents),
s AS (SELECT x.tokenizer AS tokenizer, lang, count(*) AS sentences, CAST(sum(x.n) AS BIGINT) AS tokens, CAST(sum(letters) AS BIGINT) AS letters, CAST(sum(chars) AS BIGINT) AS chars,
    CAST(sum(bytes) AS BIGINT) AS bytes, CAST(sum(words) AS BIGINT) AS words, count(text) AS exact, CAST(sum(x.n) AS BIGINT) AS exact_tokens, CAST(sum(letters) AS BIGINT) AS exact_letters FROM c GROUP BY ALL)
SELECT *, tokens / max(CASE WHEN lang = 'en' THEN tokens END) OVER (PARTITION BY tokenizer) AS tax, tokens / letters AS tokens_per_letter, chars / tokens AS chars_per_token FROM s""")
def corpus_tax(spark, d):
    """Sums of the counts of three tokenizers by language, and their ratios to English."""
    counted = measure.text_counts(_docs(spark, d, "text", "lang"), FixedCut(1), FixedCut(CUT), Characters())
    columns = ("tokenizer", "lang", "sentences", "tokens", "letters", "chars", "bytes", "words", "exact", "exact_tokens", "exact_letters", "tax", "tokens_per_letter", "chars_per_token")
    return measure.tax(measure.corpus_counts(counted), "en").select(*columns)


def _byte_vocabulary() -> Merges:
    """A published byte-level vocabulary, under this library's pre-tokenizer."""
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as file:
        return Merges.from_config("bytes_50k", json.load(file))


# each different piece is merged at its lowest rank until no pair is left
_ALPHABET_SQL = ", ".join(f"({ord(c)}, '{b:02X}')" for b, c in enumerate(ALPHABET))
_VOCABULARY_SQL = f"""RECURSIVE a(c, h) AS (VALUES {_ALPHABET_SQL}),
j AS (SELECT unnest(merges) AS m, generate_subscripts(merges, 1) AS rank FROM (SELECT model.merges AS merges FROM read_json('{{path}}', columns = {{{{'model': 'STRUCT(merges VARCHAR[][])'}}}}, maximum_object_size = 100000000))),
s AS (SELECT rank, unnest([1, 2]) AS side, unnest(m) AS t FROM j),
x AS (SELECT rank, side, string_agg(h, '' ORDER BY i) AS t FROM (SELECT rank, side, unnest(string_split(t, '')) AS ch, unnest(range(len(t))) AS i FROM s) JOIN a ON a.c = ord(ch) GROUP BY ALL),
m AS (SELECT l.t AS l, r.t AS r, min(l.rank) AS rank FROM x l JOIN x r ON l.rank = r.rank AND l.side = 1 AND r.side = 2 GROUP BY ALL),
w AS (SELECT DISTINCT unnest({_SQL_PIECES}) AS piece FROM documents),
e AS (SELECT piece, regexp_replace(hex(encode(piece)), '(..)', '<\\1>', 'g') AS s FROM w
  UNION ALL SELECT piece, replace(any_value(s), '<' || arg_min(l, rank) || '><' || arg_min(r, rank) || '>', '<' || arg_min(l, rank) || arg_min(r, rank) || '>') FROM (
    SELECT piece, s, m.l, m.r, m.rank FROM (SELECT piece, s, unnest(list_slice(string_split(s[2:-2], '><'), 1, -2)) AS l, unnest(list_slice(string_split(s[2:-2], '><'), 2, -1)) AS r FROM e) q JOIN m ON m.l = q.l AND m.r = q.r) GROUP BY piece),
t AS (SELECT piece, min(len(string_split(s[2:-2], '><'))) AS n, arg_min(s, len(string_split(s[2:-2], '><'))) AS s FROM e GROUP BY piece)"""


def _vocabulary_sql() -> str:
    import public_tokenizers

    head = _VOCABULARY_SQL.replace("{path}", public_tokenizers.path("byte_bpe_50k.json")).replace("{{", "{").replace("}}", "}")
    return f"""WITH {head}, p AS (SELECT lang, unnest({_SQL_PIECES}) AS piece FROM documents),
c AS (SELECT lang, CAST(sum(n) AS BIGINT) AS tokens, CAST(sum(len(regexp_extract_all(regexp_replace(s, '([0-9A-F][0-9A-F])', '\\1.', 'g'), '[C-F][0-9A-F]\\.(?:[89AB][0-9A-F]\\.)*><[89AB]'))) AS BIGINT) AS broken FROM p JOIN t USING (piece) GROUP BY lang),
d AS (SELECT lang, CAST(sum(length_grapheme(text)) AS BIGINT) AS letters, CAST(sum({_SQL_FLOOR}) AS BIGINT) AS floor FROM documents GROUP BY lang)
SELECT 'bytes_50k' AS tokenizer, lang, tokens, letters, floor, tokens AS exact_tokens, broken, tokens / max(CASE WHEN lang = 'en' THEN tokens END) OVER () AS tax FROM c JOIN d USING (lang)"""


@query(_vocabulary_sql() if find_spec("public_tokenizers") else None)
def vocabulary_tax(spark, d):
    """Tokens, letters that tokens break, and ratios to English under a published byte-level vocabulary of 50,257 tokens."""
    sums = measure.corpus_counts(measure.text_counts(_docs(spark, d, "text", "lang"), _byte_vocabulary()))
    return measure.tax(sums, "en").select("tokenizer", "lang", "tokens", "letters", "floor", "exact_tokens", "broken", "tax")


@query(rf"""WITH t AS (SELECT item_id, row_number() OVER () AS k, regexp_extract_all(text, '\r\n|(?s:.)\p{{M}}*') AS ls, {_SQL_BYTES} AS n FROM benchmark),
l0 AS (SELECT item_id, k, n, unnest(ls) AS l, generate_subscripts(ls, 1) AS i FROM t),
l AS (SELECT *, CAST(sum(octet_length(encode(l))) OVER (PARTITION BY k ORDER BY i) AS BIGINT) AS upto FROM l0),
e AS (SELECT *, CASE WHEN upto % {CUT} = 0 OR upto = n THEN 1 ELSE 0 END AS shared FROM l),
c AS (SELECT *, sum(shared) OVER (PARTITION BY k ORDER BY i) - shared AS place FROM e),
s AS (SELECT item_id, k, CAST(place AS INTEGER) AS place, string_agg(l, '' ORDER BY i) AS chunk, CAST((sum(octet_length(encode(l))) + {CUT - 1}) // {CUT} AS INTEGER) AS tokens, CAST(count(*) AS INTEGER) AS letters FROM c GROUP BY ALL)
SELECT item_id, place, chunk, tokens, letters, tokens > greatest(letters, 1) AS overcut FROM s""")
def segments_exploded(spark, d):
    """Segments of the benchmark texts under three-byte tokens, flagged where tokens outnumber letters."""
    texts = _table(spark, d, "benchmark").select("item_id", "text").withColumn("s", graphemes.segments("text", FixedCut(CUT).pieces(F.col("text"))))
    return texts.select("item_id", F.posexplode("s").alias("place", "s")).select("item_id", "place", "s.chunk", "s.tokens", "s.letters", T.overcut(F.col("s.tokens"), F.col("s.letters")).alias("overcut"))


@query(f"SELECT piece, count(*) AS n FROM (SELECT unnest({_SQL_PIECES}) AS piece FROM documents) GROUP BY piece ORDER BY n DESC, piece LIMIT 50")
def piece_counts_topk(spark, d):
    """The fifty most frequent pieces."""
    return measure.distinct_piece_counts(_docs(spark, d, "text"), ()).orderBy(F.desc("n"), "piece").limit(50)


@query(f"""SELECT lang, count(DISTINCT piece) AS pieces, count(*) AS n, CAST(sum(ceil(octet_length(encode(piece)) / {CUT})) AS BIGINT) AS tokens
FROM (SELECT lang, unnest({_SQL_PIECES}) AS piece FROM documents) GROUP BY lang""")
def distinct_piece_tax(spark, d):
    """Tokens measured once for each distinct piece and summed by how often it occurs."""
    counts = measure.distinct_piece_counts(_docs(spark, d, "text", "lang"))
    return counts.groupBy("lang").agg(F.count("*").alias("pieces"), F.sum("n").alias("n"), F.sum(F.col("n") * FixedCut(CUT).tokens(F.col("piece"))).alias("tokens"))


_LATIN = "[A-Za-zÀ-ɏ]"


@query(f"""SELECT lang, CAST(sum(length(regexp_replace(text, '[^A-Za-zÀ-ɏ]', '', 'g'))) AS BIGINT) AS latin, CAST(sum(length(regexp_replace(text, '[^\\p{{L}}]', '', 'g'))) AS BIGINT) AS letters,
  count(*) FILTER (WHERE regexp_matches(text, '[଀-୿]')) AS odia_docs FROM documents GROUP BY lang""")
def script_share(spark, d):
    """Letters of the Latin script among all letters."""
    text = F.col("text")
    return _docs(spark, d, "text", "lang").groupBy("lang").agg(F.sum(T.script_letters(text, "latin")).alias("latin"), F.sum(T.alphabetic(text)).alias("letters"), F.count_if(T.in_script(text, "odia")).alias("odia_docs"))


@query("""SELECT role, count(*) AS outputs, count(*) FILTER (WHERE 2 * length(regexp_replace(text, '[^A-Za-zÀ-ɏ]', '', 'g')) > greatest(1, length(regexp_replace(text, '[^\\p{L}]', '', 'g')))) AS in_script
FROM conversations GROUP BY role""")
def target_script_outputs(spark, d):
    """Outputs that are mostly in the target script."""
    return _table(spark, d, "conversations").groupBy("role").agg(F.count("*").alias("outputs"), F.count_if(T.mostly_in_script(F.col("text"), "latin")).alias("in_script"))


_WEIGHTS_SQL = ", ".join(f"('{k}', {w})" for k, w in WEIGHTS.items())


@query(f"""WITH t AS (SELECT lang, sum({_SQL_FLOOR}) AS tokens FROM documents GROUP BY lang), w(lang, w) AS (VALUES {_WEIGHTS_SQL}),
x AS (SELECT lang, tokens / (SELECT tokens FROM t WHERE lang = 'en') AS tax FROM t)
SELECT sum(tax * CAST(w AS DOUBLE)) / sum(CAST(w AS DOUBLE)) AS weighted_tax FROM x JOIN w USING (lang)""")
def weighted_tax(spark, d):
    """The mean tax weighted by speakers."""
    sums = _docs(spark, d, "text", "lang").groupBy("lang").agg(F.sum(T.floor(F.col("text"))).alias("tokens")).withColumn("tokenizer", F.lit("pretokens"))
    taxes = sums.withColumn("tax", F.col("tokens") / measure.of_base(F.col("tokens"), "en"))
    speakers = spark.createDataFrame([*WEIGHTS.items()], "code string, speakers double")
    return measure.speaker_weighted(taxes, speakers).select("weighted_tax")


def _values(rows: list[tuple], columns: str) -> str:
    """SQL for rows of fixed values; columns as in a schema."""
    literal = lambda v: "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)
    names, kinds = zip(*(c.split() for c in columns.split(", ")))
    return f"SELECT {', '.join(f'CAST({n} AS {k.upper()}) AS {n}' for n, k in zip(names, kinds))} FROM (VALUES {', '.join('(' + ', '.join(map(literal, r)) + ')' for r in rows)}) AS t({', '.join(names)})"


@query(_values(dims.LANGUAGES, dims.LANGUAGE_COLUMNS))
def language_dimension(spark, d):
    """The languages and their speakers."""
    return dims.languages(spark)


@query(_values(dims.SPECS, dims.SPEC_COLUMNS))
def tokenizer_dimension(spark, d):
    """Public tokenizers."""
    return dims.specs(spark)


@query("SELECT lang, " + ", ".join(f"count(*) FILTER (WHERE source = 'src{i}') AS src{i}" for i in range(20)) + " FROM documents GROUP BY lang")
def pivot_source_by_lang(spark, d):
    """Documents by language and source, as a cross table."""
    return _docs(spark, d, "lang", "source").groupBy("lang").pivot("source", [f"src{i}" for i in range(20)]).agg(F.count(F.lit(1))).na.fill(0)


@query("SELECT d.doc_id, d.lang, l.quality FROM documents d JOIN labels l USING (doc_id) WHERE l.quality >= 1")
def quality_filter(spark, d):
    """Documents whose score reaches a minimum."""
    return _docs(spark, d, "doc_id", "lang").join(_table(spark, d, "labels").where("quality >= 1").select("doc_id", "quality"), "doc_id")


_OVERLAP = "EXISTS (SELECT 1 FROM benchmark b WHERE length(b.text) >= 30 AND contains(d.text, b.text))"


@query(f"SELECT doc_id, lang FROM documents d WHERE NOT {_OVERLAP}")
def decontaminate(spark, d):
    """Documents that hold no evaluation text."""
    return corpus.decontaminate(_docs(spark, d, "doc_id", "lang", "text"), _table(spark, d, "benchmark")).select("doc_id", "lang")


@query(f"""SELECT lang, count(*) FILTER (WHERE NOT o) AS documents, count(*) FILTER (WHERE o) AS dropped, CAST(coalesce(sum({_SQL_BYTES}) FILTER (WHERE NOT o), 0) AS BIGINT) AS bytes
FROM (SELECT *, {_OVERLAP} AS o FROM documents d) GROUP BY lang""")
def decontaminated_counts(spark, d):
    """Documents kept and dropped for overlap, and bytes kept."""
    found = corpus.contains_any(_docs(spark, d, "lang", "text"), _table(spark, d, "benchmark"))
    size = T.octets(F.col("text"))
    return found.groupBy("lang").agg(F.count_if(~F.col("overlap")).alias("documents"), F.count_if("overlap").alias("dropped"), F.coalesce(F.sum(F.when(~F.col("overlap"), size)), F.lit(0)).cast("long").alias("bytes"))


_GRP = f"doc_id // {GROUP}"


@query(f"SELECT doc_id, lang FROM documents WHERE {_GRP} % 4 = 0 AND {_GRP} // 4 < 3")
def stride_sample_train(spark, d):
    """Three groups of documents, every fourth one."""
    return corpus.stride_sample(_docs(spark, d, "doc_id", "lang"), "doc_id", GROUP, 3, 4)


@query(f"SELECT doc_id, lang FROM documents WHERE {_GRP} >= 2 AND ({_GRP} - 2) % 4 = 0 AND ({_GRP} - 2) // 4 < 3")
def stride_sample_holdout(spark, d):
    """Three held-out groups, half a stride later."""
    return corpus.stride_sample(_docs(spark, d, "doc_id", "lang"), "doc_id", GROUP, 3, 4, holdout=True)


def _spread_sql(n: str) -> str:
    return f"""v AS (SELECT level, unnest(range(0, 1 << level)) AS i FROM (SELECT unnest(range(0, 12)) AS level)),
s AS (SELECT (2 * i + 1) * {n} // (2 << level) AS grp, min(level * 1000000 + i) AS place FROM v WHERE (2 * i + 1) * {n} // (2 << level) < {n} GROUP BY 1),
o AS (SELECT row_number() OVER (ORDER BY place) - 1 AS ord, grp FROM s)"""


@query(f"WITH {_spread_sql('100')} SELECT ord, CAST(grp AS BIGINT) AS grp FROM o")
def spread_order(spark, d):
    """0 to 99 in an order of which every prefix is spread out."""
    return corpus.spread_order(spark, 100)


_N_GROUPS = f"(SELECT max(doc_id) // {GROUP} + 1 FROM documents)"


_BUDGET_SQL = """WITH {spread}, z AS (SELECT {grp} AS grp, sum({size}) AS size FROM {docs} GROUP BY 1),
r AS (SELECT o.grp, ord, sum(coalesce(size, 0)) OVER (ORDER BY ord) - coalesce(size, 0) AS before FROM o LEFT JOIN z ON o.grp = z.grp)
SELECT doc_id, CAST(r.grp AS BIGINT) AS grp, ord FROM {docs} d JOIN r ON {grp} = r.grp WHERE before < 1000000"""


@query(_BUDGET_SQL.format(spread=_spread_sql(_N_GROUPS), grp=_GRP, size=_SQL_BYTES, docs="documents"))
def byte_budget_sample(spark, d):
    """Whole groups in spread order up to a million bytes."""
    return corpus.byte_budget_sample(_docs(spark, d, "doc_id", "text"), "doc_id", GROUP, 1_000_000).select("doc_id", "grp", "ord")


@query(_BUDGET_SQL.format(spread=_spread_sql(_N_GROUPS), grp=_GRP, size=_SQL_BYTES, docs=f"(SELECT * FROM documents d WHERE NOT {_OVERLAP})"))
def clean_budget_sample(spark, d):
    """Whole groups in spread order up to a million bytes of documents that hold no evaluation text; only groups that are read are searched."""
    banned = _table(spark, d, "benchmark")
    return corpus.byte_budget_sample(_docs(spark, d, "doc_id", "text"), "doc_id", GROUP, 1_000_000, lambda docs: corpus.decontaminate(docs, banned)).select("doc_id", "grp", "ord")


@query("""WITH RECURSIVE n AS (SELECT count(*) AS n, CAST(greatest(1, ceil(log2(count(*)) / 2)) AS INTEGER) AS half FROM documents),
i AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS i FROM documents),
f AS (SELECT doc_id, n, half, i >> half AS l, i & ((1 << half) - 1) AS r, 0 AS round FROM i, n
  UNION ALL SELECT doc_id, n, half, r, xor(l, ((r * 2654435769 + 40503 * (round % 6 + 1) + 7000021) >> 7) & ((1 << half) - 1)), round + 1 FROM f WHERE round = 0 OR round % 6 <> 0 OR ((l << half) | r) >= n)
SELECT doc_id, arg_max((l << half) | r, round) AS place FROM f GROUP BY doc_id""")
def seeded_shuffle(spark, d):
    """Every document's place in a repeatable shuffle with seed 7, computed from its number alone."""
    numbered = corpus.numbered(_docs(spark, d, "doc_id"), "doc_id", "i")
    n = numbered.count()
    return numbered.select("doc_id", corpus.shuffled_place(F.col("i"), n, 7).alias("place"))


@query(f"""WITH n AS (SELECT lang, doc_id, {_SQL_FLOOR} AS n_tokens FROM documents),
r AS (SELECT lang, n_tokens, sum(n_tokens) OVER (PARTITION BY lang ORDER BY doc_id) AS upto FROM n)
SELECT lang, count(*) AS sentences, CAST(sum(n_tokens) AS BIGINT) AS tokens, count(*) FILTER (WHERE upto <= {CONTEXT}) AS fit, count(*) FILTER (WHERE upto <= {CONTEXT}) = count(*) AS fits_all FROM r GROUP BY lang""")
def context_fit(spark, d):
    """Documents of each language that fit into one context together."""
    lengths = _docs(spark, d, "doc_id", "lang", "text").select("doc_id", "lang", T.floor(F.col("text")).alias("n_tokens"))
    return corpus.context_fit(lengths, ["lang"], "doc_id", CONTEXT)


_MIX = f"""c(lang, cap, rank_lang) AS (VALUES {', '.join(f"('{k}', {v}, {i})" for i, (k, v) in enumerate(CAPS.items()))}),
r AS (SELECT doc_id, d.lang, cap, rank_lang, {_SQL_FLOOR} AS n_tokens, sum({_SQL_BYTES}) OVER (PARTITION BY d.lang ORDER BY doc_id) - {_SQL_BYTES} AS bytes_before FROM documents d JOIN c ON d.lang = c.lang),
m AS (SELECT *, row_number() OVER (ORDER BY bytes_before / cap, rank_lang, doc_id) - 1 AS place FROM r WHERE bytes_before < cap)"""


def _mixed(spark, d) -> DataFrame:
    """The mixture without texts, which are read once; later steps read its few numbers a row."""
    text = F.col("text")
    sized = _docs(spark, d, "doc_id", "lang", "text").where(F.col("lang").isin([*CAPS])).select("doc_id", "lang", T.octets(text).alias("size"), T.floor(text).alias("n_tokens"))
    return staged(corpus.mixture(staged(sized, "sized"), CAPS), "mixed")


@query(f"WITH {_MIX} SELECT doc_id, lang, CAST(bytes_before AS BIGINT) AS bytes_before, place FROM m")
def mixture_order(spark, d):
    """Two languages interleaved by their shares of bytes; the caps bound what is numbered."""
    placed = corpus.in_mixed_order(_mixed(spark, d), F.lit(1).cast("long"), "place")
    return placed.select("doc_id", "lang", F.col("bytes_before").cast("long").alias("bytes_before"), "place")


@query(f"WITH {_MIX}, b AS (SELECT doc_id, lang, place, n_tokens, sum(n_tokens) OVER (ORDER BY place) - n_tokens AS tokens_before FROM m) SELECT doc_id, lang, CAST(tokens_before AS BIGINT) AS tokens_before FROM b WHERE tokens_before < 50000")
def token_budget_prefix(spark, d):
    """The mixture up to a budget of tokens."""
    run = corpus.in_mixed_order(_mixed(spark, d), F.col("n_tokens"), "tokens_before")
    return run.select("doc_id", "lang", F.col("tokens_before").cast("long").alias("tokens_before")).where("tokens_before < 50000")


_BLOCKS = f"""n AS (SELECT doc_id, {_SQL_FLOOR} AS k FROM documents), a AS (SELECT doc_id, k, sum(k) OVER (ORDER BY doc_id) - k AS pos FROM n),
e AS (SELECT doc_id, k, CAST(pos AS BIGINT) AS pos, unnest(range(CAST(pos // {SEQ + 1} AS BIGINT), CAST((pos + k - 1) // {SEQ + 1} + 1 AS BIGINT))) AS block FROM a WHERE k > 0),
b AS (SELECT doc_id, block, greatest(pos, block * {SEQ + 1}) - block * {SEQ + 1} AS begins, least(pos + k, (block + 1) * {SEQ + 1}) - greatest(pos, block * {SEQ + 1}) AS tokens FROM e WHERE block < (SELECT sum(k) // {SEQ + 1} FROM n))"""


def _lengths(spark, d) -> DataFrame:
    return _docs(spark, d, "doc_id", "text").select("doc_id", T.floor(F.col("text")).alias("n_tokens"))


@query(f"WITH {_BLOCKS} SELECT doc_id, block, CAST(begins AS BIGINT) AS begins, CAST(tokens AS BIGINT) AS tokens FROM b")
def pack_blocks(spark, d):
    """Documents laid end to end and cut into blocks of one length."""
    return corpus.packed_blocks(_lengths(spark, d), SEQ).select("doc_id", "block", F.col("begins").cast("long").alias("begins"), F.col("tokens").cast("long").alias("tokens"))


@query(f"WITH {_BLOCKS}, t AS (SELECT max(block) + 1 AS n FROM b), u AS (SELECT DISTINCT block FROM b) SELECT block, CAST(block % 4 AS INTEGER) AS rank FROM u WHERE block < (SELECT n - n % 4 FROM t)")
def rank_shard(spark, d):
    """Blocks dealt to four ranks in turn."""
    blocks = corpus.packed_blocks(_lengths(spark, d), SEQ).select("block").distinct()
    n = blocks.agg(F.max("block")).first()[0]
    return corpus.rank_shard(blocks, 0 if n is None else n + 1, 4)


@query(f"""WITH n AS (SELECT doc_id, {_SQL_FLOOR} AS k FROM documents), o AS (SELECT k, (row_number() OVER (ORDER BY k, doc_id) - 1) // 16 AS batch_id FROM n)
SELECT batch_id, count(*) AS docs, CAST(max(k) AS BIGINT) AS longest, CAST(sum(k) AS BIGINT) AS tokens, CAST(count(*) * max(k) AS BIGINT) AS padded FROM o GROUP BY batch_id""")
def padded_batches_by_length(spark, d):
    """Batches of documents of like length, padded to the longest."""
    return corpus.padded_batches(_lengths(spark, d), 16)


@query(f"""WITH n AS (SELECT doc_id, {_SQL_FLOOR} AS k FROM documents), o AS (SELECT k, (row_number() OVER (ORDER BY doc_id) - 1) // 16 AS batch_id FROM n)
SELECT batch_id, count(*) AS docs, CAST(max(k) AS BIGINT) AS longest, CAST(sum(k) AS BIGINT) AS tokens, CAST(count(*) * max(k) AS BIGINT) AS padded FROM o GROUP BY batch_id""")
def padded_batches_in_order(spark, d):
    """Batches of documents in their own order, padded to the longest."""
    return corpus.padded_batches(_lengths(spark, d), 16, by_length=False)


def _sql_words(where: str = "") -> str:
    return f"SELECT hex(encode(piece)) AS word, regexp_replace(hex(encode(piece)), '(..)', '<\\1>', 'g') AS m, count(*) AS n FROM (SELECT unnest({_SQL_PIECES}) AS piece FROM documents {where}) GROUP BY 1, 2"


_W = f"w0 AS ({_sql_words()})"


def _sql_pairs(i: int, name: str = "") -> str:
    return f"""{name}s{i} AS (SELECT n, string_split(m[2:-2], '><') AS s FROM {name}w{i}),
{name}p{i} AS (SELECT s[j] AS l, s[j + 1] AS r, sum(n) AS c FROM (SELECT n, s, unnest(range(1, len(s))) AS j FROM {name}s{i}) GROUP BY 1, 2)"""


def _sql_merged(words: str, merges: str) -> str:
    return f"SELECT word, replace(m, '<' || l || '><' || r || '>', '<' || l || r || '>') AS m, n FROM {words}, {merges}"


def _sql_learn(k: int, where: str = "", name: str = "", base: str = "", base_k: int = 0) -> str:
    """k merges (name)t0.. learned on documents, after the merges of another such run (base)t0.. if it is named."""
    if base:
        parts = [f"{name}b0 AS ({_sql_words(where)})", *(f"{name}b{i + 1} AS MATERIALIZED ({_sql_merged(f'{name}b{i}', f't{i}')})" for i in range(base_k)), f"{name}w0 AS (SELECT * FROM {name}b{base_k})"]
    else:
        parts = [f"{name}w0 AS ({_sql_words(where)})"]
    for i in range(k):
        parts.append(_sql_pairs(i, name))
        parts.append(f"{name}t{i} AS (SELECT * FROM {name}p{i} ORDER BY c DESC, l, r LIMIT 1)")
        parts.append(f"{name}w{i + 1} AS MATERIALIZED ({_sql_merged(f'{name}w{i}', f'{name}t{i}')})")
    return ",\n".join(parts)


def _words(spark, d) -> DataFrame:
    return vocabulary.word_counts(_docs(spark, d, "text"))


@query(f"WITH {_W}, {_sql_pairs(0)} SELECT l AS \"left\", r AS \"right\", CAST(c AS BIGINT) AS \"count\" FROM p0")
def bpe_pair_counts(spark, d):
    """How often each pair of bytes stands side by side in a piece."""
    return vocabulary.pair_counts(_words(spark, d).select(vocabulary.bytes_as_symbols(F.col("word")).alias("marked"), "n"))


@query(f"WITH {_W}, {_sql_pairs(0)} SELECT l AS \"left\", r AS \"right\", CAST(c AS BIGINT) AS \"count\" FROM p0 ORDER BY c DESC, l, r LIMIT 1")
def bpe_first_merge(spark, d):
    """The most frequent pair."""
    return vocabulary.ranked_pairs(bpe_pair_counts(spark, d)).limit(1)


def _learned(spark, d, base=(), n=MERGES, texts=None) -> list[vocabulary.Merge]:
    words = (vocabulary.word_counts(texts) if texts is not None else _words(spark, d)).cache()
    made = vocabulary.learn(words, n, list(base))
    words.unpersist()
    return made


@query(f"WITH {_sql_learn(MERGES)} " + " UNION ALL ".join(f"SELECT {i} AS rank, l AS \"left\", r AS \"right\" FROM t{i}" for i in range(MERGES)))
def bpe_learn_k(spark, d):
    """The first merges learned on all documents."""
    return spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(_learned(spark, d))], "rank int, left string, right string")


@query(f"WITH {_sql_learn(MERGES)} SELECT word, CAST(n AS BIGINT) AS n, CAST(len(string_split(m[2:-2], '><')) AS INTEGER) AS tokens FROM w{MERGES}")
def bpe_encode_fold(spark, d):
    """Tokens of every distinct piece under the merges learned."""
    return vocabulary.encoded(_words(spark, d), _learned(spark, d)).select("word", "n", F.size("symbols").alias("tokens"))


_LADDER = [0, 1, 2, 4, MERGES]


@query(f"WITH {_sql_learn(MERGES)} " + " UNION ALL ".join(f"SELECT {i} AS size, CAST(sum(n * len(string_split(m[2:-2], '><'))) AS BIGINT) AS tokens FROM w{i}" for i in _LADDER))
def size_ladder(spark, d):
    """Tokens of the corpus with the first merges only, for growing numbers of them, in one pass."""
    return vocabulary.ladder(_words(spark, d), _learned(spark, d), _LADDER)


def _extended(spark, d) -> tuple[list, list]:
    """Merges learned on English, and those learned on top of them on French."""
    docs = _docs(spark, d, "text", "lang")
    base = _learned(spark, d, n=MERGES, texts=docs.where("lang = 'en'"))
    more = _learned(spark, d, base, MERGES, docs.where("lang = 'fr'"))
    return base, more


def _confined(spark, base, more) -> tuple[DataFrame, DataFrame]:
    """The merges as a table, and those of them kept: tokens that hold a byte beyond ASCII."""
    tokens = [(f"{b:02X}",) for b in range(256)] + [(a + b,) for a, b in base]
    merges = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(more)], "rank int, left string, right string")
    return merges, vocabulary.confine(merges, spark.createDataFrame(tokens, "token string"), lambda t: t.rlike("^(?:..)*?[89A-F]"))


# merges of English, then those of French on top of them, and which of these hold a byte beyond ASCII and have their parts
_EXTENDED = f"""{_sql_learn(MERGES, "WHERE lang = 'en'")},
{_sql_learn(MERGES, "WHERE lang = 'fr'", "f", "w", MERGES)},
more AS ({' UNION ALL '.join(f"SELECT {i} AS rank, l, r FROM ft{i}" for i in range(MERGES))}),
base AS ({' UNION ALL '.join(f"SELECT {i} AS rank, l, r FROM t{i}" for i in range(MERGES))}),
k0 AS (SELECT DISTINCT * FROM (SELECT l || r AS token FROM base UNION ALL SELECT upper(printf('%02x', i)) FROM (SELECT unnest(range(256)) AS i))),
{','.join(f"""
k{i + 1} AS (SELECT * FROM k{i} UNION SELECT l || r FROM more WHERE rank = {i} AND regexp_matches(l || r, '^(..)*?[89A-F]') AND l IN (SELECT * FROM k{i}) AND r IN (SELECT * FROM k{i}))""" for i in range(MERGES))},
kept AS (SELECT rank, l, r, regexp_matches(l || r, '^(..)*?[89A-F]') AND ({' OR '.join(f"(rank = {i} AND l IN (SELECT * FROM k{i}) AND r IN (SELECT * FROM k{i}))" for i in range(MERGES))}) AS kept FROM more)"""


@query(f'WITH {_EXTENDED} SELECT CAST(rank AS INTEGER) AS rank, l AS "left", r AS "right", kept FROM kept')
def bpe_confine(spark, d):
    """French merges on top of English ones, confined to tokens that hold a letter beyond ASCII."""
    merges, kept = _confined(spark, *_extended(spark, d))
    return merges.join(kept.select("rank", F.lit(True).alias("kept")), "rank", "left").select("rank", "left", "right", F.coalesce("kept", F.lit(False)).alias("kept"))


@query(f"""WITH {_EXTENDED}, old AS (SELECT DISTINCT l || r AS token FROM base), fresh AS (SELECT l || r AS token, min(rank) AS rank FROM more WHERE l || r NOT IN (SELECT * FROM old) GROUP BY 1)
SELECT token, CAST(255 + (SELECT count(*) FROM old) + row_number() OVER (ORDER BY rank) AS BIGINT) AS id FROM fresh""")
def bpe_apply_ids(spark, d):
    """Ids of the tokens that the French merges add to the English vocabulary."""
    base, more = _extended(spark, d)
    tokens = [f"{b:02X}" for b in range(256)] + list(dict.fromkeys(a + b for a, b in base))
    vocab = spark.createDataFrame([(t, i) for i, t in enumerate(tokens)], "token string, id long")
    return vocabulary.appended_ids(spark, vocab, spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(more)], "rank int, left string, right string"))


@query(f"""WITH {_EXTENDED}, old AS (SELECT DISTINCT l || r AS token FROM base), fresh AS (SELECT l || r AS token, min(rank) AS rank FROM more WHERE l || r NOT IN (SELECT * FROM old) GROUP BY 1),
ids AS (SELECT upper(printf('%02x', i)) AS piece, i AS id FROM (SELECT unnest(range(256)) AS i) UNION ALL SELECT l || r, 255 + row_number() OVER (ORDER BY rank) FROM base),
c0 AS (SELECT token, regexp_replace(token, '(..)', '<\\1>', 'g') AS m FROM fresh),
{','.join(f"""
c{i + 1} AS (SELECT token, replace(m, '<' || l || '><' || r || '>', '<' || l || r || '>') AS m FROM c{i}, t{i})""" for i in range(MERGES))},
x AS (SELECT token, unnest(string_split(m[2:-2], '><')) AS piece FROM c{MERGES}),
f AS (SELECT token, row_number() OVER (ORDER BY rank) AS nr FROM fresh),
v AS (SELECT token, i, avg(embedding[i]::DOUBLE) AS v FROM x JOIN ids USING (piece) JOIN embeddings ON vec_id = id, (SELECT unnest(range(1, 65)) AS i) GROUP BY ALL)
SELECT CAST(255 + (SELECT count(*) FROM old) + nr AS BIGINT) AS id, token, CAST(round(sum(v) * 1000) AS BIGINT) AS total, count(*) AS size,
  CAST(ceil((256 + (SELECT count(*) FROM old) + (SELECT count(*) FROM fresh)) / 128) * 128 AS BIGINT) AS rows_in_all FROM v JOIN f USING (token) GROUP BY token, nr""")
def extended_embedding_rows(spark, d):
    """The rows that French merges add to an embedding table: means of the rows of the English vocabulary's pieces."""
    base, more = _extended(spark, d)
    tokens = [f"{b:02X}" for b in range(256)] + list(dict.fromkeys(a + b for a, b in base))
    vocab = spark.createDataFrame([(t, i) for i, t in enumerate(tokens)], "token string, id long")
    fresh = vocabulary.appended_ids(spark, vocab, spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(more)], "rank int, left string, right string"))
    rows = vocabulary.extended_embeddings(_table(spark, d, "embeddings").select("vec_id", "embedding"), vocab, base, fresh)
    total = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x)
    size = F.lit(vocabulary.padded_size(len(tokens) + fresh.count())).cast("long")
    return rows.select("id", "token", F.round(total * 1000).cast("long").alias("total"), F.size("embedding").cast("long").alias("size"), size.alias("rows_in_all"))


def _sql_kept(words: str) -> str:
    """y0, y1, ...: words(lang, word, m, n) after the English merges and those of the first 0, 1, ... French ones that are kept."""
    parts = [f"x0 AS ({words})", *(f"x{i + 1} AS MATERIALIZED (SELECT lang, word, replace(m, '<' || l || '><' || r || '>', '<' || l || r || '>') AS m, n FROM x{i}, t{i})" for i in range(MERGES)), f"y0 AS (SELECT * FROM x{MERGES})"]
    parts += [f"y{i + 1} AS MATERIALIZED (SELECT lang, word, CASE WHEN kept THEN replace(m, '<' || l || '><' || r || '>', '<' || l || r || '>') ELSE m END AS m, n FROM y{i}, (SELECT * FROM kept WHERE rank = {i}))" for i in range(MERGES)]
    return ",\n".join(parts)


_LANG_WORDS = f"SELECT lang, hex(encode(piece)) AS word, regexp_replace(hex(encode(piece)), '(..)', '<\\1>', 'g') AS m, count(*) AS n FROM (SELECT lang, unnest({_SQL_PIECES}) AS piece FROM documents) GROUP BY ALL"


@query(f"WITH {_EXTENDED}, {_sql_kept(_LANG_WORDS)} SELECT y0.lang, bool_and(y0.m = y{MERGES}.m) AS identical FROM y0 JOIN y{MERGES} USING (lang, word) GROUP BY y0.lang")
def identical_ids_by_lang(spark, d):
    """Whether each language's pieces keep their tokens when confined merges are appended."""
    base, more = _extended(spark, d)
    kept = [(r["left"], r["right"]) for r in _confined(spark, base, more)[1].orderBy("rank").collect()]
    docs = _docs(spark, d, "text", "lang")
    words = docs.select("lang", F.explode(T.pieces(F.col("text"))).alias("p")).distinct().select("lang", F.hex(F.encode("p", "UTF-8")).alias("sent_id"))
    ids = lambda merges: words.select("lang", "sent_id", vocabulary.merged(vocabulary.bytes_as_symbols(F.col("sent_id")), merges).alias("ids"))
    return measure.identical_languages(ids(base), ids([*base, *kept]))


@query(f"WITH {_EXTENDED}, {_sql_kept(_LANG_WORDS)}, i AS (SELECT y0.lang, bool_and(y0.m = y{MERGES}.m) AS same FROM y0 JOIN y{MERGES} USING (lang, word) GROUP BY y0.lang) SELECT coalesce(string_agg(CASE WHEN same THEN lang END, ',' ORDER BY lang), '') AS languages, CAST(count_if(same) AS BIGINT) AS n, count(*) AS \"of\" FROM i")
def identical_languages_listed(spark, d):
    """The languages whose pieces all keep their tokens, and how many of all they are."""
    return measure.identical_summary(identical_ids_by_lang(spark, d)).withColumn("languages", F.array_join("languages", ","))


# the pre-tokenizer with marks taken for letters, as fix_marks() makes it
_MARKED_PIECES = _SQL_PIECES.replace(r"\p{L}\p{N}", r"\p{L}\p{M}\p{N}").replace(r"?\p{L}+", r"?[\p{L}\p{M}]+")


@query(f"""WITH {_EXTENDED}, {_sql_kept(_LANG_WORDS)}, sizes AS (SELECT i, CAST((SELECT count(*) FROM kept WHERE kept AND rank < i) AS INTEGER) AS size FROM (SELECT unnest(range({MERGES + 1})) AS i)),
z AS ({' UNION ALL '.join(f"SELECT lang, {i} AS i, CAST(sum(n * len(string_split(m[2:-2], '><'))) AS BIGINT) AS tokens FROM y{i} GROUP BY lang" for i in range(MERGES + 1))}),
l AS (SELECT DISTINCT lang, size, tokens FROM z JOIN sizes USING (i))
SELECT lang, size, tokens, tokens / max(CASE WHEN lang = 'en' THEN tokens END) OVER (PARTITION BY size) AS tax FROM l""".replace(_SQL_PIECES, _MARKED_PIECES))
def extend_ladder(spark, d):
    """A vocabulary extended end to end: marks kept inside words, English merges, French ones on top of them, confined, and every
    language measured again with the first 0, 1, 2, ... of those kept."""
    pattern = T.fix_marks(T.PATTERN)
    words = staged(vocabulary.word_counts(_docs(spark, d, "text", "lang"), pattern=pattern, by=("lang",)), "words")
    of = lambda lang: words.where(F.col("lang") == lang).select("word", "n")
    base = vocabulary.learn(of("en"), MERGES)
    kept = [(r["left"], r["right"]) for r in _confined(spark, base, vocabulary.learn(of("fr"), MERGES, base))[1].orderBy("rank").collect()]
    sizes = vocabulary.ladder(words, kept, [*range(len(kept) + 1)], ("lang",), base)
    return sizes.select("lang", "size", "tokens", F.try_divide("tokens", F.max(F.when(F.col("lang") == "en", F.col("tokens"))).over(Window.partitionBy("size"))).alias("tax"))


@query()
def bpe_learn_thousand(spark, d):
    """A thousand merges learned on all documents, with the length of each token in bytes."""
    learned = vocabulary.learn(_words(spark, d), 1000)
    rows = [(i, a, b, len(a + b) // 2) for i, (a, b) in enumerate(learned)]
    return spark.createDataFrame(rows, "rank int, left string, right string, bytes int")


@query(f"""SELECT token, CAST(len(regexp_extract_all(regexp_replace(token, '(\\s)([^\\s])', '{_MARK}\\1\\2', 'g'), '{_SQL_PATTERN}')) AS BIGINT) AS pieces
FROM (SELECT DISTINCT unnest(string_split(text, ' ')) AS token FROM documents) WHERE len(regexp_extract_all(regexp_replace(token, '(\\s)([^\\s])', '{_MARK}\\1\\2', 'g'), '{_SQL_PATTERN}')) > 1""")
def unreachable_tokens(spark, d):
    """Of a vocabulary of space-separated words those that the pre-tokenizer always splits."""
    return vocabulary.unreachable(_docs(spark, d, "text").select(F.explode(F.split("text", " ")).alias("token")).distinct())


@query("SELECT DISTINCT token FROM (SELECT unnest(string_split(text, ' ')) AS token FROM documents) WHERE contains(token, chr(10))")
def stop_tokens(spark, d):
    """Of that vocabulary the tokens that hold a line break."""
    return vocabulary.stop_tokens(_docs(spark, d, "text").select(F.explode(F.split("text", " ")).alias("token")).distinct())


@query("""SELECT token, CAST(round(list_sum(list(v ORDER BY pos)) * 1000) AS BIGINT) AS total, count(*) AS size FROM (SELECT label AS token, pos, avg(CAST(embedding[pos] AS DOUBLE)) AS v FROM (
  SELECT label, embedding, unnest(range(1, len(embedding) + 1)) AS pos FROM embeddings) GROUP BY 1, 2) GROUP BY token""")
def embedding_mean_init(spark, d):
    """New rows of an embedding matrix as means of old ones, here those of a label; their sums in thousandths."""
    vectors = _table(spark, d, "embeddings")
    means = vocabulary.mean_vectors(vectors.select(F.col("label").alias("token"), "vec_id"), vectors.select("vec_id", "embedding"))
    total = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x)
    return means.select("token", F.round(total * 1000).cast("long").alias("total"), F.size("embedding").cast("long").alias("size"))


@query("""WITH e AS (SELECT vec_id, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS i FROM embeddings), m AS (SELECT i, avg(v) AS m FROM e GROUP BY i)
SELECT vec_id, round(sum(v * m) / sqrt(sum(v * v) * sum(m * m)), 9) AS cosine FROM e JOIN m USING (i) GROUP BY vec_id""")
def embedding_cosine(spark, d):
    """Cosine of every vector with the mean of all, to nine places."""
    return vocabulary.cosine_to_mean(_table(spark, d, "embeddings").select("vec_id", "embedding")).withColumn("cosine", F.round("cosine", 9))


# a table of model outputs made from the documents: four answers a question, log-probabilities from lengths
_SCORED_SQL = f"s AS (SELECT doc_id // 4 AS question, CAST(doc_id % 4 + 1 AS INTEGER) AS k, lang, -(length(text) * 7 % 97 + 1) / 8.0::DOUBLE AS logp, {_SQL_BYTES} AS bytes, {_SQL_FLOOR} AS tokens FROM documents)"


def _scored(spark, d) -> DataFrame:
    text = F.col("text")
    return _docs(spark, d, "doc_id", "text", "lang").select(
        F.floor(F.col("doc_id") / 4).alias("question"), (F.col("doc_id") % 4 + 1).cast("int").alias("k"), "lang", (-(T.chars(text) * 7 % 97 + 1) / F.lit(8.0)).alias("logp"), T.octets(text).alias("bytes"), T.floor(text).alias("tokens")
    )


@query(f"WITH {_SCORED_SQL} SELECT lang, CAST(round(-sum(logp) / ln(2) / sum(bytes) * 10000) AS BIGINT) AS bits_10000, CAST(sum(tokens) AS BIGINT) AS tokens, CAST(sum(bytes) AS BIGINT) AS bytes FROM s GROUP BY lang")
def bits_per_byte(spark, d):
    """Bits per byte, in ten-thousandths, from a table of log-probabilities."""
    return score.bits_per_byte(_scored(spark, d), ("lang",)).select("lang", F.round(F.col("bits_per_byte") * 10000).cast("long").alias("bits_10000"), "tokens", "bytes")


@query(f"WITH {_SCORED_SQL} SELECT question, k AS choice FROM (SELECT *, row_number() OVER (PARTITION BY question ORDER BY logp / bytes DESC, k) AS p FROM s) WHERE p = 1")
def choice_argmax(spark, d):
    """The answer with the best log-probability per byte."""
    return score.choices(_scored(spark, d))


@query(f"""WITH {_SCORED_SQL}, c AS (SELECT question, k FROM (SELECT *, row_number() OVER (PARTITION BY question ORDER BY logp / bytes DESC, k) AS p FROM s) WHERE p = 1)
SELECT avg(CASE WHEN k = question % 4 + 1 THEN 1 ELSE 0 END) AS accuracy, count(*) AS questions FROM c""")
def choice_accuracy(spark, d):
    """Accuracy of the choices against an answer for each question."""
    scored = _scored(spark, d)
    answers = scored.select("question").distinct().withColumn("answer", (F.col("question") % 4 + 1).cast("int"))
    return score.accuracy(score.choices(scored), answers)


_GAP = "[ \\t\\n\\r\\f\\v]+"
_PUNCTUATION_SQL = r"[!-/:-@\[-`{-~]"


@query(f"""WITH q AS (SELECT row_number() OVER () AS k, role, text AS h, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM conversations WHERE conv_id IS NOT NULL),
s AS (SELECT k, role, unnest([0, 1]) AS side, unnest([h, r]) AS t FROM q WHERE r IS NOT NULL AND h IS NOT NULL),
u AS (SELECT k, role, side, regexp_replace(t, '{_GAP}', '', 'g') AS c, flatten(list_transform(list_filter(regexp_split_to_array(t, '{_GAP}'), lambda w: w <> ''),
  lambda w: CASE WHEN regexp_matches(w, '^.+{_PUNCTUATION_SQL}$') THEN [w[:-2], w[-1]] WHEN regexp_matches(w, '^{_PUNCTUATION_SQL}.+$') THEN [w[1], w[2:]] ELSE [w] END)) AS w FROM s),
g AS (SELECT k, role, side, 'c' || n AS o, substr(c, unnest(range(1, length(c) - n + 2)), n) AS g FROM u, (SELECT unnest(range(1, 7)) AS n)
  UNION ALL SELECT k, role, side, 'w1', unnest(w) FROM u UNION ALL SELECT k, role, side, 'w2', unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM u),
n AS (SELECT k, role, o, g, count(*) FILTER (WHERE side = 0) AS h, count(*) FILTER (WHERE side = 1) AS r FROM g GROUP BY ALL),
z AS (SELECT role, o, sum(least(h, r)) AS m, sum(h) AS h, sum(r) AS r FROM n GROUP BY ALL HAVING sum(h) > 0 AND sum(r) > 0),
a AS (SELECT role, avg(m / h) AS p, avg(m / r) AS r FROM z GROUP BY role)
SELECT role, round(CASE WHEN p + r > 0 THEN 100 * 5 * p * r / (4 * p + r) ELSE 0 END, 6) AS chrf FROM a""")
def chrf_by_role(spark, d):
    """chrF++ of every turn against the turn before it, by role, to six places."""
    turns = _table(spark, d, "conversations").where("conv_id is not null")
    pairs = turns.select("role", F.col("text").alias("hypothesis"), F.expr("lag(text) over (partition by conv_id order by turn)").alias("reference")).where("reference is not null")
    return score.chrf(pairs, ("role",)).select("role", F.round("chrf", 6).alias("chrf"))


_TIMED_SQL = f"t AS (SELECT source, lang, (length(text) % 50 + 1) / 16.0::DOUBLE AS seconds, {_SQL_FLOOR} AS tokens FROM documents)"


def _timed(spark, d) -> DataFrame:
    text = F.col("text")
    return _docs(spark, d, "text", "lang", "source").select("source", "lang", ((T.chars(text) % 50 + 1) / F.lit(16.0)).alias("seconds"), T.floor(text).alias("tokens"), F.lit(1).alias("sentences"))


@query(f"WITH {_TIMED_SQL} SELECT lang, sum(seconds) AS seconds, CAST(sum(tokens) AS BIGINT) AS tokens, count(*) AS sentences, 1000 * sum(seconds) / sum(tokens) AS ms_per_token, sum(seconds) / count(*) AS seconds_per_sentence, sum(tokens) / sum(seconds) AS tokens_per_second FROM t GROUP BY lang")
def throughput(spark, d):
    """Milliseconds a token, seconds a text and tokens a second from a table of timings."""
    return score.throughput(_timed(spark, d), ("lang",))


@query(f"WITH {_TIMED_SQL}, b AS (SELECT source AS tokenizer, lang, min(seconds) AS seconds FROM t GROUP BY ALL) SELECT *, max(CASE WHEN tokenizer = 'src0' THEN seconds END) OVER (PARTITION BY lang) / seconds AS speed_up FROM b")
def speed_up(spark, d):
    """The best repeat of each source and language against a baseline's."""
    return score.speed_up(score.best_of(_timed(spark, d), ("source", "lang")).withColumnRenamed("source", "tokenizer"), "src0")


@query("SELECT step, round(2e-4 * CASE WHEN step < 50 THEN (step + 1) / 50 ELSE 0.1 + 0.9 * 0.5 * (1 + cos(pi() * (step - 50) / 950)) END, 12) AS rate FROM (SELECT unnest(range(1000)) AS step)")
def learning_rates(spark, d):
    """A learning-rate schedule: warm-up and cosine, to twelve places."""
    return corpus.learning_rates(spark, 1000, 50, 2e-4).withColumn("rate", F.round("rate", 12))


@query(f"""WITH s AS (SELECT lang, CAST(sum({_SQL_FLOOR}) AS BIGINT) AS floor, CAST(sum({_SQL_BYTES}) AS BIGINT) AS tokens, CAST(sum(length(text)) AS BIGINT) AS chars FROM documents GROUP BY lang)
SELECT lang, round(tokens / (SELECT tokens FROM s WHERE lang = 'en'), 3) AS tax, round(chars / tokens, 3) AS chars_per_token, round(floor / tokens, 4) AS floor_share FROM s""")
def rounded_tax(spark, d):
    """Ratios as they are reported: to three places, shares to four."""
    text = F.col("text")
    sums = _docs(spark, d, "text", "lang").groupBy("lang").agg(F.sum(T.floor(text)).alias("floor"), F.sum(T.octets(text)).alias("tokens"), F.sum(T.chars(text)).alias("chars"))
    base = measure.of_base(F.col("tokens"), "en", "one")
    shares = sums.withColumn("one", F.lit(1)).withColumn("tax", F.try_divide("tokens", base))
    return shares.select("lang", rounded(F.col("tax"), 3).alias("tax"), rounded(F.try_divide("chars", "tokens"), 3).alias("chars_per_token"), rounded(F.try_divide("floor", "tokens"), 4).alias("floor_share"))


@query("SELECT source, min(doc_id) AS doc_id FROM documents GROUP BY source")
def sources_in_order(spark, d):
    """Every source with the document that names it first."""
    return score.ordered_distinct(_docs(spark, d, "doc_id", "source"), "source", "doc_id")


@query("SELECT doc_id, source, lang, length(text) AS chars FROM documents QUALIFY row_number() OVER (PARTITION BY source, lang ORDER BY doc_id DESC) = 1")
def latest_rows(spark, d):
    """The last document of each source and language."""
    rows = _docs(spark, d).select("doc_id", "source", "lang", T.chars(F.col("text")).alias("chars"))
    return score.latest(rows, ["source", "lang"], F.col("doc_id"))


@query("SELECT d.lang, count(*) AS documents, CAST(sum(l.quality) AS BIGINT) AS good FROM documents d JOIN labels l USING (doc_id) WHERE l.quality IS NOT NULL GROUP BY d.lang")
def ordinary_rows(spark, d):
    """Documents by language, without the rows that lack a label."""
    rows = _docs(spark, d, "doc_id", "lang").join(_table(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left")
    return score.ordinary(rows, "quality").groupBy("lang").agg(F.count("*").alias("documents"), F.sum("quality").alias("good"))


@query(f"""WITH s AS (SELECT lang, sum({_SQL_BYTES}) AS b, sum(length(text)) AS c FROM documents GROUP BY lang),
t AS (SELECT lang, b / (SELECT b FROM s WHERE lang = 'en') AS tax, c / (SELECT c FROM s WHERE lang = 'en') AS extended_tax FROM s)
SELECT *, tax / extended_tax AS gain FROM t""")
def extension_beside_base(spark, d):
    """The tax of two tokenizers side by side, by language."""
    return score.beside(_plain_tax(spark, d, FixedCut(1)), _plain_tax(spark, d, Characters()))


@query("""WITH t AS (SELECT d.source AS name, count(*) AS steps FROM documents d JOIN labels l USING (doc_id) WHERE l.toxic = 1 GROUP BY ALL)
SELECT name, e.documents, t.steps FROM (SELECT source AS name, count(*) AS documents FROM documents GROUP BY ALL) e LEFT JOIN t USING (name)""")
def evaluations_with_training(spark, d):
    """Rows by name with another table's row of that name, where it has one."""
    docs = _docs(spark, d, "doc_id", "source").withColumnRenamed("source", "name")
    toxic = _table(spark, d, "labels").where("toxic = 1").select("doc_id")
    return score.with_training(docs.groupBy("name").agg(F.count("*").alias("documents")), docs.join(toxic, "doc_id").groupBy("name").agg(F.count("*").alias("steps")))


@query("""WITH t AS (SELECT conv_id, role, arg_min(text, turn) AS text FROM conversations GROUP BY ALL)
SELECT u.conv_id AS sent_id, u.text AS source, a.text AS target FROM t u JOIN t a USING (conv_id) WHERE u.role = 'user' AND a.role = 'assistant'""")
def parallel_first_turns(spark, d):
    """The first text of the user and of the assistant of each conversation, paired as translations are."""
    turns = _table(spark, d, "conversations").groupBy(F.col("conv_id").alias("sent_id"), F.col("role").alias("lang")).agg(F.min_by("text", "turn").alias("text"))
    return score.parallel_pairs(turns, "user", "assistant")


@query("""WITH t AS (SELECT conv_id, role, arg_min(text, turn) AS text FROM conversations GROUP BY ALL),
p AS (SELECT u.conv_id AS sent_id, u.text AS s, a.text AS t FROM t u JOIN t a ON u.conv_id = a.conv_id AND u.role = 'user' AND a.role = 'assistant' WHERE u.text IS NOT NULL AND a.text IS NOT NULL),
h AS (SELECT coalesce(string_agg('Question: ' || s || chr(10) || 'Answer: ' || t || chr(10) || chr(10), '' ORDER BY sent_id), '') AS head FROM (SELECT * FROM p WHERE sent_id % 2 = 1 ORDER BY sent_id LIMIT 5))
SELECT sent_id, head || 'Question: ' || s || chr(10) || 'Answer:' AS prompt, t AS reference FROM p, h WHERE sent_id % 2 = 0""")
def few_shot_prompts(spark, d):
    """First turns of conversations with even ids behind five pairs of those with odd ids, as translation prompts are made."""
    turns = _table(spark, d, "conversations").groupBy(F.col("conv_id").alias("sent_id"), F.col("role").alias("lang")).agg(F.min_by("text", "turn").alias("text"))
    return score.few_shot_prompts(turns.where("sent_id % 2 = 1"), turns.where("sent_id % 2 = 0"), "user", "assistant", {"user": "Question", "assistant": "Answer"})


_ITEM_LANG = "CASE item_id % 4 WHEN 0 THEN 'en' WHEN 1 THEN 'fr' WHEN 2 THEN 'de' ELSE 'es' END"


@query(f"SELECT doc_id, lang FROM documents d WHERE NOT EXISTS (SELECT 1 FROM benchmark b WHERE length(b.text) >= 30 AND {_ITEM_LANG} = d.lang AND contains(d.text, b.text))")
def decontaminate_same_lang(spark, d):
    """Documents that hold no evaluation text of their own language; items are dealt to languages by their number."""
    banned = _table(spark, d, "benchmark").select("text", F.expr(_ITEM_LANG).alias("lang"))
    return corpus.decontaminate(_docs(spark, d, "doc_id", "lang", "text"), banned, by="lang").select("doc_id", "lang")


@query(f'WITH {_EXTENDED} SELECT CAST(rank AS INTEGER) AS rank, l AS "left", r AS "right" FROM kept WHERE kept ORDER BY rank LIMIT {round(MERGES / 1.2)}')
def bpe_learn_confined(spark, d):
    """Confined French merges on top of English ones; more are learned than asked for, since confining drops some."""
    docs = _docs(spark, d, "text", "lang")
    base = _learned(spark, d, n=MERGES, texts=docs.where("lang = 'en'"))
    vocab = spark.createDataFrame([(f"{b:02X}",) for b in range(256)] + [(a + b,) for a, b in base], "token string")
    words = vocabulary.word_counts(docs.where("lang = 'fr'"))
    return vocabulary.learn_confined(words, round(MERGES / 1.2), vocab, lambda t: t.rlike("^(?:..)*?[89A-F]"), base, 1.2)
