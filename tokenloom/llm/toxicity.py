"""Toxicity by weak supervision: many lexicon and pattern voters, a generative label model, a linear classifier.

Voters look at a text and vote for toxic, for clean, or abstain. Some use a fixed lexicon or patterns; others
use words and word beginnings found over-represented in toxic training documents, each voter its own group
of those of its own half of the documents. The label model is a Bayesian network: the class, and a tree of
votes in which every vote depends on the class (its accuracy) and on one other vote (their correlation,
Chow-Liu given the class). It is estimated by expectation maximisation over the counts of vote patterns of
all documents, training labels being observed there; a step is one pass that adds up tables of fixed size.
The classifier, logistic regression over term counts and votes, learns from the model's posteriors of all
documents outside the held-out fold, labelled or not, by L-BFGS; it is what scores documents.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tokenloom.llm.common import BROADCAST_ROWS, CACHE_WORDS, free_name, keep_rows, sliced, stage, summed
from tokenloom.llm.labels import held_out, training_labels

#: The held-out fold: crc32(doc_id as text) mod 5 is 0.
FOLD = (5, 0)
ACCEPT = 0.5
#: Labelled documents of either class that terms are mined from at most.
MINED_ROWS = 6_000
#: A term is kept if so many toxic documents' words have it, and this share of those documents' number.
LEAST_TERM, LEAST_SHARE = 5, 0.002
#: Insults that vote whatever the labels say. Fixed values.
LEXICON = ("idiot idiots moron morons stupid dumb loser losers scum trash worthless pathetic disgusting clown garbage imbecile retard freak creep jerk bastard bitch filthy vermin").split()
PREFIXES = range(4, 9)
#: Voters that share the lexicon, the words and the beginnings (these for either half of the documents).
LEXICONS, GROUPS = 4, 4
STEPS, PENALTY = 60, 1e-5
_LETTERS = regex.compile(r"\p{L}+")
#: Phrases that vote, in lower case, and patterns with a string that a text needs before they are looked for.
PHRASES = {"commanded": ("shut up", "get lost", "drop dead"), "hated": tuple(f"{v} {o}" for v in ("hate", "despise", "kill") for o in ("you", "them", "those", "these"))}
PATTERNS = {
    "masked": ("**", regex.compile(r"\b[A-Za-z]\*{2,}[A-Za-z]*\b")),
    "shouted": ("!!", regex.compile(r"\b\p{Lu}{3,}!!")),
}
_ADDRESSED = regex.compile(r"(?i)\byou(?: are|'re|r) (?:a |an |all |so |such |just )?(?:" + "|".join(LEXICON) + r")\b")
VOTERS = (
    *(f"lexicon_{i}" for i in range(LEXICONS)), "lexicon_twice", *(f"words_{p}_{g}" for p in (0, 1) for g in range(GROUPS)), *(f"beginnings_{p}_{g}" for p in (0, 1) for g in range(GROUPS)),
    "lexicon_share", "words_share", "beginnings_share", "addressed", *PHRASES, *PATTERNS,
)
_SHARES = ("lexicon_share", "words_share", "beginnings_share", "log_words")


def words_of(text: str | None) -> list[str]:
    return _LETTERS.findall(text.lower()) if text else []


def mined_terms(docs: DataFrame, labels: DataFrame) -> list[tuple[str, bool, int]]:
    """(term, whether it is a word's beginning, half) of the terms over-represented in toxic documents.

    Terms count once for each document and distinct word. A term is kept if LEAST_TERM toxic documents' words
    or more have it (and LEAST_SHARE of the toxic documents, so that their number has a bound) and its share
    among toxic documents' words is eight times that among clean ones.
    """

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                some = batch.slice(at, 64)
                rows = [(w, y, p) for y, p, t in zip(*(some.column(c).to_pylist() for c in ("y", "part", "text"))) for w in set(words_of(t))]
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64())], names=["w", "y", "part"])

    labels = stage(labels, "mined-labels")
    found = {r["y"]: r["n"] for r in labels.groupBy("y").agg(F.count("*").alias("n")).collect()}
    least = max(LEAST_TERM, LEAST_SHARE * found.get(1, 0) / 2)
    part = (F.xxhash64("doc_id", F.lit(3)) % 2 == 0).cast("long").alias("part")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    texts = texts.join(F.broadcast(labels) if sum(found.values()) <= BROADCAST_ROWS else labels, "doc_id").select(F.col("y").cast("long").alias("y"), part, "text")
    words = stage(texts.mapInArrow(run, "w string, y long, part long").groupBy("w", "part").agg(F.sum("y").alias("bad"), F.sum(1 - F.col("y")).alias("good")), "mined")
    starts = words.select(F.explode(F.array(*(F.struct(F.substring("w", 1, k).alias("term"), F.lit(k).alias("k")) for k in PREFIXES))).alias("s"), F.length("w").alias("size"), "part", "bad", "good").where("size >= s.k")
    terms = words.select(F.col("w").alias("term"), F.lit(False).alias("start"), "part", "bad", "good").unionByName(
        starts.groupBy(F.col("s.term").alias("term"), "part").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")).withColumn("start", F.lit(True))
    )
    # the two halves' totals are literals: a join on the half would gather all terms in two tasks
    totals = words.groupBy("part").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")).where("bad > 0 and good > 0").collect()
    odds = F.lit(0.0)
    for r in totals:
        odds = F.when(F.col("part") == r["part"], (F.col("bad") + 0.5) / (r["bad"] + 1) / ((F.col("good") + 0.5) / (r["good"] + 1))).otherwise(odds)
    kept = terms.where(F.col("bad") >= least).where(odds >= 8).orderBy("term", "start", "part")
    return [(r["term"], r["start"], r["part"]) for r in kept.select("term", "start", "part").collect()]


class _Found(dict):
    """White-space-free word -> its number of letter runs and the ids of their terms, kept up to CACHE_WORDS words."""

    def __init__(self, ids: dict):
        self.ids = ids

    def __missing__(self, word: str) -> tuple:
        runs, get = _LETTERS.findall(word.lower()), self.ids.get
        if len(self) >= CACHE_WORDS:
            self.clear()
        ids = [i for r in runs if (i := get((r, False))) is not None]
        ids += [i for r in runs for k in PREFIXES if len(r) >= k and (i := get((r[:k], True))) is not None]
        self[word] = out = len(runs), ids
        return out


class Terms:
    """Term ids; what voters and terms find in a text."""

    def __init__(self, mined: list[tuple[str, bool, int]]):
        keys = sorted({(t, s) for t, s, _ in mined} | {(t, False) for t in LEXICON})
        self.ids = {k: i for i, k in enumerate(keys)}
        self.starts = {i for (_, s), i in self.ids.items() if s}
        #: For each term the voters that it makes vote: those of its group in either half, those of the lexicon.
        self.voters: list[list[int]] = [[] for _ in keys]
        for t, start, part in mined:
            self.voters[self.ids[t, start]].append(VOTERS.index(f"{'beginnings' if start else 'words'}_{part}_{zlib.crc32(t.encode()) % GROUPS}"))
        self.lexicon = {self.ids[t, False]: i % LEXICONS for i, t in enumerate(LEXICON)}
        self.found = _Found(self.ids)

    def measure(self, text: str | None) -> dict:
        """Votes, term ids, their log counts and the shares of a text; a null text counts as empty."""
        text = text or ""
        n, counts = 0, {}
        for runs, ids in map(self.found.__getitem__, text.split()):
            n += runs
            if ids:
                for i in ids:
                    counts[i] = counts.get(i, 0) + 1
        votes = dict.fromkeys(VOTERS, "-")
        found = [0, 0, 0]  # occurrences of the lexicon, of words, of beginnings
        for i, c in counts.items():
            for v in self.voters[i]:
                votes[VOTERS[v]] = "1"
            if i in self.lexicon:
                votes[f"lexicon_{self.lexicon[i]}"] = "1"
                found[0] += c
            found[2 if i in self.starts else 1] += c
        if found[0] > 1:
            votes["lexicon_twice"] = "1"
        m = max(1, n)
        for name, c in zip(_SHARES, found):
            votes[name] = "1" if c > 0.01 * m else "-" if c else "0"
        if found[0] and _ADDRESSED.search(text):
            votes["addressed"] = "1"
        low = text.lower()
        for name, phrases in PHRASES.items():
            if any(x in low for x in phrases):
                votes[name] = "1"
        for name, (needed, pattern) in PATTERNS.items():
            if needed in text and pattern.search(text):
                votes[name] = "1"
        return {"votes": "".join(votes.values()), "terms": [*counts], "counts": [float(np.log1p(c)) for c in counts.values()], "shares": [*(min(1.0, 20 * c / m) for c in found), float(np.log1p(n)) / 10]}


#: What Terms.measure() finds.
MEASURED = "struct<votes: string, terms: array<int>, counts: array<double>, shares: array<double>>"
_MEASURED = pa.struct([("votes", pa.string()), ("terms", pa.list_(pa.int32())), ("counts", pa.list_(pa.float64())), ("shares", pa.list_(pa.float64()))])


def measured_by(terms: Terms, text: Column) -> Column:
    return F.arrow_udf(lambda column: sliced(column, lambda some: [terms.measure(t) for t in some], _MEASURED), MEASURED)(text.cast("string"))


def indicators(votes: list[str]) -> np.ndarray:
    """One row per pattern, three columns per voter: whether it votes clean, toxic, or abstains."""
    raw = np.frombuffer("".join(votes).encode(), np.uint8).reshape(len(votes), -1)
    return (raw[:, :, None] == np.frombuffer(LabelModel.VALUES.encode(), np.uint8)).reshape(len(votes), -1).astype(float)


class LabelModel:
    """P(toxic) for vote patterns: votes in a tree, each given the class and one other vote.

    Its estimates follow from pair sums: for either class a matrix that counts, for any two votes of any two
    voters, the documents that have both.
    """

    VALUES = "01-"

    def __init__(self, prior: float, pairs: np.ndarray, parent: list[int]):
        self.prior, self.parent, self.tables = prior, parent, self._tables(pairs, parent)

    @staticmethod
    def tree(pairs: np.ndarray) -> list[int]:
        """For each voter its parent: the maximum spanning tree by mutual information given the class."""
        k = pairs.shape[1] // 3
        info = np.zeros((k, k))
        for own in pairs:
            total = own[:3, :3].sum()
            if total:
                alone, both = np.diag(own) / total, own / total
                part = both * np.log(np.where(both > 0, both, 1) / np.where(both > 0, np.outer(alone, alone), 1))
                info += total * part.reshape(k, 3, k, 3).sum((1, 3))
        parent, inside = [-1] * k, [0]
        while len(inside) < k:
            i, j = max(((i, j) for i in inside for j in range(k) if j not in inside), key=lambda e: (info[e], -e[0], -e[1]))
            parent[j] = i
            inside.append(j)
        return parent

    @staticmethod
    def _tables(pairs: np.ndarray, parent: list[int]) -> np.ndarray:
        """log P(vote | parent's vote, class), smoothed towards P(vote | class): voters x classes x 3 x 3."""
        out = []
        for i, p in enumerate(parent):
            alone = np.stack([np.diag(own)[3 * i : 3 * i + 3] + 0.5 for own in pairs])
            alone /= alone.sum(1, keepdims=True)
            both = 2 * alone[:, None, :].repeat(3, 1) + (0 if p < 0 else pairs[:, 3 * p : 3 * p + 3, 3 * i : 3 * i + 3])
            out.append(np.log(both / both.sum(2, keepdims=True)))
        return np.array(out)

    def posterior(self, votes: list[str]) -> np.ndarray:
        raw = np.frombuffer("".join(votes).encode(), np.uint8).reshape(len(votes), -1)
        v = (raw == ord("1")) + 2 * (raw == ord("-"))
        log = np.log([1 - self.prior, self.prior])[None, :].repeat(len(v), 0)
        for i, p in enumerate(self.parent):
            log += self.tables[i][:, v[:, p] if p >= 0 else np.zeros(len(v), int), v[:, i]].T
        return 1 / (1 + np.exp(np.clip(log[:, 0] - log[:, 1], -500, 500)))


def fit_label_model(patterns: DataFrame) -> LabelModel:
    """The label model of patterns(votes, n, clean, toxic): documents without a label and with one, by votes."""
    k = 3 * len(patterns.select("votes").first()[0])

    def pair_sums(weights) -> np.ndarray:
        """Pair sums of either class, weights(batch, votes) giving each pattern's documents of the classes."""

        def add(batch) -> np.ndarray:
            votes = batch.column("votes").to_pylist()
            if not votes:
                return np.zeros(2 * k * k)
            own = indicators(votes)
            return np.stack([own.T @ (own * w[:, None]) for w in weights(batch, votes)]).reshape(-1)

        return summed(patterns, add, 2 * k * k).reshape(2, k, k)

    counts = lambda batch: [batch.column(c).to_numpy().astype(float) for c in ("n", "clean", "toxic")]
    pairs = pair_sums(lambda batch, votes: counts(batch)[1:])
    clean, toxic = (float(own[:3, :3].sum()) for own in pairs)
    prior = (toxic + 1) / (clean + toxic + 10)
    if not clean + toxic:  # without labels a document is the likelier toxic the more voters say so

        def start(batch, votes):
            q = np.clip([v.count("1") / len(v) for v in votes], 0.01, 0.99)
            return [counts(batch)[0] * (1 - q), counts(batch)[0] * q]

        pairs = pair_sums(start)
    parent = LabelModel.tree(pairs)
    model = LabelModel(prior, pairs, parent)
    for _ in range(30):

        def expected(batch, votes, model=model):
            (n, *known), q = counts(batch), model.posterior(votes)
            return [known[0] + n * (1 - q), known[1] + n * q]

        again = LabelModel(prior, pair_sums(expected), parent)
        change = float(np.abs(np.exp(again.tables) - np.exp(model.tables)).max())
        model = again
        if change < 1e-4:
            break
    return model


class Classifier:
    """Terms and weights of a logistic regression over term counts, votes and shares; small whatever the corpus' size."""

    def __init__(self, terms: Terms, weights: np.ndarray | None = None):
        self.terms, self.n_terms, self.n_dense = terms, len(terms.ids), 3 * len(VOTERS) + len(_SHARES)
        self.weights = np.zeros(self.n_terms + self.n_dense + 1) if weights is None else weights

    @staticmethod
    def dense(rows: list[dict]) -> np.ndarray:
        return np.hstack([indicators([r["votes"] for r in rows]), np.array([r["shares"] for r in rows])])

    def score(self, rows: list[dict]) -> np.ndarray:
        """Scores of what Terms.measure() found."""
        if not rows:
            return np.empty(0)
        w = self.weights
        z = self.dense(rows) @ w[self.n_terms : -1] + w[-1]
        z += [sum(w[i] * x for i, x in zip(r["terms"], r["counts"])) for r in rows]
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def fit_linear(blocks: DataFrame, n_terms: int, n_dense: int) -> np.ndarray:
    """Weights of logistic regression with soft labels by L-BFGS: terms, dense features, bias.

    blocks(at, term, value, dense, q) hold the arrays of some rows each as bytes; a step is one pass over
    them that adds up the loss and its gradient.
    """
    size = n_terms + n_dense + 1

    def evaluate(w: np.ndarray) -> np.ndarray:
        def add(batch) -> np.ndarray:
            total = np.zeros(size + 2)
            for i in range(batch.num_rows):
                at, term = (np.frombuffer(batch.column(c)[i].as_buffer(), np.int32) for c in ("at", "term"))
                value, dense, q = (np.frombuffer(batch.column(c)[i].as_buffer(), np.float32).astype(float) for c in ("value", "dense", "q"))
                dense = dense.reshape(len(q), n_dense)
                z = dense @ w[n_terms:-1] + w[-1] + np.bincount(at, value * w[term], len(q))
                g = 1 / (1 + np.exp(-np.clip(z, -500, 500))) - q
                loss = float((np.logaddexp(0, z) - q * z).sum())
                total += np.concatenate([np.bincount(term, value * g[at], n_terms), g @ dense, [g.sum(), loss, len(q)]])
            return total

        total = summed(blocks, add, size + 2)
        n, penalty = max(1.0, total[-1]), PENALTY * np.r_[w[:-1], 0]
        return np.r_[total[:size] / n + penalty, total[-2] / n + penalty @ w / 2]

    w, pairs = np.zeros(size), []
    now = evaluate(w)
    for _ in range(STEPS):
        g = now[:-1]
        if np.abs(g).max() < 1e-5:
            break
        d, used = g.copy(), []
        for s, y in reversed(pairs):
            used.append((a := s @ d / (s @ y)))
            d -= a * y
        d *= (pairs[-1][0] @ pairs[-1][1]) / (pairs[-1][1] @ pairs[-1][1]) if pairs else 1 / max(1e-12, np.abs(g).max())
        for (s, y), a in zip(pairs, reversed(used)):
            d += s * (a - y @ d / (s @ y))
        step = 1.0
        while (after := evaluate(w - step * d))[-1] > now[-1] - 1e-4 * step * (g @ d) and step > 1e-6:
            step /= 4
        s, y = -step * d, after[:-1] - g
        w, now = w + s, after
        if s @ y > 1e-12:
            pairs = [*pairs, (s, y)][-10:]
    return w


def fit_toxicity(measured: DataFrame, labels: DataFrame, terms: Terms) -> Classifier:
    """The classifier, from measured(doc_id, m) and labels(doc_id, toxic)."""
    known = training_labels(labels, "toxic", *FOLD)
    seen = measured.select("doc_id", "m.votes").join(known, "doc_id", "left").groupBy("votes")
    patterns = stage(seen.agg(F.sum(F.col("y").isNull().cast("long")).alias("n"), F.sum(F.coalesce((F.col("y") == 0).cast("long"), F.lit(0))).alias("clean"), F.sum(F.coalesce((F.col("y") == 1).cast("long"), F.lit(0))).alias("toxic")), "patterns")
    empty = Classifier(terms)
    if not patterns.take(1):
        return empty
    model = fit_label_model(patterns)

    def blocks(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                rows = batch.column("m").slice(at, 1024).to_pylist()
                q = model.posterior([r["votes"] for r in rows])
                arrays = (
                    np.repeat(np.arange(len(rows)), [len(r["terms"]) for r in rows]).astype(np.int32), np.array([i for r in rows for i in r["terms"]], np.int32),
                    np.array([x for r in rows for x in r["counts"]], np.float32), Classifier.dense(rows).astype(np.float32), q.astype(np.float32),
                )
                yield pa.RecordBatch.from_arrays([pa.array([a.tobytes()], pa.binary()) for a in arrays], names=["at", "term", "value", "dense", "q"])

    rows = measured.where(~held_out(F.col("doc_id"), *FOLD)).select("m").mapInArrow(blocks, "at binary, term binary, value binary, dense binary, q binary")
    return Classifier(terms, fit_linear(stage(rows, "blocks"), empty.n_terms, empty.n_dense))


def toxicity_filter(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs, with all their columns, that the classifier does not call toxic.

    Texts are measured once, and rows stand with what was found in the shared folder until they are judged.
    Null and empty texts are judged like others, repeated rows each for itself; columns of any name come
    through, an empty table gives an empty table.
    """
    terms = Terms(mined_terms(docs, training_labels(labels, "toxic", *FOLD, rows=MINED_ROWS)))
    m = free_name(docs, "m")
    measured = stage(docs.withColumn(m, measured_by(terms, F.col("text"))), "votes")
    classifier = fit_toxicity(measured.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(m).alias("m")), labels, terms)
    return keep_rows(measured, m, lambda some: classifier.score(some) < ACCEPT)


def score_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs(doc_id, text), labels(doc_id, toxic) -> doc_id, held_out, score, predicted, one row per row.

    Only labels outside the held-out fold are learned from. Null and empty texts have no words and are scored
    like any other text; equal texts have equal scores; a null doc_id is not held out; without labels the
    fixed lexicon and patterns decide; an empty table gives an empty table; other columns are ignored,
    whatever their names.
    """
    terms = Terms(mined_terms(docs, training_labels(labels, "toxic", *FOLD, rows=MINED_ROWS)))
    measured = stage(docs.select(F.col("doc_id").cast("long").alias("doc_id"), measured_by(terms, F.col("text")).alias("m")), "votes")
    classifier = fit_toxicity(measured, labels, terms)
    score = F.arrow_udf(lambda column: sliced(column, classifier.score, pa.float64()), "double")
    scored = measured.select("doc_id", score(F.col("m")).alias("score"))
    return scored.select("doc_id", held_out(F.col("doc_id"), *FOLD).alias("held_out"), "score", (F.col("score") >= ACCEPT).cast("int").alias("predicted"))
