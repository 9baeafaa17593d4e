"""Toxicity by a learnt lexicon, matched with edits, and the context of its matches.

Learning takes a bounded sample of the labelled documents. Words, and beginnings of words, that mark the toxic ones beyond
chance become the lexicon; a word counts once per passage, however many documents hold the passage. A Levenshtein automaton
over the lexicon's trie also finds misspelt forms. A form that the sample shows often enough is judged by its own counts. For
all others each term is asked how likely a word near it is a misspelling of it, and not a rare word of its own: misspellings
are a small share of the term's uses, and the rare near words of the sample's clean documents tell how many others there are.
Where misspellings prevail, a near form counts like the term. Around each match a window of words is scored: marks of
quotation set the match apart, words that go with harmless matches lower it. A logistic regression over the sums of a
document's matches gives the score.

Scoring reads every whole text. Defined results: null and empty texts are scored like any text without a match; documents
whose label is null teach nothing; an id labelled more than once is toxic if any label is; without labels of both kinds
every score is the kind that there is (0 without any). Only the text enters a score.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Collection, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from floodlens.llm import near_copies
from floodlens.llm.automaton import TermAutomaton
from floodlens.llm.common import cut, held, in_arrow
from floodlens.session import ship_package

#: Labelled documents learnt from, at most; the first by hash of id and text. What is learnt is as large as they allow.
MOST_LABELLED = 20_000
#: A term is at least so many times as frequent in toxic documents as in clean ones.
TIMES = 10
#: Two texts count as one in the vocabulary if so many of their MinHash bands are equal (of 16; 8 at similarity 0.8).
ALIKE = 5
#: Words before and after a word by which passages are told apart.
PASSAGE = 4
#: Weight that a near form needs to count, and the share of a term's uses that are taken to be misspelt.
NEAR, MISSPELT = 1.0, 0.02
WINDOW = 6
FEATURES = 4
#: Words remembered as no match by a worker, and the longest of them.
REMEMBERED, LONGEST = 150_000, 64
#: Texts taken out of an Arrow batch at once.
TEXTS = 500

_EDGE = "\"'“”„«»‘’`*_~()[]{}<>.,;:!?¡¿…-–—%&$#/\\|+="
_OPEN, _CLOSE = "\"“„«‘", "\"”“»’"


def held_out(key: str | Column = "doc_id") -> Column:
    return F.crc32((key if isinstance(key, Column) else F.col(key)).cast("string").cast("binary")) % 5 == 0


@dataclass
class ToxicityModel:
    weights: dict[str, float] = field(default_factory=dict)  # of terms, of stems written with *
    forms: dict[str, float] = field(default_factory=dict)  # of near forms that the sample shows often enough
    loose: frozenset[str] = frozenset()  # terms whose other near forms count
    context: dict[str, float] = field(default_factory=dict)
    mean: np.ndarray = field(default_factory=lambda: np.zeros(FEATURES))
    scale: np.ndarray = field(default_factory=lambda: np.ones(FEATURES))
    beta: np.ndarray = field(default_factory=lambda: np.zeros(FEATURES))
    bias: float = -math.inf

    def automaton(self, loose: Collection[str] | None = None) -> TermAutomaton:
        return TermAutomaton((t for t in self.weights if t[-1] != "*"), (t[:-1] for t in self.weights if t[-1] == "*"), loose)

    def probability(self, features: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip((features - self.mean) / self.scale @ self.beta + self.bias, -30, 30)))


def likelihood_ratio(a: float, b: float, n1: float, n0: float) -> float:
    """Twice the log of how much better two rates (a of n1, b of n0) explain the counts than one; negative if a is the rarer."""
    def term(x: float, n: float, p: float) -> float:
        return (x * math.log(p) if x else 0.0) + ((n - x) * math.log(1 - p) if n - x else 0.0)

    p = (a + b) / (n1 + n0)
    ratio = 2 * (term(a, n1, a / n1) + term(b, n0, b / n0) - term(a, n1, p) - term(b, n0, p))
    return ratio if a * n0 > b * n1 else -ratio


def weight(a: float, b: float, n1: float, n0: float) -> float:
    return max(-8.0, min(8.0, math.log((a + 0.5) / (n1 + 1)) - math.log((b + 0.5) / (n0 + 1))))


class Matcher:
    """Matches of a model in texts; one per Python process and model, so words are looked up once."""

    def __init__(self, model: ToxicityModel) -> None:
        self.model, self.automaton = model, model.automaton(model.loose)
        self.clean: set[str] = set()
        self.found: dict[str, float] = {}

    def value(self, word: str) -> float | None:
        """Weight of a word as written in a text; None for most words."""
        bare = word.strip(_EDGE)
        if not bare:
            return None
        if bare not in self.model.weights and (own := self.model.forms.get(bare)) is not None:
            return own if own > NEAR else None
        hit = self.automaton.find(bare)
        return self.model.weights[hit[0]] if hit else None

    def matches(self, text: str) -> tuple[list[str], list[tuple[int, float]]]:
        """The words of a text and (place, weight) of its matches."""
        words = text.lower().split()
        if len(self.clean) > REMEMBERED:
            self.clean, self.found = set(), {}
        hits = {}
        for word in set(words) - self.clean:
            value = self.found[word] if word in self.found else self.value(word)
            if value is not None:
                hits[word] = value
            if len(word) <= LONGEST:
                if value is None:
                    self.clean.add(word)
                else:
                    self.found[word] = value
        return words, [(i, hits[w]) for i, w in enumerate(words) if w in hits] if hits else []

    def features(self, text: str) -> list[float]:
        """Strongest unquoted match with its context; unquoted matches; quoted matches; density."""
        words, matches = self.matches(text)
        strongest, unquoted, quoted = 0.0, 0, 0
        context = self.model.context
        for at, value in matches:
            if in_quotes(words, at):
                quoted += 1
                continue
            value += sum(context.get(w.strip(_EDGE), 0.0) for w in window(words, at)) if context else 0.0
            strongest = max(strongest, value)
            unquoted += 1
        return [strongest, math.log1p(unquoted), math.log1p(quoted), math.log1p(100 * unquoted / max(1, len(words)))]


def window(words: Sequence[str], at: int) -> list[str]:
    return [*words[max(0, at - WINDOW):at], *words[at + 1:at + 1 + WINDOW]]


def in_quotes(words: Sequence[str], at: int) -> bool:
    """Whether a quotation opens at or shortly before a word and closes at or shortly after it."""
    opens = next((True for w in reversed(words[max(0, at - WINDOW):at + 1]) if w[0] in _OPEN), False)
    return opens and any(w.rstrip(".,;:!?")[-1:] and w.rstrip(".,;:!?")[-1] in _CLOSE and len(w) > 1 for w in words[at:at + 1 + WINDOW])


def _sample(docs: DataFrame, labels: DataFrame, most: int) -> DataFrame:
    """``doc_id, text_key, text, toxic`` of at most ``most`` labelled documents that are not held out, each id and text once."""
    ids = labels.where("toxic is not null and doc_id is not null").where(~held_out()).groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    order = [F.xxhash64("doc_id"), "doc_id"]
    ids = ids.orderBy(*order).limit(most)
    text = F.coalesce("text", F.lit(""))
    # At most ``most`` rows of two numbers are broadcast, also where an id has many texts.
    rows = cut(docs.select("doc_id", F.xxhash64(text).alias("text_key"), text.alias("text")).join(F.broadcast(ids), "doc_id"))
    first = rows.select("doc_id", "text_key").distinct().orderBy(F.xxhash64("doc_id", "text_key"), "doc_id", "text_key").limit(most)
    return rows.join(F.broadcast(first), ["doc_id", "text_key"]).dropDuplicates(["doc_id", "text_key"])


def _different(sample: DataFrame) -> DataFrame:
    """The sample with one row of each group of equal or nearly equal texts of one kind: words of a text and its copies are no evidence twice."""
    found = near_copies.sketches(sample.select(F.col("doc_id").cast("long").alias("id"), "text_key", F.col("toxic").alias("part"), "text"))
    rows = found.collect()  # ids and bands of at most MOST_LABELLED documents
    kept, holders = [], defaultdict(list)
    for row in sorted(rows, key=lambda r: (r["id"], r["text_key"])):
        shared = Counter(k for band in row["bands"] for k in holders[band])
        if not shared or max(shared.values()) < ALIKE:
            for band in row["bands"]:
                holders[band].append(len(kept))
            kept.append((row["id"], row["text_key"]))
    stay = sample.sparkSession.createDataFrame(kept, "doc_id long, text_key long")
    return sample.join(F.broadcast(stay), ["doc_id", "text_key"])


def _vocabulary(sample: DataFrame) -> DataFrame:
    """``word, a, b``: number of toxic and of clean passages of the sample with the word, one a document at most."""

    def passages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            for at in range(0, len(batch), TEXTS):
                rows: set[tuple[str, int, bool]] = set()
                some = batch.slice(at, TEXTS)
                for text, toxic in zip(some.column(0).to_pylist(), some.column(1).to_pylist()):
                    words = text.lower().split()
                    first: dict[str, int] = {}
                    for i, w in enumerate(words):
                        first.setdefault(w.strip(_EDGE), i)
                    first.pop("", None)
                    rows.update((w, xxhash.xxh3_64_intdigest(" ".join(words[max(0, i - PASSAGE):i + PASSAGE + 1])) >> 1, toxic > 0) for w, i in first.items())
                words, places, kinds = zip(*rows) if rows else ((), (), ())
                yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(places, pa.int64()), pa.array(kinds, pa.bool_())], ["word", "place", "toxic"])

    each = in_arrow(sample.select("text", "toxic"), passages, "word string, place long, toxic boolean").distinct()
    toxic = F.col("toxic").cast("long")
    return each.groupBy("word").agg(F.sum(toxic).alias("a"), F.sum(1 - toxic).alias("b"))


def _stands_out(a: Column, b: Column, n1: int, n0: int, bar: float) -> Column:
    """Whether counts ``a`` of ``n1`` are larger than ``b`` of ``n0`` by a likelihood ratio over ``bar``."""
    def term(x: Column, n: int, p: Column) -> Column:
        return F.when(x > 0, x * F.log(p)).otherwise(0.0) + F.when(x < n, (n - x) * F.log(1 - p)).otherwise(0.0)

    p = (a + b) / F.lit(float(n1 + n0))
    ratio = 2 * (term(a, n1, a / float(n1)) + term(b, n0, b / float(n0)) - term(a, n1, p) - term(b, n0, p))
    return (a * n0 > b * n1) & (ratio > bar)


def _lexicon(words: DataFrame, n1: int, n0: int) -> dict[str, float]:
    stems = words.where("length(word) > 4").select("a", "b", F.explode(F.expr("transform(sequence(4, least(8, length(word) - 1)), n -> concat(left(word, n), '*'))")).alias("word"))
    stems = stems.groupBy("word").agg(F.sum("a").alias("a"), F.sum("b").alias("b"), F.count("*").alias("forms")).where("forms > 2")
    both = words.where("length(word) > 2").select("word", "a", "b").unionByName(stems.select("word", "a", "b"))
    both = both.select("word", F.least("a", F.lit(n1)).alias("a"), F.least("b", F.lit(n0)).alias("b"))
    # A word must stand out among as many words as there are; that alone bounds how many do.
    bar = 2 * math.log(max(2, words.count())) + 6
    likely = both.where(F.col("a") * n0 > TIMES * F.col("b") * n1).where("a > 2").where(_stands_out(F.col("a"), F.col("b"), n1, n0, bar)).collect()
    ratio = {r["word"]: likelihood_ratio(r["a"], r["b"], n1, n0) for r in likely}
    chosen: dict[str, float] = {}
    value = {r["word"]: weight(r["a"], r["b"], n1, n0) for r in likely}
    alone = sorted(w for w in value if w[-1] != "*")
    for word in sorted(value, key=lambda w: (-ratio[w], -len(w), w)):
        if word[-1] == "*":
            own = [ratio[w] for w in alone[bisect_left(alone, word[:-1]):bisect_left(alone, word[:-1] + "\U0010ffff")]]
            nested = any(word[:n] + "*" in chosen for n in range(4, len(word) - 1)) or any(c[-1] == "*" and c.startswith(word[:-1]) for c in chosen)
            if nested or ratio[word] < 1.5 * max(own, default=0):
                continue
        chosen[word] = value[word]
    # Words of a stem are terms beside it: a stem has no near forms, its words have.
    return chosen


def _forms(words: DataFrame, model: ToxicityModel, n1: int, n0: int) -> None:
    """Weights of near forms that the sample shows more than twice, and the terms whose rarer near forms count."""

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = model.automaton()
        for batch in batches:
            hits = [automaton.find(w) for w in batch.column(0).to_pylist()]
            keep = pa.array([hit is not None and hit[1] > 0 for hit in hits], pa.bool_())
            found = batch.filter(keep)
            yield pa.RecordBatch.from_arrays([*found.columns, pa.array([hit[0] for hit in hits if hit is not None and hit[1] > 0], pa.string())], ["word", "a", "b", "term"])

    found = cut(in_arrow(words.select("word", "a", "b"), near, "word string, a long, b long, term string"))
    model.forms = {r["word"]: weight(r["a"], r["b"], n1, n0) for r in found.where("a + b > 2").collect()}
    # One or two sightings say little of a form, but all such forms of a term together say what words near it are.
    rare = {r["term"]: (r["a"], r["b"]) for r in found.where("a + b <= 2").groupBy("term").agg(F.sum("a").alias("a"), F.sum("b").alias("b")).collect()}
    terms = [t for t in model.weights if t[-1] != "*"]
    uses = {r["word"]: r["a"] for r in words.join(F.broadcast(words.sparkSession.createDataFrame([(t,) for t in terms], "word string")), "word").collect()}
    loose = set()
    for term in terms:
        a, b = rare.get(term, (0, 0))
        if math.log((MISSPELT * uses[term] + a) / (n1 + 1)) - math.log((b + 0.5) / (n0 + 1)) > NEAR:
            loose.add(term)
    model.loose = frozenset(loose)


def _context(sample: DataFrame, model: ToxicityModel, n1: int, n0: int) -> dict[str, float]:
    def around(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(model)
        for batch in batches:
            rows = Counter()
            for text, toxic in zip(batch.column(0), batch.column(1).to_pylist()):
                words, matches = matcher.matches(text.as_py())
                rows.update((w, toxic) for w in {x.strip(_EDGE) for at, _ in matches for x in window(words, at)} if w)
            out = list(rows.items())
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k, _ in out], pa.string()), pa.array([v * (k[1] > 0) for k, v in out], pa.int64()), pa.array([v * (k[1] == 0) for k, v in out], pa.int64())],
                ["word", "a", "b"])

    found = in_arrow(sample.select("text", "toxic"), around, "word string, a long, b long").groupBy("word").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    # Words of harmless matches: the more often beside clean matches, the less a match beside them says.
    a, b = F.least("a", F.lit(n1)), F.least("b", F.lit(n0))
    harmless = found.where("b >= 5").where(_stands_out(b, a, n0, n1, 25.0)).collect()
    ranked = {r["word"]: weight(r["a"], r["b"], n1, n0) for r in harmless}
    return {w: v for w, v in ranked.items() if v < 0 and w not in model.weights}


def _features(sample: DataFrame, model: ToxicityModel) -> tuple[np.ndarray, np.ndarray]:
    names = [f"f{i}" for i in range(FEATURES)]

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(model)
        for batch in batches:
            values = np.array([matcher.features(t.as_py()) for t in batch.column(0)], dtype=float).reshape(-1, FEATURES)
            yield pa.RecordBatch.from_arrays([*(pa.array(values[:, i]) for i in range(FEATURES)), batch.column(1)], [*names, "toxic"])

    schema = ", ".join(f"{n} double" for n in names) + ", toxic int"
    grouped = in_arrow(sample.select("text", "toxic"), compute, schema).groupBy(*names, "toxic").count().collect()  # at most one row per sampled document
    rows = np.array([[r[n] for n in names] for r in grouped], dtype=float).reshape(-1, FEATURES)
    return np.repeat(rows, [r["count"] for r in grouped], axis=0), np.repeat([float(r["toxic"] > 0) for r in grouped], [r["count"] for r in grouped])


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> tuple[np.ndarray, float]:
    """Ridge logistic regression by Newton steps; the bias is not shrunk."""
    x1 = np.hstack([x, np.ones((len(x), 1))])
    shrink = np.diag([ridge] * x.shape[1] + [1e-6])
    beta = np.zeros(x1.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x1 @ beta, -30, 30)))
        step = np.linalg.solve(x1.T * (p * (1 - p) + 1e-9) @ x1 + shrink, x1.T @ (y - p) - shrink @ beta)
        beta += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return beta[:-1], float(beta[-1])


def learn(docs: DataFrame, labels: DataFrame, most: int = MOST_LABELLED) -> ToxicityModel:
    """A model from the labels of documents that are not held out. ``docs``: doc_id, text; ``labels``: doc_id, toxic."""
    model = ToxicityModel()
    sample = cut(_sample(docs, labels, most))
    different = cut(_different(sample))
    sizes = dict(different.groupBy((F.col("toxic") > 0).alias("t")).count().collect())
    n1, n0 = sizes.get(True, 0), sizes.get(False, 0)
    if not n1 or not n0:
        model.bias = math.inf if n1 else -math.inf
        return model
    words = cut(_vocabulary(different))
    model.weights = _lexicon(words, n1, n0)
    _forms(words, model, n1, n0)
    model.context = _context(different, model, n1, n0)
    x, y = _features(sample, model)
    model.mean, deviation = x.mean(axis=0), x.std(axis=0)
    model.scale = np.where(deviation > 1e-9, deviation, 1.0)
    model.beta, model.bias = fit_logistic((x - model.mean) / model.scale, y)
    return model


def _scores(model: ToxicityModel, key: bytes, texts: pa.Array) -> np.ndarray:
    matcher = held(("matcher", key), lambda: Matcher(model))
    features = [matcher.features(t or "") for at in range(0, len(texts), TEXTS) for t in texts.slice(at, TEXTS).to_pylist()]
    return model.probability(np.array(features, dtype=float).reshape(-1, FEATURES))


def _key() -> bytes:
    import uuid

    return uuid.uuid4().bytes


def score(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every row of ``docs``."""
    key = _key()

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(_scores(model, key, batch.column(1)))], ["doc_id", "score"])

    scored = in_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), compute, "doc_id long, score double")
    out = F.coalesce(held_out(), F.lit(False))
    return scored.select("doc_id", out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, model: ToxicityModel, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that the model does not call toxic, with the columns of ``docs``. Only texts go to Python, only scores come back."""
    key = _key()

    def compute(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array(_scores(model, key, texts))

    compute.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    ship_package(docs.sparkSession)
    toxic = F.arrow_udf(compute, "double")
    return docs.where(toxic(F.col(text_col).cast("string")) < 0.5)
