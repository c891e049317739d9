"""Toxicity: a learned lexicon, Levenshtein automata intersected with its trie, context windows.

The lexicon comes from labelled documents: words and word beginnings that toxic documents have
far more often than others. Its words go into a trie, on which a Levenshtein automaton of one
edit runs, determinized as it is used; beginnings (stems of a language's words) match exactly. A
word stays in the lexicon beside its own stems, so that its misspellings are found.
A document's hits are told apart by exact word, stem and misspelling, and by their context
windows: a hit in a quotation weighs for itself, and hits that stand close together weigh more.
A logistic model of these features gives the score.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import crc_of_id, cut, lean, small_batches, table

#: Labelled rows that the model is fitted on: those with the smallest hashes of their ids.
SAMPLE = 20_000
#: A term's least share of toxic documents, their least number, and how many times as often they must have it.
#: The share was chosen by three folds of the rows that are not held out.
SUPPORT, LEAST, RATIO = 0.03, 4, 10.0
#: Lengths of stems; words from this length on may be misspelt; tokens in a context window.
STEMS, FUZZY, WINDOW = range(4, 9), 5, 50
THRESHOLD = 0.3
TOKEN = re.compile(r"[^\W_]+")
QUOTES = '"“”„«»'
SAID = frozenset("said says wrote writes called quote quoted quoting sagte schrieb dit écrit dijo escribió".split())
FEATURES = 7


class Automaton:
    """Recognizes the lexicon's words with at most one edit, and its stems, reading a token once.

    A state is a set of (trie node, edits); sets get numbers and their transitions are kept as
    they are met, so there are no more than the lexicon and the characters read allow.
    """

    def __init__(self, words: list[str], stems: list[str]):
        self.next: list[dict[str, int]] = [{}]
        self.words: set[int] = set()
        self.stems: set[int] = set()
        self.fuzzy: set[int] = set()
        for term, kind in [(w, "word") for w in words] + [(s, "stem") for s in stems]:
            at, path = 0, [0]
            for c in term:
                if c not in self.next[at]:
                    self.next[at][c] = len(self.next)
                    self.next.append({})
                at = self.next[at][c]
                path.append(at)
            (self.words if kind == "word" else self.stems).add(at)
            if kind == "word" and len(term) >= FUZZY:
                self.fuzzy.update(path)
        self.numbers: dict[frozenset, int] = {}
        self.sets: list[frozenset] = []
        self.moves: list[dict[str, int]] = []
        self.start = self._number(self._close({(0, 0)}))

    def _close(self, states: set) -> frozenset:
        """With letters left out, which takes an edit and no character."""
        return frozenset(states | {(n, 1) for at, e in states if e == 0 and at in self.fuzzy for n in self.next[at].values() if n in self.fuzzy})

    def _number(self, states: frozenset) -> int:
        if states not in self.numbers:
            self.numbers[states] = len(self.sets)
            self.sets.append(states)
            self.moves.append({})
        return self.numbers[states]

    def _step(self, state: int, c: str) -> int:
        new = set()
        for at, e in self.sets[state]:
            if at < 0 or at in self.stems and e == 0:
                new.add((-1, 0))  # a stem has been read: anything may follow
            if at < 0:
                continue
            if c in self.next[at] and (e == 0 or self.next[at][c] in self.fuzzy):
                new.add((self.next[at][c], e))
            if e == 0 and at in self.fuzzy:
                new.add((at, 1))
                new.update((n, 1) for n in self.next[at].values() if n in self.fuzzy)
        out = self._number(self._close(new)) if new else -1
        self.moves[state][c] = out
        return out

    def match(self, token: str) -> int:
        """0 none, 1 word, 2 stem, 3 misspelt word."""
        state = self.start
        for c in token:
            state = self.moves[state].get(c, -2) if c in self.moves[state] else self._step(state, c)
            if state < 0:
                return 0
        best = 0
        for at, e in self.sets[state]:
            if at in self.words and e == 0:
                return 1
            if at < 0 or at in self.stems and e == 0:
                best = 2
            elif at in self.words:
                best = best or 3
        return best


@dataclass
class Model:
    words: list[str]
    stems: list[str]
    weights: list[float] = field(default_factory=lambda: [0.0] * FEATURES)
    bias: float = 0.0


def terms_of(text: str) -> set[str]:
    """Words (ending in $) and beginnings of longer words."""
    out = set()
    for w in set(TOKEN.findall(text.lower())):
        if len(w) >= 3:
            out.add(w + "$")
        out.update(w[:k] for k in STEMS if len(w) > k)
    return out


def count_terms(only: frozenset | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            count: Counter[str] = Counter()
            for text in batch.column(0):
                found = terms_of(text.as_py() or "")
                count.update(found if only is None else found & only)
                if len(count) > 200_000:
                    yield pa.RecordBatch.from_arrays([pa.array(count.keys(), pa.string()), pa.array(count.values(), pa.int64())], names=["term", "n"])
                    count.clear()
            yield pa.RecordBatch.from_arrays([pa.array(count.keys(), pa.string()), pa.array(count.values(), pa.int64())], names=["term", "n"])

    return run


def telling(toxic: int, clean: int, n_toxic: int, n_clean: int) -> bool:
    return (toxic + 0.5) / (n_toxic + 1) >= RATIO * (clean + 0.5) / (n_clean + 1)


def choose(toxic: dict[str, int], clean: dict[str, int], n_toxic: int, n_clean: int) -> Model:
    """Of the terms that are far more frequent in toxic documents, all words, and the longest stems with the same documents, none of which begins with another."""
    good = {t: n for t, n in toxic.items() if telling(n, clean.get(t, 0), n_toxic, n_clean)}
    longer = {t[:-1]: n for t, n in sorted(good.items(), key=lambda x: x[1])}
    good = {t: n for t, n in good.items() if t.endswith("$") or longer.get(t, 0) < 0.9 * n}
    kept: list[str] = []
    stems: set[str] = set()
    for t in sorted(good, key=lambda t: (len(t), t)):
        if t.endswith("$"):
            kept.append(t)
        elif not any(t[:k] in stems for k in range(min(STEMS), len(t))):
            kept.append(t)
            stems.add(t)
    return Model(sorted(t[:-1] for t in kept if t.endswith("$")), sorted(stems))


class Reader:
    """Features of texts by one model."""

    def __init__(self, model: Model):
        self.model, self.automaton, self.known = model, Automaton(model.words, model.stems), {}

    def features(self, text: str) -> list[float]:
        text = text.lower()
        tokens = TOKEN.findall(text)
        known, match, any_ = self.known, self.automaton.match, False
        if len(known) > 200_000:
            known.clear()
        for t in set(tokens):
            k = known.get(t)
            if k is None:
                k = known[t] = match(t)
            any_ = any_ or k > 0
        if not any_:
            return [0.0] * FEATURES
        count, quoted, at = [0, 0, 0, 0], 0, []
        for i, m in enumerate(TOKEN.finditer(text)):
            if k := known[m.group()]:
                before, after = text[max(0, m.start() - 60) : m.start()], text[m.end() : m.end() + 60]
                said = any(w in SAID for w in tokens[max(0, i - 6) : i])
                if any(c in before for c in QUOTES) and any(c in after for c in QUOTES) and (said or before.count('"') % 2 == 1):
                    quoted += 1
                else:
                    count[k] += 1
                    at.append(i)
        at_ = np.array(at)
        dense = int((np.searchsorted(at_, at_ + WINDOW) - np.arange(len(at_))).max()) if at else 0
        return [*np.log1p(count[1:]), float(any(count[1:3])), np.log1p(quoted), np.log1p(dense), len(at) / max(1, len(tokens))]

    def score(self, features: np.ndarray) -> np.ndarray:
        z = features @ np.array(self.model.weights) + self.model.bias
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def featured(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(model)
        for batch in batches:
            x = [list(map(float, reader.features(t.as_py() or ""))) for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), batch.column(1)], names=["x", "y"])

    return run


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.1, steps: int = 50) -> tuple[np.ndarray, float]:
    """Ridge logistic regression by Newton steps."""
    x = np.column_stack((x, np.ones(len(x))))
    w, penalty = np.zeros(x.shape[1]), np.diag([ridge] * (x.shape[1] - 1) + [1e-3])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        move = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + penalty, x.T @ (y - p) - penalty @ w)
        w += move
        if np.abs(move).max() < 1e-8:
            break
    return w[:-1], float(w[-1])


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """From (doc_id, text) and (doc_id, toxic).

    Only the sample's rows are learned from, whatever the number of labels; what reaches the
    driver are their frequent terms and their features. Null labels or ids teach nothing, and of
    an id labelled twice the larger label counts. Without labels of both kinds every score is the
    share of toxic labels (0 without any).
    """
    small_batches(docs.sparkSession)
    y = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("y"))
    y = y.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    # the sample's size bounds what is broadcast and what is kept; copies of a text teach once
    rows = cut(docs.select("doc_id", "text").join(F.broadcast(y), "doc_id").select(F.coalesce("text", F.lit("")).alias("text"), "y").groupBy("text").agg(F.max("y").alias("y")))
    n = {r["y"]: r["count"] for r in rows.groupBy("y").count().collect()}
    n_toxic, n_clean = sum(v for k, v in n.items() if k), n.get(0, 0)
    if not n_toxic or not n_clean:
        share = n_toxic / max(1, n_toxic + n_clean)
        return Model([], [], bias=float(np.log((share + 1e-9) / (1 - share + 1e-9))))
    least = max(LEAST, int(SUPPORT * n_toxic))
    counted = rows.where("y > 0").select("text").mapInArrow(lean(count_terms(None)), "term string, n long").groupBy("term").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    toxic = {r["term"]: r["n"] for r in counted.collect()}
    counted = rows.where("y = 0").select("text").mapInArrow(lean(count_terms(frozenset(toxic))), "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))
    model = choose(toxic, {r["term"]: r["n"] for r in counted.collect()}, n_toxic, n_clean)
    got = rows.mapInArrow(lean(featured(model)), "x array<double>, y int").collect()
    w, b = logistic(np.array([r["x"] for r in got]), np.array([float(r["y"] > 0) for r in got]))
    model.weights, model.bias = w.tolist(), b
    return model


def score(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """df with score (0 to 1) and hits, by kind of features; columns of these names are replaced.

    Texts alone decide: equal texts have equal scores. A null text counts as empty, without hits.
    """
    small_batches(df.sparkSession)
    df = df.drop("score", "hits")
    kept = df.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(model)
        for batch in batches:
            x = np.array([reader.features(t.as_py() or "") for t in batch.column(batch.schema.get_field_index(text))], float).reshape(-1, FEATURES)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(reader.score(x)), pa.array(x.tolist(), pa.list_(pa.float64()))], names=[*batch.schema.names, "score", "hits"])

    return df.mapInArrow(lean(run), ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in kept) + ", score double, hits array<double>")


def held_out(doc_id):
    return F.pmod(crc_of_id(doc_id), F.lit(4)) == 2


def fitted(spark: SparkSession, sf_dir: str) -> Model:
    labels = table(spark, sf_dir, "labels").where(~held_out(F.col("doc_id"))).select("doc_id", "toxic")
    return fit(table(spark, sf_dir, "documents"), labels)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's score by the model that is fitted on the labelled rows that are not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = score(docs, fitted(spark, sf_dir))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
