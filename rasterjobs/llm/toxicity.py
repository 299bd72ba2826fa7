"""Toxicity: a learned lexicon matched with spelling errors, weighed by context.

Terms (words and word stems) whose documents are nearly all toxic are learned
from labelled rows and put into a trie. Levenshtein automata run along the trie:
a state is the set of (trie node, errors so far) that a prefix can reach, and its
successors are computed once and kept, which gives one deterministic automaton
for the whole lexicon. Each hit is weighed by the words around it: in quotation
marks or beside a verb of report it counts apart from abuse, beside a word of
address it counts again.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import slices, stage

#: Labelled rows used to learn the lexicon and the weights.
SAMPLE_ROWS = 16_000
#: Most learned words and, separately, stems.
MOST_TERMS = 2_000
STEM_LENGTHS = (4, 5, 6, 7)
#: Folds of the fit, and labels 1 under which a word needs fewer documents.
FOLDS, FEW = 10, 30
#: States of the automaton that are kept; it is built anew when there are more.
MOST_STATES = 100_000
#: Words of at least so many letters match with one error; shorter ones and stems exactly.
FUZZY_LENGTH = 5
WINDOW = 6
#: Words that a task remembers as clean or as hits.
KNOWN = 200_000

#: Words of address, words of report, quotation marks.
ADDRESS = frozenset("you your yours u ur du dich dir dein deine ihr euch tu te toi vous ton ta tes votre tú te ti usted ustedes vosotros eres".split())
REPORT = frozenset("said says say called calls quote quoted quotes wrote writes word term means sagte sagt nannte schrieb wort zitat dit dirait appelle écrit mot cite dijo dice llamó escribió palabra cita".split())
QUOTES = "\"'“”„«»‘’‹›"

_EDGE = re.compile(r"^[\W_]+|[\W_]+$")


def core(token: str) -> str:
    """A token without the marks at its ends."""
    return token if token.isalpha() else _EDGE.sub("", token)


# --------------------------------------------------------------------------
# Automaton


class Lexicon:
    """Deterministic automaton for words within one error of a term, or beginning with a stem."""

    def __init__(self, words: Iterable[str], stems: Iterable[str], fuzzy: int = FUZZY_LENGTH):
        self.children: list[dict[str, int]] = [{}]
        self.limit: list[int] = [-1]  # errors a word may have that ends at the node
        self.stem: list[bool] = [False]
        self.reach: list[int] = [-1]  # most errors useful below the node
        for w in words:
            self._add(w, 1 if len(w) >= fuzzy else 0, False)
        for w in stems:
            self._add(w, 0, True)
        self._forget()

    def _forget(self) -> None:
        self.states: dict[frozenset, int] = {}
        self.sets: list[frozenset] = []
        self.next: list[dict[str, int]] = []
        self.accept: list[int] = []  # least errors with which the state accepts, or -1
        self.ends: list[bool] = []  # a stem has been read: any continuation is a hit
        self.start = self._state(self._close({(0, 0)}))

    def _add(self, word: str, limit: int, stem: bool) -> None:
        node = 0
        self.reach[0] = max(self.reach[0], limit)
        for ch in word:
            if ch not in self.children[node]:
                self.children[node][ch] = len(self.children)
                self.children.append({})
                self.limit.append(-1)
                self.stem.append(False)
                self.reach.append(-1)
            node = self.children[node][ch]
            self.reach[node] = max(self.reach[node], limit)
        if stem:
            self.stem[node] = True
        else:
            self.limit[node] = max(self.limit[node], limit)

    def _close(self, items: set) -> frozenset:
        todo = list(items)
        while todo:  # letters missing from the word
            node, e = todo.pop()
            for child in self.children[node].values():
                x = (child, e + 1)
                if e + 1 <= self.reach[child] and x not in items:
                    items.add(x)
                    todo.append(x)
        return frozenset(items)

    def _state(self, items: frozenset) -> int:
        if items not in self.states:
            self.states[items] = len(self.sets)
            self.sets.append(items)
            self.next.append({})
            self.accept.append(min((e for n, e in items if e <= self.limit[n]), default=-1))
            self.ends.append(any(self.stem[n] and not e for n, e in items))
        return self.states[items]

    def _step(self, state: int, ch: str) -> int:
        out = set()
        for node, e in self.sets[state]:
            if e + 1 <= self.reach[node]:
                out.add((node, e + 1))  # a letter too many
            for c, child in self.children[node].items():
                cost = e + (c != ch)
                if cost <= max(self.reach[child], 0):
                    out.add((child, cost))
        return self._state(self._close(out)) if out else -1

    def match(self, word: str) -> int:
        """Errors of the best match (0 or 1), or -1."""
        if len(self.sets) > MOST_STATES:
            self._forget()
        state = self.start
        for ch in word:
            to = self.next[state].get(ch)
            if to is None:
                to = self.next[state][ch] = self._step(state, ch)
            if to < 0:
                return -1
            if self.ends[to]:
                return 0
            state = to
        return self.accept[state]


class Scanner:
    """Finds a document's hits; words known to be clean are skipped by set difference."""

    def __init__(self, words: list[str], stems: list[str]):
        self.lexicon = Lexicon(words, stems)
        self.clean: set[str] = set()
        self.hits: dict[str, int] = {}

    def features(self, text: str | None) -> list[float]:
        """Exact, misspelled, quoted and addressed hits, distinct terms, hits per hundred words (all damped)."""
        tokens = (text or "").lower().split()
        found = set(tokens)
        for t in found - self.clean:
            if t not in self.hits:
                errors = self.lexicon.match(c) if (c := core(t)) else -1
                if errors < 0:
                    self.clean.add(t)
                else:
                    self.hits[t] = errors
        bad = found & self.hits.keys()
        exact = fuzzy = quoted = addressed = 0
        if bad:
            for i, t in enumerate(tokens):
                if t in bad:
                    around = tokens[max(0, i - WINDOW) : i + WINDOW + 1]
                    if self._quoted(tokens, i) or any(core(x) in REPORT for x in around):
                        quoted += 1
                        continue
                    if self.hits[t]:
                        fuzzy += 1
                    else:
                        exact += 1
                    addressed += any(core(x) in ADDRESS for x in around)
        if len(self.clean) > KNOWN:
            self.clean.clear()
        if len(self.hits) > KNOWN:
            self.hits.clear()
        n = exact + fuzzy
        terms = len({core(t) for t in bad})
        return [math.log1p(exact), math.log1p(fuzzy), math.log1p(quoted), math.log1p(addressed), math.log1p(terms), min(100 * n / max(len(tokens), 1), 10.0) / 5]

    @staticmethod
    def _quoted(tokens: list[str], i: int) -> bool:
        """A quotation mark opens at or before the token and closes at or after it, within the window."""
        before = any(t[0] in QUOTES for t in tokens[max(0, i - WINDOW) : i + 1])
        after = any(t.rstrip(".,;:!?")[-1:] in QUOTES and t.rstrip(".,;:!?") for t in tokens[i : i + WINDOW + 1])
        return bool(before and after)


FEATURES = 6


# --------------------------------------------------------------------------
# Learning


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.05, rounds: int = 60) -> np.ndarray:
    """Weights (last: intercept) of a ridge logistic regression, by Newton steps."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    penalty = ridge * np.eye(len(w))
    penalty[-1, -1] = 1e-3
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + penalty, x.T @ (y - p) - penalty @ w)
        w += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return w


def learn_terms(labelled: DataFrame, folds: int, least: int) -> list[tuple[list[str], list[str]]]:
    """Words and stems whose documents are nearly all of label 1: without each fold's documents, and last with all.

    ``labelled`` has ``text``, ``label`` and ``fold`` (0 to ``folds - 1``). Words need
    ``least`` documents of label 1. Stems need ``least + 2`` and four words under
    them that occur with label 1, as inflected or joined forms do. A word may have
    one document of label 0 to twenty of label 1, a stem one to five: a document
    needs several hits of stems, as the weights will show. Terms have 3 to 40 letters.
    """

    def run(batches):
        for batch in slices(batches):
            words, labels, places = [], [], []
            for t, y, f in zip(batch.column("text"), batch.column("label").to_pylist(), batch.column("fold").to_pylist(), strict=True):
                new = sorted({c for x in set((t.as_py() or "").lower().split()) if 3 <= len(c := core(x)) <= 40})
                words += new
                labels += [y] * len(new)
                places += [f] * len(new)
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(labels, pa.int32()), pa.array(places, pa.int32())], ["word", "label", "fold"])

    def counts(one, zero, forms):
        """Documents of either label (and words with label 1) without each fold, and with all."""
        fold = [F.array(*(F.sum(F.when(F.col("fold") == k, x)) for k in range(folds))) for x in (one, zero)]
        return [F.sum(one).alias("one"), F.sum(zero).alias("zero"), *(f.alias(n) for f, n in zip(fold, ("ones", "zeros"), strict=True)), forms.alias("forms")]

    rows = labelled.select("text", "label", "fold").mapInArrow(run, "word string, label int, fold int")
    held = rows.groupBy("word", "fold").agg(F.sum("label").alias("y"), F.count("*").alias("n"))
    held = stage(held, "word-counts")
    words = held.groupBy("word").agg(*counts(F.col("y"), F.col("n") - F.col("y"), F.lit(0)))
    prefix = F.explode(F.array(*(F.when(F.length("word") > n, F.substring("word", 1, n)) for n in STEM_LENGTHS))).alias("stem")
    used = held.select(prefix, "word", "fold", "y", "n").filter("stem is not null")
    forms = F.size(F.collect_set(F.when(F.col("y") > 0, F.col("word"))))
    strong = used.groupBy("stem").agg(F.sum("y").alias("all")).filter(f"all >= {max(5, least + 2)}").select("stem")  # label 1 is rare in the sample
    stems = used.join(strong, "stem", "left_semi").groupBy(F.col("stem").alias("word")).agg(*counts(F.col("y"), F.col("n") - F.col("y"), forms))

    def best(table: DataFrame, rule: str) -> dict[int, list[str]]:
        without = [F.struct(F.lit(k).alias("fold"), (F.col("one") - F.coalesce(F.col("ones")[k], F.lit(0))).alias("one"), (F.col("zero") - F.coalesce(F.col("zeros")[k], F.lit(0))).alias("zero")) for k in range(folds)]
        every = F.struct(F.lit(folds).alias("fold"), F.col("one"), F.col("zero"))
        each = table.filter(f"one >= {least}").select("word", "forms", F.explode(F.array(*without, every)).alias("x")).select("word", "forms", "x.*").filter(rule)
        top = each.withColumn("place", F.row_number().over(W.partitionBy("fold").orderBy(F.desc("one"), "word"))).filter(F.col("place") <= MOST_TERMS)
        out: dict[int, list[str]] = {}
        for r in top.select("fold", "word").collect():  # at most MOST_TERMS for each fold
            out.setdefault(r.fold, []).append(r.word)
        return out

    found = best(words, f"one >= {least} and zero * 20 <= one")
    starts = best(stems, f"one >= {max(5, least + 2)} and forms >= 4 and zero * 5 <= one")
    terms = []
    for k in range(folds + 1):
        kept: list[str] = []
        for s in sorted(starts.get(k, []), key=lambda s: (len(s), s)):
            if not any(s.startswith(x) for x in kept):
                kept.append(s)
        terms.append((sorted(found.get(k, [])), sorted(kept)))
    return terms


class Model:
    def __init__(self, words: list[str], stems: list[str], weights: np.ndarray):
        self.words, self.stems, self.weights = words, stems, weights

    def score(self, features: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(features @ self.weights[:-1] + self.weights[-1], -30, 30)))


def _features(docs: DataFrame, terms: list[tuple[list[str], list[str]]], keep: list[str], finish, schema: str, which: str | None = None) -> DataFrame:
    """Features of every text by its list of terms (column ``which``, else the last), turned into columns by ``finish`` inside the tasks."""
    sent = docs.sparkSession.sparkContext.broadcast(terms)  # at most 2 * MOST_TERMS terms for each fold

    def run(batches):
        scanner, of = None, None
        for batch in slices(batches):
            x = []
            for t, k in zip(batch.column("text"), batch.column(which).to_pylist() if which else [-1] * batch.num_rows, strict=True):
                if scanner is None or k != of:  # one at a time is held
                    scanner, of = Scanner(*sent.value[k]), k
                x.append(scanner.features(t.as_py()))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), finish(np.array(x, float).reshape(-1, FEATURES))], [*keep, "out"])

    return docs.mapInArrow(run, schema)


def fit(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", label: str = "label", rows: int = SAMPLE_ROWS) -> Model:
    """Learn from at most ``rows`` labels (id, label), picked by a hash of the id.

    Labels other than 0 and 1, without an id or without a document are left out.

    The labels of each kind are dealt to ``FOLDS`` folds in turn. Weights come from
    each fold's documents with terms of the others, so that terms which are pure by
    chance lose weight; the final terms come from all. With fewer than ``FEW`` labels
    1 a word needs two documents of label 1, else three. Without both labels in the
    sample the score is the smoothed share of label 1 (0.5 without any rows).
    """
    h = F.xxhash64(F.col(doc_id), F.lit(1))
    chosen = labels.filter(F.col(label).isin(0, 1) & F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("_id"), h.alias("h"), F.col(label).cast("int").alias("label")).orderBy("h", "label").limit(rows)
    turn = F.row_number().over(W.partitionBy("label").orderBy("h", "_id"))  # of at most ``rows`` rows
    chosen = stage(chosen.withColumn("fold", ((turn - 1) % FOLDS).cast("int")), "chosen")
    texts = docs.select(F.col(doc_id).alias("_id"), F.col(text).cast("string").alias("text"))
    picked = stage(texts.join(F.broadcast(chosen), "_id").select("h", "text", "label", "fold").repartition(24, "fold", F.col("h") % 3).sortWithinPartitions("fold"), "labelled")  # at most ``rows`` ids
    positive = picked.filter("label = 1").count()
    terms = learn_terms(picked, FOLDS, 2 if positive < FEW else 3)
    got = _features(picked.select("text", "label", "fold"), terms, ["label"], lambda x: pa.array(x.tolist(), pa.list_(pa.float64())), "label int, out array<double>", "fold").collect()
    x, y = np.array([r.out for r in got]).reshape(-1, FEATURES), np.array([r.label for r in got], float)
    if len(set(y.tolist())) < 2:
        p = (y.sum() + 1) / (len(y) + 2)
        return Model(*terms[-1], np.array([0.0] * FEATURES + [math.log(p / (1 - p))]))
    return Model(*terms[-1], logistic(x, y))


def score(docs: DataFrame, model: Model, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, score`` for every document; null and empty texts score as texts without hits.

    A long text costs its words once; repeated rows repeat; a null id stays null.
    """
    d = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    kind = d.schema["doc_id"].dataType.simpleString()
    weights = model.weights

    def finish(x: np.ndarray) -> pa.Array:
        return pa.array(1 / (1 + np.exp(-np.clip(x @ weights[:-1] + weights[-1], -30, 30))))

    return _features(d, [(model.words, model.stems)], ["doc_id"], finish, f"doc_id {kind}, out double").withColumnRenamed("out", "score")
