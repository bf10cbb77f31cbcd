"""Toxicity by a weighted finite-state grammar over the clauses of a text.

A text is read as a row of symbols: insults of three strengths, words of harm, intent, address, negation
and reported speech, other words, and ends of clauses. Five deterministic transducers are composed
into one: negation and reported speech mark what stands in their scope, address marks what is aimed at
somebody, threats match intent followed by harm, and insults match an insult under the marks it carries. What
a clause matches is counted once a clause, so a text is scored by its matched clauses, not by isolated
words; a match's weight depends on its strength and its marks.

Which words insult is learned from labelled texts: beginnings of words and whole words whose share in toxic
texts is reliably above that in others. The weights of the matches are those of a logistic model, fitted to
texts whose matches were found with words learned from the other half of the labelled texts.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.runtime import materialize

#: Labelled texts the model is learned from at most (half of each label), and words and beginnings it keeps.
FIT_ROWS, LEXICON = 12_000, 4_000
#: Lengths of beginnings; toxic texts a word must be found in; log odds from which it is weak, plain or strong.
STEMS, SUPPORT, LEVELS = range(3, 9), 3, (1.5, 3.0, 4.5)
#: Words that negation and address reach over, and words between intent and harm.
REACH, AIM, PLAN = 3, 4, 3

# Words of the grammar in English, German, French and Spanish.
NEGATIONS = "not no never without isn't aren't wasn't don't doesn't didn't nicht kein keine keinen nie niemals ohne ne pas jamais aucun sans ni nunca jamás sin tampoco"
REPORTS = "said says say told called calls wrote quoted alleged accused claimed reported sagte sagt nannte schrieb behauptete zitierte dit disait déclara appelait écrivit prétendait dijo dice llamó escribió afirmó citó"
ADDRESSES = "you your you're they he she du dich dir ihr euch sie er tu toi te vous ils il elle tú te vosotros usted ustedes ellos él ella"
INTENTS = "will gonna going shall i'll we'll werde werden wird vais allons va vont voy vamos van"
HARMS = "kill hurt destroy beat burn shoot stab punch töten umbringen schlagen verletzen verbrennen tuer frapper blesser brûler détruire matar golpear herir quemar destruir"

OTHER, NEGATION, REPORT, ADDRESS, INTENT, HARM, WEAK, PLAIN, STRONG, END = range(10)
SYMBOLS = 10
#: Marks are added to a symbol: negated, reported, aimed.
NEGATED, REPORTED, AIMED = 10, 20, 40
#: Matches: 1 to 12 are insults, three strengths by four contexts (plain, negated, reported, aimed); then threats, plain and aimed.
MATCHES = 15
GRAMMAR = {w: s for s, ws in ((NEGATION, NEGATIONS), (REPORT, REPORTS), (ADDRESS, ADDRESSES), (INTENT, INTENTS), (HARM, HARMS)) for w in ws.split()}
TOKEN = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?|[.!?;:\n]")


@dataclass
class Transducer:
    """A deterministic transducer: ``step(state, symbol)`` gives the next state and what is written; it starts in state 0."""

    step: Callable


def countdown(trigger: int, reach: int, mark: int) -> Transducer:
    """Marks the ``reach`` symbols after a trigger, up to the end of the clause."""

    def step(state: int, x: int) -> tuple[int, int]:
        kind = x % SYMBOLS
        if kind == END:
            return 0, x
        if kind == trigger:
            return reach, x
        return max(state - 1, 0), x + (mark if state else 0)

    return Transducer(step)


def to_clause_end(trigger: int, mark: int) -> Transducer:
    """Marks everything after a trigger up to the end of the clause."""

    def step(state: int, x: int) -> tuple[int, int]:
        kind = x % SYMBOLS
        return (0 if kind == END else 1 if kind == trigger else state), x + (mark if state and kind != END else 0)

    return Transducer(step)


def threats() -> Transducer:
    """Writes harm that follows intent as a match, a negative number; everything else passes."""

    def step(state: int, x: int) -> tuple[int, int]:
        kind = x % SYMBOLS
        if kind == END:
            return 0, x
        if kind == INTENT:
            return PLAN + 1, x
        if kind == HARM and state and not x // NEGATED % 2:
            return 0, -2 if x >= AIMED else -1
        return max(state - 1, 0), x

    return Transducer(step)


def insults() -> Transducer:
    """Writes the matches: of threats as they come, of insults by strength and marks; 0 for all else."""

    def step(state: int, x: int) -> tuple[int, int]:
        if x < 0:
            return 0, 12 - x
        kind, marks = x % SYMBOLS, x // SYMBOLS
        if kind not in (WEAK, PLAIN, STRONG):
            return 0, 0
        context = 2 if marks & 2 else 1 if marks & 1 else 3 if marks & 4 else 0
        return 0, 1 + 4 * (kind - WEAK) + context

    return Transducer(step)


def compose(first: Transducer, second: Transducer) -> Transducer:
    """The transducer that writes what the second makes of what the first writes."""

    def step(state, x: int):  # noqa: ANN001, ANN202
        a, b = state or (0, 0)
        a, y = first.step(a, x)
        b, z = second.step(b, y)
        return (a, b), z

    return Transducer(step)


def tabulate(machine: Transducer) -> list[list[tuple[int, int]]]:
    """The transducer's reachable states as a table: ``table[state][symbol]`` is (next state, what is written)."""
    number, todo, table = {0: 0}, [0], []
    while len(table) < len(todo):
        row = []
        for x in range(SYMBOLS):
            nxt, out = machine.step(todo[len(table)], x)
            if nxt not in number:
                number[nxt] = len(todo)
                todo.append(nxt)
            row.append((number[nxt], out))
        table.append(row)
    return table


def grammar_table() -> list[list[tuple[int, int]]]:
    return tabulate(reduce(compose, [countdown(NEGATION, REACH, NEGATED), to_clause_end(REPORT, REPORTED), countdown(ADDRESS, AIM, AIMED), threats(), insults()]))


def beginnings(word: str) -> list[str]:
    """What a word can be known by: itself, ended by a dollar, and its beginnings."""
    return [word + "$", *[word[:k] for k in STEMS if k < len(word)]]


@dataclass
class Lexicon:
    """Log odds of words and beginnings; ``symbol`` is a word's symbol. Words seen are kept, up to a bound."""

    odds: dict[str, float]
    known: dict[str, int] = field(default_factory=dict)

    def symbol(self, word: str) -> int:
        s = self.known.get(word)
        if s is None:
            if len(self.known) > 400_000:
                self.known.clear()
            z = max((self.odds.get(b, -9.0) for b in beginnings(word)), default=-9.0)
            s = WEAK + sum(z >= x for x in LEVELS) - 1 if z >= LEVELS[0] else GRAMMAR.get(word, OTHER)
            self.known[word] = s
        return s


#: Of a text: 1, the logarithm of its words, clauses a match (12 insults, 2 threats), words a hundred and different words of each strength.
FEATURES = 2 + (MATCHES - 1) + 6


def match_features(text: str | None, lexicon: Lexicon, table: list[list[tuple[int, int]]]) -> list[float]:
    """What the grammar matches in the whole text."""
    tokens = TOKEN.findall((text or "").lower())
    symbol, ends = lexicon.symbol, frozenset(".!?;:\n")
    row = [END if t in ends else symbol(t) for t in tokens]
    n = len(row) - row.count(END)
    out = [1.0, math.log1p(n)]
    if not any(s in row for s in (HARM, WEAK, PLAIN, STRONG)):
        return out + [0.0] * (FEATURES - 2)
    clauses, here, state = [0] * MATCHES, set(), 0
    for s in row:
        state, match = table[state][s]
        if match:
            here.add(match)
        elif s == END and here:
            for m in here:
                clauses[m] += 1
            here.clear()
    for m in here:
        clauses[m] += 1
    out += [math.log1p(c) for c in clauses[1:]]
    for strength in (WEAK, PLAIN, STRONG):
        out += [min(10.0, 100 * row.count(strength) / max(n, 1)), math.log1p(len({t for t, s in zip(tokens, row) if s == strength}))]
    return out


def fit_weights(x: np.ndarray, y: np.ndarray, shift: float, ridge: float = 1.0) -> np.ndarray:
    """Ridge logistic weights by Newton's method; the first one, the constant, is not held back and gets ``shift`` added."""
    w, hold = np.zeros(x.shape[1]), np.full(x.shape[1], ridge)
    hold[0] = 1e-3
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(hold), x.T @ (p - y) + hold * w)
        w -= step * min(1.0, 5 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-8:
            break
    w[0] += shift
    return w


@dataclass
class Toxicity:
    """A fitted model: log odds of words, weights of matches."""

    odds: dict[str, float]
    weights: np.ndarray

    def score(self, spark):  # noqa: ANN001, ANN201
        """A function of a text column: how likely the text is toxic."""
        shared = spark.sparkContext.broadcast((self.odds, self.weights))  # at most LEXICON words and FEATURES weights

        @F.pandas_udf("double")
        def scores(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            odds, w = shared.value
            lexicon, table = Lexicon(odds), grammar_table()
            for texts in batches:
                z = np.array([match_features(t, lexicon, table) for t in texts]).reshape(-1, FEATURES) @ w
                yield pd.Series(1 / (1 + np.exp(-np.clip(z, -30, 30))))

        return scores


def fit_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", fit_rows: int = FIT_ROWS) -> Toxicity:
    """Learn insults and weights from ``labels`` (``id_col`` and a label 0 or 1) and the texts they name.

    At most ``fit_rows`` labels take part, half of each kind, those with the smallest digests of their ids, so reruns
    agree; shares of the two kinds are counted over all labels. Only counts of words and numbers a text come to the
    driver. Null labels and ids are left out, ids labelled twice are toxic if one label says so, and a label without a
    text is left out. Without labels every text scores alike, below 0.5.
    """
    y = labels.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{label_col}`").cast("int").alias("y")).where("id IS NOT NULL AND y IN (0, 1)").groupBy("id").agg(F.max("y").alias("y"))
    y = y.withColumn("draw", F.md5(F.col("id").cast("string").cast("binary")))
    totals = {r["y"]: r["n"] for r in y.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    half = fit_rows // 2
    chosen = y.where("y = 1").orderBy("draw").limit(half).unionByName(y.where("y = 0").orderBy("draw").limit(half))
    chosen = materialize(chosen.select("id", "y", F.pmod(F.conv(F.substring("draw", 1, 7), 16, 10).cast("int"), F.lit(2)).alias("half")), "labelled")  # at most fit_rows
    texts = materialize(docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")).join(F.broadcast(chosen), "id"), "labelled_texts")

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pack(c: Counter) -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([{"key": k, "kind": s, "n": n} for (k, s), n in c.items()], pa.schema([("key", pa.string()), ("kind", pa.int32()), ("n", pa.int64())]))

        held: Counter = Counter()
        for b in batches:
            for text, label, part in zip(b.column("text"), b.column("y").to_pylist(), b.column("half").to_pylist()):
                words = {t for t in TOKEN.findall((text.as_py() or "").lower()) if len(t) > 1}
                held.update((k, 2 * part + label) for k in {k for w in words for k in beginnings(w)})
                held[("", 2 * part + label)] += 1  # texts
                if len(held) > 300_000:
                    yield pack(held)
                    held.clear()
        yield pack(held)

    kinds = [F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("n"))), F.lit(0)).alias(f"k{k}") for k in range(4)]
    counts = materialize(texts.select("text", "y", "half").mapInArrow(tally, "key string, kind int, n long").groupBy("key").agg(*kinds).where(f"key = '' OR k1 + k3 >= {SUPPORT}"), "word_counts")
    seen = [r for r in counts.where("key = ''").collect()]
    n = [sum(r[f"k{k}"] for r in seen) for k in range(4)]

    def learn(other: str, toxic: str, n_other: int, n_toxic: int) -> dict[str, float]:
        smooth = lambda c: F.expr(c) + F.lit(0.5)
        odds = F.log(smooth(toxic) / (n_toxic + 1)) - F.log(smooth(other) / (n_other + 1)) - F.sqrt(1 / smooth(toxic) + 1 / smooth(other))
        best = counts.where(f"key != '' AND {toxic} >= 2").withColumn("odds", odds).where(F.col("odds") >= LEVELS[0]).orderBy(F.desc("odds"), "key").limit(LEXICON)
        return {r["key"]: r["odds"] for r in best.collect()}

    halves = [learn("k0", "k1", n[0], n[1]), learn("k2", "k3", n[2], n[3])]
    whole = learn("(k0 + k2)", "(k1 + k3)", n[0] + n[2], n[1] + n[3])
    shared = docs.sparkSession.sparkContext.broadcast(halves)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, known = grammar_table(), [Lexicon(o) for o in shared.value]
        for b in batches:
            # each half is matched with the words of the other one
            x = [match_features(t.as_py(), known[1 - h], table) for t, h in zip(b.column("text"), b.column("half").to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.list_(pa.float64())), b.column("y")], names=["x", "y"])

    rows = texts.select("text", "y", "half").mapInArrow(measure, "x array<double>, y int").collect()  # at most fit_rows short rows, and those of repeated ids
    x, t = np.array([r["x"] for r in rows]).reshape(-1, FEATURES), np.array([r["y"] for r in rows], float)
    if not len(t):
        return Toxicity({}, np.r_[-2.0, np.zeros(FEATURES - 1)])
    order = np.lexsort(np.c_[x, t].T)  # the same sums on every run
    toxic, other = totals.get(1, 0), totals.get(0, 0)
    drawn = (t.sum() + 0.5) / (len(t) - t.sum() + 0.5)
    return Toxicity(whole, fit_weights(x[order], t[order], math.log((toxic + 0.5) / (other + 0.5)) - math.log(drawn)))
