"""Toxicity by a weighted finite-state grammar over clauses.

Small transducers read a clause, each word as a symbol (insult, threat verb, intent, target,
negation, turn, report, stress, other):

* insult: an insult word is a match; after a word of stress or another insult it is a stressed one;
* threat: a path of several words, a verb of harm and somebody addressed, with or without a word of
  intent, in any order and with other words between; the match is made where the path is complete;
* target: whether somebody is addressed, before the match or after it;
* negation: whether a negator stands at most three words before it; "but" ends its scope;
* report: whether the clause is reported speech, the reporting verb standing before or after.

What lies before a match is read from left to right, what lies after it from right to left. The
machines of either direction are composed into one table of reachable product states, and a third
table holds what a word emits between a left and a right state: a bimachine. It emits classes such
as "stressed insult, targeted, not negated, reported"; a text's score is a logistic function of the
weights collected under each class, not of isolated words. A clause is all that stands between two
stops; it may have any length and is read twice.

The insult words and their weights, and the classes' weights, are learned from labelled rows; the
words of the other machines are fixed lists.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import texthash
from .common import lean, materialize

#: Labelled rows to learn from, those of the smallest hash: the default of `sample_rows`, a bound on what is
#: learned, not on what is scored.
SAMPLE_ROWS = 20_000
LEAST_TEXTS = 3  # toxic training texts that an insult word must be in
LEAST_RATIO = 2.5  # natural logarithm of how much more frequent it must be in toxic texts

TARGETS = "you your yours yourself u ya du dich dir dein deine ihr euch tu te toi ton ta tes vous votre usted ustedes ti tus".split()
NEGATORS = "not no never none isn't aren't wasn't don't nicht kein keine nie niemals pas jamais ne nunca jamás tampoco".split()
TURNS = "but sondern aber mais sino pero".split()
REPORTERS = "said says say told wrote claimed quoted reported called sagte sagt schrieb berichtete dit disait écrit dijo dice escribió".split()
INTENTS = "will gonna going want wanna shall must i'll we'll werde werden will muss soll vais vas va veux dois voy vas quiero debo".split()
STRESS = "such so very total complete utter fucking damn real stupid dumb so sehr völlig total verdammt très vraiment si muy tan".split()
#: Stems of verbs of harm, and the endings that are put to them.
HARM_STEMS = "kill hurt destroy murder beat shoot stab töt verletz vernicht umbring erschieß bless détrui détruir tuer tue frapp mat hier herir destru golpe".split()
ENDINGS = ("", "s", "es", "ed", "ing", "ting", "e", "en", "et", "st", "t", "te", "ten", "er", "ez", "ons", "o", "a", "as", "an", "ar", "aré", "iré", "ir", "ire", "are", "erai")

OTHER, INSULT, HARM, INTENT, TARGET, NEGATION, TURN, REPORT, STRESSED = range(9)
SYMBOLS = 9
_WORDS = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?|[.!?;\n]")
_STOPS = frozenset(".!?;\n")
HARM_FORMS = frozenset(stem + end for stem in HARM_STEMS for end in ENDINGS if len(stem + end) > 3) - {"hier", "mate", "mat"}


class Transducer:
    """States 0.. with (state, symbol) -> next state, and the marks that a word of that symbol gets in that state."""

    def __init__(self, states: int, step: Callable[[int, int], tuple[int, frozenset[str]]]):
        self.table = {(s, a): step(s, a) for s in range(states) for a in range(SYMBOLS)}

    def compose(self, other: Transducer) -> Transducer:
        """Both machines read the same clause; marks are united. Only reachable states are kept."""
        number, todo = {(0, 0): 0}, [(0, 0)]
        table: dict[tuple[int, int], tuple[int, frozenset[str]]] = {}
        while todo:
            pair = todo.pop()
            for a in range(SYMBOLS):
                (p, x), (q, y) = self.table[pair[0], a], other.table[pair[1], a]
                if (p, q) not in number:
                    number[p, q] = len(number)
                    todo.append((p, q))
                table[number[pair], a] = (number[p, q], x | y)
        out = Transducer(0, lambda s, a: (0, frozenset()))
        out.table = table
        return out

    def arrays(self) -> tuple[list[list[int]], list[list[frozenset[str]]]]:
        states = 1 + max(s for s, _ in self.table)
        return (
            [[self.table[s, a][0] for a in range(SYMBOLS)] for s in range(states)],
            [[self.table[s, a][1] for a in range(SYMBOLS)] for s in range(states)],
        )


def _marks(*found: str | bool) -> frozenset[str]:
    return frozenset(f for f in found if isinstance(f, str))


def _seen(symbol: int, mark: str) -> Transducer:
    """Once `symbol` was read, every word carries `mark`."""
    return Transducer(2, lambda s, a: (1 if s or a == symbol else 0, _marks(bool(s) and mark)))


def _insult() -> Transducer:
    """An insult; stressed if the word before it is one of stress or an insult itself."""

    def step(s: int, a: int) -> tuple[int, frozenset[str]]:
        return (1 if a in (INSULT, STRESSED) else 0), _marks(a == INSULT and ("stressed" if s else "insult"))

    return Transducer(2, step)


def _threat() -> Transducer:
    """Harm 1, target 2, intent 4: the word that completes harm and target is a menace, with intent a
    threat; each further verb of harm is one more."""

    def step(s: int, a: int) -> tuple[int, frozenset[str]]:
        to = s | {HARM: 1, TARGET: 2, INTENT: 4}.get(a, 0)
        whole = to & 3 == 3 and (s & 3 != 3 or a == HARM)
        late = to == 7 and s == 3  # the intent comes last
        return to, _marks((whole or late) and ("threat" if to & 4 else "menace"))

    return Transducer(8, step)


def _negation(reach: int = 3) -> Transducer:
    """The `reach` words after a negator carry the mark, up to a turn."""

    def step(s: int, a: int) -> tuple[int, frozenset[str]]:
        to = reach if a == NEGATION else 0 if a == TURN else max(0, s - 1)
        return to, _marks(bool(s) and "negated")

    return Transducer(reach + 1, step)


KINDS = ("insult", "stressed", "menace", "threat")
CLASSES = 1 + 8 * len(KINDS)  # 0: nothing; then by kind the bits targeted 1, negated 2, reported 4


def grammar() -> tuple[list, list, list]:
    """left[state][symbol], right[state][symbol] and out[left state][symbol][right state], a class."""
    left = _insult()
    for part in (_threat(), _seen(TARGET, "targeted"), _negation(), _seen(REPORT, "reported")):
        left = left.compose(part)
    right = _seen(TARGET, "targeted").compose(_seen(REPORT, "reported"))
    left_to, left_marks = left.arrays()
    right_to, right_marks = right.arrays()

    def emitted(marks: frozenset[str]) -> int:
        kind = next((i for i, k in reversed(list(enumerate(KINDS))) if k in marks), None)
        if kind is None:
            return 0
        targeted = "targeted" in marks or kind >= 2  # a threat's path has its target
        return 1 + 8 * kind + targeted + 2 * ("negated" in marks) + 4 * ("reported" in marks)

    out = [
        [[emitted(left_marks[s][a] | right_marks[r][a]) for r in range(len(right_to))] for a in range(SYMBOLS)]
        for s in range(len(left_to))
    ]
    return left_to, right_to, out


class Scorer:
    """Clause features of texts, and their probability of being toxic."""

    def __init__(self, terms: dict[str, float], coefficients: np.ndarray | None = None):
        self._left, self._right, self._out = grammar()
        self._terms = terms
        self._symbols: dict[str, int] = {}
        for words, symbol in (
            (STRESS, STRESSED), (INTENTS, INTENT), (HARM_FORMS, HARM), (terms, INSULT), (TURNS, TURN),
            (REPORTERS, REPORT), (NEGATORS, NEGATION), (TARGETS, TARGET),
        ):
            self._symbols |= dict.fromkeys(words, symbol)
        self._hits = frozenset(w for w, a in self._symbols.items() if a in (INSULT, HARM))
        self.coefficients = coefficients

    def clause(self, words: list[str], out: list[float]) -> None:
        """Add what the bimachine emits for a clause to `out`."""
        symbols = [self._symbols.get(w, OTHER) for w in words]
        after, state = [0] * len(words), 0
        for i in range(len(words) - 1, -1, -1):
            after[i] = state
            state = self._right[state][symbols[i]]
        state = 0
        for w, symbol, right in zip(words, symbols, after, strict=True):
            kind = self._out[state][symbol][right]
            if kind:
                weight = self._terms[w] if symbol == INSULT and kind <= 16 else 1.0
                out[kind] += weight
                out[CLASSES] += weight
            state = self._left[state][symbol]

    def features(self, text: str) -> np.ndarray:
        """Weight collected under each class, and in all, and in all by 100 words; then log(1 + x)."""
        words = _WORDS.findall(text.lower())
        out = [0.0] * (CLASSES + 2)
        done = -1
        for i in [i for i, w in enumerate(words) if w in self._hits]:
            if i <= done:
                continue
            start = end = i
            while start > done + 1 and words[start - 1] not in _STOPS:
                start -= 1
            while end + 1 < len(words) and words[end + 1] not in _STOPS:
                end += 1
            self.clause(words[start : end + 1], out)
            done = end
        out[CLASSES + 1] = 100 * out[CLASSES] / max(1, len(words))
        return np.log1p(np.array(out))

    def score(self, text: str) -> float:
        z = float(self.features(text) @ self.coefficients[1:] + self.coefficients[0])
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def _fit(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Ridge logistic regression by Newton steps; intercept first. Targeted and stressed classes start
    above plain ones, negated and reported ones below, and stay there without evidence."""
    prior = np.zeros(x.shape[1] + 1)
    for kind, worth in enumerate((1.0, 1.2, 0.3, 1.0)):
        for bits in range(8):
            prior[2 + 8 * kind + bits] = worth * (1.3 if bits & 1 else 1.0) * (0.6 if bits & 2 else 1.0) * (0.6 if bits & 4 else 1.0)
    rate = (y.sum() + 0.5) / (len(y) + 1)
    prior[0] = math.log(rate / (1 - rate))
    ridge = np.full(len(prior), 1.0)
    ridge[0] = 0.01
    a, w = np.c_[np.ones(len(x)), x], prior.copy()
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        gradient = a.T @ (p - y) + ridge * (w - prior)
        hessian = (a * (p * (1 - p))[:, None]).T @ a + np.diag(ridge)
        change = np.linalg.solve(hessian, gradient)
        w -= change
        if np.abs(change).max() < 1e-6:
            break
    return w


def _sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, training: str, sample_rows: int) -> DataFrame:
    """(text, y, fold) of at most `sample_rows` labelled training rows; of repeated ids one text."""
    chosen = (
        labels.where(F.expr(training.format(id=f"`{id_col}`")) & F.col(label_col).isNotNull())
        .groupBy(F.col(id_col).alias("key"))
        .agg(F.max(label_col).cast("int").alias("y"))
        .orderBy(F.xxhash64("key"), "key")
        .limit(sample_rows)
    )
    chosen = chosen.withColumn("fold", F.pmod(F.xxhash64("key", F.lit(5)), F.lit(3)).cast("int"))
    rows = docs.select(F.col(id_col).alias("key"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.join(F.broadcast(chosen), "key")  # broadcast: sample_rows at most
    return rows.groupBy("key", "y", "fold").agg(F.min_by("text", F.xxhash64("text")).alias("text")).select("text", "y", "fold")


def learn(sample: DataFrame) -> Scorer:
    """Learn insult words and class weights from a bounded sample (text, y, fold).

    Word counts are summed and the words chosen in Spark: those far more frequent in toxic texts,
    their weight being the log ratio. The classes' weights are fitted on fold 0 with words from folds
    1 and 2, so they expect unseen texts; the words used afterwards come from all.
    """
    sample = materialize(sample)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[Counter] = [Counter() for _ in range(4)]
        for batch in batches:
            for text, y, fold in zip(*(batch.column(c).to_pylist() for c in ("text", "y", "fold")), strict=True):
                words = set(_WORDS.findall(text.lower())) - _STOPS
                held[0 if y else 1].update(words)
                if fold:
                    held[2 if y else 3].update(words)
        words = list(held[0].keys() | held[1].keys())
        for i in range(0, len(words), 100_000):
            part = words[i : i + 100_000]
            yield pa.RecordBatch.from_arrays(
                [pa.array(part, pa.string()), *(pa.array([h[w] for w in part], pa.int64()) for h in held)], ["word", "a", "b", "c", "d"]
            )

    totals = {(r["y"], r["fold"]): r["count"] for r in sample.groupBy("y", "fold").count().collect()}
    size = lambda y, folds: sum(totals.get((y, f), 0) for f in folds)
    counts = sample.mapInArrow(lean(count), "word string, a long, b long, c long, d long").groupBy("word")
    counts = counts.agg(*(F.sum(c).alias(c) for c in "abcd"))

    def ratio(p: str, n: str, folds: tuple[int, ...]):
        value = F.log((F.col(p) + 0.5) / (size(1, folds) + 1)) - F.log((F.col(n) + 0.5) / (size(0, folds) + 1))
        return F.when(F.col(p) >= LEAST_TEXTS, value)

    counts = counts.select("word", ratio("a", "b", (0, 1, 2)).alias("all"), ratio("c", "d", (1, 2)).alias("early"))
    found = counts.where(f"all >= {LEAST_RATIO} OR early >= {LEAST_RATIO}").collect()
    terms = lambda column: {r["word"]: min(r[column], 6.0) - 1.5 for r in found if (r[column] or 0) >= LEAST_RATIO}
    ready, early = Scorer(terms("all")), Scorer(terms("early"))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in texthash.slices(batches, "text"):
            x = [early.features(t).tolist() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("y"), pa.array(x, pa.list_(pa.float64()))], ["y", "x"])

    fit = sample.where("fold = 0").select("text", "y").mapInArrow(lean(measure), "y int, x array<double>").toArrow()
    x = np.array(fit.column("x").to_pylist(), np.float64).reshape(-1, CLASSES + 2)
    ready.coefficients = _fit(x, fit.column("y").to_numpy().astype(np.float64))
    return ready


TRAINING = "pmod(crc32(cast({id} as string)), 3) <> 1"


def toxicity_scores(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    *,
    label_col: str = "toxic",
    training: str = TRAINING,
    threshold: float = 0.7,
    sample_rows: int = SAMPLE_ROWS,
) -> DataFrame:
    """(<id_col>, held_out, score, predicted), one row per input row.

    labels: <id_col> and `label_col` (0 or 1; null rows are unlabelled; of repeated ids the
    larger label counts). training: SQL for the ids whose labels may be used, {id} stands for
    the id. sample_rows: the bound of labelled rows that are learned from (those of the smallest
    hash of the id; of a repeated id one text); all rows are scored, whole texts. score: from 0 to 1;
    null and empty texts get the score of a text without matches. Without any label the score is 0.5
    for texts without matches. Rows with a null id are held out. Repeated rows are scored each. A
    score equal to the threshold is predicted 1. Only the named columns are read. An empty table
    gives an empty result.
    """
    scorer = docs.sparkSession.sparkContext.broadcast(learn(_sample(docs, labels, id_col, text_col, label_col, training, sample_rows)))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = scorer.value
        for batch in texthash.slices(batches, "text"):
            scores = [of.score(t or "") for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("held_out"), pa.array(scores, pa.float64())], ["id", "held_out", "score"])

    rows = docs.select(
        F.col(id_col).alias("id"),
        (~F.coalesce(F.expr(training.format(id=f"`{id_col}`")), F.lit(False))).alias("held_out"),
        F.col(text_col).alias("text"),
    )
    id_type = rows.schema["id"].dataType.simpleString()
    scored = rows.mapInArrow(lean(score), f"id {id_type}, held_out boolean, score double")
    return scored.select(F.col("id").alias(id_col), "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def drop_toxic(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    *,
    label_col: str = "toxic",
    training: str = TRAINING,
    threshold: float = 0.7,
    sample_rows: int = SAMPLE_ROWS,
) -> DataFrame:
    """`docs` without the rows whose text scores `threshold` or more, in one pass after learning.

    Each row is judged by its own text: repeated and null ids don't matter, null texts count as empty
    and stay (unless most labelled texts are toxic), repeated rows stay or go together. All columns
    are kept as they are. An empty table stays empty.
    """
    scorer = docs.sparkSession.sparkContext.broadcast(learn(_sample(docs, labels, id_col, text_col, label_col, training, sample_rows)))
    at = docs.columns.index(text_col)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = scorer.value
        for batch in texthash.slices(batches, text_col):
            clean = [of.score(t or "") < threshold for t in batch.column(at).to_pylist()]
            yield batch.filter(pa.array(clean, pa.bool_()))

    return docs.mapInArrow(lean(keep), docs.schema)
