"""Toxicity: a weighted finite-state pattern grammar over clauses.

Words are read as signs: I (insult), T (threat), Y (target, "you"), N (negation), R (reported speech) or O.  Four
transducers rewrite and weigh a clause's signs, one after another, as one composed machine:

* negation: after N, the next NEGATION_REACH signs are in its scope, where I becomes i and T becomes t;
* reported speech: from R to the clause's end I, T become i, t;
* insult and target: I weighs more once a Y was read, and a Y read after an I adds the rest;
* threat: a T counts in full with a Y in the clause and little without.

The weight of a clause is that of its path through the composition, with insult arcs weighted by how far each
speaks for toxic texts.  A logistic curve over a text's summed, largest and mean clause weight gives the score.

Threats, targets, negations and reporting verbs are fixed lists, and a word on them always reads as its sign; a
threat that also has an insult arc reads as both.  Insult arcs are learned: words, and beginnings of words, of
labelled texts, with log-odds of the texts that hold them.  The sample is bounded: at most
TRAIN_ROWS labelled rows, those with the smallest xxhash64 of their id; one half of them gives the arcs and the
other the curve.

Defined results: null and empty texts, which have no clause, get the score of weight 0; with no labelled rows the
fixed insults and curve are used; a null id or label is not learned from; repeated rows give one row each;
extra columns are ignored.  Whole texts are read, however long.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrylink.llm.common import id_and_text, is_held_out, map_batches
from quarrylink.llm.quality import labelled_sample

TRAIN_ROWS = 8000
THRESHOLD = 0.7
NEGATION_REACH = 3
STEM_LENGTHS = (5, 6, 7, 8)
LEAST_TEXTS = 4
LEAST_SHARE = 0.95

# The word lists of the grammar (English, French, German, Spanish).
INSULTS = "asshole bastard bitch cretin dumbass fool idiot imbecile jerk loser moron pathetic scum stupid trash worthless connard crétin imbécile salaud arschloch dummkopf idiotin schwachkopf estúpido idiota imbécil pendejo".split()
THREATS = "kill murder hurt destroy burn stab shoot strangle tuer frapper brûler töten verletzen verbrennen matar golpear quemar".split()
TARGETS = "you your yours yourself u tu toi ton vous votre du dich dir dein ihr euch usted ustedes te ti tú".split()
NEGATIONS = "not no never none cannot don't doesn't isn't aren't won't pas jamais aucun nicht kein keine nie nunca ningún ninguna".split()
REPORTS = "said says say told tells wrote writes claimed claims quoted reported called dit disait écrit sagte sagt schrieb dijo dice escribió".split()
FIXED_WEIGHT, FIXED_CURVE = 3.0, (-3.0, 0.9, 0.5, 0.5)

WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?|[.!?;:,\n|]")
BREAKS = frozenset(".!?;:\n|,")
SIGNS = {**dict.fromkeys(THREATS, "T"), **dict.fromkeys(TARGETS, "Y"), **dict.fromkeys(NEGATIONS, "N"), **dict.fromkeys(REPORTS, "R")}


@dataclass
class Transducer:
    """``step(state, sign)`` gives the next state, the sign written and its weight; ``final(state)`` a last weight."""

    start: object
    step: object
    final: object = field(default=lambda state: 0.0)


def compose(*machines: Transducer) -> Transducer:
    """The machine that feeds each one's output to the next and sums their weights."""

    def step(states, sign):
        total, after = 0.0, []
        for machine, state in zip(machines, states, strict=True):
            state, sign, weight = machine.step(state, sign)
            after.append(state)
            total += weight
        return tuple(after), sign, total

    return Transducer(tuple(m.start for m in machines), step, lambda states: sum(m.final(s) for m, s in zip(machines, states, strict=True)))


def negation() -> Transducer:
    def step(left, sign):
        kind, weight = sign
        if kind == "N":
            return NEGATION_REACH, sign, 0.0
        return max(0, left - 1), (kind.lower() if left and kind in "IT" else kind, weight), 0.0

    return Transducer(0, step)


def reported() -> Transducer:
    def step(inside, sign):
        kind, weight = sign
        return inside or kind == "R", (kind.lower() if inside and kind in "IT" else kind, weight), 0.0

    return Transducer(False, step)


def insult_and_target() -> Transducer:
    """State: whether a target was read, and the insult weight still open to one."""

    def step(state, sign):
        target, held = state
        kind, weight = sign
        if kind == "Y":
            return (True, 0.0), sign, 0.5 * held
        if kind == "I":
            return (target, 0.0 if target else held + weight), sign, weight * (1.5 if target else 1.0)
        return state, sign, 0.25 * weight if kind == "i" else 0.0

    return Transducer((False, 0.0), step)


def threat() -> Transducer:
    """State: threats and targets read, each as a flag."""

    def step(state, sign):
        kind, weight = sign
        return (state[0] or kind == "T", state[1] or kind == "Y"), sign, 0.0

    return Transducer((False, False), step, lambda state: FIXED_WEIGHT if all(state) else 0.1 if state[0] else 0.0)


GRAMMAR = compose(negation(), reported(), insult_and_target(), threat())


def clause_weight(signs: list[tuple[str, float]]) -> float:
    state, total = GRAMMAR.start, 0.0
    for sign in signs:
        state, _, weight = GRAMMAR.step(state, sign)
        total += weight
    return total + GRAMMAR.final(state)


@dataclass
class Lexicon:
    """Insult arcs: whole words, and stems that stand for all words they begin."""

    words: dict[str, float]
    stems: dict[str, float]

    def weight(self, word: str) -> float:
        return max([self.words.get(word, 0.0), *(self.stems.get(word[:n], 0.0) for n in STEM_LENGTHS if len(word) >= n)])

    def finder(self) -> ahocorasick.Automaton:
        found = ahocorasick.Automaton()
        for w in {*self.words, *self.stems, *THREATS}:
            found.add_word(w, len(w))
        found.make_automaton()
        return found


def text_weights(text: str | None, lexicon: Lexicon, finder: ahocorasick.Automaton) -> tuple[float, float, float]:
    """Summed and largest clause weight, and the sum for each hundred words; only texts that hold an arc's letters are read by the grammar."""
    if not text:
        return 0.0, 0.0, 0.0
    low = text.lower()
    if next(finder.iter(low), None) is None:
        return 0.0, 0.0, 0.0
    total = largest = 0.0
    clause, n, told, weight = [], 0, False, 0.0
    for word in [*WORD.findall(low), "."]:
        if word in BREAKS:
            if told:
                weight = clause_weight(clause)
                total, largest = total + weight, max(largest, weight)
            clause, told = [], False
            continue
        n += 1
        kind = SIGNS.get(word, "O")
        if kind in "TO" and (weight := lexicon.weight(word)):
            clause.append(("I", weight))
            told = True
        if kind != "O" or not weight:
            clause.append((kind, 0.0))
            told = told or kind == "T"
    return total, largest, 100 * total / max(n, 20)


@dataclass
class Grader:
    lexicon: Lexicon
    curve: tuple[float, float, float, float]

    def score(self, weights: tuple[float, float, float]) -> float:
        a, b, c, d = self.curve
        z = a + b * math.log1p(max(0.0, weights[0])) + c * math.log1p(max(0.0, weights[1])) + d * math.log1p(max(0.0, weights[2]))
        return 1 / (1 + math.exp(-min(40.0, max(-40.0, z))))


def arcs_of(text: str | None) -> set[str]:
    """Words, and stems marked by a star, that a text holds."""
    words = {w for w in WORD.findall((text or "").lower()) if w not in BREAKS}
    return words | {w[:n] + "*" for w in words for n in STEM_LENGTHS if len(w) >= n}


def lexicon_of(counts: dict[str, tuple[int, int]], toxic: int, clean: int) -> Lexicon:
    """From the toxic and clean texts that hold each arc."""

    def odds(arc: str) -> float:
        t, c = counts.get(arc, (0, 0))
        return math.log((t + 0.5) / (toxic + 1)) - math.log((c + 0.5) / (clean + 1))

    fixed = {w: FIXED_WEIGHT for w in INSULTS if not counts.get(w, (0, 0))[1]}
    good = {a: odds(a) for a, (t, c) in counts.items() if t >= LEAST_TEXTS and t >= LEAST_SHARE * (t + c) and odds(a) > 1}
    stems = {a[:-1]: w for a, w in good.items() if a.endswith("*")}
    stems = {s: w for s, w in stems.items() if not any(s[:n] in stems for n in STEM_LENGTHS if n < len(s))}
    return Lexicon(fixed | {a: w for a, w in good.items() if not a.endswith("*")}, stems)


def fit_curve(points: np.ndarray, labels: np.ndarray) -> tuple[float, float, float, float]:
    x = np.column_stack([np.ones(len(points)), np.log1p(np.maximum(points, 0))])
    at, ridge = np.zeros(4), np.diag([1e-3, 0.05, 0.05, 0.05])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ at, -40, 40)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (labels - p) - ridge @ at)
        at = at + np.clip(step, -2, 2)
    return tuple(float(v) for v in at)


def learn(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text", limit: int = TRAIN_ROWS) -> Grader:
    sample = labelled_sample(docs, labels, label_col, id_col, text_col, limit)
    # The same text counts once, and falls into one half with its copies.
    half = (F.xxhash64(F.coalesce("text", F.lit(""))) % 2 == 0).alias("half")
    sample = sample.select("text", "label", half).groupBy("text", "half").agg(F.max("label").alias("label"))

    def arcs():
        return lambda rows: {"arcs": [sorted(arcs_of(x)) for x in rows["text"]], "label": rows["label"]}

    first = sample.where("half")
    sizes = {r["label"]: r["count"] for r in first.groupBy("label").count().collect()}
    found = map_batches(first, arcs, "arcs array<string>, label int").select(F.explode("arcs").alias("arc"), "label")
    tally = found.groupBy("arc").agg(F.sum("label").alias("t"), F.sum(1 - F.col("label")).alias("c"))
    tally = tally.where((F.col("t") >= LEAST_TEXTS) & (F.col("t") >= LEAST_SHARE * (F.col("t") + F.col("c"))) | F.col("arc").isin(INSULTS))
    lexicon = lexicon_of({r["arc"]: (r["t"], r["c"]) for r in tally.collect()}, sizes.get(1, 0), sizes.get(0, 0))

    def weigh():
        finder = lexicon.finder()
        return lambda rows: {"weights": [text_weights(x, lexicon, finder) for x in rows["text"]], "label": rows["label"]}

    points = map_batches(sample.where("NOT half"), weigh, "weights array<double>, label int").toPandas()
    if points["label"].nunique() < 2:
        return Grader(lexicon, FIXED_CURVE)
    return Grader(lexicon, fit_curve(np.array(points["weights"].tolist()), points["label"].to_numpy(dtype=float)))


def score(docs: DataFrame, grader: Grader, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted, clause_weight.  The grammar's size is bounded by the labelled sample."""

    def make():
        finder = grader.lexicon.finder()

        def work(rows):
            found = [text_weights(x, grader.lexicon, finder) for x in rows["text"]]
            return {"doc_id": rows["doc_id"], "score": [grader.score(w) for w in found], "clause_weight": [w[0] for w in found]}

        return work

    done = map_batches(id_and_text(docs, id_col, text_col), make, f"doc_id {dict(docs.dtypes)[id_col]}, score double, clause_weight double")
    return done.select("doc_id", is_held_out("doc_id").alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "clause_weight")


def grade(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text", limit: int = TRAIN_ROWS) -> DataFrame:
    return score(docs, learn(docs, labels, label_col, id_col, text_col, limit), id_col, text_col)
