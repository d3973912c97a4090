"""Toxicity by a weighted finite-state pattern grammar (operator 4).

Words become symbols (insult, threat, target, pointer, negation, report). Small transducers read the symbols
of a text: how near the last target, pointer and negation are, whether the clause is reported speech, whether an
insult or a threat is open, waiting for what completes it, and whether the text has insulted before.
`compose` joins them into one machine of product states, with an arc for every state and symbol. An arc may
open an insult or a threat with its word's weight, or complete a clause and emit that weight:

* aimed: an insult within `REACH` words of a person addressed or spoken of ("you idiot", "idiot that you are"),
* framed: one near an article, demonstrative or copula ("the idiot", "is pathetic"),
* repeated: one in a text that has had another insult,
* threat: a threat followed by a person within REACH words ("kill you").

Under negation or reported speech an arc's weight is lowered. Threats and insults are open in states of their own.
A word alone, which completes no clause, adds nothing. The score is the logistic function of the prior plus,
for each of the four patterns, its arc weight times what its clauses emitted.

Insults are the listed ones and those learned from labels: whole words and word stems (first letters)
whose frequency in toxic documents exceeds that in clean ones, by a likelihood ratio that chance would reach for less
than one of all entries. Pattern weights and prior are then fitted on the same rows. Learning takes a sample of
at most `SAMPLE` labelled rows (those with the least hash of the id), a parameter; what reaches the driver is
the lexicon, at most `LEXICON` entries, and four numbers a sampled row. Scoring reads nothing but the text.

Defined results: null or empty text gets the prior's score; labels that are null, or whose document is
missing, teach nothing; without labels the listed insults and standard weights work alone; repeated label rows
count each; repeated documents are scored each; very long texts are read whole; an empty table gives no rows;
other columns, whatever their names but `score`, pass through.
"""

from __future__ import annotations

import math
import re
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm.common import documents

SAMPLE = 20_000
LEXICON = 20_000
STEMS = (4, 5, 6, 7, 8)
#: Standard errors by which an entry's log odds are lowered to its weight, and the least weight kept.
CAUTION, LEAST_WEIGHT = 1.64, 3.0
CUT = 0.3

SYMBOLS = INSULT, THREAT, TARGET, POINTER, NEGATION, REPORT, OTHER, BREAK = range(8)
LISTED = {
    INSULT: "idiot idiots moron morons scum clown worthless pathetic trash loser losers stupid disgusting imbecile filth idiota imbécile abruti salaud connard dummkopf arschloch abschaum estúpido imbécil".split(),
    THREAT: "kill hurt destroy burn stab shoot punch beat murder strangle tuer umbringen töten matar".split(),
    TARGET: "you your yours u he she him her they them tu vous toi ton votre il elle du dich dein ihr euch sie er tú te usted ustedes vosotros él ella".split(),
    POINTER: "the a an this that these those such what is are was were der die das den dem ein eine ist sind war le la les un une ce cette est sont el los las una este esta es son".split(),
    NEGATION: "not never isn't aren't wasn't don't doesn't didn't nobody nicht kein keine niemals pas jamais nunca jamás tampoco".split(),
    REPORT: "said says wrote writes claimed claims quoted quotes reported reports called sagte schrieb behauptete dit écrit affirme dijo escribió afirmó".split(),
}
LISTED_WEIGHT = 4.0
THREAT_WEIGHT = 6.0
#: How many words a target, a pointer, a negation and an open insult or threat reach, and what negation and report do to a weight.
REACH = 3
NEGATION_FACTOR, REPORT_FACTOR = 0.25, 0.35
PATTERNS = AIMED, FRAMED, REPEATED, THREATENED = range(4)
#: Arc weights of the patterns where no labels teach others.
STANDARD = (1.25, 0.75, 1.0, 1.0)
#: What a text's clauses of one pattern may emit in all.
MOST = 12.0

TOKEN = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?|[.!?;\n]")
BREAKS = frozenset(".!?;\n")


def near(own: int) -> dict[tuple[int, int], int]:
    """A transducer whose state is how many words its last own symbol still reaches: {(state, symbol): state}."""
    return {(s, x): REACH if x == own else 0 if x == BREAK else max(s - 1, 0) for s in range(REACH + 1) for x in SYMBOLS}


def within(own: int) -> dict[tuple[int, int], int]:
    """A transducer that is in state 1 from its own symbol to the end of the clause."""
    return {(s, x): 0 if x == BREAK else 1 if x == own else s for s in (0, 1) for x in SYMBOLS}


def ever(own: int) -> dict[tuple[int, int], int]:
    """A transducer that is in state 1 from its own symbol on."""
    return {(s, x): 1 if x == own else s for s in (0, 1) for x in SYMBOLS}


def opened(own: int, closers: tuple[int, ...]) -> dict[tuple[int, int], int]:
    """A transducer that its own symbol opens for REACH words, and that a closer ends."""
    return {(s, x): 0 if x == BREAK or x in closers else REACH if x == own else max(s - 1, 0) for s in range(REACH + 1) for x in SYMBOLS}


MACHINES = {
    "target": near(TARGET), "pointer": near(POINTER), "negation": near(NEGATION), "report": within(REPORT),
    "insult": opened(INSULT, (TARGET, POINTER)), "threat": opened(THREAT, (TARGET,)), "insulted": ever(INSULT),
}

#: Registers of an arc: nothing, keep the word's weight for later, emit the word's weight, emit what was kept.
NOTHING, KEEP, EMIT, EMIT_KEPT = range(4)


def compose() -> tuple[list[list[tuple]], dict[tuple, int]]:
    """(arcs[state][symbol] = (next state, what to do with the insult register, with the threat register, pattern, factor), number of each product state)."""
    names, tables = list(MACHINES), list(MACHINES.values())
    sizes = [max(s for s, _ in t) + 1 for t in tables]
    number = {state: i for i, state in enumerate(product(*map(range, sizes)))}
    arcs: list[list[tuple]] = []
    for state in number:
        now = dict(zip(names, state))
        factor = (NEGATION_FACTOR if now["negation"] else 1.0) * (REPORT_FACTOR if now["report"] else 1.0)
        row = []
        for x in SYMBOLS:
            after = [t[s, x] for t, s in zip(tables, state)]
            insult = threat = NOTHING
            pattern = None
            if x == INSULT:
                insult, pattern = (EMIT, AIMED) if now["target"] else (EMIT, REPEATED) if now["insulted"] else (EMIT, FRAMED) if now["pointer"] else (KEEP, None)
                if insult == EMIT:
                    after[names.index("insult")] = 0  # complete: not open for a second time
            elif x == THREAT:
                threat = KEEP
            elif x in (TARGET, POINTER) and now["insult"]:
                insult, pattern = EMIT_KEPT, AIMED if x == TARGET else FRAMED
            if x == TARGET and now["threat"]:
                threat = EMIT_KEPT
            row.append((number[tuple(after)], insult, threat, pattern, factor))
        arcs.append(row)
    return arcs, number


ARCS, STATES = compose()
START = STATES[(0,) * len(MACHINES)]


class Grammar:
    """The composed transducers over a lexicon {word or "stem*": weight}, with the patterns' arc weights."""

    def __init__(self, lexicon: dict[str, float], prior: float, weights: tuple[float, ...] = STANDARD):
        self.words = {w: (kind, THREAT_WEIGHT if kind == THREAT else LISTED_WEIGHT) for kind, ws in LISTED.items() for w in ws}
        self.words |= {w: (INSULT, weight) for w, weight in lexicon.items() if not w.endswith("*")}
        self.stems = {w[:-1]: weight for w, weight in lexicon.items() if w.endswith("*")}
        self.prior, self.weights = prior, weights
        self.known: dict[str, tuple[int, float] | None] = {}

    def classify(self, word: str) -> tuple[int, float] | None:
        if word in BREAKS:
            return BREAK, 0.0
        own = self.words.get(word)
        best = max((self.stems.get(word[:n], 0.0) for n in STEMS if len(word) > n), default=0.0)
        return (INSULT, max(best, own[1] if own else 0.0)) if best else own

    def read(self, text: str | None) -> list[float]:
        """What the clauses of each pattern emit."""
        emitted = [0.0] * len(PATTERNS)
        if not text:
            return emitted
        known, marks = self.known, []
        if len(known) > 300_000:
            known.clear()
        danger = False
        for i, t in enumerate(TOKEN.findall(text.lower())):
            try:
                c = known[t]
            except KeyError:
                c = known[t] = self.classify(t)
            if c is not None:
                marks.append((i, c))
                danger = danger or c[0] <= THREAT
        if not danger:
            return emitted
        state, last, insult, threat = START, -1, 0.0, 0.0
        for i, (symbol, weight) in marks:
            for _ in range(min(i - last - 1, REACH)):
                state = ARCS[state][OTHER][0]
            last = i
            state, on_insult, on_threat, pattern, factor = ARCS[state][symbol]
            if on_insult == KEEP:
                insult = weight * factor
            elif on_insult == EMIT:
                emitted[pattern] += weight * factor
            elif on_insult == EMIT_KEPT:
                emitted[pattern] += insult
            if on_threat == KEEP:
                threat = weight * factor
            elif on_threat == EMIT_KEPT:
                emitted[THREATENED] += threat
        return [min(x, MOST) for x in emitted]

    def score(self, text: str | None) -> float:
        z = self.prior + sum(w * x for w, x in zip(self.weights, self.read(text)))
        return 1.0 / (1.0 + math.exp(-min(z, 30.0)))


def fitted(x: np.ndarray, y: np.ndarray, hold: float = 0.02) -> tuple[float, tuple[float, ...]]:
    """(prior, pattern weights) of a logistic regression by Newton steps, drawn towards STANDARD as by `hold` of the rows; weights are not negative."""
    a = np.column_stack([np.ones(len(x)), x])
    standard = np.array([math.log((y.sum() + 1) / (len(y) - y.sum() + 9)), *STANDARD])
    w = standard.copy()
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        pull = np.diag([1e-3, *[hold * len(y)] * len(STANDARD)])
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + pull, a.T @ (y - p) - pull @ (w - standard))
        w = w + step / max(1.0, np.abs(step).max())
        if np.abs(step).max() < 1e-6:
            break
    return float(w[0]), tuple(np.maximum(w[1:], 0.0).tolist())


def _stems(words: Column, n: int) -> Column:
    """The first n letters of longer words, marked as stems."""
    return F.transform(F.filter(words, lambda x: F.length(x) > n), lambda x: F.concat(F.substring(x, 1, n), F.lit("*")))


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, size: int = LEXICON) -> Grammar:
    """docs (doc_id, text), labels (doc_id, toxic) -> the grammar with its learned lexicon and arc weights."""
    chosen = labels.select("doc_id", "toxic").where("doc_id IS NOT NULL AND toxic IS NOT NULL").orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").limit(sample)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").where("text IS NOT NULL")  # at most `sample` pairs of numbers
    word = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}+)")))
    stems = F.flatten(F.array(*[_stems(F.col("w"), n) for n in STEMS]))
    entry = rows.select("toxic", word.alias("w")).select("toxic", F.explode(F.array_distinct(F.concat("w", stems))).alias("entry"))
    n = rows.agg(F.coalesce(F.sum("toxic"), F.lit(0)).alias("a"), F.coalesce(F.sum(1 - F.col("toxic")), F.lit(0)).alias("b")).first()
    counts = entry.groupBy("entry").agg(F.sum("toxic").alias("a"), F.sum(1 - F.col("toxic")).alias("b"))
    odds = F.log((F.col("a") + 0.5) / (n["a"] + 1)) - F.log((F.col("b") + 0.5) / (n["b"] + 1))
    sure = odds - CAUTION * F.sqrt(1 / (F.col("a") + 0.5) + 1 / (F.col("b") + 0.5))

    def part(seen: Column, share: float) -> Column:
        """A term of the likelihood ratio of an entry's count against what its share would be by chance."""
        return F.when(seen > 0, 2 * seen * F.log(seen / ((F.col("a") + F.col("b")) * share))).otherwise(0.0)

    toxic_share = n["a"] / max(n["a"] + n["b"], 1)
    ratio = part(F.col("a"), toxic_share) + part(F.col("b"), 1 - toxic_share)
    if not n["a"] or not n["b"]:
        return Grammar({}, -2.0)
    total = counts.count()
    found = (
        counts.where("a > 1").select("entry", sure.alias("weight"), odds.alias("odds"), ratio.alias("ratio"))
        .where((F.col("odds") >= LEAST_WEIGHT) & (F.col("ratio") >= 2 * math.log(max(total, 2)))).orderBy(F.desc("ratio"), "entry").limit(size).collect()
    )
    grammar = Grammar({r["entry"]: float(max(r["weight"], 0.5 * LEAST_WEIGHT)) for r in found}, -2.0)

    @F.pandas_udf("array<double>")
    def emitted(text: pd.Series) -> pd.Series:
        return text.map(grammar.read)

    seen = rows.select("toxic", emitted("text").alias("x")).collect()  # at most `sample` rows of four numbers
    grammar.prior, grammar.weights = fitted(np.array([r["x"] for r in seen]), np.array([r["toxic"] for r in seen], float))
    return grammar


def with_score(docs: DataFrame, grammar: Grammar) -> DataFrame:
    """docs with a column score, 0 to 1."""

    @F.pandas_udf("double")
    def score(text: pd.Series) -> pd.Series:
        return text.map(grammar.score, na_action=None).astype("float64") if len(text) else pd.Series([], dtype="float64")

    return docs.withColumn("score", score("text"))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def learn_outside(spark: SparkSession, sf_dir: str) -> Grammar:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return learn(documents(spark, sf_dir), labels.where(~held_out(F.col("doc_id"))))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = with_score(documents(spark, sf_dir).select("doc_id", "text"), learn_outside(spark, sf_dir))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
