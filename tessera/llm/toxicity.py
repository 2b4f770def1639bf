"""Toxicity by a weighted finite-state grammar over clauses.

Transducers over letters for insults, threats, targets, negators and reporting
words turn a word into a symbol; an insult's symbol is its level, by log odds
learned from labels. They feed a grammar composed of a transducer for negation,
one for reported speech and one for clauses, whose arcs carry the weights: an
insult is plain, aimed at somebody, denied or quoted, and a threat counts once
it has a target. A target may follow its insult, so a clause has several paths,
and its weight is that of the best one. A document's score is a logistic
function of the sum of its clauses' weights, fitted on the labelled rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tessera.llm.common import renamed, small_side, written
from tessera.llm.transducer import Transducer

# Words of the grammar in English, German, French and Spanish.
THREATS = "kill hurt destroy burn stab shoot beat strangle töten umbringen verletzen zerstören tuer blesser détruire frapper matar herir destruir golpear"
TARGETS = "you your yours yourself u du dich dir dein deine ihr euch tu toi te ton ta vous votre tú ti tus usted ustedes vosotros"
NEGATORS = "not never neither nor isnt arent wasnt dont nicht nie niemals kein keine ne jamais aucun nunca jamás tampoco"
REPORTERS = "said says wrote called claimed quoted sagte schrieb nannte dit écrit appelé dijo escribió llamó"

#: Levels of insults by their log odds, each a symbol.
LEVELS = {"1": 3.0, "2": 4.5, "3": 6.0}
INSULT, THREAT, TARGET, NEGATOR, REPORTER, OTHER = "".join(LEVELS), "T", "Y", "N", "R", "O"
SYMBOLS = INSULT + THREAT + TARGET + NEGATOR + REPORTER + OTHER
#: What the grammar finds in a clause.
EVENTS = {"i": "insult", "a": "aimed insult", "t": "threat", "d": "denied", "q": "quoted"}
#: Share of an insult's level that an arc of each kind weighs: aimed >= plain > quoted, and denied isn't above 0.
SHARES = {"i": 1.0, "a": 1.5, "q": 0.0, "d": -0.5}
#: Weight of a threat with a target, a prior: labels may show none.
THREAT_WEIGHT = 3.0
#: Taken by an arc that promises a target and returned by the target; a path that breaks the promise can't be the best.
PROMISE = 1000.0

#: In the lexicon: the end of a word, and a letter more after a stem.
END, MORE = "end", "more"

CLAUSES = re.compile(r"[.!?;\n]+")
WORDS = re.compile(r"[^\W\d_]+")

#: Stems are learned besides words: prefixes of these many letters.
STEMS = (4, 5, 6)
#: A word or stem counts if this many toxic documents have it and its log odds are this high, also at the lower end of
#: their confidence interval of this many standard errors.
LEAST, LOG_ODDS, SURE_ODDS, ERRORS = 4, 3.0, 1.0, 1.96
#: Labels are broadcast up to this size, else joined by a shuffle.
LABEL_BYTES = 64 << 20


def grammar() -> Transducer:
    """Negation, then reported speech, then clauses, as one transducer; an insult keeps its level up to the clause's arcs."""
    hidden = {"d": str.maketrans("123", "def"), "q": str.maketrans("123", "qrs")}  # a level that is denied or quoted
    negation = Transducer(0)
    for left in range(4):  # a negator reaches over three words
        negation.add(left, NEGATOR, 3)
        negation.add(left, OTHER + TARGET + REPORTER, max(left - 1, 0))
        for symbol in INSULT:
            negation.add(left, symbol, max(left - 1, 0), symbol.translate(hidden["d"]) if left else None)
        negation.add(left, THREAT, max(left - 1, 0), "u" if left else None)
    reported = Transducer("own")
    reported.add("own", REPORTER, "told")
    for symbol in INSULT:
        reported.add("told", symbol, "told", symbol.translate(hidden["q"]))  # to the end of the clause
    reported.add("told", THREAT, "told", "v")
    # a clause is in (words that a target still reaches, a threat without target, words left to keep a promise of one)
    clause = Transducer((0, False, 0))
    for near in range(5):  # a target reaches over four words
        for threat in (False, True):
            for owed in range(5):
                here, on = (near, threat, owed), (max(near - 1, 0), threat, max(owed - 1, 0))
                if owed == 1:  # the last word that can keep the promise: after it only the target's arc pays back
                    on = (*on[:2], -1)
                clause.add(here, OTHER + NEGATOR + REPORTER, on)
                for symbol, level in LEVELS.items():
                    for kind in "dq":
                        clause.add(here, symbol.translate(hidden[kind]), on, kind, SHARES[kind] * level)
                    if near or owed:
                        clause.add(here, symbol, on, "a", SHARES["a"] * level)
                    else:
                        clause.add(here, symbol, on, "i", SHARES["i"] * level)
                        clause.add(here, symbol, (*on[:2], 4), "a", SHARES["a"] * level - PROMISE)
                clause.add(here, "u", on, "d", SHARES["d"] * THREAT_WEIGHT)
                clause.add(here, "v", on, "q", SHARES["q"] * THREAT_WEIGHT)
                paid = PROMISE if owed else 0.0
                clause.add(here, TARGET, (4, False, 0), "t" if threat else None, paid + (THREAT_WEIGHT if threat else 0.0))
                if near:
                    clause.add(here, THREAT, (0, False, on[2]), "t", THREAT_WEIGHT)
                else:
                    clause.add(here, THREAT, (near, True, on[2]))
    return negation.compose(reported, SYMBOLS).compose(clause, SYMBOLS)


def lexicon(words: dict[str, str], stems: dict[str, str]) -> Transducer:
    """From letters to the symbol of a word, given after its end; a stem's symbol needs a letter more."""
    letters = Transducer("")
    for text, symbol in words.items():
        for n, letter in enumerate(text):
            letters.arcs[(text[:n], letter)] = [(text[: n + 1], "", 0.0)]
        letters.arcs[(text, END)] = [("", symbol, 0.0)]
    for text, symbol in stems.items():
        for n, letter in enumerate(text):
            letters.arcs[(text[:n], letter)] = [(text[: n + 1], "", 0.0)]
        letters.arcs[(text, MORE)] = [(text, symbol, LEVELS.get(symbol, 0.0))]
    return letters


@dataclass(frozen=True)
class Model:
    """Log odds of words and stems; slope and intercept of the logistic function over a text's weight."""

    words: dict[str, float]
    stems: dict[str, float]
    slope: float = 0.0
    intercept: float = -1.0

    def total(self, weight: float) -> float:
        return self.intercept + self.slope * math.log1p(weight)


def level_of(log_odds: float) -> str:
    """Symbol of the highest level that the log odds reach, the lowest one if none."""
    return max((symbol for symbol, least in LEVELS.items() if log_odds >= least), default=min(LEVELS))


class Scorer:
    """Finds and weighs the clauses of a text."""

    #: Words remembered by a worker before it forgets all.
    REMEMBERED = 150_000

    def __init__(self, model: Model) -> None:
        self.grammar = grammar()
        listed = {THREAT: THREATS, TARGET: TARGETS, NEGATOR: NEGATORS, REPORTER: REPORTERS}
        words = {word: symbol for symbol, some in listed.items() for word in some.split()}
        words.update((word, level_of(odds)) for word, odds in model.words.items())
        self.letters = lexicon(words, {stem: level_of(odds) for stem, odds in model.stems.items()})
        self.known: dict[str, str] = {}

    def lexical(self, word: str) -> str:
        """Symbol of a word in lower case: a whole word's before a stem's, the highest level of its stems."""
        found = self.known.get(word)
        if found is None:
            if len(self.known) > self.REMEMBERED:
                self.known.clear()
            found = self.known[word] = self._read(word)
        return found

    def _read(self, word: str) -> str:
        arcs, state, stem, level = self.letters.arcs, "", OTHER, -1.0
        for letter in word:
            more = arcs.get((state, MORE))
            if more and more[0][2] > level:
                _, stem, level = more[0]
            step = arcs.get((state, letter))
            if step is None:
                return stem
            state = step[0][0]
        end = arcs.get((state, END))
        return end[0][1] if end else stem

    def events(self, text: str | None) -> list[float]:
        """Sum of the weights of all clauses of a text, none below 0, then how often each kind of event comes."""
        counts = dict.fromkeys(EVENTS, 0.0)
        total = 0.0
        lower = (text or "").lower()
        lexical, marked = self.lexical, INSULT + THREAT
        if any(lexical(word) in marked for word in set(WORDS.findall(lower))):
            for clause in CLAUSES.split(lower):
                read = [lexical(word) for word in WORDS.findall(clause)]
                if any(symbol in marked for symbol in read):
                    outputs, weight = self.grammar.best(read)
                    total += max(weight, 0.0)
                    for out in outputs:
                        if out in counts:
                            counts[out] += 1
        return [total, *counts.values()]


def held_out(doc_id: Column) -> Column:
    """Rows kept from learning: every fifth by the checksum of the id's text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def _labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents to learn from, with toxic 0 or 1. A repeated label counts as toxic if one of its rows is."""
    known = written(labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic")))
    return docs.where(~held_out(F.col("doc_id"))).join(small_side(known, LABEL_BYTES, 24), "doc_id")


def _slices(batches: Iterator[pa.RecordBatch], rows: int = 500) -> Iterator[pa.RecordBatch]:
    """Few rows at a time: texts may be long, and as Python objects they take twice their size."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def _terms(text: str | None) -> set[tuple[str, bool]]:
    """Words and stems of a text; a stem is marked."""
    words = {word for word in WORDS.findall((text or "").lower()) if len(word) > 1}
    return {(word, False) for word in words} | {(word[:n], True) for word in words for n in STEMS if len(word) > n}


def _document_counts(rows: DataFrame) -> DataFrame:
    """(term, stem, n): documents with a term, added up per task before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in _slices(batches):
            for text in batch.column(0).to_pylist():
                counts.update(_terms(text))
            if len(counts) > 50_000:
                yield _counted(counts)
                counts = Counter()
        yield _counted(counts)

    return rows.select("text").mapInArrow(run, "term string, stem boolean, n long").groupBy("term", "stem").agg(F.sum("n").alias("n"))


def _counted(counts: Counter) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [
            pa.array([term for term, _ in counts], pa.string()),
            pa.array([stem for _, stem in counts], pa.bool_()),
            pa.array(list(counts.values()), pa.int64()),
        ],
        ["term", "stem", "n"],
    )


def _learned(labelled: DataFrame) -> Model:
    """Words and stems that mark toxic documents, with smoothed log odds as weights.

    A fixed count and the lower end of the log odds' confidence interval
    decide, so a word isn't taken by chance, nor left out because labels are many.
    """
    toxic = labelled.where("toxic = 1").dropDuplicates(["text"])  # copies would make rare words look frequent
    clean = labelled.where("toxic = 0")
    n_toxic, n_clean = toxic.count(), clean.count()
    if not n_toxic or not n_clean:
        return Model({}, {})
    with_term = _document_counts(toxic).where(F.col("n") >= LEAST)
    without = _document_counts(clean).withColumnRenamed("n", "other")
    rows = with_term.join(without, ["term", "stem"], "left").na.fill(0, ["other"])
    n, other = F.col("n") + 0.5, F.col("other") + 0.5
    rows = rows.select("term", "stem", (F.log(n / (n_toxic + 1)) - F.log(other / (n_clean + 1))).alias("odds"), F.sqrt(1 / n + 1 / other).alias("error"))
    words, stems = {}, {}
    for r in rows.where((F.col("odds") >= LOG_ODDS) & (F.col("odds") - ERRORS * F.col("error") >= SURE_ODDS)).collect():
        (stems if r["stem"] else words)[r["term"]] = r["odds"]
    return Model(words, stems)


def _measured(rows: DataFrame, model: Model, kept: str) -> DataFrame:
    """The kept column of each row and the events of its text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in _slices(batches):
            events = [scorer.events(text) for text in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(kept), pa.array(events, pa.list_(pa.float64()))], [kept, "events"])

    kind = rows.schema[kept].dataType.simpleString()
    return rows.select(kept, "text").mapInArrow(run, f"{kept} {kind}, events array<double>")


def _fitted(learned: Model, measured: DataFrame) -> Model:
    """The learned words with the logistic function of (events, toxic); more weight never lowers a score."""
    if not learned.words and not learned.stems:
        return learned
    # imported here, as the tasks load this module too and would each hold some 50 MB more
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.linalg import Matrices

    # one insult says nearly as much as ten: weights count by their logarithm
    features = array_to_vector(F.array(F.log1p(F.get("events", F.lit(0)))))
    rows = measured.select(features.alias("features"), F.col("toxic").cast("double").alias("label"))
    fit = LogisticRegression(regParam=0.0005, maxIter=50, lowerBoundsOnCoefficients=Matrices.dense(1, 1, [0.0])).fit(rows)
    return Model(learned.words, learned.stems, float(fit.coefficients[0]), float(fit.intercept))


def _score(events: Column, model: Model) -> Column:
    return 1 / (1 + F.exp(-(F.log1p(F.get(events, F.lit(0))) * F.lit(model.slope) + F.lit(model.intercept))))


def score(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted, weight, number of each event) for every row of docs.

    Learned from labelled rows that aren't held out; only the text is read for
    a score. Null and empty texts have no events and get the score of none, as
    have all rows if labels of one class are missing. Very long texts are read
    whole, clause by clause. Repeated rows are scored alike; an empty table gives
    an empty one; other columns, whatever their names, have no effect.
    """
    rows = renamed(docs, doc_id=doc_id, text=docs[text].cast("string"))
    learned = _learned(_labelled(rows, labels))
    measured = written(_measured(rows, learned, "doc_id"))
    model = _fitted(learned, _labelled(measured, labels))
    scored = measured.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), _score(F.col("events"), model).alias("score"), "events")
    kinds = [F.get("events", F.lit(i)).alias(name.replace(" ", "_")) for i, name in enumerate(["weight", *EVENTS.values()])]
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), *kinds)


def drop_toxic(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs that aren't predicted toxic, with all columns. The rows themselves aren't shuffled.

    Null and empty texts have no events and stay; very long texts are read
    whole; repeated rows go or stay alike; an empty table gives an empty one.
    """
    rows = renamed(docs, doc_id=doc_id, text=docs[text].cast("string"))
    labelled = _labelled(rows, labels)
    learned = _learned(labelled)
    model = _fitted(learned, written(_measured(labelled, learned, "toxic")))
    schema, n_columns = docs.schema, len(docs.columns)
    plain = docs.select(docs[text]).schema[0].dataType == StringType()
    at = docs.columns.index(text) if plain else n_columns  # else the text as a string comes along, as a last column

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(model)
        for batch in _slices(batches):
            stay = [model.total(scorer.events(x)[0]) < 0 for x in batch.column(at).to_pylist()]
            yield batch.select(list(range(n_columns))).filter(pa.array(stay, pa.bool_()))

    read = docs if plain else docs.select("*", docs[text].cast("string").alias("text read"))
    return read.mapInArrow(run, schema)
