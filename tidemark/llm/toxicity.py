"""Toxicity by a weighted finite-state grammar over clauses.

Transducers compose into one weighted machine that reads a clause word by word:

* *insult*: reads a word and writes its weight. The lexicon is learned: whole
  words and word stems (prefixes) whose log odds between toxic and other labelled
  texts are high.
* *threat*, *target*, *negation*, *reported speech*: read words of fixed lists and
  write marks.

The composed machine keeps as state how many words ago a negation was read,
whether speech is being reported (until the clause ends), and whether a target or
threat stands open. A path's weight is the sum over its matches: an insult counts
less within the reach of a negation or in reported speech, more with a target in
the clause; a threat counts only with a target. Clauses that match nothing weigh
nothing, and words outside clauses are never scored alone. A long text meets more
entries by chance, so the matches and their weight also count per 1000 words. A
logistic unit over these statistics of a text gives its score.

Words are read from all bytes of all texts, vectorised; only clauses that hold a
match run through the machine. Lexicon, unit and cut are fitted on the whole texts of
at most ``PER_CLASS`` labelled rows of either label: tasks count their words and
compute their statistics, and only numbers reach the driver. The lexicon is bounded
by ``LEXICON`` and goes to every task.

Defined results: null and empty texts have no clause and get the score of such
texts; every row is scored; without labelled rows of both kinds the lexicon is
empty and all texts score alike, below 0.7.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.labelled import best_cut, held_out, logistic, whole_sample
from tidemark.llm.shingles import list_array
from tidemark.llm.tables import documents, table
from tidemark.llm.words import BASES, NOT_ALNUM, U64, Words, mix, segment_hash, signed, slices, words_of

#: fixed values of the contract: training fold and the score from which on label 1 is told
MODULO, REST, TELL = 3, 1, 0.7
PER_CLASS = (4000, 2000)
#: bytes of word stems
STEMS = (4, 5, 6, 7, 8, 9)
#: a lexicon entry is in so many toxic sample texts, and so much likelier there
LEAST_TEXTS, LEAST_SHARE, LEAST_ODDS = 3, 0.025, 3.5
LEXICON = 20_000
#: words after a negation that it reaches
REACH = 3
#: weights of arcs
NEGATED, REPORTED, TARGETED, THREAT = 0.4, 0.5, 1.25, 3.0

# Words of the small hand-written transducers, in four languages.
NEGATION = "not no never neither nor without isn aren wasn don doesn didn nicht kein keine nie ohne ne pas jamais sans ni nunca sin tampoco".split()
REPORT = "said says say told wrote writes quoted quotes claims claimed called sagte sagt schrieb meinte dit disait écrit déclare dijo dice escribió afirma".split()
TARGET = "you your yours u they them he she him her these those people everyone du dich dir ihr euch sie tu toi vous ils elles usted ustedes tú ti ellos ellas".split()
THREATS = "kill hurt destroy beat shoot stab burn murder hang töten umbringen verletzen schlagen tuer frapper détruire brûler matar herir golpear quemar destruir".split()

OTHER, NEG, SAY, AIM, MENACE = range(5)
CLAUSE_ENDS = np.isin(np.arange(256), [ord(c) for c in ".,;:!?\n"])
FEATURES = 9
SCORES = "doc_id long, score double"


def lexical(words: Words, stems: tuple[int, ...] = STEMS) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Hash of each word, and for each stem length the words that are longer and the hash of their stem."""
    whole = words.hashes()
    out = []
    for n in stems:
        at = np.flatnonzero(words.ends - words.starts > n)
        raw = segment_hash(words.data.astype(U64) + U64(1), words.starts[at], words.starts[at] + n, BASES[0])
        out.append((at, mix(raw + U64(1000 + n))))
    return whole, out


def hash_list(words: list[str]) -> np.ndarray:
    return np.sort(words_of(pa.array(words), lower=True, blank=NOT_ALNUM).hashes())


@dataclass
class Grammar:
    keys: np.ndarray = field(default_factory=lambda: np.zeros(0, U64))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    unit: np.ndarray = field(default_factory=lambda: np.zeros(FEATURES + 1))
    scale: np.ndarray = field(default_factory=lambda: np.ones(FEATURES))
    cut: float = 1.0

    def insult(self, words: Words) -> np.ndarray:
        """The insult transducer: a weight per word, the largest of its matching entries."""
        whole, stems = lexical(words)
        weight = self._look_up(whole)
        for at, keys in stems:
            weight[at] = np.maximum(weight[at], self._look_up(keys))
        return weight

    def _look_up(self, keys: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.zeros(len(keys))
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.weights[at], 0.0)

    def features(self, column: pa.Array) -> np.ndarray:
        """Clause statistics of each text."""
        words = words_of(column, lower=True, blank=NOT_ALNUM)
        out = np.zeros((len(column), FEATURES))
        if not len(words.starts):
            return out
        insult, hashes = self.insult(words), words.hashes()
        mark = np.zeros(len(hashes), dtype=np.int8)
        for kind, known in MARKS:
            at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
            mark[known[at] == hashes] = kind
        # a clause ends at a mark between two words, and with the text
        ends = np.concatenate([[0], np.cumsum(CLAUSE_ENDS[words.data])])
        row = words.row()
        new = np.ones(len(hashes), dtype=bool)
        new[1:] = (row[1:] != row[:-1]) | (ends[words.starts[1:]] > ends[words.ends[:-1] - 1])
        clause = np.cumsum(new) - 1
        first = np.append(np.flatnonzero(new), len(hashes))
        for c in np.unique(clause[(insult > 0) | (mark == MENACE)]):
            span = slice(first[c], first[c + 1])
            weight, plain, negated, reported, threats = run_clause(insult[span].tolist(), mark[span].tolist())
            own = out[row[first[c]]]
            own[0] = max(own[0], weight)
            own[1] += weight
            own[2] += plain
            own[3] += negated
            own[4] += reported
            own[5] += threats
        # per 1000 words; an entry met in a long text says less
        number = np.diff(words.first)
        out[:, 6] = 1000 * np.bincount(row[insult > 0], minlength=len(column)) / np.maximum(number, 1)
        out[:, 7] = 1000 * out[:, 1] / np.maximum(number, 1)
        out[:, 8] = number
        return np.log1p(out)

    def scores(self, column: pa.Array) -> np.ndarray:
        x = self.features(column) / self.scale
        z = x @ self.unit[:-1] + self.unit[-1] - self.cut + np.log(TELL / (1 - TELL))
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


MARKS = [(NEG, hash_list(NEGATION)), (SAY, hash_list(REPORT)), (AIM, hash_list(TARGET)), (MENACE, hash_list(THREATS))]


def run_clause(insult: list[float], mark: list[int]) -> tuple[float, int, int, int, int]:
    """The composed machine over one clause: its weight, and how many matches took which arcs."""
    since, said, aimed, menace = REACH + 1, False, False, 0.0
    total, plain, negated, reported, threats = 0.0, 0, 0, 0, 0
    for weight, kind in zip(insult, mark, strict=True):
        since += 1
        arc = (NEGATED if since <= REACH else 1.0) * (REPORTED if said else 1.0)
        if weight:
            total += weight * arc
            negated += since <= REACH
            reported += said
            plain += since > REACH and not said
        if kind == NEG:
            since = 0
        elif kind == SAY:
            said = True
        elif kind == AIM:
            aimed = True
        elif kind == MENACE:
            menace += THREAT * arc
    if aimed:
        total *= TARGETED
        threats = int(menace > 0)
        total += menace
    return total, plain, negated, reported, threats


UNITS = "doc_id long, text_key long, y int, same long, units array<long>"


def unit_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The different words and stems of each whole text, and a hash of all of them."""
    for part in slices(batches):
        found = []
        for i in range(part.num_rows):
            whole, stems = lexical(words_of(part.column("text").slice(i, 1), lower=True, blank=NOT_ALNUM))
            found.append(np.unique(np.concatenate([whole, *[keys for _, keys in stems]])) if len(whole) else whole)
        same = [int.from_bytes(blake2b(x.tobytes(), digest_size=8).digest(), "little", signed=True) for x in found]
        units = list_array(signed(np.concatenate(found)), np.cumsum([0, *map(len, found)]))
        yield pa.RecordBatch.from_arrays(
            [*[part.column(c) for c in ("doc_id", "text_key", "y")], pa.array(same, pa.int64()), units],
            ["doc_id", "text_key", "y", "same", "units"],
        )


def learn_lexicon(sample: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and weights of words and stems that tell toxic texts."""
    # a copy says nothing new: of texts with the same words, the first in the sample's order counts
    first = F.min_by("y", F.struct(F.xxhash64("doc_id"), "doc_id", "text_key", "y")).alias("y")
    texts = sample.mapInArrow(unit_rows, UNITS).groupBy("same").agg(first, F.first("units").alias("units"))
    sizes = {r.y: r.n for r in texts.groupBy("y").agg(F.count("*").alias("n")).collect()}
    clean, toxic = sizes.get(0, 0), sizes.get(1, 0)
    counts = texts.select("y", F.explode("units").alias("unit")).groupBy("unit").agg(F.sum("y").alias("n"), F.sum(1 - F.col("y")).alias("other"))
    odds = F.log((F.col("n") + 0.5) / (toxic + 1)) - F.log((F.col("other") + 0.5) / (clean + 1))
    found = (
        counts.where(F.col("n") >= max(LEAST_TEXTS, LEAST_SHARE * toxic))
        .select("unit", odds.alias("odds"))
        .where(F.col("odds") >= LEAST_ODDS)
        .orderBy(F.desc("odds"), "unit")
        .limit(LEXICON)
        .toArrow()
    )
    keys, weights = found.column("unit").to_numpy().view(U64), found.column("odds").to_numpy()
    order = np.argsort(keys)
    return keys[order], weights[order]


def feature_rows(grammar: Grammar):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            x = grammar.features(part.column("text"))
            bounds = np.arange(len(x) + 1) * FEATURES
            yield pa.RecordBatch.from_arrays(
                [*[part.column(c) for c in ("doc_id", "text_key", "y")], list_array(x.ravel(), bounds)], ["doc_id", "text_key", "y", "x"]
            )

    return rows


def learn(sample: DataFrame) -> Grammar:
    """A grammar fitted on whole texts: ``sample`` has doc_id, text_key, y and text."""
    if sample.select("y").distinct().count() < 2:
        return Grammar()
    grammar = Grammar(*learn_lexicon(sample))
    # FEATURES numbers of each row, in an order that does not depend on the layout
    found = sample.mapInArrow(feature_rows(grammar), "doc_id long, text_key long, y int, x array<double>").toArrow()
    found = found.sort_by([("doc_id", "ascending"), ("text_key", "ascending"), ("y", "ascending")])
    x, y = np.array(found.column("x").to_pylist()), found.column("y").to_numpy().astype(np.int64)
    grammar.scale = np.where(x.std(axis=0) > 0, x.std(axis=0), 1)
    grammar.unit = logistic(x / grammar.scale, y)
    # telling a clean text toxic costs twice as much as missing a toxic one
    grammar.cut = best_cut(x / grammar.scale @ grammar.unit[:-1] + grammar.unit[-1], y, cost_of_missing_one=0.5)
    return grammar


def score_rows(grammar: Grammar):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(grammar.scores(part.column("text")))], ["doc_id", "score"]
            )

    return rows


def train(docs: DataFrame, labels: DataFrame) -> Grammar:
    return learn(whole_sample(docs, labels, "toxic", ~held_out(MODULO, REST), PER_CLASS))


def toxicity_scores(docs: DataFrame, grammar: Grammar) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of ``docs`` (doc_id, text)."""
    scored = docs.select("doc_id", "text").mapInArrow(score_rows(grammar), SCORES)
    return scored.select(
        "doc_id",
        held_out(MODULO, REST).alias("held_out"),
        "score",
        (F.col("score") >= TELL).cast("int").alias("predicted"),
    )


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document by the learned grammar."""
    docs = documents(spark, sf_dir)
    return toxicity_scores(docs, train(docs, table(spark, sf_dir, "labels")))
