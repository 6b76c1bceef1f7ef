"""Quality classifier from weak labels.

Heuristic labellers vote on every document. Expectation-maximisation over the counts of all
vote patterns estimates how often each labeller is right, and with that the posterior of
each pattern. The posteriors train a linear scorer on hashed word shapes, which judges every
document.
"""

from __future__ import annotations

import math
import re
import sys
import unicodedata
import zlib
from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tastegrid.functions.hashing import DRAW_SPACE, draw
from tastegrid.llm.shelf import Shelf
from tastegrid.llm.tokens import give_back, slices

# The functions below travel to the workers inside the task.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Frequent short words of four languages. Texts without any of them may be in another
# language, so the labeller that looks for them abstains there.
STOP_WORDS = frozenset(
    "the of and to in a is was for on that with as by at it are be from this "
    "le la les de des et un une du que qui dans pour sur au est par ne pas se "
    "der die das und zu den dem ein eine mit von im auf ist nicht als auch für sich es "
    "el los las del que y en un una por con no su al para lo se como más".split()
)
LABELLERS = ("symbols", "capitals", "echo", "decorated", "function_words", "bare_marks", "variety", "runs")
ACCEPT, ABSTAIN, REJECT = 1, 0, -1
SHAPE_BUCKETS = 512
# Words that the shares of a text are thinned by, so that a few words cannot decide.
PADDING = 8
# Characters whose words a task holds at a time.
TEXT_CHARS = 8_000_000
# Signs of plain prose, also in other scripts.
PROSE_SIGNS = frozenset(".,;:'’\"-()¿?¡" "।॥、。，！？：；「」،؛؟۔·«»“”„‘–—…")
# Latin capitals, then small letters, then a full stop or comma.
PLAIN = re.compile("([A-ZÀ-ÖØ-Þ]*)([a-zß-öø-ÿ]*)([.,]?)")


@dataclass(frozen=True)
class QualityConfig:
    """Settings of the classifier.

    ``train_docs`` bounds the sample the scorer is fitted on (about that many different texts,
    chosen by their hash); counts and votes always cover every document.
    """

    train_docs: int = 10_000
    min_score: float = 0.5
    em_rounds: int = 200
    max_iter: int = 40
    reg_param: float = 1e-4
    seed: int = 1


# ---- what is seen of a word ----


def _is_letter(c: str) -> bool:
    """Letters, and the marks that are written with them."""
    return c.isalpha() or c >= "\u0300" and unicodedata.category(c)[0] == "M"


def _shape(word: str) -> str:
    """Upper-case, lower-case and digit runs as one sign each; other signs at most twice.

    Letters of scripts without case, and marks, count as lower-case letters.
    """
    signs = []
    for c in word:
        kind = "X" if c.isupper() else "9" if c.isdigit() else "x" if _is_letter(c) else c
        if kind in "xX9":
            if signs[-1:] != [kind]:
                signs.append(kind)
        elif signs[-2:] != [kind, kind]:
            signs.append(kind)
    return "".join(signs)


def _bucket(shape: str) -> int:
    return zlib.crc32(shape.encode()) % (SHAPE_BUCKETS - 1)


def _word_facts(word: str) -> tuple[int, int, int, int, int, int, int]:
    """Bucket of the shape, letters, capitals, other signs, decorated, function word, bare."""
    plain = PLAIN.fullmatch(word)
    if plain:
        # Nearly all words; the general way gives the same.
        upper, lower, tail = plain.groups()
        shape = ("X" if upper else "") + ("x" if lower else "") + tail
        letters = len(upper) + len(lower)
        function = int((upper + lower).lower() in STOP_WORDS)
        return _bucket(shape), letters, len(upper), 0, 0, function, int(not letters)
    return _any_word_facts(word)


def _any_word_facts(word: str) -> tuple[int, int, int, int, int, int, int]:
    letters = sum(map(_is_letter, word))
    capitals = sum(map(str.isupper, word))
    strange = sum(not c.isalnum() and not _is_letter(c) and c not in PROSE_SIGNS for c in word)
    end = len(word) - len(word.rstrip("!#$%&*=~^|<>_+"))
    bare = word.strip(".,;:!?\"'()").lower()
    return (
        _bucket(_shape(word)),
        letters,
        capitals,
        strange,
        int(end >= 2),
        int(bare in STOP_WORDS),
        int(not letters and not any(map(str.isdigit, word))),
    )


def _band(share: np.ndarray, accept: float, reject: float) -> np.ndarray:
    """Votes of a labeller for which a low share speaks for the document."""
    return np.where(share <= accept, ACCEPT, np.where(share >= reject, REJECT, ABSTAIN))


@dataclass
class Seen:
    """A batch of texts: the words of each, by number of the distinct word."""

    codes: np.ndarray
    ends: np.ndarray
    facts: np.ndarray

    @property
    def echo(self) -> np.ndarray:
        """Whether a word repeats the one before it in the same text."""
        same = np.zeros(len(self.codes), dtype=bool)
        same[1:] = self.codes[1:] == self.codes[:-1]
        starts = self.ends[:-1]
        same[starts[starts < len(same)]] = False
        return same

    def total(self, values: np.ndarray) -> np.ndarray:
        """Sums of a number per word over each text."""
        sums = np.concatenate([[0], np.cumsum(values)])
        return sums[self.ends[1:]] - sums[self.ends[:-1]]

    @property
    def distinct(self) -> np.ndarray:
        """Distinct words of each text."""
        pairs = zip(self.ends[:-1], self.ends[1:])
        return np.array([len(np.unique(self.codes[a:b])) for a, b in pairs], dtype=np.int64)

    @property
    def longest_run(self) -> np.ndarray:
        """Length of the longest run of one word in each text."""
        place = np.arange(len(self.codes))
        begin = np.maximum.accumulate(np.where(self.echo, 0, place))
        pairs = zip(self.ends[:-1], self.ends[1:])
        length = place - begin + 1
        return np.array([length[a:b].max(initial=0) for a, b in pairs], dtype=np.int64)

    @property
    def words(self) -> np.ndarray:
        return np.diff(self.ends)


def look(texts: pa.Array) -> Seen:
    words = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    flat, ends = words.flatten(), np.asarray(words.offsets)
    real = np.asarray(pc.greater(pc.binary_length(flat), 0))
    place = np.concatenate([[0], np.cumsum(real)])
    coded = flat.filter(pa.array(real)).dictionary_encode()
    facts = np.array([_word_facts(w) for w in coded.dictionary.to_pylist()], dtype=np.int32)
    return Seen(np.asarray(coded.indices), place[ends - ends[0]], facts.reshape(-1, 7))


def votes(seen: Seen) -> np.ndarray:
    """One column per labeller. Texts without words get abstentions only."""
    words = np.maximum(seen.words, 1)

    def sums(fact: int) -> np.ndarray:
        return seen.total(seen.facts[seen.codes, fact])

    letters = np.maximum(sums(1), 1)
    short = seen.words < 8
    function = sums(5) / words
    cast = [
        _band(sums(3) / (letters + sums(3)), 0.02, 0.06),
        _band(sums(2) / letters, 0.15, 0.45),
        np.where(short, ABSTAIN, _band(seen.total(seen.echo) / words, 0.04, 0.20)),
        _band(sums(4) / words, 0.02, 0.20),
        np.where(short | (function == 0), ABSTAIN, np.where(function >= 0.10, ACCEPT, np.where(function <= 0.03, REJECT, ABSTAIN))),
        _band(sums(6) / words, 0.02, 0.10),
        np.where(short, ABSTAIN, _band(1 - np.log(np.maximum(seen.distinct, 1)) / np.log(words + 1), 0.25, 0.35)),
        _band(seen.longest_run, 2, 5),
    ]
    table = np.stack(cast, axis=1)
    table[seen.words == 0] = ABSTAIN
    return table


def features(seen: Seen) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Per text the filled buckets and their thinned shares of the words."""
    shapes = seen.facts[seen.codes, 0]
    echo = seen.total(seen.echo)
    for i, (start, end) in enumerate(zip(seen.ends[:-1], seen.ends[1:])):
        where, counts = np.unique(shapes[start:end], return_counts=True)
        size = end - start + PADDING
        yield np.append(where, SHAPE_BUCKETS - 1), np.append(counts, echo[i]) / size


# ---- the label model ----


# Starting point: each labeller's chances to accept, abstain and reject. A labeller knows one
# kind of flaw, so it passes many bad documents, but it seldom rejects a good one.
START_GOOD = (0.9, 0.08, 0.02)
START_BAD = (0.5, 0.1, 0.4)


@dataclass(frozen=True)
class LabelModel:
    """The share of good documents, and how each labeller votes on good and on bad ones."""

    prior: float
    good: tuple[tuple[float, float, float], ...]
    bad: tuple[tuple[float, float, float], ...]

    def posterior(self, pattern: tuple[int, ...]) -> float:
        """Probability that a document with these votes is good; abstentions say nothing."""
        log_odds = math.log(self.prior / (1 - self.prior))
        for vote, good, bad in zip(pattern, self.good, self.bad):
            if vote != ABSTAIN:
                seen_good, seen_bad = good[0] + good[2], bad[0] + bad[2]
                log_odds += math.log(good[1 - vote] / seen_good * seen_bad / bad[1 - vote])
        return 1 / (1 + math.exp(-max(-700.0, min(700.0, log_odds))))

    def accuracies(self) -> tuple[float, ...]:
        """How often each labeller is right when it votes."""
        found = []
        for good, bad in zip(self.good, self.bad):
            right = self.prior * good[0] + (1 - self.prior) * bad[2]
            wrong = self.prior * good[2] + (1 - self.prior) * bad[0]
            found.append(right / (right + wrong))
        return tuple(found)


def fit_label_model(counts: Mapping[tuple[int, ...], int], rounds: int = 200) -> LabelModel:
    """Expectation-maximisation over the numbers of documents with each vote pattern.

    Labellers vote independently given the truth. Counts are smoothed by one vote of each
    kind for each class.
    """
    n_labellers = len(LABELLERS)
    model = LabelModel(0.8, (START_GOOD,) * n_labellers, (START_BAD,) * n_labellers)
    for _ in range(rounds):
        weight = {True: 1.0, False: 1.0}
        cast = {side: [[1.0] * 3 for _ in range(n_labellers)] for side in weight}
        for pattern, n in counts.items():
            p = model.posterior(pattern)
            for side, share in ((True, n * p), (False, n * (1 - p))):
                weight[side] += share
                for votes_, vote in zip(cast[side], pattern):
                    votes_[1 - vote] += share
        tables = {
            side: tuple(tuple(x / sum(v) for x in v) for v in cast[side]) for side in weight
        }
        fresh = LabelModel(weight[True] / (weight[True] + weight[False]), tables[True], tables[False])
        if fresh == model:
            break
        model = fresh
    return model


# ---- the jobs ----


def _looks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Seen, pa.RecordBatch]]:
    """Pieces of the batches whose words fit in memory, seen."""
    for batch in batches:
        texts = batch.column("text")
        for low, high in slices(texts, TEXT_CHARS):
            yield look(texts.slice(low, high - low)), batch.slice(low, high - low)
        give_back()


def _codes(seen: Seen) -> np.ndarray:
    """The vote pattern of each text as one number."""
    return (votes(seen) + 1) @ (3 ** np.arange(len(LABELLERS)))


def _vote_job(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for seen, _ in _looks(batches):
        yield pa.RecordBatch.from_arrays([pa.array(_codes(seen), pa.int32())], names=["pattern"])


def pattern_of(code: int) -> tuple[int, ...]:
    return tuple(code // 3**j % 3 - 1 for j in range(len(LABELLERS)))


def _train_job(posteriors: np.ndarray) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for seen, _ in _looks(batches):
            rows = np.zeros((len(seen.words), SHAPE_BUCKETS))
            for row, (where, share) in zip(rows, features(seen)):
                row[where] = share
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(rows), pa.list_(pa.float64())), pa.array(posteriors[_codes(seen)])],
                names=["shares", "posterior"],
            )

    return run


def _scores(seen: Seen, weights: np.ndarray, bias: float) -> np.ndarray:
    """The linear scorer: a sum over the words of each text."""
    per_word = weights[seen.facts[seen.codes, 0]] + weights[-1] * seen.echo
    margin = bias + seen.total(per_word) / (seen.words + PADDING)
    return np.where(seen.words > 0, 1 / (1 + np.exp(-np.clip(margin, -700, 700))), 0.0)


def _score_job(weights: np.ndarray, bias: float, posteriors: np.ndarray) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for seen, batch in _looks(batches):
            score = _scores(seen, weights, bias)
            names = [n for n in batch.schema.names if n != "text"]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(n) for n in names), pa.array(posteriors[_codes(seen)]), pa.array(score)],
                names=[*names, "posterior", "score"],
            )

    return run


@dataclass(frozen=True)
class Classifier:
    """A fitted label model and scorer."""

    labels: LabelModel
    weights: tuple[float, ...]
    bias: float
    min_score: float

    def _posteriors(self) -> np.ndarray:
        return _all_posteriors(self.labels)

    def scores(self, docs: DataFrame, columns: str = "doc_id BIGINT") -> DataFrame:
        """``columns`` of each row with ``posterior`` and ``score``, without a shuffle."""
        names = [c.split()[0] for c in columns.split(",")]
        run = _score_job(np.array(self.weights), self.bias, self._posteriors())
        schema = f"{columns}, posterior DOUBLE, score DOUBLE"
        return docs.select(*names, "text").mapInArrow(run, schema)


def _all_posteriors(model: LabelModel) -> np.ndarray:
    codes = range(3 ** len(LABELLERS))
    return np.array([model.posterior(pattern_of(c)) for c in codes])


def fit(docs: DataFrame, config: QualityConfig = QualityConfig()) -> Classifier:
    """Fit both models on ``docs``; of its columns only ``text`` is read."""
    texts = docs.select("text")
    rows = texts.mapInArrow(_vote_job, "pattern INT").groupBy("pattern").count().collect()
    counts = {pattern_of(r["pattern"]): r["count"] for r in rows}
    model = fit_label_model(counts, config.em_rounds)
    share = min(1.0, config.train_docs / max(sum(counts.values()), 1))
    chosen = draw("train", config.seed, [F.coalesce("text", F.lit(""))]) < round(share * DRAW_SPACE)
    # Copies of one text are chosen together, so each text counts once.
    sample = texts.where(chosen).distinct()
    shelf = Shelf(docs.sparkSession)
    train = shelf.put(
        "train", sample.mapInArrow(_train_job(_all_posteriors(model)), "shares ARRAY<DOUBLE>, posterior DOUBLE")
    )
    sides = F.explode(
        F.array(
            F.struct(F.lit(1.0).alias("label"), F.col("posterior").alias("weight")),
            F.struct(F.lit(0.0).alias("label"), (1 - F.col("posterior")).alias("weight")),
        )
    )
    soft = train.select(array_to_vector("shares").alias("features"), sides.alias("side"))
    soft = soft.select("features", "side.label", "side.weight").where("weight > 1e-6")
    if soft.select("label").distinct().count() < 2:
        # One class only: nothing to learn, the prior decides.
        bias = math.log(model.prior / (1 - model.prior))
        return Classifier(model, (0.0,) * SHAPE_BUCKETS, bias, config.min_score)
    fitted = LogisticRegression(
        maxIter=config.max_iter, regParam=config.reg_param, weightCol="weight"
    ).fit(soft)
    shelf.drop("train")
    return Classifier(
        model, tuple(fitted.coefficients.toArray().tolist()), float(fitted.intercept), config.min_score
    )


def judged(docs: DataFrame, config: QualityConfig = QualityConfig()) -> DataFrame:
    """One row per input row: ``doc_id, posterior, score, kept``.

    A document is kept if its score is at least ``min_score``. A text without words, null
    or empty, has score 0 and is rejected. Rows that repeat are judged alike; doc_id may be
    null. Only ``doc_id`` and ``text`` are read. No rows give no rows.
    """
    model = fit(docs, config)
    ids = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return model.scores(ids).withColumn("kept", F.col("score") >= model.min_score)


def keep_good(docs: DataFrame, config: QualityConfig = QualityConfig()) -> DataFrame:
    """The documents that are kept, with all their columns in their order."""
    model = fit(docs, config)
    good = _filter_job(np.array(model.weights), model.bias, model.min_score)
    return docs.mapInArrow(good, docs.schema)


def _filter_job(weights: np.ndarray, bias: float, least: float) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for seen, batch in _looks(batches):
            yield batch.filter(pa.array(_scores(seen, weights, bias) >= least))

    return run
