"""Toxicity by class-conditional Kneser-Ney language models.

Two models, of toxic and of ordinary documents, spell out each word of a text letter by letter, each letter given
up to ``HISTORY`` before it in the word; so an insult is known in forms that were never seen. A word's
log-likelihood ratio depends on the word alone and is kept (bounded cache); a text has two length-normalised
log-likelihoods, by word, of which only the difference counts.

The class models discount their own counts and leave the rest to one shared backoff distribution: Kneser-Ney
continuation counts (after how many different letters something was seen) of both classes together, interpolated
down to single letters. An expression that is rare in one class thus gets the same small mass from either model,
and what neither class has seen after a history counts only by what the two leave to the backoff there.

A text is its different words, in order of their first place: an echo says nothing new. Its score is the logistic
of four numbers: the difference of the two length-normalised log-likelihoods, the largest such difference in any
``WINDOW`` words (a few bad words in a long text move the first but little), that of its second most suspect word
(one chance likeness is no insult), and the logarithm of its length. Their weights come from sampled documents whose texts gave no counts.

Learning uses, of each class, at most ``SAMPLE`` labelled documents with different texts, in order of their
texts' hashes: two thirds for counts, one for the weights. A word counts once for each document. Spark does the
counting; nothing is pruned: what was seen once enters its class's counts and the continuation counts as all else.
The driver gets the counted strings of letters, bounded by the sample, as Arrow columns, and works on them as
arrays: a string is known by 64 mixed bits of its letters, and the model that is sent to tasks is two sorted arrays
of these with their ratios.

Defined cases: null and empty texts have difference 0; rows without an id are scored and never learned from;
labels other than 0 and 1, or null, are ignored; repeated rows and copies of a text teach once; of an id with several
texts each teaches; if the training
rows hold one class only (or none), every score is that class's (or 0.5).
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestrata.llm.quality import fold, share_of
from lodestrata.shipping import ship
from lodestrata.storage import materialise

SAMPLE, HISTORY, WINDOW, DISCOUNT, CACHED_WORDS, LONG_WORD = 3000, 7, 16, 0.75, 60_000, 64
TOXIC_SHARE = 0.3
_WORD = re.compile(r"[^\W\d_]+")
START, STOP = "^", "$"


_NONE = (np.empty(0, np.uint64), np.empty(0, np.float32))


def words_of(text: str | None) -> list[str]:
    """The text's different words, in order of their first place."""
    return list(dict.fromkeys(_WORD.findall((text or "").lower())))


def grams_of(word: str) -> list[str]:
    """Each letter of a word, and its end, led by its history."""
    spelt = START + word + STOP
    return [spelt[max(0, i - HISTORY) : i + 1] for i in range(1, len(spelt))]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _known_as(letters: np.ndarray) -> np.ndarray:
    """64 mixed bits for each row of code points; zeros before a string don't count."""
    out = np.zeros(len(letters), np.uint64)
    for column in letters.T:
        out = np.where(column != 0, _mixed(out + column.astype(np.uint64)), out)
    return out


def _spelt(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(code points of every gram of each word, right-aligned; which word it is of)."""
    flat = np.frombuffer("".join([START + w + STOP for w in words]).encode("utf-32-le"), np.uint32)
    sizes = np.array([len(w) + 2 for w in words])
    begins = np.cumsum(sizes) - sizes
    place = np.arange(len(flat)) - np.repeat(begins, sizes)
    at = np.arange(len(flat))[:, None] - np.arange(HISTORY, -1, -1)
    grams = np.where(np.arange(HISTORY, -1, -1) <= place[:, None], flat[np.maximum(at, 0)], 0)
    return grams[place > 0], np.repeat(np.arange(len(words)), sizes - 1)


def _at(known: np.ndarray, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place in the sorted array, whether it is there) of each value."""
    if not len(known):
        return np.zeros(len(asked), np.int64), np.zeros(len(asked), bool)
    place = np.minimum(np.searchsorted(known, asked), len(known) - 1)
    return place, known[place] == asked


@dataclass
class Models:
    """Log-likelihood ratios, toxic to ordinary: of letters after their history, and of histories that leave a letter to the
    backoff. Each is (sorted names of strings, their ratios)."""

    letters: tuple[np.ndarray, np.ndarray]
    histories: tuple[np.ndarray, np.ndarray]
    weights: np.ndarray = field(default_factory=lambda: np.array([-1.0, 4.0, 4.0, 0.0, 0.0]))
    constant: float | None = None

    def __post_init__(self) -> None:
        self.words: dict[str, float] = {}

    def __reduce__(self):
        return Models, (self.letters, self.histories, self.weights, self.constant)

    def ratios(self, words: list[str]) -> np.ndarray:
        """The log-likelihood ratio of each word."""
        grams, of = _spelt(words)
        history = _known_as(grams[:, :-1])
        place, there = _at(self.letters[0], _mixed(history + grams[:, -1].astype(np.uint64)))
        back, known = _at(self.histories[0], history)
        unseen = np.where(known, self.histories[1][back], 0.0) if len(self.histories[0]) else 0.0
        ratio = np.where(there, self.letters[1][place], unseen) if len(self.letters[0]) else np.zeros(len(of))
        return np.bincount(of, ratio, len(words))

    def learn_words(self, texts: list[list[str]]) -> list[str]:
        """Puts the ratios of all words of the texts into ``words``; gives those too long to be kept there."""
        if len(self.words) > CACHED_WORDS:
            self.words.clear()
        new = list({w for own in texts for w in own if w not in self.words})
        for at in range(0, len(new), 4096):
            some = new[at : at + 4096]
            self.words.update(zip(some, self.ratios(some).tolist(), strict=True))
        return [w for w in new if len(w) > LONG_WORD]

    def features(self, texts: list[str | None]) -> np.ndarray:
        """Mean difference by word, largest of any window, second largest of a word, and logarithm of the length, for each text."""
        out = np.zeros((len(texts), 4))
        for at in range(0, len(texts), 256):
            some = [words_of(t) for t in texts[at : at + 256]]
            sizes = np.array([len(w) for w in some])
            # Each text is followed by WINDOW places that count nothing.
            gap = [0.0] * WINDOW
            long = self.learn_words(some)
            ratio = np.array([x for own in some for part in (map(self.words.__getitem__, own), gap) for x in part])
            for word in long:
                del self.words[word]
            total = np.concatenate(([0.0], np.cumsum(ratio)))
            starts = np.concatenate(([0], np.cumsum(sizes + WINDOW)[:-1]))
            sums = total[starts + sizes] - total[starts]
            rolling = total[np.minimum(np.arange(len(ratio)) + WINDOW, len(ratio))] - total[:-1]
            places = np.arange(len(ratio)) - np.repeat(starts, sizes + WINDOW)
            rolling[places >= np.repeat(sizes, sizes + WINDOW)] = 0.0  # a window that begins behind its text would reach into the next
            mine = slice(at, at + len(some))
            out[mine, 0], out[mine, 1], out[mine, 3] = sums / np.maximum(sizes, 1), np.maximum.reduceat(rolling, starts) / WINDOW, np.log1p(sizes)
            for i, (a, n) in enumerate(zip(starts.tolist(), sizes.tolist(), strict=True)):
                out[at + i, 2] = np.partition(ratio[a : a + n], n - 2)[n - 2] if n > 1 else 0.0
        return out

    def score(self, texts: list[str | None]) -> np.ndarray:
        """Probability that each text is toxic."""
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        return _logistic(np.column_stack((np.ones(len(texts)), self.features(texts))) @ self.weights)


def _logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -700, 700)))


def fit_weights(x: np.ndarray, y: np.ndarray, penalty: float = 1e-3, steps: int = 60) -> np.ndarray:
    """Weights (constant first) of a logistic regression by Newton's method; of the weight, class 1 has ``TOXIC_SHARE``."""
    spread = x.std(axis=0) + 1e-9
    z = np.column_stack((np.ones(len(x)), x / spread))
    share = np.where(y == 1, TOXIC_SHARE / max(1, (y == 1).sum()), (1 - TOXIC_SHARE) / max(1, (y == 0).sum()))
    ridge = penalty * np.diag([1e-3] + [1.0] * x.shape[1])
    w = np.zeros(z.shape[1])
    loss = lambda v: float((share * np.logaddexp(0, np.where(y == 1, -1, 1) * (z @ v))).sum() + v @ ridge @ v / 2)
    for _ in range(steps):
        p = _logistic(z @ w)
        step = np.linalg.solve((z * (share * p * (1 - p))[:, None]).T @ z + ridge, z.T @ (share * (p - y)) + ridge @ w)
        size = 1.0
        while size > 1e-6 and loss(w - size * step) > loss(w):
            size /= 2
        w = w - size * step
    return w / np.append(1, spread)


def count_letters(sample: DataFrame) -> DataFrame:
    """(label, gram, n) of a sample (label, text): in how many documents' words a letter follows its history."""
    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words: Counter = Counter()
            for label, text in zip(batch.column("label").to_pylist(), batch.column("text").to_pylist(), strict=True):
                words.update((label, w) for w in words_of(text))
            counts: Counter = Counter()
            for (label, word), n in words.items():
                for gram in grams_of(word):
                    counts[label, gram] += n
            labels, grams = zip(*counts, strict=True) if counts else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(labels, pa.int32()), pa.array(grams, pa.string()), pa.array(counts.values(), pa.int64())], ["label", "gram", "n"])

    return sample.mapInArrow(run, "label int, gram string, n long").groupBy("label", "gram").agg(F.sum("n").alias("n"))


def _counted(names: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(different names, sorted; the sum of the weights of each, or how often it is there)."""
    known, of = np.unique(names, return_inverse=True)
    return known, np.bincount(of, weights, len(known))


def _of(counted: tuple[np.ndarray, np.ndarray], names: np.ndarray) -> np.ndarray:
    """What was counted of each name, 0 where it wasn't seen."""
    place, there = _at(counted[0], names)
    return np.where(there, counted[1][place], 0.0) if len(counted[0]) else np.zeros(len(names))


def shared_backoff(letters: np.ndarray, sizes: np.ndarray, discount: float) -> np.ndarray:
    """For each gram (right-aligned code points) the probability of its last letter after what follows its first letter.

    A shorter string counts as often as there are different letters before it in any gram (continuation counts);
    what is discounted goes to the next shorter history, down to single letters.
    """
    out, width = np.zeros(len(letters)), letters.shape[1]
    shorter: tuple[np.ndarray, np.ndarray] = (np.empty(0, np.uint64), np.empty(0))
    for m in range(1, width):
        led = np.flatnonzero(sizes > m)  # strings of m letters with a letter before them
        longer, own, history = (_known_as(letters[led, width - m - 1 :]), _known_as(letters[led, width - m :]), _known_as(letters[led, width - m : -1]))
        one = led[:0] if not len(led) else np.unique(longer, return_index=True)[1]
        after = _counted(own[one])
        first = np.unique(own, return_index=True)[1] if len(own) else led[:0]
        times = _of(after, own[first])
        number, kinds = _counted(history[first], times), _counted(history[first])
        total = _of(number, history[first])
        if m == 1:
            p = times / np.maximum(total, 1)
        else:
            rest = _of(shorter, _known_as(letters[led[first], width - m + 1 :]))
            p = (np.maximum(times - discount, 0) + discount * _of(kinds, history[first]) * rest) / np.maximum(total, 1)
        shorter = (own[first], p)
        mine = sizes[led] == m + 1
        out[led[mine]] = _of(shorter, own[mine])
    return out


def estimate(counts: DataFrame, discount: float = DISCOUNT) -> Models:
    """The models' ratios from counts (label, gram, n)."""
    import pyarrow as pa
    import pyarrow.compute as pc

    of = lambda c: F.coalesce(F.sum(F.when(F.col("label") == c, F.col("n"))), F.lit(0)).alias(f"n{c}")
    rows = counts.groupBy("gram").agg(of(0), of(1)).toArrow()
    grams = rows.column("gram").combine_chunks()
    sizes = pc.utf8_length(grams).to_numpy(zero_copy_only=False)
    flat = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(grams)], pa.int32()), grams), "").to_pylist()[0] or ""
    return ratios(np.frombuffer(flat.encode("utf-32-le"), np.uint32), sizes, [rows.column(f"n{c}").to_numpy().astype(float) for c in (0, 1)], discount)


def ratios(flat: np.ndarray, sizes: np.ndarray, own: list[np.ndarray], discount: float = DISCOUNT) -> Models:
    """The models' ratios from all grams' code points, one after another, their lengths, and each class's counts of them."""
    width = HISTORY + 1
    letters = np.zeros((len(sizes), width), np.uint32)
    starts = np.cumsum(sizes) - sizes
    for i in range(width):  # the i-th letter from the end
        has = sizes > i
        letters[has, width - 1 - i] = flat[(starts + sizes - 1 - i)[has]]
    rest, names, history = shared_backoff(letters, sizes, discount), _known_as(letters), _known_as(letters[:, :-1])
    known, of = np.unique(history, return_inverse=True)
    p, left = [], []
    for n in own:
        number, kinds = np.bincount(of, n, len(known)), np.bincount(of, n > 0, len(known))
        left.append(np.where(number > 0, discount * kinds / np.maximum(number, 1), 1.0))
        p.append(left[-1][of] * rest + np.maximum(n - discount, 0) / np.maximum(number, 1)[of])
    order = np.argsort(names)
    return Models((names[order], np.log(p[1] / p[0])[order].astype(np.float32)), (known, np.log(left[1] / left[0]).astype(np.float32)))


def fit(docs: DataFrame, labels: DataFrame, label: str, learns: Column, sample: int = SAMPLE, id_column: str = "doc_id", text: str = "text") -> Models:
    """Models from labelled rows that satisfy ``learns``, a condition on doc_id."""
    ship(docs.sparkSession)
    known = labels.select(F.col(id_column).cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).where("label in (0, 1) and doc_id is not null").where(learns)
    texts = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.xxhash64(text).alias("h"))
    different = materialise(known.join(texts, "doc_id").groupBy("label", "h").agg(F.min("doc_id").alias("doc_id")), "labelled")
    numbers = {r["label"]: r["count"] for r in different.groupBy("label").count().collect()}
    # A hash condition leaves about twice as many as are wanted, so that few rows are put in order.
    first = lambda c: different.where(F.col("label") == c).where(share_of(F.col("h"), 2 * sample, numbers.get(c, 0))).orderBy("h").limit(sample)
    chosen = materialise(first(0).unionByName(first(1)), "chosen")  # at most 2 * sample rows
    found = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.xxhash64(text).alias("h"), F.col(text).alias("text")).join(F.broadcast(chosen), ["doc_id", "h"])
    found = materialise(found.dropDuplicates(["doc_id", "h", "label"]), "sample")
    present = {r["label"] for r in found.select("label").distinct().collect()}
    if len(present) < 2:
        return Models(_NONE, _NONE, constant=float(present.pop()) if present else 0.5)
    weighs = F.pmod(F.col("h"), F.lit(3)) == 0
    models = estimate(materialise(count_letters(found.where(~weighs).select("label", "text")), "letters"))
    measured = found.where(weighs).select("label", "h", features(models, F.col("text")).alias("x")).toPandas().sort_values(["label", "h"])
    y = measured["label"].to_numpy()
    if len(set(y.tolist())) == 2:
        models.weights = fit_weights(np.array(measured["x"].tolist()), y)
    return models


def _shared(models: Models, column: Column, kind: str, method: str) -> Column:
    from pyspark.sql import SparkSession

    sent = SparkSession.active().sparkContext.broadcast(models)  # bounded by the sample

    @F.pandas_udf(kind)
    def run(texts: pd.Series) -> pd.Series:
        made = getattr(sent.value, method)(texts.tolist())
        return pd.Series(list(made))

    return run(column)


def features(models: Models, text: Column) -> Column:
    return _shared(models, text, "array<double>", "features")


def score(models: Models, text: Column) -> Column:
    """The probability that each text is toxic."""
    return _shared(models, text, "double", "score")


def toxicity_scores(docs: DataFrame, labels: DataFrame, folds: int = 5, held_out: int = 0) -> DataFrame:
    """(doc_id, held_out, score, predicted) of each row; learned from the labels outside fold ``held_out``."""
    models = fit(docs, labels, "toxic", fold(F.col("doc_id"), folds) != held_out)
    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), score(models, F.col("text")).alias("score"))
    out = F.coalesce(fold(F.col("doc_id"), folds) == held_out, F.lit(False))
    return scored.select("doc_id", out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
