"""Toxicity by a support vector machine over a subsequence string kernel.

The kernel compares two strings by the triples of characters they share in
order, gaps allowed: a triple that spans s characters counts decay ** s. Inserted
characters and gaps in an insult therefore cost some weight and no match. The
kernel is scaled by the lengths and raised to a power, which keeps it a kernel and sharpens it.

Strings are the units of a text: its words without marks, letters that stand apart
joined, long ones in overlapping windows. A text is as toxic as its worst units.
Labels exist for texts only, so training is by witnesses: units that far more toxic texts hold
than chance would have it start as positive, and only those that remain the worst
of some toxic text stay positive. Equal texts count as one.

Nyström landmarks, chosen among the units of both sides, map a unit to its
kernel values with them; the machine is linear there, and a logistic curve
turns the two worst margins of a text into a score.

The machine is fitted on the driver, on a sample of at most ``docs_per_class`` labelled
texts of each class and on at most ``positives`` and ``negatives`` units of them; class shares are counted on all labels.
Where no unit tells the classes apart nothing is fitted: a warning says so, and no text reaches a score of 0.5.
"""

from __future__ import annotations

import math
import re
import warnings
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import count

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from skewprobe.llm.common import replaced
from skewprobe.session import stage

DECAY, SPAN, POWER = 0.7, 6, 3
LANDMARKS = 192
DOCS_PER_CLASS = 2500
#: Units taken to the driver: the most telling ones, and those of clean texts, half of them the most frequent
#: and half dealt by a hash.
POSITIVES, NEGATIVES = 1500, 30000
#: No score of a model that could not be fitted is higher, so nothing counts as toxic.
UNFITTED = 0.49
ROUNDS = 4
REGULAR = 1e-3
# Units whose margin is so close to the worst of their text are witnesses with it.
TOGETHER = 0.5
# Longer units are cut into windows.
LONG, WINDOW, STRIDE = 24, 16, 8
CHARS = 1 << 20
UNITS_AT_ONCE = 1 << 11
# Triples that are looked up, or added up, at once.
TRIPLES = 1 << 17
# Words whose margins a task remembers from earlier texts.
REMEMBERED = 1 << 18
# Texts that are scored at once.
ROWS = 1000
SYMBOLS = 64
NOTHING = -2.0  # the margin of a unit that is not there
# Letters and marks have no character in common, and marks are never given back: linear on any text.
APART = re.compile(r"(?<!\S)[^\W_](?:[\W_]++[^\W_]){2,}(?!\S)")
MARKS = re.compile(r"[\W_]+")
UNITS = "unit string, toxic int"


def units_of(text: str) -> list[str]:
    """Lower-case words without marks, with joined single letters and windows of long words."""
    text = text.lower()
    out = text.split()
    out += [MARKS.sub("", m) for m in APART.findall(text)]
    return out


def windows(unit: str) -> list[str]:
    """The word without marks, in windows if it is long; nothing if no letter is left."""
    unit = MARKS.sub("", unit)
    if len(unit) <= LONG:
        return [unit] if len(unit) >= 3 else []
    return [unit[a : a + WINDOW] for a in range(0, len(unit) - STRIDE, STRIDE)]


def _codes(units: list[str], size: int) -> np.ndarray:
    raw = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), "<u4")
    raw = raw.reshape(len(units), size).astype(np.int64)
    letter = (raw >= 97) & (raw <= 122)
    return np.where(letter, raw - 96, 27 + raw % (SYMBOLS - 27))


def _triples(codes: np.ndarray) -> Iterator[tuple[np.ndarray, float]]:
    """For each shape of gaps, the numbers of the triples (unit by position) and their weight."""
    size = codes.shape[1]
    for last in range(2, min(SPAN, size)):
        for middle in range(1, last):
            a = codes[:, : size - last]
            b, c = codes[:, middle : size - last + middle], codes[:, last:]
            yield (a * SYMBOLS + b) * SYMBOLS + c, DECAY ** (last + 1)


def _triples_of(size: int) -> int:
    """How many triples a unit of ``size`` characters has."""
    return sum((size - last) * (last - 1) for last in range(2, min(SPAN, size)))


def _scale(size: int) -> float:
    """The root of the summed squares of all weights: depends on the length alone."""
    total = sum(
        (size - last) * (last - 1) * DECAY ** (2 * (last + 1)) for last in range(2, min(SPAN, size))
    )
    return max(total, 1e-12) ** 0.5


@dataclass
class Kernel:
    """Kernel values of units with fixed landmarks."""

    landmarks: list[str]
    row: np.ndarray = field(init=False)
    #: Where the landmarks of a row begin, how many these are, their numbers and weights: few share a triple.
    first: np.ndarray = field(init=False)
    many: np.ndarray = field(init=False)
    column: np.ndarray = field(init=False)
    weight: np.ndarray = field(init=False)

    def __post_init__(self):
        seen: dict[int, dict[int, float]] = {}
        for j, unit in enumerate(self.landmarks):
            scale = _scale(len(unit))
            for triple, weight in _triples(_codes([unit], len(unit))):
                for t in triple[0].tolist():
                    mine = seen.setdefault(t, {})
                    mine[j] = mine.get(j, 0.0) + weight / scale
        self.row = np.zeros(SYMBOLS**3, np.int32)
        rows = sorted(seen.items())
        for i, (t, _) in enumerate(rows, 1):
            self.row[t] = i
        self.many = np.array([0, *[len(values) for _, values in rows]], np.int64)
        self.first = np.cumsum(self.many) - self.many
        self.column = np.array([j for _, values in rows for j in values], np.int64)
        self.weight = np.array([x for _, values in rows for x in values.values()], np.float32)

    def values(self, units: list[str]) -> np.ndarray:
        out = np.zeros((len(units), len(self.landmarks)), np.float32)
        sizes = np.array([len(u) for u in units], int)
        for size in np.unique(sizes[sizes >= 3]):
            members = np.flatnonzero(sizes == size)
            step = max(1, TRIPLES // _triples_of(int(size)))
            for at in range(0, len(members), step):
                part = members[at : at + step]
                found = list(_triples(_codes([units[i] for i in part], int(size))))
                rows = np.concatenate([self.row[triple] for triple, _ in found], 1)
                weight = np.repeat(np.array([w for _, w in found], np.float32), [t.shape[1] for t, _ in found])
                unit, place = np.nonzero(rows)
                out[part] = self._sums(len(part), unit, rows[unit, place], weight[place]) / np.float32(_scale(int(size)))
        flat = out.ravel()
        there = np.flatnonzero(flat)
        flat[there] = flat[there] ** POWER
        return out

    def _sums(self, n: int, unit: np.ndarray, row: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """The weights of the triples ``row`` of each unit, for every landmark that has them, summed in their order."""
        total = np.zeros(n * len(self.landmarks), np.float32)
        many = self.many[row]
        upto = np.cumsum(many)
        start = 0
        while start < len(row):
            done = upto[start] - many[start]
            stop = max(start + 1, int(np.searchsorted(upto, done + TRIPLES, "right")))
            m = many[start:stop]
            entry = np.repeat(self.first[row[start:stop]] - (upto[start:stop] - m - done), m) + np.arange(m.sum())
            to = np.repeat(unit[start:stop] * len(self.landmarks), m) + self.column[entry]
            np.add.at(total, to, np.repeat(weight[start:stop], m) * self.weight[entry])
            start = stop
        return total.reshape(n, -1)


@dataclass
class Model:
    """Margins of units are linear in the kernel values, scores logistic in the two worst."""

    kernel: Kernel | None
    weight: np.ndarray
    bias: float
    curve: np.ndarray  # for the worst, the second and one
    prior: float
    known: dict[str, float] = field(default_factory=dict, repr=False)

    def margins(self, units: list[str]) -> np.ndarray:
        # Kernel values of a few thousand units at a time.
        blocks = [units[a : a + UNITS_AT_ONCE] for a in range(0, len(units), UNITS_AT_ONCE)]
        found = [self.kernel.values(b).astype(np.float64) @ self.weight for b in blocks]
        return np.concatenate([np.zeros(0), *found]) + self.bias

    def worst(self, texts: list[str]) -> np.ndarray:
        """The margins of the two worst units of each text; a unit that occurs twice can be both."""
        out, start, held = [np.zeros((0, 2))], 0, 0
        for stop, text in enumerate(texts, 1):
            held += len(text)
            if held >= CHARS or stop == len(texts):
                out.append(self._worst(texts[start:stop]))
                start, held = stop, 0
        return np.concatenate(out)

    def _worst(self, texts: list[str]) -> np.ndarray:
        words = [units_of(text) for text in texts]
        self._learn(set().union(*words))
        out = np.full((len(texts), 2), NOTHING)
        for i, mine in enumerate(words):
            margins = np.fromiter(map(self.known.__getitem__, mine), float, len(mine))
            top = np.sort(margins if len(mine) <= 2 else np.partition(margins, len(mine) - 2)[-2:])
            out[i, : len(top)] = top[::-1]
        return out

    def _learn(self, words: set[str]) -> None:
        """The margin of every word is known afterwards; most words come again."""
        new = words - self.known.keys()
        if len(self.known) + len(new) > REMEMBERED:
            self.known.clear()
            new = words
        new = list(new)
        cut = [windows(w) for w in new]
        number: dict[str, int] = defaultdict(count().__next__)
        flat = np.array([number[w] for ws in cut for w in ws], np.int64)
        margin = np.full(len(new), NOTHING)
        if len(flat):
            # Windows come word by word; a word without any has no run.
            many = np.array([len(ws) for ws in cut])
            own = np.flatnonzero(many)
            margin[own] = np.maximum.reduceat(self.margins(list(number))[flat], (np.cumsum(many) - many)[own])
        self.known.update(zip(new, margin.tolist(), strict=True))

    def scores(self, texts: list[str]) -> np.ndarray:
        if self.kernel is None:
            return np.full(len(texts), min(self.prior, UNFITTED))
        worst = self.worst(texts)
        return 1 / (1 + np.exp(-np.clip(worst @ self.curve[:2] + self.curve[2], -500, 500)))


def train(
    docs: DataFrame, labels: DataFrame, docs_per_class: int = DOCS_PER_CLASS, positives: int = POSITIVES,
    negatives: int = NEGATIVES, landmarks: int = LANDMARKS, seed: int = 11,
) -> Model:
    """A model from ``docs`` (``doc_id, text``) and ``labels`` (``doc_id, toxic``).

    Labels other than 0 and 1 and null ids are left out; of several labels of a document the
    highest counts. Without texts of both classes, or without a unit that tells them apart, nothing can be
    fitted: there is a warning, and the model gives every text the share of toxic labels, 0.49 at most.
    """
    known = (
        labels.where("toxic in (0, 1) and doc_id is not null")
        .groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    )
    known = stage(known, "toxic-labels")
    shares = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    prior = shares.get(1, 0) / max(1, sum(shares.values()))
    order = F.xxhash64(F.lit(seed), "doc_id")
    picked = [known.where(F.col("toxic") == c).orderBy(order, "doc_id").limit(docs_per_class) for c in (0, 1)]
    ids = stage(picked[0].unionByName(picked[1]).withColumnRenamed("doc_id", "__id"), "toxic-sample")
    sample = docs.select("doc_id", "text").join(ids, F.col("doc_id") == F.col("__id"))
    sample = stage(sample.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "toxic"), "toxic-texts")
    sizes = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    if not sizes.get(0) or not sizes.get(1):
        return _unfitted(prior, "there are no labelled texts of both classes")

    def explode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for text, toxic in zip(frame["text"], frame["toxic"], strict=True):
                found = list({w for u in set(units_of(text)) for w in windows(u)})
                if not found:
                    continue
                yield pd.DataFrame({"unit": found, "toxic": np.full(len(found), toxic, np.int32)})

    # Copies of a text are one witness.
    texts = sample.select("text", "toxic").distinct()
    counted = texts.mapInPandas(explode, UNITS).groupBy("unit").agg(
        F.sum("toxic").alias("bad"), F.sum(1 - F.col("toxic")).alias("good")
    )
    counted = stage(counted, "toxic-units")
    sums = counted.agg(F.count("*"), F.sum("bad"), F.sum("good")).first()
    if not sums[1] or not sums[2]:
        return _unfitted(prior, "the texts of a class have no words")
    share, n = sums[1] / (sums[1] + sums[2]), F.col("bad") + F.col("good")
    # The Chernoff bound of meeting so many toxic texts by chance, as -log: with that of all
    # units together a unit has to be above chance, however few or many texts there are.
    telling = F.col("bad") * F.log(F.col("bad") / n / share) + F.when(
        F.col("good") > 0, F.col("good") * F.log(F.col("good") / n / (1 - share))
    ).otherwise(0.0)
    # And at least halfway from the share that chance gives to all of its texts.
    more = F.col("bad") > (1 + share) / 2 * n
    best = counted.where("bad > 0").withColumn("telling", telling)
    best = best.where((F.col("telling") > math.log(sums[0])) & more)
    best = best.orderBy(F.desc("telling"), "unit").limit(positives).toPandas()
    clean = counted.where("good > 0")
    common = clean.orderBy(F.desc("good"), "unit").limit(negatives // 2).toPandas()
    dealt = clean.orderBy(F.xxhash64(F.lit(seed), "unit"), "unit").limit(negatives - negatives // 2).toPandas()
    other = pd.concat([common, dealt]).drop_duplicates("unit")
    if not len(best) or not len(other):
        return _unfitted(prior, "no unit tells the classes apart")
    other = other[~other["unit"].isin(best["unit"])]
    model = _fit(best, other, landmarks, prior, seed)

    # Witnesses: only units that are about the worst of some toxic text stay positive.
    for _ in range(ROUNDS - 1):
        kept = _witnesses(sample, model, best)
        if kept.all() or not kept.any():
            break
        best = best[kept]
        model = _fit(best, other, landmarks, prior, seed)
    return _calibrate(sample, model, sizes, shares)


def _unfitted(prior: float, why: str) -> Model:
    warnings.warn(f"no toxicity model was fitted: {why}; no text is judged toxic", stacklevel=3)
    return Model(None, np.zeros(0), 0.0, np.zeros(3), prior)


def _witnesses(sample: DataFrame, model: Model, best: pd.DataFrame) -> np.ndarray:
    names = best["unit"].tolist()
    margin = dict(zip(names, model.margins(names).tolist(), strict=True))

    @pandas_udf("array<string>")
    def worst(texts: pd.Series) -> pd.Series:
        out = []
        for text in texts:
            mine = {w for u in set(units_of(text)) for w in windows(u)} & margin.keys()
            least = max((margin[w] for w in mine), default=0.0) - TOGETHER
            out.append([w for w in mine if margin[w] >= least])
        return pd.Series(out, dtype=object)

    bad = sample.where("toxic = 1").select(F.explode(worst("text")).alias("unit"))
    seen = bad.distinct().toPandas()["unit"]
    return best["unit"].isin(seen).to_numpy()


def _fit(best: pd.DataFrame, other: pd.DataFrame, landmarks: int, prior: float, seed: int) -> Model:
    rng = np.random.default_rng(seed)
    half = min(len(best), landmarks // 2)
    near = best["unit"].tolist()[: half // 2]
    rest = best["unit"].tolist()[half // 2 :]
    near += [rest[i] for i in sorted(rng.permutation(len(rest))[: half - len(near)])]
    far = other["unit"].tolist()
    near += [far[i] for i in sorted(rng.permutation(len(far))[: landmarks - len(near)])]
    kernel = Kernel(near)
    gram = kernel.values(near).astype(np.float64)
    size, vectors = np.linalg.eigh((gram + gram.T) / 2)
    keep = size > 1e-6 * size.max()
    root = vectors[:, keep] / np.sqrt(size[keep])
    units = best["unit"].tolist() + far
    mapped = kernel.values(units).astype(np.float64) @ root
    y = np.repeat([1.0, -1.0], [len(best), len(far)])
    seen = np.concatenate([best["bad"], other["good"]]).astype(float)
    weight = np.log1p(seen)
    weight /= np.where(y > 0, weight[y > 0].sum(), weight[y < 0].sum() / 4)
    w = _svm(np.hstack([mapped, np.ones((len(y), 1))]), y, weight)
    return Model(kernel, root @ w[:-1], float(w[-1]), np.array([1.0, 0.0, 0.0]), prior)


def _svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Squared hinge loss by Newton steps; the last column is the free bias."""
    w = np.zeros(x.shape[1])
    ridge = np.full(x.shape[1], REGULAR)
    ridge[-1] = 1e-9
    active = None
    for _ in range(30):
        inside = y * (x @ w) < 1
        if active is not None and np.array_equal(inside, active):
            break
        active = inside
        a = x[active] * weight[active, None]
        w = np.linalg.solve(a.T @ x[active] + np.diag(ridge), a.T @ y[active])
    return w


def _calibrate(sample: DataFrame, model: Model, sizes: dict, shares: dict) -> Model:
    @pandas_udf("array<double>")
    def worst(texts: pd.Series) -> pd.Series:
        return pd.Series(list(model.worst(texts.tolist())), dtype=object)

    rows = sample.select("doc_id", "toxic", worst("text").alias("m")).orderBy("doc_id").toPandas()
    # The second unit counts half; one slope for both stays stable with few texts.
    x = np.stack(rows["m"].to_list()) @ np.array([1.0, 0.5])
    x = np.stack([x, np.ones(len(x))], 1)
    y = rows["toxic"].to_numpy(float)
    # Each class counts by its share of all labels.
    weight = np.where(y > 0, shares[1] / sizes[1], shares[0] / sizes[0])
    weight /= weight.sum()
    curve = np.zeros(2)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ curve, -30, 30)))
        slope = x.T @ (weight * (p - y)) + np.array([1e-4, 0]) * curve
        bend = (x * (weight * p * (1 - p))[:, None]).T @ x + np.diag([1e-4, 1e-9])
        step = np.linalg.solve(bend, slope)
        curve = curve - step * min(1.0, 4 / max(np.abs(step).max(), 1e-9))
        if np.abs(step).max() < 1e-8:
            break
    full = np.array([curve[0], curve[0] / 2, curve[1]])
    return Model(model.kernel, model.weight, model.bias, full, model.prior)


def toxicity(text: Column, model: Model) -> Column:
    """The score of each text, 0 to 1. Null and empty texts have no units, so the lowest margins."""

    @pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            for a in range(0, max(len(texts), 1), ROWS):
                yield pd.Series(model.scores([t or "" for t in texts.iloc[a : a + ROWS]]))
        # The worker goes on with other tasks.
        model.known.clear()

    return score(text)


def score_docs(docs: DataFrame, model: Model, text: str = "text", score: str = "toxicity") -> DataFrame:
    """``docs`` with the column ``score``.

    Only the text is read: null ids, repeated rows and other columns have no effect, and equal
    texts have equal scores. Null and empty texts are scored as texts without words. A column of
    that name is replaced; an empty table gives an empty one.
    """
    return replaced(docs, {score: toxicity(F.col(f"`{text}`"), model)})
