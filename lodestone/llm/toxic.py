"""Toxic spans by a linear-chain conditional random field; document scores from its marginals.

Learning. A sample of labelled rows (at most SAMPLE of each class, by hash of doc_id, so it does not depend on row
order, as far as their texts have SAMPLE_BYTES) goes to one task, which sends back the model. Documents are labelled, tokens are not, so token labels are derived first: features
(a word, its first four or five letters) are chosen greedily, each time the one that explains most word uses
in toxic documents not explained yet, among those that hardly occur in clean ones. Tokens of toxic documents with a chosen feature are labelled toxic, all
others clean. The field (bias, transitions, feature weights) is fitted to these tokens by gradient ascent on the regularised likelihood,
with expectations from forward-backward, over segments of SEGMENT tokens that count as chains of their own.

Scoring. A whole document is one chain, of any length. Tokens without a chosen feature all have the same potentials, so the chain between two tokens with
features is a power of one 2 x 2 matrix; forward-backward is exact and its cost follows the tokens that
matter. A document's score is its largest marginal of the toxic tag; runs of tokens whose marginal is 0.5 or more are its spans.

Nulls: a null, empty or wordless text scores 0. An empty table gives an empty result; drop_toxic returns all columns of docs untouched. A null label is ignored, of several labels for one doc_id the largest counts,
a null doc_id is never held out or learnt from. Without labels of both classes every score is 0. Repeated rows are scored
row by row, other columns are ignored; only the text is an input of a score.
"""

from __future__ import annotations

import math
import pickle
import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import documents, drop_held, give_back, steady_heap

#: Labelled rows that are learnt from: of the toxic ones, and of the others.
SAMPLE = (2000, 4000)
#: Bytes of text that are learnt from, of each class.
SAMPLE_BYTES = 32 << 20
#: Features that may be chosen, and how many uses each must explain.
FEATURES, LEAST = 256, 3
#: How many times as frequent in toxic documents a feature must be.
RARE = 50
THRESHOLD = 0.7
SEGMENT = 32

_WORD = re.compile(r"[^\W\d_]+")


def lowered(text: str) -> str:
    low = text.lower()
    return low if len(low) == len(text) else "".join(y if len(y := c.lower()) == 1 else c for c in text)


def word_features(word: str) -> tuple[str, ...]:
    return f"={word}", f"4{word[:4]}", f"5{word[:5]}"


@dataclass
class Field:
    """The fitted model: features by kind, their weights, and the background chain."""

    words: dict[str, int] = field(default_factory=dict)
    four: dict[str, int] = field(default_factory=dict)
    five: dict[str, int] = field(default_factory=dict)
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    bias: float = -20.0
    trans: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))

    def __post_init__(self) -> None:
        self.matrix = np.exp(self.trans) * np.array([1.0, np.exp(self.bias)])  # from a tag to the next token's tag
        self.powers: dict[int, np.ndarray] = {}
        self.plain: dict[int, float] = {}
        self.matrix = self.matrix / np.abs(np.linalg.eigvals(self.matrix)).max()  # powers then neither vanish nor grow
        self.ahead = np.array([[1.0, np.exp(self.bias)]])
        self.behind = np.ones((1, 2))

    def weight(self, word: str) -> float | None:
        """The summed weight of a word's features; None without one."""
        got = [t[k] for t, k in ((self.words, word), (self.four, word[:4]), (self.five, word[:5])) if k in t]
        return float(self.weights[got].sum()) if got else None

    def power(self, n: int) -> np.ndarray:
        """matrix ** n up to scale."""
        if n not in self.powers:
            self.powers[n] = np.linalg.matrix_power(self.matrix, n)
        return self.powers[n]

    def marginals(self, n: int, at: list[int], weights: list[float]) -> np.ndarray:
        """P(toxic) at the tokens with features, of n tokens."""
        start = np.array([1.0, np.exp(self.bias)])
        up = [np.array([1.0, np.exp(min(w, 500.0))]) for w in weights]
        forward = []
        for i, (p, u) in enumerate(zip(at, up, strict=True)):
            a = (start if p == 0 else start @ self.power(p)) if i == 0 else forward[-1] @ self.power(p - at[i - 1])
            a = a * u
            forward.append(a / a.sum())
        out = np.zeros(len(at))
        back = self.power(n - 1 - at[-1]) @ np.ones(2) if n - 1 > at[-1] else np.ones(2)
        for i in range(len(at) - 1, -1, -1):
            both = forward[i] * back
            out[i] = both[1] / both.sum()
            if i:
                back = self.power(at[i] - at[i - 1]) @ (up[i] * back)
                back = back / back.sum()
        return out

    def background(self, n: int) -> float:
        """The largest marginal of n tokens without features."""
        if n not in self.plain:
            while len(self.ahead) < n:  # twice as many, as one product of what there is and a power
                step = self.power(len(self.ahead))
                self.ahead, self.behind = np.concatenate([self.ahead, self.ahead @ step]), np.concatenate([self.behind, self.behind @ step.T])
            both = self.ahead[:n] * self.behind[:n][::-1]
            self.plain[n] = float((both[:, 1] / both.sum(1)).max())
        return self.plain[n]

    def score(self, text: str, with_spans: bool = True) -> tuple[float, list[dict]]:
        low = lowered(text)
        words = _WORD.findall(low)
        if not words or not len(self.weights):
            return 0.0, []
        exact, four, five = self.words, self.four, self.five
        at = [i for i, w in enumerate(words) if w in exact or w[:4] in four or w[:5] in five]
        if not at:
            return self.background(len(words)), []
        p = self.marginals(len(words), at, [self.weight(words[i]) for i in at])
        best = max(float(p.max()), self.background(len(words)))
        if not with_spans or p.max() < 0.5:
            return best, []
        hot = {i for i, x in zip(at, p, strict=True) if x >= 0.5}
        spans, last = [], -2
        for i, m in enumerate(_WORD.finditer(low)):
            if i in hot:
                if last == i - 1:
                    spans[-1]["end"] = m.end()
                else:
                    spans.append({"start": m.start(), "end": m.end()})
                last = i
        return best, spans


class Corpus:
    """Sampled documents as arrays of word numbers: a word's text is held once, however often it occurs."""

    def __init__(self, sample: list[tuple[str, bool]]) -> None:
        number: dict[str, int] = {}
        self.docs: list[np.ndarray] = []
        for text, _ in sample:
            words = _WORD.findall(lowered(text))
            self.docs.append(np.fromiter((number.setdefault(w, len(number)) for w in words), np.int32, len(words)))
        self.words = list(number)
        self.toxic = [bad for _, bad in sample]

    def uses(self, bad: bool) -> np.ndarray:
        """Of each word, how many different words it follows in documents of a class (the start of a text is one)."""
        codes = [np.zeros(0, np.int64)]
        for doc, mark in zip(self.docs, self.toxic, strict=True):
            if mark == bad and len(doc):
                codes.append(doc.astype(np.int64) << 32 | np.concatenate([[len(self.words)], doc[:-1]]))
        distinct = np.unique(np.concatenate(codes))
        return np.bincount(distinct >> 32, minlength=len(self.words))


def choose_features(corpus: Corpus) -> list[str]:
    """Features that mark toxic documents, chosen greedily by the word uses that they explain.

    A use is a word with the word before it, counted once, so copies of a document add nothing. A feature
    qualifies if its uses fall in toxic documents far beyond chance (log likelihood ratio, against all features
    tried) and are at least RARE times as frequent there as in clean ones.
    """
    used = {bad: corpus.uses(bad) for bad in (True, False)}
    counts: dict[bool, Counter[str]] = {True: Counter(), False: Counter()}
    for bad in (True, False):
        for i in np.flatnonzero(used[bad]).tolist():
            for f in word_features(corpus.words[i]):
                if bad or f in counts[True]:
                    counts[bad][f] += int(used[bad][i])
    total = int(used[True].sum()) + int(used[False].sum())
    share = int(used[True].sum()) / max(1, total)
    if not 0 < share < 1:
        return []
    needed = math.log(len(counts[True])) + 5
    gain: dict[str, int] = {}
    for f, n in counts[True].items():
        k = counts[False][f]
        q = n / (n + k)
        ratio = n * math.log(q / share) + (k * math.log((1 - q) / (1 - share)) if k else 0.0)
        if n >= LEAST and ratio >= needed and q / (1 - q + 1e-12) >= RARE * share / (1 - share):
            gain[f] = n
    own: dict[str, Counter[str]] = defaultdict(Counter)
    for i in np.flatnonzero(used[True]).tolist():
        for f in word_features(corpus.words[i]):
            if f in gain:
                own[f][corpus.words[i]] += int(used[True][i])
    chosen: list[str] = []
    done: set[str] = set()
    while gain and len(chosen) < FEATURES:
        f = max(gain, key=lambda x: (gain[x] - 10 * counts[False][x] * share / (1 - share), x[0] == "=", x))
        live = sum(n for w, n in own[f].items() if w not in done)
        if live < gain[f]:
            gain[f] = live  # stale: look again
            if live < LEAST:
                del gain[f]
            continue
        chosen.append(f)
        del gain[f]
        done.update(own[f])
    return chosen


def fit(sample: list[tuple[str, bool]], steps: int = 100, ridge: float = 1e-3) -> Field:
    """The field fitted to (text, toxic) rows."""
    corpus = Corpus(sample)
    chosen = choose_features(corpus)
    if not chosen or all(corpus.toxic):  # also without rows
        return Field()
    model = Field(*({f[1:]: i for i, f in enumerate(chosen) if f[0] == kind} for kind in "=45"), weights=np.zeros(len(chosen)))
    # Segments of tokens: which feature sets they have and their labels, padded; padding is masked. Equal segments are counted.
    sets: dict[tuple[int, ...], int] = {(): 0}
    set_of = np.array([sets.setdefault(tuple(t[k] for t, k in ((model.words, w), (model.four, w[:4]), (model.five, w[:5])) if k in t), len(sets)) for w in corpus.words], np.int32)
    parts = []
    for doc, bad in zip(corpus.docs, corpus.toxic, strict=True):
        ids = np.full(-(-len(doc) // SEGMENT) * SEGMENT, -1, np.int32)
        ids[: len(doc)] = set_of[doc]
        tags = (ids > 0).astype(np.int32) * bad
        parts.append(np.concatenate([ids.reshape(-1, SEGMENT), tags.reshape(-1, SEGMENT)], 1))
    grid, counts = np.unique(np.concatenate(parts), axis=0, return_counts=True)
    x, y = grid[:, :SEGMENT].T, grid[:, SEGMENT:].T
    c = counts.astype(float)
    design = np.zeros((len(sets), len(chosen) + 1))
    design[:, -1] = 1.0
    for s, i in sets.items():
        design[i, list(s)] = 1.0
    mask = (x >= 0).astype(float)
    xs = np.where(x >= 0, x, 0)
    total = float((mask * c).sum())
    seen = np.zeros(len(sets))
    np.add.at(seen, xs.ravel(), (mask * y * c).ravel())
    pair = np.zeros((2, 2))
    for t in range(1, SEGMENT):
        np.add.at(pair, (y[t - 1], y[t]), mask[t] * c)
    theta = np.zeros(len(chosen) + 1 + 3)
    theta[len(chosen)] = -5.0
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, steps + 1):
        weights, trans = theta[: len(chosen) + 1], np.array([[0.0, theta[-3]], [theta[-2], theta[-1]]])
        emit = np.exp(np.clip(design @ weights, -30, 30))[xs]
        a_mat = np.exp(trans)
        f = np.zeros((SEGMENT, 2, x.shape[1]))
        f[0] = np.stack([np.ones(x.shape[1]), emit[0]])
        f[0] /= f[0].sum(0)
        for t in range(1, SEGMENT):
            now = np.einsum("sn,st->tn", f[t - 1], a_mat) * np.stack([np.ones(x.shape[1]), emit[t]])
            now = np.where(mask[t] > 0, now, f[t - 1])
            f[t] = now / now.sum(0)
        b = np.ones((2, x.shape[1]))
        expected, exp_pair = np.zeros(len(sets)), np.zeros((2, 2))
        for t in range(SEGMENT - 1, -1, -1):
            p = f[t] * b
            p = p / p.sum(0)
            np.add.at(expected, xs[t], mask[t] * c * p[1])
            if t:
                out = np.stack([np.ones(x.shape[1]), emit[t]]) * b
                joint = f[t - 1][:, None, :] * a_mat[:, :, None] * out[None]
                joint = joint / joint.sum((0, 1))
                exp_pair += (joint * (mask[t] * c)).sum(2)
                b = np.where(mask[t] > 0, np.einsum("st,tn->sn", a_mat, out), b)
                b = b / b.sum(0)
        grad = np.concatenate([(seen - expected) @ design, (pair - exp_pair).ravel()[1:]]) - ridge * theta
        m, v = 0.9 * m + 0.1 * grad / total, 0.99 * v + 0.01 * (grad / total) ** 2
        theta = theta + 0.3 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-10)
    weights = theta[: len(chosen)]
    return Field(model.words, model.four, model.five, weights, float(theta[len(chosen)]), np.array([[0.0, theta[-3]], [theta[-2], theta[-1]]]))


def held_out(doc_id: str = "doc_id", folds: int = 3, fold: int = 1) -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % folds == fold, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame, sample: tuple[int, int] = SAMPLE, sample_bytes: int = SAMPLE_BYTES) -> Field:
    """Fits the field, in one task, to at most `sample` toxic and other labelled rows with sample_bytes of text each; held-out rows are left aside."""
    known = labels.select("doc_id", "toxic").where("doc_id is not null and toxic is not null").where(~held_out())
    known = known.groupBy("doc_id").agg((F.max("toxic") == 1).alias("toxic"))
    ids = [known.where(c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n) for c, n in zip((F.col("toxic"), ~F.col("toxic")), sample, strict=True)]
    picked = docs.sparkSession.createDataFrame([tuple(r) for part in ids for r in part.collect()], "doc_id long, toxic boolean")
    got = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id").groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.max("text").alias("text"))
    so_far = Window.partitionBy("toxic").orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    got = got.withColumn("so_far", F.sum(F.coalesce(F.octet_length("text"), F.lit(0))).over(so_far)).where(F.col("so_far") <= sample_bytes).select("text", "toxic").distinct()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        steady_heap()
        drop_held()
        rows = sorted({(x.as_py() or "", y.as_py()) for batch in batches for x, y in zip(*batch.columns, strict=True)})
        model = fit(rows)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps((model.words, model.four, model.five, model.weights, model.bias, model.trans))], pa.binary())], names=["model"])
        del rows, model
        give_back()

    found = got.repartition(1).mapInArrow(run, "model binary").collect()
    return Field(*pickle.loads(found[0]["model"])) if found else Field()


def toxic_scores(docs: DataFrame, model: Field, columns: tuple[str, ...] = ("doc_id",), with_spans: bool = True) -> DataFrame:
    """columns, score and spans ([start, end) code points of toxic runs)."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    slim = docs.select(*columns, F.col("text").alias("_text"))
    n = len(columns)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_held()
        field_ = sent.value
        for batch in batches:
            got = [field_.score(x.as_py() or "", with_spans) for x in batch.column(n)]
            score = pa.array([s for s, _ in got], pa.float64())
            spans = pa.array([s for _, s in got], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], score, spans], names=[*columns, "score", "spans"])
        give_back()

    shape = slim.drop("_text").schema.add("score", "double").add("spans", T.ArrayType(T.StructType().add("start", T.LongType()).add("end", T.LongType())))
    return slim.mapInArrow(run, shape)


def drop_toxic(docs: DataFrame, model: Field, threshold: float = THRESHOLD, text: str = "text") -> DataFrame:
    """docs, all columns, without the rows that score threshold or more."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_held()
        for batch in batches:
            keep = [sent.value.score(x.as_py() or "", False)[0] < threshold for x in batch.column(at)]
            yield batch.filter(pa.array(keep, pa.bool_()))
        give_back()

    return docs.mapInArrow(run, docs.schema)


def op8_crf_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    out = toxic_scores(docs, model)
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), F.to_json("spans").alias("spans"))
