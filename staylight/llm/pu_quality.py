"""Text quality from trusted positives and unlabelled text.

A score is learnt without any trusted negative: labelled good texts are the positives, all
other text is a mix of good and bad whose share of good, the class prior, is estimated. The
risk of the unlabelled part less that of the positives in it cannot be negative in truth;
where a step would make it so, it is pushed back (the non-negative risk).
"""

from __future__ import annotations

import operator
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from staylight.llm.texts import documents

#: What a text is judged by; nothing but the text goes in.
NAMES = (
    "log_words", "word_length", "word_spread", "upper", "digit", "symbol", "bang", "comma", "stop", "bar",
    "quote", "other_ascii", "beyond_ascii", "blank", "distinct", "same_as_before", "dup_lines", "line_ends",
    "shout_words", "tagged_words", "log_line", "one_letter",
)

_SETS = {
    "upper": range(65, 91), "lower": range(97, 123), "digit": range(48, 58), "symbol": b"#*$%&<>^~@\\", "bang": b"!?",
    "comma": b",;:", "stop": b".", "bar": b"|", "quote": b"\"'()", "blank": b" \t\n\r\x0b\x0c", "beyond_ascii": range(128, 256),
}
_KIND = np.full(256, len(_SETS))
for _n, _bytes in enumerate(_SETS.values()):
    _KIND[list(_bytes)] = _n
_AT = {name: n for n, name in enumerate(_SETS)}
#: Words per block in which distinct words are counted, so that length does not matter.
_BLOCK = 128
_TAGGED = re.compile(r"[^\s][#*$%&!?|]{2,}(?=\s|$)")
_SHOUT = re.compile(r"\b[A-Z]{2,}\b")


def features(text: str) -> list[float]:
    """The numbers named in :data:`NAMES`, for the whole text; an empty text has its own."""
    words, lines = text.split(), [x for x in text.split("\n") if x.strip()]
    n = len(words)
    if not n:
        return [-1.0] + [0.0] * (len(NAMES) - 1)
    raw = np.frombuffer(text.encode(), np.uint8)
    share = np.bincount(_KIND[raw], minlength=len(_SETS) + 1) / len(raw)
    lengths = np.fromiter(map(len, words), float, n)
    blocks = range(0, n, _BLOCK)
    distinct = sum(len(set(words[i : i + _BLOCK])) for i in blocks) / n
    return [
        float(np.log1p(n)), float(lengths.mean()), float(lengths.std()),
        *(float(share[_AT[k]]) for k in ("upper", "digit", "symbol", "bang", "comma", "stop", "bar", "quote")),
        float(share[-1]), float(share[_AT["beyond_ascii"]]), float(share[_AT["blank"]]),
        distinct, sum(map(operator.eq, words, words[1:])) / n, 1 - len(set(lines)) / len(lines),
        sum(x.rstrip()[-1] in ".!?" for x in lines) / len(lines), len(_SHOUT.findall(text)) / n,
        len(_TAGGED.findall(text)) / n, float(np.log1p(n / len(lines))), float((lengths == 1).mean()),
    ]


# --- learning -------------------------------------------------------------------------
@dataclass(frozen=True)
class Settings:
    """``positives``, ``unlabelled``: most rows taken of each for fitting (a sample by hash of the id,
    bounded so that fitting needs the same memory at any size). ``hidden``: units of the
    middle layer. ``steps``, ``rate``, ``decay``: of the optimiser. ``slack``: how far below zero the
    risk of negatives may go before it is pushed back. ``confidence``: of the prior's estimate."""

    positives: int = 5_000
    unlabelled: int = 5_000
    hidden: int = 8
    steps: int = 300
    rate: float = 0.02
    decay: float = 1e-4
    slack: float = 0.0
    confidence: float = 0.1
    seed: int = 11


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


@dataclass
class Network:
    """Two small layers over standardised features."""

    mean: np.ndarray
    spread: np.ndarray
    weights: list[np.ndarray]
    prior: float

    def _forward(self, x: np.ndarray):
        a, b, c, d = self.weights
        z = np.clip((x - self.mean) / self.spread, -8, 8)
        h = np.tanh(z @ a + b)
        return z, h, h @ c + d[0]

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self._forward(x)[2]

    def score(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(self.raw(x))

    def gradient(self, x: np.ndarray, slope: np.ndarray) -> list[np.ndarray]:
        """Of the sum of ``slope`` times the output, by each weight."""
        z, h, _ = self._forward(x)
        back = np.outer(slope, self.weights[2]) * (1 - h * h)
        return [z.T @ back, back.sum(0), h.T @ slope, np.array([slope.sum()])]


def _train(net: Network, slopes, settings: Settings, seed: int) -> None:
    """Adam; ``slopes(net)`` gives the rows and the derivative of the risk by their outputs."""
    first = [np.zeros_like(w) for w in net.weights]
    second = [np.zeros_like(w) for w in net.weights]
    for step in range(1, settings.steps + 1):
        x, slope = slopes(net)
        for k, g in enumerate(net.gradient(x, slope)):
            g = g + settings.decay * net.weights[k]
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.999 * second[k] + 0.001 * g * g
            scale = np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8
            net.weights[k] = net.weights[k] - settings.rate * first[k] / (1 - 0.9**step) / scale


def _new(positives: np.ndarray, unlabelled: np.ndarray, settings: Settings) -> Network:
    rng = np.random.default_rng(settings.seed)
    both = np.vstack([positives, unlabelled])
    width = both.shape[1]
    weights = [
        rng.normal(0, 1 / np.sqrt(width), (width, settings.hidden)), np.zeros(settings.hidden),
        rng.normal(0, 1 / np.sqrt(settings.hidden), settings.hidden), np.zeros(1),
    ]
    return Network(both.mean(0), both.std(0) + 1e-9, weights, 0.5)


def estimate_prior(positives: np.ndarray, unlabelled: np.ndarray, confidence: float = 0.1) -> float:
    """Share of positives in the unlabelled scores: the least, over thresholds, of the part of the
    unlabelled above it to the part of the positives above it, with room for chance. Where
    a threshold admits positives only, that ratio is the share itself."""
    room = lambda n: np.sqrt(np.log(4 / confidence) / (2 * n))
    edges = np.unique(np.concatenate([positives, unlabelled]))
    of_p = 1 - np.searchsorted(np.sort(positives), edges) / len(positives)
    of_u = 1 - np.searchsorted(np.sort(unlabelled), edges) / len(unlabelled)
    usable = of_p > 0
    slack = room(len(positives)) + room(len(unlabelled))
    best = np.argmin((of_u[usable] + slack) / of_p[usable])
    return float(np.clip(of_u[usable][best] / of_p[usable][best], 0.01, 0.99))


def fit(positives: np.ndarray, unlabelled: np.ndarray, settings: Settings = Settings()) -> Network:
    """First a plain classifier of positives against unlabelled, whose scores on the half it did not
    see give the prior; then the network that minimises the non-negative risk."""
    if not len(positives) or not len(unlabelled):
        net = _new(np.zeros((1, len(NAMES))), np.zeros((1, len(NAMES))), settings)
        net.weights = [np.zeros_like(w) for w in net.weights]
        return net
    plain = _new(positives, unlabelled, settings)
    seen = (positives[::2], unlabelled[::2])
    x = np.vstack(seen)
    is_p = np.repeat([1.0, 0.0], [len(seen[0]), len(seen[1])])
    weight = np.where(is_p == 1, 0.5 / max(1, len(seen[0])), 0.5 / max(1, len(seen[1])))
    _train(plain, lambda net: (x, weight * (_sigmoid(net.raw(x)) - is_p)), settings, settings.seed)
    unseen = (positives[1::2], unlabelled[1::2])
    usable = all(map(len, unseen))
    prior = estimate_prior(plain.raw(unseen[0]), plain.raw(unseen[1]), settings.confidence) if usable else 0.5

    net = _new(positives, unlabelled, settings)
    net.prior = prior
    both, n_p, n_u = np.vstack([positives, unlabelled]), len(positives), len(unlabelled)

    def slopes(net: Network):
        out = net.raw(both)
        p, u = out[:n_p], out[n_p:]
        as_negative = lambda z: np.logaddexp(0, z)
        negative_risk = as_negative(u).mean() - prior * as_negative(p).mean()
        slope_p, slope_u = prior * _sigmoid(p) / n_p, _sigmoid(u) / n_u
        if negative_risk < -settings.slack:
            return both, np.concatenate([slope_p, -slope_u])
        good = -prior * _sigmoid(-p) / n_p
        return both, np.concatenate([good - slope_p, slope_u])

    _train(net, slopes, settings, settings.seed)
    return net


# --- tables ---------------------------------------------------------------------------
def held_out(doc_id: Column) -> Column:
    """A fixed quarter of the ids, from which no label is learnt. A missing id is not in it."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _sampled(rows: DataFrame, most: int, flag: str) -> DataFrame:
    return rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).withColumn(flag, F.lit(1))


def learn(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> Network:
    """Fit on ``docs`` (doc_id, text) and ``labels`` (doc_id, quality), neither held out.

    Trusted positives are ids all of whose labels are 1; any document may be unlabelled. The ids
    of the sample, at most ``settings.positives + settings.unlabelled``, are all that is broadcast,
    and their figures all that the driver gets.
    """
    usable = lambda rows: rows.filter(~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull())
    ids = usable(docs.select("doc_id")).distinct()
    trusted = usable(labels.select("doc_id", "quality")).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    trusted = trusted.filter("quality = 1").select("doc_id").join(ids, "doc_id", "left_semi")
    sample = (
        _sampled(trusted, settings.positives, "p")
        .join(_sampled(ids, settings.unlabelled, "u"), "doc_id", "full")
        .select("doc_id", F.coalesce("p", F.lit(0)).alias("p"), F.coalesce("u", F.lit(0)).alias("u"))
    )
    texts = documents(docs).join(F.broadcast(sample), "doc_id").select("doc_id", "text", "p", "u")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [features(t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("p"), batch.column("u"), pa.array(rows, pa.list_(pa.float64()))],
                ["doc_id", "p", "u", "x"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    found = texts.mapInArrow(measure, f"doc_id {kind}, p int, u int, x array<double>").collect()
    found.sort(key=lambda r: (r["doc_id"], r["x"]))
    pick = lambda flag: np.array([r["x"] for r in found if r[flag]], float).reshape(-1, len(NAMES))
    return fit(pick("p"), pick("u"), settings)


def _scores(net: Network, texts: pa.Array) -> np.ndarray:
    rows = [features((t.as_py() or "")) for t in texts]
    return net.score(np.array(rows, float).reshape(-1, len(NAMES)))


def scored(docs: DataFrame, net: Network, threshold: float = 0.7) -> DataFrame:
    """``doc_id``, ``held_out``, ``score`` and ``predicted`` of each row of ``docs``, from its whole text alone.
    Missing and empty texts have the score of an empty text; repeated rows score alike."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(_scores(net, batch.column("text")), pa.float64())], ["doc_id", "score"]
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    found = documents(docs).mapInArrow(run, f"doc_id {kind}, score double")
    return found.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )


def good_documents(docs: DataFrame, net: Network, threshold: float = 0.7) -> DataFrame:
    """The rows of ``docs``, all columns, that the classifier does not reject."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = _scores(net, batch.column(batch.schema.names.index("text"))) >= threshold
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
