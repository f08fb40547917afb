"""Quality rules (9): an isolation forest over rule statistics.

Every text gives the counts of the usual heuristics (words, symbols, words with
symbols, repeated lines, repeated five-word windows, words said twice in a row,
capitals, exclamation, word length).  Their ratios, as they are but for the
arcsine of the root that evens out the spread of shares, feed an isolation
forest: rows that random splits isolate after few steps are anomalous.

What the labels decide: a tree splits a statistic the more often the better it
tells good labelled rows from bad ones by rank; each tree's sample has at most a
twentieth of bad rows, as anomalies must be few in it; and the threshold on the
anomaly score is chosen from all labelled rows.  No cutoff is set by hand.

The forest is grown on at most ``max_fit`` labelled rows, those with the
smallest hashed ids; the threshold is chosen from counts of all labelled rows by
bins of their score, so what the driver holds is bounded.  All rows are scored.

Defined results: a null or empty text has no words, all counts are 0 and it
fails the base rules.  Repeated rows give repeated results.  Without labelled
rows of both kinds the verdict is the base rules' alone.  Labels with null ids or
null quality are ignored.  An empty table has an empty result; texts of any
length are read whole.  Other columns of the inputs are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from math import asin, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import guarded, lean, stored, values

SYMBOLS = b"#*$%&|<>"
SHOUTS = b"!?~^"
CAPITALS = bytes(range(65, 91))
SPACES = b" \t\n\x0b\x0c\r"
WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
#: Rows the forest is grown on, at most.
MAX_FIT = 6000
#: Bins of the score, which lies between 0 and 1, that the threshold is chosen from.
BINS = 1 << 16
#: Share of bad rows in a tree's sample, at most.
FEW = 0.05
FEATURES = ("symbols", "symbol_words", "dup_lines", "repeats", "capitals", "shouts", "runs", "word_length")
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
MARKED = re.compile(rb"[^ \t-\r]*[#*$%&|<>][^ \t-\r]*")


def window_codes(ids: np.ndarray, distinct: int, width: int) -> np.ndarray:
    """An exact integer code for each window of ``width`` ids: equal codes mean equal windows."""
    code, radix = ids.astype(np.int64), max(1, distinct)
    span = radix
    for _ in range(width - 1):
        if span * radix >= 1 << 62:
            code = np.unique(code, return_inverse=True)[1].astype(np.int64)
            span = int(code.max()) + 1
        code = code[:-1] * radix + ids[len(ids) - len(code) + 1 :]
        span *= radix
    return code


def repeated_words(words: list[bytes]) -> tuple[int, int]:
    """Words inside windows found twice or more, and words equal to the one before."""
    n = len(words)
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, n)
    runs = int(np.count_nonzero(ids[1:] == ids[:-1])) if n > 1 else 0
    if n <= WINDOW:
        return 0, runs
    _, inverse, counts = np.unique(window_codes(ids, len(seen), WINDOW), return_inverse=True, return_counts=True)
    if len(counts) == n - WINDOW + 1:
        return 0, runs
    twice = counts[inverse] > 1
    hit = np.zeros(n, bool)
    for k in range(WINDOW):
        hit[k : k + len(twice)] |= twice
    return int(np.count_nonzero(hit)), runs


def statistics(text: bytes | None) -> tuple[list[int], list[float]]:
    """The counts of COUNTS and the values of FEATURES of one text."""
    text = text or b""
    words = text.split()
    n = len(words)
    points = int(np.count_nonzero((np.frombuffer(text, np.uint8) & 0xC0) != 0x80))
    chars = points - (len(text) - len(text.translate(None, SPACES)))
    symbols = len(text) - len(text.translate(None, SYMBOLS))
    marked = sum(1 for _ in MARKED.finditer(text)) if symbols else 0
    lines, with_word, dup = set(), 0, 0
    for line in text.split(b"\n"):
        if line.strip():
            with_word += 1
            if line in lines:
                dup += 1
            lines.add(line)
    repeat, runs = repeated_words(words)
    capitals = len(text) - len(text.translate(None, CAPITALS))
    shouts = len(text) - len(text.translate(None, SHOUTS))
    # a prior of some clean words keeps short texts from looking extreme
    shares = (
        symbols / (chars + 20), marked / (n + 10), dup / (with_word + 3), repeat / (n + 10),
        capitals / (chars + 20), shouts / (chars + 20), runs / (n + 10),
    )
    return [n, chars, symbols, dup, repeat], [*(asin(sqrt(min(1.0, x))) for x in shares), chars / max(1, n)]


def base_failed(n_words, n_repeat):  # noqa: ANN001, ANN201
    """Of numbers, arrays or columns."""
    return (n_words < MIN_WORDS) | (100 * n_repeat > MAX_REPEAT_PERCENT * n_words)


def mean_path(n: np.ndarray | float) -> np.ndarray:
    """Mean depth of an unsuccessful search in a binary tree of n rows."""
    n = np.maximum(np.asarray(n, float), 1.0)
    safe = np.maximum(n - 1, 1e-9)
    value = 2 * (np.log(safe) + np.euler_gamma) - 2 * safe / n
    return np.where(n > 2, value, np.where(n > 1, 1.0, 0.0))


@dataclass
class Forest:
    """Random splits as flat arrays, a row a tree."""

    feature: np.ndarray
    split: np.ndarray
    child: np.ndarray
    depth: np.ndarray
    norm: float
    threshold: float = field(default=2.0)

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Anomaly in 0..1: 2 ** -(mean path length / expected path length)."""
        trees = len(self.feature)
        total = np.zeros(len(x))
        rows = np.arange(len(x))
        for t in range(trees):
            at = np.zeros(len(x), np.int64)
            while True:
                f = self.feature[t, at]
                inner = f >= 0
                if not inner.any():
                    break
                right = x[rows, np.maximum(f, 0)] >= self.split[t, at]
                at = np.where(inner, self.child[t, at] + right, at)
            total += self.depth[t, at]
        return 2.0 ** (-total / trees / self.norm)


def separation(x: np.ndarray, good: np.ndarray) -> np.ndarray:
    """How well each column tells good rows from others: 0 by chance, 1 wholly (twice the area under the curve, less 1)."""
    out = np.zeros(x.shape[1])
    n, m = int(good.sum()), int((~good).sum())
    for k in range(x.shape[1]) if n and m else ():
        _, at, counts = np.unique(x[:, k], return_inverse=True, return_counts=True)
        rank = (np.cumsum(counts) - (counts - 1) / 2)[at]  # ties share their mean rank
        out[k] = abs(2 * (rank[good].sum() - n * (n + 1) / 2) / (n * m) - 1)
    return out


def grow(x: np.ndarray, good: np.ndarray | None = None, trees: int = 100, sample: int = 128, seed: int = 9) -> Forest:
    """Isolation trees, each over ``sample`` rows drawn without replacement, by what ``good`` tells of the statistics."""
    rng = np.random.default_rng(seed)
    sample = min(sample, len(x))
    good = np.ones(len(x), bool) if good is None else good
    weight = separation(x, good)
    weight = weight if weight.any() else np.ones(x.shape[1])
    fine, poor = np.flatnonzero(good), np.flatnonzero(~good)
    few = min(len(poor), int(np.ceil(FEW * sample))) if len(fine) else min(len(poor), sample)
    limit = max(1, int(np.ceil(np.log2(max(2, sample))))) + 4
    size = 2 * sample + 2
    feature, split = np.full((trees, size), -1), np.zeros((trees, size))
    child, depth = np.zeros((trees, size), np.int64), np.zeros((trees, size))
    for t in range(trees):
        rows = np.concatenate([rng.choice(fine, min(len(fine), sample - few), replace=False), rng.choice(poor, few, replace=False)])
        todo, used = [(0, rows, 0)], 1
        while todo:
            node, own, level = todo.pop()
            low, high = x[own].min(0), x[own].max(0)
            wide = np.flatnonzero((high > low) & (weight > 0))
            if level >= limit or len(own) < 2 or not len(wide):
                depth[t, node] = level + mean_path(len(own))
                continue
            f = int(rng.choice(wide, p=weight[wide] / weight[wide].sum()))
            at = rng.uniform(low[f], high[f])
            at = at if at > low[f] else np.nextafter(low[f], high[f])
            feature[t, node], split[t, node], child[t, node] = f, at, used
            right = x[own, f] >= at
            todo += [(used, own[~right], level + 1), (used + 1, own[right], level + 1)]
            used += 2
    return Forest(feature, split, child, depth, float(mean_path(sample)))


def calibrate(scores: np.ndarray, good: np.ndarray, cost: float = 10.0) -> float:
    """The threshold of ``calibrate_counts`` for single rows."""
    own, at = np.unique(scores, return_inverse=True)
    return calibrate_counts(own, own, np.bincount(at[good], minlength=len(own)), np.bincount(at[~good], minlength=len(own)), cost)


def calibrate_counts(low: np.ndarray, high: np.ndarray, good: np.ndarray, bad: np.ndarray, cost: float = 10.0) -> float:
    """The score above which rows are rejected: least missed junk plus ``cost``
    times lost good rows, in shares; within the best range, its middle.  Given are
    the lowest and highest score and the good and bad rows of ascending bins."""
    if not good.sum() or not bad.sum():
        return 2.0
    cuts = np.concatenate([low[:1] - 1e-6, (low[1:] + high[:-1]) / 2, high[-1:] + 1e-6])
    lost = 1 - np.concatenate([[0], np.cumsum(good)]) / good.sum()
    missed = np.concatenate([[0], np.cumsum(bad)]) / bad.sum()
    loss = missed + cost * lost
    best = np.flatnonzero(loss <= loss.min() + 1e-12)
    return float((cuts[best[0]] + cuts[best[-1]]) / 2)


def _texts(batch: pa.RecordBatch, name: str = "text") -> Iterator[bytes | None]:
    return values(batch.column(batch.schema.get_field_index(name)))


def measured(docs: DataFrame) -> DataFrame:
    """(doc_id, counts, ratios) of every row of ``docs``, written to the shared folder: texts are read once."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [statistics(t) for t in _texts(b)]
            cells = [b.column(0), pa.array([c for c, _ in found], pa.list_(pa.int64())), pa.array([f for _, f in found], pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(cells, names=["doc_id", "counts", "ratios"])

    kind = dict(docs.dtypes)["doc_id"]
    return stored(docs.select("doc_id", "text").mapInArrow(lean(measure), f"doc_id {kind}, counts array<long>, ratios array<double>"), "quality")


def fit(docs: DataFrame, labels: DataFrame, max_fit: int = MAX_FIT) -> Forest | None:
    return fit_measured(measured(docs), labels, max_fit)


def fit_measured(rows: DataFrame, labels: DataFrame, max_fit: int = MAX_FIT) -> Forest | None:
    """Forest from the labelled of the ``measured`` rows with the smallest hashed ids, threshold from all labelled ones."""
    labelled = labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy("doc_id").agg(F.min("quality").cast("long").alias("quality"))
    chosen = labelled.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_fit)
    sample = (
        rows.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min(F.struct("counts", "ratios", "quality")).alias("r"))
        .orderBy("doc_id").limit(max_fit).collect()
    )
    known = [r["r"] for r in sample if not base_failed(r["r"]["counts"][0], r["r"]["counts"][4])]
    if not known:
        return None
    forest = grow(np.array([r["ratios"] for r in known]), np.array([r["quality"] > 0 for r in known]))
    forest.threshold = _threshold(rows, labelled, forest)
    return forest


def _threshold(rows: DataFrame, labelled: DataFrame, forest: Forest) -> float:
    """From the counts of good and bad rows by bins of the score, BINS at most."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(forest.scores(_matrix(b)))], names=[*b.schema.names, "score"])

    kind = dict(rows.dtypes)["doc_id"]
    known = rows.join(labelled, "doc_id").select("doc_id", "counts", "ratios", "quality")
    scored = (
        known.mapInArrow(lean(score), f"doc_id {kind}, counts array<long>, ratios array<double>, quality long, score double")
        .groupBy("doc_id", "quality").agg(F.min(F.struct("counts", "score")).alias("r"))
        .filter(~base_failed(F.col("r.counts")[0], F.col("r.counts")[4])).select("r.score", (F.col("quality") > 0).alias("good"))
    )
    bins = (
        scored.groupBy(F.floor(F.col("score") * BINS).alias("bin"))
        .agg(F.min("score").alias("low"), F.max("score").alias("high"), F.count_if("good").alias("good"), F.count_if(~F.col("good")).alias("bad"))
        .orderBy("bin").collect()
    )
    return calibrate_counts(*[np.array([r[c] for r in bins]) for c in ("low", "high", "good", "bad")])


def _matrix(batch: pa.RecordBatch, name: str = "ratios", wide: int = len(FEATURES)) -> np.ndarray:
    """A column of lists of equal length as an array, a row a list."""
    own = batch.column(batch.schema.get_field_index(name))
    return own.flatten().to_numpy(zero_copy_only=False).reshape(len(own), wide)


def _verdict(forest: Forest | None, counts: np.ndarray, ratios: np.ndarray) -> list[pa.Array]:
    """The counts, score, base_failed and kept."""
    score = forest.scores(ratios) if forest else np.zeros(len(counts))
    failed = base_failed(counts[:, 0], counts[:, 4])
    kept = ~failed & ((score <= forest.threshold) if forest else True)
    return [*(pa.array(counts[:, k]) for k in range(len(COUNTS))), pa.array(score), pa.array(failed), pa.array(kept)]


VERDICT = ", ".join([f"{c} long" for c in COUNTS] + ["score double", "base_failed boolean", "kept boolean"])


def judge(docs: DataFrame, labels: DataFrame, carry: tuple[str, ...] = ("doc_id",), max_fit: int = MAX_FIT) -> DataFrame:
    """``carry`` columns, the counts, ``score``, ``base_failed`` and ``kept`` of every row.

    Texts are measured once; where more than doc_id is carried, once more: that is cheaper than to write all texts
    beside their measures.
    """
    rows = measured(docs)
    forest = fit_measured(rows, labels, max_fit)
    again = set(carry) != {"doc_id"}

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            if again:
                found = [statistics(t) for t in _texts(b)]
                counts, ratios = np.array([c for c, _ in found], np.int64), np.array([f for _, f in found])
            else:
                counts, ratios = _matrix(b, "counts", len(COUNTS)), _matrix(b)
            own = [b.column(b.schema.get_field_index(c)) for c in carry]
            yield pa.RecordBatch.from_arrays([*own, *_verdict(forest, counts, ratios)], names=[*carry, *COUNTS, "score", "base_failed", "kept"])

    kinds = dict(docs.dtypes)
    schema = ", ".join([f"`{c}` {kinds[c]}" for c in carry] + [VERDICT])
    source = docs.select(*[c for c in carry if c != "text"], "text") if again else rows
    return source.mapInArrow(lean(apply), schema)


def keep(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that pass, with their columns."""
    return guarded(docs, {"doc_id", "text"}, lambda d: judge(d, labels, tuple(d.columns)).filter("kept"))
