"""Quality by histogram gradient-boosted trees over statistics of a document.

Statistics of whole texts are computed in batches. The trees are grown on a bounded sample of
labelled rows: statistics are cut into quantile bins once, each level of a tree adds gradients and
hessians by (node, bin) and takes the split with the largest gain. Trees are flattened into arrays
(feature, threshold, left child, leaf value), and a batch of documents walks all levels of a tree
together by numpy indexing.

Null and empty texts have all statistics 0 and get the score of that vector. With no labels, or
one label only, the score is the share of label 1 (0.5 with none). Of several texts of one labelled
id the one with the least hash is learned from, and of several labels the largest counts. Equal
texts get equal scores; a very long text is one task's work; an empty table gives an empty one. A
column ``score`` is replaced, others are kept.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm.common import first_by_hash, map_batches, one_text_each, schema_with, texts

#: Documented bound of the fit: labelled rows at most.
SAMPLE_ROWS = 12_000
TREES, DEPTH, BINS, RATE, LEAST_ROWS, RIDGE = 80, 4, 64, 0.1, 10, 1.0

STATISTICS = [
    "log_bytes", "log_words", "mean_word", "distinct_words", "repeated_neighbours", "top_word", "letters", "upper", "digits",
    "white", "other_ascii", "beyond_ascii", "bars", "shouts", "symbols", "stops", "log_lines", "distinct_lines", "mean_line",
    "words_in_upper", "words_ending_odd", "single_letter", "compressed",
]
_BYTES = np.arange(256)
_CLASS = {
    "upper": (_BYTES >= 65) & (_BYTES <= 90),
    "lower": (_BYTES >= 97) & (_BYTES <= 122),
    "digits": (_BYTES >= 48) & (_BYTES <= 57),
    "white": (_BYTES == 32) | (_BYTES >= 9) & (_BYTES <= 13),
    "beyond_ascii": _BYTES >= 128,
    "bars": _BYTES == ord("|"),
    "shouts": (_BYTES == ord("!")) | (_BYTES == ord("?")),
    "symbols": np.isin(_BYTES, np.frombuffer(b"#$%&*@^~<>{}[]\\_=+", np.uint8)),
    "stops": np.isin(_BYTES, np.frombuffer(b".,;:", np.uint8)),
}
_MASKS = np.stack(list(_CLASS.values())).astype(np.float64)


def statistics(text: str) -> list[float]:
    raw = text.encode()
    n = len(raw)
    if not n:
        return [0.0] * len(STATISTICS)
    upper, lower, digits, white, beyond, bars, shouts, symbols, stops = (_MASKS @ np.bincount(np.frombuffer(raw, np.uint8), minlength=256)) / n
    words, lines = raw.split(), raw.split(b"\n")
    m = len(words) or 1
    counts: dict[bytes, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    same = sum(map(bytes.__eq__, words, words[1:]))
    ends = sum(not (w[-1] >= 97 or w[-1] in b".,") for w in counts)
    shouted = sum(w.isupper() for w in counts)
    d = len(counts) or 1
    return [
        float(np.log1p(n)), float(np.log1p(len(words))), (n - white * n) / m, len(counts) / m, same / m, max(counts.values(), default=0) / m, upper + lower, upper, digits,
        white, 1 - upper - lower - digits - white - beyond, beyond, bars, shouts, symbols, stops, float(np.log1p(len(lines))), len(set(lines)) / len(lines), n / len(lines),
        shouted / d, ends / d, sum(len(w) == 1 for w in counts) / d, len(zlib.compress(raw, 1)) / n,
    ]


@dataclass
class Forest:
    """Flattened trees: node arrays of each tree lie one after another."""

    base: float
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int

    def margin(self, x: np.ndarray) -> np.ndarray:
        total, rows = np.full(len(x), self.base), np.arange(len(x))
        for root in self.roots:
            at = np.full(len(x), root)
            for _ in range(self.depth):
                inner = self.feature[at] >= 0
                right = x[rows, np.maximum(self.feature[at], 0)] > self.threshold[at]
                at = np.where(inner, self.left[at] + right, at)
            total += self.value[at]
        return total

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -30, 30)))


def grow(x: np.ndarray, y: np.ndarray) -> Forest:
    n, width = x.shape if len(x) else (0, len(STATISTICS))
    share = float(np.clip(y.mean(), 1e-4, 1 - 1e-4)) if n else 0.5
    base = float(np.log(share / (1 - share)))
    feature, threshold, left, value, roots = [], [], [], [], []
    if n and 0 < y.mean() < 1:
        edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(width)]
        binned = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)], 1)
        margin = np.full(n, base)
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-margin))
            g, h = p - y, p * (1 - p)
            roots.append(len(feature))
            feature.append(-1), threshold.append(0.0), left.append(0), value.append(0.0)
            at = np.full(n, roots[-1])
            level = [roots[-1]]
            for depth in range(DEPTH + 1):
                slot = np.full(len(feature), -1)
                slot[level] = np.arange(len(level))
                node = slot[at]
                live = node >= 0
                k = len(level)
                gs, hs = np.bincount(node[live], g[live], k), np.bincount(node[live], h[live], k)
                for i, v in enumerate(level):
                    value[v] = float(-RATE * gs[i] / (hs[i] + RIDGE))
                if depth == DEPTH:
                    break
                best = np.full(k, 1e-3)
                choice: list[tuple[int, int] | None] = [None] * k
                for j in range(width):
                    cell = node[live] * BINS + binned[live, j]
                    gl = np.cumsum(np.bincount(cell, g[live], k * BINS).reshape(k, BINS), 1)
                    hl = np.cumsum(np.bincount(cell, h[live], k * BINS).reshape(k, BINS), 1)
                    nl = np.cumsum(np.bincount(cell, minlength=k * BINS).reshape(k, BINS), 1)
                    gr, hr, nr = gs[:, None] - gl, hs[:, None] - hl, nl[:, -1:] - nl
                    gain = gl**2 / (hl + RIDGE) + gr**2 / (hr + RIDGE) - (gs**2 / (hs + RIDGE))[:, None]
                    gain[(nl < LEAST_ROWS) | (nr < LEAST_ROWS)] = 0
                    gain[:, len(edges[j]) :] = 0
                    b = gain.argmax(1)
                    better = gain[np.arange(k), b] > best
                    for i in np.flatnonzero(better):
                        best[i], choice[i] = gain[i, b[i]], (j, int(b[i]))
                following = []
                for i, v in enumerate(level):
                    if choice[i]:
                        j, b = choice[i]
                        feature[v], threshold[v], left[v] = j, float(edges[j][b]), len(feature)
                        for _side in range(2):
                            following.append(len(feature))
                            feature.append(-1), threshold.append(0.0), left.append(0), value.append(0.0)
                        mine = at == v
                        at[mine] = left[v] + (binned[mine, j] > b)
                level = following
                if not level:
                    break
            margin += np.array(value)[at]
    arrays = (np.array(feature, np.int32), np.array(threshold), np.array(left, np.int32), np.array(value))
    return Forest(base, *arrays, np.array(roots, np.int32), DEPTH)


def with_statistics(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` without its text and with ``_stats``, an array of doubles."""
    kept = df.drop("_stats")
    schema = schema_with(kept.drop(text), "_stats array<double>")

    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            rest = [i for i, n in enumerate(batch.schema.names) if n != text]
            rows = pa.array([statistics(t) for t in texts(batch, text)], pa.list_(pa.float64()))
            return pa.RecordBatch.from_arrays([*[batch.column(i) for i in rest], rows], [*[batch.schema.names[i] for i in rest], "_stats"])

        return work

    return map_batches(kept, make, schema)


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", most_rows: int = SAMPLE_ROWS) -> Forest:
    """``labels`` has the rows to learn from, of which the ``most_rows`` ids with the least hashes are
    taken, each with one text. The ids are bounded, so they are broadcast, and only the sample's
    statistics come to the driver."""
    marked = labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull()).groupBy(doc_id).agg(F.max(label).alias("_label"))
    sample = first_by_hash(marked, doc_id, most_rows)
    once = one_text_each(docs.select(doc_id, text).join(F.broadcast(sample.select(doc_id)), doc_id, "left_semi"), doc_id, text)
    rows = with_statistics(once.join(F.broadcast(sample), doc_id), text).select(doc_id, "_label", "_stats").toArrow().sort_by(doc_id)
    flat = rows.column("_stats").combine_chunks()
    x = np.asarray(flat.flatten()).reshape(-1, len(STATISTICS)) if rows.num_rows else np.zeros((0, len(STATISTICS)))
    return grow(x, np.asarray(rows.column("_label").to_numpy(), float))


def score(df: DataFrame, forest: Forest, text: str = "text") -> DataFrame:
    """Adds ``score``, the probability of label 1; a column of this name is replaced."""
    df = df.drop("score")
    schema = schema_with(df, "score double")

    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            x = np.array([statistics(t) for t in texts(batch, text)])
            return pa.RecordBatch.from_arrays([*batch.columns, pa.array(forest.score(x))], [*batch.schema.names, "score"])

        return work

    return map_batches(df, make, schema)
