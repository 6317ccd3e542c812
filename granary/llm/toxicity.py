"""Toxicity by the nearest labelled examples under exact TF-IDF cosine.

The examples are a bounded sample of labelled rows, with their whole texts. The terms of the space
are all words that occur significantly more often in examples with label 1, so that a few such
words count in a long text; how many there are is up to the test alone. Near copies among the
examples, which share the least hash of their five-word shingles, count once in the test.

The examples lie in an inverted index: each term has its postings, example and weight, in order of
examples, cut into blocks with the largest weight of each. A query's bound for a block is the sum
of query weights times these; blocks are scored from the highest bound down and the search ends
when no bound beats the k-th score, so the k nearest are exact.

Neighbours vote with weights that fall with distance, and by how many labelled rows each stands
for; the vote is calibrated by a logistic curve fitted on the examples' own leave-one-out votes.
The nearest example, its similarity and the terms in common are the evidence.

Null and empty texts, and texts with no term, have no neighbour and get the calibrated share of
label 1 among such examples. With no labels the score is 0. Equal texts get equal scores, and ties
between examples go to the lower place in the index. Of several texts of one labelled id the one
with the least hash is the example, and of several labels the largest counts. Very long texts are
one task's work. An empty table gives an empty one; repeated rows are scored as any others; columns
named as those that are added are replaced, others are kept.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.llm.common import first_by_hash, map_batches, one_text_each, schema_with, texts
from granary.llm.similarity import shingles
from granary.session import stage

#: Documented bounds of the fit: examples with label 1 and with label 0.
MOST_TOXIC, MOST_CLEAN = 2000, 6000
#: A term counts if it's in so many examples of different text, so many times likelier, and at a
#: chi-square that a thousand times as many chance terms as there are would hardly reach.
LEAST_EXAMPLES, LEAST_LIFT, SPARE = 3, 2.0, 1000
BLOCK, NEAREST = 64, 25
_WORD = re.compile(r"\w+")


def _counts(text: str) -> dict[str, int]:
    out: dict[str, int] = {}
    for w in _WORD.findall(text.lower()):
        out[w] = out.get(w, 0) + 1
    return out


class Postings:
    """Each term's examples and weights, cut into blocks of examples."""

    def __init__(self, terms: np.ndarray, places: np.ndarray, weights: np.ndarray, n_terms: int, n_places: int):
        order = np.lexsort((places, terms))
        terms, self.place, self.weight = terms[order], places[order], weights[order]
        self.blocks = -(-n_places // BLOCK)
        cell = terms * max(self.blocks, 1) + self.place // BLOCK
        begins = np.flatnonzero(np.diff(cell, prepend=-1)) if len(cell) else np.zeros(0, np.int64)
        #: Of each run of postings, which is a term's in a block: where it begins, its block, its largest weight.
        self.start = np.append(begins, len(cell)).astype(np.int64)
        self.block = self.place[begins] // BLOCK
        self.largest = np.maximum.reduceat(self.weight, begins) if len(begins) else np.zeros(0)
        #: A term's runs are those from ``first[term]`` to ``first[term + 1]``.
        self.first = np.searchsorted(terms[begins], np.arange(n_terms + 1))
        self.by_place = np.argsort(self.place, kind="stable")
        self.begin = np.searchsorted(self.place[self.by_place], np.arange(n_places + 1))
        self.term = terms

    def example(self, place: int) -> tuple[np.ndarray, np.ndarray]:
        """Terms of an example in order, and their weights."""
        at = self.by_place[self.begin[place] : self.begin[place + 1]]
        at = at[np.argsort(self.term[at])]
        return self.term[at], self.weight[at]

    def nearest(self, at: np.ndarray, w: np.ndarray, k: int, but: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """Places and cosines of the k nearest examples with cosine above 0, nearest first."""
        counts = self.first[at + 1] - self.first[at]
        runs = np.repeat(self.first[at] - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
        own = np.repeat(w, counts)
        blocks = self.block[runs]
        bound = np.bincount(blocks, own * self.largest[runs], self.blocks)
        order = np.argsort(blocks, kind="stable")
        ends = np.searchsorted(blocks[order], np.arange(self.blocks + 1))
        places, scores = np.zeros(0, np.int64), np.zeros(0)
        for b in np.argsort(-bound, kind="stable"):
            if bound[b] <= 1e-12 or len(places) == k and bound[b] < scores[-1] - 1e-12:
                break
            got = np.zeros(BLOCK)
            for i in order[ends[b] : ends[b + 1]]:
                here = slice(self.start[runs[i]], self.start[runs[i] + 1])
                got[self.place[here] - b * BLOCK] += own[i] * self.weight[here]
            if but // BLOCK == b:
                got[but % BLOCK] = 0.0
            here = np.flatnonzero(got > 1e-12)
            places, scores = np.concatenate([places, here + b * BLOCK]), np.concatenate([scores, got[here]])
            first = np.lexsort((places, -np.round(scores, 12)))[:k]
            places, scores = places[first], scores[first]
        return places, scores


@dataclass
class Index:
    terms: dict[str, int]
    idf: np.ndarray
    postings: Postings
    label: np.ndarray
    stands_for: np.ndarray
    ids: np.ndarray
    nothing: tuple[float, float]
    """Mass of label 1 and of all among examples without a term"""
    curve: tuple[float, float] = (1.0, 0.0)

    def __post_init__(self):
        self.names = list(self.terms)

    def vector(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        found: dict[int, int] = {}
        get = self.terms.get
        for w in _WORD.findall(text.lower()):
            i = get(w)
            if i is not None:
                found[i] = found.get(i, 0) + 1
        at = np.array(sorted(found), np.int64)
        return at, self.weighed(at, np.array([found[i] for i in at], float))

    def weighed(self, at: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """TF-IDF weights of terms with their counts, of length 1."""
        w = (1 + np.log(counts)) * self.idf[at]
        return w / (np.linalg.norm(w) or 1.0)

    def vote(self, places: np.ndarray, scores: np.ndarray) -> float:
        """Log odds of the mass of label 1 near by, with the examples without a term as one more
        neighbour at distance 1."""
        share = (self.nothing[0] + 0.1) / (self.nothing[1] + 1)
        if not len(places):
            return float(np.log(share / (1 - share)))
        mass = self.stands_for[places] / (1.02 - scores)
        far = 1 / 1.02 * float(self.stands_for[places].mean())
        p = ((mass * self.label[places]).sum() + far * share) / (mass.sum() + far)
        return float(np.log(p / (1 - p)))

    def calibrated(self, vote: float) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.curve[0] * vote + self.curve[1], -30, 30))))

    def judge(self, text: str) -> tuple[float, int | None, float, list[str]]:
        """Score, the nearest example's id, its similarity, the terms in common."""
        if not self.terms:
            return self.calibrated(self.vote(np.zeros(0, np.int64), np.zeros(0))) if self.nothing[1] else 0.0, None, 0.0, []
        at, w = self.vector(text)
        places, scores = self.postings.nearest(at, w, NEAREST)
        score = self.calibrated(self.vote(places, scores))
        if not len(places):
            return score, None, 0.0, []
        shared = np.intersect1d(at, self.postings.example(int(places[0]))[0])
        return score, int(self.ids[places[0]]), float(scores[0]), [self.names[i] for i in shared]


def _logistic(x: np.ndarray, y: np.ndarray, mass: np.ndarray) -> tuple[float, float]:
    """Slope (0.2 at least, so that the order stays) and offset, by Newton steps."""
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        h = mass * p * (1 - p)
        grad = np.array([(mass * (p - y) * x).sum() + 0.1 * (a - 1), (mass * (p - y)).sum() + 0.1 * b])
        hess = np.array([[(h * x * x).sum() + 0.1, (h * x).sum()], [(h * x).sum(), h.sum() + 0.1]])
        step = np.linalg.solve(hess, grad)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-9:
            break
    return float(max(a, 0.2)), float(b)


def counted_examples(docs: DataFrame, labels: DataFrame, doc_id: str, text: str, label: str, most_toxic: int, most_clean: int) -> tuple[DataFrame, dict[int, int]]:
    """``(id, label, kind, counts)`` of the sample, and how many ids have each label."""
    marked = labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull()).groupBy(doc_id).agg(F.max(label).cast("int").alias("_label"))
    totals = {r["_label"]: r["n"] for r in marked.groupBy("_label").agg(F.count(F.lit(1)).alias("n")).collect()}
    sample = first_by_hash(marked.where("_label = 1"), doc_id, most_toxic).unionByName(first_by_hash(marked.where("_label = 0"), doc_id, most_clean))
    rows = one_text_each(docs.select(doc_id, text).join(F.broadcast(sample.select(doc_id)), doc_id, "left_semi"), doc_id, text).join(F.broadcast(sample), doc_id)

    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            whole = texts(batch, text)
            kinds = [int(x[0]) - (1 << 63) if len(x := shingles(t)) else 0 for t in whole]
            counts = [list(_counts(t).items()) for t in whole]
            columns = [batch.column(doc_id).cast(pa.int64()), batch.column("_label"), pa.array(kinds, pa.int64()), pa.array(counts, pa.map_(pa.string(), pa.int32()))]
            return pa.RecordBatch.from_arrays(columns, ["id", "label", "kind", "counts"])

        return work

    return stage(map_batches(rows, make, "id bigint, label int, kind bigint, counts map<string,int>"), "toxicity"), totals


def telling_terms(counted: DataFrame, spare: float = SPARE) -> tuple[list[tuple[str, float]], float]:
    """``(term, examples that have it)`` of all terms that pass the test, and the number of examples,
    near copies counted once. The counts stay distributed."""
    once = counted.groupBy("label", "kind").agg(F.min(F.struct("id", F.map_keys("counts").alias("terms"))).alias("x")).select("label", "x.terms")
    differ = {r["label"]: float(r["n"]) for r in once.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    n1, n0 = differ[1], differ[0]
    freq = once.select("label", F.explode("terms").alias("term")).groupBy("term").agg(F.sum("label").cast("double").alias("a"), F.count(F.lit(1)).cast("double").alias("n"))
    b = F.col("n") - F.col("a")
    chi2 = (n1 + n0) * F.pow(F.col("a") * (n0 - b) - b * (n1 - F.col("a")), 2) / (F.col("n") * (n1 + n0 - F.col("n")) * n1 * n0 + 1e-9)
    lift = ((F.col("a") + 0.5) / (n1 + 1)) / ((b + 0.5) / (n0 + 1))
    freq = stage(freq.where(F.col("a") >= LEAST_EXAMPLES), "toxicity-terms")
    least = 2 * np.log(spare * max(freq.count(), 1))
    chosen = freq.where((chi2 >= least) & (lift >= LEAST_LIFT)).select("term", "n", chi2.alias("chi2")).collect()
    return [(r["term"], r["n"]) for r in sorted(chosen, key=lambda r: (-r["chi2"], r["term"]))], n1 + n0


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", most_toxic: int = MOST_TOXIC, most_clean: int = MOST_CLEAN, spare: float = SPARE) -> Index:
    """Index of a bounded sample of ``labels``: the ``most_toxic`` and ``most_clean`` ids with the least
    hashes. The driver gets the telling terms and the examples' counts of these alone."""
    counted, totals = counted_examples(docs, labels, doc_id, text, label, most_toxic, most_clean)
    found = {r["label"]: r["n"] for r in counted.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    n1, n0 = found.get(1, 0), found.get(0, 0)
    nowhere = Postings(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), 0, 0)
    if not n1 or not n0:
        return Index({}, np.zeros(0), nowhere, np.zeros(0), np.zeros(0), np.zeros(0), (float(n1), float(n1 + n0)))
    chosen, n = telling_terms(counted, spare)
    terms = {term: i for i, (term, _) in enumerate(chosen)}

    def make():
        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            own = [[(terms[t], c) for t, c in counts if t in terms] for counts in batch.column("counts").to_pylist()]
            columns = [batch.column("id"), batch.column("label"), pa.array([[i for i, _ in x] for x in own], pa.list_(pa.int64())), pa.array([[c for _, c in x] for x in own], pa.list_(pa.int64()))]
            return pa.RecordBatch.from_arrays(columns, ["id", "label", "own", "counts"])

        return work

    examples = sorted(map_batches(counted.select("id", "label", "counts"), make, "id bigint, label int, own array<bigint>, counts array<bigint>").collect(), key=lambda r: r["id"])
    stands = {1: totals[1] / n1, 0: totals[0] / n0}
    nothing, kept = [0.0, 0.0], []
    for r in examples:
        if r["own"]:
            kept.append(r)
        else:
            nothing[0] += stands[1] * (r["label"] == 1)
            nothing[1] += stands[r["label"]]
    # Neighbouring examples share terms, which keeps the blocks' largest weights apart.
    kept.sort(key=lambda r: (min(r["own"]), r["id"]))
    of = lambda values, kind=float: np.array(values, kind)
    index = Index(terms, np.log1p(n / of([c for _, c in chosen])), nowhere, of([r["label"] for r in kept]), of([stands[r["label"]] for r in kept]), of([r["id"] for r in kept], np.int64), (nothing[0], nothing[1]))
    if kept:
        weights = [index.weighed(of(r["own"], np.int64), of(r["counts"])) for r in kept]
        index.postings = Postings(np.concatenate([of(r["own"], np.int64) for r in kept]), np.repeat(np.arange(len(kept)), [len(w) for w in weights]), np.concatenate(weights), len(terms), len(kept))
        votes = [index.vote(*index.postings.nearest(*index.postings.example(j), NEAREST, but=j)) for j in range(len(kept))]
        votes.append(index.vote(np.zeros(0, np.int64), np.zeros(0)))
        y = np.array([*[float(r["label"]) for r in kept], nothing[0] / max(nothing[1], 1e-9)])
        index.curve = _logistic(np.array(votes), y, np.array([*[stands[r["label"]] for r in kept], nothing[1]]))
    return index


def score(df: DataFrame, index: Index, text: str = "text") -> DataFrame:
    """Adds ``score`` and its evidence: ``nearest_id``, ``similarity`` and ``terms``. Columns of
    these names are replaced. The index is bounded, and goes to the workers by broadcast."""
    df = df.drop("score", "nearest_id", "similarity", "terms")
    schema = schema_with(df, "score double, nearest_id bigint, similarity double, terms array<string>")
    shared = df.sparkSession.sparkContext.broadcast(index)

    def make():
        ix = shared.value

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            got = [ix.judge(t) for t in texts(batch, text)]
            kinds = (pa.float64(), pa.int64(), pa.float64(), pa.list_(pa.string()))
            columns = [pa.array(c, k) for c, k in zip(zip(*got, strict=True), kinds, strict=True)]
            return pa.RecordBatch.from_arrays([*batch.columns, *columns], [*batch.schema.names, "score", "nearest_id", "similarity", "terms"])

        return work

    return map_batches(df, make, schema)
