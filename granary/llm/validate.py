"""Cross-validation of the fitted operators within the rows that their contracts let them learn from.

    python -m granary.llm.validate /root/testdata/sf0.1

Prints what the choices of ``toxicity.SPARE`` and ``language.MARGIN`` rest on: three folds by a hash
of the id, each judged by a fit on the other two. Rows that are held out by contract aren't read.
"""

from __future__ import annotations

import sys

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.llm import language, toxicity
from granary.llm.common import held_out
from granary.session import local_session, scratch, stage

FOLDS = 3


def fold(doc_id: str) -> Column:
    return F.pmod(F.xxhash64(F.col(doc_id).cast("string"), F.lit("fold")), F.lit(FOLDS))


def toxicity_scores(docs: DataFrame, labels: DataFrame, spare: float) -> list[tuple[float, int]]:
    """(score, label) of each labelled row, by the fit that hasn't seen its label."""
    own, out = labels.where(~held_out("doc_id", 4, 2)), []
    for k in range(FOLDS):
        index = toxicity.fit(docs, own.where(fold("doc_id") != k), spare=spare)
        judged = toxicity.score(docs.join(own.where(fold("doc_id") == k).select("doc_id", "toxic"), "doc_id"), index)
        out += [(r["score"], r["toxic"]) for r in judged.select("score", "toxic").collect()]
    return out


def area_under_curve(scores: np.ndarray, labels: np.ndarray) -> float:
    both = np.sort(scores)
    rank = (np.searchsorted(both, scores, "left") + np.searchsorted(both, scores, "right") + 1) / 2
    n1 = labels.sum()
    return float((rank[labels == 1].sum() - n1 * (n1 + 1) / 2) / max(n1 * (len(labels) - n1), 1))


def language_margins(docs: DataFrame) -> list[tuple[float, bool]]:
    """(margin, right) of each text with a language, by dictionaries of the other folds."""
    own, out = docs.where(~held_out("doc_id", 4, 2)).where("lang IS NOT NULL AND text IS NOT NULL"), []
    for k in range(FOLDS):
        contents = language.fit(own.where(fold("doc_id") != k))
        found = language.identify(own.where(fold("doc_id") == k), contents)
        out += [(r["score"], r["right"]) for r in found.select("score", (F.col("lang") == F.col("lang_pred")).alias("right")).collect()]
    return out


def main(sf_dir: str) -> None:
    spark = local_session()
    spark.sparkContext.setLogLevel("ERROR")
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    with scratch(spark):
        texts = stage(docs.select("doc_id", "text", "lang"), "validate")
        for spare in (20, 100, 1000, 10_000):
            s, y = map(np.array, zip(*toxicity_scores(texts.drop("lang"), labels, spare), strict=True))
            said, p = s >= 0.3, np.clip(s, 1e-6, 1 - 1e-6)
            loss = -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))
            print(f"toxicity, SPARE {spare}: precision {(said & (y == 1)).sum() / max(said.sum(), 1):.2f}, recall {(said & (y == 1)).sum() / max(y.sum(), 1):.2f}, AUC {area_under_curve(s, y):.3f}, log loss {loss:.3f}, {len(y)} rows, {y.sum()} toxic")
        m, right = map(np.array, zip(*language_margins(texts), strict=True))
        for margin in (0.0, 0.01, 0.02, 0.03, 0.05):
            narrow = m < margin
            print(f"language, margin {margin}: rejects {narrow.sum()} of {len(m)}, {(narrow & ~right).sum()} of the {(~right).sum()} wrong")


if __name__ == "__main__":
    main(sys.argv[1])
