"""Language by compression: the language whose text best predicts a text encodes it smallest.

For each language a raw-content zstandard dictionary is made of whole documents, a bounded sample of
its rows. Texts and samples are lower-cased, and what is neither a letter nor a mark on one becomes
one space. A text is cut into blocks that are encoded alone with each dictionary, over its whole
length, so that the dictionary rather than the text's own start does the prediction; the sizes are
summed.

Null texts and texts without a letter are ``und`` with score 0. Ties go to the first language by
code point. With no labelled text at all, an empty table among them, everything is ``und``. Texts
whose margin is under ``min_margin`` are marked rejected, and so are those that are ``und``. A very
long text is encoded block by block in one task. Repeated rows are rows of their own; an empty table
gives an empty one; columns named as those that are added are replaced, others are kept.
"""

from __future__ import annotations

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from granary.llm.common import map_batches, schema_with

#: Documented bounds of the fit: documents of each language at most, and bytes of their texts in all.
#: Documents are taken or left whole; where the shortest of a language is larger, it's taken alone.
SAMPLE_DOCS, SAMPLE_BYTES = 64, 1 << 18
BLOCK_BYTES, LEVEL = 1024, 6
#: Languages whose dictionaries stay in a worker's memory; those beyond are made anew for each batch.
KEPT_LANGUAGES = 64
#: Margin under which a prediction is rejected, by threefold cross-validation within rows that aren't held out.
MARGIN = 0.02
_LETTER = regex.compile(r"\p{L}")
_NO_LETTERS = regex.compile(r"[^\p{L}\p{M}]+")


def folded(text: str) -> str:
    """Lower-case words between single spaces; empty without a letter."""
    if not _LETTER.search(text):
        return ""
    return f" {_NO_LETTERS.sub(' ', text.lower()).strip()} "


def fit(labelled: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", most_docs: int = SAMPLE_DOCS, most_bytes: int = SAMPLE_BYTES) -> dict[str, bytes]:
    """Dictionary content by language. Each of ``most_docs`` hash slots of a language gives the document
    with the least hash among those that fit ``most_bytes``, pre-aggregated before the shuffle; of
    these the shortest come first, as many as fit together."""
    key = F.xxhash64(F.col(doc_id).cast("string"), F.col(text))
    rows = labelled.where(F.col(lang).isNotNull() & F.col(text).rlike(r"\p{L}"))
    rows = rows.select(F.col(lang).alias("_lang"), F.pmod(key, F.lit(most_docs)).alias("_slot"), key.alias("_key"), F.octet_length(text).alias("_size"), F.col(text).alias("_text"))
    least = F.min(F.struct((F.col("_size") > most_bytes).alias("long"), F.col("_key").alias("key"), F.col("_size").alias("size"), F.col("_text").alias("text"))).alias("_least")
    taken = rows.groupBy("_lang", "_slot").agg(least).select("_lang", "_least.*")
    order = Window.partitionBy("_lang").orderBy("size", "key")
    fitting = taken.withColumn("_sum", F.sum(F.col("size").cast("bigint")).over(order)).withColumn("_at", F.row_number().over(order)).where((F.col("_sum") <= most_bytes) | (F.col("_at") == 1))
    out: dict[str, list[tuple[int, str]]] = {}
    for r in fitting.select("_lang", "key", "text").collect():
        out.setdefault(r["_lang"], []).append((r["key"], r["text"]))
    return {name: "".join(folded(t) for _, t in sorted(out[name])).encode() for name in sorted(out)}


class Model:
    def __init__(self, contents: dict[str, bytes]):
        self.contents, self.langs, self.kept = contents, sorted(contents), {}

    def coder(self, i: int):
        import zstandard

        if i in self.kept:
            return self.kept[i]
        d = zstandard.ZstdCompressionDict(self.contents[self.langs[i]], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(level=LEVEL)
        made = zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False)
        if i < KEPT_LANGUAGES:
            self.kept[i] = made
        return made

    def predict(self, text: str | None) -> tuple[str, float]:
        return self.predict_all([text])[0]

    def predict_all(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """One language after the other over all texts, so that memory doesn't grow with languages."""
        raws = [folded(t or "").encode() for t in texts]
        blocks = [[raw[i : i + BLOCK_BYTES] for i in range(0, len(raw), BLOCK_BYTES)] for raw in raws]
        sizes: list[list[int]] = [[] for _ in raws]
        for i in range(len(self.langs)):
            compress = self.coder(i).compress
            for own, bs in zip(sizes, blocks, strict=True):
                if bs:
                    own.append(sum(len(compress(b)) for b in bs))
        return [self._best(own) for own in sizes]

    def _best(self, sizes: list[int]) -> tuple[str, float]:
        if not sizes:
            return "und", 0.0
        best = min(range(len(sizes)), key=lambda i: (sizes[i], i))
        rest = min((s for i, s in enumerate(sizes) if i != best), default=2 * sizes[best])
        return self.langs[best], min(1.0, (rest - sizes[best]) / max(rest, 1))


def identify(df: DataFrame, contents: dict[str, bytes], text: str = "text", min_margin: float = MARGIN) -> DataFrame:
    """Adds ``lang_pred``, ``score`` (relative margin to the next language, 0 to 1) and
    ``rejected``. Columns of these names are replaced."""
    df = df.drop("lang_pred", "score", "rejected")
    schema = schema_with(df, "lang_pred string, score double, rejected boolean")

    def make():
        model = Model(contents)

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            got = model.predict_all(batch.column(text).to_pylist())
            columns = [pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64()), pa.array([g[0] == "und" or g[1] < min_margin for g in got], pa.bool_())]
            return pa.RecordBatch.from_arrays([*batch.columns, *columns], [*batch.schema.names, "lang_pred", "score", "rejected"])

        return work

    return map_batches(df, make, schema)
