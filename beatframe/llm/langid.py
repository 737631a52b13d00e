"""Language identification with blended-spectrum presence kernels, Nyström landmarks and kernel ridge regression."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from beatframe.llm.common import map_texts, stored, table

BUCKETS = 1 << 14
SPECTRUM = (1, 2, 3, 4)
UNKNOWN = "und"
_ODD = np.array([0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35, 0x27D4EB2F], dtype=np.uint32)


def presence(texts: pa.Array) -> np.ndarray:
    """A row for each text: which buckets its n-grams of 1 to 4 bytes fall in (1 or 0)."""
    out = np.zeros((len(texts), BUCKETS), dtype=np.float32)
    for i, t in enumerate(texts):
        b = np.frombuffer(t.as_buffer(), dtype=np.uint8) if t.is_valid else np.zeros(0, np.uint8)
        code = np.zeros(len(b), dtype=np.uint32)
        for n in SPECTRUM:
            if len(b) < n:
                break
            code = code[: len(b) - n + 1] * np.uint32(257) + b[n - 1 :]
            out[i, ((code + np.uint32(n)) * _ODD[n - 1]) >> np.uint32(18)] = 1
    return out


@dataclass(frozen=True)
class Model:
    """Languages, and one matrix or two whose product with presence rows (normalised) gives each language's margin, with intercepts."""

    names: list[str]
    weights: list[np.ndarray]
    intercept: np.ndarray

    def margins(self, x: np.ndarray) -> np.ndarray:
        s = x
        for w in self.weights:
            s = s @ w
        return s / np.sqrt(np.maximum(x.sum(1, keepdims=True), 1)) + self.intercept


def fit(x: np.ndarray, langs: list[str], *, landmarks: int, ridge: float) -> Model:
    """One-versus-rest ridge regression on Nyström features.

    Landmarks take turns over the languages. With L the landmarks' normalised presence rows, a text's
    features are K(x, L) K(L, L)^-1/2; each language's ridge regression on them is against all others. As
    K(x, L) is a product of x with L, landmarks and coefficients fold into one matrix, unless there are more
    languages than landmarks; then both stay, so that neither grows beyond buckets x landmarks.
    """
    names = sorted(set(langs))
    by = {k: [i for i, v in enumerate(langs) if v == k] for k in names}
    turns = [i for r in range(max(map(len, by.values()))) for k in names for i in by[k][r : r + 1]][:landmarks]
    rows = x / np.sqrt(np.maximum(x.sum(1, keepdims=True), 1))
    mark = rows[turns]
    values, vectors = np.linalg.eigh((mark @ mark.T).astype(np.float64))
    values = np.maximum(values, 0)
    good = values > 1e-6 * values.max(initial=1e-12)
    white = vectors[:, good] / np.sqrt(values[good])
    f = (rows @ mark.T).astype(np.float64) @ white
    y = np.where(np.array(langs)[:, None] == np.array(names)[None], 1.0, -1.0)
    mean, middle = f.mean(0), y.mean(0)
    g = f - mean
    coef = np.linalg.solve(g.T @ g + ridge * np.eye(g.shape[1]), g.T @ (y - middle))
    parts = [mark.T.astype(np.float64), white @ coef]
    weights = [parts[0] @ parts[1]] if len(names) <= landmarks else parts
    return Model(names, [w.astype(np.float32) for w in weights], (middle - mean @ coef).astype(np.float32))


def learned(labelled: DataFrame, *, text: str = "text", lang: str = "lang", order: str = "doc_id", per_language: int = 300, sample_rows: int = 16_384, landmarks: int = 256, ridge: float = 1.0) -> Model | None:
    """Fits on a bounded sample of labelled rows with a letter: of each language its distinct rows of least hash of text and order column, per_language at most.

    A row that is repeated counts once, and null or shared ids make no two texts alike, so the sample is as
    large as it can be whatever the ids are; it doesn't depend on partitions. Languages' sizes come from
    sketches; no task ranks more than about twice what it keeps of a language. At most sample_rows rows' presence bits (2 kB each) go to the driver; where languages are so many that
    per_language of each would be more, each has fewer. None when there is nothing to learn from. Rows without a label teach nothing.
    """
    of = F.xxhash64(F.lit("sample"), F.col(order).cast("string"), F.lit("of"), text)  # null ids leave the hash of the text
    rows = labelled.filter(F.col(lang).isNotNull() & F.col(text).rlike(r"\p{L}")).select(F.col(lang).alias("_lang"), F.col(text).alias("text"), of.alias("h"))
    counts = stored(rows.groupBy("_lang").agg(F.approx_count_distinct("h", 0.02).alias("count")))
    several = counts.count()
    if not several:
        return None
    each = max(1, min(per_language, sample_rows // several))
    u = F.pmod("h", F.lit(1 << 30)).cast("double") / (1 << 30)
    share = F.least(F.lit(1.0), (F.lit(1.6 * each) + 16) / F.col("count"))
    drawn = rows.join(counts, "_lang").filter(u < share).groupBy("_lang", "h").agg(F.first("text").alias("text"))
    first = F.row_number().over(Window.partitionBy("_lang").orderBy(F.pmod("h", F.lit(1 << 30)), "h"))  # of about 1.6 * each rows of a language
    sample = drawn.withColumn("n", first).filter(F.col("n") <= each)

    def bits(slices):
        for texts in slices:
            yield [pa.array([np.packbits(r > 0).tobytes() for r in presence(texts)], pa.binary())]

    found = map_texts(sample, ["_lang", "n"], F.lower("text"), bits, "bits binary", slice_bytes=200_000).select("row.*", "bits").orderBy("n", "_lang", "bits").limit(sample_rows).collect()
    if not found:  # only where all languages are far rarer than their sketches say
        return None
    x = np.stack([np.unpackbits(np.frombuffer(r["bits"], np.uint8)) for r in found]).astype(np.float32)
    return fit(x, [r["_lang"] for r in found], landmarks=landmarks, ridge=ridge)


def identify(docs: DataFrame, model: Model | None, *, keep: list[str], text: str = "text") -> DataFrame:
    """row (struct of keep), lang_pred, score for each row of docs, by a model that learned() gave.

    score is half of one more than the largest margin, cut to 0 to 1: below 0.5 every language's regression
    says "rest". Whole texts are read, however long. `und` with score 0: null texts, texts without a letter,
    and every text where there is no model. Repeated rows get equal results. A tie goes to the first
    language by name. Empty table: no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 16 MB for each of its matrices at most

    def predict(slices):
        for texts in slices:
            n = len(texts)
            if shared.value is None:
                yield [pa.array([UNKNOWN] * n), pa.array([0.0] * n)]
                continue
            s = shared.value.margins(presence(texts))
            known = np.asarray(texts.is_valid())
            yield [pa.array([shared.value.names[i] if k else UNKNOWN for i, k in zip(s.argmax(1), known, strict=True)]), pa.array(np.where(known, np.clip((s.max(1).astype(np.float64) + 1) / 2, 0, 1), 0.0))]

    read = F.when(docs[text].rlike(r"\p{L}"), F.lower(docs[text]))
    return map_texts(docs, keep, read, predict, "lang_pred string, score double", slice_bytes=400_000)


def op9_language(spark, sf_dir: str) -> DataFrame:
    """identify over all documents, learned from those outside the held-out fold; see there."""
    docs = table(spark, sf_dir, "documents")
    fold = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4, F.lit(0))
    out = identify(docs, learned(docs.filter(fold != 2)), keep=["doc_id"])
    return out.select("row.doc_id", "lang_pred", "score").select("doc_id", (fold == 2).alias("held_out"), "lang_pred", "score")
