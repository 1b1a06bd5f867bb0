"""Quality by nearest-neighbour voting in a latent-semantic space.

A bounded sample of labelled rows (``SAMPLE`` documents, the only data that
reaches the driver) fits the space: hashed word and word-shape terms, square
roots of their shares, inverse document frequency, and a truncated singular
value decomposition.  The sample's vectors are broadcast (under 1 MB), every
document's cosines with all of them are computed in blocks, and the nearest
``NEIGHBOURS`` vote with weights that grow with similarity.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrine.llm import common as C
from vitrine.llm.common import values_of

SAMPLE = 4096        # bound of the labelled sample
WORDS = 512          # hashed word terms
SHAPES = 512         # hashed shape terms; the last counts words that repeat their predecessor
DIMENSIONS = 48
NEIGHBOURS = 31
SHARPNESS = 8        # a neighbour's weight is its cosine to this power
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
CACHE = 200_000      # distinct words a task remembers


class Terms(dict):
    """Word -> packed term numbers, worked out once per distinct word."""

    def __missing__(self, word: str) -> int:
        if len(self) >= CACHE:
            self.clear()
        core = word.strip(PUNCTUATION)
        if core.isalpha():
            at = word.find(core)
            shape = word[:at] + ("a" if core.islower() else "Aa" if core[1:].islower() else "A") + word[at + len(core):]
        else:
            shape = re.sub(r"\d+", "9", re.sub(r"[^\W\d_]+", "a", word))
        if len(shape) > 3:
            shape = re.sub(r"(.)\1+", r"\1", shape)
        packed = zlib.crc32(core.lower().encode()) % WORDS * SHAPES + zlib.crc32(shape.encode()) % (SHAPES - 1)
        self[word] = packed
        return packed


def term_shares(text: str | None, terms: Terms) -> np.ndarray:
    """Square roots of the shares of each term; zeros for a text without words."""
    out = np.zeros(WORDS + SHAPES, np.float32)
    words = (text or "").split()
    if words:
        packed = np.fromiter(map(terms.__getitem__, words), np.int64, len(words))
        out[:WORDS] = np.bincount(packed // SHAPES, minlength=WORDS)
        out[WORDS:] = np.bincount(packed % SHAPES, minlength=SHAPES)
        out[-1] = np.count_nonzero(packed[1:] == packed[:-1])
        out /= len(words)
        np.sqrt(out, out)
    return out


def unit(rows: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(rows, axis=1, keepdims=True)
    return np.divide(rows, norm, out=np.zeros_like(rows), where=norm > 0)


def fit(shares: np.ndarray, labels: np.ndarray) -> dict:
    """The space and the labelled vectors."""
    idf = np.log((1 + len(shares)) / (1 + (shares > 0).sum(0))).astype(np.float32) + 0.1
    weighted = unit(shares * idf)
    _, axes = np.linalg.eigh(weighted.T @ weighted)
    axes = np.ascontiguousarray(axes[:, ::-1][:, :DIMENSIONS].astype(np.float32))
    return {"idf": idf, "axes": axes, "vectors": unit(weighted @ axes), "labels": labels.astype(np.float32)}


def vote(model: dict, shares: np.ndarray) -> np.ndarray:
    """Scores in 0..1; a row without any similar neighbour gets the sample's mean label."""
    labels = model["labels"]
    if not len(labels):
        return np.full(len(shares), 0.5)
    cosines = unit(unit(shares * model["idf"]) @ model["axes"]) @ model["vectors"].T
    k = min(NEIGHBOURS, len(labels))
    near = np.argpartition(-cosines, k - 1, axis=1)[:, :k]
    weight = np.maximum(np.take_along_axis(cosines, near, 1), 0).astype(np.float64) ** SHARPNESS
    prior = 1e-6
    return (weight * labels[near]).sum(1).__add__(prior * float(labels.mean())) / (weight.sum(1) + prior)


def _shares_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    terms = Terms()
    for batch in batches:
        rows = [term_shares(t, terms).tobytes() for t, in values_of(batch, "_text")]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.binary())], ["label", "shares"])


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
          sample: int = SAMPLE) -> dict:
    """The model from at most ``sample`` labelled documents, drawn by a hash of
    the id among those whose crc32(id as text) mod 3 is not 1.  An id with
    several labels counts with their mean, rounded; null labels don't count."""
    fold = F.crc32(F.col("_id").cast("string").cast("binary")) % 3
    drawn = (labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("double").alias("_label"))
             .filter(F.col("_id").isNotNull() & F.col("_label").isNotNull()).filter(fold != 1)
             .groupBy("_id").agg(F.round(F.avg("_label")).alias("_label"))
             .orderBy(F.xxhash64(F.col("_id")), "_id").limit(sample))
    shares = (docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
              .join(F.broadcast(drawn), "_id").select("_id", "_label", "_text").dropDuplicates(["_id"])
              .select("_label", "_text").mapInArrow(C.tidy(_shares_of), "label double, shares binary").toPandas())
    matrix = np.stack([np.frombuffer(s, np.float32) for s in shares["shares"]]) if len(shares) else np.zeros((0, WORDS + SHAPES), np.float32)
    order = np.lexsort([*matrix.T[:8], shares["label"].to_numpy()]) if len(shares) else np.array([], int)
    return fit(matrix[order], shares["label"].to_numpy()[order])


def scorer(model: dict) -> Callable:
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = Terms()
        for batch in batches:
            shares = [term_shares(t, terms) for t, in values_of(batch, "_text")]
            scores = vote(model, np.stack(shares)) if shares else np.zeros(0)
            rest = [c for c in batch.schema.names if c != "_text"]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in rest),
                                              pa.array(scores, pa.float64())], [*rest, "_score"])

    return score


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: the id, held_out, score, predicted.

    The score uses nothing but the text.  Null and empty texts, and those without
    words, score the sample's mean label; without any labelled row all score 0.5.
    held_out: crc32(id as text) mod 3 is 1; false for a null id."""
    model = train(docs, labels, id_col, text_col)
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    kind = dict(rows.dtypes)["_id"]
    scored = rows.mapInArrow(scorer(model), f"_id {kind}, _score double")
    held = F.coalesce(F.crc32(F.col("_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    return scored.select(F.col("_id").alias(id_col), held.alias("held_out"), F.col("_score").alias("score"),
                         (F.col("_score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that are not predicted bad, with all their columns."""
    model = train(docs, labels, id_col, text_col)
    rows = docs.select(F.col(text_col).alias("_text"), F.struct("*").alias("_row"))
    scored = rows.mapInArrow(scorer(model), f"_row {rows.schema['_row'].dataType.simpleString()}, _score double")
    return scored.filter("_score >= 0.5").select("_row.*")
