"""A quality classifier by compression.

Two zstandard dictionaries are trained, one from pieces of text labelled good and
one from pieces labelled bad. A text is compressed with each, piece by piece over
its whole length; the difference of the two sizes, over the size of the text, is
its margin. The smaller of the two sizes, over that of the text, is its density:
where a text says next to nothing (one word over and over), both dictionaries do
equally well and the margin alone is blind. A logistic curve in margin and the
logarithm of density, fitted on labelled rows that the dictionaries have not
seen, is the probability.

The labelled sample is bounded: at most ``sample_rows`` rows and
``sample_pieces`` pieces of ``PIECE`` bytes for each label go into the
dictionaries, and ``sample_rows`` rows for each label into the curve, all chosen
by a hash of the id. Everything else covers every row.

Defined results: a null or empty text has margin and log density 0; rows without a label, or with
another label than 0 and 1, teach nothing; with labels of one kind or none, every
score is the smoothed share of label 1; an empty table gives an empty result;
other columns stay as they are; repeated rows are scored alike.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from formulary.llm.storage import lean, written

#: Bytes of text that are compressed at once.
PIECE = 2048
DICTIONARY_BYTES = 112 << 10
LEVEL = 3
SAMPLE_ROWS = 1500
SAMPLE_PIECES = 3000
#: A score of at least this is label 1.
ACCEPT = 0.3


@dataclass(frozen=True)
class Model:
    good: bytes | None
    bad: bytes | None
    #: Of margin, log density and 1.
    weights: tuple[float, float, float]

    def features(self, texts: list[bytes]) -> np.ndarray:
        """Margin and log density of each text; 0 and 0 for an empty one."""
        out = np.zeros((len(texts), 2))
        if self.good is None or self.bad is None:
            return out
        good, bad = (compressor(x).compress for x in (self.good, self.bad))
        for i, text in enumerate(texts):
            if text:
                pieces = [text[k : k + PIECE] for k in range(0, len(text), PIECE)]
                by_good, by_bad = sum(len(good(p)) for p in pieces), sum(len(bad(p)) for p in pieces)
                out[i] = (by_bad - by_good) / len(text), np.log(min(by_good, by_bad) / len(text))
        return out

    def scores(self, texts: list[bytes]) -> np.ndarray:
        margin, density, bias = self.weights
        return 1 / (1 + np.exp(-np.clip(self.features(texts) @ np.array([margin, density]) + bias, -40, 40)))


def compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    held = zstandard.ZstdCompressionDict(dictionary)
    held.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(dict_data=held, write_checksum=False, write_content_size=False, write_dict_id=False)


def trained(samples: list[bytes]) -> bytes | None:
    """A dictionary of the samples; of too few for training, their own text."""
    samples = [x for x in samples if x]
    if not samples:
        return None
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples, k=512, d=8, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-DICTIONARY_BYTES:]


def curve(features: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """Weights of the logistic curve of greatest likelihood, with a slight pull to 0; the bias is last."""
    middle, scale = features.mean(axis=0), np.maximum(features.std(axis=0), 1e-9)
    x = np.column_stack([(features - middle) / scale, np.ones(len(features))])
    beta = np.zeros(x.shape[1])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -40, 40)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(len(beta)), x.T @ (labels - p) - 0.1 * beta)
        beta += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    slopes = beta[:-1] / scale
    return np.append(slopes, beta[-1] - slopes @ middle)


def held_out(doc_id: Column) -> Column:
    """Whether a row is kept from learning."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)) == 0


def utf8(column: pa.Array) -> list[bytes]:
    return pc.fill_null(column.cast(pa.binary()), b"").to_pylist()


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, sample_pieces: int = SAMPLE_PIECES) -> Model:
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).select("doc_id", F.col("quality").cast("int").alias("label"))
    known = known.where(~F.coalesce(held_out(F.col("doc_id")), F.lit(True)))
    parts = []
    for label in (0, 1):  # bounded by the limits
        parts.append(known.where(F.col("label") == label).orderBy(F.xxhash64("doc_id", F.lit(17)), "doc_id").limit(2 * sample_rows))
    chosen = parts[0].unionByName(parts[1]).withColumn("teach", F.pmod(F.xxhash64("doc_id", F.lit(29)), F.lit(2)) == 0)
    # Rows made by the driver would go through Python workers of a second kind, which executors hold beside the others.
    chosen = written(chosen.select(F.col("doc_id").cast("bigint").alias("doc_id"), "label", "teach"), "quality-sample")
    found = {r["label"]: int(r["n"]) for r in chosen.groupBy("label").agg(F.count("*").alias("n")).collect()}
    counts = [found.get(k, 0) for k in (0, 1)]
    share = (counts[1] + 1) / (sum(counts) + 2)
    blank = Model(None, None, (0.0, 0.0, float(np.log(share / (1 - share)))))
    if min(counts) < 2:
        return blank
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("text")).join(F.broadcast(chosen), "doc_id")
    count = F.ceil(F.length("text") / PIECE).cast("int")
    pieces = texts.where("teach").where(F.length("text") > 0).select("label", "doc_id", "text", F.explode(F.sequence(F.lit(0), count - 1)).alias("i"))
    pieces = pieces.select("label", "doc_id", "i", F.expr(f"substring(text, i * {PIECE} + 1, {PIECE})").alias("piece"))
    order = W.partitionBy("label").orderBy(F.xxhash64("doc_id", "i"), "doc_id", "i")
    taken = pieces.withColumn("k", F.row_number().over(order)).where(F.col("k") <= sample_pieces).select("label", "piece").toPandas()
    good, bad = (trained([bytes(x) for x in taken.loc[taken["label"] == k, "piece"]]) for k in (1, 0))
    if good is None or bad is None:
        return blank
    raw = Model(good, bad, (0.0, 0.0, 0.0))

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = raw.features(utf8(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found[:, 0]), pa.array(found[:, 1])], ["label", "margin", "density"])

    seen = texts.where("not teach").select("label", "text").mapInArrow(lean(measured), "label int, margin double, density double").toPandas()
    if seen["label"].nunique() < 2:
        return blank
    weights = curve(seen[["margin", "density"]].to_numpy(), seen["label"].to_numpy().astype(float))
    # Each label weighs in the curve as it does among the labelled rows.
    totals = {int(r["label"]): int(r["n"]) for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    drawn = seen["label"].value_counts()
    weights[-1] += np.log(totals[1] / totals[0]) - np.log(drawn[1] / drawn[0])
    return Model(good, bad, tuple(map(float, weights)))


def fresh(name: str, columns: list[str]) -> str:
    while name.lower() in {c.lower() for c in columns}:
        name += "_"
    return name


def scored(docs: DataFrame, model: Model, output: str = "score") -> DataFrame:
    """``docs`` with one more column, the probability of label 1; nothing but the text goes into it."""
    output = fresh(output, docs.columns)
    held = docs.sparkSession.sparkContext.broadcast(model)  # two dictionaries of at most DICTIONARY_BYTES
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = pa.array(held.value.scores(utf8(batch.column(at))), pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, score], [*batch.schema.names, output])

    return docs.mapInArrow(lean(run), T.StructType([*docs.schema.fields, T.StructField(output, T.DoubleType())]))


def accepted(docs: DataFrame, model: Model, accept: float = ACCEPT) -> DataFrame:
    """The rows of ``docs`` whose score is at least ``accept``."""
    name = fresh("_quality", docs.columns)
    return scored(docs, model, name).where(F.col(name) >= accept).select(docs.columns)
