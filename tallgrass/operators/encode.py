"""Vectors of wordings by an encoder of the caller's, and the codes that say what they were made from."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallgrass.functions.similarity import cosine
from tallgrass.functions.text import normalise
from tallgrass.operators.matching import content_code
from tallgrass.sources.datasets import load_vectors

Encoder = Callable[[Sequence[str]], np.ndarray]

#: Goes into the identity code; to be raised when :func:`tallgrass.functions.text.normalise` changes.
NORMALISATION = "1"


def hashing_encoder(width: int = 64) -> Encoder:
    """An encoder without a model: counts of hashed words and pairs of letters."""

    def encode(texts: Sequence[str]) -> np.ndarray:
        out = np.zeros((len(texts), width), dtype=np.float32)
        for i, t in enumerate(texts):
            for part in [*t.split(), *(t[k : k + 2] for k in range(len(t) - 1))]:
                h = zlib.crc32(part.encode())
                out[i, h % width] += 1.0 if h & 1 << 31 else -1.0
        return out

    return encode


def unit_length(vector: Column) -> Column:
    """A stored vector divided by its length; a zero vector stays as it is."""
    size = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.transform(vector, lambda x: (x.cast("double") / F.when(size == 0, 1.0).otherwise(size)).cast("float"))


def encode_texts(texts: DataFrame, key: str, text: str, encoder: Encoder, batch: int = 256) -> DataFrame:
    """(key, vector): vectors of unit length of the normalised, non-empty wordings.

    The encoder gets lists of up to ``batch`` texts in the tasks and returns a matrix with a row per text;
    another shape, or rows that differ in length between batches, raise an error.
    """

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def run(column: pd.Series) -> pd.Series:
        rows: list = []
        for start in range(0, len(column), batch):
            part = column.iloc[start : start + batch].tolist()
            made = np.asarray(encoder(part), dtype=np.float32)
            if made.ndim != 2 or len(made) != len(part) or rows and made.shape[1] != len(rows[0]):
                raise ValueError(f"the encoder returned {made.shape} for {len(part)} texts")
            size = np.linalg.norm(made, axis=1, keepdims=True)
            rows += list(made / np.where(size == 0, 1.0, size))
        return pd.Series(rows, dtype=object)

    named = texts.select(F.col(key).cast("string").alias("key"), normalise(F.col(text)).alias("norm")).where("norm <> '' and key is not null")
    return named.select("key", run("norm").alias("vector"))


def identity_code(model: str, width: int, normalisation: str = NORMALISATION) -> str:
    """What vectors depend on besides the texts: the encoder's name, their width, how texts are normalised."""
    return hashlib.sha256("\n".join([model, str(width), normalisation]).encode()).hexdigest()[:16]


def verified_vectors(artefacts: Sequence[tuple[str, DataFrame]], identity: str, key: str = "key", text: str = "norm") -> tuple[list[DataFrame], str]:
    """(vectors of each compared field, reason): the stored vectors, if all of them were made from these texts.

    ``artefacts`` holds (folder, texts) per compared field. If one is missing or out of date, none is
    returned and the reason says which: the run then compares letters only.
    """
    got = []
    for folder, texts in artefacts:
        code = content_code(texts, key, text).first()["code"]
        try:
            vectors = load_vectors(texts.sparkSession, folder, identity, code)
        except Exception as e:  # no such folder
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return [], f"no vectors at {folder}"
        if vectors is None:
            return [], f"the vectors at {folder} are out of date"
        got.append(vectors)
    return got, ""


def benchmark(texts: DataFrame, key: str, text: str, twins: DataFrame, decoys: DataFrame, encoders: Mapping[str, Encoder]) -> DataFrame:
    """(encoder, kind, n_pairs, mean_cosine, least_cosine, most_cosine): how encoders tell near copies (twin, source) from decoys (left_id, right_id)."""
    pairs = twins.select(F.lit("twin").alias("kind"), F.col("twin").alias("l"), F.col("source").alias("r")).unionByName(decoys.select(F.lit("decoy").alias("kind"), F.col("left_id").alias("l"), F.col("right_id").alias("r")))
    out = None
    for name, encoder in encoders.items():
        v = encode_texts(texts, key, text, encoder)
        both = pairs.join(v.select(F.col("key").alias("l"), F.col("vector").alias("p")), "l").join(v.select(F.col("key").alias("r"), F.col("vector").alias("q")), "r").withColumn("c", cosine(F.col("p"), F.col("q")))
        part = both.groupBy("kind").agg(F.count(F.lit(1)).alias("n_pairs"), F.avg("c").alias("mean_cosine"), F.min("c").alias("least_cosine"), F.max("c").alias("most_cosine")).select(F.lit(name).alias("encoder"), "*")
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise ValueError("no encoder to compare")
    return out
