"""Forward pass of the sentence model: one encoder block over tokens, then a two-layer head. Plain arrays, in batched tasks.

Weights are a mapping from names to arrays, read from an .npz archive (arrays only, no objects); the names are those of
the parameters of such a model's state, so a converted checkpoint fits as it is.
"""

from __future__ import annotations

import io
from collections.abc import Mapping

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqlake.operators.models import infer

# Names of the parameters, and the small number under the roots of both kinds of norm.
WORDS, PLACES = "encoder.word_embedding.weight", "encoder.position_embedding.weight"
BLOCK, EPSILON = "encoder.layers.", 1e-5
#: Largest archive that is read and sent to the workers.
ARCHIVE_BYTES = 1 << 30
#: Attention weights that a worker holds at once.
CELLS = 1 << 23


def _norm(x: np.ndarray, scale: np.ndarray, shift: np.ndarray) -> np.ndarray:
    centred = x - x.mean(-1, keepdims=True)
    return centred / np.sqrt((centred * centred).mean(-1, keepdims=True) + EPSILON) * scale + shift


class SentenceModel:
    """Embeddings of words and places; attention of `heads` heads that share their projections, masked at the pad; feed-forward;
    the flattened block through a normalised hidden layer to one number. Sentences have as many places as the model has."""

    def __init__(self, weights: Mapping[str, np.ndarray], heads: int = 8, pad: int = 0):
        self.w, self.heads, self.pad = weights, heads, pad
        self.length, self.size = weights[PLACES].shape
        if self.size % heads:
            raise ValueError(f"{self.size} dimensions can't be split into {heads} heads")

    def _linear(self, x: np.ndarray, name: str) -> np.ndarray:
        y = x @ self.w[name + ".weight"].T
        return y + self.w[name + ".bias"] if name + ".bias" in self.w else y

    def encode(self, tokens: np.ndarray) -> np.ndarray:
        """(sentences, places, dimensions)."""
        x = self.w[WORDS][tokens] + self.w[PLACES]
        parts = x.reshape(*x.shape[:2], self.heads, -1)
        value, key, query = (self._linear(parts, f"{BLOCK}attention.{n}").transpose(0, 2, 1, 3) for n in ("values", "keys", "queries"))
        energy = query @ key.transpose(0, 1, 3, 2)
        energy[np.broadcast_to((tokens == self.pad)[:, None, None, :], energy.shape)] = -1e20
        energy /= np.sqrt(self.size)
        energy -= energy.max(-1, keepdims=True)
        np.exp(energy, out=energy)
        energy /= energy.sum(-1, keepdims=True)
        seen = (energy @ value).transpose(0, 2, 1, 3).reshape(x.shape)
        x = _norm(self._linear(seen, f"{BLOCK}attention.fc_out") + x, self.w[f"{BLOCK}norm1.weight"], self.w[f"{BLOCK}norm1.bias"])
        wide = np.maximum(self._linear(x, f"{BLOCK}feed_forward.0"), 0)
        return _norm(self._linear(wide, f"{BLOCK}feed_forward.2") + x, self.w[f"{BLOCK}norm2.weight"], self.w[f"{BLOCK}norm2.bias"])

    def __call__(self, tokens: np.ndarray) -> np.ndarray:
        """One number (before the sigmoid) for each row of `length` tokens."""
        tokens = np.asarray(tokens).astype(np.int64)
        step, out = max(1, CELLS // (self.heads * self.length**2)), []
        for at in range(0, len(tokens), step):
            x = self.encode(tokens[at : at + step])
            x = self._linear(x.reshape(len(x), -1), "fc1")
            x = (x - self.w["bn.running_mean"]) / np.sqrt(self.w["bn.running_var"] + EPSILON) * self.w["bn.weight"] + self.w["bn.bias"]
            out.append(self._linear(x, "out")[:, 0])
        return np.concatenate(out) if out else np.zeros(0)


def read_weights(spark: SparkSession, path: str) -> dict[str, np.ndarray]:
    """The arrays of an .npz archive, read by Spark, so that it may stand wherever Spark can read; pickled objects are refused."""
    file = spark.read.format("binaryFile").load(path).select("length", "content")
    size = file.agg(F.sum("length")).first()[0] or 0
    if not 0 < size <= ARCHIVE_BYTES:
        raise ValueError(f"{path} has {size} bytes; 1 to {ARCHIVE_BYTES} can be read")
    with np.load(io.BytesIO(file.first()["content"]), allow_pickle=False) as arrays:
        return {k: arrays[k] for k in arrays.files}


def score_sentences(sentences: DataFrame, weights: Mapping[str, np.ndarray], tokens: str = "tokens", heads: int = 8, pad: int = 0, batch_size: int = 500) -> DataFrame:
    """Add score, the model's sigmoid for the token array of each row. Weights go to each worker once, by broadcast.

    Token arrays have the model's length (see models.sentences); a null array gives a null score. A column named score is
    replaced.
    """
    length = weights[PLACES].shape[0]
    shared = sentences.sparkSession.sparkContext.broadcast(dict(weights))

    def make_predict():
        return SentenceModel(shared.value, heads, pad)

    known = F.coalesce(F.col(tokens), F.array_repeat(F.lit(pad), length))
    scored = infer(sentences.drop("score").withColumn("_tokens", known), "_tokens", make_predict, batch_size, length).drop("_tokens")
    return scored.withColumn("score", F.when(F.col(tokens).isNotNull(), F.col("score")))
