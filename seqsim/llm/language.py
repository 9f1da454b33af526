"""Language identification: multinomial naive Bayes over hashed character n-grams.

Counts of n-grams by language are summed in tasks and then over the cluster; the matrix of log-probabilities, whose size
is bounded by buckets and languages, is broadcast, and tasks score batches of whole texts in numpy.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqsim.llm.common import pieces, texts

#: Hash buckets of n-grams, longest n-gram, added count, most languages that a model may hold.
BUCKETS, LONGEST, PRIOR, LANGUAGES = 1 << 14, 3, 0.5, 512
FACTORS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], np.uint32)


@lru_cache(1)
def letters() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def grams(batch: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all n-grams, the text that each is of, and whether each text has a letter.

    Texts are lower-cased, anything but letters is a blank, a blank stands at both ends, and blanks alone are no n-gram.
    """
    lowered = [x.decode().lower() for x in batch]
    points = np.frombuffer((" " + "  ".join(lowered) + " ").encode("utf-32-le"), np.uint32)
    size = np.fromiter(map(len, lowered), np.int64, len(lowered)) + 2
    owner = np.repeat(np.arange(len(lowered)), size)
    letter = letters()[points]
    some = np.bincount(owner[letter], minlength=len(lowered)) > 0
    value = np.where(letter, points, 32).astype(np.uint32)
    buckets, owners = [], []
    h, real = np.zeros(len(value), np.uint32), np.zeros(len(value), bool)
    for n in range(1, LONGEST + 1):
        m = len(value) - n + 1
        h = (h[:m] ^ (value[n - 1 :] * FACTORS[n - 1])) * np.uint32(0x27D4EB2F)
        real = real[:m] | letter[n - 1 :]
        use = real & (owner[:m] == owner[n - 1 :])
        mixed = h[use] + np.uint32(n)
        buckets.append(((mixed ^ (mixed >> np.uint32(15))) * np.uint32(0x2C1B3C6D)) >> np.uint32(33 - BUCKETS.bit_length()))
        owners.append(owner[:m][use])
    return np.concatenate(buckets).astype(np.int64), np.concatenate(owners), some


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> tuple[list[str], np.ndarray]:
    """Languages in order, and the matrix (BUCKETS + 1, languages) of log-probabilities; its last row has the priors.

    Every row with a language is learned from, whole. A null text counts for its language's prior only. No such rows
    give no languages. More than LANGUAGES languages are an error.
    """
    rows = docs.where(F.col(lang_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
    names = sorted(r["lang"] for r in rows.select("lang").distinct().limit(LANGUAGES + 1).collect())
    if len(names) > LANGUAGES:
        raise ValueError(f"over {LANGUAGES} languages")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = {x: i for i, x in enumerate(names)}
        count = np.zeros(len(names) * (BUCKETS + 1), np.int64)
        for batch in pieces(batches, "text"):
            own = np.array([at[x] for x in batch.column("lang").to_pylist()], np.int64) * (BUCKETS + 1)
            buckets, owner, _ = grams(texts(batch, "text"))
            count += np.bincount(own[owner] + buckets, minlength=len(count))
            count += np.bincount(own + BUCKETS, minlength=len(count))
        some = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(count[some])], ["cell", "n"])

    total = np.zeros(len(names) * (BUCKETS + 1))
    for part in [rows.mapInArrow(run, "cell int, n bigint").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()]:
        total[part["cell"].to_numpy()] = part["n"].to_numpy()
    counts = total.reshape(len(names), BUCKETS + 1).T
    own = counts[:BUCKETS] + PRIOR
    matrix = np.log(np.vstack([own / own.sum(axis=0, keepdims=True), counts[BUCKETS:] / max(1, counts[BUCKETS:].sum())]) + 1e-300)
    return names, matrix.astype(np.float32)


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, lang_pred, score) for each row: the likeliest language and its probability given the text.

    A text that is null or has no letter, or any text if the model has no language, gets `und` and score 0. Ties go
    to the first language in order. Repeated rows get equal results; other columns are left out.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, matrix = held.value
        for batch in pieces(batches, "text"):
            buckets, owner, some = grams(texts(batch, "text"))
            if names:
                total = np.stack([np.bincount(owner, matrix[buckets, k], len(some)) for k in range(len(names))], axis=1) + matrix[BUCKETS]
                best = total.argmax(axis=1)
                share = 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
            else:
                some[:] = False
            lang = [names[best[i]] if some[i] else "und" for i in range(len(some))]
            score = np.where(some, share if names else 0.0, 0.0)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(lang, pa.string()), pa.array(score, pa.float64())], ["id", "lang_pred", "score"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, lang_pred string, score double").withColumnRenamed("id", id_col)


def held_out(id_col: str = "doc_id") -> Column:
    """Rows that aren't learned from: crc32 of the id as text leaves 2 when divided by 4. A null id is not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))
