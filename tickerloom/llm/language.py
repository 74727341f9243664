"""Language identification: multinomial naive Bayes over hashed character n-grams.

Texts are lower-cased; every run of characters that are not letters is one
separator.  N-grams of one to three characters that hold a letter are hashed to a
fixed number of buckets.  Training counts buckets per language with Spark over a
bounded sample of labelled rows; the log-probability matrix (buckets x languages,
at most ``MOST_LANGUAGES`` columns) is broadcast and a batch is scored in numpy:
bucket rows are gathered for all n-grams and summed per text.

Defined cases: a text that is null or has no letter is ``und`` with score 0; so is
every text if nothing could be learned; equal posteriors go to the language that
sorts first; repeated rows and ids give equal rows; a very long text is one row, held
with some forty bytes a character; an empty table gives an empty result.  A kept
column with the name of a result is replaced by it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from tickerloom.llm.common import slices, texts_of

BUCKETS = 1 << 16
#: At most so many labelled rows of each language are learned from; every row up to that number is.
ROWS_PER_LANGUAGE = 4000
MOST_LANGUAGES = 512
SMOOTHING = 0.5
UNDECIDED = "und"
#: Bytes of text whose n-grams are held at once: an n-gram takes some forty bytes.
SLICE = 1 << 19
_MIX = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], np.uint32)
_LETTERS: list[np.ndarray] = []


def letters() -> np.ndarray:
    """For every code point whether it is a letter."""
    if not _LETTERS:
        _LETTERS.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _LETTERS[0]


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all n-grams, the text of each, and the number of letters of each text."""
    lowered = [t.lower() for t in texts]
    sizes = np.fromiter(map(len, lowered), np.int64, len(lowered)) + 2
    # lone surrogates cannot be encoded strictly; they are no letters anyway
    codes = np.frombuffer("".join(f" {t} " for t in lowered).encode("utf-32-le", "surrogatepass"), np.uint32)
    owner = np.repeat(np.arange(len(texts), dtype=np.int32), sizes)
    letter = letters()[codes]
    counts = np.bincount(owner[letter], minlength=len(texts))
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # a separator after a letter
    keep[:-1] |= letter[1:]  # and one before a letter
    codes, owner, letter = np.where(letter, codes, 32)[keep].astype(np.uint32), owner[keep], letter[keep]
    one = codes * _MIX[0]
    found = [(one, letter, owner)]
    two = (one[:-1] ^ codes[1:]) * _MIX[1]
    same = owner[1:] == owner[:-1]
    found.append((two, same & (letter[1:] | letter[:-1]), owner[:-1]))
    three = (two[:-1] ^ codes[2:]) * _MIX[2]
    found.append((three, same[:-1] & same[1:] & (letter[1:-1] | letter[2:] & letter[:-2]), owner[:-2]))
    return np.concatenate([h[k] >> 16 for h, k, _ in found]), np.concatenate([o[k] for _, k, o in found]), counts


@dataclass
class Model:
    languages: list[str]
    matrix: np.ndarray  # buckets x languages, log probability
    prior: np.ndarray

    def score(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """Language and posterior of every text."""
        if not self.languages:
            return [UNDECIDED] * len(texts), np.zeros(len(texts))
        bucket, owner, counts = grams(texts)
        total = np.stack([np.bincount(owner, self.matrix[:, k][bucket], len(texts)) for k in range(len(self.languages))], axis=1)
        total += self.prior
        posterior = np.exp(total - total.max(axis=1, keepdims=True))
        posterior /= posterior.sum(axis=1, keepdims=True)
        best = posterior.argmax(axis=1)
        known = counts > 0
        return [self.languages[b] if k else UNDECIDED for b, k in zip(best, known)], np.where(known, posterior.max(axis=1), 0.0)


def fit(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", rows_per_language: int = ROWS_PER_LANGUAGE) -> Model:
    """Learn from rows with a language.  Of a language with more rows than the bound, the share that
    reaches the bound is taken by a hash of the text, so equal tables give equal models."""
    rows = labelled.select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")).filter("lang IS NOT NULL")
    sizes = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MOST_LANGUAGES).collect()
    languages = sorted(r["lang"] for r in sizes)
    if not languages:
        return Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros(0))
    place = {x: k for k, x in enumerate(languages)}
    share = {r["lang"]: min(1.0, rows_per_language / r["count"]) for r in sizes}
    limits = labelled.sparkSession.createDataFrame([(x, place[x], share[x]) for x in languages], "lang string, k int, share double")
    sample = rows.join(F.broadcast(limits), "lang").filter(F.pmod(F.xxhash64("text", F.lit(7)), F.lit(1 << 20)) < F.col("share") * (1 << 20))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(len(languages) * BUCKETS, np.int64)
        for part in slices(batches, limit=SLICE):
            bucket, owner, _ = grams(texts_of(part))
            own = part.column(1).to_numpy()[owner].astype(np.int64)
            table += np.bincount(own * BUCKETS + bucket, minlength=len(table))
        at = np.flatnonzero(table)
        yield pa.RecordBatch.from_arrays([pa.array(at // BUCKETS, pa.int32()), pa.array(at % BUCKETS, pa.int32()), pa.array(table[at])], ["k", "bucket", "n"])

    counted = sample.select("text", "k").mapInArrow(count, "k int, bucket int, n bigint").groupBy("k", "bucket").agg(F.sum("n").alias("n")).toArrow()
    table = np.zeros((BUCKETS, len(languages)))
    table[counted["bucket"].to_numpy(), counted["k"].to_numpy()] = counted["n"].to_numpy()
    table += SMOOTHING
    prior = np.array([r["count"] for r in sorted(sizes, key=lambda r: r["lang"])], float)
    return Model(languages, np.log(table / table.sum(axis=0)).astype(np.float32), np.log(prior / prior.sum()))


def predict(docs: DataFrame, model: Model, text_col: str = "text", into: tuple[str, str] = ("lang_pred", "score"), keep: list[str] | None = None) -> DataFrame:
    """The columns ``keep`` of ``docs`` (all by default) and two more: predicted language and its posterior.

    A column of ``docs`` with one of the two names is replaced.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    docs = docs.drop(*into)
    kept = [f for f in docs.schema.fields if keep is None or f.name in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, text_col, SLICE):
            languages, scores = shared.value.score(texts_of(part, text_col))
            yield pa.RecordBatch.from_arrays([*(part.column(f.name) for f in kept), pa.array(languages, pa.string()), pa.array(scores, pa.float64())], [*(f.name for f in kept), *into])

    return docs.mapInArrow(run, StructType([*kept, StructField(into[0], StringType()), StructField(into[1], DoubleType())]))
