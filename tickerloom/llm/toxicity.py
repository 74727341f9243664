"""Toxicity: a convolutional text classifier trained in numpy.

A word's embedding is the sum of two rows of a hashed table, so two words collide in
full only if both hashes do; filters of several widths slide over the words of
the whole text and the largest response of each filter feeds a logistic output.
A filter's response is a sum of one table row per word and offset, so scoring is
table gathers and one maximum per text, whatever its length.

Training runs on every labelled row.  The rows are dealt by a hash of the id into
groups of about ``GROUP_ROWS``, stored in the order of that hash; in an epoch each
group trains a copy of the network in a task of its own, and the copies are averaged.
Embeddings start from the log-odds of a bucket.  A fifth of the rows is held back to
calibrate: per language the threshold with the best F1 is found (probabilities are
counted in steps of 1 / ``STEPS`` of their logit) and the probability is shifted so
that this threshold becomes ``TARGET``.  At scoring time the language is guessed from
the same hashed words; language labels are used for learning that guess only.  The
driver holds counts per bucket and language and one network, whatever the rows.

Defined cases: a null text is empty; an empty text is scored like any other; with
no labelled row every score is 0; labels of a repeated id are merged to the
largest; a null label is no label; repeated rows are scored separately; a very long
text is one row, held with some hundred bytes a word; an empty table gives an empty
result.  The names of what is added may not be those of kept columns.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StringType, StructField, StructType

from tickerloom.llm.common import bounded_broadcast, parquet_files, release, shared_path, slices, texts_of

BUCKETS = 1 << 15
DIMENSION = 16
FILTERS = 8
WIDTHS = (1, 2, 3)
GROUP_ROWS = 10_000
EPOCHS = 2
#: Texts and words of a training step, at most (one text at least).
BATCH, BATCH_WORDS = 64, 1 << 18
#: Every HELD-th row by hash calibrates.
HELD = 5
STEPS = 512
#: Up to so many labels are broadcast to the documents.
BROADCAST_LABELS = 1_000_000
#: Pieces in which networks are averaged.
PIECES = 64
RATE = 0.05
TARGET = 0.3
SHRINK = 20.0
LEAST_TEXTS = 8
LEAST_POSITIVES = 25
MOST_LANGUAGES = 64
_PAD = max(WIDTHS)
_LEARNED = ("out", "bias", "kernel")
_WORD = re.compile(r"\w+")


class _Buckets(dict):
    """word -> its two buckets in one number (first * BUCKETS + second, each 1 .. BUCKETS - 1), emptied when large."""

    def __missing__(self, word: str) -> int:
        if len(self) > 200_000:
            self.clear()
        low, high = xxhash.xxh3_64_intdigest(word) & 0xFFFFFFFF, xxhash.xxh3_64_intdigest(word) >> 32
        self[word] = both = (1 + low % (BUCKETS - 1)) * BUCKETS + 1 + high % (BUCKETS - 1)
        return both


_KNOWN = _Buckets()


def tokens(texts: list[str]) -> list[np.ndarray]:
    """Words of every text, each as the number of its two buckets."""
    split = [_WORD.findall(t.lower()) for t in texts]
    flat = np.fromiter((b for s in split for b in map(_KNOWN.__getitem__, s)), np.int32, sum(map(len, split)))
    ends = np.cumsum([len(s) for s in split], dtype=np.int64)
    return [flat[e - len(s) : e] for s, e in zip(split, ends)]


def _summed(table: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Rows of the words: the sum of the rows of their two buckets."""
    out = table[codes // BUCKETS]
    out += table[codes % BUCKETS]
    return out


def _buckets(codes: np.ndarray) -> np.ndarray:
    return np.concatenate([codes // BUCKETS, codes % BUCKETS])


def _laid_out(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts with padding after each; first window of every text and the place after its last."""
    sizes = np.array([len(t) for t in texts])
    flat = np.zeros(int(sizes.sum()) + _PAD * len(texts), np.int32)
    starts = np.cumsum(sizes + _PAD) - sizes - _PAD
    for s, t in zip(starts, texts):
        flat[s : s + len(t)] = t
    return flat, starts, starts + np.maximum(sizes, 1)


def _responses(rows: np.ndarray) -> np.ndarray:
    """Filter responses at every place from one row of offset responses per word."""
    n, out, at = len(rows), [], 0
    for w in WIDTHS:
        total = rows[:, at : at + FILTERS].copy()
        for o in range(1, w):
            total[: n - o] += rows[o:, at + o * FILTERS : at + (o + 1) * FILTERS]
        at += w * FILTERS
        out.append(total)
    return np.concatenate(out, axis=1)


def _logit(p):
    p = np.clip(p, 1e-9, 1 - 1e-9)
    return np.log(p / (1 - p))


@dataclass
class Network:
    embedding: np.ndarray
    kernel: np.ndarray  # dimension x (offset blocks of FILTERS), all widths side by side
    bias: np.ndarray
    out: np.ndarray
    constant: float
    common: np.ndarray
    seen: list = field(default_factory=list)

    @classmethod
    def start(cls, odds: np.ndarray, common: np.ndarray, rng: np.random.Generator) -> Network:
        """Buckets that are not common stay at zero: a rare word says nothing, whatever text it is in."""
        embedding = rng.normal(0, 0.1, (BUCKETS, DIMENSION)).astype(np.float32)
        embedding[:, 0] = odds
        embedding[~common] = 0
        embedding[0] = 0
        kernel = rng.normal(0, 0.1, (DIMENSION, FILTERS * sum(WIDTHS))).astype(np.float32)
        kernel[0] += 0.3
        n = FILTERS * len(WIDTHS)
        return cls(embedding, kernel, np.full(n, -0.1, np.float32), rng.normal(0.2, 0.05, n).astype(np.float32), -2.0, common)

    def hidden(self, texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Largest responses, where they are, and the laid out words."""
        flat, starts, ends = _laid_out(texts)
        z = _responses(_summed(self.embedding, flat) @ self.kernel)
        place = np.stack([s + z[s:e].argmax(axis=0) for s, e in zip(starts, ends)])
        return z[place, np.arange(z.shape[1])] + self.bias, place, flat

    def step(self, texts: list[np.ndarray], labels: np.ndarray, rate: float) -> None:
        top, place, flat = self.hidden(texts)
        active = np.maximum(top, 0)
        p = 1 / (1 + np.exp(-np.clip(active @ self.out + self.constant, -30, 30)))
        error = ((p - labels) / len(labels)).astype(np.float32)
        back = error[:, None] * self.out * (top > 0)
        grads = {"out": active.T @ error, "bias": back.sum(axis=0), "kernel": np.zeros_like(self.kernel)}
        touched, moves, at = [], [], 0
        for k, w in enumerate(WIDTHS):
            own = slice(k * FILTERS, (k + 1) * FILTERS)
            for o in range(w):
                block = slice(at, at + FILTERS)
                word = flat[place[:, own] + o]
                grads["kernel"][:, block] = np.einsum("df,dfk->kf", back[:, own], _summed(self.embedding, word))
                touched.append(_buckets(word.ravel()))
                move = (back[:, own, None] * self.kernel[:, block].T[None]).reshape(-1, DIMENSION)
                moves += [move, move]
                at += FILTERS
        rows, inverse = np.unique(np.concatenate(touched), return_inverse=True)
        move = np.zeros((len(rows), DIMENSION), np.float32)
        np.add.at(move, inverse, np.concatenate(moves))
        self._adapt(rows, move, grads, rate)
        self.constant -= rate * float(error.sum())

    def packed(self) -> np.ndarray:
        """All numbers that training changes, one after the other."""
        self._begin()
        parts = [self.embedding, self.kernel, self.bias, self.out, np.array([self.constant]), self.seen[0], *(self.seen[1][k] for k in _LEARNED)]
        return np.concatenate([np.asarray(x, np.float32).ravel() for x in parts])

    def unpacked(self, flat: np.ndarray) -> Network:
        """A network of this shape with the numbers of ``packed``."""
        shapes = [self.embedding.shape, self.kernel.shape, self.bias.shape, self.out.shape, (1,)]
        shapes += [self.embedding.shape, *(getattr(self, k).shape for k in _LEARNED)]
        cut = np.split(flat.astype(np.float32), np.cumsum([np.prod(x, dtype=int) for x in shapes])[:-1])
        e, k, b, o, c, seen, *more = (x.reshape(shape) for x, shape in zip(cut, shapes))
        return Network(e, k, b, o, float(c[0]), self.common, [seen, dict(zip(_LEARNED, more))])

    def _begin(self) -> None:
        if not self.seen:
            self.seen = [np.zeros_like(self.embedding), {k: np.zeros_like(getattr(self, k)) for k in _LEARNED}]

    def _adapt(self, rows: np.ndarray, move: np.ndarray, grads: dict, rate: float) -> None:
        """Steps scaled by the root of the summed squares so far."""
        self._begin()
        self.seen[0][rows] += move**2
        self.embedding[rows] -= self.common[rows, None] * rate * move / (np.sqrt(self.seen[0][rows]) + 1e-6)
        self.embedding[0] = 0
        for k, g in grads.items():
            self.seen[1][k] += g**2
            getattr(self, k)[...] -= rate * g / (np.sqrt(self.seen[1][k]) + 1e-6)


@dataclass
class Model:
    table: np.ndarray  # bucket x offset responses
    bias: np.ndarray
    out: np.ndarray
    constant: float
    languages: list[str]
    language_table: np.ndarray  # bucket x languages, log probability
    thresholds: np.ndarray  # of each language, then that of an unknown one
    empty: bool = False

    def raw(self, texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Probability and guessed language (number of languages: none) of every text."""
        flat, starts, ends = _laid_out(texts)
        z = _responses(_summed(self.table, flat))
        top = np.maximum.reduceat(z, np.stack([starts, ends], axis=1).ravel(), axis=0)[::2] + self.bias
        p = 1 / (1 + np.exp(-np.clip(np.maximum(top, 0) @ self.out + self.constant, -30, 30).astype(np.float64)))
        guess = np.full(len(texts), len(self.languages))
        if self.languages:
            fit = np.add.reduceat(_summed(self.language_table, flat), starts, axis=0)
            known = np.array([len(t) > 0 for t in texts])
            guess[known] = fit.argmax(axis=1)[known]
        return p, guess

    def score(self, texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Calibrated score, probability and guessed language."""
        if self.empty or not texts:
            return np.zeros(len(texts)), np.zeros(len(texts)), np.full(len(texts), len(self.languages))
        p, guess = self.raw(texts)
        shifted = _logit(p) - _logit(self.thresholds[guess]) + _logit(TARGET)
        return 1 / (1 + np.exp(-shifted)), p, guess


def _best_threshold(p: np.ndarray, hits: np.ndarray, n: np.ndarray) -> float:
    """Middle of the gap below the probability at which F1 is best; distinct probabilities with positive and all rows of each."""
    order = np.argsort(-p)
    hits, n, p = np.cumsum(hits[order]), np.cumsum(n[order]), p[order]
    k = int((2 * hits / (n + hits[-1])).argmax())
    low = p[k + 1] if k + 1 < len(p) else 0.0
    return float(np.clip((p[k] + low) / 2, 1e-4, 1 - 1e-4))


def _stepped(p: np.ndarray) -> np.ndarray:
    """Numbers of the steps in which probabilities are counted."""
    return np.round(_logit(p) * STEPS).astype(np.int64)


def _calibrate(model: Model, guess: np.ndarray, step: np.ndarray, hits: np.ndarray, n: np.ndarray) -> Model:
    """Set the thresholds from positive and all held rows per guessed language and step."""

    def best(own: np.ndarray) -> float:
        steps, place = np.unique(step[own], return_inverse=True)
        return _best_threshold(1 / (1 + np.exp(-steps / STEPS)), np.bincount(place, hits[own]), np.bincount(place, n[own]))

    if 0 < hits.sum() < n.sum():
        model.thresholds[:] = best(np.ones(len(n), bool))
    for k in range(len(model.languages)):
        own = guess == k
        if LEAST_POSITIVES <= hits[own].sum() < n[own].sum():
            model.thresholds[k] = best(own)
    return model


def _begun(counts: np.ndarray, positives: int, rows: int, seed: int) -> Network:
    """A network before training, from the negative and positive texts that hold each bucket."""
    rate = positives / rows if rows else 0.5
    # the share of positive texts among those with the bucket, drawn to the overall rate where there are few
    odds = _logit((counts[1] + SHRINK * rate) / (counts.sum(axis=0) + SHRINK)) - _logit(rate)
    return Network.start((np.clip(odds / 2, -1, 2) / 2).astype(np.float32), counts.sum(axis=0) >= LEAST_TEXTS, np.random.default_rng(seed))


def _finished(network: Network, named: list[str], words: np.ndarray) -> Model:
    """The model before calibration; ``words`` counts (bucket, language)."""
    words = words + 0.1
    words = np.log(words / words.sum(axis=0)).astype(np.float32)
    words[0] = 0
    return Model(network.embedding @ network.kernel, network.bias, network.out, network.constant, named, words, np.full(len(named) + 1, TARGET))


def _batched(texts: list[np.ndarray], labels: np.ndarray) -> Iterator[tuple[list[np.ndarray], np.ndarray]]:
    """Texts of one training step after the other."""
    start, held = 0, 0
    for i, t in enumerate(texts):
        if i > start and (i - start == BATCH or held + len(t) > BATCH_WORDS):
            yield texts[start:i], labels[start:i]
            start, held = i, 0
        held += len(t)
    if start < len(texts):
        yield texts[start:], labels[start:]


@dataclass
class Rows:
    """Some labelled rows: words as buckets, labels, places of the languages (-1: none), and which are held back."""

    texts: list[np.ndarray]
    labels: np.ndarray
    languages: np.ndarray
    held: np.ndarray

    def tally(self, counts: np.ndarray, words: np.ndarray) -> None:
        """Add to negative and positive texts per bucket, and to the words per bucket and language."""
        for text, label, language, held in zip(self.texts, self.labels, self.languages, self.held):
            both = _buckets(text)
            if not held:
                counts[int(label), np.unique(both)] += 1
            if language >= 0:
                np.add.at(words[:, language], both, 1)

    def fitted(self) -> tuple[list[np.ndarray], np.ndarray]:
        return [self.texts[i] for i in np.flatnonzero(~self.held)], self.labels[~self.held]

    def judged(self, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Guessed language, step and label of the held rows."""
        of, labels = [self.texts[i] for i in np.flatnonzero(self.held)], self.labels[self.held]
        found = [model.raw(part) for part, _ in _batched(of, labels)] or [(np.zeros(0), np.zeros(0, int))]
        p, guess = (np.concatenate(x) for x in zip(*found))
        return guess, _stepped(p), labels


def train(texts: list[np.ndarray], labels: np.ndarray, languages: list[str | None], held: np.ndarray, epochs: int = EPOCHS, seed: int = 5) -> Model:
    """Fit on the rows not held, calibrate on the held ones: one group, in memory."""
    named = sorted({x for x in languages if x is not None})[:MOST_LANGUAGES]
    rows = Rows(texts, labels, np.array([named.index(x) if x in named else -1 for x in languages], int), held)
    counts, words = np.zeros((2, BUCKETS)), np.zeros((BUCKETS, len(named)))
    rows.tally(counts, words)
    own, y = rows.fitted()
    network, rng = _begun(counts, int(y.sum()), len(y), seed), np.random.default_rng(seed)
    for epoch in range(epochs):
        order = rng.permutation(len(own))
        for part, label in _batched([own[i] for i in order], y[order]):
            network.step(part, label, RATE / (1 + epoch / 2))
    model = _finished(network, named, words)
    guess, step, y = rows.judged(model)
    return _calibrate(model, guess, step, y, np.ones(len(y)))


def labelled(docs: DataFrame, labels: DataFrame, group_rows: int = GROUP_ROWS) -> tuple[str, int]:
    """Folder of all labelled rows (words, toxic, lang, held), a folder per group, and the number of groups."""
    named = labels.filter("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    groups = max(1, round(named.count() / group_rows))
    named = named.withColumn("draw", F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1 << 30)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            own = tokens(texts_of(part))
            yield pa.RecordBatch.from_arrays([pa.array([t.tobytes() for t in own], pa.binary()), *part.columns[1:]], ["words", "toxic", "lang", "draw"])
        _KNOWN.clear()

    found = docs.select("doc_id", "text", "lang").join(bounded_broadcast(named, BROADCAST_LABELS), "doc_id").select("text", (F.col("toxic") > 0).cast("int").alias("toxic"), "lang", "draw")
    found = found.mapInArrow(run, "words binary, toxic int, lang string, draw bigint")
    group = F.pmod(F.xxhash64("draw"), F.lit(groups)).alias("grp")  # by id, so that copies of a row stay together
    path = shared_path(docs.sparkSession, "labelled")
    dealt = found.select("*", group, (F.col("draw") % HELD == 0).alias("held")).repartition(groups, "grp").sortWithinPartitions("grp", "draw", "words", "lang")
    dealt.drop("draw").write.partitionBy("grp").parquet(path)
    return path, groups


def _rows_of(path: str, group: int, named: list[str], at_once: int = 8 * BATCH) -> Iterator[Rows]:
    """The stored rows of a group in their order."""
    place = {x: k for k, x in enumerate(named)}
    files, listed = parquet_files(f"{path}/grp={group}")
    for name in listed:
        with files.open_input_file(name) as opened:
            for batch in pq.ParquetFile(opened).iter_batches(at_once, columns=["words", "toxic", "lang", "held"]):
                words, toxic, lang, held = (c.to_pylist() for c in batch.columns)
                yield Rows([np.frombuffer(w, np.int32) for w in words], np.array(toxic, float), np.array([place.get(x, -1) for x in lang], int), np.array(held, bool))
    release()


def _each_group(spark: SparkSession, groups: int, work, names: list[str], schema: str) -> DataFrame:
    """The columns that ``work`` returns for every group, each in a task of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for group in batch.column(0).to_pylist():
                columns = work(group)
                for a in range(0, len(columns[0]), 10_000):
                    yield pa.RecordBatch.from_arrays([pa.array(c[a : a + 10_000]) for c in columns], names)

    return spark.range(0, groups, 1, groups).mapInArrow(run, schema)


def _tallied(spark: SparkSession, path: str, groups: int, named: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Negative and positive texts per bucket; words per bucket and language."""

    def work(group: int) -> list[np.ndarray]:
        counts, words = np.zeros((2, BUCKETS), np.int64), np.zeros((BUCKETS, len(named)), np.int64)
        for rows in _rows_of(path, group, named):
            rows.tally(counts, words)
        kind, bucket = np.nonzero(every := np.concatenate([counts, words.T]))
        return [kind, bucket, every[kind, bucket]]

    found = _each_group(spark, groups, work, ["kind", "bucket", "n"], "kind bigint, bucket bigint, n bigint")
    found = found.groupBy("kind", "bucket").agg(F.sum("n").alias("n")).toArrow()
    every = np.zeros((2 + len(named), BUCKETS))
    every[found["kind"].to_numpy(), found["bucket"].to_numpy()] = found["n"].to_numpy()
    return every[:2], every[2:].T


def _epoch(spark: SparkSession, path: str, groups: int, named: list[str], network: Network, rate: float) -> Network:
    """The mean of the networks that the groups make of ``network`` in one pass over their rows, by their numbers of rows."""
    shared = spark.sparkContext.broadcast(network)

    def work(group: int) -> list:
        own, seen = shared.value.unpacked(shared.value.packed()), 0
        for rows in _rows_of(path, group, named):
            for texts, labels in _batched(*rows.fitted()):
                own.step(texts, labels, rate)
                seen += len(texts)
        pieces = np.array_split(own.packed(), PIECES) if seen else []
        return [np.arange(len(pieces)), np.full(len(pieces), group), np.full(len(pieces), seen), [x.tobytes() for x in pieces]]

    def mean(table: pa.Table) -> pa.Table:
        table = table.sort_by("group")
        total, rows = 0.0, table["n"].to_numpy()
        for n, values in zip(rows, table["values"]):
            total = total + n * np.frombuffer(values.as_buffer(), np.float32).astype(np.float64)
        return pa.table({"piece": table["piece"][:1], "values": pa.array([(total / rows.sum()).astype(np.float32).tobytes()], pa.binary())})

    names = ["piece", "group", "n", "values"]
    found = _each_group(spark, groups, work, names, "piece bigint, group bigint, n bigint, values binary").groupBy("piece").applyInArrow(mean, "piece bigint, values binary")
    pieces = sorted(found.collect(), key=lambda r: r["piece"])
    return network.unpacked(np.concatenate([np.frombuffer(r["values"], np.float32) for r in pieces])) if pieces else network


def fit(docs: DataFrame, labels: DataFrame, group_rows: int = GROUP_ROWS, seed: int = 5) -> Model:
    """Learn from all rows of ``docs`` (doc_id, text, lang) that have a label (doc_id, toxic)."""
    spark = docs.sparkSession
    path, groups = labelled(docs, labels, group_rows)
    rows = spark.read.schema("toxic int, lang string, held boolean").parquet(path)
    size = rows.agg(F.count(F.lit(1)), F.count_if(~F.col("held")), F.coalesce(F.sum(F.when(~F.col("held"), F.col("toxic"))), F.lit(0))).first()
    if not size[0]:
        nothing = np.zeros((BUCKETS, FILTERS * sum(WIDTHS)), np.float32)
        return Model(nothing, np.zeros(1), np.zeros(1), 0.0, [], nothing[:, :0], np.array([TARGET]), empty=True)
    named = [r["lang"] for r in rows.filter("lang IS NOT NULL").select("lang").distinct().orderBy("lang").limit(MOST_LANGUAGES).collect()]
    counts, words = _tallied(spark, path, groups, named)
    network = _begun(counts, size[2], size[1], seed)
    for epoch in range(EPOCHS):
        network = _epoch(spark, path, groups, named, network, RATE / (1 + epoch / 2))
    model = _finished(network, named, words)
    shared = spark.sparkContext.broadcast(model)

    def work(group: int) -> list[np.ndarray]:
        parts = [r.judged(shared.value) for r in _rows_of(path, group, named)] or [[np.zeros(0)] * 3]
        guess, step, y = (np.concatenate(x).astype(np.int64) for x in zip(*parts))
        return [guess, step, y]

    held = _each_group(spark, groups, work, ["guess", "step", "toxic"], "guess bigint, step bigint, toxic bigint")
    held = held.groupBy("guess", "step").agg(F.sum("toxic").alias("hits"), F.count(F.lit(1)).alias("n")).toArrow()
    return _calibrate(model, *(held[c].to_numpy() for c in ("guess", "step", "hits", "n")))


def score(docs: DataFrame, model: Model, keep: list[str], text_col: str = "text", into: str = "") -> DataFrame:
    """The columns ``keep`` of ``docs`` and score, predicted, probability, guessed_lang (names begin with ``into``)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    fields = [docs.schema[c] for c in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for part in slices(batches, text_col, 1 << 19):
            s, p, guess = own.score(tokens(texts_of(part, text_col)))
            names = pa.array([*own.languages, None], pa.string()).take(pa.array(guess))
            more = [pa.array(s), pa.array((s >= TARGET).astype(np.int32)), pa.array(p), names]
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), *more], [*keep, *new])
        _KNOWN.clear()  # workers live on; a later stage needs the memory

    new = [into + x for x in ("score", "predicted", "probability", "guessed_lang")]
    kinds = (DoubleType(), IntegerType(), DoubleType(), StringType())
    picked = docs.select(*dict.fromkeys([*keep, text_col]))
    return picked.mapInArrow(run, StructType([*fields, *(StructField(n, t) for n, t in zip(new, kinds))]))
