"""Language-model scoring with a log-frequency Bloom filter.

The model is an interpolated bigram model over words, learned from all training
texts.  The filter holds, for every bigram and every rare word, its count on a
logarithmic scale: a count c is entered as levels 1 .. 1 + floor(log2 c), and a
reader probes level after level until one is absent.

1. One pass counts words exactly.  The most frequent words (at most
   ``FREQUENT_WORDS``) are broadcast with their exact counts.
2. One pass counts bigrams: tasks combine their own, the rest meets by filter
   shard.  A shard becomes one Bloom filter of its own size, so the error rate is
   the same at every corpus size and a shard is bounded.
3. One pass scores all documents.  The shards are broadcast in groups of at most
   ``FILTER_BYTES``; a task holds one group at a time and keeps its tokens while
   it goes through the groups.  A bigram whose second word is rare lies in the
   shard of that word, so one shard decides a token alone.

P(w | v) = (1 - back) * c(v w) / c(v) + back * (c(w) + 0.1) / (N + 0.1 * (V + 1)),
where ``back`` is the share of bigram types, T / (T + C), among contexts as
frequent as v.  A rare v has the mean count of rare words.

The base score is exact: frequent words are scored in the task, rare ones by a
join with their counts.

Words are compared by 64-bit hashes.  Defined cases: a null text is empty and has
one token, its end; without training texts every probability of the base is 1 and
the score equals it; rows that repeat an id are scored separately; a very long text
is one row, held with some fifty bytes a word; an empty table gives an empty result.
Other columns are carried only if named.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickerloom.llm.common import slices, texts_of, written

FREQUENT_WORDS = 1_000_000
FILTER_BYTES = 192 << 20
BITS_PER_ENTRY = 10
HASHES = 5
TOKENS_PER_SHARD = 2_000_000
#: Tokens that a task gathers before it writes bigram counts, and before it scores.
BLOCK_TOKENS = 2_000_000
TASK_TOKENS = 3_000_000
ADDED = 0.1
RARE, UNIGRAM = 30, 31

_U = np.uint64
#: No word contains white space, so these two hashes are never those of a word of the text.
END = xxhash.xxh3_64_intdigest(b" ")
START = xxhash.xxh3_64_intdigest(b"\t")
_A, _B, _C = _U(0x9E3779B97F4A7C15), _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _B
    x = (x ^ (x >> _U(27))) * _C
    return x ^ (x >> _U(31))


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words and one end per text, text after text; number of tokens of each text."""
    split = [t.encode("utf-8", "surrogatepass").lower().split() for t in texts]
    sizes = np.fromiter(map(len, split), np.int64, len(split)) + 1
    flat = np.full(int(sizes.sum()), END, _U)
    words = np.ones(len(flat), bool)
    words[np.cumsum(sizes) - 1] = False
    flat[words] = np.fromiter((h for s in split for h in map(xxhash.xxh3_64_intdigest, s)), _U, int(words.sum()))
    return flat, sizes


def context_class(count: np.ndarray) -> np.ndarray:
    """Class of a frequent context by its count, 0 to 29."""
    return np.minimum(np.log2(np.maximum(count, 1)).astype(np.int64), RARE - 1)


@dataclass
class Frequent:
    """Sorted hashes and exact counts of the frequent words, and what else tasks need."""

    words: np.ndarray
    counts: np.ndarray
    tokens: int
    distinct: int
    texts: int
    shards: int

    def count(self, words: np.ndarray) -> np.ndarray:
        """Exact count, or -1 of a word that is not frequent."""
        if not len(self.words):
            return np.full(len(words), -1)
        at = np.minimum(np.searchsorted(self.words, words), len(self.words) - 1)
        return np.where(self.words[at] == words, self.counts[at], -1)

    def bigrams(self, words: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, ...]:
        """Key and shard of every bigram, counts of its two words (-1: rare), class of its context."""
        before = np.empty_like(words)
        before[1:] = words[:-1]
        first = np.cumsum(sizes) - sizes
        before[first] = START
        count = self.count(words)
        context = np.empty_like(count)
        context[1:] = count[:-1]
        context[first] = self.texts
        kind = np.where(context < 0, RARE, context_class(context))
        pair = _mixed(before * _A + words)
        key = (pair & ~_U(31)) | kind.astype(_U)
        return key, self.shard(np.where(count < 0, _mixed(words), pair)), context, count, kind

    def unigram(self, words: np.ndarray) -> np.ndarray:
        """Key of a rare word."""
        return (_mixed(words ^ _A) & ~_U(31)) | _U(UNIGRAM)

    def shard(self, mixed: np.ndarray) -> np.ndarray:
        return ((mixed >> _U(32)) * _U(self.shards) >> _U(32)).astype(np.int64)


def _levels(counts: np.ndarray) -> np.ndarray:
    return 1 + np.log2(counts).astype(np.int64)


def _positions(keys: np.ndarray, level: int, i: int, bits: np.ndarray) -> np.ndarray:
    """The i-th bit of every key at a level, in filters of ``bits`` bits (below 2^32)."""
    mixed = _mixed(keys + _U(level * int(_A) % 2**64))
    return (((mixed & _U(0xFFFFFFFF)) + _U(i) * ((mixed >> _U(32)) | _U(1)) & _U(0xFFFFFFFF)) * bits.astype(_U)) >> _U(32)


def filled(keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Bloom filter of one shard as bytes."""
    levels = _levels(counts)
    size = np.array([max(64, -(-int(levels.sum()) * BITS_PER_ENTRY // 64) * 64)])
    bits = np.zeros(int(size[0]), bool)
    for level in range(1, int(levels.max(initial=0)) + 1):
        own = keys[levels >= level]
        for i in range(HASHES):
            bits[_positions(own, level, i, size)] = True
    return np.packbits(bits, bitorder="little")


@dataclass
class Filter:
    """Filters of a range of shards, one after the other; a shard outside has size 0."""

    data: np.ndarray
    starts: np.ndarray  # bit at which a shard starts
    sizes: np.ndarray  # bits of a shard

    def holds(self, shard: np.ndarray) -> np.ndarray:
        return self.sizes[shard] > 0

    def counts(self, keys: np.ndarray, shard: np.ndarray) -> np.ndarray:
        """Count of every key in the middle of its level, 0 if absent."""
        level = np.zeros(len(keys), np.int64)
        alive, now = np.arange(len(keys)), 0
        while len(alive):
            now += 1
            for i in range(HASHES):
                at = self.starts[shard[alive]] + _positions(keys[alive], now, i, self.sizes[shard[alive]]).astype(np.int64)
                alive = alive[(self.data[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)]
            level[alive] = now
        return np.where(level > 0, (1.5 * 2.0 ** np.maximum(level, 1) - 1) / 2, 0.0)


def _rare(bucket: Column, least: int) -> Column:
    """Words below the least frequent bucket; the end is never rare."""
    return (bucket < least) & (F.col("w") != int(np.array([END], _U).view(np.int64)[0]))


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def word_counts(train: DataFrame) -> DataFrame:
    """w (hash), n: exact counts of all training tokens, the end included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            words, n = np.unique(np.concatenate(kept), return_counts=True)
            kept.clear()
            return pa.RecordBatch.from_arrays([_signed(words), pa.array(n, pa.int64())], ["w", "n"])

        for part in slices(batches):
            kept.append(word_hashes(texts_of(part))[0])
            if sum(map(len, kept)) > BLOCK_TOKENS:
                yield flush()
        if kept:
            yield flush()

    return train.select("text").mapInArrow(run, "w bigint, n bigint").groupBy("w").agg(F.sum("n").alias("n"))


def _blocks(key: np.ndarray, shard: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    """One row per shard: keys and counts as bytes."""
    order = np.argsort(shard, kind="stable")
    key, n, shard = key[order], n[order].astype("<u4"), shard[order]
    own, first = np.unique(shard, return_index=True)
    ends = [*first[1:], len(shard)]
    many = n > 1  # the counts of all others are 1
    rows = [(key[a:b].tobytes(), np.flatnonzero(many[a:b]).astype("<u4").tobytes(), n[a:b][many[a:b]].tobytes()) for a, b in zip(first, ends)]
    return pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), *(pa.array([r[k] for r in rows], pa.binary()) for k in range(3))], ["shard", "keys", "which", "counts"])


_BLOCK = "shard int, keys binary, which binary, counts binary"


def _bigram_blocks(train: DataFrame, shared) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[tuple[np.ndarray, np.ndarray]] = []

        def flush() -> pa.RecordBatch:
            key, first, n = np.unique(np.concatenate([k for k, _ in kept]), return_index=True, return_counts=True)
            shard = np.concatenate([s for _, s in kept])[first]
            kept.clear()
            return _blocks(key, shard, n)

        for part in slices(batches):
            kept.append(shared.value.bigrams(*word_hashes(texts_of(part)))[:2])
            if sum(len(k) for k, _ in kept) > BLOCK_TOKENS:
                yield flush()
        if kept:
            yield flush()

    return train.select("text").mapInArrow(run, _BLOCK)


def _unigram_blocks(rare: DataFrame, shared) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                words = batch.column(0).to_numpy().view(_U)
                yield _blocks(shared.value.unigram(words), shared.value.shard(_mixed(words)), batch.column(1).to_numpy())

    return rare.select("w", "n").mapInArrow(run, _BLOCK)


def _shard_filters(blocks: DataFrame) -> DataFrame:
    """shard, data (the filter), types (distinct bigrams by class of the context)."""

    def build(table: pa.Table) -> pa.Table:
        keys, counts = [], []
        for k, which, n in zip(*(table[c].to_pylist() for c in ("keys", "which", "counts"))):
            keys.append(np.frombuffer(k, _U))
            own = np.ones(len(keys[-1]))
            own[np.frombuffer(which, "<u4")] = np.frombuffer(n, "<u4")
            counts.append(own)
        key, place = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.bincount(place, np.concatenate(counts))
        types = np.bincount((key & _U(31)).astype(np.int64), minlength=32)
        return pa.table({"shard": table["shard"][:1], "data": pa.array([filled(key, total).tobytes()], pa.binary()), "types": pa.array([types.tolist()], pa.list_(pa.int64()))})

    return blocks.groupBy("shard").applyInArrow(build, "shard int, data binary, types array<bigint>")


@dataclass
class Model:
    frequent: object  # broadcast of Frequent
    filters: list  # broadcasts of Filter, each within FILTER_BYTES
    back: np.ndarray  # by class of the context
    rare_mean: float
    counts: DataFrame  # w, n of rare words
    denominator: float
    tokens: int


def fit(train: DataFrame, text_col: str = "text", frequent_words: int = FREQUENT_WORDS, filter_bytes: int = FILTER_BYTES) -> Model:
    """Learn from all rows of ``train``."""
    sc = train.sparkSession.sparkContext
    train = train.select(F.col(text_col).alias("text"))
    counts = written(word_counts(train), "words")
    bucket = F.floor(F.log2("n") * 4).cast("int")
    sizes = counts.groupBy(bucket.alias("b")).agg(F.count("*").alias("words"), F.sum("n").alias("n")).orderBy(F.desc("b")).collect()
    tokens, distinct, least, held = sum(r["n"] for r in sizes), sum(r["words"] for r in sizes), 1 << 30, 0
    for r in sizes:
        held += r["words"]
        if held > frequent_words:
            break
        least = r["b"]
    rare = counts.filter(_rare(bucket, least))
    top = counts.filter(~_rare(bucket, least)).toArrow()
    words = top["w"].to_numpy().astype(np.int64).view(_U)
    order = np.argsort(words)
    words, n = words[order], top["n"].to_numpy()[order]
    texts = int(n[words == END].sum())
    shards = max(1, -(-tokens // TOKENS_PER_SHARD))
    own = Frequent(words, n, tokens, distinct, texts, shards)
    shared = sc.broadcast(own)

    blocks = _bigram_blocks(train, shared).unionByName(_unigram_blocks(rare, shared))
    built = written(_shard_filters(blocks), "filters")
    groups, types = [], np.zeros(32)
    data: list[np.ndarray] = []
    places: list[int] = []

    def close() -> None:
        if data:
            sizes = np.zeros(shards, np.int64)
            starts = np.zeros(shards, np.int64)
            lengths = np.array([8 * len(x) for x in data])
            sizes[places], starts[places] = lengths, np.cumsum(lengths) - lengths
            groups.append(sc.broadcast(Filter(np.concatenate(data), starts, sizes)))
            data.clear()
            places.clear()

    for row in built.toLocalIterator():
        if data and sum(map(len, data)) + len(row["data"]) > filter_bytes:
            close()
        data.append(np.frombuffer(row["data"], np.uint8))
        places.append(row["shard"])
        types += np.array(row["types"])
    held = set(built.select("shard").toPandas()["shard"])
    for shard in (k for k in range(shards) if k not in held):  # nothing falls into it
        data.append(np.zeros(8, np.uint8))
        places.append(shard)
    close()

    follows = np.zeros(32)  # tokens after contexts of a class
    contexts = words != END
    np.add.at(follows, context_class(n[contexts]), n[contexts])
    follows[context_class(np.array([texts]))[0]] += texts
    follows[RARE] = tokens - texts - n[contexts].sum()
    back = np.where(types + follows > 0, types / np.maximum(types + follows, 1), 1.0)
    rare_words = distinct - len(words)
    mean = float(follows[RARE] / rare_words) if rare_words else 1.0
    return Model(shared, groups, back, mean, rare, tokens + ADDED * (distinct + 1), tokens)


def _released(shared) -> None:
    """Forget a broadcast value that this worker has read; its file stays and can be read again."""
    if hasattr(shared, "_value"):
        del shared._value


def score(docs: DataFrame, model: Model, keep: list[str], text_col: str = "text") -> DataFrame:
    """The columns ``keep`` of ``docs`` (none of them named like a result) and n_tokens, n_known,
    train_tokens, base_score, score."""
    frequent, filters, back, mean, denominator = model.frequent, model.filters, model.back, model.rare_mean, model.denominator
    rows = docs.select(F.struct(*keep).alias("kept"), F.monotonically_increasing_id().alias("row"), F.col(text_col).alias("text"))

    def scored(parts: list[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        own = frequent.value
        state = []
        for _, words, sizes in parts:
            key, shard, context, count, kind = own.bigrams(words, sizes)
            state.append((key, shard, context, count, kind, np.zeros(len(sizes)), np.repeat(np.arange(len(sizes)), sizes)))
        for group in filters:
            for (_, words, sizes), (key, shard, context, count, kind, total, owner) in zip(parts, state):
                here = np.flatnonzero(group.value.holds(shard))
                if len(here):
                    own_shard, unknown = shard[here], count[here] < 0
                    unigram = count[here].astype(float)
                    unigram[unknown] = group.value.counts(own.unigram(words[here][unknown]), own_shard[unknown])
                    pair = group.value.counts(key[here], own_shard)
                    before = np.where(context[here] < 0, np.maximum(mean, pair), np.maximum(context[here], 1))
                    step = back[kind[here]]
                    seen = (context[here] >= 0) | (pair > 0)  # else nothing is known of the context
                    step = np.where(seen, step, 1.0)
                    chance = (1 - step) * np.minimum(pair / before, 1) + step * (unigram + ADDED) / denominator
                    total += np.bincount(owner[here], np.log10(chance), len(sizes))
            if len(filters) > 1:
                _released(group)
        for (part, words, sizes), (_, _, _, count, _, total, owner) in zip(parts, state):
            common = count >= 0
            base = np.bincount(owner[common], np.log10((count[common] + ADDED) / denominator), len(sizes))
            rare = np.flatnonzero(~common)
            offsets = np.concatenate([[0], np.cumsum(np.bincount(owner[rare], minlength=len(sizes)))])
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0),
                    part.column(1),
                    pa.array(sizes, pa.int64()),
                    pa.array(np.bincount(owner[common], minlength=len(sizes)), pa.int64()),
                    pa.array(base, pa.float64()),
                    pa.array(total, pa.float64()),
                    pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), _signed(words[rare])),
                ],
                ["kept", "row", "n_tokens", "known", "base", "score", "rare"],
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for part in slices(batches):
            words, sizes = word_hashes(texts_of(part))
            parts.append((part.select([0, 1]), words, sizes))
            held += len(words)
            if len(filters) < 2 or held > TASK_TOKENS:
                yield from scored(parts)
                parts, held = [], 0
        if parts:
            yield from scored(parts)

    kind = rows.schema["kept"].dataType.simpleString()
    done = written(rows.mapInArrow(run, f"kept {kind}, row bigint, n_tokens bigint, known bigint, base double, score double, rare array<bigint>"), "scores")
    rare = done.select("row", F.explode("rare").alias("w")).groupBy("row", "w").agg(F.count("*").alias("times"))
    rare = rare.join(model.counts, "w", "left").groupBy("row").agg(
        F.sum(F.when(F.col("n").isNotNull(), F.col("times")).otherwise(0)).alias("rare_known"),
        F.sum(F.col("times") * F.log10((F.coalesce("n", F.lit(0)) + ADDED) / denominator)).alias("rare_base"),
    )
    return done.drop("rare").join(rare, "row", "left").select(
        "kept.*",
        "n_tokens",
        (F.col("known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
        F.lit(model.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("rare_base", F.lit(0.0))).alias("base_score"),
        "score",
    )
