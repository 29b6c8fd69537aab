"""Language-model scoring with a gated recurrent network over corpus counts.

Counts of all words are gathered from every training text, whole and exact: each task counts its own texts
before the shuffle. They give the base score (add-one unigram), the network's vocabulary, the initial
biases of its output and the distribution within its buckets of rarer words. The network's weights (gru.py)
start from a bounded sample, a window of each drawn text wherever it lies in it; then all different training
texts, whole, train them on: dealt into groups of about GROUP tokens, each group carries on from the same weights, and the
groups' weights are averaged by their tokens. So the weights learn from the whole corpus, while no task and
not the driver holds more than a group. The network then reads every whole text, its state carried from window to window.

The GLOSSARY most frequent words travel to the workers with their counts; words of more than LONG_WORD bytes stand
under a short digest everywhere. Rarer words are looked up by a
join: each text sends its rare words once, with how often they occur, and gets the sum of
their logarithms back; nothing about the corpus is ever held in one place but bounded tables.

Tokens are those of the contract: A-Z lower-cased, split at ASCII white space, then one end mark.

Defined cases: null text counts as empty and has one token, the end; rows without an id are scored but not
learned from; without training texts, as in an empty table, N and V are 0 and all counts too; an empty table
gives an empty result; words and texts of any length count whole; words that are equally frequent enter the
glossary by a hash; rows that repeat are counted, and scored, once for each row; other columns don't matter.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from zlib import crc32 as crc

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketry.llm.common import cores, sample_of, stable
from docketry.llm.gru import LANES, WINDOW, Gru

#: Frequent words of the network, buckets of the others, and words whose counts travel.
VOCABULARY = 1_024
BUCKETS = 64
GLOSSARY = 200_000
#: Bytes of a word beyond which a digest stands for it.
LONG_WORD = 48
#: Bounds of the sample that the weights start from: texts, and characters of each.
TRAIN_DOCS = 600
TRAIN_CHARS = 20_000
#: All training texts train the weights on, in groups of about so many tokens, in about so many steps and up to so many lanes.
GROUP = 1_000_000
STEPS = 64
MOST_LANES = 512
#: Symbols, about, that a task scores at once.
SCORED = 2_000_000
#: Numbers in a block of weights, as groups hand them on.
_BLOCK = 8_192
#: Bytes of words that a task gathers before it counts them, and characters, about, that it reads at once for training.
COUNTED = 48_000_000
READ = 100_000_000
#: Step size when groups train the weights on.
ON_RATE = 1e-2
END = b"\n"


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts, one after the other, and how many each text has. Words stay in Arrow's buffers: there is no object for each."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts.cast(pa.string())))
    words, sizes = lists.flatten(), pc.list_value_length(lists).fill_null(0).to_numpy()
    # white space at an end of a text, or no word at all, leaves an empty string
    real = pc.greater(pc.binary_length(words), 0)
    kept = real.to_numpy(zero_copy_only=False)
    if kept.all():
        return words, sizes
    return words.filter(real), np.bincount(np.repeat(np.arange(len(sizes)), sizes)[kept], minlength=len(sizes))


def key_of(word: bytes) -> bytes:
    """The word, or for a long one a digest behind a line break, which no word holds."""
    return word if len(word) <= LONG_WORD else b"\n" + xxhash.xxh3_128_hexdigest(word).encode()


def keys_of(words: pa.Array) -> pa.Array:
    """key_of() each word."""
    long = pc.greater(pc.binary_length(words), LONG_WORD)
    if not pc.any(long).as_py():
        return words
    digests = [key_of(w) for w in words.filter(long).cast(pa.binary()).to_pylist()]
    return pc.replace_with_mask(words, long, pa.array(digests, pa.binary()).cast(pa.string()))


def bucket(word: bytes) -> int:
    """By the last three bytes, which tell much about a word's language and kind."""
    return crc(word[-3:]) % BUCKETS


def bucket_column(word: Column) -> Column:
    return (F.crc32(F.substring(word.cast("binary"), -3, 3)) % BUCKETS).cast("int")


def count_words(texts: DataFrame) -> DataFrame:
    """(text binary) -> (word, c), without the end mark; long words by their digests."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            held.append(words_of(batch.column(0))[0])
            size += held[-1].nbytes
            if size > COUNTED:
                yield _counted(held)
                held, size = [], 0
        yield _counted(held)

    return texts.mapInArrow(run, "word string, c long").groupBy("word").agg(F.sum("c").alias("c"))


def _counted(held: list[pa.Array]) -> pa.RecordBatch:
    found = pa.chunked_array(held, pa.string()).value_counts()
    return pa.RecordBatch.from_arrays([keys_of(found.field("values")), found.field("counts")], names=["word", "c"])


class Reader:
    """Turns texts into ids of the network, and counts into logarithms."""

    def __init__(self, glossary: list[tuple[bytes, int]], ends: int, n: int, v: int, totals: np.ndarray):
        """glossary: most frequent first; totals: sum of (c + 1) over the words of each bucket."""
        self.vocabulary = [END, *[w for w, _ in glossary[: VOCABULARY - 1]]]
        words = [END, *[w for w, _ in glossary]]
        counts = np.array([ends, *[c for _, c in glossary]], np.float64)
        k = len(self.vocabulary)
        self.words = pa.array(words, pa.binary()).cast(pa.string())
        self.symbol = np.array([i if i < k else k + bucket(w) for i, w in enumerate(words)], np.int32)
        self.log_count = np.log10(counts + 1)
        self.known = counts > 0
        self.log_bucket = np.log10(totals + 1)
        self.log_all = math.log10(n + v + 1)
        self.k, self.totals, self.counts = k, totals, counts

    def network(self) -> Gru:
        return Gru(self.counts[: self.k], self.totals)

    def read(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
        """(words of each text; of all texts, one after the other: places in the glossary or -1, symbols, keys of words not in the glossary), without the end marks."""
        words, sizes = words_of(texts)
        words = keys_of(words)
        found = pc.index_in(words, value_set=self.words)
        places = found.fill_null(-1).to_numpy()
        unknown, symbols = words.filter(found.is_null()), self.symbol[places]
        if len(unknown):
            ends = pc.binary_slice(unknown.cast(pa.binary()), -3)
            symbols[places < 0] = [self.k + crc(w) % BUCKETS for w in ends.to_numpy(zero_copy_only=False)]
        return sizes, places, symbols, unknown

    def symbols(self, texts: list[str]) -> list[np.ndarray]:
        """The symbols of each text."""
        ends, found = np.cumsum([len(t) for t in texts]), []
        # by runs of bounded length, as an array of Arrow's holds 2 GB at most
        for run in np.split(np.arange(len(texts)), np.flatnonzero(np.diff(ends // READ)) + 1):
            sizes, _, symbols, _ = self.read(pa.array([texts[i] for i in run], pa.string()))
            found += _split(symbols, sizes)
        return found


def _split(symbols: np.ndarray, sizes: np.ndarray) -> list[np.ndarray]:
    return np.split(symbols, np.cumsum(sizes)[:-1]) if len(sizes) else []


def learn(docs: DataFrame, chosen: Column, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, Reader, Gru, int]:
    """(counts of all training words, reader, network, N)."""
    training = docs.filter(F.coalesce(chosen, F.lit(False)))
    counts = stable(count_words(training.select(F.col(text_col).cast("string").cast("binary").alias("text"))))
    ends = training.count()
    total = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    n, v = total["n"] + ends, total["v"] + (1 if ends else 0)
    top = _most_frequent(counts, GLOSSARY).toPandas()
    glossary = sorted(zip((w.encode() for w in top["word"]), (int(c) for c in top["c"])), key=lambda x: (-x[1], x[0]))
    totals = np.zeros(BUCKETS)
    # the frequent words are counted too and taken out again
    for r in counts.groupBy(bucket_column(F.col("word")).alias("b")).agg(F.sum(F.col("c") + 1).alias("t")).collect():
        totals[r["b"]] = r["t"]
    for w, c in glossary[: VOCABULARY - 1]:
        totals[bucket(w)] -= c + 1
    reader = Reader(glossary, ends, n, v, totals)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    hashed = training.select(F.xxhash64(F.col(id_col), F.lit(9)).alias("h"), text.alias("text"))
    at = F.pmod("h", F.greatest(F.length("text") - TRAIN_CHARS, F.lit(0)) + 1).cast("int") + 1
    drawn = sample_of(hashed.withColumn("text", F.substring("text", at, F.lit(TRAIN_CHARS))), "h", TRAIN_DOCS)
    network = reader.network().fit(reader.symbols([r["text"] for r in drawn]))
    return counts, reader, _trained_on(hashed, reader, network, n), n


def _trained_on(hashed: DataFrame, reader: Reader, network: Gru, n: int) -> Gru:
    """The network after all texts (h, text), of n tokens together, trained it on, group by group, averaged by tokens."""
    spark = hashed.sparkSession
    groups = -(-n // GROUP)
    if not groups:
        return network
    held = spark.sparkContext.broadcast((reader, network))

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        of, start = held.value
        # rows that repeat an id and its text train once
        texts = of.symbols(pdf.drop_duplicates().sort_values(["h", "text"])["text"].tolist())
        size = sum(map(len, texts)) + len(texts)
        flat = start.copy().fit(texts, epochs=1, rate=ON_RATE, n_lanes=max(LANES, min(MOST_LANES, size // (STEPS * WINDOW)))).flat()
        blocks = [flat[i : i + _BLOCK] for i in range(0, len(flat), _BLOCK)]
        return pd.DataFrame({"block": range(len(blocks)), "size": size, "w": [b.tobytes() for b in blocks]})

    def mean(pdf: pd.DataFrame) -> pd.DataFrame:
        total, size = 0.0, 0
        for n, w in pdf.sort_values(["size", "w"])[["size", "w"]].itertuples(index=False):
            total, size = total + n * np.frombuffer(w, np.float32).astype(np.float64), size + n
        return pd.DataFrame({"block": [pdf["block"].iloc[0]], "w": [(total / size).astype(np.float32).tobytes()]})

    # a text goes to its group once, and is kept nowhere else
    dealt = hashed.withColumn("g", F.pmod(F.xxhash64("h", F.xxhash64("text")), F.lit(groups)))
    fitted = dealt.repartition(int(min(20_000, max(cores(spark), groups))), "g").groupBy("g").applyInPandas(lambda pdf: fit(pdf[["h", "text"]]), "block int, size long, w binary")
    means = fitted.groupBy("block").applyInPandas(mean, "block int, w binary").collect()
    return network.copy().load(np.concatenate([np.frombuffer(w, np.float32) for _, w in sorted(tuple(r) for r in means)]))


def _most_frequent(counts: DataFrame, n: int) -> DataFrame:
    """The n most frequent words; of the last level of counts, those with the smallest hashes. Only a few hundred levels meet in one place."""
    level = F.floor(F.log2("c") * 32).cast("int")
    held, cut = 0, None
    for r in counts.groupBy(level.alias("l")).agg(F.count("*").alias("n")).orderBy(F.desc("l")).collect():
        cut = r["l"]
        if held + r["n"] > n:
            break
        held, cut = held + r["n"], r["l"] - 1
    if cut is None:
        return counts.limit(0)
    return counts.filter(level > cut).unionByName(counts.filter(level == cut).orderBy(F.xxhash64("word"), "word").limit(n - held))


class _Texts:
    """Texts that are scored together, and what a task says of each."""

    def __init__(self, reader: Reader):
        self.of, self.size, self.symbols, self.main = reader, 0, [], []

    def take(self, idents: pa.Array, texts: pa.Array, names: list[str], kinds: list[pa.DataType]) -> Iterator[pa.RecordBatch]:
        """Yields the rare words of each text and how often it has them."""
        of, m = self.of, len(texts)
        uids = pa.array([xxhash.xxh3_64_intdigest(t.as_py() or b"") - (1 << 63) for t in texts], kinds[0])
        sizes, places, symbols, unknown = of.read(texts)
        self.symbols += _split(symbols, sizes)
        self.size += len(symbols) + m
        text = np.repeat(np.arange(m), sizes)
        seen, outside = places >= 0, symbols >= of.k
        total = lambda at, x: np.bincount(text[at], x, m)
        base = total(seen, of.log_count[places[seen]]) + of.log_count[0] - (sizes + 1) * of.log_all
        known = total(seen, of.known[places[seen]]).astype(np.int64) + int(of.known[0])
        # what the counts say within the buckets
        inside = seen & outside
        inner = total(inside, of.log_count[places[inside]]) - total(outside, of.log_bucket[symbols[outside] - of.k])
        self.main.append((uids, idents, pa.array(sizes + 1, kinds[2]), pa.array(known), pa.array(base), inner))
        words = unknown.dictionary_encode()
        each, times = np.unique(text[~seen] * (len(words.dictionary) + 1) + words.indices.to_numpy(), return_counts=True)
        for at in range(0, len(each), 50_000):
            row, word = map(pa.array, np.divmod(each[at : at + 50_000], len(words.dictionary) + 1))
            yield pa.RecordBatch.from_arrays([uids.take(row), idents.take(row), *[pa.nulls(len(word), k) for k in kinds[2:6]], words.dictionary.take(word), pa.array(times[at : at + 50_000])], names=names)

    def scored(self, net: Gru, names: list[str]) -> Iterator[pa.RecordBatch]:
        """Yields a row for each text."""
        whole, at = net.score(self.symbols) / math.log(10), 0
        for uids, *more, inner in self.main:
            keys = pa.array([f" {uid} {at + i}" for i, uid in enumerate(uids.to_pylist())], pa.string())
            yield pa.RecordBatch.from_arrays([uids, *more, pa.array(whole[at : at + len(uids)] + inner), keys, pa.nulls(len(uids), pa.int64())], names=names)
            at += len(uids)


def score(docs: DataFrame, chosen: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """-> (id, n_tokens, n_known, train_tokens, base_score, score): one row for each row of docs."""
    counts, reader, network, n = learn(docs, chosen, id_col, text_col)
    held = docs.sparkSession.sparkContext.broadcast((reader, network))
    fields = "uid long, id long, n_tokens long, n_known long, base double, score double, key string, times long"
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.string(), pa.int64()]
    names = [f.split()[0] for f in fields.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, net = held.value
        texts = _Texts(of)
        for batch in batches:
            yield from texts.take(batch.column(0), batch.column(1), names, kinds)
            if texts.size > SCORED:
                yield from texts.scored(net, names)
                texts = _Texts(of)
        yield from texts.scored(net, names)

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").cast("binary").alias("text")).mapInArrow(run, fields)
    # the row of a text itself has a key of its own that is no word (it holds a space), so that it is dealt out evenly
    found = rows.join(counts.select(F.col("word").alias("key"), "c"), "key", "left")
    times, logs = F.coalesce("times", F.lit(0)), F.log10(F.coalesce("c", F.lit(0)) + 1)
    own = F.max(F.struct(F.col("n_tokens").isNotNull().alias("own"), "n_tokens", "n_known", "base", "score"))
    # a row is told by its id and its text, so that a task that runs again says the same; rows that repeat both are `rows`
    summed = found.groupBy("id", "uid").agg(own.alias("m"), F.count("n_tokens").alias("rows"), F.sum(times * logs).alias("logs"), F.sum(F.when(F.col("c") > 0, times).otherwise(0)).alias("known"))
    one = summed.withColumn("logs", F.col("logs") / F.col("rows")).withColumn("known", (F.col("known") / F.col("rows")).cast("long"))
    again = one.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("rows").cast("int"))))
    return again.select(
        F.col("id").alias(id_col), F.col("m.n_tokens").alias("n_tokens"), (F.col("m.n_known") + F.col("known")).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"), (F.col("m.base") + F.col("logs")).alias("base_score"), (F.col("m.score") + F.col("logs")).alias("score"),
    )
