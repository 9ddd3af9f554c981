"""Language-model scores of whole texts.

The model is a causal self-attention network over subword ids, trained in numpy: replicas train on their
share of the training windows and their parameters are averaged after every round. Its probability of an id
is mixed with that of a memory of word beginnings, counted over all training texts, so that a word
has the share it has in the corpus. The beginnings of frequent words are sent to the tasks; those of all others are
joined to the words of the texts, however rare they are. Texts are scored in overlapping windows, each id once.

A text is its words, lower-cased, and one end. The ids are those of each word with a space before it.
"""

from __future__ import annotations

import base64
import math
from array import array
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from tidemark.llm import attention
from tidemark.llm.common import drop_tables, fields, keep_freed_memory, shared_table, slices

#: The held-out rest of crc32(doc_id as text) modulo FOLDS.
FOLDS, HELD_OUT = 7, 2
#: Learning rate of each round (each trains on another one of so many parts, so that together they go through all
#: training documents); documents of a replica, about as many as one pass of LEAST_STEPS needs, and the most replicas.
RATES, REPLICA_DOCS, MAX_REPLICAS = (0.02, 0.012, 0.006), 800, 1024
#: Steps a replica makes in a round at least, by going through its windows again, and the most passes.
LEAST_STEPS, MOST_PASSES = 400, 8
OVERLAP = 3
#: Share of the memory in a probability, and ids (or stop) of a remembered word beginning.
MEMORY_SHARE, KEY_IDS = 0.35, 4
#: Words whose counts and beginnings are sent to the tasks (the most frequent); all others are joined.
FREQUENT_WORDS = 150_000
#: Distinct words a task remembers before it starts its memory anew, or hands on its counts.
KNOWN_WORDS = 300_000
#: The ids of a word are 0 to END_ID - 1; END_ID ends a text, STOP ends a word.
END_ID, STOP = 50_256, 0xFFFF
END_WORD = b""


def words_of(text: str | None) -> list[bytes]:
    """The words of the text (A to Z lower-cased, split at ASCII white space), then the end."""
    return [*(text or "").encode().lower().split(), END_WORD]


class Subwords:
    """Ids of words by a public rank file."""

    def __init__(self, rank_path: str, pattern: str):
        import tiktoken

        with open(rank_path, "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        self.encoding = tiktoken.Encoding("words", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        #: Ids that begin with a space; no id has one behind its first byte.
        self.spaced = np.zeros(END_ID, bool)
        self.spaced[[i for b, i in ranks.items() if b.startswith(b" ")]] = True

    def ids(self, word: bytes) -> list[int]:
        return [END_ID] if word == END_WORD else self.encoding.encode_ordinary(" " + word.decode())

    def flat(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the words end to end, and how many each has.

        Words without any space are encoded in one text: each space begins a match of the pattern, and an id there.
        """
        text = b" ".join(words).decode()
        if len(words) > 1 and text.split() == text.split(" "):
            ids = np.array(self.encoding.encode_ordinary(" " + text), np.int64)
            first = np.flatnonzero(self.spaced[ids])
            if len(first) == len(words):
                return ids, np.diff(first, append=len(ids))
        if len(words) < 2:
            ids = np.array([i for w in words for i in self.ids(w)], np.int64)
            return ids, np.full(len(words), len(ids))
        half = len(words) // 2
        parts = self.flat(words[:half]), self.flat(words[half:])
        return np.concatenate([ids for ids, _ in parts]), np.concatenate([lengths for _, lengths in parts])


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (word, n): how often a word stands in training texts; zero for the words of held-out texts."""

    def rows(counts: Counter, others: set[bytes]) -> pa.RecordBatch:
        others = others.difference(counts)
        n = np.zeros(len(counts) + len(others), np.int64)
        n[: len(counts)] = list(counts.values())
        return pa.RecordBatch.from_arrays([pa.array([*counts, *others], pa.binary()), pa.array(n)], names=["word", "n"])

    counts, others = Counter(), set()
    for batch in slices(batches):
        for text, held_out in zip(batch.column("text").to_pylist(), batch.column("held_out").to_pylist()):
            (others if held_out else counts).update(words_of(text))
            if len(counts) + len(others) > KNOWN_WORDS:
                yield rows(counts, others)
                counts, others = Counter(), set()
    yield rows(counts, others)


def beginnings(ids: np.ndarray, lengths: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Keys of the first ids of each word, the first one, two and so on up to KEY_IDS, and of the whole with its stop.

    A key holds 16 bits for each id (plus one); zero where the word has fewer ids. A word whose stop does not
    fit has the stop key zero.
    """
    first = np.cumsum(lengths) - lengths
    key, keys, stop = np.zeros(len(lengths), np.uint64), [], np.zeros(len(lengths), np.uint64)
    for j in range(KEY_IDS):
        has = lengths > j
        own = np.zeros(len(lengths), np.uint64)
        own[has] = (ids[first[has] + j] + 1).astype(np.uint64) << np.uint64(16 * j)
        ended = lengths == j
        stop[ended] = key[ended] | (np.uint64(STOP) << np.uint64(16 * j))
        key = np.where(has, key | own, np.uint64(0))
        keys.append(key)
    return keys, stop


def _count_ids(rank_path: str, pattern: str):
    """Rows (kind, key, n): the count of every id (kind 0) and of every word beginning (kind 1)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_freed_memory()
        subwords = Subwords(rank_path, pattern)
        id_counts = np.zeros(END_ID + 1)

        def rows(kind: int, keys: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            columns = [pa.array(np.full(len(keys), kind, np.int32)), pa.array(keys.view(np.int64)), pa.array(n.astype(np.int64))]
            return pa.RecordBatch.from_arrays(columns, names=["kind", "key", "n"])

        for batch in batches:
            times = batch.column("n").to_numpy()
            ids, lengths = subwords.flat(batch.column("word").to_pylist())
            id_counts += np.bincount(ids, np.repeat(times, lengths), END_ID + 1)
            keys, stop = beginnings(ids, lengths)
            every, place = np.unique(np.concatenate([*keys, stop]), return_inverse=True)
            n = np.bincount(place, np.tile(times, KEY_IDS + 1))
            yield rows(1, every[every > 0], n[every > 0])
        seen = np.flatnonzero(id_counts)
        yield rows(0, seen.astype(np.uint64), id_counts[seen])

    return count


#: The steps of a word's path behind its first id.
PATH = [f"key{j}" for j in range(1, KEY_IDS)]


def _paths(firsts: np.ndarray, rank_path: str, pattern: str):
    """Rows (word, n, n_ids, n1, key1, key2, key3): how often the word's first id begins a word, and the keys that follow.

    Those of its first two, three and four ids; the one behind its last id has the stop. Zero behind the stop.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_freed_memory()
        subwords = Subwords(rank_path, pattern)
        for batch in batches:
            ids, lengths = subwords.flat(batch.column("word").to_pylist())
            keys, stop = beginnings(ids, lengths)
            path = [np.where(lengths == j, stop, keys[j]).view(np.int64) for j in range(1, KEY_IDS)]
            first = ids[np.cumsum(lengths) - lengths]
            columns = [batch.column("word"), batch.column("n"), pa.array(lengths), pa.array(firsts[first]), *map(pa.array, path)]
            yield pa.RecordBatch.from_arrays(columns, names=["word", "n", "n_ids", "n1", *PATH])

    return run


def remembered(counts: DataFrame, firsts: np.ndarray, rank_path: str, pattern: str) -> DataFrame:
    """The words of counts(word, n) with n_ids, n1, the keys of their path and n2 to n4: how many words begin so.

    Words are first added up by path; paths with a common beginning are at most as many as the ids allow.
    """
    words = counts.mapInArrow(_paths(firsts, rank_path, pattern), f"word binary, n bigint, n_ids bigint, n1 bigint, {', '.join(f'{k} bigint' for k in PATH)}")
    paths = words.groupBy(*PATH).agg(F.sum("n").alias(f"n{KEY_IDS}"))
    for j in range(KEY_IDS - 1, 1, -1):
        paths = paths.withColumn(f"n{j}", F.sum(f"n{KEY_IDS}").over(Window.partitionBy(*PATH[: j - 1])))
    return shared_table(words.join(paths, PATH), "lm-words")


class Model:
    """All that scoring needs but the rarer words' beginnings; bounded in size whatever the corpus."""

    def __init__(self, total: int, distinct: int, id_counts: dict[int, int], begun: dict[int, int]):
        self.total, self.distinct = total, distinct
        order = sorted(id_counts, key=lambda i: (-id_counts[i], i))
        self.rank = np.full(END_ID + 1, attention.RANKS, np.int64)
        self.rank[order[: attention.RANKS]] = np.arange(min(len(order), attention.RANKS))
        counts = np.zeros(attention.RANKS + 1)
        np.add.at(counts, self.rank[list(id_counts)], list(id_counts.values()))
        self.params = attention.initial(counts)
        # Ids beyond the table share the last class by their counts.
        other = np.array([id_counts.get(i, 0) for i in range(END_ID + 1)]) + 0.5
        other[self.rank < attention.RANKS] = 0.0
        self.in_rest = np.zeros(END_ID + 1, np.float32)
        rest = other > 0
        self.in_rest[rest] = np.log(other[rest] / other.sum())
        # Word beginnings by key.
        self.keys = np.array(sorted(begun), np.uint64)
        self.counts = np.array([begun[k] for k in self.keys.tolist()], np.float64)

    def _find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.keys):
            return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return at, self.keys[at] == keys

    def memory(self, ids: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of words end to end: share and rest weight of each id; of each word those of its stop, and its first id's share.

        A share is MEMORY_SHARE times the part of the words with this beginning that go on so; the rest
        weight is what all ways to go on leave to the network. A word's first id has its own below. True of
        words whose beginnings are all in the model.
        """
        share, rest = np.zeros(len(ids), np.float32), np.ones(len(ids), np.float32)
        stop, stop_rest = np.zeros(len(lengths), np.float32), np.ones(len(lengths), np.float32)
        first = np.cumsum(lengths) - lengths
        keys, stops = beginnings(ids, lengths)
        found = [self._find(k) for k in keys]
        n = [np.where(there, self.counts[at] if len(self.counts) else 0.0, 0.0) for at, there in found]
        stop_at, stop_there = self._find(stops)
        for j in range(KEY_IDS):
            known = n[j] > 0
            if j + 1 < KEY_IDS:
                on = known & (lengths > j + 1)
                share[first[on] + j + 1] = MEMORY_SHARE * n[j + 1][on] / n[j][on]
                rest[first[on] + j + 1] = 1.0 - MEMORY_SHARE
                end = known & (lengths == j + 1)
                stop_rest[end] = 1.0 - MEMORY_SHARE
                end &= stop_there
                stop[end] = MEMORY_SHARE * self.counts[stop_at[end]] / n[j][end]
        return share, rest, stop, stop_rest, (n[0] / max(1, self.total)).astype(np.float32)


class Scorer:
    """Scores texts in one task; remembers what it knows of each word."""

    def __init__(self, model: Model, counts: dict[bytes, int], subwords: Subwords):
        self.model, self.counts, self.subwords = model, counts, subwords
        self.start = int(model.rank[END_ID])
        self.forget()

    def forget(self) -> None:
        self.index: dict[bytes, int] = {}
        self.offset, self.length, self.count = array("q"), array("q"), array("q")
        self.stop, self.stop_rest, self.begin = array("f"), array("f"), array("f")
        self.rank, self.share, self.rest, self.inner = array("h"), array("f"), array("f"), array("f")

    def learn(self, words: list[bytes]) -> None:
        ids, lengths = self.subwords.flat(words)
        share, rest, stop, stop_rest, begin = self.model.memory(ids, lengths)
        self.index.update(zip(words, range(len(self.index), len(self.index) + len(words))))
        offsets = len(self.rank) + np.cumsum(lengths) - lengths
        for to, values in (
            (self.offset, offsets), (self.length, lengths), (self.stop, stop), (self.stop_rest, stop_rest), (self.begin, begin),
            (self.rank, self.model.rank[ids].astype(np.int16)), (self.inner, self.model.in_rest[ids]), (self.share, share), (self.rest, rest),
        ):
            to.frombytes(values.tobytes())
        self.count.extend([self.counts.get(w, -1) for w in words])

    def score(self, texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
        """Of each text: log10 probability; sum of log10(c + 1) and tokens with c > 0 over frequent words; its rarer words.

        The probability is without the ids that need a rarer word's beginnings. A rarer word has the network's
        probabilities of the ids at its first id's place plus 1, 2 and 3, as far as its path goes, and the part of the
        words that begin like the next one.
        """
        words = list(chain.from_iterable(texts))
        missing = set(words).difference(self.index)
        if missing:
            self.learn(sorted(missing))

        def flat(values: array) -> np.ndarray:
            return np.frombuffer(values, values.typecode)

        n_words = np.array([len(w) for w in texts])
        at = np.fromiter(map(self.index.__getitem__, words), np.int64, len(words))
        length, count = flat(self.length)[at], flat(self.count)[at]
        ends = np.cumsum(length)
        first = ends - length
        tokens = np.repeat(flat(self.offset)[at] - first, length) + np.arange(int(ends[-1]))
        share, rest = flat(self.share)[tokens], flat(self.rest)[tokens]
        # The first id of a word follows the stop of the word before; a text starts with a certain stop.
        text_first = np.cumsum(n_words) - n_words
        stop, stop_rest = np.roll(flat(self.stop)[at], 1), np.roll(flat(self.stop_rest)[at], 1)
        stop[text_first], stop_rest[text_first] = MEMORY_SHARE, 1.0 - MEMORY_SHARE
        share[first], rest[first] = stop * flat(self.begin)[at], stop_rest
        bounds = np.append(first[text_first], ends[-1])
        ranks = flat(self.rank)[tokens].astype(np.int64)
        network = attention.score_windows(self.model.params, attention.Windows(ranks, np.diff(bounds), self.start, OVERLAP))
        network = np.exp(network + flat(self.inner)[tokens])
        logs = np.log10(share.astype(np.float64) + rest.astype(np.float64) * network + 1e-30)
        base = np.where(count > 0, np.log10(np.maximum(count, 0) + 1.0), 0.0)
        rare = np.flatnonzero(count < 0)
        last = np.zeros(len(at), bool)
        last[text_first + n_words - 1] = True
        after = np.append(flat(self.begin)[at][1:], np.float32(0.0))[rare]
        columns, names = [pa.array([words[i] for i in rare.tolist()], pa.binary()), pa.array(after)], ["word", "next"]
        for j in range(1, KEY_IDS):
            has = (length[rare] > j) | ((length[rare] == j) & ~last[rare])
            own = first[rare][has] + j
            value = np.zeros(len(rare), np.float32)
            value[has] = network[own]
            logs[own] = 0.0
            columns.append(pa.array(value, mask=~has))
            names.append(f"p{j}")
        offsets = np.searchsorted(rare, np.append(text_first, len(at)))
        rarer = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(columns, names))
        return np.add.reduceat(logs, bounds[:-1]), np.add.reduceat(base, text_first), np.add.reduceat((count > 0).astype(np.int64), text_first), rarer


#: Words of the texts scored together.
BLOCK_WORDS = 40_000

RARE = f"array<struct<word: binary, next: float, {', '.join(f'p{j}: float' for j in range(1, KEY_IDS))}>>"
SCORED = f"row bigint, held_out boolean, n_tokens bigint, score double, base double, known bigint, rare {RARE}"


def _score(model: Model, counts: dict[bytes, int], rank_path: str, pattern: str):
    def blocks(texts: list[str | None]) -> Iterator[tuple[int, list[list[bytes]]]]:
        first, block, size = 0, [], 0
        for k, text in enumerate(texts):
            block.append(words_of(text))
            size += len(block[-1])
            if size > BLOCK_WORDS or k == len(texts) - 1:
                yield first, block
                first, block, size = k + 1, [], 0

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_freed_memory()
        scorer = Scorer(model, counts, Subwords(rank_path, pattern))
        for batch in slices(batches):
            for first, texts in blocks(batch.column("text").to_pylist()):
                if len(scorer.index) > KNOWN_WORDS:
                    scorer.forget()
                scores, base, known, rare = scorer.score(texts)
                own = batch.slice(first, len(texts))
                yield pa.RecordBatch.from_arrays(
                    [
                        *[own.column(c) for c in ("doc_id", "row", "held_out")],
                        pa.array([len(w) for w in texts], pa.int64()), pa.array(scores), pa.array(base), pa.array(known, pa.int64()), rare,
                    ],
                    names=["doc_id", "row", "held_out", "n_tokens", "score", "base", "known", "rare"],
                )

    return score


def _rank_rows(rank: np.ndarray, rank_path: str, pattern: str):
    """The ranks of each training text, packed."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_freed_memory()
        subwords = Subwords(rank_path, pattern)
        known: dict[bytes, bytes] = {}
        for batch in slices(batches):
            texts = [words_of(t) for t in batch.column("text").to_pylist()]
            if len(known) > KNOWN_WORDS:
                known.clear()
            new = list(set(chain.from_iterable(texts)).difference(known))
            ids, lengths = subwords.flat(new)
            codes, ends = rank[ids].astype(np.int16).tobytes(), 2 * np.cumsum(lengths)
            known.update(zip(new, map(codes.__getitem__, map(slice, (ends - 2 * lengths).tolist(), ends.tolist()))))
            packed = [b"".join(map(known.__getitem__, words)) for words in texts]
            yield pa.RecordBatch.from_arrays([batch.column("mark"), pa.array(packed, pa.binary())], names=["mark", "ranks"])

    return encode


def _train_replica(params: attention.Params, start: int, rate: float):
    """Rows (place, total, windows): the replica's parameters times the windows it was trained on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keep_freed_memory()
        own, seen = params, 0
        for batch in batches:
            texts = [np.frombuffer(b, np.int16) for b in batch.column("ranks").to_pylist()]
            if not texts:
                continue
            windows = attention.Windows(np.concatenate(texts).astype(np.int64), np.array([len(t) for t in texts]), start, OVERLAP)
            steps = -(-len(windows) // attention.TRAIN_BATCH)
            own = attention.train(own, windows, rate, min(MOST_PASSES, -(-LEAST_STEPS // steps)))
            seen += len(windows)
        if seen:
            packed = attention.pack(own).astype(np.float64) * seen
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(len(packed), dtype=np.int32)), pa.array(packed), pa.array(np.full(len(packed), seen, np.int64))],
                names=["place", "total", "windows"],
            )

    return run


def fit(rows: DataFrame, rank_path: str, pattern: str) -> tuple[Model, DataFrame, dict[bytes, int], DataFrame]:
    """The model learned from rows(text, mark, held_out) that are not held out, the words of all texts (``remembered``),
    the counts of the most frequent ones, whose beginnings the model has, and the table it was trained on."""
    training = rows.where(~F.col("held_out"))
    counted = rows.select("text", "held_out").mapInArrow(_count_words, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    counts = shared_table(counted, "word-counts")
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.when(F.col("n") > 0, 1))).first()
    keys = counts.where("n > 0").mapInArrow(_count_ids(rank_path, pattern), "kind int, key bigint, n bigint")
    # Ids and first ids: there are END_ID + 1 of either.
    kept = keys.where((F.col("kind") == 0) | F.col("key").between(1, 0xFFFF)).groupBy("kind", "key").agg(F.sum("n").alias("n")).collect()
    ids, begun = ({r["key"]: r["n"] for r in kept if r["kind"] == kind} for kind in (0, 1))
    firsts = np.zeros(END_ID + 1, np.int64)
    firsts[[k - 1 for k in begun]] = list(begun.values())
    words = remembered(counts, firsts, rank_path, pattern)
    drop_tables(counts)
    known = {}
    for r in frequent(words):
        known[bytes(r["word"])] = r["n"]
        begun.update({r[k] % 2**64: r[f"n{j}"] for j, k in enumerate(PATH, 2) if r[k]})
    model = Model(total, distinct, ids, begun)
    texts = shared_table(training.select("mark", "text").mapInArrow(_rank_rows(model.rank, rank_path, pattern), "mark bigint, ranks binary"), "lm-texts")
    replicas = min(MAX_REPLICAS, max(1, texts.count() // len(RATES) // REPLICA_DOCS))
    start = int(model.rank[END_ID])
    for k, rate in enumerate(RATES):
        trained = texts.where(F.pmod("mark", F.lit(len(RATES))) == k).repartition(replicas, "mark").mapInArrow(
            _train_replica(model.params, start, rate), "place int, total double, windows bigint"
        )
        summed = trained.groupBy("place").agg((F.sum("total") / F.sum("windows")).alias("value")).orderBy("place").collect()
        if summed:
            model.params = attention.unpack(np.array([r["value"] for r in summed]), model.params)
    return model, words, known, texts


def frequent(words: DataFrame) -> list[Row]:
    """The rows of the most frequent words of training texts, at most FREQUENT_WORDS."""
    level = F.floor(F.log2("n") * 8)
    words = words.where("n > 0")
    levels = words.groupBy(level.alias("level")).agg(F.count("*").alias("n")).orderBy(F.desc("level")).collect()
    seen, least = 0, None
    for row in levels:
        seen += row["n"]
        if seen > FREQUENT_WORDS:
            break
        least = row["level"]
    if least is None:
        return []
    return words.where(level >= least).collect()


def _path_score() -> Column:
    """Log10 probability of the ids that depend on a rarer word's beginnings (columns of ``remembered`` and RARE)."""
    terms = []
    for j in range(1, KEY_IDS):
        network, here = F.col(f"p{j}").cast("double"), F.col(f"n{j}")
        # At the stop, the share goes to the first ids of words.
        part = F.when(F.col("n_ids") == j, F.col("next").cast("double")).otherwise(1.0) * F.col(f"n{j + 1}") / here
        mixed = F.when(here > 0, MEMORY_SHARE * part + (1.0 - MEMORY_SHARE) * network).otherwise(network)
        terms.append(F.coalesce(F.log10(mixed + 1e-30), F.lit(0.0)))
    return sum(terms[1:], terms[0])


def score_texts(docs: DataFrame, rank_path: str, pattern: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every whole text.

    ``base_score`` is that of word counts with one added to each; ``score`` is the model's. Both are log10 and
    learned only from rows that are not held out. A null text is empty (its only token is the end); a null id
    is not held out; repeated rows stay and count as often as they stand; an empty table gives no rows; other
    columns are not read.
    """
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))
    rows = fields(docs, doc_id=doc_id, text=text).withColumns({"held_out": held, "mark": F.xxhash64("doc_id", "text")})
    model, words, known, trained = fit(rows, rank_path, pattern)
    drop_tables(trained)
    keyed = rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", "held_out", "text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    score = _score(model, known, rank_path, pattern)
    scored = shared_table(keyed.mapInArrow(score, f"doc_id {kind}, {SCORED}"), "lm-scores")
    rare = scored.select("row", F.inline("rare"))
    # Every rarer word is met: its count and the counts of its beginnings, however low.
    met = rare.join(words.drop(*PATH), "word").groupBy("row").agg(
        F.sum(F.log10(F.col("n") + 1)).alias("rare_base"), F.sum((F.col("n") > 0).cast("bigint")).alias("rare_known"),
        F.sum(_path_score()).alias("rare_score"),
    )
    zero = F.lit(0)
    return scored.drop("rare").join(met, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("rare_known", zero)).alias("n_known"),
        F.lit(model.total).cast("bigint").alias("train_tokens"),
        (F.col("base") + F.coalesce("rare_base", F.lit(0.0)) - F.col("n_tokens") * F.lit(math.log10(model.total + model.distinct + 1))).alias("base_score"),
        (F.col("score") + F.coalesce("rare_score", F.lit(0.0))).alias("score"),
    )
