"""Per-text operators against the libraries they must agree with, and plain versions of themselves."""

from __future__ import annotations

import base64
import collections
import hashlib
import os
import pathlib
import random
import subprocess
import sys
import tracemalloc
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from tokenizers import Tokenizer

from tidemark.llm import attention, byte_bpe, lm_scoring, quality, queries, token_counts, winnowing

from .conftest import texts_of

RANKS, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
WORDS_FILE = public_tokenizers.path("word_bpe_49k.json")
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tik():
    with open(RANKS, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def random_texts(n: int):
    rng = random.Random(4)
    parts = ["a", "ab", "é", "the", "<|endoftext|>", " ", "  ", "\n", "\t", "\x1c", "\x85", "12", "$", "!!", "日本", "😀", "'s", "'ll", "A", "\u0301", "Σ", "İ", "tion"]
    for k in range(n):
        yield "".join(rng.choice(parts) for _ in range(rng.randint(0, 50)))
        if k % 25 == 0:
            yield rng.choice(["a", "ab", "abc ", "$", "é", "th"]) * rng.randint(50, 400)
            yield "".join(rng.choice("etaoinshrdl") for _ in range(rng.randint(100, 800)))


def test_bpe_tree_equals_the_library(tik):
    bpe = byte_bpe.load(RANKS, PATTERN)
    for text in random_texts(500):
        want = np.array(tik.encode_ordinary(text), "<u4").tobytes()
        assert bpe.encode(text) == want, text[:80]
        assert bpe.decode(want) == text.encode()


def test_bpe_join_is_the_encoding_of_the_whole():
    bpe = byte_bpe.load(RANKS, PATTERN)
    rng = random.Random(2)
    for _ in range(300):
        whole = "".join(rng.choice("thenationsr") for _ in range(rng.randint(0, 90))).encode()
        cut = rng.randint(0, len(whole))
        assert bpe.join(bpe.merge(whole[:cut]), bpe.merge(whole[cut:])) == bpe.merge(whole)
        assert bpe._merge_long(whole) == bpe.merge(whole)


def test_token_digests(edge_docs, no_docs, tik):
    got = sorted((r["doc_id"] or -1, r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in byte_bpe.token_digests(edge_docs, RANKS, PATTERN).collect())
    want = []
    for i, t in texts_of(edge_docs):
        ids = tik.encode_ordinary(t or "")
        want.append((i or -1, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(want)
    coded = byte_bpe.encode_texts(edge_docs, RANKS, PATTERN)
    assert coded.columns == [*[c for c in edge_docs.columns if c != "n_tokens"], "ids", "n_tokens"]
    assert byte_bpe.token_digests(no_docs, RANKS, PATTERN).count() == 0


def test_token_counts_and_cache(spark, edge_docs, no_docs, tmp_path):
    library = Tokenizer.from_file(WORDS_FILE)
    want = sorted((i or -1, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False))) for i, t in texts_of(edge_docs))
    cache = str(tmp_path / "cache")

    def counted():
        rows = token_counts.count_tokens(edge_docs, WORDS_FILE, cache, limit=50).collect()
        assert all(r["over_limit"] == (r["n_tokens"] > 50) for r in rows)
        return sorted((r["doc_id"] or -1, r["n_bytes"], r["n_tokens"]) for r in rows)

    assert counted() == want
    stored = spark.read.parquet(cache).count()
    assert counted() == want and spark.read.parquet(cache).count() == stored  # nothing is encoded twice
    assert token_counts.count_tokens(no_docs, WORDS_FILE).count() == 0


def test_equal_rows_are_encoded_once(spark, tmp_path):
    """A third of all rows are one text without an id; the cache gets a row for each distinct content."""
    rows = [(None, "one and the same  text")] * 500 + [(i, f"text {i % 40}") for i in range(1000)]
    cache = str(tmp_path / "cache")
    counted = token_counts.count_tokens(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(7), WORDS_FILE, cache)
    assert counted.count() == 1500 and spark.read.parquet(cache).count() == 41


def test_word_counts_add_up():
    library, words = Tokenizer.from_file(WORDS_FILE), token_counts.WordCounts(WORDS_FILE)
    for text in random_texts(300):
        assert words.count([text.encode()]) == [len(library.encode(text, add_special_tokens=False))], text[:80]


def plain_winnow(text: str, hash_of):
    """(position, gram) that the rule keeps, by the definition."""
    words = text.lower().split()
    grams = [tuple(words[i : i + winnowing.GRAM]) for i in range(max(1, len(words) - winnowing.GRAM + 1))] if words else []
    kept = []
    for s in range(max(1, len(grams) - winnowing.WINDOW_GRAMS + 1)) if grams else ():
        window = range(s, min(len(grams), s + winnowing.WINDOW_GRAMS))
        at = min(window, key=lambda i: (hash_of(i), -i))
        if at not in kept:
            kept.append(at)
    return kept


def test_winnowing(edge_docs, no_docs):
    rows = winnowing.with_fingerprint(edge_docs.select("doc_id", "text"), "text", "kept")
    rows = rows.withColumn("grams", winnowing.word_hashes(rows["text"]))
    rows = rows.withColumn("grams", winnowing.gram_values(rows["grams"]))
    for r in rows.collect():
        positions = [winnowing.LAST_POSITION - (v & winnowing.LAST_POSITION) for v in r["kept"]]
        if (r["text"] or "").isascii():
            assert positions == plain_winnow(r["text"] or "", lambda i: r["grams"][i] >> winnowing.POSITION_BITS)


def test_edit_report(edge_docs, no_docs):
    docs = edge_docs.where("doc_id IS NOT NULL AND doc_id <> 11")
    got = {r["doc_id"]: r for r in winnowing.edit_report(docs).collect()}
    ordered = sorted(((i, t or "") for i, t in texts_of(docs)), reverse=True)
    for k, (i, t) in enumerate(ordered):
        after = ordered[(k + 1) % len(ordered)][1]
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        assert got[i]["n_chars"] == len(t) and got[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        a, b = ({p.split(":")[1] for p in got[i][c].split()} for c in ("fingerprint", "edited_fingerprint"))
        assert got[i]["near_edited"] == pytest.approx(len(a & b) / len(a | b) if a | b else 1.0)
    assert got[1]["fingerprint"] == got[2]["fingerprint"] and got[4]["fingerprint"] == got[5]["fingerprint"] == ""
    assert winnowing.edit_report(edge_docs).count() == edge_docs.count()
    assert winnowing.edit_report(no_docs).count() == 0


def test_quality(spark, edge_docs, no_docs):
    rows = queries.QUERIES["op10_quality"](spark, SF).collect()
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in rows)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    sf = "/root/testdata/sf0.01"
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    test = [(r["predicted"], labels[r["doc_id"]]) for r in queries.QUERIES["op10_quality"](spark, sf).collect() if r["held_out"] and r["doc_id"] in labels]
    good = [p for p, y in test if y == 1]
    assert sum(p == y for p, y in test) / len(test) > 0.93 and sum(good) / len(good) > 0.97
    none = spark.createDataFrame([(1, None), (None, 1)], "doc_id bigint, quality int")
    kept = quality.keep_good(edge_docs, none)
    assert kept.columns == edge_docs.columns and kept.count() == edge_docs.count()
    some = spark.createDataFrame([(1, 1), (2, 1), (13, 0), (8, 0)], "doc_id bigint, quality int")
    scored = quality.score_quality(edge_docs, quality.fit_quality(edge_docs, some, folds=1000))
    assert scored.count() == edge_docs.count() and scored.columns == [c for c in edge_docs.columns if c != "score"] + ["score"]
    assert quality.keep_good(no_docs, some).count() == 0


def test_quality_equals_its_definition(spark):
    """Weights are the optimum over all pairs, the threshold the best of all cuts, and the query's scores follow from them."""
    import math

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    model = quality.fit_quality(docs, labels)
    known = docs.join(labels.where("quality IS NOT NULL").select("doc_id", "quality"), "doc_id").selectExpr("*", "xxhash64(doc_id) AS key").collect()
    rows = sorted((r["key"], quality.features(r["text"]).tolist(), r["quality"]) for r in known if zlib.crc32(str(r["doc_id"]).encode()) % 5 != 0)
    x = (np.array([r[1] for r in rows]) - model.mean) / model.scale
    y = [r[2] for r in rows]
    good, bad = [i for i, v in enumerate(y) if v == 1], [i for i, v in enumerate(y) if v == 0]
    rare, other = (bad, good) if len(bad) <= len(good) else (good, bad)
    n = max(quality.PAIRS_PER_ROW, -(-len(other) // len(rare)))
    partners = np.resize(np.random.default_rng(11).permutation(other), n * len(rare))
    gradient, pairs = quality.RIDGE * model.weights, n * len(rare)
    for k, b in enumerate(partners):
        winner, loser = (b, rare[k // n]) if rare is bad else (rare[k // n], b)
        d = x[winner] - x[loser]
        gradient = gradient - d / (1 + math.exp(float(d @ model.weights))) / pairs
    assert np.abs(gradient).max() < 1e-6
    raw = x @ model.weights

    def gain(cut):
        return sum(raw[i] < cut for i in bad) / len(bad) - sum(raw[i] < cut for i in good) / len(good)

    cuts = sorted(set(raw))
    assert gain(model.threshold) == pytest.approx(max(gain(c) for c in [*cuts, cuts[-1] + 1]))
    shift = math.log(quality.CUT / (1 - quality.CUT)) - model.threshold
    texts = dict(texts_of(docs))
    for r in queries.QUERIES["op10_quality"](spark, sf).collect():
        z = float(((quality.features(texts[r["doc_id"]]) - model.mean) / model.scale) @ model.weights) + shift
        assert r["score"] == pytest.approx(1 / (1 + math.exp(-z)), abs=1e-9)


def test_attention_gradients_and_mask():
    rng = np.random.default_rng(1)
    params = attention.initial(rng.integers(0, 50, attention.RANKS + 1).astype(float))
    params = {k: v.astype(np.float64) for k, v in params.items()}
    ids = rng.integers(0, attention.RANKS + 1, 60)
    windows = attention.Windows(ids, np.array([40, 1, 19]), 3, 3)
    before, after, used, place = windows.part(0, len(windows))
    assert sorted(place[used]) == list(range(60))  # each id once
    assert (after[used] == ids[place[used]]).all()

    def loss():
        states = attention.attend(params, before)[0]
        return -attention.log_probs(params, states[used], after[used]).mean()

    grads = attention.gradients(params, before, after, used)
    for name, g in grads.items():
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        old = params[name][at]
        params[name][at] = old + 1e-4
        up = loss()
        params[name][at] = old - 1e-4
        down = loss()
        params[name][at] = old
        assert (up - down) / 2e-4 == pytest.approx(g[at], rel=0.05, abs=1e-5), name
    changed = before.copy()
    changed[:, 9:] = 7
    same = attention.attend(params, before)[0][:, :9] - attention.attend(params, changed)[0][:, :9]
    assert np.abs(same).max() < 1e-9


def test_scoring_holds_little():
    """Windows are scored in pieces that fit a cache, whatever their number, with the same results as all at once."""
    rng = np.random.default_rng(2)
    params = attention.initial(rng.integers(0, 50, attention.RANKS + 1).astype(float))
    ids = rng.integers(0, attention.RANKS + 1, 60_000)
    windows = attention.Windows(ids, np.array([25_000, 0, 1, 34_999]), 3, 3)
    tracemalloc.start()
    got = attention.score_windows(params, windows)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 6e6
    before, after, used, place = windows.part(0, len(windows))
    want = np.zeros(len(ids), np.float32)
    want[place[used]] = attention.log_probs(params, attention.attend(params, before)[0][used], after[used])
    assert got == pytest.approx(want, abs=1e-4)


def test_tasks_keep_freed_memory():
    """In a new process, scoring a block of texts does not ask the system for the same memory again and again."""
    code = """
import resource
import numpy as np
from tidemark.llm import attention, common
common.keep_freed_memory()
params = attention.initial(np.ones(attention.RANKS + 1))
windows = attention.Windows(np.arange(60_000) % attention.RANKS, np.full(60, 1000), 3, 3)
attention.score_windows(params, windows)
before = resource.getrusage(resource.RUSAGE_SELF).ru_minflt
attention.score_windows(params, windows)
print(resource.getrusage(resource.RUSAGE_SELF).ru_minflt - before)
"""
    root = pathlib.Path(lm_scoring.__file__).parents[2]
    ran = subprocess.run([sys.executable, "-c", code], cwd=root, env=os.environ | {"OMP_NUM_THREADS": "1"}, capture_output=True, text=True, check=True)
    assert int(ran.stdout) < 1000


def test_words_are_encoded_together():
    """One call for many words gives each word's own ids, also with spaces that only Unicode knows and with the end."""
    subwords = lm_scoring.Subwords(RANKS, PATTERN)
    words = [f"word{i}'s" for i in range(3000)] + ["don't", "\u65e5\u672c", "x\u0301!!", "'ll", "\x00"]
    odd = ["\u00a0", "a\u3000b", "c\u00a0", "\u0085\u0085d", "", "\x1c", "e\u2028"]
    rng = np.random.default_rng(3)
    for own in (words, words + odd, [*odd, *words[:5], *odd[::-1]], [""], ["", "a"], [], [words[i] for i in rng.integers(0, len(words), 50)]):
        own = [w.encode() for w in own]
        ids, lengths = subwords.flat(own)
        assert [n for n in lengths] == [len(subwords.ids(w)) for w in own]
        assert list(ids) == [i for w in own for i in subwords.ids(w)]
    calls = []

    class Counted:
        def encode_ordinary(self, text, encode=subwords.encoding.encode_ordinary):
            calls.append(text)
            return encode(text)

    subwords.encoding = Counted()
    subwords.flat([w.encode() for w in words])
    assert len(calls) == 1


def test_lm_probabilities_add_up():
    """Over all ids that can follow, the mixed probabilities sum to one."""
    words = {b"the": 50, b"then": 30, b"on": 40, b"nation": 9, b"thewordislong": 3, lm_scoring.END_WORD: 10}
    subwords = lm_scoring.Subwords(RANKS, PATTERN)
    ids, begun = collections.Counter(), collections.Counter()
    for batch in lm_scoring._count_ids(RANKS, PATTERN)(iter([_batch(words)])):
        for kind, key, n in zip(*[batch.column(c).to_pylist() for c in ("kind", "key", "n")]):
            (begun if kind else ids)[key % 2**64] += n
    plain_ids, plain = collections.Counter(), collections.Counter()
    for word, n in words.items():
        own = subwords.ids(word)
        for i in own:
            plain_ids[i] += n
        coded = [*[i + 1 for i in own], lm_scoring.STOP]
        for k in range(1, min(len(coded), lm_scoring.KEY_IDS) + 1):
            plain[sum(c << 16 * j for j, c in enumerate(coded[:k]))] += n
    assert ids == plain_ids and begun == plain
    total = sum(words.values())
    model = lm_scoring.Model(total, len(words), ids, begun)
    for word in words:
        own = subwords.ids(word)
        shares, rests, stop, stop_rest, begin = model.memory(np.array(own), np.array([len(own)]))
        prefix = 0
        for j, i in enumerate(own[: lm_scoring.KEY_IDS - 1]):
            prefix |= (i + 1) << 16 * j
            after = {k: n for k, n in begun.items() if k > prefix and k & ((1 << 16 * (j + 1)) - 1) == prefix and k >> 16 * (j + 2) == 0}
            left = 1 - lm_scoring.MEMORY_SHARE * sum(after.values()) / begun[prefix]
            assert (rests[j + 1] if j + 1 < len(own) else stop_rest[0]) == pytest.approx(left)
            following = (own[j + 1] + 1 if j + 1 < len(own) else lm_scoring.STOP) << 16 * (j + 1)
            assert (shares[j + 1] if j + 1 < len(own) else stop[0]) == pytest.approx(lm_scoring.MEMORY_SHARE * begun[prefix | following] / begun[prefix])
        assert begin[0] == pytest.approx(begun[own[0] + 1] / total)
    assert sum(n for k, n in begun.items() if k < 2**16) == total
    other = np.exp(model.in_rest)[model.rank == attention.RANKS].sum()
    assert other == pytest.approx(1.0, abs=1e-3)


def _batch(words):
    import pyarrow as pa

    return pa.RecordBatch.from_arrays([pa.array(list(words), pa.binary()), pa.array(list(words.values()), pa.int64())], names=["word", "n"])


def test_lm_scores(edge_docs, no_docs):
    from collections import Counter
    from math import log10

    got = {(r["doc_id"], round(r["base_score"], 6)): r for r in lm_scoring.score_texts(edge_docs, RANKS, PATTERN).collect()}
    texts = [(i, (t or "").encode().lower().split() + [b""]) for i, t in texts_of(edge_docs)]
    held = {i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in texts}
    counts = Counter(w for i, words in texts if not held[i] for w in words)
    n, v = sum(counts.values()), len(counts)
    for i, words in texts:
        base = sum(log10((counts[w] + 1) / (n + v + 1)) for w in words)
        row = got[i, round(base, 6)]
        assert (row["held_out"], row["n_tokens"], row["n_known"], row["train_tokens"]) == (held[i], len(words), sum(counts[w] > 0 for w in words), n)
        assert row["score"] < 0
    assert lm_scoring.score_texts(no_docs, RANKS, PATTERN).count() == 0


def test_training_reads_every_training_document(spark, monkeypatch):
    """The rounds together go through all rows that are not held out, each once."""
    rows = spark.range(60).selectExpr("concat('one more text of words ', id) AS text", "xxhash64(id) AS mark", "id % 7 = 2 AS held_out")
    tables, share, seen = {}, lm_scoring.shared_table, []
    monkeypatch.setattr(lm_scoring, "shared_table", lambda df, name: tables.setdefault(name, share(df, name)))
    train = lm_scoring._train_replica

    def spied(*args):
        run = train(*args)

        def noted(batches):
            kept = [b for b in batches]
            yield from run(iter(kept))
            rows = sum(b.num_rows for b in kept)
            if rows:
                columns = [[-1], [float(rows)], [1]]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int32(), pa.float64(), pa.int64()))], names=["place", "total", "windows"])

        return noted

    def unpack(row, like, own=attention.unpack):
        seen.append(row[0])
        return own(row[1:], like)

    monkeypatch.setattr(lm_scoring, "_train_replica", spied)
    monkeypatch.setattr(attention, "unpack", unpack)
    lm_scoring.fit(rows, RANKS, PATTERN)
    want = sorted(r["mark"] for r in rows.where("NOT held_out").collect())
    assert sorted(r["mark"] for r in tables["lm-texts"].collect()) == want
    assert sum(seen) == len(want)


def test_rare_beginnings_count(spark, monkeypatch):
    """Beginnings seen once give the same scores as frequent ones, whether they are sent to the tasks or joined."""
    texts = ["the nation nationally zyxwvut Quokkaville thewordislong x", "the the on nation zyxwvuts unseenword thewordislonger y zyxwvut", None, "zyxwvut the"]
    held = [zlib.crc32(str(i).encode()) % 7 == 2 for i in range(24)]
    words = [lm_scoring.words_of(texts[i % 4]) for i in range(24)]
    words[3] = lm_scoring.words_of(f"{texts[3]} seenonce Quokkavillage")
    docs = spark.createDataFrame([(i, b" ".join(w).decode()) for i, w in enumerate(words)], "doc_id long, text string")
    assert any(held) and not held[3]
    counts = collections.Counter({w: 0 for own in words for w in own})
    counts.update(w for own, h in zip(words, held) if not h for w in own)
    ids, begun = collections.Counter(), collections.Counter()
    for batch in lm_scoring._count_ids(RANKS, PATTERN)(iter([_batch(counts)])):
        for kind, key, n in zip(*[batch.column(c).to_pylist() for c in ("kind", "key", "n")]):
            (begun if kind else ids)[key % 2**64] += n
    model = lm_scoring.Model(sum(counts.values()), sum(n > 0 for n in counts.values()), {i: n for i, n in ids.items() if n}, begun)
    want = lm_scoring.Scorer(model, dict(counts), lm_scoring.Subwords(RANKS, PATTERN)).score(words)[0]
    monkeypatch.setattr(lm_scoring, "RATES", (0.0,))
    for frequent in (0, 5, 150_000):
        monkeypatch.setattr(lm_scoring, "FREQUENT_WORDS", frequent)
        got = {r["doc_id"]: r["score"] for r in lm_scoring.score_texts(docs, RANKS, PATTERN).collect()}
        assert [got[i] for i in range(24)] == pytest.approx(list(want), abs=1e-4), frequent
