"""Operators over the whole corpus against brute force on small tables, with the edge cases of each."""

from __future__ import annotations

import collections
import hashlib
import zlib
from itertools import combinations

import numpy as np
import pytest
import xxhash

from tidemark.llm import common, decontamination, queries, sentence_spans, sharding, simhash, url_filter

from .conftest import passage, texts_of


def test_splitters_and_ranges(spark):
    rows = spark.range(5000).selectExpr("id", "IF(id < 2500, 'same', CAST(id AS STRING)) AS k")
    key = {"k": rows["k"], "id": rows["id"]}
    cuts = common.splitters(rows, key, common.F.lit(1.0), 5000.0, 16)
    parts = rows.select(common.range_of(key, "k string, id bigint", cuts).alias("p"), "k", "id").collect()
    for r in parts:
        assert r["p"] == sum((c["k"], c["id"]) <= (r["k"], r["id"]) for c in cuts)
    sizes = collections.Counter(r["p"] for r in parts)
    assert len(sizes) == 16 and max(sizes.values()) < 3 * 5000 / 16
    assert common.splitters(rows.where("id < 0"), key, common.F.lit(1.0), 0.0, 16) == []


def test_sharding(edge_docs, no_docs):
    rows = sorted(
        (hashlib.md5((t or "").encode()).hexdigest(), "" if i is None else str(i), -1 if i is None else i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode()))
        for i, t in texts_of(edge_docs)
    )
    total, before, slots, want = sum(r[3] for r in rows), 0, collections.Counter(), []
    for _, _, i, size, crc in rows:
        shard = min(7, (2 * before + size) * 8 // (2 * total))
        want.append((i, size, crc, "bytes", shard, slots[shard], None))
        slots[shard] += 1
        before += size
    got = [tuple(-1 if k == 0 and x is None else x for k, x in enumerate(r)) for r in sharding.assign_shards(edge_docs).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert sharding.assign_shards(no_docs).count() == 0


def test_sharding_splits_overfull_ranges(spark):
    """A third of the rows are copies of one short text, which weighs little but has many rows."""
    docs = spark.range(6000).selectExpr("id AS doc_id", "IF(id % 3 = 0, 'a', repeat(CAST(id AS STRING), 200)) AS text")
    got = sharding.assign_shards(docs).groupBy("shard").agg({"size": "sum", "slot": "max", "doc_id": "count"}).collect()
    sizes = [r["sum(size)"] for r in got]
    assert len(sizes) == 8 and max(sizes) - min(sizes) <= 2 * 1001
    assert all(r["max(slot)"] + 1 == r["count(doc_id)"] for r in got)


def test_sharding_of_rows_that_are_all_equal(spark):
    """Equal rows are cut into ranges like others, so that no task gets them all."""
    docs = spark.range(0, 30_000, 1, 6).selectExpr("CAST(NULL AS BIGINT) AS doc_id", "'one text' AS text")
    rows = common.shared_table(sharding.measured(docs), "sizes-test")
    cuts = common.splitters(rows, sharding._key(), rows["size"], 30_000 * 9.0, 64)
    loads = sharding._loads(rows, cuts)[1]
    assert len(loads) > 50 and max(n for n, _ in loads.values()) < 3 * 30_000 / 64
    got = sharding.assign_shards(docs).groupBy("shard").agg({"slot": "max", "size": "count"}).collect()
    assert sorted((r["shard"], r["count(size)"], r["max(slot)"]) for r in got) == [(k, 3750, 3749) for k in range(8)]


def plain_components(items, linked):
    parent = list(range(len(items)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations(range(len(items)), 2):
        if linked(items[a], items[b]):
            parent[root(a)] = root(b)
    return [root(k) for k in range(len(items))]


def test_simhash_of_a_text():
    hashes = [xxhash.xxh64_intdigest(s, seed=42) for s in (b"a b c", b"b c d", b"c d a")]
    want = sum(1 << k for k in range(64) if sum(h >> k & 1 for h in hashes) * 2 > 3)
    assert simhash.simhash(simhash.shingle_hashes("A b\nC d a", 3)) == want
    assert simhash.simhash(simhash.shingle_hashes(None, 3)) == simhash.simhash(simhash.shingle_hashes(" \t", 3)) == 0
    assert simhash.shingle_hashes("a  b", 3).tolist() == [xxhash.xxh64_intdigest(b"a b", seed=42)]


def test_links_of_small_and_large_lists(spark):
    """Random values, close groups, and a list far above LIST_ROWS: components equal brute force."""
    rng = np.random.default_rng(0)
    values = [int(v) for v in rng.integers(0, 2**63, 40)] + [0, 1, 3, 7, 15, 2**63, 2**64 - 1]
    values += [values[0] ^ (1 << int(b)) for b in rng.integers(0, 64, 10)]
    values += [0xABCDEF0123450000 | int(x) for x in rng.integers(0, 2**16, 150)]  # one list of many
    values = sorted(set(values))
    signed = [(v - 2**64 if v >> 63 else v,) for v in values]
    prints = spark.createDataFrame(signed, "fp bigint")
    found = simhash.links(prints).collect()
    links = {(r["src"] % 2**64, r["dst"] % 2**64) for r in found}
    assert all(bin(a ^ b).count("1") <= 2 for a, b in links)
    want = plain_components(values, lambda a, b: bin(a ^ b).count("1") <= 2)
    got = plain_components(values, lambda a, b: (a, b) in links or (b, a) in links)
    pairs = lambda roots: {(a, b) for a, b in combinations(range(len(roots)), 2) if roots[a] == roots[b]}
    assert pairs(got) == pairs(want)


def test_components(edge_docs, no_docs):
    rows = texts_of(edge_docs)
    prints = [simhash.simhash(simhash.shingle_hashes(t, 3)) for _, t in rows]
    roots = plain_components(prints, lambda a, b: bin(a ^ b).count("1") <= 2)
    least = {}
    for (i, _), r in zip(rows, roots):
        if i is not None:
            least[r] = min(least.get(r, i), i)
    want = sorted((str(i), f"{p:016x}", str(least.get(r))) for (i, _), p, r in zip(rows, prints, roots))
    got = sorted((str(r["doc_id"]), r["fingerprint"], str(r["component_id"])) for r in simhash.components(edge_docs).collect())
    assert got == want
    assert simhash.components(no_docs).count() == 0


def plain_kept(rows):
    """Ids (None last) of the first row of each SimHash component."""
    prints = [simhash.simhash(simhash.shingle_hashes(t, 3)) for _, t in rows]
    roots = plain_components(prints, lambda a, b: bin(a ^ b).count("1") <= 2)
    want = {}
    for (i, _), r in zip(rows, roots):
        want[r] = min(want.get(r, 10**9), 10**9 if i is None else i)
    return sorted(want.values())


def test_keep_one(spark, edge_docs, no_docs):
    """Other columns stay, whatever they are called; of repeated rows one stays."""
    table = edge_docs.withColumns({c: common.F.lit(c) for c in ("id", "kept_id", "kept_mark", "n", "fp", "component")}).withColumnRenamed("source", "row_")
    kept = simhash.keep_one(table)
    assert kept.columns == table.columns
    assert sorted(10**9 if r["doc_id"] is None else r["doc_id"] for r in kept.collect()) == plain_kept(texts_of(edge_docs))
    assert kept.where("kept_id <> 'kept_id' OR mark <> 'm'").count() == 0
    assert simhash.keep_one(no_docs).count() == 0


def test_keep_one_in_a_large_group(spark):
    """Hundreds of long texts that differ in one word, exact copies, and texts of their own."""
    base, rows = passage(31, 400).split(" "), []
    for k in range(300):
        words = list(base)
        words[k + 5] = f"new{k}"
        rows.append((k, " ".join(words)))
    rows += [(1000 + k, passage(40 + k, 120)) for k in range(20)] + [(2000 + k, passage(45, 120)) for k in range(80)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    assert sorted(r["doc_id"] for r in simhash.keep_one(docs).collect()) == plain_kept(rows)


def plain_spans(rows):
    seen, gone = {}, collections.defaultdict(set)
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0))
    for k in order:
        parts = sentence_spans.sentences(rows[k][1] or "")
        for a, b in sentence_spans.runs([len(w) for _, _, w in parts]):
            key = tuple(" ".join(w).lower() for _, _, w in parts[a : b + 1])
            first = seen.setdefault(key, (rows[k], a))
            if first != (rows[k], a):
                gone[k].update(range(a, b + 1))
    return gone


def test_sentence_spans(edge_docs, no_docs):
    rows = texts_of(edge_docs)
    gone = plain_spans(rows)
    want = []
    for k, (i, t) in enumerate(rows):
        parts = sentence_spans.sentences(t or "")
        text = None if t is None else "".join(t[a:b] for j, (a, b, _) in enumerate(parts) if j not in gone[k])
        want.append((str(i), text, len(parts), len(gone[k])))
    cleaned = sentence_spans.remove_repeats(edge_docs)
    assert cleaned.columns == [*edge_docs.columns, "n_sentences", "n_removed"]
    got = [(str(r["doc_id"]), r["text"], r["n_sentences"], r["n_removed"]) for r in cleaned.collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    shared = dict((r[0], r) for r in got)
    assert shared["14"][3] == 0 and shared["15"][3] > 0 and passage(5, 70).split()[20] not in shared["15"][1].split()[40:]
    assert sentence_spans.remove_repeats(no_docs).count() == 0


def test_sentences_cover_the_text():
    for text in ("", " ", "A b. C d!\n\nE f? g", "no end " * 50, "\nx. \n", "a.b c.d ."):
        parts = sentence_spans.sentences(text)
        assert not parts or "".join(text[a:b] for a, b, _ in parts).strip() == text.strip()
        assert [w for _, _, ws in parts for w in ws] == text.split()


@pytest.mark.parametrize("length", [0, 5, 15, 16, 28, "mixed"])
def test_a_passage_of_51_words_is_found_at_any_offset(length):
    """Between other words, in sentences of so many words (0: without end marks), it has a run in common in both texts."""
    rng = np.random.default_rng(3)

    def text(passage, before):
        own = [f"o{x}" for x in rng.integers(0, 10**9, before)] + passage + [f"o{x}" for x in rng.integers(0, 10**9, 40)]
        return " ".join(own)

    for _ in range(150):
        ends = rng.integers(1, 30) if length == "mixed" else length
        passage = [f"p{x}" for x in rng.integers(0, 10**9, 51)]
        if ends:
            for k in range(int(rng.integers(0, ends)), 51, ends):
                passage[k] += "."
        spans = [{d for _, _, d in sentence_spans.span_hashes(text(passage, int(rng.integers(0, 60))))} for _ in range(2)]
        assert spans[0] & spans[1]


def test_runs_reach_both_ends():
    for sizes in ([1, 1, 1, 30], [16] * 6, [5] * 20, [1] * 30, [30, 1, 1, 1], [2, 2], []):
        found = sentence_spans.runs(sizes)
        covered = {k for a, b in found for k in range(a, b + 1)}
        total = sum(sizes) >= sentence_spans.RUN_WORDS and len(sizes) >= sentence_spans.RUN_SENTENCES
        assert covered == (set(range(len(sizes))) if total else set())
        assert all(b - a + 1 >= sentence_spans.RUN_SENTENCES and sum(sizes[a : b + 1]) >= sentence_spans.RUN_WORDS for a, b in found)


def test_masks_find_every_window_with_two_replaced():
    first = decontamination.MASKS[0]
    for lost in combinations(range(decontamination.WINDOW), 2):
        assert any(not {s + o for o in first} & set(lost) for s in range(decontamination.WINDOW - decontamination.SPAN + 1))
    assert all(max(m) < decontamination.SPAN for m in decontamination.MASKS)


def test_decontamination(spark, edge_docs, no_docs):
    item, other = passage(50, 40).replace(".", ""), passage(51, 30).replace(".", "")
    words = item.split()
    two, four = list(words), list(words)
    for k in (3, 9, 19, 25, 35):
        two[k] = f"sub{k}"
    for k in range(0, 40, 3):
        four[k] = f"sub{k}"
    docs = [
        (100, "start " + item.upper() + " end"), (101, passage(60, 20) + " " + " ".join(two) + " x"), (102, " ".join(four)), (103, item[: len(item) // 4]),
        (104, "a " + " ".join(words[10:27]) + " b"), (105, other + " and " + item), (106, " ".join(words[10:23])),
    ]
    table = edge_docs.unionByName(spark.createDataFrame(docs, "doc_id bigint, text string"), allowMissingColumns=True)
    bench = spark.createDataFrame([(1, item, "x"), (2, other, "y"), (3, None, None), (4, "too short", ""), (1, item, "x")], "item_id bigint, text string, mark string")
    got = {r["doc_id"]: (r["contaminated"], r["item_ids"]) for r in decontamination.report(table, bench).collect()}
    assert {i: v[1] for i, v in got.items() if v[0]} == {100: [1], 101: [1], 104: [1], 105: [1, 2]}
    kept = decontamination.drop_contaminated(table, bench)
    assert kept.columns == table.columns and kept.count() == table.count() - 4
    assert decontamination.report(no_docs, bench).count() == 0
    assert decontamination.report(table, bench.where("item_id < 0")).where("contaminated").count() == 0


def plain_overlaps(docs, items):
    """{id: {item: overlap}} by laying every item at every place of every document."""
    import re

    def tokens(text):
        return [t for t in re.split(r"[^a-z0-9]+", (text or "").lower()) if t]

    found = {}
    for i, text in docs:
        words, mine = tokens(text), {}
        for k, item in items:
            wanted = tokens(item)
            if len(wanted) < 4:
                if wanted and wanted == words:
                    mine[k] = len(wanted)
                continue
            width = min(16, len(wanted))
            for shift in range(-len(wanted), len(words)):
                equal = [0 <= j + shift < len(words) and words[j + shift] == w for j, w in enumerate(wanted)]
                best = max(sum(equal[j : j + width]) for j in range(len(wanted) - width + 1))
                if best >= -(-width * 7 // 8):
                    mine[k] = max(mine.get(k, 0), best)
        found[i] = mine
    return found


def test_decontamination_equals_brute_force(spark):
    """Items of all lengths, copied with replaced tokens at random places, among texts of the same words."""
    rng = np.random.default_rng(12)
    words = [f"w{k}" for k in range(400)]
    items = [(k, " ".join(rng.choice(words, n))) for k, n in enumerate([1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15, 16, 17, 20, 30, 45])]
    docs = []
    for i in range(300):
        text = list(rng.choice(words, int(rng.integers(0, 40))))
        copy = items[int(rng.integers(0, len(items)))][1].split()
        for p in rng.choice(len(copy), min(len(copy), int(rng.integers(0, 4))), replace=False):
            copy[p] = "other"
        docs.append((i, " ".join(text + copy + list(rng.choice(words, int(rng.integers(0, 9)))))))
    docs += [(1000 + k, ("- " if k % 2 else "") + item.upper()) for k, item in items] + [(2000, None), (2001, "")]
    got = decontamination.report(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame([*items, (90, None), (91, "!")], "item_id bigint, text string"))
    want = plain_overlaps(docs, items)
    for r in got.collect():
        mine = want[r["doc_id"]]
        assert (r["contaminated"], r["item_ids"], r["overlap"]) == (bool(mine), sorted(mine) if mine else None, max(mine.values(), default=0)), r
    assert sum(map(bool, want.values())) > 150


def test_columns_of_any_name(spark, edge_docs):
    """Columns called like those the operators use inside stay as they are."""
    names = ("row", "mark_", "hit_mark", "hit_mark_", "hit_id", "gone", "gone_id", "gone_mark", "total", "firsts", "lasts", "id", "n", "low", "tag", "place")
    table = edge_docs.drop("row", "n").withColumns({c: common.F.lit(c) for c in names})
    bench = spark.createDataFrame([(1, passage(3, 90))], "item_id bigint, text string")
    for made in (simhash.keep_one(table), decontamination.drop_contaminated(table, bench), sentence_spans.remove_repeats(table)):
        assert [c for c in made.columns if c not in ("n_sentences", "n_removed")] == table.columns
        assert made.count() and not made.where(" OR ".join(f"`{c}` <> '{c}'" for c in names)).count()


def test_shuffled_benchmark_gives_the_same(spark, monkeypatch):
    sf = "/root/testdata/sf0.001"
    small = sorted(map(str, queries.QUERIES["op9_decontamination"](spark, sf).collect()))
    monkeypatch.setattr(decontamination, "BROADCAST_ROWS", 0)
    assert sorted(map(str, queries.QUERIES["op9_decontamination"](spark, sf).collect())) == small
    assert sum("contaminated=True" in r for r in small) > 0


def test_url_rules(spark):
    pages = [
        (1, "http://Sub.Example.NET/en/x?y"), (2, "https://example.net/en"), (3, "http://a.example.com/de/"), (4, "ftp://x.org/fr/1#z"), (5, None), (6, ""),
        (7, "no scheme"), (8, "http://example.net"), (9, "http://net/?q"), (10, "http://badexample.net/en/"), (11, "http://" + "a." * 3000 + "net/p"), (12, "x://y://z.net/"),
        (13, "http://q.example.net/en/deep/er"), (13, "http://q.example.net/en/deep/er"), (None, "http://example.net/en/deep"), (14, "http://example.com?/de/"),
    ]
    rules = [*queries.URL_RULES, ("example.net", "/en/deep", "block"), ("example.net", "/en/deep", "allow"), (None, "/", "block"), ("", "/", "block"), ("q.example.net", "", "allow")]
    page_table = spark.createDataFrame([(i, u, "h", 1) for i, u in pages], "page_id bigint, url string, host string, row int")
    rule_table = spark.createDataFrame(rules, "host string, path string, verdict string")
    best = {}
    for h, p, v in rules:
        if h:
            best[h, p] = max(v, best.get((h, p), ""))
    want = []
    for i, u in pages:
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        cut = min((rest.find(c) for c in "/?#" if c in rest), default=len(rest))
        host = "".join(c.lower() if c.isascii() else c for c in rest[:cut])
        path = rest[cut:].split("?")[0].split("#")[0]
        fits = [(len(h + p), h + p, v) for (h, p), v in best.items() if (host == h or host.endswith("." + h)) and path.startswith(p)]
        _, rule, verdict = max(fits, default=(0, None, "allow"))
        want.append((i, host, path, rule, verdict))
    got = [tuple(r) for r in url_filter.judge_urls(page_table, rule_table).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert url_filter.judge_urls(page_table.where("page_id > 99"), rule_table).count() == 0
    assert {r["verdict"] for r in url_filter.judge_urls(page_table, rule_table.where("host = 'zz'")).collect()} == {"allow"}


@pytest.mark.parametrize("ranges", [64, 700])
def test_url_sweep_in_many_ranges(spark, monkeypatch, ranges):
    monkeypatch.setattr(url_filter, "n_ranges", lambda n: ranges)
    sf = "/root/testdata/sf0.01"
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{sf}/pages.parquet'")
    want = sorted(map(str, con.execute(queries.OP7_SQL).fetchall()))
    assert sorted(str(tuple(r)) for r in queries.QUERIES["op7_url_rules"](spark, sf).collect()) == want


def test_span_tasks_get_few_texts_at_once(spark, monkeypatch):
    """Spans are made of small batches of texts; the session's own setting is as before afterwards."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before, seen, share = spark.conf.get(key), {}, sentence_spans.shared_table
    monkeypatch.setattr(sentence_spans, "shared_table", lambda df, name: (seen.update({name: int(spark.conf.get(key))}), share(df, name))[1])
    docs = spark.createDataFrame([(1, "One short sentence here. And one more."), (2, None)], "doc_id long, text string")
    assert sentence_spans.remove_repeats(docs).count() == 2
    assert seen["spans"] <= 1024 and spark.conf.get(key) == before
    assert seen["repeats"] == int(before)
