"""Phrase collocations, line de-duplication and lexical search against plain readings of their rules."""

import hashlib
import math
import re
import string
from collections import Counter, defaultdict

import numpy as np
import pytest
from odd import SCHEMA, odd_rows, prose
from pyspark.sql import functions as F

from lumenflow.llm import collocations, lexical, line_dedup

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
BLANK = " \t\n\x0b\x0c\r"


# lines ----------------------------------------------------------------------------------------


def plain_lines(rows, least=10):
    first = {}
    keyed = []
    for doc, text in rows:
        lines = [(x, x.strip(BLANK).translate(LOWER)) for x in (text or "").split("\n")]
        keyed.append((doc, lines))
        for _, key in lines:
            if len(key) >= least and doc is not None:
                first[key] = min(first.get(key, doc), doc)
    out = Counter()
    for doc, lines in keyed:
        gone = [k in first and (doc is None or doc > first[k]) for _, k in lines]
        left = "\n".join(x for (x, _), g in zip(lines, gone) if not g)
        out[doc, len(lines), sum(gone), hashlib.sha256(left.encode()).hexdigest()] += 1
    return out


def line_result(docs):
    got = line_dedup.with_lines(docs).select("row.doc_id", "n_lines", "n_dropped", F.sha2("kept", 256))
    return Counter(tuple(r) for r in got.collect())


def line_rows():
    common = "A line that is EVERYWHERE"
    rows = [(k, f"{common}\nown line number {k % 37} here \n\n{'é' * (k % 12)}\n  {common.lower()}\t\nshort {k % 3}") for k in range(300)]
    rows += [(7, "a line that is everywhere\nown line number 9 here"), (7, None), (None, common), (None, common), (None, "only null holds this line")]
    rows += [(900, "x" * 100_000 + "\n" + common), (-5, "own line number 36 here\r"), (901, "\n".join([common] * 5000)), (902, "")]
    return rows + rows[40:45]


def test_lines_against_plain_reading(spark):
    rows = line_rows()
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:  # eight range partitions: the common key lies over several of them
        assert line_result(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)) == plain_lines(rows)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_lines_of_documents(documents):
    rows = [(r.doc_id, r.text) for r in documents.select("doc_id", "text").collect()]
    assert line_result(documents) == plain_lines(rows)


def test_first_key_of_a_partition_waits_for_edges(spark):
    """Rows of one key cut into single-row partitions: only the edges know where it began."""
    rows = [(1, 2, False, d, 0, d % 2) for d in range(6)] + [(1, 3, False, 9, 0, 0)]
    keyed = spark.createDataFrame(rows, "high long, low long, none boolean, doc long, digest long, at int")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = line_dedup.dropped_lines(keyed)
        assert sorted(r.doc for r in got.collect()) == [1, 2, 3, 4, 5]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_bitmaps_round_trip():
    rng = np.random.default_rng(3)
    for lines in (1, 7, 8, 9, 1000):
        gone = np.flatnonzero(rng.random(lines) < 0.3)
        if len(gone):
            kept = line_dedup.kept_bits(line_dedup.pack_bits(rng.permutation(gone)), lines)
            assert np.flatnonzero(~kept).tolist() == gone.tolist()
    assert line_dedup.kept_bits(None, 4).all()


def test_lines_odd_rows(odd, empty, spark):
    got = line_dedup.dedup_lines(odd)
    assert got.columns == odd.columns and got.count() == odd.count()
    assert got.filter("row <> 'r'").count() == 0
    assert got.filter("text is null").count() == odd.filter("text is null").count()
    assert line_result(odd) == plain_lines([(r[0], r[1]) for r in odd_rows()])
    assert line_dedup.dedup_lines(empty).count() == 0


# lexical search -------------------------------------------------------------------------------

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def plain_search(docs, items, top=20):
    counts = [(d, TERM.findall((t or "").translate(LOWER))) for d, t in docs]
    n_docs = sum(1 for _, ws in counts if ws)
    n_words = sum(len(ws) for _, ws in counts)
    held = Counter(w for _, ws in counts for w in set(ws))
    tf = [(d, len(ws), Counter(ws)) for d, ws in counts]
    out = Counter()
    for item, text in items:
        asked = Counter(TERM.findall((text or "").translate(LOWER)))
        scored = []
        for d, n, c in tf:
            score = 0
            for t, repeats in asked.items():
                if c[t]:
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * held[t] + 1)))
                    m = 75 + (25 * n * n_docs) // n_words
                    score += repeats * w * ((10**9 * c[t]) // (1000 * c[t] + 12 * m))
            if score > 0:
                scored.append((-score, d is None, d or 0, d))
        for rank, (score, _, _, d) in enumerate(sorted(scored)[:top], 1):
            out[item, rank, d, -score] += 1
    return out


def search_result(docs, items, **settings):
    found = lexical.search(docs, items, lexical.SearchConfig(**settings))
    return Counter((r.item_id, r["rank"], r.doc_id, r.score) for r in found.collect())


@pytest.mark.parametrize("shard", [300, 1 << 21])
def test_search_against_plain_scores(spark, shard):
    rows = [(k, prose(k % 150, 5 + k * 7 % 60) + f" the the Ünïcode {'rare' * (k % 50 == 0)} w{k % 4}") for k in range(400)]
    rows += [(None, "the rare thing"), (None, None), (3, "repeated id the rarerare"), (401, ""), (402, "!!! ...")]
    items = [(1, "The THE rare; w1"), (2, prose(3, 40)), (3, ""), (4, None), (5, "unknownterm"), (None, "w2 ünïcode"), (1, "w3"), (6, "the")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    asked = spark.createDataFrame(items, "item_id long, text string")
    assert search_result(docs, asked, shard=shard, stretch=2) == plain_search(rows, items)
    # blocks of a few bytes: the queries come in several passes
    assert search_result(docs, asked, block=60) == plain_search(rows, items)


def test_settle_returns_exact_scores_and_all_ties():
    rng = np.random.default_rng(5)
    for _ in range(200):
        size, top = int(rng.integers(1, 60)), int(rng.integers(1, 6))
        score = np.zeros(size, np.int64)
        lists = []
        for _ in range(rng.integers(1, 6)):
            docs = rng.permutation(size)[: rng.integers(1, size + 1)]
            gains = np.sort(rng.integers(0, 9, len(docs)))[::-1]
            score[docs] += gains
            lists.append((docs, gains))
        found, got = lexical.settle(lists, size, top, 0, 1)
        last = max(np.sort(score)[::-1][: top][-1] if size >= top else 0, 1)
        assert sorted(found) == np.flatnonzero(score >= last).tolist()
        assert (got == score[found]).all()


def test_settle_stops_before_the_end():
    class Read(np.ndarray):
        """Notes how far a list was read."""

        def __getitem__(self, at):
            if isinstance(at, slice):
                Read.furthest = max(Read.furthest, at.stop or 0)
            return np.asarray(super().__getitem__(at))

    Read.furthest = 0
    docs, gains = np.arange(10_000), np.arange(10_000, 0, -1)
    found, _ = lexical.settle([(docs.view(Read), gains)], 10_000, 5, 0, 8)
    assert found.tolist() == [0, 1, 2, 3, 4] and Read.furthest < 100


def test_search_many_lists_in_slices(spark, monkeypatch):
    monkeypatch.setattr(lexical, "CELLS", 64)
    rng = np.random.default_rng(1)
    lists = [(rng.permutation(50), np.sort(rng.integers(1, 99, 50))[::-1]) for _ in range(7)]
    shard = object.__new__(lexical.Shard)
    shard.doc, shard.of = np.arange(50), np.concatenate([d for d, _ in lists])
    shard.impact, shard.begin = np.concatenate([g for _, g in lists]), np.arange(0, 351, 50)
    found, scores = shard.search([(t, 1) for t in range(7)], lexical.SearchConfig(top=3, stretch=2), 0)
    want = np.zeros(50, np.int64)
    for d, g in lists:
        want[d] += g
    best = sorted(zip(-scores, found))[:3]
    assert [x for _, x in best] == sorted(range(50), key=lambda d: (-want[d], d))[:3]


def test_search_odd_rows(odd, empty, spark):
    items = odd.select(F.col("doc_id").alias("item_id"), "text", "lang", "id")
    rows = [(r[0], r[1]) for r in odd_rows()]
    assert search_result(odd, items) == plain_search(rows, rows)
    assert lexical.search(empty, items).count() == 0
    assert lexical.search(odd, items.limit(0)).count() == 0


# collocations ---------------------------------------------------------------------------------


def plain_collocations(rows, least, top, longest=5):
    f, total = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            ws = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(ws)
            for n in range(1, longest + 1):
                f[lang].update(tuple(ws[i : i + n]) for i in range(len(ws) - n + 1))
    out = []
    for lang, counts in f.items():
        known = {p: a for p, a in counts.items() if a >= least}
        inside = {p[i:j] for p in known for i in range(len(p)) for j in range(i + 2, len(p) + 1)
                  if j - i < len(p) and known[p] >= known[p[i:j]]}
        scored = []
        for p, a in known.items():
            if len(p) > 1 and p not in inside:
                cuts = [(1000 * a * total[lang] // (known[p[:k]] * known[p[k:]]), k) for k in range(1, len(p))]
                score, k = min(cuts)
                scored.append((-score, -a, " ".join(p).encode(), known[p[:k]], known[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(scored)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, total[lang], -score))
    return sorted(out)


def collocation_result(docs, **settings):
    found = collocations.collocations(docs, collocations.CollocationConfig(**settings))
    return sorted(tuple(r) for r in found.collect())


def phrase_rows():
    rows = []
    for k in range(150):
        words = prose(k % 40, 50).split()
        if k % 3:
            words[10:13] = ["New", "york", "city"]
            words[30:35] = ["one", "two", "three", "four", f"five{k % 2}"]
        text = " ".join(words[:20]) + ("; " if k % 2 else "  \t") + " ".join(words[20:]) + "\r\nx x x x x x x x. Été: a"
        rows.append((k % 5 and ["en", "de", None, "und"][k % 4], text))
    rows = [(lang or None, text) for lang, text in rows]
    return rows + [("en", None), ("en", ""), ("fr", "..."), ("en", "x " * 30_000), ("", "a b a b a b"), *rows[:20]]


@pytest.mark.parametrize("trigger", [1, 3, 16])
def test_collocations_against_plain_counts(spark, trigger):
    rows = phrase_rows()
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(3)
    for least, top in ((4, 2000), (12, 9)):
        assert collocation_result(docs, least=least, top=top, trigger=trigger) == plain_collocations(rows, least, top)


def test_collocations_with_a_full_filter_and_small_tables(spark, monkeypatch):
    """A filter that lets nearly all through and tasks that pass counts on early change nothing."""
    monkeypatch.setattr(collocations, "COMBINE", 500)
    monkeypatch.setattr(collocations, "PHRASES", 50)
    rows = phrase_rows()
    docs = spark.createDataFrame(rows, "lang string, text string")
    assert collocation_result(docs, least=5, filter_bits=1 << 15) == plain_collocations(rows, 5, 2000)


def test_collocations_of_documents(documents):
    rows = [(r.lang, r.text) for r in documents.select("lang", "text").collect()]
    assert collocation_result(documents, least=20) == plain_collocations(rows, 20, 2000)


def test_chunks_hold_every_phrase_once(spark):
    """Parse frequencies times own words give back all words."""
    rows = phrase_rows()
    config = collocations.CollocationConfig(trigger=3)
    chunks = collocations.dictionary(spark.createDataFrame(rows, "lang string, text string"), config).collect()
    words = sum(r.times * (len(r.chunk.split(" ")) - 4 * r.tail) for r in chunks)
    assert words == sum(len(x.split()) for _, t in rows for x in re.split(r"[.,;:!?\x0A-\x0D]", t or ""))
    assert len({(r.lang, r.chunk, r.tail) for r in chunks}) == len(chunks)


def test_collocations_odd_rows(odd, empty, spark):
    rows = [(r[2], r[1]) for r in odd_rows()]
    assert SCHEMA.split(",")[2].split()[0] == "lang"
    assert collocation_result(odd, least=2) == plain_collocations(rows, 2, 2000)
    assert collocations.collocations(empty).count() == 0
