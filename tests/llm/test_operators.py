"""Each operator against a brute-force reading, and on tables with odd rows."""

import math
import zlib
from collections import Counter, defaultdict

import brute
import numpy as np
import pytest
from odd import SF, odd_rows, prose
from pyspark.sql import functions as F

import corpus_pipeline
from lumenflow.llm import (
    graph, language, mixing, near_dedup, ordinal, packing, quality_rules, queries, suffix_dedup, token_counts, top_k,
    url_rules,
)

VOCABULARY = queries.vocabulary("word_bpe_49k.json")
PIECES = queries.vocabulary("byte_bpe_50k.tiktoken")


def texts(rows):
    return [(r[0], r[1]) for r in rows if r[0] is not None]


# mixing ---------------------------------------------------------------------------------------


def test_mixing_takes_near_targets(spark, documents):
    got = mixing.copies(documents).toPandas()
    assert len(got) == documents.count()
    assert (got.copies <= 3).all() and (got.copies >= 0).all()
    again = mixing.copies(documents).toPandas()
    key = ["doc_id"]
    assert got.sort_values(key).reset_index(drop=True).equals(again.sort_values(key).reset_index(drop=True))


def test_mixing_targets_fill_up(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 5), (None, 985)], "source string, source_size long")
    got = {r.source: r.target for r in mixing.targets(sizes).collect()}
    # a and c stop at three times their size; the rest is shared one to two by the null source and b
    assert got["a"] == 30 and got["c"] == 15
    assert math.isclose(got["b"] / got[None], 2) and math.isclose(sum(got.values()), 2000)


def test_mixing_large_source_meets_target(spark):
    rows = [(k, prose(k, 20 + k * 37 % 200), f"s{k % 3 if k % 4 else 0}") for k in range(1200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.copies(docs).toPandas()
    got["taken"] = got["size"] * got["copies"]
    for _, own in got.groupby("target"):
        assert abs(own.taken.sum() - own.target.iloc[0]) <= 0.01 * own.target.iloc[0]


def test_mixing_odd_rows(odd, empty):
    mixed = mixing.mix(odd)
    assert mixed.columns == odd.columns
    assert mixed.filter("row <> 'r'").count() == 0
    counts = mixing.copies(odd).toPandas()
    assert len(counts) == odd.count() and (counts[counts["size"] == 0].copies * 0 == 0).all()
    assert mixing.mix(empty).count() == 0


# language -------------------------------------------------------------------------------------


def test_language_held_out(spark):
    got = queries.language_crf(spark, "/root/testdata/sf0.01").toPandas().set_index("doc_id")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang").toPandas()
    docs = docs[docs.lang.notna()].set_index("doc_id")
    rest = [zlib.crc32(str(k).encode()) % 4 == 2 for k in docs.index]
    assert got.held_out.loc[docs.index].tolist() == rest
    assert (got.lang_pred.loc[docs.index] == docs.lang)[rest].mean() > 0.97
    assert got.score.between(0, 1).all()


def test_posteriors_equal_plain_forward_backward():
    rng = np.random.default_rng(1)
    begin = np.array([0, 1, 70, 71, 400])
    emission, moves = rng.random((400, 3)) + 0.01, rng.random((3, 3)) + 0.1
    got, _ = language.posteriors(emission, begin, moves)
    for a, b in zip(begin[:-1], begin[1:]):
        ahead, state = [], np.full(3, 1 / 3)
        for t in range(a, b):
            state = state @ moves * emission[t]
            state = state / state.sum()
            ahead.append(state)
        back = np.ones(3)
        for t in range(b - 1, a - 1, -1):
            want = ahead[t - a] * back
            assert np.allclose(got[t], want / want.sum())
            back = moves @ (emission[t] * back)
            back = back / back.sum()


def test_language_code_switch(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language.train(docs)
    parts = {x: docs.filter(F.col("lang") == x).orderBy("doc_id").first().text for x in ("fr", "de")}
    both = spark.createDataFrame([(1, parts["fr"] + " " + parts["de"])], "doc_id long, text string")
    row = language.identify(both, model).first()
    assert row.lang_pred in ("fr", "de") and row.score < 0.95


def test_language_odd_rows(odd, empty):
    model = language.train(odd)
    got = {r.doc_id: (r.lang_pred, r.score) for r in language.identify(odd, model).collect() if r.doc_id is not None}
    assert all(got[k] == ("und", 0.0) for k in (3, 4, 5, 11))
    assert got[10][0] in ("en", "fr")
    nothing = language.train(empty)
    assert {r.lang_pred for r in language.identify(odd, nothing).collect()} == {"und"}
    assert language.identify(empty, model).count() == 0


# near copies ----------------------------------------------------------------------------------


@pytest.mark.parametrize("width", [4, 5])
def test_near_copies(documents, width):
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    want = brute.near_components(rows, width)
    got = near_dedup.classes(documents, near_dedup.NearConfig(width=width)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def near_group(n=400):
    base = prose(11, 200).split()
    rows = []
    for k in range(n):
        own = list(base)
        for j in range(k % 6):
            own[(k * 31 + j * 53) % len(own)] = f"e{k}x{j}"
        rows.append((k, " ".join(own)))
    return rows + [(n + k, prose(100 + k, 60)) for k in range(50)]


def test_near_copies_in_a_large_group(spark):
    """A group far above the leaf size, met by leaders, dealt out in chunks, in parts and in blocks."""
    rows = near_group()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    config = near_dedup.NearConfig(width=4, leaf=8, depth=2, walk=64, leaders=2, chunk=2000)
    got = near_dedup.classes(docs, config).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute.near_components(rows, 4)


def test_near_copies_odd_rows(odd, empty):
    got = near_dedup.classes(odd).collect()
    want = brute.near_components(texts(odd_rows()), 5)
    assert len(got) == odd.count()
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id) == want[r.doc_id]
    kept = near_dedup.dedup(odd)
    assert kept.columns == odd.columns
    assert Counter(r.doc_id for r in kept.collect())[12] == 1
    assert near_dedup.classes(empty).count() == 0 and near_dedup.dedup(empty).count() == 0


def test_near_copies_of_repeated_and_null_ids(spark):
    """Rows are linked by their texts, whatever ids they share."""
    b, c = prose(71, 60), prose(72, 60)
    rows = [(1, b), (1, c), (2, b), (3, c + " more"), (None, b), (None, prose(73, 60)), (None, prose(73, 60) + " x"), (4, None), (4, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter((r.doc_id, r.component_id, r.kept) for r in near_dedup.classes(docs).collect())
    assert got == Counter([(1, 1, True), (1, 1, True), (2, 1, False), (3, 1, False), (None, 1, False),
                           (None, None, True), (None, None, False), (4, 4, True), (4, 4, True)])
    left = near_dedup.dedup(docs.withColumn("row", F.lit(1)).withColumn("id", F.lit("i")))
    assert left.columns == ["doc_id", "text", "row", "id"]
    assert Counter(tuple(r)[:2] for r in left.collect()) == Counter([rows[0], rows[1], rows[5], rows[7], rows[8]])


def test_near_copies_just_alike_in_a_crowd(spark):
    """Pairs at 0.80 to 0.83 among texts that share half their words, in nodes far above the leaf size."""
    rng = np.random.default_rng(8)
    base = prose(21, 300).split()
    rows = []
    for k in range(220):
        own = list(base)
        for j in rng.choice(300, 45, replace=False):
            own[j] = f"t{k}x{j}"
        other = list(own)
        for j in rng.choice(290, 1) + np.arange(0, 300, 60):
            other[(j + 7) % 300] = f"u{k}"
        rows += [(2 * k, " ".join(own)), (2 * k + 1, " ".join(other))]
    sets = [brute.shingle_set(t, 5) for _, t in rows]
    alike = [len(a & b) / len(a | b) for a, b in zip(sets[::2], sets[1::2])]
    assert 0.8 < np.mean(alike) < 0.86
    config = near_dedup.NearConfig(leaf=8, walk=64, leaders=2)
    got = near_dedup.classes(spark.createDataFrame(rows, "doc_id long, text string"), config).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute.near_components(rows, 5)


def thue_morse(n, letters):
    return "".join(letters[bin(k).count("1") % 2] for k in range(n))


def test_words_that_collide_modulo_powers_of_two(spark):
    """Two words that polynomial hashes modulo 2^64 cannot tell apart, whatever the base."""
    words = [thue_morse(2048, "ab"), thue_morse(2048, "ba")]
    docs = spark.createDataFrame(list(enumerate(words)), "doc_id long, text string")
    assert all(r.component_id == r.doc_id for r in near_dedup.classes(docs).collect())
    assert near_dedup.dedup(docs).count() == 2
    check_packing(list(enumerate(words)), packing.packed(docs, packing.PackConfig(VOCABULARY)).collect())
    import base64

    pieces = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PIECES, "rb"))}
    got = {r.doc_id: r.n_tokens for r in token_counts.token_counts(docs, token_counts.CountConfig(PIECES)).collect()}
    assert got == {k: plain_count(w.encode(), pieces) for k, w in enumerate(words)}


def test_links_are_thinned_to_stars(spark, monkeypatch):
    rng = np.random.default_rng(2)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 400, (5000, 2))] + [(900, 901)]
    want = {r.node: r.component for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    pairs = spark.createDataFrame([(max(x), min(x)) for x in links if x[0] != x[1]], "u long, v long")
    assert sorted(tuple(r) for r in graph.thinned(pairs).collect()) == sorted((k, v) for k, v in want.items() if k != v)
    monkeypatch.setattr(graph, "CHUNK", 3000)
    assert graph.thinned(pairs).count() < 1000
    again = {r.node: r.component for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert again == want


def test_components(spark):
    links = [(k, k + 1) for k in range(40)] + [(100, 7), (200, 201), (201, 200), (300, 300)]
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(41)}, 100: 0, 200: 200, 201: 200}


# packing --------------------------------------------------------------------------------------


def check_packing(rows, pieces, capacity=2048):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(VOCABULARY)
    want = Counter()
    for doc, text in rows:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        want[doc, ids.tobytes()] += 1
    sequences, whole = defaultdict(list), defaultdict(list)
    for p in pieces:
        sequences[p.sequence_id].append((p.offset, p.length))
        whole[p.doc_id, p.doc_tokens].append((p.start, bytes(p.ids)))
    for own in sequences.values():
        at = 0
        for offset, n in sorted(own):
            assert offset == at and n > 0
            at += n
        assert at <= capacity and (at == capacity or at & (at - 1) == 0)
    joined = Counter()
    for (doc, total), own in whole.items():
        if len({s for s, _ in own}) == len(own):
            ids = b"".join(x for _, x in sorted(own))
            assert len(ids) == 4 * total
            joined[doc, ids] += 1
    for key, n in joined.items():
        assert want[key] >= n
    assert sum(len(p.ids) for p in pieces) == sum(len(ids) * n for (_, ids), n in want.items())


def test_packing(documents, odd, empty):
    config = packing.PackConfig(VOCABULARY)
    check_packing([(r.doc_id, r.text) for r in documents.collect()], packing.packed(documents, config).collect())
    check_packing([(r[0], r[1]) for r in odd_rows()], packing.packed(odd, config).collect())
    assert packing.packed(empty, config).count() == 0


def test_packing_assigns_every_token_once():
    lengths = np.random.default_rng(5).integers(1, 2048, 3000).tolist()
    held = packing.assign(lengths, packing.PackConfig(VOCABULARY))
    pieces = defaultdict(list)
    for own in held:
        n = sum(n for *_, n in own)
        assert n == 2048 or n & (n - 1) == 0
        for k, start, n in own:
            pieces[k].append((start, n))
    for k, total in enumerate(lengths):
        at = 0
        for start, n in sorted(pieces[k]):
            assert start == at
            at += n
        assert at == total


def test_packing_balances_cost():
    config = packing.PackConfig(VOCABULARY)
    held = packing.assign([1024] * 4 + [512] * 8 + [256] * 16, config)
    costs = [sum(n + n * n / 2048 for *_, n in own) for own in held]
    first_fit = [2 * (1024 + 512)] * 2 + [4 * (512 + 128)] * 2 + [8 * (256 + 32)] * 2
    assert len(costs) == 6 and np.ptp(costs) < np.ptp(first_fit) and np.std(costs) < np.std(first_fit)


# URL rules ------------------------------------------------------------------------------------


def test_url_rules(spark):
    urls = [
        "http://a.b.example.net/en/x", "https://EXAMPLE.net/en", "http://example.net/en/", "ftp://x.org/fr/q?y#z", "nonsense",
        None, "http://", "http://net/", "http://anet/", "http://x.example.com/de/?a", "http://x.example.com/dex/", "http://x.net",
        "http://x.net?u=http://org/fr/", "http://org/fr/" + "a/" * 500, ".".join(["http://w"] + ["w"] * 300) + ".net/", "",
    ]
    pages = spark.createDataFrame([(k, u, "h") for k, u in enumerate(urls + urls[:1])], "page_id long, url string, host string")
    got = url_rules.judge(pages, url_rules.rule_table(spark, queries.URL_RULES)).collect()
    assert len(got) == len(urls) + 1
    for r in got:
        url = r.row.url
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host, path = rest[:cut].lower(), rest[cut:].split("?")[0].split("#")[0]
        fits = []
        for verdict, rule in queries.URL_RULES:
            h, _, p = rule.partition("/")
            if (host == h or host.endswith("." + h)) and path.startswith("/" + p):
                fits.append((len(rule), rule, verdict))
        best = max(fits, default=(0, None, "allow"))
        assert (r.host, r.path, r.rule, r.verdict) == (host, path, best[1], best[2]), url


# repeated strings -----------------------------------------------------------------------------


@pytest.mark.parametrize("shard", [1 << 20, 3000])
def test_repeated_strings(documents, shard):
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    config = suffix_dedup.SuffixConfig(shard=shard)
    got = suffix_dedup.cut(documents.select("doc_id", "text"), config).withColumn("sha", F.sha2("rest", 256)).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.sha) for r in got} == brute.repeated_bytes(rows)


def test_repeated_strings_of_one_anchor(spark):
    """One passage in many surroundings: a key with several shards, merged by binary search."""
    middle = "the one and only passage that all of these texts share, made a bit longer than ninety bytes"
    rows = [(k, prose(k, 15) + " " + middle + f" {k % 7}" + " " + prose(k % 11, 20)) for k in range(300)]
    rows += [(1000, "abc" * 400), (1001, "z" * 700), (1002, None), (1003, "z" * 99)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for shard in (1 << 20, 2000):
        got = suffix_dedup.cut(docs, suffix_dedup.SuffixConfig(shard=shard)).withColumn("sha", F.sha2("rest", 256)).collect()
        assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.sha) for r in got} == brute.repeated_bytes(rows)


def test_repeated_strings_of_a_hot_key_are_spread(spark):
    """A line of 66 to 99 bytes in differing surroundings: no key holds more than a few shards of bytes."""
    line = "a line that very many of these documents carry in their midst, of some ninety bytes in all"
    assert 66 <= len(line) <= 99
    rows = [(k, prose(k % 350, 15) + " " + line + " " + prose(k + 500, 20)) for k in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    config = suffix_dedup.SuffixConfig(shard=4000)
    found = suffix_dedup.repeated_segments(docs, config)
    compared = suffix_dedup.windows_to_compare(docs, found.filter("NOT again"), config)
    sizes = [r.n for r in compared.groupBy("key").agg(F.sum(F.length("bytes")).alias("n")).collect()]
    assert sum(sizes) > 10 * config.shard and max(sizes) < 3 * config.shard
    got = suffix_dedup.cut(docs, config).withColumn("sha", F.sha2("rest", 256)).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.sha) for r in got} == brute.repeated_bytes(rows)


def test_strip_keeps_replacement_characters(spark):
    """Only characters that the edge of a removed span cuts go with it."""
    again = prose(1, 40)
    rows = [
        (0, "\u4e2d" + again + "\u6587 first"),
        (1, "own \ufffd\u4e2d\ufffd " + "\u4e2d" + again + "\u6587 \ufffd tail"),
        (2, "\u4e2e" + again + "\u6586\u00e9"),  # two bytes in common before, and the first two after
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.text for r in suffix_dedup.strip(docs).collect()}
    assert got == {0: rows[0][1], 1: "own \ufffd\u4e2d\ufffd \ufffd tail", 2: "\u4e2e\u00e9"}


def test_suffix_array_and_prefixes():
    rng = np.random.default_rng(2)
    data = rng.integers(0, 3, 500).astype(np.uint8)
    stop = np.repeat([120, 121, 300, 500], [120, 1, 179, 200])
    order = suffix_dedup.suffix_array(data, stop)
    suffix = [bytes(data[i : stop[i]]) for i in range(500)]
    assert order.tolist() == sorted(range(500), key=lambda i: (suffix[i], i))
    common = suffix_dedup.common_prefixes(data, stop, order, lanes=7)
    for k in range(1, 500):
        a, b = suffix[order[k - 1]], suffix[order[k]]
        n = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        assert common[k] == n


def test_repeated_strings_odd_rows(odd, empty):
    got = suffix_dedup.strip(odd)
    assert got.columns == odd.columns and got.count() == odd.count()
    rows = {(r.doc_id, r.text) for r in got.collect()}
    assert (3, None) in rows and (1, "") in rows and (12, "") in rows and (4, "") in rows
    assert suffix_dedup.strip(empty).count() == 0


# quality rules --------------------------------------------------------------------------------


def measures(text):
    found = brute.WORD.findall(text or "")
    grams = Counter(tuple(found[i : i + 3]) for i in range(len(found) - 2))
    covered = {i + j for i in range(len(found) - 2) if grams[tuple(found[i : i + 3])] > 1 for j in range(3)}
    lines = [x for x in (text or "").split("\n") if brute.WORD.search(x)]
    return len(found), sum(map(len, found)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def test_quality_measures(odd, empty, documents):
    for docs in (odd, documents):
        got = quality_rules.judge(docs).select("row.text", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
        got = got.collect()
        assert len(got) == docs.count()
        for r in got:
            n = measures(r.text)
            assert tuple(r)[1:6] == n
            assert r.base_failed == (n[0] < 50 or 100 * n[4] > 50 * n[0])
            assert not (r.base_failed and r.kept)
    assert quality_rules.keep_good(odd).columns == odd.columns
    assert quality_rules.judge(empty).count() == 0


def test_quality_fit_finds_accuracies():
    rng = np.random.default_rng(8)
    width = len(quality_rules.RULES)
    good = rng.random(20000) < 0.7
    alarm, notice = 0.03, 0.6
    votes = np.where(rng.random((20000, width)) < np.where(good, alarm, notice)[:, None], 1, 2)
    votes[rng.random(votes.shape) < 0.1] = 0
    codes = Counter(int(sum(v * 3 ** (width - 1 - k) for k, v in enumerate(row))) for row in votes)
    found = quality_rules.fit(dict(codes), quality_rules.QualityConfig(rounds=60))
    assert abs(found.share - 0.7) < 0.02
    assert all(abs(a - alarm) < 0.01 and abs(b - notice) < 0.03 for a, b in zip(found.false_alarm, found.notice))


def test_quality_keeps_prose(spark):
    rows = [(k, ". ".join(prose(k * 9 + j, 12).capitalize() for j in range(10))) for k in range(150)]
    rows += [(1000 + k, " ".join(w + "***" for w in prose(k, 80).split())) for k in range(20)]
    rows += [(2000 + k, prose(k, 80).upper() + " " + prose(k, 80).upper()) for k in range(10)]
    got = quality_rules.judge(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert all(r.kept == (r.doc_id < 1000) for r in got)


# token counts ---------------------------------------------------------------------------------


def plain_count(token, pieces):
    best = [(0.0, 0)] + [(-math.inf, 0)] * len(token)
    for end in range(1, len(token) + 1):
        for size in range(min(end, 128), 0, -1):
            rank = pieces.get(token[end - size : end])
            if rank is not None:
                value = -math.log(rank + 2.7) + best[end - size][0]
                if value > best[end][0]:
                    best[end] = value, best[end - size][1] + 1
    return best[-1][1]


def plain_pretokens(data):
    out, at = [], 0
    words = [(m.start(), m.end()) for m in __import__("re").finditer(rb"[^\x20\x09-\x0D]+", data)]
    for a, b in words:
        if a > at and data[a - 1 : a] == b" ":
            a -= 1
        out += [data[i : i + 1] for i in range(at, a)]
        out.append(data[a:b])
        at = b
    return out + [data[i : i + 1] for i in range(at, len(data))]


def test_token_counts(odd, empty, documents):
    import base64

    pieces = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PIECES, "rb"))}
    config = token_counts.CountConfig(PIECES)
    memo = {}
    for docs in (odd, documents.filter("doc_id < 60")):
        got = Counter(tuple(r) for r in token_counts.token_counts(docs, config).collect())
        want = Counter()
        for r in docs.collect():
            tokens = plain_pretokens((r.text or "").encode())
            for t in set(tokens) - set(memo):
                memo[t] = plain_count(t, pieces)
            want[r.doc_id, len((r.text or "").encode()), len(tokens), sum(memo[t] for t in tokens)] += 1
        assert got == want
    assert token_counts.token_counts(empty, config).count() == 0


def test_token_counts_of_whole_pretokens(spark):
    """Pre-tokens and pieces over 64 bytes, by a reading without any bound."""
    import base64
    import re

    pieces = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PIECES, "rb"))}
    longest = max(map(len, pieces))
    assert longest == 128

    def count(token):
        best = [(0.0, 0)] + [(-math.inf, 0)] * len(token)
        for end in range(1, len(token) + 1):
            for size in range(min(end, longest), 0, -1):
                rank = pieces.get(token[end - size : end])
                if rank is not None and best[end - size][0] - math.log(rank + 2.7) > best[end][0]:
                    best[end] = best[end - size][0] - math.log(rank + 2.7), best[end - size][1] + 1
        return best[-1][1]

    large = [p for p in pieces if len(p) > 64 and not p.strip(b" ") == b"" and not set(p) & set(b"\t\n\v\f\r")]
    assert large
    noise = base64.b64encode(np.random.default_rng(5).bytes(3000)).decode()
    rows = [
        "see https://example.org/" + "/".join(f"section-{k}" for k in range(20)) + "?q=information&lang=en here",
        noise, "a " + noise[:65] + " " + noise[:64] + "  " + noise[:63], "\u4e2d\u6587\u6ca1\u6709\u7a7a\u683c\u3002" * 40, "internationalization" * 30,
        *("begin" + p.decode("utf-8", "ignore") + "end" for p in large), *(p.decode("utf-8", "ignore") for p in large), "",
    ]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    want = []
    for k, text in enumerate(rows):
        tokens = re.findall(rb"\x20?[^\x20\x09-\x0D]+|[\x20\x09-\x0D]", text.encode())
        want.append((k, len(text.encode()), len(tokens), sum(map(count, tokens))))
    for config in (token_counts.CountConfig(PIECES), token_counts.CountConfig(PIECES, shared=4, stretch=37)):
        assert sorted(tuple(r) for r in token_counts.token_counts(docs, config).collect()) == want


# graded quality -------------------------------------------------------------------------------


def test_ordinal_grades(spark):
    folder = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rated = queries.ratings(spark.read.parquet(f"{folder}/labels.parquet")).filter("grade IS NOT NULL")
    held = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    model = ordinal.train(docs, rated.filter(~held))
    assert (np.diff(model.thresholds) > 0).all()
    got = ordinal.grade(docs, model).join(rated.filter(held), "doc_id").toPandas()
    print(got.groupby("grade").kept.mean())
    assert len(got) > 500 and (got.kept == (got.grade == 2)).mean() > 0.9
    assert got.expected_grade.corr(got.grade) > 0.7


def test_ordinal_odd_rows(odd, empty):
    ratings = odd.select("doc_id", (F.col("doc_id") % 3).cast("int").alias("grade"))
    model = ordinal.train(odd, ratings)
    got = ordinal.grade(odd, model).collect()
    assert len(got) == odd.count() and not any(r.kept for r in got if r.doc_id in (3, 4, 5))
    flat = ordinal.train(empty, ratings.limit(0))
    assert ordinal.grade(odd, flat).count() == odd.count()
    assert ordinal.grade(empty, model).count() == 0


# search ---------------------------------------------------------------------------------------


def test_top_k(spark):
    rng = np.random.default_rng(4)
    rows = [(k, (rng.normal(size=12) * (1 + k % 9)).tolist(), "x") for k in range(700)]
    rows += [(1000, None, "x"), (1020, [1.0, float("nan")] + [0.0] * 10, "x"), (1040, [None] + [1.0] * 11, "x"), (None, [1.0] * 12, "x")]
    rows += [rows[20], (1060, rows[40][1], "x"), (1061, [0.0] * 12, "x"), (1080, [float("inf")] * 12, "x")]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>, block string")
    good = {k: np.floor(64 * np.array(v)).astype(int) for k, v, _ in rows if k is not None and v is not None and None not in v and np.isfinite(v).all()}
    ids = np.array(sorted(good))
    table = np.stack([good[k] for k in ids])
    config = top_k.SearchConfig(k=20, leading=4, block=100, query_block=8, step=32)
    got = top_k.top_k(vectors, F.col("vec_id") % 20 == 0, config=config).collect()
    want = set()
    for k in ids[ids % 20 == 0]:
        score = table @ good[k]
        order = [j for j in np.lexsort((ids, -score)) if ids[j] != k][:20]
        want |= {(int(k), n + 1, int(ids[j]), int(score[j])) for n, j in enumerate(order)}
    assert {tuple(r) for r in got} == want and len(got) == len(want)
    few = top_k.top_k(vectors.filter("vec_id < 5"), F.col("vec_id") == 0, config=config)
    assert few.count() == 4
    assert top_k.top_k(vectors.limit(0), F.col("vec_id") == 0).count() == 0


# pipeline -------------------------------------------------------------------------------------


def test_pipeline(spark, documents):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        docs = stage(spark, docs, SF)
        if k < len(corpus_pipeline.STAGES) - 1:
            docs = corpus_pipeline.saved(docs)
            assert docs.columns == columns and docs.count() > 0
        if k == 1:
            want = brute.near_components([(r.doc_id, r.text) for r in before.collect()], 5)
            assert {r.doc_id for r in docs.collect()} == {i for i, (_, c) in want.items() if i == c}
    check_packing([(r.doc_id, r.text) for r in before.collect()], docs.collect())


def test_pipeline_odd_rows(spark, odd, empty):
    for start in (odd, empty):
        docs = start
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = corpus_pipeline.saved(stage(spark, docs, SF))
            assert docs.columns == odd.columns
        assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() >= 0
