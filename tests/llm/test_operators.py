"""Each operator against brute force on small tables, and on tables with nulls, empty texts, ties, repeated rows and other columns."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lakeferry.llm import anchors, bradley_terry, components, decontaminate, kd_sharding, mixing, ngram_join, quality_rules, substring_dedup, suffix_dedup, textcore, token_counts, toxicity
from lakeferry.llm.queries import QUERIES, tokenizer_path

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, label string, n long"


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{int(rng.random() ** 2 * vocabulary)}x" for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(7)
    passage = prose(rng, 60)
    out = [prose(rng, rng.randint(1, 160)) for _ in range(60)]
    base = prose(rng, 120)
    out += [base] * 7 + [" ".join(w if rng.random() > 0.01 else "edit" for w in base.split()) for _ in range(25)]
    out += [prose(rng, 20) + " " + passage + "\n" + prose(rng, 30) for _ in range(12)]
    out += ["", None, " \t\n", "one", "ONE", "a b c d", "a b c d e", "a b c d e f", "é ö 日本 " * 30, "same words " * 80, "x" * 500, "   z"]
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, "en", f"src{i % 3}" if i % 11 else None, len(t or ""), "label", 1) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA).repartition(5).cache()


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in every column, and a row twice."""
    rows = [(None, "a b c d e f g", None, None, None, None, None), (None, None, None, None, None, None, None), (3, "a b c d e f g", None, None, None, None, None), (3, "a b c d e f g", None, None, None, None, None), (4, "", None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, (i // 2) % 2) for i in range(200)], "doc_id long, quality int, toxic int")


OPERATORS = {
    "ngram": lambda d, labels: ngram_join.linked_components(d),
    "keep_one": lambda d, labels: ngram_join.keep_one(d),
    "rules": quality_rules.apply_rules,
    "keep_good": quality_rules.keep_good,
    "suffix": lambda d, labels: suffix_dedup.remove_repeats(d),
    "toxicity": toxicity.score_toxicity,
    "substring": lambda d, labels: substring_dedup.remove_repeats(d),
    "ranker": bradley_terry.score_quality,
    "shards": lambda d, labels: kd_sharding.shard_documents(d, 4),
    "mix": lambda d, labels: mixing.mix_sources(d),
    "mixed": lambda d, labels: mixing.mixed(d),
    "leaks": lambda d, labels: decontaminate.find_leaks(d, labels.limit(0).select(F.lit(1).cast("long").alias("item_id"), F.lit("a").alias("text"))),
    "drop_leaks": lambda d, labels: decontaminate.drop_leaks(d, labels.limit(1).select(F.lit(1).cast("long").alias("item_id"), F.lit("q r s t u v").alias("text"))),
    "tokens": lambda d, labels: token_counts.count_tokens(d, tokenizer_path()),
}
ROW_FOR_ROW = {"ngram", "rules", "suffix", "toxicity", "substring", "ranker", "shards", "mix", "tokens"}


@pytest.mark.parametrize("name", OPERATORS)
def test_nulls_repeats_and_empty_tables(name, odd, nothing, labels):
    assert OPERATORS[name](nothing, labels).count() == 0
    got = OPERATORS[name](odd, labels).collect()
    if name in ROW_FOR_ROW:
        assert len(got) == 5
    assert len(OPERATORS[name](odd, labels.limit(0)).collect()) == len(got) or name in ("rules", "keep_good")


OWN_NAMES = ["_lf_id", "_lf_at", "_node", "size", "shard", "slot", "runs", "_key", "_row", "key", "part", "pos", "doc", "like", "id", "tok", "rows", "held_out", "score", "kept", "item_id", "quality", "toxic", "target", "copies", "label", "n", "starts", "at"]


@pytest.mark.parametrize("name", OPERATORS)
def test_columns_named_as_the_operators_own(name, spark, texts):
    """Other columns change nothing, whatever they are called; operators that keep rows keep them too."""
    rows = [(i, t, "en", f"s{i % 2}") for i, t in enumerate(texts[:30] + texts[60:75] + [None, ""])]
    plain = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(3)
    more = plain.select("doc_id", *[F.concat(F.lit("x"), F.col("doc_id")).alias(c) for c in OWN_NAMES], "text", "lang", "source")
    known = spark.createDataFrame([(i, i % 2, (i // 2) % 2) for i in range(200)], "doc_id long, quality int, toxic int")
    want, got = OPERATORS[name](plain, known), OPERATORS[name](more, known)
    assert sorted(map(str, want.collect())) == sorted(map(str, got.select(*want.columns).collect()))
    if want.columns == plain.columns:
        assert got.columns == more.columns and all(r["_node"] == r["size"] == f"x{r.doc_id}" for r in got.collect())


@pytest.mark.parametrize("name", OPERATORS)
def test_one_very_long_text(name, spark):
    """A text of several slices, and its repeats, beside short ones."""
    rng = random.Random(3)
    part = prose(rng, 30_000, 9000)
    rows = [(1, part + " " + part, "en", "a"), (2, part, "en", "a"), (3, "short text", "en", "b"), (4, prose(rng, 300), "en", "b")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    known = spark.createDataFrame([(i, i % 2, (i // 2) % 2) for i in range(200)], "doc_id long, quality int, toxic int")
    got = OPERATORS[name](df, known).collect()
    assert len(got) == 4 if name in ROW_FOR_ROW else len(got) >= 0
    if name == "substring":
        assert {r.doc_id: r.n_words - r.n_removed for r in got} == {1: 0, 2: 0, 3: 2, 4: 300}
    if name == "suffix":
        assert {r.doc_id: r.n_removed for r in got}[2] == len(part) and {r.doc_id: r.n_removed for r in got}[1] == len(part)


# n-gram join


def brute_components(texts, words=5, similarity=80):
    sets = []
    for t in texts:
        w = [x.translate({c: c + 32 for c in range(65, 91)}) for x in WORD.findall(t or "")]
        sets.append({tuple(w[i : i + words]) for i in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} if w else set())
    parent = list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= similarity * len(a | b):
                x, y = root(i), root(j)
                parent[max(x, y)] = min(x, y)
    return {i: (len(s), root(i)) for i, s in enumerate(sets)}


@pytest.mark.parametrize("small, rows, hot", [(ngram_join.SMALL, ngram_join.BLOCK_ROWS, ngram_join.HOT_ROWS), (4, 8, 3)])
def test_components_are_those_of_all_pairs(docs, texts, small, rows, hot, monkeypatch):
    monkeypatch.setattr(ngram_join, "SMALL", small)
    monkeypatch.setattr(ngram_join, "HOT_ROWS", hot)
    monkeypatch.setattr(ngram_join, "BLOCK_ROWS", rows)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.linked_components(docs).collect()}
    assert got == brute_components(texts)
    kept = {r.doc_id for r in ngram_join.keep_one(docs).collect()}
    assert kept == {i for i, (_, c) in got.items() if i == c}


@pytest.mark.parametrize("hot", [2, 256])
def test_components_where_many_share_some_shingles(spark, hot, monkeypatch):
    """Near copies of texts that also share common passages of several lengths, chains among them, against all pairs."""
    monkeypatch.setattr(ngram_join, "HOT_ROWS", hot)
    rng = random.Random(37)
    common = [prose(rng, n, 3000) for n in (5, 6, 9, 30)]
    texts = []
    for _ in range(60):
        base = [*prose(rng, rng.choice([3, 12, 40, 110]), 3000).split(), *rng.choice(common).split(), *(rng.choice(common).split() if rng.random() < 0.4 else [])]
        for _ in range(rng.choice([1, 1, 2, 4, 8])):
            w = list(base)
            for _ in range(rng.choice([0, 1, 1, 2])):
                w[rng.randrange(len(w))] = f"e{rng.randrange(999)}"
            texts.append(" ".join(w[rng.choice([0, 0, 1]) :]))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.linked_components(df).collect()} == brute_components(texts)


@pytest.mark.parametrize("similarity", [80, 70, 20])
def test_a_row_is_sent_if_any_size_in_the_range_may_link(spark, similarity):
    def may(n, m, c):
        rest = lambda x: -(-x * similarity // 100) - 1 - x // ngram_join.EXTRA
        return (c + max(rest(n), rest(m))) * (100 + similarity) >= (n + m) * similarity

    rng = random.Random(17)
    rows = [(16, 18, 20, 1)]
    for _ in range(3000):
        n = rng.randint(1, 150)
        low, high = sorted(rng.randint(-(-n * similarity // 100), n * 100 // similarity) for _ in range(2))
        rows.append((n, low, high, rng.randint(1, 1 + n // 5)))
    want = [any(may(n, m, c) for m in range(low, high + 1)) for n, low, high, c in rows]
    ends = [may(n, low, c) or may(n, high, c) for n, low, high, c in rows]
    assert (want[0] and not ends[0]) or similarity != 80
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, n long, low long, high long, c long")
    got = df.select("i", ngram_join._may_link_some(F.col("n"), F.col("low"), F.col("high"), F.col("c"), similarity).alias("x")).orderBy("i").collect()
    assert [r.x for r in got] == want


def test_components_of_chains(spark):
    edges = [(i, i + 1) for i in range(100)] + [(200, 201), (203, 202), (202, 202)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(1, 101)} | {201: 200, 203: 202}


# quality rules and ranking


def brute_base(t):
    w = WORD.findall(t or "")
    lines = [x for x in (t or "").split("\n") if WORD.search(x)]
    windows = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    repeated = {j for i in range(len(w) - 7) if windows[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(repeated)


def test_base_rules(docs, texts, labels):
    for r in quality_rules.apply_rules(docs, labels).collect():
        n, chars, symbols, lines, words = brute_base(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (n, chars, symbols, lines, words)
        assert r.base_failed == (n < 20 or 100 * words > 30 * n) and not (r.base_failed and r.kept)


def test_forest_is_monotone_and_learns():
    rng = np.random.default_rng(0)
    x = rng.random((3000, 11))
    y = (x[:, 2] + 0.1 * rng.random(3000) < 0.5).astype(int)
    forest = quality_rules.fit_forest(x, y)
    assert ((forest.chance(x) >= 0.5) == (y == 1)).mean() > 0.9
    line = np.repeat(x[:1], 50, 0)
    line[:, 2] = np.linspace(0, 1, 50)
    assert (np.diff(forest.raw(line)) <= 1e-12).all()
    assert np.allclose(quality_rules.fit_forest(x[:0], y[:0]).chance(x[:3]), 0.5)


def test_ranker_orders_pairs():
    rng = np.random.default_rng(1)
    x = rng.random((1000, 11))
    y = (x[:, 0] > 0.3).astype(int)
    model = bradley_terry.fit_ranker(x, y)
    assert ((model.score(x) >= 0.3) == (y == 1)).mean() > 0.95


def slow_features(text):
    """The features of a text, counted one by one."""
    t = text or ""
    words = WORD.findall(t)
    n, chars, symbols, dups, repeats = brute_base(text)
    lines = sum(bool(WORD.search(x)) for x in t.split("\n"))
    upper = sum("A" <= c <= "Z" or "\u00c0" <= c <= "\u00de" for c in t)
    lower = sum("a" <= c <= "z" or "\u00df" <= c <= "\u00ff" for c in t)
    ascii_ = [c for c in t if c < "\x80" and not c.isspace() or c in "\x1c\x1d\x1e\x1f"]
    digits, letters = sum(c.isdigit() for c in ascii_), sum(c.isalpha() for c in ascii_)
    w, k = max(n, 1), max(chars, 1)
    return [np.log1p(n), chars / w, symbols / k, dups / max(lines, 1), repeats / w, upper / max(upper + lower, 1), t.count("!") / k, digits / k, (len(ascii_) - digits - letters) / k, len(set(words)) / w, np.log1p(n / max(lines, 1))]


MIXED = ["Ünïcode ÀÉÞ ßþÿ! A1 b2; c3... [x]", "UPPER lower\nUPPER lower\n\nx#y $5 & <b>", "a! " * 30 + "\nx y\nx y", "\x1c \x1f a\u00a0b \u2003 c"]


@pytest.fixture(scope="module")
def judged(spark, texts):
    """Documents, labels of quality, and the features by counting."""
    every = [*texts, *MIXED]
    rows = [(i, t) for i, t in enumerate(every)]
    labels = [(i, int(i % 3 != 0)) for i in range(len(every))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    return df, spark.createDataFrame(labels, "doc_id long, quality int"), {i: slow_features(t) for i, t in rows}, dict(labels)


def training_rows(judged):
    df, _, features, labels = judged
    keep = [i for i in sorted(features) if zlib.crc32(str(i).encode()) % 5]
    return np.array([features[i] for i in keep]), np.array([labels[i] for i in keep])


def test_verdicts_of_the_trees_one_node_at_a_time(judged):
    """Which documents stay, by walking each tree of the forest that the training rows give."""
    df, labels, features, _ = judged
    x, y = training_rows(judged)
    got, known = quality_rules.sample_features(df, labels, "quality", 10_000)
    assert np.allclose(got, x) and known.tolist() == y.tolist()
    forest = quality_rules.fit_forest(got, known)
    kept = set()
    for r in quality_rules.apply_rules(df, labels).collect():
        f, total = features[r.doc_id], forest.bias
        for node in forest.roots.tolist():
            while forest.left[node] != node:
                node = int(forest.left[node] if f[forest.feature[node]] <= forest.threshold[node] + 1e-12 else forest.right[node])
            total += forest.value[node]
        chance = 1 / (1 + np.exp(-total))
        assert r.chance == pytest.approx(chance) and r.kept == (not r.base_failed and chance >= quality_rules.KEEP_AT)
        kept |= {r.doc_id} if r.kept else set()
    assert {r.doc_id for r in quality_rules.keep_good(df, labels).collect()} == kept and 0 < len(kept) < len(features)


def test_ranks_by_the_definition(judged):
    """The weights make the pairs' penalised loss least, and scores follow from strengths and the quantile."""
    df, labels, features, _ = judged
    x, y = training_rows(judged)
    model = bradley_terry.fit_ranker(x, y)

    def strength(f, weights):
        z = [min(max((v - m) / s, -8), 8) for v, m, s in zip(f, model.mean, model.scale, strict=True)]
        basis = z + [max(v - k, 0) for k in (-1.0, 0.0, 1.0, 2.0) for v in z]
        return sum(a * b for a, b in zip(basis, weights, strict=True))

    def loss(weights):
        each = [strength(f, weights) for f in x]
        good, bad = bradley_terry.preference_pairs(y)
        return np.mean([np.log1p(np.exp(-(each[i] - each[j]))) for i, j in zip(good, bad, strict=True)]) + 0.5e-2 * sum(w * w for w in weights)

    least = loss(model.weights)
    rng = np.random.default_rng(3)
    assert all(loss(model.weights + step) >= least - 1e-9 for step in rng.normal(0, 0.02, (12, len(model.weights))))
    ordered = sorted(strength(f, model.weights) for f in x)
    worse = int((y == 0).sum())
    at = (ordered[worse - 1] + ordered[worse]) / 2
    for r in bradley_terry.score_quality(df, labels).collect():
        odds = np.exp(strength(features[r.doc_id], model.weights) - at) * 0.3 / 0.7
        assert r.score == pytest.approx(odds / (1 + odds), rel=1e-6) and r.predicted == int(r.score >= 0.3)


def test_ranker_learns_from_every_row_and_pair(spark):
    """No gradient is left of the loss over all pairs, and rows dealt over tasks give the model of rows in memory."""
    rng = np.random.default_rng(4)
    x = rng.random((25_000, 11))
    y = (x[:, 0] + rng.normal(0, 0.2, len(x)) > 0.3).astype(int)
    model = bradley_terry.fit_ranker(x[:2000], y[:2000])
    phi = bradley_terry._basis(x[:2000], model.mean, model.scale, model.knots)
    better, worse = phi[y[:2000] == 1], phi[y[:2000] == 0]
    lose = 1 / (1 + np.exp((better @ model.weights)[:, None] - worse @ model.weights))
    gradient = (worse.T @ lose.sum(0) - better.T @ lose.sum(1)) / lose.size + 1e-2 * model.weights
    assert np.abs(gradient).max() < 1e-6 and len(bradley_terry.preference_pairs(y[:2000])[0]) == lose.size
    known = spark.createDataFrame([(int(a), *map(float, b)) for a, b in zip(y, x, strict=True)], "label int, " + ", ".join(f"{f} double" for f in bradley_terry.FEATURES)).repartition(5)
    dealt, whole = bradley_terry.train(known), bradley_terry.fit_ranker(x, y)
    assert np.allclose(dealt.weights, whole.weights, atol=1e-6) and np.allclose(dealt.mean, x.mean(0)) and dealt.threshold == pytest.approx(whole.threshold, abs=1e-6)


def test_values_on_either_side_of_a_rank(spark):
    values = [0.5] * 30 + [float(v) for v in np.random.default_rng(5).normal(0, 1, 200)] + [1e9, -1e9, 0.5000000001]
    held = spark.createDataFrame([(v,) for v in values], "s double")
    ordered = sorted(values)
    for rank in (1, 2, 90, ordered.index(0.5), ordered.index(0.5) + 1, ordered.index(0.5) + 30, len(values) - 1):
        assert bradley_terry._either_side(held, rank) == (ordered[rank - 1], ordered[rank])


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.01"])
def test_held_out_accuracy(spark, sf):
    labels = {r.doc_id: r for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    for name, column, least in (("op6_bradley_terry", "quality", 0.9), ("op4_toxicity", "toxic", 0.8)):
        rows = QUERIES[name](spark, sf).collect()
        assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in rows)
        known = [(r.predicted, labels[r.doc_id][column]) for r in rows if r.held_out and r.doc_id in labels]
        assert sum(a == b for a, b in known) / len(known) >= least


# toxicity


def brute_segments(s):
    """All maximal scoring segments by their definition: the best segment, then the same to its left and right."""
    if not len(s) or max(s) <= 0:
        return []
    total = np.concatenate([[0], np.cumsum(s)])
    spans = ((total[j] - total[i], i, j) for i in range(len(s)) for j in range(i + 1, len(s) + 1))
    score, i, j = max(spans, key=lambda x: (round(x[0], 9), -(x[2] - x[1])))
    return brute_segments(s[:i]) + [(i, j, score)] + [(a + j, b + j, c) for a, b, c in brute_segments(s[j:])]


def test_maximal_segments():
    rng = np.random.default_rng(3)
    for _ in range(60):
        s = np.round(rng.normal(-0.2, 1, rng.integers(1, 25)), 3)
        got = sorted((i, j, round(x, 6)) for i, j, x in toxicity.maximal_segments(s))
        want = sorted((i, j, round(float(x), 6)) for i, j, x in brute_segments(s))
        assert [x for _, _, x in got] == [x for _, _, x in want] and got == want


def test_segments_take_time_in_proportion():
    """Twice the text, about twice the time, where each candidate ends lower than the one before."""
    import time

    def seconds(n):
        s = np.tile([1.0, -1.5], n)
        t = time.perf_counter()
        assert len(toxicity.maximal_segments(s)) == n
        return time.perf_counter() - t

    seconds(1000)
    assert min(seconds(40_000) for _ in range(3)) < 8 * min(seconds(10_000) for _ in range(3))


def test_toxic_passages(spark):
    rng = random.Random(5)
    rows, labels = [], []
    for i in range(400):
        toxic = i % 4 == 0
        words = prose(rng, 80, 60).split()
        if toxic:
            words[30:34] = rng.choices(["vile", "foul", "nasty"], k=4)
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    got = toxicity.score_toxicity(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    assert all(r.predicted == (r.doc_id % 4 == 0) for r in got)
    one = next(r for r in got if r.doc_id == 4)
    passage = rows[4][1].encode()[one.passages[0].start : one.passages[0].end].decode().split()
    assert passage and set(passage) <= {"vile", "foul", "nasty"}


TOKEN = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


def hash_of(token):
    return int(toxicity.tokens(np.frombuffer(token, np.uint8), np.array([0, len(token)])).h[0])


def prefix_hash(token, k):
    """The hash of a token's first k characters, as a longer token has it."""
    t = toxicity.tokens(np.frombuffer(token, np.uint8), np.array([0, len(token)]))
    return int(t.prefixes(np.array([0]))[0, toxicity.PREFIXES.index(k)])


def lowered(text):
    return bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode())


def slow_scores(odds, text):
    """A token's own score, else that of its longest beginning that has one, less the drift."""
    table = dict(zip(odds.keys.tolist(), odds.scores.tolist(), strict=True))
    out = []
    for w in TOKEN.findall(lowered(text)):
        tries = [hash_of(w)] + [prefix_hash(w, k) for k in sorted(toxicity.PREFIXES, reverse=True) if len(w.decode()) > k]
        out.append(next((table[h] for h in tries if table.get(h)), 0.0) - odds.drift)
    return out


def test_token_counts_and_odds(spark, texts):
    """The counts of labelled documents and of the corpus, and what follows from them, against plain dictionaries."""
    rows = [(i, t, i % 2) for i, t in enumerate(texts) if t]
    sample = spark.createDataFrame(rows, "doc_id long, text string, label int").repartition(3)
    words, beginnings = toxicity.class_counts(sample)
    want = collections.defaultdict(lambda: [0, 0])
    for _, t, y in rows:
        for w in set(TOKEN.findall(lowered(t))):
            want[w][y] += 1
    assert {r.token: (r.clean, r.toxic) for r in words.collect()} == {int(np.uint64(hash_of(w)).astype(np.int64)): tuple(c) for w, c in want.items()}
    begin = collections.defaultdict(lambda: [0, 0])
    for w, c in want.items():
        for k in toxicity.PREFIXES:
            if len(w.decode()) > k:
                for y in (0, 1):
                    begin[prefix_hash(w, k)][y] += c[y] > 0
    assert {int(np.int64(r.token).astype(np.uint64)): (r.clean, r.toxic) for r in beginnings.collect()} == {h: tuple(c) for h, c in begin.items()}
    vocabulary = np.sort(np.array([hash_of(w) for w in want] + list(begin), np.uint64))
    counts, total = toxicity.corpus_counts(sample.select("doc_id", "text"), vocabulary)
    seen = collections.Counter(w for _, t, _ in rows for w in TOKEN.findall(lowered(t)))
    plain = collections.Counter({hash_of(w): n for w, n in seen.items()})
    for w, n in seen.items():
        for k in toxicity.PREFIXES:
            if len(w.decode()) > k:
                plain[prefix_hash(w, k)] += n
    assert total == sum(seen.values()) and dict(zip(vocabulary.tolist(), counts.tolist(), strict=True)) == plain
    prior = toxicity.PRIOR * np.array([seen[w] for w in want]) / total + toxicity.FLOOR
    n0, n1 = (sum(c[y] for c in want.values()) for y in (0, 1))
    got = toxicity.token_odds(np.array([c[1] * 0 + c[0] for c in want.values()], float), np.array([c[1] for c in want.values()], float), np.array([seen[w] for w in want]), total, n0, n1)
    for g, (c0, c1), p in zip(got, want.values(), prior, strict=True):
        a, b, w = c1 + p, c0 + p, prior.sum()
        x = np.log(a / max(n1 + w - a, toxicity.FLOOR)) - np.log(b / max(n0 + w - b, toxicity.FLOOR))
        assert g == pytest.approx(np.sign(x) * max(abs(x) - toxicity.Z * (1 / a + 1 / b) ** 0.5, 0))


def test_scores_and_evidence_against_a_slow_version(spark):
    """Whole documents, copies next to each other, repeats, compounds, nulls: evidence, passages and scores by the definitions."""
    rng = random.Random(5)
    texts = []
    for i in range(240):
        words = prose(rng, rng.choice([1, 5, 80, 200]), 60).split()
        if i % 3 == 0:
            words[len(words) // 2 : len(words) // 2] = [w + rng.choice(["", "", "ish", "keit"]) for w in rng.choices(["vilest", "Foulness", "näßtier"], k=4)]
        texts += [" ".join(words)] * rng.choice([1, 1, 2])
    texts += ["", None, "vilest", "vilest vilest vilest"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(i, int(bool(re.search("(?i)vile|foul|näß", t or "")))) for i, t in enumerate(texts)], "doc_id long, toxic int")
    model = toxicity.fit_odds(df, labels)
    for r in toxicity.score_toxicity(df, labels).collect():
        s = slow_scores(model, texts[r.doc_id])
        limit = np.log(toxicity.E_VALUE)
        parts = [(i, j, x, np.log(model.k * len(s)) - model.lam * x) for i, j, x in brute_segments(np.array(s))] if s else []
        evidence = -sum(e for *_, e in parts if e < limit)
        assert r.evidence == pytest.approx(evidence) and len(r.passages) == sum(e < limit for *_, e in parts)
        score = 1 / (1 + np.exp(-np.clip(model.slope * (np.log1p(evidence) - model.at), -40, 40)))
        assert r.score == pytest.approx(score) and r.predicted == int(score >= 0.5)
        assert [round(p.score, 6) for p in sorted(r.passages)] == [round(x, 6) for i, j, x, e in sorted(parts) if e < limit]


# substring dedup


def brute_bytes(texts, length=100):
    seen, out = set(), {}
    for i, t in enumerate(texts):
        b = (t or "").encode()
        gone = np.zeros(len(b) + 2, bool)
        for p in range(len(b) - length + 1):
            if b[p : p + length] in seen:
                gone[p + 1 : p + 1 + length] = True
            seen.add(b[p : p + length])
        kept = bytes(x for x, g in zip(b, gone[1:], strict=False) if not g)
        out[i] = (len(b), int(gone.sum()), int((gone[1:] & ~gone[:-1]).sum()), hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("length", [100, 24])
def test_repeated_bytes(docs, texts, length):
    rows = suffix_dedup.remove_repeats(docs, length).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows} == brute_bytes(texts, length)


@pytest.mark.parametrize("rows, size", [(2, 1), (2048, 1 << 12)])
def test_hot_keys_in_parts_give_the_same(docs, texts, rows, size, monkeypatch):
    """Keys dealt to many parts, and shards of few bytes, change nothing."""
    monkeypatch.setattr(anchors, "KEY_ROWS", rows)
    monkeypatch.setattr(suffix_dedup, "SHARD_BYTES", size)
    monkeypatch.setattr(substring_dedup, "GROUP_WINDOWS", size)
    test_repeated_bytes(docs, texts, 100)
    test_repeated_words(docs, texts, 35)


def test_texts_longer_than_a_piece(spark, texts, monkeypatch):
    """Texts are cut to pieces for their runs alone; what is removed is as in whole texts."""
    monkeypatch.setattr(anchors, "PIECE_BYTES", 300)
    monkeypatch.setattr(anchors, "TAKE_BYTES", 200)
    monkeypatch.setattr(suffix_dedup, "TAKE_RUNS", 3)
    long = [" ".join(t or "" for t in texts), *texts[:40], " ".join(t or "" for t in texts[30:])]
    table = spark.createDataFrame(list(enumerate(long)), "doc_id long, text string").repartition(3)
    test_repeated_bytes(table, long, 100)
    test_repeated_words(table, long, 35)


def test_without_a_filter_the_join_does(docs, texts, monkeypatch):
    monkeypatch.setattr(anchors, "FILTER_MOST", 1)
    test_repeated_bytes(docs, texts, 100)
    test_repeated_words(docs, texts, 35)


def test_unlike_texts_of_one_id(spark, texts):
    """They don't stop the operators; each row is judged."""
    table = spark.createDataFrame([(1, texts[60]), (1, texts[0]), (1, None), (2, texts[60] + " " + texts[60])], "doc_id long, text string")
    assert len(suffix_dedup.remove_repeats(table).collect()) == len(substring_dedup.remove_repeats(table).collect()) == 4


def test_suffix_arrays():
    rng = np.random.default_rng(2)
    for text in (b"banana", b"aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", bytes(rng.integers(97, 99, 500, dtype=np.uint8)), b"x"):
        buf = np.frombuffer(text, np.uint8)
        order = suffix_dedup.suffix_array(buf)
        assert order.tolist() == sorted(range(len(text)), key=lambda i: text[i:])
        got = suffix_dedup.common_prefixes(buf, order, 30)
        for k in range(1, len(order)):
            a, b = text[order[k - 1] :], text[order[k] :]
            n = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
            assert got[k] == min(n, 30)


@pytest.mark.parametrize("window", [35, 13])
def test_repeated_words(docs, texts, window):
    words = [WORD.findall(t or "") for t in texts]
    count = collections.Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    for r in substring_dedup.remove_repeats(docs, window).collect():
        w = words[r.doc_id]
        gone = {j for i in range(len(w) - window + 1) if count[tuple(w[i : i + window])] > 1 for j in range(i, i + window)}
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        assert (r.n_words, r.n_removed, r.kept_sha256, r.kept) == (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest(), kept)


# sharding and mixing


def test_shards(docs, texts):
    rows = kd_sharding.shard_documents(docs, 4).collect()
    sizes = collections.Counter()
    for r in rows:
        b = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32) == (len(b) + 1, zlib.crc32(b))
        sizes[r.shard] += r.size
    assert set(sizes) == {0, 1, 2, 3} and max(sizes.values()) < 1.35 * min(sizes.values())
    for s in range(4):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))


def test_texts_stay_whole_if_a_shard_has_room(spark):
    """Of texts of very different weight only that above a shard is cut, and the shards are near equal."""
    rng = random.Random(9)
    heavy = [(prose(rng, 40), n) for n in (1500, 200, 180, 60, 33, 20, 12)]
    texts = [t for t, n in heavy for _ in range(n)] + [prose(rng, 40) for _ in range(600)] * 2
    rows = kd_sharding.shard_documents(spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string").repartition(5)).collect()
    sizes, where = collections.Counter(), collections.defaultdict(set)
    for r in rows:
        sizes[r.shard] += r.size
        where[r.text_crc32, r.size].add(r.shard)
    shard = sum(sizes.values()) / 16
    b = heavy[0][0].encode()
    assert len(sizes) == 16 and max(sizes.values()) < 1.1 * min(sizes.values())
    assert [k for k, s in where.items() if len(s) > 1] == [(zlib.crc32(b), len(b) + 1)] and len(where[zlib.crc32(b), len(b) + 1]) == -(-1500 * (len(b) + 1) // shard)


def brute_tree(units, room):
    """The k-d tree by sorting: [(keys, weight)] -> shard of each."""
    spread = lambda rows, d: (lambda w, total: next(k for k, c in w if c >= 0.95 * total) - next(k for k, c in w if c >= 0.05 * total))(*running(rows, d))

    def running(rows, d):
        total, out = 0, []
        for keys, weight in sorted(rows, key=lambda r: r[0][d]):
            total += weight
            out.append((keys[d] >> 20, total))
        return out, total

    root = {d: max(spread(units, d), 1) for d in units[0][0]}
    found = {}

    def split(rows, first, s):
        if s == 1 or not rows:
            found.update({tuple(sorted(k.items())): first for k, _ in rows})
            return
        d = max(sorted(root), key=lambda x: spread(rows, x) / root[x])
        half, seen, cut = sum(w for _, w in rows) * sum(room[first : first + s // 2]) / sum(room[first : first + s]), 0, 0
        rows = sorted(rows, key=lambda r: r[0][d])
        while seen < half:
            seen += rows[cut][1]
            cut += 1
        split(rows[:cut], first, s // 2)
        split(rows[cut:], first + s // 2, s - s // 2)

    split(units, 0, len(room))
    return found


@pytest.mark.parametrize("room", [[1.0] * 8, [1.0, 3.0, 0.5], [2.0, 1.0, 1.0, 1.0, 0.25]])
def test_the_tree_is_that_of_sorting(spark, room):
    rng = random.Random(41)
    low = rng.sample(range(1 << 19, 1 << 20), 3 * 400)
    units = [({"x": (int(rng.random() ** 2 * 1000) << 20) + low[3 * i], "y": (rng.choice([0, 0, 0, 300, 700]) << 20) + low[3 * i + 1], "z": (rng.randrange(20) << 20) + low[3 * i + 2]}, rng.choice([1, 1, 5, 40])) for i in range(400)]
    df = spark.createDataFrame([(k["x"], k["y"], k["z"], w) for k, w in units], "x long, y long, z long, _weight long").repartition(3)
    got, splits = kd_sharding.split_tree(df, {c: F.col(c) for c in "xyz"}, room)
    assert {(("x", r.x), ("y", r.y), ("z", r.z)): r._node for r in got.collect()} == brute_tree(units, room)
    assert len(splits) == len(room) - 1 and len({x["dimension"] for x in splits}) > 1


def test_places_keep_the_order_of_values(spark):
    names = ["", "a", "a/very/long/head/1", "a/very/long/head/2", "b", "é", "日本"]
    df = spark.createDataFrame([(n, i) for i, n in enumerate(names) for _ in range(3)], "_source string, i int").repartition(4)
    got = {r._source: r._at_source for r in kd_sharding.with_places(df, "_source").collect()}
    assert [got[n] for n in names] == pytest.approx([i / 6 for i in range(7)])


@pytest.mark.parametrize("shards", [1, 3, 7])
def test_any_number_of_shards(docs, shards):
    assert {r.shard for r in kd_sharding.shard_documents(docs, shards).collect()} == set(range(shards))


def brute_targets(sizes, weights=(5, 2, 1), epochs=3.0):
    """By the rule itself: hold what is above, share the rest anew, until none is above."""
    w = {s: weights[i % 3] for i, s in enumerate(sorted(sizes, key=lambda s: (s is None, s)))}
    held, total = {}, sum(sizes.values())
    while True:
        free = [s for s in sizes if s not in held]
        left = total - sum(held.values())
        share = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        above = [s for s in free if share[s] > epochs * sizes[s]]
        if not above:
            return held | share
        held |= {s: epochs * sizes[s] for s in above}


def test_mix(spark):
    rng = random.Random(11)
    counts = {"a": 900, "b": 40, "c": 3, "é": 200, None: 60, "empty": 5}
    rows = [(i, prose(rng, 0 if s == "empty" else rng.randint(1, 90)), s) for i, s in enumerate(s for s, n in counts.items() for _ in range(n))]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix_sources(df).collect()
    assert sorted(got) == sorted(mixing.mix_sources(df.repartition(7)).collect())
    sizes = collections.Counter()
    for _, t, s in rows:
        sizes[s] += len(t.split())
    want = brute_targets(sizes)
    taken = collections.Counter()
    for r in got:
        assert r.target == pytest.approx(want[r.source]) and r.source_size == sizes[r.source] and 0 <= r.taken <= 3 * r.size
        taken[r.source] += r.taken
    for s in counts:
        assert abs(taken[s] - want[s]) <= 0.02 * want[s] + 100
    drawn = {r.doc_id: r.copies for r in got}
    assert collections.Counter(r.doc_id for r in mixing.mixed(df).collect()) == collections.Counter({i: n for i, n in drawn.items() if n})


def test_rows_that_repeat_are_mixed_within_the_cap(spark):
    """Rows with one id, alike and unlike, and null ids; columns named as the operator's own."""
    rng = random.Random(17)
    rows = [(1, "a b c", "s", 7, "x"), (1, "a b c", "s", 7, "x"), (1, "d e", "s", 8, "x"), (None, "f g h", "s", 9, None), (None, None, None, 1, None)]
    rows += [(i, prose(rng, 50), "t", i, "y") for i in range(10, 60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, _n long, size string").repartition(3)
    got = collections.Counter(tuple(r) for r in mixing.mixed(df).collect())
    have = collections.Counter(rows)
    assert set(got) <= set(have) and all(n <= 3 * have[r] for r, n in got.items()) and max(got[r] for r in rows[:4]) == 3 * max(1, have[rows[0]])
    drawn = mixing.mix_sources(df)
    assert sum(got.values()) == drawn.agg(F.sum("copies")).first()[0] and drawn.filter("copies > 3").count() == 0


def test_one_row_of_each_group_stays(spark):
    """Null ids, ids that repeat with like and unlike texts, and columns named as the operator's own."""
    base = " ".join(f"b{k}" for k in range(60))
    near, other = base.replace("b59", "c"), " ".join(f"o{k}" for k in range(30))
    rows = [(5, base, 1), (5, base, 2), (5, other, 3), (7, near, 4), (None, base, 5), (None, "lone one text that no other row has here", 6), (None, "lone one text that no other row has here", 7), (8, "", 8), (9, None, 9), (None, "", 10)]
    df = spark.createDataFrame(rows, "doc_id long, text string, like long").repartition(4)
    got = sorted(ngram_join.keep_one(df).collect(), key=lambda r: r.like)
    assert got[0]._fields if hasattr(got[0], "_fields") else got[0].__fields__ == ["doc_id", "text", "like"]
    assert [r.like for r in got] == [1, 3, 6, 8, 9, 10]


# leaks and tokens


def test_leaks(spark):
    rng = random.Random(13)
    items = [prose(rng, n, 5000) for n in (15, 40, 59)] + ["only four words here", "", None]
    edited = items[1].split()
    edited[20] = "changed"
    texts = [prose(rng, 50, 5000) + " " + items[0].upper() + " " + prose(rng, 50, 5000), prose(rng, 30, 5000) + " " + " ".join(edited) + " tail", items[2], prose(rng, 400, 5000), items[0].rsplit(" ", 6)[0], "", None, "only four words here"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.similarity for r in decontaminate.find_leaks(df, bench).collect()}
    assert got[0, 0] == 1.0 and got[2, 2] == 1.0 and got[7, 3] == 1.0 and set(got) <= {(0, 0), (1, 1), (2, 2), (7, 3)}
    assert ((1, 1) in got) == (31 / 41 >= 0.8)
    assert {r.doc_id for r in decontaminate.drop_leaks(df, bench).collect()} == set(range(8)) - {d for d, _ in got}


def test_leaks_with_parts_in_another_order(spark):
    rng = random.Random(29)
    item = [f"i{k}" for k in range(100)]
    around = lambda w: " ".join([*prose(rng, 50, 5000).split(), *w, *prose(rng, 50, 5000).split()])
    texts = [around(item[50:] + item[:50]), around(item[20:] + item[:20]), around(item[70:] + item[:70]), around(item[:50])]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame([(0, " ".join(item))], "item_id long, text string")
    got = {r.doc_id: (round(r.similarity, 3), r.first_word) for r in decontaminate.find_leaks(df, bench).collect()}
    assert got == {d: (0.92, 50) for d in range(3)}
    assert [r.doc_id for r in decontaminate.drop_leaks(df, bench).collect()] == [3]


@pytest.mark.parametrize("times", [5, 8, 10])
def test_leaks_with_a_shingle_that_repeats(times):
    """The item has one shingle ``times`` over that the document has once."""
    import pyarrow as pa

    missed = 0
    for k in range(20):
        # a run of one word has times equal shingles
        body = [f"r{k}x{i}" for i in range(99)]
        item, text = ["run"] * (times + 4) + body, ["run"] * 5 + body
        items = decontaminate.Items([0], [" ".join(item)])
        found = dict(decontaminate._searches(pa.RecordBatch.from_arrays([pa.array([" ".join(text).encode()], pa.binary())], ["text"]), 0, items))
        bags = [collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) for w in (item, text)]
        want = sum((bags[0] & bags[1]).values()) / sum((bags[0] | bags[1]).values())
        assert want >= 0.8
        missed += 0 not in found.get(0, {}) or found[0][0][0] != pytest.approx(want)
    assert missed == 0


@pytest.mark.parametrize("entries", [300, 4000])
def test_multi_index_finds_all_within_the_radius(entries):
    """With fewer entries than values near one, and with more."""
    rng = np.random.default_rng(5)
    blocks = rng.integers(0, 1 << 16, (entries, decontaminate.BLOCKS), dtype=np.uint16)
    windows = blocks[:8].copy()
    for k, n in enumerate((0, 20, 60, 78, 79, 80, 90, 120)):
        bits = np.unpackbits(windows[k].astype(">u2").view(np.uint8))
        bits[rng.choice(256, n, replace=False)] ^= 1
        windows[k] = np.packbits(bits).view(">u2")
    distance = np.bitwise_count(windows[:, None] ^ blocks[None]).sum(axis=2)
    want = set(zip(*(x.tolist() for x in np.nonzero(distance <= decontaminate.RADIUS)), strict=True))
    assert set(zip(*(x.tolist() for x in decontaminate.Prints(blocks).within(windows)), strict=True)) == want


def test_fingerprints_of_all_windows():
    """Running sums give each window what its own bag has, with shingles that repeat."""
    rng = np.random.default_rng(6)
    for n, kinds, size in ((60, 1000, 20), (60, 4, 15), (40, 1, 12), (9, 3, 9)):
        shingles = textcore.mix(rng.integers(0, kinds, n).astype(np.uint64))
        starts = np.unique(rng.integers(0, n - size + 1, 12))
        got = decontaminate.window_prints(shingles, starts, size)
        assert got.tolist() == [decontaminate.fingerprint(shingles[s : s + size]).tolist() for s in starts]


def test_no_window_above_the_similarity_is_lost(spark):
    """All windows of all documents against all items, edited, cut, with words that repeat, next to what the operator finds."""
    rng = random.Random(31)
    items = [prose(rng, rng.choice([5, 8, 15, 15, 40, 60, 61]), rng.choice([12, 300, 3000])) for _ in range(40)]
    texts = []
    for _ in range(220):
        w = rng.choice(items).split()
        for _ in range(rng.choice([0, 0, 1, 1, 2, 4])):
            k = rng.randrange(len(w))
            w[k : k + rng.choice([0, 1, 1])] = [rng.choice(["new", w[k]])]
        cut = rng.choice([0, 0, 0, 2, 5])
        texts.append(" ".join([*prose(rng, rng.choice([0, 3, 40]), 300).split(), *w[cut:], *prose(rng, rng.choice([0, 3, 40]), 300).split()]))
    grams = lambda w: collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else collections.Counter([tuple(w)] if w else [])
    want = {}
    for d, t in enumerate(texts):
        words = t.split()
        for i, item in enumerate(items):
            own = grams(item.split())
            n = min(len(item.split()), len(words))
            best = max(sum((x & own).values()) / sum((x | own).values()) for x in (grams(words[f : f + n]) for f in range(len(words) - n + 1)))
            if best >= 0.8:
                want[d, i] = pytest.approx(best)
    df, bench = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    assert {(r.doc_id, r.item_id): r.similarity for r in decontaminate.find_leaks(df, bench).collect()} == want and len(want) > 80


def test_items_in_blocks_and_ids_of_text(spark, monkeypatch):
    rng = random.Random(33)
    items = [prose(rng, 30, 4000) for _ in range(12)]
    df = spark.createDataFrame([(f"d{i}", prose(rng, 9) + " " + t) for i, t in enumerate(items)] + [("none", prose(rng, 50)), (None, items[0])], "doc_id string, text string")
    bench = spark.createDataFrame([(f"i{i}", t) for i, t in enumerate(items)], "item_id string, text string")
    whole = sorted(map(str, decontaminate.find_leaks(df, bench).collect()))
    monkeypatch.setattr(decontaminate, "ITEM_WORDS", 50)
    assert sorted(map(str, decontaminate.find_leaks(df, bench).collect())) == whole and len(whole) == 13
    assert [r.doc_id for r in decontaminate.drop_leaks(df, bench).collect()] == ["none"]


def test_tokens_are_those_of_the_library(spark, docs, texts):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer_path())
    extra = ["don't I'LL they're", "a<|endoftext|>b <|startoftext|>", "İ ΑΣ ß ﬁ é", "x\x1cy\x85z\x00", "１２ ½ 日本語", "😀 a😀b"]
    every = texts + extra
    df = spark.createDataFrame(list(enumerate(every)), "doc_id long, text string")
    for r in token_counts.count_tokens(df, tokenizer_path(), 100).collect():
        t = every[r.doc_id] or ""
        n = len(library.encode(t, add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(t.encode()), n, n > 100)


def test_a_small_word_table_is_enough():
    tokenizer = token_counts._load(tokenizer_path())
    whole = token_counts.prove_whole_tokens(tokenizer)
    text = " ".join(f"word{i} thing{i}" for i in range(200)).encode()
    assert token_counts.WordCounter(tokenizer, whole, 16).count(text) == token_counts.WordCounter(tokenizer, whole).count(text)


# kernels


def test_words_and_windows():
    texts = ["ab  cd\te", "", " x y", "long" * 9 + " z"]
    import pyarrow as pa

    (_, _, buf, bounds), = textcore.slices(pa.array([t.encode() for t in texts], pa.binary()))
    starts, ends, per = textcore.find_words(buf, bounds)
    got = [[bytes(buf[a:b]).decode() for a, b in zip(starts[per[d] : per[d + 1]], ends[per[d] : per[d + 1]], strict=True)] for d in range(4)]
    assert got == [WORD.findall(t) for t in texts]
    v = np.random.default_rng(1).integers(0, 50, 300).astype(np.uint64)
    for w in (1, 2, 7, 300):
        assert textcore.window_minimum(v, w).tolist() == [v[i : i + w].min() for i in range(300 - w + 1)]
    h = textcore.run_hashes(np.tile(v[:50], 3), 35)
    assert (h[:50] == h[50:100]).all() and len(np.unique(h[:50])) == 50


def test_intermediate_tables_are_one_file_a_task(spark, tmp_path):
    from pathlib import Path

    from lakeferry.runtime import materialize

    given = spark.range(100, numPartitions=3)
    held = materialize(given, "plain", plain=True)
    (path,) = {Path(f.removeprefix("file:")).parent for f in held.inputFiles()}
    assert held.exceptAll(given).isEmpty() and held.count() == 100
    # no files of checksums, each of which costs the executor a process
    assert sorted(x.suffix for x in path.iterdir() if x.name != "_SUCCESS") == [".parquet"] * 3
    given.write.parquet(f"file://{tmp_path}/t")
    assert any(x.suffix == ".crc" for x in (tmp_path / "t").iterdir())  # others' tables are written as ever
