"""Language, quality, near-duplicates, mixing and sharding, against brute force and held-out labels."""

import itertools
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from wavemill.llm import hamming_search, language_id, mixing, near_dedup, quality, sharding, url_rules
from wavemill.llm.queries import PLACES, QUERIES, table

SF = "/root/testdata/sf0.01"
WORD = re.compile(rb"[^\x20\x09-\x0D]+")


# --- language

def test_language_accuracy_on_held_out_rows(spark):
    docs = table(spark, SF, "documents")
    train, rest = docs.where("doc_id % 2 = 0"), docs.where("doc_id % 2 = 1")
    model = language_id.train_trigrams(train, "text", "lang")
    got = language_id.identify(rest, model, ["doc_id"]).collect()  # text alone: nothing declared, no host
    truth = {r.doc_id: r.lang for r in rest.collect()}
    assert np.mean([r.language == truth[r.doc_id] for r in got if r.kept]) > 0.98
    assert np.mean([r.kept for r in got]) > 0.97


def test_fused_posterior_matches_brute_force(spark):
    rows = [(i, t, d, h) for i, (t, d, h) in enumerate(
        [("the river", "en", "a.x.org"), ("la casa", "es", "b.x.org"), ("la", None, "a.x.org"), ("the", "es", None), ("casa casa", "en", "plain"), ("7", "en", "a.x.org")]
    )]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, declared string, host string")
    train = spark.createDataFrame([("the river the stone", "en"), ("la casa la mesa", "es")], "text string, lang string")
    langs, grams = language_id.train_trigrams(train, "text", "lang")
    got = {r.doc_id: r for r in language_id.identify(docs, (langs, grams), ["doc_id"], "text", F.col("declared"), F.col("host")).collect()}

    def softmax(x):
        e = np.exp(x - np.max(x))
        return e / e.sum()

    text = {}
    for i, t, _d, _h in rows:
        g = language_id.trigrams(t.encode())
        if len(g):
            text[i] = grams[g].sum(axis=0, dtype=np.float64) * min(1, language_id.TEMPER / len(g))
    weight = {i: softmax(x) for i, x in text.items()}
    k = language_id.STRENGTH

    def smooth(which, prior):
        n = sum((weight[i] for i in which if i in weight), np.zeros(len(langs)))
        return (n + k * prior) / (n.sum() + k)

    ground = smooth(weight, np.full(len(langs), 1 / len(langs)))
    domain = lambda h: ".".join(h.split(".")[-2:]) if h and "." in h else None
    for i, t, d, h in rows:
        if i not in text:
            assert got[i].language is None and not got[i].kept
            continue
        above = smooth([j for j, *_x, g in rows if domain(g) == domain(h)], ground) if domain(h) else ground
        x = text[i] + np.log(smooth([j for j, *_x, g in rows if g == h], above) if h else ground)
        if d:
            x = x + np.log(smooth([j for j, _t, e, _g in rows if e == d], ground) / ground)
        if domain(h):
            x = x + np.log(smooth([j for j, *_x, g in rows if g and g.endswith(".org")], ground) / ground)
        p = softmax(x)
        assert got[i].language == langs[p.argmax()] and got[i].confidence == pytest.approx(p.max(), rel=1e-5)


def test_every_language_is_sampled(spark):
    """A rare language, and one whose copies alone would fill the sample."""
    rows = [(f"the river {i} stone{i}", "en") for i in range(400)] + [("sur la table", "fr")] * 300 + [("der fluss", "De"), ("1 2", "xx"), (None, "yy")]
    train = spark.createDataFrame(rows, "text string, lang string").repartition(7)
    langs, table_ = language_id.train_trigrams(train, "text", "lang", sample=20)
    assert langs == ["de", "en", "fr"]
    hashes = {r.text: r.h for r in train.where("text IS NOT NULL").select("text", F.xxhash64(F.col("text").cast("binary")).alias("h")).collect()}
    first = sorted((t for t, lang in rows if lang == "en"), key=hashes.get)[:20]
    for lang, texts in (("en", first), ("fr", ["sur la table"]), ("de", ["der fluss"])):
        n = np.full(1 << language_id.TRIGRAM_BITS, 0.05)
        for t in texts:
            np.add.at(n, language_id.trigrams(t.encode()), 1)
        assert np.allclose(table_[:, langs.index(lang)], np.log(n / n.sum()), atol=1e-5)


def test_language_of_odd_rows(spark, odd_docs, no_docs):
    model = language_id.train_trigrams(odd_docs, "text", "lang")
    got = language_id.identify(odd_docs, model, ["doc_id"], "text", F.col("lang"), F.col("source")).collect()
    assert len(got) == odd_docs.count() and all(not r.kept for r in got if r.doc_id in (1, 2, 3))
    assert len({(r.language, r.confidence) for r in got if r.doc_id == 4}) == 1
    assert language_id.identify(no_docs, model, ["doc_id"]).count() == 0
    untrained = language_id.train_trigrams(no_docs, "text", "lang")
    assert all(r.language is None and r.kept is False for r in language_id.identify(odd_docs, untrained, ["doc_id"]).collect())


# --- quality

def slow_counts(text):
    data = (text or "").encode()
    words = [w.decode() for w in WORD.findall(data)]
    lines = [x for x in (text or "").split("\n") if WORD.search(x.encode())]
    times = Counter(zip(words, words[1:], words[2:]))
    inside = {i + k for i in range(len(words) - 2) if times[tuple(words[i : i + 3])] > 1 for k in range(3)}
    symbols = sum(map((text or "").count, "#*$%&|<>")) if words else 0
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(inside)


def test_counts_match_brute_force(spark, odd_docs):
    docs = table(spark, SF, "documents").select("doc_id", "text").unionByName(odd_docs.select("doc_id", "text"))
    docs = docs.unionByName(spark.createDataFrame([(70, "a b a b a b\n\nx\nx\n \n"), (71, "\x1c  #$  |"), (72, "a a a a")], "doc_id bigint, text string"))
    texts = defaultdict(list)
    for r in docs.collect():
        texts[r.doc_id].append(slow_counts(r.text))
    got = defaultdict(list)
    for r in quality.document_counts(docs).collect():
        got[r.doc_id].append(tuple(r[c] for c in quality.COUNTS))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in texts.items()}


def test_repeats_with_very_many_distinct_words(monkeypatch):
    ids = np.array([5, 6, 7, 8, 5, 6, 7, 1, 5, 6, 2])
    want = quality.repeated_words(ids, 9)
    assert want == 6 and quality.repeated_words(ids, 1 << 21) == want


def test_held_out_quality(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    counted = quality.document_counts(docs)
    trees = quality.fit(counted, labels.where("doc_id % 2 = 0"))
    judged = quality.judge(counted, trees).join(labels.where("doc_id % 2 = 1"), "doc_id").where("NOT base_failed").collect()
    assert np.mean([r.kept == bool(r.quality) for r in judged]) > 0.95


def test_trees_are_monotonic_and_flat_scoring_agrees():
    r = np.random.default_rng(0)
    x = r.random((600, 3))
    y = ((x[:, 0] + 0.3 * x[:, 1] + 0.2 * r.normal(size=600)) < 0.6).astype(float)
    trees = quality.train(x, y, [-1, 1, 0], rounds=20)
    line = np.linspace(0, 1, 200)
    for at in r.random((20, 3)):
        for f, direction in ((0, -1), (1, 1)):
            rows = np.repeat(at[None], 200, axis=0)
            rows[:, f] = line
            assert (np.diff(trees.score(rows)) * direction >= -1e-12).all()

    def walk(row):
        total = trees.base
        for node in trees.roots:
            while trees.feature[node] >= 0:
                node = trees.left[node] if row[trees.feature[node]] <= trees.threshold[node] else trees.right[node]
            total += trees.value[node]
        return total

    assert np.allclose(trees.score(x[:50]), [walk(row) for row in x[:50]])
    assert ((trees.score(x) > 0) == (y > 0)).mean() > 0.8


def test_quality_of_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(4, 1, 0), (4, None, 0), (8, 0, 0), (None, 0, 0)], "doc_id bigint, quality int, toxic int")
    got = quality.quality_rules(odd_docs, labels).collect()
    assert len(got) == odd_docs.count() and all(r.base_failed and not r.kept for r in got if r.doc_id in (1, 2, 3))
    assert quality.quality_rules(no_docs, labels).count() == 0
    unlabelled = quality.quality_rules(odd_docs, labels.where("false")).collect()
    assert all(r.kept == (not r.base_failed) and r.score is None for r in unlabelled)


# --- near-duplicates

def slow_groups(texts, width, percent):
    """Component and set size of (id, text) rows by comparing all pairs."""
    sets = []
    for _, t in texts:
        w = [x.lower() for x in WORD.findall((t or "").encode())]
        sets.append({tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set())
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in itertools.combinations(range(len(texts)), 2):
        a, b = sets[i], sets[j]
        if texts[i][0] == texts[j][0] or (a and b and 100 * len(a & b) >= percent * len(a | b)):
            root[find(j)] = find(i)
    least = defaultdict(lambda: 1 << 62)
    for i, (key, _) in enumerate(texts):
        least[find(i)] = min(least[find(i)], key)
    return {(key, len(sets[i]), least[find(i)]) for i, (key, _) in enumerate(texts)}


@pytest.mark.parametrize("width", [2, 5])
def test_groups_match_all_pairs(spark, width):
    docs = table(spark, SF, "documents").select("doc_id", "text")
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(docs, width=width).collect()}
    assert got == slow_groups([tuple(r) for r in docs.collect()], width, 80)


def test_chains_stars_and_borders(spark):
    """Chains whose ends are far apart, tight groups beside each other, sets at exactly 80 %."""
    r = np.random.default_rng(1)
    texts, n = [], 0

    def add(words):
        nonlocal n
        texts.append((n, " ".join(words)))
        n += 1

    base = [f"w{i}" for i in range(120)]
    for step in range(25):  # every link loses two words and gains two
        add([f"z{step}{i}" for i in range(2 * step)] + base[2 * step :])
    for g in range(3):  # groups that share most of their text, not enough for a link
        for _ in range(12):
            own = [f"g{g}x{i}" for i in range(30)]
            words = [f"c{i}" for i in range(70)] + own
            words[int(r.integers(100))] = f"e{n}"
            add(words)
    for cut in range(18, 30):
        add([f"b{i}" for i in range(100 - cut)])
    order = r.permutation(n).tolist()
    rows = [(order[i], t) for i, t in texts]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(docs, width=2).collect()}
    assert got == slow_groups(rows, 2, 80)


def test_links_at_exactly_the_bound(spark):
    """Y is the union of X and Z, each 80 % of it: their distance is the sum of the two links' distances."""
    rows = []
    for g in range(24):
        words = [f"u{g}x{i}" for i in range(11)]
        rows += [(3 * g, " ".join(words[:9])), (3 * g + 1, " ".join(words[2:])), (3 * g + 2, " ".join(words))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in near_dedup.near_duplicates(docs, width=2).collect()}
    assert got == slow_groups(rows, 2, 80)


def test_groups_of_odd_rows(odd_docs, no_docs):
    got = near_dedup.near_duplicates(odd_docs).collect()
    assert len(got) == odd_docs.count()
    by_id = defaultdict(set)
    for r in got:
        by_id[r.doc_id].add((r.component_id, r.kept))
    assert by_id[4] == {(4, True)} and by_id[10] == {(4, False)} and by_id[1] == {(1, True)} and by_id[None] == {(None, False)}
    assert near_dedup.near_duplicates(no_docs).count() == 0


def test_superminhash_estimates_with_less_variance():
    r = np.random.default_rng(2)
    for size, shared in ((12, 8), (200, 150)):
        found = []
        for _ in range(80):
            pool = r.integers(0, 1 << 62, 2 * size).astype(np.uint64)
            a, b = np.unique(pool[:size]), np.unique(np.concatenate([pool[:shared], pool[size : 2 * size - shared]]))
            s = near_dedup.signatures([a, b])
            found.append((s[0] == s[1]).mean())
        j = shared / (2 * size - shared)
        assert abs(np.mean(found) - j) < 0.02 and np.std(found) < math.sqrt(j * (1 - j) / near_dedup.PLACES)


def test_signature_places_are_permutations():
    """One element: its step at every place is another, and all are taken."""
    s = near_dedup.signatures([np.array([123456789], np.uint64)])[0]
    assert sorted((s >> np.uint64(32)).tolist()) == list(range(near_dedup.PLACES))


# --- mixing

def slow_targets(sizes, weights=(3, 1, 2), budget=1.5, most=2):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, free, left = {}, set(names), budget * sum(sizes.values())
    while free:
        total = sum(weight[s] for s in free)
        over = {s for s in free if weight[s] * left / total > most * sizes[s]}
        if not over:
            return target | {s: weight[s] * left / total for s in free}
        for s in over:
            target[s] = float(most * sizes[s])
            left -= target[s]
        free -= over
    return target


def test_mix_meets_its_targets(spark, odd_docs):
    docs = table(spark, SF, "documents").select("doc_id", "text", "source").unionByName(odd_docs.select("doc_id", "text", "source"))
    rows = mixing.mix(docs).collect()
    assert len(rows) == docs.count()
    sizes, taken, target = Counter(), Counter(), {}
    for r in rows:
        sizes[r.source] += r["size"]
        taken[r.source] += r.taken
        target[r.source] = r.target
        assert 0 <= r.taken <= 2 * r["size"]
        assert r.taken == sum(c.words for c in r.copies)
    want = slow_targets(sizes)
    for s in sizes:
        assert target[s] == pytest.approx(want[s]) and taken[s] == math.floor(target[s] + 0.5)
    again = sorted((str(r.doc_id), r["size"], r.taken) for r in mixing.mix(docs.repartition(5)).collect())
    assert again == sorted((str(r.doc_id), r["size"], r.taken) for r in rows)


def test_sizes_match_the_word_rule(spark, odd_docs):
    got = sorted((str(r.doc_id), r["size"]) for r in mixing.mix(odd_docs).collect())
    assert got == sorted((str(r.doc_id), len(WORD.findall((r.text or "").encode()))) for r in odd_docs.collect())


def test_split_quotas_are_exact_and_even(spark):
    quotas = {0: 7, 1: 300, 2: 0, 3: 41}
    df = spark.createDataFrame(list(quotas.items()), "place int, quota bigint")
    rows = mixing.split_quotas(df, 8).collect()
    by_shard, by_place = Counter(), Counter()
    for r in rows:
        by_shard[r.shard] += r.n
        by_place[r.place] += r.n
    assert dict(by_place) == quotas and len(by_shard) == 8
    assert max(by_shard.values()) - min(by_shard.values()) <= 2 and sum(by_shard.values()) == 348
    for p in quotas:
        ordered = sorted((r.shard, r.n, r.before) for r in rows if r.place == p)
        assert [b for _, _, b in ordered] == [sum(n for _, n, _ in ordered[:i]) for i in range(8)]


def test_hypergeometric_draws_follow_the_law(spark):
    total, marked, drawn = 30, 11, 9
    df = spark.range(4000).select(F.lit(total).alias("t"), F.lit(marked).alias("m"), F.lit(drawn).alias("d"), ((F.col("id") + 0.5) / 4000).alias("u"))
    got = Counter(r[0] for r in df.select(mixing.hypergeometric(F.col("t"), F.col("m"), F.col("d"), F.col("u"))).collect())
    for k in range(drawn + 1):
        p = math.comb(marked, k) * math.comb(total - marked, drawn - k) / math.comb(total, drawn)
        assert abs(got[k] / 4000 - p) < 1 / 2000


def test_mixed_documents_are_whole_copies(spark, odd_docs, no_docs):
    rows = mixing.mixed_documents(odd_docs)
    assert rows.columns == odd_docs.columns
    plan = mixing.mix(odd_docs)
    words = rows.select(mixing.word_count().alias("n"), "source").groupBy("source").agg(F.sum("n").alias("n")).collect()
    taken = plan.groupBy("source").agg(F.sum("taken").alias("n")).where("n > 0").collect()
    assert {(r.source, r.n) for r in words} == {(r.source, r.n) for r in taken}
    assert mixing.mix(no_docs).count() == 0 and mixing.mixed_documents(no_docs).count() == 0


def test_cut_copies_keep_their_layout_and_columns(spark):
    """Starts of texts as they were, repeated rows, columns that carry the names used inside."""
    lines = ["one\n\ttwo  three\r\n", " four five\n\nsix", "seven\neight\x0bnine ten "]
    rows = [(i % 40, lines[i % 3] * (1 + i % 5), "a" if i % 3 else None) for i in range(240)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    names = ("h", "block", "draws", "cut", "row", "shard", "slot_key", "words", "__h", "__key", "drawn", "place")
    docs = docs.select("*", *[F.lit(n).alias(n) for n in names])
    got = mixing.mixed_documents(docs).collect()
    assert {tuple(r[n] for n in names) for r in got} == {names}
    whole = {(r[0], r[1], r[2]) for r in rows}
    cut = [r for r in got if (r.doc_id, r.text, r.source) not in whole]
    assert cut and all(any(t.startswith(r.text) and i == r.doc_id and s == r.source for i, t, s in whole) and not r.text[-1].isspace() for r in cut)
    copies = Counter((r.doc_id, r.source, r.taken, c.words) for r in mixing.mix(docs).collect() for c in r.copies)
    assert sum(copies.values()) == len(got)
    assert Counter(w for _, _, _, w in copies.elements()) == Counter(len(WORD.findall(r.text.encode())) for r in got)


def test_mixed_documents_lie_by_shard_and_key(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    want = sorted((s, k, r.doc_id) for r in QUERIES["op8_source_mix"](spark, "/root/testdata/sf0.001").collect() for s, k in zip(r.shards, r.slot_keys, strict=True))
    assert [r.doc_id for r in mixing.mixed_documents(docs).collect()] == [d for _, _, d in want]


# --- sharding

def test_shards_follow_weights_and_grow_only_into_the_new(spark):
    keys = np.arange(60_000, dtype=np.uint64)
    tree = sharding.balanced_tree(24)
    before, after = sharding.place(keys, tree), sharding.place(keys, sharding.grown(tree))
    assert set(after[before != after]) == {24} and abs((after == 24).mean() - 1 / 25) < 0.005
    assert abs(np.bincount(before, minlength=24) / 2500 - 1).max() < 0.1


def test_weight_change_moves_only_to_and_from_that_subtree():
    def tree(w):
        rack = lambda n, *s: sharding.Node(n, children=s)
        leaf = lambda s, w=1.0: sharding.Node(s, w, s)
        return sharding.Node(0, children=(rack(0, rack(0, leaf(0), leaf(1, w)), rack(1, leaf(2), leaf(3))), rack(1, rack(0, leaf(4), leaf(5)))))

    keys = np.arange(40_000, dtype=np.uint64)
    a, b = sharding.place(keys, tree(1.0)), sharding.place(keys, tree(3.0))
    moved = a != b
    stays_out = moved & ~np.isin(b, [0, 1, 2, 3])  # nothing enters the other region
    assert moved.any() and not stays_out.any()
    within = moved & np.isin(a, [0, 1, 2, 3])  # inside the region all moves lead into the rack whose weight rose
    assert set(b[within]) <= {0, 1} and abs((b == 1).mean() - 3 / 8) < 0.01


def test_sharding_of_odd_rows(spark, odd_docs, no_docs):
    tree = sharding.balanced_tree(24)
    placed = sharding.number_slots(sharding.shard_rows(odd_docs, "doc_id", {"shard": tree}).drop("slot"), "shard", ["doc_id"]).collect()
    assert len(placed) == odd_docs.count()
    for s in {r.shard for r in placed}:
        assert sorted(r.slot for r in placed if r.shard == s) == list(range(sum(r.shard == s for r in placed)))
    assert sharding.shard_rows(no_docs, "doc_id", {"shard": tree}).count() == 0


def test_sharding_query_digests(spark):
    docs = {r.doc_id: r.text or "" for r in table(spark, SF, "documents").collect()}
    for r in QUERIES["op9_sharding"](spark, SF).collect():
        assert r["size"] == len(docs[r.doc_id].encode()) + 8 and r.text_crc32 == zlib.crc32(docs[r.doc_id].encode())
        assert r.grown_shard in (r.shard, 24)


# --- URL rules

def test_rules_match_brute_force(spark):
    urls = [
        "http://a.org", "http://a.org/", "http://example.org/en/15", "http://x.EXAMPLE.org/en/2", "http://example.org/es/1?q", "http://notexample.org/es/1",
        "https://m.com/fr/1#x", "https://com/de/", "ftp://com.net/de/", None, "", "no scheme/fr/", "http://a.net/login?x", "http://a.net/blogin", "http://a.net/x.JPG",
        "http://a.net/?a=1&sid=3", "http://m.ads-track.example.com/fr/1", "http://ads-track.example.net/", "://", "http://org/x", "http://a.com/FR/", "http://u@b.org/é",
        "http://a.net/p#://b.org/", "http://a.org?x", "http://b.example.org/en/1\nx",
    ]
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)] + [(None, urls[0], "y")], "page_id bigint, url string, verdict string")
    rules = (*PLACES, *url_rules.PATTERNS)
    got = url_rules.judge_urls(pages, rules).collect()
    assert len(got) == len(urls) + 1
    for r in got:
        url = urls[r.page_id or 0] or ""
        host, path = url_rules.address(url)
        assert (r.host, r.path) == (host, path)
        fits = [p for p in PLACES if (host == (h := p.name.split("/")[0]) or host.endswith("." + h)) and path.startswith(p.name[len(h) :])]
        best = max(fits, key=lambda p: len(p.name), default=None)
        lowered = "".join(c.lower() if c.isascii() else c for c in url)
        hits = sorted(p.name for p in url_rules.PATTERNS if re.search(p.pattern, lowered, re.S))
        assert r.rule == (best and best.name) and r.pattern == (hits[0] if hits else None)
        assert r.verdict == (best.verdict if best else "block" if hits else "allow")
    assert url_rules.judge_urls(pages.where("false"), rules).count() == 0


def test_index_files_rules_under_their_rarest_token():
    rules = (url_rules.place_rule("block", "example.org/en/1"), url_rules.Rule("any", "block", "x", ()))
    assert rules[0].literals == ("example", "org", "en")
    assert url_rules.index_rules(rules, {"example": 5, "org": 3, "en": 9}) == {"org": [0], "": [1]}


# --- nearest neighbours

def test_recall_and_scores(spark):
    table_ = table(spark, SF, "embeddings")
    rows = table_.select("vec_id", "embedding").collect()
    ids, vectors = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], np.float64)
    got = defaultdict(list)
    for r in hamming_search.nearest(table_, every=20).orderBy("query_id", "rank").collect():
        got[r.query_id].append(r.vec_id)
        assert r.score == pytest.approx(np.linalg.norm(vectors[ids == r.query_id][0] - vectors[ids == r.vec_id][0]), rel=1e-12)
    want = dict(hamming_search.exact_nearest(ids, vectors, 20))
    assert set(got) == set(want)
    assert np.mean([len(set(got[q]) & set(want[q])) / 10 for q in want]) >= 0.9


def test_probing_finds_every_code_in_the_radius():
    r = np.random.default_rng(0)
    codes = r.integers(0, 256, (3000, 8), dtype=np.uint8)
    codes[:200] = codes[0] ^ np.packbits(r.random((200, 64)) < 0.15, axis=1)
    index = hamming_search.BlockIndex(codes)
    for radius in (0, 3, 7, 8, 15, 22, 29, 64):
        apart = np.bitwise_count(codes ^ codes[0]).sum(axis=1)
        assert index.within(codes[0], radius).tolist() == np.flatnonzero(apart <= radius).tolist()


def test_recall_beyond_the_fitted_sample(spark, monkeypatch):
    """Clustered rows, four times as many as train the rotation, in several blocks of rows and of queries."""
    monkeypatch.setattr(hamming_search, "SAMPLE", 1000)
    monkeypatch.setattr(hamming_search, "QUERY_BLOCK", 20)
    monkeypatch.setattr(hamming_search, "ROW_BLOCK", 1500)
    r = np.random.default_rng(3)
    vectors = r.standard_normal((40, 24))[r.integers(0, 40, 4000)] + 0.4 * r.standard_normal((4000, 24))
    ids = np.arange(4000)
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, vectors)], "vec_id bigint, embedding array<double>")
    got = defaultdict(list)
    for row in hamming_search.nearest(df.repartition(5)).orderBy("query_id", "rank").collect():
        got[row.query_id].append(row.vec_id)
    want = dict(hamming_search.exact_nearest(ids, vectors))
    assert {q: len(v) for q, v in got.items()} == {q: 10 for q in want}
    assert np.mean([len(set(got[q]) & set(want[q])) / 10 for q in want]) >= 0.9


def test_repeated_ids_and_other_lengths(spark):
    rows = [(100, [1.0, 0.0])] * 3 + [(100, [5.0, 5.0]), (7, [1.0, 0.1]), (7, [1.0, 0.1]), (8, [4.0, 5.0])]
    rows += [(200, [1.0, 1.0, 1.0]), (201, [1.0, 1.0, 2.0]), (300, [2.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").repartition(4)
    got = sorted((r.query_id, r.rank, r.vec_id, round(r.score, 9)) for r in hamming_search.nearest(df, k=4).collect())
    want = []
    for at, (q, v) in enumerate(rows):
        if q % 100 == 0:
            near = sorted((float(np.linalg.norm(np.subtract(v, w))), i) for other, (i, w) in enumerate(rows) if other != at and len(w) == len(v))
            want += [(q, place, i, round(s, 9)) for place, (s, i) in enumerate(near[:4], 1)]
    assert got == sorted(want)


def test_odd_vectors_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.1]), (2, [0.0, 0.0]), (3, None), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]), (7, [1.0, 0.1]), (8, [1.0, 2.0, 3.0]), (None, [1.0, 0.0]), (100, [0.0, 1.0])]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id bigint, embedding array<float>, id string, rank int")
    got = [(r.query_id, r.rank, r.vec_id) for r in hamming_search.nearest(df).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1), (0, 2, 7), (0, 3, 100), (100, 1, 1), (100, 2, 7), (100, 3, 0)]
    assert hamming_search.nearest(df.where("false")).count() == 0
