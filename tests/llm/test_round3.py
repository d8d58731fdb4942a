"""Decontamination, importance resampling and tokenizer alignment beside brute force."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from conftest import prose
from pyspark.sql import functions as F

from wavemill.llm import alignment, decontamination, near_dedup, queries, resampling
from wavemill.llm.bpe import byte_letters

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOW))


@pytest.fixture(scope="module")
def items(spark):
    rows = [
        (1, prose(80, 4)), (2, " ".join(prose(80, 4).split()[10:30])), (3, "A"), (4, "É été-Ñ x9!"), (5, ""), (6, None), (None, prose(12, 5)),
        (7, "nothing like it at all in any of the documents here"), (2, "the"), (1, prose(80, 4)),
    ]
    return spark.createDataFrame(rows, "item_id bigint, text string").withColumn("n_words", F.lit("x"))


def hits_of(text, items, width=10):
    w = words(text)
    hit, found = set(), set()
    for item, t in items:
        v = words(t)
        size = min(width, len(v))
        grams = {tuple(v[i : i + size]) for i in range(len(v) - size + 1)} if v else set()
        for i in range(len(w) - size + 1):
            if tuple(w[i : i + size]) in grams:
                hit.update(range(i, i + size))
                found |= set() if item is None else {str(item)}
    return len(w), hit, sorted(found)


MORE = [
    (20, "start " + " ".join(prose(80, 4).upper().split()[3:20]) + ", end\n", "en", "a"), (21, "É ÉTÉ É été_Ñ X9", "fr", "a"),
    (22, "\t" + prose(12, 5) + " a ", "en", None), (23, "a", "en", "c"),
]


@pytest.fixture(scope="module")
def docs(spark, odd_docs):
    more = spark.createDataFrame(MORE, "doc_id bigint, text string, lang string, source string")
    return odd_docs.unionByName(more, allowMissingColumns=True)


@pytest.mark.parametrize("block_bytes", [1 << 25, 700])
def test_hits_equal_brute_force(spark, docs, items, block_bytes):
    tests = decontamination.TestSet(items, block_bytes=block_bytes)
    assert len(tests.gram_blocks) > 3 if block_bytes == 700 else len(tests.gram_blocks) == 1
    got = decontamination.hit_documents(docs, tests).collect()
    listed = [(r[0], r[1]) for r in items.select("item_id", "text").collect()]
    want = []
    for r in docs.select("doc_id", "text").collect():
        n, hit, found = hits_of(r.text, listed)
        want.append((r.doc_id, n, len(hit), found))
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


def test_no_items_no_documents(spark, docs, no_docs, items):
    none = decontamination.TestSet(items.where("false"))
    assert {(r.n_hit, len(r["items"])) for r in decontamination.hit_documents(docs, none).collect()} == {(0, 0)}
    assert decontamination.hit_documents(no_docs, decontamination.TestSet(items)).count() == 0
    assert decontamination.decontaminate(docs, none).count() == docs.count()


def test_removal_of_spans_and_documents(spark, docs, items):
    tests = decontamination.TestSet(items)
    listed = [(r[0], r[1]) for r in items.select("item_id", "text").collect()]
    named = docs.withColumn("place", F.lit("p")).withColumn("clean", F.lit("c"))
    left = decontamination.decontaminate(named, tests, "documents")
    assert left.columns == named.columns
    clean = [r.doc_id for r in docs.collect() if not hits_of(r.text, listed)[1]]
    assert sorted(map(str, (r.doc_id for r in left.collect()))) == sorted(map(str, clean))
    out = decontamination.decontaminate(named, tests, "spans")
    assert out.columns == named.columns and {(r.place, r.clean) for r in out.collect()} == {("p", "c")}
    want = []
    for r in docs.collect():
        hit = hits_of(r.text, listed)[1]
        cut = re.findall(r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", r.text or "")
        tail = (r.text or "")[sum(map(len, cut)) :]
        want.append((r.doc_id, "".join(c for i, c in enumerate(cut) if i not in hit) + tail if hit else r.text))
    assert sorted(map(repr, ((r.doc_id, r.text) for r in out.collect()))) == sorted(map(repr, want))
    with pytest.raises(ValueError):
        decontamination.decontaminate(docs, tests, "words")


def features(text, longest):
    w = words(text)
    return [" ".join(w[i : i + n]) for n in range(1, longest + 1) for i in range(len(w) - n + 1)]


@pytest.mark.parametrize("longest,rows", [(1, 1 << 20), (2, 1000), (3, 64)])
def test_interned_counts(monkeypatch, docs, longest, rows):
    monkeypatch.setattr(resampling, "TABLE_ROWS", rows)
    texts = [(r.text or "").encode() for r in docs.select("text").collect()]
    got, per_text = Counter(), Counter()
    for owner, table, _ in resampling.tables(texts, longest, 97):
        for slot in np.flatnonzero(table.count):
            got[int(table.bucket[slot])] += int(table.count[slot])
        per_text.update(owner.tolist())
    want = Counter(zlib.crc32(f.encode()) % 97 for t in texts for f in features(t.decode(), longest))
    assert got == want
    assert per_text == Counter({i: n for i, t in enumerate(texts) if (n := len(features(t.decode(), longest)))})


def test_equal_keys_are_told_apart_by_bytes():
    joined = b"aa bb aa cc bb"
    start = np.array([0, 3, 6, 9, 12])
    table = resampling.GramTable(joined, start, start + 2, 1000, keys=np.full(5, 7, np.uint64))
    assert len(set(table.slot.tolist())) == 3 and table.slot[0] == table.slot[2] and table.slot[1] == table.slot[4]
    assert sorted(table.count[table.count > 0].tolist()) == [1, 2, 2]


def resampled(docs, target, longest, buckets, least, percent):
    s, t = Counter(), Counter()
    for c, rows in ((s, [x for _, x in docs]), (t, target)):
        for x in rows:
            c.update(zlib.crc32(f.encode()) % buckets for f in features(x, longest))
    whole_s, whole_t = sum(s.values()) + buckets, sum(t.values()) + buckets
    gain = [math.floor(1000 * math.log((t[b] + 1) * whole_s / ((s[b] + 1) * whole_t))) for b in range(buckets)]
    out = []
    for key, x in docs:
        f = features(x, longest)
        weight = sum(gain[zlib.crc32(v.encode()) % buckets] for v in f)
        h = int(hashlib.sha256(f"2024:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        out.append([key, len(words(x)), len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296.0)))])
    able = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is not None, r[0] or 0))
    ranks = Counter()
    for n, r in enumerate(able[: len(able) * percent // 100], 1):
        ranks[(tuple(r), n)] += 1
    drawn = {}
    for (r, n), _ in ranks.items():
        drawn.setdefault(r, []).append(n)
    rows = []
    for r in map(tuple, out):
        rows.append((*r, drawn[r].pop(0) if drawn.get(r) else None))
    return rows


@pytest.mark.parametrize("longest,percent", [(1, 10), (2, 60), (1, 100)])
def test_resampling_equals_brute_force(spark, docs, items, longest, percent):
    got = resampling.resample(docs, items, longest=longest, buckets=500, percent=percent)
    want = resampled([(r[0], r[1]) for r in docs.select("doc_id", "text").collect()], [r[0] for r in items.select("text").collect()], longest, 500, 20, percent)
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))


def test_resampling_on_tables(spark):
    docs, target = (queries.table(spark, "/root/testdata/sf0.001", n) for n in ("documents", "benchmark"))
    got = queries.op12_importance_resampling(spark, "/root/testdata/sf0.001").collect()
    want = resampled([(r.doc_id, r.text) for r in docs.collect()], [r.text for r in target.collect()], 1, 10_000, 20, 10)
    assert sorted(map(repr, map(tuple, got))) == sorted(repr((r[0], *r[2:])) for r in want)


def test_ties_and_copies_take_ranks_in_order(spark):
    rows = [(i % 3, 5, 100 - i % 2) for i in range(40)] + [(9, 1, 500), (8, 30, 7)]
    df = spark.createDataFrame(rows, "doc_id bigint, n_words bigint, score bigint").repartition(5)
    got = resampling.highest(df, "score", "doc_id", F.col("n_words") >= 5, 50).collect()
    able = sorted((r for r in rows if r[1] >= 5), key=lambda r: (-r[2], r[0]))
    assert sorted((r.rank, r.score, r.doc_id) for r in got if r.rank) == [(n, r[2], r[0]) for n, r in enumerate(able[: len(able) // 2], 1)]
    assert len(got) == len(rows)


def test_empty_tables_resample(spark, docs, no_docs, items):
    assert resampling.resample(no_docs, items).count() == 0
    assert resampling.resample(docs, items.where("false")).count() == docs.count()
    assert resampling.sample(docs, items, percent=100).columns == docs.columns


@pytest.fixture(scope="module")
def paths():
    return queries.tokenizer("byte_bpe_50k.json"), queries.tokenizer("piece_bpe_32k.model")


def aligned_by_force(rows, paths):
    import sentencepiece
    from tokenizers import Tokenizer

    a_lib, b_lib, letters = Tokenizer.from_file(paths[0]), sentencepiece.SentencePieceProcessor(model_file=paths[1]), byte_letters()
    a_lib.encode_special_tokens = True
    done, count, best = [], Counter(), Counter()
    for key, text in rows:
        groups, a, b = [], [], []
        if text:
            whole = (" " + text).encode()
            a, b = a_lib.encode(" " + text, add_special_tokens=False).ids, b_lib.encode(text)
            bytes_a = [bytes(letters[c] for c in a_lib.id_to_token(i)) for i in a]
            bytes_b = [bytes([int(b_lib.id_to_piece(i)[3:5], 16)]) if b_lib.is_byte(i) else b_lib.id_to_piece(i).replace("▁", " ").encode() for i in b]
            if b"".join(bytes_a) != whole or b"".join(bytes_b) != whole:
                a, b = [], []
            i = j = at = to = 0
            left, right = [], []
            while i < len(a) or j < len(b):
                if at <= to and i < len(a):
                    left.append(a[i])
                    at += len(bytes_a[i])
                    i += 1
                else:
                    right.append(b[j])
                    to += len(bytes_b[j])
                    j += 1
                if at == to:
                    groups.append((left, right))
                    count[left[-1], right[-1]] += 1
                    left, right = [], []
        done.append((key, len(a), len(b), groups))
    for (_, y), n in count.items():
        best[y] = max(best[y], n)
    out = []
    for key, n_a, n_b, groups in done:
        links = [(x[-1], y[-1]) for x, y in groups]
        text = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups)
        sums = (sum(count[p] == best[p[1]] for p in links), sum(count[p] for p in links))
        out.append((key, n_a, n_b, len(groups), len(links), *sums, hashlib.sha256(text.encode()).hexdigest() if text else ""))
    return out


@pytest.mark.parametrize("block_pairs", [1 << 20, 100])
def test_alignment_equals_the_libraries(spark, docs, paths, block_pairs):
    more = [
        (30, "▁ in a text"), (31, " leading  and   trailing "), (32, "a b\n\nc\td"), (33, "<s> </s> <0x41> <unk> <|endoftext|>"), (34, "\x00\x01"),
        (35, "été à l'été x  y"), (36, " "), (37, "don't  'll we've"), (38, "日本語 テスト 한국어 \U0001F468‍\U0001F469"), (39, "é ́x"),
    ]
    some = docs.select("doc_id", "text", "n_words").unionByName(spark.createDataFrame(more, "doc_id bigint, text string").withColumn("n_words", F.lit("x")))
    got = alignment.align_tokenizers(some, *paths, block_pairs=block_pairs).collect()
    want = aligned_by_force([(r[0], r[1]) for r in some.select("doc_id", "text").collect()], paths)
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


def test_whole_texts_align_as_parts_do(paths):
    texts = [prose(200, k).encode() for k in range(3)] + ["  été  là\n\n l'x ".encode()]
    parts, whole = alignment.Pair(*paths), alignment.Pair(*paths)
    whole.splits = False
    for x, y in zip(parts.align(texts), whole.align(texts)):
        assert all(np.array_equal(a, b) for a, b in zip(x, y))


def test_labels_by_pointer_jumping():
    rng = np.random.default_rng(3)
    for _ in range(50):
        n = int(rng.integers(1, 60))
        ends = [np.unique(np.append(rng.integers(1, n + 1, rng.integers(1, 40)), n)) for _ in range(2)]
        common = np.intersect1d(*ends)
        for got, own in zip(alignment.group_labels(*ends), ends):
            assert np.array_equal(got, np.searchsorted(common, own))


def test_alignment_of_no_documents(no_docs, paths):
    assert alignment.align_tokenizers(no_docs, *paths).count() == 0


def test_groups_are_returned_as_text(docs, paths):
    rows = alignment.aligned(docs.where("doc_id = 12"), *paths, groups=True).collect()
    assert hashlib.sha256(rows[0].groups.encode()).hexdigest() == rows[0].groups_sha256
    assert xxhash.xxh64_intdigest(b"") == 17241709254077376921  # the hash of the tables is the public one


# --- blocks of near-duplicate nodes


def brute_components(sets, percent):
    label = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            shared = len(np.intersect1d(sets[i], sets[j]))
            if 100 * shared >= percent * (len(sets[i]) + len(sets[j]) - shared):
                a, b = label[i], label[j]
                label = [a if x == b else x for x in label]
    return label


def same_partition(nodes, links, want):
    label = list(range(len(nodes)))
    at = {int(n): i for i, n in enumerate(nodes)}
    for a, b in links:
        x, y = label[at[a]], label[at[b]]
        assert want[at[a]] == want[at[b]]
        label = [x if v == y else v for v in label]
    return len(set(label)) == len(set(want))


def test_block_links_join_what_all_pairs_join():
    rng = np.random.default_rng(7)
    for percent in (80, 60):
        for _ in range(40):
            base = [np.unique(rng.integers(0, 10_000, rng.integers(1, 40)).astype(np.uint64)) for _ in range(6)]
            sets = []
            for _ in range(40):
                b = base[rng.integers(6)]
                kept = b[rng.random(len(b)) < 0.93]
                sets.append(np.unique(np.concatenate([kept, rng.integers(0, 10_000, rng.integers(0, 4)).astype(np.uint64), b[:1]])))
            nodes = rng.permutation(1000)[: len(sets)]
            want = brute_components(sets, percent)
            links = near_dedup.block_links(nodes, sets, None, percent)
            assert len(links) < len(sets) and same_partition(nodes, links, want)


def test_template_texts_give_no_candidates_by_pairs():
    """80 common and 16 own words: none linked, and the bound leaves next to nothing to compare."""
    rng = np.random.default_rng(1)
    common = rng.integers(0, 1 << 40, 79).astype(np.uint64)
    sets = [np.unique(np.concatenate([common, rng.integers(1 << 40, 1 << 50, 17).astype(np.uint64)])) for _ in range(1200)]
    element, _, _, _ = near_dedup.prefix_lists(sets, 80)
    lists = np.unique(element, return_counts=True)[1] if len(element) else np.zeros(1, int)
    assert (lists * (lists - 1) // 2).sum() <= 2 * len(sets)
    assert near_dedup.block_links(np.arange(1200), sets, None, 80) == []
