"""Encoding, decoding, counting and the training order, against the tokenizers library and brute force."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from wavemill.llm import bpe, token_counts, training_order
from wavemill.llm.queries import END_OF_TEXT, table, tokenizer

SF = "/root/testdata/sf0.001"
BYTE, WORD = tokenizer("byte_bpe_50k.json"), tokenizer("word_bpe_49k.json")
POOL = "abc  'HE̱\n\t\r stmdlrev!?.<|endoftext|>0123½²Éß漢字ก็́  \u0085\x1c​\U0001f600ʼ’Σİ"


def strange_texts():
    r = random.Random(3)
    texts = ["".join(r.choice(POOL) for _ in range(r.randint(0, 40))) for _ in range(1500)]
    texts += ["".join(chr(r.choice([32, r.randrange(32, 0x250), r.randrange(0x300, 0xD7FF), r.randrange(0xE000, 0x1FFFF)])) for _ in range(20)) for _ in range(700)]
    return texts + ["", "a" * 3000, "'s ''s don't I'll x'rest 'LL", "a  b", " a b ", "a b\n", "a b c' s 's d'", "\n\n a", "<|endoftext|>" * 3]


def test_ids_are_the_librarys():
    texts = strange_texts()
    want = [e.ids for e in Tokenizer.from_file(BYTE).encode_batch(texts, add_special_tokens=False)]
    vocabulary = bpe.Vocabulary(BYTE)
    for step in (7, 5000):
        got = [i.tolist() for at in range(0, len(texts), step) for i in vocabulary.encode_batch([t.encode() for t in texts[at : at + step]])]
        assert got == want


def test_decoding_is_the_librarys():
    library, vocabulary = Tokenizer.from_file(BYTE), bpe.Vocabulary(BYTE)
    r = random.Random(4)
    for _ in range(300):
        ids = [r.randrange(50257) for _ in range(r.randint(0, 20))]  # rarely valid UTF-8
        assert vocabulary.decode(np.array(ids, np.uint32)).decode() == library.decode(ids, skip_special_tokens=False)


def test_segment_tree_merges_leftmost_lowest_first():
    vocabulary = bpe.Vocabulary(BYTE)

    def slow(piece):
        symbols = [int(vocabulary.first[b]) for b in piece]
        while len(symbols) > 1:
            ranks = vocabulary.ranks(np.array(symbols[:-1]), np.array(symbols[1:]))
            at = int(ranks.argmin())
            if ranks[at] == bpe.NO_PAIR:
                break
            symbols[at : at + 2] = [int(vocabulary.merged[ranks[at]])]
        return symbols

    r = random.Random(5)
    pieces = [bytes(r.choice(b" thereinaos\xc3\xa9") for _ in range(r.randint(1, 70))) for _ in range(300)] + [b"ab" * 9000]
    ids, start, size = vocabulary.merge(pieces)
    for piece, a, n in list(zip(pieces, start, size))[:-1]:
        assert ids[a : a + n].tolist() == slow(piece)
    assert b"".join(vocabulary.bytes_of[i] for i in ids[start[-1] :][: size[-1]]) == pieces[-1]


def test_bounded_cache_changes_nothing(monkeypatch):
    texts = [t.encode() for t in strange_texts()[:400]]
    want = [i.tolist() for i in bpe.Vocabulary(BYTE).encode_batch(texts)]
    monkeypatch.setattr(bpe, "CACHED_PARTS", 20)
    small = bpe.Vocabulary(BYTE)
    assert [small.encode_batch([t])[0].tolist() for t in texts] == want


def test_round_trip_of_odd_rows(odd_docs):
    library = Tokenizer.from_file(BYTE)
    rows = bpe.round_trip(odd_docs, BYTE).collect()
    texts = {r.doc_id: r.text or "" for r in odd_docs.where("doc_id IS NOT NULL").collect()}
    assert len(rows) == odd_docs.count()
    for r in rows:
        if r.doc_id is not None:
            ids = library.encode(texts[r.doc_id], add_special_tokens=False).ids
            assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
            assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest() and r.same_text


def test_decode_gives_texts_back(odd_docs):
    encoded = bpe.encode(odd_docs, BYTE, carry=["doc_id"])
    back = {r.doc_id: r.text for r in bpe.decode(encoded, BYTE, carry=["doc_id"]).collect()}
    assert all(back[r.doc_id] == (r.text or "") for r in odd_docs.where("doc_id IS NOT NULL").collect())


def test_empty_tables(no_docs, tmp_path):
    assert bpe.round_trip(no_docs, BYTE).count() == 0
    assert token_counts.token_counts(no_docs, WORD).count() == 0
    assert training_order.materialise(no_docs, BYTE, f"file://{tmp_path}", END_OF_TEXT).count() == 0


def test_counts_are_the_librarys():
    texts = strange_texts()
    want = [len(e) for e in Tokenizer.from_file(WORD).encode_batch(texts, add_special_tokens=False)]
    assert token_counts.PartCounter(WORD).totals([t.encode() for t in texts]).tolist() == want


def test_other_spellings_of_added_tokens():
    texts = ["<|EndOfText|>", "<|ENDOFTEXT|> a", "A<|EndOfText|>B", "<|endoftext|>", "a <|StartOfText|> THE é", "<|endoftext|><|ENDOFTEXT|> The", "<| EndOfText |> THE"]
    want = [len(e) for e in Tokenizer.from_file(WORD).encode_batch(texts, add_special_tokens=False)]
    assert token_counts.PartCounter(WORD).totals([t.encode() for t in texts]).tolist() == want


def test_counts_of_odd_rows(odd_docs):
    library = Tokenizer.from_file(WORD)
    texts = {r.doc_id: r.text or "" for r in odd_docs.where("doc_id IS NOT NULL").collect()}
    for r in token_counts.token_counts(odd_docs, WORD).collect():
        if r.doc_id is not None:
            n = len(library.encode(texts[r.doc_id], add_special_tokens=False).ids)
            assert (r.n_tokens, r.n_bytes, r.over_limit) == (n, len(texts[r.doc_id].encode()), n > 2048)


@pytest.mark.parametrize("size", [1, 2, 3, 4, 5, 16, 17, 1000, 4097])
def test_feistel_walk_is_a_permutation(size):
    slots = training_order.permuted(np.arange(size), size, 1)
    assert sorted(slots.tolist()) == list(range(size))
    assert size < 100 or (slots != training_order.permuted(np.arange(size), size, 2)).any()


def test_training_order_holds_the_stream(spark, odd_docs, tmp_path):
    docs = table(spark, SF, "documents").select("doc_id", "text").unionByName(odd_docs.where("doc_id = 4 OR doc_id IS NULL").select("doc_id", "text"))
    out, length, per_shard = f"file://{tmp_path}", 64, 32
    manifest = training_order.materialise(docs, BYTE, out, END_OF_TEXT, length=length, per_shard=per_shard).collect()
    library = Tokenizer.from_file(BYTE)
    rows = sorted(docs.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0, np.array(library.encode(r.text or "", add_special_tokens=False).ids, "<u2").tobytes()))
    stream = [i for r in rows for i in (*library.encode(r.text or "", add_special_tokens=False).ids, END_OF_TEXT)]
    count = -(-len(stream) // length)
    assert sorted(r.slot for r in manifest) == list(range(count))
    stream += [END_OF_TEXT] * (count * length - len(stream))
    read = list(training_order.read_sequences(out, 0, count, length=length, per_shard=per_shard))
    slots = training_order.permuted(np.arange(count), count, 1)
    for seq in range(count):
        assert read[slots[seq]].tolist() == stream[seq * length : (seq + 1) * length]
    for r in manifest:
        assert r.crc32 == zlib.crc32(read[r.slot].tobytes()) and r.shard == r.slot // per_shard
        assert r.byte_offset == r.slot % per_shard * length * 2
    assert not list(tmp_path.glob(".draft*"))
    resumed = list(training_order.read_sequences(out, 40, 5, length=length, per_shard=per_shard))
    assert [x.tolist() for x in resumed] == [x.tolist() for x in read[40:45]]


def test_counted_spans_cover_all_documents(spark, tmp_path):
    docs = table(spark, SF, "documents")
    manifest = training_order.materialise(docs, BYTE, f"file://{tmp_path}", END_OF_TEXT)
    named = {d for r in manifest.select("doc_ids").collect() for d in r.doc_ids}
    assert named == {r.doc_id for r in docs.select("doc_id").collect()}
    assert manifest.agg(F.sum("n_tokens")).first()[0] == bpe.encode(docs, BYTE).agg(F.sum(F.col("n_tokens") + 1)).first()[0]
