"""The encoder's cache keeps the parts met again; pairs are looked up by hash, pieces lie in arrays."""

import numpy as np
import pytest
from tokenizers import Tokenizer

from wavemill.llm import bpe
from wavemill.llm.queries import tokenizer

BYTE = tokenizer("byte_bpe_50k.json")


def test_cache_keeps_parts_met_again(monkeypatch):
    monkeypatch.setattr(bpe, "CACHED_PARTS", 40)
    vocabulary, library = bpe.Vocabulary(BYTE), Tokenizer.from_file(BYTE)
    for n in range(30):
        text = "often met often met " + " ".join(f"once{n}x{k}" for k in range(30))
        assert vocabulary.encode_batch([text.encode()])[0].tolist() == library.encode(text, add_special_tokens=False).ids
        assert len(vocabulary.parts.slot) <= 40 + 33
        # Bytes, because the part that opens a text is marked.
        assert n == 0 or b"met" in vocabulary.parts.slot
    vocabulary.parts.trim()
    assert {b"often", b"met"} <= set(vocabulary.parts.slot) and len(vocabulary.parts.slot) < 10


@pytest.mark.parametrize("size", [1, 2, 3, 17, 900])
def test_pair_table(size):
    keys = np.random.default_rng(size).choice(1 << 62, size, replace=False)
    table = bpe.PairTable(keys)
    assert table.of(keys).tolist() == list(range(size))
    assert (table.of(keys ^ 1 << 62) == bpe.NO_PAIR).all() and not len(table.of(keys[:0]))


def test_texts_that_are_no_utf8():
    """A character cut between two texts is not joined."""
    vocabulary = bpe.Vocabulary(BYTE)
    want = vocabulary.encode_parts(["a�", "�b"])
    got = vocabulary._encode_cut([b"a\xe2\x82", b"\xacb"])
    assert [x.tolist() for x in got] == [x.tolist() for x in want]
