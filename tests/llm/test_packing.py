import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sievelake.llm import packing
from sievelake.llm.queries import tokenizer_path


@settings(max_examples=40, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 40), min_size=1, max_size=20))
def test_plan_places_every_piece_once(histogram):
    patterns = packing.plan(histogram, 64, groups=4)
    placed = {}
    for pattern, times in patterns:
        assert 0 < sum(n * q for n, q in pattern) <= 64 and times > 0
        for n, q in pattern:
            placed[n] = placed.get(n, 0) + q * times
    assert placed == histogram
    # no worse than best fit decreasing's guarantee over what best fit decreasing itself needs
    assert sum(t for _, t in patterns) <= 11 / 9 * best_fit_decreasing(histogram, 64) + 2


def best_fit_decreasing(histogram, capacity):
    rooms = []
    for n in sorted((n for n, c in histogram.items() for _ in range(c)), reverse=True):
        fits = [r for r in rooms if r >= n]
        room = min(fits) if fits else capacity
        if fits:
            rooms.remove(room)
        rooms.append(room - n)
    return len(rooms)


def test_configurations_solve_a_known_program():
    # two sizes: 60 goes with 40, so 10 of each take 10 bins of 100
    found = packing.configurations(np.array([60, 40]), np.array([10, 10]), 100)
    assert sum(t for _, t in found) == 10


def test_encoder_agrees_with_the_tokenizer():
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(tokenizer_path())
    texts = ["", "   ", "it's we'll DON'T x'S", "naïve café ÀÉÎ ß × ÷ µ ª º ² ½", "日本語 テスト", "a b　c", "İ ΣΑΣ", "<|endoftext|> hi", "hi <|endoftext|> there", "a<|startoftext|>b", "<|ENDOFTEXT|> x", "< |endoftext|>", "x" * 300, "a\x1cb\x0bc", "12 $%^", "t\tn\r\nl", "é z​"]
    for text, raw in zip(texts, packing.word_encoder(tokenizer_path())(texts), strict=True):
        assert np.frombuffer(raw, "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids, text


@pytest.mark.parametrize("extra", [False, True])
def test_pack_round_trip(spark, make_docs, extra):
    texts = [None, "", "hello world", "hello world", " ".join(["word"] * 5000), "tiny"] + [f"doc {i} " * (i * 7) for i in range(1, 60)]
    docs = make_docs(texts, extra)
    docs = docs.unionByName(docs.where("doc_id = 2"))  # a repeated row is a document of its own
    encode = packing.word_encoder(tokenizer_path())
    rows = packing.pack(docs, lambda: packing.word_encoder(tokenizer_path())).collect()
    ids = {i: encode([t or ""])[0] + b"\0\0\0\0" for i, t in enumerate(texts)}
    counts = {}
    for r in rows:
        own = ids[r.doc_id][4 * r.start : 4 * (r.start + r.length)]
        assert len(own) == 4 * r.length and zlib.crc32(own) == r.ids_crc32 and r.start == r.piece * 2048
        counts[r.doc_id] = counts.get(r.doc_id, 0) + r.length
    assert counts == {i: len(x) // 4 * (2 if i == 2 else 1) for i, x in ids.items()}
    by = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert by.get(r.sequence_id, 0) == r.offset
        by[r.sequence_id] = r.offset + r.length
    assert max(by.values()) <= 2048
    assert len(by) <= -(-sum(by.values()) // 2048) + 2


def test_kept_strings_are_bounded_in_bytes(monkeypatch):
    monkeypatch.setattr(packing, "KEPT", 3000)
    kept = packing._Kept(lambda w: w.encode())
    for i in range(100):
        assert kept[f"w{i}"] == f"w{i}".encode() and kept["y" * 100] == b"y" * 100
        assert len(kept) <= 3000 // packing.ENTRY and "y" * 100 not in kept


def test_empty_table(spark, make_docs):
    assert packing.pack(make_docs([]), lambda: packing.word_encoder(tokenizer_path())).count() == 0
