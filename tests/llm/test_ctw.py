import math
import re
import zlib
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sievelake.llm import ctw

TEXTS = ["the cat sat on the mat", "The dog sat", None, "", "zebra quartz!", "the the the cat\n\nmat"] + [f"cat number {i % 7} sat" for i in range(40)]


def words(text):
    return re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode("utf-8", "replace").translate(bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))))


def raw_of(text, depth):
    return bytes([ctw.END]) * depth + b"".join(w + b" " for w in words(text)) + bytes([ctw.END])


class Node:
    def __init__(self):
        self.n, self.kids = [0, 0], {}


def brute(train, texts, depth):
    """Sequential context-tree weighting: one tree per decision node, probabilities by recursion over whole trees."""
    roots = {}

    def walk(raw):
        for at in range(depth, len(raw)):
            byte, context = raw[at], raw[at - depth : at][::-1]
            for level in range(8):
                yield (1 << level) | (byte >> (8 - level)), context, (byte >> (7 - level)) & 1

    def weighted(node, d):
        own = math.lgamma(node.n[0] + 0.5) + math.lgamma(node.n[1] + 0.5) - math.log(math.pi) - math.lgamma(sum(node.n) + 1)
        if d == depth:
            return own, own
        below = sum(weighted(k, d + 1)[1] for k in node.kids.values())
        top = max(own, below)
        return own, top + math.log(0.5 * math.exp(own - top) + 0.5 * math.exp(below - top))

    for raw in train:
        for decision, context, bit in walk(raw):
            node = roots.setdefault(decision, Node())
            node.n[bit] += 1
            for c in context:
                node = node.kids.setdefault(c, Node())
                node.n[bit] += 1

    def one(decision, context):
        """P(bit = 1), contexts not met leave their parents' mixture."""
        if decision not in roots:
            return 0.5

        def mix(node, d):
            own = (node.n[1] + 0.5) / (sum(node.n) + 1)
            if d == depth or context[d] not in node.kids:
                return own
            a, w = weighted(node, d)
            stay = math.exp(a + math.log(0.5) - w)
            return stay * own + (1 - stay) * mix(node.kids[context[d]], d + 1)

        return mix(roots[decision], 0)

    return [sum(math.log10(p if bit else 1 - p) for decision, context, bit in walk(raw) for p in [one(decision, context)]) for raw in texts]


@pytest.mark.parametrize(("chunk_bytes", "fan"), [(60, 2), (60, 32), (1 << 20, 32)])
def test_scores_against_brute_force(spark, make_docs, monkeypatch, chunk_bytes, fan):
    monkeypatch.setattr(ctw, "FAN", fan)  # 2: counts are merged in several rounds, and answers go back through them
    depth = 3
    got = {r.doc_id: r for r in ctw.score(make_docs(TEXTS, extra=True), F.col("doc_id") % 3 != 0, depth=depth, chunk_bytes=chunk_bytes).collect()}
    raw = [raw_of(t, depth) for t in TEXTS]
    want = brute([x for i, x in enumerate(raw) if i % 3], raw, depth)
    tokens = Counter()
    for i, t in enumerate(TEXTS):
        if i % 3:
            tokens.update([*words(t), None])
    n, v = sum(tokens.values()), len(tokens)
    for i, t in enumerate(TEXTS):
        own = [*words(t), None]
        assert got[i].score == pytest.approx(want[i], rel=1e-6)
        assert got[i].bits_per_byte == pytest.approx(-want[i] * math.log2(10) / (len(raw[i]) - depth), rel=1e-6)
        assert got[i].base_score == pytest.approx(sum(math.log10((tokens[w] + 0.1) / (n + 0.1 * (v + 1))) for w in own))
        assert (got[i].n_tokens, got[i].n_known, got[i].train_tokens) == (len(own), sum(tokens[w] > 0 for w in own), n)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(st.sampled_from("aB \t\n\x0b\x1cé\u2003zq"), max_size=30)), min_size=1, max_size=6), st.sampled_from([3, 1 << 20]))
def test_batches_hold_the_words_and_contexts_of_each_text(texts, step):
    before, ctw.STEP = ctw.STEP, step
    try:
        found = list(ctw.in_batches(texts))
        assert [t for own, in found for t in own] == texts
        for own, in found:
            batch = ctw.Batch(own, 2)
            keys, hashed = [[] for _ in own], [[] for _ in own]
            for into, parts in ((keys, batch.keys()), (hashed, batch.words())):
                for doc, x in parts:
                    for d, v in zip(doc.tolist(), x.tolist(), strict=True):
                        into[d].append(v)
            for d, t in enumerate(own):
                raw = raw_of(t, 2)
                assert keys[d] == [raw[i - 1] << 16 | raw[i - 2] << 8 | raw[i] for i in range(2, len(raw))]
                assert hashed[d] == [v for w in words(t) for _, x in ctw.Batch([w.decode()], 2).words() for v in x.tolist()]
    finally:
        ctw.STEP = before
    assert len({v for w in ("ab", "ba", "a", "b", "aa") for _, x in ctw.Batch([w], 2).words() for v in x.tolist()}) == 5


def test_finer_parts_lie_within_coarser_ones():
    import numpy as np

    rng = np.random.default_rng(1)
    key, word = rng.integers(0, 2**48, 5000), rng.integers(-(2**63), 2**63, 5000)
    for part, more in ((ctw.part_of_key, (5,)), (ctw.part_of_word, ())):
        coarse, fine, finest = (part(key if more else word, *more, n) for n in (32, 1024, 1 << 20))
        assert (fine // 32 == coarse).all() and (finest // 1024 == fine).all() and len(set(coarse.tolist())) == 32
    sizes = {}
    for texts in (50, 500):  # the rows of a chunk do not follow the number of chunks
        import pyarrow as pa

        table = pa.table({"chunk": [7] * texts, "text": ["some words of a text " + str(i) for i in range(texts)], "learn": [True] * texts})
        sizes[texts] = ctw._gather(table, 5, ctw.FAN).num_rows
    assert max(sizes.values()) <= ctw.FAN


def test_counts_beyond_four_bytes():
    import numpy as np

    key, word = np.array([5 << 16, 9 << 16]), np.array([-7, 8])
    for large in (3, 1 << 40):
        table = ctw._dealt(1, (key, np.array([1, large])), (word, np.array([2, 2])), 4, 3, 0, 2, 2)
        found, counts = ctw._merged(table, "keys", "counts")
        assert found.tolist() == key.tolist() and counts.tolist() == [1, large] and ctw._merged(table, "words", "word_counts")[1].tolist() == [2, 2]


def test_probabilities_of_all_bytes_sum_to_one():
    import numpy as np

    key = np.concatenate([k for _, k in ctw.Batch(["abab abc"], 3).keys()])
    distinct, count = np.unique(key, return_counts=True)
    every = np.unique(np.concatenate((distinct, ((distinct[0] >> 8) << 8) + np.arange(256))))
    counts = np.zeros(len(every), np.int64)
    counts[np.searchsorted(every, distinct)] = count
    tree = ctw.Tree(every, counts, 3, 0)
    k = len(tree.levels[-1][0])
    p = 10 ** tree.log10(np.zeros(k), np.ones(k), np.full(k, 0.5))
    assert p[(every >> 8) == distinct[0] >> 8].sum() == pytest.approx(1.0)


def test_without_training_rows_or_rows(spark, make_docs):
    rows = ctw.score(make_docs(["ab", None]), F.lit(False)).orderBy("doc_id").collect()
    assert rows[0].train_tokens == 0 and rows[0].n_known == 0 and rows[0].score == pytest.approx(-4 * 8 * math.log10(2))
    assert ctw.score(make_docs([]), F.lit(True)).count() == 0


def test_held_out_folds_are_those_of_crc32(spark):
    from sievelake.llm.common import held_out

    rows = spark.range(50).select("id", held_out("id", 10)).collect()
    assert all(r.held_out == (zlib.crc32(str(r.id).encode()) % 10 == 0) for r in rows)
