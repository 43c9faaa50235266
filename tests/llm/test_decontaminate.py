import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from sievelake.llm import decontaminate
from tests.llm.conftest import prose


def brute(item, passage):
    best = 0
    h = np.zeros((len(item) + 1, len(passage) + 1), int)
    for i in range(1, len(item) + 1):
        for j in range(1, len(passage) + 1):
            step = decontaminate.MATCH if item[i - 1] == passage[j - 1] else decontaminate.MISMATCH
            h[i, j] = max(0, h[i - 1, j - 1] + step, h[i - 1, j] + decontaminate.GAP, h[i, j - 1] + decontaminate.GAP)
            best = max(best, h[i, j])
    return best


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(1, 4), max_size=15), st.lists(st.integers(0, 4), max_size=25))
def test_alignment_score(item, passage):
    a, b = np.array(item, np.int64), np.array(passage, np.int64)
    score, first, last = decontaminate.smith_waterman(a, b)
    assert score == brute(item, passage)
    if score:  # the reported stretch alone gives the score
        assert brute(item, passage[first : last + 1]) == score


def test_planted_passages(spark, make_docs):
    items = [prose(1000 + i, 30 + i) for i in range(6)] + ["tiny one", ""]
    benchmark = spark.createDataFrame([(i, t) for i, t in enumerate(items)] + [(50, None)], "item_id long, text string")
    rng = random.Random(1)
    edited = " ".join("zzz" if rng.random() < 0.12 else w for w in items[1].split())
    texts = [prose(1, 200), prose(2, 100) + "\n" + items[0].upper() + ".\n" + prose(3, 100), prose(4, 50) + " " + edited, None, "", items[2], items[2], prose(6, 20000) + " " + items[3]]
    texts += [" ".join(items[4].split()[:8]) + " " + prose(7, 80)] + [items[5]] * 40  # a short common run is no leak; copies make no seed too common
    got = decontaminate.passages(make_docs(texts, extra=True), benchmark).collect()
    assert {(r.doc_id, r.item_id) for r in got} >= {(1, 0), (2, 1), (5, 2), (6, 2), (7, 3)} | {(i, 5) for i in range(9, 49)}
    assert not {r.doc_id for r in got} & {0, 3, 4, 8}
    one = next(r for r in got if r.doc_id == 1)
    assert texts[1][one.start : one.end].lower() == items[0] and one.similarity == 1.0


def test_offsets_are_those_of_the_text(spark, make_docs):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    text = "İİİİ İstanbul " + item.title() + " end"
    benchmark = spark.createDataFrame([(1, item), (2, "İstanbul " + prose(3, 20))], "item_id long, text string")
    rows = decontaminate.passages(make_docs([text, "x İstanbul " + prose(3, 20) + " y"]), benchmark).collect()
    assert {(r.doc_id, r.item_id): text[r.start : r.end] for r in rows if r.doc_id == 0} == {(0, 1): item.title()}
    assert [(r.item_id, r.similarity, r.start) for r in rows if r.doc_id == 1] == [(2, 1.0, 2)]


def test_passages_against_whole_alignments(spark, make_docs):
    rng = random.Random(5)
    items = [prose(2000 + i, 24 + 3 * i) for i in range(5)]
    texts = []
    for i in range(30):
        words = items[i % 5].split()
        for k in rng.sample(range(len(words)), int(len(words) * (i % 6) * 0.08)):
            words[k] = "q" + str(k)
        texts.append(prose(3000 + i, 30) + " " + " ".join(words) + " " + prose(4000 + i, 30))
    benchmark = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.similarity for r in decontaminate.passages(make_docs(texts), benchmark).collect()}
    for d, text in enumerate(texts):
        for k, item in enumerate(items):
            a = decontaminate.words(item)
            score = brute(a, decontaminate.words(text)) / (2 * len(a))
            if score >= 0.6:
                assert got[d, k] == score
            elif score < 0.5:
                assert (d, k) not in got


def test_item_blocks_and_empty_tables(spark, make_docs):
    items = spark.createDataFrame([(i, prose(i, 40)) for i in range(10)], "item_id long, text string")
    docs = make_docs([prose(i, 40) for i in range(10)])
    got = decontaminate.passages(docs, items, most_bytes=700).select("doc_id", "item_id").collect()
    assert sorted(map(tuple, got)) == [(i, i) for i in range(10)]
    assert decontaminate.passages(docs.limit(0), items).count() == 0
    assert decontaminate.passages(docs, items.limit(0)).count() == 0


def test_short_edited_items_are_found():
    """Of items whose alignment with the text reaches the threshold, the share that seeds lead to."""
    from collections import Counter

    import numpy as np

    for n in (10, 12, 16, 20, 24, 40):
        for share, want in ((0.15, 0.97), (0.25, 0.95), (0.33, 0.9)):
            hits = []
            for seed in range(80):
                rng = random.Random(seed)
                item = prose(seed, n, "ka lo mi tu re sa vo ne pi da be fi go hu")
                items, words = decontaminate.Items([(1, item)], 3), item.split()
                for k in rng.sample(range(n), round(n * share)):
                    words[k] = f"q{rng.randrange(999)}"
                numbers = items.number(" ".join([prose(seed + 9999, 40), *words, prose(seed + 5555, 40)]))
                if decontaminate.smith_waterman(items.items[0], numbers)[0] < 0.5 * 2 * n:
                    continue
                chosen = decontaminate.seeds(items, Counter(), 4)
                positions, index = items.places(numbers, items.grams[np.array(sorted(chosen))])
                found = {}
                for p, g in zip(positions.tolist(), index.tolist(), strict=True):
                    for k, q in chosen[sorted(chosen)[g]]:
                        found.setdefault(k, []).append(p - q)
                hits.append(bool(list(decontaminate.align(items, numbers, found, 2, 0.5))))
            assert sum(hits) >= want * len(hits), (n, share)
