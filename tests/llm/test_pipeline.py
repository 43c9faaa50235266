"""run() against a plain version of each stage over a small folder of tables."""

from itertools import combinations

import pytest

import corpus_pipeline
from sievelake.llm import language_id, near_dedup, packing
from sievelake.llm.queries import ORACLE_SQL, queries, tokenizer_path
from tests.llm.conftest import DOCS, prose
from tests.llm.test_classifiers import SYLLABLES
from tests.llm.test_decontaminate import brute as alignment
from tests.llm.test_near_dedup import brute as classes
from tests.llm.test_substring_dedup import brute as repeated
from tests.llm.test_substring_dedup import left

LINE = prose(4242, 55)
ITEMS = [prose(900 + i, 30) for i in range(4)]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("sf"))
    texts = [(prose(i, 70, SYLLABLES[lang]), lang) for i, lang in enumerate(list(SYLLABLES) * 15)]
    en = [prose(300 + i, 90, SYLLABLES["en"]) for i in range(8)]
    texts += [(t, "en") for t in en] + [(en[0], "en"), (en[1] + " tail", None), (en[2].upper(), "en")]
    texts += [(f"{prose(500 + i, 60, SYLLABLES['en'])}\n{LINE}\n{prose(600 + i, 60, SYLLABLES['en'])}", "en") for i in range(4)]
    texts += [(prose(700, 80, SYLLABLES["en"]) + "\n" + ITEMS[0], "en"), (ITEMS[1].title() + " " + prose(701, 60, SYLLABLES["en"]), "en")]
    texts += [(None, "en"), ("12345 %%", "en"), (" ".join(["long"] * 2500), "en")]
    rows = [(i, t, lang, "src", len(t or "")) for i, (t, lang) in enumerate(texts)]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(list(enumerate(ITEMS)), "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, {r[0]: (r[1], r[2]) for r in rows}


def plain(spark, path, docs):
    model = language_id.fit(spark.read.parquet(f"{path}/documents.parquet").where("crc32(cast(doc_id as string)) % 5 <> 0"))
    kept = {i: t for i, (t, _) in docs.items() if (p := model.predict(t))[0] != "und" and p[1] >= corpus_pipeline.LEAST_LANGUAGE_SCORE}
    ids = sorted(kept)
    label = classes([kept[i] for i in ids])
    kept = {i: kept[i] for k, i in enumerate(ids) if label[k] == k}
    ids = sorted(kept)
    spans = repeated([kept[i] for i in ids])
    cut = {i: left(kept[i], spans.get(k, [])) for k, i in enumerate(ids)}
    cut = {i: t for i, t in cut.items() if t.strip()}
    clean = {}
    for i, t in cut.items():
        words = near_dedup.normalise(t)
        if not any(alignment(near_dedup.normalise(x), words) >= len(near_dedup.normalise(x)) for x in ITEMS):
            clean[i] = t
    return clean


def test_run_against_plain_stages(spark, folder):
    path, docs = folder
    docs = {i: (t, lang) for i, (t, lang) in docs.items()}
    docs[max(docs)] = docs[max(docs)]
    want = plain(spark, path, docs)
    rows = corpus_pipeline.run(spark, path).collect()
    encode = packing.word_encoder(tokenizer_path())
    lengths = {i: len(encode([t])[0]) // 4 + 1 for i, t in want.items()}
    got: dict[int, int] = {}
    for r in rows:
        got[r.doc_id] = got.get(r.doc_id, 0) + r.length
    assert got == lengths
    assert not {60 + 8, 60 + 9, 60 + 10} & got.keys()  # copies
    for a, b in combinations(sorted(rows, key=lambda r: (r.sequence_id, r.offset)), 2):
        if a.sequence_id == b.sequence_id:
            assert a.offset + a.length <= b.offset


def test_stages_keep_the_columns(spark, folder):
    path, _ = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, path)
        assert out.dtypes == docs.dtypes, name
        assert 0 < out.count() <= docs.count()
        assert stage(spark, docs.limit(0), path).count() == 0
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "minhash_near_dedup", "substring_dedup", "benchmark_decontamination", "best_fit_packing"]


def test_rows_of_odd_ids(spark, folder):
    """A row is told by id and text: without an id, or by an id of several texts, it fares as its own text does."""
    path, docs = folder
    item = prose(700, 80, SYLLABLES["en"]) + "\n" + ITEMS[0]
    clean = [prose(800 + i, 70, SYLLABLES["en"]) for i in range(3)]
    rows = [(1, item, "en"), (None, item, "en"), (2, item, None), (2, clean[0], "en"), (2, clean[0], "en"), (None, clean[1], None), (3, clean[2], "en")]
    odd = spark.createDataFrame([(i, t, lang, None, None) for i, t, lang in rows], DOCS)
    left = corpus_pipeline.decontaminate_benchmark(spark, odd, path)
    assert sorted(map(str, ((r.doc_id, r.text) for r in left.collect()))) == sorted(map(str, [(2, clean[0]), (2, clean[0]), (None, clean[1]), (3, clean[2])]))
    kept = corpus_pipeline.near_deduplicate(spark, odd, path)
    assert sorted(map(str, ((r.doc_id, r.text) for r in kept.collect()))) == sorted(map(str, [(1, item), (None, item), (2, clean[0]), (None, clean[1]), (3, clean[2])]))


def test_registered_names():
    names = list(queries())
    assert [int(n[2:].split("_")[0]) for n in names] == list(range(1, 14)) and set(ORACLE_SQL) <= set(names)
