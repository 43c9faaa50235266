import re

from sievelake.llm import substring_dedup
from tests.llm.conftest import prose

LINE = prose(1, 55)
SENTENCES = [f"{prose(50 + i, 9).capitalize()}." for i in range(7)]
PASSAGE = " ".join(SENTENCES)
TEXTS = [
    None, "", f"intro\n{LINE}\nend", f"{LINE.upper()}  \nother", f"a b\n\n{LINE}\n{LINE}", "short line\nshort line", "é\n" + LINE, " ".join(["w"] * 20000),
    f"Before it. {PASSAGE} After it.", f"{prose(3, 12)}. " + "\n".join(SENTENCES) + f"&&& {prose(4, 12)}.", f"Yes. No. {SENTENCES[0]} {prose(6, 8)}. No. Yes. {SENTENCES[2]}", "Yes. No. Yes.",
]


def brute(texts, least_words=10, least_unit=4):
    """{place of text: [(start, end, words, kept place, kept start)]} of (rank, text) pairs in order of rank, without regular expressions for units."""
    first, out = {}, {}
    for doc, text in enumerate(texts):
        found, at, text = [], 0, text or ""
        while at < len(text):
            end = at
            while end < len(text) and text[end] not in ".!?\n":
                end += 1
            while end < len(text) and text[end] in ".!?":
                end += 1
            while end < len(text) and text[end] in " \t\n\r\f":
                end += 1
            words = re.findall(r"[^\W_]+", text[at:end].lower())
            if words:
                key = tuple(words)
                found.append((at, end, len(words), first.get(key)))
                first.setdefault(key, (doc, at))
            at = end
        run = []
        for unit in [*found, (0, 0, 0, None)]:
            if unit[3]:
                run.append(unit)
                continue
            if sum(u[2] for u in run if u[2] >= least_unit) >= least_words:
                out.setdefault(doc, []).append((run[0][0], run[-1][1], sum(u[2] for u in run), *run[0][3]))
            run = []
    return out


def left(text, spans):
    for start, end, *_ in reversed(spans):
        text = text[:start] + text[end:]
    return text if text.strip() else ""


def test_repeats_and_remove_against_brute_force(spark, make_docs):
    docs = make_docs(TEXTS, extra=True)
    want = brute(TEXTS)
    found = substring_dedup.repeats(docs)
    got = {r.doc_id: [tuple(s) for s in r.spans] for r in found.collect()}
    assert got == want and set(want) == {3, 4, 6, 9}
    out = substring_dedup.remove(docs, found)
    assert out.columns == docs.columns
    texts = {r.doc_id: r.text for r in out.collect()}
    assert texts == {i: left(t, want[i]) if i in want else t for i, t in enumerate(TEXTS)}
    assert PASSAGE not in texts[9] and texts[3] == "other" and texts[4] == "a b\n\n" and "&&&" in texts[9] and texts[11] == TEXTS[11]


def test_rows_with_one_id_are_texts_of_their_own(spark, make_docs):
    other = prose(8, 40)
    docs = make_docs([(1, LINE), (2, LINE + "\ntail"), (2, other), (None, LINE), (None, other), (2, other)])
    found = substring_dedup.repeats(docs)
    texts = sorted(((r.doc_id is not None, r.doc_id, r.text) for r in substring_dedup.remove(docs, found).collect()), key=repr)
    assert texts == sorted([(True, 1, ""), (True, 2, "tail"), (True, 2, ""), (False, None, LINE), (False, None, other), (True, 2, "")], key=repr)


def test_empty_and_repeated_rows(spark, make_docs):
    assert substring_dedup.repeats(make_docs([])).count() == 0
    assert substring_dedup.remove(make_docs([]), substring_dedup.repeats(make_docs([]))).count() == 0
    twice = make_docs([(1, LINE), (1, LINE), (2, LINE)])
    assert [(r.doc_id, len(r.spans)) for r in substring_dedup.repeats(twice).collect()] == [(2, 1)]


def test_clashing_names(spark, make_docs):
    from pyspark.sql import functions as F

    docs = make_docs([LINE, LINE]).withColumns({c: F.lit(1) for c in ("_spans", "_of_id", "_of_text", "c0", "spans", "text_key", "nth", "first")})
    out = substring_dedup.remove(docs, substring_dedup.repeats(docs))
    assert out.columns == docs.columns and sorted(r.text for r in out.collect()) == ["", LINE]


def test_query_names_the_spans(spark, tmp_path, make_docs):
    from sievelake.llm.queries import op6_substring_dedup

    make_docs(TEXTS).write.parquet(f"{tmp_path}/documents.parquet")
    rows = {r.doc_id: r for r in op6_substring_dedup(spark, str(tmp_path)).collect()}
    assert len(rows) == len(TEXTS)
    for i, spans in brute(TEXTS).items():
        assert rows[i].removed_spans == " ".join(f"{a}-{b}:{c}@{d}" for a, b, _, c, d in spans) and rows[i].removed_words == sum(s[2] for s in spans)
    assert rows[0].text is None and rows[0].removed_spans == ""
