import gzip
import hashlib
import os

from sievelake.llm import warc
from sievelake.llm.common import fresh_dir

PAGES = "page_id long, url string, html string"
ROWS = [(3, "http://c", "x" * 150), (1, "http://a", "x" * 150), (2, None, "short"), (4, "http://d", "short"), (5, "http://e", None), (7, "http://f", "é" * 50000), (None, "http://n", "x" * 150), (8, "u", "y" * 200), (8, "u", "y" * 200), (9, "u r\nl", "")]


def _files(folder):
    path = folder.removeprefix("file:").replace("///", "/")
    return {n: open(f"{path}/{n}", "rb").read() for n in sorted(os.listdir(path)) if n.endswith(".warc.gz")}


def test_round_trip(spark):
    pages = spark.createDataFrame(ROWS, PAGES)
    got = sorted(warc.round_trip(spark, pages.selectExpr("*", "1 AS digest", "2 AS shard"), roll_bytes=300, shard_bytes=1000).collect(), key=lambda r: (r.page_id or 0, r.record_type))
    assert len(got) == len(ROWS)
    for r in got:
        raw = next((h or "" for i, _, h in ROWS if i == r.page_id)).encode()
        assert r.payload_bytes == len(raw) and r.payload_digest == hashlib.sha256(raw).hexdigest()
    kinds = [(r.page_id, r.record_type, r.refers_to) for r in got]
    assert (1, "response", None) in kinds and (3, "revisit", 1) in kinds and (None, "revisit", 1) in kinds
    assert (2, "response", None) in kinds and (4, "response", None) in kinds
    assert kinds.count((8, "response", None)) == 1 and kinds.count((8, "revisit", 8)) == 1


def test_same_rows_give_the_same_bytes(spark):
    folders = [fresh_dir(spark, "warc-test") for _ in range(2)]
    for folder, parts in zip(folders, (1, 5), strict=True):
        warc.write(spark.createDataFrame(ROWS, PAGES).repartition(parts), folder, roll_bytes=300, shard_bytes=1000)
    a, b = map(_files, folders)
    assert a == b and len(a) > 2
    assert not any("_temporary" in n for n in os.listdir(folders[0].removeprefix("file:").replace("///", "/")))
    text = gzip.decompress(next(iter(a.values())))
    assert text.startswith(b"WARC/1.1\r\nWARC-Type: warcinfo")


def test_empty_table(spark):
    assert warc.round_trip(spark, spark.createDataFrame([], PAGES)).count() == 0


def test_shards_of_many_cuts(spark):
    import bisect

    ids = [None, -5, 0, 1, 7, 499, 500, 1503, 1504, 99999]
    df = spark.createDataFrame([(i,) for i in ids], "page_id long")
    for cuts in ([], [3], list(range(0, 1500, 3)), list(range(1, 3000, 2))):
        got = {r.page_id: r.s for r in df.select("page_id", warc.shard_of(cuts, 16).alias("s")).collect()}
        assert got == {i: 0 if i is None else bisect.bisect_right(cuts, i) for i in ids}
