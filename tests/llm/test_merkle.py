import random
import zlib

from pyspark.sql import functions as F

from sievelake.llm import merkle
from sievelake.llm.merkle import digest_of

FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def tree(leaves, fanout=3):
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([digest_of(levels[-1][i : i + fanout]) for i in range(0, len(levels[-1]), fanout)])
    return levels


def path(levels, i, fanout=3):
    out = []
    for level in levels[:-1]:
        low = i // fanout * fanout
        run = level[low : low + fanout]
        out.append(("".join(run[: i - low]), "".join(run[i - low + 1 :])))
        i //= fanout
    return out


def test_stretches_merge_to_the_whole_tree():
    rng = random.Random(1)
    for n in [*range(1, 40), 81, 100, 244]:
        for fanout in (2, 3, 5):
            leaves = [digest_of([str(i)]) for i in range(n)]
            levels = tree(leaves, fanout)
            cuts = sorted(rng.sample(range(1, n), min(n - 1, rng.randint(0, 6))))
            stretches = list(zip([0, *cuts], [*cuts, n], strict=True))
            own = [list(merkle.mountains(leaves[a:b], a, n, fanout)) for a, b in stretches]
            half = len(own) // 2
            once = [list(merkle.merge([x[:3] for part in parts for x in part if x[3]], n, fanout)) for parts in (own[:half], own[half:])]
            twice = list(merkle.merge([x[:3] for part in once for x in part if x[3]], n, fanout))
            every = [x for part in own + once for x in part] + twice
            assert all(levels[x[0]][x[1]] == x[2] for x in every) and not any(x[3] for x in twice)
            closed = {x[:2] for x in every if not x[3]}
            assert closed >= {(v, i) for v in range(1, len(levels)) for i in range(len(levels[v]))}
            spine = {x[:2]: x[2] for x in [y for part in own for y in part if y[3]] + [x for part in once for x in part] + twice}
            for a, b in stretches:
                assert list(merkle.paths(leaves[a:b], a, n, fanout, spine)) == [path(levels, i, fanout) for i in range(a, b)]


def leaf(row):
    return digest_of("-" if x is None else f"{len(str(x).encode())}:{x}" for x in row)


def brute(rows, fanout=3):
    """By id, source and leaf, as all rows of the tests differ in these or are equal."""
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append(r)
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in names:
        groups[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[s] = tree([leaf(r) for r in groups[s]], fanout)
    top = tree([trees[s][-1][0] for s in names], fanout)
    out = []
    for k, s in enumerate(names):
        for i, r in enumerate(groups[s]):
            way = path(trees[s], i, fanout) + path(top, k, fanout)
            now = r
            if r[0] is not None and r[4] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0:
                now = (*r[:4], r[4].replace("\n", ""))
            root = merkle.folded(leaf(now), way)
            out.append((r[0], leaf(r), trees[s][-1][0], top[-1][0], digest_of(x for side in way for x in side), root, root == top[-1][0]))
    return sorted(out, key=str)


def proofs(df, **more):
    even = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    tampered = {"text": F.when(even, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))}
    forest, found = merkle.manifest(df, FIELDS, "doc_id", "source", tampered, **more)
    return forest, sorted((tuple(r) for r in found.collect()), key=str)


def test_manifest_matches_brute_force(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice(["hot", "hot", "hot", "a", "é", None]), rng.choice(["en", None]), rng.choice([3, None]), rng.choice(["a\nb", "long é " * 50, "", None])) for i in range(150)]
    rows += [(7, "hot", None, None, "again")] * 30 + [(None, "a", None, None, "x\ny"), (None, None, None, None, None), (5, "alone", "en", 1, "\n" * 9), (-3, "hot", "en", 1, "t" * 100_000)]
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    for partitions, segment_rows in ((1, 1000), (5, 20)):
        forest, got = proofs(df.withColumns({"leaf": F.lit("x"), "part": F.lit(1), "place": F.lit(2)}).repartition(partitions), segment_rows=segment_rows)
        assert got == brute(rows)
    nodes = forest.nodes.collect()
    assert len(nodes) == len({(r.team, r.level, r.idx) for r in nodes})
    assert {r.digest for r in nodes} >= {r[2] for r in got if r[2] != r[1]}


def test_small_tables(spark):
    schema = "doc_id long, source string, lang string, n_chars long, text string"
    assert proofs(spark.createDataFrame([], schema))[1] == []
    for rows in ([(1, None, None, None, None)], [(1, "a", "en", 1, "x"), (2, "b", "en", 1, "x")]):
        assert proofs(spark.createDataFrame(rows, schema))[1] == brute(rows)
