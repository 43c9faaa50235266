"""String keys and similarities that Spark has no function for, as Arrow-batched functions over plain Python."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import functions as F

_OTHER = re.compile(r"[^0-9a-z]+")


def fingerprint_of(text: str) -> str:
    """Lower case, compatibility decomposition, other signs to spaces, sorted distinct tokens."""
    plain = unicodedata.normalize("NFKD", text.strip().lower()).encode("ascii", "ignore").decode()
    return " ".join(sorted(set(_OTHER.sub(" ", plain).split())))


def fingerprint(column):
    """The key of any text, by an Arrow-batched function (there is no built-in decomposition)."""

    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else fingerprint_of(t))

    return F.pandas_udf(run, "string")(column)


def ascii_fingerprint(column):
    """The same key by built-in functions alone, for ASCII texts."""
    tokens = F.split(F.trim(F.regexp_replace(F.lower(column), "[^0-9a-z]+", " ")), " ")
    return F.array_join(F.array_sort(F.array_distinct(tokens)), " ")


def jaro_winkler(a: str, b: str, scale: float = 0.1) -> float:
    """Jaro similarity raised by a common prefix of at most four characters where it is over 0.7."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    taken = [False] * len(b)
    mine = []
    for i, x in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not taken[j] and b[j] == x:
                taken[j] = True
                mine.append(x)
                break
    if not mine:
        return 0.0
    theirs = [x for x, t in zip(b, taken, strict=True) if t]
    m, moved = len(mine), sum(x != y for x, y in zip(mine, theirs, strict=True)) / 2
    jaro = (m / len(a) + m / len(b) + (m - moved) / m) / 3
    prefix = 0
    while prefix < min(4, len(a), len(b)) and a[prefix] == b[prefix]:
        prefix += 1
    return jaro + prefix * scale * (1 - jaro) if jaro > 0.7 else jaro


def damerau(a: str, b: str) -> int:
    """Edits with transpositions of neighbours (each substring edited once)."""
    before, last, row = None, None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, last, row = last, row, [i]
        for j, y in enumerate(b, 1):
            best = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                best = min(best, before[j - 2] + 1)
            row.append(best)
    return row[-1]


def common_subsequence(a: str, b: str) -> int:
    """Length of the longest common subsequence, bit-parallel."""
    masks: dict[str, int] = {}
    for i, x in enumerate(a):
        masks[x] = masks.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for y in b:
        u = row & masks.get(y, 0)
        row = (row + u | row - u) & full
    return len(a) - row.bit_count()


def token_sort_ratio(a: str, b: str) -> float:
    """2 LCS / (|a| + |b|) of the texts with their tokens sorted."""
    a, b = " ".join(sorted(a.split())), " ".join(sorted(b.split()))
    return 2 * common_subsequence(a, b) / (len(a) + len(b)) if a or b else 1.0


SIMILARITIES = {
    "jarowinkler": jaro_winkler,
    "levenshtein": lambda a, b: 1 - damerau_free(a, b) / max(len(a), len(b), 1),
    "damerau_levenshtein": lambda a, b: 1 - damerau(a, b) / max(len(a), len(b), 1),
    "token_sort": token_sort_ratio,
    "exact": lambda a, b: float(a == b),
}


def damerau_free(a: str, b: str) -> int:
    """Plain edit distance."""
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y)))
    return row[-1]
