"""Line differences. Lines keep their newline, so a last line without one differs from the same line with one."""

from __future__ import annotations

from bisect import bisect_left
from collections import defaultdict

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType


def split_lines(text: str) -> list[str]:
    return [x for x in text.replace("\n", "\n\x01").split("\x01") if x]


def common_lines(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """One longest common subsequence as pairs of places: common ends first, then the longest rising chain of matches.

    Time grows with the number of matching pairs between the ends, not with the product of the lengths.
    """
    start = 0
    while start < min(len(a), len(b)) and a[start] == b[start]:
        start += 1
    end = 0
    while end < min(len(a), len(b)) - start and a[-1 - end] == b[-1 - end]:
        end += 1
    places = defaultdict(list)
    for j in range(len(b) - end - 1, start - 1, -1):
        places[b[j]].append(j)
    tails: list[int] = []
    chain: list[tuple] = []
    for i in range(start, len(a) - end):
        for j in places.get(a[i], ()):
            k = bisect_left(tails, j)
            node = (i, j, chain[k - 1] if k else None)
            if k == len(tails):
                tails.append(j)
                chain.append(node)
            elif j < tails[k]:
                tails[k], chain[k] = j, node
    middle, node = [], chain[-1] if chain else None
    while node:
        middle.append(node[:2])
        node = node[2]
    return [(i, i) for i in range(start)] + middle[::-1] + [(len(a) - k, len(b) - k) for k in range(end, 0, -1)]


@F.pandas_udf(IntegerType())
def _shared(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([len(common_lines(split_lines(x or ""), split_lines(y or ""))) for x, y in zip(a, b, strict=True)])


def shared_lines(a: str | Column, b: str | Column) -> Column:
    """Lines in a longest common subsequence. Python, since SQL has no such function; batches go by Arrow."""
    return _shared(a, b)


@F.pandas_udf(IntegerType())
def shared_hashes(ha: pd.Series, ga: pd.Series, hb: pd.Series, gb: pd.Series) -> pd.Series:
    """``shared_lines`` of texts given by two hashes of each line, in two arrays."""
    lines = lambda h, g: list(zip(h.tolist(), g.tolist(), strict=True))
    return pd.Series([len(common_lines(lines(a, b), lines(c, d))) for a, b, c, d in zip(ha, ga, hb, gb, strict=True)], dtype="int32")
