"""String similarities: plain Python over pairs, and one column of all of them over distinct pairs of a batch."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


@lru_cache(1 << 16)
def _letters(text: str) -> int:
    mask = 0
    for c in text:
        mask |= 1 << (ord(c) & 63)
    return mask


def edit_distance(a: str, b: str, most: int = 1 << 30) -> int:
    """Optimal string alignment distance (insert, delete, replace, swap of neighbours); most + 1 beyond most."""
    if a == b:
        return 0
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > most:
        return most + 1
    if most < 8:  # every letter of one text alone costs an edit
        x, y = _letters(a), _letters(b)
        if (x & ~y).bit_count() > most or (y & ~x).bit_count() > most:
            return most + 1
    start, end = 0, len(a)
    while start < end and a[start] == b[start]:
        start += 1
    shift = len(b) - len(a)
    while end > start and a[end - 1] == b[end - 1 + shift]:
        end -= 1
    a, b = a[start:end], b[start : end + shift]
    n = len(a)
    if not n:
        return len(b)
    far = most + 1
    if most >= len(b):
        return _bit_distance(a, b)
    older: list[int] = []
    old = list(range(n + 1))
    for i in range(1, len(b) + 1):
        y = b[i - 1]
        low, high = max(1, i - most), min(n, i + most)  # cells farther from the diagonal exceed most
        row = [far] * (n + 1)
        row[0] = i
        best = i if low == 1 else far
        for j in range(low, high + 1):
            x = a[j - 1]
            if x == y:
                value = old[j - 1]
            else:
                value = old[j - 1]
                if old[j] < value:
                    value = old[j]
                if row[j - 1] < value:
                    value = row[j - 1]
                value += 1
                if i > 1 and j > 1 and x == b[i - 2] and a[j - 2] == y and older[j - 2] + 1 < value:
                    value = older[j - 2] + 1
            row[j] = value
            if value < best:
                best = value
        if best > most:
            return far
        older, old = old, row
    return min(old[n], far)


def _bit_distance(a: str, b: str) -> int:
    """Optimal string alignment distance of two texts that are not empty; a column of the table is a few integers (Hyyrö)."""
    full, last = (1 << len(a)) - 1, 1 << (len(a) - 1)
    at: dict[str, int] = {}
    for i, x in enumerate(a):
        at[x] = at.get(x, 0) | 1 << i
    up, down, diagonal, before, distance = full, 0, 0, 0, len(a)
    for y in b:
        here = at.get(y, 0)
        swapped = ((~diagonal & here) << 1) & before
        diagonal = ((((here & up) + up) ^ up) | here | down | swapped) & full
        right, left = (down | ~(diagonal | up)) & full, diagonal & up
        distance += (1 if right & last else 0) - (1 if left & last else 0)
        right, left = (right << 1 | 1) & full, left << 1 & full
        up, down, before = (left | ~(diagonal | right)) & full, right & diagonal, here
    return distance


def assigned(costs: list[list[float]]) -> float:
    """Least total cost of giving every row a column of its own; needs at least as many columns as rows.

    Exact, over subsets of the columns, for up to 10 columns; shortest augmenting paths beyond.
    """
    rows = len(costs)
    if not rows:
        return 0.0
    columns = len(costs[0])
    if columns <= 10:
        best = {0: 0.0}
        for row in costs:
            after: dict[int, float] = {}
            for used, total in best.items():
                for j, c in enumerate(row):
                    if not used >> j & 1:
                        key, value = used | 1 << j, total + c
                        if value < after.get(key, float("inf")):
                            after[key] = value
            best = after
        return min(best.values())
    up, down = [0.0] * (rows + 1), [0.0] * (columns + 1)
    owner = [0] * (columns + 1)
    for i in range(1, rows + 1):
        owner[0], j0 = i, 0
        least, seen, way = [float("inf")] * (columns + 1), [False] * (columns + 1), [0] * (columns + 1)
        while owner[j0]:
            seen[j0] = True
            i0, step, j1 = owner[j0], float("inf"), 0
            for j in range(1, columns + 1):
                if not seen[j]:
                    slack = costs[i0 - 1][j - 1] - up[i0] - down[j]
                    if slack < least[j]:
                        least[j], way[j] = slack, j0
                    if least[j] < step:
                        step, j1 = least[j], j
            for j in range(columns + 1):
                if seen[j]:
                    up[owner[j]] += step
                    down[j] -= step
                else:
                    least[j] -= step
            j0 = j1
        while j0:
            owner[j0] = owner[way[j0]]
            j0 = way[j0]
    return sum(costs[owner[j] - 1][j - 1] for j in range(1, columns + 1) if owner[j])


def jaro(a: str, b: str) -> float:
    """Jaro similarity 0 to 100; matches are taken from left to right within max(1, longest // 2 - 1)."""
    if not a or not b:
        return 100.0 if a == b else 0.0
    if a == b:
        return 100.0
    reach = max(1, max(len(a), len(b)) // 2 - 1)
    free, left = list(b), []
    where = []
    for i, x in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if free[j] == x:
                free[j] = ""
                left.append(x)
                where.append(j)
                break
    m = len(left)
    if not m:
        return 0.0
    right = [b[j] for j in sorted(where)]
    swaps = sum(x != y for x, y in zip(left, right)) // 2
    return 100.0 * (m / len(a) + m / len(b) + (m - swaps) / m) / 3


def jaro_winkler(a: str, b: str) -> float:
    """Jaro similarity raised by a tenth of the rest for each of up to four equal first letters."""
    base, same = jaro(a, b), 0
    for x, y in zip(a[:4], b[:4]):
        if x != y:
            break
        same += 1
    return base + same * 0.1 * (100 - base)


def edit_similarity(a: str, b: str) -> float:
    """100 less the share of edits in the longer text."""
    if a == b:
        return 100.0
    if not a or not b:
        return 0.0
    return (1 - edit_distance(a, b) / max(len(a), len(b))) * 100


def token_sort(a: str, b: str) -> float:
    return jaro_winkler(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def token_set(a: str, b: str) -> float:
    """Best edit similarity among the common words and the two full word sets; of the texts as they are if none is common."""
    if not a or not b:
        return 0.0
    x, y = set(a.split()), set(b.split())
    common = " ".join(sorted(x & y))
    if not common:
        return edit_similarity(a, b)
    one, two = (" ".join(filter(None, (common, " ".join(sorted(s - (x & y)))))) for s in (x, y))
    return max(edit_similarity(common, one), edit_similarity(common, two), edit_similarity(one, two))


MEASURES = {"jaro": jaro, "jaro_winkler": jaro_winkler, "edit": edit_similarity, "token_sort": token_sort, "token_set": token_set}


def similarities(a: Column, b: Column, names: Sequence[str] = tuple(MEASURES)) -> Column:
    """struct of the named measures of two texts, 0 to 100, and no other is computed; null if one text is null."""
    measures = {name: MEASURES[name] for name in names}
    kind = pa.struct([(name, pa.float64()) for name in measures])

    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for x, y in batches:
            known: dict = {}
            out = []
            for p in zip(x.to_pylist(), y.to_pylist()):
                if p not in known:
                    known[p] = None if None in p else {name: f(*p) for name, f in measures.items()}
                out.append(known[p])
            yield pa.array(out, kind)

    return F.arrow_udf(run, ", ".join(f"{name} double" for name in measures))(a, b)
