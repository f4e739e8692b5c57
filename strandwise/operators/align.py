"""Pairwise alignment of an original with a corrected read, and what it says about errors."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandwise.functions.enums import CODE

CORRECTIONS = "array<struct<pos: int, type: int, base: string>>"
_SUB = {b: CODE[f"SUB_OF_{b}"] for b in "ACGT"}
_DEL = {b: CODE[f"DEL_OF_{b}"] for b in "ACGT"}


#: Cells of the cost table that are kept as they are computed; larger tables keep some rows and compute the others again.
KEPT_CELLS = 1 << 20
_FAR = np.int32(1 << 30)
#: Pairs of at most so many cells are aligned with others, in tables of at most so many cells together.
TOGETHER = 1 << 14
TABLE_CELLS = 1 << 23


class _Costs:
    """Edit costs of prefixes in a band around the main diagonal; N and S in the original match anything.

    The band is widened until the distance lies within it: then it holds all best ways. Of a table
    over ``KEPT_CELLS`` only every sqrt(n)-th row is kept; the rows between two of them are computed
    again when the way back reaches them, so that memory grows with sqrt(n) times the band.
    """

    def __init__(self, original: str, corrected: str, free_ends: bool) -> None:
        self.a, self.b = (np.frombuffer(x.encode("latin-1", "replace"), np.uint8) for x in (original, corrected))
        self.n, self.m, self.free = len(self.a), len(self.b), free_ends
        self.wild = np.isin(self.a, (ord("N"), ord("S")))
        most = max(self.n, self.m, 1)
        self.band = most if free_ends else min(most, max(8, abs(self.n - self.m)))
        while not self._filled() and self.band < most:
            self.band = min(most, 2 * self.band)

    def _filled(self) -> bool:
        """Compute the kept rows; whether the band is wide enough."""
        self.columns = np.arange(2 * self.band + 1, dtype=np.int32)
        self.padded = np.concatenate([np.zeros(self.band, np.uint8), self.b, np.zeros(max(0, self.n - self.m) + self.band + 1, np.uint8)])
        whole = (self.n + 1) * len(self.columns) <= KEPT_CELLS
        self.step = self.n + 1 if whole else max(1, int(self.n**0.5))
        row = self.columns - self.band  # of row 0, column j costs j
        row = np.where((row < 0) | (row > self.m), _FAR, 0 if self.free else row).astype(np.int32)
        self.kept, self.blocks = {0: row}, {}
        if whole:
            self.blocks[0] = self._block(0)
            row = self.blocks[0][self.n]
        else:
            for i in range(1, self.n + 1):
                row = self._next(row, i)
                if i % self.step == 0:
                    self.kept[i] = row
        return self.free or int(row[self.m - self.n + self.band]) <= self.band

    def _next(self, row: np.ndarray, i: int) -> np.ndarray:
        """Row i from the one before; column j is at j - i + band."""
        out = row + ((self.padded[i - 1 : i - 1 + len(row)] != self.a[i - 1]) & ~self.wild[i - 1])
        np.minimum(out[:-1], row[1:] + 1, out=out[:-1])
        if i <= self.band:
            out[: self.band - i] = _FAR
            if self.free:
                out[self.band - i] = 0
        out = np.minimum.accumulate(out - self.columns) + self.columns  # steps along the row
        out[max(0, self.m - i + self.band + 1) :] = _FAR
        return np.minimum(out, _FAR)

    def _block(self, k: int) -> list[np.ndarray]:
        rows = [self.kept[k * self.step]]
        for i in range(k * self.step + 1, min((k + 1) * self.step, self.n + 1)):
            rows.append(self._next(rows[-1], i))
        return rows

    def __call__(self, i: int, j: int) -> int:
        place = j - i + self.band
        if not 0 <= place < len(self.columns):
            return int(_FAR)
        k = i // self.step
        if k not in self.blocks:
            self.blocks = {x: rows for x, rows in self.blocks.items() if x == k + 1}
            self.blocks[k] = self._block(k)
        return int(self.blocks[k][i - k * self.step][place])


def align_pair(original: str, corrected: str, compat: bool = False) -> list[tuple[int, int]]:
    """(pos, type) of the corrections that turn the original into the corrected read, in order.

    Unit costs, global; where several ways are best, substitutions come before deleted bases, and
    these before inserted ones, seen from the end. Deleted bases lie before position pos;
    several at one place are one MULTIDEL. With ``compat`` leading gaps cost nothing, N and S are
    looked up at the corrected read's position, and insertions lie one further.
    """
    i, j = len(original), len(corrected)
    found: list[tuple[int, int]] = []
    while not compat and i and j and (original[i - 1] == corrected[j - 1] or original[i - 1] in "NS"):
        i, j = i - 1, j - 1  # a common end is always on the best way
    cost = _Costs(original[:i], corrected[:j], compat)
    while i or j:
        own = cost(i, j)
        if i and j:
            wild = original[i - 1] in "NS"
            if own == cost(i - 1, j - 1) + (not wild and original[i - 1] != corrected[j - 1]):
                shown = original[i - 1] if not compat else original[j - 1] if j <= len(original) else ""
                if original[i - 1] != corrected[j - 1] and shown not in ("N", "S") and corrected[j - 1] in _SUB:
                    found.append((i - 1, _SUB[corrected[j - 1]]))
                i, j = i - 1, j - 1
                continue
        if j and (not i or own == cost(i, j - 1) + 1):
            found.append((i, _DEL.get(corrected[j - 1], CODE["MULTIDEL"])))
            j -= 1
        else:
            found.append((i if compat else i - 1, CODE["INSERTION"]))
            i -= 1
    return _several_deleted(found[::-1])


def _several_deleted(found: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for pos, code in found:
        if out and out[-1][0] == pos and 6 <= out[-1][1] <= 11 and 6 <= code <= 11:
            out[-1] = (pos, CODE["MULTIDEL"])
        else:
            out.append((pos, code))
    return out


def _letters(texts: Sequence[str]) -> np.ndarray:
    """A row of codes for each text, filled up with zeros."""
    width = max(1, *map(len, texts))
    return np.frombuffer("".join(x.ljust(width, "\0") for x in texts).encode("ascii"), np.uint8).reshape(len(texts), width)


def _align_table(originals: Sequence[str], corrected: Sequence[str]) -> list[list[tuple[int, int]]]:
    """``align_pair`` of ASCII pairs, a step of all of them at once: the cost tables lie side by side in one array, and so do the ways back."""
    a, b = _letters(originals), _letters(corrected)
    i, j = (np.array([len(x) for x in texts]) for texts in (originals, corrected))
    wild = (a == ord("N")) | (a == ord("S"))
    cost = np.empty((a.shape[1] + 1, b.shape[1] + 1, len(a)), np.int16)
    cost[0] = np.arange(b.shape[1] + 1, dtype=np.int16)[:, None]
    columns = np.ascontiguousarray(b.T)
    for r in range(1, len(cost)):
        row, above = cost[r], cost[r - 1]
        row[0] = r
        np.minimum(above[:-1] + ((columns != a[:, r - 1]) & ~wild[:, r - 1]), above[1:] + 1, out=row[1:])
        for c in range(1, len(row)):
            np.minimum(row[c], row[c - 1] + 1, out=row[c])
    sub, deleted = np.zeros(256, np.int64), np.full(256, CODE["MULTIDEL"])
    for base in "ACGT":
        sub[ord(base)], deleted[ord(base)] = _SUB[base], _DEL[base]
    steps: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    on = np.flatnonzero((i > 0) | (j > 0))
    while len(on):
        y, x = i[on], j[on]
        own, both = cost[y, x, on], (y > 0) & (x > 0)
        shown, base = a[on, y - 1], b[on, x - 1]
        differ = (shown != base) & ~wild[on, y - 1]
        diagonal = both & (own == cost[y - 1, x - 1, on] + differ)
        left = ~diagonal & (x > 0) & ((y == 0) | (own == cost[y, x - 1, on] + 1))
        up = ~diagonal & ~left
        for which, pos, code in ((diagonal & differ & (sub[base] > 0), y - 1, sub[base]), (left, y, deleted[base]), (up, y - 1, np.full(len(on), CODE["INSERTION"]))):
            if which.any():
                steps.append((on[which], pos[which], code[which]))
        i[on] -= diagonal | up
        j[on] -= diagonal | left
        on = on[(i[on] > 0) | (j[on] > 0)]
    out: list[list[tuple[int, int]]] = [[] for _ in originals]
    for pairs, positions, codes in reversed(steps):
        for pair, pos, code in zip(pairs.tolist(), positions.tolist(), codes.tolist(), strict=True):
            out[pair].append((pos, code))
    return [_several_deleted(found) for found in out]


def align_all(originals: Sequence[str], corrected: Sequence[str], compat: bool = False) -> list[list[tuple[int, int]]]:
    """``align_pair`` of each pair; short ones are aligned together."""
    cells = lambda p: (len(originals[p]) + 1) * (len(corrected[p]) + 1)
    fit = [p for p in range(len(originals)) if not compat and cells(p) <= TOGETHER and originals[p].isascii() and corrected[p].isascii()]
    out: list[list[tuple[int, int]] | None] = [None] * len(originals)
    fit.sort(key=lambda p: (len(originals[p]), len(corrected[p])))
    first = 0
    while first < len(fit):
        last, widest = first, 0
        while last < len(fit):
            widest = max(widest, len(corrected[fit[last]]))
            if last > first and (len(originals[fit[last]]) + 1) * (widest + 1) * (last + 1 - first) > TABLE_CELLS:
                break
            last += 1
        group = fit[first:last]
        for p, found in zip(group, _align_table([originals[p] for p in group], [corrected[p] for p in group]), strict=True):
            out[p] = found
        first = last
    return [align_pair(x, y, compat) if found is None else found for x, y, found in zip(originals, corrected, out, strict=True)]


def with_alignment(pairs: DataFrame, original: str = "original", corrected: str = "corrected", compat: bool = False, into: str = "corrections") -> DataFrame:
    """Rows with the corrections (pos, type, base of the original at pos) that alignment finds."""

    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        out = [None if x is None or y is None else [] for x, y in zip(a, b, strict=True)]
        differ = [(n, x, y) for n, (x, y) in enumerate(zip(a, b, strict=True)) if out[n] is not None and x != y]
        aligned = align_all([x for _, x, _ in differ], [y for _, _, y in differ], compat)
        for (n, x, _), found in zip(differ, aligned, strict=True):
            out[n] = [{"pos": p, "type": t, "base": x[p : p + 1]} for p, t in sorted(found)]
        return pd.Series(out, dtype=object)

    aligned = F.pandas_udf(run, CORRECTIONS)
    return pairs.withColumn(into, aligned(F.col(original), F.col(corrected)))


def smooth_multidels(corrections: DataFrame, keys: Iterable[str] = ("rid",), pos: str = "pos", code: str = "type") -> DataFrame:
    """One row per read, position and kind: several gap errors at one place become MULTIDEL; base errors stay."""
    gap = F.col(code).between(CODE["DEL_OF_A"], CODE["NODEL"])
    gaps = corrections.where(gap).groupBy(*keys, pos).agg(F.when(F.count("*") > 1, CODE["MULTIDEL"]).otherwise(F.min(code)).alias(code))
    return corrections.where(~gap).select(*keys, pos, code).unionByName(gaps)


def substitutions(rows: DataFrame, keys: Iterable[str], seq: str, against: str) -> DataFrame:
    """keys, pos, base (of seq), true (of against) at each place where two strings of equal length differ."""
    pairs = F.arrays_zip(F.split(F.col(seq), "").alias("base"), F.split(F.col(against), "").alias("true"))
    spread = rows.where(F.col(seq) != F.col(against)).select(*keys, F.posexplode(pairs).alias("pos", "pair"))
    return spread.select(*keys, "pos", F.col("pair.base").alias("base"), F.col("pair.true").alias("true")).where(F.col("base") != F.col("true"))


