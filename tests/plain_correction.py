"""Plain versions of read correction, which take a read from start to end: what the rounds of joins are held against."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np

from strandwise.functions.enums import CODE, REPEAT, UNTRUSTED

_TURN = str.maketrans("ACGTacgt", "TGCAtgca")


def _canonical(kmer: str) -> str:
    return min(kmer, kmer.translate(_TURN)[::-1])


class Missing(Exception):
    def __init__(self, kmers: set[str]) -> None:
        self.kmers = kmers


class Known:
    """Classes by k-mer; asking for others raises ``Missing`` with all of them."""

    def __init__(self, classes: dict[str, int]) -> None:
        self.classes = classes

    def need(self, kmers: Iterable[str]) -> None:
        if missing := {c for c in map(_canonical, kmers) if c not in self.classes}:
            raise Missing(missing)

    def __call__(self, kmer: str) -> int:
        self.need([kmer])
        return self.classes[_canonical(kmer)]


def edited(seq: str, pos: int, code: int) -> str:
    """The sequence with an error of this type at pos undone; deleted bases go in after pos."""
    if 1 <= code <= 4:
        return seq[:pos] + "ACGT"[code - 1] + seq[pos + 1 :]
    if code == CODE["INSERTION"]:
        return seq[:pos] + seq[pos + 1 :]
    if 6 <= code <= 9:
        return seq[: pos + 1] + "ACGT"[code - 6] + seq[pos + 1 :]
    raise ValueError("this type can't be undone")


def candidate_types(seq: str, pos: int, indels: bool = True, at: int | None = None) -> list[int]:
    """Types worth trying at pos, in code order; ``at`` is the place whose base and distance from the ends are looked at."""
    at = pos if at is None else at
    shifting = indels and 0 < at < len(seq) - 1
    own = seq[at] if at < len(seq) else ""
    return [c for c in range(1, 5) if "ACGT"[c - 1] != own] + ([5, 6, 7, 8, 9] if shifting else [])


def _extended(seqs: list[str], starts: list[range], k: int, known: Known) -> list[dict[int, tuple[int, int]]]:
    """For each sequence: start -> (class, k) with k grown by 2 while the k-mer is a repeat and fits."""
    out: list[dict[int, tuple[int, int]]] = [{} for _ in seqs]
    open_ = [(n, i) for n, r in enumerate(starts) for i in r]
    while open_:
        known.need(seqs[n][i : i + k] for n, i in open_)
        again = []
        for n, i in open_:
            kind = known(seqs[n][i : i + k])
            out[n][i] = kind, k
            if kind == REPEAT and i + k + 2 < len(seqs[n]):
                again.append((n, i))
            elif kind == REPEAT:
                out[n][i] = kind, k + 2
        open_, k = again, k + 2
    return out


def bad_coverage(seq: str, k: int, known: Known) -> np.ndarray:
    """How many untrusted k-mers cover each position."""
    cover = np.zeros(len(seq) + 1, np.int64)
    for i, (kind, n) in _extended([seq], [range(max(0, len(seq) - k))], k, known)[0].items():
        if kind == UNTRUSTED:
            cover[i] += 1
            cover[i + n] -= 1
    return np.cumsum(cover[:-1])


def _untrusted(seqs: list[str], first: int, last: int, k: int, known: Known) -> list[int]:
    starts = [range(first, min(last, len(s)) - k + 1) for s in seqs]
    return [sum(kind == UNTRUSTED for kind, _ in found.values()) for found in _extended(seqs, starts, k, known)]


def is_perfect(seq: str, first: int, last: int, k: int, known: Known) -> bool:
    """No untrusted k-mer begins at first or later and ends by last."""
    if first > len(seq) or last > len(seq):
        raise ValueError("the range exceeds the read")
    return _untrusted([seq], first, last, k, known)[0] == 0


def fix_position(seq: str, pos: int, k: int, known: Known, indels: bool = True) -> str | None:
    """The read with the one edit at pos that leaves no untrusted k-mer around it; larger k where several do equally well."""
    while k < len(seq):
        first, last = max(0, pos - k + 1), min(len(seq) - 1, pos + k - 1)
        types = candidate_types(seq, pos, indels)
        edits = [edited(seq, pos, c) for c in types]
        before, *after = _untrusted([seq, *edits], first, last, k, known)
        best = min(after, default=before)
        if best >= before:
            return None
        if _tied(after, before):
            k += 2
            continue
        return edits[after.index(best)] if best == 0 else None
    return None


def _tied(counts: list[int], before: int) -> bool:
    """Whether, going through the candidates, one equals the best so far (below ``before``)."""
    lowest = before
    for n in counts:
        if n < lowest:
            lowest = n
        elif n == lowest < before:
            return True
    return False


def fix_first(seq: str, pos: int, k: int, known: Known, indels: bool = True) -> str | None:
    """The first edit at pos, in type order, after which the area around it is perfect."""
    first, last = max(0, pos - k + 1), min(len(seq) - 1, pos + k - 1)
    edits = [edited(seq, pos, c) for c in candidate_types(seq, pos, indels)]
    for text, n in zip(edits, _untrusted(edits, first, last, k, known), strict=True):
        if n == 0:
            return text
    return None


def correct_simple(seq: str, k: int, known: Known, indels: bool = True) -> str:
    """Again and again fix the position that most untrusted k-mers cover (the first of several), while that works.

    It ends by itself: where a read comes back to a sequence it had, its fixes lead in a circle.
    """
    had = {seq}
    while True:
        cover = bad_coverage(seq, k, known)
        if not len(cover) or not cover.max():
            return seq
        fixed = fix_position(seq, int(cover.argmax()), k, known, indels)
        if fixed is None or fixed in had:
            return seq
        had.add(fixed)
        seq = fixed


def smallest_nonrepetitive(seq: str, pos: int, k: int, known: Known) -> int | None:
    while pos + k < len(seq):
        if known(seq[pos : pos + k]) != REPEAT:
            return k
        k += 2
    return None


def fix_kmer(seq: str, pos: int, k: int, known: Known, indels: bool = True, compat: bool = False) -> str:
    """The read with the first edit (by place, then type) that makes the k-mer at pos trusted.

    Types are ruled out by the read at the edited place; with ``compat`` by the read at the place's
    distance from the k-mer's begin.
    """
    kmer = seq[pos : pos + k]
    tries = [(i, c) for i in range(len(kmer)) for c in candidate_types(seq, pos + i, indels, i if compat else pos + i)]
    new = [edited(kmer, i, c) for i, c in tries]
    known.need(new)
    for (i, c), text in zip(tries, new, strict=True):
        if known(text) != UNTRUSTED:
            return edited(seq, pos + i, c)
    return seq


def correct_adaptive(seq: str, k: int, known: Known, indels: bool = True, compat: bool = False) -> str:
    """Go over every second start, with the smallest k whose k-mer is no repeat, and fix untrusted ones."""
    known.need(seq[i : i + k] for i in range(0, len(seq) - k, 2))
    pos = 0
    while pos + k < len(seq):
        size = smallest_nonrepetitive(seq, pos, k, known)
        if size is None:
            break
        if known(seq[pos : pos + size]) == UNTRUSTED:
            fixed = fix_kmer(seq, pos, size, known, indels, compat)
            if fixed != seq:  # ask for all that follows at once
                known.need(fixed[i : i + k] for i in range(pos + 2, len(fixed) - k, 2))
            seq = fixed
        pos += 2
    return seq
