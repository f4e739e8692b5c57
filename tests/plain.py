"""Plain versions of what the library does with columns, for tests."""

from strandwise.functions.enums import CODE

_SUB = {b: CODE[f"SUB_OF_{b}"] for b in "ACGT"}
_DEL = {b: CODE[f"DEL_OF_{b}"] for b in "ACGT"}
_TURNED = {"A": "T", "C": "G", "G": "C", "T": "A"}


def record_errors(seq: str, ops: list[tuple[str, int]], genome: str, reverse: bool) -> list[tuple[int, int, str]]:
    """(pos, type, base in read) of one record, in sequencing orientation, ordered.

    ``seq`` is in genome orientation and holds all bases but hard-clipped ones; ``genome`` is the
    stretch that the record covers. Inserted bases are INSERTIONs; one missing base is
    DEL_OF_<base>, at the base before the gap, several are MULTIDEL; soft-clipped bases say
    nothing; a hard clip is a MULTIDEL at the read's end there. Genome bases other than A, C, G, T
    say nothing either.
    """
    at = place = 0
    found: list[tuple[int, str, str]] = []  # (position, kind, genome base)
    for op, n in ops:
        if op in "M=X":
            for k in range(min(n, len(seq) - at, len(genome) - place)):
                if seq[at + k] != genome[place + k]:
                    found.append((at + k, "sub", genome[place + k]))
            at, place = at + n, place + n
        elif op == "I":
            found += [(at + k, "ins", "") for k in range(n)]
            at += n
        elif op == "D":
            # seen from the other strand, the base before the gap is the one after it here
            found.append((at if reverse else at - 1, "del", genome[place : place + 1] if n == 1 else ""))
            place += n
        elif op == "S":
            at += n
        elif op == "H":
            found.append((max(0, at - 1), "multi", ""))
        elif op == "N":
            place += n
    out = []
    for pos, kind, true in found:
        base = _TURNED.get(true, true) if reverse else true
        code = {"sub": _SUB.get(base), "ins": CODE["INSERTION"], "multi": CODE["MULTIDEL"], "del": _DEL.get(base) if true else CODE["MULTIDEL"]}[kind]
        if code is None or not seq:
            continue
        pos = min(max(pos, 0), len(seq) - 1)
        own = seq[pos]
        out.append((len(seq) - 1 - pos if reverse else pos, code, _TURNED.get(own, own) if reverse else own))
    return sorted(out)


def cost_table(original: str, corrected: str, free_ends: bool):
    """Edit costs of all prefixes as a function of both lengths; N and S in the original match anything."""
    rows = [[0 if free_ends else j for j in range(len(corrected) + 1)]]
    for i, x in enumerate(original, 1):
        rows.append([0 if free_ends else i])
        for j, y in enumerate(corrected, 1):
            rows[i].append(min(rows[i - 1][j - 1] + (x not in "NS" and x != y), rows[i - 1][j] + 1, rows[i][j - 1] + 1))
    return lambda i, j: rows[i][j]
