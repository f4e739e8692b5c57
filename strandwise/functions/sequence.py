"""Column functions on nucleotide strings. All are null for null input."""

from __future__ import annotations

import itertools

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from .enums import CODE

#: k up to which a k-mer's base-4 number fits a BIGINT.
MAX_NUMBERED_K = 31


def complement(c: Column) -> Column:
    """A-T and C-G swapped in either case; everything else stays."""
    return F.translate(c, "ACGTacgt", "TGCAtgca")


def reverse_complement(s: Column) -> Column:
    return F.reverse(complement(s))


def reverse_complement_read(name: Column, seq: Column, qual: Column) -> Column:
    return F.struct(name.alias("name"), reverse_complement(seq).alias("seq"), F.reverse(qual).alias("qual"))


def gc_count(s: Column) -> Column:
    """Number of upper-case G and C."""
    return F.length(s) - F.length(F.translate(s, "GC", ""))


def gc_content(s: Column) -> Column:
    """Share of G and C of all characters; null for the empty string."""
    return F.when(F.length(s) > 0, gc_count(s).cast("double") / F.length(s))


def is_own_reverse_complement(s: Column) -> Column:
    return (F.length(s) % 2 == 0) & (s == reverse_complement(s))


def canonical(kmer: Column) -> Column:
    """The smaller of a k-mer and its reverse complement: one key for both strands."""
    return F.least(kmer, reverse_complement(kmer))


def base_number(c: Column, strict: bool = False) -> Column:
    at = F.instr(F.lit("ACGT"), c)
    wrong = F.raise_error(F.lit("not a base")).cast("int") if strict else F.lit(None).cast("int")
    return F.when((F.length(c) == 1) & (at > 0), at - 1).otherwise(wrong)


def kmer_number(kmer: Column) -> Column:
    """Base-4 number with A 0, C 1, G 2, T 3, first base most significant; null with any other character or k > 31."""
    plain = kmer.rlike("^[ACGT]+$") & (F.length(kmer) <= MAX_NUMBERED_K)
    return F.when(plain, F.conv(F.translate(kmer, "ACGT", "0123"), 4, 10).cast("long"))


def number_kmer(number: Column, k: Column | int) -> Column:
    """Inverse of ``kmer_number`` for k-mers of length k."""
    k = F.lit(k) if isinstance(k, int) else k
    return F.translate(F.lpad(F.conv(number.cast("string"), 10, 4), k, F.lit("0")), "0123", "ACGT")


def packed_kmer(number: Column, k: int) -> Column:
    """What ``number_kmer`` gives of numbers below 4^k, looked up four bases at a time."""

    def bases(n: int, above: int) -> Column:
        """The n bases with ``above`` bases after them."""
        names = ",".join("".join(x) for x in itertools.product("ACGT", repeat=n))
        return F.get(F.split(F.lit(names), ","), F.shiftright(number, 2 * above).bitwiseAND(4**n - 1).cast("int"))

    sizes = ([k % 4] if k % 4 else []) + [4] * (k // 4)
    return F.concat(*[bases(n, sum(sizes[i + 1 :])) for i, n in enumerate(sizes)])


def _edited(kmer: Column, pos: Column, code: Column, insert_after: int) -> Column:
    before, rest = F.substring(kmer, F.lit(1), pos), F.substring(kmer, pos + 2, F.length(kmer))
    here = F.substring(kmer, pos + 1, F.lit(1))
    base = F.substring(F.lit("ACGT"), F.pmod(code - 1, F.lit(5)) + 1, F.lit(1))
    put = F.when(code == CODE["MULTIDEL"], F.lit("_")).otherwise(base)
    grown = F.concat(before, here, put, rest) if insert_after else F.concat(before, put, here, rest)
    return (
        F.when((pos < 0) | (pos >= F.length(kmer)), F.lit(None).cast("string"))
        .when(code.between(CODE["SUB_OF_A"], CODE["SUB_OF_T"]), F.concat(before, base, rest))
        .when(code == CODE["INSERTION"], F.concat(before, rest))
        .when(code.between(CODE["DEL_OF_A"], CODE["MULTIDEL"]), grown)
        .otherwise(kmer)
    )


def undo_error_before(kmer: Column, pos: Column, code: Column) -> Column:
    """The k-mer with an error of this type at pos undone; deleted bases go in before pos, '_' for several.

    Null where pos is outside the k-mer.
    """
    return _edited(kmer, pos, code, insert_after=0)


def undo_error_after(kmer: Column, pos: Column, code: Column) -> Column:
    """As ``undo_error_before`` with deleted bases put after pos; several deleted bases can't be undone (null)."""
    return F.when(code != CODE["MULTIDEL"], _edited(kmer, pos, code, insert_after=1))


def cigar_ops(cigar: Column) -> Column:
    """CIGAR text as an array of (op, len)."""
    pattern = F.lit(r"(\d+)([MIDNSHP=X])")
    ops, lengths = F.regexp_extract_all(cigar, pattern, 2), F.regexp_extract_all(cigar, pattern, 1)
    return F.zip_with(ops, lengths, lambda op, n: F.struct(op.alias("op"), n.cast("int").alias("len")))


def cigar_text(ops: Column) -> Column:
    """'op:len ' for each element."""
    return F.concat_ws("", F.transform(ops, lambda x: F.concat(x["op"], F.lit(":"), x["len"].cast("string"), F.lit(" "))))


def normal_name(name: Column) -> Column:
    """Name up to its first space, then up to its first slash."""
    return F.substring_index(F.substring_index(name, " ", 1), "/", 1)


def natural_key(name: Column, width: int = 20) -> Column:
    """Sort key in which runs of digits compare as numbers: each run is padded to ``width`` digits."""
    runs = F.regexp_extract_all(name, F.lit(r"(\d+|\D+)"), 1)
    return F.transform(runs, lambda r: F.when(r.rlike("^[0-9]"), F.lpad(r, width, "0")).otherwise(r))


def edit_distance(a: Column, b: Column) -> Column:
    return F.levenshtein(a, b)


def register(spark: SparkSession) -> None:
    """Make the functions that SQL users need available by name, as SQL functions (no Python at run time)."""
    for name, args, body in (
        ("revcomp", "s STRING", "reverse(translate(s, 'ACGTacgt', 'TGCAtgca'))"),
        ("gc_count", "s STRING", "length(s) - length(translate(s, 'GC', ''))"),
        ("canonical_kmer", "s STRING", "least(s, reverse(translate(s, 'ACGTacgt', 'TGCAtgca')))"),
        ("kmer_number", "s STRING", "CASE WHEN s RLIKE '^[ACGT]{1,31}$' THEN CAST(conv(translate(s, 'ACGT', '0123'), 4, 10) AS BIGINT) END"),
        ("normal_name", "s STRING", "substring_index(substring_index(s, ' ', 1), '/', 1)"),
    ):
        kind = "BIGINT" if name == "kmer_number" else "INT" if name == "gc_count" else "STRING"
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS {kind} RETURN {body}")
