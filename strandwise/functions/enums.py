"""Code tables of error types and k-mer types, and predicates on their codes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The order of the codes decides ties.
ERROR_TYPES = (
    "CORRECT",
    "SUB_OF_A",
    "SUB_OF_C",
    "SUB_OF_G",
    "SUB_OF_T",
    "INSERTION",
    "DEL_OF_A",
    "DEL_OF_C",
    "DEL_OF_G",
    "DEL_OF_T",
    "MULTIDEL",
    "NODEL",
)
KMER_TYPES = ("UNTRUSTED", "UNIQUE", "REPEAT")
GENOME_TYPES = ("LINEAR", "CIRCULAR")
ALGORITHMS = ("NONE", "SIMPLE_KMER", "ADAPTIVE_KMER", "PARTIAL_MSA", "SUFFIX_TREE", "FULL_MSA")
COUNTING = ("FM_INDEX", "NAIVE_BUFFERED")
CODE = {name: code for code, name in enumerate(ERROR_TYPES)}
KMER_CODE = {name: code for code, name in enumerate(KMER_TYPES)}
UNTRUSTED, UNIQUE, REPEAT = range(3)

RANGES = {"all": (0, 11), "error": (1, 10), "base": (0, 5), "gap": (6, 11)}


def error_type_table(spark: SparkSession, which: str = "all") -> DataFrame:
    """code, name, kind ('base' or 'gap'), is_error for one of the ranges of types."""
    low, high = RANGES[which]
    rows = [(c, n, "base" if c <= 5 else "gap", 1 <= c <= 10) for c, n in enumerate(ERROR_TYPES) if low <= c <= high]
    return spark.createDataFrame(rows, "code int, name string, kind string, is_error boolean")


def kmer_type_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(enumerate(KMER_TYPES)), "code int, name string")


def error_type_name(code: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, ERROR_TYPES)), code.cast("int") + 1)


def kmer_type_name(code: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, KMER_TYPES)), code.cast("int") + 1)


def is_base_type(code: Column) -> Column:
    return code.between(0, 5)


def is_gap_type(code: Column) -> Column:
    return code.between(6, 11)


def kind_of(code: Column) -> Column:
    return F.when(is_base_type(code), "base").when(is_gap_type(code), "gap")


def no_error(kind: Column) -> Column:
    """The type that stands for 'nothing wrong here': CORRECT for bases, NODEL for gaps."""
    return F.when(kind == "base", CODE["CORRECT"]).otherwise(CODE["NODEL"])


def _inferred(base: Column, first: int, strict: bool) -> Column:
    at = F.instr(F.lit("ACGT"), F.upper(base))
    known = (F.length(base) == 1) & (at > 0)
    wrong = F.raise_error(F.concat(F.lit("not a base: "), F.coalesce(base, F.lit("null")))).cast("int") if strict else F.lit(None).cast("int")
    return F.when(known, at + (first - 1)).otherwise(wrong)


def substitution_of(base: Column, strict: bool = False) -> Column:
    """SUB_OF_<base>; null (or an error, if strict) for anything but A, C, G, T."""
    return _inferred(base, CODE["SUB_OF_A"], strict)


def deletion_of(base: Column, strict: bool = False) -> Column:
    return _inferred(base, CODE["DEL_OF_A"], strict)


def is_skipped(code: Column, pos: Column, seq: Column, indels: bool = True, multidels: bool = False) -> Column:
    """Whether a correction of this type at this place is left out of the candidates."""
    shifting = is_gap_type(code) | (code == CODE["INSERTION"])
    at_end = (pos == 0) | (pos == F.length(seq) - 1)
    same = code == substitution_of(F.substring(seq, pos + 1, F.lit(1)))
    return F.coalesce(
        (F.lit(not indels) & shifting) | (at_end & shifting) | (F.lit(not multidels) & (code == CODE["MULTIDEL"])) | F.coalesce(same, F.lit(False)), F.lit(False)
    )
