"""Errors of reads as alignments to a genome show them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandwise.functions.enums import CODE
from strandwise.functions.sequence import complement, reverse_complement

from .align import CORRECTIONS

_READ = ("M", "=", "X", "I", "S")
_GENOME = ("M", "=", "X", "D", "N")


def _turned_base(base: Column, turned: Column) -> Column:
    return F.when(turned, F.translate(base, "ACGT", "TGCA")).otherwise(base)


def placed_ops(ops: Column) -> Column:
    """Operations with where they begin in the read (at) and in the genome stretch (place)."""
    size = lambda x, kinds: F.when(x["op"].isin(*kinds), x["len"]).otherwise(0)
    entry = "array<struct<op: string, len: int, at: int, place: int>>"
    state = lambda at, place, out: F.struct(at.cast("int").alias("at"), place.cast("int").alias("place"), out.cast(entry).alias("out"))
    return F.aggregate(
        F.coalesce(ops, F.array().cast("array<struct<op: string, len: int>>")),
        state(F.lit(0), F.lit(0), F.array()),
        lambda a, x: state(a["at"] + size(x, _READ), a["place"] + size(x, _GENOME), F.concat(a["out"], F.array(F.struct(x["op"].alias("op"), x["len"].alias("len"), a["at"].alias("at"), a["place"].alias("place"))))),
        lambda a: a["out"],
    )


def with_record_errors(records: DataFrame, window: str = "window", into: str = "errors") -> DataFrame:
    """Rows (flag, seq, ops, and the genome stretch from the record's position on) with their errors, as an array of
    (pos, type, base in read) in sequencing orientation, ordered; unmapped records are an error.

    ``seq`` is in genome orientation and holds all bases but hard-clipped ones. Inserted bases are INSERTIONs; one missing
    base is DEL_OF_<base>, at the base before the gap, several are MULTIDEL; soft-clipped bases say nothing; a hard clip is
    a MULTIDEL at the read's end there. Genome bases other than A, C, G, T say nothing either. Operations are
    placed by one fold and each turned into its errors by column functions: nothing leaves the JVM and no row is
    multiplied.
    """
    seq, stretch = F.coalesce(F.col("seq"), F.lit("")), F.coalesce(F.col(window), F.lit(""))
    last = F.length(seq) - 1
    turned = F.col("flag").bitwiseAND(16) != 0
    none = F.array().cast(CORRECTIONS)

    def error(at: Column, code: Column) -> Column:
        at = F.least(F.greatest(at, F.lit(0)), last)
        base = _turned_base(F.substring(seq, at + 1, F.lit(1)), turned)
        return F.struct(F.when(turned, last - at).otherwise(at).cast("int").alias("pos"), code.cast("int").alias("type"), base.alias("base"))

    def code_of(base: Column, first: str) -> Column:
        at = F.instr(F.lit("ACGT"), _turned_base(base, turned))
        return F.when((F.length(base) == 1) & (at > 0), at + (CODE[first] - 1))

    def mismatches(x: Column) -> Column:
        own, true = F.substring(seq, x["at"] + 1, x["len"]), F.substring(stretch, x["place"] + 1, x["len"])
        pairs = F.zip_with(F.split(own, ""), F.split(true, ""), lambda a, b: F.struct(a.alias("own"), b.alias("true")))
        found = F.filter(F.transform(pairs, lambda e, k: F.struct(k.alias("k"), e["own"].alias("own"), e["true"].alias("true"))), lambda e: (F.length(e["own"]) == 1) & (F.length(e["true"]) == 1) & (e["own"] != e["true"]))
        return F.when(own == true, none).otherwise(F.transform(found, lambda e: error(x["at"] + e["k"], code_of(e["true"], "SUB_OF_A"))))

    def of(x: Column) -> Column:
        gap = F.substring(stretch, x["place"] + 1, F.lit(1))
        missing = F.when((x["len"] == 1) & (gap != ""), code_of(gap, "DEL_OF_A")).otherwise(CODE["MULTIDEL"])
        inserted = F.when(x["len"] > 0, F.transform(F.sequence(F.lit(0), F.greatest(x["len"], F.lit(1)) - 1), lambda k: error(x["at"] + k, F.lit(CODE["INSERTION"])))).otherwise(none)
        return (
            F.when(x["op"].isin("M", "=", "X"), mismatches(x))
            .when(x["op"] == "I", inserted)
            .when(x["op"] == "D", F.array(error(F.when(turned, x["at"]).otherwise(x["at"] - 1), missing)))  # the base before the gap, seen from the read's own strand
            .when(x["op"] == "H", F.array(error(x["at"] - 1, F.lit(CODE["MULTIDEL"]))))
            .otherwise(none)
        )

    found = F.array_sort(F.filter(F.flatten(F.transform(placed_ops(F.col("ops")), of)), lambda e: e["type"].isNotNull()))
    unmapped = F.raise_error(F.lit("an unmapped record has no errors to extract")).cast(CORRECTIONS)
    return records.withColumn(into, F.when(F.col("flag").bitwiseAND(4) != 0, unmapped).when(seq == "", none).otherwise(found))


def genome_span(ops: Column) -> Column:
    """Genome bases that a record covers."""
    return F.aggregate(ops, F.lit(0), lambda n, x: n + F.when(x["op"].isin("M", "=", "X", "D", "N"), x["len"]).otherwise(0))


def with_soft_clips(rows: DataFrame, seq: str = "seq", ops: str = "ops", into: str = "masked") -> DataFrame:
    """Rows with soft-clipped bases as S; a hard clip is an error."""
    hard = F.exists(F.col(ops), lambda x: x["op"] == "H")
    part = F.aggregate(
        F.col(ops),
        F.struct(F.lit(1).alias("at"), F.lit("").alias("out")),
        lambda a, x: F.when(x["op"] == "S", F.struct((a["at"] + x["len"]).alias("at"), F.concat(a["out"], F.repeat(F.lit("S"), x["len"])).alias("out")))
        .when(x["op"].isin("M", "=", "X", "I"), F.struct((a["at"] + x["len"]).alias("at"), F.concat(a["out"], F.substring(F.col(seq), a["at"], x["len"])).alias("out")))
        .otherwise(a),
        lambda a: a["out"],
    )
    return rows.withColumn(into, F.when(hard, F.raise_error(F.lit("hard-clipped record")).cast("string")).otherwise(part))


def has_soft_clip(ops: Column) -> Column:
    return F.exists(ops, lambda x: x["op"] == "S")


def without_placeholders(seq: Column) -> Column:
    """The read as sequenced: deletion placeholders dropped, upper case."""
    return F.upper(F.translate(seq, "D", ""))


def substitution_errors(records: DataFrame, keys: Sequence[str] = ("rid",), seq: str = "seq", window: str = "window") -> DataFrame:
    """keys, pos, type, base_in_read of records that only match or mismatch; seq and window in genome orientation."""
    from strandwise.functions.enums import substitution_of

    from .align import substitutions

    found = substitutions(records.select(*keys, "flag", seq, window, F.length(seq).alias("_n")), [*keys, "flag", "_n"], seq, window)
    turned = F.col("flag").bitwiseAND(16) != 0
    true = F.when(turned, complement(F.col("true"))).otherwise(F.col("true"))
    return found.select(
        *keys,
        F.when(turned, F.col("_n") - 1 - F.col("pos")).otherwise(F.col("pos")).cast("int").alias("pos"),
        substitution_of(true).cast("int").alias("type"),
        F.when(turned, complement(F.col("base"))).otherwise(F.col("base")).alias("base_in_read"),
    ).where("type is not null")


def sequenced(seq: Column, flag: Column) -> Column:
    """Sequence in sequencing orientation."""
    return F.when(flag.bitwiseAND(16) != 0, reverse_complement(seq)).otherwise(seq)
