"""Error profiles learnt from corrections: overall rates and motifs around errors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandwise.functions.enums import CODE, substitution_of

from .kmers import windows

#: Longest motif, and the letters in the order of their digits.
MAX_MOTIF = 6
LETTERS = "ACGTN"


def log_or_minus_infinity(x: Column) -> Column:
    return F.when(x > 0, F.ln(x)).otherwise(F.lit(float("-inf")))


def overall_counts(corrections: DataFrame, reads: DataFrame) -> DataFrame:
    """type, correct, read, n: substitutions by (correct base, base in read), other types by type alone, all cells dense.

    ``corrections`` is (rid, pos, type, base_in_read), ``reads`` (rid, seq). Rows with type null
    hold the totals: correct = 'bases' (all bases), 'noncorrect', 'deleted'.
    """
    spark = corrections.sparkSession
    base = F.when(F.col("type").between(1, 4), F.substring(F.lit("ACGT"), F.col("type"), F.lit(1)))
    by_type = corrections.groupBy("type", base.alias("correct"), F.when(base.isNotNull(), F.col("base_in_read")).alias("read")).agg(F.count("*").alias("n"))
    cells = [(CODE[f"SUB_OF_{c}"], c, r) for c in "ACGT" for r in LETTERS] + [(t, None, None) for t in (5, 6, 7, 8, 9, 10)]
    grid = spark.createDataFrame(cells, "type int, correct string, read string")
    same = F.col("g.type").eqNullSafe(F.col("c.type")) & F.col("g.correct").eqNullSafe(F.col("c.correct")) & F.col("g.read").eqNullSafe(F.col("c.read"))
    dense = F.broadcast(grid).alias("g").join(by_type.alias("c"), same, "left").select("g.type", "g.correct", "g.read", F.coalesce("c.n", F.lit(0)).alias("n"))
    noncorrect = F.col("type").between(1, 5)
    sums = corrections.agg(F.count_if(noncorrect).alias("noncorrect"), F.count_if(F.col("type").between(6, 10)).alias("deleted"))
    bases = reads.agg(F.coalesce(F.sum(F.length("seq")), F.lit(0)).alias("bases"))
    totals = sums.crossJoin(bases).select(F.explode(F.array(*[F.struct(F.lit(c).alias("correct"), F.col(c).alias("n")) for c in ("bases", "noncorrect", "deleted")])).alias("t"))  # one row each
    return dense.unionByName(totals.select(F.lit(None).cast("int").alias("type"), "t.correct", F.lit(None).cast("string").alias("read"), "t.n"))


def error_rates(counts: DataFrame) -> DataFrame:
    """current_base (share of bases that are wrong) and next_gap (gaps per base)."""
    of = lambda name: F.max(F.when(F.col("type").isNull() & (F.col("correct") == name), F.col("n")))
    sums = counts.agg(of("bases").cast("double").alias("b"), of("noncorrect").alias("x"), of("deleted").alias("d"))
    share = lambda c: F.when(F.col("b") > 0, F.col(c) / F.col("b"))
    return sums.select(share("x").alias("current_base"), share("d").alias("next_gap"))


def log_profile(counts: DataFrame) -> DataFrame:
    """type, read (base in read for substitutions, else null), log_p: natural logs of count / bases; -inf for none.

    CORRECT and NODEL have what remains.
    """
    bases = counts.where("type is null and correct = 'bases'").select(F.col("n").cast("double").alias("bases"))
    wrong = counts.where("type is null and correct = 'noncorrect'").select(F.col("n").alias("wrong"))
    gaps = counts.where("type is null and correct = 'deleted'").select(F.col("n").alias("gaps"))
    one = bases.crossJoin(wrong).crossJoin(gaps)  # one row each
    log = lambda n: log_or_minus_infinity(F.when(F.col("bases") > 0, n / F.col("bases")))
    types = counts.where("type is not null").crossJoin(F.broadcast(one)).select("type", "read", log(F.col("n")).alias("log_p"))
    rest = one.select(F.explode(F.array(F.struct(F.lit(CODE["CORRECT"]).alias("type"), log(F.col("bases") - F.col("wrong")).alias("log_p")), F.struct(F.lit(CODE["NODEL"]).alias("type"), log(F.col("bases") - F.col("gaps")).alias("log_p")))).alias("r"))
    return types.unionByName(rest.select("r.type", F.lit(None).cast("string").alias("read"), "r.log_p"))


def probabilities(sequences: DataFrame, profile: DataFrame, seq: str = "seq", first: int | None = None, last: int | None = None) -> DataFrame:
    """Sequences' positions (all, or first..last inclusive) with ``log_p``, a map from type to log probability.

    '_' in a sequence (several deleted bases) is an error.
    """
    text = F.when(F.contains(F.col(seq), F.lit("_")), F.raise_error(F.lit("'_' has no profile")).cast("string")).otherwise(F.col(seq))
    spread = sequences.select("*", F.posexplode(F.split(text, "")).alias("pos", "base")).where("base <> ''")
    if first is not None:
        spread = spread.where(F.col("pos") >= first)
    if last is not None:
        spread = spread.where(F.col("pos") <= last)
    spark = sequences.sparkSession
    letters = spark.createDataFrame([(c,) for c in LETTERS], "letter string")
    by_base = letters.join(profile, F.col("read").isNull() | (F.col("read") == F.col("letter"))).groupBy("letter").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("type", "log_p")))).alias("log_p"))  # 5 x 26 rows
    return spread.join(F.broadcast(by_base), F.col("base") == F.col("letter"), "left").drop("letter")


def motif_index(motif: Column) -> Column:
    """Position of a motif in the order of length, then letters; null for other characters or lengths."""
    number = F.conv(F.translate(motif, LETTERS, "01234"), 5, 10).cast("long")
    before = F.element_at(F.array(*[F.lit(sum(5**j for j in range(1, n))) for n in range(1, MAX_MOTIF + 1)]), F.length(motif))
    return F.when(motif.rlike(f"^[{LETTERS}]{{1,{MAX_MOTIF}}}$"), before + number)


def index_motif(index: Column) -> Column:
    out = F.lit(None).cast("string")
    before = 0
    for n in range(1, MAX_MOTIF + 1):
        own = F.translate(F.lpad(F.conv((index - before).cast("string"), 10, 5), n, "0"), "01234", LETTERS)
        out = F.when((index >= before) & (index < before + 5**n), own).otherwise(out)
        before += 5**n
    return out


def motif_counts(corrections: DataFrame, reads: DataFrame) -> DataFrame:
    """motif, pos, type, num_errors: for each error every stretch of 1 to 6 bases of the read that covers it, with the error's place in it."""
    errors = corrections.select("rid", F.col("pos").alias("at"), "type").join(reads.select("rid", "seq"), "rid")
    lengths = F.explode(F.sequence(F.lit(1), F.lit(MAX_MOTIF)))
    spread = errors.select("seq", "at", "type", lengths.alias("len"))
    begins = F.sequence(F.greatest(F.lit(0), F.col("at") - F.col("len") + 1), F.least(F.col("at"), F.length("seq") - F.col("len")))
    spread = spread.where((F.col("len") <= F.length("seq")) & (F.greatest(F.lit(0), F.col("at") - F.col("len") + 1) <= F.least(F.col("at"), F.length("seq") - F.col("len"))))
    spread = spread.select("seq", "at", "type", "len", F.explode(begins).alias("begin"))
    return spread.groupBy(F.substring("seq", F.col("begin") + 1, F.col("len")).alias("motif"), (F.col("at") - F.col("begin")).cast("int").alias("pos"), "type").agg(F.count("*").alias("num_errors"))


def motif_occurrences(reads: DataFrame) -> DataFrame:
    """motif, cnt: occurrences of every stretch of 1 to 6 bases on both strands of the reads."""
    from strandwise.functions.sequence import reverse_complement

    both = windows(reads, range(1, MAX_MOTIF + 1)).groupBy("k", "kmer").agg(F.count("*").alias("n"))
    return both.select(F.explode(F.array(F.struct(F.col("kmer").alias("motif"), "n"), F.struct(reverse_complement(F.col("kmer")).alias("motif"), "n"))).alias("m")).groupBy("m.motif").agg(F.sum("m.n").alias("both")).select(
        "motif", F.when((F.length("motif") % 2 == 0) & (F.col("motif") == reverse_complement(F.col("motif"))), F.expr("both div 2")).otherwise(F.col("both")).alias("cnt")
    )


def motif_zscores(counts: DataFrame, occurrences: DataFrame) -> DataFrame:
    """motif, pos, type, num_errors, z of motifs of 3 to 6 bases, against what their parts let expect.

    Parts without the error's place take their count from the sequence itself. No z where the
    inner part never occurs or the variance is 0.
    """
    n = F.length("motif")
    rows = counts.where(n >= 3).select(
        "*",
        F.substring("motif", F.lit(1), n - 1).alias("left"),
        F.substring("motif", F.lit(2), n - 1).alias("right"),
        F.substring("motif", F.lit(2), n - 2).alias("inner"),
    )

    def part(rows: DataFrame, name: str, shift: int, outside: Column) -> DataFrame:
        own = counts.select(F.col("motif").alias("_m"), F.col("pos").alias("_p"), F.col("type").alias("_t"), F.col("num_errors").alias("_n"))
        plain = occurrences.select(F.col("motif").alias("_o"), F.col("cnt").alias("_c"))
        rows = rows.join(own, (F.col(name) == F.col("_m")) & (F.col("pos") - shift == F.col("_p")) & (F.col("type") == F.col("_t")), "left").join(F.broadcast(plain), F.col(name) == F.col("_o"), "left")
        value = F.when(outside, F.coalesce("_c", F.lit(0))).otherwise(F.coalesce("_n", F.lit(0)))
        return rows.withColumn(name + "_n", value.cast("double")).drop("_m", "_p", "_t", "_n", "_o", "_c")

    at_begin, at_end = F.col("pos") == 0, F.col("pos") == n - 1
    rows = part(rows, "left", 0, at_end)
    rows = part(rows, "right", 1, at_begin)
    rows = part(rows, "inner", 1, at_begin | at_end)
    left, right, inner = F.col("left_n"), F.col("right_n"), F.when(F.col("inner_n") != 0, F.col("inner_n"))
    expected = left * right / inner
    variance = expected * (inner - left) * (inner - right) / (inner * inner)
    z = F.when(variance > 0, (F.col("num_errors") - expected) / F.sqrt(variance))
    return rows.select("motif", "pos", "type", "num_errors", z.alias("z"))


def extreme_z(positions: DataFrame, zscores: DataFrame) -> DataFrame:
    """rid, pos, type, z: of all motifs (3 to 6 bases) of a read that cover a position, the z farthest from 0; the larger on ties.

    ``positions`` is (rid, seq, pos).
    """
    spread = positions.select("rid", "seq", "pos", F.explode(F.sequence(F.lit(3), F.lit(MAX_MOTIF))).alias("len")).where(F.col("len") <= F.length("seq"))
    first, last = F.greatest(F.lit(0), F.col("pos") - F.col("len") + 1), F.least(F.col("pos"), F.length("seq") - F.col("len"))
    spread = spread.where(first <= last).select("rid", "pos", F.explode(F.transform(F.sequence(first, last), lambda b: F.struct(F.substring(F.col("seq"), b + 1, F.col("len")).alias("motif"), (F.col("pos") - b).cast("int").alias("at")))).alias("m"))
    table = zscores.where("z is not null").select(F.col("motif").alias("_m"), F.col("pos").alias("_p"), "type", "z")
    found = spread.join(table, (F.col("m.motif") == F.col("_m")) & (F.col("m.at") == F.col("_p"))).groupBy("rid", "pos", "type").agg(F.min("z").alias("low"), F.max("z").alias("high"))
    return found.select("rid", "pos", "type", F.when(F.abs("low") > F.abs("high"), F.col("low")).otherwise(F.col("high")).alias("z"))


def motif_probabilities(positions: DataFrame, zscores: DataFrame) -> DataFrame:
    """rid, pos and a map ``score`` from type to extreme z; substituting a base for itself has the lowest double, CORRECT and NODEL 0."""
    lowest = -1.7976931348623157e308
    found = extreme_z(positions, zscores).groupBy("rid", "pos").agg(F.collect_list(F.struct("type", "z")).alias("found"))
    own = substitution_of(F.substring(F.col("seq"), F.col("pos") + 1, F.lit(1)))
    rows = positions.join(found, ["rid", "pos"], "left").withColumn("own", own)
    entries = F.filter(F.coalesce("found", F.array().cast("array<struct<type: int, z: double>>")), lambda x: (x["type"] != F.coalesce(F.col("own"), F.lit(-1))) & ~x["type"].isin(0, 11))
    fixed = F.array(F.struct(F.lit(0).alias("type"), F.lit(0.0).alias("z")), F.struct(F.lit(11).alias("type"), F.lit(0.0).alias("z")))
    self_ = F.when(F.col("own").isNotNull(), F.array(F.struct(F.col("own").alias("type"), F.lit(lowest).alias("z")))).otherwise(F.array().cast("array<struct<type: int, z: double>>"))
    return rows.select("rid", "pos", F.map_from_entries(F.concat(entries, fixed, self_)).alias("score"))


def notable_motifs(zscores: DataFrame, least: float = 1.0) -> DataFrame:
    return zscores.where(F.abs("z") >= least)


def store_profile(profile: DataFrame, path: str) -> None:
    profile.write.mode("overwrite").parquet(path)


def load_counts(spark: SparkSession, path: str) -> DataFrame:
    """Stored counts; ``log_profile`` of them gives the probabilities again."""
    return spark.read.parquet(path)
