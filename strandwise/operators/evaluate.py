"""Evaluation of corrections and of k-mer classes as confusion tables."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandwise.functions.enums import KMER_TYPES, error_type_name, kind_of, kmer_type_name, no_error
from strandwise.functions.sequence import canonical, cigar_ops, gc_content, normal_name

from .align import with_alignment
from .cigar import genome_span, sequenced, with_record_errors
from .classify import classify_by_read_median, genome_class, kmer_class
from .coverage import bias_at, kmer_bias
from .kmers import look_up


def join_by_name(corrected: DataFrame, alignments: DataFrame) -> DataFrame:
    """Corrected reads (name, seq) with the alignment of the same normalised name, where it is mapped and has one record."""
    single = (
        alignments.withColumn("_name", normal_name(F.col("qname")))
        .withColumn("_records", F.count("*").over(Window.partitionBy("_name")))
        .where((F.col("_records") == 1) & (F.col("flag").bitwiseAND(4) == 0))
        .drop("_records")
    )
    own = corrected.select(normal_name(F.col("name")).alias("norm_name"), F.col("seq").alias("corrected"))
    return own.join(single, F.col("norm_name") == F.col("_name")).drop("_name")


def paired_errors(truth: DataFrame, predicted: DataFrame, keys: Iterable[str] = ("rid",)) -> DataFrame:
    """What ``match_errors`` gives, with nth: the number of the pair at its place and kind, from 1."""
    keys = list(keys)

    def numbered(errors: DataFrame, name: str) -> DataFrame:
        kind = kind_of(F.col("type"))
        place = Window.partitionBy(*keys, "pos", "kind").orderBy("type")
        return errors.select(*keys, "pos", kind.alias("kind"), "type").withColumn("nth", F.row_number().over(place)).withColumnRenamed("type", name)

    both = numbered(truth, "truth").join(numbered(predicted, "predicted"), [*keys, "pos", "kind", "nth"], "full_outer")
    nothing = no_error(F.col("kind"))
    return both.select(*keys, "pos", "kind", "nth", F.coalesce("truth", nothing).alias("truth"), F.coalesce("predicted", nothing).alias("predicted"))


def match_errors(truth: DataFrame, predicted: DataFrame, keys: Iterable[str] = ("rid",)) -> DataFrame:
    """keys, pos, kind, truth, predicted: errors of both sides paired by place and kind; what is missing is CORRECT or NODEL.

    Several errors of one kind at one place pair up in the order of their types.
    """
    return paired_errors(truth, predicted, keys).drop("nth")


def error_confusion(matched: DataFrame, positions: DataFrame, keys: Iterable[str] = ("rid",)) -> DataFrame:
    """kind, truth, predicted, n over all 36 + 36 cells.

    ``positions`` has one row with ``n``, the number of positions of all evaluated reads; those
    without an event of a kind count as CORRECT or NODEL there. Pairs are counted once, and with them, where they have nth, their places.
    """
    spark = matched.sparkSession
    cells = [("base", t, p) for t in range(6) for p in range(6)] + [("gap", t, p) for t in range(6, 12) for p in range(6, 12)]
    grid = spark.createDataFrame(cells, "kind string, truth int, predicted int")
    if "nth" not in matched.columns:
        matched = matched.withColumn("nth", F.row_number().over(Window.partitionBy("kind", *keys, "pos").orderBy("truth")))
    counted = matched.groupBy("kind", "truth", "predicted").agg(F.count("*").alias("n"), F.count_if(F.col("nth") == 1).alias("places"))
    nothing = no_error(F.col("kind"))
    cell = lambda t, p, n: F.struct(t.cast("int").alias("truth"), p.cast("int").alias("predicted"), n.cast("long").alias("n"))
    events = counted.select("kind", F.inline(F.array(cell(F.col("truth"), F.col("predicted"), F.col("n")), cell(nothing, nothing, -F.col("places")))))
    kinds = spark.createDataFrame([("base",), ("gap",)], "kind string")
    every = kinds.crossJoin(F.broadcast(positions.select(F.col("n").alias("all")))).select("kind", F.inline(F.array(cell(nothing, nothing, F.col("all")))))  # one row
    total = events.unionByName(every).groupBy("kind", "truth", "predicted").agg(F.sum("n").alias("n"))
    return _dense(grid, total)


def _dense(grid: DataFrame, counted: DataFrame) -> DataFrame:
    return grid.join(F.broadcast(counted), ["kind", "truth", "predicted"], "left").select("kind", "truth", "predicted", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def classified_counts(classes: DataFrame, genome_counts: DataFrame | None = None) -> DataFrame:
    """truth, predicted, inner by distinct k-mer: what ``kmer_truth`` and ``predict_kmers`` say of its ``inner`` occurrences, without a row for each.

    Without ``genome_counts`` classes have in_genome.
    """
    rows = classes.where("inner > 0")
    if genome_counts is not None:
        rows = rows.join(genome_counts.select("k", "kmer", F.col("cnt").alias("in_genome")), ["k", "kmer"], "left")
    return rows.select(genome_class(F.col("in_genome")).alias("truth"), F.col("class").alias("predicted"), "inner")


def kmer_confusion(rows: DataFrame, truth: str = "truth", predicted: str = "predicted", weight: Column | None = None) -> DataFrame:
    """kind ('kmer'), truth, predicted, n over all 9 cells; each row counts ``weight`` times (once, if none)."""
    spark = rows.sparkSession
    grid = spark.createDataFrame([("kmer", t, p) for t in range(3) for p in range(3)], "kind string, truth int, predicted int")
    counted = rows.groupBy(F.lit("kmer").alias("kind"), F.col(truth).cast("int").alias("truth"), F.col(predicted).cast("int").alias("predicted")).agg((F.count("*") if weight is None else F.sum(weight)).alias("n"))
    return _dense(grid, counted)


def names(confusion: DataFrame) -> DataFrame:
    """The same with type names instead of codes."""

    def name(c: str) -> Column:
        return F.when(F.col("kind") == "kmer", kmer_type_name(F.least(F.col(c), F.lit(len(KMER_TYPES) - 1)))).otherwise(error_type_name(F.col(c)))

    return confusion.select("kind", name("truth").alias("truth"), name("predicted").alias("predicted"), "n")


def switch_types(confusion: DataFrame) -> DataFrame:
    """For each error type t, cells (t, none) and (t, t) swapped."""
    nothing = no_error(F.col("kind"))
    switched = F.when(F.col("truth") == nothing, F.col("predicted")).when(F.col("predicted") == nothing, F.col("truth")).when(F.col("predicted") == F.col("truth"), nothing).otherwise(F.col("predicted"))
    return confusion.select("kind", "truth", switched.cast("int").alias("predicted"), "n")


def evaluate_corrections(corrected: DataFrame, alignments: DataFrame, windows: DataFrame | None = None, exclude_clipped: bool = True, compat_alignment: bool = False) -> DataFrame:
    """Confusion of corrected reads (name, seq) against alignments (qname, flag, pos0, cigar, seq).

    ``windows`` gives for qname the genome stretch from its position on (as long as the record
    covers, or longer); if none, alignments hold it as ``window``. Truth is what the alignment says, prediction what turned the original into
    the corrected read. Soft-clipped positions are left out, unless ``exclude_clipped`` is off.
    """
    held = ["window"] if windows is None else []
    own = join_by_name(corrected, alignments.select("qname", "flag", cigar_ops(F.col("cigar")).alias("ops"), "seq", *held))
    if windows is not None:
        own = own.join(windows.select(F.col("qname").alias("_q"), "window"), F.col("qname") == F.col("_q")).drop("_q")
    own = own.withColumn("window", F.substring("window", F.lit(1), genome_span(F.col("ops"))))
    own = with_record_errors(own).withColumn("original", sequenced(F.col("seq"), F.col("flag")))
    own = with_alignment(own, compat=compat_alignment)
    clips = F.when(F.lit(exclude_clipped), clipped(F.col("ops"), F.col("flag"), F.length("seq"))).otherwise(F.struct(F.lit(0).alias("head"), F.lit(0).alias("tail")))
    own = own.withColumn("clips", clips).withColumn("last", F.length("original") - F.col("clips.tail"))

    def spread(column: str) -> DataFrame:
        return own.select("norm_name", "clips", "last", F.explode(column).alias("e")).where((F.col("e.pos") >= F.col("clips.head")) & (F.col("e.pos") < F.col("last"))).select("norm_name", "e.pos", "e.type")

    matched = paired_errors(spread("errors"), spread("corrections"), ["norm_name"])
    positions = own.agg(F.coalesce(F.sum(F.col("last") - F.col("clips.head")), F.lit(0)).alias("n"))
    return error_confusion(matched, positions, ["norm_name"])


def clipped(ops: Column, flag: Column, length: Column) -> Column:
    """Soft-clipped bases at the (head, tail) of the read in sequencing orientation."""
    inner = F.filter(ops, lambda x: x["op"] != "H")
    n = F.size(inner)
    size = lambda x: F.when(x["op"] == "S", x["len"]).otherwise(0)
    head = F.when(n > 0, size(F.element_at(inner, 1))).otherwise(0)
    tail = F.when(n > 1, size(F.element_at(inner, -1))).otherwise(0)
    turned = flag.bitwiseAND(16) != 0
    return F.struct(F.when(turned, tail).otherwise(head).alias("head"), F.when(turned, head).otherwise(tail).alias("tail"))


def evaluate_corrections_aligned(original: DataFrame, corrected: DataFrame, windows: Sequence[DataFrame]) -> DataFrame:
    """Confusion where both original and corrected reads are alignments; an error left in the corrected one was not found."""

    def errors(alignments: DataFrame, stretch: DataFrame) -> DataFrame:
        rows = alignments.withColumn("norm_name", normal_name(F.col("qname"))).withColumn("_n", F.count("*").over(Window.partitionBy("norm_name")))
        rows = rows.where((F.col("_n") == 1) & (F.col("flag").bitwiseAND(4) == 0)).join(stretch.select(F.col("qname").alias("_q"), "window"), F.col("qname") == F.col("_q"))
        rows = rows.withColumn("ops", cigar_ops(F.col("cigar"))).withColumn("window", F.substring("window", F.lit(1), genome_span(F.col("ops"))))
        return with_record_errors(rows.select("norm_name", "flag", "seq", "ops", "window")).select("norm_name", F.length("seq").alias("n"), "errors")

    a, b = errors(original, windows[0]), errors(corrected, windows[1])
    both = a.join(b.select(F.col("norm_name").alias("_b"), F.col("errors").alias("left_over")), F.col("norm_name") == F.col("_b"))
    spread = lambda c: both.select("norm_name", F.explode(c).alias("e")).select("norm_name", "e.pos", "e.type")
    matched = paired_errors(spread("errors"), spread("left_over"), ["norm_name"])
    return switch_types(error_confusion(matched, both.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")), ["norm_name"]))


def kmer_truth(read_kmers: DataFrame, genome_counts: DataFrame) -> DataFrame:
    """Rows (k, kmer) with ``truth`` from the k-mer's count in the genome."""
    key = genome_counts.select(F.col("k").alias("_k"), F.col("kmer").alias("_g"), F.col("cnt").alias("_n"))
    rows = read_kmers.withColumn("_c", canonical(F.col("kmer"))).join(key, (F.col("k") == F.col("_k")) & (F.col("_c") == F.col("_g")), "left")
    return rows.withColumn("truth", genome_class(F.col("_n"))).drop("_k", "_g", "_n", "_c")


def truth_of_classes(classes: DataFrame, genome_counts: DataFrame) -> DataFrame:
    """Rows (k, kmer: smaller of both strands) with ``truth``."""
    genome = genome_counts.select("k", "kmer", F.col("cnt").alias("_n"))
    # a table of k-mers is not for broadcasting, however small it looks
    return classes.join(genome.hint("merge"), ["k", "kmer"], "left").withColumn("truth", genome_class(F.col("_n"))).drop("_n")


def reads_all_correct(rows: DataFrame, read_id: str = "rid") -> DataFrame:
    """reads, all_correct: how many reads there are, and of how many every k-mer is classified right."""
    per_read = rows.groupBy(read_id).agg(F.bool_and(F.col("truth") == F.col("predicted")).alias("right"))
    return per_read.agg(F.count("*").alias("reads"), F.count_if("right").alias("all_correct"))


def kmer_variants(read_kmers: DataFrame, reads: DataFrame, biases: DataFrame, expected: DataFrame, genome_counts: DataFrame, read_id: str = "rid", seq: str = "seq") -> DataFrame:
    """variant, truth, predicted, n for four predictors: each k-mer's own bias, the read's mean bias (to 12 digits, so that sums in any order agree), the bias at the read's G/C share, the read's median count."""
    rows = kmer_bias(kmer_truth(read_kmers, genome_counts), biases)
    at_gc = gc_biases(reads.select(F.col(read_id).alias("_g"), seq), biases, expected, seq).select("_g", "gc_bias")
    return variant_counts(rows.join(at_gc, F.col(read_id) == F.col("_g")).drop("_g"), expected, read_id)


def gc_biases(reads: DataFrame, biases: DataFrame, expected: DataFrame, seq: str = "seq") -> DataFrame:
    """Reads that have a G/C share with gc_bias, the bias there; ``expected`` has one row."""
    shares = reads.withColumn("gc", gc_content(F.col(seq))).where("gc is not null").crossJoin(F.broadcast(expected.select("k")))  # one row of k
    return bias_at(shares, biases).withColumnRenamed("bias", "gc_bias").drop("gc", "k")


def variant_counts(rows: DataFrame, expected: DataFrame, read_id: str = "rid") -> DataFrame:
    """What ``kmer_variants`` counts, of rows (read_id, k, cnt, truth, bias, gc_bias)."""
    rows = rows.join(F.broadcast(expected.select(F.col("k").alias("_k"), "expectation")), F.col("k") == F.col("_k")).drop("_k")
    by_read = Window.partitionBy(read_id)
    rows = classify_by_read_median(rows.withColumn("mean_bias", F.round(F.avg("bias").over(by_read), 12)), read_id)
    of = lambda bias: kmer_class(F.col("cnt"), F.col("expectation"), F.col(bias))
    predicted = {"kmer": of("bias"), "read_mean": of("mean_bias"), "read_gc": of("gc_bias"), "read_median": F.col("class")}
    counted = rows.groupBy("truth", *[c.alias(f"_{n}") for n, c in predicted.items()]).agg(F.count("*").alias("_n"))
    variants = F.array(*[F.struct(F.lit(n).alias("variant"), F.col(f"_{n}").alias("predicted")) for n in predicted])
    return counted.select("truth", "_n", F.explode(variants).alias("v")).groupBy("v.variant", "truth", "v.predicted").agg(F.sum("_n").alias("n"))


def predict_kmers(read_kmers: DataFrame, classes: DataFrame) -> DataFrame:
    """Rows (k, kmer) with ``predicted`` from a class table."""
    return look_up(read_kmers, classes.select("k", "kmer", "cnt", F.col("class").alias("predicted"))).withColumn("predicted", F.coalesce("predicted", F.lit(0)))


