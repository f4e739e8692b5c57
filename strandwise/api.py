"""The library's front: parameters, data sets and the operations on them."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandwise.functions.enums import ALGORITHMS, COUNTING, GENOME_TYPES
from strandwise.operators import evaluate, metrics, profile
from strandwise.operators.classify import class_table, classify
from strandwise.operators.correct import correct_reads
from strandwise.operators.coverage import CoverageModel
from strandwise.operators.kmers import count_both_strands, count_naive, read_lengths
from strandwise.plans.storage import cut


@dataclass
class Parameters:
    """Defaults of library use; the command line starts from k = 15."""

    min_k: int = 31
    algorithm: str = "ADAPTIVE_KMER"
    counting: str = "FM_INDEX"
    indels: bool = True

    def __post_init__(self) -> None:
        if self.algorithm not in ALGORITHMS:
            raise ValueError(f"algorithm is one of {ALGORITHMS}")
        if self.counting not in COUNTING:
            raise ValueError(f"counting is one of {COUNTING}")
        if self.min_k < 1:
            raise ValueError("min_k is at least 1")


@dataclass
class Dataset:
    """Reads (rid, name, seq), the genome's size and shape, and the reads' lengths."""

    reads: DataFrame
    genome_size: int
    genome_type: str = "LINEAR"
    lengths: DataFrame = field(init=False)

    def __post_init__(self) -> None:
        if self.genome_type not in GENOME_TYPES:
            raise ValueError(f"genome_type is one of {GENOME_TYPES}")
        if self.genome_size <= 0:
            raise ValueError("the genome's size is above 0")
        self.lengths = read_lengths(self.reads)


@dataclass
class ReferenceDataset(Dataset):
    """A data set with its genome: overlapping stretches (idx, seq) whose k-mer windows are the genome's."""

    genome: DataFrame | None = None


class Toolkit:
    """Classify k-mers, correct reads and evaluate both for one data set."""

    def __init__(self, dataset: Dataset, parameters: Parameters | None = None) -> None:
        self.dataset, self.parameters = dataset, parameters or Parameters()
        self._models: dict[tuple[int, ...], CoverageModel] = {}

    def model(self, ks: list[int]) -> CoverageModel:
        key = tuple(sorted(set(ks)))
        if key not in self._models:
            d = self.dataset
            self._models[key] = CoverageModel(d.reads, d.genome_size, key, d.genome_type, lengths=d.lengths)
        return self._models[key]

    def count_kmers(self, k: int | None = None) -> DataFrame:
        k = k or self.parameters.min_k
        if self.parameters.counting == "NAIVE_BUFFERED":
            return count_naive(self.dataset.reads, k)
        return count_both_strands(self.dataset.reads, k)

    def classes(self, k: int | None = None) -> DataFrame:
        return class_table(self.model([k or self.parameters.min_k]))

    def classify_kmers(self, kmers: DataFrame) -> DataFrame:
        """``kmers`` (kmer) of any lengths with cnt and class."""
        rows = kmers.withColumn("k", F.length("kmer"))
        sizes = [r[0] for r in rows.select("k").distinct().collect()]  # one row for each length
        return classify(rows, self.model(sizes))

    def coverage_biases(self, ks: list[int] | None = None) -> DataFrame:
        k = self.parameters.min_k
        return self.model(ks or [k, k + 2, k + 4, k + 6]).report()

    def correct(self) -> DataFrame:
        """rid, seq of all reads after correction."""
        p = self.parameters
        return correct_reads(self.dataset.reads, self.model, p.algorithm, p.min_k, folder=cut, indels=p.indels)

    def evaluate_corrections(self, corrected: DataFrame, alignments: DataFrame, windows: DataFrame) -> DataFrame:
        return metrics.report(evaluate.evaluate_corrections(corrected, alignments, windows))

    def kmer_confusion(self, genome: DataFrame, k: int | None = None) -> DataFrame:
        """Confusion of the classes of all k-mers of the reads against the genome (idx, seq)."""
        k = k or self.parameters.min_k
        rows = evaluate.classified_counts(self.classes(k), count_both_strands(genome, k))
        return evaluate.kmer_confusion(rows, weight=F.col("inner"))

    def evaluate_kmers(self, genome: DataFrame, k: int | None = None) -> DataFrame:
        return metrics.report(self.kmer_confusion(genome, k))

    def overall_profile(self, corrections: DataFrame) -> DataFrame:
        return profile.log_profile(profile.overall_counts(corrections, self.dataset.reads))
