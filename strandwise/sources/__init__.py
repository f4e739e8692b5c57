"""Readers and writers of sequencing files."""

from .alignments import read_sam, read_totals, reads_with_alignments
from .bam import read_bam, write_bam
from .reads import read_fasta, read_genome, read_reads, write_reads
from .tables import load_counts_text, plot_points, read_plot_script, store_counts_text, write_plot

__all__ = [
    "load_counts_text",
    "plot_points",
    "read_bam",
    "read_fasta",
    "read_genome",
    "read_plot_script",
    "read_reads",
    "read_sam",
    "read_totals",
    "reads_with_alignments",
    "store_counts_text",
    "write_bam",
    "write_plot",
    "write_reads",
]
