"""Sinks: CSV, FASTA, and wide tables of allele frequencies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_csv(df: DataFrame, path: str, mode: str = "error") -> None:
    """Quoted where needed, with a header in each part and no byte-order mark; Spark writes the parts side by side."""
    df.write.mode(mode).option("header", True).option("escape", '"').option("lineSep", "\r\n").csv(path)


def fasta_lines(sequences: DataFrame, width: int = 60) -> DataFrame:
    """value: one record per row of ind, pop, seq, its body in lines of ``width`` letters."""
    body = F.regexp_replace("seq", f"(.{{{width}}})(?=.)", "$1\n")
    return sequences.select(F.concat(F.lit(">"), F.concat_ws(" | ", "ind", "pop"), F.lit("\n"), body).alias("value"))


def write_fasta(sequences: DataFrame, path: str, mode: str = "error") -> None:
    fasta_lines(sequences).write.mode(mode).text(path)


def frequency_table(freqs: DataFrame, pops: list) -> DataFrame:
    """locus, allele and a column per population (absent alleles 0) of pop, locus, allele, p."""
    return freqs.groupBy("locus", "allele").pivot("pop", pops).agg(F.round(F.first("p"), 5)).na.fill(0.0)
