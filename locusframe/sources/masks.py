"""Region masks by name: `builtin:<name>` beside plain BED paths."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from locusframe.sources.text import read_bed

#: Core regions of P. falciparum 3D7 by chromosome number, 0-based half-open (MalariaGEN regions of 2013, core ends of 8, 11 and 13 moved out).
PF3D7_CORE = {
    1: [(92900, 457931), (460311, 575900)],
    2: [(105800, 447300), (450450, 862500)],
    3: [(70630, 597816), (600275, 1003060)],
    4: [(91420, 545800), (614900, 642003), (644529, 935030), (983080, 1143990)],
    5: [(37900, 455740), (457252, 1321390)],
    6: [(72350, 478652), (480971, 723117), (742800, 1294830)],
    7: [(77100, 508360), (605650, 809245), (811716, 1381600)],
    8: [(73560, 299079), (301403, 427430), (467340, 1387982)],
    9: [(79100, 1242137), (1244483, 1473560)],
    10: [(68970, 1571815)],
    11: [(110000, 831968), (834245, 2003328)],
    12: [(60300, 766654), (780450, 1282773), (1285067, 1688600), (1745530, 2163700)],
    13: [(74413, 1168127), (1170425, 2844785)],
    14: [(35774, 1071523), (1075089, 3255710)],
}
#: Descriptions of multigene families and other genes that reads map to wrongly.
PARALOG_PATTERNS = (
    "erythrocyte membrane protein", r"\bPfEMP1\b", r"\brifin\b", r"\bRIF\b", r"\bstevor\b", r"\bsurfin\b", "surface-associated interspersed", "exported protein", r"\bPHIST\b", "heat shock protein",
    "acyl-CoA synthetase", "cytoadherence linked asexual", r"\bpseudogene\b",
)
BUILTIN = ("pf3d7_core_regions", "pf3d7_paralog_genes", "pf3d7_tandem_repeats")


def core_regions(spark: SparkSession) -> DataFrame:
    rows = [(f"Pf3D7_{c:02d}_v3", a, b) for c, spans in PF3D7_CORE.items() for a, b in spans]
    return spark.createDataFrame(rows, "chrom string, start long, end long")


def genes_of_gff(spark: SparkSession, path: str) -> DataFrame:
    """chrom, start, end (0-based half-open), gene_id and description of the genes and pseudogenes of a GFF3 file."""
    f = F.split("value", "\t")
    rows = spark.read.text(path).where(~F.col("value").startswith("#")).select(f.alias("f")).where(F.get("f", 2).isin("gene", "protein_coding_gene", "ncRNA_gene", "pseudogene"))
    notes = F.get("f", 8)
    plain = lambda key: F.url_decode(F.replace(F.regexp_extract(notes, f"(?:^|;){key}=([^;]*)", 1), F.lit("+"), F.lit("%2B")))
    kind = F.when(F.get("f", 2) == "pseudogene", " pseudogene").otherwise("")
    return rows.select(F.get("f", 0).alias("chrom"), (F.get("f", 3).cast("long") - 1).alias("start"), F.get("f", 4).cast("long").alias("end"), plain("ID").alias("gene_id"), F.concat(plain("description"), kind).alias("description"))


def paralog_genes(spark: SparkSession, gff: str) -> DataFrame:
    """chrom, start, end, name of the genes whose description matches a pattern, letter case aside."""
    found = genes_of_gff(spark, gff).where(F.col("description").rlike("(?i)" + "|".join(PARALOG_PATTERNS)))
    return found.select("chrom", "start", "end", F.concat_ws("|", "gene_id", "description").alias("name"))


def resolve_bed(spark: SparkSession, value: str | None, gff: str | None = None) -> DataFrame | None:
    """The merged regions of a BED path or of a builtin mask.

    The core regions come with the package. Paralogs are built from an annotation (gff). There are no tandem
    repeats to build from, so that name, like an unknown one, is an error that says what to pass."""
    if value is None or not value.startswith("builtin:"):
        return read_bed(spark, value) if value else None
    name = value.removeprefix("builtin:")
    if name == "pf3d7_core_regions":
        return core_regions(spark)
    if name == "pf3d7_paralog_genes" and gff:
        return paralog_genes(spark, gff).select("chrom", "start", "end")
    if name == "pf3d7_paralog_genes":
        raise ValueError("builtin:pf3d7_paralog_genes is built from an annotation; name its GFF3 file")
    if name == "pf3d7_tandem_repeats":
        raise ValueError("builtin:pf3d7_tandem_repeats does not come with the package; pass a BED path")
    raise ValueError(f"unknown builtin mask {name!r}; there are {', '.join(BUILTIN)}")
