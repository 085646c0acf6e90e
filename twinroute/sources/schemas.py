"""Schemas of the relations, coordinates 0-based and half-open."""

from __future__ import annotations

from pyspark.sql import types as T


def _schema(text: str) -> T.StructType:
    kinds = {"string": T.StringType(), "long": T.LongType(), "int": T.IntegerType(), "double": T.DoubleType(), "boolean": T.BooleanType()}
    return T.StructType([T.StructField(n, kinds[k]) for n, k in (x.split() for x in text.split(", "))])


#: Raw records of either route; ``operators.scan`` makes the operators' rows of them.
ALIGNMENT = _schema("sample string, read_id string, flag int, ref string, pos long, epos long, strand string, qlen int, mapq int, nh int, score int, cigar string")
GTF_LINE = _schema("seqname string, source string, feature string, start long, end long, score string, strand string, phase string, attributes string")
SAM_LINE = _schema("qname string, flag int, rname string, pos long, mapq int, cigar string, rnext string, pnext long, tlen long, seq string, qual string")
BED_LINE = _schema("name string, start long, end long, label string, score string, strand string")
MANIFEST = _schema("schema_version string, sample_id string, cell_line string, ribo_gsm string, rna_gsm string, ribo_gse string")
QC_MASTER = _schema(
    "sample string, read_length int, n_reads long, pct_reads double, in_phase1 boolean, psite_offset int, frame0_pct double, frame1_pct double, frame2_pct double, periodic boolean, n_first10 long, n_first10_frame0 long, n_first10_frame1 long, n_first10_frame2 long"
)
COUNTS = _schema("transcript_id string, sample string, assay string, route string, n long")
