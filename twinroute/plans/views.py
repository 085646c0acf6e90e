"""Views that give the test tables the shape of alignments, exons and counts.

The same text runs in Spark SQL (tables in braces) and in the oracle engine (plain names).
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

from twinroute.operators.unions import plain_unions, plain_windows

VIEWS = {
    "aln_g": (
        ("lineitem",),
        """select cast(l_orderkey as bigint) read_id, concat('s',cast(l_orderkey % 6 as string)) sample, concat('chr',cast(l_suppkey % 5 as string)) chrom,
 cast(floor(l_extendedprice) as bigint) pos, cast(floor(l_extendedprice) as bigint)+20+cast(floor(l_quantity) as bigint)%21 epos, 20+cast(floor(l_quantity) as bigint)%21 qlen,
 case when l_linestatus='O' then '+' else '-' end strand, -cast(round(l_tax*100) as bigint) score,
 count(*) over (partition by l_orderkey) nh,
 case when row_number() over (partition by l_orderkey order by l_linenumber,l_partkey,l_suppkey,l_extendedprice,l_quantity,l_tax,l_linestatus)=1 then false else true end is_secondary from {lineitem}""",
    ),
    "aln_t": (
        ("orders",),
        """select cast(o_orderkey as bigint) read_id, concat('s',cast(o_orderkey % 6 as string)) sample, cast(o_custkey % 500 as bigint) transcript_id, cast(floor(o_totalprice) as bigint) % 120 pos, cast(20 + o_orderkey % 21 as bigint) qlen,
 case when cast(floor(o_totalprice) as bigint) % 10 < 8 then 42 else cast(floor(o_totalprice) as bigint) % 42 end mapq from {orders} where o_orderkey % 11 <> 0""",
    ),
    "exons": (
        ("part",),
        """select gene_id, transcript_id, concat('chr',cast(gene_id % 5 as string)) chrom, cast(base + off as bigint) g_start, cast(base + off + 10 + p_size as bigint) g_end,
 case when cast(floor(gene_id/10) as bigint) % 2 = 0 then '+' else '-' end strand,
 case when gene_id % 4 = 0 then 'processed_pseudogene' when gene_id % 4 = 1 then 'lncRNA' else 'protein_coding' end gene_type
from (select cast(floor(p_partkey/8) as bigint) gene_id, cast(floor(p_partkey/4) as bigint) transcript_id, p_size,
 (cast(floor(p_partkey/8) as bigint)*400) % 100000 base, case when p_partkey % 8 = 7 then 1990 else (p_partkey % 8)*50 end off from {part}) x""",
    ),
    "counts_long": (
        ("lineitem",),
        """select l_partkey % 200 transcript_id, concat('s',cast(l_orderkey % 6 as string)) sample, case when l_linestatus='O' then 'ribo' else 'rna' end assay, case when l_returnflag='A' then 'genome' else 'txome' end route, count(*) n from {lineitem} group by 1,2,3,4""",
    ),
}


#: The column by which the reads of a view's table are dealt.
READS = {"aln_g": "l_orderkey"}


def view(spark: SparkSession, sf_dir: str, name: str, by_read: bool = False) -> DataFrame:
    """A view.  ``by_read``: its table is dealt by read before anything is worked out of it.

    Windows by read take what they are given along with what is worked out of it; dealt first, the table's own columns are all
    that is shuffled, and the view's reads lie together for what follows.  Only for queries that need the windows.
    """
    plain_unions(spark)
    plain_windows(spark)
    tables, text = VIEWS[name]
    read = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables}
    return spark.sql(text, **({t: df.repartition(READS[name]) for t, df in read.items()} if by_read and name in READS else read))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    plain_unions(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame) -> DataFrame:
    """df written once to the folder in spark.checkpoint.dir and read from there; without such a folder, kept on the executors' disks."""
    if df.sparkSession.sparkContext.getCheckpointDir() is None:
        return df.persist(StorageLevel.DISK_ONLY)
    return df.checkpoint()


def cte(*names: str) -> str:
    """The views as common table expressions of the oracle engine."""
    parts = [f"{n} AS MATERIALIZED ({VIEWS[n][1].format(**{t: t for t in VIEWS[n][0]})})" for n in names]
    return "WITH RECURSIVE " + ",\n".join(parts)
