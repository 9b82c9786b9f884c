"""Each job as a query: run twice into one folder, the output as it stands after the second run."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from jobs import line_stats, restore_reads
from seqframe.plans.fixtures import with_views
from seqframe.plans.scratch import new_folder


def job1_line_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "job1")
    for _ in range(2):
        out = line_stats.run(spark, f"{sf_dir}/documents.parquet", f"{folder}/stats", f"{folder}/checkpoint")
    return out


def job2_restore_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder, settings = new_folder(spark, "job2"), restore_reads.configured()
    for _ in range(2):
        out = restore_reads.run(spark, sf_dir, folder, **settings)
    return out


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"job1_line_stats": job1_line_stats, "job2_restore_reads": job2_restore_reads}

ORACLE_SQL: dict[str, str] = {
    "job1_line_stats": """
        with lines as (select source, lang, unnest(string_split(text, chr(10))) as value from documents),
        reads as (select source, lang, rtrim(value, ' ') as seq from lines where not starts_with(value, '@') and trim(value, ' ') <> ''),
        counted as (select *, length(seq) as l, length(seq) - length(replace(seq, 'N', '')) as n from reads)
        select source, lang, count(*) as seqs_n, cast(min(l) as int) as min_l, cast(max(l) as int) as max_l, count(*) filter (where n > 0) as reads_n_with_n,
        cast(sum(l) as bigint) as bases_all, cast(sum(n) as bigint) as bases_n, cast(coalesce(min(n) filter (where n > 0), 0) as int) as min_n, cast(max(n) as int) as max_n
        from counted group by source, lang
    """,
    "job2_restore_reads": with_views(
        """with s as (select *, row_number() over (partition by seq order by sid desc) as k from reads),
        b as (select *, row_number() over (partition by seq order by rid) as k from bare_reads)
        select b.rid, s.name, s.comment, b.seq, s.qual, case when s.qual is null then concat('>', coalesce(s.name, ''), chr(10), b.seq)
        else concat('@', s.name, ' ', s.comment, chr(10), b.seq, chr(10), '+', chr(10), s.qual) end as record, cast(floor(b.rid / 1000000) as bigint) as part
        from b left join s on b.seq = s.seq and b.k = s.k""",
        "reads",
        "bare_reads",
    ),
}
