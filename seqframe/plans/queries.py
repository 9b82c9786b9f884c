"""One query for each operator, with SQL that DuckDB runs on the same tables."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyarrow.fs import FileSelector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from seqframe import streaming
from seqframe.functions import sequence, text
from seqframe.operators import align, lookup, reorder, stats
from seqframe.plans import fixtures
from seqframe.plans.fixtures import view, with_views
from seqframe.plans.scratch import new_folder
from seqframe.report import logs, tables
from seqframe.sinks.fastx import listing, rendered, write_fastx
from seqframe.sources import fastx, files, index, lines, sam
from seqframe.sources.files import store_of

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

#: Bases of the source reads and of a chunk in the chunked query (the fixture's reads have 32 bases).
READ_LENGTH, SMALL_CHUNK = 32, 32_000


def query(sql: str | None, *views: str, recursive: bool = False) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = with_views(sql, *views, recursive=recursive) if views else sql
        return f

    return add


def alignment_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The alignments as lines of text, which the parser takes apart again."""
    a = view(spark, sf_dir, "alignments")
    c = [F.col(x).cast("string") for x in ("qname", "flag", "rname", "pos", "mapq")]
    tags = [F.concat(F.lit("NM:i:"), F.col("nm")), F.concat(F.lit("AS:i:"), F.col("as_score"))]
    return a.select("k", F.concat_ws("\t", *c, *[F.lit(x) for x in ("32M", "*", "0", "0")], "seq", F.lit("*"), *tags).alias("value"))


def header_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "sam_sq").select(F.concat_ws("\t", F.lit("@SQ"), F.concat(F.lit("SN:"), F.col("sn")), F.concat(F.lit("LN:"), F.col("ln"))).alias("value"))


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sam.parse_records(alignment_lines(spark, sf_dir), keep=("k",))


def _file(lines: DataFrame, name: str, order: str | None = None, **options: str) -> str:
    """A folder of text files that hold the lines (column `value`)."""
    folder = new_folder(lines.sparkSession, name)
    ordered = lines.orderBy(order) if order else lines
    ordered.select("value").write.options(**options).text(folder)
    return folder


def _misnamed(folder: str) -> str:
    """The folder, whose compressed files have lost the ending that says so."""
    store, inner = store_of(folder)
    for file in store.get_file_info(FileSelector(inner)):
        if file.path.endswith(".gz"):
            store.move(file.path, file.path.removesuffix(".gz"))
    return folder


_TRUTH = """with truth as (
    select mapq, split_part(qname,'_',1) = rname
        and abs(pos - case when (flag & 16) <> 0 then cast(split_part(qname,'_',3) as int) - length(seq) + 1 else cast(split_part(qname,'_',2) as int) end) <= {d} as correct
    from alignments where (flag & 2308) = 0)"""


def _mapq_sql(distance: int) -> str:
    return _TRUTH.format(d=distance) + " select mapq, count(*) as aligned, count(*) filter (where correct) as correct from truth group by mapq"


@query(_mapq_sql(10), "alignments")
def sam_mapq_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.mapq_accuracy(_records(spark, sf_dir))


@query(_mapq_sql(0), "alignments")
def sam_mapq_accuracy_d0(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.mapq_accuracy(_records(spark, sf_dir), 0)


@query(_mapq_sql(3), "alignments")
def sam_mapq_accuracy_d3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.mapq_accuracy(_records(spark, sf_dir), 3)


@query("select count(*) filter (where (flag & 4) <> 0) as unmapped from alignments", "alignments")
def sam_unmapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.unmapped(_records(spark, sf_dir))


@query(
    _TRUTH.format(d=10)
    + """, sums as (select count(*) as mapped, count(*) filter (where correct) as correct, (select count(*) from alignments where (flag & 4) <> 0) as unmapped from truth)
    select mapped, correct, unmapped, (correct * cast(100 as double)) / (mapped + unmapped) as accuracy from sums""",
    "alignments",
)
def sam_accuracy_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.accuracy_total(_records(spark, sf_dir))


@query(
    """select count(*) as alignments, count(*) filter (where (flag & 4) <> 0) as unmapped, count(*) filter (where (flag & 2308) = 0) as primary_n,
    count(*) filter (where (flag & 4) = 0 and (flag & 2048) <> 0) as supplementary, count(*) filter (where (flag & 4) = 0 and (flag & 256) <> 0) as secondary,
    cast(sum(as_score) filter (where (flag & 2308) = 0) as double) / count(*) filter (where (flag & 2308) = 0) as mean_as,
    cast(sum(nm) filter (where (flag & 2308) = 0) as double) / count(*) filter (where (flag & 2308) = 0) as mean_nm from alignments""",
    "alignments",
)
def sam_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.sam_summary(_records(spark, sf_dir))


@query("select qname, flag, rname, pos, mapq, '32M' as cigar, seq, nm, as_score from alignments", "alignments")
def sam_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alignments written as compressed text, with a header, and read as a file."""
    lines = alignment_lines(spark, sf_dir).select("value").unionByName(header_lines(spark, sf_dir))
    records = sam.parse_records(sam.read_sam(spark, _file(lines, "sam", compression="gzip")))
    return records.select("qname", "flag", "rname", "pos", "mapq", "cigar", "seq", F.col("opt.nm").alias("nm"), F.col("opt.as").alias("as_score"))


@query("select k, qname, flag, rname, pos, mapq, '32M' as cigar, '*' as rnext, 0 as pnext, 0 as tlen, seq, '*' as qual, nm, as_score from alignments", "alignments")
def sam_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _records(spark, sf_dir).select("*", F.col("opt.nm").alias("nm"), F.col("opt.as").alias("as_score")).drop("opt")


@query("select " + ", ".join(f"count(*) filter (where (flag & {bit}) <> 0) as {name}" for name, bit in align.flags.BITS.items()) + " from aln_flags", "aln_flags")
def sam_flag_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.flag_census(view(spark, sf_dir, "aln_flags"))


@query("select sn, ln from sam_sq", "sam_sq")
def sam_header_sq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sam.header_sequences(header_lines(spark, sf_dir))


@query("select cast(sum(ln) as bigint) as ref_len from sam_sq", "sam_sq")
def sam_ref_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.reference_length(sam.header_sequences(header_lines(spark, sf_dir)))


@query(
    """with lines as (select n_nationkey as line_no, n_name from nation)
    select '1.' || (select max(line_no) from lines) as vn, 'coordinate' as so, (select n_name from lines order by line_no desc limit 1) as id"""
)
def sam_header_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations = spark.read.parquet(f"{sf_dir}/nation.parquet")
    hd = nations.select(F.col("n_nationkey").alias("line_no"), F.concat(F.lit("@HD\tVN:1."), F.col("n_nationkey"), F.lit("\tSO:coordinate")).alias("value"))
    pg = nations.select(F.col("n_nationkey").alias("line_no"), F.concat(F.lit("@PG\tID:"), F.col("n_name")).alias("value"))
    return sam.header_summary(hd.unionByName(pg)).select("hd.vn", "hd.so", "pg.id")


_STATS = """count(*) as seqs_n, cast(min(length(seq)) as int) as min_l, cast(max(length(seq)) as int) as max_l, count(*) filter (where n > 0) as reads_n_with_n,
    cast(sum(length(seq)) as bigint) as bases_all, cast(sum(n) as bigint) as bases_n, cast(coalesce(min(n) filter (where n > 0), 0) as int) as min_n, cast(max(n) as int) as max_n"""
_N = "length(seq) - length(replace(seq, 'N', ''))"


@query(f"with c as (select seq, {_N} as n from reads) select {_STATS} from c", "reads")
def read_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.read_stats(view(spark, sf_dir, "reads"))


@query(
    f"with c as (select 1 as file_no, seq, {_N} as n from reads union all select 2 as file_no, seq, {_N} as n from mates2) select file_no, {_STATS} from c group by file_no",
    "reads",
    "mates2",
)
def read_stats_paired(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.read_stats_paired(view(spark, sf_dir, "reads"), view(spark, sf_dir, "mates2"))


@query("with t as (select text as seq from documents), c as (select seq, length(seq) - length(replace(seq, 'N', '')) as n from t) select " + _STATS + " from c")
def read_stats_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.read_stats(spark.read.parquet(f"{sf_dir}/documents.parquet"), seq="text")


@query(f"select cast({_N} as int) as n_count, count(*) as reads from reads group by 1", "reads")
def read_n_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.n_profile(view(spark, sf_dir, "reads"))


def _reorder_sql(order: str) -> str:
    return f"""with s as (select *, row_number() over (partition by seq order by {order}) as k from reads),
    b as (select *, row_number() over (partition by seq order by rid) as k from bare_reads)
    select b.rid, s.name, s.comment, b.seq, s.qual from b left join s on b.seq = s.seq and b.k = s.k"""


@query(_reorder_sql("sid desc"), "reads", "bare_reads")
def reorder_by_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reorder.reorder_by_sequence(view(spark, sf_dir, "bare_reads"), view(spark, sf_dir, "reads"))


@query(_reorder_sql("sid"), "reads", "bare_reads")
def reorder_by_sequence_fifo(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reorder.reorder_by_sequence(view(spark, sf_dir, "bare_reads"), view(spark, sf_dir, "reads"), tie="fifo")


@query(_reorder_sql(f"cast(floor(sid / {SMALL_CHUNK // READ_LENGTH}) as bigint), sid desc"), "reads", "bare_reads")
def reorder_by_sequence_chunked(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunk = reorder.constant_length_chunk(F.col("sid"), READ_LENGTH, SMALL_CHUNK)
    return reorder.reorder_by_sequence(view(spark, sf_dir, "bare_reads"), view(spark, sf_dir, "reads"), chunk=chunk)


@query(
    f"""with odd as (select sid, name, comment, qual, substring(seq, 1, cast(sid % 7 + 8 as int)) as seq from reads),
    sums as (select *, cast(sum(length(seq)) over (order by sid) as bigint) as c from odd),
    ends(c) as (select cast(0 as bigint) union all select n.c from ends e, lateral (select min(s.c) as c from sums s where s.c >= e.c + {SMALL_CHUNK}) n where n.c is not null),
    s as (select sums.*, row_number() over (partition by seq order by (select count(*) from ends where ends.c < sums.c), sid desc) as k from sums),
    x as (select rid, substring(seq, 1, cast(rid % 5 + 8 as int)) as seq from bare_reads),
    b as (select *, row_number() over (partition by seq order by rid) as k from x)
    select b.rid, s.name, s.comment, b.seq, s.qual from b left join s on b.seq = s.seq and b.k = s.k""",
    "reads",
    "bare_reads",
    recursive=True,
)
def reorder_by_sequence_odd_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source reads of several lengths in chunks of a number of bases: a running total that starts anew."""
    reads = view(spark, sf_dir, "reads").withColumn("seq", F.substring("seq", F.lit(1), (F.col("sid") % 7 + 8).cast("int")))
    bare = view(spark, sf_dir, "bare_reads").withColumn("seq", F.substring("seq", F.lit(1), (F.col("rid") % 5 + 8).cast("int")))
    chunked = reorder.with_chunks(reads, reorder.chunk_starts(reads, SMALL_CHUNK))
    return reorder.reorder_by_sequence(bare, chunked, chunk=F.col("chunk"), strict_alphabet=True)


@query(
    "with t as (select substring(seq, 1, cast(sid % 7 + 8 as int)) as seq, sid from reads), sums as (select sid, cast(sum(length(seq)) over (order by sid) as bigint) as c, cast(length(seq) as bigint) as l from t), "
    f"ends(c) as (select cast(0 as bigint) union all select n.c from ends e, lateral (select min(s.c) as c from sums s where s.c >= e.c + {SMALL_CHUNK // 100}) n where n.c is not null) "
    "select chunk, count(*) as reads, cast(sum(l) as bigint) as bases, min(sid) as first from (select *, (select count(*) from ends where ends.c < sums.c) - 1 as chunk from sums) group by chunk",
    "reads",
    recursive=True,
)
def read_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Many small chunks of reads of several lengths: the reads, bases and first ordinal of each."""
    reads = view(spark, sf_dir, "reads").withColumn("seq", F.substring("seq", F.lit(1), (F.col("sid") % 7 + 8).cast("int")))
    chunked = reorder.with_chunks(reads, reorder.chunk_starts(reads, SMALL_CHUNK // 100))
    return chunked.groupBy("chunk").agg(F.count("*").alias("reads"), F.sum(F.length("seq").cast("bigint")).alias("bases"), F.min("sid").alias("first"))


@query("select count(*) filter (where o_orderkey % 11 = 0) as bare_empty, count(*) filter (where o_orderkey % 13 = 0) as source_empty from orders")
def reorder_empty_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    bare = view(spark, sf_dir, "bare_reads").withColumn("seq", F.when(F.col("rid") % 11 == 0, "").otherwise(F.col("seq")))
    source = view(spark, sf_dir, "reads").withColumn("seq", F.when(F.col("sid") % 13 != 0, F.col("seq")))
    return reorder.empty_reads(bare, source)


@query(
    """with b as (select seq, count(*) as nb from bare_reads group by seq), s as (select seq, count(*) as ns from reads group by seq),
    both_ as (select length(coalesce(b.seq, s.seq)) as l, coalesce(nb, 0) as nb, coalesce(ns, 0) as ns from b full join s on b.seq = s.seq)
    select cast(sum(nb) as bigint) as bare_reads, cast(sum(ns) as bigint) as source_reads, cast(sum(least(nb, ns)) as bigint) as matched,
    cast(sum(nb - least(nb, ns)) as bigint) as unmatched, cast(sum(l * nb) as bigint) as bare_bases, cast(sum(l * ns) as bigint) as source_bases,
    cast(sum(greatest(ns - 1, 0)) as bigint) as source_duplicates from both_""",
    "reads",
    "bare_reads",
)
def reorder_match_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reorder.match_report(view(spark, sf_dir, "bare_reads"), view(spark, sf_dir, "reads"))


@query("select count(*) as reads, count(*) - count(distinct seq) as duplicates from reads", "reads")
def read_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.duplicates(view(spark, sf_dir, "reads"))


_MATES = """with a as (select rid, left(name, length(name) - 2) as n, row_number() over (partition by left(name, length(name) - 2) order by rid) as k from mates1),
    b as (select *, left(name, length(name) - 2) as n, row_number() over (partition by left(name, length(name) - 2) order by rid) as k from mates2 {where})"""


@query(_MATES.format(where="") + " select a.rid, concat(a.n, '/2') as name, b.seq from a join b on a.n = b.n and a.k = b.k", "mates1", "mates2")
def reorder_mates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reorder.reorder_mates(view(spark, sf_dir, "mates1"), view(spark, sf_dir, "mates2"))


@query(_MATES.format(where="where rid % 50 <> 0") + " select a.rid, a.n as name from a left join b on a.n = b.n and a.k = b.k where b.rid is null", "mates1", "mates2")
def reorder_mates_unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reorder.mates_missing(view(spark, sf_dir, "mates1"), view(spark, sf_dir, "mates2").filter("rid % 50 <> 0"))


@query(
    """with h as (select list_reduce(list_prepend(cast(0 as hugeint), list_transform(string_split(name, ''), lambda c: cast(ascii(c) as hugeint))), lambda a, c: (a * 1313 + c) % 18446744073709551616) as h from mates1)
    select count(*) as names, count(distinct h) as hashes, cast(count(*) - count(distinct h) as double) / count(*) as collision_rate from h""",
    "mates1",
)
def name_hash_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reorder.hash_collisions(view(spark, sf_dir, "mates1"))


@query("select rec_no, name, '' as comment from contigs", "contigs")
def contig_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.contig_list(view(spark, sf_dir, "contigs"))


@query("select concat('>', name, chr(10), seq) as value from contigs where rec_no = 7", "contigs")
def contig_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = view(spark, sf_dir, "contigs").withColumn("qual", F.lit(None).cast("string"))
    return lookup.nth_record(records, 7).select(rendered().alias("value"))


_VIEW = """with r as (select r_regionkey, r_name, n_name as name, cast(n_nationkey * 13 + 1 as int) as start, cast(r_regionkey * 40 + 5 as int) as length from region join nation on n_regionkey = r_regionkey)
    select c.name, '' as comment, cast(length(c.seq) as int) as l_seq, start, r.length, case when start - 1 + r.length <= length(c.seq) then substring(c.seq, start, r.length) end as bases,
    start - 1 + r.length <= length(c.seq) as in_bounds from r join contigs c on c.name = r.name"""


def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    nations = spark.read.parquet(f"{sf_dir}/nation.parquet")
    return nations.select(F.col("n_name").alias("name"), (F.col("n_nationkey") * 13 + 1).cast("int").alias("start"), (F.col("n_regionkey") * 40 + 5).cast("int").alias("length"))


@query(_VIEW, "contigs")
def sequence_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.sequence_view(view(spark, sf_dir, "contigs"), _requests(spark, sf_dir))


@query(_VIEW, "contigs")
def sequence_view_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from FASTA files of lines of 60 bases, by an index and byte ranges."""
    wrapped = F.regexp_replace("seq", "(.{60})(?=.)", "$1\n")
    folder = _file(view(spark, sf_dir, "contigs").select(F.concat(F.lit(">"), "name", F.lit("\n"), wrapped).alias("value")), "fasta")
    return index.fetch(spark, index.write_index(spark, new_folder(spark, "index"), folder), _requests(spark, sf_dir))


@query(
    f"""with c as (select 'c' || (o_custkey % 50) as name, string_agg({fixtures.bases("cast(o_orderkey as string)")}, '' order by o_orderkey) as seq from orders group by 1),
    r as (select distinct 'c' || (o_custkey % 50) as name, cast(o_orderkey % 3000 + 1 as int) as start, cast(o_orderkey % 97 as int) as length from orders)
    select c.name, '' as comment, cast(length(c.seq) as int) as l_seq, start, r.length, case when start - 1 + r.length <= length(c.seq) then substring(c.seq, start, r.length) end as bases,
    start - 1 + r.length <= length(c.seq) as in_bounds from r join c on c.name = r.name"""
)
def sequence_view_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A range of bases for every order, from 50 long records."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    part = F.struct("o_orderkey", F.expr(fixtures.bases("cast(o_orderkey as string)")).alias("s"))
    contigs = orders.groupBy(F.concat(F.lit("c"), F.col("o_custkey") % 50).alias("name")).agg(F.array_join(F.array_sort(F.collect_list(part))["s"], "").alias("seq"))
    wrapped = F.regexp_replace("seq", "(.{60})(?=.)", "$1\n")
    folder = _file(contigs.select(F.concat(F.lit(">"), "name", F.lit("\n"), wrapped).alias("value")), "fasta")
    asked = orders.select(F.concat(F.lit("c"), F.col("o_custkey") % 50).alias("name"), (F.col("o_orderkey") % 3000 + 1).cast("int").alias("start"), (F.col("o_orderkey") % 97).cast("int").alias("length"))
    return index.fetch(spark, index.write_index(spark, new_folder(spark, "index"), folder), asked.distinct())


@query("with r as (select name from reads union all select '/1' union all select 'a/12' union all select 'b/1/2') select name, case when length(name) > 2 and regexp_matches(name, '/[0-9]$') then left(name, length(name) - 2) else name end as trimmed from r", "reads")
def trim_mate_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = view(spark, sf_dir, "reads").select("name").unionByName(spark.createDataFrame([("/1",), ("a/12",), ("b/1/2",)], "name string"))
    return names.select("name", sequence.trim_mate_suffix(F.col("name")).alias("trimmed"))


@query(
    """with b as (select substring(seq, cast(sid % 32 + 1 as int), 1) as base, sid from reads), c as (select sid, case when sid % 3 = 0 then lower(base) when sid % 7 = 0 then '-' else base end as base from b)
    select sid, base, case when base in ('A','C','G','N','T') then cast(instr('ACGNT', base) - 1 as int) end as strict_code,
    cast(case upper(base) when 'A' then 0 when 'C' then 1 when 'G' then 2 when 'T' then 3 when '-' then 5 else 4 end as int) as lenient_code from c""",
    "reads",
)
def base_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = F.substring("seq", (F.col("sid") % 32 + 1).cast("int"), F.lit(1))
    base = F.when(F.col("sid") % 3 == 0, F.lower(base)).when(F.col("sid") % 7 == 0, "-").otherwise(base)
    return view(spark, sf_dir, "reads").select("sid", base.alias("base")).select("*", sequence.base_code(F.col("base")).alias("strict_code"), sequence.lenient_code(F.col("base")).alias("lenient_code"))


@query("select sid, name, comment, seq, case when sid % 5 <> 0 then qual end as qual from reads", "reads")
def fastx_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records written as text and read back by the data source; part files in name order give the ordinals' order."""
    reads = view(spark, sf_dir, "reads").withColumn("qual", F.when(F.col("sid") % 5 != 0, F.col("qual")))
    folder = new_folder(spark, "fastx")
    reads.withColumn("comment", F.concat_ws(" ", F.col("sid").cast("string"), "comment")).select(rendered().alias("value")).write.option("compression", "gzip").text(folder)
    back = fastx.read_fastx(spark, folder)
    at = F.instr("comment", " ")
    return back.select(F.substring_index("comment", " ", 1).cast("bigint").alias("sid"), "name", F.substring("comment", at + 1, F.length("comment")).alias("comment"), "seq", "qual")


_BACK = "select sid, name, comment, seq, case when sid % 5 <> 0 then qual end as qual from reads"


def _with_sid(reads: DataFrame) -> DataFrame:
    return reads.withColumn("qual", F.when(F.col("sid") % 5 != 0, F.col("qual"))).withColumn("comment", F.concat_ws(" ", F.col("sid").cast("string"), "comment"))


def _without_sid(records: DataFrame) -> DataFrame:
    at = F.instr("comment", " ")
    return records.select(F.substring_index("comment", " ", 1).cast("bigint").alias("sid"), "name", F.substring("comment", at + 1, F.length("comment")).alias("comment"), "seq", "qual")


@query(_BACK, "reads")
def fastx_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records written by the sink in gzip blocks, in order, and read back in pieces of compressed files."""
    folder = new_folder(spark, "sink")
    fastx.register(spark)
    reads = _with_sid(view(spark, sf_dir, "reads")).orderBy("sid").select("name", "comment", "seq", "qual")
    reads.write.format("fastx").mode("overwrite").option("compression", "blocks").save(folder)
    return _without_sid(fastx.read_fastx(spark, folder, split_bytes=1 << 18))


@query(_BACK, "reads")
def fastx_many_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of several lines each, qualities that begin with any character among them, from plain files in small pieces."""
    reads = _with_sid(view(spark, sf_dir, "reads"))
    seq, qual = F.regexp_replace("seq", "(.{12})(?=.)", "$1\n"), F.regexp_replace("qual", "(.{9})(?=.)", "$1\n")
    folder = _file(reads.select("name", "comment", seq.alias("seq"), qual.alias("qual")).select(rendered().alias("value")), "lines")
    return _without_sid(fastx.read_fastx(spark, folder, split_bytes=1 << 18))


_SEC = "cast(o_orderkey * 7 as bigint)"


@query(
    f"select o_orderkey, printf('%02d:%02d:%02d', {_SEC} // 3600, ({_SEC} % 3600) // 60, {_SEC} % 60) as clock, "
    "printf('%d:%02d:%02d', s // 3600, (s % 3600) // 60, s % 60) as clock_up from (select *, cast(ceil(o_orderkey / 4.0) as bigint) as s from orders)"
)
def fmt_duration(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return orders.select("o_orderkey", text.clock(F.col("o_orderkey") * 7).alias("clock"), text.clock_ceil(F.col("o_orderkey") / F.lit(4.0)).alias("clock_up"))


@query("select o_orderkey, format('{:,}', o_orderkey * 12345 - 1000000) as thousands from orders")
def fmt_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return orders.select("o_orderkey", text.thousands(F.col("o_orderkey") * 12345 - 1_000_000).alias("thousands"))


@query(
    """with k as (select o_orderkey, o_orderkey * 10313 as kb from orders)
    select o_orderkey, case when kb = 0 then 'None' when kb > 1048576 then concat(cast(cast(ceil(kb / 1024.0 / 1024.0) as bigint) as string), 'G') when kb > 1024 then concat(cast(cast(ceil(kb / 1024.0) as bigint) as string), 'M') else '<1M' end as short,
    case when kb < 1024 then concat(cast(kb as string), ' KB') when kb < 1048576 then concat(cast(kb // 1024 as string), ' MB') else concat(printf('%.1f', kb / cast(1048576 as double)), ' GB') end as long_ from k"""
)
def fmt_ram(spark: SparkSession, sf_dir: str) -> DataFrame:
    kb = F.col("o_orderkey") * 10313
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", text.memory_short(kb).alias("short"), text.memory_text(kb).alias("long_"))


@query("select o_orderkey, printf('%.2f', v) as two, printf('%.1f', v) as one from (select o_orderkey, (o_orderkey - 5000) / cast(8 as double) + o_orderkey % 1000 * cast('0.005' as double) as v from orders)")
def fmt_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = (F.col("o_orderkey") - 5000) / F.lit(8.0) + F.col("o_orderkey") % 1000 * F.lit(0.005)
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", text.fixed(v, 2).alias("two"), text.fixed(v, 1).alias("one"))


@query("select o_orderkey, cast(o_orderkey % 100 * 3600 + o_orderkey % 60 * 60 + o_orderkey % 59 as double) as seconds from orders")
def parse_duration(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    clock = F.concat_ws(":", k % 100, F.lpad((k % 60).cast("string"), 2, "0"), F.lpad((k % 59).cast("string"), 2, "0"))
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", text.clock_seconds(clock).alias("seconds"))


@query("select o_orderkey, printf('#%02x%02x%02x', o_orderkey % 256, o_orderkey * 3 % 256, o_orderkey * 7 % 256) as colour from orders")
def rgb_hex(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", text.hex_colour(k % 256, k * 3 % 256, k * 7 % 256).alias("colour"))


@query("select o_orderkey, case when o_orderkey % 4 = 0 then 0 when o_orderkey % 4 = 1 then -cast(o_orderkey as int) else cast(o_orderkey as int) end as number from orders")
def c_int(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    digits = k.cast("string")
    written = F.when(k % 4 == 0, "*").when(k % 4 == 1, F.concat(F.lit("  -"), digits)).when(k % 4 == 2, F.concat(F.lit("+"), digits, F.lit("abc9"))).otherwise(digits)
    return spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", text.c_int(written).alias("number"))


@query("select value from (select l_extendedprice as value, row_number() over (order by l_extendedprice) as k from lineitem) where k = 1000")
def kth_smallest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.kth_smallest(spark.read.parquet(f"{sf_dir}/lineitem.parquet"), F.col("l_extendedprice"), 1000)


@query(
    """with s as (select event_type as stage, cast(sum(event_id % 90000) as double) as seconds from events group by event_type)
    select stage, seconds, (seconds * cast(100 as double)) / (select sum(seconds) from s) as share from s"""
)
def log_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    line = F.concat_ws(" ", F.lit("stage"), "event_type", text.clock(F.col("event_id") % 90000), F.lit("elapsed"))
    return logs.stage_profile(events.select(F.col("event_id").alias("line_no"), line.alias("value")))


@query("select cast(event_id as string) as value from (select * from events where event_type = (select min(event_type) from events) order by event_id limit 1)")
def log_variable(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    least = events.agg(F.min("event_type")).first()[0]
    lines = events.select(F.col("event_id").alias("line_no"), F.concat_ws(" ", F.concat(F.lit("x_"), F.col("event_type")), F.col("event_id").cast("string"), F.lit("end")).alias("value"))
    return logs.variable(lines, f"x_{least}")


@query("select row_number() over (order by sid) - 1 as rec_no, name, seq, qual from reads", "reads")
def fastx_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records written in an order and read back in pieces: their numbers follow that order."""
    reads = view(spark, sf_dir, "reads").repartition("sid")
    folder = new_folder(spark, "ordered")
    write_fastx(reads, folder, order="sid", compression="none")
    back, numbers = (fastx.read_fastx(spark, folder, columns=c, layout="four_line", split_bytes=50_000) for c in (None, ["file_id"]))
    counts = numbers.groupBy("file_id").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("file_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row a file
    offsets = F.broadcast(counts.select("file_id", before.alias("before")))
    return back.join(offsets, "file_id").select((F.col("rec_no") + F.col("before")).alias("rec_no"), "name", "seq", "qual")


@query("select name from reads", "reads")
def fastx_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names alone, by a narrowed schema."""
    folder = new_folder(spark, "names")
    view(spark, sf_dir, "reads").select(rendered().alias("value")).write.text(folder)
    return fastx.read_fastx(spark, folder, columns=["name"])


@query("select concat('No.', cast(rec_no as string), chr(9), name) as value from contigs", "contigs")
def contig_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listing(view(spark, sf_dir, "contigs"))


@query("select rid, case when rid % 4 = 0 then 'ACGTN' else seq end as seq from bare_reads where rid % 3 <> 0 and rid % 7 <> 0", "bare_reads")
def bare_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bare reads as lines of a compressed file whose name doesn't say so, headers and blank lines among them."""
    reads = view(spark, sf_dir, "bare_reads")
    value = F.when(F.col("rid") % 3 == 0, "@header").when(F.col("rid") % 7 == 0, " ").when(F.col("rid") % 4 == 0, "ACGTN ").otherwise(F.col("seq"))
    folder = _file(reads.select("rid", value.alias("value")), "bare", "rid", compression="gzip")
    return lines.bare_reads(lines.read_lines(spark, _misnamed(folder)))


@query("select rid as line_no, seq as value from bare_reads", "bare_reads")
def line_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    reads = view(spark, sf_dir, "bare_reads").withColumnRenamed("seq", "value")
    return lines.read_lines(spark, _file(reads, "lines", "rid", compression="gzip"))


@query("select cast(sum(length(n_name) + 1) as bigint) as bytes from nation")
def file_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = _file(spark.read.parquet(f"{sf_dir}/nation.parquet").select(F.col("n_name").alias("value")), "sizes")
    return files.file_sizes(spark, folder).agg(F.sum("bytes").alias("bytes"))


@query("select sid, nullif(case when sid % 3 = 0 then '' else comment end, '') as comment from reads", "reads")
def empty_to_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    comment = F.when(F.col("sid") % 3 == 0, "").otherwise(F.col("comment"))
    return view(spark, sf_dir, "reads").select("sid", sequence.none_if_empty(comment).alias("comment"))


@query(
    """with e as (select event_type as run, event_id as k from events),
    r as (select run, 1000 * cast(max(k) as bigint) as reads, cast(max_by(k % 5000, k) as double) as input, cast(sum(k % 60) as double) as trie, cast(sum(k % 30) as double) as search,
        cast(sum(k % 900) as bigint) as matched, cast(max(k) as bigint) as same, cast(max(k) as string) || '%' as same_share, max(k) as kb, cast(ceil(max(k) * 1000.5) as bigint) as total from e group by run)
    select run, reads, input, trie, search, matched, same, same_share, case when kb > 1048576 then cast(cast(ceil(kb / 1048576.0) as bigint) as string) || 'G' when kb > 1024 then cast(cast(ceil(kb / 1024.0) as bigint) as string) || 'M' else '<1M' end as ram, total, total - input - trie - search as write,
    input * 100 / total as input_share, trie * 100 / total as trie_share, search * 100 / total as search_share, (total - input - trie - search) * 100 / total as write_share, matched * cast(100 as double) / reads as matched_share from r"""
)
def log_run_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logs made of events, one a type: each event gives lines of all kinds."""
    k = F.col("event_id")
    kinds = [
        F.concat(F.lit("Input "), text.thousands(k * 1000), F.lit(" reads in "), text.clock(k % 5000), F.lit(" s")),
        F.concat(F.lit("Chunk 1 in "), text.clock(k % 60), F.lit(" s")),
        F.concat(text.thousands(k % 900), F.lit(" read matched in "), text.clock(k % 30), F.lit(" s")),
        F.concat(F.lit("Found "), text.thousands(k), F.lit(" same reads, taking "), k.cast("string"), F.lit("% of the reads")),
        F.concat(F.lit("MAX_rss: "), k.cast("string"), F.lit(" KB")),
        F.concat(F.lit("Elapsed_seconds "), (k * F.lit(1000.5)).cast("string")),
    ]
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_type").alias("run"), k, F.posexplode(F.array(*kinds)).alias("i", "value"))
    return logs.run_profile(rows.select("run", (k * 10 + F.col("i")).alias("line_no"), "value"))


@query("select cast(max(event_id) * 60 as double) as seconds from events where event_id % 2 = 0")
def log_elapsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    mark = F.when(F.col("event_id") % 2 == 0, "Elapsed (wall clock) time: ").otherwise("other ")
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_id").alias("line_no"), F.concat(mark, F.col("event_id").cast("string"), F.lit(":00")).alias("value"))
    return logs.elapsed(rows)


@query(
    _TRUTH.format(d=10)
    + """, sums as (select count(*) as mapped, count(*) filter (where correct) as correct from truth)
    select mapped, correct, (correct * cast(100 as double)) / (mapped + (select count(*) from alignments where (flag & 4) <> 0)) as accuracy from sums""",
    "alignments",
)
def mapq_table_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The MAPQ table written as a report and read again."""
    records = _records(spark, sf_dir)
    lost = align.unmapped(records).select(F.lit(-1).alias("line_no"), F.col("unmapped").cast("string").alias("value"))
    table = align.mapq_accuracy(records).select(F.col("mapq").alias("line_no"), F.concat_ws(" ", "mapq", "aligned", "correct").alias("value"))
    folder = _file(lost.unionByName(table), "mapq", "line_no")
    unmapped, rows = logs.read_mapq_table(lines.read_lines(spark, folder))
    return logs.accuracy_of_table(rows, unmapped)


@query(
    """with t as (select cast(r_regionkey as string) as k, r_name as n, r_regionkey as o from region union all select 'r_regionkey', 'r_name', -1),
    w as (select max(length(k)) + 2 as a, max(length(n)) + 2 as b from t),
    p as (select o, k, n, a, b, a - length(k) as x, b - length(n) as y from t, w),
    l as (select o, x // 2 + (x & a & 1) as xl, y // 2 + (y & b & 1) as yl, * exclude (o) from p),
    r as (select o, '|' || repeat(' ', cast(xl as bigint)) || k || repeat(' ', cast(x - xl as bigint)) || '|' || repeat(' ', cast(yl as bigint)) || n || repeat(' ', cast(y - yl as bigint)) || '|' as line, '+' || repeat('-', cast(a as bigint)) || '+' || repeat('-', cast(b as bigint)) || '+' as rule from l)
    select max(rule) || chr(10) || string_agg(line || chr(10) || rule, chr(10) order by o) as value from r"""
)
def report_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A box table of the regions, made on the driver."""
    regions = spark.read.parquet(f"{sf_dir}/region.parquet").orderBy("r_regionkey").select("r_regionkey", "r_name")
    return spark.createDataFrame([(tables.frame_table(regions),)], "value string")


@query("select n_name as name, cast(n_nationkey as string) as cell from nation where contains(n_name, (select left(max(n_name), 7) from nation)) order by n_nationkey limit 1")
def report_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two tables put into a Markdown file of the driver, one of them twice, and a cell looked up by a part of its row's name."""
    nations = spark.read.parquet(f"{sf_dir}/nation.parquet").orderBy("n_nationkey").select("n_nationkey", "n_name").collect()
    part = max(r.n_name for r in nations)[:7]
    with tempfile.TemporaryDirectory() as folder:
        file = f"{folder}/notes.md"
        tables.put_markdown_table(file, "Table: other", ["|ID|key|", "|---|---|", "|ANY|0|"])
        for shift in (7, 0):
            tables.put_markdown_table(file, "Table: nations", ["|ID|key|", "|---|---|", *(f"|{r.n_name}|{r.n_nationkey + shift}|" for r in nations)])
        cells = [tables.markdown_lookup(file, "Table: nations", column, part) for column in ("ID", "key")]
    return spark.createDataFrame([tuple(cells)], "name string, cell string")


@query(
    """select count(*) as alignments, count(*) filter (where (flag & 4) <> 0) as unmapped, count(*) filter (where (flag & 2308) = 0) as primary_n,
    count(*) filter (where (flag & 4) = 0 and (flag & 2048) <> 0) as supplementary, count(*) filter (where (flag & 4) = 0 and (flag & 256) <> 0) as secondary,
    cast(sum(as_score) filter (where (flag & 2308) = 0) as double) / count(*) filter (where (flag & 2308) = 0) as mean_as,
    cast(sum(nm) filter (where (flag & 2308) = 0) as double) / count(*) filter (where (flag & 2308) = 0) as mean_nm from alignments""",
    "alignments",
)
def sam_summary_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The summary of alignments that arrive as files."""
    folder = _file(alignment_lines(spark, sf_dir).repartition(4), "stream")
    name = f"summary_{uuid.uuid4().hex}"
    streaming.start(streaming.stream_summary(streaming.stream_lines(spark, folder, 2), "sam_summary"), name, new_folder(spark, "stream-state")).awaitTermination()
    return spark.table(name)


@query("select case when o_orderkey % 3 = 0 then 'x' else 'y' end as kind, count(*) as reads, count(*) - count(distinct seq) as duplicates from reads join orders on sid = o_orderkey group by 1", "reads")
def read_duplicates_by(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("sid") % 3 == 0, "x").otherwise("y").alias("kind")
    return stats.duplicates(view(spark, sf_dir, "reads").select(kind, "seq"), by=("kind",))


@query("select value from (select l_extendedprice as value, row_number() over (order by l_extendedprice) as k from lineitem) where k = (select count(*) // 2 from lineitem)")
def median_price(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A k in the middle, found by ranges of a few thousand distinct values each."""
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return stats.kth_smallest(rows, F.col("l_extendedprice"), rows.count() // 2, ordered=5000)
