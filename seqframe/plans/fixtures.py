"""Reads, alignments and contigs derived from the driver's tables by expressions that Spark and DuckDB share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_ALPHABET, _QUALITIES = "ACGTACGTACGTACGN", "!#%&+,-/:;<=>?@I"


def bases(text: str) -> str:
    """32 bases, N among them, made of a text expression."""
    return f"translate(md5({text}),'0123456789abcdef','{_ALPHABET}')"


_CUST = bases("cast(o_custkey as string)")

#: Select lists and tables of each view.
VIEWS: dict[str, tuple[str, str]] = {
    "reads": (
        f"o_orderkey as sid, concat('rd',cast(o_orderkey as string),'/1') as name, o_orderpriority as comment, {_CUST} as seq, translate(md5(cast(o_orderkey as string)),'0123456789abcdef','{_QUALITIES}') as qual",
        "orders",
    ),
    "bare_reads": (f"o_orderkey as rid, case when o_orderkey%10=0 then 'ACGT' else {_CUST} end as seq", "orders"),
    "mates1": ("o_orderkey as rid, concat('frag',cast(o_custkey as string),'/1') as name", "orders"),
    "mates2": (f"(o_orderkey*7919)%1000003 as rid, concat('frag',cast(o_custkey as string),'/2') as name, {bases("concat('m',cast(o_orderkey as string))")} as seq", "orders"),
    "aln_base": (f"o_orderkey as k, concat('chr',cast(o_custkey%5+1 as string)) as rname0, cast(o_custkey*37+101 as int) as pos, cast(o_orderkey%31-15 as int) as jit, {_CUST} as seq", "orders"),
    "alignments": (
        "k, concat(rname0,'_',cast(pos+jit as string),'_',cast(pos+jit+31 as string),'_',cast(k as string)) as qname, "
        "cast(case when k%97=0 then 4 else (case when k%2=1 then 16 else 0 end)+(case when k%11=0 then 256 else 0 end)+(case when k%13=0 then 2048 else 0 end) end as int) as flag, "
        "case when k%29=0 then 'chrX' else rname0 end as rname, pos, cast(k%61 as int) as mapq, seq, cast(k%7 as int) as nm, cast(32-5*(k%7) as int) as as_score",
        "aln_base",
    ),
    "aln_flags": ("o_orderkey as k, cast((o_orderkey*977)%4096 as int) as flag", "orders"),
    "contigs": (f"cast(n_nationkey+1 as int) as rec_no, n_name as name, cast(null as string) as comment, repeat({bases('n_name')},cast(n_nationkey+1 as int)) as seq", "nation"),
    "sam_sq": ("n_name as sn, cast(n_nationkey*1000+500 as int) as ln", "nation"),
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    columns, table = VIEWS[name]
    source = view(spark, sf_dir, table) if table in VIEWS else spark.read.parquet(f"{sf_dir}/{table}.parquet")
    return source.selectExpr(*_split(columns))


def _split(columns: str) -> list[str]:
    """A select list at its top-level commas."""
    out, depth, quoted, start = [], 0, False, 0
    for i, c in enumerate(columns):
        if c == "'":
            quoted = not quoted
        elif not quoted:
            depth += (c == "(") - (c == ")")
            if c == "," and not depth:
                out.append(columns[start:i].strip())
                start = i + 1
    return [*out, columns[start:].strip()]


def with_views(sql: str, *names: str, recursive: bool = False) -> str:
    """A query with the named views (and what they need) as common table expressions."""
    needed: list[str] = []

    def add(name: str) -> None:
        if VIEWS[name][1] in VIEWS:
            add(VIEWS[name][1])
        if name not in needed:
            needed.append(name)

    for n in names:
        add(n)
    listed = ", ".join(f"{n} as (select {VIEWS[n][0]} from {VIEWS[n][1]})" for n in needed)
    body = sql.strip()
    word = "with recursive" if recursive else "with"
    return f"{word} {listed}, {body[5:]}" if body.startswith("with ") else f"{word} {listed} {body}"
