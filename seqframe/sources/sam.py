"""Alignment text as columns, by expressions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seqframe.functions.text import c_int
from seqframe.sources.files import text_lines

#: Mandatory fields in file order and whether each is a number; fixed by the format.
FIELDS = {
    "qname": False,
    "flag": True,
    "rname": False,
    "pos": True,
    "mapq": True,
    "cigar": False,
    "rnext": False,
    "pnext": True,
    "tlen": True,
    "seq": False,
    "qual": False,
}


def read_sam(spark: SparkSession, path: str) -> DataFrame:
    """Lines of alignment text (column `value`), compressed or not, told by content; splits where a file isn't compressed."""
    return text_lines(spark, path)


def _tag(parts: Column, tag: str) -> Column:
    """The number of the last optional field of that name; 0 without one."""
    extra = F.slice(parts, len(FIELDS) + 1, F.greatest(F.size(parts) - len(FIELDS), F.lit(0)))
    mine = F.filter(extra, lambda t: F.left(t, F.lit(2)) == tag)
    return F.coalesce(c_int(F.substring(F.try_element_at(mine, F.lit(-1)), 6, 1 << 30)), F.lit(0))


def parse_records(lines: DataFrame, keep: tuple[str, ...] = (), value: str = "value", blank: str = "drop") -> DataFrame:
    """One row an alignment: the mandatory fields and `opt` (`nm`, `as`); header lines are left out, `keep` columns kept.

    `blank`: a blank line is left out (`drop`), or an alignment whose fields are empty and zero (`zero`).

    A line is split once: the parts come out of an `explode` of one value, through which no filter or projection is pushed.
    """
    if blank not in ("drop", "zero"):
        raise ValueError("blank must be drop or zero")
    body = lines.filter(~F.col(value).startswith("@"))
    if blank == "drop":
        body = body.filter(F.trim(value) != "")
    parts = F.col("_parts")
    fields = [(c_int(F.coalesce(F.get(parts, F.lit(i)), F.lit(""))) if number else F.coalesce(F.get(parts, F.lit(i)), F.lit(""))).alias(name) for i, (name, number) in enumerate(FIELDS.items())]
    split = body.select(*keep, F.explode(F.array(F.split(F.col(value), "\t"))).alias("_parts"))
    return split.select(*keep, *fields, F.struct(_tag(parts, "NM").alias("nm"), _tag(parts, "AS").alias("as")).alias("opt"))


def _header_field(value: Column, name: str) -> Column:
    return F.nullif(F.regexp_extract(value, rf"(?:^|\t){name}:([^\t]*)", 1), F.lit(""))


def header_sequences(lines: DataFrame, value: str = "value") -> DataFrame:
    """`sn`, `ln` of every @SQ line."""
    sq = lines.filter(F.col(value).startswith("@SQ\t"))
    return sq.select(_header_field(F.col(value), "SN").alias("sn"), c_int(F.coalesce(_header_field(F.col(value), "LN"), F.lit(""))).alias("ln"))


def header_summary(lines: DataFrame, value: str = "value", order: str = "line_no") -> DataFrame:
    """One row: `hd` (vn, so) and `pg` (id, pn, vn, cl); of repeated fields the last in `order` stays."""

    def last(kind: str, field: str) -> Column:
        found = F.when(F.col(value).startswith(f"@{kind}\t"), _header_field(F.col(value), field))
        return F.max_by(found, F.when(found.isNotNull(), F.col(order)))

    return lines.filter(F.col(value).startswith("@")).agg(
        F.struct(*[last("HD", x).alias(x.lower()) for x in ("VN", "SO")]).alias("hd"),
        F.struct(*[last("PG", x).alias(x.lower()) for x in ("ID", "PN", "VN", "CL")]).alias("pg"),
    )
