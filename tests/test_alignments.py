import pytest

from seqframe.operators import align, stats
from seqframe.sources import sam
from seqframe.sources.lines import bare_reads, numbered, read_lines
from seqframe.streaming import start, stream_lines, stream_read_stats, stream_summary


def line(qname, flag, rname="chr1", pos=100, mapq=60, seq="ACGT", *tags):
    return "\t".join(map(str, [qname, flag, rname, pos, mapq, "4M", "*", 0, 0, seq, "*", *tags]))


@pytest.fixture
def lines(spark):
    return lambda *values: spark.createDataFrame([(v,) for v in values], "value string")


def test_parser(lines):
    rows = sam.parse_records(
        lines("@HD\tVN:1.6", "", line("a", 16, "chr1", 7, 3, "AC", "NM:i:2", "XX:Z:q", "AS:i:9", "NM:i:4"), line("b", 0), "c\t4", line("d", "x", "*", "*", " 12z"))
    ).collect()
    assert [(r.qname, r.flag, r.pos, r.mapq, r.seq, r.opt.nm, getattr(r.opt, "as")) for r in rows] == [("a", 16, 7, 3, "AC", 4, 9), ("b", 0, 100, 60, "ACGT", 0, 0), ("c", 4, 0, 0, "", 0, 0), ("d", 0, 0, 12, "ACGT", 0, 0)]


def test_header(spark, lines):
    values = ["@HD\tVN:1\tSO:queryname", "@SQ\tSN:x\tLN:5", "@SQ\tLN:7\tSN:y", "@PG\tID:p\tCL:run it", "@HD\tVN:2", "@CO\tSN:no", "r\t0"]
    assert [tuple(r) for r in sam.header_sequences(lines(*values)).collect()] == [("x", 5), ("y", 7)]
    assert stats.reference_length(sam.header_sequences(lines(*values))).first().ref_len == 12
    r = sam.header_summary(numbered(lines(*values))).first()
    assert (r.hd.vn, r.hd.so, r.pg.id, r.pg.pn, r.pg.cl) == ("2", "queryname", "p", None, "run it")
    assert stats.reference_length(sam.header_sequences(lines("r\t0"))).first().ref_len == 0


def test_summary_counts_overlapping_flags(lines):
    records = sam.parse_records(lines(line("a", 0x100 | 0x800), line("b", 4 | 0x100), line("c", 0x100), line("d", 0, "c", 1, 1, "A", "AS:i:7", "NM:i:1"), line("e", 16)))
    r = align.sam_summary(records).first()
    assert tuple(r) == (5, 1, 2, 1, 2, 3.5, 0.5)
    empty = align.sam_summary(records.limit(0)).first()
    assert (empty.alignments, empty.mean_as) == (0, None)
    assert align.flag_census(records).first().secondary == 3


@pytest.mark.parametrize("distance", [0, 10])
def test_accuracy_at_the_edges(lines, distance):
    values = []
    for off in (-distance - 1, -distance, 0, distance, distance + 1):
        values += [line("chr1_100_200_x", 0, "chr1", 100 + off, 60), line("chr1_100_200_x", 16, "chr1", 197 + off, 0)]
    values += [line("chr1_100_200_x", 0, "chr2", 100, 255), line("bad", 4, "*", 0, 0), line("bad", 0x100, "chr1", 1, 9), line("chr1_100_200_x", 16, "chr1", 200, 7, "*")]
    records = sam.parse_records(lines(*values))
    assert [tuple(r) for r in align.mapq_accuracy(records, distance).collect()] == [(0, 5, 3), (7, 1, 1), (60, 5, 3), (255, 1, 0)]
    total = align.accuracy_total(records, distance).first()
    assert tuple(total) == (12, 7, 1, 100 * 7 / 13)
    assert total.mapped == align.sam_summary(records).first().primary_n


def test_accuracy_guards(lines):
    with pytest.raises(Exception, match="paired"):
        align.mapq_accuracy(sam.parse_records(lines(line("chr1_1_2_x", 0x40 | 4)))).collect()
    for name in ("chr1_1_2", "chr1_a_2_x", "chr1"):
        records = sam.parse_records(lines(line(name, 0)))
        with pytest.raises(Exception, match="no simulated position"):
            align.mapq_accuracy(records).collect()
        assert align.mapq_accuracy(records, malformed="skip").count() == 0


def test_lines(spark, tmp_path):
    (tmp_path / "r.txt").write_text("@h\nAC\n\nGT \n")
    assert [tuple(r) for r in bare_reads(read_lines(spark, f"{tmp_path}/r.txt")).collect()] == [(1, "AC"), (3, "GT")]
    assert read_lines(spark, f"{tmp_path}/none.txt", missing_ok=True).count() == 0


def test_streams_equal_batches(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for i in range(3):
        (tmp_path / f"in/{i}.sam").write_text("@HD\tVN:1\n" + "\n".join(line(f"chr1_{k}_{k + 50}_x", 16 * (k % 2) + (4 if k % 9 == 0 else 0), "chr1", k, k % 5) for k in range(i * 10, i * 10 + 10)) + "\n")
    folder = f"{tmp_path}/in"
    batch = sam.parse_records(spark.read.text(folder))
    for name, whole in (("sam_summary", align.sam_summary), ("flag_census", align.flag_census), ("mapq_accuracy", align.mapq_accuracy)):
        q = start(stream_summary(stream_lines(spark, folder, 1), name), f"s_{name}", f"{tmp_path}/cp_{name}")
        q.awaitTermination()
        assert sorted(map(tuple, spark.table(f"s_{name}").collect())) == sorted(map(tuple, whole(batch).collect()))
    q = start(stream_read_stats(stream_lines(spark, folder, 1)), "s_reads", f"{tmp_path}/cp_reads")
    q.awaitTermination()
    assert spark.table("s_reads").first().seqs_n == 30
