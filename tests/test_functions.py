import datetime
import math
import random
from decimal import Decimal
from types import SimpleNamespace

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from seqframe.functions import sequence, text
from seqframe.operators import lookup, stats
from seqframe.report import logs, measure, tables


def values(spark, f, rows, kind="string"):
    return [r.y for r in spark.createDataFrame([(x,) for x in rows], f"x {kind}").select(f(F.col("x")).alias("y")).collect()]


def test_numbers_and_durations(spark):
    assert values(spark, text.c_int, ["12abc", " \t-7", "+3", "*", "", "x1", "99999999999", None]) == [12, -7, 3, 0, 0, 0, 0, 0]
    assert values(spark, text.strict_digits, ["12", "1a", "", "-1"]) == [12, None, None, None]
    assert values(spark, text.thousands, [12345345, -1234, 0], "long") == ["12,345,345", "-1,234", "0"]
    assert values(spark, text.clock, [0.9, 61.0, 360000.0], "double") == ["00:00:00", "00:01:01", "100:00:00"]
    assert values(spark, text.clock_ceil, [0.1, 59.5, 3600.0], "double") == ["0:00:01", "0:01:00", "1:00:00"]
    assert values(spark, text.clock_seconds, ["1:02:03", "4:05.5", "7", "x"]) == [3723.0, 245.5, 7.0, None]
    assert values(spark, text.memory_text, [1023, 1024, 1048575, 1572864], "long") == ["1023 KB", "1 MB", "1023 MB", "1.5 GB"]
    assert values(spark, text.memory_short, [0, 1, 1025, 1048577], "long") == ["None", "<1M", "2M", "2G"]
    assert values(spark, lambda x: text.hex_colour(x, x + 1, F.lit(255)), [9], "int") == ["#090aff"]
    assert values(spark, text.fields, ["  a  b\tc "]) == [["a", "b", "c"]]


def test_names_and_bases(spark):
    assert values(spark, sequence.trim_mate_suffix, ["a/1", "/1", "a/12", "a/x", "é/2"]) == ["a", "/1", "a/12", "a/x", "é"]
    assert values(spark, sequence.chop2, ["ab/1", "ab", "a"]) == ["ab", "", None]
    assert values(spark, sequence.base_code, ["A", "C", "G", "N", "T", "a", "AC", ""]) == [0, 1, 2, 3, 4, None, None, None]
    assert values(spark, sequence.lenient_code, ["A", "c", "G", "t", "-", "N", "x"]) == [0, 1, 2, 3, 5, 4, 4]
    assert values(spark, sequence.n_count, ["NANn", "", "ACG"]) == [2, 0, 0]
    assert values(spark, sequence.is_strict, ["ACGTN", "acg", ""]) == [True, False, True]


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(st.characters(min_codepoint=32, max_codepoint=126), max_size=30), min_size=1, max_size=20))
def test_hash(spark, names):
    def plain(x):
        h = 0
        for c in x:
            h = (h * 1313 + ord(c)) % (1 << 64)
        return h

    assert [int(v) for v in values(spark, sequence.bkdr_hash, names)] == [plain(x) for x in names]


def test_lookup(spark):
    records = spark.createDataFrame([(1, "a", None, "ACGT"), (2, "b", "c", "NN"), (3, "a", None, "T")], "rec_no long, name string, comment string, seq string")
    assert [r.name for r in lookup.nth_record(records, 2).collect()] == ["b"] and lookup.nth_record(records, 0).count() == 0
    requests = spark.createDataFrame([("a", 1, 4), ("a", 2, 4), ("a", 0, 1), ("a", 2, -1), ("b", 1, 0), ("z", 1, 1)], "name string, start int, length int")
    rows = {(r.name, r.start, r.length): (r.l_seq, r.bases, r.in_bounds) for r in lookup.sequence_view(records, requests).collect()}
    assert rows == {("a", 1, 4): (4, "ACGT", True), ("a", 2, 4): (4, None, False), ("a", 0, 1): (4, None, False), ("a", 2, -1): (4, "", True), ("b", 1, 0): (2, "", True)}
    assert [r.comment for r in lookup.contig_list(records).collect()] == ["", "c", ""]


def test_read_statistics(spark):
    reads = spark.createDataFrame([("ACN",), ("NNAA",), ("G",)], "seq string")
    assert tuple(stats.read_stats(reads).first()) == (3, 1, 4, 2, 8, 3, 1, 2)
    assert tuple(stats.read_stats(reads.limit(0)).first()) == (0, None, None, 0, 0, 0, 0, 0)
    assert tuple(stats.read_stats(reads.filter("seq = 'G'")).first())[3:] == (0, 1, 0, 0, 0)
    assert [r.file_no for r in stats.read_stats_paired(reads, reads).orderBy("file_no").collect()] == [1, 2]
    with pytest.raises(Exception, match="unequal"):
        stats.read_stats_paired(reads, reads.limit(2)).collect()
    with pytest.raises(Exception, match="unequal"):
        stats.read_stats_paired(reads, reads.limit(0)).collect()
    numbers = spark.createDataFrame([(x,) for x in [5, 1, 1, 3, None]], "x int")
    assert [[r.value for r in stats.kth_smallest(numbers, F.col("x"), k).collect()] for k in (1, 2, 3, 4, 5)] == [[1], [1], [3], [5], []]


def test_reports(spark, tmp_path):
    box = tables.box_table([["a", "bb"], ["ccc", None]], "T", "note")
    assert box.splitlines()[-1] == "note" and len({len(x) for x in box.splitlines()[:-1]}) == 1
    assert "reads" in tables.read_stats_report(stats.read_stats(spark.createDataFrame([("AN",)], "seq string")).first())
    row = SimpleNamespace(alignments=3, unmapped=1, primary_n=2, supplementary=0, secondary=0, mean_as=0.125, mean_nm=None)
    assert tables.sam_summary_report(row, 7).splitlines()[-2:] == ["Alignment_Score:  0.12", "Edit_distance:    -"]
    assert tables.mapq_report(4, [SimpleNamespace(mapq=0, aligned=2, correct=1)]) == "4\n0 2 1\n"
    md = tmp_path / "x.md"
    table = ["|ID|#reads|", "|---|---|", "|d_1|5|"]
    tables.put_markdown_table(md, "Table: A", table)
    tables.put_markdown_table(md, "Table: B", table)
    tables.put_markdown_table(md, "Table: A", [*table[:2], "|d_1|6|"])
    assert tables.markdown_lookup(md, "Table: A", "#reads", "d_") == "6" and tables.markdown_lookup(md, "Table: B", "#reads", "d_1") == "5"
    assert tables.markdown_lookup(md, "Table: C", "#reads", "d_1") is None and tables.markdown_lookup(tmp_path / "no", "A", "b", "c") is None


def test_logs(spark):
    def lines(*v):
        return spark.createDataFrame(list(enumerate(v)), "line_no long, value string")

    log = lines("my_var 7 x", "my_var 8", "Elapsed (wall clock) time: 1:02", "Elapsed (wall clock) time: 2:03:04", "stage a 0:01:00", "stage b 0:03:00", "stage a 0:00:00 end")
    assert logs.variable(log, "var").first().value == "7" and logs.variable(log, "none").first().value == "0"
    assert logs.elapsed(log).first().seconds == 7384.0
    assert {r.stage: (r.seconds, r.share) for r in logs.stage_profile(log).collect()} == {"a": (60.0, 25.0), "b": (180.0, 75.0)}
    run = lines("Input 1,000 reads in 0:00:10 s", "Chunk 1 0:00:20 s", "Chunk 2 0:00:20 s", "300 read matched 0:00:05 s", "1,200 read matched 0:00:05 s", "Elapsed_seconds 99.5").withColumn("run", F.lit("x"))
    r = logs.run_profile(run).first()
    assert (r.reads, r.input, r.trie, r.search, r.matched, r.total, r.write) == (1000, 10.0, 40.0, 10.0, 1500, 100, 40.0) and math.isclose(r.trie_share, 40.0)
    unmapped, rows = logs.read_mapq_table(lines("5", "0 10 4", "60 20 20", "", "9 9 9"))
    assert unmapped == 5 and tuple(logs.accuracy_of_table(rows, unmapped).first()) == (30, 24, 100 * 24 / 35)
    empty = rows.limit(0)
    assert logs.accuracy_of_table(empty, 0).first().accuracy is None


def test_run_profile_memory_and_same_reads(spark):
    rows = ["Input 10 reads in 0:00:01 s", "Found 1,234 same reads, taking 0.14% of the reads", "MAX_rss: 2097153 KB", "Elapsed_seconds 9"]
    log = spark.createDataFrame(list(enumerate(rows)), "line_no long, value string").withColumn("run", F.lit("x"))
    r = logs.run_profile(log).first()
    assert (r.same, r.same_share, r.ram) == (1234, "0.14%", "3G")
    none = logs.run_profile(log.filter("line_no = 0")).first()
    assert (none.same, none.same_share, none.ram, none.total) == (0, None, "None", None)


def test_rounding_like_c(spark):
    rng = random.Random(1)
    numbers = [0.125, 0.375, 1.005, 2.675, 1.115, -0.125, 0.0, -0.0, -0.001, 1e12, 123456.785, 0.5, 1.5, 2.5, 0.045, 8.345]
    numbers += [rng.randint(-(10**7), 10**7) / 1000 + 0.0005 for _ in range(2000)] + [rng.random() * 10 ** rng.randint(-6, 9) for _ in range(2000)] + [rng.randint(0, 10**6) / 8 for _ in range(500)]
    for digits in (0, 1, 2, 3):
        assert values(spark, lambda x, d=digits: text.fixed(x, d), numbers, "double") == [f"%.{digits}f" % x for x in numbers]
    assert values(spark, lambda x: text.fixed(x, 2), [None], "double") == [None]


def test_kth_smallest_by_ranges(spark):
    rng = random.Random(2)
    for kind, pool in (("long", [rng.randint(-500, 500) for _ in range(3000)]), ("string", [f"v{rng.randint(0, 700):04d}" for _ in range(3000)])):
        rows = spark.createDataFrame([(x,) for x in pool] + [(None,)], f"x {kind}").repartition(3)
        for k in (1, 2, 1499, 2999, 3000):
            assert [r.value for r in stats.kth_smallest(rows, F.col("x"), k, ordered=40).collect()] == [sorted(pool)[k - 1]]
        assert stats.kth_smallest(rows, F.col("x"), 3001, ordered=40).count() == 0
    assert stats.kth_smallest(rows.limit(0), F.col("x"), 1).count() == 0


def test_kth_smallest_by_a_sketch(spark):
    """Numbers, ties, dates and values that aren't finite, with brackets that are narrowed again and again."""
    rng = random.Random(5)
    pools = {
        "double": [rng.gauss(0, 1) for _ in range(3000)] + [float("inf")] * 40 + [float("-inf")] * 30,
        "decimal(12,2)": [Decimal(rng.randint(-(10**6), 10**6)) / 100 for _ in range(3000)],
        "int": [rng.choice([1, 1, 1, 2, 9]) for _ in range(3000)],
        "date": [datetime.date(2020, 1, 1) + datetime.timedelta(rng.randint(0, 900)) for _ in range(3000)],
    }
    for kind, pool in pools.items():
        rows = spark.createDataFrame([(x,) for x in pool] + [(None,)], f"x {kind}").repartition(3)
        for k in (1, 3, len(pool) // 2, len(pool)):
            for ordered in (30, 1 << 20):
                assert [r.value for r in stats.kth_smallest(rows, F.col("x"), k, ordered).collect()] == [sorted(pool)[k - 1]], (kind, k, ordered)
        assert stats.kth_smallest(rows, F.col("x"), len(pool) + 1).count() == 0 == stats.kth_smallest(rows, F.col("x"), 0).count()


def test_children_and_stages(spark, tmp_path):
    status, usage = measure.child(["python3", "-c", "import sys; x = bytes(30_000_000); sys.exit(3)"])
    assert status == 3 and usage.wall > 0 and usage.peak_kb > 20_000
    report = measure.usage_report(["ls", "-l"], measure.Usage(3725.25, 7450.5, 3 << 19), 0)
    assert report.splitlines() == ['\tCommand:     "ls -l"', "\tMAX_rss:     1.5 GB", "\tCPU_time:    02:04:10  i.e.  7450.5 sec", "\tWall_clock:  01:02:05  i.e.  3725.2 sec", "\tJob_CPU:     2.00", "\tExit_status: 0"]
    assert [measure.write_report(tmp_path / "p", report).name for _ in range(2)] == ["0001.pstat", "0002.pstat"]
    with pytest.raises(FileExistsError):
        measure.write_report(tmp_path / "p", report, most=2)
    spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count().collect()
    rows = measure.stage_metrics(spark).collect()
    assert rows and any(r.shuffle_written > 0 and r.tasks > 0 for r in rows)
    assert "driver" in {r.executor for r in measure.executor_peaks(spark).collect()}


def test_frame_tables_are_whole(spark):
    assert tables.frame_table(spark.range(3)).count("\n") == 8
    with pytest.raises(ValueError, match="more than 3"):
        tables.frame_table(spark.range(4), most=3)


def test_measure():
    out, usage = measure.measured(lambda: sum(range(1000)))
    assert out == 499500 and usage.wall >= 0 and usage.peak_kb > 0 and usage.ratio >= 0
