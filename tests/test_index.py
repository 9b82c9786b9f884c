"""Random access by an index against whole records, for lines of all layouts and pieces of all sizes."""

import random

import pytest
from pyspark.sql import functions as F

from seqframe.operators.lookup import sequence_view
from seqframe.sources import index
from seqframe.sources.fastx import read_fastx


def fasta(rng, records, newline):
    """Records of even and uneven lines, with blank lines, without bases, and one long one; the last line may lack its end."""
    out = ["text before", ""]
    for k in range(records):
        out.append(f">r{k % (records - 2)}" + rng.choice(["", " a comment", "\ttab and more"]))
        width = rng.choice([1, 7, 60, 61])
        seq = "".join(rng.choices("ACGTN", k=rng.choice([0, 1, 59, 60, 61, 300, 2000])))
        lines = [seq[i : i + width] for i in range(0, len(seq), width)]
        if rng.random() < 0.4 and lines:
            lines.insert(rng.randrange(len(lines) + 1), "")
        if rng.random() < 0.3 and len(lines) > 3:
            lines = [lines[0] + lines[1], *lines[2:]]
        out += lines
    return newline.join(out) + rng.choice(["", newline])


@pytest.mark.parametrize("piece_bytes", [150, 1 << 20])
@pytest.mark.parametrize("newline", ["\n", "\r\n"])
def test_same_as_whole_records(spark, tmp_path, piece_bytes, newline):
    rng = random.Random(piece_bytes)
    for k in range(2):
        (tmp_path / f"{k}.fa").write_bytes(fasta(rng, 14, newline).encode())
    records = read_fastx(spark, f"file://{tmp_path}/0.fa", f"file://{tmp_path}/1.fa")
    folder = index.write_index(spark, f"file://{tmp_path}/index", f"file://{tmp_path}/0.fa", f"file://{tmp_path}/1.fa", piece_bytes=piece_bytes)
    whole = {(r.file_id, r.rec_no): (r.name, r.comment, len(r.seq)) for r in records.collect()}
    assert {(r.file_id, r.rec_no): (r.name, r.comment, r.l_seq) for r in index.index_records(spark, folder).collect()} == whole
    first = {}
    for key in sorted(whole):
        first.setdefault(whole[key][0], whole[key][2])
    asked = [(n, s, length) for n, size in first.items() for s, length in [(1, size), (1, 0), (0, 1), (size, 1), (size + 1, 1), (1, size + 1), *[(rng.randint(1, size + 1), rng.randint(0, 90)) for _ in range(4)]]]
    requests = spark.createDataFrame([*asked, *asked[:3], ("unknown", 1, 1)], "name string, start int, length int")
    got = sorted(map(tuple, index.fetch(spark, folder, requests, range_bytes=64).collect()), key=str)
    unique = records.withColumn("rec_no", F.col("file_id") * 1000 + F.col("rec_no"))
    assert got == sorted(map(tuple, sequence_view(unique, requests).collect()), key=str) and len(got) == len(asked) + 3


def test_only_what_is_asked_for_is_read(spark, tmp_path):
    seq = "".join(random.Random(1).choices("ACGT", k=2_000_000))
    (tmp_path / "a.fa").write_text(">x\n" + "\n".join(seq[i : i + 80] for i in range(0, len(seq), 80)) + "\n>y\nACGT\n")
    folder = index.write_index(spark, f"file://{tmp_path}/index", f"file://{tmp_path}/a.fa", piece_bytes=100_000)
    requests = spark.createDataFrame([("x", 1_500_001, 200), ("x", 79, 3), ("y", 2, 2)], "name string, start int, length int")
    _, ranges = index.ranges_of(spark, folder, requests)
    read = index.read_ranges(ranges).collect()
    assert {(r.name, r.start): r.bases for r in read} == {("x", 1_500_001): seq[1_500_000:1_500_200], ("x", 79): seq[78:81], ("y", 2): "CG"}
    assert sum(r.n_bytes for r in read) <= 205 + 6  # of two million
    assert spark.read.parquet(f"{folder}/segments").count() < 60  # not a row a line


@pytest.mark.parametrize("text", [b"@r\nAC\n+\nII\n", b"\x1f\x8bxx"])
def test_not_fasta(spark, tmp_path, text):
    (tmp_path / "a").write_bytes(text)
    with pytest.raises(Exception, match="only FASTA|only plain FASTA"):
        index.write_index(spark, f"file://{tmp_path}/index", f"file://{tmp_path}/a")


def test_no_records(spark, tmp_path):
    (tmp_path / "a").write_bytes(b"")
    folder = index.write_index(spark, f"file://{tmp_path}/index", f"file://{tmp_path}/a")
    assert index.index_records(spark, folder).count() == 0
    assert index.fetch(spark, folder, spark.createDataFrame([("x", 1, 1)], "name string, start int, length int")).collect() == []
