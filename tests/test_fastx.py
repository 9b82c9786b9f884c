import gzip
import http.server
import io
import random
import threading

import pytest
from pyspark.sql import functions as F

from seqframe.sinks.fastx import listing, rendered, write_fastx
from seqframe.sources.fastx import MalformedRecord, fasta_lines, parsed, read_fastx, records, synced
from seqframe.sources.pieces import Piece
from seqframe.sources.files import file_sizes, text_lines
from seqframe.sources.lines import read_lines
from seqframe.sources.sam import parse_records, read_sam

CASES = {
    "wrapped": (b">a one two\nAC\n\nGT\n>b\nNN\n>c x\nA", [("a", "one two", "ACGT", None), ("b", None, "NN", None), ("c", "x", "A", None)]),
    "mixed": (b">a\nAC\n@b q\nGT\n+\nII\n>c\nT\n", [("a", None, "AC", None), ("b", "q", "GT", "II"), ("c", None, "T", None)]),
    "at_quality": (b"@a\nACGT\n+anything\n@I\n@@\n@b\nA\n+\n@\n", [("a", None, "ACGT", "@I@@"), ("b", None, "A", "@")]),
    "crlf": (b"@a\r\nAC\r\n+\r\nII\r\n@b c\r\nG\r\n+\r\nI\r\n", [("a", None, "AC", "II"), ("b", "c", "G", "I")]),
    "junk_before": (b"junk line\nmore >a c\nAC\n", [("a", "c", "AC", None)]),
    "empty": (b"", []),
    "no_record": (b"only text\n", []),
    "empty_sequence": (b">a\n>b\nA\n", [("a", None, "", None), ("b", None, "A", None)]),
    "two_blanks": (b">a  b \nA\n", [("a", " b ", "A", None)]),
    "no_name": (b"> c\nA\n", [("", "c", "A", None)]),
    "no_last_line_end": (b"@a\nAC\n+\nII", [("a", None, "AC", "II")]),
}


@pytest.mark.parametrize("name", CASES)
def test_grammar(name):
    data, want = CASES[name]
    assert list(records(io.BytesIO(data))) == want
    assert list(records(io.BytesIO(gzip.compress(data)))) == want
    half = len(data) // 2
    assert list(records(io.BytesIO(gzip.compress(data[:half]) + gzip.compress(data[half:])))) == want


BAD = b"@a\nAC\n+\nII\n@b\nACGT\n+\nIII\n@c\nG\n+\nI\n"


def test_malformed():
    assert [r[0] for r in records(io.BytesIO(b"@a\nAC\n+\nII\n@b\nAC\n+\nIII\n@c\nG\n+\nI\n"), "skip")] == ["a", "c"]
    assert [r[0] for r in records(io.BytesIO(b"@a\nAC\n+\nII\n@b\nAC\n+\nIII\n@c\nG\n+\nI\n"), "stop")] == ["a"]
    with pytest.raises(MalformedRecord):
        list(records(io.BytesIO(b"@a\nAC\n+\nII\n@b\nAC\n+\nIII\n@c\nG\n+\nI\n")))
    with pytest.raises(MalformedRecord):
        list(records(io.BytesIO(b"@a\nACGT\n+\nII")))
    with pytest.raises(MalformedRecord):
        list(records(io.BytesIO(b"@a\nACGT\n+")))


def test_source(spark, tmp_path):
    (tmp_path / "reads").mkdir()
    (tmp_path / "reads/1.fq").write_bytes(b"@a\nAC\n+\nII\n@b x\nNNN\n+\nIII\n")
    (tmp_path / "reads/2").write_bytes(gzip.compress(b">c\nG\n") + gzip.compress(b">d\nT\n"))  # gzip without its extension
    df = read_fastx(spark, f"{tmp_path}/reads")
    assert df.rdd.getNumPartitions() == 2
    assert [tuple(r) for r in df.orderBy("file_id", "rec_no").collect()] == [(0, 0, "a", None, "AC", "II", 2), (0, 1, "b", "x", "NNN", "III", 3), (1, 0, "c", None, "G", None, 1), (1, 1, "d", None, "T", None, 1)]
    names = read_fastx(spark, f"file://{tmp_path}/reads/1.fq", columns=["name"])
    assert names.columns == ["name"] and [r.name for r in names.collect()] == ["a", "b"]
    with pytest.raises(Exception, match="nowhere"):
        read_fastx(spark, f"{tmp_path}/nowhere").count()
    (tmp_path / "bad.fq").write_bytes(BAD)
    with pytest.raises(Exception, match="qualities"):
        read_fastx(spark, f"{tmp_path}/bad.fq").count()


def test_fasta_lines_agree(spark, tmp_path):
    text = "".join(f">n{i} c {i}\nACGT\nNN{'A' * (i % 7)}\n" if i % 3 else f">n{i}\r\nAC\r\n" for i in range(500))
    (tmp_path / "x.fa").write_text(text, newline="")
    (tmp_path / "x.fa.gz").write_bytes(gzip.compress(text.encode()))
    want = [(r.name, r.comment, r.seq, r.l_seq) for r in read_fastx(spark, f"{tmp_path}/x.fa").collect()]
    for size in ("128m", "1000"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        for file in ("x.fa", "x.fa.gz"):
            assert [tuple(r) for r in fasta_lines(spark, f"{tmp_path}/{file}").collect()] == want
    spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_round_trip_in_order(spark, tmp_path):
    rows = [(i, f"r{i}", None if i % 3 else f"c {i}", "ACGTN"[i % 5] * (i % 9 + 1), None if i % 4 == 0 else "@" * (i % 9 + 1)) for i in range(300)]
    df = spark.createDataFrame(rows, "rid long, name string, comment string, seq string, qual string").repartition(7)
    write_fastx(df, f"{tmp_path}/out", order="rid")
    back = read_fastx(spark, f"{tmp_path}/out").orderBy("file_id", "rec_no")
    assert [(r.name, r.comment, r.seq, r.qual) for r in back.collect()] == [r[1:] for r in rows]
    assert df.filter("rid = 0").select(rendered().alias("v")).first().v == ">r0 c 0\nA"
    numbered = df.filter("rid < 2").orderBy("rid").select((F.col("rid") + 1).alias("rec_no"), "name", "comment")
    assert [r.value for r in listing(numbered).collect()] == ["No.1\tr0 c 0", "No.2\tr1"]


def four_lines(n):
    rng = random.Random(n)
    out = []
    for i in range(n):
        size = rng.randint(1, 40)
        qual = "".join(rng.choice("@+>I!") for _ in range(size))
        out.append((f"r{i}", None if i % 3 else f"c {i}", "".join(rng.choice("ACGTN") for _ in range(size)), qual))
    return out


@pytest.mark.parametrize("end", ["\n", "\r\n"])
@pytest.mark.parametrize("size", [1, 37, 400, 1 << 20])
def test_pieces_of_a_four_line_file(spark, tmp_path, end, size):
    rows = four_lines(150)
    text = "".join(f"@{n}{' ' + c if c else ''}{end}{s}{end}+{n if len(s) % 2 else ''}{end}{q}{end}" for n, c, s, q in rows)
    (tmp_path / "x.fq").write_text(text, newline="")
    (tmp_path / "y.fq.gz").write_bytes(gzip.compress(text.encode()))
    step = max(size, 37)
    found = []
    for at in range(0, len(text), step):
        with Piece(f"{tmp_path}/x.fq", "plain", at, at + step) as piece:
            found += list(parsed(synced(piece.lines(), "four_line") if at else piece.lines()))
    assert found == rows
    if size in (37, 400):
        df = read_fastx(spark, f"{tmp_path}/x.fq", f"{tmp_path}/y.fq.gz", layout="four_line", split_bytes=max(size, 400))
        assert df.rdd.getNumPartitions() > 2 and df.columns == read_fastx(spark, f"{tmp_path}/x.fq").columns
        back = {(r.file_id, r.rec_no): (r.name, r.comment, r.seq, r.qual) for r in df.collect()}
        assert back == {(f, i): r for f in (0, 1) for i, r in enumerate(rows)}
        assert sorted(r.name for r in read_fastx(spark, f"{tmp_path}/x.fq", columns=["name"], layout="four_line", split_bytes=400).collect()) == sorted(r[0] for r in rows)


def test_pieces_of_a_fasta_file(spark, tmp_path):
    text = "".join(f">n{i} c\nAC\n{'GT' * (i % 30)}\n" for i in range(200))
    (tmp_path / "x.fa").write_text(text)
    want = [(r.rec_no, r.name, r.seq) for r in read_fastx(spark, f"{tmp_path}/x.fa").collect()]
    df = read_fastx(spark, f"{tmp_path}/x.fa", columns=["rec_no", "name", "seq"], layout="fasta", split_bytes=333)
    assert sorted(map(tuple, df.collect())) == want
    with pytest.raises(Exception, match="layout"):
        read_fastx(spark, f"{tmp_path}/x.fa", layout="other").count()


def test_lines_by_content(spark, tmp_path):
    """Compression is told by the first bytes, whatever a file is called; numbers follow files and lines."""
    (tmp_path / "t").mkdir()
    data = {"a.txt": ["one", "", "two é"], "b.txt.gz": ["three"], "c.sam": ["four", "five"], "d.gz": ["six"], "e": []}
    for name, rows in data.items():
        raw = "".join(f"{x}\n" for x in rows).encode()
        (tmp_path / "t" / name).write_bytes(gzip.compress(raw) if name in ("b.txt.gz", "c.sam") else raw)
    assert sorted(r.value for r in text_lines(spark, f"{tmp_path}/t").collect()) == sorted(x for rows in data.values() for x in rows)
    for name, rows in data.items():
        assert [tuple(r) for r in read_lines(spark, f"{tmp_path}/t/{name}").orderBy("line_no").collect()] == list(enumerate(rows))
    (tmp_path / "u").mkdir()
    for i in range(5):
        (tmp_path / f"u/{i}.txt").write_text("".join(f"{i} {k}\n" for k in range((7 * i) % 5 * 40)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "150")
    rows = sorted(map(tuple, read_lines(spark, f"{tmp_path}/u").collect()))
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert rows == list(enumerate(f"{i} {k}" for i in range(5) for k in range((7 * i) % 5 * 40)))
    sizes = {r.file.rsplit("/", 1)[1]: r.bytes for r in file_sizes(spark, f"{tmp_path}/t").collect()}
    assert sizes == {name: (tmp_path / "t" / name).stat().st_size for name in data}
    plan = read_lines(spark, f"{tmp_path}/u")._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan.replace("BroadcastExchange", "")


def test_sam_by_content(spark, tmp_path):
    line = "\t".join(["q", "0", "c", "7", "3", "4M", "*", "0", "0", "ACGT", "*"])
    (tmp_path / "x.sam").write_bytes(gzip.compress(f"@HD\tVN:1\n{line}\n\n".encode()))
    lines = read_sam(spark, f"{tmp_path}/x.sam")
    assert [(r.qname, r.pos) for r in parse_records(lines).collect()] == [("q", 7)]
    assert sorted((r.qname, r.pos) for r in parse_records(lines, blank="zero").collect()) == [("", 0), ("q", 7)]


def test_addresses_and_standard_input(spark, tmp_path, monkeypatch):
    """Over a server on this machine: only what answers 200 is read, and redirects aren't followed."""
    data = gzip.compress(b"@a\nAC\n+\nII\n")

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            self.send_response({"/x.fq": 200, "/moved": 302}.get(self.path, 404))
            if self.path == "/moved":
                self.send_header("Location", "/x.fq")
            self.end_headers()
            if self.path == "/x.fq":
                self.wfile.write(data)

        def log_message(self, *_):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    top = f"http://127.0.0.1:{server.server_port}"
    try:
        assert [r.name for r in read_fastx(spark, f"{top}/x.fq").collect()] == ["a"]
        for path in ("moved", "none"):
            with pytest.raises(OSError):
                read_fastx(spark, f"{top}/{path}")
    finally:
        server.shutdown()
    monkeypatch.setattr("sys.stdin", io.TextIOWrapper(io.BytesIO(b"one\ntwo\n")))
    assert [r.value for r in read_lines(spark, "-").orderBy("line_no").collect()] == ["one", "two"]
