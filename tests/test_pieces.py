"""Files in pieces, cut anywhere, against one pass over the whole file."""

import io
import pickle
import random
import struct
import zlib

import pytest

from seqframe.sources import fastx, pieces
from seqframe.sources.fastx import parsed, read_fastx, records
from seqframe.sources.files import text_lines
from seqframe.sources.pieces import H, Piece, Q, S, entries, kind_of, kinds, leave, summary


def member(content):
    raw = zlib.compressobj(6, zlib.DEFLATED, -15)
    data = raw.compress(content) + raw.flush()
    return b"\x1f\x8b\x08\x04" + bytes(6) + struct.pack("<H", 6) + b"BC" + struct.pack("<HH", 2, len(data) + 25) + data + struct.pack("<II", zlib.crc32(content), len(content))


def blocks(content, size):
    return b"".join(member(content[i : i + size]) for i in range(0, len(content), size)) + member(b"")


def grammar(seed, n):
    """Records over several lines, with and without qualities, whose qualities look like headers, and bad ones."""
    rng = random.Random(seed)
    end = rng.choice(["\n", "\r\n"])
    out = [rng.choice(["", "junk", "junk >mid line"])]

    def wrapped(text):
        width = rng.choice([1, 4, 9, 1000])
        lines = [text[i : i + width] for i in range(0, len(text), width)] or rng.choice([[], [""]])
        if rng.random() < 0.2:
            lines.insert(rng.randrange(len(lines) + 1), "")
        return lines

    for i in range(n):
        bases = "".join(rng.choices("ACGT", k=rng.choice([0, 1, 5, 12, 40])))
        if rng.random() < 0.3:
            out += [f">f{i} c", *wrapped(bases)]
            continue
        quals = "".join(rng.choices("@>+I!", k=len(bases) + rng.choice([0] * 12 + [1])))
        out += [f"@q{i}", *wrapped(bases), "+" + rng.choice(["", "x>@"]), *(wrapped(quals) or [""])]
    if rng.random() < 0.3:
        out += ["@last", "ACGT", "+"]  # a record without its qualities
    return (end.join(out) + rng.choice(["", end])).encode()


def by_pieces(path, kind, size, total):
    state, found = (H, 0), []
    for at in range(0, total, size):
        with Piece(path, kind, at, min(at + size, total)) as piece:
            found += list(parsed(piece.lines(), "skip", state))
        with Piece(path, kind, at, min(at + size, total)) as piece:
            state = leave(summary(piece.blocks()), state)
    return found


@pytest.mark.parametrize("seed", range(40))
def test_every_cut(tmp_path, seed):
    text = grammar(seed, 25)
    whole = list(records(io.BytesIO(text), "skip"))
    path = f"{tmp_path}/x"
    (tmp_path / "x").write_bytes(text)
    for size in (*range(1, 40, 2), 100, 333):
        assert by_pieces(path, "plain", size, len(text)) == whole, size
    packed = blocks(text, random.Random(seed).choice([1, 7, 50, 300]))
    (tmp_path / "x").write_bytes(packed)
    assert kind_of(path) == "blocks" and list(records(io.BytesIO(packed), "skip")) == whole
    for size in (11, 90, 700, 1 << 20):
        assert by_pieces(path, "blocks", size, len(packed)) == whole, size


def test_summaries_are_short(tmp_path):
    """Wrong guesses fall in with right ones: a table has rows for the last record alone."""
    rng = random.Random(1)
    text = "".join(f"@r{i}\n{'A' * 100}\n+\n{''.join(rng.choices('@>+I', k=100))}\n" for i in range(5000)).encode()
    (tmp_path / "x").write_bytes(text)
    with Piece(f"{tmp_path}/x", "plain", 1000, len(text) - 77) as piece:
        told = summary(piece.blocks())
    assert told["lines"] > 19_000 and len(told["sums"]) < 10 and len(told["states"]) < 10


def test_states_that_go_through_a_piece():
    empty, bare = summary(iter(())), summary(iter([b"ACGT\nAC\n"]))
    for state in ((H, 0), (S, 5), (Q, 5), (Q, 0)):
        assert leave(empty, state) == state
    assert leave(bare, (S, 5)) == (S, 11) and leave(bare, (Q, 5)) == (H, 0) and leave(bare, (Q, 7)) == (Q, 1) and leave(bare, (Q, 0)) == (H, 0)


def test_read_in_pieces(spark, tmp_path):
    texts = {"a.fq": grammar(3, 300), "b.fq": grammar(4, 300)}
    for name, text in texts.items():
        (tmp_path / name).write_bytes(text)
        (tmp_path / f"{name}.gz").write_bytes(blocks(text, 500))
    paths = [f"{tmp_path}/{n}{e}" for e in ("", ".gz") for n in texts]
    whole = {(i, k): r for i, t in enumerate([*texts.values()] * 2) for k, r in enumerate(records(io.BytesIO(t), "skip"))}
    df = read_fastx(spark, *paths, malformed="skip", split_bytes=1500)
    assert df.rdd.getNumPartitions() > 8
    assert {(r.file_id, r.rec_no): (r.name, r.comment, r.seq, r.qual) for r in df.collect()} == whole
    names = read_fastx(spark, *paths, columns=["name"], malformed="skip", split_bytes=1500)
    assert sorted(r.name for r in names.collect()) == sorted(r[0] for r in whole.values())
    assert kinds(spark, paths) == dict(zip(paths, ["plain", "plain", "blocks", "blocks"], strict=True))
    pieces = [(paths[0], "plain", at, min(at + 200, len(texts["a.fq"]))) for at in range(0, len(texts["a.fq"]), 200)]
    assert {s[0] for s in entries(spark, pieces)} == {H, S, Q}


def test_one_gzip_of_blocks_is_many_tasks(spark, tmp_path):
    rows = [f"line {i} é" for i in range(3000)]
    raw = "\n".join(rows).encode()
    for name in ("x.gz", "x"):
        (tmp_path / name).write_bytes(blocks(raw, 700))
        df = text_lines(spark, f"{tmp_path}/{name}", split_bytes=2000)
        assert df.rdd.getNumPartitions() > 3 and [r.value for r in df.collect()] == rows


def test_damage_is_told(tmp_path):
    raw = bytearray(blocks(b"@a\nAC\n+\nII\n" * 50, 100))
    raw[-40] ^= 1
    (tmp_path / "x").write_bytes(bytes(raw))
    with pytest.raises((ValueError, zlib.error)), Piece(f"{tmp_path}/x", "blocks", 0, len(raw)) as piece:
        list(piece.lines())


def test_a_piece_is_summed_up_block_by_block(spark, tmp_path, monkeypatch):
    """No more than a block of lines is looked at together, and the states are the same."""
    text = "".join(f"@r{i}\n{'ACG' * (i % 5)}\nT\n+\n{'@>+' * (i % 5)}\nI\n" for i in range(400)).encode()
    path = tmp_path / "a.fq"
    path.write_bytes(text)
    cut = [(f"file://{path}", "plain", at, min(at + 3000, len(text))) for at in range(0, len(text), 3000)]
    want, state = [], (0, 0)
    for piece in cut:
        want.append(state)
        with pieces.Piece(*piece) as lines:
            state = pieces.leave(pieces.summary(lines.blocks()), state)
    with pieces.Piece(f"file://{path}", "plain", 0, len(text)) as lines:
        monkeypatch.setattr(pieces, "_AT_ONCE", 500)
        blocks = list(lines.blocks())
    assert len(blocks) > 10
    state = (0, 0)
    for body in blocks:
        state = pieces.leave(pieces.summary(iter([body])), state)
    assert state == (0, 0)
    assert pieces.entries(spark, cut) == want


def test_small_pieces_share_tasks(spark, tmp_path):
    """Tasks grow with bytes, not with pieces, and none is sent the list of all pieces."""
    (tmp_path / "a.fq").write_text("".join(f"@r{i}\nACGT\n+\n@>+I\n" for i in range(3000)))
    for layout in ("four_line", "any"):
        rows = fastx.read_fastx(spark, f"file://{tmp_path}/a.fq", columns=["rec_no", "name"], layout=layout, split_bytes=100)
        assert rows.rdd.getNumPartitions() <= 4 * spark.sparkContext.defaultParallelism + 1
        assert sorted(map(tuple, rows.collect())) == [(i, f"r{i}") for i in range(3000)]
    options = {"pieces": fastx.packed(fastx.pieces_of(spark, [f"file://{tmp_path}/a.fq"], "any", 100), 100), "at_once": "4000", "paths": "[]"}
    reader = fastx.FastxReader(fastx.SCHEMA, options)
    assert len(pickle.dumps(reader)) < 2000 < len(options["pieces"])
    assert 9 <= len(reader.partitions()) < 20
