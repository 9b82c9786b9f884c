import random
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

from seqframe.llm import token_store as ts
from seqframe.llm.queries import tokenizer_path

PATH = tokenizer_path("word_bpe_49k.json")
PARTS = [" ", "  ", "\n", "\t", "a", "The", "'s", "'S", "!", "?!'s", "é", "à ", "E", "́", "ß", " ", "中文", "😀", "\x1c", "12", "<|endoftext|>", "<|endof", "Σ", "ΑΣ", "İ", ",", "don't", "—!", "x" * 90, "Å", "<", "|", ">"]


def test_same_ids_as_the_library():
    library = Tokenizer.from_file(PATH)
    with open(PATH, encoding="utf-8") as f:
        own = ts.WordEncoder(f.read())
    rng = random.Random(3)
    for _ in range(8000):
        text = "".join(rng.choice(PARTS) for _ in range(rng.randint(0, 9)))
        assert np.frombuffer(own.encode(text), "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, text


def test_crc_of_pieces():
    rng = random.Random(4)
    groups = [[rng.randbytes(rng.choice([1, 4, 90, 3000])) for _ in range(rng.randint(1, 6))] for _ in range(60)]
    pieces = [p for g in groups for p in g]
    starts = np.cumsum([0] + [len(g) for g in groups[:-1]])
    found = ts.join_crcs(np.array([zlib.crc32(p) for p in pieces]), np.array([len(p) for p in pieces]), starts)
    assert found.tolist() == [zlib.crc32(b"".join(g)) for g in groups]


def test_merkle_stream():
    for n in range(1, 40):
        keys = [bytes([i]) for i in range(n)]
        stream = ts.MerkleStream()
        for k in keys:
            stream.add(k)
        assert stream.root() == ts.merkle(keys)


def test_chunks_move_with_their_text():
    rng = np.random.default_rng(1)
    passage = rng.integers(0, 49000, 9000).astype("<u4")
    keys = []
    for lead in (0, 333):
        ids = np.concatenate([rng.integers(0, 49000, lead).astype("<u4"), passage])
        ends = ts.cut(np.flatnonzero(ts.boundaries(ids)) + 1, len(ids))
        assert ends[-1] == len(ids) and all(ts.LEAST <= j - i <= ts.MOST for i, j in zip([0, *ends], ends[:-1], strict=False))
        keys.append({ts.pack(ids[i:j]) for i, j in zip([0, *ends], ends, strict=False)})
    assert len(keys[0] & keys[1]) > len(keys[0]) // 2


def test_store(spark, tmp_path):
    library = Tokenizer.from_file(PATH)
    long = " ".join(str(i * 7919 % 10007) for i in range(30000))
    texts = {7: None, 3: "", 5: long, 6: long + " tail", 1: "One two.", 2: "One two.", -4: "ÀB  c"}
    docs = spark.createDataFrame([(k, t, 9, "x") for k, t in texts.items()], "doc_id long, text string, start int, key string").repartition(3)
    path = ts.write_store(docs, PATH, 2, f"file://{tmp_path}/store")
    rows = {r.doc_id: r for r in ts.read_digests(spark, path).collect()}
    ids = {r.doc_id: r.ids for r in ts.read_documents(spark, path).collect()}
    start = 0
    for k in sorted(texts):
        want = library.encode(texts[k] or "", add_special_tokens=False).ids + [2]
        assert ids[k] == want
        assert (rows[k].start, rows[k].n_tokens, rows[k].ids_crc32) == (start, len(want), zlib.crc32(np.array(want, "<u4").tobytes()))
        start += len(want)
    chunks = spark.read.parquet(f"{path}/objects").filter("kind = 'chunk'")
    assert chunks.count() == chunks.select("key").distinct().count()
    ts.verify(spark, path)
    empty = ts.write_store(docs.limit(0), PATH, 2, f"file://{tmp_path}/none")
    assert ts.read_digests(spark, empty).count() == 0


def test_damage_is_found(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a b c"), (2, "d e f")], "doc_id long, text string")
    path = ts.write_store(docs, PATH, 2, f"file://{tmp_path}/store")
    for p in (tmp_path / "store/objects/kind=chunk").rglob("*.parquet"):
        p.unlink()
    with pytest.raises(Exception, match="can't be rebuilt"):
        ts.read_digests(spark, path).collect()


def test_lost_files_are_found(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"text {i} of many") for i in range(60)], "doc_id long, text string").repartition(4)
    for n, spoil in enumerate(("last", "first", "rows")):
        path = ts.write_store(docs, PATH, 2, f"file://{tmp_path}/store{n}")
        ts.verify(spark, path)
        folder = tmp_path / f"store{n}/recipes"
        files = sorted(folder.glob("*.parquet"))
        if spoil == "rows":  # a file that lost a document, but kept its root
            table = pq.read_table(files[0])
            pq.write_table(table.slice(1), files[0])
            for crc in folder.glob(".*.crc"):
                crc.unlink()
        else:
            files[0 if spoil == "first" else -1].unlink()
        with pytest.raises(ValueError, match="recipes"):
            ts.read_digests(spark, path)


def test_repeated_and_null_ids(spark, tmp_path):
    library = Tokenizer.from_file(PATH)
    texts = [(None, "zz"), (3, "a b"), (3, "c"), (3, "a b"), (None, "zz"), (2, "q " * 3000)]
    docs = spark.createDataFrame([(*t, 1, "x") for t in texts], "doc_id long, text string, n int, kind string").repartition(3)
    path = ts.write_store(docs, PATH, 2, f"file://{tmp_path}/store")
    rows = sorted(ts.read_digests(spark, path).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in rows] == [None, None, 2, 3, 3, 3]
    sizes = [len(library.encode(t, add_special_tokens=False).ids) + 1 for _, t in texts]
    assert sorted(r.n_tokens for r in rows) == sorted(sizes)
    assert [r.start for r in rows] == [sum(r.n_tokens for r in rows[:i]) for i in range(len(rows))]
    assert len({r.ids_crc32 for r in rows}) == 4
