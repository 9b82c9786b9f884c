import hashlib
import random

import pytest
from tokenizers import Tokenizer

from seqframe.llm import bpe
from seqframe.llm.queries import tokenizer_path

PATH = tokenizer_path("byte_bpe_50k.json")
PARTS = [" ", "  ", "\n", "\t", "a", "the", "'s", "'S", "'re", "!", "?!'s", "é", "à", "à ", "ß", " ", "　", "中文", "😀", "\x1c", "12", "<|endoftext|>", "<|endof", "\r\n", "x" * 300, "́", "İ", "Ġ", ",", "don't", "—!"]


@pytest.fixture(scope="module")
def pair():
    with open(PATH, encoding="utf-8") as f:
        return Tokenizer.from_file(PATH), bpe.BoundaryBPE(f.read())


def test_same_ids_as_the_library(pair):
    library, own = pair
    rng = random.Random(5)
    for _ in range(8000):
        text = "".join(rng.choice(PARTS) for _ in range(rng.randint(0, 9)))
        ids = library.encode(text, add_special_tokens=False).ids
        assert own.encode(text).tolist() == ids, text
        assert own.decode(ids) == library.decode(ids, skip_special_tokens=False) == text


def test_other_white_space_keeps_the_cuts(pair):
    library, own = pair
    blanks = [chr(x) for x in range(0x3001) if chr(x).isspace()] + ["\u180e", "\u200b", "\ufeff", "  ", " \n"]
    rng = random.Random(7)
    for _ in range(6000):
        text = "".join(rng.choice(blanks) if rng.random() < 0.5 else rng.choice(["a", "The", "1", "!", "é", "中", "'s", "x1-"]) for _ in range(rng.randint(1, 10)))
        assert own.encode(text).tolist() == library.encode(text, add_special_tokens=False).ids, text
    assert len(own.fragments("one two\tthree four five\u00a0 six seven")) > 4


def test_same_text_as_the_library_for_any_ids(pair):
    library, own = pair
    rng = random.Random(6)
    for _ in range(2000):
        ids = [rng.randrange(50257) for _ in range(6)]
        assert own.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_rows(spark, pair):
    library, _ = pair
    texts = [None, "", "a  b", "a  b", "zü\n\n über. " * 4000, "<|endoftext|>x"]
    docs = spark.createDataFrame([(i if i else None, t, 1, 2) for i, t in enumerate(texts)], "doc_id long, text string, n_tokens int, ids int")
    rows = bpe.round_trip(docs, PATH, columns=tuple(bpe.COLUMNS)).collect()
    for text, row in zip(texts, rows, strict=True):
        ids = library.encode(text or "", add_special_tokens=False).ids
        assert (row.n_tokens, row.ids, row.decoded) == (len(ids), ids, text or "")
        assert row.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()
    encoded = bpe.round_trip(docs, PATH, columns=("ids",))
    assert [r.decoded for r in bpe.decode(encoded, PATH).collect()] == [t or "" for t in texts]
    assert bpe.round_trip(docs.limit(0), PATH).count() == 0
