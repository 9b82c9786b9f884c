"""Operator 1: byte-level BPE encoding and decoding by forced-boundary splitting.

A merge can only ever build byte pairs that lie inside some vocabulary token.
Where two neighbouring bytes never do, no token can span them, so the text may
be cut there and the parts encoded apart; concatenated, they are the encoding.

Cuts must also be certain for the pre-tokenizer, which splits a text before any
merge. So a cut is made only between a visible character (no white space of any
other kind) and a following space or line feed, and between ASCII or Latin letters, digits and ASCII punctuation
other than the apostrophe, and only if the table built from the vocabulary has
no token with that pair of bytes inside. The tokenizers library encodes each
distinct fragment; a Python worker remembers the results.

Defined results: a null text counts as empty and gives no ids; equal texts give
equal rows; special tokens found in a text become their own ids, as in the
tokenizers library; texts of any length are encoded whole (a fragment without a
cut, such as a long run of one kind, is as long as it is); rows with null or equal
keys are rows of their own; other input columns are ignored, whatever their names;
an empty table gives none.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from seqframe.llm.common import slices, small_batches, worker_cache

#: Fragments that a Python worker remembers before it starts afresh (the last such set is kept beside it), and the longest of them.
REMEMBERED, LONGEST = 80_000, 120

#: Bytes of text encoded before their rows are sent on.
AT_ONCE = 1 << 20

#: Output columns of `round_trip` and their types.
COLUMNS = {
    "n_tokens": "long",
    "ids": "array<int>",
    "decoded": "string",
    "ids_sha256": "string",
    "decoded_sha256": "string",
}


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary: itself if visible Latin-1, else the next from U+0100 on."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(visible)]
    return [chr(b) if b in set(visible) else chr(0x100 + hidden.index(b)) for b in range(256)]


class BoundaryBPE:
    """Encoder and decoder of one byte-level BPE vocabulary given as a tokenizers JSON text."""

    def __init__(self, spec: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        described = json.loads(spec)
        model, pre = described["model"], described["pre_tokenizer"]
        if model["type"] != "BPE" or described["normalizer"] or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or not pre["use_regex"]:
            raise ValueError("only byte-level BPE without a normalizer or prefix space is supported")
        if any(x["single_word"] or x["lstrip"] or x["rstrip"] or x["normalized"] for x in described["added_tokens"]):
            raise ValueError("added tokens with stripping, word or normalizing rules aren't supported")
        byte_of = {s: b for b, s in enumerate(byte_symbols())}
        self.pieces: list[bytes] = [b""] * (1 + max([*model["vocab"].values(), *(x["id"] for x in described["added_tokens"])]))
        #: Whether two bytes stand together inside some token.
        self.together = np.zeros((256, 256), bool)
        for token, number in model["vocab"].items():
            self.pieces[number] = raw = bytes(map(byte_of.__getitem__, token))
            codes = np.frombuffer(raw, np.uint8)
            self.together[codes[:-1], codes[1:]] = True
        self.special = {x["content"]: x["id"] for x in described["added_tokens"]}
        for text, number in self.special.items():
            self.pieces[number] = text.encode()
        longest_first = sorted(self.special, key=len, reverse=True)
        self.specials = re.compile("(" + "|".join(map(re.escape, longest_first)) + ")") if longest_first else None
        self.library = Tokenizer.from_str(spec)
        self.library.no_truncation()
        self.library.no_padding()
        self.fragments = self._cutter()
        self.known: dict[str, tuple[bytes, str]] = {}
        self.older: dict[str, tuple[bytes, str]] = {}

    def _cutter(self) -> Callable[[str], list[str]]:
        letters = [chr(c) for c in [*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0xC0, 0x250)] if c not in (0xD7, 0xF7)]
        digits = [chr(c) for c in range(0x30, 0x3A)]
        marks = [chr(c) for c in range(0x21, 0x7F) if not chr(c).isalnum() and chr(c) != "'"]
        blanks = [" ", "\n"]

        def certain(before: list[str], after: list[str]) -> list[str]:
            """Those of `before` after which a cut is certain, whichever of `after` follows."""
            firsts = [x.encode()[0] for x in after]
            return [x for x in before if not self.together[x.encode()[-1], firsts].any()]

        a = "".join(certain(letters, [*digits, *marks, *blanks]))
        b = "".join(certain(digits, [*letters, *marks, *blanks]))
        c = "".join(map(re.escape, certain(marks, [*letters, *digits, *blanks])))
        # characters that end in a byte after which no cut before a blank is certain; a fragment goes on over that blank
        open_ends = [x for x in range(0x80, 0xC0) if self.together[x, [0x20, 0x0A]].any()]
        if self.together[np.ix_(range(0x21, 0x7F), [0x20, 0x0A])].any():
            return lambda text: [text]
        joined = "".join(chr(x) for x in range(0x80, 0x10000) if (x & 0x3F | 0x80) in open_ends and not 0xD800 <= x < 0xE000) + ("\U00010000-\U0010ffff" if open_ends else "")
        # white space of other kinds is one run with the blanks after it, which the pre-tokenizer splits by what follows, so there is no cut inside
        joined += "".join(re.escape(chr(x)) for x in range(0x3001) if re.match(r"[^\S \n]", chr(x))) + "\u180e\u200b-\u200d\ufeff"
        more = rf"(?:(?<=[{joined}])[ \n]+[^ \n]*)*"
        end = r"[ \n]|\Z"
        ways = [rf"[{own}]+(?={end}|[{others}])" for own, others in ((a, b + c), (c, a + b), (b, a + c)) if own]
        return re.compile(rf"[ \n]*(?:{'|'.join([*ways, rf'[^ {chr(92)}n]+{more}'])})|[ \n]+").findall

    def _learn(self, fragments: Iterable[str]) -> dict[str, tuple[bytes, str]]:
        """Encode fragments that aren't known; what was known long ago is known again."""
        new = set(fragments)
        found = {f: self.older[f] for f in new if f in self.older}
        unseen = [f for f in new if f not in found]
        for f, e in zip(unseen, self.library.encode_batch_fast(unseen, add_special_tokens=False), strict=True):
            ids = e.ids
            found[f] = np.array(ids, "<u4").tobytes(), ",".join(map(str, ids))
        if len(self.known) > REMEMBERED:
            self.older, self.known = self.known, {}
        self.known.update((f, x) for f, x in found.items() if len(f) <= LONGEST)
        return found

    def _plain(self, text: str) -> list[tuple[bytes, str]]:
        """Encoded fragments of a text without special tokens, each as bytes of ids and as decimal text."""
        if not text:
            return []
        fragments = self.fragments(text)
        entries = list(map(self.known.get, fragments))
        if None in entries:
            found = self._learn([f for f, x in zip(fragments, entries, strict=True) if x is None])
            entries = [x or found[f] for f, x in zip(fragments, entries, strict=True)]
        return entries

    def parts_of(self, text: str | None) -> list[tuple[bytes, str]]:
        if not text:
            return []
        if self.specials is None or not any(s in text for s in self.special):
            return self._plain(text)
        out: list[tuple[bytes, str]] = []
        for piece in self.specials.split(text):
            if piece in self.special:
                out.append((np.array([self.special[piece]], "<u4").tobytes(), str(self.special[piece])))
            else:
                out += self._plain(piece)
        return out

    def encode(self, text: str | None) -> np.ndarray:
        return np.frombuffer(b"".join(p[0] for p in self.parts_of(text)), "<u4")

    def decode_bytes(self, ids: Iterable[int]) -> bytes:
        """The UTF-8 text of `ids`; bytes that form no character become U+FFFD. Ids outside the vocabulary give nothing."""
        pieces = self.pieces
        try:
            raw = b"".join([pieces[i] for i in ids])
        except IndexError:
            raw = b"".join(pieces[i] for i in ids if 0 <= i < len(pieces))
        try:
            raw.decode()
            return raw
        except UnicodeDecodeError:
            return raw.decode("utf-8", "replace").encode()

    def decode(self, ids: Iterable[int]) -> str:
        return self.decode_bytes(ids).decode()


def _codec(spec: str) -> BoundaryBPE:
    """One codec, with what it remembers, for all tasks of a Python worker."""
    key, made = hashlib.blake2b(spec.encode(), digest_size=16).digest(), worker_cache("bpe")
    if key not in made:
        made.clear()
        made[key] = BoundaryBPE(spec)
    return made[key]


def round_trip(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", columns: tuple[str, ...] = ("n_tokens", "ids", "decoded")) -> DataFrame:
    """Encode each whole text, decode its ids again, and return `key` with the asked `COLUMNS`; one pass, no shuffle.

    `tokenizer` is the path of a tokenizers JSON file that the driver can read; its text (a few MB, the size of one vocabulary) is broadcast.
    """
    with open(tokenizer, encoding="utf-8") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, made = _codec(shared.value), None
        types = {"n_tokens": pa.int64(), "ids": pa.list_(pa.int32()), "decoded": pa.string(), "ids_sha256": pa.string(), "decoded_sha256": pa.string()}
        for batch in slices(batches, 1, AT_ONCE):
            made = {c: [] for c in columns}
            for value in batch.column(1):
                parts = codec.parts_of(value.as_py())
                raw = b"".join([p[0] for p in parts])
                ids = np.frombuffer(raw, "<u4")
                if "n_tokens" in made:
                    made["n_tokens"].append(len(ids))
                if "ids" in made:
                    made["ids"].append(ids.astype(np.int32))
                if "ids_sha256" in made:
                    made["ids_sha256"].append(hashlib.sha256(",".join([p[1] for p in parts]).encode()).hexdigest())
                if "decoded" in made or "decoded_sha256" in made:
                    decoded = codec.decode_bytes(ids.tolist())
                    if "decoded" in made:
                        made["decoded"].append(decoded.decode())
                    if "decoded_sha256" in made:
                        made["decoded_sha256"].append(hashlib.sha256(decoded).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(made[c], types[c]) for c in columns)], [key, *columns])

    kind = docs.schema[key].dataType.simpleString()
    return small_batches(docs).select(key, text).mapInArrow(work, f"`{key}` {kind}, " + ", ".join(f"{c} {COLUMNS[c]}" for c in columns))


def decode(encoded: DataFrame, tokenizer: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """`key` and the text of each row's ids (null ids: empty text)."""
    with open(tokenizer, encoding="utf-8") as f:
        shared = encoded.sparkSession.sparkContext.broadcast(f.read())

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared.value)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([codec.decode(x.as_py() or ()) for x in batch.column(1)], pa.string())], [key, "decoded"])

    return small_batches(encoded).select(key, ids).mapInArrow(work, f"`{key}` {encoded.schema[key].dataType.simpleString()}, decoded string")
