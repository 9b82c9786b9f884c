"""Operator 8: fuzzy line deduplication by MinHash.

A line is compared by its normal form: white space squeezed, lower case. Equal
normal forms are one line, named by a 128-bit hash. Every other likeness goes
through character shingles (`SHINGLE` characters; a shorter line is one shingle).
A changed word touches too many of these in a line that isn't long, so two lines
of `SHINGLE` to `SHORT` characters are also alike if their finer shingles (`FINE`
characters) say so; longer ones are not, as long lines of the same words in
another order share most of those.

The steps are those of `alike`:

1. One pass over the documents makes a one-permutation MinHash signature of each
   line that a task hasn't seen yet (bins that stay empty borrow from the next),
   and from it `BANDS` band keys of `ROWS` values. At a Jaccard similarity of 0.8
   two lines share a key with a probability of 0.99, at 0.9 of 0.99999. Lines of up
   to `SHORT` characters have a second signature, of the finer shingles.
2. Lines that share a key meet in the group of the smallest line name under that
   key; keys go to the tasks that match them packed, by buckets. The texts of such lines, and only those, are fetched by a second pass: a
   bitmap of their names, of bounded size, tells which lines to send.
3. In a group, a breadth-first search by exact Jaccard similarity (`LEAST` or
   more) over lines not yet reached gives a spanning forest, never all pairs. A
   group of more than `BLOCK_CHARS` characters is dealt to several tasks, one for
   each pair of its blocks, so that no pair is left out.
4. Distributed union-find joins the links; of each component the first line, by
   doc_id and place, stays, and all its other occurrences go.

Defined results: blank lines are never duplicates; a null text has no lines and
stays null, an empty one stays empty; a text may lose all its lines and is then
empty (or goes, with `drop_emptied`); a null doc_id counts as the first; rows with
an equal doc_id are rows of their own, in the order of a hash of their texts, but
repeated rows (equal in doc_id and text) stay or go together, line by line; other
columns are ignored or, in `deduplicate`, kept, whatever their names; an empty
table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqframe.llm.alike import BLOCK_CHARS, Kind, fine_set, fine_shingles, links, shingle_set, shingles, signed
from seqframe.llm.common import fresh_name, give_back, small_batches, with_facts, worker_cache
from seqframe.llm.components import components


def cut_lines(text: str) -> list[str]:
    return text.split("\n")


LINES = Kind(cut_lines, shingles, shingle_set, fine_shingles, fine_set)


def decide(docs: DataFrame, key: str = "doc_id", text: str = "text", block_chars: int = BLOCK_CHARS) -> tuple[DataFrame, DataFrame]:
    """The rows of `docs` by identity (doc_id, h1, h2) with their lines' `names` (null for blank lines), and `kept`, the places of the non-blank lines that stay, for each identity that has any."""
    signatures = signed(docs, LINES, key, text)
    alike = components(links(docs, signatures, LINES, text, block_chars), "lines")
    places = signatures.select("doc_id", "h1", "h2", F.posexplode("names").alias("place", "line")).filter("line is not null")
    first = places.groupBy("line").agg(F.min(F.struct("doc_id", "h1", "h2", "place")).alias("at"))
    named = first.join(alike, first.line == alike.node, "left").select(F.coalesce("component", "line").alias("component"), "at")
    stays = named.groupBy("component").agg(F.min("at").alias("at")).select("at.*")
    return signatures.drop("fresh", "heavy", "keys"), stays.groupBy("doc_id", "h1", "h2").agg(F.collect_list("place").alias("kept"))


def report(decided: tuple[DataFrame, DataFrame]) -> DataFrame:
    """`doc_id`, `n_lines` (not blank), `n_dropped` and `dropped`, the places (from 0) of the lines that go, ascending."""
    rows, kept = decided
    lines = F.filter(F.transform("names", lambda x, i: F.when(x.isNotNull(), i)), lambda i: i.isNotNull())
    rows = rows.select("doc_id", "h1", "h2", lines.alias("lines"))
    other = kept.withColumnsRenamed({"doc_id": "_d", "h1": "_h1", "h2": "_h2"})
    rows = rows.join(other, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("h1") == F.col("_h1")) & (F.col("h2") == F.col("_h2")), "left")
    dropped = F.when(F.col("kept").isNull(), F.col("lines")).otherwise(F.array_except("lines", "kept"))
    return rows.select("doc_id", F.size("lines").alias("n_lines"), F.size(dropped).alias("n_dropped"), dropped.alias("dropped"))


def deduplicate(docs: DataFrame, key: str = "doc_id", text: str = "text", block_chars: int = BLOCK_CHARS, drop_emptied: bool = False) -> DataFrame:
    """`docs` with all its columns, each text without the lines that go; with `drop_emptied`, without the rows that lose all the lines they had."""
    at, last = docs.columns.index(text), len(docs.columns)
    joined = with_facts(docs, decide(docs, key, text, block_chars)[1], key, text, "left")
    joined = joined.select("row.*", F.col("kept").alias(fresh_name("kept", docs.columns)))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_cache("lines")
        for batch in batches:
            out, stay = [], []
            for value, kept in zip(batch.column(at).to_pylist(), batch.column(last), strict=True):
                emptied = False
                if value:
                    places = set(kept.values.to_pylist()) if kept.is_valid else ()
                    lines = value.split("\n")
                    left = [x for i, x in enumerate(lines) if i in places or not x.strip()]
                    if len(left) < len(lines):
                        emptied = not places
                        value = "\n".join(left)
                out.append(value)
                stay.append(not (emptied and drop_emptied))
            columns = [batch.column(i) for i in range(last)]
            columns[at] = pa.array(out, batch.schema.field(at).type)
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names[:last]).filter(pa.array(stay, pa.bool_()))
        give_back()

    return small_batches(joined).mapInArrow(work, docs.schema)
