"""Reports as text. Inputs are a few rows; formatting follows C's and Python's `%`."""

from __future__ import annotations

import re
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import DataFrame


def box_table(rows: Sequence[Sequence[object]], title: str = "", info: str = "") -> str:
    """A box of centred cells, as wide as the widest cell of each column, with a title line and a footer if given."""
    cells = [["" if c is None else str(c) for c in r] for r in rows]
    n = max((len(r) for r in cells), default=0)
    cells = [r + [""] * (n - len(r)) for r in cells]
    widths = [max(len(r[j]) for r in cells) + 2 for j in range(n)]
    inner = sum(widths) + max(0, n - 1)
    rule = "+" + "+".join("-" * w for w in widths) + "+"
    out = []
    if title:
        inner = max(inner, 0)
        out += ["+" + "-" * inner + "+", "|" + title.center(inner) + "|"]
    out.append(rule)
    for r in cells:
        out += ["|" + "|".join(c.center(w) for c, w in zip(r, widths, strict=True)) + "|", rule]
    if info:
        out.append(info)
    return "\n".join(out)


def frame_table(df: DataFrame, title: str = "", most: int = 1000) -> str:
    """A box of a small DataFrame; one of more than `most` rows is an error."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a table of more than {most} rows")
    return box_table([df.columns, *rows], title)


def _percent(part: int, whole: int) -> str:
    return f"{100.0 * part / whole:.3f}" if whole else "-"


def read_stats_report(row) -> str:
    """One row of `read_stats` as text."""
    return box_table(
        [
            ["reads", f"{row.seqs_n:,}"],
            ["length", f"{row.min_l} - {row.max_l}"],
            ["reads with N", f"{row.reads_n_with_n:,} ({_percent(row.reads_n_with_n, row.seqs_n)} %)"],
            ["bases", f"{row.bases_all:,}"],
            ["N bases", f"{row.bases_n:,} ({_percent(row.bases_n, row.bases_all)} %)"],
            ["N in a read", f"{row.min_n} - {row.max_n}"],
        ],
        "Read statistics",
    )


def sam_summary_report(row, ref_len: int) -> str:
    """`sam_summary` and the reference length as `label: value` lines."""

    def mean(x: float | None) -> str:
        return "-" if x is None else "%.2f" % x

    # labels and their width are fixed values of the output format
    pairs = [
        ("Reference_length", ref_len),
        ("Alignments", row.alignments),
        ("Unmap", row.unmapped),
        ("Primary", row.primary_n),
        ("Supplementary", row.supplementary),
        ("Secondary", row.secondary),
        ("Alignment_Score", mean(row.mean_as)),
        ("Edit_distance", mean(row.mean_nm)),
    ]
    return "\n".join(f"{label + ':':<18}{value}" for label, value in pairs) + "\n"


def mapq_report(unmapped: int, rows: Sequence) -> str:
    """The unmapped count, then `mapq aligned correct` lines (256 at most)."""
    return "\n".join([str(unmapped), *(f"{r.mapq} {r.aligned} {r.correct}" for r in rows)]) + "\n"


def view_report(row) -> str:
    """One row of `sequence_view`."""
    return f"<{row.name}, {row.comment}> Length: {row.l_seq}\n{row.bases if row.in_bounds else 'out of range'}\n"


def put_markdown_table(path: str | Path, caption: str, table: Sequence[str]) -> None:
    """Replace the table after the line `caption` of a Markdown file, or append both."""
    file = Path(path)
    lines = file.read_text().splitlines() if file.exists() else []
    at = next((i for i, x in enumerate(lines) if x.strip() == caption), None)
    if at is None:
        lines += [*([""] if lines else []), caption, "", *table]
    else:
        first = next((i for i in range(at + 1, len(lines)) if lines[i].lstrip().startswith("|")), None)
        between = lines[at + 1 : first] if first is not None else []
        if first is None or any(x.strip() for x in between):
            lines[at + 1 : at + 1] = ["", *table]
        else:
            last = first
            while last < len(lines) and lines[last].lstrip().startswith("|"):
                last += 1
            lines[first:last] = table
    file.write_text("\n".join(lines) + "\n")


def markdown_lookup(path: str | Path, caption: str, column: str, key: str, key_column: str = "ID") -> str | None:
    """The cell of `column` in the first row, of the table after `caption`, whose `key_column` contains `key`."""
    lines = Path(path).read_text().splitlines() if Path(path).exists() else []
    at = next((i for i, x in enumerate(lines) if x.strip() == caption), None)
    rows = []
    for line in lines[at + 1 :] if at is not None else []:
        if line.lstrip().startswith("|"):
            rows.append([c.strip() for c in line.strip().strip("|").split("|")])
        elif rows:
            break
    if not rows or column not in rows[0] or key_column not in rows[0]:
        return None
    k, c = rows[0].index(key_column), rows[0].index(column)
    return next((r[c] for r in rows[1:] if len(r) > max(k, c) and key in r[k] and not re.fullmatch(r":?-+:?", r[k])), None)
