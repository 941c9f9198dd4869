"""Splitting oversized code chunks at natural boundaries.

Lines (and the parts of overlong lines) are units. The least number of pieces is
computed from both limits, equal-length targets are laid over the text, each target
moves to the strongest boundary near it, and a piece is added while any piece with
its overlap breaks a limit. Pieces are exact substrings: without their overlaps they
join to the original text.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from quarrylens.operators.records import canonical_id

MAX_LINES = 180
MAX_CHARS = 12_000
OVERLAP_LINES = 5
#: Share of a target length within which a cut may move to a stronger boundary.
SNAP = 0.3


class Piece(NamedTuple):
    start: int
    """First character, overlap included."""
    end: int
    first_line: int
    """First line counted from 0, overlap included."""
    last_line: int
    overlap_lines: int


_LINE = re.compile(r"[^\n]*\n|[^\n]+")
_OPENS = re.compile(r"^(?:@|/\*\*|//|export\b|import\b|package\b|public\b|private\b|protected\b|static\b|abstract\b|async\b|class\b|"
                    r"interface\b|enum\b|record\b|function\b|const\b|let\b|var\b|type\b|declare\b)")
_WEAK_END = re.compile(r"(?:[,(\[=+&|?:.]|=>)$")
_IN_LINE = ((";", 3), ("}", 3), (",", 2), (" ", 1))


def _units(text: str, max_chars: int) -> list[tuple[int, int, int, bool]]:
    """(start, end, line, ends a line) of each line, overlong lines cut into parts."""
    part = max(1, max_chars // 3)
    units = []
    for number, m in enumerate(_LINE.finditer(text)):
        a, b = m.span()
        if b - a <= max_chars:
            units.append((a, b, number, True))
            continue
        pieces = -(-(b - a) // part)
        while True:
            cuts, at, ok = [], a, True
            for i in range(1, pieces):
                target = a + (b - a) * i // pieces
                reach = max(1, (b - a) // pieces // 3)
                low, high = max(at + 1, target - reach), min(b - 1, target + reach)
                best = (0, 0, target)
                for sign, weight in _IN_LINE:
                    left = text.rfind(sign, low, target) + 1
                    right = text.find(sign, target, high) + 1
                    for c in (left, right):
                        if c and low <= c <= high:
                            best = max(best, (weight, -abs(c - target), c))
                cut = max(at + 1, best[2])
                cuts.append(cut)
                ok &= cut - at <= part
                at = cut
            if ok and b - at <= part or pieces >= b - a:
                break
            pieces += 1
        edges = [a, *cuts, b]
        units += [(x, y, number, y == b) for x, y in zip(edges, edges[1:])]
    return units


def _strengths(text: str, units: list[tuple[int, int, int, bool]]) -> list[float]:
    """Strength of the boundary before each unit; the first is unused."""
    lines = [text[a:b].strip() for a, b, _, _ in units]
    indents = []
    for a, b, _, _ in units:
        raw = text[a:b]
        indents.append(len(raw.replace("\t", "    ")) - len(raw.replace("\t", "    ").lstrip()) if raw.strip() else -1)
    following = [0] * len(units)
    nearest = 0
    for i in range(len(units) - 1, -1, -1):
        if indents[i] >= 0:
            nearest = indents[i]
        following[i] = nearest
    out = [0.0] * len(units)
    for i in range(1, len(units)):
        if not units[i - 1][3]:
            out[i] = -20.0
            continue
        before, after = lines[i - 1], lines[i]
        score = 8.0 - min(following[i] / 4, 8)
        if not before:
            score += 4
        elif before.endswith("}") or before.endswith("};"):
            score += 2
        elif before.endswith(";"):
            score += 1
        elif _WEAK_END.search(before) or before.startswith(("@", "*", "/*")):
            score -= 4
        if _OPENS.match(after):
            score += 2
        if after.startswith(("}", ")", "]", "*", "else", "catch", ".")) or not after:
            score -= 3
        out[i] = score
    return out


def split_text(text: str | None, max_lines: int = MAX_LINES, max_chars: int = MAX_CHARS, overlap: int = OVERLAP_LINES) -> list[Piece]:
    """Pieces of a text; none for null or empty, one if no limit is exceeded.

    Every piece has at most `max_lines` lines and `max_chars` characters with its
    overlap. The overlap is `overlap` whole lines before the cut; it is shorter
    where those lines alone would fill half a piece or leave no room for the next
    line, and nothing is repeated before a cut inside a line that is itself over
    `max_chars`. Lines end in LF or CRLF.
    """
    if max_lines < 2 or max_chars < 3 or overlap < 0 or overlap >= max_lines:
        raise ValueError("limits must leave room for the overlap")
    if not text:
        return []
    n_lines = text.count("\n") + (not text.endswith("\n"))
    if n_lines <= max_lines and len(text) <= max_chars:
        return [Piece(0, len(text), 0, n_lines - 1, 0)]
    units = _units(text, max_chars)
    n = len(units)
    strengths = _strengths(text, units)
    starts = [u[0] for u in units]
    by_chars = len(text) / max_chars > n / max_lines
    position = starts if by_chars else list(range(n))
    total = len(text) if by_chars else n

    def begin(cut: int) -> int:
        """First unit of the piece after `cut`, its overlap included."""
        if cut == 0 or not units[cut - 1][3]:
            return cut
        first = cut
        while (first > 0 and cut - first < overlap and starts[cut] - starts[first - 1] <= max_chars // 2
               and units[cut][1] - starts[first - 1] <= max_chars):
            if not units[first - 1][3] or first - 1 > 0 and not units[first - 2][3]:
                break
            first -= 1
        return first

    def fits(cut: int, stop: int) -> bool:
        first = begin(cut)
        return units[stop - 1][1] - starts[first] <= max_chars and stop - first <= max_lines

    pieces = max(2, -(-len(text) // max_chars), -(-max(1, n - overlap) // max(1, max_lines - overlap)))
    while True:
        cuts = [0]
        for i in range(1, min(pieces, n)):
            target = total * i / pieces
            reach = max(1.0, total / pieces * SNAP)
            low = max(cuts[-1] + 1, bisect_left(position, target - reach))
            high = min(n - 1, bisect_left(position, target + reach))
            best = max(
                range(low, high + 1),
                key=lambda c: (strengths[c] - 6 * abs(position[c] - target) / reach, -c),
                default=min(n - 1, cuts[-1] + 1))
            if best > cuts[-1]:
                cuts.append(best)
        edges = [*cuts, n]
        if all(fits(a, b) for a, b in zip(edges, edges[1:])):
            break
        pieces += 1
        if pieces > n:
            # no balanced cut fits: every piece takes as much as it can hold
            edges = [0]
            while edges[-1] < n:
                stop = edges[-1] + 1
                while stop < n and fits(edges[-1], stop + 1):
                    stop += 1
                edges.append(stop)
            break
    out = []
    for a, b in zip(edges, edges[1:]):
        first = begin(a)
        out.append(Piece(starts[first], units[b - 1][1], units[first][2], units[b - 1][2], a - first))
    return out


def oversized(content: str, max_lines: int = MAX_LINES, max_chars: int = MAX_CHARS) -> Column:
    """Is the text in this column over a limit? A line end at the very end begins no line."""
    col = F.col(content)
    ends = F.length(col) - F.length(F.replace(col, F.lit("\n"), F.lit("")))
    lines = ends + F.when(col.endswith("\n"), 0).otherwise(1)
    return (F.length(col) > max_chars) | (lines > max_lines)


def split_chunks(chunks: DataFrame, max_lines: int = MAX_LINES, max_chars: int = MAX_CHARS, overlap: int = OVERLAP_LINES,
                 with_text: bool = True) -> DataFrame:
    """Pieces of the newest version of every oversized chunk.

    Columns: chunk_id, piece_no (from 1), n_pieces, start_line, end_line (in the
    file: the chunk's start_line, 1 where it is null, plus the line's place),
    overlap_lines, content (if `with_text`). Only oversized texts go to Python and
    only they are shuffled. Chunks with null text or id have no pieces; an empty
    input gives an empty result; other columns are ignored.
    """
    slim = chunks.select(
        canonical_id("id").alias("id"), F.coalesce("start_line", F.lit(1)).alias("start_line"),
        F.col("ingested_at").alias("at"), F.when(oversized("content", max_lines, max_chars), F.col("content")).alias("content"),
    ).filter(F.col("id").isNotNull())

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            pieces = []
            for text, line in zip(batch["content"], batch["start_line"]):
                rows = split_text(text, max_lines, max_chars, overlap) if isinstance(text, str) else []
                pieces.append([
                    {"piece_no": i, "start_line": int(line) + p.first_line, "end_line": int(line) + p.last_line,
                     "overlap_lines": p.overlap_lines, "content": text[p.start:p.end] if with_text else None}
                    for i, p in enumerate(rows, 1)])
            yield pd.DataFrame({"id": batch["id"], "at": batch["at"], "pieces": pieces})

    rows = slim.mapInPandas(
        cut,
        "id string, at timestamp_ntz, "
        "pieces array<struct<piece_no:int,start_line:int,end_line:int,overlap_lines:int,content:string>>")
    version = F.struct(F.coalesce("at", F.lit("0001-01-01").cast("timestamp_ntz")).alias("at"), "pieces")
    newest = rows.groupBy("id").agg(F.max(version).alias("v")).select(F.col("id").alias("chunk_id"), F.col("v.pieces").alias("pieces"))
    out = newest.filter(F.size("pieces") > 0).select("chunk_id", F.size("pieces").alias("n_pieces"), F.inline("pieces"))
    columns = ["chunk_id", "piece_no", "n_pieces", "start_line", "end_line", "overlap_lines"]
    return out.select(*columns, *(["content"] if with_text else []))
