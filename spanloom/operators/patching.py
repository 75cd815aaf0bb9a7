"""Cleaned-up differences, fuzzy location of patterns, and patches; all on code points."""

from __future__ import annotations

import re
import urllib.parse
from dataclasses import dataclass, replace

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .alignment import DIFF_TYPE, Script, diff, merge

# The longest pattern, the context of a hunk, the cost of an edit, and what a fuzzy match may differ.
PATTERN = 32
MARGIN = 4
EDIT_COST = 4
MATCH_THRESHOLD = 0.5
MATCH_DISTANCE = 1000
DELETE_THRESHOLD = 0.5
#: Characters that a patch text keeps as they are.
PATCH_SAFE = "-_.!~*'();/?:@&=+$,# "

Gap = tuple[str, str, str]


def _gaps(script: Script) -> list[Gap]:
    """The script as (equal, deleted, inserted) triples; the last one is what is equal at the end."""
    out, same, gone, new = [], "", "", ""
    for op, t in script:
        if op == "EQUAL":
            if gone or new:
                out.append((same, gone, new))
                same, gone, new = "", "", ""
            same += t
        elif op == "DELETE":
            gone += t
        else:
            new += t
    return [*out, (same, gone, new), ("", "", "")] if gone or new else [*out, (same, "", "")]


def _script(gaps: list[Gap]) -> Script:
    return [(op, t) for g in gaps for op, t in zip(("EQUAL", "DELETE", "INSERT"), g) if t]


def _join(script: Script, drop) -> Script:
    """Join two gaps wherever ``drop(left gap, what is equal between them, right gap)`` says so, until it never does."""
    *gaps, tail = _gaps(script)
    done: list[Gap] = []
    for g in gaps:
        while done and drop(done[-1], g[0], g):
            same, gone, new = done.pop()
            g = (same, gone + g[0] + g[1], new + g[0] + g[2])
        done.append(g)
    return _script([*done, tail])


def _overlap(a: str, b: str) -> int:
    """The longest end of ``a`` that ``b`` starts with."""
    return next((n for n in range(min(len(a), len(b)), 0, -1) if a[-n:] == b[:n]), 0)


def _boundary(left: str, right: str) -> int:
    """How natural it is to cut between the two: 6 at an end of the text, 5 blank line, 4 line break, 3 end of a sentence, 2 blank, 1 punctuation, 0 within a word."""
    if not left or not right:
        return 6
    if re.search(r"\n\r?\n\Z", left) or re.match(r"\r?\n\r?\n", right):
        return 5
    x, y = left[-1], right[0]
    if x in "\r\n" or y in "\r\n":
        return 4
    if not x.isalnum() and not x.isspace() and y.isspace():
        return 3
    if x.isspace() or y.isspace():
        return 2
    return int(not (x.isalnum() and y.isalnum()))


def slide(script: Script) -> Script:
    """Move lone edits between two equal pieces to the most natural place; of equally natural ones the last."""
    gaps = _gaps(script)
    for i in range(len(gaps) - 1):
        same, gone, new = gaps[i]
        after = gaps[i + 1][0]
        if bool(gone) == bool(new) or not same or not after:
            continue
        edit = gone or new
        whole, n = same + edit + after, len(edit)
        low = high = len(same)
        while low and whole[low - 1] == whole[low + n - 1]:
            low -= 1
        while high + n < len(whole) and whole[high] == whole[high + n]:
            high += 1
        at = max(range(low, high + 1), key=lambda p: (_boundary(whole[:p], whole[p : p + n]) + _boundary(whole[p : p + n], whole[p + n :]), p))
        moved = whole[at : at + n]
        gaps[i] = (whole[:at], moved if gone else "", "" if gone else moved)
        gaps[i + 1] = (whole[at + n :], *gaps[i + 1][1:])
    return merge(_script(gaps))


def clean_semantic(script: Script) -> Script:
    """Drop equal pieces no longer than the edits on each side, slide edits, and free overlaps of at least half an edit."""

    def drop(a: Gap, same: str, b: Gap) -> bool:
        return 0 < len(same) <= min(max(len(a[1]), len(a[2])), max(len(b[1]), len(b[2])))

    out: Script = []
    for same, gone, new in _gaps(slide(merge(_join(script, drop)))):
        n, m = _overlap(gone, new), _overlap(new, gone)
        half = min(len(gone), len(new)) / 2
        out += [("EQUAL", same)] if same else []
        if gone and new and max(n, m) >= half and max(n, m):
            pieces = [("DELETE", gone[: len(gone) - n]), ("EQUAL", new[:n]), ("INSERT", new[n:])] if n >= m else [("INSERT", new[: len(new) - m]), ("EQUAL", gone[:m]), ("DELETE", gone[m:])]
            out += [p for p in pieces if p[1]]
        else:
            out += _script([("", gone, new)])
    return out


def clean_efficiency(script: Script, cost: int = EDIT_COST) -> Script:
    """Drop equal pieces that cost more than they save: below ``cost`` between two full edits, below half of it next to one."""

    def drop(a: Gap, same: str, b: Gap) -> bool:
        edits = sum(map(bool, (*a[1:], *b[1:])))
        return 0 < len(same) < cost and (edits == 4 or (edits == 3 and len(same) < cost / 2))

    return merge(_join(script, drop))


def locate(text: str, pattern: str, near: int, threshold: float = MATCH_THRESHOLD, distance: int = MATCH_DISTANCE) -> int:
    """Where ``pattern`` fits best around ``near``, or -1.

    The score of a place is errors / pattern length + distance from ``near`` / ``distance``; errors are the least
    insertions, deletions and substitutions. The best score of at most ``threshold`` wins, of equal scores the first place.
    """
    if text is None or pattern is None:
        raise ValueError("a text is null")
    if len(pattern) > PATTERN:
        raise ValueError("the pattern is too long")
    near = max(0, min(near, len(text)))
    if text.startswith(pattern, near):
        return near
    if text == pattern:
        return 0
    if not text:
        return -1
    reach = int(threshold * distance) if distance else 0
    low, high = max(0, near - reach), min(len(text), near + reach + 1)
    m = len(pattern)
    # errors[j]: least errors of matching pattern[m - j:] at the current place, free where it ends
    errors, best, found = list(range(m + 1)), threshold, -1
    for at in range(min(len(text), high + 2 * m) - 1, low - 1, -1):
        last, row = errors, [0] * (m + 1)
        for j in range(1, m + 1):
            row[j] = min(last[j - 1] + (text[at] != pattern[m - j]), last[j] + 1, row[j - 1] + 1)
        errors = row
        if at < high:
            away = abs(near - at)
            score = row[m] / m + (away / distance if distance else float(away > 0))
            if score <= best:
                best, found = score, at
    return found


@dataclass(frozen=True)
class Hunk:
    """A stretch of a patch: where it starts in both texts and the script there, context included."""

    start1: int
    start2: int
    script: tuple[tuple[str, str], ...]

    @property
    def source(self) -> str:
        return "".join(t for op, t in self.script if op != "INSERT")

    @property
    def target(self) -> str:
        return "".join(t for op, t in self.script if op != "DELETE")


def make_patch(a: str, b: str | None = None, script: Script | None = None) -> list[Hunk]:
    """Hunks from ``a`` to ``b``, or for a given script; each is placed in the text as the hunks before it leave it.

    Edits with fewer than two margins between them share a hunk. Its context grows by margins until what it looks for is
    unique or as long as a pattern may be, and then by one more.
    """
    if script is None:
        script = diff(a, b)
        if len(script) > 2:
            script = clean_efficiency(clean_semantic(script))
    *gaps, _ = _gaps(script)
    b = "".join(t for op, t in script if op != "DELETE")
    runs: list[list] = []
    p = q = 0
    for same, gone, new in gaps:
        p, q = p + len(same), q + len(same)
        piece = _script([("", gone, new)])
        if runs and len(same) < 2 * MARGIN:
            runs[-1][2] += [("EQUAL", same), *piece] if same else piece
        else:
            runs.append([p, q, list(piece)])
        p, q = p + len(gone), q + len(new)
    out = []
    for p, q, piece in runs:
        before = b[:q] + a[p:]
        n = sum(len(t) for op, t in piece if op != "INSERT")
        width = 0
        while before and n + 2 * width < PATTERN - 2 * MARGIN:
            sought = before[max(0, q - width) : q + n + width]
            if before.find(sought) == before.rfind(sought):
                break
            width += MARGIN
        width += MARGIN
        head, tail = before[max(0, q - width) : q], before[q + n : q + n + width]
        out.append(Hunk(q - len(head), q - len(head), (*([("EQUAL", head)] if head else []), *piece, *([("EQUAL", tail)] if tail else []))))
    return out


def _bites(h: Hunk) -> list[Hunk]:
    """The hunk in pieces whose source fits a pattern, each with what precedes and follows it as context; a long deletion stays whole."""
    if len(h.source) <= PATTERN:
        return [h]
    room = PATTERN - 2 * MARGIN
    parts: list[list] = [[]]
    for op, t in h.script:
        while t:
            used = sum(len(x) for o, x in parts[-1] if o != "INSERT")
            if op == "INSERT" or (op == "DELETE" and len(t) > 2 * PATTERN):
                parts[-1].append((op, t))
                break
            if used >= room:
                parts.append([])
                continue
            parts[-1].append((op, t[: room - used]))
            t = t[room - used :]
    out, p, q = [], 0, 0
    source, target = h.source, h.target
    for part in parts:
        n, m = (sum(len(t) for op, t in part if op != skip) for skip in ("INSERT", "DELETE"))
        if any(op != "EQUAL" for op, _ in part):
            head, tail = target[max(0, q - MARGIN) : q], source[p + n : p + n + MARGIN]
            at = h.start2 + q - len(head)
            out.append(Hunk(at, at, tuple(merge([("EQUAL", head), *part, ("EQUAL", tail)]))))
        p, q = p + n, q + m
    return out


def _index(script: Script, at: int) -> int:
    """Where a place of the source text lies in the target text; a deleted one is where the deletion was."""
    p = q = 0
    for op, t in script:
        if op == "EQUAL":
            if at < p + len(t):
                return q + at - p
            p, q = p + len(t), q + len(t)
        elif op == "DELETE":
            if at < p + len(t):
                return q
            p += len(t)
        else:
            q += len(t)
    return q + at - p


def apply_patch(hunks: list[Hunk], text: str) -> tuple[str, list[bool]]:
    """The patched text, and for each hunk (long ones count by their pieces) whether it found its place."""
    pad = "".join(map(chr, range(1, MARGIN + 1)))
    text, moved, done = pad + text + pad, 0, []
    hunks = [_padded(h, pad, i == 0, i == len(hunks) - 1) for i, h in enumerate(hunks)]
    for h in [x for h in hunks for x in _bites(h)]:
        source, target = h.source, h.target
        near = h.start2 + moved
        at = locate(text, source[:PATTERN], near) if source else near
        end = at + len(source)
        if at >= 0 and len(source) > PATTERN:
            last = locate(text, source[-PATTERN:], near + len(source) - PATTERN)
            at, end = (-1, -1) if last < at else (at, last + PATTERN)
        if at < 0:
            done.append(False)
            moved -= len(target) - len(source)
            continue
        moved = at - h.start2
        found = text[at:end]
        if found == source:
            text = text[:at] + target + text[at + len(source) :]
        else:
            way = diff(source, found)
            if len(source) > PATTERN and sum(max(len(g), len(n)) for _, g, n in _gaps(way)) / len(source) > DELETE_THRESHOLD:
                done.append(False)
                continue
            p = 0
            for op, t in h.script:
                if op == "INSERT":
                    x = at + _index(way, p)
                    text = text[:x] + t + text[x:]
                    way = _spliced(way, p, t)
                elif op == "DELETE":
                    x, y = at + _index(way, p), at + _index(way, p + len(t))
                    text = text[:x] + text[y:]
                    way = _removed(way, p, len(t))
                p += 0 if op == "DELETE" else len(t)
        done.append(True)
    return text[MARGIN : len(text) - MARGIN], done


def _spliced(way: Script, at: int, t: str) -> Script:
    """The script after ``t`` was put into both of its texts at the source place ``at``."""
    out, p, put = [], 0, False
    for op, x in way:
        n = 0 if op == "INSERT" else len(x)
        if not put and p + n >= at and op != "INSERT":
            out += [(op, x[: at - p]), ("EQUAL", t), (op, x[at - p :])]
            put = True
        else:
            out.append((op, x))
        p += n
    return [s for s in (out if put else [*out, ("EQUAL", t)]) if s[1]]


def _removed(way: Script, at: int, n: int) -> Script:
    """The script after ``n`` source characters from ``at`` and what they lead to were removed from both of its texts."""
    out, p = [], 0
    for op, x in way:
        if op == "INSERT":
            out += [] if at < p < at + n else [(op, x)]
            continue
        low, high = min(max(at - p, 0), len(x)), min(max(at + n - p, 0), len(x))
        p += len(x)
        out.append((op, x[:low] + x[high:]))
    return [s for s in out if s[1]]


def _padded(h: Hunk, pad: str, first: bool, last: bool) -> Hunk:
    """The hunk in the padded text; the first and the last one take some of the padding if they have less than a margin of context."""
    script = list(h.script)
    start = h.start2 + len(pad)
    lead = len(script[0][1]) if script[0][0] == "EQUAL" else 0
    if first and h.start2 == 0 and lead < MARGIN:
        head = pad[lead:]
        script[:1] = [("EQUAL", head + script[0][1])] if lead else [("EQUAL", head), script[0]]
        start -= len(head)
    trail = len(script[-1][1]) if script[-1][0] == "EQUAL" else 0
    if last and trail < MARGIN:
        tail = pad[: MARGIN - trail]
        script[-1:] = [("EQUAL", script[-1][1] + tail)] if trail else [script[-1], ("EQUAL", tail)]
    return replace(h, start1=start, start2=start, script=tuple(script))


def patch_to_text(hunks: list[Hunk]) -> str:
    def span(start: int, n: int) -> str:
        return f"{start},0" if n == 0 else str(start + 1) if n == 1 else f"{start + 1},{n}"

    sign = {"EQUAL": " ", "DELETE": "-", "INSERT": "+"}
    return "".join(f"@@ -{span(h.start1, len(h.source))} +{span(h.start2, len(h.target))} @@\n" + "".join(f"{sign[op]}{urllib.parse.quote(t, safe=PATCH_SAFE)}\n" for op, t in h.script) for h in hunks)


def patch_from_text(text: str) -> list[Hunk]:
    """Hunks of a patch text; a line that is none of it raises ValueError."""
    out: list[Hunk] = []
    for line in text.split("\n"):
        if line.startswith("@@"):
            head = re.fullmatch(r"@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@", line)
            if not head:
                raise ValueError(f"no patch header: {line!r}")
            first, n, second, m = head.groups()
            out.append(Hunk(int(first) - (n != "0"), int(second) - (m != "0"), ()))
        elif line and out and line[0] in " +-":
            piece = ({" ": "EQUAL", "-": "DELETE", "+": "INSERT"}[line[0]], urllib.parse.unquote(line[1:]))
            out[-1] = replace(out[-1], script=(*out[-1].script, piece))
        elif line:
            raise ValueError(f"no patch line: {line!r}")
    return out


def _cleaned(clean):
    @F.pandas_udf(DIFF_TYPE)
    def udf(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else [{"op": o, "text": t} for o, t in clean(diff(x, y))] for x, y in zip(a, b)])

    return udf


semantic_udf, efficiency_udf, slide_udf = _cleaned(clean_semantic), _cleaned(clean_efficiency), _cleaned(slide)


@F.pandas_udf(T.IntegerType())
def locate_udf(text: pd.Series, pattern: pd.Series, near: pd.Series) -> pd.Series:
    """Places of patterns; null where an argument is null."""
    return pd.Series([None if t is None or p is None or pd.isna(n) else locate(t, p, int(n)) for t, p, n in zip(text, pattern, near)], dtype="Int32")


@F.pandas_udf(T.StringType())
def patch_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else patch_to_text(make_patch(x, y)) for x, y in zip(a, b)])


@F.pandas_udf(T.StructType([T.StructField("text", T.StringType()), T.StructField("applied", T.ArrayType(T.BooleanType()))]))
def apply_patch_udf(patch: pd.Series, text: pd.Series) -> pd.DataFrame:
    rows = [(None, None) if p is None or t is None else apply_patch(patch_from_text(p), t) for p, t in zip(patch, text)]
    return pd.DataFrame(rows, columns=["text", "applied"])
