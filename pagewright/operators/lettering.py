"""Text into boxes: wrapping, hyphenation and the largest size that fits, with widths from a table of advances.

A width is the sum of the characters' advances, in parts of the size, and the outline on
both sides; a line is as high as the size and the outline. Real fonts differ by a
few pixels; a table of theirs can be passed in.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Endings before which a word is divided, marks that stay with a word's end, vowels.
ENDINGS = "tion sion ment ness able ible ful less ous ive ing ting ally ely ily ly er ed en est ize ise ated ious eous tial cial".split()
TRAILING = ".,;:!?-_'\""
VOWELS = "aeiouAEIOU"
#: Advances of narrow and wide characters; others take the middle one.
NARROW, MIDDLE, WIDE = 0.3, 0.58, 0.9
ADVANCES = dict.fromkeys("iljI.,:;'!|()[] t", NARROW) | dict.fromkeys("mwMW@%", WIDE)


def outline(size: Column) -> Column:
    """Width of the outline of a size."""
    return F.greatest(F.lit(1), F.floor(size / 12))


def spacing(size: Column, style: Column) -> Column:
    """Space between lines of a size."""
    return F.when(style == "sfx", F.greatest(F.lit(2), F.floor(size * 0.12))).otherwise(F.greatest(F.lit(4), F.floor(size * 0.25)))


def least_size(box_w: Column, box_h: Column, w: Column, h: Column, balloon: Column) -> Column:
    """The least readable size of dialogue in the space w x h of a box."""
    area, side = w * h, F.least(w, h)
    return (
        F.when((side < 38) | (area < 2200) | (box_w < 52) & (box_h > box_w * 1.8), 12)
        .when((area >= 34000) & (side >= 78), 15)
        .when((area >= 14000) & (side >= 54), 14)
        .when(balloon & (area >= 7000) & (side >= 44), 13)
        .otherwise(12)
    )


def drawn_style(text: Column, w: Column, h: Column) -> Column:
    """`sfx` for a few letters without an end of sentence, or for a few words in a wide box."""
    words = F.size(F.array_remove(F.split(F.trim(text), "(?U)\\s+"), ""))
    few = (words <= 2) & (F.regexp_count(text, F.lit("\\p{L}")) <= 12) & ~text.rlike("[.?!]")
    return F.when(few | (h < F.floor(w * 0.55)) & (words <= 3), "sfx").otherwise("dialogue")


def divided(word: str) -> list[str]:
    """A word of eight letters or more in two, before its last ending or a vowel near the middle, else whole."""
    core = word.rstrip(TRAILING)
    if len(core) < 8:
        return [word]
    low = core.lower()
    found = [at for e in ENDINGS if (at := low.rfind(e)) > 1 and at + len(e) >= len(core) - 1]
    cut = max(found, default=-1)
    if not 1 < cut < len(core) - 1:
        middle = len(core) // 2
        places = (p for off in range(middle) for p in (middle + off, middle - off))
        cut = next((p for p in places if 2 <= p < len(core) - 1 and core[p - 1] not in VOWELS and core[p] in VOWELS), -1)
    return [word] if cut < 0 else [word[:cut], word[cut:]]


def cut_to(token: str, most: float, width: Callable[[str], float]) -> list[str]:
    """A token in pieces that fit, at least a character each; the marks at its end stay together."""
    core = token.rstrip(TRAILING)
    marks, out, now = token[len(core) :], [], ""
    for c in core:
        if now and width(now + c) > most:
            out.append(now)
            now = ""
        now += c
    if now and width(now + marks) > most and marks:
        out.append(now)
        now = ""
    return [x for x in [*out, now + marks] if x]


def wrapped(text: str, most: float, width: Callable[[str], float], hyphens: bool = False, characters: bool = False) -> list[str]:
    """Lines of at most a width, filled greedily; none at all if a word is too wide and may not be divided."""
    out: list[str] = []
    for paragraph in text.replace("\r", "\n").split("\n"):
        line = ""
        for word in paragraph.split():
            parts = [word]
            if width(word) > most:
                if not (hyphens or characters):
                    return []
                if hyphens and len(halves := divided(word)) == 2:
                    parts = [halves[0] + "-", halves[1]]
                if characters:
                    parts = [p for x in parts for p in ([x] if width(x) <= most else cut_to(x, most, width))]
            for k, part in enumerate(parts):
                joined = f"{line} {part}" if line and not k else part
                if line and (k or width(joined) > most):
                    out.append(line)
                    joined = part
                line = joined
        if line:
            out.append(line)
    return out


def most_size(words: int, w: int, h: int, style: str) -> int:
    """The largest size to try in a box."""
    if style == "sfx":
        return min(200, max(w, h))
    if words <= 5:
        size = min(200, max(h, int(w * (1.5 if words <= 2 else 1.4))))
    else:
        size = min(200, max(24, int(min(w, h) * 1.5)))
    for least, top, part in ((9, 28, 0.2), (6, 30, 0.22), (4, 34, 0.28)):
        if words >= least:
            return min(size, max(20, min(top, int(w * part))))
    return size


def layout(text: str, size: int, w: float, style: str, advances: Mapping[str, float] = ADVANCES, hyphens: bool = False) -> tuple[list[str], float, int]:
    """Lines of a size within a width, the widest line, and the height of all."""
    edge = max(1, size // 12)
    gap = max(2, int(size * 0.12)) if style == "sfx" else max(4, int(size * 0.25))

    def width(x: str) -> float:
        return size * sum(advances.get(c, MIDDLE) for c in x) + 2 * edge

    lines = wrapped(text, w, width, hyphens, hyphens)
    return lines, max(map(width, lines), default=0.0), len(lines) * (size + 2 * edge) + max(0, len(lines) - 1) * gap


def fitted(text: str, w: int, h: int, style: str, least: int = 10, advances: Mapping[str, float] = ADVANCES) -> tuple[int, list[str]]:
    """The largest size whose lines fit a box, and the lines; 0 and none if none fits.

    Dialogue is never divided, and has a pixel of slack; sounds are divided where that allows a size at all.
    """
    low, slack = (min(least, 6), 0) if style == "sfx" else (least, 1)
    for hyphens in (False, True) if style == "sfx" else (False,):
        a, b, best = low, most_size(len(text.split()), w, h, style), (0, [])
        while a <= b:
            size = (a + b) // 2
            lines, wide, high = layout(text, size, w + slack, style, advances, hyphens)
            if lines and wide <= w + slack and high <= h:
                best, a = (size, lines), size + 1
            else:
                b = size - 1
        if best[0]:
            return best
    return 0, []


def fit(units: DataFrame, advances: Mapping[str, float] = ADVANCES) -> DataFrame:
    """units (page, idx, text, style, w, h) with size, lines and skip_reason, null where the text is drawn."""
    names = ["page", "idx", "text", "style", "w", "h"]
    kinds = ", ".join(f"{n} {units.schema[n].dataType.simpleString()}" for n in names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for text, style, w, h in zip(*(b.column(k).to_pylist() for k in range(2, 6)), strict=True):
                if not (text or "").strip():
                    out.append((0, [], "blank text"))
                elif not w or not h or w < 1 or h < 1:
                    out.append((0, [], "no available text area"))
                else:
                    size, lines = fitted(text, w, h, style or "dialogue", advances=advances)
                    out.append((size, lines, None if size else "no fitted lines"))
            columns = list(zip(*out, strict=True)) or [(), (), ()]
            more = [pa.array(c, k) for c, k in zip(columns, (pa.int32(), pa.list_(pa.string()), pa.string()), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, *more], [*names, "size", "lines", "skip_reason"])

    return units.select(*names).mapInArrow(run, f"{kinds}, size int, lines array<string>, skip_reason string")
