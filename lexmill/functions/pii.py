"""Redaction of Chinese id numbers, mobile numbers and bank cards.

Numbers are recognised in their plain form: invisible characters are skipped, and full-width, circled and other compatibility
forms count as the digits, spaces, hyphens and letters that they stand for. Only a run of such characters can hold a number,
so each run is judged and rewritten by itself; text outside runs is never touched. The classes of these characters are
derived from the Unicode data once a process. Texts without a run that holds enough digits stay in the JVM; that gate uses
the same classes, so it lets nothing by.
"""

import re
import sys
import unicodedata
from functools import cache
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: The shapes of the numbers; a separator may stand between digits of phones and cards.
ID_18 = r"(?<!\d)([1-9]\d{5})\d{8}([\dXx]{4})(?!\d)"
ID_15 = r"(?<!\d)([1-9]\d{5})\d{6}(\d{3})(?!\d)"
PHONE = r"(?<!\d)(1[3-9]\d)[ -]?(\d{4})[ -]?(\d{4})(?!\d)"
CARD = r"(?<!\d)(?:\d[ -]?){16,19}(?!\d)"
KINDS = ("id_card", "phone", "bank_card")
#: Shape, kind, head and tail kept, and what stands between; of shapes that start at one place the earlier kind goes first.
SHAPES = ((ID_18, "id_card", 6, 4, "*" * 8), (ID_15, "id_card", 6, 3, "*" * 6), (PHONE, "phone", 3, 4, "****"), (CARD, "bank_card", 4, 4, "****"))
#: The fewest digits of a number.
FEWEST = 11


class Alphabet(NamedTuple):
    plain: dict[int, str]
    run: re.Pattern
    gate: str
    hidden: str


def _ranges(points: list[int], form: str) -> str:
    """The inside of a character class that holds the code points, which are sorted."""
    out, start = [], None
    for a, b in zip([*points], [*points[1:], None], strict=True):
        start = a if start is None else start
        if b != a + 1:
            out.append(form % start if start == a else f"{form % start}-{form % a}")
            start = None
    return "".join(out)


def _java(points: list[int]) -> str:
    """A Java class of the code points, behind a few wide ranges that hold them: most letters are told by those, not by hundreds
    of narrow ones."""
    if not points:
        return ""
    near, high = [p for p in points if p < 0x80], [p for p in points if p >= 0x80]
    hull, low = set(near), [p for p in high if p < 0x600]
    for p in low:
        hull.update(range(p & ~63, (p | 63) + 1))
    wide = _ranges(sorted(hull), "\\x{%x}") + (f"\\x{{{min(p for p in high if p >= 0x600):x}}}-\\x{{10ffff}}" if high and high[-1] >= 0x600 else "")
    return f"[{wide}&&[{_ranges(points, '\\x{%x}')}]]"


@cache
def alphabet() -> Alphabet:
    """What each character of a run stands for, runs long enough for a number, the gate and invisible characters for the JVM."""
    plain, several, one, other = {}, [], [], []
    for point in range(sys.maxunicode + 1):
        c = chr(point)
        kind = unicodedata.category(c)
        if kind == "Cs":
            continue
        said = "" if kind == "Cf" else unicodedata.normalize("NFKC", c) if unicodedata.decomposition(c) else c
        digits = sum(x.isdecimal() for x in said)
        if not said or digits or any(x in " -Xx" for x in said):
            (several if digits > 1 else one if digits else other).append(point)
            if said != c:
                plain[point] = said
    everything = sorted(several + one + other)
    widest = max(sum(x.isdecimal() for x in plain.get(p, "")) for p in several)
    run = re.compile(f"[{_ranges(everything, '\\U%08x')}]{{{-(-FEWEST // widest)},}}")
    gate = f"{_java(one)}(?:{_java(other)}*+{_java(one)}){{{FEWEST - 1}}}|{_java(several)}"
    return Alphabet(plain, run, gate, _java(sorted(p for p in everything if plain.get(p) == "")))


def masked(run: str, counts: dict[str, int]) -> str:
    """A run with its numbers masked; counts are raised. What is masked begins earliest, then is of the first kind, then longest."""
    plain = alphabet().plain
    view = run.translate(plain)
    ends = None if run.isascii() else np.cumsum([len(plain.get(ord(c), c)) for c in run])
    of = (lambda p: p) if ends is None else lambda p: int(np.searchsorted(ends, p, side="right"))  # the run's character behind a place of the view
    found = []
    for order, (shape, kind, head, tail, mask) in enumerate(SHAPES):
        for m in re.finditer(shape, view):
            digits = m[0].translate({32: None, 45: None})
            start, end = of(m.start()), of(m.end() - 1) + 1
            found.append((start, KINDS.index(kind), start - end, order, end, kind, digits[:head] + mask + digits[-tail:]))
    out, at = [], 0
    for start, _, _, _, end, kind, said in sorted(found):
        if start >= at:
            counts[kind] += 1
            out += [run[at:start], said]
            at = end
    return "".join(out) + run[at:]


def redact_text(text: str | None) -> tuple[str | None, dict[str, int], int]:
    """The redacted text, counts by kind, and how many invisible characters there are."""
    counts = dict.fromkeys(KINDS, 0)
    if text is None:
        return None, counts, 0
    known = alphabet()
    hidden = 0 if text.isascii() else sum(known.plain.get(ord(c)) == "" for c in text)
    return known.run.sub(lambda m: masked(m[0], counts), text), counts, hidden


RESULT = "text string, id_card int, phone int, bank_card int, hidden int"


def suspect(text: Column) -> Column:
    """Whether a text may hold a number: enough digits, in whatever form, with nothing but invisible characters, separators and X between."""
    return text.rlike(alphabet().gate)


def redacted(text: Column) -> Column:
    """Struct of RESULT. Texts that aren't suspect stay in the JVM."""

    @F.pandas_udf(RESULT)
    def redact(texts: pd.Series) -> pd.DataFrame:
        rows = [redact_text(x) for x in texts]
        return pd.DataFrame({"text": [r[0] for r in rows], **{k: [r[1][k] for r in rows] for k in KINDS}, "hidden": [r[2] for r in rows]})

    hidden = F.when(F.octet_length(text) == F.length(text), F.lit(0)).otherwise(F.length(F.regexp_replace(text, f"[^{alphabet().hidden}]+", "")))
    found = redact(F.when(suspect(text), text))
    return F.struct(F.coalesce(found["text"], text).alias("text"), *[F.coalesce(found[k], F.lit(0)).alias(k) for k in KINDS], F.when(found["text"].isNotNull(), found["hidden"]).otherwise(hidden).alias("hidden"))
