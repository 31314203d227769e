"""The character rules for one text at a time, for streams and SQL functions.

Only suspicious places are visited. The last kept character before a place is found by looking back over glue and stripped
characters, which are decided from their neighbours alone.
"""

from __future__ import annotations

import bisect
import difflib
import re
import unicodedata

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import constants as C
from ..operators.characters import INSPECT, Options


class _Ranges:
    """Membership in sorted ranges."""

    def __init__(self, ranges):
        merged = []
        for a, b in sorted(ranges):
            if merged and a <= merged[-1][1] + 1:
                merged[-1][1] = max(b, merged[-1][1])
            else:
                merged.append([a, b])
        self.first, self.last = [a for a, _ in merged], [b for _, b in merged]

    def __contains__(self, cp) -> bool:
        k = bisect.bisect_right(self.first, cp) - 1 if cp is not None else -1
        return k >= 0 and cp <= self.last[k]

    def regex(self) -> str:
        return "[" + "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in zip(self.first, self.last, strict=True)) + "]"


_R = {name: _Ranges(getattr(C, name)) for name in ("TAG_BLOCK", "TAGS", "NONCHARACTERS", "RESERVED", "BIDI", "BIDI_KEPT", "ZERO_WIDTH", "PRIVATE_USE", "VS_SUPPLEMENT", "VS_CJK", "CJK", "MONGOLIAN_VS", "MONGOLIAN", "EMOJI_BASE", "JOINERS", "ORTHOGRAPHIC_CF", "MONGOLIAN_LETTERS", "KHMER_VOWELS", "KHMER_LETTERS", "HANGUL_FILLERS", "JAMO", "GLUE", "SPACES", "FORMAT")}
_STRIPPED = _Ranges([*C.STRIP, *C.VS_SUPPLEMENT, *C.TAG_BLOCK, *C.NONCHARACTERS, *C.RESERVED, *C.PRIVATE_USE])
_SELECTORS = _Ranges([*C.VS_SUPPLEMENT, *C.VS, *C.MONGOLIAN_VS])
_JOINING = {name: _Ranges(r) for name, r in C.JOINING.items()}
_FIND = {False: re.compile(_Ranges(C.SUSPICIOUS).regex()), True: re.compile(_Ranges(C.SUSPICIOUS_AGGRESSIVE).regex())}
_FLAGS = re.compile("\U0001f3f4([\U000e0020-\U000e007e]+\U000e007f)")
_KINDS = (("TAG_BLOCK", "tag_chars"), ("NONCHARACTERS", "noncharacter"), ("RESERVED", "reserved_ignorable"), (None, "variation_selector"), ("BIDI", "bidi"), ("ZERO_WIDTH", "zwj_family"), ("PRIVATE_USE", "private_use"))


def _script(cp):
    return next((n for n, r in _JOINING.items() if cp in r), None)


class _Text:
    def __init__(self, text: str, o: Options):
        self.text, self.o = text, o
        self.tags = {i for m in _FLAGS.finditer(text) for i in range(*m.span(1))}
        self.pairs: set[int] = set()
        self.known: tuple[int, int | None] = (0, None)  # a place and the last kept character before it
        opened: list[int] = []
        for m in re.finditer("[\u202a-\u202e]", text) if not o.strip_bidi else ():
            if m[0] != "\u202c":
                opened.append(m.start())
            elif opened and text[k := opened.pop()] in "\u202a\u202b":
                self.pairs |= {k, m.start()}

    def at(self, i):
        return ord(self.text[i]) if 0 <= i < len(self.text) else None

    def kept_before(self, i):
        found, j = None, i
        while j > 0:
            if j == self.known[0]:
                found = self.known[1]
                break
            j -= 1
            cp = self.at(j)
            if cp in _R["GLUE"]:
                continue
            kind, out = self.kind(j)
            if kind is None or out:
                found = ord(out) if out else cp
                break
        self.known = (i, found)
        return found

    def part_of_text(self, i) -> bool:
        cp, a, b = self.at(i), self.at(i - 1), self.at(i + 1)
        r = _R
        if cp in r["VS_SUPPLEMENT"] or cp in r["VS_CJK"]:
            if a in r["CJK"]:
                return True
        if cp in r["MONGOLIAN_VS"] and a in r["MONGOLIAN"] or cp in (0xFE0E, 0xFE0F) and a in r["EMOJI_BASE"]:
            return True
        if cp in r["JOINERS"] and (s := _script(a)) and s == _script(b):
            return True
        if cp in r["ORTHOGRAPHIC_CF"] or i in self.tags:
            return True
        if any(c[0] <= cp <= c[1] and any(n is not None and s[0] <= n <= s[1] for n in (a, b)) for c, s in C.LAYOUT):
            return True
        if cp == 0x200D and b in r["EMOJI_BASE"]:
            return self.kept_before(i) in r["EMOJI_BASE"]
        for glue, letters in (("MONGOLIAN_VS", "MONGOLIAN_LETTERS"), ("KHMER_VOWELS", "KHMER_LETTERS"), ("HANGUL_FILLERS", "JAMO")):
            if cp in r[glue]:
                return self.kept_before(i) in r[letters]
        return False

    def kind(self, i) -> tuple[str | None, str]:
        """Kind (None: stays) and what replaces the character."""
        cp, o = self.at(i), self.o
        if not o.strip_bidi and (i in self.pairs or cp in _R["BIDI_KEPT"]) or not o.strip_glue and self.part_of_text(i):
            return None, ""
        if cp in _STRIPPED:
            return next((k for n, k in _KINDS if cp in (_R[n] if n else _SELECTORS)), "strip"), ""
        if o.normalize_spaces and cp in _R["SPACES"]:
            return "space", " "
        if o.aggressive and cp in C.CONFUSABLES:
            return "confusable", C.CONFUSABLES[cp]
        return ("other_cf" if cp in _R["FORMAT"] else None), ""

    def marks(self):
        """(place, code point, kind, replacement) of what does not stay."""
        for m in _FIND[self.o.aggressive].finditer(self.text):
            kind, out = self.kind(m.start())
            if kind:
                yield m.start(), ord(m[0]), kind, out


def marks(text: str, o: Options = INSPECT) -> list[tuple[int, int, str, str]]:
    return list(_Text(text, o).marks()) if text else []


def nfkc(text: str) -> tuple[str, int]:
    """Normalised text, and how many input characters changed (at least one if any did)."""
    out = unicodedata.normalize("NFKC", text)
    if out == text:
        return out, 0
    if len(text) <= WHOLE:
        return out, max(1, _changed(text, out))
    return out, max(1, sum(_changed(x, y) for x in _pieces(text) if (y := unicodedata.normalize("NFKC", x)) != x))


def _changed(text: str, out: str) -> int:
    return len(text) - sum(b.size for b in difflib.SequenceMatcher(None, text, out, autojunk=False).get_matching_blocks())


#: Characters up to which a text is compared as a whole; longer ones in the pieces that normalisation treats by themselves.
WHOLE = 2000
_PIECES = re.compile("[\x00-\x7f]?[^\x00-\x7f]+")


def _pieces(text: str):
    """Stretches that hold all that may change: cut before ASCII, and before letters, digits and marks of punctuation that begin anew."""
    for m in _PIECES.finditer(text):
        piece, start = m[0], 0
        for k in range(64, len(piece)):
            if k - start >= 64 and unicodedata.category(piece[k]) in ("Lu", "Ll", "Lo", "Nd", "Po") and not 0x1160 <= ord(piece[k]) <= 0x11FF:
                yield piece[start:k]
                start = k
        yield piece[start:]


def clean_text(text: str | None, o: Options = Options()) -> tuple[str | None, int, int, int]:
    """Cleaned text, removed and replaced characters (normalised ones included) and normalised characters."""
    if text is None:
        return None, 0, 0, 0
    parts, start, removed, replaced, changed = [], 0, 0, 0, 0
    for i, _, _, out in marks(text, o):
        parts += [text[start:i], out]
        start = i + 1
        removed, replaced = removed + (not out), replaced + bool(out)
    result = "".join([*parts, text[start:]])
    if o.nfkc:
        result, changed = nfkc(result)
    return result, removed, replaced + changed, changed


@F.pandas_udf(T.StructType().add("text", T.StringType()).add("changed", T.IntegerType()))
def nfkc_clean(text: pd.Series) -> pd.DataFrame:
    got = [(None, 0) if t is None else nfkc(t) for t in text]
    return pd.DataFrame({"text": [x[0] for x in got], "changed": [x[1] for x in got]})


def kept_of(text: str | None, ranges: list[tuple[int, int]], o: Options = INSPECT) -> tuple[int, int]:
    """Of the characters in the ranges, how many stay and how many do not."""
    if not text:
        return 0, 0
    t = _Text(text, o)
    kinds = [t.kind(m.start())[0] for m in re.finditer(_Ranges(ranges).regex(), text)]
    return kinds.count(None), len(kinds) - kinds.count(None)


def kept_udf(ranges: list[tuple[int, int]], o: Options = INSPECT):
    """A pandas UDF: text -> struct of the numbers of characters in the ranges that stay and that do not."""

    @F.pandas_udf("kept long, stripped long")
    def run(text: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([kept_of(t, ranges, o) for t in text], columns=["kept", "stripped"])

    return run


def clean_udf(o: Options = Options()):
    """A pandas UDF: text -> struct of the cleaned text and counts."""

    @F.pandas_udf("cleaned string, removed_count int, replaced_count int, nfkc_changed int")
    def run(text: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([clean_text(t, o) for t in text], columns=["cleaned", "removed_count", "replaced_count", "nfkc_changed"])

    return run


LABELS = "array<struct<label:string,action:string,n:int>>"


def stats_of(text: str | None, o: Options = Options()) -> list[tuple[str, str, int]]:
    """(label, action, count) of what cleaning removes and replaces."""
    found: dict[tuple[str, str], int] = {}
    for _, cp, _, out in marks(text or "", o):
        key = label(cp), "replaced" if out else "removed"
        found[key] = found.get(key, 0) + 1
    if o.nfkc and (n := clean_text(text, o)[3]):
        found["NFKC", "replaced"] = n
    return [(*k, n) for k, n in sorted(found.items())]


def stats_udf(o: Options = Options()):
    """A pandas UDF: text -> array of labels, actions and counts."""

    @F.pandas_udf(LABELS)
    def run(text: pd.Series) -> pd.Series:
        return pd.Series([[{"label": a, "action": b, "n": n} for a, b, n in stats_of(t, o)] for t in text], dtype=object)

    return run


def hits_of(text: str | None, aggressive: bool = False, strip_glue: bool = False) -> list[tuple[int, str, int, list[int]]]:
    """(code point, kind, count, first ten offsets) by count, then code point."""
    found: dict[tuple[int, str], list[int]] = {}
    for i, cp, kind, _ in marks(text or "", Options(aggressive=aggressive, strip_glue=strip_glue, strip_bidi=True)):
        found.setdefault((cp, kind), []).append(i)
    return sorted(((cp, kind, len(at), at[:10]) for (cp, kind), at in found.items()), key=lambda x: (-x[2], x[0]))


HITS = "array<struct<cp:int,label:string,kind:string,count:int,sample_offsets:array<int>>>"


def label(cp: int) -> str:
    """Name shown for a code point, after its number."""
    if cp in C.NAMES:
        name = C.NAMES[cp]
    elif 0xFE00 <= cp <= 0xFE0F:
        name = f"VARIATION SELECTOR-{cp - 0xFE00 + 1}"
    elif cp in _R["VS_SUPPLEMENT"]:
        name = f"VARIATION SELECTOR-{cp - 0xE0100 + 17}"
    elif cp in _R["TAGS"] or cp == 0xE0001:
        name = "TAG CHARACTER"
    else:
        kinds = (("PRIVATE_USE", "PRIVATE USE"), ("NONCHARACTERS", "NONCHARACTER"), ("RESERVED", "RESERVED DEFAULT-IGNORABLE"))
        name = next((text for r, text in kinds if cp in _R[r]), f"CONFUSABLE OF '{C.CONFUSABLES[cp]}'" if cp in C.CONFUSABLES else "UNKNOWN")
    return f"U+{cp:04X} {name}"


def inspect_udf(aggressive: bool = False, strip_glue: bool = False):
    """A pandas UDF: text -> array of hits; null where a text fails, so that one row cannot end the job."""

    def one(t: str | None):
        try:
            return [{"cp": c, "label": label(c), "kind": k, "count": n, "sample_offsets": at} for c, k, n, at in hits_of(t, aggressive, strip_glue)]
        except Exception:
            return None

    @F.pandas_udf(HITS)
    def run(text: pd.Series) -> pd.Series:
        return pd.Series([one(t) for t in text], dtype=object)

    return run
