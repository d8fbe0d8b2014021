"""A screen's reading of a text in Python: normalised, judged by shape, terms and words, then by what it may hide.

The same definitions as the columns of palisade.functions.text, but one text at a time and no further than a verdict needs,
so memory doesn't grow with the number of texts, and variants that nothing asks for are never made.
"""

from __future__ import annotations

import base64
import re
import sys
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from palisade.functions import automaton as M
from palisade.functions import lexicon as L
from palisade.functions import text as T

_TRIM = " \t\n\r\x0b\f"


def _classes(*kinds: tuple[str, ...]) -> list[re.Pattern]:
    """Patterns of the characters whose general category begins with one of each kind's."""
    ranges: list[list[list[int]]] = [[] for _ in kinds]
    for i in range(sys.maxunicode + 1):
        category = unicodedata.category(chr(i))
        for kind, found in zip(kinds, ranges, strict=True):
            if category.startswith(kind):
                if found and found[-1][1] == i - 1:
                    found[-1][1] = i
                else:
                    found.append([i, i])
    return [re.compile("[" + "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in found) + "]") for found in ranges]


_INVISIBLE, _SYMBOLS = _classes(("Cf", "Mn"), ("S",))
_CONTROL = re.compile(r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f]")
_ANSI = re.compile(T.ANSI)
_ALIKE, _FOLDED = re.compile(f"[{L.HOMOGLYPH_FROM}]"), str.maketrans(L.HOMOGLYPHS)
_URL = re.compile(T.URL, re.ASCII)
_CODE, _VOWELS = re.compile(r"[=+/0-9]"), re.compile(r"[aeiouAEIOU]")
_SPACED_HEX = re.compile(r"[0-9a-fA-F]{2,4}(\s[0-9a-fA-F]{2,4}){5,}", re.ASCII)
_ESCAPES = re.compile(T.ESCAPES)
_MODEL_TOKENS = re.compile(T.MODEL_TOKENS, re.IGNORECASE)
_PERSONA = re.compile(T.PERSONA.replace(r"\s", r"[ \t\n\x0b\f\r]"), re.IGNORECASE)
#: One of these stands in whatever _PERSONA finds (in capitals; İ, which matches I, has its own way there).
_PERSONA_HINTS = ("YOU", "ANYTHING", "ACT", "PRETEND", "FROM", "RESPOND", "FILTER", "SAFETY", "İ")
_ROT = bytes.maketrans((T._UPPER + T._LOWER).encode(), (T._UPPER[13:] + T._UPPER[:13] + T._LOWER[13:] + T._LOWER[:13]).encode())
_UNLEET = bytes.maketrans(L.LEET_FROM.encode(), L.LEET_TO.encode())
_GAPS = re.compile(r" {2,}")
_BASE64, _HEX = re.compile(r"[A-Za-z0-9+/]{8,}={0,2}"), re.compile(r"([0-9a-fA-F]{2}){4,}")
_PRINTABLE = re.compile(rb"[\x20-\x7E\n\r\t]+")


def normalised(t: str, compatibility: bool = True) -> str:
    """text.normalise()."""
    if not t.isascii():
        t = _INVISIBLE.sub("", t)
    t = _CONTROL.sub(" ", t)
    if not t.isascii():
        if compatibility:
            t = unicodedata.normalize("NFKC", t)
        if _ALIKE.search(t):
            t = t.translate(_FOLDED)
    return _ANSI.sub("", t) if "\x1b" in t else t


def is_gibberish(t: str) -> bool:
    s = _SYMBOLS.sub("", _URL.sub("", t).strip(_TRIM)).strip(_TRIM)
    n = len(s)
    if n <= 50:
        return False
    spaces = s.count(" ") / n
    if spaces < 0.02 and (s.endswith("=") or len(_CODE.findall(s)) / n > 0.08):
        return True
    return _SPACED_HEX.fullmatch(s) is not None or (spaces < 0.05 and len(_VOWELS.findall(s)) / n < 0.1)


def is_flood(t: str, words: list[str]) -> bool:
    s = t.strip(_TRIM)
    if len(s) >= 50 and len(set(s[:50])) <= 2 and len(set(s)) <= 2:
        return True
    if len(words) < 12:
        return False
    top = Counter(words).most_common(1)[0][1]
    return top >= 10 and top / len(words) > 0.6


def shape(t: str, upper: str, words: list[str]) -> str | None:
    """The first layer that a text's form alone decides."""
    if is_gibberish(t):
        return "gibberish"
    if is_flood(t, words):
        return "flood"
    if "\\" in t and _ESCAPES.search(t):
        return "escapes"
    if ("<" in t or "[" in t) and _MODEL_TOKENS.search(t):
        return "model_tokens"
    return "persona" if any(x in upper for x in _PERSONA_HINTS) and _PERSONA.search(t) else None


def _joined(segment: str) -> str:
    marks = [x for x in segment.split(" ") if x]
    return "".join(marks) if len(marks) > 2 and all(len(x) == 1 for x in marks) else segment


def _unpigged(w: str) -> str:
    if w[-2:].lower() != "ay":
        return w
    if w[-3:].lower() == "way" and len(w) > 4:
        return w[:-3]
    return w[-3] + w[:-3] if len(w) > 3 else w


def hidden(t: str, words: list[str]) -> Iterator[str]:
    """text.decoded_variants(), one after the other."""
    raw = t.encode()
    for made in (raw.translate(_ROT), raw.translate(_UNLEET)):
        if made != raw:
            yield made.decode()
    plain = " ".join(words)
    for made, original in ((t[::-1], t), (" ".join(map(_joined, _GAPS.split(t))), t), ("".join(words), t), (" ".join(map(_unpigged, words)), plain)):
        if made != original:
            yield made
    for w in words:
        if len(w) < 8 or len(w := w.strip(T.EDGE)) < 8:
            continue
        if len(w) % 4 == 0 and _BASE64.fullmatch(w):
            try:
                made = base64.b64decode(w, validate=True)
            except ValueError:
                made = b""
            if _PRINTABLE.fullmatch(made):
                yield made.decode()
        if _HEX.fullmatch(w) and _PRINTABLE.fullmatch(made := bytes.fromhex(w)):
            yield made.decode()


def parts(code: int) -> tuple[int, bool, int, int]:
    """A code's weight, whether a sure term was found, action and target words."""
    return code % M.WEIGHT, code // M.SURE % 2 > 0, code // M.ACTIONS % (1 << 16), code // M.TARGETS


def verdict(t: str, judge: M.Judge) -> tuple[str | None, int]:
    """(layer, points) of a normalised text; points count only where nothing blocks."""
    upper, words = t.upper(), t.split()
    layer = shape(t, upper, words)
    if layer:
        return layer, 0
    weight, sure, acts, aims = parts(judge.code(upper))
    pairs = acts + aims if acts and aims else 0
    if sure or weight >= 2 or pairs >= 3:
        return "high_confidence" if sure else "signals" if weight >= 2 else "co_occurrence", 0
    points = 12 * (weight == 1) + 15 * (pairs > 0) + 8 * (len(t) > 5000)
    for v in hidden(t, words):
        code = judge.code(v.upper())
        if code:
            weight, sure, acts, aims = parts(code)
            if sure or weight >= 2 or (acts and aims):
                return "decoded", 0
            points += 10 * (weight == 1) + 8 * (acts + aims > 0)
    return None, points


def read(df: DataFrame, text: str, judge: M.Judge, compatibility: bool = True) -> DataFrame:
    """df with clean, layer and _points of its texts; an operator of its own, as UDFs would be repeated with the expressions around them."""
    keep = [f for f in df.schema if f.name not in ("clean", "layer")]
    names = [f.name for f in keep]
    schema = StructType([*keep, StructField("clean", StringType()), StructField("layer", StringType()), StructField("_points", IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in M.portions(batch):
                clean = [normalised(t or "", compatibility) for t in M.strings(part.column(text))]
                layers, points = zip(*(verdict(t, judge) for t in clean), strict=True)
                made = [pa.array(clean, pa.string()), pa.array(layers, pa.string()), pa.array(points, pa.int32())]
                yield pa.RecordBatch.from_arrays([*(part.column(n) for n in names), *made], [*names, "clean", "layer", "_points"])

    return df.mapInArrow(run, schema)
