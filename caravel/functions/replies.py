"""Free-form model replies: JSON repair, keyword lists, descriptions without openings.

Replies are short and branchy, so these run as Arrow functions over whole batches.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Openings that a description loses, English and Spanish.
OPENINGS = ("here is", "here's", "the image shows", "this image shows", "this is", "sure,", "la imagen muestra", "esta imagen muestra", "aquí está", "claro,")


def repaired(text: str) -> object | None:
    """S9. The JSON value in a reply: outer text, trailing commas, single quotes and open brackets are mended."""
    cut = re.search(r"[\[{].*", text, re.S)
    if not cut:
        return None
    body = cut[0]
    for end in (len(body), body.rfind("}") + 1, body.rfind("]") + 1):
        for quotes in (False, True):
            t = re.sub(r",\s*([\]}])", r"\1", body[:end].strip())
            if quotes:
                t = t.replace("'", '"')
            opened = [{"[": "]", "{": "}"}[c] for c in re.sub(r'"[^"]*"', "", t) if c in "[{"]
            closed = sum(c in "]}" for c in re.sub(r'"[^"]*"', "", t))
            for tail in ("", *(["".join(reversed(opened[: len(opened) - closed]))] if len(opened) > closed else [])):
                try:
                    return json.loads(t + tail)
                except ValueError:
                    continue
    return None


def keywords(text: str | None, most: int = 8, longest: int = 60) -> list[str]:
    """S7, S8. Keywords of a reply: JSON, a dict's list, numbered or dashed lines, or commas; first occurrences only."""
    if not text:
        return []
    found = repaired(text)
    if isinstance(found, dict):
        found = next((v for v in found.values() if isinstance(v, list)), None)
    if not isinstance(found, list):
        found = re.split(r"[,;\n]+", text)
    out: dict[str, str] = {}
    for x in found:
        w = re.sub(r"^\s*(?:\d+[.)]|[-*•])\s*", "", str(x)).strip(" \t\"'.:")
        if w and len(w) <= longest and re.search(r"[aeiouáéíóú]", w, re.I):
            out.setdefault(w.lower(), w)
    return list(out.values())[:most]


def description(text: str | None, least: int = 15) -> str | None:
    """S10, S11. A description without up to three openings; the whole text if too little would be left."""
    if not text:
        return None
    rest = text.strip()
    for _ in range(3):
        low = rest.lower()
        opening = next((o for o in sorted(OPENINGS, key=len, reverse=True) if low.startswith(o)), None)
        if opening is None:
            break
        rest = rest[len(opening) :].lstrip(" :,-\n")
    if len(rest) < least:
        return text.strip()
    return rest[0].upper() + rest[1:]


def _over(f: Callable, kind: str, arrow: pa.DataType) -> Callable[[Column], Column]:
    @F.arrow_udf(kind)
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([f(t) for t in texts.to_pylist()], arrow)

    return run


def reply_keywords(text: Column) -> Column:
    return _over(keywords, "array<string>", pa.list_(pa.string()))(text)


def reply_description(text: Column) -> Column:
    return _over(description, "string", pa.string())(text)


def lossless(old: Column, new: Column) -> Column:
    """S12. Whether a cleaned text is only the old one without its beginning."""
    plain = lambda c: F.regexp_replace(F.lower(c), r"\s+", " ")
    return plain(old).endswith(plain(new))
