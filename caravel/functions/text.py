"""Keyword lists, folding and transcripts as column expressions."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Letters with accents and the plain letters they fold to, pair by pair.
ACCENTED = "áàâäãåéèêëíìîïóòôöõúùûüñçýÿ"
PLAIN = "aaaaaaeeeeiiiiooooouuuuncyy"
#: Leading articles that a keyword loses.
ARTICLES = "el|la|los|las|un|una|unos|unas"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def folded(text) -> Column:
    """Lower case without accents."""
    return F.translate(F.lower(_c(text)), ACCENTED, PLAIN)


def keyword_list(text) -> Column:
    """S1. Array of a JSON array or a comma list: trimmed, without quotes and closing marks, no blanks."""
    t = _c(text)
    raw = F.coalesce(F.from_json(t, "array<string>", {"mode": "PERMISSIVE"}), F.split(t, ","))
    raw = F.when(F.ltrim(t).startswith("["), raw).otherwise(F.split(t, ","))
    tidy = F.transform(raw, lambda w: F.regexp_replace(F.trim(F.regexp_replace(F.trim(w), "^[\"']+|[\"']+$", "")), "[.,;]+$", ""))
    return F.filter(tidy, lambda w: w != "")


def normal_keyword(word) -> Column:
    """S2. Lexical normal form: lower, cut at ``(`` and ``...``, no outer punctuation, no leading article."""
    w = F.lower(F.trim(_c(word)))
    w = F.regexp_replace(w, r"(\(|\.\.\.).*$", "")
    w = F.regexp_replace(w, r"^[\s\p{Punct}]+|[\s\p{Punct}]+$", "")
    return F.regexp_replace(w, rf"^({ARTICLES})\s+", "")


def singular(word) -> Column:
    """S4. Drops a final s behind a vowel, but not of ``-es`` words or words under four letters."""
    w = _c(word)
    return F.when((F.length(w) >= 4) & w.rlike("[aeiouáéíóú]s$") & ~w.endswith("es"), F.substr(w, F.lit(1), F.length(w) - 1)).otherwise(w)


def canonical(word, synonyms: dict[str, str]) -> Column:
    """S5. Canonical form of a word; the first entry for a synonym holds."""
    if not synonyms:
        return _c(word)
    table = F.create_map(*[x for k, v in synonyms.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(F.try_element_at(table, _c(word)), _c(word))


#: Patterns of replies that repeat their prompt, file names and sizes.
JUNK = (
    "g[eé]nero fotogr[aá]fico", "elige una", "deben describir", "no incluyas", "ejemplo", "ning[uú]n otro texto", "separa", "palabra clave", "this is", "spanish",
    "primera palabra", r"^\.\.\.$", "no inventes", "separ[aá]las", "no incluesas", r"^sa_\d+$", r"^dsc\d+", r"^\d+x\d+$", r"^\d+\s*[a-z]",
)


def is_junk(word, stop: tuple[str, ...] = (), phrases: tuple[str, ...] = ()) -> Column:
    """S3. Whether a keyword is noise: it has a junk pattern, under three characters, is a stop word, or is a phrase of three or more words that isn't among ``phrases``. Null is no noise."""
    w = F.lower(_c(word))
    spaces = F.length(w) - F.length(F.replace(w, F.lit(" "), F.lit("")))
    phrase = (spaces >= 2) & (~w.isin(*[p.lower() for p in phrases]) if phrases else F.lit(True))
    out = w.rlike("|".join(f"(?:{j})" for j in JUNK)) | (F.length(w) < 3) | phrase
    return out | w.isin(*stop) if stop else out


def replaced_words(text, table: dict[str, str]) -> Column:
    """S20. Whole words replaced in any case, entry by entry."""
    out = _c(text)
    for k, v in table.items():
        key = "".join(f"\\{c}" if not c.isalnum() and c != " " else c for c in k)
        out = F.regexp_replace(out, rf"(?iu)\b{key}\b", v.replace("\\", "\\\\").replace("$", "\\$"))
    return out


def is_token_subset(part, whole) -> Column:
    """S17. All words of ``part`` are in ``whole``, which has more than one; false for a blank ``part``."""
    tokens = lambda c: F.filter(F.array_distinct(F.split(_c(c), r"\s+")), lambda t: t != "")
    return (F.size(tokens(whole)) > 1) & (F.size(tokens(part)) > 0) & (F.size(F.array_except(tokens(part), tokens(whole))) == 0)


def is_concentrated(own: Column, official: Column) -> Column:
    """S17. One province only, which is among the official ones; true if there are no official ones (arrays)."""
    return F.when(F.coalesce(F.size(official), F.lit(0)) <= 0, True).otherwise((F.size(own) == 1) & (F.size(F.array_except(own, official)) == 0))


def voice_state(segments: Column, **limits: float) -> Column:
    """S30. ``ok`` if a segment passes ``good_segments``, else ``sin_voz``."""
    return F.when(F.size(good_segments(segments, **limits)) > 0, "ok").otherwise("sin_voz")


def refined(words: Column, synonyms: dict[str, str] | None = None, stop: tuple[str, ...] = (), most: int = 7) -> Column:
    """S3, S6. Normal form, noise out (``is_junk``), singular, canonical, first occurrences, the first ``most``."""
    steps = F.filter(F.transform(words, normal_keyword), lambda w: ~is_junk(w, stop))
    steps = F.filter(F.transform(steps, lambda w: canonical(singular(w), synonyms or {})), lambda w: ~is_junk(w, stop))
    return F.slice(F.array_distinct(steps), 1, most)


def merged_ci(words: Column) -> Column:
    """Words without later ones that differ in case only; order stays."""
    start = F.struct(F.array().cast("array<string>").alias("seen"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, w: Column) -> Column:
        low = F.lower(w)
        new = ~F.array_contains(acc["seen"], low)
        return F.struct(F.when(new, F.array_append(acc["seen"], low)).otherwise(acc["seen"]).alias("seen"), F.when(new, F.array_append(acc["out"], w)).otherwise(acc["out"]).alias("out"))

    return F.aggregate(words, start, step, lambda acc: acc["out"])


def merged_words(text) -> Column:
    """The words between single spaces, as ``merged_ci`` leaves them, joined again; one hash look-up a word."""

    @F.arrow_udf(T.StringType())
    def merged(texts: pa.Array, lows: pa.Array) -> pa.Array:
        out = []
        for t, low in zip(texts, lows, strict=True):
            first = {}
            for w, x in zip(t.as_py().split(" "), low.as_py().split(" "), strict=True) if t.is_valid else ():
                first.setdefault(x, w)
            out.append(" ".join(first.values()) if t.is_valid else None)
        return pa.array(out, pa.string())

    return merged(_c(text), F.lower(_c(text)))


def compact(text) -> Column:
    return F.trim(F.regexp_replace(_c(text), r"\s+", " "))


def hashtags(text) -> Column:
    """Sorted distinct hashtags, lower case."""
    found = F.regexp_extract_all(_c(text), F.lit(r"#(\w+)"), F.lit(1))
    return F.array_sort(F.array_distinct(F.transform(found, F.lower)))


def leading_score(text, default: float = 5.0) -> Column:
    """S24. The number a reply begins with, else ``default``."""
    return F.coalesce(F.regexp_extract(_c(text), r"^\s*(\d+(?:\.\d+)?)", 1).try_cast("double"), F.lit(default))


def cut_at_space(text, most: int) -> Column:
    """S14. At most ``most`` characters, cut at the last space if that keeps half of them."""
    t = _c(text)
    head = F.substring(t, 1, most)
    whole = F.regexp_extract(head, r"(?s)^(.*)\s", 1)
    return F.when(F.length(t) <= most, t).when(F.length(whole) >= most / 2, whole).otherwise(head)


SEGMENT = "array<struct<start: double, end: double, text: string, logprob: double, no_speech: double, compression: double>>"


def good_segments(segments: Column, logprob: float = -0.8, no_speech: float = 0.6, compression: float = 2.4, seconds: float = 1.5) -> Column:
    """Segments above the confidence thresholds; an unknown measure passes."""

    def ok(s: Column) -> Column:
        passed = lambda c: F.coalesce(c, F.lit(True))
        return passed(s["logprob"] >= logprob) & passed(s["no_speech"] < no_speech) & passed(s["compression"] < compression) & passed(s["end"] - s["start"] >= seconds)

    return F.filter(segments, ok)


def transcript(segments: Column) -> Column:
    """S13. Texts in order of start, joined by spaces, blanks left out."""
    ordered = F.array_sort(segments, lambda a, b: F.when(a["start"] < b["start"], -1).when(a["start"] > b["start"], 1).otherwise(0))
    return F.array_join(F.filter(F.transform(ordered, lambda s: F.trim(s["text"])), lambda t: t != ""), " ")


def srt_time(seconds: Column) -> Column:
    """``HH:MM:SS,mmm``."""
    ms = F.round(seconds * 1000).cast("long")
    part = lambda x, n: F.lpad(F.floor(x).cast("string"), n, "0")
    return F.concat(part(ms / 3_600_000, 2), F.lit(":"), part(F.pmod(ms / 60_000, F.lit(60)), 2), F.lit(":"), part(F.pmod(ms / 1000, F.lit(60)), 2), F.lit(","), F.lpad(F.pmod(ms, F.lit(1000)).cast("string"), 3, "0"))


def subtitles(segments: Column) -> Column:
    """SNK14. SRT text of segments in their order."""
    blocks = F.transform(segments, lambda s, i: F.concat((i + 1).cast("string"), F.lit("\n"), srt_time(s["start"]), F.lit(" --> "), srt_time(s["end"]), F.lit("\n"), F.trim(s["text"]), F.lit("\n")))
    return F.array_join(blocks, "\n")


def translated(words: Column, glossary: dict[str, str]) -> Column:
    """S19. A label by the whole entry, else word by word; unknown words stay."""
    table = F.create_map(*[x for k, v in glossary.items() for x in (F.lit(k), F.lit(v))])
    by_word = F.array_join(F.transform(F.split(F.lower(words), " "), lambda w: F.coalesce(F.try_element_at(table, w), w)), " ")
    return F.coalesce(F.try_element_at(table, F.lower(words)), by_word)
