"""Column functions for free text."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from marquee.fixed_values import ROUTING_KEYWORDS, STOP_WORDS, SUMMARY_PROMPT, SUMMARY_PROMPT_NO_SPOILER
from marquee.functions.labels import strip


def clean_text(col: Column) -> Column:
    """Lower case without tags, digits and punctuation, single blanks; null gives an empty string."""
    bare = F.regexp_replace(F.lower(col), "<[^>]+>", "")
    letters = F.regexp_replace(bare, r"[^a-z\s]", "")
    return F.coalesce(F.trim(F.regexp_replace(letters, r"\s+", " ")), F.lit(""))


def keep_tokens(
    col: Column, stop_words: list[str] = STOP_WORDS, lemmas: dict[str, str] | None = None, min_length: int = 3
) -> Column:
    """Alphabetic tokens of ``min_length`` or more that are no stop words, joined by blanks."""
    tokens = F.filter(
        F.split(col, r"\s+"),
        lambda t: (F.length(t) >= min_length) & F.rlike(t, F.lit("^[a-z]+$")) & ~t.isin(stop_words),
    )
    if lemmas:
        known = F.create_map(*[F.lit(x) for pair in lemmas.items() for x in pair])
        tokens = F.transform(tokens, lambda t: F.coalesce(F.try_element_at(known, t), t))
    return F.array_join(tokens, " ")


def accent_table() -> tuple[str, str]:
    """Latin letters with marks and the letters they stand on, from Unicode decomposition."""
    marked, plain = [], []
    for code in [*range(0x00C0, 0x0250), *range(0x1E00, 0x1F00)]:
        base = "".join(c for c in unicodedata.normalize("NFKD", chr(code)) if not unicodedata.combining(c))
        if len(base) == 1 and base != chr(code):
            marked.append(chr(code))
            plain.append(base)
    return "".join(marked), "".join(plain)


def strip_accents(col: Column) -> Column:
    marked, plain = accent_table()
    combining = "".join(chr(c) for c in range(0x0300, 0x0370))
    # characters of the first list without a partner in the second are dropped
    return F.translate(col, marked + combining, plain)


def word_tokens(col: Column, stop_words: list[str] = STOP_WORDS) -> Column:
    """Lower-cased, accent-free words of two characters or more, stop words left out."""
    words = F.regexp_extract_all(strip_accents(F.lower(col)), F.lit(r"[\p{L}\p{N}_]{2,}"), F.lit(0))
    return F.filter(words, lambda t: ~t.isin(stop_words)) if stop_words else words


def word_count(col: Column) -> Column:
    """Number of blank-separated words; null and blank text have none."""
    return F.when(F.length(strip(col)) > 0, F.size(F.split(strip(col), r"\s+"))).otherwise(0)


def embedding_text(title: Column, director: Column, genre: Column, year: Column, plot: Column) -> Column:
    parts = [
        F.lit("The movie titled '"), title, F.lit("' was directed by "), director,
        F.lit(". It falls under the '"), genre, F.lit("' genres and was released in "), year.cast("string"),
        F.lit(". Plot summary: "), F.substring(plot, 1, 1000),
    ]
    return F.concat(*[F.coalesce(p, F.lit("")) for p in parts])


def credits_text(title: Column, director: Column, cast_names: Column) -> Column:
    parts = [F.lit("Title: "), title, F.lit(" Director: "), director, F.lit(" Cast: "), cast_names]
    return F.concat(*[F.coalesce(p, F.lit("")) for p in parts])


def truncate(col: Column, length: int) -> Column:
    return F.when(F.length(col) > length, F.concat(F.substring(col, 1, length), F.lit("..."))).otherwise(col)


def highlight(col: Column, entity: Column) -> Column:
    """Every occurrence of ``entity`` in any case, replaced by ``**entity**``."""
    literal = F.regexp_replace(entity, r"([\\.\[\]{}()*+?^$|-])", r"\\$1")
    with_marks = F.concat(F.lit("**"), F.regexp_replace(entity, r"([\\$])", r"\\$1"), F.lit("**"))
    marked = F.regexp_replace(col, F.concat(F.lit("(?iu)"), literal), with_marks)
    return F.when(F.length(entity) > 0, marked).otherwise(col)


def summary_prompt(title: Column, plot: Column, max_tokens: int, non_spoiler: bool = True) -> Column:
    text = (SUMMARY_PROMPT_NO_SPOILER if non_spoiler else SUMMARY_PROMPT).replace("{words}", str(max_tokens // 2))
    head, rest = text.split("{title}")
    middle, tail = rest.split("{plot}")
    return F.concat(F.lit(head), title, F.lit(middle), plot, F.lit(tail))


def summarize_input(title: Column, plot: Column) -> Column:
    titled = F.concat(F.lit("summarize: "), title, F.lit(": "), plot)
    return F.when(F.length(title) > 0, titled).otherwise(F.concat(F.lit("summarize: "), plot))


def transcript(messages: Column) -> Column:
    """Chat text of an array of (role, text) in order, open for the assistant's answer."""
    def line(m: Column) -> Column:
        known = m["role"].isin("system", "user", "assistant")
        return F.when(known, F.concat(F.lit("["), F.initcap(m["role"]), F.lit("]\n"), strip(m["text"]), F.lit("\n\n"))).otherwise("")
    return F.concat(F.array_join(F.transform(messages, line), ""), F.lit("[Assistant]\n"))


def has_keyword(col: Column, keywords: list[str] = ROUTING_KEYWORDS) -> Column:
    """Whether any keyword is part of the lower-cased text."""
    pattern = "|".join(re.escape(k) for k in keywords)
    return F.coalesce(F.rlike(F.lower(col), F.lit(pattern)), F.lit(False))


def safe_name(col: Column) -> Column:
    return F.translate(F.lower(col), " -", "__")


def guarded_summary(summary: Column, plot: Column, length: int = 200) -> Column:
    """The summary, or the cut plot where the summary is missing, too short or echoes the prompt."""
    text = strip(summary)
    poor = text.isNull() | (F.length(text) < 10) | F.startswith(F.lower(text), F.lit("summarize"))
    return F.when(poor, truncate(plot, length)).otherwise(text)


def matches_entities(field: Column, entities: Column) -> Column:
    """Whether any wanted entity is part of the field; no wanted entities means yes."""
    wanted = F.exists(entities, lambda e: F.contains(F.lower(F.coalesce(field, F.lit(""))), F.lower(e)))
    return F.coalesce(F.size(entities) <= 0, F.lit(True)) | F.coalesce(wanted, F.lit(False))


def any_field_contains(fields: list[Column], query: Column) -> Column:
    found = F.lit(False)
    for field in fields:
        found = found | F.coalesce(F.contains(F.lower(field), F.lower(query)), F.lit(False))
    return found
