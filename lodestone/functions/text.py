"""Text functions as column expressions."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words of letters, digits and underscores in any script.
TOKEN = r"[\p{L}\p{N}_]+"
FENCE_MARK = "\u0001"


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))


def normalize(text: Column) -> Column:
    """Lower case, without marks, single blanks."""
    bare = F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}_\s]", "")
    return F.trim(F.regexp_replace(bare, r"\s+", " "))


def strip_code(text: Column) -> Column:
    """Fenced and inline code become blanks."""
    for pattern in (r"(?s)```.*?```", r"`[^`]*`", r"\s+"):
        text = F.regexp_replace(text, pattern, " ")
    return F.trim(text)


#: What cleaning removes, in order, as (pattern, replacement).
_MARKUP = [
    (r"<\{\s*IMAGE:[^}]+\s*\}>", ""),
    (r"(?m)^#{1,6}\s+", ""),
    (r"!\[[^\]]*\]\([^)]+\)", ""),
    (r"(?s)\*\*(.+?)\*\*", "$1"),
    (r"(?s)\*(.+?)\*", "$1"),
    (r"`([^`]+)`", "$1"),
    (r"\[([^\]]+)\]\([^)]+\)", "$1"),
    (r"<[^>]+>", ""),
    (r"\{[%{#][^}]*[%}#]\}", ""),
    (r"\{\{[^}]+\}\}", ""),
    (r"\n{3,}", "\n\n"),
]
_FENCES = r"(?s)```(\w+)\n(.*?)```|```\n?(.*?)```"


def clean_markup(text: Column) -> Column:
    """Markdown, tags and templates removed; fenced code kept with its language tag.

    Fences are cut out first and put back by place, so nothing inside them is touched; a fence
    without a tag is put back with its first line beside the opening marks.
    """
    fences = F.regexp_extract_all(text, F.lit(_FENCES), F.lit(0))
    plain = F.regexp_replace(text, _FENCES, FENCE_MARK)
    plain = reduce(lambda t, rule: F.regexp_replace(t, rule[0], rule[1]), _MARKUP, plain)
    parts = F.split(plain, FENCE_MARK, -1)

    def restored(fence: Column) -> Column:
        lang = F.regexp_extract(fence, _FENCES, 1)
        body = F.when(lang != "", F.regexp_extract(fence, _FENCES, 2)).otherwise(F.regexp_extract(fence, _FENCES, 3))
        body = F.regexp_replace(F.regexp_replace(body, r"^\s+", ""), r"\s+$", "")
        return F.concat(F.lit("```"), F.when(lang != "", F.concat(lang, F.lit("\n"))).otherwise(F.lit("")), body, F.lit("\n```"))

    back = F.transform(fences, restored)
    joined = F.zip_with(parts, back, lambda p, f: F.concat(F.coalesce(p, F.lit("")), F.coalesce(f, F.lit(""))))
    return F.regexp_replace(F.regexp_replace(F.array_join(joined, ""), r"^\s+", ""), r"\s+$", "")


def page_text(html: Column) -> Column:
    """Visible text of a page: no scripts, styles, comments or tags; common entities decoded."""
    for pattern in (r"(?is)<script.*?</script>", r"(?is)<style.*?</style>", r"(?s)<!--.*?-->", r"<[^>]*>"):
        html = F.regexp_replace(html, pattern, " ")
    for entity, mark in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&nbsp;", " "), ("&middot;", "·"), ("&copy;", "©"), ("&amp;", "&")):
        html = F.replace(html, F.lit(entity), F.lit(mark))
    return F.trim(F.regexp_replace(html, r"\s+", " "))


#: Fixed value: what counts as a URL-like run.
_URL_LIKE = r"https?://|(?:[a-z0-9_-]+\.){2,}[a-z]{2,}(?:[/:.@][\w.-]*)*"


def expand_urls(text: Column) -> Column:
    """Within URL-like runs, the marks / : . @ become blanks."""
    found = F.regexp_extract_all(text, F.lit(f"({_URL_LIKE})"), F.lit(1))
    between = F.split(F.regexp_replace(text, _URL_LIKE, FENCE_MARK), FENCE_MARK, -1)
    opened = F.transform(found, lambda u: F.translate(u, "/:.@", "    "))
    return F.array_join(F.zip_with(between, opened, lambda p, u: F.concat(F.coalesce(p, F.lit("")), F.coalesce(u, F.lit("")))), "")


def word_match(signal: str, text: Column) -> Column:
    """A signal of up to three characters as a whole word, a longer one anywhere."""
    if len(signal) <= 3:
        quoted = "".join("\\" + c if not c.isalnum() else c for c in signal)
        return text.rlike(rf"(?U)\b{quoted}\b")
    return text.contains(signal)


def any_signal(signals: list[str], text: Column) -> Column:
    return reduce(lambda a, b: a | b, [word_match(s, text) for s in signals], F.lit(False))


def snippet(text: Column, term: Column, around: int = 150) -> Column:
    """Up to ``around`` characters on both sides of the first place of a term, line ends as blanks."""
    at = F.position(F.lower(term), F.lower(text))
    start = F.greatest(at - around, F.lit(1))
    return F.when(at > 0, F.translate(F.substring(text, start, at - start + F.length(term) + around), "\n", " "))


def section_key(section: Column) -> Column:
    """module-<n> of a section name, else the name."""
    found = F.regexp_extract(section, r"^(module-\d+)", 1)
    return F.when(found != "", found).otherwise(section)


def composite_key(*parts: Column) -> Column:
    return F.concat_ws("::", *[F.coalesce(p.cast("string"), F.lit("unknown")) for p in parts])


def slug(name: Column) -> Column:
    return F.translate(name, "/-.", "___")


def short_name(name: Column) -> Column:
    return F.element_at(F.split(name, "/", -1), -1)


def text_bar(value: Column, top: Column, width: int = 30) -> Column:
    return F.repeat(F.lit("#"), F.when(top > 0, F.floor(value / top * width)).otherwise(F.lit(0)).cast("int"))


def encode_text(question: Column, answer: Column, mode: str) -> Column:
    """The text that is embedded: question, qa or answer."""
    return {"question": question, "qa": F.concat_ws(" ", question, answer), "answer": answer}[mode]


def collection_name(base: str, mode: str) -> str:
    return base + {"question": "", "qa": "_qa", "answer": "_answer"}[mode]


def uuid5_dns(name: Column) -> Column:
    """Name-based UUID (version 5) in the DNS namespace."""
    digest = F.sha1(F.concat(F.unhex(F.lit("6ba7b8109dad11d180b400c04fd430c8")), F.encode(name, "UTF-8")))
    variant = F.lower(F.hex(F.conv(F.substring(digest, 17, 2), 16, 10).cast("int").bitwiseAND(F.lit(0x3F)).bitwiseOR(F.lit(0x80))))
    return F.concat_ws("-", F.substring(digest, 1, 8), F.substring(digest, 9, 4), F.concat(F.lit("5"), F.substring(digest, 14, 3)), F.concat(F.lpad(variant, 2, "0"), F.substring(digest, 19, 2)), F.substring(digest, 21, 12))


def index_id(name: Column) -> Column:
    """A UUID stays (lower case); any other id becomes its name-based UUID."""
    is_uuid = F.lower(name).rlike(r"^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$")
    return F.when(is_uuid, F.lower(name)).otherwise(uuid5_dns(name))


def strip_accents(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Iterator form for a pandas UDF: decomposed, without combining marks."""
    for s in parts:
        yield s.str.normalize("NFKD").str.replace(r"[̀-ͯ]", "", regex=True)


def unaccented(text: Column) -> Column:
    return F.pandas_udf(strip_accents, "string")(text)


def fenced_json(reply: Column) -> Column:
    """JSON of a model's reply: the body of a fence, else the last line that starts with a brace."""
    fenced = F.regexp_extract(reply, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1)
    lines = F.filter(F.split(reply, "\n", -1), lambda x: F.trim(x).startswith("{"))
    return F.when(fenced != "", fenced).otherwise(F.try_element_at(lines, F.lit(-1)))


#: Openings that answers lose, in sequence.
_OPENINGS = [r"^To resolve this issue:\s*\n?", r"^To fix this:\s*\n?", r"^Solution:\s*\n?"]


def strip_openings(answer: Column) -> Column:
    for pattern in _OPENINGS:
        answer = F.regexp_replace(answer, pattern, "")
    return F.regexp_replace(F.regexp_replace(answer, r"^\s+", ""), r"\s+$", "")


def signature(style: Column, tier: Column, name: Column) -> Column:
    return F.concat_ws("__", style, tier, name)


def parse_signature(value: Column) -> Column:
    """struct(style, tier, base) of a__b__c_<n>; the last underscore part of c is dropped."""
    parts = F.split(value, "__", -1)
    return F.struct(parts[0].alias("style"), parts[1].alias("tier"), F.regexp_extract(parts[2], r"^(.*)_[^_]*$", 1).alias("base"))
