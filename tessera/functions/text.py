"""Column functions for text, URLs and record checks. All are Catalyst expressions: no Python per row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Word lists and patterns of the checks.
STOP_WORDS = ("the", "and", "for", "with", "that", "this", "from", "are", "was", "were", "has", "had", "have", "not", "but", "its", "their", "which", "than", "been", "will", "can", "all", "one", "two")
POSITIVE = ("better", "calmer", "even", "lower", "fewer", "careful", "steady", "shared")
NEGATIVE = ("failed", "doubt", "backlog", "gap", "rough", "late", "waste", "rise")
GENERIC_TITLES = (r"^untitled\s*$", r"^no\s+title\s*$", r"^home\s*[|\-–]", r"^\s*$", r"^document\s*$", r"^page\s+\d+\s*$")
GENERIC_QUESTIONS = (
    r"^what\s+is\s+this\s+(article|document|page|text|post)\s+about",
    r"^what\s+does\s+this\s+(article|document|page|text|post)\s+(say|discuss|cover|contain|describe)",
    r"^(can\s+you\s+)?summarize\s+this",
    r"^tell\s+me\s+about\s+this",
    r"^what\s+are\s+the\s+(main\s+)?(topics?|points?|themes?|subjects?)\s+(in|of|covered)",
    r"^what\s+information\s+is\s+(provided|given|contained)",
)
BOILERPLATE = (
    r"accept all", r"reject optional", r"cookies", r"enable javascript", r"access denied", r"page not found", r"subscribe to", r"sign in", r"privacy choices", r"terms of use", r"all rights reserved", r"too many requests",
)
LANGUAGE_WORDS = {
    "de": ("der", "die", "und", "das", "nicht", "mit", "ist", "ein", "eine", "von", "auf", "für", "sich", "dem", "den", "wurde", "nach", "bei", "aus", "wird"),
    "en": ("the", "and", "of", "to", "in", "is", "was", "that", "for", "with", "by", "were", "on", "are", "from", "which", "after", "at", "it", "as"),
    "es": ("el", "la", "los", "las", "de", "que", "y", "en", "una", "por", "con", "del", "se", "para", "fue", "no", "al", "su", "como", "más"),
    "fr": ("le", "la", "les", "des", "et", "est", "une", "dans", "que", "pour", "par", "sur", "du", "au", "avec", "ne", "pas", "qui", "sont", "ont"),
}
PII = {"email": r"[\w.+-]+@[\w-]+\.[\w.-]+", "ssn": r"\b\d{3}-\d{2}-\d{4}\b", "card": r"\b\d{4}[ -]\d{4}[ -]\d{4}[ -]\d{4}\b", "phone": r"\b\d{3}[-.]\d{3}[-.]\d{4}\b"}


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def language(text: Column) -> Column:
    """The language whose frequent words come most often in the whole text (of equal ones the last by name); null where none comes."""
    t = tokens(text)
    count = lambda own: F.size(F.filter(t, lambda x: x.isin(*own)))
    best = F.greatest(*[F.struct(count(own).alias("n"), F.lit(name).alias("l")) for name, own in LANGUAGE_WORDS.items()])
    return F.when(best["n"] > 0, best["l"])


def term_set(text: Column) -> Column:
    """Distinct terms longer than two characters, split at white space, hyphens, slashes, dots, commas, underscores."""
    return F.array_distinct(F.filter(F.split(F.lower(text), r"[\s\-_/.,]+"), lambda x: F.length(x) > 2))


def normalize_url(url: Column) -> Column:
    """Trimmed, without ``www.``, ``utm_`` parameters and trailing slash. (A true prefix is stripped, not a set of characters.)"""
    u = F.regexp_replace(F.trim(url), r"^(https?://)www\.", "$1")
    u = F.regexp_replace(u, r"([?&])utm_[^&#]*", "$1")
    u = F.regexp_replace(F.regexp_replace(u, r"&&+", "&"), r"[?]&+", "?")
    u = F.regexp_replace(F.regexp_replace(u, r"[?&]+#", "#"), r"[?&]+$", "")
    return F.regexp_replace(u, r"/+$", "")


def doc_uuid(url: Column) -> Column:
    """Version 5 UUID of a normalised URL in the URL namespace."""
    h = F.sha1(F.concat(F.unhex(F.lit("6ba7b8119dad11d180b400c04fd430c8")), F.encode(url, "UTF-8")))
    variant = F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(3).bitwiseOR(8)
    return F.concat_ws(
        "-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(F.lower(F.hex(variant)), F.substring(h, 18, 3)), F.substring(h, 21, 12)
    )


def url_host(url: Column) -> Column:
    return F.regexp_extract(F.lower(F.trim(url)), r"^[a-z]+://([^/?#:]+)", 1)


def type_bucket(url: Column, source: Column) -> Column:
    """youtube, podcast, pdf, document or website."""
    u, s = F.lower(F.coalesce(url, F.lit(""))), F.lower(F.coalesce(source, F.lit("")))
    return (
        F.when(u.contains("youtube.") | u.contains("youtu.be"), "youtube")
        .when(s.contains("podcast") | s.contains("radio") | s.contains("signal"), "podcast")
        .when(u.rlike(r"\.pdf($|[?#])"), "pdf")
        .when(u.rlike(r"\.(docx?|xlsx?|pptx?|txt)($|[?#])") | s.contains("upload"), "document")
        .otherwise("website")
    )


def tool_bucket(source: Column) -> Column:
    """The tool a source came in by, from its name."""
    s = F.lower(F.coalesce(source, F.lit("")))
    return F.when(s.like("%forum%"), "forum").when(s.like("%upload%"), "upload").when(s.like("%radio%") | s.like("%signal%"), "audio").otherwise("rss")


def words_of(text: Column) -> Column:
    """Words split at Unicode white space."""
    return F.filter(F.split(text, r"(?U)\s+"), lambda x: x != "")


def letter_share(text: Column) -> Column:
    n = F.length(text)
    return F.when(n > 0, F.length(F.regexp_replace(text, r"[^\p{L}]", "")) / n).otherwise(F.lit(0.0))


def noise_share(text: Column) -> Column:
    n = F.length(text)
    return F.when(n > 0, F.length(F.regexp_replace(text, r"(?U)[\p{L}\p{N}\s]", "")) / n).otherwise(F.lit(0.0))


def repeated_line_share(text: Column) -> Column:
    """1 - distinct/all of the lines that aren't blank; 0 for fewer than ten."""
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    return F.when(F.size(lines) >= 10, 1 - F.size(F.array_distinct(lines)) / F.size(lines)).otherwise(F.lit(0.0))


def content_gate(body: Column, title: Column) -> Column:
    """The first reason to reject a record, or ok."""
    b = F.trim(F.coalesce(body, F.lit("")))
    head = F.lower(F.substring(b, 1, 200))
    boiler = F.lit(False)
    for p in BOILERPLATE:
        boiler = boiler | head.rlike(p)
    generic = F.lit(False)
    t = F.trim(F.coalesce(title, F.lit("")))
    for p in GENERIC_TITLES:
        generic = generic | F.lower(t).rlike(p)
    return (
        F.when(F.length(b) < 200, "too_short").when(F.length(b) > 5_000_000, "too_long").when(F.size(words_of(b)) < 40, "too_few_words").when(boiler, "boilerplate")
        .when(letter_share(b) < 0.5, "not_alphabetic").when(noise_share(b) > 0.35, "noisy").when(repeated_line_share(b) > 0.6, "repetitive")
        .when(F.length(t) < 3, "no_title").when(generic, "generic_title").otherwise("ok")
    )


def enrich_flags(summary: Column, body: Column, questions: Column) -> Column:
    """All flags of an enrichment."""
    s, n = F.coalesce(summary, F.lit("")), F.size(questions)
    flags = F.array(
        F.when(F.length(s) < 50, "summary_short"),
        F.when(F.length(s) > 5000, "summary_long"),
        F.when((F.length(s) >= 150) & F.startswith(F.coalesce(body, F.lit("")), F.substring(s, 1, 150)), "body_bleed"),
        F.when(n < 2, "few_questions"),
        F.when(n > 20, "many_questions"),
        F.when(F.exists(questions, lambda q: F.length(q) < 15), "short_question"),
        F.when(F.exists(questions, lambda q: F.lower(q).rlike("|".join(GENERIC_QUESTIONS))), "generic_question"),
        F.when(F.size(F.array_distinct(F.transform(questions, lambda q: F.lower(q)))) < n, "duplicate_question"),
    )
    return F.filter(flags, lambda x: x.isNotNull())


def quality_score(body: Column, keywords: Column, entities: Column, questions: Column, summary: Column) -> Column:
    """0 to 100 from body length, keywords, entities, questions and summary."""
    n, s = F.length(F.coalesce(body, F.lit(""))), F.length(F.coalesce(summary, F.lit("")))
    step = lambda c, *pairs: _ladder(c, pairs)
    return F.least(
        F.lit(100),
        step(n, (3000, 35), (1500, 28), (800, 20), (300, 10)) + step(F.size(keywords), (8, 20), (5, 15), (3, 10), (1, 5)) + step(F.size(entities), (5, 20), (3, 15), (1, 8))
        + step(F.size(questions), (5, 15), (3, 12), (1, 6)) + step(s, (200, 10), (100, 7), (40, 4)),
    )


def _ladder(c: Column, pairs) -> Column:
    out = F.when(c >= pairs[0][0], pairs[0][1])
    for least, points in pairs[1:]:
        out = out.when(c >= least, points)
    return out.otherwise(0)


def sentiment(text: Column) -> Column:
    """(positive - negative) / (positive + negative) words, 0 without any."""
    t = tokens(text)
    p = F.size(F.filter(t, lambda x: x.isin(*POSITIVE)))
    n = F.size(F.filter(t, lambda x: x.isin(*NEGATIVE)))
    return F.when(p + n > 0, F.round((p - n) / (p + n), 4)).otherwise(F.lit(0.0))


def lead_summary(text: Column, most: int = 500) -> Column:
    """Whole leading sentences up to ``most`` characters, else the first ``most``."""
    parts = F.split(F.trim(text), r"(?<=[.!?])\s+")
    lead = F.aggregate(
        parts,
        F.struct(F.lit("").alias("s"), F.lit(False).alias("full")),
        lambda acc, x: F.when(acc["full"], acc)
        .when(F.length(acc["s"]) + F.length(x) + F.when(acc["s"] == "", 0).otherwise(1) <= most, F.struct(F.when(acc["s"] == "", x).otherwise(F.concat(acc["s"], F.lit(" "), x)).alias("s"), F.lit(False).alias("full")))
        .otherwise(F.struct(acc["s"].alias("s"), F.lit(True).alias("full"))),
        lambda acc: acc["s"],
    )
    return F.when(lead == "", F.substring(F.trim(text), 1, most)).otherwise(lead)


def pii_kinds(text: Column) -> Column:
    return F.filter(F.array(*[F.when(text.rlike(p), k) for k, p in PII.items()]), lambda x: x.isNotNull())


def error_class(message: Column) -> Column:
    m = F.lower(F.coalesce(message, F.lit("")))
    return (
        F.when(m.contains("validation"), "validation").when(m.contains("429") | m.contains("rate limit"), "rate_limit").when(m.contains("timeout") | m.contains("timed out"), "timeout")
        .when(m.contains("parse") | m.contains("json"), "parse").otherwise("unknown")
    )


def duration_seconds(text: Column) -> Column:
    """Seconds of S, MM:SS or HH:MM:SS; null for other forms."""
    p = F.split(F.trim(text), ":")
    n = lambda i: F.get(p, F.lit(i)).cast("long")
    ok = text.rlike(r"^\s*\d+(:\d{1,2}){0,2}\s*$")
    return F.when(ok & (F.size(p) == 1), n(0)).when(ok & (F.size(p) == 2), n(0) * 60 + n(1)).when(ok & (F.size(p) == 3), n(0) * 3600 + n(1) * 60 + n(2))


def paywall_class(paywall: Column, body: Column) -> Column:
    n = F.length(F.regexp_replace(F.coalesce(body, F.lit("")), r"^\s+|\s+$", ""))
    return F.when(paywall == "none", "normal").when(n == 0, "terminal_no_body").when(n < 500, "terminal_stub").otherwise("enrich_normal")


def video_id(url: Column) -> Column:
    """The id in a video address (watch, short, embed and shorts forms); empty otherwise."""
    return F.coalesce(
        F.nullif(F.regexp_extract(url, r"youtube\.[a-z]+/watch\?(?:[^#]*&)?v=([\w-]{11})", 1), F.lit("")), F.nullif(F.regexp_extract(url, r"youtu\.be/([\w-]{11})", 1), F.lit("")),
        F.nullif(F.regexp_extract(url, r"youtube\.[a-z]+/(?:embed|shorts|live)/([\w-]{11})", 1), F.lit("")), F.lit(""),
    )


def published_in_url(url: Column) -> Column:
    """yyyy-mm-dd from a dated path (year 2000 to 2030; the first of the month where no day is given), else null."""
    y, m = F.regexp_extract(url, r"/(20[0-3]\d)/(0[1-9]|1[0-2])(?:/|$)", 1), F.regexp_extract(url, r"/(20[0-3]\d)/(0[1-9]|1[0-2])(?:/|$)", 2)
    d = F.regexp_extract(url, r"/20[0-3]\d/(?:0[1-9]|1[0-2])/([0-2]\d|3[01])(?:/|$)", 1)
    return F.when((y != "") & (y <= "2030"), F.concat_ws("-", y, m, F.when(d == "", "01").otherwise(d)))
