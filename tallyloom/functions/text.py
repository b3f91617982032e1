"""Text scalars as column expressions; pandas UDFs only where Spark has no equal."""

from __future__ import annotations

import html
import unicodedata
from collections import Counter
from difflib import SequenceMatcher
from urllib.parse import quote

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Title rules as (code, pattern).
SAFETY_RULES = (
    ("source_title_nsfw_marker", "(?<![ㄱ-ㅎ])(?:ㅇㅎㅂ|ㅇㅎ|ㅎㅂ)(?![ㄱ-ㅎ])"),
    ("sexual_title", "비키니|ㅂㅋㄴ|섹스|성관계|야동|젖꼭지|알몸|성인물"),
    ("graphic_or_death_title", "총살|처형|참수|시신|시체|자살|고문|성폭행"),
    ("private_allegation_title", "불륜|성추행|몰카|강간"),
)
# Sections by the first pattern that a category matches.
SECTION_RULES = (
    ("웹툰", "웹툰산업"),
    ("정치|정책", "정치·정책"),
    ("경제|금리|환율|증시|금융|부동산", "경제·생활경제"),
    ("반도체|기술|과학|AI|IT", "과학·기술"),
    ("국제|외교|안보", "국제정세"),
    ("생활|안전|날씨|기상|재난", "생활·안전"),
    ("사회|보건|교육|노동", "사회이슈"),
)


# Units after a number in records and in overviews; limits of an overview's phrases.
NUMBER_UNITS = "%p|%|배|억원|조원|억달러|만달러|달러|원|명|건|곳|장|TB"
OVERVIEW_UNITS = "%포인트|%p|%|배|조달러|억달러|달러|억원|조원|원"
LEAD_LENGTH, PHRASE_LENGTH, MOST_PHRASES = 65, 55, 4
PAST_PREFIX, RECORD_PREFIX = "당시 ", "주요 기록: "
# Hosts of the two networks, and their labels.
SOCIAL_HOSTS = {"instagram.com": "인스타", "x.com": "X", "twitter.com": "X"}
# What readers are told of a source's scope.
SCOPE_INSTAGRAM = "인스타 공개 인기 · 보조 자료 (한국 지역 순위 아님)"
SCOPE_X_KOREA = "X 한국 지역 트렌드 확인"
SCOPE_X = "X 공개 자료 · 한국 지역 트렌드 미확인"

#: White space as text is cut at it, in Spark and in SQL alike: Unicode's, and the four ASCII separators.
WHITE = r"[\x{9}-\x{D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"

#: White space as scripts of pages know it.
PAGE_WHITE = r"[\x{9}-\x{D}\x{20}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"


def normalized(t: Column) -> Column:
    """Lower case, only digits, Latin letters and Hangul syllables."""
    return F.regexp_replace(F.lower(t), "[^0-9a-z가-힣]", "")


@F.pandas_udf(T.StringType())
def normalize_title(t: pd.Series) -> pd.Series:
    """NFC, casefold, single spaces."""
    return t.map(lambda v: " ".join(unicodedata.normalize("NFC", v or "").casefold().split()))


@F.pandas_udf(T.StringType())
def nfc(t: pd.Series) -> pd.Series:
    return t.map(lambda v: None if v is None else unicodedata.normalize("NFC", v))


@F.pandas_udf(T.DoubleType())
def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """The matching-blocks ratio; the order of the arguments matters."""
    return pd.Series([None if x is None or y is None else SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)], dtype="float64")


def similarity_bound(a: str, b: str) -> float:
    """The ratio can't exceed this: matched characters are common to both multisets, and so are all but one of the neighbours
    in each of the runs that they come in."""
    total = len(a) + len(b)
    common = sum((Counter(a) & Counter(b)).values())
    if not total:
        return 1.0
    neighbours = sum((Counter(zip(a, a[1:])) & Counter(zip(b, b[1:]))).values())
    return 2.0 * min(common, (neighbours + total + 1) // 3) / total


def similarity_from(least: float):
    """A UDF for :func:`similarity` that gives null where bounds show that it is below ``least``, or where it is."""

    @F.pandas_udf(T.DoubleType())
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        out, matcher, held = [], SequenceMatcher(None), None
        for x, y in zip(a, b):
            ratio = None
            if x is not None and y is not None and similarity_bound(x, y) >= least:
                if y != held:  # what is known of the second text serves for all of its partners
                    matcher.set_seq2(y)
                    held = y
                matcher.set_seq1(x)
                ratio = matcher.ratio()
            out.append(ratio if ratio is not None and ratio >= least else None)
        return pd.Series(out, dtype="float64")

    return run


@F.pandas_udf(T.StringType())
def decode_entities(t: pd.Series) -> pd.Series:
    return t.map(lambda v: None if v is None else html.unescape(v))


@F.pandas_udf(T.StringType())
def encode_unicode(u: pd.Series) -> pd.Series:
    """Percent-encode what isn't ASCII, leave reserved characters and escapes alone."""
    return u.map(lambda v: None if v is None else quote(v, safe=":/?#[]@!$&'()*+,;=%"))


def fingerprint(facts: Column) -> Column:
    """SHA-256 of a map's normalised keys and values in key order."""
    entries = F.array_sort(F.transform(F.map_entries(facts), lambda e: F.struct(normalized(e["key"]).alias("key"), normalized(e["value"]).alias("value"))))
    return F.sha2(F.to_json(F.transform(entries, lambda e: F.array(e["key"], e["value"]))), 256)


def record_digest(*columns: str) -> Column:
    """SHA-256 of the named columns as JSON, in name order."""
    return F.sha2(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}), 256)


def digest_sums(digest: Column) -> list[Column]:
    """Aggregates that stand for a multiset of SHA-256 digests in any order: sums of their parts of 60 bits, with map-side combining."""
    return [F.sum(F.conv(F.substring(digest, 1 + 15 * i, 15), 16, 10).cast("decimal(20,0)")).cast("string").alias(f"digest_{i}") for i in range(4)]


def sums_digest(count: str) -> Column:
    """The digest of the multiset that :func:`digest_sums` stands for, and of its size."""
    return F.sha2(F.concat_ws(" ", count, *(f"digest_{i}" for i in range(4))), 256)


def literal_count(t: Column, c: str) -> Column:
    """Occurrences of a character as written, without Unicode folding."""
    return (F.length(t) - F.length(F.replace(t, F.lit(c), F.lit("")))) / len(c)


def words(t: Column) -> Column:
    """Words between white space of ``WHITE``."""
    return F.filter(F.split(t, WHITE + "+"), lambda w: w != "")


def short_title(t: Column, most: int = 25) -> Column:
    """The first words of a title."""
    return F.array_join(F.slice(words(t), 1, most), " ")


def is_truncated(t: Column, most: int = 25) -> Column:
    return F.size(words(t)) > most


def quoted_words(texts: Column) -> Column:
    """Words in the distinct texts of an array: a page's quotation budget."""
    return F.aggregate(F.array_distinct(texts), F.lit(0), lambda n, t: n + word_count(t))


def word_count(t: Column) -> Column:
    """How many :func:`words` a text has; within lambdas, a split would compile its pattern for every text."""
    return F.regexp_count(t, F.lit("[^" + WHITE[1:] + "+"))


def phrases_occur(phrases: Column, paragraphs: Column, least: int, most: int) -> Column:
    """Between ``least`` and ``most`` phrases, each within some paragraph, and none of them blank."""
    filled = lambda p: p.rlike("[^" + WHITE[1:])
    return F.size(phrases).between(least, most) & F.forall(phrases, lambda p: filled(p) & F.exists(paragraphs, lambda t: F.contains(t, p)))


def classify_title(t: Column, rules=SAFETY_RULES) -> Column:
    """Every rule that matches, as (code, matched text)."""
    tried = F.array(*(F.struct(F.lit(c).alias("code"), F.regexp_extract(t, p, 0).alias("matched")) for c, p in rules))
    return F.filter(tried, lambda h: h["matched"] != "")


def has_tag(t: Column) -> Column:
    """A retired tag that stands alone, zero-width spaces ignored. Pass the text through :func:`nfc` first."""
    return F.coalesce(F.regexp_replace(t, "​", "").rlike(SAFETY_RULES[0][1]), F.lit(False))


def is_unsafe(t: Column, rules=SAFETY_RULES) -> Column:
    """Any of the rules."""
    return F.coalesce(t.rlike("|".join(p for _, p in rules)), F.lit(False))


def section(category: Column, rules=SECTION_RULES) -> Column:
    """The first section whose pattern the category matches, else null."""
    out = F.lit(None).cast("string")
    for pattern, name in reversed(rules):
        out = F.when(category.rlike(pattern), name).otherwise(out)
    return out


def bracket_prefix(t: Column) -> Column:
    """The text without a leading ``[tag]`` and a trailing source note."""
    return F.trim(F.regexp_replace(F.regexp_replace(t, r"^\[[^\]]+\]\s*", ""), r"\s*확인:.*$", ""))


def source_names(t: Column) -> Column:
    """The names after the source note's cue, without the final stop; null without a note."""
    return F.nullif(F.regexp_extract(t, r"확인:\s*(.*?)\.?$", 1), F.lit(""))


def number_tokens(t: Column, units: str = NUMBER_UNITS, most: int = 6, ranges: bool = True) -> Column:
    """Numbers with a unit, at most ``most``, in order: a sign or none, digits grouped by commas and points, the unit.

    With ``ranges`` a number may end in a tilde and a second one; without, only the number next to the unit counts."""
    sign, digits = "[+−-]?", r"\d[\d,.]*"
    number = sign + digits + (r"(?:~[\d,.]+)?" if ranges else "")
    return F.slice(F.regexp_extract_all(t, F.lit(f"({number}(?:{units}))"), F.lit(1)), 1, most)


def emphasis_parts(t: Column, phrases: list[str]) -> Column:
    """Text cut at phrases, longest first where two start together: array of (text, bold)."""
    named = sorted({p for p in phrases if p}, key=lambda p: (-len(p), p))
    if not named:
        return F.filter(F.array(F.struct(t.alias("text"), F.lit(False).alias("bold"))), lambda s: s["text"] != "")
    escaped = "|".join("\\Q" + p + "\\E" for p in named)
    marked = F.split(F.regexp_replace(t, f"({escaped})", "\u0001$1\u0002"), "(?=\u0001)|(?<=\u0002)")
    parts = F.transform(marked, lambda s: F.struct(F.regexp_replace(s, "[\u0001\u0002]", "").alias("text"), s.startswith("\u0001").alias("bold")))
    return F.filter(parts, lambda s: s["text"] != "")


def overview_phrases(paragraph: Column, candidates: Column, editorial: Column) -> Column:
    """Phrases of a paragraph to stress: those of the editor that it holds; failing them, what it offers itself.

    That is its opening sentence where short and not of the past, short candidates that it holds, and its numbers (of a range, the
    last). Candidates and offers are one list of (phrase, allowed), filtered once, so each rule stands by its phrase. A blank phrase takes a
    place among those chosen, and is dropped at last.
    """
    held = lambda phrases: F.filter(F.coalesce(phrases, F.array().cast("array<string>")), lambda p: F.contains(paragraph, p))
    opening = F.regexp_extract(paragraph, r"^(?s)(.*?[.!?。])" + PAGE_WHITE, 1)
    opening = F.when(opening == "", paragraph).otherwise(opening)
    short = F.filter(held(candidates), lambda p: F.length(p) <= PHRASE_LENGTH)
    stated = number_tokens(paragraph, OVERVIEW_UNITS, MOST_PHRASES, ranges=False)
    offer = lambda phrase, allowed: F.struct(phrase.alias("phrase"), allowed.alias("allowed"))
    yes = F.lit(True)
    lead = offer(F.regexp_replace(opening, "^" + RECORD_PREFIX, ""), (F.length(opening) <= LEAD_LENGTH) & ~paragraph.startswith(PAST_PREFIX))
    offers = F.concat(F.array(lead), F.transform(F.slice(short, 1, MOST_PHRASES), lambda p: offer(p, yes)), F.transform(stated, lambda p: offer(p, yes)))
    own = F.transform(F.filter(offers, lambda o: o["allowed"]), lambda o: o["phrase"])
    return F.array_distinct(F.filter(F.when(F.size(held(editorial)) > 0, held(editorial)).otherwise(own), lambda p: p != ""))


def _escaped(t: Column) -> Column:
    """Characters beyond ASCII percent-encoded, the others as they are."""
    points = F.regexp_extract_all(t, F.lit("(?s)(.)"), F.lit(1))
    return F.array_join(F.transform(points, lambda c: F.when(c.rlike(r"[^\x00-\x7F]"), F.regexp_replace(F.hex(F.encode(c, "UTF-8")), "(..)", "%$1")).otherwise(c)), "")


def social_links(t: Column) -> Column:
    """Distinct links to the hosts of ``SOCIAL_HOSTS`` and their subdomains in a text, as (label, url), in order.

    A link begins at its scheme or its host, wherever the sign before is none that a longer host, an address or a word would have there:
    so after a colon, within brackets, or after Hangul. It ends at the host, or with what follows it up to white space, a quote or an angle
    bracket, less closing signs. URLs have their scheme and host in lower case, a path of at least a slash, and escapes for what isn't ASCII.
    """
    inside = "[A-Za-z0-9_.-]"
    label = F.create_map(*(F.lit(v) for pair in SOCIAL_HOSTS.items() for v in pair))
    hosts = "|".join(h.replace(".", "[.]") for h in SOCIAL_HOSTS)
    # A host has no more labels, and a label no more signs; so no text, however long, makes a deep search.
    host = rf"(?:[a-z0-9-]{{1,63}}\.){{0,126}}(?:{hosts})"
    rest = rf"[/?#][^{PAGE_WHITE[1:-1]}<>\"'`]*"
    found = F.regexp_extract_all(F.coalesce(t, F.lit("")), F.lit(rf"(?i)(?<![A-Za-z0-9_@.-])((?:https?://)?{host}(?:{rest})?)(?!{inside})"), F.lit(1))
    bare = F.transform(found, lambda w: F.regexp_replace(w, r"[.,;!)\]}]+$", ""))
    part = lambda w, n: F.regexp_extract(w, rf"(?i)^(?:(https?)://)?([^/?#]*)/?([?#]?(?s).*)$", n)
    link = lambda w: F.concat(F.coalesce(F.nullif(F.lower(part(w, 1)), F.lit("")), F.lit("https")), F.lit("://"), F.lower(part(w, 2)), F.lit("/"), _escaped(part(w, 3)))
    name = lambda w: label[F.regexp_extract(F.lower(part(w, 2)), f"({hosts})$", 1)]
    return F.array_distinct(F.transform(bare, lambda w: F.struct(name(w).alias("label"), link(w).alias("url"))))


def joined_codes(codes: Column) -> Column:
    """Distinct codes in order, joined."""
    return F.array_join(F.array_sort(F.array_distinct(codes)), "; ")


def safe_count(t: Column) -> Column:
    """A non-negative integer up to 2^53 - 1 written in digits, else null."""
    n = F.when(t.rlike(r"^\d{1,16}$"), t.cast("bigint"))
    return F.when(n <= (1 << 53) - 1, n)


def present(t: Column, limit: int = 1200) -> Column:
    """Text that isn't blank and not over the limit."""
    return F.coalesce((F.trim(t) != "") & (F.length(t) <= limit), F.lit(False))


def is_slug(t: Column) -> Column:
    return F.coalesce(t.rlike(r"^[a-z0-9][a-z0-9-]{0,119}$"), F.lit(False))


def first_filled(*values: Column) -> Column:
    """The first value that is neither null nor empty."""
    return F.coalesce(*(F.nullif(v, F.lit("")) for v in values))


def source_scope(platform: Column, region: Column, evidence: Column, name: Column) -> Column:
    """A source's scope as shown to readers; a Korean trend counts only with its evidence."""
    proven = F.coalesce((region == "KR") & (evidence != ""), F.lit(False))
    on_x = F.when(proven, SCOPE_X_KOREA).otherwise(SCOPE_X)
    return F.when(platform == "x", on_x).when(platform == "instagram", SCOPE_INSTAGRAM).otherwise(name)


def prompt_text(title: Column, lines: dict[str, Column]) -> Column:
    """A record as lines ``label: value`` after its title, lines without a value left out."""
    return F.concat_ws("\n", title, *(F.when(v.isNotNull() & (v != ""), F.concat(F.lit(f"{k}: "), v)) for k, v in lines.items()))
