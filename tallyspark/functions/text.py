"""Text rules as column expressions."""

from __future__ import annotations

import html.entities
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.pandas_udf(T.StringType())
def strip_marks(texts: pd.Series) -> pd.Series:
    """Letters without their accents (compatibility decomposition, which Spark has no function for)."""
    bare = lambda s: None if s is None else "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c))
    return texts.map(bare)


def letters_key(name: Column) -> Column:
    return F.regexp_replace(F.lower(name), "[^a-z]", "")


def country_key(name: Column) -> Column:
    """For names without accents (see strip_marks): saints in full, no punctuation, single spaces."""
    plain = F.regexp_replace(F.lower(name), r"\bst\.? ", "saint ")
    return F.trim(F.regexp_replace(F.regexp_replace(plain, "&", " and "), r"[^a-z0-9]+", " "))


def plain_typography(text: Column) -> Column:
    """Straight quotes, plain dashes, single spaces."""
    return F.trim(F.regexp_replace(F.translate(text, "‘’“”–— ", "''\"\"-- "), r"\s+", " "))


def last_name_variants(name: Column) -> Column:
    """Ways in which sources write a family name of several words, as letters: together, its first word, its last, the words reversed. For names without accents (see strip_marks); a name without letters has none."""
    words = F.filter(F.transform(F.split(name, r"\s+"), letters_key), lambda w: w != "")
    ways = F.array(F.array_join(words, ""), F.get(words, F.lit(0)), F.get(words, F.size(words) - 1), F.array_join(F.reverse(words), ""))
    return F.array_distinct(F.filter(ways, lambda w: w != ""))


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")


#: Words that stay small within a case's name (this library's choice).
SMALL = ("of", "the", "and", "for", "in", "on", "v.", "ex", "rel.")


def case_title(name: Column) -> Column:
    """Title case with small words, the first word always capital."""
    words = F.transform(F.split(F.lower(name), " "), lambda w, i: F.when((i > 0) & w.isin(*SMALL), w).otherwise(F.initcap(w)))
    return F.array_join(words, " ")


def repaired(text: Column) -> Column:
    """UTF-8 that was read as Latin-1 and written again, put right; texts that were not are left as they are."""
    odd = text.rlike("[\u00c2-\u00f4][\u0080-\u00bf]") & ~text.rlike("[^\u0000-\u00ff]")
    again = F.try_validate_utf8(F.encode(text, "ISO-8859-1").cast("string"))
    return F.when(odd, F.coalesce(again, text)).otherwise(text)


def display_name(override: Column, official: Column, first: Column, middle: Column, nickname: Column) -> Column:
    """An override, a nickname, a name in quotes or parentheses, the middle name if the first is an initial, the first."""
    quoted = F.nullif(F.regexp_extract(official, r"[(“\"]([A-Za-z.]+)[)”\"]", 1), F.lit(""))
    return F.coalesce(override, nickname, quoted, F.when(first.rlike(r"^[A-Z]\.?$"), middle), first)


def committee_short(name: Column) -> Column:
    return F.trim(F.regexp_replace(name, r"^(House |Senate |Joint )?(Permanent |Select |Special )*Committee on (the )?", ""))


def child_id(parent: Column, suffix: Column) -> Column:
    return F.concat(parent, suffix)


def references(notes: Column, label: str) -> Column:
    """Numbers after "label:" up to the next semicolon; "labelled by" forms have another label and are left alone."""
    part = F.regexp_extract(notes, rf"(?:^|; ?){label}: ([^;]*)", 1)
    return F.transform(F.regexp_extract_all(part, F.lit(r"(\d+)"), F.lit(1)), lambda x: x.cast("int"))


def roll_number(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, r"(?i)roll (?:call )?(?:no\. ?|vote ?(?:no\. ?)?)(\d+)", 1), F.lit("")).cast("int")


def tally(text: Column) -> Column:
    """Yes and no of "284 - 135"; null without one."""
    yes, no = (F.regexp_extract(text, r"(\d+)\s*[-–]\s*(\d+)", j) for j in (1, 2))
    return F.when(yes != "", F.struct(yes.cast("int").alias("yes"), no.cast("int").alias("no")))


def passing_method(text: Column) -> Column:
    """voice, consent, roll or unstated, in this order."""
    low = F.lower(text)
    return F.when(low.contains("voice vote"), "voice").when(low.contains("unanimous consent"), "consent").when(low.rlike(r"roll|yea-nay|\d+\s*-\s*\d+"), "roll").otherwise("unstated")


#: Abbreviations after which a sentence goes on (this library's choice).
ABBREVIATIONS = ("Mr", "Mrs", "Ms", "Dr", "Sen", "Rep", "Gov", "Gen", "No", "St", "U.S", "v", "Inc", "Co", "Jr", "Sr")


def sentences(text: Column) -> Column:
    """Split after . ! ? and what closes with it (quotes, parentheses), before a capital, a digit or what opens; not after an abbreviation or a lone letter."""
    known, closes = "|".join(a.replace(".", r"\.") for a in ABBREVIATIONS), "[\"”'’)\\]]{0,3}"
    flat = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.split(flat, rf"(?<=[.!?]{closes})(?<!\b(?:{known}|[A-Za-z])\.{closes}) (?=[\"“‘(\[]?[A-Z0-9])")


def whole_sentence(text: Column, least: int = 12, most: int = 600) -> Column:
    """Whether a text reads as one finished sentence: a capital or quote first, a stop last, all brackets and quotes closed, no markup, of a fit length."""
    even = lambda a, b: F.regexp_count(text, F.lit(a)) == F.regexp_count(text, F.lit(b))
    plain = ~text.rlike(r"[\[\]{}<>|]") & text.rlike("^[A-Z“\"'‘]") & text.rlike("[.!?][\"”'’)]?$")
    return F.coalesce(plain & F.length(text).between(least, most) & even(r"\(", r"\)") & even("“", "”") & (F.regexp_count(text, F.lit('"')) % 2 == 0), F.lit(False))


def lead(text: Column, heading: str = "", says: str = "", among: int = 3) -> Column:
    """The first of a text's first sentences, after a heading, that is a whole sentence and says what is asked for (a pattern); null without one."""
    body = F.regexp_replace(text, f"^{heading}\\s*", "") if heading else text
    good = F.filter(F.slice(sentences(body), 1, among), lambda s: whole_sentence(s) & (s.rlike(says) if says else F.lit(True)))
    return F.get(good, F.lit(0))


def decoded_entities(text: Column) -> Column:
    """HTML's named entities (of HTML 4, and &apos;) and numbered ones, decimal or hexadecimal, as characters; what is none stays."""
    names = {n: chr(c) for n, c in html.entities.name2codepoint.items()} | {"apos": "'"}
    table = F.create_map(*(F.lit(x) for pair in names.items() for x in pair))
    numbered = lambda n: F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")

    def one(piece: Column) -> Column:
        inner = F.regexp_extract(piece, r"^&(#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});", 1)
        code = F.when(inner.rlike("^#[0-9]"), F.substr(inner, F.lit(2)).cast("long")).when(inner.rlike("^#"), F.conv(F.substr(inner, F.lit(3)), 16, 10).cast("long"))
        known = F.when(code.between(1, 0xD7FF) | code.between(0xE000, 0x10FFFF), numbered(code)).when(code.isNull(), F.element_at(table, inner))
        return F.when((inner != "") & known.isNotNull(), F.concat(known, F.substr(piece, F.length(inner) + 3))).otherwise(piece)

    return F.when(text.contains("&"), F.array_join(F.transform(F.split(text, "(?=&)"), one), "")).otherwise(text)


def html_text(page: Column) -> Column:
    """Without scripts, styles, comments and tags, with entities decoded, single spaces."""
    bare = F.regexp_replace(F.regexp_replace(page, r"(?is)<(script|style)\b.*?</\1>|<!--.*?-->", " "), r"(?s)<[^>]*>", " ")
    return F.trim(F.regexp_replace(decoded_entities(bare), r"[\s\u00a0]+", " "))


def bill_label(kind: Column, number: Column) -> Column:
    names = F.create_map(*(F.lit(x) for pair in {"hr": "H.R.", "s": "S.", "hjres": "H.J.Res.", "sjres": "S.J.Res."}.items() for x in pair))
    return F.concat_ws(" ", F.element_at(names, kind), number.cast("string"))


def quoted_in(quote: Column, source: Column) -> Column:
    """Whether a quote stands in a source, both with plain typography and lower case."""
    return F.contains(F.lower(plain_typography(source)), F.lower(plain_typography(quote)))


def number_in(value: Column, source: Column) -> Column:
    """Whether a whole number stands in a source, with or without separators."""
    return F.contains(source, F.format_number(value, 0)) | F.contains(source, value.cast("long").cast("string"))


def exact_dollars(text: Column) -> Column:
    """$20,140 or $20,140.55; null for a range or anything else."""
    return F.when(F.trim(text).rlike(r"^\$\d{1,3}(,\d{3})*(\.\d{2})?$"), F.regexp_replace(F.trim(text), "[$,]", "")).cast("decimal(18,2)")


def caucus_group(caucus: Column) -> Column:
    """By how the name begins."""
    return F.when(caucus.startswith("Democrat"), "D").when(caucus.startswith("Republican"), "R").otherwise("O")


def party_group(party: Column, session: Column) -> Column:
    """By the whole name; the one party exists from the 33rd session on."""
    return F.when(party == "Democrat", "D").when((party == "Republican") & (session >= 33), "R").otherwise("O")


def has_all_words(query: str, *columns: Column) -> Column:
    """Whether every word of a query occurs in the columns together, whatever the case."""
    hay = F.lower(F.concat_ws(" ", *columns))
    out = F.lit(True)
    for word in query.lower().split():
        out = out & hay.contains(word)
    return out


def occurrences(text: Column, part: str) -> Column:
    return F.size(F.split(text, F.lit("\\Q" + part + "\\E"), -1)) - 1
