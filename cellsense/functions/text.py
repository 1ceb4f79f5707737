"""Text functions over columns, and the cell tokenizer as one Arrow UDF."""

from __future__ import annotations

import html
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .lexicon import CONTRACTIONS, PUNCTUATION, STOPWORDS

#: Characters before the name in an entity's address.
ENTITY_PREFIX = 28


def _stops() -> Column:
    return F.array(*[F.lit(w) for w in STOPWORDS])


def strip_punctuation(c: Column) -> Column:
    return F.translate(c, PUNCTUATION, "")


def collapse_spaces(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def retain_alphanumerics(c: Column) -> Column:
    """Every character but ASCII letters and digits becomes a space."""
    return F.regexp_replace(c, "[^a-zA-Z0-9]", " ")


def remove_stopwords(tokens: Column) -> Column:
    return F.filter(tokens, lambda w: ~F.array_contains(_stops(), w))


def words(c: Column) -> Column:
    """Runs of word characters."""
    return F.regexp_extract_all(c, F.lit(r"(?U)\w+"), F.lit(0))


def long_words(c: Column) -> Column:
    """Word tokens of two characters or more."""
    return F.filter(words(c), lambda w: F.length(w) > 1)


def bag(tokens: Column) -> Column:
    """Bag of words of an array: map from word to count. Equal words stand side by side once sorted, so one pass over the sorted array
    finds where each begins; its count is the distance to the next beginning."""
    def counted(xs: Column) -> Column:
        places = F.transform(xs, lambda x, i: F.when((i == 0) | (x != F.get(xs, i - 1)), i))
        starts = F.concat(F.array_compact(places), F.array(F.size(xs)))
        # bound by a transform of its own: written out inside the next one it would be worked out anew for every word
        return F.transform(F.array(starts), lambda at: F.map_from_entries(entries(xs, at)))[0]

    def entries(xs: Column, at: Column) -> Column:
        return F.transform(F.slice(at, F.lit(1), F.size(at) - 1), lambda a, k: F.struct(F.get(xs, a).alias("word"), (F.get(at, k + 1) - a).alias("n")))

    return F.transform(F.array(F.array_sort(tokens)), counted)[0]


def bags(cell: Column, entity: Column, abstract: Column) -> Column:
    """The three bags that a candidate is scored by: of the cell, the entity's name and its abstract."""
    return F.struct(bag(words(cell)).alias("cell"), bag(words(entity)).alias("entity"), bag(words(abstract)).alias("abstract"))


def bag_of_words(df: DataFrame, keys: list[str], text: Column) -> DataFrame:
    """(keys, word, n): the same as rows; counts combine before the shuffle."""
    return df.select(*keys, F.explode(words(text)).alias("word")).groupBy(*keys, "word").agg(F.count(F.lit(1)).alias("n"))


def query_text(clean: Column) -> Column:
    """Conjunctive query of a clean text: quoted words of four characters or more, or of three that aren't stopwords, joined by AND;
    the whole phrase where there are none; empty for an empty text."""
    parts = F.transform(F.split(clean, " "), lambda w: F.trim(w))
    told = F.filter(parts, lambda w: (F.length(w) > 3) | ((F.length(w) == 3) & ~F.array_contains(_stops(), w)))
    quoted = F.transform(told, lambda w: F.concat(F.lit('"'), w, F.lit('"')))
    phrase = F.array_join(parts, " ")
    return F.when(F.size(told) > 0, F.array_join(quoted, " AND ")).when(phrase == "", F.lit("")).otherwise(F.concat(F.lit('"'), phrase, F.lit('"')))


def longest_words(tokens: Column, k: int) -> Column:
    """The k longest words; among equals the earlier."""
    placed = F.transform(tokens, lambda w, i: F.struct((-F.length(w)).alias("n"), i.alias("i"), w.alias("w")))
    return F.transform(F.slice(F.array_sort(placed), 1, k), lambda x: x.w)


def lookup_query(c: Column, more_than: int = 3, keep: int = 3) -> Column:
    """Texts of more than three words are cut to their three longest."""
    tokens = F.split(c, " ")
    return F.when(F.size(tokens) > more_than, F.array_join(longest_words(tokens, keep), " ")).otherwise(c)


def or_query(c: Column, keep: int = 2) -> Column:
    """Disjunctive query: the two longest distinct words of four characters or more, null where there are none."""
    told = F.array_distinct(F.filter(F.split(c, " "), lambda w: F.length(w) > 3))
    quoted = F.transform(longest_words(told, keep), lambda w: F.concat(F.lit('"'), w, F.lit('"')))
    return F.when(F.size(told) > 0, F.array_join(quoted, " OR "))


def decode(c: Column) -> Column:
    """Percent-decoding that leaves malformed text as it is."""
    return F.coalesce(F.try_url_decode(F.replace(c, F.lit("+"), F.lit("%2B"))), c)


def entity_name(uri: Column) -> Column:
    """The readable name in an entity's address, before cleaning."""
    return F.lower(F.translate(F.substr(decode(uri), F.lit(ENTITY_PREFIX + 1)), "_", " "))


def initial_name(name: Column) -> Column:
    """A person's name with the first word cut to its first letter."""
    first = F.element_at(F.split(name, " "), 1)
    return F.concat(F.substring(first, 1, 1), F.substr(name, F.length(first) + 1, F.length(name)))


def local_names(uris: Column) -> Column:
    """The last segment of each address."""
    return F.transform(uris, lambda u: F.substring_index(u, "/", -1))


def short_label(uri: Column) -> Column:
    """``xsd:`` form of schema types, else the last segment."""
    return F.when(uri.contains("XMLSchema#"), F.concat(F.lit("xsd:"), F.substring_index(uri, "XMLSchema#", -1))).otherwise(F.substring_index(uri, "/", -1))


def table_name_tokens(c: Column) -> Column:
    """Words of a table's name: lower case, decoded, ASCII, without parentheses and what follows a later ``#``."""
    s = ascii_fold(decode(F.lower(c)))
    s = F.replace(F.replace(s, F.lit("_-_"), F.lit(" ")), F.lit("_"), F.lit(" "))
    s = F.translate(s, "()", "")
    s = F.when(F.instr(s, "#") > 1, F.substring_index(s, "#", 1)).otherwise(s)
    return F.filter(F.split(s, r"\s+"), lambda w: w != "")


def literal_value(o: Column) -> Column:
    """The text of a literal: language-marked ones only in English or unmarked, typed ones without type, addresses as names; null for others."""
    lang = F.regexp_extract(o, r'^"(?s:.*)"@([A-Za-z-]+)$', 1)
    quoted = F.regexp_extract(o, r'^"((?s:.*))"(?:@[A-Za-z-]+|\^\^<[^>]*>)?$', 1)
    return F.when(o.startswith("http"), entity_name(o)).when((lang != "") & (lang != "en"), None).when(o.startswith('"'), quoted).otherwise(o)


def alias_name(alias: Column) -> Column:
    """The name of an alias address; null for direct hits, marked by the text ``None``."""
    return F.when(alias != "None", F.substr(alias, F.lit(ENTITY_PREFIX + 1)))


def context_bag(texts: Column) -> Column:
    """Bag words of a row: addresses become names, other web addresses are left out, literals stay."""
    kept = F.filter(texts, lambda t: t.startswith("http://dbpedia.org/resource/") | ~t.startswith("http"))
    return F.flatten(F.transform(kept, lambda t: words(F.when(t.startswith("http"), entity_name(t)).otherwise(F.lower(t)))))


#: Irregular plurals and endings (own rules).
_PLURALS = [("men", "man"), ("people", "person"), ("children", "child"), ("feet", "foot"), ("teeth", "tooth"), ("mice", "mouse")]


def singular(w: Column) -> Column:
    out = F.when(w.rlike("[^aeiou]ies$"), F.regexp_replace(w, "ies$", "y")).when(w.rlike("(s|x|z|ch|sh)es$"), F.regexp_replace(w, "es$", "")).when(w.rlike("[^su]s$"), F.regexp_replace(w, "s$", "")).otherwise(w)
    for many, one in _PLURALS:
        out = F.when(w == many, F.lit(one)).otherwise(out)
    return out


def plural(w: Column) -> Column:
    out = F.when(w.rlike("[^aeiou]y$"), F.regexp_replace(w, "y$", "ies")).when(w.rlike("(s|x|z|ch|sh)$"), F.concat(w, F.lit("es"))).otherwise(F.concat(w, F.lit("s")))
    for many, one in _PLURALS:
        out = F.when(w == one, F.lit(many)).otherwise(out)
    return out


@F.pandas_udf(T.StringType())
def ascii_fold(s: pd.Series) -> pd.Series:
    """Letters without their marks; what has no ASCII form goes."""
    return s.map(lambda x: unicodedata.normalize("NFKD", x).encode("ascii", "ignore").decode(), na_action="ignore")


@F.pandas_udf(T.StringType())
def sanitize(s: pd.Series) -> pd.Series:
    """Control characters removed, escapes and entities decoded, doubly encoded UTF-8 mended, then ASCII."""

    def one(x: str) -> str:
        x = "".join(c for c in x if c in "\t\n\r" or unicodedata.category(c) != "Cc")
        x = re.sub(r"\\(?:u([0-9a-fA-F]{4})|x([0-9a-fA-F]{2})|([nrt\\'\"]))", lambda m: chr(int(m[1] or m[2], 16)) if m[1] or m[2] else {"n": "\n", "r": "\r", "t": "\t"}.get(m[3], m[3]), x)
        x = html.unescape(x)
        try:
            x = x.encode("cp1252").decode("utf-8")
        except (UnicodeEncodeError, UnicodeDecodeError):
            pass
        return unicodedata.normalize("NFKD", x.translate(_QUOTES)).encode("ascii", "ignore").decode()

    return s.map(one, na_action="ignore")


_QUOTES = str.maketrans({"’": "'", "‘": "'", "“": '"', "”": '"', "–": "-", "—": "-", "…": "...", "ß": "ss", "æ": "ae", "Æ": "AE", "ø": "o", "Ø": "O", "œ": "oe", "ł": "l", "Ł": "L"})

#: Token patterns in order of priority (fixed values).
TOKENS = [
    ("QUOTED_PHRASE", r"\"[^\"]*\""),
    ("URL", r"(?i)(?:https?:\/\/)(?:[\da-z\.-]+)\.(?:[a-z\.]{2,6})(?:[\/\w\.\-\?#=]*)*\/?"),
    ("EMAIL", r"(?i)[-!#$%&'*+\/=?^\w{|}~](?:\.?[-!#$%&'*+\/=?^\w`{|}~])*@[a-z0-9](?:-?\.?[a-z0-9])*(?:\.[a-z](?:-?[a-z0-9])*)+"),
    ("MENTION", r"@\w+"),
    ("HASHTAG", r"(?i)#[a-z][a-z0-9]*"),
    ("HASHTAG", r"(?i)#[ऀ-ॣ॰-ॿ][ऀ-ॣ॰-ॿ०-९0-9]*"),
    ("EMOJI", r"[☀-⛿]|[✀-➿]"),
    ("TIME", r"(?i)(?:\d|[01]\d|2[0-3]):?(?:[0-5][0-9])?\s?(?:[ap]\.?m\.?|hours|hrs)"),
    ("ORDINAL", r"1\dth|[04-9]th|1st|2nd|3rd|[02-9]1st|[02-9]2nd|[02-9]3rd|[02-9][04-9]th|\d+\d[04-9]th|\d+\d1st|\d+\d2nd|\d+\d3rd"),
    ("NUMBER", r"\d+\/\d+|\d(?:[\.,-\/]?\d)*(?:\.\d+)?"),
    ("NUMBER", r"[०-९]+\/[०-९]+|[०-९](?:[\.,-\/]?[०-९])*(?:\.[०-९]+)?"),
    ("CURRENCY", r"[₿₽₹₨$£¥€₩]"),
    ("WORD", r"(?i)[a-zÀ-ÖØ-öø-ÿ][a-zÀ-ÖØ-öø-ÿ']*"),
    ("WORD", r"(?i)[ऀ-ॏ॑-ॣ॰-ॿ]+"),
    ("PUNCTUATION", r"[’'‘’`“”\"\[\]\(\){}…,\.!;\?\-:।॥]"),
    ("SYMBOL", r"[ॐ~@#%\^\+=\*\|\/<>&]"),
]
_RULES = [(tag, re.compile(rx)) for tag, rx in TOKENS]


def _word_parts(word: str) -> list[tuple[str, str]]:
    """A word with an apostrophe: known contractions, possessives, else what stands at either side of it."""
    if word in CONTRACTIONS:
        return [("WORD", x) for x in CONTRACTIONS[word]]
    head, _, tail = word.partition("'")
    if re.match(r"(?i)[a-z]+'s$", word):
        return [("WORD", head), ("WORD", "'s")]
    if re.match(r"(?i)[a-z]+s'$", word):
        return [("WORD", head), ("WORD", "'")]
    return [("WORD", head), ("PUNCTUATION", "'"), ("WORD", tail)]


def tokenize_text(text: str) -> list[tuple[str, str]]:
    """(tag, value) of a text: each rule in turn takes its matches out of what the rules before left."""
    parts: list[tuple[str | None, str]] = [(None, text)]
    for tag, rx in _RULES:
        left: list[tuple[str | None, str]] = []
        for known, piece in parts:
            if known:
                left.append((known, piece))
                continue
            piece, at = piece.strip(), 0
            for m in rx.finditer(piece):
                if gap := piece[at : m.start()].strip():
                    left.append((None, gap))
                left.extend(_word_parts(m[0]) if tag == "WORD" and "'" in m[0] else [(tag, m[0])])
                at = m.end()
            if gap := piece[at:].strip():
                left.append((None, gap))
        parts = left
    return [(tag, v) if tag else ("ALIEN", x) for tag, v in parts for x in ([v] if tag else v.split())]


def clean(text: str) -> str:
    """Words and numbers of a text in lower case, without what stands in brackets; a web address takes no space after it."""
    out, closing = [], None
    for tag, value in tokenize_text(text):
        if closing:
            closing = None if value == closing else closing
        elif tag in ("WORD", "NUMBER"):
            if value := value.partition("'")[0]:
                out.append(value + " ")
        elif tag == "URL":
            out.append(value)
        elif value in ("(", "["):
            closing = {"(": ")", "[": "]"}[value]
    return "".join(out).strip().lower()


@F.pandas_udf(T.StringType())
def clean_text(s: pd.Series) -> pd.Series:
    return s.map(clean, na_action="ignore")


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("tag", T.StringType()), T.StructField("value", T.StringType())])))
def tokenize(s: pd.Series) -> pd.Series:
    return s.map(lambda x: [{"tag": t, "value": v} for t, v in tokenize_text(x)], na_action="ignore")
