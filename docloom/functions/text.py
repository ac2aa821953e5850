"""Scalar text functions as column expressions: they stay in the JVM, inside code generation where it allows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docloom.functions import constants as K

#: White space as Python's str.split sees it; Java's \\s is narrower.
WS = r"\t-\r\x{1c}-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
INVISIBLE = "[\\x{200b}\\x{200c}\\x{200d}\\x{feff}\\x{2060}\\x{ad}]"


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    return F.regexp_replace(_c(c), f"^[{WS}]+|[{WS}]+$", "")


def words(c: Column | str) -> Column:
    return F.filter(F.split(_c(c), f"[{WS}]+"), lambda x: x != "")


def word_count(c: Column | str) -> Column:
    return F.size(words(c))


def tokens_of_words(n: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(n * F.lit(0.75)).cast("int"))


def token_estimate(c: Column | str) -> Column:
    """Three quarters of the words, rounded down, at least 1."""
    return tokens_of_words(word_count(c))


def char_count(c: Column | str) -> Column:
    return F.length(_c(c))


def normalize_whitespace(c: Column | str) -> Column:
    """Line ends to \\n, invisible characters out, runs of blanks to one, three or more newlines to two, each line stripped."""
    x = F.regexp_replace(_c(c), "\r\n?", "\n")
    x = F.regexp_replace(x, INVISIBLE, "")
    x = F.regexp_replace(F.regexp_replace(x, "[ \t]+", " "), "\n{3,}", "\n\n")
    return F.array_join(F.transform(F.split(x, "\n"), strip), "\n")


def checksum(c: Column | str) -> Column:
    return F.sha2(_c(c).cast("binary"), 256)


def key_values(c: Column | str) -> Column:
    """Map of `key: value` lines, the last of a key; null unless there are two keys."""
    pattern = f"^([^:]+?)[{WS}]*[:→][{WS}]*([^{WS}].*)$"
    lines = F.transform(F.split(_c(c), "\n"), strip)
    pairs = F.transform(
        F.filter(lines, lambda x: x.rlike(pattern)),
        lambda x: F.struct(strip(F.regexp_extract(x, pattern, 1)).alias("key"), strip(F.regexp_extract(x, pattern, 2)).alias("value")),
    )

    def kept(p: Column) -> Column:
        key, value = F.lower(p["key"]), F.lower(p["value"])
        bad = key.isin(*K.EXCLUDED_KEYS) | value.contains("wikipedia:") | value.contains("arxiv:") | (key == "")
        for part in K.EXCLUDED_KEY_PARTS:
            bad = bad | key.contains(part)
        return ~bad

    pairs = F.filter(pairs, kept)
    # the last pair of a key wins; keys keep the order of their first pair
    keys = F.array_distinct(F.transform(pairs, lambda p: p["key"]))
    entries = F.transform(keys, lambda k: F.struct(k.alias("key"), F.element_at(F.filter(pairs, lambda p: p["key"] == k), -1)["value"].alias("value")))
    return F.when(F.size(keys) > 1, F.map_from_entries(entries))


def dates(c: Column | str) -> Column:
    """ISO dates of `Month D, YYYY` in the text, without a check of the calendar."""
    months = "|".join(m.capitalize() for m in K.MONTHS)
    pattern = rf"(?i)\b({months})\s+(\d{{1,2}}),?\s+(\d{{4}})\b"
    found = F.regexp_extract_all(_c(c), F.lit(pattern), F.lit(0))
    names = F.array(*[F.lit(m) for m in K.MONTHS])

    def iso(m: Column) -> Column:
        month = F.array_position(names, F.lower(F.regexp_extract(m, pattern, 1)))
        day = F.regexp_extract(m, pattern, 2)
        return F.concat(F.regexp_extract(m, pattern, 3), F.lit("-"), F.lpad(month.cast("string"), 2, "0"), F.lit("-"), F.lpad(day, 2, "0"))

    return F.transform(found, iso)


def date_field(c: Column | str) -> Column:
    """A date field as an ISO date where one of the known layouts fits, else as it is."""
    x = F.trim(_c(c))
    layouts = ("yyyy-MM-dd", "yyyy/MM/dd", "dd/MM/yyyy", "MM/dd/yyyy", "MMMM d, yyyy")
    shapes = (r"^\d{4}-\d{2}-\d{2}$", r"^\d{4}/\d{1,2}/\d{1,2}$", r"^\d{1,2}/\d{1,2}/\d{4}$", r"^\d{1,2}/\d{1,2}/\d{4}$", r"^[A-Z][a-z]+ \d{1,2}, \d{4}$")
    tries = [F.when(x.rlike(s), F.try_to_timestamp(x, F.lit(layout)).cast("date").cast("string")) for layout, s in zip(layouts, shapes, strict=True)]
    iso = F.when(x.rlike(r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}"), F.substring(x, 1, 10))
    return F.coalesce(*tries, iso, _c(c))


def clean_url(c: Column | str) -> Column:
    """The URL without tracking and blank parameters, over https."""
    u = _c(c)
    head, fragment = F.regexp_extract(u, r"^([^#]*)", 1), F.regexp_extract(u, r"^[^#]*#(.*)$", 1)
    path, query = F.regexp_extract(head, r"^([^?]*)", 1), F.regexp_extract(head, r"^[^?]*\?(.*)$", 1)
    params = F.filter(F.split(query, "&"), lambda p: p.rlike(r"^[^=]+=.+$") & ~F.regexp_extract(p, r"^([^=]*)", 1).isin(*K.TRACKING))
    # equal names stand together, where the first of them stood
    names = F.array_distinct(F.transform(params, lambda p: F.regexp_extract(p, r"^([^=]*)", 1)))
    grouped = F.flatten(F.transform(names, lambda n: F.filter(params, lambda p: F.regexp_extract(p, r"^([^=]*)", 1) == n)))
    rest = F.array_join(grouped, "&")
    out = F.concat(
        F.regexp_replace(path, "^(?i)http://", "https://"),
        F.when(rest != "", F.concat(F.lit("?"), rest)).otherwise(""),
        F.when(fragment != "", F.concat(F.lit("#"), fragment)).otherwise(""),
    )
    return F.when(u.isNull() | (u == ""), u).otherwise(out)


def is_upper(c: Column | str) -> Column:
    """At least one cased letter, and none of lower case."""
    return _c(c).rlike(r"\p{Lu}") & ~_c(c).rlike(r"[\p{Ll}\p{Lt}]")


def heading_level(c: Column | str) -> Column:
    """The level that a heading's looks suggest."""
    x = _c(c)
    number = F.regexp_extract(x, K.NUMBER_OF_HEADING, 1)
    by_words = F.when(word_count(x).between(1, K.FEW_WORDS), K.FEW_WORDS_LEVEL).otherwise(K.OTHER_LEVEL)
    level = F.when(number != "", F.least(F.size(F.split(number, r"\.")), F.lit(K.DEEPEST))).otherwise(by_words)
    for limit, capital in reversed(K.CAPITAL_LEVELS):
        level = F.when(is_upper(x) & (F.length(x) < limit), capital).otherwise(level)
    return F.when(x.isNull() | (x == ""), K.OTHER_LEVEL).otherwise(level)


def numbered_label(c: Column | str) -> Column:
    """The number that a heading starts with, null if it has none."""
    label = F.regexp_extract(_c(c), r"^(\d+(?:\.\d+)*|[IVXLC]+)\.?\s", 1)
    return F.when(label != "", label)


def section_role(c: Column | str) -> Column:
    low = F.lower(_c(c))
    out = F.lit(None).cast("string")
    for keyword, role in reversed(K.SECTION_ROLES):
        out = F.when(low.contains(keyword), F.lit(role)).otherwise(out)
    return out


def language_guess(c: Column | str) -> Column:
    """de, fr or es by their letters among the first 1000 characters, else en."""
    x = F.lower(F.substring(_c(c), 1, 1000))
    return F.when(x.rlike("[äöüß]"), "de").when(x.rlike("[éèêàù]"), "fr").when(x.rlike("[ñáéíóú]"), "es").otherwise("en")


def has_cjk(c: Column | str) -> Column:
    return _c(c).rlike(r"[\x{3040}-\x{309F}\x{30A0}-\x{30FF}\x{4E00}-\x{9FFF}]")


def sentences(c: Column | str) -> Column:
    """Sentences with their offsets: sentence_id, text, start_char, end_char."""
    parts = F.regexp_extract_all(_c(c), F.lit(r"[^.!?]+[.!?]*"), F.lit(0))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"]
        lead = F.length(x) - F.length(F.regexp_replace(x, f"^[{WS}]+", ""))
        body = strip(x)
        row = F.struct((F.size(acc["rows"]) + 1).alias("sentence_id"), body.alias("text"), (start + lead).alias("start_char"), (start + lead + F.length(body)).alias("end_char"))
        return F.struct((start + F.length(x)).alias("at"), F.when(body == "", acc["rows"]).otherwise(F.concat(acc["rows"], F.array(row))).alias("rows"))

    empty = F.from_json(F.lit("[]"), "array<struct<sentence_id:int,text:string,start_char:int,end_char:int>>")
    return F.aggregate(parts, F.struct(F.lit(0).alias("at"), empty.alias("rows")), step, lambda acc: acc["rows"])


def code_symbols(c: Column | str) -> tuple[Column, Column, Column]:
    """(functions, classes, imports) of source code, each distinct in order."""
    def found(p: str) -> Column:
        return F.regexp_extract_all(_c(c), F.lit("(?m)" + p), F.lit(1))

    functions = F.array_distinct(F.filter(found(K.FUNCTION_PATTERN), lambda x: ~x.isin(*K.NOT_FUNCTIONS)))
    imports = F.array_distinct(F.transform(F.concat(*[found(p) for p in K.IMPORT_PATTERNS]), F.trim))
    return functions, F.array_distinct(found(K.CLASS_PATTERN)), imports
