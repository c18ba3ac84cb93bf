"""Names as columns: entity class, and sanitized organization, vessel and person names. No Python runs per row."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import words as W


def one_of(values: Iterable[str]) -> str:
    """A regular expression for any of the values."""
    return "|".join(sorted((v.replace(".", r"\.") for v in values), key=len, reverse=True))


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with value computed once however often then names it."""
    return F.element_at(F.transform(F.array(value), then), 1)


def squeezed(name: Column) -> Column:
    return F.trim(F.regexp_replace(name, r"\s+", " "))


def strip_end(text: Column, chars: str) -> Column:
    return F.rtrim(text, F.lit(chars))


def _tokens(text: Column) -> Column:
    return F.filter(F.split(text, " "), lambda t: t != "")


def _share(part: Column, whole: Column) -> Column:
    return F.coalesce(F.try_divide(F.length(part), F.length(whole)), F.lit(0.0))


def _ends(upper: Column, endings: list[str], least: int) -> Column:
    return upper.rlike(f".{{{least},}}({one_of(endings)})$")


def classify_entity(name: Column) -> Column:
    """entity_type, confidence and flags of a name: a cascade of rules in which the first that holds decides."""
    return let(squeezed(name), lambda w: let(_tokens(w), lambda tokens: _classified(name, w, tokens)))


def _classified(name: Column, w: Column, tokens: Column) -> Column:
    upper = F.upper(w)
    imo = F.regexp_extract(w, r"(?i)\bIMO[:\s]?(\d{7})\b", 1)
    clean = F.translate(w, " .-,", "")
    solid = F.lower(F.replace(w, F.lit(" "), F.lit("")))
    bare = F.transform(tokens, lambda t: strip_end(F.upper(t), ".,;:"))
    keyword = F.try_element_at(F.filter(bare, lambda t: t.isin(W.CORPORATE + W.GOVERNMENT + W.LOGISTICS + W.INSURANCE + W.FINANCE + W.INDICATORS)), F.lit(1))
    kind = (
        F.when(keyword.isin(W.CORPORATE), "CORPORATE").when(keyword.isin(W.GOVERNMENT), "GOVERNMENT").when(keyword.isin(W.LOGISTICS), "LOGISTICS").when(keyword.isin(W.INSURANCE + W.FINANCE), "FINANCE").otherwise("INDICATOR")
    )
    slash = F.coalesce(*(F.when(upper.startswith(p) | upper.startswith(p.replace("/", " ")), F.lit(p)) for p in W.VESSEL_SLASH))
    first = strip_end(F.upper(F.try_element_at(tokens, F.lit(1))), ".")
    prefix = F.coalesce(slash, F.when(first.isin(W.VESSEL_WORDS), first))
    last = strip_end(F.upper(F.try_element_at(tokens, F.lit(-1))), ".,")
    patronymic = F.exists(tokens, lambda t: _ends(F.upper(t), W.PATRONYMICS, 3))
    letters = F.regexp_replace(w, r"[^\p{L}]", "")

    def out(entity: str, confidence: float | Column, *flags: str | Column) -> Column:
        flag = F.array(*(F.lit(f) if isinstance(f, str) else f for f in flags))
        return F.struct(F.lit(entity).alias("entity_type"), (F.lit(confidence) if isinstance(confidence, float) else confidence).alias("confidence"), flag.alias("flags"))

    strict = F.when(imo != "", F.array(F.lit("IMO_PRESENT"), F.concat(F.lit("IMO_"), imo))).otherwise(F.array(F.lit("IMO_PRESENT")))
    vessel = F.struct(F.lit("VESSEL").alias("entity_type"), F.lit(0.95).alias("confidence"), strict.alias("flags"))
    sure = F.when(kind.isin("CORPORATE", "GOVERNMENT"), 0.95).otherwise(0.85)
    return (
        F.when(name.isNull(), out("GARBAGE", 0.0, "NULL_INPUT"))
        .when(w == "", out("GARBAGE", 0.0, "EMPTY"))
        .when(F.length(w) < 2, out("GARBAGE", 0.1, "TOO_SHORT"))
        .when(w.rlike(r"(?i)\bIMO\b") | (imo != ""), vessel)
        .when(_share(F.regexp_replace(clean, r"\D", ""), clean) > 0.35, out("GARBAGE", 0.2, "NUMERIC_HEAVY"))
        .when(w.rlike(r"\d{5,}") | upper.rlike(r"^[A-Z]{2,4}[-/]?\d{4,}") | upper.rlike("^[0-9A-F]{8}-[0-9A-F]{4}-"), out("GARBAGE", 0.3, "ID_LIKE"))
        .when(F.lower(w).isin(W.PLACEHOLDERS + W.DASHES), out("GARBAGE", 0.0, "GARBAGE_VALUE"))
        .when(F.replace(solid, F.substring(solid, 1, 1), F.lit("")) == "", out("GARBAGE", 0.1, "REPEATED_CHAR"))
        .when(prefix.isNotNull(), out("VESSEL", 0.90, F.concat(F.lit("VESSEL_PREFIX_"), prefix)))
        .when(keyword.isNotNull(), out("ORGANIZATION", sure, F.concat(F.lit("ORG_"), kind), F.concat(F.lit("KEYWORD_"), keyword)))
        .when(first.isin(W.TITLES), out("PERSON", 0.95, F.concat(F.lit("TITLE_"), first)))
        .when(last.isin(W.SUFFIXES), out("PERSON", 0.90, F.concat(F.lit("SUFFIX_"), last)))
        .when(patronymic, out("PERSON", 0.90, "PATRONYMIC"))
        .when(F.size(tokens).between(2, 4) & (_share(letters, F.replace(w, F.lit(" "), F.lit(""))) >= 0.8), out("PERSON", 0.75, "TOKEN_COUNT_PERSON_RANGE", "ALPHABETIC"))
        .when(F.size(tokens) > 4, out("ORGANIZATION", 0.50, "LOW_CERTAINTY", "LONG_NAME"))
        .when(F.size(tokens) == 1, out("ORGANIZATION", 0.40, "LOW_CERTAINTY", "SINGLE_TOKEN"))
        .otherwise(out("PERSON", 0.50, "LOW_CERTAINTY"))
    )


def tidy(name: Column) -> Column:
    """White space and repeated punctuation squeezed."""
    return F.trim(F.regexp_replace(squeezed(F.coalesce(name, F.lit(""))), r"([.,;:!?])\1+", "$1"))


def _short(raw: Column, whole: Column, **blank: str) -> Column:
    """The result for blank and one-letter names, else whole."""

    def out(text: Column, confidence: float, flag: str) -> Column:
        cols = {"sanitized_name": text, **{k: text if v == "name" else F.lit(v) for k, v in blank.items()}}
        return F.struct(*(c.alias(k) for k, c in cols.items()), F.lit(confidence).alias("confidence"), F.array(F.lit(flag)).alias("flags"), F.lit("GARBAGE").alias("decision_path"))

    return F.when(raw == "", out(raw, 0.0, "BLANK")).when(F.length(raw) < 2, out(raw, 0.1, "TOO_SHORT")).otherwise(whole)


def sanitize_organization(name: Column) -> Column:
    """sanitized_name, org_name, legal_suffix, org_category, confidence, flags, decision_path."""
    return let(F.upper(tidy(name)), lambda upper: let(_tokens(upper), lambda tokens: _organization(F.trim(F.coalesce(name, F.lit(""))), upper, tokens)))


def _organization(raw: Column, upper: Column, tokens: Column) -> Column:
    n = F.size(tokens)
    plain = lambda t: F.translate(t, ".,", "")
    pair = F.when(n >= 2, F.array_join(F.slice(tokens, -2, 2), " "))
    single = F.try_element_at(tokens, F.lit(-1))
    known = lambda t: F.when(t.isin(W.LEGAL_SUFFIXES) | plain(t).isin(W.LEGAL_SUFFIXES), t)
    bare = strip_end(single, ".,")
    found = F.coalesce(known(pair), known(single), F.when(bare.isin(W.LEGAL_SUFFIXES), bare))
    used = F.when(known(pair).isNotNull(), 2).when(found.isNotNull(), 1).otherwise(0)
    short = F.coalesce(*(F.when(found == k, v) for k, v in W.LEGAL_SHORT.items()), plain(found))
    rest = F.array_join(F.slice(tokens, 1, F.greatest(n - used, F.lit(0))), " ")
    category = (
        F.when(upper.rlike(one_of(W.GOVERNMENT + W.BANKS)), "GOVERNMENT")
        .when(upper.rlike(one_of(W.INSURANCE + W.INSURANCE_MORE)), "INSURANCE")
        .when(upper.rlike(one_of(W.FINANCE)), "FINANCE")
        .when(upper.rlike(one_of(W.LOGISTICS + W.LOGISTICS_PHRASES)), "LOGISTICS")
        .otherwise("COMPANY")
    )
    has = found.isNotNull()
    confidence = F.when(has & (category != "COMPANY"), 1.0).when(has, 0.9).when(category != "COMPANY", 0.8).otherwise(0.7)
    flags = F.array_compact(F.array(F.when(has, F.concat(F.lit("SUFFIX_"), short)), F.concat(F.lit("CATEGORY_"), category)))
    whole = F.struct(
        upper.alias("sanitized_name"), F.when(has & (rest != ""), rest).otherwise(upper).alias("org_name"), F.coalesce(short, F.lit("")).alias("legal_suffix"), category.alias("org_category"), confidence.alias("confidence"), flags.alias("flags"), F.when(has, "SUFFIX_EXTRACTED").otherwise("NORMALIZED").alias("decision_path"),
    )
    return _short(raw, whole, org_name="name", legal_suffix="", org_category="OTHER")


def sanitize_vessel(name: Column) -> Column:
    """sanitized_name, vessel_name, imo_number, vessel_prefix, confidence, flags, decision_path."""
    return let(tidy(name), lambda w: _vessel(F.trim(F.coalesce(name, F.lit(""))), w, F.regexp_extract(w, r"(?i)\bIMO[:\s]?(\d{7})\b", 1)))


def _vessel(raw: Column, w: Column, imo: Column) -> Column:
    # Only the first number is taken out.
    at = F.regexp_instr(w, F.lit(r"(?i)\bIMO[:\s]?\d{7}\b"))
    size = F.length(F.regexp_substr(w, F.lit(r"(?i)\bIMO[:\s]?\d{7}\b")))
    w = F.when(imo != "", tidy(F.concat(F.substring(w, F.lit(1), at - 1), F.substring(w, at + size, F.length(w))))).otherwise(w)
    return let(F.upper(w), lambda upper: let(_tokens(upper), lambda tokens: _vessel_parts(raw, upper, tokens, imo)))


def _vessel_parts(raw: Column, upper: Column, tokens: Column, imo: Column) -> Column:
    n = F.size(tokens)
    after = lambda k: F.trim(F.substring(upper, F.lit(k + 1), F.length(upper)))
    slash = F.coalesce(*(F.when(upper.startswith(v), F.struct(F.lit(p).alias("prefix"), after(len(v)).alias("rest"))) for p in W.VESSEL_SLASH for v in (p, p.replace("/", " / "))))
    normal = F.create_map(*(F.lit(x) for kv in W.VESSEL_NORMAL.items() for x in kv))
    tail = lambda k: F.array_join(F.slice(tokens, k + 1, F.greatest(n - k, F.lit(0))), " ")
    one = F.try_element_at(normal, strip_end(F.try_element_at(tokens, F.lit(1)), "."))
    two = F.when(n >= 2, F.try_element_at(normal, F.replace(F.concat(F.try_element_at(tokens, F.lit(1)), F.try_element_at(tokens, F.lit(2))), F.lit("."), F.lit(""))))
    prefix = F.coalesce(slash["prefix"], one, two, F.lit(""))
    rest = F.when(slash.isNotNull(), F.regexp_replace(slash["rest"], " +", " ")).when(one.isNotNull(), tail(1)).when(two.isNotNull(), tail(2)).otherwise(F.array_join(tokens, " "))
    vessel = F.when(rest != "", rest).otherwise(upper)
    has, imo_has = prefix != "", imo != ""
    sanitized = F.when(has & (vessel != ""), F.concat_ws(" ", prefix, vessel)).when(has, prefix).otherwise(vessel)
    confidence = F.when(has & imo_has, 1.0).when(imo_has, 0.9).when(has, 0.8).otherwise(0.7)
    flags = F.array_compact(F.array(F.when(imo_has, "IMO_EXTRACTED"), F.when(has, F.concat(F.lit("PREFIX_"), F.replace(prefix, F.lit("/"), F.lit("_"))))))
    path = F.when(has & imo_has, "IMO_AND_PREFIX").when(imo_has, "IMO_EXTRACTED").when(has, "PREFIX_ONLY").otherwise("NAME_ONLY")
    whole = F.struct(sanitized.alias("sanitized_name"), vessel.alias("vessel_name"), imo.alias("imo_number"), prefix.alias("vessel_prefix"), confidence.alias("confidence"), flags.alias("flags"), path.alias("decision_path"))
    return _short(raw, whole, vessel_name="name", imo_number="", vessel_prefix="")


#: Latin letters with marks and the letters that remain when the marks go; what is not listed and not ASCII goes.
MARKED = "ÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝàáâãäåçèéêëìíîïñòóôõöùúûüýÿĀāĂăĄąĆćĈĉĊċČčĎďĒēĔĕĖėĘęĚěĜĝĞğĠġĢģĤĥĨĩĪīĬĭĮįİĴĵĶķĹĺĻļĽľŃńŅņŇňŌōŎŏŐőŔŕŖŗŘřŚśŜŝŞşŠšŢţŤťŨũŪūŬŭŮůŰűŲųŴŵŶŷŸŹźŻżŽž"
PLAIN = "AAAAAACEEEEIIIINOOOOOUUUUYaaaaaaceeeeiiiinooooouuuuyyAaAaAaCcCcCcCcDdEeEeEeEeEeGgGgGgGgHhIiIiIiIiIJjKkLlLlLlNnNnNnOoOoOoRrRrRrSsSsSsSsTtTtUuUuUuUuUuUuWwYyYZzZzZz"


def folded(text: Column) -> Column:
    """Text in ASCII: marks are dropped from Latin letters, other characters go."""
    return F.regexp_replace(F.translate(text, MARKED, PLAIN), r"[^\x00-\x7F]", "")


def _person(w: Column, tokens: Column) -> tuple[Column, Column, Column]:
    """First, middle and last name of a cleaned name; null where there is none."""
    n = F.size(tokens)
    at = lambda k: F.try_element_at(tokens, F.lit(k))
    patronymic = _ends(F.lower(at(-1)), W.NAME_PATRONYMICS, 0) & (F.length(at(-1)) >= 4)
    slavic = lambda t: F.coalesce((F.length(t) >= 3) & _ends(F.lower(t), W.SLAVIC_SURNAMES, 0) & ~(_ends(F.lower(t), W.NAME_PATRONYMICS, 0) & (F.length(t) >= 4)), F.lit(False))
    comma = F.contains(w, F.lit(","))
    before = F.trim(F.substring_index(w, ",", 1))
    given = _tokens(F.trim(F.when(comma, F.substring(w, F.instr(w, ",") + 1, F.length(w))).otherwise("")))
    rest = lambda a, k: F.when(F.size(a) >= k, F.array_join(F.slice(a, k, F.greatest(F.size(a) - k + 1, F.lit(0))), " "))
    western_last = slavic(at(2)) & ~slavic(at(1))
    three = (n >= 3) & patronymic
    first = F.when(w == "", None).when(comma, F.try_element_at(given, F.lit(1))).when(n == 1, None).when(three & western_last, at(1)).when(three, at(2)).when((n == 2) & patronymic, None).otherwise(at(1))
    middle = F.when(w == "", None).when(comma, rest(given, 2)).when(n == 1, None).when(three, rest(tokens, 3)).when((n == 2) & patronymic, at(2)).when(n == 2, None).otherwise(F.array_join(F.slice(tokens, 2, F.greatest(n - 2, F.lit(0))), " "))
    last = F.when(w == "", None).when(comma, before).when(n == 1, at(1)).when(three & western_last, at(2)).when(three | ((n == 2) & patronymic), at(1)).otherwise(at(-1))
    return first, middle, last


def sanitize_person(name: Column) -> Column:
    """sanitized ("LAST, FIRST MIDDLE"), first_name, middle_name, last_name, suffix, format_standardized, confidence, flags."""
    return let(F.trim(F.coalesce(name, F.lit(""))), _sanitized_person)


def _sanitized_person(raw: Column) -> Column:
    low = F.lower(raw)
    solid = F.replace(low, F.lit(" "), F.lit(""))
    garbage = low.isin(W.PLACEHOLDERS) | (F.replace(solid, F.substring(solid, 1, 1), F.lit("")) == "") | (F.length(low) < 2)
    clean = F.translate(raw, " .-,", "")
    numeric = _share(F.regexp_replace(clean, r"\D", ""), clean) > 0.5
    none = F.lit(None).cast("string")

    def plain(text: Column, confidence: float, flag: str) -> Column:
        return F.struct(text.alias("sanitized"), none.alias("first_name"), none.alias("middle_name"), none.alias("last_name"), none.alias("suffix"), F.lit(False).alias("format_standardized"), F.lit(confidence).alias("confidence"), F.array(F.lit(flag)).alias("flags"))

    whole = let(folded(raw), lambda ascii_: let(squeezed(ascii_), lambda w: _untitled(w, ascii_ != raw)))
    return F.when(raw == "", plain(raw, 0.0, "BLANK")).when(garbage, plain(raw, 0.0, "GARBAGE")).when(numeric, plain(raw, 0.1, "NUMERIC")).otherwise(whole)


def _untitled(w: Column, changed: Column) -> Column:
    """The result for an ASCII name: dots between names, titles and suffixes go first."""
    dotted = ~F.contains(w, F.lit(" ")) & (F.length(w) - F.length(F.replace(w, F.lit("."), F.lit(""))) >= 2)
    titles = rf"(?i)^((({one_of(W.NAME_TITLES)})\.*)(\s+|$))+"
    tail = rf"(?i)(^|\s+)({one_of(W.NAME_SUFFIXES)})[.,]*(\s+({one_of(W.NAME_SUFFIXES)})[.,]*)*$"

    def cut(spaced: Column) -> Column:
        bare = F.regexp_replace(spaced, titles, "")
        suffix = F.nullif(F.regexp_extract(F.regexp_substr(bare, F.lit(tail)), r"^\s*(\S+)", 1), F.lit(""))
        flags = [F.when(changed, "UNICODE_NORMALIZED"), F.when(dotted, "DOT_NORMALIZED"), F.when(spaced.rlike(titles), "TITLE_STRIPPED"), F.when(suffix.isNotNull(), "SUFFIX_STRIPPED")]
        return let(F.regexp_replace(bare, tail, ""), lambda name: let(_tokens(name), lambda tokens: _parsed(name, tokens, suffix, flags)))

    return let(F.when(dotted, squeezed(F.replace(w, F.lit("."), F.lit(" ")))).otherwise(w), cut)


def _parsed(w: Column, tokens: Column, suffix: Column, before: list[Column]) -> Column:
    names = F.struct(*(F.upper(F.nullif(c, F.lit(""))).alias(k) for k, c in zip(("first", "middle", "last"), _person(w, tokens), strict=True)))

    def out(name: Column) -> Column:
        first, middle, last = name["first"], name["middle"], name["last"]
        final = F.lower(F.try_element_at(tokens, F.lit(-1)))
        comma = F.contains(w, F.lit(","))
        slavic = F.coalesce(~comma & (F.size(tokens) >= 3) & _ends(final, W.NAME_PATRONYMICS, 0) & (F.length(final) >= 4), F.lit(False))
        initial = F.coalesce(F.length(first) == 1, F.lit(False)) & last.isNotNull()
        confidence = F.least(
            F.when(F.length(w) < 2, 0.2).otherwise(1.0), F.when(slavic, 0.95).otherwise(1.0), F.when(initial, 0.85).when(first.isNotNull() & last.isNotNull(), 0.9).when(last.isNotNull(), 0.85).otherwise(0.3)
        )
        standardized = last.isNotNull() & ~comma
        lacking = F.when(last.isNotNull() & first.isNull(), "LAST_NAME_ONLY").when(last.isNull(), "PARSE_FAILED")
        flags = F.array_compact(F.array(*before, F.when(F.length(w) < 2, "TOO_SHORT"), F.when(slavic, "SLAVIC_FORMAT"), F.when(initial, "FIRST_INITIAL_ONLY"), lacking, F.when(standardized, "FORMAT_STANDARDIZED")))
        given = F.concat_ws(" ", first, middle)
        sanitized = F.when(last.isNull(), F.upper(w)).when(given == "", last).otherwise(F.concat(last, F.lit(", "), given))
        return F.struct(sanitized.alias("sanitized"), first.alias("first_name"), middle.alias("middle_name"), last.alias("last_name"), F.upper(suffix).alias("suffix"), standardized.alias("format_standardized"), confidence.alias("confidence"), flags.alias("flags"))

    return let(names, out)


def match_name(name: Column) -> Column:
    """A name as it is looked up: lower case, ASCII, titles and suffixes off, "last, first" turned round."""
    low = folded(F.lower(F.trim(F.coalesce(name, F.lit("")))))
    w = squeezed(F.regexp_replace(low, r"[^A-Za-z0-9_\s',]", " "))
    w = F.regexp_replace(w, rf"^(({one_of(W.MATCH_TITLES)})(\s+|$))+", "")
    w = F.regexp_replace(w, rf"((^|\s+)({one_of(W.MATCH_SUFFIXES)}))+$", "")
    return _turned(w)


def index_name(name: Column) -> Column:
    """A name as it is indexed: lower case, ASCII, turned round first, then without punctuation."""
    return squeezed(F.regexp_replace(_turned(folded(F.lower(F.trim(F.coalesce(name, F.lit("")))))), r"[^A-Za-z0-9_\s']", " "))


def _turned(w: Column) -> Column:
    at = F.instr(w, ",")
    return squeezed(F.when(at > 0, F.concat_ws(" ", F.trim(F.substring(w, at + 1, F.length(w))), F.trim(F.substring(w, F.lit(1), at - 1)))).otherwise(w))


def last_name(name: Column) -> Column:
    """The likely last name of a raw name: before a comma, else the first token in capitals, else the last token."""
    w = squeezed(F.coalesce(name, F.lit("")))
    tokens = _tokens(w)
    caps = F.filter(tokens, lambda t: (F.length(t) > 1) & (F.upper(t) == t) & (F.lower(t) != t))
    return F.when(F.contains(w, F.lit(",")), F.lower(F.trim(F.substring_index(w, ",", 1)))).otherwise(F.lower(F.coalesce(F.try_element_at(caps, F.lit(1)), F.try_element_at(tokens, F.lit(-1)), F.lit(""))))
