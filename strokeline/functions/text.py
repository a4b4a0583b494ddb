"""Strings of drawings as Spark column expressions: normalisation, dimensions, identifiers and markup."""

from __future__ import annotations

import uuid

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import PROFILE


def sanitized_filename(name: Column) -> Column:
    """The last path component without control characters, of 255 characters at most; null if nothing is left."""
    base = F.element_at(F.split(F.regexp_replace(name, r"\\", "/"), "/"), -1)
    return F.nullif(F.substring(F.regexp_replace(base, r"[\x00-\x1f\x7f]", ""), 1, 255), F.lit(""))


def with_abbreviations(text: Column, abbreviations: dict[str, str] = PROFILE.abbreviations) -> Column:
    """Expands `abbr.` where a word character follows the dot, in any case."""
    for short, full in sorted(abbreviations.items()):
        if short.isalpha():
            text = F.regexp_replace(text, rf"(?i)\b{short}\.\b", full)
    return text


def with_known_terms(text: Column, terms: tuple[str, ...] = PROFILE.terms, abbreviations: dict[str, str] = PROFILE.abbreviations) -> Column:
    """Known terms lose surrounding punctuation; those of four letters or fewer become upper case. Words are joined by one space."""
    known = F.array(*[F.lit(t.lower()) for t in terms])

    def one(word: Column) -> Column:
        bare = F.regexp_replace(word, r"^[.,;:]+|[.,;:]+$", "")
        case = bare
        for short, full in sorted(abbreviations.items()):
            case = F.when(F.lower(bare) == short, F.lit(full)).otherwise(case)
        return F.when(F.array_contains(known, F.lower(bare)), F.when((F.length(case) <= 4) & case.rlike(r"^\p{L}+$"), F.upper(case)).otherwise(case)).otherwise(word)

    return F.array_join(F.transform(F.split(F.regexp_replace(text, r"^\s+|\s+$", ""), r"\s+"), one), " ")


def sentence_case(text: Column) -> Column:
    return F.concat(F.upper(F.substring(text, 1, 1)), F.substring(text, 2, 2147483647))


def normalized(text: Column) -> Column:
    """The proposed reading of a text, null for a blank one and where nothing changes."""
    bare = F.regexp_replace(text, r"^\s+|\s+$", "")
    made = sentence_case(with_known_terms(with_abbreviations(bare)))
    return F.when((bare != "") & (made != bare), made)


def parsed_dimension(text: Column) -> Column:
    """struct of value, unit, status and confidence of a feet and inches string; null where it is none. The first pattern that fits decides."""
    bare = F.regexp_replace(text, r"^\s+|\s+$", "")
    number = r"(\d+(?:\.\d+)?)"
    feet_inches, inches, words = rf"^{number}\s*['′]\s*{number}?\s*[\"″]?$", rf"^{number}\s*[\"″]$", rf"(?i)^{number}\s*ft\.?$"
    get = lambda pattern, k: F.nullif(F.regexp_extract(bare, pattern, k), F.lit("")).cast("double")
    made = lambda value, unit, status, confidence: F.struct(value.cast("double").alias("value"), F.lit(unit).cast("string").alias("unit"), F.lit(status).alias("status"), F.lit(confidence).alias("confidence"))
    none = F.lit(None)
    return (
        F.when(bare == "", made(none, None, "none", 0.0))
        .when(bare.rlike("^['\"″′]$"), made(none, None, "illegible", 0.2))
        .when(bare.rlike(feet_inches), made(get(feet_inches, 1) + F.coalesce(get(feet_inches, 2), F.lit(0.0)) / 12.0, "ft", "parsed", 0.85))
        .when(bare.rlike(inches), made(get(inches, 1), "in", "parsed", 0.88))
        .when(bare.rlike(words), made(get(words, 1), "ft", "parsed", 0.92))
        .when(bare.contains("'") & bare.contains('"'), made(none, None, "ambiguous", 0.35))
    )


def first_invalid_xml_character(text: Column) -> Column:
    """The first character that XML 1.0 doesn't allow, null if there is none."""
    return F.nullif(F.regexp_extract(text, r"[^\x{9}\x{A}\x{D}\x{20}-\x{D7FF}\x{E000}-\x{FFFD}\x{10000}-\x{10FFFF}]", 0), F.lit(""))


def xml_text(text: Column) -> Column:
    for raw, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("\r", "&#13;")):
        text = F.replace(text, F.lit(raw), F.lit(entity))
    return text


def xml_attribute(text: Column) -> Column:
    text = xml_text(text)
    for raw, entity in (('"', "&quot;"), ("\n", "&#10;"), ("\t", "&#9;")):
        text = F.replace(text, F.lit(raw), F.lit(entity))
    return text


def number(value: Column) -> Column:
    """Three decimals at most, without trailing zeros; minus zero is 0, and what lies between two of them, as 0.0625, goes to the even one."""
    between = (value * 16 == F.floor(value * 16)) & (F.abs(value) < 1e12)
    even = F.bround(F.when(between, value).cast("decimal(20,4)"), 3).cast("string")
    fixed = F.regexp_replace(F.regexp_replace(F.coalesce(even, F.format_string("%.3f", value)), r"0+$", ""), r"\.$", "")
    return F.when(fixed == "-0", F.lit("0")).otherwise(fixed)


def rgb_hex(r: Column, g: Column, b: Column) -> Column:
    return F.format_string("#%02x%02x%02x", r.cast("int"), g.cast("int"), b.cast("int"))


def path_data(points: Column) -> Column:
    """SVG path data of an array of structs x, y."""
    return F.array_join(F.transform(points, lambda p, k: F.concat(F.when(k == 0, F.lit("M")).otherwise(F.lit("L")), number(p["x"]), F.lit(" "), number(p["y"]))), " ")


def without_fences(text: Column) -> Column:
    """JSON text without Markdown code fences."""
    return F.regexp_replace(F.regexp_replace(text, r"^\s*```(?:json)?\s*", ""), r"\s*```\s*$", "")


def filled_location(location: Column, reading: Column) -> Column:
    trimmed = lambda c: F.nullif(F.trim(c), F.lit(""))
    return F.coalesce(trimmed(location), F.nullif(F.substring(F.trim(reading), 1, 80), F.lit("")), F.lit("drawing"))


def relationship_id(kind: Column, source: Column, target_kind: Column, target: Column) -> Column:
    return F.concat(F.lit("rel_"), F.substring(F.sha2(F.concat_ws("|", kind, source, target_kind, target), 256), 1, 12))


def uuid5(namespace: uuid.UUID, name: Column) -> Column:
    """The version 5 UUID of a name, as text."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace.hex)), F.encode(name, "UTF-8")))
    variant = F.substring(F.lower(F.hex(F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(F.lit(3)).bitwiseOR(F.lit(8)))), -1, 1)
    return F.concat(F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-"), variant, F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12))


def bare_etag(value: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.trim(value), r"^W/", ""), r'^"+|"+$', "")


def safe_key(key: Column) -> Column:
    """Whether an artifact key is relative and has no parent step."""
    return ~key.startswith("/") & ~F.array_contains(F.split(key, "/"), "..") & (key != "")


def canonical_json(text: Column) -> Column:
    """JSON with sorted keys, no spaces and no minus zero; null for what isn't JSON, holds NaN, or repeats a key of an object."""
    return F.to_json(F.try_parse_json(text))


def issue_path(*segments: Column) -> Column:
    """Path of a value in a document: names with dots between, numbers in brackets."""
    made = segments[0].cast("string")
    for s in segments[1:]:
        s = s.cast("string")
        made = F.concat(made, F.when(s.rlike(r"^\d+$"), F.concat(F.lit("["), s, F.lit("]"))).otherwise(F.concat(F.lit("."), s)))
    return made


def supported_version(version: Column, major: int = 1) -> Column:
    """Whether a version of two whole numbers has the major one; false for anything else."""
    return F.coalesce(F.regexp_extract(version, r"^(\d+)\.\d+$", 1) == str(major), F.lit(False))


def review_id(*parts: Column) -> Column:
    return F.concat(F.lit("rev_"), F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 12))
