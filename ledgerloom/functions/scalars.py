"""Native column expressions for names, dates, addresses, codes and lists. (?U) makes classes Unicode-aware."""

from __future__ import annotations

from html.entities import name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Name endings whose dot stays, markers in applicant lists (one misspelt at the source), and what marks an organisation.
SUFFIXES = ("INC.", "LLC.", "L.L.C.", "L.L.P.", "LTD.", "CORP.", "CO.", "L.P.", "PTY.", "JR.", "SR.", "S.P.A.", "F.O.E.", "U.P.", "D.B.A.", "P.C.", "N.A.", "P.A.", "W. & S.")
MARKERS = ("ADDITIONAL NAMES ON FILE", "ADDTIONAL NAMES ON FILE")
ORGANISATION = r"\b(LLC|L\.?L\.?C\.?|INC\.?|CORP\.?|CORPORATION|TRUST|LTD\.?|LIMITED|PARTNERS|PARTNERSHIP|HOLDINGS|GROUP|ENTERPRISE|ENTERPRISES|ASSOCIATION|FOUNDATION|COMPANY|CO\.|L\.?P\.?)\b"
#: Marks of repeated names, places in addresses with and without a zip, and punctuation that similarity reads as blanks.
DUPLICATE = r"(?iU)\s*(?:\(\s*DUPLICATE(?:\s+\d+)?\s*\)|\*DUPLICATE\*|\(\s*DUPLICATE(?:\s+\d+)?|DUPLICATE)"
PLACE = r"(?U),\s*([A-Z][A-Z .]+?),\s*([A-Z]{2})"
PLACE_WITH_ZIP = PLACE + r"\s+(\d{5}(?:-\d{4})?)"
PUNCTUATION = r"""[<>,.;:!?/\\()\[\]{}"'`@#$%^&*=|~]"""
#: The character references that a look-up, which reads names in turn, tries first.
COMMON_REFERENCES = ("amp", "nbsp", "quot", "apos", "lt", "gt", "eacute", "Eacute")
#: Sections as they are shown, and the archive folders that they come from.
SECTION_LABELS = {"new_application": "New Application", "approved": "Approved", "discontinued": "Discontinued"}
SECTION_FOLDERS = {"notifications": "new_application", "approvals": "approved", "discontinued": "discontinued"}


def _strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def trimmed(c: Column) -> Column:
    """Without white space of any kind at either end, the non-breaking blank and the separators 28 to 31 included."""
    return F.regexp_replace(c, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def _character(number: Column) -> Column:
    """The character of a code point; null for what is none."""
    real = number.between(1, 0xD7FF) | number.between(0xE000, 0x10FFFF)
    return F.when(real, F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32"))


def unescaped(c: Column) -> Column:
    """Text with its character references read, each once: named ones with a semicolon, numeric ones with or without. Others stay as they are."""
    points = {name: name2codepoint.get(name, 39) for name in dict.fromkeys([*COMMON_REFERENCES, *name2codepoint])}
    named = F.str_to_map(F.lit(" ".join(f"{name}={chr(point)}" for name, point in points.items())), F.lit(" "), F.lit("="))

    def read(t: Column) -> Column:
        said = F.rtrim(F.substr(t, F.lit(2)), F.lit(";"))
        number = F.when(t.rlike("^&#[xX]"), F.conv(F.substr(said, F.lit(3)), 16, 10)).otherwise(F.substr(said, F.lit(2)))
        character = F.transform(F.array(number.try_cast("long")), _character)[0]
        return F.when(t.startswith("&#"), F.coalesce(character, t)).when(t.startswith("&") & (F.length(t) > 1), F.coalesce(F.try_element_at(named, said), t)).otherwise(t)

    pieces = F.regexp_extract_all(c, F.lit(r"&#[xX][0-9a-fA-F]{1,8};?|&#[0-9]{1,10};?|&[A-Za-z][A-Za-z0-9]*;|[^&]+|&"), 0)
    return F.when(F.contains(c, F.lit("&")), F.array_join(F.transform(pieces, read), "")).otherwise(c)


def clean_name(c: Column) -> Column:
    """Upper case, single spaces, no trailing dots or commas but that of a known suffix."""
    text = F.regexp_replace(F.upper(_strip(c)), r"(?U)\s+", " ")
    keep = "|".join(s.replace(".", r"\.") for s in SUFFIXES)
    return F.regexp_replace(text, rf"(?:(?<=\s|^)({keep})[.,\s]*|\s*[.,][.,\s]*)$", "$1")


def strip_duplicate_marker(c: Column) -> Column:
    """Without DUPLICATE marks, wherever they stand: bare, starred, in brackets, numbered or with the bracket left open."""
    return _strip(F.regexp_replace(F.regexp_replace(c, DUPLICATE, ""), " {2,}", " "))


def normalise_nbsp(c: Column) -> Column:
    return F.regexp_replace(c, " +", " ")


def iso_date(c: Column) -> Column:
    """M/D/YYYY as ISO text; what is no date passes through trimmed."""
    t = F.trim(c)
    return F.coalesce(F.date_format(F.try_to_date(t, "M/d/yyyy"), "yyyy-MM-dd"), t)


def city_state_zip(c: Column) -> Column:
    """struct<city, state, zip> of an address in capitals, without a zip if there is none; defaults '', WA, ''."""
    place, full = PLACE, PLACE_WITH_ZIP
    found = lambda pattern: F.struct(_strip(F.regexp_extract(c, pattern, 1)).alias("city"), F.regexp_extract(c, pattern, 2).alias("state"), (F.regexp_extract(c, pattern, 3) if pattern is full else F.lit("")).alias("zip"))
    none = F.struct(F.lit("").alias("city"), F.lit("WA").alias("state"), F.lit("").alias("zip"))
    return F.when(c.rlike(full), found(full)).when(c.rlike(place), found(place)).otherwise(none)


def entity_type(c: Column) -> Column:
    return F.when(c.rlike(ORGANISATION), "organization").otherwise("person")


def has_additional_names(*columns: Column) -> Column:
    """True if any ;-part of any column is a marker."""
    return F.coalesce(F.exists(F.split(F.concat_ws(";", *columns), ";"), lambda x: _strip(x).isin(*MARKERS)), F.lit(False))


def section_label(c: Column) -> Column:
    """A section as it is shown; others as they are."""
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in SECTION_LABELS.items() for x in kv]), c), c)


def section_of_file(c: Column) -> Column:
    """The section that a file name tells by the archive folder's name in it, else null."""
    out = F.lit(None).cast("string")
    for name, section in reversed(SECTION_FOLDERS.items()):
        out = F.when(F.contains(c, F.lit(name)), section).otherwise(out)
    return out


def shown_time(c: Column) -> Column:
    """struct<iso, date> of a timestamp for display; '' for null."""
    iso = F.coalesce(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss"), F.lit(""))
    return F.struct(iso.alias("iso"), F.substring(iso, 1, 10).alias("date"))


def code_of(c: Column) -> Column:
    """The code of a license type that begins with one: of "450," and "450, NAME"; else null."""
    first = F.trim(F.split_part(c, F.lit(","), F.lit(1)))
    return F.when(first.rlike(r"^\d+$"), first)


def clean_list(c: Column) -> Column:
    """A ;-list with cleaned, distinct, non-empty elements in order of first place; null and '' pass through."""
    parts = F.filter(F.transform(F.split(c, ";"), lambda x: clean_name(strip_duplicate_marker(x))), lambda x: x != "")
    return F.when(c.isNull() | (c == ""), c).otherwise(F.array_join(F.array_distinct(parts), "; "))


def applicants(c: Column) -> Column:
    """Entities of a ;-list in order: the first element is the business and is skipped, markers too; none without a semicolon."""
    parts = F.transform(F.split(c, ";"), lambda x: clean_name(strip_duplicate_marker(x)))
    rest = F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0)))
    return F.array_distinct(F.filter(rest, lambda x: (x != "") & ~x.isin(*MARKERS)))


def license_types(c: Column) -> Column:
    """array<struct<code, name>> of the three forms: a bare code, ``code, name`` or a ;-list of names."""
    entry = lambda code, name: F.struct(code.cast("string").alias("code"), name.cast("string").alias("name"))
    t = _strip(F.rtrim(c, F.lit(",")))
    none = F.lit(None).cast("string")
    names = F.transform(F.filter(F.transform(F.split(c, ";"), _strip), lambda x: x != ""), lambda x: entry(none, F.upper(x)))
    return (
        F.when(F.coalesce(F.trim(c), F.lit("")) == "", F.array().cast("array<struct<code:string,name:string>>"))
        .when(t.rlike(r"^\d+$"), F.array(entry(t, none)))
        .when(t.rlike(r"^\d+,\s+.+$"), F.array(entry(F.regexp_extract(t, r"^(\d+),\s+(.+)$", 1), F.upper(F.regexp_extract(t, r"^(\d+),\s+(.+)$", 2)))))
        .otherwise(names)
    )


def slug(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def phone(c: Column) -> Column:
    return F.regexp_replace(c, r"^(\d{3})(\d{3})(\d{4})$", "($1) $2-$3")


def country(c: Column) -> Column:
    return F.when(F.trim(c).rlike("^[A-Za-z]{2}$"), F.upper(F.trim(c))).otherwise("")


def first_filled(*columns: Column) -> Column:
    """The first that is neither null nor empty, else ''."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in columns], F.lit(""))


def code_order(c: Column) -> list[Column]:
    """Numeric codes by value, then the others as text."""
    return [c.try_cast("int").asc_nulls_last(), c.asc()]


def strip_anchors(c: Column) -> Column:
    return F.regexp_replace(c, r"(?i)</?a(\s[^>]*)?>", "")


def diff_timestamp(c: Column) -> Column:
    """RFC-2822 time after the tab of a diff header."""
    return F.try_to_timestamp(F.regexp_replace(F.split_part(c, F.lit("\t"), F.lit(2)), r"^[A-Za-z]{3}, ", ""), F.lit("dd MMM yyyy HH:mm:ss Z"))


def valid_record(section: Column, day: Column, license_: Column, kind: Column) -> Column:
    filled = lambda c: F.coalesce(c, F.lit("")) != ""
    return filled(section) & F.coalesce(day.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.lit(False)) & filled(license_) & filled(kind)


def trigrams(c: Column) -> Column:
    """Distinct trigrams of the words of lower-cased text, each word with two blanks before and one behind."""
    words = F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}\p{N}]+"), 0)
    return F.array_distinct(F.flatten(F.transform(words, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) + 1), lambda i: F.substr(F.concat(F.lit("  "), w, F.lit(" ")), i, F.lit(3))))))


def trigram_similarity(a: Column, b: Column) -> Column:
    """Shared trigrams by all; 0 if there are none at all."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)).cast("double"), F.size(F.array_union(a, b)).cast("double")), F.lit(0.0))


#: Words that similarity ignores, spellings that it evens out, and the words of a sign.
STOP_WORDS = ("ENDORSEMENT", "THE", "AND", "OF", "FOR", "A")
SPELLINGS = (("TAKE OUT", "TAKEOUT"),)
SIGNS = ("PLUS", "MINUS")


def similarity_phrase(c: Column) -> Column:
    t = F.upper(c)
    for old, new in SPELLINGS:
        t = F.replace(t, F.lit(old), F.lit(new))
    return t


def similarity_tokens(c: Column) -> Column:
    """Words in capitals: + as PLUS, a - that stands alone as MINUS, other punctuation as blanks, without stop words."""
    t = F.replace(similarity_phrase(c), F.lit("+"), F.lit(" PLUS "))
    t = F.regexp_replace(t, "(?<![a-zA-Z0-9])-(?![a-zA-Z0-9])", " MINUS ")
    t = F.regexp_replace(t, PUNCTUATION, " ")
    return F.filter(F.split(t, r"(?U)\s+"), lambda x: (x != "") & ~x.isin(*STOP_WORDS))


def similarity_features(tokens: Column) -> Column:
    n = F.size(tokens)
    pairs = F.when(n > 1, F.zip_with(F.slice(tokens, F.lit(1), n - 1), F.slice(tokens, F.lit(2), n - 1), lambda x, y: F.concat_ws(" ", x, y))).otherwise(F.array().cast("array<string>"))
    return F.array_union(tokens, pairs)


def blended_similarity(a: Column, b: Column) -> Column:
    """0.7 * Jaccard of words and word pairs + 0.3 * containment of words; 0 if exactly PLUS and MINUS differ, or a side is empty."""
    fa, fb = similarity_features(a), similarity_features(b)
    jaccard = F.size(F.array_intersect(fa, fb)) / F.size(F.array_union(fa, fb))
    inside = F.size(F.array_intersect(a, b)) / F.least(F.size(F.array_distinct(a)), F.size(F.array_distinct(b)))
    differ = F.array_sort(F.array_union(F.array_except(a, b), F.array_except(b, a)))
    signs = differ == F.array(*[F.lit(x) for x in sorted(SIGNS)])
    return F.when((F.size(a) == 0) | (F.size(b) == 0) | signs, 0.0).otherwise(0.7 * jaccard + 0.3 * inside)
