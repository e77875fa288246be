"""Source pages: label/value tables to records, natively, by cutting each page into cells and its cells at date labels.

Elements are cut at their opening tags and end where their end tag stands, or, as end tags may be missing, where the next one begins or
what holds them ends. A cell's text is its text nodes, each with its character references read and without white space at its
ends, put together without anything between. Tables within tables are not told from tables that follow each other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import city_state_zip, iso_date, trimmed, unescaped

#: Section headings, and the date label that begins a record of each section.
SECTIONS = {"STATEWIDE NEW LICENSE APPLICATIONS": "new_application", "STATEWIDE RECENTLY APPROVED LICENSES": "approved", "STATEWIDE DISCONTINUED LICENSES": "discontinued"}
DATE_LABELS = {"new_application": "Notification Date:", "approved": "Approved Date:", "discontinued": "Discontinued Date:"}
#: Labels and the fields that they fill.
FIELDS = {
    "Business Name:": "business_name",
    "New Business Name:": "business_name",
    "Current Business Name:": "previous_business_name",
    "Business Location:": "business_location",
    "New Business Location:": "business_location",
    "Current Business Location:": "previous_business_location",
    "Applicant(s):": "applicants",
    "New Applicant(s):": "applicants",
    "Current Applicant(s):": "previous_applicants",
    "License Type:": "license_type",
    "Application Type:": "application_type",
    "\\Application Type:": "application_type",
    "License Number:": "license_number",
    "Contact Phone:": "contact_phone",
}
#: Columns of a record with what stands where nothing was given.
DEFAULTS = {"record_date": "", "business_name": "", "business_location": "", "applicants": "", "license_type": "", "application_type": "", "license_number": "", "contact_phone": "", "city": "", "state": "WA", "zip_code": "", "previous_business_name": "", "previous_applicants": "", "previous_business_location": "", "previous_city": "", "previous_state": "", "previous_zip_code": ""}
_PLACES = (("business_location", "city", "state", "zip_code"), ("previous_business_location", "previous_city", "previous_state", "previous_zip_code"))


def _lookup(values: dict[str, str], c: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), c)


def _text(content: Column) -> Column:
    """Bytes as text: UTF-8, else Latin-1."""
    return F.when(F.is_valid_utf8(content.cast("string")), content.cast("string")).otherwise(F.decode(content, "ISO-8859-1"))


def read_files(spark: SparkSession, path: str, pattern: str, strict: bool = False) -> DataFrame:
    """(path, text) of whole files that fit the pattern, packed by gzip or not; of ``p`` and ``p.gz`` only the latter is read.

    Bytes that are not UTF-8 are read as Latin-1; with strict, the text of a plain file with such bytes is null.
    """
    plain = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    said = F.when(F.is_valid_utf8(F.col("content").cast("string")), F.col("content").cast("string")) if strict else _text(F.col("content"))
    plain = plain.select("path", said.alias("text"))
    packed = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern + ".gz").text(path, wholetext=True)
    packed = packed.select(F.col("_metadata.file_path").alias("path"), _text(F.col("value").cast("binary")).alias("text"))
    name = lambda c: F.regexp_replace(F.regexp_replace(c, "^file:/+", "/"), r"\.gz$", "")
    return plain.join(packed.select(name(F.col("path")).alias("stem")), name(F.col("path")) == F.col("stem"), "left_anti").unionByName(packed)


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """(path, html) of all snapshots below a folder."""
    return read_files(spark, path, "*.html").withColumnRenamed("text", "html")


def snapshot_date(path: Column) -> Column:
    """The first yyyy_mm_dd in a file name as a timestamp, else null."""
    return F.try_to_timestamp(F.regexp_extract(F.element_at(F.split(path, "/"), -1), r"\d{4}_\d{2}_\d{2}", 0), F.lit("yyyy_MM_dd"))


#: Marks that cells are cut at: of rows, of cells, of tags, and one that stands before a letter for a mark in the text itself.
_ROW, _CELL, _MARK, _ESCAPE = "\x01", "\x02", "\x03", "\x04"
_LETTERS = ((_ESCAPE, "d"), (_ROW, "a"), (_CELL, "b"), (_MARK, "c"))


def _tag(names: str, within: str = "") -> str:
    """A tag whose name fits: quoted values may hold its end; one with a quote left open ends at the first >. It does not go beyond the characters of within."""
    return rf"""{names}(?:(?:[^>"'{within}]++|"[^"{within}]*+"|'[^'{within}]*+')*+>|[^>{within}]*+>)"""


def _opening(name: str, within: str = "") -> str:
    return _tag(rf"(?i)<{name}(?=[\s/>])", within)


_ANY = "<[a-zA-Z/!?]"


def elements(c: Column, name: str, ends: str = "") -> Column:
    """The contents of each element of a name, in order: from its opening tag to its end tag, to the next opening tag or to one of ends (a pattern of tags' beginnings)."""
    stop = f"</{name}" + (f"|{ends}" if ends else "")
    return F.transform(F.slice(F.split(c, _opening(name)), 2, 1_000_000_000), lambda x: F.regexp_replace(x, rf"(?is)(?:{stop})(?=[\s/>]).*$", ""))


def _marked(c: Column) -> Column:
    """Text without marks of its own."""
    for mark, letter in _LETTERS:
        c = F.replace(c, F.lit(mark), F.lit(_ESCAPE + letter))
    return c


def _node(x: Column) -> Column:
    """What a text node of marked text says."""
    own = x
    for mark, letter in reversed(_LETTERS):
        own = F.replace(own, F.lit(_ESCAPE + letter), F.lit(mark))
    return let(F.when(F.contains(x, F.lit(_ESCAPE)), own).otherwise(x), lambda t: trimmed(unescaped(t)))


def _said(c: Column) -> Column:
    """What marked text says whose tags are marks."""
    return F.when(F.contains(c, F.lit(_MARK)), F.array_join(F.transform(F.split(c, _MARK), _node), "")).otherwise(_node(c))


def text_of(c: Column) -> Column:
    """What an element's content says."""
    return let(F.regexp_replace(_marked(c), _tag(_ANY), _MARK), _said)


def tables(pages: DataFrame, key: str, html: str) -> DataFrame:
    """(key, section, table_no, body): tables whose first heading names a section; comments are left out."""
    bare = F.regexp_replace(F.col(html), "(?s)<!--.*?-->", "")
    found = pages.select(key, F.posexplode(elements(bare, "table")).alias("table_no", "body"))
    heading = F.replace(text_of(F.get(elements(F.col("body"), "th", "<th|<td|</tr|<tr|</thead"), F.lit(0))), F.lit("\u00a0"), F.lit(" "))
    return found.withColumn("section", _lookup(SECTIONS, heading)).where("section is not null").select(key, "section", "table_no", "body")


def _rows_of(body: Column) -> Column:
    """array<struct<pos, label, value>> of an HTML fragment's rows of two cells.

    Spark compiles the pattern of a split for every text that it cuts, but that of a replacement once. So the beginnings of rows and cells and
    all tags become marks in the whole fragment, what follows an end goes up to the next mark, and rows and cells are cut at single characters.
    """
    steps = [
        (_opening("tr"), _ROW),
        (rf"(?i)<(?:/(?:tr|tbody|thead|tfoot|table)|tbody|thead|tfoot)(?=[\s/>])[^{_ROW}]*+", ""),
        (_opening("td", _ROW), _CELL),
        (rf"(?i)<(?:/td|th)(?=[\s/>])[^{_ROW}{_CELL}]*+", ""),
        (_tag(_ANY, _ROW + _CELL), _MARK),
    ]
    cut = _marked(body)
    for pattern, mark in steps:
        cut = F.regexp_replace(cut, pattern, mark)
    rows = F.transform(F.slice(F.split(cut, _ROW), 2, 1_000_000_000), lambda r, i: F.struct(i.alias("pos"), F.split(r, _CELL).alias("c")))
    return F.transform(F.filter(rows, lambda x: F.size(x["c"]) == 3), lambda x: F.struct(x["pos"].alias("pos"), _said(x["c"][1]).alias("label"), _said(x["c"][2]).alias("value")))


def cells_of(parts: DataFrame, key: list[str], body: str = "body") -> DataFrame:
    """(key, pos, label, value): the rows of two cells of HTML fragments."""
    return parts.select(*key, F.explode(_rows_of(F.col(body))).alias("r")).select(*key, "r.*")


def let(value: Column, use) -> Column:
    """use(value), with the value worked out once however often it is used."""
    return F.transform(F.array(value), use)[0]


def _blocks(rows: Column) -> Column:
    """The rows (pos, field, value) cut at each date, in order; what stands before the first is a block, too."""
    dates = F.filter(F.transform(rows, lambda x, i: F.when(x["field"] == "record_date", i)), lambda i: i.isNotNull())
    cut = let(dates, lambda d: F.zip_with(F.concat(F.array(F.lit(0)), d), F.concat(d, F.array(F.size(rows))), lambda a, b: F.slice(rows, a + 1, b - a)))
    return F.filter(cut, lambda b: F.size(b) > 0)


def _split_block(rows: Column) -> Column:
    """A block's parts, each its rows: a field that is set again to another value begins a part, as the date row of the next record may be
    missing. Parts follow from the rows before, so a block's rows, about 15, are read in order; one that sets no field twice is a part as it stands."""
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    start = F.struct(none.alias("seen"), F.lit(0).alias("part"), F.array().cast("array<struct<part:int,row:struct<pos:int,field:string,value:string>>>").alias("out"))

    def step(s: Column, x: Column) -> Column:
        field = x["field"]
        had = F.try_element_at(s["seen"], field)
        begins = F.coalesce((had != "") & (had != x["value"]), F.lit(False))
        part = s["part"] + begins.cast("int")
        own = F.map_filter(s["seen"], lambda k, _: k != field)
        seen = F.when(field.isNull(), s["seen"]).when(begins, F.create_map(field, x["value"])).otherwise(F.map_concat(own, F.create_map(F.coalesce(field, F.lit("")), x["value"])))
        return F.struct(seen.alias("seen"), part.alias("part"), F.concat(s["out"], F.array(F.struct(part.alias("part"), x.alias("row")))).alias("out"))

    read = F.aggregate(rows, start, step, lambda s: s["out"])
    parts = let(read, lambda out: F.transform(F.sequence(F.lit(0), F.array_max(out["part"])), lambda p: F.transform(F.filter(out, lambda x: x["part"] == p), lambda x: x["row"])))
    fields = F.filter(rows["field"], lambda f: f.isNotNull())
    once = let(fields, lambda f: F.size(F.array_distinct(f)) == F.size(f))
    return F.when(once, F.array(rows)).otherwise(parts)


def parts_of(section: Column, body: Column) -> Column:
    """array<struct<pos, fields, values>>: what each record of an HTML fragment of a section says, the last row first, and the place of its first row.

    Dates are read here, once: a filter on the records would have them read again.
    """
    field = lambda x: F.coalesce(_lookup(FIELDS, x["label"]), F.when(x["label"] == _lookup(DATE_LABELS, section), "record_date"))
    named = F.transform(_rows_of(body), lambda x: F.struct(x["pos"].alias("pos"), field(x).alias("field"), x["value"].alias("value")))
    rows = F.transform(named, lambda x: F.struct(x["pos"].alias("pos"), x["field"].alias("field"), F.when(x["field"] == "record_date", iso_date(x["value"])).otherwise(x["value"]).alias("value")))
    said = lambda p: F.struct(F.get(p, F.lit(0))["pos"].alias("pos"), F.reverse(p["field"]).alias("fields"), F.reverse(p["value"]).alias("values"))
    return let(rows, lambda r: F.transform(F.flatten(F.transform(_blocks(r), _split_block)), said))


def said_by(part: Column, field: str | Column) -> Column:
    """The value of a field in one of parts_of(), null if it is not given; of a field that stands twice the last row counts."""
    at = F.array_position(part["fields"], F.lit(field)).cast("int")
    return F.when(at > 0, F.get(part["values"], at - 1))


def filled(parts: DataFrame, key: list[str], part: str = "part") -> DataFrame:
    """Records of rows (key with section, part: one of parts_of()); those without a license number are left out. Result: key, section_type, pos and DEFAULTS."""
    given = parts.where(F.coalesce(said_by(F.col(part), "license_number"), F.lit("")) != "")
    names = ["record_date", *dict.fromkeys(FIELDS.values())]
    # looked up in one loop: with a look-up for each column the generated method grows beyond what the JVM compiles
    said = F.transform(F.array(*[F.lit(n) for n in names]), lambda n: said_by(F.col(part), n))
    of = lambda name: F.get("said", F.lit(names.index(name)))
    out = given.select(*key, F.col(part)["pos"].alias("pos"), said.alias("said"))
    out = out.select(*key, "pos", *[of(n).alias(n) for n in names], *[F.when(of(place).isNotNull(), city_state_zip(of(place))).alias(f"{place} parts") for place, *_ in _PLACES])
    out = out.withColumns({n: F.col(f"{place} parts")[field] for place, *own in _PLACES for n, field in zip(own, ("city", "state", "zip"), strict=True)})
    return out.select(*[k for k in key if k != "section"], F.col("section").alias("section_type"), "pos", *[F.coalesce(n, F.lit(d)).alias(n) for n, d in DEFAULTS.items()])


def records(parts: DataFrame, key: list[str], body: str = "body") -> DataFrame:
    """Records of HTML fragments (key with section, body), read within their rows, without a shuffle. Result: key, section_type, pos and DEFAULTS."""
    return filled(parts.select(*key, F.explode(parts_of(F.col("section"), F.col(body))).alias("part")), key)


def records_of_pages(pages: DataFrame, key: str, html: str) -> DataFrame:
    """All records of pages."""
    return records(tables(pages, key, html), [key, "section", "table_no"]).drop("table_no", "pos")


def blocks_of(parts: DataFrame, key: list[str], body: str = "body") -> DataFrame:
    """(key, block_no, body): the <tbody> groups of HTML fragments, with their tags."""
    found = F.regexp_extract_all(F.col(body), F.lit(r"(?is)<tbody(?=[\s/>]).*?(?=</tbody|<tbody|</table|\z)"), 0)
    return parts.select(*key, F.posexplode(F.transform(found, lambda x: F.concat(x, F.lit("</tbody>")))).alias("block_no", "body"))


NATURAL_KEY = ["section_type", "record_date", "license_number", "application_type"]


def keys_of_blocks(blocks: DataFrame, key: list[str]) -> DataFrame:
    """key with section_type for section, and the natural key that each block's rows say; of a label that stands twice the last row counts."""
    rows = cells_of(blocks, key)
    said = lambda c: F.coalesce(F.max_by(F.when(c, F.col("value")), F.when(c, F.col("pos"))), F.lit(""))
    labels = {"license_number": ["License Number:"], "application_type": ["Application Type:", "\\Application Type:"]}
    each = rows.groupBy(*key).agg(iso_date(said(F.col("label") == _lookup(DATE_LABELS, F.col("section")))).alias("record_date"), *[said(F.col("label").isin(*names)).alias(c) for c, names in labels.items()])
    return each.withColumnRenamed("section", "section_type")


def evidence(blocks: DataFrame, key: list[str], wanted: DataFrame, order: list[str], among: list[str] | None = None) -> DataFrame:
    """The block (key with section, body) that evidences each wanted natural key: the first by order; one for each of among (columns), if given. Result: among, the natural key, html."""
    found = keys_of_blocks(blocks, key).join(wanted.select(*NATURAL_KEY).distinct(), NATURAL_KEY, "left_semi")
    own = ["section_type" if k == "section" else k for k in key]
    held = found.join(blocks.select(*key, F.col("body").alias("html")).withColumnRenamed("section", "section_type"), own)
    return held.groupBy(*(among or []), *NATURAL_KEY).agg(F.min_by("html", F.struct(*order)).alias("html"))


def source_blocks(parts: DataFrame, key: list[str], wanted: DataFrame) -> DataFrame:
    """The <tbody> that evidences each wanted record (section_type, record_date, license_number, application_type): its first by
    key and place. parts are (key with section, body)."""
    return evidence(blocks_of(parts, key), [*key, "block_no"], wanted, [*[k for k in key if k != "section"], "block_no"])
