"""Unified diffs: hunk lines, added and removed runs, whole records in them, and replay of a chain of diffs.

Files are read in parallel, each cut into hunks, runs and blocks within its row. Replay is sequential by nature: each
chain's files are one ordered group, replayed by a small state machine under applyInPandas that gives back blocks, not documents.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import diff_timestamp, valid_record
from . import html

#: A diff that contradicts this many known lines, and this part of them, starts the document anew.
RESET_MIN, RESET_RATIO = 50, 0.20
#: Lines on either side of a change in which its block is looked for; a block is about 25 lines.
AROUND = 200
_HUNK = r"^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@"


def headers(diffs: DataFrame, key: list[str], content: str = "content") -> DataFrame:
    """(key, old_ts, new_ts) of files that are unified diffs; error pages and other texts are left out."""
    line = lambda n: F.try_element_at(F.split(content, "\n", 3), F.lit(n))
    return diffs.where(line(1).startswith("--- ") & line(2).startswith("+++ ")).select(*key, diff_timestamp(line(1)).alias("old_ts"), diff_timestamp(line(2)).alias("new_ts"))


def report(files: DataFrame, content: str = "content") -> DataFrame:
    """(files, read_errors, skipped): files of a chain, those that could not be read (null) and those that are no diffs."""
    real = F.col(content).rlike(r"^--- [^\n]*\n\+\+\+ ")
    return files.agg(F.count("*").alias("files"), F.count_if(F.col(content).isNull()).alias("read_errors"), F.count_if(~real).alias("skipped"))


def lines(diffs: DataFrame, key: list[str], content: str = "content") -> DataFrame:
    """(key, pos, hunk, op, text) of the lines of whole hunks; op is '+', '-' or ' '. A hunk ends once its header's counts are
    reached; one that breaks off is left out."""
    own = _bodies(diffs, key, content).where("complete")
    return own.select(*key, "hunk", F.explode("body").alias("x")).select(*key, "x.pos", "hunk", "x.op", "x.text")


def truncated(diffs: DataFrame, key: list[str], content: str = "content") -> DataFrame:
    """(key, hunks, truncated): the number of whole hunks, and whether one breaks off."""
    return _bodies(diffs, key, content).groupBy(*key).agg(F.count_if("complete").alias("hunks"), F.bool_or(~F.col("complete")).alias("truncated"))


def _bodies(diffs: DataFrame, key: list[str], content: str) -> DataFrame:
    """(key, hunk, complete, body) of the hunks of diffs, cut within their rows: body has pos, op and text of the lines that the header's counts ask for."""
    op = lambda x: F.when(F.substring(x, 1, 1).isin("+", "-"), F.substring(x, 1, 1)).otherwise(" ")
    text = lambda x: F.when(F.substring(x, 1, 1).isin("+", "-", " "), F.substr(x, F.lit(2))).otherwise(x)
    places = lambda rows, is_one: F.filter(F.transform(rows, lambda x, i: F.when(is_one(x), i)), lambda i: i.isNotNull())
    number = lambda h, k: F.coalesce(F.regexp_extract(F.get(h["rows"], F.lit(0)), _HUNK, k).try_cast("int"), F.lit(1))

    def said(h: Column) -> Column:
        placed = F.filter(F.transform(h["rows"], lambda x, i: F.struct((i + h["at"]).alias("pos"), x.alias("line"))), lambda x: ~x["line"].startswith("@@") & ~x["line"].startswith("\\"))
        return F.struct(h["no"].alias("hunk"), number(h, 2).alias("old"), number(h, 4).alias("new"), F.transform(placed, lambda x: F.struct(x["pos"].alias("pos"), op(x["line"]).alias("op"), text(x["line"]).alias("text"))).alias("rows"))

    def cut(h: Column) -> Column:
        sides = F.struct(places(h["rows"], lambda x: x["op"] != "+").alias("old"), places(h["rows"], lambda x: x["op"] != "-").alias("new"))
        # the line at which a side's count is reached; all lines if it never is
        last = lambda at, side: F.when(h[side] <= 0, 0).otherwise(F.coalesce(F.get(at[side], h[side] - 1) + 1, F.size(h["rows"])))
        got = lambda at, side, n: F.size(F.filter(at[side], lambda i: i < n)) == h[side]
        whole = lambda at, n: F.struct(h["hunk"].alias("hunk"), (got(at, "old", n) & got(at, "new", n)).alias("complete"), F.slice(h["rows"], F.lit(1), n).alias("body"))
        return html.let(sides, lambda at: html.let(F.greatest(last(at, "old"), last(at, "new")), lambda n: whole(at, n)))

    def hunks(rows: Column) -> Column:
        # from each line that begins a hunk to the next such line
        spans = html.let(places(rows, lambda x: x.startswith("@@")), lambda at: F.transform(at, lambda a, k: F.struct((k + 1).alias("no"), a.alias("at"), F.slice(rows, a + 1, F.coalesce(F.get(at, k + 1), F.size(rows)) - a).alias("rows"))))
        return F.transform(F.transform(F.filter(spans, lambda h: F.get(h["rows"], F.lit(0)).rlike(_HUNK)), said), cut)

    # worked out within the generator, as a filter on its result would else have it worked out again
    return diffs.select(*key, F.explode(html.let(F.split(content, "\n"), hunks)).alias("h")).select(*key, "h.*")


def _run_blocks(body: Column, op: Column) -> Column:
    """The <tbody> groups, as texts, that begin and end within one run of an operation's lines in a hunk's body."""
    # a blank line begins a new piece: where another operation or a gap stands, and before each line with <tbody
    opens = lambda x: F.contains(F.lower(x["text"]), F.lit("<tbody"))
    gap = lambda x, i: (i > 0) & (F.get(body, i - 1)["pos"] + 1 < x["pos"])
    line = lambda x, i: F.when(x["op"] != op, F.lit("\n")).otherwise(F.concat(F.when(opens(x) | gap(x, i), F.lit("\n")).otherwise(""), op, x["text"], F.lit("\n")))
    pieces = F.transform(F.split(F.array_join(F.transform(body, line), ""), "\n\n+"), lambda x: F.split(F.regexp_replace(x, r"\A\n+|\n+\z", ""), "\n"))
    bare = F.transform(pieces, lambda p: F.transform(p, lambda x: F.substr(x, F.lit(2))))
    begun = F.filter(bare, lambda p: F.contains(F.lower(p[0]), F.lit("<tbody")))
    closes = lambda x: F.contains(F.lower(x), F.lit("</tbody>"))
    closed = F.filter(begun, lambda p: F.exists(p, closes))
    first = lambda p: F.array_min(F.filter(F.transform(p, lambda x, i: F.when(closes(x), i + 1)), lambda i: i.isNotNull()))
    return F.transform(closed, lambda p: F.array_join(F.slice(p, F.lit(1), first(p)), "\n"))


def runs(diff_lines: DataFrame, key: list[str], op: str = "-") -> DataFrame:
    """Contiguous runs of one operation as lists of lines (gaps and islands)."""
    own = run_lines(diff_lines, key, op)
    return own.groupBy(*key, "island").agg(F.min("pos").alias("pos"), F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]).alias("lines")).drop("island")


def run_lines(diff_lines: DataFrame, key: list[str], op: str = "-") -> DataFrame:
    """The lines of one operation with island, the same for all lines of a run."""
    order = Window.partitionBy(*key).orderBy("pos")
    return diff_lines.where(F.col("op") == op).withColumn("island", F.col("pos") - F.row_number().over(order))


def streams(diffs: DataFrame, key: list[str], content: str = "content", now: Column | None = None) -> DataFrame:
    """(key, old_ts, new_ts, added, removed, new_side, old_side) of each diff: its added and its removed lines as texts, and both with the
    lines around them. Header lines are left out wherever they stand; hunk counts are not asked. A time that cannot be read is now."""
    head = lambda x: x.startswith("--- ") | x.startswith("+++ ") | x.startswith("@@")
    bare = lambda rows: F.transform(rows, lambda x: F.when(x.startswith("+") | x.startswith("-"), F.substr(x, F.lit(2))).otherwise(x))
    of = lambda keep: F.array_join(bare(F.filter("body", keep)), "\n")
    time = lambda mark: F.coalesce(diff_timestamp(F.try_element_at(F.filter("heads", lambda x: x.startswith(mark)), F.lit(-1))), now if now is not None else F.current_timestamp())
    # cut once, as each of the columns reads all lines
    rows = diffs.select(*key, F.split(content, "\n").alias("rows"))
    cut = rows.select(*key, F.filter("rows", head).alias("heads"), F.filter("rows", lambda x: ~head(x)).alias("body"))
    return cut.select(
        *key,
        time("--- ").alias("old_ts"),
        time("+++ ").alias("new_ts"),
        of(lambda x: x.startswith("+")).alias("added"),
        of(lambda x: x.startswith("-")).alias("removed"),
        of(lambda x: ~x.startswith("-")).alias("new_side"),
        of(lambda x: ~x.startswith("+")).alias("old_side"),
    )


def extract_records(diffs: DataFrame, key: list[str], content: str = "content", now: Column | None = None) -> DataFrame:
    """Valid records of single diffs (key with section, content), each natural key once a diff: of the added lines, else of the removed ones.

    Only where these give a record with a license number that is not valid, as its rows were not changed and stand around, are the
    sides with context read too, for natural keys that the first pass lacks. Rows need no <tbody>. Result: key, section_type, html.DEFAULTS, scraped_at.
    """
    section = F.col("section")
    texts = streams(diffs, key, content, now).select("*", html.parts_of(section, F.col("added")).alias("own added"), html.parts_of(section, F.col("removed")).alias("own removed"))
    valid = lambda p: F.coalesce(valid_record(section, html.said_by(p, "record_date"), html.said_by(p, "license_number"), html.said_by(p, "application_type")), F.lit(False))
    cut = lambda c: F.coalesce(F.exists(c, lambda p: (F.coalesce(html.said_by(p, "license_number"), F.lit("")) != "") & ~valid(p)), F.lit(False))
    broken = cut(F.col("own added")) | cut(F.col("own removed"))
    side = lambda no, ts, parts: F.transform(parts, lambda p: F.struct(F.lit(no).alias("side"), F.col(ts).alias("scraped_at"), p.alias("part")))
    around = lambda c: F.when(F.col("broken"), html.parts_of(section, F.col(c)))
    sides = F.array(side(0, "new_ts", F.col("own added")), side(1, "old_ts", F.col("own removed")), side(2, "new_ts", around("new_side")), side(3, "old_ts", around("old_side")))
    each = texts.withColumn("broken", broken).select(*key, F.explode(F.flatten(F.filter(sides, lambda s: s.isNotNull()))).alias("s"))
    own = [*key, "side", "scraped_at"]
    found = html.filled(each.select(*key, "s.*"), own)
    source = [k for k in key if k != "section"]
    place = F.row_number().over(Window.partitionBy(*source, *html.NATURAL_KEY).orderBy("side", "pos"))
    every = found.where(valid_record(*[F.col(c) for c in html.NATURAL_KEY])).withColumn("place in key", place).where("`place in key` = 1")
    return every.select(*source, "section_type", *html.DEFAULTS, "scraped_at")


def viewer_blocks(diffs: DataFrame, key: list[str], content: str = "content") -> DataFrame:
    """(key, side, block_no, body): record groups of a diff's added lines (side 0) and removed ones (side 1), as the source viewer shows them.

    A group goes from a line with <tbody to the next with </tbody>. Where a side has no <tbody at all, from a line with a cell that says a date
    label to the next such line, wrapped in <tbody>.
    """
    texts = streams(diffs, key, content).select(*key, F.posexplode(F.array("added", "removed")).alias("side", "text"))
    rows = texts.select(*key, "side", F.contains(F.lower("text"), F.lit("<tbody")).alias("wrapped"), F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    low = F.lower("line")
    label = "|".join(x.replace(".", r"\.") for x in html.DATE_LABELS.values())
    dated = F.col("line").rlike(rf"(?i)<td[^>]*>\s*(?:<[^>]+>)*\s*(?:{label})\s*(?:</[^>]+>)*\s*</td>")
    opens, closes = F.contains(low, F.lit("<tbody")), F.contains(low, F.lit("</tbody>"))
    before = Window.partitionBy(*key, "side").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy(*key, "side").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    # a wrapped group lies between two closing lines; bare ones begin at each date label
    numbered = rows.withColumn("group", F.when(F.col("wrapped"), F.coalesce(F.count_if(closes).over(before), F.lit(0))).otherwise(F.count_if(dated).over(upto)))
    whole = Window.partitionBy(*key, "side", "group")
    kept = numbered.withColumn("first", F.min(F.when(opens, F.col("pos"))).over(whole)).withColumn("last", F.max(F.when(closes, F.col("pos"))).over(whole))
    kept = kept.where((F.col("wrapped") & (F.col("pos") >= F.col("first")) & F.col("last").isNotNull()) | (~F.col("wrapped") & (F.col("group") > 0)))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n")
    body = F.when(F.first("wrapped"), text).otherwise(F.concat(F.lit("<tbody>\n"), text, F.lit("\n</tbody>")))
    return kept.groupBy(*key, "side", F.col("group").alias("block_no")).agg(body.alias("body"))


def source_blocks_of_diffs(diffs: DataFrame, key: list[str], wanted: DataFrame, content: str = "content") -> DataFrame:
    """(key but section, natural key, html): in each diff, the first group that evidences a wanted record, added lines first."""
    return html.evidence(viewer_blocks(diffs, key, content), [*key, "side", "block_no"], wanted, ["side", "block_no"], [k for k in key if k != "section"])


def records_of_diffs(diffs: DataFrame, key: list[str], content: str = "content") -> DataFrame:
    """Records that stand whole in added or removed runs of diffs (key with section, content): the first by key and place wins.

    Result: the natural key and fields, source (the key but section), side ('entry' or 'exit') and the html that evidences it.
    """
    cut = _bodies(diffs, key, content).where("complete")
    mark = F.array(*[F.struct(F.lit(op).alias("op"), F.lit(side).alias("side")) for op, side in (("+", "entry"), ("-", "exit"))])
    each = cut.select(*key, "hunk", "body", F.explode(mark).alias("m"))
    blocks = each.select(*key, "hunk", "m.side", F.posexplode(_run_blocks(F.col("body"), F.col("m.op"))).alias("block_no", "html"))
    own = [*key, "hunk", "block_no", "side", "html"]
    found = html.records(blocks, own, "html").drop("pos")
    natural = ["section_type", "record_date", "license_number", "application_type"]
    source = [k for k in key if k != "section"]
    first = F.row_number().over(Window.partitionBy(*natural).orderBy(*source, F.col("side"), "hunk", "block_no"))
    return found.withColumn("place in key", first).where("`place in key` = 1").select(*source, "side", "section_type", *html.DEFAULTS, "html")


def _hunks(content: str) -> tuple[list[tuple[int, list[tuple[str, str]]]], bool]:
    """(first old line, [(op, text)]) of each whole hunk, and whether one broke off; what follows that is left out."""
    rows, i, head, out = content.split("\n"), 0, re.compile(_HUNK), []
    if not (len(rows) > 1 and rows[0].startswith("--- ") and rows[1].startswith("+++ ")):
        return [], False
    while i < len(rows):
        m = head.match(rows[i])
        i += 1
        if not m:
            continue
        old, new, body = int(m[2] or 1), int(m[4] or 1), []
        first = int(m[1]) - (old > 0)
        while i < len(rows) and (old > 0 or new > 0) and not rows[i].startswith("@@"):
            op, text = (rows[i][0], rows[i][1:]) if rows[i][:1] in ("+", "-", " ") else (" ", rows[i])
            if not rows[i].startswith("\\"):
                body.append((op, text))
                old, new = old - (op != "+"), new - (op != "-")
            i += 1
        if old or new:
            return out, True
        out.append((first, body))
    return out, False


#: A line of the document: a list of its text, or of None while no file has shown it. States share their lines, so what a later file
#: shows of a line is known in every state that holds it.
_Line = list


def _whole_blocks(lines: list[_Line], low: int, high: int) -> Iterator[tuple[int, int]]:
    """(from, to) of the <tbody> groups that touch the lines from low to high and are known throughout."""
    begin = None
    for k, (text,) in enumerate(lines):
        if text is None:
            begin = None
            continue
        if "<tbody" in text.lower():
            begin = k
        if begin is not None and "</tbody>" in text.lower():
            if begin < high and k >= low:
                yield begin, k + 1
            begin = None


def _size(lines: list[_Line]) -> tuple[int, int]:
    """Lines up to the last known one, and how many of them are known."""
    known = [k for k, (text,) in enumerate(lines) if text is not None]
    return (known[-1] + 1 if known else 0), len(known)


def _replay(files: pd.DataFrame) -> pd.DataFrame:
    """One chain: a row a file with its counts, and a row for each block that some state evidences, read once all files are known."""
    now: list[_Line] = []
    out, pending, fresh, first = [], [], False, True
    for row in files.sort_values("seq").itertuples():
        hunks, broken = _hunks(row.content or "")
        if not hunks and not broken:
            out.append((row.section, row.seq, "file", 0, False, 0, *_size(now), []))
            continue
        size = max((at + sum(op != "+" for op, _ in body) for at, body in hunks), default=0)
        now += [[None] for _ in range(size + AROUND - len(now))]  # more than the file speaks of, as later ones may show what follows
        said = [(now[at + k][0], text) for at, body in hunks for k, text in enumerate(t for op, t in body if op != "+")]
        known, bad = sum(x is not None for x, _ in said), sum(x is not None and x != t for x, t in said)
        reset = known >= RESET_MIN and bad >= RESET_RATIO * known
        if reset:
            now, fresh = [[None] for _ in range(size + AROUND)], True
        old, new, seen, changed, added, at = now, [], set(), [], [], 0
        for start, body in hunks:
            new += old[at:start]
            at, low, put = max(at, start), max(at, start), len(new)
            for op, text in body:
                if op == "+":
                    new.append([text])
                else:
                    line, at = old[at], at + 1
                    if line[0] is None:
                        line[0] = text
                    if op == "-":
                        continue
                    new.append(line if line[0] == text else [text])  # what is shown now holds from now on
                seen.add(id(new[-1]))
            changed += [(low, at)] * any(op == "-" for op, _ in body)
            added += [(put, len(new))] * any(op == "+" for op, _ in body)
        new += old[at:]
        cut = lambda lines, low, high: (lines[max(0, low - AROUND) : high + AROUND], min(low, AROUND), min(low, AROUND) + high - low)
        if not bad and not first and not fresh:
            pending += [(row.seq, 1, "mutation", *cut(old, low, high), None) for low, high in changed]
        if first:
            pending.append((row.seq, 2, "state", old, 0, len(old), None))
        if fresh:
            pending.append((row.seq, 3, "state", new, 0, len(new), None))
        for low, high in added:
            lines, a, b = cut(new, low, high)
            pending.append((row.seq, 4, "entry", lines, a, b, [id(x) in seen for x in lines]))
        now, first, fresh = new, False, broken
        out.append((row.section, row.seq, "file", len(hunks), bool(reset), 0 if reset else bad, *_size(now), []))
        if broken:
            now = []
    if out:
        pending.append((out[-1][1], 5, "final", now, 0, len(now), None))
    section, shown = (files["section"].iloc[0] if len(files) else None), set()
    for seq, _, origin, lines, low, high, confirmed in sorted(pending, key=lambda x: x[:2]):
        for a, b in _whole_blocks(lines, low, high):
            text = tuple(x[0] for x in lines[a:b])
            if (confirmed is None or all(confirmed[a:b])) and text not in shown:
                shown.add(text)
                out.append((section, seq, origin, 0, False, 0, 0, 0, list(text)))
    return pd.DataFrame(out, columns=["section", "seq", "origin", "hunks", "reset", "mismatches", "n_lines", "n_known", "lines"])


def replay(files: DataFrame) -> DataFrame:
    """Replays each chain's files (section, seq, content) in order.

    Result: a row a file (origin 'file') with hunks, reset, mismatches, n_lines and n_known of the document after it; and a row for each
    different block that a state evidences, as lines, with the file and the origin that show it first: 'mutation' (in the state before),
    'state' (whole pages at the start or after a reset), 'entry' or 'final'. A line that only a later file shows is known in
    earlier states, too. A chain is one task that holds its document; chains run in parallel.
    """
    return files.select("section", "seq", "content").groupBy("section").applyInPandas(_replay, "section string, seq long, origin string, hunks long, reset boolean, mismatches long, n_lines long, n_known long, lines array<string>")


def records_of_replay(replayed: DataFrame) -> DataFrame:
    """Records of the blocks that a replay evidences: of each natural key the first by file and origin. Result adds seq, origin and html."""
    blocks = replayed.where("origin <> 'file'").select("section", "seq", "origin", F.array_join("lines", "\n").alias("body")).distinct()
    blocks = blocks.withColumn("evidence", F.sha2("body", 256))
    own = ["section", "seq", "origin", "evidence"]
    found = html.records(blocks.withColumnRenamed("body", "html"), [*own, "html"], "html").drop("pos").withColumnRenamed("section_type", "section")
    natural = ["section", "record_date", "license_number", "application_type"]
    rank = F.array_position(F.array(*[F.lit(x) for x in ("mutation", "state", "entry", "final")]), F.col("origin"))
    first = F.row_number().over(Window.partitionBy(*natural).orderBy("seq", rank, "evidence"))
    return found.withColumn("place in key", first).where("`place in key` = 1").select("seq", "origin", F.col("section").alias("section_type"), *html.DEFAULTS, "html")


def work(files: DataFrame, path: Column, section: str | None = None, limit: int | None = None) -> DataFrame:
    """Diff files to read, with their section by file name: all, of one section, or the first so many by section and name."""
    from ..functions.scalars import section_of_file

    out = files.withColumn("section", section_of_file(F.element_at(F.split(path, "/"), -1))).where("section is not null")
    out = out.where(F.col("section") == section) if section else out
    return out.orderBy("section", path).limit(limit) if limit is not None else out
