"""Column builders for titles, paragraphs, slugs, ids and headings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TITLE_LIMIT = 100
#: Headings of a body that make no claim (fixed values).
SCAFFOLDING_HEADINGS = ("what to do", "why the obvious fix does not work", "why the obvious fix doesn't work")
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def strip(c: Column) -> Column:
    """Without white space at both ends; trim() alone strips only spaces."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def collapse(c: Column) -> Column:
    """Stripped, with each inner run of white space as one space."""
    return strip(F.regexp_replace(c, r"(?U)\s+", " "))


def slug(title: Column, words: int = 6) -> Column:
    """The first words of a title, lower-case letters and digits, joined by hyphens; `entry` if none."""
    parts = F.filter(F.split(F.regexp_replace(F.lower(title), "[^a-z0-9]+", " "), " "), lambda x: x != "")
    return F.coalesce(F.nullif(F.array_join(F.slice(parts, 1, words), "-"), F.lit("")), F.lit("entry"))


def entry_id(kind: Column, seed: Column) -> Column:
    return F.concat(kind, F.lit("-"), F.substring(F.sha2(seed.cast("binary"), 256), 1, 6))


def entry_file(created: Column, title: Column, ident: Column) -> Column:
    """The file name that stands for an entry: date, slug, and the start of the id's suffix."""
    return F.concat(F.date_format(created, "yyyy-MM-dd"), F.lit("-"), slug(title), F.lit("-"), F.substring(F.substring_index(ident, "-", -1), 1, 4), F.lit(".md"))


def title_from_error(text: Column) -> Column:
    """The first line of an error, cut to TITLE_LIMIT characters with an ellipsis."""
    line = strip(F.split(strip(text), r"\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85  ]", 2)[0])
    cut = F.concat(F.regexp_replace(F.substring(line, 1, TITLE_LIMIT - 1), r"(?U)\s+$", ""), F.lit("…"))
    return F.when(F.char_length(line) > TITLE_LIMIT, cut).when(line == "", F.lit("Unspecified error")).otherwise(line)


def first_paragraph(body: Column) -> Column:
    """The first block between blank lines that is not empty nor a heading, white space collapsed; empty if none."""
    blocks = F.transform(F.split(strip(body), "\n\n"), collapse)
    return F.coalesce(F.get(F.filter(blocks, lambda b: (b != "") & ~b.startswith("#")), F.lit(0)), F.lit(""))


def title_words(title: Column) -> Column:
    """The set of a title's lower-case words without punctuation at their ends."""
    words = F.transform(F.split(collapse(F.lower(title)), " "), lambda w: F.btrim(w, F.lit(PUNCTUATION)))
    return F.array_distinct(F.filter(words, lambda w: w != ""))


def normalized_heading(c: Column) -> Column:
    return F.regexp_replace(collapse(F.lower(F.replace(c, F.lit("’"), F.lit("'")))), "[:.]+$", "")


def claim_headings(body: Column) -> Column:
    """How many level-2 headings outside code fences make a claim: a fold over the lines with the open fence."""
    fence = lambda line: F.regexp_extract(line, "^ {0,3}(`{3,}|~{3,})", 1)
    heading = lambda line: F.regexp_extract(line, r"^ {0,3}##(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*$", 1)
    is_heading = lambda line: line.rlike(r"^ {0,3}##(?:[ \t]+.*?)?(?:[ \t]+#+)?[ \t]*$")

    def step(acc, line):
        mark, opened = fence(line), acc["fence"]
        closes = (opened != "") & (mark != "") & (F.substring(mark, 1, 1) == F.substring(opened, 1, 1)) & (F.char_length(mark) >= F.char_length(opened)) & line.rlike("^ {0,3}(`{3,}|~{3,})[ \\t]*$")
        text = normalized_heading(heading(line))
        claims = (opened == "") & (mark == "") & is_heading(line) & (text != "") & ~text.isin(*SCAFFOLDING_HEADINGS)
        after = F.when(opened == "", mark).when(closes, F.lit("")).otherwise(opened)
        return F.struct(after.alias("fence"), (acc["n"] + claims.cast("int")).alias("n"))

    start = F.struct(F.lit("").alias("fence"), F.lit(0).alias("n"))
    return F.aggregate(F.split(body, "\n"), start, step, lambda acc: acc["n"])


def derive_scope(artifacts: Column) -> Column:
    """For each path its folder and everything below, or the file itself; sorted, distinct."""
    clean = F.transform(artifacts, lambda a: F.ltrim(F.replace(a, F.lit("\\"), F.lit("/")), F.lit("./")))
    scope = F.transform(clean, lambda a: F.when(a.contains("/"), F.concat(F.regexp_replace(a, "/[^/]*$", ""), F.lit("/**"))).otherwise(a))
    return F.array_sort(F.array_distinct(F.filter(scope, lambda s: s != "")))


def version(text: Column) -> Column:
    """The first dotted run of integers as an array, which compares as versions do."""
    return F.split(F.nullif(F.regexp_extract(text, r"(\d+(?:\.\d+)*)", 1), F.lit("")), r"\.").cast("array<int>")


def project_slug(path: Column) -> Column:
    return F.regexp_replace(path, r"[:/\\]", "-")


def text_of_blocks(blocks: Column) -> Column:
    """The text blocks of a content list (structs of type and text), joined by line ends."""
    return F.array_join(F.transform(F.filter(blocks, lambda b: (b["type"] == "text") & b["text"].isNotNull()), lambda b: b["text"]), "\n")


def diff_of_edit(name: Column, file: Column, old: Column, new: Column, content: Column, limit: int = 2000) -> Column:
    """The preview of an edit, cut to `limit` characters, or of a write, whose content is; null if a part is missing."""
    edit = F.concat(F.lit("- "), old, F.lit("\n+ "), new)
    return F.when(file.isNotNull(), F.when(name == "Edit", F.substring(edit, 1, limit)).when(name == "Write", F.concat(F.lit("+ "), F.substring(content, 1, limit))))
