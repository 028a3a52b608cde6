"""Text kernel: Column to Column, all on the JVM.

White space is Unicode's, as (?U) makes it; a pattern's dot stops at newline
only, as (?d) makes it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vellum.profile import CIRCLED, CJK, FILE_NAME_FROM, FILE_NAME_TO, META_PREFIXES, NOTES_HEADING, SIGNIFICANT, Profile

_DIGITS = ("０１２３４５６７８９", "0123456789")


def strip(x: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(x, r"(?U)\A\s+|\s+\z", "")


def strip_right(x: Column) -> Column:
    return F.regexp_replace(x, r"(?U)\s+\z", "")


def strip_left(x: Column) -> Column:
    return F.regexp_replace(x, r"(?U)\A\s+", "")


def strip_tags(x: Column) -> Column:
    """Content of <sub> and then of <sup>; a tag without its end on the same line stays."""
    for tag in ("sub", "sup"):
        x = F.regexp_replace(x, f"(?d)<{tag}>(.*?)</{tag}>", "$1")
    return x


def join_lines(lines: Column) -> Column:
    """One paragraph of printed lines: a space only between two ASCII letters or digits."""

    def append(text: Column, line: Column) -> Column:
        gap = F.when(text.rlike("[0-9A-Za-z]$") & line.rlike("^[0-9A-Za-z]"), F.lit(" ")).otherwise(F.lit(""))
        return F.when(line == "", text).otherwise(F.concat(text, gap, line))

    return F.aggregate(F.transform(F.coalesce(lines, F.array().cast("array<string>")), strip), F.lit(""), append)


def text_or_lines(text: Column, lines: Column) -> Column:
    """A block's own text, else its joined lines; tags removed, trimmed."""
    return strip(strip_tags(F.coalesce(F.nullif(text, F.lit("")), join_lines(lines))))


def significant(x: Column) -> Column:
    """The characters that a comparison keeps."""
    return F.regexp_replace(x, f"[^{SIGNIFICANT}]", "")


def tidy_footnote(x: Column) -> Column:
    """Repair breaks and widths in a note without adding punctuation."""
    x = F.regexp_replace(strip_tags(x), "－", "-")
    for pattern, into in (
        (rf"(?U)\s*:\s*(?=[{CJK}《（])", "："),
        (rf"(?U)(?<=[{CJK}》）])\s*:\s*", "："),
        (rf"(?U)(?<=[{CJK}》）])\s*;\s*", "；"),
        (r"(?U)\s*·\s*", "·"),
        (rf"(?U)\(\s*([^()]*[{CJK}][^()]*?)\s*\)", "（$1）"),
        (r"(?U)\s+([，。、；：》】」』？！])", "$1"),
        (r"(?U)([《【「『])\s+", "$1"),
        (r"(?U)\s{2,}", " "),
    ):
        x = F.regexp_replace(x, pattern, into)
    return strip(x)


def leading_marks(x: Column) -> Column:
    """The run of circled digits that a note starts with; empty if none."""
    return F.regexp_extract(x, "^[①-⑳]+", 0)


def mark_index(mark: Column) -> Column:
    """0 for ①, 19 for ⑳."""
    return (F.instr(F.lit(CIRCLED), mark) - 1).cast("long")


def mark_of(index: Column) -> Column:
    """The circled digit of an index; empty outside 0 to 19."""
    return F.when((index >= 0) & (index < len(CIRCLED)), F.substring(F.lit(CIRCLED), (index + 1).cast("int"), F.lit(1))).otherwise("")


def pieces(x: Column) -> Column:
    """The text cut before each circled digit."""
    return F.filter(F.split(x, "(?=[①-⑳])"), lambda p: p != "")


def is_meta(x: Column) -> Column:
    return x.rlike("^(" + "|".join(META_PREFIXES) + ")")


def first_number(x: Column) -> Column:
    """The first run of digits, full-width ones too; null if none or too long for a number."""
    digits = F.translate(F.regexp_extract(x, r"(?U)\d+", 0), *_DIGITS)
    return F.nullif(digits, F.lit("")).try_cast("long")


def ends_open(x: Column, profile: Profile) -> Column:
    """Whether the last character is none that ends a paragraph."""
    return (x != "") & ~F.right(x, F.lit(1)).isin(*profile.terminals)


_NO_PARAGRAPH = r"^(#|<!--|!\[|\*|<small>)"
_REFERENCES = r"(?U)(\[\^\d+\]\s*)+$"


def stays_open(block: Column, profile: Profile) -> Column:
    """Whether a rendered block is a paragraph that does not end."""
    tail = strip_right(F.regexp_replace(block, _REFERENCES, ""))
    return (block != "") & ~block.rlike(_NO_PARAGRAPH) & ends_open(tail, profile)


def is_continued(block: Column, profile: Profile) -> Column:
    """Whether a rendered block can be the rest of a paragraph."""
    return (block != "") & ~block.rlike(_NO_PARAGRAPH) & ~block.rlike(profile.opener)


def is_only_references(block: Column) -> Column:
    """Whether nothing but note references stands in a block."""
    return (block != "") & (F.regexp_replace(block, _REFERENCES, "") == "")


def is_break(before: Column, after: Column, profile: Profile) -> Column:
    """Whether a page boundary between two rendered blocks cuts a paragraph."""
    return stays_open(before, profile) & is_continued(after, profile)


def context(x: Column, at: Column, before: int = 18, after: int = 14) -> Column:
    """The mark at a 0-based place in brackets with the text around it."""
    left = F.substring(x, F.greatest(at - before, F.lit(0)) + 1, F.least(at, F.lit(before)))
    here = F.substring(x, at + 1, F.lit(1))
    return F.translate(F.concat(left, F.lit("【"), here, F.lit("】"), F.substring(x, at + 2, F.lit(after))), "\t", " ")


def cut(x: Column, n: int) -> Column:
    """Long text as its two ends and how much is left out."""
    left_out = F.concat(F.lit("……〔中略 "), (F.length(x) - n).cast("string"), F.lit(" 字〕……"))
    return F.when(F.length(x) <= n, x).otherwise(F.concat(F.left(x, F.lit(n // 2)), left_out, F.right(x, F.lit(n - n // 2))))


def safe_name(x: Column) -> Column:
    """A title as a file name."""
    return strip(F.translate(x, FILE_NAME_FROM, FILE_NAME_TO))


def frontmatter(x: Column) -> Column:
    """The YAML head without its fences; null if there is none."""
    return F.when(x.rlike(r"(?s)\A---\n.*?\n---\n"), F.regexp_extract(x, r"(?s)\A---\n(.*?)\n---\n", 1))


def without_frontmatter(x: Column) -> Column:
    return F.regexp_replace(x, r"(?s)\A---\n.*?\n---\n", "")


_NOTES = rf"(?U)\n#+\s*{NOTES_HEADING}\s*\n"


def body_and_notes(x: Column) -> tuple[Column, Column]:
    """The text before and after the first heading of notes."""
    parts = F.split(x, _NOTES, 2)
    return F.get(parts, F.lit(0)), F.coalesce(F.get(parts, F.lit(1)), F.lit(""))


def without_callouts(x: Column, title: str = "") -> Column:
    """Without callout boxes whose title line matches."""
    return F.regexp_replace(x, rf"(?U)>\s*\[!\w+\][^\n]*{title}[^\n]*\n(?:>[^\n]*\n?)*", "")


def plain_markdown(x: Column) -> Column:
    """Markdown without what is not source text: comments, note labels, images, marks of quotes and headings."""
    for pattern in (r"(?s)<!--.*?-->", r"(?U)\[\^\d+\]:?", r"!\[[^\]]*\]\([^)]*\)", r"(?U)>\s*\[!\w+\]\s*", r"(?Um)^\s*[>#]+\s*", r"\*\*", "---"):
        x = F.regexp_replace(x, pattern, "")
    return x


def without_code(x: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(x, r"(?s)```.*?```", ""), r"`[^`\n]*`", "")


def parse_added_note(x: Column) -> Column:
    """struct(page_idx, circ, text) of "page:circled:text"; null if malformed."""
    parts = F.split(x, ":", 3)
    page, circ = F.trim(F.get(parts, F.lit(0))), F.trim(F.get(parts, F.lit(1)))
    good = (F.size(parts) == 3) & page.rlike(r"^\d+$") & circ.rlike(r"^\d+$")
    return F.when(good, F.struct(page.try_cast("long").alias("page_idx"), (circ.try_cast("long") - 1).alias("circ"), strip(F.get(parts, F.lit(2))).alias("text")))


def parse_numbers(x: Column) -> Column:
    """array<bigint> of a comma list; the full-width comma separates too."""
    return F.transform(F.filter(F.transform(F.split(F.translate(x, "，", ","), ","), strip), lambda p: p != ""), lambda p: p.cast("long"))


def fingerprint(*parts: Column) -> Column:
    """Twelve hex digits of the parts' SHA-256."""
    return F.left(F.sha2(F.concat_ws("|", *parts).cast("binary"), 256), F.lit(12))


def member_is_inside(path: Column) -> Column:
    """Whether an archive member's path stays below the folder it is unpacked in."""
    parts = F.filter(F.split(F.translate(path, "\\", "/"), "/"), lambda p: (p != "") & (p != "."))
    depth = F.aggregate(parts, F.struct(F.lit(0).alias("d"), F.lit(0).alias("low")), lambda a, p: F.struct((a["d"] + F.when(p == "..", -1).otherwise(1)).alias("d"), F.least(a["low"], a["d"] + F.when(p == "..", -1).otherwise(1)).alias("low")), lambda a: a["low"])
    return ~path.rlike(r"^([/\\]|[A-Za-z]:)") & (depth >= 0)


def parse_rect(x: Column) -> Column:
    """array of the four numbers of a crop rectangle; the full-width comma separates too; null if they are not four."""
    parts = F.transform(F.split(F.translate(x, "，", ","), ","), lambda p: strip(p).try_cast("double"))
    return F.when((F.size(parts) == 4) & ~F.exists(parts, lambda p: p.isNull()), parts)
