"""The dialect of a corpus: marks, terminals, heading shapes. Immutable; passed to operators as literals."""

from __future__ import annotations

from dataclasses import dataclass

# The circled digits that mark notes, the characters that a comparison
# keeps, the marks that end a paragraph, how a new paragraph opens, the prefixes of
# journal data, the heading shapes from coarse to fine, file name and property rules.
CIRCLED = "①②③④⑤⑥⑦⑧⑨⑩⑪⑫⑬⑭⑮⑯⑰⑱⑲⑳"
CIRCLED_CLASS = "[①-⑳]"
CJK = "㐀-䶿一-鿿"
SIGNIFICANT = "㐀-䶿一-鿿A-Za-z0-9①-⑳□〈〉〔〕"
CJK_TERMINALS = "。！？”』》）】…—：；"
CJK_OPENER = r"(?U)^\s*(第[一二三四五六七八九十百]+[章节編编篇]|[一二三四五六七八九十]+[、．.]|[（(]\s*\d+\s*[)）]|\d+\s*[.．、]|附录|绪论|结语|参考|思考题|本章|学术)"
META_PREFIXES = ("收稿日期", "作者简介", "基金项目", "通信作者", "引用格式", "作者单位", "DOI")
HEADINGS = (
    r"(?U)^第[一二三四五六七八九十百零〇\d]+\s*[部编篇卷]",
    r"(?U)^第[一二三四五六七八九十百零〇\d]+\s*章",
    r"(?U)^第[一二三四五六七八九十百零〇\d]+\s*节",
    r"(?U)^[一二三四五六七八九十]+\s*[、．.]",
    r"(?U)^[（(]\s*[一二三四五六七八九十]+\s*[)）]",
    r"(?U)^\d+\s*[、．.]",
    r"(?U)^[（(]\s*\d+\s*[)）]",
)
CONTENTS_LINE = r"(?U)[…·．.]{3,}\s*[(（]?\d+[)）]?\s*$|^\S{0,20}[…·．.]{3,}"
SENTENCE_MARKS = "。，、；：？！"
FORMULA_KINDS = (("inline", r"\$[^$]{1,40}\$"), ("percent", r"\\%"), ("tilde", r"\\sim"), ("operator", r"\\(?:times|approx|pm|circ|cdot)"), ("script", r"[\^_]\{"))
NOTES_HEADING = "注释"
PROPERTY_NAMES = (("标签", "tags"), ("别名", "aliases"), ("样式", "cssclasses"))
FILE_NAME_FROM, FILE_NAME_TO = '\\/:*?"<>|', "-／-------"


@dataclass(frozen=True)
class Profile:
    terminals: str = CJK_TERMINALS
    opener: str = CJK_OPENER
    contents_line: str | None = CONTENTS_LINE


CJK_PROFILE = Profile()
#: For corpora in Latin script; leader dots are not looked for, as "..." is prose there.
LATIN_PROFILE = Profile(terminals=".!?…:;", opener=CJK_OPENER, contents_line=None)
