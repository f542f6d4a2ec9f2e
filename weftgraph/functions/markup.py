"""Wiki markup as Markdown, in the order of rules that the results depend on."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: the patterns of the markup, blocks first, then what is sought in each line
CODE = r"(?s)\{code(?::([^}]*))?\}(.*?)\{code\}"
NOFORMAT = r"(?s)\{noformat[^}]*\}(.*?)\{noformat\}"
PANEL = r"(?s)\{panel(?::title=([^|}]+))?\}(.*?)\{panel\}"
QUOTE = r"(?s)\{quote\}(.*?)\{quote\}"
COLOR = r"(?s)\{color:[^}]+\}(.*?)\{color\}"
NOTES = (("note", "⚠️ **注意：**"), ("warning", "❌ **警告：**"), ("info", "ℹ️ **說明：**"), ("tip", "💡 **提示：**"))
HEADING = r"^h([1-6])\.\s+(.+)$"
BULLET = r"^(\*+)\s(.+)$"
NUMBERED = r"^(#+)\s(.+)$"
INLINE = (
    (r"\[([^\|]+)\|([^\]]+)\]", "[$1]($2)"),
    (r"\[(https?://[^\]]+)\]", "<$1>"),
    (r"!([^!|\n]+)(?:\|[^!]*)?\!", "[圖片: $1]"),
    (r"(?<!\*)\*([^*\n]+)\*(?!\*)", "**$1**"),
    (r"(?<!_)_([^_\n]+)_(?!_)", "*$1*"),
    (r"\{\{([^}]+)\}\}", "`$1`"),
    (r"(?<!\-)\-([^-\n]+)\-(?!\-)", "~~$1~~"),
    (r"\+([^+\n]+)\+", "<u>$1</u>"),
)
_OPEN, _MID, _SHUT = "\x01", "\x02", "\x03"


def _strip(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def _blocks(text: Column, pattern: str, groups: int, render: Callable[[Column, Column], Column]) -> Column:
    """Each match of the pattern replaced by render(first group or null, last group)."""
    marked = F.regexp_replace(text, pattern, f"{_OPEN}{'$1' if groups > 1 else ''}{_MID}${groups}{_SHUT}")
    parts = F.split(marked, _OPEN, -1)

    def shown(part: Column, i: Column) -> Column:
        head, tail = F.substring_index(part, _SHUT, 1), F.substring(part, F.instr(part, _SHUT) + 1, F.length(part))
        return F.when(i == 0, part).otherwise(F.concat(render(F.substring_index(head, _MID, 1), F.substring_index(head, _MID, -1)), tail))

    return F.when(text.rlike(pattern), F.array_join(F.transform(parts, shown), "")).otherwise(text)


def _quoted(text: Column) -> Column:
    return F.replace(_strip(text), F.lit("\n"), F.lit("\n> "))


def _heading(line: Column) -> Column:
    return F.when(line.rlike(HEADING), F.concat(F.repeat(F.lit("#"), F.regexp_extract(line, HEADING, 1).cast("int")), F.lit(" "), _strip(F.regexp_extract(line, HEADING, 2)))).otherwise(line)


def _table(line: Column) -> Column:
    start = F.regexp_replace(line, r"^\s+", "")
    heads = F.transform(F.filter(F.split(line, r"\|\|", -1), lambda c: c != ""), _strip)
    header = F.concat(F.lit("| "), F.array_join(heads, " | "), F.lit(" |\n| "), F.array_join(F.transform(heads, lambda c: F.lit("---")), " | "), F.lit(" |"))
    cells = F.transform(F.split(F.regexp_replace(_strip(line), r"^\|+|\|+$", ""), r"\|", -1), _strip)
    return F.when(F.startswith(start, F.lit("||")), header).when(F.startswith(start, F.lit("|")), F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))).otherwise(line)


def _list(pattern: str, mark: str) -> Callable[[Column], Column]:
    return lambda line: F.when(line.rlike(pattern), F.concat(F.repeat(F.lit("  "), F.length(F.regexp_extract(line, pattern, 1)) - 1), F.lit(mark), _strip(F.regexp_extract(line, pattern, 2)))).otherwise(line)


def _inline(line: Column) -> Column:
    for pattern, shown in INLINE:
        line = F.regexp_replace(line, pattern, shown)
    return line


def _note(name: str, mark: str) -> Callable[[Column], Column]:
    return lambda t: _blocks(t, rf"(?s)\{{{name}[^}}]*\}}(.*?)\{{{name}\}}", 1, lambda _, body: F.concat(F.lit(f"> {mark} "), _strip(body)))


_BLOCK_RULES: tuple[Callable[[Column], Column], ...] = (
    lambda t: _blocks(t, CODE, 2, lambda lang, body: F.concat(F.lit("```"), _strip(lang), F.lit("\n"), _strip(body), F.lit("\n```"))),
    lambda t: _blocks(t, NOFORMAT, 1, lambda _, body: F.concat(F.lit("```\n"), _strip(body), F.lit("\n```"))),
    lambda t: _blocks(t, PANEL, 2, lambda title, body: F.concat(F.lit("> "), F.when(title != "", F.concat(F.lit("**"), _strip(title), F.lit("**\n"))).otherwise(""), F.lit("> "), _quoted(body))),
    lambda t: _blocks(t, QUOTE, 1, lambda _, body: F.concat(F.lit("> "), _quoted(body))),
    lambda t: F.regexp_replace(t, COLOR, "$1"),
    *[_note(name, mark) for name, mark in NOTES],
)
_LINE_RULES = (_heading, _table, _list(BULLET, "- "), _list(NUMBERED, "1. "), _inline)


def wiki_to_markdown(text: Column) -> Column:
    """Blocks, then each line by itself: heading, table, list, inline marks. A null or blank text is empty.

    The rules run one after the other on what the one before made, so a heading of wiki markup, which becomes a line of
    number signs, is then read as a numbered list; that is the behaviour to match. Marks \\x01 to \\x03 are no part of a text.
    """
    # each rule is a transform of its own: its input is then a variable, not a copy of all rules before it
    whole = F.array(F.translate(text, _OPEN + _MID + _SHUT, ""))
    for rule in _BLOCK_RULES:
        whole = F.transform(whole, rule)
    lines = F.split(F.get(whole, 0), "\n", -1)
    for rule in _LINE_RULES:
        lines = F.transform(lines, rule)
    return F.when(F.coalesce(_strip(text), F.lit("")) == "", "").otherwise(F.regexp_replace(F.array_join(lines, "\n"), r"\s+$", ""))
