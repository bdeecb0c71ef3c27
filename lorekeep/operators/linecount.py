"""Blank, comment and code lines of source files, block comments followed over lines and kept out of strings."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .textscan import BLANKS, LINE_COMMENTS, lines_of, rollup_languages

# What one language's lexer knows, as patterns. A quote that is not closed ends with its line.
_C_BLOCK = r"/\*.*?(?:\*/|\z)"
_C_LINE = r"//[^\n]*+"
_HASH = r"#[^\n]*+"
_ONE_LINE = tuple(rf"{q}(?:[^{q}\\\n]|\\.)*+{q}?+" for q in "\"'")
# Possessive loops, as the others make a call on the stack for every character.
_TRIPLE = tuple(rf"{q * 3}(?:[^{q}\\]|\\.|{q}(?!{q * 2}))*+(?:{q * 3}|\\?\z)" for q in "\"'")


@dataclass(frozen=True)
class Lexer:
    """Patterns of comments and of strings, and the characters with which one of them may begin."""

    comments: tuple[str, ...]
    strings: tuple[str, ...]
    begins: str

    def pattern(self) -> str:
        """Cuts a text into comments (group 1), strings, newlines and the rest."""
        comments, strings = "|".join(self.comments), "".join(f"|{x}" for x in self.strings)
        return rf"(?sdm)({comments}){strings}|\n|[^\n{self.begins}]++|."


_SCRIPT = Lexer((_C_BLOCK, _C_LINE), (*_ONE_LINE, r"`(?:[^`\\]|\\.)*+`?+"), "/\"'`")
#: Comments and strings of the counted languages with block comments.
LEXERS = {
    "JavaScript": _SCRIPT,
    "TypeScript": _SCRIPT,
    "JSX": _SCRIPT,
    "CSS": Lexer((_C_BLOCK,), _ONE_LINE, "/\"'"),
    "SCSS": Lexer((_C_BLOCK, _C_LINE), _ONE_LINE, "/\"'"),
    "Groovy": Lexer((_C_BLOCK, _C_LINE), (*_TRIPLE, *_ONE_LINE), "/\"'"),
    "HTML": Lexer((r"<!--.*?(?:-->|\z)",), (), "<"),
    # A literal of three quotes that begins a line explains; elsewhere it is a value.
    "Python": Lexer(tuple(rf"^[ \t]*+[rRuU]?+{x}" for x in _TRIPLE) + (_HASH,), (*_TRIPLE, *_ONE_LINE), "#\"'"),
}


def without_comments(text: Column, lexer: Lexer) -> Column:
    """The text with comments taken out and every newline kept."""
    pattern = F.lit(lexer.pattern())
    pieces = F.regexp_extract_all(text, pattern, F.lit(0))
    comments = F.regexp_extract_all(text, pattern, F.lit(1))
    kept = F.zip_with(pieces, comments, lambda piece, comment: F.when(comment == "", piece).otherwise(
        F.regexp_replace(comment, r"[^\n]+", "")))
    return F.array_join(kept, "")


def source_line_counts(
    files: DataFrame, lexers: Mapping[str, Lexer] = LEXERS, comment_marks: Mapping[str, str] = LINE_COMMENTS,
    language: str = "language", text: str = "text",
) -> DataFrame:
    """Files, blank, comment and code lines per language, and a ``TOTAL`` row.

    A line is blank if it holds white space only, inside comments too; code if something but comments
    is on it; else comment. Languages with a lexer are cut into comments, strings and the rest over the
    whole text, so a mark in a string opens nothing and an open comment goes on over lines, at
    the end of the text at the latest. Other languages have comment lines that begin with
    their mark. Literals for patterns (between slashes) and nested documents count as code.
    A null text has no lines; a null language is a group of its own.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    of = F.col(language)
    code = None
    for lexer in dict.fromkeys(lexers.values()):
        names = [name for name, own in lexers.items() if own == lexer]
        # Without a first mark there is no comment, and the text stays as it is.
        shown = F.when(F.regexp_like(whole, F.lit(f"[{lexer.begins}]")), without_comments(whole, lexer)).otherwise(whole)
        code = (F if code is None else code).when(of.isin(names), shown)
    mark = F.lit(None).cast("string")
    for name, value in comment_marks.items():
        if name not in lexers:
            mark = F.when(of == name, F.lit(value)).otherwise(mark)
    bare = whole if code is None else code.otherwise(whole)
    blank = lambda line: F.trim(line, F.lit(BLANKS)) == ""
    marked = lambda line: F.coalesce(F.startswith(F.trim(line, F.lit(BLANKS)), F.col("_mark")), F.lit(False))
    rows = files.select(of.alias("language"), mark.alias("_mark"), lines_of(whole).alias("_lines"), lines_of(bare).alias("_bare"))
    size = lambda lines: F.size(lines).cast("bigint")
    per_file = rows.select(
        "language", size(F.col("_lines")).alias("lines"), size(F.filter("_lines", blank)).alias("blank"),
        size(F.filter("_bare", lambda line: ~blank(line) & ~marked(line))).alias("_code"))
    return rollup_languages(per_file.select("language", "lines", "blank", (F.col("lines") - F.col("blank") - F.col("_code")).alias("comment")))
