"""Text columns: bounded output, doc comments, chunk documents, names and search."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
MORE = " […]"


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, UPPER.lower())


def bounded(text: Column, n: int) -> Column:
    """At most n characters and a mark that there was more; null gives an empty text."""
    text = F.coalesce(text, F.lit(""))
    return F.when(F.length(text) > n, F.concat(F.left(text, F.lit(n)), F.lit(MORE))).otherwise(text)


def like_search(columns: list[Column], wanted: str) -> Column:
    """True where any column holds the text, without regard to the case of A-Z. `%` and `_` are wildcards, unescaped."""
    pattern = f"%{wanted.translate(str.maketrans(UPPER, UPPER.lower()))}%"
    out = F.lit(False)
    for column in columns:
        out = out | F.coalesce(ascii_lower(column).like(pattern), F.lit(False))
    return out


def plain_doc(comment: Column) -> Column:
    """A doc comment without its marks: one trimmed line for each that holds something."""
    bare = F.regexp_replace(F.regexp_replace(comment, r"/\*\*|\*/", ""), r"(?m)^\s*\*\s?", "")
    lines = F.transform(F.split(bare, "\n"), lambda line: F.regexp_replace(line, r"^\s+|\s+$", ""))
    return F.array_join(F.filter(lines, lambda line: line != ""), "\n")


def doc_summary(comment: Column) -> Column:
    """The first line of a doc comment, or N/A."""
    return F.when(F.coalesce(comment, F.lit("")) == "", "N/A").otherwise(F.element_at(F.split(comment, r"\r\n|\r|\n"), 1))


def parent_name(name: Column) -> Column:
    """A hierarchical name without its last part."""
    parts = F.split(name, r"\.")
    return F.array_join(F.slice(parts, F.lit(1), F.size(parts) - 1), ".")


def root_name(file_name: Column) -> Column:
    """What stands before the first dot."""
    return F.element_at(F.split(file_name, r"\."), 1)


def chunk_document(path: Column, name: Column, source: Column, comment: Column) -> Column:
    """The text of a code chunk to be embedded: documentation, where it stands, source."""
    doc = plain_doc(comment)
    documentation = F.when(F.coalesce(doc, F.lit("")) != "", F.concat(F.lit("// Documentation:\n"), doc))
    context = F.concat(F.lit("// Context: File: "), path, F.lit(" | Chunk: "), F.replace(name, F.lit("."), F.lit(" > ")))
    return F.concat_ws("\n\n", documentation, context, F.concat(F.lit("\n"), source))


def text_document(path: Column, number: Column, text: Column) -> Column:
    return F.concat(F.lit("// Context: File: "), path, F.lit(" | Chunk: "), number.cast("string"), F.lit("\n\n"), text)


def first_lines(code: Column, n: int = 400) -> Column:
    """The first n lines, whose ends become line feeds. What is behind the n-th line feed isn't looked at."""
    part = F.substring_index(code, "\n", n)
    return F.substring_index(F.replace(F.replace(part, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n")), "\n", n)


def summary_prompt(path: Column, code: Column, n: int = 400) -> Column:
    return F.concat(
        F.lit("Describe what this file does and how it is built, for a reader who has not seen it.\nFile: "), path,
        F.lit("\n\n```\n"), first_lines(code, n), F.lit("\n```\n\nSummary:"),
    )


def kib(size: Column) -> Column:
    return size / F.lit(1024.0)


def prefixed_query(question: str, prefix: str) -> str:
    """Embedding models that want it get an instruction before queries, never before documents."""
    return prefix + question
