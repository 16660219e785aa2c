"""Text and digests: fingerprints, task keys, lines, messages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .paths import SPACE_CLASS, stripped

#: Line models: what ends a line when a file is read, searched, or taken as context.
READ_LINES, SEARCH_LINES, CONTEXT_LINES = r"\r\n|\n|\r", r"\n", r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"


def lines(c: Column, model: str = READ_LINES) -> Column:
    """The lines of a text; an ending line break adds none."""
    return F.when(c == "", F.array().cast("array<string>")).otherwise(F.split(F.regexp_replace(c, rf"(?:{model})\z", ""), model, -1))


def fingerprint(*parts: Column) -> Column:
    """A digest of some values in order; null differs from every text."""
    coded = [F.coalesce(F.concat(F.length(p.cast("string")).cast("string"), F.lit(":"), p.cast("string")), F.lit("-")) for p in parts]
    return F.sha2(F.concat_ws("|", *coded), 256)


def task_key(repo: Column, base_commit: Column, statement: Column, patch: Column, use_patch: Column) -> Column:
    """What makes two tasks the same: white space in the statement and line ends in the patch don't."""
    words = stripped(F.regexp_replace(statement, f"{SPACE_CLASS}+", " "))
    change = stripped(F.replace(F.coalesce(patch, F.lit("")), F.lit("\r\n"), F.lit("\n")))
    return fingerprint(repo, base_commit, words, change, F.coalesce(use_patch, F.lit(False)))


def trace_id(c: Column) -> Column:
    return F.substring(F.sha2(c, 256), 1, 12)


def observation_text(observation: Column) -> Column:
    """The text of an observation struct (text, content: array of struct(text)): its own, else its blocks by line."""
    blocks = F.transform(F.filter(observation["content"], lambda b: b["text"].isNotNull()), lambda b: b["text"])
    return F.coalesce(observation["text"], F.array_join(blocks, "\n"), F.lit(""))


def message_text(content: Column) -> Column:
    """Blocks (type, text) as one text; a block of another type is an error."""
    odd = F.exists(content, lambda b: F.coalesce(b["type"], F.lit("")) != "text")
    return F.when(odd, F.raise_error(F.lit("message content must be text"))).otherwise(F.array_join(F.transform(content, lambda b: b["text"]), "\n"))


def instruction(statement: Column, directory: Column) -> Column:
    return F.format_string("Repository: %s\n\nIssue:\n%s\n\nFind the code that must change and report its locations.", directory, statement)


def final_turn_ok(c: Column) -> Column:
    """Exactly one call, closed, one end mark after it, and only white space between."""
    ones = [F.regexp_count(c, F.lit(p)) == 1 for p in ("<tool_call>", "</tool_call>", r"<\|im_end\|>")]
    return ones[0] & ones[1] & ones[2] & c.rlike(rf"(?s)<tool_call>.*</tool_call>{SPACE_CLASS}*<\|im_end\|>")
