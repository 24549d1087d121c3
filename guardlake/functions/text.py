"""Column functions on text: invisible characters, escapes, keys, paths, HTML styles."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The classes of invisible characters, by category, as the bodies of regex classes.
INVISIBLE = {
    "zero-width": "​‌‍﻿",
    "tag-character": "\U000e0001-\U000e007f",
    "directional-override": "‪-‮⁦-⁩",
    "variation-selector": "︀-️",
    "control-character": "\\x00-\\x08\\x0b-\\x1f\\x7f-\\x9f",
}
LATIN = "A-Za-zÀ-ɏ"
CYRILLIC = "Ѐ-ӿ"
# Terminal escape sequences: CSI, OSC, character set, two bytes.
ANSI = r"\x1b\[[\x30-\x3f]*[\x20-\x2f]*[\x40-\x7e]|\x1b\][^\n]*?(?:\x1b\\|\x07)|\x1b[()][A-Z0-9]|\x1b[\x40-\x5f]"
# Hidden CSS declarations.
HIDDEN_KEYWORD = r"(?i)(?:^|[^A-Za-z0-9\-_])(?:display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse))(?:[^A-Za-z0-9\-_]|$)"
OPACITY = r"(?i)(?:^|[^A-Za-z0-9\-_])opacity\s*:\s*([+\-]?(?:\d+\.?\d*|\.\d+))%?"
CSS_COMMENT = r"(?s)/\*.*?(?:\*/|$)"


def strip_ansi(text: Column) -> Column:
    return F.when(text.contains("\x1b"), F.regexp_replace(text, ANSI, "")).otherwise(text)


def ansi_count(text: Column) -> Column:
    """Escape bytes that strip_ansi removes."""
    found = (F.regexp_count(text, F.lit(r"\x1b")) - F.regexp_count(strip_ansi(text), F.lit(r"\x1b"))).cast("int")
    return F.when(text.contains("\x1b"), found).when(text.isNotNull(), 0)


_ALL_INVISIBLE = "[" + "".join(INVISIBLE.values()) + "]"


def has_invisible(text: Column) -> Column:
    return text.rlike(_ALL_INVISIBLE)


def strip_invisible(text: Column) -> Column:
    """The text without invisible characters; texts that have none, as most, are only looked through once."""
    return F.when(has_invisible(text), F.regexp_replace(text, _ALL_INVISIBLE, "")).otherwise(text)


def strip_counts(text: Column) -> Column:
    """struct of a count for each category, and total."""
    count = lambda pattern: F.when(has_invisible(text), F.regexp_count(text, F.lit(pattern))).when(text.isNotNull(), 0)
    return F.struct(*[count(f"[{body}]").alias(name.replace("-", "_")) for name, body in INVISIBLE.items()], count(_ALL_INVISIBLE).alias("total"))


def has_mixed_script(text: Column) -> Column:
    """A word has Latin and Cyrillic letters. Lookaheads keep long words linear; texts without Cyrillic are only looked through."""
    return F.coalesce(text.rlike(f"[{CYRILLIC}]") & text.rlike(rf"(?U)\b(?=\w*[{LATIN}])(?=\w*[{CYRILLIC}])\w"), F.lit(False))


def strip_categories(text: Column) -> Column:
    """Categories met, by their first place; mixed-script, judged on what is left, comes last."""
    at = F.array(*[F.struct(F.regexp_instr(text, F.lit(f"[{body}]")).alias("at"), F.lit(name).alias("name")) for name, body in INVISIBLE.items()])
    met = F.when(has_invisible(text), F.transform(F.array_sort(F.filter(at, lambda x: x["at"] > 0)), lambda x: x["name"])).when(text.isNotNull(), F.array().cast("array<string>"))
    return F.when(has_mixed_script(strip_invisible(text)), F.concat(met, F.array(F.lit("mixed-script")))).otherwise(met)


def norm_key(text: Column) -> Column:
    """Lower case, letters, digits and single spaces only."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), r"(?U)[^\p{L}\p{N}\s]", ""), r"(?U)\s+", " "))


def path_check(path: Column) -> Column:
    """Null for a clean path, else why it is refused."""
    return F.when(path.contains("\x00"), "nul").when(path.rlike(r"[\x01-\x08\x0b-\x1f\x7f-\x9f]"), "control")


def lexical_path(path: Column) -> Column:
    """The path with '.' and '..' resolved by name alone."""
    parts = F.filter(F.split(path, "/"), lambda p: (p != "") & (p != "."))
    done = F.aggregate(
        parts,
        F.expr("cast(array() as array<string>)"),
        lambda acc, p: F.when(p == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(p))),
    )
    return F.concat(F.lit("/"), F.array_join(done, "/"))


def path_within(path: Column, roots: Column) -> Column:
    """The resolved path is one of the roots or below one, by whole components."""
    clean = lexical_path(path)
    return F.exists(roots, lambda r: (clean == r) | clean.startswith(F.concat(F.rtrim(r, F.lit("/")), F.lit("/"))))


def is_hidden_style(style: Column) -> Column:
    """An inline style hides its element."""
    plain = F.regexp_replace(style, CSS_COMMENT, "")
    opacity = F.exists(F.regexp_extract_all(plain, F.lit(OPACITY), F.lit(1)), lambda x: F.coalesce(x.try_cast("double") == 0, F.lit(False)))
    return F.coalesce(plain.rlike(HIDDEN_KEYWORD) | opacity, F.lit(False))


@F.arrow_udf(T.FloatType())
def _repetition_ratio(texts: pa.Array) -> pa.Array:
    data = texts.cast(pa.large_binary())
    at = np.frombuffer(data.buffers()[1], np.int64, len(data) + 1, 8 * data.offset)
    raw = np.frombuffer(data.buffers()[2] or b"", np.uint8)[at[0] : at[-1]]
    at = at - at[0]
    same = np.flatnonzero(raw[1:] == raw[:-1]) + 1  # bytes that equal the one before
    starts, n = at[:-1], np.diff(at)
    found = np.searchsorted(same, at[1:]) - np.searchsorted(same, np.minimum(starts + 1, at[1:]))
    ratio = (found / np.maximum(n, 1)).astype(np.float32)
    return pa.array(ratio, pa.float32(), mask=np.asarray(texts.is_null()))


def repetition_ratio(text: Column) -> Column:
    """Adjacent equal bytes over bytes, as float; 0 for fewer than two bytes, as for null."""
    return F.coalesce(_repetition_ratio(text), F.lit(0.0).cast("float"))


def tail_lines(text: Column, n: int = 20) -> Column:
    """The last n lines, as an array; a final newline ends the last line."""
    lines = F.split(text, "\n", -1)
    lines = F.when(text.endswith("\n"), F.slice(lines, 1, F.size(lines) - 1)).otherwise(lines)
    return F.slice(lines, F.greatest(F.size(lines) - n + 1, F.lit(1)), F.lit(n))


def clip_reply(text: Column, most: int = 4096) -> Column:
    """The visible text, cut so that with a note of its length it has `most` characters."""
    clean = strip_invisible(text)
    note = F.concat(F.lit(" … [truncated, "), F.length(clean).cast("string"), F.lit(" chars]"))
    return F.when(F.length(clean) <= most, clean).otherwise(F.concat(F.left(clean, F.lit(most) - F.length(note)), note))
