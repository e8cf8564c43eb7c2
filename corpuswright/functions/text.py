"""Splitting text into segments, sentences and pieces."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import BOS, PAD, SEP, SPECIAL_TOKENS
from .arrays import col

SPECIAL = "<(?:" + "|".join(t.strip("<>") for t in SPECIAL_TOKENS) + ")>"

# A sentence ends after a run of closing punctuation and the blanks behind it;
# punctuation with nothing before it is a sentence of its own, so no text is lost.
SENTENCE = r"[^.!?]+[.!?]*[ \t\n\r\f]*|[.!?]+[ \t\n\r\f]*"

WORD = r"\p{L}+|\p{N}+"
MARKED_WORD = SPECIAL + "|" + WORD

# Fixed value: the published GPT-2 split pattern.
PRETOKEN = r"(?U)'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

# The same split around special tokens, which are pieces of their own: blanks in
# front of one are one piece, and other signs stop before it.
MARKED_PRETOKEN = (
    rf"(?U){SPECIAL}|'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+"
    rf"| ?(?:(?!{SPECIAL})[^\s\p{{L}}\p{{N}}])+|\s+(?={SPECIAL})|\s+(?!\S)|\s+"
)

LINE = "[^\n]*\n|[^\n]+"

# Signs that end a sentence before white space, in several scripts; signs that
# end one by themselves; quotes and brackets that close behind them.
ENDS = ".!?\u2026\u203c\u2047\u2048\u2049\u0589\u061f\u06d4\u0700\u0964\u0965\u104b\u1362\u1367\u166e\u1803\u1809"
WIDE_ENDS = "\u3002\uff01\uff0e\uff1f\uff61"
CLOSERS = "\"')]}\u2019\u201d\u00bb\u203a\u300d\u300f\u3011\uff09"

# Common abbreviations of English, German, French and Spanish; a parameter.
ABBREVIATIONS = (
    "Mr", "Mrs", "Ms", "Dr", "Prof", "St", "Jr", "Sr", "vs", "etc", "approx", "e.g", "i.e", "No", "Vol", "Fig",
    "z.B", "d.h", "bzw", "usw", "ca", "Nr", "Abb", "M", "Mme", "Mlle", "p.ex", "Sra", "Srta", "Ud", "p.ej",
)


def pieces(text, pattern: str) -> Column:
    return F.regexp_extract_all(col(text), F.lit(pattern), F.lit(0))


def sentences(text) -> Column:
    return pieces(text, SENTENCE)


def _class(signs: str) -> str:
    """Inside of a character class, in this engine and in others."""
    return "".join("\\" + c if c in "\\]^-[" else c for c in signs)


def ruled_pattern(abbreviations: tuple[str, ...] = ABBREVIATIONS) -> str:
    """Matches one sentence after another; see :func:`ruled_sentences`."""
    apart = r"(?:^|[^\p{L}\p{N}])"
    known = "|".join([a.replace(".", r"\.") for a in abbreviations] + [r"\p{Lu}"])
    blank, both = r"[ \t\n\r\f]", _class(ENDS + WIDE_ENDS)
    number = rf"(?!(?<=\p{{N}})\.{blank}+[\p{{Ll}}\p{{N}}])"
    stop = rf"(?<!{apart}(?:{known})){number}\.(?![{both}])"
    run = rf"[{_class(ENDS.replace('.', ''))}][{_class(ENDS)}]*|\.[{_class(ENDS)}]+"
    closing = f"[{_class(CLOSERS)}]*"
    wide = rf"[{_class(WIDE_ENDS)}][{both}]*{closing}{blank}*"
    # Only an ending sign is worth a look behind: all else is passed by one test.
    return rf"(?s).*?(?=[{both}])(?:(?:{stop}|{run}){closing}(?={blank}|\z){blank}*|{wide})|.+\z"


def ruled_sentences(text, abbreviations: tuple[str, ...] = ABBREVIATIONS) -> Column:
    """Sentences by rules, each with the white space behind it; no character is lost.

    A sentence ends after a run of ending signs and the quotes and brackets that close behind
    it, if white space or the end of the text follows; wide signs need no white space. A single
    full stop does not end it after one of the ``abbreviations``, after a single capital
    letter, or after a digit if a small letter or a digit comes next. Null stays null.
    """
    return pieces(text, ruled_pattern(abbreviations))


def segments(text_columns: list[str], segmentation: bool) -> Column:
    """One segment per text column, or the sentences of the only text column."""
    if not text_columns:
        raise ValueError("at least one text column is needed")
    if segmentation:
        if len(text_columns) != 1:
            raise ValueError("segmentation needs exactly one text column")
        return sentences(text_columns[0])
    return F.array(*[F.col(c) for c in text_columns])


def add_markers(segs) -> Column:
    """Put SEP behind every segment and BOS before the first one."""
    bos, sep = F.lit(SPECIAL_TOKENS[BOS]), F.lit(SPECIAL_TOKENS[SEP])
    return F.transform(
        col(segs), lambda s, i: F.concat(F.when(i == 0, bos).otherwise(F.lit("")), s, sep)
    )


def cut_at_padding(text) -> Column:
    return F.substring_index(col(text), SPECIAL_TOKENS[PAD], 1)


def with_prefix(key, prefix: str = "eval_") -> Column:
    key = col(key)
    return F.when(F.startswith(key, F.lit(prefix)), key).otherwise(F.concat(F.lit(prefix), key))


def parse_spec(spec) -> Column:
    """``name-subset`` to struct(name, subset); later parts are dropped."""
    parts = F.split(col(spec), "-", -1)
    return F.struct(
        F.element_at(parts, 1).alias("name"), F.try_element_at(parts, F.lit(2)).alias("subset")
    )
