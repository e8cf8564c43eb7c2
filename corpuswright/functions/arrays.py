"""Per-row array expressions over token ids and vectors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..constants import PAD, SEP


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def cap_sentences(sentences, max_sentences: int | None) -> Column:
    """Keep the first ``max_sentences`` sentences (all of them when None)."""
    return F.slice(col(sentences), 1, max_sentences) if max_sentences else col(sentences)


def close_sentence(ids, max_length: int | None) -> Column:
    """Cut a sentence to ``max_length`` ids and make SEP its last id.

    The last id is replaced even in a short sentence (it is SEP already), and an
    empty sentence becomes ``[SEP]``.
    """
    ids = col(ids)
    size = F.size(ids) if max_length is None else F.least(F.size(ids), F.lit(max_length))
    return F.concat(F.slice(ids, F.lit(1), F.greatest(size - 1, F.lit(0))), F.array(F.lit(SEP)))


def close_sentences(sentences, max_length: int | None) -> Column:
    return F.transform(col(sentences), lambda s: close_sentence(s, max_length))


def sequence_numbers(sentences) -> Column:
    """1-based sentence number of every token, flattened."""
    return F.flatten(F.transform(col(sentences), lambda s, i: F.array_repeat(i + 1, F.size(s))))


def position_numbers(sentences) -> Column:
    """1-based position of every token within its sentence, flattened."""
    return F.flatten(
        F.transform(
            col(sentences),
            lambda s: F.when(F.size(s) > 0, F.sequence(F.lit(1), F.size(s))).otherwise(
                F.array().cast("array<int>")
            ),
        )
    )


def pad_right(values, width, fill=PAD) -> Column:
    """Append ``fill`` until the array is ``width`` long; longer arrays stay."""
    values = col(values)
    missing = F.greatest((col(width) if not isinstance(width, int) else F.lit(width)) - F.size(values), F.lit(0))
    fill = fill if isinstance(fill, Column) else F.lit(fill)
    return F.concat(values, F.array_repeat(fill, missing.cast("int")))


def chunk_width(size, chunk: int) -> Column:
    """Smallest multiple of ``chunk`` that holds ``size`` entries."""
    return (F.ceil(col(size) / F.lit(float(chunk))) * chunk).cast("int")


def pad_to_chunk(values, chunk: int, fill=PAD) -> Column:
    return pad_right(values, chunk_width(F.size(col(values)), chunk), fill)


def not_padding(ids) -> Column:
    """Attention mask: True where the id is not padding."""
    return F.transform(col(ids), lambda x: x != PAD)


def argmax(values) -> Column:
    """0-based index of the first largest entry."""
    values = col(values)
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def where(flags, if_true, if_false) -> Column:
    """Entry-wise choice between two arrays; ``if_true`` may be a scalar."""
    if isinstance(if_true, (int, float)):
        return F.zip_with(col(flags), col(if_false), lambda f, b: F.when(f, F.lit(if_true)).otherwise(b))
    pairs = F.zip_with(col(if_true), col(if_false), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    return F.zip_with(col(flags), pairs, lambda f, p: F.when(f, p["a"]).otherwise(p["b"]))


def array_sum(values, zero=0.0) -> Column:
    """Sum of an array; ``zero`` fixes the result type."""
    zero = F.lit(zero)
    return F.aggregate(col(values), zero, lambda acc, x: acc + x)


def weighted_checksum(values) -> Column:
    """Sum of entry times 1-based position: equal arrays give equal sums."""
    return F.aggregate(
        F.transform(col(values), lambda x, i: x.cast("bigint") * (i + 1)),
        F.lit(0).cast("bigint"),
        lambda acc, x: acc + x,
    )


def add_vectors(*vectors) -> Column:
    total = col(vectors[0])
    for other in vectors[1:]:
        total = F.zip_with(total, col(other), lambda a, b: a + b)
    return total
