"""Spelling variants: words that differ by one edit, each led to its commonest spelling.

Every word's bigrams are ordered by how many words of the vocabulary hold them, rarest
first. One edit destroys at most two adjoining bigrams, so of any two disjoint bigrams of a
word one survives in each of its near words, at the same place counted from the front
(with all before it, if the edit comes later) or from the back (with all behind it). The
first three bigrams in the order always hold two disjoint ones; dynamic programming picks
the disjoint pair with the fewest words in all, the pivots. Of two near words the one
whose prefix ends later in the order has, in that prefix, a surviving pivot of the other:
a common bigram no later than the other's last one. So pivots are joined with prefixes by
bigram and place, and the candidates are verified.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialized

LEAST_LENGTH = 6
LEAST_COUNT = 5
FACTOR = 5
EVERY = 199
_UPPER = "".join(chr(c) for c in range(65, 91))
_ROUNDS = 6  # counts grow by the factor at each step, so 28 steps reach any 64-bit count

PREFIX = 3


def runs(text: Column, least: int = LEAST_LENGTH) -> Column:
    """Maximal runs of letters of ``least`` code points or more, A-Z in lower case."""
    lowered = F.translate(text.cast("string"), _UPPER, _UPPER.lower())
    return F.regexp_extract_all(lowered, F.lit("[a-z\\u00C0-\\u00FF]{%d,}" % least), F.lit(0))


def misspelt(key: Column, run: Column, every: int = EVERY) -> Column:
    """The run without one of its code points, if ``every`` divides the hash of key and run."""
    h = F.crc32(F.concat(key.cast("string"), F.lit(":"), run).cast("binary"))
    at = F.pmod(h, F.length(run).cast("long")).cast("int")
    cut = F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))
    return F.when(F.pmod(h, F.lit(every)) == 0, cut).otherwise(run)


def vocabulary(docs: DataFrame, key: str = "doc_id", column: str = "text", every: int | None = EVERY) -> DataFrame:
    """``word, n``: words long and frequent enough, over all texts. Counted before the shuffle."""
    rows = docs.select(F.col(key).alias("key"), F.explode(runs(F.col(column))).alias("run"))
    word = F.col("run") if every is None else misspelt(F.col("key"), F.col("run"), every)
    words = rows.select(word.alias("word")).where(F.length("word") >= LEAST_LENGTH)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= LEAST_COUNT)


def prefix_of(word: str, order: dict[str, tuple[int, int]]) -> list[int]:
    """Places, from the left, of the word's three first bigrams in the order and of all others
    equal to the last of these. ``order`` has each bigram's rank and number of words."""
    ranks = [order[word[p : p + 2]][0] for p in range(len(word) - 1)]
    last = sorted(ranks)[PREFIX - 1]
    return [p for p, rank in enumerate(ranks) if rank <= last]


def pivots_of(word: str, prefix: list[int], order: dict[str, tuple[int, int]]) -> tuple[int, int]:
    """The two disjoint bigrams of the prefix that the fewest words hold in all: from left to
    right, the best bigram that ends before each place, and the best pair so far."""
    best: tuple[int, int, int] | None = None
    waiting: list[tuple[int, int]] = []
    left: tuple[int, int] | None = None
    for p in prefix:
        while waiting and waiting[0][1] <= p - 2:
            cost, place = waiting.pop(0)
            if left is None or cost < left[0]:
                left = (cost, place)
        cost = order[word[p : p + 2]][1]
        if left is not None and (best is None or left[0] + cost < best[0]):
            best = (left[0] + cost, left[1], p)
        waiting.append((cost, p))
    return best[1], best[2]


def gram_counts(words: DataFrame) -> DataFrame:
    """``gram, c``: the number of words with each bigram. At most 8,100 rows, as the letters
    are 26 and the 64 from U+00C0 to U+00FF."""
    grams = F.transform(F.sequence(F.lit(1), F.length("word") - 1), lambda i: F.substring(F.col("word"), i, F.lit(2)))
    return words.select(F.explode(F.array_distinct(grams)).alias("gram")).groupBy("gram").agg(F.count(F.lit(1)).alias("c"))


class Parts:
    """Hashes of a word's beginnings and endings, each in one step. Equal hashes of unequal
    parts only make a candidate that is found out."""

    BASE, MODULUS = 0x1F3D5B79A2C4E687, (1 << 61) - 1

    def __init__(self, word: str):
        self.run, self.power = [0], [1]
        for c in word:
            self.run.append((self.run[-1] * self.BASE + ord(c)) % self.MODULUS)
            self.power.append(self.power[-1] * self.BASE % self.MODULUS)

    def up_to(self, end: int) -> int:
        return self.run[end] << 1

    def from_on(self, start: int) -> int:
        return (self.run[-1] - self.run[start] * self.power[len(self.run) - 1 - start]) % self.MODULUS << 1 | 1


def marks(word: str) -> tuple[int, int]:
    """Two bags of 64 bits, of letters and of bigrams, in which a bit tells whether an even or
    odd number fell on it. One edit flips at most two bits of the first and four of the second."""
    letters = grams = 0
    for c in word:
        letters ^= 1 << (ord(c) & 63)
    for a, b in zip(word, word[1:]):
        grams ^= 1 << ((ord(a) * 131 + ord(b)) * 0x9E3779B1 >> 13 & 63)
    return tuple(x - (1 << 64) if x >> 63 else x for x in (letters, grams))


def _grams(words: DataFrame, order: dict[str, tuple[int, int]]) -> DataFrame:
    """``id, length, last, letters, grams, pivot, shared``: pivots and prefix bigrams of words
    ``id, word``, each with what the word has up to it and with what it has from it on, as
    hashes."""
    shipped = words.sparkSession.sparkContext.broadcast(order)

    def run(batches):
        order = shipped.value
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [], [], [], [])
            for key, word in zip(batch.column("id").to_pylist(), batch.column("word").to_pylist()):
                prefix, parts = prefix_of(word, order), Parts(word)
                last = max(order[word[p : p + 2]][0] for p in prefix)
                pivots = pivots_of(word, prefix, order)
                own = (key, len(word), last, *marks(word))
                for is_pivot, places in ((True, pivots), (False, prefix)):
                    for p in places:
                        for shared in (parts.up_to(p + 2), parts.from_on(p)):
                            for values, value in zip(out, (*own, is_pivot, shared)):
                                values.append(value)
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.bool_(), pa.int64())
            names = ["id", "length", "last", "letters", "grams", "pivot", "shared"]
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out, kinds)], names)

    schema = "id long, length int, last int, letters long, grams long, pivot boolean, shared long"
    return words.select("id", "word").mapInArrow(run, schema)


def near_words(words: DataFrame) -> DataFrame:
    """``word, other, n_other`` for all different words of a stored table ``id, word, n`` that one
    inserted, deleted or replaced code point parts, both ways. Words of at least four letters.

    Only numbers meet in the join, so a long word is sent once for each candidate, not once for
    each of its bigrams.
    """
    counts = sorted((r["c"], r["gram"]) for r in gram_counts(words).collect())
    grams = materialized(_grams(words, {gram: (rank, c) for rank, (c, gram) in enumerate(counts)}))
    of = lambda name, pivot: grams.where(F.col("pivot") == pivot).select(
        "shared", *[F.col(c).alias(f"{c}_{name}") for c in ("id", "length", "last", "letters", "grams")]
    )
    # The word whose prefix ends later has the other's pivot in it.
    met = of("a", True).join(of("b", False), "shared")
    near = met.where("id_a <> id_b and last_a <= last_b and abs(length_a - length_b) <= 1")
    # Most candidates are ruled out here, so that few are sent on to be verified.
    near = near.where("bit_count(letters_a ^ letters_b) <= 2 and bit_count(grams_a ^ grams_b) <= 4")
    pairs = near.select(F.least("id_a", "id_b").alias("id_a"), F.greatest("id_a", "id_b").alias("id_b")).distinct()
    named = lambda name: words.select(*[F.col(c).alias(f"{c}_{name}") for c in ("id", "word", "n")])
    candidates = pairs.join(named("a"), "id_a").join(named("b"), "id_b")
    found = materialized(candidates.where(F.levenshtein("word_a", "word_b", 1) == 1))
    both = lambda a, b: found.select(F.col(f"word_{a}").alias("word"), F.col(f"word_{b}").alias("other"), F.col(f"n_{b}").alias("n_other"))
    return both("a", "b").union(both("b", "a"))


def roots(forms: DataFrame) -> DataFrame:
    """``word, root`` for links ``word, form`` to a more frequent word: each round doubles the
    steps that a word looks ahead."""
    ahead = materialized(forms.select("word", F.col("form").alias("root")))
    for _ in range(_ROUNDS):
        on = ahead.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = materialized(ahead.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        ahead = moved.select("word", "root")
        if not moved.where("moved").limit(1).count():
            break
    return ahead


def variants(docs: DataFrame, key: str = "doc_id", column: str = "text", every: int | None = EVERY) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` for every word of the texts.

    Words are maximal runs of A-Z, a-z and U+00C0 to U+00FF, A-Z in lower case, after the
    deletion that :func:`misspelt` makes (none with ``every=None``), of at least 6 code points
    and 5 occurrences. ``form`` is the near word of largest ``n`` (ties: the first in code-point
    order) if that is at least 5 times the word's; ``root`` is where forms lead, the word
    itself without any. Null and empty texts have no words; a null key deletes nothing; repeated
    rows count each. Other columns are not read. An empty table gives no rows.
    """
    words = materialized(vocabulary(docs, key, column, every).withColumn("id", F.monotonically_increasing_id()))
    near = near_words(words)
    first = F.min(F.struct((-F.col("n_other")).alias("n"), F.col("other").alias("word")))
    best = near.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), first.alias("best"))
    follows = -F.col("best")["n"] >= FACTOR * F.col("n")
    table = materialized(
        words.join(best, "word", "left").select(
            "word", F.when(follows, F.col("best")["word"]).alias("form"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
            F.when(follows, -F.col("best")["n"]).alias("form_n"),
        )
    )
    led = roots(table.where("form is not null"))
    return table.join(led, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
