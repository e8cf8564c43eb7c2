"""Masking, replacing and labelling tokens: maps over id arrays, no shuffle."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import IGNORE, MASK, MASK_PROBABILITY, PROTECTED_IDS, REPLACE_PROBABILITY, VOCAB_SIZE
from ..functions import digests
from ..functions.arrays import col, where
from ..functions.hashing import happens, uniform, uniform_index
from ..functions.scores import gumbel


@dataclass(frozen=True)
class CorruptionConfig:
    mask_probability: float = MASK_PROBABILITY
    replace_probability: float = REPLACE_PROBABILITY
    sentence_probability: float = 0.0
    protected: tuple[int, ...] = PROTECTED_IDS
    seed: int = 42
    epoch: int = 0
    algorithm: str = "md5"


def is_special(x: Column, protected=PROTECTED_IDS) -> Column:
    return x.isin(*protected)


def corrupted_sentences(sequence_ids, key: str, cfg: CorruptionConfig) -> Column:
    """True at the tokens of sentences drawn to be left unmasked: one draw for a sentence,
    however long it is. Sentence numbers are 0 or more."""
    ids = col(sequence_ids)
    numbers = F.sequence(F.lit(0), F.coalesce(F.array_max(ids), F.lit(0)).cast("int"))
    draws = F.transform(
        numbers,
        lambda s: happens(cfg.sentence_probability, cfg.seed, f"sentence:{cfg.epoch}", key, s, algorithm=cfg.algorithm),
    )
    # As an argument the draws are made once; inside the lambda they would be made for each token.
    return F.zip_with(ids, F.array_repeat(draws, F.size(ids)), lambda s, drawn: F.element_at(drawn, s + 1))


def mask_tokens(df: DataFrame, key: str, cfg: CorruptionConfig = CorruptionConfig()) -> DataFrame:
    """Add ``masked``, ``replaced``, ``generator_input_ids``, ``labels_generator``.

    Every position is selected with the mask probability, protected ids never.
    A selected position becomes MASK with the replace probability and otherwise
    keeps its id. The label is the id where selected, else the ignore value.
    """
    if cfg.algorithm == "md5" and cfg.sentence_probability <= 0:
        return _with_drawn(df, key, cfg)

    def draw(p, purpose, i):
        return happens(p, cfg.seed, f"{purpose}:{cfg.epoch}", key, i, algorithm=cfg.algorithm)

    if cfg.sentence_probability > 0:
        spared = corrupted_sentences("sequence_ids", key, cfg)
        tokens = F.arrays_zip(F.col("input_ids").alias("x"), spared.alias("spared"))
        free = lambda t: ~is_special(t["x"], cfg.protected) & ~t["spared"]
    else:
        tokens, free = "input_ids", lambda x: ~is_special(x, cfg.protected)
    selected = F.transform(tokens, lambda t, i: free(t) & draw(cfg.mask_probability, "mask", i))
    out = df.withColumn("masked", selected)
    out = out.withColumn(
        "replaced", F.transform("masked", lambda m, i: m & draw(cfg.replace_probability, "replace", i))
    )
    return out.withColumns({
        "generator_input_ids": where("replaced", MASK, "input_ids"),
        "labels_generator": F.zip_with(
            "masked", "input_ids", lambda m, x: F.when(m, x).otherwise(F.lit(IGNORE))
        ),
    })


_MASKED = ("masked", "replaced", "generator_input_ids", "labels_generator")


def _with_drawn(df: DataFrame, key: str, cfg: CorruptionConfig, table: tuple[np.ndarray, np.ndarray] | None = None) -> DataFrame:
    """The columns of :func:`mask_tokens` and, with a table, of :func:`replace_tokens` and
    :func:`replacement_labels`, for whole Arrow batches: the same draws, many at once."""
    kind = df.schema["input_ids"].dataType.elementType.simpleString()
    types = dict.fromkeys(_MASKED, f"array<{kind}>") | {"masked": "array<boolean>", "replaced": "array<boolean>"}
    if table is not None:
        ids, running = table
        total = int(running[-1])
        types |= {"sampled_input_ids": f"array<{kind}>", "labels_at_token_level": "array<int>"}

    @F.arrow_udf("struct<" + ", ".join(f"{n}: {t}" for n, t in types.items()) + ">")
    def drawn(lists: pa.Array, keys: pa.Array) -> pa.Array:
        sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        offsets = np.append(0, np.cumsum(sizes))
        values = lists.flatten()
        unknown = values.is_null().to_numpy(zero_copy_only=False)
        x = pc.fill_null(values, 0).to_numpy(zero_copy_only=False)
        open_ = unknown | ~np.isin(x, cfg.protected)

        def happening(p, purpose, among):
            at = np.flatnonzero(among)
            rows = np.searchsorted(offsets, at, "right") - 1
            hit = digests.happen(p, digests.prefixes(cfg.seed, f"{purpose}:{cfg.epoch}", keys), rows, at - offsets[rows])
            out = np.zeros(len(among), bool)
            out[at[hit]] = True
            return out

        masked = happening(cfg.mask_probability, "mask", open_)
        replaced = happening(cfg.replace_probability, "replace", masked)
        # What is not known is neither masked nor replaced for sure.
        sure, changed = masked & ~unknown, replaced & ~unknown
        made = {
            "masked": pa.array(masked, mask=masked & unknown),
            "replaced": pa.array(replaced, mask=replaced & unknown),
            "generator_input_ids": pa.array(np.where(changed, MASK, x), values.type, mask=unknown & ~changed),
            "labels_generator": pa.array(np.where(sure, x, IGNORE), values.type),
        }
        if table is not None:
            at = np.flatnonzero(changed)
            rows = np.searchsorted(offsets, at, "right") - 1
            ranks = digests.indices(total, digests.prefixes(cfg.seed, f"sample:{cfg.epoch}", keys), rows, at - offsets[rows])
            sampled = x.copy()
            sampled[at] = ids[np.searchsorted(running, ranks, side="right")]
            labels = np.where(open_, (changed & (sampled != x)).astype(np.int32), np.int32(IGNORE))
            made |= {"sampled_input_ids": pa.array(sampled, values.type, mask=unknown), "labels_at_token_level": pa.array(labels)}
        starts = pa.array(offsets.astype(np.int32), mask=np.append(lists.is_null().to_numpy(zero_copy_only=False), False))
        return pa.StructArray.from_arrays([pa.ListArray.from_arrays(starts, made[n]) for n in types], list(types))

    out = df.withColumn("_drawn", drawn("input_ids", F.col(key).cast("string")))
    return out.withColumns({n: F.col(f"_drawn.{n}") for n in types}).drop("_drawn")


def array_proposal(df: DataFrame, ids: str = "input_ids", protected=PROTECTED_IDS) -> DataFrame:
    """:func:`token_proposal` of lists of ids, counted before they become rows."""

    def run(batches):
        for batch in batches:
            counted = batch.column(0).flatten().value_counts()
            yield pa.RecordBatch.from_arrays([counted.field("values").cast(pa.int32()), counted.field("counts")], ["id", "n"])

    counted = df.select(ids).mapInArrow(run, "id int, n bigint").where(~F.col("id").isin(*protected))
    return counted.groupBy("id").agg(F.sum("n").alias("n"))


def token_proposal(tokens: DataFrame, protected=PROTECTED_IDS) -> DataFrame:
    """Corpus frequency ``n`` per token id, the distribution replacements come
    from. At most one row per vocabulary entry."""
    kept = tokens.where(~F.col("id").isin(*protected))
    return kept.groupBy("id").agg(F.count(F.lit(1)).alias("n"))


def proposal_table(proposal: DataFrame, temperature: float = 1.0, vocab_size: int = VOCAB_SIZE):
    """Ids and running weights, ordered by id, for :func:`replace_tokens`.

    The table has one row per vocabulary entry; more rows than ``vocab_size`` are
    refused.
    """
    rows = proposal.orderBy("id").limit(vocab_size + 1).collect()
    if len(rows) > vocab_size:
        raise ValueError(f"proposal has more than {vocab_size} tokens")
    ids = np.array([r["id"] for r in rows], dtype=np.int32)
    weights = np.array([r["n"] for r in rows])
    if temperature != 1.0:
        weights = np.maximum((weights / weights.max()) ** (1.0 / temperature) * 2**40, 1).astype(np.int64)
    return ids, np.cumsum(weights.astype(np.int64))


def _rank_lookup(ids: np.ndarray, running: np.ndarray):
    @F.arrow_udf("array<int>")
    def lookup(ranks: pa.Array) -> pa.Array:
        found = ids[np.searchsorted(running, ranks.flatten().to_numpy(zero_copy_only=False), side="right")]
        offsets = np.asarray(ranks.offsets)
        return pa.ListArray.from_arrays(pa.array(offsets - offsets[0]), pa.array(found))

    return lookup


def replace_tokens(
    masked: DataFrame, key: str, table: tuple[np.ndarray, np.ndarray], cfg: CorruptionConfig = CorruptionConfig()
) -> DataFrame:
    """Add ``sampled_input_ids``: replaced positions get a token drawn from the
    proposal, all others keep their id.

    The draw inverts the running weights, which picks from the same distribution
    as Gumbel noise on the log weights at a cost that does not grow with the
    vocabulary.
    """
    ids, running = table
    total = F.lit(int(running[-1]))
    rank = F.transform(
        "replaced",
        lambda r, i: F.when(
            r, uniform_index(uniform(cfg.seed, f"sample:{cfg.epoch}", key, i, algorithm=cfg.algorithm), total)
        ).otherwise(F.lit(0).cast("bigint")),
    )
    drawn = masked.withColumn("_drawn", _rank_lookup(ids, running)(rank))
    return drawn.withColumn("sampled_input_ids", where("replaced", "_drawn", "input_ids")).drop("_drawn")


def _scatter():
    """Values of a row with those at some of its places replaced, from a list of
    ``position, id``."""

    @F.arrow_udf("array<int>")
    def scatter(values: pa.Array, found: pa.Array) -> pa.Array:
        starts = np.asarray(values.offsets, np.int64)
        out = values.flatten().to_numpy(zero_copy_only=False).astype(np.int32)
        counts = np.diff(np.asarray(found.offsets))
        pairs = found.flatten()
        at = np.repeat(starts[:-1] - starts[0], counts) + pairs.field("position").to_numpy(zero_copy_only=False)
        out[at] = pairs.field("id").to_numpy(zero_copy_only=False)
        return pa.ListArray.from_arrays(pa.array((starts - starts[0]).astype(np.int32)), pa.array(out))

    return scatter


def sample_by_position(
    masked: DataFrame, key: str, logits: DataFrame, temperature: float = 1.0, cfg: CorruptionConfig = CorruptionConfig()
) -> DataFrame:
    """Add ``sampled_input_ids``: each replaced position gets one of the ids that ``logits``
    (``key, position, id, logit``; one row per candidate, positions from 0) offers there, drawn
    from the softmax of its logits / temperature. A position without candidates keeps its id.

    Noise is added to every candidate where its row is, and the largest of a position is a
    mergeable aggregate: candidates are combined before they are shuffled, and no row is as
    wide as the vocabulary. Equal sums go to the lower id. A candidate given twice counts once,
    with its larger logit; null and NaN logits are no candidates. Keys are unique in ``masked``.
    """
    if not temperature > 0:
        raise ValueError("temperature must be positive")
    wanted = masked.select(F.col(key).alias("_key"), F.posexplode("replaced").alias("position", "_replaced")).where("_replaced")
    given = logits.select(F.col(key).alias("_key"), "position", F.col("id").cast("int").alias("id"), F.col("logit").cast("double").alias("logit"))
    candidates = given.where("logit is not null and not isnan(logit)").join(wanted.drop("_replaced"), ["_key", "position"])
    draw = uniform(cfg.seed, f"sample:{cfg.epoch}", "_key", "position", "id", algorithm=cfg.algorithm)
    score = F.col("logit") / F.lit(float(temperature)) + gumbel(draw)
    best = candidates.groupBy("_key", "position").agg(F.max(F.struct(score.alias("score"), (-F.col("id")).alias("less"))).alias("best"))
    found = best.groupBy("_key").agg(F.collect_list(F.struct("position", (-F.col("best.less")).cast("int").alias("id"))).alias("_found"))
    joined = masked.join(found.withColumnRenamed("_key", key), key, "left")
    none = F.array().cast("array<struct<position: int, id: int>>")
    drawn = _scatter()(F.col("input_ids").cast("array<int>"), F.coalesce("_found", none))
    return joined.withColumn("sampled_input_ids", drawn).drop("_found")


def sample_by_token(
    masked: DataFrame, key: str, offers: DataFrame, temperature: float = 1.0, cfg: CorruptionConfig = CorruptionConfig(),
    max_offers: int = 16 * VOCAB_SIZE,
) -> DataFrame:
    """:func:`sample_by_position` where the logits of a position are those of the token before
    it: ``offers`` has ``before, id, logit``, some rows for each entry of the vocabulary. More
    than ``max_offers`` rows are refused, so they travel to the tasks and nothing is joined.
    The same draws, for whole Arrow batches. The first position has no token before it.
    """
    if not temperature > 0:
        raise ValueError("temperature must be positive")
    if cfg.algorithm != "md5":
        raise ValueError("only md5 is drawn for whole batches")
    given = offers.select(*[F.col(c).cast(t).alias(c) for c, t in (("before", "int"), ("id", "int"), ("logit", "double"))])
    given = given.where("before is not null and id is not null and logit is not null and not isnan(logit)")
    held = given.orderBy("before", "id").limit(max_offers + 1).toArrow()
    if held.num_rows > max_offers:
        raise ValueError(f"more than {max_offers} offers")
    ids, logits = held["id"].to_numpy(), held["logit"].to_numpy() / float(temperature)
    tokens, starts, counts = np.unique(held["before"].to_numpy(), return_index=True, return_counts=True)

    @F.arrow_udf("array<int>")
    def drawn(lists: pa.Array, replaced: pa.Array, keys: pa.Array) -> pa.Array:
        sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        offsets = np.append(0, np.cumsum(sizes))
        values = lists.flatten()
        x = pc.fill_null(values, -1).to_numpy(zero_copy_only=False).astype(np.int32)
        out = x.copy()
        at = np.flatnonzero(pc.fill_null(replaced.flatten(), False).to_numpy(zero_copy_only=False))
        rows = np.searchsorted(offsets, at, "right") - 1
        inner = at > offsets[rows]
        at, rows = at[inner], rows[inner]
        token = np.searchsorted(tokens, x[at - 1])
        offered = np.append(tokens, -1)[token] == x[at - 1]
        at, rows, token = at[offered], rows[offered], token[offered]
        if len(at):
            n = counts[token]
            first = np.cumsum(n) - n
            which = np.repeat(np.arange(len(at)), n)
            entry = np.arange(len(which)) + np.repeat(starts[token] - first, n)
            heads = digests.prefixes(cfg.seed, f"sample:{cfg.epoch}", keys)
            places = [heads[r] + b"%d:" % i for r, i in zip(rows.tolist(), (at - offsets[rows]).tolist())]
            score = logits[entry] + digests.gumbel(digests.draws(places, which, ids[entry]))
            best = np.flatnonzero(score == np.maximum.reduceat(score, first)[which])
            # Ids ascend inside of a token's offers, so the first of equals is the lowest.
            out[at] = ids[entry[best[np.unique(which[best], return_index=True)[1]]]]
        ends = pa.array(offsets.astype(np.int32), mask=np.append(lists.is_null().to_numpy(zero_copy_only=False), False))
        return pa.ListArray.from_arrays(ends, pa.array(out, mask=(out == -1) & values.is_null().to_numpy(zero_copy_only=False)))

    return masked.withColumn("sampled_input_ids", drawn("input_ids", "replaced", F.col(key).cast("string")))


def pair_counts(df: DataFrame, ids: str = "input_ids", protected=PROTECTED_IDS) -> DataFrame:
    """``before, id, n``: how often an id that is not protected follows another, counted in
    Arrow batches before anything becomes a row."""

    def run(batches):
        for batch in batches:
            lists = batch.column(0)
            sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            x = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            inner = np.ones(len(x) + 1, bool)
            inner[np.append(0, np.cumsum(sizes))] = False
            at = np.flatnonzero(inner[: len(x)])
            at = at[~np.isin(x[at], protected)]
            codes, n = np.unique((x[at - 1] << 32) | x[at], return_counts=True)
            columns = [pa.array((codes >> 32).astype(np.int32)), pa.array((codes & 0xFFFFFFFF).astype(np.int32)), pa.array(n.astype(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, ["before", "id", "n"])

    counted = df.select(ids).mapInArrow(run, "before int, id int, n bigint")
    return counted.groupBy("before", "id").agg(F.sum("n").alias("n"))


def replacement_labels(df: DataFrame, protected=PROTECTED_IDS) -> DataFrame:
    """Add ``labels_at_token_level``: 1 where a replaced token really differs,
    0 elsewhere, the ignore value at protected ids."""
    differs = F.zip_with("sampled_input_ids", "input_ids", lambda s, x: s != x)
    changed = F.zip_with("replaced", differs, lambda r, d: r & d)
    label = F.zip_with(
        changed,
        "input_ids",
        lambda c, x: F.when(is_special(x, protected), F.lit(IGNORE)).when(c, F.lit(1)).otherwise(F.lit(0)),
    )
    return df.withColumn("labels_at_token_level", label)


def corrupt(
    df: DataFrame, key: str, table: tuple[np.ndarray, np.ndarray], cfg: CorruptionConfig = CorruptionConfig()
) -> DataFrame:
    """Masking, replacing and labelling in one map."""
    if cfg.algorithm == "md5" and cfg.sentence_probability <= 0:
        return _with_drawn(df, key, cfg, table)
    return replacement_labels(replace_tokens(mask_tokens(df, key, cfg), key, table, cfg), cfg.protected)
