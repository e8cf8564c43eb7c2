"""Near-duplicate documents by SetSketch registers over word shingles.

A register holds the largest exponentially spaced level that an element's random
exponential falls below, that is a truncated minimum: registers of unions are the
larger of two registers, and two sets agree in a register about as often as they
share elements. Bands of registers give candidate pairs; a pair goes on unless the
joint likelihood of its registers rules the threshold out; what is left is confirmed
on the full shingle sets.

Documents with equal shingle sets are one class, and only a class's smallest document
takes part. In a band's bucket all documents are compared with the smallest one;
only where a bucket then still holds more than one component are the pairs across
components compared too, in blocks of bounded size that return a spanning forest. So
groups of copies never give all their pairs, and no link that could join two
components is left out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import discard, materialized
from . import words
from .batches import flat, ranges, slices
from .components import components

BANDS, BAND_ROWS = 32, 5
REGISTERS = BANDS * BAND_ROWS
BASE, RATE, TOP = 1.001, 20.0, 2**16 - 1
DOUBT = 15.0
BLOCK = 1 << 15
STAR_SIZE = 500
CHUNK = 512
PAIRS_AT_ONCE = 100_000
_STEPS = np.array([(i * 0x9E3779B97F4A7C15 >> 13) & 0xFFFFFFFF | 1 for i in range(1, REGISTERS + 1)], np.uint64)
_MULTIPLIERS = (words.mix(_STEPS) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
_MASKS = words.mix(_STEPS * np.uint64(words.WORD_BASE)).astype(np.uint32)


def shingle_sets(texts: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, one text after the other, and
    where each begins. A text with fewer words than ``size`` has its whole sequence
    as the only shingle, one without words has none."""
    data, offsets = flat(texts)
    data = words.lower_ascii(data)
    starts, ends, first = words.bounds(data, offsets)
    hashes = words.word_hashes(data, starts, ends)
    count = np.diff(first)
    n = np.where(count >= size, count - size + 1, (count > 0).astype(np.int64))
    rolling = np.zeros(len(hashes), np.uint64)
    whole = words.sequence_hashes(hashes, size)
    rolling[: len(whole)] = whole
    for few in range(1, size):
        at = first[:-1][count == few]
        if len(at):
            rolling[at] = words.sequence_hashes(hashes, few)[at]
    out, begins = [], np.zeros(len(n) + 1, np.int64)
    for i, (a, k) in enumerate(zip(first[:-1], n)):
        mine = np.sort(rolling[a : a + k])
        if k > 1:
            new = np.empty(k, bool)
            new[0] = True
            np.not_equal(mine[1:], mine[:-1], out=new[1:])
            mine = mine[new]
        out.append(mine)
        begins[i + 1] = begins[i] + len(mine)
    return (np.concatenate(out) if out else np.zeros(0, np.uint64)), begins


def registers(sets: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Registers (uint16) of each non-empty set, one row per set."""
    low = np.empty((len(begins) - 1, REGISTERS), np.uint32)
    short = (sets >> np.uint64(32)).astype(np.uint32)
    at = 0
    while at < len(begins) - 1:
        to = max(int(np.searchsorted(begins, begins[at] + BLOCK, "right")) - 1, at + 1)
        mine = short[begins[at] : begins[to]]
        where = begins[at:to] - begins[at]
        scratch = np.empty_like(mine)
        for i in range(REGISTERS):
            np.bitwise_xor(mine, _MASKS[i], out=scratch)
            np.multiply(scratch, _MULTIPLIERS[i], out=scratch)
            low[at:to, i] = np.minimum.reduceat(scratch, where)
        at = to
    x = -np.log1p(-(low + 0.5) / 2.0**32) / RATE
    return np.clip(np.floor(1 - np.log(x) / np.log(BASE)), 0, TOP).astype("<u2")


def merged(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Registers of the union of two sets."""
    return np.maximum(left, right)


def _rate(x: np.ndarray) -> np.ndarray:
    return -np.log1p(-x * (BASE - 1) / BASE) / np.log(BASE)


def likelihoods(left: np.ndarray, right: np.ndarray, n_left: np.ndarray, n_right: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Joint log likelihood of two sets' registers for each similarity in a row of
    ``at`` (one row per pair); the sets' sizes are known exactly."""
    more, less = (left > right).sum(1)[:, None], (left < right).sum(1)[:, None]
    same = left.shape[1] - more - less
    u = (n_left / (n_left + n_right))[:, None]
    v = 1 - u
    tiny = 1e-12
    p, q = _rate(np.maximum(u - v * at, 0)), _rate(np.maximum(v - u * at, 0))
    return more * np.log(np.maximum(p, tiny)) + less * np.log(np.maximum(q, tiny)) + same * np.log(np.maximum(1 - p - q, tiny))


def estimate(left: np.ndarray, right: np.ndarray, n_left: np.ndarray, n_right: np.ndarray) -> np.ndarray:
    """Most likely similarity of each pair."""
    at = np.linspace(0, 1, 201) * np.minimum(n_left / n_right, n_right / n_left)[:, None]
    return at[np.arange(len(at)), likelihoods(left, right, n_left, n_right, at).argmax(1)]


def plausible(left: np.ndarray, right: np.ndarray, n_left: np.ndarray, n_right: np.ndarray, threshold: float) -> np.ndarray:
    """Pairs for which the threshold or more is not ruled out."""
    most = np.minimum(n_left / n_right, n_right / n_left)
    ok = most >= threshold * (1 - 1e-12)
    out = np.zeros(len(ok), bool)
    if not ok.any():
        return out
    left, right, a, b, most = left[ok], right[ok], n_left[ok], n_right[ok], most[ok][:, None]
    above = likelihoods(left, right, a, b, threshold + (most - threshold) * np.linspace(0, 1, 17)).max(1)
    below = likelihoods(left, right, a, b, threshold * np.linspace(0, 1, 33)[None, :].repeat(len(a), 0)).max(1)
    out[ok] = above >= below - DOUBT
    return out


# --- tables ------------------------------------------------------------------


def signatures(docs: DataFrame, size: int, key: str = "doc_id", column: str = "text") -> DataFrame:
    """``doc, n, mark_a, mark_b, sketch`` per row: distinct shingles, a 128-bit mark
    of the set and its registers (null without shingles)."""
    rows = docs.select(F.col(key).cast("long").alias("doc"), F.col(column).cast("string").alias("text"))

    def run(batches):
        for part in slices(batches, "text"):
            sets, begins = shingle_sets(part.column(1), size)
            n = np.diff(begins)
            some = np.flatnonzero(n)
            a, b = np.zeros(len(n), np.uint64), np.zeros(len(n), np.uint64)
            sketches = np.empty(len(n), object)
            if len(some):
                where = begins[:-1][some]
                a[some] = np.add.reduceat(words.mix(sets), where)
                b[some] = np.bitwise_xor.reduceat(words.mix(sets * np.uint64(words.BYTE_BASE)), where)
                found = registers(sets, np.append(where, len(sets)))
                for i, row in zip(some, found):
                    sketches[i] = row.tobytes()
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(n), pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), pa.array(list(sketches), pa.binary())],
                ["doc", "n", "mark_a", "mark_b", "sketch"],
            )

    return rows.mapInArrow(run, "doc long, n long, mark_a long, mark_b long, sketch binary")


def _band_keys() -> Column:
    width = 2 * BAND_ROWS
    return F.array(*[F.xxhash64(F.lit(i), F.substring("sketch", i * width + 1, width)) for i in range(BANDS)])


def _likely(pairs: DataFrame, sketches: DataFrame, threshold: float) -> DataFrame:
    """Pairs ``a, b`` that their registers do not rule out."""
    one = sketches.select(F.col("doc").alias("a"), F.col("n").alias("n_a"), F.col("sketch").alias("s_a"))
    two = sketches.select(F.col("doc").alias("b"), F.col("n").alias("n_b"), F.col("sketch").alias("s_b"))

    def run(batches):
        def values(column):
            return flat(column)[0].view("<u2").reshape(len(column), REGISTERS)

        for batch in batches:
            if batch.num_rows:
                n_a, n_b = (batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in ("n_a", "n_b"))
                ok = plausible(values(batch.column("s_a")), values(batch.column("s_b")), n_a, n_b, threshold)
                yield batch.select(["a", "b"]).filter(pa.array(ok))

    joined = pairs.join(one, "a").join(two, "b").where("least(n_a, n_b) >= {} * greatest(n_a, n_b)".format(threshold - 1e-9))
    return joined.select("a", "b", "n_a", "n_b", "s_a", "s_b").mapInArrow(run, "a long, b long")


def confirmed(pairs: DataFrame, docs: DataFrame, size: int, percent: int, key: str, column: str) -> DataFrame:
    """The pairs ``a, b`` whose full shingle sets have 100 * common >= percent * all.

    Each ``a`` is a star with its ``b`` around it; large stars are split. Every text
    in a pair goes once to each star it belongs to.
    """
    pairs = materialized(pairs)
    stars = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / F.lit(float(STAR_SIZE))).cast("int").alias("parts"))
    split = materialized(
        pairs.join(stars, "a").withColumn("part", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int")).select("a", "b", "part")
    )
    targets = split.select(F.col("b").alias("doc"), "a", "part", F.lit(1).alias("role")).union(
        split.select(F.col("a").alias("doc"), "a", "part", F.lit(0).alias("role")).distinct()
    )
    texts = docs.select(F.col(key).cast("long").alias("doc"), F.col(column).cast("string").alias("text"))
    rows = texts.join(targets.hint("shuffle_hash"), "doc").select("a", "part", "role", "doc", "text").repartition("a", "part").sortWithinPartitions("a", "part", "role")

    def run(batches):
        star, center = None, None
        for part in slices(batches, "text"):
            sets, begins = shingle_sets(part.column("text"), size)
            a, split_no, role, doc = (part.column(c).to_pylist() for c in ("a", "part", "role", "doc"))
            out_a, out_b = [], []
            for i in range(part.num_rows):
                mine = sets[begins[i] : begins[i + 1]]
                if role[i] == 0:
                    star, center = (a[i], split_no[i]), mine.copy()
                    continue
                if star != (a[i], split_no[i]) or not len(center) or not len(mine):
                    continue
                at = np.minimum(np.searchsorted(center, mine), len(center) - 1)
                common = int((center[at] == mine).sum())
                if 100 * common >= percent * (len(center) + len(mine) - common):
                    out_a.append(a[i])
                    out_b.append(doc[i])
            yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], ["a", "b"])

    return rows.mapInArrow(run, "a long, b long")


def _tasks(rows: DataFrame) -> DataFrame:
    """Rows of a bucket (``k, band, doc``) dealt to tasks, so that every two of them meet
    in one: a large bucket is cut into chunks, and a task holds two of them (``side``)
    or one."""
    sizes = rows.groupBy("band").agg(F.ceil(F.count(F.lit(1)) / F.lit(float(CHUNK))).cast("int").alias("_chunks"))
    dealt = rows.join(sizes, "band").withColumn("_mine", F.pmod(F.xxhash64("doc"), F.col("_chunks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("_chunks") - 1))
    dealt = dealt.withColumn("_other", other)
    low, high = F.least("_mine", "_other"), F.greatest("_mine", "_other")
    side = F.when(F.col("_chunks") == 1, 0).when(low == high, 0).otherwise(F.when(F.col("_mine") == low, 1).otherwise(2))
    dealt = dealt.withColumn("task", F.xxhash64("band", low, high)).withColumn("side", side)
    return dealt.drop("_chunks", "_mine", "_other").repartition("task").sortWithinPartitions("task")


def _whole_tasks(batches):
    """Tables that hold all rows of the tasks in them."""
    waiting: list[pa.RecordBatch] = []
    for batch in batches:
        if batch.num_rows == 0:
            continue
        tasks = batch.column("task").to_numpy()
        last = int(np.flatnonzero(tasks != tasks[-1])[-1]) + 1 if tasks[0] != tasks[-1] else 0
        if waiting and (last or waiting[-1].column("task")[-1].as_py() != tasks[0]):
            yield pa.Table.from_batches([*waiting, batch.slice(0, last)]).combine_chunks()
            waiting = []
        elif last:
            yield pa.Table.from_batches([batch.slice(0, last)])
        waiting.append(batch.slice(last))
    if waiting:
        yield pa.Table.from_batches(waiting).combine_chunks()


def _crossing(table: pa.Table, threshold: float):
    """Blocks of row pairs of one task, of different components, that their registers
    do not rule out and that share no earlier band."""
    column = lambda name: table.column(name).combine_chunks()
    tasks, side, component, k = (column(c).to_numpy() for c in ("task", "side", "component", "k"))
    n = column("n").to_numpy().astype(float)
    sketch = flat(column("sketch"))[0].view("<u2").reshape(len(n), REGISTERS)
    new = np.append(True, tasks[1:] != tasks[:-1])
    ends = np.append(np.flatnonzero(new)[1:], len(tasks))[np.cumsum(new) - 1]
    partners = ends - np.arange(len(tasks)) - 1
    reached = np.cumsum(partners)
    at = 0
    while at < len(tasks):
        to = int(np.searchsorted(reached, (reached[at - 1] if at else 0) + PAIRS_AT_ONCE, "right"))
        to = min(max(to, at + 1), len(tasks))
        rows = np.arange(at, to)
        i, j = np.repeat(rows, partners[rows]), ranges(rows + 1, partners[rows])
        ok = (component[i] != component[j]) & ((side[i] == 0) | (side[i] != side[j]))
        ok &= np.minimum(n[i], n[j]) >= threshold * np.maximum(n[i], n[j]) - 1e-9
        i, j = i[ok], j[ok]
        same = (sketch[i] == sketch[j]).reshape(len(i), BANDS, BAND_ROWS).all(2)
        first = same.argmax(1) == k[i]
        i, j = i[first], j[first]
        if len(i):
            ok = plausible(sketch[i], sketch[j], n[i], n[j], threshold)
            yield i[ok], j[ok]
        at = to


def _across(mixed: DataFrame, sketches: DataFrame, docs: DataFrame, size: int, percent: int, key: str, column: str) -> DataFrame:
    """Links ``a, b`` between components of a bucket, as far as they join any.

    ``mixed`` is a stored table ``k, band, doc, component`` of buckets with several
    components. First the registers tell which documents have a possible partner;
    only their sets are then made and compared.
    """
    threshold = percent / 100

    def partners(batches):
        for table in _whole_tasks(batches):
            found = [np.concatenate(ij) for ij in _crossing(table, threshold)]
            if found:
                rows = table.take(pa.array(np.unique(np.concatenate(found))))
                yield from rows.select(["k", "band", "doc", "component", "n", "sketch"]).to_batches()

    wide = mixed.join(sketches, "doc").select("k", "band", "doc", "component", "n", "sketch")
    schema = "k int, band long, doc long, component long, n long, sketch binary"
    needed = materialized(_tasks(wide).mapInArrow(partners, schema).dropDuplicates(["band", "doc"]))
    texts = docs.select(F.col(key).cast("long").alias("doc"), F.col(column).cast("string").alias("text"))
    wanted = texts.join(needed.select("doc").distinct().hint("shuffle_hash"), "doc", "left_semi")

    def make_sets(batches):
        for part in slices(batches, "text"):
            sets, begins = shingle_sets(part.column("text"), size)
            blobs = [sets[a:b].astype("<u8").tobytes() for a, b in zip(begins[:-1], begins[1:])]
            yield pa.RecordBatch.from_arrays([part.column("doc"), pa.array(blobs, pa.binary())], ["doc", "set"])

    sets = wanted.select("doc", "text").mapInArrow(make_sets, "doc long, set binary").dropDuplicates(["doc"])

    def compare(batches):
        for table in _whole_tasks(batches):
            own = [np.frombuffer(v.as_buffer(), "<u8") for v in table.column("set").combine_chunks()]
            doc, component = table.column("doc").to_numpy(), table.column("component").to_numpy()
            names, node = np.unique(component, return_inverse=True)
            label = np.arange(len(names))
            links = []
            for i, j in _crossing(table, threshold):
                for a, b in zip(i.tolist(), j.tolist()):
                    if label[node[a]] == label[node[b]]:
                        continue
                    x, y = own[a], own[b]
                    at = np.minimum(np.searchsorted(x, y), len(x) - 1)
                    common = int((x[at] == y).sum())
                    if 100 * common >= percent * (len(x) + len(y) - common):
                        links.append((doc[a], doc[b]))
                        low, high = sorted((label[node[a]], label[node[b]]))
                        label[label == high] = low
            if links:
                a, b = zip(*links)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return _tasks(needed.join(sets, "doc")).select("k", "doc", "component", "n", "sketch", "set", "task", "side").mapInArrow(compare, "a long, b long")


def near_duplicates(
    docs: DataFrame, size: int = 5, percent: int = 80, key: str = "doc_id", column: str = "text"
) -> DataFrame:
    """``key, n_shingles, component_id, kept`` for every row.

    Shingles are ``size`` consecutive words of the text in ASCII lower case. Documents
    with 100 * common shingles >= ``percent`` * all shingles are linked; a component is
    named by the smallest key that links reach, and that document is kept. A text
    without words, or null, has no shingles and is linked with nothing. Rows with a
    null key are linked with nothing and have a null component; rows with equal keys
    count as one document. Other columns are not read. A pair at a similarity of 0.8 is missed by all
    bands with a probability of about 3e-6, and less above.
    """
    threshold = percent / 100
    all_rows = materialized(signatures(docs, size, key, column))
    some = all_rows.where("n > 0 and doc is not null")
    marks = ["mark_a", "mark_b", "n"]
    classes = materialized(some.groupBy(*marks).agg(F.min("doc").alias("smallest")))
    sketches = materialized(
        some.select("doc", *marks, "sketch").join(classes, marks).where("doc = smallest").select("doc", "n", "sketch").dropDuplicates(["doc"])
    )
    banded = sketches.select("doc", F.posexplode(_band_keys()).alias("k", "band"))
    smallest = banded.groupBy("band").agg(F.min("doc").alias("a"), F.count(F.lit(1)).alias("c")).where("c > 1").drop("c")
    shared = materialized(banded.join(smallest, "band"))
    tried = shared.where("doc <> a").select("a", F.col("doc").alias("b")).distinct()
    links = materialized(confirmed(_likely(tried, sketches, threshold), docs, size, percent, key, column))
    found = components(links)
    # Buckets that still hold several components: their remaining pairs.
    labelled = materialized(
        shared.join(found, F.col("doc") == F.col("node"), "left").select("k", "band", "doc", F.coalesce("component", "doc").alias("component"))
    )
    several = labelled.groupBy("band").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x < y").select("band")
    mixed = materialized(labelled.join(several, "band"))
    more = materialized(_across(mixed, sketches, docs, size, percent, key, column))
    named = classes.join(found, F.col("smallest") == F.col("node"), "left").select(
        *marks, F.coalesce("component", "smallest").alias("component")
    )
    if more.limit(1).count():
        # Links between components join these, not the documents anew.
        label = lambda name: found.select(F.col("node").alias(name), F.col("component").alias(f"of_{name}"))
        between = more.join(label("a"), "a", "left").join(label("b"), "b", "left")
        joined = components(between.select(F.coalesce("of_a", "a").alias("a"), F.coalesce("of_b", "b").alias("b")))
        joined = joined.select(F.col("node").alias("component"), F.col("component").alias("further"))
        named = named.join(joined, "component", "left").select(*marks, F.coalesce("further", "component").alias("component"))
    named = materialized(named)
    for used in (sketches, shared, links, labelled, mixed, more, classes):
        discard(used)
    out = all_rows.select("doc", *marks).join(named, marks, "left")
    component = F.when((F.col("n") > 0) & F.col("doc").isNotNull(), F.col("component")).otherwise(F.col("doc"))
    return out.select(
        F.col("doc").alias(key),
        F.col("n").alias("n_shingles"),
        component.alias("component_id"),
        F.coalesce(F.col("doc") == component, F.lit(False)).alias("kept"),
    )
