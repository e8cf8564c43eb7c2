"""Encoding and decoding with a sentence-piece model of merge type.

The encoder finds all vocabulary pieces in a text with an Aho-Corasick automaton
and takes the longest piece at each position. Two neighbours are accepted if
merging their joined text anew gives the same two pieces; a list of pieces in which
all neighbours are so is the one the merges would give. If no piece fits, the
position is marked as failed in a bit field and the piece before it is shortened.

Texts are first cut wherever no piece of the vocabulary holds the two adjoining
characters, since no merge can cross such a place; each distinct segment is encoded
once per batch.
"""

from __future__ import annotations

import hashlib
import heapq
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .batches import flat, kept_in_worker, ranges, slices
from .segments import Memo, spread

SPACE = "▁"
UNKNOWN_TEXT = " ⁇ "


class Pieces:
    """Vocabulary of a model and its merging rules."""

    def __init__(self, pieces: list[tuple[str, float, str]], reachable: bytes | None = None):
        """``pieces`` are text, score and kind (normal, byte, control, unknown) by
        id. ``reachable`` tells which pieces merging can give; it is found here if
        it is not passed."""
        self.pieces = pieces
        self.ids = {p.replace(SPACE, " "): i for i, (p, _, kind) in enumerate(pieces) if kind == "normal"}
        self.scores = {p: pieces[i][1] for p, i in self.ids.items()}
        self.byte_ids = {int(p[1:-1], 16): i for i, (p, _, kind) in enumerate(pieces) if kind == "byte"}
        if len(self.byte_ids) != 256:
            raise ValueError("the model has no byte fallback")
        if reachable is None:
            reachable = bytes(kind == "normal" and len(self.merge(p.replace(SPACE, " "))) == 1 for p, _, kind in pieces)
        self.reachable = reachable
        self.pairs: dict[tuple[str, str], bool] = {}
        self.memo = Memo()
        self._automaton = None

    @classmethod
    def load(cls, model: bytes) -> Pieces:
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto.FromString(model)
        norm = proto.normalizer_spec
        plain = not norm.precompiled_charsmap and not norm.remove_extra_whitespaces
        plain &= norm.add_dummy_prefix and norm.escape_whitespaces and not proto.trainer_spec.treat_whitespace_as_suffix
        kinds = {1: "normal", 2: "unknown", 3: "control", 6: "byte"}
        if not plain or any(p.type not in kinds for p in proto.pieces) or proto.trainer_spec.model_type != 2:
            raise ValueError("only plain merge models with identity normalization are supported")
        assert sentencepiece.SentencePieceProcessor(model_proto=model).get_piece_size() == len(proto.pieces)
        return cls([(p.piece, p.score, kinds[p.type]) for p in proto.pieces])

    def merge(self, text: str) -> list[str]:
        """The pieces that merging gives: best score first, then leftmost."""
        n = len(text)
        part: list[str | None] = list(text)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        scores, agenda = self.scores, []

        def offer(left: int, right: int) -> None:
            joined = part[left] + part[right]
            score = scores.get(joined)
            if score is not None:
                heapq.heappush(agenda, (-score, left, right, len(joined)))

        for i in range(n - 1):
            offer(i, i + 1)
        while agenda:
            _, left, right, size = heapq.heappop(agenda)
            if part[left] is None or part[right] is None or len(part[left]) + len(part[right]) != size:
                continue
            part[left] += part[right]
            part[right] = None
            after[left] = after[right]
            if after[left] < n:
                before[after[left]] = left
                offer(left, after[left])
            if before[left] >= 0:
                offer(before[left], left)
        return [p for p in part if p is not None]

    @property
    def automaton(self):
        if self._automaton is None:
            import ahocorasick

            self._automaton = ahocorasick.Automaton()
            for text, i in self.ids.items():
                if self.reachable[i]:
                    self._automaton.add_word(text, len(text))
            self._automaton.make_automaton()
        return self._automaton

    def fits(self, left: str, right: str) -> bool:
        """Whether merging the joined text of two pieces gives them again."""
        known = self.pairs.get((left, right))
        if known is None:
            if len(self.pairs) > 500_000:
                self.pairs.clear()
            known = self.pairs[left, right] = self.merge(left + right) == [left, right]
        return known

    def split(self, text: str) -> list[str]:
        """The pieces of a text, by backtracking over longest matches."""
        if "  " in text:
            # Runs of blanks are pieces of equal score; ties are left to the merges.
            return self.merge(text)
        n = len(text)
        found: list[list[int]] = [[] for _ in range(n)]
        for end, size in self.automaton.iter(text):
            found[end + 1 - size].append(size)
        for sizes in found:  # ascending, as matches come by their end
            if not sizes or sizes[0] != 1:
                sizes.insert(0, 1)
        alive = (1 << (n + 1)) - 1 if n < 256 else None
        failed = bytearray(n // 8 + 1) if alive is None else None
        out: list[str] = []
        tried: list[int] = []
        at, option = 0, len(found[0]) - 1 if n else -1
        while at < n:
            last = out[-1] if out else None
            sizes = found[at]
            while option >= 0:
                end = at + sizes[option]
                open_end = alive >> end & 1 if alive is not None else not failed[end >> 3] >> (end & 7) & 1
                if open_end:
                    piece = text[at:end]
                    if last is None or self.fits(last, piece):
                        break
                option -= 1
            if option >= 0:
                out.append(piece)
                tried.append(option)
                at = end
                option = len(found[at]) - 1 if at < n else -1
            else:
                if alive is not None:
                    alive &= ~(1 << at)
                else:
                    failed[at >> 3] |= 1 << (at & 7)
                if not out:
                    raise AssertionError("no segmentation")
                at -= len(out.pop())
                option = tried.pop() - 1
        return out

    def encode_segment(self, text: str) -> list[int]:
        ids = []
        for p in self.split(text):
            i = self.ids.get(p)
            if i is not None:
                ids.append(i)
            else:
                ids.extend(self.byte_ids[b] for b in p.encode())
        return ids

    # --- whole batches -------------------------------------------------------

    @property
    def joins(self) -> np.ndarray:
        """Marks last and first bytes of neighbouring characters in any piece."""
        table = np.zeros((256, 256), bool)
        for p in self.ids:
            for x, y in zip(p, p[1:]):
                table[x.encode()[-1], y.encode()[0]] = True
        table[:, 0x80:0xC0] = True  # inside a character
        return table

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and where each text's begin."""
        if not hasattr(self, "_joins"):
            self._joins = self.joins
        texts = pc.fill_null(texts, "")
        texts = pc.if_else(pc.equal(texts, ""), "", pc.binary_join_element_wise("", pc.replace_substring(texts, SPACE, " "), " "))
        data, offsets = flat(texts)
        if len(data) == 0:
            return np.zeros(0, np.int32), np.zeros(len(offsets), np.int64)
        cut = np.ones(len(data), bool)
        np.logical_not(self._joins[data[:-1], data[1:]], out=cut[1:])
        cut[offsets[:-1][offsets[:-1] < len(data)]] = True
        starts = np.flatnonzero(cut)
        ends = np.append(starts[1:], len(data))
        make = lambda segments: [array("i", self.encode_segment(s)).tobytes() for s in segments]
        numbers, values = self.memo.values(data, starts, ends, make)
        return spread(numbers, values, np.searchsorted(starts, offsets), "i4")

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> list[bytes]:
        """UTF-8 text of each list of ids."""
        if not hasattr(self, "_bytes"):
            texts = []
            for p, _, kind in self.pieces:
                if kind == "byte":
                    texts.append(bytes([int(p[1:-1], 16)]))
                else:
                    texts.append({"normal": p.replace(SPACE, " "), "unknown": UNKNOWN_TEXT, "control": ""}[kind].encode())
            self._lengths = np.array([len(t) for t in texts], np.int64)
            self._begins = np.cumsum(self._lengths) - self._lengths
            self._bytes = np.frombuffer(b"".join(texts), np.uint8)
            self._is_byte = np.array([kind == "byte" for _, _, kind in self.pieces])
            self._starts_blank = np.array([kind == "normal" and p.startswith(SPACE) for p, _, kind in self.pieces])
        lengths = self._lengths[ids]
        raw = self._bytes[ranges(self._begins[ids], lengths)].tobytes()
        ends = np.zeros(len(ids) + 1, np.int64)
        np.cumsum(lengths, out=ends[1:])
        out = []
        for a, b in zip(offsets[:-1], offsets[1:]):
            text = raw[ends[a] : ends[b]]
            while a < b and self._lengths[ids[a]] == 0:  # control pieces come first without a text
                a += 1
            if a < b and self._starts_blank[ids[a]]:
                text = text[1:]
            out.append(_valid(text))
        return out


def _valid(text: bytes) -> bytes:
    """The text, with the mark U+FFFD for every byte that is not valid UTF-8."""
    try:
        text.decode()
        return text
    except UnicodeDecodeError:
        pass
    out, at = [], 0
    while at < len(text):
        first = text[at]
        size = 1 if first < 0x80 else 2 if first >> 5 == 6 else 3 if first >> 4 == 14 else 4
        try:
            out.append(text[at : at + size].decode().encode())
            at += size
        except UnicodeDecodeError:
            out.append("�".encode())
            at += 1
    return b"".join(out)


def _shipped(df: DataFrame, model_path: str):
    """A function giving the model in a worker; the file is read here once."""
    with open(model_path, "rb") as f:
        raw = f.read()
    made = Pieces.load(raw)
    sent = df.sparkSession.sparkContext.broadcast((hashlib.sha256(raw).hexdigest(), made.pieces, made.reachable))

    def model() -> Pieces:
        key, pieces, reachable = sent.value
        return kept_in_worker(f"pieces-{key}", lambda: Pieces(pieces, reachable))

    return model


def _with(df: DataFrame, name: str, kind: T.DataType) -> T.StructType:
    """The columns, with one more; it takes the place of one of that name."""
    others = [f for f in df.schema.fields if f.name.lower() != name.lower()]
    return T.StructType([*others, T.StructField(name, kind)])


def encode(df: DataFrame, model_path: str, column: str = "text", out: str = "ids") -> DataFrame:
    """Add the ids of each whole text (no begin or end ids). A null or empty text
    has no ids; other columns stay, but for one called ``out``."""
    model = _shipped(df, model_path)
    schema = _with(df, out, T.ArrayType(T.IntegerType(), False))

    def run(batches):
        for part in slices(batches, column):
            ids, offsets = model().encode(part.column(column))
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))
            yield pa.RecordBatch.from_arrays([*[part.column(c) for c in schema.names[:-1]], lists], schema.names)

    return df.mapInArrow(run, schema)


def decode(df: DataFrame, model_path: str, column: str = "ids", out: str = "decoded") -> DataFrame:
    """Add the text of each list of ids; null for a null list."""
    model = _shipped(df, model_path)
    schema = _with(df, out, T.StringType())

    def run(batches):
        for part in batches:
            lists = part.column(column)
            offsets = np.append(0, np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)))
            ids = lists.flatten().to_numpy(zero_copy_only=False)
            texts = pa.array([t.decode() for t in model().decode(ids, offsets)], pa.string())
            texts = pc.if_else(lists.is_null(), pa.scalar(None, pa.string()), texts)
            yield pa.RecordBatch.from_arrays([*[part.column(c) for c in schema.names[:-1]], texts], schema.names)

    return df.mapInArrow(run, schema)


def round_trip_digests(df: DataFrame, model_path: str, key: str = "doc_id", column: str = "text") -> DataFrame:
    """``key, n_tokens, ids_sha256, decoded_sha256`` of each whole text.

    Encodes and decodes in the worker, so that the ids need not travel. A null
    text counts as empty: no ids, digests of the empty string. Rows with equal
    keys each give a row; further columns are not read.
    """
    model = _shipped(df, model_path)
    rows = df.select(key, column)
    schema = T.StructType(
        [
            rows.schema[key],
            T.StructField("n_tokens", T.LongType()),
            T.StructField("ids_sha256", T.StringType()),
            T.StructField("decoded_sha256", T.StringType()),
        ]
    )

    def sha(raw: bytes) -> str:
        return hashlib.sha256(raw).hexdigest()

    def run(batches):
        for part in slices(batches, column):
            m = model()
            ids, offsets = m.encode(part.column(1))
            names = kept_in_worker(f"decimals-{len(m.pieces)}", lambda: pa.array([str(i) for i in range(len(m.pieces))], pa.large_string()))
            lists = pa.LargeListArray.from_arrays(pa.array(offsets), names.take(pa.array(ids)))
            joined = pc.binary_join(lists, pa.scalar(",", pa.large_string()))
            data, at = flat(joined)
            raw = data.tobytes()
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0),
                    pa.array(np.diff(offsets)),
                    pa.array([sha(raw[a:b]) for a, b in zip(at[:-1], at[1:])], pa.string()),
                    pa.array([sha(t) for t in m.decode(ids, offsets)], pa.string()),
                ],
                schema.names,
            )

    return rows.mapInArrow(run, schema)
