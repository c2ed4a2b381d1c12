"""Operator 7, SentencePiece encoding and decoding with byte offsets.

The library segments; what it doesn't hand back cheaply is where each piece comes from. So the
normaliser of the model is replayed here: its compiled character map, a double-array trie over
UTF-8 prefixes, is walked for the longest prefix at each position, and every byte of the
normalised text records the source byte it came from. Pieces tile the normalised text, so
piece lengths, summed, index straight into that record: each piece gets the half-open span of
original UTF-8 bytes that it covers. Spans are monotone and cover the whole text.

The model file that is at hand compiles no map of its own, so the query gives it that of the
library's rule ``nmt_nfkc`` (no piece changes by it, and nothing is trained).

No key of such a map goes on with an ASCII character after its first one. So rewriting can only
happen in clusters: runs of other than ASCII bytes with the ASCII character before them, and
control characters. Clusters are walked once and kept; the rest of a text is aligned by array
operations. Maps with other keys, and models that squeeze white space, take the plain walk. If
the pieces of a text don't add up to its replayed normal form, an error is raised; offsets are
never guessed.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm.common import pick, table

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: The library's normalisation rule whose compiled map a model is given; None leaves its own.
RULE = "nmt_nfkc"
SPACE = "▁".encode()
RESULT = "doc_id bigint, ids array<int>, starts array<int>, ends array<int>, decoded_ok boolean"
_BATCH = 1 << 20
_CLUSTER = re.compile(rb"[\x00-\x7f]?[\x80-\xff]+|[\x00-\x1f\x7f]")
_KEPT = 1 << 16  # clusters remembered


class CharacterMap:
    """A compiled character map: longest-prefix replacement over UTF-8 bytes."""

    def __init__(self, blob: bytes):
        size = int.from_bytes(blob[:4], "little") if blob else 0
        self.units = np.frombuffer(blob[4 : 4 + size], "<u4").tolist()
        self.pool = blob[4 + size :]

    def longest(self, data: bytes, at: int) -> tuple[int, int]:
        """Length of the longest key that ``data`` has at a position, and its place in the pool; (0, 0) if none."""
        if not self.units:
            return 0, 0
        best = (0, 0)
        node = 0
        unit = self.units[0]
        node ^= (unit >> 10) << ((unit & 0x200) >> 6)
        for i in range(at, len(data)):
            c = data[i]
            node ^= c
            unit = self.units[node]
            if unit & 0x800000FF != c:
                break
            node ^= (unit >> 10) << ((unit & 0x200) >> 6)
            if unit >> 8 & 1:
                best = (i - at + 1, self.units[node] & 0x7FFFFFFF)
        return best

    def replacement(self, place: int) -> bytes:
        return self.pool[place : self.pool.index(b"\0", place)]

    def clustered(self) -> bool:
        """Whether no key has an ASCII byte after its first: all nodes of the trie are looked at."""
        if not self.units:
            return True
        units, labels = np.array(self.units, np.int64), np.arange(1, 256)
        nodes, depth = np.array([(units[0] >> 10) << ((units[0] & 0x200) >> 6)]), 0
        while len(nodes):
            grown = []
            for at in range(0, len(nodes), 1 << 14):
                place = nodes[at : at + (1 << 14), None] ^ labels[None, :]
                unit = np.where(place < len(units), units[np.minimum(place, len(units) - 1)], 0)
                i, j = np.nonzero((place < len(units)) & (unit & 0x800000FF == labels[None, :]))
                if depth and (labels[j] < 0x80).any():
                    return False
                unit = unit[i, j]
                grown.append(place[i, j] ^ ((unit >> 10) << ((unit & 0x200) >> 6)))
            nodes, depth = np.concatenate(grown), depth + 1
        return True


class Normaliser:
    """The normaliser settings of a model, replayed with source alignment."""

    def __init__(self, spec, whitespace_suffix: bool = False):
        self.map = CharacterMap(spec.precompiled_charsmap)
        self.prefix = spec.add_dummy_prefix
        self.squeeze = spec.remove_extra_whitespaces
        self.escape = spec.escape_whitespaces
        self.suffix = whitespace_suffix
        self.fast = not self.squeeze and self.escape and not self.suffix and self.map.clustered()
        self.clusters: dict[bytes, tuple[bytes, list[int] | None]] = {}

    def align(self, source: bytes) -> tuple[bytes, np.ndarray]:
        """Normalised bytes (on the fast path without the blank in front, and blanks as they are) and len + 1 source offsets."""
        if not self.fast:
            return self._walk(source)
        raw = np.frombuffer(source, np.uint8)
        times = np.where(raw == 32, len(SPACE), 1)
        out, at = [], 0
        for found in _CLUSTER.finditer(source) if self.map.units else ():
            data = found.group()
            if (entry := self.clusters.get(data)) is None:
                entry = self._cluster(data)
            if entry[1] is not None:
                out += [source[at : found.start()], entry[0]]
                at = found.end()
                times[found.start() : at] = entry[1]
        head = np.zeros(len(SPACE) if self.prefix and len(raw) else 0, np.int64)
        return b"".join([*out, source[at:]]), np.concatenate([head, np.repeat(np.arange(len(raw)), times), [len(raw)]])

    def _cluster(self, data: bytes) -> tuple[bytes, list[int] | None]:
        """What a cluster becomes, and how many bytes each of its own stands for; None if it stays."""
        new, times, at, changed = [], [0] * len(data), 0, False
        while at < len(data):
            length, place = self.map.longest(data, at)
            if length:
                part, changed = self.map.replacement(place), True
            else:
                first = data[at]
                length = 1 if first < 0x80 else 2 if first < 0xE0 else 3 if first < 0xF0 else 4
                part = data[at : at + length]
            if part == data[at : at + length] and b" " not in part:
                times[at : at + length] = [1] * length
            else:
                times[at] = len(part) + (len(SPACE) - 1) * part.count(b" ")
            new.append(part)
            at += length
        if len(self.clusters) >= _KEPT:
            self.clusters.clear()
        entry = self.clusters[data] = (b"".join(new), times if changed else None)
        return entry

    def _walk(self, source: bytes) -> tuple[bytes, np.ndarray]:
        out, where = bytearray(), []
        space = SPACE if self.escape else b" "
        at, n = 0, len(source)
        chunks: list[tuple[bytes, int, int]] = []
        while at < n:
            length, place = self.map.longest(source, at)
            if length:
                new = self.map.replacement(place)
            else:
                first = source[at]
                length = 1 if first < 0x80 else 2 if first < 0xE0 else 3 if first < 0xF0 else 4
                new = source[at : at + length]
            chunks.append((new, at, at + length))
            at += length
        a, b = 0, len(chunks)
        if self.squeeze:
            while a < b and chunks[a][0] in (b" ", b""):
                a += 1
        def put(data: bytes, begin: int, own: bool = False) -> None:
            out.extend(data)
            where.extend(range(begin, begin + len(data)) if own else [begin] * len(data))
        if a == b:
            return b"", np.array([n], np.int64)
        blank = self.squeeze
        if self.prefix and not self.suffix:
            put(space, 0)
            blank = True
        for new, begin, end_ in chunks[a:b]:
            if b" " not in new and new == source[begin:end_]:  # an unchanged character keeps its bytes
                put(new, begin, True)
                blank = False
                continue
            if self.squeeze:
                while blank and new.startswith(b" "):
                    new = new[1:]
            for byte in new:
                put(space if byte == 32 else bytes([byte]), begin)
            if new:
                blank = new.endswith(b" ") and self.squeeze
        end = n
        if self.squeeze:
            while out.endswith(space):
                del out[-len(space) :]
                end = where[-1]
                del where[-len(space) :]
        if self.prefix and self.suffix:
            put(space, end)
        return bytes(out), np.array([*where, n], np.int64)


class Encoder:
    """A model with its normaliser and the byte length of every piece."""

    def __init__(self, model: bytes):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        proto.ParseFromString(model)
        self.library = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.normaliser = Normaliser(proto.normalizer_spec, proto.trainer_spec.treat_whitespace_as_suffix)
        byte, unknown = 6, 2
        self.lengths = np.array([1 if p.type == byte else 0 if p.type == unknown else len(p.piece.encode()) for p in proto.pieces], np.int64)
        self.unknown = np.array([p.type == unknown for p in proto.pieces])
        # what each piece decodes to; control symbols to nothing
        special = {3: b"", unknown: proto.trainer_spec.unk_surface.encode()}
        self.surface = [bytes([int(p.piece[3:5], 16)]) if p.type == byte else special.get(p.type, p.piece.encode().replace(SPACE, b" ")) for p in proto.pieces]

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(ids, first bytes, ends) of each text."""
        return [f[:3] for f in self.encode_all(texts)]

    def encode_all(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, bool]]:
        """The same, and whether the pieces decode to the normal form of the text."""
        out = []
        for text, ids in zip(texts, self.library.encode(texts, num_threads=1)):
            ids = np.array(ids, np.int32)
            source = text.encode("utf-8")
            normal, where = self.normaliser.align(source)
            lengths = self.lengths[ids]
            if self.unknown[ids].any():
                lengths = self._with_unknown(text, lengths, ids)
            bounds = np.concatenate([[0], np.cumsum(lengths)])
            if bounds[-1] != len(where) - 1:
                raise ValueError("the pieces of a text don't add up to its normal form")
            spans = where[bounds].astype(np.int32)
            if len(ids):
                spans[0], spans[-1] = 0, len(source)
            if not self.normaliser.fast:
                normal = normal.replace(SPACE, b" ")
                normal = normal[1:] if self.normaliser.prefix and not self.normaliser.suffix else normal
            out.append((ids, spans[:-1], spans[1:], self.decode(ids.tolist()) == normal))
        return out

    def _with_unknown(self, text: str, lengths: np.ndarray, ids: np.ndarray) -> np.ndarray:
        pieces = self.library.encode(text, out_type=str)
        return np.array([len(p.encode()) for p in pieces], np.int64) if len(pieces) == len(ids) else lengths

    def decode(self, ids: list[int]) -> bytes:
        """The bytes that pieces stand for, without the blank that encoding puts in front."""
        out = b"".join([self.surface[i] for i in ids])
        return out[1:] if self.normaliser.prefix and not self.normaliser.suffix and out.startswith(b" ") else out


def with_rule(model: bytes, rule: str | None) -> bytes:
    """The model with the compiled character map of one of the library's rules, all else as it was."""
    if rule is None:
        return model
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2

    proto, donor = sentencepiece_model_pb2.ModelProto(), sentencepiece_model_pb2.ModelProto()
    proto.ParseFromString(model)
    donor.ParseFromString(sentencepiece.SentencePieceNormalizer(rule_name=rule).serialized_model_proto())
    proto.normalizer_spec.name = rule
    proto.normalizer_spec.precompiled_charsmap = donor.normalizer_spec.precompiled_charsmap
    return proto.SerializeToString()


_loaded: dict[tuple[str, str | None], Encoder] = {}


def encoder(path: str, rule: str | None = None, blob: bytes | None = None) -> Encoder:
    if (path, rule) not in _loaded:
        _loaded[path, rule] = Encoder(blob if blob is not None else with_rule(Path(path).read_bytes(), rule))
    return _loaded[path, rule]


def encoded(docs: DataFrame, model: str = MODEL, rule: str | None = RULE, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids, starts, ends, decoded_ok): pieces, their byte spans, and whether decoding gives the normal form back.

    ``starts[i]:ends[i]`` are UTF-8 byte offsets in the original text; together they cover it. A
    piece of text that the map takes out belongs to the piece before it. Null texts give nulls,
    empty ones empty arrays. Repeated rows and null ids pass through, nothing is ranked, so ties
    don't arise; other columns are dropped. The model (about 0.7 MB with its map) is broadcast.
    """
    blob = docs.sparkSession.sparkContext.broadcast(with_rule(Path(model).read_bytes(), rule))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = encoder(model, rule, blob.value)
        for batch in batches:
            names, texts = batch.column(0), batch.column(1).to_pylist()
            at = 0
            while at < len(texts):
                to, size = at, 0
                while to < len(texts) and (to == at or size < _BATCH):
                    size += len(texts[to] or "")
                    to += 1
                yield _encode(tool, names.slice(at, to - at), texts[at:to])
                at = to

    slim = pick(docs, doc_id=id_col, text=text_col).select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return slim.mapInArrow(run, RESULT)


def _encode(tool: Encoder, names: pa.Array, texts: list[str | None]) -> pa.RecordBatch:
    found = tool.encode_all([t or "" for t in texts])
    offsets = np.concatenate([[0], np.cumsum([len(f[0]) for f in found])]).astype(np.int32)
    nulls = np.array([t is None for t in texts], bool)
    index = pa.array(np.append(offsets[:-1], offsets[-1:]), pa.int32(), mask=np.append(nulls, False)) if nulls.any() else pa.array(offsets, pa.int32())
    lists = [pa.ListArray.from_arrays(index, pa.array(np.concatenate([f[k] for f in found]) if found else [], pa.int32())) for k in range(3)]
    ok = pa.array([None if t is None else f[3] for t, f in zip(texts, found)], pa.bool_())
    return pa.RecordBatch.from_arrays([names, *lists, ok], ["doc_id", "ids", "starts", "ends", "decoded_ok"])


def decoded(pieces: DataFrame, model: str = MODEL, *, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, text): the text of each array of ids; null for null, empty for none, null for ids that the model hasn't.

    Bytes that aren't UTF-8 together become replacement characters.
    """
    blob = pieces.sparkSession.sparkContext.broadcast(Path(model).read_bytes())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tool = encoder(model, None, blob.value)
        n = len(tool.lengths)
        for batch in batches:
            rows = [None if x is None or any(i is None or not 0 <= i < n for i in x) else [int(i) for i in x] for x in batch["ids"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "text": pd.Series([None if r is None else tool.decode(r).decode("utf-8", "replace") for r in rows], dtype=object)})

    return pick(pieces, doc_id=id_col, ids=ids_col).select(F.col("doc_id").cast("long"), F.col("ids").cast("array<int>")).mapInPandas(run, "doc_id bigint, text string")


def op7_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded(table(spark, sf_dir, "documents"))
