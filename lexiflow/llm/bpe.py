"""Operator 3: byte-level BPE encoding and decoding with content-defined chunk reuse.

Texts are cut where a rolling hash of the last 48 bytes says so, so a passage that several texts share is cut alike in all of
them. The chunks' digests (128 bits of their bytes) are counted over the whole table; a chunk found in two or more different texts is
encoded once, in one text that holds it, and its tokens travel to the others. What lies between shared chunks is encoded in place. A
seam between two encoded pieces is repaired: the stretch from the last sure boundary of the left piece to the first of the
right one is encoded anew, and widened until its outer boundaries agree with the tokens on both sides. A sure boundary is the
place before a space that follows a non-space: no token of the pattern crosses it, whatever stands around. So the result is
exactly that of encoding the whole text. Should two different chunks ever have one digest, the tokens don't decode to the text; such a
text is encoded whole.

Equal texts meet in one task and are encoded once.

Cost at scale. Digests, not texts, are counted, and within each partition first, so a passage that every document holds costs its
task one row a partition; what it owns is joined back to the digests, where a hot one may be split. The texts are shuffled once,
compressed (the exchange is used by both the join that encodes shared chunks and the one that assembles the texts).

Defined results: a null text has null tokens and a null round trip; an empty text has no tokens. Rows keep their doc_id and
come once each, repeated ones too. Further columns of any name are ignored. An empty table gives an empty result. The vocabulary
file's path is a parameter; it is read by every worker, so on a cluster it has to lie where all machines can read it.
"""

from __future__ import annotations

import base64
import functools
import re
from collections.abc import Iterator
from typing import TYPE_CHECKING

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import _bytes as B
from ._spark import cut, table

if TYPE_CHECKING:
    import tiktoken

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Bytes that the rolling hash sees; a cut on average every so many bytes; least size of a chunk.
WINDOW, AVERAGE, LEAST = 48, 256, 96
_SPACE = re.compile(rb"(?<=[!-~\x80-\xff]) (?=[!-~])")


@functools.cache
def encoding(path: str = VOCABULARY) -> tiktoken.Encoding:
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f)}
    return tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def cuts(data: np.ndarray, off: np.ndarray) -> list[np.ndarray]:
    """Of each text, the ends of its chunks, the last one being its length. A cut never splits a UTF-8 letter."""
    n = len(data)
    if n > WINDOW:
        p = B.prefix_hash(data)
        ends = np.arange(WINDOW, n)
        ends = ends[(data[ends] & 0xC0) != 0x80]
        h = B.span_hash(p, ends - WINDOW, ends)
        ends = ends[h < np.uint64(2**64 // AVERAGE)]
    else:
        ends = np.zeros(0, dtype=np.int64)
    out = []
    at = np.searchsorted(ends, off)
    for i in range(len(off) - 1):
        size, last, got = off[i + 1] - off[i], 0, []
        for e in (ends[at[i] : at[i + 1]] - off[i]).tolist():
            if e >= WINDOW and e - last >= LEAST and e < size:
                got.append(e)
                last = e
        if size:
            got.append(int(size))
        out.append(np.array(got, dtype=np.int64))
    return out


def digest(chunk: bytes | memoryview) -> bytes:
    return xxhash.xxh3_128_digest(chunk)


def chunks(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, list[bytes]]]:
    """(row, ends, digests of the chunks) of every text that has any."""
    for at, part in B.pieces(texts):
        data, off = B.view(part)
        raw = memoryview(data)
        for i, ends in enumerate(cuts(data, off)):
            if len(ends):
                bounds = [int(off[i]), *(ends + off[i]).tolist()]
                yield at + i, ends, [digest(raw[a:b]) for a, b in zip(bounds, bounds[1:])]


def _seams(data: bytes, ends: list[int], size: int) -> list[tuple[int, int]]:
    """The stretches to encode anew around the given seams: from the last sure boundary before each to the first after it,
    or to the text's end; stretches that touch are joined."""
    out: list[tuple[int, int]] = []
    for e in ends:
        lo, step = 0, 64
        while e - step > 0:
            found = [m.start() for m in _SPACE.finditer(data, max(0, e - step), e)]
            if found:
                lo = found[-1]
                break
            step *= 4
        else:
            found = [m.start() for m in _SPACE.finditer(data, 0, e)]
            lo = found[-1] if found else 0
        m = _SPACE.search(data, max(e, 1) - 1)
        while m and m.start() < e:
            m = _SPACE.search(data, m.start() + 1)
        hi = m.start() if m else size
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(hi, out[-1][1]))
        else:
            out.append((lo, hi))
    return out


class Encoder:
    def __init__(self, path: str):
        self.encoding = encoding(path)
        self.lengths = np.zeros(self.encoding.n_vocab, dtype=np.int64)
        for token in range(self.encoding.n_vocab):
            try:
                self.lengths[token] = len(self.encoding.decode_single_token_bytes(token))
            except KeyError:
                pass

    def plain(self, data: bytes) -> np.ndarray:
        return np.array(self.encoding.encode_ordinary(data.decode("utf-8")), dtype=np.int32)

    def encode(self, data: bytes, ends: np.ndarray, shared: dict[int, np.ndarray]) -> np.ndarray:
        """shared: tokens of chunks, by number of the chunk."""
        if not shared:
            return self.plain(data)
        parts: list[np.ndarray] = []
        seams: list[int] = []
        at = start = 0
        for i, e in enumerate(ends.tolist()):
            if i in shared:
                if at > start:
                    parts.append(self.plain(data[start:at]))
                    seams.append(at)
                parts.append(shared[i])
                seams.append(e)
                start = e
            at = e
        if at > start:
            parts.append(self.plain(data[start:at]))
        else:
            seams = seams[:-1]
        tokens = np.concatenate(parts)
        if self.lengths[tokens].sum() != len(data):  # a chunk's tokens are those of another
            return self.plain(data)
        return self.repair(data, tokens, seams)

    def repair(self, data: bytes, tokens: np.ndarray, seams: list[int]) -> np.ndarray:
        if not seams:
            return tokens
        bounds = np.concatenate(([0], np.cumsum(self.lengths[tokens])))
        out: list[np.ndarray] = []
        last = 0
        for lo, hi in _seams(data, seams, len(data)):
            while True:
                i, j = np.searchsorted(bounds, (lo, hi))
                agrees = (bounds[i] == lo, bounds[j] == hi)
                if all(agrees):
                    break
                # a token crosses the end of the stretch: widen it to the token's other end, then to a sure boundary
                if not agrees[0]:
                    before = [m.start() for m in _SPACE.finditer(data, 0, int(bounds[i - 1]) + 1)]
                    lo = before[-1] if before and before[-1] < lo else 0
                if not agrees[1]:
                    m = _SPACE.search(data, int(bounds[j]) - 1)
                    hi = m.start() if m and m.start() > hi else len(data)
            if i < last:  # widened into the stretch before: do the whole text
                return self.plain(data)
            out += [tokens[last:i], self.plain(data[lo:hi])]
            last = int(j)
        return np.concatenate([*out, tokens[last:]])


def _packed(t: np.ndarray) -> bytes:
    return (t.astype(np.uint16) if len(t) == 0 or t.max() < 1 << 16 else t.astype(np.uint32)).tobytes() + (b"s" if len(t) == 0 or t.max() < 1 << 16 else b"l")


def _unpacked(b: bytes) -> np.ndarray:
    return np.frombuffer(b[:-1], dtype=np.uint16 if b[-1:] == b"s" else np.uint32).astype(np.int32)


@F.arrow_udf(T.BinaryType())
def _squeezed(texts: pa.Array) -> pa.Array:
    z = zstandard.ZstdCompressor(level=3)
    return pa.array([None if t is None else z.compress(t.as_buffer()) for t in (x if x.is_valid else None for x in texts)], pa.binary())


@F.arrow_udf(T.ArrayType(T.BinaryType()))
def _digests(texts: pa.Array) -> pa.Array:
    out: list[list[bytes]] = [[]] * len(texts)
    for row, _, h in chunks(texts):
        out[row] = list(set(h))
    return pa.array(out, pa.list_(pa.binary()))


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[int, bytes]]:
    z = zstandard.ZstdDecompressor()
    for i, x in enumerate(batch.column("packed")):
        if x.is_valid:
            yield i, z.decompress(x.as_py())


def _encode_shared(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = Encoder(path)
        last = None
        for batch in batches:
            keys, wanted = batch.column("node"), batch.column("wanted")
            got: dict[bytes, bytes] = {}
            for i, data in _texts(batch):
                if keys[i].as_py() == last:
                    continue
                last = keys[i].as_py()
                want = set(wanted[i].as_py())
                for _, ends, h in chunks(pa.array([data.decode()])):
                    starts = np.concatenate(([0], ends[:-1])).tolist()
                    for s, e, x in zip(starts, ends.tolist(), h):
                        if x in want and x not in got:
                            got[x] = _packed(enc.plain(data[s:e]))
            yield pa.RecordBatch.from_arrays([pa.array(list(got), pa.binary()), pa.array(list(got.values()), pa.binary())], names=["digest", "tokens"])

    return run


def _assemble(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = Encoder(path)
        last, tokens, ok = None, None, None
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                keys, held = batch.column("node"), batch.column("held")
                flat, sizes, good, n = [], np.zeros(batch.num_rows, dtype=np.int64), [None] * batch.num_rows, batch.num_rows
                valid = np.zeros(n, dtype=bool)
                for i, data in _texts(batch):
                    if keys[i].as_py() != last:
                        last = keys[i].as_py()
                        shared = {d["digest"]: d["tokens"] for d in held[i].as_py() or ()}
                        ends, own = np.zeros(0, np.int64), {}
                        if shared:
                            for _, ends, h in chunks(pa.array([data.decode()])):
                                own = {j: _unpacked(shared[x]) for j, x in enumerate(h) if x in shared}
                        tokens = enc.encode(data, ends, own)
                        ok = enc.encoding.decode_bytes(tokens.tolist()) == data
                        if not ok:  # two chunks of one digest
                            tokens = enc.plain(data)
                            ok = enc.encoding.decode_bytes(tokens.tolist()) == data
                    flat.append(tokens)
                    sizes[i], good[i], valid[i] = len(tokens), ok, True
                values = pa.array(np.concatenate(flat) if flat else np.zeros(0, np.int32), pa.int32())
                ids = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32()), values, mask=pa.array(~valid))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), ids, pa.array(sizes, pa.int64(), mask=~valid), pa.array(good, pa.bool_())], names=["doc_id", "token_ids", "n_tokens", "round_trip"])

    return run


def encoded(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, token_ids, n_tokens, round_trip (whether the tokens decode to the text): a row for each row of docs."""
    # never null, as the planner can tell: both joins then share one exchange of the texts
    node = F.coalesce(F.unhex(F.coalesce(F.md5("text"), F.md5(F.lit("\0null")))), F.lit(b""))
    kind = dict(docs.dtypes)["doc_id"]
    held = cut(docs.select(node.alias("node"), F.explode(_digests("text")).alias("digest")))
    shared = held.groupBy("digest").agg(F.min("node").alias("owner"), F.max("node").alias("other")).where("owner <> other").select("digest", "owner")
    places = cut(held.join(shared, "digest").select("digest", "node", "owner").distinct())
    texts = docs.select("doc_id", node.alias("node"), _squeezed("text").alias("packed"))
    wanted = places.where("node = owner").groupBy("node").agg(F.collect_list("digest").alias("wanted"))
    once = texts.join(wanted, "node").select("doc_id", "node", "packed", "wanted").mapInArrow(_encode_shared(vocabulary), "digest binary, tokens binary")
    once = once.groupBy("digest").agg(F.any_value("tokens").alias("tokens"))
    owned = places.select("digest", "node").join(once, "digest").groupBy("node").agg(F.collect_list(F.struct("digest", "tokens")).alias("held"))
    return texts.join(owned, "node", "left").select("doc_id", "node", "packed", "held").mapInArrow(_assemble(vocabulary), f"doc_id {kind}, token_ids array<int>, n_tokens bigint, round_trip boolean")


def _decode(ids: pa.Array, path: str) -> pa.Array:
    enc = encoding(path)
    return pa.array([None if not x.is_valid else enc.decode_bytes(x.values.to_pylist()).decode("utf-8", "replace") for x in ids], pa.string())


def decoded(tokens: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id and text of rows with token_ids; null tokens give a null text."""

    @F.arrow_udf("string")
    def run(ids: pa.Array) -> pa.Array:
        return _decode(ids, vocabulary)

    return tokens.select("doc_id", run("token_ids").alias("text"))


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as tokens, each decoded again and compared."""
    return encoded(table(spark, sf_dir, "documents"))
