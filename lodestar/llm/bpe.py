"""Byte-level BPE by a lazily determinised finite-state transducer, and streaming decoding.

A sequence of tokens is the BPE encoding of its bytes if and only if each pair
of neighbours is stable, that is, BPE applied to the bytes of both gives these
two again. So the merges compile into a nondeterministic transducer: a state
is (last token, node in the trie of the vocabulary), a byte moves to a child,
and where a child is a token that is stable after the last one, the machine may
end it there. For each prefix exactly one way has just ended a token.

The transducer is determinised as texts need it: a deterministic state is the
set of ways that are still open, each with the tokens it has not yet emitted.
What all open ways share is emitted at once, so the output lags behind the
input by no more than the longest token. States and transitions are kept up to
a limit and then built anew, which bounds memory and changes no result.
"""

from __future__ import annotations

import base64
import contextlib
import re
from array import array
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship_package
from ..workspace import spread

STATE_LIMIT = 300_000
PIECE_LIMIT = 300_000
_NEVER = 1 << 60
#: Letters of texts that the faster of two regular expression engines can split the same way.
_PLAIN_LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
#: Tokens decoded at once, and rows whose ids a worker holds at once.
DECODE_CHUNK, ROWS = 4096, 256


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks from lines of a base64 token and its rank."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


class BpeTransducer:
    """Encoder of single pieces: what the splitting pattern matches."""

    def __init__(self, ranks: dict[bytes, int], state_limit: int = STATE_LIMIT) -> None:
        missing = [b for b in range(256) if bytes([b]) not in ranks]
        if missing:
            raise ValueError(f"{len(missing)} single bytes have no token")
        self.ranks, self.state_limit = ranks, state_limit
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.child: dict[int, int] = {}
        self.ends: list[int] = [-1]
        self.inner: list[bool] = [True]
        for token, rank in ranks.items():
            node = 0
            for b in token:
                self.inner[node] = True
                key = node << 8 | b
                if key not in self.child:
                    self.child[key] = len(self.ends)
                    self.ends.append(-1)
                    self.inner.append(False)
                node = self.child[key]
            self.ends[node] = rank
        self._histories: dict[int, tuple[bool, list[tuple[int, bytes, bytes]]]] = {}
        self._reset()

    def _reset(self) -> None:
        start = self._pack([(-1, 0, ())])
        self._id = {start: 0}
        self._ways = [start]
        self._step: dict[int, int] = {}
        self._emits: list[tuple[int, tuple[int, ...]]] = []

    @staticmethod
    def _pack(ways: list[tuple[int, int, tuple[int, ...]]]) -> bytes:
        """Open ways as bytes, a tenth of what tuples take: last, node, number of tokens held back, these tokens."""
        return array("i", [x for last, node, out in ways for x in (last, node, len(out), *out)]).tobytes()

    @staticmethod
    def _unpack(packed: bytes) -> Iterator[tuple[int, int, tuple[int, ...]]]:
        flat, i = array("i", packed), 0
        while i < len(flat):
            n = flat[i + 2]
            yield flat[i], flat[i + 1], tuple(flat[i + 3 : i + 3 + n])
            i += 3 + n

    def _history(self, token: int) -> tuple[bool, list[tuple[int, bytes, bytes]]]:
        """Whether merging the token's bytes gives it back, and after each merge its rank and the first and last part."""
        known = self._histories.get(token)
        if known is None:
            parts, ranks, steps = [bytes([b]) for b in self.tokens[token]], self.ranks, []
            steps.append((-1, parts[0], parts[-1]))
            while len(parts) > 1:
                rank, at = min((ranks.get(parts[i] + parts[i + 1], _NEVER), i) for i in range(len(parts) - 1))
                if rank == _NEVER:
                    break
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
                steps.append((rank, parts[0], parts[-1]))
            known = self._histories[token] = (len(parts) == 1, steps)
        return known

    def stable(self, last: int, token: int) -> bool:
        """Whether ``token`` can follow ``last``, or stand at the start (last = -1).

        Both merge on their own, the lesser rank first, unless the parts that
        meet at the border merge before that: then it can't.
        """
        alone, right = self._history(token)
        if last < 0 or not alone:
            return alone
        alone, left = self._history(last)
        i, j, get = 0, 0, self.ranks.get
        while True:
            across = get(left[i][2] + right[j][1], _NEVER)
            next_left = left[i + 1][0] if i + 1 < len(left) else _NEVER
            next_right = right[j + 1][0] if j + 1 < len(right) else _NEVER
            if across < next_left and across <= next_right and across != _NEVER:
                return False
            if next_left <= next_right:
                if next_left == _NEVER:
                    return alone
                i += 1
            else:
                j += 1

    def _advance(self, state: int, byte: int) -> int:
        """The transition, determinised now and kept: the next state, or ~i where entry i of ``_emits`` has it and the tokens emitted."""
        ways = []
        for last, node, out in self._unpack(self._ways[state]):
            to = self.child.get(node << 8 | byte)
            if to is None:
                continue
            if self.inner[to]:
                ways.append((last, to, out))
            token = self.ends[to]
            if token >= 0 and self.stable(last, token):
                ways.append((token, 0, (*out, token)))
        shared, outs = 0, [w[2] for w in ways]
        shortest = min(map(len, outs))
        while shared < shortest and all(o[shared] == outs[0][shared] for o in outs):
            shared += 1
        key = self._pack(sorted((last, node, out[shared:]) for last, node, out in ways))
        to = self._id.setdefault(key, len(self._ways))
        if to == len(self._ways):
            self._ways.append(key)
        if shared:
            self._emits.append((to, outs[0][:shared]))
            to = ~(len(self._emits) - 1)
        self._step[state << 8 | byte] = to
        return to

    def encode(self, piece: bytes) -> list[int]:
        if len(self._ways) > self.state_limit:
            self._reset()
        whole = self.ranks.get(piece)
        if whole is not None:  # as tiktoken has it, also for tokens that merges don't reach
            return [whole]
        state, out, steps, emits = 0, [], self._step, self._emits
        for byte in piece:
            to = steps.get(state << 8 | byte)
            if to is None:
                if len(self._ways) > self.state_limit:  # within a long piece
                    packed = self._ways[state]
                    self._reset()
                    state, steps, emits = self._id.setdefault(packed, len(self._ways)), self._step, self._emits
                    if state == len(self._ways):
                        self._ways.append(packed)
                to = self._advance(state, byte)
            if to >= 0:
                state = to
            else:
                state, tokens = emits[~to]
                out += tokens
        out += next(rest for _, node, rest in self._unpack(self._ways[state]) if node == 0)
        return out


class BpeCodec:
    """Whole texts to ids and back."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.transducer = BpeTransducer(ranks)
        self.pattern = regex.compile(pattern)
        # where a text has no other letters, digits or blanks than these, \p{L} and \p{N} are plain classes
        plain = pattern.replace(r"\p{L}+", f"[{_PLAIN_LETTERS}]+").replace(r"\p{N}+", "[0-9]+").replace(r"\p{L}", _PLAIN_LETTERS).replace(r"\p{N}", "0-9")
        self.plain = None if r"\p" in plain else re.compile(plain)
        self.is_plain = re.compile(f"[ -~\t\n{_PLAIN_LETTERS}]*").fullmatch
        self.decoder = Decoder(self.transducer.tokens)
        self._pieces: dict[str, bytes] = {}
        self._older: dict[str, bytes] = {}

    def _missing(self, piece: str) -> bytes:
        """Ids of a piece, as the bytes of 32-bit integers, that the pieces in use lately don't have."""
        ids = self._pieces.get(piece)  # it may have come up before in the same text
        if ids is not None:
            return ids
        ids = self._older.get(piece)
        if ids is None:
            ids = array("i", self.transducer.encode(piece.encode())).tobytes()
        if len(piece) <= 64:
            if len(self._pieces) >= PIECE_LIMIT:
                self._older, self._pieces = self._pieces, {}
            self._pieces[piece] = ids
        return ids

    def encode_array(self, text: str | None) -> np.ndarray:
        """Token ids of the whole text; none for null and for the empty text."""
        text, out = text or "", []
        pattern = self.plain if self.plain and self.is_plain(text) else self.pattern
        for pieces in [pattern.findall(text)] if len(text) < 1 << 20 else _some(m.group() for m in pattern.finditer(text)):
            ids, at = list(map(self._pieces.get, pieces)), 0
            with contextlib.suppress(ValueError):  # until no more is missing
                while True:
                    at = ids.index(None, at)
                    ids[at] = self._missing(pieces[at])
            out += ids
        return np.frombuffer(b"".join(out), np.int32)

    def encode(self, text: str | None) -> list[int]:
        return self.encode_array(text).tolist()

    def decode(self, ids: Iterable[int]) -> str:
        return "".join(self.decoder.stream(ids))


def _some(items: Iterator[str], n: int = 1 << 16) -> Iterator[list[str]]:
    while some := list(islice(items, n)):
        yield some


#: Continuation bytes that are still to come after a lead byte; -1 where none can lead.
_NEED = [0] * 0x80 + [-1] * 0x42 + [1] * 0x1E + [2] * 0x10 + [3] * 0x05 + [-1] * 0x0B


class Utf8Stream:
    """Incremental UTF-8: takes bytes cut anywhere and gives the characters that are complete.

    A state machine whose state is the number of bytes that the last character
    still needs. Within ``data`` it need only run from the last byte that can
    lead a character; all before that is complete. What is not UTF-8 becomes U+FFFD.
    """

    def __init__(self) -> None:
        self.pending, self.need = b"", 0

    def _run(self, data: bytes) -> int:
        """Where the character begins that ``data`` does not complete, or its length; sets the state."""
        start = next((i for i in range(len(data) - 1, max(-1, len(data) - 4), -1) if data[i] & 0xC0 != 0x80), len(data))
        self.need = 0
        for byte in data[start:]:
            self.need = self.need - 1 if self.need else max(0, _NEED[byte])
        return start if self.need else len(data)

    def feed(self, data: bytes) -> str:
        data = self.pending + data
        cut = self._run(data)
        self.pending = data[cut:]
        return data[:cut].decode("utf-8", "replace")

    def finish(self) -> str:
        rest, self.pending, self.need = self.pending, b"", 0
        return rest.decode("utf-8", "replace")


class Decoder:
    """All tokens' bytes in one array, from which the bytes of ids are gathered."""

    def __init__(self, tokens: dict[int, bytes]) -> None:
        size = max(tokens) + 1
        self.lengths = np.array([len(tokens.get(i, b"")) for i in range(size)], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.data = np.frombuffer(b"".join(tokens.get(i, b"") for i in range(size)), np.uint8)

    def stream(self, ids: Iterable[int]) -> Iterator[str]:
        """Text of the ids, as soon as characters are complete."""
        ids, stream = ids if isinstance(ids, np.ndarray) else np.fromiter(ids, np.int64), Utf8Stream()
        for i in range(0, len(ids), DECODE_CHUNK):
            some = ids[i : i + DECODE_CHUNK]
            n = self.lengths[some]
            ends = np.cumsum(n)
            yield stream.feed(self.data[np.repeat(self.starts[some] - ends + n, n) + np.arange(ends[-1])].tobytes())
        yield stream.finish()


_codecs: dict[tuple[int, str], BpeCodec] = {}


def _codec(shared, pattern: str) -> BpeCodec:
    """One for each Python worker: what it has determinised serves all its tasks."""
    key = (shared.id if hasattr(shared, "id") else id(shared), pattern)
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = BpeCodec(shared.value, pattern)
    return _codecs[key]


def bpe_encode(docs: DataFrame, ranks_path: str, pattern: str, decode: bool = False) -> DataFrame:
    """(doc_id, ids array<int>) of each row of ``docs`` (doc_id, text; other columns are ignored).

    Whole texts; null and empty texts have no ids. Null ids and repeated rows
    come back as they are, and an empty table gives an empty result. With ``decode`` also what
    the ids decode to, by the same worker, as decoded. The vocabulary is read
    on the driver and broadcast: its size is that of the file, whatever the input.
    """
    ship_package(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))
    names = ["doc_id", "ids", *(["decoded"] if decode else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared, pattern)
        for whole in batches:
            for start in range(0, whole.num_rows, ROWS):
                batch = whole.slice(start, ROWS)
                flat, ends, texts = [], [0], []
                for text in batch.column(1):
                    ids = codec.encode_array(text.as_py())
                    flat.append(ids)
                    ends.append(ends[-1] + len(ids))
                    if decode:
                        texts.append(codec.decode(ids))
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(flat), pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(0), lists, *([pa.array(texts, pa.string())] if decode else [])], names)

    schema = f"doc_id {dict(docs.dtypes)['doc_id']}, ids array<int>" + ", decoded string" * decode
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def bpe_decode(encoded: DataFrame, ranks_path: str) -> DataFrame:
    """(doc_id, ids, decoded string) of each row of ``encoded`` (doc_id, ids); null ids decode to the empty text."""
    ship_package(encoded.sparkSession)
    shared = encoded.sparkSession.sparkContext.broadcast(Decoder({rank: token for token, rank in read_ranks(ranks_path).items()}))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream = shared.value.stream
        for whole in batches:
            for start in range(0, whole.num_rows, ROWS):
                batch = whole.slice(start, ROWS)
                texts = ["".join(stream(ids.values.to_numpy() if ids.is_valid else ())) for ids in batch.column(1)]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["doc_id", "ids", "decoded"])

    kind = dict(encoded.dtypes)["doc_id"]
    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, ids array<int>, decoded string")


def digests(decoded: DataFrame, keep_ids: bool = False) -> DataFrame:
    """What op3 returns for (doc_id, ids, decoded), with the ids themselves if wanted."""
    return decoded.select(
        "doc_id",
        *(["ids"] if keep_ids else []),
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the ids of each row of ``documents`` and of what they decode to; null texts are as empty ones, for the rest see ``bpe_encode``."""
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return digests(bpe_encode(docs, path, public_tokenizers.PATTERN, decode=True))
