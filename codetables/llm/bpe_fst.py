"""Operator 9: byte-level BPE encoding and decoding by a lazily determinised finite-state transducer.

Encoding.  For a rank vocabulary whose tokens encode to themselves, the last token of every prefix of a
text is the one suffix token that is *compatible* with the last token of the prefix before it: the two
together encode to exactly these two.  So the transducer reads bytes and keeps, for those positions at
which a longer token may still begin, the last token and the position before it.  A state is this small
tree together with the longest suffix that begins a token; a transition moves every position back by one,
adds the new prefix, drops what no token can reach any more, and emits the tokens below the point in which
all remaining paths meet (the bounded lookahead).  A transition is determinised when it is asked for often and kept in a bounded
table, as in a lazy DFA; the first few times, a short pre-token follows the same paths without making states of them.

Whether two tokens are compatible is read from their merges: at their border, the last part of the first and
the first part of the second grow by merges of rising rank, and no merge of two such parts may come before.

Decoding.  Tokens become bytes; a UTF-8 state machine holds back the bytes of an unfinished character and
releases whole characters only, so a text can be decoded from a stream of ids that cut characters.
"""

from __future__ import annotations

import base64
import gc
import hashlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codetables.llm import chunks
from codetables.llm.common import batches_of, documents

#: Transitions, compatible pairs and pieces of text (twice: recent ones and those before) that a worker keeps before it begins anew.
TRANSITIONS, PAIRS, PIECES = 200_000, 600_000, 250_000
#: Bytes of a pre-token that may follow its paths without states, and how often a transition must be missing to be made.
SHORT, OFTEN = 64, 6


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def merge_by_rank(ranks: dict[bytes, int], piece: bytes) -> list[int]:
    """The definition: join the adjacent pair of lowest rank, leftmost first, until none is in the table."""
    none = 1 << 60
    parts = [piece[i : i + 1] for i in range(len(piece))]
    joined = [ranks.get(piece[i : i + 2], none) for i in range(len(piece) - 1)]
    while joined and (least := min(joined)) < none:
        at = joined.index(least)
        parts[at] += parts.pop(at + 1)
        joined.pop(at)
        if at:
            joined[at - 1] = ranks.get(parts[at - 1] + parts[at], none)
        if at < len(joined):
            joined[at] = ranks.get(parts[at] + parts[at + 1], none)
    return [ranks[p] for p in parts]


class Suffix:
    """A text that begins a token: what follows it by each byte, lengths and ranks of the tokens that end it, lengths at which a token may still begin."""

    __slots__ = ("live", "next", "text", "tokens")

    def __init__(self, text: bytes, tokens: tuple[tuple[int, int], ...], live: list[int]):
        self.text, self.tokens, self.live, self.next = text, tokens, live, {}


class Transducer:
    """encode(bytes) -> ids of one pre-token."""

    def __init__(self, ranks: dict[bytes, int], transitions: int = TRANSITIONS):
        self.ranks, self.limit = ranks, transitions
        self.bytes_of = {r: b for b, r in ranks.items()}
        self.prefixes = {b[:i] for b in ranks for i in range(len(b) + 1)}
        self.pairs: dict[int, bool] = {}
        self.parts: dict[int, tuple[bytes, bytes] | None] = {}
        self.borders: dict[tuple[int, int], list[tuple[bytes, int]] | None] = {}
        self.length = {r: len(b) for b, r in ranks.items()}
        self.root = Suffix(b"", (), [])
        self.suffixes: dict[bytes, Suffix] = {b"": self.root}  # at most one for each prefix of a token
        self._forget()

    def _forget(self) -> None:
        #: a state: (suffix, root, then position, token and position before it of each node); positions count back from here
        self.states: list[tuple] = []
        self.ids: dict[tuple, int] = {}
        #: state and byte -> next state, doubled, plus 1 if the transition emits something
        self.steps: dict[int, int] = {}
        self.missing: dict[int, int] = {}
        self.emitted: dict[int, tuple[int, ...]] = {}
        self.ends: dict[int, tuple[int, ...]] = {}
        self._state((self.root, 0))

    def _state(self, state: tuple) -> int:
        if (i := self.ids.get(state)) is None:
            i = self.ids[state] = len(self.states)
            self.states.append(state)
        return i

    def _border(self, token: int, side: int) -> list[tuple[bytes, int]] | None:
        """Parts of a token at its first (0) or last (1) byte, from that byte on, and the rank of the merge that ends each; the last is the token itself.

        None if these ranks don't rise, so that the order of merges can't be read from them.
        """
        if (token, side) not in self.borders:
            now, out, rank = self.bytes_of[token], [], 1 << 60
            while out is not None:
                out.append((now, rank))
                if len(now) == 1:
                    break
                r = self.ranks[now]
                if r not in self.parts:
                    self.parts[r] = self._halves(now)
                if self.parts[r] is None or r >= rank:
                    out = None
                else:
                    now, rank = self.parts[r][side], r
            self.borders[token, side] = out and out[::-1]
        return self.borders[token, side]

    def _halves(self, token: bytes) -> tuple[bytes, bytes] | None:
        """The two parts whose merge is the token."""
        rest = {k: v for k, v in ((token[i:j], self.ranks.get(token[i:j])) for i in range(len(token)) for j in range(i + 1, len(token) + 1)) if v is not None and k != token}
        ids = merge_by_rank(rest, token)
        return (self.bytes_of[ids[0]], self.bytes_of[ids[1]]) if len(ids) == 2 else None

    def _compatible(self, a: int, b: int) -> bool:
        if (got := self.pairs.get(a << 32 | b)) is None:
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            left, right = self._border(a, 1), self._border(b, 0)
            if left is None or right is None:
                got = merge_by_rank(self.ranks, self.bytes_of[a] + self.bytes_of[b]) == [a, b]
            else:
                got, i, j, get = True, 0, 0, self.ranks.get
                while True:
                    (x, grows), (y, grown) = left[i], right[j]
                    both = get(x + y)
                    # of equal ranks the leftmost merge comes first
                    if both is not None and both < grows and both <= grown:
                        got = False
                        break
                    if i == len(left) - 1 and j == len(right) - 1:
                        break
                    if grows <= grown:
                        i += 1
                    else:
                        j += 1
            self.pairs[a << 32 | b] = got
        return got

    def _suffix(self, at: Suffix, byte: int) -> Suffix:
        """The longest suffix of ``at`` and the byte that begins a token."""
        now = at.text + bytes([byte])
        while now not in self.prefixes:
            now = now[1:]
        if (got := self.suffixes.get(now)) is None:
            tokens = tuple((n, self.ranks[now[-n:]]) for n in range(len(now), 0, -1) if now[-n:] in self.ranks)
            got = self.suffixes[now] = Suffix(now, tokens, [n for n in range(1, len(now) + 1) if now[-n:] in self.prefixes])
        at.next[byte] = got
        return got

    def _follow(self, piece: bytes) -> list[int]:
        """The same paths without states: the last token of every prefix, then back from the end."""
        at, last, pairs = self.root, [0], self.pairs
        for i, byte in enumerate(piece, 1):
            at = at.next.get(byte) or self._suffix(at, byte)
            for n, token in at.tokens:
                if n == i:
                    break
                ok = pairs.get(last[-n] << 32 | token)
                if ok or ok is None and self._compatible(last[-n], token):
                    break
            else:
                raise ValueError("the vocabulary lacks a single byte or holds a token that doesn't encode to itself")
            last.append(token)
        out, i, length = [], len(piece), self.length
        while i:
            token = last[i]
            out.append(token)
            i -= length[token]
        return out[::-1]

    def _step(self, state: int, byte: int) -> int:
        """The transition's target and what it emits, determinised now."""
        suffix, root, *nodes = self.states[state]
        suffix = suffix.next.get(byte) or self._suffix(suffix, byte)
        tokens, live = suffix.tokens, suffix.live
        root += 1
        at = {nodes[k] + 1: (nodes[k + 1], nodes[k + 2] + 1) for k in range(0, len(nodes), 3)}
        for n, token in tokens:
            if n in at:
                if not self._compatible(at[n][0], token):
                    continue
            elif n != root:  # else the start of the text
                continue
            at[0] = (token, n)
            break
        else:
            raise ValueError("the vocabulary lacks a single byte or holds a token that doesn't encode to itself")
        front, after = {n for n in live if n in at or n == root}, [suffix, 0]
        front.add(0)
        while len(front) > 1:  # back from the latest position until all paths meet
            last = min(front)
            front.remove(last)
            token, before = at[last]
            front.add(before)
            after += (last, token, before)
        (meet,) = front
        out, p = [], meet
        while p != root:
            token, p = at[p]
            out.append(token)
        if meet in at:  # its token decides what is compatible, its own past no longer matters
            after += (meet, at[meet][0], meet)
        after[1] = meet
        key, step = state << 8 | byte, self._state(tuple(after)) * 2
        if out:
            self.emitted[key] = tuple(reversed(out))
            step += 1
        self.steps[key] = step
        return step

    def _end(self, state: int) -> tuple[int, ...]:
        _, root, *nodes = self.states[state]
        at, p, out = {nodes[k]: (nodes[k + 1], nodes[k + 2]) for k in range(0, len(nodes), 3)}, 0, []
        while p != root:
            token, p = at[p]
            out.append(token)
        return tuple(reversed(out))

    def encode(self, piece: bytes) -> list[int]:
        state, out, steps = 0, [], self.steps
        for byte in piece:
            key = state << 8 | byte
            step = steps.get(key)
            if step is None:
                if len(piece) <= SHORT and (times := self.missing.get(key, 1)) < OFTEN:
                    if len(self.missing) >= self.limit:
                        self.missing.clear()
                    self.missing[key] = times + 1
                    return self._follow(piece)
                if len(steps) >= self.limit:  # all but the state that this pre-token is in
                    now = self.states[state]
                    self._forget()
                    steps, state = self.steps, self._state(now)
                    key = state << 8 | byte
                step = self._step(state, byte)
            state = step >> 1
            if step & 1:
                out += self.emitted[key]
        end = self.ends.get(state)
        if end is None:
            end = self.ends[state] = self._end(state)
        out += end
        return out


class Decoder:
    """Streaming decoder: ``feed`` gives the bytes of whole characters so far, ``close`` what is left over."""

    def __init__(self, bytes_of: dict[int, bytes]):
        self.bytes_of, self.held = bytes_of, b""
        self.whole = {i: b for i, b in bytes_of.items() if self._unfinished(b) == 0 and b[0] & 0xC0 != 0x80}

    @staticmethod
    def _unfinished(data: bytes) -> int:
        """How many bytes at the end begin a character that isn't complete."""
        for back in range(1, min(4, len(data)) + 1):
            lead = data[-back]
            if lead & 0xC0 != 0x80:
                need = 4 if lead >= 0xF0 else 3 if lead >= 0xE0 else 2 if lead >= 0xC0 else 1
                return back if need > back else 0
        return 0

    def feed(self, ids: list[int]) -> bytes:
        if not self.held:
            try:
                return b"".join(map(self.whole.__getitem__, ids))  # no token here cuts a character
            except KeyError:
                pass
        data = self.held + b"".join(map(self.bytes_of.__getitem__, ids))
        cut = len(data) - self._unfinished(data)
        self.held = data[cut:]
        return data[:cut]

    def close(self) -> bytes:
        left, self.held = self.held, b""
        return left


class Encoder:
    """Whole texts to ids: the pattern cuts pre-tokens, the transducer encodes each distinct one once."""

    def __init__(self, path: str, pattern: str, pieces: int = PIECES):
        import regex

        self.ranks = read_ranks(path)
        self.transducer = Transducer(self.ranks)
        self.decoder = Decoder(self.transducer.bytes_of)
        self.pattern, self.limit = regex.compile(pattern), pieces
        self.recent: dict[str, tuple[bytes, bytes]] = {}  # of pieces of text: their ids as 32-bit bytes, and as decimal numbers
        self.before: dict[str, tuple[bytes, bytes]] = {}
        gc.set_threshold(200_000, 20, 100)  # the tables hold no cycles, and grow by many small objects

    def _pretoken(self, text: str) -> list[int]:
        data = text.encode("utf-8")
        whole = self.ranks.get(data)
        return self.transducer.encode(data) if whole is None else [whole]

    def _piece(self, piece: str) -> tuple[bytes, bytes]:
        if chunks.PLAIN.fullmatch(piece):
            ids = self._pretoken(piece)
        else:
            ids = [i for part in self.pattern.findall(piece) for i in self._pretoken(part)]
        return array("I", ids).tobytes(), " ".join(map(str, ids)).encode()

    def encode(self, text: str) -> tuple[bytes, bytes]:
        """ids as 32-bit bytes, and as decimal numbers joined by one space."""
        if chunks.ODD_SPACE.search(text):
            return self._piece(text)
        pieces = chunks.PIECES.findall(text)
        recent, before = self.recent, self.before
        for x in set(pieces).difference(recent):
            recent[x] = before.get(x) or self._piece(x)
        both = list(map(recent.__getitem__, pieces))
        if len(recent) > self.limit:  # what the next texts ask for again comes back from ``before``
            self.before, self.recent = recent, {}
        return b"".join([x for x, _ in both]), b" ".join([y for _, y in both])


_ENCODERS: dict[tuple[str, str], Encoder] = {}


def encoder(path: str, pattern: str) -> Encoder:
    if (path, pattern) not in _ENCODERS:
        _ENCODERS[path, pattern] = Encoder(path, pattern)
    return _ENCODERS[path, pattern]


def encode_texts(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids BINARY (32-bit little-endian), decimal BINARY: one row per row of ``df``, no shuffle.

    A null text counts as empty and gives no ids.  Repeated rows and null ids stay as they are; other
    columns are left out, so their names can't clash.
    """

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path, pattern)

        def make(batch: pa.RecordBatch) -> pa.RecordBatch:
            got = [bpe.encode(t or "") for t in batch.column(1).to_pylist()]
            return pa.record_batch([batch.column(0), pa.array([a for a, _ in got], pa.binary()), pa.array([b for _, b in got], pa.binary())], ["doc_id", "ids", "decimal"])

        return batches_of(rows, make)

    return _small(df, id_col, text_col).mapInArrow(run, "doc_id long, ids binary, decimal binary")


def _small(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def decode_ids(df: DataFrame, path: str, pattern: str, piece: int = 1 << 16) -> DataFrame:
    """doc_id, decoded BINARY from columns doc_id and ids (as encode_texts gives them), streamed by pieces of ids."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path, pattern)
        return batches_of(rows, lambda b: pa.record_batch([b.column(0), pa.array([decode(bpe.decoder, x or b"", piece) for x in b.column(1).to_pylist()], pa.binary())], ["doc_id", "decoded"]))

    return df.select("doc_id", "ids").mapInArrow(run, "doc_id long, decoded binary")


def decode(decoder: Decoder, ids: bytes, piece: int = 1 << 16) -> bytes:
    ids = np.frombuffer(ids, dtype="<u4")
    out = [decoder.feed(ids[i : i + piece].tolist()) for i in range(0, len(ids), piece)]
    return b"".join([*out, decoder.close()])


def digests(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each whole text, encoded and decoded in one pass."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(path, pattern)

        def make(batch: pa.RecordBatch) -> pa.RecordBatch:
            n, a, b = [], [], []
            for text in batch.column(1).to_pylist():
                ids, decimal = bpe.encode(text or "")
                n.append(len(ids) // 4)
                a.append(hashlib.sha256(decimal).hexdigest())
                b.append(hashlib.sha256(decode(bpe.decoder, ids)).hexdigest())
            return pa.record_batch([batch.column(0), pa.array(n, pa.int64()), pa.array(a), pa.array(b)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

        return batches_of(rows, make)

    return _small(df, id_col, text_col).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digests(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
