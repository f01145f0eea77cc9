"""Byte-level BPE encoding and decoding with a lazily determinised transducer.

A token sequence is the BPE encoding of its bytes exactly if every two neighbours stay apart, that is, if
no merge crosses their border (``Merges.apart``).  So a nondeterministic transducer that reads bytes along the
vocabulary's trie and starts a new token only after a neighbour from which it stays apart has one accepting run
per text.  ``Transducer`` determinises it as it reads: a state is the set of live runs with the tokens that they
have not agreed on yet, and what all runs agree on is emitted.  No run is longer than the longest token, so the
lookahead is bounded.  All distinct pieces of a slice of texts are read at once, byte by byte, so that states, moves
and merges are looked up and made in arrays.  Decoding steps an incremental UTF-8 state machine (``Utf8Machine``) by tokens,
whose effect on each of its states is tabulated, and by bytes where the ids are no well-formed text.
"""

from __future__ import annotations

import base64
import hashlib
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import arrow_map, by_size, mix, texts_of

FAR = 1 << 30
#: Bytes from which a piece is read alone: few are as long, and each step over all pieces costs as much as over one.
LONG_PIECE = 256


class Table:
    """A hash table of distinct integer keys to integers, by open addressing over arrays."""

    def __init__(self, bits: int = 12):
        self.bits, self.size = bits, 0
        self.keys, self.values = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, np.int64)

    def slot(self, keys: np.ndarray) -> np.ndarray:
        return (mix(keys.astype(np.uint64)) & np.uint64((1 << self.bits) - 1)).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """The values of keys, -1 where there is none."""
        out, open_, slot = np.full(len(keys), -1, np.int64), np.arange(len(keys)), self.slot(keys)
        while len(open_):
            found = self.keys[slot]
            hit = found == keys[open_]
            out[open_[hit]] = self.values[slot[hit]]
            on = ~hit & (found != -1)
            open_, slot = open_[on], (slot[on] + 1) & (1 << self.bits) - 1
        return out

    def put(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Adds distinct keys that are not in the table."""
        if 2 * (self.size + len(keys)) > 1 << self.bits:
            used = self.keys != -1
            keys, values = np.concatenate([self.keys[used], keys]), np.concatenate([self.values[used], values])
            self.__init__(max(self.bits + 1, int(4 * len(keys)).bit_length()))
        self.size += len(keys)
        slot = self.slot(keys)
        while len(keys):
            free = self.keys[slot] == -1
            self.keys[slot[free]] = keys[free]  # of those that meet in a slot one stays
            in_ = free & (self.keys[slot] == keys)
            self.values[slot[in_]] = values[in_]
            keys, values, slot = keys[~in_], values[~in_], (slot[~in_] + 1) & (1 << self.bits) - 1


class Rows:
    """Integer arrays that grow together at the end."""

    def __init__(self, *names: str):
        self.names, self.rows = names, 0
        for name in names:
            setattr(self, name, np.empty(1024, np.int64))

    def add(self, *columns: np.ndarray) -> None:
        end = self.rows + len(columns[0])
        for name, column in zip(self.names, columns, strict=True):
            held = getattr(self, name)
            if end > len(held):
                held = np.concatenate([held[: self.rows], np.empty(2 * end - self.rows, np.int64)])
                setattr(self, name, held)
            held[self.rows : end] = column
        self.rows = end


def spread(start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(owner, place) of all elements of ranges that begin at start."""
    owner = np.repeat(np.arange(len(start)), length)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(length) - length, length) + np.repeat(start, length)


class Merges:
    """Ranks of a vocabulary, and whether two tokens stay apart."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.pairs = Table()
        halves = {a << 32 | b: r for t, r in ranks.items() for k in range(1, len(t)) if (a := ranks.get(t[:k])) is not None and (b := ranks.get(t[k:])) is not None}
        self.pairs.put(np.array(list(halves), np.int64), np.array(list(halves.values()), np.int64))
        lefts: dict[bytes, list[int]] = {}
        rights: dict[bytes, list[int]] = {}
        for token in sorted(ranks, key=len):
            a, b = self.split(token) if len(token) > 1 else (b"", b"")
            lefts[token], rights[token] = lefts.get(a, []) + [ranks[token]], rights.get(b, []) + [ranks[token]]
        self.starts, self.ends = self.padded(lefts), self.padded(rights)

    def padded(self, spines: dict[bytes, list[int]]) -> np.ndarray:
        """By token: what begins (or ends) it while it is merged, from a byte up to itself; FAR behind."""
        out = np.full((max(self.ranks.values()) + 1, max(map(len, spines.values())) + 1), FAR, np.int64)
        for token, spine in spines.items():
            out[self.ranks[token], : len(spine)] = spine
        return out

    def split(self, token: bytes) -> tuple[bytes, bytes]:
        """The two parts that the last merge of a token joins."""
        parts, limit, ranks = [token[i : i + 1] for i in range(len(token))], self.ranks[token], self.ranks
        while len(parts) > 2:
            best, at = limit, -1
            for i in range(len(parts) - 1):
                r = ranks.get(parts[i] + parts[i + 1], FAR)
                if r < best:
                    best, at = r, i
            if at < 0:
                raise ValueError(f"not reachable by merges: {token!r}")
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts[0], parts[1]

    def apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Where the encoding of two tokens in a row is these two: both borders' merges in time, none across comes first."""
        out, open_, i, j = np.ones(len(a), bool), np.arange(len(a)), np.zeros(len(a), np.int64), np.zeros(len(a), np.int64)
        while len(open_):
            ends, starts = self.ends[a[open_]], self.starts[b[open_]]
            k = np.arange(len(open_))
            up, down = ends[k, i + 1], starts[k, j + 1]
            cross = self.pairs.get(ends[k, i] << 32 | starts[k, j])
            cross = np.where(cross < 0, FAR, cross)
            joined = (cross < up) & (cross <= down) & (cross < FAR)  # equal ranks merge from the left
            out[open_[joined]] = False
            on = ~joined & ((up < FAR) | (down < FAR))
            first = (up <= down)[on]
            open_, i, j = open_[on], i[on] + first, j[on] + ~first
        return out


class Transducer:
    """Deterministic states are made when first reached, for all pieces that wait for one at the same time.

    A run is (previous token, node of the open token, tokens not emitted yet); the runs of a state stand in the order in
    which their open tokens begin, so the last one has none open and holds the encoding of what was read.  States are known
    by 64-bit hashes of their runs.  Beyond max_states all are forgotten, so memory is bounded.
    """

    def __init__(self, merges: Merges, max_states: int = 1 << 18, chunk: int = 1 << 18):
        self.merges, self.max_states, self.chunk = merges, max_states, chunk
        children: dict[int, int] = {}  # node << 8 | byte -> node; the root is 0
        token, inner = [-1], [True]
        for t, rank in merges.ranks.items():
            node = 0
            for byte in t:
                inner[node] = True
                if (child := children.get(node << 8 | byte)) is None:
                    child = children[node << 8 | byte] = len(token)
                    token.append(-1)
                    inner.append(False)
                node = child
            token[node] = rank
        self.children = Table()
        self.children.put(np.array(list(children), np.int64), np.array(list(children.values()), np.int64))
        self.token, self.inner = np.array(token, np.int64), np.array(inner)
        self.reset()

    def reset(self) -> None:
        self.states, self.moves, self.apart = Table(), Table(), Table()
        self.state, self.run, self.waiting = Rows("run", "runs"), Rows("previous", "node", "at", "n"), Rows("token")
        self.move, self.emitted = Rows("to", "at", "n"), Rows("token")
        self.known: dict[int, tuple[int, list[int]]] = {}  # moves of pieces that are read alone
        one = np.zeros(1, np.int64)
        self.intern(one, one - 1, one, np.zeros((1, 0), np.int64), one)

    def intern(self, owner: np.ndarray, previous: np.ndarray, node: np.ndarray, rest: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Numbers of the states whose runs have the owners 0, 1, ... in a row; rest has n tokens a row."""
        h = mix((previous + 2).astype(np.uint64) << np.uint64(32) | node.astype(np.uint64), 1)
        for k in range(rest.shape[1]):
            h = np.where(n > k, mix(h + (rest[:, k] + 1).astype(np.uint64), 2), h)
        first = np.flatnonzero(np.diff(owner, prepend=-1))
        runs = np.diff(np.append(first, len(owner)))
        with np.errstate(over="ignore"):
            place = (np.arange(len(owner)) - np.repeat(first, runs)).astype(np.uint64)
            key = (np.add.reduceat(mix(h + place * np.uint64(0x9E3779B97F4A7C15), 3), first) >> np.uint64(1)).astype(np.int64)
        found = self.states.get(key)
        new, at = np.unique(np.where(found < 0, key, -1), return_index=True)
        at = at[new >= 0]
        if len(at):
            self.states.put(key[at], self.state.rows + np.arange(len(at)))
            _, r = spread(first[at], runs[at])
            of, k = spread(np.zeros(len(r), np.int64), n[r])
            self.state.add(self.run.rows + np.cumsum(runs[at]) - runs[at], runs[at])
            self.run.add(previous[r], node[r], self.waiting.rows + np.cumsum(n[r]) - n[r], n[r])
            self.waiting.add(rest[r[of], k])
            found = self.states.get(key)
        return found

    def stay_apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        pairs, back = np.unique(a << 32 | b, return_inverse=True)
        found = self.apart.get(pairs)
        new = pairs[found < 0]
        if len(new):
            self.apart.put(new, self.merges.apart(new >> 32, new & 0xFFFFFFFF).astype(np.int64))
            found = self.apart.get(pairs)
        return found[back] == 1

    def build(self, keys: np.ndarray) -> None:
        """The moves of distinct keys, state << 8 | byte."""
        k, byte = keys >> 8, keys & 255
        owner, r = spread(self.state.run[k], self.state.runs[k])
        child = self.children.get(self.run.node[r] << 8 | byte[owner])
        owner, r, child = owner[child >= 0], r[child >= 0], child[child >= 0]
        previous, t = self.run.previous[r], self.token[child]
        ends = t >= 0
        inside = ends & (previous >= 0)
        ends[inside] = self.stay_apart(previous[inside], t[inside])
        on = self.inner[child]
        # The runs that go on, then the one that ends a token here.
        at = np.concatenate([np.flatnonzero(on), np.flatnonzero(ends)])
        fresh = np.arange(len(at)) >= on.sum()
        order = np.lexsort((fresh, owner[at]))
        at, fresh = at[order], fresh[order]
        owner, r = owner[at], r[at]
        previous, node = np.where(fresh, t[at], previous[at]), np.where(fresh, 0, child[at])
        n = self.run.n[r]
        rest = np.full((len(at), int(n.max()) + 1), -1, np.int64)
        of, place = spread(np.zeros(len(at), np.int64), n)
        rest[of, place] = self.waiting.token[np.repeat(self.run.at[r], n) + place]
        rest[np.flatnonzero(fresh), n[fresh]] = t[at][fresh]
        n = n + fresh
        # What all runs of a state agree on is emitted.
        first = np.flatnonzero(np.diff(owner, prepend=-1))
        model = np.repeat(rest[first], np.diff(np.append(first, len(owner))), axis=0)
        same = np.logical_and.reduceat((rest == model) & (rest >= 0), first, axis=0)
        agreed = np.logical_and.accumulate(same, axis=1).sum(1)
        of, place = spread(np.zeros(len(first), np.int64), agreed)
        tokens = rest[first[of], place]
        shift = agreed[owner]
        n = n - shift
        of, place = spread(np.zeros(len(owner), np.int64), n)
        left = np.full((len(owner), int(n.max())), -1, np.int64)
        left[of, place] = rest[of, place + shift[of]]
        to = self.intern(owner, previous, node, left, n)
        self.moves.put(keys, self.move.rows + np.arange(len(keys)))
        self.move.add(to, self.emitted.rows + np.cumsum(agreed) - agreed, agreed)
        self.emitted.add(tokens)

    def rest(self, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Place in waiting and number of the tokens of the run that has no token open."""
        last = self.state.run[k] + self.state.runs[k] - 1
        return self.run.at[last], self.run.n[last]

    def encode(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of all pieces in a row, and how many each piece has."""
        out, counts, at, long = [], np.zeros(len(pieces), np.int64), 0, {}
        lengths = list(map(len, pieces))
        while at < len(pieces):
            end, total = at, 0
            while end < len(pieces) and (end == at or total < self.chunk):
                if lengths[end] <= LONG_PIECE:
                    total += lengths[end]
                else:
                    long[end] = np.array(self.encode_alone(pieces[end]), np.int64)
                end += 1
            part = [b"" if k in long else pieces[k] for k in range(at, end)]
            tokens, counts[at:end] = self.encode_together(part)
            out.append(tokens)
            at = end
        tokens = np.concatenate(out) if out else np.empty(0, np.int64)
        if long:
            parts = np.split(tokens, np.cumsum(counts)[:-1])
            for k, x in long.items():
                parts[k], counts[k] = x, len(x)
            tokens = np.concatenate(parts)
        return tokens, counts

    def encode_together(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Byte by byte over all pieces at once."""
        if self.state.rows > self.max_states:
            self.reset()
        length = np.fromiter(map(len, pieces), np.int64, len(pieces))
        order = np.argsort(-length, kind="stable")
        start = (np.cumsum(length) - length)[order]
        data = np.frombuffer(b"".join(pieces), np.uint8).astype(np.int64)
        state, steps = np.zeros(len(pieces), np.int64), []
        for k in range(int(length.max(initial=0))):
            on = int(np.searchsorted(-length[order], -k))
            key = state[:on] << 8 | data[start[:on] + k]
            found = self.moves.get(key)
            if (found < 0).any():
                self.build(np.unique(key[found < 0]))
                found = self.moves.get(key)
            state[:on] = self.move.to[found]
            steps.append(found)
        at, n = self.rest(state)
        counts = n.copy()
        for found in steps:
            counts[: len(found)] += self.move.n[found]
        back = np.empty(len(pieces), np.int64)
        back[order] = np.arange(len(pieces))
        place = (np.cumsum(counts[back]) - counts[back])[order]
        out = np.empty(int(counts.sum()), np.int64)
        for found in steps:
            owner, k = spread(self.move.at[found], self.move.n[found])
            _, to = spread(place[: len(found)], self.move.n[found])
            out[to] = self.emitted.token[k]
            place[: len(found)] += self.move.n[found]
        owner, k = spread(at, n)
        _, to = spread(place, n)
        out[to] = self.waiting.token[k]
        return out, counts[back]

    def encode_alone(self, piece: bytes) -> list[int]:
        """One long piece; its states are forgotten, but for the current one, at the same limit."""
        out: list[int] = []
        k = 0
        for byte in piece:
            if (found := self.known.get(k << 8 | byte)) is None:
                if self.state.rows > self.max_states:
                    k = self.restart(k)
                key = np.array([k << 8 | byte], np.int64)
                if (at := int(self.moves.get(key)[0])) < 0:
                    self.build(key)
                    at = int(self.moves.get(key)[0])
                a, n = int(self.move.at[at]), int(self.move.n[at])
                found = self.known[k << 8 | byte] = (int(self.move.to[at]), self.emitted.token[a : a + n].tolist())
            k, emitted = found
            out += emitted
        (at,), (n,) = self.rest(np.array([k]))
        return out + self.waiting.token[at : at + n].tolist()

    def restart(self, k: int) -> int:
        """Forgets all states but this one; its new number."""
        _, r = spread(self.state.run[[k]], self.state.runs[[k]])
        previous, node, at, n = (getattr(self.run, c)[r] for c in self.run.names)
        rest = np.full((len(r), int(n.max())), -1, np.int64)
        of, place = spread(np.zeros(len(r), np.int64), n)
        rest[of, place] = self.waiting.token[at[of] + place]
        self.reset()
        return int(self.intern(np.zeros(len(r), np.int64), previous, node, rest, n)[0])


class Utf8Machine:
    """Incremental UTF-8: bytes in, code points out; a malformed sequence gives one U+FFFD, as Unicode recommends.

    The states say what may follow: 0 a first byte; 1, 2, 3 so many bytes 80-BF; 4 A0-BF and one more (after E0);
    5 80-9F and one more (ED); 6 90-BF and two more (F0); 7 80-8F and two more (F4).
    """

    FIRST = ((0x00, 0x7F, 0), (0xC2, 0xDF, 1), (0xE0, 0xE0, 4), (0xE1, 0xEC, 2), (0xED, 0xED, 5), (0xEE, 0xEF, 2), (0xF0, 0xF0, 6), (0xF1, 0xF3, 3), (0xF4, 0xF4, 7))
    NEXT = ((1, 0x80, 0xBF, 0), (2, 0x80, 0xBF, 1), (3, 0x80, 0xBF, 2), (4, 0xA0, 0xBF, 1), (5, 0x80, 0x9F, 1), (6, 0x90, 0xBF, 2), (7, 0x80, 0x8F, 2))
    STATES, BAD = 8, 8

    @classmethod
    def table(cls) -> np.ndarray:
        """Next state by state and byte; BAD for a byte that may not follow, and behind BAD."""
        out = np.full((cls.STATES + 1, 256), cls.BAD, np.int8)
        for low, high, to in cls.FIRST:
            out[0, low : high + 1] = to
        for state, low, high, to in cls.NEXT:
            out[state, low : high + 1] = to
        return out

    @classmethod
    def over_tokens(cls, vocabulary: list[bytes]) -> np.ndarray:
        """Next state by token and state."""
        step, length = cls.table(), np.fromiter(map(len, vocabulary), np.int64, len(vocabulary))
        start, data = np.cumsum(length) - length, np.frombuffer(b"".join(vocabulary) + b"\0", np.uint8)
        out = np.tile(np.arange(cls.STATES + 1, dtype=np.int8), (len(vocabulary), 1))
        for k in range(int(length.max(initial=0))):
            on = np.flatnonzero(length > k)
            out[on] = step[out[on], data[start[on] + k][:, None]]
        return out

    def __init__(self):
        self.step, self.state, self.open = self.table().tolist(), 0, bytearray()

    def feed(self, data: bytes) -> str:
        out = []
        for x in data:
            to = self.step[self.state][x]
            if to == self.BAD and self.state:  # the sequence ends here, and x begins anew
                out.append("\ufffd")
                self.open.clear()
                to = self.step[0][x]
            if to == self.BAD:
                out.append("\ufffd")
                self.state = 0
                continue
            self.open.append(x)
            self.state = to
            if not to:
                out.append(self.open.decode())
                self.open.clear()
        return "".join(out)

    def close(self) -> str:
        open_, self.state = bool(self.open), 0
        self.open.clear()
        return "\ufffd" if open_ else ""


class Codec:
    """Encodes and decodes whole texts by a rank file and the pattern that splits text before the merges."""

    def __init__(self, rank_file: str, pattern: str):
        with open(rank_file, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.transducer = Transducer(Merges(ranks))
        self.vocabulary = [b""] * (max(ranks.values()) + 1)
        for t, k in ranks.items():
            self.vocabulary[k] = t
        self.pattern = regex.compile(pattern)
        self.decimal = list(map(str, range(len(self.vocabulary))))
        self.after = Utf8Machine.over_tokens(self.vocabulary)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text; each distinct match of the pattern in a slice of texts is encoded once."""
        out: list[np.ndarray] = []
        for part in by_size(texts, ENCODED_CHARS):
            matches = list(map(self.pattern.findall, part))
            number = {m: k for k, m in enumerate(dict.fromkeys(chain.from_iterable(matches)))}
            tokens, counts = self.transducer.encode([m.encode() for m in number])
            start, tokens = np.cumsum(counts) - counts, tokens.astype(np.uint32)
            for m in matches:
                k = np.fromiter(map(number.__getitem__, m), np.int64, len(m))
                out.append(tokens[spread(start[k], counts[k])[1]])
        return out

    def digits(self, ids: np.ndarray) -> str:
        """The ids in decimal form, joined by spaces."""
        return " ".join(map(self.decimal.__getitem__, ids.tolist()))

    def valid(self, ids: np.ndarray) -> bool:
        """Whether the state machine, a token a step, reads well-formed UTF-8 and ends with no character open."""
        after = self.after[ids, 0]
        open_ = np.flatnonzero(after).tolist()  # a token that is well-formed in itself changes no state
        at, state, table = -1, 0, self.after
        for k in open_:
            if k < at:
                continue
            at, state = k, 0
            while at < len(ids) and (at == k or state):
                state = int(table[ids[at], state])
                at += 1
                if state == Utf8Machine.BAD:
                    return False
        return state == 0

    def decode(self, ids: np.ndarray) -> str:
        """Text of any ids; malformed UTF-8 goes through the machine byte by byte."""
        data = b"".join(map(self.vocabulary.__getitem__, ids.tolist()))
        if self.valid(ids):
            return data.decode()
        machine = Utf8Machine()
        return machine.feed(data) + machine.close()


#: Characters, and rows, of texts that are encoded together; a longer text is encoded alone.
ENCODED_CHARS, ENCODED_ROWS = 1 << 22, 1024


CODECS: dict[tuple[str, str], Codec] = {}


def codec(rank_file: str, pattern: str) -> Codec:
    """One for each worker process (of the last four asked for); its tables are kept from task to task, its states until a task ends."""
    if (key := (rank_file, pattern)) not in CODECS:
        if len(CODECS) >= 4:
            CODECS.clear()
        CODECS[key] = Codec(rank_file, pattern)
    return CODECS[key]


def forget() -> None:
    """The transducers of this process forget their states, which the next task builds anew as it reaches them."""
    for c in CODECS.values():
        c.transducer.reset()


def encode_texts(docs: DataFrame, rank_file: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids array<int> for each row of docs.

    A null text is the empty text and has no ids; a null id, repeated rows and further columns are left as they are
    (columns other than these two are dropped).  Whole texts are encoded.  Row for row, without a shuffle.
    """

    def encode(batch: pa.RecordBatch) -> dict:
        return {"doc_id": batch.column(0), "ids": lists(codec(rank_file, pattern).encode(texts_of(batch)))}

    return arrow_map(docs.selectExpr(f"`{id_col}` AS doc_id", f"`{text_col}` AS text"), encode, "doc_id bigint, ids array<int>", rows=ENCODED_ROWS, release=forget)


def lists(rows: list[np.ndarray]) -> pa.ListArray:
    return pa.ListArray.from_arrays(np.cumsum([0, *map(len, rows)]).astype(np.int32), pa.array(np.concatenate([np.empty(0, np.int32), *rows]).astype(np.int32)))


def decode_ids(ids: DataFrame, rank_file: str, pattern: str) -> DataFrame:
    """doc_id, text for rows of doc_id, ids; null ids give null, an empty list the empty text."""

    def decode(batch: pa.RecordBatch) -> dict:
        c = codec(rank_file, pattern)
        return {"doc_id": batch.column(0), "text": [None if x is None else c.decode(np.array(x, np.int64)) for x in batch.column(1).to_pylist()]}

    return arrow_map(ids.select("doc_id", "ids"), decode, "doc_id bigint, text string")


def round_trip(docs: DataFrame, rank_file: str, pattern: str, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encodes each whole text, decodes the ids by the state machine, and digests both.

    with_ids adds ids array<int>.  Null texts are empty: no tokens, and the digests of nothing.  Row for row, without a
    shuffle; repeated rows stay, further columns are dropped.
    """

    def digest(batch: pa.RecordBatch) -> dict:
        c = codec(rank_file, pattern)
        ids = c.encode(texts_of(batch))
        sha = lambda text: hashlib.sha256(text.encode()).hexdigest()
        out = {"doc_id": batch.column(0), "n_tokens": list(map(len, ids)), "ids_sha256": [sha(c.digits(x)) for x in ids], "decoded_sha256": [sha(c.decode(x)) for x in ids]}
        return out | ({"ids": lists(ids)} if with_ids else {})

    return arrow_map(docs.select("doc_id", "text"), digest, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids, rows=ENCODED_ROWS, release=forget)
