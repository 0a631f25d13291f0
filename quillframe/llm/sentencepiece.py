"""SentencePiece encoding and decoding by weighted finite-state transducers.

Four machines are compiled from a model file and composed with each input. Weights are of the
tropical semiring: added along a path, and the least path wins; infinity is no arc.

* N, the normaliser, has an explicit arc table over {space, any other symbol}. Its states know
  whether the text has begun (it then writes the dummy prefix) and, where spaces are squeezed,
  whether a gap is open. A space becomes U+2581.
* P, the pieces, is a trie from state 0 back to itself: its arcs read symbols, and an arc without
  input from a piece's last state writes the piece's number, at minus its score in a unigram model.
* B, the byte fallback, reads a symbol that no piece spells, writes a number for it and costs ten
  more than the worst piece. Its output is the symbol's UTF-8 bytes as ids, or one unknown id.
* L reads piece numbers. For a unigram model it has one state. For a BPE model its state is
  the last piece, and an arc weighs 0 where the merge rules, run over both pieces' text, give just
  these two back, and infinity elsewhere. Merges never cross a border of tokens, so a sequence is
  the merges' result if and only if each of its transitions is legal.

``shortest`` composes ``input o N o (P | B)* o L`` on demand and relaxes its arcs in the order of
the input's positions, for both kinds of model alike. At a position between pieces the composed
machine has one live state: L has one for a unigram model, and for a BPE model only one path
to each position is finite. ``shortest_of`` is the same relaxation over many inputs at once:
arcs are looked up for all of them in hash tables, and L's weights are found by undoing both
pieces' merges along their border, for all pairs at once.

No piece goes on behind a U+2581 that follows another symbol (checked when compiling), so where
a run of spaces (or of U+2581) begins N, P and L are each in one known state and the path factors there. Factors of a batch are
distinct before they are composed, and the ids and decoded bytes of those seen before are kept
in a bounded table per task.

Decoding is the inverse transducer: ids to a piece's bytes or a single one, U+2581 to space, and
from its first state without the dummy prefix. It works id by id, so factors' bytes add up.

Defined results: a null text and an empty one have no ids and decode to the empty string.
Texts of any length are encoded whole, in memory of their own size. Repeated rows get
repeated results. Only the named columns are read and returned, so names can't clash.
"""

from __future__ import annotations

import hashlib
import math
import re
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, strings, trimmed

SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
#: Factors kept per task (as many again while they grow old), and the longest that are kept and composed together.
KEPT, KEPT_LENGTH = 100_000, 40
#: Factors composed together, and texts whose factors are made distinct together, with so many characters in all (or one text).
TOGETHER, TEXTS, CHARACTERS = 4096, 1000, 400_000
#: Arcs of a BPE model's L that are kept, one for each place of a table.
ARCS = 1 << 19
#: N's states, and what it reads: a space, or a run of other symbols.
BEGIN, INSIDE, GAP = 0, 1, 2
RUNS = re.compile(" |[^ ]+")


def _fields(data: bytes):
    """(number, value) of a protocol buffer message's fields: int, or bytes for the others."""
    at, end = 0, len(data)

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            b = data[at]
            at += 1
            out |= (b & 127) << shift
            if b < 128:
                return out
            shift += 7

    while at < end:
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        else:
            n = {1: 8, 5: 4}.get(kind) or varint()
            yield key >> 3, data[at : at + n]
            at += n


class Table:
    """Values of int64 keys (none negative) by open addressing; -1 where there is none."""

    def __init__(self, keys, values):
        keys, values = np.asarray(keys, np.int64), np.asarray(values, np.int32)
        bits = max(4, (3 * len(keys)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.values = np.full(1 << bits, -1, np.int64), np.full(1 << bits, -1, np.int32)
        slot = self._slot(keys)
        while len(keys):
            free = np.flatnonzero(self.keys[slot] < 0)
            _, first = np.unique(slot[free], return_index=True)
            won = free[first]
            self.keys[slot[won]], self.values[slot[won]] = keys[won], values[won]
            left = np.ones(len(keys), bool)
            left[won] = False
            keys, values, slot = keys[left], values[left], (slot[left] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).view(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        slot = self._slot(keys)
        there = self.keys[slot]
        out = np.where(there == keys, self.values[slot], -1)
        on = np.flatnonzero((there != keys) & (there >= 0))
        while len(on):
            slot[on] = (slot[on] + 1) & self.mask
            there = self.keys[slot[on]]
            hit = there == keys[on]
            out[on[hit]] = self.values[slot[on[hit]]]
            on = on[~hit & (there >= 0)]
        return out


class Model:
    """The compiled transducers of a model file's bytes."""

    def __init__(self, data: bytes):
        pieces, trainer, normalizer = [], {}, {}
        for number, value in _fields(data):
            if number == 1:
                f = dict(_fields(value))
                pieces.append((f[1].decode(), struct.unpack("<f", f[2])[0] if 2 in f else 0.0, f.get(3, NORMAL)))
            elif number == 2:
                trainer = dict(_fields(value))
            elif number == 3:
                normalizer = dict(_fields(value))
        self.kind = trainer.get(3, UNIGRAM)
        if self.kind not in (UNIGRAM, BPE):
            raise ValueError("word and character models have no piece transducer")
        if normalizer.get(2):
            raise ValueError("this normaliser's character map isn't the identity; compile its rewrites first")
        if any(k in (USER, UNUSED) for *_, k in pieces):
            raise ValueError("user-defined and unused pieces aren't supported")
        self.ids = {p: i for i, (p, _, k) in enumerate(pieces) if k == NORMAL}
        self.scores = [s for _, s, _ in pieces]
        self.unknown = next(i for i, (*_, k) in enumerate(pieces) if k == UNKNOWN)
        self.bytes = {int(p[3:5], 16): i for i, (p, _, k) in enumerate(pieces) if k == BYTE}
        self.text = [p for p, *_ in pieces]
        self._compile_n(bool(normalizer.get(3, 1)), bool(normalizer.get(4, 1)))
        #: The decoder's arcs: what an id writes.
        self.out = [bytes([int(p[3:5], 16)]) if k == BYTE else p.replace(SPACE, " ").encode() if k == NORMAL else b" \xe2\x81\x87 " if k == UNKNOWN else b"" for p, _, k in pieces]
        self._compile_pb()
        self.inner = any(SPACE in p.lstrip(SPACE) for p in self.ids)
        self.factor = re.compile(".+" if self.inner else f"[ {SPACE}]+[^ {SPACE}]*|[^ {SPACE}]+", re.DOTALL)
        self.legal: dict[tuple[str, str], bool] = {}
        self.kept: dict = {}
        self.old: dict = {}

    def _compile_n(self, prefix: bool, squeeze: bool) -> None:
        """N's arcs: state -> (arc of a space, arc of any other symbol), an arc being (what it writes, next state); the other symbol is copied behind that."""
        self.prefix, self.squeeze = prefix, squeeze
        first = SPACE if prefix else ""
        if squeeze:
            self.n_arcs = {BEGIN: (("", BEGIN), (first, INSIDE)), INSIDE: (("", GAP), ("", INSIDE)), GAP: (("", GAP), (SPACE, INSIDE))}
        else:
            self.n_arcs = {BEGIN: ((first + SPACE, INSIDE), (first, INSIDE)), INSIDE: ((SPACE, INSIDE), ("", INSIDE))}

    def _compile_pb(self) -> None:
        """P and B as one arc table: (state, symbol class) -> state, and the number that a state writes on its way back to state 0.

        Symbol class 0 holds all symbols outside the vocabulary. Numbers from len(text) on are B's.
        """
        n, bpe = len(self.text), self.kind == BPE
        symbols = sorted({c for p in self.ids for c in p})
        self.symbol = {c: k + 1 for k, c in enumerate(symbols)}
        self.classes = np.zeros(0x110000, np.uint16)
        self.classes[[ord(c) for c in symbols]] = np.arange(1, len(symbols) + 1)
        self.single = {c: self.ids.get(c, n + k + 1) for k, c in enumerate(symbols)}
        total = n + len(symbols) + 1
        self.length = np.ones(total, np.int32)
        self.length[:n] = [max(1, len(p)) for p in self.text]
        #: A piece's place in the order of merges (symbols before all), and its last merge's two sides.
        self.rank, self.sides = np.full(total, -1, np.int64), np.full((total, 2), -1, np.int64)
        worst = 10 - min((self.scores[i] for i in self.ids.values()), default=0.0)
        self.weight = np.full(total, 0.0 if bpe else worst)
        live = list(self.ids.items())
        if bpe:
            live = self._compile_l(live)
        else:
            self.weight[:n] = [-s for s in self.scores]
        arcs: dict[int, int] = {}
        ends = [-1]
        for p, i in [*live, *((c, k) for c, k in self.single.items() if k >= n)]:
            state = 0
            for c in p:
                key = state << 16 | self.symbol[c]
                if key not in arcs:
                    arcs[key] = len(ends)
                    ends.append(-1)
                state = arcs[key]
            ends[state] = i
        arcs[0] = len(ends)  # B's arc of all other symbols
        ends.append(n)
        self.arcs, self.ends = arcs, ends
        self.arc_table, self.end_array = Table(list(arcs.keys()), list(arcs.values())), np.array(ends, np.int32)

    def _compile_l(self, live: list[tuple[str, int]]) -> list[tuple[str, int]]:
        """L's parts: ranks and sides of merges, and the pairs that merge; returns the pieces that the merge rules make at all."""
        order = {s: k for k, s in enumerate(sorted({-self.scores[i] for p, i in live if len(p) > 1}))}
        for p, i in live:
            if len(p) > 1:
                self.rank[i] = order[-self.scores[i]]
        self.odd: set[int] = set()
        out = []
        for p, i in sorted(live, key=lambda x: len(x[0])):
            if len(p) == 1:
                out.append((p, i))
                continue
            parts = self._merged_to(p, 2)
            sides = [self.ids.get(x, self.single.get(x, -1)) for x in parts]
            made = lambda x: self.length[x] == 1 or self.sides[x, 0] >= 0
            if len(sides) == 2 and min(sides) >= 0 and max(self.rank[x] for x in sides) < self.rank[i] and all(map(made, sides)):
                self.sides[i] = sides
            elif self.merged(p) == [p]:
                self.odd.add(i)
            else:
                continue  # the merge rules never make it: no arc
            out.append((p, i))
        keys, ranks, total = [], [], len(self.length)
        for p, i in live:
            for k in range(1, len(p)):
                a, b = p[:k], p[k:]
                a, b = self.ids.get(a, self.single.get(a)), self.ids.get(b, self.single.get(b))
                if a is not None and b is not None:
                    keys.append(a * total + b)
                    ranks.append(int(self.rank[i]))
        self.merge_table = Table(keys, ranks)
        self.odd_array = np.zeros(total, bool)
        self.odd_array[list(self.odd)] = True
        #: L's arcs seen lately, by a hash of the pair: the pair, and whether the arc's weight is 0.
        self.seen, self.seen_legal = np.full(ARCS, -1, np.int64), np.zeros(ARCS, bool)
        return out

    # -- L's weights ---------------------------------------------------------------------

    def _merged_to(self, text: str, least: int) -> list[str]:
        parts = list(text)
        while len(parts) > least:
            best, at = -math.inf, -1
            for i in range(len(parts) - 1):
                j = self.ids.get(parts[i] + parts[i + 1])
                if j is not None and self.scores[j] > best:
                    best, at = self.scores[j], i
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def merged(self, text: str) -> list[str]:
        """The merge rules run to their end: the best-scored pair first, then the leftmost."""
        return self._merged_to(text, 1)

    def transition(self, a: str, b: str) -> bool:
        """Whether piece b may follow piece a ("": the start) at weight 0, by the merge rules."""
        key = (a, b)
        found = self.legal.get(key)
        if found is None:
            if len(self.legal) > KEPT:
                self.legal.clear()
            found = self.legal[key] = self.merged(a + b) == ([a, b] if a else [b])
        return found

    def follows(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """L's arcs for pairs of numbers (a negative: its start): whether their weight is 0; those not seen lately are made."""
        if self.kind != BPE:
            return np.ones(len(a), bool)
        key = (a + 1) << 32 | b
        slot = ((key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(45)).view(np.int64)
        ok = self.seen_legal[slot]
        new = np.flatnonzero(self.seen[slot] != key)
        if len(new):
            ok[new] = found = self._follows(a[new], b[new])
            self.seen[slot[new]], self.seen_legal[slot[new]] = key[new], found
        return ok

    def _follows(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Undoes the two pieces' merges along their border, the latest first, and looks whether a
        merge across it would have come before; at a tie the one further left comes first.
        """
        ok = np.ones(len(a), bool)
        total = len(self.length)
        live = np.flatnonzero(a >= 0)
        a, b = a[live].astype(np.int64), b[live].astype(np.int64)
        if self.odd:
            for k in np.flatnonzero(self.odd_array[a] | self.odd_array[b]).tolist():
                ok[live[k]] = self.transition(self.text[a[k]] if a[k] < len(self.text) else "\0", self.text[b[k]] if b[k] < len(self.text) else "\0")
            plain = ~(self.odd_array[a] | self.odd_array[b])
            live, a, b = live[plain], a[plain], b[plain]
        limit = np.full(len(a), np.iinfo(np.int64).max)
        while len(live):
            across = self.merge_table.get(a * total + b)
            bad = (across >= 0) & (2 * across.astype(np.int64) < limit)
            ok[live[bad]] = False
            ra, rb = self.rank[a], self.rank[b]
            left = ra > rb
            limit = np.where(left, 2 * ra, 2 * rb + 1)
            on = np.flatnonzero(~bad & (left | (rb >= 0)))
            live, limit, left, a, b = live[on], limit[on], left[on], a[on], b[on]
            a, b = np.where(left, self.sides[a, 1], a), np.where(left, b, self.sides[b, 0])
        return ok

    def joins(self, a: int, b: int) -> bool:
        """follows() for one pair."""
        return bool(self.follows(np.array([a]), np.array([b]))[0])

    # -- composition and shortest paths --------------------------------------------------

    def rewritten(self, text: str, state: int = BEGIN) -> str:
        """input o N from a state: what it writes."""
        out, arcs = [], self.n_arcs
        for run in RUNS.findall(text):  # behind its first symbol a run of other symbols is copied: the arc from INSIDE to itself
            w, state = arcs[state][run != " "]
            out.append(w if run == " " else w + run)
        return "".join(out)

    def shortest(self, text: str) -> list[int]:
        """The numbers on the least path of text o (P | B)* o L, text being N's output; relaxed position by position."""
        n, arcs, ends, symbol = len(text), self.arcs, self.ends, self.symbol
        weight, moves = self.weight, {}
        cost, back = [math.inf] * (n + 1), [-1] * (n + 1)
        cost[0] = 0.0
        classes = [symbol.get(c, 0) for c in text]
        for i in range(n):
            here, last, state = cost[i], back[i], 0
            if here == math.inf:
                continue
            for j in range(i, n):
                state = arcs.get(state << 16 | classes[j], -1)
                if state < 0:
                    break
                piece = ends[state]
                if piece < 0:
                    continue
                to = here + weight[piece]
                if to < cost[j + 1]:
                    key = last << 32 | piece
                    legal = moves.get(key)
                    if legal is None:
                        legal = moves[key] = self.joins(last, piece)
                    if legal:
                        cost[j + 1], back[j + 1] = to, piece
        out = []
        while n:
            out.append(back[n])
            n -= int(self.length[back[n]])
        return out[::-1]

    def shortest_of(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """shortest() of many inputs at once: all numbers in order, and where each input's begin and end."""
        size = np.fromiter(map(len, texts), np.int64, len(texts))
        flat = self.classes[np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)]
        begin, widest = np.cumsum(size) - size, int(size.max(initial=0))
        m = len(texts)
        codes = np.zeros((widest, m), np.int64)
        row, place = np.repeat(np.arange(m), size), np.arange(len(flat)) - np.repeat(begin, size)
        codes[place, row] = flat
        cost, back = np.full((widest + 1, m), np.inf), np.full((widest + 1, m), -1, np.int64)
        cost[0] = 0.0
        for i in range(widest):
            rows = np.flatnonzero((size > i) & (cost[i] < np.inf))
            state, last, here = np.zeros(len(rows), np.int64), back[i, rows], cost[i, rows]
            for j in range(i, widest):
                state = self.arc_table.get(state << 16 | codes[j, rows]).astype(np.int64)
                on = np.flatnonzero((state >= 0) & (size[rows] > j))
                if not len(on):
                    break
                rows, state, last, here = rows[on], state[on], last[on], here[on]
                piece = self.end_array[state]
                to = here + self.weight[piece]
                better = np.flatnonzero((piece >= 0) & (to < cost[j + 1, rows]))
                better = better[self.follows(last[better], piece[better])]
                cost[j + 1, rows[better]], back[j + 1, rows[better]] = to[better], piece[better]
        # the paths, from their ends
        steps, rows, place = [], np.arange(m), size.copy()
        while True:
            on = np.flatnonzero(place > 0)
            if not len(on):
                break
            rows, place = rows[on], place[on]
            piece = back[place, rows]
            steps.append((rows, piece))
            place = place - self.length[piece]
        rows = np.concatenate([r for r, _ in steps][::-1]) if steps else np.zeros(0, np.int64)
        pieces = np.concatenate([p for _, p in steps][::-1]) if steps else np.zeros(0, np.int64)
        order = np.argsort(rows, kind="stable")
        return pieces[order], np.concatenate([[0], np.cumsum(np.bincount(rows, minlength=m))])

    # -- ids and bytes -------------------------------------------------------------------

    def _written(self, text: str, numbers: list[int]) -> tuple[bytes, bytes]:
        """(ids as little-endian 32-bit integers, decoded bytes) of a path."""
        ids, at, n = numbers, 0, len(self.text)
        if max(numbers, default=0) >= n:
            ids = []
            for k in numbers:
                if k < n:
                    ids.append(k)
                elif self.bytes:
                    ids += [self.bytes[b] for b in text[at].encode()]
                elif not (ids and ids[-1] == self.unknown):
                    ids.append(self.unknown)
                at += int(self.length[k])
        return struct.pack(f"<{len(ids)}i", *ids), b"".join(map(self.out.__getitem__, ids))

    def _composed(self, factors: list) -> None:
        """Puts the ids and bytes of factors (raw text, or a tuple of it where N is in its first state) into the table."""
        if len(self.kept) >= KEPT:
            self.old, self.kept = self.kept, {}
        leads: dict = {}  # N's way over the spaces that factors begin with

        def rewritten(f) -> str:
            f, state = (f, INSIDE) if type(f) is str else (f[0], BEGIN)
            run = f.lstrip(" ")
            if " " in run or not run:
                return self.rewritten(f, state)
            key = (len(f) - len(run), state)
            if key not in leads:
                leads[key] = self.rewritten(f[: key[0]] + "x", state)[:-1]
            return leads[key] + run

        texts, out, n = list(map(rewritten, factors)), self.out, len(self.text)
        size = np.fromiter(map(len, texts), np.int64, len(texts))
        order = np.argsort(size, kind="stable")[: int((size <= KEPT_LENGTH).sum())].tolist()
        for a in range(0, len(order), TOGETHER):
            own = order[a : a + TOGETHER]
            numbers, ends = self.shortest_of([texts[k] for k in own])
            plain = np.maximum.reduceat(np.append(numbers, 0), ends[:-1]) < n if len(numbers) else []
            packed, numbers, ends = numbers.astype("<i4").tobytes(), numbers.tolist(), ends.tolist()
            for k, b, e, p in zip(own, ends, ends[1:], plain, strict=False):
                self.kept[factors[k]] = (packed[4 * b : 4 * e], b"".join([out[x] for x in numbers[b:e]])) if p else self._written(texts[k], numbers[b:e])

    def _parts(self, text: str) -> list:
        """The text's factors; the first is a tuple, as N is in its first state there."""
        parts = self.factor.findall(text)
        if parts:
            parts[0] = (parts[0],)
        return parts

    def encoded_all(self, texts: list[str]):
        """For each text its ids as little-endian 32-bit integers and their decoded bytes, the dummy prefix on."""
        for own in self._dealt(texts):
            every = [self._parts(t) for t in own]
            kept, old, new = self.kept, self.old, []
            for f in set().union(*every).difference(kept):
                if f in old:
                    kept[f] = old[f]
                elif len(f if type(f) is str else f[0]) < KEPT_LENGTH:
                    new.append(f)
            now = kept
            self._composed(new)
            if self.kept is not now:  # the table grew old meanwhile
                now = {**now, **self.kept}
            for parts in every:
                found = list(map(now.get, parts))
                if None in found:
                    found = [x or self._alone(f) for x, f in zip(found, parts, strict=True)]
                ids, back = zip(*found, strict=True) if found else ((), ())
                yield b"".join(ids), b"".join(back)

    @staticmethod
    def _dealt(texts: list[str]):
        """texts in order, so many at a time that their factors take some 50 MB at most."""
        begin = size = 0
        for k, t in enumerate(texts):
            if k > begin and (k - begin == TEXTS or size + len(t) > CHARACTERS):
                yield texts[begin:k]
                begin, size = k, 0
            size += len(t)
        yield texts[begin:]

    def forget(self) -> None:
        """Empties the tables of what was seen lately: Python workers outlive their tasks."""
        self.kept, self.old = {}, {}
        self.legal.clear()

    def _alone(self, factor) -> tuple[bytes, bytes]:
        text = self.rewritten(factor[0], BEGIN) if type(factor) is tuple else self.rewritten(factor, INSIDE)
        return self._written(text, self.shortest(text))

    def encoded(self, text: str) -> bytes:
        """The ids of text as little-endian 32-bit integers."""
        return next(self.encoded_all([text]))[0]

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encoded(text), "<i4").tolist()

    def unprefixed(self, data: bytes) -> bytes:
        """What the decoder writes from its first state: without the dummy prefix, and as valid UTF-8."""
        data = data.decode("utf-8", "replace").encode()
        return data[1:] if self.prefix and data.startswith(b" ") else data

    def decode(self, ids: list[int]) -> str:
        return self.unprefixed(b"".join(map(self.out.__getitem__, ids))).decode()

    def lossless(self, text: str) -> bytes:
        """What encoding and decoding must give back: the text's normal form, with spaces for U+2581."""
        if self.squeeze:
            text = re.sub(" +", " ", text).strip(" ")
        return text.replace(SPACE, " ").encode("utf-8", "surrogatepass")


_COMPILED: dict[str, Model] = {}


def compiled(data: bytes) -> Model:
    """The model, compiled once in each Python worker."""
    key = hashlib.sha256(data).hexdigest()
    if key not in _COMPILED:
        _COMPILED[key] = Model(data)
    return _COMPILED[key]


def model_bytes(path: str) -> bytes:
    """A model file's bytes (some MB at most), read on the driver and shipped with the tasks."""
    with open(path, "rb") as f:
        return f.read()


def encode(df: DataFrame, data: bytes, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_tokens, token_ids, ids_sha256 (of the ids as little-endian 32-bit integers), decoded_sha256 (of the decoded text) and round_trip (whether that is the normalised text, spaces again)."""
    spark = df.sparkSession
    bounded_batches(spark)
    shipped = spark.sparkContext.broadcast(data)  # a model file: bounded by its vocabulary

    def over(it):
        m = compiled(shipped.value)
        for b in it:
            if not b.num_rows:
                continue
            texts = strings(b.column(1))
            parts, n, digests, decoded, same = [], [], [], [], []
            for t, (ids, back) in zip(texts, m.encoded_all(texts), strict=True):
                back = m.unprefixed(back)
                parts.append(ids)
                n.append(len(ids) // 4)
                digests.append(hashlib.sha256(ids).hexdigest())
                decoded.append(hashlib.sha256(back).hexdigest())
                same.append(back == m.lossless(t))
            ends = np.concatenate([[0], np.cumsum(n)])
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(parts), "<i4"), pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), lists, pa.array(digests), pa.array(decoded), pa.array(same)], names=[key, "n_tokens", "token_ids", "ids_sha256", "decoded_sha256", "round_trip"])
        m.forget()

    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(key), F.col(text)).mapInArrow(trimmed(over), f"`{key}` {kind}, n_tokens long, token_ids array<int>, ids_sha256 string, decoded_sha256 string, round_trip boolean")


def decode(df: DataFrame, data: bytes, *, key: str = "doc_id", ids: str = "token_ids") -> DataFrame:
    """key and text: the inverse transducer over each row's ids; null ids: the empty string."""
    bounded_batches(df.sparkSession)
    shipped = df.sparkSession.sparkContext.broadcast(data)

    def over(it):
        m = compiled(shipped.value)
        for b in it:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([m.decode(x or []) for x in b.column(1).to_pylist()], pa.string())], names=[key, "text"])

    return df.select(F.col(key), F.col(ids)).mapInArrow(over, f"`{key}` {df.schema[key].dataType.simpleString()}, text string")


#: The vocabulary file that the query reads; a parameter of everything above.
MODEL_PATH = "/opt/tokenizers/piece_bpe_32k.model"


def query(df: DataFrame, path: str = MODEL_PATH) -> DataFrame:
    return encode(df, model_bytes(path))
