"""The bit predictor behind language-model scoring: hashed contexts, gated mixing, adaptive refinement.

A text is its lower-cased words, then an end. A word of the dictionary (the commonest words of the training
texts) is one symbol; any other is an escape symbol, and what it is follows from its spelling: its bytes and a
stop. Every symbol is a few yes-or-no decisions down a Huffman tree (one tree for words, one for bytes). Each
decision is predicted from four contexts; for words: none, the word before, the two words before, the last very
common word (which tells the language); for bytes: the two, three and four bytes before, and the word so far.
A spelling depends on the word alone, so each distinct word is spelled once, however often it occurs.
A context and a tree node have a slot of a hash table that holds how often the decision went each way in training.

A context and the first of four nodes of a path hash to a place in a table, and the nodes below to places beside it.

The slots' log odds are mixed by weights from a set that is chosen (gated) by how well filled the slots are.
A last table maps (kind and depth, mixed odds) to what happened there. While a text is scored, its own corrections
to the weights and to that table are refined: after every symbol of its first 64, then whenever it has grown by a
64th, and every 64 symbols at least (``EVERY``; when, depends on the place in the text alone). Spellings, which stand outside any text, are
scored by weights and table as they were fitted. All are probabilities of the next decision
given what came before, so the sum over a text is the log of a proper distribution over texts.
"""

from __future__ import annotations

import heapq
import zlib
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BITS, CONTEXTS = 22, 4  # of the smallest tables
GATES = 2 * 4 ** (CONTEXTS - 1)
BLOCK = 1 << 13
COMMON = 256
PRIOR, UNIT, MOST = 0.4, 512, 15.9
LEVELS = np.array([0, 1, 2, 8], np.float32)
RATE, WARM, REFINE, BUCKETS, DEPTHS, EVERY = 2.0, 1280, 0.02, 24, 32, 64
U = np.uint32
K1, K2, K3 = U(2654435761), U(0x9E3779B1), U(0x85EBCA6B)
MUL = 0x5851F42D4C957F2D
START, UNKNOWN, PLAIN = 0xFFFFFFFF, 1 << 24, 7


def squeezed(a: np.ndarray) -> bytes:
    raw = np.ascontiguousarray(a).tobytes()
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def filled(b: bytes, dtype) -> np.ndarray:
    return np.frombuffer(pa.decompress(b[8:], int.from_bytes(b[:8], "little"), "zstd", asbytes=True), dtype)


def native(state: dict) -> dict:
    """state with its arrays as NumPy makes them: unpickled ones have types of their own, for which ufunc.at, for one, takes a slow path."""
    return {k: v.astype(v.dtype.type) if isinstance(v, np.ndarray) else v for k, v in state.items()}


class Tree:
    """A Huffman tree: first[s] : first[s] + length[s] are symbol s's decisions in node and bit."""

    def __init__(self, counts: list[int], base: int = 0):
        n, order = len(counts), count()
        heap = [(int(c), next(order), s) for s, c in enumerate(counts)]
        heapq.heapify(heap)
        above, branch = np.zeros(2 * n, np.int64), np.zeros(2 * n, np.uint8)  # the node above and the branch taken; leaves are 0 to n - 1, nodes from n on
        for node in range(n, 2 * n - 1):
            (a, _, left), (b, _, right) = heapq.heappop(heap), heapq.heappop(heap)
            above[left], above[right], branch[right] = node, node, 1
            heapq.heappush(heap, (a + b, next(order), node))
        self.length = np.zeros(2 * n, np.int64)
        for node in range(2 * n - 3, -1, -1):  # from the root down: what is above has a larger number
            self.length[node] = self.length[above[node]] + 1
        self.length = self.length[:n]
        ends = np.cumsum(self.length)
        self.first = ends - self.length
        self.node, self.bit = np.zeros(ends[-1], np.uint32), np.zeros(ends[-1], np.uint8)
        at = np.arange(n)
        for step in range(1, int(self.length.max()) + 1):  # all symbols' last decisions, then those before
            own = np.flatnonzero(self.length >= step)
            place = ends[own] - step
            self.node[place], self.bit[place] = above[at[own]] - n + base, branch[at[own]]
            at[own] = above[at[own]]


class Code:
    """Symbols: dictionary words by rank, then escape, then end, then the 256 bytes."""

    def __init__(self, words: list[tuple[bytes, int]], escapes: int, ends: int, byte_counts: np.ndarray, bits: int = BITS):
        self.bits = bits  # tables have 2 ** bits slots
        self.words = pa.array([w for w, _ in words], pa.large_binary())
        self.escape, self.end = len(words), len(words) + 1
        self.byte0 = len(words) + 2
        a = Tree([n for _, n in words] + [max(escapes, 1), max(ends, 1)])
        b = Tree([int(n) * 16 + 1 for n in byte_counts], base=self.byte0)
        self.length = np.concatenate([a.length, b.length])
        self.first = np.concatenate([a.first, b.first + len(a.node)])
        self.node, self.bit = np.concatenate([a.node, b.node]), np.concatenate([a.bit, b.bit])
        depth = np.arange(len(self.node)) - np.repeat(self.first, self.length)
        self.kind = np.minimum(depth, DEPTHS // 2 - 1) + np.where(self.node >= self.byte0, DEPTHS // 2, 0)
        self.kind = self.kind.astype(np.int16)
        self.both = self.kind << np.int16(1) | self.bit
        # the first context's log odds of words, known before anything is counted in a table
        counts, ways = np.array([*(n for _, n in words), escapes, ends], float), np.zeros((2, self.byte0))
        own = int(a.length.sum())
        np.add.at(ways, (a.bit, a.node), np.repeat(counts, a.length))
        self.odds = np.zeros(len(self.node), np.float32)
        self.odds[:own] = np.clip(np.log((ways[1] + PRIOR) / (ways[0] + PRIOR)), -MOST, MOST)[a.node]
        # runs of four decisions share a place: the first one's node, and where in the little tree below it each stands
        inside, at, b = depth & 3, np.arange(len(self.node)), self.bit.astype(np.int64)
        back = lambda k: np.where(inside >= k, b[np.maximum(at - k, 0)], 0)
        self.offset = np.choose(inside, [np.ones_like(at), 2 + back(1), 4 + 2 * back(2) + back(1), 8 + 4 * back(3) + 2 * back(2) + back(1)]).astype(np.uint8)
        self.run_head = np.flatnonzero(inside == 0).astype(np.int32)
        self.run_node, self.run_size = self.node[self.run_head] * K2, np.diff(np.append(self.run_head, len(at))).astype(np.int8)
        self.runs = -(-self.length // 4)
        self.run_first = np.cumsum(self.runs) - self.runs

    def __setstate__(self, state: dict) -> None:
        self.__dict__ = native(state)

    def ids(self, words: pa.Array) -> np.ndarray:
        """Ranks of words, -1 for those that aren't in the dictionary."""
        return pc.fill_null(pc.index_in(words, value_set=self.words), -1).to_numpy(zero_copy_only=False).astype(np.int64)

    def paths(self, symbols: np.ndarray) -> "Paths":
        return Paths(self, symbols)


class Paths:
    """The decisions of some symbols: how many each has (n), their places in the code (at), and their slots under a context."""

    def __init__(self, code: Code, symbols: np.ndarray):
        self.n, self.runs, self.bits = np.take(code.length, symbols), np.take(code.runs, symbols), code.bits
        ends = np.cumsum(self.runs)
        run = np.repeat(np.take(code.run_first, symbols) - (ends - self.runs), self.runs)
        run += np.arange(len(run))
        self.node, size, head = (np.take(a, run, mode="clip") for a in (code.run_node, code.run_size, code.run_head))
        head = head - (np.cumsum(size) - size)
        self.run = np.repeat(np.arange(len(run)), size)  # of each decision; looking a run up is quicker than repeating it
        self.at = np.take(head, self.run, mode="clip")
        self.at += np.arange(len(self.at))
        self.offset = np.take(code.offset, self.at, mode="clip").astype(np.int64)

    def slots(self, seed: np.ndarray) -> np.ndarray:
        s = np.repeat(seed, self.runs)
        s += self.node
        s *= K1
        s ^= s >> U(15)
        s *= K3
        s >>= U(32 - self.bits)
        out = np.take(s.astype(np.int64), self.run, mode="clip")
        out ^= self.offset
        return out


_POWERS: list[np.ndarray] = []


def powers(n: int) -> list[np.ndarray]:
    """MUL ** k and its inverse modulo 2 ** 64, for k < n."""
    if not _POWERS or len(_POWERS[0]) < n:
        _POWERS.clear()
        for x in (MUL, pow(MUL, -1, 1 << 64)):
            a = np.full(max(n, 1 << 18), x, np.uint64)
            a[0] = 1
            _POWERS.append(np.cumprod(a))
    return [a[:n] for a in _POWERS]


Texts = tuple[pa.Array, np.ndarray]


def split_texts(texts) -> Texts:
    """All words of texts (strings or nulls, or an Arrow array without nulls) in a row, lower-cased as bytes, and how many each text has. ASCII white space parts words."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts if isinstance(texts, pa.Array) else pc.fill_null(pa.array(texts, pa.large_string(), from_pandas=True), "")))
    flat = lists.flatten()
    real = pc.not_equal(pc.binary_length(flat), 0)  # white space at an end leaves an empty piece
    text = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
    sizes = np.bincount(text[real.to_numpy(zero_copy_only=False)], minlength=len(lists)) if len(lists) else np.zeros(0, np.int64)
    return flat.filter(real).cast(pa.large_binary()), sizes


class Batch:
    """Texts as symbols with the seeds of their contexts."""

    def __init__(self, texts: Texts, code: Code):
        words, n_words = texts
        n, found = len(n_words), code.ids(words)
        text = np.repeat(np.arange(n), n_words)
        sizes = n_words + 2  # a start, which is not coded, and an end
        stops = np.cumsum(sizes)
        self.token_start = stops - sizes
        tok = np.empty(int(sizes.sum()), np.int64)
        place = np.arange(len(found)) + 2 * text + 1
        tok[place], tok[self.token_start], tok[stops - 1] = found, -2, code.end
        self.tokens = tok
        unknown = np.flatnonzero(found < 0)
        self.unknown, self.unknown_text = words.take(pa.array(unknown)), text[unknown]
        esc = place[unknown]
        seed = tok.astype(np.uint32)
        seed[tok == -2] = START
        seed[esc] = np.fromiter(map(zlib.crc32, self.unknown.to_pylist()), np.uint32, len(esc)) | U(UNKNOWN)
        seed *= K2
        coded = tok != -2
        self.symbols = np.where(tok == -1, code.escape, tok)[coded]
        # the last very common word before each token
        i = np.arange(len(tok))
        common = np.where((tok < COMMON) & (tok != -1), i, 0)  # starts count, so nothing crosses texts
        last = np.maximum.accumulate(common)
        before = np.concatenate([[0], last[:-1]]) if len(last) else last
        topic = seed[before] * K1
        one = np.concatenate([[U(START)], seed[:-1]]) if len(seed) else seed
        two = np.concatenate([[U(START)], one[:-1]]) if len(seed) else seed
        two[self.token_start + 1] = U(START)  # nothing crosses texts
        self.seeds = [a[coded] for a in (np.full(len(tok), PLAIN, np.uint32), one, (one ^ (two >> U(7))) * K3 + two, topic + U(99))]
        self.start = self.token_start - np.arange(n)
        self.size = sizes - 1


class Spelling:
    """Words as bytes, a stop after each, with the seeds of their contexts."""

    def __init__(self, words: list[bytes], code: Code):
        lens = np.fromiter(map(len, words), np.int64, len(words)) + 1
        raw = np.frombuffer(b"".join([w + b" " for w in words]), np.uint8)
        m = len(raw)
        self.symbols, self.start = raw.astype(np.int64) + code.byte0, np.cumsum(lens) - lens
        # hashes of what stands before in the word, by prefix sums with powers of MUL
        head = np.repeat(self.start, lens)
        up, down = powers(m + 1)
        total = np.concatenate([[np.uint64(0)], np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * down[:m])])
        part = (total[:-1] - total[head]) * up[:m]
        prefix = ((part ^ (part >> np.uint64(31))) * np.uint64(MUL) >> np.uint64(32)).astype(np.uint32)
        inside = np.arange(m) - head
        back = [np.where(inside >= k, np.concatenate([np.zeros(k, np.uint8), raw[: m - k]])[:m], 0).astype(np.uint32) for k in (1, 2, 3, 4)]
        pair = back[0] | back[1] << U(8)
        three = pair | back[2] << U(16)
        self.seeds = [pair + U(1 << 20), prefix, (three | back[3] << U(24)) * K2 + U(5), three * K3]


class Lessons:
    """Weights by gate and sums for the refinement table, learned from all that a task counts, each part before it is counted.

    Steps follow Adam; what stands for a gate in the end is the mean of its weights after each step, by decisions.
    """

    def __init__(self):
        self.weights, self.step = first_weights().astype(np.float64), 0
        self.m, self.v = np.zeros_like(self.weights), np.zeros_like(self.weights)
        self.n, self.sums = np.zeros(GATES), np.zeros_like(self.weights)
        self.cells = np.zeros((3, DEPTHS * BUCKETS))  # how many decisions, how many yes, sum of odds

    def learn(self, gate: np.ndarray, x: np.ndarray, kind: np.ndarray, bit: np.ndarray) -> None:
        """Decisions are sorted by gate, so that a gate's are mixed and summed in one go."""
        order = np.argsort(gate.astype(np.int8, copy=False), kind="stable")
        seen, n = np.bincount(gate, minlength=GATES), DEPTHS * BUCKETS
        met, ends = np.flatnonzero(seen), np.cumsum(seen)
        own = [(g, slice(ends[g] - seen[g], ends[g])) for g in met.tolist()]
        near = np.empty_like(x)
        for k in range(CONTEXTS):
            np.take(x[k], order, out=near[k], mode="clip")
        x = near
        cell, bit = np.take(kind * np.int16(2 * BUCKETS) + bit * np.int16(BUCKETS), order, mode="clip"), np.take(bit, order, mode="clip").astype(np.float32)
        for turn in range(max(1, 4 - self.step // 20)):  # more than one while little has been seen
            w, z = self.weights.astype(np.float32), np.empty(len(bit), np.float32)
            for g, part in own:
                np.dot(w[g, :CONTEXTS], x[:, part], out=z[part])
                z[part] += w[g, CONTEXTS]
            if not turn:
                at = (cell + Model.bucket(z)).astype(np.int64)
                both = np.bincount(at, minlength=2 * n).reshape(DEPTHS, 2, BUCKETS)
                odds = np.bincount(at, z, 2 * n).reshape(DEPTHS, 2, BUCKETS)
                self.cells += both.sum(1).ravel(), both[:, 1].ravel(), odds.sum(1).ravel()
            err = bit - 1 / (1 + np.exp(-z))
            g = np.zeros_like(self.weights)
            for k, part in own:
                g[k, :CONTEXTS], g[k, CONTEXTS] = np.dot(x[:, part], err[part]), err[part].sum()
            g /= seen[:, None] + 50
            self.step += 1
            self.m, self.v = 0.8 * self.m + 0.2 * g, 0.97 * self.v + 0.03 * g * g
            pace = 0.05 * min(1.0, (40 / self.step) ** 0.5)
            self.weights += pace * (self.m / (1 - 0.8**self.step)) / (np.sqrt(self.v / (1 - 0.97**self.step)) + 1e-6)
        self.n += seen
        self.sums += seen[:, None] * self.weights

    def sent(self) -> np.ndarray:
        """All in one array; those of several tasks add up, in any order to the same sums."""
        return np.rint(np.concatenate([self.n, self.sums.ravel(), self.cells.ravel()]) * 2.0**16) / 2.0**16


class Counts:
    """How often each slot's decision was no and yes, and the lessons from it."""

    def __init__(self, code: Code):
        self.code, self.own = code, [np.zeros(2 << code.bits, np.uint32) for _ in range(CONTEXTS)]
        self.symbols = np.zeros(code.byte0, np.int64)
        self.lessons, self.added = [Lessons(), Lessons()], [0, 0]  # of texts, of spellings

    def add(self, b: Batch | Spelling, most: int = 1 << 14) -> None:
        """Each part is predicted by what was counted before it, then counted; parts grow with what there is."""
        plain = isinstance(b, Batch)  # whose first context is the same everywhere, so it is counted by symbol
        if plain:
            self.symbols += np.bincount(b.symbols, minlength=len(self.symbols))
        lo = 0
        while lo < len(b.symbols):
            hi = lo + min(most, max(1 << 9, self.added[plain] // 4))
            paths = self.code.paths(b.symbols[lo:hi])
            kind = np.take(self.code.both, paths.at, mode="clip")
            bit = kind & np.int16(1)
            way = bit.astype(np.int64)
            kind >>= np.int16(1)
            x, gate = np.empty((CONTEXTS, len(bit)), np.float32), np.full(len(bit), 0 if plain else 1, np.int8)
            if plain:
                np.take(self.code.odds, paths.at, out=x[0], mode="clip")
            for k in range(plain, CONTEXTS):
                s = paths.slots(b.seeds[k][lo:hi])
                level = odds_and_level(np.take(self.own[k].view(np.uint64), s, mode="clip"), x[k])
                if k:
                    gate *= np.int8(4)  # below 128 in the end
                    gate += level
                s <<= 1
                s |= way
                np.add.at(self.own[k], s, U(1))  # at once, while what was read is still near
            self.lessons[plain].learn(gate, x, kind, bit)
            self.added[plain] += len(b.symbols[lo:hi])
            lo = hi

    def tables(self) -> list[np.ndarray]:
        met = np.flatnonzero(self.symbols)
        paths = self.code.paths(met)
        s = paths.slots(np.full(len(met), PLAIN, np.uint32)) << 1 | self.code.bit[paths.at]
        np.add.at(self.own[0], s, np.repeat(self.symbols[met], paths.n).astype(np.uint32))
        self.symbols[:] = 0
        return self.own


def odds_and_level(pairs: np.ndarray, odds: np.ndarray) -> np.ndarray:
    """How well filled slots are (0 to 3), given as (no, yes) in 64 bits each; their log odds go into odds."""
    n = pairs.view(np.uint32).astype(np.float32)
    no, yes = n[0::2], n[1::2]
    total = no + yes
    level = (total >= LEVELS[1]).view(np.int8) + (total >= LEVELS[2]).view(np.int8)
    level += (total >= LEVELS[3]).view(np.int8)
    n += np.float32(PRIOR)
    np.divide(yes, no, out=odds)
    np.log(odds, out=odds)
    np.clip(odds, -MOST, MOST, out=odds)
    return level


def packed(tables: list[np.ndarray]) -> list[np.ndarray]:
    """Each slot as 16 bits: log odds in units of 1 / UNIT, times four, plus how well filled it is (0 to 3)."""
    out = []
    for t in tables:
        no, yes = t[0::2].astype(float), t[1::2].astype(float)
        odds = np.clip(np.log((yes + PRIOR) / (no + PRIOR)), -MOST, MOST)
        level = np.searchsorted(LEVELS, no + yes, side="right") - 1
        out.append((np.rint(odds * UNIT).astype(np.int32) * 4 + level).astype(np.int16))
    return out


def first_weights() -> np.ndarray:
    w = np.full((GATES, CONTEXTS + 1), 0.3, np.float32)
    w[:, -1] = 0
    return w


def mix(weights: np.ndarray, gate: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Log odds by the weights of each decision's gate."""
    w = np.ascontiguousarray(weights.T)
    z = np.take(w[CONTEXTS], gate, mode="clip")  # no index is out of range; clip is the quicker check
    for k in range(CONTEXTS):
        a = np.take(w[k], gate, mode="clip")
        a *= x[k]
        z += a
    return z


def stride(at: int) -> int:
    """Symbols from place ``at`` of a text up to its next refinement."""
    return min(EVERY, 1 + at // EVERY)


class Model:
    def __init__(self, code: Code, tables: list[np.ndarray]):
        self.code, self.tables = code, tables
        self.weights, self.learned = first_weights(), np.zeros(GATES)
        self.refine = np.zeros((DEPTHS, BUCKETS), np.float32)
        self.plain: np.ndarray | None = None

    def plain_values(self) -> np.ndarray:
        """What is the same for all words at each place in node, in one number: the first context's slot, kind and bit."""
        if self.plain is None:
            every = np.arange(len(self.code.length))
            slot = np.take(self.tables[0], self.code.paths(every).slots(np.full(len(every), PLAIN, np.uint32)))
            self.plain = slot.astype(np.int32) << 16 | self.code.kind.astype(np.int32) << 1 | self.code.bit
        return self.plain

    def __getstate__(self) -> dict:
        """What goes to the tasks: the tables squeezed, as each executor keeps a copy on disk."""
        return self.__dict__ | {"plain": None, "tables": [squeezed(t) for t in self.tables]}

    def __setstate__(self, state: dict) -> None:
        self.__dict__ = native(state) | {"tables": [filled(t, np.int16) for t in state["tables"]]}

    def inputs(self, seeds: list[np.ndarray], symbols: np.ndarray, spelled: bool):
        """Decisions of each symbol, gate, log odds (CONTEXTS x decisions), kind, bit."""
        paths = self.code.paths(symbols)
        return paths.n, *self.met(paths, seeds, spelled)

    def met(self, paths: Paths, seeds: list[np.ndarray], spelled: bool):
        """Gate, log odds, kind and bit of each decision of paths."""
        same = np.take(self.plain_values(), paths.at, mode="clip")
        both = same.astype(np.int16)  # its lower half: kind and bit; all below 64
        bit, kind = (both & np.int16(1)).view(np.uint16), both >> np.int16(1)
        x, gate = np.empty((CONTEXTS, len(bit)), np.float32), (kind >= DEPTHS // 2).view(np.int8)
        for k, seed in enumerate(seeds):
            v = np.take(self.tables[k], paths.slots(seed), mode="clip") if k or spelled else same >> np.int32(16)
            if k:
                gate <<= np.int8(2)  # below 128 in the end
                gate |= (v & np.int16(3)).astype(np.int8)
            v >>= v.dtype.type(2)
            x[k] = v
        x *= np.float32(1 / UNIT)
        return gate, x, kind, bit

    def mixed(self, gate: np.ndarray, x: np.ndarray) -> np.ndarray:
        """Log odds by the fitted weights."""
        return mix(self.weights, gate.astype(np.int64), x)

    @staticmethod
    def bucket(z: np.ndarray) -> np.ndarray:
        b = (z * np.float32(1.5) + np.float32(BUCKETS // 2)).astype(np.int16)
        return np.clip(b, 0, BUCKETS - 1, out=b)

    def fit(self, lessons: np.ndarray) -> None:
        """Weights and refinement from the sums of all tasks' lessons; learned: how many decisions each gate's weights come from."""
        self.learned, sums, (every, yes, odds) = lessons[:GATES], lessons[GATES : GATES * (CONTEXTS + 2)].reshape(GATES, CONTEXTS + 1), lessons[GATES * (CONTEXTS + 2) :].reshape(3, -1)
        met = self.learned > 0
        self.weights[met] = (sums[met] / self.learned[met, None]).astype(np.float32)
        mean = odds / np.maximum(every, 1)
        p0 = 1 / (1 + np.exp(-mean))
        real = np.log((yes + 2 * p0) / (every - yes + 2 * (1 - p0)))
        self.refine = ((real - mean) * every / (every + 30)).reshape(DEPTHS, BUCKETS).astype(np.float32)

    def logs(self, z: np.ndarray, kind: np.ndarray, bit: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Natural log of each symbol's probability; first: where its decisions begin."""
        fine = z + np.take(self.refine.ravel(), kind * np.int16(BUCKETS) + self.bucket(z))
        side = np.where(bit, fine, -fine)
        return np.add.reduceat(np.minimum(side, 0) - np.log1p(np.exp(-np.abs(side))), first, dtype=np.float64)

    def spell(self, words: list[bytes]) -> np.ndarray:
        """log10 probability of each word's bytes and stop."""
        b = Spelling(words, self.code)
        per_symbol = np.zeros(len(b.symbols))
        for lo in range(0, len(b.symbols), BLOCK):
            part = slice(lo, lo + BLOCK)
            d, gate, x, kind, bit = self.inputs([s[part] for s in b.seeds], b.symbols[part], True)
            per_symbol[part] = self.logs(self.mixed(gate, x), kind, bit, np.cumsum(d) - d)
        return np.add.reduceat(per_symbol, b.start) / np.log(10) if len(words) else np.zeros(0)

    def score(self, texts: Texts) -> tuple[np.ndarray, Batch]:
        """log10 probability of each text without what its unknown words are; the batch.

        Texts step along together, the longest first, each with its own corrections; those made after a step
        hold from the next one on. Rates fall with the decisions seen, from RATE / WARM on.
        """
        b = Batch(texts, self.code)
        n, cells = len(b.size), DEPTHS * BUCKETS
        order = np.argsort(-b.size, kind="stable")
        start, size = b.start[order], b.size[order]
        own, seen = np.zeros((CONTEXTS, n), np.float32), np.full(n, WARM, np.float32)
        table = np.tile(self.refine.ravel(), n)  # each text's own
        per_symbol, one = np.zeros(len(b.symbols)), np.float32(1)
        lo, most = 0, int(size[0]) if n else 0
        while lo < most:
            # about BLOCK symbols: the next steps of every text that goes on
            steps, text, place, total = [], [], [], 0
            while lo < most and total < BLOCK:
                hi = lo + stride(lo)
                m = int(np.searchsorted(-size, -lo))  # texts longer than lo
                c = np.minimum(size[:m], hi) - lo
                steps.append((m, total, np.cumsum(c) - c))
                text.append(np.repeat(np.arange(m), c))
                place.append(np.arange(len(text[-1])) + np.repeat(start[:m] + lo - steps[-1][2], c))
                total, lo = total + len(text[-1]), hi
            i = np.concatenate(place)
            paths = self.code.paths(b.symbols[i])
            gate, x, kind, bit = self.met(paths, [s[i] for s in b.seeds], False)
            first = np.append(np.cumsum(paths.n) - paths.n, len(bit))
            z, p = self.mixed(gate, x), np.empty(len(bit), np.float32)
            sign = bit.astype(np.float32)
            sign *= np.float32(2)
            sign -= one
            base = np.take(np.repeat(np.concatenate(text) * cells, paths.runs), paths.run, mode="clip")  # a text's table begins here
            base += kind * np.int16(BUCKETS)
            ends = [at for _, at, _ in steps[1:]] + [total]
            for (m, at, texts_at), end in zip(steps, ends, strict=True):
                u, v = first[at], first[end]
                xs, zs, up = x[:, u:v], z[u:v], sign[u:v]
                heads = first[at + texts_at] - u
                met = np.diff(np.append(heads, v - u))
                zs += np.einsum("kd,kd->d", np.repeat(own[:, :m], met, axis=1), xs)
                cell = base[u:v]
                cell += self.bucket(zs)
                err = up / (one + np.exp(up * zs))  # bit less its probability
                own[:, :m] += np.float32(RATE / WARM**0.5) / np.sqrt(seen[:m]) * np.add.reduceat(err * xs, heads, axis=1)
                seen[:m] += met
                zs += np.take(table, cell, mode="clip")
                zs *= up
                against = np.divide(one, one + np.exp(zs), out=p[u:v])
                np.add.at(table, cell, np.float32(REFINE) * up * against)
            # what was not to be expected of a decision; a symbol's probability is the product of the rest
            per_symbol[i] = np.log(np.maximum(np.multiply.reduceat(np.subtract(1, p, dtype=float), first[:-1]), 1e-300))
        return (np.add.reduceat(per_symbol, b.start) if n else np.zeros(0)) / np.log(10), b
