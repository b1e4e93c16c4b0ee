"""Sampled segmentations of a text over the pieces of a SentencePiece model.

A text's lattice is cut at places no piece crosses, so that it is a row of small lattices, one for
each word, which are remembered.
"""

from __future__ import annotations

import heapq
import math
import re

import numpy as np
import pyarrow as pa
import sentencepiece
import xxhash

SPACE_MARK = "▁"
#: Stands for a text's own mark, which is no piece and no space: half of a surrogate pair, found in no text.
ESCAPED = "\udc81"
#: Lattice nodes remembered before the store is emptied.
STORED_NODES = 1_500_000
END = -1
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each number."""
    x = x + _GOLDEN
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def uniform(seed, counter: np.ndarray) -> np.ndarray:
    """Numbers in (0, 1), each from its seed (one, or one for each) and counter alone."""
    bits = mixed(counter.astype(np.uint64) * _GOLDEN ^ np.asarray(seed, np.uint64))
    return ((bits >> np.uint64(12)).astype(np.float64) + 0.5) / float(1 << 52)


class Lattices:
    """Pieces of a model, and the lattices of words met so far, as arrays of edges by node."""

    def __init__(self, model: bytes, alpha: float, rank_scores: bool):
        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        n = sp.get_piece_size()
        plain = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) or sp.is_byte(i))]
        self.unknown, bytes_ = sp.unk_id(), {sp.id_to_piece(i): i for i in range(n) if sp.is_byte(i)}
        self.byte_id = [bytes_.get(f"<0x{b:02X}>") for b in range(256)]
        scores = np.array([sp.get_score(i) for i in range(n)], float)
        if rank_scores:  # a model of merges has ranks, which are taken for those of a Zipf law
            scores = -np.log(np.where(scores <= 0, -scores, n) + 2.7)
            scores -= math.log(np.exp(scores).sum())
        self.weight = (alpha * scores).tolist()
        self.worst = alpha * (float(scores.min()) - 10)
        self.id_of = {sp.id_to_piece(i): i for i in plain}
        self._trie()
        if any(re.search(f"[^{SPACE_MARK}]{SPACE_MARK}|.\n|\n.", p) for p in self.id_of):
            raise ValueError("this model has pieces that cross words")
        bytes_of = [b""] * n
        for i in plain:
            bytes_of[i] = sp.id_to_piece(i).replace(SPACE_MARK, " ").encode()
        for b, i in enumerate(self.byte_id):
            if i is not None:
                bytes_of[i] = bytes([b])
        self.piece_length = np.array([len(x) for x in bytes_of], np.int64)
        self.piece_start = np.cumsum(self.piece_length) - self.piece_length
        self.piece_bytes = np.frombuffer(b"".join(bytes_of), np.uint8)
        self.n_pieces = n
        self.fallback: list[tuple[int, ...]] = []
        self.known_fallbacks = -1
        self.fallback_of: dict[str, int] = {}
        self._empty()

    def _trie(self) -> None:
        """Moves between prefixes of pieces, sorted by (prefix, character)."""
        state, ends, moves = {"": 0}, [0], []
        chars: dict[str, int] = {}
        for piece, i in self.id_of.items():
            for k in range(1, len(piece) + 1):
                if piece[:k] not in state:
                    state[piece[:k]] = len(ends)
                    ends.append(-1)
                    moves.append((state[piece[: k - 1]], chars.setdefault(piece[k - 1], len(chars) + 1), len(ends) - 1))
            ends[state[piece]] = i
        ends[0] = -1
        self.piece_at = np.array(ends, np.int64)
        self.n_chars = len(chars) + 1
        keys = np.array([s * self.n_chars + c for s, c, _ in moves], np.int64)
        to = np.array([t for _, _, t in moves], np.int64)
        self.bits = np.uint64(64 - max(2 * len(keys) - 1, 1).bit_length())
        self.move_key = np.full((1 << (64 - int(self.bits))) + 64, -1, np.int64)
        self.move_to = np.zeros(len(self.move_key), np.int64)
        left, slot = np.arange(len(keys)), self._slot(keys)
        while len(left):  # the first to come takes a slot, the others go on to the next one
            free = np.flatnonzero(self.move_key[slot] < 0)
            _, i = np.unique(slot[free], return_index=True)
            won = free[i]
            self.move_key[slot[won]], self.move_to[slot[won]] = keys[left[won]], to[left[won]]
            lost = np.ones(len(left), bool)
            lost[won] = False
            left, slot = left[lost], slot[lost] + 1
            if len(left) and slot.max() >= len(self.move_key):
                self.move_key, self.move_to = np.r_[self.move_key, np.full(64, -1)], np.r_[self.move_to, np.zeros(64, np.int64)]
        self.char_number = np.zeros(0x110000, np.int32)  # 0: in no piece
        for c, i in chars.items():
            self.char_number[ord(c)] = i
        self.weights = np.array(self.weight)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * _GOLDEN >> self.bits).astype(np.int64)

    def _moves(self, keys: np.ndarray):
        """Which of the moves there are, and where these lead."""
        slot, ok, to = self._slot(keys), np.zeros(len(keys), bool), np.zeros(len(keys), np.int64)
        i = np.arange(len(keys))
        while len(i):
            found = self.move_key[slot]
            hit = found == keys[i]
            ok[i[hit]], to[i[hit]] = True, self.move_to[slot[hit]]
            on = ~hit & (found >= 0)
            i, slot = i[on], slot[on] + 1
        return ok, to[ok]

    def _empty(self) -> None:
        self.root: dict[bytes, int] = {}
        self.n_nodes = self.n_edges = 0
        size = 1 << 22  # zeros take no memory before they are written
        self.first = np.zeros(size, np.int32)  # each node's first edge, and the end of the last one's
        self.to, self.token, self.at = (np.zeros(size, np.int32) for _ in range(3))
        self.p, self.q, self.upto = (np.zeros(size) for _ in range(3))  # chance of an edge at its node, of the others, of those up to it

    def _single(self, ch: str) -> tuple[float, int]:
        """Weight and token of a character that is no piece: its bytes, or the unknown piece."""
        t = self.fallback_of.get(ch)
        if t is None:
            ids = tuple(self.byte_id[b] for b in (SPACE_MARK if ch == ESCAPED else ch).encode("utf-8", "replace"))
            if None in ids:
                ids = (self.unknown,)
            t = self.fallback_of[ch] = ids[0] if len(ids) == 1 else self.n_pieces + len(self.fallback)
            if len(ids) > 1:
                self.fallback.append(ids)
        ids = (t,) if t < self.n_pieces else self.fallback[t - self.n_pieces]
        return (self.worst if ids == (self.unknown,) else sum(self.weight[i] for i in ids)), t

    def _add(self, words: list[bytes]) -> None:
        """Builds the lattices of these words together; each number depends on its own word alone."""
        data = b"".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))
        lengths = np.diff(np.r_[0, np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)[ends - 1]])  # in characters
        text = data.decode("utf-8").replace(SPACE_MARK, ESCAPED).replace(" ", SPACE_MARK)
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        n = len(points)
        ends = np.repeat(np.cumsum(lengths), lengths)
        chars = self.char_number[points].astype(np.int64)
        at, reach, state = np.arange(n), np.arange(n), np.zeros(n, np.int64)
        steps = []
        while len(at):  # one more character of all pieces that go on
            ok, state = self._moves(state * self.n_chars + chars[reach])
            at, reach = at[ok], reach[ok] + 1
            piece = self.piece_at[state]
            whole = piece >= 0
            steps.append((at[whole], reach[whole], piece[whole], self.weights[piece[whole]]))
            on = reach < ends[at]
            at, reach, state = at[on], reach[on], state[on]
        single = np.ones(n, bool)
        single[steps[0][0]] = False
        if single.any():
            left = np.flatnonzero(single)
            own = [self._single(chr(c)) for c in points[left].tolist()]
            steps.append((left, left + 1, np.array([t for _, t in own]), np.array([w for w, _ in own])))
        counts = sum(np.bincount(x[0], minlength=n) for x in steps)
        first = np.r_[0, np.cumsum(counts)]
        room, m = first[:-1].copy(), int(first[-1])
        from_, to, token, weight = np.repeat(np.arange(n), counts), np.empty(m, np.int64), np.empty(m, np.int64), np.empty(m)
        for a, b, t, w in steps:  # a node has one edge a step
            e = room[a]
            to[e], token[e], weight[e] = b, t, w
            room[a] += 1
        # log of the sum over segmentations from each place to its word's end, from the last places on
        rest, last = np.zeros(n + 1), to == ends[from_]
        left = ends - np.arange(n)
        by = np.argsort(left.astype(np.int16) if left.max(initial=0) < 1 << 15 else left, kind="stable")
        cuts = np.r_[0, np.cumsum(np.bincount(left, minlength=1)[1:])]
        total = np.empty(m)
        for low, high in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            if low == high:
                continue
            nodes = by[low:high]
            own = counts[nodes]
            starts = np.cumsum(own) - own
            e = np.arange(own.sum()) + np.repeat(first[nodes] - starts, own)
            total[e] = weight[e] + np.where(last[e], 0.0, rest[to[e]])
            rest[nodes] = np.logaddexp.reduceat(total[e], starts)
        p = np.exp(total - rest[from_])
        starts = first[:-1]
        # The likeliest edge of a node comes first.
        best = np.flatnonzero(p == np.repeat(np.maximum.reduceat(p, starts), counts))
        best = best[np.r_[True, from_[best[1:]] != from_[best[:-1]]]]
        moved = np.flatnonzero(best != starts)
        a, b = starts[moved], best[moved]
        for x in (to, token, last, p):
            x[a], x[b] = x[b], x[a]
        sums = np.repeat(np.add.reduceat(p, starts), counts)
        leads = p > 0.5
        # An edge that leads has the sum of the others exactly, however small it is.
        q = np.where(leads, np.repeat(np.add.reduceat(np.where(leads, 0.0, p), starts), counts), sums - p)
        q[np.repeat(counts, counts) == 1] = 0.0
        cum = p.copy()
        nodes, k = np.flatnonzero(counts > 1), 1
        while len(nodes):
            e = first[nodes] + k
            cum[e] += cum[e - 1]
            nodes, k = nodes[counts[nodes] > k + 1], k + 1
        cum[first[1:] - 1] = 2.0
        m, nodes = self.n_edges + m, self.n_nodes + n
        self._room(m, ("to", "token", "at", "p", "q", "upto"))
        self._room(nodes + 1, ("first",))
        new = slice(self.n_edges, m)
        self.to[new] = np.where(last, END, self.n_nodes + to)
        self.token[new], self.at[new], self.p[new], self.q[new], self.upto[new] = token, self.n_nodes + from_, p, q, cum
        self.first[self.n_nodes : nodes + 1] = self.n_edges + first
        self.root.update(zip(words, (self.n_nodes + np.cumsum(lengths) - lengths).tolist(), strict=True))
        self.n_nodes, self.n_edges = self.n_nodes + n, m

    def _room(self, n: int, names: tuple[str, ...]) -> None:
        for name in names:
            x = getattr(self, name)
            if n > len(x):
                setattr(self, name, np.concatenate([x, np.zeros(max(n, 2 * len(x)) - len(x), x.dtype)]))

    def words(self, texts: list[bytes]) -> list[np.ndarray]:
        """For each text, the first node of each of its words: a line break, or spaces and what follows, up to the next of these."""
        data = b"".join(b" " + t for t in texts if t)
        if not data:
            return [np.zeros(0, np.int64) for _ in texts]
        if self.n_nodes > STORED_NODES:
            self._empty()
        x = np.frombuffer(data, np.uint8)
        space, line = x == 32, x == 10
        begins = space.copy()
        begins[1:] &= ~space[:-1]
        begins |= line
        begins[1:] |= line[:-1]
        ends = np.cumsum([len(t) + 1 if t else 0 for t in texts])
        begins[ends[:-1][ends[:-1] < len(x)]] = True  # a text before may end with a space
        at = np.flatnonzero(begins)
        own = pa.Array.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(np.r_[at, len(x)].astype(np.int64)), pa.py_buffer(data)]).dictionary_encode()
        distinct = own.dictionary.to_pylist()
        if new := [w for w in distinct if w not in self.root]:
            self._add(new)
        nodes = np.fromiter(map(self.root.__getitem__, distinct), np.int64, len(distinct))[own.indices.to_numpy()]
        return np.split(nodes, np.searchsorted(at, ends[:-1]))

    def draw(self, nodes: np.ndarray, u: np.ndarray) -> np.ndarray:
        """An edge of each node."""
        e = self.first[nodes]
        more = np.flatnonzero(u >= self.upto[e])
        while len(more):
            e[more] += 1
            more = more[u[more] >= self.upto[e[more]]]
        return e

    def walk(self, seeds: np.ndarray, doc: np.ndarray, place: np.ndarray, nodes: np.ndarray):
        """Edges drawn from each node to its word's end, with their text and word, in order of both."""
        edges, docs, places, t = [], [], [], 0
        while len(nodes):
            e = self.draw(nodes, uniform(seeds[doc], (place << 24) + t))
            edges.append(e)
            docs.append(doc)
            places.append(place)
            nodes = self.to[e].astype(np.int64)
            on = nodes != END
            nodes, doc, place, t = nodes[on], doc[on], place[on], t + 1
        if not edges:
            return (np.zeros(0, np.int64),) * 3
        e, d, w = np.concatenate(edges), np.concatenate(docs), np.concatenate(places)
        order = np.argsort((d << 32) + w, kind="stable")
        return e[order], d[order], w[order]

    def ids(self, edges: np.ndarray) -> np.ndarray:
        tokens = self.token[edges]
        if not len(tokens) or tokens.max() < self.n_pieces:
            return tokens.astype(np.int32)
        if self.known_fallbacks != len(self.fallback):
            self.known_fallbacks = len(self.fallback)
            lengths = [len(x) for x in self.fallback]
            self.run_length = np.concatenate([np.ones(self.n_pieces, np.int64), lengths]).astype(np.int64)
            self.run_start = np.cumsum(self.run_length) - self.run_length
            self.run_ids = np.concatenate([np.arange(self.n_pieces), *map(np.array, self.fallback)]).astype(np.int32)
        n = self.run_length[tokens]
        return self.run_ids[np.arange(n.sum()) + np.repeat(self.run_start[tokens] - np.cumsum(n) + n, n)]

    def joined(self, ids: np.ndarray) -> bytes:
        n = self.piece_length[ids]
        return self.piece_bytes[np.arange(n.sum()) + np.repeat(self.piece_start[ids] - np.cumsum(n) + n, n)].tobytes()

    def decode(self, ids: np.ndarray) -> str:
        text = self.joined(ids).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text

    def gives(self, ids: np.ndarray, text: bytes) -> bool:
        """Whether the ids decode to the text."""
        data = self.joined(ids)
        return data[1:] == text if data.startswith(b" ") else data == text


def lowered(mass: np.ndarray, bound: float, u: np.ndarray) -> np.ndarray:
    """Gumbel numbers at these log masses, given that they are at most bound."""
    with np.errstate(over="ignore", divide="ignore"):
        return np.where(np.isneginf(mass), -np.inf, mass - np.logaddexp(mass - bound, np.log(-np.log(u))))


def sample_segmentations(lat: Lattices, texts: list[bytes], keys: list[str], k: int, seed: int = 0):
    """For each text: the k segmentations of greatest perturbed log probability, as (ids, log_prob,
    perturbed), and the number of the (k+1)th.

    A best-first search over sets of segmentations. A text's whole lattice has a Gumbel number; the
    best path under it is drawn edge by edge. What deviates from that path falls into one set for
    each edge: same path before, another edge there. Each set's best has a Gumbel number at the
    set's mass, bounded by the path's; the set of greatest number is searched next. Texts are
    searched side by side; each has random numbers of its own.
    """
    roots = lat.words(texts)
    base = np.array([xxhash.xxh64_intdigest(f"{seed}:{x}".encode("utf-8", "replace")) for x in keys], np.uint64)
    stream = lambda s, what: mixed(base ^ np.uint64(xxhash.xxh64_intdigest(f"{s}{what}".encode())))
    bounds = -np.log(-np.log(uniform(stream(0, "root"), np.zeros(len(texts)))))
    heaps: list[list[tuple]] = [[] for _ in texts]
    found: list[list[tuple[np.ndarray, float, float]]] = [[] for _ in texts]
    starts = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.arange(len(r)), r) for r in roots]
    active = np.arange(len(texts))
    serial = 0
    for s in range(k):
        doc = np.repeat(active, [len(x[2]) for x in starts])
        empty = np.zeros(0, np.int64)
        tail, tail_doc, tail_place = lat.walk(
            stream(s, "walk"), doc, np.concatenate([*(x[2] for x in starts), empty]), np.concatenate([*(x[3] for x in starts), empty])
        )
        cuts = np.searchsorted(tail_doc, np.r_[active, len(texts)])
        paths = [np.concatenate([x[0], tail[low:high]]) for x, low, high in zip(starts, cuts[:-1], cuts[1:], strict=True)]
        places = [np.concatenate([x[1], tail_place[low:high]]) for x, low, high in zip(starts, cuts[:-1], cuts[1:], strict=True)]
        # All sets that leave the new paths after the deviation that led to them.
        sizes = np.array([len(x) for x in paths], np.int64)
        ends = np.cumsum(sizes)
        edges = np.concatenate([*paths, empty])
        logs = np.log(lat.p[edges])
        at = np.arange(len(edges)) - np.repeat(ends - sizes, sizes)
        # A sum for each text, so that no text's numbers depend on the others.
        sums = [np.r_[0.0, np.cumsum(logs[low:high])] for low, high in zip(ends - sizes, ends, strict=True)]
        before = np.concatenate([*(x[:-1] for x in sums), np.zeros(0)])
        since = np.array([len(x[0]) for x in starts], np.int64)
        with np.errstate(divide="ignore"):
            mass = before + np.log(lat.q[edges])
        mass[at < np.repeat(since, sizes)] = -np.inf
        owner = np.repeat(active, sizes)
        g = lowered(mass, bounds[owner], uniform(stream(s, "set")[owner], at))
        for i, low, high, path, place, own in zip(active.tolist(), ends - sizes, ends, paths, places, sums, strict=True):
            found[i].append((path, float(own[-1]), float(bounds[i])))
            own = g[low:high]
            best = range(high - low) if high - low <= k + 1 else np.argpartition(-own, k)[: k + 1].tolist()  # no more can be searched
            for j in best:
                if own[j] > -np.inf:
                    serial += 1
                    heapq.heappush(heaps[i], (-float(own[j]), serial, path, place, int(j), float(before[low + j]), (int(path[j]),)))
        active = np.array([i for i in active.tolist() if heaps[i]], np.int64)
        if s + 1 == k or not len(active):
            break
        turn, again = uniform(stream(s + 1, "turn"), np.zeros(len(texts))), uniform(stream(s + 1, "again"), np.zeros(len(texts)))
        starts = []
        for i in active.tolist():
            g_i, _, path, place, j, prefix, used = heapq.heappop(heaps[i])
            bounds[i] = -g_i
            node = lat.at[path[j]]
            low, high = lat.first[node], lat.first[node + 1]
            p = lat.p[low:high].copy()
            p[np.array(used) - low] = 0.0
            e = min(int(np.searchsorted(np.cumsum(p), turn[i] * p.sum(), "right")), int(np.flatnonzero(p)[-1]))
            p[e] = 0.0
            e += int(low)
            if (left := p.sum()) > 0:
                more = float(lowered(np.array([prefix + math.log(left)]), bounds[i], again[i : i + 1])[0])
                serial += 1
                heapq.heappush(heaps[i], (-more, serial, path, place, j, prefix, (*used, e)))
            word = int(place[j])
            later, nodes = np.arange(word + 1, len(roots[i])), roots[i][word + 1 :]
            if lat.to[e] != END:
                later, nodes = np.r_[word, later], np.r_[int(lat.to[e]), nodes]
            starts.append((np.r_[path[:j], e], np.r_[place[:j], word], later, nodes))
    return [
        ([(lat.ids(path), log_prob, g_i) for path, log_prob, g_i in own], -heap[0][0] if heap else -math.inf)
        for own, heap in zip(found, heaps, strict=True)
    ]
