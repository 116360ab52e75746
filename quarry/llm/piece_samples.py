"""Operator 1: SentencePiece encoding with Gumbel top-k samples without replacement, and decoding.

Every way to cut a text into pieces of the vocabulary is a path through a lattice, with the product of its pieces'
probabilities as weight. The k paths of the largest Gumbel-perturbed log weights are k distinct samples without
replacement. A perturbed A* search finds them top down: a set of paths with a common beginning has total weight
exp(phi) by the backward sums, and its largest perturbed value is a Gumbel at phi, truncated at its parent's. The set
of the largest bound is taken from the frontier and split into the path that attains the bound, which is an ancestral
sample, and the sets that leave that path at each of its nodes; those rests are bounded in turn. A sample's
inclusion score is 1 - exp(-exp(log p - kappa)), kappa being the largest bound left after the k-th sample.

White space opens a piece and never occurs inside one, so the lattice of a text is a chain of the lattices of its
words; backward sums are made once per distinct word. All words of a batch take one step at a time as arrays.
Random numbers are hashes of (seed, doc_id, sample, place), so results do not depend on partitions or retries.
The model gives merge ranks, not probabilities; piece probabilities are taken as Zipf in the rank, sharpened by
`alpha`. Characters outside the vocabulary are their bytes' pieces.

Null and empty texts have one sample, the empty one, with score 1. Texts with fewer cuts than k give all of them.
Texts of any length are sampled whole. Repeated rows give the same samples; a null doc_id counts as -1 for the
seed. An empty table gives no rows. Other columns are ignored. As in the library, the space mark in a text reads as
a space, and one space is put before the text.
"""

from __future__ import annotations

import re
import zlib
from itertools import chain, compress, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import claim, clean, strings, text_batches

MARK = "▁"
#: Units, which no piece crosses: a mark and its word; where no piece joins a letter to a stop, the stops behind a word are
#: a unit of their own; where no piece holds a line feed, lines are cut.
UNIT = f"{MARK}+[^{MARK}]*"
SHORT_UNIT = rf"{MARK}[^\W\d_]+(?![^.,{MARK}])|{MARK}+[^{MARK}]*|[.,][^{MARK}]*"
#: Units a worker keeps, some 800 bytes each, and the characters whose lattices it builds at once.
CACHED_UNITS = 250_000
CHUNK_CHARS = 65_536
M1, M2, GOLD = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    x = x + GOLD
    x = (x ^ (x >> np.uint64(30))) * M1
    x = (x ^ (x >> np.uint64(27))) * M2
    return x ^ (x >> np.uint64(31))


def uniform(x: np.ndarray) -> np.ndarray:
    """In (0, 1), a function of the 64-bit key."""
    return ((mix(x) >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def truncated(phi: np.ndarray, bound: np.ndarray, key: np.ndarray) -> np.ndarray:
    """A Gumbel at phi, no more than bound."""
    with np.errstate(divide="ignore", invalid="ignore"):
        return -np.logaddexp(-bound, -(phi - np.log(-np.log(uniform(key)))))


class Lattices:
    """The nodes and edges of all distinct words seen by a worker.

    Node i's edges are first[i] to first[i + 1]; edge e leads to node to[e] (-1: the word's end) with conditional
    log probability log_q[e], longer pieces first; cum[e] sums probabilities over the node's edges up to e. A piece
    below 0 is -1 - the code point of a character spelled in bytes. A full cache keeps the units that came again.
    """

    _made: dict[tuple[str, float], Lattices] = {}

    @classmethod
    def get(cls, model: str, alpha: float) -> Lattices:
        claim("pieces", cls._made.clear)
        if (model, alpha) not in cls._made:
            cls._made[model, alpha] = cls(model, alpha)
        return cls._made[model, alpha]

    def __init__(self, model: str, alpha: float):
        from sentencepiece import SentencePieceProcessor

        self.sp = sp = SentencePieceProcessor(model_file=model)
        pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
        plain = [i for i in range(len(pieces)) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        if any(MARK in pieces[i].lstrip(MARK) for i in plain):
            raise ValueError("pieces hold white space inside: texts cannot be cut at words")
        rank = {i: r for r, i in enumerate(plain)}
        weight = {i: -alpha * float(np.log(r + 3.0)) for i, r in rank.items()}
        self.least = -alpha * float(np.log(len(plain) + 3.0))
        self.ids = {pieces[i]: i for i in plain}
        self.weight = weight
        self.bytes = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.byte_ids = np.array(self.bytes)
        spell = {i: bytes([b]) for b, i in enumerate(self.bytes)}
        self.spelled = pa.array([spell.get(i) or (b"" if sp.is_control(i) else sp.decode([i]).encode() if sp.is_unknown(i) else p.replace(MARK, " ").encode()) for i, p in enumerate(pieces)], pa.binary())
        self.marked = [p.startswith(MARK) for p in pieces]
        form = UNIT if any(re.search(r"[^\W\d_][.,]", pieces[i]) for i in plain) else SHORT_UNIT
        if not any("\n" in pieces[i] and len(pieces[i]) > 1 for i in plain):
            form = form.replace(f"{MARK}]", f"{MARK}\n]") + f"|\n|[^{MARK}\n]+"
        self.unit_form = re.compile(form)
        self._build_trie()
        self.clear()

    def units(self, text: str) -> list[str]:
        return self.unit_form.findall(MARK + text.replace(" ", MARK)) if text else []

    def places(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """First nodes of all texts' units in a row, and how many units each text has; units are learnt on the way.

        Words are split and numbered by Arrow and looked up once each; texts with other blanks than single ones between
        words, and with marks of their own, are cut whole.
        """
        if len(self.unit) > CACHED_UNITS:  # what came again since the last time stays
            self._keep(self.again)
            self.again = set()
        column = pa.array(texts, pa.string())
        whole = pc.or_(pc.match_substring_regex(column, f"^ | $|  |{MARK}"), pc.equal(column, ""))
        words = pc.split_pattern(pc.if_else(whole, "", column), " ")
        begin = words.offsets.to_numpy()
        coded = words.flatten().dictionary_encode()
        row = coded.indices.to_numpy().astype(np.int64)
        keys = strings(coded.dictionary, MARK)
        known = np.fromiter(map(self.unit.get, keys, repeat(-1)), np.int64, len(keys))  # a word that is one unit
        self.again.update(compress(keys, (known >= 0).tolist()))
        alone = np.flatnonzero(whole.to_numpy(zero_copy_only=False))
        row[begin[alone]] = len(keys) + np.arange(len(alone))
        cut = [(k, self.unit_form.findall(keys[k])) for k in np.flatnonzero(known < 0).tolist()] + [(len(keys) + k, self.units(texts[d])) for k, d in enumerate(alone.tolist())]
        fresh = set(chain.from_iterable(u for _, u in cut))
        self.learn(fresh)
        size = np.ones(len(keys) + len(alone), np.int64)
        place = np.fromiter((k for k, _ in cut), np.int64, len(cut))
        size[place] = np.fromiter((len(u) for _, u in cut), np.int64, len(cut))
        start = np.cumsum(size) - size
        nodes = np.empty(int(size.sum()), np.int64)
        one = np.ones(len(size), bool)
        one[place] = False
        nodes[start[one]] = known[known >= 0]
        made = np.fromiter(map(self.unit.__getitem__, chain.from_iterable(u for _, u in cut)), np.int64, int(size[place].sum()))
        inside = np.arange(len(made)) - np.repeat(np.cumsum(size[place]) - size[place], size[place])
        nodes[np.repeat(start[place], size[place]) + inside] = made
        n = size[row]
        ends = np.concatenate([[0], np.cumsum(n)])
        return nodes[np.repeat(start[row] - ends[:-1], n) + np.arange(ends[-1])], np.diff(ends[begin])

    def clear(self) -> None:
        self.unit: dict[str, int] = {}
        self.again: set[str] = set()
        self.nodes = 0
        self.first, self.to, self.piece = np.zeros(1, np.int64), np.empty(0, np.int32), np.empty(0, np.int32)
        self.cum, self.log_q, self.log_rest = (np.empty(0) for _ in range(3))

    def _append(self, ends: np.ndarray, edges: dict[str, np.ndarray]) -> None:
        """Nodes with their edges' ends, counted from the new edges' begin; arrays grow by doubling."""
        a = int(self.first[self.nodes])
        for name, at, values in [("first", self.nodes + 1, a + ends), *((name, a, v) for name, v in edges.items())]:
            held = getattr(self, name)
            if at + len(values) > len(held):
                grown = np.empty(max(2 * len(held), at + len(values)), held.dtype)
                grown[:at] = held[:at]
                setattr(self, name, grown)
            getattr(self, name)[at : at + len(values)] = values
        self.nodes += len(ends)

    def _keep(self, units: set[str]) -> None:
        """Forget all units but these."""
        kept = [u for u in units if u in self.unit]
        old, size = np.fromiter(map(self.unit.__getitem__, kept), np.int64, len(kept)), np.fromiter(map(len, kept), np.int64, len(kept))
        new = np.cumsum(size) - size
        nodes = np.repeat(old - new, size) + np.arange(int(size.sum()))
        n = self.first[nodes + 1] - self.first[nodes]
        ends = np.cumsum(n)
        e = np.repeat(self.first[nodes] - ends + n, n) + np.arange(int(n.sum()))
        edges = {name: getattr(self, name)[e] for name in ("to", "piece", "cum", "log_q", "log_rest")}
        edges["to"] = np.where(edges["to"] >= 0, edges["to"] + np.repeat(np.repeat(new - old, size), n), -1)
        self.unit, self.nodes = dict(zip(kept, new.tolist(), strict=True)), 0
        self._append(ends, edges)

    def _build_trie(self) -> None:
        """The vocabulary as a trie whose steps (state, character) are looked up in one open hash table."""
        steps: dict[tuple[int, str], int] = {}
        self.state_id, self.state_weight = [-1], [0.0]
        for text, i in self.ids.items():
            at = 0
            for c in text:
                if (at, c) not in steps:
                    steps[at, c] = len(self.state_id)
                    self.state_id.append(-1)
                    self.state_weight.append(0.0)
                at = steps[at, c]
            self.state_id[at], self.state_weight[at] = i, self.weight[i]
        self.state_id, self.state_weight = np.array(self.state_id, np.int64), np.array(self.state_weight)
        self.bits = max(4, (4 * len(steps)).bit_length())
        self.slot_key, self.slot_to = np.full(1 << self.bits, -1, np.int64), np.zeros(1 << self.bits, np.int64)
        keys = np.array([s << 21 | ord(c) for s, c in steps], np.int64)
        for key, slot, to in zip(keys.tolist(), self._slots(keys).tolist(), steps.values(), strict=True):
            while self.slot_key[slot] >= 0:
                slot = (slot + 1) % len(self.slot_key)
            self.slot_key[slot], self.slot_to[slot] = key, to

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * GOLD) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _step(self, states: np.ndarray, chars: np.ndarray) -> np.ndarray:
        """The states that follow, -1 where the trie ends."""
        keys = states << 21 | chars
        slots, out, open_ = self._slots(keys), np.full(len(keys), -1, np.int64), np.arange(len(keys))
        while len(open_):
            held = self.slot_key[slots[open_]]
            hit = held == keys[open_]
            out[open_[hit]] = self.slot_to[slots[open_[hit]]]
            open_ = open_[~hit & (held >= 0)]
            slots[open_] = (slots[open_] + 1) % len(self.slot_key)
        return out

    def learn(self, units: set[str]) -> None:
        fresh = [u for u in units if u not in self.unit]
        fresh.sort(key=len)
        a = 0
        while a < len(fresh):  # some units of like length at a time, whose arrays a processor's cache holds
            b = min(len(fresh), a + max(1, CHUNK_CHARS // len(fresh[a])))
            while b > a + 1 and (b - a) * len(fresh[b - 1]) > 2 * CHUNK_CHARS:
                b = (a + b + 1) // 2
            self._learn(fresh[a:b])
            a = b

    def _learn(self, fresh: list[str]) -> None:
        base = self.nodes
        size = np.fromiter(map(len, fresh), np.int64, len(fresh))
        ends = np.cumsum(size)
        chars = np.frombuffer("".join(fresh).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        end = np.repeat(ends, size)
        # all pieces at all places, one character further each round
        at = np.arange(len(chars))
        state, stop = np.zeros(len(chars), np.int64), at
        held: list[tuple[np.ndarray, ...]] = []
        known, single = np.zeros(len(chars), bool), np.empty(len(chars))
        while len(at):
            state = self._step(state, chars[stop])
            on = state >= 0
            at, state, stop = at[on], state[on], stop[on] + 1
            piece = np.flatnonzero(self.state_id[state] >= 0)
            held.append((at[piece], stop[piece], self.state_weight[state[piece]], self.state_id[state[piece]]))
            if len(held) == 1:
                known[at[piece]], single[at[piece]] = True, held[0][2]
            on = stop < end[at]
            at, state, stop = at[on], state[on], stop[on]
        odd = np.flatnonzero(~known)
        code = chars[odd]
        single[odd] = self.least * (1.0 + (code > 0x7F) + (code > 0x7FF) + (code > 0xFFFF))
        held.append((odd, odd + 1, single[odd], -1 - code))
        # edges by node, longer pieces first, which are mostly likelier: each round has a place at most once
        n = np.zeros(len(chars), np.int64)
        for places, *_ in held:
            n[places] += 1
        stops_at = np.cumsum(n)
        begin = stops_at - n
        node = np.repeat(np.arange(len(chars)), n)
        to, weight, piece, fill = np.empty(len(node), np.int64), np.empty(len(node)), np.empty(len(node), np.int64), begin.copy()
        for places, stops, weights, pieces in reversed(held):
            where = fill[places]
            to[where], weight[where], piece[where] = stops, weights, pieces
            fill[places] += 1
        score = self._conditional(node, to, weight, n, begin, end, size, single)
        q = np.exp(score)
        cum, on, k = q.copy(), np.flatnonzero(n > 1), 1
        while len(on):
            cum[begin[on] + k] += cum[begin[on] + k - 1]
            k += 1
            on = on[n[on] > k]
        cum[stops_at - 1] = 1.0
        with np.errstate(divide="ignore"):
            rest = np.log(np.maximum(0.0, 1.0 - q))
        rest[begin[n == 1]] = -np.inf  # whatever rounding says
        self._append(stops_at, {"to": np.where(to < end[node], base + to, -1), "piece": piece, "cum": cum, "log_q": score, "log_rest": rest})
        self.unit.update(zip(fresh, (base + ends - size).tolist(), strict=True))

    @staticmethod
    def _conditional(node, to, weight, n, begin, end, size, single) -> np.ndarray:
        """Log of each edge's weight with all that can follow, by its node's, from backward sums over all paths.

        Sums are taken relative to the path of single characters, rounded down. They are 1 at least then, so only long
        units can leave the range of doubles, upwards; the sums of units that might are taken as logarithms.
        """
        word = np.repeat(np.arange(len(size)), size)
        place, goal = np.arange(len(word)) + word, to + word[node]  # a place behind each word stands for its end
        left = end - np.arange(len(word))
        turn = np.argsort(left.astype(np.uint16) if size.max() < 65_536 else left, kind="stable")
        head = np.cumsum(n[turn]) - n[turn]
        e = np.repeat(begin[turn] - head, n[turn]) + np.arange(len(node))
        head, own, aim = np.append(head, len(node)), place[turn], goal[e]
        bounds = np.searchsorted(left[turn], np.arange(1, int(size.max()) + 2)).tolist()
        rounds = [(slice(a, b), slice(int(head[a]), int(head[b])), head[a:b] - head[a]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        base = np.floor(single * 1024) / 1024  # whose sums are exact
        path = np.concatenate([[0.0], np.cumsum(base)])
        gain = weight - (path[to] - path[node])
        with np.errstate(over="ignore", invalid="ignore"):
            times, total = np.exp(gain)[e], np.ones(len(word) + len(size))
            for nodes, edges, heads in rounds:
                total[own[nodes]] = np.add.reduceat(times[edges] * total[aim[edges]], heads)
            total = np.log(total)
        far = 0.7 * size - np.add.reduceat(base, np.cumsum(size) - size) > 700  # up to 2^size paths, each of weight 1 at most
        if far.any():
            ordered, logs = gain[e], np.zeros(len(total))
            for nodes, edges, heads in rounds:
                w = ordered[edges] + logs[aim[edges]]
                top = np.maximum.reduceat(w, heads)
                logs[own[nodes]] = top + np.log(np.add.reduceat(np.exp(w - np.repeat(top, np.diff(np.append(heads, len(w))))), heads))
            total = np.where(np.repeat(far, size + 1), logs, total)
        return np.minimum(0.0, gain + total[goal] - total[place[node]])

    def walk(self, nodes: np.ndarray, seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ancestral samples from nodes to their words' ends: (edges in order, edges of each node)."""
        n, at, row, step = np.zeros(len(nodes), np.int64), nodes, np.arange(len(nodes)), 0
        edges, rows = [], []
        with np.errstate(over="ignore"):
            while len(at):
                u = uniform(seeds[row] + np.uint64(step) * M2)
                e = self.first[at]
                on = np.flatnonzero(u > self.cum[e])
                while len(on):
                    e[on] += 1
                    on = on[u[on] > self.cum[e[on]]]
                edges.append(e)
                rows.append(row)
                n[row] += 1
                to = self.to[e]
                more = to >= 0
                at, row, step = to[more], row[more], step + 1
        out = np.empty(int(n.sum()), np.int64)
        start = np.cumsum(n) - n
        for k, (e, r) in enumerate(zip(edges, rows, strict=True)):
            out[start[r] + k] = e
        return out, n

    def decode(self, ids: list[np.ndarray]) -> list[str]:
        """The texts of some runs of ids, as the library decodes them."""
        run = np.concatenate(ids) if ids else np.empty(0, np.uint32)
        taken = self.spelled.take(pa.array(run.astype(np.int32)))
        ends = np.frombuffer(taken.buffers()[1], np.int32, len(run) + 1)
        raw = memoryview(taken.buffers()[2] or b"")
        out, a = [], 0
        for x in ids:
            b = a + len(x)
            start = int(ends[a]) + bool(len(x) and self.marked[x[0]])
            try:
                out.append(str(raw[start : int(ends[b])], "utf-8"))
            except UnicodeDecodeError:  # bytes that make no character
                out.append(self.sp.decode(x.tolist()))
            a = b
        return out

    def tokens(self, edges: np.ndarray) -> np.ndarray:
        ids = self.piece[edges].astype(np.int64)
        odd = np.flatnonzero(ids < 0)
        if not len(odd):
            return ids.astype("<u4")
        short = odd[ids[odd] >= -128]  # ASCII: a byte each
        ids[short] = self.byte_ids[-1 - ids[short]]
        odd = odd[ids[odd] < 0]
        if not len(odd):
            return ids.astype("<u4")
        parts, last = [], 0
        for i in odd.tolist():
            parts += [ids[last:i], np.array([self.bytes[b] for b in chr(-1 - ids[i]).encode("utf-8", "surrogatepass")], np.int64)]
            last = i + 1
        return np.concatenate([*parts, ids[last:]]).astype("<u4")


def sample_texts(lat: Lattices, keys: list, texts: list[str], k: int, seed: int) -> list[list[tuple[np.ndarray, float, float, float]]]:
    """For each text its samples, best first: ids, log probability, perturbed value, inclusion score."""
    nodes, count = lat.places(texts)
    begin = np.cumsum(count) - count
    doc = np.repeat(np.arange(len(texts)), count)
    place = (np.arange(len(nodes)) - begin[doc]).astype(np.uint64)
    own = mix(mix(np.array([-1 if x is None else x for x in keys], np.int64).view(np.uint64)) + np.uint64(seed))
    bound = -np.log(-np.log(uniform(own + np.uint64(0x51ED27))))
    paths: list[list] = [[] for _ in texts]  # of a text: [edges, tokens a word, log p before each edge, rest bounds, edges left by]

    def draw(s: int, after: np.ndarray):
        """Ancestral samples number s of the words behind word after[d] of each text d."""
        pick = np.arange(len(nodes)) - begin[doc] > after[doc]
        salt = mix(own[doc[pick]] + np.uint64(1000 + s))
        return lat.walk(nodes[pick], mix(salt + place[pick] * GOLD))

    log_q, log_rest = lat.log_q, lat.log_rest

    def rests(edges: np.ndarray, before: float, top: float, key: np.uint64, skip: int) -> tuple[np.ndarray, np.ndarray]:
        lead = before + np.concatenate([[0.0], np.cumsum(log_q[edges])])
        g = truncated(lead[:-1] + log_rest[edges], np.full(len(edges), top), mix(key + np.arange(len(edges)).astype(np.uint64) * M1))
        g[:skip] = -np.inf
        return lead, g

    edges, n = draw(0, np.full(len(texts), -1))
    ends = np.concatenate([[0], np.cumsum(n)])
    out: list[list] = [[] for _ in texts]
    for d in range(len(texts)):
        a, b = ends[begin[d]], ends[begin[d] + count[d]]
        lead, g = rests(edges[a:b], 0.0, bound[d], own[d] + np.uint64(77), 0)
        paths[d].append((edges[a:b], n[begin[d] : begin[d] + count[d]], lead, g, {}))
        out[d].append((lead[-1], bound[d]))
    for s in range(1, k):
        rows = np.array([d for d in range(len(texts)) if max((float(p[3].max(initial=-np.inf)) for p in paths[d]), default=-np.inf) > -np.inf and len(out[d]) == s], np.int64)
        if not len(rows):
            break
        leaves, after = [], count.copy()  # where each text leaves which of its paths; only what is behind is drawn anew
        for d in rows.tolist():
            j = max(range(len(paths[d])), key=lambda p: paths[d][p][3].max(initial=-np.inf))
            i = int(paths[d][j][3].argmax())
            leaves.append((j, i, int(np.searchsorted(np.cumsum(paths[d][j][1]), i, "right"))))
            after[d] = leaves[-1][2]
        fresh, fn = draw(s, after)
        f_ends = np.concatenate([[0], np.cumsum(fn)])
        at = 0
        for d, (j, i, word) in zip(rows.tolist(), leaves, strict=True):
            words = int(count[d]) - word - 1
            path, sizes, lead, g, left = paths[d][j]
            top = float(g[i])
            node = int(np.searchsorted(lat.first[: lat.nodes + 1], path[i], "right")) - 1
            used = left.setdefault(i, [int(path[i])])
            options = [e for e in range(lat.first[node], lat.first[node + 1]) if e not in used]
            weights = np.exp(lat.log_q[options])
            u = float(uniform(np.array([own[d] + np.uint64(31 * s + 5)], np.uint64))[0]) * weights.sum()
            e = options[min(int(np.searchsorted(np.cumsum(weights), u)), len(options) - 1)]
            used.append(e)
            rest = float(weights.sum() - np.exp(lat.log_q[e])) if len(options) > 1 else 0.0
            g[i] = truncated(np.array([lead[i] + (np.log(rest) if rest > 0 else -np.inf)]), np.array([top]), np.array([own[d] + np.uint64(9000 + 13 * s)], np.uint64))[0] if rest > 0 else -np.inf
            to = int(lat.to[e])
            tail, tn = lat.walk(np.array([to], np.int64), np.array([mix(own[d : d + 1] + np.uint64(500 + s))[0]], np.uint64)) if to >= 0 else (np.empty(0, np.int64), np.zeros(1, np.int64))
            a, b = f_ends[at], f_ends[at + words]
            whole = np.concatenate([path[:i], [e], tail, fresh[a:b]])
            new_sizes = np.concatenate([sizes[:word], [i - int(sizes[:word].sum()) + 1 + int(tn[0])], fn[at : at + words]])
            lead2, g2 = rests(whole, 0.0, top, own[d] + np.uint64(7700 + s), i + 1)
            paths[d].append((whole, new_sizes, lead2, g2, {}))
            out[d].append((lead2[-1], top))
            at += words
    result = []
    for d in range(len(texts)):
        kappa = max(float(p[3].max(initial=-np.inf)) for p in paths[d])
        result.append([(lat.tokens(p[0]), float(lp), float(g), float(-np.expm1(-np.exp(min(700.0, lp - kappa)))) if kappa > -np.inf else 1.0) for p, (lp, g) in zip(paths[d], out[d], strict=True)])
    return result


SCHEMA = "doc_id long, sample int, n_tokens long, ids binary, log_prob double, perturbed double, inclusion double"
DECODED = "text_chars long, text_crc32 long"


def sample_pieces(docs: DataFrame, model: str, k: int = 2, alpha: float = 1.0, seed: int = 1, decoded: bool = False) -> DataFrame:
    """k distinct segmentations of every text, ids as little-endian unsigned 32-bit integers.

    With `decoded`, each sample's ids are decoded again, and the length and CRC of that text are given besides.
    """
    schema = f"{SCHEMA}, {DECODED}" if decoded else SCHEMA
    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.float64(), pa.float64(), pa.float64(), pa.int64(), pa.int64())

    def run(batches):
        lat = Lattices.get(model, alpha)
        for keys, texts in text_batches(batches):
            every = [(key, s, *x) for key, found in zip(keys, sample_texts(lat, keys, texts, k, seed), strict=True) for s, x in enumerate(found)]
            again = [(len(t), zlib.crc32(t.encode())) for t in lat.decode([x[2] for x in every])] if decoded else [()] * len(every)
            rows = [(key, s, len(ids), ids.tobytes(), lp, g, pi, *more) for (key, s, ids, lp, g, pi), more in zip(every, again, strict=True)]
            names = [f.split()[0] for f in schema.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=False)], names=names)

    return clean(docs, "doc_id", "text").mapInArrow(run, schema)


def decode_pieces(samples: DataFrame, model: str) -> DataFrame:
    """(doc_id, sample, text_chars, text_crc32, text) of each row's ids."""

    def run(batches):
        lat = Lattices.get(model, 1.0)
        for batch in batches:
            texts = lat.decode([np.frombuffer(raw, "<u4") for raw in batch.column(2).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([len(t) for t in texts], pa.int64()), pa.array([zlib.crc32(t.encode()) for t in texts], pa.int64()), pa.array(texts, pa.string())], names=["doc_id", "sample", "text_chars", "text_crc32", "text"])

    return samples.select("doc_id", "sample", "ids").mapInArrow(run, f"doc_id long, sample int, {DECODED}, text string")
