"""SentencePiece encoding by sampled segmentations, and decoding.

Gumbel top-k without replacement: every segmentation of a text has its log probability in the lattice plus Gumbel noise, and
the k largest are wanted. The search is A-star over sets of segmentations: the largest perturbed value in a set is drawn
without looking into it, which is an exact bound, so the best set is opened first and its best member is the next sample.
A sample is drawn piece by piece; at each piece the set of all segmentations that leave it there goes on the queue, its
value drawn as a Gumbel variable cut off at the sample's own. Samples are distinct by construction. Each comes with its
inclusion score: the chance that it is among the samples, given the (k + 1)-th value.

All draws are hashes of (seed, row key, sample, place), so retries and other partitionings give the same samples. Steps run
on whole arrays, over the texts of a block together; the lattice of a unit is built once and kept, within a bound, for the blocks that follow.

Units: a run of spaces with what follows, up to the next space; pieces do not cross units. Units of more than MAX_UNIT
characters are cut every MAX_UNIT. A character without a piece is spelled in byte pieces, so every text can be encoded, and
decoding gives back the text. The vocabulary's scores are ranks; a piece's log probability is -log(rank + SHIFT).
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hindcast.llm.common import byte_slices, id_text, released, text_of
from hindcast.llm.wordhash import mix, run_hashes, upto_hashes

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE, LITERAL = 0x2581, 0x110000  # the mark of a space; the character that looks like it, which only bytes spell
MAX_UNIT, SHIFT, BYTE_LOSS, MOST_GIFT = 24, 10.0, 11.0, 20.0
BLOCK_CHARS, LATTICE_CODES, SPELLED = 1 << 16, 3 << 16, 1 << 18  # SPELLED: pieces put together at a time, or one text's
SAMPLES = 8  # per text: the search opens as many sets less one
WIDTH, SLOT_BITS = 16, 20
WALKED, ROWS = 1 << 16, 1 << 11  # units walked together; characters whose edges are worked out together
# A Gumbel draw is below MOST_GUMBEL, since uniform draws are below 1 - 2^-54. So sets with a log probability under -NEAR have
# values far under those of the best, and are drawn only if the best ever come down to what they can reach.
NEAR, MOST_GUMBEL = 45.0, 37.5
_BASE = 0x9E3779B97F4A7C15
_BYTES = np.uint64(0x0101010101010101)


@dataclass
class Vocabulary:
    """Hashes of all beginnings of pieces, sorted; the piece that each one is, or -1; and pieces by number."""

    keys: np.ndarray
    piece: np.ndarray
    score: np.ndarray
    longest: int
    byte_piece: np.ndarray
    text: list[bytes]
    slots: np.ndarray  # by the upper bits of a key: the first key with these bits
    crowd: int  # the most keys that share these bits

    def find(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place among the keys, whether it is there)."""
        at = self.slots[key >> np.uint64(64 - SLOT_BITS)]
        there = self.keys[at] == key
        for _ in range(self.crowd - 1):
            next_ = np.minimum(at + 1, len(self.keys) - 1)
            at = np.where(there, at, next_)
            there = self.keys[at] == key
        return at, there


def _hash_all(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return mix(run_hashes(mix(codes.astype(np.uint64) + np.uint64(1)), starts, ends, _BASE) + (ends - starts).astype(np.uint64))


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def load(path: str = MODEL) -> Vocabulary:
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    size = sp.get_piece_size()
    byte_piece, text, score, names = np.zeros(256, np.int32), [], np.zeros(size), {}
    for i in range(size):
        name = sp.id_to_piece(i)
        if sp.is_byte(i):
            byte_piece[int(name[3:5], 16)] = i
            text.append(bytes([int(name[3:5], 16)]))
        elif sp.is_control(i) or sp.is_unknown(i):
            text.append(b"")
        else:
            text.append(name.replace(chr(SPACE), " ").encode())
            names[name] = i
            score[i] = -np.log(-sp.get_score(i) + SHIFT)
    beginnings = sorted({name[:k] for name in names for k in range(1, len(name) + 1)})
    codes = _codes("".join(beginnings))
    ends = np.cumsum([len(b) for b in beginnings])
    keys = _hash_all(codes, ends - [len(b) for b in beginnings], ends)
    order = np.argsort(keys)
    keys = keys[order]
    piece = np.array([names.get(b, -1) for b in beginnings], np.int32)
    slots = np.searchsorted(keys, np.arange(1 << SLOT_BITS, dtype=np.uint64) << np.uint64(64 - SLOT_BITS))
    crowd = int(np.bincount((keys >> np.uint64(64 - SLOT_BITS)).astype(np.int64)).max())
    longest = max(map(len, beginnings))
    if longest > WIDTH:
        raise ValueError(f"pieces of more than {WIDTH} characters are not provided for")
    return Vocabulary(keys, piece[order], score, longest, byte_piece, text,
                      np.minimum(slots, len(keys) - 1).astype(np.int32), crowd)


FAR = np.uint64(1 << 60)  # places beyond those of units and steps


def _stream(seed: int, keys: np.ndarray, number: int) -> np.ndarray:
    """Where each key's draws of one kind begin."""
    return mix(mix(keys + np.uint64(seed)) + np.uint64(number))


def _uniform(place: np.ndarray) -> np.ndarray:
    """In (0, 1), from the place alone."""
    x = mix(place)
    x >>= np.uint64(11)
    out = x.astype(np.float64)
    out += 0.5
    out *= 2.0**-53
    return out


def _gumbel(u: np.ndarray) -> np.ndarray:
    return -np.log(-np.log(u))


class Lattice:
    """The distinct units' characters one after the other; an edge leaves a character by its next 1 to WIDTH characters and
    has the number character * WIDTH + length - 1. ``chance`` is an edge's probability given its character, by the sums over
    all ways from its end to the unit's end, 0 where there is no piece; ``upto`` that of all edges up to it, ``rest`` that of all others.

    Units stay from block to block until there are more than LATTICE_CODES characters; then the lattice starts anew. What
    is known of a unit does not depend on the others, so neither do samples."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary, self.room = vocabulary, 0
        self._clear(LATTICE_CODES)

    def _clear(self, room: int) -> None:
        if room != self.room:  # what is left of earlier units is written over or not looked at
            self.room, self.piece = room, np.zeros((room, WIDTH), np.int32)
            self.chance, self.upto, self.rest = (np.zeros((room, WIDTH), np.float32) for _ in range(3))
        self.used = 0
        self.first, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.names, self.numbers = np.zeros(0, np.uint64), np.zeros(0, np.int64)  # units by hash, sorted

    def units(self, codes: np.ndarray, head: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The number of each unit; new ones are added."""
        names, own, kind = np.unique(_hash_all(codes, head, end), return_index=True, return_inverse=True)
        size = (end - head)[own]
        at = np.searchsorted(self.names, names)
        new = np.append(self.names, np.uint64(0))[at] != names
        new |= at == len(self.names)
        if self.used + size[new].sum() > self.room or self.room > LATTICE_CODES:
            self._clear(max(LATTICE_CODES, int(size.sum())))
            at, new = np.zeros(len(names), np.int64), np.ones(len(names), bool)
        number = np.zeros(len(names), np.int64)
        number[~new] = self.numbers[at[~new]]
        if new.any():
            by_size = np.flatnonzero(new)[np.argsort(size[new], kind="stable")]
            number[by_size] = len(self.first) + np.arange(len(by_size))
            own, size = own[by_size], size[by_size]
            flat = np.repeat(head[own] - (np.cumsum(size) - size), size) + np.arange(size.sum())
            self.first = np.append(self.first, self.used + np.cumsum(size) - size)
            self.size = np.append(self.size, size)
            self._add(codes[flat], size)
            self.names = np.insert(self.names, at[new], names[new])
            self.numbers = np.insert(self.numbers, at[new], number[new])
        return number[kind]

    def _add(self, codes: np.ndarray, size: np.ndarray) -> None:
        """The characters of new units, which come by size."""
        v, n_codes = self.vocabulary, len(codes)
        pieces, weight = self.piece[self.used:self.used + n_codes], np.zeros((n_codes, WIDTH))
        self.used += n_codes
        end = np.repeat(np.cumsum(size), size)
        open_, given = np.arange(n_codes), np.zeros(n_codes)
        mixed = mix(codes.astype(np.uint64) + np.uint64(1))
        total = upto_hashes(mixed, _BASE)
        alone = np.full(n_codes, -np.inf)
        for n in range(1, v.longest + 1):
            open_ = open_[open_ + n <= end[open_]]
            if not len(open_):
                break
            if n > 1:
                given[open_] += own_gift[open_ + n - 1]
            at, there = v.find(mix(run_hashes(mixed, open_, open_ + n, _BASE, total) + np.uint64(n)))
            open_, at = open_[there], v.piece[at[there]]
            whole, at = open_[at >= 0], at[at >= 0]
            pieces[whole, n - 1] = at
            if n > 1:
                weight[whole, n - 1] = np.exp(v.score[at] + given[whole])
                continue
            alone[whole] = v.score[at]
            # Characters without a piece: their code below zero stands for their bytes.
            bare = np.flatnonzero(np.isinf(alone))
            code = codes[bare].astype(np.int64)
            width = 1 + (code > 0x7F).astype(int) + (code > 0x7FF) + ((code > 0xFFFF) & (code < LITERAL))
            pieces[bare, 0], alone[bare] = -1 - code, -BYTE_LOSS * width
            # Each character gives its edges a factor, the same for all ways through it, so that sums stay in range.
            own_gift = np.minimum(-alone, MOST_GIFT)
            given[:] = own_gift
            weight[:, 0] = np.exp(alone + own_gift)
        # From the units' ends back, those that reach so far together: ``total`` is the sum of all ways from a character to
        # the end, with a place more per unit, for the end itself.
        head = self.used - n_codes
        ends, skipped = np.cumsum(size), np.arange(len(size))
        total = np.ones(n_codes + len(size) + WIDTH)
        onward = np.lib.stride_tricks.sliding_window_view(total[1:], WIDTH)  # the totals after each place
        for left in range(1, int(size[-1]) + 1 if len(size) else 1):
            far = int(np.searchsorted(size, left))  # units come by size
            at, w = ends[far:] - left, min(left, WIDTH)
            place = at + skipped[far:]
            total[place] = (weight[at, :w] * onward[place, :w]).sum(axis=1)
        place = np.arange(n_codes) + np.repeat(skipped, size)
        for lo in range(0, n_codes, ROWS):
            own = place[lo:lo + ROWS]
            value = weight[lo:lo + ROWS]
            value *= onward[own]
            value /= total[own][:, None]
            rows = slice(head + lo, head + lo + len(own))
            self.chance[rows] = value
            # All edges but one, added up without it, so that the sum keeps its digits.
            after = np.zeros((len(own), WIDTH))
            for n in range(WIDTH - 1, 0, -1):
                np.add(after[:, n], value[:, n], out=after[:, n - 1])
            for n in range(1, WIDTH):
                value[:, n] += value[:, n - 1]
            self.upto[rows] = value
            others = self.rest[rows]
            others[:, 0] = 0
            others[:, 1:] = value[:, :-1]
            others[:, :-1] += after[:, :-1]

    def walk(self, at: np.ndarray, end: np.ndarray, draw) -> tuple[np.ndarray, np.ndarray]:
        """From each character to its unit's end: (edges, by character and then step; where each character's begin, with one
        entry more). ``draw(which, step)`` are uniform."""
        count, found, step = np.zeros(len(at), np.int64), [], 0
        which = np.flatnonzero(at < end)
        at, end = at.take(which), end.take(which)
        while len(which):
            upto = self.upto.take(at, axis=0)
            u = (draw(which, step) * upto[:, -1]).astype(np.float32)
            # How many sums are not above u: a row's 16 truth values are two words, whose bytes are added up.
            words = (upto <= u[:, None]).view(np.uint64)
            length = words[:, 0] + words[:, 1]
            length *= _BYTES
            length >>= np.uint64(56)
            length = length.view(np.int64)
            bad = np.flatnonzero(length == WIDTH)
            if len(bad):
                length[bad] = self.chance[at[bad]].argmax(axis=1)
            found.append((which, at * WIDTH + length))
            count[which] = step = step + 1
            at += length
            at += 1
            on = np.flatnonzero(at < end)
            which, at, end = which.take(on), at.take(on), end.take(on)
        first = np.append(0, np.cumsum(count))
        edges = np.empty(first[-1], np.int64)
        for i, (which, edge) in enumerate(found):
            edges[first.take(which) + i] = edge
        return edges, first


def _units(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes, where units start, how many units each text has), each text with a space before it."""
    parts = [np.concatenate([[np.uint32(SPACE)], np.where((c := _codes(t)) == 32, SPACE, np.where(c == SPACE, LITERAL, c))])
             for t in texts]
    sizes = np.array([len(p) for p in parts])
    codes = np.concatenate(parts).astype(np.uint32)
    first = np.cumsum(sizes) - sizes
    space = codes == SPACE
    new = space.copy()
    new[1:] &= ~space[:-1]
    new[first] = True
    head = np.flatnonzero(new)
    long_ = np.diff(np.append(head, len(codes)))
    if long_.max() > MAX_UNIT:
        cuts = -(-long_ // MAX_UNIT)
        base = np.repeat(head, cuts)
        head = base + MAX_UNIT * (np.arange(len(base)) - np.repeat(np.cumsum(cuts) - cuts, cuts))
    return codes, head, np.diff(np.searchsorted(head, np.append(first, len(codes))))


class _Path:
    """A sample of every text, and the sets that leave it, each at a step of its own: text, step, unit, edge, the log
    probability before the step and the set's value, by text and then step. Edges are ``head`` of the text and then
    [``lo``, ``hi``) of the walk with the sample's number; ``start`` is the log probability before ``lo``. Steps from
    ``near`` on have no values yet; theirs are below ``far``."""

    def __init__(self, value: np.ndarray, lo: np.ndarray, hi: np.ndarray, head: dict[int, np.ndarray], start: np.ndarray):
        self.value, self.lo, self.hi, self.head, self.start = value, lo, hi, head, start
        self.near, self.far = lo.copy(), np.full(len(lo), -np.inf)
        self.first, self.sets = np.zeros(len(lo) + 1, np.int64), []
        self.gone: dict[int, list[int]] = {}  # by text: edges ruled out at the step where the path branched
        self.branch: dict[int, int] = {}

    def add(self, *sets: np.ndarray) -> None:
        """More sets: (text, step, unit, edge, before, value)."""
        self.sets = [np.concatenate(x) for x in zip(self.sets, sets)] if self.sets else list(sets)
        order = np.argsort(self.sets[0], kind="stable")
        self.sets = [x.take(order) for x in self.sets]
        self.first = np.searchsorted(self.sets[0], np.arange(len(self.lo) + 1))

    def best(self) -> tuple[np.ndarray, np.ndarray]:
        """(largest value, its place among the sets), per text."""
        doc, left = self.sets[0], self.sets[-1]
        most, place = np.full(len(self.lo), -np.inf), np.zeros(len(self.lo), np.int64)
        some = np.flatnonzero(np.diff(self.first))
        if len(some):
            most[some] = np.maximum.reduceat(left, self.first[some])
            hit = np.flatnonzero(left == most.take(doc))[::-1]
            place[doc[hit]] = hit
        return most, place


def _ranges(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which range, number) of all numbers in ranges."""
    size = hi - lo
    which = np.repeat(np.arange(len(lo)), size)
    return which, np.arange(len(which)) + (lo - np.cumsum(size) + size)[which]


def sample_block(lattice: Lattice, texts: Sequence[str], keys: np.ndarray, k: int, seed: int
                 ) -> list[list[tuple[np.ndarray, float, float, float]]]:
    """Per text up to ``k`` of (piece numbers, log probability, perturbed value, inclusion score), best first.

    The draws that lead from a unit's start to its end depend on the sample's number and the unit, not on what came before. So
    all samples walk through all units together, and a sample takes what follows the unit in which it branches."""
    codes, head, n_units = _units(texts)
    kind = lattice.units(codes, head, np.append(head[1:], len(codes)))
    docs, n_heads = np.arange(len(texts)), len(head)
    text_of_unit = np.repeat(docs, n_units)
    first_unit = np.append(0, np.cumsum(n_units))
    start = lattice.first[kind]
    stop = start + lattice.size[kind]
    keys = keys.astype(np.uint64)
    chance, rest = lattice.chance.ravel(), lattice.rest.ravel()
    local = (np.arange(n_heads) - first_unit[text_of_unit]).astype(np.uint64) * np.uint64(64)

    def walked(units: np.ndarray, at: np.ndarray, numbers: Sequence[int]):
        """Walks from the characters ``at`` of units, once for each number."""
        base = np.concatenate([_stream(seed, keys, n * 2 + 2)[text_of_unit[units]] + local[units] for n in numbers])
        return lattice.walk(np.tile(at, len(numbers)), np.tile(stop[units], len(numbers)),
                            lambda w, s: _uniform(base.take(w) + np.uint64(s)))

    # By number: edges, where each unit's begin, and the log probability lost before each edge.
    walks: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    every, together = np.arange(n_heads), max(1, WALKED // n_heads)
    for lo in range(0, k, together):
        numbers = range(lo, min(lo + together, k))
        edges, first = walked(every, start, numbers)
        for i in range(len(numbers)):
            own = first[i * n_heads:(i + 1) * n_heads + 1]
            edge = edges[own[0]:own[-1]]
            lost = np.zeros(len(edge) + 1)
            np.cumsum(-np.log(chance.take(edge).astype(np.float64)), out=lost[1:])
            walks.append((edge, own - own[0], lost))
        del edges

    def drawn(number: int, doc: np.ndarray, value: np.ndarray, place: np.ndarray, log_mass: np.ndarray) -> np.ndarray:
        """Values of sets, below the value of the set that they are part of."""
        out = np.full(len(doc), -np.inf)
        some = np.flatnonzero(np.isfinite(log_mass))
        own = doc[some]
        noise = _gumbel(_uniform(_stream(seed, keys, number * 2 + 1)[own] + place[some]))
        out[some] = -np.logaddexp(-value[own], -(log_mass[some] + noise))
        return out

    def log_rest(edge: np.ndarray) -> np.ndarray:
        with np.errstate(divide="ignore"):
            return np.log(rest.take(edge).astype(np.float64))

    def draw_tail(path: _Path, number: int, own: np.ndarray, floor: float) -> None:
        """Values for the steps of texts ``own`` from ``near`` on whose log probability before is ``floor`` or more."""
        edges, unit_first, lost = walks[number]
        lo, hi = path.near[own], path.hi[own]
        upto = lost[path.lo[own]] + path.start[own]  # the log probability before a step is this less what is lost
        till = np.clip(np.searchsorted(lost, upto - floor, "right"), lo, hi) if floor > -np.inf else hi
        which, at = _ranges(lo, till)
        doc, edge = own[which], edges[at]
        step = at - path.lo[doc] + np.array([len(path.head.get(d, ())) for d in own.tolist()], np.int64)[which]
        before = upto[which] - lost[at]
        path.add(doc, step, np.searchsorted(unit_first, at, "right") - 1, edge, before,
                 drawn(number, doc, path.value, step.astype(np.uint64), before + log_rest(edge)))
        path.near[own] = till
        path.far[own] = np.where(till < hi, upto - lost[till] + MOST_GUMBEL, -np.inf)

    def found(paths: list[_Path]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(value, path, place among its sets) of each text's best set; values that may matter are drawn first."""
        best = [p.best() for p in paths]
        most = np.max([m for m, _ in best], axis=0)
        for number, p in enumerate(paths):
            late = np.flatnonzero((p.far > -np.inf) & (p.far >= most))
            if len(late):
                draw_tail(p, number, late, -np.inf)
                best[number] = p.best()
        values = np.stack([m for m, _ in best])
        source = values.argmax(axis=0)
        return values[source, docs], source, np.stack([x for _, x in best])[source, docs]

    top = _gumbel(_uniform(_stream(seed, keys, 0)))
    paths = [_Path(top, walks[0][1][first_unit[:-1]], walks[0][1][first_unit[1:]], {}, np.zeros(len(docs)))]
    draw_tail(paths[0], 0, docs, -NEAR)
    taken = [docs]
    bound = np.full(len(docs), -np.inf)
    alive = np.ones(len(docs), bool)
    for number in range(1, k + 1):
        value, source, pick = found(paths)
        alive &= value > -np.inf
        live = docs[alive]
        if number == k or not len(live):
            bound = value
            break
        gone, heads = {}, {}
        place, branch_unit, before = np.zeros(len(live), np.int64), np.zeros(len(live), np.int64), np.zeros(len(live))
        for i, (d, n, s) in enumerate(zip(live.tolist(), source[live].tolist(), pick[live].tolist())):
            p = paths[n]
            _, step, unit, edge, prob, left = p.sets
            place[i], branch_unit[i], before[i] = step[s], unit[s], prob[s]
            gone[d] = [*(p.gone[d] if p.branch.get(d) == step[s] else ()), int(edge[s])]
            left[s] = -np.inf
        # Another edge at the character where each text's path branches, by the chances of those that are not gone.
        node = np.array([gone[d][-1] for d in live.tolist()]) // WIDTH
        open_ = lattice.chance.take(node, axis=0)
        for i, d in enumerate(live.tolist()):
            open_[i, [e % WIDTH for e in gone[d]]] = 0
        mass = np.cumsum(open_, axis=1)
        turn = _uniform(_stream(seed, keys[live], number * 2 + 2) + FAR) * mass[:, -1]
        right = (open_ > 0) & (mass >= turn[:, None])
        length = np.where(right.any(axis=1), right.argmax(axis=1), WIDTH - 1 - (open_[:, ::-1] > 0).argmax(axis=1))
        alt = node * WIDTH + length
        open_[np.arange(len(live)), length] = 0
        others = np.cumsum(open_, axis=1)[:, -1]
        # The rest of the unit in which the path branches, on from there.
        tail, tail_first = walked(branch_unit, node + length + 1, [number])
        edges, unit_first, lost = walks[number]
        for i, d in enumerate(live.tolist()):
            p = paths[source[d]]
            old = p.head.get(d, alt[:0])
            more = p.lo[d] + place[i] - len(old)
            heads[d] = np.concatenate([old[:place[i]], walks[source[d]][0][p.lo[d]:max(more, p.lo[d])], alt[i:i + 1],
                                       tail[tail_first[i]:tail_first[i + 1]]])
        lo, hi = (np.zeros(len(docs), np.int64) for _ in range(2))
        lo[live], hi[live] = unit_first[branch_unit + 1], unit_first[first_unit[live + 1]]
        log = np.log(chance.take(tail).astype(np.float64))
        run = np.append(0, np.cumsum(log))
        after = before + np.log(chance.take(alt).astype(np.float64))
        start_ = np.zeros(len(docs))
        start_[live] = after + run[tail_first[1:]] - run[tail_first[:-1]]
        path = _Path(value, lo, hi, heads, start_)
        # What is left where it branched: all edges but those gone.
        with np.errstate(divide="ignore"):
            left = drawn(number, live, value, np.full(len(live), FAR), before + np.log(others))
        path.add(live, place, branch_unit, alt, before, left)
        which, at = _ranges(tail_first[:-1], tail_first[1:])
        step = place[which] + 1 + at - tail_first[which]
        inner = after[which] + run[at] - run[tail_first[which]]
        path.add(live[which], step, branch_unit[which], tail, inner,
                 drawn(number, live[which], value, step.astype(np.uint64), inner + log_rest(tail)))
        draw_tail(path, number, live, -NEAR)
        path.gone, path.branch = gone, dict(zip(live.tolist(), place.tolist()))
        paths.append(path)
        taken.append(live)
    out: list[list] = [[] for _ in texts]
    piece, parts = lattice.piece.ravel(), []
    for p, t, (edges, _, _) in zip(paths, taken, walks):
        tail = piece.take(edges)
        for d in t.tolist():
            own = tail[p.lo[d]:p.hi[d]]
            parts.append(np.concatenate([piece.take(p.head[d]), own]) if d in p.head else own)
    numbers, first = _spelled(lattice.vocabulary, np.concatenate(parts), np.append(0, np.cumsum([len(x) for x in parts])))
    first, row = first.tolist(), 0
    for p, t, (_, _, lost) in zip(paths, taken, walks):
        total = (p.start + lost[p.lo] - lost[p.hi])[t]
        least = bound[t]
        inclusion = np.where(least > -np.inf, -np.expm1(-np.exp(np.minimum(total - least, 700.0))), 1.0)
        for d, *facts in zip(t.tolist(), total.tolist(), p.value[t].tolist(), inclusion.tolist()):
            out[d].append((numbers[first[row]:first[row + 1]], *facts))
            row += 1
    return out


def _spelled(v: Vocabulary, pieces: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(piece numbers, where each text's begin), with byte pieces for characters that have none."""
    bare = np.flatnonzero(pieces < 0)
    if not len(bare):
        return pieces, first
    kinds, kind = np.unique(pieces[bare], return_inverse=True)
    chars = [chr(SPACE) if -1 - p == LITERAL else chr(-1 - p) for p in kinds.tolist()]
    known = [v.byte_piece[list(c.encode("utf-8", "surrogatepass"))] for c in chars]
    sizes = np.array([len(b) for b in known])
    ends = np.cumsum(sizes)
    size = np.ones(len(pieces), np.int64)
    size[bare] = sizes[kind]
    out = np.repeat(pieces, size)
    out[np.repeat(pieces < 0, size)] = np.concatenate(known)[_ranges((ends - sizes)[kind], ends[kind])[1]]
    return out, np.append(0, np.cumsum(size))[first]


def _gives_back(text: pa.Array, rows: Sequence[tuple[int, np.ndarray]], wanted: Sequence[str]) -> list[bool]:
    """Whether the pieces of each (number, pieces) give back the text of that number; ``text``: what each piece stands for."""
    out: list[bool] = []
    blobs = [b" " + t.encode("utf-8", "surrogatepass") for t in wanted]
    while len(out) < len(rows):
        own, n = [], 0
        while len(out) + len(own) < len(rows) and (not own or n < SPELLED):
            own.append(rows[len(out) + len(own)])
            n += len(own[-1][1])
        spelled = text.take(pa.array(np.concatenate([p for _, p in own])))
        cuts = np.frombuffer(spelled.buffers()[1], np.int32)[np.append(0, np.cumsum([len(p) for _, p in own]))].tolist()
        data = (spelled.buffers()[2] or pa.py_buffer(b"")).to_pybytes()
        out += [data[a:b] == blobs[d] for (d, _), a, b in zip(own, cuts, cuts[1:])]
    return out


def decode_pieces(v: Vocabulary, pieces: Sequence[int]) -> str:
    """The text, without the space that encoding puts before it."""
    return b"".join(map(v.text.__getitem__, pieces)).decode("utf-8", "surrogatepass")[1:]


def encode_documents(docs: DataFrame, k: int = SAMPLES, seed: int = 1, path: str = MODEL) -> DataFrame:
    """(doc_id, sample, pieces, n_pieces, log_prob, perturbed, inclusion, decoded), up to ``k`` rows per document.

    Fewer where a text has fewer segmentations; an empty or null text has the space before it only. ``decoded``: whether the
    pieces give back the text. The row key is the id, a null id that of empty text; rows with one id share their draws. Other
    columns are not looked at; an empty table gives no rows.
    """
    v = load(path)
    kinds = pa.schema([("doc_id", pa.int64()), ("sample", pa.int32()), ("pieces", pa.list_(pa.int32())),
                       ("n_pieces", pa.int32()), ("log_prob", pa.float64()), ("perturbed", pa.float64()),
                       ("inclusion", pa.float64()), ("decoded", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice, text = Lattice(v), pa.array(v.text, pa.binary())
        for batch in batches:
            ids, keys = batch.column(0), batch.column(1).to_numpy(zero_copy_only=False)
            for lo, hi in byte_slices(batch.column(2), BLOCK_CHARS):
                texts = batch.column(2).slice(lo, hi - lo).to_pylist()
                samples = sample_block(lattice, texts, keys[lo:hi], k, seed)
                rows = [(d, i, *s) for d, own in enumerate(samples) for i, s in enumerate(own)]
                size = np.array([len(r[2]) for r in rows])
                lists = pa.ListArray.from_arrays(np.append(0, np.cumsum(size)).astype(np.int32),
                                                 pa.array(np.concatenate([r[2] for r in rows])))
                ok = _gives_back(text, [(r[0], r[2]) for r in rows], texts)
                yield pa.RecordBatch.from_arrays([
                    ids.take(pa.array([lo + r[0] for r in rows])), pa.array([r[1] for r in rows], pa.int32()), lists,
                    pa.array(size, pa.int32()), *[pa.array([r[i] for r in rows]) for i in (3, 4, 5)], pa.array(ok)],
                    schema=kinds)

    schema = ("doc_id long, sample int, pieces array<int>, n_pieces int, log_prob double, perturbed double, inclusion double, "
              "decoded boolean")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(id_text()).alias("key"),
                       text_of().alias("text")).mapInArrow(released(run), schema)


def decode_documents(encoded: DataFrame, path: str = MODEL) -> DataFrame:
    """(doc_id, sample, text) of encoded rows; null pieces give a null text."""
    v = load(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [None if p is None else decode_pieces(v, p) for p in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())],
                                             names=["doc_id", "sample", "text"])

    return encoded.select("doc_id", "sample", "pieces").mapInArrow(run, "doc_id long, sample int, text string")
