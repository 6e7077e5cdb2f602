"""SentencePiece encoding and decoding with the N best segmentations.

A text becomes a lattice of vocabulary pieces; a segmentation's score is the sum of its pieces' scores.
Viterbi scores of every prefix, found forwards, are the exact cost still to come for a search that runs
backwards from the end, so A* pops complete segmentations best first and expands little else.

No piece crosses a blank marker from the left, and none crosses two characters that stand together in no
piece, so the lattice falls into units between such places. Units repeat, and are searched once per task, many
at a time: with exact costs to come, A* takes from every unit's end the entry of the best score until it is at the
begin, and the best of what it passed by is the score of the next segmentation. The N best of a text differ only in
the N - 1 units where that next one costs least: A* gives N of those few, and the text's N best are their best
combinations. They are kept as the best one's ids and what the others change in them.
"""

from __future__ import annotations

import heapq
import re
from array import array
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leakscan.llm import common as C

BLANK = "▁"
#: Stands for a U+2581 of the text itself: no valid text holds a lone surrogate.
LITERAL = "\ud800"
N_BEST = 4
#: Units remembered by a task.
REMEMBERED = 300_000
#: Longest unit whose lattice is searched together with others, and the numbers that such a group's edges may take.
TOGETHER, GROUP = 32, 1 << 20


class Vocabulary:
    """Pieces and scores of a SentencePiece model file; characters in no piece become their UTF-8 bytes' pieces.

    A piece that holds a blank marker after another character would cross units and is refused.
    """

    def __init__(self, pieces: dict[str, tuple[int, float]], byte_ids: list[int] | None, unknown: int = 0, names: dict[int, str] | None = None):
        if crossing := [p for p in pieces if BLANK in p.lstrip(BLANK)]:
            raise ValueError(f"a blank marker inside a piece: {crossing[0]!r}")
        self.pieces, self.byte_ids, self.unknown = pieces, byte_ids, unknown
        self.names = names or {i: p for p, (i, _) in pieces.items()}
        self.fallback = min((s for _, s in pieces.values()), default=0.0) - 10  # of a character in no piece
        self.longest = max(map(len, pieces), default=1)
        self.bigrams = {p[i : i + 2] for p in pieces for i in range(len(p) - 1)}

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(sp.get_piece_size())
        plain = [i for i in ids if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        by_byte = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        has_bytes = all(sp.is_byte(i) for i in by_byte)
        return cls({sp.id_to_piece(i): (i, sp.get_score(i)) for i in plain}, by_byte if has_bytes else None, sp.unk_id(), {i: sp.id_to_piece(i) for i in plain})

    @cached_property
    def byte_of(self) -> dict[int, int]:
        return {i: b for b, i in enumerate(self.byte_ids or [])}

    @cached_property
    def trie(self) -> tuple:
        """Nodes (the children's get, score of the piece that ends here or None)."""
        children: dict[str, dict] = {"": {}}
        root = (children[""].get, None)
        for p in sorted({p[:i] for p in self.pieces for i in range(1, len(p) + 1)}, key=len):
            own = children[p] = {}
            children[p[:-1]][p[-1]] = (own.get, self.pieces[p][1] if p in self.pieces else None)
        return root

    @cached_property
    def steps(self) -> Steps:
        return Steps(self)

    def spelled(self, c: str) -> tuple[int, ...]:
        c = BLANK if c == LITERAL else c
        return tuple(self.byte_ids[b] for b in c.encode()) if self.byte_ids else (self.unknown,)

    def decode(self, ids) -> str:
        """The text of piece ids: blanks for markers, the one before the text dropped, bytes read as UTF-8."""
        out = bytearray()
        for i in ids:
            b = self.byte_of.get(i)
            out += self.names.get(i, "⁇").replace(BLANK, " ").encode() if b is None else bytes([b])
        text = out.decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


# --- one unit's lattice --------------------------------------------------------------------------


def lattice(v: Vocabulary, s: str) -> tuple[list[list[tuple[int, float]]], list[float], list[int]]:
    """Edges (begin, score) into every position, the best score of every prefix, and where the last piece of the
    best segmentation begins (of equal ones the longest)."""
    size, root, longest = len(s), v.trie[0], v.longest
    into: list[list[tuple[int, float]]] = [[] for _ in range(size + 1)]
    best, back = [0.0] + [-float("inf")] * size, [0] * (size + 1)
    for i in range(size):
        here, get, j, alone = best[i], root, i, False
        for c in s[i : i + longest]:
            node = get(c)
            if node is None:
                break
            get, w = node
            j += 1
            if w is not None:
                into[j].append((i, w))
                if here + w > best[j]:
                    best[j], back[j] = here + w, i
                if j == i + 1:
                    alone = True
        if not alone:
            j, w = i + 1, v.fallback
            into[j].append((i, w))
            if here + w > best[j]:
                best[j], back[j] = here + w, i
    return into, best, back


def search(v: Vocabulary, s: str, n: int) -> tuple[list[tuple[float, tuple[int, ...]]], float]:
    """The n best segmentations (score, ids) of s, best first, and the score of the next one (-inf if there is none).

    A* from the end. An open entry's first number is the score of the best segmentation that ends as it does: exact,
    so an entry taken is followed to the begin at once, and of what it passes by only as many entries stay open as
    are still wanted. Of equal scores the one met first goes first: the longest last pieces, then what lies nearer
    to the end. A longer list begins with a shorter one.
    """
    into, best, back = lattice(v, s)
    todo: list[tuple] = [(best[-1], len(s), 0.0, None)]
    out: list[tuple[float, tuple[int, ...]]] = []
    low = -float("inf")
    while todo and len(out) < n:
        _, at, done, path = todo.pop(0)
        room = n - len(out)
        least = todo[-1][0] if len(todo) >= room else low
        while at:
            b, edges, to = back[at], into[at], (at, path)
            for i, w in edges:
                if i == b:
                    own = w
                elif best[i] + w + done > least:
                    f, k = best[i] + w + done, len(todo)
                    while k and todo[k - 1][0] < f:
                        k -= 1
                    todo.insert(k, (f, i, done + w, to))
                    if len(todo) >= room:
                        del todo[room:]
                        least = todo[-1][0]
            path, done, at = to, done + own, b
        ids: list[int] = []
        while path is not None:
            end, path = path
            hit = v.pieces.get(s[at:end])
            ids += (hit[0],) if hit else v.spelled(s[at])
            at = end
        out.append((done, tuple(ids)))
    return out, todo[0][0] if todo else low


class Steps:
    """The trie for many walks at a time: the child of (node, character) by a hash table with linear probing."""

    def __init__(self, v: Vocabulary):
        number = {"": 0}
        for p in v.pieces:
            for k in range(1, len(p) + 1):
                number.setdefault(p[:k], len(number))
        letters = {c: k for k, c in enumerate(sorted({p[-1] for p in number if p}), 1)}
        self.code = np.zeros(0x110000, np.int64)  # 0: in no piece
        self.code[[ord(c) for c in letters]] = list(letters.values())
        self.alone = np.zeros(len(letters) + 1, bool)  # characters that are pieces
        self.alone[[k for c, k in letters.items() if c in v.pieces]] = True
        self.score, self.piece = np.full(len(number), -np.inf), np.zeros(len(number), np.int32)
        for p, (i, score) in v.pieces.items():
            self.score[number[p]], self.piece[number[p]] = score, i
        self.many = len(letters) + 1
        key = np.array([number[p[:-1]] * self.many + letters[p[-1]] for p in number if p], np.int64)
        child = np.array([k for p, k in number.items() if p], np.int64)
        self.bits = max(4, int(np.ceil(np.log2(4 * len(key) + 1))))
        self.keys, self.children = np.full((1 << self.bits) + len(key) + 1, -1, np.int64), np.zeros((1 << self.bits) + len(key) + 1, np.int64)
        at, todo = self._slot(key), np.arange(len(key))
        while len(todo):
            free = todo[self.keys[at[todo]] < 0]
            slots, first = np.unique(at[free], return_index=True)
            self.keys[slots], self.children[slots] = key[free[first]], child[free[first]]
            todo = todo[self.keys[at[todo]] != key[todo]]
            at[todo] += 1

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def child(self, node: np.ndarray, letter: np.ndarray) -> np.ndarray:
        """The nodes reached, -1 where there is none."""
        key = node * self.many + letter
        at = self._slot(key)
        held = self.keys[at]
        out = np.where(held == key, self.children[at], -1)
        on = np.flatnonzero((held != key) & (held >= 0))
        while len(on):
            at[on] += 1
            held = self.keys[at[on]]
            hit = held == key[on]
            out[on[hit]] = self.children[at[on[hit]]]
            on = on[~hit & (held >= 0)]
        return out


def search_all(v: Vocabulary, letters: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """search(n=1) for many units in step: piece ids, their number per unit, the best scores and the next ones' scores.

    letters: a row of character codes per unit, all of which are pieces; size: its length. The sums and the choices
    among equal scores are those of `search`.
    """
    steps, n, width = v.steps, len(size), letters.shape[1]
    longest = min(v.longest, width)
    node_of = np.full((n, width + 1, longest), -1, np.int32)  # the node of the edge into a place, by its length less one
    best, back = np.full((n, width + 1), -np.inf), np.zeros((n, width + 1), np.int64)
    best[:, 0] = 0
    for i in range(width):
        row = np.flatnonzero(size > i)
        node = np.zeros(len(row), np.int64)
        here = best[row, i]
        for k in range(min(longest, width - i)):
            on = size[row] > i + k
            row, node, here = row[on], node[on], here[on]
            node = steps.child(node, letters[row, i + k])
            on = node >= 0
            row, node, here = row[on], node[on], here[on]
            if not len(row):
                break
            w, to = steps.score[node], i + k + 1
            ends = np.flatnonzero(w > -np.inf)
            node_of[row[ends], to, k] = node[ends]
            total = here[ends] + w[ends]
            up = total > best[row[ends], to]
            r = row[ends[up]]
            best[r, to], back[r, to] = total[up], i
    at, done, then = size.copy(), np.zeros(n), np.full(n, -np.inf)
    units, found = [], []
    span = np.arange(1, longest + 1)
    row = np.flatnonzero(at > 0)
    while len(row):
        place = at[row]
        node = node_of[row, place]
        w = np.where(node >= 0, steps.score[node], -np.inf)
        begin = place[:, None] - span
        total = best[row[:, None], np.maximum(begin, 0)] + w + done[row][:, None]
        own = place - back[row, place] - 1
        k = np.arange(len(row))
        total[k, own] = -np.inf
        then[row] = np.maximum(then[row], total.max(axis=1))
        done[row] += w[k, own]
        units.append(row), found.append(steps.piece[node[k, own]])
        at[row] = back[row, place]
        row = row[at[row] > 0]
    unit = np.concatenate([np.zeros(0, np.int64), *units])[::-1]  # pieces were met last first
    order = np.argsort(unit, kind="stable")
    ids = np.concatenate([np.zeros(0, np.int32), *found])[::-1][order]
    return ids, np.bincount(unit, minlength=n), done, then


def combine(places: list[list[float]], n: int) -> list[tuple[float, tuple[int, ...]]]:
    """The n least sums (cost, choice of every place); of equal ones those that keep the first places' best."""
    out: list[tuple[float, tuple[int, ...]]] = [(0.0, ())]
    for costs in places:
        out = heapq.nsmallest(n, [(a + b, r + (k,)) for a, r in out for k, b in enumerate(costs)])
    return out


# --- texts --------------------------------------------------------------------------------------


class Encoder:
    """Encodes texts; remembers the units it has searched."""

    def __init__(self, v: Vocabulary):
        self.v = v
        # a unit begins at a run of blank markers, at a line end unless a piece holds one, and after a letter or
        # digit at a character that no piece holds right after any
        line = "" if any("\n" in p for p in v.pieces) else "\n"
        before: dict[str, set] = {}
        for x, c in v.bigrams:
            if x.isalnum():
                before.setdefault(c, set()).add(x)
        ends = [c for c in ".,;:!?\"')]}%*&#$|" if len(before.get(c, ())) <= 3]
        odd = re.escape("".join(sorted(set().union(*(before.get(c, ()) for c in ends)))))
        ends = re.escape("".join(ends))
        end = f"(?=[{ends}{BLANK}{line}]|\\Z)"
        self.units = re.compile(f"{BLANK}*[^\\W_{odd}]+{end}|{BLANK}*[^{BLANK}{line}]+|{BLANK}+" + (f"|{line}" if line else ""))
        self.reset()

    def reset(self) -> None:
        self.number: dict[str, int] = {}
        self.ids, self.begin, self.size, self.score, self.gap = array("i"), array("q"), array("q"), array("d"), array("d")
        self.others: dict[tuple[int, int], list[tuple[float, tuple[int, ...]]]] = {}
        self.text_of: list[str] = []

    def _cut(self, unit: str) -> list[str]:
        """At every two characters that no piece holds together."""
        b, out, at = self.v.bigrams, [], 0
        for i in range(1, len(unit)):
            if unit[i - 1 : i + 1] not in b:
                out.append(unit[at:i])
                at = i
        return [*out, unit[at:]]

    def _solve(self, new: list[str]) -> None:
        """Searches units that are met for the first time, in their order."""
        steps, size = self.v.steps, np.fromiter(map(len, new), np.int64, len(new))
        flat = steps.code[np.frombuffer("".join(new).encode("utf-32-le", "surrogatepass"), np.uint32)]
        ends = np.cumsum(size)
        odd = np.concatenate([[0], np.cumsum(~steps.alone[flat])])
        together = (size <= TOGETHER) & (odd[ends] == odd[ends - size])
        parts, in_order = [], []
        count, score, gap = np.zeros(len(new), np.int64), np.zeros(len(new)), np.zeros(len(new))
        own = np.flatnonzero(together)
        own = own[np.argsort(size[own], kind="stable")]
        at = 0
        while at < len(own):
            # units of like lengths; a group's edges are bounded by GROUP
            most = size[own[at]] + 1
            stop = min(np.searchsorted(size[own], most, side="right"), at + max(1, GROUP // int((most + 1) * min(most, self.v.longest))))
            group = own[at:stop]
            n = size[group]
            place = np.arange(n.max())
            letters = flat[np.minimum((ends - size)[group][:, None] + place, len(flat) - 1)]
            ids, count[group], score[group], then = search_all(self.v, letters, n)
            gap[group] = np.maximum(0.0, score[group] - then)
            parts.append(ids), in_order.append(group)
            at = stop
        for u in np.flatnonzero(~together).tolist():
            ids, total, least = (), 0.0, float("inf")
            for s in self._cut(new[u]):
                ((best, one),), then = search(self.v, s, 1)
                ids, total, least = ids + one, total + best, min(least, max(0.0, best - then))
            parts.append(np.array(ids, np.int32)), in_order.append(np.array([u]))
            count[u], score[u], gap[u] = len(ids), total, least
        in_order, flat = np.concatenate(in_order), np.concatenate(parts)
        begin = np.empty_like(count)
        begin[in_order] = np.cumsum(count[in_order]) - count[in_order]
        self.begin.frombytes((len(self.ids) + begin).tobytes())
        self.size.frombytes(count.tobytes()), self.score.frombytes(score.tobytes()), self.gap.frombytes(gap.tobytes())
        self.ids.frombytes(flat.tobytes())

    def marked(self, text: str) -> str:
        """With a blank marker before the text and for every space; a U+2581 of the text itself is no marker."""
        return (BLANK + text.replace(BLANK, LITERAL).replace(" ", BLANK)) if text else ""

    def batch(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        """Piece ids of all texts, their offsets, and every text's unit numbers."""
        if len(self.begin) > REMEMBERED:
            self.reset()
        number, numbers = self.number, []
        for t in texts:
            units = self.units.findall(self.marked(t))
            own = list(map(number.get, units))
            if None in own:
                new = dict.fromkeys(u for u, k in zip(units, own, strict=True) if k is None)
                number.update(zip(new, range(len(number), len(number) + len(new)), strict=True))
                self.text_of += new
                own = list(map(number.get, units))
            numbers.append(np.array(own, np.int64))
        if len(self.text_of) > len(self.begin):
            self._solve(self.text_of[len(self.begin) :])
        all_ = np.concatenate(numbers) if numbers else np.zeros(0, np.int64)
        begin, size = np.array(self.begin)[all_], np.array(self.size)[all_]
        ends = np.cumsum(size)
        at = np.repeat(begin - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)
        per = np.array([len(n) for n in numbers])
        offsets = np.concatenate([[0], np.concatenate([[0], ends])[np.cumsum(per)]]) if len(per) else np.zeros(1, np.int64)
        return np.array(self.ids)[at], offsets, numbers

    def best(self, numbers: list[np.ndarray], n: int) -> list[list[float]]:
        """Scores of the n best segmentations of texts of these units, best first."""
        return [[score for score, _ in found] for found in self.choices(numbers, n)]

    def choices(self, numbers: list[np.ndarray], n: int) -> list[list[tuple[float, list[tuple[int, tuple[int, ...]]]]]]:
        """The n best of texts of these units, best first: the score, and (place, ids) of the units that aren't at their best."""
        scores, gaps, out = np.array(self.score), np.array(self.gap), []
        for units in numbers:
            gap, base = gaps[units], float(scores[units].sum())
            k = min(n - 1, len(units))
            near = np.zeros(0, np.int64)
            if k:
                # the least gaps; of equal ones the last places', as `combine` has it
                most = np.partition(gap, k - 1)[k - 1]
                near = np.flatnonzero(gap < most)
                near = np.sort(np.concatenate([near, np.flatnonzero(gap == most)[-(k - len(near)) :]])) if most < np.inf else near
            options = [self._others(int(u), n) for u in units[near]]
            found = combine([[c for c, _ in o] for o in options], n)
            out.append([(base - cost, [(p, o[r][1]) for p, o, r in zip(near.tolist(), options, ranks, strict=True) if r]) for cost, ranks in found])
        return out

    def changes(self, numbers: list[np.ndarray], choices: list) -> pa.Array:
        """What every choice of every text changes in the best one's ids: (at, size, ids), last places first."""
        sizes = np.array(self.size)
        outer, inner, at, size, many, ids = [0], [0], [], [], [0], array("i")
        for units, found in zip(numbers, choices, strict=True):
            ends = np.cumsum(sizes[units])
            for _, changed in found:
                for p, other in reversed(changed):
                    n = int(sizes[units[p]])
                    at.append(int(ends[p]) - n), size.append(n)
                    ids.extend(other)
                    many.append(len(ids))
                inner.append(len(at))
            outer.append(len(inner) - 1)
        i32 = lambda x: pa.array(np.array(x, np.int32))
        rows = pa.StructArray.from_arrays([i32(at), i32(size), pa.ListArray.from_arrays(i32(many), i32(ids))], ["at", "size", "ids"])
        return pa.ListArray.from_arrays(i32(outer), pa.ListArray.from_arrays(i32(inner), rows))

    def _others(self, unit: int, n: int) -> list[tuple[float, tuple[int, ...]]]:
        """The unit's n best segmentations: what they cost over the best, and their ids."""
        if (unit, n) not in self.others:
            parts = [search(self.v, s, n)[0] for s in self._cut(self.text_of[unit])]
            found = combine([[max(0.0, one[0][0] - x) for x, _ in one] for one in parts], n)
            self.others[unit, n] = [(cost, tuple(i for one, r in zip(parts, ranks, strict=True) for i in one[r][1])) for cost, ranks in found]
        return self.others[unit, n]


_LOADED: dict[str, Vocabulary] = {}


def _load(path: str) -> Vocabulary:
    """The model file's vocabulary, read once by a worker."""
    if path not in _LOADED:
        _LOADED[path] = Vocabulary.load(path)
    return _LOADED[path]


def _sources(vocabulary: str | Vocabulary):
    state: dict = {}

    def own() -> Encoder:
        if not state:
            state["e"] = Encoder(vocabulary if isinstance(vocabulary, Vocabulary) else _load(vocabulary))
        return state["e"]

    return own


_CHANGES = T.ArrayType(T.ArrayType(T.StructType([T.StructField("at", T.IntegerType()), T.StructField("size", T.IntegerType()), T.StructField("ids", T.ArrayType(T.IntegerType()))])))


def encode(docs: DataFrame, vocabulary: str | Vocabulary, text: str = "text", n: int = N_BEST) -> DataFrame:
    """`docs` with ids (the best segmentation), n_pieces, and scores and changes of the n best.

    These are best first, and fewer if there are fewer. changes says how each differs from ids: from `at` on (from 0)
    `size` ids give way to `ids`; the first has none, and `n_best` spells all of them out. Of equal scores those go
    first that have the longer last piece in the last place where they differ.
    A blank marker goes before the text and in place of every space. A U+2581 of the text itself is spelled by its
    bytes, as characters in no piece are, so texts come back exactly from a vocabulary with byte pieces. Null and
    empty texts have no ids, and one segmentation of score 0 without ids. Texts are encoded whole. Input columns named
    like an output give way. vocabulary: a model file that every machine has, or a Vocabulary.
    """
    own = _sources(vocabulary)

    def fn(_, texts):
        e = own()
        ids, offsets, units = e.batch(texts.to_pylist())
        found = e.choices(units, n)
        return {
            "ids": pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids)),
            "n_pieces": pa.array(np.diff(offsets).astype(np.int64)),
            "scores": pa.array([[score for score, _ in x] for x in found], pa.list_(pa.float64())),
            "changes": e.changes(units, found),
        }

    fields = [T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("n_pieces", T.LongType()), T.StructField("scores", T.ArrayType(T.DoubleType())), T.StructField("changes", _CHANGES)]
    return C.add_columns(docs, text, fields, fn)


def n_best(ids: Column | str = "ids", changes: Column | str = "changes") -> Column:
    """The ids of all segmentations of `encode`'s rows, best first."""
    own = F.col(ids) if isinstance(ids, str) else ids
    # the last places come first, so what lies before them keeps its place
    step = lambda a, e: F.concat(F.slice(a, F.lit(1), e["at"]), e["ids"], F.slice(a, e["at"] + e["size"] + 1, F.greatest(F.lit(0), F.size(a) - e["at"] - e["size"])))
    return F.transform(changes, lambda c: F.aggregate(c, own, step))


def decode(encoded: DataFrame, vocabulary: str | Vocabulary, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """`encoded` with the text of each row's ids; null ids give null."""
    own = _sources(vocabulary)
    keep = [f for f in encoded.schema.fields if f.name.lower() != out.lower()]
    names = [f.name for f in keep]

    def run(batches):
        for big in batches:
            for lo in range(0, big.num_rows, 500):
                batch = big.slice(lo, 500)
                v, lists = own().v, batch.column(ids)
                # pieces are joined by Arrow; rows with bytes or unknown ids are spelled one by one
                flat = np.asarray(lists.flatten(), dtype=np.int64)
                size = np.asarray(pc.fill_null(pc.list_value_length(lists), 0), dtype=np.int64)
                table = state.setdefault("t", pa.array([v.names[i].replace(BLANK, " ") if i in v.names else None for i in range(max(v.names, default=0) + 1)], pa.large_string()))
                ok = (flat >= 0) & (flat < len(table))
                parts = table.take(pa.array(np.where(ok, flat, 0)))
                odd = np.asarray(parts.is_null()) | ~ok
                ends = np.cumsum(size)
                offsets = np.concatenate([[0], ends])
                bad = np.concatenate([[0], np.cumsum(odd)])
                text = pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pc.fill_null(parts, "")), pa.scalar("", pa.large_string())).to_pylist()
                for r in np.flatnonzero(bad[offsets[1:]] - bad[offsets[:-1]]).tolist():
                    text[r] = None
                values = [None if null else v.decode(flat[a:b].tolist()) if t is None else t[1:] if t.startswith(" ") else t for t, a, b, null in zip(text, offsets[:-1].tolist(), ends.tolist(), lists.is_null().to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in names), pa.array(values, pa.string())], [*names, out])

    state: dict = {}
    return encoded.mapInArrow(run, T.StructType([*keep, T.StructField(out, T.StringType())]))
