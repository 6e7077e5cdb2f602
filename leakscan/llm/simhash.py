"""SimHash near-dedup: 64-bit fingerprints linked within a Hamming radius by BK-trees over shards.

Distinct fingerprints are dealt to shards by pigeonhole: split into blocks, two fingerprints within the
radius agree in some choice of blocks, so each choice and its bits name a shard and every link lies
inside one. A shard is a BK-tree of at most TREE members; a larger shard is dealt again by its other
bits, and what is still too large becomes several trees, to each of which the shard's members are sent.
Trees and their probes meet by a shuffle, so nothing that grows with the corpus passes the driver.
Within a shard each member is linked to one representative per connected group, never to all partners.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leakscan.llm import common as C

TREE = 1024
SEED = 42


# --- fingerprints -------------------------------------------------------------------------------


def fingerprints(docs: DataFrame, text: str = "text", size: int = 3, column: str = "fp") -> DataFrame:
    """`docs` with the SimHash of the lower-cased text's `size`-word shingles, repeats included, as a signed 64-bit column.

    Fewer words: the whole sequence is one shingle. No words or null: 0. A bit is set if it is set in
    over half of the shingles' XXH64 (seed 42).
    """

    def fn(_, texts):
        offsets, flat = C.words(C.translate(texts, C.LOWER))
        n = np.diff(offsets)
        ends = np.cumsum(np.asarray(pc.binary_length(flat), dtype=np.int64) + 1) - 1  # in the words joined by spaces
        begins = np.concatenate([[0], ends[:-1] + 1]) if len(ends) else ends
        data = C.joined(np.array([0, len(flat)]), flat).buffers()[2]
        buf = memoryview(b"" if data is None else data)
        first = C.window_starts(offsets, size)
        short = np.flatnonzero((n > 0) & (n < size))
        s = np.concatenate([begins[first], begins[offsets[short]]])
        e = np.concatenate([ends[first + size - 1], ends[offsets[short + 1] - 1]])
        x = xxhash.xxh64_intdigest
        h = np.fromiter((x(buf[i:j], SEED) for i, j in zip(s.tolist(), e.tolist(), strict=True)), "<u8", len(s))
        row = np.concatenate([C.rows_of(offsets)[first], short])
        order = np.argsort(row, kind="stable") if len(short) else slice(None)
        h, row = h[order], row[order]
        out = np.zeros(len(n), np.uint64)
        if len(h):
            at = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
            count = np.diff(np.append(at, len(h)))
            half = np.zeros((len(at), 64), bool)
            for lo in range(0, 64, 8):  # eight bits at a time keep the table small
                bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8)[:, lo // 8 : lo // 8 + 1], axis=1, bitorder="little")
                half[:, lo : lo + 8] = 2 * np.add.reduceat(bits, at, axis=0, dtype=np.int64) > count[:, None]
            out[row[at]] = np.packbits(half, axis=1, bitorder="little").view("<u8").ravel()
        return {column: pa.array(out.view(np.int64))}

    return C.add_columns(docs, text, [T.StructField(column, T.LongType())], fn)


# --- BK-trees -----------------------------------------------------------------------------------


class BKTree:
    """Distinct integers; a node's children are keyed by their Hamming distance to it."""

    def __init__(self):
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def add(self, value: int) -> None:
        new = len(self.values)
        if new:
            at = 0
            while True:
                d = (self.values[at] ^ value).bit_count()
                if not d:
                    return
                nxt = self.children[at].setdefault(d, new)
                if nxt == new:
                    break
                at = nxt
        self.values.append(value)
        self.children.append({})

    def within(self, value: int, radius: int) -> list[int]:
        """Node numbers at most `radius` away: only edges in [d - radius, d + radius] can lead there."""
        found, todo = [], [0] if self.values else []
        while todo:
            at = todo.pop()
            d = (self.values[at] ^ value).bit_count()
            if d <= radius:
                found.append(at)
            todo += [c for k, c in self.children[at].items() if d - radius <= k <= d + radius]
        return found


def _links(radius: int):
    """Arrow function over rows (shard, probe, fp) sorted by shard, members before probes: star edges."""

    def close(tree, parent):
        for i, p in enumerate(parent):
            if p != i:
                yield tree.values[i], tree.values[root(parent, i)]

    def root(parent, i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    def run(batches):
        now, tree, parent, linked = None, None, None, False
        a, b = [], []

        def join(found):
            """Unites the groups of `found`; the number of one of them."""
            top = root(parent, found[0])
            for i in found[1:]:
                r = root(parent, i)
                if r != top:
                    parent[max(r, top)] = top = min(r, top)
            return top

        def finish():
            if tree is not None:
                if not linked:
                    settle()
                for x, y in close(tree, parent):
                    a.append(x)
                    b.append(y)

        def settle():
            """All members are in: links among them."""
            if len(tree.values) > 1:
                for v in tree.values:
                    found = tree.within(v, radius)
                    if len(found) > 1:
                        join(found)

        def flush():
            nonlocal a, b
            out = pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])
            a, b = [], []
            return out

        mask = (1 << 64) - 1
        signed = lambda x: x - (1 << 64) if x >> 63 else x
        for batch in batches:
            for shard, probe, fp in zip(*(batch.column(k).to_pylist() for k in ("shard", "probe", "fp")), strict=True):
                if shard != now:
                    finish()
                    now, tree, parent, linked = shard, BKTree(), [], False
                if not probe:
                    tree.add(fp & mask)
                    parent = list(range(len(tree.values))) if len(parent) != len(tree.values) else parent
                    continue
                if not linked:
                    settle()
                    linked = True
                found = tree.within(fp & mask, radius)
                if found:
                    a.append(fp & mask)
                    b.append(tree.values[join(found)])
            if len(a) > 100_000:
                a, b = [signed(x) for x in a], [signed(x) for x in b]
                yield flush()
        finish()
        a, b = [signed(x) for x in a], [signed(x) for x in b]
        yield flush()

    return run


def _deal(width: int, blocks: int, same: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """The choices of `same` of `blocks` bit ranges of `width` bits."""
    cuts = [width * i // blocks for i in range(blocks + 1)]
    return [(k, [(cuts[i], cuts[i + 1]) for i in c]) for k, c in enumerate(combinations(range(blocks), same))]


def _bits(ranges: list[tuple[int, int]]):
    """The fingerprint's bits outside which all else is masked."""
    m = sum(((1 << (hi - lo)) - 1) << lo for lo, hi in ranges)
    return F.col("fp").bitwiseAND(F.lit(m - (1 << 64) if m >> 63 else m))


def links(values: DataFrame, radius: int = 3, tree: int = TREE) -> DataFrame:
    """Star edges (a, b) whose components are those of all links at most `radius` bits long.

    values: distinct non-null signed 64-bit integers in column fp.
    """
    scratch = C.Scratch(values.sparkSession)
    n = values.count()
    # choices whose shards would hold about 256 of n random fingerprints, or the finest
    blocks = next((b for b in range(radius + 1, radius + 4) if n >> (64 * (b - radius) // b) <= 256), radius + 3)
    choices = _deal(64, blocks, blocks - radius)
    shards = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), _bits(r).alias("v")) for k, r in choices]))
    dealt = values.select("fp", shards.alias("s")).select("fp", F.concat_ws(":", F.col("s.k"), F.hex("s.v")).alias("shard"))
    sizes = scratch.save(dealt.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1))
    dealt = dealt.join(sizes, "shard")  # a shard of one has no links
    if not sizes.where(F.col("n") > tree).isEmpty():
        # the bits left over decide again: links differ in at most `radius` of radius + 1 further ranges
        again = []
        for k, ranges in choices:
            rest = [i for i in range(64) if not any(lo <= i < hi for lo, hi in ranges)]
            for j, own in _deal(len(rest), radius + 1, 1):
                bits = [(rest[i], rest[i] + 1) for lo, hi in own for i in range(lo, hi)]
                again.append(F.when(F.split("shard", ":")[0] == str(k), F.concat_ws(":", "shard", F.lit(j), F.hex(_bits(bits)))))
        large = dealt.where(F.col("n") > tree).select("fp", F.explode(F.filter(F.array(*again), lambda x: x.isNotNull())).alias("shard"))
        own = scratch.save(large.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1))
        dealt = dealt.where(F.col("n") <= tree).unionByName(large.join(own, "shard"))
    parts = F.ceil(F.col("n") / tree).cast("int")
    part = F.pmod(F.xxhash64("fp"), parts).cast("int")
    member = F.array(F.struct(part.alias("part"), F.lit(False).alias("probe")))
    others = F.transform(F.sequence(F.lit(0), parts - 1), lambda p: F.struct(p.alias("part"), F.lit(True).alias("probe")))
    roles = F.when(parts == 1, member).otherwise(F.concat(member, F.filter(others, lambda x: x["part"] != part)))
    rows = dealt.select("shard", "fp", F.explode(roles).alias("r")).select(F.concat_ws("/", "shard", "r.part").alias("shard"), "r.probe", "fp")
    return rows.repartition("shard").sortWithinPartitions("shard", "probe").mapInArrow(_links(radius), "a long, b long").distinct()


def label(ids: DataFrame, id: str = "doc_id", fp: str = "fp", radius: int = 3) -> DataFrame:
    """`ids` (id, fp) with component_id, the smallest id reachable by links, the row's own included.

    Rows with equal fingerprints are linked whatever their texts, the zero fingerprint like any other. One fingerprint
    or component may hold most rows. `ids` is read several times and should be a written table.
    Null ids count as largest: a component of null ids only has a null component_id.
    """
    first = ids.where(F.col(fp).isNotNull()).groupBy(F.col(fp).alias("fp")).agg(F.min(id).alias("_first"))
    roots = C.components(links(first.select("fp"), radius))
    scratch = C.Scratch(ids.sparkSession)
    rooted = scratch.save(first.join(roots, first["fp"] == roots["node"], "left").select("fp", "_first", F.coalesce("root", "fp").alias("_root")))
    least = scratch.save(rooted.groupBy("_root").agg(F.min("_first").alias("component_id")))
    of = scratch.save(C.lookup(rooted, least, "_root").select(F.col("fp").alias(fp), "component_id"))
    return C.lookup(ids, of, fp)


def near_duplicates(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row (id, fp, component_id) per row of `docs`. See `fingerprints` and `label` for odd cases."""
    ids = C.Scratch(docs.sparkSession).save(fingerprints(docs.select(id, text), text).select(id, "fp"))
    return label(ids, id)


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of every component: that of the smallest doc_id, and of the texts under it the one whose SHA-256 is smallest.

    Equal rows count once. Rows with a null id stay.
    """
    # a null id counts as largest
    row = lambda: F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.coalesce(F.sha2("text", 256), F.lit("")).alias("text_hash"))
    ids = near_duplicates(docs.select(row().alias("row"), "text"), "row")
    gone = ids.where(~F.col("row.none") & (F.col("row") != F.col("component_id"))).select("row.id", "row.text_hash")
    rows = docs.where(F.col("doc_id").isNotNull()).select(F.struct("*").alias("doc"), row().alias("row")).select("doc", "row.id", "row.text_hash")
    kept = rows.join(gone, ["id", "text_hash"], "left_anti").dropDuplicates(["id", "text_hash"])
    return kept.select("doc.*").unionByName(docs.where(F.col("doc_id").isNull()))
