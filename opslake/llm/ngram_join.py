"""N-gram Jaccard join with set-relation skipping: exact links between texts, reported as components.

A text's set holds its distinct word shingles as 64-bit hashes. Two sets link when 100 * |intersection| >=
percent * |union|. Equal sets are one node, known by a 64-bit hash, and only nodes are joined.

1. Order. A count sketch of bounded size ranks shingles from rare to frequent. Any common order gives exact
   results; a good one keeps frequent shingles out of the prefixes.
2. Index lists. Linked sets share a shingle in their prefixes, whose lengths follow from the threshold. Each
   prefix shingle has a list of (set, size, position).
3. Answers from a similar set. One member of a list is its hub. Members are compared with the hub; those that link
   share its component, and no pair among them has to be looked at again, however many they are. While lists hold
   many pairs of different components, other members take their turn as hubs.
4. Block skipping. What a list holds falls into blocks, one for each component. Pairs of blocks are skipped by
   their ranges of size and position, without reading members. In the others, members are paired unless their known
   distances to the same hub differ by more than the threshold allows (Jaccard distance is a metric), and the
   pairs that remain are compared.

No list, node or component is ever held by one task: minima and ranges are combined before the shuffle and
joins on list keys are left to skew handling. Compared sets travel as 48-bit hashes.

Defined results: a text that is null, empty or without words has an empty set and links with nothing; fewer words
than a shingle has are one shingle; repeated rows are copies of each other; rows without an id take part, and
``component_id`` is the smallest id that is not null; an empty table gives an empty result. Other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial
from itertools import count

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from opslake.llm.components import components
from opslake.session import staged

SKETCH_BITS, FILTER_BITS, SLICES = 23, 26, 64
ROUND_HUBS, FEW_PAIRS = 8, 8
COMMON = 1 / 16
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, *range(9, 14)]] = True
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class Shingles:
    """Sets of distinct word shingles, computed for many texts at a time."""

    def __init__(self, width: int):
        self.width, self.held = width, 0

    def _sized(self, n: int) -> None:
        if n > self.held:
            self.up, self.down = _powers(0x5851F42D4C957F2D, n), _powers(pow(0x5851F42D4C957F2D, -1, 1 << 64), n)
            self.held = n

    def sets(self, texts: list[str | None]) -> list[np.ndarray]:
        """Sorted distinct 64-bit hashes of each text."""
        raw = [(t or "").encode().translate(_LOWER) for t in texts]
        data = np.frombuffer(b" ".join([b"", *raw, b""]), dtype=np.uint8)
        self._sized(len(data) + 1)
        space = _SPACE[data]
        starts = np.flatnonzero(space[:-1] & ~space[1:]) + 1
        ends = np.flatnonzero(~space[:-1] & space[1:]) + 1
        sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum((data + np.uint64(1)) * self.up[:len(data)], out=sums[1:])
        words = _mix((sums[ends] - sums[starts]) * self.down[starts] + (ends - starts).astype(np.uint64) * _ODD)
        first = np.searchsorted(starts, np.cumsum([1, *(len(r) + 1 for r in raw)]))
        w = self.width
        grams = words[:max(len(words) - w + 1, 0)].copy()
        for i in range(1, w):
            grams = _mix(grams * _ODD + words[i:len(words) - w + 1 + i])
        out = []
        for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
            if b - a >= w:
                out.append(np.unique(grams[a:b - w + 1]))
            elif b > a:
                h = np.uint64(b - a)
                for word in words[a:b]:
                    h = _mix(np.array([h], dtype=np.uint64) * _ODD + word)[0]
                out.append(np.array([h], dtype=np.uint64))
            else:
                out.append(np.zeros(0, dtype=np.uint64))
        return out


def _in_groups(column: pa.Array, size: int = 250_000) -> Iterator[tuple[int, list[str | None]]]:
    """Texts of one batch in groups of bounded size, with the place of the first."""
    at, group, held = 0, [], 0
    for i, text in enumerate(column):
        group.append(text.as_py())
        held += len(group[-1] or "")
        if held >= size:
            yield at, group
            at, group, held = i + 1, [], 0
    if group:
        yield at, group


def _fingerprint(s: np.ndarray) -> int:
    """A 64-bit name of a set: the sum of its hashes, mixed again."""
    total = np.append(_mix(s + _ODD), np.uint64(len(s))).sum(dtype=np.uint64)
    return int(_mix(total[None]).astype(np.int64)[0])


def _sketch(docs: DataFrame, text_col: str, width: int) -> np.ndarray:
    """How frequent each range of hashes is, as ``2 ** SKETCH_BITS`` bytes: exact to 127, then on a log scale."""

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, maker, seen = np.zeros(1 << SKETCH_BITS, dtype=np.uint16), Shingles(width), set()
        for batch in batches:
            for _, texts in _in_groups(batch.column(0)):
                for s in maker.sets(texts):
                    if len(s) and (mark := _fingerprint(s)) not in seen:
                        seen.add(mark)  # copies within a task count once
                        np.add.at(total, (s >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), 1)
        pack = zstandard.ZstdCompressor(level=1).compress
        parts = [(i, pack(x.tobytes())) for i, x in enumerate(np.split(total, SLICES)) if x.any()]
        yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in parts], type=pa.int32()),
                                          pa.array([x for _, x in parts], type=pa.binary())], ["slice", "counts"])

    def add(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((1 << SKETCH_BITS) // SLICES, dtype=np.uint64)
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for packed in batch.column("counts"):
                total += np.frombuffer(unpack(packed.as_py()), dtype=np.uint16)
        logs = 128 + np.minimum(127, 4 * (np.log2(np.maximum(total, 128)) - 7))
        level = np.where(total < 128, total, logs).astype(np.uint8)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], type=pa.int32()), pa.array([level.tobytes()])],
                                         ["slice", "levels"])

    counted = docs.select(text_col).mapInArrow(tally, "slice int, counts binary")
    out = np.zeros(1 << SKETCH_BITS, dtype=np.uint8).reshape(SLICES, -1)
    for row in counted.groupBy("slice").applyInArrow(add, "slice int, levels binary").collect():
        out[row["slice"]] = np.frombuffer(row["levels"], dtype=np.uint8)
    return out.ravel()


def _pack(s: np.ndarray) -> bytes:
    return (s & np.uint64(0xFFFFFFFF)).astype("<u4").tobytes() + (s >> np.uint64(32)).astype("<u2").tobytes()


def _unpack(raw: bytes, most: int | None = None) -> np.ndarray:
    n = len(raw) // 6
    k = n if most is None else min(n, most)
    low, high = np.frombuffer(raw, "<u4", k), np.frombuffer(raw, "<u2", k, 4 * n)
    return low.astype(np.uint64) | (high.astype(np.uint64) << np.uint64(32))


def _probe(n, percent: int):
    """How many of a set's rarest shingles a linked set shares at least one of."""
    return n - -(-percent * n // 100) + 1


def _sets(docs: DataFrame, id_col: str, text_col: str, width: int, percent: int) -> DataFrame:
    """Rows (id, mark, n, node, prefix), written once: mark is a hash of the text, node names the set, prefix holds its
    rarest hashes (48 bits each) in order. Whole sets are as large as the texts, so they are not written.

    Of equal sets only the first that a task meets carries its prefix.
    """
    levels = _sketch(docs, text_col, width)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maker, seen = Shingles(width), set()
        for batch in batches:
            for at, texts in _in_groups(batch.column(2)):
                sets = maker.sets(texts)
                nodes, packed = [_fingerprint(s) for s in sets], []
                for s, node in zip(sets, nodes, strict=True):
                    if not len(s) or node in seen:
                        packed.append(None)
                        continue
                    seen.add(node)
                    order = np.lexsort((s, levels[(s >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]))
                    packed.append(_pack(s[order[:_probe(len(s), percent)]] & np.uint64((1 << 48) - 1)))
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(at, len(texts)), batch.column(1).slice(at, len(texts)),
                    pa.array([len(s) for s in sets], type=pa.int64()), pa.array(nodes, type=pa.int64()),
                    pa.array(packed, type=pa.binary())], ["id", "mark", "n", "node", "prefix"])

    made = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("mark"), text_col)
    return staged(made.mapInArrow(run, f"id {kind}, mark long, n long, node long, prefix binary"))


def _postings(sets: DataFrame, percent: int) -> DataFrame:
    """Rows (token, node, n, pos, indexed) of each set's prefix; indexed: the part that a set not smaller can meet."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, sizes = batch.column("node").to_numpy(), batch.column("n").to_numpy()
            index = sizes - -(-2 * percent * sizes // (100 + percent)) + 1
            tokens = [_unpack(h.as_py()) for h in batch.column("prefix")]
            lengths = np.array([len(t) for t in tokens], dtype=np.int64)
            pos = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            yield pa.RecordBatch.from_arrays([
                pa.array(np.concatenate([*tokens, np.zeros(0, np.uint64)]).astype(np.int64)), pa.array(np.repeat(nodes, lengths)),
                pa.array(np.repeat(sizes, lengths).astype(np.int32)), pa.array(pos.astype(np.int32)),
                pa.array(pos < np.repeat(index, lengths))], ["token", "node", "n", "pos", "indexed"])

    return sets.select("node", "n", "prefix").where(F.col("prefix").isNotNull()).mapInArrow(
        run, "token long, node long, n int, pos int, indexed boolean")


def _held(docs: DataFrame, text_col: str, width: int, sets: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows (node, n, hashes) of the wanted nodes (node), written once, each made again from one of its texts.

    Texts are passed over by a bit filter of bounded size over the marks of the wanted, before any set is made.
    """
    low = FILTER_BITS - 6

    def bits(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(1 << low, dtype=bool)
        for batch in batches:
            bits[batch.column("mark").to_numpy() & ((1 << low) - 1)] = True
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], type=pa.int64()), pa.array([np.packbits(bits).tobytes()])],
                                         ["slice", "bits"])

    texts = sets.where(F.col("n") > 0).select("node", "mark").join(wanted, "node", "left_semi").groupBy("node").agg(F.min("mark").alias("mark"))
    part = F.shiftright(F.col("mark"), low).bitwiseAND(F.lit(SLICES - 1)).cast("long")
    marked = np.zeros((SLICES, 1 << low - 3), dtype=np.uint8)
    for row in texts.select("mark", part.alias("slice")).groupBy("slice").applyInArrow(bits, "slice long, bits binary").collect():
        marked[row["slice"]] = np.frombuffer(row["bits"], dtype=np.uint8)
    marked = marked.ravel()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maker, seen = Shingles(width), set()
        for batch in batches:
            place = batch.column(0).to_numpy() & ((1 << FILTER_BITS) - 1)
            kept = batch.filter(pa.array((marked[place >> 3] >> (7 - (place & 7)).astype(np.uint8) & 1).astype(bool)))
            for _, group in _in_groups(kept.column(1)):
                new = {}
                for s in maker.sets(group):
                    if len(s) and (node := _fingerprint(s)) not in seen:
                        seen.add(node)
                        new[node] = s
                yield pa.RecordBatch.from_arrays([
                    pa.array(list(new), type=pa.int64()), pa.array([len(s) for s in new.values()], type=pa.int64()),
                    pa.array([_pack(s & np.uint64((1 << 48) - 1)) for s in new.values()], type=pa.binary())], ["node", "n", "hashes"])

    made = docs.select(F.xxhash64(text_col).alias("mark"), text_col).where(F.col(text_col).isNotNull())
    made = made.mapInArrow(run, "node long, n long, hashes binary")
    return staged(made.join(wanted, "node", "left_semi").dropDuplicates(["node"]))


def _compare(pairs: DataFrame, held_of: Callable[[DataFrame], DataFrame], percent: int) -> DataFrame:
    """Rows (x, y, shared, linked, distance) of distinct pairs (x, y); held_of gives the sets of nodes."""
    held = held_of(staged(pairs.select(F.explode(F.array("x", "y")).alias("node")).distinct()))
    one = held.select(F.col("node").alias("x"), F.col("n").alias("nx"), F.col("hashes").alias("hx"))
    two = held.select(F.col("node").alias("y"), F.col("n").alias("ny"), F.col("hashes").alias("hy"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shared = [len(np.intersect1d(_unpack(a.as_py()), _unpack(b.as_py()), assume_unique=True))
                      for a, b in zip(batch.column("hx"), batch.column("hy"), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("x", "y", "nx", "ny")), pa.array(shared, type=pa.int64())],
                ["x", "y", "nx", "ny", "shared"])

    joined = pairs.join(one, "x").join(two, "y").select("x", "y", "nx", "ny", "hx", "hy")
    counted = joined.mapInArrow(run, "x long, y long, nx long, ny long, shared long")
    union = F.col("nx") + F.col("ny") - F.col("shared")
    return staged(counted.select("x", "y", "shared", (100 * F.col("shared") >= percent * union).alias("linked"),
                                 (1 - F.col("shared") / union).alias("distance")))


def _labelled(rows: DataFrame, labels: DataFrame, name: str) -> DataFrame:
    return rows.join(labels.select("node", F.col("root").alias(name)), "node", "left").withColumn(
        name, F.coalesce(name, "node"))


def _differences(anchored: DataFrame, held: DataFrame, percent: int) -> DataFrame:
    """Rows (hub, hub_n, node, n, linked, elements) of distinct pairs (hub, node), compared on the sets ``held``.

    elements are those of the symmetric difference: twice the hash for what the node has more, and one added for what it lacks.
    They are left out where the hub has no other node.
    """
    several = anchored.groupBy("hub").agg((F.count(F.lit(1)) > 1).alias("several"))
    one = held.select("node", "n", "hashes")
    two = held.select(F.col("node").alias("hub"), F.col("n").alias("hub_n"), F.col("hashes").alias("hub_hashes"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            elements = []
            for a, b in zip(batch.column("hashes"), batch.column("hub_hashes"), strict=True):
                a, b = _unpack(a.as_py()), _unpack(b.as_py())
                more, less = np.setdiff1d(a, b, assume_unique=True), np.setdiff1d(b, a, assume_unique=True)
                elements.append(np.concatenate([more << np.uint64(1), less << np.uint64(1) | np.uint64(1)]).astype(np.int64))
            apart = np.array([len(e) for e in elements], dtype=np.int64)
            elements = [e if kept else e[:0] for e, kept in zip(elements, batch.column("several").to_pylist(), strict=True)]
            sizes = batch.column("n").to_numpy() + batch.column("hub_n").to_numpy()
            linked = (100 + percent) * apart <= (100 - percent) * sizes
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("hub", "hub_n", "node", "n")), pa.array(linked), pa.array(elements, type=pa.list_(pa.int64()))],
                ["hub", "hub_n", "node", "n", "linked", "elements"])

    joined = anchored.join(several, "hub").join(one, "node").join(two, "hub").select(
        "hub", "hub_n", "node", "n", "hashes", "hub_hashes", "several")
    return staged(joined.mapInArrow(run, "hub long, hub_n long, node long, n long, linked boolean, elements array<long>"))


def _firsts(differences: DataFrame, percent: int) -> DataFrame:
    """Rows (hub, node, n, apart, linked, posted, tokens): the first elements of each difference, see ``_met_by_difference``.

    What few nodes of a hub have comes first. Elements that a share of ``COMMON`` of them have are put in order of
    their counts; there are at most ``1 / COMMON`` differences full of them, so a hub's list is bounded.
    """
    open_hubs = differences.groupBy("hub").agg(F.count(F.lit(1)).alias("total"), F.min("linked").alias("all_linked")).where(
        "total > 1 AND NOT all_linked").select("hub", "total")
    differences = differences.join(open_hubs.select("hub"), "hub", "left_semi")
    counted = differences.select("hub", F.explode("elements").alias("token")).groupBy("hub", "token").agg(F.count(F.lit(1)).alias("held"))
    common = counted.where("held > 1").join(open_hubs, "hub").where(F.col("held") >= COMMON * F.col("total")).groupBy("hub").agg(
        F.array_sort(F.collect_list(F.struct("held", "token")))["token"].alias("common"))
    more, less = 100 + percent, 100 - percent

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            hubs, n, m = (batch.column(c).to_numpy() for c in ("hub", "n", "hub_n"))
            linked, held, often = batch.column("linked").to_pylist(), batch.column("elements"), batch.column("common")
            apart, posted, tokens = [], [], []
            for i in range(len(hubs)):
                if last != hubs[i]:
                    listed = np.array(often[i].as_py() or [0], dtype=np.int64)
                    last, by_token = hubs[i], np.argsort(listed)
                    listed = listed[by_token]
                e = np.array(held[i].as_py(), dtype=np.int64)
                at = np.minimum(np.searchsorted(listed, e), len(listed) - 1)
                rank = np.where(listed[at] == e, by_token[at] + 1, 0)
                size = len(e)
                first = size - (more * size + less * int(m[i] - n[i])) // (2 * more)
                every = first if linked[i] else size + 1 - max(1, -(-(more * size - less * int(n[i] + m[i])) // (2 * more)))
                apart.append(size)
                posted.append(first)
                tokens.append(e[np.lexsort((e, e & 1, rank))[:every]])
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("hub", "node", "n")), pa.array(apart, type=pa.int64()), batch.column("linked"),
                 pa.array(posted, type=pa.int64()), pa.array(tokens, type=pa.list_(pa.int64()))],
                ["hub", "node", "n", "apart", "linked", "posted", "tokens"])

    joined = differences.join(common, "hub", "left").select(
        "hub", "hub_n", "node", "n", "linked", "elements", "common")
    return staged(joined.mapInArrow(
        run, "hub long, node long, n long, apart long, linked boolean, posted long, tokens array<long>"))


def _met_by_difference(differences: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """Distinct pairs (x, y) of nodes of one hub and different components that may link; no pair that links is left out.

    |x ^ y| = |dx| + |dy| - 2 |dx & dy| for the differences dx, dy of x and y to their hub, and x links with y if
    (100 + percent) * |x ^ y| <= (100 - percent) * (|x| + |y|). Two that link with the hub are in one component. Otherwise one
    does not, and the bound asks that the differences share elements. So they meet in the first elements of both, where
    whatever changes a copy has of its own comes first; the place of an element bounds how many can follow.
    """
    more, less = 100 + percent, 100 - percent
    named = _labelled(_firsts(differences, percent), labels, "comp").select(
        "hub", "node", "n", "apart", "linked", "posted", "comp", F.posexplode("tokens").alias("pos", "token"))
    apart = named.where(~F.col("linked")).select("hub", "token", F.struct("node", "n", "apart", "posted", "comp", "pos").alias("s"))
    listed = named.where("pos < posted").select("hub", "token", F.struct("node", "n", "apart", "linked", "comp", "pos").alias("t"))
    left = F.least(F.col("s.apart") - F.col("s.pos"), F.col("t.apart") - F.col("t.pos"))
    meets = ((F.col("s.comp") != F.col("t.comp")) & (100 * F.least("s.n", "t.n") >= percent * F.greatest("s.n", "t.n"))
             & (2 * more * left >= more * (F.col("s.apart") + F.col("t.apart")) - less * (F.col("s.n") + F.col("t.n")))
             & (F.col("t.linked") | ((F.col("s.pos") < F.col("s.posted")) & (F.col("s.node") < F.col("t.node")))))
    return apart.join(listed, ["hub", "token"]).where(meets).select(
        F.least("s.node", "t.node").alias("x"), F.greatest("s.node", "t.node").alias("y")).distinct()


def link(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, percent: int = 85) -> DataFrame:
    """Rows (id, n_shingles, component_id), one per input row."""
    sets = _sets(docs, id_col, text_col, width, percent)
    held_of = partial(_held, docs, text_col, width, sets)
    postings = _postings(sets, percent)

    # The hub of a list is its smallest indexed member (names are hashes), so the same sets are hubs of many lists.
    hubs = postings.groupBy("token").agg(F.min(F.when(F.col("indexed"), F.col("node"))).alias("hub"), F.max("node").alias("most"),
                                         F.min("node").alias("least")).where("least < most AND hub IS NOT NULL").select("token", "hub")
    listed = staged(postings.join(hubs, "token"))
    first = listed.where(F.col("node") == F.col("hub")).select("token", F.col("n").alias("hub_n"), F.col("pos").alias("hub_pos")).distinct()
    live = listed.where(F.col("node") != F.col("hub")).join(first, "token")
    listed = listed.distinct()

    def fits(n1: str, p1: str, n2: str, p2: str):
        most = F.least(F.col(n1) - F.col(p1), F.col(n2) - F.col(p2))
        return ((100 * F.least(n1, n2) >= percent * F.greatest(n1, n2))
                & ((100 + percent) * most >= percent * (F.col(n1) + F.col(n2))))

    # A set is compared with the first two of its lists' hubs; lists that this leaves open are looked at below.
    first = F.row_number().over(Window.partitionBy("x").orderBy(F.xxhash64("y"), "y"))
    stars = live.where(fits("n", "pos", "hub_n", "hub_pos")).select(F.col("node").alias("x"), F.col("hub").alias("y")).distinct()
    stars = stars.withColumn("first", first).where(F.col("first") <= 2).drop("first")
    tested = _compare(staged(stars), held_of, percent)
    edges = tested.where("linked").select(F.col("x").alias("a"), F.col("y").alias("b"))
    labels = staged(components(edges))

    # Members of each list with their component; a list is finished when it holds only one.
    pair = [F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")]
    done = tested.select(*pair)
    for turn in count(1):
        members = staged(_labelled(listed, labels, "comp"))
        blocks = members.groupBy("token", "comp").agg(
            F.count(F.lit(1)).alias("held"), F.min("n").alias("low"), F.max("n").alias("high"), F.min("pos").alias("pos"))
        held = F.sum("held")
        open_lists = staged(blocks.groupBy("token").agg(
            held.alias("held"), ((held * held - F.sum(F.col("held") * F.col("held"))) / 2).alias("pairs")).where("pairs > 0"))
        size = open_lists.agg(F.coalesce(F.sum("held"), F.lit(0)).alias("held"), F.coalesce(F.sum("pairs"), F.lit(0)).alias("pairs")).first()
        if size["pairs"] <= FEW_PAIRS * size["held"]:
            break
        # Families of copies around the threshold: other members of their lists take their turn as hubs.
        unfinished = members.join(open_lists.select("token"), "token", "left_semi")
        chosen = unfinished.where("indexed").withColumn("turn", F.row_number().over(
            Window.partitionBy("token").orderBy(F.xxhash64(F.lit(turn), "node"), "node"))).where(F.col("turn") <= ROUND_HUBS)
        chosen = chosen.select("token", F.col("comp").alias("comp2"), F.col("node").alias("y"), F.col("n").alias("ny"), F.col("pos").alias("py"))
        asked = (
            unfinished.select("token", "comp", F.col("node").alias("x"), "n", "pos").join(chosen, "token")
            .where((F.col("comp") != F.col("comp2")) & fits("n", "pos", "ny", "py")).select(*pair).distinct()
        )
        found = _compare(staged(asked.join(done, ["x", "y"], "left_anti")), held_of, percent)
        done = done.unionByName(found.select(*pair))
        new = found.where("linked").select(F.col("x").alias("a"), F.col("y").alias("b"))
        edges = edges.unionByName(new)
        if 10 * new.count() <= found.count():  # also where no pair is left to ask for
            break
        labels = staged(components(edges))
    blocks = staged(blocks.join(open_lists.select("token"), "token", "left_semi"))
    other = blocks.select("token", *[F.col(c).alias(f"{c}2") for c in ("comp", "low", "high", "pos")])
    # Best case of a pair of blocks: sizes as close as the ranges allow, positions as early as any.
    most = F.least(F.col("high") - F.col("pos"), F.col("high2") - F.col("pos2"))
    meets = ((100 * F.least("high", "high2") >= percent * F.greatest("low", "low2"))
             & ((100 + percent) * most >= percent * (F.col("low") + F.col("low2"))))
    block_pairs = staged(blocks.join(other, "token").where(F.col("comp") < F.col("comp2")).where(meets)
                         .select("token", "comp", "comp2"))
    if block_pairs.isEmpty():
        final = labels
    else:
        known = tested.select(F.col("x").alias("node"), F.col("y").alias("hub"), "distance")
        held = (
            members.join(block_pairs.select("token", F.explode(F.array("comp", "comp2")).alias("comp")).distinct(),
                         ["token", "comp"], "left_semi")
            .join(known, ["node", "hub"], "left")
            .withColumn("distance", F.when(F.col("node") == F.col("hub"), 0.0).otherwise(F.col("distance")))
        )
        held = staged(held)
        left = held.select("token", "comp", F.col("node").alias("x"), F.col("n").alias("nx"), F.col("pos").alias("px"),
                           F.col("indexed").alias("ix"), F.col("distance").alias("dx"))
        right = held.select("token", F.col("comp").alias("comp2"), F.col("node").alias("y"), F.col("n").alias("ny"),
                            F.col("pos").alias("py"), F.col("indexed").alias("iy"), F.col("distance").alias("dy"))
        apart = F.abs(F.col("dx") - F.col("dy")) > 1 - percent / 100 + 1e-9
        rest = (
            block_pairs.join(left, ["token", "comp"]).join(right, ["token", "comp2"])
            .where(fits("nx", "px", "ny", "py") & ~F.coalesce(apart, F.lit(False)))
            .where(F.when(F.col("nx") <= F.col("ny"), F.col("ix")).otherwise(F.col("iy"))
                   | ((F.col("nx") == F.col("ny")) & F.col("iy")))
            .select(*pair).distinct()
        )
        more = _compare(staged(rest.join(done, ["x", "y"], "left_anti")), held_of, percent)
        final = components(edges.unionByName(more.where("linked").select(F.col("x").alias("a"), F.col("y").alias("b"))))

    named = sets.where(F.col("n") > 0).groupBy("node").agg(F.min("id").alias("least"))
    rooted = staged(_labelled(named, final, "root"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    found = rooted.join(least, "root").select("node", "component_id")
    return sets.select("id", "n", "node").join(found, "node", "left").select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id"))
