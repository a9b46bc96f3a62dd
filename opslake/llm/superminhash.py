"""Near duplicates by SuperMinHash: signatures, banding, verification on full sets, union-find grouping.

A text's set holds its distinct word shingles as 64-bit hashes. Equal sets are one node, known by a 64-bit hash, and
only nodes are joined; copies of any number cost nothing further.

1. Signature. Every element draws its own permutation of the ``bands * rows`` places, one place for each rank, and
   puts rank + fraction there; a place keeps the least value. The ranks of one element are correlated (no two in one
   place), which lowers the variance below that of independent hashes. Ranks are drawn for all elements of many texts
   at a time, and a text stops at the first rank that cannot lower any of its places: long texts end after one or two.
2. Banding. ``rows`` neighbouring places make a band; nodes that agree in one are members of its bucket. The chance
   that two sets of similarity s share no bucket is (1 - s ** rows) ** bands: 5e-8 at 0.8 with the defaults.
3. Verification. Members are compared with hubs of their bucket on full sets, never all with all: the hub is the member
   whose buckets are fullest, and a node first meets the two hubs that it shares most buckets with. In buckets that then
   still hold several groups all members are compared with the hub, and members of different groups meet if their
   differences to the hub share enough elements, without which they cannot link. A pair of one group is not compared.
4. Grouping. Each task joins its links by union-find before they are shuffled; stars join what is left.

Defined results: a text that is null, empty or without words has an empty set and links with nothing; fewer words
than a shingle has are one shingle; repeated rows are copies of each other; rows without an id take part,
``component_id`` is the smallest id that is not null, and a row is kept if it has this id (or its group has none);
an empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from opslake.llm.components import components
from opslake.llm.ngram_join import (
    _ODD, Shingles, _differences, _fingerprint, _held, _in_groups, _met_by_difference, _mix, _unpack,
)
from opslake.session import staged

BANDS, ROWS = 32, 4
FIRST_HUBS = 2
TURN_HUBS = 4  # not read any more: there are no later turns; tests still set it
CHUNK = 1 << 13
BATCH_ROWS = 1000  # of Arrow batches, which hold whole texts or sets
_RANK = 48  # bits of the fraction below the rank


def signatures(sets: list[np.ndarray], places: int) -> np.ndarray:
    """SuperMinHash of each set: ``places`` values, rank in the upper 16 bits, fraction in the lower 48."""
    best = np.full((len(sets), places), np.iinfo(np.uint64).max, dtype=np.uint64)
    flat = best.reshape(-1)
    owners = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    elements = np.concatenate([*sets, np.zeros(0, np.uint64)])
    for at in range(0, len(elements), CHUNK):
        owner, element = owners[at:at + CHUNK], elements[at:at + CHUNK]
        order = None  # the permutation of each element, from the second rank on
        for rank in range(places):
            live = (best[owner[0]:owner[-1] + 1].max(axis=1) >= np.uint64(rank << _RANK))[owner - owner[0]] if rank else None
            if live is not None and not live.all():
                owner, element, order, place = owner[live], element[live], order if order is None else order[live], place[live]
            if not len(element):
                break
            rows = np.arange(len(element))
            if rank == 1:  # what the first swap has left
                order = np.tile(np.arange(places, dtype=np.uint16), (len(element), 1))
                order[rows, place] = 0
            drawn = _mix(element + np.uint64((rank + 1) * int(_ODD) % (1 << 64)))
            place = rank + ((drawn & np.uint64(0xFFFF)) * np.uint64(places - rank) >> np.uint64(16)).astype(np.int64)
            here = place
            if order is not None:
                here = order[rows, place].astype(np.int64)
                order[rows, place] = order[:, rank]
            np.minimum.at(flat, owner * places + here, np.uint64(rank << _RANK) | drawn >> np.uint64(16))
    return best


def band_keys(best: np.ndarray, bands: int) -> np.ndarray:
    """One 64-bit key for each band of each signature."""
    parts = best.reshape(len(best), bands, -1)
    keys = np.broadcast_to(np.arange(bands, dtype=np.uint64), parts.shape[:2])
    for i in range(parts.shape[2]):
        keys = _mix(keys * _ODD + parts[:, :, i])
    return keys.astype(np.int64)


def _signed(docs: DataFrame, id_col: str, text_col: str, width: int, bands: int, rows: int) -> DataFrame:
    """Rows (id, mark, n, node, bands), written once; mark is a hash of the text.

    Of equal sets only the first that a task meets is signed.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maker, seen = Shingles(width), set()
        for batch in batches:
            for at, texts in _in_groups(batch.column(2), 60_000):
                sets = maker.sets(texts)
                nodes = [_fingerprint(s) for s in sets]
                new = []
                for i, (s, node) in enumerate(zip(sets, nodes, strict=True)):
                    if len(s) and node not in seen:
                        seen.add(node)
                        new.append(i)
                keys = [None] * len(sets)
                signed = band_keys(signatures([sets[i] for i in new], bands * rows), bands) if new else []
                for i, key in zip(new, signed, strict=True):
                    keys[i] = key
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(at, len(texts)), batch.column(1).slice(at, len(texts)),
                    pa.array([len(s) for s in sets], type=pa.int64()), pa.array(nodes, type=pa.int64()),
                    pa.array(keys, type=pa.list_(pa.int64()))], ["id", "mark", "n", "node", "bands"])

    made = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("mark"), text_col)
    return staged(made.mapInArrow(run, f"id {kind}, mark long, n long, node long, bands array<long>"))


def _verified(pairs: DataFrame, held: DataFrame, percent: int) -> DataFrame:
    """Rows (x, y, linked) of distinct pairs (x, y), compared on the full sets ``held``."""
    one = held.select(F.col("node").alias("x"), F.col("n").alias("nx"), F.col("hashes").alias("hx"))
    two = held.select(F.col("node").alias("y"), F.col("n").alias("ny"), F.col("hashes").alias("hy"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shared = np.array([len(np.intersect1d(_unpack(a.as_py()), _unpack(b.as_py()), assume_unique=True))
                               for a, b in zip(batch.column("hx"), batch.column("hy"), strict=True)], dtype=np.int64)
            union = batch.column("nx").to_numpy() + batch.column("ny").to_numpy() - shared
            yield pa.RecordBatch.from_arrays([batch.column("x"), batch.column("y"), pa.array(100 * shared >= percent * union)],
                                             ["x", "y", "linked"])

    joined = pairs.join(one, "x").join(two, "y").select("x", "y", "nx", "ny", "hx", "hy")
    return staged(joined.mapInArrow(run, "x long, y long, linked boolean"))


def joined_in_tasks(edges: DataFrame) -> DataFrame:
    """The links of each task as stars (a, b) by union-find, so that no more than a tree is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        up: dict[int, int] = {}

        def root(x: int) -> int:
            while up.setdefault(x, x) != x:
                up[x] = up[up[x]]
                x = up[x]
            return x

        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                a, b = root(a), root(b)
                up[max(a, b)] = min(a, b)
        ends = [(x, root(x)) for x in up if root(x) != x]
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in ends], type=pa.int64()),
                                          pa.array([r for _, r in ends], type=pa.int64())], ["a", "b"])

    return edges.select("a", "b").mapInArrow(run, "a long, b long")


def _grouped(members: DataFrame, labels: DataFrame) -> DataFrame:
    named = members.join(labels.select("node", F.col("root").alias("comp")), "node", "left")
    return named.withColumn("comp", F.coalesce("comp", "node"))


@contextmanager
def _short_batches(docs: DataFrame) -> Iterator[None]:
    conf, name = docs.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    old = conf.get(name)
    conf.set(name, str(BATCH_ROWS))
    try:
        yield
    finally:
        conf.set(name, old)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80,
                    bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """Rows (id, n_shingles, component_id, kept), one per input row."""
    with _short_batches(docs):
        return _near_duplicates(docs, id_col, text_col, width, percent, bands, rows)


def _near_duplicates(docs: DataFrame, id_col: str, text_col: str, width: int, percent: int, bands: int, rows: int) -> DataFrame:
    sets = _signed(docs, id_col, text_col, width, bands, rows)
    postings = sets.where(F.col("bands").isNotNull()).select(F.explode("bands").alias("bucket"), "node", "n")
    shared = postings.groupBy("bucket").agg(F.min("node").alias("least"), F.max("node").alias("most"), F.count(F.lit(1)).alias("size"))
    members = staged(postings.join(shared.where("least < most").select("bucket", "size"), "bucket").distinct())
    # The text that a family was copied from shares most buckets with most others, so it comes first as a hub.
    weights = members.groupBy("node").agg(F.sum("size").alias("weight"))
    members = staged(members.join(weights, "node").select("bucket", "node", "n", "weight"))
    # Sets that no other shares a bucket with are left behind here.
    wanted = staged(weights.select("node"))
    held = _held(docs, text_col, width, sets, wanted)

    alike = 100 * F.least("n", "hub_n") >= percent * F.greatest("n", "hub_n")
    pair = [F.least("node", "hub").alias("x"), F.greatest("node", "hub").alias("y")]
    leading = members.groupBy("bucket").agg(F.max(F.struct("weight", "node", "n")).alias("h")).select(
        "bucket", F.col("h.node").alias("hub"), F.col("h.n").alias("hub_n"), F.col("h.weight").alias("hub_weight"))
    met = members.join(leading, "bucket").where((F.col("node") != F.col("hub")) & alike).groupBy("node", "hub").agg(
        F.count(F.lit(1)).alias("shared"), F.max("hub_weight").alias("hub_weight"))
    most = F.row_number().over(Window.partitionBy("node").orderBy(F.desc("shared"), F.desc("hub_weight"), "hub"))
    first = met.withColumn("place", most).where(F.col("place") <= FIRST_HUBS).select(*pair).distinct()
    tested = _verified(staged(first), held, percent)
    links = tested.where("linked").select(F.col("x").alias("a"), F.col("y").alias("b"))
    edges = joined_in_tasks(links)
    labels = staged(components(edges))

    # Buckets of several groups: members of other groups meet by their differences to the hub of the bucket.
    placed = _grouped(members, labels)
    mixed = placed.groupBy("bucket").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low <> high")
    anchored = staged(members.join(mixed.select("bucket"), "bucket", "left_semi").join(leading.select("bucket", "hub"), "bucket").where(
        F.col("node") != F.col("hub")).select("hub", "node").distinct())
    differences = _differences(anchored, held, percent)
    edges = staged(edges.unionByName(differences.where("linked").select(F.col("node").alias("a"), F.col("hub").alias("b"))))
    labels = staged(components(edges))
    found = _verified(staged(_met_by_difference(differences, labels, percent)), held, percent)
    labels = components(joined_in_tasks(edges.unionByName(found.where("linked").select(F.col("x").alias("a"), F.col("y").alias("b")))))

    named = sets.where(F.col("n") > 0).groupBy("node").agg(F.min("id").alias("least"))
    rooted = staged(named.join(labels, "node", "left").select("node", "least", F.coalesce("root", "node").alias("root")))
    found = rooted.join(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("node", "component_id")
    out = sets.select("id", "n", "node").join(found, "node", "left").select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col(id_col) == F.col("component_id"), F.col("component_id").isNull()))
