"""Source divergence audit: how far the word distributions of the sources of one language lie apart, and which terms do it.

1. Collapse. Texts that are equal within a language are one text with its copies per source. Copies are counted by
   hash, so a text that a third of all rows share is a few rows after the tasks have counted; one of them keeps the text.
2. Count. Every text is split once; its terms carry the copies as weights for document frequencies and counts.
3. Prices. A term kept (in at least ``min_docs`` documents of its language) has p = 1 + floor(scale * (count + 1) / (N + V)) in
   each group, so only the terms a group holds need a row: all others share the price of count 0.
4. Pairs. A pair's sum over all V terms is put together from the sum over the terms of one side, that over the terms of the
   other (both from how many terms have which count), and a correction for the terms that both hold. The last needs the
   lists of sources by term, which tasks add up to one row for each pair before anything is shuffled.

All arithmetic is exact in integers.

Defined results: null text, language and source count as ''; a group without a term, or a text of its language that has none,
still gives its pairs, of value 0 where V is 0; a language of one source gives no pair; ties in value go by item in UTF-8
order; repeated rows are documents of their own; an empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opslake.session import staged

TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
_BREAKS = "".join(chr(c) for c in range(128) if not chr(c).isalpha())  # what TERM leaves out
SCALE = 1_000_000_000
PAIRS_AT_ONCE = 1 << 20


def _price(count: Column, total: Column, terms: Column) -> Column:
    return 1 + _divided((count + 1).cast("decimal(20,0)") * F.lit(SCALE), (total + terms).cast("decimal(20,0)"))


def _divided(a: Column, b: Column) -> Column:
    """Integer quotient of whole numbers, null for a divisor of 0."""
    return F.call_function("div", a, F.nullif(b, F.lit(0)))


def _term_counts(docs: DataFrame, text: str, lang: str, source: str) -> tuple[DataFrame, DataFrame]:
    """Rows (lang, source, code) of all groups, and (code, term, count, docs); the upper half of a code is the language's."""
    rows = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(a) for c, a in ((lang, "lang"), (source, "source"), (text, "text"))])
    rows = rows.withColumn("mark", F.sha2("text", 256))
    copies = staged(rows.groupBy("lang", "mark", "source").agg(F.count(F.lit(1)).alias("n")))
    numbered = Window.orderBy("lang", "source")  # over groups, of which the answer holds all pairs
    groups = staged(copies.select("lang", "source").distinct().withColumn("code", F.shiftleft(
        F.dense_rank().over(Window.orderBy("lang")).cast("long"), 32) + F.row_number().over(numbered)))
    shares = copies.join(groups, ["lang", "source"]).groupBy("lang", "mark").agg(F.collect_list(F.struct("code", "n")).alias("shares"))
    texts = rows.groupBy("lang", "mark").agg(F.first("text").alias("text"))
    terms = F.array_remove(F.split(F.translate("text", _BREAKS + string.ascii_uppercase, " " * len(_BREAKS) + string.ascii_lowercase), " "), "")
    split = texts.join(shares, ["lang", "mark"]).select("shares", terms.alias("terms"))
    # First every occurrence of a term, then every term of the text once.
    each = split.select("shares", F.size("terms").alias("length"),
                        F.posexplode(F.concat("terms", F.array_distinct("terms"))).alias("at", "term"))
    each = each.select("term", (F.col("at") < F.col("length")).alias("occurs"), F.explode("shares").alias("share"))
    weight = F.col("share.n")
    counts = each.groupBy(F.col("share.code").alias("code"), "term").agg(
        F.sum(F.when(F.col("occurs"), weight).otherwise(0)).alias("count"),
        F.sum(F.when(F.col("occurs"), 0).otherwise(weight)).alias("docs"))
    return groups, counts


def _divergence(p: Column, q: Column) -> Column:
    return _divided((p - q) * (p - q), q)


def _both_sides(priced: DataFrame) -> DataFrame:
    """Rows (lang, source, other, value): corrections for the terms that both sources hold."""

    def excess(p: np.ndarray, q: np.ndarray) -> np.ndarray:
        return (p - q) ** 2 // q

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes: dict[tuple[str, str], int] = {}
        sums: dict[tuple[int, int], int] = {}
        for batch in batches:
            held = batch.column("held")
            sizes = np.asarray(held.value_lengths(), dtype=np.int64)
            flat = held.flatten()
            p, rest = flat.field("p").to_numpy(zero_copy_only=False), flat.field("rest").to_numpy(zero_copy_only=False)
            langs = batch.column("lang").take(pa.array(np.repeat(np.arange(len(sizes)), sizes))).to_pylist()
            code = np.array([codes.setdefault(k, len(codes)) for k in zip(langs, flat.field("source").to_pylist(), strict=True)],
                            dtype=np.int64)
            start, size = np.repeat(np.cumsum(sizes) - sizes, sizes), np.repeat(sizes, sizes)
            cuts = np.flatnonzero(np.diff(np.cumsum(size) // PAIRS_AT_ONCE, prepend=0))
            for some in np.split(np.arange(len(size)), cuts):
                n = size[some]
                x = np.repeat(some, n)
                y = np.repeat(start[some], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                x, y = x[x != y], y[x != y]
                value = excess(p[x], p[y]) - excess(p[x], rest[y]) - excess(rest[x], p[y]) + excess(rest[x], rest[y])
                pairs, at = np.unique(code[x] << 32 | code[y], return_inverse=True)
                total = np.zeros(len(pairs), dtype=np.int64)
                np.add.at(total, at, value)
                for k, v in zip(pairs.tolist(), total.tolist(), strict=True):
                    sums[k] = sums.get(k, 0) + v
        names = list(codes)
        ends = [(names[k >> 32], names[k & 0xFFFFFFFF]) for k in sums]
        yield pa.RecordBatch.from_arrays(
            [pa.array([s[0] for s, _ in ends], pa.string()), pa.array([s[1] for s, _ in ends], pa.string()),
             pa.array([t[1] for _, t in ends], pa.string()), pa.array(list(sums.values()), pa.int64())],
            ["lang", "source", "other", "value"])

    lists = priced.groupBy("lang", "term").agg(F.collect_list(F.struct("source", "p", "rest")).alias("held")).where(F.size("held") > 1)
    return lists.select("lang", "held").mapInArrow(run, "lang string, source string, other string, value long")


def audit(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", min_docs: int = 3,
          top: int = 200) -> DataFrame:
    """Rows (lang, source, part, item, value, rank): every other source of the language by its divergence (part ``pair``),
    and the ``top`` terms that the source uses more than its language (part ``term``)."""
    groups, counts = _term_counts(docs, text, lang, source)
    lists = staged(counts.groupBy(F.shiftright("code", 32).alias("lang_code"), "term").agg(
        F.sum("docs").alias("docs"), F.sum("count").alias("all"), F.collect_list(F.struct("code", "count")).alias("held"))
        .where(F.col("docs") >= min_docs).select("lang_code", "term", "all", "held"))
    by_lang = lists.groupBy("lang_code").agg(F.count(F.lit(1)).alias("terms"), F.sum("all").alias("lang_total"))
    held = lists.select("term", "all", F.explode("held").alias("h")).select("term", "all", "h.code", "h.count")
    totals = held.groupBy("code").agg(F.sum("count").alias("total"), F.count(F.lit(1)).alias("own"))
    groups = groups.join(totals, "code", "left").withColumn("lang_code", F.shiftright("code", 32)).join(by_lang, "lang_code", "left").na.fill(0)
    groups = staged(groups.withColumn("rest", _price(F.lit(0).cast("long"), F.col("total"), F.col("terms"))))
    priced = staged(held.join(groups, "code").select(
        "lang", "term", "source", "count", "rest", _price(F.col("count"), F.col("total"), F.col("terms")).alias("p"),
        _price(F.col("all"), F.col("lang_total"), F.col("terms")).alias("q")))

    over = priced.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"),
                                        _divergence(F.col("p"), F.col("q")).alias("value"))
    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    terms = over.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)

    others = groups.select("lang", F.col("source").alias("other"), F.col("rest").alias("other_rest"), F.col("own").alias("other_own"))
    none = _divergence(F.col("rest"), F.col("other_rest"))
    pairs = groups.join(others, "lang").where("source <> other").select(
        "lang", "source", "other", F.coalesce((F.col("terms") - F.col("own") - F.col("other_own")) * none, F.lit(0)).alias("value"))
    counted = priced.groupBy("lang", "source", "p", "rest").agg(F.count(F.lit(1)).alias("n"))
    sided = counted.join(others, "lang").where("source <> other").select("lang", F.explode(F.array(
        F.struct("source", "other", (F.col("n") * _divergence(F.col("p"), F.col("other_rest"))).alias("value")),
        F.struct(F.col("other").alias("source"), F.col("source").alias("other"),
                 (F.col("n") * _divergence(F.col("other_rest"), F.col("p"))).alias("value")))).alias("x")).select("lang", "x.*")
    summed = pairs.unionByName(sided).unionByName(_both_sides(priced)).groupBy("lang", "source", "other").agg(F.sum("value").alias("value"))
    ranked = summed.select("lang", "source", F.lit("pair").alias("part"), F.col("other").alias("item"), "value").withColumn(
        "rank", F.row_number().over(best))
    return ranked.unionByName(terms)
