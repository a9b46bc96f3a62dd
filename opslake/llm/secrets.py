"""Secret scans with corpus-wide ownership: DataFrame functions only.

Three base patterns give spans that always stay. Wider patterns (vendor prefixes, signed tokens, private keys,
mixed random strings) give further candidates. The hash of every candidate is counted over the whole corpus by
distinct owners and repositories: a value that more than ``max_owners`` owners carry is a widely copied example,
one that stays with its owner looks live. A further candidate becomes a span only if it looks live and
overlaps no base span.

Positions count code points, ends are exclusive. Spans are ordered by start, then by kind as in ``KINDS``.

Defined results: a null text counts as empty and has no spans; a null owner or repository counts as one more
owner or repository; repeated rows get a result each and count as one owner; an empty table gives an empty result.
Texts are searched whole. Further columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opslake.session import staged


@dataclass(frozen=True)
class Kind:
    """A pattern, the group that holds the value, the value's least length, and what it must contain."""

    name: str
    pattern: str
    group: int = 0
    least: int = 1
    holds: tuple[str, ...] = ()
    base: bool = False
    ignored: str = ""  # what is left out of the value before it is hashed


# A whole key: header, fields, body and footer. Without a footer it ends where the base64 characters end.
PRIVATE = (r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----((?:\s*[A-Za-z-]{1,40}: ?[^\r\n]{0,200}[\r\n]+){0,8}"
           r"(?:[A-Za-z0-9+/=\s\\]*+(?=-----END )|[A-Za-z0-9+/=\r\n\\]*+))(?:-----END [A-Z ]{0,20}PRIVATE KEY-----)?")

# The base patterns.
KINDS = (
    Kind("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6,
         base=True),
    Kind("access", r"AKIA[A-Z0-9]+", 0, 20, base=True),
    Kind("hex", r"[0-9a-f]{24,}", 0, 24, base=True),
    # Further candidates.
    Kind("private", PRIVATE, 1, 0, ignored=r"\s|\\[rn]"),
    Kind("vendor", r"(?:gh[pousr]_|xox[abprs]-|sk_live_|sk-|AIza|glpat-)[A-Za-z0-9_-]{16,}"),
    Kind("signed", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Kind("random", r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{24,}={0,2}", holds=("[0-9]", "[a-z]", "[A-Z]")),
)


def _spans(text: Column, at: int) -> Column:
    """Array of (start, kind, end, hash): leftmost non-overlapping matches whose value passes.

    The text around the matches tells where they start: a match begins where the pieces and matches before it end.
    """
    kind = KINDS[at]
    pattern = F.lit(kind.pattern)
    pieces = F.split(text, kind.pattern, -1)
    matches = F.regexp_extract_all(text, pattern, F.lit(0))
    values = F.regexp_extract_all(text, pattern, F.lit(kind.group)) if kind.group else matches
    none = F.array().cast("array<struct<start:int,kind:int,end:int,hash:bigint>>")

    def add(acc: Column, m: Column) -> Column:
        start = acc["at"] + F.length(m["piece"])
        end = start + F.length(m["match"])
        passes = F.length(m["value"]) >= kind.least
        for needed in kind.holds:
            passes &= m["value"].rlike(needed)
        value = F.regexp_replace(m["value"], kind.ignored, "") if kind.ignored else m["value"]
        span = F.struct(start.alias("start"), F.lit(at).alias("kind"), end.alias("end"), F.xxhash64(value).alias("hash"))
        return F.struct(end.alias("at"), F.when(passes, F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out"))

    parts = F.arrays_zip(pieces.alias("piece"), matches.alias("match"), values.alias("value"))
    folded = F.aggregate(F.filter(parts, lambda m: m["match"].isNotNull()),
                         F.struct(F.lit(0).alias("at"), none.alias("out")), add, lambda acc: acc["out"])
    return F.when(text.rlike(kind.pattern), folded).otherwise(none)


def _joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k.name) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(docs: DataFrame, owner: Column, repository: Column, id_col: str = "doc_id", text_col: str = "text",
         max_owners: int = 2) -> DataFrame:
    """One row per document: counts per base kind, base and all spans, and how many values look live or copied."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    kinds = {True: [], False: []}
    for at, kind in enumerate(KINDS):
        kinds[kind.base].append(at)
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"), owner.alias("owner"), repository.alias("repository"))
    found = rows.select(
        "id", "owner", "repository", F.concat(*[_spans(F.col("text"), i) for i in kinds[True]]).alias("base"),
        F.concat(*[_spans(F.col("text"), i) for i in kinds[False]]).alias("more"))
    apart = F.filter("more", lambda m: ~F.exists("base", lambda b: (b["start"] < m["end"]) & (m["start"] < b["end"])))
    # The row number is written with the rows, so it is the same whenever they are read.
    found = staged(found.withColumn("more", apart).withColumn("base", F.array_sort("base")).withColumn(
        "row", F.monotonically_increasing_id()))

    spans = found.select("row", "owner", "repository", F.explode(F.concat("base", "more")).alias("span"))
    copied = staged(
        spans.groupBy(F.col("span.hash").alias("hash"), "owner", "repository").agg(F.count(F.lit(1)).alias("n"))
        .groupBy("hash", "owner").agg(F.count(F.lit(1)).alias("repositories"))
        .groupBy("hash").agg(F.count(F.lit(1)).alias("owners"), F.sum("repositories").alias("repositories"))
        .where(F.col("owners") > max_owners))
    judged = (
        spans.select("row", "span", F.col("span.hash").alias("hash")).join(copied, "hash", "left")
        .groupBy("row").agg(
            F.collect_list(F.when(F.col("owners").isNull(), F.col("span"))).alias("live"),
            F.count("owners").alias("n_example"))
    )
    live = F.coalesce("live", F.array())
    kept = F.filter(live, lambda s: s["kind"] >= len(kinds[True]))

    def count(at: int) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == at)).cast("long").alias(f"n_{KINDS[at].name}")

    return found.join(judged, "row", "left").select(
        F.col("id").alias(id_col), *map(count, kinds[True]), F.sha2(_joined(F.col("base")), 256).alias("base_sha256"),
        _joined(F.array_sort(F.concat("base", kept))).alias("spans"),
        F.size(live).cast("long").alias("n_live"), F.coalesce("n_example", F.lit(0)).cast("long").alias("n_example"))
