"""Document search by an inverted index: posting lists by term, sorted numbers, intersection from the shortest list."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opslake.session import staged

BREAKS = r"[^\p{L}\p{N}]+"


def field_kind(name: str) -> str:
    """``num`` for a number, ``tag`` for a value taken as it is, ``text`` for words."""
    return "num" if name.endswith("_num") else "tag" if name.endswith("_tag") else "text"


def index_write(docs: DataFrame, path: str, fields: list[str], id_col: str = "id", folders: int = 32, files: int = 8) -> None:
    """Write the index of ``docs`` to a folder: ``postings`` (folder, field, term, id), ``terms`` (folder, field, term, n) and ``numbers``
    (field, value, id).

    A term's folder is given by its hash, so a search opens the folders of its terms alone. Postings are dealt out and sorted by
    (term, id): the term and id ranges that Parquet keeps for each block let a scan skip all other blocks, and the list of a term
    that most documents hold is spread over several files. A word that a document repeats is there once.
    """
    lists, numbers = [], []
    for name in fields:
        kind, value = field_kind(name), F.col(name)
        if kind == "num":
            numbers.append(docs.select(F.lit(name).alias("field"), value.cast("double").alias("value"), F.col(id_col).alias("id")))
            continue
        terms = F.array(value.cast("string")) if kind == "tag" else F.filter(F.array_distinct(F.split(F.lower(value), BREAKS)), lambda t: t != "")
        lists.append(docs.select(F.lit(name).alias("field"), F.explode(terms).alias("term"), F.col(id_col).alias("id")))
    shape = "field string, term string"
    none = docs.select(*[F.lit(None).cast("string").alias(c) for c in ("field", "term")], F.col(id_col).alias("id"))
    postings = reduce(DataFrame.unionByName, lists, none).where("term IS NOT NULL AND id IS NOT NULL")
    postings = postings.withColumn("folder", F.pmod(F.xxhash64("field", "term"), F.lit(folders)).cast("int"))
    order = ["folder", "field", "term", "id"]
    postings.repartitionByRange(folders * files, *order).sortWithinPartitions(*order).write.mode("overwrite").partitionBy("folder").parquet(
        f"{path}/postings")
    stored = docs.sparkSession.read.schema(f"{shape}, id {docs.schema[id_col].dataType.simpleString()}, folder int").parquet(f"{path}/postings")
    counts = stored.groupBy("folder", "field", "term").agg(F.count(F.lit(1)).alias("n"))
    counts.repartition("folder").sortWithinPartitions("field", "term").write.mode("overwrite").partitionBy("folder").parquet(f"{path}/terms")
    values = reduce(DataFrame.unionByName, numbers, none.select("field", F.lit(None).cast("double").alias("value"), "id")).where("value IS NOT NULL")
    values.repartitionByRange(files, "field", "value").sortWithinPartitions("field", "value").write.mode("overwrite").parquet(f"{path}/numbers")
    docs.select(F.col(id_col).alias("id")).where("false").write.mode("overwrite").parquet(f"{path}/id")
    docs.sparkSession.createDataFrame([(folders,)], "folders int").write.mode("overwrite").parquet(f"{path}/shape")


class DocumentIndex:
    """A stored index, opened for searching."""

    def __init__(self, spark: SparkSession, path: str):
        kind = spark.read.parquet(f"{path}/id").schema["id"].dataType.simpleString()
        self.folders = spark.read.parquet(f"{path}/shape").first()["folders"]
        self.postings = spark.read.schema(f"field string, term string, id {kind}, folder int").parquet(f"{path}/postings")
        self.terms = spark.read.schema("field string, term string, n long, folder int").parquet(f"{path}/terms")
        self.numbers = spark.read.schema(f"field string, value double, id {kind}").parquet(f"{path}/numbers")
        self.spark = spark

    def _folder(self, field, term):
        return F.pmod(F.xxhash64(field, term), F.lit(self.folders)).cast("int")

    def search(self, criteria: dict, limit: int | None = 100, offset: int = 0) -> DataFrame:
        """Ids that meet all criteria, in order: ``*_num`` takes a (low, high) range, ``*_tag`` a value or a list, any other field
        words that must all occur. Lists are cut down from the shortest; no criterion means no document."""
        wanted: list[list[tuple[str, str]]] = []  # of each entry one term has to occur
        ranges = []
        for name, value in criteria.items():
            if field_kind(name) == "num":
                ranges.append(self.numbers.where((F.col("field") == name) & F.col("value").between(*map(float, value))).select("id"))
            elif field_kind(name) == "tag":
                wanted.append([(name, str(v)) for v in (value if isinstance(value, (list, tuple)) else [value])])
            else:
                wanted += [[(name, term)] for term in dict.fromkeys(str(value).lower().split())]
        asked = [pair for entry in wanted for pair in entry]
        places = {}
        if asked:
            rows = self.spark.createDataFrame(asked, "field string, term string").select("field", "term", self._folder("field", "term").alias("f"))
            places = {(r["field"], r["term"]): r["f"] for r in rows.collect()}

        def held(df: DataFrame, entry: list[tuple[str, str]]) -> DataFrame:
            return df.where(F.col("folder").isin(sorted({places[p] for p in entry})) & reduce(
                or_, [(F.col("field") == f) & (F.col("term") == t) for f, t in entry], F.lit(False)))

        counts = {(r["field"], r["term"]): r["n"] for r in held(self.terms, asked).collect()} if asked else {}
        entries = sorted(wanted, key=lambda entry: sum(counts.get(p, 0) for p in entry))
        lists = [held(self.postings, e).select("id") for e in entries] + ranges
        if not lists:
            return self.postings.select("id").where("false")
        found = reduce(lambda a, b: a.join(b, "id", "left_semi"), lists).distinct().orderBy("id").offset(offset)
        return found if limit is None else found.limit(limit)

    def search_many(self, wanted: DataFrame) -> DataFrame:
        """(query_id, id) of the documents that hold all terms of a query; ``wanted`` has rows (query_id, field, term).

        Only the postings of a query's rarest term become candidates; each further term is looked up for these alone.
        """
        wanted = wanted.select("query_id", "field", F.lower("term").alias("term")).distinct().withColumn("folder", self._folder("field", "term"))
        key = ["folder", "field", "term"]
        rated = staged(wanted.join(self.terms, key, "left").withColumn("n", F.coalesce("n", F.lit(0))))
        shortest = rated.groupBy("query_id").agg(F.min_by(F.struct(*key), F.struct("n", "field", "term")).alias("_r"), F.count(F.lit(1)).alias("_terms"))
        lead = staged(shortest.select("query_id", "_terms", "_r.*"))
        first = self.postings.join(lead, key).select("query_id", "_terms", "id")
        others = rated.join(lead.drop("_terms"), ["query_id", *key], "left_anti").select("query_id", *key)
        asked = first.where("_terms > 1").join(others, "query_id")
        met = asked.join(self.postings, [*key, "id"], "left_semi").groupBy("query_id", "id", "_terms").agg(F.count(F.lit(1)).alias("_met"))
        return first.where("_terms = 1").select("query_id", "id").unionByName(met.where("_met = _terms - 1").select("query_id", "id"))
