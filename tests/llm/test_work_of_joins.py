"""What the joins write and compare does not grow with the texts or with the pairs of a family."""

import os
import random
import string

import pytest
from pyspark.sql import functions as F

from opslake.llm import fuzzy_lines, ngram_join, superminhash


def word(rng):
    return "".join(rng.choices(string.ascii_lowercase, k=rng.randint(5, 9)))


@pytest.mark.parametrize("module, run", [(ngram_join, ngram_join.link), (superminhash, superminhash.near_duplicates)],
                         ids=["link", "near_duplicates"])
def test_whole_sets_of_unlinked_texts_are_not_written(spark, module, run, monkeypatch):
    rng = random.Random(3)
    texts = [" ".join(word(rng) for _ in range(3000)) for _ in range(40)]
    texts.append(texts[0].replace(texts[0].split()[9], "changed"))
    written, whole = [], module.staged

    def noted(df):
        out = whole(df)
        written.extend(os.path.getsize(f.removeprefix("file://")) for f in out.inputFiles())
        return out

    monkeypatch.setattr(ngram_join, "staged", noted)
    monkeypatch.setattr(superminhash, "staged", noted)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    got = {r["doc_id"]: r["component_id"] for r in run(df).collect()}
    assert got == {i: i % 40 for i in range(41)}
    assert sum(written) < 0.5 * sum(map(len, texts))


def test_variants_meet_the_line_that_they_were_made_from(spark, monkeypatch):
    rng = random.Random(4)
    line = [word(rng) for _ in range(60)]
    rows = [" ".join(line)] * 4
    for i in range(0, 60, 5):  # each within a tenth of the line, two of them not
        rows.append(" ".join([*line[:i], *(word(rng) for _ in range(4)), *line[i + 4:]]))
    asked, compare = [], fuzzy_lines._similar

    def noted(pairs, *rest):
        asked.append(pairs.count())
        return compare(pairs, *rest)

    monkeypatch.setattr(fuzzy_lines, "_similar", noted)
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(2)
    assert [r["doc_id"] for r in fuzzy_lines.dedup(df, wide=True).where("text <> ''").collect()] == [0]
    assert sum(asked) <= 12


def family(rng, words, changed, size):
    """A text and variants of it, each with other words changed; two variants differ in about twice as many."""
    base = [word(rng) for _ in range(words)]
    rows = [" ".join(base)]
    for _ in range(size):
        at = set(rng.sample(range(words), changed))
        rows.append(" ".join(word(rng) if i in at else w for i, w in enumerate(base)))
    return list(enumerate(rows))


def test_variants_below_the_threshold_are_not_compared_in_pairs(spark, monkeypatch):
    rows = family(random.Random(5), 150, 12, 60)  # similarity 0.73 to the text, 0.52 to each other
    compared, verify = [], superminhash._verified

    def noted(pairs, *rest):
        compared.append(pairs.count())
        return verify(pairs, *rest)

    monkeypatch.setattr(superminhash, "_verified", noted)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    assert all(r["kept"] for r in superminhash.near_duplicates(df, width=2).collect())
    assert sum(compared) <= 3 * len(rows)


def test_lines_apart_by_their_distances_to_the_hub_are_not_compared(spark, monkeypatch):
    rng = random.Random(6)
    line = [word(rng) for _ in range(60)]
    rows = [" ".join(line)] * 4
    for i in range(60):  # each near the line
        rows.append(" ".join([*line[:i], word(rng), *line[i + 1:]]))
    for i in range(0, 45, 9):  # each further from the line than is similar
        rows.append(" ".join([*line[:i], *(word(rng) for _ in range(14)), *line[i + 14:]]))
    asked, compare = [], fuzzy_lines._similar

    def noted(pairs, *rest):
        asked.append(pairs.count())
        return compare(pairs, *rest)

    monkeypatch.setattr(fuzzy_lines, "_similar", noted)
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(2)
    left = [r["doc_id"] for r in fuzzy_lines.dedup(df, wide=True).where("text <> ''").collect()]
    assert sorted(left) == [0, *range(64, 69)]
    assert sum(asked) <= 100


def test_edits_of_long_texts_are_those_of_what_differs(spark):
    rng = random.Random(7)
    text = "".join(rng.choices("ab\u00e9\u4e2d", k=1500))
    rows = [(text, text[:700] + "x" + text[700:]), (text, "x" + text[1:] + "y"), (text, text[:-1]), (text, text[1:]),
            (text, text[:10] + text[40:]), (text + text, text), ("", text), (text[:500] + text[900:], text[:499] + text[899:])]
    bounds = [F.lit(0), F.lit(2), F.lit(50)]
    df = spark.createDataFrame(rows, "a string, b string").select(
        fuzzy_lines._edits(F.col("a"), F.col("b"), bounds).alias("edits"), F.levenshtein("a", "b", 50).alias("all"))
    got = df.collect()
    assert [r["edits"] for r in got] == [r["all"] for r in got]


def test_a_sum_over_pieces_bounds_the_edits_and_is_small_for_copies(spark):
    rng = random.Random(8)
    rows = [("", "", 0), ("short", "shirt", 0), ("\u4e2d\u6587" * 40, "\u4e2d\u6587" * 38 + "\u6587", 0)]
    for n in (5, 20, 60, 300, 1200):
        words = [word(rng) for _ in range(n)]
        other = [w for w in words if rng.random() > 0.02]  # words left out, changed and put in
        other = [word(rng) if rng.random() < 0.02 else w for w in other]
        other.insert(n // 2, word(rng))
        rows += [(" ".join(words), " ".join(other), 1), (" ".join(words), " ".join(word(rng) for _ in range(n)), 0)]
    df = spark.createDataFrame(rows, "a string, b string, near int").withColumn("most", (F.length("a") * 0.1).cast("int"))
    got = df.select("near", "most", F.levenshtein("a", "b").alias("edits"), fuzzy_lines._edits_at_most(F.col("a"), F.col("b"), F.col("most")).alias("bound")).collect()
    assert all(r["bound"] >= min(r["edits"], r["most"] + 1) for r in got)
    assert all(r["bound"] == r["edits"] for r in got if r["near"] and r["edits"] <= r["most"]) and sum(r["near"] for r in got) == 5


def test_copies_are_not_compared_as_a_whole(spark, monkeypatch):
    rng = random.Random(9)
    base, rows = [word(rng) for _ in range(80)], []
    for i in range(0, 80, 2):  # near the first line, each with one word more and one word less
        rows.append(" ".join([*base[:i], word(rng), *base[i + 1:]]))
    whole, compare = [], fuzzy_lines._similar

    def noted(pairs, texts, similarity, wide=1, pieces=True):
        one, two = (texts.select(F.col("node").alias(c), F.col("line").alias(f"l{c}")) for c in "ab")
        joined = pairs.join(one, "a").join(two, "b").withColumn("most", (F.greatest(F.length("la"), F.length("lb")) * 0.1).cast("int"))
        whole.append(joined.where(fuzzy_lines._edits_at_most(F.col("la"), F.col("lb"), F.col("most")) > F.col("most")).count())
        return compare(pairs, texts, similarity, wide, pieces)

    monkeypatch.setattr(fuzzy_lines, "_similar", noted)
    df = spark.createDataFrame(list(enumerate([" ".join(base)] * 3 + rows)), "doc_id long, text string").repartition(2)
    assert [r["doc_id"] for r in fuzzy_lines.dedup(df, wide=True).where("text <> ''").collect()] == [0]
    assert sum(whole) == 0


def test_added_characters_of_long_lines_are_counted(spark):
    rng = random.Random(10)
    text = "".join(rng.choices("abc\u00e9 ", k=1500))
    long = "".join(c + ("z" if i % 25 == 0 else "") for i, c in enumerate(text))
    df = spark.createDataFrame([(text, long), (long, text), (text, long[1:]), (text, "")], "a string, b string")
    got = df.select(fuzzy_lines._edits(F.col("a"), F.col("b"), [F.lit(90)]).alias("edits"), F.levenshtein("a", "b", 90).alias("all")).collect()
    assert [r["edits"] for r in got] == [r["all"] for r in got] and got[0]["edits"] == 60


def test_keys_of_lines_are_those_of_arrays(spark):
    rng = random.Random(11)
    texts = ["one", "a b", "no 12345", "first second third", " ".join(word(rng) for _ in range(40)), "\u4e2d\u6587\u5b57 x", "\u4e2d", "z" * 19]
    lines = spark.createDataFrame([(n, t) for n, t in enumerate(texts)], "node long, line string").withColumn("length", F.length("line"))
    strange = F.col("line").rlike(fuzzy_lines.NO_BLANKS)
    lines = lines.withColumn("words", F.size(F.split("line", " "))).withColumn("plain", (F.col("words") >= 3) & ~strange)
    got = {}
    for r in fuzzy_lines._wide_keys(lines).collect():
        got.setdefault(r["node"], set()).add(r["key"])
    for n, t in enumerate(texts):
        words = t.split(" ")
        units = [*t.replace(" ", "")] if any(ord(c) > 0x3000 for c in t) else words
        grams = [(t[i:i + 6],) for i in range(len(t) - 5)] if len(units) < 3 else list(zip(units, units[1:], strict=False))
        want = []
        if grams:
            hashes = spark.createDataFrame([(g,) for g in grams], "g array<string>").select(
                F.when(F.size("g") == 1, F.xxhash64(F.get("g", F.lit(0)))).otherwise(F.xxhash64(F.get("g", F.lit(0)), F.get("g", F.lit(1)))))
            hashes = [r[0] for r in hashes.collect()]
            least = [min(h ^ m for h in hashes) for m in fuzzy_lines.MASKS]
            want += [F.hash(F.lit(i), *[F.lit(least[j]).cast("long") for j in band]) for i, band in enumerate(fuzzy_lines.BANDS)]
        if 2 <= len(words) <= 12:
            want += [F.hash(F.array(*map(F.lit, words[:i] + words[i + 1:]))) for i in range(len(words))] + [F.hash(F.array(*map(F.lit, words)))]
        if 8 < len(t) < 20:
            want += [F.hash(F.lit(t))] + [F.hash(F.lit(t[:i] + t[i + 1:])) for i in range(len(t))]
        assert got.get(n, set()) == (set(spark.range(1).select(F.array(*want)).first()[0]) if want else set()), t
