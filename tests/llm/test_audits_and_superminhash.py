"""Filter interactions, source divergence and SuperMinHash against brute force, on hard cases and empty tables."""

import collections
import itertools
import random
import re
import sys
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))

import cases  # noqa: E402
from opslake.llm import divergence, interactions, superminhash  # noqa: E402
from opslake.llm.ngram_join import Shingles, _mix  # noqa: E402

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs(spark):
    return cases.documents(spark).cache()


@pytest.fixture(scope="module")
def no_docs(spark):
    return cases.documents(spark, empty=True)


# 11: filter interactions

def fails_by_hand(text, is_copy):
    words = WORD.findall(text)
    out = "A" if len(words) < 50 else ""
    out += "B" if 100 * len(set(words)) < 65 * len(words) else ""
    out += "C" if 100 * len(re.findall("[A-Z]", text)) > 5 * len(text) else ""
    out += "D" if re.search("[#$%&*|]", text) else ""
    return out + ("E" if is_copy else "")


def audit_by_hand(rows, labels):
    """rows (id, text, source); labels (id, quality, toxic)."""
    good, toxic = {i for i, q, _ in labels if q == 1}, {i for i, _, t in labels if t == 1}
    least = {}
    for i, text, _ in rows:
        if i is not None:
            least[text or ""] = min(i, least.get(text or "", i))
    out = collections.Counter()
    parts = {s or "" for _, _, s in rows}
    for i, text, source in rows:
        fails, part = fails_by_hand(text or "", i is not None and least[text or ""] < i), source or ""
        for order in itertools.permutations("ABCDE"):
            name, gone = "".join(order), False
            for step, letter in enumerate(order, 1):
                hit, key = letter in fails, (part, name, step)
                out[(*key, "unique_fails")] += fails == letter
                out[(*key, "redundant")] += hit and gone
                out[(*key, "removed")] += hit and not gone
                out[(*key, "good_lost")] += hit and not gone and i in good and i is not None
                out[(*key, "toxic_lost")] += hit and not gone and i in toxic and i is not None
                if hit and not gone:
                    out[part, letter] += 1
                gone |= hit
                out[(*key, "kept")] += not gone
    names = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost"]
    return {(p, "".join(o), s): (*(out[p, "".join(o), s, n] for n in names), out[p, o[s - 1]])
            for p in parts for o in itertools.permutations("ABCDE") for s in range(1, 6)}


def audited(df):
    return {(r["part"], r["filter_order"], r["step"]): tuple(r[c] for c in (
        "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")) for r in df.collect()}


@pytest.mark.parametrize("files", [1, 100])
def test_interactions_whatever_the_batches(spark, docs, tmp_path, files):
    # Each file holds smaller ids than the one before, so that every text is retracted again and again.
    for k, (low, high) in enumerate([(40, 1000), (20, 39), (9, 19), (0, 8)]):
        docs.where(F.col("doc_id").between(low, high) | (F.col("doc_id").isNull() if k == 1 else F.lit(False))).coalesce(1).write.mode(
            "append").parquet(f"{tmp_path}/docs")
    copies = docs.where("doc_id IN (8, 20, 21)").withColumn("doc_id", F.col("doc_id") + 500).withColumn("source", F.lit("other"))
    copies.coalesce(1).write.mode("append").parquet(f"{tmp_path}/docs")
    got = interactions.audit(spark, f"{tmp_path}/docs", cases.labels(spark).withColumn("toxic", (F.col("doc_id") % 5 == 0).cast("int")),
                             files_per_batch=files)
    rows = [tuple(r) for r in docs.unionByName(copies).select("doc_id", "text", "source").collect()]
    labels = [(r["doc_id"], r["quality"], int(r["doc_id"] is not None and r["doc_id"] % 5 == 0)) for r in cases.labels(spark).collect()]
    assert audited(got) == audit_by_hand(rows, labels)


def test_interactions_go_on_where_they_ended(spark, docs, tmp_path):
    later, sooner = docs.where("doc_id >= 20"), docs.where("doc_id < 20")
    later.coalesce(1).write.parquet(f"{tmp_path}/docs")
    labels = cases.labels(spark)
    interactions.audit(spark, f"{tmp_path}/docs", labels, run=f"{tmp_path}/run").count()
    sooner.coalesce(1).write.mode("append").parquet(f"{tmp_path}/docs")
    got = interactions.audit(spark, f"{tmp_path}/docs", labels, run=f"{tmp_path}/run")
    rows = [tuple(r) for r in docs.where("doc_id IS NOT NULL").select("doc_id", "text", "source").collect()]
    assert audited(got) == audit_by_hand(rows, [tuple(r) for r in labels.collect()])


def test_interactions_of_an_empty_table(spark, no_docs, tmp_path):
    no_docs.write.parquet(f"{tmp_path}/docs")
    assert interactions.audit(spark, f"{tmp_path}/docs", cases.labels(spark)).count() == 0


# 12: source divergence

def divergence_by_hand(rows, min_docs=3, top=200):
    """rows (text, lang, source)."""
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    docs, counts, groups = collections.Counter(), collections.Counter(), collections.defaultdict(set)
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups[lang].add(source)
        terms = re.findall(divergence.TERM, (text or "").translate(low))
        docs.update((lang, t) for t in set(terms))
        counts.update((lang, source, t) for t in terms)
    out = set()
    for lang, sources in groups.items():
        kept = [t for (at, t), n in docs.items() if at == lang and n >= min_docs]

        def prices(some, lang=lang, kept=kept):
            n = {t: sum(counts[lang, s, t] for s in some) for t in kept}
            total = sum(n.values())
            return {t: 1 + 10**9 * (n[t] + 1) // (total + len(kept)) for t in kept}

        whole, own = prices(sources), {s: prices([s]) for s in sources}
        for s in sources:
            pairs = [(-sum((own[s][t] - own[o][t]) ** 2 // own[o][t] for t in kept), o.encode()) for o in sources if o != s]
            terms = [(-((own[s][t] - whole[t]) ** 2 // whole[t]), t.encode()) for t in kept
                     if counts[lang, s, t] and own[s][t] > whole[t]]
            for part, found, most in (("pair", pairs, None), ("term", terms, top)):
                for rank, (value, item) in enumerate(sorted(found)[:most], 1):
                    out.add((lang, s, part, item.decode(), -value, rank))
    return out


@pytest.mark.parametrize("top, at_once", [(200, 1 << 20), (3, 7)])
def test_divergence(spark, docs, top, at_once, monkeypatch):
    monkeypatch.setattr(divergence, "PAIRS_AT_ONCE", at_once)
    many = docs.unionByName(docs.where("doc_id IN (8, 30)").withColumn("source", F.lit("")).withColumn("lang", F.lit("xx"))).unionByName(
        docs.where("doc_id > 40").withColumn("source", F.lit("Ä")))
    got = divergence.audit(many, top=top).collect()
    want = divergence_by_hand([tuple(r) for r in many.select("text", "lang", "source").collect()], top=top)
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_divergence_without_terms(spark, no_docs):
    assert divergence.audit(no_docs).count() == 0
    bare = spark.createDataFrame([("12 34", "en", "a"), (None, "en", "b"), ("one", "en", None), ("x", "de", "a")], "text string, lang string, source string")
    got = {tuple(r) for r in divergence.audit(bare).collect()}
    assert got == divergence_by_hand([tuple(r) for r in bare.collect()])
    assert len(got) == 6 and {r[4] for r in got} == {0}


# 13: SuperMinHash

def signature_by_hand(elements, places):
    """One element after the other, each with a whole permutation."""
    best = [2**64 - 1] * places
    for e in elements:
        order = list(range(places))
        for rank in range(places):
            drawn = int(_mix(np.array([(int(e) + (rank + 1) * 0x9E3779B97F4A7C15) % 2**64], dtype=np.uint64))[0])
            k = rank + ((drawn & 0xFFFF) * (places - rank) >> 16)
            order[rank], order[k] = order[k], order[rank]
            best[order[rank]] = min(best[order[rank]], rank << 48 | drawn >> 16)
    return best


@pytest.mark.parametrize("chunk", [5, 1 << 13])
def test_signatures_stop_early_without_a_change(chunk, monkeypatch):
    monkeypatch.setattr(superminhash, "CHUNK", chunk)
    rng = np.random.default_rng(3)
    sets = [rng.integers(0, 2**63, n, dtype=np.uint64) for n in (1, 2, 3, 17, 40, 200)]
    got = superminhash.signatures(sets, 24)
    assert [list(map(int, s)) for s in got] == [signature_by_hand(s, 24) for s in sets]
    assert superminhash.signatures([], 24).shape == (0, 24)


def test_signatures_estimate_with_less_variance_than_independent_hashes():
    rng = np.random.default_rng(4)
    places, shared, apart, errors = 64, 40, 10, []
    for _ in range(400):
        e = rng.integers(0, 2**63, shared + 2 * apart, dtype=np.uint64)
        a, b = superminhash.signatures([e[:shared + apart], np.concatenate([e[:shared], e[shared + apart:]])], places)
        errors.append((a == b).mean() - shared / (shared + 2 * apart))
    share = shared / (shared + 2 * apart)
    assert abs(np.mean(errors)) < 0.01 and np.var(errors) < 0.85 * share * (1 - share) / places


def grouped_by_hand(rows, width, percent):
    sets = [set(s.tolist()) for s in Shingles(width).sets([t for _, t in rows])]
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        a, b = sets[i], sets[j]
        if a and b and 100 * len(a & b) >= percent * len(a | b):
            up[max(root(i), root(j))] = min(root(i), root(j))
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[root(i)] = min(doc, least.get(root(i), doc))
    return collections.Counter((doc, len(s), c := least.get(root(i)) if s else doc, doc == c if doc is not None else c is None)
                               for i, ((doc, _), s) in enumerate(zip(rows, sets)))


def bag(df):
    return collections.Counter((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in df.collect())


@pytest.mark.parametrize("width, percent", [(2, 80), (5, 80)])
def test_near_duplicates_hard_cases(docs, no_docs, width, percent):
    assert bag(superminhash.near_duplicates(docs, width=width, percent=percent)) == grouped_by_hand(cases.pairs(docs), width, percent)
    assert superminhash.near_duplicates(no_docs, width=width, percent=percent).count() == 0


@pytest.mark.parametrize("seed, hubs, turn", [(1, 2, 4), (2, 1, 1)])
def test_near_duplicates_in_families_around_the_threshold(spark, seed, hubs, turn, monkeypatch):
    # Chains of small edits, and many variants of one text that share a part and are mostly not alike.
    monkeypatch.setattr(superminhash, "FIRST_HUBS", hubs)
    monkeypatch.setattr(superminhash, "TURN_HUBS", turn)
    rng = random.Random(seed)
    texts = []
    for family in range(3):
        base = [f"w{rng.randint(0, 400)}" for _ in range(80)]
        for _ in range(60):
            words = list(base)
            for _ in range(rng.randint(0, 9)):
                words[rng.randrange(len(words))] = f"x{rng.randint(0, 999)}"
            texts.append(" ".join(words))
            if rng.random() < 0.3:
                base = words
    rows = list(enumerate(texts)) + [(1000, texts[0]), (None, texts[3])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert bag(superminhash.near_duplicates(df, width=2)) == grouped_by_hand(rows, 2, 80)


def test_links_of_a_task_become_stars(spark):
    rng = random.Random(6)
    edges = [(rng.randint(0, 200), rng.randint(0, 200)) for _ in range(180)]
    made = superminhash.joined_in_tasks(spark.createDataFrame(edges, "a long, b long").coalesce(1)).collect()
    assert len({r["a"] for r in made}) == len(made) and not {r["a"] for r in made} & {r["b"] for r in made}
