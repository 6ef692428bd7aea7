"""Fingerprints, spelling variants and the filter audit against plain versions."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import permutations

import duckdb
import pytest
from pyspark.sql import functions as F

from catalith.llm import filter_audit, fingerprints, variants

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def plain_picks(text):
    k, w, long = fingerprints.GRAM, fingerprints.WINDOW, fingerprints.LONG
    tokens = []
    for run in re.findall(r"[^ \t-\r]+", text):
        cut = max(0, len(run) - long)
        tokens += [*run[:cut], run[cut:]]
    code = lambda s: zlib.crc32(s.encode()) % fingerprints.PRIME
    if not tokens:
        return []
    if len(tokens) < k:
        return [(code(" ".join(tokens)), 0)]
    found = []
    for i in range(len(tokens) - k + 1):
        value = 0
        for x in tokens[i : i + k]:
            value = (value * fingerprints.BASE + code(x)) % fingerprints.PRIME
        found.append(value)
    kept = set()
    for s in range(max(1, len(found) - w + 1)):
        window = found[s : s + w]
        kept.add(max((i for i, x in enumerate(window) if x == min(window))) + s)
    return [(found[i], i) for i in sorted(kept)]


def like(a, b):
    a, b = {h for h, _ in a}, {h for h, _ in b}
    return len(a & b) / len(a | b) if a | b else 1.0


def written(picks):
    return ",".join(f"{h:08x}:{i}" for h, i in picks)


def awkward(seed, n=150):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        letters = rng.choice(["ab ", "abc é日𝒳", " x", "a"])
        text = "".join(rng.choice(letters) for _ in range(rng.choice([0, 1, 7, 8, 9, 17, 18, 60, 300, 2000])))
        rows.append((rng.choice([i, i, i, None, 7]), text))
    rows += [(900, "a" * 3000), (901, None), (902, ""), (903, "q"), (7, None), (7, "zz"), (904, "𝒳" * 2500), (905, " \t\n"), (906, "w " * 20000)]
    return rows + rows[:9]


@pytest.mark.parametrize("rows", [awkward(4), [(5, "one two three four five")], [(None, "x y")] * 3, []])
def test_fingerprints_are_those_of_a_plain_version(spark, rows):
    docs = spark.createDataFrame([(d, t, "l", "s", 0) for d, t in rows], DOCS).repartition(4).withColumns({"range": F.lit(1), "picks": F.lit("x"), "id": F.lit(2)})
    got = sorted(map(str, map(tuple, fingerprints.edited(docs).collect())))
    digest = {r["text"]: r["d"] for r in spark.createDataFrame([(t or "",) for _, t in rows], "text string").select("text", F.shiftrightunsigned(F.xxhash64("text"), 1).alias("d")).collect()} if rows else {}
    order = sorted(((d, t or "") for d, t in rows), key=lambda x: (x[0] is None, -(x[0] or 0), digest[x[1]], x[1].encode()))
    want = []
    for (d, t), (_, following) in zip(order, order[1:] + order[:1], strict=True):
        edit = t[: len(t) - len(t) // 2] + following[: len(t) // 2]
        p, q = plain_picks(t), plain_picks(edit)
        want.append((d, len(t), hashlib.sha256(edit.encode()).hexdigest(), written(p), written(q), like(p, q), like(p, plain_picks(following))))
    assert got == sorted(map(str, want))


def test_hot_ids_are_split_and_keep_their_order(spark):
    rng = random.Random(8)
    rows = [(50 if i % 2 else i, f"text {rng.randrange(400)} {i % 3}") for i in range(1000)] + [(None, f"n {i}") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    parts = fingerprints.dealt(docs).where("ghost = 0").groupBy("range", "part").count().collect()
    assert max(r["count"] for r in parts) < 100 and sum(r["count"] for r in parts) == len(rows)
    digest = {r["text"]: r["d"] for r in docs.select("text", F.shiftrightunsigned(F.xxhash64("text"), 1).alias("d")).collect()}
    order = sorted(rows, key=lambda x: (x[0] is None, -(x[0] or 0), digest[x[1]], x[1].encode()))
    want = Counter(zip(order, (t for _, t in order[1:] + order[:1]), strict=True))
    got = Counter(((r["id"], r["text"]), r["next_text"]) for r in fingerprints.neighbours(docs).collect())
    assert got == want


def test_shared_passages_share_a_fingerprint(spark):
    rng = random.Random(2)
    texts = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(60)) for _ in range(40)]
    passage = " ".join(f"p{i}" for i in range(fingerprints.REACH))
    docs = spark.createDataFrame([(i, f"{t} {passage} {t[::-1]}") for i, t in enumerate(texts)], "doc_id long, text string")
    found = [dict((h, at) for h, at in ((x % fingerprints.PLACE, x // fingerprints.PLACE) for x in r["picks"])) for r in fingerprints.fingerprints(docs).collect()]
    shared = set.intersection(*map(set, found))
    assert shared and all(60 <= f[h] <= 60 + fingerprints.REACH - fingerprints.GRAM for f in found for h in shared)


def one_apart(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(counts):
    near = {w: [v for v in counts if one_apart(w, v)] for w in counts}
    form = {}
    for w in counts:
        best = min(near[w], key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best and counts[best] >= 2 * counts[w] else None

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return {(w, form[w], root(w), counts[w], len(near[w]), counts[form[w]] if form[w] else None) for w in counts}


@pytest.mark.parametrize("share", [1 << 17, 64])
def test_variants_are_those_of_a_plain_version(spark, monkeypatch, share):
    monkeypatch.setattr(variants, "SHARE", share)
    rng = random.Random(1)
    counts = {"a" * 300: 5, "a" * 299: 11, "a" * 299 + "b": 3, "b" + "a" * 298: 40}
    while len(counts) < 400:
        counts["".join(rng.choice("abé") for _ in range(rng.randint(5, 8)))] = rng.randint(3, 60)
    got = variants.variants(spark.createDataFrame(list(counts.items()), "word string, n long").repartition(3)).collect()
    assert {(r["word"], r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in got} == plain_variants(counts) and len(got) == len(counts)


def test_colliding_keys_are_told_apart_by_their_strings(spark, monkeypatch):
    rng = random.Random(3)
    counts = {"".join(rng.choice("abc") for _ in range(6)): rng.randint(3, 9) for _ in range(150)}
    real = variants.keys
    monkeypatch.setattr(variants, "keys", lambda words: (lambda o, p, k: (o, p, k % variants.T.U(7)))(*real(words)))
    batch = variants.pa.record_batch({"word": list(counts), "n": variants.pa.array(counts.values(), variants.pa.int64())})
    dealt = variants.pa.Table.from_batches(list(variants._deal(0)([batch])))
    got = variants._met(dealt).to_pylist()
    want = {w: [v for v in counts if one_apart(w, v)] for w in counts}
    assert {r["word"]: r["near"] for r in got} == {w: len(v) for w, v in want.items() if v}
    assert all(r["best"] == min(want[r["word"]], key=lambda v: (-counts[v], v)) for r in got)


def test_long_words_of_one_letter_take_work_in_proportion():
    words = ["a" * 200_000, "a" * 199_999, "a" * 199_999 + "b"]
    batch = variants.pa.record_batch({"word": words, "n": variants.pa.array([3, 9, 4], variants.pa.int64())})
    got = variants._met(variants.pa.Table.from_batches(list(variants._deal(0)([batch])))).to_pylist()
    assert {r["word"][-2:]: (r["near"], r["best_n"]) for r in got if len(r["word"]) == 200_000} == {"aa": (2, 9), "ab": (2, 9)}


def test_variants_of_documents(spark):
    texts = [(i, t) for i, t in enumerate(["Straße STRASSE straßen, naïve—Naïve×naïve", None, "", " ", "abcd abcde Abcde"] * 60)] + [(None, "abcde abcdf"), (3, "abcde")] * 3
    docs = spark.createDataFrame([(d, t, "l", "s", 0) for d, t in texts], DOCS).withColumns({"id": F.lit(1), "run": F.lit("x"), "word": F.lit("y")})
    counts = Counter()
    for d, t in texts:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            at = h % len(run)
            word = run[:at] + run[at + 1 :] if h % 97 == 0 else run
            counts[word] += len(word) >= 5
    counts = {w: n for w, n in counts.items() if n >= 3}
    got = variants.variants(variants.counted(variants.misspelt(variants.runs(docs), 97, 5), 3)).collect()
    assert {(r["word"], r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in got} == plain_variants(counts)
    assert variants.variants(spark.createDataFrame([], "word string, n long")).count() == 0


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for name in ("documents", "labels"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")
    return con


@pytest.mark.parametrize("module", [variants, filter_audit])
def test_late_queries_agree_with_their_sql(spark, sf, duck, module):
    theirs = duck.sql(module.SQL)
    assert sorted(map(str, theirs.fetchall())) == sorted(str(tuple(r)) for r in module.query(spark, sf).select(*theirs.columns).collect())


def test_audit_is_that_of_a_plain_replay(spark):
    rng = random.Random(6)
    texts = [None, "", "A", "a b # c", " ".join(["word"] * 120), " ".join(f"w{i}" for i in range(150)), " ".join(f"W{i}" for i in range(150)), "x" * 500, "É " * 130]
    rows = [(rng.choice([i, i, None, 3]), rng.choice(texts), rng.choice(["en", "de", None])) for i in range(120)]
    rows += rows[:7]
    marks = [(i, rng.choice([0, 1, None]), rng.choice([0, 1])) for i in range(0, 120, 2)] + [(4, 1, 0), (None, 1, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns({"part": F.lit("?"), "n": F.lit(9), "key": F.lit(1), "good": F.lit("g")})
    got = filter_audit.audit(docs, spark.createDataFrame(marks, "doc_id long, quality int, toxic int")).collect()
    good, toxic = {d for d, q, _ in marks if q == 1 and d is not None}, {d for d, _, x in marks if x == 1 and d is not None}
    order = lambda d: (d is None, d or 0)
    first = {}
    for d, t, _ in rows:
        first[t or ""] = min(first.get(t or "", order(d)), order(d))
    want = defaultdict(lambda: [0] * 6)
    shapley = Counter()
    for d, t, part in rows:
        t = t or ""
        words = re.findall(r"[^ \t-\r]+", t)
        fails = {"A": len(words) < 100, "B": 100 * len(set(words)) < 80 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": order(d) > first[t]}
        for o in map("".join, permutations("ABCDE")):
            gone = next((i for i, x in enumerate(o, 1) if fails[x]), 6)
            for step, x in enumerate(o, 1):
                here = gone == step
                for i, yes in enumerate((gone > step, here, gone < step and fails[x], fails[x] and sum(fails.values()) == 1, here and d in good, here and d in toxic)):
                    want[part or "", o, step][i] += yes
                shapley[part or "", x] += here
    assert {(r["part"], r["filter_order"], r["step"]): [r[c] for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")] for r in got} == want
    assert all(r["shapley"] == shapley[r["part"], r["filter_order"][r["step"] - 1]] for r in got) and len(got) == 3 * 600
    assert filter_audit.audit(docs.limit(0), spark.createDataFrame([], "doc_id long, quality int, toxic int")).count() == 0
