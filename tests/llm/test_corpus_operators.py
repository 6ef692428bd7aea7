"""Each operator against a plain version, on a small table with awkward rows."""

import random
import tracemalloc
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from catalith.llm import counting, decontaminate, exact_dedup, jaccard_join, language, licenses, lm_score, packing, pii, text as T, toxicity, url_filter
from tests.llm import brute

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def near_copies(seed=3, clusters=6, size=12):
    """Clusters of texts with a few words changed, one hot passage in most texts."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(900)]
    hot = " ".join(rng.choice(vocabulary) for _ in range(40))
    texts = []
    for c in range(clusters):
        base = [rng.choice(vocabulary) for _ in range(rng.choice((6, 30, 70, 300)))]
        for i in range(size):
            words = list(base)
            for _ in range(rng.randint(0, max(1, len(words) // 30))):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            texts.append(" ".join(words) + ("  " + hot if (c + i) % 3 else ""))
    return texts


AWKWARD = [None, "", " \t\n", "one", "Two  words", "two WORDS", "é ñ ß", "x" * 5000, "+" * 300, "1.2.3.4" + ".5" * 400, "a@" + "b." * 3000 + "c", "9" * 3000, " ".join(["word"] * 4000), "İstanbul straße 𝒳𝒴 日本語", "a <|ENDOFTEXT|> b, x<|StartOfText|>. And <|endoftext|>Y <|startoftext|>", "it's. O'K!! É... ÉÜ× ÷. a|b c| | |d e\u0301. f*** \u00bb. ª. 7, (x) ...", "I'll.' 're!! x.'s y'd) ñ& ß,, n\u0303\u00a0o: \u2003p;"]


@pytest.fixture(scope="module")
def rows(spark, sf):
    some = [r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").limit(60).collect()]
    return [(i, t, "en", "s", 0) for i, t in enumerate(AWKWARD + near_copies() + some + some[:5])]


@pytest.fixture(scope="module")
def docs(spark, rows):
    wide = spark.createDataFrame(rows, DOCS).repartition(5)
    return wide.withColumns({"kind": F.lit("x"), "token": F.lit(1), "range": F.lit(2), "id": F.lit(None).cast("string")})


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def test_shingles_and_words_are_those_of_the_plain_version(rows):
    raw, offsets = T.flat(pa.array([r[1] for r in rows]))
    for k in (4, 5):
        _, bounds = T.shingle_sets(raw, offsets, k)
        assert [int(b - a) for a, b in zip(bounds, bounds[1:], strict=False)] == [len(brute.shingles(r[1], k)) for r in rows]


def test_words_do_not_depend_on_slices(monkeypatch, rows):
    raw, offsets = T.flat(pa.array([r[1] for r in rows]))
    whole = T.words(raw, offsets)
    monkeypatch.setattr(T, "SLICE", 1 << 9)
    T._powers.cache_clear()
    parts = T.words(raw, offsets)
    T._powers.cache_clear()
    assert all((a == b).all() for a, b in zip(whole, parts, strict=True))


def test_packed_keys_come_back():
    import numpy as np

    for keys in ([], [7], [0, 1, 2**64 - 1], sorted({zlib.crc32(str(i).encode()) << 31 for i in range(1000)})):
        keys = np.array(keys, np.uint64)
        assert (T.unpack_sorted(T.pack_sorted(keys)) == keys).all()


def test_pii_base_is_that_of_plain_regular_expressions(spark, docs, rows):
    got = {r["doc_id"]: r for r in pii.pii(docs).collect()}
    assert len(got) == len(rows)
    for i, text, *_ in rows:
        base = brute.pii(text)
        assert [got[i][f"n_{k}"] for k in pii.KINDS] == [sum(x[0] == k for x in base) for k in pii.KINDS], text
        assert got[i]["base_sha256"] == brute.sha(",".join(f"{k}:{a}:{b}" for k, a, b in base))
        assert {f"{k}:{a}:{b}" for k, a, b in base} <= set(got[i]["spans"].split(",")) | {""}


def test_pii_matches_adjoin_and_overlap_as_plain_ones_do(spark):
    texts = ["a@b.c%d@e.f", "a@b@c.d", "1.2.3.4.5.6.7.8", "256.1.1.1 01.002.003.0255", "+1 (974) 555-3436.", "+12345678", "4539 1488 0343 6467 4539148803436467", "x\u00e9 a@b.co \U0001f600 9.8.7.6", "..@a.b", "a@b.c..d@e.f"]
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate(texts)], DOCS)
    for r in pii.pii(docs.unionByName(docs)).collect():
        assert r["spans"] == ",".join(f"{k}:{a}:{b}" for k, a, b in brute.pii(texts[r["doc_id"]])), texts[r["doc_id"]]


def test_pii_learns_contexts(spark):
    seeds = [f"please call +1 555 010 {i:04d} today" for i in range(40)]
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate([*seeds, "please call 555-010-4477 today", "sold 555-010-4477 boxes"])], DOCS)
    got = {r["doc_id"]: r for r in pii.pii(docs, accept=0.8).collect()}
    assert got[40]["spans"] == "phone:12:24" and got[40]["n_added"] == 1 and got[40]["n_phone"] == 0
    assert got[41]["spans"] == ""


def test_pii_learns_from_what_it_accepted_and_counts_copies_once(spark):
    first = [f"please call +1 555 010 {i:04d} today" for i in range(60)]
    second = [f"please call 555-010-44{i:02d} swiftly" for i in range(10)] + [f"hotline 555-020-44{i:02d} today" for i in range(10)]
    third = "hotline 555-030-4477 swiftly"
    copied = "please call 555-040-4477 today"
    texts = [*first, *second, third, *[copied] * 300]
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate(texts)], DOCS)
    got = {r["doc_id"]: r["n_added"] for r in pii.pii(docs, accept=0.7).collect()}
    assert [i for i in range(60, len(texts)) if got[i] != 1] == [] and not any(got[i] for i in range(60))


def tiling(doc, item, least=5):
    """Greedy string tiling by its definition."""
    marked_doc, marked_item, covered = set(), set(), 0
    while True:
        best = None
        for q in range(len(item)):
            for p in range(len(doc)):
                n = 0
                while p + n < len(doc) and q + n < len(item) and doc[p + n] == item[q + n] and p + n not in marked_doc and q + n not in marked_item:
                    n += 1
                if n >= least and (best is None or (-n, q, p) < best):
                    best = (-n, q, p)
        if best is None:
            return covered
        n, q, p = -best[0], best[1], best[2]
        marked_doc.update(range(p, p + n))
        marked_item.update(range(q, q + n))
        covered += n


def test_decontamination_is_greedy_string_tiling(spark):
    rng = random.Random(1)
    items = [[rng.choice("abcdefghijkl") + rng.choice("xyz") for _ in range(rng.randint(3, 30))] for _ in range(8)]
    texts = []
    for _ in range(60):
        item = rng.choice(items)
        cut = rng.randint(0, len(item))
        parts = [item[cut:], [rng.choice("pqrst") for _ in range(rng.randint(0, 4))], item[:cut], rng.choice(items)[:9]]
        texts.append([w for p in rng.sample(parts, 4) for w in p])
    docs = spark.createDataFrame([(i, " ".join(t).upper(), None, None, None) for i, t in enumerate(texts)] + [(900, None, None, None, None), (901, "", None, None, None)], DOCS)
    bench = spark.createDataFrame([(i, ", ".join(x)) for i, x in enumerate(items)] + [(90, None), (91, "too short")], "item_id long, text string")
    want = {(d, i): n for d, t in enumerate(texts) for i, x in enumerate(items) if len(x) >= 5 and (n := tiling(t, x)) >= 0.8 * len(x)}
    for block in (8 << 20, 60):
        got = {(r["doc_id"], r["item_id"]): r["covered_words"] for r in decontaminate.leaks(docs, bench, block_bytes=block).collect()}
        assert got == want and want
    assert decontaminate.leaks(docs, bench.limit(0)).count() == 0 and decontaminate.leaks(docs.limit(0), bench).count() == 0


@pytest.mark.parametrize("piece", [7, 1 << 20])
def test_tiles_of_repetitive_texts_are_those_of_the_definition(monkeypatch, piece):
    monkeypatch.setattr(decontaminate, "PIECE", piece)
    random = np.random.default_rng(5)
    for vocabulary in [1, 2, 3] * 20:
        item = [f"w{x}" for x in random.integers(0, vocabulary, random.integers(5, 40))]
        doc = [f"w{x}" for x in random.integers(0, vocabulary, random.integers(5, 120))]
        block = decontaminate.index(pa.table({"item_id": [1], "text": [" ".join(item)], "times": [1]}))
        got = {item_: n for _, item_, n, _ in decontaminate._leaks_of(block, 0.0, pa.array([" ".join(doc)]))}
        assert got.get(0, 0) == tiling(doc, item)


def test_a_repetitive_text_takes_memory_in_proportion():
    block = decontaminate.index(pa.table({"item_id": [1], "text": ["so " * 300], "times": [1]}))
    tracemalloc.start()
    assert [x[1:] for x in decontaminate._leaks_of(block, 0.8, pa.array(["so " * 200_000]))] == [(0, 300, 1)]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 300 << 20


def test_decontamination_of_repeated_rows_nulls_and_clashing_columns(spark):
    text = "one two three four five six seven"
    docs = spark.createDataFrame([(1, text, "x"), (1, text, "x"), (None, text, None), (2, None, "x"), (3, "", "x")], "doc_id long, text string, item_id string")
    bench = spark.createDataFrame([(7, text), (7, text), (None, text), (8, "too short"), (9, None)], "item_id long, text string")
    got = sorted((str(r["doc_id"]), str(r["item_id"])) for r in decontaminate.leaks(docs, bench).collect())
    assert got == sorted([("1", "7")] * 4 + [("1", "None")] * 2 + [("None", "7")] * 2 + [("None", "None")])
    assert [r["doc_id"] for r in decontaminate.clean(docs, bench).orderBy("doc_id").collect()] == [2, 3]


def accuracy(rows, label, predicted):
    return sum(r[label] == r[predicted] for r in rows) / max(1, len(rows))


def test_language_is_right_on_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language.language_id(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r["held_out"]]
    assert len(got) == docs.count() and len(held) > 100
    assert all(r["held_out"] == (brute.fold(r["doc_id"]) == 0) for r in got)
    assert accuracy(held, "lang", "lang_pred") > 0.97 and all(0 <= r["score"] <= 1 for r in got)


def test_language_of_awkward_rows(spark, docs, rows, empty):
    got = {r["doc_id"]: r for r in language.language_id(docs).collect()}
    assert len(got) == len(rows)
    for i in (0, 1, 2, 8, 11):
        assert (got[i]["lang_pred"], got[i]["score"]) == ("und", 1.0)
    assert got[3]["lang_pred"] == "en" and language.language_id(empty).count() == 0
    nulls = spark.createDataFrame([(None, "words here", None, None, None)] * 2, DOCS)
    assert [tuple(r) for r in language.language_id(nulls).collect()] == [(None, None, "und", 0.0)] * 2


def test_toxicity_is_right_on_held_out_documents(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    got = toxicity.toxicity(docs, labels).join(labels, "doc_id").where("held_out").collect()
    hit = [r for r in got if r["predicted"] == 1]
    assert accuracy(got, "toxic", "predicted") > 0.97
    assert sum(r["toxic"] for r in hit) >= 0.93 * len(hit) and sum(r["toxic"] for r in hit) >= 0.8 * sum(r["toxic"] for r in got)


def test_toxicity_of_awkward_rows(spark, docs, rows, empty):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r["score"] for r in toxicity.toxicity(docs, none).collect()} == {0.0}
    one = spark.createDataFrame([(i, 1) for i in range(20)] + [(None, 1), (3, None)], "doc_id long, toxic int")
    assert {r["score"] for r in toxicity.toxicity(docs, one).collect()} == {1.0}
    both = spark.createDataFrame([(i, i % 2) for i in range(len(rows))], "doc_id long, toxic int")
    got = toxicity.toxicity(docs, both).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)
    assert toxicity.toxicity(empty, both).count() == 0


def test_exact_dedup(spark, docs, rows, empty):
    groups = defaultdict(list)
    norm = lambda t: brute.SPACE.sub(" ", t or "")
    for i, t, *_ in rows:
        groups[norm(t)].append(i)
    got = exact_dedup.exact_dedup(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        mine = norm(rows[r["doc_id"]][1])
        assert (r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) == (min(groups[mine]), len(groups[mine]), r["doc_id"] == min(groups[mine]), brute.sha(mine))
    assert exact_dedup.exact_dedup(empty).count() == 0
    twice = spark.createDataFrame([(1, "a", None, None, None)] * 2 + [(None, "a", None, None, None), (None, "b", None, None, None)], DOCS)
    assert sorted(map(str, (tuple(r)[:4] for r in exact_dedup.exact_dedup(twice).collect()))) == sorted(map(str, [(1, 1, 3, True)] * 2 + [(None, 1, 3, False), (None, None, 1, True)]))


def test_fill_is_the_closest_sum():
    rng = random.Random(5)
    for _ in range(200):
        lengths = {rng.randint(1, 40): rng.randint(1, 3) for _ in range(rng.randint(0, 6))}
        capacity = rng.randint(1, 100)
        sums = {0}
        for length, n in lengths.items():
            sums = {s + length * k for s in sums for k in range(n + 1)}
        taken, slack = packing.fill(lengths, capacity)
        assert slack == capacity - max(s for s in sums if s <= capacity)
        assert all(n <= lengths[x] for x, n in taken.items()) and sum(x * n for x, n in taken.items()) == capacity - slack


@pytest.mark.parametrize("batch", [2_000_000, 9_000])
def test_packing_holds_every_id_once(spark, docs, rows, empty, batch):
    import numpy as np
    from tokenizers import Tokenizer

    path = packing.tokenizer_path()
    tokenizer = Tokenizer.from_file(path)
    got = packing.pack(docs, path, batch_tokens=batch).collect()
    ids = {i: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2] for i, t, *_ in rows}
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in got:
        pieces[r["doc_id"]].append((r["start"], r["length"]))
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
        part = np.array(ids[r["doc_id"]][r["start"] : r["start"] + r["length"]], "<u4")
        assert r["ids_crc32"] == zlib.crc32(part.tobytes()) and r["doc_tokens"] == len(ids[r["doc_id"]])
    for i, mine in ids.items():
        assert [x for a, n in sorted(pieces[i]) for x in range(a, a + n)] == list(range(len(mine)))
    for x in sequences.values():
        assert [a for n0, n in sorted(x) for a in range(n0, n0 + n)] == list(range(total := sum(n for _, n in x)))
        assert total == 4096 or total & (total - 1) == 0 and total < 4096
    assert packing.pack(empty, path).count() == 0


def test_words_that_are_forgotten_keep_their_ids(monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(packing, "REMEMBER", 40)
    path = packing.tokenizer_path()
    words, tokenizer = packing.Words(path), Tokenizer.from_file(path)
    draw = random.Random(4)
    for _ in range(60):
        texts = [" ".join(draw.choice(["so", "Ever", "on", "né", "x|", "a1"]) + str(int(draw.expovariate(0.1))) + draw.choice(["", ".", "!?", "'s", "''."]) for _ in range(draw.choice([0, 3, 60]))) for _ in range(3)]
        assert [np.frombuffer(x, "<u4").tolist() for x in words.ids([x.encode() for x in texts], b"")] == [tokenizer.encode(x, add_special_tokens=False).ids for x in texts]
        assert len(words.known) + len(words.older) <= 40


def test_url_rules_and_parts(spark):
    urls = [None, "", "no scheme", "http://", "https://Sub.EXAMPLE.com/en/7?x#y", "http://example.com/en/70", "http://example.com/en/8", "http://a.net/de/x", "http://example.net/de/8", "ftp://org/es/", "http://borg/es/", "http://com", "http://a.com?/en/", "x://y://z.com/en/q", "http://a.COM/EN/"]
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)], "page_id long, url string, html string").withColumn("suffix", F.lit("x"))
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.url_filter(pages).collect()}
    assert [got[i][:2] for i in range(5)] == [("", "")] * 4 + [("sub.example.com", "/en/7")]
    assert [got[i][2] for i in range(4, 15)] == ["example.com/en/7", "example.com/en/7", "com/en/", "net/de/", "example.net/de/8", "org/es/", None, None, None, None, None]
    assert [got[i][3] for i in range(4, 10)] == ["allow", "allow", "block", "allow", "block", "block"]
    assert got[13][:2] == ("y:", "//z.com/en/q") and all(x[3] in ("allow", "block") for x in got.values())
    assert url_filter.url_filter(pages.limit(0)).count() == 0
    assert {r["verdict"] for r in url_filter.url_filter(pages.where("page_id = 10")).collect()} == {"allow"}


def test_url_trees_learn_from_labelled_urls(spark, sf):
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    got = url_filter.url_filter(pages).where("rule IS NOT NULL").collect()
    assert sum((r["score"] >= 0.5) == (r["verdict"] == "block") for r in got) > 0.85 * len(got)  # the rules have exceptions that the features do not see


def test_license_scan(spark):
    body = "some words come first here and then "
    apache = licenses.TEMPLATES["Apache-2.0"]
    texts = [body + apache + " more", "é " + apache.upper().replace(",", ""), body, None, "", "Licensed under the new Apache License, Version 2.0", apache + " " + "filler " * 20 + apache, "license version under the", licenses.TEMPLATES["MIT-text"].replace("modify, ", "")]
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate(texts)], DOCS)
    got = defaultdict(list)
    for r in licenses.license_scan(docs).collect():
        got[r["doc_id"]].append((r["license"], round(r["coverage"], 2), r["start"], r["end"]))
    assert got[0] == [("Apache-2.0", 1.0, len(body), len(body + apache) - 1)]
    assert got[1] == [("Apache-2.0", 1.0, 2, 2 + len(apache) - 2)]
    assert got[5] == [("Apache-2.0", 1.0, 0, len(texts[5]))]
    assert sorted(x[2] for x in got[6]) == [0, len(apache) + 1 + 7 * 20]
    assert [x[0] for x in got[8]] == ["MIT-text"] and 0.95 < got[8][0][1] < 1
    assert not got[2] and not got[3] and not got[4] and not got[7]


def test_license_names_tell_kin_apart(spark):
    gnu = "This work is licensed under the GNU {}General Public License, version {}."
    cc = "This work is licensed under a Creative Commons Attribution{} 4.0 International License."
    whole = licenses.all_templates()
    texts = {gnu.format("", 2): ["GPL-2.0"], gnu.format("", 3): ["GPL-3.0"], gnu.format("Lesser ", 3): ["LGPL-3.0"], gnu.format("Affero ", 3): ["AGPL-3.0"], gnu.format("", 4): [],
             cc.format(""): ["CC-BY-4.0"], cc.format("-NonCommercial"): ["CC-BY-NC-4.0-long"], cc.format("-ShareAlike"): ["CC-BY-SA-4.0-long"], cc.format("-NoDerivatives"): []}
    for name in ("GPL-2.0-full", "GPL-3.0-full", "LGPL-2.1-full", "Apache-2.0-full", "MIT-full", "BSD-2-Clause-full", "BSD-3-Clause-full", "ISC-full", "MPL-2.0-full"):
        texts[f"First words. {whole[name]}"] = [name]
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate(texts)], DOCS)
    got = defaultdict(list)
    for r in licenses.license_scan(docs).collect():
        got[r["doc_id"]].append((r["license"], r["coverage"]))
    for i, (text, names) in enumerate(texts.items()):
        assert [x[0] for x in got[i]] == names, text[:90]
        assert all(x[1] == 1 for x in got[i])


def test_reach_bounds_the_alignment():
    rng = np.random.default_rng(4)
    for _ in range(200):
        doc, template = rng.integers(0, 6, int(rng.integers(1, 40))).astype(np.uint64), rng.integers(0, 6, int(rng.integers(1, 25))).astype(np.uint64)
        d = int(rng.integers(-20, 40))
        assert licenses.align(doc, template, d)[0] <= licenses.reach(doc, template, d)


def test_banded_alignment_finds_planted_stretches():
    import numpy as np

    rng = np.random.default_rng(2)
    for _ in range(50):
        template = rng.permutation(1000)[:20].astype(np.uint64)
        at = int(rng.integers(0, 30))
        doc = np.concatenate((np.arange(2000, 2000 + at), template, np.arange(3000, 3010))).astype(np.uint64)
        assert licenses.align(doc, template, at) == (20, at, at + 19)
        gone = np.delete(doc, at + 7)
        assert licenses.align(gone, template, at) == (19, at, at + 18)


@pytest.mark.parametrize(("k", "percent"), [(4, 85), (5, 80), (2, 60)])
def test_jaccard_classes_are_those_of_all_pairs(spark, docs, rows, k, percent, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK", 5)
    monkeypatch.setattr(jaccard_join, "ASKING", 4)
    monkeypatch.setattr(jaccard_join, "RANGE_BYTES", 1 << 14)
    monkeypatch.setattr(jaccard_join, "CHUNK", 1 << 10)
    want = brute.classes({r[0]: r[1] for r in rows}, k, percent)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.jaccard_classes(docs, k, percent).collect()}
    assert got == want


def test_jaccard_of_repeated_rows_and_nulls(spark, empty):
    text = " ".join(f"w{i}" for i in range(80))
    docs = spark.createDataFrame([(7, text, None, None, None)] * 2 + [(3, text + " tail", None, None, None), (None, text, None, None, None), (9, "other words stand in this one", None, None, None)], DOCS)
    got = sorted(map(str, (tuple(r) for r in jaccard_join.jaccard_classes(docs).collect())))
    assert got == sorted(map(str, [(7, 76, 3)] * 2 + [(3, 77, 3), (None, 76, None), (9, 2, 9)]))
    assert jaccard_join.jaccard_classes(empty).count() == 0


def test_long_copies_in_separate_partitions_meet(spark):
    words = [f"w{i}" for i in range(250_000)]
    texts = {4: " ".join(words), 2: " ".join(words), 9: " ".join([*words[:100_000], "other", *words[100_001:]]), 7: "none of these words"}
    docs = spark.createDataFrame([(d, t, None, None, None) for d, t in texts.items()], DOCS).repartitionByRange(4, "doc_id")
    assert docs.rdd.glom().map(len).collect() == [1, 1, 1, 1]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.jaccard_classes(docs).collect()}
    assert got == brute.classes(texts, 5, 80)


def test_packed_counts_of_any_size_come_back():
    for counts in ([], [0, 1, 70_000, (1 << 32) - 1], [3, 1 << 32, (1 << 40) + 5]):
        assert counting.unpack(counting.pack(np.array(counts, np.int64))).tolist() == counts


def test_components_of_chains(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 200), (200, 150), (300, 300)]
    got = {r["id"]: r["root"] for r in jaccard_join.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 150: 100, 200: 100}


def test_lm_base_scores_are_exact_and_the_model_beats_them(spark, docs, rows, empty, monkeypatch):
    monkeypatch.setattr(lm_score, "CHUNK_BYTES", 1 << 14)
    want = brute.lm_base([(r[0], r[1]) for r in rows])
    got = {r["doc_id"]: r for r in lm_score.lm_score(docs, chunk_bytes=1 << 14).collect()}
    for i, x in want.items():
        assert (got[i]["n_tokens"], got[i]["n_known"], got[i]["train_tokens"]) == x[:3]
        assert got[i]["base_score"] == pytest.approx(x[3], rel=1e-9)
        assert got[i]["score"] <= 0
    assert lm_score.lm_score(empty).count() == 0


def test_lm_chunks_split_rows_of_one_or_no_id_and_copies_of_one_text(spark):
    rows = [(d, f"some words {i % 200} of many") for i, d in enumerate([None] * 200 + [7] * 200)] + [(1000 + i, "one and the same text") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    dealt = docs.groupBy(counting.chunk_of(("doc_id", "text"), 16).alias("chunk")).count().collect()
    assert len(dealt) == 16 and max(r["count"] for r in dealt) < 100
    got = lm_score.lm_score(docs).collect()
    want = brute.lm_base([(d, t) for d, t in rows if d is not None])
    assert len(got) == len(rows) and {r["train_tokens"] for r in got} == {want[7][2]}
    assert {round(r["base_score"], 9) for r in got if r["doc_id"] == 1000} == {round(want[1000][3], 9)}


def test_lm_held_out_documents_score_above_the_base(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    sums = lm_score.lm_score(docs).join(docs.select("doc_id", (F.crc32(F.col("doc_id").cast("string")) % 5 == 1).alias("held")), "doc_id").where("held").agg(F.sum("score"), F.sum("base_score"), F.sum("n_tokens")).first()
    assert sums[0] > sums[1] and 0 < -sums[0] / sums[2] < 5


def test_lm_probabilities_sum_to_one():
    """For any context, over the known words and one unknown word."""
    import numpy as np

    weights = lm_score.learn_weights(np.array([[3, -20, -8], [0, -12, lm_score.ZERO], [3, lm_score.ZERO, lm_score.ZERO]]), np.array([10, 4, 2]), 50)
    assert np.allclose(weights.sum(1), 1) and weights[0, 2] < 1e-6 and (weights >= 0).all()


def discovered(texts, accept, rounds=3, prior=3.0, least=5):
    """Places (text number, kind, start, end) that bootstrapping adds, each with all places of its value, in plain Python."""
    import math
    import re
    import string

    base = {i: brute.pii(t) for i, t in enumerate(texts)}
    norm = lambda kind, v: re.sub("[^0-9]", "", v) if kind in ("card", "phone") else v.lower()
    spots = []
    for i, t in enumerate(texts):
        found = [(kind, a, b, True) for kind, a, b in base[i]]
        for m in re.finditer(r"\S+", t):
            if re.search("[0-9@]", m[0]):
                head = re.sub("^[^A-Za-z0-9(]+", "", m[0])
                core = re.sub("[^A-Za-z0-9]+$", "", head)
                kind = next((k for k in pii.KINDS if re.search(pii.SHAPES[k], core)), None)
                a = m.end() - len(head)
                if kind and not any(x < a + len(core) and a < y for _, x, y in base[i]):
                    spots.append((i, kind, a, a + len(core), False, (m.start(), m.end())))
        spots += [(i, kind, a, b, True, (a, b)) for kind, a, b, _ in found]
    gap = r"[\s%s]" % re.escape(string.punctuation)
    word = r"[^\s%s]+" % re.escape(string.punctuation)
    sides = {}
    for i, kind, a, b, is_base, (x, y) in spots:
        same = sorted(s[5] for s in spots if s[0] == i and (s[4] and s[1] == kind if is_base else not s[4])) if is_base else [m.span() for m in re.finditer(r"\S*[0-9@]\S*", texts[i])]
        left, right = texts[i][max([q for _, q in same if q <= x], default=0) : x], texts[i][y : min([p for p, _ in same if p >= y], default=len(texts[i]))]
        l, r = re.search(f"({word}){gap}*$", left), re.search(f"^{gap}*({word})", right)
        sides[i, kind, a, b] = ([f"<{l[1].lower()}"] if l else []) + ([f">{r[1].lower()}"] if r else [])
    value = {s[:4]: (s[1], norm(s[1], texts[s[0]][s[2] : s[3]])) for s in spots}
    seeds = {value[s[:4]] for s in spots if s[4]}
    edges = {(value[s[:4]], p) for s in spots for p in sides[s[:4]]}
    while True:
        at = defaultdict(set)
        for v, p in edges:
            at[v[0], p].add(v)
        good = {k: (len(vs & seeds), len(vs - seeds)) for k, vs in at.items()}
        good = {k: x for k, x in good.items() if x[0] >= least and x[1]}
        graph = [(v, (v[0], p)) for v, p in edges if v not in seeds and (v[0], p) in good]
        confidence = defaultdict(float)
        for _ in range(rounds):
            mass = defaultdict(float)
            for v, k in graph:
                mass[k] += confidence[v]
            doubt = defaultdict(float)
            for v, k in graph:
                doubt[v] += math.log1p(-min((good[k][0] + mass[k]) / (sum(good[k]) + prior), 0.999))
            confidence = defaultdict(float, {v: 1 - math.exp(d) for v, d in doubt.items()})
        new = {v for v, c in confidence.items() if c >= accept}
        if not new:
            return {s[:4] for s in spots if not s[4] and value[s[:4]] in seeds}
        seeds = seeds | new


def test_pii_discovery_is_that_of_plain_python(spark):
    rng = random.Random(8)
    contexts = ["call", "ring", "sold", "mail", "visit", "box", "card", "pay"]
    number = {"phone": lambda i: f"+1 555 {i:07d}", "open": lambda i: f"555-{i % 1000:03d}-{i:04d}", "email": lambda i: f"user{i}@mail{i % 3}.org", "half": lambda i: f"user{i}@é{'y' * 130}.z", "ip": lambda i: f"10.0.{i % 256}.7", "dash": lambda i: f"10-0-{i % 99}-7", "plain": lambda i: str(i)}
    texts = []
    for i in range(260):
        parts = []
        for _ in range(rng.randint(1, 3)):
            kind = rng.choice(list(number))
            usual = {"phone": "call", "open": "call", "email": "mail", "half": "mail", "ip": "visit", "dash": "visit", "plain": "sold"}[kind]
            parts += [rng.choice([usual, usual, usual, *contexts]), number[kind](rng.randrange(40)), rng.choice(["today", "now", "Boxes", usual])]
        texts.append(" ".join(parts))
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate(texts)], DOCS)
    got = {r["doc_id"]: r for r in pii.pii(docs, accept=0.6, everywhere=True).collect()}
    want = discovered(texts, 0.6)
    assert len(want) > 20 and any(b - a > 100 for _, _, a, b in want)
    for i, t in enumerate(texts):
        spans = {f"{k}:{a}:{b}" for k, a, b in brute.pii(t)} | {f"{k}:{a}:{b}" for j, k, a, b in want if j == i}
        assert set(got[i]["spans"].split(",")) - {""} == spans, t


def test_pii_values_vouch_for_all_their_places(spark, empty):
    seeds = [f"please call +1 555 010 {i:04d} today" for i in range(40)]
    texts = [*seeds, "please call 555-010-4477 today", "sold 555-010-4477 boxes", "sold 555-010-9999 boxes"]
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate(texts)] + [(None, texts[41], None, None, None)] * 2, DOCS)
    got = [(r["doc_id"], r["spans"]) for r in pii.pii(docs, accept=0.8, everywhere=True).collect()]
    assert [s for d, s in got if d is None] == ["phone:5:17"] * 2 and dict(got)[41] == "phone:5:17" and dict(got)[42] == ""
    assert pii.pii(empty).count() == 0


def plain_ftrl(examples, targets, order, alpha, l1, l2, beta=1.0):
    """FTRL-proximal with dictionaries: {feature: [weight of each class]} after the examples in order."""
    import math

    k = len(targets[0])
    z, n = defaultdict(lambda: [0.0] * k), defaultdict(lambda: [0.0] * k)

    def weight(f):
        return [0.0 if abs(a) <= l1 else (math.copysign(l1, a) - a) / ((beta + math.sqrt(b)) / alpha + l2) for a, b in zip(z[f], n[f], strict=True)]

    for i in order:
        w = {f: weight(f) for f in examples[i]}
        raw = [sum(v * w[f][c] for f, v in examples[i].items()) for c in range(k)]
        if k == 1:
            p = [1 / (1 + math.exp(-raw[0]))]
        else:
            e = [math.exp(x - max(raw)) for x in raw]
            p = [x / sum(e) for x in e]
        for f, v in examples[i].items():
            for c in range(k):
                g = v * (p[c] - targets[i][c])
                z[f][c] += g - (math.sqrt(n[f][c] + g * g) - math.sqrt(n[f][c])) / alpha * w[f][c]
                n[f][c] += g * g
    return {f: weight(f) for f in list(z)}


def test_toxicity_is_that_of_a_plain_learner(spark):
    import math
    import re

    rng = random.Random(6)
    vocabulary = [a + b for a in ("bad", "nice", "gut", "so") for b in ("a", "bc", "def")]
    texts = [" ".join(rng.choice(vocabulary[: rng.choice((4, 12))]) for _ in range(rng.randint(1, 12))) for _ in range(300)]
    labels = [int("bad" in t) if rng.random() < 0.95 else rng.randint(0, 1) for t in texts]

    def features(text):
        w = re.findall("[a-z0-9]+", text.lower())
        return {("word", x) for x in w} | {("stem", x[:4]) for x in w} | set(zip(w, w[1:])) | {("skip", *x) for x in zip(w, w[2:])} | {"always"}  # noqa: B905

    teach = [i for i in range(300) if brute.fold(i) != 0]
    sets = [features(texts[i]) for i in teach]
    examples = [{f: 1.0 for f in s if sum(f in x for x in sets) >= 3} for s in sets]
    fitted = [i for i in range(len(teach)) if i % 10 != 9]
    order = np.random.default_rng(11)
    w = plain_ftrl(examples, [[labels[i]] for i in teach], [i for _ in range(3) for i in order.permutation(fitted)], 0.5, 5.0, 0.1)
    raw = lambda s: sum(w[f][0] for f in s if f in w)
    a, b = 1.0, 0.0
    held = [(raw(examples[i]), labels[teach[i]]) for i in range(len(teach)) if i % 10 == 9]
    slope, shift = toxicity.platt(np.array([x for x, _ in held]), np.array([float(y) for _, y in held]))
    loss = lambda a, b: sum(math.log1p(math.exp(-(2 * y - 1) * (a * x + b))) for x, y in held) + 5e-4 * (a - 1) ** 2
    assert all(loss(slope, shift) <= loss(slope + da, shift + db) + 1e-9 for da in (-0.05, 0, 0.05) for db in (-0.05, 0, 0.05))
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate(texts)], DOCS)
    got = toxicity.toxicity(docs, spark.createDataFrame(list(enumerate(labels)), "doc_id long, toxic int")).collect()
    assert len({round(r["score"], 6) for r in got}) > 20
    for r in got:
        a = slope * raw(features(texts[r["doc_id"]])) + shift
        assert r["score"] == pytest.approx(1 / (1 + math.exp(-a)), abs=1e-9) and r["held_out"] == (brute.fold(r["doc_id"]) == 0)


def test_language_is_that_of_a_plain_learner(spark):
    import math
    import re
    from collections import Counter

    rng = random.Random(9)
    texts = [("" if i % 9 else "12 ") + " ".join("".join(rng.choice("abcd" if i % 3 else "cdef") for _ in range(rng.randint(1, 5))) for _ in range(rng.randint(1, 8))).title() + "!" for i in range(240)]
    langs = ["xx" if i % 3 else "yy" for i in range(240)]

    def counted(text):
        s = re.sub("[^a-z]+", " ", text.lower()).lstrip()
        return Counter(s[i : i + n] for n in (1, 2, 3) for i in range(len(s) - n + 1))

    teach = [i for i in range(240) if brute.fold(i) != 0]
    grams = [counted(texts[i]) for i in teach]
    often = Counter(g for c in grams for g in c)
    idf = {g: (math.log((1 + len(teach)) / (1 + n)) + 1) * 40 for g, n in often.items() if n >= 2}
    value = lambda c: {g: np.float32(n / sum(c.values())) * idf[g] for g, n in c.items() if g in idf}
    examples = [value(c) for c in grams]
    fitted = np.array([i for i in range(len(teach)) if i % 10 != 9])
    order = np.random.default_rng(5)
    target = [[float(langs[i] == x) for x in ("xx", "yy")] for i in teach]
    w = plain_ftrl(examples, target, [i for _ in range(3) for i in order.permutation(fitted)], 0.3, 0.3, 0.3)
    raw = lambda c: [sum(v * w[g][k] for g, v in value(c).items() if g in w) for k in (0, 1)]
    held = [i for i in range(len(teach)) if i % 10 == 9]
    t = language.temperature(np.array([raw(grams[i]) for i in held]), np.array([target[i] for i in held]))
    docs = spark.createDataFrame([(i, x, lang, None, None) for i, (x, lang) in enumerate(zip(texts, langs, strict=True))], DOCS)
    for r in language.language_id(docs).collect():
        x, y = (v / t for v in raw(counted(texts[r["doc_id"]])))
        p = 1 / (1 + math.exp(min(y - x, 700)))
        assert r["score"] == pytest.approx(max(p, 1 - p), abs=1e-3) and r["lang_pred"] == ("xx" if p >= 0.5 else "yy")


def test_language_quotas_take_rare_languages_whole(spark):
    assert [language.quota(*x) for x in (([5, 5], 20), ([3000, 6], 100), ([10, 20, 30], 36), ([], 5))] == [5, 94, 13, 0]
    rng = random.Random(2)
    make = lambda letters: " ".join("".join(rng.choice(letters) for _ in range(5)) for _ in range(12))
    rows = [(i, make("abcdefg"), "en", None, None) for i in range(3000)] + [(5000 + i, make("mnopqrs"), "zz", None, None) for i in range(20)]
    got = language.language_id(spark.createDataFrame(rows, DOCS), max_rows=100).collect()
    assert {r["lang_pred"] for r in got if r["doc_id"] >= 5000} == {"zz"} and {r["lang_pred"] for r in got if r["doc_id"] < 3000} == {"en"}


def test_samples_are_bounded_in_rows_and_bytes(spark):
    from catalith.llm.common import bounded

    rows = spark.createDataFrame([(7, "x" * n) for n in range(1, 200)] + [(7, "x")] * 500, "doc_id long, text string")
    assert bounded(rows, 50, 1 << 30).count() == 50
    got = [len(r["text"]) for r in bounded(rows, 1000, 900).collect()]
    assert got and sum(got) <= 900 and bounded(rows, 1000, 900).count() == len(got) and bounded(rows.where("length(text) = 150"), 9, 10).count() == 1


def test_keep_first_takes_any_column_names(spark):
    rows = [(1, "a b", 10, True, "k", "s"), (2, "a  b", 11, True, "k", "s"), (None, "a b", 12, False, "k", "s"), (None, None, 13, True, None, None), (None, "", 14, True, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _id long, none boolean, key string, sha string")
    got = exact_dedup.keep_first(docs)
    assert got.columns == docs.columns and sorted(r["_id"] for r in got.collect())[0] == 10 and got.count() == 2


def test_url_suffix_statistics_leave_the_own_fold_out(spark):
    rows = [("com", 0, 1.0), ("com", 0, 0.0), ("com", 1, 1.0), ("com", 2, None), ("net", 3, None)]
    got = {(r["suffix"], r["fold"]): (round(np.expm1(r["f_suffix_count"])), r["f_suffix_block"]) for r in url_filter.suffix_statistics(spark.createDataFrame(rows, "suffix string, fold int, label double"), prior=2.0).collect()}
    assert got == {("com", 0): (4, 2 / 3), ("com", 1): (4, 2 / 4), ("com", 2): (4, 3 / 5), ("com", 5): (4, 3 / 5), ("net", 3): (1, 0.5), ("net", 5): (1, 0.5)}


def test_url_features_and_rules_are_those_of_plain_python(spark):
    import math

    rng = random.Random(3)
    hosts = ["com", "a.com", "example.com", "x.example.com", "example.net", "net", "b.NET", "org", "c-d.org", "io", ""]
    urls = [f"{rng.choice(('http', 'ftp'))}://{rng.choice(hosts)}{rng.choice(('', '/', '/en/', '/en/7', '/de/8x', '/es/1-2', '/%C3'))}{rng.choice(('', '?a=1&b', '?', '#f', '?q#z'))}" for _ in range(300)] + [None, "", "none"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    parts = pages.withColumns({"host": url_filter.host_of("url"), "path": url_filter.path_of("url")})
    rows = {r["page_id"]: r for r in url_filter.lexical(url_filter.apply_rules(parts), "url").collect()}
    for i, u in enumerate(urls):
        host, path, u = "", "", u or ""
        if "://" in u:
            rest = u.split("://", 1)[1]
            cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
            host, rest = rest[:cut].lower(), rest[cut:]
            path = rest[: min([rest.find(c) for c in "?#" if c in rest], default=len(rest))]
        fits = [(r, v) for r, v in url_filter.RULES if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith("/" + r.split("/", 1)[1])]
        best = max(fits, key=lambda x: len(x[0]), default=(None, None))
        r = rows[i]
        assert (r["host"], r["path"], r["rule"], r["rule_verdict"]) == (host, path, *best), u
        query = u.split("?", 1)[1].split("#")[0] if "?" in u and ("#" not in u or u.find("?") < u.find("#")) else ""
        entropy = -sum(u.count(c) / len(u) * math.log2(u.count(c) / len(u)) for c in set(u))
        assert (r["f_length"], r["f_depth"], r["f_query"], r["f_parameters"]) == (len(u), u.count("/"), len(query), query.count("&") + 1 if query else 0)
        assert r["f_entropy"] == pytest.approx(entropy, abs=1e-9) and r["f_digits"] == pytest.approx(sum(c in "0123456789" for c in u) / max(1, len(u)))


def test_a_group_of_near_copies_takes_work_in_proportion(spark, monkeypatch):
    """One hot group over many blocks, with a few outliers and a bridge: leaders merge its blocks, few sets are asked about."""
    monkeypatch.setattr(jaccard_join, "BLOCK", 8)
    rng = random.Random(12)
    base = [f"w{i}" for i in range(60)]
    texts = {}
    for i in range(300):
        words = list(base)
        for _ in range(1 if i % 40 else 4):
            words[rng.randrange(60)] = f"x{rng.randrange(9)}"
        texts[i] = " ".join(words)
    asked = []
    real = jaccard_join.cut
    monkeypatch.setattr(jaccard_join, "cut", lambda df: (out := real(df), asked.append(out.count()) if "asks" in df.columns else None)[0])
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in texts.items()] + [(5, texts[5], None, None, None)] * 20, DOCS)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.jaccard_classes(docs, 4, 70).collect()}
    assert got == brute.classes(texts, 4, 70) and len({c for _, c in got.values()}) > 1
    assert sum(asked) < 6 * 300  # each set in each of 38 blocks would make over 10,000
