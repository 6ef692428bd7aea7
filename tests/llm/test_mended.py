"""Licences side by side, long texts of matches, ties between rows, bounded samples."""

import random
import time
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from catalith.llm import exact_dedup, licenses, pii, text as T, url_filter
from tests.llm import brute

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def index():
    return licenses._index(licenses.all_templates())


def scan(index, text, threshold=0.8):
    return list(licenses.matches(index, threshold, *T.flat(pa.array([text]))))


@pytest.mark.parametrize("gap", [0, 1, 5, 12])
def test_every_copy_of_a_template_is_a_match(index, gap):
    for name, template in licenses.all_templates().items():
        for copies in (1, 3):
            got = scan(index, (template + " " + "w " * gap) * copies)
            assert [index["names"][x[1]] for x in got] == [name] * copies
            assert all(a[4] <= b[3] for a, b in zip(got, got[1:], strict=False))


def test_many_copies_side_by_side_in_time(index):
    began = time.process_time()
    assert len(scan(index, "Released under the MIT License. " * 2000)) == 2000
    assert scan(index, "under the terms of the GNU General Public License " * 4000) == []
    assert time.process_time() - began < 20


def plain_align(doc, template, diagonal, band):
    """Banded local alignment, cell by cell: (value, matched words, first place), best end first."""
    cells, best = {}, (0, 0, -1, -1)
    for i in range(len(template)):
        for p in range(max(0, i + diagonal - band), min(len(doc), i + diagonal + band + 1)):
            v, m, s = cells.get((i - 1, p - 1), (0, 0, -1))
            options = [(0, 0, -1)]
            if doc[p] != licenses.TAKEN:
                if doc[p] == template[i]:
                    options.append((v + 2, m + 1, s if m else p))
                elif v > 1:
                    options.append((v - 1, m, s))
                options += [(x[0] - 1, *x[1:]) for x in (cells.get((i - 1, p), (0,)), cells.get((i, p - 1), (0,))) if x[0] > 1]
            cells[i, p] = max(options)
            if cells[i, p][0] > best[0]:
                best = (*cells[i, p], p)
    return best[1:]


def test_alignment_is_that_of_a_plain_version():
    rng = np.random.default_rng(7)
    for _ in range(400):
        template = rng.integers(0, int(rng.integers(2, 9)), int(rng.integers(1, 14))).astype(np.uint64)
        doc = np.concatenate((rng.integers(0, 8, int(rng.integers(0, 9))).astype(np.uint64), template[rng.random(len(template)) > 0.2], rng.integers(0, 8, 5).astype(np.uint64)))
        doc[rng.random(len(doc)) < 0.05] = licenses.TAKEN
        d = int(rng.integers(-4, 12))
        if not (0 <= d <= len(doc) - len(template) and (doc[d : d + len(template)] == template).all()):
            got = licenses.align(doc, template, d, 3)
            want = plain_align(doc.tolist(), template.tolist(), d, 3)
            assert got[0] == want[0] and (not got[0] or got == want)
        diagonals = np.arange(-20, 30)
        assert licenses.reaches(doc, template, diagonals, 3).tolist() == [licenses.reach(doc, template, int(x), 3) for x in diagonals]


def test_coarse_windows_lose_no_diagonal():
    rng = np.random.default_rng(9)
    for _ in range(40):
        template = rng.integers(0, 60, 90).astype(np.uint64)
        doc = np.concatenate((rng.integers(0, 80, 50), template[rng.random(90) > 0.1], rng.integers(0, 80, 50))).astype(np.uint64)
        diagonals = np.arange(-20, 100)
        kept = set(licenses.possible(doc, template, diagonals, 60).tolist())
        assert all(int(d) in kept for d in diagonals if licenses.reach(doc, template, int(d)) >= 60)


def test_license_scan_of_awkward_rows(spark):
    mit = "Released under the MIT License."
    rows = [(None, mit), (None, None), (1, ""), (1, mit), (1, mit), (2, "é" * 50_000 + " " + mit), (3, "MIT " * 100_000), (4, f"{mit} {mit.upper()}")]
    docs = spark.createDataFrame([(d, t, None, None, None) for d, t in rows], DOCS).withColumns({"license": F.lit("x"), "start": F.lit(0)})
    got = Counter((r["doc_id"], r["license"], r["start"], r["end"]) for r in licenses.license_scan(docs).collect())
    assert got == {(None, "MIT", 0, 30): 1, (1, "MIT", 0, 30): 2, (2, "MIT", 50_001, 50_031): 1, (4, "MIT", 0, 30): 1, (4, "MIT", 32, 62): 1}
    assert licenses.license_scan(docs.limit(0)).count() == 0


def test_pii_takes_time_with_the_matches_of_a_text(spark):
    texts = ["1." * 30_000 + "1", " ".join(f"10.0.{i % 256}.{i % 200}" for i in range(100_000)), " ".join(f"n{i}@x.org 1{i}-5" for i in range(20_000))]
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate(texts)], DOCS)
    began = time.monotonic()
    got = {r["doc_id"]: r for r in pii.pii(docs, everywhere=True).collect()}
    assert time.monotonic() - began < 90
    for i, t in enumerate(texts):
        spans = brute.pii(t)
        assert got[i]["base_sha256"] == brute.sha(",".join(f"{k}:{a}:{b}" for k, a, b in spans)) and got[i]["n_ip"] == sum(k == "ip" for k, _, _ in spans)


def test_the_row_that_stays_does_not_depend_on_the_order(spark):
    rows = [(1, "a  b", "en", 1), (1, "a b", "de", 2), (1, "a\tb", "fr", 3), (1, "a\tb", "es", 4), (2, "a b", "en", 5), (None, None, "en", 6), (None, "", "de", 7), (None, "", "en", 8)]
    found = set()
    for seed in range(4):
        mixed = random.Random(seed).sample(rows, len(rows))
        docs = spark.createDataFrame(mixed, "doc_id long, text string, lang string, n long").repartition(1 + seed).withColumn("tags", F.create_map(F.lit("a"), "n"))
        found.add(tuple(sorted(r["n"] for r in exact_dedup.keep_first(docs).collect())))
    assert len(found) == 1
    n = found.pop()
    assert len(n) == 2 and n[0] in (1, 2, 3, 4) and n[1] in (6, 7, 8)


def test_the_url_sample_is_bounded(spark):
    urls = ["http://a.com/en/hot"] * 4000 + [f"http://h{i}.org/es/{i}" for i in range(700)] + [f"http://net/de/{i}" for i in range(100)] + [None, "x"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").repartition(3)
    labelled = url_filter.apply_rules(pages.withColumns({"host": url_filter.host_of("url"), "path": url_filter.path_of("url")})).where("rule IS NOT NULL")
    assert url_filter.teaching(labelled, 500).count() == 500 and url_filter.teaching(labelled, 5000).count() == 801
    got = url_filter.url_filter(pages, max_rows=600).collect()
    assert len(got) == len(urls) and {r["verdict"] for r in got} == {"allow", "block"}


def test_url_filter_of_repeated_and_very_long_urls(spark):
    long = "http://x.com/en/" + "a/" * 100_000 + "?" + "k=1&" * 20_000
    pages = spark.createDataFrame([(1, long), (1, long), (2, "http://net/de/1"), (2, "http://net/de/1"), (3, None)], "page_id long, url string").withColumns({"host": F.lit(1), "score": F.lit("s")})
    got = sorted((r["page_id"], r["rule"] or "", len(r["path"])) for r in url_filter.url_filter(pages).collect())
    assert got == [(1, "com/en/", 200_004)] * 2 + [(2, "net/de/", 5)] * 2 + [(3, "", 0)]
