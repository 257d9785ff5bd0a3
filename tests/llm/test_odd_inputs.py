"""Every operator and pipeline stage on odd tables: nulls, empty and very long texts, repeated rows, clashing names, no rows."""

import random

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from sigmaframe.llm import bpe, html, minhash, neighbours, packing, quality, secrets, suffixes, toxicity, warc

PATH = public_tokenizers.path("word_bpe_49k.json")
#: Names that operators use inside, or could.
CLASHING = "score predicted _id _text id of y digest number block row spans live n_live ids offsets data rest class class_id kept label node task band in0 in1 start length sequence_id record header payload held_out _gone _twice _n".split()
WORDS = ["alpha", "beta", "gamma", "delta", "epsilon", "zeta", "eta", "theta"]


def long_text(n: int) -> str:
    r = random.Random(4)
    return " ".join(r.choice(WORDS) + str(r.randrange(1000)) for _ in range(n // 9))


LONG = long_text(1_500_000)
TEXTS = [(1, None), (2, ""), (3, " \n\t"), (4, LONG), (5, "password = hunter22 " * 3), (5, "password = hunter22 " * 3), (6, "é" * 500), (None, "a null id"), (None, None), (7, LONG[:600]), (7, "another text with the same id"), (8, "x")]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, None if k % 3 == 0 else "en", None if k % 4 == 0 else "s", len(t or "")) for k, (i, t) in enumerate(TEXTS)]
    plain = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return plain.select("*", *(F.lit(k).alias(c) for k, c in enumerate(CLASHING)))


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(k, 1, int(k % 2)) for k in range(9)] + [(None, None, None)], "doc_id long, quality int, toxic int").withColumn("y", F.lit(1))


STAGES = {
    "toxicity": lambda d, y: toxicity.drop_toxic(d, y),
    "near_duplicates": lambda d, y: minhash.drop_near_duplicates(d),
    "repeated_passages": lambda d, y: suffixes.remove_repeats(d),
    "secret_scan": lambda d, y: secrets.redact(d),
}
#: Least number of rows that a stage keeps: the repeated row goes with the near duplicates.
LEAST = {"near_duplicates": len(TEXTS) - 1}


@pytest.mark.parametrize("name", STAGES)
def test_stages_keep_columns_and_clean_rows(docs, labels, name):
    out = STAGES[name](docs, labels)
    assert out.columns == docs.columns
    rows = out.collect()
    assert len(rows) == LEAST.get(name, len(TEXTS))
    assert all(r["score"] == 0 and r["_n"] == len(CLASHING) - 1 for r in rows)
    assert sum((r["text"] or "") == LONG for r in rows) == 1
    empty = STAGES[name](docs.where("false"), labels)
    assert empty.columns == docs.columns and empty.count() == 0


REPORTS = {
    "suffixes": lambda d, y: suffixes.report(d),
    "bpe": lambda d, y: bpe.round_trip_digests(d, PATH),
    "quality": lambda d, y: quality.filter_quality(d),
    "toxicity": lambda d, y: toxicity.report(d, y),
    "secrets": lambda d, y: secrets.report(d),
    "minhash": lambda d, y: minhash.report(d),
}


@pytest.mark.parametrize("name", REPORTS)
def test_reports_have_a_row_for_every_row(docs, labels, name):
    got = REPORTS[name](docs, labels).collect()
    assert sorted(str(r["doc_id"]) for r in got) == sorted(str(i) for i, _ in TEXTS)
    assert REPORTS[name](docs.where("false"), labels).count() == 0


def test_packing_of_odd_rows(docs):
    got = packing.pieces(docs, PATH, 2).collect()
    library = {len(bpe.encoder(PATH, bpe.odd_characters(PATH)).encode(LONG)) // 4 + 1}
    assert {r.doc_tokens for r in got if r.doc_id == 4} == library and sum(r.length for r in got if r.doc_id == 4) in library
    assert [(r.length, r.doc_tokens) for r in got if r.doc_id == 2] == [(1, 1)]
    assert len({r.sequence_id for r in got}) == len(got)
    assert packing.pieces(docs.where("false"), PATH, 2).count() == 0


def test_pages_of_odd_rows(spark):
    rows = [(1, None, None), (2, "u", ""), (2, "u", ""), (None, "v", "<p>x"), (3, "w", "<p>" + LONG)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").select("*", *(F.lit(k).alias(c) for k, c in enumerate([*CLASHING, "bytes", "sha1", "of_page", "revisit"])))
    assert html.extract(pages).count() == warc.round_trip(pages).count() == len(rows)
    assert html.extract(pages.where("false")).count() == warc.round_trip(pages.where("false")).count() == 0


def test_vectors_of_odd_rows(spark):
    rows = [(1, None), (2, []), (3, [1.0, None]), (4, [0.0, 0.0]), (5, [float("nan"), 1.0]), (6, [1.0, 2.0]), (6, [1.0, 2.0]), (None, [1.0, 2.0]), (7, [2.0, 4.0]), (8, [1.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").select("*", *(F.lit(k).alias(c) for k, c in enumerate([*CLASHING, "unit", "key", "copies", "home", "near"])))
    got = sorted((str(r.vec_id), r.n_links, str(r.component_id)) for r in neighbours.report(table).collect())
    assert got == sorted([("1", 0, "1"), ("2", 0, "2"), ("3", 0, "3"), ("4", 0, "4"), ("5", 0, "5"), ("6", 2, "6"), ("6", 2, "6"), ("None", 0, "None"), ("7", 2, "6"), ("8", 0, "8")])
