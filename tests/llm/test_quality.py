import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from opsight.llm.quality import common_words, js_distance, quality_rules
from tests.llm.conftest import words


def repeated(text):
    w = words(text)
    windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    counts = Counter(windows)
    return len({i + k for i, x in enumerate(windows) if counts[x] > 1 for k in range(5)})


def prose(seed, n):
    chance = random.Random(seed)
    common = "the of and to in is was for on that with as it by at from his her an be".split()
    letters = "abcdefghijklmnopqrstuvwxyz"
    out = [chance.choice(common) if chance.random() < 0.5 else "".join(chance.choices(letters, k=6)) for _ in range(n)]
    return " ".join(out).capitalize() + "."


ROWS = [(i, prose(i, 120), "en", "s") for i in range(30)]
ROWS += [
    (100, None, "en", "s"),
    (101, "", None, None),
    (102, "a b c d e a b c d e a b c", "en", "s"),
    (103, "one\ntwo\none\n \none", "en", "s"),
    (104, " ".join(w + "###" for w in words(prose(7, 120))), "en", "s"),
    (105, prose(8, 120).upper().replace(" ", "!! "), "en", "s"),
    (106, "x\ty\x0bz\x0c\r\n w v   u", "en", "s"),
    (107, prose(9, 30_000), "en", "s"),
    (108, prose(3, 120), "xx", "s"),
    (None, prose(4, 60), "en", "s"),
]


def test_base_counts(documents):
    got = {r["doc_id"]: r for r in quality_rules(documents(ROWS)).collect()}
    assert len(got) == len(ROWS)
    for i, text, *_ in ROWS:
        w, r = words(text), got[i]
        lines = [x for x in (text or "").split("\n") if words(x)]
        assert r["n_words"] == len(w)
        assert r["word_chars"] == sum(map(len, w))
        assert r["n_symbols"] == sum(c in "#*$%&|<>" for c in text or "")
        assert r["n_dup_lines"] == len(lines) - len(set(lines))
        assert r["n_repeat_words"] == repeated(text)
        assert r["base_failed"] == (len(w) < 10 or 100 * repeated(text) > 20 * len(w))


def test_verdicts(documents):
    kept = {r["doc_id"] for r in quality_rules(documents(ROWS)).filter("kept").collect()}
    assert set(range(30)) | {107, 108, None} <= kept
    assert not kept & {100, 101, 102, 103, 104, 105}


def test_other_languages_and_texts_without_common_words_go(spark):
    """The given documents, some under another language's name, some without their language's commonest words."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").withColumn("kind", F.lit("own"))
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet").filter("quality = 1").select("doc_id")
    french = docs.filter("lang = 'fr' and doc_id % 5 = 0").withColumns({"lang": F.lit("en"), "kind": F.lit("french")})
    known = common_words(docs, 16, "text", "lang").select(F.expr("substr(_lang, 2)").alias("lang"), "_common")
    rest = F.array_except(F.filter(F.split("text", r"\s+"), lambda w: w != ""), F.col("_common"))
    bare = docs.filter("doc_id % 4 = 0").join(known, "lang").filter(F.size(rest) >= 120)
    bare = bare.withColumns({"text": F.array_join(F.slice(rest, 1, 120), " "), "kind": F.lit("bare")}).select(docs.columns)
    every = docs.unionByName(french).unionByName(bare).withColumn("key", F.struct("kind", "doc_id"))
    got = quality_rules(every, id_col="key").filter("not base_failed").select("key.*", "kept")
    share = {r["kind"]: r["share"] for r in got.groupBy("kind").agg(F.avg(F.col("kept").cast("int")).alias("share")).collect()}
    assert share["french"] < 0.1 and share["bare"] < 0.1
    clean = got.filter("kind = 'own'").join(labels, "doc_id").agg(F.avg(F.col("kept").cast("int"))).first()[0]
    assert clean >= 0.98


def test_distance_of_histograms(spark):
    row = spark.range(1).select(
        js_distance(F.array(F.lit(1), F.lit(0)), F.array(F.lit(0), F.lit(5))).alias("far"),
        js_distance(F.array(F.lit(2), F.lit(6)), F.array(F.lit(1), F.lit(3))).alias("same"),
        js_distance(F.array(F.lit(0), F.lit(0)), F.array(F.lit(1), F.lit(3))).alias("none"),
    )
    far, same, none = row.first()
    assert far == pytest.approx(1.0)
    assert same == pytest.approx(0.0, abs=1e-7)
    assert none is None


def test_empty_table(documents):
    assert quality_rules(documents([])).count() == 0
