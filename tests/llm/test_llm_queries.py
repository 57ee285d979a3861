"""The registered queries on the smallest tables, and the pipeline against a plain version."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.test_operators import components_by_force, folded, plain_words
from visitline.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
COLUMNS = {
    "op1": ["page_id", "url", "text", "n_chars"],
    "op2": ["doc_id", "held_out", "score", "predicted"],
    "op3": ["doc_id", "item_id", "similarity"],
    "op4": ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
    "op5": ["doc_id", "held_out", "lang_pred", "score"],
    "op6": ["doc_id", "keep_id", "group_size", "kept", "text_sha256"],
    "op7": ["doc_id", "n_shingles", "component_id"],
    "op8": ["doc_id", "epoch"],
    "op9": ["doc_id", "other_id"],
    "op11": ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"],
    "op12": ["lang", "rank", "phrase", "a", "l", "r", "n", "score"],
    "op13": ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"],
    "op10": ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_returns_its_contract(spark, name):
    got = QUERIES[name](spark, SF)
    wanted = COLUMNS[name.split("_")[0]]
    assert [c for c in got.columns if c in wanted] == wanted
    rows = got.count()
    table = "pages" if name.startswith("op1_") else "documents"
    if not name.startswith(("op3_", "op8_", "op9_", "op12_", "op13_")):
        assert rows == spark.read.parquet(f"{SF}/{table}.parquet").count()


def _stages_by_force(rows, items):
    """Ids left after stages 1 to 4 of ``(doc_id, text)``; texts with a letter count as told apart."""
    left = [(i, t) for i, t in rows if re.search(r"[^\W\d_]", t or "")]
    seen = {}
    for i, t in sorted(left):
        seen.setdefault(folded(t), (i, t))
    left = sorted(seen.values())
    groups = components_by_force(left, 5, 80, 100)
    left = [(i, t) for i, t in left if groups[i][1] == i]
    texts = [" ".join(plain_words(t)) for t in items]
    return {i for i, t in left if not any(f" {x} " in f" {' '.join(plain_words(t))} " for x in texts)}


def test_pipeline_equals_its_stages_by_force(spark, tmp_path):
    rng = random.Random(4)
    kinds = {"aa": "abcde", "bb": "vwxyz"}
    word = lambda lang: "".join(rng.choice(kinds[lang]) for _ in range(rng.randint(3, 7)))
    rows, langs = [], {}
    for i in range(60):
        lang = list(kinds)[i % 2]
        rows.append((i, " ".join(word(lang) for _ in range(80))))
        langs[i] = lang
    items = [" ".join(word("aa") for _ in range(25)) for _ in range(3)]
    extra = [rows[0][1], rows[0][1].replace(" ", " \n", 3), rows[1][1] + " vvv", rows[3][1] + " " + items[0], items[1], None, "", "12 34 !", rows[5][1] + " " + word("bb")]
    for j, text in enumerate(extra):
        rows.append((100 + j, text))
        langs[100 + j] = "aa"
    docs = spark.createDataFrame([(i, t, langs[i], f"src{i % 20}", len(t or ""), "x") for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, extra string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:4]:
        got = stage(spark, got, str(tmp_path))
        assert got.columns == list(corpus_pipeline.COLUMNS)
    assert {r["doc_id"] for r in got.select("doc_id").collect()} == _stages_by_force(rows, items)
    mixed = corpus_pipeline.run(spark, str(tmp_path)).select("doc_id", "epoch").collect()
    assert mixed and {r["doc_id"] for r in mixed} <= _stages_by_force(rows, items)


def test_pipeline_stages_take_empty_tables(spark):
    empty = spark.read.parquet(f"{SF}/documents.parquet").where(F.lit(False))
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0, name


def test_pipeline_judges_rows_that_share_an_id_each_for_itself(spark, tmp_path):
    rng = random.Random(8)
    prose = lambda: " ".join("".join(rng.choice("abcde") for _ in range(5)) for _ in range(60))
    copy, own, near, item = prose(), prose(), prose(), " ".join(prose().split()[:30])
    rows = [(1, copy), (2, copy), (2, own), (3, near), (4, near + " tail"), (4, prose()), (5, prose() + " " + item), (5, prose()), (None, prose()), (None, copy), (6, None), (7, prose()), (7, rows7 := prose()), (7, rows7)]
    docs = spark.createDataFrame([(i, t, "aa", "src1", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[1:4]:
        got = stage(spark, got, str(tmp_path))
    left = sorted(((r["doc_id"], r["text"]) for r in got.collect()), key=repr)
    gone = [(2, copy), (4, near + " tail"), rows[6]]
    wanted = [r for r in rows if r not in gone and (r != (None, copy) or r in left)]
    assert [(i, (t or "")[:30]) for i, t in left] == [(i, (t or "")[:30]) for i, t in sorted(wanted, key=repr)]
    assert all(r not in left for r in gone)
