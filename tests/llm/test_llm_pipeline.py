import subprocess
import sys

import corpus_pipeline as pipeline
import pandas as pd
import pytest
from llm_cases import doc_frame, edge_texts, sentence
from test_llm_jaccard import brute as jaccard_brute
from test_llm_suffix import brute as suffix_brute

from fairlease.llm import queries
from fairlease.llm.shared import table

SF = "/root/testdata/sf0.001"


def test_order_and_registration():
    assert [n for n, _ in pipeline.STAGES] == ["language", "toxicity", "near copies", "repeated passages", "packing"]
    assert sorted(queries.QUERIES, key=lambda q: int(q[2:].split("_")[0])) == [
        "op1_toxicity", "op2_language_id", "op3_url_filters", "op4_packing", "op5_jaccard_join", "op6_suffix_dedup", "op7_sharding", "op8_nearest", "op9_fingerprints", "op10_sentencepiece",
        "op11_spelling", "op12_periodic_runs", "op13_secrets",
    ]
    import __spark_entry__ as entry

    assert set(queries.QUERIES) | {"pipeline"} <= set(entry.queries()) and set(queries.ORACLE_SQL) <= set(entry.oracle_sql())


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    out = tmp_path_factory.mktemp("stages")
    docs = table(spark, SF, "documents")
    frames = [docs.toPandas()]
    for k, (_, stage) in enumerate(pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(str(out / str(k)))
        docs = spark.read.parquet(str(out / str(k)))
        frames.append(docs.toPandas())
    return frames


def test_each_stage_works_on_what_came(stages):
    docs, known, clean, single, cut, packed = stages
    for f in (known, clean, single, cut):
        assert list(f.columns) == list(docs.columns)
    assert len(docs) >= len(known) >= len(clean) > len(single) == len(cut)
    # near copies: one document, the smallest id, of each group
    want = {i for i, _, c in jaccard_brute(list(zip(clean.doc_id, clean.text, strict=True))) if i == c}
    assert set(single.doc_id) == want and len(single) == len(want)
    # repeats: the bytes that the brute force keeps
    left = suffix_brute(list(zip(single.doc_id, single.text, strict=True)), 100)
    cut = cut.set_index("doc_id")
    for i, (n, removed, _, _) in left.items():
        text = cut.text[i]
        assert n - removed - 3 <= len(text.encode()) <= n - removed
        assert cut.n_chars[i] == len(text)
    assert set(packed.doc_id) == set(cut.index)


def test_run_equals_the_stages(spark, stages):
    out = pipeline.run(spark, SF).toPandas()
    key = ["doc_id", "piece", "start", "length", "ids_crc32"]
    pd.testing.assert_frame_equal(out[key].sort_values(key).reset_index(drop=True), stages[-1][key].sort_values(key).reset_index(drop=True))


def test_stages_with_hostile_rows(spark):
    docs = doc_frame(spark, edge_texts(), langs=("en", "en", None))
    for _, stage in pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
    kept = pipeline.keep_known_languages(spark, docs, SF).toPandas()
    assert kept.text.notna().all() and not kept.text.str.fullmatch(r"[^\w]*|[\d\s!]*").any()
    empty = docs.limit(0)
    for _, stage in pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0


def test_language_stage_drops_other_scripts(spark):
    import random

    rng = random.Random(1)
    rows = [(i, sentence(rng, 50)) for i in range(60)] + [(100, "привет мир это другой текст"), (101, "123 456"), (102, None)]
    out = pipeline.keep_known_languages(spark, doc_frame(spark, rows, langs=("en",)).withColumn("lang", __import__("pyspark").sql.functions.expr("case when doc_id < 60 then 'en' end")), SF)
    assert {r["doc_id"] for r in out.select("doc_id").collect()} == set(range(60))


def test_entry_without_the_subpackage(tmp_path):
    """The rest imports and lists its queries when the driver has taken the folders out."""
    code = (
        "import sys, importlib.abc\n"
        "class Gone(importlib.abc.MetaPathFinder):\n"
        "    def find_spec(self, name, path, target=None):\n"
        "        if name in ('corpus_pipeline', 'fairlease.llm') or name.startswith('fairlease.llm.'):\n"
        "            raise ModuleNotFoundError(name, name=name)\n"
        "sys.meta_path.insert(0, Gone())\n"
        "import __spark_entry__ as e\n"
        "print(len(e.queries()), any(q.startswith('op1') for q in e.queries()))\n"
    )
    import os

    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    said = subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True, timeout=120)
    n, there = said.stdout.split()
    assert int(n) > 50 and there == "False"


def test_one_row_of_each_component_whatever_the_ids(spark):
    x, y, z = (" ".join(f"{c}{i}" for i in range(40)) for c in "xyz")
    rows = [(3, x), (5, x), (5, y), (None, z), (None, z + " end"), (None, "one two three"), (7, ""), (7, "")]
    out = pipeline.keep_one_of_near_copies(spark, doc_frame(spark, rows), SF)
    got = [(r["doc_id"], r["text"]) for r in out.collect()]
    assert sorted(t for i, t in got if i is None) in (sorted([z, "one two three"]), sorted([z + " end", "one two three"]))
    assert sorted((i, t) for i, t in got if i is not None) == [(3, x), (5, y), (7, ""), (7, "")]
