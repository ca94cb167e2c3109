"""The pipeline on planted cases, and the registered queries on the smallest data."""

import os
import random
import zlib

import duckdb
import pytest

import corpus_pipeline
from maskwright.llm import catalog

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def planted(spark, tmp_path_factory):
    rng = random.Random(8)
    pool = [a + b for a in ("lor", "ips", "dol", "sit", "con", "adi") for b in ("um", "or", "et", "am", "is", "ex")]
    rows, labels = {}, []
    for i in range(400):
        words = [rng.choice(pool) + str(rng.randrange(4)) for _ in range(rng.randrange(20, 60))]
        y = int(rng.random() < 0.25)
        if y:
            for _ in range(3):
                words[rng.randrange(len(words))] = "blargface"
        rows[i] = " ".join(words)
        labels.append((i, y))
    clean = [i for i, y in labels if not y]
    item = " ".join(rng.choice(pool) for _ in range(25))
    rows[1000] = rows[clean[0]].replace(" ", "\n ")  # exact copy
    words = rows[clean[1]].split()
    rows[1001] = " ".join([*words, "extra"])  # near copy
    rows[1002] = "some words before " + item.upper() + " and after"
    rows[1003], rows[1004] = None, ""
    folder = str(tmp_path_factory.mktemp("planted"))
    spark.createDataFrame([(i, t, "en", f"src{i % 3}", len(t or "")) for i, t in rows.items()], DOCUMENTS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1, y) for i, y in labels], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, rows, dict(labels), clean


def test_stages_on_planted_cases(spark, planted):
    folder, rows, labels, clean = planted
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.persist(stage(spark, docs, folder), name)
        kept[name] = {r.doc_id for r in docs.select("doc_id").collect()}
        if name != "packing":
            assert docs.columns == columns
    toxic = {i for i, y in labels.items() if y}
    held = {i for i in toxic if zlib.crc32(str(i).encode()) % 4 == 2}
    assert len(kept["toxicity"] & held) <= 0.1 * len(held) + 1
    assert len(set(clean) - kept["toxicity"]) <= 0.02 * len(clean)
    assert kept["toxicity"] - kept["exact_dedup"] == {1000, 1004}
    assert kept["exact_dedup"] - kept["near_dedup"] == {1001}
    assert kept["near_dedup"] - kept["decontamination"] == {1002}
    assert kept["packing"] == kept["decontamination"]


def test_pipeline_of_nothing(spark, planted, tmp_path):
    folder, *_ = planted
    for t in ("labels", "benchmark", "documents"):
        spark.read.parquet(f"{folder}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query_runs_over_its_whole_table(spark, name):
    df = catalog.QUERIES[name](spark, DATA)
    rows = df.collect()
    source = "pages" if name.startswith("op6") else "documents"
    con = duckdb.connect()
    for t in (source, "documents"):
        con.execute(f"CREATE OR REPLACE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    n = con.execute(f"SELECT count(*) FROM {source}").fetchone()[0]
    key = "page_id" if source == "pages" else "doc_id"
    assert len({r[key] for r in rows}) == n
    if name in catalog.ORACLE_SQL:
        want = con.execute(catalog.ORACLE_SQL[name])
        columns = sorted(c[0] for c in want.description)
        at = [[c[0] for c in want.description].index(c) for c in columns]
        assert columns == sorted(df.columns)
        assert sorted(repr(tuple(r[c] for c in columns)) for r in rows) == sorted(repr(tuple(r[i] for i in at)) for r in want.fetchall())
