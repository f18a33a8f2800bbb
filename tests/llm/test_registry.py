"""Registered queries against their oracles, on the test tables and on odd ones."""

from __future__ import annotations

import random

import duckdb
import pytest
from oracle import differences, duck

from tidemark.llm import registry


def test_every_operator_is_registered():
    assert sorted(int(n.split("_")[0][2:]) for n in registry.queries()) == list(range(1, 11))
    assert set(registry.oracle_sql()) <= set(registry.queries())


@pytest.fixture(scope="module")
def con(sf):
    return duck(sf)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_oracle(spark, sf, con, name):
    assert differences(spark, sf, registry.queries()[name], registry.oracle_sql()[name], con) == ""


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    """Documents with terms that give an address away, near copies, nulls and repeated rows."""
    rnd = random.Random(8)
    filler = [f"word{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(300)]
    some = lambda n: " ".join(rnd.choice(filler) for _ in range(n))
    texts = [f"{some(9)} Zyx {some(2)} mail jane@corp.example now {some(8)}" for _ in range(6)]
    texts += [f"{some(9)} Qrstuv wrote, {some(1)} jane@corp.example {some(8)} +1 (234) 555-1234" for _ in range(6)]
    texts += [f"{some(20)} QRSTUV {some(5)}", None, "", "a b", "a b"]
    texts += [f"{some(6)} 10.0.0.{i} other{i}@corp.example token = \"{'ab' * 9}{i}\"" for i in range(20)]
    texts += [some(30) for _ in range(200)]
    texts += [t + " and more of it" for t in texts[-20:] if t]
    path = str(tmp_path_factory.mktemp("odd"))
    spark.createDataFrame([(i * 3, t, "en", "x", 1) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, texts[40 + i]) for i in range(3)] + [(7, "wordaa"), (8, None), (10, texts[60])], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame([(1, None, None), (2, "http://a.b/c", "x"), (3, "", None)], "page_id long, url string, html string").write.parquet(f"{path}/pages.parquet")
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}/{t}.parquet/*.parquet')")
    return path, con


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_oracle_on_odd_rows(spark, odd, name):
    assert differences(spark, odd[0], registry.queries()[name], registry.oracle_sql()[name], odd[1]) == ""
