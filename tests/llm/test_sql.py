"""Queries against their SQL in DuckDB."""

import duckdb
import pytest

from trailforge.llm import quality
from trailforge.llm.registry import ORACLES, QUERIES

SMALL = "/root/testdata/sf0.001"


def rows(found, columns):
    return sorted((tuple(r[c] for c in columns) for r in found), key=repr)


def asked(path, sql):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{path}')")
    return con.execute(sql).df().astype(object).where(lambda x: x.notna(), None).to_dict("records")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, name):
    got = QUERIES[name](spark, SMALL)
    assert rows(got.collect(), got.columns) == rows(asked(f"{SMALL}/documents.parquet", ORACLES[name]), got.columns)


def test_quality_rules_equal_their_sql_on_odd_rows(spark, frame, odd, tmp_path):
    lines = ["Home | News | Mail", "Read more", "ALL CAPITALS AND NOT A SINGLE SMALL LETTER IN THE WHOLE OF THIS LINE.", "!!! Now!", "### $$$", "no stop in these nine words of one line", "Über ÄÖÜ, 漢字。", "\x0b\t", "All rights reserved."]
    texts = ["\n".join(lines[k:] + lines[:k] * (k % 3)) for k in range(len(lines))] + ["a b c d e " * 3, "a b c d a b c d a", "\n\n", "x\r\ny"]
    docs = odd.unionByName(frame([(100 + i, t) for i, t in enumerate(texts)]))
    docs.write.parquet(f"{tmp_path}/documents")
    got = quality.measure(spark.read.parquet(f"{tmp_path}/documents"))
    assert rows(got.collect(), got.columns) == rows(asked(f"{tmp_path}/documents/*.parquet", quality.ORACLE), got.columns)
