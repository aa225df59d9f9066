"""The SQL of op7 states the query's rule, on values that tell its parts apart."""

import duckdb

from roadcast.llm import secret_scan
from roadcast.llm.oracles import ORACLES

LIVE, MANY_REPOSITORIES, MANY_OWNERS = (f"{c}Ab3" * 8 for c in "xyz")


def test_values_of_few_and_many_repositories(spark):
    rows = []
    for k in range(6):
        rows.append((k, f"key {MANY_REPOSITORIES} here", f"l{k}", "s0"))  # one owner, six repositories
        rows.append((10 + k, f"key {LIVE} here", f"l{k % 2}", "s0"))  # one owner, two repositories
        rows.append((20 + k, f"key {MANY_OWNERS} here", "en", f"s{k}"))
    rows += [(30, None, "en", "s0"), (31, "", None, None), (32, "password = abcdefgh12", None, "s1")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    found = secret_scan.scan(docs)
    got = sorted(tuple(r) for r in found.collect())
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar, lang varchar, source varchar)")
    con.executemany("insert into documents values (?, ?, ?, ?)", rows)
    result = con.execute(f"select {', '.join(found.columns)} from ({ORACLES['op7_secret_owners']})").fetchall()
    assert got == sorted(map(tuple, result))
    spans = {r["doc_id"]: r["spans"] for r in found.collect()}
    assert spans[0] == "" and spans[20] == "" and spans[10].startswith("opaque:4:")
