"""Every registered query outside llm, at the smallest scale, against DuckDB over the same files."""

import hashlib
import os

import duckdb
import pandas as pd
import pytest

from driftwell.plans import all_queries
from driftwell.sources.views import view
from driftwell.streaming.sessions import sessions_of

FOLDER = "/root/testdata/sf0.001"
QUERIES, ORACLES = all_queries()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for name in os.listdir(FOLDER):
        con.sql(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{FOLDER}/{name}'")
    return con


def rows(frame: pd.DataFrame, columns: list[str]) -> list[str]:
    plain = lambda x: None if x is None or x is pd.NA or x is pd.NaT or x != x else round(float(x), 6) if isinstance(x, float) else x
    return sorted(str([plain(x) for x in r]) for r in frame[columns].astype(object).to_numpy().tolist())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_duckdb(spark, duck, name):
    found, wanted = QUERIES[name](spark, FOLDER).toPandas(), duck.sql(ORACLES[name]).df()
    columns = sorted(found.columns)
    assert columns == sorted(wanted.columns)
    assert rows(found, columns) == rows(wanted, columns)


def test_all_others_are_checked_here():
    assert set(QUERIES) - set(ORACLES) == {"src6_disk_inventory", "ag7_content_defined_chunks", "ag7_dedup_report", "ag7_archive_chunks", "ag7_shift_report", "st1_debounce_sessions"}


def test_src6(spark):
    found = QUERIES["src6_disk_inventory"](spark, FOLDER).collect()
    assert [tuple(r) for r in found] == [("documents.parquet", os.path.getsize(f"{FOLDER}/documents.parquet"), "unchanged")]


def test_ag7(spark):
    found = QUERIES["ag7_content_defined_chunks"](spark, FOLDER).toPandas()
    texts = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()}
    for doc_id, chunks in found.sort_values("ord").groupby("doc_id"):
        at = 0
        for size, digest in zip(chunks["size"], chunks["hash"]):
            assert hashlib.sha256(texts[doc_id][at : at + size]).hexdigest() == digest
            at += size
        assert at == len(texts[doc_id]) and (chunks["size"].iloc[:-1] >= 128).all() and (chunks["size"] <= 2048).all()
    assert set(found["doc_id"]) == {d for d, t in texts.items() if t}
    report = QUERIES["ag7_dedup_report"](spark, FOLDER).first()
    kinds = found.drop_duplicates("hash")
    assert tuple(report) == (len(found), len(kinds), found["size"].sum(), kinds["size"].sum())


def test_ag7_archives(spark):
    found = QUERIES["ag7_archive_chunks"](spark, FOLDER).toPandas()
    files = {}
    for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("source", "doc_id", "text").orderBy("doc_id").collect():
        files[r.source or ""] = files.get(r.source or "", b"") + (r.text or "").encode()
    for file, chunks in found.sort_values("ord").groupby("file"):
        at = 0
        for start, size, digest in zip(chunks["start"], chunks["size"], chunks["hash"]):
            assert start == at and hashlib.sha256(files[file][at : at + size]).hexdigest() == digest
            at += size
        assert at == len(files[file]) and (chunks["size"].iloc[:-1] >= 2 << 10).all() and (chunks["size"] <= 32 << 10).all()
    assert set(found["file"]) == {f for f, b in files.items() if b}
    report = QUERIES["ag7_shift_report"](spark, FOLDER).toPandas()
    assert (report["bytes_after"] == report["bytes_before"] + 1000).all() and report["bytes_kept"].sum() > 0.5 * report["bytes_before"].sum()


def test_st1(spark):
    events = view(spark, FOLDER, "fx_fs_events").toPandas()
    events["us"] //= 40000
    wanted = pd.concat(sessions_of(rows, 300_000, 2_000_000, 500) for _, rows in events.groupby("group_id"))
    found = QUERIES["st1_debounce_sessions"](spark, FOLDER).toPandas()
    assert rows(found, list(wanted.columns)) == rows(wanted, list(wanted.columns))


def test_collisions_find_the_written_pairs(spark):
    assert QUERIES["jn9_normalization_collisions"](spark, FOLDER).count() >= 1
    assert QUERIES["jn10_case_normalization_collisions"](spark, FOLDER).count() >= 5
