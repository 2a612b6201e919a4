"""Values that lie exactly on a limit, and numbers longer than their format."""

import duckdb

from broadsheet.operators import archive
from broadsheet.operators import layout as L
from broadsheet.plans import catalogue
from tests.compare import difference


def test_banner_parts_may_be_shifted_by_exactly_their_limit(spark):
    fields = "page_id long, block_id int, cls string, x1 int, y1 int, x2 int, y2 int"
    rows = []
    for page, height in enumerate(range(20, 481, 20)):
        by = height * 35 // 100  # the limit itself, whole for every such height
        rows += [(2 * page, 1, "title", 0, 100, 200, 100 + height), (2 * page, 2, "title", 210, 100 + by, 400, 100 + by + height)]
        rows += [(2 * page + 1, 1, "title", 0, 100, 200, 100 + height), (2 * page + 1, 2, "title", 210, 101 + by, 400, 101 + by + height)]
    got = {(r.page_id, r.block_id): r.group_id for r in L.banner_groups(spark.createDataFrame(rows, fields)).collect()}
    assert got == {(r[0], r[1]): 1 if r[0] % 2 == 0 else r[1] for r in rows}


def test_an_offset_may_have_exactly_the_least_share(spark):
    votes = range(20, 2001, 20)
    enough = [(n, 1 if k < n * 55 // 100 else 2 + k) for n in votes for k in range(n)]
    short = [(-n, 1 if k < n * 55 // 100 - 1 else 2 + k) for n in votes for k in range(n)]
    df = spark.createDataFrame(enough + short, "key long, offset int")
    got = archive.dominant_offset(df, ["key"], "offset", 3, 0.55).collect()
    assert sorted((r.key, r.offset, r.n, r.votes) for r in got) == [(n, 1, n * 55 // 100, n) for n in votes]


def test_document_numbers_may_have_more_than_six_digits(spark, tmp_path):
    ids = lambda *numbers: spark.createDataFrame([(f"doc_{n:06d}",) for n in numbers], "document_id string")
    for numbers in ((7, 999_998), (5, 999_999), (1_000_000, 999_999), (8_999_999, 90), (2**31 - 1, 2), (2**31, 2), (2**40, 1)):
        assert archive.next_document_id(ids(*numbers)).first()[0] == f"doc_{max(numbers) + 1:06d}"
    name = "s09_next_document_id"
    for most in (41, 999_998, 999_999, 8_999_999):
        spark.createDataFrame([(3,), (most,)], "o_orderkey long").write.parquet(str(tmp_path / str(most) / "orders.parquet"))
        con = duckdb.connect()
        con.execute(f"CREATE VIEW orders AS SELECT * FROM read_parquet('{tmp_path / str(most)}/orders.parquet/*.parquet')")
        assert difference(catalogue.QUERIES[name](spark, str(tmp_path / str(most))), con, catalogue.ORACLES[name]) == ""
