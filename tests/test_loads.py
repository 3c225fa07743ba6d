from __future__ import annotations

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallyshelf.schemas import INVENTORY, MG, ORDERS
from tallyshelf.sources import conform, csv_tables
from tallyshelf.streaming.csv_stream import stream_table
from tests.tables import day, dicts


@pytest.fixture
def write(tmp_path):
    def to_file(name: str, content: bytes | str) -> str:
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(content if isinstance(content, bytes) else content.encode())
        return str(path)

    return to_file


def load(spark, path, spec=ORDERS, **options):
    return csv_tables.load_table(spark, spec, path, **options)


def test_plain_file(spark, write):
    path = write("o.csv", "order_id,status,sale_price\n1,new,2.5\n2,old,\n")
    loaded = load(spark, path)
    assert loaded.table.columns == ORDERS.columns
    assert loaded.table.schema == ORDERS.schema
    assert [(r["order_id"], r["status"], r["sale_price"], r["returned_at"])
            for r in dicts(loaded.table)] == [(1, "new", 2.5, None), (2, "old", None, None)]
    assert not loaded.plans[0].multiline


def test_latin1_is_detected(spark, write):
    loaded = load(spark, write("o.csv", b"order_id,status\n1,caf\xe9\n"))
    assert loaded.plans[0].encoding == csv_tables.LATIN1
    assert dicts(loaded.table)[0]["status"] == "café"


def test_byte_order_mark(spark, write):
    loaded = load(spark, write("o.csv", b"\xef\xbb\xbforder_id,status\n1,caf\xc3\xa9\n"))
    assert [(r["order_id"], r["status"]) for r in dicts(loaded.table)] == [(1, "café")]


def test_uneven_rows(spark, write):
    text = "order_id,status\n1,a\n3,z,EXTRA\n4\n5,w,\n6,q,,\n  \n\n7,\"a,b\"\n8,\"c,d\",\"e\"\n"
    for body in (text, text + '9,"x\ny"\n'):
        loaded = load(spark, write("o.csv", body))
        rows = [(r["order_id"], r["status"]) for r in dicts(loaded.table)]
        expected = [(1, "a"), (4, None), (7, "a,b")]
        expected += [(9, "x\ny")] if body != text else []
        assert sorted(rows, key=str) == sorted(expected, key=str)
        report = dicts(loaded.report())[0]
        assert (report["row_count"], report["skipped_rows"]) == (len(rows), 4)
        assert loaded.table.count() == len(rows)


def test_missing_words(spark, write):
    words = ["NA", "null", "", "NaN", "None", "#N/A", "n/a", "kept"]
    body = "order_id,status\n" + "".join(f"{i},{w}\n" for i, w in enumerate(words))
    statuses = [r["status"] for r in dicts(load(spark, write("o.csv", body)).table)]
    assert statuses == [None] * 7 + ["kept"]


def test_headers_and_aliases(spark, write):
    path = write("o.csv", " Order_ID ,CUSTOMER_ID,buyer_id,Price,extra,order_id\n"
                          "1,NA,7,2.5,e,99\n2,8,9,3,e,99\n")
    rows = [(r["order_id"], r["user_id"], r["sale_price"]) for r in dicts(load(spark, path).table)]
    assert rows == [(1, 7, 2.5), (2, 8, 3.0)]


def test_canonical_column_before_alias(spark, write):
    path = write("i.csv", "buy_price,unit_cost,cost\n1,2,3\n1,2,\n1,,\n")
    assert [r["cost"] for r in dicts(load(spark, path, INVENTORY).table)] == [3.0, 2.0, 1.0]


def test_spaced_headers_of_mg(spark, write):
    path = write("m.csv", "Id User,Total Payout,Vendor\n4,1.5,v\n")
    row = dicts(load(spark, path, MG).table)[0]
    assert (row["id_user"], row["total_payout"], row["vendor_name"]) == (4, 1.5, "v")


def test_values_that_do_not_fit(spark, write):
    path = write("o.csv", "order_id,user_id,sale_price,created_at,shipped_at\n"
                          "2.5,5.0,x,2024-01-01T10:00:00+05:30,soon\n"
                          "1e3,9007199254740993,1d,2024-01-01 10:00:00 UTC,01/02/2024\n"
                          "99999999999999999999,-7,inf,2024-01-01,2024-01-01 10:00:00.25Z\n")
    loaded = load(spark, path, formats=["dd/MM/yyyy"])
    got = [(r["order_id"], r["user_id"], r["sale_price"], r["created_at"], r["shipped_at"])
           for r in dicts(loaded.table)]
    assert got == [
        (None, 5, None, day("2024-01-01 04:30"), None),
        (1000, 9007199254740993, None, day("2024-01-01 10:00"), day("2024-02-01")),
        (None, -7, float("inf"), day("2024-01-01"), day("2024-01-01 10:00:00.250")),
    ]
    failures = {r["column_name"]: (r["given"], r["failed"]) for r in dicts(
        conform.coercion_failures(loaded.raw, ORDERS, ["dd/MM/yyyy"]))}
    assert failures["order_id"] == (3, 2) and failures["sale_price"] == (3, 2)
    assert failures["user_id"] == (3, 0) and failures["shipped_at"] == (3, 1)


def test_timestamps_do_not_depend_on_the_session_zone(spark, write):
    path = write("o.csv", "created_at,shipped_at\n2024-07-01 10:00:00,2024-07-01T10:00:00+02:00\n")
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        row = dicts(load(spark, path).table)[0]
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert (row["created_at"], row["shipped_at"]) == (day("2024-07-01 10:00"), day("2024-07-01 08:00"))


def test_first_existing_path(spark, write, tmp_path):
    path = write("mg.csv", "id_user\n1\n")
    loaded = load(spark, [str(tmp_path / "none.csv"), path], MG)
    assert loaded.resolved == path and len(loaded.tried) == 1
    assert loaded.table.count() == 1


def test_no_path(spark, tmp_path):
    loaded = load(spark, [str(tmp_path / "a.csv"), str(tmp_path / "b.csv")], MG)
    assert loaded.missing and loaded.table.schema == MG.schema and loaded.table.count() == 0
    assert dicts(loaded.report())[0]["row_count"] == 0


def test_files_of_one_folder_are_planned_one_by_one(spark, write, tmp_path):
    write("all/a.csv", b"order_id,status\n1,caf\xe9\n")
    write("all/b c.csv", "order_id,status\n2,café\n")
    write("all/d.csv", 'order_id,status\n3,"café\nx"\n')
    loaded = load(spark, str(tmp_path / "all"))
    assert len(loaded.plans) == 3
    assert {(r["order_id"], r["status"]) for r in dicts(loaded.table)} == {
        (1, "café"), (2, "café"), (3, "café\nx")}


def test_large_files_are_put_together_from_lines(spark, write, tmp_path):
    values = ["plain", "a\nb", 'say ""hi""\n\n\nthere', "x,y\n,", "\n", "end\n" * 40]
    rows = "".join(f'{i},"{values[i % 6]}"\n' for i in range(3000))
    odd_rows = '1\n2,z,EXTRA\n\n  \n3,w,\n4,"n\nm","q\nr"\n'
    write("all/a.csv", b"\xef\xbb\xbf\norder_id,status\n" + (odd_rows + rows).encode())
    write("all/b.csv", ("order_id,status\n" + rows + '7,"caf\xe9\nx"').encode("latin-1"))
    folder = str(tmp_path / "all")
    whole = load(spark, folder)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "5000")  # records span many blocks
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        split = load(spark, folder)
        got = sorted(map(str, dicts(split.table)))
        report = dicts(split.report())[0]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert got == sorted(map(str, dicts(whole.table)))
    assert report["row_count"] == len(got) == 6002 and report["skipped_rows"] == 3


@pytest.mark.parametrize("seed", range(4))
def test_random_files_are_read_as_pandas_reads_them(spark, write, seed):
    """Quotes, line breaks, uneven rows, blank lines and missing words, in text columns."""
    pick = random.Random(seed)
    words = ["a", "b c", " d ", "é", "NA", "", "null", "1.0", "x'y", "-", "#N/A"]
    if seed % 2:
        words += ["p,q", 'say "hi"', "two\nlines", '"', ",\n,", "two\r\nends"]

    def cell():
        word = pick.choice(words)
        if pick.random() < 0.05:  # a quote that opens nothing
            return pick.choice(['5" pipe', '6" by 7"', 'x""'])
        quoted = any(c in word for c in ',"\n') or pick.random() < 0.2
        return '"' + word.replace('"', '""') + '"' if quoted else word

    # pandas takes a first row that is too wide for one with an index column.
    lines = ["product_name,product_brand,product_category", "k,l,m"]
    for _ in range(400):
        width = pick.choice([3] * 10 + [1, 2, 4, 5])
        lines.append(",".join(["k", *[cell() for _ in range(width - 1)]]))
        if pick.random() < 0.05:
            lines.append(pick.choice(["", "  "]))
    path = write("i.csv", ("\n".join(lines) + "\n").encode())
    expected = pd.read_csv(path, dtype=str, on_bad_lines="skip").astype(object)
    rows = [tuple(r) for r in expected.where(expected.notna(), None).itertuples(index=False)]
    for multiline in (None, True):
        loaded = load(spark, path, INVENTORY, multiline=multiline).table
        got = loaded.select("product_name", "product_brand", "product_category").collect()
        assert sorted(map(str, map(tuple, got))) == sorted(map(str, rows))


def test_stray_quotes_lose_no_row_over_many_blocks(spark, write):
    rows = "".join(f'{i},"a\r\n{i}"\n{i},{i}" pipe\n' for i in range(1500))
    path = write("o.csv", ("order_id,status\n" + rows).encode())
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "5000")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        got = sorted((r["order_id"], r["status"]) for r in dicts(load(spark, path).table))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert got == sorted((i, text) for i in range(1500) for text in (f"a\r\n{i}", f'{i}" pipe'))


@pytest.mark.parametrize("rest", ["", "".join(f"{i},z\n" for i in range(500))])
def test_a_field_left_open_is_an_error(spark, write, rest):
    path = write("o.csv", 'order_id,status\n1,"open\n' + rest)
    with pytest.raises(Exception, match="not closed"):
        load(spark, path).table.collect()


def test_large_file_with_another_header(spark, write, tmp_path):
    write("all/a.csv", 'order_id,status\n1,"a\nb"\n')
    write("all/b.csv", 'status,order_id\n"a\nb",2\n')
    with pytest.raises(Exception, match="CSV header does not conform"):
        load(spark, str(tmp_path / "all")).table.collect()


def test_other_header_in_a_file_is_an_error(spark, write, tmp_path):
    write("all/a.csv", "order_id,status\n1,a\n")
    write("all/b.csv", "status,order_id\nb,2\n")
    with pytest.raises(Exception, match="CSV header does not conform"):
        load(spark, str(tmp_path / "all")).table.collect()


def test_given_options_skip_the_scan(spark, write):
    path = write("o.csv", b"order_id,status\n1,caf\xe9\n")
    loaded = load(spark, path, encoding=csv_tables.LATIN1, multiline=False)
    assert dicts(loaded.table)[0]["status"] == "café"


def test_enforce_and_nan(spark):
    df = spark.createDataFrame([(float("nan"), 1, "x")], "sale_price double, order_id int, z string")
    enforced = conform.enforce_schema(df, ORDERS)
    assert enforced.schema == ORDERS.schema
    assert dicts(conform.nan_to_null(enforced))[0]["sale_price"] is None
    typed = conform.coerce_types(df.withColumn("user_id", F.lit(2.5)), ORDERS)
    assert dicts(typed)[0]["sale_price"] is None and dicts(typed)[0]["user_id"] is None


def test_stream_equals_batch(spark, write, tmp_path):
    write("in/a.csv", "order_id,Price,created_at\n1,2.5,2024-01-01\n2,x,soon\n3,1,2024-01-02,EXTRA\n")
    write("in/b.csv", "order_id,Price,created_at\n4\n5,7,2024-01-03\n")
    stream = stream_table(
        spark, ORDERS, str(tmp_path / "in"), ["order_id", "Price", "created_at"], files_per_batch=1
    )
    assert stream.isStreaming and stream.schema == ORDERS.schema
    query = (
        stream.writeStream.format("memory").queryName("arrived")
        .option("checkpointLocation", str(tmp_path / "state"))
        .trigger(availableNow=True).start()
    )
    query.awaitTermination(120)
    batch = load(spark, str(tmp_path / "in")).table
    assert sorted(map(str, dicts(spark.table("arrived")))) == sorted(map(str, dicts(batch)))
    assert spark.table("arrived").count() == 4
