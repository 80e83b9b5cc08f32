"""Files are decoded a piece at a time and written in bounded sizes; parsed pages keep their items alone."""

import pyarrow as pa

from pyspark.sql import functions as F

from fairlease.sources import io


def test_charset_is_told_from_pieces(monkeypatch):
    monkeypatch.setattr(io, "DECODED_BYTES", 7)
    text = "서울 가나다,1\n" * 50
    for charset in io.CHARSETS:
        raw = text.encode(charset)
        assert io._decodes(pa.py_buffer(raw), charset)
        assert not io._decodes(pa.py_buffer(raw[:-1] + b"\xff"), charset)
    assert not io._decodes(pa.py_buffer(text.encode("cp949")), "utf-8-sig")
    assert io._decodes(pa.py_buffer(b""), "utf-8-sig")
    assert not io._decodes(pa.py_buffer(b"\xef\xbb"), "utf-8-sig")


def test_large_and_empty_files_in_both_charsets(spark, tmp_path):
    body = "".join(f"{i},\"서울 {i}\n둘째, 줄\",\r\n" for i in range(40_000))
    (tmp_path / "a.csv").write_bytes(("k,v,w\r\n" + body).encode("cp949"))
    (tmp_path / "b.csv").write_bytes(("k,v,w\r\n" + body).encode("utf-8-sig"))
    (tmp_path / "c.csv").write_bytes(b"")
    assert (tmp_path / "a.csv").stat().st_size > io.DECODED_BYTES
    got = io.read_csv_files(spark, f"{tmp_path}/*.csv")
    assert got.columns == ["k", "v", "w"]
    right = F.col("v") == F.concat(F.lit("서울 "), "k", F.lit("\n둘째, 줄"))
    assert got.agg(F.count("*"), F.count_if(right), F.count("w"), F.countDistinct("k")).first() == (80_000, 80_000, 0, 40_000)


def test_written_csv_files_hold_bounded_records(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(io, "CSV_FILE_ROWS", 100)
    df = spark.range(1000).selectExpr("cast(id as string) k").coalesce(1)
    io.write_table(df, f"{tmp_path}/x.csv", fmt="csv")
    assert len(list(tmp_path.glob("x.csv/part-*.csv"))) == 10
    assert sorted(r["k"] for r in io.read_csv_files(spark, f"{tmp_path}/x.csv/part-*").collect()) == sorted(map(str, range(1000)))


def test_good_pages_are_stored_without_their_text(spark, monkeypatch):
    page = "<response><header><resultCode>000</resultCode></header><body><items><item><a> 1 </a></item></items><totalCount>1</totalCount></body></response>"
    stored = []
    keep = io.materialize
    monkeypatch.setattr(io, "materialize", lambda df: stored.append(df) or keep(df))
    rows, errors = io.parse_trade_xml(spark.createDataFrame([("good", page), ("bad", page[:60])], "k string, payload string"), "payload", ("k",))
    assert {r["k"]: r["payload"] for r in stored[0].collect()} == {"good": None, "bad": page[:60]}
    assert [r["item"] for r in rows.collect()] == [{"a": "1"}]
    assert "transform_values" not in rows._jdf.queryExecution().optimizedPlan().toString()
    assert [(r["k"], r["payload"]) for r in errors.collect()] == [("bad", page[:60])]


def test_a_number_is_parsed_once_in_its_expression(spark):
    from fairlease.functions import columns as C

    texts = ["1,234.5", " 7 ", "", " ", ",", "NaN", "abc", None, "-0", "1e3", "Infinity"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select(C.to_number("t").alias("n"))
    assert [r["n"] for r in df.collect()] == [1234.5, 7.0, None, None, None, None, None, None, 0.0, 1000.0, float("inf")]
    assert df._jdf.queryExecution().optimizedPlan().toString().count("trim(") <= 1
