"""A1 / A3: declared-schema CSV with a UTF-8 BOM; missing table -> empty frame with the schema."""

import os
import tempfile

from pyspark.sql import types as T

from fairlease.sources import io

SCHEMA = T.StructType([T.StructField("gu_code", T.StringType()), T.StructField("deposit", T.StringType())])


def test_read_table_bom_and_schema(spark):
    d = tempfile.mkdtemp(prefix="fairlease-src-")
    path = os.path.join(d, "listing.csv")
    with open(path, "w", encoding="utf-8-sig") as fh:
        fh.write("gu_code,deposit\n01110,\"12,000\"\n11680, 300 \n")
    rows = io.read_table(spark, path, SCHEMA).collect()
    assert [r["gu_code"] for r in rows] == ["01110", "11680"]  # leading zero kept, BOM not in the name
    assert [r["deposit"] for r in rows] == ["12,000", " 300 "]


def test_read_or_empty_missing(spark):
    d = tempfile.mkdtemp(prefix="fairlease-src-")
    df = io.read_or_empty(spark, os.path.join(d, "absent"), SCHEMA, fmt="csv")
    assert df.count() == 0 and df.schema == SCHEMA


GOOD = "<response><header><resultCode>000</resultCode><resultMsg>OK</resultMsg></header><body><items>{}</items><totalCount>{}</totalCount></body></response>"


def test_every_payload_gives_rows_or_an_error(spark):
    item = "<item><a> 1 </a><b/></item>"
    payloads = {
        "one": GOOD.format(item, 1),
        "two": GOOD.format(item + "<item><a>2</a></item>", 2),
        "none": GOOD.format("", 0),
        "header": "<response><header><resultCode>03</resultCode><resultMsg>NODATA</resultMsg></header></response>",
        "service": "<OpenAPI_ServiceResponse><cmmMsgHeader><errMsg>E</errMsg><returnAuthMsg>NO KEY</returnAuthMsg><returnReasonCode>30</returnReasonCode></cmmMsgHeader></OpenAPI_ServiceResponse>",
        "deep": "<r><x><y><resultCode>99</resultCode></y></x></r>",
        "cut": GOOD.format(item, 1)[:-40],
        "cut_early": GOOD.format(item, 1)[:60],
        "unclosed": "<response><header><resultCode>000</resultCode></header><body>",
        "text": "upstream timed out",
        "html": "<p>Bad gateway",
        "bare": "<response/>",
        "blank": "  ",
        "null": None,
    }
    rows, errors = io.parse_trade_xml(spark.createDataFrame(list(payloads.items()), "k string, payload string"), "payload", ("k",))
    items = [(r["k"], r["item"]) for r in rows.collect()]
    assert sorted(k for k, _ in items) == ["one", "two", "two"] and all(v["a"] in ("1", "2") for _, v in items)
    bad = {r["k"]: (r["result_code"], r["payload"]) for r in errors.collect()}
    assert {k: c for k, (c, _) in bad.items()} == {
        "header": "03", "service": "30", "deep": "99", "cut": "MALFORMED", "cut_early": "MALFORMED", "unclosed": "MALFORMED", "text": "MALFORMED",
        "html": "MALFORMED", "bare": "EMPTY", "blank": "EMPTY", "null": "EMPTY",
    }
    assert all(p == payloads[k] for k, (_, p) in bad.items())
    assert {k for k, _ in items} | set(bad) | {"none"} == set(payloads)


def csv_folder(files):
    d = tempfile.mkdtemp(prefix="fairlease-csv-")
    for name, content in files.items():
        with open(os.path.join(d, name), "wb") as fh:
            fh.write(content)
    return d


def test_csv_files_of_two_headers_and_two_charsets(spark):
    big = "이름,값\n" + "".join(f"이름{i},{i}\n" for i in range(25_000))
    d = csv_folder(
        {
            "rent_1.csv": "﻿이름,값\r\n서울,1\r\n\r\n\"부산, 남구\",\"a \"\"b\"\"\"\r\n".encode(),
            "rent_2.csv": "값,추가,이름\n2,x,대구\n3\n4,y,인천,zzz\n".encode("cp949"),
            "rent_3.csv": "이름,값,이름\n처음,5,나중\n".encode(),
            "rent_4.csv": b"",
            "rent_5.csv": "이름,값\n".encode("cp949"),
            "rent_6.csv": big.encode("cp949"),
            "sale_1.csv": b"other\n1\n",
        }
    )
    got = io.read_csv_files(spark, f"{d}/rent_*.csv")
    assert got.columns == ["이름", "값", "추가"]
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == 25_006
    small = {r for r in rows if not (r[0] or "").startswith("이름")}
    assert small == {("서울", "1", None), ("부산, 남구", 'a "b"', None), ("대구", "2", "x"), (None, "3", None), ("인천", "4", "y"), ("처음", "5", None)}
    assert io.read_csv_files(spark, f"{d}/none_*.csv").columns == []


def test_a_file_in_no_charset_is_named(spark):
    d = csv_folder({"rent_1.csv": b"a\n\xff\xff\xff\n"})
    try:
        io.read_csv_files(spark, f"{d}/rent_*.csv").count()
    except Exception as exc:  # noqa: BLE001
        assert "rent_1.csv" in str(exc)
    else:
        raise AssertionError("undecodable file was read")


def test_thousands_of_files_are_one_scan(spark):
    d = csv_folder({f"rent_{i}.csv": f"k,{'v' if i % 2 else 'w'}\n{i},{i}\n".encode() for i in range(3000)})
    got = io.read_raw_trades(spark, d, "rent")
    assert "Union" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert got.selectExpr("count(*)", "count(v)", "count(w)").first()[:] == (3000, 1500, 1500)


def test_legacy_charset_leaves_the_session_alone(spark):
    d = csv_folder({"t.csv": "gu_code,deposit\n01110,천\n11680,\n".encode("cp949")})
    before = spark.conf.get("spark.sql.legacy.javaCharsets")
    rows = io.read_table(spark, f"{d}/t.csv", SCHEMA, encoding="cp949").collect()
    assert [tuple(r) for r in rows] == [("01110", "천"), ("11680", None)]
    typed = io.read_table(spark, f"{d}/t.csv", "gu_code int, deposit double", encoding="cp949").collect()
    assert [tuple(r) for r in typed] == [(1110, None), (11680, None)]
    assert spark.conf.get("spark.sql.legacy.javaCharsets") == before
