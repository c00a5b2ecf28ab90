"""Registered queries of the reader and writer, with the relation that each must give as SQL.

The data are Parquet, so a query first writes its table as text with the writer, once for each
session and folder, then reads it back through the operator under test. Both sides cover whole
tables.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import rectio as rx
from rectio.functions.locale import locale
from rectio.functions.parsers import parse_column
from rectio.operators.writer import rendered, write_text_dir
from rectio.sources.staging import shared_folder

_WRITTEN: dict[tuple[str, str, str], str] = {}
_QUERIES: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def query(sql: str | None):
    def register(f):
        _QUERIES[f.__name__] = (f, sql)
        return f

    return register


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _text(spark: SparkSession, sf_dir: str, name: str, write: Callable[[str], None]) -> str:
    """Folder of text files that ``write`` makes, once for each session and data folder."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _WRITTEN:
        path = f"{shared_folder(spark, 'text')}/{uuid.uuid4().hex}/{name}"
        write(path)
        _WRITTEN[key] = path
    return _WRITTEN[key]


def _delim(spark: SparkSession, sf_dir: str, table: str, delim: str = ",", columns: list[str] | None = None, **options) -> str:
    df = _table(spark, sf_dir, table)
    df = df.select(*columns) if columns else df
    name = f"{table}-{delim.encode().hex()}-{'-'.join(columns or [])}-{'-'.join(f'{k}{v}' for k, v in options.items())}"
    return _text(spark, sf_dir, name, lambda path: rx.write_delim_dir(df, path, delim, **options))


def _lines(spark: SparkSession, sf_dir: str, name: str, line: Column, table: str) -> str:
    return _text(spark, sf_dir, name, lambda path: _table(spark, sf_dir, table).select(line.alias("value")).write.text(path))


def _headed(spark: SparkSession, sf_dir: str, name: str, df: DataFrame, head: str, files: int = 3) -> str:
    """A folder of several files of lines ``value``, each of which begins with ``head``."""
    return _text(spark, sf_dir, name, lambda path: write_text_dir(df.repartition(files), path, head))


def _day(column: str) -> Column:
    return F.date_format(column, "yyyy-MM-dd").alias(column)


LINEITEM = "IIIiddddccT"


def lineitem_text(spark: SparkSession, sf_dir: str) -> str:
    return _delim(spark, sf_dir, "lineitem", "|")


def read_lineitem(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    return rx.read_delim(spark, lineitem_text(spark, sf_dir), delim="|", col_types=LINEITEM, multiline=False, **options).df


# -- delimited reads


@query("SELECT * REPLACE (strftime(l_shipdate, '%Y-%m-%d') AS l_shipdate) FROM lineitem")
def delim_roundtrip_lineitem(spark, sf_dir):
    df = read_lineitem(spark, sf_dir)
    return df.withColumn("l_shipdate", _day("l_shipdate"))


@query("""SELECT CAST(o_orderkey AS DOUBLE) AS o_orderkey, CAST(o_custkey AS DOUBLE) AS o_custkey, o_orderstatus, o_totalprice,
    strftime(o_orderdate, '%Y-%m-%d') AS o_orderdate, o_orderpriority FROM orders""")
def delim_guess_orders(spark, sf_dir):
    df = rx.read_delim(spark, _delim(spark, sf_dir, "orders", ",")).df
    return df.withColumn("o_orderdate", _day("o_orderdate"))


@query("SELECT doc_id, nullif(trim(text, chr(32) || chr(9) || chr(13)), '') AS text FROM documents")
def quoted_newlines_documents(spark, sf_dir):
    return rx.read_delim(spark, _delim(spark, sf_dir, "documents", ",", ["doc_id", "text"]), delim=",", col_types="Ic").df


@query("SELECT page_id, url, trim(html, chr(32) || chr(9) || chr(13)) AS html FROM pages")
def quoted_pages_semicolon(spark, sf_dir):
    return rx.read_delim(spark, _delim(spark, sf_dir, "pages", ";", ["page_id", "url", "html"]), delim=";", col_types="Icc", multiline=True).df


@query("SELECT event_id, user_id, event_type, value, props FROM events")
def quoted_json_events(spark, sf_dir):
    path = _delim(spark, sf_dir, "events", ",", ["event_id", "user_id", "event_type", "value", "props"])
    return rx.read_delim(spark, path, delim=",", col_types="IIcdc").df


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation")
def multibyte_delim_nation(spark, sf_dir):
    return rx.read_delim(spark, _delim(spark, sf_dir, "nation", "||"), delim="||", col_types="ici").df


@query("SELECT p_partkey, p_name, p_brand, p_type, p_size, p_retailprice FROM part")
def unicode_delim_part(spark, sf_dir):
    return rx.read_delim(spark, _delim(spark, sf_dir, "part", "❤"), delim="❤", col_types="Icccid").df


@query("SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier")
def backslash_escapes_supplier(spark, sf_dir):
    path = _delim(spark, sf_dir, "supplier", "\t", quote="all", escape="backslash")
    return rx.read_delim(spark, path, delim="\t", col_types="Icid", escape_double=False, escape_backslash=True).df


@query("SELECT c_custkey, c_acctbal FROM customer")
def cols_only_customer(spark, sf_dir):
    return rx.read_delim(spark, _delim(spark, sf_dir, "customer"), delim=",", col_types=rx.cols_only(c_custkey="I", c_acctbal="d")).df


@query("SELECT c_mktsegment AS segment, c_custkey AS id FROM customer")
def col_select_rename_customer(spark, sf_dir):
    path = _delim(spark, sf_dir, "customer")
    return rx.read_delim(spark, path, delim=",", col_types="Icidc", col_select=[{"segment": "c_mktsegment"}, {"id": "c_custkey"}]).df


@query("SELECT c_custkey, c_name, c_mktsegment FROM customer")
def col_select_negate_customer(spark, sf_dir):
    path = _delim(spark, sf_dir, "customer")
    return rx.read_delim(spark, path, delim=",", col_types="Icidc", col_select=[~rx.contains("nation"), "-c_acctbal"]).df


@query("SELECT o_orderkey, o_orderdate_, o_orderpriority FROM (SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS o_orderdate_, o_orderpriority FROM orders)")
def col_select_helpers_orders(spark, sf_dir):
    path = _delim(spark, sf_dir, "orders", ",")
    df = rx.read_delim(spark, path, delim=",", col_types="IIcdTc", col_select=[rx.matches("orderkey"), rx.starts_with("o_orderd"), rx.last_col()]).df
    return df.select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("o_orderdate_"), "o_orderpriority")


@query("SELECT CAST(l_orderkey AS VARCHAR) AS X1, l_linestatus AS X2 FROM lineitem")
def no_header_lineitem(spark, sf_dir):
    path = _delim(spark, sf_dir, "lineitem", "|", ["l_orderkey", "l_linestatus"], col_names=False)
    return rx.read_delim(spark, path, delim="|", col_names=False, col_types="cc").df


@query("SELECT p_partkey AS key, p_name AS name FROM part")
def given_names_part(spark, sf_dir):
    path = _delim(spark, sf_dir, "part", "|", ["p_partkey", "p_name"], col_names=False)
    return rx.read_delim(spark, path, delim="|", col_names=["key", "name"], col_types="Ic").df


@query("SELECT r_regionkey, r_name FROM region")
def skip_comment_region(spark, sf_dir):
    path = _delim(spark, sf_dir, "region")
    body = [r[0] for r in spark.read.text(path).collect()]
    head, rows = body[0], [x for x in body if x != body[0]]
    messy = ["junk one", "", "## a comment", head + "## names", "", *[f"{x}## row" for x in rows], "   ", "## end"]
    return rx.read_delim(spark, rx.I(messy), delim=",", col_types="ic", skip=1, comment="##").df


@query("""SELECT p_partkey, CASE WHEN p_partkey % 5 = 1 THEN NULL ELSE p_name END AS p_name,
    CASE WHEN p_partkey % 5 = 1 THEN NULL WHEN p_partkey % 5 = 2 THEN p_brand || '|x|y' ELSE p_brand END AS p_brand FROM part""")
def ragged_rows_part(spark, sf_dir):
    tail = F.when(F.col("p_partkey") % 5 == 1, "").otherwise(F.concat(F.lit("|"), "p_name", F.lit("|"), "p_brand"))
    more = F.when(F.col("p_partkey") % 5 == 2, "|x|y").otherwise("")
    path = _lines(spark, sf_dir, "ragged-part", F.concat(F.col("p_partkey").cast("string"), tail, more), "part")
    names = ["p_partkey", "p_name", "p_brand"]
    return rx.read_delim(spark, path, delim="|", quote="", col_names=names, col_types="Icc", width=3).df


@query("SELECT n_nationkey, n_name FROM nation WHERE n_nationkey < 10")
def n_max_nation(spark, sf_dir):
    text = rx.format_delim(_table(spark, sf_dir, "nation").select("n_nationkey", "n_name").orderBy("n_nationkey"), ",")
    return rx.read_delim(spark, rx.I(text), delim=",", col_types="ic", n_max=10).df


@query("SELECT c_custkey, CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN NULL ELSE c_mktsegment END AS c_mktsegment FROM customer")
def na_strings_customer(spark, sf_dir):
    path = _delim(spark, sf_dir, "customer", ",", ["c_custkey", "c_mktsegment"])
    return rx.read_delim(spark, path, delim=",", col_types="Ic", na=["BUILDING", "MACHINERY"]).df


@query("SELECT event_type AS kind, CAST(count(*) AS BIGINT) AS n, min(event_id) AS first_id, max(event_id) AS last_id FROM events GROUP BY event_type")
def multi_file_id_events(spark, sf_dir):
    events = _table(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    kinds = sorted(r[0] for r in events.select("event_type").distinct().collect())
    paths = [
        _text(spark, sf_dir, f"events_{k}", lambda path, k=k: rx.write_delim_dir(events.where(F.col("event_type") == k).drop("event_type"), path, ","))
        for k in kinds
    ]
    df = rx.read_delim(spark, paths, delim=",", col_types="II", id="path").df
    kind = F.regexp_extract("path", "events_([^/]+)/", 1)
    return df.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"), F.max("event_id").alias("last_id"))


# -- folders of several files, each with what comes before its data


@query("SELECT o_orderkey, o_orderstatus FROM orders")
def skip_folder_orders(spark, sf_dir):
    orders = _table(spark, sf_dir, "orders")
    lines = orders.select(F.concat_ws(",", F.col("o_orderkey").cast("string"), "o_orderstatus").alias("value"))
    path = _headed(spark, sf_dir, "skip-orders", lines, "one line of junk\n\no_orderkey,o_orderstatus")
    return rx.read_delim(spark, path, delim=",", col_types="Ic", skip=1).df


@query("SELECT c_custkey, c_mktsegment FROM customer")
def comment_folder_customer(spark, sf_dir):
    tail = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit(" ## note\n## whole line "), "c_name")).otherwise("")
    line = F.concat(F.col("c_custkey").cast("string"), F.lit(","), "c_mktsegment", tail)
    path = _headed(spark, sf_dir, "comment-customer", _table(spark, sf_dir, "customer").select(line.alias("value")), "## first\n\nc_custkey,c_mktsegment## names")
    return rx.read_delim(spark, path, delim=",", col_types="Ic", comment="##").df


@query("SELECT c_custkey, c_name || ' é' AS \"prénom\" FROM customer")
def latin1_folder_customer(spark, sf_dir):
    line = F.concat(F.col("c_custkey").cast("string"), F.lit(","), "c_name", F.lit(" é"))
    lines = _table(spark, sf_dir, "customer").select(line.alias("c_custkey,prénom")).repartition(3)
    # lines without the separator and quote are written as they are
    writer = lines.write.option("header", True).option("sep", "\x01").option("quote", "\x02").option("encoding", "ISO-8859-1")
    path = _text(spark, sf_dir, "latin1-customer", writer.csv)
    return rx.read_delim(spark, path, delim=",", col_types="Ic", locale=locale(encoding="latin-1")).df


@query("SELECT p_partkey, p_name, p_retailprice FROM part")
def gzip_folder_part(spark, sf_dir):
    part = _table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_retailprice").repartition(3)
    path = _text(spark, sf_dir, "part-gz", lambda path: rx.write_delim_dir(part, path, ",", compression="gzip"))
    return rx.read_delim(spark, path, delim=",", col_types="Icd").df


def _sorted_orders(spark: SparkSession, sf_dir: str, columns: list[str]) -> str:
    orders = _table(spark, sf_dir, "orders").select(*columns).repartitionByRange(3, "o_orderkey").sortWithinPartitions("o_orderkey")
    return _text(spark, sf_dir, f"sorted-orders-{'-'.join(columns)}", lambda path: rx.write_delim_dir(orders, path, ","))


@query("SELECT o_orderpriority AS level, CAST(row_number() OVER (ORDER BY min(o_orderkey)) AS INTEGER) AS code FROM orders GROUP BY o_orderpriority")
def factor_implicit_orders(spark, sf_dir):
    path = _sorted_orders(spark, sf_dir, ["o_orderkey", "o_orderpriority"])
    return rx.read_delim(spark, path, delim=",", col_types="If").levels("o_orderpriority")


@query("SELECT nullif(o_orderstatus, 'P') AS level, CAST(row_number() OVER (ORDER BY min(o_orderkey)) AS INTEGER) AS code FROM orders GROUP BY o_orderstatus")
def factor_include_na_orders(spark, sf_dir):
    path = _sorted_orders(spark, sf_dir, ["o_orderkey", "o_orderstatus"])
    kinds = rx.cols(o_orderkey="I", o_orderstatus=rx.col_factor(include_na=True))
    return rx.read_delim(spark, path, delim=",", col_types=kinds, na=["P"]).levels("o_orderstatus")


@query("SELECT o_orderkey, nullif(o_orderstatus, 'P') AS o_orderstatus, CAST(0 AS BIGINT) AS problems FROM orders")
def factor_na_level_orders(spark, sf_dir):
    path = _sorted_orders(spark, sf_dir, ["o_orderkey", "o_orderstatus"])
    kinds = rx.cols(o_orderkey="I", o_orderstatus=rx.col_factor(["O", "F", None]))
    frame = rx.read_delim(spark, path, delim=",", col_types=kinds, na=["P"])
    return frame.df.withColumn("problems", F.lit(frame.problems().count()))


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey IN (0, 6, 777, 1234)")
def rows_by_number_orders(spark, sf_dir):
    frame = rx.read_delim(spark, _sorted_orders(spark, sf_dir, ["o_orderkey", "o_totalprice"]), delim=",", col_types="Id")
    return frame.rows([7, 1, 1235, 778]).drop("row")


@query("SELECT CAST(count(*) AS BIGINT) AS files, CAST(3 * 100 AS BIGINT) AS rows FROM (VALUES (1), (2), (3)) t(x)")
def n_max_each_file_orders(spark, sf_dir):
    path = _sorted_orders(spark, sf_dir, ["o_orderkey", "o_totalprice"])
    df = rx.read_delim(spark, path, delim=",", col_types="Id", n_max=100, id="file").df
    # the first rows of a sorted file have its least keys side by side
    files = df.groupBy("file").agg(F.count("*").alias("n"), F.min("o_orderkey").alias("low"), F.max("o_orderkey").alias("high"))
    return files.where("high - low = n - 1").agg(F.count("*").alias("files"), F.sum("n").alias("rows"))


@query("""SELECT CAST(2 AS INTEGER) + CAST(p_partkey % 5 = 2 AS INTEGER) * 3 - CAST(p_partkey % 5 = 1 AS INTEGER) AS col, '3 columns' AS expected,
    CASE WHEN p_partkey % 5 = 2 THEN '5 columns' ELSE '1 columns' END AS actual, CAST(count(*) AS BIGINT) AS n FROM part WHERE p_partkey % 5 IN (1, 2) GROUP BY ALL""")
def problems_width_part(spark, sf_dir):
    tail = F.when(F.col("p_partkey") % 5 == 1, "").otherwise(F.concat(F.lit("|"), "p_name", F.lit("|"), "p_brand"))
    more = F.when(F.col("p_partkey") % 5 == 2, "|x|y").otherwise("")
    path = _lines(spark, sf_dir, "ragged-part", F.concat(F.col("p_partkey").cast("string"), tail, more), "part")
    frame = rx.read_delim(spark, path, delim="|", quote="", col_names=["p_partkey", "p_name", "p_brand"], col_types="Icc", width=3)
    return frame.problems().groupBy("col", "expected", "actual").agg(F.count("*").alias("n"))


@query("SELECT s_suppkey AS X1, s_name AS X2, s_acctbal AS X3 FROM supplier")
def fwf_empty_supplier(spark, sf_dir):
    line = F.concat(F.rpad(F.col("s_suppkey").cast("string"), 12, " "), F.rpad(F.replace("s_name", F.lit(" "), F.lit("_")), 30, " "), F.col("s_acctbal").cast("string"))
    path = _lines(spark, sf_dir, "supplier-blanks", line, "supplier")
    return rx.read_fwf(spark, path, col_types="Icd").df.withColumn("X2", F.replace("X2", F.lit("_"), F.lit(" ")))


# -- fixed width and lines


@query("SELECT s_suppkey, s_name, s_acctbal FROM supplier")
def fwf_supplier(spark, sf_dir):
    line = F.concat(F.rpad(F.col("s_suppkey").cast("string"), 12, " "), F.rpad("s_name", 30, " "), F.col("s_acctbal").cast("string"))
    path = _lines(spark, sf_dir, "supplier-fwf", line, "supplier")
    layout = rx.fwf_widths([12, 30, None], ["s_suppkey", "s_name", "s_acctbal"])
    return rx.read_fwf(spark, path, layout, col_types="Icd").df


@query("SELECT substr(lpad(CAST(o_orderkey AS VARCHAR), 8, '0'), 1, 4) AS a, substr(lpad(CAST(o_orderkey AS VARCHAR), 8, '0'), 3, 2) AS b, o_orderstatus AS c FROM orders")
def fwf_overlap_orders(spark, sf_dir):
    path = _lines(spark, sf_dir, "orders-fwf", F.concat(F.lpad(F.col("o_orderkey").cast("string"), 8, "0"), F.col("o_orderstatus")), "orders")
    return rx.read_fwf(spark, path, rx.fwf_positions([1, 3, 9], [4, 4, 9], ["a", "b", "c"]), col_types="ccc").df


@query("SELECT CAST(r_regionkey AS DOUBLE) AS X1, r_name AS X2 FROM region")
def fwf_empty_region(spark, sf_dir):
    lines = [f"{r['r_regionkey']:<6d}{r['r_name']}" for r in _table(spark, sf_dir, "region").collect()]
    return rx.read_fwf(spark, rx.I(lines)).df


@query("SELECT unnest(string_split(text, chr(10))) AS line FROM documents")
def lines_documents(spark, sf_dir):
    path = _lines(spark, sf_dir, "documents-lines", F.col("text"), "documents")
    return rx.read_lines(spark, path).withColumnRenamed("V1", "line")


@query("SELECT line FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM documents) WHERE trim(line, chr(32) || chr(9) || chr(13)) <> ''")
def lines_skip_empty_documents(spark, sf_dir):
    path = _lines(spark, sf_dir, "documents-lines", F.col("text"), "documents")
    return rx.read_lines(spark, path, skip_empty_rows=True).withColumnRenamed("V1", "line")


# -- parsers on spellings chosen by the key


def _spelt(spark: SparkSession, sf_dir: str, kind: str, spellings: list[str], fmt: str | None = None, loc=None, show: Callable[[Column], Column] = lambda x: x) -> DataFrame:
    key = F.col("o_orderkey")
    text = F.get(F.array(*[F.lit(s) for s in spellings]), (key % len(spellings)).cast("int"))  # null for a remainder below zero
    df = _table(spark, sf_dir, "orders").select("o_orderkey", text.alias("x"))
    return df.select("o_orderkey", show(parse_column(F.col("x"), kind, loc or locale(), fmt)).alias("v"))


def _expected(values: list[str], kind: str) -> str:
    cases = " ".join(f"WHEN {k} THEN CAST({v} AS {kind})" for k, v in enumerate(values))
    return f"SELECT o_orderkey, CASE o_orderkey % {len(values)} {cases} END AS v FROM orders"


@query(_expected(["true", "false", "true", "false", "NULL", "NULL"], "BOOLEAN"))
def parse_logical(spark, sf_dir):
    return _spelt(spark, sf_dir, "logical", ["TRUE", "f", "1", "0", "yes", "tRUE"])


@query(_expected(["12", "-7", "2147483647", "NULL", "NULL", "NULL"], "INTEGER"))
def parse_integer(spark, sf_dir):
    return _spelt(spark, sf_dir, "integer", ["12", "-7", "2147483647", "2147483648", "+5", " 3"])


@query(_expected(["2147483648", "-9", "NULL", "NULL"], "BIGINT"))
def parse_big_integer(spark, sf_dir):
    return _spelt(spark, sf_dir, "big_integer", ["2147483648", "-9", "9223372036854775808", "1.0"])


@query(_expected(["1.5", "100", "1000", "0.5", "'-inf'", "NULL", "NULL"], "DOUBLE"))
def parse_double(spark, sf_dir):
    return _spelt(spark, sf_dir, "double", ["1.5", "1d2", "1e3", ".5", "-Inf", "1.2.3", "0x10"])


@query(_expected(["2750.25", "6.5", "9", "31000", "NULL", "-550"], "DOUBLE"))
def parse_number(spark, sf_dir):
    return _spelt(spark, sf_dir, "number", ["EUR 2,750.25", "6.5.1", "9-8", "about 31,000 of 40", "-.-", "-5.5e2 m"])


@query(_expected(["1234.5", "0.75", "-2"], "DOUBLE"))
def locale_decimal_comma(spark, sf_dir):
    return _spelt(spark, sf_dir, "number", ["1.234,5", "0,75 EUR", "-2"], loc=locale(decimal_mark=","))


_SHOW_DAY = lambda x: F.date_format(x, "yyyy-MM-dd")
_SHOW_SECOND = lambda x: F.date_format(x, "yyyy-MM-dd HH:mm:ss")


@query(_expected(["'2020-01-31'", "'1999-12-01'", "NULL", "NULL"], "VARCHAR"))
def parse_date(spark, sf_dir):
    return _spelt(spark, sf_dir, "date", ["2020-01-31", "1999/12/01", "2020-13-01", "01/15/2024"], show=_SHOW_DAY)


@query(_expected(["'2010-02-03'", "'1970-01-10'", "'2068-05-02'", "NULL"], "VARCHAR"))
def parse_date_format(spark, sf_dir):
    return _spelt(spark, sf_dir, "date", ["3 Feb 10", "10 jan 70", " 2 May 68", "31 Jun 10"], "%d %b %y", show=_SHOW_DAY)


@query(_expected(["'2010-01-15'", "'2012-08-02'"], "VARCHAR"))
def locale_french_dates(spark, sf_dir):
    return _spelt(spark, sf_dir, "date", ["15 janvier 2010", "2 août 2012"], "%d %B %Y", locale("fr"), _SHOW_DAY)


@query(_expected(["'2020-01-02 03:04:05'", "'2020-01-02 03:04:00'", "'2020-01-02 14:30:00'", "'2020-01-02 00:00:00'", "NULL"], "VARCHAR"))
def parse_datetime(spark, sf_dir):
    return _spelt(spark, sf_dir, "datetime", ["2020-01-02T03:04:05Z", "20200102T0304", "2020-01-02T18:30+04", "2020-01-02", "2020-02-30"], show=_SHOW_SECOND)


@query(_expected(["'1970-10-25 05:30:00'", "NULL", "'1970-07-01 16:00:00'"], "VARCHAR"))
def timezone_gap_and_overlap(spark, sf_dir):
    texts = ["1970-10-25 01:30:00", "1970-04-26 02:30:00", "1970-07-01 12:00:00"]
    return _spelt(spark, sf_dir, "datetime", texts, "%Y-%m-%d %H:%M:%S", locale(tz="America/New_York"), _SHOW_SECOND)


@query(_expected(["45296", "46920", "90000", "NULL"], "BIGINT"))
def parse_time(spark, sf_dir):
    def seconds(x: Column) -> Column:
        part = lambda p: F.extract(F.lit(p), x)
        return (part("DAY") * 86400 + part("HOUR") * 3600 + part("MINUTE") * 60 + part("SECOND")).cast("bigint")

    return _spelt(spark, sf_dir, "time", ["12:34:56", "1:02 PM", "25:00:00", "10:61"], show=seconds)


@query("SELECT o_orderkey, CASE WHEN o_orderstatus IN ('F', 'O') THEN o_orderstatus END AS o_orderstatus FROM orders")
def factor_levels_orders(spark, sf_dir):
    path = _delim(spark, sf_dir, "orders", ",", ["o_orderkey", "o_orderstatus"])
    return rx.read_delim(spark, path, delim=",", col_types={"o_orderkey": "I", "o_orderstatus": rx.col_factor(["F", "O"])}).df


# -- date and time formats on each order's own moment


def _moment() -> Column:
    """The order's day with a time from its key."""
    return F.col("o_orderdate") + F.col("o_orderkey") * 7919 % 86400 * F.expr("INTERVAL '1' SECOND")


_MOMENT = "(o_orderdate + to_seconds(o_orderkey * 7919 % 86400))"


def _formatted(spark: SparkSession, sf_dir: str, text: Column, kind: str, fmt: str, loc=None) -> DataFrame:
    df = _table(spark, sf_dir, "orders").select("o_orderkey", text.alias("x"))
    v = parse_column(F.col("x"), kind, loc or locale(), fmt)
    if kind == "time":
        part = lambda p: F.extract(F.lit(p), F.col("v"))
        return df.select("o_orderkey", v.alias("v")).select("o_orderkey", (part("DAY") * 86400 + part("HOUR") * 3600 + part("MINUTE") * 60 + part("SECOND")).cast("bigint").alias("v"))
    return df.select("o_orderkey", F.date_format(v, "yyyy-MM-dd" if kind == "date" else "yyyy-MM-dd HH:mm:ss.SSS").alias("v"))


def _moments(sql: str = _MOMENT) -> str:
    return f"SELECT o_orderkey, strftime({sql}, '%Y-%m-%d %H:%M:%S.%g') AS v FROM orders"


_DAYS = "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS v FROM orders"


def _written(pattern: str) -> Column:
    return F.date_format(_moment(), pattern)


@query(_moments())
def format_twelve_hours(spark, sf_dir):
    return _formatted(spark, sf_dir, _written("yyyy-MM-dd hh:mm:ss a"), "datetime", "%Y-%m-%d %I:%M:%S %p")


@query(_DAYS)
def format_padded_day(spark, sf_dir):
    return _formatted(spark, sf_dir, F.concat(F.lpad(_written("d"), 2, " "), _written("/MM/yyyy")), "date", "%e/%m/%Y")


@query(_moments())
def format_fractions(spark, sf_dir):
    return _formatted(spark, sf_dir, _written("yyyy-MM-dd HH:mm:ss.SSS"), "datetime", "%F %H:%M:%OS")


@query(_moments(f"{_MOMENT} - to_minutes(CAST((o_orderkey % 5 - 2) * 90 AS INTEGER))"))
def format_offsets(spark, sf_dir):
    minutes = (F.col("o_orderkey") % 5 - 2) * 90
    size = F.abs(minutes)
    clock = F.concat(F.lpad(F.floor(size / 60).cast("string"), 2, "0"), F.when(F.col("o_orderkey") % 2 == 0, ":").otherwise(""), F.lpad((size % 60).cast("string"), 2, "0"))
    return _formatted(spark, sf_dir, F.concat(_written("yyyy-MM-dd HH:mm:ss "), F.when(minutes < 0, "-").otherwise("+"), clock), "datetime", "%Y-%m-%d %H:%M:%S %z")


@query(_moments(f"{_MOMENT} - to_hours(CAST(CASE o_orderkey % 3 WHEN 0 THEN 9 WHEN 1 THEN -7 ELSE 0 END AS INTEGER))"))
def format_zone_names(spark, sf_dir):
    zone = F.element_at(F.array(F.lit("Asia/Tokyo"), F.lit("America/Phoenix"), F.lit("UTC")), (F.col("o_orderkey") % 3 + 1).cast("int"))
    return _formatted(spark, sf_dir, F.concat(_written("yyyy-MM-dd HH:mm:ss "), zone), "datetime", "%Y-%m-%d %H:%M:%S %Z")


@query(_DAYS)
def format_non_digits(spark, sf_dir):
    junk = F.repeat(F.lit("~"), (F.col("o_orderkey") % 3).cast("int"))
    return _formatted(spark, sf_dir, F.concat(_written("dd."), _written("MM"), F.lit("--"), _written("yyyy"), junk), "date", "%d%.%m%+%Y%*")


@query(_DAYS)
def format_american_day(spark, sf_dir):
    return _formatted(spark, sf_dir, _written("MM/dd/yy"), "date", "%D")


@query(_DAYS)
def format_short_day(spark, sf_dir):
    return _formatted(spark, sf_dir, _written("yy/MM/dd"), "date", "%x")


@query(_moments())
def format_day_and_clock(spark, sf_dir):
    return _formatted(spark, sf_dir, _written("yyyy-MM-dd HH:mm:ss"), "datetime", "%F %T")


@query(_moments())
def format_day_and_x_clock(spark, sf_dir):
    return _formatted(spark, sf_dir, _written("yyyy-MM-dd HH:mm:ss"), "datetime", "%F %X")


@query(_moments(f"date_trunc('minute', {_MOMENT})"))
def format_minutes(spark, sf_dir):
    return _formatted(spark, sf_dir, _written("yyyy-MM-dd HH:mm"), "datetime", "%F %R")


@query(_moments())
def format_epoch(spark, sf_dir):
    seconds = F.datediff(F.col("o_orderdate"), F.lit("1970-01-01")).cast("bigint") * 86400 + F.col("o_orderkey") * 7919 % 86400
    return _formatted(spark, sf_dir, seconds.cast("string"), "datetime", "%s")


@query("SELECT o_orderkey, CAST(CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE -1 END * ((o_orderkey % 900 + 1) * 3600 + o_orderkey % 60 * 60 + o_orderkey % 53) AS BIGINT) AS v FROM orders")
def format_free_hours(spark, sf_dir):
    key = F.col("o_orderkey")
    clock = F.format_string("%d:%02d:%02d", key % 900 + 1, key % 60, key % 53)
    return _formatted(spark, sf_dir, F.concat(F.when(key % 2 == 0, "").otherwise("-"), clock), "time", "%h:%M:%S")


@query(_DAYS)
def format_weekday_and_month(spark, sf_dir):
    return _formatted(spark, sf_dir, _written("EEE, dd MMMM yyyy"), "date", "%a, %d %B %Y")


# -- inference, specification, problems


@query("""SELECT * FROM (VALUES ('orders', 'double,double,character,double,datetime,character'), ('customer', 'double,character,double,double,character'),
    ('region', 'double,character'), ('lineitem', 'double,double,double,double,double,double,double,double,character,character,datetime')) t(name, kinds)""")
def guess_type_tables(spark, sf_dir):
    found = []
    for name in ("orders", "customer", "region", "lineitem"):
        frame = rx.read_delim(spark, _delim(spark, sf_dir, name, ","), delim=",", multiline=False)
        found.append((name, ",".join(c.kind for c in frame.spec.cols.values())))
    return spark.createDataFrame(found, "name string, kinds string")


@query("""SELECT * FROM (VALUES ('1,2', 'number'), ('T', 'logical'), ('1.5', 'double'), ('01', 'character'), ('12:30', 'time'), ('2020-01-01', 'date'),
    ('2020-01-01T10:00', 'datetime'), ('x', 'character'), ('00010203', 'datetime'), ('20001010', 'double')) t(x, kind)""")
def guess_type_values(spark, sf_dir):
    values = ["1,2", "T", "1.5", "01", "12:30", "2020-01-01", "2020-01-01T10:00", "x", "00010203", "20001010"]
    return spark.createDataFrame([(v, rx.guess_type(spark, [v])) for v in values], "x string, kind string")


@query("SELECT * FROM (VALUES ('default', 'double'), ('o_orderstatus', 'character'), ('o_orderdate', 'datetime'), ('o_orderpriority', 'character')) t(name, kind)")
def cols_condense_orders(spark, sf_dir):
    spec = rx.cols_condense(rx.read_delim(spark, _delim(spark, sf_dir, "orders", ","), delim=",", multiline=False).spec)
    return spark.createDataFrame([("default", spec.default.kind), *[(k, c.kind) for k, c in spec.cols.items()]], "name string, kind string")


@query("""SELECT CAST(3 AS INTEGER) AS col, 'an integer' AS expected, CAST(c_nationkey AS VARCHAR) || 'x' AS actual, CAST(count(*) AS BIGINT) AS n
    FROM customer WHERE c_custkey % 10 = 0 GROUP BY ALL""")
def problems_customer(spark, sf_dir):
    key = F.concat(F.col("c_nationkey").cast("string"), F.when(F.col("c_custkey") % 10 == 0, "x").otherwise(""))
    line = F.concat_ws(",", F.col("c_custkey").cast("string"), "c_name", key)
    path = _lines(spark, sf_dir, "customer-problems", line, "customer")
    frame = rx.read_delim(spark, path, delim=",", col_names=["c_custkey", "c_name", "c_nationkey"], col_types="Ici")
    return frame.problems().groupBy("col", "expected", "actual").agg(F.count("*").alias("n"))


@query("SELECT * FROM (VALUES (CAST(3 AS BIGINT), CAST(2 AS INTEGER), 'a double', '1.x'), (CAST(4 AS BIGINT), CAST(1 AS INTEGER), '2 columns', '1 columns')) t(\"row\", col, expected, actual)")
def problems_rows(spark, sf_dir):
    frame = rx.read_delim(spark, rx.I("x,y\n1,2\n1,1.x\n3\n"), delim=",", col_types="dd")
    return frame.problems().drop("file")


# -- writer


@query("SELECT n_nationkey || chr(9) || n_name || chr(9) || n_regionkey AS line FROM nation")
def format_lines_nation(spark, sf_dir):
    return rendered(_table(spark, sf_dir, "nation")).withColumnRenamed("value", "line")


@query("SELECT event_id || ',\"' || event_type || '\",\"' || replace(props, '\"', '\"\"') || '\"' AS line FROM events")
def write_quote_all_events(spark, sf_dir):
    return rendered(_table(spark, sf_dir, "events").select("event_id", "event_type", "props"), ",", quote="all").withColumnRenamed("value", "line")


@query("SELECT event_id || chr(9) || replace(props, '\"', '\\\"') AS line FROM events")
def write_escape_backslash_events(spark, sf_dir):
    return rendered(_table(spark, sf_dir, "events").select("event_id", "props"), quote="none", escape="backslash").withColumnRenamed("value", "line")


@query("SELECT c_custkey || ',' || regexp_replace(CAST(c_acctbal AS VARCHAR), '[.]0$', '') AS line FROM customer")
def write_doubles_customer(spark, sf_dir):
    return rendered(_table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal"), ",").withColumnRenamed("value", "line")


@query("SELECT o_orderkey || ',' || strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') || ',' || CASE WHEN o_orderkey % 2 = 0 THEN 'TRUE' ELSE 'FALSE' END AS line FROM orders")
def write_datetimes_orders(spark, sf_dir):
    df = _table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", (F.col("o_orderkey") % 2 == 0).alias("even"))
    return rendered(df, ",").withColumnRenamed("value", "line")


@query("SELECT n_nationkey, n_name FROM nation")
def write_append_gzip_nation(spark, sf_dir):
    nation = _table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    path = os.path.join(tempfile.mkdtemp(prefix="rectio-"), "nation.csv.gz")
    rx.write_delim(nation.where("n_nationkey < 10"), path, ",", bom=True)
    rx.write_delim(nation.where("n_nationkey >= 10"), path, ",", append=True)
    with open(path, "rb") as f:  # a file object is staged for the executors
        return rx.read_delim(spark, f, delim=",", col_types="ic").df


@query("SELECT r_regionkey, r_name FROM region UNION ALL SELECT r_regionkey, r_name FROM region UNION ALL SELECT r_regionkey, r_name FROM region")
def compressed_region(spark, sf_dir):
    import bz2
    import io
    import lzma
    import zipfile

    data = rx.format_delim(_table(spark, sf_dir, "region"), ",").encode()
    folder = tempfile.mkdtemp(prefix="rectio-")
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as z:
        z.writestr("region.csv", data)
    paths = []
    for name, body in (("a.csv.xz", lzma.compress(data)), ("b.bin", bz2.compress(data)), ("c.zip", packed.getvalue())):
        paths.append(os.path.join(folder, name))
        with open(paths[-1], "wb") as f:
            f.write(body)
    return rx.read_delim(spark, paths, delim=",", col_types="ic").df


@query("SELECT r_regionkey, r_name || 'é' AS r_name FROM region")
def encodings_region(spark, sf_dir):
    df = _table(spark, sf_dir, "region").select("r_regionkey", F.concat("r_name", F.lit("é")).alias("r_name"))
    return rx.read_delim(spark, rx.format_delim(df, ",").encode("latin-1"), delim=",", col_types="ic", locale=locale(encoding="latin-1")).df


# -- the benchmark's workload on text


@query("SELECT l_linestatus, avg(l_quantity) AS mean_quantity FROM lineitem WHERE l_returnflag = 'R' GROUP BY l_linestatus")
def filter_group_mean_lineitem(spark, sf_dir):
    return read_lineitem(spark, sf_dir).where("l_returnflag = 'R'").groupBy("l_linestatus").agg(F.avg("l_quantity").alias("mean_quantity"))


@query("SELECT l_returnflag, CAST(count(*) AS BIGINT) AS n, sum(l_quantity) AS quantity FROM lineitem GROUP BY l_returnflag")
def group_sum_lineitem(spark, sf_dir):
    return read_lineitem(spark, sf_dir).groupBy("l_returnflag").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("quantity"))


@query("SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem WHERE l_extendedprice > 50000")
def filter_numeric_lineitem(spark, sf_dir):
    return read_lineitem(spark, sf_dir).where("l_extendedprice > 50000").select("l_orderkey", "l_linenumber", "l_extendedprice")


@query("SELECT l_orderkey, l_linenumber FROM lineitem ORDER BY l_orderkey, l_linenumber, l_partkey LIMIT 10")
def head_lineitem(spark, sf_dir):
    return read_lineitem(spark, sf_dir).orderBy("l_orderkey", "l_linenumber", "l_partkey").limit(10).select("l_orderkey", "l_linenumber")


@query("SELECT CAST(100 AS BIGINT) AS n, CAST(100 AS BIGINT) AS known")
def sample_100_lineitem(spark, sf_dir):
    picked = read_lineitem(spark, sf_dir).orderBy(F.rand(1)).limit(100)
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"]
    known = picked.join(_table(spark, sf_dir, "lineitem").select(*keys).distinct().withColumn("known", F.lit(1)), keys, "left")
    return known.agg(F.count("*").alias("n"), F.count("known").alias("known"))


@query("SELECT CAST(1000 AS BIGINT) AS n, CAST(8 AS INTEGER) AS width")
def gen_tbl_shape(spark, sf_dir):
    df = rx.gen_tbl(spark, 1000, 8, missing=0.1)
    return df.agg(F.count("*").alias("n")).withColumn("width", F.lit(len(df.columns)))


@query("SELECT n_nationkey, n_name FROM nation")
def stream_nation(spark, sf_dir):
    path = _delim(spark, sf_dir, "nation", ",", ["n_nationkey", "n_name"])
    stream = rx.read_stream(spark, path, rx.cols(n_nationkey="i", n_name="c"), header=True)
    name = f"nation_{uuid.uuid4().hex}"
    running = stream.writeStream.format("memory").queryName(name).trigger(availableNow=True).start()
    running.awaitTermination(120)
    return spark.table(name)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, (f, _) in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _QUERIES.items() if sql}
