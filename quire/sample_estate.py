"""A workbook estate rendered from star-schema tables, for checks and benchmarks.

Every order becomes one workbook document (XML text), every supplier in it a
data source, every part a field. An order with very many fields is split into
several documents, so that no document, and no group below, grows with the
share of rows one order happens to hold.
"""

from __future__ import annotations

import os
from functools import reduce

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quire.session import fresh_path, hadoop_path, ship_package

# Fields of one volume.
FIELDS_PER_DOCUMENT = 1000
# Source rows that one task renders.
ROWS_PER_TASK = 100_000
# Parts of one slice: the fields of an order are ranked slice by slice.
PARTS_PER_SLICE = 1000


def _text(value: Column) -> Column:
    """Escape for use inside an XML attribute."""
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        value = F.replace(value, F.lit(char), F.lit(entity))
    return value


def _attr(name: str, value: Column) -> Column:
    """`` name="value"``, or nothing where the value is null."""
    return F.coalesce(F.concat(F.lit(f' {name}="'), value, F.lit('"')), F.lit(""))


def _joined(rows: Column, field: str) -> Column:
    return F.array_join(F.transform(rows, lambda r: r[field]), "")


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def tasks_for(rows: DataFrame, rows_per_task: int = ROWS_PER_TASK) -> int:
    """Tasks that render documents from rows of a stored table: slim rows become large texts, so their bytes do not tell."""
    return max(2 * rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // rows_per_task))


def staged(rows: DataFrame, label: str) -> DataFrame:
    """Rows written to the shared folder, so that Spark knows their size; they go when the driver's JVM ends."""
    spark = rows.sparkSession
    path = fresh_path(spark, label)
    rows.write.parquet(path)
    handle, files = hadoop_path(spark, path)
    files.deleteOnExit(handle)
    return spark.read.parquet(path)


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("o"), F.col("l_suppkey").alias("s"), F.col("l_partkey").alias("p"),
        (F.col("l_returnflag") == "R").alias("has_r"))


def _ranked(items: DataFrame) -> DataFrame:
    """``(o, vol, s, p, has_r)``: the fields of each document of orders that may need several."""
    rows = items.groupBy("o", "s", "p").agg(F.max("has_r").alias("has_r"))
    rows = rows.withColumn("slice", F.floor(F.col("p") / PARTS_PER_SLICE))
    # Ranks by slice: counts per slice are added up, and only the fields of one slice are sorted together.
    slices = rows.groupBy("o", "slice").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("o").orderBy("slice")) - F.col("n")
    ranked = rows.withColumn("place", F.row_number().over(Window.partitionBy("o", "slice").orderBy("p", "s")) - 1)
    volume = F.floor((F.col("before") + F.col("place")) / FIELDS_PER_DOCUMENT)
    return ranked.join(slices.select("o", "slice", before.alias("before")), ["o", "slice"]).select(
        "o", volume.alias("vol"), "s", "p", "has_r")


def _document_rows(spark: SparkSession, sf_dir: str) -> list[tuple[DataFrame, list[str]]]:
    """``(o, vol, s, p, has_r)``, the fields of each document, and what deals them to tasks.

    Orders with so few line items that one document holds them need no ranks, and one exchange by order brings
    together all that their documents are made of. The others are ranked, and dealt by document.
    """
    items = _items(spark, sf_dir)
    long_orders = staged(
        items.groupBy("o").agg(F.count("*").alias("n")).filter(F.col("n") > FIELDS_PER_DOCUMENT).select("o"), "long-orders")
    short = lambda rows: rows.withColumn("vol", F.lit(0).cast("long"))
    if long_orders.isEmpty():
        return [(short(items), ["o"])]
    return [(short(items.join(long_orders, "o", "left_anti")), ["o"]),
            (_ranked(items.join(long_orders, "o", "left_semi")), ["o", "vol"])]


def documents(spark: SparkSession, sf_dir: str, variant: str = "a") -> DataFrame:
    """``(o, path, xml)`` of every document; variant ``b`` is a later snapshot.

    What documents are made of is exchanged as slim rows; texts are made where a document is put together.
    """
    later = variant == "b"
    # Rows of one key travel as one array, so that a repeated key multiplies what it should and nothing before it.
    parts = _read(spark, sf_dir, "part").groupBy(F.col("p_partkey").alias("p")).agg(
        F.collect_list(F.struct("p_name")).alias("names"))
    orders = _read(spark, sf_dir, "orders").groupBy(F.col("o_orderkey").alias("o")).agg(F.collect_list(F.struct(
        F.when(F.col("o_orderstatus") == "F", F.lit("18.1"))
        .when(F.col("o_orderstatus") == "O", F.lit("17.0")).alias("version"),
        F.col("o_orderpriority").alias("platform"),
    )).alias("heads"))
    supplier = staged(
        _read(spark, sf_dir, "supplier")
        .join(_read(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
        .join(_read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .groupBy(F.col("s_suppkey").alias("s")).agg(F.collect_list(F.struct("s_name", "n_nationkey", "r_name")).alias("owners")),
        "suppliers")
    tasks = tasks_for(_read(spark, sf_dir, "lineitem"))
    rendered = []
    for rows, dealt_by in _document_rows(spark, sf_dir):
        # Joined while rows are slim: where suppliers are too many to broadcast, this exchanges no text.
        rows = rows.join(parts, "p").join(supplier, "s")
        if dealt_by == ["o"]:
            rows = rows.repartition(tasks, "o").join(orders, "o")
        else:
            rows = rows.join(orders, "o").repartition(tasks, *dealt_by)
        rendered.append(_rendered(rows, later))
    return reduce(DataFrame.unionByName, rendered)


def _rendered(rows: DataFrame, later: bool) -> DataFrame:
    """``(o, path, xml)`` from ``(o, vol, s, p, has_r, names, owners, heads)``, dealt by document or by order."""
    k, s = F.col("p"), F.col("s")
    name = F.concat(F.lit("[p"), k.cast("string"), F.lit("]"))
    caption = (
        F.when(k % 10 == 0, F.lit("Customer Email"))
        .when(k % 10 == 1, F.lit("SSN"))
        .when(k % 10 == 2, F.lit("Cost Center"))
        .otherwise(F.col("p_name"))
    )
    datatype = F.when((k % 6 == 0) & F.lit(later), F.lit("integer")).otherwise(F.lit("string"))
    formula = (
        F.when(k % 20 == 0, F.concat(F.lit("ATTR("), name, F.lit(") * 2")))
        .when(k % 20 == 4, F.concat(F.lit("[gone"), k.cast("string"), F.lit("] + 1")))
        .when(k % 20 == 8, F.concat(F.lit('IF USERNAME() = "a" THEN '), name, F.lit(" END")))
        .when(k % 40 == 12, F.lit("1 + 1"))
        .when(k % 40 == 32, F.lit(" 1  +  1 "))
        .when(k % 20 == 16, F.concat(name, F.lit(" * 3" if later else " * 2")))
    )
    plain_xml = F.concat(
        F.lit("<column"), _attr("name", name), _attr("datatype", datatype),
        F.lit(' role="dimension" type="nominal"'), _attr("caption", _text(caption)), F.lit("/>"),
    )
    calc_xml = F.coalesce(F.concat(
        F.lit('<column name="[c'), k.cast("string"), F.lit(']" datatype="real" role="measure">'),
        F.lit('<calculation class="tableau"'), _attr("formula", _text(formula)), F.lit("/></column>"),
    ), F.lit(""))
    # _attr never yields null, so a missing formula has to blank the element here.
    calc_xml = F.when(formula.isNotNull(), calc_xml).otherwise(F.lit(""))

    sources = (
        rows.groupBy("o", "vol", "s", "p", "names", "owners", "heads").agg(F.max("has_r").alias("has_r"))
        .select("o", "vol", "s", "has_r", "p", "owners", "heads", F.explode("names").alias("named"))
        .select("o", "vol", "s", "has_r", "p", "owners", "heads", "named.p_name")
        .select("o", "vol", "s", "has_r", "p", "owners", "heads", plain_xml.alias("plain"), calc_xml.alias("calc"))
        .groupBy("o", "vol", "s", "owners", "heads")
        .agg(
            F.max("has_r").alias("has_r"),
            F.array_sort(F.collect_list(F.struct("p", "plain", "calc"))).alias("cols"),
        )
        .withColumn("cols_xml", F.concat(_joined(F.col("cols"), "plain"), _joined(F.col("cols"), "calc")))
    )
    nation = F.col("n_nationkey")
    server = F.when(
        nation % 2 == 0,
        F.concat(F.replace(F.lower("r_name"), F.lit(" "), F.lit("")), F.lit(".internal.example.com")),
    ).otherwise(F.concat(F.lit("n"), nation.cast("string"), F.lit(".vendor.example.net")))
    dbname = F.when(nation.between(10, 19), F.lit("dbx1")).otherwise(
        F.concat(F.lit("db_"), nation.cast("string"))
    )
    source_name = F.concat(F.lit("federated.s"), s.cast("string"))
    sheet = F.concat(
        F.lit("ws_"), s.cast("string"),
        F.when((s % 9 == 0) & F.lit(later), F.lit("_v2")).otherwise(F.lit("")),
    )
    filename = F.when(s % 7 == 0, F.concat(F.lit("C:\\Users\\u"), s.cast("string"), F.lit("\\x.csv")))
    source_xml = F.concat(
        F.lit("<datasource"), _attr("name", source_name), _attr("caption", _text(F.col("s_name"))),
        F.lit('><connection class="sqlserver"'), _attr("server", server), _attr("dbname", dbname),
        _attr("password", F.when(F.col("has_r"), F.lit("hunter2-secret"))),
        _attr("filename", filename), F.lit("/>"), F.col("cols_xml"), F.lit("</datasource>"),
    )
    if later:
        source_xml = F.when(s % 5 == 0, F.lit("")).otherwise(source_xml)
    sheet_xml = F.concat(
        F.lit("<worksheet"), _attr("name", sheet), F.lit("><table><view><datasources>"),
        F.when(s % 4 == 0, F.lit("")).otherwise(
            F.concat(F.lit("<datasource"), _attr("name", source_name), F.lit("/>"))
        ),
        F.lit("</datasources></view></table></worksheet>"),
    )
    zone_xml = F.when(
        s % 2 == 0,
        F.concat(F.lit('<zone id="'), s.cast("string"), F.lit('" type="worksheet"'), _attr("name", sheet), F.lit("/>")),
    ).otherwise(F.lit(""))

    parts = (
        sources.select("o", "vol", "s", "heads", "has_r", "cols_xml", F.explode("owners").alias("owner"))
        .select("o", "vol", "s", "heads", "has_r", "cols_xml", "owner.*")
        .select("o", "vol", "s", "heads", source_xml.alias("source"), sheet_xml.alias("sheet"), zone_xml.alias("zone"))
        .groupBy("o", "vol", "heads")
        .agg(F.array_sort(F.collect_list(F.struct("s", "source", "sheet", "zone"))).alias("parts"))
        .select("o", "vol", "parts", F.explode("heads").alias("head"))
        .select("o", "vol", "parts", "head.*")
    )
    dashboard = F.when(F.col("o") % 3 != 0, F.concat(
        F.lit('<dashboard name="Overview"><zones><zone id="0" type="layout-basic">'),
        _joined(F.col("parts"), "zone"), F.lit("</zone></zones></dashboard>"),
    )).otherwise(F.lit(""))
    xml = F.concat(
        F.lit('<?xml version="1.0" encoding="utf-8"?>\n<workbook'),
        _attr("version", F.col("version")), _attr("source-platform", _text(F.col("platform"))),
        F.lit(">\n<datasources>"), _joined(F.col("parts"), "source"),
        F.lit("</datasources>\n<worksheets>"), _joined(F.col("parts"), "sheet"),
        F.lit("</worksheets>\n<dashboards>"), dashboard, F.lit("</dashboards>\n</workbook>\n"),
    )
    path = F.concat(
        F.lit("estate/"), F.col("o").cast("string"), F.lit("-"), F.col("vol").cast("string"), F.lit(".twb"),
    )
    return parts.select("o", path.alias("path"), xml.alias("xml"))


def files(docs: DataFrame) -> DataFrame:
    """Documents in the shape of scanned files."""
    return docs.select("path", F.encode("xml", "UTF-8").alias("content"))


def with_broken(docs: DataFrame) -> DataFrame:
    """Every 50th order's documents cut off in the middle."""
    half = F.expr("substring(xml, 1, CAST(length(xml) / 2 AS INT))")
    return docs.withColumn("xml", F.when(F.col("o") % 50 == 0, half).otherwise(F.col("xml")))


def with_repeated_source(docs: DataFrame) -> DataFrame:
    """Every 10th order's documents name two data sources alike."""
    twice = '<datasources><datasource name="twin"/><datasource name="twin"/>'
    repeated = F.replace("xml", F.lit("\n<datasources>"), F.lit("\n" + twice))
    return docs.withColumn("xml", F.when(F.col("o") % 10 == 0, repeated).otherwise(F.col("xml")))


def _noisy(xml: Column) -> Column:
    xml = F.replace(xml, F.lit("\n<datasources>"), F.lit("\n<!-- saved --><windows><window a='1'/></windows><datasources>"))
    xml = F.replace(xml, F.lit("<workbook"), F.lit('<workbook source-build="2026.1"'))
    return F.regexp_replace(xml, r'<column( name="[^"]*")( datatype="[^"]*")', "<column$2$1")


def noisy(docs: DataFrame) -> DataFrame:
    """The same documents as another save would write them: comments, window
    state, a build number, other attribute order."""
    return docs.withColumn("xml", _noisy(F.col("xml")))


def with_noisy(docs: DataFrame) -> DataFrame:
    """The documents and their ``noisy`` forms, each rendered once."""
    return docs.withColumn("xml", F.explode(F.array("xml", _noisy(F.col("xml")))))


def packaged(docs: DataFrame) -> DataFrame:
    """Zipped documents; every 40th order holds two members, every 41st none."""
    def pack(batches):
        import io
        import zipfile

        for frame in batches:
            contents = []
            for o, xml in zip(frame["o"], frame["xml"]):
                buffer = io.BytesIO()
                with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED, compresslevel=1) as archive:
                    archive.writestr("data/extract.txt", "x")
                    if o % 41 != 0:
                        archive.writestr("book.twb", xml)
                        if o % 40 == 0:
                            archive.writestr("copy.TWB", xml)
                contents.append(buffer.getvalue())
            yield frame.assign(content=contents, path=frame["path"] + "x")[["path", "content"]]

    ship_package(docs.sparkSession)
    return docs.select("o", "path", "xml").mapInPandas(pack, "path string, content binary")


def schema_file(spark: SparkSession) -> str:
    """Name under which executors find the XML schema of the documents."""
    path = os.path.join(os.path.dirname(os.path.abspath(__file__)), "resources", "sample_estate.xsd")
    spark.sparkContext.addFile(path)
    return os.path.basename(path)


def supplier_books(spark: SparkSession, sf_dir: str, later: bool) -> DataFrame:
    """``name, text`` of one small workbook per supplier, as a scan of real files would meet them.

    Every tenth is truncated. The later state holds what changed only: a second data source in every fourth, and half
    of the truncated ones repaired.
    """
    key = F.col("s_suppkey")
    source = F.concat(F.lit('<datasource name="s'), key.cast("string"), F.lit('"><connection class="sqlserver" server="n'),
                      F.col("s_nationkey").cast("string"), F.lit('.example.net"/></datasource>'))
    more = F.when(F.lit(later) & (key % 4 == 1), F.lit('<datasource name="later"/>')).otherwise(F.lit(""))
    whole = F.concat(F.lit('<workbook version="18.1"><datasources>'), source, more, F.lit("</datasources></workbook>"))
    broken = key % 20 == 17 if later else key % 10 == 7
    rows = _read(spark, sf_dir, "supplier").select(
        F.concat(F.lit("n"), F.col("s_nationkey").cast("string"), F.lit("/s"), key.cast("string"), F.lit(".twb")).alias("name"),
        F.when(broken, F.lit("<workbook")).otherwise(whole).alias("text"), "s_suppkey")
    return (rows.where((key % 4 == 1) | (key % 20 == 7)) if later else rows).select("name", "text")


def write_files(rows: DataFrame, root: str) -> None:
    """Each row of ``name, text`` as a file below ``root``; a repeated task writes the same again."""
    def written(batches):
        system, place = fs.FileSystem.from_uri(root)
        for batch in batches:
            for name, text in zip(batch.column("name").to_pylist(), batch.column("text").to_pylist()):
                target = f"{place}/{name}"
                system.create_dir(target.rpartition("/")[0], recursive=True)
                with system.open_output_stream(target) as out:
                    out.write(text.encode())
        yield pa.RecordBatch.from_arrays([pa.array([0], pa.int64())], ["done"])

    rows.select("name", "text").mapInArrow(written, "done long").write.format("noop").mode("overwrite").save()
