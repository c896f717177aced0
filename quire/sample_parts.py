"""Small workbooks rendered from the part table: every kind of change between two snapshots, every wording of the rules.

Each part is one workbook, rendered from its own row alone. What its fields are called, what its formula says and which
file it reads go by remainders of the part's key, as does the one change its later snapshot has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.sample_estate import _attr, _read, _text, tasks_for

# Captions and the label of personal data each of them has, if any.
CAPTIONS = (
    ("Social-Security_Number", "ssn"), ("Date of Birth", "dob"), ("E-Mail", "email"), ("MOBILE number", "phone"),
    ("Zip_Code", "address"), ("CC Num", "credit_card"), ("Diagnosis-Code", "medical"), ("Maiden Name", "personal_name"),
    ("IPv6 Address", "ip_address"), ("Phone or home address", "phone"), ("emailed", None), ("filename", None), ("", None),
)
# Formulas, and whether one decides by the user (``user``) or calls a deprecated function (its name).
FORMULAS = (
    ("USERNAME() = 'a'", "user"), ("isusername ('x')", "user"), ("IF IsMemberOf('g') THEN 1 END", "user"),
    ("FULLNAME( )", "user"), ("1 + USERDOMAIN()", "user"), ("MYUSERNAME()", None), ("[USERNAME] + 1", None),
    ("attr ([id])", "ATTR"), ("[id]  +  1", None),
)
# Files, and whether one lies in somebody's own folder.
FILES = (
    (r"C:\Users\u\x.csv", True), (r"d:\USERS\u\y.csv", True), ("/home/u/z.csv", True), ("/Users/u/z.csv", True),
    ("/var/home/u/z.csv", False), (r"C:\Data\Users\q.csv", False),
)
CHANGES = 17
# Workbooks that one task renders.
ROWS_PER_TASK = 25_000


def _pick(values: tuple, key: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v[0]) for v in values]), (key % len(values) + 1).cast("int"))


def documents(spark: SparkSession, sf_dir: str, later: bool = False) -> DataFrame:
    """``path, xml`` of one workbook per part; the later snapshot differs by the key's remainder modulo ``CHANGES``."""
    key = F.col("p_partkey")

    def if_changed(number: int, new: str, old: str = "") -> Column:
        return F.when(F.lit(later) & (key % CHANGES == number), F.lit(new)).otherwise(F.lit(old))

    def gone(number: int, text: Column) -> Column:
        return F.when(F.lit(later) & (key % CHANGES == number), F.lit("")).otherwise(text)

    connection = F.concat(
        F.lit('<connection class="sqlserver"'), if_changed(2, ' server="new.internal.example.com"', ' server="old.internal.example.com"'),
        F.lit(' dbname="d"'), if_changed(5, ' username="u"'), _attr("filename", _pick(FILES, key)), F.lit("/>"))
    caption = F.when(F.lit(later) & (key % CHANGES == 13), F.lit("Renamed")).otherwise(_pick(CAPTIONS, key))
    role = if_changed(10, ' role="measure"', ' role="dimension"')
    main = F.concat(
        F.lit('<datasource name="main"'), _attr("caption", _text(F.col("p_brand"))), F.lit(">"), gone(4, connection),
        F.lit('<column name="[id]" datatype="integer"'), gone(16, role), _attr("caption", caption), F.lit("/>"),
        F.when(F.lit(later) & (key % CHANGES == 11), F.lit('<column name="[calc]" datatype="string" role="dimension"/>')).otherwise(F.concat(
            F.lit('<column name="[calc]" datatype="real" role="measure"><calculation'), _attr("formula", _pick(FORMULAS, key)),
            F.lit("/></column>"))),
        F.lit("</datasource>"))
    x = F.concat(F.lit('<column name="[x]" datatype="string">'), if_changed(12, '<calculation formula="1"/>'), F.lit("</column>"))
    bare = F.concat(
        F.lit('<datasource name="bare">'), if_changed(3, '<connection class="excel-direct"/>'), gone(9, x),
        if_changed(8, '<column name="[more]"/>'), F.lit("</datasource>"))
    extra = if_changed(6, '<datasource name="extra"><connection class="c"/><column name="[y]"/></datasource>')
    zones = F.concat(
        F.lit('<zones><zone id="1" type="layout-flow"><zone id="2" type="layout-basic"><zone id="3" type="worksheet" name="w1"/></zone>'),
        if_changed(15, "", '<zone id="4" type="worksheet" name="w2"/>'), F.lit('</zone><zone id="5" type="text"/></zones>'))
    xml = F.concat(
        F.lit("<workbook version="), if_changed(1, '"19.1"', '"18.1"'), F.lit(">\n<datasources>"), main, gone(7, bare), extra,
        F.lit('</datasources>\n<worksheets><worksheet name="w1"/>'), if_changed(15, "", '<worksheet name="w2"/>'),
        F.lit("</worksheets>\n<dashboards><dashboard name="), if_changed(14, '"Next"', '"Main"'), F.lit(">"), zones,
        F.lit("</dashboard></dashboards>\n</workbook>\n"))
    path = F.concat(F.lit("parts/"), key.cast("string"), F.lit(".twb"))
    part = _read(spark, sf_dir, "part").select("p_partkey", "p_brand")
    # A few files of slim rows make far more text: the rows are dealt to tasks before the texts are made.
    return part.repartition(tasks_for(part, ROWS_PER_TASK)).select(path.alias("path"), xml.alias("xml"))
