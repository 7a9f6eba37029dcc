"""Title and copyright pages as books print them, set from the book and contributor tables.

The corpus has hardly any pages of this kind, so the rules for them would meet
nothing. Each book with a title gets two pages before its first, under the
indices -2 and -1; what they state follows from its digest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bindery.session import read

ORDINAL_LINES = ["Second edition", "3rd revised edition", "International edition", "Third edition published 1987", "First edition published 1980", "Printed on acid-free paper"]


def books(spark: SparkSession, d: str) -> DataFrame:
    """``doc_id, title, site, n, nine``: two digits of the digest as a number, nine others."""
    x = read(spark, d, "book").where("title is not null and sha256 is not null and site is not null").groupBy("doc_id").agg(F.min("title").alias("title"), F.min("site").alias("site"), F.min("sha256").alias("sha"))
    return x.withColumn("n", F.ascii(F.substring("sha", 1, 1)) + 3 * F.ascii(F.substring("sha", 2, 1))).withColumn("nine", F.translate(F.substring("sha", 3, 9), "abcdefABCDEF", "012345012345"))


def _digit(text: Column, i: int) -> Column:
    return F.substring(text, i, 1).cast("int")


def isbn(nine: Column) -> tuple[Column, Column]:
    """A book number of thirteen digits with hyphens, and one of ten."""
    total = F.lit(38)
    for i in range(1, 10):
        total = total + _digit(nine, i) * (3 if i % 2 else 1)
    ten = F.lit(0)
    for i in range(1, 10):
        ten = ten + _digit(nine, i) * (11 - i)
    last = F.pmod(F.lit(11) - F.pmod(ten, F.lit(11)), F.lit(11))
    thirteen = F.concat(F.lit("978-"), F.substring(nine, 1, 1), F.lit("-"), F.substring(nine, 2, 4), F.lit("-"), F.substring(nine, 6, 4), F.lit("-"), F.pmod(F.lit(10) - F.pmod(total, F.lit(10)), F.lit(10)).cast("string"))
    return thirteen, F.concat(F.substring(nine, 1, 1), F.lit(" "), F.substring(nine, 2, 4), F.lit(" "), F.substring(nine, 6, 4), F.lit(" "), F.when(last == 10, "X").otherwise(last.cast("int").cast("string")))


def lines(spark: SparkSession, d: str) -> DataFrame:
    """``doc_id, page_index, revision, line, text, t, b, h`` of the two pages of each book."""
    b = books(spark, d)
    n, site = F.col("n"), F.col("site")
    row = lambda y, text, t, h: F.struct(F.lit(y).alias("o"), text.alias("text"), F.lit(float(t)).alias("t"), F.lit(float(h)).alias("h"))
    none = F.lit(None).cast("string")
    head = F.array(row(1, F.col("title"), 100, 24), row(2, F.when(n % 2 == 0, F.lit("A companion volume for readers")), 134, 14), row(1000, F.when(n % 5 == 0, F.concat(F.lit("University of "), site)).otherwise(F.concat(site, F.lit(" Press"))), 700, 12))
    top = b.select("doc_id", F.lit(-2).alias("page_index"), F.explode(head).alias("x")).select("doc_id", "page_index", "x.*")
    c = read(spark, d, "contributor").where("name is not null and doc_id is not null").select("doc_id", "contributor_id", "ord", "name").distinct()
    w = Window.partitionBy("doc_id").orderBy("ord", "contributor_id", "name")
    c = c.withColumn("i", F.row_number().over(w)).join(b.select("doc_id", "n"), "doc_id")
    said = F.when(n % 3 == 0, F.concat(F.lit("by "), "name")).when(n % 3 == 1, F.col("name")).otherwise(F.concat(F.lit("Edited by "), "name"))
    named = c.select("doc_id", F.lit(-2).alias("page_index"), (F.col("i") + 9).alias("o"), said.alias("text"), (F.lit(180.0) + 20 * F.col("i")).alias("t"), F.lit(14.0).alias("h"))
    y = 1950 + n % 60
    thirteen, ten = isbn(F.col("nine"))
    wrong = F.concat(F.substring(thirteen, 1, 16), F.pmod(F.substring(thirteen, 17, 1).cast("int") + 1, F.lit(10)).cast("string"))
    other = F.when(n % 2 == 0, F.concat(F.lit("Copyright "), (y + 7).cast("string"), F.when(n % 4 == 0, F.concat(F.lit(" Holder "), site)).otherwise(F.lit(" by Another House"))))
    stated = F.element_at(F.array(*map(F.lit, ORDINAL_LINES)), (n % 6 + 1).cast("int"))
    issued = F.when(n % 3 == 0, F.concat(F.lit("First published "), y.cast("string"))).when(n % 3 == 1, F.concat(F.lit("Published "), (y + 1).cast("string"))).otherwise(F.concat(F.lit("Reprinted "), (y + 2).cast("string")))
    numbers = F.when(n % 4 == 0, F.concat(F.lit("ISBN "), thirteen, F.lit(" (hardback : alk. paper)"))).when(n % 4 == 1, F.concat(F.lit("Print ISBN: "), thirteen, F.lit("  e-ISBN "), ten)).when(n % 4 == 2, F.concat(F.lit("ISBN "), wrong)).otherwise(F.lit("ISBN (paperback)"))
    under = F.when(n % 4 == 3, F.concat(thirteen, F.lit(" pbk"))).otherwise(none)
    body = [F.concat(F.lit("© "), y.cast("string"), F.lit(" Holder "), site), other, stated, issued, F.lit("under the Signs and Marks Act of 1971"), numbers, under]
    back = b.select("doc_id", F.lit(-1).alias("page_index"), F.explode(F.array(*[row(i + 1, text, 100 + 20 * i, 10) for i, text in enumerate(body)])).alias("x")).select("doc_id", "page_index", "x.*")
    x = top.unionByName(named).unionByName(back).where("text is not null")
    order = Window.partitionBy("doc_id", "page_index").orderBy("o")
    return x.select("doc_id", "page_index", F.lit(0).cast("long").alias("revision"), F.row_number().over(order).alias("line"), "text", "t", (F.col("t") + F.col("h")).alias("b"), "h")


DIGIT = "CAST(substr(nine, {0}, 1) AS INTEGER)"
S13 = "38 + " + " + ".join(f"{DIGIT.format(i)} * {3 if i % 2 else 1}" for i in range(1, 10))
S10 = " + ".join(f"{DIGIT.format(i)} * {11 - i}" for i in range(1, 10))
SQL_LINES = f"""
sb AS (SELECT *, ascii(substr(sha, 1, 1)) + 3 * ascii(substr(sha, 2, 1)) AS n, translate(substr(sha, 3, 9), 'abcdefABCDEF', '012345012345') AS nine FROM (SELECT doc_id, min(title) AS title, min(site) AS site, min(sha256) AS sha FROM book WHERE title IS NOT NULL AND sha256 IS NOT NULL AND site IS NOT NULL GROUP BY doc_id)),
sd AS (SELECT *, 1950 + n % 60 AS y, CAST((10 - ({S13}) % 10) % 10 AS INTEGER) AS c13, CAST((11 - ({S10}) % 11) % 11 AS INTEGER) AS c10 FROM sb),
sg AS (SELECT *, '978-' || nine[1] || '-' || substr(nine, 2, 4) || '-' || substr(nine, 6, 4) || '-' AS stem, nine[1] || ' ' || substr(nine, 2, 4) || ' ' || substr(nine, 6, 4) || ' ' || CASE WHEN c10 = 10 THEN 'X' ELSE CAST(c10 AS VARCHAR) END AS ten FROM sd),
sh AS (SELECT doc_id, -2 AS page_index, 1 AS o, title AS text, 100.0::DOUBLE AS t, 24.0::DOUBLE AS h FROM sg
  UNION ALL SELECT doc_id, -2, 2, 'A companion volume for readers', 134, 14 FROM sg WHERE n % 2 = 0
  UNION ALL SELECT doc_id, -2, 1000, CASE WHEN n % 5 = 0 THEN 'University of ' || site ELSE site || ' Press' END, 700, 12 FROM sg
  UNION ALL SELECT doc_id, -2, i + 9, CASE n % 3 WHEN 0 THEN 'by ' || name WHEN 1 THEN name ELSE 'Edited by ' || name END, 180.0 + 20 * i, 14 FROM (SELECT doc_id, name, row_number() OVER (PARTITION BY doc_id ORDER BY ord, contributor_id, name) AS i FROM (SELECT DISTINCT doc_id, contributor_id, ord, name FROM contributor WHERE name IS NOT NULL AND doc_id IS NOT NULL)) JOIN sg USING (doc_id)
  UNION ALL SELECT doc_id, -1, 1, '© ' || y || ' Holder ' || site, 100, 10 FROM sg
  UNION ALL SELECT doc_id, -1, 2, 'Copyright ' || (y + 7) || CASE WHEN n % 4 = 0 THEN ' Holder ' || site ELSE ' by Another House' END, 120, 10 FROM sg WHERE n % 2 = 0
  UNION ALL SELECT doc_id, -1, 3, ['Second edition', '3rd revised edition', 'International edition', 'Third edition published 1987', 'First edition published 1980', 'Printed on acid-free paper'][n % 6 + 1], 140, 10 FROM sg
  UNION ALL SELECT doc_id, -1, 4, CASE n % 3 WHEN 0 THEN 'First published ' || y WHEN 1 THEN 'Published ' || (y + 1) ELSE 'Reprinted ' || (y + 2) END, 160, 10 FROM sg
  UNION ALL SELECT doc_id, -1, 5, 'under the Signs and Marks Act of 1971', 180, 10 FROM sg
  UNION ALL SELECT doc_id, -1, 6, CASE n % 4 WHEN 0 THEN 'ISBN ' || stem || c13 || ' (hardback : alk. paper)' WHEN 1 THEN 'Print ISBN: ' || stem || c13 || '  e-ISBN ' || ten WHEN 2 THEN 'ISBN ' || stem || ((c13 + 1) % 10) ELSE 'ISBN (paperback)' END, 200, 10 FROM sg
  UNION ALL SELECT doc_id, -1, 7, stem || c13 || ' pbk', 220, 10 FROM sg WHERE n % 4 = 3),
sl AS (SELECT doc_id, page_index, CAST(0 AS BIGINT) AS revision, row_number() OVER (PARTITION BY doc_id, page_index ORDER BY o) AS line, text, t, t + h AS b, h FROM sh)"""
