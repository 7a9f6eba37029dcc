"""Bibliographic facts of covers, title and copyright pages, with SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bindery.functions import text as T
from bindery.operators import frontmatter as front
from bindery.plans import query, rules
from bindery.plans.metadata_queries import SQL_LINES, lines
from bindery.session import kept, read
from bindery.sources import corpus, specimen
from bindery.sources.corpus import PAGE

ORD = "CASE WHEN list_contains(['first','second','third','fourth','fifth','sixth','seventh','eighth','ninth','tenth','eleventh','twelfth'], {0}) THEN list_position(['first','second','third','fourth','fifth','sixth','seventh','eighth','ninth','tenth','eleventh','twelfth'], {0}) WHEN regexp_matches({0}, '^[0-9]{{1,3}}(st|nd|rd|th)$') THEN CAST(regexp_extract({0}, '^([0-9]+)', 1) AS INTEGER) END"
ITEMS = "list_filter(list_transform(string_split(regexp_replace(' ' || {0} || ' ', '(?i) and | & |;', ',', 'g'), ','), lambda p: " + rules.squeezed("p") + "), lambda p: p <> '')"


def names_sql(x: str) -> str:
    items = ITEMS.format(rules.plain(x))
    flags = f"list_transform({items}, lambda z: {rules.name_like('z')})"
    return f"list_slice({items}, 1, coalesce(nullif(list_position({flags}, false), 0) - 1, len({items})))"


PHRASES = [("edited by ", "editor"), ("editor: ", "editor"), ("editors: ", "editor"), ("translated by ", "translator")]
ROLE = "CASE " + " ".join(f"WHEN contains({rules.low('text')}, '{p}') THEN '{r}'" for p, r in PHRASES) + f" WHEN starts_with({rules.low('text')}, 'by ') THEN 'author' END"
REST = "CASE " + " ".join(f"WHEN contains({rules.low('text')}, '{p}') THEN substr(text, instr({rules.low('text')}, '{p}') + {len(p)})" for p, _ in PHRASES) + f" WHEN starts_with({rules.low('text')}, 'by ') THEN substr(text, 4) END"
CAPS = "NOT regexp_matches({0}, '[a-z]')"
OPEN = f"({rules.squeezed('ptext')} <> '' AND (regexp_matches({rules.squeezed('ptext')}, '[,:;-]$') OR list_contains(['a','an','and','as','at','by','for','from','in','into','of','on','or','the','to','via','with'], regexp_extract({rules.low(rules.squeezed('ptext'))}, '([^ ]*)$', 1))))"
SQL_FRONT = (
    SQL_LINES
    + f""",{specimen.SQL_LINES},
m0 AS (SELECT doc_id, page_index, revision, line, {rules.squeezed("text")} AS text, t, b, h FROM (SELECT doc_id, page_index, revision, line, text, t, b, h FROM lx UNION ALL SELECT * FROM sl)),
mp AS (SELECT doc_id, page_index, revision, height, images, source, min(page_index) OVER (PARTITION BY doc_id) AS first FROM (SELECT doc_id, page_index, revision, min(height) AS height, max(coalesce(image_object_count, 0)) AS images, min(source) AS source FROM la GROUP BY ALL
  UNION ALL SELECT DISTINCT doc_id, page_index, revision, 800.0::DOUBLE, CAST(0 AS BIGINT), 'embedded_pdf' FROM sl)),
m1 AS (SELECT m0.*, height, images, source, first, {rules.publisher("text")} AS pub, {rules.contents("text")} AS con, {rules.statement("text")} AS copy, {rules.key("text")} AS k, {rules.any_of(rules.low("text"), T.AFFILIATIONS)} AS place, {ROLE} AS role, {REST} AS rest, {names_sql("text")} AS names,
  regexp_matches({rules.low("text")}, '(^|[ \t\n\r\f\v])([0-9]{{1,4}}|[ivxlcdm]{{1,7}})$') AS tail FROM m0 JOIN mp USING (doc_id, page_index, revision)),
m2 AS (SELECT *, CASE WHEN role IS NOT NULL THEN {names_sql("rest")} END AS said, count(*) OVER pg AS n, lead(t) OVER lw AS nt, lag(b) OVER lw AS pb FROM m1 WINDOW pg AS (PARTITION BY doc_id, page_index, revision), lw AS (PARTITION BY doc_id, page_index, revision ORDER BY line)),
an AS (SELECT doc_id, page_index, revision, arg_max(line, (h, -line)) AS anc, max(h) AS high FROM m2 WHERE NOT pub AND NOT con AND strlen(k) >= 2 GROUP BY ALL),
m3 AS (SELECT m2.*, anc, high, h >= 0.7 * high AND NOT pub AND NOT con AS fits FROM m2 LEFT JOIN an USING (doc_id, page_index, revision)),
u1 AS (SELECT *, nt - b AS gap, greatest(-1.0, coalesce(max(nt - b) OVER (PARTITION BY doc_id, page_index, revision ORDER BY line DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1.0)) AS wide FROM m3 WHERE line < anc),
u2 AS (SELECT doc_id, page_index, revision, coalesce(max(line) FILTER (NOT fits OR gap > 1.2 * high OR (wide >= 0 AND gap > 2.5 * greatest(wide, 1.0) AND h < 0.9 * high)), 0) + 1 AS first_line FROM u1 GROUP BY ALL),
u3 AS (SELECT an.doc_id, an.page_index, an.revision, anc, high, coalesce(first_line, anc) AS first_line FROM an LEFT JOIN u2 USING (doc_id, page_index, revision)),
u4 AS (SELECT u3.*, greatest(-1.0, coalesce((SELECT max(gap) FROM u1 WHERE u1.doc_id = u3.doc_id AND u1.page_index = u3.page_index AND u1.revision = u3.revision AND line >= first_line), -1.0)) AS wide0 FROM u3),
d1 AS (SELECT m3.*, first_line, m3.t - pb AS gap, greatest(wide0, coalesce(max(m3.t - pb) OVER (PARTITION BY m3.doc_id, m3.page_index, m3.revision ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), wide0)) AS wide FROM m3 JOIN u4 ON u4.doc_id = m3.doc_id AND u4.page_index = m3.page_index AND u4.revision = m3.revision AND line > u4.anc),
d2 AS (SELECT doc_id, page_index, revision, coalesce(min(line) FILTER (NOT fits OR gap > 1.2 * high OR (wide >= 0 AND gap > 2.5 * greatest(wide, 1.0) AND h < 0.9 * high)), max(n) + 1) - 1 AS last_line FROM d1 GROUP BY ALL),
bl AS (SELECT u3.*, coalesce(last_line, anc) AS last_line FROM u3 LEFT JOIN d2 USING (doc_id, page_index, revision)),
m4 AS (SELECT m2.*, first_line, last_line, high, coalesce(line BETWEEN first_line AND last_line, false) AS inside FROM m2 LEFT JOIN bl USING (doc_id, page_index, revision)),
g1 AS (SELECT doc_id, page_index, revision, any_value(n) AS n, any_value(first) AS first, any_value(images) AS images, any_value(source) AS source, any_value(high) AS high, any_value(first_line) AS first_line, any_value(last_line) AS last_line, max(h) FILTER (NOT inside AND NOT pub) AS next_h,
  quantile_disc(h, 0.5) FILTER (NOT inside) AS middle, count(*) FILTER (copy) AS copies, count(*) FILTER (copy AND (b < height * 0.1 OR t > height * 0.9)) AS margin, min(line) FILTER (copy AND (b < height * 0.1 OR t > height * 0.9)) AS margin_line,
  count(*) FILTER (strlen(k) > 4 AND tail) AS cited, coalesce(bool_or(con AND t < height * 0.3), false) AS heading FROM m4 GROUP BY ALL),
g2 AS (SELECT *, CASE WHEN next_h > 0 THEN high / next_h WHEN high IS NOT NULL THEN 1e9 END AS prominence, copies = 1 AND margin = 1 AND n >= 15 AS runs FROM g1),
g3 AS (SELECT *, CASE WHEN runs THEN 0 ELSE copies END AS n_copyright, CASE WHEN runs THEN margin_line END AS running, coalesce(high > 0 AND (prominence >= 1.3 OR n <= 6) AND n <= 25 AND CASE WHEN middle IS NOT NULL THEN high >= 1.2 * middle ELSE high >= 16 END, false) AS prominent FROM g2),
pr AS (SELECT *, CASE WHEN heading THEN 'contents' WHEN n_copyright > 0 THEN 'copyright' WHEN cited >= 2 AND cited * 2 >= n THEN 'contents' WHEN prominent AND page_index = first AND (images > 0 OR source = 'ocr') THEN 'cover' WHEN prominent THEN 'title_page' ELSE 'other' END AS role FROM g3),
t1 AS (SELECT pr.doc_id, pr.page_index, pr.revision, pr.role, pr.source, prominence, pr.last_line, string_agg(text, ' ' ORDER BY line) AS whole, max(h) AS tall, any_value(pr.n) AS n FROM pr JOIN m4 USING (doc_id, page_index, revision) WHERE pr.role IN ('cover', 'title_page') AND inside GROUP BY ALL),
t2 AS (SELECT t1.*, instr(whole, ': ') AS colon, x.h AS xh, x.text AS xtext, coalesce(instr(whole, ': ') = 0 AND x.h >= 0.35 * tall AND x.h < 0.9 * tall AND x.t - x.pb <= 2 * tall AND NOT x.pub AND len(x.names) = 0 AND strlen(x.k) > 3, false) AS starts
  FROM t1 LEFT JOIN m4 x ON x.doc_id = t1.doc_id AND x.page_index = t1.page_index AND x.revision = t1.revision AND x.line = t1.last_line + 1),
t3 AS (SELECT t2.doc_id, t2.page_index, t2.revision, min(f.line) FILTER (abs(f.h - xh) > 0.15 * xh OR f.t - f.pb > 1.2 * xh OR f.pub OR (len(f.names) > 0 AND NOT {OPEN.replace("ptext", "f.ptext")})) AS stop FROM t2 JOIN (SELECT *, lag(text) OVER (PARTITION BY doc_id, page_index, revision ORDER BY line) AS ptext FROM m4) f ON f.doc_id = t2.doc_id AND f.page_index = t2.page_index AND f.revision = t2.revision AND f.line > t2.last_line + 1 WHERE starts GROUP BY ALL),
t4 AS (SELECT t2.*, CASE WHEN starts THEN last_line + 1 END AS sub_first, CASE WHEN starts THEN coalesce(stop - 1, n) END AS sub_last FROM t2 LEFT JOIN t3 USING (doc_id, page_index, revision)),
t5 AS (SELECT t4.doc_id, t4.page_index, t4.revision, role, source, prominence, sub_first, sub_last, CASE WHEN colon > 0 THEN substr(whole, 1, colon - 1) ELSE whole END AS title, CASE WHEN colon > 0 THEN substr(whole, colon + 2) WHEN starts THEN (SELECT string_agg(text, ' ' ORDER BY line) FROM m0 WHERE m0.doc_id = t4.doc_id AND m0.page_index = t4.page_index AND m0.revision = t4.revision AND m0.line BETWEEN sub_first AND sub_last) END AS subtitle FROM t4),
t6 AS (SELECT doc_id, {rules.key("title || ' ' || subtitle")} AS k, min({rules.key("title")}) AS head FROM t5 WHERE subtitle IS NOT NULL GROUP BY ALL),
t7 AS (SELECT t5.*, head, string_split(title, ' ') AS w FROM t5 LEFT JOIN t6 ON subtitle IS NULL AND t6.doc_id = t5.doc_id AND t6.k = {rules.key("t5.title")}),
t8 AS (SELECT *, CASE WHEN head IS NOT NULL THEN list_min(list_filter(range(1, len(w)), lambda i: {rules.key("array_to_string(list_slice(w, 1, i), ' ')")} = head)) END AS cut FROM t7),
ti AS (SELECT doc_id, page_index, revision, role, source, prominence, sub_first, sub_last, CASE WHEN cut IS NOT NULL THEN array_to_string(list_slice(w, 1, cut), ' ') ELSE title END AS title, CASE WHEN cut IS NOT NULL THEN array_to_string(list_slice(w, cut + 1, len(w)), ' ') ELSE subtitle END AS subtitle FROM t8),
r1 AS (SELECT *, {rules.key("title")} AS k, CASE role WHEN 'title_page' THEN 3 ELSE 2 END AS wt FROM ti),
r2 AS (SELECT doc_id, k, count(*) AS pages, max(wt) AS wt, max(prominence) AS top, arg_min(title, (CASE WHEN {CAPS.format("title")} THEN 1 ELSE 0 END, CASE WHEN source = 'ocr' THEN 1 ELSE 0 END, -wt, page_index, title)) AS title,
   (list(subtitle ORDER BY subtitle IS NULL, {CAPS.format("subtitle")}, page_index, subtitle))[1] AS subtitle FROM r1 WHERE k <> '' AND NOT regexp_matches(k, '^(chapter |[0-9]{{1,2}} )') GROUP BY ALL),
r3 AS (SELECT *, 100.0::DOUBLE * pages + 10 * wt + least(top, 10.0) AS score, count(*) OVER (PARTITION BY doc_id) AS rivals FROM r2),
tr AS (SELECT doc_id, CASE WHEN pages >= 2 OR (rivals = 1 AND top >= 1.5) THEN 'resolved' ELSE 'ambiguous' END AS status, title, subtitle, pages, score FROM r3 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, k) = 1),
k1 AS (SELECT m4.*, pr.role AS page_role, sub_first, sub_last, regexp_replace(replace(m4.k, ' ', ''), '[^\\x00-\\x7F]', '', 'g') AS mark FROM m4 JOIN pr USING (doc_id, page_index, revision) LEFT JOIN ti USING (doc_id, page_index, revision) WHERE pr.role IN ('cover', 'title_page')),
k2 AS (SELECT *, inside OR coalesce(line BETWEEN sub_first AND sub_last, false) AS titled, coalesce(len(said) > 0, false) AS stated, length(mark) >= 3 AND strlen(text) <= 40 AND EXISTS (SELECT 1 FROM m4 i WHERE i.doc_id = k1.doc_id AND i.page_index = k1.page_index AND i.revision = k1.revision AND i.pub AND i.line <> k1.line AND starts_with(replace(i.k, ' ', ''), mark)) AS logo FROM k1),
lk AS (SELECT doc_id, page_index, revision, page_role, line, text, t, b, h, CASE WHEN titled THEN 'title' WHEN stated THEN 'name' WHEN pub OR logo THEN 'imprint' WHEN place THEN 'affiliation' WHEN len(names) > 0 THEN 'name' ELSE 'other' END AS kind, CASE WHEN NOT titled AND stated THEN role END AS role,
   CASE WHEN NOT titled AND stated THEN said WHEN NOT titled AND NOT pub AND NOT logo AND NOT place AND len(names) > 0 THEN names END AS names FROM k2),
l1 AS (SELECT *, lag(kind) OVER w AS before, lead(kind) OVER w AS after, lag(b) OVER w AS pb, lag(h) OVER w AS ph FROM lk WINDOW w AS (PARTITION BY doc_id, page_index, revision ORDER BY line)),
l2 AS (SELECT *, kind = 'name' AS isname, coalesce(before = 'name' AND t - pb <= 1.5 * greatest(h, ph) AND least(h, ph) >= 0.8 * greatest(h, ph), false) AS joins FROM l1),
l3 AS (SELECT doc_id, page_index, revision, page_role, count(*) FILTER (isname AND NOT joins) AS blocks, min(line) FILTER (isname) AS first, max(line) FILTER (isname) AS last, coalesce(bool_or(role IS NOT NULL), false) AS stated, arg_min(coalesce(before, '-'), line) FILTER (isname) AS before, arg_max(coalesce(after, 'end'), line) FILTER (isname) AS after,
   string_agg(text, ' ' ORDER BY line) FILTER (kind = 'title') AS shown FROM l2 GROUP BY ALL),
ab AS (SELECT l3.doc_id, page_index, revision, blocks, last - first + 1 AS n_lines, before = 'title' AS after_title, after IN ('affiliation', 'imprint', 'end') AS closed,
   NOT stated AND page_role = 'title_page' AND coalesce({rules.key("tr.title")} <> '' AND starts_with({rules.key("coalesce(shown, '')")}, {rules.key("tr.title")}), false) AND blocks = 1 AND before = 'title' AND after IN ('affiliation', 'imprint', 'end') AND last - first + 1 <= 4 AS layout FROM l3 LEFT JOIN tr ON tr.doc_id = l3.doc_id AND tr.status = 'resolved' WHERE blocks > 0),
cn AS (SELECT lk.doc_id, lk.page_index, layout, role IS NOT NULL AS stated, coalesce(role, 'author') AS role, unnest(names) AS name FROM lk LEFT JOIN ab USING (doc_id, page_index, revision) WHERE kind = 'name'),
co2 AS (SELECT *, {rules.key("name")} AS key, CASE WHEN {rules.any_of(rules.low("name"), T.ORGANISATIONS)} THEN 'organization' ELSE role END AS orole FROM cn),
ct AS (SELECT doc_id, key, min(name) AS name, min(orole) AS role, count(DISTINCT page_index) AS pages, bool_or(stated OR coalesce(layout, false)) AS explicit, bool_or(stated OR coalesce(layout, false)) OR count(DISTINCT page_index) >= 2 AS accepted FROM co2 WHERE key <> '' GROUP BY ALL),
e1 AS (SELECT m0.doc_id, m0.page_index, m0.revision, line, {rules.low("text")} AS low FROM m0 JOIN pr USING (doc_id, page_index, revision) WHERE pr.role IN ('cover', 'title_page', 'copyright') AND regexp_matches({rules.low("text")}, '(^|[^a-z0-9_])edition([^a-z0-9_]|$)')),
e2 AS (SELECT *, list_filter(string_split_regex(regexp_extract(low, '(([0-9a-z]+[ ]+){{0,2}})edition([^a-z0-9_]|$)', 1), ' +'), lambda q: q <> '') AS w FROM e1),
e3 AS (SELECT *, w[-1] AS last_w, CASE WHEN len(w) > 1 THEN w[-2] END AS before_w FROM e2),
e4 AS (SELECT *, {ORD.format("before_w")} AS ob_, {ORD.format("last_w")} AS ol_ FROM e3),
ed AS (SELECT doc_id, page_index, revision, line, CAST(coalesce(ob_, ol_) AS INTEGER) AS ordinal, CASE WHEN (ob_ IS NOT NULL OR ol_ IS NULL) AND list_contains({rules.listed(T.QUALIFIERS)}, last_w) THEN last_w END AS qualifier, contains(low, 'published') AS history FROM e4),
es AS (SELECT * FROM ed WHERE ordinal IS NOT NULL OR qualifier IS NOT NULL),
eg AS (SELECT doc_id, count(*) FILTER (NOT history) AS strong, count(DISTINCT coalesce(CAST(ordinal AS VARCHAR), qualifier)) FILTER (NOT history) AS kinds, min(ordinal) FILTER (NOT history) AS o, min(qualifier) FILTER (NOT history) AS q, max(ordinal) FILTER (history) AS top, count(*) AS n FROM es GROUP BY ALL),
er AS (SELECT doc_id, CASE WHEN strong > 0 THEN CASE WHEN kinds = 1 THEN 'resolved' ELSE 'ambiguous' END WHEN top IS NOT NULL THEN 'resolved' ELSE 'unknown' END AS status, CASE WHEN strong > 0 THEN CASE WHEN kinds = 1 THEN o END ELSE top END AS edition, CASE WHEN strong > 0 AND kinds = 1 THEN q END AS qualifier, n FROM eg),
y1 AS (SELECT m2.doc_id, m2.page_index, pr.role AS prole, pr.role NOT IN ('copyright', 'title_page', 'cover') AS running, line, text, k, {rules.low("text")} AS low, list_filter(list_transform(list_filter(string_split_regex(text, '[^0-9]+'), lambda q: length(q) = 4), lambda q: CAST(q AS INTEGER)), lambda q: q BETWEEN 1450 AND 2100) AS years
  FROM m2 JOIN pr USING (doc_id, page_index, revision) WHERE pr.role IN ('copyright', 'title_page', 'cover') OR line = pr.running),
y2 AS (SELECT *, CASE WHEN contains(low, 'reprint') OR contains(low, 'printing') OR (contains(low, 'printed') AND NOT contains(low, 'published')) THEN 'printing' WHEN contains(low, 'published') OR contains(low, 'publication') THEN 'publication'
   WHEN contains(low, '©') OR contains(low, 'copyright') OR contains(low, '(c)') OR ({rules.statement("text")} AND NOT {rules.any_of(rules.low("text"), T.STATEMENTS)}) THEN 'copyright' WHEN prole IN ('title_page', 'cover') AND strlen(k) = 4 THEN 'publication' END AS kind,
   list_sort(list_distinct(list_filter(string_split({rules.key("replace(text, '©', ' ')")}, ' '), lambda q: strlen(q) >= 2 AND NOT regexp_matches(q, '^[0-9]') AND NOT list_contains({rules.listed(front.NO_HOLDER)}, q)))) AS holder,
   regexp_extract(low, '(^|[^a-z0-9_])([a-z]+|[0-9]{{1,3}}(st|nd|rd|th)) +edition([^a-z0-9_]|$)', 2) AS ew
  FROM y1 WHERE len(years) > 0 AND NOT contains(low, 'isbn') AND NOT contains(low, 'international standard book number') AND NOT regexp_matches(regexp_replace(text, '[- ‐‑–]', '', 'g'), '(^|[^0-9])97[89][0-9]{{10}}([^0-9]|$)') AND NOT {rules.law("text")}),
y3 AS (SELECT doc_id, page_index, line, kind, running, holder, CAST({ORD.format("ew")} AS INTEGER) AS edition, contains(low, 'edition') AS names_edition, contains(low, 'this edition') AS this_edition, contains(low, 'first published') AS first_published, len(years) AS n_years, unnest(years) AS year FROM y2 WHERE kind IS NOT NULL),
ys AS (SELECT * FROM y3 WHERE NOT (running AND EXISTS (SELECT 1 FROM y3 o WHERE o.doc_id = y3.doc_id AND o.kind = y3.kind AND NOT o.running))),
yc AS (SELECT doc_id, count(DISTINCT year) AS n_years, min(year) AS low, bool_or(n_years <> 1 OR names_edition OR len(holder) = 0) AS unclear FROM ys WHERE kind = 'copyright' GROUP BY ALL),
yp AS (SELECT ys.*, er.edition AS own, coalesce(ys.edition = er.edition, false) OR this_edition AS tied, coalesce(er.edition IS NOT NULL AND (coalesce(ys.edition <> er.edition, false) OR (first_published AND er.edition > 1)), false) AS other FROM ys LEFT JOIN er USING (doc_id) WHERE kind = 'publication'),
yq AS (SELECT doc_id, CASE WHEN count(*) FILTER (tied) > 0 THEN list_sort(list(DISTINCT year) FILTER (tied)) ELSE coalesce(list_sort(list(DISTINCT year) FILTER (NOT other)), []) END AS y FROM yp GROUP BY ALL),
yr AS (SELECT yc.doc_id, 'copyright' AS kind, CASE WHEN ok THEN 'resolved' ELSE 'ambiguous' END AS status, CASE WHEN ok THEN low END AS year, n_years FROM (SELECT yc.*, n_years = 1 OR (NOT unclear AND NOT coalesce(er.edition > 1, false) AND NOT EXISTS (SELECT 1 FROM ys a JOIN ys b ON a.doc_id = b.doc_id AND a.kind = 'copyright' AND b.kind = 'copyright' AND a.year < b.year WHERE a.doc_id = yc.doc_id AND 2 * len(list_intersect(a.holder, b.holder)) >= least(len(a.holder), len(b.holder)))) AS ok FROM yc LEFT JOIN er USING (doc_id)) yc
  UNION ALL SELECT doc_id, 'publication', CASE WHEN len(y) = 1 THEN 'resolved' WHEN len(y) > 1 THEN 'ambiguous' ELSE 'unknown' END, CASE WHEN len(y) = 1 THEN y[1] END, len(y) FROM yq)"""
)


def all_lines(spark: SparkSession, d: str) -> DataFrame:
    return lines(spark, d).select(*PAGE, "line", "text", "t", "b", "h").unionByName(specimen.lines(spark, d))


def all_pages(spark: SparkSession, d: str) -> DataFrame:
    real = corpus.latest(spark, d).groupBy(*PAGE).agg(F.min("height").alias("height"), F.max(F.coalesce("image_object_count", F.lit(0))).cast("long").alias("images"), F.min("source").alias("source"))
    made = specimen.lines(spark, d).select(*PAGE).distinct().select(*PAGE, F.lit(800.0).alias("height"), F.lit(0).cast("long").alias("images"), F.lit("embedded_pdf").alias("source"))
    x = real.unionByName(made)
    return x.join(x.groupBy("doc_id").agg(F.min("page_index").alias("first")), "doc_id")


def pages(spark: SparkSession, d: str) -> DataFrame:
    return front.paged(all_lines(spark, d), all_pages(spark, d))


def few(spark: SparkSession, d: str) -> DataFrame:
    """Pages with their lines, written once where several steps read them."""
    return kept(pages(spark, d))


@query(SQL_FRONT + " SELECT doc_id, page_index, revision, role, CAST(n_copyright AS BIGINT) AS n_copyright, CAST(running AS BIGINT) AS running FROM pr")
def page_roles(spark: SparkSession, d: str) -> DataFrame:
    return pages(spark, d).select(*PAGE, "role", F.col("n_copyright").cast("long").alias("n_copyright"), F.col("running").cast("long").alias("running"))


@query(SQL_FRONT + " SELECT doc_id, page_index, revision, CAST(first_line AS BIGINT) AS first_line, CAST(last_line AS BIGINT) AS last_line, round(prominence, 6) AS prominence FROM pr WHERE first_line IS NOT NULL")
def title_expand(spark: SparkSession, d: str) -> DataFrame:
    """The block of lines around each page's tallest one."""
    x = pages(spark, d).where("first_line is not null")
    return x.select(*PAGE, F.col("first_line").cast("long").alias("first_line"), F.col("last_line").cast("long").alias("last_line"), F.round("prominence", 6).alias("prominence"))


@query(SQL_FRONT + " SELECT doc_id, page_index, revision, role, title, subtitle FROM ti")
def subtitle(spark: SparkSession, d: str) -> DataFrame:
    return front.titles(few(spark, d)).select(*PAGE, "role", "title", "subtitle")


@query(SQL_FRONT + " SELECT doc_id, status, title, subtitle, pages, round(score, 4) AS score FROM tr")
def title_resolve(spark: SparkSession, d: str) -> DataFrame:
    return front.resolve_title(front.titles(few(spark, d))).withColumn("score", F.round("score", 4))


@query(SQL_FRONT + " SELECT doc_id, page_index, revision, CAST(line AS BIGINT) AS line, kind, role, array_to_string(names, '|') AS names FROM lk")
def line_kinds(spark: SparkSession, d: str) -> DataFrame:
    """Lines of covers and title pages: title, names, imprint or its mark, affiliation, other."""
    p = few(spark, d)
    return front.kinds(p, front.titles(p)).select(*PAGE, F.col("line").cast("long").alias("line"), "kind", "role", F.array_join("names", "|").alias("names"))


def authors(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    p = few(spark, d)
    t = front.titles(p)
    k = kept(front.kinds(p, t))
    return k, front.author_blocks(k, front.resolve_title(t))


@query(SQL_FRONT + " SELECT doc_id, page_index, revision, blocks, n_lines, after_title, closed, layout FROM ab")
def author_block(spark: SparkSession, d: str) -> DataFrame:
    return authors(spark, d)[1]


@query(SQL_FRONT + " SELECT doc_id, key, name, role, pages, explicit, accepted FROM ct")
def contributors_resolve(spark: SparkSession, d: str) -> DataFrame:
    return front.contributors(*authors(spark, d))


@query(SQL_FRONT + " SELECT doc_id, page_index, CAST(line AS BIGINT) AS line, ordinal, qualifier, history FROM es")
def edition_statements(spark: SparkSession, d: str) -> DataFrame:
    return front.edition_statements(few(spark, d)).select("doc_id", "page_index", F.col("line").cast("long").alias("line"), "ordinal", "qualifier", "history")


@query(SQL_FRONT + " SELECT doc_id, status, edition, qualifier, n FROM er")
def edition(spark: SparkSession, d: str) -> DataFrame:
    return front.resolve_edition(front.edition_statements(few(spark, d)))


@query(SQL_FRONT + " SELECT doc_id, page_index, CAST(line AS BIGINT) AS line, kind, year, edition, array_to_string(holder, ' ') AS holder FROM ys")
def year_statements(spark: SparkSession, d: str) -> DataFrame:
    return front.year_statements(few(spark, d)).select("doc_id", "page_index", F.col("line").cast("long").alias("line"), "kind", "year", "edition", F.array_join("holder", " ").alias("holder"))


@query(SQL_FRONT + " SELECT doc_id, kind, status, year, n_years FROM yr")
def years_resolve(spark: SparkSession, d: str) -> DataFrame:
    p = few(spark, d)
    return front.resolve_years(kept(front.year_statements(p)), front.resolve_edition(front.edition_statements(p)))


@query(
    f"""WITH {specimen.SQL_LINES.lstrip()}
SELECT doc_id, '978' || nine || c13 AS isbn13, 1 AS n, 'isbn13' AS form, CASE n % 4 WHEN 0 THEN 'hardcover' WHEN 1 THEN 'print' ELSE 'paperback' END AS format, CASE n % 4 WHEN 0 THEN 'hardback : alk. paper' WHEN 1 THEN 'Print ISBN' ELSE 'pbk' END AS label, -1 AS first_page FROM sg WHERE n % 4 IN (0, 3)
UNION ALL SELECT doc_id, '978' || nine || c13, 2, 'isbn13', 'print', 'Print ISBN', -1 FROM sg WHERE n % 4 = 1"""
)
def isbn_list(spark: SparkSession, d: str) -> DataFrame:
    """The valid book numbers of page lines; of those set on copyright pages one in four has a wrong check digit."""
    found = front.merged_isbns(front.isbns(few(spark, d)))
    return found.select("doc_id", "isbn13", F.col("n").cast("int").alias("n"), "form", "format", "label", "first_page")


@query(f"SELECT DISTINCT doc_id, page_index, revision, line_no, {rules.statement('text')} AS copyright, {rules.law('text')} AS law, {rules.publisher('text')} AS publisher, array_to_string(list_filter(list_transform(list_filter(string_split_regex(text, '[^0-9]+'), lambda y: length(y) = 4), lambda y: CAST(y AS INTEGER)), lambda y: y BETWEEN 1450 AND 2100), ',') AS years FROM text_line WHERE text IS NOT NULL")
def copyright_lines(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    return read(spark, d, "text_line").where("text is not null").select("doc_id", "page_index", "revision", "line_no", T.copyright_line(t).alias("copyright"), T.cites_law(t).alias("law"), T.publisher_line(t).alias("publisher"), F.array_join(F.transform(T.years(t), lambda y: y.cast("string")), ",").alias("years")).distinct()


@query(f"SELECT DISTINCT contributor_id, {ROLE.replace('text', 'name')} AS role_phrase, len({ITEMS.format(rules.plain('name'))}) AS n_names, len({names_sql('name')}) AS n_like, {rules.any_of(rules.low('name'), T.ORGANISATIONS)} AS organization, {rules.any_of(rules.low('name'), T.AFFILIATIONS)} AS affiliation FROM contributor WHERE name IS NOT NULL")
def contributor_parts(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("name")
    v = F.concat(F.lit(" "), T.squeeze(F.replace(n, F.lit("\xa0"), F.lit(" "))), F.lit(" "))
    items = F.filter(F.transform(F.split(F.regexp_replace(v, "(?i) and | & |;", ","), ","), T.squeeze), lambda p: p != "")
    low = T.lower_ascii(n)
    return read(spark, d, "contributor").where("name is not null").select("contributor_id", T.role_phrase(n)[0].alias("role_phrase"), F.size(items).cast("long").alias("n_names"), F.size(T.names_in(n)).cast("long").alias("n_like"), T.has_any(low, T.ORGANISATIONS).alias("organization"), T.has_any(low, T.AFFILIATIONS).alias("affiliation")).distinct()
