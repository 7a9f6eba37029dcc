"""Title pages and copyright pages: roles, title blocks, subtitles, names, editions, years and book numbers."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bindery.functions import text as T
from bindery.sources.corpus import PAGE

BLOCK_RATIO, PROMINENCE = 0.7, 1.5


def marked(lines: DataFrame) -> DataFrame:
    """Lines with what is asked of their text, each question once, as part of the scan."""
    t = F.col("text")
    role, rest = T.role_phrase(t)
    x = lines.withColumn("text", T.squeeze(t)).withColumn("pub", T.publisher_line(t)).withColumn("con", T.contents_line(t)).withColumn("copy", T.copyright_line(t)).withColumn("k", T.key(t))
    x = x.withColumn("role", role).withColumn("said", F.when(F.col("role").isNotNull(), T.names_in(rest))).withColumn("names", T.names_in(t))
    tail = T.lower_ascii(t).rlike(r"(?:^|[ \t\n\r\f\x0B])(?:[0-9]{1,4}|[ivxlcdm]{1,7})$")
    return x.withColumn("cited", (F.octet_length("k") > 4) & tail).withColumn("place", T.has_any(T.lower_ascii(t), T.AFFILIATIONS))


def paged(lines: DataFrame, pages: DataFrame) -> DataFrame:
    """A row for each page with its lines in order (``ls``), title block, prominence and role.

    ``lines`` has ``page, line, text, t, b, h`` with lines from 1, ``pages``
    ``page, height, images, source`` and ``first`` (the book's first page). All
    rules are folds over a page's lines, so lines are grouped once.
    """
    cols = ["line", "text", "t", "b", "h", "pub", "con", "copy", "k", "role", "said", "names", "cited", "place"]
    g = marked(lines).groupBy(*PAGE).agg(F.array_sort(F.collect_list(F.struct(*cols))).alias("ls")).join(pages, PAGE)
    best = "array_max(transform(filter(ls, x -> not x.pub and not x.con and octet_length(x.k) >= 2), x -> struct(x.h as h, -x.line as line)))"
    g = g.withColumn("best", F.expr(best)).withColumn("at", -F.col("best.line")).withColumn("high", F.col("best.h"))
    fits = f"x.h >= {BLOCK_RATIO}D * high and not x.pub and not x.con"
    apart = "(s.wide >= 0 and gap > 2.5D * greatest(s.wide, 1.0D) and x.h < 0.9D * high)"
    # at the top the gap lies below the line that is looked at, at the bottom above it
    step = lambda gap, edge: f"if(s.open and {fits} and not ({gap} > 1.2D * high) and not {apart.replace('gap', gap)}, named_struct('edge', x.line, 'wide', greatest(s.wide, {gap}), 'open', true), named_struct('edge', s.edge, 'wide', s.wide, 'open', false))"
    up = f"aggregate(reverse(slice(ls, 1, at - 1)), named_struct('edge', at, 'wide', -1.0D, 'open', true), (s, x) -> {step('(element_at(ls, x.line + 1).t - x.b)', 0)})"
    down = f"aggregate(slice(ls, at + 1, size(ls)), named_struct('edge', at, 'wide', up.wide, 'open', true), (s, x) -> {step('(x.t - element_at(ls, x.line - 1).b)', 0)})"
    g = g.withColumn("up", F.when(F.col("at").isNotNull(), F.expr(up))).withColumn("down", F.when(F.col("at").isNotNull(), F.expr(down)))
    g = g.withColumn("first_line", F.col("up.edge")).withColumn("last_line", F.col("down.edge"))
    g = g.withColumn("inside", F.expr("filter(ls, x -> x.line between first_line and last_line)")).withColumn("outside", F.expr("filter(ls, x -> not coalesce(x.line between first_line and last_line, false))"))
    next_ = F.expr("array_max(transform(filter(outside, x -> not x.pub), x -> x.h))")
    g = g.withColumn("prominence", F.when(next_ > 0, F.col("high") / next_).when(F.col("high").isNotNull(), 1e9))
    n = F.size("ls")
    copies = F.expr("size(filter(ls, x -> x.copy))")
    margin = F.expr("filter(ls, x -> x.copy and (x.b < height * 0.1D or x.t > height * 0.9D))")
    running = (copies == 1) & (F.size(margin) == 1) & (n >= 15)
    g = g.withColumn("running", F.when(running, margin[0]["line"])).withColumn("n_copyright", F.when(running, 0).otherwise(copies))
    cited = F.expr("size(filter(ls, x -> x.cited))")
    middle = F.when(F.size("outside") > 0, F.sort_array(F.transform("outside", lambda x: x["h"]))[((F.size("outside") - 1) / 2).cast("int")])
    stands = F.when(middle.isNotNull(), F.col("high") >= 1.2 * middle).otherwise(F.col("high") >= 16)
    prominent = F.coalesce((F.col("high") > 0) & ((F.col("prominence") >= 1.3) | (n <= 6)) & (n <= 25) & stands, F.lit(False))
    heading = F.expr("exists(ls, x -> x.con and x.t < height * 0.3D)")
    role = F.when(heading, "contents").when(F.col("n_copyright") > 0, "copyright").when((cited >= 2) & (cited * 2 >= n), "contents")
    role = role.when(prominent & (F.col("page_index") == F.col("first")) & ((F.col("images") > 0) | (F.col("source") == "ocr")), "cover").when(prominent, "title_page").otherwise("other")
    return g.withColumn("role", role).select(*PAGE, "ls", "source", "role", "n_copyright", "running", "first_line", "last_line", "prominence", "inside", "high")


def titles(pages: DataFrame) -> DataFrame:
    """``page, role, source, title, subtitle, prominence, sub_first, sub_last``: titles of covers and title pages.

    The subtitle stands behind a colon, or below the title in smaller lines of
    one style that are no names and no publisher's. A title that ran on into
    its subtitle is split as on a page of the same book that sets it apart.
    """
    x = pages.where("role in ('cover', 'title_page')").withColumn("whole", T.squeeze(F.array_join(F.transform("inside", lambda l: l["text"]), " ")))
    colon = F.instr("whole", ": ")
    tall = F.expr("array_max(transform(inside, x -> x.h))")
    x = x.withColumn("colon", colon).withColumn("tall", tall).withColumn("below", F.try_element_at("ls", F.col("last_line") + 1))
    starts = "colon = 0 and below is not null and below.h >= 0.35D * tall and below.h < 0.9D * tall and below.t - element_at(ls, last_line).b <= 2 * tall and not below.pub and size(below.names) = 0 and octet_length(below.k) > 3"
    x = x.withColumn("starts", F.coalesce(F.expr(starts), F.lit(False)))
    ends = T.ends_open(F.col("x.text"))  # noqa: F841
    follow = """
        aggregate(slice(ls, last_line + 2, size(ls)), named_struct('edge', last_line + 1, 'open', true), (s, x) ->
          if(s.open and not (abs(x.h - below.h) > 0.15D * below.h) and not (x.t - element_at(ls, x.line - 1).b > 1.2D * below.h) and not x.pub and not (size(x.names) > 0 and not element_at(opens, x.line - 1)),
             named_struct('edge', x.line, 'open', true), named_struct('edge', s.edge, 'open', false)))"""
    x = x.withColumn("opens", F.transform("ls", lambda l: T.ends_open(l["text"])))
    x = x.withColumn("sub_first", F.when(F.col("starts"), F.col("last_line") + 1)).withColumn("sub_last", F.when(F.col("starts"), F.expr(follow)["edge"]))
    sub = F.when(F.col("colon") > 0, F.expr("substring(whole, colon + 2)")).when(F.col("starts"), F.array_join(F.transform(F.expr("filter(ls, x -> x.line between sub_first and sub_last)"), lambda l: l["text"]), " "))
    x = x.select(*PAGE, "role", "source", F.when(F.col("colon") > 0, F.expr("substring(whole, 1, colon - 1)")).otherwise(F.col("whole")).alias("title"), sub.alias("subtitle"), "prominence", "sub_first", "sub_last")
    return _split_alike(x)


def _split_alike(x: DataFrame) -> DataFrame:
    told = x.where("subtitle is not null").select("doc_id", T.key(F.concat_ws(" ", "title", "subtitle")).alias("key"), T.key(F.col("title")).alias("head")).groupBy("doc_id", "key").agg(F.min("head").alias("head"))
    x = x.withColumn("key", F.when(F.col("subtitle").isNull(), T.key(F.col("title")))).join(told, ["doc_id", "key"], "left")
    words = F.split("title", " ")
    cuts = F.filter(F.sequence(F.lit(1), F.size(words)), lambda n: T.key(F.array_join(F.slice(words, F.lit(1), n), " ")) == F.col("head"))
    x = x.withColumn("cut", F.when(F.col("head").isNotNull() & (F.size(words) > 1), F.array_min(cuts)))
    split = F.col("cut").isNotNull() & (F.col("cut") < F.size(words))
    title = F.when(split, F.array_join(F.slice(words, F.lit(1), F.col("cut")), " ")).otherwise(F.col("title"))
    sub = F.when(split, F.array_join(F.slice(words, F.col("cut") + 1, F.size(words)), " ")).otherwise(F.col("subtitle"))
    return x.select(*PAGE, "role", "source", title.alias("title"), sub.alias("subtitle"), "prominence", "sub_first", "sub_last")


def resolve_title(titles_: DataFrame) -> DataFrame:
    """``doc_id, status, title, subtitle, pages, score``: agreed on two pages or more, or alone and clearly prominent.

    Score: a hundred for each page, ten for each step of the best role, up to
    ten for prominence. The value comes from native text before recognised and
    from title pages before covers, in mixed case if any page has it.
    """
    x = titles_.withColumn("k", T.key(F.col("title"))).where("k <> '' and not k rlike '^(chapter |[0-9]{1,2} )'")
    weight = F.when(F.col("role") == "title_page", 3).otherwise(2)
    caps = lambda c: ~F.col(c).rlike("[a-z]")
    order = F.struct(caps("title").alias("caps"), (F.col("source") == "ocr").alias("ocr"), (-weight).alias("w"), "page_index", "title")
    sub = F.min_by("subtitle", F.struct(F.col("subtitle").isNull().alias("none"), caps("subtitle").alias("caps"), F.col("page_index").alias("p"), F.col("subtitle").alias("s")))
    g = x.groupBy("doc_id", "k").agg(F.count("*").alias("pages"), F.max(weight).alias("w"), F.max(F.least("prominence", F.lit(10.0))).alias("prom"), F.max("prominence").alias("top"), F.min_by("title", order).alias("title"), sub.alias("subtitle"))
    g = g.withColumn("score", 100.0 * F.col("pages") + 10 * F.col("w") + F.col("prom"))
    w = Window.partitionBy("doc_id").orderBy(F.desc("score"), "k")
    g = g.withColumn("rn", F.row_number().over(w)).withColumn("rivals", F.count("*").over(Window.partitionBy("doc_id"))).where("rn = 1")
    done = (F.col("pages") >= 2) | ((F.col("rivals") == 1) & (F.col("top") >= PROMINENCE))
    return g.select("doc_id", F.when(done, "resolved").otherwise("ambiguous").alias("status"), "title", "subtitle", "pages", "score")


def kinds(pages: DataFrame, titles_: DataFrame) -> DataFrame:
    """``page, line, kind, role, names``: lines of covers and title pages as title, name, imprint, affiliation or other."""
    x = pages.where("role in ('cover', 'title_page')").join(titles_.select(*PAGE, "sub_first", "sub_last"), PAGE, "left")
    imprints = F.transform(F.filter("ls", lambda l: l["pub"]), lambda l: F.struct(l["line"].alias("line"), F.replace(l["k"], F.lit(" "), F.lit("")).alias("c")))
    x = x.withColumn("imprints", imprints).select(*PAGE, F.col("role").alias("page_role"), "first_line", "last_line", "sub_first", "sub_last", "imprints", F.explode("ls").alias("x"))
    mark = F.regexp_replace(F.replace(F.col("x.k"), F.lit(" "), F.lit("")), r"[^\x00-\x7F]", "")
    logo = (F.length(mark) >= 3) & (F.octet_length("x.text") <= 40) & F.exists("imprints", lambda i: (i["line"] != F.col("x.line")) & F.startswith(i["c"], mark))
    title = F.col("x.line").between(F.col("first_line"), F.col("last_line")) | F.coalesce(F.col("x.line").between(F.col("sub_first"), F.col("sub_last")), F.lit(False))
    said = F.coalesce(F.size("x.said") > 0, F.lit(False))
    kind = F.when(title, "title").when(said, "name").when(F.col("x.pub") | logo, "imprint").when(F.col("x.place"), "affiliation").when(F.size("x.names") > 0, "name").otherwise("other")
    role = F.when(~title & said, F.col("x.role"))
    names = F.when(~title & said, F.col("x.said")).when(kind == "name", F.col("x.names"))
    return x.select(*PAGE, "page_role", F.col("x.line").alias("line"), F.col("x.text").alias("text"), F.col("x.t").alias("t"), F.col("x.b").alias("b"), F.col("x.h").alias("h"), kind.alias("kind"), role.alias("role"), names.alias("names"))


def author_blocks(kinds_: DataFrame, title: DataFrame) -> DataFrame:
    """``page, blocks, n_lines, after_title, closed, layout``: whether the name lines of a page are its one author block.

    One block of up to four close lines of like size, right below the title,
    closed by an affiliation, the imprint or the end, on a title page that
    shows the book's title and states no responsibility.
    """
    w = Window.partitionBy(*PAGE).orderBy("line")
    x = kinds_.withColumn("before", F.lag("kind").over(w)).withColumn("after", F.lead("kind").over(w)).withColumn("pb", F.lag("b").over(w)).withColumn("ph", F.lag("h").over(w))
    tall = F.greatest("h", "ph")
    joins = F.coalesce((F.col("before") == "name") & (F.col("t") - F.col("pb") <= 1.5 * tall) & (F.least("h", "ph") >= 0.8 * tall), F.lit(False))
    name = F.col("kind") == "name"
    shown = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == "title", F.struct("line", "text")))), lambda e: e["text"]), " ")
    g = x.groupBy(*PAGE, "page_role").agg(
        F.count_if(name & ~joins).alias("blocks"), F.min(F.when(name, F.col("line"))).alias("first"), F.max(F.when(name, F.col("line"))).alias("last"), F.bool_or(F.col("role").isNotNull()).alias("stated"),
        F.min_by("before", F.when(name, F.col("line"))).alias("before"), F.max_by(F.coalesce("after", F.lit("end")), F.when(name, F.col("line"))).alias("after"), shown.alias("shown"),
    ).where("blocks > 0")
    g = g.join(title.where("status = 'resolved'").select("doc_id", T.key(F.col("title")).alias("k")), "doc_id", "left")
    n = F.col("last") - F.col("first") + 1
    after_title, closed = F.coalesce(F.col("before") == "title", F.lit(False)), F.col("after").isin("affiliation", "imprint", "end")
    shows = F.coalesce((F.col("k") != "") & F.startswith(T.key(F.col("shown")), F.col("k")), F.lit(False))
    layout = ~F.col("stated") & (F.col("page_role") == "title_page") & shows & (F.col("blocks") == 1) & after_title & closed & (n <= 4)
    return g.select(*PAGE, "blocks", n.cast("long").alias("n_lines"), after_title.alias("after_title"), closed.alias("closed"), layout.alias("layout"))


def contributors(kinds_: DataFrame, blocks: DataFrame) -> DataFrame:
    """``doc_id, key, name, role, pages, explicit, accepted``: names on two pages, in a statement or in an author block."""
    x = kinds_.where("kind = 'name'").join(blocks.select(*PAGE, "layout"), PAGE, "left").withColumn("stated", F.col("role").isNotNull())
    x = x.select("doc_id", "page_index", "line", "layout", "stated", F.coalesce("role", F.lit("author")).alias("role"), F.explode("names").alias("name")).withColumn("key", T.key(F.col("name"))).where("key <> ''")
    role = F.when(T.has_any(T.lower_ascii(F.col("name")), T.ORGANISATIONS), "organization").otherwise(F.col("role"))
    g = x.withColumn("role", role).groupBy("doc_id", "key").agg(F.min("name").alias("name"), F.min("role").alias("role"), F.countDistinct("page_index").alias("pages"), F.bool_or(F.col("stated") | F.coalesce("layout", F.lit(False))).alias("explicit"))
    return g.withColumn("accepted", F.col("explicit") | (F.col("pages") >= 2))


def edition_statements(pages: DataFrame) -> DataFrame:
    """``page, line, ordinal, qualifier, history, low``: statements of an edition on covers, title and copyright pages."""
    x = pages.where("role in ('cover', 'title_page', 'copyright')").select(*PAGE, F.explode("ls").alias("x")).select(*PAGE, "x.line", T.lower_ascii(F.col("x.text")).alias("low"))
    words = F.split(F.regexp_extract("low", r"((?:[0-9a-z]+[ ]+){0,2})edition(?:[^a-z0-9_]|$)", 1), " +")
    words = F.filter(words, lambda w: w != "")
    n = F.size(words)
    last, before = F.try_element_at(words, F.lit(-1)), F.when(n > 1, F.element_at(words, -2))
    value = F.coalesce(ordinal(before), ordinal(last))
    named = F.when(ordinal(before).isNotNull(), last).when(ordinal(last).isNull(), last)
    x = x.where(F.col("low").rlike(r"(?:^|[^a-z0-9_])edition(?:[^a-z0-9_]|$)")).select(*PAGE, "line", value.alias("ordinal"), F.when(named.isin(T.QUALIFIERS), named).alias("qualifier"), F.contains("low", F.lit("published")).alias("history"))
    return x.where("ordinal is not null or qualifier is not null")


def ordinal(word: Column) -> Column:
    """Value of an ordinal word up to twelfth or of 1st to 999th, else null."""
    at = F.array_position(F.array(*map(F.lit, T.ORDINALS)), word)
    number = F.regexp_extract(word, "^([0-9]{1,3})(?:st|nd|rd|th)$", 1)
    return F.when(at > 0, at.cast("int")).when(number != "", number.cast("int"))


def resolve_edition(statements: DataFrame) -> DataFrame:
    """``doc_id, status, edition, qualifier, n``: statements that agree; without any the latest of the history; else ambiguous."""
    same = F.coalesce(F.col("ordinal").cast("string"), F.col("qualifier"))
    g = statements.groupBy("doc_id").agg(F.count_if(~F.col("history")).alias("strong"), F.countDistinct(F.when(~F.col("history"), same)).alias("kinds"), F.min(F.when(~F.col("history"), F.col("ordinal"))).alias("o"), F.min(F.when(~F.col("history"), F.col("qualifier"))).alias("q"), F.max(F.when(F.col("history"), F.col("ordinal"))).alias("top"), F.count("*").alias("n"))
    has = F.col("strong") > 0
    status = F.when(has & (F.col("kinds") == 1), "resolved").when(has, "ambiguous").when(F.col("top").isNotNull(), "resolved").otherwise("unknown")
    one = has & (F.col("kinds") == 1)
    return g.select("doc_id", status.alias("status"), F.when(one, F.col("o")).when(~has, F.col("top")).alias("edition"), F.when(one, F.col("q")).alias("qualifier"), "n")


# Words of a copyright statement that don't tell its holder.
NO_HOLDER = ["copyright", "c", "o", "by", "all", "rights", "reserved", "inc", "ltd", "llc", "co", "corp", "gmbh", "kgaa", "ag", "sa", "plc", "the", "and", "of", "as", "publishing", "published", "publisher", "publishers"]


def year_statements(pages: DataFrame) -> DataFrame:
    """``doc_id, page_index, line, kind, year, n_years, running, holder, edition``: years of copyright, publication and printing.

    On copyright and title pages and covers, and on other pages in the one
    statement that runs in their margin. Lines that hold book numbers or name a
    law have no years.
    """
    x = pages.withColumn("side", F.when(F.col("role").isin("copyright", "title_page", "cover"), F.lit(False)).when(F.col("running").isNotNull(), F.lit(True))).where("side is not null")
    x = x.select("doc_id", "page_index", "role", "side", "running", F.explode("ls").alias("x")).where("not side or x.line = running").select("doc_id", "page_index", "role", F.col("side").alias("running"), "x.line", "x.text", "x.k")
    low = T.lower_ascii(F.col("text"))
    x = x.withColumn("low", low).withColumn("years", T.years(F.col("text"))).where(F.size("years") > 0)
    x = x.where(~F.contains("low", F.lit("isbn")) & ~F.contains("low", F.lit("international standard book number")) & ~isbn13_shape(F.col("text")) & ~T.cites_law(F.col("text")))
    has = lambda w: F.contains("low", F.lit(w))
    kind = F.when(has("reprint") | has("printing") | (has("printed") & ~has("published")), "printing").when(has("published") | has("publication"), "publication")
    kind = kind.when(has("©") | has("copyright") | has("(c)") | T.misread_sign(F.col("low")), "copyright").when(F.col("role").isin("title_page", "cover") & (F.octet_length("k") == 4), "publication")
    words = F.filter(F.split(T.key(F.regexp_replace("text", "©", " ")), " "), lambda w: (F.octet_length(w) >= 2) & ~w.rlike("^[0-9]") & ~w.isin(NO_HOLDER))
    edition = ordinal(F.regexp_extract("low", r"(?:^|[^a-z0-9_])([a-z]+|[0-9]{1,3}(?:st|nd|rd|th)) +edition(?:[^a-z0-9_]|$)", 1))
    x = x.withColumn("kind", kind).where("kind is not null")
    x = x.select("doc_id", "page_index", "line", "kind", "running", F.array_sort(F.array_distinct(words)).alias("holder"), edition.alias("edition"), has("edition").alias("names_edition"), has("this edition").alias("this_edition"), has("first published").alias("first_published"), F.size("years").alias("n_years"), F.explode("years").alias("year"))
    # a statement that runs in margins counts only for a kind of year that no page of its own states
    own = x.groupBy("doc_id", "kind").agg(F.bool_or(~F.col("running")).alias("own"))
    return x.join(own, ["doc_id", "kind"]).where("not (running and own)").drop("own")


def isbn13_shape(x: Column) -> Column:
    return F.regexp_replace(x, "[- ‐‑–]", "").rlike("(?:^|[^0-9])97[89][0-9]{10}(?:[^0-9]|$)")


def resolve_years(statements: DataFrame, editions: DataFrame) -> DataFrame:
    """``doc_id, kind, status, year, n_years``: copyright and publication.

    One copyright year resolves; of several the earliest does if each statement
    has one year and those of different years name holders that share fewer
    than half of the smaller one's words. Publication statements of the book's
    edition, or of "this edition", go before others; those of another are left out.
    """
    c = statements.where("kind = 'copyright'")
    several = c.groupBy("doc_id").agg(F.count_distinct("year").alias("n_years"), F.min("year").alias("low"), F.bool_or((F.col("n_years") != 1) | F.col("names_edition") | (F.size("holder") == 0)).alias("unclear"))
    h = c.select("doc_id", "year", "holder").distinct()
    pair = h.join(h.select("doc_id", F.col("year").alias("y2"), F.col("holder").alias("h2")), "doc_id").where("year < y2")
    shared = pair.where(2 * F.size(F.array_intersect("holder", "h2")) >= F.least(F.size("holder"), F.size("h2"))).select("doc_id", F.lit(True).alias("shared")).distinct()
    x = several.join(shared, "doc_id", "left").join(editions.select("doc_id", "edition"), "doc_id", "left")
    separate = ~F.col("unclear") & F.col("shared").isNull() & ~F.coalesce(F.col("edition") > 1, F.lit(False))
    done = (F.col("n_years") == 1) | separate
    out = x.select("doc_id", F.lit("copyright").alias("kind"), F.when(done, "resolved").otherwise("ambiguous").alias("status"), F.when(done, F.col("low")).alias("year"), "n_years")
    p = statements.where("kind = 'publication'").join(editions.select("doc_id", F.col("edition").alias("own")), "doc_id", "left")
    tied = F.coalesce(F.col("edition") == F.col("own"), F.lit(False)) | F.col("this_edition")
    other = F.col("own").isNotNull() & (F.coalesce(F.col("edition") != F.col("own"), F.lit(False)) | (F.col("first_published") & (F.col("own") > 1)))
    g = p.withColumn("tied", tied).withColumn("other", other).groupBy("doc_id").agg(F.array_sort(F.collect_set(F.when(F.col("tied"), F.col("year")))).alias("a"), F.array_sort(F.collect_set(F.when(~F.col("other"), F.col("year")))).alias("b"))
    g = g.withColumn("y", F.when(F.size("a") > 0, F.col("a")).otherwise(F.col("b")))
    n = F.size("y").cast("long")
    return out.unionByName(g.select("doc_id", F.lit("publication").alias("kind"), F.when(n == 1, "resolved").when(n > 1, "ambiguous").otherwise("unknown").alias("status"), F.when(n == 1, F.col("y")[0]).alias("year"), n.alias("n_years")))


# Words that tell a book number's format.
FORMATS = {
    "electronic": {"ebook", "ebk", "eisbn", "epub", "epdf", "pdf", "electronic", "online", "digital", "kindle", "mobi"},
    "hardcover": {"hardback", "hardcover", "hardbound", "hbk", "hb", "hc", "cloth", "casebound"},
    "paperback": {"paperback", "softcover", "softback", "pbk", "pb"},
    "print": {"print"},
}
JOINED = {("e", "book"): "ebook", ("e", "isbn"): "eisbn", ("e", "pub"): "epub", ("hard", "cover"): "hardcover", ("hard", "back"): "hardback", ("soft", "cover"): "softcover", ("soft", "back"): "softback"}
DASHES = str.maketrans({**dict.fromkeys("‐‑‒–—−", "-"), **dict.fromkeys("    ", " ")})
NUMBER = re.compile(r"(?<![0-9])(?:[0-9](?:[- ]{0,2}[0-9]){12}(?![0-9])|[0-9](?:[- ]{0,2}[0-9]){8}[- ]{0,2}(?:[0-9](?![0-9])|[Xx](?![0-9A-Za-z])))")
TEN = re.compile(r"[0-9](?:[- ]{0,2}[0-9]){8}[- ]{0,2}(?:[0-9](?![0-9])|[Xx](?![0-9A-Za-z]))")


def check13(d: str) -> str:
    return str(-sum(int(c) * (3 if i % 2 else 1) for i, c in enumerate(d[:12])) % 10)


def as_isbn13(number: str) -> str | None:
    """A printed number's thirteen digits, null if its check digit is wrong."""
    d = re.sub("[- ]", "", number).upper()
    if len(d) == 13:
        return d if d[:3] in ("978", "979") and check13(d) == d[12] else None
    total = sum((10 - i) * (10 if c == "X" else int(c)) for i, c in enumerate(d))
    return f"978{d[:9]}{check13('978' + d[:9])}" if total % 11 == 0 else None


def format_of(text: str) -> str | None:
    words = re.findall(r"[a-z0-9\x80-\U0010ffff]+", text.lower())
    words += [JOINED[p] for p in zip(words, words[1:]) if p in JOINED]
    return next((name for name, known in FORMATS.items() if known & set(words)), None)


def isbns_of(lines: list[str]) -> list[tuple[int, int, str, str, str | None, str | None]]:
    """Line, place in it, ISBN-13, form, format and label of the valid numbers of a page.

    Lines that name an ISBN, and those directly below, where only numbers of
    thirteen digits count. A number of thirteen digits that fails is passed
    over whole. The label stands in brackets or as one word behind a number, or
    else before it, after the number before.
    """
    out, going = [], False
    for n, raw in enumerate(lines, 1):
        text = raw.translate(DASHES)
        named = re.search("isbn|international standard book number", text, re.I) is not None
        found, at = [], 0
        while named or going:
            m = NUMBER.search(text, at)
            if m is None:
                break
            value = as_isbn13(m[0])
            digits = len(re.sub("[- ]", "", m[0]))
            if value is None and digits == 13 and re.sub("[- ]", "", m[0])[:3] not in ("978", "979"):
                m10 = TEN.match(text, m.start())
                m, value, digits = (m10, as_isbn13(m10[0]), 10) if m10 and as_isbn13(m10[0]) else (m, None, 13)
            at = m.end()
            if value and (named or digits == 13):
                found.append((m.start(), m.end(), value, "isbn13" if digits == 13 else "isbn10"))
        going = named or bool(found)
        done = 0
        for i, (start, end, value, form) in enumerate(found):
            limit = found[i + 1][0] if i + 1 < len(found) else len(text)
            before, label, kind = text[done:start], None, None
            inside = re.compile(r" *\(([^)]*)\)").match(text, end)
            done = end
            if inside and inside.end() <= limit:
                label, kind, done = inside[1].strip(" ,;:") or None, format_of(inside[1]), inside.end()
            else:
                word = re.compile(r" *([A-Za-z0-9-]*)").match(text, end)
                ahead = re.search("isbn", text[word.start() : limit], re.I) and format_of(before)
                if format_of(word[1]) and not ahead:
                    label, kind, done = word[1], format_of(word[1]), word.end()
            near = re.search(r"((?:[A-Za-z0-9]+[^A-Za-z0-9),;.]+){0,2})(?:e-?)?isbn.*$", before, re.I)
            prefix = near[0] if near else before if len(before) <= 32 else ""
            if format_of(prefix):
                kind, label = kind or format_of(prefix), label or prefix.strip(" ,;:")
            out.append((n, start, value, form, kind, label))
    return out


def isbns(pages: DataFrame) -> DataFrame:
    """``page, line, place, isbn13, form, format, label`` of every page's valid numbers."""
    fields = ", ".join(f"{c} {pages.schema[c].dataType.simpleString()}" for c in PAGE)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(d, p, r, *x) for d, p, r, texts in zip(*[b[c] for c in PAGE], b["texts"]) for x in isbns_of(list(texts))]
            yield pd.DataFrame(rows, columns=[*PAGE, "line", "place", "isbn13", "form", "format", "label"])

    x = pages.select(*PAGE, F.transform("ls", lambda l: l["text"]).alias("texts")).where(F.exists("texts", lambda t: T.lower_ascii(t).rlike("isbn|international standard book number")))
    return x.mapInPandas(run, f"{fields}, line int, place int, isbn13 string, form string, format string, label string")


def merged_isbns(found: DataFrame) -> DataFrame:
    """``doc_id, isbn13, n, form, format, label, first_page``: numbers of a book merged; the first known format and label count."""
    at = F.struct("page_index", "revision", "line", "place")
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), at))
    return found.groupBy("doc_id", "isbn13").agg(F.count("*").alias("n"), F.min_by("form", at).alias("form"), first("format").alias("format"), first("label").alias("label"), F.min("page_index").alias("first_page"))
