"""Single rules with their counterexamples."""

from pyspark.sql import functions as F

from bindery.functions import text as T
from bindery.operators import assemble, detect, frontmatter, mapping, parse, plan, sections

KEY = {"doc_id": "d", "page_index": 4, "revision": 5}
FRAGMENT = "doc_id string, page_index int, revision bigint, region_id int, piece int, text string, l double, r double, t double, b double, width double, height double"


def frag(spark, rows):
    """Rows of id, text, left, right, top, bottom on one page of 600 x 800."""
    return spark.createDataFrame([("d", 4, 5, i, 0, x, float(a), float(b), float(t), float(u), 600.0, 800.0) for i, x, a, b, t, u in rows], FRAGMENT)


def one(spark, expr, *values):
    df = spark.createDataFrame([(v,) for v in values], "x string")
    return [r[0] for r in df.select(expr(F.col("x"))).collect()]


def test_roman_numbers(spark):
    assert one(spark, T.roman_value, "iv", "IIII", "VX", "MCMXCIV", "mix", "", None, "abc") == [4, None, None, 1994, 1009, None, None, None]
    n = spark.range(1, 4000).select("id", T.roman_value(T.to_roman(F.col("id"))).alias("back"))
    assert n.where("id <> back or back is null").count() == 0


def test_keys_and_titles(spark):
    assert one(spark, T.key, "  Ünï-code:  The  WAY ", "...") == ["Ünï code the way", ""]
    assert one(spark, T.clean_title, "Alpha ................ ", "Release 7.1 ", "Beta . . . .", "a.b") == ["Alpha", "Release 7.1", "Beta", "a.b"]
    assert one(spark, T.section_number, "2.1 Next", "A.2.1 More", "12 Not", "3. No") == ["2.1", "A.2.1", "", ""]
    assert one(spark, T.ends_with_label, "See Chapter", "Slow lanterns", "Fig.") == [True, False, True]
    assert one(spark, T.ends_open, "The way of", "Parts:", "Done", "") == [True, True, False, False]
    assert one(spark, T.inline_token, "First chapter ........ 12", "12", "ab 12-3", "Alpha.xiv", "X 99999") == ["12", None, None, "xiv", None]


def test_years_and_laws(spark):
    assert one(spark, T.years, "© 1987, 1999 by 54321 x 1449", "") == [[1987, 1999], []]
    assert one(spark, T.copyright_line, "o 1871 by the heirs", "c1902, Holder", "(c) 1999 Holder", "07431 Harbour Town", "0 1600 1700", "c 1350 nobody", "0 1871") == [True, True, True, False, False, False, False]
    assert one(spark, T.cites_law, "under the Lighthouse (Rights) Act 1934", "Ferries Act of 1871.", "the Patent\tAct", "© 1999 ACT House", "an act in 1871", "fact 1871") == [True, True, True, False, False, False]


def test_names(spark):
    got = one(spark, T.name_like, "Marta Logrun", "M. Logrun", "MARTA LOGRUN", "Marta van Logrun", "Marta", "A History", "B C", "The Guide", "N EW Rules", "Łucja Ömer", "«Marta Logrun", "Marta L0grun", "McKay Logrun", "LOgrun Marta")
    assert got == [True, True, True, False, False, False, False, False, False, True, False, False, True, False]
    assert one(spark, T.names_in, "Marta Logrun and Oskar Velm, in three parts", "volume one") == [["Marta Logrun", "Oskar Velm"], []]


def test_book_numbers():
    thirteen = "978412345678" + frontmatter.check13("978412345678")
    wrong = thirteen[:12] + str((int(thirteen[12]) + 1) % 10)
    ten = next(f"41234567{a}{b}" for a in "0123456789" for b in "0123456789X" if sum((10 - i) * (10 if c == "X" else int(c)) for i, c in enumerate(f"41234567{a}{b}")) % 11 == 0)
    assert frontmatter.as_isbn13(thirteen) == thirteen and frontmatter.as_isbn13(wrong) is None and len(frontmatter.as_isbn13(ten)) == 13
    rows = frontmatter.isbns_of([f"ISBN {thirteen} (hardback)", f"{thirteen} pbk", "a line between", thirteen, f"ISBN {wrong}", f"e-ISBN: {thirteen[:3]}–{thirteen[3:]}, call 5550123456"])
    assert [(n, v, k, label) for n, _, v, _, k, label in rows] == [(1, thirteen, "hardcover", "hardback"), (2, thirteen, "paperback", "pbk"), (6, thirteen, "electronic", "e-ISBN")]
    assert frontmatter.isbns_of([ten, "no number"]) == [] and frontmatter.isbns_of([f"isbn {ten}"])[0][3] == "isbn10"
    assert [frontmatter.format_of(x) for x in ("hard cover", "e book", "PDF", "print", "cloth", "none")] == ["hardcover", "electronic", "electronic", "print", "hardcover", None]


def test_isbn_check_digits(spark):
    df = spark.createDataFrame([(f"978{n:09d}", f"{n:09d}") for n in (412345678, 7, 990000121)], "a string, b string")
    got = df.select("a", "b", T.isbn13_check(F.col("a")), T.isbn10_check(F.col("b"))).collect()
    for a, b, x, y in got:
        assert sum(int(c) * (3 if i % 2 else 1) for i, c in enumerate(a + str(x))) % 10 == 0
        assert sum((10 - i) * (10 if c == "X" else int(c)) for i, c in enumerate(b + y)) % 11 == 0


def test_columns_cluster_from_their_first_row(spark):
    f = frag(spark, [(i, "row ... 7", 40, r, 40 * i, 40 * i + 10) for i, r in ((1, 500), (2, 512), (3, 524), (4, 525))])
    got = sorted((r["first"], r["n"]) for r in detect.columns(f).collect())
    assert got == [(500.0, 2), (524.0, 2)]


def test_reference_pairs_with_the_nearest_title(spark):
    f = frag(spark, [(1, "Deep title", 40, 250, 110, 126), (2, "42", 530, 548, 110, 126)])
    assert [(r.region_id, r.title_id) for r in detect.paired_rows(f).collect()] == [(2, 1)]
    # a title that is a whole row itself keeps its number, and one behind another fragment isn't paired
    f = frag(spark, [(1, "Left row 7", 40, 200, 110, 126), (2, "42", 530, 548, 110, 126)])
    assert detect.paired_rows(f).count() == 0
    f = frag(spark, [(1, "Left title", 40, 200, 110, 126), (3, "9", 220, 230, 110, 126), (2, "42", 530, 548, 110, 126)])
    assert {(r.region_id, r.title_id) for r in detect.paired_rows(f).collect()} == {(3, 1)}


def test_contents_page_is_a_candidate(spark):
    f = frag(spark, [(0, "Contents", 40, 140, 35, 51), (1, "First chapter ........ 12", 40, 550, 110, 126), (2, "Second chapter ...... 29", 40, 550, 140, 156), (3, "Third chapter ....... 41", 40, 550, 170, 186)])
    page = spark.createDataFrame([("d", 4, 5, "ok", "embedded_pdf", 600.0, 800.0, "acceptable", "no_omission_indicated", 0)], "doc_id string, page_index int, revision bigint, outcome string, source string, width double, height double, readability string, coverage string, image_object_count bigint")
    s = detect.page_scores(page, f.drop("width", "height")).collect()[0]
    assert (s.status, s.rows, s.score > 7) == ("candidate", 3, True)
    c = detect.candidates(detect.page_scores(page, f.drop("width", "height"))).collect()[0]
    assert (c.start, c.end, c.n_pages) == ("may_continue", "may_continue", 1)
    none = detect.page_scores(page, f.drop("width", "height").limit(0)).collect()[0]
    assert (none.status, none.rows) == ("rejected", 0)


def test_margin_numbers(spark):
    region = "doc_id string, page_index int, revision bigint, region_id int, text string, l double, t double, r double, b double"
    page = spark.createDataFrame([("d", p, 1, 800.0) for p in range(5)], "doc_id string, page_index int, revision bigint, height double")
    rows = [(0, 0, "12", 744), (1, 0, "12", 744), (1, 1, "13", 744), (2, 0, "Slow lanterns 3", 10), (3, 0, "Chapter 9", 10), (4, 0, "0", 744)]
    df = spark.createDataFrame([("d", p, 1, i, x, 280.0, float(t), 320.0, float(t + 16)) for p, i, x, t in rows], region)
    got = {(r.page_index, r.kind): r.ordinal for r in mapping.margin_numbers(df, page).collect()}
    assert got == {(0, "footer"): 12, (2, "header"): 3}


def test_offsets_and_decision(spark):
    obs = spark.createDataFrame([("d", 12, "decimal", 1), ("d", 14, "decimal", 3), ("d", 23, "decimal", 12)], "doc_id string, page_index int, style string, ordinal int")
    body = spark.createDataFrame([("d", 10)], "doc_id string, first int")
    off = mapping.offsets(obs, body)
    assert off.collect()[0].asDict() | {} == {"doc_id": "d", "n_pages": 3, "n_offsets": 1, "contradictory": False, "offset": 11, "support": 3, "method": "strong"}
    e = spark.createDataFrame([("d", "e1", 12, "decimal"), ("d", "e2", 50, "decimal"), ("d", "e3", None, "unknown")], "doc_id string, entry_id string, ordinal int, numbering string")
    none = spark.createDataFrame([], "doc_id string, entry_id string, page_index int")
    got = {r.entry_id: (r.status, r.page) for r in mapping.map_entries(e, off, obs, none, body).collect()}
    assert got == {"e1": ("resolved", 23), "e2": ("unresolved", None), "e3": ("unresolved", None)}


def test_hierarchy_by_indent(spark):
    e = spark.createDataFrame([("d", "a", 0, 40.0), ("d", "b", 1, 52.0), ("d", "c", 2, 64.0)], "doc_id string, entry_id string, ord int, left double")
    got = {r.entry_id: (r.kind, r.parent_id) for r in parse.by_indent(e).collect()}
    assert got == {"a": ("root", None), "b": ("unknown", None), "c": ("known_parent", "a")}


def test_plan_issues(spark):
    rows = [("d", 0, "a", "c", b"A", 1), ("d", 1, "b", "a", b"B\xff", 1), ("d", 2, "c", "b", b" ", 9), ("d", 3, "s", "s", b"S", 2), ("d", 4, "m", "gone", b"M", 3), ("d", 5, "m", None, b"M", 3)]
    n = spark.createDataFrame([(d, o, i, p, bytearray(t), x) for d, o, i, p, t, x in rows], "doc_id string, ord int, node_id string, parent_id string, title binary, dest int")
    b = spark.createDataFrame([("d", 5, "ab", 1, 0), ("e", 0, None, 2, 1)], "doc_id string, page_count int, sha256 string, schema_version int, page_index_base int")
    gone = spark.createDataFrame([("d", "x"), ("d", "a"), ("d", "")], "doc_id string, entry_id string")
    moved = spark.createDataFrame([("d", "a", "z", "c"), ("d", "b", "a", "a"), ("d", "q", None, "a")], "doc_id string, node_id string, original_id string, new_id string")
    got = {(r.doc_id, r.node_id, r.code) for r in plan.validate(n, b, gone, moved).collect()}
    assert got == {
        ("d", "a", "parent_cycle"), ("d", "c", "empty_title"), ("d", "b", "invalid_utf8_title"), ("d", "c", "destination_out_of_range"), ("d", "s", "self_parent"), ("d", "m", "missing_parent"), ("d", "m", "duplicate_node_id"),
        ("d", "a", "invalid_omission"), ("d", "", "invalid_omission"), ("d", "b", "invalid_promotion"), ("d", "q", "invalid_promotion"),
        ("e", None, "invalid_page_count"), ("e", None, "missing_input_digest"), ("e", None, "empty_plan"), ("e", None, "unsupported_schema_version"), ("e", None, "unsupported_page_index_base"),
    }


def test_assembled_plan(spark):
    e = spark.createDataFrame([("d", "a", 0, "A", "root", None), ("d", "b", 1, "B", "known_parent", "a"), ("d", "c", 2, "C", "known_parent", "b"), ("d", "u", 3, "U", "unknown", None), ("d", "v", 4, "V", "known_parent", "u"), ("d", "g", 5, "G", "known_parent", "gone"), ("d", "x", 6, "X", "known_parent", "x")], "doc_id string, entry_id string, ord int, title string, kind string, parent_id string")
    m = spark.createDataFrame([("d", i, "resolved" if i not in "bu" else "unresolved", 3) for i in "abcuvgx"], "doc_id string, entry_id string, status string, page int")
    got = {r.entry_id: (r.parent_id, r.flattened, r.promoted, r.blocked) for r in assemble.assemble(e, m).collect()}
    no = (None, False, False, None)
    assert got == {"a": no, "b": no, "c": ("a", False, True, None), "u": no, "v": (None, True, True, None), "g": (None, False, False, "missing_parent"), "x": (None, False, False, "cycle")}
    r = assemble.readiness(assemble.assemble(e, m)).collect()[0]
    assert (r.n_nodes, r.n_omitted, r.n_promoted, r.n_flattened, r.n_blocked, r.ready) == (3, 2, 2, 1, 2, False)
    assert assemble.assemble(e.limit(0), m).count() == 0


def test_sections(spark):
    s = spark.createDataFrame([("d", "body", 4, 40, "decimal", ""), ("d", "front", 0, 4, "roman", "")], "doc_id string, section string, first int, end int, style string, prefix string")
    t = spark.createDataFrame([("d", p, "decimal", "", p - 3) for p in (5, 6, 7, 8)] + [("d", 9, "decimal", "", 1), ("d", 1, "roman", "", 2), ("d", 2, "roman", "", 3)], "doc_id string, page_index int, style string, prefix string, ordinal int")
    a = {r.section: (r.offset, r.contradictory, list(r.outliers)) for r in sections.anchors(t, s).collect()}
    assert a == {"body": (3, False, [9]), "front": (-1, False, [])}
    e = spark.createDataFrame([("d", "e1", "decimal", 4, None, "", False), ("d", "e2", "roman", 2, None, "", False), ("d", "e3", "decimal", 30, None, "", False), ("d", "e4", "decimal", 2, 1, "", False), ("d", "e5", "decimal", 3, None, "", True)], "doc_id string, entry_id string, numbering string, ordinal int, range_end int, prefix string, uncertain boolean")
    page = "doc_id string, entry_id string, page_index int"
    none = spark.createDataFrame([], "doc_id string, section string, page_index int, style string, prefix string, ordinal int")
    links = spark.createDataFrame([("d", "e1", 8), ("d", "e3", 20), ("d", "e3", 33)], page)
    head = spark.createDataFrame([("d", "e3", 20), ("d", "e3", 33)], page)
    whole = spark.createDataFrame([], "doc_id string, section string")
    got = {r.entry_id: (r.status, r.page, r.method, r.reason, r.n_hints) for r in sections.resolve(e, s, sections.anchors(t, s), t, head, none, links, whole).collect()}
    assert got == {
        "e1": ("resolved", 7, "inferred_offset", "outliers_ignored", 1), "e2": ("resolved", 1, "inferred_offset", "confirmed", 0), "e3": ("ambiguous", None, None, "several_destinations", 0),
        "e4": ("unresolved", None, None, "outside_section", 0), "e5": ("unresolved", None, None, "no_reference", 0),
    }


def test_rejected_page_between_two_candidates(spark):
    rows = [("d", 3, "candidate", 20.0, [0.9], 9, False), ("d", 4, "rejected", 6.0, [0.91], 3, False), ("d", 5, "candidate", 20.0, [0.92], 9, False), ("d", 6, "rejected", 6.0, [0.4], 3, False), ("d", 7, "candidate", 20.0, [0.93], 9, False), ("e", 1, "candidate", 9.0, [0.5], 4, False), ("e", 2, "skipped", 0.0, [], 0, False), ("e", 3, "candidate", 9.0, [0.5], 4, False)]
    s = spark.createDataFrame(rows, "doc_id string, page_index int, status string, score double, anchors array<double>, rows bigint, excluded boolean")
    got = sorted((r.doc_id, r.first, r["last"], r.n_pages, r.gaps) for r in detect.candidates(s).collect())
    assert got == [("d", 3, 5, 3, 0), ("d", 7, 7, 1, 0), ("e", 1, 3, 2, 1)]


def test_outline_links_and_verification(spark):
    n = spark.createDataFrame([("d", 0, "a", None), ("d", 1, "b", "a"), ("d", 2, "c", "a"), ("d", 3, "e", None)], "doc_id string, ord int, node_id string, parent_id string")
    links = plan.outline_links(n)
    got = {r.node_id: (r.prev, r.next, r["first"], r["last"], r.n_children) for r in links.collect()}
    assert got == {"a": (None, "e", "b", "c", 2), "b": (None, "c", None, None, 0), "c": ("b", None, None, None, 0), "e": ("a", None, None, None, 0)}
    count = lambda other: tuple(plan.verify(links, other).collect()[0])
    assert count(links) == ("d", 4, 4, 0, 0, True) and count(links.where("node_id <> 'c'")) == ("d", 4, 3, 1, 0, False)


def test_order_and_partitions_change_nothing(spark):
    f = frag(spark, [(i, f"Chapter {i} ..... {i * 3}", 40, 550, 100 + 20 * i, 112 + 20 * i) for i in range(8)])
    a = sorted(map(tuple, detect.reference_rows(f).collect()))
    b = sorted(map(tuple, detect.reference_rows(f.orderBy(F.desc("region_id")).repartition(3)).collect()))
    assert a == b and len(a) == 8
