import io
import zipfile

import pytest
from pyspark.sql import functions as F

from quarry.functions import metrics, scalars, text
from quarry.sources import files as source


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(column).first()[0]


def test_dates():
    assert [scalars.date_to_unix(x) for x in ("1970-01-01", "1970-01-02", "garbage", "1970-1-3", "2024-02-31", "a-b-c")] == [0, 86400, None, 172800, scalars.date_to_unix("2024-03-02"), None]
    assert scalars.date_bounds("1970-01-02", "1970-01-02") == (86400 * 10**9, (2 * 86400 - 1) * 10**9)


def test_cursor_round_trip():
    for score, path in ((0.0327868852, "/a|b/c.txt"), (0.0, ""), (-1.5, "é")):
        assert scalars.decode_cursor(scalars.encode_cursor(score, path)) == (score, path)
    assert scalars.decode_cursor("%%%") is None


@pytest.mark.parametrize(
    "query, want",
    [
        ("pdf invoices from 2023 in Finance", {"media_types": ("pdf",), "date_from": "2023-01-01", "date_to": "2023-12-31", "root_scope": ("finance",), "query_text": "invoices"}),
        ("report 2022", {"date_from": "2022-01-01", "query_text": "report"}),
        ("notes today", {"date_from": "2026-01-05", "date_to": "2026-01-05", "query_text": "notes"}),
        ("scans min confidence 0.8", {"min_confidence": 0.8, "query_text": "scans"}),
        ("pdf", {"media_types": ("pdf",), "query_text": "pdf"}),
        ("in pdf", {"root_scope": (), "media_types": ("pdf",), "query_text": "in"}),
    ],
)
def test_parser(query, want):
    got = scalars.parse_query(query, today="2026-01-05")
    assert {k: getattr(got, k) for k in want} == want


def test_model_gate_and_replies():
    calls = []

    def llm(q):
        calls.append(q)
        return 'Sure: {"queryText": "a}b", "mediaTypes": ["pdf", "exe"], "minConfidence": 3} bye'

    long = "please find all the quarterly finance reports"
    got = scalars.parse_query(long, llm=llm)
    assert (got.query_text, got.media_types, got.min_confidence) == ("a}b", ("pdf",), 1.0)
    scalars.parse_query(long, mode="keyword", llm=llm)
    scalars.parse_query("five words are too few", llm=llm)
    assert len(calls) == 1
    assert scalars.parse_query(long, llm=lambda q: 1 / 0).query_text == long
    assert scalars.parse_reply('é {"queryText": "x"').query_text == "x"
    with pytest.raises(ValueError):
        scalars.parse_reply("nothing")


@pytest.mark.parametrize("n, size, overlap, want", [(10, 4, 2, [(0, 4), (2, 6), (4, 8), (6, 10)]), (7, 4, 1, [(0, 4), (3, 7)]), (20, 8, 2, [(0, 8), (6, 14), (12, 20)]), (0, 4, 2, []), (3, 4, 2, [(0, 3)])])
def test_chunks(spark, n, size, overlap, want):
    got = one(spark, text.chunks("v", size, overlap), "  ".join(f"w{i}" for i in range(n)))
    assert [(c.start_token, c.end_token) for c in got] == want
    assert all(c.text == " ".join(f"w{i}" for i in range(c.start_token, c.end_token)) for c in got)


def test_chunk_overlap_must_be_less():
    with pytest.raises(ValueError):
        text.chunks("v", 4, 4)


def test_tokens_and_phrases(spark):
    assert one(spark, text.tokens("v"), "Crème BRÛLÉE, naïve-ly 42ª!") == ["creme", "brulee", "naive", "ly", "42ª"]
    assert text.query_tokens("Crème BRÛLÉE") == ["creme", "brulee"]
    count = lambda phrase, body: one(spark, text.phrase_count(text.spaced("v"), phrase), body)
    assert count(["a", "b"], "a b a  b b") == 2 and count(["a", "a"], "a a a") == 2 and count([], "a") == 0 and count(["a", "b", "c"], "a b") == 0


def test_snippets(spark):
    assert one(spark, text.format_snippet("v"), '<a> & "b" \x01hit\x02') == "&lt;a&gt; &amp; &quot;b&quot; <mark>hit</mark>"
    assert one(spark, text.highlighted("v"), "a <mark>b</mark> c") == ["a ", "b", " c"]
    assert one(spark, text.first_sentences("v"), " One. Two! three") == "One. Two!"
    assert one(spark, text.first_sentences("v"), "x" * 300) == "x" * 200
    assert text.match_window("a Big, dog ran", ["big", "dog"]) == "a \x01Big, dog\x02 ran"
    cut = text.match_window(" ".join(["w"] * 50 + ["hit"] + ["w"] * 50), ["hit"])
    assert cut.startswith("...") and cut.endswith("...") and "\x01hit\x02" in cut and len(cut.split()) == 30


def test_names(spark):
    assert one(spark, text.basename("v"), "a\\b\\c.txt") == "c.txt" and one(spark, text.dirname("v"), "a/b/c.txt") == "a/b"
    assert [one(spark, text.media_type("v"), x) for x in ("A.PDF", "x.xlsm", "y.jpeg", "z.exe", "none")] == ["pdf", "xlsx", "jpg", None, None]
    assert one(spark, text.format_bytes("v"), 1536, "long") == "1.5 KB" and one(spark, text.format_bytes("v"), 2048, "long") == "2 KB" and one(spark, text.format_bytes("v"), 5, "long") == "5 B"
    assert one(spark, text.remove_first_token("v", "pdf"), "a PDF b pdf pdfs") == "a b pdf pdfs"
    assert one(spark, text.csv_pairs("v"), "name,age,city\nAna,,Lisbon\nBo,3,") == "name: Ana, city: Lisbon\nname: Bo, age: 3"
    assert source.csv_text("name,age,city\nAna,,Lisbon\nBo,3,") == "name: Ana, city: Lisbon\nname: Bo, age: 3"
    assert one(spark, text.csv_pairs("v"), "only,heads") == "" == source.csv_text("only,heads") == source.csv_text("")


def test_format_bytes_as_shown_by_the_reference(spark):
    sizes = [(0, "0 B"), (1023, "1023 B"), (1280, "1.3 KB"), (2049, "2.0 KB"), (1024**2 - 1, "1024.0 KB"), (1024**2, "1 MB"), (5 * 2**18, "1.3 MB"), (2**30, "1 GB"), (5 * 2**28, "1.3 GB"), (2**50, "1048576 GB"), (None, None)]
    assert [r[0] for r in spark.createDataFrame([(n,) for n, _ in sizes], "v long").select(text.format_bytes("v")).collect()] == [t for _, t in sizes]


@pytest.mark.parametrize(
    "body, want",
    [
        ("# Head\n> **bold** `code` [link](http://x) ![alt](y.png)\na_b *odd", "Head\nbold code link alt\na_b odd"),
        ("#hash", "hash"), ("### Deep heading ###", "Deep heading ###"), ("** wide ** and * inner * and ` code `", "wide and inner and code"),
        ("**open", "open"), ("a ` b", "a  b"), ("> > quote", "> quote"), ("![broken] (x)", "![broken] (x)"), ("x\x0cy\r\nz\u2028w", "x\x0cy\nz\u2028w"), ("", ""),
    ],
)
def test_markdown(body, want):
    assert source.strip_markdown(body) == want


def test_csv_lines_are_cut_by_line_feeds_only():
    assert source.csv_text("a,b\r\n1\x0b2,3\r\n") == "a: 1\x0b2, b: 3"


def sheet_file(sheets, styles="", shared=""):
    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as z:
        names = "".join(f'<sheet name="{n}" sheetId="{k}" r:id="r{k}"/>' for k, (n, _) in enumerate(sheets))
        z.writestr("xl/workbook.xml", f'<workbook {main} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets>{names}</sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", "<Relationships>" + "".join(f'<Relationship Id="r{k}" Target="worksheets/{n}.xml"/>' for k, (n, _) in enumerate(sheets)) + "</Relationships>")
        for n, rows in sheets:
            z.writestr(f"xl/worksheets/{n}.xml", f"<worksheet {main}><sheetData>{rows}</sheetData></worksheet>")
        z.writestr("xl/styles.xml", f"<styleSheet {main}>{styles}</styleSheet>")
        z.writestr("xl/sharedStrings.xml", f"<sst {main}>{shared}</sst>")
    return raw.getvalue()


def test_spreadsheets():
    styles = '<numFmts><numFmt numFmtId="170" formatCode="yyyy\\-mm"/><numFmt numFmtId="171" formatCode="0.0&quot;days&quot;"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="170"/><xf numFmtId="171"/></cellXfs>'
    rows = '<row r="2"><c t="s"><v>0</v></c><c><v>3</v></c><c><v>0.1</v></c><c><v>1E21</v></c><c t="b"><v>1</v></c></row><row r="4"><c s="1"><v>45000</v></c><c s="2"><v>45000.5</v></c><c s="3"><v>7.5</v></c><c t="e"><v>#N/A</v></c><c t="d"><v>2024-01-01</v></c><c t="inlineStr"><is><t>in</t></is></c><c t="str"><v>calc</v></c><c/></row>'
    raw = sheet_file([("zeta", rows), ("alpha", '<row r="1"><c><v>5.0</v></c></row>')], styles, "<si><t>shared</t></si>")
    assert source.xlsx_text(raw) == "shared 3 0.1 1000000000000000000000 true \n\n7.5 in calc \n5"


def test_pdf_passes():
    pages = [("", "low", 0.5), ("", "ok", 0.8), (" ", "good", 0.9), ("", " ", 0.99)]
    asked = []

    def vision(which):
        asked.append(which)
        return [f"seen {k}" if k else " " for k in which]

    got = source.pdf_text(pages, vision)
    assert got.text == "ok\n\ngood\n\nseen 3" and asked == [[0, 3]] and abs(got.confidence - 0.85) < 1e-9
    got = source.pdf_text([("", "low", 0.5), ("", "", 0.0)], vision)
    assert (got.text, got.confidence) == ("seen 1", 0.75) and asked[-1] == [0, 1]
    assert source.pdf_text([("layer", "x", 0.9), (" two ", "y", 0.9)], vision).text == "layer\n two"
    assert source.pdf_text([("", "low", 0.5)]).text == ""


def test_ocr_files(spark):
    df = spark.createDataFrame([(1, 2, "b", 0.9), (1, 1, "a", 0.8), (1, 3, "c", 0.7), (1, 4, " ", 0.99), (2, 1, "z", 0.1)], "file_id long, page int, text string, confidence double")
    assert [(r.file_id, r.text, round(r.confidence, 6), r.pages) for r in source.ocr_files(df).collect()] == [(1, "a\n\nb", 0.85, 2)]


def test_metrics(spark):
    df = spark.createDataFrame([("A", ["x", "y"], ["z", "x", "y"]), ("B", [], ["x"]), ("B", ["q"], ["z"])], "group string, relevant array<string>, retrieved array<string>")
    rows = metrics.evaluate(df).collect()
    assert [(r.recall, r.mrr) for r in rows] == [(1.0, 0.5), (0.0, 0.0), (0.0, 0.0)]
    assert abs(rows[0].ndcg - (1 / 1.5849625 + 0.5) / (1 + 1 / 1.5849625)) < 1e-6
    means = {r.group: (r.recall, r.n) for r in metrics.by_group(metrics.evaluate(df)).collect()}
    assert means == {"all": (0.5, 2), "A": (1.0, 1), "B": (0.0, 1), "C": (0.0, 0)}
    assert df.select(metrics.recall_at_k(F.col("relevant"), F.col("retrieved"), 0).alias("r")).first().r == 0.0


def test_language():
    assert source.detect_language("the cat and the dog of the house") == "eng" and source.detect_language("zzz") == "unknown"
    assert source.detect_language("zz " * 3000 + "der hund und die katze") == "deu"


def test_remove_first_token(spark):
    cases = {"invoices pdf 2024": "invoices 2024", "pdf invoices": "invoices", "invoices pdf": "invoices", "pdf invoices pdf": "invoices pdf", "pdfviewer invoices": "pdfviewer invoices", "invoices PDF 2024": "invoices 2024", "invoices  pdf  2024": "invoices 2024", "pdf": "", "invoices docx 2024": "invoices docx 2024", "a (pdf) b": "a () b", "pdf, x": ", x", "x_pdf pdf": "x_pdf", "p.f (p.f": "p.f (p.f"}
    for value, want in cases.items():
        assert one(spark, text.remove_first_token("v", "pdf"), value) == want, value
    assert one(spark, text.remove_first_token("v", "p.f"), "pdf p.f") == "pdf"


def test_delta(spark):
    df = spark.createDataFrame([(0.5, 0.25), (0.25, 0.5), (0.5, 0.5)], "a double, b double")
    assert [r[0] for r in df.select(text.format_delta("a", "b")).collect()] == ["+0.250", "-0.250", "+0.000"]


@pytest.mark.parametrize(
    "query, want",
    [
        ("receipts in pdf from 2024 in Dropbox", {"media_types": ("pdf",), "root_scope": ("dropbox",), "date_from": "2024-01-01", "date_to": "2024-12-31"}),
        ("anime girl min confidence 0.8", {"min_confidence": 0.8}), ("", {"query_text": "", "media_types": (), "root_scope": (), "date_from": None}),
        ("show me pdf and docx files", {"media_types": ("pdf", "docx")}), ("search in pdf", {"root_scope": (), "media_types": ("pdf",)}), ("documents 2023", {"date_from": "2023-01-01", "date_to": "2023-12-31"}),
        ("pdf 2024", {"query_text": "pdf 2024"}), ("birthday party photos", {"query_text": "birthday party photos", "media_types": ()}), ("jpeg files", {"media_types": ("jpeg",)}),
        ("min confidence 2024", {"min_confidence": 0.0, "date_from": "2024-01-01", "query_text": "min confidence"}), ("notes in min confidence 0.5", {"root_scope": ("min",), "min_confidence": 0.0, "query_text": "notes confidence 0.5"}),
        ("a min confidence 0.5 min confidence 0.7", {"min_confidence": 0.7, "query_text": "a"}), ("from 2021 from 2022", {"date_from": "2021-01-01", "query_text": "from 2022"}), ("today 2020", {"date_from": "2020-01-01", "query_text": "today"}),
    ],
)
def test_parser_passes(query, want):
    got = scalars.parse_query(query, today="2026-01-05")
    assert {k: getattr(got, k) for k in want} == want


@pytest.mark.parametrize("query, mode, calls", [("pdf 2024", "hybrid", 0), ("receipts in pdf from 2024 in Dropbox", "hybrid", 0), ("find the document about the project planning meeting notes", "hybrid", 1), ("find the document about the project planning meeting notes", "keyword", 0), ("elephant giraffe banana from 2024 pdf", "hybrid", 0)])
def test_model_is_asked_for_long_queries_only(query, mode, calls):
    asked = []
    scalars.parse_query(query, mode=mode, llm=lambda q: asked.append(q) or '{"queryText": "x"}')
    assert len(asked) == calls
