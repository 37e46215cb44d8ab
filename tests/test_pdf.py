"""Text layers of made-up PDF files: tables over pages, packed objects, mapped fonts, damage."""

import zlib

import pytest
from pyspark.sql import functions as F

from quernstone.sources import pdf
from quernstone.sources.files import UnsupportedInput

ROWS = [("Emp ID", "Name", "Designation"), ("EMP-00040", "Asha Rao", "Staff Engineer"), ("EMP-00041", "Bo Li", ""), ("EMP-00042", "Cy Ng", "Senior (QA) Lead")]
FONT = b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica >>"


def escaped(text):
    return text.replace("\\", r"\\").replace("(", r"\(").replace(")", r"\)").encode("cp1252")


def shown(rows, top=700):
    out = [b"BT /F1 10 Tf"]
    for i, row in enumerate(rows):
        out += [b"1 0 0 1 %d %d Tm (%s) Tj" % (72 + 160 * k, top - 20 * i, escaped(c)) for k, c in enumerate(row) if c]
    return b"\n".join([*out, b"ET"])


def document(pages, font=FONT, more=(), packed=True, media=b"[0 0 612 792]"):
    objects = {1: b"<< /Type /Catalog /Pages 2 0 R >>", 2: b"<< /Type /Pages /Kids [" + b" ".join(b"%d 0 R" % (10 + 2 * i) for i in range(len(pages))) + b"] /Count %d /MediaBox " % len(pages) + media + b" /Resources << /Font << /F1 3 0 R >> >> >>", 3: font}
    for i, content in enumerate(pages):
        body = zlib.compress(content) if packed else content
        objects[10 + 2 * i] = b"<< /Type /Page /Parent 2 0 R /Contents %d 0 R >>" % (11 + 2 * i)
        objects[11 + 2 * i] = b"<< /Length %d %s>>\nstream\n" % (len(body), b"/Filter /FlateDecode " if packed else b"") + body + b"\nendstream"
    objects |= dict(more)
    return b"%PDF-1.4\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % (n, o) for n, o in objects.items()) + b"trailer << /Root 1 0 R >>\n%%EOF"


def test_words_and_boxes():
    (page,) = pdf.page_words(document([shown(ROWS)]))
    assert [w[0] for w in page] == " ".join(c for row in ROWS for c in row if c).split()
    first = page[0]
    assert first[1] == 72 and first[2] == pytest.approx(792 - 700 - 8) and first[4] - first[2] == pytest.approx(10) and first[3] > first[1]
    moved = pdf.page_words(document([b"q 2 0 0 2 10 20 cm BT /F1 5 Tf 12 TL 10 100 Td (one) Tj T* [(t) -20 (wo) -900 (three)] TJ ET Q"], packed=False))[0]
    assert [w[0] for w in moved] == ["one", "two", "three"] and moved[0][1] == 30 and moved[1][2] - moved[0][2] == pytest.approx(24)


def test_mapped_fonts_and_object_streams():
    cmap = b"1 beginbfrange <0001> <0003> <0041> endbfrange 2 beginbfchar <0010> <00DC> <0011> <00660069> endbfchar"
    font = b"<< /Type /Font /Subtype /Type0 /Encoding /Identity-H /DescendantFonts [4 0 R] /ToUnicode 5 0 R >>"
    inner = b"<< /Type /Font /Subtype /CIDFontType2 /DW 600 /W [1 [500 500] 16 17 700] >>"
    head = b"4 0 "
    body = head + inner
    stream = zlib.compress(body)
    packed = b"<< /Type /ObjStm /N 1 /First %d /Filter /FlateDecode /Length %d >>\nstream\n" % (len(head), len(stream)) + stream + b"\nendstream"
    more = {5: b"<< /Length %d >>\nstream\n" % len(cmap) + cmap + b"\nendstream", 6: packed}
    (page,) = pdf.page_words(document([b"BT /F1 10 Tf 50 50 Td <000100020003> Tj 100 0 Td <00100011> Tj ET"], font, more))
    assert [w[0] for w in page] == ["ABC", "Üfi"] and page[0][3] - page[0][1] == pytest.approx(16) and page[1][3] - page[1][1] == pytest.approx(14)
    differs = b"<< /Type /Font /Subtype /Type1 /Encoding << /Differences [65 /one /two /uni00E9] >> /FirstChar 65 /Widths [500 500 500] >>"
    assert pdf.page_words(document([b"BT /F1 10 Tf (ABC) Tj ET"], differs))[0][0][0] == "12é"


def test_damage_is_told():
    whole = document([shown(ROWS)])
    for bad, why in ((b"no", "no PDF"), (whole[: whole.index(b"stream") + 40], "breaks off"), (b"%PDF-1.4\n", "no pages"), (whole.replace(b"trailer <<", b"trailer << /Encrypt 9 0 R"), "encrypted"), (whole.replace(b"FlateDecode", b"LZWDecode"), "LZWDecode")):
        with pytest.raises(UnsupportedInput, match=why):
            pdf.page_words(bad)
    cut = whole.replace(b"x\x9c", b"zz", 1)
    with pytest.raises(UnsupportedInput, match="unpacked"):
        pdf.page_words(cut)


def test_tables_become_records(spark, tmp_path):
    title = b"BT /F1 16 Tf 1 0 0 1 72 750 Tm (Roster) Tj ET\n"
    (tmp_path / "roster.pdf").write_bytes(document([title + shown(ROWS), shown([ROWS[0], ("EMP-00043", "Di Ek", "Intern"), ("EMP-00044", "Ed Fu", "Head of Staff")])]))
    (tmp_path / "scan.pdf").write_bytes(document([b""]))
    (tmp_path / "bad.pdf").write_bytes(b"%PDF-1.4\n1 0 obj\n<< /Length 5 >>\nstream\nabc")
    notes = {(r.file, r.page): (r.chars, r.note) for r in pdf.read_pages(spark, [str(tmp_path)]).collect()}
    assert notes["scan.pdf", 1] == (0, "") and "breaks off" in notes["bad.pdf", None][1] and notes["roster.pdf", 2][0] > 60
    recorded = [("scan.pdf", 1, w, x, 10.0 + 20 * i, x + 8.0 * len(w), 20.0 + 20 * i, 0.7) for i, row in enumerate([("Emp", "City"), ("E1", "Bonn"), ("E2", "Ulm")]) for w, x in zip(row, (10.0, 200.0))]
    words = spark.createDataFrame(recorded, "file string, page int, text string, x0 double, y0 double, x1 double, y1 double, confidence double")
    got = {r.record_id: r for r in pdf.read_documents(spark, [str(tmp_path)], words).collect()}
    rows = [got[f"roster.pdf##{i}"].cells for i in range(1, 6)]
    assert [r["Emp ID"] for r in rows] == [f"EMP-0004{i}" for i in range(5)] and [r.get("Designation") for r in rows] == ["Staff Engineer", None, "Senior (QA) Lead", "Intern", "Head of Staff"]
    assert got["roster.pdf##5"].path == "page 2" and set(got["roster.pdf##1"].confidence.values()) == {1.0}
    assert got["scan.pdf##2"].cells == {"Emp": "E2", "City": "Ulm"} and set(got["scan.pdf##2"].confidence.values()) == {0.7}
    assert pdf.read_pages(spark, [str(tmp_path)]).where(F.col("page").isNull()).count() == 1


def test_files_of_all_kinds(spark, tmp_path):
    from quernstone.sources import files

    (tmp_path / "roster.pdf").write_bytes(document([shown(ROWS)]))
    (tmp_path / "broken.pdf").write_bytes(b"%PDF-1.4 nothing")
    (tmp_path / "named.csv").write_bytes(document([shown(ROWS)]))
    (tmp_path / "text.pdf").write_text("a,b\n1,2\n")
    (tmp_path / "plain.csv").write_text("a,b\n1,2\n3,4\n")
    report = {r.file: (r.kind, r.supported, r.rows, r.columns, r.note) for r in files.file_report(spark, [str(tmp_path)]).collect()}
    assert report["roster.pdf"] == ("pdf", True, 3, 3, "") and report["plain.csv"][:3] == ("csv", True, 2) and report["text.pdf"][:3] == ("csv", True, 1)
    assert report["broken.pdf"][1:4] == (False, 0, 0) and "no pages" in report["broken.pdf"][4] and report["named.csv"][:2] == ("pdf", False)
    got = sorted(r.record_id for r in files.read_records(spark, [str(tmp_path)]).collect())
    assert got == ["plain.csv##1", "plain.csv##2", *(f"roster.pdf##{i}" for i in (1, 2, 3)), "text.pdf##1"]
