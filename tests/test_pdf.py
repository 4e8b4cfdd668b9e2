"""PDF reading and writing on files made here."""

import zlib

import pytest

from docloom.sources import pdf as P


def made(*streams, media=(0, 0, 612, 792), flate=True, info=None, extra=None, objects=None):
    pages = []
    holder = P.Pdf(dict(objects or {}), {})
    for k, s in enumerate(streams):
        body = zlib.compress(s.encode("cp1252")) if flate else s.encode("cp1252")
        holder.objects[10 + k] = P.Stream({"Filter": P.Name("FlateDecode")} if flate else {}, body)
        font = {"Type": P.Name("Font"), "Subtype": P.Name("Type1"), "BaseFont": P.Name("Helvetica")} | (extra or {})
        pages.append((holder, {"Type": P.Name("Page"), "MediaBox": list(media), "Contents": P.Ref(10 + k), "Resources": {"Font": {"F1": font}}}))
    return P.build(pages, info)


PAGE = "BT /F1 10 Tf 72 700 Td (Hello world) Tj 0 -14 Td [(sec) -20 (ond) -900 (line)] TJ 0 -60 Td (Far \\(away\\)) Tj ET 72 600 m 400 600 l S"


def test_words_lines_blocks():
    rows = list(P.rows_of("f", made(PAGE), "words"))
    assert [r[5] for r in rows] == ["Hello", "world", "second", "line", "Far", "(away)"]
    assert [r[2] for r in rows] == [0, 0, 0, 0, 1, 1]
    assert rows[0][7] == 72.0
    assert rows[0][11] == pytest.approx(92.0)
    assert list(P.rows_of("f", made(PAGE), "rules")) == [("f", 0, "h", 192.0, 72.0, 400.0, None)]


def test_unicode_map_and_metadata():
    cmap = b"1 beginbfchar <0041> <00E9> endbfchar 1 beginbfrange <0042> <0044> <0061> endbfrange"
    font = {"Subtype": P.Name("Type0"), "ToUnicode": P.Ref(50)}
    data = made("BT /F1 12 Tf 10 10 Td <0041004200430044> Tj ET", extra=font, objects={50: P.Stream({}, cmap)}, info={"Title": "Über", "Author": "A"})
    assert [r[5] for r in P.rows_of("f", data, "words")] == ["éabc"]
    (m,) = P.rows_of("f", data, "metadata")
    assert m[1:4] == (1, "Über", "A")


def test_damage_is_a_row_not_a_failure():
    assert list(P.rows_of("f", b"no pdf", "words"))[0][-1].startswith("ValueError")
    encrypted = made(PAGE).replace(b"/Root 1 0 R", b"/Root 1 0 R /Encrypt 9 0 R")
    assert "encrypted" in list(P.rows_of("f", encrypted, "pages"))[0][-1]
    no_xref = made(PAGE).split(b"xref")[0]
    assert len(list(P.rows_of("f", no_xref, "words"))) == 6


def test_object_streams():
    data = made(PAGE)
    body = b"<< /Type /Catalog /Pages 2 0 R >>"
    packed = zlib.compress(b"90 0 " + body)
    stream = P._serial(P.Stream({"Type": P.Name("ObjStm"), "N": 1, "First": 5, "Filter": P.Name("FlateDecode")}, packed))
    data = data.replace(b"1 0 obj\n<</Type /Catalog /Pages 2 0 R>>\nendobj", b"91 0 obj\n" + stream + b"\nendobj").split(b"xref")[0]
    assert len(list(P.rows_of("f", data, "words"))) == 6


def test_data_source_and_plans(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(made(PAGE, PAGE.replace("Hello", "Second")))
    (tmp_path / "B.PDF").write_bytes(made(PAGE.replace("Hello", "Other"), flate=False))
    (tmp_path / "c.pdf").write_bytes(b"broken")
    pages = P.read_pdf(spark, str(tmp_path), "pages")
    assert pages.where("error is null").count() == 3
    assert pages.where("error is not null").count() == 1
    assert P.read_pdf(spark, str(tmp_path)).where("page_num = 1 and text = 'Second'").count() == 1
    files = spark.createDataFrame([(1, (tmp_path / "a.pdf").read_bytes()), (2, (tmp_path / "B.PDF").read_bytes()), (3, b"broken")], "doc_id bigint, content binary")
    plan = spark.createDataFrame([("m", 2, 0, 1, 90), ("m", 1, 1, 2, 0), ("x", 3, 0, 1, 0)], "out string, doc_id bigint, out_page int, page int, rotation int")
    got = {r.out: r for r in P.apply_plan(files, plan).collect()}
    assert got["x"].error
    merged = bytes(got["m"].content)
    assert [r[5] for r in P.rows_of("m", merged, "words")][::6] == ["Other", "Second"]
    assert [r[4] for r in P.rows_of("m", merged, "pages")] == [90, 0]


def test_metadata_set_and_cleared(spark):
    data = made(PAGE, info={"Title": "Old", "Author": "A"})
    files = spark.createDataFrame([(1, data), (2, b"broken"), (3, data)], "doc_id bigint, content binary")
    changes = spark.createDataFrame([(1, "Title", "Über"), (1, "Author", None), (2, "Title", "x"), (3, "Color", "red")], "doc_id bigint, field string, value string")
    got = {r.doc_id: r for r in P.set_metadata(files, changes, "D:20240101120000Z").collect()}
    (m,) = P.rows_of("f", bytes(got[1].content), "metadata")
    assert (m[2], m[3], m[9]) == ("Über", None, "D:20240101120000Z")
    assert [r[5] for r in P.rows_of("f", bytes(got[1].content), "words")] == [r[5] for r in P.rows_of("f", data, "words")]
    assert bytes(got[1].content).startswith(data)
    assert "ValueError" in got[2].error
    assert "Color" in got[3].error


def test_signed_files_are_refused():
    pdf = P.parse(made(PAGE))
    root = {"Type": P.Name("Catalog"), "Pages": P.Ref(2), "AcroForm": {"Fields": [{"FT": P.Name("Sig")}]}}
    data = made(PAGE).replace(b"<</Type /Catalog /Pages 2 0 R>>", P._serial(root))
    with pytest.raises(ValueError, match="signed"):
        P.with_info(data, {"Title": "x"}, "D:20240101120000Z")
    assert P.with_info(data, {"Title": "x"}, "D:20240101120000Z", force=True)[0]
    assert pdf.trailer


def test_crop_and_resize(spark):
    files = spark.createDataFrame([(1, made(PAGE))], "doc_id bigint, content binary")
    plan = spark.createDataFrame(
        [("crop", 1, 0, 1, [10.0, 10.0, 300.0, 400.0], None, None, None), ("half", 1, 0, 1, None, [0.5, 0.0, 0.0, 0.5, 0.0, 0.0], 306.0, 396.0), ("bad", 1, 0, 1, [5.0, 5.0, 5.0, 9.0], None, None, None)],
        "out string, doc_id bigint, out_page int, page int, crop array<double>, matrix array<double>, width double, height double",
    )
    got = {r.out: r for r in P.apply_plan(files, plan).collect()}
    assert b"/CropBox [10 10 300 400]" in bytes(got["crop"].content)
    assert "crop" in got["bad"].error
    half = bytes(got["half"].content)
    (page,) = P.rows_of("f", half, "pages")
    assert page[2:4] == (306.0, 396.0)
    rows = list(P.rows_of("f", half, "words"))
    assert [r[5] for r in rows][:2] == ["Hello", "world"]
    assert rows[0][7] == 36.0


def test_images_fonts_and_tags(spark, tmp_path):
    from docloom.sources import files

    body = "/P <</MCID 0>> BDC BT /F1 10 Tf 72 700 Td (Tagged head) Tj ET EMC BT /F1 10 Tf 72 650 Td (plain) Tj ET q 100 0 0 50 72 500 cm /Im1 Do Q q 10 0 0 10 0 0 cm /Im2 Do Q"
    holder = P.Pdf({}, {})
    holder.objects[10] = P.Stream({}, body.encode())
    image = {"Type": P.Name("XObject"), "Subtype": P.Name("Image"), "Width": 2, "Height": 1, "ColorSpace": P.Name("DeviceRGB"), "BitsPerComponent": 8}
    holder.objects[11] = P.Stream(image | {"Filter": P.Name("FlateDecode")}, zlib.compress(bytes([255, 0, 0, 0, 255, 0])))
    holder.objects[12] = P.Stream(image | {"ColorSpace": P.Name("DeviceCMYK")}, b"abcdefgh")
    font = {"Type": P.Name("Font"), "Subtype": P.Name("Type1"), "BaseFont": P.Name("ABCDEF+Serif-BoldItalic"), "FontDescriptor": {"Flags": 64}}
    page = {"Type": P.Name("Page"), "MediaBox": [0, 0, 612, 792], "Contents": P.Ref(10), "Resources": {"Font": {"F1": font}, "XObject": {"Im1": P.Ref(11), "Im2": P.Ref(12)}}}
    data = P.build([(holder, page)])
    tree = b"<</Type /Catalog /Pages 2 0 R /StructTreeRoot <</K [<</S /Head /Pg 3 0 R /K [0] /Alt (Alt)>>] /RoleMap <</Head /H1>>>>>>"
    data = data.replace(b"<</Type /Catalog /Pages 2 0 R>>", tree)
    (im,) = P.rows_of("f", data, "images")
    assert im[2:7] == (0, 72.0, 242.0, 172.0, 292.0)
    assert im[7:10] == (2, 1, "png")
    assert im[10].startswith(b"\x89PNG")
    fonts = list(P.rows_of("f", data, "fonts"))
    assert fonts[0][2:6] == ("Serif", 700, True, 10.0)
    assert [f[6] for f in fonts] == ["Tagged head", "plain"]
    (tag,) = P.rows_of("f", data, "tags")
    assert tag[2:6] == (0, "H1", "Alt", None)
    assert tag[6] == 72.0
    (tmp_path / "a.pdf").write_bytes(data)
    (r,) = files.write_images(P.read_pdf(spark, str(tmp_path / "a.pdf"), "images"), str(tmp_path / "out")).collect()
    assert r.image_path.endswith("a/page1_img1.png")
    assert open(r.image_path, "rb").read() == im[10]
