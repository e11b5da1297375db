"""File sources: dispatch, text, documents, mail and attachments."""

import hashlib
import io
import zipfile
from email.message import EmailMessage

from locatext.sources import files

W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def docx(body):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {W}><w:body>{body}</w:body></w:document>")
    return out.getvalue()


def p(text):
    return f"<w:p><w:r><w:t>{text}</w:t></w:r></w:p>"


def mail():
    m = EmailMessage()
    m["Subject"], m["From"], m["To"] = "RFI 42", "A <a@x.example>", "b@x.example"
    m["Message-ID"], m["In-Reply-To"] = "<One@x>", "<zero@x>"
    m.set_content("Please see.\n-- \nA Person\nOn Monday B wrote:\n> old text\n")
    m.add_alternative("<p>Please <b>see</b>.</p>", subtype="html")
    m.add_attachment(b"abc", maintype="application", subtype="pdf", filename="plan.pdf")
    return m.as_bytes()


def test_every_file_is_parsed_or_says_why_not(spark, tmp_path):
    data = {
        "a.txt": "\ufeffone\n\ntwo".encode(),
        "b.txt": "drei\n".encode("utf-16"),
        "c.txt": b"\xff\x00bad\xfa",
        "d.docx": docx(p("First") + f"<w:tbl><w:tr><w:tc>{p('x')}</w:tc><w:tc>{p('y')}</w:tc></w:tr></w:tbl>" + p("Last") + "<w:p><w:ins><w:r><w:t>new</w:t></w:r></w:ins></w:p>"),
        "e.docx": b"no archive",
        "f.xyz": b"?",
        "g.html": b"<p>a</p><script>b</script><p>c",
        "h.eml": mail(),
        "i.txt": b"",
        "noname": b"x",
    }
    for name, content in data.items():
        (tmp_path / name).write_bytes(content)
    rows = files.read_files(spark, str(tmp_path)).collect()
    by = {}
    for r in sorted(rows, key=lambda r: (r["file_name"], r["ord"])):
        assert r["sha256"] == hashlib.sha256(data[r["file_name"]]).hexdigest()
        by.setdefault(r["file_name"], []).append((r["status"], r["locator"], r["raw_text"]))
    assert set(by) == set(data) - {"i.txt"}  # Spark lists no file of no bytes
    assert by["a.txt"] == [("PARSED", "line 1", "one"), ("PARSED", "line 3", "two")] and by["b.txt"] == [("PARSED", "line 1", "drei")]
    assert by["c.txt"] == [("FAILED", None, None)] == by["e.docx"]
    assert files.parse_file("i.txt", b"")[0]["status"] == "EMPTY"
    assert by["f.xyz"] == by["noname"] == [("UNSUPPORTED", None, None)]
    assert [x[1:] for x in by["d.docx"]] == [("Paragraph 1", "First"), ("Table 1 row 1", "x | y"), ("Paragraph 2", "Last"), ("Paragraph 3", "new")]
    assert next(r for r in rows if r["file_name"] == "d.docx")["warnings"] == ["TRACKED_CHANGES"]
    assert [x[2] for x in by["g.html"]] == ["a", "c"]
    parts = {x[1]: x[2] for x in by["h.eml"]}
    assert parts["EMAIL > BODY"] == "Please see." and parts["EMAIL > SIGNATURE"].endswith("A Person") and "old text" in parts["EMAIL > QUOTED HISTORY"]
    assert parts["EMAIL > THREAD > PARENT"] == files.message_key(" <ZERO@x> ")
    assert parts["EMAIL > ATTACHMENT 1"] == f"plan.pdf | application/pdf | {hashlib.sha256(b'abc').hexdigest()} | 3"


def test_archives_that_unpack_to_too_much_are_refused():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("word/document.xml", "<a>" + " " * 3_000_000 + "</a>")
    assert files.parse_file("x.docx", out.getvalue())[0]["warnings"] == ["ARCHIVE_TOO_LARGE"]
    assert files.parse_file("x.docx", docx(p("x")))[0]["status"] == "PARSED"


def test_attachments_are_imported_by_place_and_digest(spark):
    mails = spark.createDataFrame([("h.eml", mail()), ("empty.eml", b"")], "file_name string, content binary")
    right = hashlib.sha256(b"abc").hexdigest()
    wanted = spark.createDataFrame([("h.eml", 1, right), ("h.eml", 1, right), ("h.eml", 2, right), ("h.eml", 1, "other")], "file_name string, index int, sha256 string")
    got = files.import_attachments(mails, wanted).collect()
    assert [(r["name"], bytes(r["content"])) for r in got] == [("plan.pdf", b"abc")]
