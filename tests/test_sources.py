import io
import zipfile

import pytest

from tarnlight.sources import blocks, files


def test_markdown():
    text = "---\ntags: [alpha, beta]\n---\nintro [[Page|shown]] and [[Other]]\n# One\nbody\n## Two\nmore"
    parts = blocks.markdown_parts(text)
    assert [p for p, _ in parts] == ["Intro", "One", "Two"]
    assert parts[0][1].startswith("intro shown and Other") and all(t.endswith("Keywords: alpha, beta") for _, t in parts)
    assert blocks.markdown_parts(None) == [] and blocks.markdown_parts("  ") == []


def test_chunks_cover_the_text():
    text = " ".join(f"word{i}" for i in range(2000))
    pieces = blocks.chunk_text(text, 500, 100)
    assert all(50 < len(p) <= 500 for p in pieces) and all(f"word{i}" in " ".join(pieces) for i in range(2000))
    assert blocks.chunk_text("") == [] and len(blocks.chunk_text("x" * 5000)) > 3
    with pytest.raises(ValueError):
        blocks.chunk_text("a", 300, 200)


def test_html_org_text():
    html = "<html><head><title>t</title></head><body><script>x()</script><h1>A</h1><p>one</p><h2>B</h2><p>two<br>three</p></body></html>"
    assert files.html_parts(html) == [("A", "A\none"), ("B", "B\ntwo\nthree")]
    assert [p for p, _ in files.file_parts("a.org", b"start\n* First\nx\n** Second\ny")] == ["Intro", "First", "Second"]
    assert [p for p, _ in files.file_parts("a.txt", b"Chapter 1\nx\nChapter 2\ny")] == ["Chapter 1", "Chapter 2"]
    with pytest.raises(ValueError):
        files.file_parts("a.xyz", b"")


def archive(entries):
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        for name, text in entries.items():
            z.writestr(name, text)
    return buffer.getvalue()


def test_docx_and_epub():
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    p = lambda t: f"<w:p><w:r><w:t>{t}</w:t></w:r></w:p>"
    data = archive({"word/document.xml": f"<w:document {w}><w:body>{p('Chapter One')}{p('Text.')}</w:body></w:document>"})
    assert files.docx_parts(data) == [("Chapter One", "Text.")]
    page = "<html><body><h1>{0}</h1><p>text</p></body></html>"
    book = archive({"b.xhtml": page.format("Second"), "a.xhtml": page.format("First")})
    assert [t for t, _ in files.epub_parts(book)] == ["First", "Second"]


def test_scan_and_ingest(spark, tmp_path):
    (tmp_path / "a.md").write_text("# T\nbody")
    (tmp_path / "copy.md").write_text("# T\nbody")
    (tmp_path / "b.docx").write_bytes(b"broken")
    (tmp_path / "c.bin").write_text("no")
    (tmp_path / ".hidden").mkdir()
    (tmp_path / ".hidden" / "d.md").write_text("# no")
    found = files.scan_files(spark, str(tmp_path))
    assert found.count() == 3
    none = spark.createDataFrame([], "checksum string")
    assert files.ingest(found, none).count() == 1
    assert files.ingest(found, found.select("checksum")).count() == 0
