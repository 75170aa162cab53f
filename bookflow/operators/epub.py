"""E-book packages, right to left: written book by book as their chapters arrive, with a manifest of what was written."""

from __future__ import annotations

import uuid
import zipfile
from collections.abc import Iterator
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MANIFEST = "novel_id long, path string, n_chapters int, n_bytes long"
STYLE = "body { direction: rtl; text-align: right; line-height: 1.8; }"


def _page(head: str, inner: str) -> str:
    return f'<?xml version="1.0" encoding="utf-8"?><html xmlns="http://www.w3.org/1999/xhtml" lang="ar" dir="rtl"><head><title>{escape(head)}</title><link rel="stylesheet" href="../style.css"/></head><body>{inner}</body></html>'


class Package:
    """One package, written to a stream: the type first and uncompressed, then chapters as they come, contents and navigation last.

    It holds the names and titles of its chapters, never their texts. ``file`` need not seek."""

    def __init__(self, file, novel_id: int, title: str, author: str | None = None, description: str | None = None, cover: bytes | None = None):
        self.novel_id, self.title, self.author, self.cover = novel_id, title, author or "", cover
        self.chapters: list[tuple[str, str]] = []
        self.seen: dict[str, int] = {}
        self.zip = zipfile.ZipFile(file, "w", zipfile.ZIP_DEFLATED)
        self.zip.writestr(zipfile.ZipInfo("mimetype"), "application/epub+zip", zipfile.ZIP_STORED)
        self.zip.writestr("META-INF/container.xml", '<?xml version="1.0"?><container version="1.0" xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="OEBPS/content.opf" media-type="application/oebps-package+xml"/></rootfiles></container>')
        self.zip.writestr("OEBPS/style.css", STYLE)
        image = ""
        if cover:
            self.zip.writestr("OEBPS/cover.jpg", cover)
            image = '<img src="../cover.jpg" alt=""/>'
        by = f"<p>{escape(self.author)}</p>" if self.author else ""
        about = "".join(f"<p>{escape(p.strip())}</p>" for p in (description or "").split("\n") if p.strip())
        self.zip.writestr("OEBPS/text/cover.xhtml", _page(title, f"{image}<h1>{escape(title)}</h1>{by}{about}"))

    def add(self, name: str, title: str, html: str) -> None:
        """A chapter; a name that occurred before gets a suffix."""
        self.seen[name] = self.seen.get(name, 0) + 1
        if self.seen[name] > 1:
            name = name.replace(".xhtml", f"_{self.seen[name]}.xhtml")
        self.chapters.append((name, title))
        self.zip.writestr("OEBPS/" + name, _page(title, f"<h2>{escape(title)}</h2>{html}"))

    def close(self) -> None:
        names = ["text/cover.xhtml", *[n for n, _ in self.chapters]]
        items = "".join(f'<item id="i{i}" href="{n}" media-type="application/xhtml+xml"/>' for i, n in enumerate(names))
        image = '<item id="image" href="cover.jpg" media-type="image/jpeg" properties="cover-image"/>' if self.cover else ""
        spine = '<itemref idref="nav"/>' + "".join(f'<itemref idref="i{i}"/>' for i in range(len(names)))
        self.zip.writestr(
            "OEBPS/content.opf",
            '<?xml version="1.0" encoding="utf-8"?><package xmlns="http://www.idpf.org/2007/opf" version="3.0" unique-identifier="id"><metadata xmlns:dc="http://purl.org/dc/elements/1.1/">'
            f'<dc:identifier id="id">novel-{self.novel_id}</dc:identifier><dc:title>{escape(self.title)}</dc:title><dc:language>ar</dc:language><dc:creator>{escape(self.author)}</dc:creator></metadata>'
            f'<manifest><item id="nav" href="nav.xhtml" media-type="application/xhtml+xml" properties="nav"/><item id="css" href="style.css" media-type="text/css"/>{image}{items}</manifest><spine page-progression-direction="rtl">{spine}</spine></package>',
        )
        toc = "".join(f'<li><a href="{n}">{escape(t)}</a></li>' for n, t in self.chapters)
        self.zip.writestr("OEBPS/nav.xhtml", f'<?xml version="1.0" encoding="utf-8"?><html xmlns="http://www.w3.org/1999/xhtml" xmlns:epub="http://www.idpf.org/2007/ops"><head><title>{escape(self.title)}</title></head><body><nav epub:type="toc"><ol>{toc}</ol></nav></body></html>')
        self.zip.close()


def covers(images: DataFrame, novels: DataFrame) -> DataFrame:
    """(novel_id, cover): images read as files (path, content), by the last part of the book's cover address; books without one have none."""
    name = lambda c: F.regexp_extract(c, "([^/?#]+)(?:[?#].*)?$", 1)
    found = images.groupBy(name(F.col("path")).alias("_name")).agg(F.min_by("content", "path").alias("cover"))
    return novels.where("cover_url is not null").select(F.col("id").alias("novel_id"), name(F.col("cover_url")).alias("_name")).join(found, "_name").select("novel_id", "cover")


def written_packages(chapters: DataFrame, novels: DataFrame, folder: str, images: DataFrame | None = None) -> DataFrame:
    """Writes a package for each book and returns the manifest; a book without chapters has none.

    ``chapters``: novel_id, place, file_name, title, html. ``images``: novel_id, cover. ``folder`` is an address that all
    executors share, of any kind that Arrow's file systems open; another is an error. A package is one file and so one
    task, but chapters pass through it in order and one batch at a time, so no book is held in memory. The file's name has
    the book's id, so equal titles don't overwrite one another; a task that runs twice writes the same file."""

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        files, root = fs.FileSystem.from_uri(folder)
        files.create_dir(root, recursive=True)
        book: Package | None = None
        stream = part = path = None

        def finished() -> pd.DataFrame:
            book.close()
            stream.close()
            files.move(part, path)
            return pd.DataFrame([(book.novel_id, path, len(book.chapters), files.get_file_info(path).size)], columns=["novel_id", "path", "n_chapters", "n_bytes"])

        for b in batches:
            for r in b.itertuples(index=False):
                if book is None or book.novel_id != r.novel_id:
                    if book is not None:
                        yield finished()
                    path = f"{root}/{int(r.novel_id)}.epub"
                    part = f"{path}.{uuid.uuid4().hex}.part"
                    stream = files.open_output_stream(part)
                    book = Package(stream, int(r.novel_id), r.book or "", r.author, r.description, r.cover)
                book.add(r.file_name, r.title or "", r.html or "")
        if book is not None:
            yield finished()

    books = novels.select(F.col("id").alias("novel_id"), F.col("title").alias("book"), "author", "description")
    books = books.join(images, "novel_id", "left") if images is not None else books.withColumn("cover", F.lit(None).cast("binary"))
    # the book's own columns travel with its first chapter only
    first = F.col("place") == 1
    rows = chapters.select("novel_id", "place", "file_name", "title", "html").join(books, "novel_id")
    rows = rows.select("novel_id", "place", "file_name", "title", "html", "book", *[F.when(first, F.col(c)).alias(c) for c in ("author", "description", "cover")])
    return rows.repartition("novel_id").sortWithinPartitions("novel_id", "place", "file_name").mapInPandas(write, MANIFEST)
