"""Writers: event partitions, logs, and the TXT, Markdown and EPUB forms of a book."""

from __future__ import annotations

import json
import os
import zipfile
from collections.abc import Iterable
from pathlib import Path
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DECISIONS = ("structure", "character", "plot", "style", "rule", "other")


def write_events(events: DataFrame, path: str) -> None:
    """Write events partitioned by (book, chapter), replacing just the chapters they hold: doing it twice changes nothing.

    A chapter's events go to one task, so that it has one file and not one per task.
    """
    events.repartition("book", "chapter").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("book", "chapter").parquet(path)


def drop_chapter(events: DataFrame, path: str, book: str, chapter: int) -> None:
    """Undo a chapter: its partition is removed, every view over the events follows."""
    jvm = events.sparkSession._jvm
    named = jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(book)
    p = jvm.org.apache.hadoop.fs.Path(f"{path}/book={named}/chapter={chapter}")
    p.getFileSystem(events.sparkSession._jsc.hadoopConfiguration()).delete(p, True)


def apply_chapters(analyses: DataFrame, violations: DataFrame, path: str, errors_path: str | None = None, shown: int = 100) -> list[tuple]:
    """Write analyses unless a check finds an error, else nothing.

    Returns the first `shown` errors to look at; all of them go to `errors_path` if it is given.
    """
    errors = violations.where("severity = 'E'")
    first = [tuple(r) for r in errors.limit(shown).collect()]
    if not first:
        write_events(analyses, path)
    elif errors_path:
        errors.write.mode("overwrite").parquet(errors_path)
    return first


def write_json(rows: DataFrame, path: str) -> None:
    """Replace a ledger of JSON lines at `path` as a whole: written beside it first, then moved, so that a failed job leaves the old one."""
    spark = rows.sparkSession
    tmp = f"{path}.new"
    rows.write.mode("overwrite").json(tmp)
    hadoop = spark._jvm.org.apache.hadoop.fs
    fs = hadoop.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    fs.delete(hadoop.Path(path), True)
    if not fs.rename(hadoop.Path(tmp), hadoop.Path(path)):
        raise OSError(f"could not move {tmp} to {path}")


def write_snapshot(state: DataFrame, path: str) -> None:
    """Write states (book, chapter, character_id, state_key, value), a partition per book and chapter; doing it twice changes nothing."""
    write_events(state, path)


def write_anchors(anchors: DataFrame, path: str) -> None:
    """Write the anchors that a corpus gave; refused if it was too small to give all of them."""
    row = anchors.first()
    if row is None or row["origin"] != "corpus":
        raise ValueError("the corpus is too small for anchors")
    _replace(path, lambda tmp: Path(tmp).write_text(json.dumps(row.asDict(), ensure_ascii=False), encoding="utf-8"))


def scaffold(spark: SparkSession, folder: str, schemas: dict[str, str]) -> list[str]:
    """Make the missing tables of a new project as empty parquet; tables that exist are never touched. Returns what was made."""
    made = []
    hadoop = spark._jvm.org.apache.hadoop.fs
    for name, schema in schemas.items():
        p = hadoop.Path(f"{folder}/{name}.parquet")
        if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
            spark.createDataFrame([], schema).write.parquet(f"{folder}/{name}.parquet")
            made.append(name)
    return made


def append_decisions(rows: DataFrame, path: str) -> None:
    """Append to the log of decisions; an unknown type fails before anything is written."""
    bad = rows.where(~F.col("type").isin(*DECISIONS) | F.col("type").isNull()).limit(1).collect()
    if bad:
        raise ValueError(f"unknown type of decision: {bad[0]['type']}")
    rows.write.mode("append").json(path)


def _bodies(chapters: DataFrame, first: int | None, last: int | None) -> Iterable[tuple[int, str, str]]:
    """(n, title, body) of one book's chapters in order, fetched one partition at a time."""
    c = chapters.select("n", "text").where("text is not null")
    if first is not None:
        c = c.where(F.col("n") >= first)
    if last is not None:
        c = c.where(F.col("n") <= last)
    for n, text in c.orderBy("n").toLocalIterator():
        head, _, body = text.partition("\n")
        if head.lstrip().startswith("#"):
            yield n, head.lstrip("# ").strip(), body.strip()
        else:
            yield n, f"{n}", text.strip()


def missing(chapters: DataFrame, first: int, last: int) -> DataFrame:
    """Numbers in [first, last] without a chapter."""
    want = chapters.sparkSession.range(first, last + 1).select(F.col("id").cast("int").alias("n"))
    return want.join(chapters.select("n"), "n", "left_anti")


def _replace(path: str, write) -> None:  # noqa: ANN001
    """Write beside the target and rename, so that a reader never meets half a file."""
    tmp = f"{path}.tmp"
    write(tmp)
    os.replace(tmp, path)


def export_txt(chapters: DataFrame, path: str, title: str, first: int | None = None, last: int | None = None, markdown: bool = False) -> None:
    """One book as text, or as Markdown with a heading per chapter."""
    def write(tmp: str) -> None:
        with open(tmp, "w", encoding="utf-8") as f:
            f.write(f"# {title}\n" if markdown else f"{title}\n{'=' * 20}\n")
            for _, head, body in _bodies(chapters, first, last):
                f.write(f"\n## {head}\n\n{body}\n" if markdown else f"\n{head}\n\n{body}\n")

    _replace(path, write)


def xhtml(title: str, body: str) -> str:
    """A chapter as XHTML; text is escaped before line ends become tags."""
    paras = "".join(f"<p>{escape(p.strip()).replace(chr(10), '<br/>')}</p>" for p in body.split("\n\n") if p.strip())
    return f'<?xml version="1.0" encoding="utf-8"?><html xmlns="http://www.w3.org/1999/xhtml"><head><title>{escape(title)}</title><link rel="stylesheet" type="text/css" href="style.css"/></head><body><h1>{escape(title)}</h1>{paras}</body></html>'


CSS = "body{margin:5%;line-height:1.6}h1{font-size:1.3em;text-align:center}p{text-indent:2em;margin:0}"


def export_epub(chapters: DataFrame, path: str, title: str, language: str = "zh", modified: str = "2000-01-01T00:00:00Z", whole: bool = False) -> None:
    """One book as EPUB: the mimetype first and stored, then container, package, navigation, title page, style and chapters.

    whole: refuse a book with a missing chapter between its first and its last.
    """
    if whole:
        ends = chapters.where("text is not null").agg(F.min("n"), F.max("n")).first()
        gap = missing(chapters.where("text is not null"), ends[0], ends[1]).orderBy("n").first() if ends[0] is not None else None
        if gap:
            raise ValueError(f"chapter {gap[0]} is missing")

    def write(tmp: str) -> None:
        with zipfile.ZipFile(tmp, "w", zipfile.ZIP_DEFLATED) as z:
            z.writestr(zipfile.ZipInfo("mimetype"), "application/epub+zip", zipfile.ZIP_STORED)
            z.writestr("META-INF/container.xml", '<?xml version="1.0"?><container version="1.0" xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="OEBPS/content.opf" media-type="application/oebps-package+xml"/></rootfiles></container>')
            z.writestr("OEBPS/style.css", CSS)
            z.writestr("OEBPS/title.xhtml", xhtml(title, ""))
            names = []
            for n, head, body in _bodies(chapters, None, None):
                names.append((f"c{n:03d}", head))
                z.writestr(f"OEBPS/c{n:03d}.xhtml", xhtml(head, body))
            items = "".join(f'<item id="{i}" href="{i}.xhtml" media-type="application/xhtml+xml"/>' for i, _ in [("title", ""), *names])
            spine = "".join(f'<itemref idref="{i}"/>' for i, _ in [("title", ""), *names])
            z.writestr("OEBPS/content.opf", f'<?xml version="1.0"?><package xmlns="http://www.idpf.org/2007/opf" version="3.0" unique-identifier="id"><metadata xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:identifier id="id">{escape(title)}</dc:identifier><dc:title>{escape(title)}</dc:title><dc:language>{language}</dc:language><meta property="dcterms:modified">{modified}</meta></metadata><manifest><item id="nav" href="nav.xhtml" media-type="application/xhtml+xml" properties="nav"/><item id="css" href="style.css" media-type="text/css"/>{items}</manifest><spine>{spine}</spine></package>')
            links = "".join(f'<li><a href="{i}.xhtml">{escape(h)}</a></li>' for i, h in names)
            z.writestr("OEBPS/nav.xhtml", f'<?xml version="1.0"?><html xmlns="http://www.w3.org/1999/xhtml" xmlns:epub="http://www.idpf.org/2007/ops"><body><nav epub:type="toc"><ol>{links}</ol></nav></body></html>')

    _replace(path, write)


def report(df: DataFrame, path: str, title: str) -> None:
    """A result as a Markdown table, whole, fetched one partition at a time."""
    def write(tmp: str) -> None:
        with open(tmp, "w", encoding="utf-8") as f:
            f.write(f"# {title}\n\n| " + " | ".join(df.columns) + " |\n|" + "---|" * len(df.columns) + "\n")
            for r in df.toLocalIterator():
                f.write("| " + " | ".join("" if v is None else str(v).replace("|", "\\|").replace("\n", " ") for v in r) + " |\n")

    _replace(path, write)
