"""Papers: text of PDF pages, chunks, figures, tables and region proposals; sizes of images."""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from talkgraph.functions import text as X

_STREAM = re.compile(rb"<<(.*?)>>\s*stream\r?\n(.*?)\r?\nendstream", re.S)
_SHOWN = re.compile(rb"\((?:\\.|[^\\()])*\)|<[0-9A-Fa-f\s]+>|T\*|Td|TD|Tm|'|\"|ET")
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


def _literal(token: bytes) -> str:
    if token[:1] == b"<":
        digits = re.sub(rb"\s", b"", token[1:-1])
        raw = bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
        return raw.decode("utf-16-be", "ignore") if raw[:2] == b"\xfe\xff" else raw.decode("latin-1")
    one = lambda m: bytes([int(m[1], 8) & 255]) if m[1][:1].isdigit() else _ESCAPES.get(m[1], m[1])
    return re.sub(rb"\\([0-7]{1,3}|.)", one, token[1:-1], flags=re.S).decode("latin-1")


def pdf_pages(content: bytes | None) -> list[str]:
    """Text of each content stream of a PDF that shows text, in order: literal and hexadecimal strings of simple encodings.

    Null, broken and scanned files have no pages; fonts with encodings of their own need a provider.
    """
    pages = []
    for head, body in _STREAM.findall(content or b""):
        if b"/Subtype" in head or b"/FontFile" in head:
            continue
        if b"FlateDecode" in head:
            try:
                body = zlib.decompress(body)
            except zlib.error:
                continue
        if b"BT" not in body:
            continue
        out: list[str] = []
        for token in _SHOWN.findall(body):
            if token[:1] in b"(<":
                out.append(_literal(token))
            elif out and not out[-1].endswith("\n"):
                out.append("\n")
        if text := "".join(out).strip():
            pages.append(text)
    return pages


def page_texts(files: DataFrame, key: str, content: str, reader: Callable[[bytes | None], list[str]] = pdf_pages) -> DataFrame:
    """(key, page, text) of PDFs, pages from 1; a file without text has none. reader may be another provider; one that fails gives none."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for k, c in zip(part[key], part[content]):
                try:
                    rows += [(k, n, t) for n, t in enumerate(reader(None if c is None else bytes(c)), 1)]
                except Exception:  # noqa: BLE001
                    continue
            yield pd.DataFrame(rows, columns=[key, "page", "text"])

    return files.select(key, content).mapInPandas(run, f"`{key}` string, page int, text string")


def chunks(pages: DataFrame, most: int = 900) -> DataFrame:
    """(sample_id, page, ci, chunk_id, text) of pages (sample_id, page, text): sentences packed into chunks, numbered through
    the paper; a page without text has one empty chunk."""
    packed = X.packed(X.sentences(F.coalesce("text", F.lit(""))), most)
    c = pages.select("sample_id", "page", F.posexplode(F.when(F.size(packed) > 0, packed).otherwise(F.array(F.lit("")))).alias("ci", "text"))
    n = F.row_number().over(Window.partitionBy("sample_id").orderBy("page", "ci")) - 1
    return c.select("sample_id", "page", "ci", F.concat("sample_id", F.lit("/paper_chunk/"), F.lpad(n.cast("string"), 4, "0")).alias("chunk_id"), "text")


def floats(chunk_rows: DataFrame) -> DataFrame:
    """(sample_id, kind, float_id, page, caption): figures and tables that chunks speak of."""
    low = F.lower("text")
    kinds = F.array_compact(F.array(*(F.when(F.contains(low, F.lit(k)), k) for k in ("figure", "table"))))
    x = chunk_rows.select("sample_id", "page", "ci", "text", F.explode(kinds).alias("kind"))
    return x.select("sample_id", "kind", F.concat("sample_id", F.lit("/"), "kind", F.lit("/"), F.lpad(F.col("page").cast("string"), 3, "0"), F.lit("_"), F.lpad(F.col("ci").cast("string"), 2, "0")).alias("float_id"), "page", F.substring("text", 1, 200).alias("caption"))


#: Region proposals: name -> (rank, hint, left, top, right, bottom as shares, when: always, figure, table or neither) (fixed values).
PROPOSALS = {
    "page_full": (100, "Mixed", 0.0, 0.0, 1.0, 1.0, "always"), "figure_main": (95, "Figure", 0.05, 0.08, 0.95, 0.58, "figure"), "table_main": (94, "Table", 0.05, 0.42, 0.95, 0.95, "table"),
    "center_band": (85, "Mixed", 0.10, 0.20, 0.90, 0.85, "always"), "upper_large": (82, "Mixed", 0.05, 0.08, 0.95, 0.58, "neither"), "lower_large": (81, "Mixed", 0.05, 0.42, 0.95, 0.95, "neither"),
    "figure_left": (80, "Figure", 0.05, 0.20, 0.52, 0.88, "figure"), "table_right": (79, "Table", 0.48, 0.20, 0.95, 0.88, "table"),
}


def region_proposals(pages: DataFrame, per_page: int = 4) -> DataFrame:
    """(sample_id, page, n, region_type, hint, x0, y0, x1, y1) of pages (sample_id, page, text, width, height): the likeliest regions, no box twice."""
    low = F.lower(F.coalesce("text", F.lit("")))
    has = lambda *ws: sum(((F.contains(low, F.lit(w))).cast("int") for w in ws), F.lit(0)) > 0
    fig, tab = has("figure", "fig."), has("table", "tab.")
    when = {"always": F.lit(True), "figure": fig, "table": tab, "neither": ~fig & ~tab}
    side = lambda share, c: F.floor(F.lit(share) * F.col(c)).cast("int")
    made = F.array_compact(F.array(*(F.when(when[w], F.struct(F.lit(-r).alias("r"), F.lit(k).alias("region_type"), F.lit(h).alias("hint"), side(a, "width").alias("x0"), side(b, "height").alias("y0"), side(c, "width").alias("x1"), side(d, "height").alias("y1"))) for k, (r, h, a, b, c, d, w) in PROPOSALS.items())))
    x = pages.select("sample_id", "page", F.explode(F.array_sort(made)).alias("p")).select("sample_id", "page", "p.*")
    first = x.groupBy("sample_id", "page", "x0", "y0", "x1", "y1").agg(F.min(F.struct("r", "region_type", "hint")).alias("f")).select("sample_id", "page", "f.*", "x0", "y0", "x1", "y1")
    w = Window.partitionBy("sample_id", "page").orderBy("r")
    return first.withColumn("n", F.row_number().over(w)).where(F.col("n") <= max(1, per_page)).drop("r")


def image_size(content: bytes | None) -> tuple[int, int]:
    """(width, height) from the header of a PNG or JPEG; 1000 x 1000 for anything else."""
    b = content or b""
    if b[:8] == b"\x89PNG\r\n\x1a\n" and len(b) >= 24:
        return int.from_bytes(b[16:20], "big"), int.from_bytes(b[20:24], "big")
    if b[:2] == b"\xff\xd8":
        at = 2
        while at + 9 < len(b):
            if b[at] != 0xFF:
                at += 1
                continue
            mark = b[at + 1]
            if 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC):
                return int.from_bytes(b[at + 7 : at + 9], "big"), int.from_bytes(b[at + 5 : at + 7], "big")
            if mark == 0xFF or mark == 0x01 or 0xD0 <= mark <= 0xD9:
                at += 1 if mark == 0xFF else 2
                continue
            at += 2 + int.from_bytes(b[at + 2 : at + 4], "big")
    return 1000, 1000


def image_sizes(files: DataFrame, key: str, content: str) -> DataFrame:
    """(key, width, height) of image files; only their first 64 KB are looked at."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            sizes = [image_size(None if c is None else bytes(c)) for c in part["_c"]]
            yield pd.DataFrame({key: part[key], "width": [s[0] for s in sizes], "height": [s[1] for s in sizes]})

    return files.select(key, F.substring(content, 1, 65536).alias("_c")).mapInPandas(run, f"`{key}` string, width int, height int")


def native_context(parts: dict[str, Column], most: int) -> Column:
    """Titled parts one after the other, those without text left out, cut at ``most`` characters with a note."""
    titled = [F.when(F.length(F.coalesce(c, F.lit(""))) > 0, F.concat(F.lit(f"=== {t} ===\n"), c)) for t, c in parts.items()]
    whole = F.concat_ws("\n\n", *titled)
    return F.when(F.length(whole) > most, F.concat(F.substring(whole, 1, most), F.lit("\n\n[...truncated...]"))).otherwise(whole)


def multimodal_messages(parts: dict[str, Column], images: Column, question: Column, most_chars: int, most_images: int = 3) -> Column:
    """One user message as JSON: the titled texts (cut at ``most_chars``), the first images (array of PNG bytes) as data URLs,
    then the question. Null and empty parts are left out; the number of images is what a model takes."""
    text = lambda c: F.struct(F.lit("text").alias("type"), c.alias("text"), F.lit(None).cast("struct<url:string>").alias("image_url"))
    picture = lambda b: F.struct(F.lit("image_url").alias("type"), F.lit(None).cast("string").alias("text"), F.struct(F.concat(F.lit("data:image/png;base64,"), F.base64(b)).alias("url")).alias("image_url"))
    drawn = F.transform(F.slice(F.filter(F.coalesce(images, F.array().cast("array<binary>")), lambda b: b.isNotNull()), 1, most_images), picture)
    content = F.concat(F.array(text(native_context(parts, most_chars))), drawn, F.array(text(F.concat(F.lit("Question: "), question, F.lit("\nAnswer:")))))
    return F.to_json(F.array(F.struct(F.lit("user").alias("role"), content.alias("content"))))
