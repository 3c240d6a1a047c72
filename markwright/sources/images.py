"""Scanned sheets: files to pages to recognised words. Renderers and recognisers are functions the caller gives.

A renderer takes a file's bytes and yields one image (bytes) a page. A recogniser takes an image and language hints and yields
(block number, word, confidence or None). A file that fails gives one row with the error and no text; the others go on."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Endings of the files that are read, and the shortest block that is kept.
IMAGES, SHORTEST_BLOCK = ("jpg", "jpeg", "png", "bmp", "tiff", "tif", "webp", "gif"), 5


def scan(spark: SparkSession, folder: str, pdf: bool = True) -> DataFrame:
    """path, content of each image (and PDF) in a folder."""
    endings = (*IMAGES, *(("pdf",) if pdf else ()))  # in the glob, so that other files are listed but not read
    glob = ",".join("".join(f"[{c}{c.upper()}]" for c in e) for e in endings)
    return spark.read.format("binaryFile").option("pathGlobFilter", f"*.{{{glob}}}").load(folder).select("path", "content")


def pages(files: DataFrame, render: Callable[[bytes], Iterable[bytes]] | None = None) -> DataFrame:
    """path, page (from 1), image, error. PDFs need `render`; an image is its own page."""

    def work(batches):
        import pandas as pd

        for b in batches:
            for path, content in zip(b["path"], b["content"], strict=True):
                rows = []
                try:
                    if path.lower().endswith(".pdf"):
                        if render is None:
                            raise ValueError("no renderer for PDF files was given")
                        rows = [(path, k, i, None) for k, i in enumerate(render(content), 1)]
                    else:
                        rows = [(path, 1, content, None)]
                except Exception as e:  # one bad file must not end the batch
                    rows = [(path, 0, None, f"{type(e).__name__}: {e}")]
                yield pd.DataFrame(rows, columns=["path", "page", "image", "error"])

    return files.select("path", "content").mapInPandas(work, "path string, page int, image binary, error string")


def recognised(images: DataFrame, recognise: Callable, hints: tuple[str, ...] = ("ta", "en"), prepare: Callable[[bytes], bytes] | None = None) -> DataFrame:
    """path, page, words (block, word, confidence), error. `prepare` may straighten or sharpen an image first."""

    def work(batches):
        import pandas as pd

        for b in batches:
            out = []
            for path, page, image, error in b[["path", "page", "image", "error"]].itertuples(index=False):
                words = []
                if error is None:
                    try:
                        words = [{"block": x, "word": w, "confidence": c} for x, w, c in recognise(prepare(image) if prepare else image, list(hints))]
                    except Exception as e:
                        error = f"{type(e).__name__}: {e}"
                out.append((path, page, words, error))
            yield pd.DataFrame(out, columns=["path", "page", "words", "error"])

    return images.mapInPandas(work, "path string, page int, words array<struct<block: int, word: string, confidence: double>>, error string")


def page_text(found: DataFrame) -> DataFrame:
    """path, page, full_text, blocks, confidence, word_count, error. Blocks under SHORTEST_BLOCK characters go; confidence is
    the mean over words that have one other than zero, at four digits (0 if none has)."""
    numbers = F.array_sort(F.array_distinct(F.transform("words", lambda w: w["block"])))
    texts = F.transform(numbers, lambda b: F.array_join(F.transform(F.filter("words", lambda w: w["block"] == b), lambda w: w["word"]), " "))
    known = F.filter(F.transform("words", lambda w: w["confidence"]), lambda c: c.isNotNull() & (c != 0))
    mean = F.aggregate(known, F.lit(0.0), lambda a, x: a + x) / F.greatest(F.size(known), F.lit(1))
    return found.select("path", "page", F.array_join(texts, "\n").alias("full_text"), F.filter(texts, lambda t: F.length(t) >= SHORTEST_BLOCK).alias("blocks"), F.round(mean, 4).alias("confidence"), F.size("words").alias("word_count"), "error")


def folder_text(spark: SparkSession, folder: str, recognise: Callable, render: Callable | None = None, hints: tuple[str, ...] = ("ta", "en")) -> DataFrame:
    """The text of a folder's files by path and page."""
    return page_text(recognised(pages(scan(spark, folder), render), recognise, hints)).orderBy("path", "page")
