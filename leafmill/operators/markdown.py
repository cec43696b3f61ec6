"""Pages as Markdown, from their events."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmill.functions.urls import absolute_one
from leafmill.operators.selectors import matching
from leafmill.operators.tokenizer import ENTER, EXIT, TEXT, events

_SKIPPED = frozenset("head noscript script style svg template title button select option textarea".split())
_BLOCK = frozenset("address article aside blockquote dd details div dl dt fieldset figcaption figure footer form header hr main nav p section summary table ul ol".split())


def to_markdown(html: str, url: str, exclude: str | None = None, isolate_main: bool = False, origin: str | None = None) -> str:
    """Headings, paragraphs, links, images, emphasis, code, lists, quotes and tables of a page."""
    found = events(html or "")
    base = url
    for e in found:
        if e[0] == ENTER and e[2] == "base" and e[3].get("href", "").strip():
            base = absolute_one(e[3]["href"], url)
            break
    base = origin or base
    excluded = matching(found, exclude) if exclude else set()
    mains = {e[1] for e in found if e[0] == ENTER and e[2] == "main"} if isolate_main else set()
    out: list[str] = []
    opened: dict[int, tuple[int, dict]] = {}
    lists: list[list] = []
    cells: list[str] = []
    quotes = 0

    def block() -> None:
        while out and out[-1].endswith(" ") and not out[-1].strip():
            out.pop()
        text = "".join(out[-3:])
        if out and not text.endswith("\n\n"):
            out.append("\n\n" if not text.endswith("\n") else "\n")

    def cut(node: int) -> str:
        at, _ = opened[node]
        text = "".join(out[at:])
        del out[at:]
        return text

    for kind, node, tag, attrs, text, path, inside, *_ in found:
        names = set(path) | {tag}
        if names & _SKIPPED or node in excluded or not excluded.isdisjoint(inside) or mains and node not in mains and not mains & set(inside):
            continue
        if kind == TEXT:
            if "pre" in names:
                out.append(text)
            elif text.strip() or out and not out[-1].endswith(("\n", " ")):
                out.append(text.lstrip() if not out or out[-1].endswith(("\n", "| ")) else text)
        elif kind == ENTER:
            if tag in _BLOCK or re.fullmatch(r"h[1-6]|pre", tag):
                block()
            if tag in ("ul", "ol"):
                lists.append([tag, 0])
            elif tag == "li":
                if lists:
                    lists[-1][1] += 1
                if out and not out[-1].endswith("\n"):
                    out.append("\n")
                out.append("  " * max(0, len(lists) - 1) + (f"{lists[-1][1]}. " if lists and lists[-1][0] == "ol" else "- "))
            elif tag == "br":
                out.append("  \n")
            elif tag == "hr":
                out.append("---\n\n")
            elif tag == "img" and attrs.get("src"):
                out.append(f"![{attrs.get('alt', '')}]({absolute_one(attrs['src'], base)})")
            elif tag == "blockquote":
                quotes += 1
            elif tag == "tr":
                cells = []
            opened[node] = (len(out), attrs)
        elif kind == EXIT and node in opened:
            attrs = opened[node][1]
            if re.fullmatch(r"h[1-6]", tag):
                words = " ".join(cut(node).split())
                if words:
                    out.append(f"{'#' * int(tag[1])} {words}")
                block()
            elif tag == "a":
                words = cut(node)
                href = attrs.get("href")
                out.append(f"[{words.strip()}]({absolute_one(href, base)})" if href and words.strip() else words)
            elif tag in ("strong", "b", "em", "i", "del", "s") and tag not in path:
                words, mark = cut(node), {"strong": "**", "b": "**", "em": "_", "i": "_"}.get(tag, "~~")
                out.append(f"{mark}{words.strip()}{mark}{' ' if words.endswith(' ') else ''}" if words.strip() else words)
            elif tag == "code" and "pre" not in path:
                out.append(f"`{cut(node)}`")
            elif tag == "pre":
                out.append("```\n" + cut(node).strip("\n") + "\n```")
                block()
            elif tag in ("td", "th"):
                cells.append(" ".join(cut(node).split()))
            elif tag == "tr":
                cut(node)
                first = not out or not out[-1].endswith("|\n")
                out.append("| " + " | ".join(cells) + " |\n" + ("|" + " --- |" * len(cells) + "\n" if first else ""))
            elif tag == "blockquote":
                body = cut(node).strip()
                out.append("\n".join("> " + line if line else ">" for line in body.split("\n")))
                block()
            elif tag in ("ul", "ol"):
                if lists:
                    lists.pop()
                if not lists:
                    block()
            elif tag in _BLOCK:
                block()
    return re.sub(r"\n{3,}", "\n\n", re.sub(r"(?<! ) \n", "\n", "".join(out))).strip()


def markdown(pages: DataFrame, exclude: tuple[str, ...] = (), isolate_main: bool = False, origin: str | None = None) -> DataFrame:
    """``(page_id, markdown)``; ``exclude`` lists selectors of what to leave out, ``isolate_main`` keeps the main element only
    where there is one, ``origin`` replaces the base of addresses."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [to_markdown(h, u or "", ", ".join(exclude) or None, isolate_main, origin) for u, h in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["page_id", "markdown"])

    return pages.select(F.col("page_id").cast("bigint").alias("page_id"), "url", "html").mapInArrow(run, "page_id bigint, markdown string")
