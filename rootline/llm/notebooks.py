"""The cells of computational notebooks as a reader sees them.

A notebook is written out in one of four forms: ``md`` (fenced code and output between paragraphs),
``percent`` (``# %%`` markers, text and output as comments), ``console`` (``In [n]:`` prompts) and
``ipynb`` (JSON).  ``read`` undoes the form: it returns the source of text and code cells and the
text of outputs, without prompts, comment marks, JSON escapes, terminal codes, HTML tags or images.

In md and console neighbouring cells look like one stretch of text; the lengths in the list of cells
as collected tell them apart.  Where the list is missing or doesn't fit, paragraphs are cells.

Defined results: null and empty texts have no cells; a text that was cut off gives its cells up to
the cut, the last one in part; CRLF counts as LF; an unknown form is read as md.
"""

from __future__ import annotations

import html
import json
import re
from collections.abc import Sequence

ANSI = re.compile(r"\x1b\[[0-9;?]*[ -/]*[@-~]|\x1b[@-Z\\-_]")
# Names of HTML elements that notebooks show (fixed values); other things in angle brackets are text.
BLOCKS = "address|article|blockquote|br|caption|dd|div|dl|dt|figcaption|figure|h[1-6]|hr|img|li|ol|p|pre|section|table|tbody|td|tfoot|th|thead|tr|ul"
INLINES = "a|abbr|b|center|cite|code|del|details|em|font|i|ins|kbd|mark|q|s|samp|small|span|strong|style|sub|summary|sup|tt|u|var"
_REST = r"(?:\s+[\w:-]+\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s\"'<>]+))*\s*/?>"
BLOCK_TAG = re.compile(rf"</?(?:{BLOCKS}){_REST}|<!--.*?-->", re.S | re.I)
INLINE_TAG = re.compile(rf"</?(?:{INLINES}){_REST}", re.I)
LINK = re.compile(r"\[([^\[\]]*)\]\([^()\s]*(?:\s+\"[^\"]*\")?\)")
IMAGE = re.compile(r"!\[[^\]]*\]\(data:[^)]*\)?|<image/\w+[ ;]base64[ ,][^>]*>?|data:image/[\w.+-]+;base64,[A-Za-z0-9+/=]+")
TOKEN = re.compile(r'"(?:[^"\\]|\\.)*"|[{}\[\]]', re.S)
HEAD = re.compile(r"(?:In|Out)\s?\[[ \d*]*\]: ?")

Cell = tuple[str, str]


def seen(kind: str, content: str) -> str:
    """What a reader sees of the content of a cell."""
    if "\x1b" in content:
        content = ANSI.sub("", content)
    if kind == "code":
        return content
    if "base64" in content:
        content = IMAGE.sub(" ", content)
    marked = kind == "text"
    if "<" in content:
        bare = INLINE_TAG.sub("", BLOCK_TAG.sub(" ", content))
        marked |= bare != content
        content = bare
    if kind == "text" and "](" in content:
        content = LINK.sub(r"\1", content)
    if marked and "&" in content:
        content = html.unescape(content)
    return content


def _joined(source) -> str:
    if isinstance(source, list):
        return "".join(x for x in source if isinstance(x, str))
    return source if isinstance(source, str) else ""


def _mend(text: str) -> str:
    """A JSON text that was cut off, closed where it ends."""
    closers, last = [], 0
    for m in TOKEN.finditer(text):
        if (c := m.group()[0]) in "{[":
            closers.append("}" if c == "{" else "]")
        elif c in "}]" and closers:
            closers.pop()
        last = m.end()
    rest = text[last:]
    if (at := rest.find('"')) >= 0:  # cut within a string
        body = rest[at + 1 :]
        body = re.sub(r"\\(?:u[0-9a-fA-F]{0,3})?$", "", body) if not re.search(r"(?<!\\)(?:\\\\)+$", body) else body
        text, rest = text[:last] + rest[: at + 1] + body + '"', ""
    else:
        rest = re.sub(r"[-\w.+]+$", "", rest)  # cut within a number or a word
        text = text[:last] + rest
    text = text.rstrip().rstrip(",").rstrip()
    return text, "".join(reversed(closers))


def _loads(text: str):
    try:
        return json.loads(text, strict=False)
    except (ValueError, RecursionError):
        pass
    body, tail = _mend(text)
    for extra in ("", ":null", "null"):
        try:
            return json.loads(body + extra + tail, strict=False)
        except (ValueError, RecursionError):
            continue
    return None


def _ipynb(text: str) -> list[Cell] | None:
    found = _loads(text)
    if not isinstance(found, dict) or not isinstance(cells := found.get("cells"), list):
        return None
    out: list[Cell] = []
    for cell in cells:
        if not isinstance(cell, dict):
            continue
        code = cell.get("cell_type") == "code"
        out.append(("code" if code else "text", _joined(cell.get("source"))))
        for output in cell.get("outputs") or [] if code else []:
            if not isinstance(output, dict):
                continue
            parts = [_joined(output.get("text")), "\n".join(x for x in output.get("traceback") or [] if isinstance(x, str))]
            data = output.get("data")
            if isinstance(data, dict):
                parts += [_joined(v) for k, v in data.items() if not k.startswith("image/")]
            out.append(("output", "\n".join(p for p in parts if p)))
    return out


def _ends(text: str, at: int) -> bool:
    return at >= len(text) or text[at] == "\n"


def _listed(text: str, form: str, cells: Sequence[tuple[str, int]]) -> tuple[list[Cell], int]:
    """The cells that the list and the text agree on, from the start, and where they end."""
    out: list[Cell] = []
    pos = 0
    for kind, size in cells:
        start = pos
        while start < len(text) and text[start] == "\n":
            start += 1
        if start >= len(text):
            return out, len(text)
        if form == "console":
            if kind != "text":
                if not (m := HEAD.match(text, start)):
                    return out, pos
                start = m.end() + (kind == "output" and text.startswith("\n", m.end()))
            if kind == "code":
                end = text.find("\n\n", start)
                while end >= 0 and text.startswith("   ...:", end + 2):
                    end = text.find("\n\n", end + 2)
                end = len(text) if end < 0 else end
                out.append((kind, text[start:end].replace("\n   ...: ", "\n").replace("\n   ...:", "\n")))
                pos = end
                continue
        elif kind == "code":
            if not text.startswith("```", start):
                return out, pos
            start = text.find("\n", start) + 1 or len(text)
        elif kind == "output":
            if text.startswith("![", start):
                end = text.find("\n", start)
                pos = len(text) if end < 0 else end
                out.append((kind, text[start:pos]))
                continue
            if text.startswith("<", start) and _ends(text, start + size):
                pos = start + size
                out.append((kind, text[start:pos]))
                continue
            if not text.startswith("```", start):
                return out, pos
            start = text.find("\n", start) + 1 or len(text)
        end = start + size
        if kind == "output" and form == "console" and not _ends(text, end) and text.startswith("<image", start):
            end = text.find("\n", start)
            end = len(text) if end < 0 else end
        if not _ends(text, end):
            return out, pos
        out.append((kind, text[start:end]))
        if form == "md" and kind != "text":
            if end < len(text) and not text.startswith("\n```", end):
                out.pop()
                return out, pos
            end = min(len(text), end + 4)
        pos = end
    return out, pos


def _percent(text: str) -> list[Cell]:
    out: list[Cell] = []
    kind, held = "code", []

    def close() -> None:
        body = "\n".join(held).strip("\n")
        if body:
            out.append((kind, body))
        held.clear()

    for line in text.split("\n"):
        if line.startswith("# %%"):
            close()
            kind = "text" if "[markdown]" in line else "code"
        elif line.startswith("#>"):
            if kind != "output":
                close()
                kind = "output"
            held.append(line[3:] if line.startswith("#> ") else line[2:])
        elif kind == "text":
            held.append(line[2:] if line.startswith("# ") else line[1:] if line.startswith("#") else line)
        elif kind == "output" and not line:
            close()
            kind = "code"
        else:
            held.append(line)
    close()
    return out


def _plain(text: str, form: str) -> list[Cell]:
    """Cells by the marks of the form alone; paragraphs between them are text cells, a heading going
    with the paragraph below it."""
    out: list[Cell] = []
    kind, held, fence = "text", [], False

    def close() -> None:
        body = "\n".join(held).strip("\n")
        if body:
            if kind == "text" and out and out[-1][0] == "text" and re.fullmatch(r"#+ [^\n]*", out[-1][1]):
                body = out.pop()[1] + "\n\n" + body
            out.append((kind, body))
        held.clear()

    for line in text.split("\n"):
        if form == "console":
            if m := HEAD.match(line):
                close()
                kind, line = ("code" if line.startswith("In") else "output"), line[m.end() :]
                held.append(line)
            elif line.startswith("   ...:"):
                held.append(line[8:])
            elif not line:
                close()
                kind = "text"
            else:
                held.append(line)
        elif line.startswith("```"):
            close()
            fence = not fence
            kind = ("code" if line[3:].strip() else "output") if fence else "text"
        elif line or fence:
            held.append(line)
        else:
            close()
    close()
    return out


def read(text: str | None, form: str | None, cells: Sequence[tuple[str, int]] | None = None) -> list[Cell]:
    """The cells of a notebook as (kind, content): kind is text, code or output.

    ``cells`` lists (kind, length) of the cells as collected, where known.
    """
    if not text:
        return []
    if "\r" in text:
        text = text.replace("\r\n", "\n").replace("\r", "\n")
    form = (form or "").strip().lower()
    out = None
    if form == "ipynb":
        out = _ipynb(text)
    elif form == "percent":
        out = _percent(text)
    if out is None:
        form = "console" if form == "console" else "md"
        out, end = _listed(text, form, cells or ())
        if end < len(text):
            out += _plain(text[end:], form)
    return [(kind, seen(kind, content)) for kind, content in out]


KINDS = {"t": "text", "c": "code", "o": "output"}


def compact_columns(documents, *others):
    """(doc_id, text, nb_format, kinds, sizes, *others): documents with their list of cells as a string of
    first letters and an array of lengths, which Python reads far faster than structs."""
    from pyspark.sql import functions as F

    kinds = F.array_join(F.transform("cells", lambda c: F.coalesce(F.substring(F.lower(c["cell_type"]), 1, 1), F.lit("t"))), "")
    sizes = F.transform("cells", lambda c: F.coalesce(c["n_chars"].cast("int"), F.lit(0)))
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "nb_format", F.coalesce(kinds, F.lit("")).alias("kinds"), F.coalesce(sizes, F.array().cast("array<int>")).alias("sizes"), *others).where("doc_id is not null")


def batch_cells(batch):
    """(doc_id, cells) of each row of a record batch of ``compact_columns``."""
    ids, texts, forms, kinds = (batch.column(i).to_pylist() for i in range(4))
    sizes = batch.column(4)
    flat, ends = sizes.flatten().to_pylist(), sizes.value_lengths().to_pylist()
    at = 0
    for doc_id, text, form, letters, n in zip(ids, texts, forms, kinds, ends, strict=True):
        listed = [(KINDS.get(k, "text"), size) for k, size in zip(letters, flat[at : at + n], strict=False)]
        at += n
        yield doc_id, read(text, form, listed)
