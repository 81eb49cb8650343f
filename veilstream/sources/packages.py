"""Text of office packages, for ``extract_text``: word-processor files, sheets and slides of both families.

Members are inflated and parsed in steps, and all of them together may give so many bytes and the text so many
characters, so that a small archive cannot fill a worker.  Paragraphs and rows are lines, cells are a tab apart.
"""

from __future__ import annotations

import io
import posixpath
import zipfile
from xml.parsers import expat

#: bytes that a package's members may inflate to, and characters of its text
MOST_INFLATED = 64 << 20
STEP = 1 << 16


class TooLarge(ValueError):
    """The package gives more than allowed."""


class Package:
    def __init__(self, content: bytes, most: int = MOST_INFLATED):
        self.zip, self.left, self.room, self.out = zipfile.ZipFile(io.BytesIO(content)), most, most, []

    def steps(self, name: str):
        with self.zip.open(name) as f:
            while part := f.read(STEP):
                self.left -= len(part)
                if self.left < 0:
                    raise TooLarge(name)
                yield part

    def read(self, name: str) -> bytes:
        return b"".join(self.steps(name))

    def add(self, text: str) -> None:
        self.room -= len(text)
        if self.room < 0:
            raise TooLarge("text")
        self.out.append(text)

    def walk(self, name: str, start=None, end=None, data=None) -> None:
        """A member's XML as events: names and attributes without their namespaces."""
        local = lambda x: x.rpartition(" ")[2]
        parser = expat.ParserCreate(namespace_separator=" ")
        parser.buffer_text = True

        def refuse(*_):
            raise TooLarge("a document type may not be declared")

        parser.StartDoctypeDeclHandler = refuse
        if start:
            parser.StartElementHandler = lambda tag, attrs: start(local(tag), {local(k): v for k, v in attrs.items()})
        if end:
            parser.EndElementHandler = lambda tag: end(local(tag))
        if data:
            parser.CharacterDataHandler = data
        for part in self.steps(name):
            parser.Parse(part)
        parser.Parse(b"", True)

    def listed(self, main: str, tag: str) -> list[str]:
        """Members that the elements of a main part name, in order, by the part's relations."""
        folder, file = posixpath.split(main)
        targets, ids = {}, []
        self.walk(f"{folder}/_rels/{file}.rels", lambda t, a: targets.__setitem__(a.get("Id"), a.get("Target")) if t == "Relationship" else None)

        def start(t, attrs):  # a slide's own number is an "id" too: relations' ids are known
            if t == tag:
                ids.append(next(v for k, v in attrs.items() if k.endswith("id") and v in targets))

        self.walk(main, start)
        return [posixpath.normpath(posixpath.join("/" + folder, targets[i])).lstrip("/") for i in ids]


def sheets(content: bytes, most: int = MOST_INFLATED) -> str:
    """Rows of all sheets in the workbook's order; shared, inline and computed values; empty cells keep their place."""
    box = Package(content, most)
    shared: list[str] = []
    state = {"on": False, "skip": 0, "held": []}

    def start(tag, attrs):
        if tag == "si":
            state["held"] = []
        state["skip"] += tag == "rPh"  # readings beside the text
        state["on"] = tag == "t" and not state["skip"]

    def end(tag):
        state["on"] = False
        state["skip"] -= tag == "rPh"
        if tag == "si":
            shared.append("".join(state["held"]))

    if "xl/sharedStrings.xml" in box.zip.namelist():
        box.walk("xl/sharedStrings.xml", start, end, lambda x: state["held"].append(x) if state["on"] else None)

    row: list[str] = []
    cell: dict = {}

    def open_(tag, attrs):
        if tag == "row":
            row.clear()
        elif tag == "c":
            letters = [c for c in attrs.get("r", "") if c.isalpha()]
            column = 0
            for c in letters[:3]:
                column = column * 26 + ord(c.upper()) - 64
            row.extend([""] * min(column - 1 - len(row), 1 << 14))
            cell.update(kind=attrs.get("t", "n"), held=[])
        cell["on"] = tag in ("v", "t")

    def close(tag):
        cell["on"] = False
        if tag == "c":
            text = "".join(cell["held"])
            row.append(shared[int(text)] if cell["kind"] == "s" and text else {"1": "TRUE", "0": "FALSE"}.get(text, text) if cell["kind"] == "b" else text)
        elif tag == "row":
            box.add("\t".join(row) + "\n")

    for name in box.listed("xl/workbook.xml", "sheet"):
        box.walk(name, open_, close, lambda x: cell["held"].append(x) if cell.get("on") else None)
    return "".join(box.out).removesuffix("\n")


def slides(content: bytes, most: int = MOST_INFLATED) -> str:
    """Paragraphs of all slides in the presentation's order."""
    box = Package(content, most)
    on = [False]

    def start(tag, attrs):
        on[0] = tag == "t"
        if tag == "br":
            box.add("\n")

    def end(tag):
        on[0] = False
        if tag == "p":
            box.add("\n")

    for name in box.listed("ppt/presentation.xml", "sldId"):
        box.walk(name, start, end, lambda x: box.add(x) if on[0] else None)
    return "".join(box.out).removesuffix("\n")


def open_document(content: bytes, most: int = MOST_INFLATED) -> str:
    """Paragraphs and headings of texts and slides, rows of sheets; white space in XML stands for one blank."""
    box = Package(content, most)
    depth = {"p": 0, "cell": 0}
    row: list[str] = []
    held: list[str] = []
    empty = [0]  # cells that count if another follows in their row
    blank = [True]
    room = [most]

    def put(text):
        room[0] -= len(text)
        if room[0] < 0:
            raise TooLarge("text")
        held.append(text)
        if text:  # the parser may part white space from white space that follows
            blank[0] = text.endswith((" ", "\n", "\t"))

    def start(tag, attrs):
        if tag == "table-row":
            row.clear()
            empty[0] = 0
        elif tag in ("table-cell", "covered-table-cell"):
            depth["cell"] += 1
            held.clear()
            empty[0] += min(int(attrs.get("number-columns-repeated", 1)) - 1, 1 << 14)
        elif tag in ("p", "h"):
            depth["p"] += 1
            if depth["cell"] and held:
                put("\n")
            blank[0] = True
        elif depth["p"] and tag == "s":
            put(" " * min(int(attrs.get("c", 1)), most + 1))
        elif depth["p"] and tag == "tab":
            put("\t")
        elif depth["p"] and tag == "line-break":
            put("\n")

    def end(tag):
        if tag in ("p", "h"):
            depth["p"] -= 1
            if not depth["cell"]:
                box.add("".join(held) + "\n")
                held.clear()
        elif tag in ("table-cell", "covered-table-cell"):
            depth["cell"] -= 1
            if held:
                row.extend([""] * empty[0])
                row.append("".join(held))
                empty[0] = 0
            else:
                empty[0] += 1
            held.clear()
        elif tag == "table-row":
            if row:
                box.add("\t".join(row) + "\n")

    def data(text):
        if depth["p"]:
            words = text.replace("\t", " ").replace("\n", " ").replace("\r", " ")
            while "  " in words:
                words = words.replace("  ", " ")
            put(words.lstrip(" ") if blank[0] else words)

    box.walk("content.xml", start, end, data)
    return "".join(box.out).removesuffix("\n")
