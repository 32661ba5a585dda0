"""Transcriptions: formatting blocks across pages, inline markup, and byte-exact lines."""

from __future__ import annotations

import re

from .natural import natural_key

#: Block openers with kind and closer, and style tags.
OPENERS = {"/*": ("local", "*/"), "/#": ("continued", "#/")}
CLOSERS = {"*/": "local", "#/": "continued"}
STYLES = ("i", "b", "sc", "f", "g", "tb")
_CONTROL = re.compile(r"/\*|\*/|/#|#/")
_LEX = re.compile(r"(?P<newline>\r\n|[\r\n])|(?P<control>/\*|\*/|/#|#/)|(?P<note>\[\*\*[^\]\r\n]*\])|(?P<badnote>\[\*\*[^\r\n]*)|(?P<tag><[^>\r\n]*>)|(?P<open><[^>\r\n]*)")
_BARE = re.compile(r"\s*/?\s*[A-Za-z]")


def _overlap(a: int, b: int, c: int, d: int) -> bool:
    """Half-open ranges meet; an empty range also meets what it touches."""
    return c <= a <= d if a == b else a <= c <= b if c == d else a < d and c < b


class _Page:
    """A page with what the blocks of its book have made of it."""

    def __init__(self, name: str, text: str, resolved: dict):
        self.name, self.text = name, text
        self.at = [0]
        for ch in text:
            self.at.append(self.at[-1] + len(ch.encode()))
        self.deleted = set(resolved["deleted"])
        self.bad, self.spans, self.told = resolved["bad"], resolved["spans"], resolved["told"]


def controls(text: str) -> tuple[int, list[tuple[int, int, str]]]:
    """(bytes of a text, its block controls as character, byte and mark): all that the blocks of a book need of a page."""
    found, at, done = [], 0, 0
    for m in _CONTROL.finditer(text):
        at += len(text[done : m.start()].encode())
        done = m.start()
        found.append((m.start(), at, m[0]))
    return at + len(text[done:].encode()), found


def resolved_blocks(pages: list[tuple[str, int, list[tuple[int, int, str]]]]) -> dict[str, dict]:
    """name -> deleted markers (characters), bad ranges, spans and diagnostics of pages (name, bytes, controls), in order."""
    out: dict[str, dict] = {name: {"deleted": [], "bad": [], "spans": [], "told": []} for name, *_ in pages}
    names, sizes = [p[0] for p in pages], [p[1] for p in pages]
    block: dict | None = None

    def segment(name: str, stop: int) -> None:
        block["segments"].append((name, block["from"], stop))
        block["from"] = 0

    def spans(block_id: str, closed: bool) -> None:
        for name, a, b in block["segments"]:
            out[name]["spans"].append({"opening_id": block["id"], "block_id": block_id, "kind": block["kind"], "byte_start": a, "byte_end": b, "closed": closed})

    def fail(last: int, stop: int, say: bool) -> None:
        spans(block["id"], False)
        for k in range(block["page"], last + 1):
            out[names[k]]["bad"].append((block["start"] if k == block["page"] else 0, stop if k == last else sizes[k]))
        if say:
            out[names[block["page"]]]["told"].append(("malformed_control", block["start"], block["start"] + 2))

    for k, (name, size, marks) in enumerate(pages):
        own = out[name]
        for char, start, mark in marks:
            stop = start + 2
            if mark in OPENERS:
                if block is None:
                    kind, closer = OPENERS[mark]
                    block = {"kind": kind, "closer": closer, "page": k, "start": start, "char": char, "from": stop, "valid": True, "segments": [], "id": f"{kind}:{name}:{start}"}
                else:
                    block["valid"] = False
                    own["told"].append(("malformed_control", start, stop))
            elif block is None:
                lone = f"{CLOSERS[mark]}:{name}:{start}"
                own["spans"].append({"opening_id": lone, "block_id": lone, "kind": CLOSERS[mark], "byte_start": start, "byte_end": stop, "closed": False})
                own["bad"].append((start, stop))
                own["told"].append(("malformed_control", start, stop))
            elif mark != block["closer"]:
                block["valid"] = False
                own["told"].append(("malformed_control", start, stop))
            else:
                segment(name, start)
                if block["valid"]:
                    out[names[block["page"]]]["deleted"].append(block["char"])
                    own["deleted"].append(char)
                    spans(f"{block['id']}:{name}:{stop}", True)
                else:
                    fail(k, stop, False)
                block = None
        if block is not None:
            segment(name, size)
            if block["kind"] == "local" or k == len(pages) - 1:
                fail(k, size, True)
                block = None
    return out


def _tag(body: str) -> tuple[str, bool, bool] | None:
    """(name, closing, self-closing) of what stands between < and >; None if it is no tag."""
    body = body.strip()
    closing = body.startswith("/")
    body = body[1:].lstrip() if closing else body
    if not body[:1].isalpha() or not body[:1].isascii():
        return None
    end = 1
    while end < len(body) and (body[end].isalnum() or body[end] in "_:-"):
        end += 1
    name, rest = body[:end].lower(), body[end:]
    alone = not closing and rest.rstrip().endswith("/")
    rest = rest.rstrip()[:-1] if alone else rest
    return None if rest and not rest[0].isspace() else (name, closing, alone)


def _tokens(page: _Page) -> dict:
    ops: list[dict] = []
    runs: list[dict] = []
    stack: list[tuple[str, int, int]] = []
    loose = list(page.bad)
    told = list(page.told)
    seen = 0
    text, at = page.text, page.at

    def emit(kind: str, a: int, b: int, out: str) -> None:
        nonlocal seen
        if a < b:
            ops.append({"kind": kind, "byte_start": at[a], "byte_end": at[b], "output": out})
            seen += len(out)

    def pieces(kind: str, a: int, b: int) -> None:
        """A lexeme's operation, cut where deleted controls stand inside it."""
        for c in sorted(x for x in page.deleted if a <= x < b):
            emit(kind, a, c, text[a:c] if kind == "copy" else "")
            emit("delete_control", c, c + 2, "")
            a = c + 2
        emit(kind, a, b, text[a:b] if kind == "copy" else "")

    def complain(code: str, a: int, b: int) -> None:
        told.append((code, a, b))
        loose.append((a, b))

    done = 0
    for m in _LEX.finditer(text):
        kind, a, b = m.lastgroup, m.start(), m.end()
        if kind == "open" and not _BARE.match(text, a + 1, b):
            continue
        emit("copy", done, a, text[done:a])
        done = b
        tag = _tag(m[0][1:-1]) if kind == "tag" else None
        if kind == "newline":
            emit("normalize_newline", a, b, "\n")
        elif kind == "note":
            pieces("delete_note", a, b)
        elif kind == "control":
            emit("delete_control", a, b, "") if a in page.deleted else emit("copy", a, b, m[0])
        elif tag is None:
            pieces("copy", a, b)
            complain("malformed_markup", at[a], at[b])
        elif tag[0] not in STYLES:
            pieces("copy", a, b)
            complain("unknown_tag", at[a], at[b])
        else:
            pieces("delete_tag", a, b)
            name, closing, alone = tag
            if name == "tb":
                runs.append({"kind": "tb", "start": seen, "end": seen, "byte_start": at[b], "byte_end": at[b]})
            elif closing and stack and stack[-1][0] == name:
                _, byte, start = stack.pop()
                runs.append({"kind": name, "start": start, "end": seen, "byte_start": byte, "byte_end": at[a]})
            elif closing:
                complain("unmatched_style_tag", at[a], at[b])
            elif not alone:
                stack.append((name, at[b], seen))
    emit("copy", done, len(text), text[done:])
    for _, byte, _ in stack:
        complain("unmatched_style_tag", byte, byte)
    return {"page_name": page.name, "visible_text": "".join(o["output"] for o in ops), "operations": ops, "styles": runs, "spans": page.spans, "diagnostics": [{"code": c, "byte_start": a, "byte_end": b} for c, a, b in told], "lines": _lines(page, ops, loose)}


def _lines(page: _Page, ops: list[dict], loose: list[tuple[int, int]]) -> list[dict]:
    ends = [(m.start(), m.end()) for m in re.finditer(r"\r\n|[\r\n]", page.text)] + [(len(page.text), len(page.text))]
    out, start, op = [], 0, 0
    for ordinal, (stop, after) in enumerate(ends):
        a, content, b = page.at[start], page.at[stop], page.at[after]
        first = op
        while op < len(ops) and ops[op]["byte_end"] <= b:
            op += 1
        meets = lambda ranges: any(_overlap(a, content, x, y) for x, y in ranges)  # noqa: B023, E731
        on = [s for s in page.spans if _overlap(a, b, s["byte_start"], s["byte_end"])]
        out.append({
            "ordinal": ordinal, "byte_start": a, "content_end": content, "byte_end": b, "original_text": page.text[start:stop],
            "visible_text": "".join(o["output"] for o in ops[first:op] if o["byte_end"] <= content), "first_operation": first, "operations": op - first,
            "span_ids": [s["block_id"] for s in on], "continued_ids": [s["opening_id"] for s in on if s["kind"] == "continued"],
            "matching_eligible": not meets(page.bad), "style_eligible": not meets(loose),
        })
        start = after
    return out


def tokenize_page(name: str, text: str, resolved: dict) -> dict:
    """A page taken apart, given what resolved_blocks says of it."""
    return _tokens(_Page(name, text, resolved))


def tokenize(pages: dict[str, str]) -> list[dict]:
    """The pages of one project, in natural order, taken apart with blocks carried from page to page."""
    order = sorted(pages, key=natural_key)
    found = resolved_blocks([(name, *controls(pages[name])) for name in order])
    return [tokenize_page(name, pages[name], found[name]) for name in order]


def feature_page(page: dict, text: str) -> dict:
    """source_text, feature_text and blocks of a tokenized page, for the page features."""
    raw = text.encode()
    closed = [s for s in page["spans"] if s["closed"]]
    cuts = sorted((r for s in closed for r in ((s["byte_start"] - 2, s["byte_start"]), (s["byte_end"], s["byte_end"] + 2)) if r[0] >= 0 and r[1] <= len(raw)))
    out, at = [], 0
    for a, b in cuts:
        if a >= at:
            out.append(raw[at:a])
            at = b
    return {"source_text": text, "feature_text": (b"".join(out) + raw[at:]).decode(), "blocks": [raw[s["byte_start"] : s["byte_end"]].decode() for s in closed]}


#: Fixed patterns: a line of fields set apart by three spaces or more, and an illustration's mark.
_FIELDS = re.compile(r"\S(?:.*?\S)? {3,}\S(?:.*\S)?")
_PICTURE = re.compile(r"\[(?:illustration|decoration)\b[^\]]*\]", re.IGNORECASE)


def feature_evidence(page: dict, features: list[str]) -> dict[str, list[int]]:
    """code -> ordinals of the lines that show it, for the page's features; a feature that no line shows is an error.

    A table needs three lines of fields that overlap closed blocks. Without `spans` the page carries no evidence.
    """
    out: dict[str, list[int]] = {}
    if page.get("spans") is None:
        return {{"table_like": "table_like", "illustration_or_ornament": "illustration_marker"}[f]: [] for f in features}
    closed = [(s["byte_start"], s["byte_end"]) for s in page["spans"] if s["closed"]]
    for line in page["lines"]:
        text = line["original_text"]
        if "table_like" in features and _FIELDS.fullmatch(text.strip()) and any(_overlap(line["byte_start"], line["byte_end"], a, b) for a, b in closed):
            out.setdefault("table_like", []).append(line["ordinal"])
        if "illustration_or_ornament" in features and _PICTURE.search(text):
            out.setdefault("illustration_marker", []).append(line["ordinal"])
    for feature, code, least in (("table_like", "table_like", 3), ("illustration_or_ornament", "illustration_marker", 1)):
        if feature in features and len(out.get(code, ())) < least:
            raise ValueError(f"{feature} without {least} lines that show it")
    return out
