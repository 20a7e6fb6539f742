"""The older grammar: indented sections of ``key: value`` lines under singular section words.

Read on the driver, as one small file at a time. Only metadata, system, entity and feature are read; action, flow, constraint, traceability and generation_rule blocks are
skipped and leave one row of placeholders each, as this grammar never said more about them. Fields keep name, type and description.
"""

from __future__ import annotations

from dataclasses import dataclass

from ..model import document_type
from .specs import parse_text


class GrammarError(Exception):
    pass


@dataclass
class Token:
    kind: str  # indent, dedent, newline, dash, colon, word, text, number, end
    value: object
    line: int
    col: int


def tokenize(text: str) -> list[Token]:
    """Tokens with indentation as tokens: a tab counts four, # begins a comment, several closed levels give one dedent."""
    out: list[Token] = []
    levels = [0]
    for n, raw in enumerate(text.split("\n"), 1):
        width = 0
        at = 0
        while at < len(raw) and raw[at] in " \t":
            width += 4 if raw[at] == "\t" else 1
            at += 1
        if at == len(raw) or raw[at] in "#\r":
            continue
        if width > levels[-1]:
            levels.append(width)
            out.append(Token("indent", width, n, 1))
        elif width < levels[-1]:
            while width < levels[-1]:
                levels.pop()
            if width != levels[-1]:
                raise GrammarError(f"Invalid dedent at line {n}, column {at + 1}")
            out.append(Token("dedent", width, n, 1))
        while at < len(raw):
            c = raw[at]
            if c in " \t\r":
                at += 1
            elif c == "#":
                break
            elif c in "\"'":
                value, start, at = "", at, at + 1
                while at < len(raw) and raw[at] != c:
                    if raw[at] == "\\" and at + 1 < len(raw):
                        at += 1
                        value += {"n": "\n", "t": "\t", "r": "\r"}.get(raw[at], raw[at])
                    else:
                        value += raw[at]
                    at += 1
                if at == len(raw):
                    raise GrammarError(f"Unterminated string at line {n}, column {start + 1}")
                out.append(Token("text", value, n, start + 1))
                at += 1
            elif c == ":":
                out.append(Token("colon", ":", n, at + 1))
                at += 1
            elif c == "-" and (at + 1 == len(raw) or raw[at + 1] in " \t"):
                out.append(Token("dash", "-", n, at + 1))
                at += 1
            else:
                start = at
                while at < len(raw) and raw[at] not in " \t\r:#\"'":
                    at += 1
                word = raw[start:at]
                number = word.replace(".", "", 1).isdigit()
                out.append(Token("number" if number else "word", float(word) if number else word, n, start + 1))
        out.append(Token("newline", None, n, len(raw) + 1))
    out.append(Token("end", None, text.count("\n") + 1, 1))
    return out


SKIPPED = {
    "action": ("actions", {"id": "placeholder"}), "flow": ("flows", {"id": "placeholder", "name": "placeholder", "steps": []}), "constraint": ("constraints", {"id": "placeholder", "name": "placeholder", "type": "placeholder", "rule": "placeholder"}),
    "traceability": ("traceability", {"from": "placeholder", "to": "placeholder", "relation": "placeholder"}), "generation_rule": ("generation_rules", {"id": "placeholder", "name": "placeholder", "triggers": [], "generates": []}),
}


class _Reader:
    def __init__(self, tokens: list[Token]) -> None:
        self.tokens, self.at, self.levels = tokens, 0, [0]

    @property
    def now(self) -> Token:
        return self.tokens[self.at]

    def next(self) -> Token:
        self.at += 1
        return self.tokens[self.at - 1]

    def expect(self, kind: str) -> Token:
        if self.now.kind != kind:
            raise GrammarError(f"Unexpected token at line {self.now.line}, column {self.now.col}: expected {kind}")
        return self.next()

    def line(self) -> str:
        """The rest of the line as text."""
        words = []
        while self.now.kind not in ("newline", "end"):
            words.append(str(self.next().value))
        if self.now.kind == "newline":
            self.next()
        return " ".join(words)

    def block(self):
        """A nested block: a list if it begins with a dash, else a mapping."""
        self.levels.append(int(self.expect("indent").value))
        out = self.items() if self.now.kind == "dash" else self.mapping()
        self.levels.pop()
        if self.now.kind == "dedent" and self.now.value == self.levels[-1]:  # one that closes more levels is the outermost one's
            self.next()
        return out

    def items(self) -> list:
        out = []
        while self.now.kind == "dash":
            self.next()
            if self.now.kind == "word" and self.tokens[self.at + 1].kind == "colon":
                key = str(self.next().value)
                self.next()
                out.append({key: self.line()})
            else:
                out.append(self.line())
            if self.now.kind == "indent":
                token = self.tokens[self.at + 1]
                raise GrammarError(f"Unexpected token at line {token.line}, column {token.col}: list items have one line")
        return out

    def mapping(self) -> dict:
        out = {}
        while self.now.kind == "word":
            key = str(self.next().value)
            self.expect("colon")
            if self.now.kind == "newline":
                self.next()
                out[key] = self.block() if self.now.kind == "indent" else ""
            else:
                out[key] = self.line()
        return out

    def skip_block(self) -> None:
        self.line()
        if self.now.kind != "indent":
            return
        while self.now.kind != "end":
            token = self.next()
            if token.kind == "dedent" and token.value == 0:
                return


def parse(text: str) -> dict:
    """A text in the older grammar as a document."""
    r, doc = _Reader(tokenize(text)), parse_text("", document_type())
    while r.now.kind != "end":
        if r.now.kind in ("newline", "dedent"):
            r.next()
            continue
        token = r.expect("word")
        r.expect("colon")
        if token.value in SKIPPED:
            section, row = SKIPPED[token.value]
            r.skip_block()
            doc[section].append(dict(row))
            continue
        if token.value not in ("metadata", "system", "entity", "feature"):
            raise GrammarError(f"Unexpected token at line {token.line}, column {token.col}: {token.value}")
        r.line()
        body = r.block() if r.now.kind == "indent" else {}
        names = {f.name: f.dataType for f in document_type().fields}
        kind = names[{"entity": "entities", "feature": "features"}.get(token.value, token.value)]
        row = {f.name: None for f in (kind.elementType if token.value in ("entity", "feature") else kind).fields}
        row |= {k: v for k, v in body.items() if k in row and not isinstance(v, (dict, list))}
        if token.value == "system":
            row |= {"components": [x for x in body.get("components") or [] if isinstance(x, str)], "relationships": []}
        if token.value == "entity":
            row["fields"] = [{"name": f.get("name", ""), "type": f.get("type", ""), "description": f.get("description"), "required": None, "default": None, "constraints": None} for f in body.get("fields") or [] if isinstance(f, dict)]
        if token.value == "feature":
            row["scenarios"] = []
        if token.value in ("metadata", "system"):
            doc[token.value] = row
        else:
            doc["entities" if token.value == "entity" else "features"].append(row)
    return doc
