"""A tokenizer for languages with braces: words, numbers, strings, marks; comments kept aside; brackets matched."""

from __future__ import annotations

import re
from dataclasses import dataclass

_TOKEN = re.compile(
    r"""(?P<space>\s+)|(?P<comment>//[^\n]*|/\*.*?(?:\*/|\Z))|(?P<text>\"\"\".*?(?:\"\"\"|\Z)|"(?:\\.|[^"\\\n])*"?|'(?:\\.|[^'\\\n])*'?|`(?:\\.|[^`\\])*`?)"""
    r"""|(?P<word>[^\W\d][\w$]*|\$[\w$]*|\#[^\W\d]\w*)|(?P<number>\d[\w.]*)|(?P<mark>=>|\.\.\.|:=|&&|\|\||[^\w\s])""",
    re.DOTALL,
)
OPEN, CLOSE = {"(": ")", "[": "]", "{": "}"}, {")", "]", "}"}


@dataclass
class Token:
    kind: str
    text: str
    start: int
    end: int
    line: int
    last_line: int
    match: int = -1  # of an opening bracket: where it closes


class Source:
    """Tokens without comments; comments by the token that follows them; whether all brackets match."""

    def __init__(self, text: str):
        self.text = text
        self.tokens: list[Token] = []
        self.comment_before: dict[int, str] = {}
        self.sound = True
        line, stack, note = 1, [], None
        for m in _TOKEN.finditer(text):
            kind, s = m.lastgroup, m.group()
            last = line + s.count("\n")
            if kind == "comment":
                note = s
            elif kind != "space":
                if note is not None:
                    self.comment_before[len(self.tokens)] = note
                    note = None
                t = Token(kind, s, m.start(), m.end(), line, last)
                if kind == "mark" and s in OPEN:
                    stack.append(len(self.tokens))
                elif kind == "mark" and s in CLOSE:
                    if stack and OPEN[self.tokens[stack[-1]].text] == s:
                        self.tokens[stack.pop()].match = len(self.tokens)
                    else:
                        self.sound = False
                self.tokens.append(t)
            line = last
        for at in stack:
            self.tokens[at].match = len(self.tokens) - 1
            self.sound = False
        self.lines = line

    def __len__(self) -> int:
        return len(self.tokens)

    def at(self, i: int) -> str:
        return self.tokens[i].text if 0 <= i < len(self.tokens) else ""

    def word(self, i: int) -> bool:
        return 0 <= i < len(self.tokens) and self.tokens[i].kind == "word"

    def cut(self, i: int, j: int) -> str:
        """The text of tokens i to j, both included."""
        return self.text[self.tokens[i].start : self.tokens[min(j, len(self.tokens) - 1)].end]

    def after(self, i: int) -> int:
        """The token after i, or after what i opens."""
        t = self.tokens[i]
        return (t.match if t.match >= 0 else i) + 1

    def generic(self, i: int, end: int) -> int:
        """After type arguments that start with < at i; i if there are none."""
        if self.at(i) != "<":
            return i
        depth = 0
        while i < end:
            s = self.at(i)
            depth += {"<": 1, ">": -1}.get(s, 0)
            i = self.after(i) if s in OPEN else i + 1
            if not depth:
                return i
        return end
