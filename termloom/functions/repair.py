"""Reading the JSON that language models nearly write.

A scanner goes through a reply once, with the open brackets on a stack, and writes proper JSON: it starts at the first brace (or
bracket, where there is no brace), ends where that is closed, and takes strings in single or curly quotes, keys and values without
quotes, Python's names of constants, comments, quotes inside strings, commas too many or too few, and ends that are cut off.
"""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import StringType

#: Closing quotes by opening ones, and constants: fixed values.
QUOTES = {'"': '"', "'": "'", "“": "”", "‘": "’", "`": "`"}
CONSTANTS = {"true": "true", "false": "false", "null": "null", "None": "null", "True": "true", "False": "false", "undefined": "null", "NaN": "null"}
_SKIP = re.compile(r"(?:\s|//[^\n]*|/\*(?:[^*]|\*(?!/))*(?:\*/|\Z))*+")
#: A number or constant that something follows which may follow a value.
_SCALAR = re.compile(rf"(-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?|{'|'.join(CONSTANTS)})(?=\s*+(?:[,}}\]\"'“‘`]|//|/\*|\Z))")
_BARE_KEY = re.compile(r"[^:,{}\[\]\n]*+")
_BARE_VALUE = re.compile(r"[^,{}\[\]\n]*+")
_ESCAPED = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f"}
_PLAIN = {q: re.compile(rf"[^\\{re.escape(q)}]*+") for q in QUOTES.values()}


class Scanner:
    """The state of one reply: where it is read, what is written, and the open brackets with what each expects."""

    def __init__(self, text: str):
        self.text, self.at, self.out, self.open = text, 0, [], []

    def skip(self) -> None:
        self.at = _SKIP.match(self.text, self.at).end()

    def peek(self) -> str:
        return self.text[self.at : self.at + 1]

    def string(self, in_key: bool) -> str:
        """A quoted string's text. A quote ends it if what may follow a string follows; else it is a part of the string."""
        close, parts = QUOTES[self.peek()], []
        self.at += 1
        while self.at < len(self.text):
            run = _PLAIN[close].match(self.text, self.at)
            parts.append(run[0])
            self.at = run.end()
            if self.peek() == "\\":
                parts.append(self.escape())
            elif self.at < len(self.text):
                self.at += 1
                if self.ends(in_key):
                    break
                parts.append(close)
        return "".join(parts)

    def escape(self) -> str:
        c = self.text[self.at + 1 : self.at + 2]
        if c == "u" and re.match(r"[0-9a-fA-F]{4}", self.text[self.at + 2 : self.at + 6]):
            self.at += 6
            return chr(int(self.text[self.at - 4 : self.at], 16))
        self.at += 2
        return _ESCAPED.get(c, c)

    def ends(self, in_key: bool) -> bool:
        """Whether a string may end before what comes next."""
        after = re.compile(r"[ \t\r]*+").match(self.text, self.at).end()
        c = self.text[after : after + 1]
        if in_key:
            return c in ("", ":", "}", ",")
        return c in ("", ",", "}", "]", "\n") or c in QUOTES and after > self.at or self.text.startswith(("//", "/*"), after)

    def write(self, text: str) -> None:
        self.out.append(json.dumps(text.encode("utf-16", "surrogatepass").decode("utf-16", "replace"), ensure_ascii=False))

    def element(self) -> None:
        """A comma, if something stands before."""
        if self.open and self.open[-1][1]:
            self.out.append(",")
        if self.open:
            self.open[-1][1] = True

    def value(self) -> None:
        """One value, or the start of a bracket's."""
        c = self.peek()
        if c and c in "{[":
            self.open.append([c, False])
            self.out.append(c)
            self.at += 1
        elif c in QUOTES:
            self.write(self.string(False))
        elif not c or c in ",}]":
            self.out.append("null")
        elif scalar := _SCALAR.match(self.text, self.at):
            self.at = scalar.end()
            self.out.append(CONSTANTS.get(scalar[0], scalar[0]))
        else:
            bare = _BARE_VALUE.match(self.text, self.at)
            self.at = bare.end()
            self.write(re.split(r"\s//|/\*", bare[0])[0].strip())

    def close(self, c: str) -> None:
        """Closes the bracket that c ends, and those that are open in it; one that ends none is passed over."""
        self.at += 1
        start = {"}": "{", "]": "["}[c]
        if any(kind == start for kind, _ in self.open):
            while True:
                kind, _ = self.open.pop()
                self.out.append({"{": "}", "[": "]"}[kind])
                if kind == start:
                    break

    def member(self) -> None:
        """A key with what follows it. A key that the reply ends in is left out."""
        if self.peek() in QUOTES:
            key = self.string(True)
        else:
            bare = _BARE_KEY.match(self.text, self.at)
            self.at = bare.end()
            key = bare[0].strip()
        self.skip()
        if self.peek() != ":":
            if self.at < len(self.text) and self.peek() not in ",}":
                self.at += 1  # no key at all
            return
        self.at += 1
        self.skip()
        self.element()
        self.write(key)
        self.out.append(":")
        self.value()

    def run(self) -> str | None:
        begin = self.text.find("{")
        self.at = begin if begin >= 0 else self.text.find("[")
        if self.at < 0:
            return None
        self.value()
        while self.open:
            self.skip()
            c = self.peek()
            if not c:
                self.out += [{"{": "}", "[": "]"}[kind] for kind, _ in reversed(self.open)]
                break
            if c in "}]":
                self.close(c)
            elif c in ",:":
                self.at += 1
            elif self.open[-1][0] == "{":
                if c in "{[":  # a value without a key
                    self.at += 1
                else:
                    self.member()
            else:
                self.element()
                self.value()
        return "".join(self.out)


def repair(text: str | None) -> str | None:
    """The JSON of a reply's first object (or list); null if it has none."""
    return None if text is None else Scanner(text).run()


@pandas_udf(StringType())
def repaired_udf(replies: pd.Series) -> pd.Series:
    return replies.map(repair, na_action="ignore")
