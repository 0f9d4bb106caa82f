"""Shell texts as trees: lists of pipelines of commands, with redirections, here-documents, compound commands and substitutions at any depth.

`parse` gives the pipelines of a text, `commands` all its commands in the order of their starts, those inside
substitutions, groups and loops too. A text that ends too early (an open quote, a here-document without its end) is
read as if it were closed at its end; nothing is an error.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

#: Words that open, part or close compound commands where a command may begin.
RESERVED = frozenset("if then elif else fi while until do done ! { } time".split())
#: Commands that run the command behind them.
WRAPPERS = frozenset("sudo env nohup exec command builtin nice".split())
_OPERATORS = ("<<<", "<<-", "&>>", "<<", ">>", ">&", "<&", ">|", "&>", "<>", "<", ">")


@dataclass
class Word:
    """A word's text without its quotes, and what is substituted in it; quoted: whether any of it was."""

    text: str = ""
    inner: list[list[Command]] = field(default_factory=list)
    quoted: bool = False


@dataclass
class Command:
    """A simple command. start: its place in the text; reads, writes: whether a pipe leads to it, from it; heredoc: the body of a here-document."""

    start: int
    words: list[Word] = field(default_factory=list)
    assigned: list[Word] = field(default_factory=list)
    redirects: list[tuple[str, Word]] = field(default_factory=list)
    heredoc: str | None = None
    reads: bool = False
    writes: bool = False
    depth: int = 0
    bodies: list[list[list[Command]]] = field(default_factory=list)

    @property
    def texts(self) -> list[str]:
        """The words from the program on, behind commands that only run it, their options and assignments."""
        out = [w.text for w in self.words]
        while out and out[0] in WRAPPERS:
            out = out[1:]
            while out and (out[0].startswith("-") or _assigns(out[0])):
                out = out[1:]
        return out

    @property
    def name(self) -> str:
        """The program, without its path; empty where a substitution names it."""
        first = self.texts[0] if self.texts else ""
        return "" if first.startswith(("$(", "`")) else first.rsplit("/", 1)[-1]

    @property
    def target(self) -> str | None:
        """The file that standard output goes to last."""
        return next((w.text for op, w in reversed(self.redirects) if op in (">", ">>", ">|", "&>", "&>>")), None)


def _assigns(text: str) -> bool:
    head = text.split("=")[0].rstrip("+")
    return "=" in text and head.split("[")[0].isidentifier()


class _Reader:
    def __init__(self, text: str, at: int = 0, depth: int = 0):
        self.text, self.at, self.depth = text, at, depth
        self.open: list[tuple[Command, str, bool, bool]] = []  # here-documents whose bodies are still to come

    def blank(self) -> None:
        """To the next token of the line, over blanks, joined lines and remarks."""
        while self.at < len(self.text):
            if self.text.startswith("\\\n", self.at):
                self.at += 2
            elif self.text[self.at] in " \t\r":
                self.at += 1
            elif self.text[self.at] == "#" and (self.at == 0 or self.text[self.at - 1] in " \t\n;|&("):
                end = self.text.find("\n", self.at)
                self.at = len(self.text) if end < 0 else end
            else:
                return

    def line_end(self) -> None:
        """Over a line feed, and the bodies of the here-documents that begin behind it."""
        self.at += 1
        for command, mark, stripped, quoted in self.open:
            rows, ended = [], False
            while self.at < len(self.text) and not ended:
                end = self.text.find("\n", self.at)
                end = len(self.text) if end < 0 else end
                row = self.text[self.at : end]
                self.at = min(len(self.text), end + 1)
                ended = (row.lstrip("\t") if stripped else row).rstrip() == mark
                rows += [] if ended else [row]
            command.heredoc = "\n".join(rows)
            if not quoted:
                command.bodies += _substituted(command.heredoc, self.depth + 1)
        self.open = []

    def program(self, ends: str = "") -> list[list[Command]]:
        """Pipelines up to one of the closing characters, which is not read."""
        out: list[list[Command]] = []
        piped, line = False, []
        while True:
            self.blank()
            if self.at >= len(self.text) or self.text[self.at] in ends:
                break
            c = self.text[self.at]
            if c == "\n":
                self.line_end()
            elif c in ";&|":
                piped = c == "|" and not self.text.startswith("||", self.at)
                wide = self.text[self.at : self.at + 2] in (";;", "&&", "||", "|&")
                piped = piped or self.text.startswith("|&", self.at)
                self.at += 1 + wide
                if piped and line:
                    line[-1].writes = True
                elif line:
                    out.append(line)
                    line = []
                if piped:
                    self.blank()
                    while self.at < len(self.text) and self.text[self.at] == "\n":
                        self.line_end()
                        self.blank()
                continue
            elif c == "(":
                self.at += 1
                if not self.text.startswith(")", self.at):
                    self.depth += 1
                    inner = self.program(")")
                    self.depth -= 1
                    if inner:
                        inner[0][0].reads = piped
                        out += [*([line] if line else []), *inner[:-1]]
                        line = inner[-1]
                self.at += 1
                piped = False
                continue
            elif c == ")":
                self.at += 1  # a closing bracket of nothing, as behind the pattern of a case
                continue
            else:
                command = self.command()
                if command is not None:
                    command.reads = piped
                    line.append(command)
            if c == "\n" and not piped and line:
                out.append(line)
                line = []
            if c != "\n":
                piped = False
        if line:
            out.append(line)
        return out

    def command(self) -> Command | None:
        """A simple command; of compound ones what belongs to their head."""
        own = Command(self.at, depth=self.depth)
        while True:
            self.blank()
            if self.at >= len(self.text) or self.text[self.at] in ";|)\n" or (self.text[self.at] == "&" and self.text[self.at + 1 : self.at + 2] != ">"):
                break
            if self.text[self.at] == "(":
                if len(own.words) == 1 and self.text.startswith("()", self.at):  # the head of a function
                    self.at += 2
                    return None
                break
            digits = self.at
            while digits < len(self.text) and self.text[digits].isdigit():
                digits += 1
            op = next((x for x in _OPERATORS if self.text.startswith(x, digits)), None)
            if op and not (op == "<" and self.text.startswith("<(", digits)) and not (op == ">" and self.text.startswith(">(", digits)):
                number, self.at = self.text[self.at : digits], digits + len(op)
                self.blank()
                word = self.word()
                if op in ("<<", "<<-"):
                    own.heredoc = ""
                    self.open.append((own, word.text, op == "<<-", word.quoted))
                elif number in ("", "1") or op != ">":
                    own.redirects.append((op, word))
                continue
            begin = self.at
            word = self.word()
            if self.at == begin:
                self.at += 1
                continue
            if not own.words and not word.quoted and not word.inner:
                if word.text in RESERVED:
                    own = Command(self.at, assigned=own.assigned, depth=self.depth)
                    self.blank()
                    own.start = self.at
                    continue
                if word.text in ("for", "select", "case"):
                    return self.head(own, word.text)
                if word.text == "function":
                    self.blank()
                    self.word()
                    return None
            if not own.words and _assigns(self.text[begin : self.at]):
                own.assigned.append(word)
            else:
                own.words.append(word)
        return own if own.words or own.assigned or own.redirects or own.heredoc is not None else None

    def head(self, own: Command, kind: str) -> Command | None:
        """The words of for and case, of which only substitutions run."""
        while self.at < len(self.text) and self.text[self.at] not in ";\n":
            self.blank()
            if self.at >= len(self.text) or self.text[self.at] in ";\n":
                break
            begin = self.at
            word = self.word()
            self.at += self.at == begin
            own.assigned.append(word)
            if kind == "case" and word.text == "in":
                break
        if kind == "case":
            return self.cases(own)
        return own if any(w.inner for w in own.assigned) else None

    def cases(self, own: Command) -> Command:
        """Branches up to esac: patterns run nothing, what follows them does."""
        while self.at < len(self.text):
            self.blank()
            if self.at < len(self.text) and self.text[self.at] == "\n":
                self.line_end()
                continue
            if self.text.startswith("esac", self.at):
                self.at += 4
                break
            close = self.text.find(")", self.at)
            if close < 0:
                self.at = len(self.text)
                break
            self.at = close + 1
            branch = _branch_end(self.text, self.at)
            own.bodies.append(_Reader(self.text[: branch[0]], self.at, self.depth).program())
            self.at = branch[1]
        return own

    def word(self) -> Word:
        out = Word()
        text = self.text
        while self.at < len(text):
            c = text[self.at]
            if c == "\\":
                out.text += "" if text.startswith("\\\n", self.at) else text[self.at + 1 : self.at + 2]
                out.quoted = True
                self.at += 2
            elif c == "'":
                end = text.find("'", self.at + 1)
                end = len(text) if end < 0 else end
                out.text += text[self.at + 1 : end]
                out.quoted, self.at = True, end + 1
            elif c == '"':
                out.quoted = True
                self.at += 1
                while self.at < len(text) and text[self.at] != '"':
                    if text[self.at] == "\\" and text[self.at + 1 : self.at + 2] in ('"', "\\", "$", "`", "\n"):
                        out.text += text[self.at + 1].replace("\n", "")
                        self.at += 2
                    elif not self.substitution(out):
                        out.text += text[self.at]
                        self.at += 1
                self.at += 1
            elif self.substitution(out):
                continue
            elif text.startswith(("<(", ">("), self.at):
                self.at += 2
                self.inner(out, ")")
            elif c in " \t\r\n;|&<>()":
                break
            else:
                out.text += c
                self.at += 1
        return out

    def inner(self, word: Word, end: str) -> None:
        begin = self.at
        reader = _Reader(self.text, self.at, self.depth + 1)
        word.inner += reader.program(end)
        self.at = min(len(self.text), reader.at + 1)
        word.text += self.text[begin - 2 : self.at]

    def substitution(self, word: Word) -> bool:
        """Reads $(...), $((...)), ${...} or `...` if one begins here."""
        text = self.text
        if text.startswith("$((", self.at):
            end = text.find("))", self.at)
            end = len(text) if end < 0 else end + 2
            word.inner += [line for body in _substituted(text[self.at + 3 : end], self.depth + 1) for line in body]
            word.text += text[self.at : end]
            self.at = end
        elif text.startswith("$(", self.at):
            self.at += 2
            self.inner(word, ")")
        elif text.startswith("${", self.at):
            begin = self.at
            self.at += 2
            held = Word()
            while self.at < len(text) and text[self.at] != "}":
                if not self.substitution(held):
                    self.at += 1
            self.at += 1
            word.inner += held.inner
            word.text += text[begin : self.at]
        elif text.startswith("`", self.at):
            end = self.at + 1
            while end < len(text) and text[end] != "`":
                end += 1 + (text[end] == "\\")
            body = text[self.at + 1 : end].replace("\\`", "`")
            lines = _Reader(body, 0, self.depth + 1).program()
            for command in _walk(lines):
                command.start += self.at + 1
            word.inner += lines
            word.text += text[self.at : end + 1]
            self.at = end + 1
        else:
            return False
        return True


def _branch_end(text: str, at: int) -> tuple[int, int]:
    """Where a branch of a case ends, and where what follows it begins, over quotes, substitutions and inner cases."""
    reader, level = _Reader(text, at), 1
    while reader.at < len(text):
        if text.startswith(";;", reader.at) and level == 1:
            return reader.at, reader.at + 2
        begin = reader.at
        word = reader.word()
        if not word.quoted and word.text in ("case", "esac"):
            level += 1 if word.text == "case" else -1
            if not level:
                return begin, begin
        reader.at += reader.at == begin
    return len(text), len(text)


def _substituted(text: str, depth: int) -> list[list[list[Command]]]:
    """What a text outside quotes, as a here-document's, substitutes."""
    reader, out = _Reader(text, 0, depth - 1), []
    while reader.at < len(text):
        word = Word()
        if text[reader.at] == "\\":
            reader.at += 2
        elif reader.substitution(word):
            out.append(word.inner)
        else:
            reader.at += 1
    return out


def parse(text: str | None) -> list[list[Command]]:
    """The pipelines of a text, in order."""
    return _Reader(text or "").program()


def _walk(lines: list[list[Command]]) -> Iterator[Command]:
    for line in lines:
        for command in line:
            yield command
            for word in (*command.assigned, *command.words, *(w for _, w in command.redirects)):
                yield from _walk(word.inner)
            for body in command.bodies:
                yield from _walk(body)


@lru_cache(maxsize=4_096)
def commands(text: str | None) -> tuple[Command, ...]:
    """All commands of a text that name a program, in the order of their starts; those of a here-document after it."""
    return tuple(c for c in _walk(parse(text)) if c.name)
