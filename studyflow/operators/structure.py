"""Lines of exam pages: the tokens that give a line its structure, the parts between them, and which lines belong together.

A line is read once.  The scanner gives typed tokens (a number that may begin a question, an option label, an answer or
analysis mark), a pass over the tokens sets the places where the line is cut.  For joining, a line is a kind and a few
properties, and a table of rules says whether it goes on the line before.  What a line joins depends on the lines joined
before it, so a page is a fold; :mod:`.corpus` groups the pages.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import NamedTuple

from ..functions import marks as M

#: What a token may be (fixed values): the form of a question number inside a line, option labels, and marks of solutions.
_TOKEN = re.compile(rf"(?P<question>(?<!\d)(?:第\s*)?(?:{M.NUMBER})\s*(?:题|[.、．)])\s*(?=\S))|(?P<label>{M.LABEL})|(?P<answer>{M.ANSWER})|(?P<analysis>{M.ANALYSIS})")
#: What a line may be: the first form that it begins with; other lines are text.
_KIND = re.compile("|".join(f"(?P<{name}>{form})" for name, form in (
    ("question", M.QUESTION), ("section", M.SECTION), ("entry", M.ENTRY), ("option", M.OPTION), ("answer", M.ANSWER_HEAD), ("analysis", M.ANALYSIS_HEAD), ("amount", r"^\s*(?:\d\s*){1,3}$"),
)))
_QUESTION_HEAD, _SECTION_LINE, _SIGN = re.compile(M.QUESTION), re.compile(M.SECTION), re.compile(M.SIGN)
#: Figures: numbers with several points, sums with a unit, formulas (fixed values).
_FIGURE = re.compile(r"\d+(?:\.\d+)+|\d+(?:\.\d+)?(?:万元|元|分|%)|(?=.*\d)[\d+\-*/=.()（）万元分%]+")
#: Ends after which a question may begin, after which a long line is whole, and after which a text goes on; what closes a text before it; words that begin a solution (fixed values).
_BREAKS, _WHOLE, _OPEN = (*M.STOPS, ")", "）", "]", "】"), ("。", "！", "？", ")", "）"), ("：", ":", "，", ",", "（", "(", "、")
_CLOSES, _SOLUTION = re.compile(r"[，,。．、；;：:）)\]】%]"), ("答案", "解析", "正确答案", "参考答案")
#: Characters of a line that may always go on, and of one that may be whole.
_SHORT, _LONG = 32, 64


class Token(NamedTuple):
    kind: str
    start: int
    end: int


def scan(line: str) -> list[Token]:
    return [Token(m.lastgroup, *m.span()) for m in _TOKEN.finditer(line)]


def is_figure(text: str) -> bool:
    return _FIGURE.fullmatch("".join(text.split())) is not None


def question_starts(line: str, tokens: list[Token]) -> Iterator[int]:
    """Places inside the line where a question begins: with a text of its own, after something that is whole.

    Whole is a section's name, what has options or a solution, and what ends with a stop.
    """
    origin, seen = 0, []
    for t in tokens:
        if t.kind == "question" and t.start > origin and (before := line[origin : t.start].strip()):
            head = _QUESTION_HEAD.match(line[t.start :])
            body = line[t.start + head.end() :].strip() if head else ""
            options = [x for x in seen if x.kind == "label"]
            whole = (
                before.endswith(_BREAKS) or len(options) > 1 or any(x.kind in ("answer", "analysis") for x in seen)
                or (options and not line[origin : options[0].start].strip()) or _SECTION_LINE.match(before)
            )
            if len(body) > 1 and not is_figure(body) and whole:
                yield t.start
                origin, seen = t.start, []
        seen.append(t)


def role_cuts(line: str, tokens: list[Token], a: int, b: int) -> tuple[list[tuple[int, int]], list[tuple[int, int]], list[tuple[int, int]]]:
    """Ranges of stem, options and solution of the question from a to b.

    Options are cut where labels A and B come first, after no stem or one that asks.  Of a solution whose analysis
    comes first, the answer alone stays.
    """
    first: dict[str, int] = {}
    for t in tokens:
        first.setdefault(t.kind, t.start)
    marks = sorted(first[k] for k in ("answer", "analysis") if k in first)
    tail = marks[0] if marks else b
    labels = [t for t in tokens if t.kind == "label" and t.end <= tail]
    names = list(dict.fromkeys(line[t.start] for t in labels))
    stem_end = labels[0].start if labels else tail
    stem = line[a:stem_end].strip()
    options = [(t.start, end) for t, end in zip(labels, [*(t.start for t in labels[1:]), tail])]
    asked = names[:2] == ["A", "B"] and (any(cue in stem for cue in M.CUES) if stem else any(line[i + 2 : j].strip() for i, j in options))
    if not asked:
        options = []
    if len(marks) == 2 and first["analysis"] < first["answer"]:
        marks = marks[1:]
    solution = list(zip(marks, [*marks[1:], b]))
    return [(a, stem_end if asked else tail)], options, solution


def structural_parts(line: str) -> list[str]:
    """A line's questions, each cut into stem, options, answer and analysis; a blank line has none."""
    line = line.strip()
    tokens = scan(line)
    if not tokens:
        return [line] if line else []
    cuts = [0, *question_starts(line, tokens), len(line)]
    out: list[str] = []
    for a, b in zip(cuts, cuts[1:]):
        stem, options, solution = role_cuts(line, [t for t in tokens if a <= t.start < b], a, b)
        if len(cuts) == 2 and not options and not solution:
            return [line] if line else []
        one_line = (lambda x: " ".join(x.split())) if options else str.strip
        parts = [one_line(line[i:j]) for i, j in stem]
        parts += [f"{line[i]}. {text}" for i, j in options if (text := " ".join(line[i + 2 : j].split()))]
        out += [p for p in (*parts, *(line[i:j].strip() for i, j in solution)) if p]
    return out or [line]


@dataclass(frozen=True)
class Line:
    """What joining looks at."""

    text: str
    kind: str

    @classmethod
    def of(cls, text: str) -> Line:
        m = _KIND.match(text)
        return cls(text, m.lastgroup if m else "text")

    def wraps_into(self, after: Line) -> bool:
        """Whether the break between the two falls within a text: a closing mark follows, or signs stand on both sides."""
        return bool(_CLOSES.match(after.text) or (_SIGN.match(self.text[-1]) and _SIGN.match(after.text)))


#: Kinds that nothing joins; a line that joins another is text.
_APART = frozenset(("entry", "option", "answer", "analysis", "amount"))
#: Whether a line goes on the one before: the first rule whose condition holds decides.
JOINS: tuple[tuple[bool, Callable[[Line, Line], bool]], ...] = (
    (False, lambda a, b: not a.text or not b.text or a.kind in _APART or b.kind != "text"),
    (False, lambda a, b: len(a.text) > _LONG and a.text.endswith(_WHOLE)),
    (True, lambda a, b: len(a.text) <= _SHORT or a.text.endswith(_OPEN)),
    (False, lambda a, b: a.text.endswith(M.STOPS) or is_figure(a.text)),
    (False, lambda a, b: len(_SIGN.findall(b.text)) < 2 or b.text.startswith(_SOLUTION) or is_figure(b.text)),
    (True, Line.wraps_into),
)


def joins(before: Line, line: Line) -> bool:
    return next((verdict for verdict, holds in JOINS if holds(before, line)), False)


@dataclass
class Fold:
    """The lines of a page so far."""

    lines: list[Line] = field(default_factory=list)
    merged: int = 0
    split: int = 0
    #: Which input lines are short numbers of accounting entries.
    numbers: list[bool] = field(default_factory=list)

    def take(self, parts: list[str]) -> None:
        self.split += len(parts) - 1
        for line in map(Line.of, parts):
            if self.lines and joins(self.lines[-1], line):
                self.lines[-1] = Line.of(f"{self.lines[-1].text} {line.text}".strip())
                self.merged += 1
            else:
                self.lines.append(line)


def fold_page(texts: list[str], reasons: list[str | None]) -> Fold:
    """The lines without a reason to drop them, cut and joined.  A number of up to three digits stays where the line before it in the result, or the next line, begins an accounting entry."""
    page = Fold()
    kinds = [Line.of(t).kind for t in texts]
    for text, reason, kind, after in zip(texts, reasons, kinds, [*kinds[1:], ""]):
        in_entry = kind == "amount" and "entry" in (after, page.lines[-1].kind if page.lines else "")
        page.numbers.append(in_entry)
        if in_entry:
            page.take([text])
        elif reason is None:
            page.take(structural_parts(text))
    return page
