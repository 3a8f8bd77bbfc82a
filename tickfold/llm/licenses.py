"""License scans: an Aho-Corasick automaton over normalised words, and a shunting-yard parser for
license expressions."""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import WORD_BYTES, texts, utf8

# The base phrases and their labels.
BASE = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}
# Notice phrases of the method's own: label, and whether the license is permissive.
NOTICES = {
    "gnu general public license": ("gpl", False),
    "gnu general public license version 2": ("gpl-2", False),
    "gnu general public license version 3": ("gpl-3", False),
    "gnu lesser general public license": ("lgpl", False),
    "gnu affero general public license": ("agpl", False),
    "mozilla public license": ("mpl", False),
    "eclipse public license": ("epl", False),
    "creative commons attribution": ("cc-by", True),
    "cc by sa": ("cc-by-sa", False),
    "redistribution and use in source and binary forms": ("bsd", True),
    "bsd license": ("bsd", True),
    "permission is hereby granted free of charge": ("mit", True),
    "isc license": ("isc", True),
    "all rights reserved": ("proprietary", False),
}
TAG = "spdx license identifier"
PERMISSIVE = {"mit", "apache-2", "bsd", "isc", "cc-by", "cc0", "unlicense", "zlib"}
# Families of license identifiers; a name is known if it is one of them, or one followed by a hyphen or a version.
FAMILIES = (
    "0bsd", "afl", "agpl", "apache", "apsl", "artistic", "beerware", "blueoak", "bsd", "bsl", "busl", "bzip2", "cc0", "cc-by", "cddl", "cecill", "cpl", "curl",
    "ecl", "efl", "elastic", "epl", "etalab", "eupl", "fsfap", "ftl", "gfdl", "gpl", "hpnd", "icu", "ijg", "ipl", "isc", "json", "lgpl", "libpng", "licenseref",
    "lppl", "mit", "mpl", "ms-pl", "ms-rl", "mulanpsl", "ncsa", "nist-pd", "npl", "odbl", "odc-by", "ofl", "oldap", "openssl", "osl", "pddl", "php", "postgresql",
    "psf", "python", "qpl", "ruby", "sgi-b", "sissl", "sleepycat", "sspl", "tcl", "unicode", "unlicense", "upl", "vim", "w3c", "wtfpl", "x11", "xnet", "zlib", "zpl",
)
_KNOWN = re.compile(rf"(?:{'|'.join(map(re.escape, FAMILIES))})(?:-|v?[0-9]|$)")
_TAG_LINE = re.compile(rb"(?i)spdx[^0-9a-z\x80-\xff]+license[^0-9a-z\x80-\xff]+identifier[ \t]*:?[ \t]*([^\r\n]*)")
_TOKEN = re.compile(r"[()]|[A-Za-z0-9.+:\-]+|\S")
_PRIORITY = {"or": 1, "and": 2, "with": 3}


def label_of(identifier: str) -> str:
    """The label of a license identifier: lower case, without trailing ``.0``, ``-only`` and ``-or-later``."""
    name = re.sub(r"-(only|or-later|clause|new|revised)\b|\+$", "", identifier.lower())
    name = re.sub(r"(\d)\.0\b", r"\1", name)
    if m := re.match(r"(cc-by(?:-nc|-sa|-nd)*)-\d", name):
        return m[1]
    return re.sub(r"^(bsd)-\d$", r"\1", name)


def postfix(expression: str) -> list[str]:
    """The expression in postfix order; ``with`` binds tighter than ``and``, ``and`` tighter than ``or``.

    It ends at the first symbol that can't continue it, so text after a tag on its line does no harm.
    """
    out: list[str] = []
    stack: list[str] = []
    want = True  # an operand comes next
    for token in _TOKEN.findall(expression):
        low = token.lower()
        if token == "(" and want:
            stack.append(token)
        elif low in _PRIORITY and not want:
            while stack and stack[-1] != "(" and _PRIORITY[stack[-1]] >= _PRIORITY[low]:
                out.append(stack.pop())
            stack.append(low)
            want = True
        elif token == ")" and not want and "(" in stack:
            while stack[-1] != "(":
                out.append(stack.pop())
            stack.pop()
        elif want and low not in _PRIORITY and re.match(r"[A-Za-z0-9]", token):
            out.append(token)
            want = False
        else:
            break
    if want and stack and stack[-1] in _PRIORITY:  # an operator without its right side
        stack.pop()
    return out + [x for x in reversed(stack) if x != "("]


def choices(expression: str) -> list[frozenset[str]]:
    """The sets of labels one of which the expression asks for; none if it names no license. Their number doubles
    with each ``or`` that ``and`` joins; ``judged`` needs none of them."""
    stack: list[list[frozenset[str]]] = []
    for token in postfix(expression):
        if token not in _PRIORITY:
            stack.append([frozenset([label_of(token)])])
            continue
        right, left = stack.pop(), stack.pop()
        if token == "or":
            made = left + [x for x in right if x not in left]
        elif token == "and":
            made = [a | b for a in left for b in right]
        else:
            made = [frozenset(f"{x}-with-{y}" for x in a for y in r) for a in left for r in right]
        stack.append(made)
    return stack[0] if stack else []


def judged(expression: str) -> tuple[frozenset[str], bool] | None:
    """(all labels of the expression's known licenses, whether it leaves a choice of permissive licenses only); a name
    of no known family has no label and isn't permissive. None without a known license."""
    stack: list[tuple[frozenset[str], bool, str]] = []
    for token in postfix(expression):
        if token not in _PRIORITY:
            label = label_of(token)
            stack.append((frozenset([label] if _KNOWN.match(label) else []), label in PERMISSIVE, label))
            continue
        (right, also, name), (left, free, _) = stack.pop(), stack.pop()
        if token == "with":
            stack.append((frozenset(f"{x}-with-{name}" for x in left), free, name))
        else:
            stack.append((left | right, free or also if token == "or" else free and also, name))
    return stack[0][:2] if stack and stack[0][0] else None


def automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for phrase in {*BASE, *NOTICES, TAG}:
        found.add_word(f" {phrase} ", (phrase, len(phrase) + 1))
    found.make_automaton()
    return found


def scan(text: bytes | None, ac: ahocorasick.Automaton) -> tuple:
    """(words, base places, first, last, base labels, all labels, permissive, score) of one text."""
    parts = text.translate(WORD_BYTES).split() if text else []
    line = f" {b' '.join(parts).decode('latin-1')} "
    starts, base, labels, free = [], set(), set(), []
    tagged, weak = False, 1.0
    at = word = 0  # blanks are counted from the last hit on, as a text may be full of notices
    for end, (phrase, back) in ac.iter(line) if parts else ():
        if phrase in BASE:
            start = end - back
            word += line.count(" ", at, start) if start >= at else -line.count(" ", start, at)
            at = start
            starts.append(word)
            base.add(BASE[phrase])
            free.append(BASE[phrase] in PERMISSIVE)
        elif phrase == TAG:
            tagged = True
        else:
            labels.add(NOTICES[phrase][0])
            free.append(NOTICES[phrase][0] in PERMISSIVE)
            weak *= 0.4
    if tagged:
        for m in _TAG_LINE.finditer(text):
            if found := judged(m[1].decode("utf-8", "replace")):
                labels |= found[0]
                free.append(found[1])
                weak *= 0.05
    labels |= base
    permissive = all(free) if free else None
    score = 1 - weak * 0.1 ** len(starts)
    return len(parts), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), permissive, score


def _kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    ac = automaton()
    kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.bool_(), pa.float64()]
    names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "permissive", "score"]
    for batch in batches:
        rows = [scan(t, ac) for t in utf8(batch, "text")]
        columns = [pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)]
        yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["id", *names])


def scan_licenses(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: n_words, n_base (places of base phrases), first_word and last_word (their smallest and
    largest start, else null), base_labels and labels (distinct, sorted, comma-joined), permissive
    (whether every notice leaves a choice of permissive licenses only; null without notices), score
    (0: no notice; each base phrase, tag and other notice takes a share of what is left to 1).

    Null and empty texts have no words and empty labels; a tag that names no known license adds none. Rows, ids and ties stay as they are; other
    columns are not looked at.
    """
    base = texts(df, id_col, text_col)
    shape = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, permissive boolean, score double"
    return base.mapInArrow(_kernel, f"id {dict(base.dtypes)['id']}, {shape}").withColumnRenamed("id", id_col)
