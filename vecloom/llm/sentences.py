"""Sentence boundaries in any language and script.

A line is read once by a pushdown automaton. A stack pairs quotations and brackets of every kind; what stands
inside a closed pair is never divided. List markers are told apart at the start of a line. At a final mark outside all pairs the
word before it is looked up, from its end, in a trie of abbreviations, and the script and case of what follows decide. The
result are end offsets in code points.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

# Abbreviations after which a sentence goes on, whatever follows.
INNER = """
dr prof mr mrs ms mx st sr sra srta srs dra drs fr hr hrn dipl ing vs cf e.g i.e eg bzw z.b d.h u.a o.ä vgl evtl ggf inkl
av avda ud uds p.ej p.ex p.es env mme mlle c.-à-d j.-p np tzn tj tzw ul mgr inż jl dhr mevr bijv dott dott.ssa sig sig.ra sigg sig.na avv geom
т.е см ул вул просп напр проф доц акад yth sdr tn ny örn yrd doç bkz mah cad डॉ प्रो नं श्री सुश्री messrs approx aprox
hon gen col capt lt sgt rev gov sen rep pres mt
""".split()

# Abbreviations only where a number follows.
COUNTED = """
no nos nr nrs fig figs vol vols ch chap sec p pp pg ca cca circa núm n art pág págs ok hab tys mln mld тыс тис млн млрд рис ок бл стр с г ver rev mm
""".split()

# Abbreviations that may close a sentence; it ends when a capital follows.
OUTER = """
etc usw itd itp dll dsb enz ecc vb vs. т.д т.п т.н и.т.д і.т.д тощо a.m p.m hrs hr min sec co inc ltd corp jr bros dept est u.k u.s u.s.a e.u д.р др inne
""".split()

TIMES = frozenset(("a.m", "p.m"))
# Words before a number that make it an ordinal.
ORDINAL = frozenset("am der die das dem den des vom zum zur im bis seit ab beim jeder jede jedes".split())

PAIRS = {"(": ")", "[": "]", "{": "}", "（": "）", "［": "］", "【": "】", "〔": "〕", "「": "」", "『": "』", "《": "》", "〈": "〉", "«": "»", "‹": "›", "“": "”", "„": "“”", "‚": "‘’", "‟": "”", "〝": "〞〟"}
OPENERS_OF = {c: frozenset(o for o, cs in PAIRS.items() if c in cs) for c in "".join(PAIRS.values())}
CLOSERS = frozenset("".join(PAIRS.values()) + '"')
OPENERS = frozenset(PAIRS) | frozenset('"')

EMOJI = r"(?:[\U0001F1E6-\U0001F1FF]{2}|(?:[‼⁉™ℹ↔-↪⌚-⏿Ⓜ▪-◾☀-➿⤴⤵⬅-⭕〰〽㊗㊙\U0001F000-\U0001F1E5\U0001F200-\U0001FAFF][︎️⃣\U0001F3FB-\U0001F3FF]*)(?:‍[←-⯿\U0001F000-\U0001FAFF][︎️\U0001F3FB-\U0001F3FF]*)*)"
_EMOJI = regex.compile(EMOJI)
_EMOJI_LAST = regex.compile(EMOJI + "$")
_LINE = regex.compile(r"[^\n\r  \x0b\x0c\x85]+")
_MARK = regex.compile(r"[.!?…‥。！？｡．؟۔।॥!]+(?:[   ][!?]+)?")
_STACK = regex.compile("[" + regex.escape("".join(sorted(OPENERS | CLOSERS | set("‘’"))), special_only=False) + "]")
_URL = regex.compile(r"(?:https?://|www\.)[A-Za-z0-9\-._~:/?#\[\]@!$&'()*+,;=%]+")
_MARKER = regex.compile(r"\s*(?:[-*+•‣·>]\s+)*(?:\(?\d{1,3}[.)]|[a-zA-Z]\))(?=\s)")
_THAI_GAP = regex.compile(r"(?<=[฀-๿”\"’»)])[ \t 　]+")
_THAI = regex.compile(r"[฀-๿]")
_CAPITAL = regex.compile(r"[\p{Lu}\p{Lt}]")
_SMALL = regex.compile(r"(?s)(?:[^\p{Ll}]*+\p{Ll}){20}")
_WORD = regex.compile(r"[\p{L}\p{M}\p{N}.'’\-]+$")
_LETTER_DOT = regex.compile(r"\p{L}\.")
_NEXT_LETTER = regex.compile(r"\p{L}")
ALWAYS = frozenset("。！？｡؟۔।॥")
# Particles that tie a caseless quotation to the words after it.
TIES = ("と", "って", "との", "라", "이라", "고", "하", "며", "는", "란")


def _trie(words: list[str], value: int, root: dict) -> None:
    for w in words:
        at = root
        for c in reversed(w):
            at = at.setdefault(c, {})
        at.setdefault("", value)


ABBREVIATIONS: dict = {}
_trie(INNER, 3, ABBREVIATIONS)
_trie(COUNTED, 2, ABBREVIATIONS)
_trie(OUTER, 1, ABBREVIATIONS)


def _abbreviation(line: str, dot: int) -> tuple[int, str]:
    """(3 inner, 2 before numbers, 1 outer, 0 none; the word) for the word that ends before the dot; spaces after inner dots don't count."""
    at, node, i, best, word = dot - 1, ABBREVIATIONS, dot - 1, 0, ""
    while i >= 0:
        c = line[i].lower()
        if c.isspace() and word and i > 0 and line[i - 1] == ".":
            i -= 1
            continue
        if c not in node:
            break
        node = node[c]
        word = c + word
        if "" in node and (i == 0 or not (line[i - 1].isalnum() or line[i - 1] in "-'’")):
            best, at = node[""], i
            found = word
            whole = i == 0 or line[i - 1] != "."
            if whole:
                i -= 1
                if i < 0 or not line[i].isspace():
                    return best, found
                kept = (best, found)
                # a longer one may lie across a space ("т. д" beside "д")
                if i > 0 and line[i - 1] == ".":
                    continue
                return kept
        i -= 1
    return (best, found) if best else (0, "")


def _cased(c: str) -> int:
    """1 capital, -1 small, 0 caseless."""
    return 1 if c.isupper() or c.istitle() else -1 if c.islower() else 0


def _pairs(line: str) -> list[tuple[int, int]]:
    """Outermost closed pairs of a line, both ends included. Linear: the stack is searched only for an opener it holds."""
    stack: list[tuple[str, int]] = []
    held: dict[str, int] = {}
    found: list[tuple[int, int]] = []
    n = len(line)

    def push(c: str, i: int) -> None:
        stack.append((c, i))
        held[c] = held.get(c, 0) + 1

    def close(openers: Iterable[str], i: int) -> bool:
        """Closes the innermost of the openers, and drops what stayed open inside."""
        if not any(held.get(o) for o in openers):
            return False
        while True:
            o, at = stack.pop()
            held[o] -= 1
            if o in openers:
                found.append((at, i))
                return True

    for m in _STACK.finditer(line):
        i, c = m.start(), m.group()
        if c == '"':
            if not close('"', i) and not (i and line[i - 1].isdigit() and (i + 1 == n or not line[i + 1].isalpha())):
                push('"', i)
        elif c in "‘’":
            top = stack[-1][0] if stack else ""
            if i and i + 1 < n and line[i - 1].isalpha() and line[i + 1].isalpha():
                continue
            if c == "‘" and top != "‚":
                push("‘", i)
            elif top in ("‘", "‚"):
                close(top, i)
        elif not (c in OPENERS_OF and close(OPENERS_OF[c], i)) and c in PAIRS:
            push(c, i)
    if not found:
        return found
    found.sort()
    outer: list[tuple[int, int]] = []
    for s, e in found:
        if not outer or s > outer[-1][1]:
            outer.append((s, e))
    return outer


def _absorb(line: str, i: int, openers: dict[int, int]) -> int:
    """The end after closing quotes, brackets and emoji that follow directly or after one space."""
    n = len(line)
    while i < n:
        at = i + 1 if line[i].isspace() else i
        if at < n and (m := _EMOJI.match(line, at)):
            i = m.end()
        elif at < n and line[at] in CLOSERS and at not in openers and line[at] not in '“"':
            i = at + 1
        elif at == i and line[i] in '“"' and i not in openers:
            i += 1
        else:
            return i
    return i


def _line_ends(line: str, base_lower: bool) -> Iterator[int]:
    n = len(line)
    events: list[tuple[int, int, int]] = [(*m.span(), 0) for m in _MARK.finditer(line)]  # (position, end of marks, kind) kind 0 mark, 1 pair, 2 Thai gap
    pairs = _pairs(line)
    events += [(e, e + 1, 1) for _, e in pairs]
    if not line.isascii() and _THAI.search(line):
        events += [(m.start(), m.start(), 2) for m in _THAI_GAP.finditer(line)]
    if not events or len(events) == 1 and events[0][1] == n and events[0][2] == 0:
        return  # no boundary, or only the end of the line
    openers = dict(pairs)
    urls = [m.span() for m in _URL.finditer(line)] if "://" in line or "www." in line else []
    marker = _MARKER.match(line)
    events.sort()
    starts = {e: s for s, e in pairs}
    start, p, u, done = 0, 0, 0, -1
    for at, end, kind in events:
        if at < done:
            continue
        while p < len(pairs) and pairs[p][1] < at:
            p += 1
        if kind != 1 and p < len(pairs) and pairs[p][0] < at < pairs[p][1]:
            continue
        if marker and at < marker.end():
            continue
        while u < len(urls) and urls[u][1] <= at:
            u += 1
        if u < len(urls) and urls[u][0] <= at and end < urls[u][1]:
            continue
        if kind == 2:
            nxt = at
            while nxt < n and line[nxt].isspace():
                nxt += 1
            prev = line[at - 1]
            if prev.isdigit() or (nxt < n and line[nxt].isdigit()) or nxt >= n:
                continue
            if prev in CLOSERS or prev == "’":
                s = starts.get(at - 1)
                if s is None or not _THAI.search(line, s, at):
                    continue
            if line[nxt] == "ๆ":
                continue
            stop = _absorb(line, at, openers)
        elif kind == 1:
            inner = line[starts[at] + 1 : at].rstrip()
            while inner and (inner[-1] in CLOSERS or inner[-1] == "’"):
                inner = inner[:-1].rstrip()
            while inner and (m := _EMOJI_LAST.search(inner)):
                inner = inner[: m.start()].rstrip()
            if not inner or not _MARK.fullmatch(inner[-1]):
                continue
            stop = _absorb(line, end, openers)
            if not _after_pair(line, stop, start, starts[at], base_lower):
                continue
        else:
            stop = _absorb(line, end, openers)
            if not _after_mark(line, at, end, stop, start, base_lower):
                continue
        yield stop
        done = start = stop


def _after_pair(line: str, stop: int, start: int, opened: int, base_lower: bool) -> bool:
    """Does a sentence end behind a pair whose content ends with a final mark?"""
    n, i = len(line), stop
    while i < n and line[i].isspace():
        i += 1
    if i >= n:
        return True
    c = line[i]
    if c in ",;:、，；：-–—" or c in ".!?。！？…":
        return False
    if c.isalpha():
        case = _cased(c)
        lead = line[start:opened].strip(" \t 　-*•>_#")
        if case == 1:
            return True
        if case == -1:
            return base_lower and not lead
        if lead:
            return False
        return not (i == stop and line.startswith(TIES, i))
    return True


def _after_mark(line: str, at: int, end: int, stop: int, start: int, base_lower: bool) -> bool:
    """Does a sentence end at the final marks line[at:end], closers and emoji up to stop included?"""
    n, i = len(line), stop
    while i < n and line[i].isspace():
        i += 1
    if i >= n:
        return True
    marks = line[at:end]
    c = line[i]
    if any(m in ALWAYS for m in marks):
        return c not in ",;:、，；："
    if "!" in marks or "?" in marks:
        if c in ",;:" or (stop == i and c in "-/=&"):
            return False
        return not (c.isalpha() and _cased(c) == -1 and not base_lower)
    if len(marks) > 1 or marks in "…‥":
        letter = _NEXT_LETTER.search(line, i)
        return bool(letter) and _cased(letter.group()) == 1
    # a single full stop
    if c in ",;:)]}/" or at == 0:
        return False
    before = line[at - 1]
    if stop == i and stop == end:  # no space, nothing absorbed
        if c.isdigit() or c in "-_@#%&=+*":
            return False
        case = _cased(c) if c.isalpha() else 0
        if c.isalpha() and case == -1:
            return False
        if c.isalpha() and case == 1 and not (before.islower() or before.isdigit() or _cased(before) == 0):
            return False
        if c.isalpha() and case == 0 and not (before.isalpha() and _cased(before) == 0):
            return False
    elif c.isalpha() and _cased(c) == -1 and not base_lower:
        return False
    kind, word = _abbreviation(line, at)
    if kind == 3 or kind == 2 and (c.isdigit() or c in "°º#"):
        return False
    if kind == 1:
        if word in TIMES and len(line[start:at].split()) <= 3:
            return False
        return not (c.isalpha() and _cased(c) == -1)
    if before.isalpha() and _cased(before) != 0 or "؀" <= before <= "ۿ":
        alone = at < 2 or not (line[at - 2].isalnum() or line[at - 2] in "'’")
        if alone and before.isalpha() and (_cased(before) >= 0 or c.isdigit() or _LETTER_DOT.match(line, i)):
            return False  # an initial, or the first of several letters
    if before.isdigit():
        m = _WORD.search(line, start, at)
        number = m.group() if m else ""
        lead = line[start : m.start()] if m else ""
        if number.isdigit():
            if not lead.strip(" \t -*•>_#([\"'“„«"):
                return False  # a number that opens the sentence
            words = lead.split()
            if len(number) <= 2 and words and words[-1].lower() in ORDINAL:
                return False
    return True


def sentence_ends(text: str | None) -> list[int]:
    """Offsets behind each sentence, trailing white space excluded; the empty list for null and blank texts."""
    if not text:
        return []
    base_lower = not _CAPITAL.search(text) and bool(_SMALL.match(text))  # a text without capitals says nothing by small letters
    out: list[int] = []
    for m in _LINE.finditer(text):
        line, base = m.group(), m.start()
        if line.isspace():
            continue
        last = 0
        for stop in _line_ends(line, base_lower):
            piece = line[last:stop].rstrip()
            if piece.strip():
                out.append(base + last + len(piece))
            last = stop
        piece = line[last:].rstrip()
        if piece.strip():
            out.append(base + last + len(piece))
    return out


def split_sentences(rows: DataFrame, keys: list[str], text: str) -> DataFrame:
    """(keys, sent_end) for every row: one row per sentence. Null and blank texts have none; repeated rows count once."""
    kinds = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys)
    narrow = rows.select(*keys, F.col(text).alias("_text")).filter("_text is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                ends = [sentence_ends(t) for t in part.column(len(keys)).to_pylist()]
                yield pa.RecordBatch.from_arrays([*[part.column(i) for i in range(len(keys))], pa.array(ends, pa.list_(pa.int32()))], [*keys, "ends"])

    return narrow.mapInArrow(run, f"{kinds}, ends array<int>").select(*keys, F.explode("ends").alias("sent_end")).distinct()
